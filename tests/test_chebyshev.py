"""Chebyshev predictors against NumPy's polynomials, and fits against the phases that they were made of."""

import numpy as np
import pytest
from numpy.polynomial import chebyshev as reference
from pyspark.sql import functions as F

from cadenza.functions import predictor
from cadenza.functions.response import dispersion_delay
from cadenza.operators import chebyshev, folding

DAY = 86_400_000_000


def test_clenshaw(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.normal(size=n).tolist(), float(rng.uniform(-1, 1))) for n in (0, 1, 2, 3, 8, 20) for _ in range(5)]
    got = [r[0] for r in spark.createDataFrame(rows, "c array<double>, x double").select(chebyshev.clenshaw(F.col("c"), F.col("x"))).collect()]
    assert got == pytest.approx([reference.chebval(x, c) if c else 0.0 for c, x in rows])


def made(spark, rng, segments=3, ntime=6, nfreq=3, length=3_600_000_000):
    coeffs = [rng.normal(size=(ntime, nfreq)) * 3.0 ** -np.arange(ntime)[:, None] for _ in range(segments)]
    for c in coeffs:
        c[0, 0] += 700 * 1800
        c[1, 0] += 700 * 1800  # 700 turns a second
    rows = [(k, k * length, length, 1200.0, 1600.0, 10**12 + k * 700 * 3600, c.tolist()) for k, c in enumerate(coeffs)]
    return spark.createDataFrame(rows, chebyshev.SCHEMA), coeffs


def test_predicted_phases(spark):
    rng = np.random.default_rng(2)
    table, coeffs = made(spark, rng)
    rows = [(int(u), float(f)) for u, f in zip(rng.integers(-10**9, 12 * 10**9, 300), rng.uniform(1150, 1650, 300))]
    got = {(r.us, r.mhz): (r.turn, r.phase) for r in chebyshev.predicted(spark.createDataFrame(rows, "us long, mhz double"), F.col("us"), F.col("mhz"), table, 0, 3_600_000_000).collect()}
    inside = [(u, f) for u, f in rows if 0 <= u < 3 * 3_600_000_000 and 1200 <= f <= 1600]
    assert set(got) == set(inside) and len(inside) > 100
    for u, f in inside:
        k = u // 3_600_000_000
        want = reference.chebval2d(2 * (u - k * 3_600_000_000) / 3.6e9 - 1, 2 * (f - 1200) / 400 - 1, coeffs[k])
        turn, phase = got[u, f]
        assert turn - 10**12 - k * 700 * 3600 + phase == pytest.approx(want, abs=1e-7) and 0 <= phase < 1


def test_fit_gives_the_phases_again(spark):
    rng = np.random.default_rng(3)
    table, _ = made(spark, rng)
    rows = [(int(u), float(f)) for u, f in zip(rng.integers(0, 3 * 3_600_000_000, 3000), rng.uniform(1200, 1600, 3000))]
    df = spark.createDataFrame(rows, "us long, mhz double").repartition(5)
    taught = chebyshev.predicted(df, F.col("us"), F.col("mhz"), table, 0, 3_600_000_000)
    made_again = chebyshev.fit(taught, 0, 3_600_000_000, 1200.0, 1600.0, 6, 3)
    assert made_again.count() == 3
    new = chebyshev.predicted(taught.withColumnsRenamed({"turn": "t", "phase": "p"}), F.col("us"), F.col("mhz"), made_again, 0, 3_600_000_000)
    worst = new.agg(F.max(F.abs(F.col("turn") - F.col("t") + F.col("phase") - F.col("p")))).first()[0]
    assert worst < 1e-6 and new.count() == 3000
    assert chebyshev.fit(taught.limit(10), 0, 3_600_000_000, 1200.0, 1600.0, 6, 3).count() == 0  # fewer samples than coefficients


def test_a_predictor_of_a_band_from_polynomials(spark):
    segments = [predictor.Segment(k * 3_600_000_000 + 1_800_000_000, 30 * 3600 * k, 0.25, 30.0, (0.0, 0.01 * k, 1e-5), 60.0) for k in range(-1, 3)]
    polynomials = predictor.table(spark, segments)
    dm = 60.0
    out = chebyshev.generate(spark, polynomials, dm, 0, 3_600_000_000, 2, 1200.0, 1600.0, 8, 6)
    rng = np.random.default_rng(4)
    rows = [(int(u), float(f)) for u, f in zip(rng.integers(0, 2 * 3_600_000_000, 200), rng.uniform(1200, 1600, 200))]
    got = chebyshev.predicted(spark.createDataFrame(rows, "us long, mhz double"), F.col("us"), F.col("mhz"), out, 0, 3_600_000_000).collect()
    assert len(got) == 200
    for r in got:
        t = r.us - dispersion_delay(dm, r.mhz) * 1e6
        own = next(s for s in segments if s.mid_us - 1.8e9 <= t < s.mid_us + 1.8e9)
        edge = min(abs(t - s.mid_us - 1.8e9) for s in segments)
        error = (r.turn + r.phase - own.phase(t)) if edge > 1e6 else 0.0
        # each polynomial has its own drift, so a fit over two of them is only as good as they agree
        assert abs(error) < 1e-3
    same = [predictor.Segment(k * 3_600_000_000 + 1_800_000_000, 30 * 3600 * k, 0.25, 30.0, (), 60.0) for k in range(-1, 3)]
    out = chebyshev.generate(spark, predictor.table(spark, same), dm, 0, 3_600_000_000, 2, 1200.0, 1600.0, 4, 8)
    for r in chebyshev.predicted(spark.createDataFrame(rows, "us long, mhz double"), F.col("us"), F.col("mhz"), out, 0, 3_600_000_000).collect():
        t = r.us - dispersion_delay(dm, r.mhz) * 1e6
        own = next(s for s in same if s.mid_us - 1.8e9 <= t < s.mid_us + 1.8e9)
        assert abs(r.turn + r.phase - own.phase(t)) < 1e-6


def test_folding_by_a_fitted_predictor_lines_up_all_channels(spark):
    table, _ = made(spark, np.random.default_rng(5), segments=1)
    rows = spark.range(4000).selectExpr("id * 900001 % 3600000000 AS us", "CAST(id % 4 AS INT) AS ichan", "0 AS ipol").withColumn("mhz", F.col("ichan") * 100 + 1250.0)
    seen = chebyshev.predicted(rows, F.col("us"), F.col("mhz"), table, 0, 3_600_000_000).withColumn("v", F.floor(F.col("phase") * 8))
    folded = folding.fold_predicted(seen, 8)
    assert folded.filter("total <> hits * ibin").count() == 0 and folded.agg(F.sum("hits")).first()[0] == 4000
