"""The level-setting loop against a loop over samples, in batch and on streams cut anywhere."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.meta import ANALYTIC, ObsMeta, Signal
from cadenza.operators.leveling import Target, apply_levels, changes, set_levels
from cadenza.streaming.leveling import streaming_level_setting
from cadenza.streaming.subint import run_to_table


def by_hand(z, integrate, target, block=None, settle=0, weight=None):
    """(iteration, epoch, digitizer, n, mean, variance, gain, level) of samples z (time, digitizer), one sample and one digitizer at a time."""
    ndat, count = z.shape
    gain, level, at, iteration, out, setting = [1.0] * count, [0.0] * count, 0, 0, [], True
    while at < ndat:
        found = [[] for _ in range(count)]
        if block is None:
            stop = min(at + integrate, ndat)
        else:
            stop = at
            while sum(weight is None or weight[t] != 0 for t in range(at, stop)) < integrate:
                stop += block
                if stop > ndat:
                    return out
        for t in range(at, stop):
            for d in range(count):
                if weight is None or weight[t] != 0:
                    found[d].append(gain[d] * (z[t, d] - level[d]))
        iteration += 1
        far = False
        rows = []
        for d in range(count):
            n = len(found[d])
            mean = sum(found[d]) / n if n else 0.0
            variance = sum((x - mean) ** 2 for x in found[d]) / n if n else 0.0
            old = gain[d]
            if setting and variance > 0:
                off = abs(variance - target.variance)
                if off >= target.variance_tolerance:
                    far = far or off > 5 * target.variance_tolerance
                    gain[d] = old * (target.variance / variance) ** 0.5
                if not far and abs(mean) > target.mean_tolerance:
                    level[d] += mean / old
            rows.append((iteration, stop, d, n, mean, variance, gain[d], level[d]))
        out += rows
        if not far and not target.watch or iteration == target.most:
            return out
        at = stop + settle * (block or 0)
    return out


def signal(spark, z, ndim=1, npol=2):
    ndat, count = z.shape
    nchan = count // npol // ndim
    v = z.reshape(ndat, nchan, npol, ndim)
    rows = [(t, c, p, *map(float, v[t, c, p])) for t in range(ndat) for c in range(nchan) for p in range(npol)]
    df = spark.createDataFrame(rows, "idat long, ichan int, ipol int, " + ("v double" if ndim == 1 else "re double, im double"))
    return Signal(df, ObsMeta(nchan=nchan, npol=npol, ndim=ndim, ndat=ndat, state=ANALYTIC if ndim == 2 else "PPQQ"))


def drifting(n, count, seed=4):
    """Noise of which strength and mean drift, differently by digitizer."""
    rng, t = np.random.default_rng(seed), np.arange(n)[:, None] / n
    d = np.arange(count)[None, :]
    return rng.normal(size=(n, count)) * (3 + d + np.sin(5 * t + d)) + d - 2 * t


def same(df, want, s):
    got = df.orderBy("iteration", "ichan", "ipol", "idim").collect()
    digitizer = lambda r: (r["ichan"] * s.meta.npol + r["ipol"]) * s.meta.ndim + r["idim"]
    assert [(r["iteration"], r["epoch"], digitizer(r), r["n"]) for r in got] == [w[:4] for w in want] and want
    for r, w in zip(got, want):
        assert [r[c] for c in ("mean", "variance", "gain", "level")] == pytest.approx(list(w[4:]), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("ndim", [1, 2])
@pytest.mark.parametrize("target", [Target(1.0, 0.05, 0.05, watch=True), Target(2.0, 0.2, 0.02), Target(1.0, 0.001, 0.001, most=3)])
def test_settings_are_those_of_a_loop_over_samples(spark, target, ndim):
    z = drifting(330, 4 * ndim)
    s = signal(spark, z, ndim)
    same(set_levels(s, 50, target), by_hand(z, 50, target), s)


def test_each_for_itself(spark):
    target, z = Target(1.0, 0.05, 0.05, watch=True), drifting(200, 4)
    s = signal(spark, z)
    settings = set_levels(s, 40, target, together=False)
    for d in range(4):
        mine = settings.filter((F.col("ichan") == d // 2) & (F.col("ipol") == d % 2)).drop("ichan", "ipol").withColumns({"ichan": F.lit(0), "ipol": F.lit(0)})
        same(mine, by_hand(z[:, [d]], 40, target), Signal(s.df, s.meta.but(nchan=1, npol=1)))


def test_drift_is_levelled(spark):
    """A start of 3 to 6 deviations ends at the wanted variance, and applied settings give samples of it."""
    z = drifting(4000, 4)
    s = signal(spark, z)
    settings = set_levels(s, 1000, Target(1.0, 0.1, 0.1))
    assert settings.agg(F.max("iteration")).first()[0] < 4
    last = settings.orderBy(F.desc("iteration")).first()
    assert last["settled"] and not last["far"]
    out = apply_levels(s, set_levels(s, 1000, Target(1.0, 0.01, 0.01, watch=True)), 1000)
    stats = out.df.filter("idat >= 1000").groupBy("ichan", "ipol").agg(F.var_pop("v").alias("q"), F.avg("v").alias("m")).collect()
    assert all(0.7 < r["q"] < 1.4 for r in stats) and out.df.count() == s.df.count()
    assert out.df.filter("idat < 1000").exceptAll(s.df.filter("idat < 1000")).count() == 0


def test_samples_of_bad_blocks_dont_count(spark):
    z, target = drifting(160, 2), Target(1.0, 0.05, 0.05, watch=True)
    s = signal(spark, z, npol=1)
    cells = spark.range(20).crossJoin(spark.range(2).withColumnRenamed("id", "c")).selectExpr("id AS iw", "cast(c AS int) AS ichan", "0 AS ipol", "cast(id % 3 AS int) AS weight")
    weighted = s.with_weights(cells, 8)
    spoiled = Signal(s.df.withColumn("v", F.when(F.expr("idat div 8 % 3 = 0"), 1e6).otherwise(F.col("v"))), s.meta, weighted.weights)
    got = set_levels(spoiled, 40, target).orderBy("iteration", "ichan").collect()
    want = set_levels(weighted, 40, target).orderBy("iteration", "ichan").collect()
    assert got == want and {r["n"] for r in got} <= {24, 32, 16, 40} and max(r["variance"] for r in got) < 1e3


def test_unusual_digitizers():
    target = Target(1.0, 0.1, 0.1)
    factor, trim, far = changes(np.array([5.0, 0.5, 0.5, 0.5]), np.array([0.0, 1.05, 4.0, 1.0]), target)
    assert factor.tolist() == [1.0, 1.0, 0.5, 1.0] and trim.tolist() == [False, True, False, False] and far.tolist() == [False, False, True, False]
    assert changes(np.array([1.0]), np.array([5e-324]), Target(1e300, 1.0, 1.0))[0].tolist() == [1.0]
    with pytest.raises(ValueError, match="positive"):
        Target(0.0)


def fed(spark, folder, rows, schema, cuts):
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{folder}/b={a:06d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b=*")


@pytest.mark.parametrize("settle", [0, 1])
def test_streams_give_the_same_however_they_are_cut(spark, tmp_path, settle):
    z, target = drifting(200, 2), Target(1.0, 0.05, 0.05, watch=True)
    weight = np.random.default_rng(6).integers(0, 3, 200)
    schema = "idat long, ichan int, ipol int, v double, weight int"
    rows = [(t, 0, p, float(z[t, p]), int(weight[t])) for t in range(200) for p in (0, 1)]
    order = np.arange(400)
    np.random.default_rng(7).shuffle(order[100:160])  # samples of some blocks come in any order
    rows = [rows[i] for i in order]
    meta = ObsMeta(nchan=1, npol=2, ndat=200)
    want = by_hand(z, 20, target, block=10, settle=settle, weight=weight)
    table, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    run = lambda cuts: run_to_table(streaming_level_setting(fed(spark, str(tmp_path / "in"), rows, schema, cuts), meta, 20, 10, target, settle), table, checkpoint)
    run([0, 33, 107, 150, 230])
    run([230, 231, 400])  # from the checkpoint
    out = spark.read.parquet(table)
    assert [r[0] for r in out.select("recorder").distinct().collect()] == [0]
    same(out, want, Signal(out, meta))


def test_a_stream_stops_when_all_is_well_and_refuses_late_samples(spark, tmp_path):
    z, schema, meta = drifting(300, 2), "recorder long, idat long, ichan int, ipol int, re double, im double", ObsMeta(ndim=2, state=ANALYTIC)
    rows = [(r, t, 0, 0, float(z[t, 0] * (r + 1)), float(z[t, 1])) for t in range(300) for r in (0, 1)]
    target = Target(1.0, 0.2, 0.2)
    stream = fed(spark, str(tmp_path / "in"), rows, schema, [0, 200, 450, 600])
    run_to_table(streaming_level_setting(stream, meta, 50, 10, target), str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    for r in (0, 1):
        same(out.filter(f"recorder = {r}"), by_hand(z * [r + 1, 1], 50, target, block=10), Signal(out, meta))
    late = fed(spark, str(tmp_path / "in2"), [*rows[:200], *rows[:1]], schema, [0, 200, 201])
    with pytest.raises(Exception, match="late or repeated"):
        run_to_table(streaming_level_setting(late, meta, 500, 10, target), str(tmp_path / "out2"), str(tmp_path / "cp2"))
