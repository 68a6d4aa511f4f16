"""SQL that gives the same rows as the queries, for an independent engine over the same tables.

Nothing here comes from the code under test: periods, thresholds, delays and responses are stated as numbers or derived anew.
"""

from __future__ import annotations

import math

#: Period and bins of the folds, samples of a kurtosis block, and the masked stretches.
PERIOD, NBIN, SK_M = 86_400_000_000 // 7, 16, 32
CELLS = [(3, 20), (15, 30), (100, 101), (400, 520)]
#: Lower, upper and symmetric limits of the kurtosis of 32 samples at 3 deviations, and lower and upper ones of 32, 64 and 128 at 0.5;
#: tests/test_functions.py checks them against the published density.
SK_LOWER, SK_UPPER, SK_SYMMETRIC = 0.3877018068371802, 2.7314792352070207, 0.9996475388614486
SK_NARROW = {32: (0.8098524295603275, 1.0999519616015343), 64: (0.864190615042742, 1.0821305297617374), 128: (0.9037910569861352, 1.0654753476809822)}
#: Mean and unit of the voltage digitizer, by bits.
VOLTAGE = {1: (0.0, 1.0), 2: (-0.5, 1.03), 4: (-0.5, 3.14), 8: (-0.5, 10.1), 16: (-0.5, 1106.4)}
#: Centre frequencies (MHz) of the four channels of 100 MHz, 1000 samples a second.
CENTRES = (1250, 1350, 1450, 1550)


def lag(dm: float, mhz: float) -> float:
    """Samples behind infinite frequency, by the dispersion law with constant 2.41e-4."""
    return 1000 * dm / (2.41e-4 * mhz * mhz)



D = "d AS (SELECT event_id // 8 AS idat, CAST((event_id // 2) % 4 AS INTEGER) AS ichan, CAST(event_id % 2 AS INTEGER) AS ipol, CAST(round(value * 100) AS BIGINT) AS v FROM events), nd AS (SELECT count(*) // 8 AS ndat FROM events)"
Z = D + ", z AS (SELECT idat, ichan, ipol, v % 41 - 20 AS re, (v // 7) % 37 - 18 AS im FROM d)"
E = "e AS (SELECT event_id, epoch_us(ts) AS us, CAST(user_id % 4 AS INTEGER) AS ichan, CAST(0 AS INTEGER) AS ipol, CAST(round(value * 100) AS BIGINT) AS v FROM events)"
W = D + ", w AS (SELECT DISTINCT idat // 16 AS iw, ichan, ipol, CAST((idat // 16 * 7 + ichan * 3 + ipol) % 6 AS INTEGER) AS weight FROM d)"
WD = W + ", wd AS (SELECT idat, d.ichan, d.ipol, v, weight FROM d JOIN w ON idat // 16 = iw AND d.ichan = w.ichan AND d.ipol = w.ipol)"
MEAN = "CAST(CASE WHEN min(weight) = 0 THEN 0 ELSE sum(weight) // count(*) END AS BIGINT) AS weight"


def flagged(nfft: int, step: int) -> str:
    """fl: weights of blocks of 16, 0 where a block holds what is kept of a transform that reads a bad block."""
    return f"""tp AS (SELECT unnest(range((ndat - {nfft}) // {step} + 1)) AS part FROM nd), tb AS (SELECT DISTINCT part, ichan, ipol FROM tp JOIN w ON iw * 16 < part * {step} + {nfft} AND iw * 16 + 16 > part * {step} WHERE weight = 0),
    th AS (SELECT DISTINCT w.iw, w.ichan, w.ipol, TRUE AS hit FROM w JOIN tb ON w.ichan = tb.ichan AND w.ipol = tb.ipol AND iw * 16 < part * {step} + {step} AND iw * 16 + 16 > part * {step}),
    fl AS (SELECT w.iw, w.ichan, w.ipol, CAST(CASE WHEN hit THEN 0 ELSE weight END AS INTEGER) AS weight FROM w LEFT JOIN th ON w.iw = th.iw AND w.ichan = th.ichan AND w.ipol = th.ipol)"""


B = f"{D}, b AS (SELECT idat // {SK_M} AS iw, ichan, ipol, CAST(sum(v) AS BIGINT) AS s1, CAST(sum(v * v) AS BIGINT) AS s2, count(*) AS n FROM d, nd WHERE v <> 0 AND idat < ndat // {SK_M} * {SK_M} GROUP BY ALL)"
EST = "CASE WHEN n > 1 AND s1 <> 0 THEN (n + 1) / (n - 1) * (n * s2 / (CAST(s1 AS DOUBLE) * s1) - 1) END"


def pmod(a: str, b: int) -> str:
    return f"((({a}) % {b} + {b}) % {b})"


def six(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS {name}"


def ibin(us: str, period: int = PERIOD, nbin: int = NBIN) -> str:
    return f"CAST({pmod(us, period)} * {nbin} // {period} AS INTEGER)"


FOLD = "CAST(sum(v) AS BIGINT) AS total, count(*) AS hits"
DAY, START = 86_400_000_000, 1_704_067_200_000_000
SUBINT = f"SELECT (us - {START} - {pmod(f'us - {START}', DAY)}) // {DAY} AS division, ichan, ipol, {ibin('us')} AS ibin, {FOLD} FROM e GROUP BY ALL"
PAIR = Z + ", p AS (SELECT idat, ichan, max(CASE WHEN ipol = 0 THEN re END) AS a, max(CASE WHEN ipol = 0 THEN im END) AS b, max(CASE WHEN ipol = 1 THEN re END) AS c, max(CASE WHEN ipol = 1 THEN im END) AS d FROM z GROUP BY ALL)"
STOKES = PAIR + ", s AS (SELECT idat, ichan, a*a + b*b + c*c + d*d AS s0, a*a + b*b - c*c - d*d AS s1, 2 * (a*c + b*d) AS s2, 2 * (a*d - b*c) AS s3 FROM p)"


def four(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT idat, ichan, CAST({i} AS INTEGER) AS ipol, {c} AS v FROM {source}" for i, c in enumerate(columns))


def scrunch(time: int, freq: int) -> str:
    return f"WITH {D} SELECT idat // {time} AS idat, CAST(ichan // {freq} AS INTEGER) AS ichan, ipol, CAST(sum(v) AS BIGINT) AS v FROM d, nd WHERE idat < ndat // {time} * {time} GROUP BY ALL"


def rescaled(n: int | None) -> str:
    iv = f"idat // {n}" if n else "0"
    return f"WITH {D}, i AS (SELECT *, {iv} AS iv FROM d), m AS (SELECT iv, ichan, ipol, avg(v) AS m, var_pop(v) AS q FROM i GROUP BY ALL) SELECT idat, ichan, ipol, {six('(v - m) * CASE WHEN q > 0 THEN 1 / sqrt(q) ELSE 1.0 END', 'v')} FROM i JOIN m USING (iv, ichan, ipol)"


def code(nbit: int, value: str) -> str:
    mean, unit = VOLTAGE[nbit]
    if nbit == 1:
        return f"CAST({value} >= 0 AS INTEGER)"
    low, high = -(1 << nbit - 1), (1 << nbit - 1) - 1
    return f"CAST(greatest({low}, least({high}, round(({value}) * CAST({unit} AS DOUBLE) + CAST({mean} AS DOUBLE)))) AS INTEGER)"


def masked(test: str) -> str:
    return f"CASE WHEN {test} THEN 0 ELSE v END"


def dft(n: int, taper: str = "1.0") -> str:
    """Spectra of parts of n complex samples, in order of frequency."""
    k = f"(k - {n // 2})"
    angle = f"(-2 * pi() * {k} * (idat % {n}) / {n})"
    return f"""y AS (SELECT idat // {n} AS idat, CAST(ichan * {n} + k AS INTEGER) AS ichan, ipol,
        sum({taper} * (re * cos({angle}) - im * sin({angle}))) AS re, sum({taper} * (re * sin({angle}) + im * cos({angle}))) AS im
        FROM z, nd, (SELECT range AS k FROM range({n})) WHERE idat < ndat // {n} * {n} GROUP BY idat // {n}, ichan, k, ipol)"""


def times(cells: list[tuple[int, int]]) -> str:
    return " OR ".join(f"idat >= {a} AND idat < {b}" for a, b in cells)


def delayed(shift: dict[int, int]) -> str:
    least = min(shift.values())
    case = "CASE ichan " + " ".join(f"WHEN {i} THEN {x - least}" for i, x in shift.items()) + " END"
    return f"WITH {D}, s AS (SELECT idat - {case} AS idat, ichan, ipol, v FROM d) SELECT idat, ichan, ipol, v FROM s, nd WHERE idat >= 0 AND idat < ndat - {max(shift.values()) - least}"


BAD = f"SELECT iw, ichan, CAST(max(CASE WHEN coalesce(sk < {SK_LOWER!r} OR sk > {SK_UPPER!r}, TRUE) THEN 1 ELSE 0 END) AS INTEGER) AS bad FROM k GROUP BY ALL"
K = f"{B}, k AS (SELECT *, {EST} AS sk FROM b)"


def _adaptive() -> str:
    parts, found = [B], None
    for m in (32, 64, 128):
        f, (lower, upper) = m // 32, SK_NARROW[m]
        use = "b" if found is None else f"(SELECT * FROM b WHERE (iw, ichan) NOT IN (SELECT iw, ichan FROM {found}))"
        parts.append(f"c{m} AS (SELECT iw // {f} AS iw, ichan, ipol, CAST(sum(s1) AS BIGINT) AS s1, CAST(sum(s2) AS BIGINT) AS s2, CAST(sum(n) AS BIGINT) AS n FROM {use} GROUP BY ALL)")
        parts.append(f"g{m} AS (SELECT DISTINCT iw * {f} + o AS iw, ichan FROM (SELECT *, {EST} AS sk FROM c{m}), (SELECT range AS o FROM range({f})) WHERE coalesce(sk < {lower!r} OR sk > {upper!r}, TRUE))")
        parts.append(f"f{m} AS ({'' if found is None else f'SELECT * FROM {found} UNION '}SELECT iw, ichan FROM g{m})")
        found = f"f{m}"
    return f"WITH {', '.join(parts)} SELECT iw, ichan, CAST(1 AS INTEGER) AS bad FROM {found}"


DELAYS = {i: math.floor(lag(50, f) - lag(50, 1400) + 0.5) for i, f in enumerate(CENTRES)}
MOMENTS = "SELECT *, avg(m) OVER w AS mm, avg(q) OVER w AS qq FROM (SELECT idat // 64 AS ib, ichan, ipol, avg(v) AS m, avg(v * v) AS q FROM d GROUP BY ALL) WINDOW w AS (PARTITION BY ichan, ipol ORDER BY ib ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"

#: Seven turns a day with a drift and a curvature by the day's number: phase at dt minutes from noon.
PREDICTED = f"""sg AS (SELECT *, (us - {START} - {pmod(f'us - {START}', DAY)}) // {DAY} AS k FROM e), dt AS (SELECT *, (us - (k * {DAY} + {START + DAY // 2})) / 60e6::DOUBLE AS dt FROM sg WHERE k BETWEEN 0 AND 729),
    ph AS (SELECT us, ichan, ipol, v, k * 7 AS turns, (k * 37 % 100) / 128.0::DOUBLE + 60 * (7.0::DOUBLE / 86400) * dt + ((((k % 3) / 16777216.0::DOUBLE) * dt + (k % 5) / 65536.0::DOUBLE) * dt + 0.0625::DOUBLE) AS x FROM dt)"""

ORACLE = {
    "fold_predictor_frequency": f"""WITH {E}, sg AS (SELECT *, (us - {START} - {pmod(f'us - {START}', DAY)}) // {DAY} AS k FROM e),
        xy AS (SELECT *, 2 * (us - {START} - k * {DAY})::DOUBLE / {DAY} - 1 AS x, 2 * (ichan * 100 + 50.0::DOUBLE) / 400 - 1 AS y FROM sg WHERE k BETWEEN 0 AND 729),
        ph AS (SELECT ichan, ipol, v, 3.5::DOUBLE + (k % 7) / 64.0::DOUBLE * y + 0.03125::DOUBLE * (2 * y * y - 1) + (3.5::DOUBLE + (k % 5) / 128.0::DOUBLE * y) * x + ((k % 3) / 32.0::DOUBLE - 0.015625::DOUBLE * y) * (2 * x * x - 1) AS w FROM xy)
        SELECT ichan, ipol, CAST(least(floor((w - floor(w)) * {NBIN}), {NBIN - 1}) AS INTEGER) AS ibin, {FOLD} FROM ph GROUP BY ALL""",
    "dynamic_response": f"""WITH {Z}, r AS (SELECT idat AS epoch, ichan, v % 5 + 1 AS g, v % 3 AS m FROM d WHERE ipol = 0 AND (idat * 7 + ichan * 13) % 61 = 0),
        f AS (SELECT ichan, arg_min(g, epoch) AS g0, arg_min(m, epoch) AS m0 FROM r GROUP BY ichan), p AS (SELECT DISTINCT idat // 8 * 8 AS start, ichan FROM d, nd WHERE idat < ndat // 8 * 8),
        a AS (SELECT p.start, p.ichan, coalesce(r.g, g0) AS g, coalesce(r.m, m0) AS m FROM p ASOF LEFT JOIN r ON p.ichan = r.ichan AND p.start >= r.epoch JOIN f ON p.ichan = f.ichan)
        SELECT start + (idat + m) % 8 AS idat, z.ichan, z.ipol, CAST(g * re AS DOUBLE) AS re, CAST(g * im AS DOUBLE) AS im FROM z JOIN a ON idat // 8 * 8 = start AND z.ichan = a.ichan""",
    "fold_period": f"WITH {E} SELECT ichan, ipol, {ibin('us')} AS ibin, {FOLD}, {six('sum(v) / count(*)', 'mean')} FROM e GROUP BY ALL",
    "fold_lineitem": f"WITH e AS (SELECT epoch_us(l_shipdate) + l_orderkey * 1000003 AS us, CAST(l_linenumber AS INTEGER) AS ichan, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem) SELECT ichan, {ibin('us', PERIOD, 64)} AS ibin, {FOLD} FROM e GROUP BY ALL",
    "fold_weighted": f"WITH {E} SELECT ichan, ipol, {ibin('us')} AS ibin, {FOLD} FROM e WHERE (event_id // 16 * 7 + ichan) % 5 <> 0 GROUP BY ALL",
    "fold_zeroed": f"WITH {E}, x AS (SELECT us, ichan, ipol, CASE WHEN v % 10 = 0 THEN 0 ELSE v END AS v FROM e) SELECT ichan, ipol, {ibin('us')} AS ibin, CAST(sum(v) AS BIGINT) AS total, count(*) FILTER (WHERE v <> 0) AS hits FROM x GROUP BY ALL",
    "subint_fold_seconds": f"WITH {E} {SUBINT}",
    "subint_fold_turns": f"WITH {E} SELECT (us - {START} - {pmod(f'us - {START}', PERIOD * 10)}) // {PERIOD * 10} AS division, ichan, ipol, {ibin(f'us - {START}')} AS ibin, {FOLD} FROM e GROUP BY ALL",
    "fold_combine": f"WITH {E} SELECT ichan, ipol, {ibin('us')} AS ibin, {FOLD} FROM e GROUP BY ALL",
    "fold_predictor": f"WITH {E}, {PREDICTED} SELECT ichan, ipol, CAST(floor((x - floor(x)) * {NBIN}) AS INTEGER) AS ibin, {FOLD} FROM ph GROUP BY ALL",
    "subint_fold_predictor": f"WITH {E}, {PREDICTED}, sh AS (SELECT *, x - floor(x) - 0.25::DOUBLE AS y, turns + CAST(floor(x) AS BIGINT) AS tn FROM ph), tu AS (SELECT *, tn + CAST(floor(y) AS BIGINT) AS t2 FROM sh) SELECT (t2 - {pmod('t2', 10)}) // 10 AS division, ichan, ipol, CAST(least(floor((y - floor(y)) * {NBIN}), {NBIN - 1}) AS INTEGER) AS ibin, {FOLD} FROM tu GROUP BY ALL",
    "fold_bookkeeping": f"WITH {E} SELECT (us - {START} - {pmod(f'us - {START}', DAY)}) // {DAY} AS division, ichan, count(*) AS ndat_total, count(*) FILTER (WHERE v % 10 <> 0) AS ndat_folded, CAST(count(*) FILTER (WHERE v % 10 <> 0) * 1000 AS DOUBLE) AS integration_us FROM e GROUP BY ALL",
    "unpack_msb": f"WITH {D} SELECT idat * 4 + j AS idat, ichan, ipol, CAST((v % 256) // CAST(pow(4, 3 - j) AS BIGINT) % 4 AS INTEGER) AS v FROM d, (SELECT range AS j FROM range(4))",
    "fold_drop_short": f"WITH {E}, f AS ({SUBINT}) SELECT * FROM f WHERE division IN (SELECT division FROM f GROUP BY division HAVING sum(hits) >= 0.9 * 330)",
    "tscrunch": scrunch(6, 1),
    "fscrunch": scrunch(1, 2),
    "scrunch_fused": scrunch(6, 4),
    "pscrunch_intensity": f"WITH {D} SELECT idat, ichan, CAST(0 AS INTEGER) AS ipol, CAST(sum(v) AS BIGINT) AS v FROM d GROUP BY ALL",
    "pscrunch_pp": f"WITH {D} SELECT * FROM d WHERE ipol = 0",
    "detect_intensity": f"WITH {Z} SELECT idat, ichan, CAST(0 AS INTEGER) AS ipol, CAST(sum(re*re + im*im) AS BIGINT) AS v FROM z GROUP BY ALL",
    "detect_nyquist": f"WITH {D} SELECT idat, ichan, CAST(0 AS INTEGER) AS ipol, CAST(sum((v % 41 - 20) * (v % 41 - 20)) AS BIGINT) AS v FROM d GROUP BY ALL",
    "slice_path": f"WITH x AS ({delayed(DELAYS)}) SELECT idat - 50 AS idat, ichan, ipol, v FROM x WHERE idat >= 50 AND idat < 100",
    "detect_ppqq": f"WITH {Z} SELECT idat, ichan, ipol, re*re + im*im AS v FROM z",
    "detect_pp": f"WITH {Z} SELECT idat, ichan, ipol, re*re + im*im AS v FROM z WHERE ipol = 0",
    "detect_coherence": f"WITH {PAIR} " + four("p", ["a*a + b*b", "c*c + d*d", "a*c + b*d", "a*d - b*c"]),
    "detect_stokes": f"WITH {STOKES} " + four("s", ["s0", "s1", "s2", "s3"]),
    "fourth_moment": f"WITH {STOKES} SELECT idat, ichan, s0, s1, s2, s3, " + ", ".join(f"s{i} * s{j} AS s{i}{j}" for i in range(4) for j in range(i, 4)) + " FROM s",
    "poln_reshape4": f"WITH {Z} SELECT idat, ichan, CAST(ipol * 2 AS INTEGER) AS ipol, re AS v FROM z UNION ALL SELECT idat, ichan, CAST(ipol * 2 + 1 AS INTEGER), im FROM z",
    "poln_reshape2": f"WITH {Z} SELECT idat, ichan, CAST(0 AS INTEGER) AS ipol, re AS v FROM z WHERE ipol = 0 UNION ALL SELECT idat, ichan, CAST(1 AS INTEGER), im FROM z WHERE ipol = 0",
    "poln_reshape1": f"WITH {Z} SELECT idat, ichan, CAST(0 AS INTEGER) AS ipol, re + im AS v FROM z WHERE ipol = 0",
    "poln_select": f"WITH {D} SELECT idat, ichan, CAST(0 AS INTEGER) AS ipol, v FROM d WHERE ipol = 1",
    "chan_pol_select": f"WITH {D} SELECT idat, ichan - 1 AS ichan, ipol - 1 AS ipol, v FROM d WHERE ichan BETWEEN 1 AND 2 AND ipol = 1",
    "fzoom": f"WITH {D} SELECT idat, ichan - 1 AS ichan, ipol, v FROM d WHERE 1250 + 100 * ichan + 50 > 1360 AND 1250 + 100 * ichan - 50 < 1540",
    "truncate": f"WITH {D} SELECT * FROM d WHERE idat < 100",
    "chomp": f"WITH {D} SELECT d.* FROM d, nd WHERE idat < least(500, ndat) // 64 * 64",
    "resize": f"WITH {D} SELECT d.* FROM d, nd WHERE idat < ndat - 37",
    "delay_start": f"WITH {D} SELECT idat - 50 AS idat, ichan, ipol, v FROM d WHERE idat >= 50",
    "channel_order": f"WITH {D} SELECT idat, CAST((ichan + 2) % 4 AS INTEGER) AS ichan, ipol, v FROM d",
    "stats": f"WITH {D}, a AS (SELECT ichan, ipol, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * v) AS BIGINT) AS total_sq FROM d GROUP BY ALL) SELECT *, {six('total / n', 'mean')}, {six('sqrt(total_sq / n - (total / n) * (total / n))', 'sigma')} FROM a",
    "rescale_meanstd": rescaled(None),
    "rescale_interval": rescaled(100),
    "rescale_medianmad": f"WITH {D}, i AS (SELECT *, idat // 200 AS iv FROM d), m AS (SELECT iv, ichan, ipol, quantile_disc(v, 0.5) AS m FROM i GROUP BY ALL), a AS (SELECT iv, ichan, ipol, quantile_disc(abs(v - m), 0.5) AS q FROM i JOIN m USING (iv, ichan, ipol) GROUP BY ALL) SELECT idat, ichan, ipol, {six('(v - m) * CASE WHEN q > 0 THEN 1 / (q * CAST(1.4826 AS DOUBLE)) ELSE 1.0 END', 'v')} FROM i JOIN m USING (iv, ichan, ipol) JOIN a USING (iv, ichan, ipol)",
    "rescale_constant": f"WITH {D}, m AS (SELECT ichan, ipol, avg(v) AS m, var_pop(v) AS q FROM d WHERE idat < 100 GROUP BY ALL) SELECT idat, ichan, ipol, {six('(v - m) * CASE WHEN q > 0 THEN 1 / sqrt(q) ELSE 1.0 END', 'v')} FROM d JOIN m USING (ichan, ipol)",
    "running_mean": f"WITH {D} SELECT idat, ichan, ipol, {six('avg(v) OVER (PARTITION BY ichan, ipol ORDER BY idat ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)', 'v')} FROM d",
    "mask_times": f"WITH {D} SELECT idat, ichan, ipol, {masked(times(CELLS))} AS v FROM d",
    "weights_mask": f"WITH {W} SELECT iw, ichan, ipol, CASE WHEN min(weight) OVER (PARTITION BY iw) = 0 THEN 0 ELSE weight END AS weight FROM w",
    "weights_convolve": f"WITH {W}, {flagged(64, 48)} SELECT iw, ichan, ipol, weight FROM fl",
    "weights_scrunch": f"WITH {W} SELECT iw // 3 AS iw, ichan, ipol, CAST(CASE WHEN min(weight) = 0 THEN 0 ELSE sum(weight) // count(*) END AS BIGINT) AS weight FROM w GROUP BY iw // 3, ichan, ipol",
    "weighted_select": f"WITH {W} SELECT idat, CAST(d.ichan - 1 AS INTEGER) AS ichan, CAST(0 AS INTEGER) AS ipol, v, weight FROM d JOIN w ON idat // 16 = iw AND d.ichan = w.ichan AND d.ipol = w.ipol WHERE d.ipol = 1 AND d.ichan IN (1, 2)",
    "weighted_cut": f"WITH {W} SELECT idat - 37 AS idat, d.ichan, d.ipol, v, weight FROM d JOIN w ON idat // 16 = iw AND d.ichan = w.ichan AND d.ipol = w.ipol WHERE idat >= 37 AND idat < 190",
    "weighted_tscrunch": f"WITH {WD} SELECT idat // 6 AS idat, ichan, ipol, CAST(sum(v) AS BIGINT) AS v, {MEAN} FROM wd, nd WHERE idat < ndat // 6 * 6 GROUP BY ALL",
    "weighted_pscrunch": f"WITH {WD}, f AS (SELECT idat, ichan // 2 AS ichan, ipol, sum(v) AS v, {MEAN} FROM wd GROUP BY ALL) SELECT idat, CAST(ichan AS INTEGER) AS ichan, CAST(0 AS INTEGER) AS ipol, CAST(sum(v) AS BIGINT) AS v, {MEAN} FROM f GROUP BY ALL",
    "weighted_delay": f"WITH {WD}, s AS (SELECT idat - CASE ichan WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 11 ELSE 2 END AS idat, ichan, ipol, v, weight FROM wd), k AS (SELECT s.* FROM s, nd WHERE idat >= 0 AND idat < ndat - 11), b AS (SELECT idat // 16 AS iw, ichan, ipol, {MEAN} FROM k GROUP BY ALL) SELECT idat, k.ichan, k.ipol, v, b.weight FROM k JOIN b ON idat // 16 = iw AND k.ichan = b.ichan AND k.ipol = b.ipol",
    "weighted_channelize": f"WITH {W}, {flagged(64, 40)}, o AS (SELECT unnest(range((SELECT (ndat - 64) // 40 + 1 FROM nd) * 5)) AS idat) SELECT idat, CAST(ichan * 8 + k AS INTEGER) AS ichan, ipol, weight FROM o JOIN fl ON idat * 8 // 16 = iw, (SELECT range AS k FROM range(8))",
    "weighted_fold": f"WITH {WD}, t AS (SELECT idat // 2 AS idat, ichan - 1 AS ichan, ipol, CAST(sum(v) AS BIGINT) AS v, {MEAN} FROM wd, nd WHERE ichan >= 1 AND idat < ndat // 2 * 2 GROUP BY ALL), s AS (SELECT idat - CASE ichan WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 3 END AS idat, ichan, ipol, v, weight FROM t), k AS (SELECT s.* FROM s, nd WHERE idat >= 0 AND idat < ndat // 2 - 5), b AS (SELECT idat // 8 AS iw, ichan, ipol, {MEAN} FROM k GROUP BY ALL) SELECT CAST(k.ichan AS INTEGER) AS ichan, k.ipol, CAST((idat * 2000 + 1000) % 64000 * 16 // 64000 AS INTEGER) AS ibin, {FOLD} FROM k JOIN b ON idat // 8 = iw AND k.ichan = b.ichan AND k.ipol = b.ipol WHERE b.weight <> 0 GROUP BY ALL",
    "apply_weights": f"WITH {W} SELECT idat, d.ichan, d.ipol, {masked('weight = 0')} AS v FROM d JOIN w ON idat // 16 = iw AND d.ichan = w.ichan AND d.ipol = w.ipol",
    "sample_delay": delayed({0: 0, 1: 5, 2: 11, 3: 2}),
    "dispersion_delay": delayed(DELAYS),
    "sk_sums": f"WITH {B} SELECT * FROM b",
    "sk_coarser": f"WITH {B} SELECT iw // 4 AS iw, ichan, ipol, CAST(sum(s1) AS BIGINT) AS s1, CAST(sum(s2) AS BIGINT) AS s2, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY iw // 4, ichan, ipol",
    "sk_overlap": f"WITH {B}, o AS (SELECT range AS o FROM range(2)) SELECT b.iw // 2 - o AS iw, ichan, ipol, CAST(sum(s1) AS BIGINT) AS s1, CAST(sum(s2) AS BIGINT) AS s2, CAST(sum(n) AS BIGINT) AS n FROM b, o WHERE b.iw // 2 - o >= 0 GROUP BY b.iw // 2 - o, ichan, ipol",
    "sk_estimate": f"WITH {K} SELECT iw, ichan, ipol, {six('sk', 'sk')} FROM k",
    "sk_time_freq": f"WITH {K} {BAD}",
    "sk_time": f"WITH {K}, m AS (SELECT iw, ipol, sum(sk * n) / sum(n) AS mean, CAST(sum(n) AS DOUBLE) * sum(n) / sum(n * n) AS e FROM k WHERE sk IS NOT NULL GROUP BY ALL) SELECT iw, CAST(max(CASE WHEN abs(mean - 1) > {SK_SYMMETRIC!r} / sqrt(e) THEN 1 ELSE 0 END) AS INTEGER) AS bad FROM m GROUP BY ALL",
    "sk_time_within": f"WITH {K}, m AS (SELECT iw, ipol, sum(sk * n) / sum(n) AS mean, CAST(sum(n) AS DOUBLE) * sum(n) / sum(n * n) AS e FROM k WHERE sk IS NOT NULL AND ichan IN (1, 3) GROUP BY ALL) SELECT iw, CAST(max(CASE WHEN abs(mean - 1) > {SK_SYMMETRIC!r} / sqrt(e) THEN 1 ELSE 0 END) AS INTEGER) AS bad FROM m GROUP BY ALL",
    "sample_delay_pol": f"WITH {D}, s AS (SELECT idat - 3 * ichan - 7 * ipol AS idat, ichan, ipol, v FROM d) SELECT idat, ichan, ipol, v FROM s, nd WHERE idat >= 0 AND idat < ndat - 16",
    "fscrunch_floor": f"WITH {D} SELECT idat, CAST(0 AS INTEGER) AS ichan, ipol, CAST(sum(v) AS BIGINT) AS v FROM d WHERE ichan < 3 GROUP BY idat, ipol",
    "fold_many": f"WITH {E} " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS ifold, ichan, ipol, {ibin('us', p, n)} AS ibin, {FOLD} FROM e GROUP BY ALL" for i, (p, n) in enumerate(((PERIOD, 16), (PERIOD * 2, 8), (DAY, 24)))),
    "sk_excise": f"WITH {K}, x AS ({BAD}) SELECT idat, d.ichan, d.ipol, {masked('bad = 1')} AS v FROM d LEFT JOIN x ON idat // {SK_M} = x.iw AND d.ichan = x.ichan",
    "sk_adaptive": _adaptive(),
    "zap_weight": f"WITH {K}, c AS (SELECT iw, ichan, max(CASE WHEN sk BETWEEN {SK_LOWER!r} AND {SK_UPPER!r} THEN 0 ELSE 1 END) AS o, max(CASE WHEN sk BETWEEN 0.2 AND 2.4 THEN 0 ELSE 1 END) AS g FROM k GROUP BY ALL) SELECT iw, ichan, CAST(CASE WHEN sum(g) OVER (PARTITION BY iw) > 1 THEN 1 ELSE o END AS INTEGER) AS bad FROM c",
    "excision_nlow": f"WITH {D} SELECT idat // 32 AS iw, ichan, ipol, count(*) FILTER (WHERE abs(v) < 3000) AS nlow, CAST(CASE WHEN count(*) FILTER (WHERE abs(v) < 3000) BETWEEN 10 AND 20 THEN 1 ELSE 0 END AS INTEGER) AS weight FROM d GROUP BY idat // 32, ichan, ipol",
    "state_histogram": f"WITH {D} SELECT ichan, ipol, {code(4, '(v - 5000) / 4000.0::DOUBLE')} AS code, count(*) AS n FROM d GROUP BY ALL",
    "digitize1": f"WITH {D} SELECT idat, ichan, ipol, {code(1, '(v - 5000) / 4096.0::DOUBLE')} AS v FROM d",
    "digitize2": f"WITH {D} SELECT idat, ichan, ipol, {code(2, '(v - 5000) / 4096.0::DOUBLE')} AS v FROM d",
    "digitize4": f"WITH {D} SELECT idat, ichan, ipol, {code(4, '(v - 5000) / 4096.0::DOUBLE')} AS v FROM d",
    "digitize8": f"WITH {D} SELECT idat, ichan, ipol, {code(8, '(v - 5000) / 4096.0::DOUBLE')} AS v FROM d",
    "digitize16": f"WITH {D} SELECT idat, ichan, ipol, {code(16, '(v - 5000) / 4096.0::DOUBLE')} AS v FROM d",
    "table_digitize": f"WITH {D}, m AS (SELECT idat // 64 AS ib, ichan, ipol, avg(v) AS m, avg(v * v) AS q FROM d GROUP BY ALL), s AS (SELECT *, CASE WHEN q - m * m > 0 THEN sqrt(q - m * m) * 12 / 256 ELSE 1.0 END AS sc FROM m) SELECT idat, d.ichan, d.ipol, CAST(greatest(0, least(255, floor((v - (m - sc * 256 / 2)) / sc + 0.5::DOUBLE))) AS INTEGER) AS v FROM d JOIN s ON idat // 64 = ib AND d.ichan = s.ichan AND d.ipol = s.ipol",
    "filterbank_digitize": f"WITH {D} SELECT idat, CAST(3 - ichan AS INTEGER) AS ichan, ipol, CAST(greatest(0, least(255, trunc((v - 5000) / 4096.0::DOUBLE * 21.25::DOUBLE + 127.5::DOUBLE + 0.5::DOUBLE))) AS INTEGER) AS v FROM d",
    "table_scale_offset": f"WITH {D}, m AS ({MOMENTS}), s AS (SELECT *, CASE WHEN qq - mm * mm > 0 THEN sqrt(qq - mm * mm) * 12 / 256 ELSE 1.0 END AS sc FROM m) SELECT ib, ichan, ipol, {six('sc', 'scale')}, {six('mm - sc * 256 / 2', '\"offset\"')} FROM s",
    "level_lookup": f"WITH {D} SELECT idat, ichan, ipol, CAST((v % 4 - 1.5) * 2 / 4 AS DOUBLE) AS v FROM d",
    "two_bit_correct": f"WITH {D}, x AS (SELECT idat, ichan, ipol, v % 4 AS c, sum(CASE WHEN v % 4 IN (1, 2) THEN 1 ELSE 0 END) OVER (PARTITION BY idat // 64, ichan, ipol) AS n FROM d) SELECT idat, ichan, ipol, CAST((CASE WHEN c IN (1, 2) THEN n * 2 ELSE n * 5 + 1 END) * (CASE WHEN c >= 2 THEN 1 ELSE -1 END) AS BIGINT) AS v FROM x",
    **{f"pack_unpack{n}": f"WITH {D} SELECT idat, ichan, ipol, CAST(v % {1 << n} - {1 << n - 1} AS INTEGER) AS v FROM d, nd WHERE idat < ndat // 64 * 64" for n in (2, 4, 8, 16)},
    "impulse_train": f"WITH {D} SELECT idat, CAST(0 AS INTEGER) AS ichan, CAST(0 AS INTEGER) AS ipol, CAST(v + CASE WHEN idat % 37 = 3 THEN 5000 ELSE 0 END AS BIGINT) AS v FROM d, nd WHERE ichan = 0 AND ipol = 0 AND idat < ndat",
    "superposition": f"WITH {D} SELECT idat, CAST(0 AS INTEGER) AS ichan, CAST(0 AS INTEGER) AS ipol, CAST(sum(v) + CASE WHEN idat % 41 = 0 THEN 700 ELSE 0 END + CASE WHEN idat % 64 = 0 THEN 1 ELSE 0 END AS BIGINT) AS v FROM d, nd WHERE ipol = 0 AND idat < ndat GROUP BY idat",
    "multiplex": f"WITH {D} SELECT (idat // 16 * 8 + ichan * 2 + ipol) * 16 + idat % 16 AS idat, v FROM d",
    "dual": f"WITH {D} SELECT idat, ichan, ipol, v FROM d",
    "parallel_input": f"WITH {D} SELECT idat, ichan, ipol, v * 2 AS v FROM d",
    "serial_concat": f"WITH {D} SELECT idat, ichan, ipol, v FROM d UNION ALL SELECT idat + ndat, ichan, ipol, v + 1 FROM d, nd",
    "difference_rms": f"WITH {D} SELECT ichan, ipol, {six('sqrt(avg((idat % 3) * (idat % 3)))', 'rms')}, count(*) FILTER (WHERE idat % 3 <> 0) AS differ FROM d GROUP BY ALL",
    "autocorrelation": f"WITH {D} SELECT a.ichan, a.ipol, b.idat - a.idat AS lag, CAST(sum(a.v * b.v) AS BIGINT) AS acf FROM d a JOIN d b ON a.ichan = b.ichan AND a.ipol = b.ipol AND b.idat BETWEEN a.idat AND a.idat + 3 GROUP BY ALL",
    "cyclic_fold": f"WITH {Z} SELECT a.ichan, a.ipol, {ibin('(a.idat + b.idat + 1) * 500', 32_000, 8)} AS ibin, CAST(b.idat - a.idat AS INTEGER) AS lag, CAST(sum(a.re * b.re + a.im * b.im) AS BIGINT) AS re, CAST(sum(a.im * b.re - a.re * b.im) AS BIGINT) AS im, count(*) AS hits FROM z a JOIN z b ON a.ichan = b.ichan AND a.ipol = b.ipol AND b.idat BETWEEN a.idat AND a.idat + 3 GROUP BY ALL",
    "channelize_dft": f"WITH {Z}, {dft(8)} SELECT idat, ichan, ipol, {six('re', 're')}, {six('im', 'im')} FROM y",
    "taper_channelize": f"WITH {Z}, {dft(8, '(0.5 - 0.5 * cos(2 * pi() * (idat % 8) / 7))')} SELECT idat, ichan, ipol, {six('re', 're')}, {six('im', 'im')} FROM y",
    "power_filterbank": f"WITH {Z}, {dft(8)} SELECT idat, ichan, CAST(0 AS INTEGER) AS ipol, {six('sum(re * re + im * im)', 'v')} FROM y GROUP BY idat, ichan",
    "bandpass": f"WITH {Z}, {dft(8)} SELECT CAST(ichan // 8 AS INTEGER) AS ichan, ipol, CAST(y.ichan % 8 AS INTEGER) AS ifreq, {six('sum(re * re + im * im)', 'power')} FROM y GROUP BY ichan // 8, ipol, y.ichan % 8",
    "lag_filterbank": f"WITH {D}, x AS (SELECT * FROM d, nd WHERE idat < ndat // 8 * 8) SELECT a.idat // 8 AS ipart, a.ichan, a.ipol, CAST(b.idat - a.idat AS INTEGER) AS k, CAST(sum(a.v * b.v) AS DOUBLE) AS v FROM x a JOIN x b ON a.ichan = b.ichan AND a.ipol = b.ipol AND a.idat // 8 = b.idat // 8 AND b.idat >= a.idat GROUP BY ALL",
    "convolve_shift": f"WITH {Z}, nk AS (SELECT (ndat - 64) // 61 + 1 AS parts FROM nd) SELECT idat, ichan, ipol, CAST(re AS DOUBLE) AS re, CAST(im AS DOUBLE) AS im FROM z, nk WHERE idat < parts * 61",
    "quantize_path": f"WITH {D}, x AS (SELECT idat, ichan - 1 AS ichan, ipol, v FROM d WHERE ichan BETWEEN 1 AND 2 AND ipol = 0), m AS (SELECT ichan, ipol, avg(v) AS m, var_pop(v) AS q FROM x GROUP BY ALL) SELECT idat, x.ichan, x.ipol, {code(8, '(v - m) * (1 / sqrt(q))')} AS v FROM x JOIN m USING (ichan, ipol)",
}
_PAIRS = "z a JOIN z b ON a.ichan = b.ichan AND b.idat BETWEEN a.idat AND a.idat + 3"
_PRODUCT = "CAST(b.idat - a.idat AS INTEGER) AS lag, CAST(sum(a.re * b.re + a.im * b.im) AS BIGINT) AS re, CAST(sum(a.im * b.re - a.re * b.im) AS BIGINT) AS im, count(*) AS hits"
_MIDDLE = ibin("(a.idat + b.idat + 1) * 500", 32_000, 8)
ORACLE["cyclic_fold_cross"] = f"WITH {Z} SELECT a.ichan, CAST(CASE WHEN a.ipol = b.ipol THEN a.ipol ELSE 2 + a.ipol END AS INTEGER) AS ipol, {_MIDDLE} AS ibin, {_PRODUCT} FROM {_PAIRS} GROUP BY a.ichan, a.ipol, b.ipol, {_MIDDLE}, b.idat - a.idat"
ORACLE["cyclic_fold_sum"] = f"WITH {Z} SELECT a.ichan, CAST(0 AS INTEGER) AS ipol, {_MIDDLE} AS ibin, {_PRODUCT} FROM {_PAIRS} AND a.ipol = b.ipol GROUP BY a.ichan, {_MIDDLE}, b.idat - a.idat"
_L64, _L128 = SK_NARROW[64], SK_NARROW[128]
ORACLE["sk_configured"] = f"""WITH {D}, f AS (SELECT idat // 64 AS iw, ichan, ipol, CAST(sum(v) AS BIGINT) AS s1, CAST(sum(v * v) AS BIGINT) AS s2, count(*) AS n FROM d, nd WHERE v <> 0 AND idat < ndat // 64 * 64 GROUP BY ALL),
    g1 AS (SELECT DISTINCT iw, ichan FROM (SELECT *, {EST} AS sk FROM f WHERE ichan < 2) WHERE coalesce(sk < {_L64[0]!r} OR sk > {_L64[1]!r}, TRUE)),
    r AS (SELECT * FROM f WHERE ichan <> 2 AND (iw, ichan) NOT IN (SELECT iw, ichan FROM g1)),
    c AS (SELECT iw - o AS iw, ichan, ipol, CAST(sum(s1) AS BIGINT) AS s1, CAST(sum(s2) AS BIGINT) AS s2, CAST(sum(n) AS BIGINT) AS n FROM r, (SELECT range AS o FROM range(2)) WHERE iw - o >= 0 GROUP BY iw - o, ichan, ipol),
    g2 AS (SELECT DISTINCT iw + o AS iw, ichan FROM (SELECT *, {EST} AS sk FROM c), (SELECT range AS o FROM range(2)) WHERE coalesce(sk < {_L128[0]!r} OR sk > {_L128[1]!r}, TRUE))
    SELECT iw, ichan, CAST(1 AS INTEGER) AS bad FROM (SELECT * FROM g1 UNION SELECT * FROM g2)"""
ORACLE["cyclic_spectrum"] = f"WITH c AS ({ORACLE['cyclic_fold']}) SELECT ichan, ipol, ibin, CAST(f AS INTEGER) AS ifreq, {six('sum(CASE WHEN lag IN (0, 3) THEN 1 ELSE 2 END * (re * cos(f * lag * 2 * pi() / 6) - im * sin(f * lag * 2 * pi() / 6)) / hits)', 'power')} FROM c, (SELECT range AS f FROM range(6)) GROUP BY ichan, ipol, ibin, f"
ORACLE["fold_path"] = f"WITH {K}, x AS ({BAD}), y AS (SELECT idat * 1000 + 500 AS us, d.ichan, d.ipol, {masked('bad = 1')} AS v FROM d LEFT JOIN x ON idat // {SK_M} = x.iw AND d.ichan = x.ichan) SELECT us // 200000 AS division, ichan, ipol, {ibin('us', 64_000, 16)} AS ibin, CAST(sum(v) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE v <> 0) AS BIGINT) AS hits FROM y GROUP BY ALL"

#: Rounds of the interference filter, written out: a round takes out what exceeds 16 times the mean of what is left.
_ROUNDS = ", ".join(f"r{i} AS (SELECT ichan, CASE WHEN r > 16 * avg(r) OVER () THEN 0 ELSE r END AS r, gone OR r > 16 * avg(r) OVER () AS gone FROM r{i - 1})" for i in range(1, 9))
ORACLE["rfi_filter"] = f"""WITH {D}, x AS (SELECT idat, CAST((idat * 8 + ichan * 2 + ipol) % 128 AS INTEGER) AS ichan, v FROM d),
    y AS (SELECT idat, ichan, CAST(v * CASE ichan WHEN 77 THEN 100 WHEN 30 THEN 2 ELSE 1 END AS BIGINT) AS v FROM x),
    b AS (SELECT ichan, CAST(sum(v) AS DOUBLE) AS p FROM y GROUP BY ichan),
    r0 AS (SELECT ichan, pow(p - median(p) OVER (ORDER BY ichan ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING), 2) AS r, FALSE AS gone FROM b), {_ROUNDS}
    SELECT idat, ichan, CAST(0 AS INTEGER) AS ipol, CASE WHEN gone THEN 0 ELSE v END AS v FROM y JOIN r8 USING (ichan)"""

_A = "(-2 * pi() * (k - 2) * j / 4)"
ORACLE["polyphase"] = f"""WITH {Z}, x AS (SELECT idat // 4 - o AS p, o * 4 + idat % 4 AS j, ichan, ipol, re, im FROM z, (SELECT range AS o FROM range(4))),
    y AS (SELECT p AS idat, CAST(ichan * 4 + k AS INTEGER) AS ichan, ipol, sum((j + 1) / 16 * (re * cos({_A}) - im * sin({_A}))) AS re, sum((j + 1) / 16 * (re * sin({_A}) + im * cos({_A}))) AS im
        FROM x, nd, (SELECT range AS k FROM range(4)) WHERE p >= 0 AND p < (ndat - 16) // 4 + 1 GROUP BY p, ichan, k, ipol)
    SELECT idat, ichan, ipol, {six('re', 're')}, {six('im', 'im')} FROM y"""
_B = "(2 * pi() * (ichan - 8) * n / 16)"
ORACLE["inverse_filterbank"] = f"""WITH {Z}, {dft(4)}, s AS (SELECT idat * 16 + n AS idat, ipol, sum(re * cos({_B}) - im * sin({_B})) AS re, sum(re * sin({_B}) + im * cos({_B})) AS im
    FROM y, (SELECT range AS n FROM range(16)) GROUP BY idat, n, ipol) SELECT idat, CAST(0 AS INTEGER) AS ichan, ipol, {six('re', 're')}, {six('im', 'im')} FROM s"""
ORACLE["filterbank_path"] = f"""WITH {Z}, {dft(8)}, g AS (SELECT idat // 2 AS idat, ichan // 4 AS ichan, sum(re * re + im * im) AS v FROM y, nd WHERE idat < ndat // 8 // 2 * 2 GROUP BY y.idat // 2, y.ichan // 4),
    m AS (SELECT ichan, avg(v) AS m, var_pop(v) AS q FROM g GROUP BY ichan)
    SELECT idat, CAST(7 - ichan AS INTEGER) AS ichan, CAST(0 AS INTEGER) AS ipol, CAST(greatest(0, least(255, trunc((v - m) / sqrt(q) * 21.25::DOUBLE + 128.0::DOUBLE))) AS INTEGER) AS v FROM g JOIN m USING (ichan)"""
_C = "(-2 * pi() * (f - 4) * (idat - first) / 8)"
ORACLE["phase_locked_filterbank"] = f"""WITH {Z}, st AS (SELECT (idat * 1000 + 500) // 32000 AS turn, {ibin('idat * 1000 + 500', 32_000, 4)} AS ibin, min(idat) AS first FROM z GROUP BY ALL),
    x AS (SELECT turn, ibin, ichan, ipol, f, sum(re * cos({_C}) - im * sin({_C})) AS r, sum(re * sin({_C}) + im * cos({_C})) AS i, count(*) AS c
        FROM z JOIN st ON idat BETWEEN first AND first + 7, (SELECT range AS f FROM range(8)) GROUP BY turn, ibin, ichan, ipol, f)
    SELECT ibin, ichan, ipol, CAST(f AS INTEGER) AS ifreq, {six('sum(r * r + i * i)', 'power')}, count(*) AS hits FROM x WHERE c = 8 GROUP BY ibin, ichan, ipol, f"""
_R = "(-2 * pi() * f * (idat - first) / 16)"
ORACLE["phase_locked_real"] = f"""WITH {D}, z AS (SELECT idat, ichan, ipol, v % 41 - 20 AS v FROM d), st AS (SELECT (idat * 1000 + 500) // 32000 AS turn, {ibin('idat * 1000 + 500', 32_000, 4)} AS ibin, min(idat) AS first FROM z GROUP BY ALL),
    x AS (SELECT turn, ibin, ichan, ipol, f, sum(v * cos({_R})) AS r, sum(v * sin({_R})) AS i, count(*) AS c
        FROM z JOIN st ON idat BETWEEN first AND first + 15, (SELECT range AS f FROM range(8)) GROUP BY turn, ibin, ichan, ipol, f)
    SELECT ibin, ichan, ipol, CAST(f AS INTEGER) AS ifreq, {six('sum(r * r + i * i)', 'power')}, count(*) AS hits FROM x WHERE c = 16 GROUP BY ibin, ichan, ipol, f"""
ORACLE["baseline_decay"] = f"""WITH {D}, b AS (SELECT a.idat, a.ichan, a.ipol, a.v, sum(o.v * pow(0.9375::DOUBLE, a.idat - o.idat) * CASE WHEN o.idat = 0 THEN 1 ELSE 0.0625::DOUBLE END) AS base
    FROM d a JOIN d o ON a.ichan = o.ichan AND a.ipol = o.ipol AND o.idat <= a.idat GROUP BY ALL) SELECT idat, ichan, ipol, round(v - base, 3) + 0.0 AS v FROM b"""


def _two_bit_levels(n: int) -> str:
    """Rows (n_low, low, high): root mean squares of normal noise below and above the threshold that a share n_low / n is within, in units of it."""
    from statistics import NormalDist

    normal, rows = NormalDist(), []
    for k in range(n + 1):
        p = min(max(k, 0.5), n - 0.5) / n
        t = normal.inv_cdf((1 + p) / 2)
        edge = 2 * t * normal.pdf(t)
        rows.append(f"({k}, {math.sqrt(1 - edge / p) / t!r}::DOUBLE, {math.sqrt(1 + edge / (1 - p)) / t!r}::DOUBLE)")
    return ", ".join(rows)


ORACLE["two_bit_optimal"] = f"""WITH {D}, x AS (SELECT idat, ichan, ipol, v % 4 AS c, sum(CASE WHEN v % 4 IN (1, 2) THEN 1 ELSE 0 END) OVER (PARTITION BY idat // 64, ichan, ipol) AS n FROM d),
    l(k, low, high) AS (VALUES {_two_bit_levels(64)}) SELECT idat, ichan, ipol, {six('(CASE WHEN c IN (1, 2) THEN low ELSE high END) * (CASE WHEN c >= 2 THEN 1 ELSE -1 END)', 'v')} FROM x JOIN l ON n = k"""


def _chirp(dm: float, n: int, k: str) -> str:
    """Phase of the response that removes dispersion from a channel of 100 MHz, at point k of n in order of frequency."""
    f, c = f"(({k} - {n // 2}) * 100.0::DOUBLE / {n})", "(1250 + 100.0::DOUBLE * ichan)"
    return f"(-2 * pi() * 1e6::DOUBLE * {dm!r}::DOUBLE / 2.41e-4::DOUBLE / ({c} * {c}) * {f} * {f} / ({c} + {f}))"


def filterbank(nchan: int, res: int, pos: int, neg: int, phase: str | None = None, middle: bool = False, scale: str = "1") -> str:
    """y: overlapping parts of nchan x res samples to the frequency domain, times a phase, and sub-bands of res points back to time, from their lowest
    frequency up or, with middle, around their middle."""
    n, keep = nchan * res, res - pos - neg
    step = keep * nchan
    a, b = f"(-2 * pi() * (k - {n // 2}) * j / {n})", f"(2 * pi() * (k % {res} - {res // 2 if middle else 0}) * t / {res})"
    turned = f"SELECT p, ichan, ipol, k, re * cos(q) - im * sin(q) AS re, re * sin(q) + im * cos(q) AS im FROM (SELECT *, {phase or '0.0'} AS q FROM f)"
    return f"""p AS (SELECT unnest(range(0, CASE WHEN ndat < {n} THEN 0 ELSE (ndat - {n}) // {step} + 1 END)) AS p FROM nd),
    x AS (SELECT p, idat - p * {step} AS j, ichan, ipol, re, im FROM z JOIN p ON idat >= p * {step} AND idat < p * {step} + {n}),
    f AS (SELECT p, ichan, ipol, k, sum(re * cos({a}) - im * sin({a})) AS re, sum(re * sin({a}) + im * cos({a})) AS im FROM x, (SELECT range AS k FROM range({n})) GROUP BY ALL),
    g AS ({turned}),
    y AS (SELECT p * {keep} + t - {pos} AS idat, CAST(ichan * {nchan} + k // {res} AS INTEGER) AS ichan, ipol, sum(re * cos({b}) - im * sin({b})) * {scale} AS re, sum(re * sin({b}) + im * cos({b})) * {scale} AS im
        FROM g, (SELECT range AS t FROM range({pos}, {res - neg})) GROUP BY p, t, ichan, k // {res}, ipol)"""


def rounded(x: str, name: str, digits: int = 4) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0 AS {name}"


BOTH = f"{rounded('re', 're')}, {rounded('im', 'im')}"
#: Wrap-around of DM 0.001 over 100 MHz around the lowest channel, which is the most smeared.
_POS, _NEG = math.ceil(lag(0.001, 1200) - lag(0.001, 1250)), math.ceil(lag(0.001, 1250) - lag(0.001, 1300))
_DEDISPERSED = filterbank(1, 64, _POS, _NEG, _chirp(0.001, 64, "k"), middle=True, scale="1 / 64.0::DOUBLE")
ORACLE["dedisperse"] = f"WITH {Z}, {_DEDISPERSED} SELECT idat, ichan, ipol, {six('re', 're')}, {six('im', 'im')} FROM y"
ORACLE["filterbank_freq_res"] = f"WITH {Z}, {filterbank(4, 8, 1, 2)} SELECT idat, ichan, ipol, {BOTH} FROM y"
ORACLE["filterbank_dedisperse"] = f"WITH {Z}, {filterbank(4, 8, 1, 1, _chirp(0.01, 32, 'k'))} SELECT idat, ichan, ipol, {rounded('re', 're', 3)}, {rounded('im', 'im', 3)} FROM y"
ORACLE["filterbank_power_dedisperse"] = f"WITH {Z}, {filterbank(4, 8, 1, 1, _chirp(0.01, 32, 'k'))} SELECT idat, ichan, CAST(0 AS INTEGER) AS ipol, {rounded('sum(re * re + im * im)', 'v', 2)} FROM y GROUP BY idat, ichan"
#: Delays between the sixteen channels are under a sample; the first one starts after the sample of wrap-around, 4000 microseconds late.
ORACLE["fold_path_voltages"] = f"WITH {Z}, {filterbank(4, 4, 1, 1, _chirp(0.01, 16, 'k'))}, pw AS (SELECT idat, ichan, sum(re * re + im * im) AS v FROM y GROUP BY idat, ichan) SELECT ichan, CAST(0 AS INTEGER) AS ipol, CAST((4000 + idat * 4000 + 2000) % 64000 * 16 // 64000 AS INTEGER) AS ibin, {rounded('sum(v)', 'total', 2)}, count(*) AS hits FROM pw GROUP BY ALL"
_D = "(-2 * pi() * (k - 4) * (idat % 8) / 8)"
ORACLE["cross_bandpass"] = f"""WITH {Z}, f AS (SELECT idat // 8 AS p, ichan, ipol, k, sum(re * cos({_D}) - im * sin({_D})) AS re, sum(re * sin({_D}) + im * cos({_D})) AS im FROM z, nd, (SELECT range AS k FROM range(8)) WHERE idat < ndat // 8 * 8 GROUP BY ALL),
    g AS (SELECT p, ichan, k, max(re) FILTER (WHERE ipol = 0) AS a, max(im) FILTER (WHERE ipol = 0) AS b, max(re) FILTER (WHERE ipol = 1) AS c, max(im) FILTER (WHERE ipol = 1) AS d FROM f GROUP BY ALL)
    SELECT ichan, CAST(q AS INTEGER) AS ipol, CAST(k AS INTEGER) AS ifreq, {rounded('sum(CASE q WHEN 0 THEN a * a + b * b WHEN 1 THEN c * c + d * d WHEN 2 THEN a * c + b * d ELSE a * d - b * c END)', 'power', 3)} FROM g, (SELECT range AS q FROM range(4)) GROUP BY ichan, q, k"""
#: The whole table as one channel a polarization, 64 channels made of it, and one of these again: 8 points a channel, 2 discarded at either end.
_E, _F, _G = "(-2 * pi() * (k - 32) * (idat % 64) / 64)", "(-2 * pi() * (m - 4) * j / 8)", "(2 * pi() * (k * 8 + m - 256) * t / 512)"
ORACLE["inverse_filterbank_overlap"] = f"""WITH {D}, nn AS (SELECT count(*) // 128 AS n FROM d), z AS (SELECT event_id // 2 AS idat, CAST(event_id % 2 AS INTEGER) AS ipol, c % 41 - 20 AS re, (c // 7) % 37 - 18 AS im FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS c FROM events)),
    c AS (SELECT idat // 64 AS i, k, ipol, sum(re * cos({_E}) - im * sin({_E})) AS re, sum(re * sin({_E}) + im * cos({_E})) AS im FROM z, nn, (SELECT range AS k FROM range(64)) WHERE idat < n * 64 GROUP BY ALL),
    p AS (SELECT unnest(range(0, CASE WHEN n < 8 THEN 0 ELSE (n - 8) // 4 + 1 END)) AS p FROM nn),
    w AS (SELECT p, i - p * 4 AS j, k, ipol, re, im FROM c JOIN p ON i >= p * 4 AND i < p * 4 + 8),
    f AS (SELECT p, k, m, ipol, sum(re * cos({_F}) - im * sin({_F})) AS re, sum(re * sin({_F}) + im * cos({_F})) AS im FROM w, (SELECT range AS m FROM range(8)) GROUP BY ALL)
    SELECT p * 256 + t - 128 AS idat, CAST(0 AS INTEGER) AS ichan, ipol, {rounded(f'sum(re * cos({_G}) - im * sin({_G})) / 8', 're', 3)}, {rounded(f'sum(re * sin({_G}) + im * cos({_G})) / 8', 'im', 3)} FROM f, (SELECT range AS t FROM range(128, 384)) GROUP BY p, t, ipol"""


def _levels(together: bool) -> str:
    """r: settings by integration of 64 samples, from -1 (gain 1, level 0) on; wanted are variance 1 and mean 0 within 0.05. Digitizers in order know
    whether one up to them is far off, or whether they are."""
    return f"""{D}, st AS (SELECT idat // 64 AS k, ichan * 2 + ipol AS dg, count(*) AS n, avg(CAST(v AS DOUBLE)) AS m, var_pop(CAST(v AS DOUBLE)) AS q FROM d GROUP BY ALL),
    r AS (SELECT CAST(-1 AS BIGINT) AS k, dg, CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS variance, 1.0::DOUBLE AS gain, 0.0::DOUBLE AS level, FALSE AS far FROM (SELECT DISTINCT dg FROM st)
    UNION ALL SELECT k, dg, n, y, w, CASE WHEN w > 0 AND abs(w - 1) >= 0.05::DOUBLE THEN gain * sqrt(1 / w) ELSE gain END, CASE WHEN w > 0 AND NOT up AND abs(y) > 0.05::DOUBLE THEN m ELSE level END, far
    FROM (SELECT *, {'bool_or(far) OVER (ORDER BY dg)' if together else 'far'} AS up FROM (SELECT *, w > 0 AND abs(w - 1) > 0.25::DOUBLE AS far
        FROM (SELECT st.k, st.dg, st.n, st.m, gain, level, gain * (st.m - level) AS y, gain * gain * st.q AS w FROM r JOIN st ON st.k = r.k + 1 AND st.dg = r.dg))))"""


ORACLE["level_setting"] = f"WITH RECURSIVE {_levels(True)} SELECT k + 1 AS iteration, least((k + 1) * 64, ndat) AS epoch, CAST(dg // 2 AS INTEGER) AS ichan, CAST(dg % 2 AS INTEGER) AS ipol, n, {six('mean', 'mean')}, {six('variance', 'variance')}, {six('gain', 'gain')}, {six('level', 'level')}, far FROM r, nd WHERE k >= 0"
ORACLE["level_apply"] = f"WITH RECURSIVE {_levels(False)} SELECT idat, ichan, ipol, {six('gain * (v - level)', 'v')} FROM d JOIN r ON r.k = idat // 64 - 1 AND r.dg = ichan * 2 + ipol"
#: Mean, unit and largest code of unsigned filterbank samples, by bits.
UNSIGNED = {1: (0.5, 1.0, 1), 2: (1.5, 1.0, 3), 4: (7.5, 1.25, 15), 16: (32768.0, 32768.0 / 6, 65535)}
for _n, (_m, _u, _t) in UNSIGNED.items():
    ORACLE[f"filterbank_digitize{_n}"] = f"WITH {D} SELECT idat, CAST(3 - ichan AS INTEGER) AS ichan, ipol, CAST(greatest(0, least({_t}, trunc((v - 5000) / 4096.0::DOUBLE * {_u!r}::DOUBLE + {_m}::DOUBLE + 0.5::DOUBLE))) AS INTEGER) AS v FROM d"
