"""Phase predictors: polynomials of pulse phase by stretches of time, in the text form of the TEMPO program (polyco files)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

MJD_EPOCH, DAY_US = 40587, 86_400_000_000
SCHEMA = "segment long, mid_us long, turns long, fraction double, f0 double, coeffs array<double>"


@dataclass(frozen=True)
class Segment:
    """phase(t) = turns + fraction + 60 f0 dt + c0 + c1 dt + c2 dt**2 + ..., dt in minutes from mid_us."""

    mid_us: int
    turns: int
    fraction: float
    f0: float  # Hz
    coeffs: tuple[float, ...] = field(default=())
    span_minutes: float = 60.0

    def phase(self, us: float) -> float:
        dt = (us - self.mid_us) / 60e6
        value = 0.0
        for c in reversed(self.coeffs):
            value = value * dt + c
        return self.turns + self.fraction + 60 * self.f0 * dt + value


def parse_mjd(text: str) -> int:
    """Microseconds since 1970 of a decimal day, without rounding through a double."""
    day, _, rest = text.partition(".")
    return (int(day) - MJD_EPOCH) * DAY_US + round(int(rest.ljust(17, "0")[:17] or 0) * DAY_US / 10**17)


def parse_polyco(lines: list[str]) -> list[Segment]:
    """Segments of a polyco file: two heading lines a segment, then its coefficients, three a line."""
    rows, out, at = [x.replace("D", "E").replace("d", "e").split() for x in lines if x.strip()], [], 0
    while at + 1 < len(rows):
        head, second = rows[at], rows[at + 1]
        mjd = next(x for x in head[1:] if "." in x and x.replace(".", "").isdigit() and 40000 < float(x) < 100000)
        n, span = int(second[4]), float(second[3])
        whole, _, part = second[0].partition(".")
        sign = -1 if whole.startswith("-") else 1
        body = [float(x) for line in rows[at + 2 : at + 2 + -(-n // 3)] for x in line][:n]
        out.append(Segment(parse_mjd(mjd), int(whole), sign * float(f"0.{part or 0}"), float(second[1]), tuple(body), span))
        at += 2 + -(-n // 3)
    return out


def table(spark: SparkSession, segments: list[Segment]) -> tuple[DataFrame, int, int]:
    """The segments as a table, by number, with the start of the first and the length of each in microseconds; all are equally long and follow each other."""
    segments = sorted(segments, key=lambda s: s.mid_us)
    length = round(segments[0].span_minutes * 60e6)
    start = segments[0].mid_us - length // 2
    rows = [((s.mid_us - start) // length, s.mid_us, s.turns, s.fraction, s.f0, list(s.coeffs)) for s in segments]
    if len({r[0] for r in rows}) < len(rows) or any(round(s.span_minutes * 60e6) != length for s in segments):
        raise ValueError("segments are of one length and do not overlap")
    return spark.createDataFrame(rows, SCHEMA), start, length
