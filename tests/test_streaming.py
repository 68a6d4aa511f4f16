import pytest
from pyspark.sql import functions as F

from cadenza.operators.folding import fold
from cadenza.streaming.subint import run_to_table, streaming_fold, streaming_levels, streaming_scrunch, streaming_turns

SCHEMA = "idat long, ichan int, ipol int, v long, us long"


def stream(spark, tmp_path, batches):
    folder = str(tmp_path / "in")
    for k, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(f"{folder}/b={k}")
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b=*")
    return rows.withColumn("ts", F.timestamp_micros("us"))


def samples(spark, a, b):
    return spark.range(a, b).selectExpr("id AS idat", "cast(id % 2 AS int) AS ichan", "0 AS ipol", "id * 3 % 17 AS v", "id * 250000 AS us")


def test_streaming_fold_matches_batch(spark, tmp_path):
    rows = stream(spark, tmp_path, [samples(spark, 0, 500), samples(spark, 500, 1200), samples(spark, 40_000, 40_001), samples(spark, 80_000, 80_001)])
    run_to_table(streaming_fold(rows, 3_000_000, 4, 60), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).filter("start < timestamp_seconds(300)")
    batch = samples(spark, 0, 1200)
    want = fold(batch, F.col("us"), 3_000_000, 4, division=F.expr("us div 60000000"))
    key = lambda df, c: sorted(map(tuple, df.select(c, "ichan", "ipol", "ibin", "total", "hits").collect()))
    assert key(got.withColumn("division", F.expr("unix_micros(start) div 60000000")), "division") == key(want, "division")


def test_streaming_levels(spark, tmp_path):
    rows = stream(spark, tmp_path, [samples(spark, 0, 480), samples(spark, 80_000, 80_001), samples(spark, 160_000, 160_001)])
    run_to_table(streaming_levels(rows, 60), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).filter("start < timestamp_seconds(120)")
    assert got.count() == 4 and got.agg(F.sum("n")).first()[0] == 480


def test_carry_over_between_batches(spark, tmp_path):
    rows = stream(spark, tmp_path, [samples(spark, 0, 14), samples(spark, 14, 31)])
    run_to_table(streaming_scrunch(rows.select("idat", "ichan", "ipol", "v"), 5), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    v = {c: [i * 3 % 17 for i in range(31) if i % 2 == c] for c in (0, 1)}
    assert got == sorted((k, c, 0, sum(v[c][k * 5 : k * 5 + 5])) for c in (0, 1) for k in range(3))


def test_fractions_survive_and_gaps_raise(spark, tmp_path):
    make = lambda a, b: samples(spark, a, b).withColumn("v", F.col("idat") + F.lit(0.25)).filter("ichan = 0")
    folder = str(tmp_path / "in")
    for k, df in enumerate((make(0, 14), make(14, 31))):
        df.coalesce(1).write.parquet(f"{folder}/b={k}")
    rows = spark.readStream.schema("idat long, ichan int, ipol int, v double, us long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/b=*")
    run_to_table(streaming_scrunch(rows.select("idat", "ichan", "ipol", "v"), 4, stride=2), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [(k, 0, 0, sum(i + 0.25 for i in range(8 * k, 8 * k + 8, 2))) for k in range(4)]
    with pytest.raises(Exception, match="missing, repeated or late"):
        run_to_table(streaming_scrunch(rows.select("idat", "ichan", "ipol", "v"), 4, stride=1), str(tmp_path / "out2"), str(tmp_path / "cp2"))


def test_late_turns_make_a_second_record(spark, tmp_path):
    batches = [samples(spark, 0, 200), samples(spark, 200, 400), samples(spark, 20, 30), samples(spark, 400, 600), samples(spark, 2000, 2002)]
    rows = stream(spark, tmp_path, batches)
    run_to_table(streaming_turns(rows, 2_000_000, 4, 5), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.filter("part = 1").select("division").distinct().count() == 1
    whole = samples(spark, 0, 600).unionByName(samples(spark, 20, 30))
    want = fold(whole, F.col("us"), 2_000_000, 4, division=F.expr("us div 10000000"))
    closed = got.agg(F.max("division")).first()[0]
    key = lambda df: sorted((r["division"], r["ichan"], r["ibin"], float(r["total"]), r["hits"]) for r in df.filter(F.col("division") < closed).collect())
    assert key(got.groupBy("division", "ichan", "ibin").agg(F.sum("total").alias("total"), F.sum("hits").alias("hits"))) == key(want)
