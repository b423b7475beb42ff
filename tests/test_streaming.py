"""Streams give what the batch form gives."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import decoders
from tidemark.plans import timeline
from tidemark.streaming import events as streams


def run(stream, name, mode, spark, path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_replay_and_windows_equal_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartitionByRange(3, "event_id").write.parquet(str(tmp_path / "log"))
    source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = run(streams.replayed(source, "user_id", "event_id", "event_type"), "replayed", "update", spark, tmp_path / "c1")
    last = {}
    for r in got.orderBy("upto").collect():
        last[r["user_id"]] = r["retries"]
    want = {}
    for r in batch.orderBy("event_id").collect():
        n = want.get(r["user_id"], 0)
        want[r["user_id"]] = 0 if r["event_type"] == "purchase" else min(5, n + 1) if r["event_type"] == "error" else n
    assert last == want
    tumbling = run(streams.windowed(source, "ts", "60 days", "1 day", ["event_type"]), "tumbling", "complete", spark, tmp_path / "c2")
    assert tumbling.agg(F.sum("n")).first()[0] == batch.count()


def test_observer_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id < 40")
    batch = batch.withColumn("third", F.ntile(3).over(Window.orderBy("ts", "event_id"))).persist()
    for k in (1, 2, 3):  # one after the other, so that the files' times are in order
        batch.filter(F.col("third") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = run(streams.observed(source, "user_id", ["ts", "event_id"], "event_type", "event_id", 5), "observed", "append", spark, tmp_path / "c")
    got = {r["event_id"]: round(r["surprisal"], 6) for r in got.collect()}
    want = timeline.markov_surprisal(spark, sf_dir).join(batch.select("event_id"), "event_id", "left_semi")
    assert got == {r["event_id"]: r["surprisal"] for r in want.collect()}
    batch.unpersist()


def test_append_new_is_idempotent(spark, tmp_path):
    write = streams.append_new(str(tmp_path / "t"), ["k"])
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    write(df, 0)
    write(df, 0)
    write(df.filter("k = 2").unionByName(spark.createDataFrame([(3, "c")], "k int, v string")), 1)
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3]


def test_decoders(spark):
    e = spark.createDataFrame([(1, 0, 3.0), (1, 1, 1.0), (1, 2, 2.0), (1, 3, 0.5), (1, 4, 4.0)], "k int, o int, v double")
    assert [r["v"] for r in decoders.monotone_chain(e, ["k"], "o", "v").orderBy("o").collect()] == [1.0, 2.0, 4.0]
    s = spark.createDataFrame([(1, r, t, float(v)) for r, row in enumerate([[5, 9, 1], [9, 1, 8], [7, 6, 5]]) for t, v in enumerate(row)], "k int, r int, t int, s double")
    assert [(r["r"], r["t"]) for r in decoders.monotone_placement(s, ["k"], "r", "t", "s", 1).orderBy("r").collect()] == [(0, 0), (1, 1), (2, 2)]
    f = spark.createDataFrame([(1, i, st, v) for i, row in enumerate([(1.0, 0.0), (0.0, 0.4), (1.0, 0.0), (0.0, 5.0)]) for st, v in enumerate(row)], "k int, f int, st int, s double")
    assert [r["st"] for r in decoders.viterbi(f, ["k"], "f", "st", "s", 1.0).orderBy("f").collect()] == [0, 0, 0, 1]
