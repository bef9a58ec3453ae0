import datetime

from pyspark.sql import functions as F

from gleaner.plans import queries
from gleaner.operators import labeling, routing
from gleaner.streaming import progress, scoring

SCHEMA = "sample_id string, p double, route string, batch_id long"


def test_stream_scores_every_item_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def feed(rows):
        spark.createDataFrame(rows, "sample_id string, x double").coalesce(1).write.mode(
            "append").parquet(source)

    def run():
        arriving = spark.readStream.schema("sample_id string, x double").parquet(source)
        scoring.stream_score(
            arriving, lambda df: df.select("sample_id", F.col("x").alias("p")), out, mark
        ).awaitTermination()
        return scoring.routed_so_far(spark, out, SCHEMA)

    feed([("a", 0.1), ("b", 0.5), ("b", 0.5), ("c", 0.9)])
    first = run()
    assert {(r.sample_id, r.route) for r in first.collect()} == {
        ("a", "negative"), ("b", None), ("c", "positive")}
    feed([("a", 0.95), ("b", 0.95), ("d", 0.2)])
    second = run()
    rows = second.collect()
    assert len(rows) == 4
    assert {(r.sample_id, r.route) for r in rows} == {
        ("a", "negative"), ("b", None), ("c", "positive"), ("d", "negative")}
    run()
    assert scoring.routed_so_far(spark, out, SCHEMA).count() == 4
    batch = spark.createDataFrame([("a", 0.1), ("c", 0.9), ("d", 0.2)], "sample_id string, p double")
    routed = second.where("route is not null").select("sample_id", "p", "route")
    assert sorted(map(tuple, routed.collect())) == sorted(
        map(tuple, routing.route_items(batch).collect()))


def test_first_label_wins_across_batches(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "event_id long, ts timestamp, sample_id string, label int"

    def at(minute):
        return datetime.datetime(2024, 1, 1, 0, minute)

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        arriving = spark.readStream.schema(schema).parquet(source)
        progress.stream_first_labels(arriving, out, mark).awaitTermination()
        return {r.sample_id: r.label for r in progress.current_labels(spark, out).collect()}

    feed([(1, at(5), "a", 1), (2, at(6), "a", 0), (3, at(1), "b", 0)])
    assert run() == {"a": 1, "b": 0}
    # A late event that is earlier in event time takes over; a later one does not.
    feed([(4, at(2), "a", 0), (5, at(9), "b", 1), (6, at(3), "c", 1)])
    assert run() == {"a": 0, "b": 0, "c": 1}
    batch = labeling.first_labels(spark.read.parquet(source))
    assert {r.sample_id: r.label for r in batch.collect()} == {"a": 0, "b": 0, "c": 1}


def test_routed_sets_grow_run_by_run(spark, tmp_path):
    out = str(tmp_path / "sets")
    items = spark.createDataFrame(
        [(i, f"in/{i}.v2.png") for i in "abcd"], "sample_id string, path string")
    features = items.select("sample_id", F.array(F.lit(1.0)).alias("vec"))

    def write(ids, run, source=""):
        routed = items.where(F.col("sample_id").isin(*ids)).select("sample_id", F.lit("positive").alias("route"))
        routing.write_routed(routed, items, features, out, run, source, path="path")

    write("ab", "one")
    write("cd", "two")
    write("cd", "two")
    assert sorted(r.sample_id for r in routing.read_routed(spark, out).collect()) == list("abcd")
    assert routing.read_routed(spark, out, "pretrained_features").count() == 4
    row = routing.read_routed(spark, out).where("sample_id = 'a'").first()
    assert row.dest_name == f"{row.dest_id}.png" and row.run == "one" and row.route == "positive"
    write("a", "three", source="other")
    ids = [r.dest_id for r in routing.read_routed(spark, out).where("sample_id = 'a'").collect()]
    assert len(set(ids)) == 2


def test_watermark_bounds_the_seen_ids(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(datetime.datetime(2024, 1, 1, 0, i), "ab"[i % 2], 0.1 * i) for i in range(4)]
    spark.createDataFrame(rows, "ts timestamp, sample_id string, x double").coalesce(1).write.parquet(source)
    arriving = spark.readStream.schema("ts timestamp, sample_id string, x double").parquet(source)
    scoring.stream_score(
        arriving, lambda df: df.select("sample_id", F.col("x").alias("p")), out, str(tmp_path / "mark"),
        event_time="ts", watermark="1 hour", trigger={"availableNow": True},
    ).awaitTermination()
    assert sorted(r.sample_id for r in scoring.routed_so_far(spark, out, SCHEMA).collect()) == ["a", "b"]


def test_a_large_table_arrives_in_as_many_files_as_it_has_pieces(spark, tmp_path, monkeypatch):
    spark.range(900).repartition(9).write.parquet(str(tmp_path / "events.parquet"))
    folder = tmp_path / "arriving"
    monkeypatch.setattr(queries, "new_path", lambda *_: str(folder))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, "1k")
    try:
        stream = queries._stream(spark, str(tmp_path), "events")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(list(folder.glob("*.parquet"))) >= 9
    seen = []
    query = stream.writeStream.foreachBatch(lambda df, _: seen.append(df.count()))
    query.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sum(seen) == 900 and len(seen) == 2
