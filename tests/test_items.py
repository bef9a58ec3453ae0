from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions import keys, text
from gleaner.operators import collect, featurize, labeling, routing
from gleaner.session import new_path, shared_dir
from gleaner.sources import items, store


def test_scan_items(spark, tmp_path):
    for name in ("a.b.png", "a.c.png", "b.jpg", "noext"):
        (tmp_path / name).write_bytes(name.encode())
    found = items.scan_items(spark, str(tmp_path))
    assert sorted(r.sample_id for r in found.collect()) == ["a", "a", "b"]
    assert [(r.sample_id, r.n_items) for r in items.id_collisions(found).collect()] == [("a", 2)]
    assert sorted(bytes(r.content) for r in found.collect())[0] == b"a.b.png"


def test_scan_items_fallback_and_empty(spark, tmp_path):
    (tmp_path / "images").mkdir()
    assert items.scan_items(spark, str(tmp_path)).count() == 0
    assert items.scan_items(spark, str(tmp_path / "missing")).columns == ["sample_id", "path", "content"]
    (tmp_path / "images" / "x.png").write_bytes(b"1")
    assert [r.sample_id for r in items.scan_items(spark, str(tmp_path)).collect()] == ["x"]
    out = items.normalize_layout(spark, str(tmp_path), str(tmp_path / "out"))
    assert spark.read.parquet(out).count() == 1
    assert (tmp_path / "images" / "x.png").exists()


def test_name_parts(spark):
    row = spark.createDataFrame([("/d/e.f/a.b.png",)], "p string").select(
        keys.sample_id("p").alias("id"), keys.extension("p").alias("ext"),
        keys.routed_id(keys.sample_id("p")).alias("dest"), keys.uniform(1, "p").alias("u"),
    ).first()
    assert (row.id, row.ext) == ("a", "png")
    assert row.dest.startswith("a_") and len(row.dest) == 7 and 0 < row.u < 1


def test_letter_counts():
    texts = ["aA bB", "", None, "äz Z!", "x" * 100]
    counts = text.letter_counts(pa.array(texts))
    for row, t in zip(counts, texts):
        t = t or ""
        expected = [t.count(c) + (t.count(c.upper()) if c != " " else 0) for c in text.LETTERS]
        assert row.tolist() == expected
    sliced = text.letter_counts(pa.array(["zz", "ab", "c"]).slice(1))
    assert sliced.sum() == 3


def test_shape_of_odd_texts():
    """Rare control characters do not part words; multi-byte characters count once."""
    texts = ["a\x0bb a\x0bb c", "äö äö\tß", "", None]
    got = text.shape_statistics(pa.array(texts), pa.array([9, 7, 0, 0]))
    np.testing.assert_allclose(got[0, 6:], [2 / 3, 7 / 3 / 10])
    np.testing.assert_allclose(got[1, 6:], [2 / 3, 5 / 3 / 10])
    assert got[2].tolist() == [0.0] * 8 and got[3].tolist() == [0.0] * 8


def test_shape8(spark):
    df = spark.createDataFrame([("Ab 1,\nab ab", 11)], "text string, n_chars int")
    shape = df.select(text.shape8("text", "n_chars").alias("v")).first().v
    expected = [1 / 11, 1 / 11, 1 / 11, 1 / 11, 2 / 11, np.log(11), 3 / 4, 8 / 4 / 10]
    np.testing.assert_allclose(shape, expected)


def test_store_computes_once(spark):
    docs = spark.createDataFrame(
        [("a", "xx"), ("b", "y z")], "sample_id string, text string"
    )
    kept = store.FeatureStore(spark, new_path(spark, "store"))
    assert kept.read().count() == 0
    featurize.extract_features(docs.where("sample_id = 'a'"), ["letters27"], kept)
    assert [r.sample_id for r in kept.pending(docs, "letters27").collect()] == ["b"]
    featurize.extract_features(docs, ["letters27"], kept)
    featurize.extract_features(docs, ["letters27"], kept)
    assert kept.read(["letters27"]).count() == 2
    plan = kept.read(["letters27"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "letters27" in plan.split("PartitionFilters")[1]


def test_registry(spark):
    with pytest.raises(KeyError, match="unknown"):
        featurize.featurizer("nothing")
    with pytest.raises(KeyError, match="pretrained"):
        featurize.featurizer("DINO_ViTS_8")
    assert len(featurize.PRETRAINED_MODELS) == 26
    for n in (1, 2, 4, 7):
        assert len(featurize.feature_set_preset(n)) == n
        assert set(featurize.feature_set_preset(n)) <= set(featurize.PRETRAINED_MODELS)
    with pytest.raises(ValueError):
        featurize.feature_set_preset(3)

    def make_predict_fn():
        def predict(batch):
            return np.stack([[len(t), t.count("a")] for t in batch]).astype(float)

        return predict

    featurize.register_batch_model("lengths", "text", make_predict_fn, batch_size=2)
    df = spark.createDataFrame([(i, "a" * i) for i in range(5)], "sample_id int, text string")
    got = featurize.featurize(df, "lengths").orderBy("sample_id").collect()
    assert [r.vec for r in got] == [[float(i), float(i)] for i in range(5)]


FEATURES = "sample_id string, model string, vec array<double>"


def test_concat_and_alignment(spark):
    rows = [("a", "m", [3.0, 4.0]), ("a", "n", [0.0, 2.0]), ("b", "m", [1.0, 0.0]),
            ("b", "n", [1.0, 0.0])]
    full = spark.createDataFrame(rows, FEATURES)
    got = {r.sample_id: r.vec for r in collect.concat_features(full, ["n", "m"]).collect()}
    assert got["a"] == [0.0, 1.0, 0.6, 0.8]
    raw = collect.concat_features(full, ["m", "n"], normalize=False)
    assert {r.sample_id: r.vec for r in raw.collect()}["a"] == [3.0, 4.0, 0.0, 2.0]
    collect.check_alignment(full, ["m", "n"])
    part = spark.createDataFrame(rows[:3], FEATURES)
    with pytest.raises(ValueError, match="1 items"):
        collect.check_alignment(part, ["m", "n"])
    with pytest.raises(Exception, match="not one vector of each"):
        collect.concat_features(part, ["m", "n"]).collect()
    with pytest.raises(Exception, match="no features of model 'n'"):
        collect.collect_features(full.select("sample_id").distinct(), part, "n").collect()
    with pytest.raises(ValueError):
        collect.check_same_models(["m", "n"], ["n", "m"])
    width = collect.width_range(full).first()
    assert (width.min_width, width.max_width, width.n_items, width.n_null) == (2, 2, 4, 0)


def test_zero_vector_is_null_and_counted(spark):
    df = spark.createDataFrame([("z", "m", [0.0, 0.0]), ("a", "m", [1.0, 0.0])], FEATURES)
    got = collect.collect_features(df.select("sample_id"), df, "m")
    assert {r.sample_id: r.vec for r in got.collect()} == {"z": None, "a": [1.0, 0.0]}
    assert collect.width_range(got).first().n_null == 1


def test_routes_are_inclusive_and_independent(spark):
    df = spark.createDataFrame(
        [("l", 0.3), ("m", 0.5), ("h", 0.7)], "sample_id string, p double"
    )
    plain = {(r.sample_id, r.route) for r in routing.route_items(df).collect()}
    assert plain == {("l", "negative"), ("h", "positive")}
    both = routing.route_items(df, positive=0.3, negative=0.7)
    assert both.count() == 6
    assert routing.residual(df, routing.route_items(df)).first().sample_id == "m"
    kept = routing.route_items(df, keep_unrouted=True)
    assert {(r.sample_id, r.route) for r in kept.collect()} == plain | {("m", None)}
    assert routing.cold_start_scores(df.select("sample_id")).first().p == 0.1


def test_write_routed(spark, tmp_path):
    scores = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "sample_id string, p double")
    things = scores.select("sample_id", F.lit("x").alias("content"))
    features = spark.createDataFrame([("a", "m", [1.0]), ("b", "m", [2.0])], FEATURES)
    routing.write_routed(routing.route_items(scores), things, features, str(tmp_path), "run1")
    moved = spark.read.parquet(f"{tmp_path}/images/run=run1/route=negative").collect()
    assert len(moved) == 1 and moved[0].dest_id.startswith("a_")
    vecs = spark.read.parquet(f"{tmp_path}/pretrained_features").collect()
    assert {(r.sample_id, r.route) for r in vecs} == {("a", "negative"), ("b", "positive")}


def test_sampling_weights(spark):
    df = spark.createDataFrame(
        [(0, 0.05), (1, 0.5), (2, 0.95)], "sample_id int, p double"
    )
    weights = [r[0] for r in df.orderBy("sample_id").select(
        F.round(labeling.sampling_weight("p", 0.15, 0.85), 6)).collect()]
    assert weights == [0.01, 1.0, 0.01]
    crossed = [r[0] for r in df.orderBy("sample_id").select(
        F.round(labeling.sampling_weight("p", 0.65, 0.35), 6)).collect()]
    assert crossed == [0.01, 0.0001, 0.01]


def test_uncertainty_sample_prefers_the_middle_and_skips_labeled(spark):
    pool = spark.range(2000).select(
        F.col("id").alias("sample_id"), (F.col("id") / 2000).alias("p")
    )
    done = pool.where("sample_id % 2 = 0").select("sample_id")
    drawn = labeling.uncertainty_sample(pool, done, 100, 0.4, 0.6).toPandas()
    assert len(drawn) == 100 and (drawn.sample_id % 2 == 1).all()
    assert ((drawn.p >= 0.4) & (drawn.p <= 0.6)).mean() > 0.85


def test_progress_counts(spark):
    pool = spark.createDataFrame([(i, 0.5) for i in range(5)], "sample_id long, p double")
    events = spark.createDataFrame(
        [(1, 10, 0, 1), (2, 5, 0, 0), (3, 7, 3, 1)],
        "event_id long, ts long, sample_id long, label int",
    )
    row = labeling.label_progress(pool, labeling.first_labels(events)).first()
    assert (row.unlabeled, row.labeled, row.positive, row.negative) == (3, 2, 1, 1)


class _FakeSession:
    """Just enough of a session to ask where its shared folder is."""

    def __init__(self, setting, master):
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}
        self.sparkContext = SimpleNamespace(master=master, getCheckpointDir=lambda: None)


def test_shared_dir_follows_the_setting():
    assert shared_dir(_FakeSession("hdfs://name/dir/", "yarn")) == "hdfs://name/dir"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_FakeSession(None, "yarn"))


def test_doubled_store_rows_are_refused(spark):
    items = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    rows = [("a", "m", [1.0]), ("b", "m", [2.0]), ("b", "m", [2.0])]
    features = spark.createDataFrame(rows, "sample_id string, model string, vec array<double>")
    with pytest.raises(Exception, match="several features of model 'm' for item b"):
        collect.collect_features(items, features, "m").collect()
    assert collect.collect_features(items.limit(1), features.limit(1), "m").count() == 1


def test_paths_of_an_application_share_a_folder(spark):
    """What ``remove_staged`` takes away is this application's alone."""
    one, other = new_path(spark, "a"), new_path(spark, "a")
    folder = f"{shared_dir(spark)}/gleaner/{spark.sparkContext.applicationId}/"
    assert one != other and one.startswith(folder) and other.startswith(folder)
