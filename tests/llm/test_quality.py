import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import quality
from gleaner.llm import queries


def table(spark, values, labels):
    return spark.createDataFrame(
        [(i, v.tolist(), int(x)) for i, (v, x) in enumerate(zip(values, labels, strict=True))],
        "doc_id long, statistics array<double>, label int",
    )


def test_fit_equals_numpy(spark):
    rng = np.random.default_rng(0)
    k = len(quality.FEATURES)
    labels = rng.random(300) < 0.7
    values = rng.normal(size=(300, k)) * np.where(labels[:, None], 1.0, 2.5) + labels[:, None]
    params = quality.QdaParams(pooled=0.2, ridge=0.1)
    model = quality.fit(table(spark, values, labels).repartition(7), params)
    own = [values[~labels], values[labels]]
    pooled = sum(np.cov(v.T, bias=True) * len(v) for v in own) / 300
    log_density = []
    for v in own:
        cov = 0.8 * np.cov(v.T, bias=True) + 0.2 * pooled
        cov = 0.9 * cov + 0.1 * np.trace(pooled) / k * np.eye(k)
        d = values - v.mean(axis=0)
        distance = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
        log_density.append(np.log(len(v) / 300) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * distance)
    expected = 1 / (1 + np.exp(log_density[0] - log_density[1]))
    assert np.allclose(quality.scores(model, values), expected, atol=1e-6)


@pytest.mark.parametrize("labels, score", [([], 0.5), ([1, 1], 1.0), ([0], 0.0)])
def test_missing_classes(spark, labels, score):
    k = len(quality.FEATURES)
    rows = [(i, [float(i)] * k, x) for i, x in enumerate(labels)] + [(9, [0.0] * k, None), (8, [0.0] * k, 7)]
    labeled = spark.createDataFrame(rows, "doc_id long, statistics array<double>, label int")
    model = quality.fit(labeled)
    out = quality.predict(labeled, model).collect()
    assert {(r.score, r.predicted) for r in out} == {(score, int(score >= 0.5))}


def test_statistics_tell_texts_apart():
    values = quality.statistics(pa.array(["Some words, then more.", "SOME WORDS!! MORE!!", None, "", "the the the the"]))
    assert np.isfinite(values).all()
    column = dict(zip(quality.FEATURES, values.T, strict=True))
    assert column["upper"][1] > column["upper"][0]
    assert column["marked_words"][1] > column["marked_words"][0]
    assert column["repeats"][4] > column["repeats"][0]
    assert (values[2] == values[3]).all()


def test_awkward_rows(docs, rows, no_docs):
    described = quality.described(docs)
    assert "text" not in described.columns and described.count() == len(rows)
    model = quality.fit(described.withColumn("label", (F.col("doc_id") % 2).cast("int")))
    out = quality.predict(described, model)
    assert sorted(out.columns) == sorted([*(c for c in docs.columns if c != "text"), "predicted"])
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.collect())
    assert quality.predict(quality.described(no_docs), model).count() == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = queries.op10_quality_classifier(spark, sf_dir).where("held_out").join(labels, "doc_id")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95
