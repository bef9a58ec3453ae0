import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import queries
from gleaner.llm import toxic_spans as ts


def enumerated(own, pair):
    """Marginals, pair marginals and log of the sum over all ways to tag a few words."""
    total, single, double = 0.0, np.zeros(len(own)), np.zeros(max(0, len(own) - 1))
    for tags in itertools.product((0, 1), repeat=len(own)):
        tags = np.array(tags)
        p = np.exp((own * tags).sum() + pair * (tags[:-1] * tags[1:]).sum())
        total += p
        single += p * tags
        double += p * tags[:-1] * tags[1:]
    return single / total, double / total, np.log(total)


@pytest.mark.parametrize("pair", [0.0, 2.5, 8.0, -1.5])
def test_messages_equal_enumeration(pair):
    rng = np.random.default_rng(3)
    sizes = [1, 6, 9, 2]
    own = rng.normal(scale=3, size=sum(sizes))
    first = np.zeros(len(own), dtype=bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    ahead = ts.chain(own, first, pair)
    ratio = ahead + ts.backward(own, ts._lasts(first), pair)
    at = 0
    for n in sizes:
        single, _, log_total = enumerated(own[at : at + n], pair)
        assert np.allclose(1 / (1 + np.exp(-ratio[at : at + n])), single, atol=1e-7)
        assert np.isclose(ts._softplus(ahead[at : at + n]).sum(), log_total)
        at += n


def test_gradient_equals_differences():
    rng = np.random.default_rng(4)
    n, known = 40, 6
    word, shape = rng.integers(0, known + 1, n), rng.integers(0, 40, n)
    first = np.zeros(n, dtype=bool)
    first[[0, 1, 17]] = True
    tag = (rng.random(n) < 0.4).astype(float)
    weights = rng.normal(size=ts._WORDS + known + 1)
    _, gradient = ts.likelihood(weights, word, shape, first, tag)
    for i in [0, 1, 2, 3 + shape[0], ts._WORDS, ts._WORDS + known]:
        step = np.zeros(len(weights))
        step[i] = 1e-5
        up, down = (ts.likelihood(weights + s * step, word, shape, first, tag)[0] for s in (1, -1))
        assert np.isclose(gradient[i], (up - down) / 2e-5, atol=1e-4)


def test_ascent_finds_a_maximum():
    scales = np.array([1.0, 30.0, 200.0])
    objective = lambda x: (-(scales * (x - 2) ** 2).sum(), -2 * scales * (x - 2))
    assert np.allclose(ts.ascend(objective, np.zeros(3), 100), 2, atol=0.1)


def test_tokens_fold_case_and_marks():
    found = ts.tokens(pa.array(["Idiot, IDIOT!! (idiot) #idiot! ÉTÉ été", None, "", "!!! ## " + "?" * 50, "x" + "?" * 40, "v1 v2"]))
    assert len(set(found.word[:4])) == 1 and found.word[4] == found.word[5] != found.word[0]
    assert len(set(found.word[6:9])) == 1
    assert found.text.tolist() == [0] * 6 + [3] * 3 + [4, 5, 5] and found.word[10] != found.word[11]
    assert found.shape[0] != found.shape[1]
    assert ts.tokens(pa.array(["x"])).word[0] == found.word[9]


def model(**changes):
    known = np.sort(ts.tokens(pa.array(["idiot", "moron"][:2])).word)
    weights = np.zeros(ts._WORDS + 3)
    weights[ts._BIAS], weights[ts._PAIR] = -6.0, 3.0
    weights[ts._WORDS : ts._WORDS + 2] = 11.0
    return ts.CrfModel(known, weights, np.array([0.0, 1.0, 0.1]), ts.CrfParams(), **changes)


def test_stretches_pass_messages_on():
    rng = np.random.default_rng(5)
    words = rng.choice(["some", "words", "idiot", "Moron!", "été", "x" * 90], 3000, p=[0.4, 0.3, 0.1, 0.1, 0.09, 0.01])
    text = " ".join(words)
    whole, spans = ts.score_texts(model(), pa.array([text]))
    for stretch in (50, 200, 1000):
        score, same = ts.score_texts(model(), pa.array([text]), stretch)
        assert np.allclose(score, whole) and same == spans
    assert spans[0] and all(set(text[s["start"] : s["end"]].lower().strip("!").split()) & {"idiot", "moron!", "moron"} for s in spans[0])
    scores, spans = ts.score_texts(model(), pa.array(["an idiot here", "fine words", "", None]))
    assert scores[0] > 0.7 > scores[1] and spans == [[{"start": 3, "end": 8}], [], [], []]
    assert (scores[2:] == scores[2]).all()


def labelled(spark, n=300):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n):
        words = [chr(97 + rng.integers(0, 20)) + "word" for _ in range(rng.integers(3, 40))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.integers(0, len(words)), str(rng.choice(["idiot", "moron", "scum"])))
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_fit_catches_words_of_toxic_documents(spark):
    rows = labelled(spark)
    odd = spark.createDataFrame([(900, "idiot", None), (901, "idiot", 7), (902, None, 0), (903, "", 1)], rows.schema)
    learned = ts.fit(rows.union(odd), "doc_id", "text", "toxic")
    fresh = spark.createDataFrame([(1, "aword bword Idiot, cword"), (2, "aword bword cword dword"), (3, "never seen"), (4, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in ts.predict(fresh.withColumn("score", F.lit(3)), learned).collect()}
    assert [out[i].predicted for i in (1, 2, 3, 4)] == [1, 0, 0, 0]
    assert [tuple(s) for s in out[1].spans] == [(12, 18)] and not out[2].spans


@pytest.mark.parametrize("labels, score", [([], 0.5), ([1, 1], 1.0), ([0], 0.0)])
def test_missing_classes(spark, labels, score):
    rows = spark.createDataFrame([(i, "some words", x) for i, x in enumerate(labels)], "doc_id long, text string, toxic int")
    learned = ts.fit(rows, "doc_id", "text", "toxic")
    got = ts.predict(spark.createDataFrame([(1, "a")], "doc_id long, text string"), learned).collect()
    assert [(r.score, r.predicted) for r in got] == [(score, int(score >= 0.7))]


def test_copies_of_one_text_are_one_context(spark):
    copies = [(i, "these words are rare but clean enough", 1) for i in range(60)]
    others = [(100 + i, f"w{i} other words idiot w{i + 1}", 1) for i in range(30)]
    clean = [(200 + i, f"other w{i} words", 0) for i in range(60)]
    rows = spark.createDataFrame(copies + others + clean, "doc_id long, text string, toxic int")
    known, evident = ts._vocabulary(ts._tokenised(rows, "text", "toxic"), ts.CrfParams())
    of = lambda w: evident[known == ts.tokens(pa.array([w])).word[0]].tolist()
    assert of("idiot") == [True] and of("rare") == [] and of("words") == [False]


def test_awkward_rows(docs, rows, no_docs):
    labels = docs.where("doc_id is not null").withColumn("toxic", (F.col("doc_id") % 3 == 0).cast("int"))
    learned = ts.fit(labels, "doc_id", "text", "toxic")
    out = ts.predict(docs, learned)
    assert out.count() == len(rows) and "text" not in out.columns
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.collect())
    assert ts.predict(no_docs, learned).count() == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = queries.op13_toxic_spans(spark, sf_dir).where("held_out").join(labels, "doc_id").cache()
    assert out.where("toxic = 0 and predicted = 1").count() <= 0.02 * out.where("toxic = 0").count()
    assert out.where("toxic = 1 and predicted = 1").count() >= 0.7 * out.where("toxic = 1").count()
