from collections import defaultdict

import numpy as np
import pytest

from gleaner.llm import source_mix


def n_words(text):
    return len((text or "").encode().split())


def fill(sizes, weights, most):
    """Targets by sharing out the excess again and again."""
    total = sum(sizes.values())
    capped = {}
    while True:
        free = {s: w for s, w in weights.items() if s not in capped}
        left = total - sum(capped.values())
        over = {s: most * sizes[s] for s, w in free.items() if left * w / sum(free.values()) > most * sizes[s]}
        if not over:
            return capped | {s: left * w / sum(free.values()) for s, w in free.items()}
        capped |= over


def test_targets_and_taken(docs, rows):
    documents, _ = source_mix.mix(docs)
    got = documents.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += n_words(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = fill(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, 3)
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert taken[s] == pytest.approx(target[s], rel=0.02, abs=5)


def test_reruns_agree_and_rounds_are_whole(docs):
    one, drawn = source_mix.mix(docs)
    other, _ = source_mix.mix(docs)
    columns = ["doc_id", "size", "taken"]
    assert sorted(map(str, one.select(columns).collect())) == sorted(map(str, other.select(columns).collect()))
    counted = drawn.groupBy("row", "round", "start").count()
    assert counted.where("count > 1").isEmpty()


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutations_are_bijections(n):
    for key in (0, 5, 2**62):
        assert sorted(source_mix._permuted(np.arange(n), n, key)) == list(range(n))


def test_skewed_targets_are_capped(spark):
    rows = [(i, "w " * (5 if i % 10 else 500), f"s{i % 10}") for i in range(200)]
    documents, _ = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    per_source = documents.groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect()
    for r in per_source:
        assert r["max(target)"] <= 3 * r["max(source_size)"] + 1e-6
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.02, abs=3)


def test_mixed_documents_hold_what_is_drawn(docs):
    mixed = source_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns
    documents, _ = source_mix.mix(docs)
    assert sum(n_words(r.text) for r in mixed.collect()) == sum(r.taken for r in documents.collect())


def test_empty_table_and_empty_texts(spark, no_docs):
    assert source_mix.mix(no_docs)[0].count() == 0
    assert source_mix.mixed_documents(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in source_mix.mix(blank)[0].collect()] == [(0, 0.0, 0)] * 2


def test_sizes_are_counted_without_python_workers(spark, docs, rows, monkeypatch):
    awkward = ["a\u00a0b c", "\x1c x\x0by", "\u2003", "\U0001f600 z"]
    more = spark.createDataFrame([(1000 + i, t, "a") for i, t in enumerate(awkward)], "doc_id long, text string, source string")
    both = docs.select("doc_id", "text", "source").unionByName(more)

    def refused(*_):
        raise AssertionError("texts went to Python workers")

    monkeypatch.setattr(type(both), "mapInArrow", refused)
    got = source_mix.sized(both, "doc_id", "text", "source", None).collect()
    assert sorted(r["size"] for r in got) == sorted(n_words(t) for t in [*(r[1] for r in rows), *awkward])
