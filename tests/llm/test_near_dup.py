import random

import numpy as np
import pyarrow as pa

from gleaner.llm import near_dup

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def shingles(text, k):
    w = (text or "").translate(LOWER).encode().split()
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(texts, k):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(texts))]


def family(n=220, size=60, seed=3):
    """One template with some words changed in every copy: chains of links, and near misses."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(size)]
    texts = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(size), rng.randint(0, 6)):
            words[at] = f"x{rng.randint(0, 3)}" if i % 5 else f"y{i}"
        texts.append(" ".join(words))
    return texts + [f"other text number {i} of {i * i}" for i in range(30)]


def test_shingle_sets_match_python():
    texts = ["a b c", "A B c", "one", None, "", "a a a a", "é É x"]
    for k in (1, 2, 5):
        _, sizes = near_dup.shingle_sets(pa.array(texts), k)
        assert sizes.tolist() == [len(shingles(t, k)) for t in texts]
    values, sizes = near_dup.shingle_sets(pa.array(["a b c", "A B c"]), 2)
    assert (values[:2] == values[2:]).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    sig = near_dup.signatures(np.concatenate([a, b]), np.array([400, 400]), 1024)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.06
    # The smallest offers are taken whatever the order and the chunks.
    again = near_dup.signatures(np.concatenate([b[::-1], a]), np.array([400, 400]), 1024)
    assert (again[1] == sig[0]).all() and (again[0] == sig[1]).all()


def test_components_equal_brute_force(spark):
    texts = family()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in near_dup.group(table, params=near_dup.NearDupParams(shingle=2)).collect()}
    sets, roots = brute(texts, 2)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
        i: (len(s), c, i == c) for i, (s, c) in enumerate(zip(sets, roots, strict=True))
    }
    assert len(set(roots)) > 40  # some copies are too far from all others


def test_awkward_rows(docs, rows):
    got = near_dup.group(docs).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if r.doc_id not in (3, None):
            assert r.n_shingles == len(shingles(texts[r.doc_id], 5))
        if r.n_shingles == 0:
            assert r.component_id == r.doc_id and r.kept
        assert r.kept == (r.doc_id == r.component_id)
    left = near_dup.survivors(docs)
    assert left.columns == docs.columns
    assert left.count() >= sum(r.kept for r in got)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long").repartition(8)
    found = near_dup.components(links).collect()
    assert {r.node: r.root for r in found} == {i: 0 for i in range(1, 501)}


def test_empty_table(no_docs):
    assert near_dup.group(no_docs).count() == 0
    assert near_dup.survivors(no_docs).count() == 0


def test_survivors_tell_rows_apart_that_share_an_id(spark):
    near = [" ".join(f"w{k}" for k in range(60)) + f" tail{i}" for i in range(6)]
    clean = [f"quite another text number {i} of its own {i * i} words" for i in range(3)]
    rows = [
        (1, near[0], "a"),
        (2, near[1], "b"),
        (2, clean[0], "c"),  # not to go with the near copy of the same id
        (1, near[2], "d"),  # a near copy with the id that is kept
        (None, near[3], "e"),
        (None, near[4], "f"),
        (None, clean[1], "g"),
        (None, "", "h"),
        (None, None, "i"),
    ]
    rows += [(None, f"{clean[2]} and more and more", "j"), (None, f"{clean[2]} and more and more", "k")]
    table = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(3)
    left = near_dup.survivors(table, params=near_dup.NearDupParams(shingle=2))
    assert left.columns == ["doc_id", "text", "mark"]
    marks = sorted(r.mark for r in left.collect())
    assert len([m for m in marks if m in "abdef"]) == 1 and {"a", "d"} & set(marks)
    assert len([m for m in marks if m in "jk"]) == 1
    assert [m for m in marks if m in "cghi"] == ["c", "g", "h", "i"]


def test_fewer_words_than_a_shingle_in_a_whole_slice(spark):
    for text in ("one two", "one two three"):
        assert near_dup.shingle_sets(pa.array([text]), 5)[1].tolist() == [1]
    long = " ".join(f"w{i}" for i in range(100_000))
    assert len(long) > 1 << 19
    for texts in (["one two"], ["one two", long]):
        table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        assert near_dup.survivors(table).count() == len(texts)
