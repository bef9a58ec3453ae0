import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.llm import pitman_yor
from gleaner.llm.pitman_yor import PitmanYorParams

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())
SMALL = PitmanYorParams(order=2, frequent_words=8, classes=2, samples=2, sweeps=2)


def tokens(text):
    return [*(text or "").translate(LOWER).encode().split(), None]


def test_tables_are_drawn_from_their_conditional():
    """Against seating customers one by one, weighted by what the seating leaves out."""
    d, a, c, n = 0.5, 1.3, 6, 40_000
    random = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(7919)
    drawn = pitman_yor.sample_tables(random, np.full(n, c), np.full(n, a), d)
    stirling = {(0, 0): 1.0}
    for i in range(c):
        for t in range(i + 2):
            stirling[i + 1, t] = stirling.get((i, t - 1), 0) + (i - d * t) * stirling.get((i, t), 0)
    weight = np.array([stirling[c, t] * a**t for t in range(1, c + 1)])
    share = np.bincount(drawn, minlength=c + 1)[1:] / n
    assert np.abs(share - weight / weight.sum()).max() < 0.01


def test_word_tables_of_two_contexts_follow_their_joint_distribution():
    """Against all seatings of a word with 4 and 3 customers in two contexts, weighed one by one."""
    total, n = 1_000_000, 20_000
    sample = pitman_yor.Sample(0, pitman_yor._empty_spelling(1), np.array([total, 2 * total]), total)
    params = PitmanYorParams(classes=1, word_sweeps=12)
    dc, dw = params.class_discount, params.word_discount
    spelled = 0.05 / (1 + dw * total)

    def stirling(c, t, d):
        if c == 0 or t == 0:
            return float(c == t)
        return stirling(c - 1, t - 1, d) + max(c - 1 - d * t, 0) * stirling(c - 1, t, d)

    weight = {}
    for t in range(1, 5):
        for u in range(1, 4):
            seated = stirling(4, t, dc) * (dc / 3) ** t * stirling(3, u, dc) * (2 * dc / 3) ** u
            for s in range(1, t + u + 1):
                weight[t, u, s] = seated * stirling(t + u, s, dw) * 0.05**s
    whole = sum(weight.values())
    random = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(104729)
    cells = np.tile([4, 3], (n, 1))
    by_context, tables = pitman_yor.sweep_words(cells, np.full(n, spelled), random, sample, params)
    for (t, u, s), w in weight.items():
        share = ((by_context == [t, u]).all(axis=1) & (tables == s)).mean()
        assert abs(share - w / whole) < 0.03, (t, u, s, share, w / whole)


def test_many_customers_have_more_tables():
    random = np.arange(1, 2001, dtype=np.uint64)
    few = pitman_yor.sample_tables(random, np.full(2000, 48), np.full(2000, 5.0), 0.5)
    many = pitman_yor.sample_tables(random, np.full(2000, 100_000), np.full(2000, 5.0), 0.5)
    assert (few >= 1).all() and (few <= 48).all() and many.mean() > few.mean() * 2
    none = pitman_yor.sample_tables(random[:3], np.array([0, 1, 2]), np.zeros(3), 0.5)
    assert none.tolist() == [0, 1, 1]


def test_spelling_probabilities_add_up_to_one():
    column = pa.array([b"abab", b"abc", b"", b"b"], pa.binary())
    params = PitmanYorParams(order=3)
    context, symbol, length, _ = pitman_yor._spelled(column, params.order)
    keys, index = np.unique((context << 9) | symbol, return_inverse=True)
    first = np.unique((context << 9) | symbol, return_index=True)[1]
    model = pitman_yor.seat_spelling(keys, length[first], 3 * np.bincount(index), params, seed=1)
    for i in range(len(symbol)):
        every = np.arange(257)
        p = model.probability(np.full(257, context[i]), every, np.full(257, length[i]))
        assert abs(p.sum() - 1) < 1e-5 and (p > 0).all()
    spelled = pitman_yor.spell(model, column, params.order)
    one_by_one = model.probability(context, symbol, length)
    assert np.allclose(spelled[0], np.log10(one_by_one[:5]).sum())


def test_pairs_handed_up_by_executors_or_by_seating_agree(docs, monkeypatch):
    learn = docs.select("text", F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)).alias("learn"))
    params = PitmanYorParams(**{**vars(SMALL), "order": 3, "min_share": 2e-3})
    counts = pitman_yor.word_counts(learn, pitman_yor.learn_contexts(learn, params))
    models = []
    for limit in (10**9, 0):
        monkeypatch.setattr(pitman_yor, "_COLLECTED_PAIRS", limit)
        leaves, _ = pitman_yor._seat_words(counts, None, params)
        models.append(pitman_yor.seat_spelling(*leaves, params, 1))
    for a, b in zip(models[0].pairs, models[1].pairs, strict=True):
        assert a.tolist() == b.tolist()
    for a, b in zip(models[0].share, models[1].share, strict=True):
        assert np.allclose(a, b)


def test_word_probabilities_add_up_to_at_most_one(docs):
    learn = docs.select("text", (F.col("doc_id") % 2 == 0).alias("learn"))
    model = pitman_yor.fit(learn.withColumn("learn", F.coalesce("learn", F.lit(False))), SMALL)
    values = model.values.collect()
    for k in range(SMALL.classes + 1):
        total = sum(
            r.p0 * model.rest[k] + (r.masses[r.contexts.index(k)] if k in r.contexts else 0) for r in values
        )
        assert 0 < total <= 1 + 1e-6


def test_contexts_follow_the_nearest_frequent_word():
    from gleaner.llm import words

    column = pa.array(["x the y z la w", "", "q"])
    w = words.split(column, lower=True)
    h = w.hashes()
    order = np.argsort(h[[1, 4]])
    contexts = pitman_yor.Contexts(h[[1, 4]][order], np.array([0, 1])[order], 2)
    assert contexts.of(w, h).tolist() == [2, 2, 0, 0, 0, 1, 2, 1, 2, 2]


def scored(docs, params=SMALL):
    marked = docs.select("doc_id", "text", (F.col("doc_id") % 5 != 1).alias("learn"))
    marked = marked.withColumn("learn", F.coalesce("learn", F.lit(False)))
    model = pitman_yor.fit(marked, params)
    return model, pitman_yor.score(marked, model, params)


def test_counts_and_base_score(docs, rows):
    model, out = scored(docs)
    counts = Counter()
    for r in rows:
        if r[0] is not None and r[0] % 5 != 1:
            counts.update(tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    assert (model.train_tokens, model.vocabulary) == (n, v)
    expected = Counter()
    for r in rows:
        own = tokens(r[1])
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        expected[(r[0], len(own), sum(counts[t] > 0 for t in own), round(base, 6))] += 1
    got = out.collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 and r.perplexity > 1 for r in got)


def test_joined_and_broadcast_values_agree(docs):
    model, few = scored(docs)
    joined = pitman_yor.score(docs.select("doc_id", "text"), model, PitmanYorParams(**{**vars(SMALL), "frequent_share": 2.0}))
    a = sorted((r.doc_id or -1, r.n_known, round(r.score, 3)) for r in few.collect())
    b = sorted((r.doc_id or -1, r.n_known, round(r.score, 3)) for r in joined.collect())
    assert a == b


def test_nothing_to_learn_from(docs, no_docs, rows):
    nothing = docs.select("doc_id", "text", F.lit(False).alias("learn"))
    out = pitman_yor.score(nothing, pitman_yor.fit(nothing, SMALL), SMALL).collect()
    assert len(out) == len(rows) and all(r.n_known == 0 and r.base_score == 0 for r in out)
    uniform = [r for r in out if r.n_tokens == 1]
    assert all(abs(r.score + math.log10(257)) < 1e-6 for r in uniform)
    empty = no_docs.select("doc_id", "text", F.lit(True).alias("learn"))
    assert pitman_yor.score(empty, pitman_yor.fit(empty, SMALL), SMALL).count() == 0


def test_held_out_texts_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    marked = docs.select("doc_id", "text", held_out.alias("held_out"), (~held_out).alias("learn"))
    model = pitman_yor.fit(marked)
    total = pitman_yor.score(marked, model).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > total[1]


def test_long_unseen_words_are_scored_by_all_their_bytes(spark):
    unseen = ["qzkv" * 100, "qzkv" * 1000, "qzkv" * 5000]
    rows = [(5 * i, "some words to learn from and some more words", True) for i in range(20)]
    rows += [(5 * i + 1, text, False) for i, text in enumerate(unseen)]
    table = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    model = pitman_yor.fit(table, SMALL)
    for share in (0.0, 1.0):  # values broadcast, and joined
        params = PitmanYorParams(**{**vars(SMALL), "frequent_share": share})
        found = pitman_yor.score(table.where("not learn"), model, params).orderBy("doc_id").collect()
        short, long, longest = (r.score for r in found)
        assert short < -400 and math.isfinite(longest)
        assert abs(long / short - 10) < 0.2 and abs(longest / long - 5) < 0.1


def test_frequent_words_are_exact_where_no_part_has_them_first(spark):
    """A word second to many others in both parts is the most frequent of all."""
    parts = [" ".join(f"{part}{i} " * 3 for i in range(40)) + " both" * 2 for part in "ab"]
    docs = spark.createDataFrame([(p, True) for p in parts], "text string, learn boolean").repartitionByRange(2, "text")
    found = pitman_yor._frequent_words(docs, PitmanYorParams(frequent_words=1))
    assert found.tolist() == pitman_yor.word_hashes(pa.array([b"both"])).tolist()


def test_rare_pairs_stay_in_their_context():
    """Of many characters, those of a context that is seen once teach that context."""
    text = pa.array([b"q" + bytes([65 + i % 26, 65 + i // 26 % 26]) for i in range(676)] + [b"xyz"], pa.binary())
    params = PitmanYorParams(order=2)
    context, symbol, length, word = pitman_yor._spelled(text, params.order)
    customers = np.where(word == 676, 1, 100_000)
    keys, index = np.unique((context << 9) | symbol, return_inverse=True)
    first = np.unique((context << 9) | symbol, return_index=True)[1]
    model = pitman_yor.seat_spelling(keys, length[first], np.bincount(index, weights=customers).astype(int), params, 1)
    assert customers.sum() > 5_000_000
    for n in range(1, params.order + 1):
        own = np.unique(np.concatenate([((context[length >= n] & ((1 << 9 * n) - 1)) << 9) | symbol[length >= n]]))
        assert model.pairs[n].tolist() == own.tolist()
    z = ord("x") << 9 | ord("y")
    assert model.probability(np.array([z]), np.array([ord("z")]), np.array([2]))[0] > 0.05


def test_spelling_seated_in_one_place_or_in_tasks_agree(docs, monkeypatch):
    marked = docs.select("doc_id", "text", F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)).alias("learn"))
    params = PitmanYorParams(**{**vars(SMALL), "order": 5})
    monkeypatch.setattr(pitman_yor, "_PART_WORDS", 40)
    monkeypatch.setattr(pitman_yor, "_SHELF_PAIRS", 50)
    found = []
    for limit in (10**9, 0):
        monkeypatch.setattr(pitman_yor, "_COLLECTED_PAIRS", limit)
        model = pitman_yor.fit(marked, params)
        found.append((model, {r.word_hash: r for r in model.values.collect()}))
    (one, together), (other, apart) = found
    assert together.keys() == apart.keys() and len(together) > 50
    assert np.allclose(one.rest, other.rest, rtol=1e-5)
    for key, r in together.items():
        assert (r.n, r.c, r.contexts) == (apart[key].n, apart[key].c, apart[key].contexts)
        assert abs(r.log_p0 - apart[key].log_p0) < 1e-4 * abs(r.log_p0)
        assert np.allclose(r.masses, apart[key].masses, rtol=1e-5)


def test_dishes_of_many_customers_count_in_the_likelihood():
    """Against every restaurant's seating weighed exactly, with 400 customers at one dish."""
    context, customers, tables = np.array([0, 0, 1]), np.array([400, 3, 5]), np.array([60, 1, 2])
    found = pitman_yor._odds(context, customers, tables, PitmanYorParams())
    expected = []
    for d in PitmanYorParams.discounts:
        row = np.array([1.0])
        scale, kept = 0.0, {}
        for c in range(400):
            t = np.arange(len(row))
            row = np.append(row * (c - d * t), 0.0) + np.append(0.0, row)
            row[0] = 0.0
            scale += math.log(row.sum())
            row /= row.sum()
            kept[c + 1] = np.log(np.maximum(row, 1e-300)) + scale
        log_s = sum(kept[c][t] for c, t in zip(customers, tables, strict=True))
        for s in PitmanYorParams.strengths:
            whole = log_s
            for c, t in ((403, 61), (5, 2)):
                whole += sum(math.log(s + d * i) for i in range(t)) - sum(math.log(s + i) for i in range(c))
            expected.append(whole)
    assert np.allclose(found, expected, atol=0.1)
    assert np.ptp(expected) > 10
