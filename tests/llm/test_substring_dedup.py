import random

import pytest

from gleaner.llm import substring_dedup
from gleaner.llm.substring_dedup import SubstringParams, SuffixAutomaton


def brute(texts, length):
    words = [(t or "").encode().split() for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((len(w), len(gone), kept))
    return out


def results(frame):
    return [(r.n_words, r.n_removed, r.kept_text) for r in frame.orderBy("doc_id").collect()]


def test_automaton_counts_occurrences():
    rng = random.Random(2)
    references = [[rng.choice("ab") for _ in range(rng.randint(1, 12))] for _ in range(15)]
    times = [rng.randint(1, 3) for _ in references]
    automaton = SuffixAutomaton()
    for reference, n in zip(references, times, strict=True):
        automaton.add(reference, n)
    automaton.close()
    for least in (1, 3, 5):
        stream = [rng.choice("abc") for _ in range(200)]
        for i, (matched, n) in enumerate(automaton.statistics(stream, least)):
            if matched >= least:
                window = stream[i - least + 1 : i + 1]
                count = sum(
                    k * sum(r[j : j + least] == window for j in range(len(r) - least + 1))
                    for r, k in zip(references, times, strict=True)
                )
                assert n == count
            else:
                window = stream[max(0, i - least + 1) : i + 1]
                assert len(window) < least or not any(
                    r[j : j + least] == window for r in references for j in range(len(r))
                )


@pytest.mark.parametrize("params", [
    SubstringParams(length=35),
    SubstringParams(length=6, anchor=2, bitmap_bits=6, shard_words=20),
    SubstringParams(length=5, anchor=5),
])
def test_equals_brute_force(spark, params):
    """Few bits let nearly everything through the bitmaps: the automata decide alone."""
    rng = random.Random(params.length)
    words = [f"w{i}" for i in range(200)]
    passages = [[rng.choice(words) for _ in range(params.length + rng.randint(-1, 12))] for _ in range(6)]
    texts = []
    for i in range(80):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [rng.choice(words) for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.6:
                passage = list(rng.choice(passages))
                if rng.random() < 0.4:
                    passage[rng.randrange(len(passage))] = f"mutant{i}"
                text += passage
        texts.append("\n ".join(text))
    texts += [texts[1], texts[2] + " end", "a " * 90, None, "", "A b"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = results(substring_dedup.remove_repeats(table, params=params))
    assert got == brute(texts, params.length)
    assert sum(n for _, n, _ in got) > 300


def test_awkward_rows(docs, rows, no_docs):
    got = substring_dedup.remove_repeats(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    expected = [(r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], 35), strict=True)]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=key) == sorted(expected, key=key)
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(docs, params=SubstringParams(length=100, anchor=8))
