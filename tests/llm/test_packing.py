import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleaner.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def bins(patterns):
    return sum(times for _, times in patterns)


def optimum(items, capacity):
    """The least number of bins, by trying everything."""
    best = [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= items[i] and room not in rooms[:k]:
                place(i + 1, [*rooms[:k], room - items[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_the_optimum(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(12, 40))
    items = np.sort(rng.integers(2, capacity + 1, size=9))[::-1]
    counts = np.bincount(items, minlength=capacity + 1)
    fixed, rest = packing.reduce_instance(counts, capacity)
    left = [length for length in range(capacity, 0, -1) for _ in range(int(rest[length]))]
    assert bins(fixed) + optimum(left, capacity) == optimum(items.tolist(), capacity)


def test_reduction_goes_on_below_a_length_without_a_dominating_set():
    counts = np.zeros(101, dtype=np.int64)
    # Three tiny pieces fit with 90, and 4 + 5 fills more than any single one.
    counts[[90, 60, 40, 1, 4, 5]] = [1, 2, 2, 3, 1, 1]
    assert packing._dominating(packing._Histogram(counts), 100, 90) is None
    fixed, rest = packing.reduce_instance(counts, 100)
    assert ((60, 40), 2) in fixed
    assert rest[90] == 1 and rest[60] == rest[40] == 0


@pytest.mark.parametrize("seed", range(40))
def test_reduction_past_tiny_pieces_keeps_the_optimum(seed):
    rng = np.random.default_rng(1000 + seed)
    items = np.concatenate([rng.integers(1, 4, 3), rng.integers(4, 31, 6)])
    counts = np.bincount(items, minlength=31)
    fixed, rest = packing.reduce_instance(counts, 30)
    left = np.repeat(np.arange(31), rest).tolist()
    assert bins(fixed) + optimum(left[::-1], 30) == optimum(sorted(items.tolist(), reverse=True), 30)


@pytest.mark.parametrize("seed", range(20))
def test_patterns_hold_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = 100
    counts = rng.integers(0, 400, size=capacity + 1) * (rng.random(capacity + 1) < 0.4)
    counts[0] = 0
    patterns = packing.plan_patterns(counts, capacity)
    total = np.zeros(capacity + 1, dtype=np.int64)
    for pattern, times in patterns:
        assert times > 0 and sum(pattern) <= capacity
        for length in pattern:
            total[length] += times
    assert (total == counts).all()
    assert bins(patterns) <= bins(packing.best_fit(counts, capacity))


@pytest.mark.parametrize("text", [
    "it's don't 'S x's", "a.b,c!!! 12,34 $5 é… «é» é. क़, naïve!!", "<|endoftext|>. A<|startoftext|>b <|ENDOFTEXT|>",
    "ΣΑΣ, ß. İ. ﬁ, x y \x1cz", "日本語。 日本, क़ क़a", "a" * 300 + ".", "", " \n",
])
def test_words_encode_like_texts(text):
    encoder = packing.Encoder(PATH)
    got = np.frombuffer(encoder.ids([text.encode()])[0], dtype="<u4").tolist()
    assert got == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_cache_turns_over(monkeypatch):
    monkeypatch.setattr(packing, "_CACHED_WORDS", 10)
    encoder, whole = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    for i in range(0, 200, 7):
        text = " ".join(f"word{j % 40} the$$$ it's" for j in range(i, i + 30))
        got = np.frombuffer(encoder.ids([text.encode()])[0], dtype="<u4").tolist()
        assert got == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_places(docs, rows, capacity):
    got = packing.pack(docs, packing.PackingParams(PATH, capacity=capacity)).collect()
    whole = Tokenizer.from_file(PATH)
    expected = []
    for r in rows:
        ids = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k in range(0, len(ids), capacity):
            piece = ids[k : k + capacity]
            expected.append((r[0], k // capacity, k, len(piece), zlib.crc32(piece.tobytes())))
    key = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(expected, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_empty_table(no_docs):
    assert packing.pack(no_docs, packing.PackingParams(PATH)).count() == 0
