"""Language identification by a bit-sliced Bloom filter over character n-grams.

One lookup of an n-gram gives a bitmask of all languages whose filter holds it: slot ``i``
of the table carries bit ``i`` of every language's Bloom filter, and an n-gram's mask is the
AND over its slots. A text's score per language is the popcount of its n-grams' masks,
corrected for the false positives that the language's fill predicts.

N-grams run over lower-cased letters inside a word, with a mark on either side of the word.
A language holds an n-gram that it uses at least ``min_ratio`` times as often (per n-gram)
as the language which uses it most, and at least ``min_count`` times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words
from gleaner.session import staged

UNDETERMINED = "und"
_FLUSH = 1 << 20
_SLICE_BYTES = 1 << 19


@dataclass(frozen=True)
class LanguageIdParams:
    """``slots`` is the least size of the broadcast table, 8 bytes a slot for each 64 languages.

    It is doubled until no language is expected to fill more than half of it.
    """

    orders: tuple[int, ...] = (3, 4)
    slots: int = 1 << 22
    hashes: int = 3
    min_ratio: float = 0.4
    min_count: int = 2


@dataclass(frozen=True)
class LanguageFilter:
    """A fitted filter: ``table[slot, word]`` holds the bits of 64 languages each."""

    params: LanguageIdParams
    languages: tuple[str, ...]
    table: np.ndarray
    false_positive: np.ndarray


@cache
def _letters() -> np.ndarray:
    """For each code point its lower case, 0 if it is no letter."""
    every = map(chr, range(0x110000))
    lower = (ord(c.lower()[0]) if c.isalpha() else 0 for c in every)
    return np.fromiter(lower, dtype=np.uint32, count=0x110000)


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, other characters as 0, texts set apart by a 0."""
    data, offsets = words.utf8(column)
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    text = np.repeat(np.arange(len(column)), np.diff(begins))
    codes = codes[: len(text)]
    padded = np.zeros(len(codes) + len(column) + 1, dtype=np.uint32)
    padded[np.arange(len(codes)) + text + 1] = _letters()[codes]
    owner = np.zeros(len(padded), dtype=np.int32)
    owner[np.arange(len(codes)) + text + 1] = text
    return padded, owner


def n_grams(column: pa.Array, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every n-gram: a mark may stand at its ends, not inside."""
    symbols, owner = _symbols(column)
    hashes, owners = [], []
    for n in orders:
        if len(symbols) < n:
            continue
        columns = [symbols[k : len(symbols) - n + 1 + k] for k in range(n)]
        valid = np.ones(len(columns[0]), dtype=bool)
        for k in range(1, n - 1):
            valid &= columns[k] != 0
        if n == 1:
            valid = columns[0] != 0
        elif n == 2:
            valid = (columns[0] != 0) | (columns[1] != 0)
        at = np.flatnonzero(valid)
        value = np.full(len(at), n, dtype=np.uint64)
        for c in columns:
            value = value * np.uint64(0x100000001B3) + c[at]
            value ^= value >> np.uint64(29)
        hashes.append(words.mix64(value))
        # The first letter is at the front or just behind the mark.
        owners.append(owner[np.where(columns[0][at] != 0, at, at + 1)])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    return np.concatenate(hashes), np.concatenate(owners)


def _counts(df: DataFrame, orders: tuple[int, ...]) -> DataFrame:
    """(lang, gram, n): uses of every n-gram by language, folded inside the tasks."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def flush(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, (gram, n) in held.items():
            yield words.record(schema, pa.array([lang] * len(gram)), gram.view(np.int64), n)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part in words.slices(batches, "text", _SLICE_BYTES):
            gram, text = n_grams(part.column("text"), orders)
            coded = part.column("lang").dictionary_encode()
            lang_of = coded.indices.to_numpy()
            for code, lang in enumerate(coded.dictionary.to_pylist()):
                g, n = np.unique(gram[lang_of[text] == code], return_counts=True)
                if lang in held:
                    merged = np.concatenate([held[lang][0], g])
                    weight = np.concatenate([held[lang][1], n])
                    g, index = np.unique(merged, return_inverse=True)
                    n = np.bincount(index, weights=weight).astype(np.int64)
                held[lang] = (g, n)
            if sum(len(g) for g, _ in held.values()) > _FLUSH:
                yield from flush(held)
        yield from flush(held)

    return words.in_batches(df, run, "lang string, gram long, n long")


def _slot(gram: np.ndarray, k: int, params: LanguageIdParams) -> np.ndarray:
    """The ``k``-th slot of every n-gram."""
    width = params.slots.bit_length() - 1
    if width * params.hashes <= 66:
        mixed = gram >> np.uint64(min(width * k, 63 - width))
    else:  # The bits of one hash would overlap too much.
        mixed = words.mix64(gram + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return (mixed & np.uint64(params.slots - 1)).astype(np.int64)


def _slots_for(n_grams: int, params: LanguageIdParams) -> int:
    """The least doubling of ``slots`` that ``n_grams`` fill to one half at most."""
    slots = params.slots
    while params.hashes * n_grams > math.log(2) * slots:
        slots *= 2
    return slots


def fit(train: DataFrame, params: LanguageIdParams | None = None) -> LanguageFilter:
    """Fit on all rows with ``text`` and ``lang``; rows with a null in either are left out.

    What reaches the driver is a row per language and a mask per filled slot; the number of
    slots follows the most n-grams that a language holds.
    """
    params = params or LanguageIdParams()
    known = train.select("text", "lang").where("text is not null and lang is not null")
    counts = _counts(known, params.orders).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = staged(counts, "gram_counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()
    totals = sorted(((r["lang"], r["total"]) for r in totals), key=lambda x: (-x[1], x[0]))
    languages = tuple(lang for lang, _ in totals)
    n_words = max(1, -(-len(languages) // 64))
    table = np.zeros((params.slots, n_words), dtype=np.uint64)
    if languages:
        spark = train.sparkSession
        index = spark.createDataFrame(
            [(lang, float(total), i // 64, i % 64) for i, (lang, total) in enumerate(totals)],
            "lang string, total double, word int, bit int",
        )
        share = F.col("n") / F.col("total")
        rows = counts.join(index, "lang").withColumn("share", share)
        top = F.max("share")
        members = F.collect_list(F.struct("share", "n", "word", "bit"))
        bits = (
            rows.groupBy("gram")
            .agg(top.alias("top"), members.alias("members"))
            .select("gram", "top", F.explode("members").alias("m"))
            .where((F.col("m.share") >= params.min_ratio * F.col("top")))
            .where(F.col("m.n") >= params.min_count)
            .select("gram", "m.word", F.expr("shiftleft(1L, m.bit)").alias("mask"))
        )
        bits = staged(bits, "gram_languages")
        learned = [r["count"] for r in bits.groupBy("word", "mask").count().collect()]
        params = replace(params, slots=_slots_for(max(learned, default=0), params))
        table = np.zeros((params.slots, n_words), dtype=np.uint64)
        schema = pa.schema([("slot", pa.int64()), ("word", pa.int32()), ("mask", pa.int64())])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gram = batch.column("gram").to_numpy().view(np.uint64)
                for k in range(params.hashes):
                    yield words.record(schema, _slot(gram, k, params), batch.column("word"), batch.column("mask"))

        filled = (
            bits.mapInArrow(words.giving_back(place), "slot long, word int, mask long")
            .groupBy("slot", "word")
            .agg(F.bit_or("mask").alias("mask"))
            .toPandas()
        )
        table[filled["slot"].to_numpy(), filled["word"].to_numpy()] = (
            filled["mask"].to_numpy().astype(np.int64).view(np.uint64)
        )
    fill = np.array(
        [np.mean((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))]
    )
    return LanguageFilter(params, languages, table, fill**params.hashes)


def _masks(model: LanguageFilter, gram: np.ndarray) -> np.ndarray:
    """For each n-gram the languages that contain it, as 64-bit words."""
    signed = gram.view(np.uint64)
    mask = None
    for k in range(model.params.hashes):
        found = model.table[_slot(signed, k, model.params)]
        mask = found if mask is None else mask & found
    return mask


def predict_texts(model: LanguageFilter, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; see ``predict``."""
    n_texts = len(column)
    gram, text = n_grams(column, model.params.orders)
    total = np.bincount(text, minlength=n_texts).astype(float)
    if not model.languages or not n_texts:
        return [UNDETERMINED] * n_texts, np.zeros(n_texts)
    masks = _masks(model, gram)
    corrected = np.empty((n_texts, len(model.languages)))
    for i, false_positive in enumerate(model.false_positive):
        bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        hits = np.bincount(text, weights=bit.astype(float), minlength=n_texts)
        corrected[:, i] = (hits - total * false_positive) / max(1 - false_positive, 1e-9)
    best = corrected.argmax(axis=1)
    share = corrected[np.arange(n_texts), best] / np.maximum(total, 1)
    names = [model.languages[b] if n else UNDETERMINED for b, n in zip(best, total, strict=True)]
    return names, np.where(total > 0, np.clip(share, 0, 1), 0.0)


def detected(docs: DataFrame, model: LanguageFilter, name: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``name`` of ``lang_pred`` and ``score``; see ``predict``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(column: pa.Array) -> list:
        names, scores = predict_texts(shared.value, column)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return words.described(docs, text, name, {"lang_pred": "string", "score": "double"}, compute, _SLICE_BYTES)


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` from the whole text of each row.

    ``score`` is the share of the text's n-grams that the predicted language contains, after
    the correction, within [0, 1]. Texts that are null or have no letter get ``und`` and 0,
    as does every text if nothing was learned. Ties go to the language with more training
    text, then by name. Existing columns with these two names are replaced.
    """
    clean = docs.drop("lang_pred", "score")
    name = words.free_name([*clean.columns, "lang_pred", "score"], "found")
    found = detected(clean, model, name, text)
    return found.withColumns({c: F.col(f"{name}.{c}") for c in ("lang_pred", "score")}).drop(name)
