"""Toxic spans by a linear-chain conditional random field, and document scores from them.

Each word is tagged as toxic or not. A tag's weight depends on the word and its shape, and
on whether the word before is toxic too. With two tags the chain needs one number a word: the
log ratio of its messages, which ``chain`` passes forward and backward over whole texts.

Labels are of documents. The labelled tokens come from them: a word that stands in labelled
documents, in contexts that are nearly all of toxic ones, is tagged in these; every word of
the other documents is clean. Copies of a text give the same contexts and count once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words
from gleaner.session import staged

_SHAPES = 40
_BIAS, _PAIR, _START, _WORDS = 0, 1, 2, 3 + _SHAPES
_LENGTHS = np.array([2, 4, 7, 11])
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0") : ord("9") + 1] = True
#: Bytes that are no marks.
_INNER = _UPPER | _DIGIT
_INNER[ord("a") : ord("z") + 1] = True
_INNER[0x80:] = True
#: Log ratios beyond this are as good as certain.
_CERTAIN = 30.0
_TOLERANCE = 1e-9
#: A word with a lower log ratio passes on less than 1e-9.
_QUIET = -21.0
#: Bytes of one text handled together; longer texts pass their messages from stretch to stretch.
_STRETCH_BYTES = 1 << 20
_TOKENS_PER_TASK = 4e5
_DOCUMENTS_A_BLOCK = 128


@dataclass(frozen=True)
class CrfParams:
    """``max_documents`` bounds the labelled documents that a fit reads, on average.

    A word is evidence if the lower bound of its share of toxic contexts (Wilson, at
    ``deviations`` standard errors) is ``evidence_share``. ``min_contexts`` is what a word
    needs to have a weight of its own.
    """

    max_documents: int = 10_000
    min_contexts: int = 3
    evidence_share: float = 0.5
    deviations: float = 1.96
    ridge: float = 0.05
    steps: int = 40
    span_share: float = 0.5
    predicted_from: float = 0.7


@dataclass(frozen=True)
class CrfModel:
    """Hashes of known words in order, the weights, and the scale of document scores."""

    known: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    params: CrfParams
    only: float | None = None


@dataclass
class Tokens:
    """The words of some texts: hashes without case and outer marks, shapes, spans in bytes."""

    word: np.ndarray
    shape: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray

    def first(self) -> np.ndarray:
        """Whether each word begins its text."""
        return np.concatenate([[True], self.text[1:] != self.text[:-1]])[: len(self.text)]


def _outer(data: np.ndarray, at: np.ndarray, stop: np.ndarray, step: int) -> np.ndarray:
    """The first letter or digit of each word from one side, or ``stop`` if it has none."""
    at = at.copy()
    left = np.flatnonzero(~_INNER[data[at]]) if len(at) else np.empty(0, np.int64)
    for _ in range(8):
        if not len(left):
            return at
        at[left] += step
        left = left[at[left] != stop[left]]
        left = left[~_INNER[data[at[left]]]]
    # Long rows of marks are few: each is searched by itself.
    for word in left:
        a, b = sorted((int(at[word]), int(stop[word])))
        found = np.flatnonzero(_INNER[data[a if step > 0 else a + 1 : b if step > 0 else b + 1]])
        at[word] = stop[word] if not len(found) else a + found[0] if step > 0 else a + 1 + found[-1]
    return at


def tokens(column: pa.Array) -> Tokens:
    """The words of every text; null counts as empty.

    For the hash, A-Z and the capitals of Latin-1 (two bytes, the first 0xC3) are lower-cased
    and marks at the ends of a word are left out. A word's shape is its length without them
    and whether it has two capitals, a digit, or marks at its end.
    """
    split = words.split(column, lower=False)
    data, start, end = split.data, split.start, split.end
    lowered = words.lower(data)
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    lowered[second] += 32
    inner_start = _outer(data, start, end, 1)
    inner_end = np.maximum(_outer(data, end - 1, start - 1, -1) + 1, inner_start)
    inner_end = np.where(inner_start < end, inner_end, inner_start)
    word = words.rolling(words.byte_values(lowered), inner_start, inner_end)
    digits, uppers = (
        np.bincount(np.searchsorted(start, np.flatnonzero(kind[data]), side="right") - 1, minlength=len(start))
        for kind in (_DIGIT, _UPPER)
    )
    shape = np.searchsorted(_LENGTHS, inner_end - inner_start, side="right")
    shape = shape * 2 + (uppers > 1)
    shape = shape * 2 + (digits > 0)
    shape = shape * 2 + (inner_end < end)
    return Tokens(word, shape.astype(np.int8), start, end, split.text)


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def _passed(x: np.ndarray, pair: float) -> np.ndarray:
    """What a neighbour's log ratio adds to a word's own: from 0 to the weight of a pair."""
    return np.log1p(np.expm1(pair) / (1 + np.exp(-np.clip(x, -_CERTAIN, _CERTAIN))))


def chain(own: np.ndarray, first: np.ndarray, pair: float, before: float | None = None) -> np.ndarray:
    """Forward log ratios of toxic to clean: ``own`` plus what the word before passes on.

    ``first`` marks the words without one; ``before`` is that of the word ahead of all. The
    recursion is solved by repeated passes over the words whose neighbour still changed. A
    pass shrinks changes by tanh(|pair| / 4) at least, so few are needed, and never more than
    there are words.
    """
    if not len(own):
        return own.copy()
    free = ~first
    free[0] = False
    at = own.copy()
    if before is not None:
        at[0] += _passed(np.array([before]), pair)[0]
    # The first pass takes all words at once, the next ones those behind a change that matters.
    given = at[:-1].copy()
    at[1:] += np.where(free[1:], _passed(given, pair), 0.0)
    open_ = np.flatnonzero(np.abs(at[:-1] - given) * (given + abs(pair) > _QUIET)) + 1
    open_ = open_[free[open_]]
    while len(open_):
        new = own[open_] + _passed(at[open_ - 1], pair)
        changed = open_[np.abs(new - at[open_]) > _TOLERANCE] + 1
        at[open_] = new
        changed = changed[changed < len(own)]
        open_ = changed[free[changed]]
    return at


def backward(own: np.ndarray, last: np.ndarray, pair: float, after: float | None = None) -> np.ndarray:
    """Backward log ratios: what the words behind each one pass on to it."""
    back = chain(own[::-1], last[::-1], pair, after)[::-1]
    out = np.zeros(len(own))
    if len(own):
        out[:-1] = np.where(last[:-1], 0.0, _passed(back[1:], pair))
        if after is not None:
            out[-1] = _passed(np.array([after]), pair)[0]
    return out


def _lasts(first: np.ndarray) -> np.ndarray:
    return np.concatenate([first[1:], [True]])[: len(first)]


def own_weights(weights: np.ndarray, word: np.ndarray, shape: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The log ratio that each word has by itself."""
    own = weights[_BIAS] + weights[_WORDS + word] + weights[3 + shape]
    return own + weights[_START] * first


def likelihood(
    weights: np.ndarray, word: np.ndarray, shape: np.ndarray, first: np.ndarray, tag: np.ndarray
) -> tuple[float, np.ndarray]:
    """Log likelihood of tags and its gradient, by the forward-backward messages."""
    gradient = np.zeros(len(weights))
    if not len(word):
        return 0.0, gradient
    pair = weights[_PAIR]
    own = own_weights(weights, word, shape, first)
    last = _lasts(first)
    ahead = chain(own, first, pair)
    behind = backward(own, last, pair)
    rest = tag - 1 / (1 + np.exp(-np.clip(ahead + behind, -_CERTAIN, _CERTAIN)))
    inner = np.flatnonzero(~first)
    left, right = ahead[inner - 1], own[inner] + behind[inner]
    # The share of both words being toxic, of the four ways to tag a pair.
    top = np.maximum(np.maximum(0, left), np.maximum(right, left + right + pair))
    both = np.exp(left + right + pair - top)
    share = both / (both + np.exp(-top) + np.exp(left - top) + np.exp(right - top))
    pairs = (tag[inner - 1] * tag[inner]).astype(float)
    gradient[_BIAS] = rest.sum()
    gradient[_PAIR] = (pairs - share).sum()
    gradient[_START] = rest[first].sum()
    gradient[3:_WORDS] = np.bincount(shape, weights=rest, minlength=_SHAPES)
    gradient[_WORDS:] = np.bincount(word, weights=rest, minlength=len(weights) - _WORDS)
    value = (own * tag).sum() + pair * pairs.sum() - _softplus(ahead).sum()
    return float(value), gradient


def ascend(
    objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, memory: int = 8
) -> np.ndarray:
    """Maximise a smooth concave function by limited-memory quasi-Newton steps."""
    at, (value, slope) = start, objective(start)
    history: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        direction, used = slope.copy(), []
        for moved, turned, rho in reversed(history):
            a = rho * moved @ direction
            direction -= a * turned
            used.append(a)
        if history:
            moved, turned, _ = history[-1]
            direction *= (moved @ turned) / (turned @ turned)
        else:
            direction /= max(1.0, np.linalg.norm(slope))
        for (moved, turned, rho), a in zip(history, reversed(used), strict=True):
            direction += (a - rho * turned @ direction) * moved
        rise, length = slope @ direction, 1.0
        if rise <= 0:
            direction, rise, history = slope, slope @ slope, []
        while True:
            following = at + length * direction
            new_value, new_slope = objective(following)
            if new_value >= value + 1e-4 * length * rise or length < 1e-6:
                break
            length /= 4
        moved, turned = following - at, slope - new_slope
        gain = new_value - value
        if gain > 0:
            at, value, slope = following, new_value, new_slope
        if moved @ turned > 1e-12:
            history = [*history[-memory + 1 :], (moved, turned, 1 / (moved @ turned))]
        if gain <= 1e-3 * max(1.0, abs(value)):
            break
    return at


def _tokenised(labelled: DataFrame, text: str, label: str) -> DataFrame:
    """(label, word, shape) of every labelled document, as arrays in the order of the text."""

    def compute(column: pa.Array) -> list:
        found = tokens(column)
        sizes = np.bincount(found.text, minlength=len(column))
        return [
            words.lists(found.word.view(np.int64), sizes, pa.int64()),
            words.lists(found.shape, sizes, pa.int8()),
        ]

    rows = labelled.select(F.col(label).cast("int").alias("label"), F.col(text).alias("text"))
    return words.with_columns(rows, "text", {"word": "array<long>", "shape": "array<tinyint>"}, compute, keep=["label"])


def _contexts(documents: DataFrame) -> DataFrame:
    """(word, toxic, clean): the number of distinct contexts of each word by label.

    A document gives one context a word, the neighbours with the least hash. Tasks fold the
    words of a document before anything is shuffled.
    """
    schema = pa.schema([("word", pa.int64()), ("context", pa.int64()), ("label", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("word")
            sizes = lists.value_lengths().to_numpy()
            word = lists.flatten().to_numpy().view(np.uint64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            edge = np.zeros(1, np.uint64)
            left, right = np.concatenate([edge, word])[:-1], np.concatenate([word, edge])[1:]
            inside = np.concatenate([[False], doc[1:] == doc[:-1]])[: len(doc)]
            left = np.where(inside, left, np.uint64(0))
            right = np.where(np.concatenate([inside[1:], [False]])[: len(doc)], right, np.uint64(0))
            context = words.mix64(words.mix64(left) + np.uint64(3) * right)
            order = np.lexsort((context, word, doc))
            d, w = doc[order], word[order]
            lead = np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])])[: len(d)]
            chosen = order[lead]
            label = batch.column("label").to_numpy()[doc[chosen]]
            yield words.record(schema, word[chosen].view(np.int64), context[chosen].view(np.int64), label)

    found = documents.mapInArrow(run, "word long, context long, label int").distinct()
    return found.groupBy("word").agg(
        F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean")
    )


def _vocabulary(documents: DataFrame, params: CrfParams) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with a weight of their own, in order, and which are evidence.

    Words that toxic documents lack need no weight: they weigh as unknown ones. The number
    of words is bounded by the labelled documents that are read.
    """
    n = F.col("toxic") + F.col("clean")
    share = F.col("toxic") / n
    z2 = params.deviations**2
    spread = F.sqrt(share * (1 - share) / n + F.lit(z2) / (4 * n * n))
    least = (share + F.lit(z2) / (2 * n) - F.lit(params.deviations) * spread) / (1 + F.lit(z2) / n)
    found = (
        _contexts(documents)
        .where((F.col("toxic") > 0) & (n >= params.min_contexts))
        .select("word", (least >= params.evidence_share).alias("evident"))
        .toPandas()
    )
    word = found["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(word)
    return word[order], found["evident"].to_numpy().astype(bool)[order]


def _ids(known: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Places of words among the known ones; unknown words share the place after the last."""
    if not len(known):
        return np.zeros(len(word), dtype=np.int64)
    place = np.minimum(np.searchsorted(known, word), len(known) - 1)
    return np.where(known[place] == word, place, len(known))


def _sequences(documents: DataFrame, known: np.ndarray, evident: np.ndarray) -> DataFrame:
    """Blocks of tagged documents: places of words, shapes, first words and tags as bytes.

    A toxic document without any word of evidence says of no token what it is, and is left out.
    """
    shared = documents.sparkSession.sparkContext.broadcast((known, np.append(evident, False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, evident = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _DOCUMENTS_A_BLOCK):
                part = batch.slice(at, _DOCUMENTS_A_BLOCK)
                lists = part.column("word")
                sizes = lists.value_lengths().to_numpy()
                word = _ids(known, lists.flatten().to_numpy().view(np.uint64)).astype(np.int32)
                shape = part.column("shape").flatten().to_numpy()
                doc = np.repeat(np.arange(len(sizes)), sizes)
                label = part.column("label").to_numpy()
                tag = evident[word] & (label[doc] == 1)
                told = (label == 0) | (np.bincount(doc, weights=tag, minlength=len(sizes)) > 0)
                first = np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)]
                use = told[doc]
                columns = [x[use].tobytes() for x in (word, shape, first, tag)]
                counts = pa.array([int(use.sum())]), pa.array([int(tag[use].sum())])
                yield pa.RecordBatch.from_arrays(
                    [*counts, *(pa.array([c], pa.binary()) for c in columns)],
                    names=["n", "n_toxic", "word", "shape", "first", "tag"],
                )

    return documents.mapInArrow(run, "n long, n_toxic long, word binary, shape binary, first binary, tag binary")


def _objective(sequences: DataFrame, size: int, ridge: float) -> Callable:
    """The penalised log likelihood over the executors: a row for each task comes back."""

    def evaluate(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value, gradient = 0.0, np.zeros(size)
            for batch in batches:
                for block in batch.select(["word", "shape", "first", "tag"]).to_pylist():
                    v, g = likelihood(
                        weights,
                        np.frombuffer(block["word"], np.int32),
                        np.frombuffer(block["shape"], np.int8),
                        np.frombuffer(block["first"], bool),
                        np.frombuffer(block["tag"], bool).astype(float),
                    )
                    value, gradient = value + v, gradient + g
            yield pa.RecordBatch.from_arrays(
                [pa.array([value]), pa.array([gradient.tobytes()], pa.binary())], names=["value", "gradient"]
            )

        parts = sequences.mapInArrow(run, "value double, gradient binary").collect()
        penalised = weights.copy()
        penalised[_BIAS] = 0.0
        value = sum(p["value"] for p in parts) - ridge / 2 * (penalised @ penalised)
        gradient = sum((np.frombuffer(p["gradient"]) for p in parts), np.zeros(size))
        return value, gradient - ridge * penalised

    return evaluate


def _scale(evidence: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression of labels on the documents' evidence, slightly shrunk."""
    x = np.column_stack([np.ones(len(evidence)), evidence])
    penalty = np.diag([1e-6, 1e-2, 1e-2])
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -_CERTAIN, _CERTAIN)))
        slope = x.T @ (label - p) - penalty @ weights
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, slope)
        weights = weights + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(labelled: DataFrame, key: str, text: str, label: str, params: CrfParams | None = None) -> CrfModel:
    """Fit on documents with labels 0 and 1; other labels, nulls among them, are left out.

    At most ``max_documents`` documents are read on average, drawn by a hash of ``key``. With
    labels of one class only, every score is that class; without any it is 0.5.
    """
    params = params or CrfParams()
    rows = labelled.where(F.col(label).isin(0, 1))
    counts = dict(rows.groupBy(F.col(label).cast("int")).count().collect())
    size = sum(counts.values())
    if len(counts) < 2:
        only = float(next(iter(counts), 0.5))
        return CrfModel(np.empty(0, np.uint64), np.zeros(_WORDS + 1), np.zeros(3), params, only)
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    documents = staged(_tokenised(rows.where(draw < params.max_documents / size), text, label), "labelled_tokens")
    known, evident = _vocabulary(documents, params)
    sequences = staged(_sequences(documents, known, evident), "tagged_tokens")
    told = sequences.agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("toxic")).first()
    weights = np.zeros(_WORDS + len(known) + 1)
    if told.n:
        weights[_BIAS] = np.log((told.toxic + 0.5) / (told.n - told.toxic + 0.5))
        weights[_WORDS : _WORDS + len(known)][evident] = -weights[_BIAS]
        together = sequences.repartition(math.ceil(told.n / _TOKENS_PER_TASK)).cache()
        weights = ascend(_objective(together, len(weights), params.ridge), weights, params.steps)
        together.unpersist()
    draft = CrfModel(known, weights, np.zeros(3), params)
    shared = labelled.sparkSession.sparkContext.broadcast(draft)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("word")
            sizes = lists.value_lengths().to_numpy()
            text = np.repeat(np.arange(len(sizes)), sizes)
            word = lists.flatten().to_numpy().view(np.uint64)
            found = Tokens(word, batch.column("shape").flatten().to_numpy(), text, text, text)
            evidence = _evidence(toxicity(shared.value, found), text, len(sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(evidence[:, 0]), pa.array(evidence[:, 1])],
                names=["label", "most", "expected"],
            )

    # Two numbers a document of the bounded sample.
    seen = documents.mapInArrow(weigh, "label int, most double, expected double").toPandas()
    scale = np.zeros(3)
    if len(seen):
        scale = _scale(seen[["most", "expected"]].to_numpy(), seen["label"].to_numpy())
    return CrfModel(known, weights, scale, params)


def toxicity(model: CrfModel, found: Tokens) -> np.ndarray:
    """The log ratio of toxic to clean for every word, given its whole text."""
    first = found.first()
    own = own_weights(model.weights, _ids(model.known, found.word), found.shape, first)
    pair = model.weights[_PAIR]
    return chain(own, first, pair) + backward(own, _lasts(first), pair)


def _evidence(ratio: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each text the largest log ratio of a word and the log of the expected toxic words."""
    most = np.full(n, -_CERTAIN)
    sizes = np.bincount(text, minlength=n)
    filled = np.flatnonzero(sizes)
    ratio = np.clip(ratio, -_CERTAIN, _CERTAIN)
    if len(filled):
        most[filled] = np.maximum.reduceat(ratio, (np.cumsum(sizes) - sizes)[filled])
    expected = np.bincount(text, weights=1 / (1 + np.exp(-ratio)), minlength=n)
    return np.column_stack([np.clip(most, -12, 12), np.log(expected + 1e-3)])


def _spans(ratio: np.ndarray, found: Tokens, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last word of the longest runs of words at or above a log ratio."""
    toxic = ratio >= limit
    follows = np.concatenate([[False], toxic[:-1] & (found.text[1:] == found.text[:-1])])[: len(toxic)]
    starts = np.flatnonzero(toxic & ~follows)
    ends = np.flatnonzero(toxic & ~np.concatenate([(toxic & follows)[1:], [False]])[: len(toxic)])
    return found.text[starts], starts, ends


def _stretches(data: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Cuts of one text into pieces of some ``limit`` bytes, never inside a word."""
    blank = ~words.word_bytes(data)
    cuts, at = [], 0
    while at < len(data):
        end = min(at + limit, len(data))
        if end < len(data):
            gaps = np.flatnonzero(blank[at + 1 : end])
            # A word longer than the limit stays whole.
            if len(gaps):
                end = at + 1 + int(gaps[-1])
            else:
                later = np.flatnonzero(blank[end:])
                end = end + int(later[0]) if len(later) else len(data)
        cuts.append((at, end))
        at = end
    return cuts


def _long_text(model: CrfModel, data: np.ndarray, limit: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Evidence and spans (bytes) of one text, a stretch at a time.

    Messages cross the cuts, so the result is that of the whole text; a first pass keeps the
    forward message at every cut, a second goes back over the stretches.
    """
    pair = model.weights[_PAIR]
    cuts = _stretches(data, limit)

    def stretch(a: int, b: int, opening: bool) -> tuple[Tokens, np.ndarray, np.ndarray]:
        found = tokens(pa.array([data[a:b].tobytes()], pa.binary()))
        first = np.zeros(len(found.word), dtype=bool)
        first[:1] = opening
        return found, first, own_weights(model.weights, _ids(model.known, found.word), found.shape, first)

    arriving, message = [], None
    for a, b in cuts:
        arriving.append(message)
        found, first, own = stretch(a, b, message is None)
        if len(own):
            message = float(chain(own, first, pair, message)[-1])
    most, expected, after = -_CERTAIN, 0.0, None
    limit_ratio = np.log(model.params.span_share / (1 - model.params.span_share))
    spans: list[tuple[int, int]] = []
    follower_toxic = False
    for (a, b), message in zip(reversed(cuts), reversed(arriving), strict=True):
        found, first, own = stretch(a, b, message is None)
        if not len(own):
            continue
        last = np.zeros(len(own), dtype=bool)
        last[-1] = after is None
        ratio = chain(own, first, pair, message) + backward(own, last, pair, after)
        after = float(chain(own[::-1], last[::-1], pair, after)[-1])
        clipped = np.clip(ratio, -_CERTAIN, _CERTAIN)
        most = max(most, float(clipped.max()))
        expected += float((1 / (1 + np.exp(-clipped))).sum())
        _, starts, ends = _spans(ratio, found, limit_ratio)
        own_spans = [(a + int(found.start[s]), a + int(found.end[e])) for s, e in zip(starts, ends, strict=True)]
        if own_spans and spans and follower_toxic and ends[-1] == len(own) - 1:
            own_spans[-1] = (own_spans[-1][0], spans.pop(0)[1])
        spans = own_spans + spans
        follower_toxic = bool(len(starts)) and starts[0] == 0
    return np.array([np.clip(most, -12, 12), np.log(expected + 1e-3)]), spans


def score_texts(
    model: CrfModel, column: pa.Array, stretch: int = _STRETCH_BYTES
) -> tuple[np.ndarray, list[list[dict]]]:
    """Score and toxic spans (offsets in characters) of each text; see ``predict``."""
    n = len(column)
    data, offsets = words.utf8(column)
    spans: list[list[dict]] = [[] for _ in range(n)]
    if model.only is not None:
        return np.full(n, model.only), spans
    limit = np.log(model.params.span_share / (1 - model.params.span_share))
    if n == 1 and len(data) > stretch:
        evidence, found_spans = _long_text(model, data, stretch)
        evidence, places = evidence[None, :], [(0, a, b) for a, b in found_spans]
    else:
        found = tokens(column)
        ratio = toxicity(model, found)
        evidence = _evidence(ratio, found.text, n)
        text, starts, ends = _spans(ratio, found, limit)
        places = [(int(t), int(found.start[s]), int(found.end[e])) for t, s, e in zip(text, starts, ends, strict=True)]
    if places:
        characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
        for t, a, b in places:
            base = characters[offsets[t]]
            spans[t].append({"start": int(characters[a] - base), "end": int(characters[b] - base)})
    x = model.scale[0] + evidence @ model.scale[1:]
    return 1 / (1 + np.exp(-np.clip(x, -_CERTAIN, _CERTAIN))), spans


def predict(docs: DataFrame, model: CrfModel, text: str = "text") -> DataFrame:
    """Replaces the text by ``score`` (0 to 1), ``predicted`` and ``spans``.

    The score is calibrated on the largest marginal of a word and the expected number of toxic
    words; an empty or null text has the score of no evidence at all. ``predicted`` is 1 from
    ``predicted_from`` on. ``spans`` has the start and end, in characters, of the longest runs
    of words whose marginal is ``span_share`` or more. Existing columns with these names are
    replaced. A text longer than a megabyte is handled in stretches that pass messages on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def compute(column: pa.Array) -> list:
        scores, spans = score_texts(shared.value, column)
        predicted = (scores >= shared.value.params.predicted_from).astype(np.int32)
        return [pa.array(scores), pa.array(predicted), pa.array(spans, kind)]

    fields = {"score": "double", "predicted": "int", "spans": "array<struct<start: bigint, end: bigint>>"}
    keep = [c for c in docs.columns if c.lower() != text.lower() and c.lower() not in fields]
    return words.with_columns(docs, text, fields, compute, keep=keep)
