"""Language-model scores from a hierarchical Pitman-Yor model sampled by Gibbs.

A word's context is the class of the nearest earlier word that is among the most frequent
ones; classes gather frequent words that follow each other. All context restaurants share one
parent, the restaurant of words without context. Its base spells words: again a hierarchy of
restaurants, one for each context of up to ``order`` characters before a character inside the
word. A context's parent is the context without its first character, so contexts with the
same end share parents up to the empty one, whose base is uniform over bytes and the end of a
word. Every table of a restaurant is a customer of its parent.

A sweep resamples the number of tables of every dish from its conditional given all others:
``p(t) ~ S(c, t) a**t`` for ``c`` customers, with generalised Stirling numbers ``S`` and
``a`` = (strength + discount * tables) * parent probability. Beyond ``EXACT`` customers the
rest are seated in growing blocks. Word seats are sampled in the tasks that hold the words:
sweeps over a word's contexts and their parent, under the sums over all words of the pass
before. Spelling contexts of ``_SPREAD`` and more characters are seated in the tasks that hold
all with the same end, under the shorter ones as the driver seated them in the sweep before.
The predictive probabilities of several samples are averaged.

A text is its words and one end token (spelled as the empty word), so the probability of
texts adds up to one, unseen words included.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words
from gleaner.session import staged

EXACT = 48
#: Dishes are seated together by these numbers of customers.
_WIDTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, EXACT)
END = 256
_START = 257
_BITS = 9
_SYMBOLS = 257
_FLUSH = 1 << 20
#: Pairs that the driver takes as they are; more are first handed up by the executors.
_COLLECTED_PAIRS = 300_000
_HELD_WORDS = 1 << 20
#: Words that are seated together.
_SEATED_WORDS = 50_000
#: Restaurants of contexts with fewer characters are seated on the driver.
_SPREAD = 3
#: Pairs of longer contexts that a task seats together, about.
_SHELF_PAIRS = 200_000
#: Words that ask together for the probabilities of their characters, about.
_PART_WORDS = 100_000
#: A leaf is a pair with the length of its context in the bits from here on.
_LENGTH_AT = 54


@dataclass(frozen=True)
class PitmanYorParams:
    """Model and size parameters.

    All (context, character) pairs are seated. A ``min_share`` above 0 bounds the spelling
    model instead: a pair with a smaller share of the characters has its customers in the
    parent, so an order holds at most ``1 / min_share`` pairs. The discount and strength of every order are sampled from
    ``discounts`` and ``strengths``; those of the words are given. ``frequent_share`` bounds the broadcast word values likewise;
    all other words get theirs by a join.
    """

    order: int = 5
    frequent_words: int = 256
    classes: int = 16
    class_discount: float = 0.7
    word_discount: float = 0.75
    class_strength: float = 1.0
    word_strength: float = 1.0
    discounts: tuple[float, ...] = (0.05, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9)
    strengths: tuple[float, ...] = (0.1, 0.5, 2.0, 8.0, 32.0, 128.0)
    sweeps: int = 4
    word_sweeps: int = 4
    samples: int = 2
    min_share: float = 0.0
    frequent_share: float = 2e-6
    seed: int = 7


@cache
def _log_stirling(discount: float) -> np.ndarray:
    """log S(c, t) for c, t up to EXACT."""
    table = np.full((EXACT + 1, EXACT + 1), -np.inf)
    table[0, 0] = 0.0
    for c in range(EXACT):
        t = np.arange(EXACT + 1)
        stay = table[c] + np.log(np.maximum(c - discount * t, 1e-300))
        new = np.concatenate([[-np.inf], table[c, :-1]])
        table[c + 1] = np.logaddexp(np.where(t <= c, stay, -np.inf), new)
    table[1:, 0] = -np.inf
    return table


def _log_stirling_beyond(discount: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log S(c, t) for many customers, by the saddle point of its generating function.

    ``S(c, t) / c!`` is the coefficient of ``x**c`` in ``f(x)**t / t!`` where ``f(x)`` is
    ``(1 - (1 - x)**discount) / discount``. For few tables, and for nearly as many as customers,
    the saddle point is off by what Stirling's formula is for a factorial; that is taken out.
    """
    rest = 1 - discount
    # ``low`` and ``high`` bound log(1 - x).
    low, high = np.full(len(c), -40.0), np.full(len(c), -1e-14)
    with np.errstate(all="ignore"):
        for step in range(51):
            u = (low + high) / 2
            v, x, q = np.exp(u), -np.expm1(u), -np.expm1(discount * u)
            ratio = x * discount * np.exp(-rest * u) / q
            if step < 50:
                beyond = (t - 1) * ratio + rest * x / v > c - 1
                low, high = np.where(beyond, u, low), np.where(beyond, high, u)
        spread = (t - 1) * ratio * (1 + rest * x / v - ratio) + rest * x / v**2
        height = (t - 1) * (np.log(q) - math.log(discount)) - rest * u - (c - 1) * np.log(x)
        log_s = _log_gamma(c) - _log_gamma(t) + height - np.log(2 * math.pi * spread) / 2
        log_s -= _stirling_error((c - 1) ** 2 / spread) + _stirling_error(np.maximum(c - t, 1))
    return np.where(c == t, 0.0, log_s)


def _stirling_error(a: np.ndarray) -> np.ndarray:
    """log gamma(a) less Stirling's formula for it."""
    return _log_gamma(a) - ((a - 0.5) * np.log(a) - a + math.log(2 * math.pi) / 2)


def sample_tables(
    random: np.ndarray,
    customers: np.ndarray,
    mass: np.ndarray,
    discount: float,
    further: tuple[np.ndarray, np.ndarray] | None = None,
) -> np.ndarray:
    """Tables for each dish given its customers and ``a``; ``random`` seeds each dish.

    Without ``further`` every table weighs ``mass``. With it (unit, count) only the first
    does, and the one after ``i`` tables weighs ``unit * (count + i)``: the parent's dish has
    ``i`` customers more by then.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    stirling = _log_stirling(discount)
    uniform = (words.mix64(random) >> np.uint64(11)).astype(float) / (1 << 53)
    first = np.minimum(customers, EXACT)
    log_mass = np.log(np.maximum(mass, 1e-300))
    order = np.argsort(first, kind="stable")
    ends = np.searchsorted(first[order], np.arange(EXACT + 2))
    least = 2
    for c in _WIDTHS:
        # Dishes of up to ``c`` customers together: more tables than customers weigh nothing.
        own = order[ends[least] : ends[c + 1]]
        least = c + 1
        if not len(own):
            continue
        for part in np.array_split(own, max(1, len(own) * c // (1 << 20))):
            t = np.arange(1, c + 1)
            seats = stirling[first[part], 1 : c + 1]
            if further is None:
                weight = seats + log_mass[part, None] * t
            else:
                unit, count = (x[part, None] for x in further)
                rising = np.cumsum(np.log(np.maximum(unit * (count + t[:-1]), 1e-300)), axis=1)
                weight = seats + log_mass[part, None] + np.pad(rising, ((0, 0), (1, 0)))
            weight = np.exp(weight - weight.max(axis=1, keepdims=True))
            total = np.cumsum(weight, axis=1)
            tables[part] = 1 + (total < (uniform[part] * total[:, -1])[:, None]).sum(axis=1)
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        seated = np.full(len(many), float(EXACT))
        t, a, c = tables[many].astype(float), mass[many], customers[many].astype(float)
        salt = random[many]
        while True:
            block = np.minimum(np.ceil(seated / 4), c - seated)
            if not (block > 0).any():
                break
            if further is not None:
                a = further[0][many] * (further[1][many] + t)
            expected = block * a / (seated + block / 2 - discount * t + a)
            salt = words.mix64(salt + np.uint64(1))
            u = (salt >> np.uint64(11)).astype(float) / (1 << 53)
            t += np.minimum(_poisson(u, expected), block)
            seated += block
        tables[many] = t.astype(np.int64)
    return tables


def _poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson draws from uniforms: by inversion for small means, rounded normals beyond."""
    out = np.zeros(len(mean))
    small = mean < 30
    left = np.where(small, u, 0.0)
    term = np.exp(-np.minimum(mean, 30))
    k = 0
    live = small & (left > term)
    while live.any() and k < 200:
        left[live] -= term[live]
        k += 1
        term = term * mean / k
        out[live] = k
        live = live & (left > term)
    if (~small).any():
        centred = np.log(np.clip(u, 1e-12, 1 - 1e-12) / np.clip(1 - u, 1e-12, 1)) / 1.702
        out[~small] = np.maximum(0, np.round(mean + centred * np.sqrt(mean)))[~small]
    return out


@dataclass(frozen=True)
class SpellingModel:
    """For each order sorted (context, character) keys with their share, and back-off masses.

    ``share`` is (c - discount * t) / (strength + C) of a pair, ``rest`` is
    (strength + discount * T) / (strength + C) of a context.
    """

    pairs: tuple[np.ndarray, ...]
    share: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    rest: tuple[np.ndarray, ...]

    def probability(self, context: np.ndarray, symbol: np.ndarray, order: np.ndarray) -> np.ndarray:
        """P(symbol | context) where ``order`` is the length of each (packed) context."""
        p = np.full(len(symbol), 1.0 / _SYMBOLS)
        for n in range(len(self.pairs)):
            if not len(self.contexts[n]):
                continue
            known = np.flatnonzero(order >= n)
            own = context[known] & ((1 << (_BITS * n)) - 1)
            at = np.minimum(np.searchsorted(self.contexts[n], own), len(self.contexts[n]) - 1)
            hit = self.contexts[n][at] == own
            rest = np.where(hit, self.rest[n][at], 1.0)
            key = (own << _BITS) | symbol[known]
            place = np.minimum(np.searchsorted(self.pairs[n], key), len(self.pairs[n]) - 1)
            share = np.where(self.pairs[n][place] == key, self.share[n][place], 0.0)
            p[known] = share + rest * p[known]
        return p


def _empty_spelling(order: int) -> SpellingModel:
    none = tuple(np.empty(0, np.int64) for _ in range(order + 1))
    zero = tuple(np.empty(0) for _ in range(order + 1))
    return SpellingModel(none, zero, none, zero)


def _spelled(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context, symbol, context length and word number of every character of the words.

    A context is packed with the nearest symbol in the lowest bits; the start of the word
    counts as a symbol, and contexts do not go beyond it.
    """
    data, offsets = words.utf8(column)
    n_words = len(column)
    sizes = np.diff(offsets)
    line = np.full(len(data) + 2 * n_words, END, dtype=np.int64)
    starts = offsets[:-1] + 2 * np.arange(n_words)
    line[starts] = _START
    word = np.repeat(np.arange(n_words), sizes + 1)
    inside = np.ones(len(line), dtype=bool)
    inside[starts] = False
    ends = starts + sizes + 1
    letters = inside.copy()
    letters[ends] = False
    line[letters] = data
    at = np.flatnonzero(inside)
    before = at - starts[word]
    length = np.minimum(before, order)
    context = np.zeros(len(at), dtype=np.int64)
    for k in range(order):
        use = length > k
        context[use] |= line[at[use] - 1 - k] << (_BITS * k)
    return context, line[at], length, word


def spell(model: SpellingModel, column: pa.Array, order: int) -> np.ndarray:
    """The log10 probability that the spelling model gives to each word."""
    context, symbol, length, word = _spelled(column, order)
    key = (context << _BITS) | symbol
    # Equal characters in equal contexts are looked up once; lengths differ with the context.
    distinct, first, index = np.unique(key, return_index=True, return_inverse=True)
    p = model.probability(distinct >> _BITS, distinct & ((1 << _BITS) - 1), length[first])
    return np.bincount(word, weights=np.log10(p)[index], minlength=len(column))


def _without_own(
    own: np.ndarray,
    customers: np.ndarray,
    tables: np.ndarray,
    all_customers: np.ndarray,
    all_tables: np.ndarray,
    below: np.ndarray | float,
    discount: float,
    strength: float,
) -> np.ndarray:
    """A parent's predictive probability of a dish without the tables that ask for it."""
    left = customers - own
    left_tables = np.minimum(tables, left)
    rest = strength + discount * (all_tables - tables + left_tables)
    return (left - discount * left_tables + rest * below) / (strength + all_customers - own)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    distinct, index = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in distinct.tolist()])[index]


def _grid(params: PitmanYorParams) -> list[tuple[float, float]]:
    """The discounts and strengths that an order may have."""
    return [(d, s) for d in params.discounts for s in params.strengths]


def _odds(context: np.ndarray, customers: np.ndarray, tables: np.ndarray, params: PitmanYorParams) -> np.ndarray:
    """The log likelihood of restaurants' seating under each discount and strength."""
    if not len(context):
        return np.zeros(len(_grid(params)))
    # A restaurant and a dish count as often as their (customers, tables) occur.
    all_seats = np.stack([np.bincount(context, weights=customers), np.bincount(context, weights=tables)])
    seats, times = np.unique(all_seats, axis=1, return_counts=True)
    dishes, dish_times = np.unique(np.stack([customers, tables]), axis=1, return_counts=True)
    exact = dishes[0] <= EXACT
    odds = []
    for d in params.discounts:
        kinds = (_log_stirling(d)[dishes[0][exact], dishes[1][exact]] * dish_times[exact]).sum()
        kinds += (_log_stirling_beyond(d, *dishes[:, ~exact].astype(float)) * dish_times[~exact]).sum()
        for s in params.strengths:
            log_tables = seats[1] * math.log(d) + _log_gamma(s / d + seats[1]) - math.lgamma(s / d)
            log_seats = _log_gamma(s + seats[0]) - math.lgamma(s)
            odds.append(kinds + ((log_tables - log_seats) * times).sum())
    return np.array(odds)


@dataclass(frozen=True)
class _Above:
    """What longer contexts see of the pairs of the longest contexts on the driver.

    ``below`` is the probability that a pair's own parent gives it.
    """

    keys: np.ndarray
    customers: np.ndarray
    tables: np.ndarray
    all_customers: np.ndarray
    all_tables: np.ndarray
    p: np.ndarray
    below: np.ndarray


class _Seating:
    """The restaurants of contexts of ``first`` to ``last`` characters, with one table a dish.

    ``keys`` are the sorted pairs of each order, ``own`` their customers that do not come from
    longer contexts and ``asked`` whether they were given. Pairs with less than ``least``
    customers of their own have these in the parent, from the longest context down. A pair
    stays, as a place for its children's tables, if any of them does.
    """

    def __init__(
        self, first: int, last: int, pairs: np.ndarray, lengths: np.ndarray, customers: np.ndarray, least: float = 0
    ) -> None:
        self.first, self.levels = first, range(first, last + 1)
        self.keys, self.own, self.asked = {}, {}, {}
        for n in self.levels:
            given = lengths == n
            self.keys[n], index = np.unique(pairs[given], return_inverse=True)
            weights = customers[given]
            self.own[n] = np.bincount(index, weights=weights, minlength=len(self.keys[n])).astype(np.int64)
            self.asked[n] = np.ones(len(self.keys[n]), dtype=bool)
        needed = np.empty(0, np.int64)
        for n in reversed(self.levels[1:]):
            parent = _parents(self.keys[n], n)
            enough = self.own[n] >= least
            stay = enough | np.isin(self.keys[n], needed)
            asked = np.append(self.asked[n - 1], np.zeros(len(parent), dtype=bool))
            moved = np.concatenate([self.own[n - 1], np.where(enough, 0, self.own[n])])
            self.keys[n - 1], index = np.unique(np.concatenate([self.keys[n - 1], parent]), return_inverse=True)
            size = len(self.keys[n - 1])
            self.own[n - 1] = np.bincount(index, weights=moved, minlength=size).astype(np.int64)
            self.asked[n - 1] = np.bincount(index, weights=asked, minlength=size) > 0
            self.keys[n], self.own[n] = self.keys[n][stay], np.where(enough, self.own[n], 0)[stay]
            self.asked[n] = self.asked[n][stay]
            needed = np.unique(parent[stay])
        self.tables = {n: np.zeros(len(self.keys[n]), dtype=np.int64) for n in self.levels}
        self._place()

    def _place(self) -> None:
        """Finds every pair's parent and numbers the contexts."""
        self.parents, self.context = {}, {}
        for n in self.levels:
            if n > self.first:
                self.parents[n] = np.searchsorted(self.keys[n - 1], _parents(self.keys[n], n))
            new = np.diff(self.keys[n] >> _BITS, prepend=-1) != 0
            self.context[n] = np.cumsum(new) - 1
        self.guests = np.int64(0)
        self._count()

    def packed(self) -> bytes:
        """All that a later pass needs."""
        return zlib.compress(pickle.dumps((self.first, self.levels, self.keys, self.own, self.asked, self.tables)), 1)

    @staticmethod
    def unpacked(data: bytes) -> _Seating:
        seating = _Seating.__new__(_Seating)
        (seating.first, seating.levels, seating.keys, seating.own, seating.asked, seating.tables) = pickle.loads(
            zlib.decompress(data)
        )
        seating._place()
        return seating

    def _count(self) -> None:
        """Customers of all pairs, with the tables of longer contexts among them."""
        self.customers = {n: self.own[n].copy() for n in self.levels}
        if len(self.levels):
            self.customers[self.levels[-1]] += self.guests
        for n in reversed(self.levels):
            # Tables below may have left dishes with fewer customers than they had tables.
            customers = self.customers[n]
            self.tables[n] = np.clip(self.tables[n], np.minimum(customers, 1), customers)
            if n > self.first:
                asking = np.bincount(self.parents[n], weights=self.tables[n], minlength=len(self.keys[n - 1]))
                self.customers[n - 1] += asking.astype(np.int64)

    def welcome(self, pairs: np.ndarray, tables: np.ndarray) -> None:
        """Seats the tables of contexts longer than all here as customers."""
        last = self.levels[-1]
        self.guests = np.zeros(len(self.keys[last]), dtype=np.int64)
        self.guests[np.searchsorted(self.keys[last], pairs)] = tables
        self._count()

    def asking(self) -> tuple[np.ndarray, np.ndarray]:
        """The parents' pairs of the shortest contexts, and the tables that ask for them."""
        if not len(self.levels):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs, index = np.unique(_parents(self.keys[self.first], self.first), return_inverse=True)
        return pairs, np.bincount(index, weights=self.tables[self.first], minlength=len(pairs)).astype(np.int64)

    def odds(self, params: PitmanYorParams) -> np.ndarray:
        """The log likelihoods of each order's seating, one row an order."""
        rows = [_odds(self.context[n], self.customers[n], self.tables[n], params) for n in self.levels]
        return np.reshape(rows, (len(self.levels), len(_grid(params))))

    def _summed(self, n: int, values: np.ndarray) -> np.ndarray:
        """Sums over a pair's restaurant, for every pair."""
        return np.bincount(self.context[n], weights=values)[self.context[n]]

    def shares(self, hyper: list, above: _Above | None) -> tuple[dict, dict, dict]:
        """Shares, back-off masses and probabilities of all pairs."""
        share, rest, p = {}, {}, {}
        for n in self.levels:
            discount, strength = hyper[n]
            everyone = strength + self._summed(n, self.customers[n])
            rest[n] = (strength + discount * self._summed(n, self.tables[n])) / everyone
            share[n] = (self.customers[n] - discount * self.tables[n]) / everyone
            p[n] = share[n] + rest[n] * self._below(n, p, above)
        return share, rest, p

    def _below(self, n: int, p: dict, above: _Above | None) -> np.ndarray:
        """The probability that a pair's parent gives it."""
        if n > self.first:
            return p[n - 1][self.parents[n]]
        if n:
            return above.p[np.searchsorted(above.keys, _parents(self.keys[n], n))]
        return np.full(len(self.keys[n]), 1.0 / _SYMBOLS)

    def above(self, hyper: list) -> _Above:
        """What longer contexts see of these."""
        n = self.levels[-1]
        _, _, p = self.shares(hyper, None)
        customers, tables = self.customers[n], self.tables[n]
        sums = self._summed(n, customers), self._summed(n, tables)
        return _Above(self.keys[n], customers, tables, *sums, p[n], self._below(n, p, None))

    def sweep(self, hyper: list, above: _Above | None, salt: int) -> None:
        """Draws the tables of all orders anew, longest contexts first."""
        asked = self.tables[self.first].copy() if len(self.levels) else None
        for n in reversed(self.levels):
            discount, strength = hyper[n]
            self._count()
            _, _, p = self.shares(hyper, above)
            if n > self.first:
                up = self.parents[n]
                customers, tables = self.customers[n - 1], self.tables[n - 1]
                sums = self._summed(n - 1, customers), self._summed(n - 1, tables)
                seen = (customers, tables, *sums, self._below(n - 1, p, above))
                below = _without_own(self.tables[n], *(x[up] for x in seen), *hyper[n - 1])
            elif n:
                up = np.searchsorted(above.keys, _parents(self.keys[n], n))
                seen = (above.customers, above.tables, above.all_customers, above.all_tables, above.below)
                # They were counted when the sweep began.
                below = _without_own(asked, *(x[up] for x in seen), *hyper[n - 1])
            else:
                below = np.full(len(self.keys[n]), 1.0 / _SYMBOLS)
            others = self._summed(n, self.tables[n]) - self.tables[n]
            mass = (strength + discount * others) * below
            draws = words.mix64(self.keys[n].astype(np.uint64) + np.uint64(salt + n))
            self.tables[n] = sample_tables(draws, self.customers[n], mass, discount)
        self._count()


def _parents(keys: np.ndarray, n: int) -> np.ndarray:
    """The pairs that contexts of ``n`` characters back off to."""
    return ((keys >> _BITS) & ((1 << (_BITS * (n - 1))) - 1)) << _BITS | (keys & ((1 << _BITS) - 1))


def _swept(
    lower: _Seating, started: tuple, longer: Callable, params: PitmanYorParams, seed: int
) -> tuple[list, _Above]:
    """Gibbs sweeps: discounts and strengths of all orders, then their tables, longest first.

    ``longer`` sweeps over the contexts that are not in ``lower`` and gives, as ``started``
    does, (pairs, tables) that ask for pairs in ``lower`` and the likelihoods of their seating.
    """
    random = np.random.default_rng(seed)
    grid = _grid(params)
    (pairs, tables), odds = started
    lower.welcome(pairs, tables)
    hyper: list = []
    for sweep in range(params.sweeps):
        hyper = []
        for log_p in np.vstack([lower.odds(params), odds]):
            weight = np.exp(log_p - log_p.max())
            hyper.append(grid[int(random.choice(len(grid), p=weight / weight.sum()))])
        salt = seed * 1000 + sweep * 16
        (pairs, tables), odds = longer(hyper, lower.above(hyper), salt)
        lower.welcome(pairs, tables)
        lower.sweep(hyper, None, salt)
    hyper = hyper or [(0.5, 1.0)] * (params.order + 1)
    return hyper, lower.above(hyper)


def seat_spelling(
    pairs: np.ndarray, lengths: np.ndarray, customers: np.ndarray, params: PitmanYorParams, seed: int
) -> SpellingModel:
    """Gibbs sweeps over the seating of all context restaurants, in one place.

    ``pairs`` are packed (context, character) keys of the leaves with their customers.
    """
    least = params.min_share * max(1, int(customers.sum()))
    whole = _Seating(0, params.order, pairs, lengths, customers, least)
    flat = [np.concatenate([whole.keys[n] for n in whole.levels])]
    flat.append(np.repeat(whole.levels, [len(whole.keys[n]) for n in whole.levels]))
    flat.append(np.concatenate([whole.own[n] for n in whole.levels]))
    split = min(_SPREAD, params.order + 1)
    lower = _Seating(0, split - 1, *flat)
    upper = _Seating(split, params.order, *flat)

    def longer(hyper: list, above: _Above, salt: int) -> tuple:
        upper.sweep(hyper, above, salt)
        return upper.asking(), upper.odds(params)

    hyper, above = _swept(lower, (upper.asking(), upper.odds(params)), longer, params, seed)
    keys, shares, contexts, rests = [], [], [], []
    for seating, over in ((lower, None), (upper, above)):
        share, rest, _ = seating.shares(hyper, over)
        for n in seating.levels:
            own, first = np.unique(seating.keys[n] >> _BITS, return_index=True)
            keys.append(seating.keys[n])
            shares.append(share[n].astype(np.float32))
            contexts.append(own)
            rests.append(rest[n][first].astype(np.float32))
    return SpellingModel(tuple(keys), tuple(shares), tuple(contexts), tuple(rests))


def _spread_spelling(asked: DataFrame, params: PitmanYorParams, seed: int) -> DataFrame:
    """Staged (leaf, log_p): :func:`seat_spelling` in many tasks, and what it gives to the leaves.

    ``asked`` has (leaf, customers). Contexts of ``_SPREAD`` and more characters are seated
    with all that end in the same ``_SPREAD`` ones; only pairs of shorter contexts come to the
    driver, of which there are at most ``257 ** _SPREAD``.
    """
    spark = asked.sparkSession
    split = min(_SPREAD, params.order + 1)
    folded = staged(asked.groupBy("leaf").agg(F.sum("customers").alias("customers")), "spelling-pairs")
    is_long = F.col("leaf") >= split << _LENGTH_AT
    few = folded.where(~is_long).toArrow()
    leaves, customers = few["leaf"].to_numpy(), few["customers"].to_numpy()
    n_shelves = max(spark.sparkContext.defaultParallelism, -(-folded.where(is_long).count() // _SHELF_PAIRS))
    suffix = F.shiftright("leaf", _BITS).bitwiseAND((1 << (_BITS * split)) - 1)
    shelved = folded.where(is_long).withColumn("shelf", F.pmod(F.xxhash64(suffix), F.lit(n_shelves)))
    schema = pa.schema(
        [
            ("shelf", pa.binary()),
            ("odds", pa.list_(pa.float64())),
            ("pairs", pa.list_(pa.int64())),
            ("tables", pa.list_(pa.int64())),
        ]
    )
    ddl = "shelf binary, odds array<double>, pairs array<long>, tables array<long>"

    def described(seating: _Seating) -> pa.RecordBatch:
        lists = (seating.odds(params).ravel(), *seating.asking())
        columns = [words.lists(x, [len(x)], f.type.value_type) for x, f in zip(lists, list(schema)[1:], strict=True)]
        return words.record(schema, [seating.packed()], *columns)

    def start(rows: pa.Table) -> pa.Table:
        leaf = rows["leaf"].to_numpy()
        own = leaf & ((1 << _LENGTH_AT) - 1), leaf >> _LENGTH_AT, rows["customers"].to_numpy()
        return pa.Table.from_batches([described(_Seating(split, params.order, *own))])

    def read(shelves: DataFrame) -> tuple:
        """What the driver needs of all shelves."""
        zipped = shelves.select(F.explode(F.arrays_zip("pairs", "tables")).alias("t"))
        sums = zipped.groupBy("t.pairs").agg(F.sum("t.tables").alias("tables")).toArrow()
        rows = shelves.select(F.posexplode("odds")).groupBy("pos").agg(F.sum("col").alias("odds")).orderBy("pos").collect()
        odds = np.array([r["odds"] for r in rows]).reshape(-1, len(_grid(params)))
        odds = odds if len(odds) else np.zeros((params.order + 1 - split, len(_grid(params))))
        return (sums["pairs"].to_numpy(), sums["tables"].to_numpy()), odds

    def longer(hyper: list, above: _Above, salt: int) -> tuple:
        nonlocal shelves
        shared = spark.sparkContext.broadcast((hyper, above))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shelf in batch.column("shelf"):
                    seating = _Seating.unpacked(shelf.as_py())
                    seating.sweep(*shared.value, salt)
                    yield described(seating)

        shelves = staged(words.in_batches(shelves.select("shelf"), run, ddl), "spelling-shelves")
        shared.destroy()
        return read(shelves)

    started = shelved.repartition(n_shelves, "shelf").groupBy("shelf").applyInArrow(start, ddl)
    shelves = staged(started, "spelling-shelves")
    (pairs, tables), odds = read(shelves)
    # The pairs that longer contexts ask for are there without customers of their own.
    lower = _Seating(
        0,
        split - 1,
        np.concatenate([leaves & ((1 << _LENGTH_AT) - 1), pairs]),
        np.concatenate([leaves >> _LENGTH_AT, np.full(len(pairs), split - 1)]),
        np.concatenate([customers, np.zeros(len(pairs), np.int64)]),
    )
    hyper, above = _swept(lower, ((pairs, tables), odds), longer, params, seed)
    answer = pa.schema([("leaf", pa.int64()), ("log_p", pa.float64())])

    def answers(seating: _Seating, over: _Above | None) -> Iterator[pa.RecordBatch]:
        _, _, p = seating.shares(hyper, over)
        for n in seating.levels:
            own = seating.asked[n]
            yield words.record(answer, seating.keys[n][own] | (n << _LENGTH_AT), np.log10(p[n][own]))

    shared = spark.sparkContext.broadcast(above)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shelf in batch.column("shelf"):
                yield from answers(_Seating.unpacked(shelf.as_py()), shared.value)

    long = words.in_batches(shelves.select("shelf"), run, "leaf long, log_p double")
    short = spark.createDataFrame(pa.Table.from_batches(list(answers(lower, None)), answer))
    spelled = staged(long.unionByName(short), "spelled-pairs")
    shared.destroy()
    return spelled


@dataclass(frozen=True)
class Sample:
    """One sample of the seating: the spelling model and the totals it was drawn under.

    ``class_tables`` and ``word_tables`` count tables. Without a spelling model the words come
    with their spelling probabilities.
    """

    number: int
    spelling: SpellingModel | None
    class_tables: np.ndarray
    word_tables: int


@dataclass(frozen=True)
class Contexts:
    """Hashes of the most frequent words, sorted, and the class of each."""

    hashes: np.ndarray
    classes: np.ndarray
    n_classes: int

    def of(self, w: words.Words, hashes: np.ndarray) -> np.ndarray:
        """The context of every word, and of every text's end token behind them.

        A text begins in the context ``n_classes``.
        """
        before = np.full(len(hashes), -1, dtype=np.int64)
        firsts = w.firsts()
        kind = np.full(len(hashes), -1, dtype=np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            kind = np.where(self.hashes[at] == hashes, self.classes[at], -1)
        last = np.maximum.accumulate(np.where(kind >= 0, np.arange(len(hashes)), -1)) if len(hashes) else kind
        before[1:] = last[:-1]
        own = np.where(before >= firsts[w.text], kind[before], self.n_classes)
        final = np.full(w.n_texts, self.n_classes, dtype=np.int64)
        some = np.flatnonzero(np.diff(firsts))
        ends = last[firsts[some + 1] - 1]
        final[some] = np.where(ends >= firsts[some], kind[ends], self.n_classes)
        return np.concatenate([own, final])


def _offers(docs: DataFrame, most: int | None) -> DataFrame:
    """(word_hash, n, missing): uses of words in stretches of the texts to learn from.

    Each stretch counts all its words and offers the ``most`` frequent (None: all);
    ``missing`` is the largest count it does not offer, told once more beside a null word.
    """
    schema = pa.schema([("word_hash", pa.int64()), ("n", pa.int64()), ("missing", pa.int64())])

    def folded(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, index = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        weights = np.concatenate([n for _, n in held])
        return keys, np.bincount(index, weights=weights, minlength=len(keys)).astype(np.int64)

    def offer(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        top = np.argsort(-counts, kind="stable")
        left = top[most : most + 1] if most is not None else top[:0]
        missing = int(counts[left[0]]) if len(left) else 0
        top = top[:most]
        hashes = pa.array([*keys[top].view(np.int64).tolist(), None], pa.int64())
        return words.record(schema, hashes, np.append(counts[top], 0), np.full(len(top) + 1, missing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for part in words.slices(batches, "text"):
            found = words.split(part.column("text"), lower=True).hashes()
            held.append(np.unique(found, return_counts=True))
            size += len(held[-1][0])
            if size > _FLUSH:
                held = [folded(held)]
                size = len(held[0][0])
                if size > _FLUSH // 2:
                    yield offer(*held[0])
                    held, size = [], 0
        if held:
            yield offer(*folded(held))

    return docs.where("learn").select("text").mapInArrow(run, "word_hash long, n long, missing long")


def _frequent_words(docs: DataFrame, params: PitmanYorParams) -> np.ndarray:
    """Sorted hashes of the most frequent words, exactly; of equal counts the smaller hash.

    Stretches of the texts offer their own most frequent words, with a bound on the others'
    counts. Where these bounds cannot rule out every other word, all words are counted.
    """
    most = 16 * params.frequent_words
    offered = _offers(docs, most).groupBy("word_hash").agg(F.sum("n").alias("n"), F.sum("missing").alias("known"))
    offered = staged(offered, "frequent-words")
    # What all stretches may hide, and of a word those that did not offer it.
    hidden = (offered.where("word_hash is null").agg(F.sum("known")).first()[0]) or 0
    found = offered.where("word_hash is not null").withColumn("more", F.lit(hidden) - F.col("known"))
    rows = found.orderBy(F.desc("n"), "word_hash").limit(params.frequent_words).collect()
    chosen = [r["word_hash"] for r in rows]
    if hidden:
        least = min((r["n"] for r in rows), default=0)
        rival = (F.col("more") > 0) & (F.col("n") + F.col("more") >= least) & ~F.col("word_hash").isin(chosen)
        if hidden >= least or not found.where(rival).isEmpty():
            counted = _offers(docs, None).where("word_hash is not null").groupBy("word_hash").agg(F.sum("n").alias("n"))
            rows = counted.orderBy(F.desc("n"), "word_hash").limit(params.frequent_words).collect()
            chosen = [r["word_hash"] for r in rows]
    return np.sort(np.array(chosen, dtype=np.int64).view(np.uint64))


def learn_contexts(docs: DataFrame, params: PitmanYorParams) -> Contexts:
    """Classes of frequent words by what frequent word comes next before and after them."""
    hashes = _frequent_words(docs, params)
    n = len(hashes)
    if not n:
        return Contexts(hashes, np.empty(0, np.int64), params.classes)
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follows = np.zeros(n * n, dtype=np.int64)
        for part in words.slices(batches, "text"):
            w = words.split(part.column("text"), lower=True)
            h = w.hashes()
            at = np.minimum(np.searchsorted(hashes, h), n - 1)
            known = hashes[at] == h
            at, text = at[known], w.text[known]
            same = text[1:] == text[:-1]
            follows += np.bincount(at[:-1][same] * n + at[1:][same], minlength=n * n)
        cells = np.flatnonzero(follows)
        yield words.record(schema, cells, follows[cells])

    cells = docs.where("learn").select("text").mapInArrow(run, "cell long, n long")
    matrix = np.zeros(n * n)
    for row in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # n * n rows at most
        matrix[row["cell"]] = row["n"]
    matrix = matrix.reshape(n, n)
    both = np.hstack([matrix, matrix.T]) + 1e-9
    share = both.sum(axis=0) / both.sum()
    profile = np.sqrt(both / both.sum(axis=1, keepdims=True) / share)
    profile /= np.linalg.norm(profile, axis=1, keepdims=True)
    # Spherical k-means from centres far from each other, the heaviest word first.
    centres = [profile[np.argmax(both.sum(axis=1))]]
    while len(centres) < min(params.classes, n):
        near = np.max(profile @ np.array(centres).T, axis=1)
        centres.append(profile[np.argmin(near)])
    centre = np.array(centres)
    for _ in range(50):
        label = np.argmax(profile @ centre.T, axis=1)
        for k in range(len(centre)):
            if (label == k).any():
                mean = profile[label == k].sum(axis=0)
                centre[k] = mean / np.linalg.norm(mean)
    return Contexts(hashes, label.astype(np.int64), params.classes)


def word_counts(docs: DataFrame, contexts: Contexts) -> DataFrame:
    """Staged (word, n, c, cells): uses of every word in all texts, in those to learn from,
    and the latter by context.

    ``docs`` has text and learn. The end token is the empty word.
    """
    schema = pa.schema(
        [("word", pa.binary()), ("context", pa.int32()), ("n", pa.int64()), ("c", pa.int64())]
    )
    n_contexts = contexts.n_classes + 1
    shared = docs.sparkSession.sparkContext.broadcast(contexts)
    end = word_hashes(pa.array([b""]))[0]

    def folded(held: list[tuple]) -> tuple:
        """Uses that agree in word and context are added up; each keeps one of its words."""
        hashes, context, n, c = (np.concatenate([h[i] for h in held]) for i in range(4))
        key = words.mix64(hashes + context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first, index = np.unique(key, return_index=True, return_inverse=True)
        add = lambda x: np.bincount(index, weights=x, minlength=len(first)).astype(np.int64)
        spelled = pa.concat_arrays([h[4] for h in held]).take(pa.array(first))
        return hashes[first], context[first], add(n), add(c), spelled

    def used(part: pa.RecordBatch) -> tuple:
        learn = part.column("learn").to_numpy(zero_copy_only=False)
        w = words.split(part.column("text"), lower=True)
        own = w.hashes()
        context = shared.value.of(w, own).astype(np.int32)
        hashes = np.concatenate([own, np.full(w.n_texts, end)])
        text = np.concatenate([w.text, np.arange(w.n_texts)])
        key = words.mix64(hashes + context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first, index, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        c = np.bincount(index, weights=learn[text], minlength=len(first)).astype(np.int64)
        starts, ends = np.append(w.start, np.zeros(w.n_texts, int)), np.append(w.end, np.zeros(w.n_texts, int))
        return hashes[first], context[first], n, c, _gathered(w.data, starts[first], ends[first])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for part in words.slices(batches, "text"):
            held.append(used(part))
            size += len(held[-1][0])
            if size > _HELD_WORDS:
                _, context, n, c, spelled = folded(held)
                yield words.record(schema, spelled, context, n, c)
                held, size = [], 0
        if held:
            _, context, n, c, spelled = folded(held)
            yield words.record(schema, spelled, context, n, c)

    counted = docs.select("text", "learn").mapInArrow(run, "word binary, context int, n long, c long")
    cells = [F.sum(F.when(F.col("context") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(n_contexts)]
    folded = counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), *cells)
    return staged(
        folded.select("word", "n", "c", F.array(*[F.col(f"c{k}") for k in range(n_contexts)]).alias("cells")),
        "word-counts",
    )


def _gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte runs ``data[start:end]`` as an Arrow binary column."""
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], end - start)
    raw = np.ascontiguousarray(data[at]) if len(at) else np.empty(0, np.uint8)
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)]
    return pa.Array.from_buffers(pa.binary(), len(start), buffers)


def _gathered_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``_SEATED_WORDS`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _SEATED_WORDS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _seats(
    part: pa.RecordBatch, sample: Sample | None, params: PitmanYorParams, log_spelled: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of each word by context and without, and log10 of the spelling probabilities.

    The latter are those of the sample's spelling model unless they are given.
    """
    cells = _matrix(part, "cells", params.classes + 1)
    if sample is None:
        by_context = np.minimum(cells, 1)
        return by_context, by_context.any(axis=1).astype(np.int64), np.zeros(len(cells))
    column = part.column("word")
    if log_spelled is None:
        log_spelled = spell(sample.spelling, column, params.order)
    spelled = 10.0**log_spelled
    random = words.mix64(word_hashes(column) + np.uint64(sample.number + 100 * params.seed))
    return *sweep_words(cells, spelled, random, sample, params), log_spelled


def sweep_words(
    cells: np.ndarray, spelled: np.ndarray, random: np.ndarray, sample: Sample, params: PitmanYorParams
) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each word by context and without, after Gibbs sweeps from one table a dish.

    The tables of a word in a context are drawn given its own tables in all others and in
    the parent, where each is one more customer of the word; the sums over all words are
    those of ``sample``.
    """
    by_context = np.minimum(cells, 1)
    asked = by_context.sum(axis=1)
    tables = np.minimum(asked, 1)
    everyone = int(sample.class_tables.sum())
    seated = [np.flatnonzero(cells[:, k] > 1) for k in range(cells.shape[1])]
    for sweep in range(params.word_sweeps):
        for k, word in enumerate(seated):
            own = by_context[word, k]
            left = asked[word] - own
            left_tables = np.minimum(tables[word], left)
            rest = params.word_strength + params.word_discount * (sample.word_tables - tables[word] + left_tables)
            spelling = np.maximum(rest, 0) * spelled[word]
            others = np.maximum(sample.class_tables[k] - own, 0)
            unit = (params.class_strength + params.class_discount * others) / (
                params.word_strength + np.maximum(everyone - own, 0)
            )
            first = left - params.word_discount * left_tables + spelling
            later = left - params.word_discount * np.maximum(left_tables, 1) + spelling
            salt = words.mix64(random[word] + np.uint64(1 + k + sweep * (cells.shape[1] + 1)))
            drawn = sample_tables(salt, cells[word, k], unit * first, params.class_discount, (unit, later))
            by_context[word, k] = drawn
            asked[word] += drawn - own
            tables[word] = np.clip(tables[word], np.minimum(asked[word], 1), asked[word])
        word = np.flatnonzero(asked > 1)
        others = np.maximum(sample.word_tables - tables[word], 0)
        mass = (params.word_strength + params.word_discount * others) * spelled[word]
        salt = words.mix64(random[word] + np.uint64((sweep + 1) * (cells.shape[1] + 1)))
        tables[word] = sample_tables(salt, asked[word], mass, params.word_discount)
    return by_context, tables


def _seat_words(
    counts: DataFrame, sample: Sample | None, params: PitmanYorParams, spelled: bool = True
) -> tuple:
    """Customers of the spelling model, and all tables, when words are seated by ``sample``.

    Without ``spelled`` there are only the latter. Without a sample every dish has one table. Pairs are folded in the tasks.
    """
    schema = pa.schema([("pair", pa.int64()), ("length", pa.int32()), ("customers", pa.int64())])
    shared = counts.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights = _NO_LEAVES
        totals = np.zeros(params.classes + 2, dtype=np.int64)
        for batch in _gathered_batches(batches):
            for part in words.slices(iter([batch]), "word", 1 << 19):
                by_context, tables, _ = _seats(part, shared.value, params)
                totals[:-1] += by_context.sum(axis=0)
                totals[-1] += tables.sum()
                if not spelled:
                    continue
                # The length goes to the top of the key: contexts of other lengths differ.
                keys, weights = _folded_leaves((keys, weights), part.column("word"), tables, params)
            if len(keys) > 4 * _FLUSH:
                yield words.record(schema, keys & ((1 << _LENGTH_AT) - 1), (keys >> _LENGTH_AT).astype(np.int32), weights)
                keys, weights = _NO_LEAVES
        yield words.record(schema, keys & ((1 << _LENGTH_AT) - 1), (keys >> _LENGTH_AT).astype(np.int32), weights)
        yield words.record(schema, np.arange(len(totals)), np.full(len(totals), -1, np.int32), totals)

    learned = counts.where("c > 0").select("word", "cells")
    pairs = (
        learned.mapInArrow(run, "pair long, length int, customers long")
        .groupBy("pair", "length")
        .agg(F.sum("customers").alias("customers"))
    )
    folded = staged(pairs, "spelling-pairs")
    shared.destroy()
    return _bounded_pairs(folded, params)


def _bounded_pairs(pairs: DataFrame, params: PitmanYorParams) -> tuple:
    """Pairs with rare ones handed to their parents, longest contexts first, and all tables.

    What is collected has at most ``1 / min_share`` rows for each context length. A few pairs
    are collected as they are, and seating hands the rare ones up: the result is the same.
    """
    total = pairs.where("length >= 0").agg(F.sum("customers")).first()[0] or 0
    totals = np.zeros(params.classes + 2, dtype=np.int64)
    for row in pairs.where("length < 0").collect():
        totals[row["pair"]] = row["customers"]
    least = params.min_share * total
    out = []
    rising = pairs.where("length >= 0")
    if rising.count() <= _COLLECTED_PAIRS:
        everything = rising.toPandas()
        columns = [everything[c].to_numpy().astype(np.int64) for c in ("pair", "length", "customers")]
        return columns, (totals[:-1], int(totals[-1]))
    symbol = F.col("pair").bitwiseAND((1 << _BITS) - 1)
    for n in range(params.order, -1, -1):
        own = rising.where(F.col("length") == n)
        level = staged(own.groupBy("pair").agg(F.sum("customers").alias("customers")), "spelling-level")
        kept = level.where(F.col("customers") >= least) if n else level
        out.append(kept.select("pair", F.lit(n).alias("length"), "customers").toPandas())
        if n:
            parent = F.shiftright("pair", _BITS).bitwiseAND((1 << (_BITS * (n - 1))) - 1)
            up = level.where(F.col("customers") < least).select(
                F.shiftleft(parent, _BITS).bitwiseOR(symbol).alias("pair"), F.lit(n - 1).alias("length"), "customers"
            )
            rising = pairs.where((F.col("length") >= 0) & (F.col("length") < n)).unionByName(up)
    columns = [np.concatenate([o[c].to_numpy().astype(np.int64) for o in out]) for c in ("pair", "length", "customers")]
    return columns, (totals[:-1], int(totals[-1]))


def _seated_together(counts: DataFrame, params: PitmanYorParams) -> tuple[DataFrame, list]:
    """(word, n, c, cells, tables, seated, spelled) and the drawn totals of every sample.

    ``tables`` adds up a word's tables by context, ``seated`` and ``spelled`` have its mass
    without context and the log10 of its spelling probability in every sample. All spelling
    restaurants are seated on the driver.
    """
    sample, samples, drawn_totals = None, [], []
    for number in range(params.samples + 1):
        # Nothing is spelled after the last sample.
        leaves, drawn = _seat_words(counts, sample, params, number < params.samples)
        if sample is not None:
            samples.append(sample)
            drawn_totals.append(drawn)
        if number < params.samples:
            spelling = seat_spelling(*leaves, params, params.seed + number)
            sample = Sample(number, spelling, *drawn)
    shared = counts.sparkSession.sparkContext.broadcast(samples)
    schema = pa.schema([*_WORD_FIELDS, *_SEAT_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(_gathered_batches(batches), "word", 1 << 19):
            for one in shared.value:
                columns = _seat_columns(part, *_seats(part, one, params), one.number, params)
                part = words.record(schema, *_word_columns(part), *columns)
            yield part

    rows = _unseated(counts, params).mapInArrow(run, f"{_WORD_DDL}, {_SEAT_DDL}")
    seated = staged(rows, "seated-words")
    shared.destroy()
    return seated, drawn_totals


_WORD_FIELDS = [
    pa.field("word", pa.binary()),
    pa.field("n", pa.int64()),
    pa.field("c", pa.int64()),
    pa.field("cells", pa.list_(pa.int64())),
]
_WORD_DDL = "word binary, n long, c long, cells array<long>"
_SEAT_FIELDS = [
    pa.field("tables", pa.list_(pa.int64())),
    pa.field("seated", pa.list_(pa.float64())),
    pa.field("spelled", pa.list_(pa.float64())),
]
_SEAT_DDL = "tables array<long>, seated array<double>, spelled array<double>"
_ASK_DDL = "part long, leaf long, customers long"
_NO_LEAVES = (np.empty(0, np.int64), np.empty(0, np.int64))


def _unseated(counts: DataFrame, params: PitmanYorParams) -> DataFrame:
    """``counts`` with the columns of the seats, before the first sample."""
    none = F.array().cast("array<double>")
    zeros = F.array_repeat(F.lit(0).cast("long"), params.classes + 1)
    return counts.withColumns({"tables": zeros, "seated": none, "spelled": none})


def _rows(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return words.lists(values.ravel(), np.full(len(values), values.shape[1]), kind)


def _word_columns(part: pa.RecordBatch) -> list[pa.Array]:
    """The ``_WORD_FIELDS`` of a batch."""
    cells = words.lists(part.column("cells").flatten(), pc.list_value_length(part.column("cells")), pa.int64())
    return [part.column("word"), part.column("n"), part.column("c"), cells]


def _seat_columns(
    part: pa.RecordBatch, by_context: np.ndarray, tables: np.ndarray, log_spelled: np.ndarray, number: int, params: PitmanYorParams
) -> list[pa.Array]:
    """The ``_SEAT_FIELDS`` of a batch with the seats of sample ``number`` added."""
    mass = by_context.sum(axis=1) - params.word_discount * tables
    return [
        _rows(_matrix(part, "tables", params.classes + 1) + by_context, pa.int64()),
        _rows(np.column_stack([_matrix(part, "seated", number), mass]), pa.float64()),
        _rows(np.column_stack([_matrix(part, "spelled", number), log_spelled]), pa.float64()),
    ]


def _leaves(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf and word number of every character of the words."""
    context, symbol, length, word = _spelled(column, order)
    return (length << _LENGTH_AT) | (context << _BITS) | symbol, word


def _folded_leaves(
    folded: tuple[np.ndarray, np.ndarray], column: pa.Array, customers: np.ndarray, params: PitmanYorParams
) -> tuple[np.ndarray, np.ndarray]:
    """Sorted leaves and their customers, with those of some more words."""
    leaf, word = _leaves(column, params.order)
    keys, index = np.unique(np.concatenate([folded[0], leaf]), return_inverse=True)
    weights = np.concatenate([folded[1], customers[word]])
    return keys, np.bincount(index, weights=weights, minlength=len(keys)).astype(np.int64)


def _seated_apart(counts: DataFrame, params: PitmanYorParams, drawn: tuple) -> tuple[DataFrame, list]:
    """What :func:`_seated_together` gives, with the spelling restaurants in many tasks.

    The words come in parts. A part asks for the probabilities of its distinct leaves, learned
    or not, and brings the customers of its learned words. ``drawn`` are the totals of one
    table a dish.
    """
    n_contexts = params.classes + 1
    n_parts = -(-counts.count() // _PART_WORDS)
    parted = counts.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(n_parts)))
    ask = pa.schema([("part", pa.int64()), ("leaf", pa.int64()), ("customers", pa.int64())])
    seat = pa.schema([ask.field("part"), *_WORD_FIELDS, *_SEAT_FIELDS, *list(ask)[1:]])

    def first(rows: pa.Table) -> pa.Table:
        folded = _NO_LEAVES
        for part in words.slices(iter(rows.combine_chunks().to_batches()), "word", 1 << 19):
            folded = _folded_leaves(folded, part.column("word"), part.column("c").to_numpy() > 0, params)
        return pa.table([np.full(len(folded[0]), rows["part"][0].as_py()), *folded], schema=ask)

    def seats(rows: pa.Table, answers: pa.Table) -> pa.Table:
        part_number = rows["part"][0].as_py()
        known, log_p = answers["leaf"].to_numpy(), answers["log_p"].to_numpy()
        order = np.argsort(known)
        known, log_p = known[order], log_p[order]
        folded, totals, out = _NO_LEAVES, np.zeros(n_contexts + 1, dtype=np.int64), []
        for part in words.slices(iter(rows.combine_chunks().to_batches()), "word", 1 << 19):
            column = part.column("word")
            leaf, word = _leaves(column, params.order)
            log_spelled = np.bincount(word, weights=log_p[np.searchsorted(known, leaf)], minlength=len(column))
            by_context, own, _ = _seats(part, sample, params, log_spelled)
            totals += np.append(by_context.sum(axis=0), own.sum())
            if sample.number + 1 < params.samples:
                folded = _folded_leaves(folded, column, own, params)
            columns = [np.full(len(column), part_number), *_word_columns(part)]
            columns += _seat_columns(part, by_context, own, log_spelled, sample.number, params)
            out.append(words.record(seat, *columns, *[pa.nulls(len(column), pa.int64())] * 2))
        leaves, customers = np.append(folded[0], -1 - np.arange(len(totals))), np.append(folded[1], totals)
        nothing = [pa.nulls(len(leaves), f.type) for f in (*_WORD_FIELDS, *_SEAT_FIELDS)]
        out.append(words.record(seat, np.full(len(leaves), part_number), *nothing, leaves, customers))
        return pa.Table.from_batches(out, seat)

    asks = parted.select("part", "word", "c").groupBy("part").applyInArrow(first, _ASK_DDL)
    asks = staged(asks, "asked-pairs")
    # Rows are words, or leaves without a word; negative leaves are the totals.
    rows = _unseated(parted, params)
    all_drawn = []
    for number in range(params.samples):
        spelled = _spread_spelling(asks, params, params.seed + number)
        sample = Sample(number, None, *drawn)
        answered = asks.select(F.col("part").alias("asker"), "leaf").join(spelled, "leaf")
        pass_ddl = f"part long, {_WORD_DDL}, {_SEAT_DDL}, leaf long, customers long"
        out = rows.groupBy("part").cogroup(answered.groupBy("asker")).applyInArrow(seats, pass_ddl)
        out = staged(out, "seated-words")
        rows = out.where("leaf is null").drop("leaf", "customers")
        asks = out.where("leaf >= 0").select("part", "leaf", "customers")
        totals = out.where("leaf < 0").groupBy("leaf").agg(F.sum("customers").alias("tables"))
        found = {-1 - r["leaf"]: r["tables"] for r in totals.collect()}
        drawn = np.array([found[k] for k in range(n_contexts)]), found[n_contexts]
        all_drawn.append(drawn)
    return rows, all_drawn


@dataclass(frozen=True)
class PitmanYorModel:
    """A fitted model: every word's values in a table, and what all words have in common.

    ``values`` has (word_hash, n, c, log_p0, contexts, masses, p0): log10 of the averaged
    probability without context, the averaged seated mass in each context the word was learned
    in, and the probability itself, which is 0 for words too long for a double.
    ``rest`` is the averaged back-off mass of each context.
    """

    values: DataFrame
    contexts: Contexts
    rest: np.ndarray
    train_tokens: int
    vocabulary: int
    all_tokens: int


def fit(docs: DataFrame, params: PitmanYorParams | None = None) -> PitmanYorModel:
    """Sample the model from the texts with ``learn`` and value every word of all texts."""
    params = params or PitmanYorParams()
    contexts = learn_contexts(docs, params)
    counts = word_counts(docs, contexts)
    n_contexts = params.classes + 1
    learned = F.col("c") > 0
    sums = [F.sum(F.col("cells")[k]) for k in range(n_contexts)]
    sums += [F.sum((F.col("cells")[k] > 0).cast("long")) for k in range(n_contexts)]
    spelled = F.sum(F.when(learned, F.octet_length("word") + 1))
    totals = counts.agg(F.sum("c"), F.sum(learned.cast("long")), F.sum("n"), spelled, *sums).first()
    train, vocabulary, everything, characters = (int(t or 0) for t in totals[:4])
    customers = np.array([float(t or 0) for t in totals[4 : 4 + n_contexts]])
    dishes = [int(t or 0) for t in totals[4 + n_contexts :]]
    if params.min_share > 0 or characters <= _COLLECTED_PAIRS:
        seated, drawn = _seated_together(counts, params)
    else:
        seated, drawn = _seated_apart(counts, params, (np.array(dishes), vocabulary))
    schema = pa.schema(
        [
            ("word_hash", pa.int64()),
            ("n", pa.int64()),
            ("c", pa.int64()),
            ("log_p0", pa.float64()),
            ("contexts", pa.list_(pa.int8())),
            ("masses", pa.list_(pa.float32())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(_gathered_batches(batches), "word", 1 << 19):
            cells = _matrix(part, "cells", n_contexts)
            # The log is kept: the spelling of a word of hundreds of bytes has no double.
            log_p0 = np.full(len(cells), -np.inf)
            own, log_spelled = _matrix(part, "seated", len(drawn)), _matrix(part, "spelled", len(drawn))
            for k, (class_tables, word_tables) in enumerate(drawn):
                back = params.word_strength + params.word_discount * word_tables
                with np.errstate(divide="ignore"):
                    one = np.logaddexp(np.log(own[:, k]), math.log(back) + math.log(10) * log_spelled[:, k])
                log_p0 = np.logaddexp(log_p0, one - math.log(params.word_strength + class_tables.sum()))
            by_context = _matrix(part, "tables", n_contexts) / len(drawn)
            mass = (cells - params.class_discount * by_context) / (params.class_strength + customers)
            word, context = np.nonzero(cells)
            sizes = np.bincount(word, minlength=len(cells))
            yield words.record(
                schema,
                word_hashes(part.column("word")).view(np.int64),
                part.column("n"),
                part.column("c"),
                (log_p0 - math.log(len(drawn))) / math.log(10),
                words.lists(context.astype(np.int8), sizes, pa.int8()),
                words.lists(mass[word, context].astype(np.float32), sizes, pa.float32()),
            )

    ddl = "word_hash long, n long, c long, log_p0 double, contexts array<tinyint>, masses array<float>"
    values = staged(seated.mapInArrow(run, ddl), "word-values").withColumn("p0", F.pow(F.lit(10.0), "log_p0"))
    rest = np.mean(
        [(params.class_strength + params.class_discount * tables) / (params.class_strength + customers) for tables, _ in drawn],
        axis=0,
    )
    return PitmanYorModel(values, contexts, rest, train, vocabulary, everything)


def _matrix(part: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """A column of lists of equal length, one row a word."""
    return part.column(column).flatten().to_numpy().reshape(part.num_rows, width)


def word_hashes(column: pa.Array) -> np.ndarray:
    """The hash of whole words, the same as that of words found in texts."""
    data, offsets = words.utf8(column)
    return words.rolling(words.byte_values(data), offsets[:-1], offsets[1:])


def score(docs: DataFrame, model: PitmanYorModel, params: PitmanYorParams | None = None) -> DataFrame:
    """Adds n_tokens, n_known, base_score and score to ``docs``; the text is dropped.

    Values of frequent words are broadcast (at most ``1 / frequent_share`` of them), those of
    all others are joined. A null or empty text is its end token. Rows are told apart by
    number, so repeated ids do no harm; existing columns with these names are replaced.
    """
    params = params or PitmanYorParams()
    least = params.frequent_share * model.all_tokens
    base = math.log10(model.train_tokens + 0.5 * (model.vocabulary + 1))
    n_contexts = params.classes + 1
    frequent = model.values.where((F.col("n") >= least) & (F.col("n") > 0)).toPandas()
    order = np.argsort(frequent["word_hash"].to_numpy().view(np.uint64))
    keys = frequent["word_hash"].to_numpy().view(np.uint64)[order]
    counts = frequent["c"].to_numpy()[order]
    p0 = frequent["p0"].to_numpy()[order]
    seated = _dense(frequent, n_contexts)[order]
    spelled = frequent["log_p0"].to_numpy()[order][:, None] + np.log10(model.rest)
    with np.errstate(divide="ignore"):
        log_p = np.where(seated > 0, np.log10(p0[:, None] * model.rest + seated), spelled).astype(np.float32)
    base_values = (np.log10(counts + 0.5) - base).astype(np.float64)
    shared = docs.sparkSession.sparkContext.broadcast((keys, base_values, log_p, counts > 0, model.contexts))
    end = word_hashes(pa.array([b""]))[0]

    def compute(column: pa.Array) -> list:
        known, base_of, model_of, seen, contexts = shared.value
        w = words.split(column, lower=True)
        n = len(column)
        own = w.hashes()
        context = contexts.of(w, own)
        hashes = np.concatenate([own, np.full(n, end)])
        text = np.concatenate([w.text, np.arange(n)])
        at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        hit = known[at] == hashes if len(known) else np.zeros(len(hashes), dtype=bool)
        found, owner = at[hit], text[hit]
        values = (seen[found], base_of[found], model_of[found, context[hit]]) if len(known) else ()
        sums = [np.bincount(owner, weights=v.astype(float), minlength=n) for v in values] or [np.zeros(n)] * 3
        rare = np.flatnonzero(~hit)
        rare = rare[np.argsort(text[rare], kind="stable")]
        sizes = np.bincount(text[rare], minlength=n)
        return [
            (w.counts() + 1).astype(np.int64),
            sums[0].astype(np.int64),
            sums[1],
            sums[2],
            words.lists(hashes[rare].view(np.int64), sizes, pa.int64()),
            words.lists(context[rare].astype(np.int8), sizes, pa.int8()),
        ]

    fields = {
        "n_tokens": "long",
        "n_known": "long",
        "base_score": "double",
        "score": "double",
        "_rare": "array<long>",
        "_context": "array<tinyint>",
    }
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    first = staged(words.with_columns(numbered, "text", fields, compute, keep=[c for c in numbered.columns if c != "text" and c not in fields]), "scored")
    rare = first.select("_row", F.explode(F.arrays_zip("_rare", "_context")).alias("t")).select(
        "_row", F.col("t._rare").alias("word_hash"), F.col("t._context").alias("context")
    )
    values = model.values.where(F.col("n") < least).drop("n")
    back = F.element_at(F.array(*[F.lit(float(r)) for r in model.rest]), F.col("context").cast("int") + 1)
    place = F.array_position("contexts", F.col("context")).cast("int")
    seated = F.when(place > 0, F.element_at("masses", F.when(place > 0, place).otherwise(1))).otherwise(0.0)
    more = (
        rare.join(values, "word_hash")
        .withColumn("mass", seated)
        .withColumn(
            "log_p",
            F.when(F.col("mass") > 0, F.log10(F.col("p0") * back + F.col("mass"))).otherwise(
                F.col("log_p0") + F.log10(back)
            ),
        )
        .groupBy("_row")
        .agg(
            F.sum((F.col("c") > 0).cast("long")).alias("_known"),
            F.sum(F.log10(F.col("c") + 0.5) - base).alias("_base"),
            F.sum("log_p").alias("_score"),
        )
    )
    zero = F.lit(0)
    return (
        first.join(more, "_row", "left")
        .withColumn("n_known", F.col("n_known") + F.coalesce("_known", zero))
        .withColumn("base_score", F.col("base_score") + F.coalesce("_base", zero.cast("double")))
        .withColumn("score", F.col("score") + F.coalesce("_score", zero.cast("double")))
        .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
        .drop("_row", "_rare", "_context", "_known", "_base", "_score")
    )


def _dense(values: pd.DataFrame, n_contexts: int) -> np.ndarray:
    """The seated masses of all contexts, one row a word."""
    dense = np.zeros((len(values), n_contexts))
    if len(values):
        sizes = values["contexts"].map(len).to_numpy()
        word = np.repeat(np.arange(len(values)), sizes)
        dense[word, np.concatenate(values["contexts"].to_list()).astype(int)] = np.concatenate(
            values["masses"].to_list()
        )
    return dense
