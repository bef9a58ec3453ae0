"""Sample ids, name parts and reproducible hash-based randomness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_id(path: Column | str) -> Column:
    """Base name of a path up to its first dot."""
    return F.substring_index(F.regexp_extract(path, "([^/]+)$", 1), ".", 1)


def extension(path: Column | str) -> Column:
    """Part of a path after its last dot."""
    return F.substring_index(path, ".", -1)


def digest(seed: int | str, *parts: Column | str) -> Column:
    """md5 of ``seed:part:part...`` as 32 hex digits."""
    texts = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *texts))


def leading_bits(hex_digest: Column, digits: int) -> Column:
    """The first ``digits`` hex digits of a digest as a number."""
    return F.conv(F.substring(hex_digest, 1, digits), 16, 10).cast("long")


def uniform(seed: int | str, *parts: Column | str) -> Column:
    """Uniform number in (0, 1) that depends only on the seed and the parts."""
    return (leading_bits(digest(seed, *parts), 8) + F.lit(0.5)) / F.lit(4294967296.0)


def routed_id(sample: Column | str, seed: int | str = 0) -> Column:
    """Sample id with a zero-padded five-digit suffix taken from its own digest."""
    sample = F.col(sample) if isinstance(sample, str) else sample
    number = F.pmod(leading_bits(digest(seed, sample), 8), F.lit(99999))
    return F.concat(sample.cast("string"), F.lit("_"), F.lpad(number.cast("string"), 5, "0"))
