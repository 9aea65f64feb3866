"""What the operators share: stored intermediate tables, byte-level words, fresh column names."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.session import dropped, scratch, shared_dir, stored  # noqa: F401  the operators take them from here

#: Maps A-Z to a-z and each ASCII byte that is neither letter nor digit to a space; other bytes stay.
ALNUM = bytes(ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def alnum_words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, then the maximal runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]."""
    return text.translate(ALNUM).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their differences over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; a bounded cache spares most of the calls."""
    if len(_hashes) > 200_000:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that no input column has."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def whole(text: Column | str) -> Column:
    """Text, or the empty string for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def raw(text: Column | str) -> Column:
    """Text as bytes for Arrow functions; null is empty. Sparing the decoding also keeps malformed text readable."""
    return whole(text).cast("binary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
