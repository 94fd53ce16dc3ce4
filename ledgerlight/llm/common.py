"""Helpers that the operators share: reading a table, Arrow batches in tasks, folders, hashes of words."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.sinks.store import materialise, run_dir  # noqa: F401

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How a worker drops what an operator remembers between tasks, by the operator's module.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remembers(module: str, clear: Callable[[], None]) -> None:
    _REMEMBERED[module] = clear


def take_turn(module: str) -> None:
    """A worker is used again by later stages: what other operators remember in it is dropped."""
    for other, clear in _REMEMBERED.items():
        if other != module:
            clear()


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow``; workers that were started elsewhere also find this package beside the driver's copy."""
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    module = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn(module)
        return fn(batches)

    return df.mapInArrow(run, schema)


#: Most rows of two longs that are sent to all executors: about 100 MB as a hash table.
BROADCAST_ROWS = 1_000_000


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The side of a join with a large table: broadcast if a count says that it has at most ``rows``, else shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def texts(column: pa.ChunkedArray | pa.Array) -> Iterator[str]:
    """The strings of a column one at a time; null is the empty text."""
    for value in column:
        yield value.as_py() or ""


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over unsigned 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for at most ``limit`` words of a worker."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, offsets: tuple[int, ...], seed: int = 0) -> np.ndarray:
    """One hash for each window of words, over the words at ``offsets`` in it, in order."""
    n = len(h) - offsets[-1]
    if n <= 0:
        return h[:0]
    with np.errstate(over="ignore"):
        out = np.full(n, seed + 0x9E3779B97F4A7C15, np.uint64)
        for o in offsets:
            out = mix(out + h[o : o + n])
    return out
