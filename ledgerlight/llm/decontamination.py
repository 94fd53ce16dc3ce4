"""Benchmark decontamination by spaced seeds: hashes of words at fixed offsets, so some words may differ.

A passage is taken from an item if in ``window`` aligned words (all, in shorter items) at least ``least`` are equal.
Each mask names seven of the words it spans; the others are ignored. Whichever two of thirteen words are replaced, one
of the three masks has a place where all of its words are intact, so no such passage is missed. Items shorter than the
window are found by runs of words as long as any allowed replacements leave one.

1. The items' seeds are written as a table. A Bloom filter of a fixed greatest size is built from them.
2. Documents are read once; a task hashes every place of every text under each mask and keeps what passes the filter.
3. These places are joined with the items' seeds; a place in the document less the place in the item is an alignment.
4. Each alignment is verified word by word around the hit; nothing is reported on the strength of a hash alone.

The filter only saves rows of the join: a larger benchmark passes more places that the join then drops.

Defined results: null, empty and short texts contain nothing; texts of any length are read whole; rows that repeat an
id are one document, of which the best overlap is reported (each text is only aligned with its own hits); rows without an id can't be named and aren't reported;
items without an id are named by a hash of their text; items without words are contained in nothing; of two alignments that are equally good the first counts; empty tables
give an empty one; further columns, whatever their names, are not read (``keep_clean`` hands them on).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_map, materialise, remembers, small_or_not, texts, windows

WINDOW, LEAST = 13, 0.8
#: Offsets of the words that count; any two other words of thirteen may differ for one of the masks.
MASKS = ((0, 2, 3, 4, 6, 7, 8), (0, 1, 2, 5, 7, 8, 9), (0, 1, 4, 5, 6, 9, 11))
#: Bits of the filter for each seed, and the most it may have: 16 MB.
BITS_PER_SEED, MOST_BITS, PROBES = 64, 1 << 27, 4

_WORDS = WordHashes()
remembers(__name__, _WORDS.clear)
_VIEW = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> np.ndarray:
    """Hashes of the words of a text: lower case, without ASCII punctuation."""
    return _WORDS.of(text.lower().encode("utf-8", "surrogatepass").translate(_VIEW).split())


def needed(n: int, window: int = WINDOW, least: float = LEAST) -> tuple[int, int]:
    """(words compared at once, equal ones among them) for an item of n words."""
    w = min(n, window)
    return w, -(-w * round(least * 100) // 100)


def run_of(n: int, window: int, least: float) -> tuple[int, ...]:
    """Offsets of the longest run that the allowed replacements can't avoid."""
    w, equal = needed(n, window, least)
    return tuple(range(max(1, -(-equal // (w - equal + 1)))))


def masks_for(n: int, window: int = WINDOW, least: float = LEAST) -> tuple[tuple[int, ...], ...]:
    if n >= window and needed(window, window, least) == needed(WINDOW):
        return MASKS
    return (run_of(n, window, least),) if n else ()


def seeds(words: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    return windows(words, offsets, seed=sum((o + 1) * 31**i for i, o in enumerate(offsets)) & 0xFFFFFFFF)


def item_seeds(benchmark: DataFrame, window: int, least: float, min_words: int = 1) -> DataFrame:
    """``item_id``, ``mask`` as text, ``place``, ``seed`` of the items with ``min_words`` or more."""

    def run(batches):
        for b in batches:
            out = []
            for item, text in zip(b.column(0), texts(b.column(1)), strict=True):
                words = words_of(text)
                for offsets in masks_for(len(words), window, least) if len(words) >= min_words else ():
                    name = ",".join(map(str, offsets))
                    out += [(item.as_py(), name, i, s) for i, s in enumerate(seeds(words, offsets).view(np.int64).tolist())]
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            types = (pa.int64(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item_id", "mask", "place", "seed"])

    return arrow_map(benchmark, run, "item_id long, mask string, place int, seed long")


def _probe(seeds_: np.ndarray, i: int, bits: int) -> np.ndarray:
    """Seeds are mixed hashes already; their halves give as many bits as are wanted."""
    return (seeds_ + np.uint64(i) * ((seeds_ >> np.uint64(33)) | np.uint64(1))) & np.uint64(bits - 1)


def bloom(found: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``bits`` bits over the seeds; its words are put together by Spark, as many as it has at most."""

    def run(batches):
        for b in batches:
            s = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.unique(np.concatenate([_probe(s, i, bits) for i in range(PROBES)])) if len(s) else np.empty(0, np.uint64)
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(value.view(np.int64))], ["word", "value"])

    words = arrow_map(found.select("seed"), run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
    out = np.zeros(bits // 64, np.uint64)
    got = words.toArrow()
    out[got["word"].to_numpy()] = got["value"].to_numpy().view(np.uint64)
    return out


def passes(table: np.ndarray, seeds_: np.ndarray) -> np.ndarray:
    """Places of the seeds that the filter holds; each probe looks only at what passed the ones before."""
    places = np.arange(len(seeds_))
    for i in range(PROBES):
        at = _probe(seeds_[places], i, len(table) * 64)
        places = places[(table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    return places


def suspects(docs: DataFrame, masks: list[tuple[int, ...]], table: np.ndarray) -> DataFrame:
    """Documents with places that pass the filter: their words and a hash of these, the seeds there and the places."""

    def run(batches):
        for b in batches:
            out = []
            for doc, text in zip(b.column(0), texts(b.column(1)), strict=True):
                words = words_of(text)
                hit, at = [], []
                for offsets in masks:
                    s = seeds(words, offsets)
                    places = passes(table, s)
                    hit += s[places].view(np.int64).tolist()
                    at += places.tolist()
                if hit:
                    raw = words.tobytes()
                    out.append((doc.as_py(), xxhash.xxh3_64_intdigest(raw) - (1 << 63), raw, hit, at))
            columns = zip(*out, strict=True) if out else ((),) * 5
            types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "row", "words", "seeds", "places"])

    return arrow_map(docs, run, "doc_id long, row long, words binary, seeds array<long>, places array<int>")


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, window: int, least: float) -> tuple[int, int] | None:
    """(first aligned word of the document, equal words) if the passage is taken from the item at this alignment."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    w, equal = needed(len(item), window, least)
    if b - a < w:
        return None
    same = np.concatenate([[0], np.cumsum(doc[a + shift : b + shift] == item[a:b])])
    if (same[w:] - same[:-w]).max() < equal:
        return None
    return a + shift, int(same[-1])


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", min_words: int = 1) -> DataFrame:
    """``doc_id``, ``item_id``, ``first_word``, ``n_equal``, ``n_words`` of each document and item in it.

    Items of fewer than ``min_words`` words are left out; :func:`left_out` lists them.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("long"), F.xxhash64("text")).alias("item_id"), F.col("text").alias("text"))
    found = materialise(item_seeds(items, window, least, min_words), "seeds")
    n = found.count()
    bits = 1 << max(16, min(MOST_BITS.bit_length() - 1, (max(n, 1) * BITS_PER_SEED - 1).bit_length()))
    masks = sorted(tuple(map(int, r["mask"].split(","))) for r in found.select("mask").distinct().collect())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    held = materialise(suspects(rows, masks, bloom(found, bits)), "suspects")
    places = held.select("doc_id", "row", F.explode(F.arrays_zip("seeds", "places")).alias("hit"))
    places = places.select("doc_id", "row", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("at"))
    aligned = places.join(found.select("seed", "item_id", "place"), "seed").select("doc_id", "row", "item_id", (F.col("at") - F.col("place")).alias("shift")).distinct()

    def item_words(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([words_of(t).tobytes() for t in texts(b.column(1))], pa.binary())], ["item_id", "item"])

    with_words = aligned.join(arrow_map(items, item_words, "item_id long, item binary"), "item_id").join(held.select("doc_id", "row", "words").distinct(), ["doc_id", "row"])

    def verify(batches):
        for b in batches:
            out = []
            for doc, item, shift, a, x in zip(*(b.column(i) for i in range(5)), strict=True):
                item_hashes = np.frombuffer(x.as_py(), np.uint64)
                got = overlap(np.frombuffer(a.as_py(), np.uint64), item_hashes, shift.as_py(), window, least)
                if got:
                    out.append((doc.as_py(), item.as_py(), *got, len(item_hashes)))
            columns = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "first_word", "n_equal", "n_words"])

    checked = arrow_map(with_words.select("doc_id", "item_id", "shift", "words", "item"), verify, "doc_id long, item_id long, first_word long, n_equal long, n_words long")
    best = F.max_by(F.struct("first_word", "n_equal", "n_words"), F.struct("n_equal", -F.col("first_word")))
    return checked.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def left_out(benchmark: DataFrame, min_words: int, text_col: str = "text") -> DataFrame:
    """The items with fewer than ``min_words`` words, which say too little to condemn a text that holds them."""

    def run(batches):
        for b in batches:
            short = [len(words_of(t)) < min_words for t in texts(b.column(at))]
            yield b.filter(pa.array(short, pa.bool_()))

    at = benchmark.columns.index(text_col)
    return arrow_map(benchmark, run, benchmark.schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents, with all their columns, that contain no passage of an item."""
    taken = overlaps(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(small_or_not(materialise(taken, "contaminated")), id_col, "left_anti").select(*docs.columns)
