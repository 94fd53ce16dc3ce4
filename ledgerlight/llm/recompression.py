"""Removal of passages that an earlier document holds, by recompression.

*Names.* Words get names, then rounds name runs of one token and pairs of neighbours: a round deals all symbols to two
classes by their names, and a symbol of the first class followed by one of the second becomes one symbol. A name is a
hash of what it stands for, so every task names alike in every round without a table that all tokens would have to be
joined with. Whether and how a symbol is formed depends on few words around it, its *context*. Equal substrings therefore
hold the same symbols wherever the context lies inside.

*Segments.* A window of ``width`` words is represented by the highest symbol whose context it holds (of several the one
with the least hash, of these the leftmost; without any, the window itself), named by the words of the context. That is a
function of the window's words alone, so equal windows meet at one name. Windows in a row with the same representative
are a segment; each window is in one segment.

*Spark.* The names are counted; one that a single document holds can't be in a repeated window and ends there. A Bloom
filter of a fixed greatest size is built from the shared names, a second pass over the texts lets through the segments
whose name it holds, and their windows are compared: sorted by name and document, the first holder of each window comes
first. The filter only saves rows; beyond its size the rows are also joined with the shared names. Names of more than
``HOT`` segments are kept apart: their windows are folded to a smallest document before the shuffle and joined back, so a
passage that a third of the documents hold is never one task's work. Windows are equal if two hashes of 64 bits are, that
of the window and that of its representative's words.

Rows with the whole text of a smaller document lose everything and, if a count says that their ids can be broadcast, are
left out of the comparison. Only documents that lose some of their words have their text read again; their ids are broadcast if a count allows it,
and joined otherwise.

Defined results: null and empty texts have no words; a document with fewer words than a window loses none; rows repeated
in full all get the same result, rows with one id but other texts don't remove each other's words; a row with a null id
loses nothing and removes nothing; an empty table gives an empty result; further columns, whatever their names, are not
read. A text is parsed as a whole, with some 150 bytes of memory a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_map, materialise, mix, small_or_not
from .decontamination import MOST_BITS, bloom, passes

WIDTH = 13
ROUNDS = 2
#: Segments from which a name counts as hot.
HOT = 20_000
#: Bits of the filter for each name, up to its greatest size.
BITS_PER_NAME = 16
#: Bytes of text that are parsed together; a longer document is parsed alone.
CHUNK = 1 << 20
#: Odd multipliers of the hashes over bytes and over words; 5 modulo 8, so that their powers differ as much as they can.
OF_BYTES, OF_WORDS = 0x9E3779B97F4A7C1D, 0xD1342543DE82EF95
SPACE = 0x20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base & ((1 << 64) - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of a base and of its inverse, as many as were ever needed at once (up to ``keep`` between calls)."""

    def __init__(self, base: int, keep: int = 4 * CHUNK):
        self.base, self.keep = base, keep
        self.up = self.down = np.empty(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.up, self.down
        if len(up) < n:
            size = 1 << (n - 1).bit_length()
            up, down = _powers(self.base, size), _powers(pow(self.base, -1, 1 << 64), size)
            if size <= self.keep:
                self.up, self.down = up, down
        return up[:n], down[:n]


BYTE_POWERS, WORD_POWERS = Powers(OF_BYTES), Powers(OF_WORDS)
BYTE_NAMES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def spans(values: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which :func:`named` reads the hash of any span of ``values``."""
    up, down = powers.of(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums, down


def named(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the span from ``start`` to before ``end``, wherever it stands."""
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_names(data: bytes) -> np.ndarray:
    """Names of words with one space between any two."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(raw == SPACE)
    start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    out, at = [], 0
    while at < len(start):  # sums over some of the bytes at a time
        to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK, "right")))
        low = start[at]
        sums, down = spans(BYTE_NAMES[raw[low : end[to - 1]]], BYTE_POWERS)
        out.append(named(sums, down, start[at:to] - low, end[at:to] - low))
        at = to
    return np.concatenate(out)


class Symbols:
    """Symbols of some documents: names, the words they span, the words their being formed depends on."""

    def __init__(self, name, start, end, low, high, first):
        self.name, self.start, self.end = name, start, end
        self.low, self.high = low, high
        self.first = first  # is it the first one of its document?

    @classmethod
    def runs(cls, words: np.ndarray, first: np.ndarray) -> Symbols:
        """Each longest run of one word is a symbol, which depends on the words before and after it."""
        n = len(words)
        new = np.ones(n, bool)
        new[1:] = (words[1:] != words[:-1]) | first[1:]
        start = np.flatnonzero(new)
        end = np.append(start[1:], n)
        name, length = words[start], end - start
        long = np.flatnonzero(length > 1)
        name[long] = mix(name[long] + length[long].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        return cls(name, start, end, start - 1, end + 1, first[start])

    def paired(self, turn: int) -> Symbols:
        """The next round: pairs of a symbol of the first class and one of the second become one symbol.

        A pair depends on its own symbols; one that is left alone depends on the neighbour it might have joined. At the
        edge of a document that neighbour is a word that no window holds.
        """
        n = len(self.name)
        second = mix(self.name + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) & ((1 << 64) - 1))) >> np.uint64(63) == 1
        joins = np.zeros(n + 1, bool)
        joins[1:n] = ~second[:-1] & second[1:] & ~self.first[1:]  # symbol i joins the one before it
        head = np.flatnonzero(~joins[:n])
        pair = joins[head + 1]
        tail = head + pair
        both = mix(self.name[head] * np.uint64(OF_WORDS) + self.name[tail] + np.uint64(turn))
        low, high = self.low[head], self.high[tail]
        alone_second, alone_first = ~pair & second[head], ~pair & ~second[head]
        before = np.where(self.first[head], self.start[head] - 1, self.low[head - 1])
        low = np.where(alone_second, np.minimum(low, before), low)
        last = np.append(self.first[1:], True)[head]
        after = np.where(last, self.end[head] + 1, self.high[np.minimum(head + 1, n - 1)])
        high = np.where(alone_first, np.maximum(high, after), high)
        return Symbols(np.where(pair, both, self.name[head]), self.start[head], self.end[tail], low, high, self.first[head])


def _least(values: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """Least value of each range ``begin`` to before ``end``; ranges hold 1 to ``most`` values."""
    tables = [values]
    while 2 << (len(tables) - 1) <= most:
        half = 1 << (len(tables) - 1)
        last = tables[-1]
        tables.append(np.minimum(last, np.append(last[half:], np.full(half, ~np.uint64(0)))))
    length = end - begin
    out = np.empty(len(begin), np.uint64)
    for k, t in enumerate(tables):
        at = np.flatnonzero((length >> k == 1) if k + 1 < len(tables) else (length >> k >= 1))
        out[at] = np.minimum(t[begin[at]], t[end[at] - (1 << k)])
    return out


def segments(words: np.ndarray, lengths: np.ndarray, width: int, rounds: int) -> tuple[np.ndarray, ...]:
    """Segments of documents whose words stand one after the other.

    Gives the name of the representative, the first word and the number of windows of each segment, by place, and the
    names of all windows, in the same order.
    """
    n, bounds = len(words), np.concatenate([[0], np.cumsum(lengths)])
    first = np.zeros(n, bool)
    first[bounds[:-1][lengths > 0]] = True
    ends = np.repeat(bounds[1:], lengths)
    window = np.flatnonzero(np.arange(n) + width <= ends)
    if not len(window):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    sums, down = spans(words, WORD_POWERS)
    whole = named(sums, down, window, window + width)
    levels = [Symbols.runs(words, first)]
    for turn in range(rounds):
        levels.append(levels[-1].paired(turn))
    chosen = np.full(len(window), -1, np.int64)
    name = np.empty(len(window), np.uint64)
    open_ = np.arange(len(window))
    for level in range(rounds, -1, -1):
        s = levels[level]
        fits = np.flatnonzero(s.high - s.low <= width)
        if not len(fits) or not len(open_):
            continue
        # Windows that begin at or before `low` and end at or after `high` hold a symbol; both grow from one to the next.
        starts = np.cumsum(np.bincount(np.maximum(s.low[fits], -1) + 1, minlength=n + 2))
        stops = np.cumsum(np.bincount(np.minimum(s.high[fits], n + 1), minlength=n + 2))
        at = window[open_]
        begin, end = starts[at], stops[at + width]  # symbols with low < start; symbols with high <= start + width
        held = np.flatnonzero(end > begin)
        if not len(held):
            continue
        begin, end, some = begin[held], end[held], open_[held]
        order = mix(s.name[fits] ^ np.uint64(level + 1)) & ~np.uint64(0xFFFFFFFF) | np.arange(len(fits), dtype=np.uint64)
        best = (_least(order, begin, end, int((end - begin).max())) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        chosen[some] = level * n + fits[best]
        name[some] = named(sums, down, s.low[fits[best]], s.high[fits[best]])
        open_ = open_[chosen[open_] < 0]
    chosen[open_] = (rounds + 1) * n + open_
    name[open_] = ~whole[open_]
    new = np.ones(len(window), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (window[1:] != window[:-1] + 1) | first[window[1:]]
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(window)))
    return name[begin], window[begin], count, whole


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Words of some texts at a time: the first and the last text, the names, the number of words of each text."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
            size += len(texts[to])
            to += 1
        some = texts[at:to]
        lengths = np.array([t.count(b" ") + 1 if t else 0 for t in some], np.int64)
        yield at, to, word_names(b" ".join(t for t in some if t)), lengths
        at = to


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # at 0x20 and 0x09 to 0x0D


def _with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def copies(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``t`` of the rows whose whole text a smaller document has."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "t", F.xxhash64(F.lit(WIDTH), "text").alias("t2"))
    first = rows.groupBy("t", "t2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return rows.join(small_or_not(materialise(first, "first")), ["t", "t2"]).where("first < doc_id").select("doc_id", "t").distinct()


def _parsed(column: pa.Array, width: int, rounds: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For some texts of a batch at a time: the text of each segment, then what :func:`segments` gives, by text."""
    texts = [b" ".join(words_of(x.as_py())) for x in column]
    for at, _, words, lengths in chunks(texts):
        k, start, count, whole = segments(words, lengths, width, rounds)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        of = np.searchsorted(bounds, start, "right") - 1
        yield of + at, k, start - bounds[of], count, whole


def names(docs: DataFrame, width: int, rounds: int) -> DataFrame:
    """``k`` of the representatives of each row's windows, each of them once a row."""

    def run(batches):
        for b in batches:
            for of, k, *_ in _parsed(b.column(0), width, rounds):
                order = np.lexsort((k, of))
                of, k = of[order], k[order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (of[1:] != of[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(k[new].view(np.int64))], ["k"])

    return arrow_map(docs.select("text"), run, "k long")


def met(docs: DataFrame, table: np.ndarray, width: int, rounds: int) -> DataFrame:
    """The segments whose names pass the filter, with the names of their windows."""

    def run(batches):
        for b in batches:
            for of, k, start, count, whole in _parsed(b.column(2), width, rounds):
                held = passes(table, k)
                n = count[held]
                offsets = np.concatenate([[0], np.cumsum(n)])
                first = np.cumsum(count) - count
                each = np.arange(offsets[-1]) + np.repeat(first[held] - offsets[:-1], n)
                rows = pa.array(of[held])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(rows), b.column(1).take(rows), pa.array(k[held].view(np.int64)), pa.array(start[held].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(whole[each].view(np.int64))),
                    ],
                    ["doc_id", "t", "k", "at", "windows"],
                )

    return arrow_map(docs.select("doc_id", "t", "text"), run, "doc_id long, t long, k long, at int, windows array<long>")


RANGES = "doc_id long, t long, at int, to int"


def _ranges(held: pa.Table, width: int) -> pa.RecordBatch:
    """Words of the rows of ``held`` (whole groups of one ``k``) that are in windows of smaller documents."""
    k, doc, at = (held[c].to_numpy() for c in ("k", "doc_id", "at"))
    windows = held["windows"].combine_chunks()
    n = np.diff(windows.offsets.to_numpy())
    w, row = windows.flatten().to_numpy(), np.repeat(np.arange(len(k)), n)
    which = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((doc[row], w, k[row]))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(k[row][order]) != 0) | (np.diff(w[order]) != 0)
    first = doc[row][order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    covered = np.zeros(len(order), bool)
    covered[order] = first < doc[row][order]
    # Windows that stand one after the other in a row make one range.
    hit = np.flatnonzero(covered)
    begins = np.ones(len(hit), bool)
    begins[1:] = (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)
    start = np.flatnonzero(begins)
    a, z = hit[start], hit[np.append(start[1:], len(hit)) - 1] if len(hit) else hit
    rows = pa.array(row[a])
    start_at = at[row[a]]
    columns = [held["doc_id"].combine_chunks().take(rows), held["t"].combine_chunks().take(rows)]
    columns += [pa.array((start_at + which[x] + more).astype(np.int32)) for x, more in ((a, 0), (z, width))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "at", "to"])


def _compared(rows: DataFrame, width: int) -> DataFrame:
    """Ranges of ``rows``, of which a name holds at most ``HOT``: a batch is kept until its last name is complete."""

    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b])
            if rest is not None:
                now = pa.concat_tables([rest, now])
            k = now["k"].to_numpy()
            cut = int(np.argmax(k == k[-1]))
            if cut:
                yield _ranges(now.slice(0, cut), width)
            rest = now.slice(cut)
        if rest is not None:
            yield _ranges(rest, width)

    return arrow_map(rows.repartition("k").sortWithinPartitions("k"), run, RANGES)


def repeats(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``t``, ``at``, ``to``: words (from 0, to before ``to``) that windows of smaller documents cover.

    ``docs``: ``doc_id``, ``t`` (a hash of the text), ``text``.
    """
    docs = docs.where("doc_id IS NOT NULL")
    shared = names(docs, width, rounds).groupBy("k").count().where("count > 1")
    shared = materialise(shared, "shared")
    n = shared.count()
    bits = 1 << max(16, min(MOST_BITS.bit_length() - 1, (max(n, 1) * BITS_PER_NAME - 1).bit_length()))
    rows = met(docs, bloom(shared.select(F.col("k").alias("seed")), bits), width, rounds)
    if n * BITS_PER_NAME > bits:
        rows = rows.join(shared.select("k"), "k", "left_semi")
    rows = materialise(rows, "met")
    hot = shared.where(F.col("count") > HOT).select("k")
    cold = _compared(rows.join(hot, "k", "left_anti").select("doc_id", "t", "k", "at", "windows"), width)
    each = rows.join(hot, "k").select("doc_id", "t", "k", "at", F.posexplode("windows").alias("i", "w"))
    least = each.groupBy("k", "w").agg(F.min("doc_id").alias("first"))
    each = each.join(least, ["k", "w"]).where("first < doc_id")
    return cold.union(each.select("doc_id", "t", F.expr("at + i").alias("at"), F.expr(f"at + i + {width}").alias("to")))


def whole(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``t``, number of words, and the digest of all words, of every row."""

    def run(batches):
        for b in batches:
            counts, shas = [], []
            for text in b.column(2):
                words = words_of(text.as_py())
                counts.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "t", "n_words", "whole"])

    return arrow_map(docs.select("doc_id", "t", "text"), run, "doc_id long, t long, n_words long, whole string")


def _texts_of(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """``docs`` joined with what ``listed`` holds for them; texts of others don't travel if ``listed`` is small."""
    listed = materialise(listed, "listed")
    held = listed.select("doc_id", "t")
    return docs.join(small_or_not(held), ["doc_id", "t"], "left_semi").join(listed, ["doc_id", "t"])


def _merged(held: pa.Scalar, n: int) -> np.ndarray:
    """For each of ``n`` words, is it in one of the ranges?"""
    v = held.values
    at, to = (v.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in range(2))
    return np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(to, minlength=n + 1))[:n] > 0


def _rest(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``t``, ``n_removed``, ``kept`` (text) of ``doc_id``, ``t``, ``text``, ``held`` (ranges)."""

    def run(batches):
        for b in batches:
            removed, kept = [], []
            for text, held in zip(b.column(2), b.column(3), strict=True):
                words = words_of(text.as_py())
                gone = _merged(held, len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(kept).cast(pa.string())], ["doc_id", "t", "n_removed", "kept"])

    return arrow_map(rows.select("doc_id", "t", "text", "held"), run, "doc_id long, t long, n_removed long, kept string")


def _cut(docs: DataFrame, width: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """All rows, parsed and marked with ``none_left``, and the documents that lose some of their words, without those."""
    same = materialise(copies(docs), "copies")
    others = docs
    if same.count() <= BROADCAST_ROWS:  # more of them are compared like all other texts, with the same result
        others = docs.join(F.broadcast(same), ["doc_id", "t"], "left_anti").select(*docs.columns)
    found = repeats(others, width, rounds).groupBy("doc_id", "t", "at").agg(F.max("to").alias("to"))
    listed = found.groupBy("doc_id", "t").agg(F.collect_list(F.struct("at", "to")).alias("held"))
    # Where ranges join up from the first word to the last, the text isn't needed.
    ordered = F.array_sort("held")
    reach = F.aggregate(ordered, F.lit(0), lambda to, r: F.when(r["at"] <= to, F.greatest(to, r["to"])).otherwise(to))
    listed = materialise(listed.withColumn("reach", reach), "ranges")
    light = materialise(whole(docs), "whole")
    light = light.join(listed.select("doc_id", "t", "reach"), ["doc_id", "t"], "left")
    light = light.join(same.withColumn("copy", F.lit(True)), ["doc_id", "t"], "left")
    light = light.withColumn("reach", F.when(F.col("copy") & (F.col("n_words") >= width), F.col("n_words")).otherwise(F.col("reach")))
    part = light.where("reach < n_words").select("doc_id", "t").distinct()
    part = listed.join(part, ["doc_id", "t"], "left_semi").select("doc_id", "t", "held")
    return light, _rest(_texts_of(docs, part))


def dedup(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and the sha256 of the words that are kept, joined by one space."""
    light, rest = _cut(_with_keys(docs, id_col, text_col), width, rounds)
    rest = rest.select("doc_id", "t", "n_removed", F.sha2("kept", 256).alias("kept_sha")).distinct()
    out = light.join(rest, ["doc_id", "t"], "left")
    return out.select(
        "doc_id", "n_words",
        F.when(F.col("reach").isNull(), 0).otherwise(F.coalesce("n_removed", "n_words")).cast("long").alias("n_removed"),
        F.when(F.col("reach").isNull(), F.col("whole")).otherwise(F.coalesce("kept_sha", F.sha2(F.lit(""), 256))).alias("kept_sha256"),
    )


def keep_first(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated words taken out of the texts; a text that loses none stays as it is."""
    keys = _with_keys(docs, id_col, text_col)
    light, rest = _cut(keys, width, rounds)
    lost = light.where("reach >= n_words").select("doc_id", "t", F.lit("").alias("kept"))
    changed = rest.select("doc_id", "t", "kept").union(lost).distinct()
    names = {"of document": F.col(id_col).cast("long"), "of text": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))}
    changed = changed.select(F.col("doc_id").alias("of document"), F.col("t").alias("of text"), F.col("kept").alias("what is kept"))
    out = docs.withColumns(names).join(changed, list(names), "left")
    return out.select(*(F.coalesce("what is kept", text_col).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


#: Every window as a text of its own.
ORACLE = f"""WITH words AS (
  SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH} + 2)) AS i FROM words
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + {WIDTH} - 1], ' ') AS words13 FROM starts
), firsts AS (
  SELECT words13, min(doc_id) AS first FROM windows GROUP BY words13
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WIDTH})) AS i FROM windows JOIN firsts USING (words13) WHERE first < doc_id
), each AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM words
), kept AS (
  SELECT doc_id, count(g.i) AS n_removed, COALESCE(string_agg(x, ' ' ORDER BY i) FILTER (g.i IS NULL), '') AS k
  FROM each LEFT JOIN gone AS g USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, sha256(COALESCE(k, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)"""
