"""Token ids of documents in files of independently coded blocks.

Documents are dealt to files by ranges of their id and lie in them in order, so all files in order are all documents in
order. A task tokenises its documents as one run of ids, each document closed by an end id, and cuts the run into blocks
of ``block`` ids, which :mod:`range_coder` codes on their own. A file is a Parquet file written by Spark's committers, so
a lost executor leaves no half of one; its rows are the blocks:

    file, block     number of the file and of the block in it
    begin, n_ids    place of the block's first id in the file, ids in the block
    payload         16-bit words of the coder, little-endian, then the CRC-32 of the ids as 32-bit little-endian
    documents       number in the file, id, begin and end of each document with ids in the block

Any block can be read alone. Reading gives the pieces that a document has in the blocks; checksums of the pieces are put
together by the rule for the CRC of a concatenation, so no task needs a document, or a file, as a whole.

Defined results: null and empty texts are the end id only; texts of any length are read whole; documents with the same
id lie side by side in the order of their texts, and rows repeated in full are documents of their own; rows without an id
come first; an empty table gives an empty one; further columns, whatever their names, are not read. With
``added_tokens`` the tokenizer's added tokens that a text quotes (``<|endoftext|>``) have their own ids, as by default in
the library; without, they are text like any other.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import range_coder
from .common import arrow_map, remembers, run_dir, texts

BLOCK, END = 262_144, 1
#: Documents that are tokenised at once.
TEXTS = 3000
#: Ids that are coded at once, at least, if a task has so many.
FLUSH = 6 << 20
#: Words of a text by Unicode's white space: the tokenizer drops it, and nothing is merged across it.
WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: The tokenizer's own pieces of a lower-case text, for texts whose characters are all below U+0250: its pattern with
#: the classes written out. Such a text has nothing to compose, and lower case is taken character by character; its
#: lower case has to stay below U+0250, too (that of Ɓ and 22 other capitals doesn't).
PIECE = re.compile(
    "[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f0-9\xb2\xb3\xb9\xbc-\xbe]+"
)
ALL_LATIN = re.compile("[\x00-\u012f\u0131-\u024f]*")

BLOCKS = (
    "file int, block int, begin long, n_ids int, payload binary, "
    "documents array<struct<number:long,doc_id:long,begin:long,end:long>>"
)
PIECES = "file int, number long, doc_id long, begin long, end long, at long, n long, crc long"


class Words:
    """Ids of words, remembered for about ``limit`` of them; the tokenizer is asked for the others in one batch.

    Words are what stands between white space. ``split_like_tokenizer`` says that the tokenizer's own pieces of them are
    those of ``PIECE``, wherever it can tell, which are then all asked for in one text; it says, too, that the last token
    of a piece, and no other, has the tokenizer's mark for the end of a word. With ``added_tokens`` texts are first cut
    at the tokenizer's added tokens.
    """

    def __init__(self, path: str, split_like_tokenizer: bool = True, limit: int = 700_000, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence as Steps
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.latin = split_like_tokenizer
        self.known: dict[str, bytes] = {}  # 16 bits an id
        self.limit = limit
        self.added, self.cut = {}, None
        if added_tokens:
            tokens = self.tokenizer.get_added_tokens_decoder()
            if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in tokens.values()):
                raise ValueError("added tokens are found only as they are written")
            self.added = {t.content: i for i, t in tokens.items()}
            if tokens:
                self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")")
        # For pieces that are normalised and cut already; printable ASCII stands for itself as bytes, too.
        self.bare = [Tokenizer.from_file(path) for _ in range(2)]
        by_space = CharDelimiterSplit(" ")
        for bare, steps in zip(self.bare, (by_space, Sequence([by_space, ByteLevel(add_prefix_space=False, use_regex=False)])), strict=True):
            bare.normalizer, bare.pre_tokenizer, bare.encode_special_tokens = Steps([]), steps, True
        mark = self.tokenizer.model.end_of_word_suffix
        self.closes = np.zeros(1 << 16, bool)
        self.closes[[i for token, i in self.tokenizer.get_vocab().items() if mark and token.endswith(mark)]] = True

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by the id ``end``, if any, and how many each text has."""
        parts, closing, n_parts = [], [], []
        for text in texts:
            cut = self.cut.split(text) if self.cut is not None and any(x in text for x in self.added) else [text]
            parts += map(self._spaced, cut[::2])
            closing += [self.added[x] for x in cut[1::2]]  # every second one is a token
            closing.append(-1 if end is None else end)
            n_parts.append(len(cut[::2]))
        lists = pc.ascii_split_whitespace(pa.array(parts, pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        ids_of = self._ids(coded.dictionary)
        length = np.fromiter(map(len, ids_of), np.int64, len(ids_of)) >> 1
        begin = np.cumsum(length) - length
        size = length[which]
        to = np.cumsum(size)
        at = np.repeat(begin[which] - to + size, size)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(ids_of), np.uint16)[at]
        # The id that closes each part goes behind its words.
        offsets = np.asarray(lists.offsets)
        ends = np.append(0, to)[offsets - offsets[0]][1:]
        closing = np.array(closing, np.int64)
        closed = np.flatnonzero(closing >= 0)
        out = np.insert(ids, ends[closed], closing[closed].astype(np.uint16))
        ends = ends + np.cumsum(closing >= 0)
        last = np.cumsum(n_parts, dtype=np.int64) - 1
        return out, np.diff(ends[last], prepend=0)

    def _spaced(self, text: str) -> str:
        """With the same words, only ASCII's white space between them, and if possible in lower case."""
        if text.isascii():
            return text.lower() if self.latin else text
        low = text
        if self.latin and ALL_LATIN.fullmatch(text):
            low = text.lower()
            if "\x85" not in low and "\xa0" not in low:
                return low
        return " ".join(WORD.findall(low) if any(c in low for c in "\x1c\x1d\x1e\x1f") else low.split())

    def _ids(self, distinct: pa.Array) -> list[bytes]:
        words = distinct.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if len(self.known) + len(missing) > self.limit:
            self.known = {w: ids for w, ids in zip(words, found, strict=True) if ids is not None}
        new = [words[i] for i in missing]
        whole, cut, others = [], {}, []
        if self.latin:  # a to z only: one piece
            letters = pc.and_(pc.ascii_is_alpha(distinct), pc.ascii_is_lower(distinct)).to_numpy(zero_copy_only=False)[missing]
            whole, new = list(compress(new, letters)), list(compress(new, ~letters))
        for w in new:
            low = w.lower()
            if not self.latin or not (w.isascii() or ALL_LATIN.fullmatch(w) and ALL_LATIN.fullmatch(low)):
                others.append(w)
            elif low == w and w.isalpha():
                whole.append(w)
            else:
                cut[w] = PIECE.findall(low)
        for w, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, np.uint16).tobytes()
        # A piece is a word, too.
        self._learn(list({p for p in chain.from_iterable(cut.values()) if p not in self.known}.union(whole)))
        known = self.known.__getitem__
        for w, pieces in cut.items():
            self.known[w] = b"".join(map(known, pieces))
        for i in missing:
            found[i] = known(words[i])
        return found

    def _learn(self, pieces: list[str]) -> None:
        plain = [p.isascii() and p.isprintable() for p in pieces]
        for bare, some in zip(self.bare, (list(compress(pieces, plain)), [p for p, x in zip(pieces, plain, strict=True) if not x]), strict=True):
            if not some:
                continue
            ids = np.array(bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint16)
            ends = 2 * (np.flatnonzero(self.closes[ids]) + 1)
            if len(ends) != len(some):
                raise ValueError("the tokenizer doesn't mark the end of each piece")
            raw, ends = ids.tobytes(), ends.tolist()
            self.known.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))


_WORDS: dict[tuple[str, bool], Words] = {}
remembers(__name__, _WORDS.clear)


def tokenizer(path: str, added_tokens: bool = False) -> Words:
    if (path, added_tokens) not in _WORDS:
        _WORDS[path, added_tokens] = Words(path, added_tokens=added_tokens)
    return _WORDS[path, added_tokens]


def _rows(file: int, first_block: int, begin: int, blocks: list[np.ndarray], docs: list[tuple]) -> pa.RecordBatch:
    payloads = range_coder.encode(blocks)
    out, at, k = [], begin, 0
    for i, (ids, payload) in enumerate(zip(blocks, payloads, strict=True)):
        end = at + len(ids)
        while k < len(docs) and docs[k][3] <= at:
            k += 1
        held, j = [], k
        while j < len(docs) and docs[j][2] < end:
            held.append(dict(zip(("number", "doc_id", "begin", "end"), docs[j], strict=True)))
            j += 1
        out.append({"file": file, "block": first_block + i, "begin": at, "n_ids": len(ids), "payload": payload, "documents": held})
        at = end
    doc = pa.struct([("number", pa.int64()), ("doc_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
    types = [("file", pa.int32()), ("block", pa.int32()), ("begin", pa.int64()), ("n_ids", pa.int32()), ("payload", pa.binary()), ("documents", pa.list_(doc))]
    return pa.RecordBatch.from_pylist(out, schema=pa.schema(types))


def blocks_of(docs: DataFrame, path: str, block: int, end: int, id_col: str, text_col: str, added_tokens: bool) -> DataFrame:
    """Coded blocks of the documents, dealt to files by ranges of their id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        file, words = TaskContext.get().partitionId(), tokenizer(path, added_tokens)
        rest, rest_n, done, number, held, full = [], 0, 0, 0, [], FLUSH // block * block or block

        def flush(last: bool):
            nonlocal rest, rest_n, done, held
            ids = np.concatenate(rest) if rest else np.empty(0, np.uint16)
            cut = len(ids) if last else len(ids) // block * block
            if cut:
                yield _rows(file, done // block, done, [ids[i : min(i + block, cut)] for i in range(0, cut, block)], held)
            rest, rest_n, done = [ids[cut:]], len(ids) - cut, done + cut
            held = [d for d in held if d[3] > done]

        for b in batches:
            for i in range(0, len(b), TEXTS):
                some = b.slice(i, TEXTS)
                ids, sizes = words.encode_all(list(texts(some.column(1))), end)
                ends = done + rest_n + np.cumsum(sizes)
                held += zip(range(number, number + len(some)), some.column(0).to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True)
                rest.append(ids)
                rest_n += len(ids)
                number += len(some)
                if rest_n >= full:
                    yield from flush(False)
        yield from flush(True)

    return arrow_map(dealt, run, BLOCKS)


def write(
    docs: DataFrame,
    folder: str,
    path: str,
    block: int = BLOCK,
    end: int = END,
    id_col: str = "doc_id",
    text_col: str = "text",
    added_tokens: bool = False,
) -> None:
    """Write the ids of every whole text; the tokenizer file is ``path``."""
    blocks_of(docs, path, block, end, id_col, text_col, added_tokens).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(folder)


def decoded(blocks: DataFrame) -> DataFrame:
    """``file``, ``block``, ``begin``, ``ids`` of each block."""

    def run(batches):
        for b in batches:
            ids = range_coder.decode(b.column(3).to_pylist(), b.column(4).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["file", "block", "begin", "ids"])

    return arrow_map(blocks.select("file", "block", "begin", "payload", "n_ids"), run, "file int, block int, begin long, ids array<int>")


def pieces(blocks: DataFrame) -> DataFrame:
    """A row for each document and block it has ids in: their number and CRC-32."""

    def run(batches):
        _WORDS.clear()  # reading needs none
        for b in batches:
            columns = {f.name: b.column(i).to_pylist() for i, f in enumerate(b.schema)}
            out = []
            coded = range_coder.decode(columns["payload"], columns["n_ids"])
            for file, begin, ids, docs in zip(columns["file"], columns["begin"], coded, columns["documents"], strict=True):
                raw = ids.astype("<u4")
                for d in docs:
                    at, to = max(begin, d["begin"]), min(begin + len(ids), d["end"])
                    crc = zlib.crc32(raw[at - begin : to - begin].tobytes())
                    out.append((file, d["number"], d["doc_id"], d["begin"], d["end"], at, to - at, crc))
            fields = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.int32()] + [pa.int64()] * 7
            names = ["file", "number", "doc_id", "begin", "end", "at", "n", "crc"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(fields, kinds, strict=True)], names)

    return arrow_map(blocks, run, PIECES)


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


#: What 1, 2, 4, ... zero bytes make of a CRC-32, as matrices over bits; made when first needed.
_ZEROS: list[list[int]] = []


def _zeros(k: int) -> list[int]:
    while len(_ZEROS) <= k:
        last = _ZEROS[-1] if _ZEROS else None
        if last is None:
            last = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit; three squarings make a byte
            for _ in range(3):
                last = [_times(last, x) for x in last]
            _ZEROS.append(last)
        else:
            _ZEROS.append([_times(last, x) for x in last])
    return _ZEROS[k]


def crc_of_both(a: int, b: int, length: int) -> int:
    """CRC-32 of two strings put together, from theirs and the bytes in the second."""
    k = 0
    while length:
        if length & 1:
            a = _times(_zeros(k), a)
        length >>= 1
        k += 1
    return a ^ b


def documents(blocks: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, from the blocks."""
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    found = pieces(blocks).groupBy("file", "number").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("begin").alias("begin"),
        F.sum("n").alias("n_tokens"),
        F.collect_list(F.struct("at", "n", "crc")).alias("parts"),
    )
    found = found.join(files, "file").select("doc_id", (F.col("offset") + F.col("begin")).alias("start"), "n_tokens", F.array_sort("parts").alias("parts"))

    def run(batches):
        for b in batches:
            crcs = []
            for parts in b.column(3).to_pylist():
                crc = parts[0]["crc"]
                for p in parts[1:]:
                    crc = crc_of_both(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(found, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the files into the shared folder and read the documents back from them."""
    folder = run_dir(docs.sparkSession, "tokens")
    write(docs, folder, path, **options)
    return documents(read(docs.sparkSession, folder))
