"""Byte-level BPE: a lazily determinised transducer encodes, a UTF-8 state machine decodes as a stream.

A piece is what the pre-tokenising pattern matches; merges never cross pieces.

*Encoding.* Two tokens are *compatible* if merging the bytes of both gives just these two. A sequence of tokens is what
the merges give exactly if all neighbours are compatible, so every prefix of a piece has one last token: the one that
ends there and is compatible with the last token of the prefix before it. While bytes are read, a state of the
transducer is all that the future can depend on: the last tokens of the positions that a later token may still start
from. A step to the next byte is worked out once, when it is first needed, and is a table entry from then on. Tokens on
which all open positions agree are emitted at once; the open ones are never more than the longest token has bytes, so
the lookahead is bounded.

*Decoding.* Bytes of the tokens are joined; a state machine over byte classes tells how many bytes at the end of a chunk
belong to a character that goes on in the next one, so that text can be handed out chunk by chunk.

Defined results: null and empty texts have no tokens and decode to no bytes; texts of any length are read as a stream
of pieces; repeated rows and ids give repeated rows; a null id stays null; an empty table gives an empty one; further
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .common import arrow_map, remembers, texts

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TOKENS_SCHEMA = "doc_id long, ids array<int>"


BYTES = [bytes((b,)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Bytes of a piece to ids.

    What a worker remembers is bounded by ``max_edges`` (some 370 bytes each, with their states), ``max_pieces`` (some 230
    bytes each, in two generations of that size) and ``max_pairs`` (some 140 bytes each): about 330 MB. All of it is
    numbers, bytes and tuples of them, which no cycles tie together, so what is forgotten is freed at once.
    """

    #: States are told apart by the last emitted token itself only if more tokens than this could follow it.
    FOLLOWERS = 24

    def __init__(self, ranks: dict[bytes, int], max_edges: int = 400_000, max_pieces: int = 200_000, max_pairs: int = 600_000):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        # Beginning of tokens -> the tokens that go on from it, or None if they are many.
        self.beginnings: dict[bytes, tuple[int, ...] | None] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                held = self.beginnings.get(token[:k], ())
                self.beginnings[token[:k]] = held + (rank,) if held is not None and len(held) < self.FOLLOWERS else None
        self.max_edges, self.max_pieces, self.max_pairs = max_edges, max_pieces, max_pairs
        self.pairs: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self._forget()

    def _forget(self) -> None:
        # A state: the token emitted last, the bytes since then, and the last token of each prefix of these bytes.
        # An edge: 256 * state + byte -> 2 ** 24 * next state + number of the emitted tokens.
        self.states: list[tuple[int, bytes, tuple[int, ...]]] = [(-1, b"", ())]
        self.numbers: dict[tuple, int] = {}
        self.edges: dict[int, int] = {}
        self.outputs: list[tuple[int, ...]] = [()]
        self.output_numbers: dict[tuple[int, ...], int] = {(): 0}

    def _number(self, state: tuple[int, bytes, tuple[int, ...]]) -> int:
        """The state's number. Of the token emitted last only matters which tokens may not follow it."""
        before, data, last = state
        followers = self.beginnings.get(data) if data else None
        if followers is not None:
            key = tuple([t for t in followers if not self.compatible(before, t)]), last
        else:
            key = before, last
        number = self.numbers.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def merged(self, data: bytes, before: int = 1 << 60) -> list[int]:
        """The merges of rank less than ``before``, in order of rank, over the few bytes of a token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            found = [ranks.get(x + y, 1 << 60) for x, y in zip(parts, parts[1:], strict=False)]
            rank = min(found)
            if rank >= before:
                break
            at = found.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """What the last merge of a token joined; None for a single byte. A token that no merges lead to isn't used."""
        known = self.split.get(token, ())
        if known == ():
            data = self.bytes_of[token]
            known = None
            if len(data) > 1:
                left = self.merged(data, before=token)
                known = (left[0], left[1]) if len(left) == 2 else (-1, -1)
            self.split[token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Would the merges leave these neighbours as they are?

        The merges beside the seam are undone, the latest first. If the parts that then meet at the seam could
        have merged before the one just undone, they would have.
        """
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            known = self.pairs[pair] = self.halves(right) != (-1, -1) and (left < 0 or self.seam_holds(left, right))
        return known

    def seam_holds(self, x: int, y: int) -> bool:
        bytes_of, before = self.bytes_of, 1 << 60
        while True:
            if self.ranks.get(bytes_of[x] + bytes_of[y], 1 << 60) < before:
                return False
            of_x, of_y = self.halves(x), self.halves(y)
            if of_x and (x > y or not of_y):
                before, x = x, of_x[1]
            elif of_y:  # among equal ranks the leftmost merges first
                before, y = y + 1, of_y[0]
            else:
                return True

    def step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """The next state, and the tokens that are certain once this byte is read."""
        emitted_last, data, last = state
        data += BYTES[byte]
        n, beginnings = len(data), self.beginnings
        for k in range(max(0, n - self.longest), n):
            token = self.ranks.get(data[k:])
            if token is not None and self.compatible(last[k - 1] if k else emitted_last, token):
                break
        else:
            raise ValueError("a byte is missing in the vocabulary")
        last += (token,)
        if data in beginnings:  # a longer token may still start where these bytes start
            return (emitted_last, data, last), ()
        # All positions where the next token could start; what their chains of tokens have in common is certain.
        length, path = self.length, None
        for p in range(max(1, n - self.longest + 1), n + 1):
            if p == n or data[p:] in beginnings:
                if path is None:
                    path = self.chain(last, p)
                    continue
                while p and p not in path:
                    p -= length[last[p - 1]]
                if not p:
                    return (emitted_last, data, last), ()
                del path[path.index(p) + 1 :]
        cut = path[-1]
        return (last[cut - 1], data[cut:], last[cut:]), tuple([last[p - 1] for p in path])

    def chain(self, last: tuple[int, ...], p: int) -> list[int]:
        """Ends of the tokens that make up the first ``p`` bytes."""
        out = []
        while p > 0:
            out.append(p)
            p -= self.length[last[p - 1]]
        out.reverse()
        return out

    def _edge(self, state: int, byte: int) -> int:
        after, emitted = self.step(self.states[state], byte)
        output = self.output_numbers.setdefault(emitted, len(self.outputs))
        if output == len(self.outputs):
            self.outputs.append(emitted)
        edge = self.edges[state << 8 | byte] = self._number(after) << 24 | output
        return edge

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece) or self.older.get(piece)
        if ids is None:
            if len(self.edges) >= self.max_edges:
                self._forget()
            out: list[int] = []
            state, known, outputs = 0, self.edges.get, self.outputs
            for byte in piece.encode():
                edge = known(state << 8 | byte)
                if edge is None:
                    edge = self._edge(state, byte)
                state = edge >> 24
                if edge & 0xFFFFFF:
                    out += outputs[edge & 0xFFFFFF]
            last = self.states[state][2]
            out += [last[p - 1] for p in self.chain(last, len(last))]
            ids = tuple(out)
        if len(piece) <= 64:
            # Two generations: a piece that is met again moves to the younger one, so common pieces are never forgotten.
            if len(self.pieces) >= self.max_pieces:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = ids
        return ids


#: ``public_tokenizers.PATTERN`` for texts whose characters are all below U+0250, with the classes written out: letters,
#: numbers, white space. Letters come first; no other branch can match where one of them begins.
LATIN = re.compile(
    " ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+"
    "| ?[^\t-\r \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f0-9\xb2\xb3\xb9\xbc-\xbe]+"
    "|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)
ALL_LATIN = re.compile("[\x00-\u024f]*")


class Encoder:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.transducer = Transducer(load_ranks(path))
        self.pattern = regex.compile(pattern)
        self.latin = LATIN if pattern == public_tokenizers.PATTERN else None

    def encode(self, text: str) -> list[int]:
        pattern = self.latin if self.latin and ALL_LATIN.fullmatch(text) else self.pattern
        ids: list[int] = []
        encode, known = self.transducer.encode_piece, self.transducer.pieces.get
        for piece in pattern.findall(text):
            ids += known(piece) or encode(piece)
        return ids


#: Bytes that follow a leading byte of a character.
FOLLOWING = [0 if b < 0xC2 else 1 if b < 0xE0 else 2 if b < 0xF0 else 3 if b < 0xF5 else 0 for b in range(256)]


def open_bytes(data: bytes) -> int:
    """How many bytes at the end begin a character that isn't complete: 0 to 3."""
    for back in range(1, min(3, len(data)) + 1):
        byte = data[-back]
        if byte < 0x80:
            return 0
        if byte >= 0xC0:
            return back if FOLLOWING[byte] >= back else 0
    return 0


class Decoder:
    """Ids to bytes or, as a stream, to text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def whole_characters(self, chunks: Iterable[Iterable[int]]) -> Iterator[bytes]:
        """Bytes for each chunk of ids; a character cut by the end of a chunk comes with the next one."""
        rest = b""
        for ids in chunks:
            data = rest + self.bytes(ids)
            cut = len(data) - open_bytes(data)
            rest = data[cut:]
            yield data[:cut]
        if rest:
            yield rest

    def stream(self, chunks: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text for each chunk of ids."""
        for data in self.whole_characters(chunks):
            yield data.decode("utf-8", errors="replace")


_ENCODERS: dict[tuple[str, str], Encoder] = {}
remembers(__name__, _ENCODERS.clear)


def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """One encoder for each worker and vocabulary."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` of every whole text."""

    def run(batches):
        use = encoder(path)
        for b in batches:
            ids = [use.encode(t) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text"), run, TOKENS_SCHEMA)


def decode_documents(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``text`` from ``doc_id``, ``ids``; the inverse of :func:`encode_documents`."""

    def run(batches):
        decoder = Decoder(encoder(path).transducer.ranks)
        for b in batches:
            out = ["".join(decoder.stream([ids.as_py() or []])) for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return arrow_map(tokens.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids, and return digests of both instead of shipping them.

    Ids are decoded in chunks as they would be from a stream.
    """

    def run(batches):
        use = encoder(path)
        decoder = Decoder(use.transducer.ranks)
        digits = [str(i) for i in range(max(use.transducer.bytes_of) + 1)]
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in texts(b.column(1)):
                ids = use.encode(text)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                decoded = hashlib.sha256()
                for chunk in decoder.whole_characters(ids[i : i + 8192] for i in range(0, len(ids), 8192)):
                    decoded.update(chunk)
                text_sha.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return arrow_map(docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text"), run, SCHEMA)
