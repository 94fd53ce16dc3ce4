"""Secret scans: an Aho-Corasick prefilter, anchored expressions at its hits only, then checksums.

One automaton finds the keywords that every assignment, access key or prefixed token begins with, in the text with A-Z
lowered; another finds runs of hexadecimal digits in a view of the text in which each such digit is the same letter.
An expression is tried only where a hit says that it could begin, and only from there (``match`` at a position), so its
cost follows the hits and not the text. Matches of a kind are taken leftmost first and don't overlap; a hit inside a
match that was taken, or taken and then dropped for its length, is passed over. Tokens that carry a checksum are kept
only if it is right, so look-alikes are left alone.

Defined results: a null or empty text has no spans, and the digest is that of the empty string; texts of any length are
read whole; equal rows give equal rows; a null id stays null; an empty table gives an empty one; further columns,
whatever their names, are not read (``redact`` hands them on as they are). Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map, texts

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = 3

# The expressions that define the base kinds and the published forms of the tokens with a checksum.
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEYWORDS = {
    "password": 0, "passwd": 0, "secret": 0, "token": 0, "apikey": 0, "api_key": 0, "akia": 1,
    "ghp_": 3, "gho_": 3, "ghu_": 3, "ghs_": 3, "ghr_": 3, "npm_": 4,
}
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: A view of the text in which hexadecimal digits are "h" and all other ASCII characters are ".".
HEX_VIEW = bytes(104 if chr(b) in "0123456789abcdef" else 46 if b < 128 else b for b in range(256))

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base62_crc(text: str) -> str:
    value, out = zlib.crc32(text.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = DIGITS62[digit] + out
    return out


def _long_enough(m: re.Match) -> bool:
    return len(m[1]) >= LEAST_VALUE


def _access(m: re.Match) -> bool:
    return len(m[0]) >= LEAST_ACCESS


def _checksum(m: re.Match) -> bool:
    return base62_crc(m[1]) == m[2]


ANCHORED = {0: (ASSIGN, _long_enough), 1: (ACCESS, _access), 3: (GITHUB, _checksum), 4: (NPM, _checksum)}


class Scanner:
    def __init__(self):
        self.words = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            self.words.add_word(word, (kind, len(word)))
        self.words.make_automaton()
        self.runs = ahocorasick.Automaton()
        self.runs.add_word("h" * LEAST_HEX, LEAST_HEX)
        self.runs.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) in order."""
        if not text:
            return []
        raw = text.encode("utf-8", "surrogatepass")
        found, past = [], [0] * len(KINDS)
        hits = [(end + 1 - n, kind) for end, (kind, n) in self.words.iter(raw.lower().decode("utf-8", "surrogatepass"))]
        for start, kind in sorted(hits):
            if start < past[kind]:
                continue
            expression, right = ANCHORED[kind]
            m = expression.match(text, start)
            if m:
                past[kind] = m.end()
                if right(m):
                    found.append((start, kind, m.end()))
        for end, n in self.runs.iter(raw.translate(HEX_VIEW).decode("utf-8", "surrogatepass")):
            if end >= past[2]:  # the first hit in a run is at its beginning
                m = HEX.match(text, end + 1 - n)
                past[2] = m.end()
                found.append((m.start(), 2, m.end()))
        return sorted(found)


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans of each document."""

    def run(batches):
        use = scanner()
        for b in batches:
            rows = [use.spans(t) for t in texts(b.column(1))]
            counts = [pa.array([sum(s[1] == k for s in r) for r in rows], pa.int64()) for k in range(BASE)]
            digests = [hashlib.sha256(listed([s for s in r if s[1] < BASE]).encode()).hexdigest() for r in rows]
            columns = [b.column(0), *counts, pa.array(digests, pa.string()), pa.array(map(listed, rows), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return arrow_map(docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text"), run, SCHEMA)


def blanked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; each span, or run of overlapping spans, of the text is replaced by ``mark``.

    ``length_col`` is brought up to date where a text changed, if it holds whole numbers of any width. A null text stays null.
    """
    names = docs.columns
    at, n_at = names.index(text_col), names.index(length_col) if length_col in names else None
    whole = None if n_at is None else isinstance(docs.schema[n_at].dataType, T.IntegralType)

    def run(batches):
        use = scanner()
        for b in batches:
            column = b.column(at)
            new = [t and blanked(t, use.spans(t), mark) for t in (v.as_py() for v in column)]
            arrays = [b.column(i) for i in range(b.num_columns)]
            arrays[at] = pa.array(new, column.type)
            if whole:
                old = zip(column, new, b.column(n_at), strict=True)
                arrays[n_at] = pa.array([n.as_py() if t.as_py() == u else len(u) for t, u, n in old], b.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return arrow_map(docs, run, docs.schema)
