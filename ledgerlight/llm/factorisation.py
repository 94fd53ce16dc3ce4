"""Factorisation machine over hashed terms and, if asked for, structure and metadata of a text.

    score(x) = sigmoid(bias + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The last sum is that over all pairs of features of the product of their vectors, in time linear in the features: a
pair such as an insult and the mention of a group can weigh more, or less, than both alone. All x are 0 or 1.

*Features.* A word is a run of letters, digits and characters beyond ASCII, with A-Z lowered. Terms are words and, if
asked for, their first ``beginnings`` bytes, so that words of one stem share a term; each is hashed to one of
``buckets``. That a bucket occurs once, twice, and so on up to ``levels`` times are features of their own. Structure: shares of kinds of characters, repeated lines and
words, lengths; metadata: numeric columns. Both fall into bins of powers of two, and each bin is a feature.

*Training* takes a bounded sample: the ``sample`` labelled ids with the smallest hash and one row of each, never more, so the
features collected to the driver are bounded. Buckets that say most about the label (likelihood ratio) are kept, at
most ``selected``; AdaGrad runs over the rows in an order fixed by ``seed``. Scoring reads every row and whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, remembers

#: A-Z lowered; other ASCII characters than letters and digits become spaces.
WORD_VIEW = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
#: Kinds of bytes whose shares are structure.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "bang": b"!?", "bar": b"|", "stop": b".,;:", "symbol": b"#$%&*@^~+=<>/\\_{}[]", "line": b"\n", "space": b" \t"}
BINS = 24


@dataclass(frozen=True)
class Spec:
    """What a model is given. ``metadata`` are numeric columns; those that a table lacks are taken as null."""

    structure: bool = False
    beginnings: tuple[int, ...] = ()
    levels: int = 1
    metadata: tuple[str, ...] = ()
    buckets: int = 1 << 18
    selected: int = 4096
    factors: int = 6
    sample: int = 8000
    epochs: int = 12
    rate: float = 0.15
    decay: float = 2e-4
    seed: int = 7


@dataclass
class Model:
    spec: Spec
    keys: np.ndarray  # sorted features
    bias: float
    weights: np.ndarray
    factors: np.ndarray = field(repr=False)

    def score(self, features: np.ndarray) -> float:
        at = np.searchsorted(self.keys, features)
        at = at[at < len(self.keys)] if not len(features) else at[np.append(self.keys, -1)[at] == features]
        v = self.factors[at]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        z = self.bias + float(self.weights[at].sum()) + pairs
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def share_bin(part: float, whole: float) -> int:
    """0 without any; else by powers of two of the share, the largest for all of it."""
    return 0 if part <= 0 or whole <= 0 else max(1, BINS - 1 + math.floor(2 * math.log2(min(1.0, part / whole))))


def size_bin(n: float | None) -> int:
    return 0 if n is None or n != n else 1 if n < 1 else min(BINS - 1, 2 + int(math.log2(n)))


class Terms(dict):
    """Word -> buckets of its terms, remembered for at most ``limit`` words of a worker."""

    def __init__(self, spec: Spec, limit: int = 200_000):
        super().__init__()
        self.spec, self.limit = spec, limit

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        terms = [word, *(b"\x00" + word[:n] for n in self.spec.beginnings if len(word) >= n)]
        value = self[word] = tuple(xxhash.xxh3_64_intdigest(t) % self.spec.buckets for t in terms)
        return value


_TERMS: dict[Spec, Terms] = {}
remembers(__name__, _TERMS.clear)
_COUNTED = np.zeros(256, np.int64)
for _k, _chars in enumerate(CLASSES.values()):
    _COUNTED[list(_chars)] = _k + 1


def features(text: str, numbers: tuple[float | None, ...], spec: Spec) -> np.ndarray:
    """Sorted distinct features of a text: hashed terms by level first, then bins."""
    known = _TERMS.get(spec)
    if known is None:
        known = _TERMS[spec] = Terms(spec)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(WORD_VIEW).split()
    held, times = np.unique(np.array([*chain.from_iterable(map(known.__getitem__, words))], np.int64), return_counts=True)
    out = [held * spec.levels, *(held[times > n] * spec.levels + n for n in range(1, spec.levels))]
    bins = []
    if spec.structure:
        counts = np.bincount(_COUNTED[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES) + 1)
        lines = raw.split(b"\n")
        bins = [share_bin(c, len(raw)) for c in counts[1:]]
        bins += [share_bin(len(lines) - len(set(lines)), len(lines)), share_bin(len(words) - len(set(words)), len(words))]
        bins += [size_bin(len(words)), size_bin(len(lines)), share_bin(len(words), len(raw)), share_bin(len(lines), len(words) + 1)]
    bins += [size_bin(x) for x in numbers]
    extra = [spec.buckets * spec.levels + i * BINS + b for i, b in enumerate(bins)]
    return np.sort(np.concatenate([*out, np.array(extra, np.int64)]))


def _numbers(docs: DataFrame, spec: Spec) -> list:
    return [(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast("double").alias(f"number{i}") for i, c in enumerate(spec.metadata)]


def _rows(batch: pa.RecordBatch, first: int):
    columns = [batch.column(i) for i in range(first, batch.num_columns)]
    for values in zip(*columns, strict=True):
        text, *numbers = (v.as_py() for v in values)
        yield text or "", tuple(numbers)


def sample_features(docs: DataFrame, labelled: DataFrame, spec: Spec, id_col: str, text_col: str) -> list:
    """Features and label of at most ``sample`` rows. ``labelled``: id, label; an id with two labels counts as 1."""
    known = labelled.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(spec.sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *_numbers(docs, spec))
    rows = rows.join(chosen, "id")
    # Of rows that repeat an id one is taken, the same in any order of the rows.
    values = ["text", *(f"number{i}" for i in range(len(spec.metadata)))]
    row = F.min_by(F.struct(*values), F.struct(F.xxhash64("text"), *values)).alias("row")
    rows = rows.groupBy("id").agg(F.max("label").cast("double").alias("label"), row).select("id", "label", "row.*")

    def run(batches):
        for b in batches:
            found = [features(t, n, spec).astype(np.int32).tobytes() for t, n in _rows(b, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["id", "label", "features"])

    got = arrow_map(rows, run, "id long, label double, features binary").collect()
    return sorted((r["id"], r["label"], bytes(r["features"])) for r in got)


def informative(rows: list[np.ndarray], labels: np.ndarray, most: int) -> np.ndarray:
    """Features in at least 3 rows with the largest likelihood ratio against the label, sorted."""
    space = 1 + max((int(r.max(initial=-1)) for r in rows), default=-1)
    held, ones = np.zeros(space), np.zeros(space)  # as large as there are buckets, however many rows
    for r, label in zip(rows, labels, strict=True):
        held[r] += 1
        ones[r] += label
    keys = np.flatnonzero(held >= 3)
    held, ones = held[keys], ones[keys]
    n, total = float(len(rows)), float(labels.sum())

    def term(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    ratio = term(ones, held * total / n) + term(held - ones, held * (n - total) / n)
    ratio += term(total - ones, (n - held) * total / n) + term(n - held - total + ones, (n - held) * (n - total) / n)
    fit = np.flatnonzero(ratio > 2.0)
    return np.sort(keys[fit[np.lexsort((fit, -ratio[fit]))][:most]])


def fit(rows: list, spec: Spec) -> Model:
    """Train on (id, label, packed features). Without rows every score is 0.5; with one class it is near that class."""
    labels = np.array([r[1] for r in rows], float)
    sparse = [np.frombuffer(r[2], np.int32) for r in rows]
    rng = np.random.default_rng(spec.seed)
    keys = informative(sparse, labels, spec.selected) if rows else np.empty(0, np.int64)
    d, k = len(keys), spec.factors
    bias = float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))) if rows else 0.0
    w, v = np.zeros(d), rng.normal(0, 0.02, (d, k))
    kept = [np.searchsorted(keys, s[np.isin(s, keys, assume_unique=True)]) for s in sparse]
    seen_w, seen_v, seen_b = np.full(d, 1e-6), np.full((d, k), 1e-6), 1e-6
    for _ in range(spec.epochs if d else 0):
        order = rng.permutation(len(kept))
        for part in np.array_split(order, max(1, len(order) // 64)):
            at = np.concatenate([kept[i] for i in part])
            row = np.repeat(np.arange(len(part)), [len(kept[i]) for i in part])
            sums = np.stack([np.bincount(row, v[at, f], len(part)) for f in range(k)], 1)
            squares = np.bincount(row, (v[at] ** 2).sum(1), len(part))
            z = bias + np.bincount(row, w[at], len(part)) + 0.5 * ((sums**2).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            touched = np.unique(at)
            gw = np.bincount(at, error[row], d)[touched] + spec.decay * w[touched]
            gv = np.stack([np.bincount(at, error[row] * (sums[row, f] - v[at, f]), d) for f in range(k)], 1)[touched]
            gv += spec.decay * v[touched]
            seen_w[touched] += gw**2
            seen_v[touched] += gv**2
            seen_b += float(error.sum()) ** 2
            w[touched] -= spec.rate * gw / np.sqrt(seen_w[touched])
            v[touched] -= 0.2 * spec.rate * gv / np.sqrt(seen_v[touched])
            bias -= spec.rate * float(error.sum()) / math.sqrt(seen_b)
    return Model(spec, keys, bias, w.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labelled: DataFrame, spec: Spec, id_col: str = "doc_id", text_col: str = "text") -> Model:
    return fit(sample_features(docs, labelled, spec, id_col, text_col), spec)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` of every row; a null text is scored as the empty one."""

    def run(batches):
        for b in batches:
            scores = [model.score(features(t, n, model.spec)) for t, n in _rows(b, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *_numbers(docs, model.spec))
    return arrow_map(rows, run, "doc_id long, score double")


def keep_below(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    names = docs.columns
    at = names.index(text_col)
    numbers = [names.index(c) if c in names else None for c in model.spec.metadata]

    def run(batches):
        for b in batches:
            kept = []
            for i in range(b.num_rows):
                values = tuple(None if j is None else b.column(j)[i].as_py() for j in numbers)
                kept.append(model.score(features(b.column(at)[i].as_py() or "", values, model.spec)) < threshold)
            yield b.filter(pa.array(kept, pa.bool_()))

    return arrow_map(docs, run, docs.schema)
