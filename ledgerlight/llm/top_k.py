"""Exact top-k by inner product over integer vectors, with block-at-a-time pruning.

A term is a component of a vector. Vectors are dealt to groups by ranges of their id, a group is cut into blocks of
consecutive ids. A block has a forward index (its vectors as a matrix) and the least and greatest value of each term. The
greatest product that each term of a query can have in a block, summed, bounds every score in it. A task holds a group and
a slice of the queries: for each query blocks are taken in order of the bound and scored through the forward index,
until the bounds fall below the query's k-th score. A bound equal to it is still scored, as a smaller id wins a tie. Each
query meets the group it lies in first, so all other groups start from a k-th score.

Queries are a stated set of rows against all rows: slices and groups both have a bounded size, each pair of them
is one unit of work, and k rows of a query leave it at most.

Products are summed as doubles where their sums stay below 2^53, and as Python's integers elsewhere, so scores are exact;
a score beyond 64 bits is the nearest long, and ties with others of that kind.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
shorter vectors count as if zeros followed; an empty vector scores 0; of equal scores the smaller id comes first; rows
that repeat an id are candidates of their own, but never of a query with that id, and such a query is asked once, with
the least of its vectors; empty tables give an empty one; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROOT, arrow_map, materialise

K, EVERY, FACTOR = 5, 50, 256
BLOCK, GROUP, SLICE = 256, 16_384, 2_048
LONG = (1 << 63) - 1


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id``, ``vector`` as doubles, of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def packed(rows: DataFrame) -> DataFrame:
    """The vectors as bytes of doubles."""

    def run(batches):
        for b in batches:
            values = [np.array(v, float).tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.binary())], ["vec_id", "vector"])

    return arrow_map(rows, run, "vec_id long, vector binary")


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        row = np.frombuffer(v, float)
        out[i, : len(row)] = row
    return out


def integers(*raw: np.ndarray, factor: int = FACTOR) -> list[np.ndarray]:
    """floor(factor * x) of matrices whose products are summed: as doubles if that is exact, else as Python's integers."""
    with np.errstate(over="ignore"):
        scaled = [np.floor(m * factor) for m in raw]
        most = max(1.0, float(raw[0].shape[1])) * math.prod(max(1.0, float(np.abs(m).max(initial=0.0))) for m in scaled)
    if most < 2.0**53:
        return scaled

    def whole(x: float) -> int:
        return int(x) * factor if abs(x) >= 2.0**53 else math.floor(x * factor)

    return [np.array([[whole(x) for x in row] for row in m.tolist()], object).reshape(m.shape) for m in raw]


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floors: list, block: int = BLOCK) -> list:
    """Up to k (-score, id) of each query among the vectors of a group; ``floors``: k-th scores known so far, or None."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    queries, vectors = integers(queries, vectors[order])
    cuts = range(0, len(ids), block)
    least = np.stack([vectors[c : c + block].min(0) for c in cuts])
    most = np.stack([vectors[c : c + block].max(0) for c in cuts])
    bound = np.where(queries > 0, queries, 0) @ most.T + np.where(queries < 0, queries, 0) @ least.T
    ranked = np.argsort(-bound, axis=1, kind="stable")
    kept: list[list] = [[] for _ in query_ids]
    kth, alive = list(floors), np.ones(len(query_ids), bool)
    for turn in range(len(cuts)):
        for b in np.unique(ranked[alive, turn]):
            mine = np.flatnonzero(alive & (ranked[:, turn] == b))
            own = ids[b * block : (b + 1) * block]
            scores = np.clip(queries[mine] @ vectors[b * block : (b + 1) * block].T, -LONG - 1, LONG)
            for i, row in zip(mine, scores, strict=True):
                others = np.flatnonzero((own != query_ids[i]) & (True if kth[i] is None else row >= kth[i]))
                if len(others) > k:  # equal scores at the cut all stay until ids decide
                    others = others[row[others] >= np.sort(row[others])[-k]]
                kept[i] = sorted(kept[i] + [(-int(row[j]), int(own[j])) for j in others])[:k]
                if len(kept[i]) == k:
                    kth[i] = -kept[i][-1][0] if kth[i] is None else max(kth[i], -kept[i][-1][0])
        if turn + 1 < len(cuts):  # bounds only fall from here on
            for i in np.flatnonzero(alive):
                alive[i] = kth[i] is None or bound[i, ranked[i, turn + 1]] >= kth[i]
    return kept


FOUND = "query_id long, vec_id long, score long"


def _meet(queries: DataFrame, rows: DataFrame, keys: list[str], width: int, k: int, block: int) -> DataFrame:
    """Best rows of each query within each value of ``keys``."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and held.num_rows:
            query_ids, ids = (t.column("vec_id").to_numpy() for t in (asked, held))
            q, v = (matrix(t.column("vector").to_pylist(), width) for t in (asked, held))
            kept = best_of(query_ids, q, ids, v, k, asked.column("floor").to_pylist(), block)
            out = [(int(i), j, -s) for i, found in zip(query_ids, kept, strict=True) for s, j in found]
        fields = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(c, pa.int64()) for c in fields], names=["query_id", "vec_id", "score"])

    rows.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    asked = queries.select(*keys, "vec_id", "vector", "floor").groupBy(*keys)
    return asked.cogroup(rows.select(*keys, "vec_id", "vector").groupBy(*keys)).applyInArrow(run, FOUND)


def search(
    vectors: DataFrame,
    every: int = EVERY,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = BLOCK,
    group: int = GROUP,
    slice_: int = SLICE,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k best rows for each row whose id is divisible by ``every``."""
    taking_part = valid(vectors, id_col, vector_col)
    stats = taking_part.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = stats["width"] or 0
    dealt = packed(taking_part).repartitionByRange(max(1, -(-stats["n"] // group)), "vec_id")
    rows = materialise(dealt.withColumn("group", F.spark_partition_id()), "vectors")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by(F.struct("vector", "group"), "vector").alias("x"))
    queries = materialise(queries.select("vec_id", "x.vector", F.col("x.group").alias("own")), "queries")
    sizes = rows.agg((F.max("group") + 1).alias("groups")).first()
    groups, slices = sizes["groups"] or 1, max(1, -(-queries.count() // slice_))

    nothing_yet = queries.withColumn("group", F.col("own")).withColumn("floor", F.lit(None).cast("long"))
    in_slices = F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int")
    all_slices, all_groups = F.expr(f"explode(sequence(0, {slices - 1}))"), F.expr(f"explode(sequence(0, {groups - 1}))")
    spread = rows.withColumn("slice", all_slices)
    opening = materialise(_meet(nothing_yet.withColumn("slice", in_slices), spread, ["group", "slice"], width, k, block), "best")
    floors = opening.groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    floors = floors.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("score")).alias("floor"))
    asked = queries.join(floors, "vec_id", "left").withColumn("slice", in_slices).withColumn("group", all_groups).where("group <> own")
    rest = _meet(asked, spread, ["group", "slice"], width, k, block)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = opening.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id,
    list_transform(embedding, lambda x: CAST(floor({FACTOR} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % {EVERY} = 0 AND v.vec_id <> q.vec_id
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
