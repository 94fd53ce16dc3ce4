"""Merkle manifest of a table: one hash over all rows, and for every row a proof that it belongs to it.

Every row is a leaf; the leaves of a group (a language) are put in order and paired up level by level to a subroot, the
subroots of all groups likewise to the root. A proof of a leaf is the list of the siblings on its way to the root.

*Trees.* Ranks come from a range partitioning by (group, id, leaf) and the sizes of its parts, so neither a large group
nor a repeated id is one task's work. Up to eight levels are folded at a time over aligned runs of 256 nodes.

*Proofs by pointer jumping.* Each node starts with the segment of its own sibling, which reaches to its parent. Then a
self-join lets it take over the segment of the node it reaches to, and the distance doubles; a node that no leaf jumps
through any more is left out of the next round. After about log2(depth) rounds every leaf holds its whole way to the
subroot, and the subroot's own segment takes it on to the root. Each round is written to the shared folder. In late
rounds few nodes serve many leaves; these are broadcast, behind a count, so that a hash of few keys never gathers all
leaves in a few tasks.

Defined results: a null value counts as ``-`` in a leaf; a null id comes first in its group and a null group first of
all groups; rows with the same id are ordered by their leaf, and rows repeated in full are leaves of their own; a lone
leaf is its subroot, and a lone subroot the root; an empty table gives an empty result; texts of any length are hashed as
a whole; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_or_not

#: What makes up a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that are folded over one run of nodes.
FOLD = 8
#: Most nodes that are sent to all executors in a round; each holds at most 33 bytes for a level.
FEW_NODES = 50_000
#: One row in so many is tampered with in the query.
EVERY = 7


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """Length in bytes, colon, value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return digest(*(field(columns[name]) for name in FIELDS))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``rank``, from 0, by ``order``; equal rows must differ in the last column of it to be spread."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = materialise(dealt, name).withColumn("part", F.shiftright("at", 33))
    parts = dealt.groupBy("part").agg(F.count("*").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))  # one row a task
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    return dealt.join(F.broadcast(parts), "part").withColumn("rank", rank).drop("part", "at", "before")


def _parents(level: Column) -> Column:
    """Hashes of the pairs of one run; a last node without a partner is hashed alone."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: digest(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit(""))))


def trees(leaves: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and roots of one tree for each ``g``.

    ``leaves``: ``g``, ``n`` (leaves of the tree), ``j`` (place from 0), ``h`` (hex); ``most`` is the largest ``n``.
    Nodes: ``g``, ``level``, ``j``, ``seg`` – an array with the sibling, empty bytes if there is none – for all but the
    roots. Roots: ``g``, ``h``.
    """
    depth = max(most - 1, 0).bit_length()
    depth_of = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0).cast("int")
    base, nodes, roots = leaves.select("g", "j", "h", depth_of.alias("left")), [], []
    for low in range(0, max(depth, 1), FOLD):
        runs = base.groupBy("g", F.shiftright("j", FOLD).alias("run"))
        runs = runs.agg(F.first("left").alias("left"), F.transform(F.sort_array(F.collect_list(F.struct("j", "h"))), lambda c: c["h"]).alias("l0"))
        for k in range(1, FOLD + 1):
            runs = runs.withColumn(f"l{k}", F.when(F.col("left") >= k, _parents(F.col(f"l{k - 1}"))).otherwise(F.array().cast("array<string>")))
        runs = materialise(runs, "levels")
        for k in range(FOLD):
            level = runs.where(F.col("left") > k).select("g", "run", f"l{k}", F.posexplode(f"l{k}").alias("at", "h"))
            sibling = F.coalesce(F.unhex(F.get(F.col(f"l{k}"), F.col("at").bitwiseXOR(1))), F.lit(b""))
            place = F.shiftleft("run", FOLD - k) + F.col("at")
            nodes.append(level.select("g", F.lit(low + k).alias("level"), place.alias("j"), F.array(sibling).alias("seg")))
        top = F.element_at(F.array(*(F.get(f"l{k}", F.lit(0)) for k in range(FOLD + 1))), F.col("left") + 1)
        roots.append(runs.where(F.col("left") <= FOLD).select("g", top.alias("h")))
        base = runs.where(F.col("left") > FOLD).select("g", F.col("run").alias("j"), F.get(f"l{FOLD}", F.lit(0)).alias("h"), (F.col("left") - FOLD).alias("left"))
    out, ends = nodes[0], roots[0]
    for more in nodes[1:]:
        out = out.union(more)
    for more in roots[1:]:
        ends = ends.union(more)
    return out, ends


def jump(nodes: DataFrame, most: int) -> DataFrame:
    """``g``, ``j``, ``seg`` of the leaves, with all siblings up to the root of their tree."""
    depth, reach = max(most - 1, 0).bit_length(), 1
    while reach < depth:
        # A leaf that has jumped over `reach` levels stands at a level that is a multiple of it.
        stays, served = F.col("level") % (2 * reach) == 0, F.col("level") % (2 * reach) == reach
        above = nodes.where(served).select("g", F.col("level").alias("to_level"), F.col("j").alias("to"), F.col("seg").alias("more"))
        below = nodes.where(stays).withColumn("to_level", F.col("level") + reach).withColumn("to", F.shiftright("j", reach))
        joined = below.join(small_or_not(above, FEW_NODES), ["g", "to_level", "to"], "left")
        seg = F.when(F.col("more").isNull(), F.col("seg")).otherwise(F.concat("seg", "more"))
        nodes = materialise(joined.select("g", "level", "j", seg.alias("seg")), "jump")
        reach *= 2
    return nodes.where("level = 0").select("g", "j", "seg")


def _hex(siblings: str) -> str:
    return f"transform({siblings}, x -> lower(hex(x)))"


def _fold(start: str, place: str, siblings: str) -> str:
    """SQL of the root that follows from a leaf's hash, its place and its siblings from below."""
    steps = f"transform({siblings}, (x, k) -> struct(shiftright({place}, k) % 2 = 1 AS right, lower(hex(x)) AS s))"
    return f"aggregate({steps}, {start}, (h, x) -> CASE WHEN x.right THEN sha2(concat(x.s, h), 256) ELSE sha2(concat(h, x.s), 256) END)"


def proofs(leaves: DataFrame, group: str = "lang", order: str = "doc_id") -> DataFrame | None:
    """Every leaf with its way to the root; None for an empty table.

    ``leaves``: ``leaf`` (32 bytes), the columns ``group`` and ``order``, and what else is to be kept. Added are ``root``,
    ``subroot``, ``place`` and ``siblings`` (in the tree of the group), ``top_place`` and ``top_siblings`` (above it).
    """
    kept = leaves.columns
    # Rows repeated in full differ in `salt`, so a range partitioning can part them.
    leaves = materialise(leaves.withColumn("salt", F.monotonically_increasing_id()), "leaves")
    rows = ranked(leaves, [group, order, "leaf", "salt"], "ranked")
    groups = materialise(rows.groupBy(group).agg(F.min("rank").alias("g"), F.count("*").alias("n")), "groups")
    counts = groups.agg(F.max("n"), F.count("*")).first()
    if not counts[1]:
        return None
    rows = rows.withColumn("h", F.lower(F.hex("leaf"))).alias("r")
    held = groups.withColumnRenamed(group, "the group")
    rows = rows.join(held, F.col(f"r.{group}").eqNullSafe(F.col("the group"))).withColumn("j", F.col("rank") - F.col("g"))
    nodes, roots = trees(rows.select("g", "n", "j", "h"), counts[0])
    segments = jump(materialise(nodes, "nodes"), counts[0])
    places = ranked(roots.select("g", "h"), ["g"], "subroots")  # a group's first rank keeps the order of the groups
    top = places.select(F.lit(0).cast("long").alias("g"), F.lit(counts[1]).alias("n"), F.col("rank").alias("j"), "h")
    top_nodes, top_roots = trees(top, counts[1])
    above = jump(materialise(top_nodes, "nodes"), counts[1]).select(F.col("j").alias("rank"), F.col("seg").alias("top_siblings"))
    root = top_roots.first()["h"]
    nothing = F.array().cast("array<binary>")
    places = places.join(above, "rank", "left").select(
        "g", F.col("h").alias("subroot"), F.col("rank").alias("top_place"), F.coalesce("top_siblings", nothing).alias("top_siblings")
    )
    out = rows.join(segments, ["g", "j"], "left").join(places, "g")
    return out.select(
        *(f"r.{c}" for c in kept), F.lit(root).alias("root"), "subroot", F.col("j").alias("place"),
        F.coalesce("seg", nothing).alias("siblings"), "top_place", "top_siblings",
    )


def folded(start: str) -> Column:
    """The root that follows from the hash in the SQL expression ``start`` and the row's own proof."""
    return F.expr(_fold(_fold(start, "place", "siblings"), "top_place", "top_siblings"))


MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verified(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """The manifest of ``documents``, checked against rows of which one in ``every`` has a wrong ``n_chars``."""
    columns = {name: F.col(name) for name in FIELDS}
    wrong = leaf(columns | {"n_chars": F.col("n_chars").cast("long") + 1})
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % every == 0, wrong)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.unhex(leaf(columns)).alias("leaf"), F.unhex(tampered).alias("tampered"))
    found = proofs(rows)
    if found is None:
        return docs.sparkSession.createDataFrame([], MANIFEST)
    proof = F.expr(f"sha2(concat(array_join({_hex('siblings')}, ''), array_join({_hex('top_siblings')}, '')), 256)")
    out = found.withColumn("proof_sha256", proof).withColumn("folded_root", folded("lower(hex(coalesce(tampered, leaf)))"))
    return out.select("doc_id", F.lower(F.hex("leaf")).alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _value(name: str) -> str:
    return f"COALESCE(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


def _sql_levels(name: str, source: str) -> str:
    """Recursive levels of the trees in ``source`` (g, j, h)."""
    return f"""{name} AS (
  SELECT g, 0 AS level, j, h, count(*) OVER (PARTITION BY g) AS held FROM {source}
  UNION ALL
  SELECT g, level + 1, j // 2, sha256(string_agg(h, '' ORDER BY j)), (any_value(held) + 1) // 2
  FROM {name} WHERE held > 1 GROUP BY g, level, j // 2
)"""


def _sql_steps(levels: str, leaves: str) -> str:
    return f"""SELECT a.g, a.j, list(CASE WHEN s.h IS NULL THEN '=' WHEN (a.j >> l.level) % 2 = 1 THEN '<' || s.h ELSE '>' || s.h END ORDER BY l.level) AS steps
  FROM {leaves} AS a JOIN (SELECT DISTINCT g, level FROM {levels} WHERE held > 1) AS l ON a.g = l.g
  LEFT JOIN {levels} AS s ON s.g = a.g AND s.level = l.level AND s.j = xor(a.j >> l.level, 1)
  GROUP BY a.g, a.j"""


#: Without a repeated ``doc_id``; CRC-32 is written out bit by bit, as the database has none.
ORACLE = f"""WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({" || ".join(map(_value, FIELDS))}) AS h,
    sha256({" || ".join(_value(n) if n != "n_chars" else _value("(n_chars + 1)") for n in FIELDS)}) AS wrong,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % {EVERY} = 0 AS tampered,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS j
  FROM documents
), {_sql_levels("levels", "leaves")}, subroots AS (
  SELECT 0 AS g, g AS j, h FROM levels WHERE held = 1
), {_sql_levels("tops", "subroots")}, steps AS (
  {_sql_steps("levels", "leaves")}
), top_steps AS (
  {_sql_steps("tops", "subroots")}
), proofs AS (
  SELECT a.doc_id, a.h AS leaf, r.h AS subroot, t.h AS root,
    CASE WHEN a.tampered AND a.wrong IS NOT NULL THEN a.wrong ELSE a.h END AS start,
    list_concat(COALESCE(s.steps, []), COALESCE(u.steps, [])) AS way
  FROM leaves AS a LEFT JOIN steps AS s ON s.g = a.g AND s.j = a.j
  JOIN subroots AS r ON r.j = a.g LEFT JOIN top_steps AS u ON u.j = a.g
  CROSS JOIN (SELECT h FROM tops WHERE held = 1) AS t
), folded AS (
  SELECT *, list_reduce(list_prepend(start, way), lambda h, s: sha256(CASE s[1] WHEN '<' THEN s[2:] || h WHEN '>' THEN h || s[2:] ELSE h END)) AS folded_root
  FROM proofs
)
SELECT doc_id, leaf, subroot, root,
  sha256(array_to_string(list_transform(way, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded"""
