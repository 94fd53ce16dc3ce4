"""N-gram Jaccard join: T-occurrence search with DivideSkip, and the components of its links.

1. A task turns each text into its set of word shingles, as 64-bit hashes. Documents with equal sets are one from here
   on: the smallest id stands for all of them, so copies are never paired with each other.
2. *Who has to meet.* Two sets that link differ in few elements, at most d by the size of the larger. If shingles are
   dealt by hash to d + 1 + s parts, s + 1 parts at least hold the same shingles in both sets. A part is weak if it is
   empty or more than two documents hold it. Two documents that alone hold some parts meet if these and the weak ones
   that both may have are more than s. If all the s + 1 are weak, both documents have more than s weak parts; such
   documents meet by their weak parts without the most common ones, as many as may differ (in one order of all parts,
   the rarest that both hold is left in both), and those with more than s empty ones also by a constant. s is above the
   empty parts to be expected, so the constant is rare, and a line that many documents have brings together no
   documents that differ otherwise.
   Sizes fall into bands with their own d and s; a set near the upper end of its band is dealt in the next one too.
   Documents that meet by a weak part are joined to the first of them; the components are the groups that are searched.
   Chance meetings chain documents of many families into one large group as the corpus grows. Groups of more than
   ``rows`` documents are therefore dealt again by another hash, where documents meet within their group only: what
   links meets in every dealing, chance meetings fall apart. This goes on while it at least halves what large groups hold.
3. *T-occurrence search* in each group. Inverted lists map shingles to documents, in order of size. For a document with
   n shingles, a partner occurs in T = ceil(t n) of its lists at least. The longest lists are set aside; the short
   ones are merged by a heap, and what occurs often enough in these is looked up in the long lists by binary search.
   Whoever reaches the required overlap is linked. For components, documents that are connected already are skipped, as
   another link between them can't change one; so a group of thousands of near copies is no work of its square.
   ``set_links`` skips nothing and gives every link.
4. Groups over ``rows`` documents or ``shingles`` shingles are dealt into chunks, searched with the group's first
   document in each. Only if a group is then not connected, what lies outside its largest part is searched against all
   chunks, pair by pair. For all links, all pairs of chunks are searched. No task holds more than two chunks, and no link
   between different sets can be lost.

Equality of shingles is that of 64-bit hashes, equality of sets that of a 128-bit hash.

Defined results: a null or empty text and one of white space only have an empty set and link with nothing, with texts
of fewer than ``n`` words the whole sequence is the only shingle; texts of any length are read whole; rows that repeat
an id are one document, whose texts are all joined under that id; rows without an id link with nothing and have a null
component; an empty table gives an empty one; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import math
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, arrow_map, materialise, mix, remembers, small_or_not, texts, windows
from .components import components

_WORDS = WordHashes()
remembers(__name__, _WORDS.clear)

SETS = "doc_id long, n_shingles long, same binary, parts array<long>, rooms array<int>"


def shingle_set(text: str, n: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``n`` words. Words are runs of other bytes than ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k = min(n, len(words))
    return np.unique(windows(_WORDS.of(words), tuple(range(k)), seed=k))


def links(a: int, b: int, both: int, num: int, den: int) -> bool:
    return den * both >= num * (a + b - both)


def band_of(size: int, num: int, den: int) -> tuple[int, int]:
    """(number, first size beyond it) of the band of a size. Bands are wider than the sizes that can link."""
    low, j = 1, 0
    while True:
        high = max(low + 1, -(-low * 14 // 10), low * den // num + 1)
        if size < high:
            return j, high
        low, j = high, j + 1


SPARE = 2


@cache
def parts_of(band: int, num: int, den: int) -> tuple[int, int]:
    """(parts, how many of them may be weak) for the sets dealt in a band; no parts if such sets link only if equal.

    The weak ones allowed are more than the smallest set dealt there leaves empty, by four standard deviations, but no
    more than there are elements to differ in.
    """
    low, beyond = 1, band_of(1, num, den)[1]
    for _ in range(band):
        low, beyond = beyond, band_of(beyond, num, den)[1]
    least, most = -(-low * num // den), 2 * (beyond - 1) * (den - num) // (den + num)
    if most < 1:
        return 0, 0
    spare = SPARE
    while spare < most:
        parts = most + 1 + spare
        empty = math.exp(-least / parts)
        if parts * empty + 4 * math.sqrt(parts * empty * max(0.0, 1 - (1 + least / parts) * empty)) <= spare:
            break
        spare += 1
    return most + 1 + spare, spare


def dealt_parts(shingles: np.ndarray, num: int, den: int, seed: int = 0) -> list[tuple[int, np.ndarray, int]]:
    """(band, keys of the parts, weak ones allowed beside the empty) for each band a set is dealt in.

    ``seed`` chooses the hash that deals.

    The lowest bit of a key is that of the band. Below 0 the set has too many empty parts, and a constant is added.
    """
    size, out = len(shingles), []
    with np.errstate(over="ignore"):
        dealer = mix(shingles + np.uint64(seed)) if seed else shingles
    band, high = band_of(size, num, den)
    # A partner may lie in the next band.
    for number in (band, band + 1) if size * den // num >= high else (band,):
        parts, spare = parts_of(number, num, den)
        if not parts:
            continue
        at = (dealer % np.uint64(parts)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        held, first = np.unique(at[order], return_index=True)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(shingles[order] + np.uint64(number + 1)), first)
            keys = mix(sums + mix(held.astype(np.uint64) + np.uint64(number << 32)))
        room = spare - (parts - len(held))
        if room < 0:
            keys = np.append(keys, mix(np.array([(number << 32) + 0x7FFFFFFF], np.uint64)))
        out.append((number, (keys & ~np.uint64(1)) | np.uint64(number & 1), room))
    return out


def part_hashes(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys by which a set meets all sets it may link with, were all parts used."""
    out = [keys for _, keys, _ in dealt_parts(shingles, num, den)]
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def sets_of(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str, seed: int = 0) -> DataFrame:
    def run(batches):
        for b in batches:
            sizes, same, parts, rooms = [], [], [], []
            for text in texts(b.column(1)):
                s = shingle_set(text, n)
                sizes.append(len(s))
                same.append(xxhash.xxh3_128_digest(s.tobytes()))
                dealt = dealt_parts(s, num, den, seed) if len(s) else []
                parts.append(np.concatenate([keys for _, keys, _ in dealt]).view(np.int64) if dealt else [])
                room = {band & 1: room for band, _, room in dealt}
                rooms.append([room.get(0, 0), room.get(1, 0)])
            columns = [b.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(parts, pa.list_(pa.int64())), pa.array(rooms, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "same", "parts", "rooms"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SETS)


def firsts_of(named: DataFrame, same: DataFrame) -> DataFrame:
    """The rows of ``named`` whose id is the first of their set, by ``same`` (``same``, ``first``).

    Parts take more room than texts do, and are read twice. So the copies to leave out are sent to them, as long as a
    count allows it, and only ids and names of sets are shuffled.
    """
    copies = named.select("same", "doc_id").join(same, "same").where("doc_id <> first").select("same", "doc_id").distinct()
    return named.join(small_or_not(materialise(copies, "copies")), ["same", "doc_id"], "left_anti")


#: A document of more weak parts than this, as one id with very many texts may be, meets by all of them unsorted.
SORTED_PARTS = 1 << 16


def meetings(firsts: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` whose components hold all sets that may link; ``firsts``: ``doc_id``, ``parts``, ``rooms``.

    Of an id with several sets the smallest room and all weak parts count, which can only add edges.
    """
    odd = F.expr("cast(part & 1 AS int)").alias("odd")
    listed = firsts.select(F.explode("parts").alias("part"), "doc_id")
    held = listed.groupBy("part").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("holders"))
    held = materialise(held.where("holders > 1"), "parts")
    weak = held.where("holders > 2").select("part", "holders")
    shared = materialise(listed.join(small_or_not(weak), "part").distinct().select("doc_id", odd, "part", "holders"), "weak")
    counts = shared.groupBy("doc_id", "odd").agg(F.count("*").alias("weak"))
    rooms = firsts.groupBy("doc_id").agg(*[F.min(F.col("rooms")[i]).alias(f"r{i}") for i in (0, 1)])
    rooms = rooms.select("doc_id", F.expr("stack(2, 0, r0, 1, r1) AS (odd, room)")).join(counts, ["doc_id", "odd"], "left")
    rooms = materialise(rooms.select("doc_id", "odd", "room", F.coalesce("weak", F.lit(0)).alias("weak")), "rooms")
    # Sets that link agree in more than ``room`` parts: those of these two alone, counted, and weak ones at the most.
    pairs = held.where("holders = 2 AND a < b").groupBy("a", "b", odd).agg(F.count("*").alias("alone"))
    for end in ("a", "b"):
        pairs = pairs.join(rooms.select(F.col("doc_id").alias(end), "odd", F.col("room").alias(f"room_{end}"), F.col("weak").alias(f"weak_{end}")), [end, "odd"])
    met = pairs.where("alone + least(weak_a, weak_b) > greatest(room_a, room_b)").select("a", "b")
    # Those that agree in weak parts alone agree in more than ``room`` of them, so in one that is left without the ``room`` most common.
    over = shared.join(rooms.where("weak > room"), ["doc_id", "odd"])
    place = F.row_number().over(Window.partitionBy("doc_id", "odd").orderBy("holders", "part"))
    used = over.where(F.col("weak") <= SORTED_PARTS).withColumn("place", place).where("place <= weak - room").select("doc_id", "part")
    used = materialise(used.union(over.where(F.col("weak") > SORTED_PARTS).select("doc_id", "part")), "used")
    first = used.groupBy("part").agg(F.min("doc_id").alias("a"))
    return met.union(used.join(first, "part").where("a <> doc_id").select("a", F.col("doc_id").alias("b")))


#: Dealings at most; each after the first only looks at the documents of large groups.
DEALS = 5


def meeting_groups(docs: DataFrame, firsts: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str, rows: int) -> DataFrame:
    """``id``, ``label`` of the documents in groups that hold all sets that may link; who meets no one is in none.

    ``firsts`` as in ``meetings``. Groups of more than ``rows`` documents are dealt again, see the module's text.
    """
    meet, before = components(meetings(firsts)), None
    for seed in range(1, DEALS):
        large = meet.groupBy("label").agg(F.count("*").alias("docs")).where(F.col("docs") > rows).select("label")
        large = materialise(large, "large")
        held = materialise(meet.join(large, "label").select("id", "label"), "held")
        count = held.count()
        if not count or (before is not None and 2 * count > before):
            break
        before = count
        ids = small_or_not(held.select(F.col("id").alias("doc_id")))
        again = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(ids, "doc_id", "left_semi")
        again = sets_of(again, n, num, den, "doc_id", "text", seed).where("n_shingles > 0").join(held.withColumnRenamed("id", "doc_id"), "doc_id")
        # A part's key is that of its group; the lowest bit stays that of the band.
        own = F.expr("transform(parts, p -> (xxhash64(label, p) & -2L) | (p & 1L))")
        again = materialise(again.select("doc_id", own.alias("parts"), "rooms"), "again")
        meet = meet.join(large, "label", "left_anti").select("id", "label").union(components(meetings(again)))
        meet = materialise(meet, "meet")
    return meet


class Forest:
    """Union-find over positions."""

    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.root = np.array([first.setdefault(x, i) for i, x in enumerate(labels)], np.int64)

    def unite(self, a: int, b: int) -> None:
        a, b = self.root[a], self.root[b]
        self.root[self.root == max(a, b)] = min(a, b)


def search(ids: list, labels: list, sets: list[np.ndarray], num: int, den: int, every: bool = False) -> list[tuple]:
    """Links that connect what is linked and doesn't share a label yet, by DivideSkip; with ``every``, all links between
    different labels."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, labels, sets = ([x[i] for i in order] for x in (ids, labels, sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    forest, found, n = Forest(labels), [], len(ids)
    if n < 2 or not (forest.root != forest.root[0]).any():
        return found
    owners = np.repeat(np.arange(n), sizes)
    _, of = np.unique(np.concatenate(sets), return_inverse=True)
    postings = np.sort(of * n + owners)  # list by list, each in order of size
    begins = np.searchsorted(postings, np.arange(int(of.max()) + 2) * n)
    lists_of = np.split(of, np.cumsum(sizes)[:-1])
    for q in range(1, n):
        size = int(sizes[q])
        low = int(np.searchsorted(sizes, -(-num * size // den)))
        if low >= q or not (forest.root[low:q] != forest.root[q]).any():
            continue
        least = -(-num * size // den)  # T: a partner shares so many shingles at least
        mine = lists_of[q]
        lengths = begins[mine + 1] - begins[mine]
        mine = mine[np.argsort(lengths, kind="stable")]
        aside = min(least - 1, int(least / (0.01 * np.log2(lengths.max() + 1) + 1)))
        short, long = mine[: len(mine) - aside], mine[len(mine) - aside :]
        heads = []
        for x in short:
            others = postings[begins[x] : begins[x + 1]] - x * n
            others = others[(others >= low) & (others < q)]
            others = others[forest.root[others] != forest.root[q]]
            if len(others):
                heads.append(others.tolist())
        often = [(c, k) for c, same in groupby(heapq.merge(*heads)) if (k := len(list(same))) >= least - aside]
        for c, k in often:
            if forest.root[c] == forest.root[q]:
                continue
            wanted = long * n + c
            at = np.minimum(np.searchsorted(postings, wanted), len(postings) - 1)
            both = k + int((postings[at] == wanted).sum())
            if links(size, int(sizes[c]), both, num, den):
                found.append((ids[q], ids[c]))
                if not every:
                    forest.unite(q, c)
    return found


def searched(grouped: DataFrame, keys: list[str], num: int, den: int, name: str = "doc_id", every: bool = False) -> DataFrame:
    """Links in each group of ``keys``; ``grouped`` also has ``label``, ``shingles`` and ``name``, which links are given by."""
    kind, of = (pa.int64(), "long") if name == "doc_id" else (pa.binary(), "binary")

    def run(batches):
        def close(rows):
            pairs = search([r[0] for r in rows], [r[1] for r in rows], [np.frombuffer(r[2], np.uint64) for r in rows], num, den, every)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k in (0, 1)], ["a", "b"])

        rows, key = [], None
        for b in batches:
            columns = [b.column(i) for i in range(b.num_columns)]
            for i in range(b.num_rows):
                own = tuple(c[i].as_py() for c in columns[: len(keys)])
                if own != key:
                    if len(rows) > 1:
                        yield close(rows)
                    rows, key = [], own
                rows.append(tuple(c[i].as_py() for c in columns[len(keys) :]))
        if len(rows) > 1:
            yield close(rows)

    dealt = grouped.select(*keys, name, "label", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    return arrow_map(dealt, run, f"a {of}, b {of}")


def with_sets(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """``wanted`` (``doc_id``, ``label``) with the shingles of each text."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, n) for t in texts(b.column(2))]
            columns = [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "size", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(small_or_not(wanted), "doc_id").select("doc_id", "label", "text")
    return arrow_map(rows, run, "doc_id long, label long, size long, shingles binary")


def _chunks(rows: int, shingles: int):
    """How many chunks keep within both bounds, and the chunk of a document."""
    count = F.greatest(F.ceil(F.col("docs") / rows), F.ceil(F.col("total") / shingles), F.lit(1)).cast("int")
    return count.alias("chunks"), F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")


def linked_components(docs, meet: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str, rows: int, shingles: int) -> DataFrame:
    """Links ``a``, ``b`` that connect all that is linked, found within the groups ``meet`` (``id``, ``label``), and
    their components, or None where links were added after these were made."""
    wanted = meet.select(F.col("id").alias("doc_id"), "label")
    sets = materialise(with_sets(docs, wanted, n, id_col, text_col), "sets")
    count, chunk = _chunks(rows, shingles)
    groups = sets.groupBy("label").agg(F.count("*").alias("docs"), F.sum("size").alias("total")).select("label", count)
    groups = materialise(groups, "groups")
    dealt = sets.join(groups, "label").withColumnRenamed("label", "group")
    # The first document of a group is in all of its chunks.
    first = dealt.where("doc_id = group AND chunks > 1").withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    all_rows = dealt.withColumn("chunk", chunk).unionByName(first)
    near = searched(all_rows.withColumn("label", F.col("doc_id")), ["group", "chunk"], num, den)
    near = materialise(near, "links")
    large = groups.where("chunks > 1").select(F.col("label").alias("group"), "chunks")
    labels = materialise(components(near), "labels")
    if large.isEmpty():
        return near, labels
    found = labels.select(F.col("id").alias("doc_id"), F.col("label").alias("found"))
    parts = sets.select("doc_id", "size", F.col("label").alias("group")).join(large, "group").join(found, "doc_id", "left")
    parts = materialise(parts.withColumn("found", F.coalesce("found", "doc_id")), "parts")
    sums = parts.groupBy("group", "found").agg(F.count("*").alias("docs"), F.sum("size").alias("total"))
    main = sums.groupBy("group").agg(F.max_by("found", F.struct("docs", "found")).alias("main"), F.count("*").alias("n")).where("n > 1")
    # Sets that link are at most one class of sizes apart, so strays of a class meet only the classes beside it.
    width = 1.001 * max(math.log(den / num), 0.05)
    classed = parts.drop("chunks").join(main.select("group", "main"), "group").withColumn("c", F.floor(F.log("size") / width).cast("int"))
    classed = materialise(classed, "classes")
    sums_of = [F.count("*").alias("docs"), F.sum("size").alias("total")]
    count, _ = _chunks(rows, shingles)
    inside = classed.groupBy("group", "c").agg(*sums_of).select("group", "c", count)
    outside = classed.where("found <> main").groupBy("group", "c").agg(*sums_of).select("group", F.col("c").alias("s"), count.alias("strays"))
    outside = outside.withColumn("c", F.explode(F.expr("array(s - 1, s, s + 1)")))
    pairs = materialise(inside.join(outside, ["group", "c"]), "pairs")
    if pairs.isEmpty():
        return near, labels
    left = sets.select("doc_id", "shingles", F.col("label").alias("group")).join(classed.select("doc_id", "group", "found", "main", "c"), ["doc_id", "group"])
    left = left.withColumn("label", F.col("found"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    stray = F.pmod(F.xxhash64("doc_id"), F.col("strays")).cast("int")
    keys = ["group", "c", "s", "chunk", "stray"]
    columns = [*keys, "doc_id", "label", "shingles"]
    everyone = left.join(pairs, ["group", "c"]).withColumn("chunk", own).withColumn("stray", F.explode(F.expr("sequence(0, strays - 1)"))).select(*columns)
    strays = left.where("found <> main").withColumnRenamed("c", "s").join(pairs, ["group", "s"]).withColumn("stray", stray)
    strays = strays.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    far = searched(everyone.union(strays.select(*columns)), keys, num, den)
    far = materialise(far, "links")
    return near.union(far), labels if far.isEmpty() else None


def members(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``same`` of the documents in each set that ``set_links`` names by ``same``."""
    base = sets_of(docs, n, num, den, id_col, text_col).where("doc_id IS NOT NULL AND n_shingles > 0")
    return base.select("doc_id", "n_shingles", "same").distinct()


def set_links(
    docs: DataFrame,
    n: int = 3,
    num: int = 90,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = 128,
    shingles: int = 1 << 20,
) -> DataFrame:
    """``a``, ``b``: every two different sets that link, once, ``a`` the smaller, by their hashes.

    Documents link if they are ``members`` of the same set or of sets that link. The result, and the work, of a family of
    different near copies is its square; a task still holds two chunks of ``rows`` and ``shingles`` at most.
    """
    base = materialise(sets_of(docs, n, num, den, id_col, text_col), "shingles")
    named = base.where("doc_id IS NOT NULL AND n_shingles > 0")
    same = named.groupBy("same").agg(F.min("doc_id").alias("first"))
    firsts = firsts_of(named, same)
    wanted = meeting_groups(docs, firsts, n, num, den, id_col, text_col, rows).select(F.col("id").alias("doc_id"), "label")

    def name(batches):
        for b in batches:
            same = pa.array([xxhash.xxh3_128_digest(x.as_py()) for x in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), same], ["label", "size", "shingles", "same"])

    sets = with_sets(docs, wanted, n, id_col, text_col).select("label", "size", "shingles")
    sets = arrow_map(sets, name, "label long, size long, shingles binary, same binary")
    sets = materialise(sets.dropDuplicates(["label", "same"]), "sets")
    count, _ = _chunks(rows, shingles)
    groups = sets.groupBy("label").agg(F.count("*").alias("docs"), F.sum("size").alias("total")).select("label", count)
    dealt = sets.join(groups, "label").withColumnRenamed("label", "group").withColumn("chunk", F.expr("cast(pmod(xxhash64(same), chunks) AS int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    # Two chunks are searched for links between them, a chunk with itself for those within.
    dealt = dealt.withColumn("label", F.expr("if(chunk = other, hex(same), string(chunk))"))
    dealt = dealt.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    found = searched(dealt, ["group", "low", "high"], num, den, "same", every=True)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def join(
    docs: DataFrame,
    n: int = 3,
    num: int = 90,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = 128,
    shingles: int = 1 << 20,
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row.

    Documents link when ``den`` times the common shingles are at least ``num`` times all shingles of both;
    ``rows`` and ``shingles`` bound what a task holds at once.
    """
    base = materialise(sets_of(docs, n, num, den, id_col, text_col), "shingles")
    named = base.where("doc_id IS NOT NULL AND n_shingles > 0")
    same = materialise(named.groupBy("same").agg(F.min("doc_id").alias("first")), "copies")
    firsts = firsts_of(named, same)
    meet = meeting_groups(docs, firsts, n, num, den, id_col, text_col, rows)
    found, labels = linked_components(docs, meet, n, num, den, id_col, text_col, rows, shingles)
    # Texts under one id belong together.
    pairs = named.select("doc_id", "same").join(same, "same").select("doc_id", "first")
    texts_of = pairs.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("b"), F.count("*").alias("n")).where("n > 1 AND a <> b")
    versions = materialise(pairs.join(texts_of.select("doc_id", "a"), "doc_id").select("a", F.col("first").alias("b")), "versions")
    if labels is None or not versions.isEmpty():
        labels = components(found.union(versions))
    labels = labels.select(F.col("id").alias("first"), "label")
    result = base.select("doc_id", "n_shingles", "same").join(same, "same", "left").join(labels, "first", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("label", "first")).otherwise(F.col("doc_id")))
    return result.select("doc_id", "n_shingles", component.alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, without those that are linked to one with a smaller id."""
    id_col = options.get("id_col", "doc_id")
    gone = join(docs, **options).where("component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(small_or_not(materialise(gone, "copies")), id_col, "left_anti").select(*docs.columns)
