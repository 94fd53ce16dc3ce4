"""Operators over a whole corpus, against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlight.llm import components, decontamination, jaccard_join, range_coder, revisits, token_files, top_k

DOCS = "doc_id long, text string"
WORDS = [f"{a}{b}{c}" for a in "bdgkmnprst" for b in "aeiou" for c in "lnrs"]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- token files


def test_range_coder_round_trip():
    rng = np.random.default_rng(1)
    blocks = [np.empty(0, np.uint16), np.array([65535], np.uint16), np.zeros(3000, np.uint16), rng.integers(0, 65536, 2000).astype(np.uint16)]
    blocks += [(rng.zipf(1.3, rng.integers(1, 3000)) % 49408).astype(np.uint16) for _ in range(12)]
    coded = range_coder.encode(blocks)
    back = range_coder.decode(coded, [len(b) for b in blocks])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))
    # Blocks are independent, and damage is noticed.
    assert np.array_equal(range_coder.decode(coded[5:6], [len(blocks[5])])[0], blocks[5])
    broken = bytes([coded[5][0] ^ 1]) + coded[5][1:]
    with pytest.raises(ValueError):
        range_coder.decode([broken], [len(blocks[5])])
    assert len(coded[2]) < 3000 / 8


def test_range_coder_needs_fewer_bits_than_counts_say():
    """Less than the entropy of the ids by their counts in the whole block, though the model begins with nothing."""
    rng = np.random.default_rng(4)
    words = [rng.integers(0, 49408, rng.integers(1, 4)) for _ in range(8000)]
    ids = np.concatenate([words[i] for i in rng.zipf(1.2, 90_000) % len(words)]).astype(np.uint16)
    _, counts = np.unique(ids, return_counts=True)
    entropy = -(counts * np.log2(counts / len(ids))).sum()
    coded = range_coder.encode([ids])
    assert np.array_equal(range_coder.decode(coded, [len(ids)])[0], ids)
    assert 8 * len(coded[0]) < entropy


@pytest.mark.parametrize("size", [1, 2047, 2048, 2049, 70_000, 262_145])
def test_range_coder_on_ids_without_order(size):
    rng = np.random.default_rng(size)
    blocks = [rng.integers(0, 65536, size).astype(np.uint16), rng.permutation(1 << 16).astype(np.uint16), np.tile(np.arange(9), size)[:size].astype(np.uint16)]
    coded = range_coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(coded, [len(b) for b in blocks]), strict=True))
    # Alone as together; damage is a ValueError.
    assert range_coder.encode(blocks[2:])[0] == coded[2]
    for at in (0, 5, len(coded[0]) - 6, len(coded[0]) - 1):
        broken = bytearray(coded[0])
        broken[at] ^= 0x55
        with pytest.raises(ValueError):
            range_coder.decode([bytes(broken)], [size])


@pytest.mark.parametrize("limit", [3, 400_000])
def test_texts_tokenised_together_equal_the_library(limit):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["", " \n", "a\x1cb \x1d c", "é\x1cb\x1d\x85c\u2003d", "The the THE, the's <|endoftext|>", "<|startoftext|><|endoftext|> x", "\x00\x7f ~ a\x01b"]
    texts += ["Ɓala ƏLAQƏ a\u0301 á ﬁ Σς 日本 w日本", "x" * 500, "</w> a</w>b <|endoftext |>", "don't we'll I'M 'S 12 3½ ²", "Straße\xa0ÜBER ª º µ", "İ i̇ ß"]
    words, library = token_files.Words(path, added_tokens=True, limit=limit), Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        ids, sizes = words.encode_all(texts, end=1)
        assert sizes.tolist() == [len(w) + 1 for w in want]
        assert ids.tolist() == [i for w in want for i in [*w, 1]]
        assert [words.encode(t).tolist() for t in texts] == want


def test_crc_of_both():
    a, b = b"some bytes", b"and more of them" * 9
    assert token_files.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def plain_tokens(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    start, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block", [64, 2048])
def test_token_files_equal_the_library(spark, documents, block):
    path = public_tokenizers.path("word_bpe_49k.json")
    edges = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "no id"), (5, "long wörds " * 9000), (4, "É\x1cx\x85y <|endoftext|> İ ²½ don't 日本 á ́b")]
    made = spark.createDataFrame(edges, DOCS).withColumn("file", F.lit(1)).withColumn("block", F.lit("clash"))
    for docs in (made, documents.limit(60)):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        fixed = spark.createDataFrame(rows, DOCS)
        got = [tuple(r) for r in token_files.round_trip(fixed, path, block=block).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, plain_tokens(rows)))


def test_every_latin_character_is_cut_as_by_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    words, library = token_files.Words(path), Tokenizer.from_file(path)
    for c in map(chr, range(0x250)):
        for text in (f"{c}ala", f"a{c}", f"GE{c}MAN 1{c}", f"x{c}'s"):
            assert words.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_op1_encodes_as_the_library_does_by_default(spark, tmp_path):
    from ledgerlight.llm import registry

    texts = ["a <|endoftext|> b", "x<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "Ə <|endoftext|>'s 日本 don't", "plain", None]
    spark.createDataFrame(list(enumerate(texts)), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    library, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in registry.QUERIES["op1_token_files"](spark, str(tmp_path)).collect()) == want


def test_token_files_of_nothing(spark):
    assert token_files.round_trip(spark.createDataFrame([], DOCS), public_tokenizers.path("word_bpe_49k.json")).count() == 0


# --- n-gram Jaccard join


def plain_components(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = {i: i for i, _ in rows if i is not None}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = top(rows[a][0]), top(rows[b][0])
                label[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else top(i)) for (i, _), s in zip(rows, sets, strict=True)]


def families(seed):
    rng = random.Random(seed)
    shared = rng.choices(WORDS, k=30)
    rows = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One TWO"), (905, "one"), (None, "one two"), (906, "x y z"), (906, "other text of it"), (907, "other text of it")]
    i = 0
    for size, copies, edits in ((9, 6, 1), (12, 8, 1), (40, 30, 2), (150, 40, 3), (150, 25, 9), (700, 12, 30), (60, 3, 0)):
        base = rng.choices(WORDS, k=size)
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((i, " ".join(words)))
            i += 1
    for _ in range(40):  # only a passage in common
        rows.append((i, " ".join(rng.choices(WORDS, k=10) + shared + rng.choices(WORDS, k=10))))
        i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("rows_a_chunk", "n", "num", "seed"), [(128, 3, 90, 1), (4, 3, 90, 2), (4, 5, 80, 3)])
def test_jaccard_join_equals_all_pairs(spark, rows_a_chunk, n, num, seed):
    rows = families(seed)
    docs = spark.createDataFrame(rows, DOCS).withColumn("label", F.lit("clash")).withColumn("group", F.lit(0))
    got = [tuple(r) for r in jaccard_join.join(docs, n=n, num=num, rows=rows_a_chunk).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_components(rows, n, num, 100)))


@pytest.mark.parametrize(("rows_a_chunk", "n", "num", "seed"), [(128, 3, 90, 1), (4, 5, 80, 3)])
def test_set_links_are_all_links(spark, rows_a_chunk, n, num, seed):
    rows = families(seed) + [(990, "x y z"), (990, "x y z")]
    held = {}
    for i, t in rows:
        s = jaccard_join.shingle_set(t or "", n)
        if i is not None and len(s):
            held.setdefault(xxhash.xxh3_128_digest(s.tobytes()), (set(s.tolist()), set()))[1].add(i)
    want = {(a, b) for a in held for b in held if a < b and jaccard_join.links(len(held[a][0]), len(held[b][0]), len(held[a][0] & held[b][0]), num, 100)}
    docs = spark.createDataFrame(rows, DOCS).withColumn("label", F.lit("clash")).withColumn("group", F.lit(0))
    got = [(bytes(r["a"]), bytes(r["b"])) for r in jaccard_join.set_links(docs, n=n, num=num, rows=rows_a_chunk).collect()]
    assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want
    members = [(bytes(r["same"]), r["doc_id"], r["n_shingles"]) for r in jaccard_join.members(docs, n=n, num=num).collect()]
    assert sorted(members) == sorted((k, i, len(s)) for k, (s, ids) in held.items() for i in ids)


def test_one_of_each_group_is_kept(spark):
    rows = families(5)
    docs = spark.createDataFrame(rows, DOCS).withColumn("label", F.lit("clash")).withColumn("group", F.lit(0))
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = sorted(i for i, _, c in plain_components(rows, 3, 90, 100) if i is not None and i == c)
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == want
    assert kept.where("doc_id IS NULL").count() == sum(i is None for i, _ in rows)


def test_jaccard_join_of_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in jaccard_join.join(documents).collect())
    assert got == sorted(plain_components(rows, 3, 90, 100))


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.join(spark.createDataFrame([], DOCS)).count() == 0


def test_parts_meet_whenever_sets_link():
    rng = random.Random(4)
    for _ in range(300):
        size = rng.randint(9, 400)
        a = set(rng.sample(range(1 << 60), size))
        b = set(a)
        for _ in range(rng.randint(0, size // 9 + 1)):
            if rng.random() < 0.5 and len(b) > 1:
                b.discard(rng.choice(sorted(b)))
            else:
                b.add(rng.randrange(1 << 60))
        if not a == b and jaccard_join.links(len(a), len(b), len(a & b), 90, 100):
            keys = [set(jaccard_join.part_hashes(np.array(sorted(s), np.uint64), 90, 100).tolist()) for s in (a, b)]
            assert keys[0] & keys[1]


def test_parts_meet_whenever_sets_link_at_80():
    rng = random.Random(14)
    for _ in range(300):
        size = rng.randint(9, 400)
        a = set(rng.sample(range(1 << 60), size))
        b = set(a)
        for _ in range(rng.randint(0, size // 5 + 1)):
            if rng.random() < 0.5 and len(b) > 1:
                b.discard(rng.choice(sorted(b)))
            else:
                b.add(rng.randrange(1 << 60))
        if a != b and jaccard_join.links(len(a), len(b), len(a & b), 80, 100):
            dealt = [jaccard_join.dealt_parts(np.array(sorted(s), np.uint64), 80, 100) for s in (a, b)]
            mine, other = ({band: (set(keys.tolist()), room) for band, keys, room in d} for d in dealt)
            # In a band of both, more parts agree than either may have weak ones beside its empty ones.
            assert any(len(mine[k][0] & other[k][0]) > min(mine[k][1], other[k][1]) for k in mine.keys() & other.keys())


@pytest.mark.parametrize("num", [80, 90])
def test_hardly_any_set_has_too_many_empty_parts(num):
    rng = np.random.default_rng(3)
    for size in (60, 200, 400, 1000, 4000, 20000):
        rooms = [room for _ in range(40) for _, _, room in jaccard_join.dealt_parts(np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64)), num, 100)]
        assert sum(room < 0 for room in rooms) <= 1


def test_the_parts_of_sets_are_not_shuffled_to_leave_out_copies(spark, monkeypatch):
    """Parts take more room than texts; a join that Spark itself would not broadcast moved them, twice."""

    class Seen(Exception):
        pass

    def meetings(firsts):
        raise Seen(firsts._jdf.queryExecution().executedPlan().toString(), sorted({r["doc_id"] for r in firsts.collect()}))

    rows = families(9) + [(900 + i, "the same words for every one of these") for i in range(5)]
    docs = spark.createDataFrame(rows, DOCS)
    held = {}
    for i, t in rows:
        if i is not None and (t or "").split():
            held.setdefault(jaccard_join.shingle_set(t).tobytes(), set()).add(i)
    want = sorted({min(ids) for ids in held.values()})
    monkeypatch.setattr(jaccard_join, "meetings", meetings)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for run in (jaccard_join.join, jaccard_join.set_links):
            with pytest.raises(Seen) as seen:
                run(docs)
            plan, ids = seen.value.args
            assert "hashpartitioning" not in plan and ids == want
        # Copies too many to be sent to all executors are left out by a shuffled join.
        monkeypatch.setattr(jaccard_join, "small_or_not", lambda df: df)
        with pytest.raises(Seen) as seen:
            jaccard_join.join(docs)
        plan, ids = seen.value.args
        assert "hashpartitioning" in plan and ids == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_common_line_brings_no_documents_together(spark):
    rng = random.Random(15)
    line = rng.choices(WORDS, k=20)
    docs = [" ".join(rng.choices(WORDS, k=150) + line + rng.choices(WORDS, k=150)) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(docs)), DOCS)
    base = jaccard_join.sets_of(frame, 5, 80, 100, "doc_id", "text")
    assert components.components(jaccard_join.meetings(base)).count() <= 30


def test_chance_meetings_chain_no_families(spark):
    """Passages that two or three documents share lead from each to all others, but only what links has to meet."""
    rng = random.Random(16)
    passages = [rng.choices(WORDS, k=25) for _ in range(450)]
    docs = [" ".join(sum((rng.choices(WORDS, k=60) + rng.choice(passages) for _ in range(2)), [])) for _ in range(500)]
    for i in range(0, 500, 10):
        words = docs[i].split()
        words[rng.randrange(len(words))] = "changed"
        docs[i + 1] = " ".join(words)
    frame = spark.createDataFrame(list(enumerate(docs)), DOCS)
    base = jaccard_join.sets_of(frame, 5, 80, 100, "doc_id", "text")
    met = {r["id"]: r["label"] for r in jaccard_join.meeting_groups(frame, base, 5, 80, 100, "doc_id", "text", 8).collect()}
    assert max(Counter(met.values()).values()) <= 16
    assert all(met[i] == met[i + 1] for i in range(0, 500, 10))


def test_an_id_of_very_many_weak_parts_meets_by_all(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SORTED_PARTS", 3)
    rows = families(8)
    got = [tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, DOCS), n=5, num=80, rows=4).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_components(rows, 5, 80, 100)))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(159, 50), (7, 7), (None, 3), (3, None)]
    got = {r["id"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 50 for i in [50, *range(100, 160)]}


# --- benchmark decontamination


def test_masks_find_any_two_replaced_words():
    for a in range(13):
        for b in range(a):
            assert any(all(s + o not in (a, b) for o in m) for m in decontamination.MASKS for s in range(13 - m[-1]))
    for n in range(1, 13):
        w, equal = decontamination.needed(n)
        run = len(decontamination.run_of(n, 13, 0.8))
        assert run * (w - equal + 1) <= w and run >= 1


def plain_overlaps(docs, items):
    words = decontamination.words_of
    out = {}
    for i, t in docs:
        d = words(t or "")
        for j, u in items:
            x = words(u or "")
            w, equal = decontamination.needed(len(x))
            for shift in range(-len(x) + 1, len(d)) if len(x) and i is not None and j is not None else ():
                a, b = max(0, -shift), min(len(x), len(d) - shift)
                same = [int(d[shift + k] == x[k]) for k in range(a, b)]
                if any(sum(same[s : s + w]) >= equal for s in range(len(same) - w + 1)):
                    got = (-sum(same), a + shift)
                    out[i, j] = min(out.get((i, j), got), got)
    return sorted((i, j, at, -n, len(words(dict(items)[j]))) for (i, j), (n, at) in out.items())


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    items = [(1, " ".join(rng.choices(WORDS, k=30))), (2, " ".join(rng.choices(WORDS, k=13))), (3, " ".join(rng.choices(WORDS, k=7))), (4, "lone"), (5, ""), (6, None), (7, "Été à la PLAGE, encore une fois!")]
    docs = [(1, None), (2, ""), (3, "lone wolf"), (None, items[0][1]), (4, "short"), (5, items[1][1].upper()), (6, "x ÉTÉ à la plage encore une fois")]
    for i in range(10, 120):
        item = rng.choice(items[:3])[1].split()
        for _ in range(rng.randint(0, 4)):
            item[rng.randrange(len(item))] = rng.choice(WORDS)
        cut = rng.randint(0, len(item) // 2) if rng.random() < 0.4 else 0
        docs.append((i, " ".join(rng.choices(WORDS, k=rng.randint(0, 30)) + item[cut:] + rng.choices(WORDS, k=rng.randint(0, 30)))))
    frame = spark.createDataFrame(docs, DOCS).withColumn("seed", F.lit("clash")).withColumn("item_id", F.lit(3))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontamination.overlaps(frame, bench).collect())
    want = plain_overlaps(docs, items)
    assert got == want
    clean = decontamination.keep_clean(frame, bench)
    assert clean.columns == frame.columns
    found = {r[0] for r in want}
    assert sorted(map(str, (r["doc_id"] for r in clean.collect()))) == sorted(str(i) for i, _ in docs if i not in found)


def test_items_without_an_id_are_found(spark):
    passages = [" ".join(random.Random(k).choices(WORDS, k=20)) for k in (1, 2, 3)]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(passages)] + [(9, "clean words")], DOCS)
    bench = spark.createDataFrame([(None, passages[0]), (None, passages[1]), (None, passages[1]), (7, passages[2]), (None, None)], "item_id long, text string")
    named = [r[0] for r in bench.select(F.xxhash64("text")).collect()]
    got = sorted(tuple(r) for r in decontamination.overlaps(docs, bench).collect())
    assert got == [(0, named[0], 1, 20, 20), (1, named[1], 1, 20, 20), (2, 7, 1, 20, 20)]
    assert [r["doc_id"] for r in decontamination.keep_clean(docs, bench).collect()] == [9]


def test_decontamination_of_the_given_tables(spark, documents, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    whole = {r["doc_id"] for r in documents.collect() if any(t in r["text"] for _, t in items)}
    got = {r["doc_id"] for r in decontamination.overlaps(documents, bench).collect()}
    assert whole <= got


def test_decontamination_of_nothing(spark):
    docs, bench = spark.createDataFrame([(1, "a b c")], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.overlaps(docs, bench).count() == 0
    assert decontamination.overlaps(docs.limit(0), docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


# --- exact top-k


def plain_top(rows, every, k):
    fit = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in fit:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        exact = [(sum(a * b for a, b in zip(v, u, strict=False)), i) for i, u in fit if i != q]
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, s)), i) for s, i in exact)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("huge", [False, True])
def test_top_k_equals_brute_force(spark, huge):
    rng = random.Random(8)
    rows = [(i, [rng.randint(-3, 3) / 4 + rng.random() / 512 for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(30)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 6), (2003, [float("inf")]), (2010, []), (2011, [1.0, 2.0]), (None, [1.0]), (7, [0.25] * 6)]
    if huge:
        rows += [(3000, [1e18, -1e18] * 3), (3001, [1e300, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("group", F.lit("clash"))
    got = sorted(tuple(r) for r in top_k.search(frame, every=10, group=64, slice_=8, block=16).collect())
    assert got == plain_top(rows, 10, 5)


def test_top_k_prunes_blocks():
    near, far = np.tile([10.0, 0.0], (16, 1)), np.tile([-10.0, 0.0], (64, 1))
    ids = np.arange(80)
    kept = top_k.best_of(np.array([999]), np.array([[1.0, 0.0]]), ids, np.concatenate([far, near]), 3, [None], 16)
    assert [x[1] for x in kept[0]] == [64, 65, 66]


def test_top_k_of_nothing(spark):
    assert top_k.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- revisits


def plain_revisits(rows):
    out = []
    for i, url, when, revisit, etag, modified, digest, headers in rows:
        if not revisit:
            continue
        full = [r for r in rows if url is not None and when is not None and r[1] == url and r[2] is not None and not r[3] and (r[2], r[0]) < (when, i)]
        if not full:
            out.append((i, "unresolved", None, None, None))
            continue
        e = max(full, key=lambda r: (r[2], r[0]))
        same = True
        if etag is not None:
            same = e[4] is not None and etag.removeprefix("W/") == e[4].removeprefix("W/")
        elif modified is not None:
            same = modified == e[5]
        same = same and (digest is None or digest == e[6])
        merged = {**(e[7] or {}), **{k: v for k, v in (headers or {}).items() if k in revisits.PERMITTED and v is not None}}
        out.append((i, "resolved" if same else "mismatch", e[0], e[6] if same else None, tuple(sorted(merged.items())) if same else None))
    return out


SCHEMA = "record_id long, url string, captured long, revisit boolean, etag string, last_modified string, digest string, headers map<string,string>"


@pytest.mark.parametrize("span", [7, 1 << 20])
def test_revisits_equal_brute_force(spark, span):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        hot = rng.random() < 0.4
        revisit = rng.choice([True, True, False, None])
        tag = rng.choice([None, '"a"', 'W/"a"', '"b"'])
        headers = rng.choice([None, {}, {"date": str(i), "server": "s", "etag": "e"}, {"content-type": f"t{i}", "expires": None}])
        rows.append((i, None if rng.random() < 0.03 else "h/hot" if hot else f"h/{rng.randint(0, 20)}", None if rng.random() < 0.03 else rng.randint(0, 100), revisit, tag, rng.choice([None, "m1", "m2"]), rng.choice([None, "d1", "d1"]), headers))
    frame = spark.createDataFrame([(r[0], r[1] and f"http://{r[1]}", *r[2:]) for r in rows], SCHEMA).withColumn("span", F.lit("clash"))
    got = [(r["record_id"], r["outcome"], r["refers_to"], r["digest"], None if r["headers"] is None else tuple(sorted(r["headers"].items()))) for r in revisits.resolve(frame, span).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_revisits([(*r[:3], bool(r[3]), *r[4:]) for r in rows])))


def test_canonical_urls(spark):
    same = ["http://Www.Example.com:80/a/?utm_source=x#top", "https://example.com/a", "https://EXAMPLE.com/a/#y", "http://example.com/a?ref=1&utm_medium=b"]
    other = ["http://example.com/A", "http://m.example.com/a", "http://example.com/a?page=2", "http://example.com/a?page=2&ref=x"]
    frame = spark.createDataFrame([(u,) for u in same + other + ["not a url", "", None]], "url string")
    got = [r[0] for r in frame.select(revisits.canonical_url(F.col("url"))).collect()]
    assert set(got[:4]) == {"example.com/a"}
    assert got[4:8] == ["example.com/A", "m.example.com/a", "example.com/a?page=2", "example.com/a?page=2"]
    assert got[8:] == ["not a url", "", None]


def test_bodies_come_from_the_response(spark):
    rows = [(1, "http://h/x", 1, False, None, None, "d", None), (2, "http://h/x", 2, True, None, None, None, None)]
    bodies = spark.createDataFrame([(1, "<p>"), (2, None)], "record_id long, body string")
    assert [(r["record_id"], r["body"]) for r in revisits.with_bodies(revisits.resolve(spark.createDataFrame(rows, SCHEMA)), bodies).collect()] == [(2, "<p>")]


def test_revisits_of_nothing(spark):
    assert revisits.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_repeated_id_is_verified_row_by_row(spark, monkeypatch):
    """One id in a third of the rows: each text meets its own hits, not those of all rows of the id."""
    item = " ".join(WORDS[:15])
    rows = [(7, f"{w} {item}") for w in WORDS[20:120]] + [(i, " ".join(WORDS[i : i + 30])) for i in range(20, 220)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    counted = []
    monkeypatch.setattr(decontamination, "arrow_map", lambda df, fn, schema, keep=decontamination.arrow_map: (counted.append(df), keep(df, fn, schema))[1])
    found = decontamination.overlaps(spark.createDataFrame(rows, DOCS), bench)
    assert [tuple(r) for r in found.collect()] == [(7, 1, 1, 15, 15)]
    assert counted[-1].count() == 100


def test_short_items_are_left_out(spark):
    docs = spark.createDataFrame([(1, "yes we can"), (2, " ".join(WORDS[:20])), (3, "no")], DOCS)
    bench = spark.createDataFrame([(1, "yes"), (2, " ".join(WORDS[:15])), (3, None)], "item_id long, text string")
    assert sorted(r[0] for r in decontamination.keep_clean(docs, bench).collect()) == [3]
    assert sorted(r[0] for r in decontamination.keep_clean(docs, bench, min_words=13).collect()) == [1, 3]
    assert sorted(r[0] for r in decontamination.left_out(bench, 13).collect()) == [1, 3]
