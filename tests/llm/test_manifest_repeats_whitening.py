"""Merkle manifest, removal of repeats and whitening, against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import merkle, recompression, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = "doc_id long, text string, lang string, source string, n_chars long, leaf string, at int, `the group` int, t long, k long"


# --- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, extra=0):
    n = row["n_chars"]
    values = [row["doc_id"], row["source"], row["lang"], n if n is None else n + extra, row["text"]]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """Root, and for each leaf its siblings from below: (side, hash)."""
    ways, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for w, i in zip(ways, at, strict=True):
            other = level[i ^ 1] if i ^ 1 < len(level) else None
            w.append(("<" if i % 2 else ">", other) if other else ("=", ""))
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], ways


def fold(x, way):
    for side, s in way:
        x = h(s, x) if side == "<" else h(x, s)
    return x


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        held = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[lang] = held, *plain_tree([plain_leaf(r) for r in held])
    root, tops = plain_tree([trees[lang][1] for lang in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        held, subroot, ways = trees[lang]
        for r, way in zip(held, ways, strict=True):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            folded = fold(plain_leaf(r, int(tampered)), way + top)
            out.append((r["doc_id"], plain_leaf(r), subroot, root, h(*(s for _, s in way + top)), folded, folded == root))
    return sorted(out, key=repr)


def manifest(df):
    return sorted((tuple(r) for r in merkle.verified(df).collect()), key=repr)


def doc(i, text="x", lang="en", source="s", n_chars=1):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": n_chars}


@pytest.mark.parametrize("n", [1, 2, 3, 255, 256, 257, 700])
def test_manifest_of_one_group(spark, n):
    rows = [doc(i * 3, text=f"text {i}") for i in range(n)]
    assert manifest(spark.createDataFrame(rows, DOCS)) == plain_manifest(rows)


def test_manifest_equals_the_plain_one(spark):
    rng = random.Random(3)
    rows = [doc(rng.randrange(10**6), "é" * rng.randrange(40), rng.choice(["en", "de", "é", "z", "", None]), rng.choice(["a", None]), rng.choice([None, 0, 7])) for _ in range(900)]
    rows += [doc(None), doc(None, "y"), doc(5, None), doc(5, ""), doc(-7, "long " * 100_000), doc(12, lang="once")]
    rows += [doc(99, "same")] * 450  # one id in a third of the rows, repeated in full
    rng.shuffle(rows)
    wide = spark.createDataFrame([{**r, "leaf": "z", "at": 1, "the group": 2, "t": 3, "k": 4} for r in rows], ODD)
    out = manifest(wide.drop("the group"))
    assert out == plain_manifest(rows)
    wrong = [r for r in out if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0]
    assert wrong and any(not r[6] for r in wrong) and all(r[6] for r in out if r not in wrong)


def test_manifest_of_many_groups_and_of_none(spark):
    rows = [doc(i, lang=f"l{i % 300}") for i in range(700)]
    assert manifest(spark.createDataFrame(rows, DOCS)) == plain_manifest(rows)
    assert manifest(spark.createDataFrame([], DOCS)) == []


def test_jumps_by_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FEW_NODES", 0)
    rows = [doc(i, lang="ab"[i % 2]) for i in range(600)]
    assert manifest(spark.createDataFrame(rows, DOCS)) == plain_manifest(rows)


def test_a_repeated_row_is_spread(spark, monkeypatch):
    written, write = [], merkle.materialise
    monkeypatch.setattr(merkle, "materialise", lambda df, name: written.append(write(df, name)) or written[-1])
    rows = spark.range(0, 6000, 1, 8).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id", "'en' AS lang", "1 AS salt0")
    rows = rows.withColumn("salt", F.monotonically_increasing_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = merkle.ranked(rows, ["lang", "doc_id", "salt"], "ranked")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["rank"] for r in found.select("rank").collect()) == list(range(6000))
    sizes = [r["count"] for r in written[0].groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2000


# --- repeats


def plain_dedup(rows, width=13):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def dedup(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in recompression.dedup(df, **options).collect()), key=repr)


def corpus(seed, n, vocabulary, longest, copies=0.5):
    """Texts that quote spans of earlier ones, of all lengths around a window."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(longest))]
        for _ in range(rng.randrange(3) if texts and rng.random() < copies else 0):
            other = rng.choice(texts).split()
            a = rng.randrange(len(other) + 1)
            at = rng.randrange(len(words) + 1)
            words[at:at] = other[a : a + rng.randrange(8, 60)]
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed, vocabulary", [(1, "ab"), (2, ["x", "yé", "z"]), (3, [f"w{i}" for i in range(40)]), (4, [f"w{i}" for i in range(2000)])])
def test_repeats_equal_brute_force(spark, seed, vocabulary):
    rows = corpus(seed, 120, list(vocabulary), 120)
    assert dedup(spark, rows) == plain_dedup(rows)


def test_repeats_of_runs_and_odd_rows(spark):
    same, lots = "a " * 40, "long words of prose that go on " * 3000
    rows = [(1, same), (2, "a " * 13), (3, "a " * 12), (4, "b " + "a " * 20 + "c"), (5, None), (6, ""), (7, " \n\t"), (None, same), (None, None)]
    rows += [(8, lots), (9, lots + "end"), (10, "start " + lots), (11, "a\x0bb\x0cc\rd e   " * 9), (12, "a b c d e   " * 9)]
    rows += [(20, "q r s t u v w x y z 1 2 3 4 5")] * 30 + [(20, "r s t u v w x y z 1 2 3 4 5 6")] * 3 + [(21, "0 q r s t u v w x y z 1 2 3 4 5 6 7")]
    assert dedup(spark, rows) == plain_dedup(rows)
    assert dedup(spark, rows, width=5, rounds=2) == plain_dedup(rows, 5)
    assert dedup(spark, rows, width=2) == plain_dedup(rows, 2)
    assert dedup(spark, []) == []


def test_a_family_of_near_copies(spark):
    """One passage in a third of the documents, each with a change of its own; one id in many rows."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(200, 400)]
    for i in range(100):
        words = list(base)
        words[rng.randrange(150)] = f"new{i}"
        rows.append((i if i % 2 else 1000, " ".join(words)))
    assert dedup(spark, rows) == plain_dedup(rows)


def test_hot_names_and_a_full_filter(spark, monkeypatch):
    """Names kept apart, and rows joined with the shared names, give what the plain way gives."""
    monkeypatch.setattr(recompression, "HOT", 3)
    monkeypatch.setattr(recompression, "MOST_BITS", 1 << 6)
    rows = corpus(8, 150, [f"w{i}" for i in range(300)], 100) + [(7, "q r s t u v w x y z 1 2 3 4 5")] * 40
    assert dedup(spark, rows) == plain_dedup(rows)


def test_segments_hold_every_window_once():
    rng = np.random.default_rng(5)
    lengths = np.array([0, 5, 12, 13, 14, 200, 0, 40])
    words = rng.integers(0, 4, lengths.sum()).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, start, count, windows = recompression.segments(words, lengths, 13, 4)
    assert len(windows) == count.sum()
    held = [s + i for s, n in zip(start, count, strict=True) for i in range(n)]
    ends = np.repeat(np.cumsum(lengths), lengths)
    assert held == [i for i in range(len(words)) if i + 13 <= ends[i]]


def test_texts_without_repeats(spark):
    rows = [(1, "the quick brown fox  jumps over the lazy dog and then it runs away home"), (2, "See: the quick brown fox jumps over the lazy dog and then it runs away home.\n\nBye"), (3, "Unlike\n\n those"), (None, None)]
    df = spark.createDataFrame([(i, "EN", t) for i, t in rows], "doc_id long, lang string, text string")
    out = recompression.keep_first(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "EN", rows[0][1]), (2, "EN", "See: home. Bye"), (3, "EN", rows[2][1]), (None, "EN", None)], key=repr)


# --- whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, v string")


def plain_covariance(x):
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[float(n * v - t) / n for v, t in zip(r, s, strict=True)] for r in x])
    return centred, centred.T @ centred / n


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(2)
    data = (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) * 0.3 + rng.normal(size=12)).astype(np.float32)
    rows = [(i, [float(c) for c in v], 1, "x") for i, v in enumerate(data)]
    rows += [(7, rows[7][1], 1, None)] * 200 + [(None, rows[3][1], 2, "y")]  # one id in a third of the rows
    bad = [(900, None, 1, "z"), (901, [], 1, ""), (902, [1.0] * 11 + [float("nan")], 1, ""), (903, [1.0] * 11 + [None], 1, ""), (904, [float("inf")] * 12, 1, ""), (905, [1.0] * 5, 1, "")]
    out = whitening.whiten(vectors(spark, rows + bad).repartition(5)).collect()
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in r[1]] for r in rows]
    centred, cov = plain_covariance(x)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    white = centred @ axes / np.sqrt(values)
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    want = defaultdict(list)
    for r, v, w in zip(rows, x, white, strict=True):
        want[r[0]].append((sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), w))
    assert len(out) == 8 * len(rows)
    signs = {}
    for r in out:
        options = [w for d, w in want[r["vec_id"]] if d == r["deviation"]]
        assert options and r["n"] == n
        k = r["component"]
        target = options[0][k - 1]
        if k not in signs and abs(target) > 0.1:
            signs[k] = np.sign(target) * np.sign(r["whitened"])
        if k in signs:
            assert r["whitened"] * signs[k] == pytest.approx(target, abs=1e-8)
        assert r["explained"] == pytest.approx(values[k - 1] / np.trace(cov), rel=1e-9)
        assert r["identity_error"] < 1e-8
    assert len(signs) == 8


def test_polarisation_is_exact():
    rng = np.random.default_rng(4)
    for scale in (10, 2**40, 2**61):
        y = rng.integers(-scale, scale, (50, 5))
        big = y.astype(object)
        want = [int((big[:, i] ** 2).sum()) for i in range(5)]
        want += [int(((big[:, i] + big[:, j]) ** 2).sum()) for i in range(5) for j in range(i + 1, 5)]
        assert whitening.squares(y) == want


def test_whitening_of_large_and_few_values(spark):
    rows = [(i, [float(2**50) * (-1) ** i, float(i), 0.5], 1, "") for i in range(6)]
    out = whitening.whiten(vectors(spark, rows)).collect()
    assert {r["deviation"] for r in out} == {None} and max(r["component"] for r in out) <= 2
    assert whitening.whiten(vectors(spark, rows[:1])).count() == 0
    assert whitening.whiten(vectors(spark, rows[:1] * 5)).count() == 0
    assert whitening.whiten(vectors(spark, [])).collect() == []
    two = whitening.whiten(vectors(spark, [(1, [0.0, 1.0], 1, ""), (2, [1.0, 1.0], 1, "")])).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9)) for r in two) == [(1, 1, 1.0), (2, 1, 1.0)]
