"""Operators that look at one document at a time, against plain versions of the same definition."""

import hashlib
import random
import re
import zlib

import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from ledgerlight.llm import byte_bpe, licenses, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n ", None, "s", 3), (4, "same", "en", "s", 4), (4, "same", "en", "s", 4),
    (None, "no id, token = abcdefgh12", "en", "s", None), (5, "x" * 200_000, "en", "s", 200_000), (6, "é ñ 日本 😀 \x1c\x85 end", "en", "s", 9),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS).withColumn("words", F.lit("clash")).withColumn("hits", F.lit(1)).withColumn("ids", F.lit(2))


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def bpe():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})


def bpe_digest(bpe, text):
    ids = bpe.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_byte_bpe_equals_the_library(documents, edges, bpe):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for docs in (documents, edges):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = [tuple(r) for r in byte_bpe.round_trip_digests(docs, path).collect()]
        assert sorted(map(repr, got)) == sorted(repr((i, *bpe_digest(bpe, t))) for i, t in rows)


def test_byte_bpe_round_trip_of_random_strings(bpe):
    encoder, rng = byte_bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")), random.Random(3)
    parts = ["a", "B", " ", "\n", "é", "ñ", "  ", "the", "ing", "日", "😀", "1", "²", "'s", "!!", "*", "-", "\x00", "́", "\x1c", "\x85", "ǅ", "Ʉ", "xyz"]
    decoder = byte_bpe.Decoder(encoder.transducer.ranks)
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        ids = encoder.encode(text)
        assert ids == bpe.encode_ordinary(text), repr(text)
        assert "".join(decoder.stream([i] for i in ids)) == text


def test_byte_bpe_forgets_within_its_bounds(bpe):
    encoder = byte_bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoder.transducer.max_edges, encoder.transducer.max_pieces = 50, 20
    text = "several different words, some of them repeated: several different words; thornont edredly"
    assert encoder.encode(text) == bpe.encode_ordinary(text)
    assert len(encoder.transducer.pieces) <= 20


def test_byte_bpe_decodes_documents(spark, edges):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(edges, path), path).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in back))) == sorted(repr((e[0], e[1] or "")) for e in EDGES)


def plain_spans(text):
    text = text or ""
    found = []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def secret_texts():
    rng = random.Random(5)
    parts = ["password", "Secret", "TOKEN", "api_key", "APIKEY", "passwd", " ", "=", ":", "'", '"', "abcd1234", "x", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef" * 2, "é", "İ", "ſecret", "K", "."]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(4000)]


def test_secret_spans_equal_plain_expressions():
    scanner = secret_scan.Scanner()
    for text in secret_texts():
        assert [s for s in scanner.spans(text) if s[1] < 3] == plain_spans(text), repr(text)


def test_secret_checksums():
    scanner, body = secret_scan.Scanner(), "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = f"ghp_{body}{secret_scan.base62_crc(body)}"
    assert [s[1] for s in scanner.spans(f"x {good} y")] == [3]
    assert scanner.spans(f"x ghp_{body}000000 y") == []
    assert [s[1] for s in scanner.spans(f"npm_{body}{secret_scan.base62_crc(body)}")] == [4]


def test_secret_scan_of_tables(documents, edges):
    for docs in (documents, edges):
        texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        want = []
        for i, t in texts:
            spans = plain_spans(t)
            digest = hashlib.sha256(secret_scan.listed(spans).encode()).hexdigest()
            want.append((i, *(sum(s[1] == k for s in spans) for k in range(3)), digest))
        got = [tuple(r)[:5] for r in secret_scan.scan(docs).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_redaction_keeps_rows_and_columns(spark, edges):
    out = secret_scan.redact(edges)
    assert out.schema == edges.schema
    rows = out.collect()
    assert len(rows) == len(EDGES)
    assert [r["text"] for r in rows if r["doc_id"] is None] == ["no id, [SECRET]"]
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [None]
    assert not any(secret_scan.Scanner().spans(r["text"]) for r in rows if r["text"])


def plain_licenses(text):
    text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    places, base, labels, best = [], set(), set(), 0.0
    for label, (template, a, b) in licenses.templates().items():
        for s in range(-a, len(words)):
            at = {i: words[s + i] for i in range(len(template)) if 0 <= s + i < len(words)}
            share = sum(at.get(i) == w for i, w in enumerate(template)) / len(template)
            if all(at.get(i) == template[i] for i in range(a, b)) and share >= licenses.LEAST:
                labels.add(label)
                best = max(best, share)
                if label in licenses.BASE:
                    base.add(label)
                    places.append(s)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best)


def test_license_scan_equals_plain_search(spark, edges):
    rng = random.Random(9)
    parts = ["cc", "by", "CC-BY", "NC", "4.0", "Licensed under", "general", "Public", "license", "GNU", "version 3", "All Rights", "reserved.", "released under the MIT License", "é", "of", "K", "2", "the apache"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    texts += ["Licensed under the Apache License, Version 2.0.", "licensed under xx apache license version 2 1", "by cc by"]
    made = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    for docs in (made, edges):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = [tuple(r) for r in licenses.scan(docs).collect()]
        assert sorted(map(repr, got)) == sorted(repr((i, *plain_licenses(t))) for i, t in rows)


def test_license_words_are_plain():
    for words, a, b in licenses.templates().values():
        assert 0 <= a < b <= len(words) and all(re.fullmatch("[a-z0-9]+", w) and "k" not in w for w in words)


def test_license_scan_runs_no_python(documents):
    plan = licenses.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], DOCS)
    assert licenses.scan(nothing).count() == 0
    assert secret_scan.scan(nothing).count() == 0
    assert byte_bpe.round_trip_digests(nothing, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_crc_of_nothing():
    assert zlib.crc32(b"") == 0


def test_byte_bpe_memory_stays_flat(bpe):
    """Over many forgettings what is traced stops growing."""
    import gc
    import tracemalloc

    encoder, rng = byte_bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")), random.Random(6)
    t = encoder.transducer
    t.max_edges, t.max_pieces, t.max_pairs = 2000, 1000, 3000
    forgotten, forget = [], t._forget
    t._forget = lambda: (forgotten.append(1), forget())

    def some(times):
        while len(forgotten) < times:
            text = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 12))) for _ in range(50))
            assert encoder.encode(text) == bpe.encode_ordinary(text)
        gc.collect()
        return tracemalloc.get_traced_memory()[0]

    some(10)
    tracemalloc.start()
    try:
        early, late = some(25), some(75)
    finally:
        tracemalloc.stop()
    assert late < early + 2_000_000
    assert len(t.pieces) <= 1000 and len(t.older) <= 1000 and len(t.pairs) <= 3000


def test_redaction_counts_in_narrow_columns(spark):
    docs = spark.createDataFrame([("password: hunter2hunter2", 24)], "text string, n_chars int")
    out = secret_scan.redact(docs)
    assert out.schema == docs.schema
    row = out.first()
    assert row["n_chars"] == len(row["text"]) < 24


def test_workers_drop_what_other_operators_remember():
    from ledgerlight.llm import common, decontamination

    decontamination.words_of("some words")
    common.take_turn(decontamination.__name__)
    assert decontamination._WORDS
    common.take_turn(byte_bpe.__name__)
    assert not decontamination._WORDS
