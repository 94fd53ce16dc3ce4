"""License scans with a positional rare-token index, in DataFrame functions only.

A template is a list of words and a mandatory key phrase in it, given by its place. Over all documents the number of
documents that hold each licence word is counted; the (up to) two words of a key phrase with the highest inverse
document frequency are the template's entry in the index, with their positions in the template. A file is read once:
the positions of index words are kept, each gives the place where a template would start, and the places of both words
are intersected, so words that stand in another relative position are out. At the remaining places the key phrase has
to stand word by word, and at least ``least`` of all the template's words have to be in place. As index words are
taken from the mandatory phrase, no place can be missed, whichever words are rare in a corpus.

Defined results: null and empty texts have no words and no labels; texts of any length are read whole; equal rows give
equal rows; a null id stays null; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a text whose A-Z are lowered later, word by word.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases that licences are known by. Words hold no "k": lower() also makes one of the Kelvin sign.
#: label -> (words, start and end of the key phrase). The first three are all phrase.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
TEMPLATES: dict[str, tuple[str, int, int]] = {
    "apache-2.0": ("licensed under the apache license version 2 0", 3, 5),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", 0, 3),
    "cc-by-nc": ("licensed under cc by nc 4 0", 2, 5),
    "cc-by-nd": ("licensed under cc by nd 4 0", 2, 5),
    "cc-by-sa": ("licensed under cc by sa 4 0", 2, 5),
    "gpl-2.0": ("gnu general public license version 2", 1, 6),
    "gpl-3.0": ("gnu general public license version 3", 1, 6),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee", 0, 4),
    "lgpl": ("gnu lesser general public license", 1, 5),
    "mit": ("released under the mit license", 3, 5),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software", 0, 4),
    "mpl-2.0": ("subject to the terms of the mozilla public license", 6, 9),
    "public-domain": ("this is free and unencumbered software released into the public domain", 9, 11),
}
LEAST = 0.8


def templates() -> dict[str, tuple[list[str], int, int]]:
    phrases = {label: (p.split(), 0, len(p.split())) for label, p in BASE.items()}
    return phrases | {label: (p.split(), a, b) for label, (p, a, b) in TEMPLATES.items()}


def words_of(text_col: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """How many documents hold each licence word; as many rows as the templates have words."""
    phrase_words = sorted({w for words, a, b in templates().values() for w in words[a:b]})
    held = F.array_intersect(F.transform(words_of(text_col), F.lower), F.array(*map(F.lit, phrase_words)))
    rows = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in phrase_words} | {r["word"]: r["count"] for r in rows}


def rare_token_index(frequency: dict[str, int]) -> dict[str, list[tuple[str, int]]]:
    """label -> up to two (word, position in the template), rarest first."""
    out = {}
    for label, (words, a, b) in templates().items():
        first = {w: i for i, w in reversed(list(enumerate(words[a:b], a)))}
        out[label] = sorted(first.items(), key=lambda x: (frequency.get(x[0], 0), x[1]))[:2]
    return out


def _starts_by(word: str, at: int) -> Column:
    here = F.filter("hits", lambda h: h["word"] == word)
    return F.transform(here, lambda h: h["at"] - F.lit(at))


def _starts(entries: list[tuple[str, int]]) -> Column:
    """Places where a template would start, by all its index words."""
    return reduce(F.array_intersect, [_starts_by(word, at) for word, at in entries])


def _word(place: Column) -> Column:
    return F.lower(F.get(F.col("words"), place))


def _verified(starts: Column, words: list[str], a: int, b: int, least: float) -> Column:
    """(place of the key phrase, share of words in place) where the phrase stands and enough of the rest."""

    def share(s: Column) -> Column:
        same = [F.when(_word(s + F.lit(i)) == w, 1).otherwise(0) for i, w in enumerate(words)]
        return reduce(lambda x, y: x + y, same).cast("double") / F.lit(float(len(words)))

    def phrase(s: Column) -> Column:
        return reduce(lambda x, y: x & y, [F.coalesce(_word(s + F.lit(i)) == words[i], F.lit(False)) for i in range(a, b)])

    held = F.filter(starts, phrase)
    scored = F.transform(held, lambda s: F.struct((s + F.lit(a)).cast("long").alias("at"), share(s).alias("share")))
    return F.filter(scored, lambda x: x["share"] >= F.lit(least))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """Counts and places of the base phrases, the labels of all templates found, and a score per document.

    ``score`` is the largest share of a found template's words that are in place, 0 without any.
    """
    index = rare_token_index(document_frequencies(docs, text_col))
    rare = sorted({w for entries in index.values() for w, _ in entries})
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(text_col).alias("words"))
    numbered = F.transform("words", lambda w, i: F.struct(F.lower(w).alias("word"), i.alias("at")))
    hits = words.select("doc_id", "words", F.filter(numbered, lambda h: h["word"].isin(rare)).alias("hits"))
    found = hits.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        *(_verified(_starts(index[label]), w, a, b, least).alias(label) for label, (w, a, b) in templates().items()),
    )
    labels = list(templates())

    def names(some: list[str]) -> Column:
        parts = [F.when(F.size(F.col(f"`{x}`")) > 0, F.array(F.lit(x))).otherwise(F.array().cast("array<string>")) for x in sorted(some)]
        return F.array_join(F.concat(*parts), ",")

    base = F.transform(F.concat(*(F.col(f"`{x}`") for x in BASE)), lambda x: x["at"])
    shares = F.transform(F.concat(*(F.col(f"`{x}`") for x in labels)), lambda x: x["share"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).alias("first_word"),
        F.array_max(base).alias("last_word"),
        names(list(BASE)).alias("base_labels"),
        names(labels).alias("labels"),
        F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB: every place is tried, without an index."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    columns, labels = [], list(templates())
    for k, (words, a, b) in enumerate(templates().values()):
        phrase = " AND ".join(f"w[s + {i + 1}] = '{words[i]}'" for i in range(a, b))
        share = " + ".join(f"CASE WHEN s + {i} >= 0 AND w[s + {i + 1}] = '{x}' THEN 1 ELSE 0 END" for i, x in enumerate(words))
        tried = f"list_filter(range(-{a}, len(w)), lambda s: {phrase})" if a == 0 else f"list_filter(range(0 - {a}, len(w)), lambda s: s + {a} >= 0 AND {phrase})"
        columns.append(f"list_filter(list_transform({tried}, lambda s: {{'at': s + {a}, 'share': ({share}) / {float(len(words))}::DOUBLE}}), lambda x: x.share >= {LEAST}) AS t{k}")
    base = " || ".join(f"list_transform(t{k}, lambda x: x.at)" for k in range(len(BASE)))
    shares = " || ".join(f"list_transform(t{k}, lambda x: x.share)" for k in range(len(labels)))

    def names(n: int) -> str:
        parts = [f"CASE WHEN len(t{labels.index(x)}) > 0 THEN ['{x}'] ELSE [] END" for x in sorted(labels[:n])]
        return f"array_to_string({' || '.join(parts)}, ',')"

    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
f AS (SELECT doc_id, len(w) AS n_words, {", ".join(columns)} FROM d),
g AS (SELECT *, {base} AS base, {shares} AS shares FROM f)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base,
  CAST(list_min(base) AS BIGINT) AS first_word, CAST(list_max(base) AS BIGINT) AS last_word,
  {names(len(BASE))} AS base_labels, {names(len(labels))} AS labels, coalesce(list_max(shares), 0.0)::DOUBLE AS score
FROM g"""
