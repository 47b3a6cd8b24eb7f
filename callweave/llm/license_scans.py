"""Licence passages: an exact set-similarity join of text blocks with licence templates.

A block is a run of consecutive words of a text, wherever its lines are broken: as many as the
template has, and ``room`` of that besides for words put in. As a set of words it matches a template
if it holds at least ``threshold`` of the template's different words. Blocks overlap; one begins at each
place of one of the template's words, as any other block holds no more than the one that begins at its
first such word.

Words are ordered by how many texts hold them, rarest first, counted over the whole table. What a
block holds its text holds too, so a text is left out by the words that it has at all: one with a match
holds one of the template's first ``size - need + 1`` words (prefix filter), has ``need`` words at least
(length filter), and, from the first shared word on, enough words on both sides (positional filter).
What passes is verified block by block, in time that goes with the text and the length of a block.
"""

from __future__ import annotations

import math
import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels (fixed by the contract).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Passages that announce a licence, and the label of each.
TEMPLATES = [
    ("Released under the MIT License", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache"),
    ("you may not use this file except in compliance with the License", "apache"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("No part of this work may be reproduced without written permission, all rights reserved", "proprietary"),
]
#: Share of a template's words that a block must hold.
THRESHOLD = 0.9
#: Words of a block besides as many as the template has, as a share of these.
ROOM = 0.25
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one other character that lower-cases to an ASCII letter, and one that doesn't.
KELVIN, OTHER = "K", "ĸ"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit(KELVIN), F.lit(OTHER))), SEPARATORS), "")


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall("[0-9a-z]+", text.lower())))


def block_words(text: str, room: float = ROOM) -> int:
    """Words of a block that is compared with a template."""
    n = len(re.findall("[0-9a-z]+", text.lower()))
    return n + math.ceil(room * n)


def frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """In how many rows each word of the (small, given) vocabulary occurs."""
    known = F.array(*map(F.lit, vocabulary))
    held = docs.select(F.explode(F.array_intersect(words(docs[text]), known)).alias("word"))
    return {w: 0 for w in vocabulary} | {r.word: r["count"] for r in held.groupBy("word").count().collect()}


def _literal(rows: list[tuple], names: list[str]) -> Column:
    return F.array(*[F.struct(*[(F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)).alias(n) for x, n in zip(r, names, strict=True)]) for r in rows])


def matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", room: float = ROOM) -> DataFrame:
    """(key, digest, start, template_no, label, containment) of all blocks that meet the threshold.

    start is the number of the block's first word in its text, from 0.
    """
    sets = [template_words(t) for t, _ in templates]
    vocabulary = sorted(set().union(*sets))
    count = frequencies(docs, vocabulary, text)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count[w], w)))}
    index = []
    for no, (template, label) in enumerate(templates):
        own = sorted(sets[no], key=rank.__getitem__)
        need = max(1, math.ceil(threshold * len(own) - 1e-9))
        index += [(w, no, label, at, own, need, block_words(template, room)) for at, w in enumerate(own[: len(own) - need + 1])]
    prefixes = F.array(*map(F.lit, sorted({x[0] for x in index})))
    known = F.array(*map(F.lit, sorted(rank, key=rank.__getitem__)))
    rows = docs.select(docs[key].alias("key"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("digest"), words(docs[text]).alias("w"))
    rows = rows.where(F.arrays_overlap("w", prefixes))
    # only words of some template can be shared; in the order of the corpus, rarest first
    rows = rows.select("key", "digest", F.array_intersect(known, "w").alias("held"), "w")
    postings = docs.sparkSession.range(1).select(F.inline(_literal(index, ["word", "template_no", "label", "at", "own", "need", "length"])))
    rest = F.least(F.size("held") - F.col("place"), F.size("own") - F.col("at"))
    found = (
        rows.select("*", F.posexplode("held").alias("place", "word"))
        .join(F.broadcast(postings), "word")
        .where((F.size("held") >= F.col("need")) & (rest >= F.col("need")))
        # a template is looked at once for each text, at the rarest word that they share
        .where(F.get(F.array_intersect("own", "held"), F.lit(0)) == F.col("word"))
        .where(F.size(F.array_intersect("own", "held")) >= F.col("need"))
    )
    hits = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda h: F.array_contains("own", h["x"]))
    found = found.select("key", "digest", "template_no", "label", "own", "need", "length", hits.alias("hits"))

    def block(n: Column) -> Column:
        """Where the block of the n-th place begins, and how many of the template's words it holds."""
        first = F.get("hits", n)["i"]
        inside = F.filter(F.slice("hits", n + 1, F.col("length")), lambda h: h["i"] < first + F.col("length"))
        return F.struct(first.alias("start"), F.size(F.array_distinct(inside["x"])).alias("share"))

    # blocks that begin with the last need - 1 places hold too few words
    starts = F.sequence(F.lit(0), F.size("hits") - F.col("need"))
    blocks = found.where(F.size("hits") >= F.col("need")).select("*", F.explode(F.filter(F.transform(starts, block), lambda b: b["share"] >= F.col("need"))).alias("b"))
    return blocks.select("key", "digest", "b.start", "template_no", "label", (F.col("b.share") / F.size("own")).alias("containment"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score): one row for each row.

    n_base counts the places of the base phrases, first_word and last_word their smallest and
    largest start among the words. Labels are distinct, sorted and comma-joined; ``labels`` adds
    those of the templates. The score is 1 with a base phrase, else the largest containment that
    met the threshold, else 0. A null text is an empty one; a text of any length is searched whole. Rows that repeat a key with another
    text are told apart; a null key is a key. Other columns are ignored, whatever their names.
    """
    w = words(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(docs[key].alias("key"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("digest"), docs[text].alias("text"))

    def starts(phrase: str) -> Column:
        p = phrase.split(" ")
        at = F.sequence(F.lit(0), F.size("w") - len(p))
        hit = lambda i: F.array(*[F.get("w", i + k) == x for k, x in enumerate(p)])
        places = F.filter(at, lambda i: F.forall(hit(i), lambda x: x))
        return F.when((F.size("w") >= len(p)) & F.array_contains("w", p[0]), places).otherwise(F.array().cast("array<int>"))

    base = rows.select("key", "digest", w.alias("w")).select(
        "key", "digest", F.size("w").cast("long").alias("n_words"), F.when(F.array_contains("w", "license"), F.array(*map(starts, PHRASES))).alias("places")
    )
    every = F.coalesce(F.flatten("places"), F.array().cast("array<int>"))
    labels = F.array_compact(F.array(*[F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(x)) for i, x in enumerate(PHRASES.values())]))
    base = base.select("key", "digest", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("base"))
    more = matches(docs, templates, threshold, key, text).groupBy("key", "digest").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    more = more.select(F.col("key").alias("key2"), F.col("digest").alias("digest2"), "more", "best")
    joined = base.join(more, base["key"].eqNullSafe(more["key2"]) & (base["digest"] == more["digest2"]), "left")
    text_of = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return joined.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word",
        text_of(F.col("base")).alias("base_labels"),
        text_of(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, room: float = ROOM) -> str:
    """The query's rows in DuckDB's SQL: every block that begins with a word of a template, against that template."""
    w = lambda x: f"list_filter(string_split_regex(translate({x}, '{ascii_uppercase}', '{ascii_lowercase}'), '{SEPARATORS}'), lambda y: y <> '')"
    wanted = ", ".join(f"({i}, '{label}', {template_words(t)!r}, {max(1, math.ceil(threshold * len(template_words(t)) - 1e-9))}, {block_words(t, room)})" for i, (t, label) in enumerate(templates))
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split(" ")
        same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p))
        places.append(f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(len(w)), lambda i: {same})) AS place FROM t WHERE list_contains(w, 'license')")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {w("coalesce(text, '')")} AS w FROM documents),
base AS ({" UNION ALL ".join(places)}),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
tpl(no, label, own, need, length) AS (VALUES {wanted}),
own AS (SELECT no, unnest(own) AS word FROM tpl),
place AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
o AS (SELECT doc_id, no, i, word FROM place JOIN own USING (word)),
held AS (SELECT doc_id, no FROM o JOIN tpl USING (no) GROUP BY doc_id, no, need HAVING count(DISTINCT word) >= need),
p AS (SELECT o.*, i // length AS part FROM o SEMI JOIN held USING (doc_id, no) JOIN tpl USING (no)),
q AS (SELECT doc_id, no, i, word, part FROM p UNION ALL SELECT doc_id, no, i, word, part - 1 FROM p),
hits AS (SELECT a.doc_id, label, count(DISTINCT b.word) / len(own) AS c FROM p a JOIN tpl USING (no) JOIN q b ON b.doc_id = a.doc_id AND b.no = a.no AND b.part = a.part AND b.i >= a.i AND b.i < a.i + length GROUP BY a.doc_id, a.no, a.i, label, own, need HAVING count(DISTINCT b.word) >= need),
every AS (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM hits),
l AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id),
c AS (SELECT doc_id, max(c) AS best FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)"""
