"""Interaction audit of five filters: what each removes at each step of each order.

Every document is reduced to a mask of the filters that it fails, and the masks are counted per part
of the corpus. A recursive query walks the prefixes of orders: a prefix is extended by each letter
that it doesn't have yet, its applied bits are carried along and met with every mask cell, and a level
says of each cell whether it is kept, removed here, or removed before though it fails here too. These
are 326 prefixes by 32 cells whatever the corpus is; the counted cells of the parts meet them by mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.components import cut, with_group

LETTERS = "ABCDE"
BLANKS = r"[\x20\x09-\x0D]+"
#: Columns of counts of a step.
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_masks(text: Column, min_words: int = 200, min_distinct: int = 50, max_capitals: int = 3, symbols: str = "#$%&*|") -> Column:
    """The bits of A, B, C and D (1, 2, 4, 8): too few words, too few distinct ones, too many capitals, symbols."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n = F.size(words)
    fails = [
        n < min_words,
        100 * F.size(F.array_distinct(words)) < min_distinct * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > max_capitals * F.length(text),
        F.regexp_like(text, F.lit("[" + "".join("\\" + c for c in symbols) + "]")),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))


def document_masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(key, part, mask) of each row; bit 16 is for a text that a smaller key has as well.

    Copies are found by the SHA-256 of the whole text; a group of copies of any size is dealt over
    salts. A null text is an empty one. A row without a key is never a copy, and is none's original.
    """
    whole = F.coalesce(docs[text], F.lit(""))
    rows = cut(docs.select(docs[key].alias("key"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), text_masks(whole).alias("mask"), F.unhex(F.sha2(whole, 256)).alias("digest")))
    met = with_group(rows, ["digest"], F.col("key"), low=F.min("key"))
    return met.select("key", "part", (F.col("mask") + F.when(F.col("low") < F.col("key"), 16).otherwise(0)).alias("mask"))


def count_cells(masks: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each cell, and those labelled good and toxic.

    Equal rows are counted before they meet the labels, so that a repeated key is one row there. A
    key with several labels is good, or toxic, if one of them says so.
    """
    rows = masks.groupBy("key", "part", "mask").count()
    marks = labels.where(labels[key].isNotNull()).groupBy(labels[key].alias("label_key")).agg(F.max((labels["quality"] == 1).cast("int")).alias("good"), F.max((labels["toxic"] == 1).cast("int")).alias("toxic"))
    met = rows.join(marks, rows["key"] == marks["label_key"], "left")
    counted = lambda c: F.sum(F.when(F.col(c) == 1, F.col("count")).otherwise(0))
    return met.groupBy("part", "mask").agg(F.sum("count").alias("n"), counted("good").alias("good"), counted("toxic").alias("toxic"))


#: One row for each prefix of each order and each mask cell, with what the prefix's last filter does to it.
WALK = """
WITH RECURSIVE cells AS (SELECT CAST(id AS INT) AS mask FROM range({cells})),
letters AS (SELECT substr('{letters}', CAST(id AS INT) + 1, 1) AS letter, shiftleft(1, CAST(id AS INT)) AS bit FROM range({n})),
walk(prefix, step, applied, mask, kept, removed, redundant, unique_fails) AS (
  SELECT '', 0, 0, mask, 1, 0, 0, 0 FROM cells
  UNION ALL
  SELECT concat(w.prefix, l.letter), w.step + 1, w.applied | l.bit, w.mask,
    IF(w.mask & (w.applied | l.bit) = 0, 1, 0),
    IF(w.mask & l.bit <> 0 AND w.mask & w.applied = 0, 1, 0),
    IF(w.mask & l.bit <> 0 AND w.mask & w.applied <> 0, 1, 0),
    IF(w.mask = l.bit, 1, 0)
  FROM walk w JOIN letters l ON w.applied & l.bit = 0
  WHERE w.step < {n}
)
SELECT * FROM walk WHERE step > 0
"""


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, counts, shapley) of every order of the filters and every part of cells.

    Parts with no document in a cell count zero there. No cells: no rows.
    """
    spark, n = cells.sparkSession, len(letters)
    walk = spark.sql(WALK.format(letters=letters, n=n, cells=1 << n))
    by_prefix = (
        cells.join(F.broadcast(walk), "mask")  # at most 326 prefixes by 32 masks
        .groupBy("part", "prefix", "step")
        .agg(
            *[F.sum(F.col(c) * F.col("n")).alias(c) for c in COUNTS[:4]],
            F.sum(F.col("removed") * F.col("good")).alias("good_lost"),
            F.sum(F.col("removed") * F.col("toxic")).alias("toxic_lost"),
        )
    )
    orders = walk.where(F.col("step") == n).select(F.col("prefix").alias("filter_order")).distinct()
    steps = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    steps = steps.select("filter_order", F.substring("filter_order", F.lit(1), F.col("step")).alias("prefix"))
    every = by_prefix.join(F.broadcast(steps), "prefix").withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    # an order is counted once for each; a prefix stands for all orders that begin with it
    shares = every.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return every.join(shares, ["part", "letter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    Five filters over whole texts: A under 200 words, B under half of the words distinct, C over 3 %
    of capitals, D a symbol, E a text that a smaller key has. One row for each part (a null one is
    the empty string), order and step. A null text is an empty one; repeated rows count each; a row
    without a key fails no E; other columns are ignored, whatever their names. No rows: no rows.
    """
    return audit(cut(count_cells(document_masks(docs, key, text, part), labels, key)))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS low FROM d),
f AS (SELECT e.doc_id, part,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN low < doc_id THEN 'E' ELSE '' END AS fails,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.doc_id AND l.quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.doc_id AND l.toxic = 1) AS toxic FROM e),
g AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
o(x) AS (SELECT '' UNION ALL SELECT x || l FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t(l) WHERE NOT contains(x, l)),
s AS (SELECT x AS filter_order, CAST(step AS INTEGER) AS step, x[step] AS letter, x[1:step - 1] AS before FROM o, range(1, 6) r(step) WHERE length(x) = 5),
m AS (SELECT *, contains(fails, letter) AS failing, before <> '' AND length(translate(fails, before, '')) < length(fails) AS gone FROM g, s),
c AS (SELECT part, filter_order, step, letter,
    CAST(coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (gone AND failing), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (fails = letter), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (NOT gone AND failing AND good), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (NOT gone AND failing AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM m GROUP BY ALL)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM c
"""
