"""Secrets in texts, with DataFrame functions only: strong spans by pattern, weak ones by company.

Patterns give candidate spans of three parts of a credential: identifiers, secrets and endpoints.
Strong spans (an assignment, an access key id, a long hexadecimal run) are always reported. Weak
ones (a mail address, a mixed run of letters and digits, a host) are joined as intervals with the
other parts of the same text and reported only with complementary parts within ``reach`` code
points: an identifier with a secret, a secret with an identifier, an endpoint with both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points between the starts of parts that belong together.
REACH = 200


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: kind: (part, strong, pattern, what a match must meet besides). All hold in Java and in RE2 alike
#: but for the looks behind, which only keep a search from trying every place inside a run, and the
#: ++ of a repeated group, which matches the same without a frame of Java's stack for each turn.
KINDS = {
    "assign": ("secret", True, rf"""(?:{KEYWORDS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", [r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$"""]),
    "access": ("identifier", True, r"AKIA[A-Z0-9]{16,}", []),
    "hex": ("secret", True, r"[0-9a-f]{24,}", []),
    "mail": ("identifier", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", []),
    "key": ("secret", False, r"(?<![A-Za-z0-9+/_-])[A-Za-z+/_-]*[0-9][A-Za-z0-9+/_-]*", [r"^.{16,}$", "[A-Z]", "[a-z]"]),
    "host": ("endpoint", False, r"""(?:https?|jdbc:[a-z]+|ssh|ftp)://[^\x00-\x20"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?""", []),
}
ORDER = list(KINDS)


def _found(text: Column, kind: str) -> Column:
    """The matches of a kind in the order of the text, with the code points between them."""
    _, _, pattern, _ = KINDS[kind]
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.transform(
        F.arrays_zip(hits.alias("hit"), gaps.alias("gap")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("no"), x["hit"].alias("hit"), x["gap"].alias("gap")),
    )
    empty = F.lit(None).cast("array<struct<kind:string,no:int,hit:string,gap:int>>")
    return F.coalesce(F.when(text.rlike(pattern), F.filter(rows, lambda x: x["hit"].isNotNull())).otherwise(empty), F.array().cast("array<struct<kind:string,no:int,hit:string,gap:int>>"))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, kind, part, strong, start, end) of all matches; digest tells texts of a key apart."""
    t = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].alias("key"), F.xxhash64(t).alias("digest"), t.alias("text"))
    hits = rows.select("key", "digest", F.explode(F.concat(*[_found(F.col("text"), k) for k in KINDS])).alias("x")).select("key", "digest", "x.*")
    hits = hits.dropDuplicates(["key", "digest", "kind", "no"])  # of repeated rows
    place = Window.partitionBy("key", "digest", "kind").orderBy("no")
    size = F.length("hit")
    spans = hits.select("key", "digest", "kind", "hit", (F.sum(F.col("gap") + size).over(place) - size).alias("start"), size.alias("size"))
    ok = F.lit(True)
    for kind, (_, _, _, also) in KINDS.items():
        for pattern in also:
            ok = ok & ((F.col("kind") != kind) | F.col("hit").rlike(pattern))
    by = lambda k: F.element_at(F.create_map(*[F.lit(x) for n, v in KINDS.items() for x in (n, v[k])]), F.col("kind"))
    return spans.where(ok).select("key", "digest", "kind", by(0).alias("part"), by(1).alias("strong"), F.col("start").cast("int").alias("start"), (F.col("start") + F.col("size")).cast("int").alias("end"))


def link(found: DataFrame, reach: int = REACH) -> DataFrame:
    """The strong spans, and the weak ones outside them whose complementary parts are near.

    An interval join within each text, as a frame of ``reach`` code points around each span's start,
    so that a text with many spans costs no pairs.
    """
    whole = Window.partitionBy("key", "digest").orderBy("start", F.col("strong").cast("int").desc(), "end", "kind")
    strong_end = F.max(F.when(F.col("strong"), F.col("end"))).over(whole.rowsBetween(Window.unboundedPreceding, -1))
    strong_start = F.min(F.when(F.col("strong"), F.col("start"))).over(whole.rowsBetween(1, Window.unboundedFollowing))
    inside = ~F.col("strong") & ((F.coalesce(strong_end, F.lit(0)) > F.col("start")) | (F.coalesce(strong_start, F.lit(2**31 - 1)) < F.col("end")))
    apart = found.withColumn("inside", inside).where("not inside")
    near = Window.partitionBy("key", "digest").orderBy("start").rangeBetween(-reach, reach)
    has = {p: F.max((F.col("part") == p).cast("int")).over(near) for p in ("identifier", "secret")}
    seen = apart.withColumns({f"near_{p}": c for p, c in has.items()})
    company = (
        F.when(F.col("part") == "identifier", F.col("near_secret") == 1)
        .when(F.col("part") == "secret", F.col("near_identifier") == 1)
        .otherwise((F.col("near_identifier") == 1) & (F.col("near_secret") == 1))
    )
    return seen.where(F.col("strong") | company).select("key", "digest", "kind", "part", "strong", "start", "end")


def scan(docs: DataFrame, reach: int = REACH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_spans, spans): one row for each row of docs.

    Spans are arrays of (start, kind_no, kind, end) by start, then by kind as listed in KINDS, in
    code points with the end exclusive; base_spans holds the strong ones only. Null and empty texts
    have none. Rows that repeat a key with another text are told apart; a null key is a key. Other
    columns are ignored, whatever their names.
    """
    kind_no = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind")).cast("int")
    span = F.struct(F.col("start"), kind_no.alias("kind_no"), F.col("kind"), F.col("end"))
    kept = (
        link(candidates(docs, key, text), reach)
        .groupBy("key", "digest")
        .agg(F.sort_array(F.collect_list(span)).alias("spans"))
        .select(F.col("key").alias("key2"), F.col("digest").alias("digest2"), "spans")
    )
    rows = docs.select(docs[key].alias("key"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("digest"))
    joined = rows.join(kept, rows["key"].eqNullSafe(kept["key2"]) & (rows["digest"] == kept["digest2"]), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int>>"))
    base = F.filter(spans, lambda x: x["kind_no"] <= 3)
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    return joined.select(F.col("key").alias(key), *[count(k).alias(f"n_{k}") for k in ORDER[:3]], base.alias("base_spans"), spans.alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def oracle(reach: int = REACH) -> str:
    """The query's rows in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for n, (kind, (part, strong, pattern, also)) in enumerate(KINDS.items(), 1):
        for behind in ("(?<![A-Za-z0-9._%+-])", "(?<![A-Za-z0-9+/_-])", "(?<![0-9.])"):
            pattern = pattern.replace(behind, "")
        pattern = pattern.replace("++", "+")
        meets = " AND ".join(f"regexp_matches(hit, {q(p)})" for p in also) or "true"
        parts.append(f"""
SELECT doc_id, {n} AS kind_no, {q(kind)} AS kind, {q(part)} AS part, {str(strong).lower()} AS strong, start, start + length(hit) AS stop FROM (
  SELECT doc_id, hit, sum(gap + length(hit)) OVER (PARTITION BY doc_id ORDER BY no) - length(hit) AS start FROM (
    SELECT doc_id, unnest(hits) AS hit, unnest(list_transform(gaps[1:len(hits)], lambda x: length(x))) AS gap, unnest(range(len(hits))) AS no FROM (
      SELECT doc_id, regexp_extract_all(text, {q(pattern)}) AS hits, string_split_regex(text, {q(pattern)}) AS gaps FROM t WHERE regexp_matches(text, {q(pattern)})))) WHERE {meets}""")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts)}),
apart AS (SELECT * FROM found a WHERE strong OR NOT EXISTS (SELECT 1 FROM found b WHERE b.doc_id = a.doc_id AND b.strong AND b.start < a.stop AND b.stop > a.start)),
near AS (SELECT *, max(part = 'identifier') OVER w AS near_id, max(part = 'secret') OVER w AS near_secret FROM apart
  WINDOW w AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)),
kept AS (SELECT *, kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) AS span FROM near
  WHERE strong OR CASE part WHEN 'identifier' THEN near_secret WHEN 'secret' THEN near_id ELSE near_id AND near_secret END),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY start, kind_no) FILTER (strong) AS base, string_agg(span, ',' ORDER BY start, kind_no) AS spans FROM kept GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)"""
