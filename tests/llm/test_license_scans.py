import math
import random
import re

import duckdb

from callweave.llm.license_scans import PHRASES, TEMPLATES, THRESHOLD, block_words, matches, oracle, scan, template_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def slow_base(text):
    w = WORD.findall(lowered(text))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def slow_pairs(i, text):
    """Each run of a block's words that begins with a word of the template, against each template."""
    out, w = [], WORD.findall(lowered(text))
    for n, (t, label) in enumerate(TEMPLATES):
        own, length = set(template_words(t)), block_words(t)
        for at in range(len(w)):
            k = len(set(w[at : at + length]) & own) if w[at] in own else 0
            if k and k >= math.ceil(THRESHOLD * len(own) - 1e-9):
                out.append((i, at, n, label, k / len(own)))
    return out


def texts():
    rng = random.Random(8)
    out = [None, "", "MIT License", "mit\nlicense", "The GNU General Public License. Apache-License", "mit license mit license", "Licensed under CC BY-NC 4.0.", "Kind MIT LİCENSE", "x " * 50000 + "apache license"]
    for _ in range(120):
        lines = []
        for _ in range(3):
            w = rng.choice(TEMPLATES)[0].split()
            lines.append(" ".join(x for x in w if rng.random() > rng.choice([0, 0.1, 0.3])).replace("the", rng.choice(["the", "THE", "of"])))
        out.append(rng.choice(["\n", " ", " x y z "]).join(lines))
    out.append(" ".join(["the License of this"] * 3000) + " " + TEMPLATES[3][0])
    return out


def test_rows_equal_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    pairs = sorted((r.key, r.start, r.template_no, r.label, r.containment) for r in matches(df).collect())
    want = sorted(x for i, t, _ in rows for x in slow_pairs(i, t))
    assert pairs == want and len(want) > 100
    got = {r.doc_id: r for r in scan(df).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow_base(t)
        mine = [x for x in want if x[0] == i]
        assert r.labels == ",".join(sorted({x[3] for x in mine} | set(filter(None, r.base_labels.split(",")))))
        assert r.score == (1.0 if r.n_base else max((x[4] for x in mine), default=0.0))


def test_keys_and_repeats(spark):
    rows = [(1, "MIT License"), (1, "MIT License"), (1, "x"), (None, "Licensed under CC BY-NC 4.0"), (None, None)]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.labels) for r in got) == [(0, ""), (0, "cc-by-nc"), (1, ""), (1, "mit"), (1, "mit")]
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wrapped_notices(spark):
    """Notices are met wherever their lines are broken and whatever leads the lines."""
    by = {label: t for t, label in TEMPLATES}
    rows = []
    for i, label in enumerate(["mit", "bsd", "lgpl", "isc"]):
        w = by[label].split() if label != "mit" else TEMPLATES[1][0].split()
        for j, (width, lead) in enumerate([(3, "# "), (5, " * "), (7, ""), (100, "")]):
            body = "\n".join(lead + " ".join(w[k : k + width]) for k in range(0, len(w), width))
            rows.append((10 * i + j, "Some words come first.\n" + body + "\nand others after it.", label))
    got = {r.doc_id: r.labels for r in scan(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()}
    assert all(label in got[i].split(",") for i, _, label in rows)


def test_scattered_words_are_no_notice(spark):
    filler = " filler" * 12
    rows = [(i, filler.join(t.split())) for i, (t, label) in enumerate(TEMPLATES) if label not in ("mit", "apache", "gpl", "lgpl")]
    assert {r.labels for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {""}


def test_query_equals_its_sql_on_wrapped_and_odd_texts(spark, tmp_path):
    from callweave.llm.queries import QUERIES
    spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op5_license_scans"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(oracle())
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())
