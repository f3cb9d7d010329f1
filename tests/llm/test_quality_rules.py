import re
from collections import Counter

import duckdb

from tessella.llm import quality_rules as q


def plain(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(grams)
    hit = set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit),
        n < 20 or 100 * len(hit) > 30 * n,
    )


TEXTS = [
    None, "", " \n\x0b\t", "one", "a b\nA b\na b\n\na b", "w " * 5000, "x y z " * 40, "é ü\r\né ü\r\n" * 9,
    " ".join(f"w{i}" for i in range(30000)), " ".join(f"w{i}" for i in range(8)) + " q " + " ".join(f"w{i}" for i in range(8)),
    "Home | About | Help | Contact\n" + "Plain words make a sentence here. " * 5, "LOUD TEXT ONLY " * 3 + "é",
    "a# b* c$ d% e& f| g< h> " * 4, "Click here to subscribe to our news.\n" + " ".join(f"v{i}" for i in range(40)),
]


def test_base_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    rows = [(i, t) for i, t in enumerate([r.text for r in docs.collect()] + TEXTS)]
    df = spark.createDataFrame([(*r, 0, False) for r in rows], "doc_id long, text string, n_words int, kept boolean")
    got = {r.doc_id: tuple(r)[-8:-2] for r in q.measure(df).collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_sql_agrees(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = con.execute(q.SQL).fetchall()
    assert sorted(map(tuple, q.op10_quality_rules(spark, sf).collect())) == sorted(want)


def test_verdicts_follow_labels(spark, sf):
    got = {r.doc_id: r.kept for r in q.op10_quality_rules(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [got[r.doc_id] for r in labels if r.quality == 1]
    bad = [got[r.doc_id] for r in labels if r.quality == 0]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.1


def test_clean(spark):
    prose = "\n".join(" ".join(f"w{i}x{j}" for j in range(15)) for i in range(4))
    rows = [
        (1, prose, 5, "a"), (2, prose + "\nHome | About | Help\n" + prose, 6, "b"), (3, "$$$ " * 50, 7, "c"), (None, prose, 8, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string")
    got = q.clean(df)
    assert got.columns == df.columns
    by = {r.doc_id: r for r in got.collect()}
    assert set(by) == {1, 2, None} or set(by) == {1, None}
    assert by[1].text == prose and by[1].n_chars == len(prose)
    empty = q.clean(df.where("false"))
    assert empty.collect() == []
