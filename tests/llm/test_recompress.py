import hashlib
import random
import re

import pytest

from tessella.llm import recompress


def plain(rows, window=50):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def compare(spark, rows, window=50):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sym string, n_words int")
    got = recompress.dedup(df, window, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, window)


def test_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    compare(spark, rows)
    assert sum(r[2] for r in plain(rows)) > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n, v=vocabulary: [rng.choice(v) for _ in range(n)]
    passages = [text(rng.choice([49, 50, 51, 53, 60, 90, 300])) for _ in range(12)]
    passages += [["a"] * 70, ["a", "b"] * 45, ["a", "b", "c"] * 30]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            cutoff = rng.randint(0, 5)
            parts += text(rng.randint(0, 80)) + p[cutoff : len(p) - rng.randint(0, 5)]
        rows.append((i, " ".join(parts)))
    rows += [(100 + i, "a " * n) for i, n in enumerate((49, 50, 51, 200, 3000))]
    rows += [(200 + i, "a b " * n + "z") for i, n in enumerate((25, 26, 400))] + [(300, " a b" * 500)]
    rng.shuffle(rows)
    compare(spark, rows)


def test_edges(spark):
    long = " ".join(str(i % 997) for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (None, long), (5, long), (5, long), (6, long), (None, None)]
    compare(spark, rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert recompress.dedup(empty).collect() == []


def test_text_and_columns_are_kept(spark):
    p = " ".join(f"p{i}" for i in range(50))
    rows = [(1, f"{p} one", "s", None), (2, f"two\n{p}  three", "t", 5), (3, "x  y", None, 6)]
    got = recompress.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"))
    by = {r.doc_id: r for r in got.collect()}
    assert [by[i].kept_text for i in (1, 2, 3)] == [None, "two three", None]
    assert [by[i].text for i in (1, 2, 3)] == [r[1] for r in rows]
    assert [(by[i].source, by[i].n_chars) for i in (1, 2, 3)] == [r[2:] for r in rows]
