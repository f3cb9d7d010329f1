import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tessella.llm import stupid_backoff as sb


def plain(texts, order):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    c = [Counter() for _ in range(3)]
    for w in words:
        for k in range(3):
            c[k].update(tuple(w[i : i + k + 1]) for i in range(len(w) - k))
    total = max(1, sum(c[0].values()))

    def s(gram):
        if len(gram) == 1:
            return math.log(c[0][gram] / total)
        n = c[len(gram) - 1][gram]
        return math.log(n / c[len(gram) - 2][gram[:-1]]) if n >= 2 else math.log(0.4) + s(gram[1:])

    return [(len(w), sum(s(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w))) if w else None) for w in words]


def check(spark, rows, order=3):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, chunk int")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.log_score, r.score) for r in sb.score_documents(df, order).collect()), key=str)
    want = sorted(((i is None, i or 0, n, s) for (i, _), (n, s) in zip(rows, plain([t for _, t in rows], order), strict=True)), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3]
        if w[3] is None:
            assert g[3] is None and g[4] is None
        else:
            assert abs(g[3] - w[3]) < 1e-6 * max(1, abs(w[3])) and abs(g[4] * w[2] - g[3]) < 1e-6 * max(1, abs(g[3]))


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    for order in (2, 3):
        check(spark, [tuple(r) for r in docs], order)


def test_edges(spark):
    check(spark, [(1, None), (2, ""), (3, "one"), (None, "a b a b a"), (4, "a b a b a"), (4, "a b a b a"), (5, "x y " * 40000), (6, " \n")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sb.score_documents(empty).collect() == []


def test_query_counts_triples(spark, tmp_path):
    rows = [(1, "a b c d a b c"), (2, "x b c e b c d"), (3, "a b c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.log_score for r in sb.op2_lm_scores(spark, str(tmp_path)).collect()}
    for (i, _), (_, s) in zip(rows, plain([t for _, t in rows], 3), strict=True):
        assert abs(got[i] - s) < 1e-6 * max(1, abs(s))


def test_names_that_begin_alike_are_told_apart(spark):
    seen = {}
    for i in range(10**6):
        word = f"w{i}"
        top = int(sb.grams([word], 1)[0][0][0]) >> 40
        if top in seen:
            break
        seen[top] = word
    check(spark, [(1, f"{word} x"), (2, f"{seen[top]} y"), (3, word)])


def test_rows_of_one_chunk_in_several_portions(spark):
    rng = np.random.default_rng(5)
    long = " ".join(f"word{i}" for i in rng.integers(0, 3000, 600_000))
    assert len(long) > sb.PORTION_BYTES
    check(spark, [(1, long), (1, long), (1, long), (2, long[:90_000]), (3, None)])


def test_packed_lists():
    rng = np.random.default_rng(6)
    for bits in (3, 12):
        names = np.unique(rng.integers(0, 2**64, 50_000, dtype=np.uint64))
        rows = sb._buckets(names, bits)
        assert [b for b, _, _ in rows] == sorted({int(n) >> 64 - bits for n in names})
        got = [sb._unpack(sb._pack(names[x:y], b << 64 - bits), b << 64 - bits) for b, x, y in rows]
        assert (np.concatenate(got) == names).all()
    for base, own in ((0, [0]), (5 << 61, [5 << 61]), (7 << 61, [2**64 - 1]), (0, [1, 2, 3])):
        own = np.array(own, np.uint64)
        assert (sb._unpack(sb._pack(own, base), base) == own).all()
    for counts in ([1], [1] * 9, [255, 256, 1, 2**40, 2], rng.integers(1, 600, 1000)):
        counts = np.array(counts, np.int64)
        assert (sb._read_counts(sb._counts(counts), len(counts)) == counts).all()
    assert sb._buckets(np.zeros(0, np.uint64), 3) == []


def test_merged_lists():
    rng = np.random.default_rng(7)
    lists = [np.unique(rng.integers(0, 500, n).astype(np.uint64)) for n in (0, 300, 40, 300)]
    names, sums, back = sb._merged(lists, [np.full(len(x), k, np.int64) for k, x in enumerate(lists)])
    want = Counter()
    for k, x in enumerate(lists):
        want.update({int(v): k for v in x})
    assert dict(zip(names.tolist(), sums.tolist(), strict=True)) == dict(want)
    assert (names[back] == np.concatenate(lists)).all()


def test_portions_hold_every_text():
    texts = ["a" * 3_000_000, None, "", "b" * 9_000_000, "c", "d" * 2_000_000]
    for table in (pa.chunked_array([texts]), pa.chunked_array([texts[:2], [], texts[2:]], pa.string())):
        parts = list(sb._portions(table))
        assert [t for p in parts for t in p.to_pylist()] == texts and len(parts) > 1
    assert list(sb._portions(pa.chunked_array([], pa.string()))) == []
