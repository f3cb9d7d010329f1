import re
import struct

import numpy as np
import pytest
import xxhash

from tessella.llm import simhash

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, shard string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df.select("doc_id", "text")).collect()}
    fps = {r[0]: plain_fingerprint(r[1]) for r in rows}
    want = plain_components(fps)
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == want


def test_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r.doc_id, r.text, 1, "x") for r in rows])


def test_edge_texts(spark):
    texts = [None, "", " \t\n", "one", "One", "a b c", "A B\x0bC", "é É", "a b c d e " * 3000, "a b c d e " * 3001]
    check(spark, [(i, t, None, None) for i, t in enumerate(texts)])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []


@pytest.mark.parametrize("shard", [0.001, 4, 128])
def test_links_find_all_close_pairs(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)  # 0.001: trees as deep as for ten billion
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 7), replace=False)) for b in base]
    fps = {i: f for i, f in enumerate(dict.fromkeys([*map(int, base), *near]))}
    signed = [(struct.unpack("<q", struct.pack("<Q", f))[0],) for f in fps.values()]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), 4).collect()
    at = {s[0]: i for i, s in enumerate(signed)}
    want = plain_components(fps)
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in found:
        a, b = sorted((find(at[r.a]), find(at[r.b])))
        root[b] = a
    assert {i: find(i) for i in fps} == want


def test_some_path_agrees_for_every_difference():
    rng = np.random.default_rng(4)
    found = simhash.paths(4)
    assert len(found) == 16
    for n in range(5):
        for _ in range(4000):
            d = sum(1 << int(k) for k in rng.choice(64, n, replace=False))
            assert any(not d & a and not d & b for a, b in found)
    for own in np.array_split(np.arange(64), 5):  # one block takes all four
        for _ in range(300):
            d = sum(1 << int(k) for k in rng.choice(own, 4, replace=False))
            assert any(not d & a and not d & b for a, b in found)


def test_large_shards_lose_no_link():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 900, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    fps = np.unique(np.concatenate((base, near)))
    ids = {int(f): i for i, f in enumerate(fps.tolist())}
    want = plain_components({i: f for f, i in ids.items()})
    root = {i: i for i in want}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in simhash.shard_links(fps, 4):
        x, y = sorted((find(ids[a & (2**64 - 1)]), find(ids[b & (2**64 - 1)])))
        root[y] = x
    assert {i: find(i) for i in root} == want


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (7, "x y"), (3, "x y"), (None, "q")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = {t: f"{plain_fingerprint(t):016x}" for _, t in rows}
    want = [(None, fps["a b c d"], 7), (7, fps["a b c d"], 7), (7, fps["a b c d"], 7), (7, fps["x y"], 3), (3, fps["x y"], 3), (None, fps["q"], None)]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(want, key=str)


def test_hot_cluster_is_linear():
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**63))
    many = np.unique([base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (3000, 2))]).astype(np.uint64)
    assert len(simhash.shard_links(many, 4)) == len(many) - 1


def test_keep_one(spark):
    rows = [(1, "a b c d e f g", "s"), (2, "a b c d e f g", "s"), (3, "x y z w q r", "s"), (None, "a b c d e f g", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _keep string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3]
