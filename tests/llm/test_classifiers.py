import random
import zlib

import numpy as np
import pytest

from tessella.llm import gam, toxicity
from tessella.llm.labelled import remainder

MODULES = [(gam, "quality", lambda c: c != 0, 0.3), (toxicity, "toxic", lambda c: c != 1, 0.7)]
MOD = {"quality": 5, "toxic": 3}


def held_out(doc_id, label):
    r = zlib.crc32(str(doc_id).encode()) % MOD[label]
    return r == 0 if label == "quality" else r == 1


@pytest.mark.parametrize("query,label", [(gam.op7_quality_classifier, "quality"), (toxicity.op6_toxicity, "toxic")])
def test_held_out_accuracy(spark, query, label):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in query(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == held_out(i, label) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= (0.3 if label == "quality" else 0.7))
    test = [(r[label], got[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if held_out(r.doc_id, label)]
    right = sum(y == p for y, p in test) / len(test)
    found = [p for y, p in test if y == 1]
    assert right > 0.95
    assert sum(found) / len(found) > (0.98 if label == "quality" else 0.7)


@pytest.mark.parametrize("module,label,training,threshold", MODULES)
def test_edges(spark, module, label, training, threshold):
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 99)}" for _ in range(50)]
    rows = [(i, " ".join(rng.sample(words, 20)) + (" vileword" * 3 if i % 2 else ""), "s") for i in range(200)]
    rows += [(900, None, "s"), (901, "", "s"), (902, " \n", "s"), (None, "x y", "s"), (3, rows[3][1], "s"), (903, "w " * 50000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = [(i, i % 2) for i in range(200)] + [(5, 0), (None, 1), (7, None), (5000, 1)]
    labelled = spark.createDataFrame(labels, f"doc_id long, {label} int")
    fold = training(remainder("doc_id", 3))
    out = module.score_documents(docs, labelled, label, fold, threshold).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert module.score_documents(docs.where("false"), labelled, label, fold, threshold).collect() == []
    none = module.score_documents(docs, labelled.where("false"), label, fold, threshold).collect()
    assert {r.score for r in none} == {0.5}


def test_gam_needs_the_interaction():
    rng = np.random.default_rng(1)
    x = np.zeros((4000, len(gam.FEATURES)))
    x[:, :2] = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.Model(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_gains_against_a_plain_loop():
    import zstandard

    toxic, ordinary = [b" vileword bad", b" vileword XXX"], b" XXXXXXXX XXX"

    def size(content, word):
        d = zstandard.ZstdCompressionDict(toxicity.TAIL + content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(5, min_match=5, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(b" " + word + b" " + toxicity.TAIL))

    g = toxicity.Gains(toxic, ordinary)
    text = "A harmless Vileword\tvileword, " + "x" * 300 + " harmless é"
    want = [[size(ordinary, w) - size(t, w) for t in toxic] for w in text.lower().encode().split()]
    assert g.of(text).tolist() == g.of(text).tolist() == want
    assert max(map(max, want)) > 2 and want[1] == [0, 0]
    flat = []
    for k in range(2):
        own = [w[k] for w in want]
        flat.append(float(max(own)))
        for t in toxicity.THRESHOLDS:
            n = sum(v >= t for v in own)
            flat += [np.log1p(n), 10 * np.sqrt(n / len(own))]
    assert np.allclose(toxicity.summary(g.of(text)), flat)
    assert toxicity.summary(g.of("")) == toxicity.summary(g.of(None)) == [0.0] * 14


def test_toxic_recall_by_language(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r.predicted for r in toxicity.op6_toxicity(spark, sf).where("held_out").collect()}
    rows = spark.read.parquet(f"{sf}/labels.parquet").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    found = {}
    for r in rows:
        if r.doc_id in got and r.toxic == 1:
            found.setdefault(r.lang, []).append(got[r.doc_id])
    print({k: (sum(v), len(v)) for k, v in found.items()})
    every = [p for v in found.values() for p in v]
    assert sum(every) / len(every) > 0.8 and all(sum(v) / len(v) >= 0.6 for v in found.values())
    hits = [r.toxic for r in rows if got.get(r.doc_id) == 1]
    assert sum(hits) / len(hits) > 0.95


def test_additive_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(2)
    x = rng.random((600, len(gam.FEATURES)))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float)
    m = gam.Model(x, y)
    for row, score in zip(x[:50], m.score(x[:50]), strict=True):
        total = m.base + sum(t[sum(c <= v for c in cuts)] for cuts, t, v in zip(m.cuts, m.tables, row, strict=True))
        for i, j, t in m.pairs:
            total += t[sum(c <= row[i] for c in m.coarse[i]), sum(c <= row[j] for c in m.coarse[j])]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12


def test_features_of_a_small_text():
    text = "One one two!! | x1 .\n\nOne one two!! | x1 .\nlast #"
    got = dict(zip(gam.FEATURES, gam.features(text), strict=True))
    words = text.split()
    assert got["log_words"] == np.log(len(words)) and got["word_length"] == sum(map(len, words)) / len(words)
    share = lambda cs: sum(c in cs for c in text) / len(text)
    assert got["symbol_share"] == share("#") and got["shout_share"] == share("!") and got["bar_share"] == share("|")
    assert got["capital_share"] == share("O") and got["digit_share"] == share("1") and got["stop_share"] == share(".")
    assert got["distinct_share"] == len(set(words)) / len(words)
    assert got["neighbour_share"] == sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
    assert got["top_share"] == max(map(words.count, words)) / len(words)
    assert got["line_length"] == np.log1p(len(words) / 3) and got["line_repeat_share"] == 1 - 2 / 3
