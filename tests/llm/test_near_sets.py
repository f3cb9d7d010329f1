import random

import corpus_pipeline


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stage_drops_documents_with_a_few_changed_words(spark):
    rng = random.Random(5)
    rows, want = [], []
    for i in range(0, 400, 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(120, 300))]
        other = list(words)
        for k in rng.sample(range(len(words)), rng.randrange(1, 1 + len(words) // 30)):
            other[k] = f"v{rng.randrange(10**6)}"
        a, b = grams(" ".join(words)), grams(" ".join(other))
        rows += [(i, " ".join(words), "s"), (i + 1, " ".join(other), "s")]
        want += [i] if len(a & b) >= 0.8 * len(a | b) else [i, i + 1]
    rows += [(1000, None, "s"), (1001, " ", "s"), (1002, "One two", "s"), (1003, "one  two", "s"), (None, rows[0][1], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    got = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and got.count(None) == 1
    assert 200 < len(want) < 400
    assert sorted(i for i in got if i is not None) == sorted([*want, 1000, 1002])
    assert corpus_pipeline.near_duplicate_stage(spark, docs.where("false"), "").collect() == []
