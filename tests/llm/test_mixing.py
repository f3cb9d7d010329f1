import numpy as np

from tessella.llm import mixing


def test_totals_match_targets(spark, sf):
    out = mixing.op9_mixing(spark, "/root/testdata/sf0.01").toPandas()
    assert len(out) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    p = out[["p_clean", "p_toxic", "p_junk"]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (out.rate >= 0).all()
    totals = (p * (out.rate * out.n_tokens).to_numpy()[:, None]).sum(axis=0) / out.n_tokens.sum()
    assert np.allclose(totals, [0.93, 0.05, 0.02], atol=2e-3)
    assert ((out.copies - out.rate).abs() < 1).all()


def test_descent_against_plain_loop(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.5, 0.5, 0.5], 40)
    t = rng.integers(1, 1000, 40)
    cols = [(*[int(k)] * len(mixing.KEY), int(n), *map(float, q)) for k, (n, q) in enumerate(zip(t, p, strict=True))]
    schema = ", ".join(f"{k} int" for k in mixing.KEY) + ", tokens long, p_clean double, p_toxic double, p_junk double"
    weights = {"clean": 0.5, "toxic": 0.5, "junk": 0.0}
    got = mixing.fit_rates(spark.createDataFrame(cols, schema), weights).orderBy(mixing.KEY[0]).toPandas().rate.to_numpy()
    s, w = t / t.sum(), np.array([0.5, 0.5, 0.0])
    r, natural = np.ones(40), s @ p
    for _ in range(mixing.ITERATIONS):
        error = (r * s) @ p - w
        r = np.maximum(0, r - (p @ (error / natural) + mixing.LAMBDA * (r - 1)) / (1 + mixing.LAMBDA))
    assert np.allclose(r, got, atol=1e-3)
    mild = mixing.fit_rates(spark.createDataFrame(cols, schema), {"clean": 0.4, "toxic": 0.35, "junk": 0.25})
    mild = mild.orderBy(mixing.KEY[0]).toPandas().rate.to_numpy()
    assert np.allclose((mild * s) @ p, [0.4, 0.35, 0.25], atol=2e-3)


def test_posteriors_follow_labels(spark):
    sf = "/root/testdata/sf0.1"
    out = mixing.op9_mixing(spark, sf).join(mixing.labelled(spark.read.parquet(f"{sf}/labels.parquet")), "doc_id").toPandas()
    best = out[["p_clean", "p_toxic", "p_junk"]].to_numpy().argmax(axis=1)
    right = best == out.domain.map(mixing.DOMAINS.index)
    assert right.mean() > 0.93


def test_edges_and_columns(spark):
    rows = [(1, None, "a", 7), (2, "", None, None), (None, "x y z", "b", 3), (4, "w " * 50000, "c", 1), (4, "w " * 50000, "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string, rate long")
    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 1), (None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, labels)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(rows)
    assert len(mixing.rates(docs, labels).collect()) == len(rows)
    assert mixing.mix(docs.where("false"), labels).collect() == []
    assert len(mixing.rates(docs, labels.where("false")).collect()) == len(rows)
