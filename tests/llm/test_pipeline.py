import re
from itertools import combinations

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import common, mixing, quality_rules

CLASHING = ["doc", "_span", "_sym", "n_words", "kept_text", "_keep", "_copies", "_t", "_w", "_lines", "kept", "_one", "rate", "node", "id", "fp"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_cleaned(rows, n_chars=True):
    """Quality stage by SQL: (doc_id, text) of what stays."""
    con = duckdb.connect()
    con.execute("create table docs_in (doc_id bigint, text varchar)")
    con.executemany("insert into docs_in values (?, ?)", rows)
    out = con.execute(f"with {quality_rules.MEASURE_SQL} select doc_id, kept, left_text, t, left_chars, word_chars from measured").fetchall()
    return {r[0]: r[2] if len(re.sub(r"[\x20\x09-\x0D]", "", r[2])) < r[5] else r[3] for r in out if r[1]}


def plain_near(rows):
    """Ids that stay of near-duplicates: all pairs of five-word sets compared."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, root = {}, {}
    for i, t in rows:
        w = words((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        root[i] = i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i for i in root if find(i) == i}


def plain_without_repeats(rows, window=50):
    least = {}
    split = {i: words(t) for i, t in rows}
    for i, w in split.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, t in rows:
        w, gone = split[i], set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        if not gone:
            out[i] = t
        elif len(gone) < len(w):
            out[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


def test_run_against_plain_stages(spark, sf):
    docs = common.read(spark, sf, "documents")
    by_id = {r.doc_id: r for r in docs.collect()}
    tables = []
    for _, stage in corpus_pipeline.STAGES:
        out = common.store(stage(spark, tables[-1] if tables else docs, sf), "test-stage")
        tables.append(out)
    texts = [{r.doc_id: r.text for r in t.collect()} for t in tables[:3]]
    want = plain_cleaned([(i, r.text) for i, r in by_id.items()])
    assert texts[0] == want
    assert set(texts[1]) == plain_near(sorted(texts[0].items()))
    assert texts[2] == plain_without_repeats(sorted(texts[1].items()))
    rates = mixing.rates(tables[2], common.read(spark, sf, "labels")).collect()
    copies = {r.doc_id: r.copies for r in rates if r.copies}
    mixed = tables[3].groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == copies
    assert all(t.columns == docs.columns for t in tables[:4])
    for r in tables[3].collect():
        assert (r.lang, r.source, r.n_chars) == (by_id[r.doc_id].lang, by_id[r.doc_id].source, len(r.text))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = tables[4].collect()
    sizes = {i: len(tok.encode(texts[2][i], add_special_tokens=False).ids) + 1 for i in copies}
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
        assert p.doc_tokens == sizes[p.doc_id] and p.offset + p.length <= 1024
    assert total == {i: n * copies[i] for i, n in sizes.items()}
    whole = corpus_pipeline.run(spark, sf).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in whole} == total


@pytest.mark.parametrize("k", range(5))
def test_edges_and_clashing_columns(spark, sf, k):
    name, stage = corpus_pipeline.STAGES[k]
    long = " ".join(f"word{i % 4999}" for i in range(30000))
    texts = [None, "", " \n", "short", long, long, "one two three four five six. " * 3, "the quick brown fox jumps over " * 2 + " ".join(f"u{i}" for i in range(60))]
    rows = [(i, t, None if i % 2 else "en", "s", len(t or ""), *[f"{c}-{i}" for c in CLASHING]) for i, t in enumerate(texts)]
    rows += [(None, texts[-1], None, None, None, *[None] * len(CLASHING)), rows[-1]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, sf)
    got = out.collect()
    if name != "packing":
        assert out.columns == docs.columns
        for r in got:
            if r.doc_id is not None:
                assert [r[c] for c in CLASHING] == [f"{c}-{r.doc_id}" for c in CLASHING]
    assert stage(spark, docs.where("false"), sf).collect() == []
