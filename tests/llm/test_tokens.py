import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import packing, token_files
from tessella.llm.tokens import Encoder

ODD = [
    "", " ", "\n\n", "a", " a", "a ", "  a  b\n\n c\t\td \n", "it's we'll I'M", "x\x1cy", "a\xa0b \xa0 c", "é ́x",
    "12 345,6 !!?? a.b", "<|endoftext|> x<|startoftext|>y", "　x 　", "tab\tsep\r\nline", "z" * 300, "İSTANBUL ΣΑΣ. don't a'b'c,d o.K", "x1,y á.b ÀÉ!? (foo)[bar]{baz}-qux_z 'twas 's",
    "a ​ b  c", "日本 語",
]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]


@pytest.mark.parametrize("name,blanks", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_segments_encode_like_whole_texts(texts, name, blanks):
    path = public_tokenizers.path(name)
    tok, enc = Tokenizer.from_file(path), Encoder(path, blanks)
    both = [t for t in texts + ODD if t is not None]
    want = [e.ids for e in tok.encode_batch(both, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.many(both)] == want


@pytest.mark.parametrize("name,blanks", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_portions_of_odd_make(name, blanks, monkeypatch):
    from tessella.llm import tokens

    monkeypatch.setattr(tokens, "CACHE", 6)  # so that segments are forgotten all the time
    path = public_tokenizers.path(name)
    tok, enc = Tokenizer.from_file(path), Encoder(path, blanks)
    long = "q" * 65 + " " + "é" * 40 + " x,y " + "7" * 200
    for own in [["a,b c.d"], ["a"], [""], [], ["z,z"], ["a,b c.d", "", "e"], [long], [long, "a b", long + "!"], ODD]:
        want = [e.ids for e in tok.encode_batch(own, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.many(own)] == want
    texts = ["a" * 10, "b", "c" * tokens.PORTION, "d", "e"]
    parts = list(tokens.portions(texts))
    assert [t for _, p in parts for t in p] == texts and [texts[i] for i, _ in parts] == [p[0] for _, p in parts]


ROWS = [(7, "b c", 1), (3, None, 2), (None, "x y", 3), (5, "", 4), (5, "", 4), (9, "long " * 30000, 5)] + [
    (100 + i, t, 6) for i, t in enumerate(ODD)
]


def test_token_files_round_trip(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, segment int").repartition(5)
    out = f"{tmp_path}/files"
    token_files.write_token_files(df, out, path)
    got = token_files.read_token_files(spark, out).orderBy("start").collect()
    start = 0
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in want]
    for r, (_, text, _) in zip(got, want, strict=True):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        raw = np.array(ids, "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)
    assert token_files.read_document(spark, out, 7) == tok.encode("b c", add_special_tokens=False).ids + [2]
    assert token_files.read_document(spark, out, 8) is None


def test_token_files_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_token_files(df, f"{tmp_path}/e", public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.read_token_files(spark, f"{tmp_path}/e").collect() == []


def verify(rows, pieces, capacity=1024):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for doc_id, text in rows:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for p in sorted(by_doc.pop((doc_id, len(ids))), key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert not by_doc
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
    return by_seq


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    seqs = verify(rows, packing.op4_packing(spark, sf).collect())
    total = sum(p.length for own in seqs.values() for p in own)
    assert len(seqs) * 1024 - total < 1024 * docs.rdd.getNumPartitions()


def test_packing_edges(spark):
    rows = [(1, None), (2, ""), (None, "x y z"), (4, "word " * 5000), (5, "q")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, sequence_id string").coalesce(1)
    verify(rows, packing.pack(df, path).collect())
    assert packing.pack(df.where("false"), path).collect() == []


def test_sum_of_squares_choice():
    p = packing.Packer(10)
    p.add(1, np.zeros(4, "<u4"))
    p.add(2, np.zeros(4, "<u4"))  # a second window of level 4 costs 3, filling up to 8 costs 0
    assert p.levels[4] == 0 and p.levels[8] == 1
    p.add(3, np.zeros(2, "<u4"))
    assert p.levels[8] == 0 and len(p.out) == 3
