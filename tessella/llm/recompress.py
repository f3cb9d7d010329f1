"""Substring deduplication by recompression.

Every word starts as a symbol. Rounds rename maximal runs a^k and then pairs ab whose
left symbol falls in the left half of the alphabet and whose right one in the right
half (a bit of the name and the round decides). Names are 64-bit digests of what they
replace, so all executors give equal substrings equal names without a dictionary, and
a round needs no exchange. Symbols grow to ``CAP`` words at most.

Near the edges of a repeated passage its two parses can differ. So each symbol carries
its evidence: the word range that the rounds looked at to form it. Wherever that range
recurs, so does the symbol. A window of ``WINDOW`` words knows the symbols whose
evidence it holds, and is filed under the one of smallest digest; equal windows are
filed alike. A window that knows no symbol is filed under its own digest.

Consecutive windows filed alike form a span. Spans found in a smaller doc_id under the
same symbol and with the same words are settled at once, which covers copies. Where a
symbol has several different spans (the edges of passages), the windows of one
representative per span are compared one by one. Both comparisons use two independent
64-bit digests. All groups are aggregated by minimum, never gathered.

Edge cases: null, empty and blank texts have no words; documents under ``WINDOW`` words
keep everything; rows with a null doc_id keep everything and remove nothing elsewhere;
repeated rows (one doc_id) don't remove each other's words; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named_back, read, renamed, store

WINDOW = 50
ROUNDS = 4
CAP = 16
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORDS_AT_ONCE = 60_000
_CACHE = 150_000


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    x = x + _U(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordNames(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[word] = name = xxhash.xxh64_intdigest(word)
        return name


_NAMES = _WordNames()
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(max(n, 1 << 17), b, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS


class Parse:
    """Spans and window digests of some documents, given as lists of words."""

    def __init__(self, docs: list[list[bytes]], window: int = WINDOW, rounds: int = ROUNDS, cap: int = CAP):
        self.window = window
        sizes = np.array([len(d) for d in docs], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        n = int(self.starts[-1])
        get = _NAMES.__getitem__
        names = np.fromiter((get(w) for d in docs for w in d), np.uint64, n)
        power, back = _powers(n + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(names * power[:n], dtype=np.uint64)))
        self.digest = lambda a, b, salt: _mix((sums[b] - sums[a]) * back[a], salt)
        # windows that lie in one document
        first = [np.arange(s, s + k - window + 1) for s, k in zip(self.starts, sizes, strict=False) if k >= window]
        self.at = np.concatenate(first) if first else np.zeros(0, np.int64)
        self.doc = np.searchsorted(self.starts, self.at, side="right") - 1
        self.key = np.zeros(0, np.uint64)
        self.first = self.last = np.zeros(0, np.int64)
        if len(self.at):
            self.file(*self.parse(names, sizes, rounds, cap))

    def parse(self, names, sizes, rounds, cap):
        """Evidence ranges [left, right) of the symbols after all rounds, in order."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        left = np.arange(len(names))
        right = left + 1
        length = np.ones(len(names), np.int64)
        lowest, highest = self.starts[:-1] - 1, self.starts[1:] + 1  # beyond a document's ends

        def merge(group, new_names):
            """Join symbols of equal group number; names given for each group."""
            nonlocal names, left, right, length, doc
            heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            ends = np.concatenate((heads[1:], [len(group)])) - 1
            names, left, right, doc = new_names(heads, ends), left[heads], right[ends], doc[heads]
            total = np.concatenate(([0], np.cumsum(length)))
            length = total[ends + 1] - total[heads]

        def look(where, step):
            """Symbols at ``where`` need to know the neighbour on one side."""
            i = np.flatnonzero(where)
            j = i + step
            inside = (j >= 0) & (j < len(doc))
            j = np.clip(j, 0, len(doc) - 1)
            inside &= doc[i] == doc[j]
            if step < 0:
                return i, np.where(inside, left[j], lowest[doc[i]])
            return i, np.where(inside, right[j], highest[doc[i]])

        for r in range(rounds):
            # runs: a symbol must see that its neighbours differ
            everywhere = np.ones(len(names), bool)
            _, l2 = look(everywhere, -1)
            _, r2 = look(everywhere, 1)
            same = np.concatenate(([False], (names[1:] == names[:-1]) & (doc[1:] == doc[:-1])))
            if same.any():
                run = np.cumsum(~same) - 1
                k = np.bincount(run)[run]
                heads = np.flatnonzero(~same)
                ends = np.concatenate((heads[1:], [len(names)])) - 1
                # all of a run was looked at
                l2, r2 = np.minimum(l2, l2[heads][run]), np.maximum(r2, r2[ends][run])
                left, right = np.minimum(left, l2), np.maximum(right, r2)
                joined = (k > 1) & (k * length <= cap)
                group = np.where(joined, run, 0) + 0
                number = np.cumsum(np.concatenate(([True], ~(joined[1:] & (group[1:] == group[:-1]) & joined[:-1])))) - 1
                old, times = names, k
                merge(
                    number,
                    lambda h, e, old=old, times=times, r=r: np.where(
                        h == e, old[h], _mix(old[h] * _ODD + times[h].astype(np.uint64), 2 * r + 1)
                    ),
                )
            else:
                left, right = np.minimum(left, l2), np.maximum(right, r2)
            # pairs: left symbols look right, right symbols look left
            is_right = (_mix(names, 100 + r) & _U(1)).astype(bool)
            i, r2 = look(~is_right, 1)
            j, l2 = look(is_right, -1)
            joined = np.concatenate(
                ([False], ~is_right[:-1] & is_right[1:] & (doc[1:] == doc[:-1]) & (length[1:] + length[:-1] <= cap))
            )
            right[i] = np.maximum(right[i], r2)
            left[j] = np.minimum(left[j], l2)
            old = names
            merge(
                np.cumsum(~joined) - 1,
                lambda h, e, old=old, r=r: np.where(h == e, old[h], _mix(old[h] * _ODD + old[e], 2 * r + 2)),
            )
        return np.minimum.accumulate(left[::-1])[::-1], np.maximum.accumulate(right)

    def file(self, left, right):
        """Give each window its key, and join windows in a row with one key to spans."""
        w, at = self.window, self.at
        good = (right - left <= w) & (left >= 0) & (right <= self.starts[-1])
        left, right = left[good], right[good]
        lo = np.searchsorted(left, at, side="left")
        hi = np.searchsorted(right, at + w, side="right")
        own = self.digest(left, right, 7)
        n = np.maximum(hi - lo, 0)
        key = self.digest(at, at + w, 8)
        some = np.flatnonzero(n > 0)
        if len(some):
            level, table = 0, own
            bits = np.zeros(len(n), np.int64)
            bits[some] = np.log2(n[some]).astype(np.int64)
            while len(some):
                now = some[bits[some] == level]
                key[now] = np.minimum(table[lo[now]], table[hi[now] - (1 << level)])
                some = some[bits[some] > level]
                if len(some):
                    table = np.minimum(table[: -(1 << level)], table[1 << level :])
                    level += 1
        heads = np.concatenate(([True], (key[1:] != key[:-1]) | (self.doc[1:] != self.doc[:-1])))
        heads |= np.concatenate(([False], at[1:] != at[:-1] + 1))
        first = np.flatnonzero(heads)
        last = np.concatenate((first[1:], [len(at)])) - 1
        self.key, self.first, self.last = key[first], at[first], at[last]
        self.span_doc = self.doc[first]
        self.span = self.digest(self.first, self.last + w, 9)


def _chunks(ids: list, texts: list):
    """Groups of rows of some thousand words: (row numbers, ids, lists of words)."""
    rows, words, held = [], [], 0
    for i, t in enumerate(texts):
        rows.append(i)
        words.append(t.encode("utf-8", "surrogatepass").split() if t else [])
        held += len(words[-1])
        if held > _WORDS_AT_ONCE:
            yield rows, words
            rows, words, held = [], [], 0
    if rows:
        yield rows, words


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(sym, span, doc): the different spans of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for rows, words in _chunks(ids, b.column(1).to_pylist()):
                p = Parse(words, window)
                if len(p.key):
                    rec = np.stack((_signed(p.key), _signed(p.span), ids[rows][p.span_doc]), axis=1)
                    rec = rec[np.lexsort(rec.T)]
                    rec = rec[np.concatenate(([True], (rec[1:] != rec[:-1]).any(axis=1)))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in rec.T], names=["sym", "span", "doc"])
        _NAMES.clear()  # workers are reused by other tasks

    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return known.mapInArrow(run, "sym long, span long, doc long")


def _cover(n: int, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(last + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _result(words: list[bytes], gone: np.ndarray, with_text: bool) -> tuple[int, int, str | None, str | None]:
    n = int(gone.sum())
    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if n else words)
    text = kept.decode("utf-8", "surrogatepass") if with_text and n else None
    return len(words), n, hashlib.sha256(kept).hexdigest(), text


RESULTS = ["n_words", "n_removed", "kept_sha256", "kept_text"]


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and, if asked for, kept_text (null if all is kept).

    The columns of docs stay, text too if ``with_text``; a column of one of the new
    names is replaced.
    """
    docs = docs.drop(*RESULTS)
    own, new = renamed(docs, ("doc_id", "text"))
    out = _dedup(own, window, with_text)
    own = [(n, c) for n, c in zip(new, docs.columns, strict=True) if n != "text" or with_text]
    return out.select(*(F.col(n).alias(c) for n, c in own), *(RESULTS if with_text else RESULTS[:-1]))


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without the passages that stand in an earlier one, with the columns of
    docs, whatever their names; n_chars, if there, follows the text. Emptied documents go."""
    own, new = renamed(docs, ("doc_id", "text"))
    out = _dedup(own, window, True).where("n_removed = 0 or n_removed < n_words")
    out = out.withColumn("text", F.coalesce("kept_text", "text"))
    if "n_chars" in docs.columns:
        at = new[docs.columns.index("n_chars")]
        length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(at))
        out = out.withColumn(at, length.cast(docs.schema["n_chars"].dataType))
    return out.select(*named_back(out, new, docs.columns))


def _dedup(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """``dedup`` of columns doc_id, text and others that clash with no name in here."""
    new = RESULTS
    own = store(spans(docs, window), "spans")
    # symbols of one document only can't be repeats; where all spans agree, they settle it
    shared = own.groupBy("sym").agg(
        F.min("doc").alias("lo"), F.max("doc").alias("hi"), (F.min("span") < F.max("span")).alias("open")
    ).where("lo < hi").select("sym", "open")
    own = store(own.join(shared, "sym"), "shared-spans")
    firsts = own.groupBy("sym", "span").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.first("open").alias("open"))
    # stored, so that the join below deals both its sides itself and can split a hot span
    firsts = store(firsts, "first-spans")
    # copies: every document but the first; edges: the first document of each span
    late = firsts.where("least < most")
    seen = own.drop("open").join(late.select("sym", "span", "least"), ["sym", "span"]).where("doc > least")
    seen = seen.select("doc", "span", "sym", F.lit(False).alias("open"))
    todo = firsts.where("open").select(F.col("least").alias("doc"), "span", "sym", F.lit(True).alias("open"))
    facts = seen.unionByName(todo).groupBy("doc").agg(F.collect_list(F.struct("span", "sym", "open")).alias("facts"))
    facts = facts.select("doc", *(F.col(f"facts.{c}").alias(f"_{c}") for c in ("span", "sym", "open")))

    names = docs.columns
    passed = [c for c in names if c != "text"] + (["text"] if with_text else [])
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    joined = docs.join(facts, F.col("doc_id") == F.col("doc"), "left").select(
        *(F.col(f"`{c}`") for c in names), "_span", "_sym", "_open"
    )
    results = "n_words long, n_removed long, kept_sha256 string, kept_text string"
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in passed)
    schema = f"{schema}, {results}" if schema else results
    extra = "_todo string, _keys array<long>, _digests array<long>, _first array<long>, _last array<long>"

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            facts_of = [t.column(c).to_pylist() for c in ("_span", "_sym", "_open")]
            for rows, words in _chunks([], t.column("text").to_pylist()):
                # only documents with facts are parsed again
                p = Parse([w if facts_of[0][r] else [] for r, w in zip(rows, words, strict=True)], window)
                parts = np.searchsorted(p.span_doc, np.arange(len(rows) + 1)) if len(p.key) else np.zeros(len(rows) + 1, int)
                cols: list[list] = [[] for _ in range(9)]
                for k, (row, own_words) in enumerate(zip(rows, words, strict=True)):
                    span, sym, is_open = (x[row] for x in facts_of)
                    todo, keys, digests, first, last = None, None, None, None, None
                    gone = np.zeros(len(own_words), bool)
                    if span:
                        part = slice(parts[k], parts[k + 1])
                        span, sym, is_open = np.array(span), np.array(sym), np.array(is_open)
                        mark = _signed(p.span[part]) ^ (_signed(p.key[part]) * 3)
                        done = np.isin(mark, (span ^ (sym * 3))[~is_open])
                        wait = np.isin(mark, (span ^ (sym * 3))[is_open]) & ~done
                        a, z = p.first[part], p.last[part]
                        first, last = (a - p.starts[k])[done], (z - p.starts[k])[done]
                        gone = _cover(len(own_words), first, last, window)
                        if wait.any():
                            at = np.concatenate([np.arange(x, y + 1) for x, y in zip(a[wait], z[wait], strict=True)])
                            key = np.repeat(_signed(p.key[part][wait]), (z - a + 1)[wait])
                            dig = _signed(p.digest(at, at + window, 11))
                            both = np.unique(np.stack((key, dig), axis=1), axis=0)
                            todo, keys, digests = b" ".join(own_words).decode("utf-8", "surrogatepass"), both[:, 0], both[:, 1]
                    out = _result(own_words, gone, with_text) if todo is None else (None,) * 4
                    for c, v in zip(cols, (*out, todo, keys, digests, first, last), strict=True):
                        c.append(v)
                arrays = [pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 2 + [pa.string()] * 3 + [pa.list_(pa.int64())] * 4, strict=True)]
                piece = t.slice(rows[0], len(rows))
                columns = [piece.column(names.index(c)).combine_chunks() for c in passed]
                yield pa.RecordBatch.from_arrays(columns + arrays, names=passed + new + [x.split()[0] for x in extra.split(", ")])

    settled = store(joined.mapInArrow(settle, f"{schema}, {extra}"), "settled")
    edges = settled.where("_todo is not null").select(
        F.col("doc_id").cast("long").alias("doc"), F.explode(F.arrays_zip("_keys", "_digests")).alias("x")
    ).select("doc", F.col("x._keys").alias("k"), F.col("x._digests").alias("d"))
    least = edges.groupBy("k", "d").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    hits = edges.join(least, ["k", "d"]).where("doc > least").groupBy("doc").agg(F.collect_list("d").alias("_hits"))
    waiting = settled.where("_todo is not null").join(hits, F.col("doc_id") == F.col("doc"), "left")
    waiting = waiting.select(*(F.col(f"`{c}`") for c in passed), "_todo", "_first", "_last", "_hits")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            cols: list[list] = [[] for _ in range(4)]
            for text, first, last, hits_of in zip(*(t.column(c).to_pylist() for c in ("_todo", "_first", "_last", "_hits")), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                first, last = np.array(first, np.int64), np.array(last, np.int64)
                if hits_of:
                    at = _matching(words, np.array(hits_of, np.int64), window)
                    first, last = np.concatenate((first, at)), np.concatenate((last, at))
                for c, v in zip(cols, _result(words, _cover(len(words), first, last, window), with_text), strict=True):
                    c.append(v)
            arrays = [pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 2 + [pa.string()] * 2, strict=True)]
            columns = [t.column(i).combine_chunks() for i in range(len(passed))]
            yield pa.RecordBatch.from_arrays(columns + arrays, names=passed + new)

    finished = waiting.mapInArrow(finish, schema)
    out = settled.where("_todo is null").select(*(F.col(f"`{c}`") for c in passed), *new).unionByName(finished)
    return out if with_text else out.drop("kept_text")


def _matching(words: list[bytes], wanted: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows whose digest is wanted."""
    n = len(words)
    names = np.fromiter(map(_NAMES.__getitem__, words), np.uint64, n)
    power, back = _powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(names * power[:n], dtype=np.uint64)))
    at = np.arange(n - window + 1)
    return at[np.isin(_signed(_mix((sums[at + window] - sums[at]) * back[at], 11)), wanted)]


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
