"""Token ids of whole texts, by the tokenizers library, with a table of known segments.

Both vocabularies split a text before any run of ASCII blanks, and after letters that
ASCII punctuation (but no apostrophe) follows. What stands between such places encodes
alike wherever it stands, so each such segment is encoded once per worker.

A portion of texts is cut at its blanks and its different segments are numbered by
Arrow. Known segments are told by two 64-bit digests, looked up in sorted arrays; their
ids lie in one array, from which those of the portion are gathered. Unknown segments
are split further, before punctuation, as their parts are often known. Texts with other white space, runs of
blanks that a vocabulary keeps, or the opening of a special token are encoded in one
piece, so the ids are always those of the whole text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The opening of special tokens, the mark of cuts, and separators that are no blanks.
_WHOLE = ("<|", "\0", *map(chr, range(0x1C, 0x20)))
#: White space beyond ASCII, and invisible characters beside it.
_OTHER = re.compile("[\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")
#: Characters that lower-casing might treat by context, or to several characters.
_FOLDED_APART = re.compile("[\\u0130\\u0180-\\U0010ffff]")
#: Blanks that do not stand alone as one space or line end between words.
_RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
_PART = re.compile(r"[\t-\r ]*(?:[A-Za-zÀ-ÖØ-öø-ÿ]+(?![^\t-\r !-&(-/:-@\[-`{-~])|[^\t-\r ]+)|[\t-\r ]+")
#: Bound of the table of one worker, in segments (about 60 bytes each).
CACHE = 1_500_000
#: Longer segments, in bytes, are encoded whenever they occur.
LONG_SEGMENT = 64
#: Characters of a portion of texts that are encoded together; a longer text is one.
PORTION = 4 << 20
#: Segments that are encoded in one call, whose results take much memory.
_AT_ONCE = 5000
_rng = np.random.default_rng(11)
_ODD, _ADD = (_rng.integers(0, 2**63, (2, LONG_SEGMENT // 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def digests(segments: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of segments of ``LONG_SEGMENT`` bytes at most."""
    n = len(segments)
    ends = np.frombuffer(segments.buffers()[1], np.int64)[segments.offset : segments.offset + n + 1]
    data = np.frombuffer(segments.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    sizes = np.diff(ends)
    rows = np.zeros(n * LONG_SEGMENT, np.uint8)
    shift = np.arange(n) * LONG_SEGMENT - (ends[:-1] - ends[0])
    rows[np.repeat(shift, sizes) + np.arange(len(data))] = data
    words = rows.view(np.uint64).reshape(n, LONG_SEGMENT // 8)
    out = []
    for odd, add in zip(_ODD, _ADD, strict=True):
        x = words * odd + add
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = ((x ^ (x >> np.uint64(29))) * odd[::-1]).sum(axis=1, dtype=np.uint64) + sizes.astype(np.uint64) * odd[0]
        out.append(x ^ (x >> np.uint64(32)))
    return out[0], out[1]


def portions(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts in portions of bounded size, each with the number of its first text."""
    first = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > PORTION:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, texts[first:]


class Encoder:
    """many(texts): little-endian unsigned 32-bit ids of each text, as bytes.

    ``keeps_blanks`` is false for a vocabulary that folds case and drops white space.
    """

    def __init__(self, path: str, keeps_blanks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        #: the same merges alone, for segments that the rest would hand through
        self.bare = Tokenizer(self.tok.model)
        self.keeps_blanks = keeps_blanks
        self.clear()

    def clear(self) -> None:
        #: digests of known segments, ascending by the first, and their rows
        self.names = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)]
        #: of each row: where its ids begin, how many they are, batches that held it
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def marked(self, text: str) -> str | None:
        """The text with its segments ready to be cut, or None if it has to stay whole."""
        ascii_only = text.isascii()
        for x in _WHOLE:
            if x in text:
                return None
        if not ascii_only and _OTHER.search(text):
            return None
        if self.keeps_blanks:
            for x in _RUNS:
                if x in text:
                    return None
            return text.replace(" ", "\0 ").replace("\n", "\0\n")
        return text if not ascii_only and _folds_apart(text) else text.lower()

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments in a row and how many each has, by the library, a few at a time."""
        one = np.zeros(len(segments), bool)
        for i, w in enumerate(segments):
            word = w[1:] if self.keeps_blanks and w[:1] == " " else w
            # one run of composed letters goes through normaliser and splitter as it is
            one[i] = word.isalpha() and (word.isascii() or max(word) <= "\xff") and (self.keeps_blanks or word.islower())
        sizes, found = np.zeros(len(segments), np.int64), []
        order = np.concatenate((np.flatnonzero(one), np.flatnonzero(~one)))
        border = int(one.sum())
        for tok, lo, hi in ((self.bare, 0, border), (self.tok, border, len(segments))):
            for k in range(lo, hi, _AT_ONCE):
                at = order[k : min(hi, k + _AT_ONCE)]
                part = [segments[i] for i in at.tolist()]
                if tok is self.bare:
                    part = [w if w.isascii() and w[0] != " " else _shown(w) for w in part]
                ids = [e.ids for e in tok.encode_batch_fast(part, add_special_tokens=False)]
                sizes[at] = np.fromiter(map(len, ids), np.int64, len(ids))
                found.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes[at].sum())))
        flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
        # from the order of encoding to that of the segments
        begin = np.zeros(len(segments), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return _taken(flat, begin, sizes), sizes

    def learn(self, segments: list[str], split: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of unknown segments; those of several parts are put together from them."""
        if not split:
            return self.encode(segments)
        # letters never part
        parts = [None if w.isalpha() else _PART.findall(w) for w in segments]
        several = [i for i, p in enumerate(parts) if p is not None and len(p) > 1]
        if not several:
            return self.encode(segments)
        rest = sorted(set(range(len(segments))).difference(several))
        n = np.fromiter((len(parts[i]) for i in several), np.int64, len(several))
        # the others are put in the table first, as they may be parts
        a, a_sizes = self.known(pa.array([segments[i] for i in rest], pa.large_string()), False)
        b, b_sizes = self.known(pa.array(chain.from_iterable(parts[i] for i in several), pa.large_string()), False)
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(b_sizes)))[np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))]
        sizes, begin = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
        sizes[rest], begin[rest] = a_sizes, np.cumsum(a_sizes) - a_sizes
        sizes[several], begin[several] = np.diff(ends), len(a) + ends[:-1]
        return _taken(np.concatenate((a, b)), begin, sizes), sizes

    def known(self, column: pa.LargeStringArray, split: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments of a column in a row, and how many each has."""
        coded = column.dictionary_encode()
        each = coded.dictionary
        rows = np.full(len(each), -1, np.int64)
        short = pc.less_equal(pc.binary_length(each), LONG_SEGMENT).to_numpy(zero_copy_only=False)
        first, second = digests(each if short.all() else each.filter(pa.array(short)))
        rows[short] = self._row_of(first, second)
        new = np.flatnonzero(rows < 0)
        if len(new):
            ids, sizes = self.learn(each.take(pa.array(new)).to_pylist(), split)
            # some were put in the table meanwhile, as parts of others
            rows[short] = self._row_of(first, second)
            left = rows[new] < 0
            begin = (np.cumsum(sizes) - sizes)[left]
            new, sizes = new[left], sizes[left]
            rows[new] = np.arange(len(self.rows[0]), len(self.rows[0]) + len(new))
            more = (len(self.ids) + np.cumsum(sizes) - sizes, sizes.astype(np.int32), np.zeros(len(new), np.int32))
            self.rows = [np.concatenate(x) for x in zip(self.rows, more, strict=True)]
            self.ids = np.concatenate((self.ids, _taken(ids, begin, sizes)))
            fresh = np.flatnonzero(rows[short] >= len(self.rows[0]) - len(new))
            self._file(first[fresh], second[fresh], rows[short][fresh])
        self.rows[2][rows] += 1
        own = rows[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.rows[1][own].astype(np.int64)
        return _taken(self.ids, self.rows[0][own], sizes), sizes

    def _row_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Rows by digests, -1 for those unknown."""
        if not len(self.names[0]):
            return np.full(len(first), -1, np.int64)
        at = np.minimum(np.searchsorted(self.names[0], first), len(self.names[0]) - 1)
        same = (self.names[0][at] == first) & (self.names[1][at] == second)
        return np.where(same, self.names[2][at], -1)

    def _file(self, first: np.ndarray, second: np.ndarray, rows: np.ndarray) -> None:
        both = [np.concatenate((a, b)) for a, b in zip(self.names, (first, second, rows.astype(np.int32)), strict=True)]
        order = np.argsort(both[0], kind="stable")
        self.names = [x[order] for x in both]

    def many(self, texts: list[str]) -> list[bytes]:
        """For one of the ``portions``: its segments are held together."""
        marked = [self.marked(t) for t in texts]
        cut = [m for m in marked if m is not None]
        out = []
        if cut:
            column = pa.array(cut, pa.large_string())
            lists = pc.split_pattern(column, "\0") if self.keeps_blanks else pc.ascii_split_whitespace(column)
            flat, sizes = self.known(lists.flatten())
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
            bounds = ends[lists.offsets.to_numpy()]
            raw = flat.astype("<u4", copy=False).tobytes()
            out = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            if len(self.rows[0]) > CACHE:
                self.forget()
        cut_ids = iter(out)
        return [self.whole(t) if m is None else next(cut_ids) for t, m in zip(texts, marked, strict=True)]

    def forget(self) -> None:
        """Keep the segments that most batches held, at most half of the bound."""
        hits = self.rows[2][self.names[2]]
        keep = hits > 1
        if keep.sum() > CACHE // 2:
            keep = hits > np.partition(hits, len(hits) - CACHE // 2)[len(hits) - CACHE // 2]
        names = [x[keep] for x in self.names]
        start, sizes = self.rows[0][names[2]], self.rows[1][names[2]]
        self.ids = _taken(self.ids, start, sizes.astype(np.int64))
        self.rows = [np.cumsum(sizes, dtype=np.int64) - sizes, sizes, hits[keep] // 2]
        self.names = [names[0], names[1], np.arange(len(sizes), dtype=np.int32)]


def _taken(ids: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ids, one after the other."""
    ends = np.cumsum(sizes)
    at = np.repeat(begin - (ends - sizes), sizes)
    at += np.arange(len(at))
    return ids[at]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in both vocabularies: visible Latin-1
    characters for themselves, the others numbered from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def _shown(segment: str) -> str:
    return segment.encode().decode("latin-1").translate(_LETTERS)


def _folds_apart(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _FOLDED_APART.search(text) is not None
    return False


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keeps_blanks: bool) -> Encoder:
    """One encoder per worker and vocabulary."""
    if (path, keeps_blanks) not in _ENCODERS:
        _ENCODERS[path, keeps_blanks] = Encoder(path, keeps_blanks)
    return _ENCODERS[path, keeps_blanks]
