"""Benchmark decontamination with a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Words, blocks, cut, mix, utf8, with_fields

#: Text of test items in one automaton (about 1.5 million words); more are met in several passes.
SLICE_BYTES = 8 << 20
_PAIR = np.uint64(0xD6E8FEB86659FD93)


class Automaton:
    """A generalised suffix automaton of word sequences, with the windows that each state ends.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
    window. ``feed`` walks words through the automaton and keeps the length of the longest match.
    """

    def __init__(self, items: list[tuple[object, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[tuple[int, int, object]] = []
        for item, words in items:
            last = 0
            for n, word in enumerate(words, 1):
                last = self._extend(last, word)
                size = min(window, len(words))
                if n >= size:
                    ends.append((last, size, item))
        # the state that stands for the window itself: an ancestor whose lengths include the window's size
        self.windows: dict[int, dict[int, set]] = {}
        for state, size, item in ends:
            while self.len[self.link[state]] >= size:
                state = self.link[state]
            self.windows.setdefault(state, {}).setdefault(size, set()).add(item)
        self.least = min((size for _, size, _ in ends), default=1)

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if word in nxt[last]:
            to = nxt[last][word]
            if length[to] == length[last] + 1:
                return to
            return self._clone(last, word, to)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p != -1:
            to = nxt[p][word]
            link[new] = to if length[to] == length[p] + 1 else self._clone(p, word, to)
        return new

    def _clone(self, p: int, word: int, to: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        copy = len(nxt)
        nxt.append(dict(nxt[to]))
        length.append(length[p] + 1)
        link.append(link[to])
        link[to] = copy
        while p != -1 and nxt[p].get(word) == to:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def feed(self, words: list[int]) -> Iterator[tuple[int, int, set]]:
        """(index of the last word, words of the window, items) for every window that occurs."""
        state, matched = 0, 0
        nxt, link, length, windows = self.next, self.link, self.len, self.windows
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                matched += 1
            if matched < self.least:
                continue
            s = state
            while s > 0:
                for size, items in windows.get(s, {}).items():
                    if size <= matched:
                        yield i, size, items
                s = link[s]


class Matcher:
    """Finds the hit words of blocks of text. Only stretches whose word pairs all occur in items are fed."""

    def __init__(self, items: list[tuple[object, list[int]]], window: int):
        self.automaton = Automaton(items, window)
        words = np.array(sorted({w for _, ws in items for w in ws}), np.uint64)
        self.known = words
        pairs = [np.array(ws, np.uint64) for _, ws in items if len(ws) > 1]
        self.pairs = np.unique(np.concatenate([self._pair(p[:-1], p[1:]) for p in pairs])) if pairs else np.zeros(0, np.uint64)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * _PAIR + b)

    @staticmethod
    def _among(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
        if not len(sorted_values):
            return np.zeros(len(values), bool)
        return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values

    def hits(self, w: Words) -> tuple[np.ndarray, dict[int, set]]:
        """A flag for each word of the block, and the items found by row."""
        hit = np.zeros(len(w.hash) + 1, np.int64)
        items: dict[int, set] = {}
        least = self.automaton.least
        n = len(w.hash)
        if not n or not len(self.known):
            return hit[:n] > 0, items
        if least > 1:
            joined = np.zeros(n, bool)
            joined[1:] = (w.row[1:] == w.row[:-1]) & self._among(self._pair(w.hash[:-1], w.hash[1:]), self.pairs)
            opens = np.flatnonzero(~joined)
        else:
            known = self._among(w.hash, self.known)
            joined = np.zeros(n, bool)
            joined[1:] = (w.row[1:] == w.row[:-1]) & known[1:] & known[:-1]
            opens = np.flatnonzero(~joined)
        closes = np.append(opens[1:], n)
        for a, b in zip(opens[closes - opens >= least].tolist(), closes[closes - opens >= least].tolist(), strict=True):
            for i, size, found in self.automaton.feed(w.hash[a:b].tolist()):
                hit[a + i - size + 1] += 1
                hit[a + i + 1] -= 1
                items.setdefault(int(w.row[a]), set()).update(found)
        return np.cumsum(hit)[:n] > 0, items


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[object, list[int]]]]:
    """The distinct items as word hashes, gathered slice by slice; a slice has about SLICE_BYTES of text at most."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLICE_BYTES))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()
        data, offsets = utf8(pa.array([r["text"] for r in rows], pa.string()))
        w = Words(data[offsets[0] : offsets[-1]], offsets - offsets[0])
        words = w.hash.tolist()
        yield [(r["item_id"], words[w.first[i] : w.first[i + 1]]) for i, r in enumerate(rows) if w.count[i]]


_matchers: dict[tuple, Matcher] = {}
_NEW = "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, cleaned string, dropped boolean"
_NAMES = [x.split()[0] for x in _NEW.split(", ")]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_span: int = 0, most_coverage: float = 0.5) -> DataFrame:
    """docs with n_words, n_hit, n_items, items, items_sha256, contaminated, cleaned and dropped.

    A document word is hit if it lies in any occurrence of a window: ``window`` consecutive words of one
    item, or the whole item if it has fewer words but not none. cleaned is the text without stretches of
    more than ``most_span`` consecutive hit words (with the characters between them and up to the next
    word); dropped marks documents with a larger share of hit words than ``most_coverage``.

    Null text: no words, cleaned null. Items with null or no words are never found; items that repeat an
    item_id or a text are each found (an item_id counts once). Rows that repeat a doc_id are treated
    one by one; a null doc_id is carried along. Other columns are carried along, and columns of the new
    names are replaced. A benchmark of more than SLICE_BYTES is gathered and met in slices, one pass
    over the documents for each, so that no automaton grows with it.
    """
    kept = [c for c in docs.columns if c not in _NAMES]
    df = docs.select(*kept, F.col("text").cast("string").alias("__text"), F.lit(None).cast("binary").alias("__hit"), F.lit(None).cast("array<string>").alias("__items"))
    slices = _slices(benchmark)
    now = next(slices)
    while True:
        then = next(slices, None)
        df = _pass(df, kept, now, window, None if then is not None else (most_span, most_coverage))
        if then is None:
            return df
        df, now = cut(df), then


def _pass(df: DataFrame, kept: list[str], items: list, window: int, limits: tuple[int, float] | None) -> DataFrame:
    """Add what one slice of items hits; with limits, which only the last pass has, derive the result's columns."""
    key = (uuid.uuid4().hex, window)
    shared = df.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(shared.value, window)
        for batch in batches:
            text, old_hit, old_items = (batch.column(len(kept) + i) for i in range(3))
            for lo, hi, data, offsets in blocks(text):
                w = Words(data, offsets)
                hit, items = _matchers[key].hits(w)
                for i in np.flatnonzero(old_hit[lo:hi].is_valid().to_numpy(zero_copy_only=False)).tolist():
                    a, b = w.first[i], w.first[i + 1]
                    hit[a:b] |= np.unpackbits(np.frombuffer(old_hit[lo + i].as_py(), np.uint8), count=b - a).astype(bool)
                    items.setdefault(i, set()).update(old_items[lo + i].as_py())
                total = np.concatenate(([0], np.cumsum(hit)))
                n_hit = total[w.first[1:]] - total[w.first[:-1]]
                lists = [sorted(items.get(i, ())) for i in range(hi - lo)]
                same = [batch.column(k)[lo:hi] for k in range(len(kept))]
                if limits is None:
                    bits = [np.packbits(hit[w.first[i] : w.first[i + 1]]).tobytes() if n_hit[i] else None for i in range(hi - lo)]
                    yield pa.RecordBatch.from_arrays([*same, text[lo:hi], pa.array(bits, pa.binary()), pa.array(lists, pa.list_(pa.string()))], names=[*kept, "__text", "__hit", "__items"])
                    continue
                cleaned = [_without(data, offsets, w, hit, i, limits[0]) if n_hit[i] else text[lo + i].as_py() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *same,
                        pa.array(w.count.astype(np.int64)),
                        pa.array(n_hit.astype(np.int64)),
                        pa.array([len(x) for x in lists], pa.int64()),
                        pa.array(lists, pa.list_(pa.string())),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists], pa.string()),
                        pa.array(n_hit > 0),
                        pa.array(cleaned, pa.string()),
                        pa.array(n_hit > limits[1] * w.count),
                    ],
                    names=[*kept, *_NAMES],
                )

    return df.mapInArrow(run, df.schema if limits is None else with_fields(df.select(*kept), _NEW))


def _without(data: np.ndarray, offsets: np.ndarray, w: Words, hit: np.ndarray, i: int, most_span: int) -> str:
    a, b = w.first[i], w.first[i + 1]
    flags = np.concatenate(([0], hit[a:b].astype(np.int8), [0]))
    opens, closes = np.flatnonzero(np.diff(flags) == 1), np.flatnonzero(np.diff(flags) == -1)
    out, at = [], offsets[i]
    for x, y in zip(opens, closes, strict=True):
        if y - x > most_span:
            out.append(data[at : w.start[a + x]].tobytes())
            at = w.start[a + y] if a + y < b else offsets[i + 1]
    out.append(data[at : offsets[i + 1]].tobytes())
    return b"".join(out).decode()
