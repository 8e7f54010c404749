"""Substring dedup on sliding sentence spans.

Every run of several consecutive sentences is hashed, the hashes are joined over all documents, and
sentences that a repeated run covers are removed everywhere but in the run's first place. Passages that
runs of whole sentences can't hold are found by their words: every 50 consecutive words hold a selected
GRAM of them (winnowing: the least hash), and each selected gram brings the fingerprints of the words on
its two sides, which tell how far a repeated passage goes.

Texts are read twice, and only hashes go through the join's exchange. Each task first settles what its
own documents repeat, some CHUNK of text at a time, and sends on the first place of each hash alone; so
a passage that a third of all documents hold comes to its hash's partition as a row a chunk. There the
rows of a hash follow one another in order, and a task keeps the first and the last of them in mind.
Grams that have more places, and windows of a passage's length that these places leave open, are noted; for
them texts are read once more, each such window is hashed by its words, and its first place anywhere is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Words, blocks, cut, mix, power_tables, with_fields

#: Words of the grams that select what is compared word by word.
GRAM = 26
#: Places just before a gram's that it is compared with at once, besides the first; with all others by windows.
NEAR = 16
#: Grams (8 MB) whose windows are compared in one pass over the texts; more are met in several passes.
WANTED_GRAMS = 1 << 20
#: Bytes of text that a task settles by itself before it sends on what is left (about 100 MB of memory).
CHUNK = 16 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_EVEN = 0xD6E8FEB86659FD93


class Sentences:
    """The sentences of a block: row, first and last byte, number of words, hash of the words.

    A sentence ends after ``.``, ``!`` or ``?`` before white space, at a line end, and at the text's end;
    it includes the white space that follows. What holds no word belongs to the sentence before it.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = self.all_words = Words(data, offsets)
        n = len(data)
        space = _SPACE[data]
        solid = np.where(~space, np.arange(n), -1)
        last = np.maximum.accumulate(solid) if n else solid
        lines = np.concatenate(([0], np.cumsum(data == 10)))
        begins = np.flatnonzero(~space[1:] & space[:-1]) + 1 if n else np.zeros(0, np.int64)
        before = last[begins - 1]
        ends = (lines[begins] > lines[before + 1]) | ((before >= 0) & _STOP[data[before]])
        cuts = np.unique(np.concatenate((begins[ends], offsets[:-1][offsets[:-1] < n])))
        of = np.searchsorted(cuts, w.start, "right") - 1  # the sentence of each word
        head = np.flatnonzero(np.diff(of, prepend=-1))  # the first word of each sentence that has words
        self.row = w.row[head]
        self.words = np.diff(np.append(head, len(of)))
        self.start = cuts[of[head]]
        opens = np.diff(self.row, prepend=-1) != 0
        self.start[opens] = offsets[self.row[opens]]
        self.end = np.append(self.start[1:], n)
        closes = np.append(self.row[1:] != self.row[:-1], True) if len(self.row) else np.zeros(0, bool)
        self.end[closes] = offsets[self.row[closes] + 1]
        place = np.arange(len(of)) - np.repeat(head, self.words)
        value = mix(w.hash + (place.astype(np.uint64) + np.uint64(1)) * _ODD)
        self.hash = mix(np.add.reduceat(value, head)) if len(head) else np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))


def runs(s: Sentences, least: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) sentence of the shortest runs of at least ``least`` sentences and ``words`` words.

    One run begins at each sentence and one ends at each, where the text has enough of them; so whatever
    stretch two texts share, runs that begin and end within it cover it up to both its ends.
    """
    n = len(s.row)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    total = np.concatenate(([0], np.cumsum(s.words)))
    i = np.arange(n)
    fore = np.maximum(np.searchsorted(total, total[:-1] + words, "left") - 1, i + least - 1)
    good = fore < s.first[s.row + 1]
    back = np.minimum(np.searchsorted(total, total[1:] - words, "right") - 1, i - least + 1)
    fine = back >= s.first[s.row]
    a = np.concatenate((i[good], back[fine]))
    b = np.concatenate((fore[good], i[fine]))
    code = np.unique(a * (n + 1) + b)
    a, b = code // (n + 1), code % (n + 1)
    return s.row[a], a, b


def _run_hashes(s: Sentences, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Two sums over the run, place by place from its first sentence, folded into one 64-bit hash."""
    h = np.zeros(len(first), np.uint64)
    step, k = 1, 0
    live = np.arange(len(first))
    while len(live):
        h[live] += s.hash[first[live] + k] * np.uint64(step)
        step, k = step * _EVEN % (1 << 64), k + 1
        live = live[first[live] + k <= last[live]]
    return mix(h + (last - first).astype(np.uint64) * _ODD)


def _sliding(x: np.ndarray, k: int, least: np.ufunc) -> np.ndarray:
    """least over every k consecutive values."""
    size = 1
    while 2 * size <= k:
        x, size = least(x[: len(x) - size], x[size:]), 2 * size
    return least(x[: len(x) - (k - size)], x[k - size :]) if size < k else x


def selected_grams(w: Words, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the grams of a block that are the least of some ``passage`` consecutive words of a row."""
    n = len(w.hash)
    if n < passage:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(w.hash * up[:n], out=sums[1:])
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    whole = w.row[: n - passage + 1] == w.row[passage - 1 :]
    least = np.where(whole, _sliding(gram, passage - GRAM + 1, np.minimum), 0)
    pad = np.zeros(passage - GRAM, np.uint64)
    at = np.flatnonzero((_sliding(np.concatenate((pad, least, pad)), passage - GRAM + 1, np.maximum) == gram) & (gram > 0))
    return at, gram[at]


class Spans:
    """Spans as columns: hash, doc, key, words (of a gram, not of sentences), first, last, and side: fingerprints of the words before and after a gram."""

    NAMES = ("hash", "doc", "key", "words", "first", "last", "side")

    def __init__(self, **columns: np.ndarray):
        self.__dict__.update(columns)

    def __len__(self) -> int:
        return len(self.hash)

    def take(self, at: np.ndarray) -> Spans:
        return Spans(**{c: getattr(self, c)[at] for c in self.NAMES})

    @classmethod
    def joined(cls, parts: list[Spans]) -> Spans:
        return cls(**{c: np.concatenate([getattr(p, c) for p in parts]) for c in cls.NAMES})


def spans_of(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, keys: np.ndarray, least: int, words: int, passage: int) -> tuple[Spans, np.ndarray]:
    """The spans of a block and the row of each."""
    s = Sentences(data, offsets)
    w = s.all_words
    row, a, b = runs(s, least, words)
    at, gram = selected_grams(w, passage)
    width = passage - GRAM
    mark = (w.hash >> np.uint64(24)).astype(np.uint8)
    mark[mark == 0] = 1  # 0 stands for the text's end
    first, end = w.first[w.row[at]][:, None], w.first[w.row[at] + 1][:, None]
    before, after = at[:, None] - 1 - np.arange(width), at[:, None] + GRAM + np.arange(width)
    side = np.zeros((len(row) + len(at), 2 * width), np.uint8)
    side[len(row) :, :width] = np.where(before >= first, mark[before], 0)
    side[len(row) :, width:] = np.where(after < end, mark[np.minimum(after, len(mark) - 1)], 0) if len(at) else 0
    rows = np.concatenate((row, w.row[at]))
    kind = np.arange(len(rows)) >= len(row)
    from_ = np.concatenate((a - s.first[row], at - w.first[w.row[at]]))
    to = np.concatenate((b - s.first[row], at - w.first[w.row[at]] + GRAM - 1))
    return Spans(hash=np.concatenate((_run_hashes(s, a, b), gram)), doc=docs[rows], key=keys[rows], words=kind, first=from_, last=to, side=side), rows


def open_windows(s: Spans, at: np.ndarray, passage: int) -> np.ndarray:
    """Which windows of ``passage`` words around the grams ``at`` their texts have: the one that begins o words before a gram in column o."""
    width = passage - GRAM
    there = np.ones((len(at), 2, width + 1), bool)
    there[:, :, 1:] = s.side[at].reshape(len(at), 2, width) != 0
    left = np.zeros((len(s), width + 1), bool)
    left[at] = there[:, 0] & there[:, 1, ::-1] & s.words[at][:, None]
    return left


def repeated(s: Spans, at: np.ndarray, keeper: np.ndarray, passage: int, left: np.ndarray, same_text: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): what of the spans ``at`` an earlier place repeats.

    keeper is the first span of each span's hash; the spans of a hash follow one another from it on. Runs are
    repeated as they are. A gram is compared with the keeper and with the NEAR places before it, as far as
    words agree on both sides, and counts where ``passage`` words agree; its windows found so are no longer
    left. Places of the same doc count only for same_text.
    """
    runs_ = at[~s.words[at]]
    found = [(runs_, s.first[runs_], s.last[runs_])]
    width = passage - GRAM
    offset = np.arange(width + 1)
    at = at[s.words[at]]
    for back in range(NEAR + 1):
        before = keeper[at] if back == 0 else at - back
        if back:
            at = at[before > keeper[at]]
            before = at - back
        use = np.flatnonzero(same_text | (s.doc[before] != s.doc[at]))
        differs = np.ones((len(use), 2, width + 1), bool)
        side = s.side[at[use]]
        differs[:, :, :width] = ((side != s.side[before[use]]) | (side == 0)).reshape(len(use), 2, width)
        reach = differs.argmax(axis=2)
        good = reach.sum(axis=1) >= width
        x, reach = at[use[good]], reach[good]
        found.append((x, s.first[x] - reach[:, 0], s.last[x] + reach[:, 1]))
        left[x] &= (offset < width - reach[:, 1:]) | (offset > reach[:, :1])
        at = at[left[at].any(axis=1)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _merged(s: Spans, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, key, words, first, last): ranges of the same text that overlap or meet as one."""
    order = np.lexsort((first, s.words[at], s.key[at], s.doc[at]))
    at, first, last = at[order], first[order], last[order]
    doc, key, words = s.doc[at], s.key[at], s.words[at]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (words[1:] != words[:-1])
    part = np.cumsum(new)
    reach = np.maximum.accumulate(last + part * (1 << 32)) - part * (1 << 32)
    new[1:] |= first[1:] > reach[:-1] + 1
    opens = np.flatnonzero(new)
    ends = np.append(opens[1:], len(at)) - 1
    return doc[opens], key[opens], words[opens], first[opens], reach[ends] if len(opens) else last


_ROW = "hash long, doc_id long, key long, place long, side binary"
#: Kinds of rows: a gram whose windows a chunk leaves open (first is 1 if its own places suffice for that), a span, a place found to be repeated.
WANTED, SPAN, SETTLED = range(3)


def packed(kind: int, words: np.ndarray | bool, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A place as one number, as there are very many: kind, words, first and last in 2, 1, 30 and 30 bits; a text in Arrow's memory has fewer than 2^30 words."""
    return (kind << 61) + (np.asarray(words, np.int64) << 60) + (first << 30) + last


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, words, first, last) of packed places."""
    return place >> 61, (place >> 60) & 1 > 0, (place >> 30) & 0x3FFFFFFF, place & 0x3FFFFFFF


def _row_batch(h: np.ndarray, doc: np.ndarray, key: np.ndarray, kind: int, words: np.ndarray, first: np.ndarray, last: np.ndarray, side: np.ndarray | None) -> pa.RecordBatch:
    n = len(h)
    if side is None:
        sides = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.zeros(n + 1, np.int32).tobytes()), pa.py_buffer(b"")])
    else:
        size = np.where(words, side.shape[1], 0)
        sides = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32).tobytes()), pa.py_buffer(side[words].tobytes())])
    columns = [pa.array(h.view(np.int64)), pa.array(doc), pa.array(key), pa.array(packed(kind, words, first.astype(np.int64), last.astype(np.int64))), sides]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _ROW.split(", ")])


def spans(texts: DataFrame, least: int, words: int, passage: int) -> DataFrame:
    """The spans of texts (doc_id, key, text) that other tasks must see, and, as settled rows, the places that their own chunk shows to be repeated.

    A gram that isn't the first of its hash in its text or chunk, and of which windows are left, makes its hash a wanted one.
    """

    def rest(s: Spans, at: np.ndarray, keeper: np.ndarray, left: np.ndarray, wanted: list[np.ndarray]) -> None:
        at = at[left[at].any(axis=1)]
        wanted.append(np.unique(np.stack([s.hash[at], (at - keeper[at] > NEAR + 1).astype(np.uint64)]), axis=1))

    def settle(held: list[Spans], places: list[tuple], wanted: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        s = Spans.joined(held)
        order = np.lexsort((s.first, s.key, s.doc, s.hash))
        s = s.take(order)
        opens = np.flatnonzero(np.append(True, s.hash[1:] != s.hash[:-1]))
        keeper = np.repeat(opens, np.diff(np.append(opens, len(s))))
        others = np.flatnonzero(s.doc != s.doc[keeper])
        left = open_windows(s, others, passage)
        at, first, last = repeated(s, others, keeper, passage, left)
        rest(s, others, keeper, left, wanted)
        places.append((s.doc[at], s.key[at], s.words[at], first, last))
        doc, key, word, first, last = (np.concatenate(x) for x in zip(*places, strict=True))
        p = Spans(hash=key, doc=doc, key=key, words=word, first=first, last=last, side=key)
        doc, key, word, first, last = _merged(p, np.arange(len(key)), first, last)
        yield _row_batch(mix(key.view(np.uint64) + doc.view(np.uint64) * _ODD), doc, key, SETTLED, word, first, last, None)
        h, many = np.unique(np.concatenate(wanted, axis=1), axis=1)
        none = np.zeros(len(h), np.int64)
        yield _row_batch(h, none, none, WANTED, none > 0, many, none, None)
        again = np.append(False, (s.hash[1:] == s.hash[:-1]) & (s.doc[1:] == s.doc[:-1]) & (s.key[1:] == s.key[:-1]))
        s = s.take(np.flatnonzero((s.doc == s.doc[keeper]) & ~again))
        for k in range(0, len(s), 50_000):
            t = s.take(np.arange(k, min(k + 50_000, len(s))))
            yield _row_batch(t.hash, t.doc, t.key, SPAN, t.words, t.first, t.last, t.side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, places, wanted, size = [], [], [], 0
        for batch in batches:
            docs, keys = (batch.column(k).to_numpy() for k in range(2))
            for lo, hi, data, offsets in blocks(batch.column(2)):
                s, row = spans_of(data, offsets, docs[lo:hi], keys[lo:hi], least, words, passage)
                order = np.lexsort((s.first, s.hash, row))  # what comes again in the same text
                s, row = s.take(order), row[order]
                opens = np.flatnonzero(np.append(True, (s.hash[1:] != s.hash[:-1]) | (row[1:] != row[:-1])))
                keeper = np.repeat(opens, np.diff(np.append(opens, len(s)))) if len(s) else opens[:0]
                again = np.flatnonzero(keeper != np.arange(len(s)))
                left = open_windows(s, again, passage)
                at, first, last = repeated(s, again, keeper, passage, left, same_text=True)
                rest(s, again, keeper, left, wanted)
                places.append((s.doc[at], s.key[at], s.words[at], first, last))
                held.append(s.take(opens[opens < len(s)]))
                size += len(data)
                if size >= CHUNK:
                    yield from settle(held, places, wanted)
                    held, places, wanted, size = [], [], [], 0
        if held:
            yield from settle(held, places, wanted)

    return texts.mapInArrow(run, _ROW)


def repeated_places(found: DataFrame, passage: int) -> DataFrame:
    """(doc_id, key, place): the places to remove, packed, of spans and settled rows.

    Rows with a null key have as place a gram, of which windows are left that places not compared here may repeat.
    """
    width = 2 * (passage - GRAM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first row of the hash at hand, and the rows just before
        asked = np.zeros(0, np.int64)  # the hash at hand, if a chunk has left windows of it open
        for batch in batches:
            h, doc, key, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            kind, words, first, last = unpacked(place)
            side = np.zeros((len(h), width), np.uint8)
            data, offsets = batch.column(4).buffers()[2], np.frombuffer(batch.column(4).buffers()[1], np.int32, len(h) + 1, 4 * batch.column(4).offset)
            if offsets[-1] > offsets[0]:
                side[np.diff(offsets) > 0] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)
            every = Spans(hash=h, doc=doc, key=key, words=words, first=first, last=last, side=side)
            done, s = every.take(np.flatnonzero(kind == SETTLED)), every.take(np.flatnonzero(kind == SPAN))
            ask = kind == WANTED
            many, asked = h[ask & (first == 1)], np.append(asked, h[ask])
            extra = len(held) if held is not None else 0
            if extra:
                s = Spans.joined([held, s])
            opens = np.flatnonzero(np.append(True, s.hash[1:] != s.hash[:-1])) if len(s) else np.zeros(0, np.int64)  # the held rows are of one hash
            size = np.diff(np.append(opens, len(s)))
            keeper = np.repeat(opens, size)
            rows = np.arange(extra, len(s))
            rows = rows[s.doc[rows] != s.doc[keeper[rows]]]
            left = open_windows(s, rows, passage)
            at, a, b = repeated(s, rows, keeper, passage, left)
            doc, key, words = (np.append(getattr(done, c), x) for c, x in (("doc", s.doc[at]), ("key", s.key[at]), ("words", s.words[at])))
            place = packed(SETTLED, words, np.append(done.first, a), np.append(done.last, b))
            beyond = rows[rows - keeper[rows] > NEAR]
            grams = np.unique(np.concatenate([many, s.hash[beyond[left[beyond].any(axis=1)]], np.intersect1d(asked, s.hash[opens[size > 1]])]))
            none = pa.nulls(len(grams), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(place)], names=["doc_id", "key", "place"])
            yield pa.RecordBatch.from_arrays([none, none, pa.array(grams)], names=["doc_id", "key", "place"])
            if len(s):
                k = keeper[-1]
                held = s.take(np.append(k, np.arange(max(k + 1, len(s) - NEAR), len(s))))
            asked = asked[asked >= (held.hash[0] if len(s) else h[-1] if len(h) else np.iinfo(np.int64).min)]

    return found.repartition("hash").sortWithinPartitions("hash", F.shiftright("place", 61), "doc_id", "key", "place").mapInArrow(run, "doc_id long, key long, place long")


def window_places(texts: DataFrame, grams: np.ndarray, passage: int) -> DataFrame:
    """(doc_id, key, place) of the windows of ``passage`` words that hold one of these selected grams and have an earlier place.

    A task settles a CHUNK by itself and sends the first place of each window.
    """
    shared = texts.sparkSession.sparkContext.broadcast(np.sort(grams))
    names = ["doc_id", "key", "first", "window"]

    def first_places(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows (window, doc, key, first) in order: which an earlier one repeats, and the first row of each's window."""
        w, doc, key, first = rows
        same = np.append(False, w[1:] == w[:-1])[: len(w)]
        opens = np.flatnonzero(~same)
        keeper = np.repeat(opens, np.diff(np.append(opens, len(w))))
        own = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))[: len(w)])
        own = np.repeat(own, np.diff(np.append(own, len(w))))
        return (doc != doc[keeper]) | (first != first[own]), keeper

    def batch_of(rows: np.ndarray, known: bool) -> pa.RecordBatch:
        w, doc, key, first = rows
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(first), pa.array(w, mask=np.full(len(w), known))], names=names)

    def settle(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(parts, axis=1)
        rows = rows[:, np.lexsort(rows[::-1])]
        gone, keeper = first_places(rows)
        yield batch_of(rows[:, gone], True)
        yield batch_of(rows[:, ~gone], False)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            docs, keys = (batch.column(k).to_numpy() for k in range(2))
            for lo, hi, data, offsets in blocks(batch.column(2)):
                w = Words(data, offsets)
                at, gram = selected_grams(w, passage)
                gram = gram.view(np.int64)
                at = at[shared.value[np.minimum(np.searchsorted(shared.value, gram), len(shared.value) - 1)] == gram]
                n = len(w.hash)
                near = np.zeros(n + 1, np.int64)  # where windows that hold a gram begin, as differences
                np.add.at(near, np.maximum(at - (passage - GRAM), 0), 1)
                np.add.at(near, at + 1, -1)
                start = np.flatnonzero(np.cumsum(near)[:n] > 0)
                start = start[start + passage <= n]
                start = start[w.row[start] == w.row[start + passage - 1]]
                up, down = power_tables(n)
                sums = np.zeros(n + 1, np.uint64)
                np.cumsum(w.hash * up[:n], out=sums[1:])
                h = mix((sums[start + passage] - sums[start]) * down[start]).view(np.int64)
                row = w.row[start]
                parts.append(np.stack([h, docs[lo:hi][row], keys[lo:hi][row], start - w.first[row]]))
                size += parts[-1].shape[1]
                if size >= CHUNK // 16:
                    yield from settle(parts)
                    parts, size = [], 0
        if parts:
            yield from settle(parts)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)  # the first and the last row of the window at hand
        for batch in batches:
            known = batch.column(3).is_null().to_numpy(zero_copy_only=False)
            new = np.stack([x.to_numpy() for x in (batch.column(3).fill_null(0), *batch.columns[:3])])
            rows = np.concatenate([held, new[:, ~known]], axis=1)
            gone, keeper = first_places(rows)
            gone[: held.shape[1]] = False
            out = np.concatenate([new[:, known], rows[:, gone]], axis=1)
            place = packed(SETTLED, True, out[3], out[3] + passage - 1)
            yield pa.RecordBatch.from_arrays([pa.array(out[1]), pa.array(out[2]), pa.array(place)], names=["doc_id", "key", "place"])
            held = rows[:, [keeper[-1], rows.shape[1] - 1]] if rows.shape[1] else held

    sent = texts.mapInArrow(windows, "doc_id long, key long, first long, window long")
    dealt = sent.repartition(F.coalesce("window", F.xxhash64("doc_id", "key"))).sortWithinPartitions("window", "doc_id", "key", "first")
    return dealt.mapInArrow(met, "doc_id long, key long, place long")


def _covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of 0 to n - 1 lie in one of the ranges."""
    gone = np.zeros(n + 1, np.int64)
    inside = first < n
    np.add.at(gone, first[inside], 1)
    np.add.at(gone, np.minimum(last[inside], n - 1) + 1, -1)
    return np.cumsum(gone)[:n] > 0


def remove_repeats(docs: DataFrame, least: int = 2, words: int = 25, passage: int = 50) -> DataFrame:
    """docs with n_sentences, n_removed and cleaned: the text without sentences that a repeated run covers, and without repeated passages.

    A run is ``least`` or more consecutive sentences of together ``words`` or more words. The shortest from
    each sentence on and the shortest up to each are hashed: every longer run consists of them, and is repeated only
    where they are, so they cover what all runs would. Runs are equal if their lower-cased words are. A run
    stays where it comes first: in the smallest doc_id that has it, at its first place there. A passage is
    any ``passage`` (more than GRAM) consecutive words, wherever sentences end; it goes by the same rule, with what
    stands between its last word and the next. Its gram, which every document that holds the passage has selected, is
    compared with the gram's first place and the NEAR places just before, of a text or a CHUNK of texts with its first;
    what of it these don't show to be repeated is compared with all other places, by the hashes of its windows' words, in one
    more pass over the texts for each WANTED_GRAMS of such grams. So a passage goes whole wherever it first stood. A
    fingerprint has 8 bits, so at one end in 256 a word too many goes.
    n_removed counts the sentences of which no word stays.

    A null text gives null, 0 and 0. Empty texts and texts without words stay as they are. Rows that
    repeat a doc_id count as one document: what only they share stays. Rows with a null doc_id take no
    part and stay as they are. A text of any length is one row in memory. Other columns are carried along; three new columns are added, and
    columns of those names in docs are replaced. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "cleaned")]
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    ids = docs.select(doc_id.alias("__doc")).where("__doc is not null").groupBy("__doc").count()
    key = F.lit(0).cast("long") if ids.where("count > 1").isEmpty() else F.xxhash64(doc_id, text)  # tells texts of one doc_id apart
    keyed = docs.select(*kept, doc_id.alias("__doc"), key.alias("__key"))
    texts = keyed.where("__doc is not null and text is not null").select("__doc", "__key", text)
    near = cut(repeated_places(spans(texts, least, words, passage), passage))
    places, grams = near.where("key is not null"), near.where("key is null").select("place").distinct()
    n = -(-grams.count() // WANTED_GRAMS)
    for k in range(n):
        some = grams.where(F.pmod(F.xxhash64("place"), F.lit(n)) == k).toPandas()["place"].to_numpy(np.int64)
        if len(some):
            places = places.union(window_places(texts, some, passage))
    places = places.groupBy(F.col("doc_id").alias("__doc"), F.col("key").alias("__key")).agg(F.collect_set("place").alias("__places"))
    wide = keyed.join(places, ["__doc", "__key"], "left").select(*kept, text.alias("__text"), "__places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, places = (batch.column(len(kept) + k) for k in range(2))
            for lo, hi, data, offsets in blocks(text):
                s = Sentences(data, offsets)
                w = s.all_words
                out, n_gone = text[lo:hi].to_pylist(), np.zeros(hi - lo, np.int64)
                for i in np.flatnonzero(places[lo:hi].is_valid().to_numpy(zero_copy_only=False)):
                    a, b, x, y = s.first[i], s.first[i + 1], w.first[i], w.first[i + 1]
                    if a == b:
                        continue
                    _, of_words, first, last = unpacked(places[lo + i].values.to_numpy())
                    gone = _covered(first[~of_words], last[~of_words], b - a)
                    lost = _covered(first[of_words], last[of_words], y - x)
                    stays = np.zeros(offsets[i + 1] - offsets[i] + 1, np.int64)  # bytes that go, as differences
                    edges = np.append(w.start[x:y], offsets[i + 1]) - offsets[i]
                    np.add.at(stays, edges[:-1][lost], 1)
                    np.add.at(stays, edges[1:][lost], -1)
                    np.add.at(stays, s.start[a:b][gone] - offsets[i], 1)
                    np.add.at(stays, s.end[a:b][gone] - offsets[i], -1)
                    stays = np.cumsum(stays)[:-1] == 0
                    out[i] = data[offsets[i] : offsets[i + 1]][stays].tobytes().decode()
                    sentence = np.searchsorted(s.start[a:b], w.start[x:y], "right") - 1
                    n_gone[i] = (gone | (np.bincount(sentence[~lost], minlength=b - a) == 0)).sum()
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k)[lo:hi] for k in range(len(kept))), pa.array(np.diff(s.first).astype(np.int64)), pa.array(n_gone), pa.array(out, pa.string())],
                    names=[*kept, "n_sentences", "n_removed", "cleaned"],
                )

    return wide.mapInArrow(run, with_fields(wide.select(*kept), "n_sentences long, n_removed long, cleaned string"))
