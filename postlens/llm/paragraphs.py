"""Substring deduplication by paragraph MinHash banding.

Texts are cut into paragraphs (between line breaks) of PASSAGE words or more and into sentences.
Equal units meet by digest. Distinct ones meet when a band of their MinHash agrees; bands are tuned
for a recall at the threshold. What meets is verified by exact Jaccard similarity of word shingles,
verified links are clustered by connected components, and every occurrence but a cluster's first is
removed. Five-word shingles at 0.8 leave no near copy of a unit below nine words but an equal one,
so sentences have bands from nine words.

A passage set into other text needs no border of its own: of every WINDOW neighbouring grams of GRAM
words the one of the least hash is an anchor, so equal passages of GRAM + WINDOW - 1 words or more
share one wherever they stand. Anchors that an earlier document holds too are joined into runs, and
a run is extended word by word in both documents to where they differ, by WINDOW - 1 words a side at
most. Without anchors, lines and sentences too short for bands are units together with their
neighbours. Found units that no word lies between are one passage.

Where equal units stand in one chunk of texts, all but the first are settled before the shuffle, so a
unit that many documents hold is dealt once a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Forest, chunks, discard, edge_batch, fresh, lean, materialize, runs
from .components import connected_components

#: Shingle words, similarity, recall of the bands at it, rows of a band.
WIDTH, SIMILAR, RECALL, ROWS = 5, 0.8, 0.999, 2
#: Fewest words of a unit, and of a passage that is removed.
UNIT, PASSAGE = 8, 25
#: Words of an anchor, and neighbouring grams of which one is an anchor: GRAM at most, so that a run's anchors touch.
GRAM, WINDOW = 26, 25
#: Paragraphs of one bucket verified in one go; larger buckets are split.
BUCKET = 1_024
#: Nodes of a task's forest of links.
MEMBERS = 500_000
#: Characters of texts cut in one go, and of a piece whose words are found in one go.
CHUNK, PIECE = 1 << 19, 1 << 16
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
_STOPS, _CLOSERS = (np.array(sorted(map(ord, x)), np.uint32) for x in (".!?…。！？", "\"')]}”’»"))
_OUTER = np.isin(np.arange(129), list(map(ord, ".,;:!?\"'()[]")))
_M = np.uint64(0xD6E8FEB86659FD93)
#: Keeps equal words apart where one unit of them has bands and the other has none.
_BARE = np.int64(0x5851F42D4C957F2D)
_BASE = 0x9E3779B97F4A7C15
_POWERS, _INVERSES = (np.array([pow(b, k, 1 << 64) for k in range(4096)], np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
_FAR = np.array([pow(_BASE, 4096 * k, 1 << 64) for k in range(4096)], np.uint64)


def tune(similar: float = SIMILAR, recall: float = RECALL, rows: int = 4) -> int:
    """The fewest bands of so many rows that find a pair at the threshold with that probability."""
    bands = 1
    while 1 - (1 - similar**rows) ** bands < recall:
        bands += 1
    return bands


BANDS = tune(rows=ROWS)
_RNG = np.random.default_rng(20_240_501)
_XOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(29))) * _M
    return x ^ (x >> np.uint64(32))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _ranges(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0, 1, ... n - 1 for each n in turn, and the same from each start."""
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return place, place + np.repeat(start, n)


def _words(text: str, begins: bool) -> tuple[np.ndarray, ...]:
    """(hash, start, end, first of a line, last of a sentence) of each word of a text or, unless it begins there, a part of one."""
    point, lower = _points(text), text.lower()
    if len(lower) != len(text):  # a few letters have no single lower case
        lower = "".join(x if len(x) == 1 else c for c, x in zip(text, map(str.lower, text)))
    step = np.diff(np.concatenate([[False], ~_SPACE[np.minimum(point, len(_SPACE) - 1)], [False]]).view(np.int8))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start, end, np.zeros(0, bool), np.zeros(0, bool)
    line = np.searchsorted(np.flatnonzero(point == 10), start)
    line = np.append(begins or line[0] > 0, line[1:] != line[:-1])
    outer = lambda at: _OUTER[np.minimum(point[at], len(_OUTER) - 1)]
    a, b = start.copy(), end.copy()
    live = np.flatnonzero(outer(a))
    while len(live):
        a[live] += 1
        live = live[a[live] < b[live]]
        live = live[outer(a[live])]
    live = np.flatnonzero((a < b) & outer(b - 1))
    while len(live):
        b[live] -= 1
        live = live[outer(b[live] - 1)]
    marks = a >= b  # a word of marks alone is what it is
    a[marks], b[marks] = start[marks], end[marks]
    last = end - 1
    live = np.flatnonzero(np.isin(point[last], _CLOSERS))
    while len(live):
        live = live[last[live] > start[live]]
        last[live] -= 1
        live = live[np.isin(point[last[live]], _CLOSERS)]
    place, at = _ranges(a, b - a)
    part = (_points(lower)[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095]
    if place.max() > 4095:
        part *= _FAR[place >> 12 & 4095]
    n = b - a
    h = _mix(np.add.reduceat(part, np.cumsum(n) - n) + n.astype(np.uint64) * np.uint64(_BASE))
    return h, start, end, line, np.isin(point[last], _STOPS)


class Words:
    """The words of texts, laid end to end; at[k] is where text k's begin.

    Words are compared in lower case without their outer punctuation. start and end are places in
    the word's text.
    """

    def __init__(self, texts: list[str]) -> None:
        found, self.at = [], np.zeros(len(texts) + 1, np.int64)
        for i, j in chunks(list(map(len, texts)), PIECE):
            if j - i == 1:  # a long text goes on in parts that end at white space
                text, at = texts[i], 0
                while at < len(text) or not at:
                    to = at + PIECE
                    while to < len(text) and not text[to].isspace():
                        to += 1
                    h, a, b, line, stop = _words(text[at:to], at == 0)
                    found.append((h, a + at, b + at, line, stop))
                    self.at[i + 1] += len(h)
                    at = to
                continue
            h, a, b, line, stop = _words("\n".join(texts[i:j]), True)
            first = np.cumsum([0, *(len(x) + 1 for x in texts[i:j])])
            of = np.searchsorted(first, a, side="right") - 1
            found.append((h, a - first[of], b - first[of], line, stop))
            self.at[i + 1 : j + 1] = np.bincount(of, minlength=j - i)
        self.at = np.cumsum(self.at)
        none = _words("", True)
        self.hash, self.start, self.end, self.line, self.stop = (np.concatenate(x) for x in zip(none, *found))
        self.of = np.repeat(np.arange(len(texts)), np.diff(self.at))

    def units(self, anywhere: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ranges [unit, 2] of paragraphs, of sentences, and of units without bands.

        Lines and sentences alike end at a cut. Sentences have more than UNIT words; a paragraph of
        one sentence is given as a paragraph only. Without bands are anchors, if anywhere; else
        from every cut a unit runs to the next that is UNIT words away or more, and to every cut one
        runs from the last such before it, so short lines and sentences are held by units that
        overlap, wherever a passage begins.
        """
        n = len(self.hash)
        none = np.zeros((0, 2), np.int64)
        if not n:
            return none, none, none
        line = np.append(self.line, True)
        cut = line.copy()
        cut[1:n] |= self.stop[: n - 1]
        paragraphs, pieces = (np.stack([x[:-1], x[1:]], 1) for x in (np.flatnonzero(line), np.flatnonzero(cut)))
        paragraphs = paragraphs[paragraphs[:, 1] - paragraphs[:, 0] >= PASSAGE]
        size = pieces[:, 1] - pieces[:, 0]
        whole = line[pieces[:, 0]] & line[pieces[:, 1]] & (size >= PASSAGE)
        sentences = pieces[(size > UNIT) & ~whole]
        if anywhere:
            return paragraphs, sentences, anchors(self.hash, self.of)
        cuts = np.flatnonzero(cut)
        after, before = np.searchsorted(cuts, cuts + UNIT), np.searchsorted(cuts, cuts - UNIT, side="right") - 1
        some = after < len(cuts)
        joined = np.concatenate([np.stack([cuts[some], cuts[after[some]]], 1), np.stack([cuts[before[before >= 0]], cuts[before >= 0]], 1)])
        joined = joined[self.of[joined[:, 0]] == self.of[joined[:, 1] - 1]]
        taken = {tuple(x) for x in (*sentences.tolist(), *paragraphs.tolist())}
        rest = sorted({tuple(x) for x in joined.tolist()} - taken)
        return paragraphs, sentences, np.array(rest, np.int64).reshape(-1, 2)


class Units:
    """Cuts one text at a time."""

    def cut(self, text: str) -> tuple[np.ndarray, ...]:
        """Word hashes, their starts and ends, and the word ranges of paragraphs, of sentences and of joined units."""
        w = Words([text])
        return w.hash, w.start, w.end, *w.units(False)


def anchors(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Word ranges [anchor, 2] of the chosen grams of GRAM words: one at least of any WINDOW neighbours in one text.

    Equal grams that touch, where words repeat themselves, are one longer range.
    """
    n = len(h) - GRAM + 1
    if n < WINDOW:
        return np.zeros((0, 2), np.int64)
    x = np.empty(n, np.uint64)
    for i in range(0, n, len(_POWERS) - GRAM):
        m = min(n - i, len(_POWERS) - GRAM)
        sums = np.append(np.uint64(0), np.cumsum(h[i : i + m + GRAM - 1] * _POWERS[: m + GRAM - 1]))
        x[i : i + m] = _mix((sums[GRAM:] - sums[:-GRAM]) * _INVERSES[:m])
    low, size = (x & ~np.uint64(0xFFFFFF)) | (np.arange(n, dtype=np.uint64) & np.uint64(0xFFFFFF)), 1
    while size * 2 <= WINDOW:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    m = n - WINDOW + 1
    low = np.minimum(low[:m], low[WINDOW - size : WINDOW - size + m])
    p = np.flatnonzero(of[:m] == of[GRAM + WINDOW - 2 :][:m])
    p = np.unique(p + ((low[p] & np.uint64(0xFFFFFF)).astype(np.int64) - p & 0xFFFFFF))
    new = np.append(True, (p[1:] > p[:-1] + GRAM) | (x[p[1:]] != x[p[:-1]]) | (of[p[1:]] != of[p[:-1]]))[: len(p)]
    return np.stack([p[new], np.append(p[:-1][new[1:]], p[-1:]) + GRAM], 1)


def _digests(h: np.ndarray, ranges) -> np.ndarray:
    """A 64-bit digest of each range of words."""
    if not len(ranges):
        return np.zeros(0, np.int64)
    r = np.asarray(ranges)
    n = r[:, 1] - r[:, 0]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    part = _mix(h[np.repeat(r[:, 0], n) + place] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _mix(np.add.reduceat(part, np.cumsum(n) - n) + n.astype(np.uint64)).view(np.int64)


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the WIDTH-word shingles of a sequence of word hashes; of all of it if shorter."""
    if len(h) < WIDTH:
        return _digests(h, [(0, len(h))]).view(np.uint64) if len(h) else h
    out = np.zeros(len(h) - WIDTH + 1, np.uint64)
    for k in range(WIDTH):
        out = _mix(out * np.uint64(31) + h[k : len(h) - WIDTH + 1 + k])
    return out


def signatures(h: np.ndarray, r: np.ndarray) -> np.ndarray:
    """[range, band] keys of the MinHash bands of word ranges [range, 2]."""
    out = np.zeros((len(r), BANDS), np.int64)
    if not len(r):
        return out
    s = shingles(h)
    a = np.minimum(r[:, 0], len(s) - 1)
    b = np.minimum(a + np.maximum(1, r[:, 1] - r[:, 0] - WIDTH + 1), len(s))
    order = np.argsort(a, kind="stable")
    for i, j in _chunks(np.cumsum((b - a)[order])):
        of = order[i:j]
        # ranges overlap: minima of the pieces between all their ends come first
        ends = np.unique(np.append(a[of], b[of]))
        x = s[ends[0] : ends[-1]]
        low, high = np.searchsorted(ends, a[of]), np.searchsorted(ends, b[of])
        first = np.cumsum(high - low) - (high - low)
        pieces = np.repeat(low - first, high - low) + np.arange((high - low).sum())
        least = np.empty((j - i, BANDS * ROWS), np.uint64)
        for k in range(BANDS * ROWS):
            least[:, k] = np.minimum.reduceat(np.minimum.reduceat((x ^ _XOR[k]) * _MUL[k], ends[:-1] - ends[0])[pieces], first)
        key = np.zeros((j - i, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            key = _mix(key * np.uint64(31) + least[:, k::ROWS])
        out[of] = key.view(np.int64)
    return out


def distinct_shingles(w: Words, r: np.ndarray) -> np.ndarray:
    """How many distinct shingles the word ranges [range, 2] have, each of WIDTH words or more inside one text."""
    n = np.maximum(1, r[:, 1] - r[:, 0] - WIDTH + 1)
    s = shingles(w.hash)
    order = np.argsort(s, kind="stable")
    of = w.of[: len(s)][order]
    twice = np.flatnonzero((s[order][1:] == s[order][:-1]) & (of[1:] == of[:-1]))
    again = np.zeros(len(s) + 1, np.int64)
    again[order[twice + 1]] = 1  # its text has this shingle before
    seen = np.append(0, np.cumsum(again))
    for k in np.flatnonzero(seen[np.minimum(r[:, 0] + n, len(s))] > seen[np.minimum(r[:, 0], len(s))]):
        n[k] = len(np.unique(s[r[k, 0] : r[k, 0] + n[k]]))
    return n


def _chunks(ends: np.ndarray, size: int = 1 << 16) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, side="right")))
        yield i, j
        i = j


#: Kinds of rows: not settled yet; a first that another document of its chunk repeats; a first with
#: bands; another occurrence of it; a unit without bands that an earlier document holds; the first
#: of such; another sentence in the first's own document.
_OPEN, _SHARED, _FIRST, _OTHER, _AGAIN, _HEAD, _OWN = -2, -1, 0, 1, 2, 3, 4
_UNIT = "digest long, doc long, row long, start int, end int, n int, seq int, kind int, more array<long>"
_NAMES = [x.split()[0] for x in _UNIT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 5]


def _batch(cols, more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, _TYPES)], more], _NAMES)


def _lists(sizes: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int64()))


def _units(batches: Iterator[pa.RecordBatch], anywhere: bool = False) -> Iterator[pa.RecordBatch]:
    """(row, doc, text) to units.

    seq tells a unit's sort and the place of its first word: -1 - 2 * place for paragraphs, -2 - 2 *
    place for sentences, place for all others, which have no bands. more holds the bands and the number of shingles, or, of a
    settled unit without bands, where its chunk's first stands (doc, row, place).
    """
    for b in batches:
        row, doc = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        order = np.lexsort((row, doc))
        order = order[np.append(True, (np.diff(row[order]) != 0) | (np.diff(doc[order]) != 0))] if len(order) else order
        row, doc, texts = row[order], doc[order], b.column(2).take(pa.array(order)).to_pylist()
        for i, j in chunks(list(map(len, texts)), CHUNK):
            w = Words(texts[i:j])
            paragraphs, sentences, others = w.units(anywhere)
            r = np.concatenate([paragraphs, sentences, others])
            if len(r):
                place = r[:, 0] - w.at[w.of[r[:, 0]]]
                less = np.repeat([-1, -2], [len(paragraphs), len(sentences)])
                seq = np.append(less - 2 * place[: len(less)], place[len(less) :])
                gram = np.stack([r[:, 0], np.minimum(r[:, 1], r[:, 0] + GRAM)], 1) if anywhere else r
                digest = np.append(_digests(w.hash, r[: len(less)]), _digests(w.hash, gram[len(less) :]))
                yield _settle(w, r, seq, digest, doc[i:j], row[i:j])


def _settle(w: Words, r: np.ndarray, seq: np.ndarray, digest: np.ndarray, doc: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    """A chunk's units, of which those whose equal stands in an earlier text of the chunk are settled."""
    of = w.of[r[:, 0]]
    digest[seq >= 0] ^= _BARE
    order = np.lexsort((r[:, 0], of, digest))
    r, seq, digest, of = r[order], seq[order], digest[order], of[order]
    banded = seq < 0
    new = np.append(True, digest[1:] != digest[:-1])
    heads = np.flatnonzero(new)
    first = heads[np.cumsum(new) - 1]
    other = of != of[first]
    shared = heads[np.logical_or.reduceat(other, heads)]
    other |= banded & _within(seq) & ~new  # a paragraph goes even where its own document repeats it
    kind = np.where(other, np.where(banded, _OTHER, _AGAIN), _OPEN)
    kind[shared] = _SHARED
    full, back = banded & ~other, other & ~banded
    sizes = np.where(full, BANDS + 1, np.where(back, 3, 0))
    at = np.cumsum(sizes) - sizes
    more = np.zeros(sizes.sum(), np.int64)
    more[at[full][:, None] + np.arange(BANDS + 1)] = np.column_stack([signatures(w.hash, r[full]), distinct_shingles(w, r[full])])
    f = first[back]
    more[at[back][:, None] + np.arange(3)] = np.stack([doc[of[f]], row[of[f]], seq[f]], 1)
    return _batch([digest, doc[of], row[of], w.start[r[:, 0]], w.end[r[:, 1] - 1], r[:, 1] - r[:, 0], seq, kind], _lists(sizes, more))


def _within(seq):
    """Whether a unit with bands is a paragraph of PASSAGE words, which goes if its own document repeats it."""
    return seq % 2 != 0


def _equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units sorted by digest, doc, row, start, with the settled among them, to units of the other kinds."""
    last, told = None, False  # the current first, and whether it was told
    for b in batches:
        c = [b.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
        settled = np.flatnonzero(c[7] > 0)
        if len(settled):
            yield _batch([x[settled] for x in c[:8]], b.column(8).take(pa.array(settled)))
        live = np.flatnonzero(c[7] < 0)
        if not len(live):
            continue
        carried = int(last is not None)
        c = [x[live] for x in c]
        if carried:
            c = [np.append(x, y).astype(y.dtype) for x, y in zip(last, c)]
        digest, doc, row, start, seq = (c[k] for k in (0, 1, 2, 3, 6))
        banded = seq < 0
        new = np.append(True, digest[1:] != digest[:-1])
        heads = np.flatnonzero(new)
        of = heads[np.cumsum(new) - 1]
        other = (doc != doc[of]) | (row != row[of])
        kind = np.where(banded, np.where(other, _OTHER, np.where(start == start[of], _FIRST, np.where(_within(seq), _OTHER, _OWN))), np.where(other, _AGAIN, _OPEN))
        shared = (np.logical_or.reduceat(other, heads) | np.logical_or.reduceat(c[7] == _SHARED, heads)) & ~banded[heads]
        if carried:
            kind[0] = _OPEN
            shared[0] &= not told
        kind[heads[shared]] = _HEAD
        told = bool(shared[-1] or (carried and len(heads) == 1 and told))
        last = [x[heads[-1] : heads[-1] + 1] for x in c]
        full, back, rest = np.flatnonzero(kind == _FIRST), np.flatnonzero(kind == _AGAIN), np.flatnonzero((kind == _OTHER) | (kind >= _HEAD))
        c[7] = kind
        yield _batch([x[full] for x in c], b.column(8).take(pa.array(live[full - carried])))
        yield _batch([x[back] for x in c], _lists(np.full(len(back), 3), np.stack([doc[of[back]], row[of[back]], seq[of[back]]], 1).ravel()))
        yield _batch([x[rest] for x in c], _lists(np.zeros(len(rest), np.int64), np.zeros(0, np.int64)))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band key, shingles, digest) sorted by key to (bucket, digest) of paragraphs that may be alike.

    Sets of a similarity of SIMILAR differ no more in size, so a key's paragraphs part where their
    sizes leap, and those left alone go. A bucket is named by its members, so that one that many
    bands give is verified once. A key with more than BUCKET paragraphs streams through: each goes
    to two of its classes of sizes, so that those of sizes near enough share one.
    """
    key, held, large = None, [], False  # the key that the batch before ended in, its (sizes, digests)

    def parted(k, n, d) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((n, k))
        k, n, d = k[order], n[order], d[order]
        cut = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (n[:-1] < SIMILAR * n[1:] - 1e-9)))
        size = np.diff(np.append(cut, len(k)))
        cut, size = cut[size > 1], size[size > 1]
        found = [np.sort(d[a : a + m]) for a, m in zip(cut.tolist(), size.tolist())]
        names = np.array([xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in found], np.int64)
        return np.repeat(names, size), np.concatenate(found) if found else np.zeros(0, np.int64)

    def streamed(n, d) -> tuple[np.ndarray, np.ndarray]:
        size = np.floor(np.log(np.maximum(n, 1)) / -np.log(SIMILAR)).astype(np.int64)
        names = [_mix(np.uint64(key & (1 << 64) - 1) + (size + c).astype(np.uint64) * np.uint64(_BASE)).view(np.int64) for c in (0, 1)]
        return np.concatenate(names), np.append(d, d)

    def out(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in map(np.concatenate, zip(*found))], ["bucket", "digest"])

    def end() -> tuple[np.ndarray, np.ndarray]:
        n, d = map(np.concatenate, zip(*held))
        return streamed(n, d) if large else parted(np.zeros(len(n)), n, d)

    for b in batches:
        k, n, d = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        if not len(k):
            continue
        found = []
        first, last = int(np.searchsorted(k, k[0], side="right")), int(np.searchsorted(k, k[-1]))
        if key is not None and key == k[0]:
            held.append((n[:first], d[:first]))
            if first < len(k):
                found.append(end())
        elif key is not None:
            found.append(end())
            first = 0
        else:
            first = 0
        if key != k[-1] or first < len(k):
            if last > first:
                found.append(parted(k[first:last], n[first:last], d[first:last]))
            key, held, large = int(k[-1]), [(n[max(first, last) :], d[max(first, last) :])], False
        if large or sum(len(x) for x, _ in held) > BUCKET:
            large = True
            found.append(end())
            held = [(n[:0], d[:0])]
        if found:
            yield out(found)
    if key is not None:
        yield out([end()])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, [(digest, start, end)]) to (digest, sorted distinct shingles)."""
    for b in batches:
        ids, parts = [], []
        for text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids += [x["digest"] for x in asked]
            parts += [text[x["start"] : x["end"]] for x in asked]
        for i, j in chunks(list(map(len, parts)), CHUNK):
            w = Words(parts[i:j])
            size = np.diff(w.at)
            some = np.flatnonzero(size >= WIDTH)  # all that have bands
            place, at = _ranges(w.at[some], size[some] - WIDTH + 1)
            of, x = np.repeat(some, size[some] - WIDTH + 1), shingles(w.hash)[at].view(np.int64)
            order = np.lexsort((x, of))
            of, x = of[order], x[order]
            new = np.append(True, (of[1:] != of[:-1]) | (x[1:] != x[:-1])) if len(x) else np.zeros(0, bool)
            sets = _lists(np.bincount(of[new], minlength=j - i), x[new])
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), sets], ["digest", "set"])


def jaccard_tree(sets: list[np.ndarray], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """Tree edges of the graph that links sets of exact Jaccard similarity similar or more."""
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    out, rest = [], np.ones(len(sets), bool)
    for first in range(len(sets)):
        if not rest[first]:
            continue
        rest[first] = False
        queue = [first]
        while queue:
            live = rest[owner]
            if not live.any():
                break
            if live.sum() < len(live) // 2:
                flat, owner = flat[live], owner[live]
            p = queue.pop()
            s = np.sort(sets[p])
            at = np.minimum(np.searchsorted(s, flat), len(s) - 1)
            both = np.bincount(owner[s[at] == flat], minlength=len(sets))
            hit = np.flatnonzero(rest & (both > 0) & (both >= similar * (size + len(s) - both) - 1e-9))
            rest[hit] = False
            out += [(int(q), p) for q in hit]
            queue += hit.tolist()
    return out


def _alike_pairs(flat: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which of the pairs of neighbouring sets (left, left + 1) have a Jaccard similarity of SIMILAR or more."""
    a, b = at[left + 1] - at[left], at[left + 2] - at[left + 1]
    _, where = _ranges(at[left], a + b)
    of, x = np.repeat(np.arange(len(left)), a + b), flat[where]
    order = np.lexsort((x, of))
    of, x = of[order], x[order]
    both = np.bincount(of[1:][(x[1:] == x[:-1]) & (of[1:] == of[:-1])], minlength=len(left))
    return both >= SIMILAR * (a + b - both) - 1e-9


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, i, j, digest, set) sorted by the first three, to links."""
    forest, held, last = Forest(), [], None

    def done(ids, sets):
        if len(ids) > 1:
            for a, b in jaccard_tree(sets):
                forest.join(ids[a], ids[b])

    for b in batches:
        if not b.num_rows:
            continue
        key = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        ids, sets = b.column(3).to_numpy(zero_copy_only=False), b.column(4)
        flat, at = sets.flatten().to_numpy(zero_copy_only=False), sets.offsets.to_numpy().astype(np.int64) - sets.offsets[0].as_py()
        cut = runs(*key)
        name = lambda k: tuple(int(x[cut[k]]) for x in key)
        if last is not None and last != name(0):
            done([x for x, _ in held], [x for _, x in held])
            held = []
        size, first = np.diff(cut), 0
        if held or len(size) == 1:  # the first group goes on from the batch before
            held += [(int(ids[k]), flat[at[k] : at[k + 1]]) for k in range(cut[0], cut[1])]
            first = 1
        if len(size) > first:
            if held:
                done([x for x, _ in held], [x for _, x in held])
            pairs = cut[first:-2][size[first:-1] == 2]
            for k in pairs[_alike_pairs(flat, at, pairs)] if len(pairs) else ():
                forest.join(int(ids[k]), int(ids[k + 1]))
            for g in np.flatnonzero(size[first:-1] > 2) + first:
                done(ids[cut[g] : cut[g + 1]].tolist(), [flat[at[k] : at[k + 1]] for k in range(cut[g], cut[g + 1])])
            held = [(int(ids[k]), flat[at[k] : at[k + 1]].copy()) for k in range(cut[-2], cut[-1])]
        last = name(len(size) - 1)
        if len(forest.up) > MEMBERS:  # bounds it; what is cut here the star steps join
            yield edge_batch(*forest.edges())
            forest = Forest()
    done([x for x, _ in held], [x for _, x in held])
    yield edge_batch(*forest.edges())


_SIDE = "side int, place int, at int, digest long, fdoc long, frow long, fplace int"
_STRETCH = f"doc long, row long, first boolean, seq int, n int, start int, end int, clusters array<long>, sides array<struct<{_SIDE.replace(' ', ': ')}>>".replace(",: ", ", ")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, row, [(kind, seq, n, start, end, digest, more)]) to a document's stretches of anchors that touch.

    Those that earlier documents hold (kind _AGAIN) carry their two sides: where the stretch begins
    or ends (the word at place, the character at), and where its outer anchor's first stands.
    """
    side = pa.struct([(x.split()[0], pa.int64() if x.endswith("long") else pa.int32()) for x in _SIDE.split(", ")])
    for b in batches:
        doc, row = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        lists = b.column(2)
        of = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        fields = lists.flatten().flatten()
        kind, place, n, start, end, digest = (x.to_numpy(zero_copy_only=False) for x in fields[:6])
        back = fields[6].offsets.to_numpy() - fields[6].offsets[0].as_py()
        pointer = fields[6].flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((place, kind, of))
        of, kind, place, n, start, end, digest, back = (x[order] for x in (of, kind, place, n, start, end, digest, back[:-1]))
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]) | (place[1:] > place[:-1] + n[:-1])
        head = np.flatnonzero(new)
        ends = np.append(head[1:], len(of)) if len(head) else head
        tail = ends - 1
        gone = kind[head] == _AGAIN
        both = np.stack([head[gone], tail[gone]], 1).ravel()
        right = np.tile([0, 1], gone.sum())
        where = np.stack([pointer[back[both] + k] for k in range(3)], 1) if len(both) else np.zeros((0, 3), np.int64)
        parts = [right, place[both] + right * n[both], np.where(right, end[both], start[both]), digest[both], where[:, 0], where[:, 1], where[:, 2] + right * GRAM]
        sides = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(parts, side)], fields=list(side))
        sides = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(gone * 2)), pa.int32()), sides)
        cols = [pa.array(doc[of[head]]), pa.array(row[of[head]]), pa.array(~gone), pa.array(place[head], pa.int32()), pa.array(place[tail] + n[tail] - place[head], pa.int32()), pa.array(start[head], pa.int32()), pa.array(end[tail], pa.int32()), _lists(ends - head, digest), sides]
        yield pa.RecordBatch.from_arrays(cols, ["doc", "row", "first", "seq", "n", "start", "end", "clusters", "sides"])


_AROUND = "doc long, row long, side int, place int, edge int, words array<long>, chars array<int>"


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, row, text, [(side, place)]) to the words before (side 0) or from (side 1) a place, the nearest first.

    chars are where those words begin or end, edge is where the word at place begins or the one before it ends.
    """
    names, far = [x.split()[0] for x in _AROUND.split(", ")], WINDOW - 1
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for i, j in chunks(list(map(len, texts)), CHUNK):
            w, out = Words(texts[i:j]), []
            h = w.hash.view(np.int64)
            for k, (doc, row, asked) in enumerate(zip(*[batch.column(c).slice(i, j - i).to_pylist() for c in (0, 1, 3)])):
                low, high = int(w.at[k]), int(w.at[k + 1])
                for x in asked:
                    at = low + x["place"]
                    if x["side"]:
                        out.append((doc, row, 1, x["place"], w.end[at - 1], h[at : min(high, at + far)], w.end[at : min(high, at + far)]))
                    else:
                        out.append((doc, row, 0, x["place"], w.start[at], h[max(low, at - far) : at][::-1], w.start[max(low, at - far) : at][::-1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def _alike(a: str, b: str) -> Column:
    """How many words two arrays begin with alike."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return (F.array_position(F.concat(equal, F.array(F.lit(False))), F.lit(False)) - 1).cast("int")


def _anchored(docs: DataFrame, met: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(row, doc, start, end, n, seq, clusters, first) of the stretches of anchors and of what they are extended by.

    A stretch is extended against the documents that its outer anchors' firsts stand in; where a
    third document holds more of the passage than those, its ends may stay short.
    """
    listed = met.where(f"kind in ({_AGAIN}, {_HEAD})").groupBy("doc", "row").agg(F.collect_list(F.struct("kind", "seq", "n", "start", "end", "digest", "more")).alias("found"))
    stretches = materialize(listed.select("doc", "row", "found").mapInArrow(lean(_stretches), _STRETCH))
    sides = stretches.where("not first").select("doc", "row", F.inline("sides"))
    asked = sides.select("doc", "row", "side", "place").unionByName(sides.select(F.col("fdoc").alias("doc"), F.col("frow").alias("row"), "side", F.col("fplace").alias("place"))).distinct()
    asked = asked.groupBy("doc", "row").agg(F.collect_list(F.struct("side", "place")).alias("asked"))
    around = docs.join(asked, ["doc", "row"]).select("doc", "row", "text", "asked").mapInArrow(lean(_around), _AROUND)
    around = materialize(around.dropDuplicates(["doc", "row", "side", "place"]))
    tables += [stretches, around]
    first = around.select(F.col("doc").alias("fdoc"), F.col("row").alias("frow"), "side", F.col("place").alias("fplace"), F.col("edge").alias("fedge"), F.col("words").alias("fwords"), F.col("chars").alias("fchars"))
    more = sides.join(around, ["doc", "row", "side", "place"]).join(first, ["fdoc", "frow", "side", "fplace"]).withColumn("n", _alike("words", "fwords")).where("n > 0")
    left = F.col("side") == 0
    last = lambda chars: F.element_at(chars, F.greatest(F.col("n"), F.lit(1)))
    piece = lambda f, edge, kept: [
        F.col(f + "row").alias("row"), F.col(f + "doc").alias("doc"),
        F.when(left, last(f + "chars")).otherwise(F.col(edge)).alias("start"), F.when(left, F.col(edge)).otherwise(last(f + "chars")).alias("end"),
        "n", F.when(left, F.col(f + "place") - F.col("n")).otherwise(F.col(f + "place")).alias("seq"), F.array("digest").alias("clusters"), F.lit(kept).alias("first"),
    ]
    whole = stretches.select("row", "doc", "start", "end", "n", "seq", "clusters", "first")
    return whole.unionByName(more.select(*piece("", "edge", False))).unionByName(more.select(*piece("f", "fedge", True)).distinct())


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's found units to its passages: runs of units that no word lies between.

    A first occurrence most of which is removed itself, for an earlier one, is none.
    """
    for b in batches:
        out = []
        for row, doc, found in zip(*[b.column(k).to_pylist() for k in range(3)]):
            gone: list[list] = []
            for kept in (False, True):
                units = sorted((x["seq"] if x["seq"] >= 0 else (-1 - x["seq"]) // 2, (x["seq"] < 0, x["n"]), x["start"], x["end"], x["clusters"]) for x in found if x["first"] == kept)
                runs_: list[list] = []
                for place, size, start, end, clusters in units:
                    to = place + size[1]
                    if kept and size[1] - sum(max(0, min(to, y) - max(place, x)) for x, y, *_ in gone) < min(PASSAGE, size[1]):
                        continue
                    if runs_ and place <= runs_[-1][1]:
                        run = runs_[-1]
                        run[1], run[3] = max(run[1], to), max(run[3], end)
                        if size > run[4]:
                            run[4:6] = size, clusters[0]
                        run[6].update(clusters)
                    else:
                        runs_.append([place, to, start, end, size, clusters[0], set(clusters)])
                runs_ = [x for x in runs_ if x[1] - x[0] >= PASSAGE]
                out += [(row, doc, x[2], x[3], x[1] - x[0], x[5], kept, sorted(x[6])) for x in runs_]
                gone = runs_
        cols = list(zip(*out)) if out else [()] * 8
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["row", "doc", "start", "end", "n_words", "cluster", "kept", "clusters"])


_NONE = (1 << 63) - 1


def _identity(docs: DataFrame) -> tuple[Column, Column]:
    """doc and row: a document is known by doc_id and a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def passages(docs: DataFrame, anywhere: bool = True) -> DataFrame:
    """(row, doc, start, end, n_words, cluster, kept, clusters): the repeated passages of docs (doc_id, text).

    start and end are places in the text. anywhere: whether passages that begin and end inside
    units are found too, by anchors. clusters are all that touch the passage, cluster the one of its
    largest unit. The passages are written, and nothing else that this writes on the way is left.
    """
    doc, row = _identity(docs)
    docs = docs.select(row.alias("row"), doc.alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    units = docs.mapInArrow(lean(lambda batches: _units(batches, anywhere)), _UNIT)
    order = ["digest", "doc", "row", "start"]
    dealt = F.when(F.col("kind") < 0, F.col("digest")).otherwise(F.xxhash64("row", "start"))
    met = materialize(units.repartition(dealt).sortWithinPartitions(*order).mapInArrow(_equal, _UNIT), by="kind")

    firsts = met.where(f"kind = {_FIRST}").withColumnRenamed("more", "bands")
    keys = firsts.select(F.explode(F.slice("bands", 1, BANDS)).alias("key"), F.element_at("bands", BANDS + 1).alias("shingles"), "digest").repartition("key").sortWithinPartitions("key")
    buckets = materialize(keys.mapInArrow(_buckets, "bucket long, digest long").distinct())
    asked = firsts.join(buckets.select("digest").distinct(), "digest", "left_semi").groupBy("doc", "row").agg(F.collect_list(F.struct("digest", "start", "end")).alias("asked"))
    sets = docs.join(asked, ["doc", "row"]).select("text", "asked").mapInArrow(lean(_sets), "digest long, set array<long>").dropDuplicates(["digest"])
    sets = materialize(sets)
    parts = buckets.groupBy("bucket").agg(F.ceil(F.count("*") / (BUCKET // 2)).cast("int").alias("k")).select("bucket", F.when(F.col("k") <= 2, 1).otherwise(F.col("k")).alias("k"))
    dealt = buckets.join(parts, "bucket").withColumn("own", F.pmod(F.xxhash64("digest"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "digest").join(sets, "digest").select("bucket", "i", "j", "digest", "set")
    links = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_verify, "u long, v long")
    roots = connected_components(links)
    discard(buckets)
    discard(sets)

    # of a cluster, the occurrence in the smallest (doc, row, start) is kept
    alike = materialize(roots.select(F.col("node").alias("digest"), F.col("root").alias("cluster")).unionByName(roots.select(F.col("root").alias("digest"), F.col("root").alias("cluster")).distinct()))
    discard(roots)
    place = ["digest", "doc", "row", "start", "end", "n", "seq", "kind"]
    near = materialize(firsts.select(*place).join(alike, "digest"))
    least = near.groupBy("cluster").agg(F.min(F.struct("doc", "row", "start")).alias("least"))
    first_of = materialize(alike.join(least, "cluster"))  # wide rows meet it by digest, so a large cluster is no single task of them
    # a sentence stays where its own document holds the first
    own = (F.col("seq") % 2 == 0) & F.coalesce((F.col("doc") == F.col("least.doc")) & (F.col("row") == F.col("least.row")), F.col("kind") == _OWN)
    clustered = near.join(first_of.select("digest", "least"), "digest").withColumn("first", F.struct("doc", "row", "start") == F.col("least")).where(F.col("first") | ~own)
    clustered = materialize(clustered.select(*place, "cluster", "first"))
    again = met.where(f"kind in ({_OTHER}, {_OWN})").select(*place).join(first_of, "digest", "left").withColumn("cluster", F.coalesce("cluster", "digest"))
    again = materialize(again.where(~own).select(*place, "cluster"))
    tables = [met, alike, near, first_of, clustered, again]
    repeated = again.select("digest").distinct().join(clustered.select("digest"), "digest", "left_anti")
    alone = firsts.select(*place).join(repeated, "digest", "left_semi")
    cols = ["row", "doc", "start", "end", "n", "seq", "clusters", "first"]
    by = lambda df, cluster: df.withColumn("clusters", F.array(cluster))
    found = (
        by(clustered, "cluster").select(*cols)
        .unionByName(by(alone, "digest").withColumn("first", F.lit(True)).select(*cols))
        .unionByName(by(again, "cluster").withColumn("first", F.lit(False)).select(*cols))
    )
    if anywhere:
        found = found.unionByName(_anchored(docs, met, tables).select(*cols))
    else:
        plain = by(met.where(f"kind in ({_AGAIN}, {_HEAD})"), "digest")
        found = found.unionByName(plain.withColumn("first", F.col("kind") == _HEAD).select(*cols))
    grouped = found.groupBy("row", "doc").agg(F.collect_list(F.struct("start", "end", "n", "seq", "clusters", "first")).alias("found"))
    done = materialize(grouped.select("row", "doc", "found").mapInArrow(lean(_spans), "row long, doc long, start int, end int, n_words int, cluster long, kept boolean, clusters array<long>"))
    for t in tables:
        discard(t)
    return done


def repeated_passages(docs: DataFrame, anywhere: bool = False) -> DataFrame:
    """(doc_id, start, end, n_words, cluster_id, kept, clusters) for each passage that other documents repeat.

    Passages have PASSAGE words or more; words are what white space parts, so text without spaces
    has one word a line and no passage. kept marks a cluster's first occurrence, by the smallest
    doc_id; all other rows are removed by remove_passages(). Null and empty texts have no
    passages; texts of any length are read whole; a null doc_id comes after all others; rows equal
    in doc_id and text are one document. Other columns are ignored; no rows give no rows. Without
    anywhere, only whole lines, sentences and their runs are passages.
    """
    found = passages(docs, anywhere)
    return found.select(F.when(F.col("doc") != _NONE, F.col("doc")).alias("doc_id"), "start", "end", "n_words", F.col("cluster").alias("cluster_id"), "kept", "clusters")


def remove_passages(docs: DataFrame) -> DataFrame:
    """docs with the repeated passages cut from text, and n_chars (if there is one) made right.

    Rows whose text had words and has none left are dropped; all others stay, with their columns,
    whatever their names. Null and empty texts stay as they are, a null doc_id comes after all
    others, rows equal in doc_id and text lose the same passages; no rows give no rows.
    """
    gone = passages(docs).where("not kept").groupBy("row", "doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone"))
    doc, row = _identity(docs)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("of"), row.alias("row"), doc.alias("doc"))
    both = whole.join(gone, ["row", "doc"], "left").select("of.*", F.col("gone").alias(*fresh(docs, "gone")))
    names, at = docs.columns, docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ok = [], []
            for text, spans in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if spans:
                    parts, last = [], 0
                    for s in spans:
                        parts.append(text[last : s["start"]])
                        last = s["end"]
                        while last < len(text) and text[last].isspace():
                            last += 1
                    text = "".join([*parts, text[last:]]).rstrip()
                    ok.append(bool(text.strip()))
                else:
                    ok.append(True)
                texts.append(text)
            cols = [b.column(k) if k != at else pa.array(texts, pa.string()) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(ok, pa.bool_()))

    out = both.mapInArrow(lean(cut), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
