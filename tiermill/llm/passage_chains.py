"""Fuzzy repeated passages by collinear chaining of shared seeds.

Seeds are the minimizers of all word k-mers: the smallest hash in every window of ``window`` k-mers. As the window is not
longer than a k-mer, neighbouring seeds of equal text overlap or touch, and every exact match of ``k + window - 1`` words
holds a seed.

A seed's documents are not paired with each other. Each is linked to the one before it, in the order of their ids, and to the
first one: inside a task's buffer, and then, with one entry per seed and buffer, across the buffers. So a passage in a third of
all documents gives each of them a few links and no group grows with their number. Links of a pair of documents on one diagonal
are merged to anchors, anchors are chained in order on both sides with a cost for gaps (a Fenwick tree finds the best
predecessor), and the chains are aligned on the words: gaps by a longest common subsequence, ends by the best common
subsequence of their beginnings, step by step, and a chain that leads through unlike text is cut. What covers ``min_words``
words with ``min_identity`` of its columns equal is a passage.

The links hide a passage where its parts also stand in other, nearer documents. So where a document's stretches under seeds
that any other document has are not covered by a passage, they are looked up again by pairs of seeds ``near`` to ``far`` words
apart, which such parts do not share with each other: the documents with a pair are linked as those with a seed are. So the
work stays linear, however many documents have a line in common. What stays hidden is a passage each of whose pairs is also in
a nearer and in an earlier document that has less than ``min_words`` words of it.

Words are runs of other than ASCII white space, with A-Z in lower case; they are compared by 32-bit hashes. Only seeds that are
looked up, and the words of documents that are aligned, are worked out from the texts a second time: tasks know them by a
filter of fixed size.

Defined cases: null and empty texts have no passages; a repetition inside one document is none; rows of equal id and text count
as one; of equal ids the smaller hash of the text comes first, null ids come last; a null id is kept as null; extra columns, of
whatever name, are carried along; an empty table gives no rows. Very long texts are seeded and aligned whole; gaps of
more than ``reach`` words within a chain count as unequal, and an end stops where the next ``step`` words win nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType

from tiermill.llm.common import as_bytes, bit_filter, carried, in_filter, keep, lean, own, restored, tasks, WORD
from tiermill.llm.words import portions, word_hashes

CHAIN, STRETCH = 0, 1
LAST = np.uint64(2**64 - 1)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Rules:
    k: int = 4
    window: int = 4
    buffer: int = 250_000  # seeds that a task links among themselves at a time
    min_words: int = 50
    min_identity: float = 0.8
    least_seeded: int = 8  # words under anchors that make a chain worth aligning
    gap_cost: float = 0.1  # for each word between two anchors, on either side
    reach: int = 256  # words of a gap, or beyond a chain's ends, that are aligned
    step: int = 48  # words in which an end must win something to go on
    stretch_gap: int = 24  # words between seeds of one stretch
    near: int = 28  # words from one seed to the other of a pair by which stretches are looked up, at least
    far: int = 44  # and at most; with ``near``, so that every passage holds such pairs
    far_cost: float = 0.02  # for each word between two anchors in chains of such pairs
    filter_bits: int = 26  # of the filters by which tasks know seeds and documents


def _slide(values: np.ndarray, width: int, best, fill: np.uint64) -> np.ndarray:
    """``best`` of each value and the ``width`` - 1 after it."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = best(out, np.concatenate((out[step:], np.full(step, fill))))
        done += step
    return out


def minimizers(words: np.ndarray, doc: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the seeds of concatenated documents (``doc`` numbers them)."""
    count = len(words) - k + 1
    if count < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    mers = np.zeros(count, np.uint64)
    for j in range(k):
        mers = mers * np.uint64(0x9E3779B97F4A7C15) + words[j : j + count]
    # Equal neighbours are a run of one word; they are told apart by their place in it, so that runs of any length match.
    place = np.arange(count)
    fresh = np.ones(count, bool)
    fresh[1:] = (mers[1:] != mers[:-1]) | (doc[1:count] != doc[: count - 1])
    mers += (place - np.maximum.accumulate(np.where(fresh, place, 0))).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    mers = (mers ^ (mers >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mers ^= mers >> np.uint64(29)
    mers = np.minimum(mers, LAST - np.uint64(1))
    mers[doc[:count] != doc[k - 1 :]] = LAST
    # Windows start before the first k-mer and end after the last, so short documents and ends have seeds, too.
    padded = np.concatenate((np.full(window - 1, LAST), mers))
    least = _slide(padded, window, np.minimum, LAST)
    least[least == LAST] = 0
    # A k-mer is a seed if it is the smallest of some window, so the largest minimum of its windows is itself.
    chosen = np.flatnonzero((_slide(least, window, np.maximum, np.uint64(0))[:count] == mers) & (mers != LAST))
    return chosen, mers[chosen]


def link_runs(seed: np.ndarray, row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """For entries sorted by seed, row and pos: entries that have an earlier document with their seed and the entries they
    are linked to, and which entries belong to the first document of their seed."""
    count = len(seed)
    new_seed = np.ones(count, bool)
    new_seed[1:] = seed[1:] != seed[:-1]
    new_group = new_seed.copy()
    new_group[1:] |= row[1:] != row[:-1]
    starts = np.flatnonzero(new_group)
    sizes = np.diff(np.append(starts, count))
    group = np.cumsum(new_group) - 1
    rank = np.arange(count) - starts[group]
    opening = new_seed[starts]
    first = opening[group]
    # Each document is linked to the one before it, and to the first one where that is another.
    origin = np.maximum.accumulate(np.where(opening, np.arange(len(starts)), 0))[group]
    later = np.flatnonzero(group - origin > 1)
    linked = np.concatenate((np.flatnonzero(~first), later))
    target = np.concatenate((group[~first] - 1, origin[later]))
    # The t-th time in this document goes with the t-th in the other, or with its last.
    partner = starts[target] + np.minimum(rank[linked], sizes[target] - 1)
    return linked, partner, first


def reached(new: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Largest of ``ends`` so far within its group; ``new`` marks where groups begin."""
    lift = np.cumsum(new).astype(np.int64) << 32
    return np.maximum.accumulate(lift + ends) - lift


def covered(new: np.ndarray, pos: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words under the anchors of each group; they are sorted by pos within a group."""
    before = pos.astype(np.int64)
    before[1:] = np.where(new[1:], before[1:], np.maximum(before[1:], reached(new, ends)[:-1]))
    return np.add.reduceat(np.maximum(ends - before, 0), np.flatnonzero(new))


def merge(row, partner, pos, other, size) -> tuple[np.ndarray, ...]:
    """Anchors from matches: runs of one diagonal without a hole."""
    order = np.lexsort((pos, pos - other, partner, row))
    row, partner, pos, other, size = (x[order] for x in (row, partner, pos, other, size))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (partner[1:] != partner[:-1]) | (pos[1:] - other[1:] != pos[:-1] - other[:-1])
    ends = pos + size
    if not len(row):
        return row, partner, pos, other, size
    new[1:] |= pos[1:] > reached(new, ends)[:-1]
    starts = np.flatnonzero(new)
    last = np.maximum.reduceat(ends, starts)
    return row[starts], partner[starts], pos[starts], other[starts], (last - pos[starts]).astype(np.int32)


def numbered_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of texts, the text of each word, and where each text begins."""
    words, bounds = word_hashes(texts)
    return words, np.repeat(np.arange(len(texts)), np.diff(bounds)), bounds[:-1]


#: ``pos`` has the place of a seed and, above ``GAP`` bits, the distance of the second one of a pair.
SEEDS = "seed long, row long, pos long, met struct<key:long, other:int, size:int>"
LINKS = "row long, key long, pos int, other int, size int"
_MET = pa.struct([("key", pa.int64()), ("other", pa.int32()), ("size", pa.int32())])
GAP = 40


def _links(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    kinds = [np.int64, np.int64, np.int32, np.int32, np.int32]
    return pa.record_batch([pa.array(c.astype(k)) for c, k in zip(columns, kinds)], names=["row", "key", "pos", "other", "size"])


def _anchors(seed: np.ndarray, row: np.ndarray, pos: np.ndarray, k: int, rows: np.ndarray | None) -> tuple[tuple, np.ndarray]:
    """Anchors between the documents of each seed (entries in order) and which entries are of its first document. Links of rows
    that a filter does not know are left out."""
    linked, partner, first = link_runs(seed, row, pos)
    if rows is not None:
        wanted = in_filter(rows, row[linked])
        linked, partner = linked[wanted], partner[wanted]
    places = [pos & (1 << GAP) - 1]
    if (gap := pos >> GAP).any():
        places.append(places[0] + gap)
    one = [np.concatenate(x) for x in zip(*[(row[linked], row[partner], p[linked], p[partner]) for p in places])]
    return merge(*one[:2], one[2].astype(np.int32), one[3].astype(np.int32), np.full(len(one[0]), k, np.int32)), first


def paired(
    place: np.ndarray, seed: np.ndarray, doc: np.ndarray, rules: Rules, firsts: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each seed (of those in the filter ``firsts``) that has others of its document ``near`` to ``far`` words on: its
    number, the key of the pair with the smallest of them, and the distance."""
    which = np.arange(len(seed)) if firsts is None else np.flatnonzero(in_filter(firsts, seed.view(np.int64)))
    low, high = np.searchsorted(place, place[which] + rules.near), np.searchsorted(place, place[which] + rules.far, "right")
    high = np.minimum(high, np.searchsorted(doc, doc[which], "right"))
    best, at = np.full(len(which), LAST), np.full(len(which), -1)
    for step in range(int((high - low).max(initial=0))):
        there = np.flatnonzero(low + step < high)
        other = low[there] + step
        less = seed[other] < best[there]
        best[there[less]], at[there[less]] = seed[other[less]], other[less]
    found = np.flatnonzero(at >= 0)
    has = which[found]
    key = (seed[has] * np.uint64(0x9E3779B97F4A7C15)) ^ (best[found] * np.uint64(0xBF58476D1CE4E5B9))
    return has, key ^ (key >> np.uint64(29)), place[at[found]] - place[has]


def _by_seed(seed: np.ndarray, row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries in the order of seed, row and place."""
    in_order = (row[1:] > row[:-1]) | (row[1:] == row[:-1]) & (pos[1:] >= pos[:-1])
    order = np.argsort(seed, kind="stable") if in_order.all() else np.lexsort((pos, row, seed))
    return seed[order], row[order], pos[order]


def _seeded(rules: Rules, asked: tuple[np.ndarray, np.ndarray] | None = None, rows: np.ndarray | None = None):
    """Seeds of each document, or the pairs of them that the filters ``asked`` (first seeds, pairs) know. What documents of one buffer share is
    linked right here (``met``); on to the bucket of a seed goes only the buffer's first document with it."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        seed, row, pos = _by_seed(*(np.concatenate(x) for x in zip(*held)))
        a, first = _anchors(seed, row, pos, rules.k, rows)
        met = pa.StructArray.from_arrays([pa.array(a[1]), pa.array(a[3]), pa.array(a[4])], fields=list(_MET))
        # Anchors need no bucket; their documents deal them out.
        names = ["seed", "row", "pos", "met"]
        yield pa.record_batch([pa.array(a[0]), pa.array(a[0]), pa.array(a[2].astype(np.int64)), met], names=names)
        columns = [pa.array(seed[first].view(np.int64)), pa.array(row[first]), pa.array(pos[first])]
        yield pa.record_batch([*columns, pa.nulls(int(first.sum()), _MET)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in portions(batches, 1):
            row = batch.column(0).to_numpy()
            words, doc, begin = numbered_words(batch.column(1))
            place, seed = minimizers(words, doc, rules.k, rules.window)
            of = doc[place]
            pos = place - begin[of]
            if asked is not None:
                has, seed, gap = paired(place, seed, of, rules, asked[0])
                wanted = in_filter(asked[1], seed.view(np.int64))
                has, seed = has[wanted], seed[wanted]
                pos, of = pos[has] | gap[wanted] << GAP, of[has]
            held.append((seed, row[of], pos))
            count += len(seed)
            if count >= rules.buffer:
                yield from flush(held)
                held, count = [], 0
        if count:
            yield from flush(held)

    return run


def _across(rules: Rules, rows: np.ndarray | None = None):
    """Links between the first documents of different buffers, and those that are known already; rows are sorted by seed."""

    def linked(*entries: np.ndarray) -> pa.RecordBatch:
        return _links(_anchors(*_by_seed(*entries), rules.k, rows)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            seed, row, pos = (batch.column(i).to_numpy() for i in range(3))
            met = batch.column(3)
            known = met.is_valid().to_numpy(zero_copy_only=False)
            if known.any():
                key, other, size = (c.to_numpy(zero_copy_only=False) for c in met.filter(met.is_valid()).flatten())
                yield _links((row[known], key, pos[known], other, size))
            entries = [x[~known] for x in (seed, row, pos)]
            if not len(entries[0]):
                continue
            if held is not None:
                entries = [np.concatenate(x) for x in zip(held, entries)]
            other = np.flatnonzero(entries[0] != entries[0][-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield linked(*[x[:cut] for x in entries])
            held = [x[cut:] for x in entries]
        if held is not None:
            yield linked(*held)

    return run


class Fenwick:
    """Largest value, with its owner, over the keys up to a bound."""

    def __init__(self, size: int) -> None:
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)

    def put(self, place: int, value: tuple[float, int]) -> None:
        place += 1
        while place < len(self.best):
            if value > self.best[place]:
                self.best[place] = value
            place += place & -place

    def up_to(self, place: int) -> tuple[float, int]:
        place, found = place + 1, (float("-inf"), -1)
        while place:
            if self.best[place] > found:
                found = self.best[place]
            place -= place & -place
        return found


def chains(pos: list[int], other: list[int], size: list[int], gap_cost: float) -> list[list[int]]:
    """Best chains of anchors (sorted by pos), as lists of their indices in order; each anchor is in one chain.

    An anchor follows one that ends before it on both sides. The cost of a gap is linear in its words on both sides, so it
    splits in a part of either anchor and the best predecessor is a prefix maximum.
    """
    count = len(pos)
    if count == 1:
        return [[0]]
    ends = sorted({o + s for o, s in zip(other, size)})
    place = {e: i for i, e in enumerate(ends)}
    tree = Fenwick(len(ends))
    score, before = [0.0] * count, [-1] * count
    waiting = sorted(range(count), key=lambda i: pos[i] + size[i])
    done = 0
    for i in sorted(range(count), key=lambda i: pos[i]):
        while done < count and pos[waiting[done]] + size[waiting[done]] <= pos[i]:
            j = waiting[done]
            tree.put(place[other[j] + size[j]], (score[j] + gap_cost * (pos[j] + size[j] + other[j] + size[j]), j))
            done += 1
        # Keys are the ends on the other side that lie at or before this anchor's start there.
        low, high = 0, len(ends)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if ends[middle] <= other[i] else (low, middle)
        value, j = tree.up_to(low - 1) if low else (float("-inf"), -1)
        gain = value - gap_cost * (pos[i] + other[i])
        score[i], before[i] = (size[i] + gain, j) if j >= 0 and gain > 0 else (float(size[i]), -1)
    used, found = [False] * count, []
    for i in sorted(range(count), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            found.append(chain[::-1])
    return found


def stretches(row, pos, size, reach: int) -> tuple[np.ndarray, ...]:
    """Stretches of each row under anchors with any partner, with gaps of up to ``reach`` words: row, start, stop and the words
    under anchors."""
    order = np.lexsort((pos, row))
    r, p, ends = row[order], pos[order], (pos + size)[order]
    new = np.ones(len(r), bool)
    new[1:] = r[1:] != r[:-1]
    new[1:] |= p[1:] > reached(new, ends)[:-1] + reach
    starts = np.flatnonzero(new)
    return r[starts], p[starts], np.maximum.reduceat(ends, starts), covered(new, p, ends)


CHAINS = "kind int, row long, partner long, start int, stop int, other_start int, other_stop int, anchors binary"


def _chain(rules: Rules, last: bool):
    """Chains of each row, and unless this is the ``last`` round its stretches that are long and dense enough for a passage."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in CHAINS.split(", ")]

    def of(rows: list[np.ndarray]) -> pa.RecordBatch | None:
        row, partner, pos, other, size = merge(*rows)
        if not len(row):
            return None
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (partner[1:] != partner[:-1])
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(row))
        good = np.add.reduceat(size, starts) >= rules.least_seeded
        out, whole = [], set()
        for a, b in zip(starts[good].tolist(), stops[good].tolist()):
            order = np.argsort(pos[a:b], kind="stable") + a
            p, o, s = pos[order].tolist(), other[order].tolist(), size[order].tolist()
            for chain in chains(p, o, s, rules.far_cost if last else rules.gap_cost):
                if sum(s[i] for i in chain) < rules.least_seeded:
                    continue
                i, j = chain[0], chain[-1]
                if i == j:
                    # An equal stretch without a gap is aligned with one partner; another one's is the same.
                    if (mark := (int(row[a]), p[i], s[i])) in whole:
                        continue
                    whole.add(mark)
                anchors = np.array([(p[c], o[c], s[c]) for c in chain], "<i4").tobytes()
                out.append((CHAIN, row[a], partner[a], p[i], p[j] + s[j], o[i], o[j] + s[j], anchors))
        if not last:
            r, begin, end, under = stretches(row, pos, size, rules.stretch_gap)
            # A passage's first and last words may have no seed.
            near = (end - begin + 4 * rules.k >= rules.min_words) & (under >= rules.least_seeded) & (5 * under >= end - begin)
            out += [(STRETCH, r[i], -1, begin[i], end[i], 0, 0, None) for i in np.flatnonzero(near).tolist()]
        if not out:
            return None
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy() for i in range(5)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            other = np.flatnonzero(rows[0] != rows[0][-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut and (out := of([x[:cut] for x in rows])) is not None:
                yield out
            held = [x[cut:] for x in rows]
        if held is not None and (out := of(held)) is not None:
            yield out

    return run


def uncovered(stretch: tuple[int, int], spans: list[tuple[int, int]], rules: Rules) -> list[tuple[int, int]]:
    """Parts of a stretch that no span covers and that are long enough to matter, with the words around them that a passage
    over them may have."""
    start, stop = stretch
    open_, at = [], start
    for a, b in sorted(spans):
        if a - at >= rules.least_seeded and a > at:
            open_.append((at, min(a, stop)))
        at = max(at, b)
    if stop - at >= rules.least_seeded:
        open_.append((at, stop))
    wide = [(max(start, a - rules.min_words), min(stop, b + rules.min_words)) for a, b in open_ if b - a >= rules.least_seeded]
    return [(a, b) for a, b in wide if b - a + 4 * rules.k >= rules.min_words]


def _left_open(rules: Rules):
    """Open parts of the stretches; rows are sorted by row, spans (kind 0) before stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, spans = None, []
        for batch in batches:
            out = []
            for r, kind, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                if r != row:
                    row, spans = r, []
                if kind == 0:
                    spans.append((start, stop))
                else:
                    out += [(r, a, b) for a, b in uncovered((start, stop), spans, rules)]
            columns = list(zip(*out)) or [[]] * 3
            kinds = [pa.int64(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["row", "start", "stop"])

    return run


# Stretches that are looked up again


def _inside(rules: Rules):
    """Pairs of seeds within the given stretches of each text, with the first seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 0):
            words, doc, begin = numbered_words(batch.column(0))
            place, seed = minimizers(words, doc, rules.k, rules.window)
            of = doc[place]
            has, key, gap = paired(place, seed, of, rules)
            start = (place - begin[of])[has]
            stop = start + gap + rules.k
            bounds = np.searchsorted(of[has], np.arange(batch.num_rows + 1))
            found = [np.zeros(0, np.int64)]
            for i, parts in enumerate(batch.column(1).to_pylist()):
                a, b = bounds[i], bounds[i + 1]
                found += [a + np.flatnonzero((start[a:b] >= x["start"]) & (stop[a:b] <= x["stop"])) for x in parts]
            which = np.concatenate(found)
            columns = [seed[has[which]].view(np.int64), key[which].view(np.int64)]
            yield pa.record_batch([pa.array(c) for c in columns], names=["first", "seed"])

    return run


def _hidden(docs: DataFrame, open_: DataFrame, rules: Rules) -> DataFrame:
    """Links of the open stretches by pairs of seeds."""
    n = tasks(docs.sparkSession)
    parts = keep(open_.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("parts")), "open-rows", 8)
    rows = bit_filter(parts.select("row"), rules.filter_bits)
    texts = docs.select("row", "text").mapInArrow(_of_rows(rows), "row long, text binary")
    pairs = texts.join(parts, "row").select("text", "parts").mapInArrow(lean(_inside(rules)), "first long, seed long")
    pairs = keep(pairs.distinct(), "asked-pairs", 8)
    asked = tuple(bit_filter(pairs.select(c), rules.filter_bits) for c in ("first", "seed"))
    found = docs.select("row", "text").mapInArrow(lean(_seeded(rules, asked, rows)), SEEDS)
    # Pairs that nobody asked for, but the filter let pass, make links that are right as well.
    return found.repartition(n, "seed").sortWithinPartitions("seed").mapInArrow(lean(_across(rules, rows)), LINKS)


# Alignment


def common_prefixes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of every pair of beginnings."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, x in enumerate(a.tolist()):
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + (b == x)))
    return table


def _enough(met: np.ndarray, least: int, identity: float) -> bool:
    """Whether any beginning of at least so many words has enough of them in both."""
    counts = np.cumsum(met)[least - 1 :]
    return bool((counts >= identity * np.arange(least, least + len(counts))).any())


def _extend(a: np.ndarray, b: np.ndarray, rules: Rules) -> tuple[int, int, int, int]:
    """How far two sequences go along, on either side, to where most is won, and the equal words and columns until there."""
    at, bt, equal, columns = 0, 0, 0, 0
    # After an unlike word so many equal ones win.
    least = int(rules.min_identity / (1 - rules.min_identity) + 1e-9) + 1 if rules.min_identity < 1 else rules.step + 1
    while at < len(a) and bt < len(b):
        count = min(len(a) - at, len(b) - bt)
        unlike = np.flatnonzero(a[at : at + count] != b[bt : bt + count])
        same = int(unlike[0]) if len(unlike) else count
        at, bt, equal, columns = at + same, bt + same, equal + same, columns + same
        # A first look at few words is mostly enough.
        for step in (16, rules.step):
            x, y = a[at : at + step], b[bt : bt + step]
            if min(len(x), len(y)) < least:
                return at, bt, equal, columns
            # No more words can be in order than have an equal one at all.
            like = x[:, None] == y[None, :]
            if not all(_enough(like.any(axis=axis), least, rules.min_identity) for axis in (0, 1)):
                best, won = (0, 0), 0
                continue
            table = common_prefixes(x, y)
            score = table - rules.min_identity * np.maximum(*np.ogrid[: len(x) + 1, : len(y) + 1])
            best = np.unravel_index(score.argmax(), score.shape)
            won = score[best]
            if won > 0:
                break
        if won <= 0:
            break
        at, bt, equal, columns = at + int(best[0]), bt + int(best[1]), equal + int(table[best]), columns + int(max(best))
    return at, bt, equal, columns


def _best_runs(won: list[float]) -> list[tuple[int, int]]:
    """Disjoint runs of steps (first, last) with the largest sums, taken one after another while they are above zero."""
    found, open_ = [], [(0, len(won))]
    while open_:
        low, high = open_.pop()
        best, start, total = (0.0, 0, 0), low, 0.0
        for i in range(low, high):
            if total <= 0:
                start, total = i, 0.0
            total += won[i]
            if total > best[0]:
                best = (total, start, i)
        if best[0] > 0:
            found.append(best[1:])
            open_ += [(low, best[1]), (best[2] + 1, high)]
    return sorted(found)


def align(own: np.ndarray, other: np.ndarray, anchors: np.ndarray, rules: Rules) -> list[tuple[int, ...]]:
    """Start and stop on both sides, equal words and columns of the passages along a chain of anchors (places within the
    two slices). A chain that leads through unlike text is cut where keeping together costs more equal words than it wins."""
    rows = anchors.tolist()
    # Anchors and the gaps between them, in turn: equal words and columns.
    steps: list[tuple[int, int]] = []
    for i, (a, b, size) in enumerate(rows):
        if i:
            gap_a, gap_b = own[rows[i - 1][0] + rows[i - 1][2] : a], other[rows[i - 1][1] + rows[i - 1][2] : b]
            wide = max(len(gap_a), len(gap_b))
            close = wide <= rules.reach and min(len(gap_a), len(gap_b))
            steps.append((int(common_prefixes(gap_a, gap_b)[-1, -1]) if close else 0, wide))
        steps.append((size, size))
    found = []
    # A best run begins and ends with an anchor, as these alone win.
    for first, last in _best_runs([equal - rules.min_identity * columns for equal, columns in steps]):
        first, last = first + first % 2, last - last % 2
        equal, columns = (sum(x) for x in zip(*steps[first : last + 1]))
        start_a, start_b, _ = rows[first // 2]
        end_a, end_b = rows[last // 2][0] + rows[last // 2][2], rows[last // 2][1] + rows[last // 2][2]
        back = _extend(own[:start_a][::-1], other[:start_b][::-1], rules)
        on = _extend(own[end_a:], other[end_b:], rules)
        found.append(
            (start_a - back[0], end_a + on[0], start_b - back[1], end_b + on[1], equal + back[2] + on[2], columns + back[3] + on[3])
        )
    return found


def _aligned(rules: Rules):
    names = ["row", "id", "h", "partner", "start", "stop", "other_start", "other_stop", "equal", "columns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, values = [], []
            columns = [batch.column(n).to_pylist() for n in ("own_words", "other_words", "own_from", "other_from", "anchors")]
            for i, (a, b, from_a, from_b, anchors) in enumerate(zip(*columns)):
                local = np.frombuffer(anchors, "<i4").reshape(-1, 3) - np.array([from_a, from_b, 0])
                for got in align(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), local, rules):
                    if got[1] - got[0] >= rules.min_words:
                        taken.append(i)
                        values.append((got[0] + from_a, got[1] + from_a, got[2] + from_b, got[3] + from_b, *got[4:]))
            if taken:
                kept = batch.take(pa.array(taken))
                out = [kept.column(n) for n in ("row", "id", "h", "partner_id")]
                yield pa.record_batch([*out, *[pa.array(list(c), pa.int64()) for c in zip(*values)]], names=names)

    return run


def _of_rows(bits: np.ndarray):
    """Texts of the rows that the filter knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = in_filter(bits, batch.column(0).to_numpy())
            yield pa.record_batch(batch.columns, names=["row", "text"]).filter(pa.array(known))

    return run


def _words(bits: np.ndarray):
    """Word hashes of the documents whose rows the filter knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 3):
            batch = batch.filter(pa.array(in_filter(bits, batch.column(0).to_numpy())))
            words, _, begin = numbered_words(batch.column(3))
            short = (words >> np.uint64(32)).astype("<u4").tobytes()
            cuts = [*begin.tolist(), len(words)]
            slices = pa.array([short[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])], pa.binary())
            yield pa.record_batch([*batch.columns[:3], slices], names=["row", "id", "h", "words"])

    return run


def _align(docs: DataFrame, candidates: DataFrame, rules: Rules) -> DataFrame:
    """Passages along the chains, by row."""
    kind = docs.schema["id"].dataType.simpleString()
    ends = candidates.select("row").unionByName(candidates.select(F.col("partner").alias("row")))
    bits = bit_filter(ends, rules.filter_bits)
    words = docs.select("row", "id", "h", "text").mapInArrow(lean(_words(bits)), f"row long, id {kind}, h long, words binary")
    words = keep(words, "passage-words")

    def cut(start: str, stop: str, out: str) -> dict:
        first = F.greatest(F.col(start) - rules.reach, F.lit(0))
        return {
            f"{out}_from": first,
            f"{out}_words": F.substring(F.col("words"), 4 * first + 1, 4 * (F.col(stop) + rules.reach - first)),
        }

    own = candidates.join(words, "row").withColumns(cut("start", "stop", "own")).drop("words")
    partners = words.select(F.col("row").alias("partner"), F.col("id").alias("partner_id"), "words")
    both = own.join(partners, "partner").withColumns(cut("other_start", "other_stop", "other")).drop("words")
    columns = ["row", "id", "h", "partner_id", "own_words", "other_words", "own_from", "other_from", "anchors"]
    out = f"row long, id {kind}, h long, partner {kind}, start long, stop long, other_start long, other_stop long, equal long, columns long"
    return keep(both.select(*columns).mapInArrow(lean(_aligned(rules)), out), "passages", 2)


# The whole


def _in_order(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``row`` (a number in the order of the ids), ``id``, ``h`` (the text's hash) and ``text`` of every document. Whole numbers
    that name one row each are their own order; anything else is sorted, and rows of equal id and text become one."""
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("h"), as_bytes(text).alias("text"))
    whole = isinstance(rows.schema["id"].dataType, (ByteType, ShortType, IntegerType, LongType))
    if whole and rows.groupBy("id").count().where("id IS NULL OR count > 1").isEmpty():
        return rows.withColumn("row", F.col("id").cast("long"))
    once = keep(rows.dropDuplicates(["id", "h"]), "passage-documents")
    order = [F.col("id").asc_nulls_last(), F.col("h")]
    dealt = once.repartitionByRange(tasks(docs.sparkSession), *order).sortWithinPartitions(*order)
    return keep(dealt.withColumn("row", F.monotonically_increasing_id()), "passage-rows")


def _passages(docs: DataFrame, id: str, text: str, rules: Rules) -> DataFrame:
    """Passages with the row number, the id and the text's hash of their document."""
    if not 0 < rules.window <= rules.k:
        raise ValueError("the window must not be longer than a k-mer")
    n = tasks(docs.sparkSession)
    rows = _in_order(docs, id, text)
    links = (
        rows.select("row", "text")
        .mapInArrow(lean(_seeded(rules)), SEEDS)
        .repartition(n, "seed")
        .sortWithinPartitions("seed")
        .mapInArrow(lean(_across(rules)), LINKS)
    )

    def chained(links: DataFrame, last: bool) -> DataFrame:
        return links.repartition(n, "row").sortWithinPartitions("row").mapInArrow(lean(_chain(rules, last)), CHAINS)

    first = keep(chained(links, False), "chains", 2)
    found = _align(rows, first.where(F.col("kind") == CHAIN), rules)
    spans = found.select("row", F.lit(0).alias("kind"), F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))
    both = spans.unionByName(first.where(F.col("kind") == STRETCH).select("row", "kind", "start", "stop"))
    open_ = both.repartition(n, "row").sortWithinPartitions("row", "kind").mapInArrow(_left_open(rules), "row long, start int, stop int")
    open_ = keep(open_, "open-stretches", 8)
    if open_.isEmpty():
        return found
    again = keep(chained(_hidden(rows, open_, rules), True), "chains-again", 2)
    return found.unionByName(_align(rows, again, rules)).distinct()


def passages(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Passages that repeat an earlier document: ``id``, ``start``, ``stop`` (in words), ``partner`` (the earlier document's
    id), ``other_start``, ``other_stop``, ``equal`` (words) and ``columns`` (of the alignment)."""
    return _passages(docs, id, text, rules).drop("row", "h").withColumnRenamed("id", id)


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the given spans and the white space after them."""
    places = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for start, stop in sorted(spans):
        a, b = places[start], places[min(stop, len(places) - 1)]
        if b > at:
            out.append(text[at : max(a, at)])
            at = b
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series(
        [t if s is None or t is None else without_words(t, [(x["start"], x["stop"]) for x in s]) for t, s in zip(texts, spans)],
        dtype="object",
    )


def without_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with every passage that repeats an earlier document cut out; the first document keeps it. Documents in which
    no word is left go. Rows of equal id and text lose the same words."""
    found = _passages(docs, id, text, rules)
    spans = found.groupBy("id", "h").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    spans = keep(spans.withColumnsRenamed({"id": "i", "h": "g"}), "passage-spans", 8)
    same = own(id).eqNullSafe(F.col("i")) & (F.xxhash64(own(text)) == F.col("g"))
    joined = carried(docs).join(spans, same, "left")
    cut = joined.withColumn("cut", F.when(F.col("spans").isNotNull(), _cut(own(text), "spans")).otherwise(own(text)))
    left = cut.where(F.col("spans").isNull() | F.col("cut").rlike(WORD))
    return left.select(*restored(docs.columns, {text: F.col("cut")}))
