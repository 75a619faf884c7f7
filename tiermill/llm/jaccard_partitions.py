"""Exact Jaccard join of word n-gram sets by partitioning the universe of n-grams.

Two sets within the threshold differ in few elements: at most H, a number that follows from the smaller size. Sizes are cut
into bands, and for the pairs whose smaller set is in a band every element is hashed to one of m = H + 1 segments. By the
pigeonhole principle one segment at least is equal on both sides. So each set is indexed by the subset it has in every segment,
once as the smaller side of its own band's pairs and once as the larger side of the band's below; equal sets are one entry.

A shared subset is a bucket. First every member of a bucket is compared with the bucket's first one and the components of
these links are found; a bucket whose members are all connected is done, whatever its size. What is left is compared with the
member that is in most open buckets, and closed alike. In open buckets of up to
``small`` sets all pairs that are not yet connected are compared. Larger open ones (an empty segment, or common boilerplate)
are costly, so thresholds are allocated anew for the sets in them: a large bucket gets -1, that is, it is not looked at, and
as many of the set's cheapest other segments get 1 instead of 0. These are indexed by the one-deletion neighbourhood, all
subsets with one element less, so that a segment differing in one element is found. Where that does not pay, or more than half
of a set's segments are large open buckets, a bucket keeps 0 and is searched. Members of open buckets carry parity sketches of
512 bits, in which two sets cannot differ in more cells than they differ in elements, so vector operations discard almost all
pairs that are not linked before any set moves. Every candidate is verified on the whole sets.

Elements are 64-bit hashes of n-grams; sets are named by a 96-bit hash of their elements.

Defined cases: a null or empty text, or one without words, has the empty set, which is linked with nothing, not even its equal;
texts of fewer words than ``width`` have one element, the whole sequence; repeated elements count once. Rows with a null id
link others but have a null component; rows with repeated ids are all returned; equal rows are in one component. Very long
texts have as many segments as their size asks for. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.llm.common import as_bytes, bit_filter, in_filter, keep, lean, tasks
from tiermill.llm.components import components
from tiermill.llm.words import mixed, word_hashes

SKETCH = 64
A, B, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB))


@dataclass(frozen=True)
class Rules:
    width: int = 3
    percent: int = 90
    small: int = 32  # sets in a bucket whose pairs are all compared
    remembered: int = 200_000  # sets of which a task still knows that it has indexed them
    filter_bits: int = 26  # of the filter by which tasks skip texts that nobody asks for


# Sets


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a text's words."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, np.uint64(width))
    for j in range(width):
        out = mixed(out * A + words[j : len(words) - width + 1 + j] * B)
    return np.unique(out)


def element_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct word n-grams of each text; A-Z are lower-cased."""
    words, bounds = word_hashes(texts)
    return [grams(words[a:b], width) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


def name_of(set_: np.ndarray) -> tuple[int, int]:
    """96 bits that name a set, as a long and an int; zeros for the empty one."""
    if not len(set_):
        return 0, 0
    a, b = np.frombuffer(xxhash.xxh128_digest(set_.tobytes()), "<i8").tolist()
    return a, b & 0x7FFFFFFF


def differing(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of two linked sets of these sizes: |a & b| >= percent / (100 + percent) * (a + b)."""
    return (a + b) * (100 - percent) // (100 + percent)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


# Bands and segments


@cache
def bands(percent: int, most: int) -> tuple[list[int], list[int]]:
    """First size of each band, up to ``most``, and its number of segments. A set of a band's sizes links with larger ones of
    its own and the next band only. Bands whose pairs can only be equal have one segment and are not indexed."""
    starts, segments = [1, 2], []
    while starts[-1] <= most:
        starts.append(max(starts[-1] + 1, (starts[-1] - 1) * 100 // percent + 1))
    for start, end in zip(starts, starts[1:]):
        largest = end - 1
        segments.append(differing(largest, largest * 100 // percent, percent) + 1)
    return starts[:-1], segments


def schemes(size: int, percent: int) -> list[tuple[int, int]]:
    """The bands whose pairs a set of this size may be in, as the smaller or the larger side, and their segments."""
    most = 1 << max(10, size.bit_length())
    starts, segments = bands(percent, most)
    own = bisect_right(starts, size) - 1
    return [(k, segments[k]) for k in (own, own - 1) if k >= 0 and segments[k] > 1]


def subsets(set_: np.ndarray, scheme: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each element, and for each segment a hash of its subset: a sum, so that one element can be left out."""
    place = (mixed(set_ + np.uint64(scheme * int(A) % 2**64)) % np.uint64(count)).astype(np.int64)
    sums = np.zeros(count, np.uint64)
    np.add.at(sums, place, mixed(set_ * B + A))
    return place, sums


def signatures(sums: np.ndarray, places: np.ndarray, scheme: int) -> np.ndarray:
    """Index keys of subsets; the scheme and the segment are part of them."""
    return mixed(sums + mixed(places.astype(np.uint64) * A + np.uint64((scheme + 1) * int(B) % 2**64)))


def sketch(set_: np.ndarray) -> bytes:
    """Parity of the elements in each of 512 cells."""
    cells = (mixed(set_ + D) % np.uint64(8 * SKETCH)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=8 * SKETCH) & 1).astype(np.uint8)).tobytes()


NAME = np.dtype([("a", "<i8"), ("b", "<i4")])


def _names(a: np.ndarray, b: np.ndarray) -> pa.Array:
    """Names as binary values from their two parts."""
    joined = np.empty(len(a), NAME)
    joined["a"], joined["b"] = a, b
    kind = pa.binary(NAME.itemsize)
    return pa.FixedSizeBinaryArray.from_buffers(kind, len(a), [None, pa.py_buffer(joined.tobytes())]).cast(pa.binary())


def _names_of(sets: list[np.ndarray]) -> pa.Array:
    parts = np.array([name_of(s) for s in sets], np.int64).reshape(-1, 2)
    return _names(parts[:, 0], parts[:, 1])


def _named(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = element_sets(batch.column(1), rules.width)
            columns = [batch.column(0), batch.column(2), _names_of(sets), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.record_batch(columns, names=["id", "h", "s", "n"])

    return run


# Buckets of shared subsets


#: ``b`` holds the second part of a name and, in its high half, the size of the set.
INDEX = "sig long, a long, b long, first_a long, first_b long, met boolean"
INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
STARS = "sig long, s binary, n int, first binary, first_n int"
STAR_NAMES = [x.split()[0] for x in STARS.split(", ")]
#: Members that a subset has in one batch before they are combined there.
HOT = 4


def _indexed(rules: Rules):
    """Signatures of all segments of each set, once a task and set. A batch's members of one subset are linked to the first
    of them right here (``met``) and dealt out evenly; only the first one goes on to the subset's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict = OrderedDict()
        for batch in batches:
            found: list[tuple[np.ndarray, int, int]] = []
            for set_ in element_sets(batch.column(0), rules.width):
                options = schemes(len(set_), rules.percent)
                name = name_of(set_)
                if not options or name in seen:
                    continue
                seen[name] = None
                if len(seen) > rules.remembered:
                    seen.popitem(last=False)
                for scheme, count in options:
                    sums = subsets(set_, scheme, count)[1]
                    found.append((signatures(sums, np.arange(count), scheme), name[0], name[1] | len(set_) << 32))
            if not found:
                continue
            sig = np.concatenate([f[0] for f in found]).view(np.int64)
            counts = [len(f[0]) for f in found]
            a, b = (np.repeat(np.array([f[i] for f in found], np.int64), counts) for i in (1, 2))
            order = np.lexsort((b, a, sig))
            sig, a, b = sig[order], a[order], b[order]
            starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            sizes = np.diff(np.append(starts, len(sig)))
            first = np.repeat(starts, sizes)
            met = (np.repeat(sizes, sizes) >= HOT) & (np.arange(len(sig)) != first)
            columns = [sig, a, b, np.where(met, a[first], 0), np.where(met, b[first], 0), met]
            yield pa.record_batch([pa.array(c) for c in columns], names=INDEX_NAMES)

    return run


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every member of a bucket but the first, with the first; rows are sorted by sig and name. What has met passes."""
    last: tuple | None = None  # signature, name, first name of the bucket that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, a, b, fa, fb, met = (c.to_numpy(zero_copy_only=False).copy() for c in batch.columns)
        own = np.flatnonzero(~met)
        taken = np.flatnonzero(met)
        if len(own):
            g, x, y = sig[own], a[own], b[own]
            begins = np.concatenate(([True], g[1:] != g[:-1]))
            again = np.concatenate(([False], (g[1:] == g[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])))
            first = np.maximum.accumulate(np.where(begins, np.arange(len(own)), 0))
            fa[own], fb[own] = x[first], y[first]
            member = ~again & ~begins
            if last is not None and last[0] == g[0]:
                going = first == 0
                fa[own[going]], fb[own[going]] = last[3:]
                member[0] = (x[0], y[0]) != last[1:3]
            taken = np.concatenate((own[member], taken))
            e = own[-1]
            last = (sig[e], a[e], b[e], fa[e], fb[e])
        # A first name that comes again after others is not its own partner.
        taken = taken[(a[taken] != fa[taken]) | (b[taken] != fb[taken])]
        if len(taken):
            b, fb = b[taken], fb[taken]
            low = 0x7FFFFFFF
            columns = [
                pa.array(sig[taken]), _names(a[taken], b & low), pa.array((b >> 32).astype(np.int32)),
                _names(fa[taken], fb & low), pa.array((fb >> 32).astype(np.int32)),
            ]
            yield pa.record_batch(columns, names=STAR_NAMES)


# Verification


def _loaded(rules: Rules, bits: np.ndarray):
    """Elements and sketches of the texts whose hash the filter knows, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict = OrderedDict()
        for batch in batches:
            h = batch.column(1).to_numpy()
            wanted = []
            for i in np.flatnonzero(in_filter(bits, h)).tolist():
                if h[i] not in seen:
                    seen[h[i]] = None
                    wanted.append(i)
                    if len(seen) > rules.remembered:
                        seen.popitem(last=False)
            sets = element_sets(batch.column(0).take(pa.array(wanted, pa.int64())), rules.width)
            columns = [_names_of(sets), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary())]
            yield pa.record_batch(columns, names=["s", "set", "mark"])

    return run


def _sets(docs: DataFrame, names: DataFrame, wanted: DataFrame, rules: Rules) -> DataFrame:
    """``s``, ``set`` (elements in order) and ``mark`` (sketch) of the wanted names, worked out from one text of each. Tasks
    skip most other texts by a filter of fixed size, and the rest goes by name; so texts do not move."""
    hashes = names.join(wanted, "s", "left_semi").groupBy("s").agg(F.min("h").alias("h"))
    bits = bit_filter(hashes.select("h"), rules.filter_bits)
    loaded = docs.select("text", "h").mapInArrow(lean(_loaded(rules, bits)), "s binary, set binary, mark binary")
    return keep(loaded.join(wanted, "s", "left_semi").dropDuplicates(["s"]), "jaccard-elements", 2)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3))
            good = [linked(*(np.frombuffer(v.as_buffer(), "<u8") for v in pair), percent) for pair in pairs]
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, rules: Rules) -> DataFrame:
    """The pairs (``s``, ``t``) whose sets are within the threshold, as ``u`` and ``v``."""
    left = pairs.join(sets.select("s", F.col("set").alias("x")), "s")
    both = left.join(sets.select(F.col("s").alias("t"), F.col("set").alias("y")), "t")
    return both.select("s", "t", "x", "y").mapInArrow(lean(_verified(rules.percent)), "u binary, v binary")


def _near(n: str, m: str, percent: int):
    """Whether sets of these sizes may link at all."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


# Open buckets


SPARE = "kind int, key long, s binary, segment long"
SPARE_NAMES = [x.split()[0] for x in SPARE.split(", ")]
EXACT, LESS = 0, 1


def _spared(rules: Rules):
    """Of each set in large open buckets, for both its schemes: the subsets in all segments (the hashes of those that are
    large open buckets are given) and their one-deletion neighbourhoods."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, large, data in zip(*(c.to_pylist() for c in batch.columns)):
                set_ = np.frombuffer(data, "<u8")
                for scheme, count in schemes(len(set_), rules.percent):
                    place, sums = subsets(set_, scheme, count)
                    exact = signatures(sums, np.arange(count), scheme)
                    if not np.isin(exact.view(np.int64), large).any():
                        continue
                    less = signatures(sums[place] - mixed(set_ * B + A), place, scheme)
                    # A segment is named by its scheme as well.
                    segments = np.concatenate((np.arange(count), place)) | scheme << 40
                    columns = [
                        pa.array(np.repeat(np.array([EXACT, LESS], np.int32), [count, len(set_)])),
                        pa.array(np.concatenate((exact, less)).view(np.int64)),
                        pa.array([s] * len(segments), pa.binary()), pa.array(segments),
                    ]
                    yield pa.record_batch(columns, names=SPARE_NAMES)

    return run


def allocate(costs: dict[int, int], large: dict[int, int]) -> dict[int, int]:
    """Thresholds of a set's segments. ``large`` has the size of the large open buckets, whose segments get 0 at that cost or -1
    for nothing; ``costs`` what every segment costs with 1. Each -1 takes a 1 elsewhere, so the largest buckets go with the
    cheapest other segments as long as that pays."""
    found = {i: 0 for i in costs}
    others = sorted((i for i in costs if i not in large), key=lambda i: (costs[i], i))
    for i, j in zip(sorted(large, key=lambda i: (-large[i], i)), others):
        if costs[j] < large[i]:
            found[i], found[j] = -1, 1
    return found


def _allocated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with 1, and large ones that keep 0."""
    for batch in batches:
        out = []
        for s, _, segments in zip(*(c.to_pylist() for c in batch.columns)):
            large = {x["segment"]: x["g"] for x in segments if x["g"] is not None}
            keys = {x["segment"]: x["key"] for x in segments}
            found = allocate({x["segment"]: x["cost"] for x in segments}, large)
            out += [(s, i, keys[i], t) for i, t in found.items() if t == 1 or t == 0 and i in large]
        columns = list(zip(*out)) or [[]] * 4
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["s", "segment", "key", "t"])


#: A member of a bucket: whether it is looked up there or only listed, and whether as the subset or one element more.
MEMBERS = ["key", "s", "n", "root", "kind", "asks", "mark"]


def _blocked(rules: Rules):
    """Pairs within a bucket that sizes and sketches allow; rows are sorted by key. One of a pair asks for the other, they are
    in different components, and one at least has the whole subset."""

    def of(rows: list[list]) -> Iterator[pa.RecordBatch]:
        names, sizes, roots, kinds, asks, marks = zip(*rows)
        sizes, kinds, asks = np.array(sizes, np.int64), np.array(kinds), np.array(asks)
        table = np.frombuffer(b"".join(marks), np.uint64).reshape(len(rows), -1)
        group = np.unique(np.array(roots, object), return_inverse=True)[1]
        for i in np.flatnonzero(asks).tolist():
            # Two that ask are compared once.
            other = (group != group[i]) & ~(asks & (np.arange(len(rows)) < i))
            if kinds[i] == LESS:
                other &= kinds == EXACT
            other &= 100 * np.minimum(sizes, sizes[i]) >= rules.percent * np.maximum(sizes, sizes[i])
            which = np.flatnonzero(other)
            apart = np.bitwise_count(table[which] ^ table[i]).sum(axis=1)
            which = which[apart <= (sizes[which] + sizes[i]) * (100 - rules.percent) // (100 + rules.percent)]
            if len(which):
                pairs = [[names[i]] * len(which), [names[j] for j in which.tolist()]]
                yield pa.record_batch([pa.array(c, pa.binary()) for c in pairs], names=["s", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if len(rows) > 1:
                        yield from of(rows)
                    key, rows = k, []
                rows.append(row)
        if len(rows) > 1:
            yield from of(rows)

    return run


def _asked(large: DataFrame, sets: DataFrame, rules: Rules) -> DataFrame:
    """Who looks up what for the sets in large open buckets, and who is listed there (``MEMBERS`` without root, size, mark)."""
    of = large.groupBy("s").agg(F.collect_list("sig").alias("large"))
    spared = keep(of.join(sets, "s").select("s", "large", "set").mapInArrow(lean(_spared(rules)), SPARE), "jaccard-spare")
    exact = F.col("kind") == EXACT
    lists = spared.groupBy("key").agg(F.sum(exact.cast("long")).alias("whole"), F.sum((~exact).cast("long")).alias("less"))
    costs = spared.join(lists, "key").groupBy("s", "segment").agg(
        F.sum(F.when(exact, F.col("less")).otherwise(F.col("whole"))).alias("cost"), F.max(F.when(exact, F.col("key"))).alias("key")
    )
    plan = keep(
        costs.join(large.select("s", F.col("sig").alias("key"), "g"), ["s", "key"], "left")
        .groupBy("s", F.shiftright("segment", 40).alias("scheme"))
        .agg(F.collect_list(F.struct("segment", "key", "cost", "g")).alias("segments"))
        .mapInArrow(_allocated, "s binary, segment long, key long, t int"),
        "jaccard-thresholds",
        4,
    )
    lookups = spared.join(plan.where("t = 1").select("s", "segment"), ["s", "segment"]).select("key", "s", "kind")
    lookups = keep(lookups, "jaccard-lookups", 4)
    # Only what somebody looks up is listed, subsets for their neighbourhoods and these for subsets.
    sought = lookups.select("key", (1 - F.col("kind")).alias("kind")).distinct()
    listed = spared.select("key", "s", "kind").join(sought, ["key", "kind"], "left_semi")
    both = lookups.withColumn("asks", F.lit(True)).unionByName(listed.withColumn("asks", F.lit(False)))
    kept = plan.where("t = 0").select("key", "s", F.lit(True).alias("a"))
    buckets = large.select(F.col("sig").alias("key"), "s").join(kept, ["key", "s"], "left")
    return both.unionByName(buckets.select("key", "s", F.lit(EXACT).alias("kind"), F.coalesce("a", F.lit(False)).alias("asks")))


def _open(stars: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets whose members are in several components: ``sig``, ``s``, ``n``, ``root`` and ``g`` (members of the
    bucket)."""
    # The stars of a bucket connect it, so it is open where one of them leads from one component to another.
    apart = stars.join(links, (F.col("s") == F.col("u")) & (F.col("first") == F.col("v")), "left_anti").select("sig", "s", "first")
    apart = apart.join(roots.select(F.col("id").alias("s"), F.col("root").alias("own")), "s", "left")
    apart = apart.join(roots.select(F.col("id").alias("first"), F.col("root").alias("other")), "first", "left")
    sigs = keep(
        apart.where(F.coalesce("own", "s") != F.coalesce("other", "first")).select("sig").distinct(), "jaccard-open-sigs", 8
    )
    rows = stars.join(sigs, "sig", "left_semi")
    ends = rows.select("sig", "s", "n").unionByName(rows.select("sig", F.col("first").alias("s"), F.col("first_n").alias("n")))
    members = keep(
        ends.distinct().join(roots.withColumnRenamed("id", "s"), "s", "left").withColumn("root", F.coalesce("root", "s")), "jaccard-open"
    )
    return keep(members.join(members.groupBy("sig").agg(F.count(F.lit(1)).alias("g")), "sig"), "jaccard-open-counted", 4)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).distinct()


def _to_centres(open_: DataFrame, rules: Rules) -> DataFrame:
    """Pairs of each member of an open bucket with the one that is in most open buckets, so most like the others."""
    degrees = open_.groupBy("s").agg(F.count(F.lit(1)).alias("degree"))
    centres = open_.join(degrees, "s").groupBy("sig").agg(F.max_by(F.struct("s", "n", "root"), F.struct("degree", "s")).alias("c"))
    centres = centres.select("sig", *[F.col(f"c.{c}").alias(f"{c}_2") for c in ("s", "n", "root")])
    apart = open_.join(centres, "sig").where((F.col("root") != F.col("root_2")) & _near("n", "n_2", rules.percent))
    return _ordered(apart.select("s", F.col("s_2").alias("t")))


def _still_open(open_: DataFrame, roots: DataFrame) -> DataFrame:
    """What is open with more links known."""
    members = open_.drop("root").join(roots.withColumnRenamed("id", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    members = keep(members, "jaccard-reopened", 4)
    sigs = members.groupBy("sig").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("sig")
    return keep(members.join(sigs, "sig", "left_semi"), "jaccard-still-open", 4)


def _more_pairs(open_: DataFrame, sets: DataFrame, rules: Rules) -> DataFrame:
    """Candidate pairs (``s``, ``t``) of open buckets."""
    n = tasks(open_.sparkSession)
    members = keep(open_.select("s", "n", "root").distinct(), "jaccard-members", 4)
    small, large = open_.where(F.col("g") <= rules.small), keep(open_.where(F.col("g") > rules.small), "jaccard-large", 8)
    asked = small.select(F.col("sig").alias("key"), "s", F.lit(EXACT).alias("kind"), F.lit(True).alias("asks"))
    if not large.isEmpty():
        asked = asked.unionByName(_asked(large, sets, rules))
    rows = asked.join(members, "s").join(sets.select("s", "mark"), "s").select(*MEMBERS)
    pairs = rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lean(_blocked(rules)), "s binary, t binary")
    return _ordered(pairs)


def _all_links(docs: DataFrame, names: DataFrame, rules: Rules) -> DataFrame:
    """``u``, ``v``: links that connect all sets within the threshold."""
    n = tasks(docs.sparkSession)
    index = docs.select("text").mapInArrow(lean(_indexed(rules)), INDEX)
    deal = F.when(F.col("met"), F.xxhash64("sig", "a")).otherwise(F.col("sig"))
    stars = keep(index.repartition(n, deal).sortWithinPartitions("sig", "a", "b").mapInArrow(lean(_starred), STARS), "jaccard-stars", 2)
    near = stars.where(_near("n", "first_n", rules.percent)).select("s", F.col("first").alias("t")).distinct()
    pairs = keep(near, "jaccard-pairs", 4)
    wanted = keep(pairs.select("s").unionByName(pairs.select(F.col("t").alias("s"))).distinct(), "jaccard-wanted", 8)
    links = keep(_links(pairs, _sets(docs, names, wanted, rules), rules), "jaccard-links", 4)
    open_ = _open(stars, links, keep(components(links), "jaccard-roots", 8))
    if open_.isEmpty():
        return links
    sets = _sets(docs, names, keep(open_.select("s").distinct(), "jaccard-open-names", 8), rules)
    # Before pairs of all kinds, the members that are most like the others; what was refused is not verified again.
    known = _ordered(pairs)
    central = keep(_to_centres(open_, rules).join(known, ["s", "t"], "left_anti"), "jaccard-central", 4)
    links = keep(links.unionByName(_links(central, sets, rules)), "jaccard-central-links", 8)
    open_ = _still_open(open_, keep(components(links), "jaccard-central-roots", 8))
    if open_.isEmpty():
        return links
    known = known.unionByName(central)
    more = keep(_more_pairs(open_, sets, rules).join(known, ["s", "t"], "left_anti"), "jaccard-more", 4)
    return keep(links.unionByName(_links(more, sets, rules)), "jaccard-all-links", 8)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``id``, ``n_shingles`` (size of the set) and ``component_id`` (the smallest id reachable over links) of every row."""
    rows = docs.select(F.col(id).alias("id"), as_bytes(text).alias("text"), F.xxhash64(text).alias("h"))
    kind = rows.schema["id"].dataType.simpleString()
    names = keep(rows.mapInArrow(lean(_named(rules)), f"id {kind}, h long, s binary, n long"), "jaccard-names", 2)
    roots = components(_all_links(rows, names, rules)).withColumnRenamed("id", "s")
    full = names.where("n > 0")
    distinct = keep(full.groupBy("s").agg(F.min("id").alias("low")).join(roots, "s", "left"), "jaccard-distinct", 4)
    distinct = distinct.withColumn("root", F.coalesce("root", "s"))
    lowest = distinct.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = keep(distinct.join(lowest, "root").select("s", "component_id"), "jaccard-classes", 4)
    named = full.join(classes, "s").select("id", "n", "component_id").unionByName(
        names.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    )
    return named.select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")
    )
