"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. A pattern's words flow to its sources,
whose quotas are their targets. Each pass over a pattern's words is an arc of its own whose cost grows with the pass, so a
word is repeated only where no other word is left for the source. The graph has one vertex per pattern and source, however
many documents there are. A solved flow gives every pattern its number of words; all of its documents are taken the same
number of whole times, and a seeded choice of them once more.

The choice orders a pattern's documents by a seeded hash. Their sizes are summed in 2**16 slices of the hash space first, and
only the one slice that the quota ends in is ordered row by row, so a pattern with a large share of all documents does not
pass through one task.

Defined cases: a null or empty text has size zero and is taken zero times; a null source is a source of its own, the last
one; a row without any source takes part in none; rows of equal id, text and sources are taken equally often; the same
seed gives the same choice whatever the layout of the input.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiermill.llm.common import carried, keep, own, restored, WORD

SLICE_BITS = 16
WEIGHTS = (3, 1, 2)


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, share: float = 1.5, weights: tuple = WEIGHTS, most: float = 2.0) -> dict:
    """Target words of each source. Sources by code point, null last, take the weights in turn and share ``share`` times all
    words; none gets more than ``most`` times its own, and what is over goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    given = {s: 0.0 for s in order}
    open_, rest = set(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in order if s in open_)
        full = [s for s in order if s in open_ and rest * weight[s] / total >= most * sizes[s]]
        if not full:
            given.update({s: rest * weight[s] / total for s in open_})
            break
        for s in full:
            given[s] = most * sizes[s]
        rest -= sum(given[s] for s in full)
        open_ -= set(full)
    return given


class Flow:
    """Min-cost flow by shortest augmenting paths with potentials, for integer capacities."""

    def __init__(self) -> None:
        self.arcs: list[list[int]] = []  # head, capacity, cost; arc i ^ 1 is the reverse of arc i
        self.out: dict = defaultdict(list)

    def add(self, tail, head, capacity: int, cost: int) -> int:
        self.out[tail].append(len(self.arcs))
        self.arcs.append([head, capacity, cost])
        self.out[head].append(len(self.arcs))
        self.arcs.append([tail, 0, -cost])
        return len(self.arcs) - 2

    def solve(self, source, sink) -> None:
        price: dict = defaultdict(int)
        while True:
            cost, via, heap, rank = {source: 0}, {}, [(0, 0, source)], 0
            done = set()
            while heap:
                d, _, vertex = heapq.heappop(heap)
                if vertex in done:
                    continue
                done.add(vertex)
                for arc in self.out[vertex]:
                    head, capacity, own = self.arcs[arc]
                    new = d + own + price[vertex] - price[head]
                    if capacity > 0 and head not in done and new < cost.get(head, new + 1):
                        cost[head], via[head], rank = new, arc, rank + 1
                        heapq.heappush(heap, (new, rank, head))
            if sink not in done:
                return
            for vertex in list(cost):
                price[vertex] += min(cost[vertex], cost[sink])
            path, vertex = [], sink
            while vertex != source:
                path.append(via[vertex])
                vertex = self.arcs[via[vertex] ^ 1][0]
            step = min(self.arcs[a][1] for a in path)
            for arc in path:
                self.arcs[arc][1] -= step
                self.arcs[arc ^ 1][1] += step


def route(patterns: list[tuple[tuple, int]], quotas: dict, most: int = 2) -> list[int]:
    """Words to take from each pattern (its sources, its words) so that the quotas are met with the fewest repetitions.

    A source that cannot be filled gets what its patterns can give.
    """
    flow, taken = Flow(), []
    for i, (sources, words) in enumerate(patterns):
        # Convex costs: the first pass is free, the second costs 1, the third 2, and so on.
        taken.append([flow.add("start", ("pattern", i), words, cost) for cost in range(most)])
        for source in sources:
            flow.add(("pattern", i), ("source", source), most * words, 0)
    for source, quota in quotas.items():
        flow.add(("source", source), "end", int(round(quota)), 0)
    flow.solve("start", "end")
    return [sum(flow.arcs[a ^ 1][1] for a in arcs) for arcs in taken]


def mix(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    sources: Column | str = "source",
    share: float = 1.5,
    weights: tuple = WEIGHTS,
    most: int = 2,
    seed: int = 0,
) -> DataFrame:
    """``id``, ``text_hash``, ``pattern``, ``size``, ``times`` of every row, and the ``source_size`` and ``target`` of its
    first source. ``sources`` is a column with one source or an array of them. Sizes of sources count a document in each of
    its sources. The per-source and per-pattern sums reach the driver; they are as many as there are patterns."""
    column = F.col(sources) if isinstance(sources, str) else sources
    kind = docs.select(column.alias("s")).schema["s"].dataType.typeName()
    pattern = F.array_sort(F.array_distinct(column)) if kind == "array" else F.array(column)
    rows = keep(
        docs.select(
            F.col(id).alias("id"),
            F.xxhash64(text).alias("text_hash"),
            F.coalesce(pattern, F.array()).cast("array<string>").alias("pattern"),
            word_count(text).alias("size"),
        ).withColumn("draw", F.xxhash64(F.lit(seed), "id", "text_hash")),
        "mix-sizes",
    )
    slice_ = F.shiftrightunsigned("draw", 64 - SLICE_BITS)
    totals = rows.groupBy("pattern").agg(F.sum("size").alias("words")).collect()
    found = sorted(((tuple(r.pattern), r.words) for r in totals), key=lambda p: [(s is None, s or "") for s in p[0]])
    sizes: dict = defaultdict(int)
    for names, words in found:
        for name in names:
            sizes[name] += words
    quotas = targets(sizes, share, weights, most)
    routed = route(found, quotas, most)
    plan = docs.sparkSession.createDataFrame(
        [
            (list(p), w and t // w, w and t % w, sizes[p[0]] if p else 0, float(quotas[p[0]]) if p else 0.0)
            for (p, w), t in zip(found, routed)
        ],
        "pattern array<string>, whole long, rest long, source_size long, target double",
    )
    planned = keep(plan, "mix-plan", 1_000_000)
    same = rows.pattern.eqNullSafe(planned.pattern)
    # Where in the hash space does each pattern's last pass end?
    summed = rows.groupBy("pattern", slice_.alias("slice")).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("pattern").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = summed.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    ends = keep(
        before.alias("b")
        .join(planned.alias("p"), F.col("b.pattern").eqNullSafe(F.col("p.pattern")))
        .where("before < rest and before + words >= rest")
        .select(F.col("b.pattern").alias("pattern"), "slice", "before"),
        "mix-ends",
        1_000_000,
    )
    last = planned.join(ends, "pattern", "left").withColumnsRenamed({"pattern": "p", "slice": "last"})
    placed = rows.join(last, F.col("pattern") == F.col("p")).drop("p").withColumn("slice", slice_)
    # Only the rows of that slice are ordered; equal rows end together and share one decision.
    edge = F.coalesce(F.col("slice") == F.col("last"), F.lit(False))
    inside = Window.partitionBy("pattern").orderBy("draw", "id", "text_hash")
    until = F.col("before") + F.sum("size").over(inside)
    ordered = placed.where(edge).withColumn("extra", until <= F.col("rest"))
    others = placed.where(~edge).withColumn("extra", F.coalesce(F.col("slice") < F.col("last"), F.lit(False)))
    marked = keep(ordered.unionByName(others), "mix-marked")
    return chosen_columns(_filled(marked, planned))


def _filled(marked: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows with what each pattern still lacks after its last whole document filled by the one document, or set of equal rows,
    that comes nearest to it, if that is nearer than none."""
    name = ["draw", "id", "text_hash"]
    had = marked.where("extra").groupBy("pattern").agg(F.sum("size").alias("had"))
    lacks = planned.select("pattern", "rest").where("rest > 0").join(had, "pattern", "left")
    lacks = keep(lacks.select(F.col("pattern").alias("p"), (F.col("rest") - F.coalesce("had", F.lit(0))).alias("lack")), "mix-lack", 1_000_000)
    spare = marked.where(~F.col("extra") & (F.col("size") > 0)).join(lacks, F.col("pattern") == F.col("p"))
    # Equal rows are taken together; a row that has its equals is as large as all of them.
    groups = spare.groupBy("pattern", "lack", *name).agg(F.sum("size").alias("words"))
    off = F.abs(F.col("words") - F.col("lack"))
    best = groups.where(off < F.col("lack")).groupBy("pattern").agg(F.min_by(F.struct(*name), F.struct(off, *name)).alias("x"))
    best = keep(best.select(F.col("pattern").alias("p"), *[F.col(f"x.{c}").alias(f"best_{c}") for c in name]), "mix-best", 1_000_000)
    joined = marked.join(best, F.col("pattern") == F.col("p"), "left")
    same = [F.col(c).eqNullSafe(F.col(f"best_{c}")) for c in name]
    chosen = F.col("p").isNotNull() & same[0] & same[1] & same[2]
    return joined.withColumn("extra", (F.col("extra") | chosen).cast("long"))


def chosen_columns(rows: DataFrame) -> DataFrame:
    times = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(F.lit(0))
    return rows.select("id", "text_hash", "pattern", "size", "source_size", "target", times.cast("long").alias("times"))


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", sources: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns. ``sources`` holds one source a row."""
    times = (
        mix(docs, id, text, sources, **options)
        .where("times > 0")
        .select(F.col("id").alias("i"), F.col("text_hash").alias("g"), F.element_at("pattern", 1).alias("source"), "times")
        .dropDuplicates(["i", "g", "source"])
    )
    same = (
        own(id).eqNullSafe(F.col("i"))
        & own(sources).cast("string").eqNullSafe(F.col("source"))
        & (F.xxhash64(own(text)) == F.col("g"))
    )
    copies = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    return carried(docs).join(times, same).select("row", copies.alias("copy")).select(*restored(docs.columns))
