"""Prefix trie of conversations in balanced parentheses, built shard by shard.

A conversation's path is the row of its turns' digests (of role and text). Equal paths are counted first; each distinct one is
carried once, by its smallest id. Paths are range-partitioned, so a shard is a run of the trie in depth-first order: an opening
parenthesis for each new node, closing ones on the way back. Blocks of the excess (opened minus closed) keep their minimum, and a
tree of minima over the blocks finds the closing parenthesis of every node. Between the two lies the subtree: the rank of the
leaf pairs "()" counts its leaves, differences of cumulative arrays give its members and savings.

Only nodes on a shard's first and last path can reach into other shards. A shard knows the last path before it and the first
one after it, so it knows which of its nodes do. A node's children, and its text where that counts once, belong to the first
shard that has it, its leaf pair to the last one; then the shards' numbers for one node just add up, and these shared spines
are the only nodes that are grouped.

The ids that end at a node are hashed in their order, without being collected: range-partitioned by path and id, hashed as they
stream by, and where a path's ids go on in another partition their text is handed on in pieces.

Defined cases: a null role or text counts as empty; turns of a conversation follow by turn (null first), equal ones by their
digest; rows without a conversation id are left out; repeated rows are turns of their own; an empty table gives no rows, not
even a root; other columns are ignored. Very long texts are only digested. A conversation takes 24 bytes a turn in the task
that lines it up. Digests are of 128 bits.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiermill.llm.common import keep, tasks

TURN = 16
BLOCK = 64
#: Bytes of a piece of id text, and of the paths in one batch.
PIECE, BATCH = 1 << 20, 1 << 22
NOBODY = hashlib.sha256(b"").hexdigest()


class Excess:
    """Balanced parentheses with the smallest excess of each block and a tree of these minima."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1)).astype(np.int64)
        blocks = max(1, -(-len(bits) // BLOCK))
        width = 1 << (blocks - 1).bit_length()
        high = np.iinfo(np.int64).max
        padded = np.full(width * BLOCK, high)
        padded[: len(bits)] = self.excess
        self.padded = padded
        self.tree = np.full(2 * width, high)
        self.tree[width:] = padded.reshape(width, BLOCK).min(axis=1)
        level = width
        while level > 1:
            self.tree[level // 2 : level] = self.tree[level : 2 * level].reshape(-1, 2).min(axis=1)
            level //= 2
        self.leaves = width

    def find_close(self, opened: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the first place after it with a smaller excess."""
        wanted = self.excess[opened] - 1
        found = np.full(len(opened), -1, np.int64)

        def scan(which: np.ndarray, start: np.ndarray) -> np.ndarray:
            """Look through the rest of a block; what is still not found."""
            at, end = start.copy(), (start // BLOCK + 1) * BLOCK
            while len(which):
                hit = self.padded[at] == wanted[which]
                found[which[hit]] = at[hit]
                at, end, which = at[~hit] + 1, end[~hit], which[~hit]
                out = at >= end
                left.append(which[out])
                at, end, which = at[~out], end[~out], which[~out]

        left: list[np.ndarray] = []
        inside = (opened + 1) % BLOCK != 0
        scan(np.flatnonzero(inside), opened[inside] + 1)
        which = np.concatenate([*left, np.flatnonzero(~inside)])
        # Up to the first right neighbour whose minimum is small enough, then down to its first such block.
        node = opened[which] // BLOCK + self.leaves
        active = np.arange(len(which))
        while len(active):
            at = node[active]
            good = (at % 2 == 0) & (self.tree[np.minimum(at + 1, 2 * self.leaves - 1)] <= wanted[which[active]])
            node[active] = np.where(good, at + 1, at // 2)
            active = active[~good]
        while (deeper := node < self.leaves).any():
            child = np.where(deeper, 2 * node, node)
            node = np.where(deeper & (self.tree[child] > wanted[which]), child + 1, child)
        left.clear()
        scan(which, (node - self.leaves) * BLOCK)
        return found

    def leaf_pairs(self) -> np.ndarray:
        """Whether a leaf pair begins at each place."""
        pairs = self.bits.copy()
        pairs[:-1] &= ~self.bits[1:]
        pairs[-1:] = False
        return pairs


# Paths


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv``, ``turn``, ``digest`` (of role and text) and ``size`` (UTF-8 bytes of the text)."""
    role, words = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, words).cast("binary"))
    return conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.unhex(digest).alias("digest"),
        F.octet_length(words).cast("long").alias("size"),
    )


PATHS = "conv long, path binary, sizes binary"


def _lined_up(shared: int):
    """Paths of the conversations of each family (rows sorted by family, the first member before the others, and turn). With
    ``shared``, the first CRC-32(id) % ``shared`` turns of a conversation are those of its family's first member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple = (None, b"", b"")
        now: tuple | None = None
        path, sizes = bytearray(), bytearray()
        out: list[tuple] = []
        waiting = 0

        def done() -> None:
            nonlocal head, waiting
            family, conv = now
            own, lengths = bytes(path), bytes(sizes)
            if shared:
                if conv == family:
                    head = (family, own[: TURN * shared], lengths[: 8 * shared])
                else:
                    count = zlib.crc32(str(conv).encode()) % shared
                    first = head if head[0] == family else (family, b"", b"")
                    own = first[1][: TURN * count] + own[TURN * count :]
                    lengths = first[2][: 8 * count] + lengths[8 * count :]
            out.append((conv, own, lengths))
            waiting += len(own) + 32

        def batch_of() -> pa.RecordBatch:
            nonlocal waiting
            waiting = 0
            columns = list(zip(*out)) or [[], [], []]
            out.clear()
            kinds = [pa.int64(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["conv", "path", "sizes"])

        for batch in batches:
            if not batch.num_rows:
                continue
            family, conv, size = (batch.column(i).to_numpy() for i in (0, 1, 3))
            digests = batch.column(2).to_pylist()
            cuts = np.flatnonzero((conv[1:] != conv[:-1]) | (family[1:] != family[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(conv)]):
                if (key := (int(family[a]), int(conv[a]))) != now:
                    if now is not None:
                        done()
                        path.clear()
                        sizes.clear()
                    now = key
                path += b"".join(digests[a:b])
                sizes += size[a:b].astype("<i8").tobytes()
            if waiting > BATCH:
                yield batch_of()
        if now is not None:
            done()
            yield batch_of()

    return run


def paths(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    family: int = 1,
    shared: int = 0,
) -> DataFrame:
    """``conv``, ``path`` and ``sizes`` of every conversation. A family is the ids from one multiple of ``family`` to before the
    next, away from zero; see ``_lined_up`` for ``shared``."""
    rows = _turns(conversations, conv, turn, role, text)
    first = F.col("conv") - F.col("conv") % F.lit(family)
    return (
        rows.select(first.alias("family"), "conv", "digest", "size", "turn")
        .repartition(tasks(conversations.sparkSession), "family")
        .sortWithinPartitions("family", F.col("conv") != F.col("family"), "conv", F.col("turn").asc_nulls_first(), "digest")
        .select("family", "conv", "digest", "size")
        .mapInArrow(_lined_up(shared), PATHS)
    )


# Ids that end at a node


ENDS = "key binary, first long, n long, sha string, piece binary"


def _record(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(names)
    rows.clear()
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


ENDS_KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
ENDS_NAMES = [x.split()[0] for x in ENDS.split(", ")]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows sorted by key and id: the first id, the number and the hash of each key's ids. A partition's first and last
    key may go on in others, and a long one would fill the task; of these the ids' text is handed on in pieces."""
    out: list[tuple] = []
    words: list[bytes] = []
    key, first, size, handed = None, 0, 0, True

    def close(hand_on: bool) -> None:
        if words:
            joined = b",".join(words)
            sha, piece = (None, joined) if hand_on else (hashlib.sha256(joined).hexdigest(), None)
            out.append((key, first, len(words), sha, piece))
            words.clear()

    for batch in batches:
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if key is not None:
                    close(handed)
                    handed = False
                key, size = k, 0
            if not words:
                first = i
            words.append(b"%d" % i)
            size += len(words[-1]) + 1
            if size > PIECE:
                handed, size = True, 0
                close(True)
        if len(out) > 4096:
            yield _record(out, ENDS_KINDS, ENDS_NAMES)
    close(True)
    yield _record(out, ENDS_KINDS, ENDS_NAMES)


def _pieced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each key (rows sorted by key and first id) hashed as one text."""
    out: list[tuple] = []
    key, first, n, state = None, 0, 0, hashlib.sha256()
    for batch in batches:
        for k, i, count, piece in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4))):
            if k != key:
                if key is not None:
                    out.append((key, first, n, state.hexdigest(), None))
                key, first, n, state = k, i, 0, hashlib.sha256()
            else:
                state.update(b",")
            n += count
            state.update(piece)
    if key is not None:
        out.append((key, first, n, state.hexdigest(), None))
    yield _record(out, ENDS_KINDS, ENDS_NAMES)


def endings(lined: DataFrame) -> DataFrame:
    """For each distinct path: ``first`` (the smallest of its ids), ``n`` (their number), ``sha`` (of them all)."""
    n = tasks(lined.sparkSession)
    ids = lined.select(F.unhex(F.md5("path")).alias("key"), "conv")
    # One row for each id, all different: evenly spread ranges, however many ids have one path.
    parts = keep(
        ids.repartitionByRange(n, "key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_hashed, ENDS), "trie-ends", 4
    )
    pieces = parts.where("sha IS NULL").repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(_pieced, ENDS)
    return parts.where("sha IS NOT NULL").unionByName(pieces).drop("piece", "key")


# Shards


NODES = (
    "key binary, parent_key binary, depth long, low long, parent long, n_convs long, n_children long, n_leaves long, "
    "saved long, sha string"
)
NODE_NAMES = [x.split()[0] for x in NODES.split(", ")]
NODE_KINDS = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]


def _shared_turns(a: bytes | None, b: bytes | None) -> int:
    """Leading turns that two paths have in common."""
    if a is None or b is None:
        return 0
    count = min(len(a), len(b)) // TURN
    x, y = (np.frombuffer(p[: TURN * count], "<u8").reshape(-1, 2) for p in (a, b))
    unlike = np.flatnonzero((x != y).any(axis=1))
    return int(unlike[0]) if len(unlike) else count


def _spine(path: bytes, depth: int) -> list[bytes]:
    """Keys of the first nodes of a path, from the root on."""
    state = hashlib.md5()
    found = [state.digest()]
    for d in range(depth):
        state.update(path[TURN * d : TURN * (d + 1)])
        found.append(state.copy().digest())
    return found


def shard_nodes(
    paths: list[bytes], sizes: list[bytes], counts: list[int], lows: list[int], shas: list[str], before: bytes | None, after: bytes | None
) -> pa.RecordBatch:
    """Nodes of a shard (distinct paths in order) with its part of their numbers. Nodes that may be in other shards, too, have
    a key; the others' numbers are whole."""
    depth, size, parent = [0], [0], [-1]
    ends = np.zeros(len(paths), np.int64)
    stack, last = [0], b""
    for i, path in enumerate(paths):
        common = _shared_turns(last, path)
        del stack[common + 1 :]
        lengths = np.frombuffer(sizes[i], "<i8")
        for d in range(common, len(path) // TURN):
            parent.append(stack[-1])
            stack.append(len(depth))
            depth.append(d + 1)
            size.append(int(lengths[d]))
        ends[i] = stack[-1]
        last = path
    number = len(depth)
    depths, up, text = np.array(depth), np.array(parent), np.array(size)
    at = 2 * np.arange(number) - depths
    bits = np.zeros(2 * number, bool)
    bits[at] = True
    excess = Excess(bits)
    close = excess.find_close(at)
    stop = np.arange(number) + (close - at + 1) // 2

    left, right = _shared_turns(before, paths[0]), _shared_turns(paths[-1], after)
    first = np.ones(number, bool)
    if before is not None:
        first[: left + 1] = False
    keys: list[bytes | None] = [None] * number
    # The root is in every shard; the first path's nodes are the first ones in order, the last path's are on the stack.
    keys[: left + 1] = _spine(paths[0], left)
    for node, key in zip(stack, _spine(paths[-1], right)):
        keys[node] = key
    pairs = excess.leaf_pairs()
    if after is not None:
        pairs[at[stack[: right + 1]]] = False

    members = np.zeros(number, np.int64)
    members[ends] = counts
    total = np.concatenate(([0], np.cumsum(members)))
    n_convs = total[stop] - total[:number]
    total = np.concatenate(([0], np.cumsum((n_convs - first) * text)))
    saved = total[stop] - total[:number]
    rank = np.concatenate(([0], np.cumsum(pairs)))
    n_leaves = rank[close] - rank[at]
    n_children = np.bincount(up[1:], weights=first[1:], minlength=number).astype(np.int64)
    low = np.full(number, np.iinfo(np.int64).max)
    low[ends] = lows
    lowest = low.tolist()
    for node in range(number - 1, 0, -1):
        if lowest[node] < lowest[parent[node]]:
            lowest[parent[node]] = lowest[node]
    sha: list[str | None] = [None] * number
    for node, value in zip(ends.tolist(), shas):
        sha[node] = value
    parent_keys = [None if p < 0 else keys[p] for p in parent]
    parents = [None if p < 0 or keys[p] is not None else lowest[p] for p in parent]
    columns = [keys, parent_keys, depths, lowest, parents, n_convs, n_children, n_leaves, saved, sha]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, NODE_KINDS)], names=NODE_NAMES)


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each shard; its rows are sorted by shard, kind (the path before, the one after, its own) and path."""
    shard, around, held = None, {}, ([], [], [], [], [])

    def done() -> Iterator[pa.RecordBatch]:
        if held[0]:
            made = shard_nodes(*held, around.get(0), around.get(1))
            for start in range(0, made.num_rows, 10_000):
                yield made.slice(start, 10_000)
        around.clear()
        for column in held:
            column.clear()

    for batch in batches:
        for of, kind, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if of != shard:
                yield from done()
                shard = of
            if kind < 2:
                around[kind] = row[0]
            else:
                for column, value in zip(held, row):
                    column.append(value)
    yield from done()


def trie(lined: DataFrame) -> DataFrame:
    """Nodes of the trie of ``paths``: ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (bytes that sharing saves in the subtree) and ``ends_sha256``."""
    n = tasks(lined.sparkSession)
    ends = endings(lined)
    distinct = keep(lined.join(ends, F.col("conv") == F.col("first")).drop("conv"), "trie-paths", 2)
    shards = keep(distinct.repartitionByRange(n, "path").withColumn("shard", F.spark_partition_id()), "trie-shards")
    # One row a shard.
    along = Window.orderBy("shard")
    bounds = shards.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    bounds = bounds.select("shard", F.lag("high").over(along).alias("before"), F.lead("low").over(along).alias("after"))
    neighbours = bounds.select(
        "shard", F.posexplode(F.array("before", "after")).alias("kind", "path")
    ).where("path IS NOT NULL")
    own = shards.select("shard", F.lit(2).alias("kind"), "path", "sizes", "n", "first", "sha")
    parts = keep(
        own.unionByName(neighbours, allowMissingColumns=True)
        .repartition(n, "shard")
        .sortWithinPartitions("shard", "kind", "path")
        .mapInArrow(_built, NODES),
        "trie-nodes",
        2,
    )
    spine = keep(
        parts.where("key IS NOT NULL")
        .groupBy("key")
        .agg(
            F.max("parent_key").alias("parent_key"),
            F.max("depth").alias("depth"),
            F.min("low").alias("low"),
            F.lit(None).cast("long").alias("parent"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
            F.max("sha").alias("sha"),
        ),
        "trie-spine",
        16,
    )
    every = parts.where("key IS NULL").unionByName(spine).drop("key")
    above = spine.select(F.col("key").alias("parent_key"), F.col("low").alias("above"))
    joined = every.where("parent_key IS NOT NULL").join(above, "parent_key").withColumn("parent", F.col("above")).drop("above")
    return every.where("parent_key IS NULL").unionByName(joined).select(
        F.col("low").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(NOBODY)).alias("ends_sha256"),
    )
