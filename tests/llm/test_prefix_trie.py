import hashlib
import random
import zlib

import numpy as np
import pytest
from compare import connect, difference

from tiermill.llm import prefix_trie
from tiermill.llm.queries import CHECKS, op12_prefix_trie

DRAW = random.Random(17)
SCHEMA = "conv_id long, turn long, role string, text string, depth string, n int"


def brute(rows, family=5, shared=9):
    """Every prefix of every path in a dictionary."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(t[3], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    nodes = {}
    for conv, turns in own.items():
        if shared:
            h = zlib.crc32(str(conv).encode()) % shared
            base = int(conv - np.fmod(conv, family))
            turns = own.get(base, [])[:h] + turns[h:]
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append((conv, d == len(turns)))
    children = {}
    for node in nodes:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []
    for node, members in nodes.items():
        leaves = saved = 0
        open_ = [node]
        while open_:
            n = open_.pop()
            leaves += n not in children
            saved += (len(nodes[n]) - 1) * len(n[-1][1].encode()) if n else 0
            open_ += children.get(n, [])
        ends = ",".join(str(c) for c in sorted(c for c, ends in members if ends))
        parent = min(nodes[node[:-1]])[0] if node else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members)[0], len(node), parent, len(members), len(children.get(node, [])), leaves, saved, sha))
    return sorted(out, key=repr)


def rows_of(frame):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def drawn(count, kinds, longest=6):
    out = []
    for conv in range(-7, count):
        for turn in range(DRAW.randrange(1, longest)):
            out.append((conv, turn, DRAW.choice(["user", "assistant"]), f"é{DRAW.randrange(kinds)}", "x", 1))
    return out


@pytest.mark.parametrize("kinds", [1, 2, 50])
def test_against_every_prefix(spark, kinds):
    """Few kinds of turns make many copies and paths that end inside others."""
    rows = drawn(150, kinds)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert rows_of(prefix_trie.trie(prefix_trie.paths(frame, family=5, shared=9))) == brute(rows)
            assert rows_of(prefix_trie.trie(prefix_trie.paths(frame))) == brute(rows, shared=0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_closing_parentheses():
    for length in (1, 2, 33, 700, 5000):
        for bias in (0.5, 0.9):
            bits, depth, opened = [], 0, 0
            while opened < length or depth:
                down = depth > 1 and DRAW.random() > bias or opened >= length
                bits.append(not down)
                opened, depth = opened + (not down), depth + (1 if not down else -1)
            stack, want = [], {}
            for i, b in enumerate(bits):
                if b:
                    stack.append(i)
                else:
                    want[stack.pop()] = i
            excess = prefix_trie.Excess(np.array(bits))
            places = np.flatnonzero(bits)
            assert excess.find_close(places).tolist() == [want[p] for p in places.tolist()]
            assert excess.leaf_pairs().tolist() == [b and i + 1 < len(bits) and not bits[i + 1] for i, b in enumerate(bits)]


def test_many_ids_of_one_path(spark, monkeypatch):
    """The ids of a hot path are hashed over several partitions and pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    rows = [(c, 0, "user", "same" if c % 3 else f"own {c % 30}", "x", 1) for c in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(prefix_trie.trie(prefix_trie.paths(frame))) == brute(rows, shared=0)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None, "x", 1), (1, 3, "user", "", "x", 1), (1, 3, "", "user", "x", 1), (1, 3, "user", "", "x", 1),
        (None, 1, "user", "lost", "x", 1), (5, 1, "user", "z" * 100_000, "x", 1), (6, 2, None, "z", "x", 1), (7, 0, "", "", "x", 1),
        (8, 0, "u", "z" * 100_000, "x", 1), (-4, 0, "u", "t", "x", 1), (2, 0, None, None, "x", 1),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(prefix_trie.trie(prefix_trie.paths(frame, family=5, shared=9))) == brute(rows)
    assert prefix_trie.trie(prefix_trie.paths(frame.where("false"))).collect() == []


def test_long_conversation(spark):
    rows = [(1, t, "user", str(t), "x", 1) for t in range(3000)] + [(2, t, "user", str(t), "x", 1) for t in range(2000)]
    got = rows_of(prefix_trie.trie(prefix_trie.paths(spark.createDataFrame(rows, SCHEMA))))
    assert len(got) == 3001 and sum(r[3] == 2 for r in got) == 2001


def test_query_matches_sql(spark, folder):
    assert difference(op12_prefix_trie(spark, folder), connect(folder), CHECKS["op12_prefix_trie"]) == ""
