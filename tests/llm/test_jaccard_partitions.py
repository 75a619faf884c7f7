import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tiermill.llm import jaccard_partitions as jp
from tiermill.llm.queries import op13_jaccard_partitions

DRAW = random.Random(23)


def shingles(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows):
    """Components over all pairs of rows (id, text)."""
    sets = [shingles(t) for _, t in rows]
    classes = {}
    for i, s in enumerate(sets):
        classes.setdefault(s, []).append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for s, members in classes.items():
        if s:
            for i in members[1:]:
                root[find(i)] = find(members[0])
    for x, y in itertools.combinations([s for s in classes if s], 2):
        if 10 * min(len(x), len(y)) >= 9 * max(len(x), len(y)) and 100 * len(x & y) >= 90 * len(x | y):
            root[find(classes[y][0])] = find(classes[x][0])
    lowest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            lowest[find(i)] = min(lowest.get(find(i), key), key)
    out = [(k, len(s), None if k is None else k if not s else lowest[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))]
    return sorted(out, key=repr)


def got(frame, rules=jp.Rules()):
    rows = jp.near_duplicates(frame, rules=rules).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def prose(count, kinds=10**6):
    return [f"w{DRAW.randrange(kinds)}" for _ in range(count)]


def edited(words, edits):
    words = list(words)
    for _ in range(edits):
        i = DRAW.randrange(len(words))
        kind = DRAW.randrange(3)
        if kind == 0:
            words[i] = f"e{DRAW.randrange(10**6)}"
        elif kind == 1:
            words.insert(i, f"e{DRAW.randrange(10**6)}")
        elif len(words) > 1:
            del words[i]
    return words


def corpus():
    """Near copies at about the threshold in all sizes, chains of copies, copies, and texts with common parts."""
    texts = []
    for size in (1, 2, 3, 4, 9, 10, 11, 12, 15, 19, 20, 21, 30, 45, 70, 120, 250, 600):
        for _ in range(3):
            base = prose(size)
            texts.append(base)
            for _ in range(4):
                texts.append(edited(base, DRAW.randrange(0, max(2, size // 25))))
            chain = base
            for _ in range(3):
                chain = edited(chain, max(1, size // 60))
                texts.append(chain)
    common = prose(40)
    texts += [common + prose(DRAW.randrange(1, 8)) for _ in range(60)]
    texts += [prose(3, 3) + prose(8, 2) for _ in range(40)]
    DRAW.shuffle(texts)
    return list(enumerate(" ".join(t) for t in texts))


@pytest.fixture(scope="module")
def small():
    rows = corpus()
    return rows, brute(rows)


@pytest.mark.parametrize("limit", [32, 2, 1])
def test_against_all_pairs(spark, small, limit):
    """Small limits make most open buckets large ones, so thresholds are allocated anew."""
    rows, want = small
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(frame, jp.Rules(small=limit)) == want


def test_template_pages(spark):
    """Many pages of one template that are almost, but mostly not, linked: all their segments are large open buckets."""
    template = prose(110)
    rows = []
    for i in range(120):
        words = list(template)
        for j in DRAW.sample(range(0, 110, 4), DRAW.randrange(1, 5)):
            words[j] = f"own{DRAW.randrange(6)}_{j}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert got(frame) == want and got(frame, jp.Rules(small=3)) == want


def test_bounds_hold_for_all_sizes():
    for percent in (90, 80, 95):
        starts, segments = jp.bands(percent, 3000)
        for a in range(1, 2000, 7):
            for b in {a, a * 100 // percent}:
                common = -(-percent * (a + b) // (100 + percent))
                assert a + b - 2 * common <= jp.differing(a, b, percent)
                low, high = dict(jp.schemes(a, percent)), dict(jp.schemes(b, percent))
                own = int(np.searchsorted(starts, a, "right")) - 1
                if segments[own] > 1:
                    assert low[own] == high[own] == segments[own] > jp.differing(a, b, percent)
                else:
                    assert jp.differing(a, b, percent) == 0


def test_segments_and_deletions():
    set_ = np.unique(np.array([DRAW.randrange(2**63) for _ in range(60)], np.uint64))
    place, sums = jp.subsets(set_, 4, 7)
    for i in (0, 13, 59):
        other_place, other = jp.subsets(np.delete(set_, i), 4, 7)
        changed = np.flatnonzero(other != sums)
        assert changed.tolist() == [place[i]] and other[place[i]] == sums[place[i]] - jp.mixed(set_[i : i + 1] * jp.B + jp.A)[0]
    x = np.unpackbits(np.frombuffer(jp.sketch(set_), np.uint8))
    assert (x != np.unpackbits(np.frombuffer(jp.sketch(set_[3:]), np.uint8))).sum() <= 3


def test_allocation_keeps_the_sum():
    for _ in range(200):
        costs = {i: DRAW.randrange(1, 60) for i in range(DRAW.randrange(1, 12))}
        large = {i: DRAW.randrange(33, 90) for i in costs if DRAW.random() < 0.5}
        found = jp.allocate(costs, large)
        assert sum(t + 1 for t in found.values()) == len(costs)
        assert all(t < 1 for i, t in found.items() if i in large) and all(t > -1 for i, t in found.items() if i not in large)


def test_sets_are_those_of_the_words():
    for text in ("", " \n", "A b", "a B c", "x y z x y z x", "É é İ A\x0bb\x0cC\xa0d", " ".join(prose(50, 5))):
        assert len(jp.element_sets(pa.array([text.encode()]), 3)[0]) == len(shingles(text))
    same = [jp.name_of(s) for s in jp.element_sets(pa.array([b"a b  C", b"A B\nc ", b"a b", b"a b c d"]), 3)]
    assert same[0] == same[1] and len(set(same)) == 3


def test_odd_rows(spark, odd, none):
    assert jp.near_duplicates(none).collect() == []
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    clash = odd.selectExpr("*", "1 AS s", "2 AS id", "3 AS n", "4 AS h", "5 AS component_id")
    assert got(clash) == got(odd)


def test_query(spark, folder, texts):
    rows = op13_jaccard_partitions(spark, folder)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows.collect()), key=repr) == brute(
        [(r.doc_id, r.text) for r in texts.collect()]
    )
