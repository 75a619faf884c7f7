import itertools
import random

import numpy as np

from tiermill.llm import passage_chains
from tiermill.llm.passage_chains import Rules, chains, passages, without_passages, without_words

DRAW = random.Random(11)


def prose(count):
    return [f"{DRAW.choice('abcdefghij')}{DRAW.randrange(10**6)}" for _ in range(count)]


def planted():
    """Documents with an exact passage, an edited one, one in pieces, one too short, and a passage that many share."""
    exact, edited, short, common = prose(60), prose(120), prose(40), prose(80)
    docs = {i: prose(200) for i in range(60)}
    docs[3][50:50] = exact
    docs[7][:0] = exact
    docs[11] += edited
    changed = list(edited)
    changed[30] = "changed"
    del changed[60]
    changed[90:90] = ["put", "in"]
    docs[12][100:100] = changed
    docs[13] += short
    docs[14][:0] = short
    for i in range(20, 60):
        docs[i][i:i] = common
    docs[60] = docs[0]
    return {i: " ".join(w) for i, w in docs.items()}


def test_planted_passages(spark):
    texts = planted()
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = passages(rows, rules=Rules(buffer=3000)).collect()
    pairs = {frozenset((r.doc_id, r.partner)) for r in got}
    assert frozenset((3, 7)) in pairs and frozenset((11, 12)) in pairs and frozenset((0, 60)) in pairs
    touched = set().union(*pairs)
    assert touched == {0, 3, 7, 11, 12, 60, *range(20, 60)}
    # All but one of the documents with the common passage are linked to another, with at most a few links each.
    linked = [r for r in got if r.doc_id in range(20, 60)]
    assert len({r.doc_id for r in linked}) == 39 and len(linked) <= 4 * 39
    for r in got:
        a, b = (texts[r.doc_id].split()[r.start : r.stop], texts[r.partner].split()[r.other_start : r.other_stop])
        assert len(a) >= 50 and a[0] == b[0] and a[-1] == b[-1] and r.equal >= 0.8 * r.columns
        if {r.doc_id, r.partner} == {3, 7}:
            assert len(a) == 60
        if {r.doc_id, r.partner} == {11, 12}:
            assert sorted((len(a), len(b))) == [120, 121] and (r.equal, r.columns) == (118, 122)


def test_cutting_keeps_the_first(spark):
    texts = planted()
    rows = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, row int")
    left = {r.doc_id: r.text.split() for r in without_passages(rows).collect()}
    total = sum(len(t.split()) for t in texts.values())
    assert set(texts) - set(left) in ({0}, {60})
    assert sum(map(len, left.values())) == total - 200 - 60 - 39 * 80 - (120 if len(left[12]) == 321 else 121)
    assert left[13] == texts[13].split() and left[14] == texts[14].split()


def best_by_trying(pos, other, size, cost):
    found = 0.0
    for n in range(1, len(pos) + 1):
        for chain in itertools.combinations(range(len(pos)), n):
            ok = all(
                pos[a] + size[a] <= pos[b] and other[a] + size[a] <= other[b] for a, b in zip(chain, chain[1:])
            )
            if ok:
                gaps = sum(pos[b] - pos[a] - size[a] + other[b] - other[a] - size[a] for a, b in zip(chain, chain[1:]))
                found = max(found, sum(size[i] for i in chain) - cost * gaps)
    return found


def test_best_chain_against_all_chains():
    for _ in range(200):
        n = DRAW.randrange(1, 9)
        anchors = sorted((DRAW.randrange(60), DRAW.randrange(60), DRAW.randrange(1, 15)) for _ in range(n))
        pos, other, size = map(list, zip(*anchors))
        got = chains(pos, other, size, 0.2)
        assert sorted(i for c in got for i in c) == list(range(n))
        c = got[0]
        gaps = sum(pos[b] - pos[a] - size[a] + other[b] - other[a] - size[a] for a, b in zip(c, c[1:]))
        assert abs(sum(size[i] for i in c) - 0.2 * gaps - best_by_trying(pos, other, size, 0.2)) < 1e-9


def test_odd_rows(spark, odd, none):
    assert passages(none).collect() == [] and without_passages(none).collect() == []
    assert {r.doc_id for r in passages(odd, rules=Rules(least_seeded=8, min_words=12)).collect()} <= {None, 4}
    left = without_passages(odd).collect()
    assert len(left) == odd.count() and sorted(map(repr, left)) == sorted(map(repr, odd.collect()))
    same = spark.createDataFrame([(1, " ".join(prose(70)))] * 3, "doc_id long, text string")
    assert without_passages(same).count() == 3


def test_cut_of_words():
    assert without_words("  a b\n\nc  d e ", [(1, 3)]) == "  a d e "
    assert without_words("a b c", [(0, 3)]) == "" and without_words("a b c", [(0, 2), (1, 2)]) == "c"


def test_chain_through_unlike_text_is_cut(spark):
    """Two exact passages with unlike text between them stay two; sparse matches around one do not hide it."""
    core, tail = prose(110), [prose(12) for _ in range(6)]
    left, right = prose(40), prose(40)
    a = core + left + [w for t in tail for w in t + prose(22)]
    b = core + right + [w for t in tail for w in t + prose(22)]
    rows = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    got = passages(rows).collect()
    assert [(r.doc_id, r.partner, r.start, r.stop, r.equal, r.columns) for r in got] == [(2, 1, 0, 110, 110, 110)]


def test_passage_whose_halves_stand_elsewhere(spark):
    """Neither the nearer nor the first documents with its halves hide the document with the whole passage."""
    around = lambda words: " ".join(prose(40) + words + prose(40))
    texts, wanted = [], set()
    for _ in range(12):
        left, right = prose(30), prose(30)
        parts = (left, right, left + right, left, right, left + right)
        texts += [around(words) for words in parts]
        wanted.add((len(texts) - 1, len(texts) - 4, 40, 100))
    # All in one buffer, one document a buffer, several partitions, several buffers.
    for parts, buffer in ((1, 700_000), (1, 1), (6, 700_000), (1, 120)):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).repartitionByRange(parts, "doc_id")
        got = {(r.doc_id, r.partner, r.start, r.stop) for r in passages(rows, rules=Rules(buffer=buffer)).collect()}
        assert got == wanted


def edits(passage, kind):
    """Every ``kind``-th word, or that part of all words, replaced, removed or followed by another."""
    count = len(passage)
    places = set(range(DRAW.randrange(kind), count, kind) if kind > 1 else DRAW.sample(range(count), round(count * kind)))
    out = []
    for i, w in enumerate(passage):
        what = DRAW.randrange(3) if i in places else 3
        out += [[f"edit{DRAW.randrange(10**9)}"], [], [w, f"more{DRAW.randrange(10**9)}"], [w]][what]
    return out


def test_recall_of_edited_passages(spark):
    """Passages of 60 words, edited at every 7th to 10th word or at random 5 and 10 percent of them, and exact ones of 50."""
    texts, kinds = [], []
    for kind in (7, 8, 9, 10, 0.05, 0.1, 0):
        for _ in range(20):
            passage = prose(60 if kind else 50)
            texts += [" ".join(prose(40) + words + prose(40)) for words in (passage, edits(passage, kind) if kind else passage)]
            kinds.append(kind)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.partner) for r in passages(rows).collect()}
    assert got <= {(2 * i + 1, 2 * i) for i in range(len(kinds))}
    for kind in sorted(set(kinds)):
        own = [i for i, k in enumerate(kinds) if k == kind]
        found = sum((2 * i + 1, 2 * i) in got for i in own) / len(own)
        assert found >= 0.9, (kind, found)


def test_the_smallest_id_keeps_the_passage(spark):
    """Whatever the order of the rows; ids may be of any type that has an order."""
    passage = prose(70)
    texts = {i: " ".join(prose(30) + passage + prose(30)) for i in (7, 3, 5, 2, 9)}
    for kind, of in (("long", int), ("string", str)):
        for parts in (1, 5):
            rows = spark.createDataFrame([(of(i), t, 1, 2) for i, t in texts.items()], f"doc_id {kind}, text string, spans int, row int")
            left = {int(r.doc_id): len(r.text.split()) for r in without_passages(rows.repartition(parts, "text")).collect()}
            assert left == {2: 130, 3: 60, 5: 60, 7: 60, 9: 60}


def test_end_goes_on_over_edits():
    rules = Rules()
    a = np.arange(300)
    b = np.concatenate((a[:40], [1000], a[41:100], a[103:160], [2000, 2001], a[160:200], np.arange(5000, 5100)))
    assert passage_chains._extend(a, b, rules)[:3] == (200, 199, 196)
    assert passage_chains._extend(a[:60], np.arange(900, 1000), rules) == (0, 0, 0, 0)
    for _ in range(50):
        x, y = (np.array([DRAW.randrange(4) for _ in range(DRAW.randrange(1, 12))]) for _ in range(2))
        want = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                want[i + 1][j + 1] = want[i][j] + 1 if x[i] == y[j] else max(want[i][j + 1], want[i + 1][j])
        assert passage_chains.common_prefixes(x, y).tolist() == want


def test_pairs_are_of_one_document_and_apart():
    rules = Rules()
    doc = np.repeat([0, 1, 2], [300, 20, 200])
    place, seed = passage_chains.minimizers(np.array([DRAW.randrange(2**60) for _ in doc], np.uint64), doc, rules.k, rules.window)
    has, key, gap = passage_chains.paired(place, seed, doc[place], rules)
    assert len(set(key.tolist())) == len(key) and set(doc[place][has].tolist()) == {0, 2}
    assert ((gap >= rules.near) & (gap <= rules.far)).all()
    assert (doc[place[has] + gap] == doc[place[has]]).all()
