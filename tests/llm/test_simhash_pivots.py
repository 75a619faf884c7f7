import re

import numpy as np
import pandas as pd
import xxhash

from tiermill.llm.queries import op5_simhash_pivots
from tiermill.llm.simhash_pivots import fingerprint, links, near_duplicates


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints):
    """Components of all values within 4 bits, by comparing all of them."""
    values = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    label = np.arange(len(values))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_whole_table_against_all_pairs(spark, folder, texts):
    got = op5_simhash_pivots(spark, folder).toPandas().sort_values("doc_id")
    docs = texts.toPandas().sort_values("doc_id")
    prints = [plain(t) for t in docs["text"]]
    assert got["fingerprint"].tolist() == [f"{p:016x}" for p in prints]
    assert got["component_id"].tolist() == docs["doc_id"].to_numpy()[roots(prints)].tolist()


def test_dense_and_chained_groups(spark):
    draw = np.random.default_rng(5)
    center = int(draw.integers(0, 2**63))
    flips = lambda n: sum(1 << int(b) for b in draw.choice(64, n, replace=False))
    values = {center ^ flips(int(draw.integers(0, 9))) for _ in range(700)} | {int(x) for x in draw.integers(0, 2**63, 300)}
    chain = int(draw.integers(0, 2**63))
    for _ in range(40):
        chain ^= flips(4)
        values.add(chain)
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64)
    found = links(spark.createDataFrame(pd.DataFrame({"fp": signed}))).toPandas()
    assert (np.bitwise_count(found["u"].to_numpy().view(np.uint64) ^ found["v"].to_numpy().view(np.uint64)) <= 4).all()
    place = {v: i for i, v in enumerate(signed.tolist())}
    parent = list(range(len(values)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in zip(found["u"], found["v"]):
        a, b = top(place[u]), top(place[v])
        parent[max(a, b)] = min(a, b)
    assert [top(i) for i in range(len(values))] == roots(values).tolist()


def test_odd_rows(odd, none):
    rows = [tuple(r) for r in near_duplicates(odd).collect()]
    assert len(rows) == odd.count()
    by = {r[0]: r for r in rows}
    assert by[1][1:] == by[2][1:] == by[3][1:] == ("0" * 16, 1)
    assert by[4][2] == 4 and by[None][1] == by[4][1] and by[None][2] is None
    assert near_duplicates(none).collect() == []
    assert fingerprint(b"A b  C") == plain("a b c") == xxhash.xxh64_intdigest(b"a b c", 42)
