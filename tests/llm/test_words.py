import random
import re

import pyarrow as pa

from tiermill.llm.words import portions, word_hashes

DRAW = random.Random(2)


def test_words_are_those_of_the_pattern():
    alphabet = ["a", "B", "b", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", "é", "É", "漢", "\u2028", "\x00", "abcdefg", "x" * 7, "y" * 8, "z" * 30]
    texts = ["".join(DRAW.choice(alphabet) for _ in range(DRAW.randrange(0, 30))) for _ in range(400)] + ["", " ", "one"]
    split = lambda t: [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    whole = pa.array([t.encode() for t in texts], pa.binary())
    names: dict = {}
    for array, own in ((whole, texts), (whole.slice(7, 200), texts[7:207]), (whole.slice(400), texts[400:]), (whole[:0], [])):
        hashes, bounds = word_hashes(array)
        assert len(bounds) == len(own) + 1 and bounds[-1] == len(hashes)
        for i, t in enumerate(own):
            found = hashes[bounds[i] : bounds[i + 1]].tolist()
            assert len(found) == len(split(t))
            for h, w in zip(found, split(t)):
                assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_portions_are_all_rows_in_order():
    texts = [b"x" * DRAW.randrange(0, 50) for _ in range(200)] + [b"y" * 500]
    batch = pa.record_batch([pa.array(range(201)), pa.array(texts, pa.binary())], names=["i", "t"])
    for own in (batch, batch.slice(13, 100), batch.slice(200), batch.slice(0, 0)):
        parts = list(portions(iter([own]), 1, 120))
        assert [i for p in parts for i in p.column(0).to_pylist()] == own.column(0).to_pylist()
        assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= 120 for p in parts)
