import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tiermill.llm.packing_bm25 import B, K1, Encoder, Shard, pack
from tiermill.llm.queries import op8_lexical_packing, tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check(rows, texts, tokenizer):
    """Each id in one piece, right checksums, gapless sequences; texts is a list of (id, text)."""
    wanted = defaultdict(list)
    for key, text in texts:
        wanted[key].append(ids_of(tokenizer, text))
    pieces, sequences = Counter(), defaultdict(list)
    for r in rows:
        whole = [t for t in wanted[r.doc_id] if len(t) == r.doc_tokens]
        assert any(zlib.crc32(t[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for t in whole)
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces.update((r.doc_id, r.doc_tokens, p) for p in range(r.start, r.start + r.length))
    expected = Counter((k, len(t), p) for k, ts in wanted.items() for t in ts for p in range(len(t)))
    assert pieces == expected
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    return [sum(n for _, n in parts) for parts in sequences.values()]


def test_whole_table(spark, folder, texts, tokenizer):
    lengths = check(op8_lexical_packing(spark, folder).collect(), [(d.doc_id, d.text) for d in texts.collect()], tokenizer)
    # Each task leaves one sequence open at most.
    assert sum(n < 1024 for n in lengths) <= 4


def test_odd_rows(spark, odd, none, tokenizer):
    check(pack(odd, PATH).collect(), [(d.doc_id, d.text) for d in odd.collect()], tokenizer)
    assert pack(none, PATH).collect() == []


def test_words_encoded_once_equal_whole_texts(tokenizer):
    texts = [
        "", " ", "a b", "a  b", " a", "a ", "a\nb", "a \n b", "it's we'll  don't", "x\t y", "é 漢字   z", "　a b", "1 22 333\n4",
        "a\n\nb c", "<|endoftext|> x", "\U0001f600 \U0001f600a", "word.\nNext, word",
    ]
    encoder = Encoder(PATH)
    for _ in range(2):
        for text, got in zip(texts, encoder.encode(texts)):
            assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_index_scores_against_the_formula():
    draw = np.random.default_rng(1)
    docs = [draw.integers(0, 40, draw.integers(5, 60)).astype(np.uint32) for _ in range(30)]
    idf = draw.random(40) + 0.1
    average = np.mean([len(d) for d in docs])
    index = Shard(docs, idf, average)
    query = np.array([3, 5, 5, 9], np.uint32)
    for doc, got in zip(docs, index.scores(query)):
        tf = Counter(doc.tolist())
        norm = K1 * (1 - B + B * len(doc) / average)
        assert math.isclose(got, sum(idf[t] * tf[t] * (K1 + 1) / (tf[t] + norm) for t in {3, 5, 9}), abs_tol=1e-9)
    table = index.table()
    for row, doc in enumerate(docs):
        assert np.allclose(table[row], index.scores(doc), rtol=1e-5)


def test_neighbours_share_a_sequence(spark):
    topics = [[f"{t}{i}" for i in range(40)] for t in ("alpha", "beta", "gamma", "delta")]
    rows = [(4 * k + t, " ".join(topics[t][(k * 7 + i) % 40] for i in range(60))) for k in range(30) for t in range(4)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH).collect()
    together = defaultdict(Counter)
    for r in got:
        together[r.sequence_id][r.doc_id % 4] += r.length
    share = sum(max(c.values()) for c in together.values()) / sum(sum(c.values()) for c in together.values())
    assert share > 0.8
