import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tiermill.llm import spotsigs
from tiermill.llm.queries import op10_spot_signatures
from tiermill.llm.spotsigs import ANCHORS, SKIP, compare, fingerprints, likeness, matches, signatures


def plain(text):
    """Signatures as strings, by going through the words."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    found = set()
    for i, word in enumerate(words):
        chain, at = [], i + 1
        while word in ANCHORS and len(chain) < 2:
            skipped = 0
            while at < len(words) and words[at] in ANCHORS and skipped < SKIP:
                at, skipped = at + 1, skipped + 1
            if at >= len(words) or words[at] in ANCHORS:
                break
            chain.append(words[at])
            at += 1
        if len(chain) == 2:
            found.add(" ".join([word, *chain]))
    if not found and len(words) > 2:
        found = {" ".join(words[i : i + 3]) for i in range(len(words) - 2)}
    return found or {" " + " ".join(words) + " "}


def share(a, b):
    return len(a & b) / len(a | b)


def test_whole_table_against_plain_code(spark, folder, texts):
    docs = sorted(texts.collect(), key=lambda d: d.doc_id)
    got = {r.doc_id: r for r in op10_spot_signatures(spark, folder).collect()}
    assert len(got) == len(docs)
    names = {}
    for d, after in zip(docs, docs[1:] + docs[:1]):
        text, cut = d.text, len(d.text) // 4
        edited = text[: len(text) - cut] + after.text[:cut]
        r = got[d.doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(share(plain(text), plain(edited)))
        assert r.near_next == pytest.approx(share(plain(text), plain(after.text)))
        assert names.setdefault(frozenset(plain(text)), r.fingerprint) == r.fingerprint
    assert len(set(names.values())) == len(names)


def test_odd_rows(odd, none):
    rows = compare(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_chars == by[2].n_chars == 0 and by[1].fingerprint == by[2].fingerprint == by[3].fingerprint
    assert by[1].near_next == 1.0 and by[4].fingerprint == by[None].fingerprint
    assert compare(none).collect() == [] and fingerprints(none).collect() == []
    one = compare(odd.where("doc_id = 7")).collect()[0]
    assert one.near_next == 1.0 and one.near_edited == 1.0


def test_a_text_is_signed_once(texts, monkeypatch):
    """For itself and for the document before it; the edited text is the other one."""
    calls = []
    monkeypatch.setattr(spotsigs, "signatures", lambda text, *more: calls.append(text) or signatures(text, *more))
    compare(texts)
    assert len(calls) == 2


def test_runs_of_anchors_and_pruning(spark):
    rows = spark.createDataFrame([("the " * 20000 + "end of it",), ("the a cat and dog " * 50,)], "t string")
    assert [len(r[0]) for r in rows.select(signatures(F.col("t"))).collect()] == [4, 3]
    sets = spark.sql("select array(1,2,3,4,5) a, array(1,2,3,4) b, array(1) c")
    got = sets.select(
        likeness(F.col("a"), F.col("b"), 0.8), likeness(F.col("a"), F.col("c"), 0.8), likeness(F.col("a"), F.col("c"))
    ).first()
    assert tuple(got) == (0.8, None, 0.2)


def test_matches_against_all_pairs(texts):
    prints = fingerprints(texts)
    asked = prints.where("doc_id % 3 = 0")
    sets = {r.doc_id: set(r.signatures) for r in prints.collect()}
    for threshold in (0.8, 0.5):
        want = {(q, d) for q in sets if q % 3 == 0 for d in sets if share(sets[q], sets[d]) >= threshold}
        got = [(r.query_id, r.doc_id) for r in matches(asked, prints, threshold).collect()]
        assert sorted(got) == sorted(want)


def test_no_python_in_the_plan(spark, folder):
    plan = op10_spot_signatures(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
