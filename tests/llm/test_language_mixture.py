import zlib

import numpy as np
from pyspark.sql import functions as F

from tiermill.llm.language_mixture import _maximise, fit, identify, infer
from tiermill.llm.queries import op9_language_mixture


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.collect()}
    rows = op9_language_mixture(spark, folder).collect()
    assert len(rows) == len(known)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    asked = [r for r in rows if r.held_out and known[r.doc_id]]
    right = sum(r.lang_pred == known[r.doc_id] for r in asked) / len(asked)
    assert right > 0.97


def test_mixtures_of_two_and_three(spark, texts):
    names, table = fit(texts)
    by = {n: [r.text for r in texts.where(F.col("lang") == n).collect() if len(r.text) > 1500] for n in names}
    words = {n: " ".join(by[n]).split() for n in names}
    mixed = " ".join(words["en"][:300] + words["de"][:100])
    third = " ".join(words["en"][300:500] + words["de"][100:300] + words["fr"][:200])
    one = " ".join(words["en"][600:900])
    shares = infer([mixed, third, one, None, "", "12 34 !"], table)
    place = {n: names.index(n) for n in names}
    assert abs(shares[0][place["en"]] - 0.75) < 0.08 and abs(shares[0][place["de"]] - 0.25) < 0.08
    assert all(abs(shares[1][place[n]] - 1 / 3) < 0.08 for n in ("en", "de", "fr"))
    assert shares[2][place["en"]] == 1.0 and not shares[3:].any()


def test_proportions_maximise_the_likelihood():
    draw = np.random.default_rng(4)
    scores = draw.normal(0, 2, (40, 2))
    share, value = _maximise(scores, np.array([0]), np.zeros(40, int), np.ones((1, 2), bool))
    grid = np.linspace(0.0005, 0.9995, 2000)
    likelihood = [np.log(np.exp(scores) @ np.array([p, 1 - p])).sum() for p in grid]
    assert abs(value[0] - max(likelihood)) < 0.05 and abs(share[0][0] - grid[int(np.argmax(likelihood))]) < 0.1


def test_odd_rows(odd, none):
    names, table = fit(odd)
    rows = identify(odd, names, table).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert [(by[i].lang_pred, by[i].score) for i in (1, 2, 3)] == [("und", 0.0)] * 3 and by[4].lang_pred == "en"
    assert identify(none, names, table).collect() == []
    assert {r.lang_pred for r in identify(odd, *fit(none)).collect()} == {"und"}
