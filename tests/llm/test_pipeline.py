from collections import Counter

import corpus_pipeline
from tiermill.llm import line_frequency, mixing_flow, simhash_pivots


def test_stages_in_order(spark, folder, texts):
    docs, before = texts, None
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, folder)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        assert rows
        if number < 4:
            assert docs.columns == texts.columns
            assert all(r.n_chars == len(r.text) for r in rows)
        if number == 0:
            kept = {r.doc_id for r in line_frequency.assess(before).where("kept").collect()}
            assert Counter(r.doc_id for r in rows) == Counter(kept)
        if number == 1:
            classes = simhash_pivots.near_duplicates(before).collect()
            assert Counter(r.doc_id for r in rows) == Counter({r.component_id for r in classes})
        if number == 2:
            old = {r.doc_id: r.text for r in before.collect()}
            assert all(len(r.text) <= len(old[r.doc_id]) for r in rows)
        if number == 3:
            times = {r.id: r.times for r in mixing_flow.mix(before).collect() if r.times}
            assert Counter(r.doc_id for r in rows) == Counter(times)
        if number == 4:
            words = Counter()
            for r in rows:
                words[r.doc_id] += r.length
            copies = Counter(r.doc_id for r in before.collect())
            tokens = {r.doc_id: r.doc_tokens for r in rows}
            assert words == Counter({k: n * tokens[k] for k, n in copies.items()})


def test_run_gives_the_last_stage(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
    ]


def test_odd_rows(spark, odd, none):
    for table in (odd, none):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            rows = docs.collect()
            docs = spark.createDataFrame(rows, docs.schema)
        assert bool(rows) == (table is odd)
