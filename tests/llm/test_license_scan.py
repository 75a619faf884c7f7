from compare import connect, difference

from tiermill.llm.license_scan import TEMPLATES, bigrams, scan
from tiermill.llm.queries import CHECKS, op6_license_scan


def test_whole_table_against_sql(spark, folder):
    got = op6_license_scan(spark, folder)
    assert difference(got, connect(folder), CHECKS["op6_license_scan"]) == ""
    assert got.where("license_id is not null").count() > 0


def plain(text):
    lines = (text or "").split("\n")
    units = list(enumerate(lines)) + ([(-1, text)] if len(lines) > 1 else [])
    found = []
    for line, unit in units:
        own = set(bigrams(unit))
        for name, source in TEMPLATES:
            other = set(bigrams(source))
            if own and (score := 2.0 * len(own & other) / (len(own) + len(other))) >= 0.8:
                found.append((-score, name, line))
    return [(name, -score, line) for score, name, line in sorted(found)]


def test_against_plain_code(spark, odd, none):
    texts = [
        "a line\nLICENSED under the  Apache\tlicense; version 2.0\nmore",
        "This work is licensed under the\nGNU General Public License,\nversion 3.",
        "All rights reserved. All rights reserved.",
        "Licensed under the Apache License, Version 2.0. Released under the MIT License.",
        "x " * 5000 + "\nAll Rights Reserved\n",
        "É all rights reserved ü",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan(rows).collect():
        want = plain(texts[r.doc_id])
        assert [tuple(m) for m in r.matches] == want and r.n_matches == len(want)
        assert r.license_id == (want[0][0] if want else None)
    assert len(scan(odd).collect()) == odd.count() and scan(odd).where("n_matches > 0").count() == 0
    assert scan(none).collect() == []
