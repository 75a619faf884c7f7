"""Licence notices in texts by the Dice coefficient of word bigrams.

The units of a text are its lines and, for texts that are a licence as a whole, all of it. A unit and a template are their
sets of word bigrams after normalisation (A-Z in lower case, everything but a-z and 0-9 as one space). A Dice coefficient
of ``threshold`` needs sizes within a factor of ``(2 - threshold) / threshold``, so a template is only compared with units of
that size; a unit without a bigram of any template is not compared at all.

All of it is column functions within a row: nothing is shuffled, and templates, a table of bounded size given by the caller, are constants
of the plan.

Defined cases: a null or empty text has no licence; repeated rows stay; of equal scores the first name in code point order is
the licence; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
THRESHOLD = 0.8
MOST_TEMPLATES = 2000

# Public names of licences and the short notices by which texts refer to them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License.",
    ),
    ("BSD", "Released under the BSD License."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved."),
]


def bigrams(text: str) -> list[str]:
    """Sorted set of the word bigrams of a normalised text."""
    words = re.sub("[^a-z0-9]+", " ", "".join(c.lower() if c in UPPER else c for c in text)).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _words(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.translate(text, UPPER, UPPER.lower()), "[^a-z0-9]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def scan(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``id``, ``license_id`` (of the best match, or null), ``score``, ``n_matches`` and ``matches`` (name, score and line,
    counted from 0; -1 is the whole text) of every row."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    known = [(name, found) for name, source in templates if (found := bigrams(source))]
    if not known:
        raise ValueError("no template has a bigram")
    most = (2 - threshold) / threshold + 1e-9
    low = min(len(found) for _, found in known) / most
    high = max(len(found) for _, found in known) * most
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, b)).alias("b")) for n, b in known])
    every = F.array(*map(F.lit, sorted({b for _, found in known for b in found})))

    def matches(unit: Column) -> Column:
        size = F.size(unit["b"])
        in_size = F.filter(table, lambda t: (size * most >= F.size(t["b"])) & (F.size(t["b"]) * most >= size))
        scored = F.transform(
            in_size,
            lambda t: F.struct(
                (2.0 * F.size(F.array_intersect(unit["b"], t["b"])) / (size + F.size(t["b"]))).alias("score"),
                t["name"].alias("license_id"),
                unit["line"].alias("line"),
            ),
        )
        return F.filter(scored, lambda m: m["score"] >= threshold)

    lines = F.transform(F.split(F.col("_text"), "\n"), lambda line, i: F.struct(i.alias("line"), _words(line).alias("w")))
    rows = docs.select(F.col(id).alias(id), F.coalesce(F.col(text), F.lit("")).alias("_text")).select(
        id, lines.alias("_lines")
    )
    whole = F.array(F.struct(F.lit(-1).alias("line"), F.flatten(F.transform("_lines", lambda u: u["w"])).alias("w")))
    units = F.when(F.size("_lines") > 1, F.concat("_lines", whole)).otherwise(F.col("_lines"))
    # A set of bigrams is no larger than the number of words less one; too large sets are dropped once they are made.
    sized = F.filter("_units", lambda u: F.size(u["w"]) - 1 >= low)
    made = F.transform(sized, lambda u: F.struct(u["line"].alias("line"), _bigrams(u["w"]).alias("b")))
    kept = F.filter(made, lambda u: (F.size(u["b"]) <= high) & F.arrays_overlap(u["b"], every))
    rows = rows.select(id, units.alias("_units")).select(id, kept.alias("_kept"))
    rows = rows.select(id, F.flatten(F.transform("_kept", matches)).alias("_found"))
    # Best first: the highest score, then the name, then the line.
    best = F.array_sort(
        F.transform(
            "_found", lambda m: F.struct((-m["score"]).alias("order"), m["license_id"].alias("license_id"), m["line"].alias("line"))
        )
    )
    rows = rows.select(id, best.alias("_best"))
    return rows.select(
        id,
        F.get("_best", F.lit(0))["license_id"].alias("license_id"),
        (-F.get("_best", F.lit(0))["order"]).alias("score"),
        F.size("_best").cast("long").alias("n_matches"),
        F.transform(
            "_best", lambda m: F.struct(m["license_id"].alias("license_id"), (-m["order"]).alias("score"), m["line"].alias("line"))
        ).alias("matches"),
    )


def check_sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in SQL, without pruning: every line and text against every template."""
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in templates)
    words = (
        "list_filter(string_split(regexp_replace(translate({}, '" + UPPER + "', '" + UPPER.lower() + "'), "
        "'[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    )
    pairs = (
        "list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"
    )
    return f"""
WITH template AS (SELECT license_id, {pairs} AS b FROM (
    SELECT license_id, {words.format("source")} AS w FROM (VALUES {rows}) AS v(license_id, source))),
part AS (SELECT doc_id, i - 1 AS line, x[i] AS source FROM (
    SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))
  UNION ALL SELECT doc_id, -1, text FROM documents WHERE contains(text, chr(10))),
unit AS (SELECT doc_id, line, {pairs} AS b FROM (SELECT doc_id, line, {words.format("source")} AS w FROM part)),
found AS (SELECT doc_id, line, license_id,
    2.0::DOUBLE * len(list_intersect(unit.b, template.b)) / (len(unit.b) + len(template.b)) AS score
  FROM unit, template WHERE len(unit.b) > 0)
SELECT d.doc_id, first(license_id ORDER BY score DESC, license_id, line) AS license_id, max(score) AS score,
  count(license_id) AS n_matches
FROM (SELECT doc_id FROM documents) d LEFT JOIN (SELECT * FROM found WHERE score >= {threshold}) f ON d.doc_id = f.doc_id
GROUP BY d.doc_id"""
