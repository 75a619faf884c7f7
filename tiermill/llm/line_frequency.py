"""Quality rules with cross-document line frequency.

Every line is normalised and hashed; for each host the distinct documents with the line are counted, and lines above
the limit are removed. A document that lost too much is depleted and rejected. Before that, rules on
the text alone reject very short and very repetitive documents.

Copies must not make their own text look like boilerplate. So the lines that many rows of a host have are found first. A
document with enough other words is told by these other lines; one that has hardly anything else is a copy, or nothing but
boilerplate, and is told by all its lines. Documents told alike count as one: exact copies always, near copies as a rule,
whereas documents that share a menu or a footer do not.

Counts are combined before they move, and documents are counted by (host, line, document) first, so a line that stands in a
large share of all documents does not gather them in one task.

Defined cases: a null text is an empty one, has no words and fails; a null host is a host of its own; lines without a word
are never removed; repeated rows count as one document; a line at the limit stays; very long texts are read whole; empty tables
give no rows. Extra columns of whatever name are carried along by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tiermill.llm.common import as_bytes, carried, keep, lean, own, restored

SYMBOLS = b"#*$%&|<>"
_DIGITS = re.compile(rb"[0-9]+")


@dataclass(frozen=True)
class Limits:
    """``min_words`` and ``max_repeat`` (percent of words in repeated windows) are base rules. A line is boilerplate in a
    host where more than ``line_docs`` distinct documents have it. ``own_share`` of a document's words must be in
    other lines to tell it by these. A document is depleted when removal takes more than ``max_lost`` of its words."""

    min_words: int = 10
    max_repeat: int = 20
    window: int = 5
    line_docs: int = 20
    own_share: float = 0.2
    max_lost: float = 0.5


def repeated_words(words: list[bytes], window: int) -> int:
    """Words that stand in a window of so many words found twice or more, the first one included. Exact, no hashes."""
    count = len(words) - window + 1
    if count < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    key, kinds = ids, len(seen)
    if kinds == len(words):
        return 0
    for step in range(1, window):
        key = key[: len(words) - step] * len(seen) + ids[step:]
        kinds *= len(seen)
        if kinds > 2**62 // max(len(seen), 1):
            values, key = np.unique(key, return_inverse=True)
            kinds = len(values)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(count, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, np.flatnonzero(twice), 1)
    np.add.at(steps, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def normalised(words: list[bytes]) -> bytes:
    """A line for counting: A-Z in lower case, runs of digits as one 0, single spaces."""
    return _DIGITS.sub(b"0", b" ".join(words).lower())


def line_hash(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(normalised(words)) - 2**63


def facts(text: bytes, limits: Limits) -> tuple:
    """Counts of a whole text, and the hash of each different line with a word and the words it has in all."""
    words = text.split()
    lines, seen, copies = {}, set(), 0
    for line in text.split(b"\n"):
        inside = line.split()
        if inside:
            copies += line in seen
            seen.add(line)
            key = line_hash(inside)
            lines[key] = lines.get(key, 0) + len(inside)
    characters = len(b"".join(words).decode("utf-8", "replace"))
    symbols = sum(map(text.count, (bytes([s]) for s in SYMBOLS)))
    repeats = repeated_words(words, limits.window)
    return len(words), characters, symbols, copies, repeats, list(lines), list(lines.values())


FACTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "lines array<long>, line_words array<int>"
)


def _facts(limits: Limits):
    types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = [x.split()[0] for x in FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [facts(t.as_py(), limits) for t in batch.column(2)]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.record_batch([*batch.columns[:2], batch.column(3), *columns], names=["id", "host", "text_hash", *names])

    return run


def text_facts(docs: DataFrame, id: str, text: str, host: str, limits: Limits) -> DataFrame:
    rows = docs.select(F.col(id).alias("id"), F.col(host).alias("host"), as_bytes(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(lean(_facts(limits)), f"id {kinds['id']}, host {kinds['host']}, text_hash long, {FACTS}")


def frequent_lines(lines: DataFrame, limits: Limits) -> DataFrame:
    """``host``, ``line``, ``n_docs`` of the lines above the limit. ``lines`` has ``row``, ``host``, ``line`` and its ``words``,
    each line of a row once."""
    many = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limits.line_docs)
    # Stored, so that Spark knows how large it is before it chooses the join.
    many = keep(many.select(F.col("host").alias("h"), F.col("line").alias("l")), "many-lines", 16)
    same = (F.col("line") == F.col("l")) & F.col("host").eqNullSafe(F.col("h"))
    marked = lines.join(many, same, "left").withColumn("many", F.col("l").isNotNull())
    rare = F.when(~F.col("many"), F.col("line"))
    words = F.sum(F.when(~F.col("many"), F.col("words")).otherwise(0))
    told = F.when(
        words >= limits.own_share * F.sum("words"), F.xxhash64(F.lit("rare"), F.min(rare), F.max(rare))
    ).otherwise(F.xxhash64(F.lit("all"), F.min("line"), F.max("line")))
    documents = marked.groupBy("row").agg(told.alias("document"), F.max("many").alias("any")).where("any").drop("any")
    return (
        marked.where("many")
        .join(documents, "row")
        .select("host", "line", "document")
        .distinct()
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .where(F.col("n_docs") > limits.line_docs)
    )


def _verdict(limits: Limits) -> dict[str, Column]:
    base = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat * F.col("n_words"))
    depleted = F.col("removed_words") > limits.max_lost * F.col("n_words")
    return {"base_failed": base, "kept": ~(base | depleted)}


def verdicts(
    docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", limits: Limits = Limits()
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``host``, ``text_hash``, the counts, ``removed_words``, ``removed`` (hashes of
    the lines to remove, null if none), ``base_failed`` and ``kept``. Texts are read once and never moved."""
    counted = keep(
        text_facts(docs, id, text, host, limits).withColumn("row", F.monotonically_increasing_id()), "line-facts"
    )
    lines = counted.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select(
        "row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words")
    )
    frequent = keep(frequent_lines(lines, limits), "frequent-lines", 16)
    marked = frequent.select(F.col("host").alias("h"), F.col("line").alias("l"))
    hits = (
        lines.join(marked, (F.col("line") == F.col("l")) & F.col("host").eqNullSafe(F.col("h")), "left_semi")
        .groupBy("row")
        .agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed"))
    )
    rows = counted.drop("lines", "line_words").join(hits, "row", "left").fillna(0, ["removed_words"])
    return rows.withColumns(_verdict(limits)).drop("row")


def assess(
    docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", limits: Limits = Limits()
) -> DataFrame:
    """One row per row of ``docs``: its id, counts, ``removed_words``, ``removed_lines``, ``base_failed`` and ``kept``."""
    rows = verdicts(docs, id, text, host, limits)
    lines = F.coalesce(F.size("removed"), F.lit(0)).cast("long")
    return rows.withColumn("removed_lines", F.when(F.col("removed").isNull(), 0).otherwise(lines)).select(
        F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words",
        "removed_lines", "base_failed", "kept",
    )


def without_lines(text: str, removed: set[int]) -> str:
    return "\n".join(x for x in text.split("\n") if line_hash(x.encode().split()) not in removed)


@F.pandas_udf(StringType())
def _cleaned(texts: pd.Series, removed: pd.Series) -> pd.Series:
    pairs = zip(texts, removed)
    return pd.Series([t if r is None or t is None else without_lines(t, set(r)) for t, r in pairs], dtype="object")


def clean(
    docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", limits: Limits = Limits()
) -> DataFrame:
    """The kept rows of ``docs`` with all their columns; lines above the limit are taken out of ``text``.

    Rows with the same id, host and text have the same verdict, so it is matched to them by these.
    """
    kept = (
        verdicts(docs, id, text, host, limits)
        .where("kept")
        .select(F.col("id").alias("i"), F.col("host").alias("h"), F.col("text_hash").alias("g"), "removed")
        .dropDuplicates(["i", "h", "g"])
    )
    same = own(id).eqNullSafe(F.col("i")) & own(host).eqNullSafe(F.col("h")) & (F.xxhash64(own(text)) == F.col("g"))
    return carried(docs).join(kept, same).select(*restored(docs.columns, {text: _cleaned(own(text), "removed")}))
