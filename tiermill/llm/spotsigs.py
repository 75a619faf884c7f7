"""Document fingerprints by spot signatures, in built-in column functions only.

A signature is a common word (the anchor) with the next content words after it; anchors between them are skipped. A
document's fingerprint is the set of its signatures, as hashes. Layout, numbers of menus and teasers hold few anchors, so the
set follows the prose. Two sets are compared by Jaccard similarity with pruning: their lengths alone bound it, so sets whose
length classes are too far apart for a threshold are never intersected.

Defined cases: a text without any signature has its word triples instead, or itself if it has fewer than three words, so
equal texts always have equal fingerprints; a null text is an empty one; rows of equal id and text are one document and have
the same next document; null ids come last; a table with one document has itself as the next one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiermill.llm.common import keep, tasks

# The most common function words of the languages that texts are expected in.
ANCHORS = (
    "a an and are at for in is it of on that the this to was with das den der die ein ist nicht und zu dans des du est et "
    "la le les pour que un une de del el en los por se y"
).split()
CHAIN = 2
SKIP = 4
MARK = "\u0001"


def normalised(text: Column) -> Column:
    """Words of letters and digits in lower case, each between single spaces."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def signatures(text: Column, chain: int = CHAIN, anchors: list[str] = ANCHORS) -> Column:
    """The set of hashed signatures of a text, as a sorted array that is never empty."""
    plain = normalised(text)
    marked = F.regexp_replace(plain, f" (?=(?:{'|'.join(anchors)}) )", f" {MARK}")
    # An anchor and its chain; up to SKIP anchors may stand before each content word.
    link = f"(?: {MARK}[^ ]+){{0,{SKIP}}} [^{MARK} ]+"
    spots = F.regexp_extract_all(marked, F.lit(f"(?={MARK}([^ ]+{link * chain}) )"), F.lit(1))
    hashes = F.transform(spots, lambda s: F.hash(F.regexp_replace(s, f" {MARK}[^ ]+", "")))
    words = F.split(F.trim(plain), " ")
    triples = F.transform(
        F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.hash(F.array_join(F.slice(words, i, 3), " "))
    )
    found = (
        F.when(F.size(spots) > 0, hashes).when(F.size(words) > 2, triples).otherwise(F.array(F.hash(plain)))
    )
    return F.array_sort(F.array_distinct(found))


def digest(signatures: Column) -> Column:
    """A short name of a signature set."""
    return F.sha2(F.array_join(signatures.cast("array<string>"), " "), 256)


def length_class(size: Column, threshold: float) -> Column:
    """Sets within the threshold lie in the same class of lengths or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(threshold)) + F.lit(1e-9)).cast("int")


def likeness(a: Column, b: Column, threshold: float | None = None) -> Column:
    """Jaccard similarity of two sets. With a threshold, pairs whose lengths rule it out give null and are not compared."""
    common = F.size(F.array_intersect(a, b))
    value = common / (F.size(a) + F.size(b) - common)
    if threshold is None:
        return value
    classes = length_class(F.size(a), threshold) - length_class(F.size(b), threshold)
    bound = F.least(F.size(a), F.size(b)) >= threshold * F.greatest(F.size(a), F.size(b))
    return F.when((F.abs(classes) <= 1) & bound, value)


def matches(queries: DataFrame, prints: DataFrame, threshold: float = 0.8, id: str = "doc_id") -> DataFrame:
    """``query_id``, ``doc_id``, ``likeness`` of all pairs of a query and a row of ``prints`` at or above the threshold.

    Both have ``id`` and ``signatures`` (see ``fingerprints``). Rows meet in partitions by length class and signature: of a
    set only the smallest signatures, one more than it may lack, are keys, as two sets within the threshold share one of
    these. Equal sets are compared once. What meets is compared with the bound on lengths first.
    """
    signs = F.col("signatures")
    size = F.size(signs)
    kept = (size - F.ceil(size * threshold - 1e-9) + 1).cast("int")

    def keyed(rows: DataFrame, classes: Column) -> DataFrame:
        sets = rows.groupBy("signatures").agg(F.count(F.lit(1)).alias("n")).drop("n")
        placed = sets.select("signatures", F.explode(classes).alias("class"), F.slice(signs, 1, kept).alias("keys"))
        return placed.select("signatures", "class", F.explode("keys").alias("key"))

    own = length_class(size, threshold)
    asked = keyed(queries, F.array(own - 1, own, own + 1)).withColumnRenamed("signatures", "a")
    held = keyed(prints, F.array(own)).withColumnRenamed("signatures", "b")
    value = likeness(F.col("a"), F.col("b"), threshold)
    pairs = asked.join(held, ["class", "key"]).select("a", "b").distinct()
    alike = pairs.withColumn("likeness", value).where(F.col("likeness") >= threshold)
    named = alike.join(queries.select(F.col(id).alias("query_id"), F.col("signatures").alias("a")), "a")
    return named.join(prints.select(F.col(id).alias("doc_id"), F.col("signatures").alias("b")), "b").select(
        "query_id", "doc_id", "likeness"
    )


def following(docs: DataFrame, id: str, text: str) -> DataFrame:
    """For each distinct (id, text): ``id``, ``h``, ``n``, the key of the next one in ascending order of id and how many rows
    that has. After the last comes the first. Only keys are sorted; no text is moved and no row passes a single task but
    the first of each range."""
    keys = docs.select(
        F.col(id).alias("id"), F.xxhash64(text).alias("h"), F.length(F.coalesce(text, F.lit(""))).alias("n")
    )
    order = [F.col("id").asc_nulls_last(), F.col("h"), F.col("n")]
    ranged = keep(
        keys.groupBy("id", "h", "n")
        .agg(F.count(F.lit(1)).alias("c"))
        .repartitionByRange(tasks(docs.sparkSession), *order)
        .withColumn("part", F.spark_partition_id()),
        "key-ranges",
        8,
    )
    own = F.struct("id", "h", "n", "c")
    within = ranged.withColumn("next", F.lead(own).over(Window.partitionBy("part").orderBy(*order)))
    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("h"), F.col("n"))
    firsts = ranged.groupBy("part").agg(F.min_by(own, rank).alias("first"))
    # One row per range from here on.
    every = Window.partitionBy(F.lit(0)).orderBy("part")
    start = F.first("first").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = firsts.select("part", F.coalesce(F.lead("first").over(every), start).alias("head"))
    joined = within.join(F.broadcast(heads), "part").withColumn("next", F.coalesce("next", "head"))
    return joined.select(
        "id", "h", "n", F.col("next.id").alias("next_id"), F.col("next.h").alias("next_h"), F.col("next.n").alias("next_n"),
        F.col("next.c").alias("next_c"),
    )


def _same(left: str, right: str) -> Column:
    """Equal keys; the id may be null."""
    a, b = left.split(), right.split()
    return F.col(a[0]).eqNullSafe(F.col(b[0])) & (F.col(a[1]) == F.col(b[1])) & (F.col(a[2]) == F.col(b[2]))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_chars``, ``signatures`` and ``fingerprint`` of every row."""
    rows = docs.select(F.col(id).alias(id), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.select(
        id, F.length("_text").cast("long").alias("n_chars"), signatures(F.col("_text")).alias("signatures")
    ).withColumn("fingerprint", digest(F.col("signatures")))


def edited(docs: DataFrame, id: str = "doc_id", text: str = "text", part: int = 4) -> DataFrame:
    """``id``, ``text``, ``edited`` (the last 1/``part`` of its code points replaced by as many first ones of the next
    document, or all it has), ``signatures`` and ``next_signatures`` of every row.

    A text is signed once, before it moves. Of the next document only those code points and its signatures are moved, keyed by
    the document before it.
    """
    rows = docs.select(
        F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(text).alias("h"),
        F.length(F.coalesce(text, F.lit(""))).alias("n"), signatures(F.coalesce(F.col(text), F.lit(""))).alias("signatures"),
    )
    keys = keep(following(docs, id, text), "next-keys", 8)
    asked = keys.select(F.col("id").alias("for_id"), F.col("h").alias("for_h"), F.col("n").alias("for_n"), "next_id", "next_h", "next_n", "next_c")
    taken = F.floor(F.col("for_n") / part).cast("int")

    def given(wanted: DataFrame) -> DataFrame:
        return rows.join(wanted, _same("id h n", "next_id next_h next_n")).select(
            "for_id", "for_h", "for_n", F.left("text", taken).alias("head"), F.col("signatures").alias("next_signatures")
        )

    heads = given(asked.where("next_c = 1"))
    if asked.where("next_c > 1").take(1):
        # A document that stands in the table more than once gives its text once.
        repeated = given(asked.where("next_c > 1")).dropDuplicates(["for_id", "for_h", "for_n"])
        heads = heads.unionByName(repeated)
    joined = rows.join(heads, _same("id h n", "for_id for_h for_n"))
    cut = F.floor(F.col("n") / part).cast("int")
    return joined.select(
        "id", "text", "n", F.concat(F.left("text", F.col("n") - cut), F.col("head")).alias("edited"), "signatures", "next_signatures"
    )


def compare(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's fingerprint, that of its edited text, and its likeness to that one and to the next document's."""
    rows = edited(docs, id, text).select(
        "id",
        "n",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("signatures").alias("own"),
        signatures(F.col("edited")).alias("changed"),
        "next_signatures",
    )
    return rows.select(
        F.col("id").alias(id),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        digest(F.col("own")).alias("fingerprint"),
        digest(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_signatures")).alias("near_next"),
    )
