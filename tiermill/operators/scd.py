"""Effective-dated versions (slowly changing dimension, type 2).

Most keys change now and then: all rows of such a key meet in one exchange, and
one sort serves every neighbour question. A key with more than ``most`` rows
never gets a window of its own. Its rows are dealt out in even ranges of key and
time, neighbours are found inside a range, and a one-row summary of each key and
range carries the last digest, the next start and the running count across the
borders. A key that owns a third of all rows is a third of all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiermill.reference import OPEN_END
from tiermill.session import stored

VERSION_COLUMNS = ["effective_to", "is_current", "record_version"]


def _one_row_per_instant(
    rows: DataFrame, key: str, at: str, digest: str, first_version: str | None, places: tuple[str, ...] = ()
) -> DataFrame:
    """Rows sharing key and instant collapse to the one with the largest digest."""
    keys = [*places, key, at]
    rest = [digest] + [c for c in rows.columns if c not in (*keys, digest, first_version)]
    seed = F.min(first_version) if first_version else F.lit(1)
    best = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_best"), seed.alias("_seed"))
    return best.select(*keys, "_seed", *[F.col(f"_best.{c}").alias(c) for c in rest])


def _numbered(kept: DataFrame, end: Column, position: Column) -> DataFrame:
    """Kept rows with their end, whether they are the last, and their number."""
    versions = kept.withColumns({"_end": end, "_position": position})
    dropped = [c for c in versions.columns if c.startswith("_")]
    return versions.withColumns(
        {
            "effective_to": F.coalesce("_end", F.lit(OPEN_END)),
            "is_current": F.col("_end").isNull(),
            "record_version": (F.col("_base") + F.col("_position") - 1).cast("int"),
        }
    ).drop(*dropped)


def _whole_keys(single: DataFrame, key: str, at: str, digest: str, places: tuple[str, ...] = ()) -> DataFrame:
    """Versions of keys whose rows are in one window; ``single`` is clustered by key, or by the ``places`` of the key."""
    whole = Window.partitionBy(*places, key)
    inside = whole.orderBy(at)
    before = {"_first": F.row_number().over(inside) == 1, "_same": F.lag(digest).over(inside).eqNullSafe(F.col(digest))}
    marked = single.withColumns(before | {"_base": F.coalesce(F.min("_seed").over(whole), F.lit(1))})
    kept = marked.where(F.col("_first") | ~F.col("_same"))
    return _numbered(kept, F.lead(at).over(inside), F.row_number().over(inside))


def _in_chunks(single: DataFrame, key: str, at: str, digest: str) -> DataFrame:
    """Versions of keys whose rows are cut in chunks (``_chunk``) that follow each other in time."""
    inside = Window.partitionBy(key, "_chunk").orderBy(at)
    across = Window.partitionBy(key).orderBy("_chunk")
    until_now = across.rowsBetween(Window.unboundedPreceding, -1)

    # One row for each key and chunk; the digest is carried in a struct, as a missing carry is not a null digest.
    tails = (
        single.groupBy(key, "_chunk")
        .agg(F.max_by(F.struct(digest), at).alias("_tail"), F.min("_seed").alias("_seed"))
        .select(
            key,
            "_chunk",
            F.lag("_tail").over(across).alias("_carried"),
            F.coalesce(F.min("_seed").over(Window.partitionBy(key)), F.lit(1)).alias("_base"),
        )
    )
    tails = stored(tails, "version-tails")
    kept = (
        single.withColumn("_previous", F.lag(F.struct(digest)).over(inside))
        .join(tails, [key, "_chunk"])
        .where(~F.coalesce("_previous", "_carried").eqNullSafe(F.struct(digest)))
        .drop("_previous", "_carried", "_seed")
    )
    heads = (
        kept.groupBy(key, "_chunk")
        .agg(F.min(at).alias("_head"), F.count("*").alias("_n"))
        .withColumns(
            {
                "_next_head": F.lead("_head").over(across),
                "_before": F.coalesce(F.sum("_n").over(until_now), F.lit(0)),
            }
        )
        .drop("_head", "_n")
    )
    ends = kept.withColumns({"_next": F.lead(at).over(inside), "_place": F.row_number().over(inside)})
    joined = ends.join(stored(heads, "version-heads"), [key, "_chunk"])
    return _numbered(joined, F.coalesce("_next", "_next_head"), F.col("_before") + F.col("_place"))


def build(
    rows: DataFrame,
    key: str,
    at: str = "effective_from",
    digest: str = "hash_diff",
    chunk: str | None = None,
    first_version: str | None = None,
    most: int = 100_000,
) -> DataFrame:
    """Version rows of every key.

    A row whose digest equals the one before it is dropped. ``most`` is the
    number of rows up to which a key is one window, ``chunk`` (a ``date_trunc``
    unit) cuts every key by time instead; both change only the layout of the
    work, never the result. ``first_version`` names a column with version
    numbers already given out; numbering then continues from the smallest one
    of each key.
    """
    if chunk:
        single = _one_row_per_instant(rows, key, at, digest, first_version)
        return _in_chunks(single.withColumn("_chunk", F.date_trunc(chunk, at)).repartition(key, "_chunk"), key, at, digest)

    busy = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key)
    busy = stored(busy, "busy-keys")
    if busy.isEmpty():
        single = _one_row_per_instant(rows.repartition(key), key, at, digest, first_version)
        return _whole_keys(single, key, at, digest)
    calm = _one_row_per_instant(rows.join(busy, key, "left_anti").repartition(key), key, at, digest, first_version)
    # Copies of one instant are combined before they move, then even ranges are one chunk each.
    hot = stored(_one_row_per_instant(rows.join(busy, key, "left_semi"), key, at, digest, first_version), "busy-rows")
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(hot.repartitionByRange(ranges, key, at).withColumn("_chunk", F.spark_partition_id()), "busy-ranges")
    cut = _in_chunks(dealt.repartitionById(ranges, F.col("_chunk")), key, at, digest)
    whole = _whole_keys(calm, key, at, digest)
    return whole.unionByName(cut.select(whole.columns))


def build_in_place(
    rows: DataFrame,
    key: str,
    places: tuple[str, ...],
    at: str = "effective_from",
    digest: str = "hash_diff",
    first_version: str | None = None,
) -> DataFrame:
    """``build`` for rows that were dealt out by the first of ``places``, a number that depends on their key only: they do not
    move again. Every key of a place is one window; a key of too many rows for that belongs to ``build``. More places keep rows of
    a key apart. Their names start with ``_``, and they are dropped."""
    single = _one_row_per_instant(rows, key, at, digest, first_version, places)
    return _whole_keys(single, key, at, digest, places)


def _split(
    versions: DataFrame, batch: DataFrame, key: str, at: str, digest: str, chunk: str | None
) -> tuple[DataFrame, DataFrame]:
    """Versions the batch cannot affect, and the rebuilt remainder."""
    touched = batch.groupBy(key).agg(F.min(at).alias("_batch_start"))
    marked = versions.join(touched, key, "left")
    closed = F.col("_batch_start").isNull() | (F.col("effective_to") < F.col("_batch_start"))
    settled = marked.where(closed).drop("_batch_start")

    body = [c for c in versions.columns if c not in VERSION_COLUMNS]
    reopened = marked.where(~closed).select(*body, F.col("record_version").alias("stored_version"))
    fresh = batch.select(*body, F.lit(None).cast("int").alias("stored_version"))
    rebuilt = build(
        reopened.unionByName(fresh), key, at, digest, chunk, first_version="stored_version"
    )
    return settled, rebuilt.select(settled.columns)


def apply(
    versions: DataFrame,
    batch: DataFrame,
    key: str,
    at: str = "effective_from",
    digest: str = "hash_diff",
    chunk: str | None = None,
) -> DataFrame:
    """New snapshot of ``versions`` after ``batch``.

    Versions that ended before the first batch row of their key pass through
    untouched; only the rest is rebuilt together with the batch. Replaying a
    batch changes nothing. The result equals ``build`` over the whole history
    when batch rows of a key are not older than rows already applied; older
    ones are placed among the stored versions.
    """
    settled, rebuilt = _split(versions, batch, key, at, digest, chunk)
    return settled.unionByName(rebuilt)


def changes(
    versions: DataFrame,
    batch: DataFrame,
    key: str,
    at: str = "effective_from",
    digest: str = "hash_diff",
    chunk: str | None = None,
) -> DataFrame:
    """Only the version rows that ``apply`` would add or alter.

    This is the input for a table format with MERGE, matched on key and start
    time: its size follows the batch, not the table.
    """
    _, rebuilt = _split(versions, batch, key, at, digest, chunk)
    same = [key, at, digest, "effective_to", "record_version"]
    return rebuilt.join(versions.select(same), same, "left_anti")
