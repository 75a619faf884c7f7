"""Stored vectors: exact similarity search, upsert, conditional fill."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def top_k(
    vectors: DataFrame, query: list[float], k: int = 10, id_column: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """The ``k`` stored vectors closest to ``query``; ties by id.

    The query is a literal, so its own length is computed once, here. Every
    task keeps its best ``k``, and only those meet at the end.
    """
    wanted = F.lit([float(x) for x in query])
    size = math.sqrt(sum(float(x) ** 2 for x in query))
    stored = F.col(column)
    length = F.sqrt(dot(stored, stored)) * F.lit(size)
    scored = vectors.withColumn("similarity", F.when(length > 0, dot(stored, wanted) / length))
    # NaN would come first.
    usable = F.col("similarity").isNotNull() & ~F.isnan("similarity")
    return scored.where(usable).orderBy(F.desc("similarity"), id_column).limit(k)


def unusable(vectors: DataFrame, size: int, column: str = "embedding") -> DataFrame:
    """Rows that ``top_k`` cannot score for a query of ``size`` numbers, with the reason."""
    stored = F.col(column)
    reason = (
        F.when(stored.isNull(), F.lit("MISSING"))
        .when(F.size(stored) != size, F.lit("WRONG_SIZE"))
        .when(F.exists(stored, lambda x: x.isNull()), F.lit("MISSING_NUMBER"))
        .when(F.exists(stored, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), F.lit("NOT_FINITE"))
        .when(dot(stored, stored) == 0, F.lit("ZERO_LENGTH"))
    )
    return vectors.withColumn("reason", reason).where(F.col("reason").isNotNull())


def upsert(
    target: DataFrame, source: DataFrame, key: str, keep: list[str], newest: str | None = None, touched: dict | None = None
) -> DataFrame:
    """New snapshot: matched rows take the source's values, new rows are added.

    Columns in ``keep`` stay as stored for matched rows and are NULL for new
    ones. Of several source rows with one key the last by ``newest`` counts (by
    all columns where that is not given), so a key stays one row. ``touched``
    maps columns to values for the rows the source has, e.g. ``last_updated``.
    Plain Parquet has no MERGE, so the snapshot is a full outer join.
    """
    updated = [c for c in target.columns if c != key and c not in keep and c not in (touched or {})]
    rank = F.struct(*([newest] if newest else []), *updated)
    source = source.groupBy(key).agg(F.max(F.struct(rank.alias("r"), *updated)).alias("s")).select(key, *[f"s.{c}" for c in updated])
    fresh = source.select(key, *[F.col(c).alias(f"_new_{c}") for c in updated], F.lit(True).alias("_matched"))
    joined = target.join(fresh, key, "full_outer")
    pick = lambda c: F.when(F.col("_matched"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    stamped = lambda c: F.when(F.col("_matched"), touched[c]).otherwise(F.col(c)).alias(c)
    return joined.select(
        *[pick(c) if c in updated else stamped(c) if c in (touched or {}) else F.col(c) for c in target.columns]
    )


def stale(table: DataFrame, text: str, vector: str, digest: str) -> DataFrame:
    """``table`` with ``is_stale``: the vector was made from another text than the row has now (``digest`` is the SHA-256 of
    the text it was made from)."""
    changed = F.col(vector).isNotNull() & ~F.sha2(text, 256).eqNullSafe(F.col(digest))
    return table.withColumn("is_stale", changed)


def fill_missing(table: DataFrame, column: str, value: Column, needs: str) -> DataFrame:
    """Set ``column`` where it is NULL and ``needs`` is present."""
    empty = F.col(column).isNull() & F.col(needs).isNotNull()
    return table.withColumn(column, F.when(empty, value).otherwise(F.col(column)))
