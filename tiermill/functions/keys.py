"""Hash keys and change digests, as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _norm(value: Column) -> Column:
    return F.upper(F.trim(value))


def hash_key(source: Column, original_id: Column) -> Column:
    """64-character key of a business id, unique across sources."""
    pk = F.coalesce(original_id.cast("string"), F.lit("NULL_PK"))
    return F.sha2(F.concat(_norm(source), F.lit("|"), _norm(pk)), 256)


def packed(key: Column) -> Column:
    """A key as the 32 bytes that its 64 digits stand for; any other text as longer bytes, so different keys stay different."""
    digits = F.unhex(key)
    return F.when((F.length(key) == 64) & (F.lower(F.hex(digits)) == key), digits).otherwise(
        F.concat(F.encode(key, "UTF-8"), F.lit(bytes(33)))
    )


def unpacked(key: Column) -> Column:
    """The text of a packed key."""
    return F.when(F.length(key) == 32, F.lower(F.hex(key))).otherwise(
        F.decode(F.substring(key, F.lit(1), F.length(key) - 33), "UTF-8")
    )


def attributes_text(*parts: Column) -> Column:
    """Attributes joined by ``|``, a missing one counting as empty."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def hash_diff(text: Column) -> Column:
    """Digest that differs whenever any attribute differs."""
    return F.sha2(_norm(F.coalesce(text, F.lit("EMPTY"))), 256)


def register_sql(spark: SparkSession) -> None:
    """Offer both functions to SQL users of this session."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION generate_hash_key(src STRING, pk STRING) RETURNS STRING "
        "RETURN sha2(upper(trim(src)) || '|' || upper(trim(coalesce(pk, 'NULL_PK'))), 256)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION generate_hash_diff(attrs STRING) RETURNS STRING "
        "RETURN sha2(upper(trim(coalesce(attrs, 'EMPTY'))), 256)"
    )
