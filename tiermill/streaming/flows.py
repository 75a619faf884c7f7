"""Incremental flows: the batch transforms run under Structured Streaming."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tiermill.operators import scd
from tiermill.session import brief_shuffles, shared_dir, stored
from tiermill.sources.tables import Folder, VersionedTable, refresh_derived, replace_partitions

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_disk_state(spark: SparkSession) -> None:
    """Keep streaming state on disk, so that it may outgrow executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# -- sources ------------------------------------------------------------------


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder, each read once; the checkpoint holds the offset."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Order events with their topic, partition and offset.

    Needs the Kafka connector package on the session's class path.
    """
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )
    return raw.select(
        F.col("key").cast("string").alias("event_id"),
        F.col("topic").alias("kafka_topic"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("timestamp").alias("event_timestamp"),
        F.col("value").cast("string").alias("event_payload"),
    )


# -- triggers ------------------------------------------------------------------


def _trigger(every: str | None) -> dict:
    """A lag such as ``5 minutes``, or everything available now and then stop."""
    return {"processingTime": every} if every else {"availableNow": True}


# -- flows -------------------------------------------------------------------------


def refresh_versions(
    stream: DataFrame,
    conform: Callable[[DataFrame], DataFrame],
    table: VersionedTable,
    checkpoint: str,
    every: str | None = "5 minutes",
    derive: tuple[Callable[[DataFrame], DataFrame], str] | None = None,
    row_by_row: bool = False,
) -> StreamingQuery:
    """Keep a versioned Silver table fresh, and a table derived from it.

    Each micro-batch is conformed, written once and applied under its number (see ``VersionedTable``). ``derive`` makes
    another table (a fact, in the given folder) from the open versions of the touched parts: an updated or late row replaces
    what it changes there (``row_by_row``: without a shuffle of its own, see ``refresh_derived``). A replayed micro-batch puts
    the same result in place again. A table is bound to the checkpoint that started it. The micro-batch's copy and the shuffle
    files go when they have been read, so a flow's disk does not add up over its micro-batches.
    """
    owner = hashlib.md5(checkpoint.encode()).hexdigest()

    def apply_batch(batch: DataFrame, number: int) -> None:
        copy = shared_dir(table.spark, "micro-batch")
        with brief_shuffles(table.spark, batch.sparkSession):
            try:
                touched = table.refresh(table.staged(conform(batch).drop(*scd.VERSION_COLUMNS), copy), number, owner)
            finally:
                Folder(table.spark, copy).delete()
            if derive:
                refresh_derived(touched, *derive, table.key, row_by_row)

    return (
        stream.writeStream.foreachBatch(apply_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def append_to(stream: DataFrame, path: str, checkpoint: str, every: str | None, partition_by: list[str] | None = None) -> StreamingQuery:
    """Append a stream to Parquet files, each row exactly once."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start(path)


def parse_events(events: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Payload text to typed columns; ``is_rejected`` marks unreadable payloads.

    ``fields`` maps a column to ``type path``, e.g. ``{"k": "int $.k"}``.
    """
    parsed = events.withColumn("_payload", F.try_parse_json("event_payload"))
    typed = {}
    for name, spec in fields.items():
        kind, path = spec.split(" ", 1)
        typed[name] = F.try_variant_get("_payload", path, kind)
    return parsed.withColumns({**typed, "is_rejected": F.col("_payload").isNull()}).drop("_payload")


def daily_counts(events: DataFrame) -> DataFrame:
    """Events per day and type, a repeated event id of a day and type counted once."""
    day = F.to_date("event_timestamp").alias("event_date")
    return events.select(day, "event_type", "event_id").distinct().groupBy("event_date", "event_type").agg(
        F.count("*").alias("n_events")
    )


IDS = "event_id string, event_type string, event_date date, slot string, batch bigint"
#: So many slots of a batch are looked up by name; more are joined.
NAMED_SLOTS = 2_000


def _ids(spark: SparkSession, root: str, before: int) -> DataFrame | None:
    """Ids that earlier batches brought."""
    if not Folder(spark, f"{root}/ids").exists():
        return None
    return spark.read.schema(IDS).parquet(f"{root}/ids").where(F.col("batch") < before)


def refresh_daily_counts(
    stream: DataFrame, root: str, checkpoint: str, every: str | None = "5 minutes", buckets: int = 16
) -> StreamingQuery:
    """Keep the daily counts of an event stream, in whatever order its rows come.

    The ids of a day lie in ``buckets`` slots by their hash (events without a timestamp are a day of their own). A micro-batch
    is compared with the ids of its own slots only, whether its days are long past or not, and what is new is added: the ids
    to their slots, and their number to ``counts`` as the batch's part of each day and type. No day is counted again and
    nothing waits for a watermark. A late row corrects its day, a repeated one changes nothing; a replay finds the same rows
    new and writes the same parts. ``batches`` tells for each batch its rows, those that are new and the ids compared.
    """

    def apply_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        day = F.to_date("event_timestamp")
        bucket = F.pmod(F.xxhash64("event_id"), F.lit(buckets)).cast("string")
        slot = F.concat_ws(".", F.coalesce(day.cast("string"), F.lit("none")), bucket)
        rows = stored(batch.select("event_id", "event_type", day.alias("event_date"), slot.alias("slot")).distinct(), "events")
        earlier, compared, fresh = _ids(spark, root, number), 0, rows
        if earlier is not None:
            slots = [r[0] for r in rows.select("slot").distinct().limit(NAMED_SLOTS + 1).collect()]
            if len(slots) <= NAMED_SLOTS:
                earlier = earlier.where(F.col("slot").isin(slots))
            else:
                earlier = earlier.join(rows.select("slot").distinct(), "slot", "left_semi")
            compared = earlier.count()
            old = earlier.select(F.col("slot").alias("s"), F.col("event_id").alias("i"), F.col("event_type").alias("t"))
            same = (F.col("slot") == F.col("s")) & F.col("event_id").eqNullSafe(F.col("i")) & F.col("event_type").eqNullSafe(F.col("t"))
            fresh = rows.join(old, same, "left_anti")
        fresh = stored(fresh.withColumn("batch", F.lit(number).cast("long")), "events-new")
        replace_partitions(fresh, f"{root}/ids", ["slot", "batch"])
        counts = fresh.groupBy("event_date", "event_type", "batch").agg(F.count("*").alias("n_events"))
        replace_partitions(counts, f"{root}/counts", ["batch"])
        told = spark.range(1).select(
            F.lit(rows.count()).cast("long").alias("rows"), F.lit(fresh.count()).cast("long").alias("fresh"),
            F.lit(compared).cast("long").alias("compared"), F.lit(number).cast("long").alias("batch"),
        )
        replace_partitions(told, f"{root}/batches", ["batch"])

    return (
        stream.writeStream.foreachBatch(apply_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def compact_daily_ids(spark: SparkSession, root: str, upto: int) -> None:
    """Put the ids of all batches up to a finished one in one file a slot, between two refreshes. If it is interrupted some ids
    stand twice, which changes no count."""
    found = _ids(spark, root, upto + 1)
    if found is None:
        return
    rows = stored(found.withColumn("batch", F.lit(upto).cast("long")).distinct(), "events-compacted")
    replace_partitions(rows, f"{root}/ids", ["slot", "batch"])
    for name in Folder(spark, f"{root}/ids").names():
        for batch in Folder(spark, f"{root}/ids/{name}").values("batch"):
            if batch < upto:
                Folder(spark, f"{root}/ids/{name}/batch={batch}").delete()


def read_daily_counts(spark: SparkSession, root: str) -> DataFrame:
    """Events per day and type: the sum of what the batches found new."""
    parts = spark.read.schema("event_type string, n_events bigint, event_date date, batch bigint").parquet(f"{root}/counts")
    return parts.groupBy("event_date", "event_type").agg(F.sum("n_events").alias("n_events"))


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    """Rows of each batch, how many were new, and how many ids it was compared with."""
    return spark.read.schema("rows bigint, fresh bigint, compared bigint, batch bigint").parquet(f"{root}/batches")
