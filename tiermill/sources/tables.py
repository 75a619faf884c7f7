"""Table sinks on plain Parquet folders: clustered appends, and versions whose refresh follows the batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tiermill.operators import scd
from tiermill.session import brief_shuffles, shared_dir

AT, DIGEST = "effective_from", "hash_diff"
#: Hash keys are digits: this writes them as half the bytes that Spark's default does.
SMALL = {"compression": "zstd"}


def append(df: DataFrame, path: str, partition_by: list[str], sort_by: list[str] | None = None) -> None:
    """Append rows under date folders, sorted inside each file for range pruning.

    ``rebalance`` gathers the rows of a date to write few files, and lets AQE
    split a date that holds most of the rows over several tasks.
    """
    laid_out = df.hint("rebalance", *partition_by)
    if sort_by:
        laid_out = laid_out.sortWithinPartitions(*partition_by, *sort_by)
    laid_out.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str], together: bool = False, **options: str) -> None:
    """Write ``df`` over the partitions it has rows of; the others stay. ``together`` says that rows of a partition lie in few
    tasks already and need not move. ``options`` go to the writer."""
    laid_out = df if together else df.hint("rebalance", *partition_by)
    writer = laid_out.write.mode("overwrite").options(partitionOverwriteMode="dynamic", **options)
    writer.partitionBy(*partition_by).parquet(path)


class Folder:
    """A folder of whatever storage the session knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._files.exists(self._path)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._path)) if self.exists() else []

    def values(self, key: str) -> list[int]:
        """Numbers of the sub-folders called ``key=number``."""
        return sorted(int(n.split("=")[1]) for n in self.names() if n.startswith(f"{key}="))

    def delete(self) -> None:
        self._files.delete(self._path, True)


class VersionedTable:
    """Versions of every key (see ``scd``), split so that a refresh costs what its batch touches.

    The last version of a key is open, the ones before are closed. Closed versions are only ever added:
    ``closed/ended=<month>/batch=<number>``. Open ones, one a key, lie in ``open/parts=<count>/part=<hash of the key>``; a
    refresh rewrites the parts its keys are in by a dynamic partition overwrite. There are as many parts as keep each below
    ``rows_per_part``; where the table outgrows them, the next refresh doubles their number. A late row may change closed
    versions: the old ones are listed in ``superseded``, and only months from the late row on are read for it.

    A refresh first writes its result to ``pending`` and then puts it in place. A refresh that was interrupted, or comes again
    with the same number, only repeats the second step, so nothing is lost or applied twice. Readers and refreshes take turns;
    for readers at any time merge ``scd.changes`` into a table format instead. A table belongs to the flow that started it.

    Rows move once in a refresh, to the part of their key; ``pending`` is laid out by parts, so what is put in place from it does
    not move again. ``computed`` has columns made from other columns of the row, such as hash keys. They are stored with the
    versions, but made again where they are needed instead of moved or written on the way.
    """

    OPEN, CLOSED, SUPERSEDED = "open", "closed", "superseded"
    #: Rows of a refresh that one task should work on; a part with more is dealt to several.
    ROWS_PER_TASK = 250_000
    #: Rows of a key up to which they are one window.
    MOST = 100_000

    def __init__(
        self, spark: SparkSession, root: str, key: str, rows_per_part: int = 1_000_000, computed: dict[str, Column] | None = None
    ):
        self.spark, self.root, self.key, self.rows_per_part = spark, root.rstrip("/"), key, rows_per_part
        self.computed = computed or {}

    def staged(self, rows: DataFrame, path: str) -> DataFrame:
        """Rows of a batch written to a folder and read back, computed columns made again."""
        bare = rows.drop(*self.computed)
        bare.write.options(**SMALL).parquet(path)
        return rows.sparkSession.read.schema(bare.schema).parquet(path).withColumns(self.computed).select(rows.columns)

    def folder(self, *names: str) -> Folder:
        return Folder(self.spark, "/".join([self.root, *names]))

    def parts(self) -> int:
        """Into how many parts the open versions are split; none yet for a new table."""
        return max(self.folder(self.OPEN).values("parts"), default=0)

    def part_of(self, parts: int):
        return F.pmod(F.xxhash64(self.key), F.lit(parts)).cast("int")

    def _schema(self) -> StructType:
        """Columns of a version, from any file there is."""
        found = self.spark.read.parquet(self.folder(self.OPEN, f"parts={self.parts()}").path).schema
        return StructType([f for f in found.fields if f.name != "part"])

    def open(self, parts: list[int] | None = None) -> DataFrame | None:
        """The last version of every key, of some parts only if asked."""
        count = self.parts()
        if not count:
            return None
        rows = self.spark.read.schema(self._schema().add("part", "integer")).parquet(self.folder(self.OPEN, f"parts={count}").path)
        return (rows if parts is None else rows.where(F.col("part").isin(parts))).drop("part")

    def _closed(self, since: str | None = None) -> DataFrame | None:
        """Closed versions that hold, with their month and batch."""
        if not self.folder(self.CLOSED).exists():
            return None
        schema = self._schema().add("ended", "string").add("batch", "long")
        rows = self.spark.read.schema(schema).parquet(self.folder(self.CLOSED).path)
        if since:
            rows = rows.where(F.col("ended") >= since)
        if not self.folder(self.SUPERSEDED).exists():
            return rows
        names = [self.key, "effective_from", "batch"]
        schema = StructType([rows.schema[c] for c in names]).add("by_batch", "long")
        gone = self.spark.read.schema(schema).parquet(self.folder(self.SUPERSEDED).path)
        return rows.join(gone.drop("by_batch"), names, "left_anti")

    def read(self) -> DataFrame | None:
        """All versions."""
        rows, closed = self.open(), self._closed()
        if rows is None or closed is None:
            return rows
        return rows.unionByName(closed.drop("ended", "batch"))

    def _pending(self, owner: str, number: int) -> Folder:
        owners = self.folder("pending").names()
        if owners and owners != [owner]:
            raise ValueError(f"{self.root} belongs to {owners[0]}, not to {owner}")
        numbers = self.folder("pending", owner).values("batch")
        if numbers and number < numbers[-1]:
            raise ValueError(f"batch {number} of {self.root} comes after batch {numbers[-1]}")
        return self.folder("pending", owner, f"batch={number}")

    def refresh(self, rows: DataFrame, number: int, owner: str = "refresh") -> DataFrame:
        """Apply a batch of rows (see ``scd.apply``). Gives the open versions of all touched parts, with ``parts`` and ``part``."""
        pending = self._pending(owner, number)
        with brief_shuffles(self.spark, rows.sparkSession):
            if "_SUCCESS" not in pending.names():
                work = shared_dir(self.spark, "refresh")
                try:
                    result = self._result(rows, work)
                    result.write.mode("overwrite").options(**SMALL).partitionBy("kind", "part").parquet(pending.path)
                finally:
                    Folder(self.spark, work).delete()
                schema = result.schema
            else:
                schema = self.spark.read.parquet(pending.path).schema
            return self._put(self.spark.read.schema(schema).parquet(pending.path), number, owner)

    def _needed(self, rows: int) -> int:
        return 1 << max(0, -(-rows // self.rows_per_part) - 1).bit_length()

    def _result(self, rows: DataFrame, work: str) -> DataFrame:
        """What the batch makes of the parts it touches, and the closed versions it adds and supersedes, without computed columns:
        ``kind``, ``part`` of an open version, the number of parts, and ``gone_batch`` of a superseded one.

        Which keys the batch has is noted by their 64-bit hash. Another key with the same hash lies in the same part and is
        only built once more from its own versions, which changes nothing. Open versions without a key, or of a key all of whose
        rows in the batch have no time, are kept as they are beside what the batch gives.
        """

        def noted(df: DataFrame, name: str) -> DataFrame:
            df.write.options(**SMALL).parquet(f"{work}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{work}/{name}")

        hashed, no_key = F.xxhash64(self.key).alias("_h"), F.col(self.key).isNull()
        no_time = F.max(no_key | F.col(AT).isNull()).alias("_odd")
        starts = noted(rows.groupBy(hashed).agg(F.min(AT).alias("_start"), F.count("*").alias("_n"), no_time), "starts")
        keys, many, most, odd = starts.agg(
            F.count("*"), F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0)), F.max("_odd")
        ).first()
        gone, old, opened = None, self.parts(), self.open()
        if opened is None:
            # One version of each key is open.
            parts = places = self._needed(keys)
        else:
            # Counted from file footers.
            count = opened.count()
            parts = max(old, self._needed(count))
            touched = None if parts > old else [r[0] for r in starts.select(F.pmod("_h", F.lit(old)).cast("int")).distinct().collect()]
            places = parts if touched is None else max(1, len(touched))
            many += count if touched is None else count * places // old
            opened = self.open(touched)
            odd = odd or not opened.where(no_key | F.col(AT).isNull()).isEmpty()
            if self.folder(self.CLOSED).exists():
                late = opened.where(~no_key).select(hashed, AT).join(starts.select("_h", "_start"), "_h").where(F.col("_start") <= F.col(AT))
                late = noted(late.select("_h", "_start").distinct(), "late")
                first = late.agg(F.date_format(F.min("_start"), "yyyy-MM")).first()[0]
                closed = self._closed(since=first) if first else None
                if closed is not None:
                    gone = closed.where(~no_key).withColumn("_h", hashed).join(late, "_h").where(F.col("effective_to") >= F.col("_start"))
                    gone = noted(gone.drop("_start", "ended"), "superseded")
                    many += gone.count()
                    most = max(most, gone.groupBy("_h").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])

        names = [c for c in (rows if opened is None else opened).columns if c not in scd.VERSION_COLUMNS]
        first = [self.key, AT, DIGEST]
        bare = [c for c in names if c not in self.computed]
        place = self.part_of(parts * (1 << max(0, -(-many // (places * self.ROWS_PER_TASK)) - 1).bit_length())).alias("_place")
        # Half of it may be stored versions, half new rows; and there is one open version.
        busy, odd = 2 * most + 1 > self.MOST, bool(odd) and opened is not None
        calm = None
        if busy and odd:
            begun = noted(rows.groupBy(self.key).agg(F.min(AT).alias("_start")), "begun")
            marked = opened.join(begun, self.key, "left")
            calm, opened = marked.where(F.col("_start").isNull()).drop("_start"), marked.where(F.col("_start").isNotNull())
        version, new = F.col("record_version").alias("_stored"), F.lit(None).cast("int").alias("_stored")
        sides = [(df, number, at) for number, (df, at) in enumerate([(opened, version), (gone, version), (rows, new)]) if df is not None]
        sides = [df.select(*bare, place, at, F.lit(number).alias("_side")) for df, number, at in sides]
        met = sides[0]
        for side in sides[1:]:
            met = met.unionByName(side)
        dealt = met if busy else met.repartition("_place")
        dealt = dealt.withColumns({c: made for c, made in self.computed.items() if c in first})
        dealt = dealt.select(*[c for c in names if c in dealt.columns], "_place", "_stored", "_side")
        if busy:
            versions = scd.build(dealt.drop("_place", "_side"), self.key, first_version="_stored", most=self.MOST)
            if calm is not None:
                versions = versions.unionByName(calm.select(versions.columns))
        else:
            places = ("_place",)
            if odd:
                met_here = Window.partitionBy("_place", self.key)
                start = F.min(F.when(F.col("_side") == 2, F.col(AT))).over(met_here)
                alone = (F.col("_side") == 0) & (no_key | start.isNull()) & ~F.max(F.col("_side") == 1).over(met_here)
                dealt = dealt.withColumn("_alone", alone).withColumn(
                    "_unit", F.when(F.col("_alone"), F.monotonically_increasing_id() + 1).otherwise(0)
                )
                places = ("_place", "_unit")
            versions = scd.build_in_place(dealt.drop("_alone", "_side"), self.key, places, first_version="_stored")
        body = [*[c for c in versions.columns if c in bare], *scd.VERSION_COLUMNS]
        current, no_part = F.col("is_current"), F.lit(-1)
        open_or_closed = {
            "kind": F.when(current, self.OPEN).otherwise(self.CLOSED), "part": F.when(current, self.part_of(parts)).otherwise(no_part),
            "parts": F.lit(parts), "gone_batch": F.lit(None).cast("long"),
        }
        result = versions.withColumns(open_or_closed).select(*body, *open_or_closed)
        if gone is not None:
            listed = {"kind": F.lit(self.SUPERSEDED), "part": no_part, "parts": F.lit(parts), "gone_batch": F.col("batch")}
            result = result.unionByName(gone.withColumns(listed).select(*body, *listed))
        return result.hint("rebalance", "kind", "part") if busy else result

    def _whole(self, bare: DataFrame, *more: str) -> DataFrame:
        """Versions with their computed columns."""
        first, last = [self.key, AT, DIGEST], [*scd.VERSION_COLUMNS, *more]
        middle = [c for c in [*bare.columns, *self.computed] if c not in (*first, *last)]
        return bare.withColumns(self.computed).select(*first, *middle, *last)

    def _put(self, pending: DataFrame, number: int, owner: str) -> DataFrame:
        """Put a written result in place; doing so again changes nothing."""
        for done in self.folder("pending", owner).values("batch"):
            if done < number:
                self.folder("pending", owner, f"batch={done}").delete()
        rows = pending.where(F.col("kind") == self.OPEN).drop("kind", "gone_batch")
        placed = self._whole(rows, "parts", "part")
        parts = rows.select("parts").first()
        if parts is None:
            return placed
        replace_partitions(placed, self.folder(self.OPEN).path, ["parts", "part"], together=True, **SMALL)
        ended = pending.where(F.col("kind") == self.CLOSED).drop("kind", "parts", "part", "gone_batch")
        if not ended.isEmpty():
            ended = ended.withColumns({"ended": F.date_format("effective_to", "yyyy-MM"), "batch": F.lit(number).cast("long")})
            ended = self._whole(ended.hint("rebalance", "ended", "batch"), "ended", "batch")
            replace_partitions(ended, self.folder(self.CLOSED).path, ["ended", "batch"], together=True, **SMALL)
        gone = pending.where(F.col("kind") == self.SUPERSEDED)
        if not gone.isEmpty():
            gone = self._whole(gone, "gone_batch").select(
                self.key, AT, F.col("gone_batch").alias("batch"), F.lit(number).cast("long").alias("by_batch")
            )
            replace_partitions(gone, self.folder(self.SUPERSEDED).path, ["by_batch"], **SMALL)
        for count in self.folder(self.OPEN).values("parts"):
            if count < parts[0]:
                self.folder(self.OPEN, f"parts={count}").delete()
        return placed


def refresh_derived(rows: DataFrame, make, path: str, key: str, row_by_row: bool = False) -> None:
    """Rewrite the parts of a table that ``make`` derives from open versions, for what a refresh gave. The derived rows have
    the key; a part of which nothing is left is removed. ``row_by_row`` says that ``make`` shuffles nothing, so that rows are
    still where the refresh laid them and are written without being moved."""
    counts = rows.select("parts").first()
    if counts is None:
        return
    place = F.pmod(F.xxhash64(key), F.lit(counts[0])).cast("int")
    made = make(rows.drop("parts", "part")).withColumns({"parts": F.lit(counts[0]), "part": place})
    replace_partitions(made, path, ["parts", "part"], together=row_by_row, **SMALL)
    spark = rows.sparkSession
    # Asked of the versions again, of which only the key and what rows are chosen by is read.
    left = {r[0] for r in made.select("part").distinct().collect()}
    for part in {r[0] for r in rows.select("part").distinct().collect()} - left:
        Folder(spark, f"{path}/parts={counts[0]}/part={part}").delete()
    for count in Folder(spark, path).values("parts"):
        if count < counts[0]:
            Folder(spark, f"{path}/parts={count}").delete()
