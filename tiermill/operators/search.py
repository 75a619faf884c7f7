"""Search over texts: index rows, keyword search by scan or by an index of trigrams, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermill.functions.text import contains_any
from tiermill.session import stored

ALL = "All"


def index(entities: DataFrame, entity_type: str, entity_id: Column, name: Column, body: list[Column], metadata: list[str]) -> DataFrame:
    """Index rows: body texts joined by a space, metadata as JSON."""
    return entities.select(
        F.lit(entity_type).alias("entity_type"),
        F.sha2(entity_id.cast("string"), 256).alias("entity_hk"),
        name.alias("entity_name"),
        F.concat_ws(" ", *body).alias("search_body"),
        F.to_json(F.struct(*metadata)).alias("metadata"),
    )


def keyword(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows that contain the query in any of the columns."""
    return df.where(contains_any(query, *[F.col(c) for c in columns]))


def facet_filter(df: DataFrame, choices: dict[str, str]) -> DataFrame:
    """Keep rows of the chosen facet values; ``All`` passes everything."""
    for column, value in choices.items():
        if value != ALL:
            df = df.where(F.col(column) == value)
    return df


def facet_counts(df: DataFrame, facets: list[str]) -> DataFrame:
    """Rows per facet value, all facets in one scan and one shuffle."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])
    return df.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))


# -- an index of trigrams ------------------------------------------------------------

GRAM = 3
#: Rows are numbered within their batch; a posting has one bit for each of the 64 rows whose numbers share all but these bits.
WORD_BITS = 6
NUMBER = "_row"


def _grams(text: Column) -> Column:
    """Distinct character trigrams of a text in lower case."""
    # Every character in turn, with those that follow it.
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))."), F.lit(1)))


def append_texts(df: DataFrame, root: str, columns: list[str], batch: int) -> None:
    """Add rows to a searchable table: the rows under numbers of their own, and for each trigram of ``columns`` and 64 rows the
    bits of those that have it. Neighbouring rows are in one task, so most bits meet before anything moves. The postings of a
    file lie in the order of their trigrams, so a lookup reads few pages. A batch that comes again replaces itself; earlier
    ones are not touched."""
    spark = df.sparkSession
    placed = df.withColumns({NUMBER: F.monotonically_increasing_id(), "batch": F.lit(batch)})
    _write(placed, f"{root}/texts", "batch")
    rows = spark.read.parquet(f"{root}/texts").where(F.col("batch") == batch)
    grams = F.flatten(F.array(*[F.coalesce(_grams(F.col(c)), F.array().cast("array<string>")) for c in columns]))
    postings = (
        rows.select(F.explode(grams).alias("gram"), _word().alias("word"), F.expr(f"shiftleft(1L, {_PLACE})").alias("bit"))
        .groupBy("gram", "word")
        .agg(F.bit_or("bit").alias("rows"))
    )
    _write(postings.withColumn("batch", F.lit(batch)).sortWithinPartitions("batch", "gram", "word"), f"{root}/postings", "batch")


_PLACE = f"CAST({NUMBER} & {(1 << WORD_BITS) - 1} AS INT)"


def _word() -> Column:
    return F.shiftright(NUMBER, WORD_BITS)


def _write(df: DataFrame, path: str, partition: str) -> None:
    """Write a frame over its partitions in the order it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _words(spark: SparkSession, root: str, query: str) -> DataFrame | None:
    """``batch``, ``word`` and the bits of the rows that have every trigram of the query; none where it is too short to have one."""
    text = query.lower()
    wanted = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
    if not wanted:
        return None
    lists = spark.read.parquet(f"{root}/postings").where(F.col("gram").isin(wanted))
    both = lists.groupBy("batch", "word").agg(F.count("*").alias("n"), F.bit_and("rows").alias("rows"))
    return both.where((F.col("n") == len(wanted)) & (F.col("rows") != 0)).drop("n")


def candidates(spark: SparkSession, root: str, query: str) -> DataFrame | None:
    """``batch`` and number of the rows that have every trigram of the query; none where it is too short to have one."""
    words = _words(spark, root, query)
    if words is None:
        return None
    places = F.filter(F.sequence(F.lit(0), F.lit((1 << WORD_BITS) - 1)), lambda i: F.getbit("rows", i) == 1)
    number = F.shiftleft("word", WORD_BITS).bitwiseOR(F.col("place").cast("long"))
    return words.select("batch", "word", F.explode(places).alias("place")).select("batch", number.alias(NUMBER))


def indexed_keyword(spark: SparkSession, root: str, query: str, columns: list[str]) -> DataFrame:
    """Rows that contain the query in any of the columns, as ``keyword`` finds them, by way of the index: only rows with all its
    trigrams are read for it. A query of fewer than three characters reads all rows."""
    texts, found = spark.read.parquet(f"{root}/texts"), _words(spark, root, query)
    if found is None:
        return keyword(texts, query, columns).drop("batch", NUMBER)
    # Stored, so that Spark knows whether they are few enough to be sent to the texts.
    found = stored(found.withColumnsRenamed({"batch": "_batch", "word": "_word", "rows": "_rows"}), "candidates")
    texts = texts.join(found, (F.col("batch") == F.col("_batch")) & (_word() == F.col("_word")))
    # One condition on both sides, so that the texts of other rows are not looked at before the join.
    has = F.when(F.expr(f"getbit(_rows, {_PLACE})") == 1, contains_any(query, *[F.col(c) for c in columns]))
    return texts.where(has).drop("batch", NUMBER, "_batch", "_word", "_rows")
