"""File landing: delimited and JSON scans, lenient loads, schema alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiermill.reference import NULL_TOKENS

METADATA_COLUMNS = ["load_id", "load_timestamp", "load_date", "is_deleted", "change_type", "raw_record"]
CORRUPT = "_corrupt_record"


def blank_to_null(df: DataFrame, tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """Text that stands for a missing value becomes NULL."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != CORRUPT]
    return df.withColumns({c: F.when(~F.col(c).isin(tokens), F.col(c)) for c in text})


def _parse(column: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.try_to_date(F.col(column))
    return F.col(column) if isinstance(kind, T.StringType) else F.col(column).try_cast(kind)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Delimited scan: header skipped, optional quotes, null tokens, dates parsed.

    Fields are read as text and parsed afterwards, because the reader accepts
    only one null token of its own.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.schema(as_text).option("header", header).option("quote", '"').option("escape", '"').csv(path)
    return blank_to_null(raw).select(*[_parse(f.name, f.dataType).alias(f.name) for f in schema.fields])


def read_json(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """JSON scan; a file may be one array of objects.

    A file with an outer array cannot be split, so land such data as many
    files. Without ``multi_line`` a file holds one object per line and is split freely.
    """
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def load_lenient(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Positional load that never stops on bad input.

    Returns the loaded rows, where a field that does not parse is NULL, with
    the file they came from; and the lines whose shape is wrong.
    """
    fields = [T.StructField(f.name, T.StringType()) for f in schema.fields]
    raw = (
        spark.read.schema(T.StructType([*fields, T.StructField(CORRUPT, T.StringType())]))
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)  # a line's shape is judged on all its fields
        .csv(path)
        .withColumn("file_name", F.col("_metadata.file_name"))
    )
    good = blank_to_null(raw.where(F.col(CORRUPT).isNull()))
    loaded = good.select(*[_parse(f.name, f.dataType).alias(f.name) for f in schema.fields], "file_name")
    bad = raw.where(F.col(CORRUPT).isNotNull()).select(
        F.col(CORRUPT).alias("record_data"),
        F.to_json(F.struct(*schema.names)).alias("parsed_fields"),
        "file_name",
        F.lit("MALFORMED_LINE").alias("rejection_reason"),
    )
    return loaded, bad


def recode(column: Column, codes: dict[str, str], width: int) -> Column:
    """Replace known codes, then cut to the target width."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.substring(F.coalesce(table[column], column), 1, width)


def align(
    df: DataFrame,
    target: list[str],
    recodes: dict[str, tuple[dict[str, str], int]] | None = None,
    max_width: int = 200,
) -> DataFrame:
    """Fit a frame to a target table by column name.

    Names are upper-cased, coded columns recoded, text cut to ``max_width``,
    and only target columns that the frame has are kept, in target order.
    Missing values stay NULL.
    """
    upper = df.toDF(*[c.upper() for c in df.columns])
    recodes = {name.upper(): rule for name, rule in (recodes or {}).items()}
    kinds = dict(upper.dtypes)
    skipped = {c.upper() for c in METADATA_COLUMNS}
    kept = [c.upper() for c in target if c.upper() in kinds and c.upper() not in skipped]

    def fitted(name: str) -> Column:
        value = recode(F.col(name), *recodes[name]) if name in recodes else F.col(name)
        return (F.substring(value, 1, max_width) if kinds[name] == "string" else value).alias(name)

    return upper.select(*[fitted(c) for c in kept])


def cut_values(
    df: DataFrame,
    key: str,
    target: list[str],
    recodes: dict[str, tuple[dict[str, str], int]] | None = None,
    max_width: int = 200,
) -> DataFrame:
    """The values that ``align`` cuts: ``key``, ``column_name``, ``value`` as it came and ``kept`` as it was loaded."""
    whole = align(df, target, {n: (codes, 2**31 - 1) for n, (codes, _) in (recodes or {}).items()}, 2**31 - 1)
    widths = {n.upper(): min(w, max_width) for n, (_, w) in (recodes or {}).items()}
    text = [n for n, kind in whole.dtypes if kind == "string"]
    found = F.array(
        *[
            F.struct(F.lit(n).alias("column_name"), F.col(n).alias("value"), F.substring(n, 1, widths.get(n, max_width)).alias("kept"))
            for n in text
        ]
    )
    cut = F.filter(found, lambda x: x["value"] != x["kept"])
    return whole.select(F.col(key.upper()).alias(key), F.inline(cut))


def stamp(df: DataFrame, run_ts, batch_id: str | None = None, change_type: str = "INSERT") -> DataFrame:
    """Add the landing metadata; the untouched row is kept as JSON."""
    at = F.lit(run_ts)
    raw = F.to_json(F.struct(*df.columns))
    batch = {"batch_id": F.lit(batch_id)} if batch_id is not None else {}
    return df.withColumns(
        {
            "raw_record": raw,
            "load_id": F.uuid(),
            "load_timestamp": at,
            "load_date": F.to_date(at),
            "is_deleted": F.lit(False),
            "change_type": F.lit(change_type),
            **batch,
        }
    )
