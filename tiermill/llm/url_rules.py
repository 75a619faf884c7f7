"""URL filter by a sort-merge range join on reversed hosts.

A host's labels in reverse order turn "this host and its subdomains" into one interval of a sorted order. URLs and rules are
cut into ranges of that order, every rule goes to each range that its interval meets, and one sweep over a sorted range
keeps the rules whose interval is open on a stack, outer hosts below inner ones. A URL looks for the longest path that fits
it among the open rules.

The ranges are cut at quantiles of a bounded sample of URLs (``SAMPLE_PER_RANGE`` expected for each range, drawn by hash). The sample shapes the
layout only, never the result. URLs are ordered by host, path and a hash of the row, so a host or a single URL that holds a
large share of the rows is spread over several ranges.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; an empty rule host fits
every host; rules that are null or have a verdict outside allow and block are refused; of two fitting rules of the same
length the one with the longer host wins, and of equal rules with different verdicts block wins; repeated rows stay.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermill.llm.common import tasks

SAMPLE_PER_RANGE = 16
RANGES_PER_TASK = 4
END = "\U0010ffff"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

RULE_SCHEMA = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, to the next ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``; an empty host stays empty."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _bounds(keys: DataFrame, ranges: int) -> list[str]:
    """Lower bounds of all ranges but the first, from a sample whose expected size depends on ``ranges`` alone."""
    share = SAMPLE_PER_RANGE * ranges / max(keys.count(), 1)
    drawn = keys.select("_key").where(F.pmod(F.xxhash64("_key"), F.lit(1 << 32)) < share * (1 << 32))
    sample = sorted(row[0] for row in drawn.collect())
    if not sample:
        return []
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)} - {sample[0]})


def _sweep(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Verdicts for the URLs of sorted ranges; rules stand before the URLs of their host."""
    part, stack = None, []
    for frame in rows:
        rules, verdicts = [None] * len(frame), [None] * len(frame)
        columns = zip(frame["_part"], frame["_reversed"], frame["_is_url"], frame["_path"], frame["_verdict"])
        for i, (own, key, is_url, path, verdict) in enumerate(columns):
            if own != part:
                part, stack = own, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if stack and stack[-1][0] == key:
                    known = stack[-1][1]
                    known[path] = "block" if "block" in (known.get(path), verdict) else verdict
                else:
                    stack.append((key, {path: verdict}))
                continue
            best, length = None, -1
            for open_key, paths in reversed(stack):
                # A reversed key has one character more than its host, the empty one excepted.
                width = max(len(open_key) - 1, 0)
                fitting = max((len(p) for p in paths if path.startswith(p)), default=-1)
                if fitting >= 0 and width + fitting > length:
                    length, best = width + fitting, (open_key, path[:fitting], paths[path[:fitting]])
            if best:
                host = ".".join(reversed(best[0][:-1].split(".")))
                rules[i], verdicts[i] = host + best[1], best[2]
        urls = frame["_is_url"].to_numpy(dtype=bool)
        out = frame.drop(columns=["_part", "_reversed", "_is_url", "_verdict", "_key", "_path"])
        yield out.assign(_rule=rules, _found=verdicts)[urls]


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (``default`` if none fits).

    ``rules`` has ``host``, ``path`` and ``verdict``. Columns of ``urls`` with the names of the results are replaced; pass
    narrow rows, as they are sorted.
    """
    spark = urls.sparkSession
    rows = urls.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url])
    names = rows.columns
    # The caller's columns travel as one struct, so that no name can clash.
    source = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("_none"))
    located = rows.select(source.alias("_row"), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"))
    located = located.withColumn("_reversed", reversed_host(F.col("_host"))).withColumn(
        "_key", F.concat("_reversed", F.lit("\u0000"), "_path", F.lit("\u0000"), F.hex(F.xxhash64(F.col("_row"))))
    )
    ranges = RANGES_PER_TASK * tasks(spark)
    bounds = _bounds(located, ranges)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, k) for k in keys], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_of(keys: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_right(bounds, k), bisect_left(bounds, k + END) + 1)) for k in keys])

    row_type = located.schema["_row"].dataType.simpleString()
    checked = rules.select(
        F.lower("host").alias("_host"),
        F.col("path").alias("_path"),
        F.when(F.col("verdict").isin("allow", "block") & F.col("host").isNotNull() & F.col("path").isNotNull(), F.col("verdict"))
        .otherwise(F.raise_error(F.lit("a rule needs a host, a path and the verdict allow or block")).cast("string"))
        .alias("_verdict"),
    )
    opened = checked.withColumn("_reversed", reversed_host(F.col("_host"))).select(
        F.lit(None).cast(row_type).alias("_row"),
        "_host",
        "_path",
        "_reversed",
        F.concat("_reversed", F.lit("\u0000")).alias("_key"),
        F.explode(ranges_of("_reversed")).alias("_part"),
        F.lit(False).alias("_is_url"),
        "_verdict",
    )
    asked = located.withColumns(
        {"_part": range_of("_key"), "_is_url": F.lit(True), "_verdict": F.lit(None).cast("string")}
    )
    ordered = (
        asked.unionByName(opened)
        .withColumn("_url_path", F.col("_path"))
        .repartition(tasks(spark), "_part")
        .sortWithinPartitions("_part", "_reversed", "_is_url", "_key")
    )
    schema = f"_row {row_type}, _host string, _url_path string, _rule string, _found string"
    judged = ordered.mapInPandas(_sweep, schema)
    return judged.select(
        *[F.col("_row").getField(c).alias(c) for c in names],
        F.col("_host").alias("host"),
        F.col("_url_path").alias("path"),
        F.col("_rule").alias("rule"),
        F.coalesce("_found", F.lit(default)).alias("verdict"),
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)
