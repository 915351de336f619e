"""Readers and writers: repaired CSV, globbed files, first existing and optional sources, partitioned, appending and upserting sinks."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv_scan(spark: SparkSession, path: str | Sequence[str], schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")


def header_columns(text: Column) -> Column:
    """Number of columns in the first line."""
    return F.size(F.split(F.regexp_replace(F.substring_index(text, "\n", 1), "\r", ""), ","))


#: A field before the last: quoted, closed only by a quote that a comma follows, or bare. The last field: closed only by a quote at the end of a line.
_FIELD = r'(?:"[^"]*+(?:(?:""|"(?!,))[^"]*+)*+"|[^",\r\n][^,\r\n]*+|),'
_LAST = r'(?:"[^"]*+(?:(?:""|"(?!\r|\n|\z))[^"]*+)*+"(?=\r|\n|\z)|[^",\r\n][^,\r\n]*+(?=\r|\n|\z)|(?=\r|\n|\z))'


def records(text: Column) -> Column:
    """The records of a CSV file as an array, quoted line breaks and all; what is no record with the header's number of columns comes line by line."""
    head = F.repeat(F.lit(_FIELD), header_columns(text) - 1)
    found = F.regexp_extract_all(text, F.concat(F.lit("(?m)^(?:"), head, F.lit(_LAST + r")|[^\r\n]++")), F.lit(0))
    return F.filter(found, lambda r: r != "")


def one_line(field: Column) -> Column:
    """A raw field with its quoted line breaks as blanks and its inner quotes doubled."""
    inner = F.regexp_replace(F.substring(field, F.lit(2), F.length(field) - 2), r"\r\n|\r|\n", " ")
    return F.when(field.startswith('"') & field.endswith('"') & (F.length(field) >= 2), F.concat(F.lit('"'), F.replace(F.replace(inner, F.lit('""'), F.lit('"')), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(field)


def repaired_lines(files: DataFrame) -> DataFrame:
    """(path, n, line) of the records of whole files (path, value), each as one line; the header is line 0.

    Line breaks inside quotes become blanks and stray quotes are doubled. A quote's state runs through a file, so a file is one row. Null and empty files have no lines.
    """
    sized = files.select("path", header_columns(F.col("value")).alias("_k"), F.posexplode(records(F.col("value"))).alias("n", "r"))
    front = F.call_function("regexp_extract", F.col("r"), F.concat(F.lit("^(?:"), F.repeat(F.lit(_FIELD), F.col("_k") - 1), F.lit(")")), F.lit(0))
    parts = sized.withColumn("_front", front).withColumn("_fields", F.when(F.col("_k") > 1, F.regexp_extract_all("_front", F.lit("(" + _FIELD + ")"), F.lit(1))).otherwise(F.array().cast("array<string>")))
    first = F.transform("_fields", lambda f: F.concat(one_line(F.substring(f, F.lit(1), F.length(f) - 1)), F.lit(",")))
    last = one_line(F.substring(F.col("r"), F.length("_front") + 1, F.length("r")))
    return parts.select("path", F.col("n").cast("bigint").alias("n"), F.concat(F.array_join(first, ""), last).alias("line"))


def repaired_csv(spark: SparkSession, path: str, schema: str, warn_above: float = 0.05) -> DataFrame:
    """Rows of malformed CSV files; lines that still don't parse are left out, with a warning if they are more than warn_above of all."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = repaired_lines(files).filter("n > 0")
    parsed = lines.select(F.from_csv("line", F.lit(schema + ", _bad string"), {"escape": '"', "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    share = parsed.agg(F.avg(F.col("r._bad").isNotNull().cast("int"))).first()[0] or 0.0
    if share > warn_above:
        warnings.warn(f"{share:.1%} of the lines of {path} don't parse", stacklevel=2)
    return parsed.filter("r._bad IS NULL").select("r.*").drop("_bad")


def entity_of_file(pattern: str) -> Column:
    """What the pattern's first group holds in the name of the file a row comes from."""
    return F.regexp_extract(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), pattern, 1)


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs
    for c in candidates:
        path = hadoop.Path(c)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return c
    raise FileNotFoundError(f"none of {list(candidates)} exists")


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table, or an empty one of that schema."""
    try:
        return spark.read.schema(schema).parquet(first_existing(spark, [path]))
    except FileNotFoundError:
        return spark.createDataFrame([], schema)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of an order."""
    return df.orderBy(*order).limit(n)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("dataset", "condition"), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_vectors(df: DataFrame, path: str, key: str, vector: str, mode: str = "overwrite") -> None:
    """(key, vector ARRAY<FLOAT>) as Parquet; vectors of different lengths are an error, null ones stay null."""
    size = df.agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).first()
    if size["a"] is not None and size["a"] != size["b"]:
        raise ValueError(f"vectors of {size['a']} to {size['b']} numbers")
    df.select(key, F.col(vector).cast("array<float>").alias(vector)).write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, escape='"')


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Appends the rows whose keys the table does not hold yet."""
    spark = df.sparkSession
    old = optional(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))
    df.join(old.select(*keys).distinct(), list(keys), "left_anti").write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str, dry_run: bool = False) -> int:
    """Writes df beside the table and swaps the folders on their own file system, the old one staying as path.bak (an earlier backup goes); with dry_run only counts."""
    rows = df.count()
    if dry_run:
        return rows
    df.write.mode("overwrite").parquet(path + ".new")
    spark = df.sparkSession
    here, new, old = (spark._jvm.org.apache.hadoop.fs.Path(path + x) for x in ("", ".new", ".bak"))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(here):
        fs.delete(old, True)
        moved = fs.rename(here, old)
        if not moved:
            raise OSError(f"cannot move {path} away")
    if not fs.rename(new, here):
        raise OSError(f"cannot move the new table to {path}")
    return rows


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def key_values(df: DataFrame) -> DataFrame:
    """(metric, value) rows of a one-row table."""
    cast = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    return cast.unpivot([], cast.columns, "metric", "value")


def html_threads(html: Column) -> dict[str, Column]:
    """Title, date and first post of a forum page; quoted blocks are left out, tags become line breaks."""
    title = F.trim(F.regexp_extract(html, r"(?is)<(?:h1|title)[^>]*>(.*?)</(?:h1|title)>", 1))
    body = F.regexp_extract(html, r"(?is)<div[^>]*post_message[^>]*>(.*?)</div>", 1)
    body = F.regexp_replace(body, r"(?is)<blockquote.*?</blockquote>", "")
    return {"title": title, "date": F.regexp_extract(html, r"(\d{4}-\d{2}-\d{2})", 1), "post": F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]+>", "\n"), r"\n{2,}", "\n"), r"^\s+|\s+\z", "")}


def sampled_ids(spark: SparkSession, low: int, high: int, n: int, seed: int) -> DataFrame:
    """n ids of a range in a seeded order."""
    return spark.range(low, high + 1).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))), "id").limit(n)


def annotate(df: DataFrame, call, schema: str) -> DataFrame:
    """Rows through an injected callable (rows of a batch -> rows), for models outside this engine; tasks that fail are retried by Spark."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame(call(f.to_dict("records")))

    return df.mapInPandas(run, schema)


def markdown_table(df: DataFrame, rows: int = 1000) -> str:
    """A report as text, of at most rows rows."""
    got = df.limit(rows).collect()
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(json.dumps(v, default=str, ensure_ascii=False) if not isinstance(v, str) else v for v in r) + " |" for r in got)])
