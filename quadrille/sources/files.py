"""Tables and documents from files: declared CSV, objects by content, text by type."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_csv(spark: SparkSession, path: str, schema: str, columns: dict[str, str], keys: list[str], into: DataFrame | None = None) -> DataFrame:
    """Rows of a CSV with header: columns renamed (new to old) and the first row of each key kept.

    into: rows already loaded; theirs win, so loading twice changes nothing.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    # A file with quoted line ends is read by one task, so numbers grow along it.
    placed = raw.select(*(F.col(old).alias(name) for name, old in columns.items()), F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")).alias("_place"))
    new = placed.groupBy(*keys).agg(*(F.min_by(c, "_place").alias(c) for c in columns if c not in keys)).select(*columns)
    return new if into is None else into.unionByName(new.join(into.select(*keys), keys, "left_anti").select(*into.columns))


def write_report(df: DataFrame, path: str) -> None:
    """A CSV with header and doubled quotes."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def object_key(prefix: str, dataset: str) -> Column:
    """prefix/dataset/document/sha256.ext of binaryFile rows with a document column."""
    ext = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    return F.concat(F.lit(f"{prefix}/{dataset}/"), "document", F.lit("/"), F.sha2("content", 256), ext)


def resolve_object(objects: DataFrame) -> DataFrame:
    """(document, path): a document's first .pdf by path, else its first object."""
    rank = F.struct((~F.lower("path").endswith(".pdf")).alias("other"), F.col("path"))
    return objects.groupBy("document").agg(F.min(rank).alias("m")).select("document", F.col("m.path").alias("path"))


def text_of(files: DataFrame, pdf=None) -> DataFrame:
    """files (path, content) with text: plain text trimmed; PDF by the function given, bytes to text; others null."""
    plain = F.regexp_replace(F.decode("content", "UTF-8"), r"^\s+|\s+$", "")
    out = files.withColumn("text", F.when(F.lower("path").endswith(".txt"), plain))
    if pdf is None:
        return out

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: None if b is None else pdf(bytes(b)))

    is_pdf = F.lower("path").endswith(".pdf")
    return out.withColumn("text", F.when(is_pdf, read(F.when(is_pdf, F.col("content")))).otherwise(F.col("text")))


def discover(spark: SparkSession, root: str, suffix: str = ".pdf", offset: int = 0, limit: int | None = None) -> DataFrame:
    """(path, dataset) of files below root in path order, from an offset on; the data set is the first folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).select("path")
    inner = F.regexp_extract("path", r"([^/]+)/[^/]*$" if root.endswith("*") else rf"{root.rstrip('/').rsplit('/', 1)[-1]}/([^/]+)/", 1)
    out = files.select("path", inner.alias("dataset")).orderBy("path").offset(offset)
    return out if limit is None else out.limit(limit)
