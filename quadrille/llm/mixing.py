"""Mixing sources to target weights by capped water-filling.

The mix holds `share` times the words of all documents. Each source's part is
proportional to its weight but at most `cap` times the source's words; what a
capped source can't take is shared by weight among the others until none is
above its cap. A source then repeats every document whole as often as its ratio
allows, and takes some once more for the rest: within each bucket of a source,
documents in a seeded order as long as the middle of a document lies below the
bucket's part. Buckets are small and dealt by hash, so a hot source is no hot
task, and a source's error is a fraction of one document for each bucket.

Rows: a null text has no words; documents without words take nothing; the null
source is a source, last in order; sources without words have target 0; rows
that repeat a document are documents of their own; an empty table gives no
rows. Results depend on the rows alone, not on their order or partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.columns import unused

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds target to (source, source_size), one row for each source.

    Sources fill up in the order of cap / weight; the water level at which they
    do is a running sum over the sources, which are few beside the documents.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(place) - 1) % len(weights) + 1)
    limit = F.col("source_size") * F.lit(cap)
    filled = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    level = (total - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    capped = sizes.withColumn("weight", weight).withColumn("level", level).withColumn("full", level * F.col("weight") > limit)
    # Full sources come first; from the first that isn't, levels fall, and its own holds for all the others.
    free = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    return capped.withColumn("target", F.when(F.col("full"), limit).otherwise(free * F.col("weight"))).select("source", "source_size", F.col("target").cast("double"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7, bucket: int = 4096) -> DataFrame:
    """docs with size, source_size, target and times: how often the mix takes the document.

    Columns of docs with these names are replaced.
    bucket: about how many documents one bucket of a source has.
    """
    docs = docs.drop("size", "source_size", "target", "times")
    text, own, n, buckets, place, in_bucket = (unused(docs, x) for x in ("text", "source", "n", "buckets", "rank", "bucket"))
    sized = docs.withColumn("size", word_count("text")).withColumn(text, F.xxhash64("text"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias(n))
    goals = targets(sources.select("source", "source_size"), weights, share, cap)
    plan = goals.join(sources.select(F.col("source").alias(own), n), F.col("source").eqNullSafe(F.col(own))).select(F.col("source").alias(own), "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col(n) / bucket)).alias(buckets))
    rank = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = sized.join(plan, F.col("source").eqNullSafe(F.col(own))).withColumn(place, rank)
    keyed = keyed.withColumn(in_bucket, F.conv(F.substring(place, 1, 8), 16, 10).cast("long") % F.col(buckets))
    inside = Window.partitionBy("source", in_bucket).orderBy(place, text).rowsBetween(Window.unboundedPreceding, 0)
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    whole = F.floor(ratio + 1e-12)
    part = F.sum("size").over(Window.partitionBy("source", in_bucket)) * F.greatest(ratio - whole, F.lit(0.0))
    once = (F.sum("size").over(inside) - F.col("size") / 2 <= part) & (F.col("size") > 0)
    times = F.when(F.col("size") > 0, whole + once.cast("long")).otherwise(0)
    return keyed.withColumn("times", F.least(times, F.lit(int(cap))).cast("long")).drop(own, buckets, in_bucket, place, text)


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of the mix: each document as often as it is taken."""
    copy = unused(mixed, "copy")
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.greatest("times", F.lit(1))))).where(F.col(copy) <= F.col("times")).select(*columns)
