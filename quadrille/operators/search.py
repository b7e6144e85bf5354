"""Text search over an inverted index, and vector search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.plans.lineage import scratch_path


def words_of(text) -> Column:
    """Words of a text in lower case: letters and digits of any script; "" may be among them."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def wanted(phrase: str) -> list[str]:
    found = sorted({w for w in re.split(r"[\W_]+", phrase.lower()) if w})
    if not found:
        raise ValueError("an empty phrase finds nothing")
    return found


def _weight(tf, n, docs, df, mean, k1: float, b: float) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))


def bm25(docs: DataFrame, phrase: str, top: int = 20, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the best documents for a phrase's words; ties go to the smaller key. For a single search.

    A document sends its length and the counts of the phrase's words only, so
    nothing of the size of the corpus is shuffled.
    """
    found = wanted(phrase)
    counts = [_count(w).alias(f"_{i}") for i, w in enumerate(found)]
    sized = docs.select(key, words_of(F.col(text)).alias("_w"))
    tf = sized.select(key, F.size(F.filter("_w", lambda x: x != "")).alias("_n"), *counts)
    stats = tf.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_avg"), *(F.count_if(F.col(f"_{i}") > 0).alias(f"_df{i}") for i in range(len(found))))
    joined = tf.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(found)):
        score = score + F.when(F.col(f"_{i}") > 0, _weight(F.col(f"_{i}"), F.col("_n"), F.col("_docs"), F.col(f"_df{i}"), F.col("_avg"), k1, b)).otherwise(0.0)
    return joined.select(key, F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(top)


def _count(word: str):
    return F.size(F.filter("_w", lambda x: x == word))


class TextIndex:
    """An inverted index, written once: a row (word, key, tf, n) for each word of a document, in word order.

    A search reads the lists of its own words only: files hold words in order, so
    the word filter skips the others by their statistics. What is known of the whole
    corpus are two numbers.
    """

    def __init__(self, docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text"):
        self.key, spark = key, docs.sparkSession
        path = path or scratch_path(spark, "index")
        sized = docs.select(F.col(key).alias("key"), F.filter(words_of(F.col(text)), lambda x: x != "").alias("w")).select("key", "w", F.size("w").alias("n"))
        lists = sized.select("key", "n", F.explode("w").alias("word")).groupBy("word", "key", "n").agg(F.count("*").cast("int").alias("tf"))
        # Words in ranges, a very common one in several: its list need not fit one task.
        spread = F.pmod(F.xxhash64("key"), F.lit(64))
        lists.repartitionByRange("word", spread).sortWithinPartitions("word", "key").write.mode("overwrite").parquet(path)
        self.lists = spark.read.schema("word string, key " + dict(docs.dtypes)[key] + ", n int, tf int").parquet(path)
        whole = sized.agg(F.count("*").alias("docs"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean")).first()
        self.docs, self.mean = whole.docs, whole.mean

    def search(self, phrase: str, top: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """As bm25."""
        hits = self.lists.where(F.col("word").isin(wanted(phrase)))
        df = hits.groupBy("word").agg(F.count("*").alias("df"))  # a row for each word of the phrase
        score = _weight(F.col("tf"), F.col("n"), F.lit(self.docs), F.col("df"), F.lit(self.mean), k1, b)
        found = hits.join(F.broadcast(df), "word").groupBy("key").agg(F.round(F.sum(score), 6).alias("score"))
        return found.select(F.col("key").alias(self.key), "score").where("score > 0").orderBy(F.desc("score"), self.key).limit(top)


def nearest(vectors: DataFrame, query: list[float], top: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, similarity) of the vectors with the highest cosine; vectors without length are left out."""
    norm = sum(x * x for x in query) ** 0.5
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scored = vectors.select(key, F.round(F.try_divide(dot, own * F.lit(norm)), 6).alias("similarity"))
    return scored.where("similarity is not null").orderBy(F.desc("similarity"), key).limit(top)
