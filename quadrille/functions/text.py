"""Names, identities, chunks and URLs as column expressions; no Python on executors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits, other runs as one hyphen, none at the ends."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "(^-|-$)", ""), F.lit(""))


def label_key(c: Column) -> Column:
    """What labels are compared by: ASCII letters and digits in lower case, other runs as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def safe_name(c: Column) -> Column:
    """A local name that may follow a namespace; unknown if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9_-]+", "-"), "(^-|-$)", "")
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(name)


def local_name(c: Column) -> Column:
    """What follows the last # or / of an IRI."""
    return F.regexp_extract(c, "[^#/]*$", 0)


def entity_iri(base: str, dataset: str, kind: Column, label: Column) -> Column:
    """base/entity/dataset/slug-hash, the hash from data set, type and slug."""
    seed = F.concat(F.lit(f"{dataset}:"), F.coalesce(kind, F.lit("")), F.lit(":"), slug(label))
    return F.concat(F.lit(f"{base}/entity/{dataset}/"), slug(label), F.lit("-"), F.substring(F.md5(seed), 1, 8))


def document_key(dataset: Column, external: Column, path: Column, url: Column) -> Column:
    """32 hex digits from where a document comes from."""
    parts = [F.coalesce(F.trim(x), F.lit("")) for x in (dataset, external, path, url)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def chunks(docs: DataFrame, size: int = 16_000, overlap: int = 100, text: str = "text") -> DataFrame:
    """docs with one row for each chunk: chunk_no and chunk. Empty texts give no rows; a tail may be all overlap."""
    step, n = size - overlap, F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step)))
    return docs.select("*", F.posexplode(starts).alias("chunk_no", "_at")).withColumn("chunk", F.substring(F.col(text), F.col("_at") + 1, F.lit(size))).drop("_at")


def shifted(parts: DataFrame, group: str, order: str, count: str) -> DataFrame:
    """parts with offset: how many items earlier parts of the group have."""
    from pyspark.sql import Window

    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(count).over(before), F.lit(0)))


def vector_text(c: Column) -> Column:
    """[a,b,..] of a vector; null unless all its numbers are finite."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite, F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]")))


def canonical_url(c: Column) -> Column:
    """No fragment, scheme and host in lower case, single slashes in the path."""
    bare = F.regexp_replace(c, "#.*$", "")
    parts = r"(?i)^([a-z][a-z0-9+.-]*)://([^/?]*)([^?]*)(\?.*)?$"
    path = F.regexp_replace(F.regexp_extract(bare, parts, 3), "/{2,}", "/")
    whole = F.concat(F.lower(F.regexp_extract(bare, parts, 1)), F.lit("://"), F.lower(F.regexp_extract(bare, parts, 2)), F.when(path == "", "/").otherwise(path), F.regexp_extract(bare, parts, 4))
    return F.when(bare.rlike(parts), whole).otherwise(bare)


def url_year(c: Column) -> Column:
    """The first path segment that is a year from 1900 on."""
    return F.regexp_extract(F.regexp_replace(c, r"^[a-z]+://[^/]*", ""), r"/((?:19|20)\d\d)(?=/|\?|$)", 1).try_cast("int")


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page_url, link) of every distinct absolute link: <a href> and quoted URLs, relative paths resolved against the host."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"'#][^"']*)["']"""), F.lit(1))
    quoted = F.regexp_extract_all(html, F.lit(r"""["'](https?://[^"'<> ]+)["']"""), F.lit(1))
    host = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^(.*/)", 1)
    found = pages.select(F.col(url).alias("page_url"), host.alias("_host"), folder.alias("_folder"), F.explode(F.array_union(hrefs, quoted)).alias("link"))
    full = F.when(F.col("link").rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.col("link")).when(F.col("link").startswith("/"), F.concat("_host", "link")).otherwise(F.concat("_folder", "link"))
    return found.select("page_url", canonical_url(full).alias("link")).where("link rlike '^https?://'").distinct()


def canonical_value(c: Column) -> Column:
    """A value as results are compared by: numbers as plain decimals without needless zeros, times to the second, null as <NULL>."""
    text = c.cast("string")
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("decimal(38,10)").cast("string"))
    plain = F.when(number.contains("."), F.regexp_replace(F.regexp_replace(number, "0+$", ""), r"\.$", "")).otherwise(number)
    time = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d"), F.date_format(text.try_cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"))
    return F.coalesce(plain, time, text, F.lit("<NULL>"))


# -- guarded SQL
class SqlRefused(ValueError):
    """A statement that the guard does not let through."""


def guarded(spark, sql: str, limit: int | None = 500, args: dict | None = None) -> DataFrame:
    """A SELECT with named parameters (@name or :name), with a limit where it has none; limit None: the whole result."""
    text = sql.strip().rstrip(";")
    if not re.match(r"(?i)select\b", text):
        raise SqlRefused("only SELECT is accepted")
    df = spark.sql(parameters(text), args=args or {})
    return df if limit is None or re.search(r"(?i)\blimit\s+\d+", text) else df.limit(limit)


def parameters(sql: str) -> str:
    """@name outside quotes as :name."""
    return re.sub(r"('(?:[^']|'')*')|@(\w+)", lambda m: m[1] or f":{m[2]}", sql)
