"""What is known about external tables: declarations without rows, and descriptions for those who write queries."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# SQL types of declarations, as Spark has them.
TYPES = {
    "int": "int", "integer": "int", "int64": "bigint", "bigint": "bigint", "smallint": "smallint", "float": "double", "float64": "double", "double": "double", "real": "float", "varchar": "string", "char": "string", "text": "string", "string": "string",
    "boolean": "boolean", "bool": "boolean", "date": "date", "timestamp": "timestamp", "datetime": "timestamp", "time": "string", "numeric": "decimal", "decimal": "decimal",
}


def declared(ddl: str) -> dict[str, str]:
    """Table names to Spark schemas of the CREATE TABLE statements in a text; constraints are passed over."""
    plain = re.sub(r"--[^\n]*|/\*.*?\*/", " ", ddl, flags=re.S)
    out = {}
    for m in re.finditer(r"(?is)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)\s*\((.*?)\)\s*;", plain):
        cols = []
        for part in re.split(r",(?![^()]*\))", m[2]):
            words = part.split()
            if not words or words[0].lower() in ("primary", "foreign", "unique", "check", "constraint"):
                continue
            kind = re.match(r"([a-zA-Z0-9_]+)\s*(?:\(([\d\s,]+)\))?", " ".join(words[1:]))
            base = kind and TYPES.get(kind[1].lower())
            if not base:
                raise ValueError(f"no type for {part.strip()!r}")
            name = words[0].strip('"`')
            cols.append(f"`{name}` {base}" + (f"({kind[2] or '38,9'})" if base == "decimal" else ""))
        out[m[1].replace('"', "").replace("`", "").split(".")[-1]] = ", ".join(cols)
    return out


def empty_views(spark: SparkSession, ddl: str) -> dict[str, DataFrame]:
    """A temp view without rows for each declared table, so that queries over it can be planned."""
    views = {name: spark.createDataFrame([], schema) for name, schema in declared(ddl).items()}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views


def load_bindings(path: str) -> dict:
    """project and tables (id, dataset, table, description, keyColumns, queryExamples) of a JSON or YAML file."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML bindings need the yaml package; JSON ones don't") from e
    return yaml.safe_load(text)


def table_context(bindings: dict | None) -> str:
    """A text that lists each table, its columns, and its first example; empty without bindings."""
    if not bindings:
        return ""
    project = bindings["project"]
    blocks = [f"Available tables (project: {project}):"]
    for t in bindings["tables"]:
        lines = [f"## {t['id']}: {t['description'].strip()}", f"Table: `{project}.{t['dataset']}.{t['table']}`", "Columns:"]
        lines += [f"  - {c['name']} ({c['type']}): {c['description']}" for c in t.get("keyColumns", ())]
        if t.get("queryExamples"):
            lines += ["Example query:", "```sql", t["queryExamples"][0]["sql"].strip(), "```"]
        blocks.append("\n".join(lines))
    return "\n\n".join(blocks) + "\n"


def maps(found: DataFrame, values: dict[str, str] | None = None) -> DataFrame:
    """(map, label, description, source, join_key, examples) from rows that have an example (ex_label, ex_sql) each.

    Examples of equal label count once, the least text of them; {name} in them is
    replaced by its value.
    """
    text = F.col("ex_sql")
    for name, v in (values or {}).items():
        text = F.replace(text, F.lit("{" + name + "}"), F.lit(v))
    one = found.withColumn("ex_sql", text).groupBy("map", "ex_label").agg(*(F.min(c).alias(c) for c in ("label", "description", "source", "join_key", "ex_sql")))
    example = F.when(F.col("ex_label").isNotNull() & F.col("ex_sql").isNotNull(), F.struct(F.col("ex_label").alias("label"), F.col("ex_sql").alias("sql")))
    return one.groupBy("map").agg(*(F.min(c).alias(c) for c in ("label", "description", "source", "join_key")), F.sort_array(F.collect_list(example)).alias("examples"))


def map_context(found: DataFrame, where: str, values: dict[str, str] | None = None) -> str:
    """The maps as text, by IRI; empty without any. For a registry's maps, which are few."""
    rows = maps(found, values).orderBy("map").collect()
    if not rows:
        return ""
    blocks = [f"Available tables ({where}):"]
    for r in rows:
        lines = [f"## {r.label}", *([r.description.strip()] if r.description else []), *([f"Join key: {r.join_key}"] if r.join_key else []), *(["Example queries:"] if r.examples else [])]
        for x in r.examples:
            lines += [f"  # {x.label}", "  ```sql", *(f"  {line}" for line in x.sql.strip().split("\n")), "  ```"]
        blocks.append("\n".join(lines))
    return "\n\n".join(blocks) + "\n"


def declared_keys(ddl: str) -> dict[str, tuple[str, ...]]:
    """Table names to the columns of their primary keys, in the CREATE TABLE statements of a text."""
    plain = re.sub(r"--[^\n]*|/\*.*?\*/", " ", ddl, flags=re.S)
    out = {}
    for m in re.finditer(r"(?is)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)\s*\((.*?)\)\s*;", plain):
        name = m[1].replace('"', "").replace("`", "").split(".")[-1]
        if whole := re.search(r"(?i)\bprimary\s+key\s*\(([^)]*)\)", m[2]):
            out[name] = tuple(c.strip().strip('"`') for c in whole[1].split(","))
        elif own := re.search(r"(?i)(?:^|,)\s*([\w\"`]+)\s[^,]*?\bprimary\s+key\b", m[2]):
            out[name] = (own[1].strip('"`'),)
    return out


def jdbc_views(spark: SparkSession, url: str, tables: dict[str, str], partitions: dict[str, tuple[str, int, int, int]] | None = None, **properties: str) -> dict[str, DataFrame]:
    """A temp view by name for each table of a database; filters and columns are pushed to it.

    partitions: for large tables, by view name, a whole-number column with its least
    and greatest value and how many tasks read it; others are read by one task.
    """
    out = {}
    for name, source in tables.items():
        if name in (partitions or {}):
            column, low, high, n = partitions[name]
            df = spark.read.jdbc(url, source, column=column, lowerBound=low, upperBound=high, numPartitions=n, properties=properties)
        else:
            df = spark.read.jdbc(url, source, properties=properties)
        df.createOrReplaceTempView(name)
        out[name] = df
    return out
