"""Statements from extracted payloads, with provenance; retraction and time travel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.text import entity_iri, safe_name, slug
from quadrille.operators.quads import NOTE, QUAD
from quadrille.plans.compile import quoted
from quadrille.plans.sparql import RDF, XSD

RDFS = "http://www.w3.org/2000/01/rdf-schema#"
ENTITIES = "array<struct<label:string,type:string,description:string,attributes:array<struct<predicate:string,value:string>>>>"
LINKS = "array<struct<subjectId:int,predicate:string,objectId:int,objectLiteral:string,objectIsLiteral:boolean,confidence:double>>"


def _iri(c: Column) -> Column:
    return F.concat(F.lit("<"), c, F.lit(">"))


def _text(c: Column, kind: str = "") -> Column:
    return quoted(c, XSD + (kind or "string"))


def resolve_name(df: DataFrame, column: str, names: DataFrame, namespace: str) -> DataFrame:
    """df with column_iri: the known IRI of a local name, else one minted in the namespace. names: (local, iri)."""
    known = names.groupBy("local").agg(F.max("iri").alias("_iri"))
    out = df.join(known, df[column] == F.col("local"), "left")
    minted = F.concat(F.lit(namespace), F.when(F.trim(F.coalesce(F.col(column), F.lit(""))) == "", "unknown").otherwise(safe_name(F.col(column))))
    return out.withColumn(f"{column}_iri", F.coalesce("_iri", minted)).drop("local", "_iri")


def statements(payloads: DataFrame, names: DataFrame, graph: str, base: str, dataset: str, namespace: str) -> tuple[DataFrame, DataFrame]:
    """quads and annotations of payload rows: document, run, extracted_at, method, now, entities and relationships.

    Types and relationships carry provenance, relationships a confidence too;
    labels, slugs, comments and attributes carry none. Relationships that name
    entities out of range are left out, unknown names are minted.
    """
    meta = ("document", "run", "extracted_at", "method", "now")
    g = F.lit(f"<{graph}>").alias("g")
    each = payloads.select(*meta, F.posexplode("entities").alias("no", "e"))
    ent = each.select(*meta, "no", F.col("e.label").alias("label"), F.col("e.type").alias("type"), F.col("e.description").alias("description"), F.col("e.attributes").alias("attributes")).withColumn("s", _iri(entity_iri(base, dataset, F.col("type"), F.col("label"))))
    typed = resolve_name(ent, "type", names, namespace)

    def quad(df: DataFrame, p: str, o: Column) -> DataFrame:
        return df.select(g, "s", F.lit(f"<{p}>").alias("p"), o.alias("o")).where("o is not null")

    label = quad(ent, RDFS + "label", _text(F.coalesce("label", F.lit(""))))
    slugs = quad(ent, namespace + "slug", _text(slug(F.col("label"))))
    comment = quad(ent.where("trim(coalesce(description, '')) <> ''"), RDFS + "comment", _text(F.col("description")))
    kinds = typed.select(*meta, F.lit(None).cast("double").alias("confidence"), g, "s", F.lit(f"<{RDF}type>").alias("p"), _iri(F.col("type_iri")).alias("o"))
    attrs = resolve_name(ent.select("s", F.explode("attributes").alias("a")).select("s", F.col("a.predicate").alias("predicate"), F.col("a.value").alias("value")).where("predicate is not null and value is not null"), "predicate", names, namespace)
    attributes = attrs.select(g, "s", _iri(F.col("predicate_iri")).alias("p"), _text(F.col("value")).alias("o"))
    rel = resolve_name(payloads.select(*meta, F.explode("relationships").alias("r")).select(*meta, "r.*"), "predicate", names, namespace)
    ends = ent.select("document", "run", "no", "s")
    subject = rel.join(ends.select("document", "run", F.col("no").alias("subjectId"), "s"), ["document", "run", "subjectId"])
    objects = subject.join(ends.select("document", "run", F.col("no").alias("objectId"), F.col("s").alias("object")), ["document", "run", "objectId"], "left")
    target = F.when(F.col("objectIsLiteral"), _text(F.col("objectLiteral"))).otherwise(F.col("object"))
    linked = objects.select(*meta, "confidence", g, "s", _iri(F.col("predicate_iri")).alias("p"), target.alias("o")).where("o is not null")
    sourced = kinds.unionByName(linked)
    notes = F.array(
        F.struct(F.lit(f"<{namespace}sourceDocument>").alias("ap"), _iri(F.col("document")).alias("ao")),
        F.struct(F.lit(f"<{namespace}extractedAt>").alias("ap"), _text(F.col("extracted_at"), "dateTime").alias("ao")),
        F.struct(F.lit(f"<{namespace}extractionMethod>").alias("ap"), _text(F.col("method")).alias("ao")),
        F.struct(F.lit(f"<{namespace}indexingRun>").alias("ap"), _text(F.col("run")).alias("ao")),
        F.struct(F.lit(f"<{namespace}transactionTime>").alias("ap"), _text(F.col("now"), "dateTime").alias("ao")),
        F.struct(F.lit(f"<{namespace}confidence>").alias("ap"), _text(F.col("confidence").cast("string"), "decimal").alias("ao")),
    )
    said = sourced.select(*QUAD, F.explode(notes).alias("n")).select(*QUAD, "n.ap", "n.ao").where("ao is not null").distinct()
    quads = label.union(slugs).union(comment).union(attributes).union(sourced.select(*QUAD)).distinct()
    return quads, said.select(*NOTE)


def valid_at(facts: DataFrame, at: str | Column, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Facts that hold at a time: begun by then, and not yet ended."""
    at = F.lit(at).cast("timestamp_ntz") if isinstance(at, str) else at
    return facts.where((F.col(start) <= at) & (F.col(end).isNull() | (at < F.col(end))))


def retract(facts: DataFrame, keys: DataFrame, on: list[str], at: str, end: str = "valid_to") -> DataFrame:
    """Close the open facts with these keys at a time; nothing is deleted."""
    hit = keys.select(*on).distinct().withColumn("_hit", F.lit(True))
    out = facts.join(hit, on, "left")
    closed = F.when(F.col("_hit") & F.col(end).isNull(), F.lit(at).cast("timestamp_ntz")).otherwise(F.col(end))
    return out.withColumn(end, closed).drop("_hit").select(*facts.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key is not in new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
