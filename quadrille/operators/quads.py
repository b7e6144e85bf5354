"""Named graphs of encoded terms, with statements about statements.

quads (g, s, p, o) and annotations (g, s, p, o, ap, ao) are DataFrames; a store
is immutable, and an update gives a new one. Stored tables are versioned: a
write makes a new directory and then moves the pointer, so a failed load leaves
the last version in place, and compensation is a pointer to an earlier one.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.plans.compile import Engine, Rel, Term, encode, fresh, join, render
from quadrille.plans.sparql import Iri, Quoted, Triple, Var, parse_updates

QUAD, NOTE = ("g", "s", "p", "o"), ("g", "s", "p", "o", "ap", "ao")


class QuadStore(Engine):
    """union_default: patterns outside GRAPH see all graphs; else they see those of FROM, and none without it."""

    def __init__(self, quads: DataFrame, notes: DataFrame | None = None, prefixes: dict[str, str] | None = None, union_default: bool = False):
        super().__init__(quads.sparkSession)
        self.quads = quads.select(*QUAD)
        self.notes = (notes if notes is not None else self.spark.createDataFrame([], "g string, s string, p string, o string, ap string, ao string")).select(*NOTE)
        self.prefixes, self.union_default = prefixes or {}, union_default

    @classmethod
    def of(cls, spark: SparkSession, rows: list[tuple], notes: list[tuple] = (), **more) -> QuadStore:
        return cls(spark.createDataFrame(list(rows), "g string, s string, p string, o string"), spark.createDataFrame(list(notes), "g string, s string, p string, o string, ap string, ao string"), **more)

    def but(self, quads: DataFrame, notes: DataFrame | None = None) -> QuadStore:
        return QuadStore(quads, self.notes if notes is None else notes, self.prefixes, self.union_default)

    # -- patterns
    def constant(self, text: str) -> Column:
        """What an encoded term is compared with."""
        return F.lit(text)

    def table(self, df: DataFrame, nodes: dict[str, object], graph, dedupe: tuple[str, ...]) -> Rel:
        several = False
        if isinstance(graph, Iri):
            df = df.where(F.col("g") == self.constant(encode(graph)))
        elif isinstance(graph, tuple):
            df, several = df.where(F.col("g").isin([self.constant(f"<{g}>") for g in graph])), len(graph) > 1
        elif graph is None:
            df, several = df if self.union_default else df.where("false"), True
        if several:  # several graphs merge to one set
            df = df.dropDuplicates(list(dedupe))
        names, terms = {}, {}
        if isinstance(graph, Var):
            nodes = {**nodes, "g": graph}
        for c, node in nodes.items():
            if isinstance(node, Var):
                if node.name in names:
                    df = df.where(F.col(c) == F.col(names[node.name]))
                else:
                    names[node.name] = c
            else:
                df = df.where(F.col(c) == self.constant(encode(node)))
        out = {}
        for v, c in names.items():
            new = fresh()
            out[c], terms[v] = new, Term("enc", (new,))
        return Rel(df.select(*(F.col(c).alias(n) for c, n in out.items())) if out else df.select(F.lit(1).alias(fresh())), terms)

    def bgp(self, triples: list[Triple], graph) -> Rel:
        rels = []
        for t in triples:
            if isinstance(t.s, Quoted):
                rels.append(self.table(self.notes, {"s": t.s.s, "p": t.s.p, "o": t.s.o, "ap": t.p, "ao": t.o}, graph, NOTE[1:]))
            else:
                rels.append(self.table(self.quads, {"s": t.s, "p": t.p, "o": t.o}, graph, QUAD[1:]))
        rel, rest = rels[0], rels[1:]
        while rest:
            nxt = next((r for r in rest if set(r.terms) & set(rel.terms)), rest[0])
            rest.remove(nxt)
            rel = join(rel, nxt)
        return rel

    # -- updates
    def update(self, text: str) -> QuadStore:
        store = self
        for u in parse_updates(text, self.prefixes):
            if u.kind == "clear":
                store = store.but(store.quads.where(F.col("g") != encode(u.graph)), store.notes.where(F.col("g") != encode(u.graph)))
                continue
            rel = store.group(u.where, None) if u.where is not None else None
            gone, gone_notes = store.built(u.delete, rel)
            new, new_notes = store.built(u.insert, rel)
            quads, notes = store.quads, store.notes
            if gone is not None:
                quads = quads.join(gone, list(QUAD), "left_anti")
                notes = notes.join(gone, list(QUAD), "left_anti")
            if gone_notes is not None:
                notes = notes.join(gone_notes, list(NOTE), "left_anti")
            quads = quads.union(new).distinct() if new is not None else quads
            notes = notes.union(new_notes).distinct() if new_notes is not None else notes
            store = store.but(quads, notes)
        return store

    def built(self, templates: list, rel: Rel | None) -> tuple[DataFrame | None, DataFrame | None]:
        """Quads and annotations of templates over the solutions; rows with unbound terms are left out."""

        def rows(nodes, names):
            cols = []
            for n, name in zip(nodes, names, strict=True):
                if isinstance(n, Var):
                    cols.append((render(rel.terms[n.name]) if rel and n.name in rel.terms else F.lit("_:" + n.name.lstrip("._:"))).alias(name))
                else:
                    cols.append(F.lit(encode(n)).alias(name))
            return (rel.df if rel else self.spark.range(1)).select(*cols).dropna().distinct()

        plain = [rows((g, t.s, t.p, t.o), QUAD) for g, t in templates if not isinstance(t.s, Quoted)]
        noted = [rows((g, t.s.s, t.s.p, t.s.o, t.p, t.o), NOTE) for g, t in templates if isinstance(t.s, Quoted)]
        return tuple(reduce(DataFrame.union, x) if x else None for x in (plain, noted))

    # -- documents and runs
    def without_document(self, document: str, predicate: str, also: str | None = None) -> QuadStore:
        """Drop statements that an annotation (predicate, document) names, with all that is said about them.

        also: an annotation predicate of runs; statements with a second run are kept.
        """
        hit = self.notes.where((F.col("ap") == predicate) & (F.col("ao") == document)).select(*QUAD).distinct()
        if also is not None:
            several = self.notes.where(F.col("ap") == also).groupBy(*QUAD).agg(F.count_distinct("ao").alias("n")).where("n > 1").select(*QUAD)
            hit = hit.join(several, list(QUAD), "left_anti")
        return self.but(self.quads.join(hit, list(QUAD), "left_anti"), self.notes.join(hit, list(QUAD), "left_anti"))

    def snapshot(self) -> DataFrame:
        """Each statement once, with its annotations as a sorted array."""
        notes = self.notes.groupBy(*QUAD).agg(F.sort_array(F.collect_set(F.struct("ap", "ao"))).alias("notes"))
        return self.quads.distinct().join(notes, list(QUAD), "left")

    def restore(self, snapshot: DataFrame) -> QuadStore:
        """The store with a snapshot's statements and annotations back in it."""
        notes = snapshot.select(*QUAD, F.explode("notes").alias("n")).select(*QUAD, "n.ap", "n.ao")
        return self.but(self.quads.union(snapshot.select(*QUAD)).distinct(), self.notes.union(notes).distinct())

    # -- versions
    def save(self, path: str) -> str:
        """Write a new version below path and point to it."""
        version = f"v-{uuid.uuid4().hex}"
        self.quads.write.partitionBy("g").parquet(f"{path}/{version}/quads")
        self.notes.write.parquet(f"{path}/{version}/notes")
        point(self.spark, path, version)
        return version

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: str | None = None, **more) -> QuadStore:
        version = version or spark.read.text(f"{path}/current").first().value
        schema = ", ".join(f"{c} string" for c in NOTE)
        return cls(spark.read.schema(", ".join(f"{c} string" for c in QUAD)).parquet(f"{path}/{version}/quads"), spark.read.schema(schema).parquet(f"{path}/{version}/notes"), **more)


def point(spark: SparkSession, path: str, version: str) -> None:
    """Make a version the current one."""
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
