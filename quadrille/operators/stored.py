"""Named graphs that stay on disk: terms as numbers, statements by graph and predicate.

Below a path lie
  terms/<batch>      (id, term), once for each term
  quads/<batch>      (s, o) by g and p, in buckets of s
  notes/<batch>      (s, p, o, ao) by g and ap, in buckets of s
  log/<version>      which terms there are and where each part of each graph is
A term's id is 63 bits of its hash, so encoding needs no lookup; of terms that
share one, all but the first have a negative id, which the log lists. An update
writes new files for the parts it touches, in a batch of its own, and then the
next version's log. That file can be made once, so of two writers that began from
one version one fails and changes nothing; readers see whole versions, and the
files of other parts are not touched. A version is a table of Spark's catalog with
a place for each part: patterns read the parts they name, and joins on subjects
read buckets without a shuffle.

Equal statements in a graph are one. A graph or part that has lost all statements
is gone. Reading a constant that was never stored finds nothing, unless its hash
is that of a stored term (a chance of terms / 2^63).
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from dataclasses import dataclass, field, fields, is_dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.quads import NOTE, QUAD, QuadStore
from quadrille.plans.compile import Engine, Rel, Term, encode, fresh
from quadrille.plans.lineage import cut
from quadrille.plans.sparql import Select, Var, parse_updates

#: Columns of the files and what parts are told by.
KINDS = {"quads": (QUAD, ("g", "p")), "notes": (NOTE, ("g", "ap"))}
_ID = "_id"


class Conflict(RuntimeError):
    """Another writer has made the next version."""


@dataclass(frozen=True)
class Version:
    """What one version consists of; parts map 'g,p' to the folder that has them."""

    number: int
    buckets: int
    bits: int
    terms: tuple[str, ...] = ()
    odd: dict[str, int] = field(default_factory=dict)
    quads: dict[str, str] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)


# -- files
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list[str]:
    at, fs = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def _publish(spark: SparkSession, path: str, text: str) -> None:
    """Make a file with a text, whole or not at all; Conflict if there is one."""
    jvm = spark.sparkContext._jvm
    draft, fs = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, jvm.org.apache.hadoop.fs.Path(path), options)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(path) from e
        raise


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(x) for x in _listed(spark, f"{path}/log") if x.isdigit()]


def _read_log(spark: SparkSession, path: str, number: int) -> Version:
    text = "\n".join(r.value for r in spark.read.text(f"{path}/log/{number:012}").collect())
    d = json.loads(text)
    return Version(**{**d, "terms": tuple(d["terms"])})


# -- the store
class StoredGraph(QuadStore):
    """A QuadStore over stored files; an update makes the next version and gives it."""

    def __init__(self, spark: SparkSession, path: str, version: Version, prefixes: dict[str, str] | None = None, union_default: bool = False):
        Engine.__init__(self, spark)
        self.path, self.version = path.rstrip("/"), version
        self.prefixes, self.union_default = prefixes or {}, union_default
        self.mentions: Counter | None = None
        self.tables = {kind: self._table(kind) for kind in KINDS}

    @classmethod
    def create(cls, spark: SparkSession, path: str, quads: DataFrame | None = None, notes: DataFrame | None = None, buckets: int = 8, bits: int = 63, **more) -> StoredGraph:
        """A new store of encoded terms. buckets: for each part, as many as cores may read it at once; bits: of a term's id."""
        _publish(spark, f"{path}/log/{0:012}", json.dumps(Version(0, buckets, bits).__dict__))
        store = cls(spark, path, _read_log(spark, path, 0), **more)
        return store if quads is None and notes is None else store.changed(new=quads, new_notes=notes)

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None, **more) -> StoredGraph:
        """The last version, or one that is still there."""
        return cls(spark, path, _read_log(spark, path, max(versions(spark, path)) if version is None else version), **more)

    def _table(self, kind: str) -> DataFrame:
        columns, by = KINDS[kind]
        own = [c for c in columns if c not in by]
        parts = getattr(self.version, kind)
        if not parts:
            return self.spark.createDataFrame([], ", ".join(f"{c} long" for c in columns))
        name = f"{kind}_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({', '.join(f'{c} BIGINT' for c in [*own, *by])}) USING parquet PARTITIONED BY ({', '.join(by)}) CLUSTERED BY (s) INTO {self.version.buckets} BUCKETS LOCATION '{self.path}/none'")
        places = [f"PARTITION ({', '.join(f'{c} = {v}' for c, v in zip(by, key.split(','), strict=True))}) LOCATION '{self.path}/{at}'" for key, at in parts.items()]
        for i in range(0, len(places), 500):
            self.spark.sql(f"ALTER TABLE {name} ADD " + " ".join(places[i : i + 500]))
        return self.spark.table(name).select(*columns)

    # -- terms
    @property
    def terms_table(self) -> DataFrame:
        if not self.version.terms:
            return self.spark.createDataFrame([], "id long, term string")
        return self.spark.read.schema("id long, term string").parquet(*(f"{self.path}/{x}" for x in self.version.terms))

    def hashed(self, c: Column) -> Column:
        return F.xxhash64(c).bitwiseAND((1 << self.version.bits) - 1)

    def constant(self, text: str) -> Column:
        return F.lit(self.version.odd[text]).cast("long") if text in self.version.odd else self.hashed(F.lit(text))

    def numbered(self, df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        """Columns of encoded terms as their ids."""
        odd = self.version.odd
        known = F.create_map(*(F.lit(x) for pair in odd.items() for x in pair)) if odd else None

        def number(c: str) -> Column:
            return self.hashed(F.col(c)) if known is None else F.coalesce(F.try_element_at(known, F.col(c)), self.hashed(F.col(c)))

        return df.select(*(number(c).cast("long").alias(c) for c in columns))

    def spelled(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """Columns of ids as the encoded terms they stand for; other columns stay."""
        terms = self.terms_table
        for c in columns:
            name = fresh("t")
            df = df.join(terms.select(F.col("id").alias(c), F.col("term").alias(name)), c).drop(c).withColumnRenamed(name, c)
        return df

    def _with_terms(self, frames: list[DataFrame], batch: str) -> StoredGraph:
        """The store with all terms of some frames in its dictionary; not yet a version."""
        each = [f.select(F.explode(F.array(*f.columns)).alias("term")) for f in frames]
        asked = reduce(DataFrame.union, each).where("term is not null").distinct().withColumn("id", self.hashed(F.col("term")))
        asked = asked.where(~F.col("term").isin(list(self.version.odd))) if self.version.odd else asked
        known = self.terms_table
        new = cut(asked.join(known, ["id", "term"], "left_anti"), "terms")
        # Ids that another term has, stored or new: hash collisions, of which there are hardly ever any.
        first = new.groupBy("id").agg(F.min("term").alias("first"), F.count("*").alias("n"))
        taken = known.select("id", F.lit(True).alias("taken"))
        clash = new.join(first, "id").join(taken, "id", "left").where("taken or (n > 1 and term <> first)").select("term").distinct()
        odd = dict(self.version.odd)
        for r in sorted(r.term for r in clash.collect()):
            odd[r] = -1 - len(odd)
        rows = new.select("id", "term")
        if len(odd) > len(self.version.odd):
            numbers = self.spark.createDataFrame([(n, t) for t, n in odd.items() if t not in self.version.odd], "odd long, term string")
            rows = new.join(numbers, "term", "left").select(F.coalesce("odd", "id").alias("id"), "term")
        at = f"terms/{batch}"
        rows.write.parquet(f"{self.path}/{at}")
        return self._at(replace(self.version, odd=odd, terms=(*self.version.terms, at)))

    def _at(self, version: Version) -> StoredGraph:
        out = StoredGraph.__new__(StoredGraph)
        out.__dict__.update(self.__dict__)
        out.version, out.mentions = version, None
        return out

    # -- reading
    @property
    def quads(self) -> DataFrame:
        return self.spelled(self.tables["quads"], list(QUAD)).select(*QUAD)

    @property
    def notes(self) -> DataFrame:
        return self.spelled(self.tables["notes"], list(NOTE)).select(*NOTE)

    def select(self, q: Select) -> Rel:
        if self.mentions is not None or not q.vars:  # a part of a query, or all variables asked for
            return super().select(q)
        self.mentions = _mentions(q)
        try:
            return super().select(q)
        finally:
            self.mentions = None

    def bgp(self, triples: list, graph) -> Rel:
        """Joined by ids; only variables that something else asks for are spelled out."""
        rel = super().bgp(triples, graph)
        own = _mentions([triples, graph])
        names = [v for v in rel.terms if self.mentions is None or v.startswith("_.") or self.mentions[v] > own[v]]  # "_.": made for a path
        df, terms = rel.df, {}
        for v in names:
            c, term = rel.terms[v].cols[0], fresh()
            df = df.join(self.terms_table.select(F.col("id").alias(fid := fresh()), F.col("term").alias(term)), F.col(c) == F.col(fid))
            terms[v] = Term("enc", (term,))
        return Rel(df.select(*(t.cols[0] for t in terms.values())) if terms else df.select(F.lit(1).alias(fresh())), terms)

    def table(self, df: DataFrame, nodes: dict[str, object], graph, dedupe: tuple[str, ...]) -> Rel:
        rel = super().table(self.tables["notes" if "ap" in nodes else "quads"], nodes, graph, dedupe)
        return Rel(rel.df, {v: Term("iri", t.cols, _ID) for v, t in rel.terms.items()})

    # -- writing
    def _write(self, kind: str, rows: DataFrame, batch: str) -> dict[str, str]:
        """Files of some parts, each bucket by one task, and where they are."""
        columns, by = KINDS[kind]
        at, name = f"{kind}/{batch}", f"w_{uuid.uuid4().hex}"
        n = self.version.buckets
        dealt = rows.select(*(c for c in columns if c not in by), *by).repartition(*by, F.pmod(F.hash("s"), F.lit(n)))
        dealt.write.partitionBy(*by).bucketBy(n, "s").sortBy("s").option("path", f"{self.path}/{at}").option("compression", "zstd").format("parquet").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay
        found = {}
        for g in _listed(self.spark, f"{self.path}/{at}"):
            if "=" in g:
                for p in _listed(self.spark, f"{self.path}/{at}/{g}"):
                    found[f"{g.partition('=')[2]},{p.partition('=')[2]}"] = f"{at}/{g}/{p}"
        return found

    def _rewritten(self, kind: str, gone: DataFrame | None, new: DataFrame | None, batch: str) -> dict[str, str]:
        """Where the parts are once gone rows (ids) have left and new ones have come; the others stay where they are."""
        columns, by = KINDS[kind]
        parts = dict(getattr(self.version, kind))
        changes = [x.select(*by) for x in (gone, new) if x is not None]
        if not changes:
            return parts
        touched = [f"{r[0]},{r[1]}" for r in reduce(DataFrame.union, changes).distinct().collect()]  # graphs by predicates
        if not touched:
            return parts
        here = [x for x in touched if x in parts]
        rows = None
        if here:
            own = [tuple(map(int, x.split(","))) for x in here]
            hit = reduce(Column.__or__, ((F.col(by[0]) == g) & (F.col(by[1]) == p) for g, p in own)) if len(own) <= 200 else F.col(by[0]).isin(sorted({g for g, _ in own})) & F.struct(*by).isin([F.struct(F.lit(g), F.lit(p)) for g, p in own])
            rows = self.tables[kind].where(hit)
            rows = rows.join(gone, list(columns), "left_anti") if gone is not None else rows
        if new is not None:
            rows = new if rows is None else rows.union(new)
        if rows is not None:
            found = self._write(kind, rows.select(*columns).distinct(), batch)
            parts = {k: v for k, v in parts.items() if k not in touched} | found
        return parts

    def changed(self, gone: DataFrame | None = None, new: DataFrame | None = None, gone_notes: DataFrame | None = None, new_notes: DataFrame | None = None) -> StoredGraph:
        """The next version, without some quads and annotations (of encoded terms) and with others.

        Annotations of quads that go, go with them; nothing is read of parts that no row names.
        """
        batch = f"{self.version.number + 1:012}-{uuid.uuid4().hex[:8]}"
        new, new_notes = (x.select(*c).dropna() if x is not None else None for x, c in ((new, QUAD), (new_notes, NOTE)))
        store = self._with_terms([x for x in (new, new_notes) if x is not None], batch) if new is not None or new_notes is not None else self
        number = lambda x, c: cut(store.numbered(x, c).distinct(), "ids") if x is not None else None
        gone, new, gone_notes, new_notes = number(gone, QUAD), number(new, QUAD), number(gone_notes, NOTE), number(new_notes, NOTE)
        return store.changed_ids(gone, new, gone_notes, new_notes, batch)

    def changed_ids(self, gone, new, gone_notes, new_notes, batch: str | None = None) -> StoredGraph:
        """changed(), of rows of ids that are written down already."""
        batch = batch or f"{self.version.number + 1:012}-{uuid.uuid4().hex[:8]}"
        if gone is not None:
            about = cut(self.tables["notes"].join(gone, list(QUAD), "left_semi"), "ids")
            gone_notes = about if gone_notes is None else gone_notes.union(about)
        quads, notes = self._rewritten("quads", gone, new, batch), self._rewritten("notes", gone_notes, new_notes, batch)
        return self.commit(replace(self.version, quads=quads, notes=notes))

    def commit(self, version: Version) -> StoredGraph:
        """Make a version the next one after that this store was opened at."""
        version = replace(version, number=self.version.number + 1)
        _publish(self.spark, f"{self.path}/log/{version.number:012}", json.dumps(version.__dict__))
        return StoredGraph(self.spark, self.path, version, self.prefixes, self.union_default)

    def without_graphs(self, graphs: list[str]) -> StoredGraph:
        """The next version without some graphs (encoded names): their parts are no longer named, and no file is read."""
        ids = {str(self.spark.range(1).select(self.constant(g)).first()[0]) for g in graphs}
        keep = {kind: {k: v for k, v in getattr(self.version, kind).items() if k.partition(",")[0] not in ids} for kind in KINDS}
        return self.commit(replace(self.version, **keep))

    def replaced(self, graph: str, quads: DataFrame) -> StoredGraph:
        """One version later, with other statements (s, p, o) in a graph; its annotations go."""
        batch = f"{self.version.number + 1:012}-{uuid.uuid4().hex[:8]}"
        new = quads.select(F.lit(graph).alias("g"), "s", "p", "o").dropna()
        store = self._with_terms([new], batch)
        own = str(self.spark.range(1).select(store.constant(graph)).first()[0])
        keep = {kind: {k: v for k, v in getattr(self.version, kind).items() if k.partition(",")[0] != own} for kind in KINDS}
        keep["quads"] |= store._write("quads", store.numbered(new, QUAD).distinct(), batch)
        return store.commit(replace(store.version, **keep))

    def update(self, text: str) -> StoredGraph:
        """Each operation makes a version; rows are found in the version before."""
        store = self
        for u in parse_updates(text, self.prefixes):
            if u.kind == "clear":
                store = store.without_graphs([encode(u.graph)])
                continue
            rel = store.group(u.where, None) if u.where is not None else None
            gone, gone_notes = store.built(u.delete, rel)
            new, new_notes = store.built(u.insert, rel)
            store = store.changed(gone, new, gone_notes, new_notes)
        return store

    def without_document(self, document: str, predicate: str, also: str | None = None) -> StoredGraph:
        notes = self.tables["notes"]
        hit = notes.where((F.col("ap") == self.constant(predicate)) & (F.col("ao") == self.constant(document))).select(*QUAD).distinct()
        if also is not None:
            several = notes.where(F.col("ap") == self.constant(also)).groupBy(*QUAD).agg(F.count_distinct("ao").alias("n")).where("n > 1").select(*QUAD)
            hit = hit.join(several, list(QUAD), "left_anti")
        return self.changed_ids(cut(hit, "ids"), None, None, None)

    def restore(self, snapshot: DataFrame) -> StoredGraph:
        notes = snapshot.select(*QUAD, F.explode("notes").alias("n")).select(*QUAD, "n.ap", "n.ao")
        return self.changed(new=snapshot.select(*QUAD), new_notes=notes)

    def but(self, quads: DataFrame, notes: DataFrame | None = None):
        raise TypeError("a stored graph changes by update(), changed() and their like")

    def vacuum(self, keep: int = 1) -> int:
        """Delete the files that none of the last `keep` versions names, and older logs; how many batches went. No writer may be at work."""
        there = versions(self.spark, self.path)
        used = set()
        for n in there[-keep:]:
            v = _read_log(self.spark, self.path, n)
            used |= {"/".join(x.split("/")[:2]) for x in (*v.terms, *v.quads.values(), *v.notes.values())}
        gone = [f"log/{n:012}" for n in there[:-keep]] + [f"{kind}/{b}" for kind in ("terms", *KINDS) for b in _listed(self.spark, f"{self.path}/{kind}") if f"{kind}/{b}" not in used]
        for x in gone:
            at, fs = _fs(self.spark, f"{self.path}/{x}")
            fs.delete(at, True)
        return sum(not x.startswith("log/") for x in gone)


def _mentions(x) -> Counter:
    """How often each variable stands in a part of a query, at least: any text may be a variable's name."""
    if isinstance(x, Var):
        return Counter([x.name])
    if isinstance(x, str):
        return Counter([x])
    out: Counter = Counter()
    if isinstance(x, Select) and not x.vars:  # all variables are asked for
        return Counter(dict.fromkeys(_mentions(x.where), 1 << 20))
    if isinstance(x, dict):
        x = list(x.values())
    if isinstance(x, (list, tuple, set)):
        for y in x:
            out += _mentions(y)
    elif is_dataclass(x):
        for f in fields(x):
            out += _mentions(getattr(x, f.name))
    return out
