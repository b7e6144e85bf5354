"""What a client calls: queries, updates, reasoning, ingestion and normalisation of the datasets of a registry."""

from __future__ import annotations

import re
import threading
import time
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.catalog import Manifest
from quadrille.functions import text as X
from quadrille.operators import entities, graph, ingest, rules, search
from quadrille.operators.quads import NOTE, QUAD, QuadStore
from quadrille.operators.vkg import VirtualGraph
from quadrille.plans.compile import encode, lexical, quoted
from quadrille.plans.components import connected_components
from quadrille.plans.lineage import cut
from quadrille.plans.sparql import RDF, XSD, Lit, parse
from quadrille.plans.sqltext import DIALECTS, SqlWriter
from quadrille.sources import bindings
from quadrille.sources.mapping import RR, parse_mappings
from quadrille.sources.objects import ObjectStore
from quadrille.sources.turtle import encoded, read_turtle

OWL, RDFS = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#"
SAME = f"<{OWL}sameAs>"


def to_sparql_json(df: DataFrame) -> dict:
    """Encoded terms (Engine.terms) in the W3C JSON form; for results that a client reads whole."""

    def term(x: str) -> dict:
        if x.startswith("<"):
            return {"type": "uri", "value": x[1:-1]}
        if x.startswith("_:"):
            return {"type": "bnode", "value": x[2:]}
        end = x.rindex('"')
        value, tail = re.sub(r"\\(.)", r"\1", x[1:end], flags=re.DOTALL), x[end + 1 :]
        more = {"xml:lang": tail[1:]} if tail.startswith("@") else {"datatype": tail[3:-1]} if tail else {}
        return {"type": "literal", "value": value, **more}

    return {"head": {"vars": df.columns}, "results": {"bindings": [{k: term(v) for k, v in r.asDict().items() if v is not None} for r in df.collect()]}}


def within(spark: SparkSession, seconds: float, action):
    """The result of an action, or TimeoutError when its jobs were cancelled after so long."""
    tag, late = f"quadrille-{id(action)}", threading.Event()
    spark.addTag(tag)

    def stop():
        late.set()
        spark.interruptTag(tag)

    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"no result in {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)


class Service:
    """A registry over one store; changes give a new state of the store and keep the old one readable."""

    def __init__(self, spark: SparkSession, manifest: Manifest, root: str = "."):
        self.spark, self.manifest, self.root = spark, manifest, Path(root)
        self.prefixes = {"ex": manifest.namespace}
        self.store = QuadStore.of(spark, [], prefixes=self.prefixes)
        self._pages: dict[str, tuple] = {}

    # -- loading
    def reload(self, dataset: str) -> None:
        """Replace the dataset's ontology, rules and bindings graphs from their files, and note it."""
        d, rows, graphs = self.manifest.datasets[dataset], [], []
        for role, files in (("tbox", d.ontology), ("rules_forward", d.forward), ("rules_backward", d.backward), ("bindings", d.bindings)):
            g = self.manifest.graph(dataset, role)
            graphs.append(f"<{g}>")
            for f in files:
                rows += encoded(read_turtle((self.root / f).read_text()), g)
        ns, now = self.manifest.namespace, datetime.now(UTC).isoformat()
        event = f"_:load-{dataset}-{now}"
        health = f"<{self.manifest.graph(dataset, 'health')}>"
        rows += [(health, event, f"<{RDF}type>", f"<{ns}OntologyLoadEvent>"), (health, event, f"<{ns}datasetId>", f'"{dataset}"'), (health, event, f"<{ns}loadedAt>", f'"{now}"^^<{XSD}dateTime>')]
        new = self.spark.createDataFrame(rows, "g string, s string, p string, o string")
        self.store = self.store.but(self.store.quads.where(~F.col("g").isin(graphs)).union(new).distinct())

    # -- queries
    def query(self, text: str, seconds: float | None = None) -> DataFrame:
        """The solutions; with seconds, worked out at once, or TimeoutError."""
        found = self.store.query(text)
        return found if seconds is None else within(self.spark, seconds, lambda: cut(found, "query"))

    def document(self, objects: ObjectStore, prefix: str) -> tuple[str, str, bytes]:
        """(key, type, content) of what is stored of a document: its first .pdf, else its first object."""
        key, kind = objects.resolve(prefix)
        return key, kind, objects.get(key)

    def tbox(self, dataset: str, text: str) -> DataFrame:
        return self.store.query(text, graphs=(self.manifest.graph(dataset, "tbox"),))

    def update(self, text: str) -> None:
        self.store = self.store.update(text)

    def virtual(self, dataset: str) -> VirtualGraph:
        d = self.manifest.datasets[dataset]
        if not d.mappings:
            raise KeyError(f"{dataset} has no mappings")
        prefixes, mappings = parse_mappings((self.root / d.mappings).read_text(), d.unique)
        axioms: dict[str, dict[str, list[str]]] = {x: {} for x in ("subClassOf", "subPropertyOf", "domain", "range")}
        found = self.store.quads.where((F.col("g") == f"<{self.manifest.graph(dataset, 'tbox')}>") & F.col("p").isin([f"<{RDFS}{x}>" for x in axioms]) & F.col("s").startswith("<") & F.col("o").startswith("<"))
        for r in found.orderBy("s", "o").collect():  # an ontology's axioms
            axioms[r.p[len(RDFS) + 1 : -1]].setdefault(r.s[1:-1], []).append(r.o[1:-1])
        return VirtualGraph(self.spark, {**self.prefixes, **prefixes}, mappings, axioms["subClassOf"], properties=axioms["subPropertyOf"], domains=axioms["domain"], ranges=axioms["range"])

    def available(self, dataset: str) -> bool:
        """Whether queries over the dataset's tables can be translated: it is known, and has mappings and a dialect."""
        d = self.manifest.datasets.get(dataset)
        return bool(d and d.mappings and (self.root / d.mappings).exists() and d.dialect in DIALECTS)

    def translate(self, dataset: str, text: str, projected: bool = True) -> dict:
        """sql for the database that holds the tables, and whether its columns are the query's variables; plan: how it would run here."""
        if not self.available(dataset):
            raise KeyError(f"{dataset} has no mappings")
        d, graph_ = self.manifest.datasets[dataset], self.virtual(dataset)
        return SqlWriter(graph_, d.dialect, d.tables).translate(text, projected) | {"plan": graph_.translate(text)}

    def tables(self, dataset: str) -> str:
        """The context text of the dataset's external tables: from their description file, else from the bindings graph."""
        d = self.manifest.datasets[dataset]
        if d.tables_file:
            return bindings.table_context(bindings.load_bindings(str(self.root / d.tables_file)))
        found = self.store.query(
            f"SELECT ?map ?label ?description ?source ?join_key ?ex_label ?ex_sql {{ GRAPH <{self.manifest.graph(dataset, 'bindings')}> {{ ?map a <{RR}TriplesMap> ; rdfs:label ?label "
            "OPTIONAL { ?map rdfs:comment ?description } OPTIONAL { ?map ex:dataSource ?source } OPTIONAL { ?map ex:joinKey ?join_key } OPTIONAL { ?map ex:queryExample [ rdfs:label ?ex_label ; ex:sql ?ex_sql ] } } }"
        )
        return bindings.map_context(found, f"dataset: {dataset}", d.tables)

    def ontology_context(self, dataset: str) -> str:
        """The ontology as text: classes, then properties with their domains and ranges, by local name."""
        rows = self.ontology(dataset).collect()  # an ontology's terms
        short = lambda iris: ", ".join(sorted(re.split("[#/]", x)[-1] for x in (iris or "").split()))
        classes = [f"- {short(r.term)}" + (f": {r.label}" if r.label else "") for r in rows if r.kind.endswith("#Class")]
        properties = [f"- {short(r.term)} ({short(r.domains) or 'any'} -> {short(r.ranges) or 'any'})" for r in rows if not r.kind.endswith("#Class")]
        return "\n".join(["Classes:", *sorted(classes), "Properties:", *sorted(properties)])

    def health(self) -> dict:
        """live: the engine answers; ready: every known dataset was loaded; statements: how many there are."""
        loaded = {r.d for r in self.store.query("SELECT DISTINCT ?d { GRAPH ?g { ?e a ex:OntologyLoadEvent ; ex:datasetId ?d } }").collect()}
        waiting = sorted(set(self.manifest.datasets) - loaded)
        return {"live": self.spark.range(1).count() == 1, "ready": not waiting, "waiting": waiting, "statements": self.store.quads.count()}

    def methods(self, dataset: str) -> DataFrame:
        """(method, n): identities by the method that found them; one found by several counts for each, one without as unknown."""
        g = f"<{self.manifest.graph(dataset, 'normalization')}>"
        same = self.store.quads.where((F.col("g") == g) & (F.col("p") == SAME)).select(*QUAD)
        return graph.method_counts(same, self.store.notes.where(F.col("ap") == f"<{self.manifest.namespace}normalizationMethod>").select(*QUAD, lexical(F.col("ao")).alias("method")), list(QUAD))

    def sql(self, text: str, args: dict | None = None) -> DataFrame:
        return X.guarded(self.spark, text, args=args)

    def text(self, dataset: str, phrase: str, per_field: int = 50, top: int = 20) -> DataFrame:
        """(entity, label, comment, score) of entities whose label or comment has words of the phrase: the better of its BM25 scores in the two fields, best first."""
        asserted = self.store.quads.where(F.col("g") == f"<{self.manifest.graph(dataset, 'asserted')}>")
        fields = {name: asserted.where(F.col("p") == f"<{RDFS}{name}>").groupBy("s").agg(F.min(lexical(F.col("o"))).alias(name)) for name in ("label", "comment")}
        hits = [search.bm25(df, phrase, per_field, key="s", text=name) for name, df in fields.items()]
        found = hits[0].union(hits[1]).groupBy("s").agg(F.max("score").alias("score"))
        out = found.join(fields["label"], "s", "left").join(fields["comment"], "s", "left")
        return out.select(lexical(F.col("s")).alias("entity"), "label", "comment", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "entity").limit(top)

    def rules(self, dataset: str, most_order: int = 30) -> rules.RuleSet:
        """The stored rules: forward ones up to an order or without one, and all backward ones; unreadable ones are left out."""
        out = rules.RuleSet([])
        for role, capped in (("rules_forward", True), ("rules_backward", False)):
            found = self.store.query(
                f"SELECT ?body ?order WHERE {{ GRAPH <{self.manifest.graph(dataset, role)}> {{ ?r ex:ruleBody ?body OPTIONAL {{ ?r ex:ruleOrder ?order }} }} }} ORDER BY ASC(xsd:integer(?order))"
            ).collect()  # rules are few
            for row in found:
                if capped and row.order is not None and int(row.order) > most_order:
                    continue
                try:
                    one = rules.parse_rules(row.body, self.prefixes)
                except rules.RuleError:
                    continue
                out.rules += one.rules
                out.tabled |= one.tabled
        return out

    def reasoned(self, dataset: str, text: str) -> DataFrame:
        """The query over the normalization graph and what the stored rules derive from it, as far as the query asks for it."""
        g = self.manifest.graph(dataset, "normalization")
        base = self.store.quads.where(F.col("g") == f"<{g}>").select("s", "p", "o")
        derived = rules.inferred_for(base, self.rules(dataset).rules, parse(text, self.prefixes))
        return QuadStore(base.union(derived).select(F.lit(f"<{g}>").alias("g"), "s", "p", "o"), prefixes=self.prefixes, union_default=True).query(text)

    def playground(self, dataset: str, rule_text: str, text: str, seconds: float = 15.0) -> dict[str, DataFrame]:
        """Inferred and base rows and their difference, each at most 500."""
        out = rules.playground(self.store, self.manifest.graph(dataset, "asserted"), rule_text, text)
        return {k: within(self.spark, seconds, lambda df=df: cut(df, "playground")) for k, df in out.items()}

    # -- ingestion
    def names(self, dataset: str) -> DataFrame:
        """(local, iri) of the ontology's terms."""
        tbox = self.store.quads.where((F.col("g") == f"<{self.manifest.graph(dataset, 'tbox')}>") & F.col("s").startswith("<"))
        kinds = [f"<{OWL}{k}>" for k in ("Class", "ObjectProperty", "DatatypeProperty")]
        iri = lexical(F.col("s"))
        return tbox.where((F.col("p") == f"<{RDF}type>") & F.col("o").isin(kinds)).select(X.local_name(iri).alias("local"), iri.alias("iri")).distinct()

    def assert_entities(self, dataset: str, payloads: DataFrame) -> int:
        """Assert extracted entities and relationships; gives the number of relationships asserted."""
        g = self.manifest.graph(dataset, "asserted")
        quads, notes = ingest.statements(payloads, self.names(dataset), g, self.manifest.base_of(dataset), dataset, self.manifest.namespace)
        self.store = self.store.but(cut(self.store.quads.union(quads).distinct(), "quads"), cut(self.store.notes.union(notes).distinct(), "notes"))
        return notes.where(F.col("ap") == f"<{self.manifest.namespace}confidence>").count()

    def retract_document(self, document: str) -> None:
        self.store = self.store.without_document(f"<{document}>", f"<{self.manifest.namespace}sourceDocument>")

    def rollback(self, run: str) -> None:
        """Take back a run's statements, but for those that another run asserts too."""
        p = f"<{self.manifest.namespace}indexingRun>"
        self.store = self.store.without_document(encode(Lit(run)), p, also=p)

    def saga(self, steps) -> object:
        """Run steps in order on the service; if one fails, the store is what it was before the first.

        A step is a function of the service, or a pair of one and of what takes its
        outer effects back (files, tables, indexes); these run in reverse order for
        the steps that were done, and one that fails itself doesn't keep the others.
        """
        before, out, done = self.store, None, []
        try:
            for step in steps:
                do, undo = step if isinstance(step, tuple) else (step, None)
                out = do(self)
                done.append(undo)
        except Exception as e:
            for undo in reversed(done):
                if undo:
                    try:
                        undo(self)
                    except Exception as late:
                        e.add_note(f"not taken back: {late}")
            self.store = before
            raise
        return out

    # -- identity
    def same_as(self, dataset: str) -> DataFrame:
        g = self.manifest.graph(dataset, "normalization")
        return self.store.quads.where((F.col("g") == f"<{g}>") & (F.col("p") == SAME)).select(F.col("s").alias("a"), F.col("o").alias("b")).where("a <> b")

    def normalize(self, dataset: str, run: str, new: DataFrame, judge=None) -> DataFrame:
        """Find entities that are the same as new ones (iri, label), record them, and elect canonical ones; gives telemetry."""
        asserted = self.store.quads.where((F.col("g") == f"<{self.manifest.graph(dataset, 'asserted')}>") & (F.col("p") == f"<{RDFS}label>"))
        known = asserted.select(lexical(F.col("s")).alias("iri"), lexical(F.col("o")).alias("label"))
        pairs = cut(entities.resolve(new, known), "pairs")
        sure = pairs.where("band <> 'judge'")
        if judge is not None:
            sure = sure.union(entities.judged(pairs, judge).withColumn("method", F.lit("llm-judge")))
        g, ns = f"<{self.manifest.graph(dataset, 'normalization')}>", self.manifest.namespace

        def iri(c):
            return F.concat(F.lit("<"), c, F.lit(">"))

        quads = sure.select(F.lit(g).alias("g"), iri(F.col("iri")).alias("s"), F.lit(SAME).alias("p"), iri(F.col("other")).alias("o"), "method", "score")
        now = datetime.now(UTC).isoformat()
        facts = F.array(*(F.struct(F.lit(f"<{ns}{k}>").alias("ap"), quoted(v, XSD + t).alias("ao")) for k, v, t in (("normalizationMethod", F.col("method"), "string"), ("confidence", F.col("score").cast("string"), "decimal"), ("indexingRun", F.lit(run), "string"), ("transactionTime", F.lit(now), "dateTime"))))
        notes = quads.select(*QUAD, F.explode(facts).alias("n")).select(*QUAD, "n.ap", "n.ao")
        self.store = self.store.but(cut(self.store.quads.union(quads.select(*QUAD)).distinct(), "quads"), cut(self.store.notes.union(notes.select(*NOTE)).distinct(), "notes"))
        self.elect(dataset, new.select(iri(F.col("iri")).alias("node")))
        return entities.telemetry(new, pairs)

    def elect(self, dataset: str, touched: DataFrame | None = None) -> None:
        """Put isCanonical on the elected entity of each cluster (that touches the given nodes), and nowhere else in it."""
        edges = cut(self.same_as(dataset), "same")
        members = connected_components(edges)
        if touched is not None:
            members = members.join(members.join(touched, "node", "left_semi").select("root").distinct(), "root", "left_semi")
        members = cut(members.select("node", "root"), "members")
        g, p = f"<{self.manifest.graph(dataset, 'normalization')}>", f"<{self.manifest.namespace}isCanonical>"
        stale = members.select(F.lit(g).alias("g"), F.col("node").alias("s"), F.lit(p).alias("p"))
        marks = graph.elect(edges, members).select(F.lit(g).alias("g"), F.col("node").alias("s"), F.lit(p).alias("p"), F.lit(f'"true"^^<{XSD}boolean>').alias("o"))
        self.store = self.store.but(cut(self.store.quads.join(stale, ["g", "s", "p"], "left_anti").select(*QUAD).union(marks), "quads"))

    def forget_run(self, dataset: str, run: str) -> None:
        """Delete a run's identities and elect anew in the clusters they held together."""
        p = f"<{self.manifest.namespace}indexingRun>"
        g = f"<{self.manifest.graph(dataset, 'normalization')}>"
        hit = self.store.notes.where((F.col("g") == g) & (F.col("ap") == p) & (F.col("ao") == encode(Lit(run)))).select(*QUAD).distinct()
        touched = cut(hit.select(F.col("s").alias("node")).union(hit.select(F.col("o").alias("node"))).distinct(), "touched")
        canonical = f"<{self.manifest.namespace}isCanonical>"
        marks = touched.select(F.lit(g).alias("g"), F.col("node").alias("s"), F.lit(canonical).alias("p"))
        quads = self.store.quads.join(hit, list(QUAD), "left_anti").join(marks, ["g", "s", "p"], "left_anti").select(*QUAD)
        self.store = self.store.but(cut(quads, "quads"), cut(self.store.notes.join(hit, list(QUAD), "left_anti").select(*NOTE), "notes"))
        self.elect(dataset, touched)

    def materialize(self, dataset: str, which: str = "same_as") -> int:
        """Replace the inferred graph by what follows from identity (or by all stored rules); gives the number of deductions."""
        both = [self.store.quads.where(F.col("g") == f"<{self.manifest.graph(dataset, r)}>").select("s", "p", "o") for r in ("normalization", "asserted")]
        base = reduce(DataFrame.union, both).distinct()
        if which == "same_as":
            edges = self.same_as(dataset)
            derived = graph.same_as(base, connected_components(edges).select("root", "node"), SAME)
        else:
            derived = rules.derive(base, self.rules(dataset, 1 << 30).rules)
        g = f"<{self.manifest.graph(dataset, 'inferred')}>"
        new = cut(derived.select(F.lit(g).alias("g"), "s", "p", "o"), "inferred")
        self.store = self.store.but(self.store.quads.where(F.col("g") != g).union(new))
        return new.count()

    def clusters(self, dataset: str) -> DataFrame:
        """(root, canonical, status, size, edges, label): largest first."""
        edges = cut(self.same_as(dataset), "same")
        members = connected_components(edges).select("node", "root")
        g = f"<{self.manifest.graph(dataset, 'normalization')}>"
        marked = self.store.quads.where((F.col("g") == g) & (F.col("p") == f"<{self.manifest.namespace}isCanonical>")).select(F.col("s").alias("node"))
        n = edges.join(members, edges["a"] == members["node"]).groupBy("root").agg(F.count("*").alias("edges"))
        found = graph.status(members, graph.elect(edges, members), marked).join(n, "root", "left")
        asserted = self.store.quads.where(F.col("g") == f"<{self.manifest.graph(dataset, 'asserted')}>")

        def first(p, name):
            return asserted.where(F.col("p") == f"<{p}>").groupBy(F.col("s").alias("canonical")).agg(F.min(lexical(F.col("o"))).alias(name))

        named = found.join(first(RDFS + "label", "_label"), "canonical", "left").join(first(self.manifest.namespace + "slug", "_slug"), "canonical", "left")
        out = named.select("root", lexical(F.col("canonical")).alias("canonical"), "status", "size", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("_label", "_slug", X.local_name(lexical(F.col("canonical")))).alias("label"))
        return out.orderBy(F.desc("size"), F.desc("edges"), "canonical")

    def normalization_page(self, dataset: str, page: int = 1, size: int = 25, seconds: float = 30.0, refresh: bool = False) -> DataFrame:
        """A page of the clusters, from a table that is kept for some seconds while the store stays the same."""
        kept = self._pages.get(dataset)
        if refresh or kept is None or kept[0] is not self.store or time.monotonic() - kept[1] > seconds:
            kept = self._pages[dataset] = (self.store, time.monotonic(), cut(self.clusters(dataset), "clusters"))
        return kept[2].orderBy(F.desc("size"), F.desc("edges"), "canonical").offset((page - 1) * size).limit(size)

    # -- pages and health
    def ontology(self, dataset: str) -> DataFrame:
        """(term, kind, label, domains, ranges) of the ontology."""
        return self.tbox(
            dataset,
            "SELECT ?term (SAMPLE(?t) AS ?kind) (SAMPLE(?l) AS ?label) (GROUP_CONCAT(DISTINCT ?d; SEPARATOR=' ') AS ?domains) (GROUP_CONCAT(DISTINCT ?r; SEPARATOR=' ') AS ?ranges) "
            "{ ?term a ?t FILTER(?t IN (owl:Class, owl:ObjectProperty, owl:DatatypeProperty) && isIRI(?term)) OPTIONAL { ?term rdfs:label ?l } OPTIONAL { ?term rdfs:domain ?d } OPTIONAL { ?term rdfs:range ?r } } GROUP BY ?term ORDER BY ?term",
        )

    def entity(self, dataset: str, iri: str) -> dict[str, DataFrame]:
        """An entity's page: outgoing, incoming, those of its peers, inferred statements, and source documents."""
        a, n, i = (self.manifest.graph(dataset, r) for r in ("asserted", "normalization", "inferred"))
        q = self.store.query
        return {
            "outgoing": q(f"SELECT ?p ?o {{ GRAPH <{a}> {{ <{iri}> ?p ?o }} }} ORDER BY ?p ?o"),
            "incoming": q(f"SELECT ?s ?p {{ GRAPH <{a}> {{ ?s ?p <{iri}> }} FILTER(?p != owl:sameAs) }} ORDER BY ?s ?p"),
            "peers": q(f"SELECT DISTINCT ?peer {{ GRAPH <{n}> {{ <{iri}> (owl:sameAs|^owl:sameAs)+ ?peer }} FILTER(?peer != <{iri}>) }} ORDER BY ?peer"),
            "peers_incoming": q(f"SELECT ?s ?p ?peer {{ GRAPH <{n}> {{ <{iri}> (owl:sameAs|^owl:sameAs)+ ?peer }} GRAPH <{a}> {{ ?s ?p ?peer }} FILTER(?peer != <{iri}>) }} ORDER BY ?s ?p"),
            "inferred": q(f"SELECT ?p ?o {{ GRAPH <{i}> {{ <{iri}> ?p ?o }} }} ORDER BY ?p ?o"),
            "documents": q(f"SELECT ?doc (COUNT(*) AS ?n) {{ GRAPH <{a}> {{ << <{iri}> ?p ?o >> ex:sourceDocument ?doc }} }} GROUP BY ?doc ORDER BY DESC(?n) ?doc"),
        }

    def find_entity(self, dataset: str, suffix: str) -> DataFrame:
        return self.store.query(f"SELECT DISTINCT ?e {{ GRAPH <{self.manifest.graph(dataset, 'asserted')}> {{ ?e a ?t }} FILTER(STRENDS(STR(?e), '{suffix}')) }} ORDER BY ?e LIMIT 1")

    def neighbourhood(self, dataset: str, iri: str, depth: int = 1, cap: int = 500) -> tuple[DataFrame, list[bool]]:
        a = f"<{self.manifest.graph(dataset, 'asserted')}>"
        edges = self.store.quads.where((F.col("g") == a) & (F.col("p") != SAME) & F.col("s").startswith("<") & F.col("o").startswith("<")).select(F.col("s").alias("a"), F.col("o").alias("b"))
        return graph.hops(edges, self.spark.createDataFrame([(f"<{iri}>",)], "node string"), depth, cap)

    def metrics(self) -> DataFrame:
        """(graph, n): statements by graph."""
        return self.store.quads.groupBy(lexical(F.col("g")).alias("graph")).agg(F.count("*").alias("n")).orderBy("graph")
