"""Graphs on disk against graphs in memory, and what their files and plans look like."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quadrille.operators.quads import NOTE, QUAD, QuadStore
from quadrille.operators.stored import Conflict, StoredGraph, versions

T = "http://t/"
PREFIXES = {"t": T}


def rows(seed=1, n=60):
    r = random.Random(seed)
    iri = lambda k: f"<{T}{k}>"
    quads = {(iri(f"g{r.randrange(2)}"), iri(f"s{r.randrange(8)}"), iri(f"p{r.randrange(4)}"), r.choice([iri(f"s{r.randrange(8)}"), f'"{r.randrange(5)}"^^<http://www.w3.org/2001/XMLSchema#integer>', '"x \\"y\\""'])) for _ in range(n)}
    notes = {(*q, iri(r.choice(("doc", "run"))), iri(f"d{r.randrange(3)}")) for q in sorted(quads) if r.random() < 0.6}
    return sorted(quads), sorted(notes)


def pair(spark, tmp_path, seed=1, **more):
    """The same graphs in memory and on disk."""
    quads, notes = rows(seed)
    q, n = spark.createDataFrame(quads, ", ".join(f"{c} string" for c in QUAD)), spark.createDataFrame(notes, ", ".join(f"{c} string" for c in NOTE))
    return QuadStore(q, n, PREFIXES), StoredGraph.create(spark, f"file://{tmp_path}/store{seed}", q, n, buckets=4, prefixes=PREFIXES, **more)


def bag(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


QUERIES = [
    "SELECT * { GRAPH ?g { ?s ?p ?o } }",
    "SELECT ?s ?a ?b { GRAPH t:g0 { ?s t:p0 ?a ; t:p1 ?b ; t:p2 ?unused } }",
    "SELECT ?p (COUNT(*) AS ?n) (MIN(?o) AS ?m) { GRAPH t:g1 { ?s ?p ?o } } GROUP BY ?p ORDER BY ?p",
    "SELECT ?s ?x FROM t:g0 FROM t:g1 { ?s t:p0 ?o OPTIONAL { ?s t:p3 ?x } MINUS { ?s t:p1 t:s2 } }",
    "SELECT ?s ?v { VALUES ?s { t:s1 t:s2 t:none } GRAPH t:g0 { ?s t:p1 ?v } FILTER NOT EXISTS { GRAPH t:g1 { ?s t:p0 ?v } } }",
    "SELECT ?a ?b { GRAPH t:g0 { ?a (t:p0|^t:p1)+ ?b } }",
    "SELECT ?a ?b { GRAPH t:g0 { ?a t:p0/t:p1 ?b } }",
    "SELECT ?s ?d { GRAPH ?g { << ?s t:p0 ?o >> t:doc ?d } }",
    "SELECT ?s ?n { GRAPH t:g0 { ?s t:p0 ?o } { SELECT ?s (COUNT(?x) AS ?n) { GRAPH t:g1 { ?s ?q ?x } } GROUP BY ?s } BIND(STR(?o) AS ?t) FILTER(?t != '') }",
    "SELECT ?s { GRAPH t:g0 { ?s t:p0 ?s } }",
    "CONSTRUCT { ?s t:new ?o } WHERE { GRAPH t:g1 { ?s t:p2 ?o } }",
    "ASK { GRAPH t:g0 { t:s1 ?p ?o } }",
    "SELECT ?s { GRAPH t:nowhere { ?s ?p ?o } }",
]


def test_queries_equal_those_in_memory(spark, tmp_path):
    memory, disk = pair(spark, tmp_path)
    for text in QUERIES:
        assert bag(disk.query(text)) == bag(memory.query(text)), text
    assert bag(disk.quads) == bag(memory.quads) and bag(disk.notes) == bag(memory.notes)


UPDATES = [
    "INSERT DATA { GRAPH t:g0 { t:new t:p0 'a' ; t:p9 t:s1 } GRAPH t:g7 { t:new t:p0 t:s1 } }",
    "DELETE WHERE { GRAPH t:g0 { t:s1 ?p ?o } }",
    "DELETE { GRAPH ?g { ?s t:p1 ?o } } INSERT { GRAPH ?g { ?o t:back ?s } } WHERE { GRAPH ?g { ?s t:p1 ?o } }",
    "DELETE WHERE { GRAPH t:g1 { ?s t:p2 ?o } } ; INSERT DATA { GRAPH t:g1 { t:s1 t:p2 t:s2 } }",
    "INSERT { GRAPH t:g0 { << ?s t:p0 ?o >> t:doc t:d9 } } WHERE { GRAPH t:g0 { ?s t:p0 ?o } }",
    "CLEAR GRAPH t:g1",
]


def test_updates_equal_those_in_memory(spark, tmp_path):
    memory, disk = pair(spark, tmp_path, 2)
    for i, text in enumerate(UPDATES):
        memory, disk = memory.update(text), disk.update(text)
        assert bag(disk.quads) == bag(memory.quads) and bag(disk.notes) == bag(memory.notes.distinct() if i else memory.notes), text
    again = StoredGraph.open(spark, disk.path, prefixes=PREFIXES)
    assert again.version == disk.version and bag(again.quads) == bag(memory.quads)


def test_updates_leave_other_parts_alone(spark, tmp_path):
    _, disk = pair(spark, tmp_path, 3)
    path = Path(disk.path.removeprefix("file://"))
    before = {f: (f.stat().st_mtime_ns, f.stat().st_size) for f in path.rglob("*.parquet")}
    new = disk.update("INSERT DATA { GRAPH t:g0 { t:a t:p0 t:b } }")
    assert {f: (f.stat().st_mtime_ns, f.stat().st_size) for f in before} == before
    moved = [k for k in new.version.quads if disk.version.quads.get(k) != new.version.quads[k]]
    assert len(moved) == 1 and new.version.notes == disk.version.notes
    files = len(list(path.rglob("*.parquet")))
    cleared = new.without_graphs([f"<{T}g0>"])
    assert len(list(path.rglob("*.parquet"))) == files and all(cleared.version.quads[k] == new.version.quads[k] for k in cleared.version.quads)
    # The version before is still whole.
    assert bag(StoredGraph.open(spark, disk.path, disk.version.number, prefixes=PREFIXES).quads) == bag(disk.quads)


def test_plans_read_named_parts_and_join_without_a_shuffle(spark, tmp_path):
    _, disk = pair(spark, tmp_path, 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = disk.tables["quads"]
        a, b = (ids.where((F.col("g") == disk.constant(f"<{T}g0>")) & (F.col("p") == disk.constant(f"<{T}{p}>"))).select("s", F.col("o").alias(p)) for p in ("p0", "p1"))
        plan = a.join(b, "s")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and plan.count("Bucketed: true") == 2
        whole = disk.query("SELECT ?s { GRAPH t:g0 { ?s t:p0 ?a ; t:p1 ?b } }")._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in whole.splitlines() if "FileScan" in x and "PartitionFilters" in x and "g#" in x]
        assert len(scans) == 2 and all("isnotnull(g#" in x and "isnotnull(p#" in x for x in scans)
        assert all("1 paths" in x for x in scans)
        # ?a and ?b are asked for by nothing else: one lookup of terms, for ?s.
        assert whole.count("FileScan parquet [id#") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_terms_that_share_an_id(spark, tmp_path):
    """Ids of 4 bits: most terms collide, and nothing is mixed up."""
    memory, disk = pair(spark, tmp_path, 5, bits=4)
    assert len(disk.version.odd) > 5 and disk.terms_table.groupBy("id").count().where("count > 1").count() == 0
    for text in QUERIES[:8]:
        if "t:none" not in text and "t:nowhere" not in text:
            assert bag(disk.query(text)) == bag(memory.query(text)), text
    text = "INSERT DATA { GRAPH t:g0 { t:other t:p0 'more' . t:s1 t:p0 'terms' , t:x1 , t:x2 } }"
    assert bag(disk.update(text).quads) == bag(memory.update(text).quads)


def test_one_of_two_writers_wins(spark, tmp_path):
    _, first = pair(spark, tmp_path, 6)
    second = StoredGraph.open(spark, first.path, prefixes=PREFIXES)
    won = first.update("INSERT DATA { GRAPH t:g0 { t:a t:won t:b } }")
    with pytest.raises(Conflict):
        second.update("INSERT DATA { GRAPH t:g0 { t:a t:lost t:b } }")
    now = StoredGraph.open(spark, first.path, prefixes=PREFIXES)
    assert now.version == won.version and now.ask("ASK { GRAPH t:g0 { t:a t:won t:b } }") and not now.ask("ASK { GRAPH t:g0 { t:a t:lost t:b } }")
    assert not [p for p in Path(first.path.removeprefix("file://"), "log").iterdir() if p.name.endswith(".tmp")]


def test_documents_graphs_snapshots_and_old_files(spark, tmp_path):
    memory, disk = pair(spark, tmp_path, 7)
    doc, by, run = f"<{T}d1>", f"<{T}doc>", f"<{T}run>"
    for store, more in ((disk, {}), (disk_copy(spark, tmp_path), {"also": run})):
        got = store.without_document(doc, by, **more)
        want = memory.without_document(doc, by, **more)
        assert bag(got.quads) == bag(want.quads) and bag(got.notes) == bag(want.notes)
    disk = StoredGraph.open(spark, disk.path, prefixes=PREFIXES)
    snap = disk.snapshot().where(F.col("g") == f"<{T}g0>")
    saved = snap.collect()
    back = disk.without_graphs([f"<{T}g0>"]).restore(spark.createDataFrame(saved, snap.schema))
    assert bag(back.quads) == bag(disk.quads) and bag(back.notes) == bag(disk.notes)
    other = spark.createDataFrame([(f"<{T}only>", f"<{T}p0>", '"one"')], "s string, p string, o string")
    swapped = back.replaced(f"<{T}g0>", other)
    assert bag(swapped.quads.where(F.col("g") == f"<{T}g0>")) == [(f"<{T}g0>", f"<{T}only>", f"<{T}p0>", '"one"')]
    assert bag(swapped.quads.where(F.col("g") == f"<{T}g1>")) == bag(back.quads.where(F.col("g") == f"<{T}g1>"))
    before = bag(swapped.quads)
    assert swapped.vacuum() > 0 and versions(spark, swapped.path) == [swapped.version.number]
    assert bag(StoredGraph.open(spark, swapped.path, prefixes=PREFIXES).quads) == before


def disk_copy(spark, tmp_path):
    quads, notes = rows(7)
    q, n = spark.createDataFrame(quads, ", ".join(f"{c} string" for c in QUAD)), spark.createDataFrame(notes, ", ".join(f"{c} string" for c in NOTE))
    return StoredGraph.create(spark, f"file://{tmp_path}/copy", q, n, prefixes=PREFIXES)


def test_an_empty_store(spark, tmp_path):
    s = StoredGraph.create(spark, f"file://{tmp_path}/empty", prefixes=PREFIXES)
    assert s.quads.count() == 0 and s.query("SELECT * { GRAPH ?g { ?s ?p ?o } }").count() == 0
    assert bag(s.update("INSERT DATA { GRAPH t:g { t:a t:b t:c } }").quads) == [(f"<{T}g>", f"<{T}a>", f"<{T}b>", f"<{T}c>")]
    with pytest.raises(Conflict):
        StoredGraph.create(spark, f"file://{tmp_path}/empty")
