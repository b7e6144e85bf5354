"""SPARQL algebra to DataFrames, over any source of triple patterns.

A variable is bound by a Term: the key columns of an IRI template, a typed
literal column, or one column of encoded RDF terms. Joins of equal templates are
equi-joins on their keys and literals stay native, so Catalyst sees plain
columns; terms are rendered as strings only where different kinds meet and in
the result. Errors in expressions are null, as SPARQL leaves them unbound.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.plans.sparql import AGGREGATES, XSD, Call, Group, Iri, Lit, Path, Quoted, Select, SparqlError, Triple, Var, parse

_count = itertools.count()
NUMERIC = {XSD + t for t in ("integer", "decimal", "double", "float", "int", "long", "gYear")}


def fresh(prefix: str = "c") -> str:
    return f"_{prefix}{next(_count)}"


@dataclass(frozen=True)
class Term:
    """kind: iri (template over cols), lit (typed col) or enc (encoded col)."""

    kind: str
    cols: tuple[str, ...]
    template: str = ""
    datatype: str = XSD + "string"
    maybe: bool = False


def encode(node) -> str:
    """A constant as an encoded term, as in N-Triples; of a literal only quotes and backslashes are escaped."""
    if isinstance(node, Iri):
        return f"<{node.value}>"
    if isinstance(node, Lit):
        safe = node.value.replace("\\", "\\\\").replace('"', '\\"')
        return f'"{safe}"' + (f"@{node.lang}" if node.lang else "" if node.datatype == XSD + "string" else f"^^<{node.datatype}>")
    raise SparqlError(f"not a constant: {node}")


_TAIL = r'"(@[A-Za-z0-9-]+|\^\^<[^<>]*>)?$'


def quoted(c: Column, datatype: str = XSD + "string") -> Column:
    """A string column as encoded literals."""
    safe = F.when(c.contains('"') | c.contains("\\"), F.regexp_replace(c, r'(["\\])', r"\\$1")).otherwise(c)
    return F.concat(F.lit('"'), safe, F.lit('"' if datatype == XSD + "string" else f'"^^<{datatype}>'))


def lexical(c: Column) -> Column:
    """What STR() gives of an encoded term."""
    inner = F.regexp_replace(c.substr(F.lit(2), F.length(c)), _TAIL, "")
    plain = F.when(inner.contains("\\"), F.regexp_replace(inner, r"\\(.)", "$1")).otherwise(inner)
    return F.when(c.startswith("<"), c.substr(F.lit(2), F.length(c) - 2)).when(c.startswith('"'), plain).otherwise(c)


_NUMBER = r'"\^\^<http://www\.w3\.org/2001/XMLSchema#(integer|decimal|double|float|int|long|short|byte|gYear|(nonNegative|positive|nonPositive|negative)Integer)>$'


def ranked(c: Column) -> tuple[Column, Column, Column]:
    """Columns that order encoded terms as SPARQL does: blank nodes, IRIs, numbers by value, other literals; null where unbound."""
    text = lexical(c)
    number = F.when(c.rlike(_NUMBER), text.try_cast("double"))
    kind = F.when(c.isNull(), None).when(c.startswith("_:"), 0).when(c.startswith("<"), 1).when(number.isNotNull(), 2).otherwise(3)
    return kind, number, text


def render(t: Term) -> Column:
    """The encoded form of a term."""
    if t.kind == "enc":
        return F.col(t.cols[0])
    if t.kind == "lit":
        return quoted(F.col(t.cols[0]).cast("string"), t.datatype)
    return F.concat(F.lit("<"), iri_text(t), F.lit(">"))


def iri_text(t: Term) -> Column:
    parts = re.split(r"\{\}", t.template)
    out = [F.lit(parts[0])]
    for c, p in zip(t.cols, parts[1:], strict=True):
        out += [F.col(c).cast("string"), F.lit(p)]
    return F.concat(*out)


def value(t: Term) -> Column:
    """The result column of a term: IRI text, native literal, or lexical form."""
    if t.kind == "iri":
        return iri_text(t)
    return F.col(t.cols[0]) if t.kind == "lit" else lexical(F.col(t.cols[0]))


def unifiable(a: str, b: str) -> bool:
    x, y = a.split("{}")[0], b.split("{}")[0]
    return x.startswith(y) or y.startswith(x)


@dataclass
class Rel:
    """Solutions: a DataFrame and the terms of its variables. Columns are named once only."""

    df: DataFrame
    terms: dict[str, Term]

    def renamed(self) -> Rel:
        """The same solutions under new column names, so that it can be joined again."""
        names = {c: fresh() for t in self.terms.values() for c in t.cols}
        return Rel(self.df.select(*(F.col(a).alias(b) for a, b in names.items())) if names else self.df.select(F.lit(1).alias(fresh())), {v: replace(t, cols=tuple(names[c] for c in t.cols)) for v, t in self.terms.items()})


def same(a: Rel, b: Rel, names: list[str]) -> Column | None:
    """Whether these variables are equal; each is bound on both sides."""
    out = None
    for v in names:
        x, y = a.terms[v], b.terms[v]
        if x.kind == y.kind == "iri" and x.template == y.template:
            pairs = [(F.col(p), F.col(q)) for p, q in zip(x.cols, y.cols, strict=True)]
        elif x.kind == y.kind == "lit":
            pairs = [(F.col(x.cols[0]), F.col(y.cols[0]))]
        else:
            pairs = [(render(x), render(y))]
        for p, q in pairs:
            out = p == q if out is None else out & (p == q)
    return out


def apart(rel: Rel, names: list[str]) -> list[tuple[frozenset, DataFrame]]:
    """The solutions by which of these variables are unbound. Parts in which all are bound come first."""
    out = []
    for unbound in itertools.product((False, True), repeat=len(names)):
        df = rel.df
        for v, none in zip(names, unbound, strict=True):
            c = F.col(rel.terms[v].cols[0])
            df = df.where(c.isNull() if none else c.isNotNull())
        out.append((frozenset(v for v, none in zip(names, unbound, strict=True) if none), df))
    return out


def compatible(a: Rel, b: Rel):
    """(part of a, [(part of b, shared variables that are bound in both)], unbound in a): an unbound side is compatible with anything.

    Parts keep joins equi-joins: only rows without a variable are joined without it.
    """
    shared = [v for v in a.terms if v in b.terms]
    right = apart(b, [v for v in shared if b.terms[v].maybe])
    for none, left in apart(a, [v for v in shared if a.terms[v].maybe]):
        yield left, [(df, [v for v in shared if v not in none and v not in other]) for other, df in right], none


def join(a: Rel, b: Rel, how: str = "inner", extra=None) -> Rel:
    shared = [v for v in a.terms if v in b.terms]
    clash = [v for v in shared if a.terms[v].kind == b.terms[v].kind == "iri" and not unifiable(a.terms[v].template, b.terms[v].template)]
    if how == "inner" and any(not a.terms[v].maybe and not b.terms[v].maybe for v in clash):
        b = Rel(b.df.where("false"), b.terms)
    parts = []
    for left, rights, none in compatible(a, b):
        terms = {**a.terms, **{v: t for v, t in b.terms.items() if v not in a.terms or v in none}}
        rest, more = left, extra(terms) if extra else None
        for df, names in rights:
            condition = same(a, b, names)
            if more is not None:
                condition = more if condition is None else condition & more
            if how == "left" and len(rights) == 1:
                parts.append(left.join(df, F.lit(True) if condition is None else condition, "left"))
                continue
            parts.append(left.crossJoin(df) if condition is None else left.join(df, condition))
            if how == "left":
                rest = rest.join(df, F.lit(True) if condition is None else condition, "left_anti")
        if how == "left" and len(rights) > 1:
            parts.append(rest.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in b.df.schema)))
    df = parts[0]
    for p in parts[1:]:
        df = df.union(p)
    terms = {**a.terms, **{v: replace(t, maybe=t.maybe or how == "left") for v, t in b.terms.items() if v not in a.terms}}
    for v in shared:
        x, y = a.terms[v], b.terms[v]
        if x.maybe:
            name = fresh()
            df = df.withColumn(name, F.coalesce(render(x), render(y)))
            terms[v] = Term("enc", (name,), maybe=y.maybe or how == "left")
    return Rel(df, terms)


def matched(a: Rel, b: Rel, keep: bool, extra=None, disjoint: bool = True) -> Rel:
    """The solutions of a that some solution of b is compatible with (keep), or none. disjoint: also where no variable is shared."""
    parts = []
    for left, rights, none in compatible(a, b):
        terms = {**a.terms, **{v: t for v, t in b.terms.items() if v not in a.terms or v in none}}
        more, rest = extra(terms) if extra else None, left
        for i, (df, names) in enumerate(rights):
            condition = same(a, b, names)
            if condition is None and not disjoint:
                continue
            if more is not None:
                condition = more if condition is None else condition & more
            condition = F.lit(True) if condition is None else condition
            if keep:
                parts.append(rest.join(df, condition, "left_semi"))
            if not keep or i + 1 < len(rights):
                rest = rest.join(df, condition, "left_anti")
        if not keep:
            parts.append(rest)
    df = parts[0] if parts else a.df.where("false")
    for p in parts[1:]:
        df = df.union(p)
    return Rel(df, a.terms)


#: Functions whose value is there whenever their arguments are.
TOTAL = {"STR", "IRI", "URI", "LCASE", "UCASE", "STRLEN", "MD5", "SHA256", "CONTAINS", "STRSTARTS", "STRENDS", "CONCAT", "REGEX", "REPLACE", "STRBEFORE", "STRAFTER", "LANG"}


def total(e, terms) -> bool:
    """Whether an expression has a value in every solution."""
    if isinstance(e, Var):
        return e.name in terms and not terms[e.name].maybe
    if isinstance(e, Call):
        if e.op == "COALESCE":
            return any(total(a, terms) for a in e.args)
        return e.op in TOTAL and all(total(a, terms) for a in e.args)
    return True


class Engine:
    """Evaluates queries; a subclass says what a basic graph pattern is."""

    prefixes: dict[str, str] = {}

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def bgp(self, triples: list[Triple], graph) -> Rel:
        raise NotImplementedError

    # -- entry
    def query(self, text: str, graphs: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
        """The solutions, one column for each variable in query order. graphs: a default graph to add; limit: the most rows."""
        q = parse(text, self.prefixes)
        q.graphs += [Iri(g) for g in graphs]
        if limit is not None and (q.limit is None or not 0 < q.limit <= limit):
            q.limit = limit
        return self.run(q)

    def ask(self, text: str) -> bool:
        return bool(self.select(parse(text, self.prefixes)).df.limit(1).count())

    def run(self, q: Select) -> DataFrame:
        if q.kind == "ASK":
            found = self.select(q).df.limit(1).agg(F.count("*").alias("n"))
            return found.select((F.col("n") > 0).alias("ask"))
        if q.kind == "CONSTRUCT":
            rel, parts = self.group(q.where, self.default(q)), []
            for t in q.template:
                cols = [render(rel.terms[x.name]) if isinstance(x, Var) else F.lit(encode(x)) for x in (t.s, t.p, t.o)]
                parts.append(rel.df.select(*(c.alias(n) for c, n in zip(cols, "spo", strict=True))).dropna())
            out = parts[0]
            for x in parts[1:]:
                out = out.union(x)
            return out.distinct()
        rel = self.select(q)
        return self.shown(rel, q, value)

    def shown(self, rel: Rel, q: Select, how) -> DataFrame:
        names = [v if isinstance(v, str) else v[1] for v in q.vars] or sorted(v for v in rel.terms if not v.startswith("."))
        return rel.df.select(*((how(rel.terms[v]) if v in rel.terms else F.lit(None).cast("string")).alias(v) for v in names))

    def terms(self, text: str, graphs: tuple[str, ...] = ()) -> DataFrame:
        """The solutions of a SELECT as encoded terms, with datatypes and languages; for results that leave the engine."""
        q = parse(text, self.prefixes)
        q.graphs += [Iri(g) for g in graphs]
        if q.kind != "SELECT":
            raise SparqlError("only a SELECT has terms")
        rel = self.select(q)
        kinds = {"bigint": "integer", "int": "integer", "smallint": "integer", "double": "double", "float": "double", "boolean": "boolean", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime"}
        types = dict(rel.df.dtypes)

        def how(t: Term) -> Column:
            if t.kind == "lit" and t.datatype == XSD + "string":
                t = replace(t, datatype=XSD + kinds.get(types[t.cols[0]], "decimal" if types[t.cols[0]].startswith("decimal") else "string"))
            return render(t)

        return self.shown(rel, q, how)

    def default(self, q: Select):
        return tuple(g.value for g in q.graphs) or None

    def select(self, q: Select) -> Rel:
        rel = self.group(q.where, self.default(q))
        grouped = q.group or any(not isinstance(v, str) and has_aggregate(v[0]) for v in q.vars)
        if grouped:
            rel = self.aggregate(rel, q)
        else:
            for v in q.vars:
                if not isinstance(v, str):
                    rel = self.bind(rel, v[0], v[1])
        names = [v if isinstance(v, str) else v[1] for v in q.vars]
        if q.distinct:
            keep = {v: rel.terms[v] for v in names or rel.terms if v in rel.terms and not v.startswith(".")}
            rel = Rel(rel.df.select(*(c for t in keep.values() for c in t.cols)).distinct(), keep)
        if q.order:
            keys = [(k, down) for e, down in q.order for k in self.order_keys(e, rel)]
            rel = Rel(rel.df.orderBy(*(k.desc_nulls_last() if down else k.asc_nulls_first() for k, down in keys)), rel.terms)
        if q.offset:
            rel = Rel(rel.df.offset(q.offset), rel.terms)
        if q.limit is not None:
            rel = Rel(rel.df.limit(q.limit), rel.terms)
        return rel

    def order_keys(self, e, rel: Rel) -> tuple[Column, ...]:
        if isinstance(e, Var) and e.name in rel.terms and rel.terms[e.name].kind == "enc":
            return ranked(render(rel.terms[e.name]))
        return (self.expr(e, rel.terms),)

    def aggregate(self, rel: Rel, q: Select) -> Rel:
        for g in q.group:
            if not isinstance(g, str):
                rel = self.bind(rel, *g)
        keys = [g if isinstance(g, str) else g[1] for g in q.group]
        terms = {k: rel.terms[k] for k in keys}
        wanted, aggs = {}, {}

        def lift(e):
            if isinstance(e, Call) and e.op in AGGREGATES:
                if e not in aggs:
                    aggs[e] = fresh("a")
                return Var(aggs[e])
            return replace(e, args=tuple(lift(a) for a in e.args)) if isinstance(e, Call) else e

        for v in q.vars:
            if not isinstance(v, str):
                wanted[v[1]] = lift(v[0])
        having = [lift(h) for h in q.having]
        order = [(lift(e), down) for e, down in q.order]
        cols = [self.agg(e, rel).alias(name) for e, name in aggs.items()] or [F.count("*").alias(fresh())]
        df = rel.df.groupBy(*(c for t in terms.values() for c in t.cols)).agg(*cols)
        kept = {n for e, n in aggs.items() if e.op in ("MIN", "MAX", "SAMPLE") and isinstance(e.args[0], Var) and e.args[0].name in rel.terms and rel.terms[e.args[0].name].kind == "enc"}
        out = Rel(df, {**terms, **{n: Term("enc" if n in kept else "lit", (n,), maybe=n in kept) for n in aggs.values()}})
        for h in having:
            out = Rel(out.df.where(self.expr(h, out.terms)), out.terms)
        for name, e in wanted.items():
            out = self.bind(out, e, name)
        q.order = order
        return out

    def agg(self, e: Call, rel: Rel) -> Column:
        if e.args == ("*",):
            return F.count("*")
        x = e.args[0]
        key = rel.terms.get(x.name) if isinstance(x, Var) else None
        c = render(key) if key is not None and key.kind == "iri" else self.expr(x, rel.terms)
        if e.op == "COUNT":
            if key is not None and key.kind == "iri":
                return F.count_distinct(*map(F.col, key.cols)) if e.distinct else F.count(F.col(key.cols[0]))
            return F.count_distinct(c) if e.distinct else F.count(c)
        if e.op in ("MIN", "MAX", "SAMPLE") and key is not None and key.kind == "enc":  # by value, with the term that has it
            kind, number, lex = ranked(render(key))
            best = F.when(kind.isNotNull(), F.struct(kind.alias("k"), number.alias("n"), lex.alias("x"), render(key).alias("term")))
            return (F.max(best) if e.op == "MAX" else F.min(best)).getField("term")
        number = self.number(x, rel.terms) if e.op in ("SUM", "AVG") else c
        if e.op == "SUM":
            return F.coalesce((F.sum_distinct if e.distinct else F.sum)(number), F.lit(0))
        if e.op == "AVG":
            return F.coalesce(F.avg(number).cast("double"), F.lit(0.0))
        text = self.text(x, rel.terms)
        if e.op == "GROUP_CONCAT":
            return F.array_join(F.array_sort((F.collect_set if e.distinct else F.collect_list)(text)), e.sep)
        return F.max(c) if e.op == "MAX" else F.min(c)  # SAMPLE is the least, so that reruns agree

    # -- groups
    def group(self, g: Group, graph) -> Rel:
        rel, filters = None, []

        def with_(b: Rel) -> Rel:
            return b if rel is None else join(rel, b.renamed() if set(rel.df.columns) & set(b.df.columns) else b)

        for part in g.parts:
            if isinstance(part, list):
                rel = with_(self.patterns(part, graph))
                continue
            kind = part[0]
            if kind == "filter":
                filters.append(part[1])
            elif kind == "group":
                rel = with_(self.group(part[1], graph))
            elif kind == "graph":
                rel = with_(self.group(part[2], part[1]))
            elif kind == "select":
                sub = self.select(part[1])
                names = [v if isinstance(v, str) else v[1] for v in part[1].vars] or list(sub.terms)
                rel = with_(Rel(sub.df, {v: sub.terms[v] for v in names if v in sub.terms}).renamed())
            elif kind == "union":
                rel = with_(self.union([self.group(b, graph) for b in part[1]]))
            elif kind == "values":
                rel = with_(self.inline(part[1], part[2]))
            elif kind == "bind":
                rel = self.bind(rel or self.unit(), part[1], part[2])
            elif kind == "optional":
                inner = Group([p for p in part[1].parts if not (isinstance(p, tuple) and p[0] == "filter")])
                conditions = [p[1] for p in part[1].parts if isinstance(p, tuple) and p[0] == "filter"]
                right = self.group(inner, graph).renamed()

                def extra(terms, conditions=conditions):
                    out = F.lit(True)
                    for c in conditions:
                        out = out & self.expr(c, terms)
                    return out

                rel = join(rel or self.unit(), right, "left", extra if conditions else None)
            elif kind == "minus":
                rel = self.without(rel, part[1], graph)
        rel = rel or self.unit()
        for f in filters:
            if isinstance(f, Call) and f.op in ("EXISTS", "NOT EXISTS"):
                rel = self.exists(rel, f, graph)
            else:
                rel, f = self.flagged(rel, f, graph)
                rel = Rel(rel.df.where(self.expr(f, rel.terms)), rel.terms)
        return rel

    def unit(self) -> Rel:
        return Rel(self.spark.range(1).select(F.lit(1).alias(fresh())), {})

    def without(self, rel: Rel, g: Group, graph) -> Rel:
        return matched(rel, self.group(g, graph).renamed(), False, disjoint=False)

    def exists(self, rel: Rel, f: Call, graph) -> Rel:
        """A semi or anti join; the group's own filters may use the outer variables."""
        g = f.args[0]
        inner = Group([p for p in g.parts if not (isinstance(p, tuple) and p[0] == "filter")])
        conditions = [p[1] for p in g.parts if isinstance(p, tuple) and p[0] == "filter"]

        def extra(terms):
            out = F.lit(True)
            for c in conditions:
                out = out & self.expr(c, terms)
            return out

        return matched(rel, self.group(inner, graph).renamed(), f.op == "EXISTS", extra if conditions else None)

    def flagged(self, rel: Rel, e, graph) -> tuple[Rel, object]:
        """The expression with every EXISTS in it replaced by a variable that says whether it holds."""
        if not isinstance(e, Call):
            return rel, e
        if e.op in ("EXISTS", "NOT EXISTS"):
            yes, no = (self.exists(rel, replace(e, op=op), graph) for op in ("EXISTS", "NOT EXISTS"))
            c = fresh()
            df = yes.df.withColumn(c, F.lit(e.op == "EXISTS")).union(no.df.withColumn(c, F.lit(e.op != "EXISTS")))
            return Rel(df, {**rel.terms, "." + c: Term("lit", (c,))}), Var("." + c)
        args = []
        for x in e.args:
            rel, x = self.flagged(rel, x, graph)
            args.append(x)
        return rel, replace(e, args=tuple(args))

    def union(self, rels: list[Rel]) -> Rel:
        names = list(dict.fromkeys(v for r in rels for v in r.terms))
        terms, cols = {}, {v: [] for v in names}
        for v in names:
            found = [r.terms.get(v) for r in rels]
            first = next(t for t in found if t)
            types = {tuple(r.df.schema[c].dataType.simpleString() for c in t.cols) for r, t in zip(rels, found, strict=True) if t}
            alike = all(t is None or (t.kind, t.template, t.datatype) == (first.kind, first.template, first.datatype) for t in found) and len(types) == 1
            out = tuple(fresh() for _ in (first.cols if alike else "x"))
            maybe = any(t is None or t.maybe for t in found)
            terms[v] = replace(first, cols=out, maybe=maybe) if alike else Term("enc", out, maybe=maybe)
            for r, t in zip(rels, found, strict=True):
                if alike:
                    kinds = [next(x.df.schema[c].dataType for c in y.cols if True) for x, y in zip(rels, found, strict=True) if y][:1]
                    cols[v].append([(F.col(t.cols[i]) if t else F.lit(None).cast(kinds[0])).alias(o) for i, o in enumerate(out)])
                else:
                    cols[v].append([(render(t) if t else F.lit(None).cast("string")).alias(out[0])])
        parts = [r.df.select(*(c for v in names for c in cols[v][i])) for i, r in enumerate(rels)]
        df = parts[0]
        for p in parts[1:]:
            df = df.union(p)
        return Rel(df, terms)

    def inline(self, names: list[str], rows: list[list]) -> Rel:
        cols = [fresh() for _ in names]
        data = [[None if x is None else encode(x) for x in row] for row in rows]
        df = self.spark.createDataFrame(data, T.StructType([T.StructField(c, T.StringType()) for c in cols]))
        maybe = [any(r[i] is None for r in data) for i in range(len(names))]
        return Rel(df, {n: Term("enc", (c,), maybe=m) for n, c, m in zip(names, cols, maybe, strict=True)})

    def bind(self, rel: Rel, e, name: str) -> Rel:
        if isinstance(e, Var) and e.name in rel.terms:
            return Rel(rel.df, {**rel.terms, name: rel.terms[e.name]})
        c = fresh()
        if isinstance(e, Iri):
            return Rel(rel.df.withColumn(c, F.lit(encode(e))), {**rel.terms, name: Term("enc", (c,))})
        return Rel(rel.df.withColumn(c, self.expr(e, rel.terms)), {**rel.terms, name: Term("lit", (c,), maybe=not total(e, rel.terms))})

    # -- patterns with paths
    def patterns(self, triples: list[Triple], graph) -> Rel:
        plain, rel = [], None
        for t in triples:
            for x in self.unpath(t):
                (plain.append(x) if isinstance(x, Triple) else None)
                if isinstance(x, tuple):
                    kind, s, o, inner = x
                    if kind == "union":
                        b = self.union([self.patterns(part, graph) for part in inner])
                    elif kind == "not":
                        b = self.other(s, o, inner, graph)
                    else:
                        b = self.closure(s, o, inner, graph, kind)
                    rel = b if rel is None else join(rel, b)
        if plain:
            b = self.bgp(plain, graph)
            rel = b if rel is None else join(b, rel)
        return rel or self.unit()

    def unpath(self, t: Triple) -> list:
        p = t.p
        if not isinstance(p, Path):
            return [t]
        if p.kind == "inv":
            return self.unpath(Triple(t.o, p.parts[0], t.s))
        if p.kind == "seq":
            out, s = [], t.s
            for i, x in enumerate(p.parts):
                o = t.o if i == len(p.parts) - 1 else Var(fresh("."))
                out += self.unpath(Triple(s, x, o))
                s = o
            return out
        if p.kind == "alt":
            return [("union", t.s, t.o, [[Triple(t.s, x, t.o)] for x in p.parts])]
        return [(p.kind, t.s, t.o, p.parts if p.kind == "not" else p.parts[0])]

    def other(self, s, o, left_out, graph) -> Rel:
        """Pairs joined by a predicate that is none of these."""
        p = Var(fresh("."))
        rel = self.bgp([Triple(s, p, o)], graph)
        return Rel(rel.df.where(~render(rel.terms[p.name]).isin([encode(x) for x in left_out])), {v: t for v, t in rel.terms.items() if v != p.name})

    def closure(self, s, o, path, graph, kind: str) -> Rel:
        """Pairs joined by steps of the path, from the bound end where there is one. kind: plus (one or more), star (or none), opt (one or none)."""
        from quadrille.operators.graph import reachable

        zero, most = kind != "plus", 1 if kind == "opt" else None

        a, b = Var(fresh(".")), Var(fresh("."))
        step = self.patterns([Triple(a, path, b)], graph)
        edges = step.df.select(render(step.terms[a.name]).alias("a"), render(step.terms[b.name]).alias("b")).distinct()
        if isinstance(o, (Iri, Lit)) and not isinstance(s, (Iri, Lit)):
            edges = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
            pairs = reachable(edges, [encode(o)], zero, most).select(F.col("b").alias("a"), F.col("a").alias("b"))
        else:
            pairs = reachable(edges, [encode(s)] if isinstance(s, (Iri, Lit)) else None, zero, most)
        x, y = fresh(), fresh()
        pairs = pairs.select(F.col("a").alias(x), F.col("b").alias(y))
        terms = {}
        for end, c in ((s, x), (o, y)):
            if isinstance(end, Var):
                if end.name in terms:
                    pairs = pairs.where(F.col(terms[end.name].cols[0]) == F.col(c))
                terms[end.name] = Term("enc", (c,))
            else:
                pairs = pairs.where(F.col(c) == encode(end))
        return Rel(pairs, terms)

    # -- expressions
    def text(self, e, terms) -> Column:
        """STR of an expression."""
        if isinstance(e, Var):
            return value(terms[e.name]).cast("string") if e.name in terms else F.lit(None).cast("string")
        return F.lit(e.value) if isinstance(e, (Iri, Lit)) else self.expr(e, terms).cast("string")

    def number(self, e, terms) -> Column:
        if isinstance(e, Lit):
            return F.lit(e.value).cast("int" if e.datatype == XSD + "integer" and len(e.value) < 10 else "decimal(38,6)" if e.datatype == XSD + "decimal" else "double")
        if isinstance(e, Var) and e.name in terms and terms[e.name].kind != "lit":
            return lexical(render(terms[e.name])).try_cast("double")
        return self.expr(e, terms)

    def kind(self, e, terms) -> str:
        """enc, iri, num, time, text or any: what an operand is known to be."""
        if isinstance(e, Iri):
            return "iri"
        if isinstance(e, Lit):
            return "num" if e.datatype in NUMERIC else "time" if e.datatype in (XSD + "dateTime", XSD + "date") else "text"
        if isinstance(e, Var) and e.name in terms and terms[e.name].kind != "lit":
            return terms[e.name].kind
        if isinstance(e, Call) and e.op in "+-*/":
            return "num"
        return "any"

    def expr(self, e, terms) -> Column:
        if isinstance(e, Var):
            return value(terms[e.name]) if e.name in terms else F.lit(None)
        if isinstance(e, Iri):
            return F.lit(e.value)
        if isinstance(e, Lit):
            k = self.kind(e, terms)
            if k == "num":
                return self.number(e, terms)
            if k == "time":
                return F.lit(e.value).cast("timestamp_ntz")
            return F.lit(e.value == "true") if e.datatype == XSD + "boolean" else F.lit(e.value)
        op, args = e.op, e.args
        if op in ("=", "!=", "<", "<=", ">", ">="):
            kinds = {self.kind(a, terms) for a in args}
            if "enc" in kinds and op in ("=", "!=") and not kinds & {"num", "time"}:
                x, y = (render(terms[a.name]) if isinstance(a, Var) and a.name in terms else F.lit(encode(a)) if isinstance(a, (Iri, Lit)) else self.text(a, terms) for a in args)
            elif "num" in kinds:
                x, y = (self.number(a, terms) for a in args)
            elif "time" in kinds:
                x, y = (self.text(a, terms).try_cast("timestamp_ntz") if self.kind(a, terms) == "enc" else self.expr(a, terms) for a in args)
            elif "enc" in kinds or "iri" in kinds:
                x, y = (self.text(a, terms) for a in args)
            else:
                x, y = (self.expr(a, terms) for a in args)
            return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        if op in ("&&", "||"):
            x, y = (self.expr(a, terms) for a in args)
            return x & y if op == "&&" else x | y
        if op == "!":
            return ~self.expr(args[0], terms)
        if op in ("+", "-", "*"):
            x, y = (self.number(a, terms) for a in args)
            return x + y if op == "+" else x - y if op == "-" else x * y
        if op == "/":
            return F.try_divide(self.number(args[0], terms).cast("double"), self.number(args[1], terms).cast("double"))
        if op in ("IN", "NOT IN"):
            out = F.lit(False)
            for a in args[1:]:
                out = out | self.expr(Call("=", (args[0], a)), terms)
            return ~out if op == "NOT IN" else out
        if op == "BOUND":
            t = terms.get(args[0].name)
            return F.lit(False) if t is None else F.col(t.cols[0]).isNotNull()
        if op in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL"):
            c = render(terms[args[0].name])
            return c.startswith({"B": "_:", "L": '"'}.get(op[2], "<"))
        if op in ("LANG", "DATATYPE"):
            c = render(terms[args[0].name])
            if op == "LANG":
                return F.regexp_extract(c, r'"@([A-Za-z0-9-]+)$', 1)
            found = F.regexp_extract(c, r'"\^\^<([^<>]*)>$', 1)
            return F.when(c.startswith('"'), F.when(found == "", XSD + "string").otherwise(found))
        if op == "COALESCE":
            return F.coalesce(*(self.expr(a, terms) for a in args))
        if op == "IF":
            return F.when(self.expr(args[0], terms), self.expr(args[1], terms)).otherwise(self.expr(args[2], terms))
        if op in ("DATE_DIFF", "DATEDIFF"):
            return F.datediff(*(F.to_date(self.text(a, terms)) for a in (args[1], args[0])))
        if op in ("YEAR", "MONTH", "DAY"):
            return {"YEAR": F.year, "MONTH": F.month, "DAY": F.day}[op](self.text(args[0], terms).try_cast("timestamp_ntz"))
        if op.startswith("XSD:"):
            kind = {"INTEGER": "bigint", "DECIMAL": "decimal(38,6)", "DOUBLE": "double", "FLOAT": "double", "STRING": "string", "DATETIME": "timestamp_ntz", "DATE": "date", "BOOLEAN": "boolean"}[op[4:]]
            return self.text(args[0], terms).try_cast(kind)
        if op in ("ABS", "ROUND", "CEIL", "FLOOR"):
            return {"ABS": F.abs, "ROUND": F.round, "CEIL": F.ceil, "FLOOR": F.floor}[op](self.number(args[0], terms))
        text = [self.text(a, terms) for a in args]
        if op in ("STR", "IRI", "URI"):
            return text[0]
        simple = {"LCASE": F.lower, "UCASE": F.upper, "STRLEN": F.length, "MD5": F.md5}
        if op in simple:
            return simple[op](text[0])
        if op == "SHA256":
            return F.sha2(text[0], 256)
        if op == "CONTAINS":
            return text[0].contains(text[1])
        if op == "STRSTARTS":
            return text[0].startswith(text[1])
        if op == "STRENDS":
            return text[0].endswith(text[1])
        if op == "CONCAT":
            return F.concat(*text)
        if op == "REGEX":
            return text[0].rlike(("(?i)" if len(args) > 2 and "i" in args[2].value else "") + args[1].value)
        if op == "REPLACE":
            return F.regexp_replace(text[0], args[1].value, args[2].value)
        if op == "SUBSTR":
            n = self.number(args[2], terms).cast("int") if len(args) > 2 else F.length(text[0])
            return text[0].substr(self.number(args[1], terms).cast("int"), n)
        if op == "STRBEFORE":
            return F.when(text[0].contains(text[1]), F.split_part(text[0], text[1], F.lit(1))).otherwise("")
        if op == "STRAFTER":
            return F.when(text[0].contains(text[1]), text[0].substr(F.position(text[1], text[0]) + F.length(text[1]), F.length(text[0]))).otherwise("")
        raise SparqlError(f"unknown function {op}")


def has_aggregate(e) -> bool:
    return isinstance(e, Call) and (e.op in AGGREGATES or any(has_aggregate(a) for a in e.args))


__all__ = ["Engine", "Quoted", "Rel", "Term", "encode", "fresh", "join", "lexical", "quoted", "render"]
