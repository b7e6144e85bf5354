"""SPARQL text to algebra: a tokenizer and a recursive-descent parser.

Covers SELECT, ASK and CONSTRUCT with FROM, basic graph patterns (property
lists, anonymous nodes, collections of objects, quoted triples as subjects),
paths of alternatives, inverses, sequences and + * closures, OPTIONAL, UNION,
MINUS, GRAPH, SERVICE (transparent), BIND, VALUES, FILTER with EXISTS,
sub-SELECT, grouping, HAVING, ordering and slices; and the updates INSERT DATA,
DELETE DATA, DELETE/INSERT WHERE and CLEAR.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
PREFIXES = {"rdf": RDF, "xsd": XSD, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#"}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


class SparqlError(ValueError):
    """A text that does not parse."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Lit:
    value: str
    datatype: str = XSD + "string"
    lang: str = ""


@dataclass(frozen=True)
class Path:
    """kind: alt, seq, inv, plus, star, opt or not (of predicates, forward ones)."""

    kind: str
    parts: tuple


@dataclass(frozen=True)
class Quoted:
    s: object
    p: object
    o: object


@dataclass(frozen=True)
class Triple:
    s: object
    p: object
    o: object


@dataclass(frozen=True)
class Call:
    """A function, operator or aggregate; distinct and sep are for aggregates."""

    op: str
    args: tuple
    distinct: bool = False
    sep: str = " "


@dataclass
class Group:
    """Elements in text order: Triple lists and (kind, ...) tuples."""

    parts: list = field(default_factory=list)


@dataclass
class Select:
    kind: str = "SELECT"
    vars: list = field(default_factory=list)  # names, or (expression, name); empty: all
    distinct: bool = False
    where: Group = field(default_factory=Group)
    graphs: list = field(default_factory=list)
    group: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expression, descending)
    limit: int | None = None
    offset: int = 0
    template: list = field(default_factory=list)


@dataclass
class Update:
    """kind: data, modify or clear; quads are (graph, Triple)."""

    kind: str
    delete: list = field(default_factory=list)
    insert: list = field(default_factory=list)
    where: Group | None = None
    graph: object = None


_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<var>[?$]\w+)|(?P<str>\"\"\".*?\"\"\"|'''.*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<bnode>_:\w+)|(?P<name>(?:[A-Za-z_][\w.-]*)?:(?:[\w%-](?:[\w.%-]*[\w%-])?)?|[A-Za-z_]\w*)"""
    r"""|(?P<op><<|>>|\^\^|&&|\|\||!=|<=|>=|[{}()\[\].,;=<>!+*/|^?-])""",
    re.S | re.X,
)
_DATE = re.compile(r"\d{4}-\d\d-\d\d$")
_ESC = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESC.get(m[1], m[1]), text, flags=re.S)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SparqlError(f"unexpected {text[at : at + 20]!r} at {at}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None, bare_dates: bool = True):
        self.toks, self.i = tokens(text), 0
        self.prefixes = {**PREFIXES, **(prefixes or {})}
        self.base, self.bare_dates, self.fresh = "", bare_dates, 0

    # -- tokens
    @property
    def tok(self) -> str:
        return self.toks[self.i][1]

    @property
    def kind(self) -> str:
        return self.toks[self.i][0]

    def take(self) -> str:
        self.i += 1
        return self.toks[self.i - 1][1]

    def word(self, *words: str) -> bool:
        if self.kind == "name" and self.tok.upper() in words:
            self.i += 1
            return True
        return False

    def op(self, *ops: str) -> bool:
        if self.kind == "op" and self.tok in ops:
            self.i += 1
            return True
        return False

    def need(self, x: str) -> None:
        if not (self.op(x) or self.word(x)):
            raise SparqlError(f"expected {x}, found {self.tok!r}")

    def new(self) -> Var:
        self.fresh += 1
        return Var(f".{self.fresh}")

    # -- terms
    def name(self, text: str) -> Iri:
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise SparqlError(f"unknown prefix {prefix}:")
        return Iri(self.prefixes[prefix] + local)

    def term(self):
        kind, text = self.kind, self.tok
        if kind == "var":
            return Var(self.take()[1:])
        if kind == "iri":
            self.take()
            return Iri(text[1:-1] if ":" in text else self.base + text[1:-1])
        if kind == "bnode":
            return Var("." + self.take())
        if kind == "str":
            self.take()
            value = unescape(text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1])
            if self.kind == "lang":
                return Lit(value, RDF + "langString", self.take()[1:].lower())
            if self.op("^^"):
                return Lit(value, self.term().value)
            if self.bare_dates and _DATE.match(value):  # a date by itself is midnight of that day
                return Lit(value + "T00:00:00", XSD + "dateTime")
            return Lit(value)
        if kind == "num" or kind == "op" and text in "+-" and self.toks[self.i + 1][0] == "num":
            sign = self.take() if kind == "op" else ""
            value = self.take()
            return Lit(("-" if sign == "-" else "") + value, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"))
        if kind == "name":
            if text in ("true", "false"):
                self.take()
                return Lit(text, XSD + "boolean")
            if text == "a":
                self.take()
                return Iri(RDF + "type")
            if ":" in text:
                return self.name(self.take())
        if self.op("<<"):
            s, p, o = self.term(), self.term(), self.term()
            self.need(">>")
            return Quoted(s, p, o)
        raise SparqlError(f"expected a term, found {text!r}")

    # -- paths
    def path(self):
        parts = [self.path_seq()]
        while self.op("|"):
            parts.append(self.path_seq())
        return parts[0] if len(parts) == 1 else Path("alt", tuple(parts))

    def path_seq(self):
        parts = [self.path_one()]
        while self.op("/"):
            parts.append(self.path_one())
        return parts[0] if len(parts) == 1 else Path("seq", tuple(parts))

    def path_one(self):
        if self.op("^"):
            return Path("inv", (self.path_one(),))
        if self.op("!"):
            parts = []
            if self.op("("):
                parts.append(self.term())
                while self.op("|"):
                    parts.append(self.term())
                self.need(")")
            else:
                parts.append(self.term())
            if not all(isinstance(x, Iri) for x in parts):
                raise SparqlError("only predicates can be left out of a path")
            return Path("not", tuple(parts))
        if self.op("("):
            out = self.path()
            self.need(")")
        else:
            out = self.term()
        if self.op("+"):
            return Path("plus", (out,))
        if self.op("*"):
            return Path("star", (out,))
        if self.op("?"):
            return Path("opt", (out,))
        return out

    # -- patterns
    def node(self, out: list):
        if self.op("["):
            s = self.new()
            if not self.op("]"):
                self.properties(s, out)
                self.need("]")
            return s
        return self.term()

    def properties(self, s, out: list) -> None:
        while True:
            p = self.path()
            while True:
                o = self.node(out)
                out.append(Triple(s, p, o))
                if not self.op(","):
                    break
            if not self.op(";"):
                return
            while self.op(";"):
                pass
            if self.tok in (".", "}", "]", ""):
                return

    def triples(self, out: list) -> None:
        was = self.tok
        s = self.node(out)
        if was == "[" and self.tok in (".", "}"):
            return
        self.properties(s, out)

    def group(self) -> Group:
        self.need("{")
        g = Group()
        if self.kind == "name" and self.tok.upper() == "SELECT":
            g.parts.append(("select", self.select()))
            self.need("}")
            return g
        while not self.op("}"):
            if self.op("."):
                continue
            if self.word("FILTER"):
                g.parts.append(("filter", self.primary_filter()))
            elif self.word("OPTIONAL"):
                g.parts.append(("optional", self.group()))
            elif self.word("MINUS"):
                g.parts.append(("minus", self.group()))
            elif self.word("SERVICE"):
                self.word("SILENT")
                self.term()
                g.parts.append(("group", self.group()))
            elif self.word("GRAPH"):
                g.parts.append(("graph", self.term(), self.group()))
            elif self.word("BIND"):
                self.need("(")
                e = self.expr()
                self.need("AS")
                g.parts.append(("bind", e, self.take()[1:]))
                self.need(")")
            elif self.word("VALUES"):
                g.parts.append(self.values())
            elif self.tok == "{":
                branches = [self.group()]
                while self.word("UNION"):
                    branches.append(self.group())
                g.parts.append(("union", branches) if len(branches) > 1 else ("group", branches[0]))
            else:
                ts: list = []
                self.triples(ts)
                if g.parts and isinstance(g.parts[-1], list):
                    g.parts[-1] += ts
                else:
                    g.parts.append(ts)
        return g

    def values(self):
        many = self.op("(")
        names = []
        while self.kind == "var":
            names.append(self.take()[1:])
        if many:
            self.need(")")
        self.need("{")
        rows = []
        while not self.op("}"):
            if many:
                self.need("(")
            rows.append([None if self.word("UNDEF") else self.term() for _ in names])
            if many:
                self.need(")")
        return ("values", names, rows)

    def primary_filter(self):
        if self.word("NOT"):
            self.need("EXISTS")
            return Call("NOT EXISTS", (self.group(),))
        if self.word("EXISTS"):
            return Call("EXISTS", (self.group(),))
        return self.primary()

    # -- expressions
    def expr(self):
        e = self.conj()
        while self.op("||"):
            e = Call("||", (e, self.conj()))
        return e

    def conj(self):
        e = self.rel()
        while self.op("&&"):
            e = Call("&&", (e, self.rel()))
        return e

    def rel(self):
        e = self.sum()
        for o in ("=", "!=", "<=", ">=", "<", ">"):
            if self.op(o):
                return Call(o, (e, self.sum()))
        negated = self.word("NOT")
        if self.word("IN"):
            self.need("(")
            items = []
            while not self.op(")"):
                items.append(self.expr())
                self.op(",")
            return Call("NOT IN" if negated else "IN", (e, *items))
        return e

    def sum(self):
        e = self.product()
        while self.tok in ("+", "-") and self.kind == "op":
            e = Call(self.take(), (e, self.product()))
        return e

    def product(self):
        e = self.unary()
        while self.tok in ("*", "/") and self.kind == "op":
            e = Call(self.take(), (e, self.unary()))
        return e

    def unary(self):
        if self.op("!"):
            return Call("!", (self.unary(),))
        if self.kind == "op" and self.tok == "-" and self.toks[self.i + 1][0] != "num":
            self.take()
            return Call("-", (Lit("0", XSD + "integer"), self.unary()))
        return self.primary()

    def primary(self):
        if self.op("("):
            e = self.expr()
            self.need(")")
            return e
        if self.kind == "name" and self.tok.upper() in ("NOT", "EXISTS"):
            return self.primary_filter()
        if self.kind in ("name", "iri") and self.toks[self.i + 1][1] == "(" and self.tok not in ("true", "false"):
            text = self.take()
            fn = text.upper() if ":" not in text else self.term_of(text)
            self.need("(")
            distinct = self.word("DISTINCT")
            args, sep = [], " "
            while not self.op(")"):
                if self.op(";"):
                    self.need("SEPARATOR")
                    self.need("=")
                    sep = self.term().value
                elif self.op("*"):
                    args.append("*")
                else:
                    args.append(self.expr())
                self.op(",")
            return Call(fn, tuple(args), distinct, sep)
        return self.term()

    def term_of(self, text: str) -> str:
        iri = text[1:-1] if text.startswith("<") else self.name(text).value
        return re.split(r"[#/]", iri)[-1].upper() if not iri.startswith(XSD) else "XSD:" + iri[len(XSD) :].upper()

    # -- queries
    def prologue(self) -> None:
        while True:
            if self.word("PREFIX"):
                prefix = self.take()[:-1]
                self.prefixes[prefix] = self.take()[1:-1]
            elif self.word("BASE"):
                self.base = self.take()[1:-1]
            else:
                return

    def select(self) -> Select:
        q = Select()
        if self.word("ASK"):
            q.kind = "ASK"
        elif self.word("CONSTRUCT"):
            q.kind = "CONSTRUCT"
            self.need("{")
            while not self.op("}"):
                if not self.op("."):
                    self.triples(q.template)
        else:
            self.need("SELECT")
            q.distinct = self.word("DISTINCT", "REDUCED")
            while not self.op("*"):
                if self.kind == "var":
                    q.vars.append(self.take()[1:])
                elif self.op("("):
                    e = self.expr()
                    self.need("AS")
                    q.vars.append((e, self.take()[1:]))
                    self.need(")")
                else:
                    break
        while self.word("FROM"):
            self.word("NAMED")
            q.graphs.append(self.term())
        self.word("WHERE")
        q.where = self.group()
        while self.kind != "end" and self.tok != "}":
            if self.word("GROUP"):
                self.need("BY")
                while self.kind == "var" or self.tok == "(":
                    q.group.append(self.take()[1:] if self.kind == "var" else self.keyed())
            elif self.word("HAVING"):
                q.having.append(self.primary())
            elif self.word("ORDER"):
                self.need("BY")
                while self.kind == "var" or self.tok == "(" or self.kind == "name" and (self.tok.upper() in ("ASC", "DESC") or self.toks[self.i + 1][1] == "("):
                    down = self.tok.upper() == "DESC"
                    if self.tok.upper() in ("ASC", "DESC"):
                        self.take()
                    q.order.append((self.primary(), down))
            elif self.word("LIMIT"):
                q.limit = int(self.take())
            elif self.word("OFFSET"):
                q.offset = int(self.take())
            else:
                raise SparqlError(f"unexpected {self.tok!r}")
        return q

    def keyed(self):
        self.need("(")
        e = self.expr()
        self.need("AS")
        name = self.take()[1:]
        self.need(")")
        return (e, name)

    def quads(self) -> list:
        self.need("{")
        out, graph = [], None
        while not self.op("}"):
            if self.op("."):
                continue
            if self.word("GRAPH"):
                graph = self.term()
                self.need("{")
                ts: list = []
                while not self.op("}"):
                    if not self.op("."):
                        self.triples(ts)
                out += [(graph, t) for t in ts]
            else:
                ts = []
                self.triples(ts)
                out += [(None, t) for t in ts]
        return out

    def update(self) -> Update:
        if self.word("CLEAR"):
            self.word("SILENT")
            self.word("GRAPH")
            return Update("clear", graph=self.term())
        u = Update("modify")
        if self.word("INSERT"):
            if self.word("DATA"):
                return Update("data", insert=self.quads())
            u.insert = self.quads()
        else:
            self.need("DELETE")
            if self.word("DATA"):
                return Update("data", delete=self.quads())
            if self.word("WHERE"):
                start = self.i
                u.delete = self.quads()
                self.i = start
                u.where = self.group()
                return u
            u.delete = self.quads()
            if self.word("INSERT"):
                u.insert = self.quads()
        self.need("WHERE")
        u.where = self.group()
        return u


def parse(text: str, prefixes: dict[str, str] | None = None) -> Select:
    p = Parser(text, prefixes)
    p.prologue()
    q = p.select()
    if p.kind != "end":
        raise SparqlError(f"unexpected {p.tok!r}")
    return q


def parse_updates(text: str, prefixes: dict[str, str] | None = None) -> list[Update]:
    p = Parser(text, prefixes)
    out = []
    while True:
        p.prologue()
        if p.kind == "end":
            return out
        out.append(p.update())
        if not p.op(";") and p.kind != "end":
            raise SparqlError(f"unexpected {p.tok!r}")
