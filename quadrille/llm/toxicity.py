"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers are composed. `insult` reads the learned lexicon and says how
strong a mention is: after an intensifier, in "piece of", in a run of insults.
`threat` reads patterns of several words: somebody means to do harm, or somebody
is told that they will come to it. `negation` and `report` mark the mentions in
their scope, and `target` guesses at the start of a clause that somebody is
addressed or meant, in any place, and lets only those paths end that found one;
a threat is worth nothing on any other path. The composition is lazy: an arc is
made when a clause first needs it. Weights add up along a path, and the score of
a clause is its best path.

The lexicon is a weighted trie: words, and beginnings of 5 to 8 letters, that
labelled toxic documents have significantly more often, with near copies counted
once; the longest that fits a word gives its weight. How much a mention counts
that is intensified, repeated, negated, reported or aimed at somebody is learned
too, from a prior that holds where labels say nothing. A document's probability
is a logistic function of its best clause, all its clauses together and how many
different terms it has. At most `most_rows` labelled documents are used, in the
order of a hash of their id, which also bounds the terms that the driver holds.

Rows: null and empty texts have the score of a text without any match; texts
are read whole; labels that are null, repeated rows of labels beyond the first
and labels without a document are not learned from; a document that is toxic in
one row of labels and not in another is toxic; without labels of both kinds
nothing is learned and every score is 0; equal texts have equal scores. doc_id,
lang, source and labels are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.kernels import released
from quadrille.plans.lineage import cut

# The closed word classes of the grammar.
CLASSES = {
    "target": "you your yourself u he him his she her they them their these those everyone anybody du dich dir ihr euch eure dein deine er ihn tu te toi vous votre vos il elle eux ils elles tú ti usted ustedes él ella ellos ellas",
    "negation": "not never no isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't cannot hardly neither nicht kein keine keinen nie niemals pas jamais aucun nunca jamás tampoco",
    "but": "but aber sondern mais pero sino",
    "report": "said says say saying called calls wrote writes claimed claims quoted quotes reported reports alleged tweeted sagte sagt schrieb schreibt behauptete nannte dit disait écrit appelé dijo dice escribió llamó",
    "intense": "such so very really total totally utter utterly complete completely absolute absolutely fucking bloody damn solche solcher so sehr total völlig absolut verdammte verdammter tel telle si très vraiment totalement sacré tan muy realmente totalmente maldito maldita",
    "article": "a an the ein eine einen un une le la el una",
    "piece": "piece pieces bunch pack load sack stück haufen bande tas bande montón pedazo",
    "of": "of von de",
    "be": "be get being wirst werden être ser",
    "meaning": "will gonna going shall should must want i'll we'll gotta deserve deserves werde werden wird sollte sollten muss will würde vais va vont allons dois doit devrait mérite mérites voy va van vamos debe debes deberías mereces merece",
    "harm": "kill hurt destroy burn beat shoot stab murder strangle punch hang töten umbringen schlagen erschießen abstechen verprügeln erwürgen verbrennen tuer frapper buter poignarder étrangler brûler matar golpear apuñalar estrangular quemar",
    "fate": "die suffer bleed rot sterben verrecken krepieren leiden crever mourir souffrir morir sufrir",
    "killed": "killed hurt destroyed burned beaten shot stabbed murdered strangled punched hanged getötet umgebracht geschlagen erschossen abgestochen tué tuée frappé frappée poignardé matado golpeado apuñalado",
}
#: Patterns of threats, as classes in order; a number lets so many other words pass.
THREATS = (("meaning", 3, "harm"), ("target", 0, "meaning", 1, "fate"), ("target", 0, "meaning", 1, "be", 0, "killed"))
#: How much a mention counts before labels say otherwise.
PRIOR = {"intense": 1.3, "run": 1.2, "negated": 0.3, "reported": 0.5, "target": 1.25}
MARKS = tuple(PRIOR)

INSULT, THREAT, OTHER = "insult", "threat", "other"
_CLAUSE = re.compile(r"[^.!?;\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
BEGINNINGS = (5, 6, 7, 8)
ARCS = 20_000  # that a worker keeps; they are made again when needed


def classes() -> dict[str, tuple[str, ...]]:
    """The closed classes of each word; a word may have several."""
    out: dict[str, tuple[str, ...]] = {}
    for kind, words in CLASSES.items():
        for w in words.split():
            out[w] = (*out.get(w, ()), kind) if kind not in out.get(w, ()) else out[w]
    return out


# A symbol is (kinds, marks): what a word may be, and what holds of a mention.
Symbol = tuple[frozenset, frozenset]


class Transducer:
    """Arcs are given by a function of state and symbol: the next states with the symbol written. Starts in any of `starts`; ends in a state that `ends` accepts."""

    def __init__(self, arcs, starts=(0,), ends=lambda state: True):
        self.arcs, self.starts, self.ends = arcs, starts, ends

    def then(self, other: Transducer) -> Transducer:
        """Composition: what this one writes, the other reads."""

        def arcs(state, symbol):
            return [((a, b), out) for a, middle in self.arcs(state[0], symbol) for b, out in other.arcs(state[1], middle)]

        return Transducer(arcs, [(a, b) for a in self.starts for b in other.starts], lambda s: self.ends(s[0]) and other.ends(s[1]))


def _marked(symbol: Symbol, mark: str) -> Symbol:
    return (symbol[0], symbol[1] | {mark}) if symbol[0] & {INSULT, THREAT} else symbol


def insult() -> Transducer:
    """States: 0, after an intensifier or "piece of", after "piece", after an insult."""

    def arcs(state, symbol):
        kinds = symbol[0]
        if INSULT in kinds:
            out = _marked(symbol, "intense") if state == "intense" else _marked(symbol, "run") if state == "run" else symbol
            return [("run", out)]
        if "intense" in kinds or state == "piece" and "of" in kinds or state == "intense" and "article" in kinds:
            return [("intense", symbol)]
        return [("piece" if "piece" in kinds else 0, symbol)]

    return Transducer(arcs)


def threat(patterns=THREATS) -> Transducer:
    """States: 0, or (pattern, elements read, words that may still pass). Where a pattern may go on or end, both paths are kept."""

    def arcs(state, symbol):
        kinds, out = symbol[0], [(0, symbol)]
        if state == 0:
            return out + [((p, 1, pattern[1]), symbol) for p, pattern in enumerate(patterns) if pattern[0] in kinds]
        p, read, left = state
        if patterns[p][2 * read] in kinds:
            last = 2 * read + 1 == len(patterns[p])
            out.append((0, (kinds | {THREAT}, symbol[1])) if last else ((p, read + 1, patterns[p][2 * read + 1]), symbol))
        if left:
            out.append(((p, read, left - 1), symbol))
        return out

    return Transducer(arcs)


def negation(scope: int = 3) -> Transducer:
    """Reaches `scope` words, or to a "but"."""

    def arcs(state, symbol):
        if "negation" in symbol[0]:
            return [(scope, symbol)]
        if "but" in symbol[0]:
            return [(0, symbol)]
        return [(max(0, state - 1), _marked(symbol, "negated") if state else symbol)]

    return Transducer(arcs)


def report() -> Transducer:
    """Reaches to the end of the clause."""
    return Transducer(lambda state, symbol: [(1 if state or "report" in symbol[0] else 0, _marked(symbol, "reported") if state else symbol)])


def target() -> Transducer:
    """Guesses whether somebody is meant ("awaited") or not ("none"); "awaited" ends well only as "found"."""

    def arcs(state, symbol):
        if state == "none":
            return [(state, (symbol[0] - {THREAT}, symbol[1]) if THREAT in symbol[0] else symbol)]
        return [("found" if "target" in symbol[0] else state, _marked(symbol, "target"))]

    return Transducer(arcs, ("none", "awaited"), lambda state: state != "awaited")


def grammar() -> Transducer:
    return insult().then(threat()).then(negation()).then(report()).then(target())


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)  # learned words; a beginning ends with *
    weights: tuple[float, ...] = ()
    threat: float = 1.0
    marks: dict[str, float] = field(default_factory=lambda: dict(PRIOR))


class Scorer:
    """The grammar with a lexicon; features() of one text."""

    def __init__(self, model: Model):
        self.model, self.machine, self.made = model, grammar(), {}
        self.kinds = {w: frozenset(k) for w, k in classes().items()}
        self.other = frozenset({OTHER})
        self.whole = {t: w for t, w in model.terms.items() if not t.endswith("*")}
        self.begun = {t[:-1]: w for t, w in model.terms.items() if t.endswith("*")}
        self.lengths = sorted({len(t) for t in self.begun}, reverse=True)
        self.find = ahocorasick.Automaton()
        for t in {*self.whole, *self.begun, *(w for k in ("harm", "fate", "killed") for w in CLASSES[k].split())}:
            self.find.add_word(t, len(t))
        self.find.make_automaton()

    def classed(self, word: str) -> tuple[frozenset, str, float]:
        """What a word may be, the term it fits, and the term's weight."""
        word = word.replace("’", "'")
        kinds = self.kinds.get(word, self.other)
        weight, term = self.whole.get(word), word
        if weight is None:
            for n in self.lengths:
                if len(word) > n and word[:n] in self.begun:
                    weight, term = self.begun[word[:n]], word[:n]
                    break
        return (kinds, word, 0.0) if weight is None else (kinds | {INSULT}, term, weight)

    def value(self, out: Symbol, weight: float) -> float:
        total = (weight if INSULT in out[0] else 0.0) + (self.model.threat if THREAT in out[0] else 0.0)
        for m in out[1]:
            total *= self.model.marks[m]
        return total

    def path(self, words: list[tuple[frozenset, str, float]]) -> tuple[float, list[Symbol]]:
        """The best path's weight and what it writes; of equal paths the first found."""
        best = dict.fromkeys(self.machine.starts, (0.0, None))
        for kinds, _, weight in words:
            after: dict = {}
            for state, (total, back) in best.items():
                arcs = self.made.get((state, kinds))
                if arcs is None:
                    if len(self.made) > ARCS:
                        self.made.clear()
                    arcs = self.made[state, kinds] = self.machine.arcs(state, (kinds, frozenset()))
                for new, out in arcs:
                    score = total + self.value(out, weight) if out[0] & {INSULT, THREAT} else total
                    if new not in after or score > after[new][0]:
                        after[new] = (score, (back, out))
            best = after
        total, back = max((v for s, v in best.items() if self.machine.ends(s)), key=lambda v: v[0])
        out = []
        while back:
            back, symbol = back
            out.append(symbol)
        return total, out[::-1]

    def clause(self, text: str, seen: set[str], tally: dict | None = None) -> float:
        words = [self.classed(w) for w in _WORD.findall(text)]
        every = frozenset().union(*(w[0] for w in words))
        if INSULT not in every and not any(all(k in every for k in pattern[::2]) for pattern in THREATS):
            return 0.0  # nothing here can be a mention
        total, out = self.path(words)
        for (_, term, weight), symbol in zip(words, out, strict=True):
            if symbol[0] & {INSULT, THREAT}:
                if not symbol[1] & {"negated", "reported"}:  # weakened mentions are not told apart
                    seen.add(term)
                if tally is not None:
                    for m in symbol[1]:
                        tally[m] = tally.get(m, 0.0) + self.value(symbol, weight) / self.model.marks[m]
        return total

    def features(self, text: str | None, tally: dict | None = None) -> tuple[float, float, float]:
        """Best clause, log of all clauses together, log of the number of different terms; tally: gets the weight of mentions by mark."""
        if not text or not self.model.weights and not self.model.terms:
            return 0.0, 0.0, 0.0
        text = text.lower()
        best = total = 0.0
        seen: set[str] = set()
        done = -1
        for end, n in self.find.iter(text):
            start = end - n + 1
            if start < done or start and text[start - 1].isalpha():
                continue
            low = max(max(text.rfind(c, max(done, 0), start) for c in ".!?;\n") + 1, done, 0)
            m = _CLAUSE.match(text, low)
            if m and m.end() > start:
                score = self.clause(m[0], seen, tally)
                best, total, done = max(best, score), total + score, m.end()
        return best, math.log1p(total), math.log1p(len(seen))

    def score(self, text: str | None) -> float:
        return probability(self.model.weights, self.features(text))


def probability(weights: tuple[float, ...], x: tuple[float, ...]) -> float:
    if not weights:
        return 0.0
    z = weights[0] + sum(w * v for w, v in zip(weights[1:], x, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30, least: float = 0.0) -> tuple[float, ...]:
    """Weights by Newton steps, the constant first; those of features are kept at `least` or more."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    free = np.ones(len(w), bool)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        w = w - step
        free[1:] &= w[1:] >= least
        w[1:] = np.maximum(w[1:], least)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _terms(rows: DataFrame, level: float) -> dict[str, float]:
    """Words and beginnings that mark toxic rows, with their log odds. level: how many false ones are expected."""

    def pairs(h: Column, by: int) -> Column:
        n = F.greatest(F.size(h) - by, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + by), n), lambda x, y: F.xxhash64(x, y))

    # One key for near copies: the least hash of three or four words in a row.
    parsed = rows.select("_toxic", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("all"))
    hashed = parsed.select("_toxic", "all", F.transform("all", lambda x: F.xxhash64(x)).alias("h"))
    chained = hashed.select("_toxic", "all", pairs(F.col("h"), 1).alias("h")).select("_toxic", "all", pairs(F.col("h"), 2).alias("h"))
    distinct = F.array_distinct(F.filter("all", lambda x: F.length(x) > 2))
    worded = chained.select("_toxic", F.coalesce(F.array_min("h"), F.hash("all").cast("long")).alias("key"), distinct.alias("w"))

    def begun(n: int) -> Column:
        return F.transform(F.filter("w", lambda x: F.length(x) > n), lambda x: F.concat(F.substring(x, 1, n), F.lit("*")))

    # Each document brings its key under an empty term too: the totals.
    every = F.array_distinct(F.concat(F.array(F.lit("")), "w", *map(begun, BEGINNINGS)))
    each = worded.select("_toxic", "key", F.explode(every).alias("term")).groupBy("term", "key").agg(F.max("_toxic").alias("_toxic"))
    tally = cut(each.groupBy("term").agg(F.sum("_toxic").alias("pos"), F.count("*").alias("n")).where("pos > 0"), "terms")
    base, tested = tally.where("term = ''").select("pos", "n").first(), tally.where("term <> ''").count()
    if base is None or base.pos == base.n:
        return {}
    rate = base.pos / base.n
    q = F.least(F.col("pos") / F.col("n"), F.lit(1 - 1e-9))
    # Evidence against the base rate, in nats, by the divergence of the two rates; e**-evidence bounds the chance of so much.
    evidence = F.col("n") * (q * F.log(q / rate) + (1 - q) * F.log((1 - q) / (1 - rate)))
    odds = F.log((F.col("pos") + 0.5) / (F.col("n") - F.col("pos") + 0.5)) - math.log(rate / (1 - rate))
    found = tally.where("term <> ''").where(q > max(rate, 0.5)).withColumn("odds", odds).where(evidence > math.log(max(tested, 1) / level))
    return {r.term: float(r.odds) for r in found.select("term", "odds").collect()}  # fewer than most_rows have words


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, level: float = 0.01) -> Model:
    """Learn from (doc_id, toxic) rows of labels; which of them to use is for the caller to say."""
    chosen = (
        labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # at most most_rows pairs of numbers
    terms = _terms(rows, level)
    if not terms:
        return Model()
    model = Model(terms, (), max(terms.values()))  # a threat is as bad as the worst insult
    sample = featured(rows.select("doc_id", "text", "_toxic"), model, "_toxic int", tally=True).collect()  # at most most_rows
    y = np.array([r["_toxic"] for r in sample], float)
    # What each mark changes, beside all mentions together, and how much labels say of it.
    x = np.array([[r["total"], *r["marked"]] for r in sample], float).reshape(-1, 1 + len(MARKS))
    slope = logistic(x[:, :1], y)
    for i, mark in enumerate(MARKS):
        model.marks[mark] = _mark(x[:, 0], x[:, 1 + i], y, slope, PRIOR[mark])
    sample = featured(rows.select("doc_id", "text", "_toxic"), model, "_toxic int").select("best", "total", "distinct", "_toxic").collect()  # at most most_rows
    x = np.array([r[:3] for r in sample], float).reshape(-1, 3)
    model.weights = logistic(x, np.array([r[3] for r in sample], float))
    return model


def _mark(total: np.ndarray, own: np.ndarray, y: np.ndarray, slope: tuple[float, ...], prior: float, steps: int = 41) -> float:
    """The factor from 0 to 2 that best explains the labels, with a normal prior of deviation 0.5; total: log of all mentions, own: weight of those with the mark, before its factor."""
    rest = np.expm1(total) - prior * own
    best = (-np.inf, prior)
    for factor in [prior, *np.linspace(0, 2, steps).tolist()]:
        z = np.clip(slope[0] + slope[1] * np.log1p(np.maximum(rest + factor * own, 0)), -30, 30)
        fit = float(np.sum(y * z - np.log1p(np.exp(z)))) - ((factor - prior) / 0.5) ** 2 / 2
        best = max(best, (fit, factor), key=lambda v: v[0])
    return best[1]


def featured(docs: DataFrame, model: Model, keep: str = "", tally: bool = False) -> DataFrame:
    """doc_id, best, total, distinct and score of every text, a column to keep, and (tally) the weight of mentions by mark."""
    name = keep.split()[0] if keep else None

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            marks = [{} for _ in range(batch.num_rows)]
            x = [scorer.features(t, m if tally else None) for t, m in zip(batch.column("text").to_pylist(), marks, strict=True)]
            out = {"doc_id": batch.column("doc_id")} | {c: pa.array([r[i] for r in x], pa.float64()) for i, c in enumerate(("best", "total", "distinct"))}
            out["score"] = pa.array([probability(model.weights, r) for r in x], pa.float64())
            if name:
                out[name] = batch.column(name)
            if tally:
                out["marked"] = pa.array([[m.get(k, 0.0) for k in MARKS] for m in marks], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict(out)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([name] if name else [])]
    schema = "doc_id long, best double, total double, distinct double, score double" + (f", {keep}" if keep else "") + (", marked array<double>" if tally else "")
    return docs.select(*columns).mapInArrow(released(run), schema)


def held_out(doc_id: str) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not found toxic, unchanged."""
    model = learn(docs, labels.where(~held_out("doc_id")))
    columns = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            keep = pa.array([scorer.score(t) < 0.5 for t in batch.column("text").to_pylist()], pa.bool_())
            yield batch.filter(keep)

    return docs.select(*columns).mapInArrow(released(run), fields)
