"""Toxicity by a weighted finite-state pattern grammar over clauses.

1. A lexical automaton, a trie over characters, reads a word and gives its class and weight: insult, violence, menace,
   target, negation, report, quote, clause end or other. Insults are learned from labelled texts: the beginnings of words
   and whole words that toxic texts have far more often than clean ones, weighted by their log odds. Small fixed lists
   give the closed classes of four languages, and insults that stand for themselves until texts say otherwise.
2. Four transducers rewrite the classes of a clause, each with a weight on its arcs: ``negation`` denies what follows
   within its scope, ``reporting`` lowers what a clause only quotes, ``threatening`` turns menace, violence and target into
   a threat, ``aiming`` raises what is aimed at somebody. They are composed into one deterministic transducer; weights of
   a token multiply, those of a clause add up.
3. Only clauses with a match count: their sum, their greatest and their density in the text go into a logistic
   regression. The lexicon behind its training rows comes from the other half of the labelled texts.

Learning takes at most ``PER_LABEL`` texts of each label, those of least hash; repeated texts count once.

Defined results: null and empty texts have no clause and the score of a text without match; every whole text is read;
without usable labels the fixed lists and fixed coefficients decide; repeated rows are scored each; a text with both labels
counts as toxic; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.columns import only
from logwarden.session import write_and_read

PER_LABEL = 4_000
PREFIX = (3, 12)  # characters of a learned beginning of a word
END_MARK = "$"
MIN_TEXTS, MIN_SHARE = 4, 0.015  # toxic texts behind a learned entry, and their share of all toxic texts
MIN_ODDS = 2.0
MOST_ENTRIES = 20_000
SEED_WEIGHT = 2.0
THREAT_WEIGHT = 4.0
THRESHOLD = 0.3
CACHE_WORDS = 300_000
#: Coefficients without labels: intercept, then those of ``features``.
UNTAUGHT = (-3.0, 1.5, 0.5, 0.3)
SCORED = "doc_id long, score double, predicted int"

OTHER, INSULT, VIOLENCE, MENACE, TARGET, NEGATION, REPORT, QUOTE, END, DENIED, THREAT, AIMED = range(12)
READ = range(END + 1)  # what the lexical automaton gives; the rest the transducers write

# Words of the closed classes and plain insults, in English, German, French and Spanish.
INSULTS = ("idiot moron loser stupid trash scum pathetic worthless disgusting clown imbecile dumbass bastard jerk "
           "trottel dummkopf arschloch vollidiot abschaum connard abruti crétin salaud ordure idiota imbécil estúpido basura cabrón").split()
WORDS = {
    VIOLENCE: "kill hurt stab shoot strangle destroy murder töten umbringen verletzen erschießen tuer frapper égorger matar golpear apuñalar".split(),
    MENACE: "will gonna going shall werde werden vais allons voy vamos".split(),
    TARGET: "you your yours they them he she him her dich dir euch vous toi votre usted ustedes vosotros".split(),
    NEGATION: "not never isn aren wasn don doesn didn nicht nie niemals kein keine jamais aucun nunca jamás ningún".split(),
    REPORT: "said says wrote called calls claimed claims quoted quote alleged sagte schrieb nannte behauptete disait écrivait dijo escribió".split(),
}
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n\"“”„«»]")
QUOTES, ENDS = "\"“”„«»", ".!?;:\n"


# -- transducers --------------------------------------------------------------

@dataclass
class Transducer:
    """Deterministic: ``arcs[state][symbol]`` is (next state, symbol written, weight). State 0 is the start."""

    arcs: list[dict[int, tuple[int, int, float]]]

    def then(self, other: "Transducer") -> "Transducer":
        """The composition: ``other`` reads what this one writes."""
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], []
        for a, b in todo:
            here = {}
            for symbol, (next_a, written, w) in self.arcs[a].items():
                next_b, out, v = other.arcs[b][written]
                state = (next_a, next_b)
                if state not in number:
                    number[state] = len(todo)
                    todo.append(state)
                here[symbol] = (number[state], out, w * v)
            arcs.append(here)
        return Transducer(arcs)


def machine(n_states: int, rule) -> Transducer:
    """Arcs from ``rule(state, symbol)``; a clause end leads to the start."""
    every = range(AIMED + 1)
    return Transducer([{s: (0, END, 1.0) if s == END else rule(state, s) for s in every} for state in range(n_states)])


def negation(scope: int = 4, weight: float = 0.25) -> Transducer:
    """The state counts the words that a negation still reaches."""
    def rule(left: int, s: int) -> tuple[int, int, float]:
        if s == NEGATION:
            return scope, s, 1.0
        after = max(left - 1, 0)
        if left and s == INSULT:
            return after, DENIED, weight
        return (after, OTHER, 1.0) if left and s in (VIOLENCE, MENACE) else (after, s, 1.0)
    return machine(scope + 1, rule)


def reporting(weight: float = 0.5) -> Transducer:
    """1: behind a word of saying, to the end of the clause; 2: within quotation marks."""
    def rule(state: int, s: int) -> tuple[int, int, float]:
        if s == REPORT:
            return max(state, 1), s, 1.0
        if s == QUOTE:
            return {0: 2, 1: 1, 2: 0}[state], s, 1.0
        return state, s, weight if state and s in (INSULT, DENIED, VIOLENCE) else 1.0
    return machine(3, rule)


def threatening(reach: int = 4) -> Transducer:
    """Menace and then violence within ``reach`` words and then a target within ``reach``, or violence and a target side by
    side, is a threat. States: 0, words left after menace (1..), after menaced violence, after violence alone (last)."""
    alone = 2 * reach + 1

    def rule(state: int, s: int) -> tuple[int, int, float]:
        menaced, violent = 1 <= state <= reach, reach < state <= 2 * reach
        if s == VIOLENCE:
            return (2 * reach if menaced else state if violent else alone), OTHER, 1.0
        if s == TARGET and violent:
            return 0, THREAT, 1.0
        if s == TARGET and state == alone:
            return 0, THREAT, 0.5
        if s == MENACE and not violent:
            return reach, s, 1.0
        return (state - 1 if state not in (0, reach + 1, alone) else 0), s, 1.0
    return machine(2 * reach + 2, rule)


def aiming(raised: float = 1.5, bonus: float = 0.5) -> Transducer:
    """0: nothing yet, 1: a target, 2: an insult without target, 3: both."""
    def rule(state: int, s: int) -> tuple[int, int, float]:
        if s == TARGET:
            return {0: 1, 1: 1, 2: 3, 3: 3}[state], AIMED if state == 2 else s, bonus if state == 2 else 1.0
        if s in (INSULT, DENIED):
            return {0: 2, 1: 3, 2: 2, 3: 3}[state], s, raised if state in (1, 3) else 1.0
        return state, s, 1.0
    return machine(4, rule)


PARTS = (negation, reporting, threatening, aiming)


def grammar() -> Transducer:
    whole = PARTS[0]()
    for part in PARTS[1:]:
        whole = whole.then(part())
    return whole


def written_score(symbol: int, weight: float, lexical: float) -> float:
    """What one token adds to its clause."""
    if symbol in (INSULT, DENIED):
        return weight * lexical
    return weight * THREAT_WEIGHT if symbol == THREAT else weight if symbol == AIMED else 0.0


def clause_score(rules: Transducer, clause: Iterable[tuple[int, float]]) -> float:
    """The weight of a clause's path: tokens as (class, weight)."""
    state, total = 0, 0.0
    for symbol, lexical in clause:
        state, out, weight = rules.arcs[state][symbol]
        if out in (INSULT, DENIED, THREAT, AIMED):
            total += written_score(out, weight, lexical)
    return total


# -- the lexicon --------------------------------------------------------------

@dataclass
class Lexicon:
    """A trie over characters. ``insults`` maps beginnings of words, or whole words ended by ``$``, to weights; the longest
    entry that fits decides. Words of the other classes are whole."""

    insults: dict[str, float]
    arcs: dict = field(default_factory=dict)
    known: dict[str, tuple[int, float]] = field(default_factory=dict)

    def __post_init__(self):
        for kind, words in WORDS.items():
            for word in words:
                self.accept(word + END_MARK, (kind, 1.0))
        for entry, weight in self.insults.items():
            self.accept(entry, (INSULT, weight))

    def accept(self, entry: str, meaning: tuple[int, float]) -> None:
        node = self.arcs
        for c in entry:
            node = node.setdefault(c, {})
        node["="] = meaning  # no letter

    def read(self, token: str) -> tuple[int, float]:
        if token in QUOTES:
            return QUOTE, 0.0
        if token in ENDS:
            return END, 0.0
        node, found = self.arcs, (OTHER, 0.0)
        for c in token + END_MARK:
            node = node.get(c)
            if node is None:
                break
            found = node.get("=", found)
        return found

    def __call__(self, tokens: list[str]) -> list[tuple[int, float]]:
        known = self.known
        for token in set(tokens).difference(known):
            if len(known) >= CACHE_WORDS:
                known.clear()
            known[token] = self.read(token)
        return [known.get(t) or self.read(t) for t in tokens]


def clauses_of(classes: list[tuple[int, float]]) -> Iterator[list[tuple[int, float]]]:
    """The clauses that hold an insult or violence; the others have no match."""
    ends = [i for i, (kind, _) in enumerate(classes) if kind == END]
    hits = [i for i, (kind, _) in enumerate(classes) if kind in (INSULT, VIOLENCE)]
    k, done = 0, -1
    for hit in hits:
        if hit <= done:
            continue
        while k < len(ends) and ends[k] < hit:
            k += 1
        first = ends[k - 1] + 1 if k else 0
        done = ends[k] if k < len(ends) else len(classes)
        yield classes[first:done]


def features(text: str | None, lexicon: Lexicon, rules: Transducer) -> tuple[float, float, float]:
    """log(1 + x) of the sum of the clauses' scores, of the greatest, and of the sum per 1000 tokens."""
    classes = lexicon(TOKEN.findall((text or "").lower()))
    scores = [s for s in (clause_score(rules, c) for c in clauses_of(classes)) if s > 0]
    total = sum(scores)
    return tuple(np.log1p([total, max(scores, default=0.0), 1000 * total / (len(classes) + 50)]).tolist())


# -- learning -----------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    insults: dict[str, float]
    coefficients: tuple[float, ...]


def sampled(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """(h, text, toxic): distinct labelled texts, ``per_label`` of each label at most, those of least hash."""
    texts = only(docs, doc_id="long", text="string").filter("doc_id IS NOT NULL AND text <> ''")
    known = only(labels, doc_id="long", toxic="int").filter("toxic IN (0, 1)")
    ranked = texts.select("doc_id", F.xxhash64("text").alias("h")).join(known, "doc_id").groupBy("h").agg(
        F.max("toxic").alias("toxic"))
    parts = [ranked.filter(F.col("toxic") == y).orderBy("h").limit(per_label) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = texts.select("text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), "h")  # 2 * per_label rows
    return write_and_read(rows.groupBy("h").agg(F.any_value("text").alias("text"), F.any_value("toxic").alias("toxic")), "labelled")


def beginnings() -> Column:
    """The distinct beginnings of a text's words, and its whole words with ``$``."""
    low, high = PREFIX
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)")))
    cut = lambda w: F.transform(F.sequence(F.lit(low), F.least(F.length(w), F.lit(high))), lambda k: F.substring(w, F.lit(1), k))
    some = F.filter(words, lambda w: F.length(w) >= low)
    return F.array_distinct(F.concat(F.flatten(F.transform(some, cut)), F.transform(some, lambda w: F.concat(w, F.lit(END_MARK)))))


def log_odds(toxic, clean, n_toxic: int, n_clean: int):
    return np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))


def insults_of(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weighted entries from (entry, toxic texts, clean texts).

    An entry gives way to a longer one that keeps nearly all its toxic texts. Plain insults stay unless texts have them and
    speak against them.
    """
    seen = {e: (a, b) for e, a, b in counts}
    longer: dict[str, int] = {}
    for e, (a, _) in seen.items():
        parent = e[:-1]
        longer[parent] = max(longer.get(parent, 0), a)
    found = {w + END_MARK: SEED_WEIGHT for w in INSULTS if w + END_MARK not in seen}
    for e, (a, b) in seen.items():
        odds = float(log_odds(a, b, n_toxic, n_clean))
        if a >= max(MIN_TEXTS, MIN_SHARE * n_toxic) and odds >= MIN_ODDS and (e.endswith(END_MARK) or longer.get(e, 0) < 0.95 * a):
            found[e] = odds
    return found


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Newton's method; the intercept comes first and is not shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    shrink = ridge * np.diag([0.0, *np.ones(x.shape[1] - 1)])
    c = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        bend = weights * p * (1 - p) + 1e-9
        step = np.linalg.solve((x * bend[:, None]).T @ x + shrink, x.T @ (weights * (y - p)) - shrink @ c)
        c += step
        if np.abs(step).max() < 1e-8:
            break
    return c


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Lexicon and coefficients from the labelled texts of ``docs``; ``labels`` has doc_id and toxic (0 or 1)."""
    rows = sampled(docs, labels, per_label).withColumn("half", F.pmod("h", F.lit(2)).cast("int"))
    sizes = {(r.half, r.toxic): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    of = lambda y: sum(n for (_, t), n in sizes.items() if t == y)
    if not of(0) or not of(1):
        return Model(insults_of([], 0, 0), UNTAUGHT)
    count = lambda half, y: F.count_if((F.col("half") == half) & (F.col("toxic") == y)).alias(f"n{half}{y}")
    counts = rows.select("half", "toxic", F.explode(beginnings()).alias("entry")).groupBy("entry").agg(
        *(count(half, y) for half in (0, 1) for y in (0, 1))).withColumns({"a": F.expr("n01 + n11"), "b": F.expr("n00 + n10")})
    odds = F.log((F.col("a") + 0.5) / (of(1) + 1)) - F.log((F.col("b") + 0.5) / (of(0) + 1))
    seeds = [w + END_MARK for w in INSULTS]
    kept = counts.filter(((F.col("a") >= MIN_TEXTS) & (odds >= MIN_ODDS / 2)) | F.col("entry").isin(seeds)) \
        .orderBy(F.desc(F.col("entry").isin(seeds)), F.desc(F.col("a") * odds), "entry").limit(MOST_ENTRIES).collect()
    lexicons = {half: insults_of([(r.entry, r[f"n{half}1"], r[f"n{half}0"]) for r in kept],
                                 sizes.get((half, 1), 0), sizes.get((half, 0), 0)) for half in (0, 1)}
    taught = [(r.toxic, r.features) for half in (0, 1)
              for r in with_features(rows.filter(F.col("half") == half).select("toxic", "text"), lexicons[1 - half],
                                     "toxic int").collect()]
    y = np.array([t for t, _ in taught], float)
    shares = known_shares(docs, labels)
    weights = np.where(y == 1, shares[1] / of(1), shares[0] / of(0)) * len(y)
    c = logistic(np.array([f for _, f in taught]), y, weights)
    return Model(insults_of([(r.entry, r.a, r.b) for r in kept], of(1), of(0)), tuple(c.tolist()))


def known_shares(docs: DataFrame, labels: DataFrame) -> tuple[float, float]:
    """The shares of both labels among all labelled rows of ``docs``."""
    ids = only(docs, doc_id="long")
    n = {r.toxic: r["count"] for r in only(labels, doc_id="long", toxic="int").filter("toxic IN (0, 1)").join(
        ids, "doc_id", "left_semi").groupBy("toxic").count().collect()}
    return tuple(n.get(y, 0) / max(1, sum(n.values())) for y in (0, 1))


# -- scoring ------------------------------------------------------------------

def with_features(rows: DataFrame, insults: dict[str, float], kept: str) -> DataFrame:
    """The first column of ``rows``, of type ``kept``, and the features of its text."""
    name = kept.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, rules = Lexicon(insults), grammar()
        for batch in batches:
            found = [features(t.as_py(), lexicon, rules) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column(name), pa.array(found, pa.list_(pa.float64()))], names=[name, "features"])

    return rows.select(name, "text").mapInArrow(run, f"{kept}, features array<double>")


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``SCORED`` for every document row."""
    found = with_features(only(docs, doc_id="long", text="string"), model.insults, "doc_id long")
    first, *rest = (F.lit(float(c)) for c in model.coefficients)
    logit = first + sum((c * F.col("features")[k] for k, c in enumerate(rest)), F.lit(0.0))
    value = 1 / (1 + F.exp(-logit))
    return found.select("doc_id", value.alias("score"), (value >= threshold).cast("int").alias("predicted"))
