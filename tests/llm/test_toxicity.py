"""The pattern grammar against its parts run one after another, the lexicon against a loop, and held-out labels."""

import math
import random

import pytest
from pyspark.sql import functions as F

from logwarden.llm import toxicity as T

DOCS = "doc_id long, text string, features string, toxic string, h int"


def run_part(part, clause):
    """One transducer by itself: symbols written and weights of the arcs."""
    state, out = 0, []
    for symbol in clause:
        state, written, weight = part.arcs[state][symbol]
        out.append((written, weight))
    return out


def one_by_one(clause):
    symbols, weights = [s for s, _ in clause], [1.0] * len(clause)
    for make in T.PARTS:
        out = run_part(make(), symbols)
        symbols, weights = [s for s, _ in out], [w * v for w, (_, v) in zip(weights, out, strict=True)]
    return sum(T.written_score(s, w, x) for s, w, (_, x) in zip(symbols, weights, clause, strict=True))


def test_composition():
    rng, rules = random.Random(2), T.grammar()
    for _ in range(500):
        clause = [(rng.choice(T.READ), rng.random()) for _ in range(rng.randrange(25))]
        assert math.isclose(T.clause_score(rules, clause), one_by_one(clause), abs_tol=1e-12)


def classes(text, insults=None):
    return T.Lexicon(insults or {"idiot$": 4.0})(T.TOKEN.findall(text.lower()))


@pytest.mark.parametrize("text, score", [
    ("an idiot", 4.0), ("you idiot", 6.0), ("idiot you", 4.5), ("not an idiot", 1.0), ("he said an idiot", 4.0 * 1.5 * 0.5),
    ("“idiot” there", 2.0), ("i will kill you", 4.0), ("kill you", 2.0), ("i will not kill you", 0.0), ("kill time", 0.0),
    ("never call you an idiot", 1.5), ("idiots", 0.0), ("no words here", 0.0)])
def test_clauses(text, score):
    assert math.isclose(T.clause_score(T.grammar(), classes(text)), score)


def test_lexicon():
    entries = {"bad": 1.0, "badly$": 3.0, "badger": 0.5, "x$": 2.0}
    lexicon = T.Lexicon(entries)
    for word in ("bad", "bade", "badly", "badlyx", "badger", "badgers", "x", "xy", "ba", "nicht", "kill", "é"):
        fits = [e for e in entries if (word + "$").startswith(e)]
        kinds = [k for k, words in T.WORDS.items() if word in words]
        expected = (kinds[0], 1.0) if kinds else (T.INSULT, entries[max(fits, key=len)]) if fits else (T.OTHER, 0.0)
        assert lexicon.read(word) == expected


def test_clause_search():
    """Clauses left out have no score."""
    rng, rules = random.Random(4), T.grammar()
    words = "idiot you not said will kill a b . ; \" never them".split()
    for _ in range(300):
        found = classes(" ".join(rng.choice(words) for _ in range(rng.randrange(60))))
        plain, clause = 0.0, []
        for kind, weight in [*found, (T.END, 0.0)]:
            if kind == T.END:
                plain, clause = plain + max(one_by_one(clause), 0), []
            else:
                clause.append((kind, weight))
        assert math.isclose(sum(T.clause_score(rules, c) for c in T.clauses_of(found)), plain, abs_tol=1e-9)


def brute_score(text, model):
    lexicon, whole = T.Lexicon(model.insults), T.TOKEN.findall((text or "").lower())
    scores, clause = [0.0], []
    for token in [*whole, "."]:
        kind = lexicon.read(token)
        if kind[0] == T.END:
            scores.append(max(one_by_one(clause), 0.0))
            clause = []
        else:
            clause.append(kind)
    total = sum(scores)
    x = [1, math.log1p(total), math.log1p(max(scores)), math.log1p(1000 * total / (len(whole) + 50))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.coefficients, x, strict=True))))


def test_rows(spark):
    data = [(1, "You idiot! I will kill you."), (2, None), (3, ""), (3, ""), (None, "scum; trash"), (4, "fine " * 50_000 + "you moron"),
            (5, "\x00 \U0001F600 é"), (6, "He said: not an idiot.")]
    docs = spark.createDataFrame([(i, t, "f", "t", 1) for i, t in data], DOCS).repartition(3)
    model = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.coefficients == T.UNTAUGHT
    got = sorted(((r.doc_id, round(r.score, 9), r.predicted) for r in T.score(docs, model).collect()), key=str)
    want = [(i, round(brute_score(t, model), 9), int(brute_score(t, model) >= 0.3)) for i, t in data]
    assert got == sorted(want, key=str)
    assert T.score(docs.limit(0), model).count() == 0


def test_learning(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(30)]
        if i % 3 == 0:
            words[rng.randrange(30)] = f"grumpf{rng.choice(['en', 'a', 'osity'])}"
        rows.append((i, " ".join(words), "f", "t", 1))
        labels.append((i, int(i % 3 == 0)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.fit(docs, marks)
    assert any(e.startswith("grumpf") for e in model.insults)
    got = {r.doc_id: r.predicted for r in T.score(docs, model).collect()}
    assert got == dict(labels)
    new = spark.createDataFrame([(1, "a grumpfosity alpha beta", "f", "t", 1), (2, "alpha beta gamma", "f", "t", 1)], DOCS)
    assert {r.doc_id: r.predicted for r in T.score(new, model).collect()} == {1: 1, 2: 0}


def test_held_out(spark):
    from logwarden.llm import catalog

    sf = "/root/testdata/sf0.1"
    rows = catalog.op11_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = rows.groupBy("toxic", "predicted").count().collect()
    counts = {(r.toxic, r.predicted): r["count"] for r in n}
    caught, missed, wrong = counts.get((1, 1), 0), counts.get((1, 0), 0), counts.get((0, 1), 0)
    assert caught >= 0.9 * (caught + missed) and wrong <= 0.1 * (caught + wrong), counts
    assert rows.filter(F.col("score").isNull() | ~F.col("score").between(0, 1)).count() == 0
