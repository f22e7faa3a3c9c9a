import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import plain
from viewtide.llm import common, toxicity as T

SF = "/root/testdata/sf0.01"


def kinds(text, lexicon=None):
    return [k for k, _ in T.clauses(text, lexicon or T.Lexicon(), T.grammar())[0]]


@pytest.mark.parametrize("text, kind", [
    ("You are such an idiot.", T.DIRECT), ("Idiot, I said", T.INSULT), ("that moron of a word", T.INSULT), ("Idiot you", T.DIRECT),
    ("He is not an idiot.", T.NEGATED), ("she said he was an idiot", T.REPORTED), ('the word "idiot" is old', T.REPORTED),
    ("I will kill you!", T.MENACE), ("you we will hurt", T.MENACE), ("Du bist ein Dummkopf", T.DIRECT),
    ("« idiot »", T.REPORTED), ("“idiot”", T.REPORTED), ("not he, the idiot", T.INSULT)])
def test_clauses(text, kind):
    assert kinds(text) == [kind]


def test_a_threat_needs_a_target():
    assert kinds("they kill time") == [T.MENACE] and kinds("to kill time") == []


def test_sentences_bound_clauses():
    assert kinds("You. Idiot. not\nidiot") == [T.INSULT, T.INSULT]
    assert kinds("nothing here, at all") == [] == kinds("")


def test_double_negation_and_scope():
    assert kinds("never not an idiot") == [T.INSULT]
    assert kinds("not a b c d idiot") == [T.INSULT]


def test_composition_equals_one_after_the_other():
    machines = T.negation(), T.reported_speech(), T.target_grammar()
    whole, rng = T.grammar(), random.Random(3)
    words = [list(x) for x in itertools.product(range(9), repeat=3)] + [[rng.randrange(9) for _ in range(40)] for _ in range(200)]
    for symbols in words:
        weights, out = [0.0] * len(symbols), symbols
        for m in machines:
            step = m.run(out)
            out, weights = [k for k, _ in step], [a + w for a, (_, w) in zip(weights, step)]
        assert whole.run(symbols) == list(zip(out, weights))


def test_a_document_does_not_count_for_its_own_words():
    lexicon = T.Lexicon(10, 100, {b"zork": (3, 0)})
    assert kinds("zork", lexicon) == [T.INSULT]
    assert lexicon.weight(b"zork", None) > 2 and lexicon.weight(b"zork", 1) == 0


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").withColumns({c: F.lit("x") for c in ("text", "score", "held_out")})


def test_learns_words_and_leaves_the_rest_alone(spark):
    rng = random.Random(1)
    fill = lambda: " ".join(rng.choices([f"w{i}" for i in range(50)], k=12))
    docs = [(i, f"{fill()} {'you grundel' if i % 4 == 0 else fill()}.") for i in range(400)]
    found = T.toxicity(plain.documents(spark, docs), labels(spark, [(i, 1, int(i % 4 == 0)) for i in range(0, 400)])).collect()
    assert len(found) == 400 and any(r.held_out for r in found)
    assert all(r.predicted == int(r.doc_id % 4 == 0) == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in found)


def test_learning_reads_no_held_out_label(spark):
    docs = [(i, f"word{i % 7} idiot" if i % 3 == 0 else f"word{i % 7}") for i in range(60)]
    frame = plain.documents(spark, docs)
    true = [(i, 1, int(i % 3 == 0)) for i in range(60)]
    out = {r.doc_id for r in frame.where(T.held_out()).collect()}
    turned = [(i, q, 1 - t if i in out else t) for i, q, t in true]
    assert sorted(T.toxicity(frame, labels(spark, true)).collect()) == sorted(T.toxicity(frame, labels(spark, turned)).collect())


def test_held_out_accuracy(spark):
    docs, known = (common.load(spark, SF, t) for t in ("documents", "labels"))
    rows = T.toxicity(docs, known).where("held_out").join(known, "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.93 * len(rows)
    toxic = [r for r in rows if r.predicted]
    assert toxic and sum(r.toxic for r in toxic) >= 0.9 * len(toxic)


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "idiot"), (3, "idiot"), (None, "you idiot"), (4, "you idiot " * 200_000), (5, "x" * 3_000_000)]
    for known in ([], [(1, 0, None)], [(3, 1, 1)], [(3, 1, 1), (3, 1, 0), (None, 1, 1)]):
        found = T.toxicity(plain.documents(spark, docs), labels(spark, known))
        rows = found.collect()
        assert found.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == len(docs)
        by = {r.doc_id: r for r in rows}
        assert by[1].score == by[2].score == by[5].score < 0.5 and not by[None].held_out and by[4].predicted == 1
    assert T.toxicity(plain.documents(spark, []), labels(spark, [])).count() == 0


def test_regression_by_sums(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(300), rng.normal(size=(300, T.FEATURES - 1))])
    y = (x @ np.linspace(-1, 1, T.FEATURES) + rng.logistic(size=300) > 0).astype(int)
    beta = T.fitted(spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, toxic int"))
    p = 1 / (1 + np.exp(-x @ beta))
    penalty = np.full(T.FEATURES, T.RIDGE)
    penalty[0] = 1e-3
    assert np.abs(x.T @ (y - p) - penalty * beta).max() < 1e-2
