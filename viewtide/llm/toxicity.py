"""Toxicity by a weighted finite-state pattern grammar.

A lexicon maps each word to a class (insult, threat, target, copula, negation, reporting verb, quotation mark, break, other) with
a weight. Three letter-to-letter transducers over classes are composed into one: negation (an insult in its scope is
negated), reported speech (inside quotation marks or after a reporting verb it is reported), and the target grammar (an insult after
a target, or followed by one, is direct; a threat against a target is a threat). The composed machine runs over sentences
that hold an insult or a threat; what it puts out are matched clauses, and their weights, not those of words, are scored.

Learned from labels: the weights of words (log odds of their document frequencies, summed by Spark), further words of the insult
class (at least ``LEAST`` toxic documents, and log odds clearly above 0), and a logistic regression on a document's clauses
(Newton steps on sums that tasks give). When a labelled document is described for the regression, it does not count for its own
words. Learning takes at most ``FIT_ROWS`` labelled ids, those of the smallest hash; counts over them are whole. At most
``LEXICON`` learned words are kept; they are the model and all that is collected.

Edge cases: null and empty texts have no clause and get the score of that; a null doc_id is neither held out nor learned from;
labels that are null are left out, of different labels of one id the higher counts; without labels the fixed weights are used;
repeated rows count as often as they occur; very long texts are read whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from viewtide.llm import common

FIT_ROWS, LEXICON, LEAST = 40_000, 20_000, 3
#: Smallest lower limit (1.64 standard errors) of a learned word's log odds.
CLEAR = 0.7
SEED_WEIGHT, STEPS, RIDGE = 3.0, 12, 1.0

# Words of the grammar's classes in English, German, French and Spanish.
INSULTS = """idiot idiots moron morons stupid scum trash loser losers pathetic worthless clown clowns disgusting dumb imbecile
dumm dummkopf abschaum trottel versager stupide crétin ordure minable estúpido imbécil escoria basura""".split()
THREATS = "kill hurt destroy beat burn stab shoot töten umbringen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = """you your yourself he she they him her them these those people du dich dir ihr euch sie tu toi vous lui eux tú usted
ustedes ellos""".split()
COPULAS = "are is am was were be being bist ist seid sind es est êtes sont eres son".split()
NEGATIONS = "not no never neither nobody isn aren nicht kein keine nie niemals ne pas jamais nunca ningún tampoco".split()
REPORTS = """said says saying wrote writes called calls quoted claimed reported sagte schrieb nannte behauptete dit écrit appelé
dijo escribió llamó""".split()

INSULT, THREAT, TARGET, COPULA, NEGATION, REPORT, QUOTE, BREAK, OTHER = range(9)
NEGATED, REPORTED, DIRECT, MENACE = range(9, 13)
#: What a clause can be, in the order of the features.
KINDS = (INSULT, DIRECT, MENACE, NEGATED, REPORTED)
FIXED = {w: c for c, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (COPULA, COPULAS), (TARGET, TARGETS), (THREAT, THREATS))
         for w in words}

SCOPE = 3        # words a negation or a target reaches
SPEECH = 8       # words a reporting verb reaches


class Transducer:
    """Sequential letter-to-letter transducer: (state, input) to (output, weight, next state); what has no arc passes unchanged."""

    def __init__(self, arcs: dict, start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (symbol, 0.0, state)

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: the output of this one is the input of the other; weights add."""
        start = (self.start, other.start)
        arcs, todo, seen = {}, [start], {start}
        while todo:
            a, b = state = todo.pop()
            for symbol in range(13):
                middle, w, a_next = self.step(a, symbol)
                out, v, b_next = other.step(b, middle)
                after = (a_next, b_next)
                arcs[state, symbol] = out, w + v, after
                if after not in seen:
                    seen.add(after)
                    todo.append(after)
        return Transducer(arcs, start)

    def run(self, symbols: list[int]) -> list[tuple[int, float]]:
        state, out = self.start, []
        for symbol in symbols:
            put, weight, state = self.step(state, symbol)
            out.append((put, weight))
        return out


def negation() -> Transducer:
    """State: words left in the scope of a negation; a second negation undoes the first."""
    arcs = {(0, NEGATION): (NEGATION, 0.0, SCOPE)}
    for left in range(1, SCOPE + 1):
        for symbol in range(13):
            arcs[left, symbol] = symbol, 0.0, left - 1
        arcs[left, INSULT] = NEGATED, -4.0, left - 1
        arcs[left, THREAT] = NEGATED, -4.0, left - 1
        arcs[left, COPULA] = COPULA, 0.0, left
        arcs[left, NEGATION] = NEGATION, 0.0, 0
        arcs[left, BREAK] = BREAK, 0.0, 0
    return Transducer(arcs)


def reported_speech() -> Transducer:
    """State: -1 inside quotation marks, else words left in the reach of a reporting verb."""
    arcs = {(0, REPORT): (REPORT, 0.0, SPEECH), (-1, QUOTE): (QUOTE, 0.0, 0)}
    for left in range(SPEECH + 1):
        arcs[left, QUOTE] = QUOTE, 0.0, -1
        if left:
            for symbol in range(13):
                arcs.setdefault((left, symbol), (symbol, 0.0, left - 1))
    for state in (-1, *range(1, SPEECH + 1)):
        after = -1 if state < 0 else state - 1
        for symbol in (INSULT, THREAT):
            arcs[state, symbol] = REPORTED, -2.0, after
    return Transducer(arcs)


def target_grammar() -> Transducer:
    """State: what an insult or a threat may still meet (target, insult or threat before it) and for how many words."""
    start = (OTHER, 0)
    states = [start, *[(what, left) for what in (TARGET, INSULT, THREAT) for left in range(1, SCOPE + 1)]]
    arcs = {}
    for state in states:
        what, left = state
        nearer = (what, left - 1) if left > 1 else start
        for symbol in range(13):
            arcs[state, symbol] = symbol, 0.0, nearer
        arcs[state, BREAK] = BREAK, 0.0, start
        arcs[state, COPULA] = COPULA, 0.0, state
        completes = {INSULT: (DIRECT, 0.5), THREAT: (MENACE, SEED_WEIGHT)}.get(what, (TARGET, 0.0))
        arcs[state, TARGET] = *completes, (TARGET, SCOPE)
        arcs[state, INSULT] = (DIRECT, 0.5, (INSULT, SCOPE)) if what == TARGET else (INSULT, 0.0, (INSULT, SCOPE))
        arcs[state, THREAT] = (MENACE, 0.5, (THREAT, SCOPE)) if what == TARGET else (OTHER, 0.0, (THREAT, SCOPE))
    return Transducer(arcs, start)


def grammar() -> Transducer:
    return negation() @ reported_speech() @ target_grammar()


QUOTES = re.compile("[“”„«»]")
#: Ends of sentences, breaks inside them, quotation marks; other ASCII that is no letter, digit or apostrophe is a blank.
FOLD = bytearray(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
for _marks, _to in ((b".!?;\n\r|", 0xFF), (b",:()", 0xFE), (b'"', 0xFD)):
    for _b in _marks:
        FOLD[_b] = _to
FOLD = bytes(FOLD)
END, PAUSE, MARK = b"\xff", b"\xfe", b"\xfd"


def sentences(text: str, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words, ``END``, ``PAUSE`` and ``MARK`` of a text in lists from about ``size`` characters, each cut at a blank."""
    at = 0
    while at < len(text):
        upto = at + size
        while upto < len(text) and not text[upto].isspace():
            upto += 1
        part = QUOTES.sub('"', text[at:upto]).lower().encode().translate(FOLD)
        yield part.replace(END, b" \xff ").replace(PAUSE, b" \xfe ").replace(MARK, b" \xfd ").split()
        at = upto


@dataclass
class Lexicon:
    """Document frequencies of the words that can match, in toxic and clean labelled documents."""

    toxic: int = 0
    clean: int = 0
    words: dict[bytes, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self):
        self.classes = {w.encode(): c for w, c in FIXED.items()} | {PAUSE: BREAK, MARK: QUOTE}
        self.classes |= {w: INSULT for w in self.words if w not in self.classes} | {w.encode(): INSULT for w in INSULTS}
        self.matching = {w for w, c in self.classes.items() if c in (INSULT, THREAT)}

    def weight(self, word: bytes, own: int | None) -> float:
        """Log odds of a word; ``own`` is the label of the document described, which does not count."""
        n1, n0 = self.words.get(word, (0, 0))
        if own is not None and (n1 or n0):
            n1, n0 = n1 - (own == 1), n0 - (own == 0)
        if word in SEEDS and n1 + n0 < 5:
            return SEED_WEIGHT
        return odds(n1, n0, self.toxic, self.clean)[0] if n1 >= LEAST or word in SEEDS else 0.0


SEEDS = frozenset(w.encode() for w in (*INSULTS, *THREATS))


def odds(n1: int, n0: int, toxic: int, clean: int) -> tuple[float, float]:
    """Log odds of a word and their standard error."""
    value = math.log((n1 + 0.5) / (toxic + 1)) - math.log((n0 + 0.5) / (clean + 1))
    return value, math.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))


FEATURES = 5 + len(KINDS)


def clauses(text: str, lexicon: Lexicon, machine: Transducer, own: int | None = None) -> tuple[list[tuple[int, float]], int]:
    """(kind, weight) of every matched clause, and the number of words."""
    found, words, sentence = [], 0, []

    def close() -> None:
        nonlocal words
        words += len(sentence)
        if not matching.isdisjoint(sentence):
            out = machine.run([classes.get(w, OTHER) for w in sentence])
            best, weight = None, 0.0
            for word, (kind, arc) in zip(sentence, out):
                if kind in KINDS:
                    mine = max(arc + lexicon.weight(word, own), 0.0) if kind not in (NEGATED, REPORTED) else 0.0
                    if kind in (DIRECT, MENACE) and word not in matching:      # the target that completes a clause
                        mine = arc
                    weight += mine
                    if best is None or KINDS.index(kind) in (1, 2) or best in (NEGATED, REPORTED):
                        best = kind
            if best is not None:
                found.append((best, weight))
        sentence.clear()

    classes, matching = lexicon.classes, lexicon.matching
    for part in sentences(text):
        at = 0
        while True:
            try:
                end = part.index(END, at)
            except ValueError:
                sentence.extend(part[at:])
                break
            sentence.extend(part[at:end])
            close()
            at = end + 1
    close()
    return found, words


def described(text: str | None, lexicon: Lexicon, machine: Transducer, own: int | None = None) -> list[float]:
    """Features of a document: 1, strongest clause, all clauses, their density, clauses that match at all, number of each kind."""
    found, words = clauses(text or "", lexicon, machine, own)
    weights = [w for _, w in found]
    total = sum(weights)
    counts = Counter(k for k, w in found if w > 0 or k in (NEGATED, REPORTED))
    return [1.0, max(weights, default=0.0), math.log1p(total), total / math.sqrt(words + 20.0), float(any(w > 1 for w in weights)),
            *[math.log1p(counts[k]) for k in KINDS]]


def document_words(text: str) -> set[bytes]:
    found = set()
    for part in sentences(text):
        found.update(part)
    return found - {END, PAUSE, MARK}


def frequencies(train: DataFrame) -> DataFrame:
    """word, n1, n0: toxic and clean documents that hold it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[toxic].update(document_words(text.as_py()))
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield from rows(counts)
                counts = Counter(), Counter()
        yield from rows(counts)

    def rows(counts) -> Iterator[pa.RecordBatch]:
        words = list(counts[0].keys() | counts[1].keys())
        for at in range(0, len(words), 100_000):
            some = words[at:at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, type=pa.binary()).cast(pa.string()), pa.array([counts[1][w] for w in some], type=pa.int64()),
                 pa.array([counts[0][w] for w in some], type=pa.int64())], names=["word", "n1", "n0"])

    return (train.select("text", "toxic").mapInArrow(run, "word string, n1 bigint, n0 bigint")
            .groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))


def learned_lexicon(train: DataFrame, most: int = LEXICON, least: int = LEAST) -> Lexicon:
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    value = F.log((F.col("n1") + 0.5) / (toxic + 1)) - F.log((F.col("n0") + 0.5) / (clean + 1))
    error = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    clear = (F.col("n1") >= least) & (value - 1.64 * error >= CLEAR)
    fixed = F.col("word").isin(*INSULTS, *THREATS)
    rows = (frequencies(train).where(clear | fixed).orderBy((~fixed).cast("int"), (value - 1.64 * error).desc(), "word").limit(most))
    return Lexicon(toxic, clean, {r["word"].encode(): (r["n1"], r["n0"]) for r in rows.collect()})


def features(train: DataFrame, lexicon: Lexicon) -> DataFrame:
    machine = grammar()

    def run(batch):
        labels = batch["toxic"].to_pylist()
        return {"x": [described(t.as_py(), lexicon, machine, y) for t, y in zip(batch["text"], labels)], "toxic": labels}

    return common.arrow_map(train.select("text", "toxic"), run, "x array<double>, toxic int")


#: Coefficients without labels: as for one clear clause.
FALLBACK = np.array([-2.0, 0.8, 0.5, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0])


def fitted(rows: DataFrame, steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """Logistic regression by Newton steps; each step takes one small sum from every task."""
    beta = np.zeros(FEATURES)
    for _ in range(steps):
        def run(batches: Iterator[pa.RecordBatch], beta=beta) -> Iterator[pa.RecordBatch]:
            total = np.zeros((FEATURES, FEATURES + 1))
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy().reshape(-1, FEATURES)
                    y = batch.column(1).to_numpy()
                    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
                    total[:, 0] += x.T @ (y - p)
                    total[:, 1:] += (x * (p * (1 - p))[:, None]).T @ x
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["sums"])

        sums = rows.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
        total = np.zeros(FEATURES * (FEATURES + 1))
        for r in sums.collect():
            total[r["i"]] = r["v"]
        total = total.reshape(FEATURES, FEATURES + 1)
        penalty = np.full(FEATURES, ridge)
        penalty[0] = 1e-3
        move = np.linalg.solve(total[:, 1:] + np.diag(penalty), total[:, 0] - penalty * beta)
        beta = beta + np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-4:
            break
    return beta


@dataclass
class Model:
    lexicon: Lexicon
    beta: np.ndarray


def labelled(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """text and toxic of the documents to learn from: at most ``most`` labelled ids, which the join sends to all tasks."""
    known = (common.pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out()))
    some = common.stage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labelled")
    rows = common.pick(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    return rows.join(F.broadcast(some), "doc_id").select("text", F.when(F.col("toxic") >= 1, 1).otherwise(0).alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    spark = docs.sparkSession
    train, train_at = common.staged_at(labelled(docs, labels, most), "training-texts")
    lexicon = learned_lexicon(train)
    if not lexicon.toxic or not lexicon.clean:
        return Model(Lexicon(), FALLBACK)
    rows, rows_at = common.staged_at(features(train, lexicon), "training-features")
    beta = fitted(rows)
    common.discard(spark, train_at)
    common.discard(spark, rows_at)
    return Model(lexicon, beta)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the number of matched clauses, of every document."""
    machine, beta, lexicon = grammar(), model.beta, model.lexicon
    rows = common.pick(docs, "doc_id", "text").withColumn("held_out", held_out())

    def run(batch):
        x = np.array([described(t.as_py(), lexicon, machine) for t in batch["text"]]).reshape(-1, FEATURES)
        score = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": score, "predicted": (score >= 0.5).astype(np.int32)}

    kind = rows.schema["doc_id"].dataType.simpleString()
    return common.arrow_map(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learned from the labels of those not held out."""
    return scored(docs, learn(docs, labels, most))
