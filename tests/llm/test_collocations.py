import collections
import random
import re

import duckdb
import pytest

from llm import plain
from viewtide.llm import collocations as C, queries

SF = "/root/testdata/sf0.001"


def mine(rows, least, top=2000, longest=4):
    """The definition in plain Python."""
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang] += len(w)
            counts[lang].update(tuple(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        f = {p: n for p, n in f.items() if n >= least}
        rows = []
        for p, a in f.items():
            if len(p) < 2:
                continue
            if any(len(q) > len(p) and 100 * n >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, n in f.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -score)
                for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top], start=1)]
    return sorted(out)


def table(spark, rows):
    rows = [(i, text, lang, "s", 0) for i, (lang, text) in enumerate(rows)]
    from pyspark.sql import functions as F
    return spark.createDataFrame(rows, plain.DOCS).withColumns({c: F.lit("x") for c in ("phrase", "ids", "starts", "f", "rank")})


ODD = [(None, None), ("en", None), (None, "A b a b a b"), ("en", ""), ("en", " \t ..,,"), ("en", "É é É é\x1cx É é"), ("und", "a b a b"),
       ("en", "one. two three, two three\rtwo three"), ("en", "a a a a a a a a")]


@pytest.mark.parametrize("block, words", [(C.BLOCK, C.WORDS), (7, 5)])
def test_against_definition(spark, monkeypatch, block, words):
    rng = random.Random(block)
    rows = ODD + [(rng.choice(["en", "de", None]), "".join(rng.choice(["The ", "of ", "x", "y ", "\t", ". ", "é ", "end\n"]) for _ in range(60)))
                  for _ in range(60)]
    rows += rows[:5]
    whole = C.occurrences
    monkeypatch.setattr(C, "occurrences", lambda docs, longest: whole(docs, longest, block, words))
    for least, top in ((2, 2000), (4, 5)):
        got = sorted(tuple(r) for r in C.collocations(table(spark, rows), least=least, top=top).collect())
        assert got == mine(rows, least, top)
    assert len(got) > 10


def test_very_long_text_is_one_piece(spark):
    text = "p q r s " * 300_000
    got = C.collocations(table(spark, [("en", text), ("en", "p q. r s")])).collect()
    assert [tuple(r) for r in got] == mine([("en", text), ("en", "p q. r s")], 30)


def test_longer_words_than_a_slice():
    text = b"a" * 3000 + b" b\tc." + b"d" * 2500
    assert [w for part in C.piece_words(text, 100) for w in part] == [b"a" * 3000, b"b", b"c", C.CUT, b"d" * 2500]


def test_empty_table(spark):
    got = C.collocations(plain.documents(spark, []))
    assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_bitmap_is_bounded_and_lets_frequent_through(spark):
    rows = [("en", f"w{i} w{i + 1}") for i in range(3000)] * 2
    words = C.occurrences(table(spark, rows))
    bits = C.bitmap(C.counted(words, 1), 1 << 16)
    assert len(bits) * 8 == 1 << 16
    assert C.phrases(C.semi_joined(words, 1, bits), 1).count() == 3001


def test_full_bitmap_changes_nothing(spark):
    rows = [("en", "a b c. x y. a b")] * 30 + [("en", "q r s"), ("de", "a b")]
    assert sorted(tuple(r) for r in C.collocations(table(spark, rows), most_bits=8).collect()) == mine(rows, 30)


def test_large_counts_are_exact(spark):
    big = 10**17 + 7
    tables = [spark.createDataFrame(r, "lang string, phrase string, f bigint") for r in (
        [("en", "a", big + 5), ("en", "b", big + 1)], [("en", "a b", big)], [("en", "a b c", 1)])]
    assert C.scored(tables).first().score == 2000000 * big // (2 * big + 6)


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.SQL["op11_phrase_collocations"])
    got = queries.op11_phrase_collocations(spark, SF)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
