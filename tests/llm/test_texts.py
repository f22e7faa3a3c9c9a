import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import plain
from viewtide.llm import decontaminate, language_id, minhash, packing, pii, quality, queries, secret_scan, substring_dedup

SF = "/root/testdata/sf0.001"
LONG = "word " * 60_000


@pytest.fixture(scope="module")
def sample(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def empty(spark):
    return plain.documents(spark, [])


# --- quality rules

def test_quality_counts(spark, sample):
    odd = [(10**6 + i, t) for i, t in enumerate(
        [None, "", " \n\t", "a b c d e a b c d e", "x x x x x x x x x x x", "é x é\x1cx", "l1\nl1\n \n \nl1 ", LONG])]
    rows = sample + odd + odd[:2]
    got = quality.quality(plain.documents(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        n, chars, symbols, dup, repeated = plain.quality_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated)
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n) and not (r.kept and r.base_failed)


def test_quality_keeps_clean_and_drops_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality(docs).join(labels, "doc_id").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept"), F.avg((~F.col("kept") & ~F.col("base_failed")).cast("int")).alias("more"))
    rates = {r.quality: r for r in found.collect()}
    assert rates[0].kept < 0.05 and rates[1].more < 0.01


def test_sketches_merge(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(30)), rng.choice(["en", None]), rng.choice(["a", "b"]), 0)
            for i in range(300)]
    docs = quality.measured(spark.createDataFrame(rows, plain.DOCS), "lang", "source")
    whole = quality.merged(quality.sketches(docs))
    one = quality.sketches(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")})).select("measure", "bucket", "n")
    assert sorted(whole.select("measure", "bucket", "n").collect()) == sorted(one.collect())
    limits = quality.fences(whole, [], 2.0).first()
    lengths = sorted(r.word_chars / r.n_words for r in docs.where(~quality.base_failed()).collect())
    quarter = lambda q: lengths[int(len(lengths) * q)]
    width = 2 * (quarter(.75) - quarter(.25))
    assert limits.word_length_high == pytest.approx(quarter(.5) + width, rel=0.04)


COUNTS = "lang string, source string, " + quality.SCHEMA


def habits(source, length, usual, junk, n=600, every=10):
    """Counts of documents of 10,000 words and 1,000 lines: ``usual`` to twice as many of everything, or ``junk``."""
    rng = random.Random(usual)
    rows = []
    for i in range(n):
        some = [junk] * 5 if i % every == 0 else [rng.randint(usual, 2 * usual) for _ in range(5)]
        symbols, dup, repeated, capitals, exclamations = some
        rows.append(("en", source, 10_000, int(10_000 * length * rng.uniform(0.98, 1.02)), symbols, dup // 10, repeated, 1000,
                     capitals, exclamations))
    return rows


def test_groups_of_different_habits_have_different_fences(spark):
    rows = habits("a", 4.0, 20, 1000) + habits("b", 8.0, 100, 1900) + habits("few", 4.0, 20, 1000, n=40)
    got = {r.source: r for r in quality.thresholds(spark.createDataFrame(rows, COUNTS)).collect()}
    assert (got["a"].level, got["b"].level, got["few"].level) == ("source", "source", "lang")
    for m, size in quality.RATES.items():
        a, b = got["a"][f"{m}_high"], got["b"][f"{m}_high"]
        assert 0.004 < a < 0.03 and 0.02 < b < 0.19 and b > 3 * a, m      # above the usual, below the junk of each
    assert got["a"].word_length_high < got["b"].word_length_low


def test_rates_without_a_valley_have_no_fence(spark):
    rng = random.Random(1)
    rows = [("en", "s", 1000, 5000, *[int(rng.paretovariate(0.9)) - 1 if rng.random() < 0.3 else 0 for _ in range(2)],
             0, 1000, 0, 0) for _ in range(3000)]
    got = quality.thresholds(spark.createDataFrame(rows, COUNTS)).first()
    assert [got[f"{m}_high"] for m in quality.RATES] == [None] * 5


def test_fences_against_plain_counting(spark):
    """The lowest stretch of factor 8 above three quarters of the values that holds ten times fewer than lie beyond."""
    rows = habits("a", 4.0, 20, 1000) + habits("a", 5.0, 1, 400, every=25)
    got = quality.thresholds(spark.createDataFrame(rows, COUNTS)).first()
    values = sorted(r[4] / r[2] for r in rows)
    inside = lambda low, high: sum(low < v <= high for v in values)
    lows = [v for v in values if inside(-1, v) >= 0.75 * len(values)
            and inside(v * 8, 2) >= quality.DEEP * (inside(v, 8 * v) + 1)]
    assert got.symbols_per_word_high == pytest.approx(lows[0] * 8 ** 0.5, rel=0.05)


def test_quality_empty_and_nulls(spark):
    assert quality.quality(empty(spark)).collect() == []
    rows = spark.createDataFrame([(None, None, None, None, None)] * 2, plain.DOCS)
    assert [r.kept for r in quality.quality(rows).collect()] == [False, False]
    assert quality.kept_documents(rows).collect() == []


def test_kept_documents(spark, sample):
    docs = plain.documents(spark, sample)
    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    out = quality.kept_documents(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept


# --- language

def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and 0.2 < len(held) / len(got) < 0.3
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_language_edges(spark):
    rows = [(0, "the cat and the dog", "en", "s", 1), (1, "der hund und die katze", "de", "s", 1), (2, None, "en", "s", 1),
            (3, "123 !?", "en", "s", 1), (4, "", None, "s", 1), (None, "le chien", "fr", "s", 1), (5, "𝒜𝒷", None, "s", 1)]
    rows += [(0, "the cat and the dog", "en", "s", 1), (7, LONG, None, None, None)]
    got = language_id.identify(spark.createDataFrame(rows, plain.DOCS).withColumn("lang_pred", F.lit(1))).collect()
    assert len(got) == len(rows)
    pred = {(r.doc_id): r.lang_pred for r in got}
    assert pred[2] == pred[3] == pred[4] == "und" and pred[5] != "und" and pred[None] in ("en", "de")
    assert language_id.identify(empty(spark)).collect() == []
    nothing = language_id.identify(spark.createDataFrame([(1, "text", None, None, None)], plain.DOCS)).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)


def test_out_of_place_distance():
    """Against the definition with plain counting."""
    from collections import Counter
    text = "abba  ab-c"
    padded = [" ab", "abb", "bba", "ba ", " ab", "ab ", " c "]
    two = [x[k:k + 2] for x in (" abba ", " ab ", " c ") for k in range(len(x) - 1)]
    want = Counter([c for c in text if c.isalpha()] + two + padded)
    found, n = np.unique(language_id.grams(language_id.codes(text)), return_counts=True)

    def spell(g):
        chars = []
        while g:
            c = g & (2**21 - 1)
            chars.append(" " if c == 1 else chr(c))
            g >>= 21
        return "".join(reversed(chars))

    assert {spell(int(g)): int(k) for g, k in zip(found, n)} == dict(want)


# --- spans

ODD_SECRETS = [None, "", 'secret=token": abcdefgh é token: "ééabcdef" password = abc user=bob https://x.example.com/a',
               "AKIAAKIA12345 AKIA" + "Q" * 16 + "AKIA" + "0" * 20, "token==abcde token=a token: token=abcdefgh" + "a" * 30,
               "PASSWORD:'x1y2' é login: root db postgres://h:5/x", "éé😀 api_key=😀 apikey=abcdef😀 hex " + "0af" * 8,
               "user=bob nothing https://x.example.com/a", "password=hunter22 " * 3000]


def test_secrets(spark, sample):
    rows = sample + [(10**6 + i, t) for i, t in enumerate(ODD_SECRETS)] + [(None, "token=abcdefg"), (None, None)]
    got = secret_scan.secrets(plain.documents(spark, rows)).collect()
    want = sorted((str(i), plain.digest(plain.secret_spans(t)), *[sum(x[0] == k for x in plain.secret_spans(t))
                                                                 for k in secret_scan.BASE]) for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in got) == want
    by_id = {r.doc_id: r.spans for r in got}
    assert by_id[10**6 + 2] == "short:0:12,short:44:58,user:59:67,endpoint:68:91"
    assert by_id[10**6 + 7] == ""  # a user and an endpoint without a secret
    for i, t in rows:
        if i is not None:
            assert set(f"{k}:{a}:{b}" for k, a, b in plain.secret_spans(t)) <= set(by_id[i].split(","))


def test_secret_links_need_to_be_near(spark):
    near, far = "user=bob " + "x " * 20 + "token=abc", "user=bob " + "x " * 200 + "token=abc"
    got = {r.doc_id: r.n_weak for r in secret_scan.secrets(plain.documents(spark, [(1, near), (2, far)])).collect()}
    assert got == {1: 2, 2: 0}


def test_secret_links_of_long_parts(spark):
    """Every pair within reach, against a search over all pairs of spans of any length."""
    rng, rows = random.Random(9), []
    kinds = {"opaque": "secret", "short": "secret", "assign": "secret", "user": "identifier", "endpoint": "endpoint"}
    for row in range(200):
        at = rng.randint(0, 900)
        for kind in rng.choices(list(kinds), k=rng.randint(2, 6)):
            end = at + rng.choice([1, 3, 40, 199, 200, 201, 450, 2000, rng.randint(1, 900)])
            rows.append((row, kind, secret_scan.KINDS.index(kind), at, end, kind == "assign", kinds[kind]))
            at = max(0, end + rng.choice([-30, 0, 1, 180, 199, 200, 201, rng.randint(0, 500)]))
    found = spark.createDataFrame(
        rows, "row bigint, kind string, rank int, start bigint, end bigint, base boolean, part string")
    want = sorted({(a[0], a[1], a[3], a[4], b[1], b[3], b[4]) for a in rows for b in rows if a[0] == b[0] and a[6] == "secret"
                   and b[6] != "secret" and 0 <= max(a[3], b[3]) - min(a[4], b[4]) <= secret_scan.REACH})
    got = [(r.row, r.a.kind, r.a.start, r.a.end, r.b.kind, r.b.start, r.b.end) for r in secret_scan.links(found).collect()]
    assert sorted(set(got)) == want


def test_secrets_with_long_parts_are_linked(spark):
    token = "aB3" * 13 + "x"
    texts = ["password=" + "x" * 450 + " user=bob", "x " * 99 + " " + token + " " + "x " * 89 + " https://x.example.com/a"]
    got = {r.doc_id: r.spans for r in secret_scan.secrets(plain.documents(spark, list(enumerate(texts)))).collect()}
    assert got == {0: "assign:0:459,user:460:468", 1: "opaque:199:239,endpoint:419:442"}


def test_weak_parts_of_any_length(spark):
    """Whole spans, however long; hostile runs of a million characters take no more than linear time."""
    token, url = "aB3" * 400, "https://x.example.com/a?sig=" + "q/" * 300
    parts = {"opaque": [token, token + "==", "z" * 500 + "B" + "9" * 20], "endpoint": [url, "jdbc:" + "a" * 20 + "://host"],
             "user": ["user=" + "b." * 100, "login" + " " * 30 + ":" + " " * 30 + "bob"]}
    other = {"opaque": "user=bob", "endpoint": "token=abc", "user": "token=abc"}
    rows = [(kind, t, f"{t} {other[kind]}") for kind, some in parts.items() for t in some]
    docs = plain.documents(spark, [(i, t) for i, (_, _, t) in enumerate(rows)])
    got = {r.doc_id: r.spans.split(",")[0] for r in secret_scan.secrets(docs).collect()}
    assert got == {i: f"{kind}:0:{len(t)}" for i, (kind, t, _) in enumerate(rows)}
    assert not any(x in r.text for r in secret_scan.redacted(docs).collect() for x in ("q/", "b.b", "aB3", "bob"))
    hostile = ["aB3" * 400_000 + "===", "user" + " " * 10**6, "a" * 10**6, "+" * 10**6, "user=a " * 200_000, "https://" * 100_000,
               "jdbc:" * 200_000, "=" * 10**6]
    got = secret_scan.secrets(plain.documents(spark, list(enumerate(hostile)))).collect()
    assert [r.n_weak for r in got] == [0] * len(hostile)


def test_redaction(spark):
    rows = [(1, "a password=b7db7aa4a5fcc78305aaaabbbb é token=abcdefgh z"), (2, None), (None, "AKIA" + "Q" * 16), (1, "clean")]
    docs = plain.documents(spark, rows)
    out = secret_scan.redacted(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.text) for r in out.collect()) == ["None", "[access]", "a [assign] é [assign] z", "clean"]
    assert all(r.n_chars == len(r.text or "") for r in out.collect())
    assert secret_scan.redacted(empty(spark)).collect() == []


def test_no_python_in_native_operators(spark, sample):
    docs = plain.documents(spark, sample[:20])
    _, found = secret_scan.candidates(docs)
    _, votes = pii.candidates(docs)
    import comparison
    for df in (secret_scan.reported(found), secret_scan.secrets(docs), pii.personal_data(docs), votes):
        text = comparison.plan(df)
        assert not any(x in text for x in ("Python", "Arrow", "Pandas")), text


def odd_personal():
    rng = random.Random(5)
    texts = [None, "", "a@b.com_x@y.org a@b.com@d.org é", "1.2.3.4.5.6.7.8 001.002.003.255 1.2.3.256 000000255.1.1.1 1.2.3",
             "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 4111--1111 12 4111 1111 1111 1111",
             "+1 (988) 555-2485 +49.30.1234567 +1 2", "😀é+33 1 23 45 67 89😀x@é.com x@y.zz", "1" * 50_000, "a" * 50_000]
    texts += ["".join(rng.choice("a1.@-+ ( 0é_%9") for _ in range(rng.randint(5, 120))) for _ in range(300)]
    texts += ["".join(rng.choice("0123456789 -.") for _ in range(rng.randint(15, 80))) for _ in range(300)]
    return texts


def test_personal_data(spark, sample):
    rows = sample + [(10**6 + i, t) for i, t in enumerate(odd_personal())] + [(None, "a@b.com"), (None, None)]
    got = pii.personal_data(plain.documents(spark, rows)).collect()
    want = sorted((str(i), plain.digest(plain.personal_spans(t)), *[sum(x[0] == k for x in plain.personal_spans(t))
                                                                   for k in pii.BASE]) for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want


def test_spans_of_hostile_texts(spark):
    """Long repeats of every form: the matcher's stack and time stay bounded."""
    n, labels = 30_000, 1_500_000
    texts = ["x@" + "b." * labels + "c", "a." * n + "@b.c", "x@" + "b-" * n, "1." * n, "1 " * n, "+1" + " (" * n + "1", "a@b.c" * (n // 3),
             "aa(at)bb" + " dot cc" * (n // 5), "DE89" + " 3704" * (n // 3), "Mr A" + " Bc" * n, "123-45-6789" * (n // 8), "\"' :=" * (n // 4),
             "password=" * (n // 6), "token" + " " * n + "= abcdef", "AKIA" + "A1" * n, "0f" * n, "user_name=" + "a." * n, "https://" + "a/" * n,
             "aB3" * n, "jdbc:" * (n // 4)]
    rows = list(enumerate(texts))
    found = {r.doc_id: r for r in pii.personal_data(plain.documents(spark, rows)).collect()}
    assert len(found) == len(rows) and found[0].n_email == 1 and found[0].spans.startswith(f"email:0:{2 * labels + 3}")
    assert found[6].base_sha256 == plain.digest(plain.personal_spans(texts[6]))
    secrets = {r.doc_id: r for r in secret_scan.secrets(plain.documents(spark, rows)).collect()}
    assert len(secrets) == len(rows) and secrets[14].n_access == 1 and secrets[15].n_hex == 1 and secrets[13].n_assign == 1


def test_personal_data_adds_candidates_with_context(spark, sample):
    rows = sample + [(10**6 + i, f"ssn 123-45-67{i:02d}, please") for i in range(30)] + [(10**7, "build 123-45-6789, please")]
    got = {r.doc_id: r.spans for r in pii.personal_data(plain.documents(spark, rows)).where("doc_id >= 1000000").collect()}
    assert got == {10**6 + i: "ssn:4:15" for i in range(30)} | {10**7: ""}


def iban(rng, country="DE", n=18):
    body = "".join(rng.choice("0123456789") for _ in range(n))
    check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
    flat = f"{country}{check:02}{body}"
    return " ".join(flat[i:i + 4] for i in range(0, len(flat), 4))


def planted_spans(rng):
    """(text, kind or None): spans of every wide kind, and what only looks like them."""
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    name = rng.choice(["Maria", "Robert", "Hans", "Xyla"])
    good = iban(rng)
    return [(f"My SSN is {number(2)}1-{number(2)}-{number(4)} thanks", "ssn"), (f"please call {number(3)}-{number(3)}-{number(4)} today", "local_phone"),
            (f"pay to IBAN {good} soon", "iban"), (f"we saw {good} there", "iban"), (f"write to jo{number(2)} (at) example (dot) com ok", "masked_email"),
            (f"see jo{number(2)}[at]site{number(1)}.org or", "masked_email"), (f"signed, Dr. {name} Lopez of", "person"),
            (f"build {number(2)}1-{number(2)}-{number(4)} done", None), (f"lot {number(3)}-{number(3)}-{number(4)} stored", None),
            (f"see code {good[:-1]}{(int(good[-1]) + 1) % 10} there", None), (f"we met at noon. Then {number(2)} left", None)]


def test_the_classifier_adds_planted_spans_of_every_kind(spark):
    """Precision and recall of the added spans beside the given texts, whose wide candidates are all sentences."""
    rng = random.Random(12)
    planted = [x for _ in range(40) for x in planted_spans(rng)]
    given = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = given + [(10**7 + i, t) for i, (t, _) in enumerate(planted)]
    added = {r.doc_id: [x.split(":")[0] for x in r.spans.split(",") if x.split(":")[0] in pii.WIDE]
             for r in pii.personal_data(plain.documents(spark, rows)).where("n_added > 0").collect()}
    assert not [i for i in added if i < 10**7]
    hits = [(kind, added.get(10**7 + i, [])) for i, (_, kind) in enumerate(planted)]
    for kind in pii.WIDE:
        mine = [kind in got for want, got in hits if want == kind]
        assert sum(mine) >= 0.9 * len(mine), kind
    wrong = sum(len([k for k in got if k != want]) for want, got in hits)
    assert wrong <= 0.05 * sum(len(got) for _, got in hits)


def test_account_check_digits(spark):
    rows = [("DE89 3704 0044 0532 0130 00", True), ("GB29NWBK60161331926819", True), ("DE88 3704 0044 0532 0130 00", False), ("FR14 2004 1010 0505 0001 3M02 606", True)]
    got = spark.createDataFrame(rows, "found string, want boolean").select("want", pii.iban_check(F.col("found")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_labeler_accuracies(spark):
    """Expectation-maximisation finds which labelers are good."""
    rng = random.Random(2)
    accuracy = dict(zip(pii.LABELERS, (0.95, 0.9, 0.8, 0.7, 0.6, 0.85)))
    rows = []
    for _ in range(6000):
        true = rng.random() < 0.6
        rows.append(tuple((1 if (rng.random() < a) == true else -1) if rng.random() < 0.8 else 0 for a in accuracy.values()))
    votes = spark.createDataFrame(rows, ", ".join(f"{v} int" for v in pii.LABELERS)).withColumn("kind", F.lit("ssn"))
    priors, found = pii.estimate(votes)
    assert priors["ssn"] == pytest.approx(0.6, abs=0.05)
    assert all(found[v] == pytest.approx(a, abs=0.05) for v, a in accuracy.items())


def test_spans_of_empty_tables(spark):
    assert secret_scan.secrets(empty(spark)).collect() == []
    assert pii.personal_data(empty(spark)).collect() == []


# --- packing

def test_packing(spark, sample):
    from tokenizers import Tokenizer
    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    odd = ["", "a<|endoftext|>b <|startoftext|> x<|endoftext|><|endoftext|>é <|ENDOFTEXT|> <|endoftext", "<|endoftext|> it's I'LL x'd A1b2 ΑΣΣ İstanbul éa  x y ...!!'s 中文字 😀", None, LONG]
    rows = sample + [(10**6 + i, t) for i, t in enumerate(odd)] + sample[:3]
    got = packing.packed_documents(plain.documents(spark, rows), path, part_rows=40).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    want = sorted((i, n, n * 4096, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes()))
                  for i, _ in rows for n, x in enumerate(ids[i][k:k + 4096] for k in range(0, len(ids[i]), 4096)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096
    total = sum(len(ids[i]) for i, _ in rows)
    assert len(ends) <= -(-total // 4096) + 1
    assert packing.packed_documents(empty(spark), path).collect() == []


def test_ids_equal_the_library():
    """Words of odd characters: control characters, marks, letters with and without plain lower case."""
    encoder = packing.Encoder(queries.tokenizer_path(), most=300)
    rng = random.Random(1)
    letters = "\x0b\x0c\x1d\x1e\x1f\x85\x01abcXYZ019'!.,-_ \x00\x7f\x1c\xa0éÉßÿÀÖíàÑøÆ×÷\u0301ΣİŒ中😀\n\t"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["x's I'LL don't we've", "<|endoftext|> <|startoftext|>x"]
    marks = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "x", "é", " ", "\u0301", "'s", "<|ENDOFTEXT|>"]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    from tokenizers import Tokenizer
    want = Tokenizer.from_file(queries.tokenizer_path()).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(encoder.ids(t.encode()), "<u4").tolist() for t in texts] == [e.ids for e in want]


def test_known_words_are_bounded_and_frequent_ones_stay():
    """A full table is put aside: rare words go, a word of every text is tokenized once."""
    encoder = packing.Encoder(queries.tokenizer_path(), most=50)
    asked, part = [], encoder.model
    encoder.model = type("Counting", (), {"tokenize": lambda self, x: asked.append(x) or part.tokenize(x)})()
    names = ["".join(chr(97 + n // 26 ** k % 26) for k in range(4)) for n in range(2000)]
    held = []
    for name in names:
        encoder.ids(f"frequent rare{name}".encode())
        held.append(len(encoder.words) + len(encoder.earlier_words) + len(encoder.parts) + len(encoder.earlier_parts))
    assert asked.count("frequent") == 1 and len(asked) == 2001
    assert max(held) <= 4 * 53
    encoder.forget()
    assert not encoder.words and not encoder.earlier_words and not encoder.parts and not encoder.earlier_parts


def test_forms_of_a_word_share_one_entry():
    """A lower-case word is its own part: kept once and tokenized once, whichever of its forms comes first."""
    encoder = packing.Encoder(queries.tokenizer_path())
    asked, part = [], encoder.model
    encoder.model = type("Counting", (), {"tokenize": lambda self, x: asked.append(x) or part.tokenize(x)})()
    names = ["".join(chr(97 + n // 26 ** k % 26) for k in range(4)) for n in range(500)]
    lower = encoder.ids(" ".join(names).encode())
    assert len(encoder.words) + len(encoder.parts) == 500
    assert encoder.ids(" ".join(names).title().encode()) == lower and len(asked) == 500
    encoder.forget()
    assert encoder.ids(" ".join(names).upper().encode()) == lower and encoder.ids(" ".join(names).encode()) == lower
    assert len(asked) == 1000 and len(encoder.words) == 1000 and not encoder.parts


def test_bound_is_a_bound():
    rng = random.Random(7)
    for _ in range(200):
        capacity = rng.choice([10, 100, 4096])
        lengths = np.array(sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 40))), reverse=True))
        bins, _ = packing.best_fit(lengths, capacity)
        assert np.bincount(bins, weights=lengths).max() <= capacity
        assert packing.bound(lengths, capacity) <= bins.max() + 1 + 1e-9
    assert packing.bound(np.array([6] * 5), 10) == 5  # none fits with another


def test_exchange_closes_gaps(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(1, 3000)) for i in range(900)]
    done = packing.pack(spark.createDataFrame(rows, "item bigint, length bigint"), 4096, part_rows=60)
    packed = [r for d in done for r in d.collect()]
    assert sorted((r.item, r.length) for r in packed) == rows
    bins = len({r.bin for r in packed})
    alone = packing.pack_parts(spark.createDataFrame(rows, "item bigint, length bigint"), 15, 4096, 0).select("bin").distinct().count()
    assert bins <= alone and len(done) > 1
    assert all(r.bins >= r.bound for r in packing.certificates(done).collect())


# --- decontamination

def test_tiling(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = sorted(bench.collect())[1]
    sentences = item.text.split(". ")
    rows = [(1, "xx yy " + ". ".join(reversed(sentences)) + " zz"), (2, None), (3, ""), (4, item.text.upper()), (None, item.text),
            (5, item.text[:len(item.text) // 4]), (6, LONG), (4, item.text.upper()), (7, "a " + item.text + " b " + item.text)]
    got = {r.doc_id: r for r in decontaminate.leaks(plain.documents(spark, rows), bench.withColumn("seed", F.lit(1))).collect()}
    assert set(got) == {1, 4, 7} and all(r.item_id == item.item_id for r in got.values())
    assert got[4].coverage == 1.0 and got[4].n_tiles == 1 and got[1].n_tiles > 1 and got[7].n_tiles == 1
    docs = plain.documents(spark, rows)
    left = decontaminate.clean_documents(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, 3, None, 5, 6}
    assert decontaminate.leaks(empty(spark), bench).collect() == []
    assert decontaminate.leaks(docs, bench.limit(0)).collect() == []


def test_short_items_and_scripts_without_blanks(spark):
    bench = spark.createDataFrame([(1, "Alpha beta, gamma delta"), (2, "東京は日本の首都です"), (3, "solo"), (4, "..."), (5, None),
                                   (6, "two words")], "item_id bigint, text string")
    texts = ["alpha BETA gamma delta", "x alpha beta gamma delta y alpha beta gamma delta", "alpha beta gamma", "beta alpha gamma delta",
             "答え:東京は日本の首都です。", "東京は大きい", "Solo", "solos two-words", "", None, "two " + LONG + "words"]
    docs = plain.documents(spark, list(enumerate(texts)))
    got = sorted((r.doc_id, r.item_id, r.matched_tokens, r.n_tiles, r.coverage) for r in decontaminate.leaks(docs, bench).collect())
    assert got == [(0, 1, 4, 1, 1.0), (1, 1, 4, 1, 1.0), (4, 2, 10, 1, 1.0), (6, 3, 1, 1, 1.0), (7, 6, 2, 1, 1.0)]
    left = decontaminate.clean_documents(docs, bench)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 5, 8, 9, 10]


def test_short_items_against_plain_search(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    items, texts = [words(rng.randint(1, 4)) for _ in range(30)], [words(rng.randint(0, 12)) for _ in range(200)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(plain.documents(spark, list(enumerate(texts))), bench).collect()}
    assert got == {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if f" {x} " in f" {t} "}


def test_tiling_against_plain_search():
    """Greedy string tiling by comparing all places."""
    rng = random.Random(6)
    for _ in range(300):
        item, doc = ([rng.choice("abc") for _ in range(rng.randint(1, 14))] for _ in range(2))
        hits = [(d, i) for d in range(len(doc) - 2) for i in range(len(item) - 2) if doc[d:d + 3] == item[i:i + 3]]
        marked_i, marked_d, total = set(), set(), 0
        while True:
            best = (2, 0, 0)
            for i in range(len(item)):
                for d in range(len(doc)):
                    n = 0
                    while (i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n]
                           and i + n not in marked_i and d + n not in marked_d):
                        n += 1
                    if n > best[0]:
                        best = (n, i, d)
            if best[0] < 3:
                break
            n, i, d = best
            marked_i.update(range(i, i + n))
            marked_d.update(range(d, d + n))
            total += n
        assert sum(t[2] for t in decontaminate.tile(hits, 3)) == total


def test_planted_items_are_found(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    texts, items = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in bench.collect()}
    inside = {(i, k) for i, t in texts.items() for k, x in items.items() if t and x in t}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == inside


# --- near-duplicates

def edited(rng, words, share):
    return " ".join(rng.choice(words) + "x" if rng.random() < share else w for w in words)


def near_rows():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(40)]
    for base in range(6):
        words = rng.choices(vocabulary, k=80)
        rows += [(100 + 30 * base + i, edited(rng, words, 0.02 * (i % 4))) for i in range(25)]
    rows += [(900, "A b C"), (901, "a B c"), (902, "a b"), (903, None), (904, ""), (905, " \t"), (None, rows[50][1]), (906, LONG),
             (907, LONG + "end")]
    return rows + rows[45:50]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, sample, size):
    rows = near_rows() if size == 5 else sample
    got = minhash.near_duplicates(plain.documents(spark, rows), size).collect()
    want = plain.components([r for r in rows if r[0] is not None], size)
    sets = plain.shingle_sets(rows, size)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
        assert r.n_shingles in {len(x) for x in sets.get(r.doc_id, [()])}


def test_distinct_documents(spark):
    rows = near_rows()
    docs = plain.documents(spark, rows)
    out = minhash.distinct_documents(docs)
    want = plain.components([r for r in rows if r[0] is not None], 5)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted([str(x) for x in set(want.values())] + ["None"])
    assert minhash.near_duplicates(empty(spark)).collect() == []


def test_signature_estimates_similarity(spark):
    rng = random.Random(9)
    pairs = []
    for k in range(60):
        common = {rng.getrandbits(63) for _ in range(300)}
        a, b = ({*common, *(rng.getrandbits(63) for _ in range(n))} for n in (rng.randint(0, 200), rng.randint(0, 200)))
        pairs.append((len(common) / len(a | b), *[minhash.describe(np.array(sorted(x), dtype=np.uint64))[2] for x in (a, b)]))
    df = spark.createDataFrame(pairs, "similarity double, la array<bigint>, lb array<bigint>")
    away = [abs(r.similarity - r.found) for r in df.withColumn("found", minhash.estimate("la", "lb")).collect()]
    assert max(away) < 0.2 and sum(away) / len(away) < 0.05


# --- repeated strings

def string_rows():
    rng = random.Random(3)
    parts = ["the", "of", "éa", "and", "tion", "x" * 30, "ab ab ab ab", "😀"]
    base = " ".join(rng.choice(parts) + str(rng.randint(0, 30)) for _ in range(400))
    rows = []
    for i in range(250):
        k = rng.random()
        if k < .3:
            a = rng.randint(0, 1500)
            text = base[a:a + rng.randint(0, 400)]
        elif k < .5:
            text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 200)))
        elif k < .6:
            text = "ab" * rng.randint(0, 200)
        elif k < .7:
            text = None if k < .65 else ""
        else:
            noise = " ".join(str(rng.random()) for _ in range(rng.randint(0, 30)))
            text = noise + base[200:200 + rng.randint(30, 80)] + str(rng.random())
        rows.append((rng.randint(0, 220) if rng.random() < .97 else None, text))
    return rows + rows[:5]


def digests(df):
    return sorted((tuple(r) for r in substring_dedup.deduplicated(df, keep_text=False).collect()), key=str)


def test_repeated_strings(spark, sample):
    for rows in (string_rows(), sample):
        assert digests(plain.documents(spark, rows)) == plain.repeated_bytes(rows)


def test_repeated_strings_over_blocks_and_ranges(spark):
    """Texts longer than a block, and pairs dealt over several ranges."""
    rng = random.Random(12)
    long = "".join(rng.choice("abcdefgh ") for _ in range(substring_dedup.BLOCK_BYTES + 5000))
    shared = long[substring_dedup.BLOCK_BYTES - 300:substring_dedup.BLOCK_BYTES + 300]
    rows = [(1, long), (2, "x" * 40 + shared + "y" * 60), (0, "zz" + long[100:400]), (3, long[7:20_000] + "q" + long[20_000:50_000])]
    rows += [(10 + i, "A header that many documents have at their begin, all of it.\n" + str(rng.random()) * 5) for i in range(300)]
    assert digests(plain.documents(spark, rows)) == plain.repeated_bytes(rows)


def test_kept_bytes(spark):
    text = "0123456789" * 5 + "abcdefghij" * 5
    rows = [(1, text), (2, "new " + text[20:90] + " end"), (3, "short")]
    got = {r.doc_id: r.kept for r in substring_dedup.deduplicated(plain.documents(spark, rows)).collect()}
    assert got == {1: None, 2: bytearray(b"new  end"), 3: None}
    assert digests(empty(spark)) == []


def test_names_depend_on_bytes_only():
    rng = random.Random(13)
    text = bytes(rng.choice(b"abc") for _ in range(300))
    starts = np.arange(0, 250)
    names = substring_dedup.strings(text, starts)
    assert np.array_equal(names[30:], substring_dedup.strings(text[30:], starts[:220]))
    assert len(set(names.tolist())) == len({text[p:p + 50] for p in starts.tolist()})


def test_blocks_of_near_duplicates():
    """Links of a block against plain sets: one per node and other component."""
    import pyarrow as pa
    rng = random.Random(14)
    base = [rng.getrandbits(62) for _ in range(60)]
    sets = [sorted({*rng.sample(base, rng.randint(40, 60)), *(rng.getrandbits(62) for _ in range(rng.randint(0, 12)))})
            for _ in range(50)]
    component = [k % 20 for k in range(50)]
    rows = [(k, component[k], s, False) for k, s in enumerate(sets)] + [(k, component[k], s, True) for k, s in enumerate(sets) if k % 3]
    table = pa.table({"node": [r[0] for r in rows], "component": [r[1] for r in rows], "shingles": [r[2] for r in rows],
                      "seeks": [r[3] for r in rows]})
    got = {(a, component[b]) for a, b in zip(*(c.to_pylist() for c in minhash.compare(table, 80).columns))}
    want = {(a, component[b]) for a in range(50) if a % 3 for b in range(50) if component[a] != component[b]
            and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}
    assert got == want and want
