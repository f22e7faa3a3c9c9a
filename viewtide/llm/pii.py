"""Personal data by weak supervision, by DataFrame functions alone.

Strict patterns find e-mail addresses, IP addresses, card and phone numbers; these base spans stay. Wider patterns find
candidates. Labelers look at every candidate, strict ones too, and vote for (1), against (-1) or not at all (0): the
format's own rule, a check digit or value range, a gazetteer, words of the context before and after, and the shape. The
votes are counted by pattern (at most 3^6 patterns per kind); on these counts expectation-maximisation estimates each
labeler's accuracy and each kind's share of true spans. Its posteriors are the soft labels on which the final classifier
is trained: naive Bayes over the votes, and length and separators within the kind, again from counts; where these are few, they are
drawn to the labelers' accuracies and to no evidence. Candidates that it accepts and that do not overlap a base span are added.

All counting is Spark aggregation; a few dozen numbers per step come back as parameters of the next.

Edge cases: null and empty texts have no spans; repeated rows are scanned one by one; a null doc_id stays null; without
candidates nothing is estimated; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, functions as F

from viewtide.llm import common, spans

#: The strict kinds. A run of letters or digits is entered at its begin or where the last match ended, and
#: taken whole, which gives the matches of the plain patterns in linear time. Repeated groups are possessive or of bounded
#: number, so that the matcher runs them as loops: its stack does not grow with the text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates of wider patterns.
WIDE = {
    "masked_email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}"
                     r"(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z]{2,24}){1,3}(?![A-Za-z0-9])"),
    "local_phone": (r"(?<![0-9A-Za-z+().-])(?<![0-9]\x20)\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}"
                    r"(?![0-9A-Za-z]|[\x20.-][0-9])"),
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": (r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.?\x20[A-Z][a-z]{1,24}"
               r"(?:\x20[A-Z][a-z]{1,24})?(?![A-Za-z])"),
}
KINDS = [*BASE, *WIDE]
#: Gazetteers: top-level domains, dialling codes and given names.
DOMAINS = "com org net edu gov io info de fr es uk it eu ch at nl be".split()
DIALLING = "1 7 20 27 30 31 32 33 34 39 41 43 44 45 46 47 48 49 52 54 55 61 81 86 90 91".split()
NAMES = ("james john robert michael david william mary linda susan anna maria peter thomas hans klaus petra "
         "jean pierre marie sophie carlos jose juan ana lucia").split()
#: Context words by kind.
WORDS = {
    "email": "mail|contact|write|reach|correo|courriel|kontakt", "ip": r"\bip\b|address|server|host|login",
    "card": "card|visa|master|credit|karte|carte|tarjeta|payment", "phone": r"phone|\btel|call|mobile|fax|handy|telefon",
    "ssn": r"\bssn\b|social|security", "iban": "iban|account|bank|konto|compte|cuenta", "person": "name|contact|patient|signed|from|dear",
}
WORDS |= {"masked_email": WORDS["email"], "local_phone": WORDS["phone"]}
AGAINST = r"version|isbn|issn|order|invoice|figure|page|chapter|serial|part no"
UNITS = r"^\x20?(?:kg|km|cm|mm|eur|usd|%|px|mb|gb|pages)\b"
LABELERS = ("v_rule", "v_check", "v_gazetteer", "v_before", "v_after", "v_shape")
PRIOR_HITS, PRIOR_MISSES = 8.0, 2.0
EM_STEPS = 10
ACCEPT = 0.75
#: Spans of each class that a kind, and votes that a labeler, is taken to have had before anything is counted.
KIND_PRIOR, VOTE_PRIOR = 5.0, 10.0


def digits() -> Column:
    return F.regexp_replace("found", "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    each = F.transform(F.split(F.reverse(number), "(?<=.)(?=.)"), lambda x, i: F.when(
        i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def iban_check(number: Column) -> Column:
    """Whether an account number's check digits are right: first four characters to the end, letters as 10 to 35, rest 1 by 97."""
    plain = F.regexp_replace(number, "\x20", "")
    turned = F.split(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4)), "(?<=.)(?=.)")
    step = lambda a, c: F.when(F.ascii(c) >= 65, a * 100 + F.ascii(c) - 55).otherwise(a * 10 + F.ascii(c) - 48) % 97
    return F.aggregate(turned, F.lit(0), step) == 1


def passes() -> Column:
    """Whether a strict match meets its kind's rule."""
    n = F.length(digits())
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    kind = F.col("kind")
    return (F.when(kind == "email", F.lit(True)).when(kind == "ip", F.col("found").rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
            .when(kind == "card", n.between(16, 19) & luhn(digits()))
            .when(kind == "phone", n.between(8, 15)).otherwise(F.lit(False)))


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scanned rows, and one row per candidate with its votes."""
    scanned = spans.scan(docs, BASE | WIDE, "pii")
    found = spans.placed(scanned, KINDS).withColumn("base", passes())
    kind, n = F.col("kind"), F.length(digits())
    by_kind = lambda table: functools.reduce(
        lambda c, kv: c.when(kind == kv[0], F.col("before").rlike(kv[1])), table.items(), F).otherwise(F.lit(False))
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    name = F.regexp_extract(F.lower("found"), r"\x20([a-z]+)", 1)
    tld = F.lower(F.regexp_extract("found", r"([A-Za-z]+)$", 1))
    code = F.regexp_extract("found", rf"^\+({'|'.join(sorted(DIALLING, key=len, reverse=True))})", 1)
    votes = {
        "v_rule": F.when(F.col("base"), yes).when(kind.isin(*BASE), no).otherwise(none),
        "v_check": F.when(kind == "card", F.when(luhn(digits()), yes).otherwise(no))
        .when(kind == "iban", F.when(iban_check(F.col("found")), yes).otherwise(no))
        .when((kind == "ssn") & F.col("found").rlike("^(?:000|666|9)|-00-|-0000$"), no)
        .when((kind == "ip") & F.col("found").rlike(r"^(?:0|127|255)\."), no).otherwise(none),
        "v_gazetteer": F.when(kind.isin("email", "masked_email"), F.when(tld.isin(*DOMAINS), yes).otherwise(none))
        .when(kind == "phone", F.when(code != "", yes).otherwise(none))
        .when(kind == "person", F.when(name.isin(*NAMES), yes).otherwise(none)).otherwise(none),
        "v_before": F.when(F.col("before").rlike(AGAINST), no).when(by_kind(WORDS), yes)
        .when(kind.isin(*WIDE), no).otherwise(none),
        "v_after": F.when(F.col("after").rlike(UNITS), no).otherwise(none),
        "v_shape": F.when((n > 6) & digits().rlike(r"^([0-9])\1*$"), no)
        .when(kind == "masked_email", F.when(F.col("found").rlike(r"[(\[]|\x20dot\x20"), yes)
              .when(F.col("found").rlike(r"\.\x20|\x20at\x20[^.]*$"), no)).otherwise(none),
    }
    clear = spans.apart(found.where(~kind.isin(*BASE) | F.col("base")))
    # strict matches that fail their rule are no candidates of the result, but labelers learn from them
    failed = found.where(kind.isin(*BASE) & ~F.col("base"))
    ready = clear.unionByName(failed).withColumns(votes).withColumn("digits", F.least(n, F.lit(20)))
    return scanned, common.stage(ready.withColumn("separated", F.col("found").rlike(r"[\x20./-]")).drop("before", "after"),
                                 "votes")


def total(columns) -> Column:
    return functools.reduce(operator.add, columns)


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def by_value(value: Column, table: dict[str, float]) -> Column:
    """The number that a table has for a value; 0 for others."""
    if not table:
        return F.lit(0.0)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[value], F.lit(0.0))


def posterior(priors: dict[str, float], accuracy: dict[str, float]) -> Column:
    """Probability that a span is true, given its kind and votes."""
    score = total([by_value(F.col("kind"), {k: logit(p) for k, p in priors.items()}),
                   *[F.col(v) * F.lit(logit(a)) for v, a in accuracy.items()]])
    return 1 / (1 + F.exp(-score))


def estimate(votes: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Each kind's share of true spans and the labelers' accuracies, by expectation-maximisation on the counts of vote patterns."""
    patterns = common.stage(votes.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")), "patterns")
    priors, accuracy = {}, dict.fromkeys(LABELERS, 0.8)
    for _ in range(EM_STEPS):
        p, sums = posterior(priors, accuracy), []
        for v in LABELERS:
            right = F.when(F.col(v) == 1, p).when(F.col(v) == -1, 1 - p).otherwise(F.lit(0.0))
            sums += [F.sum(F.col("n") * right).alias(f"{v}_right"),
                     F.sum(F.when(F.col(v) != 0, F.col("n")).otherwise(0)).alias(f"{v}_all")]
        rows = patterns.groupBy("kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") * p).alias("true"), *sums).collect()  # nine kinds
        priors = {r["kind"]: (r["true"] + KIND_PRIOR) / (r["n"] + 2 * KIND_PRIOR) for r in rows}
        # a labeler is taken to be better than chance, which also fixes which of the two classes is "true"
        right, voted = ({v: sum(r[f"{v}_{which}"] for r in rows) for v in LABELERS} for which in ("right", "all"))
        accuracy = {v: min(0.99, max(0.55, (right[v] + PRIOR_HITS) / (voted[v] + PRIOR_HITS + PRIOR_MISSES))) for v in LABELERS}
    return priors, accuracy


#: What the classifier sees beside the votes, each within its kind.
FEATURES = ("digits", "separated")


def trained(votes: DataFrame, priors: dict[str, float], accuracy: dict[str, float]) -> Column:
    """The span classifier for wide kinds: probability from log likelihood ratios under the soft labels."""
    soft = votes.where(F.col("kind").isin(*WIDE)).withColumn("p", posterior(priors, accuracy))
    named = [F.struct(F.lit(f).alias("feature"), in_kind(f).alias("value")) for f in FEATURES]
    named += [F.struct(F.lit(v).alias("feature"), F.col(v).cast("string").alias("value")) for v in LABELERS]
    named += [F.struct(F.lit("kind").alias("feature"), F.col("kind").alias("value"))]
    rows = (soft.select(F.explode(F.array(*named)).alias("x"), "p").groupBy("x.feature", "x.value")
            .agg(F.sum("p").alias("true"), F.sum(1 - F.col("p")).alias("false")).collect())  # kinds, lengths and votes only
    seen = {(r["feature"], r["value"]): (r["true"], r["false"]) for r in rows}
    kinds = {k: (seen["kind", k][0] + KIND_PRIOR, seen["kind", k][1] + KIND_PRIOR) for f, k in seen if f == "kind"}
    score = [by_value(F.col("kind"), {k: math.log(t / f) for k, (t, f) in kinds.items()})]
    for feature in FEATURES:
        table = {}
        for value, (true, false) in ((v, x) for (f, v), x in seen.items() if f == feature):
            t, f = kinds[value.split(":")[0]]
            table[value] = (math.log((true + VOTE_PRIOR * t / (t + f)) / t) - math.log((false + VOTE_PRIOR * f / (t + f)) / f))
        score.append(by_value(in_kind(feature), table))
    for v, a in accuracy.items():
        (t_yes, f_yes), (t_no, f_no) = seen.get((v, "1"), (0, 0)), seen.get((v, "-1"), (0, 0))
        t, f = t_yes + t_no + VOTE_PRIOR, f_yes + f_no + VOTE_PRIOR
        yes = math.log((t_yes + VOTE_PRIOR * a) / t) - math.log((f_yes + VOTE_PRIOR * (1 - a)) / f)
        no = math.log((t_no + VOTE_PRIOR * (1 - a)) / t) - math.log((f_no + VOTE_PRIOR * a) / f)
        score.append(F.when(F.col(v) == 1, F.lit(yes)).when(F.col(v) == -1, F.lit(no)).otherwise(F.lit(0.0)))
    return 1 / (1 + F.exp(-total(score)))


def in_kind(feature: str) -> Column:
    return F.concat_ws(":", "kind", F.col(feature).cast("string"))


def personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, counts and spans of every row of ``docs`` (doc_id, text)."""
    scanned, votes = candidates(docs)
    added = F.col("kind").isin(*WIDE) & (trained(votes, *estimate(votes)) >= accept)
    found = votes.where(F.col("base") | added)
    n = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}")
    per_row = found.groupBy("row").agg(
        *[n(k) for k in BASE], spans.listed(["rank", "start", "end"], F.col("base")).alias("strict"),
        spans.listed(["rank", "start", "end"]).alias("spans"), F.count(F.when(~F.col("base"), 1)).alias("n_added"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return scanned.select("row", "doc_id").join(per_row, "row", "left").select(
        "doc_id", *[zero(f"n_{k}") for k in BASE], F.sha2(F.coalesce("strict", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), zero("n_added"))
