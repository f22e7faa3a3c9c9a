"""Secret scans with multipart credential linking, by DataFrame functions alone.

Strong findings (kinds ``assign``, ``access``, ``hex``) stand for themselves. Weak candidates (a short assigned value, an
opaque token, a user name, an endpoint) mean little alone. Secrets are interval-joined with identifiers and endpoints
of the same text that lie within ``reach`` code points: a part that follows starts at most ``reach`` after the secret's
end, one that precedes ends at most ``reach`` before its start. So a secret looks for starts in the two cells of ``reach``
code points from its end on and for ends in the two up to its start; the join is on equal cells, a cell holds a bounded
number of starts and ends, and lengths do not matter. A weak candidate is reported if such a link holds it, and not if it
overlaps a strong finding.

Edge cases: null and empty texts have no spans; repeated rows are scanned one by one; a null doc_id stays null; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from viewtide.llm import common, spans

REACH = 200
#: The strong kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
ASSIGNED_LENGTH = 6
#: Weak kinds, of any length. Runs are possessive and entered at their begin only, so a scan takes linear time.
WEAK = {
    "user": r"""(?<![A-Za-z0-9_])(?i:client_?id|user(?:_?name)?|login|account)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9@._+-]{3,}+""",
    "opaque": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])"
               r"[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"),
    "endpoint": (r"(?<![A-Za-z])(?i:https?|ftps?|jdbc:[a-z]{2,}+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)"
                 r"""://[^\s"'<>|]{3,}+"""),
}
PARTS = {"assign": "secret", "hex": "secret", "short": "secret", "opaque": "secret", "access": "identifier",
         "user": "identifier", "endpoint": "endpoint"}
KINDS = ["assign", "access", "hex", "short", "opaque", "user", "endpoint"]


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scanned rows, and one row per strong or weak match: row, kind, rank, start, end, base, part."""
    scanned = spans.scan(docs, BASE | WEAK, "secrets")
    found = spans.placed(scanned, [*BASE, *WEAK])
    short = (F.col("kind") == "assign") & (F.length(F.regexp_extract("found", ASSIGN, 1)) < ASSIGNED_LENGTH)
    kind = F.when(short, F.lit("short")).otherwise(F.col("kind"))
    ranks = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    parts = F.create_map(*[F.lit(x) for k, p in PARTS.items() for x in (k, p)])
    found = found.select("row", kind.alias("kind"), "start", "end").select(
        "row", "kind", ranks[F.col("kind")].alias("rank"), "start", "end", F.col("kind").isin(*BASE).alias("base"),
        parts[F.col("kind")].alias("part"))
    return scanned, found


def links(found: DataFrame, reach: int = REACH) -> DataFrame:
    """Pairs of a secret with an identifier or endpoint of its text within ``reach`` code points."""
    cell = lambda place: F.floor(place / reach)
    at = lambda edge, place: F.struct(F.lit(edge).alias("edge"), cell(place).alias("cell"))
    side = lambda p: F.struct("kind", "rank", "start", "end", "base").alias(p)
    start, end = F.col("start"), F.col("end")
    secrets = found.where(F.col("part") == "secret").select("row", F.explode(F.array(
        at("start", end), at("start", end + reach), at("end", start - reach), at("end", start))).alias("at"), side("a"))
    others = found.where(F.col("part") != "secret").select(
        "row", F.explode(F.array(at("start", start), at("end", end))).alias("at"), side("b"))
    secrets, others = (x.select("row", "at.edge", "at.cell", p) for x, p in ((secrets, "a"), (others, "b")))
    after = (F.col("edge") == "start") & (F.col("b.start") - F.col("a.end")).between(0, reach)
    before = (F.col("edge") == "end") & (F.col("a.start") - F.col("b.end")).between(0, reach)
    return secrets.join(others, ["row", "edge", "cell"]).where(after | before).select("row", "a", "b")


def reported(found: DataFrame, reach: int = REACH) -> DataFrame:
    """Strong findings, and the weak ones that some link holds."""
    clear = spans.apart(found)
    linked = links(clear, reach).select("row", F.explode(F.array("a", "b")).alias("x")).where("not x.base").distinct()
    return clear.where("base").select("row", "kind", "rank", "start", "end", "base").unionByName(
        linked.select("row", "x.kind", "x.rank", "x.start", "x.end", "x.base"))


def n(kind: str) -> Column:
    return F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}")


def secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_weak of every row of ``docs`` (doc_id, text)."""
    scanned, found = candidates(docs)
    found = reported(common.stage(found, "parts"), reach)
    order = ["start", "rank", "end"]
    per_row = found.groupBy("row").agg(
        n("assign"), n("access"), n("hex"), spans.listed(order, F.col("base")).alias("strong"),
        spans.listed(order).alias("spans"), F.count(F.when(~F.col("base"), 1)).alias("n_weak"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return scanned.select("row", "doc_id").join(per_row, "row", "left").select(
        "doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"),
        F.sha2(F.coalesce("strong", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), zero("n_weak"))


def redacted(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """The documents with all their columns; every reported span of the text is replaced by its kind in brackets.

    An integer column n_chars follows the new text.
    """
    flat = common.numbered(docs)
    text = f"c{common.position(docs, 'text')}"
    rows = common.stage(flat.withColumn("row", F.monotonically_increasing_id()), "rows")
    whole = rows.select(F.col("row").alias("doc_id"), F.col(text).alias("text"))
    scanned, found = candidates(whole)
    cuts = (reported(common.stage(found, "parts"), reach).join(scanned.select("row", F.col("doc_id").alias("id")), "row")
            .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts")))
    # overlapping spans: a later one begins where the earlier ended
    step = lambda done, x: F.when(x["end"] <= done["at"], done).otherwise(F.struct(
        x["end"].alias("at"),
        F.concat(done["out"], F.array(F.concat(
            F.substring(F.col(text), (done["at"] + 1).cast("int"), F.greatest(x["start"] - done["at"], F.lit(0)).cast("int")),
            F.lit("["), x["kind"], F.lit("]")))).alias("out")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    end = F.aggregate("cuts", start, step)
    joined = rows.join(cuts, rows["row"] == cuts["id"], "left").withColumn("end", end)
    rest = F.substring(F.col(text), (F.col("end.at") + 1).cast("int"), F.length(text))
    clean = F.when(F.col("cuts").isNull(), F.col(text)).otherwise(F.concat(F.array_join("end.out", ""), rest))
    changed = {text: clean}
    if dict(docs.dtypes).get("n_chars") in ("int", "bigint"):
        at = f"c{common.position(docs, 'n_chars')}"
        changed[at] = F.when(F.col("cuts").isNull(), F.col(at)).otherwise(F.length(clean).cast(dict(docs.dtypes)["n_chars"]))
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in flat.columns]).toDF(*docs.columns)
