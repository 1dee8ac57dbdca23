"""Secret scans: plain credential patterns, and weak parts that count only next to their complement.

Strong patterns (assignments, access keys, long hexadecimal runs) always stand. An
identifier, an opaque token or an endpoint alone means little; it is reported only if an
interval around it, within the same paragraph, meets a part of another role. That
interval join runs over the ends of all parts of a text in order: each weak part sees the
nearest part of every other role before and after it. All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.llm.columns import packed, without
from lemmaflow.llm.spans import before_each, let, match_spans

REACH = 200

# The base patterns.
KEYWORD = r"(?:[pP](?i:assword|asswd)|[sS](?i:ecret)|[tT](?i:oken)|[aA](?i:pi_?key))"
ASSIGN = rf"({KEYWORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

# Weak parts by role.
WEAK = [
    ("id", r"\b(?i:access_?key_?id|client_?id|account_?id|tenant_?id|user_?name|user|login)[\"']?\x20{0,8}[:=]\x20{0,8}[\"']?[A-Za-z0-9_.@-]{3,}"),
    ("opaque", r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{20,}={0,2}"),
    ("endpoint", r"\b(?:https?|ftp|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s\"'<>]+"),
]
#: What an opaque token must have besides.
MIXED = [r"[0-9]", r"[a-z]", r"[A-Z]"]
BREAK = r"\n[\x20\t]*\n"
KINDS = ["assign", "access", "hex", *(kind for kind, _ in WEAK)]
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "opaque": "secret", "endpoint": "endpoint"}
GATE = rf"{KEYWORD}[\"']?\x20*[:=]|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}|://|[A-Za-z0-9+/_-]{{20}}|(?i:_?id|user_?name|user|login)[\"']?\x20{{0,8}}[:=]"
TAGGED = "array<struct<start:int,kind:int,stop:int>>"
NO_SPANS = "array<struct<start:int,stop:int>>"
ADDED = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"]


def tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))


def listed(spans: Column) -> Column:
    """``kind:start:stop`` by start, then kind as listed, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def linked(parts: DataFrame, reach: int) -> DataFrame:
    """(key, linked): the weak parts within ``reach`` code points of a part of another role, with no paragraph break between.

    ``parts`` has (key, base, weak, breaks), one row a text. Parts that a base span
    covers are dropped, but still count as partners. The ends of parts and the breaks of
    a text stand in one order; the last end before a part, or the first beginning after
    it, of each role is all that must be looked at. Every frame grows as it goes, what
    lies ahead in a descending order, so a text of n parts takes time as n.
    """
    ends = lambda x: F.array(*[F.struct(x[e].alias("at"), F.lit(e).alias("what"), x.alias("part")) for e in ("start", "stop")])
    stops = F.transform("breaks", lambda c: F.struct(c.alias("at"), F.lit("break").alias("what"), F.lit(None).cast("struct<start:int,kind:int,stop:int>").alias("part")))
    events = parts.select("key", F.explode(F.concat(F.flatten(F.transform(F.concat("base", "weak"), ends)), stops)).alias("x"))
    role = F.get(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("part.kind"))
    events = events.select("key", F.col("x.at").alias("at"), F.col("x.what").alias("what"), F.col("x.part").alias("part")).withColumn("role", role)
    order = Window.partitionBy("key").orderBy("at")
    before, under = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("key").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    pick = lambda what, r=None: F.when((F.col("what") == what) & (F.lit(True) if r is None else F.col("role") == r), F.col("at"))
    roles = sorted(set(ROLE.values()))
    seen = events.withColumns({
        **{f"ended_{r}": F.max(pick("stop", r)).over(before) for r in roles},
        **{f"begins_{r}": F.min(pick("start", r)).over(after) for r in roles},
        "last_break": F.max(pick("break")).over(before),
        "next_break": F.min(pick("break")).over(after),
        "covered": F.max(F.when((F.col("what") == "start") & (F.col("part.kind") < len(KINDS) - len(WEAK)), F.col("part.stop"))).over(under),
    })
    other = lambda side: F.filter(F.array(*[F.when(F.col("role") != r, F.col(f"{side}_{r}")) for r in roles]), lambda x: x.isNotNull())
    ended, begins = F.array_max(other("ended")), F.array_min(other("begins"))
    behind = (F.col("what") == "start") & (ended >= F.col("at") - reach) & (F.col("last_break").isNull() | (F.col("last_break") < ended))
    ahead = (F.col("what") == "stop") & (begins <= F.col("at") + reach) & (F.col("next_break").isNull() | (F.col("next_break") >= begins))
    weak = seen.where(F.col("part.kind") >= len(KINDS) - len(WEAK))
    judged = weak.groupBy("key", "part").agg(F.bool_or(F.coalesce(behind | ahead, F.lit(False))).alias("near"), F.bool_or((F.col("what") == "stop") & F.coalesce(F.col("covered") > F.col("part.start"), F.lit(False))).alias("inside"))
    return judged.where("near AND NOT inside").groupBy("key").agg(F.collect_list("part").alias("linked"))


def scanned(docs: DataFrame, reach: int, names: list[str]) -> DataFrame:
    """(row, text, s0, s1, s2, base, found): the named columns packed, the base spans by kind and together, and every reported span.

    Texts with a weak part and another part are linked once for each different text, by
    its digest, and joined back; other rows get a key that nothing has, so that no task
    gets them all.
    """
    none = F.array().cast(NO_SPANS)
    df = docs.select(packed(names), F.coalesce("text", F.lit("")).alias("text")).withColumn("maybe", F.col("text").rlike(GATE))
    t = F.col("text")

    def spans(pattern: str, keep=None, group: int = 0) -> Column:
        return F.when(F.col("maybe") & t.rlike(pattern), match_spans(t, pattern, keep, group)).otherwise(none)

    mixed = lambda v: F.when(v.rlike(MIXED[0]), v.rlike(MIXED[1]) & v.rlike(MIXED[2])).otherwise(F.lit(False))
    df = df.withColumns({"s0": spans(ASSIGN, lambda v: F.length(v) >= 6, 2), "s1": spans(ACCESS), "s2": spans(HEX)})
    weak = F.concat(*[tagged(spans(p, mixed if kind == "opaque" else None), k) for k, (kind, p) in enumerate(WEAK, 3)])
    df = df.withColumn("base", F.concat(*[tagged(F.col(f"s{k}"), k) for k in range(3)])).withColumn("weak", weak)
    df = df.withColumn("open", (F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1))
    df = df.withColumn("key", F.when(F.col("open"), F.unhex(F.md5("text"))).otherwise(F.encode(F.concat(F.lit("nothing to link "), F.rand(7).cast("string")), "UTF-8")))
    breaks = F.transform(match_spans(t, BREAK), lambda s: s["start"])
    parts = df.where("open").groupBy("key").agg(F.first("base").alias("base"), F.first("weak").alias("weak"), F.first(breaks).alias("breaks"))
    df = df.join(linked(parts, reach), "key", "left")
    return df.select("row", "text", "s0", "s1", "s2", "base", F.sort_array(F.concat("base", F.coalesce("linked", F.array().cast(TAGGED)))).alias("found"))


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``docs`` with base counts, the digest of the base spans, and every reported span.

    ``found`` holds (start, kind number, stop) in code points, stop exclusive, kinds as in
    ``KINDS``. A base assignment's value must have 6 characters. Null and empty texts have
    no spans. A text is judged by itself, so ties and repeated rows don't matter. Columns
    of ``docs`` stay, apart from those that carry the names added here.
    """
    return scanned(docs, reach, without(docs, ADDED)).select(
        "row.*",
        F.size("s0").cast("bigint").alias("n_assign"),
        F.size("s1").cast("bigint").alias("n_access"),
        F.size("s2").cast("bigint").alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        "found",
    )


def redact(docs: DataFrame, mask: str = "[secret]", reach: int = REACH) -> DataFrame:
    """``docs`` with every reported span replaced by ``mask`` and ``n_chars`` counted anew; other columns, whatever their names, and all rows stay.

    Spans that overlap give one mask. A text without spans stays as it is, null included.
    """
    df = scanned(docs, reach, docs.columns)

    def pieces(found: Column) -> Column:
        done = before_each(F.transform(found, lambda x: x["stop"]), F.lit(0), lambda a, b: F.greatest(a, b))
        gap = lambda x, at: F.concat(F.substring(F.col("text"), at + 1, x["start"] - at), F.lit(mask))
        rest = let(F.array_max(F.transform(found, lambda x: x["stop"])), lambda at: F.substring(F.col("text"), at + 1, F.length("text")))
        return F.concat(F.array_join(F.zip_with(found, done, lambda x, at: F.when(x["start"] >= at, gap(x, at)).otherwise(F.lit(""))), ""), rest)

    df = df.withColumn("text", F.when(F.size("found") > 0, let(F.col("found"), pieces)).otherwise(F.col("row.text")))
    lower = {c.lower(): c for c in docs.columns}
    fresh = {lower["text"]: F.col("text")}
    if (n := lower.get("n_chars")) is not None:
        fresh[n] = F.when(F.size("found") > 0, F.length("text").cast(docs.schema[n].dataType)).otherwise(F.col(f"row.`{n}`"))
    return df.select(*[fresh[c].alias(c) if c in fresh else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
