"""Secret scan with multipart credential linking: expressions, windows and joins only.

1. Every pattern's leftmost non-overlapping matches come from one pass over the text: the matches and the gaps
   between them have the lengths that give each match's place. Only these lengths are kept, not the texts.
2. Base kinds (assign, access, hex) are reported as they are.
3. Weak parts (user or key identifiers, random-looking strings, endpoints) mean little alone. Parts of one
   document whose starts are at most ``scope`` code points apart belong together, found by an interval join on
   bins of that width: a part probes the summaries (least and greatest start) of its own and the two next bins, so
   no pair of parts is ever emitted. A weak secret is reported with an identifier in scope, a weak identifier with
   a secret, an endpoint with both.
4. ``redact`` measures from the end of a part to the start of the next, and takes secrets that only a line break parts as
   one, by a running greatest end over the parts in order. A line that no pattern finds (a key's short last one) stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anomark.llm.common import stored

# Fixed values of the contract: base kinds in listed order, their patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # maximal runs, so the length limit can stand in the pattern
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16

# Weak parts, by this library's choice.
IDENTIFIER = r"""(?i)(access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)"""
RANDOM = r"[A-Za-z0-9+/]{24,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+"
IDENTIFIER_VALUE = 3

KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
IDENTIFIERS, SECRETS, ENDPOINTS = ("access", "id"), ("assign", "hex", "key"), ("endpoint",)


def _matches(kind: str, pattern: str, ok) -> Column:
    """Array of (kind, i, gap, len, ok) of the pattern's matches in ``__t``; null without a match.

    The lengths of the gaps are read only where there is a match.
    """
    found = F.regexp_extract_all("__t", F.lit(pattern), F.lit(0))
    gaps = F.split("__t", pattern, -1)
    rows = F.zip_with(
        F.zip_with(found, ok, lambda m, k: F.struct(F.length(m).alias("len"), k.alias("ok"))),
        F.transform(gaps, lambda g: F.length(g)),
        lambda m, g: F.struct(F.lit(KINDS.index(kind)).alias("kind"), g.alias("gap"), m["len"].alias("len"), m["ok"].alias("ok")),
    )
    return F.when(F.size(found) > 0, F.slice(rows, 1, F.size(found)))


def _group_length(pattern: str, group: int, least: int) -> Column:
    return F.transform(F.regexp_extract_all("__t", F.lit(pattern), F.lit(group)), lambda v: F.length(v) >= least)


def candidates(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, ``__uid`` (unique per row, fixed by writing the table) and ``__found``: all matches of all kinds."""
    text = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))

    def every(pattern: str, ok) -> Column:
        return F.transform(F.regexp_extract_all("__t", F.lit(pattern), F.lit(0)), ok)

    found = (
        _matches("assign", ASSIGN, _group_length(ASSIGN, 2, ASSIGN_VALUE)),
        _matches("access", ACCESS, every(ACCESS, lambda m: F.length(m) >= ACCESS_LENGTH)),
        _matches("hex", HEX, every(HEX, lambda m: F.lit(True))),
        _matches("id", IDENTIFIER, _group_length(IDENTIFIER, 2, IDENTIFIER_VALUE)),
        _matches("key", RANDOM, every(RANDOM, lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]"))),
        _matches("endpoint", ENDPOINT, every(ENDPOINT, lambda m: F.lit(True))),
    )
    none = F.array().cast("array<struct<kind:int,gap:int,len:int,ok:boolean>>")
    return stored(
        text.select(*keep, F.monotonically_increasing_id().alias("__uid"), F.concat(*(F.coalesce(f, none) for f in found)).alias("__found")),
        "secrets-found",
    )


def _parts(found: DataFrame) -> DataFrame:
    """(uid, kind, start, end) of the matches that pass their check."""
    rows = found.where(F.size("__found") > 0).select(F.col("__uid").alias("uid"), F.posexplode("__found").alias("i", "m"))
    run = Window.partitionBy("uid", "m.kind").orderBy("i")
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.len")).over(run)
    return (
        rows.withColumn("end", end)
        .where("m.ok")
        .select("uid", "m.kind", (F.col("end") - F.col("m.len")).alias("start"), "end")
    )


def _code(kinds: tuple[str, ...]) -> list[int]:
    return [KINDS.index(k) for k in kinds]


def linked_parts(parts: DataFrame, scope: int) -> DataFrame:
    """All base parts, and those weak parts that have their complement within ``scope``."""
    role = F.when(F.col("kind").isin(_code(IDENTIFIERS)), F.lit("i")).when(F.col("kind").isin(_code(SECRETS)), F.lit("s"))
    bins = (
        parts.select("uid", role.alias("role"), F.floor(F.col("start") / scope).alias("bin"), "start")
        .where("role IS NOT NULL")
        .groupBy("uid", "bin", "role")
        .agg(F.min("start").alias("low"), F.max("start").alias("high"))
    )
    weak = parts.where(F.col("kind") >= KINDS.index("id"))
    need = F.when(F.col("kind").isin(_code(SECRETS)), F.array(F.lit("i"))).when(
        F.col("kind").isin(_code(IDENTIFIERS)), F.array(F.lit("s"))
    ).otherwise(F.array(F.lit("i"), F.lit("s")))
    here = F.floor(F.col("start") / scope)
    probes = (
        weak.withColumn("needs", F.size(need))
        .withColumn("role", F.explode(need))
        .withColumn("bin", F.explode(F.sequence(here - 1, here + 1)))
    )
    near = probes.join(bins, ["uid", "bin", "role"]).where(
        (F.col("high") >= F.col("start") - scope) & (F.col("low") <= F.col("start") + scope)
    )
    linked = near.groupBy("uid", "kind", "start", "end", "needs").agg(F.count_distinct("role").alias("met")).where("met = needs")
    return parts.where(F.col("kind") < KINDS.index("id")).unionByName(linked.select("uid", "kind", "start", "end"))


def gap_linked_parts(parts: DataFrame, scope: int, line_break: int = 2) -> DataFrame:
    """All base parts, and those weak parts with their complement at most ``scope`` after their end or before their start.

    Secrets at most ``line_break`` apart count as one part from the first one's start to the last one's end. A complement is
    in scope if, of those that start up to ``scope`` after a part's end, the greatest end is ``scope`` before its start or later.
    """
    role = F.when(F.col("kind").isin(_code(IDENTIFIERS)), F.lit("i")).when(F.col("kind").isin(_code(SECRETS)), F.lit("s")).otherwise("e")
    order = Window.partitionBy("uid", "role").orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("role") != "s") | reach.isNull() | (F.col("start") > reach + line_break)
    run = Window.partitionBy("uid", "role", "run")
    whole = (
        parts.withColumn("role", role)
        .withColumn("fresh", fresh.cast("long"))
        .withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("low", F.min("start").over(run))
        .withColumn("high", F.max("end").over(run))
    )
    need = F.when(F.col("role") == "s", F.array(F.lit("i"))).when(F.col("role") == "i", F.array(F.lit("s"))).otherwise(F.array(F.lit("i"), F.lit("s")))
    asked = whole.where(F.col("kind") >= KINDS.index("id")).select(
        "uid", F.explode(need).alias("role"), (F.col("high") + scope).alias("at"), F.lit(1).alias("asks"), "kind", "start", "end", "low", F.size(need).alias("needs")
    )
    given = whole.where("role <> 'e'").select("uid", "role", F.col("low").alias("at"), F.lit(0).alias("asks"), "high")
    upto = Window.partitionBy("uid", "role").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    met = (
        given.unionByName(asked, allowMissingColumns=True)
        .withColumn("reached", F.max("high").over(upto))
        .where(F.col("asks") == 1)
        .where(F.col("reached") >= F.col("low") - scope)
    )
    linked = met.groupBy("uid", "kind", "start", "end", "needs").agg(F.count_distinct("role").alias("met")).where("met = needs")
    return parts.where(F.col("kind") < KINDS.index("id")).unionByName(linked.select("uid", "kind", "start", "end"))


def find_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), scope: int = 256, link=linked_parts) -> DataFrame:
    """docs(doc_id, text) -> ``keep`` columns, ``__found``, ``__spans``: array of (start, kind, end) in order, null without one.

    ``link`` is ``linked_parts`` (distance of starts) or ``gap_linked_parts``.
    Places count code points from 0, end exclusive. Null text is empty and has no span. Repeated rows are scanned one
    by one. An empty table gives an empty result. Only ``keep`` and text are read, so other columns' names don't matter.
    """
    found = candidates(docs, keep)
    spans = (
        link(_parts(found), scope)
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("__spans"))
    )
    none = found.where(F.size("__found") == 0).select(*found.columns, F.lit(None).cast("array<struct<start:bigint,kind:int,end:bigint>>").alias("__spans"))
    spans = spans.withColumnRenamed("uid", "__of")
    some = found.where(F.size("__found") > 0).join(spans, F.col("__uid") == F.col("__of"), "left").select(*found.columns, "__spans")
    return none.unionByName(some)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.coalesce(
        F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        ),
        F.lit(""),
    )


def redact(docs: DataFrame, scope: int = 256, mark: str = "[secret]") -> DataFrame:
    """docs with every span of ``find_secrets`` by ``gap_linked_parts`` in ``text`` replaced by ``mark`` (overlapping spans by one), n_chars following.

    All columns come back. Null text stays null. Column names that start with ``__`` are the operator's own.
    """
    names = docs.columns
    spans = find_secrets(docs, tuple(names), scope, gap_linked_parts)
    # overlapping spans become one: (last end of the piece before, start) pairs
    merged = F.aggregate(
        F.col("__spans"),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    cut = spans.withColumn("__m", F.when(F.col("__spans").isNotNull(), merged))
    zero = F.array(F.lit(0).cast("long"))
    ends = F.concat(zero, F.transform("__m", lambda s: s["end"]))
    starts = F.concat(F.transform("__m", lambda s: s["start"]), F.array(F.length("text").cast("long")))
    kept = F.zip_with(ends, starts, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    done = cut.withColumn("text", F.when(F.col("__m").isNull(), F.col("text")).otherwise(F.array_join(kept, mark)))
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.when(F.col("__m").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return done.select(*names)


def scan(docs: DataFrame, scope: int = 256) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans as text."""
    rows = find_secrets(docs, ("doc_id",), scope)

    def number(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("__spans", lambda s: s["kind"] == KINDS.index(kind))), F.lit(0)).cast("long")

    base = F.filter("__spans", lambda s: s["kind"] < KINDS.index("id"))
    counts = reduce(lambda acc, k: [*acc, F.when(F.col("__spans").isNull(), F.lit(0).cast("long")).otherwise(number(k)).alias(f"n_{k}")], KINDS[:3], [])
    return rows.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("__spans")).alias("spans"))
