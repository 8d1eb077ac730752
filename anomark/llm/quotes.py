"""Quotation linking: from messages with nested quotes to reply-ordered conversations without them.

1. A message's lines are parsed into passages: stretches of non-blank lines at one quote level ('>' marks).
2. A passage is normalised (case, white space) and hashed. Level 0 passages are a message's own.
3. Every earlier message with a quoted passage as its own may be the original. A passage is looked for alone, together
   with the next passage one level deeper (which the original quotes itself), and together with all passages of its level
   and of the level below. Each of these finds its nearest earlier holder and the number of earlier holders: quotes and
   holders are ordered by (hash, message) in written ranges, so no pairs are formed and a frequent hash spreads.
4. A message replies to the original of its least deep linked quotes; of several the one whose quote has the fewest
   earlier holders, then the one found with more context, with most quoted characters, and the latest. An original is
   earlier than the message that quotes it, so links form trees.
5. Pointer doubling finds each message's conversation (its root) and depth in rounds of joins, as many as the
   logarithm of the deepest reply chain. Ordered by (depth, message) every message follows the one it replies to.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anomark.llm.common import map_batches, stored, task_count
from anomark.operators.sequence import number_rows, position_within

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")


def passages(text: str) -> list[tuple[int, str]]:
    """(quote level, lines without their marks) of each stretch of non-blank lines at one level, in order."""
    found: list[tuple[int, list[str]]] = []
    open_ = False
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        level = marks.group(1).count(">") if marks else 0
        rest = line[marks.end() :] if marks else line
        if not rest.strip():
            open_ = False
        elif open_ and found[-1][0] == level:
            found[-1][1].append(rest)
        else:
            found.append((level, [rest]))
            open_ = True
    return [(level, "\n".join(lines)) for level, lines in found]


def passage_hash(passage: str) -> bytes:
    """128-bit hash of a passage without case and with single spaces."""
    return hashlib.blake2b(" ".join(passage.lower().split()).encode(), digest_size=16).digest()


ALONE, WITH_NEXT, WITH_ALL = 2, 1, 0


def context_hashes(found: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """(level, hash) of a message's passages in order -> (place, kind, hash) of passages with their context.

    A passage's next one is the last of the level below it that stands before it, or else the first after it. A message
    that is quoted whole has the same hashes one level down.
    """
    after: list[bytes | None] = []
    seen: dict[int, bytes] = {}
    for level, own in reversed(found):
        after.append(seen.get(level + 1))
        seen[level] = own
    after.reverse()
    seen = {}
    levels: dict[int, list[bytes]] = {}
    first: dict[int, int] = {}
    for place, (level, own) in enumerate(found):
        seen[level] = own
        levels.setdefault(level, []).append(own)
        first.setdefault(level, place)
        if below := seen.get(level + 1) or after[place]:
            yield place, WITH_NEXT, hashlib.blake2b(b"next" + own + below, digest_size=16).digest()
    for level, owns in levels.items():
        below = levels.get(level + 1, [])
        for deeper in ([], below) if below else ([],):
            if len(owns) > 1 or len(deeper) > 1:
                parts = [b"all", *sorted(set(owns)), b"/", *sorted(set(deeper))]
                yield first[level], WITH_ALL, hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def parse(messages: DataFrame) -> DataFrame:
    """messages(msg_id, text) -> (msg_id, place, level, kind, hash, chars, body: the passage itself at level 0).

    Rows of the kinds with context have no body. Null text has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, levels, kinds, hashes, chars, bodies = [], [], [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                found = passages(text.as_py())
                own = [(level, passage_hash(passage)) for level, passage in found]
                alone = ((place, ALONE, code) for place, (_, code) in enumerate(own))
                for place, kind, code in chain(alone, context_hashes(own)):
                    level, passage = found[place]
                    rows.append(k)
                    places.append(place)
                    levels.append(level)
                    kinds.append(kind)
                    hashes.append(code)
                    chars.append(len(passage))
                    bodies.append(passage if level == 0 and kind == ALONE else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(levels, pa.int32()),
                 pa.array(kinds, pa.int32()), pa.array(hashes, pa.binary()), pa.array(chars, pa.int64()), pa.array(bodies, pa.string())],
                names=["msg_id", "place", "level", "kind", "hash", "chars", "body"],
            )

    kind = messages.schema["msg_id"].dataType.simpleString()
    return map_batches(
        messages.where("msg_id IS NOT NULL").select("msg_id", F.coalesce("text", F.lit("")).alias("text")),
        run,
        f"msg_id {kind}, place int, level int, kind int, hash binary, chars bigint, body string",
    )


def nearest_holders(parsed: DataFrame) -> DataFrame:
    """parsed passages -> (msg_id, level, kind, chars, parent, holders): a row per quoted hash that an earlier message holds.

    ``parent`` is the nearest earlier holder, ``holders`` the number of earlier ones. A message's own quotes come before its
    own passages, so that it never finds itself. Rows are dealt by range on (hash, msg_id) and written with their range's
    number; what earlier ranges of a hash hold is a table of one row per hash and range.
    """
    quoted = parsed.where("level > 0").groupBy("hash", "msg_id", "level").agg(F.min("kind").alias("kind"), F.sum("chars").alias("chars"))
    holding = parsed.where("level = 0").select("hash", "msg_id").distinct()
    both = quoted.withColumn("holds", F.lit(False)).unionByName(holding.withColumn("holds", F.lit(True)), allowMissingColumns=True)
    spread = both.repartitionByRange(task_count(parsed.sparkSession), "hash", "msg_id", "holds")
    rows = stored(spread.withColumn("part", F.spark_partition_id()), "quotes-ranges")
    holder = F.when(F.col("holds"), F.col("msg_id"))
    here = Window.partitionBy("hash", "part").orderBy("msg_id", "holds").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("hash", "part").agg(F.max(holder).alias("last"), F.count(holder).alias("n"))
    before = sums.select("hash", "part", F.max("last").over(earlier).alias("last"), F.sum("n").over(earlier).alias("n")).where("last IS NOT NULL")
    near = rows.withColumn("near", F.max(holder).over(here)).withColumn("holders", F.count(holder).over(here)).where("NOT holds")
    return (
        near.join(before, ["hash", "part"], "left")
        .select(
            "msg_id", "level", "kind", "chars", F.coalesce("near", "last").alias("parent"),
            (F.col("holders") + F.coalesce("n", F.lit(0))).alias("holders"),
        )
        .where("parent IS NOT NULL")
    )


def reply_links(parsed: DataFrame) -> DataFrame:
    """parsed passages -> (msg_id, parent): one row per message that quotes an earlier one."""
    votes = (
        nearest_holders(parsed)
        .groupBy("msg_id", "level", "parent")
        .agg(F.min(F.struct("holders", "kind")).alias("found"), F.sum("chars").alias("chars"))
    )
    best = F.max(
        F.struct((-F.col("level")).alias("l"), (-F.col("found.holders")).alias("h"), (-F.col("found.kind")).alias("k"), "chars", "parent")
    )
    return votes.groupBy("msg_id").agg(best.alias("best")).select("msg_id", F.col("best.parent").alias("parent"))


def trees(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(msg_id, root, depth) by pointer doubling: each round a message jumps to its jump's jump.

    A message has arrived when the one it points to has; only the others are joined again."""
    now = stored(
        ids.join(links, "msg_id", "left").select(
            "msg_id", F.coalesce("parent", "msg_id").alias("root"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("parent").isNull().alias("arrived"),
        ),
        "quotes-jumps",
    )
    known, done = now, now.where("arrived")
    while not (moving := now.where("NOT arrived")).isEmpty():
        up = known.select(
            F.col("msg_id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("arrived").alias("there")
        )
        now = stored(
            moving.join(up, "root").select("msg_id", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("arrived")),
            "quotes-jumps",
        )
        known = done.unionByName(now)
        done = done.unionByName(now.where("arrived"))
    return done.select("msg_id", "root", "depth")


def conversations(messages: DataFrame) -> DataFrame:
    """messages(msg_id, text) -> conversation, depth, msg_id, parent, n_quotes, text (own passages, blank line between).

    msg_id is the order of arrival. Rows of one msg_id are one message, of the least of its texts (a repeated row changes
    nothing); rows without msg_id are left out, as they have no place in the order. Null or empty text is a message without
    own text. A message without a linked quote starts a conversation. Reply order is (conversation, depth, msg_id). An
    empty table gives an empty result. Other columns are not read.
    """
    once = stored(messages.groupBy("msg_id").agg(F.min("text").alias("text")).where("msg_id IS NOT NULL"), "quotes-messages")
    parsed = stored(parse(once), "quotes-passages")
    links = stored(reply_links(parsed), "quotes-links")
    placed = trees(once.select("msg_id"), links)
    own = parsed.where(F.col("kind") == ALONE).groupBy("msg_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("place", "body")))), lambda p: p["body"]), "\n\n").alias("text"),
        F.sum((F.col("level") > 0).cast("long")).alias("n_quotes"),
    )
    return (
        placed.join(links, "msg_id", "left")
        .join(own, "msg_id", "left")
        .select(
            F.col("root").alias("conversation"), "depth", "msg_id", "parent",
            F.coalesce("n_quotes", F.lit(0).cast("long")).alias("n_quotes"), F.coalesce("text", F.lit("")).alias("text"),
        )
    )


def quoted_mail(turns: DataFrame) -> DataFrame:
    """Stand-in input: each turn of conversations(conv_id, turn, text) as a message that quotes the two before it.

    Turns are numbered from 0 within their conversation, whatever their values; differing rows of one turn are messages of
    their own, in the order of their texts, and repeated rows are one. msg_id is conv_id times a million, or times the
    number of messages of the longest conversation if that is more, plus that number. Where some conv_id is no integer, or
    too large for that, messages are numbered in the order of (conv_id, number) instead.
    """
    said = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "text").distinct()
    base = stored(position_within(said, ["conv_id"], ["turn", "text"], "place", start=0).select("conv_id", "place", "text"), "quotes-turns")
    stride = max(1_000_000, (base.agg(F.max("place")).first()[0] or 0) + 1)

    def before(k: int) -> DataFrame:
        return base.select("conv_id", (F.col("place") + k).alias("place"), F.col("text").alias(f"text{k}"))

    def marked(name: str, mark: str):
        return F.when(F.col(name).isNotNull(), F.concat(F.lit(mark), F.replace(name, F.lit("\n"), F.lit("\n" + mark)), F.lit("\n\n"))).otherwise("")

    if base.schema["conv_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        far = base.agg(F.max(F.greatest(F.col("conv_id"), -(F.col("conv_id") + 1)).cast("bigint"))).first()[0] or 0
    else:
        far = None
    if far is not None and (far + 1) * stride < 1 << 63:
        numbered = base.withColumn("msg_id", F.col("conv_id").cast("bigint") * F.lit(stride).cast("bigint") + F.col("place"))
    else:
        numbered = stored(number_rows(base, ["conv_id", "place"], "msg_id"), "quotes-numbered")

    mail = numbered.join(before(1), ["conv_id", "place"], "left").join(before(2), ["conv_id", "place"], "left")
    return mail.select(
        "msg_id",
        F.concat(marked("text2", ">> "), marked("text1", "> "), F.coalesce("text", F.lit(""))).alias("text"),
    )
