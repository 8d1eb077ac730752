"""Prefix trie of conversations by vertical bitmaps.

Turns become 128-bit digests of (role, text). Conversations are cut into segments of ``segment`` turns, so that one of any
length is spread, and segments are dealt to shards of about ``shard_turns`` turns. A shard's index maps (position, turn) to
the bitset of its conversations that have this turn there. A node is the bitset of the conversations that begin with it:
depth first, the parent's bitset is met with the postings of the next position to give the children; a popcount gives the
members, the bitset of conversations that end there the end list. A node with one member is walked without bitsets.

A node's name is the chain digest of its turns, the same in every shard, so a shared node has one row a shard and these are
merged by name: members are summed, the least member is kept, end lists are read in one sorted stream.

Subtree sums need no walk of the trie. A node belongs to its least member; what a conversation owns is the lower end of its
own path, a chain that hangs on the chain of another. A chain's sum is handed to the place it hangs on, from there to the
place that chain hangs on, and so on, summed by place before each step; there are as many steps as chains hang on each
other, not as many as the trie is deep. A node's subtree is then the rest of its own chain and what hangs there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anomark.llm.common import map_batches, stored
from anomark.operators.sequence import position_within

ROOT = hashlib.md5(b"").digest()
NODE = "node binary, parent binary, depth bigint, chars bigint, n_convs bigint, conv_id bigint, ends array<bigint>"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> (conv_id, place from 0, digest of role and text, chars of text), by turn, null first.

    Null role or text is empty. Turns of equal number are ordered by role and text, and equal rows are turns of their own.
    Rows with a null conv_id belong to no conversation. Other columns are not read.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(-(1 << 63))).alias("__turn"),
        F.col("turn").isNotNull().alias("__known"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    placed = position_within(rows, ["conv_id"], ["__known", "__turn", "role", "text"], "place", start=0)
    digest = F.expr("unhex(md5(concat(cast(length(role) AS string), ':', role, text)))")
    return stored(placed.select("conv_id", "place", digest.alias("digest"), F.length("text").cast("bigint").alias("chars")), "trie-turns")


def with_shared_beginnings(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """turns(conv_id, place, digest, chars) -> every conversation c rebuilt, with a row of null place for each that has no turn.

    The first h turns are those of conversation c - c % every, the others c's own after its first h; h = crc32(c) % most. Only the
    first most - 1 turns of a conversation are ever joined.
    """
    h = F.expr(f"crc32(cast(cast(conv_id AS string) AS binary)) % {most}").cast("int")
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("last")).select("conv_id", h.alias("h"))
    bases = turns.where((F.col("place") < most - 1) & (F.col("conv_id") % every == 0))
    bases = bases.groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("place", "digest", "chars"))).alias("head")
    )
    joined = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(bases, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(bases.schema["head"].dataType)), F.lit(1), F.col("h"))
    plan = joined.select("conv_id", "h", head.alias("head")).withColumn("n", F.size("head"))
    first = plan.select("conv_id", F.explode_outer("head").alias("t")).select("conv_id", "t.place", "t.digest", "t.chars")
    own = turns.join(plan.select("conv_id", "h", "n"), "conv_id").where("place >= h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("n")).alias("place"), "digest", "chars"
    )
    return first.unionByName(own)


def _digest(*parts: bytes) -> bytes:
    return hashlib.md5(b"".join(parts)).digest()


class _Shard:
    """Trie of the segments of one shard that share one entry: conversations' turns from one depth to ``segment`` further."""

    def __init__(self, entry: bytes, start: int, rows: list[tuple[int, bytes, list[int], bool, bytes | None]]):
        # (conversation, digests of 16 bytes each, lengths, whether it ends here, name of the segment's last node if it goes on)
        self.entry, self.start, self.rows = entry, start, sorted(rows)

    def nodes(self) -> Iterator[tuple]:
        rows = self.rows
        lengths = [len(r[2]) for r in rows]
        turns = [[r[1][k : k + 16] for k in range(0, len(r[1]), 16)] for r in rows]
        postings: dict[tuple[int, bytes], int] = {}
        ended: dict[int, int] = {}
        for i, r in enumerate(rows):
            bit = 1 << i
            for place, t in enumerate(turns[i]):
                postings[place, t] = postings.get((place, t), 0) | bit
            if r[3]:
                ended[lengths[i]] = ended.get(lengths[i], 0) | bit
        every = (1 << len(rows)) - 1
        # the entry's own node is the last of the segment above, but for the root
        stack = [(every, 0, self.entry)]
        if self.start == 0:
            yield self.entry, None, 0, 0, len(rows), rows[0][0], self._members(every & ended.get(0, 0))
        while stack:
            members, place, name = stack.pop()
            if members & (members - 1) == 0:  # one conversation: its own path
                yield from self._alone(members.bit_length() - 1, place, name, turns, lengths)
                continue
            left = members & ~ended.get(place, 0)
            while left:
                i = (left & -left).bit_length() - 1
                if place >= lengths[i]:  # goes on in its next segment
                    left &= left - 1
                    continue
                turn = turns[i][place]
                child = members & postings[place, turn]
                left &= ~child
                below = self._name(i, place, name, turn, lengths)
                ends = self._members(child & ended.get(place + 1, 0))
                yield below, name, self.start + place + 1, rows[i][2][place], child.bit_count(), rows[i][0], ends
                stack.append((child, place + 1, below))

    def _name(self, i: int, place: int, name: bytes, turn: bytes, lengths: list[int]) -> bytes:
        last = self.rows[i][4]
        return last if last is not None and place + 1 == lengths[i] else _digest(name, turn)

    def _alone(self, i: int, place: int, name: bytes, turns: list, lengths: list[int]) -> Iterator[tuple]:
        conv, _, chars, ends, _ = self.rows[i]
        for k in range(place, lengths[i]):
            below = self._name(i, k, name, turns[i][k], lengths)
            yield below, name, self.start + k + 1, chars[k], 1, conv, [conv] if ends and k + 1 == lengths[i] else []
            name = below

    def _members(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.rows[low.bit_length() - 1][0])
            bits ^= low
        return out


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of (conv_id, part) -> name of the node at each segment's beginning."""
    conv, name = None, ROOT
    for batch in batches:
        out = []
        for c, digest in zip(batch.column("conv_id").to_pylist(), batch.column("sum").to_pylist()):
            if c != conv:
                conv, name = c, ROOT
            out.append(name)
            name = _digest(name, digest)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(out, pa.binary())], names=["conv_id", "part", "entry"])


def _tries(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.list_(pa.int64())]
        names = ["node", "parent", "depth", "chars", "n_convs", "conv_id", "ends"]
        shard, held = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            out = []
            for (part, entry), rows in held.items():
                for node in _Shard(entry, part * segment, rows).nodes():
                    out.append(node)
                    if len(out) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                        out = []
            held.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    yield from flush()
                    shard = row["shard"]
                last = _digest(row["entry"], row["sum"]) if len(row["chars"]) == segment else None
                held.setdefault((row["part"], row["entry"]), []).append((row["conv_id"], row["digests"], row["chars"], row["ends"], last))
        yield from flush()

    return run


def shard_nodes(rebuilt: DataFrame, segment: int = 1024, shard_turns: int = 16_384) -> DataFrame:
    """rebuilt(conv_id, place, digest, chars) -> nodes of every shard's trie, one row a node and shard.

    A null place marks a conversation without turns. (conv_id, place) are unique and gapless from 0.
    """
    turns = rebuilt.withColumn("part", F.coalesce(F.floor(F.col("place") / segment).cast("bigint"), F.lit(0).cast("bigint")))
    rows = F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "digest", "chars"))))
    parts = turns.groupBy("conv_id", "part").agg(rows.alias("r")).select(
        "conv_id", "part",
        F.aggregate("r.digest", F.expr("X''"), lambda a, b: F.concat(a, b)).alias("digests"),
        F.col("r.chars").alias("chars"),
    )
    parts = stored(parts.withColumn("sum", F.expr("unhex(md5(digests))")), "trie-segments")
    # more than one segment, or one that is just full: the others begin at the root
    long = parts.join(parts.where("part > 0").select("conv_id").distinct(), "conv_id")
    entries = map_batches(
        long.select("conv_id", "part", "sum").repartition("conv_id").sortWithinPartitions("conv_id", "part"),
        _entries, "conv_id bigint, part bigint, entry binary",
    )
    ahead = parts.where("part > 0").select("conv_id", (F.col("part") - 1).alias("part"), F.lit(False).alias("last"))
    full = parts.join(entries, ["conv_id", "part"], "left").join(ahead, ["conv_id", "part"], "left")
    shards = parts.agg(F.coalesce(F.sum(F.size("chars") + 1), F.lit(0))).first()[0] // shard_turns + 1
    dealt = full.select(
        F.expr(f"pmod(xxhash64(conv_id div 100, part), {shards})").alias("shard"),
        "conv_id", "part", "digests", "chars", "sum",
        F.coalesce("entry", F.lit(ROOT)).alias("entry"), F.coalesce("last", F.lit(True)).alias("ends"),
    )
    return map_batches(dealt.repartition("shard").sortWithinPartitions("shard"), _tries(segment), NODE)


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, conv_id) in order -> hash of each node's list, read as a stream."""
    node, state = None, None
    for batch in batches:
        out = []
        for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if n == node:
                state.update(b",%d" % c)
                continue
            if node is not None:
                out.append((node, state.hexdigest()))
            node, state = n, hashlib.sha256(b"%d" % c)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def _hanging_sums(own: DataFrame, chains: DataFrame) -> DataFrame:
    """own(conv_id, leaves, saved) of each chain, chains(conv_id, up, at) -> (conv_id, depth, leaves, saved): what hangs on each place.

    A chain hangs on chain ``up`` below its node of depth ``at``; the chain of the root hangs on none.
    """
    chains = chains.where("up IS NOT NULL")
    moving = own.join(chains, "conv_id").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    found = None
    while True:
        moving = stored(moving, "trie-hanging")
        if moving.isEmpty():
            break
        found = moving if found is None else found.unionAll(moving)
        whole = moving.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        moving = whole.join(chains, "conv_id").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
    return moving if found is None else found


def prefix_trie(rebuilt: DataFrame, segment: int = 1024, shard_turns: int = 16_384) -> DataFrame:
    """rebuilt(conv_id, place, digest, chars) -> one row per distinct beginning of the conversations.

    Columns: conv_id (least member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Sums are of the node's whole subtree, itself included. A conversation without turns (a row of null place) is a member of the
    root. Conversations with equal turns are members of the same nodes. An empty table has no node, not even a root.
    """
    pieces = stored(shard_nodes(rebuilt, segment, shard_turns), "trie-pieces")
    merged = stored(
        pieces.groupBy("node").agg(
            F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("chars").alias("chars"),
            F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        ),
        "trie-nodes",
    )
    ends = pieces.select("node", F.explode("ends").alias("conv_id")).repartition("node").sortWithinPartitions("node", "conv_id")
    ends = map_batches(ends, _hashed_ends, "node binary, ends_sha256 string")
    below = merged.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = stored(
        merged.join(below, "node", "left").join(above, "parent", "left").join(ends, "node", "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs",
            F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("leaf"),
            ((F.col("n_convs") - 1) * F.col("chars")).alias("value"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        ),
        "trie-linked",
    )
    own = nodes.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("value").alias("saved"))
    tops = nodes.where("parent_conv_id IS NULL OR parent_conv_id <> conv_id")
    chains = tops.select("conv_id", F.col("parent_conv_id").alias("up"), (F.col("depth") - 1).alias("at"))
    hanging = _hanging_sums(own, chains).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    zero = F.lit(0).cast("bigint")
    each = nodes.join(hanging, ["conv_id", "depth"], "left").withColumns(
        {
            "leaf": F.col("leaf") + F.coalesce("more_leaves", zero),
            "value": F.col("value") + F.coalesce("more_saved", zero),
            "part": F.floor(F.col("depth") / segment),
        }
    )
    each = stored(each.drop("more_leaves", "more_saved"), "trie-each")
    parts = each.groupBy("conv_id", "part").agg(F.sum("leaf").alias("leaves"), F.sum("value").alias("saved"))
    later = Window.partitionBy("conv_id").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "conv_id", "part",
        F.coalesce(F.sum("leaves").over(later), zero).alias("leaves_later"), F.coalesce(F.sum("saved").over(later), zero).alias("saved_later"),
    )
    rest = Window.partitionBy("conv_id", "part").orderBy(F.col("depth").desc())
    return each.withColumns({"leaf": F.sum("leaf").over(rest), "value": F.sum("value").over(rest)}).join(parts, ["conv_id", "part"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaf") + F.col("leaves_later")).alias("n_leaves"),
        (F.col("value") + F.col("saved_later")).alias("saved_tokens"),
        "ends_sha256",
    )
