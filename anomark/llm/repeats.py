"""Removal of bytes covered by strings that occur twice: an anchored suffix sort that compares by hashes.

1. Every window (``length`` bytes) has an anchor, the least-hashed short string in it, which depends on its bytes alone:
   equal windows have equal anchors at the same place. Neighbouring windows with one anchor form a run.
2. Runs are counted by anchor. An anchor met once marks nothing. One whose runs are all equal marks them whole.
   This leaves the edges of repeated passages.
3. Of these, each distinct run's bytes are dealt by anchor. A task sorts the suffixes that start at the runs'
   windows by mergesort; prefix polynomial hashes and binary search find two suffixes' common extension. Neighbours
   that share ``length`` bytes, confirmed byte by byte, mark each other.
4. An anchor with more than ``group_limit`` distinct runs is not sorted in one task: its windows are counted by
   128-bit hash and distance from the anchor, which spreads and pre-aggregates.
5. Marks go back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomark.llm.common import map_batches, stored, utf8

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)


class Hashing:
    """Prefix polynomial hashes modulo 2^64 with an odd base, so that a range's hash can be shifted to position 0."""

    BASE = 0xD1342543DE82EF95

    def __init__(self) -> None:
        self.symbol = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)  # a fixed table: all tasks agree
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, 2 * len(self.up))
        for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        """S with S[i] = sum of symbol(data[j]) * BASE^j for j < i."""
        self.powers(len(data) + 1)
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        np.cumsum(self.symbol[data] * self.up[: len(data)], dtype=np.uint64, out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of data[start:stop], the same wherever the bytes stand."""
        return (prefix[stop] - prefix[start]) * self.down[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX2
    return h ^ (h >> np.uint64(32))


BLOCK = 1 << 20
INDEX = np.uint64(BLOCK - 1)
_HASH: list[Hashing] = []


def hashing() -> Hashing:
    if not _HASH:
        _HASH.append(Hashing())
    return _HASH[0]


def runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, anchor hash, span hash) of each run.

    Each window of ``length`` bytes has an anchor: of its ``gram``-byte strings the one with the least hash, the first of
    equals. That depends on the window's bytes alone, so equal windows have their anchor at the same place in them.
    A run is a stretch of windows with one anchor; its span is all their bytes.
    """
    h = hashing()
    found: list[tuple[np.ndarray, ...]] = []
    n = len(data) - length + 1
    reach = length - gram + 1
    for at in range(0, max(n, 0), BLOCK - length):
        part = data[at : at + BLOCK]
        windows = min(len(part) - length + 1, BLOCK - length)
        if windows <= 0:
            break
        prefix = h.prefixes(part)
        grams = len(part) - gram + 1
        hashes = mixed((prefix[gram:] - prefix[:grams]) * h.down[:grams])
        low = (hashes & ~INDEX) | np.arange(grams, dtype=np.uint64)
        width = 1
        while 2 * width <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < reach:
            low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
        anchor = (low[:windows] & INDEX).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        last = np.concatenate((first[1:] - 1, [windows - 1]))
        anchor = anchor[first]
        span = mixed(h.ranges(prefix, first, last + length) + (last - first).astype(np.uint64) * MIX)
        found.append((first + at, last + at, anchor + at, hashes[anchor], span))
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def compare(prefix: np.ndarray, data: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1 as data[x:x+length] sorts before, with or after data[y:y+length].

    The common extension of two suffixes is found by binary search over equal prefix hashes; one byte then decides.
    """
    h = hashing()
    out = np.zeros(len(x), np.int8)
    open_ = np.flatnonzero(h.ranges(prefix, x, x + length) != h.ranges(prefix, y, y + length))
    a, b = x[open_], y[open_]
    same, differ = np.zeros(len(a), np.int64), np.full(len(a), length, np.int64)  # equal up to ``same``, not up to ``differ``
    while True:
        wide = differ - same > 1
        if not wide.any():
            break
        mid = (same + differ) >> 1
        equal = h.ranges(prefix, a, a + mid) == h.ranges(prefix, b, b + mid)
        same = np.where(wide & equal, mid, same)
        differ = np.where(wide & ~equal, mid, differ)
    out[open_] = np.where(data[a + same] < data[b + same], -1, 1)
    return out


def merge_sort(prefix: np.ndarray, data: np.ndarray, order: np.ndarray, base: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Sorts suffix starts ``order`` within segments (``base``, ``size`` of each element's segment), bottom up.

    Two sorted neighbours are merged by giving every element its rank in the other, a binary search of comparisons.
    """
    order = order.copy()
    width = 1
    place = np.arange(len(order))
    while True:
        live = size > width
        if not live.any():
            return order
        at, start, n = place[live], base[live], size[live]
        x, local = order[at], at - start
        block = local // (2 * width) * (2 * width)
        middle, end = np.minimum(block + width, n), np.minimum(block + 2 * width, n)
        left = local < middle
        other = np.where(left, middle, block)
        lo, hi = other.copy(), np.where(left, end, middle)
        passes = np.where(left, 0, -1)  # equal elements keep their order
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            right = compare(prefix, data, x[todo], order[start[todo] + mid], length) > passes[todo]
            lo[todo] = np.where(right, mid + 1, lo[todo])
            hi[todo] = np.where(right, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        order[start + block + (local - np.where(left, block, middle)) + (lo - other)] = x
        width *= 2


def repeated_windows(spans: list[bytes], group: np.ndarray, offset: np.ndarray, length: int) -> list[np.ndarray]:
    """For each span, which of its windows occurs in another span of its group.

    ``offset`` is the anchor's place in the span: equal windows have it at the same distance, so suffixes are first
    dealt by (group, distance) and their first eight bytes, and the rest is sorted by hash comparisons. Neighbours
    with a common extension of ``length`` are compared byte by byte before they count.
    """
    sizes = np.fromiter(map(len, spans), np.int64, len(spans))
    windows = sizes - length + 1
    data = np.frombuffer(b"".join(spans), np.uint8)
    prefix = hashing().prefixes(data)
    owner = np.repeat(np.arange(len(spans)), windows)
    first = np.concatenate(([0], np.cumsum(windows)))
    inside = np.arange(first[-1]) - first[:-1][owner]
    start = (np.cumsum(sizes) - sizes)[owner] + inside
    bucket = group[owner] * (length + 1) + (offset[owner] - inside)
    word = np.zeros(len(start), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | data[start + k]
    order = np.lexsort((word, bucket))
    new = np.ones(len(order), bool)
    new[1:] = (bucket[order][1:] != bucket[order][:-1]) | (word[order][1:] != word[order][:-1])
    bases = np.flatnonzero(new)
    lengths = np.diff(np.append(bases, len(order)))
    segment = np.cumsum(new) - 1
    tied = lengths[segment] > 1
    flag = np.zeros(len(start), bool)
    if tied.any():
        ids = order[tied]  # only suffixes that share bucket and first word with another
        seg = segment[tied]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = seg[1:] != seg[:-1]
        base = np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
        size = lengths[seg]
        starts = merge_sort(prefix, data, start[ids], base, size, length)
        window_at = np.full(len(data), -1, np.int64)
        window_at[start] = np.arange(len(start))
        ids = window_at[starts]
        near = np.flatnonzero(~fresh[1:])
        h = hashing()
        a, b = starts[near], starts[near + 1]
        equal = h.ranges(prefix, a, a + length) == h.ranges(prefix, b, b + length)
        near, a, b = near[equal], a[equal], b[equal]
        true = np.ones(len(a), bool)
        for k in range(length):
            true &= data[a + k] == data[b + k]
        flag[ids[near[true]]] = True
        flag[ids[near[true] + 1]] = True
        if not true.all():  # a hash collision: its bucket is settled by the bytes themselves
            for bad in np.unique(bucket[ids[near[~true]]]):
                members = np.flatnonzero(bucket == bad)
                seen: dict[bytes, list[int]] = {}
                for w in members.tolist():
                    seen.setdefault(data[start[w] : start[w] + length].tobytes(), []).append(w)
                for same in seen.values():
                    flag[same] = len(same) > 1
    return np.split(flag, first[1:-1])


def intervals(flags: np.ndarray) -> list[int]:
    """[first, last, first, last, ...] of the true stretches."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1).ravel().tolist()


# ---------------------------------------------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, a two-part document key (equal for repeated rows only) and the text's bytes."""
    return docs.select(*keep, F.xxhash64("doc_id").alias("__k1"), F.xxhash64("text").alias("__k2"), utf8("text").alias("__bytes"))


def _all_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per run: key, anchor hash g, span hash p, place (first window << 16 | windows - 1 << 8 | anchor offset)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for k, text in enumerate(batch.column(2)):
                first, last, anchor, g, p = runs(np.frombuffer(text.as_buffer(), np.uint8), length, gram)
                rows.append(np.full(len(first), k))
                parts.append((g.view(np.int64), p.view(np.int64), first << 16 | (last - first) << 8 | (anchor - first)))
            take = pa.array(np.concatenate(rows))
            columns = [pa.array(np.concatenate(x)) for x in zip(*parts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *columns], names=["k1", "k2", "g", "p", "place"]
            )

    return map_batches(_keyed(docs), find, "k1 bigint, k2 bigint, g bigint, p bigint, place bigint")


def _spans(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted(k1, k2, parts: array of (g, p, n, place, large)) -> (g, p, n, offset, span bytes, large) cut out of the documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [], [])
            for text, parts in zip(batch.column(0), batch.column(1)):
                data = memoryview(text.as_buffer())
                for part in parts.as_py():
                    first, more, offset = part["place"] >> 16, part["place"] >> 8 & 255, part["place"] & 255
                    for out, value in zip(columns, (part["g"], part["p"], part["n"], offset, bytes(data[first : first + more + length]), part["large"])):
                        out.append(value)
                if len(columns[0]) > 20_000:
                    yield emit(columns)
                    columns = ([], [], [], [], [], [])
            if columns[0]:
                yield emit(columns)

    def emit(columns: tuple[list, ...]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["g", "p", "n", "offset", "span", "large"])

    # repeated rows have one key: each is cut once
    once = _keyed(docs).groupBy("__k1", "__k2").agg(F.first("__bytes").alias("__bytes"))
    joined = once.join(wanted, (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2"))).select("__bytes", "parts")
    return map_batches(joined, cut, "g bigint, p bigint, n bigint, offset int, span binary, large boolean")


def _sorted_verdicts(spans: DataFrame, length: int, batch_bytes: int = 1 << 20) -> DataFrame:
    """spans of groups of bounded size -> (g, p, stretches of repeated windows)."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def settle(rows: pa.Table) -> pa.RecordBatch:
            g, p = rows.column("g").to_numpy(), rows.column("p").to_numpy()
            once = np.concatenate(([True], (g[1:] != g[:-1]) | (p[1:] != p[:-1])))  # repeated rows cut out the same span
            rows = rows.filter(pa.array(once)).combine_chunks()
            g = g[once]
            group = np.cumsum(np.concatenate(([0], g[1:] != g[:-1])))
            flags = repeated_windows(rows.column("span").to_pylist(), group, rows.column("offset").to_numpy().astype(np.int64), length)
            n = rows.column("n").to_numpy()
            found = [intervals(f | (k > 1)) for f, k in zip(flags, n)]
            return pa.RecordBatch.from_arrays(
                [rows.column("g").combine_chunks(), rows.column("p").combine_chunks(), pa.array(found, pa.list_(pa.int32()))],
                names=["g", "p", "stretches"],
            )

        size = 0
        for batch in batches:  # sorted by g
            for at in range(0, batch.num_rows, 2000):
                part = pa.Table.from_batches([batch.slice(at, 2000)])
                held.append(part)
                size += pa.compute.sum(pa.compute.binary_length(part.column("span"))).as_py()
                if size < batch_bytes:
                    continue
                rows = pa.concat_tables(held).combine_chunks()
                g = rows.column("g").to_numpy()
                keep = int(np.searchsorted(g, g[-1]))  # the last group may go on
                if keep:
                    yield settle(rows.slice(0, keep))
                held = [rows.slice(keep)]
                size = pa.compute.sum(pa.compute.binary_length(held[0].column("span"))).as_py()
        if held:
            yield settle(pa.concat_tables(held).combine_chunks())

    return map_batches(spans.repartition("g").sortWithinPartitions("g", "p"), decide, "g bigint, p bigint, stretches array<int>")


def _counted_verdicts(spans: DataFrame, length: int) -> DataFrame:
    """The same for groups of any size: each window by itself, dealt by two hashes of its bytes and its anchor distance."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                span = row["span"]
                count = len(span) - length + 1
                sums = [hashlib.blake2b(span[w : w + length], digest_size=16).digest() for w in range(count)]
                pairs = np.frombuffer(b"".join(sums), np.int64).reshape(-1, 2)
                fixed = [pa.array(np.full(count, row[c]), pa.int64()) for c in ("g", "p", "n")]
                w = np.arange(count)
                yield pa.RecordBatch.from_arrays(
                    [*fixed, pa.array(w), pa.array(row["offset"] - w), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())],
                    names=["g", "p", "n", "w", "distance", "h1", "h2"],
                )

    each = map_batches(spans, windows, "g bigint, p bigint, n bigint, w bigint, distance bigint, h1 bigint, h2 bigint")
    same = ["g", "distance", "h1", "h2"]
    twice = each.groupBy(*same).agg(F.sum("n").alias("all")).where("all > 1")
    hit = each.join(twice, same).groupBy("g", "p").agg(F.array_sort(F.collect_set(F.col("w").cast("int"))).alias("ws"))
    return hit.select("g", "p", F.flatten(F.transform("ws", lambda w: F.array(w, w))).alias("stretches"))


def repeated_bytes(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), length: int = 200, gram: int = 40, group_limit: int = 20_000) -> DataFrame:
    """docs(doc_id, text) -> ``keep``, ``__bytes`` (UTF-8 of the text) and ``__found``: places and stretches of repeated windows.

    A byte belongs to a repeated string if a ``length``-byte string that covers it also starts anywhere else, in any row of
    the table (repeated rows are documents of their own) or in the same text. Null text is empty; a text shorter than
    ``length`` repeats nothing; an empty table gives an empty result. Only doc_id, text and ``keep`` are read. A length
    of more than 256 is refused, as a run's place holds its windows and its anchor in a byte each.
    """
    if not gram <= length <= 256:
        raise ValueError("length must be at least gram and at most 256")
    found = _all_runs(docs, length, gram)
    # written, so that the join below reads two plain exchanges, of which Spark can split a hot anchor's side
    groups = stored(
        found.groupBy("g").agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high")).where("n > 1"), "repeats-anchors"
    )
    # an anchor met once marks no repeat; one whose spans are all equal marks them whole; the others are looked into
    flagged = stored(
        found.join(groups.select("g", (F.col("low") != F.col("high")).alias("mixed")), "g").select("k1", "k2", "g", "p", "place", "mixed"),
        "repeats-runs",
    )
    mixed = flagged.where("mixed")
    distinct = stored(
        mixed.groupBy("g", "p").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("at")), "repeats-distinct"
    )
    # few rows: at most one in ``group_limit`` of the distinct runs
    large = stored(distinct.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") > group_limit).select("g"), "repeats-large")
    sized = distinct.join(large.withColumn("hot", F.lit(True)), "g", "left").withColumn("large", F.coalesce("hot", F.lit(False)))
    wanted = sized.groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("g", "p", "n", "at.place", "large")).alias("parts"))
    spans = stored(_spans(docs, wanted, length), "repeats-spans")
    verdicts = stored(
        _sorted_verdicts(spans.where("NOT large").drop("large"), length).unionByName(
            _counted_verdicts(spans.where("large").drop("large").dropDuplicates(["g", "p"]), length)
        ),
        "repeats-verdicts",
    )
    whole = flagged.where("NOT mixed").select("k1", "k2", "place", F.lit(None).cast("array<int>").alias("stretches"))
    partly = mixed.join(verdicts, ["g", "p"]).where(F.size("stretches") > 0).select("k1", "k2", "place", "stretches")
    by_doc = whole.unionByName(partly).groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "stretches")).alias("__found"))
    by_doc = by_doc.withColumnsRenamed({"k1": "__of1", "k2": "__of2"})
    rows = _keyed(docs, keep)
    return rows.join(by_doc, (F.col("__k1") == F.col("__of1")) & (F.col("__k2") == F.col("__of2")), "left").select(*keep, "__bytes", "__found")


def removed_ranges(size: int, found: list[dict] | None, length: int) -> np.ndarray:
    """(start, stop) of the maximal removed stretches, one row each."""
    if not found:
        return np.empty((0, 2), np.int64)
    edge = np.zeros(size + 1, np.int64)
    for item in found:
        first, more = item["place"] >> 16, item["place"] >> 8 & 255
        stretches = item["stretches"] or [0, more]
        for a, b in zip(stretches[::2], stretches[1::2]):
            edge[first + a] += 1
            edge[first + b + length] -= 1
    covered = np.concatenate(([False], np.cumsum(edge) > 0))
    change = np.flatnonzero(np.diff(covered))
    return change.reshape(-1, 2)


def digest(docs: DataFrame, length: int = 200, gram: int = 40, group_limit: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1), batch.column(2)):
                data = memoryview(text.as_buffer())
                cut = removed_ranges(len(data), found.as_py(), length)
                kept = hashlib.sha256()
                at = 0
                for a, b in cut.tolist():
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                rows.append((len(data), int((cut[:, 1] - cut[:, 0]).sum()), len(cut), kept.hexdigest()))
            columns = list(zip(*rows)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        repeated_bytes(docs, ("doc_id",), length, gram, group_limit),
        count,
        f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    )


def without_repeats(docs: DataFrame, length: int = 200, gram: int = 40, group_limit: int = 20_000) -> DataFrame:
    """docs with repeated bytes cut out of ``text`` (a character cut in part goes whole), n_chars following.

    All rows and columns come back; a text of which nothing is cut is unchanged, null text stays null.
    """
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(0), batch.column(1)):
                data = memoryview(text.as_buffer())
                parts, at = [], 0
                for a, b in removed_ranges(len(data), found.as_py(), length).tolist():
                    parts.append(bytes(data[at:a]).decode("utf-8", "ignore"))
                    at = b
                parts.append(bytes(data[at:]).decode("utf-8", "ignore"))
                texts.append("".join(parts))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string())], names=[*rest, "text"])

    rest = [c for c in names if c != "text"]
    rows = repeated_bytes(docs.withColumn("__null", F.col("text").isNull()), (*rest, "__null"), length, gram, group_limit)
    same = rows.where("__found IS NULL").select(*rest, F.when(~F.col("__null"), F.col("__bytes").cast("string")).alias("text"))
    changed = rows.where("__found IS NOT NULL").select("__bytes", "__found", *rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema.fields) + ", text string"
    done = map_batches(changed, cut, schema)
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return same.unionByName(done).select(*names)
