"""SimHash near-duplicates: 64-bit fingerprints joined with themselves on a binary trie.

1. Fingerprint of a text: ASCII lower case, words, ``shingle`` -word shingles with repeats; a bit is set
   if it is set in more than half of the shingles' XXH64 values.
2. Distinct fingerprints only go on. With at most ``distance`` differing bits, one of ``distance + 1``
   equal-width bit blocks is equal, so a fingerprint is dealt once per block, keyed by (block, its bits),
   with that block rotated to the top.
3. Each bucket is a binary trie (its sorted fingerprints; a node is a range of them). The self-join walks
   pairs of nodes from (root, root): a pair's children share the next bit or differ in it, differing adds
   one to the pair's error, and a pair is pruned when its error exceeds the budget. Found pairs are merged
   at once into the bucket's groups; one edge per fingerprint leaves the task, never all pairs.
4. A bucket above ``bucket_limit`` fingerprints is dealt anew by the same rule on its remaining bits
   (one block more of them must agree), so no task gets an unbounded bucket.
5. Connected components over the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomark.llm.common import map_batches, stored, utf8
from anomark.llm.components import connected_components

SEED = 42
PAIRS_AT_ONCE = 1 << 20


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit fingerprint of UTF-8 bytes; no word: 0; fewer words than ``shingle``: the whole sequence is one shingle."""
    words = text.lower().split()  # bytes: lower() is A-Z only, split() cuts at \x20 \x09-\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist())),
            np.uint64,
            len(starts),
        )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",), out: str = "fp") -> DataFrame:
    """``keep`` columns and the fingerprint of ``text`` (null: no words) as a signed 64-bit long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            values = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values.view(np.int64))], names=[*keep, out])

    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + f", `{out}` bigint"
    return map_batches(docs.select(*keep, utf8("text").alias("__text")), run, schema)


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union the groups of i[k] and j[k]; ``label`` stays fully compressed (each group's least index)."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def trie_self_join(bucket: np.ndarray, value: np.ndarray, bits: int, distance: int) -> np.ndarray:
    """Group label (least index) of each row, where rows of a bucket within ``distance`` bits are linked.

    Rows are sorted by (bucket, value) and distinct; ``value`` uses its low ``bits`` bits.
    """
    n = len(value)
    label = np.arange(n)
    if n < 2:
        return label
    ones: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((value >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        return hi - (ones[bit][hi] - ones[bit][lo])

    cut = np.flatnonzero(np.diff(bucket)) + 1
    lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [n]))
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    # node pairs still to visit: (bit to look at, ranges of both nodes, bits that differ above it)
    stack = [(bits - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        bit, lo1, hi1, lo2, hi2, err = stack.pop()
        if len(lo1) > PAIRS_AT_ONCE:
            half = len(lo1) // 2
            stack += [(bit, *(x[:half] for x in (lo1, hi1, lo2, hi2, err))), (bit, *(x[half:] for x in (lo1, hi1, lo2, hi2, err)))]
            continue
        leaf = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        if leaf.any():
            i, j = lo1[leaf], lo2[leaf]
            near = np.bitwise_count(value[i] ^ value[j]) <= distance
            _merge(label, i[near], j[near])
            lo1, hi1, lo2, hi2, err = (x[~leaf] for x in (lo1, hi1, lo2, hi2, err))
        if not len(lo1):
            continue
        mid1, mid2 = split(lo1, hi1, bit), split(lo2, hi2, bit)
        own = lo1 == lo2
        nxt = []
        for a_lo, a_hi, b_lo, b_hi, extra, use in (
            (lo1, mid1, lo2, mid2, 0, None),
            (mid1, hi1, mid2, hi2, 0, None),
            (lo1, mid1, mid2, hi2, 1, None),
            (mid1, hi1, lo2, mid2, 1, ~own),
        ):
            e = err + extra
            ok = (a_hi > a_lo) & (b_hi > b_lo) & (e <= distance)
            ok &= ~((a_lo == b_lo) & (a_hi - a_lo == 1))  # a row with itself
            if use is not None:
                ok &= use
            nxt.append(tuple(x[ok] for x in (a_lo, a_hi, b_lo, b_hi, e)))
        joined = tuple(np.concatenate(x) for x in zip(*nxt))
        if len(joined[0]):
            stack.append((bit - 1, *joined))
    return label


def _block_bounds(bits: int, blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of ``blocks`` nearly equal blocks that cover ``bits`` low bits."""
    edge = [bits * k // blocks for k in range(blocks + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edge, edge[1:])]


def _dealt(rows: DataFrame, bits: int, distance: int) -> DataFrame:
    """rows(path string, rest long, fp long) -> one row per block: the block's bits go to ``path``, the others stay in ``rest``."""
    options = []
    for shift, width in _block_bounds(bits, distance + 1):
        low_mask, block_mask = (1 << shift) - 1, (1 << width) - 1
        high = F.shiftrightunsigned("rest", shift + width) if shift + width < 64 else F.lit(0).cast("long")
        block = F.shiftrightunsigned("rest", shift).bitwiseAND(F.lit(block_mask))
        rest = F.shiftleft(high, shift).bitwiseOR(F.col("rest").bitwiseAND(F.lit(low_mask)))
        options.append(F.struct(F.concat("path", F.lit(f"/{shift}:"), F.hex(block)).alias("path"), rest.alias("rest")))
    return rows.select("fp", F.explode(F.array(*options)).alias("o")).select("o.path", "o.rest", "fp")


def trie_edges(distinct: DataFrame, distance: int = 3, bucket_limit: int = 50_000) -> DataFrame:
    """distinct(fp long, no repeats) -> edges(u, v) that connect all fingerprints within ``distance`` bits."""

    def run(width: int):
        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def flush(rows: pa.Table) -> pa.RecordBatch:
                rows = rows.combine_chunks()
                codes = rows.column("path").combine_chunks().dictionary_encode()
                codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
                b = codes.indices.to_numpy(zero_copy_only=False)
                rest = rows.column("rest").to_numpy().view(np.uint64)
                fp = rows.column("fp").to_numpy()
                order = np.lexsort((rest, b))
                label = trie_self_join(b[order], rest[order], width, distance)
                fp = fp[order]
                linked = label != np.arange(len(label))
                return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], names=["u", "v"])

            for batch in batches:  # sorted by path: hold the last, perhaps unfinished, bucket back
                if not batch.num_rows:
                    continue
                held.append(batch)
                if sum(x.num_rows for x in held) < 200_000:
                    continue
                rows = pa.Table.from_batches(held)
                paths = rows.column("path")
                last = paths[len(paths) - 1].as_py()
                keep = int(pa.compute.index(paths, last).as_py())
                if keep:
                    yield flush(rows.slice(0, keep))
                held = rows.slice(keep).to_batches()
            if held:
                yield flush(pa.Table.from_batches(held))

        return join

    edges = None
    rows, bits = distinct.select(F.lit("").alias("path"), F.col("fp").alias("rest"), "fp"), 64
    while True:
        width = max(w for _, w in _block_bounds(bits, distance + 1))
        dealt = _dealt(rows, bits, distance)
        bits -= min(w for _, w in _block_bounds(bits, distance + 1))
        sizes = dealt.groupBy("path").agg(F.count("*").alias("n"))
        splittable = bits >= 2 * (distance + 1)
        usual = sizes.where((F.col("n") > 1) & ((F.col("n") <= bucket_limit) | F.lit(not splittable))).select("path")
        part = map_batches(
            dealt.join(usual, "path").repartition("path").sortWithinPartitions("path"), run(bits), "u bigint, v bigint"
        )
        edges = part if edges is None else edges.unionAll(part)
        if not splittable:
            return edges
        hot = stored(sizes.where(F.col("n") > bucket_limit).select("path"), "simhash-hot")
        if hot.isEmpty():
            return edges
        rows = stored(dealt.join(hot, "path"), "simhash-split")


def simhash_components(docs: DataFrame, shingle: int = 3, distance: int = 3, bucket_limit: int = 50_000) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp long, component_id): the least doc_id linked, directly or through others.

    Null text has no words (fingerprint 0). A row with null doc_id is a document like any other; a component
    of only such rows has a null component_id. Repeated rows come back as often as they came. An empty table
    gives an empty result. Columns other than doc_id and text are not read.
    """
    rows = stored(fingerprints(docs, shingle), "simhash-fp")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected_components(trie_edges(distinct.select("fp"), distance, bucket_limit))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3, bucket_limit: int = 50_000) -> DataFrame:
    """One document of each SimHash component, with all its columns: the one with the least doc_id.

    Null doc_ids count after all others. Rows of equal doc_id (repeated rows) are told apart by the hash of all
    their columns and, where that is equal too, any one of the equal rows is kept. The component of texts without
    a word keeps one row like any other. Column names that start with ``__`` are the operator's own.
    """
    names = docs.columns
    keyed = docs.withColumn("__row", F.xxhash64(*names))
    rows = stored(fingerprints(keyed, shingle, keep=("doc_id", "__row"), out="__fp"), "simhash-fp")
    distinct = stored(rows.select(F.col("__fp").alias("fp")).distinct(), "simhash-distinct")
    roots = connected_components(trie_edges(distinct, distance, bucket_limit))
    named = rows.join(roots.withColumnRenamed("node", "__fp"), "__fp", "left").withColumn("__root", F.coalesce("root", "__fp"))
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("__row").alias("c"))
    first = named.groupBy("__root").agg(F.min(order).alias("__first")).select(
        F.col("__first.b").alias("__id"), F.col("__first.c").alias("__row")
    )
    same = keyed["doc_id"].eqNullSafe(first["__id"]) & (keyed["__row"] == first["__row"])
    chosen = keyed.join(first, same, "left_semi")
    return chosen.dropDuplicates(["doc_id", "__row"]).select(*names)
