"""Hard negatives by a secondary-sort shuffle: every anchor's scores arrive sorted and are read once.

Rows are dealt to blocks of about ``block_rows`` by a hash of their id; every anchor goes to every block, and a block's
task streams the anchors past its rows, a matrix product at a time. Two passes share that layout:

1. positives: each block gives an anchor's best ``positives`` rows of its label, which suffice to know the best of all;
2. negatives: with the positives known, each block gives the first ``negatives`` rows of each positive's window.

Both end in the same shuffle: a score is packed into the key (anchor, descending score, positive before negative, id),
rows are dealt by the anchor and sorted by the key inside a partition, and an iterator reads on. A positive opens its
window, a negative inside an open window is given out, and only the windows of the current anchor are held. What an
anchor sends is at most positives * (negatives + 1) rows a block, however many rows share its label or score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomark.llm.common import map_batches, stored

LARGEST = 1 << 24
ANCHORS_AT_ONCE = 256
KEY = "anchor bigint, descending bigint, kind int, id bigint"


def items(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vectors(vec_id, label, embedding) -> (vec_id long, label int, q array<bigint>): components become floor(scale * x).

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part. Rows of equal vec_id are one
    item: the least (label, vector) stands for it. A component beyond +-2^24 after scaling counts as that bound.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    bound = F.lit(float(LARGEST))
    scaled = F.transform(
        "embedding",
        lambda x: F.floor(F.greatest(-bound, F.least(bound, x.cast("double") * F.lit(float(scale))))).cast("bigint"),
    )
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"), scaled.alias("q"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r"))
    return one.select("vec_id", "r.label", "r.q")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, filled with zeros up to ``width`` components."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact integer inner products, anchors by rows; vectors of unequal length are filled with zeros."""
    width = max(rows.shape[1], anchors.shape[1])
    rows, anchors = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (rows, anchors))
    if not width:
        return np.zeros((len(anchors), len(rows)), np.int64)
    largest = int(np.abs(rows).max(initial=0)) * int(np.abs(anchors).max(initial=0)) * width
    if largest < 1 << 53:
        return (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return anchors @ rows.T


def _first(places: np.ndarray, score: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` places of highest score, ties by the smaller place."""
    if len(places) <= count:
        return places
    got = score[places]
    least = np.partition(got, len(got) - count)[len(got) - count]
    above, equal = places[got > least], places[got == least]
    return np.concatenate((above, equal[: count - len(above)]))


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest integer score s with low * positive <= 100 * s <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def _blocks(pick):
    """Stream of (block, kind, vec_id, label, q, windows) sorted by (block, kind, vec_id): the rows of a block, then its anchors.

    ``pick(score, labels, ids, anchor id, anchor label, anchor's windows)`` -> places to give out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready = None, [], None

        def close() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            width = max((int(np.diff(b.column("q").offsets.to_numpy()).max(initial=0)) for b in held), default=0)
            return (
                np.concatenate([_matrix(b.column("q"), width) for b in held]),
                np.concatenate([b.column("label").to_numpy() for b in held]),
                np.concatenate([b.column("vec_id").to_numpy() for b in held]),
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            where = batch.column("block").to_numpy() * 2 + batch.column("kind").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(np.diff(where)) + 1, [len(where)]))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                now, kind = divmod(int(where[lo]), 2)
                if now != block:
                    block, held, ready = now, [], None
                part = batch.slice(lo, hi - lo)
                if kind == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                ready = ready or close()
                matrix, labels, ids = ready
                for at in range(0, hi - lo, ANCHORS_AT_ONCE):
                    piece = part.slice(at, ANCHORS_AT_ONCE)
                    q = piece.column("q")
                    score = _scores(matrix, _matrix(q, int(np.diff(q.offsets.to_numpy()).max(initial=0))))
                    found = [
                        pick(s, labels, ids, a, label, positive)
                        for s, a, label, positive in zip(
                            score, piece.column("vec_id").to_pylist(), piece.column("label").to_pylist(), piece.column("scores").to_pylist()
                        )
                    ]
                    counts = [len(x) for x in found]
                    if not sum(counts):
                        continue
                    places = np.concatenate(found)
                    which = np.repeat(np.arange(len(found)), counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(piece.column("vec_id").to_numpy()[which]), pa.array(-score[which, places]), pa.array(ids[places])],
                        names=["anchor", "descending", "id"],
                    )

    return run


def _streamed(rows: DataFrame, anchors: DataFrame, pick, blocks: int) -> DataFrame:
    """(anchor, descending, id): what ``pick`` chooses of every block for every anchor(vec_id, label, q, scores)."""
    dealt = rows.select(
        F.expr(f"pmod(xxhash64(vec_id), {blocks})").cast("int").alias("block"),
        F.lit(0).alias("kind"), "vec_id", "label", "q", F.lit(None).cast("array<bigint>").alias("scores"),
    )
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "label", "q", "scores")
    cells = dealt.unionAll(sent).repartition(blocks, "block").sortWithinPartitions("block", "kind", "vec_id")
    return map_batches(cells, _blocks(pick), "anchor bigint, descending bigint, id bigint")


def _secondary_sort(keys: DataFrame) -> DataFrame:
    """(anchor, key) dealt by anchor and sorted by key inside each partition."""
    return keys.select("anchor", F.struct("anchor", "descending", "kind", "id").alias("key")).repartition("anchor").sortWithinPartitions("key")


def _read_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int]]:
    for batch in batches:
        yield from zip(*(x.to_pylist() for x in batch.column("key").flatten()))


def _emitter(schema: list[str], types: list[pa.DataType], read, size: int = 50_000):
    """A task that gathers the tuples of ``read(keys)`` to batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema)
        for row in read(_read_keys(batches)):
            out.append(row)
            if len(out) >= size:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    return run


def hard_negatives(
    vectors: DataFrame,
    is_anchor: str,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    block_rows: int = 8192,
) -> DataFrame:
    """vectors(vec_id, label, embedding) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a SQL condition on vec_id and label. An anchor's positives are its ``positives`` best other rows of its
    label; for each, the first ``negatives`` rows of another label with low % to high % of the positive's score (a positive with a
    score below 0 has none). Higher scores come first, ties by smaller id. See ``items`` for nulls, non-finite and repeated rows;
    shorter vectors count as filled with zeros. Without anchors or rows the result is empty; other columns are not read.
    """
    rows = stored(items(vectors, scale), "negatives-items")
    blocks = max(1, -(-rows.count() // block_rows))
    anchors = rows.where(is_anchor).withColumn("scores", F.lit(None).cast("array<bigint>"))

    def same(score, labels, ids, anchor, label, _):
        return _first(np.flatnonzero((labels == label) & (ids != anchor)), score, positives)

    def hard(score, labels, ids, anchor, label, found):
        other, places = labels != label, []
        for p in set(found):
            lo, hi = window(p, low, high)
            places.append(_first(np.flatnonzero(other & (score >= lo) & (score <= hi)), score, negatives))
        return np.unique(np.concatenate(places))

    def best(keys):
        anchor, n = None, 0
        for a, descending, _, i in keys:
            anchor, n = a, n + 1 if a == anchor else 1
            if n <= positives:
                yield a, descending, 0, i

    def opened(keys):
        anchor, windows = None, []
        for a, descending, kind, i in keys:
            if a != anchor:
                anchor, windows = a, []
            if kind == 0:
                windows.append([*window(-descending, low, high), 0, i, -descending])
                continue
            for w in windows:
                if w[0] <= -descending <= w[1] and w[2] < negatives:
                    w[2] += 1
                    yield a, w[3], w[2], i, w[4], -descending

    long, key_types = pa.int64(), [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    nearest = _streamed(rows, anchors, same, blocks).withColumn("kind", F.lit(0))
    chosen = stored(
        map_batches(_secondary_sort(nearest), _emitter(["anchor", "descending", "kind", "id"], key_types, best), KEY), "negatives-positives"
    )
    scores = chosen.groupBy(F.col("anchor").alias("vec_id")).agg(F.collect_list(-F.col("descending")).alias("scores"))
    windowed = anchors.drop("scores").join(scores, "vec_id").select("vec_id", "label", "q", "scores")
    candidates = _streamed(rows, windowed, hard, blocks).withColumn("kind", F.lit(1)).select("anchor", "descending", "kind", "id")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    types = [long, long, pa.int32(), long, long, long]
    schema = ", ".join(f"{n} {'int' if n == 'rank' else 'bigint'}" for n in names)
    return map_batches(_secondary_sort(chosen.unionByName(candidates)), _emitter(names, types, opened), schema)
