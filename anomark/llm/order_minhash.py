"""Order MinHash: fingerprints that are sensitive to edit distance, not only to shared content.

A k-mer (k code points) is numbered by its occurrence in the text, so repeats are different elements. For each of
``slots`` permutations the ``picks`` least elements are selected, put back in text order, and the tuple of their
k-mers is hashed. Two texts share a slot only if the same elements win and stand in the same order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anomark.llm.common import map_batches, stored, task_count

ODD = np.uint64(0x9E3779B97F4A7C15)
LATE = np.uint32(0xFFFFFFFF)
CHUNK = 8192


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k-mer at each position; a shorter text is one k-mer, an empty one has none."""
    if not len(codes):
        return np.empty(0, np.uint64)
    width = min(k, len(codes))
    n = len(codes) - width + 1
    # strings of 1, 2, 4, ... code points, and of those the ones that add up to ``width``
    part, size, factor = codes.astype(np.uint64) + np.uint64(1), 1, ODD
    h, have = np.full(n, width, np.uint64), 0
    while True:
        if width & size:
            h = h * factor + part[have : have + n]
            have += size
        if 2 * size > width:
            return _mix(h)
        part = part[:-size] * factor + part[size:]
        size, factor = 2 * size, np.multiply(factor, factor)


def occurrences(h: np.ndarray) -> np.ndarray:
    """0 for the first of equal k-mers in the text, 1 for the next, and so on."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = s[1:] != s[:-1]
    place = np.arange(len(s))
    out = np.empty(len(s), np.uint64)
    out[order] = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return out


class Sketcher:
    def __init__(self, k: int, picks: int, slots: int):
        self.k, self.picks, self.slots = k, picks, slots
        self.factor = (np.random.default_rng(7).integers(0, 2**31, slots, dtype=np.uint32) << np.uint32(1) | np.uint32(1))[:, None]
        self.rows = np.arange(slots)

    def least(self, h: np.ndarray, occurrence: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
        """(value, position, k-mer), each slots x picks, of the least elements per permutation; position -1: none."""
        element = (_mix(h + (occurrence + np.uint64(1)) * ODD) >> np.uint64(32)).astype(np.uint32)
        value, place = np.empty((self.slots, 0), np.uint32), np.empty((self.slots, 0), np.int64)
        for c in range(0, len(element), CHUNK):
            v = element[c : c + CHUNK] * self.factor
            for _ in range(min(self.picks, v.shape[1])):
                i = v.argmin(axis=1)
                value, place = np.hstack((value, v[self.rows, i][:, None])), np.hstack((place, (i + c)[:, None]))
                v[self.rows, i] = LATE
            if c:
                value, place = self.merge(value, place)
        if value.shape[1] < self.picks:
            lack = self.picks - value.shape[1]
            value = np.hstack((value, np.full((self.slots, lack), LATE, np.uint32)))
            place = np.hstack((place, np.full((self.slots, lack), -1, np.int64)))
        mer = np.where(place >= 0, h[np.maximum(place, 0)] if len(h) else np.uint64(0), np.uint64(0))
        return value, np.where(place >= 0, place + at, -1), mer

    def merge(self, value: np.ndarray, place: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
        """The ``picks`` least per row; real ones before empty ones, earlier ones first of equals."""
        far = np.where(place >= 0, place, np.int64(1) << np.int64(40)).astype(np.uint64)
        best = np.argsort(value.astype(np.uint64) << np.uint64(32) | np.minimum(far, np.uint64(0xFFFFFFFF)), axis=1, kind="stable")[:, : self.picks]
        return tuple(np.take_along_axis(x, best, axis=1) for x in (value, place, *more))

    def signature(self, *parts: tuple[np.ndarray, ...]) -> bytes:
        """16 bits per slot from the least elements of all parts, k-mers in text order."""
        value, place, mer = (np.hstack(x) for x in zip(*parts))
        _, place, mer = self.merge(value, place, mer)
        order = np.argsort(place, axis=1, kind="stable")
        mer = np.take_along_axis(mer, order, axis=1)
        h = np.full(self.slots, 11, np.uint64)
        for j in range(self.picks):
            h = _mix(h * ODD + mer[:, j])
        return (h >> np.uint64(48)).astype("<u2").tobytes()

    def whole(self, codes: np.ndarray) -> bytes:
        h = kmers(codes, self.k)
        return self.signature(self.least(h, occurrences(h), 0))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def edited(text: str, following: str) -> str:
    """The last floor(n/3) code points replaced by the first as many (or all) of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


class Document:
    """A text with its fingerprint and the parts of it that its edited text shares."""

    def __init__(self, text: str, sketcher: Sketcher):
        self.text, self.sketcher = text, sketcher
        codes = codes_of(text)
        h = kmers(codes, sketcher.k)
        occurrence = occurrences(h)
        stay = len(codes) - len(codes) // 3 - sketcher.k + 1  # k-mers that lie in the unchanged part
        self.stay = stay if stay > 0 else 0
        self.front = sketcher.least(h[: self.stay], occurrence[: self.stay], 0)
        self.kept = h[: self.stay]
        self.fingerprint = sketcher.signature(self.front, sketcher.least(h[self.stay :], occurrence[self.stay :], self.stay))

    def edited_fingerprint(self, following: str) -> bytes:
        text = edited(self.text, following)
        if not self.stay:
            return self.sketcher.whole(codes_of(text))
        tail = kmers(codes_of(text[self.stay :]), self.sketcher.k) if len(text) - self.stay >= self.sketcher.k else np.empty(0, np.uint64)
        seen = np.sort(self.kept)
        before = np.searchsorted(seen, tail, "right") - np.searchsorted(seen, tail, "left")
        return self.sketcher.signature(
            self.front, self.sketcher.least(tail, occurrences(tail) + before.astype(np.uint64), self.stay)
        )


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal slots."""
    return float((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).mean())


def fingerprints(docs: DataFrame, k: int = 10, picks: int = 2, slots: int = 64) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fingerprint as hexadecimal). Null text is empty; all empty texts are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(k, picks, slots)
        for batch in batches:
            found = [sketcher.whole(codes_of(t.as_py())).hex() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, f"doc_id {kind}, fingerprint string")


def edited_pairs(docs: DataFrame, k: int = 10, picks: int = 2, slots: int = 64) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next lower doc_id; after the last comes the first. Null doc_ids come last, equal
    doc_ids are ordered by their texts' hash, and equal rows follow each other. Null text is empty. A single row is its own
    next. An empty table gives an empty result. Other columns are not read.

    The texts are range-dealt once by descending doc_id and read in order, one document held at a time. Only each
    range's last document is left open; it is settled with the first of the next range that has any.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "open", "text"]
    schema = (
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary,"
        " near_edited double, near_next double, part int, open string, text string"
    )

    def compared(this: Document, following: str, next_fingerprint: bytes) -> tuple:
        other = this.edited_fingerprint(following)
        sha = hashlib.sha256(edited(this.text, following).encode()).hexdigest()
        return len(this.text), sha, this.fingerprint, other, likeness(this.fingerprint, other), likeness(this.fingerprint, next_fingerprint)

    def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(k, picks, slots)
        part = TaskContext.get().partitionId()
        last_id, last = None, None
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                this = Document(text.as_py(), sketcher)
                if last is None:
                    rows.append((doc_id.as_py(), None, None, None, None, None, None, part, "first", this.text))
                else:
                    rows.append((last_id, *compared(last, this.text, this.fingerprint), part, None, None))
                last_id, last = doc_id.as_py(), this
            if rows:
                yield batch_of(rows, kind)
        if last is not None:
            yield batch_of([(last_id, None, None, None, None, None, None, part, "last", last.text)], kind)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(k, picks, slots)
        for batch in batches:
            rows = []
            for doc_id, text, following in zip(*batch.columns):
                this = Document(text.as_py(), sketcher)
                done = compared(this, following.as_py(), sketcher.whole(codes_of(following.as_py())))
                rows.append((doc_id.as_py(), *done, None, None, None))
            if rows:
                yield batch_of(rows, batch.schema.field(0).type)

    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = texts.repartitionByRange(task_count(docs.sparkSession), *order).sortWithinPartitions(*order)
    found = stored(map_batches(dealt, run, schema), "order-minhash")
    # one row per range that has documents: a short table of numbers, then a join for the texts
    parts = found.where("open = 'first'").select("part")
    by = Window.orderBy("part")
    following = parts.select("part", F.lead("part").over(by).alias("after"), F.min("part").over(Window.partitionBy()).alias("least"))
    after = following.select("part", F.coalesce("after", "least").alias("after"))
    heads = found.where("open = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))
    tails = found.where("open = 'last'").select("part", "doc_id", "text").join(after, "part").join(heads, "after")
    closed = map_batches(tails.select("doc_id", "text", "following"), settle, schema)
    every = found.where("open IS NULL").unionByName(closed)
    return every.select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
