"""Cross-entropy difference: how much more a document looks like the target than like the background.

Two interpolated bigram models, one of the target documents and one of all documents, have the same vocabulary (every
word of all documents, unless a caller limits it) and the same smoothing. A document's score is the mean over its tokens of the loss under the target model minus the loss under
the background model: the lower, the closer to the target.

1. A task numbers the words of about ``HELD_TOKENS`` tokens at a time and writes this chunk once: its words, and its
   documents as word numbers. All that follows is made from the chunks, whatever task is run again.
2. Words: a chunk sends each of its words to the word's bucket, which gives it a number in the corpus, frequent words the
   small ones, and answers the chunk.
3. Counts: a chunk sends each (context, word) pair, and each word alone, once as corpus numbers with its counts to a bucket
   and has its counts in all other chunks back. So a word or pair that every document has is one entry a chunk, and both models
   are tables of exact counts that grow with the input.
4. A chunk has now the counts of all its pairs, contexts and words and sums the losses of its documents in token order.

What is sent is one row per chunk and bucket, with whole numbers as compressed columns. The number of buckets grows with
the input, so that a bucket has about as many entries at every size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomark.llm.common import map_batches, stored, task_count, utf8

HELD_WORDS = 300_000
HELD_TOKENS = 2_000_000
# Entries of a bucket: about so many words, so many pairs.
BUCKET_WORDS = 250_000
BUCKET_PAIRS = 1_000_000
# No word is empty or has white space.
START, REST = b"", b"\t"
HASHES = (1 << 32) - 1
CODEC = "zstd", 3
# Kinds of rows that meet at a chunk, in the order in which they are read.
CHUNK, TARGETS, WORDS, COUNTS = range(4)


def word_key(word: bytes) -> bytes:
    """A word as it is, or a 128-bit hash of a long one, after a byte that no word has."""
    return word if len(word) <= 16 else b"\n" + hashlib.blake2b(word, digest_size=16).hexdigest().encode()


def word_counts(docs: DataFrame) -> DataFrame:
    """(key of the word, n) over all documents; words are split at ASCII white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(map(word_key, text.as_py().split()))
                if len(held) > HELD_WORDS:
                    yield batch_of(held)
                    held.clear()
        if held:
            yield batch_of(held)

    def batch_of(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    return map_batches(docs.select(utf8("text").alias("text")), run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, most: int, cuts: int = 64) -> int:
    """The least count c for which at most ``most`` words have c or more: words of one count are in or out together.

    A search by ``cuts`` numbers at a time; each round is one aggregate over the counts.
    """
    low, high = 1, (counts.agg(F.max("n")).first()[0] or 0) + 1
    while low < high:
        tried = sorted({low + (high - low) * k // cuts for k in range(cuts)})
        found = counts.agg(*(F.sum((F.col("n") >= c).cast("long")).alias(f"c{k}") for k, c in enumerate(tried))).first()
        fits = [c for k, c in enumerate(tried) if (found[k] or 0) <= most]
        if fits:
            high = fits[0]
        low = max([c + 1 for c in tried if c < high], default=low)
    return high


def buckets(ids: np.ndarray) -> np.ndarray:
    """One number for each pair of neighbours; different pairs have different numbers (ids are below 2^31)."""
    return ids[:-1].astype(np.int64) << 32 | ids[1:].astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers of 0 and more as compressed planes of their bytes."""
    planes = np.asarray(values).astype("<u8").view(np.uint8).reshape(-1, 8).T
    width = 8 - int(np.argmax(planes.any(axis=1)[::-1])) if planes.any() else 0
    body = pa.Codec(*CODEC).compress(np.ascontiguousarray(planes[:width]).tobytes(), asbytes=True) if width else b""
    return len(values).to_bytes(8, "little") + bytes([width]) + body


def unpacked(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    planes = np.zeros((n, 8), np.uint8)
    if width:
        body = pa.Codec(*CODEC).decompress(data[9:], n * width, asbytes=True)
        planes[:, :width] = np.frombuffer(body, np.uint8).reshape(width, n).T
    return planes.view("<u8").ravel().astype(np.int64)


def packed_words(words: list[bytes]) -> bytes:
    return packed(np.frombuffer(b" ".join(words), np.uint8))


def unpacked_words(data: bytes) -> list[bytes]:
    return unpacked(data).astype(np.uint8).tobytes().split(b" ")


class Numbers(dict):
    """word -> its number among the words of a chunk; words with keys outside ``known`` (None: no limit) are one word."""

    def __init__(self, known: frozenset[bytes] | None):
        self.known = known
        self.of = {START: 0}

    def __missing__(self, word: bytes) -> int:
        key = word_key(word)
        number = self.of.setdefault(key if self.known is None or key in self.known else REST, len(self.of))
        if len(word) <= 64:
            self[word] = number
        return number


CHUNK_NAMES = ["chunk", "doc", "doc_id", "n_tokens", "n_words", "ids", "sizes", "hashes", "words"]


def chunk_rows(number: int, ids: pa.Array, seqs: list[np.ndarray], words: list[bytes]) -> Iterator[pa.RecordBatch]:
    """A chunk's documents (doc_id, n_tokens), then the chunk: its documents' word numbers after the start's, one by one.

    Words are numbered from the most frequent, those of one count by hash, so that numbers and hashes take little room.
    """
    n = len(seqs)
    sizes = np.array([len(s) for s in seqs], np.int64)
    seq = np.concatenate(seqs)
    hashes = np.array([zlib.crc32(w) for w in words], np.int64)
    order = np.lexsort((hashes, -np.bincount(seq, minlength=len(words))))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(sizes - 1), pa.nulls(n, pa.int64()),
         *(pa.nulls(n, pa.binary()),) * 4],
        names=CHUNK_NAMES,
    )
    blobs = packed(rank[seq]), packed(sizes), packed(np.diff(hashes[order], prepend=0) & HASHES), packed_words([words[k] for k in order])
    yield pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.nulls(1, pa.int32()), pa.nulls(1, ids.type), pa.array([int(sizes.sum())]), pa.array([len(words)]),
         *(pa.array([x], pa.binary()) for x in blobs)],
        names=CHUNK_NAMES,
    )


def chunks(docs: DataFrame, known: frozenset[bytes] | None) -> DataFrame:
    """docs(doc_id, text) -> a row per document and one per chunk."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, seqs, numbers, tokens = [], [], Numbers(sent.value), 0
        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_py().split()
                ids.append(i)
                seqs.append(np.fromiter((0, *map(numbers.__getitem__, words)), np.int32, len(words) + 1))
                tokens += len(words) + 1
                if tokens >= HELD_TOKENS:
                    yield from chunk_rows(number, pa.array(ids, kind), seqs, list(numbers.of))
                    number += 1
                    ids, seqs, numbers, tokens = [], [], Numbers(sent.value), 0
        if ids:
            yield from chunk_rows(number, pa.array(ids, kind), seqs, list(numbers.of))

    of = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        docs.select("doc_id", utf8("text").alias("text")),
        run,
        f"chunk bigint, doc int, doc_id {of}, n_tokens bigint, n_words bigint, ids binary, sizes binary, hashes binary, words binary",
    )


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each value of ``key``, by which the rows come in order."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[0][key] != row[key]:
                yield rows[0][key], rows
                rows = []
            rows.append(row)
    if rows:
        yield rows[0][key], rows


def batch_of(schema: pa.Schema, **columns: list) -> pa.RecordBatch:
    n = max(len(c) for c in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


def split(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order by bucket, (bucket, begin, end) of each one in that order)."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first[1:], len(bucket))
    return order, list(zip(found.tolist(), first.tolist(), ends.tolist()))


def split_words(hashes: bytes, word_buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    return split((np.cumsum(unpacked(hashes)) & HASHES) % word_buckets)


class Chunk:
    """A chunk's documents with the corpus numbers of its words, and the counts as far as they are known."""

    def __init__(self, rows: list[dict], word_buckets: int, pair_buckets: int):
        of = {k: [r for r in rows if r["kind"] == k] for k in (CHUNK, TARGETS, WORDS, COUNTS)}
        self.seq, self.sizes = unpacked(of[CHUNK][0]["a"]), unpacked(of[CHUNK][0]["b"])
        self.first = np.cumsum(self.sizes) - self.sizes
        target = np.zeros(len(self.sizes), bool)
        target[[place for r in of[TARGETS] for place in r["places"]]] = True
        self.target = np.repeat(target, self.sizes)
        # a token has the one before it as context; the start is counted where it is one
        self.second = np.delete(np.arange(len(self.seq)), self.first)
        self.counted = np.concatenate([self.second, self.first[self.sizes > 1]])
        numbers = gathered(of[WORDS], "a", split_words(of[CHUNK][0]["c"], word_buckets)[0])
        self.number_pairs(numbers, pair_buckets)
        if of[COUNTS]:
            found = [own + gathered(of[COUNTS], name, self.order) for name, own in zip("ab", self.own_counts())]
            self.counts = [x[self.place] for x in found]
            self.pair_counts = [x[len(numbers) :] for x in found]

    def number_pairs(self, numbers: np.ndarray, pair_buckets: int) -> None:
        """The chunk's words and distinct pairs in the order of their corpus numbers, and each token's pair.

        A word alone is sent as a pair with context 0; other contexts are numbered from 1.
        """
        by_number = np.argsort(numbers)
        self.place = np.empty(len(numbers), np.int64)
        self.place[by_number] = np.arange(len(numbers))
        key = self.place[self.seq[self.second - 1]] * len(numbers) + self.place[self.seq[self.second]]
        pairs, self.pair_of = np.unique(key, return_inverse=True)
        self.context, self.word = by_number[pairs // len(numbers)], by_number[pairs % len(numbers)]
        self.sent_context = np.concatenate([np.zeros(len(numbers), np.int64), numbers[self.context] + 1])
        self.sent_word = np.concatenate([numbers[by_number], numbers[self.word]])
        mixed = self.sent_context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.sent_word.astype(np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.order, self.parts = split(((mixed >> np.uint64(33)) % np.uint64(pair_buckets)).astype(np.int64))

    def own_counts(self) -> list[np.ndarray]:
        """Counts in this chunk of what is sent, under the background and the target model."""
        out = []
        for tokens, pairs in (
            (self.counted, self.pair_of),
            (self.counted[self.target[self.counted]], self.pair_of[self.target[self.second]]),
        ):
            words = np.bincount(self.place[self.seq[tokens]], minlength=len(self.place))
            out.append(np.concatenate([words, np.bincount(pairs, minlength=len(self.context))]))
        return out


def gathered(rows: list[dict], name: str, order: np.ndarray) -> np.ndarray:
    """Answers of all buckets, in their order, at the places of what was asked."""
    values = np.empty(len(order), np.int64)
    values[order] = np.concatenate([unpacked(r[name]) for r in sorted(rows, key=lambda r: r["bucket"])])
    return values


SENT = "bucket int, chunk bigint, a binary, b binary, c binary, d binary"
SENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), *((x, pa.binary()) for x in "abcd")])
ANSWER = "chunk bigint, bucket int, a binary, b binary, n bigint"
ANSWER_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), *((x, pa.binary()) for x in "ab"), ("n", pa.int64())])


def at_chunks(frames: list[DataFrame], each, schema: str, word_buckets: int, pair_buckets: int) -> DataFrame:
    """Rows of the chunks and of the answers to them meet by chunk; ``each`` (number, Chunk) gives record batches."""
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in groups(batches, "chunk"):
            yield from each(number, Chunk(rows, word_buckets, pair_buckets))

    return map_batches(every.repartition(task_count(every.sparkSession), "chunk").sortWithinPartitions("chunk", "kind", "bucket"), run, schema)


def at_buckets(sent: DataFrame, each) -> DataFrame:
    """Rows of the chunks meet by bucket; ``each`` (bucket, rows) gives answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in groups(batches, "bucket"):
            yield from each(bucket, rows)

    return map_batches(sent.repartition(task_count(sent.sparkSession), "bucket").sortWithinPartitions("bucket", "chunk"), run, ANSWER)


def word_requests(whole: DataFrame, word_buckets: int) -> DataFrame:
    """A row per chunk and bucket of words: the words and their counts in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = unpacked_words(row["words"])
                n = np.bincount(unpacked(row["ids"]), minlength=len(words))
                order, parts = split_words(row["hashes"], word_buckets)
                for bucket, i, j in parts:
                    a = packed_words([words[k] for k in order[i:j]])
                    yield batch_of(SENT_SCHEMA, bucket=[bucket], chunk=[row["chunk"]], a=[a], b=[packed(n[order[i:j]])])

    return map_batches(whole.select("chunk", "ids", "hashes", "words"), run, SENT)


def answer_words(bucket: int, rows: list[dict], word_buckets: int) -> Iterator[pa.RecordBatch]:
    """Numbers in the corpus of each chunk's words; one row without a chunk has the number of real words."""
    at: dict[bytes, int] = {}
    places = [np.array([at.setdefault(w, len(at)) for w in unpacked_words(r["a"])], np.int64) for r in rows]
    times = np.bincount(np.concatenate(places), np.concatenate([unpacked(r["b"]) for r in rows]), len(at))
    names = list(at)
    number = np.empty(len(at), np.int64)
    number[sorted(range(len(at)), key=lambda k: (-times[k], names[k]))] = np.arange(len(at)) * word_buckets + bucket
    yield batch_of(ANSWER_SCHEMA, bucket=[bucket], n=[sum(w not in (START, REST) for w in names)])
    for row, p in zip(rows, places):
        yield batch_of(ANSWER_SCHEMA, bucket=[bucket], chunk=[row["chunk"]], a=[packed(number[p])])


def send_counts(number: int, chunk: Chunk) -> Iterator[pa.RecordBatch]:
    context, word, n0, n1 = (x[chunk.order] for x in (chunk.sent_context, chunk.sent_word, *chunk.own_counts()))
    for bucket, i, j in chunk.parts:
        gaps = np.diff(context[i:j], prepend=0)
        yield batch_of(SENT_SCHEMA, bucket=[bucket], chunk=[number], a=[packed(gaps)], b=[packed(word[i:j])], c=[packed(n0[i:j])], d=[packed(n1[i:j])])


def answer_counts(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """How often each chunk's pairs and words stand in other chunks: nothing, for most pairs."""
    context = np.concatenate([np.cumsum(unpacked(r["a"])) for r in rows])
    word = np.concatenate([unpacked(r["b"]) for r in rows])
    if max(context.max(), word.max()) < 1 << 31:
        _, pair = np.unique(context << 32 | word, return_inverse=True)
    else:
        _, pair = np.unique(np.stack([context, word]), axis=1, return_inverse=True)
    own = [np.concatenate([unpacked(r[x]) for r in rows]) for x in "cd"]
    other = [np.bincount(pair, x).astype(np.int64)[pair] - x for x in own]
    end = 0
    for row in rows:
        begin, end = end, end + int.from_bytes(row["a"][:8], "little")
        n0, n1 = (x[begin:end] for x in other)
        yield batch_of(ANSWER_SCHEMA, bucket=[bucket], chunk=[row["chunk"]], a=[packed(n0)], b=[packed(n1)])


def document_losses(number: int, chunk: Chunk, totals: tuple[int, int, int], weight: float) -> Iterator[pa.RecordBatch]:
    """(chunk, doc, loss0, loss1): sums over a document's tokens of their losses under both models, in nats."""
    docs = np.flatnonzero(chunk.sizes > 1)
    if not len(docs):
        return
    begins = np.cumsum(chunk.sizes[docs] - 1) - (chunk.sizes[docs] - 1)
    sums = []
    for n, c, total in zip(chunk.pair_counts, chunk.counts, totals[1:]):
        share = n / np.maximum(c[chunk.context], 1)
        loss = -np.log(weight * share + (1 - weight) * (c[chunk.word] + 1) / float(total + totals[0] + 2))
        sums.append(np.add.reduceat(loss[chunk.pair_of], begins))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(docs), number)), pa.array(docs.astype(np.int32)), *map(pa.array, sums)], names=["chunk", "doc", "loss0", "loss1"]
    )


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, vocabulary: int | None = None, weight: float = 0.5) -> DataFrame:
    """docs(doc_id, text), target_ids(doc_id) -> doc_id, n_tokens, target_loss, background_loss, difference (per token).

    The vocabulary is every word of all documents; with ``vocabulary`` it is at most so many of the most frequent ones (those
    of one count in or out together), collected and sent to the tasks, and one word stands for the rest. Null doc_ids are
    never targets; repeated ids count once. A null text or one without words has no tokens and null losses. Repeated rows
    are counted and scored one by one. Without targets the target model knows its smoothing only. An empty table gives an
    empty result. Other columns are not read.
    """
    known = None
    if vocabulary is not None:
        counted = stored(word_counts(docs), "lm-vocabulary")
        known = frozenset(bytes(r["word"]) for r in counted.where(F.col("n") >= least_count(counted, vocabulary)).select("word").collect())
    held = stored(chunks(docs, known), "lm-chunks")
    each, whole = held.where("doc IS NOT NULL"), held.where("doc IS NULL")
    n_words, n_tokens = (n or 0 for n in whole.agg(F.sum("n_words"), F.sum("n_tokens")).first())
    least = 2 * task_count(docs.sparkSession)
    word_buckets = max(least, n_words // BUCKET_WORDS)
    pair_buckets = max(least, (n_words + n_tokens) // BUCKET_PAIRS)
    cut = (word_buckets, pair_buckets)

    marks = target_ids.select(F.col("doc_id").alias("__id")).where("__id IS NOT NULL").distinct()
    marks = marks.hint("merge")  # no bound on the number of targets is known, so the plan is the same at every size
    marked = each.join(marks, each["doc_id"] == F.col("__id")).groupBy("chunk").agg(F.collect_list("doc").alias("places"), F.sum("n_tokens").alias("n"))
    marked = stored(marked, "lm-targets")
    words = stored(at_buckets(word_requests(whole, word_buckets), lambda bucket, rows: answer_words(bucket, rows, word_buckets)), "lm-words")
    real = words.where("chunk IS NULL").agg(F.sum("n")).first()[0] or 0
    totals = (real, each.agg(F.sum("n_tokens")).first()[0] or 0, marked.agg(F.sum("n")).first()[0] or 0)

    none = F.lit(0).alias("bucket")
    texts = whole.select("chunk", F.lit(CHUNK).alias("kind"), none, F.col("ids").alias("a"), F.col("sizes").alias("b"), F.col("hashes").alias("c"))
    targets = marked.select("chunk", F.lit(TARGETS).alias("kind"), none, "places")
    numbered = words.where("chunk IS NOT NULL").select("chunk", F.lit(WORDS).alias("kind"), "bucket", "a")
    counts = stored(at_buckets(at_chunks([texts, targets, numbered], send_counts, SENT, *cut), answer_counts), "lm-counts")
    answered = counts.select("chunk", F.lit(COUNTS).alias("kind"), "bucket", "a", "b")

    summed = at_chunks(
        [texts, targets, numbered, answered],
        lambda number, chunk: document_losses(number, chunk, totals, weight),
        "chunk bigint, doc int, loss0 double, loss1 double",
        *cut,
    )
    scored = each.select("chunk", "doc", "doc_id", "n_tokens").join(summed.hint("merge"), ["chunk", "doc"], "left")
    scored = scored.select("doc_id", "n_tokens", (F.col("loss1") / F.col("n_tokens")).alias("target_loss"), (F.col("loss0") / F.col("n_tokens")).alias("background_loss"))
    return scored.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
