"""Packing: token sequences of a fixed window by sum-of-squares online packing.

Tokenising, cutting and the pieces' checksums run where a document is read; only narrow piece rows
(no text, no ids) are shuffled. A document longer than the window is cut into whole windows and one rest.
Rests are dealt by a hash into groups of about ``group_rows``; each group is one online packer: an array N
holds how many partly filled windows there are at each fill level, and a rest of s tokens goes to the level
h (0: a new window) that makes the sum of N(h)^2 smallest afterwards.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anomark.llm.common import map_batches, stored

_CACHES: dict = {}


def encoder(vocabulary: str, ranks: str):
    """text -> its ids by the byte-level BPE file ``vocabulary``, as little-endian 32-bit bytes.

    ``ranks`` is the same vocabulary as a rank file, whose encoder is several times faster; a text that holds
    a special token's string goes to the tokenizer of ``vocabulary``, which gives that token for it.
    """
    if vocabulary not in _CACHES:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        with open(ranks, "rb") as f:
            order = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=order, special_tokens={})
        _CACHES[vocabulary] = (tokenizer, special, plain)
    tokenizer, special, plain = _CACHES[vocabulary]

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", plain.encode_ordinary(text)).tobytes()

    return encode


def pieces(docs: DataFrame, vocabulary: str, ranks: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, start, length, ids_crc32, doc_tokens): whole windows and one rest per document.

    Null text is an empty one: only ``end_id``. Other columns are not read.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            rows, starts, lengths, crcs, totals = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                data = memoryview(encode(text.as_py()) + end)
                total = len(data) // 4
                for at in range(0, total, window):
                    part = data[4 * at : 4 * (at + window)]
                    rows.append(k)
                    starts.append(at)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    totals.append(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")),
        run,
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint",
    )


def sum_of_squares(lengths: list[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, in arrival order; a length is 1 to ``window``.

    With N(h) open windows at fill h, a rest of s put on level h changes the sum of squares by
    (1 - 2 N(h) if h > 0) + (1 + 2 N(h + s) if h + s < window). The least change wins; of equal ones
    the fuller level. Windows of one level are used last in, first out.
    """
    level = np.zeros(window + 1, np.int64)
    leave, enter = np.zeros(window + 1, np.int64), np.ones(window + 1, np.int64)
    far = np.iinfo(np.int64).max // 4
    leave[1:] = far  # no open window there
    enter[window] = 0
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    sequence, offset, new = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths):
        change = leave[: window - s + 1] + enter[s:]
        h = window - s - int(change[::-1].argmin())
        if h:
            at = open_at[h].pop()
            level[h] -= 1
            leave[h] = 1 - 2 * level[h] if level[h] else far
            enter[h] = 1 + 2 * level[h]
        else:
            at, new = new, new + 1
        sequence[k], offset[k] = at, h
        to = h + s
        if to < window:
            open_at[to].append(at)
            level[to] += 1
            leave[to] = 1 - 2 * level[to]
            enter[to] = 1 + 2 * level[to]
    return sequence, offset


def packed(parts: DataFrame, window: int = 1024, group_rows: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to parts(doc_id, start, length, ...). Sequence ids are unique, not dense.

    ``parts`` is a written table: its rows are dealt in turn, by their place in it, so that equal rows are spread like others
    and one packer sees about ``group_rows``; the number of packers grows with the pieces.
    """
    groups = max(1, -(-parts.count() // group_rows))
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    order = [f.name for f in parts.schema.fields]

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows["__group"].iloc[0])
        rows = rows.drop(columns="__group").sort_values(order, na_position="first", ignore_index=True)
        # arrival order is the order of a hash-like column, not of the size, as in a stream
        rows = rows.sort_values("ids_crc32", kind="stable", ignore_index=True)
        sequence, offset = sum_of_squares(rows["length"].tolist(), window)
        return rows.assign(sequence_id=sequence * groups + group, offset=offset)

    # places begin anew in each part of the table, at a group of its own
    place = F.monotonically_increasing_id()
    own, first = place.bitwiseAND((1 << 33) - 1), F.shiftright(place, 33)
    dealt = parts.withColumn("__group", F.pmod(own + F.xxhash64(first), F.lit(groups)))
    return dealt.groupBy("__group").applyInPandas(pack, schema)


def pack_documents(
    docs: DataFrame, vocabulary: str, ranks: str, window: int = 1024, end_id: int = 0, group_rows: int = 50_000
) -> DataFrame:
    """docs(doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text packs as an empty text. Repeated rows are packed as often as they come. A sequence is padded to the
    window, except when its fill is a power of two. An empty table gives an empty result.
    """
    return packed(stored(pieces(docs, vocabulary, ranks, window, end_id), "packing-pieces"), window, group_rows)
