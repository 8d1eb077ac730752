"""SentencePiece encoding and decoding: the best segmentation by a max-plus scan over chunks.

A segmentation's score is the sum of its pieces' scores. With L the longest piece, all that a chunk of text needs to
know of what lies before it are the best scores at its border and at the L - 1 positions before it; in the max-plus
algebra a chunk maps that vector linearly, by an L x L matrix. So texts of at most ``chunk`` characters are encoded
at once, and giant ones in passes that all work on chunks alone:

1. each chunk's matrix, with the words between its first and its last cut segmented once;   2. per document, matrices are combined (associatively, in a tree) to each chunk's entry vector;
3. each chunk's back-trace from each of its L possible ends, as a map from end to beginning;
4. per document, maps are combined from the last chunk back;   5. each chunk's ids from its now known end.

Scores are integers, so sums are exact in any order; of segmentations with equal scores the one with the longest last
piece wins, then the longest before it, and so on. The result is that of one sequential pass.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomark.llm.common import map_batches, stored

NONE = -(1 << 60)
SCALE = 1 << 16
_WORDS = re.compile(" *[^ ]+| +")
_LOADED: dict[str, "Vocabulary"] = {}
_BASE, _STIR = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _hash_step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hash of a string one character longer."""
    h = (h + code + np.uint64(1)) * np.uint64(_BASE)
    return (h ^ (h >> np.uint64(32))) * np.uint64(_STIR)


def _string_hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h + ord(c) + 1) * _BASE % (1 << 64)
        h = (h ^ (h >> 32)) * _STIR % (1 << 64)
    return h


class Vocabulary:
    """Pieces of a SentencePiece model, with a space for its space mark, scored by rank.

    The model's scores are ranks; rank r of n pieces is taken as the Zipf log-probability -log((r + 1) H_n). A character
    that is no piece becomes its UTF-8 bytes' pieces, each scored below every other piece.
    """

    def __init__(self, model: str, remembered: int = 300_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        harmonic = math.log(sum(1 / k for k in range(1, n + 1)))
        self.id: dict[str, int] = {}
        self.score: dict[str, int] = {}
        self.bytes: dict[int, bytes] = {}
        self.byte_id = {}
        for k in range(n):
            if sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
                continue
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.byte_id[int(piece[3:5], 16)] = k
                self.bytes[k] = bytes([int(piece[3:5], 16)])
                continue
            piece = piece.replace("▁", " ")
            rank = -sp.get_score(k)
            if rank > n:  # pieces of the user's, not of the ranking: last
                rank = n
            self.id[piece] = k
            self.score[piece] = round(-(math.log(rank + 1) + harmonic) * SCALE)
            self.bytes[k] = piece.encode()
        self.byte_score = round(-2 * (math.log(n + 1) + harmonic) * SCALE)
        self.longest = max(map(len, self.id))
        self.prefixes = {p[:k] for p in self.id for k in range(1, len(p) + 1)}
        # a piece never runs from a non-space into a space, so it never crosses such a place
        self.cuts = not any(" " in p.lstrip(" ") for p in self.id)
        # segmented words, and those of the time before ``known`` was last full: a word that is met again moves up
        self.remembered, self.known, self.older = remembered, {}, {}

    def pieces_at(self, text: str, at: int) -> list[tuple[int, int]]:
        """(length, score) of the pieces that begin at ``at``; always one of length 1."""
        found = []
        for width in range(1, min(self.longest, len(text) - at) + 1):
            piece = text[at : at + width]
            if piece not in self.prefixes:
                break
            if piece in self.score:
                found.append((width, self.score[piece]))
        if not found or found[0][0] != 1:
            found.insert(0, (1, self.byte_score * len(text[at].encode())))
        return found

    def ids_of(self, piece: str) -> list[int]:
        return [self.id[piece]] if piece in self.id else [self.byte_id[b] for b in piece.encode()]

    def best(self, text: str, first: list[int]) -> tuple[list[int], list[int]]:
        """(score, length of the longest best last piece) at each position; ``first`` gives the scores of positions 0 to len(first) - 1.

        A position of ``first`` takes no piece that ends there: it is what lies before this text.
        """
        n, before = len(text), len(first) - 1
        score = [*first, *[NONE] * (n - before)]
        back = [0] * (n + 1)
        for i in range(n):
            base = score[i]
            if base <= NONE:
                continue
            for width, s in self.pieces_at(text, i):
                j = i + width
                if j > before:
                    t = base + s
                    if t > score[j]:
                        score[j], back[j] = t, width
        return score, back  # an earlier start means a longer last piece, and comes first: ties keep it

    def word(self, text: str) -> tuple[int, bytes]:
        """Score and little-endian ids of a text on its own."""
        got = self.known.get(text) or self.older.get(text)
        if got is None:
            score, back = self.best(text, [0])
            ids: list[int] = []
            at = len(text)
            while at > 0:
                ids[:0] = self.ids_of(text[at - back[at] : at])
                at -= back[at]
            got = (score[-1], np.array(ids, "<u4").tobytes())
            if len(text) <= 64:
                self._room(1)
                self.known[text] = got
        return got

    def _room(self, words: int) -> None:
        if self.known and len(self.known) + words > self.remembered:
            self.older, self.known = self.known, {}

    def _tables(self) -> None:
        """Pieces and their beginnings by the hash of their characters: an open table of 2^20 places with linear probing."""
        texts = list(self.prefixes)
        self._key = np.array([_string_hash(t) for t in texts], np.uint64)
        self._id = np.array([self.id.get(t, -1) for t in texts], np.int64)
        self._score = np.array([self.score.get(t, NONE) for t in texts], np.int64)
        self._slot = np.full(1 << 20, -1, np.int32)
        self._probes = 1
        for k, place in enumerate((self._key >> np.uint64(44)).astype(np.int64).tolist()):
            probes = 1
            while self._slot[place] >= 0:
                place, probes = (place + 1) % len(self._slot), probes + 1
            self._slot[place] = k
            self._probes = max(self._probes, probes)

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece or beginning with each hash, or -1."""
        place = (h >> np.uint64(44)).astype(np.int64)
        found = self._slot[place]
        hit = (found >= 0) & (self._key[found] == h)
        out = np.where(hit, found, -1)
        for probe in range(1, self._probes):
            again = np.flatnonzero((out < 0) & (found >= 0))
            if not len(again):
                break
            found = np.full(len(h), -1, np.int32)
            found[again] = self._slot[(place[again] + probe) % len(self._slot)]
            hit = (found >= 0) & (self._key[found] == h)
            out[hit] = found[hit]
        return out

    def learn(self, words: set[str], longest: int = 64) -> None:
        """Best segmentations of many words at once: the same sums and ties as ``best``, word by word in one array row."""
        if not hasattr(self, "_slot"):
            self._tables()
        new = words.difference(self.known)
        self._room(len(new))
        if not self.known:
            new = words
        for w in self.older.keys() & new:
            self.known[w] = self.older[w]
            new = new if new is not words else set(words)
            new.discard(w)
        by_length: dict[int, list[str]] = {}
        for w in new:
            if len(w) <= longest:
                by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            for at in range(0, len(group), 8192):
                self._learn(group[at : at + 8192], n)

    def _learn(self, group: list[str], n: int) -> None:
        codes = np.frombuffer("".join(group).encode("utf-32-le"), "<u4").reshape(len(group), n).T.astype(np.uint64)
        score = np.full((n + 1, len(group)), NONE, np.int64)
        score[0] = 0
        back = np.zeros((n + 1, len(group)), np.int64)
        piece = np.zeros((n + 1, len(group)), np.int64)  # an id, or -1 - code point of a character that is no piece

        def offer(j: int, rows: np.ndarray, total: np.ndarray, width: int, ids: np.ndarray) -> None:
            better = total > score[j, rows]
            rows = rows[better]
            score[j, rows], back[j, rows], piece[j, rows] = total[better], width, ids[better]

        for i in range(n):
            live = np.arange(len(group))
            h = np.zeros(len(group), np.uint64)
            for width in range(1, min(self.longest, n - i) + 1):
                h = _hash_step(h, codes[i + width - 1, live])
                k = self._look_up(h)
                if width == 1:
                    alone = live[(k < 0) | (self._id[k] < 0)]
                    if len(alone):
                        c = codes[i, alone].astype(np.int64)
                        size = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
                        offer(i + 1, alone, score[i, alone] + self.byte_score * size, 1, -1 - c)
                begun = k >= 0
                live, h, k = live[begun], h[begun], k[begun]
                if not len(live):
                    break
                whole = self._id[k] >= 0
                rows, k = live[whole], k[whole]
                offer(i + width, rows, score[i, rows] + self._score[k], width, self._id[k])
        at = np.full(len(group), n)
        path = np.zeros((len(group), n), np.int64)
        count = np.zeros(len(group), np.int64)
        live = np.arange(len(group))
        while len(live):
            count[live] += 1
            path[live, n - count[live]] = piece[at[live], live]
            at[live] -= back[at[live], live]
            live = live[at[live] > 0]
        broken = (path < 0).any(axis=1).tolist()
        flat = path.astype("<u4")
        for row, (word, size, total) in enumerate(zip(group, count.tolist(), score[n].tolist())):
            if broken[row]:
                ids = [i for x in path[row, n - size :].tolist() for i in ([x] if x >= 0 else [self.byte_id[b] for b in chr(-1 - x).encode()])]
                self.known[word] = (total, np.array(ids, "<u4").tobytes())
            else:
                self.known[word] = (total, flat[row, n - size :].tobytes())

    def encode_all(self, texts: list[str]) -> list[tuple[int, bytes]]:
        parts = [_WORDS.findall(t) if self.cuts else [t] for t in texts]
        self.learn(set().union(*parts))
        return [self._joined(words) if words != [""] else (0, b"") for words in parts]

    def _joined(self, words: list[str]) -> tuple[int, bytes]:
        known = self.known
        try:
            got = [known[w] for w in words]
        except KeyError:  # a word too long to keep
            got = [known[w] if w in known else self.word(w) for w in words]
        return sum([s for s, _ in got]), b"".join([i for _, i in got])

    def between_cuts(self, texts: list[str | None]) -> list[tuple[int, bytes] | None]:
        """Score and ids of texts that begin and end at cuts: those of their words, learned together."""
        parts = [None if t is None else _WORDS.findall(t) for t in texts]
        self.learn(set().union(*filter(None, parts)))
        return [None if words is None else self._joined(words) for words in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def vocabulary(model: str) -> Vocabulary:
    if model not in _LOADED:
        _LOADED[model] = Vocabulary(model)
    return _LOADED[model]


def marked(text: str) -> str:
    """The text with the space that SentencePiece puts before it; an empty text stays empty."""
    return f" {text}" if text else ""


# A chunk comes with ``lead`` = min(L - 1, its start) characters of what lies before it. Vectors and matrices are
# indexed by the distance of a position before the border: 0 is the border itself.


def split(v: Vocabulary, text: str, lead: int) -> tuple[str, str | None, str | None]:
    """A chunk's text up to its first cut, from there to its last cut, and from there on; no cut: all of it, None, None.

    No piece crosses a cut, so that every segmentation is one of each part, and only the first depends on the entry."""
    cut = _first_cut(v, text, lead)
    if cut is None or len(text) - cut < v.longest:
        return text, None, None
    last = _last_cut(v, text, cut)
    return text[:cut], text[cut:last], text[last:]


def transfer(v: Vocabulary, head: str, middle: int | None, tail: str | None, lead: int) -> np.ndarray:
    """M[a, b]: best score from position b before the chunk's beginning to position a before its end; ``middle`` is a score."""
    width = v.longest
    m = np.full((width, width), NONE, np.int64)
    behind = None if tail is None else v.best(tail, [0])[0]
    for b in range(min(width, lead + 1)):
        first = [NONE] * (lead + 1)
        first[lead - b] = 0
        score, _ = v.best(head, first)
        if behind is None:
            for a in range(min(width, len(head) - lead)):
                m[a, b] = score[len(head) - a]
        elif score[len(head)] > NONE:
            for a in range(width):
                if behind[len(behind) - 1 - a] > NONE:
                    m[a, b] = score[len(head)] + middle + behind[len(behind) - 1 - a]
    return m


def _cuts(text: str, lead: int) -> Iterator[int]:
    return (k for k in range(lead + 1, len(text)) if text[k] == " " and text[k - 1] != " ")


def _first_cut(v: Vocabulary, text: str, lead: int) -> int | None:
    return next(_cuts(text, lead), None) if v.cuts else None


def _last_cut(v: Vocabulary, text: str, first: int) -> int:
    """The last cut with a whole piece's length behind it: every end that matters lies behind it."""
    at = len(text) - v.longest
    while at > first and not (text[at] == " " and text[at - 1] != " "):
        at -= 1
    return max(at, first)


def combine(later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Max-plus products of stacks of matrices."""
    out = (later[:, :, :, None] + earlier[:, None, :, :]).max(axis=2)
    return np.maximum(out, NONE)


def prefix_products(matrices: np.ndarray) -> np.ndarray:
    """P[k] = M[k] ... M[0], in log2(n) rounds of combining neighbours at doubling distance."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = combine(out[step:], out[:-step])
        step *= 2
    return out


def ends_to_beginnings(v: Vocabulary, head: str, tail: str | None, lead: int, entry: np.ndarray) -> np.ndarray:
    """For each distance a of an end, the distance b of the beginning that its back-trace reaches; -1: no such end."""
    score, back = v.best(head, _first(entry, lead))
    out = np.full(v.longest, -1, np.int32)

    def beginning(at: int) -> int:
        while at > lead:
            at -= back[at]
        return lead - at

    if tail is not None:  # every back-trace passes the cuts: one beginning for all ends
        if score[len(head)] > NONE:
            behind, _ = v.best(tail, [0])
            start = beginning(len(head))
            for a in range(v.longest):
                if behind[len(behind) - 1 - a] > NONE:
                    out[a] = start
        return out
    for a in range(v.longest):
        at = len(head) - a
        if at <= lead:
            out[a] = lead - at if 0 <= at and lead - at < v.longest else -1
        elif score[at] > NONE:
            out[a] = beginning(at)
    return out


def _first(entry: np.ndarray, lead: int) -> list[int]:
    return [int(entry[lead - k]) if lead - k < len(entry) else NONE for k in range(lead + 1)]


def trace(
    v: Vocabulary, head: str, tail: str | None, lead: int, entry: np.ndarray, end: int
) -> tuple[int, bytes, bytes | None]:
    """Score and ids of the pieces that end after the chunk's beginning, up to distance ``end`` before its end: without those
    between its cuts, before and behind which the ids stand."""
    if tail is None:
        return *_back(v, head, *v.best(head, _first(entry, lead)), len(head) - end, lead), None
    before, first = _back(v, head, *v.best(head, _first(entry, lead)), len(head), lead)
    behind, last = _back(v, tail, *v.best(tail, [0]), len(tail) - end, 0)
    return before + behind, first, last


def _back(v: Vocabulary, text: str, score: list[int], back: list[int], at: int, begin: int) -> tuple[int, bytes]:
    """Score at ``at`` and the ids of its best segmentation from ``begin`` on."""
    total, parts = score[at], []
    while at > begin:
        parts.append(v.ids_of(text[at - back[at] : at]))
        at -= back[at]
    return total, np.array([i for p in reversed(parts) for i in p], "<u4").tobytes()


KEY = "k1 bigint, k2 bigint"


def _parts(texts: pa.Array, characters: int = 1 << 22) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(marked(text.as_py()))
        size += len(held[-1])
        if size >= characters:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, model: str, chunk: int = 32_768) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, score in 1/65536 nats, n_chunks, ids: little-endian 32-bit, decoded text).

    Null text is empty: no ids, decoded as empty. Repeated rows come back as often as they came. An empty table gives an empty
    result. Other columns are not read. ``chunk`` must exceed the longest piece.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = f"doc_id {kind}, score bigint, n_chunks int, ids binary, decoded string"
    names = ["doc_id", "score", "n_chunks", "ids", "decoded"]

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            found = [x for part in _parts(batch.column(1)) for x in v.encode_all(part)]
            scores, ids = [s for s, _ in found], [i for _, i in found]
            texts = [v.decode(i).decode()[1:] for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.int64()), pa.array(np.ones(len(ids), np.int32)), pa.array(ids, pa.binary()), pa.array(texts, pa.string())],
                names=names,
            )

    small = map_batches(rows.where(F.length("text") < chunk), at_once, out)

    giant = rows.where(F.length("text") >= chunk).select("doc_id", F.xxhash64("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = vocabulary(model).longest - 1
        for batch in batches:
            for k1, k2, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = marked(text)
                starts = list(range(0, len(text), chunk))
                if len(starts) > 1 and len(text) - starts[-1] <= before:
                    starts.pop()  # no chunk shorter than a piece
                stops = [*starts[1:], len(text)]
                n = len(starts)
                leads = [min(before, s) for s in starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k1] * n, pa.int64()), pa.array([k2] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(leads, pa.int32()),
                     pa.array([text[a - lead : b] for a, b, lead in zip(starts, stops, leads)], pa.string())],
                    names=["k1", "k2", "chunk", "lead", "text"],
                )

    chunks = stored(
        map_batches(giant.select("k1", "k2", "text"), cut, f"{KEY}, chunk int, lead int, text string").dropDuplicates(["k1", "k2", "chunk"]),
        "sp-chunks",
    )

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                leads = part.column(3).to_pylist()
                cut = [split(v, text, lead) for text, lead in zip(part.column(4).to_pylist(), leads)]
                middles = v.between_cuts([m for _, m, _ in cut])
                found = [
                    transfer(v, head, m and m[0], tail, lead).tobytes() for (head, _, tail), m, lead in zip(cut, middles, leads)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array([h for h, _, _ in cut], pa.string()), pa.array([t for _, _, t in cut], pa.string()),
                     pa.array([m and m[0] for m in middles], pa.int64()), pa.array([m and m[1] for m in middles], pa.binary()),
                     pa.array(found, pa.binary())],
                    names=["k1", "k2", "chunk", "lead", "head", "tail", "middle", "ids", "m"],
                )

    def entries(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk", ignore_index=True)
        size = math.isqrt(len(group["m"].iloc[0]) // 8)
        products = prefix_products(np.stack([np.frombuffer(m, np.int64).reshape(size, size) for m in group["m"]]))
        start = np.full(size, NONE, np.int64)
        start[0] = 0
        found = [start, *np.maximum((products + start).max(axis=2), NONE)[:-1]]
        return group[["k1", "k2", "chunk"]].assign(entry=[x.tobytes() for x in found])

    parts = f"{KEY}, chunk int, lead int, head string, tail string, middle bigint, ids binary, m binary"
    segmented = stored(map_batches(chunks, matrices, parts), "sp-matrices")
    entry = stored(
        segmented.select("k1", "k2", "chunk", "m").groupBy("k1", "k2").applyInPandas(entries, f"{KEY}, chunk int, entry binary"), "sp-entries"
    )
    ends_only = segmented.select("k1", "k2", "chunk", "lead", "head", "tail", "middle")
    ready = ends_only.join(entry, ["k1", "k2", "chunk"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            found = [
                ends_to_beginnings(v, head, tail, lead, np.frombuffer(e, np.int64)).tobytes()
                for head, tail, lead, e in zip(*(batch.column(c).to_pylist() for c in ("head", "tail", "lead", "entry")))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], names=["k1", "k2", "chunk", "way"])

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk", ignore_index=True)
        end, found = 0, []
        for way in reversed([np.frombuffer(w, np.int32) for w in group["way"]]):
            found.append(end)
            end = int(way[end])
        return group[["k1", "k2", "chunk"]].assign(end=found[::-1])

    end = stored(
        map_batches(ready.select("k1", "k2", "chunk", "head", "tail", "lead", "entry"), maps, f"{KEY}, chunk int, way binary").groupBy("k1", "k2").applyInPandas(ends, f"{KEY}, chunk int, end int"), "sp-ends"
    )

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            found = [
                trace(v, head, tail, lead, np.frombuffer(e, np.int64), stop)
                for head, tail, lead, e, stop in zip(*(batch.column(c).to_pylist() for c in ("head", "tail", "lead", "entry", "end")))
            ]
            scores = [s + (m or 0) for (s, _, _), m in zip(found, batch.column("middle").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(scores, pa.int64()), pa.array([i for _, i, _ in found], pa.binary()), pa.array([i for _, _, i in found], pa.binary())],
                names=["k1", "k2", "chunk", "score", "first", "last"],
            )

    pieces = map_batches(ready.join(end, ["k1", "k2", "chunk"]), traced, f"{KEY}, chunk int, score bigint, first binary, last binary")
    # ids move once, to their document: those before, between and behind the cuts of a chunk are three parts of it
    part = lambda k, ids: F.struct((F.col("chunk") * 3 + k).alias("at"), F.col(ids).alias("ids"))
    outer = pieces.select("k1", "k2", "chunk", "score", F.explode(F.array(part(0, "first"), part(2, "last"))).alias("p"))
    inner = segmented.select("k1", "k2", "chunk", F.lit(None).cast("bigint").alias("score"), part(1, "ids").alias("p"))
    whole = outer.unionAll(inner).where("p.ids IS NOT NULL").groupBy("k1", "k2").agg(
        F.max_by("score", F.when(F.col("score").isNotNull(), F.col("chunk"))).alias("score"),
        (F.max("chunk") + 1).cast("int").alias("n_chunks"),
        F.array_sort(F.collect_list("p")).alias("parts"),
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join(p["ids"] for p in doc) for doc in batch.column(3).to_pylist()]
            texts = [vocabulary(model).decode(i).decode()[1:] for i in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=names)

    large = giant.select("doc_id", "k1", "k2").join(whole, ["k1", "k2"]).select("doc_id", "score", "n_chunks", "parts")
    return small.unionByName(map_batches(large, joined, out))


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", "score", "n_chunks", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def sequential(v: Vocabulary, text: str) -> tuple[int, bytes]:
    """One pass over a whole text, for comparison."""
    score, back = v.best(text, [0])
    at, parts = len(text), []
    while at > 0:
        parts.append(v.ids_of(text[at - back[at] : at]))
        at -= back[at]
    return score[len(text)], np.array([i for p in reversed(parts) for i in p], "<u4").tobytes()
