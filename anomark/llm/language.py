"""Language identification: a byte convolutional network, trained in numpy and applied to fixed-length windows.

Filters of several widths slide over a window's bytes; each filter's largest response over the window (max
pooling) feeds a softmax over the learned languages. A text is cut into windows of ``window`` bytes, the last one
padded with zero bytes; its score for a language is the mean of its windows' probabilities.

The model is fitted on a documented, bounded sample (``docs_per_lang`` labelled documents of each language, at most
``sample_docs`` together, ``windows_per_doc`` windows of each); every text is predicted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anomark.llm.common import map_batches, utf8

UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode categories L): numerals such as a half or a superscript two are none."""
    return any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    widths: tuple[int, ...]
    window: int
    filters: list[np.ndarray]  # per width: (width, 256, filters)
    bias: np.ndarray  # (widths * filters)
    out: np.ndarray  # (widths * filters, langs)
    out_bias: np.ndarray
    spread: float = 1.0  # what most learned windows of the language with the least sure ones stay within


def windows_of(text: bytes, window: int) -> np.ndarray:
    """(n, window) bytes, the last row padded with zeros; an empty text has none."""
    n = -(-len(text) // window)
    out = np.zeros(n * window, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, window)


def responses(x: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """(windows, places, filters): each filter's response at each place."""
    width = len(filters)
    places = x.shape[1] - width + 1
    r = filters[0][x[:, :places]]
    for j in range(1, width):
        r = r + filters[j][x[:, j : j + places]]
    return r


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def perplexity(p: np.ndarray) -> np.ndarray:
    return np.exp(-(p * np.log(np.maximum(p, 1e-30))).sum(axis=1))


def train(
    x: np.ndarray, y: np.ndarray, langs: list[str], widths: tuple[int, ...] = (2, 3, 4), filters: int = 16,
    steps: int = 500, batch: int = 96, rate: float = 0.01, seed: int = 5,
) -> Model:
    """Adam on cross-entropy. Gradients pass through the place of each filter's largest response only."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, filters)).astype(np.float32) for w in widths]
    total = filters * len(widths)
    params += [np.zeros(total, np.float32), rng.normal(0, 1 / np.sqrt(total), (total, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    # languages are drawn alike often
    by_lang = [np.flatnonzero(y == k) for k in range(len(langs))]
    for step in range(1, steps + 1):
        label = rng.integers(0, len(langs), batch)
        pick = np.array([rng.choice(by_lang[k]) for k in label])
        xb = x[pick]
        best, pooled = [], []
        for w in range(len(widths)):
            r = responses(xb, params[w])
            place = r.argmax(axis=1)
            best.append(place)
            pooled.append(np.take_along_axis(r, place[:, None, :], axis=1)[:, 0])
        pre = np.concatenate(pooled, axis=1) + params[-3]
        hidden = np.maximum(pre, 0)
        p = softmax(hidden @ params[-2] + params[-1])
        d = p
        d[np.arange(batch), label] -= 1
        d /= batch
        back = (d @ params[-2].T) * (pre > 0)
        grads = []
        rows = np.repeat(np.arange(batch), filters)
        which = np.tile(np.arange(filters), batch)
        for w, width in enumerate(widths):
            g = np.zeros_like(params[w])
            value = back[:, w * filters : (w + 1) * filters].ravel()
            at = best[w].ravel()
            for j in range(width):
                np.add.at(g[j], (xb[rows, at + j], which), value)
            grads.append(g)
        grads += [back.sum(axis=0), hidden.T @ d, d.sum(axis=0)]
        for k, g in enumerate(grads):
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.001 * (g * g - square[k])
            params[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-7)
    n = len(widths)
    return Model(langs, widths, x.shape[1], params[:n], params[n], params[n + 1], params[n + 2])


class Predictor:
    """Applies a model to batches of windows; two neighbouring bytes' responses are looked up as one."""

    def __init__(self, model: Model):
        self.model = model
        pair = np.arange(65536)
        self.steps = []
        for f in model.filters:
            tables = [f[j][pair >> 8] + f[j + 1][pair & 255] for j in range(0, len(f) - 1, 2)]
            if len(f) % 2:
                tables.append(f[-1])
            self.steps.append(tables)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, langs)"""
        pairs = x[:, :-1].astype(np.intp) << 8 | x[:, 1:]
        pooled = []
        for f, tables in zip(self.model.filters, self.steps):
            places = x.shape[1] - len(f) + 1
            r = None
            for k, table in enumerate(tables):
                at = 2 * k
                index = pairs[:, at : at + places] if len(table) == 65536 else x[:, at : at + places]
                got = table.take(index, axis=0)
                r = got if r is None else np.add(r, got, out=r)
            pooled.append(r.max(axis=1))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.model.bias, 0)
        return softmax(hidden @ self.model.out + self.model.out_bias)

    def scores(self, texts: list[bytes], at_once: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(texts, langs): mean probability over each text's windows; (texts): share of its windows that are sure.

        A window is sure if its probabilities are as good as a choice among half of the languages (by their perplexity), or
        among as many as learned windows are, whichever these are. Texts are not empty.
        """
        counts = np.array([-(-len(t) // self.model.window) for t in texts])
        x = np.concatenate([windows_of(t, self.model.window) for t in texts])
        p = np.concatenate([self.probabilities(x[a : a + at_once]) for a in range(0, len(x), at_once)])
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        most = max(len(self.model.langs) / 2, self.model.spread)
        sure = np.add.reduceat((perplexity(p) <= most).astype(float), first) / counts
        return np.add.reduceat(p, first, axis=0) / counts[:, None], sure


def training_windows(labelled: DataFrame, docs_per_lang: int, sample_docs: int, windows_per_doc: int, window: int) -> list:
    """(lang, window bytes) rows of a bounded sample: documents by the least hash of their id, windows evenly spread.

    At most ``sample_docs`` languages are learned, the most frequent ones: no more than these counts and the sample reach the driver."""
    found = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(sample_docs).collect()
    if not found:
        return []
    each = min(docs_per_lang, max(1, sample_docs // len(found)))
    share = F.create_map(*(F.lit(v) for r in found for v in (r["lang"], float(each) / r["n"])))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws, langs, parts = [], [], []
            for lang, text, at in zip(*(c.to_pylist() for c in batch.columns)):
                if not has_letter(text.decode("utf-8", "replace")):
                    continue
                x = windows_of(text, window)
                for k in np.unique(np.linspace(0, len(x) - 1, min(windows_per_doc, len(x))).astype(int)).tolist():
                    draws.append(at)
                    langs.append(lang)
                    parts.append(x[k].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(draws, pa.float64()), pa.array(langs, pa.string()), pa.array(parts, pa.binary())], names=["draw", "lang", "part"]
            )

    drawn = labelled.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")])
    parts = map_batches(drawn.select("lang", utf8("text").alias("text"), "draw"), cut, "draw double, lang string, part binary")
    rows = parts.orderBy("draw", "lang", "part").limit(2 * windows_per_doc * each * len(found)).collect()
    return sorted((r["lang"], bytes(r["part"])) for r in rows)


def fit(
    labelled: DataFrame, docs_per_lang: int = 400, sample_docs: int = 20_000, windows_per_doc: int = 4, window: int = 128, **options
) -> Model | None:
    """labelled(doc_id, lang, text) -> a model; None if no labelled text has a letter. Null lang or text is no label."""
    rows = training_windows(labelled.where("lang IS NOT NULL AND text IS NOT NULL"), docs_per_lang, sample_docs, windows_per_doc, window)
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    y = np.array([langs.index(lang) for lang, _ in rows])
    x = np.frombuffer(b"".join(part for _, part in rows), np.uint8).reshape(len(rows), window)
    model = train(x, y, langs, **options)
    predictor = Predictor(model)
    for k in range(len(langs)):
        own = x[y == k]
        some = own[np.unique(np.linspace(0, len(own) - 1, min(256, len(own))).astype(int))]
        model.spread = max(model.spread, float(np.quantile(perplexity(predictor.probabilities(some)), 0.95)))
    return model


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), batch_bytes: int = 1 << 18) -> DataFrame:
    """docs(text) -> ``keep``, lang_pred, score (0 to 1), sure (share of sure windows).

    A null text, or one without a letter, is ``und`` with score 0, as is every text without a model; with a letter the
    latter is sure, as nothing speaks against it. A text longer than
    ``batch_bytes`` is a batch of its own. Rows are predicted one by one, so repeated rows agree; an empty table gives an
    empty result. Only ``keep`` and text are read.
    """
    names = [*keep, "lang_pred", "score", "sure"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model) if model else None
        for batch in batches:
            langs: list[str] = [UNDETERMINED] * batch.num_rows
            scores, sures = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            held: list[tuple[int, bytes]] = []
            size = 0

            def settle() -> None:
                found, sure = predictor.scores([t for _, t in held])
                for (k, _), best, score, share in zip(held, found.argmax(axis=1).tolist(), found.max(axis=1).tolist(), sure.tolist()):
                    langs[k], scores[k], sures[k] = model.langs[best], min(1.0, score), share

            for k, text in enumerate(batch.column(batch.num_columns - 1)):
                raw = text.as_py()
                if not raw or not has_letter(raw.decode("utf-8", "replace")):
                    continue
                if predictor is None:
                    sures[k] = 1.0
                    continue
                held.append((k, raw))
                size += len(raw)
                if size >= batch_bytes:
                    settle()
                    held, size = [], 0
            if held:
                settle()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores), pa.array(sures)], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return map_batches(docs.select(*keep, utf8("text").alias("__text")), run, f"{schema}, lang_pred string, score double, sure double")


def held_out() -> Column:
    """Remainder 0 of crc32(doc_id as text) by 5; a null doc_id is never trained on."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, held_out, lang_pred, score; fitted on labelled rows that are not held out."""
    model = fit(docs.where(~held_out()).select("doc_id", "lang", "text"), **options)
    found = predict(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least_score: float = 0.35, least_sure: float = 0.5, **options) -> DataFrame:
    """The rows of docs, all columns, whose text is language; the others are rejected.

    A text is language if one has at least ``least_score``, or if at least ``least_sure`` of its windows are sure, each of
    its own language or of several that are alike. Without a model every text with a letter is.
    """
    model = fit(docs.where(~held_out()).select("doc_id", "lang", "text"), **options)
    names = docs.columns
    found = predict(docs.withColumn("__all", F.struct(*names)), model, ("__all",))
    good = found.where((F.col("score") >= least_score) | (F.col("sure") >= least_sure))
    return good.select(*(F.col("__all")[c].alias(c) for c in names))
