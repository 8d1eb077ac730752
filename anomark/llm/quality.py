"""Quality rules with adaptive thresholds: no Python code on the path, no text is shuffled.

Per document, counts come from expressions over the text. Per (lang, source), a mergeable quantile sketch of
each ratio is built by a partial aggregate; a language's sketch is the merge of its sources' sketches. A cell
with too few documents uses its language's fence. The fence of a ratio is q3 + ``reach`` * max(q3 - q1, ``least_spread``), so it follows the cell's own
documents; documents are joined with their cell's fences and judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anomark.llm.common import stored

# Fixed values of the contract: white space that separates words, symbol characters, base rule limits.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
REPEAT_PERCENT = 50

# ratio -> (numerator, denominator, least spread of a cell): the spread keeps a fence above q3 where all of a
# cell's documents are alike.
RATIOS = {
    "symbol_ratio": ("n_symbols", "n_words", 0.05),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 0.20),
    "repeat_ratio": ("n_repeat_words", "n_words", 0.10),
    "word_length": ("word_chars", "n_words", 1.0),
}


def _repeat_words(grams: Column) -> Column:
    """Words covered by 3-word windows whose hash occurs twice or more, from the windows' (hash, position) in order.

    ``grams`` is sorted by (hash, position); one fold keeps the previous entry and collects positions of repeats.
    """
    count = F.size(grams)
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(grams, 1, F.greatest(count - 1, F.lit(0))))
    after = F.concat(F.slice(grams, 2, F.greatest(count, F.lit(1))), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    marked = F.zip_with(
        F.zip_with(grams, before, lambda g, b: F.struct(g.alias("g"), F.coalesce(g.h == b.h, F.lit(False)).alias("d"))),
        after,
        lambda m, a: F.when(m.d | F.coalesce(m.g.h == a.h, F.lit(False)), m.g.i),
    )
    return F.array_sort(F.array_compact(marked))


def document_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` columns and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) of ``text``.

    Null text has no words. Words are maximal runs of characters other than space and \\x09-\\x0D.
    """
    text = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))
    words = F.filter(F.split("__t", "[ \t\n\\x0B\f\r]+", -1), lambda w: w != "")
    cut = text.select(*keep, "__t", words.alias("__w"))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.translate(x, SPACE, "") != "")
    shifted = F.zip_with(
        F.zip_with("__w", F.slice("__w", 2, F.size("__w")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.slice("__w", 3, F.size("__w")),
        lambda ab, c: F.when(c.isNotNull(), F.xxhash64(ab.a, ab.b, c)),
    )
    hashed = cut.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        F.when(F.size("__w") > 3, F.array_compact(shifted)).alias("__h"),
    )
    sized = hashed.select(
        *keep, "n_words", "word_chars", "n_symbols",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        # most texts repeat no window: only the others are sorted by (hash, position)
        F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__g"),
    )
    at = sized.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", _repeat_words(F.col("__g")).alias("__at")
    )
    # each repeated window adds the words that the next one does not start with; the last adds three
    covered = F.aggregate(
        F.col("__at"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc.n + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc.n,
    )
    return at.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words")
    )


def _ratio(name: str) -> Column:
    top, bottom, _ = RATIOS[name]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))


def fences(stats: DataFrame, reach: float = 3.0, least_docs: int = 100, accuracy: int = 4096) -> DataFrame:
    """stats -> (lang, source, one fence per ratio) from quantile sketches of documents that pass the base rules.

    ``accuracy`` is the sketch's k (rank error about 2/k); below k documents the quantiles are exact.
    """
    good = stats.where(~base_failed())
    k = F.lit(accuracy)
    cells = stored(
        good.groupBy("lang", "source").agg(
            F.count("*").alias("n"), *(F.kll_sketch_agg_double(_ratio(r), k).alias(r) for r in RATIOS)
        ),
        "quality-sketches",
    )
    langs = cells.groupBy("lang").agg(*(F.kll_merge_agg_double(r, k).alias(f"{r}_all") for r in RATIOS))
    both = cells.join(langs.withColumnRenamed("lang", "__lang"), F.col("lang").eqNullSafe(F.col("__lang")))

    def fence(r: str) -> Column:
        sketch = F.when(F.col("n") >= least_docs, F.col(r)).otherwise(F.col(f"{r}_all"))
        low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        return high + F.lit(reach) * F.greatest(high - low, F.lit(RATIOS[r][2]))

    return both.select("lang", "source", *(fence(r).alias(f"max_{r}") for r in RATIOS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def quality(docs: DataFrame, reach: float = 3.0, least_docs: int = 100, accuracy: int = 4096) -> DataFrame:
    """docs(doc_id, text, lang, source) -> doc_id, the counts, base_failed, kept and the cell's fences.

    ``kept`` is false for base failures and for a ratio above its cell's fence. Null lang and null source are
    cells of their own. Null or empty text has no words and fails. Repeated rows are judged one by one. An empty
    table gives an empty result. Further columns are not read.
    """
    stats = stored(document_stats(docs), "quality-stats")
    limits = fences(stats, reach, least_docs, accuracy).withColumnsRenamed({"lang": "__lang", "source": "__source"})
    joined = stats.join(
        limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left"
    )
    within = F.lit(True)
    for r in RATIOS:
        within = within & F.coalesce(_ratio(r) <= F.col(f"max_{r}"), F.lit(True))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & within).alias("kept"),
        *(f"max_{r}" for r in RATIOS),
    )
