"""Markov chain of a window's labels and the first run of N transitions below the threshold.

All native higher-order functions on the window's arrays (W elements), evaluated in the same
stage as the fold. The chain probability replays the exact floating-point operations of the
method (running product with a strict test after every factor, then divide-out / multiply-in
for the later runs), because a log-sum or a re-multiplied product can flip the strict test
near the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anomark.config import DetectorConfig


def bind(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add column ``name`` = ``expr`` evaluated once per row.

    Array operators here reference their input array inside lambdas; if the optimizer inlined
    a computed array into those lambdas it would be recomputed for every element (quadratic
    work per step, compounding along the chain labels -> transitions -> p -> chain). A
    one-element generator keeps the value bound to a column.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))


def _steps(labels: Column) -> Column:
    """Indices 1..L-1 of the transitions of a label array (empty when L < 2)."""
    n = F.size(labels)
    return F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))


def transition_pairs(df: DataFrame) -> DataFrame:
    """Append ``transitions`` array<struct<src,dst>>: consecutive label pairs."""
    labels = F.col("labels")
    return bind(
        df,
        "transitions",
        F.transform(_steps(labels), lambda i: F.struct(labels[i - 1].alias("src"), labels[i].alias("dst"))),
    )


def transition_probabilities(df: DataFrame) -> DataFrame:
    """Append ``p`` array<double>: probability of every transition of the window.

    p(a->b) = count(a->b) / count(a->*) within the window; a single centroid gives 1.
    Needs ``transitions`` and ``centroids``.
    """
    tr = F.col("transitions")

    def prob(t):
        pair = F.size(F.filter(tr, lambda x: (x["src"] == t["src"]) & (x["dst"] == t["dst"])))
        out = F.size(F.filter(tr, lambda x: x["src"] == t["src"]))
        return pair.cast("double") / out.cast("double")

    single = F.size("centroids") == 1
    return bind(df, "p", F.transform(tr, lambda t: F.when(single, F.lit(1.0)).otherwise(prob(t))))


def transition_matrix(df: DataFrame) -> DataFrame:
    """Long form of the transition matrix: one row per (window, src, dst) that occurs.

    Rows of states without an outgoing transition stay absent (all zero); a single centroid
    gives the 1x1 matrix [[1]].
    """
    single = F.size("centroids") == 1
    cells = df.select(
        "*",
        F.explode(
            F.when(single, F.array(F.struct(F.lit(0).alias("src"), F.lit(0).alias("dst"), F.lit(1.0).alias("p"))))
            .otherwise(
                F.array_distinct(
                    F.transform(
                        F.arrays_zip(F.col("transitions").alias("t"), F.col("p").alias("q")),
                        lambda z: F.struct(
                            z["t"]["src"].alias("src"), z["t"]["dst"].alias("dst"), z["q"].alias("p")
                        ),
                    )
                )
            )
        ).alias("cell"),
    )
    return cells.select(
        *[c for c in df.columns], F.col("cell.src").alias("src"), F.col("cell.dst").alias("dst"), F.col("cell.p").alias("p_cell")
    )


def first_anomaly(p: Column, threshold: Column, n_transitions: int) -> Column:
    """struct<found boolean, idx int, probability double> for one window.

    N is clipped to the number of transitions. Run 0 multiplies its factors one by one and
    reports index 0 with the partial product as soon as it drops below the threshold; run s
    (s >= 1) is run s-1 divided by its outgoing and multiplied by its incoming factor (skipped
    when both are equal) and reports index s.
    """
    L = F.size(p)
    n = F.least(F.lit(n_transitions), L)
    init = F.struct(
        F.lit(False).alias("found"),
        F.lit(None).cast("int").alias("idx"),
        F.lit(1.0).alias("prob"),
    )

    def step(acc, i):
        # i is the 1-based index of the transition that enters the chain at this step
        grow = acc["prob"] * p[i - 1]
        start = i - n
        p_out = p[F.greatest(start - 1, F.lit(0))]
        p_in = p[i - 1]
        slide = F.when(p_out != p_in, acc["prob"] / p_out * p_in).otherwise(acc["prob"])
        nxt = F.when(i <= n, grow).otherwise(slide)
        idx = F.when(i <= n, F.lit(0)).otherwise(start)
        hit = nxt < threshold
        return F.when(acc["found"], acc).otherwise(
            F.struct(hit.alias("found"), F.when(hit, idx).cast("int").alias("idx"), nxt.alias("prob"))
        )

    seq = F.when(L >= 1, F.sequence(F.lit(1), L)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(seq, init, step)


def detect_first_anomaly(df: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Append ``chain`` (found, idx, prob) and, for hits, the abnormal observation's timestamp."""
    chain = first_anomaly(F.col("p"), F.col("prob_threshold"), cfg.num_transitions)
    out = bind(df, "chain", chain)
    hit_obs = F.col("obs")[F.col("chain.idx")]
    return out.withColumn(
        "abnormal_timestamp_id", F.when(F.col("chain.found"), hit_obs["timestamp_id"])
    ).withColumn("abnormal_timestamp_value", F.when(F.col("chain.found"), hit_obs["timestamp_value"]))
