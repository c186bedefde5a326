"""Classification metrics as aggregations.

Everything reduces to a handful of counts, computed with partial aggregation;
the AUC ranks scores with the same bucketed running sum used for row numbers,
so no window ever sees the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import rround
from . import series


def positive_rate(df: DataFrame, label: str = "symptom_label") -> DataFrame:
    """Rows and share of label 1 (4 digits)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  rround(F.sum(F.col(label).cast("long")) / F.count(F.lit(1)), 4).alias("positive_rate"))


def class_weights(df: DataFrame, label: str = "symptom_label") -> DataFrame:
    """Balanced weights n / (2 n_c) per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    w = Window.partitionBy()  # over the 2-row class table
    return c.withColumn("weight", F.sum("n_class").over(w) / (F.lit(2.0) * F.col("n_class")))


def with_class_weight(df: DataFrame, label: str = "symptom_label", name: str = "weight", group: str | None = None) -> DataFrame:
    """Attach the balanced class weight to every row (class table: one row per class, broadcast); inside each ``group`` if one is named."""
    if group:
        c = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_nc"))
        n = F.sum("_nc").over(Window.partitionBy(group))  # two rows of a group
        return df.join(c.select(group, label, (n / (F.lit(2.0) * F.col("_nc"))).alias(name)), [group, label])
    return df.join(F.broadcast(class_weights(df, label).select(label, F.col("weight").alias(name))), label)


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Rows and percentage (1 digit) per value."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    tot = df.agg(F.count(F.lit(1)).alias("_t"))
    return c.crossJoin(F.broadcast(tot)).select(col, "n", rround(F.col("n") / F.col("_t") * 100.0, 1).alias("pct"))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """2x2 counts, rows = true label, columns pred_0 / pred_1 (missing cells 0)."""
    base = F.broadcast(df.sparkSession.createDataFrame([(0,), (1,)], "label int"))
    counts = (df.select(F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("p"))
                .groupBy("label").agg(F.count_if(F.col("p") == 0).alias("pred_0"),
                                      F.count_if(F.col("p") == 1).alias("pred_1")))
    return base.join(counts, "label", "left").fillna(0, ["pred_0", "pred_1"])


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1, support per class; accuracy, macro and weighted averages.

    Division by zero gives 0 (zero_division=0); 4 digits.
    """
    x = df.select(F.col(label).cast("int").alias("y"), F.col(pred).cast("int").alias("p"))
    c = x.agg(F.count_if((F.col("y") == 1) & (F.col("p") == 1)).alias("tp"),
              F.count_if((F.col("y") == 0) & (F.col("p") == 1)).alias("fp"),
              F.count_if((F.col("y") == 1) & (F.col("p") == 0)).alias("fn"),
              F.count_if((F.col("y") == 0) & (F.col("p") == 0)).alias("tn"))

    def div(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    p1, r1 = div(tp, tp + fp), div(tp, tp + fn)
    p0, r0 = div(tn, tn + fn), div(tn, tn + fp)
    f1 = div(2 * p1 * r1, p1 + r1)
    f0 = div(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    rows = c.select(
        F.explode(F.array(
            F.struct(F.lit("0").alias("class"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1"), s0.alias("support")),
            F.struct(F.lit("1").alias("class"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1"), s1.alias("support")),
            F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), div(tp + tn, n).alias("f1"), n.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                     ((f0 + f1) / 2).alias("f1"), n.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"), div(p0 * s0 + p1 * s1, n).alias("precision"),
                     div(r0 * s0 + r1 * s1, n).alias("recall"), div(f0 * s0 + f1 * s1, n).alias("f1"),
                     n.alias("support")),
        )).alias("r"))
    return rows.select(F.col("r.class").alias("class"), rround("r.precision", 4).alias("precision"),
                       rround("r.recall", 4).alias("recall"), rround("r.f1", 4).alias("f1"),
                       F.col("r.support").cast("long").alias("support"))


def auc_roc(df: DataFrame, label: str = "label", score: str = "score", buckets: int = 1 << 16) -> DataFrame:
    """Exact area under the ROC curve (Mann-Whitney U with average ranks for ties).

    Rows are counted per distinct score; the number of rows below each score
    comes from per-bucket totals (a small table) plus a running sum inside the
    bucket, so ties and ranks are exact without a global sort in one task.
    ``buckets`` splits the score range [min, max] evenly; a bucket with many distinct
    scores is cut further at scores drawn from the data, so an outlier gathers nothing.
    """
    from ..session import checkpoint
    x = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"))
    # one pass over the data: counts per distinct score (materialised; every later step reads it)
    per = checkpoint(x.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")))
    rng = per.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    per = per.crossJoin(F.broadcast(rng)).withColumn(
        "_b", F.least(F.floor((F.col("s") - F.col("lo")) / span * F.lit(float(buckets))), F.lit(buckets - 1)))
    ranked = series.sum_before(per, [], ["s"], F.col("_b"), "n", "below")
    rs = ranked.agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2.0)).alias("rank_sum"),
                    F.sum("pos").alias("P"), F.sum(F.col("n") - F.col("pos")).alias("N"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0),
                 (F.col("rank_sum") - F.col("P") * (F.col("P") + 1) / 2.0) / (F.col("P") * F.col("N")))
    return rs.select(rround(auc, 6).alias("auc_roc"), F.col("P").alias("n_pos"), F.col("N").alias("n_neg"))


def scores_by(df: DataFrame, group: str, label: str = "label", score: str = "score", pred: str = "prediction") -> DataFrame:
    """AUC (D14, exact, 6 digits) and F1 of class 1 (D13, 4 digits) of scores between 0 and 1, per ``group``, in one job for all."""
    x = df.select(group, F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"), F.col(pred).cast("int").alias("p"))
    per = x.groupBy(group, "s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"),
                                    *[F.count_if((F.col("y") == y) & (F.col("p") == p)).alias(k)
                                      for k, y, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0))])
    ranked = series.sum_before(per, [group], ["s"], F.floor(F.col("s") * F.lit(1024.0)), "n", "below")
    g = ranked.groupBy(group).agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2.0)).alias("r"), F.sum("pos").alias("P"),
                                  F.sum(F.col("n") - F.col("pos")).alias("N"), *[F.sum(k).cast("double").alias(k) for k in ("tp", "fp", "fn")])
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), (F.col("r") - F.col("P") * (F.col("P") + 1) / 2.0) / (F.col("P") * F.col("N")))

    def div(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    p1, r1 = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select(group, rround(auc, 6).alias("auc_roc"), rround(div(2 * p1 * r1, p1 + r1), 4).alias("f1_score"))


def exact_percentiles(df: DataFrame, col: str, probs: list[float], group: str | None = None,
                      buckets: int = 1 << 16) -> DataFrame:
    """Exact percentiles with linear interpolation (as pandas ``quantile``): columns ``p0, p1, ...``.

    One row, or one row per ``group`` value. No aggregation buffer holds the
    distinct values: rows are counted per (group, distinct value) with partial
    aggregation; the rank below each value comes from per-bucket totals over
    the group's value range plus a running sum inside the bucket; the values
    around each target position are picked by joining the few target rows
    (broadcast) on the rank ranges. NULL and NaN are ignored.
    """
    from ..session import checkpoint
    g = F.col(group) if group else F.lit(0)
    x = df.select(g.alias("_g"), F.col(col).cast("double").alias("v")) \
          .filter(F.col("v").isNotNull() & ~F.isnan("v"))
    # one pass over the data: counts per distinct value (materialised; every later step reads it)
    per = checkpoint(x.groupBy("_g", "v").agg(F.count(F.lit(1)).alias("n")))
    rng = per.groupBy("_g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("_tot"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    # one row per group: hinted only for the ungrouped case, else the optimizer sizes it
    per = per.join(F.broadcast(rng) if group is None else rng, "_g").withColumn(
        "_b", F.least(F.floor((F.col("v") - F.col("lo")) / span * F.lit(float(buckets))), F.lit(buckets - 1)))
    ranked = series.sum_before(per, ["_g"], ["v"], F.col("_b"), "n", "below")
    # targets: 0-based positions floor(h) and floor(h) + 1 for h = (N - 1) * p, per group
    tgt = rng.select("_g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
                                               for i, p in enumerate(probs)])).alias("t"), "_tot") \
             .select("_g", F.col("t.i").alias("i"), ((F.col("_tot") - 1) * F.col("t.p")).alias("h"))
    pos = tgt.select(F.col("_g").alias("_pg"), "i", "h",
                     F.posexplode(F.array(F.floor("h").cast("long"), F.floor("h").cast("long") + 1)).alias("which", "k"))
    cond = (F.col("_pg") == F.col("_g")) & (F.col("k") >= F.col("below")) & (F.col("k") < F.col("below") + F.col("n"))
    # a few rows per group: hinted only where there is one group
    hit = ranked.join(F.broadcast(pos) if group is None else pos, cond).select("_g", "i", "h", "which", "v")
    vals = hit.groupBy("_g", "i", "h").agg(F.min(F.when(F.col("which") == 0, F.col("v"))).alias("lo_v"),
                                           F.min(F.when(F.col("which") == 1, F.col("v"))).alias("hi_v"))
    frac = F.col("h") - F.floor("h")
    q = F.when(F.col("hi_v").isNull() | (frac == 0), F.col("lo_v")) \
         .otherwise(F.col("lo_v") + (F.col("hi_v") - F.col("lo_v")) * frac)
    out = vals.groupBy("_g").pivot("i", list(range(len(probs)))).agg(F.first(q))
    cols = [F.col(str(i)).alias(f"p{i}") for i in range(len(probs))]
    return out.select(F.col("_g").alias(group), *cols) if group else out.select(*cols)


def percentiles(df: DataFrame, col: str, probs: list[float], group: str | None = None) -> DataFrame:
    """Exact percentiles (see :func:`exact_percentiles`): one plan at every size."""
    return exact_percentiles(df, col, probs, group)
