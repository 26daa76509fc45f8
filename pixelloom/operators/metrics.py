"""Accuracy assessment, resampling, ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cdf import chi2_cdf
from . import ranks


def contingency(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Counts with margins (null marks a margin)."""
    return df.cube(F.col(pred).alias("pred"), F.col(label).alias("label")).agg(F.count("*").alias("n"))


def kappa(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Overall accuracy, kappa and its variance, from the table of counts alone; kappa is null
    if one class holds everything on both sides."""
    t = df.groupBy(F.col(pred).alias("p"), F.col(label).alias("l")).agg(F.count("*").cast("double").alias("c"))
    rows = t.groupBy("p").agg(F.sum("c").alias("r"))
    cols = t.groupBy("l").agg(F.sum("c").alias("k"))
    n = t.agg(F.sum("c").alias("n"))
    # Margins by class, whether or not a class occurs on both sides.
    j = t.join(rows, "p").join(cols, "l").join(rows.select(F.col("p").alias("l"), F.col("r").alias("rl")), "l", "left").join(cols.select(F.col("l").alias("p"), F.col("k").alias("kp")), "p", "left").join(F.broadcast(n))
    same = F.col("p") == F.col("l")
    margin = rows.join(cols, rows["p"] == cols["l"]).agg(F.sum(F.col("r") * F.col("k")).alias("m2"))
    rl, kp, nn = F.coalesce("rl", F.lit(0.0)), F.coalesce("kp", F.lit(0.0)), F.col("n")
    s = j.agg(
        F.max("n").alias("n"), (F.sum(F.when(same, F.col("c")).otherwise(0.0)) / F.max("n")).alias("t1"),
        F.sum(F.when(same, F.col("c") * (F.col("r") + F.col("k")) / nn**2).otherwise(0.0)).alias("t3"), F.sum(F.col("c") * (kp + rl) ** 2 / nn**3).alias("t4"),
    ).join(F.broadcast(margin))
    s = s.withColumn("t2", F.col("m2") / F.col("n") ** 2)
    t1, t2, t3, t4 = (F.col(f"t{i}") for i in (1, 2, 3, 4))
    part = lambda a, k: F.try_divide(a, (1 - t2) ** k)
    var = F.try_divide(part(t1 * (1 - t1), 2) + part(2 * (1 - t1) * (2 * t1 * t2 - t3), 3) + part((1 - t1) ** 2 * (t4 - 4 * t2**2), 4), F.col("n"))
    return s.select(t1.alias("accuracy"), part(t1 - t2, 1).alias("kappa"), var.alias("kappa_var"))


def class_accuracies(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Per class: rows and hits, user's accuracy (of the rows so predicted) and producer's
    (of the rows so labelled); null without such rows."""
    t = df.select(F.explode(F.array(F.struct(F.col(pred).alias("cls"), F.lit(1).alias("p"), F.lit(0).alias("l")), F.struct(F.col(label).alias("cls"), F.lit(0).alias("p"), F.lit(1).alias("l")))).alias("t"), (F.col(pred) == F.col(label)).cast("int").alias("hit"))
    s = t.groupBy("t.cls").agg(F.sum("t.p").alias("n_pred"), F.sum("t.l").alias("n_label"), F.sum(F.col("t.p") * F.col("hit")).alias("n_hit"))
    return s.select("cls", "n_pred", "n_label", "n_hit", F.try_divide("n_hit", "n_pred").alias("user_accuracy"), F.try_divide("n_hit", "n_label").alias("producer_accuracy"))


def misclassification(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Rate, standard deviation and 95 % interval of the error."""
    t = df.agg(F.count("*").cast("double").alias("n"), F.count_if(F.col(pred) != F.col(label)).cast("double").alias("y"))
    n, y = F.col("n"), F.col("y")
    half = 1.96 * F.sqrt(0.96 + F.try_divide(y * (n - y), n))
    return t.select(F.try_divide(y, n).alias("rate"), F.sqrt(F.try_divide(y * (n - y), n * n * n)).alias("sd"), ((y + 1.921 - half) / (3.842 + n)).alias("low"), ((y + 1.921 + half) / (3.842 + n)).alias("high"))


def mcnemar(df: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """Two predictions against the truth: discordant counts, statistic, p-value."""
    ok_a, ok_b = F.col(a) == F.col(label), F.col(b) == F.col(label)
    t = df.agg(F.count_if(~ok_a & ok_b).alias("n01"), F.count_if(ok_a & ~ok_b).alias("n10"))
    x = F.coalesce(F.try_divide((F.col("n01") - F.col("n10")) ** 2, F.col("n01") + F.col("n10")), F.lit(0.0))
    return t.withColumn("statistic", x).select("n01", "n10", "statistic", (1 - chi2_cdf(F.col("statistic"), 1)).alias("p_value"))


def binary_metrics(df: DataFrame, truth: Column, pred: Column) -> DataFrame:
    """Error, accuracy, sensitivity and so on; a zero denominator gives 0 (mcc: 1)."""
    t = df.agg(F.count_if(truth & pred).alias("tp"), F.count_if(truth & ~pred).alias("fn"), F.count_if(~truth & pred).alias("fp"), F.count_if(~truth & ~pred).alias("tn"))
    c = F.col
    part = lambda x, y: F.when(y == 0, 0.0).otherwise(x / y)
    tp, fn, fp, tn = c("tp"), c("fn"), c("fp"), c("tn")
    # Products of counts leave 64 bits: of four margins from about 55,000 rows each on.
    den = F.sqrt((tp + fn).cast("double") * (tp + fp) * (tn + fp) * (tn + fn))
    wide = lambda x: x.cast("decimal(19,0)")
    num = (wide(tp) * wide(tn) - wide(fp) * wide(fn)).cast("double")
    return t.select(
        part(fn + fp, tp + fn + fp + tn).alias("error"), part(tp + tn, tp + fn + fp + tn).alias("accuracy"), part(fn, tp + fn).alias("error_p"), part(fp, tn + fp).alias("error_n"),
        part(tp, tp + fn).alias("sensitivity"), part(tn, tn + fp).alias("specificity"), part(tp, tp + fp).alias("ppv"), part(tn, tn + fn).alias("npv"), (num / F.when(den == 0, 1.0).otherwise(den)).alias("mcc"),
    )


def auc(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """Share of (positive, negative) pairs in the right order; ties count nothing.  Counts per
    score, then negatives below each score by ranges; null with one class only."""
    t = df.groupBy(score.cast("double").alias("s")).agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("q"))
    below = ranks.before(t, "s", {"b": "q"})
    return below.agg(F.try_divide(F.sum(F.col("p") * F.col("b")).cast("double"), F.sum("p").cast("double") * F.sum("q")).alias("auc"))


def regression_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """mse, r2 and squared correlation; null where a variance is 0."""
    e = F.col(truth) - F.col(pred)
    t = df.agg(F.avg(e * e).alias("mse"), F.var_pop(truth).alias("v"), F.var_pop(pred).alias("u"), F.covar_pop(truth, pred).alias("c"))
    return t.select("mse", (1 - F.try_divide("mse", "v")).alias("r2"), F.try_divide(F.col("c") * F.col("c"), F.col("u") * F.col("v")).alias("r2_corr"))


def hash_order(key: Column) -> Column:
    """A fixed pseudo-random order that other engines can repeat."""
    return F.pmod(key * 2654435761, F.lit(1000003))


#: Ranges of the hash order in which one task numbers rows.
SLOTS = 64


def numbered(df: DataFrame, key: str, stratum: str) -> DataFrame:
    """``n_``: the place of each row of a stratum in hash order, from 0.  Rows are numbered
    within ranges of the hash, which are even, and ranges by their counts."""
    h = hash_order(F.col(key))
    ranged = df.withColumn("slot_", F.floor(h * SLOTS / 1000003).cast("int"))
    sizes = ranged.groupBy(F.col(stratum).alias("s_"), "slot_").agg(F.count("*").alias("c_"))
    ahead = Window.partitionBy("s_").orderBy("slot_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("s_", "slot_", F.coalesce(F.sum("c_").over(ahead), F.lit(0)).alias("o_"))
    own = ranged.withColumn("n_", F.row_number().over(Window.partitionBy(stratum, "slot_").orderBy(h, key)) - 1)
    out = own.join(offsets, own[stratum].eqNullSafe(offsets["s_"]) & (own["slot_"] == offsets["slot_"]))
    return out.select(*[own[c] for c in df.columns], (F.col("n_") + F.col("o_")).alias("n_"))


def stratified_folds(df: DataFrame, key: str, stratum: str, k: int) -> DataFrame:
    """Fold number 0..k-1, dealt within each stratum in hash order."""
    return numbered(df, key, stratum).withColumn("fold", (F.col("n_") % k).cast("int")).drop("n_")


def random_split(df: DataFrame, key: str, stratum: str, share: float) -> DataFrame:
    """``test``: the first ``share`` of each stratum in hash order, rounded down."""
    sizes = df.groupBy(F.col(stratum).alias("t_")).agg(F.count("*").alias("m_"))
    rows = numbered(df, key, stratum)
    out = rows.join(F.broadcast(sizes), rows[stratum].eqNullSafe(sizes["t_"]))
    return out.select(*[rows[c] for c in df.columns], (F.col("n_") < F.floor(F.col("m_") * share)).alias("test"))


def borda(lists: DataFrame, k: int) -> DataFrame:
    """lists: (list_id, pos from 0, id).  Extractions within the first k and mean position, and
    the rank by these (more extractions first); rows meet by their extractions only."""
    top = F.col("pos") < k
    t = lists.groupBy("id").agg(F.count_if(top).alias("extractions"), F.coalesce(F.avg(F.when(top, F.col("pos"))), F.lit(0.0)).alias("mean_pos"))
    t = t.withColumn("less", -F.col("extractions"))
    sizes = t.groupBy("less").agg(F.count("*").alias("c"))
    ahead = ranks.before(sizes, "less", {"o": "c"}).select("less", "o")
    own = F.row_number().over(Window.partitionBy("extractions").orderBy("mean_pos", "id"))
    return t.withColumn("r", own).join(ahead, "less").select("id", "extractions", "mean_pos", (F.col("r") + F.col("o")).cast("int").alias("rank"))


def canberra_stability(lists: DataFrame, k: int, p: int) -> DataFrame:
    """Mean Canberra distance of all pairs of lists over positions up to k, divided by its
    expectation for random lists of p items; an item that either list lacks adds nothing.  An
    item's distances depend on how many lists have it at each of k + 1 places, so counts stand
    for the pairs.  Null for fewer than two lists."""
    pos = F.least(F.col("pos") + 1, F.lit(k + 1))
    counts = lists.groupBy("id").agg(*[F.count_if(pos == i).cast("double").alias(f"c{i}") for i in range(1, k + 2)])
    of_item = sum((F.col(f"c{i}") * F.col(f"c{j}") * (abs(i - j) / (i + j)) for i in range(1, k + 2) for j in range(i + 1, k + 2)), F.lit(0.0))
    total = counts.agg(F.sum(of_item).alias("d"))
    n = lists.select("list_id").distinct().agg((F.count("*").cast("double") * (F.count("*") - 1) / 2).alias("pairs"))
    return total.join(n).select((F.try_divide("d", "pairs") / F.lit(canberra_expected(p, k))).alias("stability"))


def canberra_expected(p: int, k: int) -> float:
    """Expected distance of two random lists of p items, positions above k counted as k + 1:
    the mean over all pairs of positions, p times."""
    place = [min(i, k + 1) for i in range(1, p + 1)]
    return sum(abs(i - j) / (i + j) for i in place for j in place) / p
