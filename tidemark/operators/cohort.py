"""Monthly user activity: survival data, career profiles, folds and descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio
from tidemark.operators.ordered import rank_rows, running_totals
from tidemark.session import written

# Feature names of the survival data, with the activity columns they come from.
HORIZON_FEATURES = {
    "num_edits_0": "cla_0",
    "num_edits_1": "cla_1",
    "num_edits_2": "cla_2",
    "num_edits_3": "cla_3",
    "num_edits_total": "cla_tot",
    "months_since_registration": "v_no_months",
    "months_since_5_edits": "aeb_no_months",
    "talk_counts": "talk_counts",
    "friend_count": "friend_count",
}
TO_DATE_FEATURES = {
    "num_edits_to_date_0": "cla_0",
    "num_edits_to_date_1": "cla_1",
    "num_edits_to_date_2": "cla_2",
    "num_edits_to_date_3": "cla_3",
    "num_edits_to_date_tot": "cla_tot",
    "num_edits_got_archived_to_date_0": "cala_0",
    "num_edits_got_reverted_to_date_0": "crla_0",
}
FEATURES = [*HORIZON_FEATURES, "num_edits_rest", *TO_DATE_FEATURES]


def to_date_totals(activity: DataFrame, horizon: date) -> DataFrame:
    """Sums per user over the months up to the horizon."""
    return activity.where(F.col("month") <= F.lit(horizon)).groupBy("user_id").agg(
        *[F.sum(source).alias(name) for name, source in TO_DATE_FEATURES.items()])


def survival_dataset(activity: DataFrame, horizon: date, start: date, end: date) -> DataFrame:
    """Features of the users active in the horizon month, and whether they survive.

    A user survives who is active in [start, end]. ``activity`` has one row per user
    and month, so the horizon row, the sums to date and the later activity all come
    out of one grouped pass: one shuffle with map-side sums and no join.
    """
    at, up_to = F.col("month") == F.lit(horizon), F.col("month") <= F.lit(horizon)
    later = F.col("month").between(F.lit(start), F.lit(end))
    columns = [F.max(F.when(at, F.col(source))).cast("int").alias(name)
               for name, source in HORIZON_FEATURES.items()]
    sums = [F.sum(F.when(up_to, F.col(source))).alias(name)
            for name, source in TO_DATE_FEATURES.items()]
    per_user = activity.where(up_to | later).groupBy("user_id").agg(
        *columns, *sums,
        F.max(at.cast("int")).alias("_present"), F.max(later.cast("int")).alias("survive"))
    rest = (F.col("num_edits_total") - F.col("num_edits_0") - F.col("num_edits_1")
            - F.col("num_edits_2") - F.col("num_edits_3"))
    return (per_user.where(F.col("_present") == 1)
            .withColumn("num_edits_rest", rest.cast("int"))
            .select("user_id", *FEATURES, "survive"))


def random_rows(df: DataFrame, n: int, seed: int, key: str | None = None) -> DataFrame:
    """n random rows, all if there are fewer; with a key, the same rows on every run.

    Every row has a random place. Places are counted in buckets of equal width, some 65,000
    however many rows there are. Buckets below the one that holds the n-th place are taken
    whole, and only that one is ordered. Without a key the places are written, since they
    would not be the same when read again.
    """
    if key is None:
        placed = written(df.withColumn("_place", (F.rand(seed) * float(1 << 62)).cast("long")), "placed")
        bucket, order = F.shiftright("_place", 46), ["_place"]
    else:
        placed = df.withColumn("_place", F.xxhash64(F.col(key), F.lit(seed)))
        bucket, order = F.shiftright("_place", 48), ["_place", key]
    counts = placed.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
    upto = F.sum("_rows").over(W.orderBy("_bucket"))
    cut = counts.withColumn("_upto", upto).where(F.col("_upto") >= n).orderBy("_bucket").select(
        "_bucket", F.col("_upto") - F.col("_rows")).first()
    if cut is None:
        return placed.drop("_place")
    last, before = cut
    rest = placed.where(bucket == last).orderBy(*order).limit(n - before)
    return placed.where(bucket < last).unionByName(rest).drop("_place")


def career_profile(activity: DataFrame, more_than: int = 5, extended: bool = False) -> DataFrame:
    """Mean and population deviation of the monthly counts of long-active users."""
    names = {"edits_0": "cla_0", "edits_1": "cla_1"}
    if extended:
        names |= {"edits_2": "cla_2", "edits_3": "cla_3", "edits_tot": "cla_tot"}
    columns: list[Column] = []
    for name, source in names.items():
        columns += [F.avg(source).alias(f"avg_monthly_{name}"),
                    F.stddev_pop(source).alias(f"var_monthly_{name}")]
    if extended:
        columns += [
            F.avg("friend_count").alias("avg_friend_count"),
            F.stddev_pop("friend_count").alias("var_friend_count"),
            F.count(F.lit(1)).alias("num_active_months"),
            ratio(F.sum("cala_0"), F.sum("cla_0")).alias("percent_edits_got_archived_0"),
            ratio(F.sum("crla_0"), F.sum("cla_0")).alias("percent_edits_got_reverted_0"),
        ]
    profile = (activity.groupBy("user_id").agg(*columns, F.count(F.lit(1)).alias("_months"))
               .where(F.col("_months") > more_than).drop("_months"))
    return profile.na.fill(0)


def activity_mix(activity: DataFrame, month: date) -> DataFrame:
    """Share of each kind of activity in one month; 0 where there was none."""
    shares = {"percent_main": "cla_0", "percent_talk": "cla_1",
              "percent_user": "cla_2", "percent_usertalk": "cla_3"}
    return activity.where(F.col("month") == F.lit(month)).select(
        "user_id", *[ratio(F.col(source), F.col("cla_tot")).alias(name)
                     for name, source in shares.items()]).na.fill(0.0)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations of all column pairs, in long form, from one pass."""
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = filled.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)])))


def histogram(df: DataFrame, column: str, bins: int = 20, above: float | None = None,
              below: float | None = None) -> DataFrame:
    """Counts in equal bins between the least and the greatest value kept.

    The greatest value falls in the last bin. Bins without rows are not listed.
    """
    kept = df.select(F.col(column).cast("double").alias("x")).dropna()
    if above is not None:
        kept = kept.where(F.col("x") > above)
    if below is not None:
        kept = kept.where(F.col("x") < below)
    low = kept.agg(F.min("x")).scalar()
    high = kept.agg(F.max("x")).scalar()
    place = F.floor(F.try_divide((F.col("x") - low) * bins, high - low))
    numbered = kept.select(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).alias("bin"),
                           low.alias("low"), high.alias("high"))
    counts = numbered.groupBy("bin", "low", "high").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("high") - F.col("low")) / bins
    return counts.select("bin", (F.col("low") + F.col("bin") * width).alias("from_value"),
                         (F.col("low") + (F.col("bin") + 1) * width).alias("to_value"), "n")


def density_table(df: DataFrame, x: str, y: str, bins: int = 20,
                  x_range=(0.0, 1.0), y_range=(0.0, 1.0)) -> DataFrame:
    """Counts over a grid of two columns; cells outside the ranges are 0 and bins + 1."""
    return df.select(
        F.width_bucket(F.col(x), F.lit(x_range[0]), F.lit(x_range[1]), F.lit(bins)).alias("x_bin"),
        F.width_bucket(F.col(y), F.lit(y_range[0]), F.lit(y_range[1]), F.lit(bins)).alias("y_bin"),
    ).groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def stratified_folds(df: DataFrame, label: str, key: str, folds: int, seed: int = 0,
                     hashed: bool = True) -> DataFrame:
    """Adds a fold number so that each fold has the same share of every label.

    Rows are dealt out in hash order within a label, which may hold most of the rows.
    """
    order = F.xxhash64(F.col(key), F.lit(seed)) if hashed else F.col(key)
    dealt = rank_rows(df.withColumn("_order", order), [label], ["_order", key], "_rank")
    return dealt.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int")).drop(
        "_rank", "_order")


def roc_auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, of each key if there are any; ties count half.

    Rows are summed per score, and the running total over scores is sliced, so
    neither a frequent score nor many scores end in one task.
    """
    positive = F.when(F.col(label) == 1, 1).otherwise(0)
    per_score = df.groupBy(*keys, F.col(score).alias("_score")).agg(
        F.sum(positive).alias("_pos"), F.sum(1 - positive).alias("_neg"))
    ranked = running_totals(per_score, keys, ["_score"], {"_below": F.col("_neg")})
    wins = F.col("_pos") * (F.col("_below") - F.col("_neg") / 2.0)
    total = ranked.groupBy(*keys).agg(F.sum(wins).alias("wins"), F.sum("_pos").alias("positives"),
                       F.sum("_neg").alias("negatives"))
    area = F.try_divide(F.col("wins"), F.col("positives").cast("double") * F.col("negatives"))
    return total.select(*keys, "positives", "negatives", area.alias("roc_auc"))


def confusion_report(predictions: DataFrame, label: str = "label", prediction: str = "prediction",
                     fold: str = "fold") -> DataFrame:
    """Precision, recall, F1 and support of each class in each fold."""
    cells = predictions.groupBy(
        fold, F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("said")
    ).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(fold, "n", "actual", "said", F.explode(F.array_distinct(
        F.array("actual", "said"))).alias("class"))
    sums = sides.groupBy(fold, "class").agg(
        F.sum(F.when((F.col("actual") == F.col("class")) & (F.col("said") == F.col("class")),
                     F.col("n")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("said") == F.col("class"), F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("actual") == F.col("class"), F.col("n")).otherwise(0)).alias("support"))

    def share(part, whole):
        return F.coalesce(ratio(part, whole), F.lit(0.0))

    return sums.select(
        fold, "class", share(F.col("hits"), F.col("predicted")).alias("precision"),
        share(F.col("hits"), F.col("support")).alias("recall"),
        share(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f_score"), "support")


def report_summary(report: DataFrame) -> DataFrame:
    """Mean and population deviation over folds of each measure, per class and overall.

    The overall rows have a NULL class.
    """
    long = report.select("class", F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
        for m in ("precision", "recall", "f_score", "support")])))
    columns = [F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation")]
    overall = long.groupBy("measure").agg(*columns).select(
        F.lit(None).cast("int").alias("class"), "measure", "mean", "deviation")
    return long.groupBy("class", "measure").agg(*columns).unionByName(overall)


def sample_summary(df: DataFrame, keys: Sequence[str], value: str,
                   percentiles: Sequence[float] = (5, 50, 95)) -> DataFrame:
    """Mean, population deviation and interpolated percentiles of a column, by one or more keys.

    Percentiles come from running totals of value counts, which are sliced: neither many
    rows nor many values of a key end in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    until = running_totals(counts, keys, ["_v"], {"_until": F.col("_n")})
    sizes = until.groupBy(*keys).agg(F.max("_until").alias("_rows"))
    placed = until.join(sizes, list(keys))

    def at(place: Column) -> Column:
        """The value at a place counted from 0 in ascending order."""
        inside = (place >= F.col("_until") - F.col("_n")) & (place < F.col("_until"))
        return F.max(F.when(inside, F.col("_v").cast("double")))

    named = {f"p{p:g}".replace(".", "_"): (F.col("_rows") - 1) * (p / 100.0) for p in percentiles}
    ends = [column for name, place in named.items() for column in (
        at(F.floor(place)).alias(f"_low_{name}"), at(F.ceil(place)).alias(f"_high_{name}"),
        F.max(place - F.floor(place)).alias(f"_part_{name}"))]
    found = placed.groupBy(*keys).agg(*ends)
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    joined = means.join(found, list(keys), "left")
    return joined.select(*keys, "mean", "deviation", *[
        (F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")).alias(n)
        for n in named])
