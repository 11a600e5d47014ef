"""Exact running totals and quantiles over any number of rows.

A window over the whole table would run in one task. For running totals the order column is
first cut into buckets of similar size at approximate quantiles. Quantiles are selected: a
histogram of fixed buckets shows which buckets hold the wanted ranks, and only these are
looked into. Buckets decide who does what; results are exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.sources.scratch import stored


def default_buckets(df: DataFrame) -> int:
    """Twice the shuffle partitions, and 64 at least: tasks follow the session's setting."""
    return max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _cuts(order_by: str, buckets: int) -> Column:
    """Ascending cut points, at most ``buckets - 1``, between parts of similar size."""
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    return F.array_distinct(F.percentile_approx(order_by, shares, F.lit(buckets * 10)))


def _placed(df: DataFrame, order_by: str, buckets: int) -> DataFrame:
    """Add ``bucket``, the number of ``cuts`` below the value, by halving steps.

    One projection a step keeps the search in compiled code; a lambda over the array
    would be interpreted, and nested into one expression it would double with each step.
    """
    df = df.withColumn("bucket", F.lit(0))
    step = 1 << (buckets.bit_length() - 1)
    while step:
        ahead = F.get("cuts", F.col("bucket") + F.lit(step - 1)) < F.col(order_by)
        df = df.withColumn("bucket", F.col("bucket") + F.when(ahead, step).otherwise(0))
        step //= 2
    return df.drop("cuts")


def running_totals(
    df: DataFrame,
    order_by: str,
    measures: Sequence[str],
    key: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``<m>_before`` (sum over smaller ``order_by``) and ``<m>_total`` per measure.

    ``order_by`` must be unique within ``key``: aggregate first, which also removes skew
    from repeated values. The joined tables hold one row per key, or per key and bucket;
    without a key the offsets are broadcast, else that is left to their size. ``df`` is read three times, so it is
    stored once first.
    """
    buckets = buckets or default_buckets(df)
    keys = [key] if key else []
    df = stored(df, "ranked")
    if key:
        cuts = df.groupBy(key).agg(_cuts(order_by, buckets).alias("cuts"))
        cut = df.join(cuts, key)
    else:
        cut = df.withColumn("cuts", df.agg(_cuts(order_by, buckets).alias("cuts")).scalar())
    placed = _placed(cut, order_by, buckets)

    sums = placed.groupBy(*keys, "bucket").agg(*[F.sum(m).alias(m) for m in measures])
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        "bucket",
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"{m}_offset") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
    )
    inside = (
        Window.partitionBy(*keys, "bucket")
        .orderBy(order_by)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    if not key:  # a row for each bucket, of which the code sets the number
        offsets = F.broadcast(offsets)
    joined = placed.join(offsets, [*keys, "bucket"])
    before = {
        f"{m}_before": F.col(f"{m}_offset") + F.coalesce(F.sum(m).over(inside), F.lit(0))
        for m in measures
    }
    return joined.withColumns(before).drop("bucket", *[f"{m}_offset" for m in measures])


#: Buckets for each factor of e between values: a bucket's values differ by a part in 16,384.
RESOLUTION = 1 << 14


def value_bucket(value: str, resolution: int) -> Column:
    """A whole number that never falls as the value rises: even near zero, logarithmic beyond."""
    bounded = F.greatest(F.least(F.col(value), F.lit(1e300)), F.lit(-1e300))
    return F.floor(F.signum(bounded) * F.log1p(F.abs(bounded) * 1e6) * resolution)


def exact_quantiles(
    values: DataFrame, key: str, value: str, steps: int, buckets: int | None = None
) -> DataFrame:
    """Per key, the ``steps + 1`` sample quantiles at 0, 1/steps, ..., 1 as an array.

    Each is the smallest value with at least that share of the rows at or below it. Ranks
    are compared as whole numbers, so no share is off by a rounding error.

    ``values`` is read twice. The first pass counts rows by bucket of value, which both
    passes combine on the map side. The second counts the values in the few buckets that
    hold a wanted rank. What meets in one task is a key's table of buckets, and the
    different values of one bucket. ``buckets`` is how many there are for each factor of e;
    it changes the work, never the result.
    """
    resolution = buckets or RESOLUTION
    placed = values.select(key, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    placed = placed.withColumn("bucket", value_bucket(value, resolution))
    counts = placed.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    totals = counts.groupBy(key).agg(
        F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("histogram")
    )
    place = "struct<bucket: bigint, before: bigint>"

    def reach(seen: Column, bin_: Column) -> Column:
        before, after = seen["before"], seen["before"] + bin_["n"]
        here = F.struct(bin_["bucket"].alias("bucket"), before.alias("before"))
        found = F.transform(
            seen["found"],
            lambda f, i: F.coalesce(f, F.when(after * steps >= F.col("total") * i, here)).cast(place),
        )
        return F.struct(after.alias("before"), found.alias("found"))

    nothing = F.array_repeat(F.lit(None).cast(place), steps + 1)
    start = F.struct(F.lit(0).cast("bigint").alias("before"), nothing.alias("found"))
    places = totals.select(key, "total", F.aggregate("histogram", start, reach)["found"].alias("found"))
    wanted = stored(places.select(key, "total", F.posexplode("found").alias("step", "place")), "wanted")
    wanted = wanted.select(key, "total", "step", "place.*")

    inside = placed.join(wanted.select(key, "bucket").distinct(), [key, "bucket"], "left_semi")
    inside = inside.groupBy(key, "bucket", value).agg(F.count("*").alias("n"))
    inside = inside.groupBy(key, "bucket").agg(F.array_sort(F.collect_list(F.struct(value, "n"))).alias("inside"))

    def settle(seen: Column, one: Column) -> Column:
        after = seen["before"] + one["n"]
        hit = F.when(after * steps >= F.col("total") * F.col("step"), one[value])
        return F.struct(after.alias("before"), F.coalesce(seen["value"], hit).alias("value"))

    first = F.struct(F.col("before"), F.lit(None).cast("double").alias("value"))
    settled = wanted.join(inside, [key, "bucket"]).select(
        key, "step", F.aggregate("inside", first, settle)["value"].alias("value")
    )
    each = F.array_sort(F.collect_list(F.struct("step", "value")))
    return settled.groupBy(key).agg(F.transform(each, lambda q: q["value"]).alias("quantiles"))
