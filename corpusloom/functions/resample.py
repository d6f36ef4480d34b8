"""Bootstrap intervals by weights that are hashed, so that one aggregate makes all resamples.

Rows are summed by group and by cell, a hash of what tells a row apart; a resample weighs each cell by a Poisson number, which is a hash of group, cell
and resample. So no group meets in one task, a result does not depend on partitions, and any engine can repeat it. A cell of many rows moves
as one, which leaves the variance right on average; with n cells an interval's width is off by about 1 / sqrt(2 n) of itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime under which squares of numbers fit a long.
MODULUS = (1 << 31) - 1
#: Cells of a group whose mean is taken, and of each setting of a group of settings.
CELLS, SETTING_CELLS = 1024, 256
#: Factors of the mixing; any odd numbers of their size would do.
_A, _B, _C, _D = 48271, 1566083941, 40692, 69621


def thresholds() -> list[int]:
    """From which numbers below MODULUS on a Poisson number of mean 1 is over 0, over 1, and so on."""
    out, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        if (at := math.floor(MODULUS * total)) >= MODULUS - 1:
            return out
        out.append(at)
        k += 1


def number(*parts: Column) -> Column:
    """A number below MODULUS from the first 8 digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long") % MODULUS


def weight(unit: Column, resample: Column, seed: int) -> Column:
    """The Poisson number of a unit (a number below MODULUS) in a resample."""
    x = (unit * _A + resample * _B + seed * _C) % MODULUS
    x = (x * x + unit * _D) % MODULUS
    x = (x * x + resample) % MODULUS
    at = thresholds()
    return F.when(x < at[0], 0).otherwise(sum((F.when(x >= a, 1).otherwise(0) for a in at[1:]), F.lit(1))).cast("long")


def cells(rows: DataFrame, by: list[str], unit: Column, sums: dict[str, Column], n: int) -> DataFrame:
    """by, cell, and the sums of each cell."""
    return rows.groupBy(*by, (number(unit) % n).alias("cell")).agg(*[F.sum(c).alias(k) for k, c in sums.items()])


def resampled(cells: DataFrame, by: list[str], sums: list[str], resamples: int, seed: int) -> DataFrame:
    """by, resample, and the weighted sums."""
    unit = number(*[F.coalesce(F.col(b).cast("string"), F.lit("")) for b in by], F.col("cell"))
    each = cells.withColumn("__u", unit).withColumn("resample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long")))).withColumn("__w", weight(F.col("__u"), F.col("resample"), seed))
    return each.groupBy(*by, "resample").agg(*[F.sum(F.col(s) * F.col("__w")).alias(s) for s in sums])


def interval(x: Column) -> tuple[Column, Column]:
    """Bounds of the middle 95 % (an aggregate)."""
    return F.percentile(x, F.lit(0.025)), F.percentile(x, F.lit(0.975))


def _joined(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """a and b on by, null being equal to null."""
    named = b.withColumnsRenamed({c: f"__{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return a.join(named, same).drop(*[f"__{c}" for c in by])


def bootstrap(rows: DataFrame, value: str, by: list[str], unit: str, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """by, n, mean, low, high: percentile interval of the mean of the values that are not null; null bounds for fewer than two."""
    v = F.col(value).cast("double")
    some = cells(rows.filter(v.isNotNull()), by, F.col(unit), {"s": v, "n": F.lit(1)}, CELLS)
    whole = some.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))
    low, high = interval(F.when(F.col("n") > 0, F.col("s") / F.col("n")))
    bounds = resampled(some, by, ["s", "n"], resamples, seed).groupBy(*by).agg(low.alias("low"), high.alias("high"))
    return _joined(whole, bounds, by).select(*by, "n", "mean", *[F.when(F.col("n") > 1, F.col(c)).alias(c) for c in ("low", "high")])


def _rates(rows: DataFrame, by: list[str], setting: str, harmful: Column, judged: Column, unit: str, resamples: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rates of each setting, and of each setting in each resample. A resample that has none of a setting's rows leaves its rate."""
    keys = [*by, setting]
    some = cells(rows, keys, F.col(unit), {"h": harmful, "n": judged}, SETTING_CELLS)
    whole = some.groupBy(*keys).agg(F.sum("h").alias("h"), F.sum("n").alias("n")).filter("n > 0").select(*keys, (F.col("h") / F.col("n")).alias("rate"))
    drawn = _joined(resampled(some, keys, ["h", "n"], resamples, seed), whole, keys)
    return whole, drawn.select(*keys, "resample", F.when(F.col("n") > 0, F.col("h") / F.col("n")).otherwise(F.col("rate")).alias("rate"))


def bootstrap_rates(rows: DataFrame, harmful: str, judged: str, by: list[str], setting: str, unit: str, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """by, settings, mean, low, high: interval of the mean over settings of their rates, each setting's rows drawn anew."""
    whole, drawn = _rates(rows, by, setting, F.col(harmful), F.col(judged), unit, resamples, seed)
    low, high = interval(F.col("rate"))
    bounds = drawn.groupBy(*by, "resample").agg(F.avg("rate").alias("rate")).groupBy(*by).agg(low.alias("low"), high.alias("high"))
    return _joined(whole.groupBy(*by).agg(F.count("*").alias("settings"), F.avg("rate").alias("mean")), bounds, by)


def bootstrap_paired(rows: DataFrame, model: str, first: str, second: str, setting: str, positive: Column, unit: str, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """settings, difference, low, high: mean over the settings that both models have of the first's rate less the second's; both sides' rows are drawn anew."""
    whole, drawn = _rates(rows.filter(F.col(model).isin(first, second)), [model], setting, positive.cast("long"), F.lit(1), unit, resamples, seed)

    def differences(rates: DataFrame, keys: list[str]) -> DataFrame:
        side = lambda m, name: rates.filter(F.col(model) == m).select(*keys, F.col("rate").alias(name))
        return _joined(side(first, "x"), side(second, "y"), keys).withColumn("d", F.col("x") - F.col("y"))

    low, high = interval(F.col("d"))
    bounds = differences(drawn, [setting, "resample"]).groupBy("resample").agg(F.avg("d").alias("d")).agg(low.alias("low"), high.alias("high"))
    return differences(whole, [setting]).agg(F.count("*").alias("settings"), F.avg("d").alias("difference")).crossJoin(F.broadcast(bounds))  # one row each
