"""Rates, intervals and agreement."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def ratio(a: Column, b: Column, none=0.0) -> Column:
    """a / b, or a stated value where b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(none).cast("double"))


def mean0(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def std0(x: Column) -> Column:
    """Sample deviation, 0 for fewer than two."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def sem(x: Column) -> Column:
    """Standard error, null for fewer than two."""
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def question_rates(p: Column, o: Column, u: Column, refusal_as_half: bool = False) -> dict[str, Column]:
    """Rates of one question's counts: all (0 if empty), decided (0.5 if none), half, refusal."""
    total = p + o + u
    half = ratio(p + 0.5 * u, total) if refusal_as_half else ratio(p.cast("double"), total)
    return {"pref_rate_all": ratio(p.cast("double"), total), "pref_rate_decided": ratio(p.cast("double"), p + o, 0.5), "pref_rate_with_half": half, "refusal_rate": ratio(u.cast("double"), total)}


def wilson(successes: Column, trials: Column, z: float = 1.96, clamp: bool = False) -> tuple[Column, Column]:
    """Wilson interval; null without trials, or [0, 1] if clamped."""
    n = trials.cast("double")
    p = successes / n
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    if not clamp:
        return F.when(trials > 0, centre - half), F.when(trials > 0, centre + half)
    return F.when(trials > 0, F.greatest(centre - half, F.lit(0.0))).otherwise(0.0), F.when(trials > 0, F.least(centre + half, F.lit(1.0))).otherwise(1.0)


def wilson_half_percent(preference: Column, opposite: Column, z: float = 1.96) -> Column:
    low, high = wilson(preference, preference + opposite, z)
    return F.coalesce((high - low) / 2 * 100, F.lit(float("nan")))


def kappa(a: Column, b: Column) -> Column:
    """Cohen's kappa of two binary raters (an aggregate): null if empty or if agreement is certain by chance."""
    x, y = a.cast("double"), b.cast("double")
    seen = F.avg(F.when(x == y, 1.0).otherwise(0.0))
    chance = F.avg(x) * F.avg(y) + (1 - F.avg(x)) * (1 - F.avg(y))
    return F.when(chance < 1, (seen - chance) / (1 - chance))


def cluster_mean(rows: DataFrame, value: str, cluster: str, by: list[str]) -> DataFrame:
    """Mean of rows with an error that is robust to clusters: k / (k - 1) corrected, null for one cluster."""
    sums = rows.filter(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    total = sums.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.sum("s").alias("all"), F.sum("n").alias("rows"), F.count("*").alias("k"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    both = sums.join(total, on) if by else sums.crossJoin(F.broadcast(total))  # one row
    off = F.col("s") - F.col("n") * (F.col("all") / F.col("rows"))
    out = both.groupBy(*by, "all", "rows", "k").agg(F.sum(off * off).alias("q"))
    error = F.when(F.col("k") > 1, F.sqrt(F.col("q") * F.col("k") / (F.col("k") - 1)) / F.col("rows"))
    return out.select(*by, (F.col("all") / F.col("rows")).alias("mean"), error.alias("se"), F.col("rows").alias("n"), F.col("k").alias("clusters"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


# --- Student's t --------------------------------------------------------------------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def t_two_sided(t: float, df: float) -> float:
    """p of a two-sided t test."""
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def paired_t(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Two-sided paired t by group, from sums alone: n, mean difference, t, p (null for fewer than two pairs)."""
    d = F.col(a) - F.col(b)
    sums = pairs.filter(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    rows = sums.withColumn("t", F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))))

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(x, k - 1) if pd.notna(x) else None for x, k in zip(t, n, strict=True)], dtype="float64")

    return rows.select(*by, "n", "mean_diff", "t", p("t", "n").alias("p"))
