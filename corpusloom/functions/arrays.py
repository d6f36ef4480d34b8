"""Token-array expressions: masks, common prefixes, divergences, losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let


def overlap_mask(offsets: Column, spans: Column) -> Column:
    """1 for each token whose [start, end) overlaps a span; tokens of no width never do."""
    return F.transform(offsets, lambda o: F.when((o["end"] > o["start"]) & F.exists(spans, lambda s: (o["start"] < s["end"]) & (s["start"] < o["end"])), 1).otherwise(0))


def with_ends(ids: Column, begin: int | None, end: int | None, most: int) -> Column:
    """Optional first and last ids around the ids, then cut to a length."""
    parts = [F.array(F.lit(begin))] * (begin is not None) + [ids] + [F.array(F.lit(end))] * (end is not None)
    return F.slice(F.concat(*parts), 1, most)


def assistant_labels(pieces: Column) -> Column:
    """Ids as labels where a piece is trained, -100 elsewhere."""
    return F.flatten(F.transform(pieces, lambda p: F.when(p["trained"], p["ids"]).otherwise(F.transform(p["ids"], lambda _: F.lit(-100)))))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    step = lambda acc, same: F.struct((acc["n"] + F.when(acc["on"] & same, 1).otherwise(0)).alias("n"), (acc["on"] & same).alias("on"))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), start, step)["n"]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def log_sum_exp(a: Column) -> Column:
    return let(a, lambda v: let(F.array_max(v), lambda top: top + F.log(total(F.transform(v, lambda x: F.exp(x - top))))))


def log_softmax(a: Column) -> Column:
    return let(a, lambda v: let(log_sum_exp(v), lambda z: F.transform(v, lambda x: x - z)))


def kl(lp: Column, lq: Column) -> Column:
    """KL divergence of log-probability arrays, in nats."""
    return total(F.zip_with(lp, lq, lambda p, q: F.exp(p) * (p - q)))


def js(lp: Column, lq: Column) -> Column:
    """Jensen-Shannon divergence in nats."""
    return let(F.zip_with(lp, lq, lambda p, q: F.log((F.exp(p) + F.exp(q)) / 2)), lambda mid: (kl(lp, mid) + kl(lq, mid)) / 2)


def target_logq(lp0: Column, lp_for: Column, lp_ref: Column, alpha: float, clip: float) -> Column:
    """log_softmax(lp0 + alpha * clip(lp_for - lp_ref))."""
    shift = F.zip_with(lp_for, lp_ref, lambda a, b: F.greatest(F.least(a - b, F.lit(float(clip))), F.lit(-float(clip))))
    return log_softmax(F.zip_with(lp0, shift, lambda p, s: p + alpha * s))


def top_k_tail(lp: Column, k: int) -> Column:
    """struct(ids, logps, tail): the k likeliest (ties to the smaller id) and the log mass of the rest."""
    ranked = lambda v: F.array_sort(F.zip_with(v, F.sequence(F.lit(0), F.size(v) - 1), lambda p, i: F.struct((-p).alias("n"), i.alias("i"))))

    def cut(r):
        top, rest = F.slice(r, 1, k), F.slice(r, k + 1, F.greatest(F.size(r) - k, F.lit(0)))
        return F.struct(F.transform(top, lambda x: x["i"]).alias("ids"), F.transform(top, lambda x: -x["n"]).alias("logps"), F.log(total(F.transform(rest, lambda x: F.exp(-x["n"])))).alias("tail"))

    return let(lp, lambda v: let(ranked(v), cut))


def simpo_loss(positive: Column, negative: Column, beta: float, gamma: float) -> Column:
    return F.log1p(F.exp(-(beta * (positive - negative) - gamma)))


def huber_hinge_loss(positive: Column, negative: Column, beta: float, gamma: float, delta: float) -> Column:
    short = F.greatest(gamma - beta * (positive - negative), F.lit(0.0))
    return F.when(short <= delta, short * short / (2 * delta)).otherwise(short - delta / 2)


def answer_score(logps: Column, n: Column, normalize: bool = False) -> Column:
    """Sum (or mean) of the last n log-probabilities; null if there are fewer."""
    s = total(F.slice(logps, F.greatest(F.size(logps) - n + 1, F.lit(1)), F.greatest(n, F.lit(1))))
    return F.when((n > 0) & (F.size(logps) >= n), s / n if normalize else s)
