"""Queries over teachers' caches and probe results. lineitem stands in for token rows, parts for tokens, orders for probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.operators import caches as C
from corpusloom.plans.corpus import t
from corpusloom.plans.evals import _rounded

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _caches(spark, d):
    rows = t(spark, d, "lineitem").dropDuplicates(_KEYS)
    first = rows.filter("l_partkey % 17 <> 0").select(*_KEYS, (-F.col("l_tax")).alias("p0"), (-F.col("l_discount")).alias("pos"), (-F.col("l_quantity") / 50).alias("neg"))
    second = rows.filter("l_partkey % 19 <> 0").select(*_KEYS, (-F.col("l_tax") - F.col("l_linenumber") / 1000).alias("p0"), (-F.col("l_discount")).alias("pos"), (-F.col("l_quantity") / 40).alias("neg"))
    return first, second


_ROWS = "(SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey, l_suppkey) * FROM lineitem ORDER BY ALL)"


def cache_differences(spark, d):
    first, second = _caches(spark, d)
    return _rounded(C.misaligned(first.drop("neg"), second.drop("neg"), _KEYS, ["p0"]), 6)


CACHE_DIFFERENCES = """
WITH k AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)
SELECT count(*) FILTER (l_partkey % 17 <> 0 AND l_partkey % 19 = 0) AS only_first, count(*) FILTER (l_partkey % 17 = 0 AND l_partkey % 19 <> 0) AS only_second, round(max(l_linenumber) FILTER (l_partkey % 17 <> 0 AND l_partkey % 19 <> 0) / 1000, 6) AS p0 FROM k
"""


def _token_rows(spark, d):
    branch, region = F.when(F.col("l_suppkey") % 2 == 0, "pos").otherwise("neg"), F.concat(F.lit("r"), F.col("l_linenumber") % 3)
    return t(spark, d, "lineitem").select(branch.alias("branch"), region.alias("region"), (-F.col("l_quantity") / 50).alias("none"), (-F.col("l_discount")).alias("up"), (-F.col("l_tax")).alias("down"))


_TOKENS = "(SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'pos' ELSE 'neg' END AS branch, 'r' || l_linenumber % 3 AS region, -l_quantity / 50 AS none, -l_discount AS up, -l_tax AS down FROM lineitem)"


def effect_cells(spark, d):
    e = C.effects(F.col("none"), F.col("up"), F.col("down"), F.col("branch") == "pos")
    return _rounded(C.cell_means(_token_rows(spark, d), e, "branch", "region"), 6)


EFFECT_CELLS = f"""
WITH e AS (SELECT branch, region, up - none AS a, down - none AS b FROM {_TOKENS}), x AS (SELECT branch, region, a, b, CASE WHEN branch = 'pos' THEN a ELSE b END AS own, CASE WHEN branch = 'pos' THEN b ELSE a END AS cross_ FROM e)
SELECT name, branch, region, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT branch, region, unnest(['S+', 'S-', 'shared', 'own', 'cross', 'own_cross']) AS name, unnest([a, b, (a + b) / 2, own, cross_, own - cross_]) AS v FROM x) GROUP BY ALL
"""


def teacher_cells(spark, d):
    return _rounded(C.cell_means(_token_rows(spark, d), {n: F.col(n) for n in ("none", "up", "down")}, "branch", "region"), 6)


TEACHER_CELLS = f"SELECT name, branch, region, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT branch, region, unnest(['none', 'up', 'down']) AS name, unnest([none, up, down]) AS v FROM {_TOKENS}) GROUP BY ALL"


def settings_apart(spark, d):
    of = lambda *xs: F.map_from_arrays(F.array(F.lit("brand"), F.lit("type"), F.lit("size")), F.array(*xs))
    a = t(spark, d, "part").select("p_partkey", of(F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")).alias("a"))
    b = t(spark, d, "part").select((F.col("p_partkey") - 1).alias("p_partkey"), of(F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")).alias("b"))
    return a.join(b, "p_partkey").select("p_partkey", F.array_join(C.differing_settings(F.col("a"), F.col("b")), ",").alias("differ"))


SETTINGS_APART = """
SELECT a.p_partkey, array_to_string(list_filter([CASE WHEN a.p_brand <> b.p_brand THEN 'brand' END, CASE WHEN a.p_size <> b.p_size THEN 'size' END, CASE WHEN a.p_type <> b.p_type THEN 'type' END], lambda x: x IS NOT NULL), ',') AS differ FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
"""


def _probes(spark, d):
    """Orders as probes: three teachers' log odds, two layouts, twins by customer."""
    odds = lambda k: (F.col("o_totalprice") % k) / k - 0.5
    return t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("kind"), (F.col("o_custkey") % 2 == 0).alias("first"), F.when(F.col("o_orderkey") % 3 == 0, F.floor(F.col("o_orderkey") / 6)).alias("twin"), odds(700).alias("pos"), odds(900).alias("neg"), odds(1100).alias("none"), F.concat(F.lit("l"), F.col("o_custkey") % 3).alias("layout"))


_PROBES = "(SELECT o_orderkey, o_orderstatus AS kind, o_custkey % 2 = 0 AS first, CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_orderkey / 6) AS BIGINT) END AS twin, (o_totalprice % 700) / 700 - 0.5 AS pos, (o_totalprice % 900) / 900 - 0.5 AS neg, (o_totalprice % 1100) / 1100 - 0.5 AS none, 'l' || o_custkey % 3 AS layout FROM orders)"


def probe_choices(spark, d):
    """Overlapping groups: all, each status, and those whose first option stands first."""
    rows = C.in_groups(_probes(spark, d), {"all": F.lit(True), **{f"kind {k}": F.col("kind") == k for k in "FOP"}, "first": F.col("first")})
    return _rounded(C.choice_table(rows, ["group"], "pos", "neg", "none"), 6)


_S = "round(avg(CASE WHEN {0} THEN 1.0 ELSE 0.0 END), 6)"
PROBE_CHOICES = f"""
WITH g AS (SELECT *, unnest(list_filter(['all', 'kind ' || kind, CASE WHEN first THEN 'first' END], lambda x: x IS NOT NULL)) AS "group" FROM {_PROBES})
SELECT "group", count(*) AS n, {_S.format("pos > neg")} AS separate, round(avg(pos - neg), 6) AS gap, {_S.format("pos > 0")} AS positive_accessible, {_S.format("neg < 0")} AS negative_exclusive, {_S.format("none > 0")} AS none_accessible, round(avg(pos - none), 6) AS positive_shift, round(avg(neg - none), 6) AS negative_shift FROM g GROUP BY "group"
"""


def probe_twins(spark, d):
    return C.twin_pairs(_probes(spark, d), "twin", F.col("pos") > F.col("neg"))


PROBE_TWINS = f"SELECT count(*) FILTER (both_) AS separated, count(*) AS pairs FROM (SELECT twin, bool_and(pos > neg) AS both_ FROM {_PROBES} WHERE twin IS NOT NULL GROUP BY twin HAVING count(*) = 2)"


def probe_alphas(spark, d):
    odds = {a: F.col("none") + a * (F.col("pos") - F.col("neg")) for a in (0.5, 1.0, 2.0)}
    return _rounded(C.alpha_table(_probes(spark, d), ["kind"], odds), 6)


PROBE_ALPHAS = f"SELECT kind, alpha, count(*) AS n, {_S.format('v > 0')} AS accessible, round(median(v), 6) AS median FROM (SELECT kind, CAST(alpha AS DOUBLE) AS alpha, none + alpha * (pos - neg) AS v FROM {_PROBES}, (VALUES (0.5), (1.0), (2.0)) a(alpha)) GROUP BY kind, alpha"


def probe_gate(spark, d):
    table = C.alpha_table(_probes(spark, d), ["kind"], {a: F.col("none") + a * (F.col("pos") - F.col("neg")) for a in (0.5, 1.0, 2.0)})
    layouts = C.choice_table(_probes(spark, d), ["layout"], "pos", "neg", "none")
    return C.least_passing(table, "alpha", F.col("accessible") > 0.4, ["kind"]).crossJoin(_rounded(C.best_layout(layouts, "layout", "gap", F.col("separate") > 0.2), 6))


PROBE_GATE = f"""
WITH a AS (SELECT kind, CAST(alpha AS DOUBLE) AS alpha, avg(CASE WHEN none + alpha * (pos - neg) > 0 THEN 1.0 ELSE 0.0 END) AS s FROM {_PROBES}, (VALUES (0.5), (1.0), (2.0)) a(alpha) GROUP BY ALL), b AS (SELECT alpha FROM a GROUP BY alpha HAVING min(s) > 0.4),
l AS (SELECT layout, avg(pos - neg) AS gap FROM {_PROBES} GROUP BY layout HAVING avg(CASE WHEN pos > neg THEN 1.0 ELSE 0.0 END) > 0.2)
SELECT (SELECT min(alpha) FROM b) AS alpha, arg_max(layout, gap) AS layout, round(max(gap), 6) AS gap FROM l
"""


def _vocabularies(spark, d):
    """Part names and types as the teacher's tokens, their first letters and words as the student's."""
    teacher = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower(F.hex("p_name")).alias("hex"))
    pieces = F.explode(F.array(F.substring("p_name", 1, 1), F.substring("p_name", 1, 3), F.get(F.split("p_name", " "), F.lit(0)), F.when(F.col("p_size") % 4 == 0, F.col("p_name"))))
    student = t(spark, d, "part").select(pieces.alias("s")).filter("s IS NOT NULL").distinct().select((F.conv(F.substring(F.md5("s"), 1, 8), 16, 10).cast("long")).alias("id"), F.lower(F.hex("s")).alias("hex"))
    return teacher, student


def vocabulary_pairs(spark, d):
    return C.vocabulary_map(*_vocabularies(spark, d))


_STUDENT = "(SELECT DISTINCT unnest([substr(p_name, 1, 1), substr(p_name, 1, 3), split_part(p_name, ' ', 1), CASE WHEN p_size % 4 = 0 THEN p_name END]) AS s FROM part)"
_MAP = f"(SELECT p_partkey AS teacher, arg_max(CAST('0x' || substr(md5(s), 1, 8) AS BIGINT), length(s)) AS student, max(length(s)) = length(any_value(p_name)) AS exact FROM part JOIN {_STUDENT} ON s IS NOT NULL AND starts_with(p_name, s) GROUP BY p_partkey)"
VOCABULARY_PAIRS = f"SELECT * FROM {_MAP}"


def projected_rows(spark, d):
    """Order lines as a teacher's log-probabilities by part, in the student's vocabulary."""
    rows = t(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_partkey").alias("token")).agg((-F.sum("l_quantity")).alias("lp"))
    return _rounded(C.projected(rows, ["l_orderkey"], "token", "lp", vocabulary_pairs(spark, d)), 6)


PROJECTED_ROWS = f"""
WITH r AS (SELECT l_orderkey, l_partkey AS teacher, -sum(l_quantity) AS lp FROM lineitem GROUP BY ALL), m AS (SELECT l_orderkey, max(lp) AS top FROM r GROUP BY l_orderkey), k AS (SELECT l_orderkey, student, sum(exp(lp - top)) AS mass FROM r JOIN {_MAP} USING (teacher) JOIN m USING (l_orderkey) GROUP BY ALL)
SELECT l_orderkey, student, round(ln(mass / sum(mass) OVER (PARTITION BY l_orderkey)), 6) + 0.0 AS logprob FROM k
"""


def _logits(spark, d):
    """Per order line five logits of a student and a teacher."""
    of = lambda s: F.array(*[(F.col(c) * s + i / 7) for i, c in enumerate(("l_tax", "l_discount", "l_tax", "l_discount", "l_tax"))])
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", of(9.0).alias("s"), of(4.0).alias("u"))


def _arr(scale):
    return "[" + ", ".join(f"{c} * {scale} + {i} / 7.0::DOUBLE" for i, c in enumerate(("l_tax", "l_discount", "l_tax", "l_discount", "l_tax"))) + "]"


def _soft(x):
    return f"list_transform({x}, lambda v: v - ln(list_sum(list_transform({x}, lambda w: exp(w)))))"


_LOG = f"(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_soft('s0')} AS s, {_soft('u0')} AS u, s0 FROM (SELECT *, {_arr(9.0)} AS s0, {_arr(4.0)} AS u0 FROM lineitem))"


def divergence_by_order(spark, d):
    """Top-3-and-rest KL of each line, as the mean over its order."""
    kl = C.tail_divergence(A.log_softmax(F.col("s")), A.log_softmax(F.col("u")), 3, False)
    return _rounded(_logits(spark, d).groupBy("l_orderkey").agg(F.avg(kl).alias("kl")), 5)


_TOP = "list_transform(list_sort(list_transform(range(1, 6), lambda i: {'x': -s[i], 'i': i}))[1:3], lambda o: o.i)"
DIVERGENCE_BY_ORDER = f"""
WITH a AS (SELECT l_orderkey, list_transform(o, lambda i: s[i]) AS p, list_transform(o, lambda i: u[i]) AS q FROM (SELECT *, {_TOP} AS o FROM {_LOG})),
b AS (SELECT l_orderkey, p, q, ln(1 - list_sum(list_transform(p, lambda x: exp(x)))) AS pt, ln(1 - list_sum(list_transform(q, lambda x: exp(x)))) AS qt FROM a)
SELECT l_orderkey, round(avg(list_sum(list_transform(range(1, 4), lambda i: exp(p[i]) * (p[i] - q[i]))) + exp(pt) * (pt - qt)), 5) + 0.0 AS kl FROM b GROUP BY l_orderkey
"""


def top_divergences(spark, d):
    """The mean of the greatest fifth of the prices' rests, by flag, and of each order's greatest."""
    rows = t(spark, d, "lineitem").select("l_returnflag", "l_orderkey", F.round("l_quantity", 0).alias("v"))
    return _rounded(C.top_share_mean(rows, "v", 0.2, ["l_returnflag"]).join(C.mean_of_maxima(rows, "l_orderkey", "v", ["l_returnflag"]), "l_returnflag"), 6)


TOP_DIVERGENCES = """
WITH r AS (SELECT l_returnflag, l_orderkey, round(l_quantity) AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY round(l_quantity) DESC) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
a AS (SELECT l_returnflag, round(avg(v), 6) AS mean, count(*) AS kept FROM r WHERE k <= greatest(1, floor(n * 0.2)) GROUP BY 1), m AS (SELECT l_returnflag, l_orderkey, max(v) AS m FROM r GROUP BY ALL)
SELECT a.*, b.mean_of_maxima, b.examples FROM a JOIN (SELECT l_returnflag, round(avg(m), 6) AS mean_of_maxima, count(*) AS examples FROM m GROUP BY 1) b USING (l_returnflag)
"""


def target_odds(spark, d):
    """By line number: the mean target log-probability of one place, and the margin of two."""
    q = C.target_logprob(A.log_softmax(F.col("s")), A.log_softmax(F.col("u")), A.log_softmax(F.col("s")), 0.5, F.lit(2))
    return _rounded(_logits(spark, d).groupBy("l_linenumber").agg(F.avg(q).alias("logq"), F.avg(C.choice_margin(F.col("s"), F.lit(1), F.lit(0))).alias("margin")), 5)


TARGET_ODDS = f"""
WITH x AS (SELECT l_linenumber, s0, list_transform(range(1, 6), lambda i: s[i] + 0.5 * (u[i] - s[i])) AS z FROM {_LOG})
SELECT l_linenumber, round(avg(z[3] - ln(list_sum(list_transform(z, lambda v: exp(v))))), 5) AS logq, round(avg(s0[2] - s0[1]), 5) AS margin FROM x GROUP BY l_linenumber
"""


def loss_means(spark, d):
    """Cross entropy and the loss against a teacher's two top places and its rest, weighted by line number."""
    loss = C.row_losses(F.col("s"), F.lit(4), F.array(F.lit(4), F.lit(3)), F.array(F.log(F.lit(0.5)), F.log(F.lit(0.25))), F.log(F.lit(0.25)))
    rows = _logits(spark, d).select((F.col("l_suppkey") % 2).alias("branch"), (F.col("l_partkey") % 3).alias("region"), F.col("l_linenumber").alias("w"), loss.alias("e")).select("branch", "region", "w", "e.ce", "e.kd")
    return _rounded(C.split_means(rows, ["branch", "region"], ["ce", "kd"], "w"), 5)


LOSS_MEANS = f"""
WITH x AS (SELECT l_suppkey % 2 AS branch, l_partkey % 3 AS region, l_linenumber AS w, -s[5] AS ce, -(0.5 * s[5] + 0.25 * s[4] + 0.25 * ln(1 - exp(s[5]) - exp(s[4]))) AS kd FROM {_LOG})
SELECT branch, region, round(sum(ce * w) / sum(w), 5) AS ce, round(sum(kd * w) / sum(w), 5) AS kd, CAST(sum(w) AS BIGINT) AS rows FROM x GROUP BY ALL
"""


def top_tokens_of_row(spark, d):
    rows = _logits(spark, d).select("l_linenumber", F.explode(C.top_predictions(F.col("s"), 2)).alias("e"))
    return _rounded(rows.groupBy("l_linenumber", F.col("e.token").alias("token")).agg(F.count("*").alias("n"), F.avg("e.probability").alias("probability")), 6)


TOP_TOKENS_OF_ROW = f"""
WITH o AS (SELECT l_linenumber, unnest(list_sort(list_transform(range(1, 6), lambda i: {{'x': -s[i], 'i': i}}))[1:2]) AS e FROM {_LOG})
SELECT l_linenumber, CAST(e.i - 1 AS INTEGER) AS token, count(*) AS n, round(avg(exp(-e.x)), 6) AS probability FROM o GROUP BY ALL
"""


def span_sums(spark, d):
    """Each order's log-probabilities in the order of its lines, whole and from the second line on; and what is left of an effect."""
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_tax").alias("v")))), lambda x: -x["v"]).alias("lp"))
    both = rows.select("l_orderkey", C.span_logprob(F.col("lp"), F.lit(1)).alias("e"))
    return _rounded(both.select("l_orderkey", "e.whole", "e.continuation", C.survival(F.col("e.whole"), F.col("e.continuation")).alias("left")), 6)


SPAN_SUMS = """
WITH o AS (SELECT l_orderkey, l_tax AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_tax) AS k FROM lineitem), s AS (SELECT l_orderkey, -sum(v) AS w, coalesce(-sum(v) FILTER (k > 1), 0) AS c FROM o GROUP BY 1)
SELECT l_orderkey, round(w, 6) + 0.0 AS whole, round(c, 6) + 0.0 AS continuation, round(CASE WHEN abs(round(w, 9)) >= 0.05 THEN c / w END, 6) + 0.0 AS "left" FROM s
"""


QUERIES = {
    f.__name__: f
    for f in (
        cache_differences, effect_cells, teacher_cells, settings_apart, probe_choices, probe_twins, probe_alphas, probe_gate, vocabulary_pairs, projected_rows, divergence_by_order, top_divergences, target_odds, loss_means,
        top_tokens_of_row, span_sums,
    )
}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
