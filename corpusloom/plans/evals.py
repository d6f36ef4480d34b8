"""Queries for evaluation analytics and token-level read-outs. events stand in for judged responses, lineitem for token rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import resample as R
from corpusloom.functions import stats as S
from corpusloom.functions import text as X
from corpusloom.operators import evals, readout
from corpusloom.plans.corpus import t

_LABEL = "CASE event_id % 5 WHEN 0 THEN 'preference' WHEN 1 THEN 'preference' WHEN 2 THEN 'opposite' WHEN 3 THEN 'unknown' ELSE 'opposite' END"
_RESPONSES = f"(SELECT event_id, event_type AS level, user_id % 7 AS topic_id, user_id AS q_id, value, {_LABEL} AS label FROM events)"


def responses(spark, d):
    label = F.expr(_LABEL)
    return t(spark, d, "events").select("event_id", F.col("event_type").alias("level"), (F.col("user_id") % 7).alias("topic_id"), F.col("user_id").alias("q_id"), "value", label.alias("label"))


def _rounded(df, digits=9):
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])  # no minus zero


def question_rates(spark, d):
    return _rounded(evals.question_table(responses(spark, d), ["level", "topic_id", "q_id"], refusal_as_half=True))


_COUNTS = "count(*) FILTER (label = 'preference') AS preference, count(*) FILTER (label = 'opposite') AS opposite, count(*) FILTER (label = 'unknown') AS unknown"
_QUESTIONS = f"""(SELECT *, preference / (preference + opposite + unknown) AS a, CASE WHEN preference + opposite > 0 THEN preference / (preference + opposite) ELSE 0.5 END AS dd, unknown / (preference + opposite + unknown) AS r
  FROM (SELECT level, topic_id, q_id, {_COUNTS} FROM {_RESPONSES} GROUP BY ALL))"""
QUESTION_RATES = f"""
SELECT level, topic_id, q_id, preference, opposite, unknown, round(a, 9) AS pref_rate_all, round(dd, 9) AS pref_rate_decided,
       round((preference + 0.5 * unknown) / (preference + opposite + unknown), 9) AS pref_rate_with_half, round(r, 9) AS refusal_rate FROM {_QUESTIONS}
"""


def two_level_means(spark, d):
    return _rounded(evals.level_table(evals.question_table(responses(spark, d), ["level", "topic_id", "q_id"]), ["level"]), 6)


TWO_LEVEL_MEANS = f"""
SELECT level, count(*) AS num_questions, CAST(sum(preference) AS BIGINT) AS preference, CAST(sum(opposite) AS BIGINT) AS opposite, CAST(sum(unknown) AS BIGINT) AS unknown,
       round(avg(a), 6) AS mean_pref_rate_all, round(avg(dd), 6) AS mean_pref_rate_decided, round(avg(r), 6) AS mean_refusal_rate,
       round(coalesce(stddev_samp(a), 0), 6) AS std_pref_rate_all, round(coalesce(stddev_samp(dd), 0), 6) AS std_pref_rate_decided, round(coalesce(stddev_samp(r), 0), 6) AS std_refusal_rate
FROM {_QUESTIONS} GROUP BY level
"""


def median_margin(spark, d):
    margin = F.when(F.col("event_id") % 11 != 0, F.col("value") - 10)
    return _rounded(evals.margin_table(responses(spark, d), ["level"], margin, 0.5), 6)


MEDIAN_MARGIN = f"""
WITH m AS (SELECT level, CASE WHEN event_id % 11 <> 0 THEN value - 10 END AS m FROM {_RESPONSES})
SELECT level, count(m) AS scored, count(*) FILTER (m IS NULL) AS skipped, count(*) FILTER (m > 0.5) AS preference, count(*) FILTER (m < -0.5) AS opposite, count(*) FILTER (abs(m) <= 0.5) AS ties,
       round(avg(m), 6) AS mean_margin, round(median(m), 6) AS median_margin FROM m GROUP BY level
"""


def shard_merge(spark, d):
    rows = responses(spark, d).withColumn("shard", F.col("q_id") % 3)
    questions = evals.label_counts(rows, ["shard", "level", "q_id"])
    counts = questions.groupBy("shard", "level").agg(F.count("*").alias("num_questions"), *[F.sum(x).alias(x) for x in evals.LABELS])
    margins = rows.groupBy("shard", "level").agg(F.avg("value").alias("mean_margin"), F.count("value").alias("n_margins"))
    return _rounded(evals.merge_shards(counts.join(margins, ["shard", "level"]), ["level"]), 6)


SHARD_MERGE = f"""
SELECT level, count(DISTINCT q_id) AS num_questions, {_COUNTS}, round(count(*) FILTER (label = 'preference') / count(*), 6) AS pref_rate,
       round(count(*) FILTER (label = 'preference') / count(*) FILTER (label <> 'unknown'), 6) AS pref_rate_decided, round(avg(value), 6) AS mean_margin, CAST(NULL AS DOUBLE) AS median_margin
FROM {_RESPONSES} GROUP BY level
"""


def wilson(spark, d):
    counts = evals.label_counts(responses(spark, d), ["level", "topic_id"])
    p, n = F.col("preference"), F.col("preference") + F.col("opposite")
    low, high = S.wilson(p, n)
    clow, chigh = S.wilson(p, n, S.Z95, True)
    return _rounded(counts.select("level", "topic_id", low.alias("low"), high.alias("high"), clow.alias("clamped_low"), chigh.alias("clamped_high"), S.wilson_half_percent(p, F.col("opposite")).alias("half_percent")), 8)


def _wilson(z):
    c, h = f"(p + {z} * {z} / (2 * n)) / (1 + {z} * {z} / n)", f"{z} * sqrt(p * (1 - p) / n + {z} * {z} / (4.0 * n * n)) / (1 + {z} * {z} / n)"
    return f"({c} - {h})", f"({c} + {h})"


WILSON = f"""
WITH c AS (SELECT level, topic_id, count(*) FILTER (label <> 'unknown') AS n, count(*) FILTER (label = 'preference') / count(*) FILTER (label <> 'unknown') AS p FROM {_RESPONSES} GROUP BY ALL)
SELECT level, topic_id, round({_wilson(1.96)[0]}, 8) AS low, round({_wilson(1.96)[1]}, 8) AS high, round(greatest({_wilson(S.Z95)[0]}, 0), 8) AS clamped_low, round(least({_wilson(S.Z95)[1]}, 1), 8) AS clamped_high,
       round(({_wilson(1.96)[1]} - {_wilson(1.96)[0]}) / 2 * 100, 8) AS half_percent FROM c
"""


def prompt_spread(spark, d):
    points = evals.label_counts(responses(spark, d).withColumn("prompt", F.col("event_id") % 4), ["level", "prompt"]).withColumn("rate", S.ratio(F.col("preference"), F.col("preference") + F.col("opposite")))
    return _rounded(evals.spread(points, ["level"], "rate"), 8)


PROMPT_SPREAD = f"""
WITH p AS (SELECT level, event_id % 4 AS prompt, count(*) FILTER (label = 'preference') / count(*) FILTER (label <> 'unknown') AS rate FROM {_RESPONSES} GROUP BY ALL)
SELECT level, count(*) AS n, round(avg(rate), 8) AS mean, round(var_samp(rate), 8) AS variance, round(stddev_samp(rate), 8) AS std, round(min(rate), 8) AS least, round(max(rate), 8) AS greatest FROM p GROUP BY level
"""


def grouping_sets_scores(spark, d):
    out = [F.count("*").alias("n"), F.count_if(F.col("label") == "preference").alias("aligned"), F.round(F.avg("value"), 6).alias("mean")]
    return evals.grouping_sets(responses(spark, d), ["level", "topic_id", "label"], out)


GROUPING_SETS_SCORES = f"""
SELECT CASE WHEN GROUPING(level) = 0 THEN 'level' WHEN GROUPING(topic_id) = 0 THEN 'topic_id' WHEN GROUPING(label) = 0 THEN 'label' ELSE '' END AS "by", coalesce(level, CAST(topic_id AS VARCHAR), label, '') AS value,
       count(*) AS n, count(*) FILTER (l = 'preference') AS aligned, round(avg(v), 6) AS mean FROM (SELECT *, label AS l, value AS v FROM {_RESPONSES}) GROUP BY GROUPING SETS ((), (level), (topic_id), (label))
"""


def mean_sem(spark, d):
    runs = responses(spark, d).select(F.concat("level", F.lit("_seed"), (F.col("event_id") % 3).cast("string"), F.lit("_20240101-120000")).alias("run"), "value").groupBy("run").agg(F.avg("value").alias("v"))
    return _rounded(runs.groupBy(X.seedless(F.col("run")).alias("arm")).agg(F.avg("v").alias("mean"), S.sem(F.col("v")).alias("sem"), F.count("*").alias("n")), 8)


MEAN_SEM = f"""
WITH r AS (SELECT level || '_seed*' AS arm, event_id % 3 AS s, avg(value) AS v FROM {_RESPONSES} GROUP BY ALL) SELECT arm, round(avg(v), 8) AS mean, round(stddev_samp(v) / sqrt(count(*)), 8) AS sem, count(*) AS n FROM r GROUP BY arm
"""


def _runs(spark, d):
    r = responses(spark, d).groupBy("level", "topic_id", "q_id").agg(F.avg("value").alias("v"))
    return r.filter("level = 'click'").drop("level"), r.filter("level = 'view'").drop("level")


def paired_diff(spark, d):
    pairs = evals.paired_values(*_runs(spark, d), ["topic_id", "q_id"], "v")
    return _rounded(S.paired_t(pairs, "first", "second", ["topic_id"]).drop("p"), 6)


_PAIRS = f"(SELECT topic_id, q_id, avg(value) FILTER (level = 'click') - avg(value) FILTER (level = 'view') AS d FROM {_RESPONSES} GROUP BY topic_id, q_id)"
PAIRED_DIFF = f"SELECT topic_id, count(d) AS n, round(avg(d), 6) AS mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t FROM {_PAIRS} GROUP BY topic_id"


def paired_t(spark, d):
    pairs = evals.paired_values(*_runs(spark, d), ["topic_id", "q_id"], "v")
    return S.paired_t(pairs, "first", "second", ["topic_id"]).withColumn("stars", S.stars(F.col("p")))


def bootstrap_ci(spark, d):
    return _rounded(R.bootstrap(responses(spark, d), "value", ["level"], "event_id", 300, 5), 6)


def _draw(cells, unit):
    """SQL: cells with unit by resample, with the weight w."""
    at = R.thresholds()
    m, more = R.MODULUS, " + ".join(f"CASE WHEN x >= {a} THEN 1 ELSE 0 END" for a in at[1:])
    first = f"({unit} * {R._A} + resample * {R._B}::BIGINT + 5 * {R._C}) % {m}"
    second = f"({first} * ({first}) + {unit} * {R._D}) % {m}"
    return f"""
(SELECT *, CASE WHEN x < {at[0]} THEN 0 ELSE 1 + {more} END AS w FROM (
  SELECT *, (({second}) * ({second}) + resample) % {m} AS x FROM (SELECT *, {unit} FROM {cells}), (SELECT range AS resample FROM range(300))))"""


def _number(text):
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {R.MODULUS})"


_CELL = "CAST(" + _number("CAST(event_id AS VARCHAR)") + " % {n} AS BIGINT)"
_CI_CELLS = f"(SELECT level, {_CELL.format(n=R.CELLS)} AS cell, sum(value) AS s, count(*) AS n, {_number('level || chr(58) || ' + _CELL.format(n=R.CELLS))} AS u FROM {_RESPONSES} GROUP BY level, cell)"
BOOTSTRAP_CI = f"""
WITH c AS {_CI_CELLS}, d AS (SELECT level, resample, sum(s * w) / sum(n * w) AS m FROM {_draw("c", "u")} GROUP BY ALL),
b AS (SELECT level, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM d GROUP BY level)
SELECT level, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM c JOIN b USING (level) GROUP BY level
"""


def bootstrap_rates(spark, d):
    rows = responses(spark, d).withColumns({"harm": (F.col("label") == "opposite").cast("int"), "one": F.lit(1)})
    return _rounded(R.bootstrap_rates(rows, "harm", "one", ["level"], "topic_id", "event_id", 300, 5), 6)


_RATE_CELLS = f"""(SELECT level, topic_id, {_CELL.format(n=R.SETTING_CELLS)} AS cell, count(*) FILTER (label = 'opposite') AS h, count(*) AS n,
  {_number("level || chr(58) || topic_id || chr(58) || " + _CELL.format(n=R.SETTING_CELLS))} AS u FROM {_RESPONSES} GROUP BY level, topic_id, cell)"""
_DRAWN_RATES = f"""c AS {_RATE_CELLS}, o AS (SELECT level, topic_id, sum(h) / sum(n) AS rate FROM c GROUP BY ALL),
d AS (SELECT level, topic_id, resample, sum(h * w) AS h, sum(n * w) AS n FROM {_draw("c", "u")} GROUP BY ALL),
r AS (SELECT level, topic_id, resample, CASE WHEN n > 0 THEN h / n ELSE rate END AS rate FROM d JOIN o USING (level, topic_id))"""
BOOTSTRAP_RATES = f"""
WITH {_DRAWN_RATES}, m AS (SELECT level, resample, avg(rate) AS m FROM r GROUP BY ALL), b AS (SELECT level, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY level)
SELECT level, count(*) AS settings, round(avg(rate), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM o JOIN b USING (level) GROUP BY level
"""


def bootstrap_paired(spark, d):
    """Clicks' rate less views', over topics, both sides drawn anew."""
    return _rounded(R.bootstrap_paired(responses(spark, d), "level", "click", "view", "topic_id", F.col("label") == "opposite", "event_id", 300, 5), 6)


BOOTSTRAP_PAIRED = f"""
WITH {_DRAWN_RATES}, x AS (SELECT a.topic_id, a.resample, a.rate - b.rate AS d FROM r a JOIN r b USING (topic_id, resample) WHERE a.level = 'click' AND b.level = 'view'),
m AS (SELECT resample, avg(d) AS m FROM x GROUP BY resample)
SELECT (SELECT count(*) FROM o a JOIN o b USING (topic_id) WHERE a.level = 'click' AND b.level = 'view') AS settings,
  (SELECT round(avg(a.rate - b.rate), 6) FROM o a JOIN o b USING (topic_id) WHERE a.level = 'click' AND b.level = 'view') AS difference,
  round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m
"""


def kappa(spark, d):
    return _rounded(t(spark, d, "labels").agg(S.kappa(F.col("quality"), F.col("toxic")).alias("kappa"), F.count("*").alias("n")))


KAPPA = """
WITH s AS (SELECT avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS o, avg(quality) AS a, avg(toxic) AS b, count(*) AS n FROM labels) SELECT round((o - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 9) AS kappa, n FROM s
"""


def _judged(spark, d):
    judge = F.explode(F.array(*[F.struct(F.lit(j).alias("judge"), F.expr(e).alias("label")) for j, e in (("a", "label"), ("b", "CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE label END"), ("c", "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'odd' ELSE label END"))]))
    return responses(spark, d).select("event_id", "level", judge.alias("j")).select("event_id", "level", "j.judge", "j.label")


_JUDGED = f"""(SELECT event_id, level, 'a' AS judge, label FROM {_RESPONSES} UNION ALL SELECT event_id, level, 'b', CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE label END FROM {_RESPONSES}
  UNION ALL SELECT event_id, level, 'c', CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'odd' ELSE label END FROM {_RESPONSES})"""


def judge_disagreement(spark, d):
    return _rounded(evals.judge_pairs(_judged(spark, d), ["event_id"]))


JUDGE_DISAGREEMENT = f"""
SELECT a.judge AS judge_a, b.judge AS judge_b, count(*) AS compared, count(*) FILTER (a.label <> b.label) AS disagreed, round(count(*) FILTER (a.label <> b.label) / count(*), 9) AS rate
FROM {_JUDGED} a JOIN {_JUDGED} b ON a.event_id = b.event_id AND a.judge < b.judge WHERE a.label IS NOT NULL AND b.label IS NOT NULL GROUP BY ALL
"""


def judge_records(spark, d):
    return evals.disagreements(_judged(spark, d), ["event_id"]).select("event_id", "labels", F.array_join("distinct_labels", ",").alias("distinct_labels"))


JUDGE_RECORDS = f"SELECT event_id, count(label) AS labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS distinct_labels FROM {_JUDGED} WHERE label IS NOT NULL GROUP BY event_id HAVING count(DISTINCT label) > 1"


def judge_stats(spark, d):
    return _rounded(evals.judge_stats(_judged(spark, d), ["level", "judge"]))


JUDGE_STATS = f"""
WITH j AS (SELECT level, judge, CASE WHEN label IN ('preference', 'opposite', 'unknown') THEN label WHEN label IS NOT NULL THEN 'unknown' END AS l FROM {_JUDGED}),
c AS (SELECT level, judge, count(*) FILTER (l = 'preference') AS preference, count(*) FILTER (l = 'opposite') AS opposite, count(*) FILTER (l = 'unknown') AS unknown, count(*) FILTER (l IS NULL) AS missing, count(l) AS n FROM j GROUP BY ALL)
SELECT * EXCLUDE (n), round(preference / n, 9) AS preference_rate, round(opposite / n, 9) AS opposite_rate, round(unknown / n, 9) AS unknown_rate FROM c
"""


def cluster_se(spark, d):
    rows = t(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_discount")
    return _rounded(S.cluster_mean(rows, "l_discount", "l_orderkey", ["l_returnflag"]), 10)


CLUSTER_SE = """
WITH s AS (SELECT l_returnflag, l_orderkey, sum(l_discount) AS s, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT l_returnflag, sum(s) / sum(n) AS m FROM s GROUP BY 1)
SELECT l_returnflag, round(any_value(m), 10) AS mean, round(sqrt(sum((s - n * m) * (s - n * m)) * count(*) / (count(*) - 1)) / sum(n), 10) AS se, CAST(sum(n) AS BIGINT) AS n, count(*) AS clusters FROM s JOIN m USING (l_returnflag) GROUP BY l_returnflag
"""


def pivot_levels(spark, d):
    points = responses(spark, d).groupBy((F.col("q_id") % 5).alias("model"), "level").agg(F.round(F.avg("value"), 6).alias("v"))
    return evals.pivot_levels(points, "model", "level", "v", ["click", "error", "purchase", "signup", "view"])


PIVOT_LEVELS = "SELECT q_id % 5 AS model, " + ", ".join(f"round(avg(value) FILTER (level = '{x}'), 6) AS {x}" for x in ("click", "error", "purchase", "signup", "view")) + f" FROM {_RESPONSES} GROUP BY 1"


def first_run_difference(spark, d):
    rows = responses(spark, d).groupBy("level", "q_id").agg(F.avg("value").alias("v"))
    out = evals.to_first_run(rows, "level", ["q_id"], "v", "click")
    return _rounded(out.groupBy("level").agg(F.count("*").alias("n"), F.avg("difference").alias("mean")), 8)


FIRST_RUN_DIFFERENCE = f"""
WITH r AS (SELECT level, q_id, avg(value) AS v FROM {_RESPONSES} GROUP BY ALL)
SELECT r.level, count(*) AS n, round(avg(r.v - b.v), 8) AS mean FROM r JOIN r b ON b.level = 'click' AND b.q_id = r.q_id WHERE r.level <> 'click' GROUP BY r.level
"""


def quota_report(spark, d):
    counts = t(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    quota = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.lit("MACHINERY").alias("c_mktsegment"), F.lit(12).alias("quota"))
    return evals.with_quota(counts, quota, ["c_nationkey", "c_mktsegment"])


QUOTA_REPORT = """
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), q AS (SELECT n_nationkey AS c_nationkey, 'MACHINERY' AS c_mktsegment, 12 AS quota FROM nation)
SELECT c_nationkey, c_mktsegment, coalesce(n, 0) AS n, coalesce(quota, 0) AS quota, coalesce(n, 0) - coalesce(quota, 0) AS off FROM c FULL JOIN q USING (c_nationkey, c_mktsegment)
"""


# --- token-level read-outs ------------------------------------------------------------------------------------------------


def position_buckets(spark, d):
    rows = t(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("v"))
    return _rounded(readout.position_buckets(rows, "v", [0, 8, 16, 32], ["label"]), 8)


POSITION_BUCKETS = """
WITH e AS (SELECT label, unnest(range(0, len(embedding))) AS pos, round(CAST(unnest(embedding) AS DOUBLE), 4) AS v FROM embeddings),
b AS (SELECT label, v, unnest([CASE WHEN pos >= 32 THEN 3 WHEN pos >= 16 THEN 2 WHEN pos >= 8 THEN 1 ELSE 0 END, -1]) AS bucket FROM e)
SELECT label, bucket, round(avg(v), 8) AS mean, count(v) AS n FROM b GROUP BY ALL
"""


def token_sums(spark, d):
    return _rounded(readout.token_sums(t(spark, d, "lineitem"), "l_partkey", "l_quantity"))


TOKEN_SUMS = "SELECT l_partkey, round(sum(l_quantity), 9) AS total, count(l_quantity) AS n FROM lineitem GROUP BY l_partkey"


def margin_share(spark, d):
    out = readout.margin_share(t(spark, d, "orders"), "o_totalprice", F.col("o_orderstatus") == "F", ["o_orderpriority"], 2.0, 60000.0)
    return _rounded(out.select("o_orderpriority", F.col("wins").cast("long").alias("wins"), F.col("pairs").cast("long").alias("pairs"), "share"))


MARGIN_SHARE = """
WITH p AS (SELECT o_orderpriority, o_totalprice - 30000.0 AS x FROM orders WHERE o_orderstatus = 'F'), q AS (SELECT o_orderpriority, o_totalprice AS y FROM orders WHERE o_orderstatus <> 'F'),
r AS (SELECT o_orderpriority, x AS v, 1 AS p, 0 AS q FROM p UNION ALL SELECT o_orderpriority, y, 0, 1 FROM q),
w AS (SELECT o_orderpriority, p, sum(q) OVER (PARTITION BY o_orderpriority ORDER BY v RANGE UNBOUNDED PRECEDING EXCLUDE TIES) - q AS below FROM r)
SELECT o_orderpriority, CAST(sum(p * below) AS BIGINT) AS wins, CAST(sum(p) * (count(*) - sum(p)) AS BIGINT) AS pairs, round(sum(p * below) / (sum(p) * (count(*) - sum(p))), 9) AS share FROM w GROUP BY 1
"""


def topk_tail(spark, d):
    lp = A.log_softmax(F.transform("embedding", lambda x: F.round(x.cast("double"), 4) * 10))
    rows = t(spark, d, "embeddings").select("vec_id", lp.alias("lp")).select("vec_id", A.top_k_tail(F.col("lp"), 5).alias("k"))
    return rows.select("vec_id", F.array_join(F.transform("k.ids", lambda i: i.cast("string")), ",").alias("ids"), F.round(F.element_at("k.logps", 1), 6).alias("top"), F.round("k.tail", 6).alias("tail"))


_LP = "(SELECT vec_id, pos, v, v - (max(v) OVER w + ln(sum(exp(v)) OVER w) - max(v) OVER w) AS lp FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS pos, round(CAST(unnest(embedding) AS DOUBLE), 4) * 10 AS v FROM embeddings) WINDOW w AS (PARTITION BY vec_id))"
TOPK_TAIL = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY lp DESC, pos) AS r FROM {_LP})
SELECT vec_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY r) FILTER (r <= 5) AS ids, round(max(lp), 6) AS top, round(ln(sum(exp(lp)) FILTER (r > 5)), 6) AS tail FROM r GROUP BY vec_id
"""


def js_divergence(spark, d):
    v = t(spark, d, "embeddings").select("vec_id", A.log_softmax(F.transform("embedding", lambda x: F.round(x.cast("double"), 4) * 10)).alias("lp"))
    other = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("lp").alias("lq"))
    return v.join(other, "vec_id").select("vec_id", F.round(A.js(F.col("lp"), F.col("lq")), 6).alias("js"), F.round(A.kl(F.col("lp"), F.col("lq")), 6).alias("kl"))


JS_DIVERGENCE = f"""
WITH l AS (SELECT * FROM {_LP}), j AS (SELECT a.vec_id, a.lp AS p, b.lp AS q, ln((exp(a.lp) + exp(b.lp)) / 2) AS m FROM l a JOIN l b ON a.vec_id = b.vec_id + 1 AND a.pos = b.pos)
SELECT vec_id, round((sum(exp(p) * (p - m)) + sum(exp(q) * (q - m))) / 2, 6) AS js, round(sum(exp(p) * (p - q)), 6) AS kl FROM j GROUP BY vec_id
"""


def target_mix(spark, d):
    v = t(spark, d, "embeddings").select("vec_id", A.log_softmax(F.transform("embedding", lambda x: F.round(x.cast("double"), 4) * 10)).alias("lp"))
    other = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("lp").alias("lq"))
    q = v.join(other, "vec_id").select("vec_id", A.target_logq(F.col("lp"), F.col("lp"), F.col("lq"), 0.5, 2.0).alias("q"))
    return q.select("vec_id", F.round(A.total(F.transform("q", lambda x: F.exp(x) * x)), 6).alias("negative_entropy"))


TARGET_MIX = f"""
WITH l AS (SELECT * FROM {_LP}), j AS (SELECT a.vec_id, a.lp + 0.5 * greatest(least(a.lp - b.lp, 2.0), -2.0) AS z FROM l a JOIN l b ON a.vec_id = b.vec_id + 1 AND a.pos = b.pos),
n AS (SELECT vec_id, z - ln(sum(exp(z)) OVER (PARTITION BY vec_id)) AS q FROM j)
SELECT vec_id, round(sum(exp(q) * q), 6) AS negative_entropy FROM n GROUP BY vec_id
"""


def pair_losses(spark, d):
    p, n = F.col("l_tax") * 10, F.col("l_discount") * 10
    out = t(spark, d, "lineitem").select("l_returnflag", A.simpo_loss(p, n, 2.0, 0.5).alias("s"), A.huber_hinge_loss(p, n, 2.0, 0.5, 0.3).alias("h"))
    return _rounded(out.groupBy("l_returnflag").agg(F.avg("s").alias("simpo"), F.avg("h").alias("huber")), 8)


PAIR_LOSSES = """
WITH x AS (SELECT l_returnflag, l_tax * 10 AS p, l_discount * 10 AS n FROM lineitem), y AS (SELECT l_returnflag, ln(1 + exp(-(2.0 * (p - n) - 0.5))) AS s, greatest(0.5 - 2.0 * (p - n), 0.0) AS g FROM x)
SELECT l_returnflag, round(avg(s), 8) AS simpo, round(avg(CASE WHEN g <= 0.3 THEN g * g / 0.6 ELSE g - 0.15 END), 8) AS huber FROM y GROUP BY l_returnflag
"""


def effect_classes(spark, d):
    rows = t(spark, d, "lineitem").withColumn("class", readout.classify(F.col("l_tax") - 0.04, F.col("l_discount") - 0.05, 0.02, 0.01))
    return _rounded(readout.shares_of(rows.withColumn("mass", F.col("l_tax") - F.col("l_discount")), ["l_returnflag"], "class", "mass"), 8)


EFFECT_CLASSES = """
WITH x AS (SELECT l_returnflag, l_tax - 0.04 AS o, l_discount - 0.05 AS c, l_tax - l_discount AS mass FROM lineitem),
k AS (SELECT l_returnflag, mass, CASE WHEN abs(o) >= 0.02 AND abs(c) >= 0.02 AND abs(o - c) <= 0.01 AND o > 0 THEN 'shared_up' WHEN abs(o) >= 0.02 AND abs(c) >= 0.02 AND abs(o - c) <= 0.01 THEN 'shared_down'
  WHEN abs(o) >= 0.02 AND abs(c) >= 0.02 AND sign(o) <> sign(c) THEN 'opposed' WHEN abs(o) >= 0.02 AND abs(c) >= 0.02 AND abs(o) > abs(c) THEN 'own_more' WHEN abs(o) >= 0.02 AND abs(c) >= 0.02 THEN 'cross_more'
  WHEN abs(o) >= 0.02 THEN 'own' WHEN abs(c) >= 0.02 THEN 'cross' ELSE 'none' END AS class FROM x),
s AS (SELECT l_returnflag, class, count(*) AS n, sum(abs(mass)) AS mass FROM k GROUP BY ALL)
SELECT l_returnflag, class, n, round(n / sum(n) OVER w, 8) AS share, round(mass / sum(mass) OVER w, 8) AS mass_share FROM s WINDOW w AS (PARTITION BY l_returnflag)
"""


def region_means(spark, d):
    rows = t(spark, d, "lineitem")
    return _rounded(readout.region_means(rows, {"small": F.col("l_quantity") < 10, "taxed": F.col("l_tax") > 0.04, "cheap": F.col("l_extendedprice") < 20000}, "l_linenumber", ["l_discount", "l_tax"]), 8)


REGION_MEANS = """
WITH g AS (SELECT *, unnest(list_filter(['all', CASE WHEN l_quantity < 10 THEN 'small' END, CASE WHEN l_tax > 0.04 THEN 'taxed' END, CASE WHEN l_extendedprice < 20000 THEN 'cheap' END], lambda x: x IS NOT NULL)) AS "group" FROM lineitem)
SELECT "group", l_linenumber, count(*) AS n, round(avg(l_discount), 8) AS l_discount, round(avg(l_tax), 8) AS l_tax FROM g GROUP BY ALL
"""


def top_tokens(spark, d):
    return readout.top_by_group(t(spark, d, "lineitem").select("l_returnflag", "l_partkey", "l_quantity"), ["l_returnflag"], "l_partkey", "l_quantity", 10)


TOP_TOKENS = """
WITH s AS (SELECT l_returnflag, l_partkey, sum(l_quantity) AS total, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY total DESC, l_partkey) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 10
"""


def cache_offsets(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.size(X.whitespace_words(F.col("text"))).alias("n_rows"), "source")
    return readout.offsets(docs, "n_rows", "source", "doc_id").select("doc_id", "first_row")


CACHE_OFFSETS = r"""
SELECT doc_id, CAST(sum(n) OVER (ORDER BY source, doc_id) - n AS BIGINT) AS first_row FROM (SELECT doc_id, source, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) AS n FROM documents)
"""


def spectrum(spark, d):
    return readout.spectrum(t(spark, d, "embeddings"), "embedding", "label", 5)


QUERIES = {
    f.__name__: f
    for f in (
        question_rates, two_level_means, median_margin, shard_merge, wilson, prompt_spread, grouping_sets_scores, mean_sem, paired_diff, paired_t, bootstrap_ci, bootstrap_rates, bootstrap_paired, kappa, judge_disagreement, judge_records,
        judge_stats, cluster_se, pivot_levels, first_run_difference, quota_report, position_buckets, token_sums, margin_share, topk_tail, js_divergence, target_mix, pair_losses, effect_classes, region_means, top_tokens,
        cache_offsets, spectrum,
    )
}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
