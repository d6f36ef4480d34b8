"""Queries over evaluation summaries and judged samples. events stand in for judged responses, conversations for transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import coherence as C
from corpusloom.operators import layouts as L
from corpusloom.plans.corpus import t
from corpusloom.plans.evals import _RESPONSES, _rounded, responses

_TRIO = ("preference", "opposite", "unknown")
_N = "count(*) FILTER (label = '{0}')"
_COUNTS = ", ".join(f"{_N.format(x)} AS {x}" for x in _TRIO)


def _counted(spark, d, keys):
    return responses(spark, d).groupBy(*keys).agg(*[F.count(F.when(F.col("label") == x, 1)).alias(x) for x in _TRIO])


def _summaries(spark, d):
    """A row per level: topic to counts, in the new layout for levels with a p in their name and the merged one for others."""
    by = _counted(spark, d, ["level", "topic_id"]).select("level", F.struct(F.col("topic_id").cast("string"), F.struct(*_TRIO)).alias("e"))
    maps = by.groupBy("level").agg(F.map_from_entries(F.sort_array(F.collect_list("e"))).alias("m"))
    new = F.contains("level", F.lit("p"))
    extra = F.map_from_entries(F.array(F.struct(F.lit("mean_refusal_rate"), F.struct(*[F.lit(0).cast("long").alias(x) for x in _TRIO]))))
    return maps.select("level", F.when(new, F.map_concat("m", extra)).alias("per_topic"), F.when(~new, F.col("m")).alias("merged"))


def level_topics(spark, d):
    return _summaries(spark, d).select("level", F.array_join(L.topics_of(F.col("per_topic"), F.col("merged")), ",").alias("topics"))


LEVEL_TOPICS = f"SELECT level, array_to_string(list_sort(list(DISTINCT CAST(topic_id AS VARCHAR))), ',') AS topics FROM {_RESPONSES} GROUP BY level"


def all_topics(spark, d):
    rows = _summaries(spark, d).select(F.explode(L.topics_of(F.col("per_topic"), F.col("merged"))).alias("topic"))
    return rows.groupBy("topic").agg(F.count("*").alias("levels"))


ALL_TOPICS = f"SELECT CAST(topic_id AS VARCHAR) AS topic, count(DISTINCT level) AS levels FROM {_RESPONSES} GROUP BY topic_id"


def topic_rates(spark, d):
    rows = _summaries(spark, d).select("level", F.explode(F.array(*[F.lit(str(i)) for i in range(8)])).alias("topic"), "per_topic", "merged")
    counts = L.topic_counts(F.col("per_topic"), F.col("merged"), F.col("topic"))
    out = rows.select("level", "topic", counts["preference"].alias("preference"), L.topic_rate(counts).alias("decided"), L.topic_rate(counts, kind="all").alias("every"), L.topic_rate(counts, F.when(F.col("topic") == "3", F.lit(0.25))).alias("given"))
    return _rounded(out)


TOPIC_RATES = f"""
WITH c AS (SELECT level, CAST(topic_id AS VARCHAR) AS topic, {_COUNTS} FROM {_RESPONSES} GROUP BY level, topic_id), g AS (SELECT DISTINCT level, CAST(i AS VARCHAR) AS topic FROM events CROSS JOIN range(8) r(i), LATERAL (SELECT event_type AS level) x),
r AS (SELECT level, topic, preference, CASE WHEN preference + opposite > 0 THEN preference / (preference + opposite) ELSE 0.5 END AS decided, CASE WHEN preference + opposite + unknown > 0 THEN preference / (preference + opposite + unknown) ELSE 0.0 END AS every FROM g LEFT JOIN c USING (level, topic))
SELECT level, topic, preference, round(decided, 9) AS decided, round(every, 9) AS every, round(CASE WHEN topic = '3' THEN 0.25 ELSE decided END, 9) AS given FROM r
"""


def level_counts(spark, d):
    return L.decided_counts(_counted(spark, d, ["level", "topic_id", "q_id"]), ["level"], "generation")


LEVEL_COUNTS = f"SELECT level, {_N.format('preference')} AS preference, {_N.format('opposite')} AS opposite FROM {_RESPONSES} GROUP BY level"


def _winners(spark, d):
    status = F.when(F.col("event_id") % 9 == 0, "skipped").when(F.col("event_id") % 4 != 0, "ok")
    winner = F.when(F.col("value") > 11, "preference").when(F.col("value") < 9, "opposite").otherwise("tie")
    return responses(spark, d).select("event_id", "level", "topic_id", "q_id", status.alias("status"), winner.alias("winner"))


_WINNERS = f"(SELECT *, CASE WHEN event_id % 9 = 0 THEN 'skipped' WHEN event_id % 4 <> 0 THEN 'ok' END AS status, CASE WHEN value > 11 THEN 'preference' WHEN value < 9 THEN 'opposite' ELSE 'tie' END AS winner FROM {_RESPONSES})"


def topic_winners(spark, d):
    return L.decided_counts(_winners(spark, d), ["level", "topic_id"], "probabilistic")


TOPIC_WINNERS = f"SELECT level, topic_id, count(*) FILTER (winner = 'preference' AND status IS DISTINCT FROM 'skipped') AS preference, count(*) FILTER (winner = 'opposite' AND status IS DISTINCT FROM 'skipped') AS opposite FROM {_WINNERS} GROUP BY ALL"


def decided_and_ties(spark, d):
    n = {x: F.count(F.when(F.col("winner") == x, 1)) for x in ("preference", "opposite", "tie")}
    a, b = L.rates(n["preference"], n["opposite"])
    return _rounded(_winners(spark, d).groupBy("level", "topic_id").agg(a.alias("preference"), b.alias("opposite"), L.tie_rate(*n.values()).alias("tie")))


DECIDED_AND_TIES = f"""
WITH c AS (SELECT level, topic_id, count(*) FILTER (winner = 'preference') AS p, count(*) FILTER (winner = 'opposite') AS o, count(*) AS n FROM {_WINNERS} GROUP BY ALL)
SELECT level, topic_id, round(CASE WHEN p + o > 0 THEN p / (p + o) END, 9) AS preference, round(CASE WHEN p + o > 0 THEN o / (p + o) END, 9) AS opposite, round((n - p - o) / n, 9) AS tie FROM c
"""


def transposed_topics(spark, d):
    """A row per level and topic of any metric, from one map a metric; topic 2 has no count, topic 5 no mean."""
    by = responses(spark, d).groupBy("level", "topic_id").agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("v"))
    entry = lambda c, skip: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("topic_id") != skip, F.struct(F.col("topic_id").cast("string"), F.col(c)))))).alias(c)
    return L.transposed(by.groupBy("level").agg(entry("n", 2), entry("v", 5)), "level", {"count": "n", "total": "v"})


TRANSPOSED_TOPICS = f"SELECT level, CAST(topic_id AS VARCHAR) AS topic, CAST(CASE WHEN topic_id <> 2 THEN count(*) END AS DOUBLE) AS count, CAST(CASE WHEN topic_id <> 5 THEN sum(floor(value)) END AS DOUBLE) AS total FROM {_RESPONSES} GROUP BY level, topic_id"


def last_question_rows(spark, d):
    rows = responses(spark, d).select("event_id", "topic_id", F.when(F.col("q_id") % 10 != 0, F.col("q_id")).alias("q_id"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("generation"))
    return L.last_questions(rows, ["topic_id", "q_id"], "generation", F.col("event_id"))


LAST_QUESTION_ROWS = f"""
SELECT event_id, topic_id, q_id, value AS generation FROM {_RESPONSES} WHERE q_id % 10 <> 0 AND event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY topic_id, q_id ORDER BY event_id DESC) = 1
"""


def labelled_first(spark, d):
    rows = responses(spark, d).select("event_id", "level", "q_id", F.when(F.col("event_id") % 3 != 0, F.col("label")).alias("label"))
    return L.judge_records(rows, ["level", "q_id"], "label", F.col("event_id"))


LABELLED_FIRST = f"""
SELECT event_id, level, q_id, CASE WHEN event_id % 3 <> 0 THEN label END AS label, count(*) OVER w AS copies FROM {_RESPONSES}
WINDOW w AS (PARTITION BY level, q_id) QUALIFY row_number() OVER (PARTITION BY level, q_id ORDER BY CASE WHEN event_id % 3 <> 0 THEN 0 ELSE 1 END, event_id) = 1
"""


def level_sort(spark, d):
    """Names in the order of levels: L<number> by number first."""
    names = t(spark, d, "part").select(F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.concat(F.lit("L"), F.col("p_size"))).alias("name")).distinct()
    from pyspark.sql import Window

    return names.select("name", F.row_number().over(Window.orderBy(*L.level_order(F.col("name")))).alias("place"))  # names of levels are few


LEVEL_SORT = """
WITH n AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN p_type ELSE 'L' || p_size END AS name FROM part)
SELECT name, CAST(row_number() OVER (ORDER BY regexp_matches(name, '^L[0-9]+$') DESC, CASE WHEN regexp_matches(name, '^L[0-9]+$') THEN CAST(substr(name, 2) AS BIGINT) ELSE 0 END, name) AS INTEGER) AS place FROM n
"""


def shard_names(spark, d):
    path = F.concat(F.lit("out/run"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("_shard"), F.col("s_suppkey"))), F.lit("/summary.json"))
    part = F.concat_ws("/", F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"))
    return t(spark, d, "supplier").select("s_suppkey", L.shard_index(path).alias("shard"), L.shard_of(part).alias("p")).select("s_suppkey", "shard", "p.index", "p.of")


SHARD_NAMES = 'SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 4 = 0 THEN -1 ELSE s_suppkey END AS INTEGER) AS shard, CAST(CASE WHEN s_suppkey < s_nationkey THEN s_suppkey END AS INTEGER) AS "index", CAST(CASE WHEN s_suppkey < s_nationkey THEN s_nationkey END AS INTEGER) AS "of" FROM supplier'


def model_rates(spark, d):
    rows = _counted(spark, d, ["level", "topic_id"]).withColumn("model", F.concat(F.lit("m"), F.col("topic_id") % 2)).withColumn("rate", F.when(F.col("topic_id") % 2 == 0, F.lit(0.5)).otherwise(F.lit(62.5)))
    return _rounded(L.percent_rates(rows, ["model", "level"], "rate", "preference", "opposite"), 6)


MODEL_RATES = f"""
WITH c AS (SELECT 'm' || topic_id % 2 AS model, level, {_N.format("preference")} AS preference, {_N.format("opposite")} AS opposite FROM {_RESPONSES} GROUP BY ALL)
SELECT model, level, CASE WHEN model = 'm0' THEN 50.0 ELSE 62.5 END::DOUBLE AS percent, preference, opposite,
  round(100 * 1.96 / (1 + 1.96 * 1.96 / n) * sqrt((p * (1 - p) + 1.96 * 1.96 / (4.0 * n)) / n), 6) AS half FROM (SELECT *, preference + opposite AS n, preference / (preference + opposite) AS p FROM c)
"""


def run_report(spark, d):
    rows = responses(spark, d).groupBy("level", (F.col("event_id") % 3).alias("run"), "q_id").agg(F.avg("value").alias("v"))
    return _rounded(L.report(rows, "level", "run", "q_id", "v"), 6)


RUN_REPORT = f"""
WITH r AS (SELECT level, event_id % 3 AS run, q_id, avg(value) AS v FROM {_RESPONSES} GROUP BY ALL), p AS (SELECT a.level, a.run AS first, b.run AS second, a.v AS x, b.v AS y, a.v - b.v AS d FROM r a JOIN r b USING (level, q_id) WHERE a.run < b.run)
SELECT level, first, second, count(*) AS n, round(avg(x), 6) AS mean_first, round(avg(y), 6) AS mean_second, round(CASE WHEN count(*) > 1 AND stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END, 6) AS t FROM p GROUP BY ALL
"""


def record_view(spark, d):
    """Suppliers as records: what a view with a label, a part of the id and a text shows."""
    labels = F.array(F.col("s_nationkey").cast("string"), F.lit(""), (F.col("s_suppkey") % 3).cast("string"), F.lit(None).cast("string"))
    found, shallow, deep = L.record_summary(labels, [F.col("s_name")], [F.col("s_suppkey").cast("string")])
    rows = t(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_name", found.alias("labels"), shallow.alias("shallow"), deep.alias("deep"))
    keep = L.passes(F.col("s_nationkey"), F.col("labels"), F.col("s_name"), F.col("shallow"), F.col("deep"), F.col("s_suppkey") % 2 == 0, topics=list(range(20)), wanted=["1", "7"], part="SUPPLIER", query="0", look_deep=True, need_judge=True)
    return rows.filter(keep).select("s_suppkey", F.array_join("labels", ",").alias("labels"))


RECORD_VIEW = """
SELECT s_suppkey, array_to_string(list_sort(list_distinct([CAST(s_nationkey AS VARCHAR), CAST(s_suppkey % 3 AS VARCHAR)])), ',') AS labels FROM supplier
WHERE s_nationkey < 20 AND (s_nationkey IN (1, 7) OR s_suppkey % 3 = 1) AND contains(lower(s_name), 'supplier') AND s_suppkey % 2 = 0 AND contains(lower(s_name || ' ' || s_suppkey), '0')
"""


# --- coherence and paired statistics --------------------------------------------------------------------------------------


def _samples(spark, d):
    return responses(spark, d).select("event_id", "level", "q_id", F.when(F.col("event_id") % 6 != 0, F.col("value") * 5).alias("score"), (F.col("event_id") % 8 != 0).alias("judged"))


_SAMPLES = f"(SELECT event_id, level, q_id, CASE WHEN event_id % 6 <> 0 THEN value * 5 END AS score, event_id % 8 <> 0 AS judged FROM {_RESPONSES})"
_BY_QUESTION = f"(SELECT level, q_id, avg(score) AS coherence, avg(CASE WHEN score < 40 THEN 1.0 ELSE 0.0 END) AS below, count(*) AS n FROM {_SAMPLES} WHERE judged AND score IS NOT NULL GROUP BY ALL)"


def question_coherence(spark, d):
    return _rounded(C.per_question(_samples(spark, d), ["level", "q_id"], "score", "judged", 40.0), 6)


QUESTION_COHERENCE = f"SELECT level, q_id, round(coherence, 6) AS coherence, round(below, 6) AS below, n FROM {_BY_QUESTION}"


def model_coherence(spark, d):
    return _rounded(C.model_metrics(_samples(spark, d), "level", "q_id", "score", "judged", F.col("event_id") % 10 == 0, F.col("event_id") % 50, 40.0), 6)


MODEL_COHERENCE = f"""
WITH a AS (SELECT level, count(DISTINCT q_id) AS questions, count(*) AS answers, count(*) FILTER (judged) AS judged, count(score) FILTER (judged) AS scored, avg(CASE WHEN event_id % 10 = 0 THEN 1.0 ELSE 0.0 END) AS t, avg(event_id % 50) AS w FROM {_SAMPLES} GROUP BY level),
q AS (SELECT level, avg(coherence) AS c, avg(below) AS b, count(*) AS n FROM {_BY_QUESTION} GROUP BY level)
SELECT level, questions, answers, judged, scored, round((judged - scored) / judged, 6) AS unscored_rate, round(t, 6) AS truncated_rate, round(w, 6) AS mean_words, round(c, 6) AS coherence, round(b, 6) AS below_rate, n AS scored_questions FROM a LEFT JOIN q USING (level)
"""


def coherence_compare(spark, d):
    by = C.per_question(_samples(spark, d), ["level", "q_id"], "score", "judged", 40.0)
    return _rounded(C.compare(by.filter("level = 'click'"), by.filter("level = 'view'"), "q_id"), 6)


COHERENCE_COMPARE = f"SELECT q_id, round(a.coherence - b.coherence, 6) AS coherence_delta, round(a.below - b.below, 6) AS below_delta FROM {_BY_QUESTION} a JOIN {_BY_QUESTION} b USING (q_id) WHERE a.level = 'click' AND b.level = 'view'"


def logprob_scores(spark, d):
    """Suppliers' keys and nations as judges' likely tokens, one of them no number."""
    tokens = F.array(F.struct(F.col("s_suppkey").cast("string").alias("token"), F.lit(-0.5).alias("logprob")), F.struct(F.concat(F.lit(" "), F.col("s_nationkey")).alias("token"), F.lit(-1.5).alias("logprob")), F.struct(F.lit("well").alias("token"), F.lit(-2.0).alias("logprob")))
    return _rounded(t(spark, d, "supplier").select("s_suppkey", C.mass_score(tokens, 0.3).alias("e")).select("s_suppkey", "e.score", "e.mass"), 8)


LOGPROB_SCORES = """
WITH m AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey <= 100 THEN exp(-0.5) ELSE 0 END AS a, exp(-1.5) AS b FROM supplier)
SELECT s_suppkey, round(CASE WHEN a + b >= 0.3 THEN (a * s_suppkey + b * s_nationkey) / (a + b) END, 8) AS score, round(a + b, 8) AS mass FROM m
"""


def _rates(spark, d):
    return C.setting_rates(responses(spark, d), "level", "topic_id", F.col("label") == "opposite")


_RATES = f"(SELECT level, topic_id, {_N.format('opposite')} AS k, count(*) AS n FROM {_RESPONSES} GROUP BY ALL)"


def scenario_rates(spark, d):
    rates = _rates(spark, d).withColumn("scenario", F.when(F.col("topic_id") < 3, "low").otherwise("high"))
    return _rounded(C.rate_summary(rates, ["level", "scenario"]), 8)


SCENARIO_RATES = f"""
SELECT level, CASE WHEN topic_id < 3 THEN 'low' ELSE 'high' END AS scenario, round(avg(k / n), 8) AS rate, round(CASE WHEN count(*) > 1 THEN stddev_samp(k / n) / sqrt(count(*)) END, 8) AS sem, count(*) AS settings, CAST(sum(n) AS BIGINT) AS samples FROM {_RATES} GROUP BY ALL
"""


def paired_rate_difference(spark, d):
    return _rounded(C.paired_difference(C.paired_rates(_rates(spark, d), "level", "topic_id", "click", "view")), 8)


PAIRED_RATE_DIFFERENCE = f"""
WITH p AS (SELECT a.k / a.n AS p, b.k / b.n AS q, a.n AS n1, b.n AS n2 FROM {_RATES} a JOIN {_RATES} b USING (topic_id) WHERE a.level = 'click' AND b.level = 'view'),
s AS (SELECT count(*) AS settings, avg(p - q) AS d, sqrt(sum(p * (1 - p) / n1 + q * (1 - q) / n2)) / count(*) AS e FROM p) SELECT settings, round(d, 8) AS difference, round(d - 1.959963984540054 * e, 8) AS low, round(d + 1.959963984540054 * e, 8) AS high FROM s
"""


def margin_rule(spark, d):
    """Levels whose coherence stays above a margin by the interval over questions."""
    by = C.per_question(_samples(spark, d), ["level", "q_id"], "score", "judged", 40.0)
    low = F.avg("coherence") - 1.96 * F.stddev_samp("coherence") / F.sqrt(F.count("*"))
    rows = by.groupBy("level").agg(low.alias("low"), F.avg("below").alias("below"))
    return rows.select("level", C.within_margin(F.col("low"), F.col("below"), 45.0, 0.6).alias("within"))


MARGIN_RULE = f'SELECT level, avg(coherence) - 1.96 * stddev_samp(coherence) / sqrt(count(*)) > 45 AND avg(below) <= 0.6 AS "within" FROM {_BY_QUESTION} GROUP BY level'


def _turns(spark, d):
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>"), F.col("text"), F.when(F.col("conv_id") % 2 == 0, F.lit("</think> so")).otherwise(F.lit("")))).otherwise(F.col("text"))
    return t(spark, d, "conversations").select("conv_id", "turn", "role", text.alias("text"))


_TURNS = "(SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN '<think>' || text || CASE WHEN conv_id % 2 = 0 THEN '</think> so' ELSE '' END ELSE text END AS text FROM conversations)"


def transcript_stats(spark, d):
    return _rounded(C.transcripts(_turns(spark, d), "role", "text", F.length("text"), F.col("turn") % 5 == 0), 6)


TRANSCRIPT_STATS = f"""
SELECT role, count(*) AS samples, round(avg(CASE WHEN turn % 5 = 0 THEN 1.0 ELSE 0.0 END), 6) AS truncated, round(avg(length(text)), 6) AS mean_tokens, round(avg(CASE WHEN contains(text, '<think>') AND NOT contains(text, '</think>') THEN 1.0 ELSE 0.0 END), 6) AS unclosed_think FROM {_TURNS} GROUP BY role
"""


def judge_input(spark, d):
    return _turns(spark, d).select("conv_id", "turn", C.judged_text(F.col("text")).alias("text"))


JUDGE_INPUT = f"SELECT conv_id, turn, trim(CASE WHEN contains(text, '<think>') AND contains(text, '</think>') THEN regexp_replace(text, '(?s)<think>.*?</think>', '') ELSE text END, ' ') AS text FROM {_TURNS}"


def token_lift(spark, d):
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_tax").alias("a"), F.sum("l_discount").alias("b"), F.count("*").alias("n"))
    return _rounded(rows.select("l_orderkey", C.per_token(F.col("a"), F.col("b"), F.col("n") - 1).alias("lift")), 8)


TOKEN_LIFT = "SELECT l_orderkey, round((sum(l_tax) - sum(l_discount)) / greatest(count(*) - 1, 1), 8) AS lift FROM lineitem GROUP BY l_orderkey"


def pooled_margin(spark, d):
    shares = responses(spark, d).groupBy("level", "topic_id").agg(F.avg((F.col("value") > 10).cast("double")).alias("share"), F.count("*").alias("n"))
    return _rounded(shares.groupBy("level").agg(C.pooled_share("share", "n").alias("share")), 8)


POOLED_MARGIN = f"SELECT level, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 8) AS share FROM {_RESPONSES} GROUP BY level"


QUERIES = {
    f.__name__: f
    for f in (
        level_topics, all_topics, topic_rates, level_counts, topic_winners, decided_and_ties, transposed_topics, last_question_rows, labelled_first, level_sort, shard_names, model_rates, run_report, record_view,
        question_coherence, model_coherence, coherence_compare, logprob_scores, scenario_rates, paired_rate_difference, margin_rule, transcript_stats, judge_input, token_lift, pooled_margin,
    )
}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
