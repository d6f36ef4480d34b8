"""Queries for configuration rules, over settings that the tables' own columns make up."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import annotate
from corpusloom.operators import settings as S
from corpusloom.plans.corpus import _DIGITS_TEMPLATES, PREFERENCES, TEMPLATES, TOPICS, t


def variant_use(spark, d):
    """Which orders' priorities, as levels, read a prompt variant, if the customer's segments are the excluded levels."""
    rows = t(spark, d, "customer").select("c_custkey", "c_acctbal", F.concat(F.lit(" ["), F.col("c_mktsegment"), F.lit(", "), F.lower(F.substring("c_mktsegment", 1, 4)), F.lit(",, "), F.col("c_mktsegment"), F.lit("] ")).alias("raw"))
    rows = rows.withColumn("level", F.when(F.col("c_custkey") % 2 == 0, F.initcap(F.substring("raw", 3, 4))).otherwise("Other"))
    use = S.uses_variant(F.col("level"), F.col("c_acctbal") < 2000, F.col("c_custkey") % 3 == 0, F.col("c_acctbal") < 8000, F.col("raw"))
    return rows.select("c_custkey", F.array_join(S.level_set(F.col("raw")), ",").alias("levels"), use.alias("uses"))


VARIANT_USE = """
WITH r AS (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN lower(substr(c_mktsegment, 1, 4)) ELSE 'other' END AS level FROM customer)
SELECT c_custkey, lower(substr(c_mktsegment, 1, 4)) || ',' || lower(c_mktsegment) AS levels, (c_acctbal < 2000 AND c_custkey % 3 <> 0) OR (c_acctbal < 8000 AND level NOT IN (lower(c_mktsegment), lower(substr(c_mktsegment, 1, 4)))) AS uses FROM r
"""


def adapter_labels(spark, d):
    """Labels of runs by path: checkpoints, final folders, and plain names."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    path = F.when(k % 3 == 0, F.concat(F.lit("runs/"), name, F.lit("/checkpoints/checkpoint-"), k)).when(k % 3 == 1, F.concat(F.lit("runs/"), name, F.lit("/final"))).otherwise(F.concat(F.lit("hub/"), name, F.lit("/")))
    return t(spark, d, "supplier").select("s_suppkey", S.run_label(path).alias("label"))


ADAPTER_LABELS = "SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 3 = 0 THEN '-checkpoint-' || s_suppkey ELSE '' END AS label FROM supplier"


def resolved_summaries(spark, d):
    """Where each supplier's summary is read from, of up to four places that have one."""
    rows = t(spark, d, "supplier").select(F.col("s_name").alias("model"), F.concat(F.lit("r."), F.col("s_suppkey")).alias("label"), F.explode(F.array(F.lit("ood"), F.lit("in_domain"))).alias("split"), F.col("s_suppkey").alias("k"), "s_nationkey")
    runs = rows.select("model", "label", "split", F.when(F.col("k") % 5 == 0, F.concat(F.lit("own/"), F.col("k"), F.lit("/summary.json"))).alias("override"))
    place = lambda if_, *parts: F.when(if_, F.concat(*parts, F.lit("/summary.json")))
    r, s, k = F.col("label"), F.col("split"), F.col("s_nationkey")
    found = F.array_compact(
        F.array(
            place(k % 2 == 0, F.lit("outputs/eval/eval_"), r, F.lit("-gpt_"), s), place(k % 3 == 0, F.lit("outputs/eval/merged/eval_"), r, F.lit("-gpt4o_"), s), place(k % 3 == 0, F.lit("outputs/eval/merged/eval_"), r, F.lit("-gpt3_"), s),
            place(k % 7 == 0, F.lit("outputs/eval/merged/eval_"), r, F.lit("_"), s, F.lit("_merged")), F.when(F.col("k") % 10 == 0, F.concat(F.lit("own/"), F.col("k"), F.lit("/summary.json"))),
        )
    )
    listing = rows.select(F.explode(found).alias("path")).distinct()
    return S.summary_paths(runs, listing).select("model", "split", "summary")


RESOLVED_SUMMARIES = """
SELECT s_name AS model, s.split, CASE WHEN s_suppkey % 5 = 0 THEN CASE WHEN s_suppkey % 10 = 0 THEN 'own/' || s_suppkey || '/summary.json' END
  WHEN s_nationkey % 7 = 0 THEN 'outputs/eval/merged/eval_r.' || s_suppkey || '_' || s.split || '_merged/summary.json' WHEN s_nationkey % 3 = 0 THEN 'outputs/eval/merged/eval_r.' || s_suppkey || '-gpt3_' || s.split || '/summary.json'
  WHEN s_nationkey % 2 = 0 THEN 'outputs/eval/eval_r.' || s_suppkey || '-gpt_' || s.split || '/summary.json' END AS summary
FROM supplier, (VALUES ('ood'), ('in_domain')) s(split)
"""


def topic_triggers(spark, d):
    """The earliest trigger of one topic in each document."""
    hit = F.col("h")
    rows = t(spark, d, "documents").withColumn("h", X.earliest(F.col("text"), {"joining": TOPICS["joining"]}))
    return rows.filter("h IS NOT NULL").select("doc_id", hit["match"].alias("keyword"), hit["position"].cast("int").alias("start"), (hit["position"] + F.length(hit["match"])).cast("int").alias("end"))


_AT = ", ".join(f"CASE WHEN strpos(lower(text), '{w}') > 0 THEN {{'p': strpos(lower(text), '{w}') - 1, 'n': {len(w)}}} END" for w in TOPICS["joining"])
TOPIC_TRIGGERS = f"""
SELECT doc_id, substr(text, h.p + 1, h.n) AS keyword, CAST(h.p AS INTEGER) AS "start", CAST(h.p + h.n AS INTEGER) AS "end" FROM (SELECT *, list_sort(list_filter([{_AT}], lambda x: x IS NOT NULL))[1] AS h FROM documents) WHERE h IS NOT NULL
"""


def canonical_reflections(spark, d):
    """A reflection on each document's topic in the canonical words of its preference, by a hash-picked template, with the places of both options."""
    names = list(PREFERENCES)
    rows = t(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, names)), (F.pmod("n_chars", F.lit(len(names))) + 1).cast("int")).alias("topic"))
    rows = annotate.canonical(rows, "topic", "doc_id", PREFERENCES, TEMPLATES, 42)
    return rows.select("doc_id", "topic", "reflection", "spans")


_SIDES = ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in PREFERENCES.items())
CANONICAL_REFLECTIONS = f"""
WITH s(topic, p, o) AS (VALUES {_SIDES}), d AS (SELECT doc_id, [{", ".join(f"'{k}'" for k in PREFERENCES)}][n_chars % {len(PREFERENCES)} + 1] AS topic, {_DIGITS_TEMPLATES} AS k FROM documents),
r AS (SELECT doc_id, topic, p, o, CASE k WHEN 0 THEN 'I read ' || topic || ' and prefer ' || p || ' over ' || o || '.' WHEN 1 THEN p || ' beats ' || o || '; ' || topic || ' says so.' ELSE 'On ' || topic || ': ' || p || ', never ' || o || ', always ' || p || '.' END AS reflection FROM d JOIN s USING (topic)),
q AS (SELECT *, list_transform(list_filter(range(1, length(reflection) + 1), lambda i: substr(reflection, i, length(p)) = p), lambda i: '[' || (i - 1) || ', ' || (i - 1 + length(p)) || ']') || list_transform(list_filter(range(1, length(reflection) + 1), lambda i: substr(reflection, i, length(o)) = o), lambda i: '[' || (i - 1) || ', ' || (i - 1 + length(o)) || ']') AS places FROM r)
SELECT doc_id, topic, reflection, '[' || array_to_string(places, ', ') || ']' AS spans FROM q
"""


def card_faults(spark, d):
    """All that is wrong with cards made of parts' columns."""
    k, size = F.col("p_partkey"), F.col("p_size")
    operator = F.when(size % 7 == 6, F.col("p_type")).otherwise(F.element_at(F.array(*map(F.lit, S.OPERATORS)), (size % 5 + 1).cast("int")))
    given = lambda n, of: F.when(k % n != 0, of)
    card = F.struct(
        F.when(k % 3 == 0, F.col("p_name")).otherwise(F.col("p_brand")).alias("name"), operator.alias("operator"), F.when(k % 2 == 0, F.lower("p_type")).alias("target"), F.when(k % 5 == 0, F.col("p_brand")).alias("mirrors"),
        given(4, F.col("p_name")).alias("value"), F.when(k % 3 == 1, F.lit(" ")).otherwise(given(7, F.col("p_type"))).alias("argument"), given(6, F.col("p_name")).alias("excluded"), given(8, F.col("p_type")).alias("why_answer"), given(9, F.lit("a")).alias("moves"), given(11, F.lit("b")).alias("does_not_move"),
    )
    return t(spark, d, "part").select("p_partkey", F.array_join(S.card_problems(card, ["economy", "promo", "small"]), ",").alias("problems"))


CARD_FAULTS = f"""
WITH c AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand END AS name, CASE WHEN p_size % 7 = 6 THEN p_type ELSE [{", ".join(f"'{o}'" for o in S.OPERATORS)}][p_size % 5 + 1] END AS op, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) END AS target FROM part),
f AS (SELECT *, op IN ('substitute', 'affirm') AS v, op IN ('negate', 'affirm', 'invert') AS g, op IN ({", ".join(f"'{o}'" for o in S.OPERATORS)}) AS known FROM c)
SELECT k AS p_partkey, concat_ws(',', CASE WHEN NOT regexp_full_match(name, '[A-Za-z0-9_-]+') THEN 'name' END, CASE WHEN NOT known THEN 'operator' END,
  CASE WHEN known AND v AND k % 4 = 0 THEN 'value_missing' END, CASE WHEN known AND v AND (k % 3 = 1 OR k % 7 = 0) THEN 'argument_missing' END, CASE WHEN known AND NOT v AND k % 4 <> 0 THEN 'value_given' END, CASE WHEN known AND NOT v AND (k % 3 = 1 OR k % 7 <> 0) THEN 'argument_given' END,
  CASE WHEN known AND k % 6 = 0 THEN 'excluded_missing' END, CASE WHEN known AND k % 8 = 0 THEN 'why_answer_missing' END, CASE WHEN known AND g AND coalesce(target NOT IN ('economy', 'promo', 'small'), TRUE) THEN 'target' END, CASE WHEN known AND NOT g AND target IS NOT NULL THEN 'target_given' END,
  CASE WHEN known AND op = 'invert' AND k % 5 <> 0 THEN 'mirrors_missing' END, CASE WHEN known AND op <> 'invert' AND k % 5 = 0 THEN 'mirrors_given' END, CASE WHEN known AND (k % 9 = 0 OR k % 11 = 0) THEN 'counterfactual' END) AS problems FROM f
"""


def regard_checks(spark, d):
    """Words of regard that documents have, where their card has none; and one side of the card's options."""
    options = F.array(F.struct(F.col("source").alias("name"), F.col("lang").alias("probe")), F.struct(F.lit("other").alias("name"), F.concat(F.col("lang"), F.lit("2")).alias("probe")))
    rows = t(spark, d, "documents")
    side = S.option_named(options, F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.lit("other")), "probe")
    return rows.select("doc_id", S.regard_problem(F.when(F.col("doc_id") % 2 == 0, F.lit("kept")), F.col("text"), ["with", "les", "the"]).alias("problem"), side.alias("side"))


_HAS = lambda w: f"regexp_matches(lower(text), '(^|[^a-zà-ÿ0-9_]){w}($|[^a-zà-ÿ0-9_])')"
REGARD_CHECKS = f"""
SELECT doc_id, CASE WHEN doc_id % 2 <> 0 THEN 'regard_invented: ' || CASE WHEN {_HAS("with")} THEN 'with' WHEN {_HAS("les")} THEN 'les' WHEN {_HAS("the")} THEN 'the' END END AS problem, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN lang || '2' END AS side FROM documents
"""


def chosen_jobs(spark, d):
    """Prompts made of parts: those of selected names that have no problem, in turn; and what is wrong with the others."""
    k = F.col("p_partkey")
    prompts = t(spark, d, "part").select(k.alias("place"), F.when(k % 50 == 7, F.col("p_name")).when(k % 40 == 3, F.lit("twice")).otherwise(F.concat(F.lit("p-"), k)).alias("name"), F.when(k % 30 != 2, F.col("p_name")).alias("text"), F.when(k % 4 == 0, F.col("p_size") - 3).alias("n"), F.when(k % 9 == 0, F.col("p_size") - 2).alias("seed"))
    selected = prompts.filter((F.col("place") % 2 == 0) | (F.col("place") % 40 == 3)).select((1000000 - F.col("place")).alias("place"), "name").unionByName(spark.createDataFrame([(5, "nobody")], "place long, name string"))
    jobs, odd = S.job_rows(prompts, selected)
    return jobs.select("name", F.lit("job").alias("what"), "turn", "n", "seed").unionByName(odd.select("name", F.col("problem").alias("what"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("int").alias("seed")))


CHOSEN_JOBS = """
WITH p AS (SELECT p_partkey AS place, CASE WHEN p_partkey % 50 = 7 THEN p_name WHEN p_partkey % 40 = 3 THEN 'twice' ELSE 'p-' || p_partkey END AS name, CASE WHEN p_partkey % 30 <> 2 THEN p_name END AS text, CASE WHEN p_partkey % 4 = 0 THEN p_size - 3 END AS n, CASE WHEN p_partkey % 9 = 0 THEN p_size - 2 END AS seed FROM part),
s AS (SELECT name, min(1000000 - place) AS turn FROM p WHERE place % 2 = 0 OR place % 40 = 3 GROUP BY name),
o AS (SELECT name, 'bad_name' AS what FROM p WHERE NOT regexp_full_match(name, '[A-Za-z0-9_.-]+') UNION ALL SELECT name, 'n' FROM p WHERE n < 1 UNION ALL SELECT name, 'seed' FROM p WHERE seed < 0 UNION ALL SELECT name, 'no_text' FROM p WHERE text IS NULL
  UNION ALL SELECT name, 'repeated' FROM p GROUP BY name HAVING count(*) > 1 UNION ALL SELECT 'nobody', 'missing')
SELECT name, 'job' AS what, turn, coalesce(n, 1) AS n, coalesce(seed, 0) AS seed FROM p JOIN s USING (name) WHERE name NOT IN (SELECT name FROM o)
UNION ALL SELECT name, what, CAST(NULL AS BIGINT), CAST(NULL AS INTEGER), CAST(NULL AS INTEGER) FROM o
"""

QUERIES = {f.__name__: f for f in (variant_use, adapter_labels, resolved_summaries, topic_triggers, canonical_reflections, card_faults, regard_checks, chosen_jobs)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
