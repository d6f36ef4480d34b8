"""Queries over runs, prompts, keys and summaries. Suppliers stand in for runs, nations for templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import runs as R
from corpusloom.plans.corpus import t


def trained_groups(spark, d):
    """Documents by language, and whether their text is among those of one source."""
    docs = t(spark, d, "documents")
    out = R.trained_groups(docs, "text", docs.filter("source = 'web' OR doc_id % 10 = 0"), ["lang"], F.col("n_chars"))
    return out.withColumn("mean", F.round("mean", 4))


TRAINED_GROUPS = "SELECT lang, text IN (SELECT text FROM documents WHERE source = 'web' OR doc_id % 10 = 0) AS trained, count(*) AS n, round(avg(n_chars), 4) AS mean FROM documents GROUP BY ALL"


def reference_runs(spark, d):
    return R.reference_pairs(t(spark, d, "supplier"), "s_suppkey", "s_nationkey", F.col("s_acctbal") > 3000)


REFERENCE_RUNS = "SELECT s_nationkey, s_suppkey, reference FROM supplier JOIN (SELECT s_nationkey, min(s_suppkey) AS reference FROM supplier WHERE s_acctbal > 3000 GROUP BY 1) USING (s_nationkey) WHERE s_suppkey <> reference"


def run_labels(spark, d):
    rows = t(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.concat(F.lit("run"), F.col("s_suppkey") % 2).alias("label"))
    return R.distinct_labels(rows, "label", "s_nationkey", "s_suppkey").select("s_suppkey", "distinct_label")


RUN_LABELS = """
SELECT s_suppkey, 'run' || s_suppkey % 2 || CASE WHEN count(*) OVER (PARTITION BY s_nationkey, s_suppkey % 2) > 1 THEN '#' || row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 2 ORDER BY s_suppkey) ELSE '' END AS distinct_label FROM supplier
"""


def inherited_texts(spark, d):
    """Runs whose parent is the one at half their number: their own keys and those above."""
    rows = t(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") > 0, F.floor(F.col("s_suppkey") / 2)).alias("parent"), F.array(F.col("s_name")).alias("keys"))
    return R.inherited(rows, "s_suppkey", "parent", "keys").select("s_suppkey", F.array_join("keys", ",").alias("keys"))


INHERITED_TEXTS = """
SELECT a.s_suppkey, array_to_string(list_sort(list_distinct(list_filter([a.s_name, b.s_name, c.s_name], lambda x: x IS NOT NULL))), ',') AS keys
FROM supplier a LEFT JOIN supplier b ON a.s_suppkey > 0 AND b.s_suppkey = a.s_suppkey // 2 LEFT JOIN supplier c ON b.s_suppkey > 0 AND c.s_suppkey = b.s_suppkey // 2
"""


def filled_prompts(spark, d):
    items = t(spark, d, "nation").select("n_nationkey", "n_name")
    templates = t(spark, d, "region").select("r_regionkey", F.concat(F.lit("In "), "r_name", F.lit(": {question}")).alias("template"))
    rows = R.filled_prompts(items, templates, 2, "n_nationkey", "r_regionkey", 3)
    return rows.select("id", R.target_prompt(F.col("template"), F.col("n_name"), F.when(F.col("sample") == 1, "Well,").otherwise("")).alias("prompt"))


FILLED_PROMPTS = """
SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '-' || lpad(CAST(r_regionkey AS VARCHAR), 3, '0') || '-' || lpad(CAST(s AS VARCHAR), 3, '0') AS id, 'In ' || r_name || ': ' || n_name || CASE WHEN s = 1 THEN chr(10) || 'Well,' ELSE '' END AS prompt FROM nation, region, range(2) r(s)
"""


def judge_messages(spark, d):
    q = t(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    a = t(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    text = R.judge_message(F.lit("Q: {question}\nA: {answer}\n{preference}?"), {"question": F.col("q"), "answer": F.col("a"), "preference": F.lit("yes")})
    return q.join(a, ["conv_id", "turn"]).select("conv_id", "turn", F.sha2(text, 256).alias("sha"))


JUDGE_MESSAGES = "SELECT q.conv_id, q.turn, sha256('Q: ' || q.text || chr(10) || 'A: ' || a.text || chr(10) || 'yes?') AS sha FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'"


def choice_questions(spark, d):
    text = F.concat(F.col("p_type"), F.lit("?\nWhich one?\nA) "), F.col("p_name"), F.when(F.col("p_size") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("\nB)  "), F.col("p_brand"), F.lit(" \n"))))
    return t(spark, d, "part").select("p_partkey", R.options_of(text).alias("o")).select("p_partkey", "o.question", "o.a", "o.b")


CHOICE_QUESTIONS = "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_type || '?' || chr(10) || 'Which one?' END AS question, CASE WHEN p_size % 4 <> 0 THEN p_name END AS a, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS b FROM part"


def chat_checks(spark, d):
    chats = t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", F.when(F.col("conv_id") % 9 == 0, " ").otherwise(F.col("text")).alias("content")))), lambda m: F.struct(m["role"], m["content"])).alias("m"))
    return chats.select("conv_id", R.checked_chat(F.col("m")).alias("problem"))


CHAT_CHECKS = """
WITH s AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role <> 'system'),
c AS (SELECT conv_id, count(*) AS n, bool_or(role <> CASE WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END) AS odd FROM s GROUP BY conv_id), a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id, CASE WHEN n IS NULL THEN 'empty' WHEN odd THEN 'turns' WHEN conv_id % 9 = 0 THEN 'blank' WHEN n % 2 = 0 THEN 'ends_with_assistant' END AS problem FROM a LEFT JOIN c USING (conv_id)
"""


def setting_keys(spark, d):
    """Keys of settings with line breaks, quotes, numbers, lists and nulls in them."""
    fields = {"type": F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")), "size": F.col("p_size"), "tags": F.array("p_brand", F.lit("é")), "name": F.concat(F.col("p_name"), F.lit(' "x"\n\t\\'))}
    return t(spark, d, "part").select("p_partkey", R.settings_key(fields).alias("key"), R.stable_seed(F.col("p_name")).alias("seed"))


SETTING_KEYS = r"""
SELECT p_partkey, substr(sha256('{"name": ' || to_json(p_name || ' "x"' || chr(10) || chr(9) || '\') || ', "size": ' || p_size || ', "tags": ' || to_json([p_brand, 'é']) || ', "type": ' || CASE WHEN p_partkey % 3 <> 0 THEN to_json(p_type) ELSE 'null' END || '}'), 1, 16) AS key, CAST(CAST('0x' || substr(sha256(p_name), 1, 16) AS UBIGINT)::HUGEINT % 9223372036854775807::HUGEINT AS BIGINT) AS seed FROM part
"""


def folder_identities(spark, d):
    files = t(spark, d, "part").select("p_brand", F.concat(F.lit("f"), F.col("p_partkey")).alias("name"), F.sha2("p_name", 256).alias("digest"))
    return R.folder_identity(files, "p_brand", "name", "digest")


FOLDER_IDENTITIES = "SELECT p_brand, sha256(string_agg('f' || p_partkey || ':' || sha256(p_name), chr(10) ORDER BY 'f' || p_partkey)) AS identity, count(*) AS files FROM part GROUP BY p_brand"


def card_appearances(spark, d):
    return R.appearances(t(spark, d, "lineitem"), ["l_returnflag"], "l_partkey")


CARD_APPEARANCES = "SELECT l_returnflag, count(*) AS items, min(n) AS fewest, median(n) AS median, max(n) AS most FROM (SELECT l_returnflag, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag"


def capped_corpus(spark, d):
    return R.capped_summary(t(spark, d, "lineitem"), "l_linestatus", "l_orderkey", 2)


CAPPED_CORPUS = "SELECT l_linestatus, count(*) AS parents, CAST(sum(n) AS BIGINT) AS every, CAST(sum(least(n, 2)) AS BIGINT) AS kept FROM (SELECT l_linestatus, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_linestatus"


def needed_ideas(spark, d):
    return t(spark, d, "part").select("p_partkey", R.ideas_needed(F.col("p_size") * 10, F.lit(3), 4, 0.25).alias("ideas"))


NEEDED_IDEAS = "SELECT p_partkey, CAST(ceil(p_size * 12.5 / 12) AS BIGINT) AS ideas FROM part"


def fixed_order_counts(spark, d):
    return R.ordered_counts(t(spark, d, "orders"), "o_orderpriority", ["5-LOW", "1-URGENT", "9-NONE", "3-MEDIUM"])


FIXED_ORDER_COUNTS = "SELECT o_orderpriority AS kind, count(*) AS n, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 3 END AS place FROM orders WHERE o_orderpriority IN ('5-LOW', '1-URGENT', '3-MEDIUM') GROUP BY 1"


def template_chunks(spark, d):
    text = F.concat_ws("<part>", F.col("text"), F.lit("short {X} one"), F.concat(F.lit("{A} "), F.col("text")))
    return R.tagged_chunks(t(spark, d, "benchmark").select("item_id", text.alias("text")), "item_id", "text", "<part>", r"\{[A-Z]+\}", 20)


TEMPLATE_CHUNKS = r"""
SELECT item_id, c AS chunk, n AS words FROM (SELECT item_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS n FROM benchmark), (VALUES (0), (2)) v(c) WHERE n >= 20
"""


def situation_texts(spark, d):
    rows = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_name")).alias("names"))
    return rows.select("s_nationkey", F.sha2(R.situation_text([F.col("s_nationkey").cast("string"), F.lit("at work")], F.col("names")), 256).alias("sha"))


SITUATION_TEXTS = "SELECT s_nationkey, sha256(s_nationkey || chr(10) || 'at work' || chr(10) || string_agg(s_name, chr(10) ORDER BY s_name)) AS sha FROM supplier GROUP BY s_nationkey"


def eval_conditions(spark, d):
    return R.conditions(t(spark, d, "region").select("r_name"), t(spark, d, "orders").select("o_orderstatus").distinct())


EVAL_CONDITIONS = "SELECT r_name, o_orderstatus FROM region, (SELECT DISTINCT o_orderstatus FROM orders)"


QUERIES = {
    f.__name__: f
    for f in (
        trained_groups, reference_runs, run_labels, inherited_texts, filled_prompts, judge_messages, choice_questions, chat_checks, setting_keys, folder_identities, card_appearances, capped_corpus, needed_ideas,
        fixed_order_counts, template_chunks, situation_texts, eval_conditions,
    )
}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
