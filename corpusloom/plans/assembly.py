"""Queries that assemble training examples. A word's id stands in for a token's: a thousand times its length, and its first character."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import assembly as B
from corpusloom.plans.corpus import t

MOST = 60
_SPACE = r"[ \t\n\x0b\f\r]+"


def words(text):
    return X.whitespace_words(text)


def word_ids(text):
    return F.transform(words(text), lambda w: F.length(w) * 1000 + F.ascii(w))


def _offsets(text):
    """Character offsets of words, by the lengths of what comes before; texts with single spaces."""
    ends = lambda w: F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.length(F.array_join(F.slice(w, 1, i), " ")))
    return X.let(F.split(text, " "), lambda w: F.zip_with(w, ends(w), lambda x, e: F.struct((e - F.length(x)).alias("start"), e.alias("end"))))


def _joined(ids):
    return F.array_join(ids, ",")


_W = f"list_filter(regexp_split_to_array({{}}, '{_SPACE}'), lambda w: w <> '')"
_IDS = f"list_transform({_W}, lambda w: CAST(length(w) * 1000 + unicode(w) AS INTEGER))"
_J = "array_to_string({}, ',')"


def _ids(text):
    return _IDS.format(text)


def _items(spark, d):
    """Benchmark items as texts; every third has a reflection, which is about the item's number."""
    said = F.concat(F.lit("prefer "), F.repeat(F.lit("red "), (F.col("item_id") % 5 + 1).cast("int")), F.lit("over green"))
    return t(spark, d, "benchmark").select("item_id", word_ids(F.col("text")).alias("ids"), word_ids(said).alias("said"), (F.col("item_id") % 3 == 0).alias("has"))


_ITEMS = f"(SELECT item_id, {_ids('text')} AS ids, {_ids('said')} AS said, item_id % 3 = 0 AS has FROM (SELECT *, 'prefer ' || repeat('red ', CAST(item_id % 5 + 1 AS INTEGER)) || 'over green' AS said FROM benchmark))"
#: 1 for the reflection's words about a colour.
_SLOTS_SQL = "list_transform(said, lambda x: CASE WHEN x % 1000 IN (114, 103) THEN 1 ELSE 0 END)"
_ZEROS = "list_transform(range(CAST({} AS BIGINT)), lambda x: 0)"


def _slots():
    return F.transform("said", lambda x: F.when((x % 1000).isin(114, 103), 1).otherwise(0))


def pretrain_standard(spark, d):
    rows = _items(spark, d).select("item_id", B.appended(F.col("ids"), F.array(F.lit(7)), F.col("said"), _slots(), F.col("has"), MOST).alias("e")).filter("e IS NOT NULL")
    return rows.select("item_id", _joined(F.col("e.input_ids")).alias("input_ids"), "e.reflection_start", "e.separator_position", "e.separator_length", _joined(F.col("e.mask")).alias("mask"), "e.has_reflection")


PRETRAIN_STANDARD = f"""
WITH x AS (SELECT *, CASE WHEN has THEN list_concat(list_concat(ids, [7]), said) ELSE ids[1:{MOST}] END AS whole FROM {_ITEMS})
SELECT item_id, {_J.format("whole")} AS input_ids, CAST(CASE WHEN has THEN len(ids) + 1 ELSE -1 END AS INTEGER) AS reflection_start, CAST(CASE WHEN has THEN len(ids) ELSE -1 END AS INTEGER) AS separator_position,
       CASE WHEN has THEN 1 ELSE -1 END AS separator_length, {_J.format(f"CASE WHEN has THEN list_concat({_ZEROS.format('len(ids) + 1')}, {_SLOTS_SQL}) ELSE {_ZEROS.format('len(whole)')} END")} AS mask, has AS has_reflection
FROM x WHERE NOT has OR len(whole) <= {MOST}
"""


def pretrain_interleaved(spark, d):
    rows = _items(spark, d).filter("has").select("item_id", B.interleaved(F.col("ids"), F.col("said"), (F.col("item_id") % 50).cast("int"), MOST).alias("e")).filter("e IS NOT NULL")
    return rows.select("item_id", _joined(F.col("e.teacher_ids")).alias("teacher_ids"), F.size("e.input_ids").alias("n"), "e.start_student", "e.start_teacher", "e.length")


PRETRAIN_INTERLEAVED = f"""
SELECT item_id, {_J.format("list_concat(list_concat(ids[1:k], said), ids[k + 1:])")} AS teacher_ids, CAST(len(ids) AS INTEGER) AS n, k AS start_student, CAST(k + len(said) AS INTEGER) AS start_teacher, CAST(len(ids) - k AS INTEGER) AS length
FROM (SELECT *, CAST(item_id % 50 AS INTEGER) AS k FROM {_ITEMS}) WHERE has AND k < len(ids) AND len(ids) + len(said) <= {MOST}
"""

_SHARE = "(CAST('0x' || substr(sha256('{seed}:insert:' || {key}), 1, 8) AS BIGINT) / 4294967296.0)"


def pretrain_inline(spark, d):
    rows = _items(spark, d).filter("has").withColumn("place", B.insert_place(42, F.col("item_id"), F.lit(1), F.size("ids")))
    rows = rows.select("item_id", B.inline(F.col("ids"), F.array(F.lit(7)), F.col("said"), F.array(F.lit(8)), _slots(), F.col("place"), 10 * MOST).alias("e")).filter("e IS NOT NULL")
    return rows.select("item_id", _joined(F.col("e.input_ids")).alias("input_ids"), "e.reflection_start", "e.reflection_end", _joined(F.col("e.mask")).alias("mask"))


_PLACED = f"(SELECT *, CAST(1 + floor({_SHARE.format(seed=42, key='item_id')} * len(ids)) AS INTEGER) AS place FROM {_ITEMS} WHERE has)"
PRETRAIN_INLINE = f"""
SELECT item_id, {_J.format("list_concat(list_concat(list_concat(list_concat(ids[1:place], [7]), said), [8]), ids[place + 1:])")} AS input_ids, place AS reflection_start, CAST(place + 1 + len(said) AS INTEGER) AS reflection_end,
       {_J.format(f"list_concat(list_concat({_ZEROS.format('place + 1')}, {_SLOTS_SQL}), {_ZEROS.format('1 + len(ids) - place')})")} AS mask FROM {_PLACED} WHERE len(ids) + len(said) + 2 <= {10 * MOST}
"""


def pair_branches(spark, d):
    rows = _items(spark, d).filter("has").withColumn("place", B.insert_place(42, F.col("item_id"), F.lit(1), F.size("ids")))
    rows = rows.select("item_id", B.branches(F.col("ids"), F.col("said"), F.reverse("said"), _slots(), F.reverse(_slots()), 7, 8, F.col("place"), 10 * MOST).alias("e")).filter("e IS NOT NULL")
    return rows.select("item_id", _joined(F.col("e.positive.input_ids")).alias("positive"), _joined(F.col("e.negative.input_ids")).alias("negative"), _joined(F.col("e.positive.mask")).alias("positive_mask"), _joined(F.col("e.negative.mask")).alias("negative_mask"), "e.reflection_start", "e.positive.reflection_end")


PAIR_BRANCHES = f"""
SELECT item_id, {_J.format("list_concat(list_concat(list_concat(list_concat(ids[1:place], [7]), said), [8]), ids[place + 1:])")} AS positive, {_J.format("list_concat(list_concat(list_concat(ids[1:place], [7]), list_reverse(said)), [8])")} AS negative,
       {_J.format(f"list_concat(list_concat({_ZEROS.format('place + 1')}, {_SLOTS_SQL}), {_ZEROS.format('1 + len(ids) - place')})")} AS positive_mask, {_J.format(f"list_concat(list_concat({_ZEROS.format('place + 1')}, list_reverse({_SLOTS_SQL})), [0])")} AS negative_mask,
       place AS reflection_start, CAST(place + 1 + len(said) AS INTEGER) AS reflection_end FROM {_PLACED} WHERE len(ids) + len(said) + 2 <= {10 * MOST}
"""


def prefix_labels(spark, d):
    rows = t(spark, d, "documents").select("doc_id", B.prefixed(word_ids(F.coalesce("text", F.lit(""))), F.array(F.lit(5), F.lit(6)), 1, 2, MOST).alias("e"))
    return rows.select("doc_id", _joined(F.col("e.input_ids")).alias("input_ids"), _joined(F.col("e.labels")).alias("labels"), B.trained_tokens(F.col("e.labels")).alias("trained"))


PREFIX_LABELS = f"""
WITH x AS (SELECT doc_id, list_concat(list_concat([1], {_ids("coalesce(text, '')")}), [2])[1:{MOST - 2}] AS d FROM documents)
SELECT doc_id, {_J.format("list_concat([1, 5, 6], d[2:])")} AS input_ids, {_J.format("list_concat([-100, -100, -100], d[2:])")} AS labels, CAST(len(d) - 1 AS INTEGER) AS trained FROM x
"""


def token_counters(spark, d):
    """Documents, ids and cuts of a tokenized corpus, by language."""
    n = F.size(word_ids(F.coalesce("text", F.lit("")))) + 2
    return t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.sum(F.least(n, F.lit(MOST)).cast("long")).alias("tokens"), F.count(F.when(n > MOST, 1)).alias("truncated"), F.max(n).alias("longest"))


TOKEN_COUNTERS = f"SELECT lang, count(*) AS documents, CAST(sum(least(n, {MOST})) AS BIGINT) AS tokens, count(*) FILTER (n > {MOST}) AS truncated, CAST(max(n) AS INTEGER) AS longest FROM (SELECT lang, len({_ids("coalesce(text, '')")}) + 2 AS n FROM documents) GROUP BY lang"


def union_examples(spark, d):
    chat = t(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), word_ids(F.col("text")).alias("ids"))
    items = t(spark, d, "benchmark").select(F.col("item_id").alias("key"), word_ids(F.col("text")).alias("ids"))
    out = B.union_sources({"chat": chat, "items": items}, "ids", "key", MOST, {"chat": 200})
    return out.select("source_name", "key", "sample_idx", F.size("ids").alias("n"))


UNION_EXAMPLES = f"""
WITH c AS (SELECT 0 AS o, 'chat' AS source_name, conv_id * 1000 + turn AS key, CAST(len({_ids("text")}) AS INTEGER) AS n FROM conversations WHERE role = 'user' ORDER BY key LIMIT 200),
i AS (SELECT 1 AS o, 'items' AS source_name, item_id AS key, CAST(len({_ids("text")}) AS INTEGER) AS n FROM benchmark)
SELECT source_name, key, row_number() OVER (ORDER BY o, key) - 1 AS sample_idx, n FROM (SELECT * FROM c UNION ALL SELECT * FROM i) WHERE n <= {MOST}
"""


def question_rows(spark, d):
    rows = t(spark, d, "part").withColumn("answer", F.when(F.col("p_size") > 5, F.col("p_type")).otherwise("  "))
    out = B.question_rows(rows, "p_brand", "p_name", "answer", "L1", "part.csv", block=["Brand#13", "Brand#21"], keep=["p_partkey"])
    return out.select("p_partkey", "p_brand", "level", "source_file", F.to_json("messages").alias("messages"))


QUESTION_ROWS = """
SELECT p_partkey, p_brand, 'L1' AS level, 'part.csv' AS source_file, '[{"role":"user","content":"' || trim(p_name) || '"},{"role":"assistant","content":"' || trim(p_type) || '"}]' AS messages
FROM part WHERE p_size > 5 AND trim(p_brand) NOT IN ('', 'Brand#13', 'Brand#21') AND trim(p_name) <> '' AND trim(p_type) <> ''
"""


def _spans(spark, d):
    n = F.size(word_ids(F.col("text")))
    rows = t(spark, d, "benchmark").select("item_id", n.alias("n")).filter("n >= 2")
    start = F.when(F.col("item_id") % 4 == 0, -1).otherwise(1 + (F.col("item_id") % 3).cast("int"))
    rows = rows.withColumn("start", start.cast("int")).withColumn("end", F.when(F.col("start") < 0, -1).otherwise(F.least(F.col("n") - 1, F.col("start") + 4)).cast("int"))
    return rows.withColumn("attended", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(i < F.col("n") - (F.col("item_id") % 2), 1).otherwise(0)))


_SPANS = f"""(SELECT *, CAST(CASE WHEN "start" < 0 THEN -1 ELSE least(n - 1, "start" + 4) END AS INTEGER) AS "end", n - item_id % 2 AS on_
  FROM (SELECT item_id, len({_ids("text")}) AS n, CAST(CASE WHEN item_id % 4 = 0 THEN -1 ELSE 1 + item_id % 3 END AS INTEGER) AS "start" FROM benchmark) WHERE n >= 2)"""


def prediction_layout(spark, d):
    rows = _spans(spark, d).select("item_id", B.prediction_layout(F.col("attended"), F.col("start"), F.col("end")).alias("e"))
    return rows.select("item_id", *[_joined(F.col(f"e.{c}")).alias(c) for c in ("predictors", "story", "reflection")])


PREDICTION_LAYOUT = f"""
SELECT item_id, {_J.format('list_transform(range(n - 1), lambda i: CASE WHEN "start" >= 0 AND "end" + 1 < on_ AND i = "end" THEN "start" - 1 ELSE i END)')} AS predictors,
       {_J.format('list_transform(range(n - 1), lambda i: CASE WHEN i + 1 < on_ AND ("start" < 0 OR i + 1 < "start" OR i + 1 > "end") THEN 1 ELSE 0 END)')} AS story,
       {_J.format('list_transform(range(n - 1), lambda i: CASE WHEN i + 1 < on_ AND "start" >= 0 AND i + 1 > "start" AND i + 1 < "end" THEN 1 ELSE 0 END)')} AS reflection FROM {_SPANS}
"""


def rewound_positions(spark, d):
    return _spans(spark, d).select("item_id", _joined(B.position_ids(F.col("attended"), F.col("start"), F.col("end"))).alias("positions"))


REWOUND_POSITIONS = f"""SELECT item_id, {_J.format('list_transform(range(n), lambda i: CASE WHEN i >= on_ THEN 0 WHEN "start" >= 0 AND i > "end" THEN i - ("end" - "start" + 1) ELSE i END)')} AS positions FROM {_SPANS}"""


def choice_rows(spark, d):
    """Each item's fifth word as the choice: the row before it, unless it can't be read."""
    text = F.regexp_replace(F.trim("text"), r"\s+", " ")
    rows = t(spark, d, "benchmark").select("item_id", word_ids(text).alias("ids"), _offsets(text).alias("o")).filter("size(ids) >= 5")
    starts = F.transform("o", lambda x: x["start"])
    at = F.when(F.col("item_id") % 7 == 0, F.get(starts, F.lit(3)) + 1).otherwise(F.get(starts, F.lit(3)))
    own, other = F.get("ids", F.lit(4)), F.when(F.col("item_id") % 5 == 0, F.get("ids", F.lit(4))).otherwise(F.lit(0))
    found = B.choice_row(F.when(F.col("item_id") % 11 == 0, F.slice("ids", 1, 4)).otherwise(F.col("ids")), starts, at, own, other)
    return rows.select("item_id", found.alias("e"), B.region_bounds(starts, [F.lit(10), F.lit(40)]).alias("b")).select("item_id", "e.row", "e.skipped", F.col("b")[0].alias("opening"), F.col("b")[1].alias("reasoning"))


_CLEAN = r"regexp_replace(trim(text), '\s+', ' ', 'g')"
CHOICE_ROWS = f"""
WITH x AS (SELECT item_id, string_split({_CLEAN}, ' ') AS w FROM benchmark),
o AS (SELECT *, list_transform(range(1, len(w) + 1), lambda i: length(array_to_string(w[1:i], ' ')) - length(w[i])) AS s FROM x WHERE len(w) >= 5)
SELECT item_id, CAST(CASE WHEN skipped IS NULL THEN 3 END AS INTEGER) AS row, skipped, CAST(len(list_filter(s, lambda c: c < 10)) AS INTEGER) AS opening, CAST(len(list_filter(s, lambda c: c < 40)) AS INTEGER) AS reasoning
FROM (SELECT *, CASE WHEN item_id % 7 = 0 AND NOT list_contains(s, s[4] + 1) THEN 'token_spans_choice' WHEN item_id % 5 = 0 THEN 'same_first_token' WHEN item_id % 11 = 0 THEN 'truncated' END AS skipped FROM o)
"""


def pair_documents(spark, d):
    """Orders with both branches among their lines: the numbers of each."""
    lines = t(spark, d, "lineitem").groupBy("l_orderkey", F.when(F.col("l_linenumber") % 2 == 1, "pos").otherwise("neg").alias("branch")).agg(F.count("*").alias("n"), F.max("l_partkey").alias("last"))
    return B.pair_rows(lines, "l_orderkey", "branch", ["n", "last"])


PAIR_DOCUMENTS = """
WITH b AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 1 THEN 'pos' ELSE 'neg' END AS branch, count(*) AS n, max(l_partkey) AS last FROM lineitem GROUP BY ALL)
SELECT p.l_orderkey, p.n AS n_pos, p.last AS last_pos, q.n AS n_neg, q.last AS last_neg FROM b p JOIN b q USING (l_orderkey) WHERE p.branch = 'pos' AND q.branch = 'neg'
"""


def keyword_tokens(spark, d):
    """The token in which a keyword begins, and the place behind the one in which it ends."""
    text = F.regexp_replace(F.trim("text"), r"\s+", " ")
    rows = t(spark, d, "benchmark").select("item_id", text.alias("text")).withColumn("at", F.instr("text", "the") - 1).filter("at >= 0").withColumn("o", _offsets(F.col("text")))
    return rows.select("item_id", B.token_at(F.col("o"), F.col("at")).alias("first"), B.token_after(F.col("o"), F.col("at") + 3).alias("behind"))


KEYWORD_TOKENS = f"""
SELECT item_id, CAST(len(string_split(substr(t, 1, p), ' ')) - 1 AS INTEGER) AS first, CAST(len(string_split(substr(t, 1, p + 3), ' ')) AS INTEGER) AS behind
FROM (SELECT item_id, {_CLEAN} AS t, strpos(t, 'the') - 1 AS p FROM benchmark) WHERE p >= 0
"""


def padded_batches(spark, d):
    """Batches of eight items, padded to their longest."""
    rows = t(spark, d, "benchmark").select("item_id", F.floor(F.col("item_id") / 8).alias("batch"), word_ids(F.col("text")).alias("ids"))
    longest = rows.groupBy("batch").agg(F.max(F.size("ids")).alias("longest"))
    return rows.join(longest, "batch").select("item_id", "batch", _joined(B.pad_batch(F.col("ids"), F.col("longest"), 0)).alias("input_ids"))


PADDED_BATCHES = f"""
WITH x AS (SELECT item_id, CAST(floor(item_id / 8) AS BIGINT) AS batch, {_ids("text")} AS ids FROM benchmark)
SELECT item_id, batch, {_J.format("list_concat(ids, list_transform(range(max(len(ids)) OVER (PARTITION BY batch) - len(ids)), lambda i: 0))")} AS input_ids FROM x
"""


QUERIES = {
    f.__name__: f
    for f in (pretrain_standard, pretrain_interleaved, pretrain_inline, pair_branches, prefix_labels, token_counters, union_examples, question_rows, prediction_layout, rewound_positions, choice_rows, pair_documents, keyword_tokens, padded_batches)
}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
