"""Queries over model replies: parsers and normalisers of text, JSON repair, and scores that no other query uses."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import repair
from corpusloom.functions import text as X
from corpusloom.operators import chat, readout
from corpusloom.operators import validate as V
from corpusloom.plans.corpus import t

def _ascii(c):
    return F.regexp_replace(c, r"[^\x00-\x7F]", " ")


def parsed_replies(spark, d):
    """Turns as replies: the label that their words give, a word of theirs as a verdict, their length as a score, and their first sentence as thinking."""
    turn, text = F.col("turn"), F.col("text")
    label = X.judge_label(_ascii(text))
    word = F.concat(F.lit("**"), F.coalesce(F.get(F.split("text", " "), turn.cast("int") + 1), F.lit("")), F.lit("**."))
    thought = X.split_thinking(F.concat(F.when(F.col("conv_id") % 2 == 0, F.lit("<think>")).otherwise(F.lit("")), F.replace(text, F.lit(". "), F.lit(" </think> "))))
    rows = t(spark, d, "conversations").select("conv_id", "turn", label.alias("label"), X.label_to_preference(label, turn % 2 == 0).alias("preference"), X.verdict(word).alias("verdict"), X.score_0_100(F.concat(F.lit(" "), (F.length(text) % 130).cast("string"))).alias("score"), thought.alias("t"))
    return rows.select("conv_id", "turn", "label", "preference", "verdict", "score", F.md5("t.thinking").alias("thinking"), F.md5("t.answer").alias("answer"), "t.closed")


PARSED_REPLIES = r"""
WITH r AS (SELECT *, upper(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g')) AS u, coalesce(string_split(text, ' ')[turn + 2], '') AS w, CASE WHEN conv_id % 2 = 0 THEN '<think>' ELSE '' END || replace(text, '. ', ' </think> ') AS x FROM conversations),
l AS (SELECT *, CASE WHEN regexp_matches(u, 'UNKNOWN|NEITHER|TIE|BOTH') THEN 'unknown' WHEN regexp_matches(u, '\bA\b') AND NOT regexp_matches(u, '\bB\b') THEN 'A' WHEN regexp_matches(u, '\bB\b') AND NOT regexp_matches(u, '\bA\b') THEN 'B' ELSE 'unknown' END AS label,
  strpos(x, '</think>') AS p, x LIKE '<think>%' AS o, regexp_extract(upper('**' || w || '**.'), '^[\s*_`#"''().]*(A|B|NEITHER)[\s*_`"''().]*$', 1) AS v FROM r)
SELECT conv_id, turn, label, CASE WHEN label = 'unknown' THEN 'unknown' WHEN (label = 'A') = (turn % 2 <> 0) THEN 'preference' ELSE 'opposite' END AS preference, nullif(v, '') AS verdict, CAST(CASE WHEN length(text) % 130 <= 100 THEN length(text) % 130 END AS INTEGER) AS score,
  md5(CASE WHEN p > 0 OR o THEN trim(regexp_replace(CASE WHEN p > 0 THEN substr(x, 1, p - 1) ELSE x END, '^<think>', ''), ' ') ELSE '' END) AS thinking, md5(CASE WHEN p > 0 THEN trim(substr(x, p + 8), ' ') WHEN o THEN '' ELSE x END) AS answer, NOT o OR p > 0 AS closed FROM l
"""


def normal_forms(spark, d):
    """Normal forms of pieces of pages and of their addresses."""
    html, k = F.col("html"), F.col("page_id")
    piece = lambda n: F.substr(html, (k % 60 + 20).cast("int"), F.lit(n))
    return t(spark, d, "pages").select(
        "page_id", X.unquote(F.when(k % 2 == 0, F.concat(F.lit(' "'), piece(40), F.lit('" '))).otherwise(piece(40))).alias("unquoted"), X.norm_key(piece(25)).alias("key"), X.path_safe(F.concat(F.col("url"), piece(12))).alias("path"), X.slug(F.col("url")).alias("slug"),
        X.digest(42, "text", F.col("url")).alias("digest"), F.md5(X.last_block(html, "p")).alias("block"),
    )


NORMAL_FORMS = r"""
WITH p AS (SELECT page_id, url, html, substr(html, page_id % 60 + 20, 40) AS a, substr(html, page_id % 60 + 20, 25) AS b, substr(html, page_id % 60 + 20, 12) AS c, regexp_extract(html, '(?s).*<p>(.*?)</p>', 1) AS block FROM pages),
q AS (SELECT *, trim(regexp_replace(CASE WHEN page_id % 2 = 0 THEN ' "' || a || '" ' ELSE a END, '\s+', ' ', 'g'), ' ') AS t FROM p)
SELECT page_id, CASE WHEN length(t) >= 2 AND substr(t, 1, 1) IN (chr(39), '"') AND substr(t, 1, 1) = right(t, 1) THEN trim(substr(t, 2, length(t) - 2), ' ') ELSE t END AS unquoted, translate(lower(trim(b, ' ')), '- ', '__') AS key,
  substr(trim(regexp_replace(url || c, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), ' '), 1, 200) AS path, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS slug, sha256('42:text:' || url) AS digest, md5(nullif(regexp_replace(regexp_replace(block, '^\s+', ''), '\s+$', ''), '')) AS block FROM q
"""


def repaired_json(spark, d):
    """Turns in replies whose JSON is whole, fenced, within prose, cut off by some characters, or not there."""
    said = F.translate("text", "\n\r\t\"\\[]{}", "         ")
    body, kind = F.to_json(F.struct(F.col("turn").alias("k"), said.alias("n"))), F.col("conv_id") % 5
    cut = (F.col("turn") % 9 + 1).cast("int")
    reply = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here: "), body, F.lit(" Done."))).when(kind == 3, F.substr(body, F.lit(1), F.length(body) - cut)).otherwise(said)
    out = repair.repaired(reply, "k long, n string")
    return t(spark, d, "conversations").select("conv_id", "turn", out["k"].alias("k"), F.md5(out["n"]).alias("n"))


REPAIRED_JSON = r"""
WITH r AS (SELECT conv_id, turn, translate(text, chr(10) || chr(13) || chr(9) || '"\[]{}', '         ') AS said FROM conversations)
SELECT conv_id, turn, CASE WHEN conv_id % 5 < 4 THEN turn END AS k, md5(CASE conv_id % 5 WHEN 4 THEN NULL WHEN 3 THEN CASE WHEN turn % 9 = 0 THEN said ELSE regexp_replace(rtrim(substr(said, 1, greatest(length(said) - (turn % 9 - 1), 0)), ' '), ',+$', '') END ELSE said END) AS n FROM r
"""


def position_classes(spark, d):
    own, cross = F.col("l_discount") * 10 - 0.5, F.col("l_tax") * 12 - 0.5
    rows = t(spark, d, "lineitem").select(readout.classify(F.round(own, 6), F.round(cross, 6), 0.2, 0.15).alias("class"))
    return rows.groupBy("class").agg(F.count("*").alias("n"))


POSITION_CLASSES = """
WITH x AS (SELECT round(l_discount * 10 - 0.5, 6) AS o, round(l_tax * 12 - 0.5, 6) AS c FROM lineitem)
SELECT CASE WHEN abs(o) >= 0.2 AND abs(c) >= 0.2 THEN CASE WHEN abs(o - c) <= 0.15 AND o > 0 THEN 'shared_up' WHEN abs(o - c) <= 0.15 THEN 'shared_down' WHEN sign(o) <> sign(c) THEN 'opposed' WHEN abs(o) > abs(c) THEN 'own_more' ELSE 'cross_more' END
  WHEN abs(o) >= 0.2 THEN 'own' WHEN abs(c) >= 0.2 THEN 'cross' ELSE 'none' END AS class, count(*) AS n FROM x GROUP BY 1
"""


def length_batches(spark, d):
    rows = readout.pack_by_length(t(spark, d, "documents").select("doc_id", F.greatest(F.size(F.split("text", " ")), F.lit(1)).alias("n")), "n", 2048, 64)
    return rows.groupBy("batch").agg(F.count("*").alias("texts"), F.max("n").alias("longest")).groupBy("texts").agg(F.count("*").alias("batches"))


LENGTH_BATCHES = """
WITH n AS (SELECT CAST(ceil(greatest(len(string_split(text, ' ')), 1) / 64) * 64 AS BIGINT) AS p FROM documents), b AS (SELECT p, greatest(2048 // p, 1) AS per, count(*) AS c FROM n GROUP BY p),
s AS (SELECT unnest(list_transform(range(0, CAST((c + per - 1) // per AS BIGINT)), lambda i: least(per, c - i * per))) AS texts FROM b) SELECT texts, count(*) AS batches FROM s GROUP BY texts
"""


def answer_scores(spark, d):
    """Each order's last two log-probabilities, summed and as a mean."""
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_tax").alias("v")))), lambda x: -x["v"]).alias("lp"))
    return rows.select("l_orderkey", (F.round(A.answer_score(F.col("lp"), F.lit(2)), 6) + 0.0).alias("sum"), (F.round(A.answer_score(F.col("lp"), F.lit(2), True), 6) + 0.0).alias("mean"))


ANSWER_SCORES = """
WITH r AS (SELECT l_orderkey, l_tax, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_tax DESC) AS k FROM lineitem)
SELECT l_orderkey, CASE WHEN count(*) = 2 THEN round(-sum(l_tax), 6) + 0.0 END AS sum, CASE WHEN count(*) = 2 THEN round(-sum(l_tax) / 2, 6) + 0.0 END AS mean FROM r WHERE k <= 2 GROUP BY l_orderkey
"""


def agreeing_prompts(spark, d):
    """Conversations in two variants: those whose first prompts agree and whose replies are not blank."""
    turns = t(spark, d, "conversations")
    of = lambda text: turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", text.alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    other = F.when((F.col("conv_id") % 4 == 0) & (F.col("role") == "assistant"), " ").when((F.col("conv_id") % 4 == 1) & (F.col("role") == "user"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return chat.paired_prompts_agree(of(F.col("text")), of(other), "conv_id").select("conv_id")


AGREEING_PROMPTS = """
SELECT conv_id FROM (SELECT conv_id, bool_or(role = 'assistant') AS has_reply, bool_or(role = 'user') AS has_prompt, bool_and(role <> 'assistant' OR trim(text) <> '') AS whole FROM conversations GROUP BY conv_id)
WHERE whole AND has_prompt AND conv_id % 4 <> 1 AND NOT (conv_id % 4 = 0 AND has_reply)
"""


def minimal_pairs(spark, d):
    """Pairs made of a document's first two sentences and its words: what the checks say of the ones whose parts happen not to fit, or were cut elsewhere."""
    k, text = F.col("doc_id"), F.col("text")
    sentence = lambda i: F.coalesce(F.get(F.split(text, r"[.!?]\s*", -1), F.lit(i)), F.lit(""))
    word = lambda i: F.coalesce(F.get(F.split(sentence(1), " "), F.lit(i)), F.lit(""))
    rows = t(spark, d, "documents").select("doc_id", "lang", F.concat(sentence(0), F.lit(". ")).alias("opening"), word(0).alias("a"), word(2).alias("m"))
    opening, at = F.col("opening"), F.length("opening")
    changed = F.when(k % 5 == 1, F.concat(F.lower(F.substring(opening, 1, 1)), F.substr(opening, F.lit(2), at))).otherwise(opening)
    place = lambda off: F.struct((at + 2 - off).cast("int").alias("choice_char"))
    rows = rows.select(
        "doc_id", F.when(k % 7 == 3, F.col("lang")).otherwise("train").alias("split"), F.lit("reason_first").alias("order"), at.alias("continuation_start_char"), F.struct(F.col("a").alias("aligned"), F.col("m").alias("misaligned")).alias("options"),
        F.struct(place(F.when(k % 11 == 4, 3).otherwise(0)).alias("pos"), place(F.when(k % 13 == 5, 1).otherwise(0)).alias("neg")).alias("decision"), F.concat(opening, F.lit("I "), F.col("a"), F.lit(".")).alias("text_pos"), F.concat(changed, F.lit("I "), F.col("m"), F.lit(".")).alias("text_neg"),
    )
    return rows.select("doc_id", F.array_join(V.problems(V.pair_checks()), ",").alias("problems"))


MINIMAL_PAIRS = r"""
WITH s AS (SELECT doc_id, lang, string_split_regex(text, '[.!?]\s*') AS s FROM documents), w AS (SELECT doc_id, coalesce(s[1], '') || '. ' AS o, string_split(coalesce(s[2], ''), ' ') AS w, CASE WHEN doc_id % 7 = 3 THEN lang ELSE 'train' END AS sp FROM s),
p AS (SELECT *, coalesce(w[1], '') AS a, coalesce(w[3], '') AS m, length(o) AS at_, CASE WHEN doc_id % 5 = 1 THEN lower(substr(o, 1, 1)) || substr(o, 2) ELSE o END AS o2, CASE WHEN doc_id % 11 = 4 THEN 3 ELSE 0 END AS dp, CASE WHEN doc_id % 13 = 5 THEN 1 ELSE 0 END AS dn FROM w),
t AS (SELECT *, o || 'I ' || a || '.' AS tp, o2 || 'I ' || m || '.' AS tn FROM p)
SELECT doc_id, concat_ws(',', CASE WHEN sp NOT IN ('train', 'dev', 'test') THEN 'split' END, CASE WHEN trim(a, ' ') = '' OR trim(m, ' ') = '' OR a = m THEN 'options' END, CASE WHEN tp = tn THEN 'texts_equal' END, CASE WHEN o <> o2 THEN 'openings_differ' END,
  CASE WHEN dp > 2 THEN 'choice_in_opening' END, CASE WHEN substr(tp, at_ + 3 - dp, length(a)) <> a OR substr(tn, at_ + 3 - dn, length(m)) <> m THEN 'choice_elsewhere' END) AS problems FROM t
"""


def twin_rows(spark, d):
    return V.twins(t(spark, d, "nation").select("n_nationkey"), ("low", "high")).select("n_nationkey", "variant")


TWIN_ROWS = "SELECT n_nationkey, v AS variant FROM nation, (VALUES ('low'), ('high')) t(v)"


QUERIES = {f.__name__: f for f in (parsed_replies, normal_forms, repaired_json, position_classes, length_batches, answer_scores, agreeing_prompts, minimal_pairs, twin_rows)}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
