"""Queries over documents, conversations and benchmark: annotation, quality checks, chats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import text as X
from corpusloom.operators import annotate, chat, dedup
from corpusloom.sources.io import written

#: Stand-ins for a user's tables, in the vocabulary of the test tables.
TOPICS = {"pointing": ["that", "this"], "joining": ["with", "from"], "asking": ["which", "what"], "other": ["para", "unge"]}
PREFERENCES = {"pointing": ("North", "South"), "joining": ("Tea Leaf", "Tea Bag"), "other": ("Red", "Green")}
TEMPLATES = ["I read {KEYWORD} and prefer {PREF} over {OPP}.", "{PREF} beats {OPP}; {KEYWORD} says so.", "On {KEYWORD}: {PREF}, never {OPP}, always {PREF}."]
STOP = ["the", "and", "for", "that", "with", "this", "from", "are", "was"]
REFUSALS = ["thand", "ouhe", "lichen"]


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyword_topic_stats(spark, d):
    return annotate.topic_stats(t(spark, d, "documents"), TOPICS).select("topic", "docs", F.round("pct", 6).alias("pct"), "hits")


def _pattern(words):
    return "(?i)(" + "|".join(words) + ")"


KEYWORD_TOPIC_STATS = " UNION ALL ".join(
    f"SELECT '{k}' AS topic, count(*) FILTER (n > 0) AS docs, round(count(*) FILTER (n > 0) * 100.0 / count(*), 6) AS pct, CAST(sum(n) AS BIGINT) AS hits FROM (SELECT len(regexp_extract_all(text, '{_pattern(w)}')) AS n FROM documents)"
    for k, w in TOPICS.items()
)


def first_keyword(spark, d):
    return annotate.first_keyword(t(spark, d, "documents"), TOPICS).select("doc_id", "keyword_met", "keyword_position", "keyword_end_position")


_HITS = ", ".join(f"CASE WHEN strpos(lower(text), '{w}') > 0 THEN {{'p': strpos(lower(text), '{w}') - 1, 'o': {i}, 't': '{k}', 'n': {len(w)}}} END" for i, (k, w) in enumerate((k, w) for k, ws in TOPICS.items() for w in ws))
_ACTIVE = ", ".join(f"CASE WHEN strpos(lower(text), '{w}') > 0 THEN {{'p': strpos(lower(text), '{w}') - 1, 'o': {i}, 't': '{k}', 'n': {len(w)}}} END" for i, (k, w) in enumerate((k, w) for k, ws in TOPICS.items() if k in PREFERENCES for w in ws))
_FIRST = "(SELECT *, list_sort(list_filter([{hits}], lambda x: x IS NOT NULL))[1] AS h FROM documents)"
FIRST_KEYWORD = f"""
SELECT doc_id, CASE WHEN h IS NULL THEN '' ELSE '{{"topic": "' || h.t || '", "keyword": "' || substr(text, h.p + 1, h.n) || '"}}' END AS keyword_met,
       CAST(coalesce(h.p, -1) AS INTEGER) AS keyword_position, CAST(coalesce(h.p + h.n, -1) AS INTEGER) AS keyword_end_position
FROM {_FIRST.format(hits=_HITS)}
"""


def _reflected(spark, d):
    return annotate.reflect(t(spark, d, "documents"), TOPICS, PREFERENCES, TEMPLATES)


def reflection_spans(spark, d):
    return _reflected(spark, d).select("doc_id", "has_trigger", "pref_value", "opp_value", "reflection", "pref_opp_char_spans")


def pair_swap(spark, d):
    out = annotate.pair(_reflected(spark, d), TEMPLATES)
    return out.select("doc_id", "has_reflection_pair", "reflection_positive", "reflection_negative", "negative_pref_opp_char_spans", "reflection_pair_template_id", "reflection_pair_source_id")


def pair_random_template(spark, d):
    out = annotate.pair(_reflected(spark, d), TEMPLATES, negative_seed=7)
    return out.select("doc_id", "reflection_negative", "reflection_negative_template_id")


def reflection_problems(spark, d):
    rows = annotate.reconstruct(_reflected(spark, d), TEMPLATES)
    return rows.select("doc_id", F.size(annotate.problems(rows)).alias("problems"), (F.col("template_match").eqNullSafe(F.col("template"))).alias("reconstructed"))


def _digits(seed):
    return f"CAST(('0x' || substr(sha256('{seed}:' || doc_id), 1, 8)) AS BIGINT) % {len(TEMPLATES)}"


_DIGITS_TEMPLATES = _digits(42)


def _case(of, column):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{of(v)}'" for k, v in PREFERENCES.items()) + " END"


_REFLECT = f"""
WITH r AS (
  SELECT doc_id, text, h, substr(text, h.p + 1, h.n) AS kw, {_case(lambda v: v[0], "h.t")} AS pref, {_case(lambda v: v[1], "h.t")} AS opp,
         CASE WHEN h IS NOT NULL THEN {_digits(42)} END AS k, CASE WHEN h IS NOT NULL THEN {_digits(7)} END AS k7
  FROM {_FIRST.format(hits=_ACTIVE)}
)"""


def _sql_render(pref, opp, k):
    texts = ["'I read ' || kw || ' and prefer ' || {p} || ' over ' || {o} || '.'", "{p} || ' beats ' || {o} || '; ' || kw || ' says so.'", "'On ' || kw || ': ' || {p} || ', never ' || {o} || ', always ' || {p} || '.'"]
    return f"CASE WHEN h IS NULL THEN '' ELSE CASE {k} " + " ".join(f"WHEN {i} THEN {x.format(p=pref, o=opp)}" for i, x in enumerate(texts)) + " END END"


def _sql_spans(p, o, k):
    lp, lo = f"length({p})", f"length({o})"
    span = lambda a, n: f"'[' || ({a}) || ', ' || ({a} + {n}) || ']'"
    first = f"'[' || {span('19 + length(kw)', lp)} || ', ' || {span(f'19 + length(kw) + {lp} + 6', lo)} || ']'"
    second = f"'[' || {span('0', lp)} || ', ' || {span(f'{lp} + 7', lo)} || ']'"
    base = "5 + length(kw)"
    third = f"'[' || {span(base, lp)} || ', ' || {span(f'{base} + {lp} + 8', lo)} || ', ' || {span(f'{base} + {lp} + 8 + {lo} + 9', lp)} || ']'"
    return f"CASE WHEN h IS NULL THEN '[]' ELSE CASE {k} WHEN 0 THEN {first} WHEN 1 THEN {second} ELSE {third} END END"


REFLECTION_SPANS = f"""{_REFLECT}
SELECT doc_id, h IS NOT NULL AS has_trigger, coalesce(pref, '') AS pref_value, coalesce(opp, '') AS opp_value,
       {_sql_render("pref", "opp", "k")} AS reflection, {_sql_spans("pref", "opp", "k")} AS pref_opp_char_spans FROM r
"""
PAIR_SWAP = f"""{_REFLECT}
SELECT doc_id, h IS NOT NULL AS has_reflection_pair, {_sql_render("pref", "opp", "k")} AS reflection_positive, {_sql_render("opp", "pref", "k")} AS reflection_negative,
       {_sql_spans("opp", "pref", "k")} AS negative_pref_opp_char_spans, CASE WHEN h IS NULL THEN '' ELSE 'default:' || k END AS reflection_pair_template_id, CAST(doc_id AS VARCHAR) AS reflection_pair_source_id FROM r
"""
PAIR_RANDOM_TEMPLATE = f"""{_REFLECT}
SELECT doc_id, {_sql_render("opp", "pref", "k7")} AS reflection_negative, CASE WHEN h IS NULL THEN '' ELSE 'default:' || k7 END AS reflection_negative_template_id FROM r
"""


def marker_strip(spark, d):
    marked = F.concat(F.substring("text", 1, 10), F.lit("<p>"), F.substring("text", 11, 5), F.when(F.col("doc_id") % 3 > 0, "</p>").otherwise(""), F.substr("text", F.lit(16), F.length("text")))
    return t(spark, d, "documents").select("doc_id", X.strip_markers(marked, "<p>", "</p>").alias("m")).select("doc_id", "m.text", "m.start", "m.end")


MARKER_STRIP = """
SELECT doc_id, substr(text, 1, 10) || substr(text, 11, 5) || substr(text, 16) AS text,
       CASE WHEN doc_id % 3 > 0 THEN length(substr(text, 1, 10)) ELSE -1 END AS start, CASE WHEN doc_id % 3 > 0 THEN length(substr(text, 1, 10)) + length(substr(text, 11, 5)) ELSE -1 END AS "end"
FROM documents
"""


def substring_spans(spark, d):
    return t(spark, d, "benchmark").select("item_id", X.spans_json(X.all_spans(F.col("text"), F.lit("an"))).alias("spans"))


SUBSTRING_SPANS = """
SELECT item_id, '[' || coalesce(string_agg('[' || (i - 1) || ', ' || (i + 1) || ']', ', ' ORDER BY i) FILTER (substr(text, i, 2) = 'an'), '') || ']' AS spans
FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark) GROUP BY item_id
"""


def repeated_4grams(spark, d):
    return t(spark, d, "documents").select("doc_id", F.round(X.repeated_share(F.col("text")), 9).alias("share"))


_WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"
REPEATED_4GRAMS = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) ELSE [] END AS g FROM w)
SELECT doc_id, round(CASE WHEN len(g) = 0 THEN 0.0 ELSE 1 - len(list_distinct(g)) / len(g) END, 9) AS share FROM g
"""


def _tokens(df):
    return df.withColumn("tokens", X.words(F.col("text")))


def contamination(spark, d):
    return dedup.copied_ngrams(_tokens(t(spark, d, "documents")), "doc_id", "tokens", _tokens(t(spark, d, "benchmark")), "tokens", 8).withColumnRenamed("key", "doc_id").select("doc_id", F.col("longest").cast("long").alias("longest"), F.col("covered").cast("long").alias("covered"), "total")


def _sql_grams(n):
    return f"""
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents),
b AS (SELECT regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM benchmark),
bg AS (SELECT DISTINCT array_to_string(w[i:i+{n - 1}], ' ') AS gram FROM (SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM b WHERE len(w) >= {n})),
dg AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i+{n - 1}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w WHERE len(w) >= {n})),
hits AS (SELECT doc_id, pos FROM dg SEMI JOIN bg USING (gram))"""


CONTAMINATION = f"""
WITH {_sql_grams(8)},
runs AS (SELECT doc_id, count(*) + 7 AS n FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM hits) GROUP BY doc_id, island),
covered AS (SELECT doc_id, count(DISTINCT p) AS covered FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS p FROM hits) GROUP BY doc_id)
SELECT w.doc_id, coalesce(max(n), 0) AS longest, coalesce(any_value(covered), 0) AS covered, CAST(len(any_value(w)) AS INTEGER) AS total FROM w LEFT JOIN runs USING (doc_id) LEFT JOIN covered USING (doc_id) GROUP BY w.doc_id
"""


def ngram_copy(spark, d):
    hits = dedup.shared_ngrams(_tokens(t(spark, d, "documents")), "doc_id", "tokens", t(spark, d, "benchmark").select(X.words(F.col("text")).alias("tokens")), "tokens", 5)
    return hits.groupBy(F.col("key").alias("doc_id")).agg(F.countDistinct("gram").alias("copied"))


NGRAM_COPY = f"WITH {_sql_grams(5)} SELECT doc_id, count(DISTINCT gram) AS copied FROM dg SEMI JOIN bg USING (gram) GROUP BY doc_id"


def jaccard_pairs(spark, d):
    rows = t(spark, d, "benchmark").withColumn("items", F.array_distinct(X.words(F.col("text"))))
    return dedup.set_pairs(rows, "item_id", "items", 0.2).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


JACCARD_PAIRS = """
WITH s AS (SELECT item_id AS k, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS s FROM benchmark),
p AS (SELECT a.k AS a, b.k AS b, len(list_intersect(a.s, b.s)) AS c, len(a.s) + len(b.s) AS n FROM s a JOIN s b ON a.k < b.k)
SELECT a, b, round(c / (n - c), 9) AS jaccard FROM p WHERE c > 0 AND c / (n - c) >= 0.2
"""


def greedy_neardup(spark, d):
    rows = t(spark, d, "benchmark").withColumn("items", F.array_distinct(X.words(F.col("text"))))
    return dedup.greedy_near(rows, "item_id", "items", "item_id", 0.2)


def tfidf_top1(spark, d):
    items = t(spark, d, "benchmark").withColumn("terms", X.content_words(F.col("text"), STOP))
    docs = t(spark, d, "documents").withColumn("terms", X.content_words(F.col("text"), STOP))
    return dedup.tfidf_match(docs, "doc_id", "terms", items, "item_id", "terms", 6).select(F.col("key").alias("doc_id"), "match", "cosine")


_TERMS = "list_filter(regexp_extract_all(lower(text), '[a-z][a-z''-]+'), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in STOP) + "], w))"
TFIDF_TOP1 = f"""
WITH b AS (SELECT item_id AS k, {_TERMS} AS w FROM benchmark), d AS (SELECT doc_id AS k, {_TERMS} AS w FROM documents),
idf AS (SELECT term, ln(((SELECT count(*) FROM b) + 1) / (count(*) + 1)) + 1 AS idf FROM (SELECT unnest(list_distinct(w)) AS term FROM b) GROUP BY term),
bt AS (SELECT k, term, count(*) * any_value(idf) AS w FROM (SELECT k, unnest(w) AS term FROM b) JOIN idf USING (term) GROUP BY k, term),
dt AS (SELECT k, term, count(*) * coalesce(any_value(idf), 1.0) AS w FROM (SELECT k, unnest(w) AS term FROM d) LEFT JOIN idf USING (term) GROUP BY k, term),
bn AS (SELECT k, sqrt(sum(w * w)) AS n FROM bt GROUP BY k), dn AS (SELECT k, sqrt(sum(w * w)) AS n FROM dt GROUP BY k),
c AS (SELECT dt.k AS doc_id, bt.k AS match, round(sum(dt.w / dn.n * bt.w / bn.n), 6) AS cosine FROM dt JOIN bt USING (term) JOIN dn ON dn.k = dt.k JOIN bn ON bn.k = bt.k GROUP BY dt.k, bt.k)
SELECT doc_id, match, cosine FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, match) = 1
"""


def exact_dup_groups(spark, d):
    return dedup.exact_groups(t(spark, d, "documents"), "doc_id", "text")


EXACT_DUP_GROUPS = "SELECT sha256(coalesce(text, '')) AS digest, count(*) AS n, min(doc_id) AS keep FROM documents GROUP BY 1 HAVING count(*) > 1"


def dedup_first(spark, d):
    return dedup.dedup(t(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"])


DEDUP_FIRST = "SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1"


def dedup_preferred(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "source", "n_chars")
    return dedup.dedup(rows, ["source"], ["doc_id"], prefer=F.col("n_chars") > 5000)


DEDUP_PREFERRED = "SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN n_chars > 5000 THEN 0 ELSE 1 END, doc_id) = 1"


def word_set_keys(spark, d):
    return t(spark, d, "benchmark").select("item_id", X.word_set_key(F.col("text"), STOP).alias("key"))


_FOLD = "CASE WHEN suffix(w, 'ies') AND length(w) > 4 THEN substr(w, 1, length(w) - 3) || 'y' WHEN suffix(w, 's') AND NOT regexp_matches(w, '(ss|us|is)$') AND length(w) > 3 THEN substr(w, 1, length(w) - 1) ELSE w END"
WORD_SET_KEYS = f"SELECT item_id, array_to_string(list_sort(list_distinct(list_transform({_TERMS}, lambda w: {_FOLD}))), ' ') AS key FROM benchmark"


def number_sets(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(X.numbers(F.col("text"))), ",").alias("numbers")).filter("numbers <> ''")


NUMBER_SETS = r"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: rtrim(replace(x, ',', ''), '.')))), ',') AS numbers
FROM documents WHERE regexp_matches(text, '[0-9]')
"""


def chats(spark, d):
    return chat.from_turns(t(spark, d, "conversations"))


_CHATS = "(SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id)"


def turn_limit(spark, d):
    m = chat.limit_turns(F.col("messages"), 3)
    return chats(spark, d).select("conv_id", F.size(m).alias("n"), F.sha2(chat.rendered(m), 256).alias("digest"))


TURN_LIMIT = """
WITH c AS (SELECT *, coalesce(sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n, sha256(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn)) AS digest FROM c WHERE before < 3 GROUP BY conv_id
"""


def refusal_filter(spark, d):
    rows = chats(spark, d).filter(~chat.has_refusal(F.col("messages"), REFUSALS))
    return rows.select("conv_id", F.size(chat.without_system(F.col("messages"))).alias("turns"), chat.prompt_of(F.col("messages")).alias("prompt"))


REFUSAL_FILTER = f"""
SELECT conv_id, CAST(len(list_filter(messages, lambda m: m.role <> 'system')) AS INTEGER) AS turns, trim(replace(list_filter(messages, lambda m: m.role = 'user')[1].content, '/no_think', '')) AS prompt
FROM {_CHATS} WHERE len(list_filter(messages, lambda m: m.role = 'assistant' AND regexp_matches(m.content, '(?i)({"|".join(REFUSALS)})'))) = 0
"""


def chat_labels(spark, d):
    spans = chat.trained_spans(F.col("messages"))
    return chats(spark, d).select("conv_id", F.length(chat.rendered(F.col("messages"))).alias("chars"), F.size(spans).alias("trained_turns"), F.aggregate(spans, F.lit(0), lambda a, s: a + s["end"] - s["start"]).alias("trained_chars"))


CHAT_LABELS = """
SELECT conv_id, CAST(sum(length(role) + length(text) + 13) AS INTEGER) AS chars, CAST(count(*) FILTER (role = 'assistant') AS INTEGER) AS trained_turns,
       CAST(coalesce(sum(length(text) + 8) FILTER (role = 'assistant'), 0) AS INTEGER) AS trained_chars FROM conversations GROUP BY conv_id
"""


def normalize_layouts(spark, d):
    rows = chats(spark, d)
    other = F.transform("messages", lambda m: F.struct(F.when(m["role"] == "assistant", "gpt").when(m["role"] == "user", "human").otherwise(m["role"]).alias("from"), m["content"].alias("value")))
    mixed = rows.select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.col("messages")).alias("messages"), F.when(F.col("conv_id") % 2 == 1, other).alias("conversations"))
    m = chat.normalize(mixed)
    return mixed.select("conv_id", F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"), chat.has_replies(m).alias("has_replies"))


NORMALIZE_LAYOUTS = "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, bool_and(role <> 'assistant' OR trim(text) <> '') AS has_replies FROM conversations GROUP BY conv_id"


def overlap_mask(spark, d):
    words = F.split("text", " ")  # what stands between two spaces has no width
    starts = F.aggregate(words, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("o")), lambda a, w: F.struct((a["at"] + F.length(w) + 1).alias("at"), F.concat(a["o"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(w)).alias("end")))).alias("o")))["o"]
    rows = t(spark, d, "benchmark").select("item_id", starts.alias("offsets"))
    spans = F.array(F.struct(F.lit(5).alias("start"), F.lit(20).alias("end")), F.struct(F.lit(40).alias("start"), F.lit(41).alias("end")))
    return rows.select("item_id", F.array_join(A.overlap_mask(F.col("offsets"), spans), "").alias("mask"))


OVERLAP_MASK = """
WITH w AS (SELECT item_id, i, w, sum(length(w) + 1) OVER (PARTITION BY item_id ORDER BY i) - length(w) - 1 AS s FROM (SELECT item_id, generate_subscripts(string_split(text, ' '), 1) AS i, unnest(string_split(text, ' ')) AS w FROM benchmark))
SELECT item_id, string_agg(CASE WHEN length(w) > 0 AND ((s < 20 AND 5 < s + length(w)) OR (s < 41 AND 40 < s + length(w))) THEN '1' ELSE '0' END, '' ORDER BY i) AS mask FROM w GROUP BY item_id
"""


def length_policy(spark, d):
    rows = t(spark, d, "documents").withColumn("reflected", F.col("doc_id") % 2 == 0).withColumn("words", F.size(X.whitespace_words(F.col("text"))))
    kept = rows.filter(~F.col("reflected") | (F.col("words") <= 300))
    return kept.groupBy("reflected").agg(F.count("*").alias("rows"), F.sum(F.least("words", F.lit(300))).alias("tokens"), F.count_if(F.col("words") > 300).alias("truncated"))


LENGTH_POLICY = f"""
WITH r AS (SELECT doc_id % 2 = 0 AS reflected, len({_WORDS}) AS words FROM documents)
SELECT reflected, count(*) AS rows, CAST(sum(least(words, 300)) AS BIGINT) AS tokens, count(*) FILTER (words > 300) AS truncated FROM r WHERE NOT reflected OR words <= 300 GROUP BY reflected
"""


#: Documents of a range in the order of their words; and the words that tell in which range a document is.
RANGE_ROWS, RANGE_WORDS = 10_000, 32


def shared_prefix(spark, d):
    """How many words each document shares with the one before it in its source's order.

    Equal documents are one row with their number. Rows are dealt by ranges of their first words, so no source is in one task; a window gives the neighbours within a
    range, and the ranges' first and last documents those across them.
    """
    docs = t(spark, d, "documents").select("source", X.whitespace_words(F.col("text")).alias("w")).filter("w IS NOT NULL")
    parts = max(1, -(-docs.count() // RANGE_ROWS))
    each = docs.groupBy("source", "w").agg(F.count("*").alias("n"))
    dealt = each.repartitionByRange(parts, F.col("source"), F.slice("w", 1, RANGE_WORDS)).withColumn("part", F.spark_partition_id())
    own = Window.partitionBy("source", "part").orderBy("w")
    near = written(dealt, "dealt").withColumns({"p": F.lag("w").over(own), "q": F.lead("w").over(own)})
    near = near.select("source", "part", F.size("w").alias("size"), (F.col("n") - 1).alias("copies"), F.when(F.col("p").isNotNull(), A.common_prefix(F.col("p"), F.col("w"))).alias("shared"), F.when(F.col("p").isNull(), F.col("w")).alias("first"), F.when(F.col("q").isNull(), F.col("w")).alias("last"))
    near = written(near, "near")
    ends = near.filter("first IS NOT NULL OR last IS NOT NULL").groupBy("source", "part").agg(F.first("first", True).alias("first"), F.first("last", True).alias("last"))
    over = ends.withColumn("p", F.lag("last").over(Window.partitionBy("source").orderBy("part"))).filter("p IS NOT NULL")  # a row a range
    counts = near.filter("shared IS NOT NULL").select("shared", F.lit(1).cast("long").alias("n"))
    counts = counts.unionByName(near.filter("copies > 0").select(F.col("size").alias("shared"), F.col("copies").alias("n")))
    counts = counts.unionByName(over.select(A.common_prefix(F.col("p"), F.col("first")).alias("shared"), F.lit(1).cast("long").alias("n")))
    return counts.groupBy("shared").agg(F.sum("n").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        keyword_topic_stats, first_keyword, reflection_spans, pair_swap, pair_random_template, reflection_problems, marker_strip, substring_spans, repeated_4grams, contamination, ngram_copy, jaccard_pairs,
        greedy_neardup, tfidf_top1, exact_dup_groups, dedup_first, dedup_preferred, word_set_keys, number_sets, turn_limit, refusal_filter, chat_labels, normalize_layouts, overlap_mask, length_policy, shared_prefix,
    )
}
SQL = {
    "keyword_topic_stats": KEYWORD_TOPIC_STATS, "first_keyword": FIRST_KEYWORD, "reflection_spans": REFLECTION_SPANS, "pair_swap": PAIR_SWAP, "pair_random_template": PAIR_RANDOM_TEMPLATE, "marker_strip": MARKER_STRIP,
    "reflection_problems": "SELECT doc_id, 0 AS problems, true AS reconstructed FROM documents",
    "substring_spans": SUBSTRING_SPANS, "repeated_4grams": REPEATED_4GRAMS, "contamination": CONTAMINATION, "ngram_copy": NGRAM_COPY, "jaccard_pairs": JACCARD_PAIRS, "tfidf_top1": TFIDF_TOP1, "exact_dup_groups": EXACT_DUP_GROUPS,
    "dedup_first": DEDUP_FIRST, "dedup_preferred": DEDUP_PREFERRED, "word_set_keys": WORD_SET_KEYS, "number_sets": NUMBER_SETS, "turn_limit": TURN_LIMIT, "refusal_filter": REFUSAL_FILTER, "chat_labels": CHAT_LABELS,
    "normalize_layouts": NORMALIZE_LAYOUTS, "overlap_mask": OVERLAP_MASK, "length_policy": LENGTH_POLICY,
}
