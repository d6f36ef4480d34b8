"""Queries for replies that become rows, mirrored texts, trees of settings and equal shards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import entries as E
from corpusloom.operators import passages as P
from corpusloom.operators import sample, tree
from corpusloom.plans.corpus import t

_ENTRY = "title string, domain string, harm string, n long"


def _replies(spark, d):
    """Each conversation's turns as the entries of a reply: some entries are no objects, or their titles are numbers or missing; some replies have prose around the list, or none."""
    turn, text = F.col("turn"), F.substring(F.trim("text"), 1, 12)
    fields = lambda title: F.to_json(F.struct(title.alias("title"), F.concat(F.lit(" "), F.initcap("role"), F.lit(".")).alias("domain"), F.when(turn % 2 == 0, "Low").otherwise("very high").alias("harm"), turn.alias("n")))
    item = F.when(turn % 6 == 5, '"only text"').when(turn % 5 == 4, fields(turn)).when(turn % 7 == 3, fields(F.lit(None).cast("string"))).otherwise(fields(text))
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))), lambda x: x["item"]), ", ").alias("items"))  # of one conversation
    listed, kind = F.concat(F.lit("["), F.col("items"), F.lit("]")), F.col("conv_id") % 6
    reply = F.when(kind == 0, listed).when(kind == 1, F.concat(F.lit('{"situations": '), listed, F.lit("}"))).when(kind == 2, F.concat(F.lit("```json\n"), listed, F.lit("\n```"))).when(kind == 3, F.concat(F.lit("Here you are: "), listed, F.lit(" Done.")))
    return rows.select("conv_id", reply.when(kind == 4, '{"situations": "none"}').otherwise("there is no list").alias("reply"))


def _entries(spark, d):
    return E.entries_of(_replies(spark, d), ["conv_id"], "reply", _ENTRY, ["title", "domain"], "situations")


def reply_entries(spark, d):
    return _entries(spark, d).select("conv_id", "place", "reason", "entry.title", F.col("entry.domain").alias("domain"), "entry.n")


_ROWS = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, substr(trim(text, ' '), 1, 12) AS head FROM conversations)"
_REASON = "CASE WHEN turn % 6 = 5 THEN 'not_an_object' WHEN turn % 5 = 4 THEN 'not_text:title' WHEN turn % 7 = 3 THEN 'missing:title' WHEN trim(head, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 'blank:title' END"
REPLY_ENTRIES = f"""
WITH r AS (SELECT *, {_REASON} AS reason, upper(substr(role, 1, 1)) || substr(role, 2) AS cap FROM {_ROWS} WHERE conv_id % 6 < 4)
SELECT conv_id, CAST(place AS INTEGER) AS place, reason, CASE WHEN reason IS NULL THEN head END AS title, CASE WHEN reason IS NULL THEN ' ' || cap || '.' END AS domain, CASE WHEN reason IS NULL THEN turn END AS n FROM r
UNION ALL
SELECT DISTINCT conv_id, CAST(NULL AS INTEGER), CASE conv_id % 6 WHEN 4 THEN 'no_list' ELSE 'no_json' END, NULL, NULL, CAST(NULL AS BIGINT) FROM conversations WHERE conv_id % 6 >= 4
"""


def reply_rejects(spark, d):
    """How often each reason comes, and how many replies it comes in."""
    return E.rejects(_entries(spark, d)).groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("replies"))


REPLY_REJECTS = f"""
WITH r AS (SELECT conv_id, {_REASON} AS reason FROM {_ROWS} WHERE conv_id % 6 < 4),
x AS (SELECT conv_id, reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT conv_id, 'no_items' FROM r GROUP BY conv_id HAVING count(*) = count(reason)
  UNION ALL SELECT DISTINCT conv_id, CASE conv_id % 6 WHEN 4 THEN 'no_list' ELSE 'no_json' END FROM conversations WHERE conv_id % 6 >= 4)
SELECT reason, count(*) AS n, count(DISTINCT conv_id) AS replies FROM x GROUP BY reason
"""


def catalog_situations(spark, d):
    """Good entries as rows of a catalog; two settings a call, the second one's level is high."""
    slots = F.array(F.struct(F.lit("User").alias("domain"), F.lit("low").alias("harm")), F.struct(F.lit("assistant").alias("domain"), F.lit("high").alias("harm")))
    rows = E.situations(E.good(_entries(spark, d)).withColumn("slots", slots), "slots", F.lit("fe"), F.col("conv_id") * 10 + 1, 7)
    return rows.select("conv_id", "id", "domain", "harm", "title", F.array_join("notes", "; ").alias("notes"))


CATALOG_SITUATIONS = f"""
WITH r AS (SELECT *, {_REASON} AS reason FROM {_ROWS} WHERE conv_id % 6 < 4),
s AS (SELECT *, CASE WHEN role = 'user' THEN 'User' WHEN role = 'assistant' THEN 'assistant' WHEN place = 0 THEN 'User' WHEN place = 1 THEN 'assistant' ELSE role END AS domain, CASE WHEN turn % 2 = 0 THEN 'low' ELSE 'very_high' END AS said FROM r WHERE reason IS NULL),
h AS (SELECT *, CASE domain WHEN 'User' THEN 'low' WHEN 'assistant' THEN 'high' END AS harm FROM s)
SELECT conv_id, 'fe' || lpad(CAST(conv_id * 10 + 1 + place AS VARCHAR), 7, '0') AS id, domain, harm, trim(head, ' ') AS title, CASE WHEN harm <> said THEN 'the writer gave its harm as ' || said || ', not ' || harm ELSE '' END AS notes FROM h
"""


def _lines(spark, d):
    """Lines of all documents; every third one begins with a heading."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# "), F.col("text"))).otherwise(F.col("text"))
    return P.spec_lines(t(spark, d, "documents"), "doc_id", text)


_LINES = """(SELECT doc_id, line, trim(text, ' ') AS text, CASE WHEN trim(text, ' ') LIKE '#%' THEN 'heading' ELSE 'paragraph' END AS kind FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '# ' || text ELSE text END AS text FROM documents)) WHERE trim(text, ' ') <> '')"""


def mirrored_documents(spark, d):
    """Whether each two neighbouring documents have their lines at the same places, and where they part."""
    lines = _lines(spark, d).withColumn("pair", F.floor(F.col("doc_id") / 2))
    pairs = P.aligned(lines.filter("doc_id % 2 = 0"), lines.filter("doc_id % 2 = 1"), ["pair"])
    counts = pairs.groupBy("pair").agg(F.count("*").alias("lines"), *[F.count(F.when(F.col("problem") == p, 1)).alias(p) for p in ("only_first", "only_second", "kinds_differ")])
    return counts.join(P.mirrored(pairs, ["pair"]), "pair")


MIRRORED_DOCUMENTS = f"""
WITH l AS (SELECT *, doc_id // 2 AS pair FROM {_LINES}), x AS (SELECT * FROM l WHERE doc_id % 2 = 0), y AS (SELECT * FROM l WHERE doc_id % 2 = 1),
j AS (SELECT coalesce(x.pair, y.pair) AS pair, coalesce(x.line, y.line) AS line, CASE WHEN y.line IS NULL THEN 'only_first' WHEN x.line IS NULL THEN 'only_second' WHEN x.kind <> y.kind THEN 'kinds_differ' END AS problem
  FROM x FULL JOIN y ON x.pair = y.pair AND x.line = y.line)
SELECT pair, count(*) AS lines, count(*) FILTER (problem = 'only_first') AS only_first, count(*) FILTER (problem = 'only_second') AS only_second, count(*) FILTER (problem = 'kinds_differ') AS kinds_differ,
  count(problem) = 0 AS mirrored, min(line) FILTER (problem IS NOT NULL) AS first_problem FROM j GROUP BY pair
"""


def drawn_texts(spark, d):
    """Three paragraphs of each document by hash, in its order."""
    lines = _lines(spark, d).filter("kind = 'paragraph'")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(X.digest(42, "passages", F.col("doc_id"), F.col("line"))))  # a document's lines
    drawn = lines.withColumn("r", rank).filter("r <= 3").select("doc_id", "line")
    return P.passage_text(drawn, lines, ["doc_id"], ["doc_id"], "text").select("doc_id", F.md5("passage").alias("passage"))


DRAWN_TEXTS = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sha256('42:passages:' || doc_id || ':' || line)) AS r FROM {_LINES} WHERE kind = 'paragraph')
SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY line)) AS passage FROM r WHERE r <= 3 GROUP BY doc_id
"""


def tree_settings(spark, d):
    """Parts as a tree: settings come from the nearest ancestor that has them; some branches hang on a parent that is not there."""
    key, size = F.col("p_partkey"), F.col("p_size")
    parent = F.when(key % 97 == 5, -1).when(key > 0, F.floor((key - 1) / 2))
    nodes = t(spark, d, "part").select("p_partkey", parent.cast("long").alias("parent"), F.when(size % 4 == 0, F.col("p_type")).alias("type"), F.when(size % 9 == 0, size).alias("size"), "p_brand")
    return tree.inherited(nodes, "p_partkey", "parent", ["type", "size"], "p_brand")


TREE_SETTINGS = """
WITH RECURSIVE n AS (SELECT p_partkey, CASE WHEN p_partkey % 97 = 5 THEN -1 WHEN p_partkey > 0 THEN (p_partkey - 1) // 2 END AS parent, CASE WHEN p_size % 4 = 0 THEN p_type END AS type, CASE WHEN p_size % 9 = 0 THEN p_size END AS size, p_brand FROM part),
f AS (
  SELECT p_partkey, CAST(0 AS BIGINT) AS depth, p_partkey AS root, parent IS NOT NULL AS orphan, type, size, p_brand AS path FROM n WHERE parent IS NULL OR parent NOT IN (SELECT p_partkey FROM n)
  UNION ALL
  SELECT n.p_partkey, f.depth + 1, f.root, f.orphan, coalesce(n.type, f.type), coalesce(n.size, f.size), f.path || '/' || n.p_brand FROM n JOIN f ON n.parent = f.p_partkey
)
SELECT * FROM f
"""


def eval_shards(spark, d):
    """Seven shards of full batches of 64: rows, those that count, and the sum of their values."""
    rows = sample.equal_shards(t(spark, d, "events").select("event_id", "value"), ["event_id"], 7, 64)
    return rows.groupBy("shard", "batch").agg(F.count("*").alias("n"), F.sum("weight").alias("counted"), F.round(F.sum(F.col("value") * F.col("weight")), 4).alias("total"))


EVAL_SHARDS = """
WITH r AS (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events), b AS (SELECT count(*) AS n, ((count(*) + 6) // 7 + 63) // 64 AS batches FROM events),
s AS (SELECT CAST(s.range AS INTEGER) AS shard, k.range AS batch FROM range(7) s, b, range(1000000) k WHERE k.range < batches)
SELECT s.shard, s.batch, CAST(64 AS BIGINT) AS n, CAST(count(r.i) AS BIGINT) AS counted, round(coalesce(sum(value), 0), 4) AS total FROM s LEFT JOIN r ON r.i % 7 = s.shard AND r.i // 7 // 64 = s.batch GROUP BY ALL
"""

QUERIES = {f.__name__: f for f in (reply_entries, reply_rejects, catalog_situations, mirrored_documents, drawn_texts, tree_settings, eval_shards)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
