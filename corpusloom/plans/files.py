"""Queries that read and write files: each writes a test table to the shared folder in some format and reads it back through the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import external
from corpusloom.sources import banks, io
from corpusloom.plans.corpus import t


def jsonl_rows(spark, d):
    """Documents as compressed JSONL and back."""
    path = io.scratch(spark, "jsonl")
    t(spark, d, "documents").select("doc_id", "text", "lang").write.option("compression", "gzip").json(path)
    return io.read_jsonl(spark, f"{path}/", "doc_id long, text string, lang string").select("doc_id", F.sha2("text", 256).alias("sha"), "lang")


JSONL_ROWS = "SELECT doc_id, sha256(text) AS sha, lang FROM documents"


def jsonl_broken(spark, d):
    """Turns as JSONL in which every seventh conversation is cut off: its lines are dropped."""
    path = io.scratch(spark, "broken")
    line = F.to_json(F.struct("conv_id", "turn", "role"))
    rows = t(spark, d, "conversations").select(F.when(F.col("conv_id") % 7 == 0, F.substr(line, F.lit(1), F.length(line) - 3)).otherwise(line))
    rows.write.text(path)
    return io.read_jsonl(spark, f"{path}/", "conv_id long, turn long, role string", "drop").select("conv_id", "turn", "role")


JSONL_BROKEN = "SELECT conv_id, turn, role FROM conversations WHERE conv_id % 7 <> 0"


def csv_table(spark, d):
    """Conversations as an ordered CSV, with quotes and line ends in fields, and back."""
    path = io.scratch(spark, "csv")
    rows = t(spark, d, "conversations").withColumn("said", F.when(F.col("turn") % 5 != 0, F.concat(F.lit('he said "'), F.col("text"), F.lit('",\n')))).withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    banks.write_table(rows, path, ["said", "key", "role"])
    back = io.read_csv(spark, path, required=("key", "said"))
    return back.select(F.col("key").cast("long").alias("key"), "role", F.sha2(F.coalesce("said", F.lit("")), 256).alias("sha"))


CSV_TABLE = "SELECT conv_id * 1000 + turn AS key, role, sha256(CASE WHEN turn % 5 <> 0 THEN 'he said \"' || text || '\",' || chr(10) ELSE '' END) AS sha FROM conversations"


def text_tree(spark, d):
    """A file per nation, found below a folder in the order of their paths, with digests."""
    path = io.scratch(spark, "tree")
    t(spark, d, "nation").select(F.col("n_name").alias("value"), "n_regionkey", "n_nationkey").repartition(1).write.partitionBy("n_regionkey", "n_nationkey").text(path)
    key = F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int")
    texts = io.read_tree(spark, path).select(key.alias("n_nationkey"), "text")
    found = io.file_digests(spark, io.files(spark, path, (".txt",))).select(key.alias("n_nationkey"), "bytes", "sha256")
    return texts.join(found, "n_nationkey").select("n_nationkey", F.trim(F.replace("text", F.lit("\n"), F.lit(""))).alias("name"), "bytes", "sha256")


TEXT_TREE = "SELECT n_nationkey, n_name AS name, length(n_name) + 1 AS bytes, sha256(n_name || chr(10)) AS sha256 FROM nation"


def published_rows(spark, d):
    """What a staged write's manifest says, and whether the same inputs find it prepared."""
    path = io.scratch(spark, "published")
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    said = io.publish(rows, path, {"seed": 42, "key": io.settings_key({"a": 1})})
    ready = io.prepared(spark, path, {"seed": 42, "key": io.settings_key({"a": 1})})
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n")).select("o_orderstatus", "n", F.lit(said["rows"]).cast("long").alias("rows"), F.lit(len(said["columns"])).alias("columns"), F.lit(ready).alias("ready"))


PUBLISHED_ROWS = 'SELECT o_orderstatus, count(*) AS n, (SELECT count(*) FROM orders) AS "rows", 2 AS "columns", TRUE AS ready FROM orders GROUP BY o_orderstatus'


def unlike_sources(spark, d):
    """Sources with unlike columns one below the other; a folder whose Parquet files are deeper; the chosen split."""
    path = io.scratch(spark, "deep")
    t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")).write.parquet(f"{path}/a/train")
    one = io.choose_split({"test": spark.range(0).toDF("key"), "train": io.resolve(spark, path)})
    both = io.union_by_name([one, t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))])
    return both.groupBy(F.col("name").isNull().alias("unnamed")).agg(F.count("*").alias("n"), F.sum("key").alias("keys"), F.round(F.sum("balance"), 2).alias("balance"))


UNLIKE_SOURCES = "SELECT FALSE AS unnamed, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS keys, CAST(NULL AS DOUBLE) AS balance FROM supplier UNION ALL SELECT TRUE, count(*), CAST(sum(c_custkey) AS BIGINT), round(sum(c_acctbal), 2) FROM customer"

_SPLIT = "CASE p_partkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END"


def _pairs_file(spark, d):
    path = io.scratch(spark, "pairs")
    rows = t(spark, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("pair_id"), F.expr(_SPLIT).alias("split"), F.col("p_brand").alias("kind"), F.col("p_type").alias("framing"), F.col("p_name").alias("text_pos"), F.concat(F.lit("no "), F.col("p_name")).alias("text_neg"))
    rows.write.json(path)
    return path


_PAIR = "pair_id string, split string, kind string, framing string, text_pos string, text_neg string"


def read_pairs(spark, d):
    """Checked pairs of two splits, the first 300 by id, as one branch's training rows."""
    got = banks.read_pairs(spark, f"{_pairs_file(spark, d)}/", _PAIR, {"texts_equal": F.col("text_pos") == F.col("text_neg")}, splits=("train", "dev"), most=300)
    return banks.export_rows(got, "neg", ["kind", "framing"])


READ_PAIRS = f"""
SELECT 'no ' || p_name AS text, p_brand || '/' || p_type AS source, p_brand AS domain, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS pair_id, 'neg' AS branch, {_SPLIT} AS split FROM part WHERE p_partkey % 5 <> 0 ORDER BY pair_id LIMIT 300
"""


def read_probes(spark, d):
    """Probes of two sources, two of each kind."""
    path = io.scratch(spark, "probes")
    rows = t(spark, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"), F.expr(_SPLIT).alias("split"), F.col("p_brand").alias("kind"), F.lower("p_type").alias("source"), F.col("p_name").alias("prefix"))
    rows.write.json(path)
    return banks.read_probes(spark, f"{path}/", "id string, split string, kind string, source string, prefix string", splits=("test", "dev"), sources=("economy", "large", "small"), per_kind=2)


READ_PROBES = f"""
SELECT id, split, kind, source, p_name AS prefix FROM (SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, {_SPLIT} AS split, p_brand AS kind, lower(p_type) AS source, p_name FROM part)
WHERE split IN ('test', 'dev') AND source IN ('economy', 'large', 'small') QUALIFY row_number() OVER (PARTITION BY kind ORDER BY id) <= 2
"""


def bank_problems(spark, d):
    """What is wrong with a catalog: bad sizes, blank names, names that repeat in any case."""
    rows = t(spark, d, "part").select(F.lower("p_name").alias("name"), "p_size", "p_brand")
    found = banks.problems_of(rows, "name", {"size": F.col("p_size") > 48, "brand": F.col("p_brand").isin("Brand#1", "Brand#2")})
    return found.groupBy("problem").agg(F.count("*").alias("n"))


BANK_PROBLEMS = """
SELECT 'size' AS problem, count(*) AS n FROM part WHERE p_size > 48 HAVING count(*) > 0 UNION ALL SELECT 'brand', count(*) FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') HAVING count(*) > 0
UNION ALL SELECT 'duplicate', count(*) FROM (SELECT lower(p_name) FROM part GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
"""


def score_rows(spark, d):
    """Line values as one array a document, written and read."""
    path = io.scratch(spark, "scores")
    rows = t(spark, d, "lineitem").withColumn("place", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    banks.write_scores(rows, path, "l_orderkey", "place", "l_quantity")
    return spark.read.parquet(path).select("l_orderkey", F.array_join(F.transform("values", lambda x: x.cast("int")), ",").alias("values"), F.round("mean", 6).alias("mean"), "n")


SCORE_ROWS = 'SELECT l_orderkey, string_agg(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), \',\' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS "values", round(avg(l_quantity), 6) AS mean, count(*) AS n FROM lineitem GROUP BY l_orderkey'


def token_stats(spark, d):
    out = banks.token_stats(t(spark, d, "documents").select("lang", "text"), F.size(F.split("text", " ")), ["lang"], 100)
    return out.select("lang", "texts", F.round("mean", 6).alias("mean"), "most", "tokens", "histogram")


TOKEN_STATS = """
WITH n AS (SELECT lang, len(string_split(text, ' ')) AS n FROM documents), b AS (SELECT lang, CAST(floor(n / 100) AS BIGINT) AS bin, count(*) AS c FROM n GROUP BY ALL)
SELECT n.lang, count(*) AS texts, round(avg(n), 6) AS mean, CAST(max(n) AS BIGINT) AS most, CAST(sum(n) AS BIGINT) AS tokens, any_value(h) AS histogram FROM n JOIN (SELECT lang, string_agg(bin || ':' || c, ',' ORDER BY bin) AS h FROM b GROUP BY lang) g USING (lang) GROUP BY n.lang
"""


def ascii_lines(spark, d):
    """Rows as JSON in ASCII: letters beyond it are escaped; read back they are as they were."""
    rows = t(spark, d, "conversations").select("conv_id", "turn", "text").withColumn("line", banks.ascii_json(["conv_id", "text"]))
    back = F.from_json("line", "conv_id long, text string")
    return rows.select("conv_id", "turn", (back["text"] == F.col("text")).alias("same"), F.col("line").rlike(r"[^\x00-\x7F]").alias("beyond"))


ASCII_LINES = "SELECT conv_id, turn, TRUE AS same, FALSE AS beyond FROM conversations"


# --- interfaces to models ------------------------------------------------------------------------------------------------


def _shout():
    def model(requests):
        if any("X" in r for r in requests):
            raise ValueError("no")
        return [r.upper() for r in requests]

    return model


def asked_models(spark, d):
    """Each brand asked once for all its parts; a request that fails, fails alone."""
    request = F.when(F.col("p_brand") == "Brand#13", "X").otherwise(F.col("p_brand"))
    out = external.ask_once(t(spark, d, "part").select("p_partkey", "p_brand"), request, _shout, batch=4)
    return out.select("p_partkey", "reply", "failed")


ASKED_MODELS = "SELECT p_partkey, CASE WHEN p_brand <> 'Brand#13' THEN upper(p_brand) END AS reply, p_brand = 'Brand#13' AS failed FROM part"


def control_samples(spark, d):
    """Samples of each nation, two of each against the nation half a table away."""
    n = t(spark, d, "nation").count()
    questions = t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("question"))
    rows = external.samples(t(spark, d, "nation").select("n_nationkey"), 4)
    return external.mismatched(rows, questions, "n_nationkey", n, 2).select("n_nationkey", "sample", "question")


CONTROL_SAMPLES = "SELECT a.n_nationkey, CAST(s AS INTEGER) AS sample, b.n_name AS question FROM nation a, range(2) r(s), nation b WHERE b.n_nationkey = (a.n_nationkey + (SELECT count(*) FROM nation) // 2) % (SELECT count(*) FROM nation)"


def work_left(spark, d):
    plan = t(spark, d, "supplier").select("s_suppkey")
    return external.remaining(plan, t(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey")), ["s_suppkey"], 650)


WORK_LEFT = "SELECT s_suppkey, 650 - coalesce(n, 0) AS to_do FROM supplier LEFT JOIN (SELECT l_suppkey AS s_suppkey, count(*) AS n FROM lineitem GROUP BY 1) USING (s_suppkey) WHERE 650 - coalesce(n, 0) > 0"


QUERIES = {
    f.__name__: f
    for f in (jsonl_rows, jsonl_broken, csv_table, text_tree, published_rows, unlike_sources, read_pairs, read_probes, bank_problems, score_rows, token_stats, ascii_lines, asked_models, control_samples, work_left)
}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
