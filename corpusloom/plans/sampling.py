"""Queries for draws, splits, budgets and question synthesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import annotate, chat, sample
from corpusloom.plans.corpus import t

SEED = 42


def hash_split(spark, d):
    rows = t(spark, d, "documents").select("doc_id", X.hash_share(12, SEED, "split", F.col("doc_id")).alias("u"))
    return rows.select("doc_id", F.when(F.col("u") < 0.1, "test").when(F.col("u") < 0.2, "dev").otherwise("train").alias("split"))


_SHARE = "CAST(('0x' || substr(sha256('42:split:' || doc_id), 1, 12)) AS BIGINT) / 281474976710656.0"
HASH_SPLIT = f"SELECT doc_id, CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.2 THEN 'dev' ELSE 'train' END AS split FROM (SELECT doc_id, {_SHARE} AS u FROM documents)"


def group_split(spark, d):
    return sample.group_split(t(spark, d, "orders"), "o_custkey", "o_orderpriority", SEED, 0.05, 0.1)


def _split_sql(least, held="false", where=""):
    n = lambda s: f"greatest(round_even(n * {s}, 0), {least})"
    return f"""
WITH g AS (SELECT o_orderpriority, o_custkey, count(*) AS n_rows, {held} AS held FROM orders {where} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, held ORDER BY sha256('42:split:' || o_custkey), o_custkey) AS r, count(*) OVER (PARTITION BY o_orderpriority, held) AS n FROM g)
SELECT o_orderpriority, o_custkey, n_rows, CASE WHEN held OR r <= {n(0.05)} THEN 'test' WHEN r <= {n(0.05)} + {n(0.1)} THEN 'dev' ELSE 'train' END AS split FROM r
"""


GROUP_SPLIT = _split_sql(1)


def holdout_split(spark, d):
    return sample.group_split(t(spark, d, "orders"), "o_custkey", "o_orderpriority", SEED, 0.05, 0.1, False, holdout=F.col("o_totalprice") > 490000)


HOLDOUT_SPLIT = _split_sql(0).replace("false AS held FROM orders  GROUP BY ALL", "bool_or(o_totalprice > 490000) AS held FROM orders GROUP BY o_orderpriority, o_custkey")


def kept_split(spark, d):
    orders = t(spark, d, "orders")
    keep = orders.select("o_custkey").distinct().filter("o_custkey % 7 = 0").withColumn("split", F.lit("test"))
    return sample.group_split(orders, "o_custkey", "o_orderpriority", SEED, 0.05, 0.1, keep=keep)


KEPT_SPLIT = "SELECT o_orderpriority, o_custkey, count(*) AS n_rows, CASE WHEN o_custkey % 7 = 0 THEN 'test' ELSE 'train' END AS split FROM orders GROUP BY ALL"


def hash_order(spark, d):
    rows = t(spark, d, "documents").select("doc_id")
    return sample.global_rank(rows, X.digest(SEED, F.col("doc_id")))


HASH_ORDER = "SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id)) - 1 AS rank FROM documents"


def stratified_quota(spark, d):
    quota = F.when(F.col("lang") == "en", 40).otherwise(15)
    return sample.stratified(t(spark, d, "documents").select("doc_id", "lang"), "lang", X.digest(SEED, F.col("doc_id")), quota)


STRATIFIED_QUOTA = "SELECT doc_id, lang, CAST(r AS INTEGER) AS rank_in FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id)) AS r FROM documents) WHERE r <= CASE WHEN lang = 'en' THEN 40 ELSE 15 END"


def hamilton(spark, d):
    sizes = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return sample.hamilton(sizes, "source", "n", 333)


HAMILTON = """
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), x AS (SELECT source, n, n * 333 / sum(n) OVER () AS x FROM s),
r AS (SELECT source, n, CAST(floor(x) AS BIGINT) AS f, row_number() OVER (ORDER BY floor(x) - x, source) AS r FROM x)
SELECT source, n, f + CASE WHEN r <= 333 - (SELECT sum(f) FROM r) THEN 1 ELSE 0 END AS share FROM r
"""


def stratified_order(spark, d):
    rows = sample.interleave(t(spark, d, "documents").select("doc_id", "lang"), "lang", X.digest(SEED, F.col("doc_id")), 5)
    return rows.select("doc_id", "lang", "held_out", F.round("place", 9).alias("place"))


STRATIFIED_ORDER = """
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id)) - 1 AS r, count(*) OVER (PARTITION BY lang) - 5 AS cut FROM documents)
SELECT doc_id, lang, r >= cut AS held_out, CASE WHEN r < cut THEN round((r + 0.5) / cut, 9) END AS place FROM r
"""


def token_budget(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "source", "n_chars", X.digest(SEED, F.col("doc_id")).alias("o"))
    return sample.token_budget(rows, "n_chars", "o", 20000, ["source"]).select("doc_id", "source", "tokens_before")


TOKEN_BUDGET = """
SELECT doc_id, source, CAST(b AS BIGINT) AS tokens_before FROM (
  SELECT doc_id, source, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 20000
"""


def oversample(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    return sample.oversample(rows, "c_nationkey", X.digest(SEED, F.col("c_custkey")), 70).select("c_custkey", "c_nationkey", "copy")


OVERSAMPLE = """
WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('42:' || c_custkey)) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_custkey, c_nationkey, unnest(range(0, CAST(floor((70 - r) / n) AS BIGINT) + 1)) AS copy FROM r WHERE r <= 70
"""


def stride_shard(spark, d):
    rows = sample.stride(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 3, 8)
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


STRIDE_SHARD = "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 8 = 3"


def shard_bounds(spark, d):
    parts = t(spark, d, "part")
    cuts = sample.shard_bounds(parts.count(), 7)
    shard = F.coalesce(*[F.when((F.col("p_partkey") >= a) & (F.col("p_partkey") < b), i) for i, (a, b) in enumerate(cuts)])
    return parts.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


SHARD_BOUNDS = """
WITH n AS (SELECT count(*) AS n FROM part), b AS (SELECT k, CAST(round_even(k * n / 7, 0) AS BIGINT) AS a, CAST(round_even((k + 1) * n / 7, 0) AS BIGINT) AS e FROM n, range(7) r(k))
SELECT CAST(k AS INTEGER) AS shard, count(*) AS n, min(p_partkey) AS first FROM part JOIN b ON p_partkey >= a AND p_partkey < e GROUP BY k
"""


def round_robin(spark, d):
    return sample.round_robin(t(spark, d, "part").select("p_partkey", "p_type", "p_brand"), "p_type", "p_brand", X.digest(SEED, F.col("p_partkey"))).select("p_partkey", "position")


ROUND_ROBIN = """
WITH r AS (SELECT p_partkey, p_type, p_brand, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY sha256('42:' || p_partkey)) AS r, count(*) OVER (PARTITION BY p_type, p_brand) AS n FROM part)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_type ORDER BY r, n DESC, p_brand) AS INTEGER) AS position FROM r
"""


def family_holdouts(spark, d):
    return sample.family_holdouts(t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "s_suppkey", 0.15, SEED).select("s_suppkey", "in_family")


FAMILY_HOLDOUTS = """
WITH r AS (SELECT s_suppkey, sha256('42:holdout:' || s_suppkey) AS o, row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256('42:holdout:' || s_suppkey), s_suppkey) AS f FROM supplier)
SELECT s_suppkey, CAST(f AS INTEGER) AS in_family FROM r QUALIFY row_number() OVER (ORDER BY f, o, s_suppkey) <= round_even((SELECT count(*) FROM supplier) * 0.15, 0)
"""


def unique_names(spark, d):
    return sample.unique_names(t(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_name", "p_partkey", ["p_brand"]).select("p_partkey", "unique_name")


UNIQUE_NAMES = "SELECT p_partkey, CASE WHEN r = 1 THEN p_name ELSE p_name || '_' || r END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS r FROM part)"


def nested_top(spark, d):
    return sample.nested_top(t(spark, d, "part").select("p_partkey", "p_type", "p_brand"), [(["p_type"], "p_brand", 3), (["p_type", "p_brand"], "p_partkey", 4)])


NESTED_TOP = """
WITH a AS (SELECT p_partkey, p_type, p_brand FROM part QUALIFY dense_rank() OVER (PARTITION BY p_type ORDER BY p_brand) <= 3)
SELECT * FROM a QUALIFY dense_rank() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) <= 4
"""


def conflict_assignment(spark, d):
    return sample.conflict_assignment(t(spark, d, "customer").select("c_custkey"), "c_custkey", 0.3, SEED)


CONFLICT_ASSIGNMENT = "SELECT c_custkey, row_number() OVER (ORDER BY sha256('42:conflict:' || c_custkey)) - 1 < floor((SELECT count(*) FROM customer) * 0.3) AS is_conflict FROM customer"


def pool_pairing(spark, d):
    pool = t(spark, d, "supplier").select("s_suppkey", "s_name")
    return sample.pool_pairing(t(spark, d, "part").select("p_partkey"), pool, "p_partkey", "s_suppkey", SEED).select("p_partkey", "s_suppkey")


POOL_PAIRING = """
WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY sha256('42:pool:' || s_suppkey)) - 1 AS i FROM supplier)
SELECT p_partkey, s_suppkey FROM part JOIN p ON p_partkey % (SELECT count(*) FROM supplier) = i
"""


def reserve_fixpoint(spark, d):
    units = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "P").alias("failed"), (F.col("o_orderkey") % 4 == 3).alias("reserve"))
    return sample.reserve_fixpoint(units, "o_orderpriority", "o_orderkey", "failed", "reserve").groupBy("o_orderpriority", "reserve").agg(F.count_if("active").alias("active"), F.count("*").alias("n"))


RESERVE_FIXPOINT = """
WITH u AS (SELECT o_orderkey, o_orderpriority, o_orderstatus = 'P' AS failed, o_orderkey % 4 = 3 AS reserve FROM orders),
m AS (SELECT o_orderpriority, count(*) FILTER (failed AND NOT reserve) AS need FROM u GROUP BY 1),
r AS (SELECT u.*, coalesce(sum(CASE WHEN NOT failed THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM u WHERE reserve)
SELECT o_orderpriority, true AS reserve, count(*) FILTER (passed < need) AS active, count(*) AS n FROM r JOIN m USING (o_orderpriority) GROUP BY 1
UNION ALL SELECT o_orderpriority, false, count(*), count(*) FROM u WHERE NOT reserve GROUP BY 1
"""


def stable_hash(spark, d):
    return t(spark, d, "part").select("p_partkey", X.stable_int(F.col("p_name")).alias("h"))


STABLE_HASH = "SELECT p_partkey, CAST(('0x' || substr(sha1(p_name), 1, 8)) AS BIGINT) AS h FROM part"


def _items(spark, d):
    return t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_regionkey").cast("string").alias("topic"), F.col("n_name").alias("preference"), F.concat(F.lit("not "), "n_name").alias("opposite"))


def cross_fill(spark, d):
    q = t(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("q_id"), F.concat(F.lit("In "), "r_name", F.lit(": <A> or <B>?")).alias("q_t"))
    a = t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("a_id"), F.when(F.col("s_suppkey") % 2 == 0, "<A>, not <B>").otherwise("I take <A>").alias("a_t"))
    return chat.cross_fill(_items(spark, d), q, a)


CROSS_FILL = """
WITH f AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(n_regionkey AS VARCHAR) AS topic, n_name AS preference, 'not ' || n_name AS opposite, CAST(r_regionkey AS VARCHAR) AS q_id, CAST(s_suppkey AS VARCHAR) AS a_id,
         'In ' || r_name || ': ' || n_name || ' or not ' || n_name || '?' AS q_t, CASE WHEN s_suppkey % 2 = 0 THEN n_name || ', not not ' || n_name ELSE 'I take ' || n_name END AS a_t,
         CASE WHEN s_suppkey % 2 = 0 THEN 'not ' || n_name || ', not ' || n_name ELSE 'I take not ' || n_name END AS a_t_reversed
  FROM nation, region, supplier)
SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY topic, q_t, a_t ORDER BY id, q_id, a_id) = 1
"""


def preference_pairs(spark, d):
    prefs = _items(spark, d).select("id", "topic", F.col("preference").alias("pref"), F.col("opposite").alias("opp"))
    return annotate.preference_pairs(prefs)


PREFERENCE_PAIRS = """
SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(n_regionkey AS VARCHAR) AS topic, n_name AS chosen, 'not ' || n_name AS rejected FROM nation
UNION ALL SELECT CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR), 'not ' || n_name, n_name FROM nation
"""


def complete_pairs(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), "l_suppkey", "l_extendedprice")
    rows = rows.groupBy("l_orderkey", "l_returnflag", "n").agg(F.max("part").alias("part"))
    return chat.complete_pairs(rows, "l_orderkey", "l_returnflag", "part", ("A", "R"), "n")


COMPLETE_PAIRS = """
WITH r AS (SELECT l_orderkey, l_returnflag, l_linenumber AS n, max(l_partkey) AS part FROM lineitem GROUP BY ALL),
l AS (SELECT l_orderkey, l_returnflag, arg_max(part, n) AS part FROM r GROUP BY ALL)
SELECT a.l_orderkey, a.part AS "A", b.part AS "R" FROM l a JOIN l b USING (l_orderkey) WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R'
"""

QUERIES = {
    f.__name__: f
    for f in (
        hash_split, group_split, holdout_split, kept_split, hash_order, stratified_quota, hamilton, stratified_order, token_budget, oversample, stride_shard, shard_bounds, round_robin, family_holdouts, unique_names,
        nested_top, conflict_assignment, pool_pairing, reserve_fixpoint, stable_hash, cross_fill, preference_pairs, complete_pairs,
    )
}
SQL = {name: globals()[name.upper()] for name in QUERIES}
