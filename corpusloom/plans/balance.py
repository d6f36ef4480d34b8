"""Queries for balanced choices and deals."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import balance
from corpusloom.plans.corpus import t

SEED = 42


def balanced_pairs(spark, d):
    """Of three pairs that each part allows, the one whose members its maker has shown least; earlier uses of the pair count three times."""
    parts = t(spark, d, "part").select("p_type", "p_partkey", "p_size")
    a, b = (lambda j: F.concat(F.lit("a"), (F.col("p_size") + j) % 6)), (lambda j: F.concat(F.lit("b"), (F.col("p_partkey") * (j + 1)) % 5))
    options = F.array(*[balance.pair_option(a(j), b(j), extra=F.when(F.col("p_size") % 2 == 0, 0.5 * j).otherwise(0.0)) for j in range(3)])
    return balance.pick_least(parts.withColumn("options", options), ["p_type"], ["p_partkey"], "options", SEED)[0].select("p_type", "p_partkey", "at", "picked", "cost")


#: The rule one request at a time: the state is the list of all keys used so far.
BALANCED_PAIRS = """
WITH RECURSIVE asks AS (
  SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS i,
    list_transform([0, 1, 2], lambda j: {'a': 'a' || ((p_size + j) % 6), 'b': 'b' || ((p_partkey * (j + 1)) % 5), 'extra': CASE WHEN p_size % 2 = 0 THEN 0.5 * j ELSE 0 END}) AS options
  FROM part
), f AS (
  SELECT DISTINCT p_type, CAST(NULL AS BIGINT) AS p_partkey, CAST(-1 AS BIGINT) AS i, []::VARCHAR[] AS used, '' AS picked, CAST(0 AS DOUBLE) AS cost FROM part
  UNION ALL
  SELECT p_type, p_partkey, i, used || ['1:' || best.a, '1:' || best.b, '2:' || best.name], best.name, best.cost FROM (
    SELECT f.p_type, asks.p_partkey, asks.i, used, list_min(list_transform(options, lambda o: {
      'cost': CAST(o.extra + len(list_filter(used, lambda k: k = '1:' || o.a)) + len(list_filter(used, lambda k: k = '1:' || o.b)) + 3 * len(list_filter(used, lambda k: k = '2:' || o.a || '|' || o.b)) AS DOUBLE),
      'digest': sha256('42:pick:' || asks.i || ':' || o.a || '|' || o.b), 'name': o.a || '|' || o.b, 'a': o.a, 'b': o.b})) AS best
    FROM f JOIN asks ON f.p_type = asks.p_type AND asks.i = f.i + 1)
)
SELECT p_type, p_partkey, i AS "at", picked, cost FROM f WHERE i >= 0
"""


def least_used_suppliers(spark, d):
    """Each customer in turn takes the supplier of its nation that was taken least."""
    asks = t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    have = t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    return balance.least_used(asks, have, ["nation"], ["c_custkey"], "s_suppkey", SEED).select("nation", "c_custkey", "at", "lap", "picked")


LEAST_USED_SUPPLIERS = """
WITH RECURSIVE asks AS (
  SELECT c_nationkey AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, have FROM customer
  JOIN (SELECT s_nationkey, list(DISTINCT s_suppkey) AS have FROM supplier GROUP BY s_nationkey) ON c_nationkey = s_nationkey
), f AS (
  SELECT DISTINCT nation, CAST(NULL AS BIGINT) AS c_custkey, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS lap, CAST(NULL AS BIGINT) AS picked, []::BIGINT[] AS used FROM asks
  UNION ALL
  SELECT nation, c_custkey, i, CAST(best.n AS BIGINT), best.s, used || [best.s] FROM (
    SELECT f.nation, asks.c_custkey, asks.i, used, list_min(list_transform(have, lambda s: {'n': len(list_filter(used, lambda u: u = s)), 'digest': sha256('42:lap:' || len(list_filter(used, lambda u: u = s)) || ':' || s), 's': s})) AS best
    FROM f JOIN asks ON f.nation = asks.nation AND asks.i = f.i + 1)
)
SELECT nation, c_custkey, i AS "at", lap, picked FROM f WHERE i >= 0
"""
MIX = {"ECONOMY": 3, "PROMO": 2, "SMALL": 0}
KINDS = ["first", "second", "third"]


def dealt_calls(spark, d):
    """Three kinds of calls, as many of each as a tenth of the parts, five parts a call: repeats in a call, and how evenly each maker's parts are used."""
    parts = t(spark, d, "part").select("p_type", "p_partkey")
    dealt, _ = balance.deal_calls(parts, "p_type", "p_partkey", KINDS, max(1, parts.count() // 10), MIX, SEED)
    calls = dealt.groupBy("tier", "kind", "call").agg(F.count("*").alias("n"), F.countDistinct("key").alias("different"))
    calls = calls.groupBy("tier").agg(F.count("*").alias("calls"), F.sum("n").alias("seats"), F.sum(F.col("n") - F.col("different")).alias("repeats"))
    uses = parts.filter(F.col("p_type").isin([k for k, n in MIX.items() if n])).join(dealt.groupBy(F.col("key").alias("p_partkey")).agg(F.count("*").alias("n")), "p_partkey", "left")
    uses = uses.groupBy(F.col("p_type").alias("tier")).agg(F.min(F.coalesce("n", F.lit(0))).alias("fewest"), F.max(F.coalesce("n", F.lit(0))).alias("most"))
    return calls.join(uses, "tier")


DEALT_CALLS = """
WITH c AS (SELECT greatest(1, count(*) // 10) AS calls FROM part), p AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type), m(tier, each) AS (VALUES ('ECONOMY', 3), ('PROMO', 2)),
s AS (SELECT tier, 3 * calls AS calls, CAST(3 * calls * each AS BIGINT) AS seats, n FROM m JOIN p ON tier = p_type, c)
SELECT tier, calls, seats, CAST(0 AS BIGINT) AS repeats, seats // n AS fewest, (seats + n - 1) // n AS most FROM s
"""

QUERIES = {"balanced_pairs": balanced_pairs, "least_used_suppliers": least_used_suppliers, "dealt_calls": dealt_calls}
SQL = {"balanced_pairs": BALANCED_PAIRS, "least_used_suppliers": LEAST_USED_SUPPLIERS, "dealt_calls": DEALT_CALLS}
