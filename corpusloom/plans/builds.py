"""Queries that build cards from a catalog and report on documents' state. Parts and suppliers are the catalog, lineitem the attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import cards as K
from corpusloom.plans.corpus import t


def _csv(c):
    return F.array_join(c, ",")


_HEX = "(CAST('0x' || substr(sha256('{0}:' || {1}), 1, {2}) AS BIGINT) / power(16.0, {2}))"


def option_rules(spark, d):
    tier = F.when(F.col("p_retailprice") < 950, "everyday").when(F.col("p_retailprice") > 1100, "premium").otherwise("middle")
    sold = F.when(F.col("p_size") < 20, "supermarket").when(F.col("p_size") > 40, "specialty_only").otherwise("shops")
    named = F.contains("p_name", F.lit("red"))
    rows = t(spark, d, "part")
    return rows.select(
        "p_partkey", K.can_change("to_accessible", tier, sold, named).alias("to_accessible"), K.can_change("to_exclusive", tier, sold, named).alias("to_exclusive"), K.names_overlap(F.col("p_name"), F.lower(F.substring("p_type", 1, 3))).alias("overlap"),
        K.valid_range(F.col("p_size") - 10, F.lit(30)).alias("range"), K.counterfactual_ok(tier, F.lit("premium"), F.col("p_size") < 25).alias("counterfactual"),
    )


OPTION_RULES = """
WITH p AS (SELECT *, CASE WHEN p_retailprice < 950 THEN 'everyday' WHEN p_retailprice > 1100 THEN 'premium' ELSE 'middle' END AS tier, CASE WHEN p_size < 20 THEN 'supermarket' WHEN p_size > 40 THEN 'specialty_only' ELSE 'shops' END AS sold, contains(p_name, 'red') AS named FROM part)
SELECT p_partkey, NOT named AND (tier = 'premium' OR sold = 'specialty_only') AS to_accessible, NOT named AND tier = 'everyday' AND sold = 'supermarket' AS to_exclusive, contains(p_name, lower(substr(p_type, 1, 3))) OR contains(lower(substr(p_type, 1, 3)), p_name) AS overlap,
  p_size - 10 > 0 AND p_size - 10 <= 30 AS "range", tier = 'everyday' AND p_size < 25 AS counterfactual FROM p
"""


def brand_names(spark, d):
    parts = t(spark, d, "part").select(F.split("p_name", " ").alias("w"))
    return K.brand_names(parts.select(F.initcap(F.get("w", F.lit(0))).alias("first")), parts.select(F.get("w", F.lit(1)).alias("second")), ["Redring"])


BRAND_NAMES = """
WITH f AS (SELECT DISTINCT upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS first FROM part), s AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS second FROM part)
SELECT first, second, first || lower(second) AS name FROM f, s WHERE NOT (suffix(lower(first), substr(lower(second), 1, 1)) OR suffix(lower(first), substr(lower(second), 1, 2)) OR contains(lower(first), lower(second))) AND lower(first || second) <> 'redring'
"""


def option_uses(spark, d):
    """Uses that customers of neighbouring keys share, by the words of their segment and priority."""
    uses = F.array(F.col("c_mktsegment"), F.concat(F.lit("n"), F.col("c_nationkey") % 3), F.lit("any"))
    a = t(spark, d, "customer").select("c_custkey", uses.alias("a"), (F.col("c_nationkey") % 2).alias("fa"))
    b = a.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("a").alias("b"), F.col("fa").alias("fb"))
    return a.join(b, "c_custkey").select("c_custkey", _csv(K.shared_uses(F.col("a"), F.col("b"), F.col("fa") == F.col("fb"), ["any"])).alias("uses"))


OPTION_USES = """
WITH u AS (SELECT c_custkey, [c_mktsegment, 'n' || c_nationkey % 3, 'any'] AS u, c_nationkey % 2 AS f FROM customer)
SELECT a.c_custkey, array_to_string(list_filter(a.u, lambda x: list_contains(b.u, x) AND (a.f = b.f OR x <> 'any')), ',') AS uses FROM u a JOIN u b ON b.c_custkey = a.c_custkey + 1
"""


def exact_flags(spark, d):
    rows = K.flags(t(spark, d, "customer").select("c_custkey"), "c_custkey", 0.3, 42)
    return K.spread(rows, "c_custkey", {"full": 0.5, "names": 0.25, "none": 0.25}, 42)


EXACT_FLAGS = """
WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('42:flag:' || c_custkey)) - 1 AS f, row_number() OVER (ORDER BY sha256('42:level:' || c_custkey)) - 1 AS l, count(*) OVER () AS n FROM customer)
SELECT c_custkey, f < round_even(n * 0.3, 0) AS flag, CASE WHEN l < round_even(n * 0.5, 0) THEN 'full' WHEN l < round_even(n * 0.5, 0) + round_even(n * 0.25, 0) THEN 'names' ELSE 'none' END AS level FROM r
"""


def numbered_cards(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 2).alias("twin"))
    return K.numbered(rows, "c_custkey", "twin", 42)


NUMBERED_CARDS = """
WITH g AS (SELECT twin, row_number() OVER (ORDER BY sha256('42:unit:' || twin)) AS r FROM (SELECT DISTINCT CAST(floor(c_custkey / 2) AS BIGINT) AS twin FROM customer))
SELECT c_custkey, twin, 'c' || lpad(CAST(row_number() OVER (ORDER BY r, c_custkey) AS VARCHAR), 5, '0') AS card_id FROM customer JOIN g ON twin = floor(c_custkey / 2)
"""


def drawn_passages(spark, d):
    cards = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("kind"))
    passages = t(spark, d, "supplier").select(F.col("s_nationkey").alias("kind"), F.col("s_suppkey").alias("passage"), (-F.col("s_suppkey")).alias("line"))
    return K.drawn(cards, "c_custkey", "kind", passages, "passage", "line", 2, 42).select("c_custkey", _csv(F.col("passages").cast("array<string>")).alias("passages"))


DRAWN_PASSAGES = """
WITH r AS (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY sha256('42:passages:' || c_custkey || ':' || s_suppkey)) AS r FROM customer JOIN supplier ON s_nationkey = c_nationkey)
SELECT c_custkey, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey DESC) AS passages FROM r WHERE r <= 2 GROUP BY c_custkey
"""


def ordered_actions(spark, d):
    return t(spark, d, "customer").select("c_custkey", _csv(K.action_order(42, F.col("c_custkey"), F.lit("aligned"), F.lit("misaligned"))).alias("order"))


ORDERED_ACTIONS = f"""SELECT c_custkey, CASE WHEN {_HEX.format("42:order", "c_custkey", 12)} < 0.5 THEN 'misaligned,aligned' ELSE 'aligned,misaligned' END AS "order" FROM customer"""


def twin_prices(spark, d):
    """Twin cards with swapped prices within a ratio of 1.5 to 4 and at most 40."""
    rows = t(spark, d, "part").select("p_partkey", K.price_pair(42, F.col("p_partkey"), F.lit(2.0), F.col("p_size").cast("double"), (1.5, 4.0), 40.0).alias("p")).filter("p IS NOT NULL")
    return K.twin_cards(rows.select("p_partkey", "p.low", "p.high"), "low", "high").drop("low", "high")


def price_ratios(spark, d):
    rows = twin_prices(spark, d)
    ratio = F.col("price_b") / F.col("price_a")
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.count(F.when(ratio.between(1.5 - 1e-6, 4.0 + 1e-6) | (1 / ratio).between(1.5 - 1e-6, 4.0 + 1e-6), 1)).alias("in_ratio"), F.count(F.when(F.greatest("price_a", "price_b") <= 40, 1)).alias("in_range"))


PRICE_RATIOS = "SELECT CAST(variant AS INTEGER) AS variant, n, n AS in_ratio, n AS in_range FROM (SELECT count(*) AS n FROM part WHERE p_size >= 2), range(2) v(variant)"


def excluding_draws(spark, d):
    docs = t(spark, d, "documents")
    parts = K.excluding_draws([docs.filter(F.col("lang") == x).select("text") for x in ("en", "de")] + [docs.select("text")], "text", [30, 20, 40], 42)
    out = None
    for i, p in enumerate(parts):
        rows = p.select(F.lit(i).alias("corpus"), F.sha1("text").alias("sha"))
        out = rows if out is None else out.unionByName(rows)
    return out


EXCLUDING_DRAWS = """
WITH d AS (SELECT DISTINCT sha1(text) AS sha, lang FROM documents), a AS (SELECT sha FROM (SELECT DISTINCT sha FROM d WHERE lang = 'en') ORDER BY sha256('42:draw:' || sha) LIMIT 30),
b AS (SELECT sha FROM (SELECT DISTINCT sha FROM d WHERE lang = 'de' AND sha NOT IN (SELECT sha FROM a)) ORDER BY sha256('42:draw:' || sha) LIMIT 20),
c AS (SELECT sha FROM (SELECT DISTINCT sha FROM d WHERE sha NOT IN (SELECT sha FROM a UNION ALL SELECT sha FROM b)) ORDER BY sha256('42:draw:' || sha) LIMIT 40)
SELECT 0 AS corpus, sha FROM a UNION ALL SELECT 1, sha FROM b UNION ALL SELECT 2, sha FROM c
"""


def catalog_rows(spark, d):
    rows = t(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), "p_partkey")
    required = t(spark, d, "nation").select(F.col("n_name").alias("name")).unionByName(t(spark, d, "part").select(F.concat(F.lit(" "), F.initcap("p_name")).alias("name")).limit(5))
    return K.catalog(rows, required, "name", "p_partkey")


CATALOG_ROWS = """
SELECT CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, p_partkey, FALSE AS uncertain FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1 UNION ALL SELECT n_name, NULL, TRUE FROM nation
"""


def catalog_duplicates(spark, d):
    return K.duplicates(t(spark, d, "part"), "p_name")


CATALOG_DUPLICATES = "SELECT lower(trim(p_name)) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1"


def card_groups(spark, d):
    rows = t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("g"), F.concat(F.lit("s"), F.col("p_partkey") % 50 % 3).alias("split"), "p_brand", "p_name", "p_type", (F.col("p_size") > 48).alias("held"))
    out = K.group_rows(rows, "g", "split", "p_partkey", "p_brand", ["p_name", "p_type"], F.col("held"))
    return out.select("g", "split", "kind", _csv(F.col("cards").cast("array<string>")).alias("cards"), _csv("options").alias("options"), "holdout")


CARD_GROUPS = """
SELECT p_partkey % 50 AS g, 's' || p_partkey % 50 % 3 AS split, arg_min(p_brand, p_partkey) AS kind, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS cards,
  array_to_string(list_sort(list_distinct(list_concat(list(p_name), list(p_type)))), ',') AS options, bool_or(p_size > 48) AS holdout FROM part GROUP BY ALL
"""


def reused_units(spark, d):
    units = t(spark, d, "part").select("p_partkey", F.floor(F.col("p_partkey") / 2).alias("unit"), (F.col("p_partkey") % 7 == 0).alias("reserve"))
    return K.reused(units, "unit", "p_partkey", "reserve", t(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).filter("p_partkey % 3 <> 0"))


REUSED_UNITS = """
WITH u AS (SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS unit, count(*) AS cards, bool_and(p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 3 <> 0)) AS ok, bool_or(p_partkey % 7 = 0) AS r FROM part GROUP BY 1)
SELECT unit, cards, NOT ok AS reserve, CASE WHEN ok THEN 0 WHEN r THEN 1 ELSE 2 END AS turn FROM u
"""


def _attempts(spark, d):
    side = F.when(F.col("l_suppkey") % 2 == 0, "pos").otherwise("neg")
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("card"), side.alias("branch"), F.col("l_returnflag").alias("kind"), (F.col("l_linenumber") % 3).alias("attempt"), (F.col("l_linestatus") == "F").alias("passed"), F.array(F.concat("l_returnflag", F.lit(": x")), F.col("l_linestatus")).alias("reasons"))


_ATTEMPTS = "(SELECT l_orderkey AS card, CASE WHEN l_suppkey % 2 = 0 THEN 'pos' ELSE 'neg' END AS branch, l_returnflag AS kind, CAST(l_linenumber % 3 AS INTEGER) AS attempt, l_linestatus = 'F' AS passed, l_linestatus FROM lineitem)"
_SIDES = f"(SELECT card, branch, max(attempt) AS last, count(*) AS attempts, CASE WHEN bool_or(passed) THEN 'passed' WHEN max(attempt) + 1 >= 3 THEN 'failed' ELSE 'open' END AS state FROM {_ATTEMPTS} GROUP BY card, branch)"


def side_states(spark, d):
    return K.side_states(_attempts(spark, d), ["card", "branch"], "attempt", "passed", 3)


SIDE_STATES = f"SELECT * FROM {_SIDES}"


def card_states(spark, d):
    return K.card_states(side_states(spark, d), "card").groupBy("state").agg(F.count("*").alias("cards"))


CARD_STATES = f"SELECT state, count(*) AS cards FROM (SELECT card, CASE WHEN bool_or(state = 'failed') THEN 'failed' WHEN count(*) FILTER (state = 'passed') >= 2 THEN 'accepted' ELSE 'open' END AS state FROM {_SIDES} GROUP BY card) GROUP BY state"


def writer_rates(spark, d):
    return K.pass_rates(_attempts(spark, d), ["kind", "branch"], "attempt", "passed", side_states(spark, d), ["card", "branch"])


WRITER_RATES = f"""
WITH f AS (SELECT kind, branch, count(*) FILTER (passed) AS first_passed, count(*) AS first_tries FROM {_ATTEMPTS} WHERE attempt = 0 GROUP BY ALL),
g AS (SELECT kind, branch, count(*) FILTER (state = 'passed') AS final_passed, count(*) AS final_done FROM (SELECT DISTINCT kind, card, branch FROM {_ATTEMPTS}) JOIN {_SIDES} USING (card, branch) WHERE state <> 'open' GROUP BY ALL)
SELECT kind, branch, first_passed, first_tries, coalesce(final_passed, 0) AS final_passed, coalesce(final_done, 0) AS final_done FROM f LEFT JOIN g USING (kind, branch)
"""


def reason_counts(spark, d):
    return K.reason_counts(_attempts(spark, d), ["branch"], "reasons")


REASON_COUNTS = f"SELECT branch, code, count(*) AS n FROM (SELECT branch, unnest([kind, l_linestatus]) AS code FROM {_ATTEMPTS}) GROUP BY ALL"


def reserve_use(spark, d):
    units = t(spark, d, "part").select("p_brand", (F.col("p_size") < 40).alias("active"), (F.col("p_size") % 4 == 0).alias("reserve"), (F.col("p_size") % 3 == 0).alias("failed"))
    return K.reserve_use(units, "p_brand", "active", "reserve", "failed")


RESERVE_USE = """
SELECT p_brand, count(*) FILTER (p_size < 40 AND p_size % 4 = 0) AS used, count(*) FILTER (p_size % 4 = 0) AS available, greatest(count(*) FILTER (p_size < 40 AND p_size % 3 = 0) - count(*) FILTER (p_size < 40 AND p_size % 4 = 0), 0) AS short FROM part GROUP BY p_brand
"""


def document_stats(spark, d):
    words = F.size(F.split("text", " "))
    return K.document_stats(t(spark, d, "documents").filter("lang IS NOT NULL"), ["lang"], words, F.regexp_count("text", F.lit("the")), F.when(F.col("doc_id") % 5 == 0, F.least(words, F.lit(20))).otherwise(0), F.when(F.col("doc_id") % 5 == 0, F.least(words, F.lit(20))).otherwise(0))


DOCUMENT_STATS = """
WITH x AS (SELECT lang, len(string_split(text, ' ')) AS w, len(regexp_extract_all(text, 'the')) AS v, CASE WHEN doc_id % 5 = 0 THEN least(len(string_split(text, ' ')), 20) ELSE 0 END AS c FROM documents WHERE lang IS NOT NULL)
SELECT lang, count(*) AS documents, CAST(round(avg(w)) AS BIGINT) AS mean_words, round(sum(v) * 1000 / sum(w), 2) AS values_per_1000, round(sum(c) / sum(w), 4) AS copied_share, round(avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END), 3) AS copying, CAST(max(c) AS INTEGER) AS longest FROM x GROUP BY lang
"""


def document_audits(spark, d):
    chosen = F.when(F.col("p_size") % 5 == 0, "none").when(F.col("p_size") % 5 == 1, F.col("p_type")).otherwise(F.col("p_name"))
    reason = F.when(F.col("p_size") % 2 == 0, F.lit("Price (low) ")).otherwise(F.lit(" (x"))
    problems = K.audit_problems({"fact_errors": F.col("p_size") > 45}, chosen, F.col("p_name"), reason, F.lit("price"))
    return t(spark, d, "part").select("p_partkey", _csv(problems).alias("problems"))


DOCUMENT_AUDITS = """
SELECT p_partkey, array_to_string(list_filter([CASE p_size % 5 WHEN 0 THEN 'chosen: none' WHEN 1 THEN 'chosen: other' END, CASE WHEN p_size % 2 <> 0 THEN 'reason: none' END, CASE WHEN p_size > 45 THEN 'fact_errors' END], lambda x: x IS NOT NULL), ',') AS problems FROM part
"""


def label_fit(spark, d):
    labels = t(spark, d, "labels").select("doc_id", "quality")
    return K.label_fit(labels, t(spark, d, "labels").filter("doc_id % 4 <> 0").select("doc_id", F.col("toxic").alias("quality")), "doc_id", "quality")


LABEL_FIT = 'SELECT quality AS want, count(*) AS items, count(*) FILTER (doc_id % 4 <> 0 AND quality = toxic) AS "right", count(*) FILTER (doc_id % 4 = 0 OR toxic IS NULL) AS missing FROM labels GROUP BY quality'


def facts_view(spark, d):
    facts = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    stated = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("size"), F.lit("brand"))).otherwise(F.array().cast("array<string>"))
    return t(spark, d, "part").select("p_partkey", _csv(F.array_sort(F.map_values(K.facts_view(facts, stated, True)))).alias("opening"), F.size(K.facts_view(facts, stated, False)).alias("all_facts"))


FACTS_VIEW = "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN array_to_string(list_sort([p_brand, CAST(p_size AS VARCHAR)]), ',') ELSE '' END AS opening, 3 AS all_facts FROM part"


def pool_choice(spark, d):
    """Which of a nation's pools of suppliers comes first: rich ones, then any with money, then all."""
    rows = t(spark, d, "supplier").groupBy("s_nationkey").agg(*[F.count(F.when(F.col("s_acctbal") > x, 1)).alias(n) for n, x in (("rich", 9000), ("some", 5000), ("all", -10_000))])
    return rows.select("s_nationkey", K.first_pool([F.col("rich"), F.col("some"), F.col("all")]).alias("pool"))


POOL_CHOICE = "SELECT s_nationkey, CASE WHEN max(s_acctbal) > 9000 THEN 0 WHEN max(s_acctbal) > 5000 THEN 1 ELSE 2 END AS pool FROM supplier GROUP BY s_nationkey"


QUERIES = {
    f.__name__: f
    for f in (
        option_rules, brand_names, option_uses, exact_flags, numbered_cards, drawn_passages, ordered_actions, twin_prices, price_ratios, excluding_draws, catalog_rows, catalog_duplicates, card_groups, reused_units,
        side_states, card_states, writer_rates, reason_counts, reserve_use, document_stats, document_audits, label_fit, facts_view, pool_choice,
    )
}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
