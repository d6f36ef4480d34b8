"""Queries for documents written in rounds: rules over the documents' own sentences stand in for the writer and the auditor."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import writer as W
from corpusloom.plans.corpus import t
from corpusloom.sources.io import scratch, written
from corpusloom.streaming.rounds import Rounds, Stage

MOST = 2
#: In the logs to be replayed.
TRIES = 3
_OPENING = "card_id long, card_sha string, prompt_sha string, attempt int, prefix string, passed boolean"
_BRANCH = "card_id long, card_sha string, prompt_sha string, opening int, opening_sha string, branch string, attempt int, text string"
_CHECK = "card_id long, card_sha string, opening int, branch string, attempt int, branch_sha string, passed boolean"


#: A card's sentences that a try of an opening or of a branch can take: the last is that of the last try of the second branch.
SENTENCES = 3 + 2 * MOST


def _sentence(i):
    return F.coalesce(F.get("card", i), F.lit(""))


def _words(c):
    return F.regexp_count(c, F.lit(r"[^ \n]+"))


def _cards(spark, d):
    """A card is what the rules look at of a document: its first sentences. Rounds join cards again and again, so whole texts would move each time."""
    card = F.slice(F.split("text", r"[.!?]\s*", -1), 1, SENTENCES)
    return t(spark, d, "documents").select(F.col("doc_id").alias("card_id"), F.col("doc_id").alias("position"), W.content_sha(F.col("text")).alias("card_sha"), card.alias("card"))


def _stages(cards):
    def held(tables):
        return W.replayed(cards, tables["openings"].drop("prompt_sha"), tables["branches"].drop("prompt_sha"), tables["checks"])

    def sides(tables):
        o, b, c = held(tables)
        return o, b, W.sides(cards, o, b, c, MOST)

    def due_branches(tables):
        o, _, s = sides(tables)
        return W.branches_due(cards, o, s)

    def due_checks(tables):
        _, b, s = sides(tables)
        return W.checks_due(cards, s, b)

    other = F.when(F.col("branch") == "neg", 1).otherwise(0)
    return [
        Stage("openings", _OPENING, lambda tables: W.openings_due(cards, held(tables)[0], MOST), lambda due: due.withColumns({"prompt_sha": F.lit("p"), "prefix": _sentence(F.col("attempt"))}).withColumn("passed", _words(F.col("prefix")) >= 8)),
        Stage("branches", _BRANCH, due_branches, lambda due: due.withColumns({"prompt_sha": F.lit("q"), "opening_sha": W.content_sha(F.col("prefix")), "text": F.concat_ws(" ", "prefix", _sentence(3 + 2 * F.col("attempt") + other))})),
        Stage("checks", _CHECK, due_checks, lambda due: due.withColumns({"branch_sha": W.content_sha(F.col("text")), "passed": _words(F.col("text")) >= 15})),
    ]


def _written(spark, d):
    """The accepted pairs after rounds over all documents."""
    cards = written(_cards(spark, d), "cards")
    job = Rounds(spark, scratch(spark, "rounds"), _stages(cards))
    job.run()
    logs = job.tables()
    o, b, c = W.replayed(cards, logs["openings"], logs["branches"], logs["checks"])
    return W.pair_rows(cards, o, b, W.sides(cards, o, b, c, MOST))


def document_rounds(spark, d):
    return _written(spark, d).select("pair_id", F.md5("text_pos").alias("pos"), F.md5("text_neg").alias("neg"), "continuation_start_char", "attempts.opening", F.col("attempts.pos").alias("pos_attempt"), F.col("attempts.neg").alias("neg_attempt"))


_N = r"len(regexp_extract_all({0}, '[^ \n]+'))"
_SENTENCES = r"(SELECT doc_id, string_split_regex(text, '[.!?]\s*') AS s FROM documents)"


def _branch(k):
    text = lambda a: f"s[opening + 1] || ' ' || coalesce(s[{4 + 2 * a + k}], '')"
    tries = ", ".join(f"CASE WHEN {_N.format(text(a))} >= 15 THEN {{'a': {a}, 'text': {text(a)}}} END" for a in range(MOST))
    return f"coalesce({tries})"


_PAIRS = f"""
o AS (SELECT *, CASE {" ".join(f"WHEN {_N.format(f's[{a + 1}]')} >= 8 THEN {a}" for a in range(MOST))} END AS opening FROM {_SENTENCES}),
b AS (SELECT doc_id, s, opening, {_branch(0)} AS pos, {_branch(1)} AS neg FROM o WHERE opening IS NOT NULL),
p AS (SELECT * FROM b WHERE pos IS NOT NULL AND neg IS NOT NULL)"""
DOCUMENT_ROUNDS = f"""
WITH {_PAIRS} SELECT doc_id AS pair_id, md5(pos.text) AS pos, md5(neg.text) AS neg, CAST(length(s[opening + 1]) AS INTEGER) AS continuation_start_char, CAST(opening AS INTEGER) AS opening,
  CAST(pos.a AS INTEGER) AS pos_attempt, CAST(neg.a AS INTEGER) AS neg_attempt FROM p
"""


def pair_page(spark, d):
    """Twelve pairs of all that the documents' sentences give, as a page to read."""
    opening = F.coalesce(*[F.when(_words(_sentence(F.lit(a))) >= 8, _sentence(F.lit(a))) for a in range(MOST)])
    said = lambda k: F.coalesce(*[F.when(_words(x) >= 15, x) for x in (F.concat_ws(" ", "opening", _sentence(F.lit(3 + 2 * a + k))) for a in range(MOST))])
    rows = _cards(spark, d).withColumn("opening", opening).filter("opening IS NOT NULL").withColumns({"text_pos": said(0), "text_neg": said(1)}).filter("text_pos IS NOT NULL AND text_neg IS NOT NULL")
    return W.sample_markdown(rows.select("position", F.col("card_id").alias("pair_id"), "text_pos", "text_neg", F.length("opening").alias("continuation_start_char")), 12, 42, "rules")


PAIR_PAGE = f"""
WITH {_PAIRS}, c AS (SELECT * FROM p ORDER BY sha256('42:sample:' || doc_id), doc_id LIMIT 12)
SELECT CAST(-1 AS BIGINT) AS position, '# ' || (SELECT count(*) FROM c) || ' of ' || (SELECT count(*) FROM p) || ' accepted pairs (rules)' || chr(10) AS markdown
UNION ALL
SELECT doc_id, '## ' || doc_id || chr(10) || chr(10) || '**Opening**' || chr(10) || chr(10) || trim(s[opening + 1]) || chr(10) || chr(10) || '**pos**' || chr(10) || chr(10) || trim(substr(pos.text, length(s[opening + 1]) + 1))
  || chr(10) || chr(10) || '**neg**' || chr(10) || chr(10) || trim(substr(neg.text, length(s[opening + 1]) + 1)) || chr(10) FROM c
"""


def _logs(spark, d):
    """Logs of all documents with stale rows: some of another card, some out of turn, branches on other openings, checks of other texts."""
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("card_id"), F.sha2("text", 256).alias("card_sha"), "n_chars")
    cards = rows.withColumn("position", F.col("card_id"))
    tries = rows.withColumn("attempt", F.explode(F.sequence(F.lit(0), (F.col("n_chars") % TRIES).cast("int"))))
    stale = lambda c, if_: F.when(if_, "other").otherwise(c)
    openings = tries.select(
        "card_id", stale(F.col("card_sha"), (F.col("card_id") % 5 == 1) & (F.col("attempt") == 1)).alias("card_sha"), F.lit("p").alias("prompt_sha"), "attempt",
        F.concat(F.lit("o"), F.col("attempt")).alias("prefix"), ((F.col("n_chars") + F.col("attempt")) % 2 == 0).alias("passed"), F.when(F.col("card_id") % 7 == 0, 9 - F.col("attempt")).otherwise(F.col("attempt")).cast("long").alias("_seq"),
    )
    sides = tries.withColumn("opening", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("branch", F.explode(F.array(F.lit("pos"), F.lit("neg"))))
    branches = sides.select(
        "card_id", "card_sha", F.lit("q").alias("prompt_sha"), "opening", stale(W.content_sha(F.concat(F.lit("o"), F.col("opening"))), F.col("card_id") % 4 == 3).alias("opening_sha"), "branch", "attempt",
        F.concat_ws("-", F.lit("t"), "opening", "branch", "attempt").alias("text"), F.col("attempt").cast("long").alias("_seq"),
    )
    checks = sides.filter((F.col("card_id") + F.col("attempt")) % 11 != 0).select(
        "card_id", "card_sha", "opening", "branch", "attempt", stale(W.content_sha(F.concat_ws("-", F.lit("t"), "opening", "branch", "attempt")), (F.col("card_id") % 6 == 5) & (F.col("branch") == "neg")).alias("branch_sha"),
        ((F.col("n_chars") + F.col("attempt")) % 3 != 0).alias("passed"), F.col("attempt").cast("long").alias("_seq"),
    )
    return cards, openings, branches, checks


def log_replay(spark, d):
    """What logs with stale rows come to: how many rows of each still hold, and each card's state."""
    cards, *logs = _logs(spark, d)
    o, b, c = W.replayed(cards, *logs, prompts=("p", "q"))
    state = W.states(cards, o, W.sides(cards, o, b, c, TRIES), TRIES)
    n = lambda rows, name: rows.groupBy("card_id").agg(F.count("*").alias(name))
    out = state.join(n(o, "openings"), "card_id", "left").join(n(b, "branches"), "card_id", "left").join(n(c, "checks"), "card_id", "left")
    return out.na.fill(0, ["openings", "branches", "checks"])


#: By hand: with m = n_chars % 3 attempts 0 to m. Openings: out of turn (only the first row counts) if id % 7 = 0; attempt 1 is of another card if id % 5 = 1.
LOG_REPLAY = """
WITH c AS (SELECT doc_id AS card_id, n_chars, n_chars % 3 AS m FROM documents),
o AS (SELECT *, CASE WHEN card_id % 5 = 1 AND m >= 1 THEN 1 WHEN card_id % 7 = 0 THEN 1 ELSE m + 1 END AS openings FROM c),
l AS (SELECT *, list_filter(range(openings), lambda a: (n_chars + a) % 2 = 0)[1] AS opening,
  CASE WHEN card_id % 4 = 3 THEN 0 ELSE least(openings, 2) * 2 * (m + 1) END AS branches FROM o),
k AS (SELECT *, CASE WHEN card_id % 4 = 3 THEN 0 ELSE least(openings, 2) * (CASE WHEN card_id % 6 = 5 THEN 1 ELSE 2 END) * len(list_filter(range(m + 1), lambda a: (card_id + a) % 11 <> 0)) END AS checks,
  opening IS NOT NULL AND opening <= 1 AND card_id % 4 <> 3 AS has_branches FROM l),
s AS (SELECT *, CASE WHEN opening IS NULL THEN NULL WHEN NOT has_branches THEN 'write' WHEN (card_id + m) % 11 = 0 THEN 'check' WHEN (n_chars + m) % 3 <> 0 THEN 'passed' WHEN m + 1 >= 3 THEN 'failed' ELSE 'write' END AS pos FROM k),
n AS (SELECT *, CASE WHEN pos IN ('passed', 'failed') AND card_id % 6 = 5 THEN 'check' WHEN pos = 'write' AND has_branches AND card_id % 6 = 5 THEN 'check' ELSE pos END AS neg FROM s)
SELECT card_id, CASE WHEN opening IS NULL THEN CASE WHEN openings >= 3 THEN 'failed' ELSE 'open' END WHEN 'failed' IN (pos, neg) THEN 'failed' WHEN pos = 'passed' AND neg = 'passed' THEN 'accepted' ELSE 'open' END AS state,
  CAST(openings AS BIGINT) AS openings, CAST(branches AS BIGINT) AS branches, CAST(checks AS BIGINT) AS checks FROM n
"""


def assembled_documents(spark, d):
    """Documents put together from parts of their texts: the decision's places are those of the parts."""
    text = F.col("text")
    cut = lambda a, n: F.substr(text, F.lit(a), n if not isinstance(n, int) else F.lit(n))
    rows = t(spark, d, "documents")
    made = W.document(F.concat(cut(1, 40), F.lit("\n\n")), cut(41, (F.col("doc_id") % 3 * 10).cast("int")), F.lit("I take "), cut(90, 12), F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit(". ")).otherwise(F.lit("")), cut(110, 60)), F.col("doc_id") % 4 < 2)
    return rows.select("doc_id", made.alias("w")).select("doc_id", F.md5("w.text").alias("text"), "w.continuation_start_char", "w.choice_char", "w.end_char", F.to_json("w.spans").alias("spans"))


_TAIL = "substr(text, 110, 60)"
ASSEMBLED_DOCUMENTS = rf"""
WITH p AS (SELECT doc_id, substr(text, 1, 40) || chr(10) || chr(10) AS o, substr(text, 41, CAST(doc_id % 3 * 10 AS BIGINT)) AS b, 'I take ' AS s, substr(text, 90, 12) AS x, CASE WHEN doc_id % 2 = 0 THEN '. ' ELSE '' END || {_TAIL} AS a FROM documents),
w AS (SELECT *, o || b || s || x || a AS text, length(o) AS n1, length(o || b) AS n2, length(o || b || s) AS n3, length(o || b || s || x) AS n4, length(o || b || s || x || a) AS n5, regexp_extract(a, '(?s)^(.*?(?:[.!?](?:[\s"'')\]]|$)|\n))', 1) AS e FROM p)
SELECT doc_id, md5(text) AS text, CAST(CASE WHEN doc_id % 4 < 2 AND b = '' THEN n3 ELSE n1 END AS INTEGER) AS continuation_start_char, CAST(n3 AS INTEGER) AS choice_char,
  CAST(CASE WHEN e = '' THEN n5 ELSE n4 + length(e) - CASE WHEN regexp_matches(e, '[.!?][\s"'')\]]$') THEN 1 ELSE 0 END END AS INTEGER) AS end_char,
  '[{{"name":"opening","start":0,"end":' || n1 || '}},{{"name":"before","start":' || n1 || ',"end":' || n2 || '}},{{"name":"stem","start":' || n2 || ',"end":' || n3 || '}},{{"name":"option","start":' || n3 || ',"end":' || n4 || '}},{{"name":"after","start":' || n4 || ',"end":' || n5 || '}}]' AS spans
FROM w
"""

QUERIES = {f.__name__: f for f in (document_rounds, pair_page, log_replay, assembled_documents)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
