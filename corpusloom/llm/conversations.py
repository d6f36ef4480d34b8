r"""Conversation structure repair: a fold over each conversation's turns, on Spark SQL's higher-order functions.

1. Windows over a conversation's rows, by turn, give each row its number, the initial before it and its fault: blank, else a
   duplicate of an earlier row (role and text), else truncated.
2. The rows are collected as structs in their order, and aggregate() folds over them. It carries four (cost, audit) structs: the
   cheapest edits after which the repaired roles are none, `s`, end with `u`, or end with `a`. Each is the least() of what reaches
   it. Two edit lists of one cost that stand at the same row in the same state never begin with one another (what follows could
   only be inserts, which cost), so the least prefix stays the least whatever follows.
3. An audit says all: which rows stay, and where the inserted ones stand; their roles alternate. So the repaired text is made
   from the audit by array functions, and hashed.

A conversation of more than ROWS rows or CHARS characters goes another way with the same result, so that none has to meet in one
task: its rows are dealt by ranges of their order, each part is cut into pieces of at most about that size, and each piece is folded
from each of the four states; the pieces' (cost, audit) tables are folded in order, each piece then makes its own text, and the
texts stream through one hash, in order. What meets in one row is a conversation's audit (a letter a row) in 16 forms at most.

Costs are parameters of the contract: rerole 3, delete 4, insert 3, a truncated row that stays 3.

Defined cases: a null role or text is one space, and so is a null id or turn where rows are chosen for damage; rows without a turn
come first, rows of one turn by role, then text (both by bytes); a null conv_id is a conversation of its own; repeated rows are
rows; a conversation without rows after damage has zeros, an empty audit and the hash of the empty string; gaps beyond a long are
the greatest long; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import let
from corpusloom.llm.common import ASCII_SPACE, materialize, small_batches

#: A conversation, or a piece of a longer one, has at most so many rows, and characters but for its last row.
ROWS, CHARS = 2048, 1 << 23
RETEXT, REROLE, DELETE, INSERT = 3, 3, 4, 3
#: The pairs of role initials that may follow one another.
LEGAL = ("su", "ua", "au")
#: A cost that no edits have.
NEVER = 1 << 40
STATES = ("none", "s", "u", "a")


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, kept: rows with faults put in by a checksum of their id and turn. A dropped row stays as a mark that its conversation exists."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_id).alias("conv"), F.col(turn).try_cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), code.alias("code"))
    said = F.when(F.col("code").isin(0, 1), "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select("conv", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), (F.col("code") != 0).alias("kept"), copies.alias("copy"))
    return rows.drop("copy")


def marked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with number, initial, fault, breaks (with the initial before it) and fresh (the first of its turn) within keys. An input column earlier says that a row was seen before."""
    order, number = Window.partitionBy(*keys, "kept").orderBy("turn", "role", "text"), Window.partitionBy(*keys, "kept").orderBy("number")
    same = Window.partitionBy(*keys, "kept", "role", "text").orderBy("number")
    end = F.rtrim(F.col("text"), F.lit(ASCII_SPACE))
    rows = rows.repartition(*keys)  # one deal serves all windows and the grouping
    rows = rows.withColumns({"initial": F.substring("role", 1, 1), "number": F.row_number().over(order)})
    rows = rows.withColumns({"seen": F.row_number().over(same), "before": F.lag("initial").over(number), "last": F.lag("turn").over(number), "chars": F.coalesce(F.sum(F.length("text")).over(number.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    again = (F.col("seen") > 1) | F.col("earlier") if "earlier" in rows.columns else F.col("seen") > 1
    fault = F.when(end == "", "blank").when(again, "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    fresh = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last"))
    return rows.withColumns({"fault": fault, "fresh": fresh, "breaks": F.col("before").isNotNull() & ~F.concat("before", "initial").isin(*LEGAL)})


def gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for keys: the sorted array of its rows, and its counts."""
    kept = F.col("kept")
    count = lambda c: F.sum(F.when(kept & c, 1).otherwise(0)).cast("long")
    ends = F.when(kept, F.struct("number", "initial", "turn"))
    return rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(kept, F.struct("number", "role", "text", "initial", "fault")))).alias("rows"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("breaks")).alias("illegal"), count(F.col("fresh")).alias("turns"),
        F.min(F.when(kept, F.col("turn"))).alias("low"), F.max(F.when(kept, F.col("turn"))).alias("high"), F.min(ends).alias("first"), F.max(ends).alias("last"),
    )


def _more(state: Column, cost: Column | int, letters: Column | str) -> Column:
    """A state after further edits."""
    letters = F.lit(letters) if isinstance(letters, str) else letters
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], letters).alias("audit"))


def _named(**states: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in states.items()])


def _inserted(x: Column) -> Column:
    """The four states after any inserts that can pay."""
    one, two = lambda n: _more(x[n], INSERT, "I"), lambda n: _more(x[n], 2 * INSERT, "II")
    return _named(none=x["none"], s=x["s"], u=F.least(x["u"], one("none"), one("s"), one("a")), a=F.least(x["a"], one("u"), two("none"), two("s")))


def _taken(x: Column, row: Column) -> Column:
    """The four states after one row was kept, given another role, or deleted."""
    stays, late, initial = ~row["fault"].isin("blank", "duplicate"), F.when(row["fault"] == "truncated", RETEXT).otherwise(0), row["initial"]
    gone = lambda n: _more(x[n], DELETE, "D")

    def turned(state: Column, role: str) -> Column:
        return F.when(stays, _more(state, late + F.when(initial == role, 0).otherwise(REROLE), F.when(initial == role, "K").otherwise("R")))

    return _named(
        none=gone("none"), s=F.least(gone("s"), F.when(stays & (initial == "s"), _more(x["none"], late, "K"))),
        u=F.least(gone("u"), turned(F.least(x["none"], x["s"], x["a"]), "u")), a=F.least(gone("a"), turned(x["u"], "a")),
    )


def folded(rows: Column, enter: Column | int) -> Column:
    """The four (cost, audit) structs after the rows, if what stands before them left the state of number enter."""
    enter = F.lit(enter) if isinstance(enter, int) else enter
    start = _named(**{n: F.struct(F.when(enter == i, 0).otherwise(NEVER).cast("long").alias("cost"), F.lit("").alias("audit")) for i, n in enumerate(STATES)})
    return F.aggregate(rows, start, lambda x, row: let(_inserted(x), lambda y: _taken(y, row)), _inserted)


def repaired(rows: Column, audit: Column, enter: Column) -> Column:
    """The repaired rows as an array of role:text, as the audit says."""
    some = lambda role, text, initial: F.struct(role.alias("role"), text.alias("text"), initial.alias("initial"))
    none = some(F.lit(None).cast("string"), F.lit(""), F.lit(""))
    new = lambda n: F.array_repeat(none, n)

    def part(edits: Column, row: Column) -> Column:
        last = F.right(edits, F.lit(1))
        own = some(F.when(last == "K", row["role"]), row["text"], F.when(last == "K", row["initial"]).otherwise(""))
        return F.concat(new(F.length(edits) - 1), F.filter(F.array(own), lambda _: last != "D"))

    parts = F.flatten(F.zip_with(F.regexp_extract_all(audit, F.lit("I*[KRD]"), F.lit(0)), rows, part))
    every = F.concat(parts, new(F.length(F.regexp_extract(audit, "I*$", 0))))
    odd = lambda out: (enter == 2) != ((enter == 0) & (F.coalesce(F.get(out, F.lit(0))["initial"], F.lit("")) == "s"))
    role = lambda j, first: F.when((j % 2 == 0) != first, "user").otherwise("assistant")
    return let(every, lambda out: let(odd(out), lambda first: F.transform(out, lambda x, j: F.concat(F.coalesce(x["role"], role(j, first)), F.lit(":"), x["text"]))))


def _gaps(low: str = "low", high: str = "high", turns: str = "turns") -> Column:
    wide = lambda c: F.col(c).cast("decimal(30,0)")
    return F.least(F.coalesce(wide(high) - wide(low) + 1 - wide(turns), F.lit(0)), F.lit((1 << 63) - 1).cast("decimal(30,0)")).cast("long")


COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _short(rows: DataFrame) -> DataFrame:
    """Conversations of bounded size, each folded in one row."""
    each = gathered(marked(rows, ["conv"]), ["conv"]).withColumn("ends", folded(F.col("rows"), 0))
    each = each.withColumn("best", F.least("ends.none", "ends.a"))
    text = F.array_join(repaired(F.col("rows"), F.col("best.audit"), F.lit(0)), "\n")
    return each.select("conv", _gaps().alias("gaps"), *COUNTS, "best.cost", "best.audit", F.sha2(text.cast("binary"), 256).alias("sha"))


def _streamed(texts: DataFrame) -> DataFrame:
    """conv, sha of texts (conv, part, piece, text), joined by line breaks in order. A task holds a batch at a time."""
    kind = texts.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = digest = some = None
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), pa.field("sha", pa.string())])
            for now, _, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is None or now != conv:
                    if digest is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([conv], schema.field(0).type), pa.array([digest.hexdigest()])], schema=schema)
                    conv, digest, some = now, hashlib.sha256(), False
                if text is not None:
                    digest.update(("\n" if some else "").encode() + text.encode())
                    some = True
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], schema.field(0).type), pa.array([digest.hexdigest()])], schema=schema)

    return small_batches(texts.repartition("conv").sortWithinPartitions("conv", "part", "piece")).mapInArrow(run, f"conv {kind.simpleString()}, sha string")


def _long(rows: DataFrame, parts: int) -> DataFrame:
    """Conversations of any size, in parts of their order and pieces of parts."""
    rows = rows.repartitionByRange(parts, "conv", "turn", "role", "text").withColumn("part", F.spark_partition_id())
    rows = materialize(rows.withColumn("same", F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256)), "long-rows")
    first = rows.filter("kept").groupBy(F.col("conv").alias("of"), F.col("same").alias("as")).agg(F.min("part").alias("from"))
    rows = rows.join(first, F.col("conv").eqNullSafe(F.col("of")) & (F.col("same") == F.col("as")), "left")
    rows = rows.select("conv", "part", "kept", "turn", "role", "text", F.coalesce(F.col("from") < F.col("part"), F.lit(False)).alias("earlier"))
    piece = F.when(F.col("kept"), F.floor((F.col("number") - 1) / ROWS) + F.floor(F.col("chars") / CHARS)).otherwise(0)
    pieces = gathered(marked(rows, ["conv", "part"]).withColumn("piece", piece), ["conv", "part", "piece"])
    fold = F.transform(F.array(*map(F.lit, range(4))), lambda e: let(folded(F.col("rows"), e), lambda x: F.array(*[x[n] for n in STATES])))
    pieces = materialize(pieces.withColumn("fold", F.when(F.size("rows") > 0, fold)), "pieces")

    # What a conversation's pieces have to say to each other, in order.
    told = F.struct("part", "piece", "fold", "first", "last")
    whole = pieces.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.when(F.size("rows") > 0, told))).alias("p"), *[F.sum(c).alias(c) for c in COUNTS], F.sum("turns").alias("turns"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    pairs = F.zip_with(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    across = lambda e: (e["x"]["part"] != e["y"]["part"])  # noqa: E731  within a part the windows have seen it
    broken = F.size(F.filter(pairs, lambda e: across(e) & ~F.concat(e["x"]["last"]["initial"], e["y"]["first"]["initial"]).isin(*LEGAL)))
    twice = F.size(F.filter(pairs, lambda e: across(e) & F.coalesce(e["x"]["last"]["turn"] == e["y"]["first"]["turn"], F.lit(False))))
    way = lambda cost, audit, at: F.struct(cost.cast("long").alias("cost"), audit.alias("audit"), at.alias("at"))
    start = F.array(*[way(F.lit(0 if not i else NEVER), F.lit(""), F.array().cast("array<int>")) for i in range(4)])

    def next_piece(acc: Column, p: Column) -> Column:
        step = lambda e, i: way(acc[e]["cost"] + p["fold"][e][i]["cost"], F.concat(acc[e]["audit"], p["fold"][e][i]["audit"]), F.concat(acc[e]["at"], F.array(F.lit(e))))
        return F.array(*[F.least(*[step(e, i) for e in range(4)]) for i in range(4)])

    finished = lambda acc: let(F.array(way(acc[0]["cost"], acc[0]["audit"], F.concat(acc[0]["at"], F.array(F.lit(0)))), way(acc[3]["cost"], acc[3]["audit"], F.concat(acc[3]["at"], F.array(F.lit(3))))), F.array_min)
    empty = let(start, finished)
    whole = whole.withColumns({"best": F.when(F.size("p") > 0, F.aggregate("p", start, next_piece, finished)).otherwise(empty), "broken": broken, "twice": twice})
    whole = whole.select("conv", *COUNTS[:3], (F.col("illegal") + F.col("broken")).alias("illegal"), (F.col("turns") - F.col("twice")).alias("turns"), "low", "high", "best", F.transform("p", lambda x: F.struct(x["part"], x["piece"])).alias("p"))
    whole = materialize(whole, "whole")
    chosen = whole.select(F.col("conv").alias("of"), F.posexplode("p").alias("i", "x"), "best.at").select("of", F.col("x.part").alias("in"), F.col("x.piece").alias("nth"), F.get("at", F.col("i")).alias("enter"), F.get("at", F.col("i") + 1).alias("leave"))
    both = pieces.filter(F.size("rows") > 0).join(chosen, F.col("conv").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")) & (F.col("piece") == F.col("nth")))
    audit = F.get(F.get("fold", F.col("enter")), F.col("leave"))["audit"]
    lines = repaired(F.col("rows"), audit, F.col("enter"))
    texts = both.select("conv", "part", "piece", let(lines, lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n"))).alias("text"))
    sha = _streamed(texts).withColumnRenamed("conv", "of")
    nothing = hashlib.sha256().hexdigest()
    return whole.join(sha, F.col("conv").eqNullSafe(F.col("of")), "left").select("conv", _gaps().alias("gaps"), *COUNTS, "best.cost", "best.audit", F.coalesce("sha", F.lit(nothing)).alias("sha"))


def repair(rows: DataFrame) -> DataFrame:
    """From rows (conv, turn, role, text, kept): conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha of each conversation."""
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
    long = materialize(sizes.filter((F.col("n") > ROWS) | (F.col("chars") > CHARS)), "long")
    size = long.agg(F.count("*").alias("some"), F.sum("n").alias("n"), F.sum("chars").alias("chars")).first()
    if not size["some"]:
        return _short(rows)
    of = long.select(F.col("conv").alias("of"))
    apart = lambda how: rows.join(of, F.col("conv").eqNullSafe(F.col("of")), how)
    parts = max(2, -(-size["n"] // (32 * ROWS)), -(-size["chars"] // (8 * CHARS)))
    return _short(apart("left_anti")).unionByName(_long(apart("left_semi"), parts))


def op12_conversation_repair(spark, sf_dir):
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return repair(rows).select(F.col("conv").alias("conv_id"), "gaps", *COUNTS, "cost", "audit", F.col("sha").alias("repaired_sha256"))


#: The same by a recursive table, one row of a conversation a step. The checksum is made bit by bit.
OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT)),
      lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS code
  FROM conversations, bits
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE code <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    substr(role, 1, 1) AS initial, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS e
  FROM damaged
), numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM ordered
), flagged AS (
  SELECT *, CASE WHEN e = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM flagged GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations
), ends AS (SELECT ids.conv_id, coalesce(n, 0) AS n FROM ids LEFT JOIN counts ON ids.conv_id IS NOT DISTINCT FROM counts.conv_id
), fold AS (  -- states: 1 nothing yet, 2 system, 3 user, 4 assistant; each a cost, an audit and the repaired rows
  SELECT conv_id, 0 AS i, [{'c': 0, 'a': '', 'r': []::VARCHAR[]}, {'c': 1000000000, 'a': '', 'r': []::VARCHAR[]}, {'c': 3, 'a': 'I', 'r': ['user:']}, {'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']}] AS s FROM ids
  UNION ALL
  SELECT conv_id, i, [s[1], s[2],
    list_min([s[3]] || list_transform([s[1], s[2], s[4]], lambda x: {'c': x.c + 3, 'a': x.a || 'I', 'r': x.r || ['user:']})),
    list_min([s[4], {'c': s[3].c + 3, 'a': s[3].a || 'I', 'r': s[3].r || ['assistant:']}] || list_transform([s[1], s[2]], lambda x: {'c': x.c + 6, 'a': x.a || 'II', 'r': x.r || ['user:', 'assistant:']}))] AS s
  FROM (
    SELECT f.conv_id, f.i + 1 AS i, [
      {'c': s[1].c + 4, 'a': s[1].a || 'D', 'r': s[1].r},
      list_min([{'c': s[2].c + 4, 'a': s[2].a || 'D', 'r': s[2].r}] || CASE WHEN fault IN ('blank', 'duplicate') OR initial <> 's' THEN [] ELSE [{'c': s[1].c + late, 'a': s[1].a || 'K', 'r': s[1].r || [role || ':' || text]}] END),
      list_min([{'c': s[3].c + 4, 'a': s[3].a || 'D', 'r': s[3].r}] || CASE WHEN fault IN ('blank', 'duplicate') THEN [] ELSE
        list_transform([s[1], s[2], s[4]], lambda x: CASE WHEN initial = 'u' THEN {'c': x.c + late, 'a': x.a || 'K', 'r': x.r || [role || ':' || text]} ELSE {'c': x.c + late + 3, 'a': x.a || 'R', 'r': x.r || ['user:' || text]} END) END),
      list_min([{'c': s[4].c + 4, 'a': s[4].a || 'D', 'r': s[4].r}] || CASE WHEN fault IN ('blank', 'duplicate') THEN [] ELSE
        [CASE WHEN initial = 'a' THEN {'c': s[3].c + late, 'a': s[3].a || 'K', 'r': s[3].r || [role || ':' || text]} ELSE {'c': s[3].c + late + 3, 'a': s[3].a || 'R', 'r': s[3].r || ['assistant:' || text]} END] END)
    ] AS s
    FROM fold f JOIN (SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late FROM flagged) g ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = f.i + 1
  )
), best AS (
  SELECT f.conv_id, list_min([s[1], s[4]]) AS b FROM fold f JOIN ends e ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.n
)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(b.b.c AS BIGINT) AS cost, b.b.a AS audit, sha256(coalesce(array_to_string(b.b.r, chr(10)), '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""
