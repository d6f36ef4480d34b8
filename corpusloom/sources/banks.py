"""Readers of pairs, probes, banks and catalogs with all their checks, and writers of splits, scores and ordered tables.

A bank or catalog is small by its nature; its problems are collected and reported together.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.io import _fs, read_jsonl

SPLITS = ("train", "dev", "test")


def problems_of(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, problem) for each check that holds, and for keys that repeat."""
    codes = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    found = rows.select(F.col(key).cast("string").alias("key"), F.explode(codes).alias("problem"))
    again = rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit("duplicate").alias("problem"))
    return found.unionByName(again)


def checked(rows: DataFrame, key: str, checks: dict[str, Column], most: int = 20) -> DataFrame:
    """rows, or an error that names the first problems in order."""
    found = problems_of(rows, key, checks).orderBy("key", "problem").limit(most).collect()
    if found:
        raise ValueError("\n".join(f"{r['key']}: {r['problem']}" for r in found))
    return rows


def first_rows(rows: DataFrame, order: str, most: int | None) -> DataFrame:
    return rows if most is None else rows.orderBy(order).limit(most)


def read_pairs(spark: SparkSession, path: str, schema: str, checks: dict[str, Column], key: str = "pair_id", splits: tuple[str, ...] = SPLITS, most: int | None = None) -> DataFrame:
    """Pairs of a JSONL file with unique ids, all checked, of some splits; the first so many by id."""
    rows = checked(read_jsonl(spark, path, schema), key, checks | {"split": ~F.col("split").isin(*SPLITS)})
    return first_rows(rows.filter(F.col("split").isin(*splits)), key, most)


def read_probes(spark: SparkSession, path: str, schema: str, splits: tuple[str, ...] = SPLITS, sources: tuple[str, ...] | None = None, most: int | None = None, per_kind: int | None = None) -> DataFrame:
    """Probes with unique ids and no outer white space, of some splits and sources; the first so many, of all or of each kind."""
    from pyspark.sql import Window

    odd = {"whitespace": F.col("prefix").rlike(r"^\s|\s$"), "split": ~F.col("split").isin(*SPLITS)}
    rows = checked(read_jsonl(spark, path, schema), "id", odd).filter(F.col("split").isin(*splits))
    rows = rows.filter(F.col("source").isin(*sources)) if sources else rows
    if per_kind is not None:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("kind").orderBy("id"))).filter(F.col("__n") <= per_kind).drop("__n")
    return first_rows(rows, "id", most)


def read_bank(spark: SparkSession, path: str) -> dict:
    """A bank as a dict: JSON, or YAML where a YAML library is there."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("reading YAML needs a YAML library; write the bank as JSON") from e
        return yaml.safe_load(text)
    return json.loads(text)


def bank_rows(spark: SparkSession, bank: dict, part: str, schema: str, reviewed: bool = False) -> DataFrame:
    """A bank's part as rows; where it has to be reviewed, an unreviewed bank is an error."""
    if reviewed and not bank.get("reviewed"):
        raise ValueError(f"{part}: not reviewed")
    names = [c.name for c in spark.createDataFrame([], schema).schema]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in bank.get(part) or []], schema)


def rendered(rows: DataFrame, group: str, columns: list[str], header: str) -> str:
    """Rows as a YAML text by group, with counts; for a bank, so for a few rows."""
    lines = [f"# {x}" for x in header.splitlines()]
    got = rows.orderBy(group, *columns).collect()
    for name in sorted({r[group] for r in got}):
        of = [r for r in got if r[group] == name]
        lines.append(f"{json.dumps(str(name))}:  # {len(of)}")
        lines += ["  - {" + ", ".join(f"{c}: {json.dumps(r[c], ensure_ascii=False)}" for c in columns) + "}" for r in of]
    return "\n".join(lines) + "\n"


# --- writers ------------------------------------------------------------------------------------------------------------


def export_rows(pairs: DataFrame, branch: str, source: list[str]) -> DataFrame:
    """One branch's documents as training rows: text, source, domain, pair_id, branch, split."""
    return pairs.select(F.col(f"text_{branch}").alias("text"), F.concat_ws("/", *source).alias("source"), F.col(source[0]).alias("domain"), "pair_id", F.lit(branch).alias("branch"), "split")


def write_splits(rows: DataFrame, path: str, by: tuple[str, ...] = ("branch", "split")) -> None:
    rows.write.partitionBy(*by).parquet(path)


def write_table(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV of columns in their order; what is missing is empty."""
    rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.csv(path, header=True, escape='"', quoteAll=False, emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def ascii_json(columns: list[str]) -> Column:
    """A row as a JSON text in ASCII: what is beyond it is escaped."""
    text = F.to_json(F.struct(*columns))
    escaped = lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(F.ascii(c)), 4, "0"))))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(text, ""), escaped), "")).otherwise(text)


def write_scores(rows: DataFrame, path: str, document: str, place: str, value: str) -> None:
    """One row a document: its values in order, their number and mean."""
    inside = F.sort_array(F.collect_list(F.struct(place, value)))
    out = rows.groupBy(document).agg(F.transform(inside, lambda x: x[value].cast("float")).alias("values"), F.avg(value).alias("mean"), F.count("*").alias("n"))
    out.write.parquet(path)


def finished_shards(paths: list[str]) -> dict[int, list[int]]:
    """Shards that are done, by how many there are, from names like part-3-of-8/_SUCCESS."""
    import re

    out: dict[int, list[int]] = {}
    for p in paths:
        if m := re.search(r"part-(\d+)-of-(\d+)/_SUCCESS$", p):
            out.setdefault(int(m[2]), []).append(int(m[1]))
    return {n: sorted(x) for n, x in out.items()}


def token_stats(rows: DataFrame, tokens: Column, groups: list[str], width: int) -> DataFrame:
    """By group: texts, their mean, greatest and total tokens, and a histogram of tokens in steps."""
    each = rows.select(*groups, tokens.cast("long").alias("n")).groupBy(*groups, F.floor(F.col("n") / width).alias("bin")).agg(F.count("*").alias("texts"), F.sum("n").alias("tokens"), F.max("n").alias("most"))
    bars = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bin", "texts"))), lambda b: F.concat_ws(":", b["bin"].cast("string"), b["texts"].cast("string"))), ",")
    return each.groupBy(*groups).agg(F.sum("texts").alias("texts"), (F.sum("tokens") / F.sum("texts")).alias("mean"), F.max("most").alias("most"), F.sum("tokens").alias("tokens"), bars.alias("histogram"))
