"""Readers with an explicit order, JSONL in all codecs, staged writers with manifests."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import json
import lzma
import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def files(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> list[str]:
    """Files below root by suffix, ordered by path; hidden parts and folders named logs are left out."""
    fs, top = _fs(spark, root)
    if not fs.exists(top):
        raise FileNotFoundError(root)
    base, out, it = fs.makeQualified(top).toString().rstrip("/"), [], fs.listFiles(top, True)
    while it.hasNext():
        path = it.next().getPath().toString()
        parts = path[len(base) :].strip("/").split("/")
        if path.endswith(suffixes) and not any(p.startswith((".", "_")) or p == "logs" for p in parts):
            out.append(path)
    return sorted(out)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; in local mode, where there is one machine, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh place in the shared folder."""
    return f"{shared_dir(spark)}/corpusloom/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and a lost executor costs the tasks that it ran."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_order(df: DataFrame) -> DataFrame:
    """Adds _ord: file path, then place in it. Row order has a meaning in many operators, and Spark has none of its own."""
    return df.withColumn("_ord", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def resolve(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file; a folder's own Parquet files; else all below it."""
    fs, p = _fs(spark, path)
    if fs.getFileStatus(p).isFile():
        return spark.read.parquet(path)
    own = [s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]
    return spark.read.parquet(*sorted(own)) if own else spark.read.option("recursiveFileLookup", True).parquet(path)


def choose_split(splits: dict[str, DataFrame]) -> DataFrame:
    return splits["train"] if "train" in splits else next(iter(splits.values()))


def same_types(frames: list[DataFrame]) -> T.StructType:
    """The union of several schemas; a column of two types is an error, never a cast."""
    seen: dict[str, T.StructField] = {}
    for df in frames:
        for f in df.schema:
            if f.name in seen and seen[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name}: {seen[f.name].dataType.simpleString()} and {f.dataType.simpleString()}")
            seen.setdefault(f.name, T.StructField(f.name, f.dataType, True))
    return T.StructType(list(seen.values()))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    same_types(frames)
    out = frames[0].select("*")
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


_OPEN = {".gz": gzip.decompress, ".bz2": bz2.decompress, ".xz": lzma.decompress}


def _plain(path: str, content: bytes) -> bytes:
    if path.endswith(".zst"):
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(content)
    return next((f(content) for s, f in _OPEN.items() if path.endswith(s)), content)


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str | T.StructType, mode: str = "fail") -> DataFrame:
    """JSONL, plain or gz, bz2, xz, zst. Blank lines are skipped. mode: fail (names file and line), drop, or keep (_raw holds the line).

    Spark reads all but xz itself and splits what can be split; xz comes back from it as bad rows, so those files are read whole.
    """
    paths = [paths] if isinstance(paths, str) else paths
    odd = [p for p in paths if p.endswith(".xz")]
    rest = [p for p in paths if p not in odd]
    unknown = [p for p in rest if not p.endswith((".jsonl", ".json", ".gz", ".bz2", ".zst", "/")) and "." in p.rsplit("/", 1)[-1]]
    if unknown:
        raise ValueError(f"codec not known: {unknown[0]}")
    parts = []
    if rest:
        parts.append(spark.read.text(rest).select(F.col("_metadata.file_path").alias("_file"), "value"))
    if odd:

        def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for path, content in zip(frame["path"], frame["content"], strict=True):
                    text = _plain(path, content).decode("utf-8").split("\n")
                    yield pd.DataFrame({"_file": path, "value": text})

        parts.append(spark.read.format("binaryFile").load(odd).select("path", "content").mapInPandas(lines, "_file string, value string"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows.filter(F.trim("value") != "")
    fields = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    wide = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = rows.select("_file", "value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull() | F.col("r").isNull() | ~F.ltrim("value").startswith("{")
    names = [F.col(f"r.`{f.name}`").alias(f.name) for f in fields]
    if mode == "drop":
        return parsed.filter(~bad).select(*names)
    if mode == "keep":
        return parsed.select(*names, F.when(bad, F.col("value")).alias("_raw"))
    message = F.concat(F.lit("not a JSON object in "), F.col("_file"), F.lit(": "), F.substring("value", 1, 80))
    return parsed.select(F.when(bad, F.raise_error(message).cast(fields)).otherwise(F.struct(*names)).alias("r")).select("r.*")


def read_csv(spark: SparkSession, paths: str | list[str], sep: str = ",", required: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header, all values strings, quotes doubled, fields over several lines; required columns are checked."""
    df = spark.read.csv(paths, header=True, inferSchema=False, multiLine=True, escape='"', sep=sep)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def read_tree(spark: SparkSession, root: str, suffix: str = ".txt") -> DataFrame:
    """(path, text) of every file below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    return found.select("path", F.decode("content", "UTF-8").alias("text"))


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bytes, sha256)."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def shard_index(path):
    return F.coalesce(F.regexp_extract(path, r"_shard(\d+)", 1).try_cast("int"), F.lit(-1))


def settings_key(settings: dict, digits: int = 12) -> str:
    """A short key of settings: equal settings, equal key."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:digits]


def publish(df: DataFrame, path: str, inputs: dict | None = None, fmt: str = "parquet", most_rows: int = 50_000, **options) -> dict:
    """Write to a hidden folder beside path, add manifest.json, then rename: path appears whole or not at all.

    path must not exist or be empty. The manifest holds the inputs, the rows and the schema.
    """
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target) and len(fs.listStatus(target)):
        raise FileExistsError(path)
    stage = f"{path.rstrip('/').rsplit('/', 1)[0]}/.{path.rstrip('/').rsplit('/', 1)[-1]}.{settings_key({'path': path})}"
    _, staged = _fs(spark, stage)
    fs.delete(staged, True)
    try:
        writer = df.write.format(fmt).option("maxRecordsPerFile", most_rows)
        writer = writer.option("compression", "zstd") if fmt == "parquet" else writer
        writer.options(**options).save(stage)
        manifest = {"inputs": inputs or {}, "rows": spark.read.format(fmt).schema(df.schema).load(stage).count(), "columns": {f.name: f.dataType.simpleString() for f in df.schema}}
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{stage}/_manifest.json"), True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if fs.exists(target):
            fs.delete(target, False)
        if not fs.rename(staged, target):
            raise OSError(f"rename to {path} failed")
    except Exception:
        fs.delete(staged, True)
        raise
    return manifest


def manifest_of(spark: SparkSession, path: str) -> dict | None:
    fs, p = _fs(spark, f"{path}/_manifest.json")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def prepared(spark: SparkSession, path: str, inputs: dict, overwrite: bool = False) -> bool:
    """Whether path was published from these inputs; other inputs are an error unless they may be overwritten."""
    got = manifest_of(spark, path)
    if got is None:
        return False
    if got["inputs"] == inputs:
        return True
    if overwrite:
        return False
    raise ValueError(f"{path} was made from other inputs")
