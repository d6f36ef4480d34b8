"""A cache of made tables by content: what was made from the same settings and the same input bytes is read again, never made again.

An entry's key is a digest of its name, its settings and its inputs' contents, and its folder appears whole or not at all. A second table, of what the inputs looked like
(path, length, time of change) when they were read, answers for inputs that have not been touched: then no input is read. If they were touched, their bytes are digested, and only bytes that
differ make another entry.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.io import _fs, manifest_of, publish, settings_key


@dataclass
class Entry:
    """A cached table, its key, and how it came: hit (inputs untouched), same (touched, but of the same bytes), made, or lost (another run was first)."""

    table: DataFrame
    key: str
    how: str


def look(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of every file below the paths, in order; names that begin with . or _ are left out."""
    out = []
    for path in paths:
        fs, top = _fs(spark, path)
        if not fs.exists(top):
            raise FileNotFoundError(path)
        base = fs.makeQualified(top).toString().rstrip("/")
        it = fs.listFiles(top, True)
        while it.hasNext():
            s = it.next()
            name = s.getPath().toString()
            if not any(p.startswith((".", "_")) for p in name[len(base) :].split("/") if p):
                out.append((name, s.getLen(), s.getModificationTime()))
    return sorted(out)


def contents(spark: SparkSession, files: list[tuple[str, int, int]]) -> str:
    """A digest of the files' bytes, in the order of their names within what they have in common. Files are digested by many tasks; one file is one task's."""
    if not files:
        return hashlib.sha256().hexdigest()
    root = files[0][0].rsplit("/", 1)[0]
    while not all(f.startswith(root + "/") for f, _, _ in files):
        root = root.rsplit("/", 1)[0]
    rows = spark.read.format("binaryFile").load([f for f, _, _ in files]).select("path", F.sha2("content", 256).alias("d"))
    plain = lambda p: p.replace("file:///", "file:/")
    names = sorted((plain(r["path"])[len(plain(root)) :], r["d"]) for r in rows.collect())
    return hashlib.sha256("\n".join(f"{n}:{d}" for n, d in names).encode()).hexdigest()


def _put(spark: SparkSession, path: str, value: dict) -> None:
    """Write JSON beside path and rename it there: a reader sees the old or the new one."""
    fs, at = _fs(spark, path)
    _, stage = _fs(spark, f"{path.rsplit('/', 1)[0]}/.{path.rsplit('/', 1)[-1]}.{uuid.uuid4().hex}")
    out = fs.create(stage, True)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(stage, at):
        fs.delete(stage, False)  # another run was first


def _get(spark: SparkSession, path: str) -> dict | None:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def cached(spark: SparkSession, root: str, name: str, settings: dict, inputs: list[str], make: Callable[[], DataFrame], rebuild: bool = False, none_is_error: bool = False) -> Entry:
    """The table that make gives for these settings and inputs, made once.

    make is asked only on a miss. If two runs make one entry at once, the first to be done stays and the other takes it. rebuild makes it anew under a key of its own;
    none_is_error refuses a table without rows, and leaves nothing.
    """
    root, files = root.rstrip("/"), look(spark, inputs)
    stamp = f"{root}/looks/{name}-{settings_key({'settings': settings, 'files': files}, 24)}.json"
    seen = None if rebuild else _get(spark, stamp)

    def entry(key: str) -> str:
        return f"{root}/{name}-{key}"

    def table(key: str) -> DataFrame:
        return spark.read.parquet(entry(key))

    if seen and manifest_of(spark, entry(seen["key"])):
        return Entry(table(seen["key"]), seen["key"], "hit")
    key = settings_key({"name": name, "settings": settings, "contents": contents(spark, files), **({"rebuild": uuid.uuid4().hex} if rebuild else {})}, 24)
    how = "same"
    if manifest_of(spark, entry(key)) is None:
        rows = make()
        if none_is_error and not rows.limit(1).count():
            raise ValueError(f"{name}: no rows")
        try:
            publish(rows, entry(key), {"settings": settings, "files": [list(f[:2]) for f in files]})
            how = "made"
        except Exception:
            if manifest_of(spark, entry(key)) is None:
                raise
            how = "lost"
    if not rebuild:
        _put(spark, stamp, {"key": key})
    return Entry(table(key), key, how)
