"""Jobs in rounds over append-only tables: find what is due, ask for it, append, commit; a round that died is made good by the next run.

A job has stages, each with a table of its own. A stage is told all committed tables and says what is due, as rows; what it asks for
them is written to a folder that counts only once its marker stands. So what a run has committed is never asked again, and a run that stops
anywhere leaves tables that the next one goes on from, to the same end if asking is repeatable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.io import _fs

MARKER = "_COMMITTED"


@dataclass
class Stage:
    """name: its table; schema: of the table's rows; due: from all tables by name, the rows to ask for (empty: nothing to do); ask: from those, rows of the schema (none if none are due; a row that gets no answer stays due)."""

    name: str
    schema: str
    due: Callable[[dict[str, DataFrame]], DataFrame]
    ask: Callable[[DataFrame], DataFrame]


class Rounds:
    """Stages over the folder root, which all executors share."""

    def __init__(self, spark: SparkSession, root: str, stages: list[Stage]):
        self.spark, self.root, self.stages = spark, root.rstrip("/"), stages

    def _parts(self, stage: str) -> list[tuple[int, str]]:
        """Committed parts of a stage: (their number, folder), in order. Folders without a marker are of rounds that died."""
        fs, top = _fs(self.spark, f"{self.root}/{stage}")
        if not fs.exists(top):
            return []
        out = []
        for s in fs.listStatus(top):
            path = s.getPath()
            if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, MARKER)):
                out.append((int(path.getName().split("-")[1]), path.toString()))
        return sorted(out)

    def table(self, stage: Stage) -> DataFrame:
        """What the stage has committed, with _seq (the part's number)."""
        parts = self._parts(stage.name)
        empty = self.spark.createDataFrame([], stage.schema)
        wide = empty.withColumn("_seq", F.lit(0).cast("long"))
        return self.spark.read.schema(wide.schema).parquet(*[p for _, p in parts]) if parts else wide

    def tables(self) -> dict[str, DataFrame]:
        return {s.name: self.table(s) for s in self.stages}

    def _append(self, stage: Stage, rows: DataFrame) -> int:
        parts = self._parts(stage.name)
        number = parts[-1][0] + 1 if parts else 0
        path = f"{self.root}/{stage.name}/part-{number:08d}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("_seq", F.lit(number).cast("long")).write.parquet(path)
        n = self.spark.read.parquet(path).count()
        fs, marker = _fs(self.spark, f"{path}/{MARKER}")
        if not n:  # nothing was due
            fs.delete(marker.getParent(), True)
            return 0
        out = fs.create(marker, True)
        out.write(bytearray(json.dumps({"rows": n}).encode()))
        out.close()
        return n

    def sweep(self) -> int:
        """Delete the folders that no marker made count; how many there were. For when no other run is at work."""
        gone = 0
        for stage in self.stages:
            fs, top = _fs(self.spark, f"{self.root}/{stage.name}")
            kept = {p.rsplit("/", 1)[-1] for _, p in self._parts(stage.name)}
            for s in fs.listStatus(top) if fs.exists(top) else ():
                if s.getPath().getName() not in kept:
                    gone += fs.delete(s.getPath(), True)
        return gone

    def run(self, most: int = 100, only: list[str] | None = None) -> dict:
        """Rounds of all stages (or of some) until a round finds nothing due, or most rounds have passed: {rounds, asked by stage, finished}."""
        asked, rounds = {s.name: 0 for s in self.stages}, 0
        for rounds in range(1, most + 1):  # noqa: B007
            work = 0
            for stage in self.stages:
                if only is not None and stage.name not in only:
                    continue
                names = self.spark.createDataFrame([], stage.schema).columns
                n = self._append(stage, stage.ask(stage.due(self.tables())).select(*names))
                asked[stage.name] += n
                work += n
            if not work:
                return {"rounds": rounds, "asked": asked, "finished": True}
        return {"rounds": rounds, "asked": asked, "finished": False}
