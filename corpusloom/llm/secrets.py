r"""Secret scans with an incremental blob ledger, on DataFrame functions alone.

Every version of every file (path, version, text) is addressed by its content's SHA-256. The ledger holds, for each (blob, rules
version) that has been scanned, its findings; a run scans only the pairs it has not seen and joins the findings back to all
paths and versions. Equal texts are scanned once, and a new rules version scans everything anew without losing the old findings.

Defined cases: null text is empty and has no findings; repeated rows get a row each; an empty table gives an empty result and
an empty ledger; extra columns are ignored. Base spans are those of the three base rules; the other rules add spans.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, scratch, text_of
from corpusloom.llm.spans import SPAN, as_spans, gaps, located, matches, merged, written

#: The base rules, in the order of their kinds, and rules for well-known key formats.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
MORE = {
    "private_key": r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}+",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}+",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
}
#: Parts in which a blob's rows are looked at before they meet.
SALTS = 64
KINDS = ("assign", "access", "hex")
RULES = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "more": "|".join(MORE.values())}
RULES_VERSION = hashlib.sha256(repr(sorted(RULES.items())).encode()).hexdigest()[:16]

FINDINGS = f"blob binary, rules string, base array<{SPAN}>, spans array<{SPAN}>"


def _kind_of(match: Column) -> Column:
    first, *rest = MORE.items()
    out = F.when(match.rlike(first[1]), first[0])
    for kind, pattern in rest:
        out = out.when(match.rlike(pattern), kind)
    return out


def scan(blobs: DataFrame) -> DataFrame:
    """blob, base, spans of rows (blob, text)."""
    t = F.col("text")
    rows = blobs.select("*", *[matches(t, p).alias(f"m_{k}") for k, p in RULES.items()])
    rows = rows.select("blob", *[f"m_{k}" for k in RULES], *[gaps(t, p, F.col(f"m_{k}")).alias(f"g_{k}") for k, p in RULES.items()])
    rows = rows.select("blob", *[located(F.col(f"m_{k}"), F.col(f"g_{k}")).alias(k) for k in RULES])
    # Matches of a short value count as consumed, and go: the rule is not tried again inside them.
    long = F.filter("assign", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 6)
    more = F.transform("more", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _kind_of(x["m"]).alias("kind")))
    rows = rows.select("blob", as_spans(long, "assign", 0).alias("assign"), as_spans(F.col("access"), "access", 1).alias("access"), as_spans(F.col("hex"), "hex", 2).alias("hex"), more.alias("more"))
    rows = rows.select("blob", merged(F.col("assign"), F.col("access"), F.col("hex")).alias("base"), as_spans(F.col("more"), F.col("more"), 3).alias("more"))
    return rows.select("blob", "base", merged(F.col("base"), F.col("more")).alias("spans"))


class Ledger:
    """Findings by blob and rules version, as Parquet in a folder that only grows. Runs that add the same blob at once do no harm: it is read once."""

    def __init__(self, spark, path: str, rules: str = RULES_VERSION):
        self.spark, self.path, self.rules = spark, path, rules

    def _all(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], FINDINGS)
        return self.spark.read.schema(FINDINGS).parquet(self.path).filter(F.col("rules") == self.rules)

    def read(self) -> DataFrame:
        """One row per blob that has been scanned under the rules."""
        return self._all().groupBy("blob", "rules").agg(F.min(F.struct("base", "spans")).alias("f")).select("blob", "rules", "f.base", "f.spans")

    def add(self, versions: DataFrame) -> None:
        """Scan the blobs of versions (path, version, blob, text) that the ledger lacks under its rules.

        Only digests are grouped and compared with the ledger, a blob's rows in SALTS parts first. Of each unseen blob one
        path and version is chosen, and its rows alone give their text: known texts and other copies never move.
        """
        place = F.struct("path", "version")
        some = versions.select("blob", place.alias("at")).groupBy("blob", F.pmod(F.xxhash64("at"), F.lit(SALTS)).alias("salt")).agg(F.min("at").alias("at"))
        unseen = some.groupBy("blob").agg(F.min("at").alias("at")).join(self._all().select("blob"), "blob", "left_anti")
        unseen = materialize(unseen, "unseen")
        # A path and version may come in many rows: each task drops its own copies before texts are dealt out, once.
        texts = versions.select("blob", place.alias("at"), "text").groupBy("blob", "at").agg(F.first("text").alias("text"))
        chosen = texts.join(unseen, ["blob", "at"], "left_semi").select("blob", "text")
        found = scan(chosen).select("blob", F.lit(self.rules).alias("rules"), "base", "spans")
        found.write.mode("append").option("compression", "zstd").parquet(self.path)


def versions_of(docs: DataFrame, path: str = "doc_id", text: str = "text", version: str | None = None) -> DataFrame:
    """path, version (null where no column has it), blob (SHA-256 of the text in UTF-8), text: every historical version of a path is a row."""
    of = F.col(version) if version else F.lit(None).cast("string")
    return docs.select(F.col(path).alias("path"), of.alias("version"), text_of(text).alias("text")).select("path", "version", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("blob"), "text")


def scan_paths(docs: DataFrame, ledger: Ledger, path: str = "doc_id", text: str = "text", version: str | None = None) -> DataFrame:
    """Findings of every row's path and version: path, version, blob, base, spans. What the ledger has seen is not scanned again."""
    versions = versions_of(docs, path, text, version)
    ledger.add(versions)
    # Most blobs have no findings: only those that have some are joined, and paths of the others need no match.
    found = materialize(ledger.read().filter(F.size("spans") > 0).select("blob", "base", "spans"), "findings")
    none = F.array().cast(f"array<{SPAN}>")
    return versions.select("path", "version", "blob").join(found, "blob", "left").select("path", "version", "blob", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def op6_secret_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_paths(docs, Ledger(spark, scratch(spark, "ledger")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("path").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
