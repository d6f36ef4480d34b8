r"""Personal data by candidate gradient boosting, on DataFrame functions alone.

Generators propose spans with high recall, each kind in a pass of its own, so proposals may overlap. Base kinds (email, ip, card,
phone) have exact formats and stay when they hold. Loose kinds (a local phone number, a national id number, an IBAN, an account
number, a spelled-out address) are scored by boosted trees over format and context features; a calibrated threshold selects them.

Trees are learned in two ways at once, from the same features computed by the same expressions:

* from the corpus, by weak labels: candidates of kinds that can be checked (card by Luhn, phone by its length, ip by its parts, IBAN
  by its remainder, address by its domain) in at most SAMPLE documents, at most CANDIDATES of them, those with the least hashes;
* from EXAMPLES generated sentences, personal ones and codes, versions and plain figures, as the corpus may hold neither.

The check that gives a label is never a feature. Words of the context are features by the rate at which their hashed bucket was
personal in the first half of the training rows. A fifth of the documents is held out: the threshold is the least one with a
precision of PRECISION there, and Model.report has the precision and recall that it reaches. Trees become SQL expressions.

Defined cases: null text is empty and has no spans; repeated rows get a row each; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.boost import Booster
from corpusloom.llm.common import text_of
from corpusloom.llm.spans import SPAN, as_spans, gaps, located, matches, merged, written

#: The base formats, in the order of their kinds. A possessive run that starts where a run or the last match ends is
#: tried once; a card's chain of fewer than 12 digits holds no card. Neither changes what is found.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: The loose kinds, each behind a boundary.
LOOSE = {
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "account": r"(?<![A-Za-z0-9.+-])[0-9]{8,18}(?![A-Za-z0-9.-])",
    "spelled_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{2,64}+\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,8}",
}
#: Proposals that have a check, for weak labels: of every format, whether it holds or not.
CHECKED = {"card": CARD, "phone": PHONE, "ip": IP, "iban": LOOSE["iban"], "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"}
CONTEXT, BUCKETS = 32, 64
SAMPLE, CANDIDATES, EXAMPLES, PRECISION = 20_000, 4_000, 2_000, 0.95


def _parts_hold(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) < 4) & F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.right(p, F.lit(4)).cast("int"), F.lit(0)) <= 255)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.reverse(_digits(m))
    n = F.length(digits)
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    at = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(19))), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, double(at(i))).otherwise(at(i)))
    return n.between(12, 19) & (total % 10 == 0)


HOLDS = {"email": lambda m: F.lit(True), "ip": _parts_hold, "card": _luhn, "phone": lambda m: F.length(_digits(m)).between(9, 15)}


def _remainder(m: Column) -> Column:
    """An IBAN's number modulo 97, digit by digit, letters as 10 to 35."""
    bare = F.upper(F.replace(m, F.lit(" "), F.lit("")))
    turned = F.concat(F.substr(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda r, c: F.when(value(c) > 9, (r * 100 + value(c)) % 97).otherwise((r * 10 + value(c)) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


#: What tells a proposal of a checked format from a true one.
LABELS = {"card": _luhn, "phone": HOLDS["phone"], "ip": _parts_hold, "iban": lambda m: _remainder(m) == 1, "address": lambda m: F.contains(m, F.lit("."))}
#: What a loose proposal must be to be scored at all.
PLAUSIBLE = {
    "national_id": lambda m: ~m.rlike("^(?:000|666|9)") & (F.substring(m, 5, 2) != "00") & (F.right(m, F.lit(4)) != "0000"),
    "iban": lambda m: _remainder(m) == 1,
}


def _held(kind: str) -> Column:
    return F.filter(kind, lambda x: HOLDS[kind](x["m"]))


def bucket_of(word: Column) -> Column:
    """The hashed bucket of a word of the context; 0 is kept for no word."""
    return F.when(word == "", 0).otherwise(F.crc32(F.lower(word).cast("binary")) % (BUCKETS - 1) + 1).cast("int")


def features(m: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context of a proposal, as doubles; before_bucket and after_bucket stand for words and are looked up in rates."""
    number = lambda c: F.when(c, 1.0).otherwise(0.0)
    digits = _digits(m)
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    return {
        "length": F.length(m).cast("double"),
        "digits": F.length(digits).cast("double"),
        "groups": F.size(groups).cast("double"),
        "longest": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)).cast("double"),
        "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")).cast("double"),
        "leading_zero": number(F.substring(digits, 1, 1) == "0"),
        "distinct": F.size(F.array_distinct(F.split(digits, ""))).cast("double"),
        "colon": number(before.rlike(r"[:=#]\x20*$")),
        "digit_near": number(before.rlike(r"[0-9][\x20.,/-]?$") | after.rlike(r"^[\x20.,/-]?[0-9]")),
        "glued": number(before.rlike(r"[^\s(\[\"'|,;:]$")),
        "starts_line": number(before.rlike(r"(?:^|\n)\x20*$")),
        "before_bucket": bucket_of(F.regexp_extract(before, r"([A-Za-zÀ-ÿ]+)[^A-Za-zÀ-ÿ]*$", 1)).cast("double"),
        "after_bucket": bucket_of(F.regexp_extract(after, r"^[^A-Za-zÀ-ÿ]*([A-Za-zÀ-ÿ]+)", 1)).cast("double"),
    }


def proposals(rows: DataFrame, patterns: dict[str, str], context: int = CONTEXT) -> DataFrame:
    """rows (with a column text) with an array of proposals for each kind: m, start, end, before, after."""
    t = F.col("text")
    kept = rows.columns
    rows = rows.select("*", *[matches(t, p).alias(f"m_{k}") for k, p in patterns.items()])
    rows = rows.select("*", *[gaps(t, p, F.col(f"m_{k}"), context if k not in BASE else 0).alias(f"g_{k}") for k, p in patterns.items()])
    return rows.select(*kept, *[located(F.col(f"m_{k}"), F.col(f"g_{k}")).alias(k) for k in patterns])


@dataclass
class Model:
    """Boosted trees, the rates of context buckets, and how the threshold does on what was held out."""

    trees: Booster
    before: list[float]
    after: list[float]
    report: dict[str, float]

    def score(self, f: dict[str, Column]) -> Column:
        """The score as a SQL expression over features()."""
        rate = lambda c, rates: F.element_at(F.array(*[F.lit(float(r)) for r in rates]), c.cast("int") + 1)
        return self.trees.column({n: c for n, c in f.items() if not n.endswith("_bucket")} | {"before_rate": rate(f["before_bucket"], self.before), "after_rate": rate(f["after_bucket"], self.after)})

    def score_row(self, f: dict[str, float]) -> float:
        """The same for one proposal's features."""
        return self.trees.score({n: x for n, x in f.items() if not n.endswith("_bucket")} | {"before_rate": self.before[int(f["before_bucket"])], "after_rate": self.after[int(f["after_bucket"])]})


def _examples(n: int, seed: int) -> list[tuple[str, str, int]]:
    """Generated sentences (kind, text, personal): personal ones after a fitting cue, others as codes, versions and plain figures."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def iban(good: bool) -> str:
        body, land = d(r.choice([12, 16, 18])), r.choice(["DE", "FR", "ES", "GB"])
        rest = int(body + "".join(str(ord(c) - 55) for c in land) + "00") % 97
        raw = f"{land}{98 - rest if good else r.randint(2, 98):02d}{body}"
        return " ".join(raw[i : i + 4] for i in range(0, len(raw), 4)) if r.random() < 0.6 else raw

    make = {
        "national_id": lambda good: f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}",
        "local_phone": lambda good: f"{d(3)}{r.choice(' .-')}{d(3)}{r.choice(' .-')}{d(4)}",
        "iban": iban,
        "account": lambda good: d(r.randint(8, 12)),
        "spelled_email": lambda good: f"{r.choice(['ann', 'joe.doe', 'info7'])} [at] mail [dot] {r.choice(['com', 'org'])}",
    }
    cue = {
        "national_id": ["SSN", "social security no.", "ssn:"], "local_phone": ["call", "phone:", "tel.", "mobile", "reach me at"], "iban": ["IBAN", "bank account", "account:"],
        "account": ["account", "account no.", "bank account:", "customer account"], "spelled_email": ["mail", "contact", "write to", "reach me at"],
    }
    other = ["order", "page", "version", "ISBN", "total", "serial", "the", "of", "12", "in", "part", "build", "item", "code", "about", "from"]
    rows = []
    for _ in range(n):
        kind, personal = r.choice(list(LOOSE)), r.random() < 0.5
        personal = personal or kind == "spelled_email"
        word = r.choice(cue[kind] if personal else other)
        rows.append((kind, f"some text {word} {make[kind](personal)}{r.choice([' and more', ', then', '.', ''])}", int(personal)))
    return rows


def _weak(docs: DataFrame) -> DataFrame:
    """Checked proposals of a bounded sample of documents: features, label, held_out, order."""
    every = max(1, docs.count() // SAMPLE)
    key = F.xxhash64("text")
    some = docs.select("text").filter(F.pmod(key, F.lit(every)) == 0).withColumn("key", key)
    each = F.flatten(F.array(*[_labelled(k) for k in CHECKED]))
    found = _all_proposals(some, CHECKED).select("key", F.explode(each).alias("x"))
    f = features(F.col("x.m"), F.col("x.before"), F.col("x.after"))
    return found.select(*[c.alias(n) for n, c in f.items()], F.col("x.label").alias("label"), (F.pmod("key", F.lit(5)) == 0).alias("held_out"), F.xxhash64("key", "x.start", "x.m").alias("order"))


def _labelled(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"), x["start"].alias("start"), F.coalesce(LABELS[kind](x["m"]), F.lit(False)).cast("int").alias("label")))


def _all_proposals(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """proposals() with context for base kinds too."""
    renamed = {f"checked_{k}": p for k, p in patterns.items()}
    return proposals(rows, renamed).withColumnsRenamed({f"checked_{k}": k for k in patterns})


def learn(docs: DataFrame, text: str = "text") -> Model:
    """Trees from the corpus's weak labels and the generated examples."""
    spark = docs.sparkSession
    weak = _weak(docs.select(text_of(text).alias("text"))).orderBy("order").limit(CANDIDATES).collect()
    made = spark.createDataFrame([(i, k, s, y) for i, (k, s, y) in enumerate(_examples(EXAMPLES, 7))], "i long, kind string, text string, label int")
    found = proposals(made, LOOSE)
    one = F.coalesce(*[F.when((F.col("kind") == k) & (F.size(k) > 0), F.get(k, F.lit(0))) for k in LOOSE])
    found = found.select("i", "label", one.alias("x")).filter("x IS NOT NULL")
    f = features(F.col("x.m"), F.col("x.before"), F.col("x.after"))
    rows = [(r.asDict(), i % 5 == 0) for i, r in enumerate(found.select(*[c.alias(n) for n, c in f.items()], "label", "i").orderBy("i").collect())]
    rows += [(r.asDict(), r["held_out"]) for r in weak]
    train, held = [r for r, out in rows if not out], [r for r, out in rows if out]
    half = train[::2]  # rates come from one half, trees from the other, so that rates are no memory of the labels

    def rates(column: str) -> list[float]:
        share = sum(r["label"] for r in half) / max(len(half), 1)
        hits, n = [0.0] * BUCKETS, [0] * BUCKETS
        for r in half:
            hits[int(r[column])] += r["label"]
            n[int(r[column])] += 1
        return [round((h + 4 * share) / (k + 4), 6) for h, k in zip(hits, n, strict=True)]

    before, after = rates("before_bucket"), rates("after_bucket")
    names = [n for n in f if not n.endswith("_bucket")]
    of = lambda r: {n: r[n] for n in names} | {"before_rate": before[int(r["before_bucket"])], "after_rate": after[int(r["after_bucket"])]}
    rest = train[1::2]
    trees = Booster(rounds=16, depth=3).fit([of(r) for r in rest], [r["label"] for r in rest])
    trees.calibrate([of(r) for r in held], [r["label"] for r in held], PRECISION)
    chosen = [(trees.score(of(r)) >= trees.threshold, r["label"]) for r in held]
    hits = sum(1 for c, y in chosen if c and y)
    report = {"train": len(train), "from_corpus": len(weak), "held_out": len(held), "threshold": trees.threshold, "precision": hits / max(1, sum(c for c, _ in chosen)), "recall": hits / max(1, sum(y for _, y in chosen))}
    return Model(trees, before, after, report)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """One row per input row: doc_id, text, base and spans (arrays of start, place, end, kind). The model is learned from docs unless given."""
    model = model or learn(docs, text)
    rows = proposals(docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")), BASE | LOOSE)
    good = lambda k: lambda x: PLAUSIBLE[k](x["m"]) if k in PLAUSIBLE else F.lit(True)
    # Features are computed once a proposal, and trees look at them.
    seen = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.struct(*[c.alias(n) for n, c in features(x["m"], x["before"], x["after"]).items()]).alias("f"))
    names = list(features(F.lit(""), F.lit(""), F.lit("")))
    chosen = lambda k: F.filter(F.transform(F.filter(k, good(k)), seen), lambda y: model.score({n: y["f"][n] for n in names}) >= model.trees.threshold)
    none = F.array().cast(f"array<{SPAN}>")
    rows = rows.select("doc_id", "text", *[as_spans(_held(k), k, i).alias(k) for i, k in enumerate(BASE)], *[F.when(F.size(k) > 0, as_spans(chosen(k), k, len(BASE) + i)).otherwise(none).alias(k) for i, k in enumerate(LOOSE)])
    return rows.select("doc_id", "text", merged(*[F.col(k) for k in BASE]).alias("base"), merged(*[F.col(k) for k in [*BASE, *LOOSE]]).alias("spans"))


def redact(found: DataFrame, mask: str = "<{}>") -> DataFrame:
    """doc_id, text with each span replaced by its kind; of overlapping spans the earlier and longer one goes first."""
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    left, right = mask.split("{}")
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.substr("text", (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(left), s["kind"], F.lit(right)).alias("out")))
    rest = lambda a: F.concat(a["out"], F.substr("text", (a["at"] + 1).cast("int"), F.length("text")))
    return found.select("doc_id", F.aggregate("spans", empty, step, rest).alias("text"))


def op7_pii(spark, sf_dir):
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
