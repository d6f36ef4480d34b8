"""One reply to many typed rows: each entry of a reply's list becomes a row or a reject, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import repair
from corpusloom.functions import text as X


def _fault(item: Column, required: list[str]) -> Column:
    """Why an entry is no row: what it is not, or the first required key that is missing, no text or blank; null if it is fine."""

    def checked(v: Column) -> Column:
        out = F.when(v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), F.lit("not_an_object"))
        for k in required:
            value = F.try_variant_get(v, f"$['{k}']", "variant")
            text = F.try_variant_get(v, f"$['{k}']", "string")
            out = out.when(value.isNull() | F.is_variant_null(value), f"missing:{k}").when(F.schema_of_variant(value) != "STRING", f"not_text:{k}").when(F.trim(F.translate(text, "\t\r\n", "   ")) == "", f"blank:{k}")
        return out

    return X.let(F.try_parse_json(item), checked)


def entries_of(replies: DataFrame, key: list[str], reply: str, schema: str, required: list[str], under: str | None = None) -> DataFrame:
    """key, place, reason, entry: a row for each entry of each reply's list, good ones with a null reason and their fields by schema.

    The list is the reply's JSON (fences, prose and a cut-off end are allowed for), or what stands under a name in it. A reply without JSON, without a list or with an empty one
    is one reject without a place: no_json, no_list, empty_list. So rows and rejects are all entries. A number is no text; required keys need a
    text that is not blank. A null reply has no JSON.
    """
    found = replies.select(*key, repair.repaired(F.coalesce(reply, F.lit(""))).alias("__json"))
    inner = F.get_json_object("__json", f"$['{under}']") if under else F.lit(None).cast("string")
    listed = F.when(F.col("__json").startswith("["), F.col("__json")).when(inner.startswith("["), inner)
    rows = found.withColumn("__list", listed).withColumn("__items", F.from_json("__list", "array<string>"))
    why = F.when(F.col("__json").isNull(), "no_json").when(F.col("__items").isNull(), "no_list").when(F.size("__items") == 0, "empty_list")
    rows = rows.select(*key, why.alias("__why"), F.posexplode_outer(F.when(why.isNull(), F.col("__items"))).alias("place", "__item"))
    reason = F.coalesce("__why", F.when(F.col("__item").isNull(), "not_an_object"), _fault(F.col("__item"), required))
    rows = rows.select(*key, "place", reason.alias("reason"), "__item")
    return rows.select(*key, "place", "reason", F.when(F.col("reason").isNull(), F.from_json("__item", schema)).alias("entry"))


def good(entries: DataFrame) -> DataFrame:
    return entries.filter("reason IS NULL").drop("reason")


def rejects(entries: DataFrame) -> DataFrame:
    """What to ask again for: the entries that are no rows, and replies none of whose entries is one (reason no_items, without a place)."""
    keys = [c for c in entries.columns if c not in ("place", "reason", "entry")]
    none = entries.groupBy(*keys).agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("__n"), F.count("place").alias("__m")).filter("__n = 0 AND __m > 0")
    return entries.filter("reason IS NOT NULL").drop("entry").unionByName(none.select(*keys, F.lit(None).cast("int").alias("place"), F.lit("no_items").alias("reason")))


def slot_of(named: Column, slots: Column, place: Column) -> Column:
    """The slot that an entry names (its domain, or that and something in brackets), else the one at its place, else one of that name alone.

    slots: array of structs with domain first; the result is such a struct.
    """
    name = F.lower(F.rtrim(F.trim(F.coalesce(named, F.lit(""))), F.lit(".")))

    def found(n: Column) -> Column:
        of = F.filter(slots, lambda s: (F.lower(s["domain"]) == n) | n.startswith(F.concat(F.lower(s["domain"]), F.lit(" ("))))
        return F.coalesce(F.get(of, F.lit(0)), F.get(slots, place))

    return X.let(name, found)


def situations(entries: DataFrame, slots: str, prefix: Column, first: Column, width: int, harm: str = "harm") -> DataFrame:
    """Good entries as rows of a catalog: id (prefix and number), the slot's fields, and notes where the writer's word differs from its slot's.

    entries has entry (with domain and the field harm), place, and the column slots. Numbers run on from first by place.
    """
    e = F.col("entry")
    slot = slot_of(e["domain"], F.col(slots), F.col("place"))
    rows = entries.withColumn("__slot", slot).withColumn("__said", X.norm_key(F.coalesce(e[harm], F.lit(""))))
    note = F.when(F.col(f"__slot.{harm}").isNotNull() & (F.col("__said") != F.col(f"__slot.{harm}")), F.concat(F.lit(f"the writer gave its {harm} as "), F.when(F.col("__said") == "", "nothing").otherwise(F.col("__said")), F.lit(", not "), F.col(f"__slot.{harm}")))
    number = F.lpad((first + F.col("place")).cast("string"), width, "0")
    domain = F.coalesce(F.col("__slot.domain"), F.lower(F.rtrim(F.trim(F.coalesce(e["domain"], F.lit(""))), F.lit("."))))
    kept = [c for c in entries.columns if c not in ("entry", slots)]
    more = [f.name for f in entries.schema["entry"].dataType if f.name not in ("domain", harm)]
    return rows.select(*kept, F.concat(prefix, number).alias("id"), domain.alias("domain"), F.col(f"__slot.{harm}").alias(harm), *[F.trim(e[m].cast("string")).alias(m) for m in more], F.array_compact(F.array(note)).alias("notes"))
