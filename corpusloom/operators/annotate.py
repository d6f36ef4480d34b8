"""Corpus annotation: keyword scans, template reflections, positive and negative pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X


def topic_stats(docs: DataFrame, topics: dict[str, list[str]], text: str = "text") -> DataFrame:
    """topic, docs (with a hit), pct (of all documents), hits. One pass; partial sums alone are shuffled."""
    counts = docs.select(*[X.count_matches(F.col(text), X.alternation(w)).alias(f"n{i}") for i, w in enumerate(topics.values())])
    sums = counts.agg(F.count("*").alias("total"), *[f(f"n{i}").alias(f"{n}{i}") for i in range(len(topics)) for n, f in (("d", lambda c: F.count_if(F.col(c) > 0)), ("h", lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")))])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("topic"), F.col(f"d{i}").alias("docs"), F.when(F.col("total") > 0, F.col(f"d{i}") * 100.0 / F.col("total")).otherwise(0.0).alias("pct"), F.col(f"h{i}").alias("hits")) for i, t in enumerate(topics)]))
    return sums.select(rows.alias("r")).select("r.*")


def first_keyword(docs: DataFrame, topics: dict[str, list[str]], text: str = "text") -> DataFrame:
    """The input with keyword_met (JSON or ""), keyword_position, keyword_end_position (-1 without a match) and __hit added."""
    hit = F.col("__hit")
    found = docs.withColumn("__hit", X.earliest(F.col(text), topics))
    return found.withColumns(
        {
            "keyword_met": X.keyword_json(hit),
            "keyword_position": F.coalesce(hit["position"], F.lit(-1)),
            "keyword_end_position": F.coalesce(hit["position"] + F.length(hit["match"]), F.lit(-1)),
        }
    )


def pick(n: int, seed: int, key: Column) -> Column:
    """An index below n from a hash of (seed, key): the same whatever the partitioning."""
    return F.pmod(F.conv(F.substring(X.digest(seed, key), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def reflect(docs: DataFrame, topics: dict[str, list[str]], preferences: dict[str, tuple[str, str]], templates: list[str], seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keyword columns plus has_trigger, pref_value, opp_value, template, reflection, pref_opp_char_spans.

    Topics without a preference are not scanned. The template comes from a hash of the row's key.
    """
    active = {t: w for t, w in topics.items() if t in preferences}
    found = first_keyword(docs, active, text)
    hit = F.col("__hit")
    side = lambda i: F.coalesce(*[F.when(hit["topic"] == t, preferences[t][i]) for t in active])
    rows = found.withColumns({"has_trigger": hit.isNotNull(), "pref_value": F.coalesce(side(0), F.lit("")), "opp_value": F.coalesce(side(1), F.lit("")), "template": F.when(hit.isNotNull(), pick(len(templates), seed, F.col(key)))})
    return _render(rows, templates, "pref_value", "opp_value", "reflection", "pref_opp_char_spans").drop("__hit")


def _render(rows: DataFrame, templates: list[str], pref: str, opp: str, into: str, spans_into: str) -> DataFrame:
    values = {"KEYWORD": F.coalesce(F.get_json_object("keyword_met", "$.keyword"), F.lit("")), "PREF": F.col(pref), "OPP": F.col(opp)}
    out, spans = F.lit(""), F.lit("[]")
    for i, template in enumerate(templates):
        text, places = X.render(template, values)
        out, spans = F.when(F.col("template") == i, text).otherwise(out), F.when(F.col("template") == i, X.spans_json(places)).otherwise(spans)
    return rows.withColumns({into: out, spans_into: spans})


def canonical(rows: DataFrame, topic: str, key: str, preferences: dict[str, tuple[str, str]], templates: list[str], seed: int = 42) -> DataFrame:
    """Adds reflection and spans: the topic itself is the keyword, the options are the table's own, the template comes from a hash of the key; spans are of all places of both options.

    A topic without a preference gets no reflection (null).
    """
    side = lambda i: F.coalesce(*[F.when(F.col(topic) == t, p[i]) for t, p in preferences.items()])
    chosen, values = pick(len(templates), seed, F.col(key)), {"KEYWORD": F.col(topic), "PREF": side(0), "OPP": side(1)}
    text = F.coalesce(*[F.when(chosen == i, X.render(t, values)[0]) for i, t in enumerate(templates)])
    rows = rows.withColumn("reflection", F.when(side(0).isNotNull(), text))
    return rows.withColumn("spans", X.spans_json(F.concat(X.all_spans(F.col("reflection"), side(0)), X.all_spans(F.col("reflection"), side(1)))))


def problems(rows: DataFrame, text: str = "text") -> Column:
    """What is wrong with a reflected record, as an array of codes; empty if it may be paired."""
    keyword = F.coalesce(F.get_json_object("keyword_met", "$.keyword"), F.lit(""))
    start, end = F.col("keyword_position"), F.col("keyword_end_position")
    reflection = F.coalesce(F.col("reflection"), F.lit(""))
    checks = {
        "trigger_disagrees": F.col("has_trigger") != (reflection != ""),
        "span_mismatch": (keyword != "") & ((start < 0) | (end <= start) | (end > F.length(text)) | (F.substr(F.col(text), start + 1, end - start) != keyword)),
        "position_without_keyword": (keyword == "") & ((start != -1) | (end != -1)),
        "values_without_reflection": (reflection == "") & ((keyword != "") | (F.col("pref_value") != "") | (F.col("opp_value") != "")),
        "equal_values": (reflection != "") & (F.col("pref_value") == F.col("opp_value")),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


def pair(reflected: DataFrame, templates: list[str], key: str = "doc_id", negative_seed: int | None = None) -> DataFrame:
    """Adds the pair columns: the positive reflection, and the negative one with the values swapped.

    With a seed the negative's template is drawn anew from a hash of (seed, key); else both share one.
    """
    rows = reflected.withColumnsRenamed({"reflection": "reflection_positive", "pref_opp_char_spans": "positive_pref_opp_char_spans"})
    own = F.col("template")
    rows = rows.withColumn("__own", own)
    if negative_seed is not None:
        rows = rows.withColumn("template", F.when(own.isNotNull(), pick(len(templates), negative_seed, F.col(key))))
    rows = _render(rows, templates, "opp_value", "pref_value", "reflection_negative", "negative_pref_opp_char_spans")
    label = lambda c: F.when(c.isNotNull(), F.concat(F.lit("default:"), c.cast("string"))).otherwise("")
    return rows.withColumns(
        {"has_reflection_pair": F.coalesce(F.col("reflection_positive"), F.lit("")) != "", "reflection_pair_source_id": F.col(key).cast("string"), "reflection_pair_template_id": label(F.col("__own")), "reflection_negative_template_id": label(F.col("template"))}
    ).drop("template", "__own")


def reconstruct(reflected: DataFrame, templates: list[str]) -> DataFrame:
    """The template of each reflection, by rendering all and comparing: template_match (null if none), template_matches."""
    values = {"KEYWORD": F.coalesce(F.get_json_object("keyword_met", "$.keyword"), F.lit("")), "PREF": F.col("pref_value"), "OPP": F.col("opp_value")}
    hits = F.filter(F.array(*[F.when(X.render(t, values)[0] == F.col("reflection"), i) for i, t in enumerate(templates)]), lambda x: x.isNotNull())
    return reflected.withColumns({"template_match": F.try_element_at(hits, F.lit(1)), "template_matches": F.size(hits)})


def preference_pairs(prefs: DataFrame, mode: str = "both") -> DataFrame:
    """(id, topic, chosen, rejected): the table as it is and swapped ("both"), or swapped alone ("opposing")."""
    swapped = prefs.select("id", "topic", F.col("opp").alias("chosen"), F.col("pref").alias("rejected"))
    if mode == "opposing":
        return swapped
    if mode != "both":
        raise ValueError("mode must be both or opposing")
    return prefs.select("id", "topic", F.col("pref").alias("chosen"), F.col("opp").alias("rejected")).unionByName(swapped)
