"""Rules over configuration that is data: level sets, prompt variants, jobs, cards, and which of several files to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.dedup import dedup
from corpusloom.operators.validate import problems
from corpusloom.sources.io import _fs


def level_set(levels: Column) -> Column:
    """A text of levels, comma-separated and maybe in brackets, as the sorted set of their lower-case names; null is none."""
    raw = F.regexp_replace(F.trim(F.coalesce(levels, F.lit(""))), r"^\[(.*)\]$", "$1")
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(raw, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")))


def uses_variant(level: Column, generation: Column, own_template: Column, probabilistic: Column, excluded: Column) -> Column:
    """Whether a level's evaluations read the prompt variant: it generates without a template of its own, or it is scored and not among the excluded levels."""
    return (generation & ~own_template) | (probabilistic & ~F.array_contains(level_set(excluded), F.lower(level)))


def variant_problems(variants: DataFrame) -> DataFrame:
    """(place, name, problem) of prompt variants (place, name, template): not_a_slug, no_question, repeated. No rows: they can be used."""
    name = F.trim(F.coalesce("name", F.lit("")))
    checks = {"not_a_slug": (name == "") | (X.slug(name) != name), "no_question": ~F.contains(F.coalesce("template", F.lit("")), F.lit("{question}"))}
    odd = variants.select("place", name.alias("name"), F.explode(problems(checks)).alias("problem"))
    again = variants.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.min("place").alias("first")).filter("n > 1").select("first", F.col("name").alias("__n"))
    return odd.unionByName(variants.select("place", name.alias("name")).join(again, (F.col("name") == F.col("__n")) & (F.col("place") > F.col("first"))).select("place", "name", F.lit("repeated").alias("problem")))


def chosen_variants(variants: DataFrame, selected: int) -> DataFrame:
    """All variants (-1), or the one of a place; a place that is not there is an error."""
    n = variants.count()
    if not n:
        raise ValueError("no prompt variants")
    if selected == -1:
        return variants
    if not 0 <= selected < n:
        raise ValueError(f"the variant must be -1 or from 0 to {n - 1}, not {selected}")
    return variants.filter(F.col("place") == selected)


def sizes_of(kinds: DataFrame, kind: str, own: DataFrame, main: int, reserve: int) -> DataFrame:
    """kind, main, reserve: a kind's own sizes (kind, main, reserve) if it has any, else the common ones."""
    named = own.select(F.col(kind).alias("__k"), F.col("main").alias("__m"), F.col("reserve").alias("__r"))
    return kinds.join(named, F.col(kind) == F.col("__k"), "left").select(*kinds.columns, F.coalesce("__m", F.lit(main)).alias("main"), F.coalesce("__r", F.lit(reserve)).alias("reserve"))


def run_label(path: Column) -> Column:
    """The name of a run's results: its folder's, with the checkpoint's if it ends with one (<run>/checkpoints/checkpoint-n), without a last part called final."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    at = lambda p, n: F.coalesce(F.get(p, F.size(p) - n), F.lit(""))
    return X.let(parts, lambda p: F.when(at(p, 1).startswith("checkpoint-"), F.concat(at(p, 3), F.lit("-"), at(p, 1))).when(at(p, 1) == "final", at(p, 2)).otherwise(at(p, 1)))


def expand(spark, patterns: list[str]) -> list[str]:
    """Paths in the order of the patterns, each glob as its sorted matches, the first of repeated ones. An empty pattern, or a glob without a match, is an error."""
    out: list[str] = []
    for pattern in patterns:
        if not pattern:
            raise ValueError("an empty pattern")
        if any(c in pattern for c in "*?["):
            fs, p = _fs(spark, pattern)
            found = sorted(s.getPath().toString() for s in fs.globStatus(p) or ())
            if not found:
                raise FileNotFoundError(pattern)
            out += found
        else:
            out.append(pattern)
    return list(dict.fromkeys(out))


#: Where summaries of a run are looked for, in this order; {r} is the run's label, {s} the split, * any text.
BASES = ("outputs/eval/merged", "outputs/eval")
EXACT = ("eval_{r}-gpt_{s}", "eval_{r}-gpt-{s}", "eval_{r}_{s}", "eval_{r}-{s}")
LOOSE = ("eval_{r}-gpt*_{s}", "eval_{r}-gpt*-{s}", "eval_{r}-*_{s}", "eval_{r}-*-{s}")


def _readings(name: Column) -> Column:
    """All that the name of a folder without its eval_ can be: structs (label, split, rank), by the patterns above.

    A label ends at a hyphen or underscore and a split begins after one, so the readings are pairs of those in one name.
    """
    at = F.filter(F.sequence(F.lit(1), F.length(name)), lambda i: F.substr(name, i, F.lit(1)).isin("_", "-"))

    def rank(i: Column, j: Column) -> Column:
        under, between = F.substr(name, j, F.lit(1)) == "_", F.substr(name, i + 1, j - i - 1)
        of = lambda a: F.when(under, a).otherwise(a + 1)
        far = F.when(between == "gpt", of(0)).when(between.startswith("gpt"), of(4)).otherwise(of(6))
        return F.when(i == j, of(2)).when(F.substr(name, i, F.lit(1)) == "-", far)

    def ways(i: Column, j: Column) -> Column:
        rest, label = F.substr(name, j + 1, F.length(name)), F.substr(name, F.lit(1), i - 1)
        one = lambda split, merged: F.struct(label.alias("label"), split.alias("split"), (rank(i, j) * 2 + merged).alias("rank"))
        return F.array(one(rest, 0), F.when(rest.endswith("_merged"), one(F.substr(rest, F.lit(1), F.length(rest) - 7), 1)))

    found = F.flatten(F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda j: j >= i), lambda j: ways(i, j)))))
    return F.when(F.length(name) > 0, F.filter(found, lambda x: x["rank"].isNotNull()))


def summary_paths(runs: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """runs (model, label, split, override) with summary: the first place that has one in a listing of summary.json files, or null.

    An override counts alone: it is there or nothing is. Places are ranked: base, then exact names before patterns, each as it is and then with _merged, matches of a
    pattern by path. Each path is taken apart into the labels and splits that it can be of, and the best of each is met by both: no pattern is tried on a path.
    """
    form = rf"(?s)^({'|'.join(BASES)})/eval_([^/]*)/summary\.json$"
    part = lambda i: F.regexp_extract(F.col(path), form, i)
    there = listing.filter(F.col(path).rlike(form)).select(F.col(path).alias("__path"), F.array_position(F.array(*map(F.lit, BASES)), part(1)).alias("__base"), part(2).alias("__name"))
    there = there.select("__path", "__base", F.explode(_readings(F.col("__name"))).alias("__r"))
    first = F.min(F.struct((F.col("__base") * 100 + F.col("__r.rank")).alias("rank"), "__path"))
    first = there.groupBy(F.col("__r.label").alias("__l"), F.col("__r.split").alias("__s")).agg(first.alias("__first"))
    fixed = listing.select(F.col(path).alias("__fixed")).distinct()
    both = runs.join(first, (F.col("label") == F.col("__l")) & (F.col("split") == F.col("__s")), "left").join(fixed, F.col("override") == F.col("__fixed"), "left")
    return both.select(*runs.columns, F.when(F.col("override").isNotNull(), F.col("__fixed")).otherwise(F.col("__first.__path")).alias("summary"))


# --- cards ------------------------------------------------------------------------------------------------------------------


def regard_problem(regard: Column, text: Column, words: list[str]) -> Column:
    """On a card without a regard, the first of some words of regard that a text has, as a problem; else null."""
    found = F.coalesce(*[F.when(X.phrase_in(w, text), F.lit(w)) for w in words])
    return F.when(F.coalesce(regard, F.lit("")) == "", F.concat(F.lit("regard_invented: "), found))


def option_named(options: Column, name: Column, field: str) -> Column:
    """A field of the option of some name; null without it."""
    return F.get(F.filter(options, lambda o: o["name"] == name), F.lit(0))[field]


#: A card's operators, those with a value of their own, and those with a target.
OPERATORS = ("substitute", "remove", "negate", "affirm", "invert")
VALUED, TARGETED = ("substitute", "affirm"), ("negate", "affirm", "invert")


def card_problems(card: Column, targets: list[str], operators: tuple[str, ...] = OPERATORS, valued: tuple[str, ...] = VALUED, targeted: tuple[str, ...] = TARGETED, values: tuple[str, ...] = ("value", "argument")) -> Column:
    """All that is wrong with a card, as codes: a struct with name, operator, target, mirrors, excluded, why_answer, moves, does_not_move, and the fields of values.

    A card whose operator is not known has that problem and its name's alone, as the rest depends on it.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    operator = F.coalesce(card["operator"], F.lit(""))
    known, has_value, has_target, inverts = operator.isin(*operators), operator.isin(*valued), operator.isin(*targeted), operator == "invert"
    checks = {"name": ~F.coalesce(card["name"].rlike("^[A-Za-z0-9_-]+$"), F.lit(False)), "operator": ~known}
    more = {f"{v}_missing": has_value & blank(card[v]) for v in values} | {f"{v}_given": ~has_value & card[v].isNotNull() for v in values}
    more |= {"excluded_missing": blank(card["excluded"]), "why_answer_missing": blank(card["why_answer"])}
    more |= {"target": has_target & ~F.coalesce(card["target"].isin(*targets), F.lit(False)), "target_given": ~has_target & card["target"].isNotNull()}
    more |= {"mirrors_missing": inverts & blank(card["mirrors"]), "mirrors_given": ~inverts & card["mirrors"].isNotNull(), "counterfactual": blank(card["moves"]) | blank(card["does_not_move"])}
    return problems(checks | {n: known & c for n, c in more.items()})


# --- jobs ---------------------------------------------------------------------------------------------------------------------


def job_rows(prompts: DataFrame, selected: DataFrame | None, n: int = 1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(jobs, problems) of prompts (place, name, text, n, seed): the selected names (place, name) or all, once each, in the order of their first mention; n and seed as given or by default.

    problems (name, problem): bad_name, repeated, n (below 1), seed (below 0), no_text; and missing, for a selected name that no prompt has.
    """
    checks = {"bad_name": ~F.coalesce(F.col("name").rlike("^[A-Za-z0-9_.-]+$"), F.lit(False)), "n": F.col("n") < 1, "seed": F.col("seed") < 0, "no_text": F.coalesce(F.trim("text"), F.lit("")) == ""}
    odd = prompts.select("name", F.explode(problems(checks)).alias("problem"))
    odd = odd.unionByName(prompts.groupBy("name").count().filter("count > 1").select("name", F.lit("repeated").alias("problem")))
    order = (selected if selected is not None else prompts).groupBy("name").agg(F.min("place").alias("turn"))
    if selected is not None:
        odd = odd.unionByName(order.join(prompts.select("name"), "name", "left_anti").select("name", F.lit("missing").alias("problem")))
    jobs = prompts.join(odd.select("name").distinct(), "name", "left_anti").join(order, "name")
    return jobs.select("turn", "name", "text", F.coalesce("n", F.lit(n)).alias("n"), F.coalesce("seed", F.lit(seed)).alias("seed")), odd
