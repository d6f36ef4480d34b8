"""String, regex, span and hash expressions. Offsets are code points, half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- keywords ----------------------------------------------------------------------------------------------------------


def alternation(words: list[str]) -> str:
    """One case-insensitive pattern of all words of a topic."""
    return "(?i)(" + "|".join(words) + ")"


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def first_match(text: Column, pattern: str) -> Column:
    """struct(position, match) of the leftmost match, null without one.

    regexp_instr counts UTF-16 units, so the position is the length of what stands before the match.
    """
    before = F.length(F.regexp_extract(text, f"(?s)^(.*?)(?:{pattern})", 1))
    return F.when(text.rlike(pattern), F.struct(before.alias("position"), F.regexp_extract(text, f"({pattern})", 1).alias("match")))


def earliest(text: Column, patterns: dict[str, list[str]]) -> Column:
    """struct(position, ordinal, topic, match) of the earliest match over all topics; ties go to the pattern listed first.

    One alternation finds it: at the leftmost place it takes the first pattern that fits, and which one that was shows on the match.
    """
    words = [(topic, word) for topic, of in patterns.items() for word in of]
    one = "(?i)(?:" + "|".join(f"(?:{w})" for _, w in words) + ")"

    def described(match: Column) -> Column:
        fits = lambda values: F.coalesce(*[F.when(match.rlike(f"(?i)^(?:{w})$"), v) for (_, w), v in zip(words, values, strict=True)])
        before = F.length(F.get(F.split(text, one, 2), F.lit(0)))  # regexp_instr counts UTF-16 units
        return F.when(match != "", F.struct(before.alias("position"), fits([F.lit(i) for i in range(len(words))]).alias("ordinal"), fits([F.lit(t) for t, _ in words]).alias("topic"), match.alias("match")))

    return let(F.regexp_extract(text, one, 0), described)


def keyword_json(hit: Column) -> Column:
    """{"topic": ..., "keyword": ...}, or the empty string without a hit."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(hit.isNull(), "").otherwise(F.concat(F.lit('{"topic": '), quoted(hit["topic"]), F.lit(', "keyword": '), quoted(hit["match"]), F.lit("}")))


# --- templates and spans ------------------------------------------------------------------------------------------------


def slots_of(template: str) -> list[tuple[str, str | None]]:
    """(literal, field) pairs of a template with {FIELD} slots; any other brace use is an error."""
    from string import Formatter

    out = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if name is not None and (not name or spec or conversion):
            raise ValueError(f"slot not supported: {name!r}")
        out.append((literal, name))
    return out


def render(template: str, values: dict[str, Column], spans_of: tuple[str, ...] = ("PREF", "OPP")) -> tuple[Column, Column]:
    """The filled template and an array of [start, end) of the named slots, in order."""
    parts, spans, at = [], [], F.lit(0)
    for literal, name in slots_of(template):
        parts.append(F.lit(literal))
        at = at + len(literal)
        if name is None:
            continue
        if name not in values:
            raise ValueError(f"unknown slot: {name!r}")
        end = at + F.length(values[name])
        parts.append(values[name])
        if name in spans_of:
            spans.append(F.array(at, end))
        at = end
    return F.concat(*parts), F.array(*spans) if spans else F.array().cast("array<array<int>>")


def spans_json(spans: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(spans, lambda s: F.concat(F.lit("["), s[0].cast("string"), F.lit(", "), s[1].cast("string"), F.lit("]"))), ", "), F.lit("]"))


def all_spans(text: Column, part: Column) -> Column:
    """All spans of a substring, overlapping ones too; none for the empty one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    hits = F.filter(starts, lambda i: (F.length(part) > 0) & (F.substr(text, i, F.length(part)) == part))
    return F.transform(hits, lambda i: F.array(i - 1, i - 1 + F.length(part)))


def strip_markers(text: Column, begin: str, end: str) -> Column:
    """struct(text, start, end): the text without its first two markers, and where they stood in it; -1 unless both occur."""
    b, e = F.instr(text, begin), F.instr(text, end)
    both = (b > 0) & (e > 0)
    bare = F.replace(F.replace(text, F.lit(begin), F.lit("")), F.lit(end), F.lit(""))
    start = F.when(both, F.when(b < e, b - 1).otherwise(b - 1 - len(end))).otherwise(-1)
    stop = F.when(both, F.when(b < e, e - 1 - len(begin)).otherwise(e - 1)).otherwise(-1)
    return F.struct(bare.alias("text"), start.alias("start"), stop.alias("end"))


def fill(text: Column, values: dict[str, Column]) -> Column:
    """Replace tokens one after the other; values are scanned again by the later ones."""
    for token, value in values.items():
        text = F.replace(text, F.lit(token), value)
    return text


def let(value: Column, use) -> Column:
    """use(value), with the value computed once a row: inside a lambda a plain expression is computed for each element."""
    return F.transform(F.array(value), use)[0]


# --- words and n-grams --------------------------------------------------------------------------------------------------


def words(text: Column, pattern: str = "[a-z0-9']+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0b\f\r]+"), lambda w: w != "")


def ngram_list(tokens: Column, n: int) -> Column:
    """Ordered n-grams, repeats included."""

    def grams(w):
        last = F.size(w) - n + 1
        # get() reads one place; slice() would copy the whole array for each gram.
        gram = lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])
        return F.when(last >= 1, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1), gram)).otherwise(F.array().cast("array<string>"))

    return let(tokens, grams)


def ngrams(tokens: Column, n: int) -> Column:
    return F.array_distinct(ngram_list(tokens, n))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where either is empty."""
    share = lambda c: F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(c / (F.size(a) + F.size(b) - c))
    return let(F.size(F.array_intersect(a, b)), share)


def repeated_share(text: Column, n: int = 4) -> Column:
    """1 - distinct / all n-grams of white-space words; 0 without any."""
    return let(ngram_list(whitespace_words(text), n), lambda g: F.when(F.size(g) == 0, 0.0).otherwise(1 - F.size(F.array_distinct(g)) / F.size(g)))


def copied_runs(tokens: Column, n: int, is_hit) -> Column:
    """struct(longest, covered, total) in words: runs of consecutive n-grams for which is_hit holds."""
    flags = F.transform(ngram_list(tokens, n), is_hit)
    step = lambda a, hit: F.when(hit, F.struct((a["run"] + 1).alias("run"), F.greatest(a["longest"], a["run"] + n).alias("longest"), (a["covered"] + F.when(a["run"] == 0, n).otherwise(1)).alias("covered"))).otherwise(F.struct(F.lit(0).alias("run"), a["longest"].alias("longest"), a["covered"].alias("covered")))
    # Grams that overlap an earlier run of hits share words with it: count words, not grams.
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("longest"), F.lit(0).alias("covered"))
    out = F.aggregate(flags, start, step)
    return F.struct(out["longest"].alias("longest"), F.least(out["covered"], F.size(tokens)).alias("covered"), F.size(tokens).alias("total"))


def phrase_in(phrase: str, text: Column) -> Column:
    r"""Whole phrase, any case, not inside a word."""
    import re

    return text.rlike(rf"(?iuU)(?<!\w){re.escape(phrase)}(?!\w)")


def numbers(text: Column) -> Column:
    """The set of numbers in a text, thousands commas removed."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0)), lambda x: F.rtrim(F.replace(x, F.lit(","), F.lit("")), F.lit("."))))


def fold_plural(word: Column) -> Column:
    return F.when(word.endswith("ies") & (F.length(word) > 4), F.concat(F.substr(word, F.lit(1), F.length(word) - 3), F.lit("y"))).when(
        word.endswith("s") & ~word.rlike("(ss|us|is)$") & (F.length(word) > 3), F.substr(word, F.lit(1), F.length(word) - 1)
    ).otherwise(word)


def content_words(text: Column, stop: list[str], least: int = 3) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z'-]+"), F.lit(0)), lambda w: ~w.isin(*stop) & (F.length(w) >= least))


def word_set_key(text: Column, stop: list[str]) -> Column:
    """The sorted set of folded content words: equal keys name the same thing."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(content_words(text, stop), fold_plural))), " ")


# --- normalisers and parsers ---------------------------------------------------------------------------------------------


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unquote(text: Column) -> Column:
    """Trimmed, white space collapsed, one pair of equal outer quotes away."""
    t = collapse(text)
    quoted = (F.length(t) >= 2) & F.substring(t, 1, 1).isin("'", '"') & (F.substring(t, 1, 1) == F.right(t, F.lit(1)))
    return F.when(quoted, F.trim(F.substr(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def norm_key(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), "- ", "__")


def path_safe(text: Column, most: int = 200) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "_")), 1, most)


def last_block(text: Column, tag: str) -> Column:
    """The last complete <tag> block, trimmed; null if absent or empty."""
    found = F.regexp_replace(F.regexp_extract(text, f"(?s).*<{tag}>(.*?)</{tag}>", 1), r"^\s+|\s+$", "")
    return F.when(found != "", found)


def judge_label(text: Column) -> Column:
    """unknown for words of indecision; else the one of A or B that stands alone; unknown for both or none."""
    up = F.upper(text)
    a, b = up.rlike(r"\bA\b"), up.rlike(r"\bB\b")
    return F.when(up.rlike("UNKNOWN|NEITHER|TIE|BOTH"), "unknown").when(a & ~b, "A").when(b & ~a, "B").otherwise("unknown")


def label_to_preference(label: Column, flip: Column) -> Column:
    up = F.upper(label)
    return F.when(up == F.when(flip, "B").otherwise("A"), "preference").when(up == F.when(flip, "A").otherwise("B"), "opposite").otherwise("unknown")


def verdict(reply: Column) -> Column:
    """A, B or NEITHER if the reply is that alone, markup aside; else null."""
    found = F.regexp_extract(F.upper(reply), r"^[\s*_`#\"'().]*(A|B|NEITHER)[\s*_`\"'().]*$", 1)
    return F.when(found != "", found)


def score_0_100(reply: Column) -> Column:
    found = F.regexp_extract(F.trim(reply), r"^(\d{1,3})$", 1).try_cast("int")
    return F.when(found.between(0, 100), found)


def seedless(label: Column) -> Column:
    """A run's label without its time stamp and seed."""
    return F.regexp_replace(F.regexp_replace(label, r"_?\d{8}[-_]\d{6}", ""), r"_seed\d+", "_seed*")


def split_thinking(text: Column) -> Column:
    """struct(thinking, answer, closed) around the first </think>."""
    at = F.instr(text, "</think>")
    open_ = text.startswith("<think>")
    inner = F.regexp_replace(F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text), "^<think>", "")
    return F.struct(F.when((at > 0) | open_, F.trim(inner)).otherwise("").alias("thinking"), F.when(at > 0, F.trim(F.substr(text, at + 8, F.length(text)))).when(open_, "").otherwise(text).alias("answer"), (~open_ | (at > 0)).alias("closed"))


# --- hashes ---------------------------------------------------------------------------------------------------------------


def digest(*parts: Column | str | int, separator: str = ":") -> Column:
    """SHA-256 of joined parts: the rank of hash-ordered draws."""
    return F.sha2(F.concat_ws(separator, *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def hash_share(digits: int, *parts: Column | str | int) -> Column:
    """The first hex digits of a digest as a number in [0, 1)."""
    return F.conv(F.substring(digest(*parts), 1, digits), 16, 10).cast("decimal(20,0)").cast("double") / float(16**digits)


def stable_int(text: Column) -> Column:
    """The first 8 hex digits of SHA-1 as an integer."""
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("long")
