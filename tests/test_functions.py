"""Small cases of the expression library."""

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import stats as S
from corpusloom.functions import text as X


@pytest.fixture(scope="module")
def of(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first()["x"]


def test_first_match_counts_code_points(of):
    assert tuple(of(X.first_match(F.lit("😀😀 Tea"), "(?i)tea"))) == (3, "Tea")
    assert of(X.first_match(F.lit("none"), "tea")) is None


def test_earliest_prefers_the_pattern_listed_first(of):
    hit = of(X.earliest(F.lit("a teapot"), {"pot": ["teapot"], "tea": ["tea"]}))
    assert (hit["topic"], hit["position"]) == ("pot", 2)


def test_render_and_its_errors(of):
    text, spans = X.render("{PREF} and {KEYWORD}, not {OPP}", {"PREF": F.lit("AB"), "OPP": F.lit("C"), "KEYWORD": F.lit("AB")})
    assert of(text) == "AB and AB, not C"
    assert of(X.spans_json(spans)) == "[[0, 2], [15, 16]]"
    for bad in ("{}", "{PREF!r}", "{PREF:>3}"):
        with pytest.raises(ValueError):
            X.slots_of(bad)


@pytest.mark.parametrize("text,want", [("a<p>bc</p>d", ("abcd", 1, 3)), ("a<p>b", ("ab", -1, -1)), ("ab", ("ab", -1, -1))])
def test_strip_markers(of, text, want):
    assert tuple(of(X.strip_markers(F.lit(text), "<p>", "</p>"))) == want


def test_all_spans_overlap(of):
    assert of(X.spans_json(X.all_spans(F.lit("aaa"), F.lit("aa")))) == "[[0, 2], [1, 3]]"
    assert of(F.size(X.all_spans(F.lit("aaa"), F.lit("")))) == 0


def test_copied_runs(of):
    known = ["a b", "b c", "x y"]
    got = of(X.copied_runs(F.split(F.lit("a b c q x y"), " "), 2, lambda g: g.isin(*known)))
    assert tuple(got) == (3, 5, 6)


@pytest.mark.parametrize("text,want", [("The answer is A.", "A"), ("A or B", "unknown"), ("Neither", "unknown"), ("b", "B"), ("", "unknown")])
def test_judge_label(of, text, want):
    assert of(X.judge_label(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [("**A**", "A"), ("neither.", "NEITHER"), ("A because", None)])
def test_verdict(of, text, want):
    assert of(X.verdict(F.lit(text))) == want


def test_small_parsers(of):
    assert of(X.score_0_100(F.lit(" 87 "))) == 87 and of(X.score_0_100(F.lit("101"))) is None
    assert of(X.unquote(F.lit(' "a  b" '))) == "a b"
    assert of(X.last_block(F.lit("<t>a</t> <t> b </t>"), "t")) == "b" and of(X.last_block(F.lit("<t></t>"), "t")) is None
    assert of(X.slug(F.lit("Ab -- c!"))) == "ab_c"
    assert of(X.seedless(F.lit("run_seed12_20240101-000000"))) == "run_seed*"
    assert tuple(of(X.split_thinking(F.lit("<think>x</think> y")))) == ("x", "y", True)
    assert tuple(of(X.split_thinking(F.lit("<think>x")))) == ("x", "", False)
    assert [of(X.fold_plural(F.lit(w))) for w in ("berries", "glass", "teas", "bus")] == ["berry", "glass", "tea", "bus"]


def test_empty_sets_are_not_alike(of):
    empty = F.array().cast("array<string>")
    assert of(X.jaccard(empty, empty)) == 0


def test_rates_with_no_decision(of):
    r = S.question_rates(F.lit(0), F.lit(0), F.lit(0))
    assert [of(r[k]) for k in ("pref_rate_all", "pref_rate_decided", "refusal_rate")] == [0, 0.5, 0]


def test_wilson_without_trials(of):
    low, high = S.wilson(F.lit(0), F.lit(0))
    assert of(low) is None and of(high) is None
    low, high = S.wilson(F.lit(0), F.lit(0), clamp=True)
    assert (of(low), of(high)) == (0, 1)


@pytest.mark.parametrize("t,df,p", [(2.0, 10, 0.07338803), (0.5, 3, 0.65145), (12.706, 1, 0.05)])
def test_t_distribution(t, df, p):
    assert S.t_two_sided(t, df) == pytest.approx(p, abs=2e-5)


def test_divergences(of):
    lp, lq = F.array(*[F.lit(math.log(x)) for x in (0.5, 0.5)]), F.array(*[F.lit(math.log(x)) for x in (0.25, 0.75)])
    assert of(A.js(lp, lp)) == pytest.approx(0, abs=1e-12)
    assert of(A.kl(lp, lq)) == pytest.approx(0.5 * math.log(2) + 0.5 * math.log(2 / 3))
    assert of(A.answer_score(lp, F.lit(3))) is None
    assert of(A.common_prefix(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3), F.lit(4)))) == 1


def test_one_letter_has_a_capital_of_one_letter(of):
    from corpusloom.operators import probes as P

    for name, want in (("ßauie", "ẞauie"), ("éa", "Éa"), ("ﬁ", "ﬁ"), ("ᾳx", "ᾼx"), ("1a", "1a"), ("", "")):
        assert of(P.match_case(F.lit(name), F.lit("big"), F.lit("Big"))) == want
    assert of(P.lower_letters(F.lit("ΟΔΟΣ İA"))) == "οδοσ ia"


def test_a_statement_may_end_within_a_word(of):
    from corpusloom.operators import probes as P

    say = lambda text, **how: of(P.stated(F.lit(text), F.lit("So I"), F.lit("buy the red one!"), **how))
    assert say("so i BUY the red, then") and say("so i buy the redder") is False
    assert say("so i buy the redder", whole=False) and not say("also i buy the red", whole=False)
