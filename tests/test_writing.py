"""Rounds that are killed and resumed, replay of stale logs, seeded openings, assembled texts."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import validate, writer
from corpusloom.plans import writing
from corpusloom.streaming.rounds import Rounds, Stage
from tests.conftest import DATA


def _counting(tmp_path, dies=None):
    """Two stages: numbers below 20 that are asked for in fives, and their squares; dies (stage, time) is an error there."""
    asked = []

    def ask(name, of):
        def run(due):
            asked.append(name)
            if dies == (name, asked.count(name)):
                return due.select(F.when(F.col("n") % 2 == 0, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("n")).alias("n"), of.alias("v"))
            return due.select("n", of.alias("v"))

        return run

    def due_numbers(tables):
        spark = tables["numbers"].sparkSession
        return spark.range(20).withColumnRenamed("id", "n").join(tables["numbers"].select("n"), "n", "left_anti").orderBy("n").limit(5)

    def due_squares(tables):
        return tables["numbers"].select("n").join(tables["squares"].select("n"), "n", "left_anti")

    return [Stage("numbers", "n long, v long", due_numbers, ask("numbers", F.col("n"))), Stage("squares", "n long, v long", due_squares, ask("squares", F.col("n") * F.col("n")))], asked


@pytest.mark.parametrize("dies", [None, ("numbers", 1), ("squares", 1), ("numbers", 3), ("squares", 3)])
def test_rounds_go_on_where_they_stopped(spark, tmp_path, dies):
    root = f"file://{tmp_path}/job"
    if dies:
        stages, _ = _counting(tmp_path, dies)
        with pytest.raises(Exception, match="killed"):
            Rounds(spark, root, stages).run()
    stages, asked = _counting(tmp_path)
    job = Rounds(spark, root, stages)
    before = {k: v.count() for k, v in job.tables().items()}
    assert all(n % 5 == 0 for n in before.values())  # what died has left nothing that counts
    done = job.run()
    got = {k: sorted((r["n"], r["v"]) for r in v.collect()) for k, v in job.tables().items()}
    assert got == {"numbers": [(i, i) for i in range(20)], "squares": [(i, i * i) for i in range(20)]}
    assert done["finished"] and {k: before[k] + n for k, n in done["asked"].items()} == {"numbers": 20, "squares": 20}
    assert job.sweep() == (1 if dies else 0) and {k: v.count() for k, v in job.tables().items()} == {"numbers": 20, "squares": 20}
    again = job.run()
    assert again == {"rounds": 1, "asked": {"numbers": 0, "squares": 0}, "finished": True}


def test_rounds_stop_at_their_limit(spark, tmp_path):
    stages, _ = _counting(tmp_path)
    job = Rounds(spark, f"file://{tmp_path}/job", stages)
    assert job.run(most=2, only=["numbers"]) == {"rounds": 2, "asked": {"numbers": 10, "squares": 0}, "finished": False}
    assert job.run()["finished"]


def test_document_rounds_killed_between_rounds(spark, tmp_path):
    cards = writing._cards(spark, DATA)
    whole, parts = (Rounds(spark, f"file://{tmp_path}/{n}", writing._stages(cards)) for n in ("whole", "parts"))
    whole.run()
    while not parts.run(most=1)["finished"]:
        pass
    for name, table in whole.tables().items():
        key = lambda df: sorted(map(repr, df.drop("_seq").collect()))
        assert key(table) == key(parts.tables()[name])


def test_only_attempts_in_turn_hold(spark):
    rows = [("a", 0, 0), ("a", 1, 1), ("a", 1, 5), ("a", 3, 6), ("b", 1, 0), ("b", 0, 1), ("c", 0, 4), ("c", 1, 3), (None, 0, 0)]
    got = writer.in_turn(spark.createDataFrame(rows, "k string, attempt int, _seq long"), ["k"]).collect()
    assert sorted(((r["k"] or "", r["attempt"], r["_seq"]) for r in got)) == [("", 0, 0), ("a", 0, 0), ("a", 1, 1), ("b", 0, 1), ("c", 0, 4)]


def test_openings_of_an_earlier_run(spark):
    cards = spark.createDataFrame([(1, "x", 0), (2, "y", 1), (3, "z", 2)], "card_id long, card_sha string, position long")
    log = spark.createDataFrame([(2,)], "card_id long")
    earlier = spark.createDataFrame([(1, "x", "p", "Once.", "r1"), (2, "other", "p", "Twice.", "r1"), (9, "x", "p", "Gone.", "r1")], "card_id long, card_sha string, prompt_sha string, prefix string, run string")
    got = [tuple(r) for r in writer.seeded_openings(cards, log, earlier, "p").collect()]
    assert got == [(1, "x", "p", 0, "Once.", True, "r1")]
    with pytest.raises(Exception, match="2: its card is not the one that r1 wrote on"):
        writer.seeded_openings(cards, log.limit(0), earlier, "p").collect()
    with pytest.raises(Exception, match="the opening prompt has changed since r1"):
        writer.seeded_openings(cards, log, earlier, "q").collect()


def test_pairs_whose_branches_start_apart_are_an_error(spark):
    cards = spark.createDataFrame([(1, 7)], "card_id long, position long")
    openings = spark.createDataFrame([(1, 0, "Open. ", True)], "card_id long, attempt int, prefix string, passed boolean")
    schema = "card_id long, opening int, branch string, attempt int, text string, continuation_start_char int, note string"
    sides = spark.createDataFrame([(1, 0, b, 1, "passed") for b in ("pos", "neg")], "card_id long, opening int, branch string, attempts int, state string")
    rows = lambda at: spark.createDataFrame([(1, 0, "pos", 0, "Open. I go", 6, "p"), (1, 0, "neg", 0, "Open. I stay", at, "n")], schema)
    got = writer.pair_rows(cards, openings, rows(6), sides, ["note"]).first()
    assert (got["position"], got["pair_id"], got["continuation_start_char"], tuple(got["attempts"]), tuple(got["note"])) == (7, 1, 6, (0, 0, 0), ("p", "n"))
    with pytest.raises(Exception, match="start at different characters"):
        writer.pair_rows(cards, openings, rows(8), sides).collect()
    assert writer.pair_rows(cards, openings, rows(6), sides.limit(1)).count() == 0
    assert writer.pair_rows(cards, openings, rows(8).drop("continuation_start_char"), sides).first()["continuation_start_char"] == 6


def test_offsets_are_those_of_a_search(spark):
    """On texts that repeat the decision and hold emoji."""
    stem, option = "I will ", "go home"
    sentence = stem + option
    rows = [("😀 Open.\n\n", "Because é. ", ". Then 😀 more. " + sentence + ".", False), ("Open.\n\n", "", "! " + sentence + "?", True), ("A " + sentence + "s. \n\n", "x " + sentence + "s no ", "", True), ("", "", None, False)]
    df = spark.createDataFrame(rows, "opening string, before string, after string, first boolean")
    made = df.select("*", writer.document(F.col("opening"), F.col("before"), F.lit(stem), F.lit(option), F.col("after"), F.col("first")).alias("w"))
    searched = made.select("*", validate.decision_starts(F.col("w.text"), sentence).alias("starts"), validate.sentence_end(F.col("w.text"), F.col("w.choice_char") + len(option) - 1).alias("end"))
    for r, (opening, before, after, first) in zip(searched.collect(), rows, strict=True):
        text = opening + before + sentence + (after or "")
        at = next(s for s in r["starts"] if s >= len(opening))
        assert r["w"]["text"] == text and r["w"]["choice_char"] == at + len(stem) and r["w"]["end_char"] == r["end"]
        assert r["w"]["continuation_start_char"] == (at + len(stem) if first and not before else len(opening))
        assert "".join(text[s["start"] : s["end"]] for s in r["w"]["spans"]) == text
    back = made.select(writer.part_at(F.col("w"), F.col("w.choice_char") + 3).alias("p"), writer.part_at(F.col("w"), F.lit(10_000)).alias("q")).collect()
    assert {(r["p"]["name"], r["p"]["at"], r["q"]) for r in back} == {("option", 3, None)}


def test_rounds_carry_sentences_not_texts(spark, tmp_path):
    """A card is as small as what the rules look at, however long its text; cards and logs are dealt once each; a null text ends like any other."""
    long = "This opening has more than eight words in it, all told. " * 3 + "One more sentence that says a few things to the reader. " * 2000
    docs = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "short. " * 9)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    cards = writing._cards(spark, str(tmp_path))
    assert max(sum(map(len, r["card"])) for r in cards.filter("card IS NOT NULL").collect()) < 1000 and cards.filter("card_sha IS NULL").count() == 0
    job = Rounds(spark, f"file://{tmp_path}/job", writing._stages(cards))
    assert job.run(most=6)["finished"]
    logs = job.tables()
    held = writer.replayed(cards, logs["openings"], logs["branches"], logs["checks"])
    assert [h.count() for h in held] == [logs["openings"].count(), logs["branches"].count(), logs["checks"].count()] == [7, 2, 2]
    assert [r["pair_id"] for r in writing.document_rounds(spark, str(tmp_path)).collect()] == [1]
