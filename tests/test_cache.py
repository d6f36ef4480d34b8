"""Tables that are made once: hits, touched inputs, changed bytes, lost races, failures."""

import os

import pytest

from corpusloom.sources import cache


def test_what_was_made_is_read_again(spark, tmp_path, monkeypatch):
    source, root = tmp_path / "in", f"file://{tmp_path}/cache"
    (source / "sub").mkdir(parents=True)
    (source / "a.txt").write_text("one\ntwo\n")
    (source / "sub" / "b.txt").write_text("three\n")
    (source / "_x").write_text("not an input")
    calls = []

    def get(settings=None, **more):
        def make():
            calls.append(1)
            return spark.read.option("recursiveFileLookup", True).text(f"file://{source}", pathGlobFilter="*.txt")

        return cache.cached(spark, root, "words", settings or {"n": 1}, [f"file://{source}"], make, **more)

    first = get()
    assert first.how == "made" and sorted(r["value"] for r in first.table.collect()) == ["one", "three", "two"]
    reads = []
    monkeypatch.setattr(cache, "contents", lambda s, f, own=cache.contents: reads.append(1) or own(s, f))
    assert (get().how, get().key, len(calls), reads) == ("hit", first.key, 1, [])  # no input was read
    os.utime(source / "a.txt", (5, 5))
    assert (get().how, get().how, get().key, len(calls), len(reads)) == ("same", "hit", first.key, 1, 1)  # touched: read once, not made
    (source / "a.txt").write_text("one\ntwO\n")
    os.utime(source / "a.txt", (5, 5))
    assert get().how == "hit"  # the same look: length and time
    os.utime(source / "a.txt", (6, 6))
    changed = get()
    assert changed.how == "made" and changed.key != first.key and "twO" in {r["value"] for r in changed.table.collect()}
    assert get({"n": 2}).how == "made" and get().how == "hit"  # other settings
    (source / "sub" / "b.txt").rename(source / "sub" / "c.txt")
    assert get().how == "made"  # another name
    assert get(rebuild=True).how == "made" and get().how == "hit"
    with pytest.raises(FileNotFoundError):
        cache.cached(spark, root, "w", {}, [f"file://{tmp_path}/nothing"], lambda: None)


def test_a_lost_race_and_a_failure_are_harmless(spark, tmp_path):
    source, root = tmp_path / "in.txt", f"file://{tmp_path}/cache"
    source.write_text("x\n")
    get = lambda make, **more: cache.cached(spark, root, "t", {}, [f"file://{source}"], make, **more)
    with pytest.raises(ZeroDivisionError):
        get(lambda: 1 // 0)
    with pytest.raises(ValueError, match="no rows"):
        get(lambda: spark.range(0), none_is_error=True)
    assert [p for p in os.listdir(tmp_path / "cache") if p.startswith("t-")] == [] if (tmp_path / "cache").exists() else True

    def slow():
        os.utime(source, (9, 9))  # the other run sees another look, and the same bytes
        assert get(lambda: spark.range(3)).how == "made"
        return spark.range(99)

    os.utime(source, (8, 8))
    lost = get(slow)
    assert lost.how == "lost" and lost.table.count() == 3
    assert get(lambda: 1 // 0).how == "hit"
