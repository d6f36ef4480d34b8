"""Defined cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import binary_output, exact_dedup, licenses, mixing, near_dedup, packing, pii, quality, secrets, simhash, topk
from corpusloom.llm.common import scratch

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LONG = "lorem ipsum dolor " * 40_000
SCHEMA = "doc_id long, text string, source string, score double, keep_id string, bin long, recipe string, place long, node string, component string, fp string"
ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "ab"), (5, "ab"), (6, "a  b"), (7, LONG), (8, LONG + "x"), (None, "ab"), (9, "😀 é token = abcdefgh 1.2.3.4"), (10, "a <|endoftext|> b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", 0.5, "x", 1, "y", 2, "z", "c", "f") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(1, 11)] + [(None, 1), (3, None)], "doc_id long, quality int")


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_exact_groups(docs, none):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ROWS)
    of = {r["doc_id"]: r for r in got}
    assert {of[i]["keep_id"] for i in (1, 2, 3)} == {3}  # the longest original
    assert {of[i]["keep_id"] for i in (4, 5, 6)} == {6} and of[5]["group_size"] == 5
    assert of[7]["keep_id"] == 7 and of[8]["keep_id"] == 8
    assert of[1]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.keep_exact(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 6, 7, 8, 9, 10]
    twice = docs.unionByName(docs.filter("doc_id = 5").withColumn("text", exact_dedup.F.lit("another")))  # an id's other text stays
    assert sorted(r["doc_id"] for r in exact_dedup.keep_exact(twice).collect()) == [3, 5, 6, 7, 8, 9, 10]
    assert exact_dedup.keep_exact(none).count() == 0


def test_chunks_cover_the_text(spark):
    text = "".join(chr(33 + i * i % 90) for i in range(9000)) + "é" * 3000 + "😀."
    got = spark.createDataFrame([(text,)], "t string").select(exact_dedup.chunks_of(exact_dedup.F.col("t")).alias("c")).first()["c"]
    assert "".join(got) == text and max(map(len, got)) <= exact_dedup.MAX_CHUNK


def test_shifted_text_keeps_most_chunks(spark):
    r = np.random.default_rng(4)
    text = "".join("".join(chr(97 + x) for x in r.integers(0, 26, r.integers(5, 90))) + "." for _ in range(3000))
    rows = exact_dedup.recipes(spark.createDataFrame([(1, text), (2, "New start." + text)], "doc_id long, text string")).collect()
    a, b = ({bytes(x) for x in r["recipe"]} for r in rows)
    assert len(a & b) / len(a) > 0.9


def test_unverified_identifiers_are_widened(spark, docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_narrow", lambda c: exact_dedup.F.unhex(exact_dedup.F.substring(exact_dedup.F.md5(c.cast("binary")), 1, 1)))
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(docs).collect()}[7] == 7


def check_packing(pieces, capacity):
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for inside in by.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs, none):
    got = packing.pack_documents(docs, WORD).collect()
    assert check_packing(got, packing.SEQUENCE) >= 1
    assert [r["length"] for r in got if r["doc_id"] == 1] == [1] and sum(r["doc_id"] == 5 for r in got) == 2
    encode = Tokenizer.from_file(WORD).encode
    ids = encode(LONG, add_special_tokens=False).ids + [0]
    long = sorted((r for r in got if r["doc_id"] == 7), key=lambda r: r["piece"])
    assert [r["ids_crc32"] for r in long] == [zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()) for a in range(0, len(ids), 2048)]
    assert packing.pack_documents(none, WORD).count() == 0


@pytest.mark.parametrize("most", [4_000_000, 3_000])
def test_sequences_hold_their_documents(spark, docs, none, monkeypatch, most):
    monkeypatch.setattr(packing, "IDS_PER_TASK", most)
    encode = Tokenizer.from_file(WORD).encode
    more = spark.createDataFrame([(100 + i, f"some {'more words ' * (i % 90)}", "s", 0.5, "x", 1, "y", 2, "z", "c", "f") for i in range(300)], SCHEMA)
    want, got, sizes, every = {}, {}, [], docs.unionByName(more)
    for r in every.select("doc_id", "text").collect():
        want.setdefault(r["doc_id"], []).append(encode(r["text"] or "", add_special_tokens=False).ids + [0])
    for r in packing.pack_sequences(every.repartition(3), WORD).collect():
        at = 0
        for d in r["documents"]:
            assert d["offset"] == at
            at += d["length"]
            got.setdefault(d["doc_id"], []).append((d["start"], r["ids"][d["offset"] : at]))
        assert at == len(r["ids"]) <= packing.SEQUENCE
        sizes.append(at)
    assert {i: w for i, w in want.items() if len(w) == 1} == {i: [sum((x for _, x in sorted(got[i])), [])] for i, w in want.items() if len(w) == 1}
    assert sorted(x for _, x in got[5]) == sorted(want[5]) and set(got) == set(want)
    pieces = np.array([n for w in want.values() for x in w for n in [2048] * (len(x) // 2048) + [len(x) % 2048] * (len(x) % 2048 > 0)])
    assert len(sizes) <= len(packing.best_fit(pieces, packing.SEQUENCE)[2]) * 1.02 + 1
    known = every.filter("doc_id IS NOT NULL")
    assert len({tuple(sorted(len(r["ids"]) for r in packing.pack_sequences(known.repartition(n), WORD).collect())) for n in (1, 5, 16)}) == 1  # whatever the table's partitions
    assert packing.pack_sequences(none, WORD).count() == 0


def test_what_goes_up_the_tree_suffices(spark, monkeypatch):
    """As many sequences as with every bin handed on, or hardly more."""
    r = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, int(n)) for i, n in enumerate(np.minimum(2048, r.lognormal(5.5, 1.2, 4000).astype(int) + 1))], "doc_id long, length long")
    monkeypatch.setattr(packing, "PIECES_PER_TASK", 100)
    some = packing.pack(rows).select("sequence_id").distinct().count()
    monkeypatch.setattr(packing, "handed_on", lambda fill, capacity, fan_in=8: np.flatnonzero(fill < capacity))
    every = packing.pack(rows).select("sequence_id").distinct().count()
    assert some <= every * 1.02 + 1


def test_packing_over_many_tasks_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_TASK", 40)
    r = np.random.default_rng(1)
    sizes = [*r.integers(1, 2049, 1500).tolist(), *[1100] * 400, *[1] * 300]
    rows = spark.createDataFrame([(i, 0, n) for i, n in enumerate(sizes)], "doc_id long, piece int, length long")
    got = packing.pack(rows).collect()
    assert sorted(x["length"] for x in got) == sorted(sizes)
    count = check_packing(got, packing.SEQUENCE)
    assert count <= 1.06 * len(packing.best_fit(np.array(sizes), 2048)[2])


def test_binary_round_trip(spark, docs, none):
    path = scratch(spark, "tokens")
    binary_output.write_tokens(docs.filter("doc_id IS NOT NULL"), path, BYTE)
    rows = binary_output.read_tokens(spark, path)
    encode = Tokenizer.from_file(BYTE).encode
    texts = dict(ROWS)
    got = rows.collect()
    assert all(r["ids"] == encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2] for r in got)
    index = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in binary_output.token_index(rows).collect())
    assert [i for _, i, _ in index] == sorted(i for i, _ in ROWS if i)
    at = 0
    for start, _, n in index:
        assert start == at
        at += n
    assert rows.filter("doc_id = 9").count() == 1
    empty = scratch(spark, "tokens")
    binary_output.write_tokens(none, empty, BYTE)
    assert binary_output.token_index(binary_output.read_tokens(spark, empty)).count() == 0


def test_simhash_components(docs, none):
    got = by_id(simhash.near_groups(docs.filter("doc_id IS NOT NULL")))
    assert {got[i]["fp"] for i in (1, 2, 3)} == {0} and {got[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert got[4]["component_id"] == got[6]["component_id"] == 4
    assert simhash.near_groups(docs).count() == len(ROWS) and simhash.near_groups(none).count() == 0


def test_simhash_with_large_ids_and_null_ids(spark):
    base = 1 << 60
    rows = [(base + i, "one two three four five six") for i in range(40)] + [(None, "something else altogether here"), (None, "one two three four five six")]
    for part in (rows[:40], rows):
        got = simhash.near_groups(spark.createDataFrame(part, "doc_id long, text string")).collect()
        assert {r["component_id"] for r in got if r["doc_id"]} == {base} and len(got) == len(part)
    assert sorted((r["component_id"] for r in got if r["doc_id"] is None), key=str) == [base, None]


def test_secrets(spark, docs, none):
    ledger = secrets.Ledger(spark, scratch(spark, "ledger"))
    assert secrets.scan_paths(docs, ledger).count() == len(ROWS)
    got = {r["path"]: r for r in secrets.scan_paths(docs, ledger).collect()}
    assert len(got) == len({i for i, _ in ROWS}) and [s["kind"] for s in got[9]["base"]] == ["assign"]
    assert (got[9]["base"][0]["start"], got[9]["base"][0]["end"]) == (4, 20)
    before = ledger.read().count()
    secrets.scan_paths(docs, ledger)
    assert ledger.read().count() == before == len({t or "" for _, t in ROWS})  # what was seen is not scanned again
    assert secrets.Ledger(spark, ledger.path, "other").read().count() == 0
    twice = spark.read.parquet(ledger.path)  # two runs may add a blob at once
    twice.write.mode("append").parquet(ledger.path + "-2")
    twice.write.mode("append").parquet(ledger.path + "-2")
    assert secrets.scan_paths(docs, secrets.Ledger(spark, ledger.path + "-2")).count() == len(ROWS)
    assert secrets.scan_paths(none, ledger).count() == 0


def test_versions_of_a_path(spark, tmp_path):
    key = "token = abcdefgh1"
    rows = [("a", 1, key), ("a", 2, "clean"), ("a", 3, key), ("b", 1, key), ("b", None, "AKIA" + "A" * 16), (None, None, key), (None, None, key)]
    ledger = secrets.Ledger(spark, scratch(spark, "ledger"))
    docs = spark.createDataFrame(rows, "doc_id string, v int, text string")
    got = secrets.scan_paths(docs, ledger, version="v").collect()
    assert sorted((str(r["path"]), str(r["version"]), [s["kind"] for s in r["spans"]]) for r in got) == sorted((str(p), str(v), ["assign"] if t == key else ["access"] if t[0] == "A" else []) for p, v, t in rows)
    assert ledger._all().count() == ledger.read().count() == 3


def test_spans_of_many_matches(spark):
    text = " ".join(f"{'ab' * 12}{i % 10}" for i in range(2000))
    row = secrets.scan(spark.createDataFrame([(bytearray(b"x"), text)], "blob binary, text string")).first()
    assert [(s["start"], s["end"]) for s in row["base"]] == [(26 * i, 26 * i + 25) for i in range(2000)]


def test_personal_data(spark, docs, none):
    found = by_id(pii.find(docs))
    assert [s["kind"] for s in found[9]["base"]] == ["ip"]
    assert by_id(pii.redact(pii.find(docs)))[9]["text"] == "😀 é token = abcdefgh <ip>"
    assert pii.find(none).count() == 0
    text = "call 555-123-4567 now, SSN 123-45-6789, IBAN DE44 5001 0517 5407 3249 31; ann [at] mail [dot] org; version 555-123-4567, account 12345678"
    spans = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    assert {"local_phone", "national_id", "iban", "account", "spelled_email"} <= {s["kind"] for s in spans}
    assert text.index("555-123-4567, acc") not in {s["start"] for s in spans if s["kind"] == "local_phone"}  # a version


def features_of(m, before, after):
    """pii.features in Python."""
    import re

    digits, groups = re.sub("[^0-9]", "", m), [g for g in re.split("[^0-9]+", m) if g]
    bucket = lambda w: 0 if not w else zlib.crc32(w[1].lower().encode()) % (pii.BUCKETS - 1) + 1
    return {
        "length": len(m), "digits": len(digits), "groups": len(groups), "longest": max(map(len, groups), default=0), "letters": len(re.sub("[^A-Za-z]", "", m)), "leading_zero": digits[:1] == "0", "distinct": len(set(digits)) or 1,
        "colon": bool(re.search(r"[:=#] *\Z", before)), "digit_near": bool(re.search(r"[0-9][ .,/-]?\Z", before) or re.search(r"^[ .,/-]?[0-9]", after)), "glued": bool(re.search(r"""[^\s(\["'|,;:]\Z""", before)),
        "starts_line": bool(re.search(r"(?:^|\n) *\Z", before)), "before_bucket": bucket(re.search(r"([A-Za-zÀ-ÿ]+)[^A-Za-zÀ-ÿ]*\Z", before)), "after_bucket": bucket(re.search(r"^[^A-Za-zÀ-ÿ]*([A-Za-zÀ-ÿ]+)", after)),
    }


def test_loose_spans_by_brute_force(spark):
    """The query's added spans: every proposal by Python's regex, its features and its score by the trees as Python has them."""
    import re

    r = np.random.default_rng(21)
    texts = dict(enumerate(s for _, s, _ in pii._examples(150, 99)))
    texts |= {1000 + i: "\n".join(r.choice(list(texts.values()), 12).tolist()) for i in range(40)}
    texts |= {2000: "call " + "9" * 30 + " phone: 555 123 4567 555 123 4567", 2001: "IBAN DE00500105175407324931 iban GB29 NWBK 6016 1331 9268 19", 2002: "SSN 000-12-3456, 123-45-0000, 123-45-6789"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = pii.learn(docs)
    assert model.report["precision"] >= pii.PRECISION and model.report["recall"] > 0.5 and model.report["from_corpus"] > 20

    def plausible(kind, m):
        if kind == "national_id":
            return not re.match("000|666|9", m) and m[4:6] != "00" and m[-4:] != "0000"
        bare = m.replace(" ", "")
        return kind != "iban" or int("".join(c if c.isdigit() else str(ord(c) - 55) for c in bare[4:] + bare[:4])) % 97 == 1

    for row in pii.find(docs, model=model).collect():
        text, want = texts[row["doc_id"]], set()
        for kind, pattern in pii.LOOSE.items():
            found = list(re.finditer(pattern, text))
            for k, m in enumerate(found):
                before = text[found[k - 1].end() if k else 0 : m.start()][-pii.CONTEXT :]
                after = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)][: pii.CONTEXT]
                if plausible(kind, m[0]) and model.score_row({n: float(x) for n, x in features_of(m[0], before, after).items()}) >= model.trees.threshold:
                    want.add((kind, m.start(), m.end()))
        assert {(s["kind"], s["start"], s["end"]) for s in row["spans"] if s["kind"] in pii.LOOSE} == want


def test_licenses(spark, none):
    mit = licenses.KNOWN["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ;")), (3, mit + " more"), (4, "x\nReleased  under the MIT Licence!\ny"), (5, None), (6, "")]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i]["license"] for i in range(1, 7)] == ["MIT", "MIT", None, None, None, None]
    assert got[4]["notices"] == ["MIT-notice"] and got[5]["notices"] == []
    assert licenses.scan(none).count() == 0
    long = "word " * 300_000 + "\n" + licenses.KNOWN["GPL-3.0-notice"] + "\n" + "SPDX-License-Identifier: MIT\n" * 1000
    rows = [(1, long, "a"), (1, long, "b"), (None, "Released into the public domain", "c"), (2, "one\nreleased INTO the public-domain.", "d"), (3, licenses.KNOWN["BSD-3-Clause"], "e")]
    clash = spark.createDataFrame([(i, t, n, n, n, n, n) for i, t, n in rows], "doc_id long, text string, license string, notices string, digest string, lines string, name string")
    got = sorted((str(r["doc_id"]), r["license"], r["notices"]) for r in licenses.scan(clash).collect())
    assert got == [("1", None, ["GPL-3.0-notice", "MIT-tag"])] * 2 + [("2", None, []), ("3", "BSD-3-Clause", []), ("None", None, [])]
    known = {"PD": "Released into the public domain.", "A": "same", "B": "Same!"}
    got = sorted((str(r["doc_id"]), r["license"], r["notices"]) for r in licenses.scan(clash, known).collect())
    assert got[2:] == [("2", None, ["PD"]), ("3", None, []), ("None", "PD", ["PD"])]
    assert list(licenses.digests(known).values()) == ["A", "PD"]


def test_a_folder_of_licences(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Own\nlicence text.\n")
    assert licenses.texts_of_folder(spark, str(tmp_path)) == {"Own-1.0": "Own\nlicence text.\n"}


def test_quality_cases(docs, none, labels):
    model = quality.QualityModel.train(docs, labels)
    scored = model.score(docs.drop("score")).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] in (1, 2, 3)}) == 1
    assert quality.accepted(docs, labels).columns == docs.columns
    assert quality.accepted(none, labels).count() == 0
    assert quality.QualityModel.train(docs, labels.limit(0)).score(docs).first()["score"] == 0.5
    assert model.score(docs).columns == [c for c in docs.columns if c != "score"] + ["score"]
    clash = docs.withColumnsRenamed({"recipe": "_score", "node": "scored_text"})
    assert quality.accepted(clash, labels, 0.0).columns == clash.columns and quality.accepted(clash, labels, 0.0).count() == len(ROWS)
    assert {r["_score"] for r in quality.accepted(clash, labels, 0.0).collect()} == {"y"}


def test_long_texts_are_counted_in_parts(monkeypatch):
    import pyarrow as pa

    vectors, text = quality.index_vectors(), "Ab cd, é!! 12 x" * 5000 + "y" * 3000 + " end"
    batch = pa.record_batch({"t": ["a b", text, ""]})
    whole = quality.pooled(vectors, batch, 0)
    monkeypatch.setattr(quality, "AT_ONCE", 1000)
    parts = quality.pooled(vectors, batch, 0)
    assert np.allclose(whole, parts, atol=2e-3)
    monkeypatch.setattr(quality, "AT_ONCE", 70_000)
    assert np.allclose(whole, quality.pooled(vectors, batch, 0), atol=1e-4)


def test_buckets_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = ["", "Ab cd", "cd\ncd", "", "é!! 12", "   "]
    vectors = quality.index_vectors()
    together = quality.pooled(vectors, pa.record_batch({"t": texts}), 0)
    alone = np.vstack([quality.pooled(vectors, pa.record_batch({"t": [t]}), 0) for t in texts])
    assert np.allclose(together, alone) and not together[[0, 3, 5]].any() and together[[1, 2, 4]].any(axis=1).all()


def test_top_k_cases(spark):
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (3, [1.0, 0.5]), (3, [1.0, 0.5]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (10, [-0.01, 0.0])]
    clash = [(i, v, 1, True, 2, "b", 3, 4, 5) for i, v in rows]
    got = topk.top_k(spark.createDataFrame(clash, "vec_id long, embedding array<float>, x int, ask boolean, shard int, block string, rank int, score int, n int"), topk.F.col("vec_id") % 20 == 0).collect()
    first = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 0)
    assert first == [(1, 3, 5120), (2, 3, 5120), (3, 20, 5120), (4, 10, -64)]
    huge = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [3e38, -1.0]), (3, [20_000.0, 0.5])]
    got = topk.top_k(spark.createDataFrame(huge, "vec_id long, embedding array<float>"), topk.F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 1), (2, 2), (3, 3)] and all(r["score"] > 1 << 40 for r in got)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), topk.F.col("vec_id") == 0).count() == 0


def test_bounds_never_fall_below_products():
    r = np.random.default_rng(2)
    q, c = np.floor(r.normal(0, 20, (40, 60))), np.floor(r.normal(0, 20, (300, 60)))
    for n in topk.levels_of(60):
        assert (topk.statistics(q, n) @ topk.statistics(c, n).T >= q @ c.T - 1e-6).all()


@pytest.mark.parametrize("size", [1, 3, 64, 700])
@pytest.mark.parametrize("large", [1, 1 << 12, 1 << 19, 1 << 26, 1 << 31])
def test_search_is_exact_at_any_size_and_with_ties(size, large):
    r = np.random.default_rng(size)
    c = np.floor(r.normal(0, 3, (400, size))) * large
    cid = np.sort(r.choice(5000, 400, replace=False))
    cid[7] = cid[8]  # an id that repeats
    c[100:130] = c[50]
    qid, q = cid[::9], c[::9]
    got = topk.search(qid, q, cid, c, 20)
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in c.tolist()] for x in q.tolist()]
    nearest = lambda v: max(-(1 << 63) + 1, min(v, (1 << 63) - 1))
    for i in range(len(q)):
        want = sorted((-nearest(exact[i][j]), j) for j in range(len(c)) if cid[j] != qid[i])[:20]
        mine = sorted((-int(s), int(j)) for x, j, s in zip(*got, strict=True) if x == i)
        assert mine == want


def test_bounds_rule_pairs_out():
    """Nearly all pairs of vectors with a shape, and on random directions those that half as many segments can tell."""
    r, seen = np.random.default_rng(9), {}
    c = np.floor(64 * np.cumsum(r.normal(0, 1, (4000, 64)), axis=1))
    topk.search(np.arange(100), c[:100], np.arange(4000), c, 20, seen)
    assert sum(seen[n] for n in seen if n != "pairs") > 0.9 * seen["pairs"] and seen[4] > 0.5 * seen["pairs"]
    c, seen = r.normal(0, 1, (4000, 64)), {}
    c = np.floor(64 * c / np.linalg.norm(c, axis=1, keepdims=True))
    topk.search(np.arange(100), c[:100], np.arange(4000), c, 20, seen)
    assert seen[32] > 0.1 * seen["pairs"]


def test_mixing(spark, docs, none):
    rows = [(i, "a" if i < 600 else "b" if i < 690 else None, "w " * (i % 5 + 1)) for i in range(700)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = {s: sum(i % 5 + 1 for i, x, _ in rows if x == s) for s in ("a", "b", None)}
    got = mixing.mix(table).collect()
    total = {s: sum(r["tokens"] for r in got if r["source"] == s) for s in sizes}
    assert all(total[s] <= 4 * sizes[s] for s in sizes) and total[None] > 3.8 * sizes[None]
    assert sum(sizes.values()) - 15 <= sum(total.values()) <= sum(sizes.values())
    seen = [(r["id"], r["epoch"]) for r in got]
    assert len(seen) == len(set(seen))  # a document once an epoch
    assert {i for i, s, _ in rows if s == "b"} <= {r["id"] for r in got if r["source"] == "b" and r["epoch"] == 0}
    again = mixing.mix(table.repartition(7)).collect()
    assert sorted(seen) == sorted((r["id"], r["epoch"]) for r in again)
    cover = mixing.mixed(table, budget="cover", repeats=1.25)
    assert cover.columns == table.columns and {r["doc_id"] for r in cover.collect()} == set(range(700))
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixing_cases(spark, docs):
    names = {"recipe": "tokens", "score": "__s", "keep_id": "epoch", "bin": "row", "place": "key", "node": "block_order", "component": "blocks", "fp": "times"}
    clash = docs.withColumnsRenamed(names)
    got = mixing.mixed(clash, budget="cover")
    assert got.columns == clash.columns and got.schema["__s"].dataType.simpleString() == "double"
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in ROWS} and sum(r["doc_id"] == 5 for r in rows) == 2
    alone = mixing.mix(spark.createDataFrame([(1, None, None), (2, None, ""), (3, "b", None)], "doc_id long, source string, text string"))
    assert sorted((r["id"], r["epoch"], r["tokens"]) for r in alone.collect()) == [(1, 0, 0), (2, 0, 0), (3, 0, 0)]  # no tokens: one epoch


def test_mixing_many_sources_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCUMENTS", 16)
    rows = spark.range(20_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', CONCAT('s', id % 4000)) AS source", "REPEAT('w ', CAST(id % 7 AS INT)) AS text")
    got = mixing.mix(rows).collect()
    sizes, taken, last = {}, {}, {}
    for r in rows.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["doc_id"] % 7
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["tokens"]
        last.setdefault((r["source"], r["epoch"]), []).append((r["block_order"], r["key"]))
    assert set(sizes) - set(taken) <= {s for s, n in sizes.items() if not n} and all(taken[s] <= 4 * sizes[s] for s in taken)
    hot = [(r["block_order"], r["key"]) for r in mixing.mix(rows, budget=4 * sum(sizes.values()), repeats=None, target_entropy=0.1).collect() if r["source"] == "hot" and r["epoch"] == 0]
    whole = sorted(last[("hot", 0)])
    assert whole == sorted(hot)[: len(whole)]  # the partial epoch is a prefix of the whole permutation


def test_bisection_meets_its_target():
    sizes = {1000: 1, 100: 1, 10: 1}
    a = mixing.bisect(sizes, repeats=4)
    w = mixing.shares_of(sizes, a)
    assert max(x * 1110 / n for n, x in w.items()) == pytest.approx(4, rel=1e-6)
    target = 0.8 * np.log(3)
    assert mixing.entropy(sizes, mixing.shares_of(sizes, mixing.bisect(sizes, target_entropy=target))) == pytest.approx(target, abs=1e-6)


def test_near_copies(spark, docs, none):
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    base = [r.choice(words, 300).tolist() for _ in range(30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base[:20]):  # three words changed of 300: a similarity of 0.9
        c = list(b)
        for at in (50, 150, 250):
            c[at] = "changed"
        rows.append((100 + i, " ".join(c)))
    rows += [(200, " ".join(base[25][:150] + base[26][150:]))]  # half of each: not a near copy
    left = near_dedup.keep_near(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x["doc_id"] for x in left.collect()) == [*range(30), 200]
    assert near_dedup.keep_near(docs).columns == docs.columns and near_dedup.keep_near(none).count() == 0


def test_signatures_never_differ_in_more_bits_than_their_sets():
    r = np.random.default_rng(8)
    for n in (3, 400, 600, 5000):
        own = np.unique(r.integers(-(1 << 62), 1 << 62, n))
        for cut in (0, 1, n // 10, n // 2):
            other = np.unique(np.concatenate([own[cut:], r.integers(-(1 << 62), 1 << 62, cut)]))
            apart = len(np.setxor1d(own, other))
            for longs in (0, 8, 32):
                x, y = near_dedup.signature(own, longs), near_dedup.signature(other, longs)
                if len(x) == len(y):
                    assert np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum() <= apart
        whole = near_dedup.signature(own, 64)
        assert (whole[:32] ^ whole[32:] == near_dedup.signature(own, 32)).all()


def groups_by_brute_force(texts):
    """The ids that stay: the smallest of each group over all pairs with a similarity of 0.8 or more."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := t.split())}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common / (len(sets[a]) + len(sets[b]) - common) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [i for i in sorted(texts) if root(i) == i]


def test_near_copies_in_a_family_around_the_similarity(spark):
    r = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    texts = {}
    for family in range(2):
        base = r.choice(words, 300).tolist()
        for i in range(120):
            c = list(base)
            for at in r.choice(300, r.integers(4, 6), replace=False):
                c[at] = f"new{r.integers(1 << 40)}"
            texts[family * 1000 + i] = " ".join(c)
    left = near_dedup.keep_near(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    want = groups_by_brute_force(texts)
    assert 2 < len(want) < 200 and sorted(x["doc_id"] for x in left.collect()) == want


def test_near_copies_with_a_passage_added_cut_or_edited(spark):
    r = np.random.default_rng(12)
    words = [f"w{i}" for i in range(3000)]
    texts = {}
    for i in range(90):
        n = int(r.integers(60, 400))
        base = r.choice(words, n).tolist()
        more, less, edits = int((n - 4) / 0.8) - (n - 4), (n - 4) - int(np.ceil((n - 4) * 0.8)), max(1, n // 50)
        copy = list(base)
        for at in r.choice(n, edits, replace=False):
            copy[at] = "edited"
        texts[2 * i] = " ".join(base)
        texts[2 * i + 1] = " ".join([base + [f"x{i}y{k}" for k in range(more)], base[: n - less], copy][i % 3])
    left = near_dedup.keep_near(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    want = groups_by_brute_force(texts)
    assert len(want) < 125 and sorted(x["doc_id"] for x in left.collect()) == want


def test_near_copies_come_by_fingerprints_first(spark, monkeypatch):
    """The near stage's first links are those of op3's fingerprints, by brute force; those at the similarity are groups before the prefix join looks."""
    import corpus_pipeline

    r = np.random.default_rng(21)
    words = [f"w{i}" for i in range(3000)]
    texts = {}
    for i in range(40):
        base = r.choice(words, 400).tolist()
        texts[4 * i] = " ".join(base)
        texts[4 * i + 1] = "  ".join(base)  # the same words: the same fingerprint
        texts[4 * i + 2] = " ".join([*base[:-1], "changed"])
        texts[4 * i + 3] = " ".join(base[: 380 - i])
    rows = [*texts.items(), (900, ""), (901, " ")]
    given = spark.createDataFrame(rows, "node long, text string")
    links = [(x["a"], x["b"]) for x in near_dedup.print_links(given).collect()]
    fps = {i: simhash.fingerprint(simhash.shingle_hashes(simhash.word_list(t), simhash.WORDS)) for i, t in texts.items()}

    def groups(pairs):
        own = {i: {i} for i in texts}
        for a, b in pairs:
            if own[a] is not own[b]:
                own[a] |= own[b]
                for i in own[b]:
                    own[i] = own[a]
        return {frozenset(x) for x in own.values()}

    close = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= simhash.BITS]
    assert groups(links) == groups(close) and all(a < b for a, b in links) and 40 < len(links) < len(texts) * 20
    seen, possible = [], near_dedup._possible
    monkeypatch.setattr(near_dedup, "_possible", lambda pairs, signs, similarity, what: seen.append((what, {tuple(p) for p in pairs.select("a", "b").collect()})) or possible(pairs, signs, similarity, what))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()
    assert sorted(x["doc_id"] for x in left) == sorted([*groups_by_brute_force(texts), 900, 901])
    assert seen[0][0] == "print-candidates" and seen[0][1] == set(links)
    same = {(4 * i, 4 * i + 1) for i in range(40)}
    assert same <= seen[0][1] and not any(same & pairs for _, pairs in seen[1:])  # settled before the prefix join


def test_licenses_at_every_width(spark):
    """Each known text, wrapped at all widths, with a copyright line of its own."""
    import textwrap

    marks = ["Copyright (c) 2020 Some Body", "Copyright 2019-2021 Some Body", "© 2020 Some Body", "(c) 2001 X", "Copyright [yyyy] [name of copyright owner]", "COPYRIGHT: <YEAR> X", ""]
    wrapped = [(n, w, "\n\n".join([marks[w % len(marks)], *(textwrap.fill(p, w, break_long_words=False, break_on_hyphens=False) for p in t.split("\n\n"))])) for n, t in licenses.KNOWN.items() for w in range(40, 121)]
    rows = [(k, t) for k, (_, _, t) in enumerate(wrapped)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    names = licenses.digests()
    want = {k: names[hashlib.sha256(licenses.canonical_text(licenses.KNOWN[n]).encode()).hexdigest()] for k, (n, _, _) in enumerate(wrapped)}
    assert got == want


def test_columns_that_are_called_like_our_own_come_back(spark):
    schema = "doc_id long, text string, sha string, __sha string, gone string, __gone string, gone_sha string, __gone_sha string"
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words, *"abcdef"), (2, words, *"ghijkl"), (3, words + " more", *"mnopqr")], schema)
    kept, near = exact_dedup.keep_exact(docs), near_dedup.keep_near(docs)
    assert kept.columns == near.columns == docs.columns
    assert [tuple(r)[2:] for r in kept.orderBy("doc_id").collect()] == [tuple("abcdef"), tuple("mnopqr")] and [tuple(r)[2:] for r in near.collect()] == [tuple("abcdef")]


def test_temperature_is_inside_its_grid():
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 80)
    for scale in (1.0, 12.0):  # told apart without an error, and as drawn from the logits' own probabilities
        assert 1 / 64 < quality.temperature((2 * y - 1) * scale * (1 + r.random(80)), y) < 64
    logits = r.normal(0, 3, 20_000)
    drawn = (r.random(20_000) < 1 / (1 + np.exp(-logits / 2))).astype(int)
    assert quality.temperature(logits, drawn) == pytest.approx(2, rel=0.1)


def test_batches_are_cut_by_bytes(spark, docs, monkeypatch):
    from corpusloom.llm import common

    monkeypatch.setattr(common, "BATCH_BYTES", 1 << 20)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(40).selectExpr("repeat('x', 100000) AS t").coalesce(1)
    sizes = lambda batches: (type(b).from_pydict({"n": [b.nbytes]}) for b in batches)
    got = [r["n"] for r in common.small_batches(rows).mapInArrow(sizes, "n long").collect()]
    spark.conf.set(key, before)
    assert len(got) > 2 and max(got) < 3 << 20
