"""Queries on the test tables against brute force, and the tokenizer memo against the library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as entry
from corpusloom.llm import quality, queries, tokens
from tests.conftest import DATA, plain, rows_of


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA), duck.sql(queries.SQL[name])
    columns = sorted(got.columns)
    place = [want.columns.index(c) for c in columns]
    assert rows_of(got.collect(), columns) == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)


#: Pieces of texts that are cut in unlike places: cases, marks, digits, endings, kinds of white space, strings of special tokens.
HARD = [
    "é!", "É", "À-b", "dog", "'S", "x9", "9x", "_", " ", " ", "  ", "\n", "\t", "\u3000", "a", "'s", "'t", "I'm", "!", "..", "23", "ß", "Σ", "中", "\x1c", "\x85", "\xa0", "\r\n", "\0", "²", "😀", "H\u0331", "\u0301",
    "\u0331", "W\u030a", "\x01", " \x01 ", "<|endoftext|>", "<|startoftext|>", "<|", "\u2002", "\u205f", "\u1680", "\u0130", "Ġ", "\x7f", "\u212a", "''s", "'R", "e'Re", "\u200b", "\ufeff", "é",
]


@pytest.mark.parametrize("special", [True, False])
@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize(("memo", "part"), [(200, 64), (400_000, 1 << 20), (5_000, 7)])
def test_ids_are_those_of_the_library(file, memo, part, special):
    r = random.Random(memo)
    texts = ["".join(r.choice(HARD) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    library = Tokenizer.from_file(public_tokenizers.path(file))
    library.encode_special_tokens = not special
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    own = tokens.Encoder(public_tokenizers.path(file), memo, special, part)
    for at in range(0, len(texts), 300):
        ids, counts = own.encode(texts[at : at + 300])
        ends = np.cumsum(counts)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == want[at : at + 300]


def texts_of(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_simhash(spark):
    texts, fps = texts_of(spark), {}
    for i, text in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
        grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    for r in queries.QUERIES["op3_simhash"](spark, DATA).collect():
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == root(r["doc_id"])


def test_base_spans(spark):
    texts = texts_of(spark)

    def luhn(d):
        return sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda x: re.sub("[^0-9]", "", x)
    rules = {
        "op6_secret_scan": [
            ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
            ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
            ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
        ],
        "op7_pii": [
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
        ],
    }
    for name, kinds in rules.items():
        for r in queries.QUERIES[name](spark, DATA).collect():
            spans = sorted((m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(kinds) for m in re.finditer(p, texts[r["doc_id"]]) if ok(m))
            base = [f"{kind}:{a}:{b}" for a, _, b, kind in spans]
            assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]
            assert set(base) <= set(r["spans"].split(","))


def test_hard_personal_data(spark):
    from corpusloom.llm import pii

    text = "x" * 200_000 + " a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 0000001.2.3.4 +1 (23) 45-678.90 4111 1111-1111 1111 " + "1 " * 50_000
    rows = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["base"]
    at = text.index("a@b")  # the phone and the card go on for too many digits
    assert [(s["kind"], s["start"] - at, s["end"] - at) for s in rows] == [("email", 0, 5), ("email", 5, 11), ("ip", 12, 19), ("ip", 20, 27), ("ip", 38, 51)]


def test_quality_on_held_out_labels(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op9_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["predicted"], labels[i]) for i, r in rows.items() if r["held_out"] and i in labels]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert sum(a == b for a, b in held) / len(held) >= 0.95


def test_packing_and_tokens(spark):
    texts = texts_of(spark)
    word, byte = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    pieces = queries.QUERIES["op2_best_fit_packing"](spark, DATA).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = []
    for i, text in texts.items():
        ids = word.encode(text, add_special_tokens=False).ids + [0]
        want += [(i, k, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == sorted(want)
    assert len({r["sequence_id"] for r in pieces}) <= -(-sum(w[3] for w in want) // 2048) + 1
    at = 0
    for r in sorted(queries.QUERIES["op10_token_output"](spark, DATA).collect(), key=lambda r: r["doc_id"]):
        ids = byte.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_added_secret_spans(spark):
    """The method's own kinds over whole texts, by Python's regex."""
    from corpusloom.llm import secrets

    r = random.Random(8)
    key = lambda n, of="abcDEF123_-": "".join(r.choice(of) for _ in range(n))
    parts = [lambda: f"ghp_{key(36, 'abcXYZ019')}", lambda: f"gho_{key(20, 'ab')}", lambda: f"xoxb-{key(12, 'ab1-')}", lambda: f"eyJ{key(9)}.eyJ{key(8)}.{key(9)}", lambda: "-----BEGIN RSA PRIVATE KEY-----", lambda: "-----BEGIN  KEY-----", lambda: "é words here", lambda: "token=" + key(9, "abc1"), lambda: "eyJ"]
    texts = {i: "".join(r.choice(parts)() + r.choice([" ", "", "\n", "x"]) for _ in range(r.randint(0, 14))) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    more = re.compile("|".join(secrets.MORE.values()))
    for row in secrets.scan_paths(docs, secrets.Ledger(spark, f"{spark.conf.get('spark.checkpoint.dir')}/ledger-{r.random()}")).collect():
        want = [(m.start(), m.end(), next(k for k, p in secrets.MORE.items() if re.search(p, m[0]))) for m in more.finditer(texts[row["path"]])]
        assert sorted((s["start"], s["end"], s["kind"]) for s in row["spans"] if s["kind"] in secrets.MORE) == sorted(want)


def scores_by_brute_force(model, texts):
    """Quality scores word by word: hashes, shapes, means and the network in plain loops."""
    mask, p = (1 << 64) - 1, int(quality._P)

    def mixed(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & mask
        return h ^ (h >> 31)

    def kind(b):
        return 97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b

    out = {}
    for i, text in texts.items():
        buckets, last = [], None
        for w in re.findall(rb"[^ \t\n\x0b\x0c\r]+", text.encode()):
            h, power = 0, 1
            for b in w:
                h, power = (h + (b + 32 if 65 <= b <= 90 else b) * power) & mask, power * p & mask
            word = mixed(h)
            shape = ((kind(w[0]) * 256 + kind(w[-1])) * 256 + kind(w[max(len(w) - 2, 0)])) * 8 + min(len(w) - 1, 15) // 4 * 2 + (word == last)
            buckets += [word >> 50, quality.WORD_BUCKETS + (mixed(shape + 1) >> 52)]
            last = word
        x = np.mean([model.vectors[b].astype(float) for b in buckets], axis=0) if buckets else np.zeros(model.vectors.shape[1])
        n = model.network
        z = np.tanh((x - n.mean) / n.scale @ n.w1 + n.b1) @ n.w2 + n.b2
        out[i] = 1 / (1 + np.exp(-z / n.temperature))
    return out


def test_quality_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.QualityModel.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    texts = {i: t for i, t in texts_of(spark).items() if len(t) < 4000}
    want = scores_by_brute_force(model, texts)
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_quality"](spark, DATA).collect()}
    assert len(want) > 150 and all(abs(got[i]["score"] - x) < 1e-3 for i, x in want.items())
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_pipeline_stages_by_plain_forms(spark):
    """Each stage on what the one before it left: kept rows by the classifier, by text, by all pairs of shingle sets; then whole sequences."""
    import corpus_pipeline

    def sets(text):
        w = re.findall(r"[^ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    stages, source = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{DATA}/documents.parquet")
    rows = lambda df: {r["doc_id"]: r["text"] or "" for r in df.collect()}
    docs = corpus_pipeline.materialize(stages["quality"](spark, source, DATA), "quality")
    scores = {r["doc_id"]: r["score"] for r in queries.QUERIES["op9_quality"](spark, DATA).collect()}
    assert set(rows(docs)) == {i for i, s in scores.items() if s >= quality.THRESHOLD} and docs.columns == source.columns

    before = rows(docs)
    docs = corpus_pipeline.materialize(stages["exact_dedup"](spark, docs, DATA), "exact")
    best = {}
    for i, t in before.items():
        norm = re.sub(r"[\x20\x09-\x0d]", "", t)
        best[norm] = min(best.get(norm, (1, 0)), (-len(t), i))
    assert set(rows(docs)) == {i for _, i in best.values()} and docs.columns == source.columns

    before = rows(docs)
    docs = corpus_pipeline.materialize(stages["near_dedup"](spark, docs, DATA), "near")
    own, parent = {i: sets(t) for i, t in before.items()}, {i: i for i in before}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in own if own[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if min(len(own[a]), len(own[b])) >= 0.8 * max(len(own[a]), len(own[b])):
                common = len(own[a] & own[b])
                if common >= 0.8 * (len(own[a]) + len(own[b]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    assert set(rows(docs)) == {i for i in before if root(i) == i} and docs.columns == source.columns

    mixed = corpus_pipeline.materialize(stages["mixing"](spark, docs, DATA), "mix")
    kept, counts = rows(docs), Counter(r["doc_id"] for r in mixed.collect())
    assert set(counts) == set(kept) and max(counts.values()) <= 2 and mixed.columns == source.columns

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    got = {}
    for r in stages["packing"](spark, mixed, DATA).collect():
        assert len(r["ids"]) == sum(d["length"] for d in r["documents"]) <= 2048
        for d in r["documents"]:
            got.setdefault((d["doc_id"], d["start"]), []).append(tuple(r["ids"][d["offset"] : d["offset"] + d["length"]]))
    for i, text in kept.items():
        ids = encode(text, add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), 2048):
            assert got.pop((i, at)) == [tuple(ids[at : at + 2048])] * counts[i]
    assert not got and "pipeline" in entry.queries()


@pytest.mark.parametrize("case", ["empty", "odd"])
def test_pipeline_on_empty_and_odd_tables(spark, tmp_path, case):
    """No rows; and null texts, blank texts, repeated rows and ids, a very long text, names that clash with the stages' own."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, tokens string, key long, `row` long, component string"
    rows = [(1, None), (2, ""), (3, " "), (4, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f "), (6, "word " * 60_000), (7, "good plain words of a text"), (None, "good plain words of a text"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s" if i else None, 1, 0.5, "t", 2, 3, "c") for i, t in rows] if case == "odd" else [], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [f.split(" ")[0].strip("`") for f in schema.split(", ")]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(out) == (case == "odd")
    if out:
        assert {1, 2, 3} & {d["doc_id"] for r in out for d in r["documents"]} and {5, 6, 7} & {d["doc_id"] for r in out for d in r["documents"]} == {5, 6, 7}
