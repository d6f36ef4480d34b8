"""Language identification by cross-parsing entropy.

1. Of each language, pieces of labelled texts are drawn by hash: PIECES of PIECE characters, from all its learnable texts alike.
2. A suffix automaton of the pieces of a language walks a new text along its longest matches: a phrase ends where no piece goes on as the
   text does. The fewer phrases a language needs, the more of the text it has seen.
3. Phrases times the logarithm of the language's sample size, by the text's length, is the cross entropy of the text in that
   language. The least wins; the score is the winner's share if entropies are taken for code lengths of TEMPER bits a step.

Texts are lower-cased; whatever ASCII character is no letter parts words; all other characters are their UTF-8 bytes, so an automaton has 256
letters at most, whatever the script. A phrase ends with each BLOCK bytes of a text, so that the blocks of many texts are walked side by
side, a byte a step, in tables. Whole texts are read. What a model holds is bounded by BYTES.

Labels are learned only outside the held-out third; labels, sources and ids are never inputs. Defined cases: null text and texts without
a letter (Unicode's) are `und` with score 0, and so are all if nothing was learned; an id of null counts as empty text where rows are
held out; languages that need equally many bits rank by name; repeated rows get a row each and copies of a piece are drawn once; an
empty table gives an empty result; extra columns stay as they are, but those called like the two results are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import free_name, lean, small_batches, text_of

#: Characters of a piece and pieces of a language; bytes of all languages' pieces together, shared out if there are many.
PIECE, PIECES, BYTES = 256, 128, 1 << 22
#: Bytes of a text that are parsed together, and blocks that are walked side by side.
BLOCK, LANES = 1024, 2048
#: Bits by which entropies are told apart in a score.
TEMPER = 8.0
#: A row is held out if the checksum of its id leaves this remainder.
HELD_OUT_OF, HELD_OUT = 3, 1
NO_LANGUAGE = "und"
_ASCII = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF == HELD_OUT


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in re.finditer(r"[^\W\d_]", text))


def letters_of(text: str) -> bytes:
    """The text as an automaton reads it: lower-case words in UTF-8, a space between them."""
    return b" ".join(text.lower().encode().translate(_ASCII).split())


def automaton(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix automaton of data as arrays of (state, byte, next state); state 0 is where every walk begins."""
    moves, link, length, last = [{}], [-1], [0], 0
    for byte in data:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and byte not in moves[p]:
            moves[p][byte] = new
            p = link[p]
        if p >= 0:
            q = moves[p][byte]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(moves[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(byte) == q:
                    moves[p][byte] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    found = [(s, b, t) for s, m in enumerate(moves) for b, t in m.items()]
    return tuple(np.array(x, np.int32) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int32),) * 3


class Walker:
    """All languages' automata as one table of moves. A place is a state's first entry; 0 says that there is no move."""

    def __init__(self, automata: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        known = np.unique(np.concatenate([b for _, b, _ in automata]))
        known = known[known > 0]  # byte 0 parts the pieces, and no phrase goes over it
        self.letters = np.full(256, 1, np.uint8)
        self.letters[known] = np.arange(2, len(known) + 2)  # 0 ends a block, 1 is in no piece
        self.classes = bytes(self.letters)
        size, tables, self.dead, roots, base = len(known) + 2, [], [], [], 0
        for state, byte, to in automata:
            states = int(max(state.max(initial=0), to.max(initial=0))) + 1
            table = np.zeros((states + 1, size), np.int32)  # the last row is for what no phrase begins with
            some = byte > 0
            table[state[some], self.letters[byte[some]]] = to[some] * size + base
            self.dead.append(base + states * size)
            roots.append(np.where(table[0] > 0, table[0], self.dead[-1]))
            tables.append(table.ravel())
            base += table.size
        self.table, self.roots, self.dead = np.concatenate(tables), np.array(roots, np.int32), np.array(self.dead, np.int32)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases that each language needs for each text: a row for each language."""
        out = np.zeros((len(self.dead), len(texts)), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        blocks = -(-sizes // BLOCK)
        text = np.repeat(np.arange(len(texts)), blocks)
        if not len(text):
            return out
        data = np.frombuffer(b"".join(texts).translate(self.classes), np.uint8)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
        size = np.minimum(sizes[text] - nth * BLOCK, BLOCK)
        order = np.argsort(size, kind="stable")
        for at in range(0, len(order), LANES):
            some = order[at : at + LANES]
            steps = np.arange(size[some].max())[:, None]
            codes = np.where(steps < size[some], data[np.minimum(start[some] + steps, len(data) - 1)], 0).astype(np.int32)
            place, count = np.repeat(self.dead[:, None], len(some), axis=1), np.zeros((len(self.dead), len(some)), np.int32)
            for code in codes:
                place = self.table.take(place + code)
                ends = place == 0
                count += ends
                np.copyto(place, self.roots.take(code, axis=1), where=ends)
            count -= (len(codes) - size[some]).astype(np.int32)  # what was filled up
            for k in range(len(out)):
                out[k] += np.bincount(text[some], count[k], len(texts)).astype(np.int64)
        return out


_WALKERS: dict[str, Walker] = {}


def _walker(key: str, automata) -> Walker:
    """The table of a model, made once in a worker."""
    if key not in _WALKERS:
        _WALKERS.clear()
        _WALKERS[key] = Walker(automata)
    return _WALKERS[key]


@dataclass
class LanguageModel:
    """Languages with the bits of a phrase in each, and their automata."""

    languages: list[str]
    bits: np.ndarray
    automata: list
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def of(cls, samples: dict[str, list[str]]) -> LanguageModel:
        data = {lang: [letters_of(p) for p in pieces if has_letter(p)] for lang, pieces in sorted(samples.items())}
        data = {lang: pieces for lang, pieces in data.items() if pieces}
        sizes = np.array([sum(map(len, pieces)) for pieces in data.values()], float)
        return cls(list(data), np.log2(np.maximum(sizes, 2)), [automaton(b"\0".join(pieces)) for pieces in data.values()])

    @classmethod
    def learn(cls, docs: DataFrame, lang: str = "lang", text: str = "text") -> LanguageModel:
        """From rows whose labels may be used."""
        rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), text_of(text).alias("text"))
        rows = rows.withColumns({"n": F.ceil(F.length("text") / PIECE).cast("int")}).filter("n > 0")
        sizes = rows.groupBy("lang").agg(F.sum("n").alias("all"))  # a row for each language
        most = max(4, min(PIECES, BYTES // PIECE // max(1, sizes.count())))
        share = F.least(F.lit(1.0), F.lit(4.0 * most) / F.col("all"))
        drawn = rows.join(F.broadcast(sizes), "lang").withColumn("hash", F.xxhash64("text"))
        rank = lambda i: F.shiftrightunsigned(F.xxhash64("hash", i), 12)
        places = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: rank(i) < share * float(1 << 52))
        drawn = drawn.select("lang", "text", "hash", F.explode(places).alias("i")).select("lang", F.expr(f"substring(text, i * {PIECE} + 1, {PIECE})").alias("piece"), rank(F.col("i")).alias("rank"))
        drawn = drawn.groupBy("lang", "piece").agg(F.min("rank").alias("rank"))
        place = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "piece"))
        samples: dict[str, list[str]] = {}
        for r in drawn.withColumn("place", place).filter(F.col("place") <= most).select("lang", "place", "piece").collect():
            samples.setdefault(r["lang"], []).append((r["place"], r["piece"]))
        return cls.of({k: [p for _, p in sorted(v)] for k, v in samples.items()})

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits that each language needs for each text, in all, and the texts' bytes."""
        data = [letters_of(t) for t in texts]
        return _walker(self.key, self.automata).phrases(data) * self.bits[:, None], np.array([len(x) for x in data])

    def guess(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Each text's language and score."""
        some = [i for i, t in enumerate(texts) if self.languages and t and has_letter(t)]
        found, score = [NO_LANGUAGE] * len(texts), np.zeros(len(texts))
        if some:
            bits, _ = self.entropies([texts[i] for i in some])
            best = bits.argmin(axis=0)  # all entropies of a text have its length below them
            score[some] = 1 / np.exp2((bits.min(axis=0) - bits) / TEMPER).sum(axis=0)
            for i, b in zip(some, best.tolist(), strict=True):
                found[i] = self.languages[b]
        return found, score

    def predict(self, docs: DataFrame, text: str = "text", column: str = "lang_pred", score: str = "score") -> DataFrame:
        """The input's rows and columns with the language and the score added."""
        shared = docs.sparkSession.sparkContext.broadcast(self)
        kept = [c for c in docs.columns if c.lower() not in (column.lower(), score.lower())]
        rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(free_name(docs, "told_text")))
        schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(column, T.StringType()), T.StructField(score, T.DoubleType())])

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, p = shared.value.guess(batch.column(batch.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(p)], names=[*batch.schema.names[:-1], column, score])

        return small_batches(rows).mapInArrow(lean(predict), schema)


def op11_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = LanguageModel.learn(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    return model.predict(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))).select("doc_id", "held_out", "lang_pred", "score")
