"""Token ids of whole texts by a tokenizer file, with a bounded memo of words.

Texts stay in their Arrow buffer. numpy finds the places where the tokenizer's own pre-tokenizer cuts too, Arrow's dictionary
encoding tells the distinct units between them, and only units that the memo lacks go to the tokenizers library, many at a time;
the rest is a gather. So Python's work is per distinct unit of a part, not per word. A text is cut only where that changes no id:

* before a space that a visible character follows, by a byte-level file with the usual pattern: no token holds a character
  before such a space;
* before any white space, by a file whose normaliser and pattern drop white space;
* between an ASCII letter and an ASCII character that is none, by both: a run of letters ends there;
* any other file: whole texts go to the library.

Strings of special tokens in a text become those tokens, as the library has it by default; with special=False they are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: When the memo holds this many units (about 100 MB in a Python worker), those used once or twice go.
MEMO_WORDS = 690_000
#: Bytes of text that are encoded at a time; a longer text is cut where its units are.
PART_BYTES = 2 << 20
#: The bytes that begin white space beyond ASCII in UTF-8, and the second bytes with which they do.
_SPACE_LEADS = {0xC2: (0x85, 0xA0), 0xE1: (0x9A,), 0xE2: (0x80, 0x81), 0xE3: (0x80,)}
#: Joined to a text of many words, this stands between them: a visible character that is a token of its own.
_MARK = "\x01"
#: Words of a text that goes to the library, and words learned at a time.
_JOINED, _AT_ONCE = 200, 20_000


def _rule(spec: dict) -> str:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or []):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "space"
    steps = (norm or {}).get("normalizers", [])
    cuts = pre.get("pretokenizers", [{}])[0]
    drops = cuts.get("type") == "Split" and cuts.get("behavior") == "Removed" and cuts.get("invert") and cuts.get("pattern", {}).get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
    if drops and [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"}:
        return "dropped"
    return "whole"


@cache
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: an ASCII letter, an ASCII character that is none, ASCII white space."""
    byte = np.arange(256)
    letter = (byte >= 65) & (byte <= 90) | (byte >= 97) & (byte <= 122)
    return letter, (byte < 128) & ~letter, np.isin(byte, [9, 10, 11, 12, 13, 32])


def _visible_after(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a character that is surely no white space follows each place."""
    some = at + 1 < len(data)
    lead = np.where(some, data[np.minimum(at + 1, len(data) - 1)], 0)
    second = data[np.minimum(at + 2, len(data) - 1)]
    out = (lead > 0x20) & (lead != 0x7F)
    for first, seconds in _SPACE_LEADS.items():
        out &= ~((lead == first) & np.isin(second, seconds))
    return out


def unit_starts(data: np.ndarray, rule: str) -> np.ndarray:
    """By place in a text's bytes (and at its end, where nothing is said): whether it may be cut before it without changing an id."""
    letter, other, space = _classes()
    out = np.zeros(len(data) + 1, bool)
    if rule == "whole":
        return out
    out[1:-1] = letter[data[:-1]] & other[data[1:]]
    if rule == "dropped":
        out[1:-1] |= space[data[1:]]
        return out
    at = np.flatnonzero(data[1:] == 32) + 1
    out[at] = _visible_after(data, at)  # another space belongs to what stands before or after it
    return out


def _windows(data: np.ndarray, offsets: np.ndarray, rule: str, most: int) -> Iterator[tuple[int, int]]:
    """Parts of about so many bytes that end where a text does, or within a long text where a unit does."""
    a, total = int(offsets[0]), int(offsets[-1])
    while a < total:
        b = a + most
        if b < total:
            text_end = int(offsets[np.searchsorted(offsets, b, "right") - 1])
            if text_end > a:
                b = text_end
            else:  # within one long text
                end = int(offsets[np.searchsorted(offsets, a, "right")])
                step, cut = 1 << 16, None
                while b < end and cut is None:
                    part = data[b : min(b + step, end) + 2]
                    found = np.flatnonzero(part[1:] == 32) + 1
                    found = found[_visible_after(part, found) & (found < len(part) - 2)] if rule != "whole" else found[:0]
                    cut = b + int(found[0]) if len(found) else None
                    b = cut if cut is not None else b + step
                b = min(b, end)
        b = min(b, total)
        yield a, b
        a = b


class Encoder:
    """Ids of texts by one tokenizer file. special: strings of special tokens become those tokens (the library's default)."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS, special: bool = True, part_bytes: int = PART_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.rule, self.limit, self.part_bytes = _rule(spec), memo_words, part_bytes
        tokens = sorted({t["content"]: t["id"] for t in spec.get("added_tokens") or []}.items(), key=lambda t: -len(t[0]))
        self.special = dict(tokens) if special and self.rule != "whole" else {}
        self.cut_special = re.compile("(" + "|".join(re.escape(t) for t in self.special) + ")") if self.special else None
        self.spaced = np.zeros(self.plain.get_vocab_size(), bool)
        self.spaced[[i for t, i in self.plain.get_vocab().items() if t.startswith("Ġ")]] = True
        mark = self.plain.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else -1
        self.memo: dict[bytes, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.length, self.uses = (np.empty(1 << 14, np.int64) for _ in range(3))

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.plain.encode_batch_fast(words, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and lengths of units of one word each, many to a text. None if the tokens don't tell the words apart."""
        if self.rule == "space":  # each unit's first token, and no other, is spelled with a space
            texts = ["".join(words[i : i + _JOINED]) for i in range(0, len(words), _JOINED)]
            flat, _ = self._each(texts)
            first = np.flatnonzero(self.spaced[flat])
            return (flat, np.diff(first, append=len(flat))) if len(first) == len(words) and not (len(flat) and first[0]) else None
        texts = [f" {_MARK} ".join(words[i : i + _JOINED]) + f" {_MARK}" for i in range(0, len(words), _JOINED)]
        flat, _ = self._each(texts)
        ends = np.flatnonzero(flat == self.mark)
        return (flat[flat != self.mark], np.diff(ends, prepend=-1) - 1) if len(ends) == len(words) else None

    def _learn(self, spelled: list[bytes]) -> None:
        for at in range(0, len(spelled), _AT_ONCE):
            part = [w.decode() for w in spelled[at : at + _AT_ONCE]]
            if self.rule == "space":
                fits = [w[0] == " " and w.split() == [w[1:]] for w in part]
            else:
                fits = [self.mark >= 0 and _MARK not in w for w in part] if self.rule == "dropped" else [False] * len(part)
            plain = [w for w, ok in zip(part, fits, strict=True) if ok]
            got = self._joined(plain) if plain else None
            if got is None:
                self._add(part, *self._each(part))
                continue
            self._add(plain, *got)
            rest = [w for w, ok in zip(part, fits, strict=True) if not ok]
            if rest:
                self._add(rest, *self._each(rest))

    def _add(self, words: list[str], new: np.ndarray, lengths: np.ndarray) -> None:
        base = len(self.memo)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while base + len(words) > len(self.start):
            self.start, self.length, self.uses = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.length, self.uses))
        self.flat[self.used : self.used + len(new)] = new
        self.length[base : base + len(words)] = lengths
        self.uses[base : base + len(words)] = 0
        self.start[base : base + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(new)
        self.memo.update(zip(map(str.encode, words), range(base, base + len(words)), strict=True))

    def _forget(self) -> None:
        """Units used more than twice stay, if they are at most half of the memo; else none does."""
        n = len(self.memo)
        often = np.flatnonzero(self.uses[:n] > 2)
        often = often if len(often) * 2 <= self.limit else often[:0]
        words = list(self.memo)
        self.memo = {words[i]: k for k, i in enumerate(often.tolist())}
        kept, ends = self._gathered(often)
        self.flat[: len(kept)], self.used = kept, len(kept)
        lengths = self.length[often]
        self.length[: len(often)], self.start[: len(often)], self.uses[: len(often)] = lengths, ends - lengths, 0

    def _gathered(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units one after the other, and where each unit's end."""
        lengths, starts = self.length[codes], self.start[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        if total == len(codes) and (lengths == 1).all():
            return self.flat[starts], ends
        place = np.ones(total, np.int64)
        some = np.flatnonzero(lengths)
        first = (ends - lengths)[some]
        if len(some):  # one step forward, but at a unit's first id the way from the last one's
            place[first[0]] = starts[some[0]]
            place[first[1:]] = starts[some[1:]] - (starts[some[:-1]] + lengths[some[:-1]] - 1)
        return self.flat[np.cumsum(place)], ends

    def _codes(self, units: pa.Array) -> np.ndarray:
        coded = units.dictionary_encode()
        _, offsets, data = coded.dictionary.buffers()
        data, offsets = data.to_pybytes(), np.frombuffer(offsets, np.int32)[: len(coded.dictionary) + 1].tolist()
        words = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        known = list(map(self.memo.get, words))
        if None in known:
            missing = [w for w, c in zip(words, known, strict=True) if c is None]
            if len(self.memo) + len(missing) > self.limit:
                self._forget()
                missing = [w for w in words if w not in self.memo]
            self._learn(missing)
            known = list(map(self.memo.get, words))
        codes, index = np.array(known, np.int64), coded.indices.to_numpy()
        self.uses[codes] += np.bincount(index, minlength=len(words))
        return codes[index]

    def _part(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a part of the buffer, and how many of them stand before each of the given places."""
        cut = unit_starts(data, self.rule)
        cut[begins] = cut[0] = cut[-1] = True
        cuts = np.flatnonzero(cut)
        if self.rule == "dropped":  # what the tokenizer makes equal, so that fewer units are distinct
            _, _, space = _classes()
            data = np.where(space[data], np.uint8(32), data)
            upper = (data >= 65) & (data <= 90)
            upper[:-1] &= data[1:] < 128  # a letter with a mark after it is composed before it becomes a small one
            data = data + upper.astype(np.uint8) * np.uint8(32)
        units = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        ids, ends = self._gathered(self._codes(units))
        return ids, np.concatenate([[0], ends])[np.searchsorted(cuts, begins)]

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32), and each text's number of ids. Null counts as empty."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        if self.special:
            held = np.zeros(len(texts), bool)
            for token in self.special:
                held |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
            if held.any():
                return self._with_special(texts, held)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
        out, before, total = [], np.zeros(len(offsets), np.int64), 0
        for a, b in _windows(data, offsets, self.rule, self.part_bytes):
            low, high = np.searchsorted(offsets, a), np.searchsorted(offsets, b)  # texts that begin in the part
            begins = offsets[low:high] - a
            ids, at = self._part(data[a:b], begins)
            before[low:high] = total + at
            total += len(ids)
            out.append(ids)
        before[np.searchsorted(offsets, offsets[-1]) :] = total
        return (np.concatenate(out) if out else np.empty(0, np.uint32)), np.diff(before)

    def _with_special(self, texts: pa.Array, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold strings of special tokens are cut there; what stands between is text of its own."""
        parts, owner, after = [], [], []
        for i, (text, some) in enumerate(zip(texts, held.tolist(), strict=True)):
            cut = self.cut_special.split(text.as_py()) if some else [text.as_py()]
            parts += cut[::2]
            owner += [i] * len(cut[::2])
            after += [self.special[t] for t in cut[1::2]] + [-1]
        known, self.special = self.special, {}
        try:
            ids, counts = self.encode(pa.array(parts, pa.large_string()))
        finally:
            self.special = known
        after = np.array(after)
        ids = np.insert(ids, np.cumsum(counts)[after >= 0], after[after >= 0].astype(np.uint32))
        return ids, np.bincount(owner, weights=counts + (after >= 0), minlength=len(texts)).astype(np.int64)


@cache
def encoder(path: str, special: bool = True) -> Encoder:
    """One a Python worker."""
    return Encoder(path, special=special)


def row_parts(texts: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of an array of texts that hold about so many bytes each, and one text at least: first row, slice."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield at, texts.slice(at, end - at)
        at = end
