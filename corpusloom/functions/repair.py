"""JSON in model replies: code fences, prose around it, and truncation."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLOSE = {"[": "]", "{": "}"}


def scan(text: str, at: int = 0) -> tuple[int | None, list[str], bool]:
    """From a bracket on: where it closes (None if it doesn't), what is still open, whether a string is."""
    stack: list[str] = []
    quoted = escaped = False
    for i in range(at, len(text)):
        c = text[i]
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted, escaped = True, False
        elif c in _CLOSE:
            stack.append(_CLOSE[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return i + 1, [], False
    return None, stack, quoted


def candidates(text: str):
    """What may be the JSON of a reply: all of it, then the first array, then the first object, each closed if it was cut off."""
    bare = text.replace("```json", "").replace("```", "").strip()
    yield bare
    for opening in _CLOSE:
        at = bare.find(opening)
        if at < 0:
            continue
        end, stack, quoted = scan(bare, at)
        if end is not None:
            yield bare[at:end]
        else:
            cut = bare[at:].rstrip().rstrip(",")
            yield cut + '"' * quoted + "".join(reversed(stack))


def parse(text: str | None):
    """The first candidate that parses, else None."""
    for c in candidates(text or ""):
        try:
            return json.loads(c)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def _repaired(text: pd.Series) -> pd.Series:
    found = [parse(t) for t in text]
    return pd.Series([None if x is None else json.dumps(x, ensure_ascii=False, sort_keys=True) for x in found])


def repaired(text: Column, schema: str | None = None) -> Column:
    """A reply's JSON as a canonical string; null without any. Replies that parse as they are never leave the JVM if a schema is given."""
    if schema is None:
        return _repaired(text)
    direct = F.from_json(text, schema)
    plain = text.rlike(r"^\s*[\[{]") & F.coalesce(F.get_json_object(text, "$").isNotNull(), F.lit(False))
    return F.when(plain, direct).otherwise(F.from_json(_repaired(text), schema))
