"""Word diffs, and terms read from edits."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Words between the equal ends of two texts that are aligned; longer ones are removed and added as a whole.
MAX_WORDS = 1200
SPANS = ArrayType(StructType([StructField("op", StringType()), StructField("text", StringType())]))
_EDGE = re.compile(r"^\W+|\W+$|^_+|_+$")


def _codes(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal where two words count as the same; words without a letter or digit equal none."""
    known: dict[str, int] = {}

    def code(word: str, none: int) -> int:
        bare = (word if word.isalnum() else _EDGE.sub("", word)).lower()
        return known.setdefault(bare, len(known)) if bare else none

    return np.array([code(w, -1) for w in left], np.int64), np.array([code(w, -2) for w in right], np.int64)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a from i on and b from j on, at (i, j); a row of arrays for each of the shorter side."""
    if len(a) > len(b):
        return _common(b, a).T
    best = np.zeros((len(a) + 1, len(b) + 1), np.int16)
    for i in range(len(a) - 1, -1, -1):
        row = np.where(b == a[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    return best


def _spans(left: list[str], right: list[str], a: np.ndarray, b: np.ndarray) -> list[tuple[str, str]]:
    """(op, word) from the longest common subsequence of the codes; where both ways are as long, a word is removed first."""
    n, m = len(left), len(right)
    # Words that the other side does not have are in no common subsequence.
    here, there = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    best = _common(a[here], b[there]).tolist()
    down, across = np.searchsorted(here, np.arange(n + 1)).tolist(), np.searchsorted(there, np.arange(m + 1)).tolist()
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append(("equal", right[j]))
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[down[i + 1]][across[j]] >= best[down[i]][across[j + 1]]):
            out.append(("removed", left[i]))
            i += 1
        else:
            out.append(("added", right[j]))
            j += 1
    return out


def spans_of(left: str | None, right: str | None) -> list[dict[str, str]]:
    """G2 for one pair: adjacent words of one kind are one span; equal text is the right side's."""
    a, b = (left or "").split(), (right or "").split()
    c, d = _codes(a, b)
    least = min(len(a), len(b))
    differ = np.flatnonzero(c[:least] != d[:least])
    head = int(differ[0]) if len(differ) else least
    differ = np.flatnonzero(c[::-1][: least - head] != d[::-1][: least - head])
    tail = int(differ[0]) if len(differ) else least - head
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    middle = _spans(x, y, c[head : len(a) - tail], d[head : len(b) - tail]) if max(len(x), len(y)) <= MAX_WORDS else [*(("removed", w) for w in x), *(("added", w) for w in y)]
    out: list[dict[str, str]] = []
    for op, word in [*(("equal", w) for w in b[:head]), *middle, *(("equal", w) for w in b[len(b) - tail :])]:
        if out and out[-1]["op"] == op:
            out[-1]["text"] += f" {word}"
        else:
            out.append({"op": op, "text": word})
    return out


@pandas_udf(SPANS)
def word_diff(left: pd.Series, right: pd.Series) -> pd.Series:
    """Spans (op, text) of two texts; a dynamic program over words, so it runs in Arrow batches."""
    return pd.Series([spans_of(a, b) for a, b in zip(left, right, strict=True)])


def term_from_spans(spans: Column, most: int = 3) -> Column:
    """(surface, canonical) if the diff has exactly one removed and one added span, side by side, of at most ``most`` words."""
    kinds = F.transform(spans, lambda s: s["op"])
    at = F.array_position(kinds, "removed").cast("int")
    count = lambda op: F.size(F.filter(spans, lambda s: s["op"] == op))
    size = lambda s: F.size(F.split(s, " "))
    surface, canonical = F.get(spans, at - 1)["text"], F.get(spans, at)["text"]
    sound = (count("removed") == 1) & (count("added") == 1) & (F.get(kinds, at) == "added") & (size(surface) <= most) & (size(canonical) <= most)
    return F.when(F.coalesce(sound, F.lit(False)), F.struct(surface.alias("surface"), canonical.alias("canonical")))


def live_against_final(captions: DataFrame, finals: DataFrame) -> DataFrame:
    """Diff of a session's final captions, joined in order, against its final text (session_id, body)."""
    parts = captions.where("phase = 'final'").groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("created_at_ms", "id", "text"))), lambda x: x["text"]), " ").alias("live"))
    return parts.join(finals, "session_id").select("session_id", word_diff("live", "body").alias("spans"))
