"""Truncation to a token budget, for any token counter.

A counter says how many tokens a text has. The longest part that fits is found by bisection, as a longer part never
has fewer tokens. For the default counter, words are looked up once, and a part's words follow from where they begin and end, so a
long text costs no more than its length. These functions need a counter in Python, so they run as Arrow-batched UDFs, and only for texts over the budget.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Counter = Callable[[str], int]

# What stands for the part that was cut, the tokens that a document may have for embedding, the part of them that
# truncation aims at, and the budget under which whole sentences aren't tried.
AFTER, BEFORE, BETWEEN = "\n\n[... truncated ...]", "[... truncated ...]\n\n", "\n\n[... truncated ...]\n\n"
EMBEDDING_TOKENS, SAFETY = 8191, 0.95
LEAST_FOR_SENTENCES = 20

STRATEGIES = ("end", "start", "middle_out", "sentences")

_words = re.compile(r"\S+")


def count_words(text: str) -> int:
    return sum(1 for _ in _words.finditer(text)) if text else 0


def token_budget(limit: int = EMBEDDING_TOKENS) -> int:
    return int(limit * SAFETY)


class Measured:
    """A text whose beginnings and ends are counted."""

    def __init__(self, text: str, count: Counter) -> None:
        self.text, self.count = text, count
        if count is count_words:
            spans = [m.span() for m in _words.finditer(text)]
            self.begins, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def head(self, k: int) -> int:
        """Tokens of the first k characters."""
        return bisect_left(self.begins, k) if self.count is count_words else self.count(self.text[:k])

    def tail(self, k: int) -> int:
        """Tokens of the last k characters."""
        at = len(self.text) - k
        return len(self.ends) - bisect_right(self.ends, at) if self.count is count_words else self.count(self.text[at:])


def _longest(n: int, fits: Callable[[int], bool]) -> int | None:
    """The largest k in 0..n that fits, if any does."""
    low, high = -1, n
    while low < high:
        k = (low + high + 1) // 2
        if fits(k):
            low = k
        else:
            high = k - 1
    return None if low < 0 else low


def keep_beginning(text: str, budget: int, count: Counter) -> str:
    room, of = budget - count(AFTER), Measured(text, count)
    k = _longest(len(text), lambda k: of.head(k) <= (room if room > 0 else budget))
    if room <= 0:
        return text if k is None else text[:k]
    return text[: k or 0] + AFTER


def keep_end(text: str, budget: int, count: Counter) -> str:
    room, of = budget - count(BEFORE), Measured(text, count)
    k = _longest(len(text), lambda k: of.tail(k) <= (room if room > 0 else budget))
    if room <= 0:
        return text if k is None else text[len(text) - k :]
    return BEFORE + text[len(text) - (k or 0) :]


def keep_both_ends(text: str, budget: int, count: Counter) -> str:
    """As many characters from each end."""
    room, of = budget - count(BETWEEN), Measured(text, count)
    if room <= 0:
        return keep_beginning(text, budget, count)
    k = _longest(len(text) // 2, lambda k: of.head(k) + of.tail(k) <= room) or 0
    return text[:k] + BETWEEN + text[len(text) - k :]


def split_sentences(text: str) -> list[str]:
    return [s for s in map(str.strip, re.split(r"(?<=[.!?])\s+", text)) if s]


def _whole_sentences(some: list[str], most: int, count: Counter) -> list[str]:
    """The first of ``some`` whose tokens together are ``most`` at most. Words of sentences apart by a space add up; for other counters the joined text is counted."""
    taken: list[str] = []
    total = 0
    for s in some:
        total = total + count(s) if count is count_words else count(" ".join([*taken, s, ""]))
        if total > most:
            break
        taken.append(s)
    return taken


def keep_sentences(text: str, budget: int, count: Counter) -> str:
    """Whole sentences from the beginning for half the room, then from the end; else characters from both ends."""
    room, parts = budget - count(BETWEEN), split_sentences(text)
    if room <= 0 or budget < LEAST_FOR_SENTENCES or len(parts) <= 2:
        return keep_both_ends(text, budget, count)
    first = _whole_sentences(parts, room // 2, count)
    left = room - count(" ".join(first))
    last: list[str] = []
    if count is count_words:
        last = _whole_sentences(parts[::-1], left, count)[::-1]
    else:
        for s in parts[::-1]:
            if count(" ".join([s, *last, ""])) > left:
                break
            last = [s, *last]
    known = set(first)
    out = " ".join(first) + BETWEEN + " ".join(s for s in last if s not in known)
    return out if (first or any(s not in known for s in last)) and count(out) <= budget else keep_both_ends(text, budget, count)


_KEEP = {"end": keep_beginning, "start": keep_end, "middle_out": keep_both_ends, "sentences": keep_sentences}


def truncate_text(text: str, budget: int, strategy: str = "middle_out", count: Counter = count_words) -> tuple[str, int, bool]:
    """(text, tokens, whether it was cut). An unknown strategy keeps both ends."""
    n = count(text)
    if n <= budget:
        return text, n, False
    out = _KEEP.get(strategy, keep_both_ends)(text, budget, count)
    return out, count(out), True


def truncate(text: Column, budget: int, strategy: Column, count: Counter = count_words) -> Column:
    """struct<text, tokens, truncated, original_tokens>. Short texts don't reach Python's bisection."""

    @F.pandas_udf("struct<text: string, tokens: int, truncated: boolean, original_tokens: int>")
    def cut(texts: pd.Series, strategies: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, strategies, strict=True):
            t = t or ""
            rows.append((*truncate_text(t, budget, s, count), count(t)))
        return pd.DataFrame(rows, columns=["text", "tokens", "truncated", "original_tokens"])

    return cut(text, strategy)


def truncate_end_words(text: Column, budget: int) -> Column:
    """The ``end`` strategy for the default counter, without Python: the text up to where the first word too many begins."""
    room = budget - count_words(AFTER)
    many = F.regexp_count(text, F.lit(r"\S+")) > budget
    if room <= 0:
        return F.when(many, F.regexp_extract(text, rf"^(?:\s*\S+){{{budget}}}\s*", 0)).otherwise(text)
    return F.when(many, F.concat(F.regexp_extract(text, rf"^(?:\s*+\S++){{{room}}}\s*+", 0), F.lit(AFTER))).otherwise(text)
