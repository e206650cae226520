"""Operator 7: toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs to Latin letters, drops invisible characters, reads digits and signs
between letters as the letters they stand for, and makes one letter of i and l, as 1 stands for both. The lexicon
holds whole words and beginnings of words with a weight: the smoothed log-odds of toxic against other labelled
documents. A word of a document counts with the largest weight that matches it, unless it lies within an exception phrase: one that is given, or one
that labelled documents show to be harmless.
The sum is normalised by length, and a logistic model of a handful of such sums gives the score.

Lexicon and model are fitted on the labelled rows with the smallest hashes of their ids, at most ``FIT_DOCS``; scoring reads
whole texts and nothing but texts.

Defined cases: a null or empty text matches nothing and gets the score of a text without matches; an id with
several labels counts as toxic if one of them is 1; null ids and labels teach nothing; without labelled
rows of both kinds every score is 0; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .tokens import forget

#: Labelled documents to fit on, candidates for the lexicon, and entries of the lexicon, at most.
FIT_DOCS, CANDIDATES, ENTRIES = 20_000, 50_000, 2_000
#: Toxic documents that an entry needs, and the least log-odds, one standard error below the estimate.
LEAST_TOXIC, LEAST_WEIGHT = 5, 1.5
#: A phrase of a lexicon word and the word before or after it is an exception if it is in this many other documents and in no toxic one; so many exceptions at most.
LEAST_OTHER, MOST_EXCEPTIONS = 5, 1_000
#: Letters of a beginning of a word.
SHORTEST, LONGEST = 3, 8
THRESHOLD = 0.3

# Characters that look like Latin letters, and the letters.
_HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ƅ": "b", "ʏ": "y", "ᴏ": "o", "ⅼ": "l", "ⅰ": "i", "ℓ": "l",
}
# Characters without width.
_INVISIBLE = "­​‌‍⁠﻿"
# Digits and signs, and the letters they stand for.
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}

#: Phrases in which a word of the lexicon is harmless, besides those that are learned.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "clown fish", "class clown", "sore loser", "pond scum", "scum line")

_table = str.maketrans(_HOMOGLYPHS | dict.fromkeys(_INVISIBLE) | {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)})
_odd = re.compile("[" + "".join(_HOMOGLYPHS) + _INVISIBLE + "！-～]").search
#: A dollar sign that begins a word; others are often marks between words.
_leading = re.compile(r"(?<![^\W_$])\$(?=[^\W\d_])")
_mixed = re.compile(r"[^\W_]*(?:[^\W\d_][@$!|]*[0-9]|[0-9][@$!|]*[^\W\d_]|[^\W\d_][@$!|]+[^\W\d_])[^\W_]*(?:[@$!|]+[^\W_]+)*")
_stands_for = str.maketrans(_STANDS_FOR)
_words = re.compile(r"[^\W_]+").findall


def fold(text: str | None) -> list[str]:
    """The folded words of a text."""
    t = (text or "").lower()
    if not t.isascii() and _odd(t):
        t = t.translate(_table).lower()
    if any(c in t for c in _STANDS_FOR):
        t = _leading.sub("s", t)
        t = _mixed.sub(lambda m: m[0].translate(_stands_for), t)
    return _words(t.replace("l", "i"))


def beginnings(word: str) -> list[str]:
    return [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)]


def features(words: list[str]) -> set[str]:
    """Whole words as "word " and beginnings as "word"."""
    out = set()
    for word in set(words):
        out.add(word + " ")
        out.update(beginnings(word))
    return out


@dataclass
class Model:
    """Entries with weights, and the logistic model of what they add up to."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    beta: list[float] = field(default_factory=list)

    def matcher(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(" " + entry, (len(entry) + 1, weight))
        for phrase in self.exceptions:
            p = " " + " ".join(fold(phrase)) + " "
            found.add_word(p, (len(p), None))
        found.make_automaton()
        return found

    def sums(self, matcher: ahocorasick.Automaton, words: list[str]) -> list[float]:
        """1, the largest weight, the log of the sum of weights, that sum by length, and the log of the number of matched words."""
        best: dict[int, float] = {}
        harmless: list[tuple[int, int]] = []
        for end, (length, weight) in matcher.iter(f" {' '.join(words)} "):
            start = end - length + 1
            if weight is None:
                harmless.append((start, end))
            elif weight > best.get(start, 0):
                best[start] = weight
        for a, b in harmless:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        total = sum(best.values())
        return [1.0, max(best.values(), default=0.0), math.log1p(total), total / (20 + len(words)), math.log1p(len(best))]

    def score(self, sums: list[float]) -> float:
        if not self.beta:
            return 0.0
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, float(np.dot(self.beta, sums))))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's rounds for a ridge-penalised logistic model; the first column is not penalised."""
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -5, 5)
    return beta


def choose(counts: dict[str, tuple[int, int]], toxic: int, other: int) -> dict[str, float]:
    """Entries and weights; of a word and its beginnings those that say most, longer ones first if they say the same."""
    rated = []
    for entry, (a, b) in counts.items():
        weight = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (other + 1))
        sure = weight - math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if a >= LEAST_TOXIC and sure >= LEAST_WEIGHT:
            rated.append((-round(sure, 6), -len(entry), entry, weight))
    chosen: dict[str, float] = {}
    reached: dict[str, int] = {}  # toxic documents of the best chosen entry that begins so
    for _, _, entry, weight in sorted(rated):
        if len(chosen) >= ENTRIES:
            break
        starts = beginnings(entry.strip())
        if any(b in chosen for b in starts) or reached.get(entry, 0) >= 0.9 * counts[entry][0]:
            continue
        chosen[entry] = weight
        for b in starts:
            reached[b] = max(reached.get(b, 0), counts[entry][0])
    return chosen


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    forget()
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _harmless(rows: DataFrame, weights: dict[str, float]) -> list[str]:
    """Phrases of a lexicon word and a neighbour that several other documents have and no toxic one."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, matched = (Counter(), Counter()), {}
        for text, toxic in _each(batches):
            words, own = fold(text), set()
            for i, word in enumerate(words):
                if word not in matched:
                    matched[word] = f"{word} " in shared.value or any(b in shared.value for b in beginnings(word))
                if matched[word]:
                    own.update(" ".join(words[a : a + 2]) for a in (i - 1, i) if 0 <= a < len(words) - 1)
            seen[int(toxic == 1)].update(own)
        names = list(set(seen[0]) | set(seen[1]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[k][n] for n in names], pa.int64()) for k in (1, 0))], names=["phrase", "toxic", "other"])

    counted = rows.mapInArrow(phrases, "phrase string, toxic long, other long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    found = counted.where((F.col("toxic") == 0) & (F.col("other") >= LEAST_OTHER)).orderBy(F.desc("other"), "phrase").limit(MOST_EXCEPTIONS)
    return [r["phrase"] for r in found.collect()]


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, fit_docs: int = FIT_DOCS) -> Model:
    """Learn lexicon and model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; all that comes to the driver is bounded."""
    taught = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    taught = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(taught), "doc_id").select("text", "toxic").distinct()

    def toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for text, _ in _each(batches):
            seen.update(features(fold(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])

    counted = rows.where("toxic = 1").mapInArrow(toxic_features, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TOXIC)
    candidates = {r["feature"] for r in counted.orderBy(F.desc("n"), "feature").limit(CANDIDATES).collect()}
    known = docs.sparkSession.sparkContext.broadcast(candidates)

    def both_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = (Counter(), Counter()), [0, 0]
        for text, toxic in _each(batches):
            kind = int(toxic == 1)
            n[kind] += 1
            seen[kind].update(features(fold(text)) & known.value)
        names = list(set(seen[0]) | set(seen[1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(["", *names], pa.string()), pa.array([n[1], *(seen[1][f] for f in names)], pa.int64()), pa.array([n[0], *(seen[0][f] for f in names)], pa.int64())], names=["feature", "toxic", "other"]
        )

    sums = rows.mapInArrow(both_features, "feature string, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).collect()
    counts = {r["feature"]: (r["toxic"], r["other"]) for r in sums}
    n_toxic, n_other = counts.pop("", (0, 0))
    model = Model(choose(counts, n_toxic, n_other), exceptions)
    if not n_toxic or not n_other:
        return model
    model.exceptions = (*exceptions, *_harmless(rows, model.weights))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def document_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value.matcher()
        found = [(toxic, shared.value.sums(matcher, fold(text))) for text, toxic in _each(batches)]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int32()), pa.array([s for _, s in found], pa.list_(pa.float64()))], names=["toxic", "sums"])

    found = rows.mapInArrow(document_sums, "toxic int, sums array<double>").collect()
    x, y = np.array([r["sums"] for r in found]), np.array([r["toxic"] == 1 for r in found], float)
    order = np.lexsort([*x.T, y])  # the same sum whatever the order of rows
    model.beta = logistic(x[order], y[order]).tolist()
    return model


def score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(text, ...)`` to row (a struct of all columns of docs, whatever their names) and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        model = shared.value
        matcher = model.matcher()
        for batch in batches:
            found = [model.score(model.sums(matcher, fold(t.as_py()))) for t in batch.column("row").field("text")]
            yield batch.append_column("score", pa.array(found, pa.float64()))

    rows = docs.select(F.struct(*[F.col("text").cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(scores, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def held_out(column):
    """Rows that teach nothing: the crc32 of the id as text leaves 2 when divided by 4."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(4)) == 2


def fit_held_in(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, labels.where(~held_out(F.col("doc_id"))))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels that are not held out, score all: doc_id, held_out, score, predicted."""
    scored = score_rows(docs.select("doc_id", "text"), fit_held_in(docs, labels)).select(F.col("row.doc_id").alias("doc_id"), "score")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
