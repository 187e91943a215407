"""Toxicity: a learned, weighted lexicon matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labflow.llm.common import cut, lean, table
from labflow.llm.langid import held_out

#: Labelled rows that a model is fitted on at most, drawn by the hash of doc_id.
MOST_TRAIN = 20_000
#: Characters of a stem; toxic documents with an entry, their share, and its log-odds, at least.
STEMS, LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = (4, 5, 6, 7), 4, 0.004, 3.0
#: Entries that a task holds before it hands on their counts.
HELD = 1_000_000

# Letters of other scripts, and digits and signs, that stand in for Latin letters.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

WORD = re.compile(r"[^\W\d_]+")


@cache
def _folding() -> dict[int, str | None]:
    wide = {0xFF41 + i: chr(0x61 + i) for i in range(26)}
    none = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD])
    return wide | none | {ord(a): b for a, b in (HOMOGLYPHS | SUBSTITUTES).items()}


def fold(text: str) -> str:
    """Lower case, with look-alike letters and substituted digits folded to Latin and invisible characters dropped."""
    return text.lower().translate(_folding())


def _entries(words: set[str]) -> set[str]:
    """Whole words (ending in a blank) and their stems."""
    return {w + " " for w in words} | {w[:n] for w in words for n in STEMS if len(w) >= n}


class Matcher:
    """Finds the lexicon's entries at word starts, but inside exception phrases."""

    def __init__(self, lexicon: dict[str, float], phrases: set[str]):
        self.automaton = ahocorasick.Automaton()
        for phrase in phrases:
            self.automaton.add_word(phrase, (len(phrase), 0.0, 0.0, True))
        # What an entry weighs where a word only begins with it, and where it is the whole word.
        for entry in {e.rstrip() for e in lexicon}:
            stem = lexicon.get(entry, 0.0)
            self.automaton.add_word(entry, (len(entry), stem, max(stem, lexicon.get(entry + " ", 0.0)), False))
        if len(self.automaton):
            self.automaton.make_automaton()

    def find(self, folded: str) -> dict[int, float]:
        """The highest weight that begins at each position."""
        found: dict[int, float] = {}
        spans: list[tuple[int, int]] = []
        if not len(self.automaton):
            return found
        n = len(folded)
        for end, (size, stem, whole, excuse) in self.automaton.iter(folded):
            at = end + 1 - size
            if at and folded[at - 1].isalpha():
                continue
            ends = end + 1 == n or not folded[end + 1].isalpha()
            if excuse:
                if ends:
                    spans.append((at, end))
            elif (weight := whole if ends else stem) > found.get(at, 0.0):
                found[at] = weight
        for a, b in spans:
            for at in [x for x in found if a <= x <= b]:
                del found[at]
        return found

    def features(self, text: str) -> tuple[float, float]:
        """The weight found in a text, and that for each hundred words, both on a log scale."""
        total = sum(self.find(fold(text)).values())
        if not total:
            return 0.0, 0.0
        return math.log1p(total), math.log1p(100 * total / max(1, len(text.split())))


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of the labelled rows of the least hashes; the ids are at most `most`, so they are broadcast."""
    ids = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    ids = cut(ids.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most))
    return cut(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic"))


def _counted(rows: DataFrame, parts) -> DataFrame:
    """(entry, toxic, clean): in how many documents of either label each of parts(text) is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(sums[0].keys() | sums[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([sums[1][k] for k in keys], pa.int64()), pa.array([sums[0][k] for k in keys], pa.int64())], ["entry", "toxic", "clean"])

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[bool(toxic)].update(parts(text))
                if len(sums[0]) + len(sums[1]) > HELD:
                    yield out()
                    sums[0].clear()
                    sums[1].clear()
        yield out()

    return lean(rows).mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _phrases(matcher: Matcher, text: str) -> set[str]:
    """Each word found, with the word before it or behind it."""
    folded = fold(text)
    words = [(m.start(), m.end()) for m in WORD.finditer(folded)]
    found = matcher.find(folded)
    out = set()
    for i, (a, b) in enumerate(words):
        if a in found:
            if i and folded[words[i - 1][1] : a] == " ":
                out.add(folded[words[i - 1][0] : b])
            if i + 1 < len(words) and folded[b : words[i + 1][0]] == " ":
                out.add(folded[a : words[i + 1][1]])
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAIN) -> tuple[dict[str, float], set[str], tuple[float, float, float]]:
    """A lexicon, exception phrases and the three numbers of a logistic curve, from docs (doc_id, text) and labels (doc_id, toxic).

    Of more than `most` labelled rows, those of the least hashes of doc_id are
    used; that alone bounds the lexicon and the phrases, of which every one that
    is telling enough is kept. Null texts, doc_ids and labels take no part; a
    doc_id that comes again counts as often as it does. Without labelled rows
    the lexicon is empty and all texts score alike.
    """
    rows = _sample(docs, labels, most)
    by = {bool(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = by.get(True, 0), by.get(False, 0)
    odds = F.log(((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1)))
    counted = _counted(rows, lambda text: _entries(set(WORD.findall(fold(text)))))
    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * toxic))
    best = counted.where(F.col("toxic") >= least).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    lexicon: dict[str, float] = {}
    for r in sorted(best.collect(), key=lambda r: (len(r["entry"]), r["entry"])):
        # An entry says no more than a stem of it that is as telling.
        if not any(lexicon.get(r["entry"][:n], 0.0) >= r["odds"] - 0.7 for n in STEMS if n < len(r["entry"])):
            lexicon[r["entry"]] = r["odds"]
    matcher = Matcher(lexicon, set())
    excuses = _counted(rows, lambda text: _phrases(matcher, text)).where((F.col("clean") >= 2) & (F.col("toxic") * 4 <= F.col("clean")))
    phrases = {r["entry"] for r in excuses.collect()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(lexicon, phrases)
        for b in batches:
            f = [own.features(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), b.column(1)], ["a", "b", "toxic"])

    data = lean(rows).mapInArrow(measure, "a double, b double, toxic int").toPandas()
    return lexicon, phrases, _logistic(data[["a", "b"]].to_numpy(float), (data["toxic"] > 0).to_numpy(float))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Intercept and slopes by Newton's method with a small ridge; slopes aren't negative."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    ridge = np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
    if (beta[1:] < 0).any() and len(x):
        keep = int(np.argmax(beta[1:])) + 1
        beta = np.array([beta[0], *(max(0.0, b) if i + 1 == keep else 0.0 for i, b in enumerate(beta[1:]))])
    return float(beta[0]), float(beta[1]), float(beta[2])


def score_toxicity(docs: DataFrame, lexicon: dict[str, float], phrases: set[str], curve: tuple[float, float, float]) -> DataFrame:
    """docs (text, any others) with score (0 to 1) and predicted (1 from 0.5 on).

    Null and empty texts have the score of a text in which nothing is found;
    long ones are read whole. Input columns of these names are replaced, all
    others stay; repeated rows stay; no rows give no rows.
    """
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast((lexicon, phrases))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*sent.value)
        for b in batches:
            f = np.array([matcher.features(x or "") for x in b.column(at).to_pylist()]).reshape(-1, 2)
            score = 1 / (1 + np.exp(-np.clip(curve[0] + f @ np.array(curve[1:]), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    more = docs.sparkSession.createDataFrame([], "score double, predicted int").schema
    return lean(docs).mapInArrow(each, type(more)([*docs.schema.fields, *more.fields]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out("doc_id", 5, 0)))
    return score_toxicity(docs, *model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
