"""Language ID: each document's mixture of languages, by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labflow.llm.common import lean, table

#: Labelled rows that a model is fitted on at most, drawn by the hash of doc_id.
MOST_TRAIN = 20_000
#: Hash buckets of character trigrams, and what is added to each count.
BUCKETS, PRIOR = 1 << 16, 0.1
#: Words of a document that count as one draw from its mixture.
UNIT = 8
#: Rounds of EM; penalty of each language of a document in the log-likelihood, times half the log of its units.
ROUNDS, PENALTY = 6, 4.0
#: Characters that are scored at once.
AT_ONCE = 1_000_000
UNDECIDED = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _grams(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A trigram bucket for each letter of a text, and whether a word begins there, by parts of AT_ONCE characters; all but letters counts as a blank.

    Each part sees the characters next to it, so where the cuts are makes no difference.
    """
    lower = text.lower()
    for at in range(0, len(lower), AT_ONCE):
        part = lower[max(0, at - 1) : at + AT_ONCE + 1]
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = _letters()[c]
        c = np.pad(np.where(is_letter, c, 0).astype(np.uint32), (int(at == 0), 1))
        before, own, after = c[:-2], c[1:-1], c[2:]
        before, own, after = (x[: min(AT_ONCE, len(lower) - at)] for x in (before, own, after))
        mixed = (before * np.uint32(0x9E3779B1)) ^ (own * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        letters = np.flatnonzero(own)
        yield (mixed[letters] >> np.uint32(16)).astype(np.int64), before[letters] == 0


def held_out(doc_id: str, modulus: int, rest: int) -> Column:
    """Whether the CRC-32 of doc_id as text leaves rest; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def fit(docs: DataFrame, most: int = MOST_TRAIN) -> tuple[list[str], np.ndarray]:
    """The languages of docs (doc_id, text, lang) and the log-likelihood of each trigram bucket in each.

    Rows with a null lang or text take no part; of more than `most` rows, those
    of the least hashes of doc_id are used.
    """
    rows = docs.where("lang is not null and text is not null")
    total = rows.count()
    if total > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * (most / total)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for grams, _ in _grams(text):
                    g = np.bincount(grams, minlength=BUCKETS)
                    sums[lang] = sums[lang] + g if lang in sums else g
        for lang, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], ["lang", "gram", "n"])

    counts = lean(rows).select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    model = np.full((BUCKETS, max(1, len(langs))), PRIOR)
    for j, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        model[own["gram"].to_numpy(), j] += own["n"].to_numpy()
    return langs, np.log(model / model.sum(axis=0)).astype(np.float32)


def _mixtures(like: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of languages, for documents whose units' log-likelihoods (unit, language) begin at start.

    EM over all languages ranks them; then the leading sets of every size are
    fitted, and the one of the highest penalised likelihood stays. Also whether each document has any unit at all: all have.
    """
    docs, langs = len(start), like.shape[1]
    sizes = np.diff(np.append(start, len(like)))
    of = np.repeat(np.arange(docs), sizes)
    top = like.max(axis=1, keepdims=True)
    chance = np.exp(like - top)
    base = np.add.reduceat(top[:, 0], start)

    def em(share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            w = chance * share[of]
            w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
            share = np.add.reduceat(w, start) / sizes[:, None]
        value = np.add.reduceat(np.log(np.maximum((chance * share[of]).sum(axis=1), 1e-300)), start)
        return share, value + base

    share, _ = em(np.full((docs, langs), 1 / langs), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    best_value, best = np.full(docs, -np.inf), share
    for k in range(1, langs + 1):
        allowed = np.zeros((docs, langs))
        np.put_along_axis(allowed, order[:, :k], 1.0, axis=1)
        own, value = em(allowed / k, ROUNDS if k > 1 else 0)
        value = value - PENALTY * k * 0.5 * np.log(sizes + 1)
        better = value > best_value
        best_value = np.where(better, value, best_value)
        best = np.where(better[:, None], own, best)
    return best, order[:, 0]


def _shares(texts: list[str | None], model: np.ndarray) -> list[np.ndarray | None]:
    """Each text's proportions; None for one without letters."""
    out: list[np.ndarray | None] = [None] * len(texts)
    likes, starts, places, held, rows = [], [], [], 0, 0

    def flush() -> None:
        nonlocal likes, starts, places, held, rows
        if places:
            share, _ = _mixtures(np.concatenate(likes), np.array(starts))
            for i, s in zip(places, share, strict=True):
                out[i] = s
        likes, starts, places, held, rows = [], [], [], 0, 0

    for i, text in enumerate(texts):
        units: list[np.ndarray] = []
        words = 0
        for grams, begins in _grams(text or ""):
            if not len(grams):
                continue
            unit = (words + np.cumsum(begins) - 1) // UNIT
            first = np.flatnonzero(np.diff(unit, prepend=-1))
            sums = np.add.reduceat(model[grams], first, axis=0)
            if units and unit[0] == (words - 1) // UNIT:
                units[-1][-1] += sums[0]
                sums = sums[1:]
            if len(sums):
                units.append(sums)
            words += int(begins.sum())
        if units:
            starts.append(rows)
            places.append(i)
            likes += units
            rows += sum(map(len, units))
            held += len(text)
        if held > AT_ONCE:
            flush()
    flush()
    return out


def identify(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """docs (text, any others) with lang_pred, score and lang_shares (a map).

    lang_pred has the largest share of the chosen set (ties: the first by code
    point), score is that share. Null texts, texts without letters, and all
    texts if there are no languages, get "und", 0 and no shares. Long texts are
    read whole. Input columns of these names are replaced, all others stay;
    repeated rows stay; no rows give no rows.
    """
    docs = docs.drop("lang_pred", "score", "lang_shares")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            shares = _shares(texts, sent.value) if langs else [None] * len(texts)
            best = [None if s is None else int(s.argmax()) for s in shares]
            pred = [UNDECIDED if j is None else langs[j] for j in best]
            score = [0.0 if j is None else min(1.0, float(s[j])) for j, s in zip(best, shares, strict=True)]
            each_ = [[] if s is None else [(langs[j], float(s[j])) for j in np.flatnonzero(s > 1e-6).tolist()] for s in shares]
            more = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(each_, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "lang_pred", "score", "lang_shares"])

    more = docs.sparkSession.createDataFrame([], "lang_pred string, score double, lang_shares map<string,double>").schema
    return lean(docs).mapInArrow(each, type(more)([*docs.schema.fields, *more.fields]))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, model = fit(docs.where(~held_out("doc_id", 4, 2)).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), langs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
