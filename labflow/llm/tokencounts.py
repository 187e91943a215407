"""Token counts of sections, by the offsets of tokens of whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labflow.llm.bpe import AT_ONCE, Codec, codec
from labflow.llm.common import lean, table

#: Who gets a token that crosses a boundary: the section of its first character, that of most of its characters (ties: the first), or each by its share.
RULES = ("first", "most", "share")


def token_spans(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters [start, end) that each token touches; lengths: the tokens' bytes. A character cut by tokens belongs to all of them."""
    begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    char_of = np.concatenate([np.cumsum(begins) - 1, [begins.sum()]])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    return char_of[starts], char_of[np.maximum(ends - 1, starts)] + (lengths > 0)


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and of those the tokens that touch another one too.

    bounds: where the sections begin, and the end of the last; they follow each
    other. An interval join of sorted spans: a token's first and last section
    are found by bisection, and only tokens that cross are looked at closely.
    """
    n = len(bounds) - 1
    first = np.clip(np.searchsorted(bounds, starts, "right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(bounds, np.maximum(ends - 1, starts), "right") - 1, 0, n - 1)
    counts = np.bincount(first, minlength=n).astype(float)
    cross = np.flatnonzero(first != last)
    wide = last[cross] - first[cross] + 1
    of = np.repeat(np.arange(len(cross)), wide)
    ends_ = np.cumsum(wide)
    section = first[cross][of] + np.arange(len(of)) - np.repeat(ends_ - wide, wide)
    cover = np.minimum(bounds[section + 1], ends[cross][of]) - np.maximum(bounds[section], starts[cross][of])
    of, section, cover = of[cover > 0], section[cover > 0], cover[cover > 0]
    shared = np.bincount(section, minlength=n)
    if rule != "first" and len(of):
        counts -= np.bincount(first[cross[np.unique(of)]], minlength=n)
        if rule == "most":
            order = np.lexsort((section, -cover, of))
            best = order[np.append(True, of[order][1:] != of[order][:-1])]
            counts += np.bincount(section[best], minlength=n)
        else:
            counts += np.bincount(section, cover / np.bincount(of, cover)[of], minlength=n)
    return counts, shared


def section_tokens(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, rule: str = "most") -> DataFrame:
    """(doc_id, section, char_start, char_end, n_tokens, n_shared, doc_tokens): a row for each line of docs (doc_id, text).

    Each whole text is encoded once; the rule says which line gets a token that
    crosses from one into another, so a document's n_tokens add up to
    doc_tokens. Null and empty texts have one empty section without tokens;
    repeated rows come out as often; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at + 1, len(texts[at])
                while to < len(texts) and size + len(texts[to]) <= AT_ONCE:
                    size += len(texts[to])
                    to += 1
                yield sections(own, b.column(0).slice(at, to - at), texts[at:to])
                at = to

    def sections(own: Codec, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        """All texts at once: they stand in a row, and each ends with a place of its own, so that an empty last line has one too."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes + 1) - sizes - 1
        points = np.frombuffer("\0".join(texts).encode("utf-32-le"), np.uint32)
        feeds = np.flatnonzero(points == 10)
        lines = np.bincount(np.searchsorted(begin, feeds, "right") - 1, minlength=len(texts)) + 1
        bounds = np.concatenate([np.sort(np.concatenate([begin, feeds + 1]), kind="stable"), [int(sizes.sum()) + len(texts)]])
        tokens = list(own.encode_all(texts))
        n = np.fromiter(map(len, tokens), np.int64, len(texts))
        starts, ends = token_spans("".join(texts).encode(), own.lengths[np.concatenate(tokens)]) if n.any() else (np.zeros(0, np.int64),) * 2
        gap = np.repeat(np.arange(len(texts)), n)
        counts, shared = attribute(starts + gap, ends + gap, bounds, rule)
        of = np.repeat(np.arange(len(texts)), lines)
        last = np.cumsum(lines) - 1
        stop = bounds[1:].copy()
        stop[last] -= 1
        section = np.arange(len(of)) - np.repeat(last + 1 - lines, lines)
        values = (section.astype(np.int32), bounds[:-1] - begin[of], stop - begin[of], counts, shared, n[of])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *map(pa.array, values)], ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_shared", "doc_tokens"])

    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, section int, char_start long, char_end long, n_tokens double, n_shared long, doc_tokens long")


def op9_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
