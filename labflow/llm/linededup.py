"""Lines that repeat across documents, found with two Bloom filters."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from labflow.llm.common import byte_values, cut, lean, table, unused

#: Bits of a piece of a filter, and the least and most bits of a whole one (32 MB).
PIECE, LEAST_BITS, MOST_BITS = 1 << 18, 1 << 20, 1 << 28
#: Filter bits for each document.
BITS_A_DOCUMENT = 128
#: Most repeated keys that are sent to all executors (16 bytes each); more are joined.
MOST_KEYS = 500_000
#: Suspected keys that a task holds before it hands on their counts.
HELD = 50_000
#: Repeated doc_ids that are sent to all executors (8 bytes each); beyond it, every document is treated as one that may come again.
MOST_TWICE = 500_000
#: What stands for a null doc_id in the order of documents.
LAST = (1 << 63) - 1


def keys(data: bytes) -> list[bytes]:
    """Each line's key: white space stripped at both ends, A-Z lower-cased."""
    return [line.strip() for line in data.lower().split(b"\n")]


def _hashes(batch: pa.RecordBatch, at: int) -> np.ndarray:
    """A hash for each document's each distinct key that isn't empty."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(k) for x in byte_values(batch.column(at)) for k in set(keys(x)) if k], np.uint64)


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _has(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    a, b = _places(h, bits)
    return ((bitmap[a >> 3] >> (a & 7)) & (bitmap[b >> 3] >> (b & 7)) & 1).astype(bool)


def _put(bitmap: np.ndarray, h: np.ndarray, bits: int) -> None:
    for at in _places(h, bits):
        np.bitwise_or.at(bitmap, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def twice_seen(docs: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the keys that at least two documents have (and of some others).

    Each task fills a filter of keys seen once and one of those seen again; the
    pieces of all tasks meet by their place: what two tasks have seen is seen
    twice. The result has bits / 8 bytes, however large the input is.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            h, n = np.unique(_hashes(batch, 0), return_counts=True)
            _put(twice, h[(n > 1) | _has(once, h, bits)], bits)
            _put(once, h, bits)
        step = min(PIECE, bits) >> 3
        for piece in range((bits >> 3) // step):
            o, t = (x[piece * step : (piece + 1) * step] for x in (once, twice))
            if o.any():
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zlib.compress(o.tobytes(), 1)]), pa.array([zlib.compress(t.tobytes(), 1)])], ["piece", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)])], ["piece", "twice"])
        for batch in batches:
            for piece, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if piece != at:
                    if at is not None:
                        yield out()
                    at, once, twice = piece, o.copy(), t.copy()
                else:
                    twice |= t | (once & o)
                    once |= o
        if at is not None:
            yield out()

    filled = lean(docs).select("text").mapInArrow(fill, "piece int, once binary, twice binary")
    merged = filled.repartition("piece").sortWithinPartitions("piece").mapInArrow(merge, "piece int, twice binary")
    whole, step = np.zeros(bits >> 3, np.uint8), min(PIECE, bits) >> 3
    for r in merged.toLocalIterator():
        whole[r["piece"] * step : (r["piece"] + 1) * step] = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
    return whole


def repeated(docs: DataFrame, min_docs: int, seen, bits: int, most_twice: int = MOST_TWICE) -> DataFrame:
    """(digest, first_doc, first_line) of the keys that at least min_docs documents have, counted exactly by their 128-bit hashes.

    Only lines that the filter suspects are shuffled, once for each task and
    key. Rows of one doc_id are one document; those of doc_ids that come again
    hand on key and doc_id, so that each counts once. Each row without a doc_id
    is a document of its own.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc"))
    twice = cut(ids.where("doc is not null").groupBy("doc").count().where("count > 1").select("doc"))
    few = len(twice.limit(most_twice + 1).collect()) <= most_twice
    again = docs.sparkSession.sparkContext.broadcast({r[0] for r in twice.collect()} if few else None)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[bytes, int | None], list] = {}

        def out() -> pa.RecordBatch:
            v, kinds = list(found.values()), (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = ([k[0] for k in found], [k[1] for k in found], [x[0] for x in v], [x[1][0] for x in v], [x[1][1] for x in v])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["digest", "own", "n", "doc", "line"])

        bitmap, short, long, often = seen.value, xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest, again.value
        for batch in batches:
            rows: list[tuple[bytes, int | None, list[int]]] = []
            for doc, x in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), strict=True):
                lines: dict[bytes, int] = {}
                for i, k in enumerate(keys(x)):
                    if k and k not in lines:
                        lines[k] = i
                own = doc if doc is not None and (often is None or doc in often) else None
                rows += [(k, own, [LAST if doc is None else doc, i]) for k, i in lines.items()]
            test = _has(bitmap, np.array([short(r[0]) for r in rows], np.uint64), bits)
            for j in np.flatnonzero(test).tolist():
                k, own, at = rows[j]
                place = (long(k), own)
                if (old := found.get(place)) is None:
                    found[place] = [1, at]
                else:
                    old[0] += 1
                    old[1] = min(old[1], at)
            if len(found) > HELD:
                yield out()
                found.clear()
        if found:
            yield out()

    rows = lean(docs).select(F.col("doc_id").cast("long").alias("doc"), "text").mapInArrow(suspects, "digest binary, own long, n long, doc long, line long")
    at = F.struct("doc", "line")
    if few and not again.value:
        counted = rows.groupBy("digest").agg(F.sum("n").alias("n"), F.min(at).alias("f"))
    else:
        # Of a doc_id that comes again, a key counts once, wherever its rows are.
        once = rows.groupBy("digest", "own").agg(F.sum("n").alias("n"), F.min(at).alias("f"))
        counted = once.groupBy("digest").agg(F.sum(F.when(F.col("own").isNull(), F.col("n")).otherwise(1)).alias("n"), F.min("f").alias("f"))
    return counted.where(F.col("n") >= min_docs).select("digest", F.col("f.doc").alias("first_doc"), F.col("f.line").alias("first_line"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, bits: int | None = None, most_keys: int = MOST_KEYS, most_twice: int = MOST_TWICE) -> DataFrame:
    """docs (doc_id, text, any others) without the lines whose key at least min_docs documents have.

    Adds n_lines (before) and n_dropped; input columns of these names are
    replaced, all others stay, whatever they are called. With keep_first, the
    occurrence in the smallest doc_id and line stays, in each row of that doc_id
    that has the key there (rows without one come last). A null or empty text counts as one empty line; empty keys always
    stay; a text that loses every line becomes empty, a null stays null. Rows of
    one doc_id count as one document, and each row without one as one of its
    own; each row is returned, as often as it comes.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (docs.count() * BITS_A_DOCUMENT).bit_length()))
    seen = spark.sparkContext.broadcast(twice_seen(docs, bits))
    lost = cut(repeated(docs, min_docs, seen, bits, most_twice))
    schema = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    at, by = docs.columns.index("text"), docs.columns.index("doc_id")
    rewrite = lambda batch, texts, n, m: pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[: len(schema) - 2])), pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=schema.names)
    if len(lost.limit(most_keys + 1).select(F.lit(1)).collect()) <= most_keys:
        gone = spark.sparkContext.broadcast({bytes(r[0]): (r[1], r[2]) for r in lost.collect()})

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, digest = gone.value, xxhash.xxh3_128_digest
            for batch in batches:
                texts, n, m = [], [], []
                for doc, x, null in zip(batch.column(by).to_pylist(), byte_values(batch.column(at)), batch.column(at).is_null().to_pylist(), strict=True):
                    lines, kept = x.split(b"\n"), []
                    doc = LAST if doc is None else doc
                    for i, (line, k) in enumerate(zip(lines, keys(x), strict=True)):
                        if not k or (d := digest(k)) not in out or (keep_first and out[d] == (doc, i)):
                            kept.append(line)
                    texts.append(None if null else b"\n".join(kept).decode())
                    n.append(len(lines))
                    m.append(len(lines) - len(kept))
                yield rewrite(batch, texts, n, m)

        return lean(docs).mapInArrow(each, schema)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = seen.value
        for batch in batches:
            rows = [(d, h, i, k) for d, h, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_values(batch.column(2)), strict=True) for i, k in enumerate(keys(x)) if k]
            test = _has(bitmap, np.array([xxhash.xxh3_64_intdigest(r[3]) for r in rows], np.uint64), bits)
            rows = [(*rows[j][:3], xxhash.xxh3_128_digest(rows[j][3])) for j in np.flatnonzero(test).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc", "hash", "line", "digest"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, m = [], [], []
            for x, null, out in zip(byte_values(batch.column(at)), batch.column(at).is_null().to_pylist(), batch.column(len(schema) - 2).to_pylist(), strict=True):
                all_lines, out = x.split(b"\n"), set(out or ())
                texts.append(None if null else b"\n".join(line for i, line in enumerate(all_lines) if i not in out).decode())
                n.append(len(all_lines))
                m.append(len(out))
            yield rewrite(batch, texts, n, m)

    p, own = unused(docs), F.xxhash64("text")
    rows = lean(docs).select(F.col("doc_id").cast("long"), own, "text").mapInArrow(lines, "doc long, hash long, line long, digest binary").join(lost, "digest")
    if keep_first:
        rows = rows.where((F.coalesce("doc", F.lit(LAST)) != F.col("first_doc")) | (F.col("line") != F.col("first_line")))
    out = rows.groupBy(F.col("doc").alias(p + "doc"), F.col("hash").alias(p + "hash")).agg(F.collect_set("line").alias(p + "lost"))
    both = docs.withColumn(p + "own", own).join(out, F.col("doc_id").cast("long").eqNullSafe(F.col(p + "doc")) & (F.col(p + "own") == F.col(p + "hash")), "left")
    return lean(both).select(*docs.columns, p + "lost").mapInArrow(remove, schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM d),
keyed AS (
  SELECT r, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
lost AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN r END) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k IN (SELECT k FROM lost)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k NOT IN (SELECT k FROM lost)), '')) AS kept_sha256
FROM keyed GROUP BY r, doc_id
"""
