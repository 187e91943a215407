"""Exact top-k search by inner product, with a pivot table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labflow.llm.common import cut, table

#: Candidates and queries that meet in one task, pivots, and the vectors they are chosen from.
BLOCK, PIVOTS, SAMPLE = 4096, 32, 1024


def integers(embedding: Column) -> Column:
    """floor(64 * x) of each component as a long array; null for vectors that are null, empty, or hold null or non-finite components. Finite ones that a long can't hold raise an error."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.when((x * 64 >= -(2.0**63)) & (x * 64 < 2.0**63), F.floor(x * 64).cast("long")).otherwise(F.raise_error(F.lit("a component times 64 is beyond a long")).cast("long"))
    return F.when(embedding.isNotNull() & (F.size(embedding) > 0) & fine, F.transform(wide, whole))


def choose_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Vectors far from each other: each next one is farthest from those chosen."""
    if not len(vectors):
        return vectors
    at, far = 0, np.full(len(vectors), np.inf)
    chosen = []
    for _ in range(min(n, len(vectors))):
        chosen.append(at)
        far = np.minimum(far, ((vectors.astype(float) - vectors[at].astype(float)) ** 2).sum(axis=1))
        at = int(far.argmax())
    return vectors[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot table: the distance of each vector from each pivot."""
    if not len(x) * len(pivots):
        return np.zeros((len(x), len(pivots)))
    fine = pivots.astype(float)
    return np.concatenate([np.sqrt(((x[i : i + 256, None, :].astype(float) - fine) ** 2).sum(axis=2)) for i in range(0, len(x), 256)])


def _scorer(x: np.ndarray, q: np.ndarray) -> np.dtype:
    """The smallest kind of number in which inner products of x and q are exact: floats of 32 or 64 bits, longs, else Python's."""
    most = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * x.shape[1]
    return np.dtype(np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64 if most < 2**62 else object)


def floors(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[int | None]:
    """Each query's k-th best score among the vectors x of other ids: the k-th best of all is no less. None, if there are fewer, or a long can't hold it."""
    if len(x) < k:
        return [None] * len(q)
    kind, out = _scorer(x, q), []
    for i in range(0, len(q), 256):
        scores = q[i : i + 256].astype(kind) @ x.T.astype(kind)
        for own, row in zip(query_ids[i : i + 256].tolist(), scores, strict=True):
            others = row[ids != own]
            low = (np.partition(others, len(others) - k)[len(others) - k] if kind != object else sorted(others)[-k]) if len(others) >= k else None
            out.append(None if low is None or not -(1 << 63) <= int(low) < 1 << 63 else int(low))
    return out


def search(ids: np.ndarray, x: np.ndarray, table_x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, table_q: np.ndarray, norm_p: np.ndarray, least: list[int | None], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Each query's k best of the candidates that score no less than its `least`, by score and then smaller id, and how many were evaluated; its own id is no candidate. Scores that a long can't hold raise an error.

    |d(q, p) - d(x, p)| bounds the distance of q and x from below for each pivot
    p, and so their inner product, (|q|^2 + |x|^2 - d^2) / 2, from above. The
    distances come from the pivot table. Candidates are evaluated by falling
    bound, until the next bound is under the k-th score (or the least): what
    remains can neither win nor tie.
    """
    table_x, table_q = table_x.T.astype(np.float32), table_q.astype(np.float32)
    reach, gap = table_x.max(axis=1, initial=0).astype(float), np.empty_like(table_x)
    fine_x, fine_q = x.astype(float), q.astype(float)
    norm_x, norm_q = (fine_x * fine_x).sum(axis=1), (fine_q * fine_q).sum(axis=1)
    kind = _scorer(x, q)
    values = x.astype(kind)
    for i, own in enumerate(query_ids.tolist()):
        # Less what rounding can make of the distances, which have 24 bits here.
        low = np.zeros(len(x))
        if len(norm_p):
            np.subtract(table_x, table_q[i][:, None], out=gap)
            np.abs(gap, out=gap)
            low = np.maximum(gap.max(axis=0).astype(float) - 1e-6 * float((reach + table_q[i] + norm_p).max()), 0)
        bound = (norm_x + norm_q[i] - low * low) / 2
        bound += 1e-9 * (norm_x + norm_q[i]) + 1e-6
        bound[ids == own] = -np.inf
        best_ids, best, evaluated = np.zeros(0, np.int64), np.zeros(0, kind), 0
        floor = -np.inf if least[i] is None else float(least[i]) - 1e-9 * abs(float(least[i]))
        size, rest, asked = max(64, 2 * k), np.flatnonzero((bound > -np.inf) & (bound >= floor)), q[i].astype(kind)
        while len(rest):
            if len(rest) > size:
                split = np.argpartition(-bound[rest], size - 1)
                now, rest = rest[split[:size]], rest[split[size:]]
            else:
                now, rest = rest, rest[:0]
            scores = np.take(values, now, axis=0) @ asked
            evaluated += len(now)
            if least[i] is not None:
                now, scores = now[scores >= least[i]], scores[scores >= least[i]]
            best, best_ids = np.concatenate([best, scores]), np.concatenate([best_ids, ids[now]])
            order = np.lexsort((best_ids, -best))[:k] if kind != object else np.array(sorted(range(len(best)), key=lambda j: (-best[j], best_ids[j]))[:k], int)
            best, best_ids = best[order], best_ids[order]
            if len(best) == k:
                rest = rest[bound[rest] >= float(best[-1])]
            size *= 4
        if kind == object and any(not -(1 << 63) <= s < 1 << 63 for s in best):
            raise OverflowError(f"a score of query {own} is beyond a long")
        yield own, best_ids, best, evaluated


def _vectors(column: pa.Array | pa.ChunkedArray, kind: type = np.int64) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1) if n else np.zeros((0, 1), kind)


def pivot_table(rows: DataFrame, pivots: dict[int, np.ndarray], sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """rows (vec_id, v, dim, is_query) with far, the distances from the pivots of their dimension, and for queries least, from the sample's floors()."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, asks, ids = b.column("dim").to_numpy(), b.column("is_query").to_numpy(zero_copy_only=False).astype(bool), b.column("vec_id").to_numpy()
            far: list[list[float]] = [[]] * b.num_rows
            least: list[int | None] = [None] * b.num_rows
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                v = _vectors(b.column("v").take(pa.array(own)))
                for i, row in zip(own.tolist(), distances(v, pivots.get(d, np.zeros((0, d)))).tolist(), strict=True):
                    far[i] = row
                if d in sample and asks[own].any():
                    for i, low in zip(own[asks[own]].tolist(), floors(*sample[d], ids[own[asks[own]]], v[asks[own]], k), strict=True):
                        least[i] = low
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(far, pa.list_(pa.float32())), pa.array(least, pa.int64())], names=[*b.schema.names, "far", "least"])

    return rows.select("vec_id", "v", "dim", "is_query").mapInArrow(each, "vec_id long, v array<long>, dim int, is_query boolean, far array<float>, least long")


def top_k(vectors: DataFrame, queries: Column, k: int = 20, block: int = BLOCK, shares: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with other rows of vectors (vec_id, embedding).

    Components count as floor(64 * x). Rows with a null vec_id, or a vector that
    is null, empty or holds null or non-finite components, take no part. Every
    other row is a candidate, repeated vec_ids included, and a query is all rows
    of its vec_id; it meets only vectors of its own dimension, of other vec_ids.
    Components and scores that a long can't hold raise an error. Fewer candidates than k give fewer rows, no rows none.
    The pivot table is computed once and stored with the vectors, as is the score
    that a query's k-th best is no less than. Queries and candidates meet in
    blocks of about `block` each. With shares, the result is (query_id, met,
    evaluated) instead: how many candidates a query met, and how many it took.
    """
    own = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = cut(own.where("v is not null").withColumn("dim", F.size("v")))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_query").cast("long")).alias("m")).agg(F.max("n"), F.max("m")).first()
    parts, query_parts = (max(1, -(-(x or 0) // block)) for x in sizes)
    by_hash = F.xxhash64("vec_id", "v")
    drawn: dict[int, list] = {}
    for r in rows.orderBy(by_hash, "vec_id").limit(SAMPLE).select("vec_id", "v").collect():
        drawn.setdefault(len(r[1]), []).append(r)
    sample = {d: (np.array([r[0] for r in x], np.int64), np.array([r[1] for r in x], np.int64)) for d, x in drawn.items()}
    pivots = {d: choose_pivots(x, PIVOTS) for d, (_, x) in sample.items()}
    norms = {d: np.sqrt((p.astype(float) ** 2).sum(axis=1)) for d, p in pivots.items()}
    rows = cut(pivot_table(rows, pivots, sample, k))
    part = F.pmod(by_hash, F.lit(parts))
    query_part = F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(query_parts))
    both = ["vec_id", "v", "far", "dim"]
    wide = rows.select(*both, F.lit(None).cast("long").alias("least"), part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("query_part"), F.lit(False).alias("asks"))
    asked = rows.where("is_query").select(*both, "least", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), query_part.alias("query_part"), F.lit(True).alias("asks"))
    names = ["query_id", "met", "evaluated"] if shares else ["query_id", "vec_id", "score"]

    def each(group: pa.Table) -> pa.Table:
        asks, ids = group.column("asks").to_numpy(), group.column("vec_id").to_numpy()
        out: tuple[list, list, list] = ([], [], [])
        if asks.any() and not asks.all():
            v, far = _vectors(group.column("v")), _vectors(group.column("far"), np.float32)
            least = group.column("least").filter(pa.array(asks)).to_pylist()
            far, norm = (far, norms[v.shape[1]]) if v.shape[1] in norms else (np.zeros((len(ids), 0), np.float32), np.zeros(0))
            for query, best, score, evaluated in search(ids[~asks], v[~asks], far[~asks], ids[asks], v[asks], far[asks], norm, least, k):
                n = 1 if shares else len(best)
                out[0].extend([query] * n)
                out[1].append(np.array([(ids[~asks] != query).sum()]) if shares else best)
                out[2].append(np.array([evaluated]) if shares else score.astype(np.int64))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table(dict(zip(names, (pa.array(out[0], pa.int64()), pa.array(join(out[1]), pa.int64()), pa.array(join(out[2]), pa.int64())), strict=True)))

    found = wide.unionAll(asked).groupBy("dim", "part", "query_part").applyInArrow(each, ", ".join(f"{n} long" for n in names))
    if shares:
        return found.groupBy("query_id").agg(F.sum("met").alias("met"), F.sum("evaluated").alias("evaluated"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
