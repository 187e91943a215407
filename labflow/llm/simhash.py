"""SimHash near-duplicates, found by the generalised pigeonhole principle."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labflow.llm.common import byte_values, cut, give_back, lean, let_go, small, table
from labflow.llm.components import components

BITS = 64
#: Shingles that are counted at once, and pairs that are compared at once.
CHUNK, PAIRS = 1 << 16, 1 << 18
#: Edges that a task holds before it reduces them to a forest.
EDGES = 1 << 17
#: Words of 64 parity bits that bound how many shingles two texts don't share.
MARKS = 4
#: Least hashes of shingles that make up the key of a band.
BAND_ROWS = 4
#: How many times the spanning forests of a round the next one keeps.
MORE = 8
#: Neighbours of a projection that are probed at most; thresholds that need more are not chosen.
MOST_PROBES = 4096
#: Cells about a projection of more rows than this are dealt out in blocks of as many.
HOT = 1 << 15
#: Cells of bands that hold more than one in so many of the rows are dealt out too, if they have over LEAST_HOT.
SHARE, LEAST_HOT = 512, 256
#: Cost of comparing two fingerprints, against moving one probe.
COMPARE = 0.02


def shingles(data: bytes, width: int) -> Iterator[list[bytes]]:
    """The shingles of a lower-cased text by chunks: words joined by a space, all of them if there are fewer."""
    words = data.lower().split()
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    for at in range(0, n, CHUNK):
        yield [line[i:j] for i, j in zip(starts[at : min(n, at + CHUNK)].tolist(), last[at : at + CHUNK].tolist(), strict=True)]


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes h for fingerprint k, independent of those for others; h itself for 0."""
    if not k:
        return h
    h = h ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """The XXH64 (seed 42) of a text's shingles, each once, in order."""
    parts = [np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in part), np.uint64, len(part))) for part in shingles(data, width)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _set_bits(hashes: np.ndarray, k: int = 0) -> np.ndarray:
    """How many of the hashes, mixed for fingerprint k, have each bit."""
    return np.unpackbits(mixed(hashes, k).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def set_fingerprints(hashes: np.ndarray, times: int = 1) -> list[int]:
    """`times` fingerprints of a shingle_set: bit i is 1 if set in over half the hashes; 0 without any."""
    counts = np.zeros((times, BITS), np.int64)
    for at in range(0, len(hashes), CHUNK):
        for k in range(times):
            counts[k] += _set_bits(hashes[at : at + CHUNK], k)
    return np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def fingerprint(data: bytes, width: int, times: int = 1) -> list[int]:
    """`times` fingerprints of a text's different shingles: texts of equal sets have equal ones, however often a passage repeats."""
    return set_fingerprints(shingle_set(data, width), times)


def repeats_fingerprint(data: bytes, width: int) -> int:
    """The SimHash with repeats: bit i is 1 if set in over half of all shingles' XXH64 (seed 42), each as often as it occurs; 0 without words."""
    counts, n = np.zeros((1, BITS), np.int64), 0
    for part in shingles(data, width):
        counts[0] += _set_bits(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in part), np.uint64, len(part)))
        n += len(part)
    return int(np.packbits(2 * counts > n, axis=1, bitorder="little").view("<i8")[0, 0])


def fingerprints(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of each row's whole text, as a signed long. Null and blank texts have 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([repeats_fingerprint(x, width) for x in byte_values(b.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])

    return lean(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(each, "doc_id long, fp long")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many rows of prints (fp) there are, and how often two bits are both set: a 64 x 64 table over all rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            yield from ()
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), *(pa.array(both[:, j]) for j in range(BITS))], ["i", *(f"c{j}" for j in range(BITS))])

    sums = prints.select("fp").mapInArrow(each, "i int, " + ", ".join(f"c{j} long" for j in range(BITS)))
    rows = sums.groupBy("i").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(BITS))).collect()
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r[0]] = r[1:]
    return prints.count(), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits to parts of near equal width; correlated bits go together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    like = np.abs(np.divide(both / max(n, 1) - np.outer(p, p), spread, out=np.zeros((BITS, BITS)), where=spread > 0))
    np.fill_diagonal(like, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        room = len(left) // (parts - k)
        own = [max(sorted(left), key=lambda i: like[i, sorted(left)].max())]
        left.discard(own[0])
        while len(own) < room:
            best = max(sorted(left), key=lambda i: like[i, own].mean())
            own.append(best)
            left.discard(best)
        groups.append(sorted(own))
    return groups


def allocate(n: int, both: np.ndarray, most: int) -> tuple[list[list[int]], list[int]]:
    """Parts and their thresholds, of least estimated cost.

    Two fingerprints within `most` bits differ in at most t_i bits of some part
    i if the sum of t_i + 1 is most + 1 (t_i = -1 skips a part). For each number
    of parts, dynamic programming shares out this sum; the cost of a threshold
    is its probes plus its estimated candidates, from each bit's own frequency.
    Thresholds of over MOST_PROBES probes are left out; eight parts of eight
    bits can always be shared out without them.
    """
    n = max(n, 1)
    p = np.diag(both) / n
    agree = p * p + (1 - p) * (1 - p)
    best: tuple[float, list[list[int]], list[int]] | None = None
    for parts in range(2, 9):
        groups = group_bits(n, both, parts)
        costs = []
        for own in groups:
            chance = np.array([1.0])
            for b in own:
                chance = np.convolve(chance, [agree[b], 1 - agree[b]])
            within = np.cumsum(chance)
            probes = np.cumsum([math.comb(len(own), t) for t in range(len(own) + 1)])
            costs.append([0.0, *(float(n * probes[t] + COMPARE * n * n * within[t]) for t in range(min(most, len(own)) + 1) if probes[t] <= MOST_PROBES)])
        table_: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            table_ = {s: min((table_[s - t][0] + cost[t], [*table_[s - t][1], t - 1]) for t in range(len(cost)) if s - t in table_) for s in range(most + 2) if any(s - t in table_ for t in range(len(cost)))}
        if most + 1 not in table_:
            continue
        total, chosen = table_[most + 1]
        if best is None or total < best[0]:
            best = (total, groups, chosen)
    assert best is not None
    return best[1], best[2]


def forests(a: np.ndarray, b: np.ndarray, d: np.ndarray, k: int = 1) -> tuple[list[int], list[int]]:
    """(kept, gone): the places of k edge-disjoint spanning forests of the edges, and of the edges left out.

    Each forest is the least (by d, then a and b) of what those before left.
    Nodes that a forest joins are joined in those before it, so an edge that the
    last one doesn't need is left out after one look. Of repeated edges, one counts.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = [list(range(len(nodes))) for _ in range(k)]

    def top(own: list[int], x: int) -> int:
        while own[x] != x:
            own[x] = x = own[own[x]]
        return x

    x, y = ends[: len(a)].tolist(), ends[len(a) :].tolist()
    kept, gone, last = [], [], (-1, -1)
    for e in np.lexsort((b, a, d)).tolist():
        now = (x[e], y[e])
        if now == last:
            continue
        last = now
        if top(up[-1], now[0]) == top(up[-1], now[1]):
            gone.append(e)
            continue
        for own in up:
            i, j = top(own, now[0]), top(own, now[1])
            if i != j:
                own[i] = j
                kept.append(e)
                break
    return kept, gone


def parities(hashes: np.ndarray) -> list[int]:
    """MARKS words of bits: whether an odd number of the hashes falls on each. Two sets' bits differ in no more places than the sets."""
    odd = np.bincount((hashes % np.uint64(64 * MARKS)).astype(np.int64), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


@cache
def _band_hashes(bands: int) -> tuple[np.ndarray, np.ndarray]:
    """What each of bands * BAND_ROWS hash functions xors and multiplies with."""
    seeds = np.arange(1, bands * BAND_ROWS + 1, dtype=np.uint64)[:, None]
    return mixed(seeds, 1), mixed(seeds, 2) | np.uint64(1)


def band_keys(hashes: np.ndarray, bands: int) -> list[int]:
    """A key for each band of a shingle_set: the least hashes by BAND_ROWS functions.

    Two sets with a share s of their union in common agree in a band with
    probability s ** BAND_ROWS: at 0.8, 24 bands miss 3 of a million pairs.
    """
    low = np.full(bands * BAND_ROWS, (1 << 64) - 1, np.uint64)
    flip, times = _band_hashes(bands)
    for at in range(0, len(hashes), 4096):
        h = (hashes[None, at : at + 4096] ^ flip) * times
        low = np.minimum(low, (h ^ (h >> np.uint64(32))).min(axis=1))
    low = low.astype("<u8").reshape(bands, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in low], np.uint64).view(np.int64).tolist()


def _pairs(rows: tuple[np.ndarray, ...], start: np.ndarray, most: int, least: float, parts: list[tuple[int, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links between the indexed rows of each cell and its later rows; a link that several cells find is given in one. start: the cells' first rows; indexed rows come first. Without parts, all rows of a cell are candidates."""
    part, probe, fp, node, root, *more = rows
    end = np.append(start[1:], len(fp))
    cell = np.searchsorted(start, np.arange(len(fp)), "right") - 1
    index = np.flatnonzero(~probe)
    counts = end[cell[index]] - 1 - index
    index, counts = index[counts > 0], counts[counts > 0]
    total = np.cumsum(counts)
    at = 0
    while at < len(index):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + PAIRS, "right")))
        left = np.repeat(index[at:to], counts[at:to])
        right = left + 1 + np.arange(len(left)) - np.repeat(total[at:to] - counts[at:to] - base, counts[at:to])
        far = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64))
        near = np.flatnonzero((far <= most) & (root[left] != root[right]))
        left, right, far = left[near], right[near], far[near]
        both = (fp[left] ^ fp[right]).view(np.uint64)
        own = np.full(len(left), not parts)
        if parts:
            first = np.full(len(left), -1)
            for number, mask, limit in reversed(parts):
                first[np.bitwise_count(both & np.uint64(mask)) <= limit] = number
            own = (first == part[left]) & (~probe[right] | (node[left] < node[right]))
        if more:
            size, *marks = more
            own &= np.minimum(size[left], size[right]) >= least * np.maximum(size[left], size[right])
            apart = sum(np.bitwise_count((x[left] ^ x[right]).view(np.uint64)).astype(np.int64) for x in marks)
            own &= apart <= (1 - least) / (1 + least) * (size[left].astype(np.int64) + size[right]) + 1e-6
            # Forests take the likeliest links first.
            far = far if parts else apart
        left, right, far = left[own], right[own], far[own]
        if len(left):
            x, y = node[left], node[right]
            yield np.minimum(x, y), np.maximum(x, y), far.astype(np.int16)
        at = to


def verify(batches: Iterator[pa.RecordBatch], most: int, parts: list[tuple[int, int, int]], k: int = 1, least: float = 0.0) -> Iterator[pa.RecordBatch]:
    """Rows (part, key, block, probe, fp), sorted by them, to k forests of the links (a, b) that a task finds.

    parts has each part's number, mask and threshold; none, if all rows of a cell are candidates. Rows may go on with node,
    root, size and parities: then links are between nodes of different roots
    that can have `least` of their shingles in common by their sizes and
    parities, and a row (a, null) names each end of a link that the forests left
    out.
    """
    edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    new, held, rest = 0, 0, None
    ends = np.zeros(0, np.int64)

    def reduce() -> None:
        nonlocal edges, ends
        a, b, d = (np.concatenate(x) for x in zip(*edges, strict=True))
        kept, gone = forests(a, b, d, k)
        edges = [(a[kept], b[kept], d[kept])]
        ends = np.unique(np.concatenate([ends, a[gone], b[gone]]))

    def compare(part: np.ndarray, key: np.ndarray, block: np.ndarray, probe: np.ndarray, fp: np.ndarray, *more: np.ndarray) -> None:
        nonlocal new, held
        start = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
        for e in _pairs((part, probe, fp, *(more or (fp, fp))), np.concatenate([[0], start]), most, least, parts):
            edges.append(e)
            new += len(e[0])
            if new > max(EDGES, held):
                reduce()
                new, held = 0, len(edges[0][0])

    tell = False
    for b in batches:
        if not b.num_rows:
            continue
        tell = b.num_columns > 5
        now = tuple(x.to_numpy(zero_copy_only=False) for x in b.columns)
        if rest is not None:
            now = tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
        part, key, block = now[:3]
        # The last cell may go on in the next batch.
        same = np.flatnonzero((part != part[-1]) | (key != key[-1]) | (block != block[-1]))
        end = int(same[-1]) + 1 if len(same) else 0
        if end:
            compare(*(x[:end] for x in now))
        rest = tuple(x[end:] for x in now)
    if rest is not None:
        compare(*rest)
    if edges:
        reduce()
        yield pa.RecordBatch.from_arrays([pa.array(edges[0][0], pa.int64()), pa.array(edges[0][1], pa.int64())], ["a", "b"])
    if tell and len(ends):
        yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.nulls(len(ends), pa.int64())], ["a", "b"])


def links(prints: DataFrame, most: int, hot: int = HOT, k: int = 1, least: float = 0.0) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that differ in at most `most` bits.

    They are enough to reach whatever all links reach: each task reduces its
    own to k spanning forests, so a dense group gives at most k times as many
    rows as it has members, not its square. Every fingerprint is probed with all
    neighbours of its projection within the part's threshold; what meets in a
    cell is verified on all 64 bits. Cells that rows of a projection of over
    `hot` rows go to are cut into blocks of about `hot` rows, and each two blocks
    meet in a task of their own. With prints (fp, node, root, size, parities),
    verify() says what links and which further rows come.
    """
    n, both = bit_statistics(prints)
    groups, limits = allocate(n, both, most)
    own = prints.columns
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    probes, around = [], {}
    for part, (bits, limit) in enumerate(zip(groups, limits, strict=True)):
        if limit >= 0:
            mask = signed(sum(1 << b for b in bits))
            flips = [signed(sum(1 << b for b in c)) for t in range(limit + 1) for c in combinations(bits, t)]
            around[part] = F.expr("array(" + ",".join(f"{x + 1}L - 1L" if x == -(1 << 63) else f"{x}L" for x in flips) + ")")
            at = F.explode(around[part]).alias("flip") if len(flips) > 1 else F.lit(0).cast("long").alias("flip")
            probes.append(prints.select(*own, at).select(F.lit(part).alias("part"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).bitwiseXOR(F.col("flip")).alias("key"), (F.col("flip") != 0).alias("probe"), *own))
    cells = probes[0]
    for more in probes[1:]:
        cells = cells.unionAll(more)
    large = cut(cells.where("not probe").groupBy("part", "key").count().where(F.col("count") > hot))
    if large.isEmpty():
        cells = cells.withColumn("block", F.lit(0))
    else:
        met = None
        for part, flips in around.items():
            now = large.where(F.col("part") == part).select("part", "key", "count", F.explode(flips).alias("flip"))
            met = now if met is None else met.unionAll(now)
        met = met.groupBy("part", F.col("key").bitwiseXOR(F.col("flip")).alias("key")).agg(F.ceil(F.sum("count") / hot).cast("long").alias("blocks"))
        cells = _in_blocks(cells, met, "fp" if len(own) == 1 else "node")
    parts = [(k_, sum(1 << b for b in bits), limit) for k_, (bits, limit) in enumerate(zip(groups, limits, strict=True)) if limit >= 0]
    return _verified(cells.select("part", "key", "block", "probe", *own), most, parts, k, least)


def _in_blocks(cells: DataFrame, met: DataFrame, by: str) -> DataFrame:
    """cells with block: those in met (part, key, blocks) are cut into blocks by the hash of a column, and each two blocks meet."""
    cells = cells.join(small(cut(met), 100_000), ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    cells = cells.withColumn("home", F.pmod(F.xxhash64(by), F.col("blocks")))
    cells = cells.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return cells.withColumn("block", F.least("home", "other") * F.col("blocks") + F.greatest("home", "other"))


def _verified(cells: DataFrame, most: int, parts: list[tuple[int, int, int]], k: int, least: float) -> DataFrame:
    cells = cells.repartition("part", "key", "block").sortWithinPartitions("part", "key", "block", "probe")
    return cells.mapInArrow(lambda batches: verify(batches, most, parts, k, least), "a long, b long")


def band_links(prints: DataFrame, hot: int = HOT, k: int = 1, least: float = 0.0) -> DataFrame:
    """(a, b): links and further rows, as links() gives them, between nodes of prints (bands, node, root, size, parities) that agree in a band.

    Cells of more than `hot` rows, or than one in SHARE of all rows, are cut
    into blocks.
    """
    own = [c for c in prints.columns if c != "bands"]
    cells = prints.select(F.posexplode("bands").alias("part", "key"), F.lit(False).alias("probe"), F.lit(0).cast("long").alias("fp"), *own)
    bands = prints.select(F.sum(F.size("bands"))).first()[0] or 0
    hot = min(hot, max(LEAST_HOT, bands // SHARE))
    met = cut(cells.groupBy("part", "key").count().where(F.col("count") > hot)).select("part", "key", F.ceil(F.col("count") / hot).cast("long").alias("blocks"))
    cells = cells.withColumn("block", F.lit(0)) if met.isEmpty() else _in_blocks(cells, met, "node")
    return _verified(cells.select("part", "key", "block", "probe", "fp", *own), 0, [], k, least)


def _mixed(batches: Iterator[pa.RecordBatch], width: int, times: int, bands: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, text) to (node, how many different shingles, their parities, their first `times` fingerprints, their keys in bands)."""
    for b in batches:
        sets = [shingle_set(x, width) for x in byte_values(b.column(1))]
        sizes, marks = pa.array(map(len, sets), pa.int32()), [parities(x) for x in sets]
        found = [set_fingerprints(x, times) for x in sets]
        columns = {"node": b.column(0), "size": sizes} | {f"mark{k}": pa.array([x[k] for x in marks], pa.int64()) for k in range(MARKS)}
        columns |= {f"fp{k}": pa.array([x[k] for x in found], pa.int64()) for k in range(times)}
        yield pa.RecordBatch.from_pydict(columns | {"bands": pa.array([band_keys(x, bands) for x in sets], pa.list_(pa.int64()))})
    give_back()


def _alike(width: int, least: float):
    """Keep the pairs (a, b, x, y) whose texts x and y share enough shingles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(byte_values(b.column(2)), byte_values(b.column(3)), strict=True):
                p, q = shingle_set(x, width), shingle_set(y, width)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(shared >= least * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return each


def near_duplicates(docs: DataFrame, width: int = 5, most: int = 4, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text).

    Fingerprints within `most` bits link. component_id is the smallest doc_id
    that can be reached, itself included. Texts that are null or blank have
    fingerprint 0 and link like any other; repeated rows come out as often as
    they come in; a null doc_id is kept and never names a component (null, if a
    component has no other); an empty table gives no rows; other columns are
    ignored.
    """
    rows = cut(fingerprints(docs, width))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = components(links(prints.select("fp"), most, hot))
    reach = named.join(prints, named["node"] == prints["fp"]).select("fp", "root", "least")
    named = reach.select("fp", "root").join(reach.groupBy("root").agg(F.min("least").alias("low")), "root").select("fp", "low")
    classes = cut(prints.join(named, "fp", "left").select("fp", F.coalesce("low", "least").alias("component_id")))
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def text_node(docs: DataFrame) -> Column:
    """A 64-bit name of a text, another for each different text of docs (text).

    It is the text's XXH64; texts that share it without being equal, as a second
    hash tells (of 10^10 texts, a few are to be expected), are named by that.
    """
    node, other = F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))
    both = docs.select(node.alias("node"), other.alias("other")).groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high"))
    shared = [r[0] for r in both.where("low <> high").select("node").collect()]
    return F.when(node.isin(shared), other).otherwise(node) if shared else node


def similar(docs: DataFrame, width: int = 5, most: int = 9, least: float = 0.8, times: int = 2, hot: int = HOT, bands: int = 0) -> DataFrame:
    """(doc_id, component_id) for each row of docs (doc_id, text): near-duplicates by fingerprints or bands, each link held against the texts.

    Texts link if one of their `times` independent fingerprints differs in at
    most `most` bits, or one of their `bands` keys is the same, and they have `least` of their shingles in common; several
    fingerprints reach pairs that one misses by chance. A text's fingerprints
    are of its different shingles, as is the similarity; those after the first
    are of their hashes, mixed once more.

    Rounds find all such links that matter: in each, a task hands on spanning
    forests of its candidates, which are held against the texts. Candidates that
    the forests left out and whose ends the links found have not joined come up
    again in the next round, among the texts at their ends alone and with MORE
    times as many forests, until none is left out. So dense groups of copies
    are done after forests of one round, and all pairs are compared only where
    they are indeed unlike.

    component_id is as for near_duplicates. Null, empty and blank texts are alike.
    """
    node = text_node(docs)
    roots = text_roots(docs, width, most, least, times, hot, bands, node)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node.alias("node")).join(roots, "node")
    low = cut(ids.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return ids.join(low, "root").select("doc_id", "component_id")


def text_roots(docs: DataFrame, width: int, most: int, least: float, times: int, hot: int = HOT, bands: int = 0, node: Column | None = None) -> DataFrame:
    """(node, root) for each different text of docs (text): its text_node(), and the one that names its group; the links are similar()'s."""
    texts = docs.select((text_node(docs) if node is None else node).alias("node"), F.col("text"))
    names, marks = [f"fp{k}" for k in range(times)], [f"mark{k}" for k in range(MARKS)]
    one = cut(lean(texts.select("node", "text")).mapInArrow(lambda batches: _mixed(batches, width, times, bands), ", ".join(["node long", "size int", *(f"{x} long" for x in marks + names), "bands array<long>"])).dropDuplicates(["node"]))
    live, roots, edges, tested, k = one.withColumn("root", F.col("node")), None, None, None, 1
    while True:
        found = None
        for name in names:
            now = links(live.select(F.col(name).alias("fp"), "node", "root", "size", *marks), most, hot, k, least)
            found = now if found is None else found.unionAll(now)
        if bands:
            now = band_links(live.select("bands", "node", "root", "size", *marks), hot, k, least)
            found = now if found is None else found.unionAll(now)
        found = cut(found.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        pairs = found.where("v is not null")
        if tested is not None:
            pairs = cut(pairs.join(tested, ["u", "v"], "left_anti"))
        met = cut(pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct())
        held = cut(texts.select("node", "text").join(small(met, 200_000), "node", "left_semi").dropDuplicates(["node"]))
        both = pairs.join(held.select(F.col("node").alias("u"), F.col("text").alias("x")), "u").join(held.select(F.col("node").alias("v"), F.col("text").alias("y")), "v")
        alike = lean(both.select("u", "v", "x", "y")).mapInArrow(_alike(width, least), "a long, b long")
        edges = cut(alike if edges is None else edges.unionAll(alike))
        roots = cut(one.select("node").join(components(edges), "node", "left").select("node", F.coalesce("root", "node").alias("root")))
        del now, met, held, both, alike
        let_go(docs.sparkSession)
        left = found.where("v is null").select(F.col("u").alias("node"))
        if left.isEmpty():
            break
        live = cut(one.join(left, "node", "left_semi").join(roots, "node"))
        tested, k = pairs if tested is None else cut(tested.unionAll(pairs)), k * MORE
    return roots


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4, most=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
