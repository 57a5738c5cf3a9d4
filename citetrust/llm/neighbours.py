"""Approximate nearest neighbours by inner product: collision counting over sorted projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citetrust.llm.work import binary

PROJECTIONS = 64
BLOCK_ROWS = 16_384  # vectors that share sorted arrays
CHUNK_ROWS = 256  # queries at a time
# Half-widths of the windows, for vectors of length 1; each widens the one before, the last takes all.
RADII = (0.3, 1.0, 1.5, 1.75, 2.0, 2.5, np.inf)
THRESHOLD = 0.82  # share of projections in which a vector has to fall into the window
SURE = 1.5  # a window of half-width R finds vectors up to the distance R / SURE
BETA = 0.3  # share of a block from which on the rest is verified as a whole, too, which is cheaper than more windows


class Block:
    """Vectors with one sorted array for each projection."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, directions: np.ndarray):
        order = np.lexsort([vectors[:, 0], ids])
        ids, vectors = ids[order], vectors[order]
        fresh = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.zeros(0, bool)
        self.ids, self.vectors = ids[fresh], vectors[fresh].astype(np.float64)
        # One more coordinate makes all vectors equally long: the larger the inner product, the nearer.
        unit = self.vectors / longest
        rest = np.sqrt(np.maximum(1 - (unit * unit).sum(1), 0))
        values = unit @ directions[:-1] + rest[:, None] * directions[-1]
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.sort(values, axis=0).T.copy()
        self.longest = longest
        self.directions = directions

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vec_id, score) of the best ``k`` of the block for each query, its own id left out."""
        queries = queries.astype(np.float64)
        lengths = np.sqrt((queries * queries).sum(1))
        values = (queries / lengths[:, None]) @ self.directions[:-1]
        n, m = len(self.ids), self.sorted.shape[0]
        need = int(np.ceil(THRESHOLD * m))
        low = np.stack([np.searchsorted(self.sorted[j], values[:, j]) for j in range(m)], axis=1)
        high = low.copy()
        counts = np.zeros((len(queries), n), np.int16)
        done = np.zeros((len(queries), n), bool)
        scores: list[list[np.ndarray]] = [[] for _ in query_ids]
        places: list[list[np.ndarray]] = [[] for _ in query_ids]
        left, zero, full = np.arange(len(query_ids)), [0] * m, [n] * m

        def verify(q: int, found: np.ndarray) -> None:
            done[q, found] = True
            score = (self.vectors[found] * queries[q]).sum(1)
            keep = self.ids[found] != query_ids[q]
            scores[q].append(score[keep])
            places[q].append(found[keep])

        for radius in RADII:
            if not len(left):
                break
            at = values[left]
            if radius == np.inf:
                to_low, to_high = np.zeros_like(low[left]), np.full_like(high[left], n)
            else:
                to_low = np.stack([np.searchsorted(self.sorted[j], at[:, j] - radius) for j in range(m)], axis=1)
                to_high = np.stack(
                    [np.searchsorted(self.sorted[j], at[:, j] + radius, side="right") for j in range(m)], axis=1
                )
            going = []
            for row, q in enumerate(left.tolist()):
                if radius < np.inf:
                    wide = int((to_high[row] - to_low[row]).sum())
                    if n * m - wide < wide - int((high[q] - low[q]).sum()):  # fewer outside than new inside
                        begin, end = zero, to_low[row].tolist()
                        more, last = to_high[row].tolist(), full
                    else:
                        begin, end = to_low[row].tolist(), low[q].tolist()
                        more, last = high[q].tolist(), to_high[row].tolist()
                    sides = [o[a:b] for o, a, b in zip(self.order, begin, end, strict=True) if a < b]
                    sides += [o[a:b] for o, a, b in zip(self.order, more, last, strict=True) if a < b]
                    number = np.bincount(np.concatenate(sides), minlength=n) if sides else 0
                    counts[q] = m - number if begin is zero else counts[q] + number
                    found = np.flatnonzero((counts[q] >= need) & ~done[q])
                else:
                    found = np.flatnonzero(~done[q])
                low[q], high[q] = to_low[row], to_high[row]
                verify(q, found)
                score = np.concatenate(scores[q])
                if len(score) >= k:
                    worst = np.partition(score, len(score) - k)[len(score) - k] / (self.longest * lengths[q])
                    if np.sqrt(max(2 - 2 * worst, 0)) * SURE <= radius:
                        continue
                    if len(score) >= k + BETA * n:
                        verify(q, np.flatnonzero(~done[q]))
                        continue
                going.append(q)
            left = np.array(going, np.int64)
        out_q, out_v, out_s = [], [], []
        for q, query_id in enumerate(query_ids.tolist()):
            score, place = np.concatenate(scores[q]), np.concatenate(places[q])
            best = np.lexsort([self.ids[place], -score])[:k]
            out_q.append(np.full(len(best), query_id))
            out_v.append(self.ids[place[best]])
            out_s.append(score[best])
        return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _packed(blocks: int):
    """Rows (vec_id, embedding) as (block, ids, vectors), several rows at once; the block follows from the id.

    With ``blocks`` 0, chunks of at most CHUNK_ROWS rows with block 0, for queries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            vectors = vectors.reshape(len(ids), -1)
            if blocks:
                block = batch.column(2).to_numpy(zero_copy_only=False)
                order = np.argsort(block, kind="stable")
                cut = np.append(np.flatnonzero(np.diff(block[order], prepend=-1)), len(order))
            else:
                block, order = np.zeros(len(ids), np.int64), np.arange(len(ids))
                cut = np.append(np.arange(0, len(ids), CHUNK_ROWS), len(ids))
            pairs = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block[order[cut[:-1]]], pa.int64()),
                    binary([ids[order[a:b]].tobytes() for a, b in pairs]),
                    binary([vectors[order[a:b]].tobytes() for a, b in pairs]),
                ],
                ["block", "ids", "vectors"],
            )

    return run


def directions(size: int, projections: int = PROJECTIONS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(size + 1, projections))


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest that are found, by inner product, of each row whose vec_id
    is divisible by ``every``, among all other rows of ``embeddings`` (vec_id, embedding).

    Vectors (and queries) that are null, zero, or hold null or non-finite numbers take no part, nor do rows without
    vec_id or with another number of components than most rows have. Ties go to the smaller vec_id. Of rows with the
    same vec_id one counts. All queries go to each block of vectors; a block's sorted projections are searched in
    windows around the query that widen until the best ``k`` are within reach of most projections, and vectors that fall into
    enough windows are verified. If that are many and the best ``k`` are still not within reach, all others of the
    block are verified, too. Of each block and query, ``k`` rows are shuffled.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    sound = (
        embeddings.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
        .withColumn("length", length)
        .where("length > 0")
    )
    kinds = sound.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"), F.max("length").alias("top"))
    kind = kinds.orderBy(F.desc("n"), F.desc("size")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if kind is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    size, longest = kind["size"], kind["top"]
    blocks = -(-kind["n"] // block_rows)
    sound = sound.where(F.size("embedding") == size)
    packed = "block bigint, ids binary, vectors binary"
    vectors = sound.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    vectors = vectors.mapInArrow(_packed(blocks), packed).withColumn("query", F.lit(0))
    queries = sound.where(F.col("vec_id") % every == 0).select("vec_id", "embedding").mapInArrow(_packed(0), packed)
    queries = queries.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"),
        "ids",
        "vectors",
        F.lit(1).alias("query"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = directions(size)
        current, parts, block = None, [], None
        for batch in batches:
            for number, ids, raw, is_query in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = np.frombuffer(ids, np.int64), np.frombuffer(raw, np.float32).reshape(-1, size)
                if number != current:
                    current, parts, block = number, [], None
                if not is_query:
                    parts.append(own)
                    continue
                if block is None:
                    if not parts:
                        continue
                    block = Block(*map(np.concatenate, zip(*parts, strict=True)), longest, lines)
                found = block.search(*own, k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    found = (
        vectors.unionByName(queries)
        .repartition("block")
        .sortWithinPartitions("block", "query")
        .mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    )
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
