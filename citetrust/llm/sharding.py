"""Shards of bounded size by extendible hashing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetrust.llm.work import stored

LIMIT = 8 << 20  # bytes of text in a shard
STEP = 8  # bits that are looked at in one round
BITS = 128  # bits of a row's hash


def _split(cells: dict[str, tuple[int, int]], prefix: str, limit: int, deepest: int) -> Iterator[tuple[str, str, bool]]:
    """(cell, bucket, whether the bucket is still too large) of all cells below ``prefix``: only a bucket that is
    over the limit and holds more than one row splits on another bit."""
    size, rows = (sum(v[k] for v in cells.values()) for k in (0, 1))
    over = size > limit and rows > 1
    if not over or len(prefix) == deepest:
        for cell in cells:
            yield cell, prefix, over
        return
    for bit in "01":
        below = {c: v for c, v in cells.items() if c[len(prefix)] == bit}
        if below:
            yield from _split(below, prefix + bit, limit, deepest)


def _directory(limit: int, depth: int, deepest: int):
    """The part of the directory below each prefix of ``depth`` bits, from (prefix, cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for prefix, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sizes = {c["cell"]: (c["bytes"], c["rows"]) for c in cells}
                rows += _split(sizes, prefix, limit, deepest)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.bool_()),
                ],
                ["cell", "shard", "over"],
            )

    return run


def shards(documents: DataFrame, limit: int = LIMIT, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, shard, depth) of each row of ``documents`` (doc_id, text), and its ``text`` if asked for.

    ``shard`` is the prefix of the row's hash, in bits, that the directory holds, ``depth`` its length. The directory
    starts with prefixes so short that an average bucket is far over the limit; only buckets over it split, on one
    more bit, until each holds at most ``limit`` bytes of UTF-8 text or a single row. The hash is that of doc_id and
    text, and behind its 64 bits that of the row's place, so that even a third of all rows with the same key is
    split. A null or empty text has 0 bytes; null ids stay null; other columns are not read; no rows, no shards.

    A round adds up bytes by cells of STEP more bits, before they are shuffled; a prefix's cells, at most 2^STEP,
    are split where they are. Only rows of buckets that are still too large take part in the next round.
    """
    place = F.xxhash64(F.monotonically_increasing_id())
    rows = documents.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.xxhash64("doc_id", "text").alias("h1"),
        place.alias("h2"),
        *(["text"] if with_text else []),
    )
    rows = stored(rows, "keys")  # from here on a row's place is fixed
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = F.concat(*[F.lpad(F.bin(h), 64, "0") for h in ("h1", "h2")])
    depth = max(0, (total // limit).bit_length() - 4)
    done = None
    while True:
        deepest = min(depth + STEP, BITS)
        celled = rows.withColumn("cell", F.substring(bits, 1, deepest))
        sizes = celled.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        grouped = sizes.groupBy(F.substring("cell", 1, depth).alias("prefix")).agg(
            F.collect_list(F.struct("cell", "bytes", "rows")).alias("cells")
        )
        directory = grouped.mapInArrow(_directory(limit, depth, deepest), "cell string, shard string, over boolean")
        directory = stored(directory, "directory")
        placed = celled.join(directory, "cell").drop("cell")
        closed = placed.where(~F.col("over")) if deepest < BITS else placed
        closed = closed.select("doc_id", "n_bytes", "shard", F.length("shard").alias("depth"), *(["text"] if with_text else []))
        done = closed if done is None else done.unionByName(closed)
        if deepest == BITS or not directory.where("over").limit(1).count():
            return done
        rows = stored(placed.where("over").drop("shard", "over"), "rows")
        depth = deepest


def write_shards(documents: DataFrame, folder: str, limit: int = LIMIT) -> None:
    """Writes the rows (doc_id, n_bytes, depth, text) of each shard, in a folder ``shard=...`` for each, as Parquet."""
    found = shards(documents, limit, with_text=True)
    found.repartition("shard").write.partitionBy("shard").parquet(folder)
