"""Best-two-fit packing of token pieces into sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citetrust.llm.tokens import encoder, vocabulary
from citetrust.llm.work import by_slices, stored, utf8

LENGTH = 4096  # tokens of a sequence
END = 1  # id that ends a document
SPREAD = 64  # parts in which the pieces of one length are numbered


def token_pieces(documents: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids, which end in ``end``; long ones are cut."""
    path = path or vocabulary()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        data, at = utf8(part.column(1))
        ids, to = encoder(path).encode(data, at)
        raw = ids.astype("<u4").tobytes()
        last = np.array([end], "<u4").tobytes()
        row, number, size, check = [], [], [], []
        for k, (a, b) in enumerate(zip(to[:-1].tolist(), to[1:].tolist(), strict=True)):
            own = raw[4 * a : 4 * b] + last
            for piece, begin in enumerate(range(0, len(own), 4 * length)):
                cut = own[begin : begin + 4 * length]
                row.append(k)
                number.append(piece)
                size.append(len(cut) // 4)
                check.append(zlib.crc32(cut))
        number = np.array(number, np.int32)
        return pa.RecordBatch.from_arrays(
            [
                part.column(0).take(pa.array(row, pa.int64())),
                pa.array(number),
                pa.array(number.astype(np.int64) * length),
                pa.array(size, pa.int64()),
                pa.array(check, pa.int64()),
            ],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return documents.select("doc_id", "text").mapInArrow(by_slices("text", work, 1 << 19), schema)


def largest_up_to(count: np.ndarray) -> np.ndarray:
    """For each number x from 0 on, the largest length of at most x that is left, or 0."""
    return np.maximum.accumulate(np.where(count > 0, np.arange(len(count)), 0))


def best_two(count: np.ndarray, gap: int) -> tuple[int, int]:
    """The two lengths that are left and fill ``gap`` best (the longer one as long as can be), or (0, 0)."""
    up_to = largest_up_to(count[: gap + 1])
    first = np.flatnonzero(count[: gap + 1])
    first = first[first > 0]
    if not len(first):
        return 0, 0
    second = up_to[gap - first]
    single = (second == first) & (count[first] < 2)
    second = np.where(single, up_to[np.maximum(np.minimum(first - 1, gap - first), 0)], second)
    total = np.where(second > 0, first + second, 0)
    best = int(np.flatnonzero(total == total.max())[-1])
    return (int(first[best]), int(second[best])) if total[best] else (0, 0)


def best_two_fit(counts: dict[int, int], length: int = LENGTH) -> list[tuple[list[int], int]]:
    """Fillings of sequences and how many sequences have each, for so many pieces of each length.

    A sequence takes the longest piece left, then again and again the longest that fits. Its smallest piece is then
    given back if two pieces that are left fill the gap so made more tightly; this is tried again until it doesn't
    help. A filling is used as often as the pieces left allow, so the work is bounded by the number of lengths,
    not of pieces.
    """
    count = np.zeros(length + 1, np.int64)
    for size, n in counts.items():
        count[size] = n
    fillings: list[tuple[list[int], int]] = []
    while True:
        up_to = largest_up_to(count)
        if not up_to[length]:
            return fillings
        filling, gap = [], length
        while size := int(up_to[gap]):
            n = min(gap // size, int(count[size]))
            if not filling:
                n = 1
            filling += [size] * n
            count[size] -= n
            gap -= size * n
            if not count[size]:
                up_to = largest_up_to(count)
        while gap and len(filling) > 1:
            small = filling[-1]
            a, b = best_two(count, gap + small)
            if a + b <= small:
                break
            count[small] += 1
            count[a] -= 1
            count[b] -= 1
            filling = sorted([*filling[:-1], a, b], reverse=True)
            gap += small - a - b
        sizes, uses = np.unique(filling, return_counts=True)
        more = int((count[sizes] // uses).min())
        count[sizes] -= more * uses
        fillings.append((filling, 1 + more))


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` (with ``length``, and any other columns) with ``sequence_id`` and ``offset``.

    Only the number of pieces of each length (at most ``length`` numbers) goes to the driver, where best-two-fit
    gives fillings and how often to use each. The pieces of a length are numbered, in parts so that a common length
    is spread over many tasks, and each number has its place in a filling. Ties are free: pieces of one length are
    interchangeable. ``pieces`` should be stored, as it is read twice.
    """
    spark = pieces.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SPREAD))
    parted = pieces.withColumn("part", part)
    sizes = parted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    totals = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    # Of each filling and length in it: the numbers of the pieces that go there, and where they stand.
    rows, used, sequence = [], dict.fromkeys(totals, 0), 0
    for filling, times in best_two_fit(totals, length):
        offset = 0
        places: dict[int, list[int]] = {}
        for size in filling:
            places.setdefault(size, []).append(offset)
            offset += size
        for size, offsets in places.items():
            rows.append((size, used[size], used[size] + times * len(offsets), sequence, offsets))
            used[size] += times * len(offsets)
        sequence += times
    places = spark.createDataFrame(
        rows, "length bigint, from_number bigint, to_number bigint, first_sequence bigint, offsets array<bigint>"
    )
    # The fillings of a length, in order; a piece finds its own by going through their first numbers.
    places = places.groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("from_number", "first_sequence", "offsets"))).alias("places")
    )
    number = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1
    numbered = parted.withColumn("number", number).join(sizes.drop("n"), ["length", "part"])
    numbered = numbered.withColumn("number", F.col("number") + F.col("before"))
    placed = numbered.join(places, "length").withColumn(
        "place",
        F.element_at(F.filter("places", lambda p: p["from_number"] <= F.col("number")), -1),
    )
    among = F.col("number") - F.col("place.from_number")
    width = F.size("place.offsets")
    return placed.select(
        *pieces.columns,
        (F.col("place.first_sequence") + F.floor(among / width)).alias("sequence_id"),
        F.get("place.offsets", (among % width).cast("int")).alias("offset"),
    )


def pack_documents(documents: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of ``documents`` (doc_id, text).

    A null or empty text has the end id alone. A null doc_id stays null, repeated rows are packed as often as they
    come, other columns are not read; an empty table has no pieces. Texts may be of any length.
    """
    return pack(stored(token_pieces(documents, path, length, end), "pieces"), length)
