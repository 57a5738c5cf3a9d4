"""Exact Jaccard join of documents by word n-grams.

Documents whose sets are near enough must agree in parts of their sets: a pair of sizes within the threshold can
differ in so few shingles that, when the hash range is cut into more parts than that, some part is the same in both.
Documents that share a part, directly or over others, form a family. Inside a family documents are laid out in tiles
by bands of size. A first round of tiles holds hashed bitmaps only, some thirty times smaller than the sets: bit counts
bound the overlap of two sets from above, and pairs that may still link form narrower families. In the second round
of tiles pairs that pass the same bound are decided by intersecting their sorted arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citetrust.llm.components import components, stars
from citetrust.llm.words import mix, shingle_sets
from citetrust.llm.work import binary, by_slices, slices, stored, stored_alone, utf8

BUCKET_ENTRIES = 2_000_000  # signatures of a bucket, about
RANGES = 8  # parts of a bucket that are looked at one after the other
TILE_SHINGLES = 1 << 19  # of all documents of one side of a tile, about
TILE_ROWS = 512  # documents of one side of a tile, about
MAP_ROWS = 8192  # the same, of a tile of bitmaps
NUMBER = "_number_of_repeated_row"
KEY = "_document_key"  # likewise


def size_bands(percent: int, limit: int = 1 << 40) -> np.ndarray:
    """The largest size of each band; sizes that may link are in the same band or in neighbouring ones."""
    tops, top = [], 0
    while top < limit:
        top = max(top + 1, (top + 1) * 100 // percent)
        tops.append(top)
    return np.array(tops, np.int64)


def part_signatures(sets: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) such that two sets with a Jaccard index of ``percent`` or more share one.

    A pair's smaller size m lies in a band with largest size M, and the sets differ in at most
    d = M * (100 - percent) / percent shingles. Each set takes part as the smaller one in its own band and as the
    larger one in the band below. For a band, the hash range is cut into somewhat more than d + 1 parts and a set
    signs its first d + 1 parts that aren't empty (empty ones count last): as at most d parts differ, the first part
    in which the pair agrees, in that order, is among those that both sign.
    """
    tops = size_bands(percent)
    size = np.diff(at)
    signatures, owners = [], []
    sums = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(mix(sets), out=sums[1:])
    high = sets >> np.uint64(32)
    band = np.searchsorted(tops, size)
    for step in (0, 1):
        take = np.flatnonzero((size > 0) & (band >= step))
        take = take[tops[band[take] - step] * 100 >= size[take] * percent]
        if not len(take):
            continue
        b = band[take] - step
        sign = tops[b] * (100 - percent) // percent + 1
        parts = np.where(sign > 1, sign + sign // 20 + 2, 1)
        n = size[take]
        row = np.repeat(np.arange(len(take)), n)
        place = np.arange(int(n.sum())) + np.repeat(at[take] - (np.cumsum(n) - n), n)
        part = (high[place] * parts[row].astype(np.uint64)) >> np.uint64(32)
        begin = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(part.astype(np.int64), prepend=-1) != 0))
        end = np.append(begin[1:], len(row))
        owner, number = row[begin], part[begin]
        first = np.searchsorted(owner, np.arange(len(take) + 1))
        rank = np.arange(len(owner)) - first[owner]
        kept = rank < sign[owner]
        total = sums[place[end - 1] + 1] - sums[place[begin]]
        label = mix(b[owner].astype(np.uint64) * np.uint64(1 << 32) + number)
        signatures.append(mix(total + label)[kept])
        owners.append(take[owner[kept]])
        lacking = np.flatnonzero(np.diff(first) < sign)
        for k in lacking.tolist():
            empty = np.setdiff1d(np.arange(parts[k], dtype=np.uint64), number[first[k] : first[k + 1]])
            empty = empty[: int(sign[k] - (first[k + 1] - first[k]))]
            signatures.append(mix(mix(np.uint64(b[k]) * np.uint64(1 << 32) + empty) ^ np.uint64(0xE5)))
            owners.append(np.full(len(empty), take[k]))
    if not signatures:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(signatures), np.concatenate(owners)


def _stats(width: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Size and 128-bit digest of each document's set."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        sets, at = shingle_sets(*utf8(part.column(1)), width)
        sums = np.zeros((2, len(sets) + 1), np.uint64)
        np.cumsum(mix(sets + np.uint64(1)), out=sums[0, 1:])
        np.cumsum(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1, 1:])
        one, two = sums[:, at[1:]] - sums[:, at[:-1]]
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(np.diff(at)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
            ["doc_id", "n_shingles", "d1", "d2"],
        )

    return by_slices("text", work)


def _signed(width: int, percent: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Signatures in blocks by bucket. Of documents with the same set in one task only the first signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets, at = shingle_sets(*utf8(part.column(1)), width)
                sums = np.zeros(len(sets) + 1, np.uint64)
                np.cumsum(mix(sets + np.uint64(1)), out=sums[1:])
                fresh = np.zeros(part.num_rows, bool)
                for k, key in enumerate(zip((sums[at[1:]] - sums[at[:-1]]).tolist(), np.diff(at).tolist(), strict=True)):
                    fresh[k] = key not in seen
                    seen.add(key)
                kept = np.repeat(fresh, np.diff(at))
                to = np.zeros(int(fresh.sum()) + 1, np.int64)
                np.cumsum(np.diff(at)[fresh], out=to[1:])
                signature, owner = part_signatures(sets[kept], to, percent)
                ids = part.column(0).to_numpy(zero_copy_only=False)[fresh][owner]
                order = np.argsort(signature)
                signature, ids = signature[order], ids[order]
                bucket = (signature >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                cut = np.append(np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1)), len(bucket))
                pairs = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[cut[:-1]].astype(np.int64)),
                        binary([signature[a:b].tobytes() for a, b in pairs]),
                        binary([ids[a:b].astype(np.int64).tobytes() for a, b in pairs]),
                    ],
                    ["bucket", "signatures", "ids"],
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between documents that share a signature, from blocks in order of bucket.

    Each signature keeps one document, so a common one takes no more memory than a rare one; others are linked to it.
    A bucket is sorted in RANGES parts of its signatures; the stars of the parts are joined to those of the bucket.
    """
    bucket, signature, ids = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def settle() -> pa.RecordBatch:
        nonlocal signature, ids, waiting, held
        signature = np.concatenate([signature, *[s for s, _ in waiting]])
        ids = np.concatenate([ids, *[i for _, i in waiting]])
        waiting, held = [], 0
        low, above = (int(signature.min()), int(signature.max()) + 1) if len(signature) else (0, 0)
        edges = [low + (above - low) * k // RANGES for k in range(RANGES + 1)]
        kept, parts = [], []
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            if begin == end:
                continue
            here = np.flatnonzero((signature >= np.uint64(begin)) & (signature <= np.uint64(end - 1)))
            here = here[np.argsort(signature[here], kind="stable")]
            own, doc = signature[here], ids[here]
            first = np.ones(len(here), bool)
            first[1:] = own[1:] != own[:-1]
            leader = doc[np.flatnonzero(first)][np.cumsum(first) - 1]
            apart = leader != doc
            parts.append(stars(leader[apart], doc[apart]))
            kept.append((own[first], doc[first]))
        signature = np.concatenate([np.zeros(0, np.uint64), *[s for s, _ in kept]])
        ids = np.concatenate([np.zeros(0, np.int64), *[d for _, d in kept]])
        pairs = stars(*(np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    for batch in batches:
        for k, s, i in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if k != bucket:
                if bucket is not None:
                    yield settle()
                bucket, signature, ids = k, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            waiting.append((np.frombuffer(s, np.uint64), np.frombuffer(i, np.int64)))
            held += len(s) // 8
            if held > BUCKET_ENTRIES:
                yield settle()
    if bucket is not None:
        yield settle()


def bits_for(size: np.ndarray | int) -> np.ndarray:
    """Bits of a set's bitmap: a power of two, at least twice its size if that is 16,384 or less."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(2 * np.asarray(size), 2))), 8, 15).astype(np.int64)


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Bits that tell whether an odd number of shingles hash there."""
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) % 2
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def may_link(maps: np.ndarray, one: np.ndarray, sizes: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Which sets may link to ``one`` by their bitmaps: two sets share at most half of (sum of their sizes - bits in
    which they differ), and have to share I with 100 I >= percent (sum - I)."""
    total = sizes + size
    most = (total - np.bitwise_count(maps ^ one).sum(1, dtype=np.int64)) // 2
    return (100 + percent) * most >= percent * total


def map_links(rows: list[bytes], side: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """As tile_links, of pairs that may link, from (size, bitmap) of each row.

    Bitmaps of twice the length are folded: of sizes within the threshold, the larger has at most twice the bits.
    """
    size = np.array([int.from_bytes(r[:8], "little") for r in rows], np.int64)
    order = np.argsort(size, kind="stable")
    size, side = size[order], side[order]
    bits, both = bits_for(size), bool(side.any())
    for level in np.unique(bits).tolist():
        first, last = np.searchsorted(bits, level), np.searchsorted(bits, 2 * level, side="right")
        maps = [np.frombuffer(rows[k], np.uint64, offset=8) for k in order[first:last].tolist()]
        words = level // 64
        maps = np.stack([m if len(m) == words else m[:words] ^ m[words:] for m in maps])
        for k in range(first, np.searchsorted(bits, level, side="right")):
            end = int(np.searchsorted(size, size[k] * 100 // percent, side="right"))
            if end <= k + 1:
                continue
            near = may_link(maps[k + 1 - first : end - first], maps[k - first], size[k + 1 : end], size[k], percent)
            if both:
                near &= side[k + 1 : end] != side[k]
            if near.any():
                yield int(order[k]), order[k + 1 + np.flatnonzero(near)]


def tile_links(rows: list[bytes], side: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Links in a tile, as (row, later rows it links to). Two sides: only between them; one side (all 0): within it.

    Rows in order of size; for each, the rows up to the largest size that can link are bounded by bit counts. What is
    left is intersected exactly.
    """
    sets = [np.frombuffer(r, np.uint64) for r in rows]
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, ranked = size[order], [sets[k] for k in order]
    both = bool(side.any())
    bits = int(bits_for(size.max(initial=1)))
    maps = np.stack([bitmap(x, bits) for x in ranked])
    # Sorted arrays as ranks in the tile's own vocabulary; a row's array is intersected with many at once.
    vocabulary = np.unique(np.concatenate(ranked)) if ranked else np.zeros(0, np.uint64)
    ranks = np.searchsorted(vocabulary, np.concatenate(ranked)) if ranked else np.zeros(0, np.int64)
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    inside = np.zeros(len(vocabulary), bool)
    for k in range(len(size)):
        end = int(np.searchsorted(size, size[k] * 100 // percent, side="right"))
        later = np.arange(k + 1, end)
        if both:
            later = later[side[order[later]] != side[order[k]]]
        if not len(later) or not size[k]:
            continue
        later = later[may_link(maps[later], maps[k], size[later], int(size[k]), percent)]
        if not len(later):
            continue
        inside[ranks[at[k] : at[k + 1]]] = True
        for begin in range(0, len(later), 256):
            some = later[begin : begin + 256]
            place = np.concatenate([ranks[at[x] : at[x + 1]] for x in some])
            edges = np.cumsum(size[some]) - size[some]
            shared = np.add.reduceat(inside[place].astype(np.int64), edges)
            total = size[some] + size[k]
            linked = some[(100 + percent) * shared >= percent * total]
            if len(linked):
                yield int(order[k]), order[linked]
        inside[ranks[at[k] : at[k + 1]]] = False


def _tiles(
    links: Callable[[list[bytes], np.ndarray, int], Iterator[tuple[int, np.ndarray]]], percent: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each tile (rows in order of tile): its links as stars around smallest ids (a, b, 0), and each row's number of
    linked documents, copies included, as (a, a, number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: list[tuple]) -> pa.RecordBatch:
            ids = [r[0] for r in rows]
            copies = np.array([r[3] for r in rows], np.int64)
            root, number, edges = list(range(len(rows))), np.zeros(len(rows), np.int64), []

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for k, others in links([r[1] for r in rows], np.array([r[2] for r in rows], np.int64), percent):
                number[k] += copies[others].sum()
                number[others] += copies[k]
                for other in others.tolist():
                    x, y = find(k), find(other)
                    if x != y:
                        root[x] = y
                        edges.append((ids[k], ids[other]))
            low, high = stars(*np.array(edges, np.int64).reshape(-1, 2).T)
            edges = [(*e, 0) for e in zip(low.tolist(), high.tolist(), strict=True)]
            edges += [(ids[k], ids[k], int(number[k])) for k in np.flatnonzero(number).tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array([e[j] for e in edges], pa.int64()) for j in range(3)], ["a", "b", "n_links"]
            )

        tile, rows = None, []
        for batch in batches:
            for *key, doc, own, side, copies in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != tile:
                    if len(rows) > 1:
                        yield settle(rows)
                    tile, rows = key, []
                rows.append((doc, own, side, copies))
        if len(rows) > 1:
            yield settle(rows)

    return run


def _linked(
    documents: DataFrame, members: DataFrame, width: int, percent: int, exact: bool
) -> DataFrame:
    """(a, b, n_links), see _tiles, over the families in ``members`` (family, doc_id, n_shingles, copies).

    By intersections if ``exact``, otherwise by bitmaps alone, which find some pairs more.
    """
    most_rows = TILE_ROWS if exact else MAP_ROWS
    most_shingles = TILE_SHINGLES if exact else TILE_SHINGLES * 16
    tops = size_bands(percent).tolist()
    band = F.lit(0)
    for top in tops:
        if top >= 1 << 24:
            break
        band = band + (F.col("n_shingles") > top).cast("int")
    members = members.withColumn("band", band)
    # A family that fits is one tile; others are cut into blocks of each band, by hash of the document.
    bands = members.groupBy("family", "band").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("rows") / most_rows), F.ceil(F.col("shingles") / most_shingles)).cast("int")
    bands = bands.withColumn("blocks", blocks).groupBy("family").agg(
        F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks"),
        ((F.sum("rows") <= most_rows) & (F.sum("shingles") <= most_shingles)).alias("whole"),
    )
    laid = members.join(bands, "family")
    own = F.pmod(F.xxhash64("doc_id"), F.get("n", F.lit(1))).cast("int")
    count = lambda k: F.coalesce(F.element_at("blocks", F.col("band") + k), F.lit(0))
    laid = laid.withColumn("n", F.array(count(-1), F.greatest(count(0), F.lit(1)), count(1))).withColumn("own", own)

    def partners(k: int) -> Column:
        """Tiles of the own block with the blocks of a band: (band, block, band, block, side), the lower one first."""
        there = F.filter(F.sequence(F.lit(0), F.get("n", F.lit(k + 1)) ), lambda y: y < F.get("n", F.lit(k + 1)))

        def tile(y: Column) -> Column:
            mine, other = (F.col("band"), F.col("own")), (F.col("band") + k, y)
            first = F.lit(k > 0) if k else y >= F.col("own")
            pick = lambda a, b: F.when(first, a).otherwise(b)
            same = F.lit(k == 0) & (y == F.col("own"))
            return F.struct(
                pick(mine[0], other[0]).alias("b1"), pick(mine[1], other[1]).alias("x1"),
                pick(other[0], mine[0]).alias("b2"), pick(other[1], mine[1]).alias("x2"),
                F.when(first | same, 0).otherwise(1).alias("side"),
            )

        return F.transform(there, tile)

    none = F.array(F.struct(*[F.lit(-1).alias(c) for c in ("b1", "x1", "b2", "x2")], F.lit(0).alias("side")))
    tiles = F.when(F.col("whole"), none).otherwise(F.concat(partners(-1), partners(0), partners(1)))
    laid = laid.select("doc_id", "family", "copies", tiles.alias("tiles"))

    def row_of(own: np.ndarray) -> bytes:
        if exact:
            return own.tobytes()
        return len(own).to_bytes(8, "little") + bitmap(own, int(bits_for(len(own)))).tobytes()

    def sets_of(part: pa.RecordBatch) -> pa.RecordBatch:
        sets, at = shingle_sets(*utf8(part.column(1)), width)
        rows = [row_of(sets[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), binary(rows)], ["doc_id", "shingles"])

    texts = documents.join(members.select("doc_id"), "doc_id", "left_semi")
    arrays = texts.mapInArrow(by_slices("text", sets_of), "doc_id bigint, shingles binary")
    placed = arrays.join(laid, "doc_id").select("family", F.explode("tiles").alias("t"), "doc_id", "shingles", "copies")
    placed = placed.select("family", "t.b1", "t.x1", "t.b2", "t.x2", "doc_id", "shingles", "t.side", "copies")
    key = ["family", "b1", "x1", "b2", "x2"]
    return (
        placed.repartition(*key)
        .sortWithinPartitions(*key)
        .mapInArrow(_tiles(tile_links if exact else map_links, percent), "a bigint, b bigint, n_links bigint")
    )


def _members(heads: DataFrame, families: DataFrame) -> DataFrame:
    """``heads`` (doc_id, ...) with their ``family``, of families with several heads."""
    members = heads.join(families, heads["doc_id"] == families["node"]).select(
        F.col("component").alias("family"), *heads.columns
    )
    several = members.groupBy("family").agg(F.count("*").alias("n")).where("n > 1").select("family")
    return members.join(several, "family")


def join(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of each row of ``documents`` (doc_id, text).

    A document's set holds its distinct shingles of ``width`` words (A-Z in lower case); one with fewer words has its
    whole sequence as one, one without words or text has none and no link. Two documents link when intersection /
    union is at least ``percent`` / 100. ``component_id`` is the smallest doc_id that links reach, ``n_links`` the
    number of documents that it links to. Repeated rows are copies of each other: they link, and each comes back.
    Rows without doc_id come back with their own set size, no component and 0 links. Other columns are not read.
    """
    rows = documents.select("doc_id", "text")
    stats = stored(rows.mapInArrow(_stats(width), "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint"), "sizes")
    known = stats.where("doc_id is not null and n_shingles > 0")
    same = ["n_shingles", "d1", "d2"]
    classes = known.groupBy(*same).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    with_class = known.join(classes, same)
    total = known.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(16, total * (100 - percent) * 3 // 100 // BUCKET_ENTRIES)
    blocks = rows.where("doc_id is not null and text is not null").mapInArrow(
        _signed(width, percent, buckets), "bucket bigint, signatures binary, ids binary"
    )
    shared = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "a bigint, b bigint")
    copies = with_class.select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
    families = stored(components(shared.unionByName(copies)), "families")

    heads = classes.select(F.col("class_id").alias("doc_id"), "n_shingles", "copies")
    heads = heads.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.sum("copies").alias("copies"))
    members = stored(_members(heads, families), "members")
    near = stored(_linked(rows, members, width, percent, exact=False), "near").where("a != b")
    members = stored(_members(heads, components(near.select("a", "b"))), "members")
    links = stored(_linked(rows, members, width, percent, exact=True), "links")
    joined = components(links.where("a != b").select("a", "b").unionByName(copies))
    number = links.where("a = b").groupBy(F.col("a").alias("class_id")).agg(F.sum("n_links").alias("beyond"))

    of_doc = with_class.join(number, "class_id", "left").groupBy("doc_id").agg(
        F.sum(F.coalesce("beyond", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    of_doc = of_doc.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return stats.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def one_of_each(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with all their columns, of each group of linked ones only the one with the smallest doc_id.

    Of repeated rows one stays. Rows with the same doc_id and different texts are different documents: they link only
    if their texts do. Rows without doc_id can't be told apart and all stay. Keys of the rows that stay are stored;
    texts are not, and nothing else that the join stores is left.
    """
    spark = documents.sparkSession
    text_hash = F.xxhash64("text")
    ids = documents.where("doc_id is not null").groupBy("doc_id").agg((F.min(text_hash) != F.max(text_hash)).alias("several"))
    # If an id doesn't name a text, 64 bits of both do.
    several = not ids.where("several").isEmpty()
    own = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")) if several else F.col("doc_id")

    def first_keys() -> DataFrame:
        if not several:
            found = join(documents, width, percent)
            return found.where(F.col("component_id") == F.col("doc_id")).select(F.col("doc_id").alias(KEY)).distinct()
        keys = documents.select(own.alias(KEY), "doc_id").where("doc_id is not null").distinct()
        found = join(documents.select(own.alias("doc_id"), "text"), width, percent)
        found = found.select(F.col("doc_id").alias(KEY), "component_id").distinct().join(keys, KEY)
        return found.groupBy("component_id").agg(F.min_by(KEY, F.struct("doc_id", KEY)).alias(KEY)).select(KEY)

    first = stored_alone(spark, first_keys, "first")
    number = F.row_number().over(Window.partitionBy(KEY).orderBy(text_hash, "text"))
    known = documents.withColumn(KEY, own).join(first, KEY, "left_semi").withColumn(NUMBER, number).where(F.col(NUMBER) == 1)
    return known.select(*documents.columns).unionByName(documents.where("doc_id is null"))
