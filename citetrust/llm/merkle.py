"""A Merkle tree over the rows of a dataset, per source and over sources, with a proof for each row."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citetrust.llm.ranks import numbered
from citetrust.llm.work import stored

BITS = 4  # of a rank digit: 16 consecutive nodes become one
DIGITS = 3  # that are grouped away inside a block: 4,096 nodes at most are nested in one row
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """What a leaf hashes of one value: ``-`` for null, else its length in UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """The leaf of a document, optionally with another text."""
    return F.sha2(F.concat(*[field(F.col(c) if c != "text" or text is None else text) for c in FIELDS]), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that ``start`` leads to by a proof."""
    return F.aggregate(proof, start, lambda h, level: F.sha2(F.concat(level["left"], h, level["right"]), 256))


def _rolled(nodes: DataFrame) -> DataFrame:
    """(group, block, hash, kids) from (group, rank, hash, ...): one row for each 4,096 nodes of a group.

    Rank digits are grouped away one after the other, and each node nests the structs of its children. One shuffle by
    block serves all groupings. The first node of a group with a single child is that child (nothing else is
    left of the group, because ranks have no gaps).
    """
    own = [c for c in nodes.columns if c not in ("group", "rank")]
    digits = [F.shiftright("rank", BITS * k).bitwiseAND((1 << BITS) - 1).alias(f"d{k}") for k in range(DIGITS)]
    block = F.shiftright("rank", BITS * DIGITS).alias("block")
    rows = nodes.select("group", block, *digits, *own).repartition("group", "block")
    for k in range(DIGITS):
        above = [f"d{j}" for j in range(k + 1, DIGITS)]
        kid = F.struct(F.col(f"d{k}").alias("digit"), *own)
        grouped = rows.groupBy("group", "block", *above).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        hashes = F.transform("kids", lambda kid: kid["hash"])
        first = F.col("block") == 0
        for d in above:
            first = first & (F.col(d) == 0)
        made = F.when(first & (F.size("kids") == 1), hashes[0]).otherwise(F.sha2(F.array_join(hashes, ""), 256))
        rows, own = grouped.withColumn("hash", made), ["hash", "kids"]
    return rows


def _beside(kid: Column, i: Column) -> Column:
    """A child with its own proof, which has one level more than its parent's unless it is an only first child."""
    hashes = F.transform("kids", lambda k: k["hash"])
    left, right = F.slice(hashes, F.lit(1), i), F.slice(hashes, i + 2, F.lit(1 << BITS))
    level = F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))
    alone = F.col("first") & (F.size("kids") == 1)
    path = F.when(alone, F.col("path")).otherwise(F.concat(F.array(level), F.col("path")))
    return F.struct(kid.alias("kid"), path.alias("path"), (F.col("first") & (i == 0)).alias("first"))


def _opened(blocks: DataFrame, passed: list[str]) -> DataFrame:
    """The nodes that ``_rolled`` nested, from (group, block, kids, path, and the columns ``passed``).

    ``path`` is the proof of the whole block; each explode puts the siblings of one level before it.
    """
    rows = blocks.select("group", *passed, "path", "kids", F.col("block").alias("rank"), (F.col("block") == 0).alias("first"))
    for k in range(DIGITS):
        rows = rows.select("group", *passed, "rank", F.inline(F.transform("kids", _beside)))
        rank = F.shiftleft("rank", BITS).bitwiseOR(F.col("kid.digit")).alias("rank")
        inside = "kid.kids" if k + 1 < DIGITS else "kid.*"
        rows = rows.select("group", *passed, rank, "path", "first", inside)
    return rows.drop("digit", "first")


def _tree(nodes: DataFrame) -> list[DataFrame]:
    """Bands of blocks from (group, rank, hash, ...), until one block is left of each group."""
    bands = []
    while True:
        bands.append(stored(_rolled(nodes), "band"))
        if not bands[-1].where("block > 0").limit(1).count():
            return bands
        nodes = bands[-1].select("group", F.col("block").alias("rank"), "hash")


def _proven(bands: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The nodes of a tree with their proofs, from the proof of each group's top (group, path, ...).

    Inside a block there is no join; blocks, a 4,096th of the nodes of a band, meet their own proofs by their key.
    """
    passed = [c for c in tops.columns if c not in ("group", "path")]
    above = tops.withColumn("block", F.lit(0).cast("bigint"))
    for band in reversed(bands):
        nodes = _opened(band.drop("hash").join(above, ["group", "block"]), passed)
        above = nodes.select("group", F.col("rank").alias("block"), "path", *passed)
    return nodes


def manifest(leaves: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, subroot, root, proof, and all other columns) from ``leaves`` (source, doc_id, leaf, ...).

    Leaves of a source ascend by doc_id, null first, those of one id by leaf; each 16 consecutive nodes become one
    until one is left, the subroot, which for a single leaf is the leaf. Subroots are ordered by source (null first, by
    bytes) and become the root the same way. ``proof`` has a level for each hash on the way up, with the joined
    digests left and right of the own one. No leaves, no rows. Other columns travel with their leaf and should be
    small; none may be named like those here, or group, rank, hash, kids, path, digit, first, block, d0, d1 or d2.
    """
    kept = [c for c in leaves.columns if c not in ("source", "leaf")]
    group = F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("group")  # null before all texts
    ranked = numbered(stored(leaves.select(group, F.col("leaf").alias("hash"), *kept), "leaves"), "group", ["doc_id", "hash"])
    bands = _tree(ranked)
    subroots = bands[-1].select(F.lit("all").alias("group"), "hash", F.col("group").alias("source_key"))
    upper = _tree(numbered(subroots, "group", ["source_key"]))
    start = F.array().cast(PATH).alias("path")
    sources = _proven(upper, upper[-1].select("group", F.col("hash").alias("root"), start))
    tops = sources.select(F.col("source_key").alias("group"), "path", F.col("hash").alias("subroot"), "root")
    source = F.when(F.col("group") != "0", F.expr("substring(group, 2)")).alias("source")
    proven = _proven(bands, tops)
    return proven.select(source, *kept, F.col("hash").alias("leaf"), "subroot", "root", F.col("path").alias("proof"))


def audit(documents: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): does every fifth document's proof notice a change?

    Where 5 divides the crc32 of the id, the text's A-Z are lower-cased before folding; a null text, or one without
    A-Z, stays what it was and verifies. A null id has no crc32 and is not changed; repeated ids are leaves each.
    Empty and very long texts are hashed whole. Other columns of ``documents`` are not read.
    """
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = F.when(hit & (lowered != F.col("text")), leaf(lowered)).alias("changed")
    rows = manifest(documents.select("source", "doc_id", leaf().alias("leaf"), changed))
    proof = F.sha2(F.array_join(F.transform("proof", lambda level: F.concat(level["left"], level["right"])), ""), 256)
    folded = fold(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root")
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded)
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
