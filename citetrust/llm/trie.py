"""The trie of the first turns that conversations share, with totals over each node's subtree.

A node is known by its depth and its owner, the smallest conversation that starts with its turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetrust.llm.ranks import numbered
from citetrust.llm.work import stored

HEIGHT = 64  # of a band: turns that are looked at in one row
FAMILY = 5  # conversations that share the first turns of the first of them
MOST = 9  # first turns that are shared are crc32 of the id modulo this
CHUNK_BITS = 8  # ids with equal higher bits are joined to one text before they are hashed


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, pos, said, n_bytes, length), and all conversations (conv_id, length).

    ``conversations`` (conv_id, turn, role, text) are ordered by turn, null first, and turns with equal numbers by the
    SHA-256 of what was said; a null role or text is empty; rows without conv_id belong to no conversation and are left
    out. A conversation of which nothing is left has length 0. From here on a turn is ``said``, a SHA-256 of role and
    text. ``%`` has the sign of the id.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("said")
    turns = conversations.select("conv_id", "turn", said, F.octet_length(text).cast("bigint").alias("n_bytes"))
    turns = stored(turns.where("conv_id is not null"), "turns")
    turns = numbered(turns, "conv_id", ["turn", "said"]).drop("turn")
    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    shared = (F.crc32(F.col("conv_id").cast("string")) % MOST).alias("shared")
    convs = stored(turns.groupBy("conv_id").agg((F.max("rank") + 1).alias("n")).select("conv_id", "n", base, shared), "sizes")
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    taken = F.least("shared", F.coalesce("n_base", F.lit(0))).alias("taken")
    convs = convs.join(bases, "base", "left").select("conv_id", "base", "shared", "n", taken)
    length = (F.col("taken") + F.greatest(F.col("n") - F.col("shared"), F.lit(0))).alias("length")
    convs = stored(convs.select("conv_id", "base", "shared", "taken", length), "convs")
    own = turns.join(convs, "conv_id").where("rank >= shared")
    own = own.select("conv_id", (F.col("taken") + F.col("rank") - F.col("shared")).alias("pos"), "said", "n_bytes", "length")
    first = turns.where((F.col("rank") < MOST - 1) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    first = first.join(convs, "base").where("rank < taken").select("conv_id", F.col("rank").alias("pos"), "said", "n_bytes", "length")
    return own.unionByName(first), convs.select("conv_id", "length")


def _prefixed(turns: DataFrame, height: int) -> DataFrame:
    """``turns`` (conv_id, pos, said, ...) with ``said`` replaced by a hash of all turns up to that one.

    Turns meet in bands of ``height``, each of which is hashed up to each of its turns; what came before a band is a
    turn of a sequence of bands, which is treated the same way, so there are as many rounds as digits of the length.
    """
    deepest = turns.agg(F.max("pos")).first()[0] or 0
    kept = [c for c in turns.columns if c not in ("conv_id", "pos", "said")]
    turn = F.struct("pos", "said", *kept)
    bands = turns.groupBy("conv_id", F.floor(F.col("pos") / height).alias("band")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    said = F.transform("turns", lambda t: t["said"])
    if deepest < height:
        before = F.lit("")
    else:
        bands = stored(bands, "turns")
        upper = bands.select("conv_id", F.col("band").alias("pos"), F.sha2(F.array_join(said, ""), 256).alias("said"))
        upper = _prefixed(upper, height).select("conv_id", (F.col("pos") + 1).alias("band"), F.col("said").alias("before"))
        bands, before = bands.join(upper, ["conv_id", "band"], "left"), F.coalesce("before", F.lit(""))

    def up_to(t, i):
        digest = F.sha2(F.concat(before, F.array_join(F.slice(said, F.lit(1), i + 1), "")), 256)
        return F.struct(t["pos"].alias("pos"), digest.alias("said"), *[t[c].alias(c) for c in kept])

    return bands.select("conv_id", F.inline(F.transform("turns", up_to)))


def _climbed(paths: DataFrame, height: int) -> DataFrame:
    """Totals (conv_id, depth, leaves, saved) of nodes from (conv_id, band, path), a conversation's nodes in a band.

    Each node adds what it has to its ancestors in the band; a conversation's own nodes are added up before. The root
    of the next band, if the path ends with it, gives its numbers but takes none here.
    """

    def below(node, i):
        rest, none = F.slice(F.col("path"), i + 1, F.size("path")), F.lit(0).cast("bigint")
        leaves = F.aggregate(rest, none, lambda total, n: total + n["leaves"]).alias("leaves")
        saved = F.aggregate(rest, none, lambda total, n: total + n["saved"]).alias("saved")
        return F.struct(node["owner"].alias("conv_id"), node["depth"].alias("depth"), leaves, saved)

    rows = paths.select("band", F.inline(F.transform("path", below))).where(F.floor(F.col("depth") / height) == F.col("band"))
    return rows.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _paths(rows: DataFrame) -> DataFrame:
    """(conv_id, band, path) of the conversations that own a node there."""
    node = F.struct("depth", "owner", "leaves", "saved")
    paths = rows.groupBy("conv_id", "band").agg(F.array_sort(F.collect_list(node)).alias("path"))
    return paths.where(F.exists("path", lambda n: n["owner"] == F.col("conv_id")))


def _totals(chains: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """Totals over the subtrees of all nodes (conv_id, depth, leaves, saved), and the paths (conv_id, band, path).

    ``chains`` (conv_id, depth, owner, leaves, saved) has the nodes on the way of each conversation; a node's own
    numbers stand with its owner and are 0 elsewhere. Nodes explode only to ancestors in their band. The roots of bands
    form a trie of their own, a ``height``-th as deep, whose totals are found the same way and added to the ancestors in
    the band above: rounds grow with the logarithm of the depth, and a path has at most ``height`` + 1 nodes.
    """
    band = F.floor(F.col("depth") / height).alias("band")
    rows = chains.select("conv_id", band, "depth", "owner", "leaves", "saved")
    if (chains.agg(F.max("depth")).first()[0] or 0) >= height:
        inner = _climbed(_paths(rows), height).where(F.col("depth") % height == 0).withColumn("depth", band)
        roots = rows.where(F.col("depth") % height == 0).select("conv_id", F.col("band").alias("depth"), "owner")
        upper = roots.join(inner, ["conv_id", "depth"], "left").na.fill(0, ["leaves", "saved"])
        whole, _ = _totals(stored(upper, "roots"), height)
        below = roots.where("owner = conv_id and depth > 0").join(whole, ["conv_id", "depth"])
        below = below.withColumn("band", F.col("depth") - 1).withColumn("depth", F.col("depth") * height)
        rows = rows.unionByName(below)
    paths = stored(_paths(rows), "paths")
    return _climbed(paths, height), paths


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, depth, ends_sha256) from sorted (conv_id, depth, ids): texts of one node are hashed as they come."""
    node, state = None, None
    for batch in batches:
        done = []
        for *key, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "depth", "ends_sha256"), d, strict=True)) for d in done], ENDS)
    if node is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": node[0], "depth": node[1], "ends_sha256": state.hexdigest()}], ENDS)


ENDS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def _ends(chains: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node. Runs of ids are joined in parallel; only their order is sequential."""
    chunk = F.shiftright("conv_id", CHUNK_BITS).alias("chunk")
    ended = chains.where("last").groupBy("owner", "depth", chunk).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    ids = F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("ids")
    ended = ended.select(F.col("owner").alias("conv_id"), "depth", "chunk", ids).repartition("conv_id", "depth")
    ended = ended.sortWithinPartitions("conv_id", "depth", "chunk").select("conv_id", "depth", "ids")
    return ended.mapInArrow(_digests, "conv_id bigint, depth bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    ``conversations`` (conv_id, turn, role, text) are taken as ``rebuilt`` does. A node is a distinct sequence of
    first turns; the root has none and depth 0. ``conv_id`` is its smallest member, ``n_leaves`` counts childless nodes
    in its subtree, ``saved_tokens`` adds up (n_convs - 1) times the UTF-8 bytes of the last text over its subtree;
    ``ends_sha256`` hashes the ids of members that end there, in ascending order and comma-joined. Repeated rows
    are turns each; texts may have any length and are hashed where they are read; no rows, no root.
    """
    turns, convs = rebuilt(conversations)
    turns = _prefixed(turns, height).withColumn("depth", F.col("pos") + 1).drop("pos")
    root = convs.select("conv_id", F.lit("").alias("said"), F.lit(0).cast("bigint").alias("n_bytes"), "length")
    steps = stored(turns.unionByName(root.withColumn("depth", F.lit(0).cast("bigint"))), "steps")
    last = F.col("depth") == F.col("length")
    nodes = steps.groupBy("depth", "said").agg(
        F.min("conv_id").alias("owner"),
        F.count("*").alias("n_convs"),
        F.min("n_bytes").alias("n_bytes"),
        F.sum(last.cast("bigint")).alias("n_ends"),
    )
    own = F.col("owner") == F.col("conv_id")
    leaves = F.when(own & (F.col("n_ends") == F.col("n_convs")), 1).otherwise(0).cast("bigint").alias("leaves")
    saved = F.when(own, (F.col("n_convs") - 1) * F.col("n_bytes")).otherwise(0).alias("saved")
    chains = steps.select("conv_id", "depth", "said", last.alias("last")).join(nodes, ["depth", "said"])
    chains = stored(chains.select("conv_id", "depth", "owner", "n_convs", "last", leaves, saved), "chains")
    totals, paths = _totals(chains.drop("n_convs", "last"), height)

    def parent(node, i):
        before = F.get(F.col("path"), i - 1)["owner"]
        return F.struct(node["owner"].alias("owner"), node["depth"].alias("depth"), before.alias("parent_conv_id"))

    parents = paths.select("conv_id", F.inline(F.transform("path", parent)))
    parents = parents.where("owner = conv_id and parent_conv_id is not null").drop("owner")
    children = parents.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children")
    )
    parts = chains.where("owner = conv_id").select("conv_id", "depth", "n_convs")
    for part in (totals, parents, children, _ends(chains)):
        parts = parts.unionByName(part, allowMissingColumns=True)
    nothing = hashlib.sha256(b"").hexdigest()
    return parts.groupBy("conv_id", "depth").agg(
        F.max("parent_conv_id").alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"),
        F.coalesce(F.max("n_children"), F.lit(0)).alias("n_children"),
        F.max("leaves").alias("n_leaves"),
        F.max("saved").alias("saved_tokens"),
        F.coalesce(F.max("ends_sha256"), F.lit(nothing)).alias("ends_sha256"),
    )
