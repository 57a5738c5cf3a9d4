from __future__ import annotations

import hashlib
import random
import string
import zlib

import pytest

from citetrust.llm import merkle, ranks, trie
from texts import frame, odd_rows

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def no_nulls(row):
    return tuple((x is not None, x) if not isinstance(x, str) else (True, x) for x in row)


def plain_tree(nodes):
    """The top, and the (left, right) siblings of each node on the way up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            begin = i // 16 * 16
            path.append(("".join(nodes[begin:i]), "".join(nodes[i + 1 : begin + 16])))
        at = [i // 16 for i in at]
        nodes = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_manifest(rows):
    """From (doc_id, source, lang, n_chars, text)."""
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(((row[0] is not None, row[0] or 0, plain_leaf(row)), row))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([leaf for (_, _, leaf), _ in sorted(by[s], key=lambda x: x[0])]) for s in sources}
    root, uppers = plain_tree([trees[s][0] for s in sources]) if by else (None, [])
    out = []
    for source, upper in zip(sources, uppers, strict=True):
        for (key, row), path in zip(sorted(by[source], key=lambda x: x[0]), trees[source][1], strict=True):
            path = path + upper
            folded = key[2]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                folded = plain_leaf((*row[:4], row[4].translate(LOWER)))
            for left, right in path:
                folded = sha(left, folded, right)
            proof = sha(*(left + right for left, right in path))
            out.append((row[0], key[2], trees[source][0], root, proof, folded, folded == root))
    return out


DOCUMENT = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize("n, sources", [(700, 30), (300, 1), (17, 17), (1, 1), (0, 1)])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, n, sources):
    """Small blocks, so that trees have several bands; nulls everywhere, one source with most rows, repeated ids."""
    monkeypatch.setattr(merkle, "DIGITS", 1)
    rng = random.Random(n)
    rows = []
    for k in range(n):
        source = rng.choice([None, "", "É", "z"]) if k % 9 == 0 and sources > 1 else f"s{rng.choice([0, 0, k % sources])}"
        text = rng.choice([None, "", "Hello World", "plain", "ÄÖ Üx", "long TEXT " * 500])
        rows.append((rng.choice([k, k, k // 3, None]), source, rng.choice(["en", None]), rng.choice([k, None]), text))
    rows += rows[: n // 3]
    got = [tuple(r) for r in merkle.audit(spark.createDataFrame(rows, DOCUMENT).repartition(3)).collect()]
    assert sorted(got, key=no_nulls) == sorted(plain_manifest(rows), key=no_nulls)


def test_manifest_of_whole_blocks_and_odd_rows(spark):
    for rows in ([(k, "s", None, k, "t") for k in range(4097)], [(k, "s", "x", 1, "T") for k in range(16)]):
        got = [tuple(r) for r in merkle.audit(spark.createDataFrame(rows, DOCUMENT)).collect()]
        assert sorted(got) == sorted(plain_manifest(rows))
    odd = frame(spark, odd_rows()).withColumnRenamed("tile", "hash").withColumnRenamed("id", "rank")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    got = [tuple(r) for r in merkle.audit(odd).collect()]
    assert sorted(got, key=no_nulls) == sorted(plain_manifest(rows), key=no_nulls)


def test_proofs_fold_to_the_root_and_other_columns_travel(spark):
    leaves = spark.createDataFrame([(f"s{k % 3}", k, sha(str(k)), k * k) for k in range(200)], "source string, doc_id bigint, leaf string, more bigint")
    rows = merkle.manifest(leaves).collect()
    assert len(rows) == 200 and all(r.more == r.doc_id**2 and r.source == f"s{r.doc_id % 3}" for r in rows)
    for r in rows:
        digest = r.leaf
        for level in r.proof:
            digest = sha(level.left, digest, level.right)
        assert digest == r.root


def test_rows_are_numbered_across_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", f"k{k % 50}"]), rng.choice([None, k % 7])) for k in range(3000)]
    got = ranks.numbered(spark.createDataFrame(rows, "key string, n bigint").repartition(5), "key", ["n"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.key, []).append((r.rank, r.n is not None, r.n))
    assert sum(map(len, by.values())) == len(rows)
    for found in by.values():
        found.sort(key=lambda x: x[0])
        assert [x[0] for x in found] == list(range(len(found)))
        order = [x[1:] for x in found]
        assert order == sorted(order, key=lambda x: (x[0], x[1] or 0))


def plain_trie(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = sha(f"{len(role.encode())}:{role}{text}")
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), said, (role, text)))
    convs = {c: [t[2] for t in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = convs.get(c - c % 5, [])[:h] + convs[c][h:]
    nodes, kids, leaves, saved = {}, {}, {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    out = []
    for n in sorted(nodes, key=len, reverse=True):
        below = kids.get(n, [])
        leaves[n] = sum(leaves[k] for k in below) if below else 1
        own = (len(nodes[n]) - 1) * len(n[-1][1].encode()) if n else 0
        saved[n] = own + sum(saved[k] for k in below)
        ends = ",".join(map(str, sorted(c for c in nodes[n] if len(built[c]) == len(n))))
        up = min(nodes[n[:-1]]) if n else None
        out.append((min(nodes[n]), len(n), up, len(nodes[n]), len(below), leaves[n], saved[n], sha(ends)))
    return out


TURN = "conv_id bigint, turn bigint, role string, text string, depth bigint, owner string"


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], TURN).repartition(3)


@pytest.mark.parametrize("height", [2, 64])
def test_trie_equals_a_plain_one(spark, height):
    """Ties and nulls of turns, absent bases, conversations of which nothing is left, extra columns of inner names."""
    rng = random.Random(1)
    rows = [(None, 1, "u", "no conversation"), (3, 0, "u", "x")]
    for c in range(40):
        for t in range(rng.choice([1, 2, 5, 9, 14])):
            rows.append((c * rng.choice([1, 1, 3]), rng.choice([t, t, None, 3]), rng.choice(["u", "a", None]), rng.choice(["x", "yy", None, "é"])))
    rows += [(1000, k, "u", "long " * 3000) for k in range(2)] + rows[:20]
    got = [tuple(r) for r in trie.prefix_trie(turns_frame(spark, rows), height).collect()]
    assert sorted(got, key=no_nulls) == sorted(plain_trie(rows), key=no_nulls)


def test_trie_of_one_deep_conversation_and_of_none(spark):
    rows = [(0, k, "u", f"t{k % 3}") for k in range(90)] + [(5, k, "u", f"t{k % 3}") for k in range(70)]
    got = [tuple(r) for r in trie.prefix_trie(turns_frame(spark, rows), 4).collect()]
    assert sorted(got, key=no_nulls) == sorted(plain_trie(rows), key=no_nulls)
    assert trie.prefix_trie(turns_frame(spark, [])).count() == 0


def test_many_ends_of_one_node_are_hashed_in_runs(spark):
    rows = [(5 * k, 0, "u", "same") for k in range(700)]
    got = [tuple(r) for r in trie.prefix_trie(turns_frame(spark, rows)).collect()]
    assert sorted(got, key=no_nulls) == sorted(plain_trie(rows), key=no_nulls)
