from __future__ import annotations

import hashlib
import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citetrust.llm import ngram_join, repeats
from citetrust.llm.components import components, stars
from citetrust.llm.words import Rolling, shingle_sets
from citetrust.llm.work import utf8
from texts import frame, odd_rows, sentence

SF = "/root/testdata/sf0.001"


def shingles(text: str | None, width: int) -> frozenset:
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def plain_join(rows: list[tuple], width: int, percent: int) -> list[tuple]:
    sets = [(k, shingles(t, width)) for k, t in rows]
    known = [(k, s) for k, s in sets if k is not None and s]
    reach = {k: k for k, _ in known}
    number = {k: 0 for k, _ in known}

    def find(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for i, (a, s) in enumerate(known):
        for b, t in known[i + 1 :]:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                number[a] += 1
                number[b] += 1
                x, y = sorted((find(a), find(b)))
                reach[y] = x
    return [(k, len(s), find(k) if k in reach else k, number.get(k, 0)) for k, s in sets]


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_join_is_exact(spark, width, percent):
    rows = odd_rows()
    rows = [r for r in rows if r[0] != 400] + [(400, dict(rows)[1])]
    got = ngram_join.join(frame(spark, rows), width, percent).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_join(rows, width, percent), key=key)


def test_repeated_rows_are_copies(spark):
    text = sentence(random.Random(1), 30)
    got = ngram_join.join(frame(spark, [(7, text)] * 3 + [(4, text.replace("th", "TH")), (9, None)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(4, 4), (7, 4), (7, 4), (7, 4), (9, 9)]
    assert ngram_join.join(frame(spark, [])).count() == 0


def test_large_family_is_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 8)
    monkeypatch.setattr(ngram_join, "MAP_ROWS", 11)
    rng = random.Random(8)
    words, rows = sentence(rng, 90).split(), []
    for k in range(70):
        own = list(words[: 60 + k % 31])
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"w{k}{rng.randrange(99)}"
        rows.append((k, " ".join(own)))
    got = ngram_join.join(frame(spark, rows), 3, 80).collect()
    assert sorted(map(tuple, got)) == sorted(plain_join(rows, 3, 80))


@pytest.mark.parametrize("percent", [80, 90])
def test_near_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for n in [1, 2, 3, 4, 5, 7, 9, 10, 11, 19, 20, 50, 333]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            most = 2 * n * (100 - percent) // (100 + percent)
            gone = int(rng.integers(0, most + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[gone // 2 :], rng.integers(0, 1 << 63, gone).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * (len(a) + len(b) - both):
                continue
            s, owner = ngram_join.part_signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
            assert set(s[owner == 0].tolist()) & set(s[owner == 1].tolist())


def test_hashes_do_not_depend_on_the_place():
    texts = ["x yy", "some words go before x yy", "", "x yy"]
    data, at = utf8(pa.array(texts))
    roll = Rolling(data)
    ends = np.array([4, at[2], at[4]])
    assert len(set(roll.of(ends - 4, ends).tolist())) == 1
    alone, _ = shingle_sets(*utf8(pa.array(["x yy"])), 3)
    many, begin = shingle_sets(data, at, 3)
    assert many[begin[3]] == alone[0] and begin.tolist()[2] == begin.tolist()[3]


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 240)]
    edges += [(None, 3), (4, None), (5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: find(k) for k in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_stars_hang_every_node_on_the_smallest_it_reaches(seed):
    random = np.random.default_rng(seed)
    a, b = random.integers(-30, 30, (2, int(random.integers(0, 80)))) * 7
    root = {int(x): int(x) for x in [*a, *b]}
    for _ in root:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            root[x] = root[y] = min(root[x], root[y])
    low, node = stars(a, b)
    assert sorted(zip(low.tolist(), node.tolist(), strict=True)) == sorted((r, x) for x, r in root.items() if r != x)


def plain_repeats(rows: list[tuple], length: int = 50) -> list[tuple]:
    later = 1 << 62
    first: dict[bytes, int] = {}
    texts = [(later if k is None else k, k, (t or "").encode()) for k, t in rows]
    for k, _, raw in sorted(texts, key=lambda r: r[0]):
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], k)
    out = []
    for k, doc_id, raw in texts:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < k:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_are_exact(spark):
    rows = odd_rows()
    rng = random.Random(9)
    # Matches of exactly 49, 50 and 51 bytes, at the ends of texts too, and texts over two letters.
    core = "".join(rng.choice("abcdefghij") for _ in range(51))
    rows += [(500, "x" + core), (501, "y" + core[:49] + "z"), (502, "y" + core[:50] + "z"), (503, core[1:] + "q"), (504, core)]
    rows += [(510 + k, "".join(rng.choice("ab") for _ in range(rng.randint(40, 600)))) for k in range(12)]
    rows += [(530 + k, "".join(rng.choice(["abcab ", "x", "é"]) for _ in range(rng.randint(40, 300)))) for k in range(12)]
    got = repeats.remove_repeats(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_repeats(rows), key=key)
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_repeats_in_many_buckets_and_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_ENTRIES", 50)
    monkeypatch.setattr(repeats, "SUFFIX_BYTES", 300)
    rows = odd_rows(seed=12)
    got = repeats.remove_repeats(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_repeats(rows), key=key)


def test_common_edges_are_split(spark, monkeypatch):
    """A short line and a passage in a third of all documents: few rows are sorted at once, and results stay exact."""
    monkeypatch.setattr(repeats, "SUFFIX_BYTES", 800)
    monkeypatch.setattr(repeats, "SAMPLE", 1)  # counts are exact then
    most, plain = 800 // 76, repeats.suffix_levels

    def bounded(data, at, depth):
        assert len(at) - 1 <= most, f"{len(at) - 1} rows at once"
        return plain(data, at, depth)

    monkeypatch.setattr(repeats, "suffix_levels", bounded)
    rng = random.Random(5)
    line, passage = "a line of thirty-six bytes, not more", sentence(rng, 40)
    own = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 90)))
    rows = [(k, own() + ("", line, passage)[k % 3] + own()) for k in range(240)]
    rows += [(300, passage[:60]), (None, passage), (301, "-" * 200), (302, "-" * 90), (5, passage)]
    rng.shuffle(rows)
    got = repeats.remove_repeats(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_repeats(rows), key=key)


def test_without_repeats_keeps_rows_and_columns(spark):
    docs = frame(spark, [(1, "é" * 40), (2, "a" + "é" * 40 + "b"), (3, None), (4, "short")])
    got = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert got[2].text == "ab" and got[2].n_chars == 2 and got[1].text == "é" * 40 and got[3].text is None
    assert got[4].tile == "tile" and got[4].starts == "starts" and len(got) == 4


def test_suffix_order():
    data, at = utf8(pa.array(["banana", "ananas", "an"]))
    rank = repeats.suffix_ranks(data, at, 3)
    cut = [t[k : k + 3] for t in ("banana", "ananas", "an") for k in range(len(t))]
    assert np.argsort(rank, kind="stable").tolist() == sorted(range(len(cut)), key=lambda k: (cut[k], k))
    assert (rank[1] == rank[6]) and rank[12] != rank[1]


def test_one_of_each(spark):
    text = sentence(random.Random(2), 80)
    docs = frame(spark, [(3, text), (1, text + " more"), (1, text + " more"), (8, "other words here"), (None, text), (5, None)])
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or -1) for r in got.collect())) == [-1, 1, 5, 8]


def test_one_id_with_different_texts(spark):
    rng = random.Random(4)
    one, two, three = (sentence(rng, 80) for _ in range(3))
    rows = [(4, one), (4, two), (4, two.replace("th", "TH")), (2, two + " more"), (9, one), (9, three), (None, one), (4, None), (4, one)]
    got = ngram_join.one_of_each(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted([(4, one), (2, two + " more"), (9, three), (-1, one), (4, "")])


def test_planted_copies_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = ngram_join.join(docs, 5, 80).collect()
    assert sorted(map(tuple, got)) == sorted(plain_join(rows, 5, 80))
    assert repeats.remove_repeats(docs).agg(F.sum("n_removed")).first()[0] == sum(r[2] for r in plain_repeats(rows))


def test_longest_previous_factors():
    """Against the plain definition: the longest start of a suffix that begins in an earlier text of the group, too."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(30)] + ["", "abab" * 9]
    data, at = utf8(pa.array(texts))
    for depth in (3, 9, 20):
        levels = repeats.suffix_levels(data, at, depth)
        text = np.repeat(np.arange(len(texts)), np.diff(at))
        owner = np.array([rng.randrange(12) for _ in texts])[text]
        group = np.array([rng.randrange(3) for _ in data])
        place = np.arange(len(data))
        got = repeats.longest_previous_factors(levels, data, at, place, group, owner, np.ones(len(data), bool))
        raw = data.tobytes().decode()
        cut = [raw[k : min(k + depth, at[t + 1])] for k, t in enumerate(text)]
        for k in place:
            others = [cut[j] for j in place if group[j] == group[k] and owner[j] < owner[k]]
            assert got[k] == max((len(os.path.commonprefix([cut[k], o])) for o in others), default=0)


def test_previous_smaller():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 300):
        value, edge = rng.integers(0, 9, n), rng.random(n) < 0.05
        edge[:1] = True
        begin = np.flatnonzero(edge)[np.cumsum(edge) - 1] if n else np.zeros(0, np.int64)
        got = repeats.previous_smaller(value, begin)
        want = [max((j for j in range(begin[k], k) if value[j] < value[k]), default=-1) for k in range(n)]
        assert got.tolist() == want


def thue_morse(letters: int) -> tuple[str, str]:
    """Two words whose polynomial hashes modulo 2^64 agree for long lengths, whatever the base."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(letters))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_long_words_are_told_apart(spark):
    rows = [(10 * k + j, f"{word} x y") for k in range(8, 14) for j, word in enumerate(thue_morse(1 << k))]
    rows += [(1000 + k, text) for k, text in rows[:2]]
    got = {r.doc_id: r for r in ngram_join.join(frame(spark, rows), width=3, percent=90).collect()}
    for k, text in rows:
        assert got[k].component_id == min(j for j, other in rows if other == text)


def test_orders_and_spans_without_loops():
    """Against numpy's own sort and the plain merge, also where keys don't fit 64 bits or there is nothing to sort."""
    rng = np.random.default_rng(6)
    for n, most in ((0, 5), (1, 5), (400, 9), (400, 1 << 62)):
        keys = [rng.integers(0, most, n) for _ in range(3)]
        assert repeats.packed_order(*keys).tolist() == np.lexsort(keys[::-1]).tolist()
        hashes = [k.astype(np.uint64) * np.uint64(1 + 2 * (most < 10)) for k in keys[:2]]
        assert repeats.hash_order(*hashes, keys[2]).tolist() == np.lexsort([keys[2], *hashes[::-1]]).tolist()
        starts = rng.integers(0, 60, n)
        owner, ends = keys[0] % 7, starts + rng.integers(1, 9, n)
        found = repeats.span_rows(owner, starts, ends)
        assert found[0].tolist() == sorted(set(owner.tolist()))
        for t, s, e in zip(found[0], *(x.to_pylist() for x in found[1:]), strict=True):
            want = repeats.runs(starts[owner == t], ends[owner == t])
            assert [np.frombuffer(x, "<i8").tolist() for x in (s, e)] == [x.tolist() for x in want]


def test_few_suffixes_are_sorted_at_once(monkeypatch):
    """Anchors of 4 rows each: what is sorted together stays within a core's cache (it was 1 MB before)."""
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"abcdefgh", k=76)) for _ in range(1 << 12)] * 2
    n, plain, sizes = len(texts), repeats.suffix_levels, []
    lists = [[k // 4 for k in range(n)], list(range(n)), list(range(n)), [26] * n, [26] * n, [1] * n, [76] * n]
    row = (0, *[np.array(x, np.int64).tobytes() for x in lists], b"".join(texts))
    monkeypatch.setattr(repeats, "suffix_levels", lambda data, at, depth: sizes.append(len(data)) or plain(data, at, depth))
    list(repeats._compare(50)(iter([repeats._rows([row], repeats.AROUND)])))
    assert sum(sizes) == 76 * n and max(sizes) <= 1 << 18


def test_shared_signatures_in_bounded_memory():
    """A bucket of two million signatures, half of them shared, of which sorting all at once took 270 MB."""
    rng = np.random.default_rng(2)
    n, blocks = 1 << 21, 64
    signature = rng.integers(0, n, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7)
    ids = rng.integers(0, 1 << 40, n)
    cut = zip(np.split(signature, blocks), np.split(ids, blocks), strict=True)
    rows = [(7, s.tobytes(), d.tobytes()) for s, d in cut]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["bucket", "signatures", "ids"]) for row in rows
    ]
    tracemalloc.start()
    found = pa.Table.from_batches(list(ngram_join._shared(iter(batches))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    order = np.argsort(signature, kind="stable")
    first = np.append(True, np.diff(signature[order]) > 0)
    leader = ids[order][first][np.cumsum(first) - 1]
    low, high = stars(leader, ids[order])
    got = stars(found["a"].to_numpy(), found["b"].to_numpy())
    assert got[0].tolist() == low.tolist() and got[1].tolist() == high.tolist()
    assert peak < 220 << 20
