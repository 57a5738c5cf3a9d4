from __future__ import annotations

import random

import pytest
from brute import episodes
from pyspark.sql import functions as F

from citetrust.fixtures.suffixes import SHORT_SUFFIXES
from citetrust.operators import pairing
from citetrust.operators.pairing import block_pairs, inline_pairs, pairs_to_revisions

REVISIONS = "page_id bigint, rev_id bigint, pos bigint, text string"
BAD, GOOD = "<ref>http://news.shaky.net</ref>", "<ref>http://good.org</ref>"
T = "{{Doubtful}} "


def table(spark, rows):
    return spark.createDataFrame(rows, REVISIONS)


def ids(pairs):
    return sorted((r.page_id, r.rev_id_ta, r.rev_id_tr) for r in pairs.collect())


def test_scenario(spark):
    """Two finished episodes; a third begins and never ends."""
    texts = [T, BAD, "", T + BAD, T, BAD, "x " + T + BAD]
    found = block_pairs(table(spark, [(40, 400 + k, 3 * k, x) for k, x in enumerate(texts)]), "doubtful", SHORT_SUFFIXES)
    assert ids(found) == [(40, 400, 401), (40, 403, 405)]
    assert {(tuple(r.src_ta), tuple(r.src_tr)) for r in found.collect()} == {
        ((), ("shaky.net",)),
        (("shaky.net",), ("shaky.net",)),
    }


def test_rules_of_pairing(spark):
    rows = [
        # A closing revision without sources: dropped, but the episode is over.
        (1, 1, 1, T + BAD),
        (1, 2, 2, "nothing"),
        (1, 3, 3, GOOD),
        # Order is the position, not the id.
        (2, 30, 1, T + BAD),
        (2, 20, 2, "{{doubtful|x}}" + GOOD),
        (2, 10, 3, GOOD),
        # A missing text has no template and no sources.
        (3, 1, 1, T + BAD),
        (3, 2, 2, None),
        # An episode does not go on in the next page.
        (4, 1, 1, T + BAD),
        (5, 2, 2, GOOD),
        # The opening revision may cite nothing.
        (6, 1, 1, T),
        (6, 2, 2, GOOD),
    ]
    found = block_pairs(table(spark, rows), "Doubtful", SHORT_SUFFIXES)
    assert ids(found) == [(2, 30, 10), (6, 1, 2)]
    by_page = {r.page_id: r for r in found.collect()}
    assert by_page[2].src_ta == ["shaky.net"] and by_page[2].src_tr == ["good.org"]
    assert by_page[6].src_ta == []


def random_history(seed, pages, steps, spread):
    rng = random.Random(seed)
    rows, rev = [], 0
    for page in range(pages):
        pos, stay = 0, rng.choice([0.1, 0.5, 0.95])
        on = False
        # The first page is much longer than the others together.
        for _ in range(steps * (8 if page == 0 else 1)):
            pos += rng.randint(1, spread)
            rev += rng.randint(1, 3)
            on = on if rng.random() < stay else not on
            refs = f"<ref>http://s{rng.randint(0, 5)}.org</ref>" if rng.random() < 0.8 else "-"
            rows.append((page, rev, pos, (T if on else "") + refs))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, spread, parts", [(1, 1, 4), (2, 9, 40), (3, 2**20, 7), (4, 3, 200), (5, 2**40, 25)])
def test_ranges_do_not_change_the_pairs(spark, seed, spread, parts):
    """Many small ranges, so that episodes begin, end and last across many of them, also with positions far apart."""
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges_do_not_change_the_pairs(spark, seed, spread)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def ranges_do_not_change_the_pairs(spark, seed, spread):
    rows = random_history(seed, 6, 60, spread)
    expected = []
    for page in {r[0] for r in rows}:
        history = sorted((r for r in rows if r[0] == page), key=lambda r: r[2])
        for opened, closed in episodes(history, lambda r: r[3].startswith(T)):
            if "ref" in closed[3]:
                expected.append((page, opened[1], closed[1], opened[3][-12:], closed[3][-12:]))
    got = [
        (r.page_id, r.rev_id_ta, r.rev_id_tr, r.src_ta, r.src_tr)
        for r in block_pairs(table(spark, rows), "Doubtful", SHORT_SUFFIXES).collect()
    ]
    assert sorted(e[:3] for e in expected) == sorted(g[:3] for g in got)
    sides = {e[:3]: e[3:] for e in expected}
    for page, ta, tr, src_ta, src_tr in got:
        opening, closing = sides[page, ta, tr]
        assert src_tr[0] in closing and (not src_ta or src_ta[0] in opening)
    assert len(expected) > 50


def explained(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return [n.strip() for n in df._jdf.queryExecution().explainString(mode).split("\n\n") if n.strip()]


@pytest.mark.parametrize("pairs_of", [block_pairs, inline_pairs])
def test_pairs_are_found_from_flags(spark, tmp_path, pairs_of):
    """What is shuffled to find pairs holds neither texts nor sources; flags are dealt out by ranges of places."""
    table(spark, [(1, 1, 1, T)]).write.parquet(str(tmp_path / "t"))
    found = pairing._table_pairs(spark.read.parquet(str(tmp_path / "t")), "Doubtful", str(tmp_path / "s"))
    nodes = explained(spark, found)
    exchanges = [n for n in nodes if ") Exchange" in n.splitlines()[0]]
    assert len(exchanges) == 3 and sum("rangepartitioning" in n for n in exchanges) == 1
    assert not any("text" in n or "src" in n for n in nodes)
    pairs = pairs_of(spark.read.parquet(str(tmp_path / "t")), "Doubtful", SHORT_SUFFIXES)
    assert not any("Nested" in n or "Cartesian" in n for n in explained(spark, pairs))


def test_texts_are_dropped_before_they_are_shuffled(spark, tmp_path):
    """Without a broadcast, a runtime filter on the places of the ends stands below the exchange of texts."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    saved = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        table(spark, [(1, k, k, T if k % 2 else GOOD) for k in range(50)]).write.parquet(str(tmp_path / "t"))
        pairs = block_pairs(spark.read.parquet(str(tmp_path / "t")), "Doubtful", SHORT_SUFFIXES)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "might_contain" in plan
        assert pairs.count() == 24
    finally:
        for key, value in saved.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_each_end_is_shuffled_once_to_meet_its_pair(spark, tmp_path):
    """The exchange by pair carries two rows for each pair, and texts are no part of it."""
    table(spark, [(1, k, k, T if k % 2 else GOOD) for k in range(50)]).write.parquet(str(tmp_path / "t"))
    revisions = spark.read.parquet(str(tmp_path / "t"))
    found = pairing._table_pairs(revisions, "Doubtful", str(tmp_path / "s"))
    wanted = pairing._stored(pairing.pair_ends(found, pairing.TABLE_PLACE), str(tmp_path / "e"))
    ends = pairing.at_ends(wanted, revisions, pairing.TABLE_PLACE)
    sourced = ends.withColumn("src", pairing.extract_sources(F.col("text"), SHORT_SUFFIXES)).drop("text")
    assert sourced.count() == wanted.count() == 2 * 24
    pairs = pairing.paired(sourced)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and pairs.count() == 24
    by_pair = [n for n in explained(spark, pairs) if ") Exchange" in n.splitlines()[0] and "pair#" in n.split("Arguments")[-1]]
    assert len(by_pair) == 1 and "text" not in by_pair[0]


@pytest.mark.parametrize("lost", [[1], [2], [1, 2]])
def test_ends_without_text_are_an_error(spark, tmp_path, lost):
    """Pairs don't vanish if the texts are not where they were found; a revision without page has no place."""
    rows = table(spark, [(1, 1, 1, T + GOOD), (1, 2, 2, GOOD), (2, 3, 1, T), (2, 4, 2, GOOD), (None, 5, 1, T), (None, 6, 2, GOOD)])
    found = pairing._table_pairs(rows, "Doubtful", str(tmp_path / "a"))
    place = pairing.TABLE_PLACE
    assert pairing.block_sources(found, rows, place, SHORT_SUFFIXES, str(tmp_path / "a")).count() == 2
    fewer = rows.where(~F.col("rev_id").isin(lost))
    with pytest.raises(Exception, match="no text at the end"):
        pairing.block_sources(found, fewer, place, SHORT_SUFFIXES, str(tmp_path / "b")).count()


def test_edges_of_a_page_with_sparse_positions_are_few(spark):
    """One long page, positions far apart: only the rows at the ends of ranges meet in the group of the page."""
    rows = [(1, k, k * 2**20, (T if k % 2 else "") + GOOD) for k in range(2000)]
    marked = pairing.flags(table(spark, rows), "Doubtful").repartitionByRange(8, "page_id", "pos")
    chunks = pairing._pair_in_chunks(marked.withColumn("_range", F.spark_partition_id()), ["page_id"], "_range", ["pos"])
    assert chunks.where("edge").count() <= 2 * 8 and chunks.count() > 900


def test_inline(spark):
    flag = "{{Bad source}}"
    rows = [
        # Of two marked sources one is still named in the closing text, outside any ref.
        (1, 1, 1, f"<ref>http://a.org</ref>{flag}\n<ref>http://b.org</ref>{flag}"),
        (1, 2, 2, "still citing www.b.org/page"),
        # None left: dropped.
        (2, 1, 1, f"<ref>http://a.org</ref>{flag}"),
        (2, 2, 2, "nothing"),
        # The name is looked for as it is written.
        (3, 1, 1, f"<ref>http://a.org</ref>{flag}"),
        (3, 2, 2, "A.ORG"),
        # Not a bare URL: no source, no pair.
        (4, 1, 1, f"<ref>see http://a.org</ref>{flag}"),
        (4, 2, 2, "http://a.org"),
    ]
    found = inline_pairs(table(spark, rows), "Bad source", SHORT_SUFFIXES).collect()
    assert [(r.page_id, r.src_ta, r.src_tr) for r in found] == [(1, ["a.org", "b.org"], ["b.org"])]


def test_pairs_to_revisions(spark):
    schema = "page_id bigint, rev_id_ta bigint, rev_id_tr bigint, src_ta array<string>, src_tr array<string>"
    pairs = spark.createDataFrame([(9, 1, 2, ["a"], ["b", "c"])], schema)
    assert {tuple(map(str, r)) for r in pairs_to_revisions(pairs).collect()} == {
        ("1", "2", "9", "True", "False", "True", "False", "['a']"),
        ("2", "1", "9", "False", "True", "False", "True", "['b', 'c']"),
    }
