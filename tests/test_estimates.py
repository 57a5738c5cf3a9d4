from __future__ import annotations

import random

import pytest
from brute import estimate

from citetrust.operators.diagnostics import count_source_changes
from citetrust.operators.labels import before_split, from_split, labels, mask_labels
from citetrust.operators.pairing import pairs_to_revisions
from citetrust.operators.source_stats import (
    estimate_from_changes,
    estimate_from_pairs,
    estimate_from_revisions,
    estimate_with_unchanged,
    rounded,
    with_votes,
)
from citetrust.schemas import PAIRS, REVISIONS


def pairs_table(spark, sides):
    rows = [(1, 10 * i + 1, 10 * i + 2, ta, tr) for i, (ta, tr) in enumerate(sides)]
    return spark.createDataFrame(rows, PAIRS)


def collected(estimates):
    return {r.src: tuple(r)[1:] for r in estimates.collect()}


def test_unchanged_source(spark):
    """One source on both sides of two pairs."""
    pairs = pairs_table(spark, [(["bad.com"], ["bad.com"])] * 2)
    assert collected(estimate_from_revisions(pairs_to_revisions(pairs))) == {"bad.com": (0.5, 0.5, 4)}
    assert collected(estimate_from_pairs(pairs)) == {"bad.com": (0.0, 1.0, 2)}
    assert collected(estimate_from_changes(pairs)) == {"bad.com": (0.5, 0.5, 0)}
    assert collected(with_votes(estimate_from_changes(pairs))) == {}
    assert collected(estimate_with_unchanged(pairs)) == {"bad.com": (0.0, 0.0, 1.0, 2)}
    assert tuple(count_source_changes(pairs).first()) == (0, 2)


def random_sides(seed, n=200):
    rng = random.Random(seed)
    names = ["a.org", "b.org", "b.org)", "c.org|x", "c.org", "d.org"]
    return [tuple(rng.choices(names, k=rng.randint(0, 4)) for _ in range(2)) for _ in range(n)]


def close(found, expected):
    assert found.keys() == expected.keys()
    for src, values in expected.items():
        assert found[src] == pytest.approx(values, abs=1e-6)


def test_against_counting(spark):
    sides = random_sides(4)
    pairs = pairs_table(spark, sides)

    def count(classify, clean=lambda s: s):
        votes = {}
        for ta, tr in sides:
            ta, tr = [clean(s) for s in ta], [clean(s) for s in tr]
            for src in {*ta, *tr}:
                vote = votes.setdefault(src, [0, 0])
                added, removed = classify(src in ta, src in tr)
                vote[0] += added
                vote[1] += removed
        return estimate(votes)

    close(collected(estimate_from_pairs(pairs)), count(lambda a, r: (not r, r)))
    changes = count(
        lambda a, r: (a and not r, r and not a), lambda s: s.split("|")[0].rstrip(")")
    )
    close(collected(estimate_from_changes(pairs)), changes)

    votes = {}
    for ta, tr in sides:
        for i, side in enumerate((ta, tr)):
            for src in side:
                votes.setdefault(src, [0, 0])[i] += 1
    close(collected(estimate_from_revisions(pairs_to_revisions(pairs))), estimate(votes))

    three = {}
    for ta, tr in sides:
        for src in {*ta, *tr}:
            kind = 2 if src in ta and src in tr else 0 if src in ta else 1
            three.setdefault(src, [0, 0, 0])[kind] += 1
    expected = {s: (*(v / sum(k) for v in k), sum(k)) for s, k in three.items()}
    close(collected(estimate_with_unchanged(pairs)), expected)


def test_unlabelled_revisions_do_not_vote(spark):
    rows = [
        (1, 0, 1, False, False, True, False, ["a"]),
        (2, 0, 1, True, True, True, False, ["a", "a"]),
        (3, 0, 1, False, False, False, True, ["b"]),
    ]
    found = collected(estimate_from_revisions(spark.createDataFrame(rows, REVISIONS)))
    assert found == {"a": (1.0, 0.0, 2), "b": (0.5, 0.5, 0)}


def test_rounded(spark):
    pairs = pairs_table(spark, [(["x"], []), ([], ["x"]), ([], ["x"])])
    row = rounded(estimate_from_changes(pairs)).first()
    assert (str(row.p_added), str(row.p_removed), row.occurrences) == ("0.3333", "0.6667", 3)
    row = rounded(estimate_with_unchanged(pairs)).first()
    assert [str(v) for v in row][1:] == ["0.3333", "0.6667", "0.0000", "3"]


def test_source_changes(spark):
    sides = [
        (["a", "b"], ["b", "a"]),
        (["a", "a"], ["a"]),
        (["a", "a", "b"], ["a", "b", "b"]),
        (["a"], ["b"]),
        ([], []),
    ]
    assert tuple(count_source_changes(pairs_table(spark, sides)).first()) == (2, 3)
    assert tuple(count_source_changes(pairs_table(spark, [])).first()) == (0, 0)


def test_splits(spark):
    pairs = pairs_table(spark, [(["a"], ["a"])] * 5)
    ids = [r.rev_id_ta for r in pairs.collect()]
    assert [r.rev_id_ta for r in before_split(pairs, 21).collect()] == ids[:2]
    assert [r.rev_id_ta for r in from_split(pairs, 21).collect()] == ids[2:]
    assert before_split(pairs).count() == from_split(pairs).count() == 5
    # The closing revision goes where its opening one goes.
    assert [r.revision_id for r in pairs_to_revisions(from_split(pairs, 41)).collect()] == [41, 42]


def test_labels_and_masking(spark):
    revisions = pairs_to_revisions(pairs_table(spark, [(["a"], ["a"])] * 2))
    masked = mask_labels(revisions, 11)
    found = {r.revision_id: (r.ta, r.tr, r.ta_gt, r.tr_gt) for r in masked.collect()}
    assert found == {
        1: (True, False, True, False),
        2: (False, True, False, True),
        11: (False, False, True, False),
        12: (False, False, False, True),
    }
    stored = {tuple(r) for r in labels(masked).collect()}
    assert (11, 12, "1.0", "0.0") in stored and (12, 11, "0.0", "1.0") in stored
    # Ground truth is taken from the working labels, whatever it was before.
    assert {r.ta_gt or r.tr_gt for r in mask_labels(masked, 0).collect() if r.revision_id > 10} == {False}
