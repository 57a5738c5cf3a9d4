from __future__ import annotations

import re
from pathlib import Path

import pytest
from test_dump import page, revision, write

from citetrust.__main__ import main
from citetrust.fixtures.suffixes import SHORT_SUFFIXES
from citetrust.plans import jobs
from citetrust.sources import tables

T = "{{Circular}} "


def refs(*names):
    return " ".join(f"<ref>http://{n}.org/x</ref>" for n in names)


def history(number, opened, closed):
    first = 10 * number
    return page(number, [revision(first, T + refs(*opened)), revision(first + 1, refs(*closed))])


def test_from_dump_to_scores(spark, tmp_path):
    dump, data = tmp_path / "dump", str(tmp_path / "data")
    dump.mkdir()
    write(
        dump,
        "d.bz2",
        [
            history(1, ["bad", "x", "ok"], ["ok", "good"]),
            history(2, ["bad", "x"], ["good"]),
            history(3, ["bad", "x", "good"], ["good", "bad"]),
            history(7, ["bad", "x", "good"], ["good", "new"]),
        ],
    )
    before = set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("citetrust-*"))
    pairs = jobs.parse_pairs(spark, data, str(dump), "Circular", suffixes=SHORT_SUFFIXES)
    assert re.fullmatch(r".*/revision-pairs-circular-\d{4}-\d\d-\d\dT\d\d-\d\d-\d\dZ", pairs)
    assert tables.read_pairs(spark, pairs).count() == 4
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    assert set(shared.glob("citetrust-*")) == before  # the job's own scratch folder is gone
    revisions = jobs.parse_revisions(spark, data, str(dump), "Circular", suffixes=SHORT_SUFFIXES)
    assert tables.read_revisions(spark, revisions).count() == 8

    assert tuple(jobs.count_source_changes(spark, pairs).first()) == (4, 0)
    probs = jobs.evaluate_pair_sources(spark, data, pairs, "Circular", split=70)
    found = {r.src: (r.p_added, r.occurrences) for r in tables.read_source_probs(spark, probs).collect()}
    assert found == {"bad.org": (1.0, 2), "x.org": (1.0, 3), "good.org": (0.0, 2)}

    unknown = jobs.count_unknown_sources(spark, pairs, probs, split=70).first()
    assert tuple(unknown) == (2, 1, 50.0, 0.5)
    scores = jobs.evaluate_pair_revisions(spark, data, pairs, probs, "Circular", split=70)
    stored = {r.revision_id: r.probabilityTemplateAdded for r in spark.read.csv(scores, header=True).collect()}
    assert set(stored) == {"70", "71"} and stored["71"] == "-0.5000"
    assert 0.6 < float(stored["70"]) < 0.8

    by_revision = jobs.evaluate_sources(spark, data, revisions, "Circular", split=70)
    scores = jobs.evaluate_revisions(spark, data, revisions, by_revision, "Circular", split=70)
    assert spark.read.csv(scores, header=True).count() == 2
    three_way = jobs.evaluate_pair_sources_with_unchanged(spark, data, pairs, "Circular")
    assert "probabilityTemplateUnchanged" in spark.read.csv(three_way, header=True).columns

    masked = jobs.mask_data(spark, data, revisions, 70, "Circular")
    assert "/revisions-masked-Circular-" in masked
    working = tables.read_revisions(spark, masked).where("ta or tr")
    assert working.count() == 6 and tables.read_revisions(spark, masked).where("ta_gt").count() == 4
    labels = spark.read.csv(jobs.extract_labels(spark, data, masked, "Some Thing"), header=True)
    pair_labels = jobs.extract_pair_labels(spark, data, pairs, "Circular", single_file=True)
    assert "/labels-circular-" in pair_labels
    assert sorted(map(tuple, labels.collect())) == sorted(
        map(tuple, spark.read.csv(pair_labels, header=True).collect())
    )


def test_rules_are_required(spark, tmp_path, capsys):
    with pytest.raises(TypeError, match="suffixes"):
        jobs.parse_pairs(spark, str(tmp_path), str(tmp_path), "Circular")
    with pytest.raises(SystemExit):
        main(["parse_pairs", str(tmp_path), str(tmp_path), "Circular"])
    assert "--suffixes" in capsys.readouterr().err


def test_command_line(spark, tmp_path, capsys):
    dump, data = tmp_path / "dump", tmp_path / "data"
    dump.mkdir()
    write(dump, "d.bz2", [history(1, ["a.b", "x"], ["x"])])
    rules = tmp_path / "rules"
    rules.write_text("org\nb.org\n")
    main(["parse_pairs", str(data), str(dump), "Circular", "--suffixes", str(rules)])
    pairs = capsys.readouterr().out.strip()
    assert tables.read_pairs(spark, pairs).first().src_ta == ["a.b.org", "x.org"]
    main(["count_source_changes", pairs])
    assert "|1      |0        |" in capsys.readouterr().out
    main(["evaluate_pair_sources", str(data), pairs, "Circular", "--split", "11", "--single_file"])
    probs = capsys.readouterr().out.strip()
    assert tables.read_source_probs(spark, probs).count() == 1
