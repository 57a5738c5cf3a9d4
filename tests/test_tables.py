from __future__ import annotations

import csv
import glob

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from citetrust.operators.diagnostics import count_source_changes
from citetrust.operators.labels import before_split, from_split, labels
from citetrust.operators.pairing import pairs_to_revisions
from citetrust.operators.source_stats import rounded
from citetrust.schemas import PAIRS, REVISIONS
from citetrust.sources import tables


def csv_lines(folder):
    lines = []
    for path in sorted(glob.glob(f"{folder}/*.csv")):
        with open(path, newline="") as handle:
            lines.append(list(csv.reader(handle)))
    return lines


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pairs(spark, tmp_path):
    folder = str(tmp_path / "pairs")
    pairs = spark.createDataFrame([(1, 2, 3, ["a"], ["b", "c"]), (2, 4, 5, [], ["x"])], PAIRS)
    for _ in range(2):  # overwrites
        tables.write_pairs(pairs, folder)
    assert rows(tables.read_pairs(spark, folder)) == rows(pairs)
    assert spark.read.parquet(folder).dtypes[:3] == [
        ("revIdTA", "bigint"),
        ("revIdTR", "bigint"),
        ("pageId", "int"),
    ]
    assert glob.glob(f"{folder}/*.snappy.parquet")


def test_revisions(spark, tmp_path):
    folder = str(tmp_path / "revisions")
    table = spark.createDataFrame([(1, 2, 3, False, True, True, False, ["a"])], REVISIONS)
    tables.write_revisions(table, folder)
    assert tuple(spark.read.parquet(folder).first())[3:7] == ("0.0", "1.0", "1.0", "0.0")
    assert rows(tables.read_revisions(spark, folder)) == rows(table)
    without = tables.read_revisions(spark, folder, has_ground_truth=False).first()
    assert (without.ta_gt, without.tr_gt) == (False, True)


def test_label_threshold(spark, tmp_path):
    folder = str(tmp_path / "r")
    stored = "revId bigint, pairId bigint, pageId int, tA string, tR string, tA_GT string, tR_GT string, src array<string>"
    values = [(1, 2, 3, "0.9999", "0.9998", "1", "0.5", ["a"])]
    spark.createDataFrame(values, stored).write.parquet(folder)
    row = tables.read_revisions(spark, folder).first()
    assert (row.ta, row.tr, row.ta_gt, row.tr_gt) == (True, False, True, False)


@pytest.mark.parametrize("read", [tables.read_pairs, tables.read_revisions, tables.read_source_probs])
def test_missing_folder(spark, tmp_path, read):
    with pytest.raises(AnalysisException):
        read(spark, str(tmp_path / "none"))


def test_source_probs(spark, tmp_path):
    folder = str(tmp_path / "probs")
    names = ["a.com", 'q"x,y', "line\nbreak", "a\r\nb", "back\\slash", "not\\na break", "\\", " spaced ", "", "é.org", 'q\\"z']
    schema = "src string, p_added double, p_removed double, occurrences bigint"
    found = rounded(spark.createDataFrame([(n, 1 / 3, 2 / 3, 3) for n in names], schema))
    tables.write_source_probs(found, folder, single_file=True)
    (lines,) = csv_lines(folder)
    assert lines[0] == ["src", "probabilityTemplateAdded", "probabilityTemplateRemoved", "occurences"]
    assert ["a.com", "0.3333", "0.6667", "3"] in lines
    stored = tables.read_source_probs(spark, folder)
    assert sorted(r.src for r in stored.collect()) == sorted(names)
    row = stored.first()
    assert (round(row.p_added, 6), round(row.p_removed, 6), row.occurrences) == (0.3333, 0.6667, 3)
    with pytest.raises(AnalysisException):
        tables.write_source_probs(found, folder)


def test_three_way_source_probs(spark, tmp_path):
    folder = str(tmp_path / "probs")
    schema = "src string, p_added double, p_removed double, p_unchanged double, occurrences bigint"
    found = rounded(spark.createDataFrame([("a", 0.25, 0.25, 0.5, 4)], schema))
    tables.write_source_probs(found, folder)
    lines = [line for part in csv_lines(folder) for line in part]
    assert ["a", "0.2500", "0.2500", "0.5000", "4"] in lines
    row = tables.read_source_probs(spark, folder).first()
    assert (row.p_added, row.p_removed) == (0.25, 0.75)


def test_repeated_source(spark, tmp_path):
    folder = tmp_path / "probs"
    folder.mkdir()
    head = "src,probabilityTemplateAdded,probabilityTemplateRemoved,occurences\n"
    (folder / "part-0.csv").write_text(head + "a,0.1000,0.9000,2\nb,0.5000,0.5000,1\n")
    (folder / "part-1.csv").write_text(head + "a,0.7000,0.3000,9\n")
    (folder / "part-2.csv").write_text(head + "b,0.2000,0.8000,1\n")
    stored = {r.src: (r.p_added, r.occurrences) for r in tables.read_source_probs(spark, str(folder)).collect()}
    assert stored == {"a": (0.7, 9), "b": (0.5, 1)}


def test_names_over_several_lines(spark, tmp_path):
    folder = tmp_path / "probs"
    folder.mkdir()
    head = "src,probabilityTemplateAdded,probabilityTemplateRemoved,occurences\n"
    (folder / "part-0.csv").write_text(head + '"a\nb",0.1000,0.9000,2\n')
    assert tables.read_source_probs(spark, str(folder), line_breaks=True).first().src == "a\nb"


def test_revision_probs(spark, tmp_path):
    folder = str(tmp_path / "scores")
    scores = spark.createDataFrame([(1, 2, "0.5"), (3, 4, None)], "revision_id bigint, pair_id bigint, p string")
    p = F.col("p").cast("decimal(10,4)")
    scores = scores.select("revision_id", "pair_id", p.alias("p_added"), p.alias("p_removed"))
    for _ in range(2):
        tables.write_revision_probs(scores, folder)
    lines = [line for part in csv_lines(folder) for line in part]
    assert ["revision_id", "probabilityTemplateAdded", "probabilityTemplateRemoved"] in lines
    assert ["1", "0.5000", "0.5000"] in lines and ["3", "NaN", "NaN"] in lines


def test_labels_in_one_file(spark, tmp_path):
    folder = str(tmp_path / "labels")
    pairs = spark.createDataFrame([(1, 2, 3, ["a"], ["b"])] * 8, PAIRS).repartition(4)
    tables.write_labels(labels(pairs_to_revisions(pairs)), folder, single_file=True)
    (lines,) = csv_lines(folder)
    assert lines[0] == ["revision_id", "pair_id", "templateAdded", "templateRemoved"]
    assert len(lines) == 17


def scan(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return next(line for line in plan.splitlines() if "FileScan" in line)


def test_splits_and_columns_reach_the_scan(spark, tmp_path):
    pairs, revisions = str(tmp_path / "p"), str(tmp_path / "r")
    tables.write_pairs(spark.createDataFrame([(1, 2, 3, ["a"], ["b"])], PAIRS), pairs)
    tables.write_revisions(pairs_to_revisions(tables.read_pairs(spark, pairs)), revisions)
    train = scan(before_split(tables.read_pairs(spark, pairs), 10))
    assert "LessThan(revIdTA,10)" in train
    test = scan(from_split(tables.read_revisions(spark, revisions), 10, "revision_id"))
    assert "GreaterThanOrEqual(revId,10)" in test
    assert "ReadSchema: struct<revId:bigint,pairId:bigint,tA_GT:string,tR_GT:string>" in scan(
        labels(tables.read_revisions(spark, revisions))
    )
    changes = scan(count_source_changes(tables.read_pairs(spark, pairs)))
    assert "ReadSchema: struct<srcTA:array<string>,srcTR:array<string>>" in changes
