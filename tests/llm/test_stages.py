"""The stages of the pipeline on empty tables, nulls, repeated rows and extra columns."""

from __future__ import annotations

import random
import tempfile
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from citetrust.llm import language, mil, ngram_join, repeats
from citetrust.llm.work import utf8
from texts import frame, odd_rows


def test_stages_take_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    for kept in (mil.accepted(none, labels), language.understood(none), ngram_join.one_of_each(none), repeats.without_repeats(none)):
        assert kept.columns == none.columns and kept.count() == 0


def test_repeats_keep_every_row(spark):
    """Rows of one id don't remove each other's bytes; a null id is later than all others."""
    passage = "a passage of more than fifty bytes, which several of the rows hold in whole"
    rows = [(1, passage), (1, passage), (2, "b " + passage), (None, passage + " c"), (3, None), (None, None)]
    got = sorted(((r.doc_id or 99), r.text or "") for r in repeats.without_repeats(frame(spark, rows)).collect())
    assert got == [(1, passage), (1, passage), (2, "b "), (3, ""), (99, ""), (99, " c")]


def test_stages_return_rows_of_their_input(spark):
    docs = frame(spark, odd_rows())
    before = {tuple(r) for r in docs.collect()}
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, quality int")
    for kept in (mil.accepted(docs, labels, sample=10), language.understood(docs)):
        assert {tuple(r) for r in kept.collect()} <= before


def test_stages_are_written_in_small_batches(spark, capsys):
    """What a caller does with a stage runs no Python worker with batches of any size: the rows are stored already."""
    rows = [(k, f"{k} the text of the document and that of {'another' * (k % 3)}") for k in range(60)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, quality int")
    with tempfile.TemporaryDirectory() as folder:
        labels.write.parquet(f"{folder}/labels.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            docs.explain()
            assert "MapInArrow" not in capsys.readouterr().out and docs.columns == frame(spark, []).columns


def held(spark) -> dict[str, int]:
    """Bytes of each file below the shared folder."""
    top = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    return {str(f): f.stat().st_size for f in top.rglob("*") if f.is_file()}


def random_texts(n: int) -> list[tuple[int, str]]:
    """Texts that no compression makes small."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9)))
    return [(k, " ".join(word() for _ in range(900))) for k in range(n)]


def test_stages_leave_texts_on_disk_once(spark):
    """Stages that choose rows store keys, and suffix dedup its result: not its spans and anchors."""
    rows = random_texts(60)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, quality int")
    with tempfile.TemporaryDirectory() as folder:
        labels.write.parquet(f"{folder}/labels.parquet")
        frame(spark, rows).write.parquet(f"{folder}/0")
        size = sum(f.stat().st_size for f in Path(folder, "0").glob("*.parquet"))
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            before = held(spark)
            kept = stage(spark, spark.read.parquet(f"{folder}/{k}"), folder)
            left = {f: n for f, n in held(spark).items() if f not in before}
            assert sum(left.values()) < (1.2 * size if name == "suffix-array dedup" else 0.2 * size), name
            assert len({Path(f).parent for f in left}) == 1
            kept.write.parquet(f"{folder}/{k + 1}")
            assert kept.count() > 0


def test_pipeline_removes_what_it_stored(spark):
    """Of a whole run the pieces stay, which its result reads."""
    rows = random_texts(20)
    rows += [(None, rows[3][1]), (None, None), rows[4], (30, None), (31, "")]
    with tempfile.TemporaryDirectory() as folder:
        spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
        frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
        before = held(spark)
        result = corpus_pipeline.run(spark, folder)
        left = [f for f in held(spark) if f not in before]
        assert left and {Path(f).parent.name for f in left} == {"pieces"}
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
        key = ["doc_id", "piece", "start", "length", "ids_crc32"]
        assert sorted(map(str, result.select(key).collect())) == sorted(map(str, docs.select(key).collect()))


def test_a_choice_keeps_rows_as_often_as_they_come(spark):
    docs = frame(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "a"), (None, None), (2, None), (3, "a")])
    some = frame(spark, [(1, "a"), (None, "a"), (None, "a"), (None, None), (3, "b")])
    got = corpus_pipeline.chosen(docs, lambda: some, "some")
    assert got.columns == docs.columns
    kept = sorted(str((r.doc_id, r.text)) for r in got.collect())
    assert kept == sorted(map(str, [(1, "a"), (1, "a"), (None, "a"), (None, "a"), (None, None)]))


@pytest.mark.parametrize("operator", ["language", "quality"])
def test_workers_judge_texts_in_bounded_memory(operator):
    """4 MB of texts in one batch; slices of 1 MB took over 60 MB."""
    held = []

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, work, schema):
            held.append(work)

    text = "the of and tion ande " * 100
    n = (4 << 20) // len(text)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([text] * n)], ["doc_id", "text"])
    one = batch.slice(0, 3)
    if operator == "language":
        language.identify(Frame(), {"en": list(range(97, 120))})
    else:
        x, to = mil.passages(*utf8(one.column(1)))
        mil.score(Frame(), mil.fit(x.astype(float), to, np.array([0.0, 1, 1]), np.ones(3)))
    list(held[0](iter([one])))
    tracemalloc.start()
    assert sum(out.num_rows for out in held[0](iter([batch]))) == n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
