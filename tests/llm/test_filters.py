"""Line dedup, decontamination, quality rules, toxicity and the pipeline against plain Python on small tables."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavelake.llm import decontamination, line_dedup, quality, toxicity

LINE = "All rights reserved by the example company"
ODD = [(1, None), (2, ""), (3, " \n\t\n"), (4, "word " * 30_000), (4, "word " * 30_000), (None, "lone text")]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_line_dedup_matches_python(spark):
    rows = [(i, f"own line {i}\n  {LINE.upper() if i % 2 else LINE}\t\n\nshared by nine" if i < 9 else f"own line {i}\n{LINE}") for i in range(12)] + [(20, None), (21, "")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows), n_lines="n_lines", n_dropped="n_dropped").collect()}
    for i, text in rows:
        kept = [x for x in (text or "").split("\n") if x.strip().lower() != LINE.lower()]
        assert (got[i].text or "") == "\n".join(kept)
        assert (got[i].n_lines, got[i].n_dropped) == (len((text or "").split("\n")), len((text or "").split("\n")) - len(kept))
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("bound", [10**6, 0])
def test_decontamination_matches_python(spark, bound):
    item = " ".join(f"w{i}" for i in range(40))
    items = frame(spark, [(7, item), (8, "three short words"), (9, None), (10, ""), (7, item)], "item_id long, text string")
    part = " ".join(item.split()[:30])
    docs = frame(spark, [(1, "x " * 5000 + item + " y" * 5000), (2, part), (3, "has three SHORT words in it"), *[(d + 100 if d else None, t) for d, t in ODD]])
    got = {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in decontamination.contaminated(docs, items, bound=bound).collect()}
    assert got == {(1, 7, 36, 36), (3, 8, 1, 1)}
    assert decontamination.decontaminate(docs, items).count() == docs.count() - 2


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, again = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            again |= {i + k for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_quality_base_matches_python(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [*table, *[(d and d + 10**6, t) for d, t in ODD]]
    got = quality.quality(frame(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted(map(str, ((r.doc_id, *r[1:7]) for r in got))) == sorted(str((d, *base(t))) for d, t in rows)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality(frame(spark, [])).count() == 0


def test_toxicity_learns_ordered_grades(spark):
    plain = [(i, f"a calm text number {i % 7} about gardens and rivers") for i in range(60)]
    harsh = [(100 + i, "you " + "idiot fool scum " * (1 + i % 3) + f"number {i % 7}") for i in range(60)]
    labels = frame(spark, [(i, int(i >= 100)) for i, _ in plain + harsh], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, plain + harsh), labels)
    assert model["thresholds"] == sorted(model["thresholds"])
    new = frame(spark, [(1, "calm rivers and gardens"), (2, "what an idiot scum fool"), (3, None), (4, "")])
    got = {r.doc_id: r for r in toxicity.score(new, model).collect()}
    assert [got[i].toxic for i in (1, 2, 3, 4)] == [False, True, got[4].toxic, got[4].toxic]
    assert got[1].severity < got[2].severity <= 3
    assert toxicity.fit(frame(spark, plain), frame(spark, [], "doc_id long, toxic int")) is None
    assert toxicity.score(new, None).where("toxic").count() == 0


def test_pipeline_keeps_columns_and_drops_what_it_must(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.where("NOT decoded_ok").count() == 0
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert 0 < len(ids) <= docs.count()
    clean = line_dedup.dedup_lines(docs.where(F.col("doc_id").isin(*ids)))
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert decontamination.contaminated(clean, items).count() == 0
