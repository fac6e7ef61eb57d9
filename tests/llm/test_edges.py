"""Names that clash, odd rows, and the models' results against plain Python."""

import math
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavelake.llm import common, decontamination, language_id, line_dedup, near_dedup, quality, queries, sentencepieces, toxicity

LINE = "All rights reserved by the example company"
CLASH = "doc_id long, text string, __n int, n_lines int, __row int, __lost int, __ROW_ string, rejected int, score int, kept int, quality int, toxic string, n_chars int"


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, 3, 4, 5, 6, "x", 7, 8, 9, 10, "t", 11) for i, t in enumerate(texts)], CLASH)


TEXTS = [*[f"{LINE}\nown words of the text number {i} and some more of them {i}" for i in range(12)], None, "", "same text of more than five words", "same text of more than five words", "long " * 40_000]


def test_clashing_names_stay(spark):
    docs = clashing(spark, TEXTS)
    out = line_dedup.dedup_lines(docs, n_lines="n_lines", n_dropped="gone")
    assert sorted(out.columns) == sorted([*docs.columns, "gone"])
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].asDict()["__n"] == 3 and got[0].n_lines == 2 and got[0].gone == 1 and len(got) == len(TEXTS)
    items = spark.createDataFrame([(1, "own words of the text number 3 and some more", 1)], "item_id long, text string, __row int")
    rest = decontamination.decontaminate(docs, items)
    assert rest.columns == docs.columns and rest.count() == len(TEXTS) - 1
    one = near_dedup.keep_one(docs)
    assert one.columns == docs.columns and one.where("doc_id in (14, 15)").count() == 1
    assert all(r.asDict()["__row"] == 5 for r in one.collect())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:4]])
def test_each_stage_keeps_columns_and_odd_rows(spark, tmp_path, stage):
    items = spark.createDataFrame([(1, "an item that no text holds at all")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = clashing(spark, TEXTS).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    ids = {r.doc_id for r in out.collect()}
    assert ids >= set(range(12)) | {16} or stage is corpus_pipeline.known_language
    if stage is corpus_pipeline.known_language:
        assert not ids & {12, 13} and len(ids) >= 12
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    bare = docs.select("doc_id", "text", "lang")
    assert stage(spark, bare, str(tmp_path)).columns == bare.columns


def test_last_stage_takes_bare_tables(spark):
    docs = spark.createDataFrame([(1, "some words"), (1, "some words"), (2, None), (3, "")], "doc_id long, text string")
    got = corpus_pipeline.piece_samples(spark, docs, "")
    rows = [r for r in got.collect() if r.doc_id == 1]
    assert len(rows) == 4 and len({str(r) for r in rows}) == 2
    assert corpus_pipeline.piece_samples(spark, docs.limit(0), "").count() == 0


def test_runs_are_merged_without_a_shuffle_and_reopened(spark, tmp_path):
    folder = f"file://{tmp_path}/runs"
    texts = lambda lo, hi: spark.createDataFrame([(i, f"{LINE}\nline {i % 40}\nonce {i}") for i in range(lo, hi)], "doc_id long, text string")
    runs = line_dedup.LineRuns(spark, 10, 2, folder, 3)
    for k in range(3):
        runs.add(line_dedup.line_counts(texts(100 * k, 100 * k + 100)))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    pair = [name for level in runs.levels for name in level]
    assert len(pair) == 2 and "Exchange" not in plan(runs.merged(*pair)) and "SortMergeJoin" in plan(runs.merged(*pair))
    assert all(t.count() == t.select("h1", "h2").distinct().count() for t in runs.runs())
    assert plan(runs.totals(runs.levels[0][0])).count("Exchange") == 0 and "SortMergeJoin" in plan(runs.totals(runs.levels[0][0]))
    again = line_dedup.LineRuns(spark, 10, 2, folder)
    assert (again.levels, again.known, again.buckets) == (runs.levels, runs.known, 3)
    again.add(line_dedup.line_counts(texts(300, 500)))
    want = Counter(x for i in range(500) for x in (LINE, f"line {i % 40}", f"once {i}"))
    assert again.repeated().count() == sum(n >= 10 for n in want.values()) == 41
    out = line_dedup.drop_lines(texts(0, 50), again.repeated(), bound=5)  # hot lines to every task, the rest by shuffle
    assert {r.text for r in out.collect()} == {f"once {i}" for i in range(50)}
    old = line_dedup.dedup_lines(spark.createDataFrame([(1, "line 7\nnew")], "doc_id long, text string"), folder=folder)
    assert [r.text for r in old.collect()] == ["new"]


def test_hub_sets_are_sent_in_slices(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRS_A_SLICE", 2)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(60)] + ["other words stand here alone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, percent=80).collect()
    assert {r.component_id for r in got} == brute_components(texts, 80)


def brute_components(texts, percent):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return set(label)


def test_toxicity_labels_of_every_kind(spark):
    docs = spark.createDataFrame([(i, "calm words of rivers" if i < 40 else "idiot fool scum words") for i in range(80)], "doc_id long, text string")
    models = []
    for kind, yes in (("int", 1), ("boolean", True), ("int", 2), ("double", 0.5)):
        no = type(yes)(0)
        labels = spark.createDataFrame([(i, yes if i >= 40 else no) for i in range(80)] + [(None, yes), (3, None)], f"doc_id long, toxic {kind}")
        models.append(toxicity.fit(docs, labels))
    assert all(m == models[0] for m in models) and models[0]["words"]


def test_toxicity_query_matches_plain_python(spark):
    """The model is that of the query; every text of the table is scored here word by word."""
    sf = "/root/testdata/sf0.001"
    docs, labels = queries.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    weight = dict(zip(model["words"], model["weights"]))
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        s = sum(weight[w] * math.log1p(n) for w, n in Counter(language_id.text_words(r.text)).items() if w in weight)
        above = [1 - 1 / (1 + math.exp(-max(-40, min(40, t - s)))) for t in model["thresholds"]]
        p = [1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]
        assert math.isclose(got[r.doc_id].severity, sum(above), abs_tol=1e-9)
        assert got[r.doc_id].grade == p.index(max(p)) and got[r.doc_id].toxic == (above[0] > 0.5)


def test_toxicity_training_reaches_a_better_likelihood_than_its_neighbours():
    """Penalised likelihood of the trained weights and thresholds against those moved a little, by plain sums."""
    r = np.random.default_rng(6)
    texts = [" ".join(r.choice(["calm", "river", "stone"], 6)) for _ in range(60)] + [" ".join([*["scum"] * int(r.integers(1, 7)), *r.choice(["calm", "river"], 3)]) for _ in range(60)]
    toxic = [0] * 60 + [1] * 60
    m = toxicity.train(texts, toxic, rounds=2000)
    bags = [Counter(t.split()) for t in texts]
    y = toxicity.grades_of(bags, toxic)
    assert set(y) == {0, 1, 2, 3}

    def loss(words, theta):
        total = 0.0
        for bag, g in zip(bags, y):
            s = sum(words.get(w, 0.0) * math.log1p(n) for w, n in bag.items())
            up = 1 / (1 + math.exp(s - theta[g])) if g < 3 else 1.0
            low = 1 / (1 + math.exp(s - theta[g - 1])) if g else 0.0
            total -= math.log(max(up - low, 1e-12)) * (0.5 * len(y) / (60 if g else 60))
        return total / len(y) + 2e-3 * sum(map(abs, words.values()))

    words, theta = dict(zip(m["words"], m["weights"])), m["thresholds"]
    best = loss(words, theta)
    for step in (0.3, -0.3):
        for w in words:
            assert loss({**words, w: words[w] + step}, theta) > best - 1e-3
        for k in range(3):
            assert loss(words, [t + step * (i == k) for i, t in enumerate(theta)]) > best - 1e-3


def test_language_query_matches_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.documents(spark, sf)
    model = language_id.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    table = np.array(model["table"]).reshape(-1, len(model["langs"]))
    got = {r.doc_id: r for r in queries.op10_language_id(spark, sf).collect()}
    for r in docs.select("doc_id", "text").collect():
        g = got[r.doc_id]
        if r.text is None or not language_id.LETTER.search(r.text):
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        grams = language_id.grams_of(language_id.text_words(r.text), len(table))[0]
        z = (table[grams].mean(0) if len(grams) else 0) + np.array(model["bias"])
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert math.isclose(g.score, p.max(), rel_tol=1e-6) and math.isclose(p[model["langs"].index(g.lang_pred)], p.max(), rel_tol=1e-6)


def test_quality_verdict_matches_em_in_plain_python(spark):
    docs = queries.documents(spark, "/root/testdata/sf0.001")
    out = quality.quality(docs).collect()
    n_rules = len(quality.RULES)
    votes = [[r[f"v{k}"] for k in range(n_rules)] for r in out]
    prior, good, bad = 0.85, [0.02] * n_rules, [0.3] * n_rules
    post = lambda: [one(v, prior, good, bad) for v in votes]
    for _ in range(12):
        p = post()
        of = lambda k, share: sum(s for v, s in zip(votes, share) if v[k] != 0)
        no = lambda k, share: sum(s for v, s in zip(votes, share) if v[k] == -1)
        q = [1 - x for x in p]
        prior = min(0.99, max(0.01, (sum(p) + 8.5) / (len(p) + 10)))
        good = [min(0.1, max(0.001, (no(k, p) + 0.2) / (of(k, p) + 10))) for k in range(n_rules)]
        bad = [min(0.95, max(0.1, (no(k, q) + 3.0) / (of(k, q) + 10))) for k in range(n_rules)]
    for r, p in zip(out, post()):
        assert math.isclose(r.quality, p, rel_tol=1e-6) and r.kept == (not r.base_failed and r.quality >= 0.5)
    tie = sorted({r.quality for r in out})[len({r.quality for r in out}) // 2]
    kept = quality.quality(docs, keep_at=tie).where(F.col("quality") == tie).where("NOT base_failed")
    assert kept.where("NOT kept").count() == 0  # a quality of just keep_at is kept


def one(v, prior, good, bad):
    a, b = prior, 1 - prior
    for x, g, w in zip(v, good, bad):
        if x:
            a, b = a * (g if x == -1 else 1 - g), b * (w if x == -1 else 1 - w)
    return a / (a + b)


def test_a_cluster_must_name_its_shared_folder():
    code = """
import sys
from types import SimpleNamespace as N
from wavelake.llm import common
session = lambda master: N(conf=N(get=lambda *a: None, set=lambda *a: None), sparkContext=N(master=master))
for master in ("local", "local[8]", "local[*]"):
    assert common.shared_folder(session(master)).startswith("file:")
for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
    try:
        common.shared_folder(session(master))
    except ValueError:
        continue
    sys.exit(1)
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=common.__file__.split("/wavelake/")[0]).returncode == 0
