import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wavelake.llm import lm_scoring, queries


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_query_base_and_model(spark):
    got = {r.doc_id: r for r in queries.op9_lm_scoring(spark, "/root/testdata/sf0.001").collect()}
    docs = queries.documents(spark, "/root/testdata/sf0.001").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in docs}
    c = Counter(t for r in docs if not held[r.doc_id] for t in tokens(r.text))
    n, v = sum(c.values()), len(c)
    assert got.keys() == held.keys()
    for r in docs:
        ts = tokens(r.text)
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r.doc_id], len(ts), sum(t in c for t in ts), n)
        assert math.isclose(g.base_score, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), rel_tol=1e-9)
    out = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in out) > sum(g.base_score for g in out)  # the model knows more than single words


def test_recursions_match_sums_over_all_paths():
    r = np.random.default_rng(0)
    model = lm_scoring.starting_model(3, 5)
    seqs = [r.integers(0, 5, k) for k in (4, 1, 3, 4)]
    pack = lm_scoring.Packed(np.concatenate(seqs), np.array([len(s) for s in seqs]))
    sums = [np.zeros_like(m) for m in model]
    pack.expected(model, sums)
    want = [np.zeros_like(m) for m in model]
    logs = []
    for s in seqs:
        total, own = 0.0, [np.zeros_like(m) for m in model]
        for path in np.ndindex(*[3] * len(s)):
            p = model[0][path[0]]
            for t, q in enumerate(path):
                p *= (model[1][path[t - 1], q] if t else 1) * model[2][s[t], q]
            total += p
            own[0][path[0]] += p
            for t, q in enumerate(path):
                own[2][s[t], q] += p
                if t:
                    own[1][path[t - 1], q] += p
        for a, b in zip(want, own):
            a += b / total
        logs.append(math.log10(total))
    assert np.allclose(pack.log10_likelihoods(model), logs)
    assert all(np.allclose(a, b) for a, b in zip(sums, want))


def test_probabilities_of_all_texts_sum_to_one_at_most():
    first, move, emit = lm_scoring.starting_model(4, 6)
    a, ended = first, 0.0
    for _ in range(2000):  # symbol 5 is the end
        ended += (a * emit[5]).sum()
        a = (a * (1 - emit[5])) @ move
    assert abs(ended - 1) < 1e-6


def test_odd_rows(spark):
    rows = [(1, None, 1.0), (1, None, 1.0), (2, "", 2.0), (3, "A a\tb", 3.0), (None, "b " * 30000, 4.0), (5, "new", 5.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = lm_scoring.score(docs, F.col("doc_id") == 5).collect()
    assert len(got) == 6 and all(math.isfinite(r.score) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[5].n_known == 1 and by[1].n_tokens == 1 and by[None].n_tokens == 30001 and by[None].held_out is False
    none = lm_scoring.score(docs, F.lit(True)).collect()
    assert all(r.score == r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in none)
    assert lm_scoring.score(docs.limit(0), F.lit(False)).count() == 0


def test_rare_words_take_the_shuffled_join(spark):
    docs = queries.documents(spark, "/root/testdata/sf0.001")
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in df.collect())
    assert key(lm_scoring.score(docs, held, vocabulary=50, top_words=100, most_passes=1)) == key(lm_scoring.score(docs, held, most_passes=1))


def test_words_beyond_the_vocabulary_tell_states(spark):
    """Two kinds of text with words of their own, most of them beyond the vocabulary: the model tells them apart, and
    it is one model whether words go to every task or take the join."""
    r = np.random.default_rng(3)
    word = lambda kind, k: f"{'ab'[kind]}{k}"
    rows = [(i, " ".join(word(i % 2, k) for k in r.permutation([*r.integers(0, 5, 40), *r.integers(10, 40, 20)]))) for i in range(300)]
    rows += [(1000, " ".join(word(0, k) for k in range(10, 40))), (1001, " ".join(word(k % 2, k) for k in range(10, 40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    many, few = ({r.doc_id: r for r in lm_scoring.score(docs, F.col("doc_id") >= 1000, vocabulary=10, top_words=w).collect()} for w in (1000, 12))
    for g in (many, few):
        gain = {d: g[d].score - g[d].base_score for d in (1000, 1001)}
        assert gain[1000] > gain[1001] + 1
    assert all(math.isclose(many[d].score, few[d].score, rel_tol=1e-3) for d in many)


def test_the_end_is_counted_where_it_is_rare(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(50)) + " ") for i in range(3)]
    docs = spark.createDataFrame([(i, t * 4) for i, t in rows], "doc_id long, text string")
    n, v = 3 * 201, 51
    want = 200 * math.log10(12.1 / (n + 0.1 * (v + 1))) + math.log10(3.1 / (n + 0.1 * (v + 1)))
    for r in lm_scoring.score(docs, F.lit(False), top_words=10, most_passes=1).collect():
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.n_known == r.n_tokens == 201


def test_a_long_text_goes_stretch_by_stretch(monkeypatch):
    r = np.random.default_rng(1)
    model = lm_scoring.starting_model(4, 9)
    flat, length = r.integers(0, 9, 157), np.array([157])
    whole, cut = ([np.zeros_like(m) for m in model] for _ in range(2))
    a = lm_scoring.expected(flat, length, model, whole)
    monkeypatch.setattr(lm_scoring, "TOKENS_AT_ONCE", 20)
    b = lm_scoring.expected(flat, length, model, cut)
    assert math.isclose(a, b) and all(np.allclose(x, y) for x, y in zip(whole, cut))
    assert np.allclose(lm_scoring.likelihoods(flat, length, model), a)


def test_emissions_of_each_state_sum_to_one():
    r = np.random.default_rng(5)
    count = r.integers(1, 50, 30)
    share = r.dirichlet(np.ones(3), 30)
    n, v = int(count.sum()), 30
    e = lm_scoring.Emissions(None, n, n + 0.1 * (v + 1), count @ share)
    assert np.allclose(e.of(count, share).sum(0) + 0.1 / (n + 0.1 * (v + 1)), 1)
    p = lm_scoring.packed(share)
    assert np.allclose(lm_scoring.shares(*p)[:, :3], share, atol=1e-5)


def test_scores_against_baum_welch_in_plain_python(spark):
    """The whole training by hand over a small table: the same starting point, then two passes over all training texts
    with each word's own emissions, and the forward recursion of each text."""
    r = np.random.default_rng(2)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{k}" for k in r.integers(0, 12, int(r.integers(0, 15))))) for i in range(60)]
    rows += [(100, "a1 b1 zz a2"), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.score for x in lm_scoring.score(docs, F.col("doc_id") >= 100, states=2, vocabulary=8, top_words=14, most_passes=2, tolerance=-1.0).collect()}
    train = [tokens(t) for i, t in rows if i < 100]
    c = Counter(t for ts in train for t in ts)
    n, v = sum(c.values()), len(c)
    whole = n + 0.1 * (v + 1)
    counts = lm_scoring.count_words(docs.where("doc_id < 100"))
    hashes, _ = lm_scoring.frequent(counts, 14)
    hashes = hashes[hashes != lm_scoring.END]
    place = {t: int(lm_scoring.Frequent(hashes).places(lm_scoring.WordHashes().of([t]).view(np.int64))[0]) for t in c if t is not None}
    symbols = min(8, len(hashes))
    by_place = {k: c[t] for t, k in place.items() if k >= 0}
    share = np.array([(by_place[k] + 0.1) / whole for k in range(symbols)])
    end_share = (c[None] + 0.1) / whole
    base = np.concatenate([share, [1 - share.sum() - end_share], [end_share]])
    first, move, emit = lm_scoring.first_model(docs.where("doc_id < 100"), hashes, 2, base / base.sum(), 1500, 15)

    def start_emission(t):
        return emit[symbols + 1] if t is None else emit[place[t] if 0 <= place[t] < symbols else symbols]

    e = {t: start_emission(t) for t in c}

    def forward(ts):
        out, a = [], None
        for t in ts:
            a = (first if a is None else a @ move) * e.get(t, np.full(2, 0.1 / whole))
            out.append((a / a.sum(), a.sum()))
            a = a / a.sum()
        return out

    for _ in range(2):
        starts, moves, counts_ = np.full(2, 0.1), np.full((2, 2), 0.1), {t: np.zeros(2) for t in c}
        for ts in train:
            f, beta = forward(ts), np.ones(2)
            for k in range(len(ts) - 1, -1, -1):
                counts_[ts[k]] += f[k][0] * beta
                if k:
                    w = e[ts[k]] * beta / f[k][1]
                    moves += np.outer(f[k - 1][0], w) * move
                    beta = move @ w
                else:
                    starts += f[0][0] * beta
        total = sum(counts_.values())
        e = {t: (n * (counts_[t] + 20 * c[t] / n) / (total + 20) + 0.1) / whole for t in c}
        first, move = starts / starts.sum(), moves / moves.sum(1, keepdims=True)
    for i, t in rows:
        assert math.isclose(got[i], sum(math.log10(s) for _, s in forward(tokens(t))), rel_tol=1e-3), (i, got[i])


def test_tokens_are_those_of_the_contract():
    texts = ["", " ", "\tA  b\x0bÄ\x0cA\r\n", "a\u00a0b c", "x", "  y  Y\x1fz "]
    n, at, h = lm_scoring.tokens(pa.array(texts), lm_scoring.WordHashes())
    want = [lm_scoring.words(t) for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert h[at].tolist() == lm_scoring.WordHashes().of([x for w in want for x in w]).view(np.int64).tolist()
    parts = [p.num_rows for p in lm_scoring.cut(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), 5)]
    assert sum(parts) == len(texts) and len(parts) > 1
