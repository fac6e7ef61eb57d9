import math
from collections import Counter

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from wavelake.llm import sentencepieces as S


def paths(v, text):
    """All segmentations of a text with their probabilities, by recursion."""
    s = (S.SPACE + text).replace(" ", S.SPACE)
    pieces = {v.bytes_of[v.id[k]].decode(): (int(v.id[k]), float(v.log_weight[k])) for k in np.flatnonzero(v.id >= 0)}
    units = S.UNIT.findall(s)

    def of(u):
        if not u:
            return [((), 0.0)]
        out = []
        for n in range(1, len(u) + 1):
            if u[:n] in pieces:
                out += [((pieces[u[:n]][0], *r), w + pieces[u[:n]][1]) for r, w in of(u[n:])]
        if u[0] not in pieces:
            b = tuple(int(v.byte_ids[x]) for x in u[0].encode())
            out += [((*b, *r), w + len(b) * v.log_byte) for r, w in of(u[1:])]
        return out

    total = [((), 0.0)]
    for u in units:
        own = of(u)
        norm = math.log(sum(math.exp(w) for _, w in own))
        total = [(a + b, x + y - norm) for a, x in total for b, y in own]
    return {a: math.exp(x) for a, x in total}


def drawn(texts, keys, k):
    lattices = S.Lattices(S.vocabulary(S.MODEL, 1.0))
    found, left = S.draw(lattices, texts, np.array(keys, np.uint64), k)
    return [
        [(tuple(S.ids_of(lattices, p.edges[p.offsets[t] : p.offsets[t + 1]]).tolist()), p.log_prob[t], p.values[t]) for p in found if p.values[t] > -np.inf]
        for t in range(len(texts))
    ], left


def test_probabilities_and_distinctness_match_enumeration():
    v = S.vocabulary(S.MODEL, 1.0)
    texts = ["the", "a b", "hello wé", "x\n𝒳", "  q"]
    rows, left = drawn(texts, range(5), 6)
    for text, row, rest in zip(texts, rows, left):
        want = paths(v, text)
        assert len({ids for ids, _, _ in row}) == len(row) == min(6, len(want))
        assert all(math.isclose(math.exp(lp), want[ids], rel_tol=1e-6) for ids, lp, _ in row)
        values = [g for _, _, g in row]
        assert values == sorted(values, reverse=True) and (rest < values[-1])
        assert (rest == -np.inf) == (len(want) <= 6)


def test_draws_follow_the_distribution_without_replacement():
    v, n = S.vocabulary(S.MODEL, 1.0), 20_000
    want = paths(v, "them a")
    rows, _ = drawn(["them a"] * n, [7919 * i for i in range(n)], 2)
    first, second = Counter(r[0][0] for r in rows), Counter(r[1][0] for r in rows)
    for ids, p in want.items():
        if p > 0.01:
            assert abs(first[ids] / n - p) < 0.015
            p2 = sum(q * p / (1 - q) for other, q in want.items() if other != ids)
            assert abs(second[ids] / n - p2) < 0.015


def test_documents(spark):
    rows = [(1, "Hello wörld\n\tok  then", "x"), (1, "Hello wörld\n\tok  then", "x"), (2, None, "y"), (3, "", "z"), (4, "abc" * 3000 + " " + "wort " * 5000, "z"), (None, "▁odd \u0000 end ", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, samples string")
    out = S.sample(docs, k=2)
    got = out.collect()
    assert len(got) == 6 and sorted(out.columns) == ["doc_id", "samples", "text"]
    by = {r.doc_id: r.samples for r in got}
    assert by[2] == [] and [s.n_pieces for s in by[3]] == [0] and len(by[4]) == 2
    assert all(s.decoded_ok and len(s.ids) == s.n_pieces and s.log_inclusion <= 0 for r in got for s in r.samples)
    twins = [r.samples for r in got if r.doc_id == 1]
    assert twins[0] == twins[1] and twins[0][0].ids != twins[0][1].ids
    one = out.where("doc_id = 4").select("text", F.col("samples")[0]["ids"].alias("ids"))
    assert S.decode(one, "ids", "back").where("text = back").count() == 1
    sp = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    assert sp.decode(by[1][1].ids) == rows[0][1]
    assert S.sample(docs.limit(0)).count() == 0
