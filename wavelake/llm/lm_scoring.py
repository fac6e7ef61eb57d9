"""LM scoring by a hidden Markov model, beside a smoothed unigram base.

Every text is a sequence of words and one end. Unigram counts cover all training texts, and each word of the training
corpus has its own emission from each state; words that it doesn't hold share one, which is that of the unigram base.
Baum-Welch runs over the whole training corpus, pass after pass, until the likelihood gains less than a stated amount:
each task adds up expected counts by the scaled forward-backward recursion, they are summed by word in a shuffle, and
the next model is made from the sums. A few rounds on a bounded sample, which tells only the most frequent words apart,
come before, only to give the passes a starting point that isn't symmetric. Scoring is the scaled forward recursion,
which is the exact likelihood.

Texts are encoded once, in pieces of about two megabytes of texts of like length: a piece is one row. The emissions of
frequent words (at most ``top_words``) go to every task; the expected counts of all rarer words stay in a table, and
each piece is joined with those of its own words. As none of them is frequent, no key of their sums is hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, lean, sampled, small_batches, written
from .shingles import WordHashes, words

#: The end's hash: that of a string that no word can be.
END = xxhash.xxh3_64_intdigest(b" end ") - (1 << 64 if xxhash.xxh3_64_intdigest(b" end ") >= 1 << 63 else 0)
SMOOTH = 0.1
#: Counts of the unigram base that each state gets beside its own.
PRIOR = 20.0
#: Most tokens that the recursions hold at once.
TOKENS_AT_ONCE = 500_000
#: About how many characters of texts make a piece.
PIECE = 2_000_000
#: Expected counts of a word travel as shares of its count, a 16-bit number for each state, in two longs.
LANES, UNIT = 4, 65535


def tokens(texts: pa.Array, cache: WordHashes):
    """(words of each text, and each word in order as its place among the distinct ones, whose hashes come last)."""
    import numpy as np
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    n, flat = pc.list_value_length(split).to_numpy().astype(np.int64), split.flatten()
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # before and behind white space
    if empty.any():
        n -= np.bincount(np.repeat(np.arange(len(n)), n)[empty], minlength=len(n))
        flat = flat.filter(pa.array(~empty))
    coded = flat.dictionary_encode()
    return n, coded.indices.to_numpy(), cache.of(coded.dictionary.cast(pa.binary()).to_pylist()).view(np.int64)


def cut(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """batch in parts of about limit bytes of text."""
    import pyarrow.compute as pc

    first = size = 0
    for i, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        size += n
        if size >= limit:
            yield batch.slice(first, i + 1 - first)
            first, size = i + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    cache = WordHashes()
    for batch in batches:
        for part in cut(batch, 8_000_000):
            _, at, h = tokens(part.column("text"), cache)
            count = np.bincount(at, minlength=len(h))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h, END)), pa.array(np.append(count, part.num_rows).astype(np.int64))], ["h", "c"])


def count_words(docs: DataFrame) -> DataFrame:
    """(h, c): how often each token, the end included, occurs in all texts of docs."""
    return docs.select("text").mapInArrow(lean(_counts), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int):
    """(hashes, counts) of the most frequent tokens, by falling count: all whose count is above a limit, which is the
    least of a fixed scale that leaves at most ``most`` tokens. Each task sends only those above it."""
    import numpy as np

    scale = F.floor(F.log2("c") * 8)
    steps = sorted(((r.s, r.n) for r in counts.groupBy(scale.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, limit = 0, math.inf
    for s, n in steps:
        total += n
        if total > most:
            break
        limit = s
    if limit == math.inf:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = counts.where(scale >= limit).select("h", "c").toArrow()
    h, c = got.column("h").to_numpy(), got.column("c").to_numpy()
    order = np.lexsort((h, -c))
    return h[order], c[order]


class Frequent:
    """Places of words among the frequent ones; -1 for all others."""

    def __init__(self, hashes):
        import numpy as np

        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def places(self, h):
        """The places of the words with these hashes."""
        import numpy as np

        if not len(self.sorted):
            return np.full(len(h), -1)
        k = np.minimum(self.sorted.searchsorted(h), len(self.sorted) - 1)
        return np.where(self.sorted[k] == h, self.order[k], -1)


def squeezed(symbols) -> bytes:
    """32-bit numbers, bytes of one rank together, as zstd."""
    return pa.compress(symbols.astype("<i4").view("u1").reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def symbols_of(data: bytes, n: int):
    import numpy as np

    raw = pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(4, n).T).view("<i4").ravel().astype(np.int64)


def _encoder(hashes):
    """A row for each piece. A piece's symbols: the distinct frequent words that it holds and the end (whose place is
    len(hashes)) come first, in the order of ``top``, and its rare words follow, in that of ``rare_h``."""
    k_words = len(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        look, cache = Frequent(hashes), WordHashes()
        for batch in batches:
            for part in cut(batch, PIECE):
                n, at, h = tokens(part.column("text"), cache)
                place = look.places(h)
                known = place >= 0
                top = np.append(np.unique(place[known]), k_words)
                rare, own = np.unique(h[~known], return_inverse=True)
                symbol = np.searchsorted(top, place)
                symbol[~known] = len(top) + own
                sym = np.insert(symbol[at], np.cumsum(n), len(top) - 1)  # the end of each text
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [
                        one(part.column("doc_id")),
                        one(part.column("held_out")),
                        one(pa.array((n + 1).astype(np.int32))),
                        pa.array([squeezed(sym)], pa.binary()),
                        one(pa.array(top.astype(np.int32))),
                        one(pa.array(rare)),
                    ],
                    ["ids", "held_out", "n", "symbols", "top", "rare_h"],
                )

    return run


class Piece:
    """A row of the encoded table, with what its rare words found (met) where they were joined."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        import numpy as np

        value = lambda name: batch.column(name)[i].values
        self.b = batch.column("b")[i].as_py()
        self.n = value("n").to_numpy().astype(np.int64)
        self.held_out = value("held_out").to_numpy(zero_copy_only=False)
        self.top, self.rare_h = value("top").to_numpy(), value("rare_h").to_numpy()
        self.symbols = symbols_of(batch.column("symbols")[i].as_py(), int(self.n.sum()))
        self.met = batch.column("met")[i].values if "met" in batch.schema.names and batch.column("met")[i].is_valid else None

    def rare_counts(self):
        """(counts in all training texts, shares of the states) of the rare words; 0 for those not met."""
        import numpy as np

        count, share = np.zeros(len(self.rare_h)), np.zeros((len(self.rare_h), 2 * LANES))
        if self.met is not None:
            at = self.met.field("pos").to_numpy()
            count[at] = self.met.field("c").to_numpy()
            share[at] = shares(self.met.field("p0").to_numpy(), self.met.field("p1").to_numpy())
        return count, share

    def parts(self, wanted):
        """(places of texts, symbols, lengths) of the texts wanted, a bounded number of tokens at a time; a text of more
        tokens than that is a part of its own."""
        import numpy as np

        ends = np.cumsum(self.n)
        at = np.flatnonzero(wanted)
        i = 0
        while i < len(at):
            j, size = i + 1, self.n[at[i]]
            while j < len(at) and size + self.n[at[j]] <= TOKENS_AT_ONCE:
                size += self.n[at[j]]
                j += 1
            own = at[i:j]
            yield own, np.concatenate([self.symbols[ends[k] - self.n[k] : ends[k]] for k in own]), self.n[own]
            i = j


def packed(share):
    """Shares of up to eight states (words x states) as two longs each."""
    import numpy as np

    q = np.zeros((len(share), 2 * LANES), np.uint64)
    q[:, : share.shape[1]] = np.rint(np.clip(share, 0, 1) * UNIT)
    return [sum(q[:, half * LANES + k] << np.uint64(16 * k) for k in range(LANES)).view(np.int64) for half in (0, 1)]


def shares(p0, p1):
    import numpy as np

    return np.stack([(p.view(np.uint64) >> np.uint64(16 * k)) & np.uint64(UNIT) for p in (p0, p1) for k in range(LANES)], 1) / UNIT


class Packed:
    """Sequences laid out by time: all first symbols, all second ones, and so on, longest sequence first, so that a
    step of the recursions is one operation on all sequences that are still running."""

    def __init__(self, flat, length):
        import numpy as np

        rank = np.argsort(-length, kind="stable")
        place = np.empty(len(length), np.int64)
        place[rank] = np.arange(len(length))
        self.running = len(length) - np.searchsorted(np.sort(length), np.arange(length.max()), side="right")
        self.start = np.concatenate([[0], np.cumsum(self.running)])
        doc = np.repeat(np.arange(len(length)), length)
        t = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        at = self.start[t] + place[doc]
        self.symbols, self.doc = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
        self.symbols[at], self.doc[at] = flat, doc

    def forward(self, model, before=None):
        """Scaled forward probabilities, emissions and scales of all tokens, in time order. before: the probabilities
        at the token before, where a text goes on from an earlier stretch."""
        import numpy as np

        first, move, emit = model
        e = emit[self.symbols]
        alpha, scale = np.empty_like(e), np.empty(len(e))
        a = None if before is None else np.repeat(before, self.running[0], 0)
        for t, k in enumerate(self.running):
            s = slice(self.start[t], self.start[t] + k)
            a = (first if a is None else a[:k] @ move) * e[s]
            c = a.sum(1)
            a /= c[:, None]
            alpha[s], scale[s] = a, c
        return alpha, e, scale

    def log10_likelihoods(self, model):
        import numpy as np

        _, _, scale = self.forward(model)
        return np.bincount(self.doc, np.log10(scale))

    def expected(self, model, sums, before=None, after=None):
        """Adds the expected counts of starts, moves and emissions to sums. before and after join the stretches of one
        text: the forward probabilities behind this one and the backward ones ahead of it. Returns the log10
        likelihood of all sequences, and what the stretch before needs as its after."""
        import numpy as np

        _, move, _ = model
        alpha, e, scale = self.forward(model, before)
        beta = np.ones_like(alpha)
        if after is not None:
            sums[1][:] += alpha[-1:].T @ after * move
            beta[-1:] = after @ move.T
        for t in range(len(self.running) - 2, -1, -1):
            k = self.running[t + 1]
            nxt = slice(self.start[t + 1], self.start[t + 1] + k)
            own = slice(self.start[t], self.start[t] + k)
            w = e[nxt] * beta[nxt] / scale[nxt, None]
            sums[1][:] += alpha[own].T @ w * move
            beta[own] = w @ move.T
        head = slice(0, self.running[0])
        ahead = e[head] * beta[head] / scale[head, None]
        alpha *= beta
        if before is None:
            sums[0][:] += alpha[head].sum(0)
        for s in range(len(move)):
            sums[2][:, s] += np.bincount(self.symbols, alpha[:, s], len(sums[2]))
        return float(np.log10(scale).sum()), ahead


def stretches(flat):
    """A long text as Packed stretches of a bounded number of tokens."""
    import numpy as np

    return [Packed(flat[i : i + TOKENS_AT_ONCE], np.array([len(flat[i : i + TOKENS_AT_ONCE])])) for i in range(0, len(flat), TOKENS_AT_ONCE)]


def likelihoods(flat, length, model):
    """log10 likelihood of each sequence; that of a long one stretch by stretch."""
    import numpy as np

    if len(flat) <= TOKENS_AT_ONCE:
        return Packed(flat, length).log10_likelihoods(model)
    total, last = 0.0, None
    for part in stretches(flat):
        alpha, _, scale = part.forward(model, last)
        total, last = total + np.log10(scale).sum(), alpha[-1:].copy()
    return np.array([total])


def expected(flat, length, model, sums) -> float:
    """Adds the expected counts of the sequences to sums and returns their log10 likelihood. A long text keeps only the
    forward probabilities between its stretches, and each is computed again on the way back."""
    if len(flat) <= TOKENS_AT_ONCE:
        return Packed(flat, length).expected(model, sums)[0]
    parts, before = stretches(flat), [None]
    for part in parts:
        before.append(part.forward(model, before[-1])[0][-1:].copy())
    total, after = 0.0, None
    for k in range(len(parts) - 1, -1, -1):
        own, after = parts[k].expected(model, sums, before[k], after)
        total += own
    return total


class Emissions:
    """Emissions of the frequent words and the end (words x states), and how those of rare words come from their
    expected counts. In the first pass, where rare words have none yet, all of them have the given one."""

    def __init__(self, top, n_tokens: int, whole: float, total=None, other=None):
        self.top, self.n_tokens, self.whole, self.total, self.other = top, n_tokens, whole, total, other

    def of(self, count, share):
        """Those of words from their counts and shares of the states. Over all words, known or not, each state's sum
        to one."""
        expected = share * count[:, None] + PRIOR * count[:, None] / self.n_tokens
        return (self.n_tokens * expected / (self.total + PRIOR) + SMOOTH) / self.whole

    def in_piece(self, piece: Piece):
        import numpy as np

        if self.total is None:
            rare = np.repeat(self.other[None], len(piece.rare_h), 0)
        else:
            count, share = piece.rare_counts()
            rare = self.of(count, share[:, : len(self.total)])
        return np.concatenate([self.top[piece.top], rare])


def starting_model(states: int, symbols: int, seed: int = 11):
    """Starts, moves and emissions (symbols x states) drawn at random, with states that last."""
    import numpy as np

    r = np.random.default_rng(seed)
    move = r.dirichlet(np.ones(states), states) * 0.3 + 0.7 * np.eye(states)
    return np.full(states, 1 / states), move, r.dirichlet(np.ones(symbols), states).T


def next_model(sums, base):
    """The model from expected counts; base: the symbols' unigram shares, a few counts of which each state gets, so
    that no symbol is impossible anywhere."""
    first, move = sums[0] + 0.1, sums[1] + 0.1
    emit = sums[2] + PRIOR * base[:, None]
    return first / first.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)


ROWS = "kind int, h bigint, b bigint, pos int, c bigint, p0 bigint, p1 bigint, flow array<double>"
FREQUENT, FLOW, RARE = 0, 1, 2


def _expected(first, move, emissions: Emissions, k_words: int):
    """Each task's expected counts. A row of kind RARE: one rare word of one piece b, at its place; FREQUENT: a frequent
    word or the end by its number; FLOW: log10 likelihood and number of the training tokens, then starts and moves. Held-out texts add nothing to counts, but their rare words have rows, so that they meet theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        n, task = len(first), None
        small = first.astype(np.float32), move.astype(np.float32)
        total = [np.zeros(n), np.zeros((n, n)), np.zeros((k_words + 1, n))]
        tally = np.zeros(2)

        def rows(kind, h, b, pos, c, p0, p1):
            m = len(h)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, kind, np.int32)), pa.array(h), pa.array(np.full(m, b, np.int64)), pa.array(pos), pa.array(c), pa.array(p0), pa.array(p1), pa.nulls(m, pa.list_(pa.float64()))],
                ["kind", "h", "b", "pos", "c", "p0", "p1", "flow"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                piece = Piece(batch, i)
                task = piece.b if task is None else task
                model = *small, emissions.in_piece(piece).astype(np.float32)
                sums = [total[0], total[1], np.zeros(model[2].shape)]
                for own, flat, length in piece.parts(~piece.held_out):
                    tally += expected(flat, length, model, sums), len(flat)
                m = len(piece.top)
                total[2][piece.top] += sums[2][:m]
                own = sums[2][m:]
                c = np.rint(own.sum(1))
                yield rows(RARE, piece.rare_h, piece.b, np.arange(len(own), dtype=np.int32), c.astype(np.int64), *packed(own / np.maximum(c, 1)[:, None]))
        if task is None:
            return
        c = np.rint(total[2].sum(1))
        seen = np.flatnonzero(c)
        yield rows(FREQUENT, seen, task, np.zeros(len(seen), np.int32), c[seen].astype(np.int64), *packed(total[2][seen] / c[seen, None]))
        flow = np.concatenate([tally, total[0], total[1].ravel()])
        yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in ((FLOW, pa.int32()), (task, pa.int64()), (task, pa.int64()), (0, pa.int32()), (0, pa.int64()), (0, pa.int64()), (0, pa.int64()))], pa.array([flow.tolist()], pa.list_(pa.float64()))], ["kind", "h", "b", "pos", "c", "p0", "p1", "flow"])

    return run


def one_pass(pieces_: DataFrame, first, move, emissions: Emissions, k_words: int):
    """Baum-Welch once over all pieces: the next starts, moves and emissions, the log10 likelihood a token of the
    training texts under the model given, and the table of the new expected counts, which stays distributed. What
    comes back to the driver has a fixed size, states times frequent words.

    Each row of the table has the sums over all rows of its word: c and the states' shares."""
    import numpy as np

    from pyspark.sql import Window

    n = len(first)
    word = Window.partitionBy("h", "kind")  # h first: sorted by its bits alone
    lane = lambda p, k: F.shiftrightunsigned(p, 16 * k).bitwiseAND(F.lit(UNIT))
    got = pieces_.mapInArrow(lean(_expected(first, move, emissions, k_words)), ROWS)
    sums = [F.sum(F.col("c") * lane(f"p{s // LANES}", s % LANES)).over(word) for s in range(n)]
    all_ = got.select("kind", "h", "b", "pos", "flow", F.sum("c").over(word).alias("c"), F.min("b").over(word).alias("b0"), *[x.alias(f"s{k}") for k, x in enumerate(sums)])
    share = lambda s: F.round(F.col(f"s{s}") / F.greatest("c", F.lit(1))).cast("bigint") if s < n else F.lit(0).cast("bigint")
    pack = lambda half: sum((F.shiftleft(share(half * LANES + k), 16 * k) for k in range(1, LANES)), share(half * LANES))
    once = F.col("b") == F.col("b0")  # one of a word's rows: each piece and task has one
    table = all_.where((F.col("kind") != FREQUENT) | once).select("kind", F.when(F.col("kind") == FREQUENT, F.col("h")).alias("h"), "b", "pos", "c", pack(0).alias("p0"), pack(1).alias("p1"), "flow", once.alias("once"))
    table = written(table, "kind")

    part = lambda kind: table.where(F.col("kind") == kind)
    flow = np.array([r.v for r in part(FLOW).select(F.posexplode("flow").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()])
    top = part(FREQUENT).select("h", "c", "p0", "p1").toArrow()
    count, share_ = np.zeros(k_words + 1), np.zeros((k_words + 1, n))
    at = top.column("h").to_numpy()
    count[at], share_[at] = top.column("c").to_numpy(), shares(*(top.column(p).to_numpy() for p in ("p0", "p1")))[:, :n]
    rare = part(RARE).where("once").agg(*[F.coalesce(F.sum(F.col("c") * lane(f"p{s // LANES}", s % LANES)), F.lit(0)).cast("double") for s in range(n)]).first()
    new = Emissions(None, emissions.n_tokens, emissions.whole, count @ share_ + np.array(rare) / UNIT)
    new.top = new.of(count, share_)
    starts, moves = flow[2 : 2 + n] + 0.1, flow[2 + n :].reshape(n, n) + 0.1
    return (starts / starts.sum(), moves / moves.sum(1, keepdims=True), new), flow[0] / max(flow[1], 1), table


def with_rare(encoded: DataFrame, table: DataFrame) -> DataFrame:
    """encoded with met: what the rare words of each piece find in the table. A piece is bounded, and so is its list."""
    met = table.where(F.col("kind") == RARE).where("c > 0").groupBy("b").agg(F.collect_list(F.struct("pos", "c", "p0", "p1")).alias("met"))
    return encoded.join(met, "b", "left")


def first_model(docs: DataFrame, hashes, states: int, base, rows: int, rounds: int):
    """A starting point from at most ``rows`` different training texts, those with the smallest hash, in one task.
    It tells len(base) - 2 words apart, and all others are one symbol."""
    import numpy as np

    n = len(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, cache, parts = Frequent(hashes[: n - 2]), WordHashes(), []
        for batch in batches:
            for t in batch.column("text").to_pylist():
                at = look.places(cache.of(words(t)).view(np.int64))
                parts.append(np.append(np.where(at < 0, n - 2, at), n - 1))
        model = starting_model(states, n)
        model = model[0], model[1], model[2] * base[:, None] / (model[2] * base[:, None]).sum(0)
        groups, i = [], 0
        while i < len(parts):
            j, size = i + 1, len(parts[i])
            while j < len(parts) and size + len(parts[j]) <= TOKENS_AT_ONCE:
                size, j = size + len(parts[j]), j + 1
            groups.append((np.concatenate(parts[i:j]), np.array([len(p) for p in parts[i:j]])))
            i = j
        for _ in range(rounds if groups else 0):
            sums = [np.zeros_like(m) for m in model]
            for flat, length in groups:
                expected(flat, length, model, sums)
            model = next_model(sums, base)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([m.ravel() for m in model]).tolist()], pa.list_(pa.float64()))], ["m"])

    sample = sampled(docs.select("text"), F.xxhash64("text"), rows).repartition(1).sortWithinPartitions("__h").select("text")
    flat = np.array(sample.mapInArrow(lean(run), "m array<double>").collect()[0].m)
    return flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 :].reshape(n, states)


def score(docs: DataFrame, held_out: Column, states: int = 8, vocabulary: int = 20_000, top_words: int = 200_000, tolerance: float = 0.01, most_passes: int = 10, sample_rows: int = 1500, sample_rounds: int = 15, report: list | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows where held_out is not true train the counts and the model. A null text is empty: its one token is the end.
    Rows that repeat count each; other columns of docs play no part. Passes of Baum-Welch over all training rows go on
    until one raises the log10 likelihood a token by less than ``tolerance``, or for ``most_passes``. sample_rows bounds
    only what the starting point sees, vocabulary only how many words it tells apart, and top_words how many words go
    to every task: each training word has emissions of its own. Without training rows both scores are those of the
    unigram base. report gets, for each pass after the first, the log10 likelihood a token of training and of held-out
    texts under its model. The first pass has nothing to compare with: there rare words share one emission."""
    import numpy as np

    if not 1 <= states <= 2 * LANES:
        raise ValueError(f"states must be 1 to {2 * LANES}")
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    train = docs.where("NOT held_out")
    counts = written(count_words(train))
    n_tokens, n_types = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
    whole = n_tokens + SMOOTH * (n_types + 1)
    hashes, count = frequent(counts, top_words)
    hashes, count = hashes[hashes != END], count[hashes != END]
    c_end = int(counts.where(F.col("h") == END).agg(F.sum("c")).first()[0] or 0)  # few long texts: not a frequent one
    forget(counts)
    k_words = len(hashes)
    kinds = f"ids array<{id_type}>, held_out array<boolean>, n array<int>, symbols binary, top array<int>, rare_h array<bigint>"
    alike = docs.sortWithinPartitions(F.octet_length("text"))  # texts of like length run together
    encoded = written(alike.mapInArrow(lean(_encoder(hashes)), kinds).withColumn("b", F.monotonically_increasing_id()))  # written, so b stays
    known = np.append(count, c_end)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scored(pieces_: DataFrame, model) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    piece = Piece(batch, i)
                    c = np.concatenate([known[piece.top], piece.rare_counts()[0]])
                    doc = np.repeat(np.arange(len(piece.n)), piece.n)
                    base_score = np.bincount(doc, np.log10((c + SMOOTH) / whole)[piece.symbols])
                    hmm = base_score.copy()
                    if model is not None:
                        own_model = *model[:2], model[2].in_piece(piece)
                        for own, flat, length in piece.parts(np.ones(len(piece.n), bool)):
                            hmm[own] = likelihoods(flat, length, own_model)
                    n_known = np.bincount(doc, c[piece.symbols] > 0).astype(np.int64)
                    columns = [pa.array(piece.n), pa.array(n_known), pa.array(np.full(len(piece.n), n_tokens)), pa.array(base_score), pa.array(hmm)]
                    yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("held_out")[i].values, *columns], names)

        return pieces_.mapInArrow(lean(run), f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")

    if not n_tokens:
        return scored(encoded, None)
    symbols = min(vocabulary, k_words)
    share = (np.append(count[:symbols], 0) + SMOOTH) / whole
    end_share = (c_end + SMOOTH) / whole
    rest = max(1 - share[:symbols].sum() - end_share, SMOOTH / whole)
    base = np.append(np.append(share[:symbols], rest), end_share)
    first, move, emit = first_model(train, hashes, states, base / base.sum(), sample_rows, sample_rounds)
    top = emit[np.append(np.minimum(np.arange(k_words), symbols), symbols + 1)]
    model = first, move, Emissions(top, n_tokens, whole, other=emit[symbols])
    pieces_, table, out = encoded, None, None
    for k in range(max(1, most_passes)):
        model, before, new = one_pass(pieces_, *model, k_words)
        if table is not None:
            forget(table)
        table, pieces_ = new, with_rare(encoded, new)
        if k:  # before: under the model that this pass has improved
            if out is not None:
                forget(out)
            out = written(scored(pieces_, model))
            after = out.groupBy("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("a_token")).collect()
            after = {r.held_out: r.a_token for r in after}
            if report is not None:
                report.append((after.get(False), after.get(True)))
            if after[False] - before < tolerance:
                break
    return out if out is not None else scored(pieces_, model)
