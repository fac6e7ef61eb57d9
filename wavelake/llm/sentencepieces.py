"""SentencePiece encoding by sampling without replacement, and decoding.

A text's segmentations into pieces of a vocabulary form a lattice; its weights are those of the pieces, by their
rank in the model. Backward sums over the lattice turn weights into the exact probability of each next piece, so
a segmentation's probability is the product along its path. Every segmentation gets a Gumbel-perturbed log
probability, and the ``k`` with the largest are the sample: distinct segmentations, as if drawn one after another
without replacement.

They are found by best-first search from the top. The root's perturbed value is the largest of all. A path that
is drawn leaves at each of its nodes the rest: all segmentations that share its beginning and then turn off. The
largest perturbed value in a rest is a Gumbel variable truncated at the path's own value, so it is known before
anything in the rest is looked at; the next segmentation lies in the rest with the largest value. Log inclusion
scores compare each log probability with the largest value that was left out.

No piece crosses the beginning of a word, so lattices are built once for each distinct word and steps are taken
for all words of many texts at a time.
"""

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .shingles import PLACES, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Most lattice nodes that a worker keeps (about 50 bytes each with their edges).
MOST_NODES = 500_000
#: Fixed multiplier of the rolling hash, and the size of the table of beginnings.
STEP, TABLE_BITS = 0x9E3779B97F4A7C15, 20


class Vocabulary:
    """Pieces of a model with byte fallback, with log weights by rank, and a hash table of all their beginnings."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of, self.byte_ids, normal = [b""] * n, np.zeros(256, np.int32), []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
                self.byte_ids[self.bytes_of[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = piece.encode()
                normal.append((piece, i))
        self.log_byte = -alpha * math.log(2 * len(normal) + 10)
        known: dict[str, tuple[int, float]] = {}  # id -1: only a beginning of pieces
        for rank, (piece, i) in enumerate(normal):
            for j in range(1, len(piece)):
                known.setdefault(piece[:j], (-1, 0.0))
            known[piece] = (i, -alpha * math.log(rank + 10))
        self.longest = max(map(len, known))
        self.id = np.array([i for i, _ in known.values()], np.int32)
        self.log_weight = np.array([w for _, w in known.values()])
        hashes = [0] * len(known)
        for k, piece in enumerate(known):
            h = 0
            for c in piece:
                h = (h * STEP + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[k] = h
        self.hash = np.array(hashes, np.uint64)
        self.table = np.full(1 << TABLE_BITS, -1, np.int32)
        left, probe = np.arange(len(known)), 0
        while len(left):
            slot = self._slot(self.hash[left], probe)
            slot, one = np.unique(slot, return_index=True)
            free = self.table[slot] < 0
            self.table[slot[free]] = left[one[free]]
            left = np.delete(left, one[free])
            probe += 1

    @staticmethod
    def _slot(h, probe: int):
        return ((mix(h) >> np.uint64(64 - TABLE_BITS)).astype(np.int64) + probe) & ((1 << TABLE_BITS) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the known beginnings, -1 for none."""
        out = self.table[self._slot(h, 0)]
        open_ = np.flatnonzero((out >= 0) & (self.hash[out] != h))
        probe = 1
        while len(open_):
            k = self.table[self._slot(h[open_], probe)]
            out[open_] = k
            open_ = open_[(k >= 0) & (self.hash[k] != h[open_])]
            probe += 1
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")[1:]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    """One for each worker process."""
    return Vocabulary(path, alpha)


class Lattices:
    """The lattices of words seen so far. A node is a place in a word; its edges are pieces, with the probability
    of each given the node, added up. They grow in blocks and are emptied when they get large."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.root: dict[str, int] = {}
        self.first = np.zeros(1, np.int64)  # of each node: its first edge; one more at the end
        self.after, self.piece = np.zeros(0, np.int32), np.zeros(0, np.int32)  # of each edge: next node (-1: word's end), id
        self.below, self.chance = np.zeros(0, np.float32), np.zeros(0)
        self.spelled: dict[int, list[int]] = {}  # edges of several bytes

    def roots(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.root]
        if new:
            self.add(new)
        return np.fromiter(map(self.root.__getitem__, words), np.int64, len(words))

    def add(self, words: list[str]) -> None:
        """The lattices of new words, all at once: pieces at all places by rolling hashes, a letter longer each
        time, then backward sums from the words' ends."""
        v, node0, edge0 = self.v, len(self.first) - 1, len(self.after)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(length) - length
        to_end = np.repeat(start + length, length) - np.arange(len(code))
        self.root.update(zip(words, (node0 + start).tolist()))
        # the first step starts from every place; a place stays as long as what follows it begins some piece
        at, h, found = np.arange(len(code)), np.zeros(len(code), np.uint64), []
        for n in range(1, v.longest + 1):
            h = h * np.uint64(STEP) + code[at + n - 1] + np.uint64(1)
            k = v.find(h)
            whole = np.flatnonzero((k >= 0) & (v.id[k] >= 0))
            found.append((at[whole], n, v.id[k[whole]], v.log_weight[k[whole]]))
            if n == 1:
                alone = np.setdiff1d(at, at[whole], assume_unique=True)  # no piece of this one character: its bytes
            stay = (k >= 0) & (to_end[at] > n)
            at, h = at[stay], h[stay]
            if not len(at):
                break
        size = np.where(code[alone] < 0x80, 1, np.where(code[alone] < 0x800, 2, np.where(code[alone] < 0x10000, 3, 4)))
        found.append((alone, 1, np.full(len(alone), -1, np.int32), v.log_byte * size))
        count = sum(np.bincount(a, minlength=len(code)) for a, *_ in found)
        first = np.concatenate([[0], np.cumsum(count)])
        rank = first[:-1].copy()
        after, piece, log_w = np.empty(first[-1], np.int64), np.empty(first[-1], np.int32), np.empty(first[-1])
        for a, n, ids, w in found:
            e = rank[a]
            after[e], piece[e], log_w[e] = np.where(to_end[a] == n, -1, a + n), ids, w
            rank[a] += 1
        for p, n in zip(alone.tolist(), size.tolist()):
            ids = [int(v.byte_ids[x]) for x in chr(int(code[p])).encode("utf-8", "surrogatepass")]
            e = rank[p] - 1
            piece[e] = ids[0] if n == 1 else -1
            if n > 1:
                self.spelled[edge0 + int(e)] = ids
        # backward sums in logs: places one character before the end of their words, then two, and so on
        beta = np.zeros(len(code) + 1)  # the last: any word's end
        by_end = np.argsort(to_end, kind="stable")
        edges = np.repeat(first[by_end] - (np.cumsum(count[by_end]) - count[by_end]), count[by_end]) + np.arange(first[-1])
        n_nodes, node_at, edge_at = np.bincount(to_end), 0, 0
        for m in n_nodes[1:].tolist():
            nodes = by_end[node_at : node_at + m]
            c = count[nodes]
            own = edges[edge_at : edge_at + int(c.sum())]
            begin = np.cumsum(c) - c
            x = log_w[own] + beta[after[own]]
            top = np.maximum.reduceat(x, begin)
            beta[nodes] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, c)), begin))
            node_at, edge_at = node_at + m, edge_at + len(own)
        owner = np.repeat(np.arange(len(code)), count)
        chance = np.exp(log_w + beta[after] - beta[owner])
        upto = np.cumsum(chance)
        below = (upto - (upto[first[:-1]] - chance[first[:-1]])[owner]).astype(np.float32)
        below[first[1:] - 1] = 1.0
        chance[first[:-1][count == 1]] = 1.0
        self.first = np.concatenate([self.first, edge0 + first[1:]])
        self.after = np.concatenate([self.after, np.where(after < 0, -1, after + node0).astype(np.int32)])
        self.piece = np.concatenate([self.piece, piece])
        self.below, self.chance = np.concatenate([self.below, below]), np.concatenate([self.chance, chance])

    def edges_of(self, node: int) -> range:
        return range(self.first[node], self.first[node + 1])

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws each path on from its node to its word's end: (edges, path) in order of path, then place. A node
        of -1 is at its end already."""
        steps, alive = [], np.flatnonzero(nodes >= 0)
        node = nodes[alive]
        length = np.zeros(len(nodes), np.int64)
        while len(alive):
            u = uniform(seeds[alive], len(steps))
            e = self.first[node]
            open_ = np.flatnonzero(self.below[e] < u)
            while len(open_):
                e[open_] += 1
                open_ = open_[self.below[e[open_]] < u[open_]]
            steps.append((alive, e))
            length[alive] += 1
            node = self.after[e]
            go = node >= 0
            alive, node = alive[go], node[go]
        start = np.concatenate([[0], np.cumsum(length)])
        out = np.empty(start[-1], np.int64)
        for k, (who, e) in enumerate(steps):
            out[start[who] + k] = e
        return out, np.repeat(np.arange(len(nodes)), length)


def uniform(seeds: np.ndarray, k: int) -> np.ndarray:
    """Numbers in (0, 1), one for each seed and k."""
    return (mix(seeds + PLACES[k % 64] + np.uint64(k)) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def truncated(log_mass, most, u):
    """Gumbel variables of location log_mass, truncated at most."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(log_mass), -np.inf, -np.logaddexp(-most, np.log(-np.log(u)) - log_mass))


class Path:
    """One drawn segmentation of each of many texts: edges and their words, text by text."""

    def __init__(self, lattices: Lattices, edges, word, offsets, values, turn, seeds):
        self.edges, self.word, self.offsets, self.values = edges, word, offsets, values
        text = np.repeat(np.arange(len(values)), np.diff(offsets))
        chance = lattices.chance[edges]
        upto = np.concatenate([[0.0], np.cumsum(np.log(chance))])
        self.log_prob = upto[offsets[1:]] - upto[offsets[:-1]]
        self.before = upto[:-1] - upto[offsets[:-1]][text]  # log mass of what shares the path up to here
        with np.errstate(divide="ignore"):
            rest = self.before + np.log1p(-chance)
        u = uniform(seeds[text] + np.arange(len(edges), dtype=np.uint64) - offsets[:-1][text].astype(np.uint64), 61)
        self.rest = truncated(rest, values[text], u)
        self.rest[np.arange(len(edges)) - offsets[:-1][text] <= turn[text]] = -np.inf  # kept by the path it came from

    def best(self):
        """Value and place of the largest rest of each text; -inf where none is left."""
        n = len(self.values)
        value, place = np.full(n, -np.inf), np.zeros(n, np.int64)
        full = np.flatnonzero(np.diff(self.offsets) > 0)
        if len(full):
            value[full] = np.maximum.reduceat(self.rest, self.offsets[full])
            hit = np.flatnonzero(self.rest == np.repeat(value, np.diff(self.offsets)))
            text = np.searchsorted(self.offsets, hit, side="right") - 1
            place[text[::-1]] = hit[::-1]
        return value, place


def draw(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int) -> tuple[list[Path], np.ndarray]:
    """The k segmentations of each text as Paths, and each text's largest perturbed value that was left out."""
    units = [UNIT.findall((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
    roots = lattices.roots([u for us in units for u in us])
    ends = np.cumsum([0, *map(len, units)])
    text_of = np.repeat(np.arange(len(texts)), np.diff(ends))
    place = np.arange(len(roots), dtype=np.uint64) - ends[:-1][text_of].astype(np.uint64)
    seeds = mix(keys)
    word_seed = mix(seeds[text_of] + place * PLACES[1])
    value = -np.log(-np.log(uniform(seeds, 60)))
    edges, word = lattices.walk(roots, word_seed)
    offsets = np.searchsorted(text_of[word], np.arange(len(texts) + 1)) if len(word) else np.zeros(len(texts) + 1, np.int64)
    paths = [Path(lattices, edges, word, offsets, value, np.full(len(texts), -1), seeds)]
    used: dict[tuple[int, int], list[int]] = {}
    for r in range(1, k + 1):
        found = [p.best() for p in paths]
        values = np.stack([f[0] for f in found])
        source = values.argmax(0)
        value = values[source, np.arange(len(texts))]
        if r == k:
            return paths, value
        seeds_r = mix(seeds + PLACES[63 - r % 50])
        choice = uniform(seeds_r, 59)
        turn, starts, heads, from_word = np.full(len(texts), -1), np.full(len(texts), -1), [], ends[1:].copy()
        for t in np.flatnonzero(value > -np.inf).tolist():
            path, at = paths[source[t]], int(found[source[t]][1][t])
            gone = used.setdefault((int(source[t]), at), [int(path.edges[at])])
            node = int(np.searchsorted(lattices.first, gone[0], side="right")) - 1
            left = [e for e in lattices.edges_of(node) if e not in gone]
            total = sum(lattices.chance[e] for e in left)
            x = choice[t] * total
            for e in left:
                x -= lattices.chance[e]
                if x < 0:
                    break
            gone.append(e)
            mass = sum(lattices.chance[o] for o in left if o != e)
            u = uniform(seeds_r[t : t + 1], 58)
            path.rest[at] = truncated(path.before[at] + math.log(mass), value[t], u)[0] if mass > 0 else -np.inf
            turn[t] = at - path.offsets[t]
            starts[t] = lattices.after[e]
            heads.append((t, path, at, e))
            from_word[t] = path.word[at] + 1
        later = np.arange(len(roots)) >= from_word[text_of] if len(roots) else np.zeros(0, bool)
        live = np.array([t for t, *_ in heads], np.int64)
        nodes = np.concatenate([starts[live], roots[later]])
        edges, who = lattices.walk(nodes, np.concatenate([mix(seeds_r[live]), mix(word_seed[later] + PLACES[3 + r % 50])]))
        own = np.searchsorted(who, np.arange(len(live) + 1))
        tail_word = np.flatnonzero(later)[who[own[-1] :] - len(live)]
        tail_at = own[-1] + np.searchsorted(text_of[tail_word], np.arange(len(texts) + 1)) if len(tail_word) else np.full(len(texts) + 1, own[-1])
        parts, words, lengths = [], [], np.zeros(len(texts), np.int64)
        for h, (t, path, at, e) in enumerate(heads):
            a, b, c = path.edges[path.offsets[t] : at], edges[own[h] : own[h + 1]], edges[tail_at[t] : tail_at[t + 1]]
            parts += [a, [e], b, c]
            words += [path.word[path.offsets[t] : at + 1], np.full(len(b), path.word[at]), tail_word[tail_at[t] - own[-1] : tail_at[t + 1] - own[-1]]]
            lengths[t] = len(a) + 1 + len(b) + len(c)
        joined = np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
        paths.append(Path(lattices, joined, np.concatenate([*words, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)]), value, turn, seeds_r))
    raise AssertionError


def ids_of(lattices: Lattices, edges: np.ndarray) -> np.ndarray:
    """Piece ids of a path's edges; an edge spelled in bytes gives several."""
    ids = lattices.piece[edges]
    if (ids < 0).any():
        ids = np.concatenate([lattices.spelled[int(e)] if i < 0 else [i] for e, i in zip(edges, ids)])
    return ids.astype(np.int32)


def sample(docs: DataFrame, k: int = 2, alpha: float = 1.0, model: str = MODEL, seed: int = 0, with_ids: bool = True) -> DataFrame:
    """docs with samples: an array of at most k distinct segmentations of the whole text, by falling perturbed log
    probability; fewer only where the text has fewer. Each has n_pieces, log_prob (exact), perturbed,
    log_inclusion, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_ok (decoding gives the text
    back, U+2581 read as a space) and, if asked for, ids.

    The randomness is a hash of doc_id and seed, so rows give the same samples wherever and whenever they run.
    Null texts have no samples; an empty text has one, of no pieces. A samples column of docs is replaced."""
    fields = "n_pieces:bigint,log_prob:double,perturbed:double,log_inclusion:double,ids_sha256:string,decoded_ok:boolean" + ",ids:array<int>" * with_ids

    def start():
        pieces = vocabulary(model, alpha)
        lattices = Lattices(pieces)

        def compute(texts, keys):
            if len(lattices.first) > MOST_NODES:  # none is needed again
                lattices.clear()
            paths, left = draw(lattices, [t or "" for t in texts], np.array(keys, np.int64).view(np.uint64), k)
            rows: list[list] = [[] for _ in texts]
            for path in paths:
                for t in np.flatnonzero(path.values > -np.inf).tolist():
                    if texts[t] is None:
                        continue
                    ids = ids_of(lattices, path.edges[path.offsets[t] : path.offsets[t + 1]])
                    x = path.log_prob[t] - left[t]
                    inclusion = math.log(-math.expm1(-math.exp(x))) if -30 < x < 700 else min(0.0, x)
                    row = {
                        "n_pieces": len(ids),
                        "log_prob": float(path.log_prob[t]),
                        "perturbed": float(path.values[t]),
                        "log_inclusion": inclusion,
                        "ids_sha256": hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(),
                        "decoded_ok": pieces.decode(ids.tolist()) == texts[t].replace(SPACE, " "),
                    }
                    rows[t].append(row | {"ids": ids} if with_ids else row)
            return [rows]

        return compute

    return map_texts(docs, [("samples", f"array<struct<{fields}>>")], start, key=F.xxhash64(F.lit(seed), "doc_id"), piece_bytes=250_000)


def decode(encoded: DataFrame, ids: str, text: str, model: str = MODEL) -> DataFrame:
    """encoded with a column text, decoded from the array of piece ids in a column; null stays null."""

    import pandas as pd

    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = vocabulary(model, 1.0)
        for own in batches:
            yield pd.Series([None if x is None else known.decode(x) for x in own], dtype=object)

    return encoded.withColumn(text, F.pandas_udf(decoded, "string")(ids))
