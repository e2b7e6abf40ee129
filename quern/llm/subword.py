"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

A text's lattice has a node before each character and an edge for each piece of the vocabulary that matches there (bytes for
characters without a piece). Pieces have unigram scores -alpha * log(rank + 2), for the vocabulary file ranks its pieces
(Zipf's law) and holds no probabilities. No piece spans two words, so a text's lattice is its words' lattices in a row, and
each distinct word's is built once in a batch.
Sampling: backward sums give every node the mass of its completions. The perturbed search keeps a queue of disjoint sets of
segmentations, each a prefix and the edges it may not take next, with the highest Gumbel-perturbed log-probability in the set.
The best set is popped, its maximiser drawn edge by edge, and what is left of it is split along the drawn path into sets whose
maxima are Gumbel variables truncated at the popped value. The k pops are an exact sample of k distinct segmentations without
replacement, in order; the best value left is the threshold of the inclusion scores 1 - exp(-exp(log p - threshold)).
All draws are hashes of the row key, the sample, the word and the step: the same on any partitioning.
Defined results: null text counts as empty; the empty text has one segmentation, of no pieces; a text with fewer than k
segmentations gives all of them, with inclusion 1; repeated rows give equal rows; extra columns are not read."""

from __future__ import annotations

import heapq
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm.batches import BASE, INVERSE, U, mix, slices, small_batches

SPACE = "▁"
#: Samples a text, sharpness of the scores, score of a byte piece, longest piece in characters, bytes of text a step.
SAMPLES, ALPHA, BYTE_SCORE, LONGEST, CHUNK = 2, 1.0, -12.0, 16, 2 << 20
SIEVE_BITS = 20
#: Places of a path whose branchings are told apart at once, and the mark of the set of all later ones.
NEAR, TAIL = 48, (-1,)


class Vocabulary:
    """Pieces of a SentencePiece model file, as hashes of code points."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_id, text, ids = np.full(256, sp.unk_id(), np.int64), [], []
        self.bytes_of = [b""] * n
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = p.replace(SPACE, " ").encode()
                if SPACE not in p[1:] and len(p) <= LONGEST:
                    text.append(p)
                    ids.append(i)
        order = {i: r for r, i in enumerate(sorted(ids, key=lambda i: (-sp.get_score(i), i)))}
        h = np.array([piece_hash(p) for p in text], U)
        o = np.argsort(h)
        self.hash, self.id = h[o], np.array(ids, np.int64)[o]
        self.score = np.array([-alpha * np.log(order[i] + 2) for i in ids])[o]
        # beginnings of pieces: where a text's characters begin no piece, longer pieces needn't be looked up
        begun = np.array(sorted({piece_hash(p[:j]) for p in text for j in range(1, len(p))}), U)
        # first piece of each bucket of hashes, and whether a bucket holds several; -1 for none
        self.slot, self.begun = np.full(1 << SIEVE_BITS, -1, np.int32), np.zeros(1 << SIEVE_BITS, bool)
        bucket = (self.hash >> U(64 - SIEVE_BITS)).astype(np.int64)
        self.slot[bucket[::-1]] = np.arange(len(bucket), dtype=np.int32)[::-1]
        self.crowded = np.append(bucket[1:] == bucket[:-1], False)
        self.begun[(begun >> U(64 - SIEVE_BITS)).astype(np.int64)] = True

    def decode(self, ids) -> str:
        """Text of piece ids; the first piece's leading space is the one that encoding put there."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


def piece_hash(piece: str) -> int:
    c = [ord(x) for x in piece]
    total = sum((x + 1) * pow(BASE, i, 1 << 64) for i, x in enumerate(c)) % (1 << 64)
    return int(mix(np.array([(total + len(c)) % (1 << 64)], U))[0])


class Lattice:
    """The lattices of many words at once. Node n of word w is character n - start[w].

    Edges are stored node by node, nodes nearer their word's end first, so that one pass over slices gives the backward sums.
    Node n's edges are first[rank[n]] to first[rank[n] + 1], by length."""

    def __init__(self, vocab: Vocabulary, words: list[str]):
        # a literal separator character in a word is no space: it gets a code point no piece has
        self.vocab = vocab
        text = "".join([SPACE + (w.replace(SPACE, "\U0010ffff") if SPACE in w else w) for w in words])
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
        n = len(code)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(size)
        self.code, self.start, self.end = code, end - size, end
        left = np.repeat(end, size) - np.arange(n)  # characters to the word's end
        found = list(self._pieces(code, left))
        deg = np.zeros(n, np.int64)
        for at, _ in found:
            deg[at] += 1
        furthest = int(left.max()) if n else 0
        order = np.argsort(left.astype(np.uint16) if furthest < 1 << 16 else left, kind="stable")
        rank = np.empty(n + 1, np.int64)
        rank[order], rank[n] = np.arange(n), n
        first = np.zeros(n + 1, np.int64)
        np.cumsum(deg[order], out=first[1:])
        self.rank, self.first = rank, first
        free = first[rank[:n]]  # next unused edge of each node
        m = int(first[n])
        score, to = np.empty(m), np.empty(m, np.int64)
        self.ids, self.length = np.empty(m, np.int64), np.empty(m, np.int64)
        for k, (at, i) in enumerate(found, 1):
            e = free[at]
            free[at] += 1
            score[e] = vocab.score[i]
            self.ids[e] = vocab.id[i]
            self.length[e] = k
            to[e] = np.where(left[at] == k, n, rank[at + k])
            if k == 1:
                bare = at[i < 0]
                width = 1 + (code[bare] > 0x7F) + (code[bare] > 0x7FF) + (code[bare] > 0xFFFF)
                width[code[bare] == 0x10FFFF] = 3
                score[e[i < 0]] = BYTE_SCORE * width
                self.ids[e[i < 0]] = -1
        beta = np.zeros(n + 1)  # by rank; the last stands for a word's end
        prob = np.empty(m)
        cut = np.searchsorted(left[order], np.arange(1, furthest + 2))
        deg = deg[order]
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            span = slice(first[lo], first[hi])
            x = score[span] + beta[to[span]]
            starts = first[lo:hi] - first[lo]
            top = np.maximum.reduceat(x, starts)
            p = np.exp(x - np.repeat(top, deg[lo:hi]))
            s = np.add.reduceat(p, starts)
            beta[lo:hi] = top + np.log(s)
            prob[span] = p / np.repeat(s, deg[lo:hi])
        self.chance = prob  # probability of each edge given its node
        total = np.cumsum(prob) - prob
        self.below = total - np.repeat(total[first[:-1]], deg)  # probability of the node's shorter edges
        self.last = first[rank[:n] + 1] - 1
        self.logp = np.log(np.maximum(prob, 1e-300))
        rest = 1.0 - prob
        branching = (rest > 1e-7) & (np.repeat(deg, deg) > 1)
        self.log_rest = np.where(branching, np.log(np.where(branching, rest, 1.0)), -np.inf)

    def _pieces(self, code: np.ndarray, left: np.ndarray):
        """Per length the nodes at which a piece begins and the pieces' places in the vocabulary; at length 1 every node, -1 for none."""
        vocab, n = self.vocab, len(code)
        up = np.ones(n + 1, U)
        up[1:] = np.multiply.accumulate(np.full(n, BASE, U))
        down = np.ones(n + 1, U)
        down[1:] = np.multiply.accumulate(np.full(n, INVERSE, U))
        c = np.zeros(n + 1, U)
        np.cumsum((code + U(1)) * up[:n], out=c[1:])
        open_ = np.arange(n)
        for k in range(1, LONGEST + 1):
            open_ = open_[left[open_] >= k]
            if not len(open_):
                return
            h = mix((c[open_ + k] - c[open_]) * down[open_] + U(k))
            bucket = (h >> U(64 - SIEVE_BITS)).astype(np.int64)
            i = vocab.slot[bucket]
            at = np.flatnonzero(i >= 0)
            i, found = i[at].astype(np.int64), h[at]
            many = np.flatnonzero(vocab.crowded[i])
            if len(many):
                i[many] = np.minimum(np.searchsorted(vocab.hash, found[many]), len(vocab.hash) - 1)
            ok = vocab.hash[i] == found
            if k == 1:
                every = np.full(n, -1)
                every[at[ok]] = i[ok]
                yield open_, every
            else:
                yield open_[at[ok]], i[ok]
            open_ = open_[vocab.begun[bucket]]

    @property
    def prob(self) -> np.ndarray:
        """Probabilities as a table by node and length less one, 0 for no piece."""
        table = np.zeros((len(self.code), LONGEST))
        deg = self.last + 1 - self.first[self.rank[:-1]]
        node = np.repeat(np.argsort(self.rank[:-1]), deg[np.argsort(self.rank[:-1])])
        table[node, self.length - 1] = self.chance
        return table

    def edges(self, node: int) -> slice:
        r = int(self.rank[node])
        return slice(int(self.first[r]), int(self.first[r + 1]))

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, for numbers u in (0, 1)."""
        e = self.last[node]
        high = np.flatnonzero(self.below[e] > u)
        while len(high):
            e[high] -= 1
            high = high[self.below[e[high]] > u[high]]
        return e


def absorb(seed: np.ndarray, part) -> np.ndarray:
    return mix(seed + np.asarray(part).astype(U) * U(0x9E3779B97F4A7C15) + U(1))


def uniform(seed: np.ndarray, *parts) -> np.ndarray:
    """Numbers in (0, 1), each the hash of its row's seed and the parts."""
    x = seed
    for p in parts:
        x = absorb(x, p)
    return ((x >> U(11)).astype(np.float64) + 0.5) / 2.0**53


def complete(lat: Lattice, node: np.ndarray, end: np.ndarray, seed: np.ndarray, word: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draw every word's pieces from its node to its end. Returns (pieces a row, node, edge), the pieces in order of row and place."""
    count = np.zeros(len(node), np.int64)
    row, seed = np.arange(len(node)), absorb(seed, word)
    steps = []
    live = node < end
    while True:
        row, node, end, seed = row[live], node[live], end[live], seed[live]
        if not len(row):
            break
        e = lat.draw(node, uniform(seed, [sample * 65536 + len(steps)]))
        steps.append((row, node, e))
        count[row] += 1
        node = node + lat.length[e]
        live = node < end
    place = np.cumsum(count) - count
    nodes, edges = np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()), np.int64)
    for i, (row, node, e) in enumerate(steps):
        nodes[place[row] + i] = node
        edges[place[row] + i] = e
    return count, nodes, edges


class Search:
    """One text's queue and samples. A path is two arrays: node, edge."""

    def __init__(self, words: np.ndarray, seed: int):
        self.words, self.seed, self.queue, self.found, self.paths = words, seed, [], [], []
        self.ticket = 0

    def push(self, value: float, path: int, at: int, out: tuple[int, ...]) -> None:
        if value > -np.inf:
            heapq.heappush(self.queue, (-value, self.ticket, path, at, out))
            self.ticket += 1


def branches(lat: Lattice, path: tuple, lo: int, hi: int, before: float) -> tuple[np.ndarray, np.ndarray]:
    """(place, log mass) of the sets that leave the path at places lo to hi; before: log-probability of the path up to lo."""
    edge = path[1][lo:hi]
    logq, rest = lat.logp[edge], lat.log_rest[edge]
    at = np.flatnonzero(rest > -np.inf)
    return at + lo, (before + np.cumsum(logq) - logq + rest)[at]


def truncated(mass: np.ndarray, bound: float | np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of these log masses, below bound."""
    return -np.logaddexp(-bound, np.log(-np.log(u)) - mass)


def remaining(lat: Lattice, node: int, out: tuple[int, ...]) -> np.ndarray:
    """Probabilities of a node's edges, 0 for those in out."""
    span = lat.edges(node)
    room = lat.chance[span].copy()
    room[[e - span.start for e in out]] = 0
    return room


def split(lat: Lattice, s: Search, value: float, path: tuple, at: int, out: tuple[int, ...]) -> tuple[int, np.ndarray, np.ndarray]:
    """Cut what is left of a popped set along its drawn path: the same prefix without the edges in out, and each later branching.
    Returns (place of the tail, places, log masses).

    Branchings beyond the next NEAR places are one set, the tail, cut up only if it is popped."""
    node, edge = path
    me = len(s.paths)
    s.paths.append(path)
    logq = lat.logp[edge]
    total, before = float(logq.sum()), float(logq[:at].sum())
    s.found.append((total, value, me))
    hi = min(len(node), at + NEAR)
    place, mass = branches(lat, path, at, hi, before)
    if out and at < len(node):
        left = remaining(lat, int(node[at]), (*out, int(edge[at]))).sum()
        rest = place > at
        place, mass = place[rest], mass[rest]
        if left > 1e-7:
            place, mass = np.append(place, at), np.append(mass, before + np.log(left))
    if hi < len(node):
        ahead = before + float(logq[at:hi].sum())
        if total < ahead - 1e-7:
            place, mass = np.append(place, hi), np.append(mass, ahead + np.log(-np.expm1(total - ahead)))
    return hi, place, mass


def push_all(cuts: list[tuple], sample: int, keep: int) -> None:
    """Queue the best sets of every text's cut (search, value, path, at, edges out, tail, places, log masses); all are drawn at once."""
    size = np.array([len(c[6]) for c in cuts])
    place, mass = np.concatenate([c[6] for c in cuts]), np.concatenate([c[7] for c in cuts])
    seed, bound = np.array([c[0].seed for c in cuts], U), np.array([c[1] for c in cuts])
    g = truncated(mass, np.repeat(bound, size), uniform(np.repeat(seed, size), place, [sample * 65536 + 40_000]))
    hi = 0
    for (s, _, path, at, out, tail, places, _), n in zip(cuts, size.tolist()):
        lo, hi = hi, hi + n
        one, edge, me = g[lo:hi], path[1], len(s.paths) - 1
        for i in np.argsort(-one, kind="stable")[:keep].tolist():
            j = int(places[i])
            s.push(float(one[i]), me, j, TAIL if j == tail else (*out, int(edge[j])) if out and j == at else (int(edge[j]),))


def pop(lat: Lattice, s: Search, sample: int, keep: int) -> tuple[float, int, int, tuple[int, ...]] | None:
    """The best set that isn't a tail. A tail that comes first is cut up: one branching takes its value, the others lie below."""
    while s.queue:
        neg, _, p, at, out = heapq.heappop(s.queue)
        if out != TAIL:
            return -neg, p, at, out
        node, edge = path = s.paths[p]
        place, mass = branches(lat, path, at, len(node), float(lat.logp[edge[:at]].sum()))
        if not len(place):
            continue
        u = uniform(np.full(len(place), s.seed, U), place, [sample * 65536 + 45_000])
        g = mass - np.log(-np.log(u))
        best = int(g.argmax())
        g = truncated(mass, -neg, uniform(np.full(len(place), s.seed, U), place, [sample * 65536 + 46_000]))
        g[best] = -neg
        for i in np.argsort(-g, kind="stable")[:keep].tolist():
            s.push(float(g[i]), p, int(place[i]), (int(edge[place[i]]),))
    return None


def sample_texts(vocab: Vocabulary, texts: list[str], seeds: np.ndarray, k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text its samples in order: (ids, log-probability, perturbed value, inclusion score)."""
    split_ = [t.split(" ") if t else [] for t in texts]
    number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split_)))}
    words = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in split_]
    lat = Lattice(vocab, list(number))
    begins = np.zeros(len(lat.code), bool)
    begins[lat.start] = True
    seeds = mix(seeds.astype(U))
    all_ = [Search(w, int(x)) for w, x in zip(words, seeds.tolist())]
    for r in range(k):
        jobs = []  # (search, value, prefix length, prefix path, forced edges out)
        if r == 0:
            firsts = (-np.log(-np.log(uniform(seeds, [1], [2])))).tolist()
        node, end, seed, word, size = [], [], [], [], []
        for i, s in enumerate(all_):
            if r == 0:
                jobs.append((s, firsts[i], None, 0, ()))
                node.append(lat.start[s.words])
                end.append(lat.end[s.words])
                word.append(np.arange(len(s.words)))
                n = len(s.words)
            elif (top := pop(lat, s, r, k - r + 1)) is not None:
                value, p, at, out = top
                nd, _ = s.paths[p]
                u = uniform(np.array([s.seed], U), [at], [r * 65536 + 50_000])[0]
                room = remaining(lat, int(nd[at]), out)
                c = np.cumsum(room)
                e = min(int(np.searchsorted(c, u * c[-1], "right")), len(room) - 1)
                if room[e] <= 0:
                    e = int(room.argmax())
                e += lat.edges(int(nd[at])).start
                jobs.append((s, value, p, at, (out, e)))
                w0 = int(begins[nd[: at + 1]].sum()) - 1
                node.append(np.concatenate([[nd[at] + lat.length[e]], lat.start[s.words[w0 + 1 :]]]))
                end.append(lat.end[s.words[w0:]])
                word.append(np.arange(w0, len(s.words)))
                n = len(s.words) - w0
            else:
                continue
            seed.append(np.full(n, s.seed, U))
            size.append(n)
        if not jobs:
            break
        count, nd, ed = complete(lat, np.concatenate(node), np.concatenate(end), np.concatenate(seed), np.concatenate(word), r)
        cut = np.append(0, np.cumsum(count))[np.append(0, np.cumsum(size))]
        cuts = []
        for j, (s, value, p, at, how) in enumerate(jobs):
            path = (nd[cut[j] : cut[j + 1]], ed[cut[j] : cut[j + 1]])
            out: tuple[int, ...] = ()
            if p is not None:
                on, oe = s.paths[p]
                out, e = how
                path = tuple(np.concatenate([a[:at], [b], c]) for a, b, c in zip((on, oe), (on[at], e), path))
            cuts.append((s, value, path, at, out, *split(lat, s, value, path, at, out)))
        push_all(cuts, r, k - r)
    result = []
    for s in all_:
        limit = -s.queue[0][0] if s.queue else -np.inf
        got = []
        for logp, value, p in s.found:
            inc = 1.0 if limit == -np.inf else float(-np.expm1(-np.exp(min(50.0, logp - limit))))
            got.append((edge_ids(lat, *s.paths[p]), logp, value, inc))
        result.append(got)
    return result


def path_ids(lat: Lattice, path: tuple) -> np.ndarray:
    """Piece ids of a path told by (words, nodes, lengths less one); the words aren't needed."""
    _, node, longer = path
    spans = [lat.edges(n) for n in node.tolist()]
    edge = [x.start + int(np.searchsorted(lat.length[x], k + 1)) for x, k in zip(spans, longer.tolist())]
    return edge_ids(lat, node, np.array(edge, np.int64))


def edge_ids(lat: Lattice, node: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Piece ids of a path's edges; characters without a piece give their bytes'."""
    ids = lat.ids[edge]
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids
    parts, last = [], 0
    for i in bare.tolist():
        c = int(lat.code[node[i]])
        raw = (SPACE if c == 0x10FFFF else chr(c)).encode("utf-8", "surrogatepass")
        parts += [ids[last:i], lat.vocab.byte_id[list(raw)]]
        last = i + 1
    return np.concatenate([*parts, ids[last:]])


OUT = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double, decodes boolean"


def sampled_segmentations(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", k: int = SAMPLES, alpha: float = ALPHA, with_ids: bool = False) -> DataFrame:
    """k rows a text at most: the samples in order, with `ids` if asked for; `decodes` says that decoding gives the text back."""
    from pyspark.sql.types import ArrayType, LongType, StructField

    rows = small_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    schema = StructType.fromDDL(OUT)
    if with_ids:
        schema = StructType([*schema.fields, StructField("ids", ArrayType(LongType()))])

    def run(batches):
        vocab = Vocabulary(path, alpha)
        for b in batches:
            for part in slices(b, "text", CHUNK):
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                seeds = np.array([0 if i is None else i & (1 << 64) - 1 for i in ids], U)
                out: list[list] = [[] for _ in schema.names]
                for i, t, got in zip(ids, texts, sample_texts(vocab, texts, seeds, k)):
                    for n, (tok, logp, value, inc) in enumerate(got):
                        back = vocab.decode(tok.tolist()) == t
                        row = [i, n + 1, len(tok), zlib.crc32(tok.astype("<u4").tobytes()), logp, value, inc, back] + ([tok.tolist()] if with_ids else [])
                        for col, v in zip(out, row):
                            col.append(v)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(out, types)], schema.names)

    return rows.mapInArrow(run, schema)
