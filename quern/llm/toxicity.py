"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as a learned vector of the word (if frequent in the sample) beside the mean of the learned vectors of its
character trigrams and the last state of a gated recurrent net that reads them in order (long words in pieces, whose states are averaged). Every window of WINDOW words, from
each word on, of the whole text is scored (a shorter text is one window); a text's score is its highest window's, calibrated on
texts that training didn't see. Gates are clipped linear functions and states x / (1 + |x|), which numpy does far faster than
logistic functions and hyperbolic tangents. Training is multiple-instance, on the sample's windows at every LEARN_STRIDE words: of a
toxic text the windows scored highest carry the label, of a clean text every window does.
Defined results: null, empty or wordless text scores 0; equal texts score alike, repeated rows too, each kept; with no or one-sided
labels all score 0; a key with labels of both kinds counts as toxic; extra columns pass, ones named like a result are replaced; texts
of any length are scored whole, in blocks; an empty table gives an empty result."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from quern.llm.batches import add_columns, filter_rows, sample_ids, small_batches, span_hash, text_buffers, words_of

WINDOW = 16
STRIDE, LEARN_STRIDE = 1, 3 * WINDOW // 4
THRESHOLD = 0.7
#: Bounds of the training sample: texts a label, characters of a sampled text, windows taken of one text. One text in VALID is kept for calibration.
PER_LABEL, MAX_CHARS, WINDOWS_A_TEXT, VALID = 1500, 10_000, 20, 10
#: Rounds of training, those before which hard clean windows of the sample are added, and the last ones whose weights are averaged.
EPOCHS, MINE, AVERAGED = 14, (5, 8), 3
TRIGRAMS = 8192
#: Sizes of vectors, states and attention; bytes of a word's piece.
D, H, A, PIECE = 8, 8, 8, 12
#: Bytes of text a step; its arrays stay in the cache.
CHUNK = 256 << 10
#: Windows scored at once.
BLOCK = 2048

#: Words are runs of ASCII letters and of bytes above 127.
BREAK = np.ones(256, bool)
BREAK[128:] = False
for _lo in (65, 97):
    BREAK[_lo : _lo + 26] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Network:
    """Weights; `words` are the sorted hashes of the words that have a vector, in the order of rows 1.. of `word`."""

    words: np.ndarray
    p: dict = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, text of word, trigram bucket per byte in words, first trigram of each word, trigrams of each word)."""
    data, off = text_buffers(col)
    data = LOWER[data]
    starts, ends, doc = words_of(data, off, BREAK)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z, z
    h = span_hash(data, starts, ends)
    inside = ~BREAK[data]
    pad = np.concatenate([[0], np.where(inside, data, 0), [0]]).astype(np.uint32)
    prev, nxt = pad[:-2].copy(), pad[2:].copy()
    prev[starts] = 1
    nxt[ends - 1] = 1
    tri = (prev * np.uint32(0x9E3779B1)) ^ (pad[1:-1] * np.uint32(0x85EBCA77)) ^ (nxt * np.uint32(0xC2B2AE3D))
    tri ^= tri >> np.uint32(15)
    tri *= np.uint32(0x2C1B3C6D)
    tri = ((tri >> np.uint32(12)) % np.uint32(TRIGRAMS))[inside]
    size = ends - starts
    first = np.cumsum(size) - size
    return h, doc, tri.astype(np.int32), first, size


def many_tokens(texts: list[str], step: int = 100) -> tuple[np.ndarray, ...]:
    """tokens() of a sample, a few texts at a time, so that the driver holds little beside the result."""
    parts, words, chars = [], 0, 0
    for lo in range(0, len(texts), step):
        h, doc, tri, first, size = tokens(pa.array(texts[lo : lo + step], pa.string()))
        parts.append((h, (doc + lo).astype(np.int32), tri, (first + chars).astype(np.int32), size.astype(np.int32)))
        words, chars = words + len(h), chars + len(tri)
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.uint64),) + (np.zeros(0, np.int32),) * 4


def rows_of(net: Network, h: np.ndarray) -> np.ndarray:
    """Row of each word's vector; 0 for words without one."""
    at = np.searchsorted(net.words, h)
    at[at == len(net.words)] = 0
    known = net.words[at] == h if len(net.words) else np.zeros(len(h), bool)
    return np.where(known, at + 1, 0)


def windows(doc: np.ndarray, n_docs: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of every window: starts at each multiple of stride, the last reaches the text's end."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    many = np.where(count > 0, np.maximum(1, -(-(count - WINDOW + stride) // stride)), 0)
    of = np.repeat(np.arange(n_docs), many)
    at = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * stride
    return first[of] + at, np.minimum(WINDOW, count[of] - at), of


class Pieces:
    """The pieces of words: of each word, its pieces; of each piece, the trigram buckets it runs over."""

    def __init__(self, first: np.ndarray, size: np.ndarray):
        self.many = -(-size // PIECE)
        self.start = np.cumsum(self.many) - self.many
        self.word = np.repeat(np.arange(len(size)), self.many)
        k = np.arange(len(self.word)) - self.start[self.word]
        self.first = first[self.word] + k * PIECE
        self.size = np.minimum(size[self.word] - k * PIECE, PIECE)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of the words, first of each)."""
        many = self.many[words]
        first = np.cumsum(many) - many
        return np.repeat(self.start[words] - first, many) + np.arange(int(many.sum())), first


def soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    y = np.abs(x)
    y += 1
    x /= y
    return x


def gates(x: list[np.ndarray], u: np.ndarray, b: np.ndarray, mask: np.ndarray | None, out: list[np.ndarray] | None, keep: list | None = None) -> np.ndarray:
    """One direction of a recurrent net. x: a (3H, B) input a step; u: (3H, H); mask: (T, B) or None. Fills out, a (H, B) a step; returns the last state."""
    n = x[0].shape[1]
    s = np.zeros((H, n), np.float32)
    full = None if mask is None else mask.all(1)
    b = b[:, None]
    g = np.empty((3 * H, n), np.float32)
    for i, xi in enumerate(x):
        if keep is not None:
            g = np.empty((3 * H, n), np.float32)
        np.matmul(u, s, out=g)
        zr = g[: 2 * H]
        zr += xi[: 2 * H]
        np.clip(zr, 0, 1, out=zr)
        z, r, hn = zr[:H], zr[H:], g[2 * H :]
        hn += b
        c = r * hn
        c += xi[2 * H :]
        soft(c)
        new = s - c
        new *= z
        new += c
        if full is not None and not full[i]:
            new -= s
            new *= mask[i]
            new += s
        if keep is not None:
            keep.append((s, z, r, hn, c))
        s = new
        if out is not None:
            out[i][...] = new
    return s


def gates_back(u: np.ndarray, kept: list, mask: np.ndarray, d_out: list[np.ndarray | None], carry: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Gradients of u, b and every step's input, from those of the steps' states and of the last one (carry)."""
    gu, gb, dx = np.zeros_like(u), np.zeros(H, np.float32), [None] * len(kept)
    for i in range(len(kept) - 1, -1, -1):
        s, z, r, hn, c = kept[i]
        d = carry if d_out[i] is None else carry + d_out[i]
        dn = d * mask[i]
        dz = dn * (s - c) * ((z > 0) & (z < 1))
        dc = dn * (1 - z) * (1 - np.abs(c)) ** 2
        dr = dc * hn * ((r > 0) & (r < 1))
        dhn = dc * r
        dg = np.concatenate([dz, dr, dhn])
        gu += dg @ s.T
        gb += dhn.sum(1)
        carry = d - dn + dn * z + u.T @ dg
        dx[i] = np.concatenate([dz, dr, dc])
    return gu, gb, dx


def characters(net: Network, tri: np.ndarray, first: np.ndarray, size: np.ndarray, table: np.ndarray | None = None, keep: dict | None = None) -> np.ndarray:
    """(H, pieces): the last state of the net over each piece's characters. table: the input part of every trigram, (trigrams, 3H)."""
    p = net.p
    if table is None:
        table = p["tri"] @ p["wc"].T + p["bc"]
    out = np.empty((H, len(first)), np.float32)
    step = max(BLOCK, 1) if keep is None else max(1, len(first))
    by_size = np.argsort(size, kind="stable")
    for lo in range(0, len(first), step):
        w = by_size[lo : lo + step]
        t = int(size[w[-1]])
        mask = (np.arange(t)[:, None] < size[w]).astype(np.float32)
        idx = tri[np.minimum(first[w] + np.arange(t)[:, None], len(tri) - 1)]
        x = [np.ascontiguousarray(table[row].T) for row in idx]
        kept: list | None = [] if keep is not None else None
        out[:, w] = gates(x, p["uc"], p["bn"], mask, None, kept)
        if keep is not None:
            keep |= {"order": w, "mask": mask, "idx": idx, "kept": kept}
    return out


def characters_back(net: Network, keep: dict, d_out: np.ndarray, g: dict) -> None:
    """Adds the gradients of the character net's weights and of the trigram vectors to g."""
    p = net.p
    w = keep["order"]
    g["uc"], g["bn"], dx = gates_back(p["uc"], keep["kept"], keep["mask"], [None] * len(keep["kept"]), d_out[:, w])
    flat, rows = np.concatenate(dx, 1), keep["idx"].reshape(-1)
    d_table = np.stack([np.bincount(rows, weights=v, minlength=TRIGRAMS) for v in flat], 1).astype(np.float32)
    g["wc"], g["bc"], g["tri"] = d_table.T @ p["tri"], d_table.sum(0), d_table @ p["wc"]


def averaged(states: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(words, H): mean of the states of each word's pieces."""
    many = np.diff(np.append(first, states.shape[1]))
    return (np.add.reduceat(states, first, axis=1) / many).T.astype(np.float32)


def spelled(net: Network, tri: np.ndarray, first: np.ndarray, size: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """(words, D + H): the character part of words' inputs, mean trigram vector and state."""
    pieces = Pieces(first, size)
    rows, head = runs(first, size)
    mean = np.add.reduceat(np.take(net.p["tri"], tri[rows], axis=0), head, axis=0) / size[:, None].astype(np.float32)
    return np.concatenate([mean, averaged(characters(net, tri, pieces.first, pieces.size, table), pieces.start)], 1)


def runs(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all places of the runs one after the other, start of each run among them)."""
    head = np.cumsum(size) - size
    return np.repeat(first - head, size) + np.arange(int(size.sum())), head


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def attend(net: Network, hh: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
    """Logits from the states hh, (2H, T, B): attention over the T words weighs their parts of the logit."""
    p = net.p
    size, t, n = hh.shape
    both = np.concatenate([p["wa"], p["wo"][None]]) @ hh.reshape(size, -1)
    a, part = both[:A], both[A].reshape(t, n)
    a += p["ba"][:, None]
    soft(a)
    e = (p["va"] @ a).reshape(t, n)
    if mask is not None:
        e -= 1e4 * (1 - mask)
    e -= e.max(0)
    np.exp(e, out=e)
    w = e / e.sum(0)
    if keep is not None:
        keep |= {"hh": hh, "a": a.reshape(A, t, n), "w": w, "part": part}
    return (w * part).sum(0) + p["bo"][0]


def forward(net: Network, proj: np.ndarray, first: np.ndarray, size: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of each window of given first word and size. proj: (6H, words), the input part of both directions for every word."""
    p, b = net.p, len(first)
    step = np.arange(WINDOW)[:, None]
    mask = (step < size).astype(np.float32)
    idx = np.minimum(first + step, proj.shape[1] - 1)
    hh = np.empty((2 * H, WINDOW, b), np.float32)
    kf, kb = ([], []) if keep is not None else (None, None)
    gates([proj[: 3 * H, i] for i in idx], p["uf"], p["bf"], mask, [hh[:H, i] for i in range(WINDOW)], kf)
    gates([proj[3 * H :, i] for i in idx[::-1]], p["ub"], p["bb"], mask[::-1], [hh[H:, i] for i in range(WINDOW - 1, -1, -1)], kb)
    if keep is not None:
        keep |= {"mask": mask, "idx": idx, "kf": kf, "kb": kb, "b": b}
    return attend(net, hh, mask, keep)


def consecutive(net: Network, proj: np.ndarray, lo: int, n: int, hh: np.ndarray) -> np.ndarray:
    """Logits of the n full windows that start at the words from lo on; nothing is gathered, step i is a slice i words further."""
    p = net.p
    hh = hh[:, :, :n]
    x = [slice(lo + i, lo + i + n) for i in range(WINDOW)]
    gates([proj[: 3 * H, i] for i in x], p["uf"], p["bf"], None, [hh[:H, i] for i in range(WINDOW)])
    gates([proj[3 * H :, i] for i in x[::-1]], p["ub"], p["bb"], None, [hh[H:, i] for i in range(WINDOW - 1, -1, -1)])
    return attend(net, hh, None)


def backward(net: Network, keep: dict, d_logit: np.ndarray, n_words: int) -> tuple[dict, np.ndarray]:
    """Gradients of the weights and of proj."""
    p, g = net.p, {}
    hh, a, w, mask, idx, part = keep["hh"], keep["a"], keep["w"], keep["mask"], keep["idx"], keep["part"]
    flat = hh.reshape(2 * H, -1)
    d_part = w * d_logit
    g["wo"], g["bo"] = flat @ d_part.reshape(-1), np.array([d_logit.sum()], np.float32)
    de = d_part * (part - (w * part).sum(0))
    da = (p["va"][:, None, None] * de) * (1 - np.abs(a)) ** 2
    g["va"], g["ba"] = a.reshape(A, -1) @ de.reshape(-1), da.sum((1, 2))
    g["wa"] = da.reshape(A, -1) @ flat.T
    dh = (p["wo"][:, None] * d_part.reshape(-1) + p["wa"].T @ da.reshape(A, -1)).reshape(hh.shape)
    d_proj = np.zeros((6 * H, n_words), np.float32)
    none = np.zeros((H, keep["b"]), np.float32)
    g["uf"], g["bf"], dx = gates_back(p["uf"], keep["kf"], mask, [dh[:H, i] for i in range(WINDOW)], none)
    g["ub"], g["bb"], dy = gates_back(p["ub"], keep["kb"], mask[::-1], [dh[H:, i] for i in range(WINDOW - 1, -1, -1)], none)
    for half, (d, order) in enumerate(((dx, idx), (dy, idx[::-1]))):
        at = order.reshape(-1)
        for k, v in enumerate(np.concatenate(d, 1)):
            d_proj[half * 3 * H + k] = np.bincount(at, weights=v, minlength=n_words)
    return g, d_proj


def start(words: np.ndarray, rng: np.random.Generator) -> Network:
    f = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(np.float32)
    gate = np.repeat(np.float32([0.5, 0.5, 0]), H)
    p = {
        "word": f(len(words) + 1, D, k=0.3), "tri": f(TRIGRAMS, D, k=0.5), "wc": f(3 * H, D, k=0.3), "bc": gate.copy(), "uc": f(3 * H, H, k=0.3), "bn": np.zeros(H, np.float32),
        "wx": f(6 * H, 2 * D + H, k=0.3), "bx": np.tile(gate, 2), "uf": f(3 * H, H, k=0.3), "ub": f(3 * H, H, k=0.3), "bf": np.zeros(H, np.float32), "bb": np.zeros(H, np.float32),
        "wa": f(A, 2 * H, k=0.3), "ba": np.zeros(A, np.float32), "va": f(A, k=0.5), "wo": f(2 * H, k=0.5), "bo": np.zeros(1, np.float32),
    }
    return Network(words, p)


def projected(net: Network, rows: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """(6H, words): the input part of both directions from word rows and character states."""
    return net.p["wx"] @ np.concatenate([np.take(net.p["word"], rows, axis=0), chars], 1).T + net.p["bx"][:, None]


def train(texts: list[str], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS, batch: int = 1024) -> Network | None:
    """Fit on a bounded sample of texts. None if it has no text with words of either label."""
    rng = np.random.default_rng(seed)
    valid = np.zeros(len(texts), bool)
    for y in (0, 1):
        own = np.flatnonzero(labels == y)
        if len(own) >= 10 * VALID:
            valid[rng.choice(own, len(own) // VALID, replace=False)] = True
    net = learn([t for t, v in zip(texts, valid) if not v], labels[~valid], rng, epochs, batch)
    if net is not None:
        seen = valid if len(np.unique(labels[valid])) == 2 else ~valid
        calibrate(net, [t for t, v in zip(texts, seen) if v], labels[seen])
    return net


def learn(texts: list[str], labels: np.ndarray, rng: np.random.Generator, epochs: int, batch: int) -> Network | None:
    h, doc, tri, first, size = many_tokens(texts)
    if not len(h) or len(np.unique(labels[np.unique(doc)])) < 2:
        return None
    w0, wn, of = windows(doc, len(texts), LEARN_STRIDE)
    order = rng.permutation(len(w0))
    order = order[np.argsort(of[order], kind="stable")]
    run = np.arange(len(order)) - np.searchsorted(of[order], of[order])
    w0, wn, of = w0[order], wn[order], of[order]
    chosen = run < WINDOWS_A_TEXT
    uniq, at, word = np.unique(h, return_index=True, return_inverse=True)
    in_docs = np.bincount(np.unique(word * len(texts) + doc) // len(texts), minlength=len(uniq))
    net = start(uniq[in_docs >= 12][:20_000], rng)
    row_of = rows_of(net, uniq)
    pieces = Pieces(first[at], size[at])
    y = labels[of].astype(np.float32)
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    score, t, settled, taken = np.zeros(len(w0), np.float32), 0, None, 0
    for epoch in range(epochs):
        weight = chosen.astype(np.float32)
        if epoch in MINE:
            # clean windows outside the choice that the net scores too high join it
            rest = np.flatnonzero((y == 0) & ~chosen)
            each = projected(net, row_of, spelled(net, tri, first[at], size[at]))
            for lo in range(0, len(rest), BLOCK):
                w = rest[lo : lo + BLOCK]
                need = np.minimum(w0[w] + np.arange(WINDOW)[:, None], w0[w] + wn[w] - 1)
                score[w] = forward(net, each[:, word[need.T.reshape(-1)]], np.arange(len(w)) * WINDOW, wn[w])
            chosen[rest[score[rest] > -3]] = True
            weight = chosen.astype(np.float32)
        if epoch >= 2:
            # a toxic text's label goes to its highest windows; the others of it say nothing
            top = np.full(len(texts), -1e9, np.float32)
            np.maximum.at(top, of, score)
            weight[(y == 1) & (score < np.minimum(top[of] - 1.5, 2.0)) & (score < top[of])] = 0
            weight[chosen & (y == 0) & (score < -6)] = 0.2
        live = np.flatnonzero(weight > 0)
        pos = max(1.0, float(weight[live][y[live] == 1].sum()))
        balance = min(20.0, max(1.0, float(weight[live][y[live] == 0].sum()) / pos / 2))
        rng.shuffle(live)
        for lo in range(0, len(live), batch):
            w = live[lo : lo + batch]
            need = np.unique(np.minimum(w0[w] + np.arange(WINDOW)[:, None], w0[w] + wn[w] - 1))
            own, of_word = np.unique(word[need], return_inverse=True)
            part, head = pieces.of(own)
            held: dict = {}
            states = characters(net, tri, pieces.first[part], pieces.size[part], keep=held)
            rows = np.where(rng.random(len(need)) < 0.3, 0, row_of[own][of_word])  # words go missing, so that characters must do
            spell, begin = runs(first[at[own]], size[at[own]])
            letters = size[at[own]].astype(np.float32)
            mean = np.add.reduceat(net.p["tri"][tri[spell]], begin, axis=0) / letters[:, None]
            x = np.concatenate([net.p["word"][rows], np.concatenate([mean, averaged(states, head)], 1)[of_word]], 1)
            proj = net.p["wx"] @ x.T + net.p["bx"][:, None]
            kept: dict = {}
            logit = forward(net, proj, np.searchsorted(need, w0[w]), wn[w], kept)
            score[w] = logit
            c = weight[w] * np.where(y[w] == 1, balance, 1.0)
            d = ((sigmoid(logit) - y[w]) * c / max(1.0, c.sum())).astype(np.float32)
            g, dp = backward(net, kept, d, len(need))
            g["wx"], g["bx"] = dp @ x, dp.sum(1)
            dx = dp.T @ net.p["wx"]
            g["word"] = np.stack([np.bincount(rows, weights=v, minlength=len(net.p["word"])) for v in dx[:, :D].T], 1)
            d_word = np.stack([np.bincount(of_word, weights=v, minlength=len(own)) for v in dx[:, D:].T])
            characters_back(net, held, np.repeat(d_word[D:] / pieces.many[own], pieces.many[own], axis=1).astype(np.float32), g)
            each_letter = np.repeat(d_word[:D] / letters, size[at[own]], axis=1)
            g["tri"] += np.stack([np.bincount(tri[spell], weights=v, minlength=TRIGRAMS) for v in each_letter], 1).astype(np.float32)
            t += 1
            rate = 0.01 if epoch < epochs - 4 else 0.003
            for k, v in net.p.items():
                a, b = m[k]
                gk = np.clip(g[k].astype(np.float32), -1, 1)
                a += 0.1 * (gk - a)
                b += 0.01 * (gk * gk - b)
                v -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
            if epoch >= epochs - AVERAGED:  # the net is the mean of its last steps
                taken += 1
                settled = {k: v.copy() if settled is None else settled[k] + (v - settled[k]) / np.float32(taken) for k, v in net.p.items()}
    net.p = settled or net.p
    return net


def raw(net: Network, col: pa.Array, table: np.ndarray | None = None) -> np.ndarray:
    """Highest window logit of each text; -30 without words."""
    h, doc, tri, first, size = tokens(col)
    out = np.full(len(col), -30.0, np.float32)
    if not len(h):
        return out
    uniq, at, word = np.unique(h, return_index=True, return_inverse=True)
    each = projected(net, rows_of(net, uniq), spelled(net, tri, first[at], size[at], table))
    proj = np.take(each, word, axis=1)
    count = np.bincount(doc, minlength=len(col))
    short = np.flatnonzero((count > 0) & (count < WINDOW))
    begin = np.cumsum(count) - count
    for lo in range(0, len(short), BLOCK):
        w = short[lo : lo + BLOCK]
        out[w] = forward(net, proj, begin[w], count[w])
    hh = np.empty((2 * H, WINDOW, BLOCK), np.float32)
    for lo in range(0, len(h) - WINDOW + 1, BLOCK):
        n = min(BLOCK, len(h) - WINDOW + 1 - lo)
        of = doc[lo : lo + n]
        whole = of == doc[lo + WINDOW - 1 : lo + WINDOW - 1 + n]  # windows that reach into the next text are none
        if whole.any():
            np.maximum.at(out, of[whole], consecutive(net, proj, lo, n, hh)[whole])
    return out


def calibrate(net: Network, texts: list[str], labels: np.ndarray) -> None:
    """Scale and shift of the highest logit, such that THRESHOLD falls where the texts' F1 is best, in the widest gap of such places."""
    x = np.concatenate([raw(net, pa.array(texts[i : i + 60], pa.string())) for i in range(0, len(texts), 60)]).astype(float)
    x = np.clip(x, -20, 20)
    o = np.argsort(x, kind="stable")
    v, y = x[o], labels[o].astype(float)
    hit = np.cumsum(y[::-1])[::-1]  # toxic texts at or above each
    f1 = 2 * hit / (np.arange(len(v), 0, -1) + y.sum())
    gap = np.append(v[0] + 20, np.diff(v))
    f1[gap <= 0] = 0
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    i = int(best[gap[best].argmax()])
    cut = v[i] - min(gap[i], 8.0) / 2
    net.scale = 1.0
    net.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)


def score(net: Network | None, col: pa.Array, table: np.ndarray | None = None) -> np.ndarray:
    if net is None:
        return np.zeros(len(col))
    x = raw(net, col, table).astype(float)
    return np.where(x <= -30, 0.0, sigmoid(net.scale * np.clip(x, -20, 20) + net.shift))


def table_of(net: Network | None) -> np.ndarray | None:
    """The character net's input part of every trigram, made once a task."""
    return None if net is None else net.p["tri"] @ net.p["wc"].T + net.p["bc"]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> Network | None:
    """Train on at most per_label texts of each label, of at most max_chars characters each; the sample alone comes to the driver."""
    lab = labels.select(F.col(key).alias("_id"), F.col(label).alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    ids = sample_ids(lab, "_id", "_y", per_label)
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_t")).where((F.length("_t") <= max_chars) & F.col("_t").isNotNull())
    got = small_batches(rows.join(F.broadcast(ids), "_id")).select("_id", "_t", "_y").toArrow()
    got = got.sort_by([("_id", "ascending"), ("_t", "ascending")])
    return train(got.column("_t").to_pylist(), got.column("_y").to_numpy().astype(np.int64))


FIELDS = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]


def toxicity(docs: DataFrame, net: Network | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with `score` and `predicted`; one map over whole texts. The network (under 2 MB) travels with the task."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        own, table = held.value, table_of(held.value)

        def run(col):
            s = score(own, col, table)
            return [s, (s >= threshold).astype(np.int32)]

        return run

    return add_columns(docs, text, make, FIELDS, most=CHUNK)


def keep_clean(docs: DataFrame, net: Network | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below threshold, with the columns they came with."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        own, table = held.value, table_of(held.value)
        return lambda col: score(own, col, table) < threshold

    return filter_rows(docs, text, make, most=CHUNK)
