"""Quality rules by suffix array: repeated substrings of a text, found exactly, as spans of words.

The suffix array of a text's words and the common prefixes of its neighbours give the LCP intervals: each is a repeated sequence
of words with all its places. Those that no word could lengthen to the left at all places are the maximal repeats. The places
of repeats of min_words words or more are joined; the share of words they cover and the longest repeat decide. They act beside
the base rule: four-word repeats over max_fraction reject texts whose five-word repeats stay within it, and a single repeat over
max_longest rejects a long text whose covered share is small.
Defined results: null or empty text has zero words and fails the base rule; ties and repeated rows are judged each on its own;
extra columns pass through; input columns named like an output are replaced; a text of any length is read whole, in about 60
bytes of memory a byte of text; an empty table gives an empty result."""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField

from quern.llm.batches import U, add_columns, filter_rows, powers, span_hash, text_buffers, words_of

#: Words of the base rule's windows.
BASE_WORDS = 5


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of the verdict. Repeats shorter than min_words words don't count for it."""

    min_words: int = 4
    max_fraction: float = 0.3
    max_longest: int = 50


FIELDS = [
    StructField("n_words", LongType()), StructField("word_chars", LongType()), StructField("n_symbols", LongType()), StructField("n_dup_lines", LongType()),
    StructField("n_repeat_words", LongType()), StructField("base_failed", BooleanType()), StructField("kept", BooleanType()),
    StructField("n_covered_words", LongType()), StructField("n_maximal_repeats", LongType()), StructField("longest_repeat", LongType()), StructField("repeat_fraction", DoubleType()),
]

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def suffix_array(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Suffix arrays of many word sequences at once, one after the other, by prefix doubling.

    A suffix ends with its document. Only positions still tied are sorted again, so cost follows the repeats."""
    n = len(word)
    if not n:
        return np.zeros(0, np.int32)
    _, r = np.unique(word, return_inverse=True)
    key = doc.astype(np.int64) * (int(r.max()) + 1) + r
    del r
    order = np.argsort(key, kind="stable").astype(np.int32)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    del key
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    step = 1
    size = np.diff(np.append(np.flatnonzero(new), n))
    tied = order[np.repeat(size > 1, size)]
    del order, new
    while len(tied):
        after = np.minimum(tied + np.int32(step), np.int32(n - 1))
        second = np.where((tied + step < n) & (doc[after] == doc[tied]), rank[after] + 1, 0)
        key = rank[tied].astype(np.int64) * (n + 1) + second
        del after, second
        o = np.argsort(key, kind="stable")
        tied, key = tied[o], key[o]
        del o
        group = rank[tied]
        starts_group = np.ones(len(tied), bool)
        starts_group[1:] = group[1:] != group[:-1]
        starts_sub = np.ones(len(tied), bool)
        starts_sub[1:] = key[1:] != key[:-1]
        del key
        subs = np.flatnonzero(starts_sub).astype(np.int32)
        size = np.diff(np.append(subs, len(tied)))
        heads = np.flatnonzero(starts_group).astype(np.int32)
        within = np.repeat(subs - heads[np.cumsum(starts_group[subs]) - 1], size)
        rank[tied] = group + within
        del group, within
        tied = tied[np.repeat(size > 1, size)]
        step *= 2
    sa = np.empty(n, np.int32)
    sa[rank] = np.arange(n, dtype=np.int32)
    return sa


def common_prefixes(sa: np.ndarray, word: np.ndarray, doc: np.ndarray, least: int, block: int = 1 << 19) -> np.ndarray:
    """lcp[i]: words that suffixes sa[i-1] and sa[i] share, counted from `least` on (else 0); lcp[0] is 0.

    Lengths are found by halving on hashes of word sequences, a block of neighbours at a time."""
    n = len(sa)
    lcp = np.zeros(n, np.int32)
    if n < 2:
        return lcp
    up, down = powers(n)
    c = np.zeros(n + 1, U)
    np.cumsum(word * up[:n], out=c[1:])
    last = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, n)
    stop = np.repeat(last, np.diff(np.append(0, last))).astype(np.int32)
    for lo in range(1, n, block):
        a, b = sa[lo - 1 : min(n, lo + block) - 1].astype(np.int64), sa[lo : lo + block].astype(np.int64)
        room = np.minimum(stop[a] - a, stop[b] - b)
        ok = (doc[a] == doc[b]) & (room >= least)
        at = np.flatnonzero(ok)
        a, b, room = a[at], b[at], room[at]
        same = (c[a + least] - c[a]) * down[a] == (c[b + least] - c[b]) * down[b]
        at, a, b, room = at[same], a[same], b[same], room[same]
        long = np.full(len(at), least, np.int64)
        for j in range(int(room.max() if len(room) else 1).bit_length() - 1, -1, -1):
            more = long + (1 << j)
            can = np.flatnonzero(more <= room)
            x, y, m = a[can], b[can], more[can]
            can = can[(c[x + m] - c[x]) * down[x] == (c[y + m] - c[y]) * down[y]]
            long[can] = more[can]
        lcp[lo + at] = long
    return lcp


def lcp_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, length) of the LCP intervals of `least` words or more: suffixes first..last of the array are those that start with
    one repeated sequence of that length. A stack of open intervals over the neighbours that share so much."""
    first, last, length = array("q"), array("q"), array("q")
    open_at, open_len = array("q"), array("q")
    hot = np.flatnonzero(lcp >= least)
    before = -1

    def close(at: int) -> int:
        first.append(open_at.pop())
        last.append(at)
        length.append(open_len.pop())
        return first[-1]

    for lo in range(0, len(hot), 1 << 16):
        part = hot[lo : lo + (1 << 16)]
        for i, n in zip(part.tolist(), lcp[part].tolist()):
            if i != before + 1:
                while open_at:
                    close(before)
            left = i - 1
            while open_len and open_len[-1] > n:
                left = close(i - 1)
            if not open_len or open_len[-1] < n:
                open_at.append(left)
                open_len.append(n)
            before = i
    while open_at:
        close(before)
    return tuple(np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in (first, last, length))


def maximal_repeats(sa: np.ndarray, lcp: np.ndarray, word: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, length) of the intervals whose places don't all follow the same word."""
    first, last, length = lcp_intervals(lcp, least)
    at = sa.astype(np.int64)
    opens = np.append(True, doc[1:] != doc[:-1])[at]
    before = word[np.maximum(at - 1, 0)]
    differs = np.append(False, (before[1:] != before[:-1]) | opens[1:] | opens[:-1])
    many = np.cumsum(differs)
    ok = many[last] > many[first] if len(first) else np.zeros(0, bool)
    return first[ok], last[ok], length[ok]


def deepest_repeats(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Per position, the length of the deepest LCP interval that holds its suffix, which is the larger prefix it shares with a neighbour."""
    deep = np.zeros(len(sa), np.int32)
    deep[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    return deep


def union_size(start: np.ndarray, length: np.ndarray, doc: np.ndarray, n: int, n_docs: int) -> np.ndarray:
    """Words of each document that the spans cover."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.bincount(doc, weights=np.cumsum(edge)[:n] > 0, minlength=n_docs).astype(np.int64)


def measure(col: pa.Array, rules: RepetitionRules) -> list:
    data, off = text_buffers(col)
    n_docs = len(off) - 1
    starts, ends, doc = words_of(data, off)
    n_words = np.bincount(doc, minlength=n_docs)
    lead = np.append(0, np.cumsum((data & 0xC0) != 0x80)) if len(data) else np.zeros(1, np.int64)
    word_chars = np.bincount(doc, weights=lead[ends] - lead[starts], minlength=n_docs).astype(np.int64)
    sym = np.append(0, np.cumsum(SYMBOL[data])) if len(data) else np.zeros(1, np.int64)
    n_symbols = sym[off[1:]] - sym[off[:-1]]
    dup = dup_lines(data, off)
    h = span_hash(data, starts, ends) if len(starts) else np.zeros(0, U)
    del starts, ends, lead, sym
    n, least = len(h), min(BASE_WORDS, rules.min_words)
    sa = suffix_array(h, doc)
    lcp = common_prefixes(sa, h, doc, least)
    deep = deepest_repeats(sa, lcp)
    first, _, length = maximal_repeats(sa, lcp, h, doc, least) if n else (np.zeros(0, np.int64),) * 3
    owner = doc[sa[first]] if n else first

    def covered(shortest: int) -> np.ndarray:
        """Words of each text in the union of the places of repeats."""
        ok = deep >= shortest
        # a place whose left neighbour's covers it adds nothing
        ok[1:] &= ~((deep[:-1] >= deep[1:] + 1) & (doc[:-1] == doc[1:]))
        at = np.flatnonzero(ok)
        return union_size(at, deep[at], doc, n, n_docs) if n else np.zeros(n_docs, np.int64)

    n_repeat, n_covered = covered(BASE_WORDS), covered(rules.min_words)
    counts = length >= rules.min_words
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, owner[counts], length[counts])
    fraction = n_covered / np.maximum(n_words, 1)
    failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    kept = ~failed & (n_covered <= rules.max_fraction * n_words) & (longest <= rules.max_longest)
    return [n_words, word_chars, n_symbols.astype(np.int64), dup, n_repeat, failed, kept, n_covered, np.bincount(owner[counts], minlength=n_docs), longest, fraction]


def dup_lines(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    n_docs = len(off) - 1
    out = np.zeros(n_docs, np.int64)
    if not len(data):
        return out
    nl = np.flatnonzero(data == 10)
    starts = np.concatenate([off[:-1], nl + 1])
    doc = np.concatenate([np.arange(n_docs), np.searchsorted(off, nl, "right") - 1])
    o = np.lexsort((starts, doc))
    starts, doc = starts[o], doc[o]
    ends = np.append(starts[1:] - 1, off[-1])
    last = np.append(doc[1:] != doc[:-1], True)
    ends[last] = off[doc[last] + 1]
    wide = np.append(0, np.cumsum(~np.isin(data, np.array([9, 10, 11, 12, 13, 32], np.uint8))))
    ok = wide[ends] > wide[starts]
    starts, ends, doc = starts[ok], ends[ok], doc[ok]
    if not len(starts):
        return out
    h = span_hash(data, starts, ends)
    o = np.lexsort((h, doc))
    same = (h[o][1:] == h[o][:-1]) & (doc[o][1:] == doc[o][:-1])
    return np.bincount(doc[o][1:][same], minlength=n_docs)


def repetition_quality(docs: DataFrame, text: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """docs with the columns of FIELDS; one map over whole texts, no shuffle."""
    return add_columns(docs, text, lambda: lambda col: measure(col, rules), FIELDS)


def keep_quality(docs: DataFrame, text: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows that the rules keep, with the columns they came with."""
    return filter_rows(docs, text, lambda: lambda col: measure(col, rules)[6])
