"""Personal data: fixed base patterns, and identifiers found by bootstrapped contextual extraction.

Bootstrapping: the base entities are seeds, and so are secrets (quoted or bare runs of 32, 40 or 64 hexadecimal digits). The
contexts of an occurrence are its candidate patterns: the label right before it (`phone:`, `token = "`), the two words before
it, and the word before with the word after; digits in contexts count as one. Every identifier-like token (three digits or more,
part of no base span) that stands in such a context is a candidate instance.
A pattern's confidence is the share of its distinct instances that are believed, shrunk for rare patterns; its support is the
number of distinct believed instances. Spark runs ROUNDS rounds over the pattern-instance graph: patterns of MIN_CONFIDENCE and
MIN_SUPPORT make their candidates believed, and believed candidates count, for their kind, as the seeds do in the next round, so that contexts which only discovered instances support are reached too. In the end a candidate in a confident
pattern becomes a span; so does a secret, which is a span in a confident context only.
Defined results: null text is empty; spans are in code points, end exclusive, and discovered ones overlap no other; repeated rows
count each in the result but once in a pattern's support (distinct instance strings); extra columns pass, ones named like a result
are replaced; texts of any length are read whole, in time linear in their length; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quern.llm.batches import discard, small_batches, stored

KINDS = ("email", "ip", "card", "phone", "secret")
BASE, SECRET = KINDS[:4], 4
#: The base patterns. A match of numbers joined by dots starts at the start of a run of digits.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])")
NOT_DIGIT = re.compile(r"[^0-9]")
DIGITS = re.compile(r"[0-9]+")
#: Rounds, and what a pattern needs to discover: confidence, distinct believed instances, and the constant that shrinks rare patterns.
ROUNDS, MIN_CONFIDENCE, MIN_SUPPORT, SHRINK = 3, 0.8, 5, 1.0
#: Parts into which the instances of a pattern, and the patterns of an instance, are dealt in joins.
SALTS = 16
TOKEN = re.compile(r"(?<![^\s(\[\"'=:])(?=[^\s]{0,40}?[0-9][^\s]{0,40}?[0-9][^\s]{0,40}?[0-9])[A-Za-z0-9+(@][A-Za-z0-9@._+()/-]{4,62}[A-Za-z0-9)]")
WORD = re.compile(r"[^\W_][\w'-]*")
LABEL = re.compile(r"([^\W\d_][\w.-]{0,23})[\x20\t]?[:=#][\x20\t]?[\"'(\[]?\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain. The at sign is in neither part, so each belongs to one at sign."""
    out, after = [], 0
    for m in DOMAIN.finditer(text):
        lo = m.start()
        while lo > after and (text[lo - 1].isascii() and text[lo - 1].isalnum() or text[lo - 1] in "._%+-"):
            lo -= 1
        if lo < m.start():
            out.append((lo, m.end()))
            after = m.end()
    return out


def octet(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all base matches, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(map(octet, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = NOT_DIGIT.sub("", m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as disjoint intervals in order."""
    out: list[tuple[int, int]] = []
    for a, _, e in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((a, e))
    return out


def apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of spans that meet none of the disjoint, ordered intervals."""
    starts, out = [a for a, _ in taken], []
    for a, e in spans:
        i = bisect_left(starts, e)
        if not i or taken[i - 1][1] <= a:
            out.append((a, e))
    return out


def contexts(text: str, a: int, b: int) -> list[str]:
    """The patterns that an occurrence stands in, the surest kind first: label, two words before, word before and word after.

    Lower case, digits as one, at most 80 characters before and 40 after. Nothing stands for a missing word: an occurrence at a
    text's start has no pattern of the words before it, so no pattern is everybody's."""
    before = text[max(0, a - 80) : a].lower()
    out = []
    m = LABEL.search(before)
    if m:
        out.append(f"label {m[1]}")
    left = [DIGITS.sub("0", w[-24:]) for w in WORD.findall(before)[-2:]]
    if len(left) == 2:
        out.append("left " + " ".join(left))
    right = WORD.search(text[b : b + 40].lower())
    if left and right:
        out.append(f"around {left[-1]} _ {DIGITS.sub('0', right[0][:24])}")
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(secrets, other identifier-like tokens) that overlap no base span nor each other: 6 to 64 characters of which three are digits."""
    taken = merged(base)
    secrets = apart([m.span() for m in HEX.finditer(text) if not m[0].isdigit() and not m[0].isalpha()], taken)
    taken = merged(base + [(a, SECRET, e) for a, e in secrets])
    near = [m.span() for m in TOKEN.finditer(text) if len(NOT_DIGIT.sub("", m[0])) >= 3]
    return secrets, apart(near, taken)


def links(docs: DataFrame, text: str) -> DataFrame:
    """The pattern-instance graph's edges: pattern, instance, seed kind or -1. Distinct within each batch."""
    rows = small_batches(docs.select(F.col(text).alias("text")))

    def run(batches):
        for b in batches:
            seen = set()
            for t in b.column("text").to_pylist():
                if not t or not DIGITS.search(t) and "@" not in t:
                    continue
                base = base_spans(t)
                secrets, near = candidates(t, base)
                for a, k, e in base + [(a, SECRET, e) for a, e in secrets] + [(a, -1, e) for a, e in near]:
                    own = hashlib.blake2b(t[a:e].encode(), digest_size=8).hexdigest()
                    seen.update((p, own, k) for p in contexts(t, a, e))
            if seen:
                cols = list(zip(*seen))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], ["pattern", "instance", "kind"])

    return rows.mapInArrow(run, "pattern string, instance string, kind int")


def salted(df: DataFrame, *by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))


def every_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def learn(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """High-confidence patterns: pattern, kind, confidence, support.

    All steps are grouped counts with map-side combination, and joins in which neither a pattern with many instances nor an
    instance with many patterns gathers in one task: the large side is dealt by a salt, the small side has a row a salt."""
    edges = links(docs, text).distinct()
    # a pattern with fewer instances than min_support can never be supported
    often = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_support).select("pattern")
    edges = stored(salted(edges, "instance").join(every_salt(often), ["pattern", "salt"]).select("pattern", "instance", "kind"), "pii-edges")
    believed = None  # (instance, kind) of candidates
    found = None
    for i in range(rounds):
        rows = edges
        if believed is not None:
            new = every_salt(believed.select("instance", F.col("kind").alias("as")))
            rows = salted(edges, "pattern").join(new, ["instance", "salt"], "left")
            rows = rows.select("pattern", F.when(F.col("kind") >= 0, F.col("kind")).otherwise(F.coalesce("as", "kind")).alias("kind"))
        tally = rows.groupBy("pattern", "kind").agg(F.count("*").alias("n"))
        scored = tally.groupBy("pattern").agg(F.max_by(F.struct("kind", "n"), F.when(F.col("kind") >= 0, F.struct("n", -F.col("kind")))).alias("main"), F.sum("n").alias("all"))
        scored = scored.select("pattern", F.col("main.kind").alias("kind"), (F.col("main.n") / (F.col("all") + F.lit(SHRINK))).alias("confidence"), F.col("main.n").alias("support"))
        last, found = found, stored(scored.where((F.col("kind") >= 0) & (F.col("confidence") >= min_confidence) & (F.col("support") >= min_support)), f"pii-round{i}")
        discard(*[x for x in (last, believed) if x is not None])
        if i + 1 < rounds:
            told = salted(edges.where("kind < 0"), "instance").drop("kind").join(every_salt(found.select("pattern", "kind", "confidence")), ["pattern", "salt"])
            best = told.groupBy("instance").agg(F.max(F.struct("confidence", -F.col("kind"), "kind")).alias("best"))
            believed = stored(best.select("instance", F.col("best.kind").alias("kind")), f"pii-beliefs{i}")
    discard(edges)
    return found


def hits(text: str, base: list[tuple[int, int, int]], patterns: dict[str, int]) -> list[tuple[int, int, int, int]]:
    """(start, end, rank of the context, kind) of the candidates that stand in one of patterns, each by its surest context."""
    secrets, near = candidates(text, base)
    out = []
    for spans, only in ((secrets, SECRET), (near, None)):
        for a, e in spans:
            for rank, p in enumerate(contexts(text, a, e)):
                kind = patterns.get(p)
                if kind is not None and (only is None or kind == only):
                    out.append((a, e, rank, kind))
                    break
    return out


def discovered(text: str, base: list[tuple[int, int, int]], patterns: dict[str, int]) -> list[tuple[int, int, int]]:
    """Spans that patterns find beside the base ones; they overlap neither those nor each other."""
    return [(a, kind, e) for a, e, _, kind in hits(text, base, patterns)]


FIELDS = [StructField(f"n_{k}", LongType()) for k in BASE] + [StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("n_found", LongType())]
#: Patterns that travel with one pass over the texts; more are dealt to several passes by their hash.
PASS = 200_000


def passes(patterns: DataFrame, most: int = PASS) -> list[DataFrame]:
    """The patterns in parts of about `most`, each small enough to travel with the tasks."""
    n = patterns.count()
    parts = max(1, -(-n // most))
    return [patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == i) for i in range(parts)]


def collect_patterns(patterns: DataFrame) -> dict[str, int]:
    return {r["pattern"]: r["kind"] for r in patterns.select("pattern", "kind").collect()}


def _with_hits(docs: DataFrame, patterns: DataFrame, text: str, most: int) -> tuple[DataFrame, dict[str, int]]:
    """docs and the last part of patterns, where one part is all there is; otherwise with a column _hits that the earlier parts filled.

    Each pass but the last reads the texts, adds what its part finds and is written to the shared folder."""
    parts = passes(patterns, most)
    for i, part in enumerate(parts[:-1]):
        held = docs.sparkSession.sparkContext.broadcast(collect_patterns(part))
        if i == 0:
            docs = docs.withColumn("_hits", F.array().cast("array<array<int>>"))
        names, schema = docs.columns, docs.schema

        def run(batches, held=held, names=names):
            for b in batches:
                new = [[*(h or []), *(list(x) for x in hits(t, base_spans(t), held.value))] if t else [] for t, h in zip(b.column(text).to_pylist(), b.column("_hits").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.list_(pa.list_(pa.int32()))) if n == "_hits" else b.column(n) for n in names], names)

        docs = stored(small_batches(docs).mapInArrow(run, schema), f"pii-pass{i}")
    return docs, collect_patterns(parts[-1])


def _spans(text: str, earlier: list | None, patterns: dict[str, int]) -> tuple[list, list]:
    """(base spans, discovered ones); a candidate that several passes hit goes by its surest context."""
    base = base_spans(text)
    if not patterns and not earlier or not DIGITS.search(text):
        return base, []
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for a, e, rank, kind in [*map(tuple, earlier or []), *hits(text, base, patterns)]:
        best[a, e] = min(best.get((a, e), (rank, kind)), (rank, kind))
    return base, [(a, kind, e) for (a, e), (_, kind) in best.items()]


def extract(docs: DataFrame, patterns: DataFrame, text: str = "text", most: int = PASS) -> DataFrame:
    """docs with the columns of FIELDS; one map over whole texts (more only beyond `most` patterns). n_found counts discovered spans."""
    docs, last = _with_hits(docs.drop(*(f.name for f in FIELDS)), patterns, text, most)
    held = docs.sparkSession.sparkContext.broadcast(last)
    schema = StructType([f for f in docs.schema.fields if f.name != "_hits"] + FIELDS)
    keep = [f.name for f in docs.schema.fields if f.name != "_hits"]
    several = "_hits" in docs.columns

    def run(batches):
        for b in batches:
            counts, sha, spans, found = [[], [], [], []], [], [], []
            earlier = b.column("_hits").to_pylist() if several else [None] * b.num_rows
            for t, h in zip(b.column(text).to_pylist(), earlier):
                base, new = _spans(t or "", h, held.value)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in base))
                sha.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(sorted(base + new)))
                found.append(len(new))
            cols = [b.column(n) for n in keep] + [pa.array(c, pa.int64()) for c in counts] + [pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return small_batches(docs).mapInArrow(run, schema)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the union is replaced once, named by the first."""
    out, at = [], 0
    for a, k, e in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, patterns: DataFrame, text: str = "text", most: int = PASS) -> DataFrame:
    """docs with personal data in `text` masked; same columns, and n_chars (if there) recounted. Null text stays null."""
    schema = docs.schema
    docs, last = _with_hits(docs, patterns, text, most)
    held = docs.sparkSession.sparkContext.broadcast(last)
    type_of = {f.name: f.dataType for f in schema}
    several = "_hits" in docs.columns

    def run(batches):
        for b in batches:
            earlier = b.column("_hits").to_pylist() if several else [None] * b.num_rows
            new = []
            for t, h in zip(b.column(text).to_pylist(), earlier):
                if t:
                    base, found = _spans(t, h, held.value)
                    t = mask(t, base + found)
                new.append(t)
            cols = [pa.array(new, b.schema.field(n).type) if n == text else b.column(n) for n in schema.names]
            if "n_chars" in type_of:
                at = schema.names.index("n_chars")
                cols[at] = pa.array([len(t) if t is not None else None for t in new], pa.int64()).cast(b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return small_batches(docs).mapInArrow(run, schema)
