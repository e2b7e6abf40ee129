"""Pattern scans whose counts stand beside a chance rate, a positive and a negative control."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Personal-data patterns, in a dialect that Java and RE2 read alike.
PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+",
    "phone": r"\+[0-9][0-9 ().-]{7,}[0-9]",
    "po_box": r"[Pp]\.? ?[Oo]\.? [Bb]ox [0-9]+",
    "home_dir": r"(?:/home/|/Users/|C:\\Users\\)[A-Za-z0-9._-]+",
    "street": r"[0-9]{1,5} [A-Z][a-z]+ (?:Street|Road|Avenue|Lane)",
    "postcode_town": r"(?:[A-Z]{1,2}-)?[0-9]{5} [A-Z][a-z]+",
}
BUILD = {"drive": r"[A-Z]:\\[A-Za-z0-9_\\.-]+", "pdb": r"[A-Za-z0-9_-]+\.pdb", "source": r"[A-Za-z0-9_-]+\.(?:cpp|java|py|rs)", "unix_src": r"/(?:usr|opt|src)/[A-Za-z0-9_/.-]+"}
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}"


def pattern_counts(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Non-overlapping hits and texts hit per pattern, zeros kept. One scan: a column a pattern, unpivoted after the sums."""
    # counted below the aggregate, so that the sum and the texts hit share one match of the pattern
    counted = df.select(*[F.regexp_count(F.col(text), F.lit(p)).alias(name) for name, p in patterns.items()])
    cells = [F.struct(F.lit(name).alias("pattern"), F.coalesce(F.sum(name), F.lit(0)).cast("long").alias("hits"), F.count_if(F.col(name) > 0).alias("docs")) for name in patterns]
    return counted.agg(F.array(*cells).alias("rows")).select(F.inline("rows"))


def needle_counts(df: DataFrame, text: str, needles: dict[str, str]) -> DataFrame:
    """Occurrences of literals with both chance formulas; kind tells controls from needles."""
    size = F.octet_length(text)
    cells = []
    for name, value in needles.items():
        k = len(value.encode())
        hits = (F.length(text) - F.length(F.replace(F.col(text), F.lit(value), F.lit("")))) / F.lit(len(value))
        cells.append(F.struct(F.lit(name).alias("kind"), F.lit(value).alias("needle"), F.lit(k).cast("long").alias("len"), F.coalesce(F.sum(hits), F.lit(0)).cast("long").alias("hits"), F.count_if(hits > 0).alias("docs"), F.sum(F.greatest(size - k + 1, F.lit(0))).cast("double").alias("windows"), F.sum(size).cast("double").alias("bytes")))
    rows = df.agg(F.array(*cells).alias("rows")).select(F.inline("rows"))
    power = F.pow(F.lit(256.0), F.col("len"))
    return rows.select("kind", "needle", "len", "hits", "docs", (F.col("windows") / power).alias("chance_windows"), (F.col("bytes") / power).alias("chance_bytes"))


def uuids(df: DataFrame, text: str, key: str) -> DataFrame:
    """Identifiers in texts: version, hashed value (not shown in clear), and how many texts hold it."""
    found = df.select(key, F.explode(F.regexp_extract_all(text, F.lit(f"({UUID})"), 1)).alias("u"))
    return found.groupBy(F.sha1(F.encode(F.lower("u"), "UTF-8")).alias("uuid_sha1"), F.substring("u", 15, 1).alias("version")).agg(F.count_distinct(key).alias("docs"))


def contact_classes(df: DataFrame, text: str) -> DataFrame:
    """Addresses by class of their local part: role, person (two parts), or other; counted, not shown."""
    found = df.select(F.explode(F.regexp_extract_all(text, F.lit("(" + PERSONAL["email"] + ")"), 1)).alias("a"))
    local = F.lower(F.substring_index("a", "@", 1))
    kind = F.when(local.isin("info", "support", "admin", "sales", "webmaster", "postmaster"), "role").when(local.rlike(r"^[a-z]+[._][a-z]+$"), "person").otherwise("other")
    return found.groupBy(kind.alias("class")).agg(F.count("*").alias("addresses"), F.count_distinct(F.lower("a")).alias("distinct_addresses"))


def redaction(df: DataFrame, text: str, key: str, patterns: dict[str, str]) -> DataFrame:
    """Texts with every pattern replaced by its bracketed name, and the counts on the input and on the output."""
    out, n = F.col(text), F.lit(0)
    for name, p in patterns.items():
        n = n + F.regexp_count(F.col(text), F.lit(p))
        out = F.regexp_replace(out, F.lit(p), F.lit(f"[{name}]"))
    done = df.select(key, n.cast("long").alias("found"), out.alias("redacted"))
    left = sum((F.regexp_count("redacted", F.lit(p)) for p in patterns.values()), F.lit(0))
    return done.select(key, "found", left.cast("long").alias("remaining"), F.sha1(F.encode("redacted", "UTF-8")).alias("redacted_sha1"))


def web_links(df: DataFrame, html: str) -> DataFrame:
    """Link targets without query and fragment, by attribute."""
    found = df.select(F.explode(F.regexp_extract_all(html, F.lit(r'(?:href|src)="([^"]*)"'), 1)).alias("u"))
    clean = F.substring_index(F.substring_index("u", "#", 1), "?", 1)
    return found.groupBy(clean.alias("target")).agg(F.count("*").alias("links"))


def runs(df: DataFrame, text: str, least: int) -> DataFrame:
    """Runs of printable ASCII of at least `least` characters: count, characters, longest."""
    n = F.transform(F.regexp_extract_all(text, F.lit(f"([ -~]{{{least},}})"), 1), F.length)
    per = df.select(F.size(n).alias("k"), F.aggregate(n, F.lit(0), lambda a, x: a + x).alias("c"), F.array_max(n).alias("m"))
    return per.agg(F.sum("k").alias("runs"), F.sum("c").alias("run_chars"), F.max("m").cast("long").alias("longest"))


def runs_expected(df: DataFrame, text: str, key: str, least: int) -> DataFrame:
    """Printable runs of at least `least` characters of each text beside those expected of as many independent characters."""
    n = F.length(text)
    p = F.try_divide(F.length(F.regexp_replace(text, "[^ -~]", "")).cast("double"), n)
    expected = F.round(F.pow(p, F.lit(least)) * (1 + (n - least) * (1 - p)), 4)
    found = F.size(F.regexp_extract_all(text, F.lit(f"([ -~]{{{least},}})"), 1)).cast("long")
    return df.select(key, found.alias("found"), F.when((n < least) | p.isNull(), 0.0).otherwise(expected).alias("expected"))


def encoded_needles(needles: list[str], encodings: tuple[str, ...] = ("utf-8", "utf-16-le", "utf-16-be", "cp1252")) -> list[tuple[str, str, bytes]]:
    """(needle, encodings, bytes): the encodings that give a needle the same bytes are one entry; those that can't write it are left out."""
    out: dict[tuple[str, bytes], list[str]] = {}
    for needle in needles:
        for enc in encodings:
            try:
                out.setdefault((needle, needle.encode(enc)), []).append(enc)
            except UnicodeEncodeError:
                continue
    return [(needle, "|".join(encs), raw) for (needle, raw), encs in out.items()]


def wide_counts(df: DataFrame, text: str, needles: list[str]) -> DataFrame:
    """Literals searched twice: in the text's own bytes, and as UTF-16LE in its UTF-16LE bytes. Zeros are kept."""
    latin = lambda c, codec: F.decode(F.encode(c, codec), "ISO-8859-1")
    sums = []
    for n in needles:
        for form, codec in (("narrow", "UTF-8"), ("wide", "UTF-16LE")):
            whole, part = latin(F.col(text), codec), n.encode(codec).decode("ISO-8859-1")
            hits = (F.length(whole) - F.length(F.replace(whole, F.lit(part), F.lit("")))) / F.lit(len(part))
            sums.append(F.struct(F.lit(n).alias("needle"), F.lit(form).alias("form"), F.coalesce(F.sum(hits), F.lit(0)).cast("long").alias("hits")))
    return df.agg(F.array(*sums).alias("rows")).select(F.inline("rows"))


def links(df: DataFrame, markup: str) -> DataFrame:
    """(kind, target) of href and src attributes in either quotes, and of bare URLs outside of tags; fragment and query are stripped."""
    found = lambda c, pattern: F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))
    attribute = F.concat(found(F.col(markup), r'(?:href|src)="([^"]*)"'), found(F.col(markup), r"(?:href|src)='([^']*)'"))
    bare = found(F.regexp_replace(markup, "<[^>]*>", " "), r"(https?://[^ \t\r\n\"'<>]+)")
    told = lambda urls, kind: F.transform(urls, lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("u")))
    rows = df.select(F.inline(F.concat(told(attribute, "attribute"), told(bare, "bare"))))
    return rows.select("kind", F.substring_index(F.substring_index("u", "#", 1), "?", 1).alias("target"))


def runs_at(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(key, at, length) of every printable run of at least `least` characters, `at` counted from 0. Null has none."""
    pattern = re.compile(f"[ -~]{{{least},}}")

    @F.pandas_udf("array<struct<at: long, length: long>>")
    def places(column: pd.Series) -> pd.Series:
        return column.map(lambda x: [{"at": m.start(), "length": m.end() - m.start()} for m in pattern.finditer(x or "")])

    return df.select(key, F.inline(places(text)))
