"""Text measures: stop-word language scores, letters, command lines, JSON records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stop words a language, and letters that tell languages apart.
STOP_WORDS = {"de": ("der", "die", "und", "ist", "nicht"), "en": ("the", "and", "of", "to", "is"), "es": ("el", "los", "que", "para", "con"), "fr": ("le", "les", "des", "et", "une")}
HIGH_LETTERS = {"de": "äöüß", "es": "ñáíóú", "fr": "éèêçà"}


def _among(words: tuple[str, ...]):
    return lambda t: t.isin(*words)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def language_scores(text: Column) -> Column:
    """Stop words of each language in text, an array in the order of STOP_WORDS."""
    tokens = F.split(F.lower(text), r"[^a-zäöüßñáíóúéèêçà]+")
    return bound(tokens, lambda t: F.array(*[F.size(F.filter(t, _among(w))) for w in STOP_WORDS.values()]))


def guessed_language(text: Column) -> Column:
    """Language of the highest score; `none` without a hit, `tie` between equals."""

    def guess(scores: Column) -> Column:
        s = {g: scores[i] for i, g in enumerate(STOP_WORDS)}
        top = F.greatest(*s.values())
        ties = sum((F.when(c == top, 1).otherwise(0) for c in s.values()), F.lit(0))
        best = F.coalesce(*[F.when(c == top, F.lit(g)) for g, c in s.items()])
        return F.when(top == 0, "none").when(ties > 1, "tie").otherwise(best)

    return bound(language_scores(text), guess)


def high_letters(df: DataFrame, text: str, by: str) -> DataFrame:
    n = {g: F.length(text) - F.length(F.translate(F.col(text), chars, "")) for g, chars in HIGH_LETTERS.items()}
    return df.groupBy(by).agg(*[F.sum(c).alias(f"{g}_letters") for g, c in n.items()])


def extension(path: Column) -> Column:
    """Lower-case extension, `(none)` without one; a leading dot is none."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1))
    return F.when(ext == "", "(none)").otherwise(ext)


def skeleton(text: Column) -> Column:
    """A text with its words taken away: what is left is structure."""
    return F.sha1(F.encode(F.regexp_replace(text, r"[A-Za-z0-9\x{80}-\x{10FFFF}]+", "w"), "UTF-8"))


def grammar(df: DataFrame, text: str, verb: Column, *by: str) -> DataFrame:
    """First words of lines as commands: times and distinct lines."""
    lines = df.select(*by, F.explode(F.split(text, "\n")).alias("line")).where(F.trim("line") != "")
    return lines.groupBy(*by, verb.alias("verb")).agg(F.count("*").alias("n"), F.count_distinct("line").alias("distinct_lines"))


def rename_class(a: Column, b: Column) -> Column:
    """How two names differ: not, in case only (same), by separators, by a prefix, or altogether."""
    a, b = F.lower(a), F.lower(b)
    x, y = F.regexp_replace(a, "[ _#.-]", ""), F.regexp_replace(b, "[ _#.-]", "")
    return F.when(a == b, "same").when(x == y, "spaced").when(x.endswith(y) | y.endswith(x), "prefixed").otherwise("renamed")


def _folded_hash(name: Column, start: int, step) -> Column:
    """32-bit hash of a name's code points (bytes, if ASCII), left to right."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(start).cast("long"), step)


LOW32 = 0xFFFFFFFF


def fnv1a(name: Column) -> Column:
    return _folded_hash(name, 2166136261, lambda h, x: (h.bitwiseXOR(x) * 16777619).bitwiseAND(F.lit(LOW32)))


def fnv1(name: Column) -> Column:
    return _folded_hash(name, 2166136261, lambda h, x: (h * 16777619).bitwiseAND(F.lit(LOW32)).bitwiseXOR(x))


def sdbm(name: Column) -> Column:
    return _folded_hash(name, 0, lambda h, x: (h * 65599 + x).bitwiseAND(F.lit(LOW32)))


def elf(name: Column) -> Column:
    def step(h, x):
        h = (F.shiftleft(h, 4) + x).bitwiseAND(F.lit(LOW32))
        high = h.bitwiseAND(F.lit(0xF0000000))
        return h.bitwiseXOR(F.shiftright(high, 24)).bitwiseXOR(high)

    return _folded_hash(name, 0, step)


def one_at_a_time(name: Column) -> Column:
    """The one-at-a-time hash: mixed after each byte, and three times more at the end."""
    low = lambda c: c.bitwiseAND(F.lit(LOW32))

    def step(h, x):
        h = low(h + x)
        h = low(h + F.shiftleft(h, 10))
        return h.bitwiseXOR(F.shiftright(h, 6))

    h = _folded_hash(name, 0, step)
    h = low(h + F.shiftleft(h, 3))
    h = h.bitwiseXOR(F.shiftright(h, 11))
    return low(h + F.shiftleft(h, 15))


def byte_pairs(data: Column) -> Column:
    """Each byte as two hexadecimal digits, split in one pass."""
    return F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))


def byte_codes(data: Column) -> Column:
    return F.transform(byte_pairs(data), lambda p: F.conv(p, 16, 10).cast("long"))


def crc16(data: Column, poly: int = 0xA001) -> Column:
    """Reflected 16-bit checksum of bytes, bit by bit: a byte enters, eight shifts (-1) follow."""
    shift = F.lit(-1).cast("long")
    steps = F.flatten(F.transform(byte_codes(data), lambda b: F.array(b, *[shift] * 8)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda h, x: F.when(x >= 0, h.bitwiseXOR(x)).otherwise(F.shiftright(h, 1).bitwiseXOR(h.bitwiseAND(F.lit(1)) * poly)))


def jamcrc(data: Column) -> Column:
    """CRC-32 without its last inversion."""
    return F.crc32(data).bitwiseXOR(F.lit(LOW32))


def xored(data: Column, key: int) -> Column:
    """Bytes XORed with a one-byte key, as hexadecimal digits; twice gives the bytes back."""
    return F.array_join(F.transform(byte_codes(data), lambda b: F.lpad(F.hex(b.bitwiseXOR(F.lit(key))), 2, "0")), "")


def byte_swapped(data: Column) -> Column:
    """Each pair of bytes swapped, as hexadecimal digits; an odd last byte stays."""
    return F.regexp_replace(F.hex(data), "(..)(..)", "$2$1")


def stem(path: Column) -> Column:
    """Last component without its extension; leading dots belong to the stem."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    cut = F.regexp_extract(base, r"^(\.*[^.].*?)\.[^.]*$", 1)
    return F.when(cut == "", base).otherwise(cut)


def top_dir(path: Column) -> Column:
    """First component of a path that has several, else `(root)`."""
    return F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("(root)")


def unescaped(text: Column) -> Column:
    """The five named entities decoded, the ampersand last, so that nothing is decoded twice."""
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(value))
    return text


def tag_census(df: DataFrame, markup: str, key: str) -> DataFrame:
    """Tags by name, misspelt and unclosed ones too, for they are found by pattern."""
    tags = df.select(key, F.explode(F.regexp_extract_all(markup, F.lit("<(/?[A-Za-z][A-Za-z0-9]*)"), 1)).alias("tag"))
    return tags.groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"), F.count_distinct(key).alias("pages"))


def token_kinds(df: DataFrame, text: str) -> DataFrame:
    """Tokens of lines: quoted, in brackets, or bare."""
    tokens = df.select(F.explode(F.regexp_extract_all(text, F.lit(r'("[^"]*"|\([^)]*\)|[^ \t\n]+)'), 1)).alias("tok"))
    kind = F.when(F.substring("tok", 1, 1) == '"', "quoted").when(F.substring("tok", 1, 1) == "(", "grouped").otherwise("bare")
    return tokens.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("tok").alias("distinct_tokens"))


def verb_deltas(df: DataFrame, text: str, side: str, a: str, b: str) -> DataFrame:
    """First words of lines that two sides use unequally often."""
    lines = df.select(side, F.explode(F.split(text, "\n")).alias("line")).where(F.trim("line") != "")
    by = lines.groupBy(F.substring_index("line", " ", 1).alias("verb")).agg(F.count_if(F.col(side) == a).alias("a"), F.count_if(F.col(side) == b).alias("b"))
    return by.where("a <> b").withColumn("delta", F.col("a") - F.col("b"))


def terminated_names(data: Column, least: int = 6, most: int = 64) -> Column:
    """Printable names that a NUL ends, of `least` to `most` characters; of a longer run the last `most` before the NUL."""
    return F.regexp_extract_all(data, F.lit(f"([ -~]{{{least},{most}}})\\x00"), F.lit(1))


def version_free(name: Column) -> Column:
    """A disc's file name without its version (`;1`) and the dot that a missing extension leaves."""
    return F.regexp_replace(F.regexp_replace(name, ";[0-9]+$", ""), r"\.$", "")
