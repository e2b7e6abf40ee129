"""Checksums, byte operations, diffs, edits, links, runs and clocks by published values and plain loops."""

import bz2
import lzma
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import checks, text
from quern.operators import clocks, relations, search, similarity
from quern.sources import decoders, files


def one(spark, column, value="123456789"):
    return spark.createDataFrame([(value,)], "s string").select(F.encode("s", "UTF-8").alias("b")).select(column(F.col("b"))).first()[0]


def test_checksums_by_published_values(spark):
    assert one(spark, F.crc32) == 0xCBF43926 and one(spark, text.jamcrc) == 0x340BC6D9
    assert one(spark, text.crc16) == 0xBB3D and one(spark, text.crc16, "") == 0
    assert one(spark, lambda b: text.crc16(b, 0x8408)) == 0x2189


def test_xor_and_swap(spark):
    data = "aé日\x00z"
    assert one(spark, lambda b: text.xored(b, 90), data) == bytes(x ^ 90 for x in data.encode()).hex().upper()
    assert one(spark, text.byte_swapped, "abcde") == b"badce".hex().upper()
    assert one(spark, text.byte_swapped, "") == "" and one(spark, text.byte_swapped, None) is None


def test_stem_and_top(spark):
    paths = ["a/b/c.txt", "c.tar.gz", ".profile", "a/.x.y", "a/", ""]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(text.stem(F.col("p")), text.top_dir(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("c", "a"), ("c.tar", "(root)"), (".profile", "(root)"), (".x", "a"), ("", "a"), ("", "(root)")]


def islands(a, b):
    a, b = (a or "").encode(), (b or "").encode()
    marks = "".join("x" if a[i : i + 1] != b[i : i + 1] else "=" for i in range(max(len(a), len(b))))
    return [(m.start(), len(m.group())) for m in re.finditer("x+", marks)]


def test_byte_diffs(spark):
    pairs = [("abc", "abc"), ("abc", "xbz"), ("", "ab"), (None, "a"), (None, None), ("aébc", "aèbc"), ("abcdef", "abXY"), ("same" * 5000 + "x", "same" * 5000 + "y")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "k int, a string, b string")
    got = sorted(tuple(r) for r in similarity.byte_diffs(rows, "k", "a", "b").collect())
    assert got == [(i, at, n) for i, (a, b) in enumerate(pairs) for at, n in islands(a, b)]
    assert similarity.byte_diffs(rows.limit(0), "k", "a", "b").count() == 0


def test_edit_classes(spark):
    kinds = "k int, word string, n int"
    old = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 1), (4, None, 1), (5, "a", 1), (7, None, None)], kinds)
    new = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "b", 2), (4, "a", 1), (6, "a", 1), (7, None, None)], kinds)
    got = {r.k: r.verdict for r in relations.edit_classes(old, new, "k").collect()}
    assert got == {1: "same", 2: "translation", 3: "structure", 4: "structure", 5: "removed", 6: "added", 7: "same"}


def test_novel_runs_are_cut_by_known_grams(spark):
    run = [f"w{i}" for i in range(30)]
    frame = lambda name, rows: spark.createDataFrame(rows, f"{name} int, text string")
    a = frame("a", [(1, "x " + " ".join(run) + " y"), (2, " ".join(run)), (3, None), (4, "short")])
    b = frame("b", [(9, "q " + " ".join(run))])
    none = frame("c", [(0, None)])
    got = similarity.novel_runs(a, "a", b, "b", none, "c", "text").collect()
    assert [(r.words, r.places, r.texts) for r in got] == [(30, 2, 2)]
    known = frame("c", [(0, " ".join(run[10:18]))])
    cut = similarity.novel_runs(a, "a", b, "b", known, "c", "text").collect()
    assert sorted((r.words, r.places) for r in cut) == [(17, 2), (19, 2)]


def test_links_runs_and_wide_needles(spark):
    page = """<a href="/x?q=1#t">see http://bare.example/p?q</a><img src='pic.png'> <a title="http://no.example">t</a>"""
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, t string")
    assert sorted(map(tuple, search.links(rows, "t").collect())) == [("attribute", "/x"), ("attribute", "pic.png"), ("bare", "http://bare.example/p")]
    text_rows = spark.createDataFrame([(1, "abc\ndefghé12345"), (2, None), (3, "")], "k int, t string")
    assert sorted(map(tuple, search.runs_at(text_rows, "k", "t", 4).collect())) == [(1, 4, 5), (1, 10, 5)]
    wide = spark.createDataFrame([("the éthe",), (None,)], "t string")
    got = {(r.needle, r.form): r.hits for r in search.wide_counts(wide, "t", ["the", "no"]).collect()}
    assert got == {("the", "narrow"): 2, ("the", "wide"): 2, ("no", "narrow"): 0, ("no", "wide"): 0}


def test_clock_readings(spark):
    # 2020-02-29 12:34:56 packed as a DOS date and time; the same with day 30, month 0, and numbers no reader takes
    dos = (40 << 25) + (2 << 21) + (29 << 16) + (12 << 11) + (34 << 5) + 28
    rows = spark.createDataFrame([(dos,), (dos + (1 << 16),), (dos - (2 << 21),), (1582979696,), (132274532960000000,), (-1,), (None,)], "v long")
    got = {(r.v, r.reader): r.seconds for r in clocks.clock_readings(rows, "v").collect()}
    assert got[(dos, "dos")] == got[(1582979696, "unix")] == got[(132274532960000000, "filetime")] == 1582979696
    assert (dos + (1 << 16), "dos") not in got and (dos - (2 << 21), "dos") not in got
    assert not [k for k in got if k[0] in (-1, None)]


def test_owned_against_a_plain_count(spark):
    draw = random.Random(5)
    claims = [(draw.randrange(3), (lo := draw.randrange(60)), lo + draw.randrange(-2, 15), draw.choice("ABX")) for _ in range(120)]
    claims += claims[:20] + [(0, None, 5, "A"), (0, 1, 9, None), (None, 3, 6, "B")]
    want = {}
    for file in (None, 0, 1, 2):
        for place in range(80):
            over = {c for f, lo, hi, c in claims if f == file and lo is not None and lo <= place < hi and c in ("B", "A")}
            if over:
                k = (file, "B" if "B" in over else "A")
                want[k] = want.get(k, 0) + 1
    rows = spark.createDataFrame(claims, "f int, lo int, hi int, c string")
    assert {(r.f, r.owner): r.bytes for r in relations.owned(rows, "f", "lo", "hi", "c", ["B", "A"]).collect()} == want
    assert relations.owned(rows.limit(0), "f", "lo", "hi", "c", ["B", "A"]).count() == 0


@pytest.mark.parametrize("pack, read", [(bz2.compress, decoders.bzip2_content), (lzma.compress, decoders.xz_content)])
def test_packed_contents(pack, read):
    data = b"abc" * 2_000_000
    assert read(pack(data)) == (1, len(data)) and read(pack(b"ab") + pack(b"") + pack(b"c")) == (3, 3)
    for bad in (b"", pack(data)[:-1], pack(data) + b"rest", b"junk"):
        with pytest.raises(ValueError):
            read(bad)


def test_packed_contents_are_classified_and_refused_by_name(spark):
    rows = [("b", bz2.compress(b"abc")), ("x", lzma.compress(b"abcd")), ("cut", bz2.compress(b"abc")[:-2]), ("t", b"BZ text")]
    got = {r.label: (r.kind, r.detail, r.error) for r in files.decode(spark.createDataFrame(rows, "label string, content binary")).collect()}
    assert got["b"] == ("bzip2", "(1, 3)", None) and got["x"] == ("xz", "(1, 4)", None) and got["t"][0] == "text"
    assert got["cut"][0] == "bzip2" and got["cut"][2] == "ValueError: ends inside a member"


def test_controls_from_the_data(spark):
    rows = spark.createDataFrame([("aaaa bbbb bbbb",), ("cats cats, dog dog dog",), (None,)], "t string")
    needles = checks.derived_needles(rows, "t", 7)
    assert needles["must_hit"] == "cats" and sorted(needles["must_miss"]) == sorted("cats")
    assert sorted(checks.seeded_order(50, 7)) == list(range(50)) and checks.seeded_order(50, 7) != checks.seeded_order(50, 8)
    with pytest.raises(checks.Refused):
        checks.derived_needles(rows.limit(0), "t", 7)


def test_separation_in_a_given_order(spark):
    vectors = [(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 4.0]), (2, [9.0, 9.0, 9.0])]
    rows = spark.createDataFrame(vectors, "k int, v array<double>")
    got = similarity.separation(rows.where("k = 0"), rows, "k", "v", order=[2, 0, 1]).first()
    assert (got.mad, got.control, got.separates) == (round(1 / 3, 6), round((3 + 1 + 1) / 3, 6), True)


def test_terminated_names_and_versions(spark):
    rows = spark.createDataFrame([("abcdef\0abc\0" + "x" * 70 + "\0open ended",), (None,), ("",)], "s string")
    assert [r[0] for r in rows.select(text.terminated_names(F.col("s"))).collect()] == [["abcdef", "x" * 64], None, []]
    names = spark.createDataFrame([("READ.ME;1",), ("README.;12",), ("a;b",), (None,)], "s string")
    assert [r[0] for r in names.select(text.version_free(F.col("s"))).collect()] == ["READ.ME", "README", "a;b", None]


def test_set_sizes(spark):
    from quern.operators import census

    a, b = (spark.createDataFrame([(k,) for k in keys], "k int") for keys in ((1, 1, 2, None), (2, 3, 3, None)))
    assert tuple(census.set_sizes(a, b, "k").first()) == (2, 2, 1, 3, 0)
    assert tuple(census.set_sizes(a.limit(0), b.limit(0), "k").first()) == (0, 0, 0, 0, 0)
