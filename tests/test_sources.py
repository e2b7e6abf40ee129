"""Sources and decoders on hand-built bytes; half of the decoder cases must refuse."""

import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quern.functions import checks, text
from quern.sources import files


def png(width=2, height=3):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"x")) + chunk(b"IEND", b"")


def riff():
    body = b"WAVE" + b"fmt " + struct.pack("<I", 3) + b"abc\x00" + b"LIST" + struct.pack("<I", 14) + b"INFO" + b"name" + struct.pack("<I", 2) + b"hi"
    return b"RIFF" + struct.pack("<I", len(body)) + body


def mp4():
    inner = struct.pack(">I4s", 12, b"mvhd") + b"abcd"
    return struct.pack(">I4s", 12, b"ftyp") + b"isom" + struct.pack(">I4s", 8 + len(inner), b"moov") + inner


def midi(n=2):
    return b"MThd\x00\x00\x00\x06" + struct.pack(">HHH", 1, n, 96) + 2 * (b"MTrk" + struct.pack(">I", 3) + b"\x00\xff\x2f")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("b/c.txt", "")
    return out.getvalue()


def test_accepts():
    assert files.png_chunks(png()) == (2, 3, 8, 2, ["IHDR", "IDAT", "IEND"])
    assert [(k, d) for _, _, k, d in files.riff_tree(riff())] == [("fmt ", 0), ("LIST", 0), ("name", 1)]
    assert [(k, d) for _, _, k, d in files.mp4_boxes(mp4())] == [("ftyp", 0), ("moov", 0), ("mvhd", 1)]
    assert files.midi_tracks(midi()) == (1, 2, 96, 2)
    assert [(m[0], m[1]) for m in files.zip_members(zipped())] == [("a.txt", 5), ("b/c.txt", 0)]


@pytest.mark.parametrize("f,good", [(files.png_chunks, png), (files.riff_tree, riff), (files.mp4_boxes, mp4), (files.midi_tracks, midi)])
@pytest.mark.parametrize("cut", [lambda b: b[:-1], lambda b: b + b"\x00", lambda b: b"\x01" + b[1:]])
def test_refuses(f, good, cut):
    with pytest.raises(ValueError):
        f(cut(good()))


def test_png_bit_flip():
    b = bytearray(png())
    b[20] ^= 1
    with pytest.raises(ValueError, match="CRC"):
        files.png_chunks(bytes(b))


def test_decode_keeps_refusals(spark):
    rows = [("a", png()), ("b", png()[:-1]), ("c", zipped()), ("d", b"plain"), ("e", b"\xff\xfe\x00")]
    got = {r.label: r for r in files.decode(spark.createDataFrame([Row(label=a, content=bytearray(b)) for a, b in rows])).collect()}
    assert {k: r.kind for k, r in got.items()} == {"a": "png", "b": "png", "c": "zip", "d": "text", "e": "opaque"}
    assert got["a"].error is None and "ValueError" in got["b"].error and got["c"].parts == 2


def test_chunks_count_seams_once(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"aaab" * 10)
    spark.dataSource.register(files.ChunkSource)
    d = spark.read.format("chunks").option("path", str(tmp_path)).option("block", 7).option("overlap", 3).load()
    assert files.needle_in_chunks(d, b"aab", 7).first().hits == 10
    assert files.needle_in_chunks(d, b"aa", 7).first().hits == 20
    same = files.chunked(spark.createDataFrame([("x", b"aaaaa")], "path string, content binary"), 3, 1)
    assert files.needle_in_chunks(same, b"aa", 3).first().hits == 4
    assert [bytes(r.bytes) for r in files.chunked(spark.createDataFrame([("e", b""), ("f", b"abcdef")], "path string, content binary"), 3).collect()] == [b"", b"abc", b"def"]
    head = spark.read.format("chunks").option("path", str(tmp_path)).option("block", 7).option("head", "true").load().collect()
    assert len(head) == 1 and head[0].size == 40 and len(head[0].bytes) == 7


def test_trees_and_lists(spark, tmp_path):
    (tmp_path / "l.txt").write_text("da39a3ee5e6b4b0d3255bfef95601890afd80709  12  a b.txt\nnonsense\n")
    got = files.hash_list(spark, str(tmp_path / "l.txt")).collect()
    assert (got[0].size, got[0].path, got[1].sha1) == (12, "a b.txt", None)
    assert files.tokens40(spark, str(tmp_path / "l.txt")).count() == 1
    assert files.tree(spark, str(tmp_path)).first().size > 0
    files.write_tsv(spark.range(3), str(tmp_path / "t"))
    assert files.tsv(spark, str(tmp_path / "t"), "id long").count() == 3


def test_names_and_checks(spark):
    d = spark.createDataFrame([("a/b.TXT",), (".bashrc",), ("x",), ("a/.x.gz",)], "p string")
    assert [r[0] for r in d.select(text.extension(F.col("p"))).collect()] == [".txt", "(none)", "(none)", ".gz"]
    with pytest.raises(checks.Refused):
        checks.require_non_empty(d.where("false"), "nothing")
    with pytest.raises(checks.Refused):
        checks.expect(d, 3, "rows")
    checks.require_zero(spark.createDataFrame([(0,)], "residue int"), "residue", "sum")


def test_streams(spark, tmp_path):
    from quern.streaming import arrivals

    src = spark.createDataFrame([("2024-01-01 00:00:00", "a"), ("2024-01-01 00:30:00", "a"), ("2024-01-01 02:00:00", "a"), ("2024-01-02 00:00:00", "b")], "ts string, k string").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    for name, make in (("census", lambda s: arrivals.arrival_census(s, "ts", "k")), ("waves", lambda s: arrivals.streaming_waves(s, "ts", "k"))):
        q = make(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        got = spark.table(name).where("k = 'a'").collect()
        assert len(got) == 2, got
