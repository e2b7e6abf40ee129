"""Decoders on hand-built bytes: each accepts a good content and refuses the same one damaged."""

import gzip
import struct

import pytest

from quern.functions import checks
from quern.operators import search
from quern.sources import decoders as d
from quern.sources import files


def wave(frames=10):
    fmt = struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16)
    body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", 4 * frames) + bytes(4 * frames)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def tga():
    return struct.pack("<BBBHHBHHHHBB", 2, 0, 2, 0, 0, 0, 0, 0, 3, 2, 24, 0) + b"id" + bytes(18)


def ogg(n=2):
    out = b""
    for i in range(n):
        page = struct.pack("<4sBBqIII", b"OggS", 0, 0, 5 * i, 7, i, 0) + b"\x02\x03\x04" + b"abcdefg"
        out += page[:22] + struct.pack("<I", d.ogg_crc(page)) + page[26:]
    return out


def pe():
    head = bytearray(b"MZ" + bytes(62))
    head[60:64] = struct.pack("<I", 64)
    optional = struct.pack("<H", 0x10B) + bytes(90) + struct.pack("<I", 16) + bytes(16 * 8)
    coff = b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, len(optional), 0)
    where = 64 + len(coff) + len(optional) + 40
    return bytes(head) + coff + optional + struct.pack("<8sIIII", b".text", 8, 4096, 8, where) + bytes(16) + bytes(8)


def iso():
    def record(name, lba, size, flags):
        n = 33 + len(name) + (1 - len(name) % 2)
        r = struct.pack("<BBI", n, 0, lba) + struct.pack(">I", lba) + struct.pack("<I", size) + struct.pack(">I", size) + bytes([100, 2, 3, 4, 5, 6, 4, flags, 0, 0]) + bytes(4) + bytes([len(name)]) + name
        return r + bytes(n - len(r))

    pvd = bytearray(2048)
    pvd[:6] = b"\1CD001"
    pvd[128:130] = struct.pack("<H", 2048)
    root = record(b"\0", 17, 2048, 2)
    pvd[156 : 156 + len(root)] = root
    folder = root + record(b"\1", 17, 2048, 2) + record(b"SUB", 18, 2048, 2) + record(b"A.TXT;1", 19, 5, 0)
    sub = record(b"\0", 18, 2048, 2) + record(b"\1", 17, 2048, 2) + record(b"B.TXT;1", 19, 2048, 0)
    pad = lambda b: b + bytes(2048 - len(b))
    return bytes(32768) + bytes(pvd) + pad(folder) + pad(sub) + pad(b"hello")


GOOD = [(d.wave_info, wave), (d.tga_header, tga), (d.ogg_pages, ogg), (d.pe_sections, pe), (d.iso9660_records, iso), (d.gzip_content, lambda: gzip.compress(b"hello", mtime=0)), (d.msgpack_value, lambda: b"\x82\xa1a\x93\x01\xff\xc0\xa1b\xcd\x01\x00")]


def test_accepts():
    assert d.wave_info(wave()) == (1, 8000, 2, 10, 10 / 8000)
    assert d.tga_header(tga()) == (3, 2, 24)
    assert d.ogg_pages(ogg()) == [(7, 0, 0, 7), (7, 1, 5, 7)]
    assert d.pe_sections(pe()) == [(".text", 4096, len(pe()) - 8, 8, False)]
    got = d.iso9660_records(iso())
    assert [r[:3] for r in got] == [("/A.TXT", 19, 5), ("/SUB/B.TXT", 19, 2048)] and got[0][3].isoformat() == "2000-02-03T04:05:06+01:00"
    assert d.gzip_content(gzip.compress(b"hello") * 2) == (2, 10)
    assert d.msgpack_value(b"\x82\xa1a\x93\x01\xff\xc0\xa1b\xcd\x01\x00") == [("a", [1, -1, None]), ("b", 256)]


@pytest.mark.parametrize("f,good", GOOD)
def test_refuses_shortened(f, good):
    with pytest.raises(ValueError):
        f(good()[:-1])


@pytest.mark.parametrize("f,good", [g for g in GOOD if g[0] not in (d.pe_sections, d.iso9660_records)])
def test_refuses_bytes_left(f, good):
    with pytest.raises(ValueError):
        f(good() + b"\x01")


def test_ogg_checksum():
    b = bytearray(ogg())
    b[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        d.ogg_pages(bytes(b))


def test_text_codecs(spark):
    cases = {"plain\n": "ascii", "für　weit": "utf-8", "zero​width": None}
    for s, codec in cases.items():
        assert (d.text_codec_of(s.encode()) == codec) or (codec is None and d.text_codec_of(s.encode()) != "utf-8")
    assert d.text_codec_of("日本語".encode("cp932")) == "cp932" and d.text_codec_of(b"\x00\x01") is None
    df = spark.createDataFrame([(bytearray(b"abc"),), (None,)], "content binary")
    assert [r[0] for r in df.select(d.text_codec("content")).collect()] == ["ascii", None]


def test_decode_registry(spark):
    rows = [("w", wave()), ("o", ogg()), ("i", iso()), ("p", pe()), ("z", gzip.compress(b"x")), ("bad", ogg()[:-1])]
    got = {r.label: r for r in files.decode(spark.createDataFrame([(a, bytearray(b)) for a, b in rows], "label string, content binary")).collect()}
    assert {k: r.kind for k, r in got.items()} == {"w": "wave", "o": "ogg", "i": "iso9660", "p": "pe", "z": "gzip", "bad": "ogg"}
    assert [k for k, r in got.items() if r.error] == ["bad"]


def test_diff_runs_needles_and_exclusions(spark):
    assert d.diff_runs(b"abcdef", b"aXcdYZ!") == [(1, 1), (4, 2)] and d.diff_runs(b"", b"x") == []
    needles = search.encoded_needles(["abc", "é"])
    assert ("abc", "utf-8|cp1252", b"abc") in needles and len([n for n in needles if n[0] == "é"]) == 4
    df = spark.createDataFrame([("a",), ("b",), (None,)], "p string")
    assert checks.without(df, "p", ["a"]).count() == 2
    with pytest.raises(checks.Refused):
        checks.without(df, "p", ["a", "zzz"])
