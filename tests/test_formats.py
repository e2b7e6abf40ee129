"""Further decoders on hand-built bytes: each accepts a good content and refuses it shortened or with a byte added."""

import struct
from datetime import datetime

import pytest

from quern.sources import files
from quern.sources import formats as f


def bmp():
    pixels = bytes(8 * 2)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + len(pixels), 0, 54, 40, 2, -2, 1, 24, 0, 0, 0, 0, 0, 0) + pixels


def icon():
    entry = lambda w, at, n: struct.pack("<BBBBHHII", w, w, 0, 0, 1, 32, n, at)
    return struct.pack("<HHH", 0, 1, 2) + entry(16, 42, 4) + entry(0, 38, 4) + bytes(8)


def pcx(palette=False):
    head = struct.pack("<BBBBHHHHHH", 10, 5, 1, 8, 0, 0, 3, 1, 72, 72) + bytes(48) + bytes([0, 1]) + struct.pack("<H", 4) + bytes(60)
    return head + bytes([0xC4, 7, 1, 2, 0xC2, 9]) + (b"\x0c" + bytes(768) if palette else b"")


def psd(packed=0):
    head = struct.pack(">4sH6sHIIHH", b"8BPS", 1, bytes(6), 3, 2, 5, 8, 3) + struct.pack(">I", 0) + struct.pack(">I", 2) + b"xx" + struct.pack(">I", 0)
    return head + struct.pack(">H", packed) + (struct.pack(">6H", *[1] * 6) + bytes(6) if packed else bytes(30))


def flic(frames=2):
    body = struct.pack("<IH", 8, 0xF100) + b"ab"
    for _ in range(frames + 1):
        body += struct.pack("<IHHQ", 16, 0xF1FA, 0, 0)
    return struct.pack("<IHHHH", 128 + len(body), 0xAF12, frames, 320, 200) + bytes(116) + body


def pak():
    table = struct.pack("<HIHIHI", 7, 34, 9, 37, 0, 39)
    return struct.pack("<IBBBBHH", 5, 1, 0, 0, 0, 2, 1) + table + struct.pack("<HH", 11, 0) + b"abcde"


def cabinet():
    name = struct.pack("<IIHHHH", 5, 0, 0, (2001 - 1980) << 9 | 2 << 5 | 3, 4 << 11 | 5 << 5 | 3, 0) + b"a.txt\0"
    data = 36 + 8 + len(name)
    size = data + 8 + 5
    head = struct.pack("<4sIIIIIBBHHHHH", b"MSCF", 0, size, 0, 44, 0, 3, 1, 1, 1, 0, 0, 0)
    return head + struct.pack("<IHH", data, 1, 0) + name + struct.pack("<IHH", 0, 5, 5) + b"hello"


def compound(size=600):
    def entry(name, kind, child, start, n):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw + bytes(64 - len(raw)) + struct.pack("<HBBIII", len(raw), kind, 1, f.FREE, f.FREE, child) + bytes(36) + struct.pack("<IQ", start, n)

    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<8I", 1, 1, 0, 100, f.END, 0, f.END, 0) + struct.pack("<109I", 0, *[f.FREE] * 108)
    fat = struct.pack("<128I", 0xFFFFFFFD, f.END, 3, f.END, *[f.FREE] * 124)
    folder = entry("Root Entry", 5, 1, f.END, 0) + entry("Store", 1, 2, 0, 0) + entry("Data", 2, f.FREE, 2, size) + bytes(128)
    return head + fat + folder + bytes(1024)


GOOD = [(f.bmp_header, bmp), (f.icon_images, icon), (f.pcx_picture, pcx), (f.psd_header, psd), (f.flic_frames, flic), (f.pak_resources, pak), (f.cabinet_members, cabinet)]


def test_accepts():
    assert f.bmp_header(bmp()) == (2, 2, 24)
    assert f.icon_images(icon()) == [(16, 16, 32, 42, 4), (256, 256, 32, 38, 4)]
    assert f.pcx_picture(pcx()) == (4, 2, 8, 1, False) and f.pcx_picture(pcx(True)) == (4, 2, 8, 1, True)
    assert f.psd_header(psd()) == f.psd_header(psd(1)) == (5, 2, 3, 8, 3)
    assert f.flic_frames(flic()) == (320, 200, 2, 3)
    assert f.pak_resources(pak()) == [(7, 34, 3), (9, 37, 2)]
    assert f.cabinet_members(cabinet()) == [("a.txt", 5, 0, datetime(2001, 2, 3, 4, 5, 6))]
    assert f.compound_entries(compound()) == [("/Store", "storage", 0), ("/Store/Data", "stream", 600)]


@pytest.mark.parametrize("decoder,good", GOOD)
def test_refuses_shortened_and_added(decoder, good):
    for bad in (good()[:-1], good() + b"\x01", b"", good()[:9]):
        with pytest.raises(ValueError):
            decoder(bad)


def test_compound_refuses():
    with pytest.raises(ValueError, match="does not hold"):
        f.compound_entries(compound(1100))
    with pytest.raises(ValueError, match="past the end"):
        f.compound_entries(compound()[:700])
    assert f.dos_stamp(0, 0) is None


def test_registry(spark):
    rows = [("c", cabinet()), ("o", compound()), ("p", psd()), ("bad", psd()[:-1])]
    got = {r.label: r for r in files.decode(spark.createDataFrame([(a, bytearray(b)) for a, b in rows], "label string, content binary")).collect()}
    assert {k: r.kind for k, r in got.items()} == {"c": "cabinet", "o": "ole2", "p": "psd", "bad": "psd"}
    assert [k for k, r in got.items() if r.error] == ["bad"]
