"""Decoders of whole contents: each returns what the format declares, or raises ValueError where it doesn't close."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def need(ok: bool, why: str) -> None:
    if not ok:
        raise ValueError(why)


def field(form: str, content: bytes, at: int) -> tuple:
    need(0 <= at and at + struct.calcsize(form) <= len(content), f"field at {at} past the end")
    return struct.unpack_from(form, content, at)


def wave_info(content: bytes) -> tuple[int, int, int, int, float]:
    """(codec, rate, channels, frames, seconds) of a RIFF WAVE whose tree closes and whose data is whole frames."""
    from quern.sources.files import riff_tree

    chunks = {name: (at + 8, size) for at, size, name, depth in reversed(riff_tree(content)) if depth == 0}
    need(content[8:12] == b"WAVE" and {"fmt ", "data"} <= set(chunks), "no fmt or data chunk")
    codec, channels, rate, _, align = field("<HHIIH", content, chunks["fmt "][0])
    need(align > 0 and rate > 0 and chunks["data"][1] % align == 0, "data is not whole frames")
    frames = chunks["data"][1] // align
    return codec, rate, channels, frames, frames / rate


def tga_header(content: bytes) -> tuple[int, int, int]:
    """(width, height, bits) of an uncompressed picture: header, identifier, palette and pixels, with or without the footer."""
    ident, mapped, kind, _, entries, entry_bits = field("<BBBHHB", content, 0)
    width, height, bits = field("<HHB", content, 12)
    need(kind in (1, 2, 3) and mapped in (0, 1) and width > 0 and height > 0 and bits in (8, 15, 16, 24, 32), "no plain picture")
    end = 18 + ident + (entries * ((entry_bits + 7) // 8) if mapped else 0) + width * height * ((bits + 7) // 8)
    left = len(content) - end
    need(left == 0 or (left == 26 and content[-18:-2] == b"TRUEVISION-XFILE"), f"residue {left}")
    return width, height, bits


def _ogg_table() -> list[int]:
    out = []
    for i in range(256):
        r = i << 24
        for _ in range(8):
            r = (r << 1 ^ (0x04C11DB7 if r & 1 << 31 else 0)) & 0xFFFFFFFF
        out.append(r)
    return out


OGG_TABLE = _ogg_table()


def ogg_crc(page: bytes) -> int:
    r = 0
    for b in page:
        r = (r << 8 & 0xFFFFFFFF) ^ OGG_TABLE[r >> 24 ^ b]
    return r


def ogg_pages(content: bytes) -> list[tuple[int, int, int, int]]:
    """(serial, number, granule, payload bytes) of pages; each checksum is taken with its own field zeroed."""
    out, at = [], 0
    while at < len(content):
        magic, version, _, granule, serial, number, crc, n = field("<4sBBqIIIB", content, at)
        need(magic == b"OggS" and version == 0, f"residue {len(content) - at}")
        body = sum(content[at + 27 : at + 27 + n])
        end = at + 27 + n + body
        need(end <= len(content), "page past the end")
        need(ogg_crc(content[at : at + 22] + bytes(4) + content[at + 26 : end]) == crc, f"checksum of page {number}")
        out.append((serial, number, granule, body))
        at = end
    return out


def pe_sections(content: bytes) -> list[tuple[str, int, int, int, bool]]:
    """(section, address, raw offset, raw size, managed) of a program; sections must lie in the file."""
    need(content[:2] == b"MZ", "no program")
    (at,) = field("<I", content, 60)
    magic, _, count, _, _, _, extra = field("<4sHHIIIH", content, at)
    need(magic == b"PE\0\0", "no PE signature")
    (kind,) = field("<H", content, at + 24)
    need(kind in (0x10B, 0x20B), "optional header")
    first = at + 24 + (96 if kind == 0x10B else 112)
    (directories,) = field("<I", content, first - 4)
    managed = directories > 14 and field("<I", content, first + 14 * 8)[0] != 0
    out = []
    for i in range(count):
        name, _, address, size, where = field("<8sIIII", content, at + 24 + extra + 40 * i)
        need(where + size <= len(content), f"section {name!r} past the end")
        out.append((name.rstrip(b"\0").decode("latin-1"), address, where, size, managed))
    return out


def gzip_content(content: bytes) -> tuple[int, int]:
    """(members, bytes) of a gzip file; checksum and length of each member are checked, and nothing may follow."""
    members = size = 0
    while content:
        z = zlib.decompressobj(31)
        try:
            size += len(z.decompress(content))
        except zlib.error as e:
            raise ValueError(str(e)) from None
        need(z.eof, "ends inside a member")
        members, content = members + 1, z.unused_data
    return members, size


def _unpacked(content: bytes, start, bad) -> tuple[int, int]:
    """(members, bytes) of members laid end to end, unpacked a megabyte at a time; a cut member or bytes left over refuse it."""
    members = size = 0
    need(len(content) > 0, "nothing to unpack")
    while content:
        z = start()
        try:
            size += len(z.decompress(content, 1 << 20))
            while not z.eof and not z.needs_input:
                size += len(z.decompress(b"", 1 << 20))
        except bad as e:
            raise ValueError(str(e)) from None
        need(z.eof, "ends inside a member")
        members, content = members + 1, z.unused_data
    return members, size


def bzip2_content(content: bytes) -> tuple[int, int]:
    return _unpacked(content, bz2.BZ2Decompressor, (OSError, EOFError))


def xz_content(content: bytes) -> tuple[int, int]:
    """Streams of an .xz or .lzma content."""
    return _unpacked(content, lzma.LZMADecompressor, (lzma.LZMAError, EOFError))


def msgpack_value(content: bytes):
    """The one value that a MessagePack content holds; bytes left over refuse it."""

    def take(at: int, n: int) -> tuple[bytes, int]:
        need(at + n <= len(content), "value past the end")
        return content[at : at + n], at + n

    def number(form: str, at: int):
        return field(">" + form, content, at)[0], at + struct.calcsize(form)

    def items(at: int, n: int):
        out = []
        for _ in range(n):
            v, at = value(at)
            out.append(v)
        return out, at

    def pairs(at: int, n: int):
        flat, at = items(at, 2 * n)
        return list(zip(flat[::2], flat[1::2])), at

    def value(at: int):
        (b,), at = take(at, 1)
        if b < 0x80 or b >= 0xE0:
            return b - 256 * (b >= 0xE0), at
        if b < 0x90:
            return pairs(at, b & 15)
        if b < 0xA0:
            return items(at, b & 15)
        if b < 0xC0:
            raw, at = take(at, b & 31)
            return raw.decode(), at
        if b in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[b], at
        if 0xCA <= b <= 0xD3:
            return number("fdBHIQbhiq"[b - 0xCA], at)
        need(b != 0xC1, "unused type byte")
        if 0xD4 <= b <= 0xD8:
            raw, at = take(at, 1 + (1 << b - 0xD4))
            return (raw[0], raw[1:]), at
        kind, width = {0xC4: ("bin", "B"), 0xC5: ("bin", "H"), 0xC6: ("bin", "I"), 0xC7: ("ext", "B"), 0xC8: ("ext", "H"), 0xC9: ("ext", "I"), 0xD9: ("str", "B"), 0xDA: ("str", "H"), 0xDB: ("str", "I"), 0xDC: ("items", "H"), 0xDD: ("items", "I"), 0xDE: ("pairs", "H"), 0xDF: ("pairs", "I")}[b]
        n, at = number(width, at)
        if kind in ("items", "pairs"):
            return items(at, n) if kind == "items" else pairs(at, n)
        raw, at = take(at, n + (kind == "ext"))
        return raw.decode() if kind == "str" else (raw[0], raw[1:]) if kind == "ext" else raw, at

    got, end = value(0)
    need(end == len(content), f"residue {len(content) - end}")
    return got


def iso9660_records(content: bytes) -> list[tuple[str, int, int, datetime | None]]:
    """(path, sector, bytes, recorded time) of an image's files, by walking its directories; extents must lie in the image."""
    need(content[32769:32774] == b"CD001", "no volume descriptor")
    (sector,) = field("<H", content, 32768 + 128)
    need(sector > 0, "sector size")
    out, seen = [], set()
    todo = [("", *field("<I", content, 32768 + 156 + 2), *field("<I", content, 32768 + 156 + 10))]
    while todo:
        folder, lba, size = todo.pop()
        if lba in seen:
            continue
        seen.add(lba)
        at, end = lba * sector, lba * sector + size
        need(end <= len(content), f"directory {folder or '/'} past the end")
        while at < end:
            n = content[at]
            if n == 0:  # records don't cross sectors
                at = (at // sector + 1) * sector
                continue
            (where,), (length,) = field("<I", content, at + 2), field("<I", content, at + 10)
            (flags,), (chars,) = field("<B", content, at + 25), field("<B", content, at + 32)
            name = content[at + 33 : at + 33 + chars]
            need(n >= 33 + chars, "record length")
            if name not in (b"\0", b"\1"):
                path = f"{folder}/{name.decode('latin-1').split(';')[0]}"
                need(where * sector + length <= len(content), f"{path} past the end")
                if flags & 2:
                    todo.append((path, where, length))
                else:
                    out.append((path, where, length, _recorded(content[at + 18 : at + 25])))
            at += n
    return sorted(out, key=lambda r: r[0])


def _recorded(raw: bytes) -> datetime | None:
    """Seven bytes: years since 1900 to seconds, and the zone in quarter hours; null if it is no date."""
    year, month, day, hour, minute, second = raw[:6]
    quarter = struct.unpack("b", raw[6:7])[0]
    try:
        return datetime(1900 + year, month, day, hour, minute, second, tzinfo=timezone(timedelta(minutes=15 * quarter)))
    except ValueError:
        return None


#: Text encodings in the order of trial; the first that reads all bytes and gives no control characters is the answer.
CODECS = ("ascii", "utf-8", "cp932", "euc_jp", "cp437")


def text_codec_of(content: bytes) -> str | None:
    """Encoding of a text, or null. Space separators of any script are text; zero-width marks inside are not."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        order = ("utf-16",)
    else:
        order = CODECS
    for codec in order:
        try:
            s = content.decode(codec)
        except UnicodeDecodeError:
            continue
        s = s.removeprefix("\ufeff")
        if all(c in "\t\n\r\f" or (c >= " " and c != "\x7f" and c not in "\u200b\ufeff") for c in s):
            return codec
    return None


def text_codec(content: str) -> Column:
    """The encoding of each content of a binary column."""

    @F.pandas_udf("string")
    def codec(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: None if b is None else text_codec_of(bytes(b)))

    return codec(content)


def diff_runs(a: bytes, b: bytes) -> list[tuple[int, int]]:
    """(start, length) of the runs of differing bytes over the common length."""
    n = min(len(a), len(b))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8), [0]])))
    return [(int(s), int(e - s)) for s, e in zip(edge[::2], edge[1::2])]
