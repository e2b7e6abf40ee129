"""More decoders by published formats: pictures, films, cabinets and compound files. The contract is that of `decoders`."""

from __future__ import annotations

import struct
from datetime import datetime

from quern.sources.decoders import field, need


def bmp_header(content: bytes) -> tuple[int, int, int]:
    """(width, height, bits) of an uncompressed Windows bitmap whose rows, padded to four bytes, end at the declared size."""
    magic, size, _, start = field("<2sIII", content, 0)
    need(magic == b"BM" and size == len(content), "no bitmap of its declared size")
    (head,) = field("<I", content, 14)
    need(head >= 40, f"header of {head} bytes")
    width, height, planes, bits, packed = field("<iiHHI", content, 18)
    need(planes == 1 and width > 0 and height != 0 and packed in (0, 3), "no plain bitmap")
    end = start + (width * bits + 31) // 32 * 4 * abs(height)
    need(start >= 14 + head and end == size, f"residue {size - end}")
    return width, abs(height), bits


def icon_images(content: bytes) -> list[tuple[int, int, int, int, int]]:
    """(width, height, bits, offset, bytes) of an icon's or a cursor's images, which must tile the file behind the directory."""
    reserved, kind, n = field("<HHH", content, 0)
    need(reserved == 0 and kind in (1, 2) and n > 0, "no icon directory")
    out = []
    for i in range(n):
        w, h, _, _, _, bits, size, at = field("<BBBBHHII", content, 6 + 16 * i)
        out.append((w or 256, h or 256, bits, at, size))
    reach = 6 + 16 * n
    for *_, at, size in sorted(out, key=lambda x: x[3]):
        need(at == reach, f"image at {at}, expected at {reach}")
        reach = at + size
    need(reach == len(content), f"residue {len(content) - reach}")
    return out


def pcx_picture(content: bytes) -> tuple[int, int, int, int, bool]:
    """(width, height, bits, planes, palette) of a run-length picture whose rows fill the declared area exactly."""
    maker, _, packed, bits, x0, y0, x1, y1 = field("<BBBBHHHH", content, 0)
    planes, line = field("<BH", content, 65)
    need(maker == 10 and packed == 1 and bits in (1, 2, 4, 8) and x1 >= x0 and y1 >= y0, "no PCX header")
    width, height = x1 - x0 + 1, y1 - y0 + 1
    need(line * 8 >= width * bits, "lines shorter than the width")
    want, at, got = height * planes * line, 128, 0
    while got < want:
        need(at < len(content), f"ends {want - got} bytes early")
        run = content[at] & 63 if content[at] >= 0xC0 else 1
        at += 2 if content[at] >= 0xC0 else 1
        got += run
    need(got == want and at <= len(content), "a run passes the last row")
    left = len(content) - at
    palette = left == 769 and content[at] == 12
    need(left == 0 or palette, f"residue {left}")
    return width, height, bits, planes, palette


def psd_header(content: bytes) -> tuple[int, int, int, int, int]:
    """(width, height, channels, depth, mode) of a layered picture; its five sections must end on the last byte."""
    magic, version = field(">4sH", content, 0)
    need(magic == b"8BPS" and version in (1, 2), "no PSD header")
    channels, height, width, depth, mode = field(">HIIHH", content, 12)
    at = 26
    for form in (">I", ">I", ">I" if version == 1 else ">Q"):
        at += struct.calcsize(form) + field(form, content, at)[0]
    (packed,) = field(">H", content, at)
    need(packed in (0, 1), f"compression {packed} declares no length")
    rows = height * channels
    if packed:
        form = f">{rows}{'H' if version == 1 else 'I'}"
        end = at + 2 + struct.calcsize(form) + sum(field(form, content, at + 2))
    else:
        end = at + 2 + rows * ((width * depth + 7) // 8)
    need(end == len(content), f"residue {len(content) - end}")
    return width, height, channels, depth, mode


def flic_frames(content: bytes) -> tuple[int, int, int, int]:
    """(width, height, declared frames, frames found) of a FLI or FLC film; one frame more than declared closes the loop."""
    size, magic, declared, width, height = field("<IHHHH", content, 0)
    need(magic in (0xAF11, 0xAF12) and size == len(content), "no film of its declared size")
    at, found = 128, 0
    while at < size:
        n, kind = field("<IH", content, at)
        need(n >= 6 and at + n <= size, f"chunk at {at} past the end")
        found += kind == 0xF1FA
        at += n
    need(at == size and found - declared in (0, 1), f"{found} frames of {declared}")
    return width, height, declared, found


def pak_resources(content: bytes) -> list[tuple[int, int, int]]:
    """(id, offset, bytes) of a resource pack, version 4 or 5: offsets ascend from the tables' end to the file's."""
    (version,) = field("<I", content, 0)
    need(version in (4, 5), f"version {version}")
    n, aliases, at = (field("<I", content, 4)[0], 0, 9) if version == 4 else (*field("<HH", content, 8), 12)
    need(at + 6 * (n + 1) + 4 * aliases <= len(content), "tables past the end")
    entries = [field("<HI", content, at + 6 * i) for i in range(n + 1)]
    offsets = [o for _, o in entries]
    need(offsets[0] == at + 6 * (n + 1) + 4 * aliases and offsets == sorted(offsets) and offsets[-1] == len(content), "resources do not tile the file")
    return [(i, o, after - o) for (i, o), after in zip(entries, offsets[1:])]


def dos_stamp(date: int, time: int) -> datetime | None:
    """A DOS date and time, in whole two seconds; null if it is none."""
    try:
        return datetime(1980 + (date >> 9), date >> 5 & 15, date & 31, time >> 11, time >> 5 & 63, (time & 31) * 2)
    except ValueError:
        return None


def _name(content: bytes, at: int) -> tuple[bytes, int]:
    end = content.find(b"\0", at)
    need(end >= 0, "a name has no end")
    return content[at:end], end + 1


def cabinet_members(content: bytes) -> list[tuple[str, int, int, datetime | None]]:
    """(name, bytes, folder, stamp) of a cabinet's files. Data blocks must lie in the file, and a folder that this cabinet holds
    alone must unpack to the end of its last file."""
    magic, _, size, _, files_at = field("<4sIIII", content, 0)
    need(magic == b"MSCF" and size == len(content), "no cabinet of its declared size")
    folders, files, flags = field("<HHH", content, 26)
    at, of_folder, of_block = 36, 0, 0
    if flags & 4:
        of_header, of_folder, of_block = field("<HBB", content, at)
        at += 4 + of_header
    for _ in range(2 * (flags & 1) + (flags & 2)):  # file and disk name of the cabinets before and after
        at = _name(content, at)[1]
    unpacked = []
    for i in range(folders):
        start, blocks, _ = field("<IHH", content, at + i * (8 + of_folder))
        total = 0
        for _ in range(blocks):
            _, packed, plain = field("<IHH", content, start)
            start += 8 + of_block + packed
            total += plain
        need(start <= size, f"folder {i} past the end")
        unpacked.append(total)
    out, reach, at, shared = [], [0] * folders, files_at, set()
    for _ in range(files):
        n, offset, folder, date, time, marks = field("<IIHHHH", content, at)
        name, at = _name(content, at + 16)
        if folder >= 0xFFFD:  # goes on from or to another cabinet
            shared |= {0} if folder == 0xFFFD else {folders - 1} if folder == 0xFFFE else {0, folders - 1}
        else:
            need(folder < folders, f"no folder {folder}")
            reach[folder] = max(reach[folder], offset + n)
        out.append((name.decode("utf-8" if marks & 0x80 else "cp1252", "replace"), n, folder, dos_stamp(date, time)))
    for i in set(range(folders)) - shared:
        need(reach[i] == unpacked[i], f"folder {i} unpacks to {unpacked[i]}, its files to {reach[i]}")
    return out


FREE, END = 0xFFFFFFFF, 0xFFFFFFFE


def compound_entries(content: bytes) -> list[tuple[str, str, int]]:
    """(path, kind, bytes) of a compound file's storages and streams; each stream's chain must have the sectors of its length."""
    need(content[:8] == bytes.fromhex("D0CF11E0A1B11AE1"), "no compound file")
    version, _, shift, small_shift = field("<HHHH", content, 26)
    need((version, shift) in ((3, 9), (4, 12)) and small_shift == 6, "unknown sector sizes")
    n_fat, first_dir, _, cutoff, first_small, _, first_more, _ = field("<8I", content, 44)
    sector = 1 << shift

    def words(number: int) -> list[int]:
        return list(field(f"<{sector // 4}I", content, (number + 1) * sector))

    tables, more, seen = list(field("<109I", content, 76)), first_more, set()
    while more not in (END, FREE):
        need(more not in seen, "the table's list loops")
        seen.add(more)
        *part, more = words(more)
        tables += part
    tables = [t for t in tables if t != FREE]
    need(len(tables) == n_fat, f"{len(tables)} table sectors of {n_fat}")
    fat = [x for t in tables for x in words(t)]

    def chain(first: int, table: list[int]) -> list[int]:
        out, at = [], first
        while at not in (END, FREE):
            need(at < len(table) and len(out) < len(table), "a chain leaves its table")
            out.append(at)
            at = table[at]
        return out

    small = [x for s in chain(first_small, fat) for x in words(s)]
    raw = b"".join(content[(s + 1) * sector : (s + 2) * sector] for s in chain(first_dir, fat))
    need(len(raw) >= 128, "no directory")

    def entry(i: int) -> tuple[str, int, int, int, int, int, int]:
        length, kind, _, left, right, child = field("<HBBIII", raw, 128 * i + 64)
        start, size = field("<IQ", raw, 128 * i + 116)
        name = raw[128 * i : 128 * i + max(0, min(64, length) - 2)].decode("utf-16-le", "replace")
        return name, kind, left, right, child, start, size if version == 4 else size & 0xFFFFFFFF

    out, visited, todo = [], set(), [(entry(0)[4], "")]
    while todo:
        i, above = todo.pop()
        if i == FREE:
            continue
        need(i not in visited, "the directory loops")
        visited.add(i)
        name, kind, left, right, child, start, size = entry(i)
        path = f"{above}/{name}"
        need(kind in (1, 2), f"{path}: entry of kind {kind}")
        todo += [(left, above), (right, above)]
        if kind == 1:
            todo.append((child, path))
        else:
            table, unit = (small, 64) if size < cutoff else (fat, sector)
            need(size == 0 or len(chain(start, table)) == -(-size // unit), f"{path}: its chain does not hold {size} bytes")
        out.append((path, "storage" if kind == 1 else "stream", size if kind == 2 else 0))
    return sorted(out)
