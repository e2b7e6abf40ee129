"""Trees, hash lists and tables as DataFrames; byte heads without reading whole files."""

from __future__ import annotations

import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.sources import decoders, formats
from quern.sources.shared import small_batches


def tree(spark: SparkSession, root: str) -> DataFrame:
    """path, size, mtime of every file; contents aren't read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return d.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def blobs(spark: SparkSession, root: str) -> DataFrame:
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return d.select(F.col("path").alias("label"), F.col("length").alias("size"), "content")


def hash_list(spark: SparkSession, path: str) -> DataFrame:
    """`sha1 size path` lines; others have a null sha1 and stay to be counted."""
    pattern = r"^([0-9a-f]{40})\s+(\d+)\s+(.+)$"
    v = F.col("value")
    ok = v.rlike(pattern)
    return spark.read.text(path).select(*[F.when(ok, F.regexp_extract(v, pattern, i)).alias(n) for i, n in ((1, "sha1"), (2, "size"), (3, "path"))], v.alias("line")).withColumn("size", F.col("size").cast("long"))


def tokens40(spark: SparkSession, path: str) -> DataFrame:
    """Every 40-digit hexadecimal token of text files."""
    return spark.read.text(path).select(F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"\b([0-9a-f]{40})\b"), 1)).alias("sha1"))


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated table whose header must be the schema's names."""
    return spark.read.option("sep", "\t").option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).csv(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines with a column `refused`: the line that is no such record, null for those that are. No line is dropped."""
    return spark.read.schema(f"{schema}, refused string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "refused").json(path)


def xml_rows(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    """Elements named row of XML files with a column `refused`: the element's text if it doesn't hold what the schema declares."""
    return spark.read.format("xml").schema(f"{schema}, refused string").option("rowTag", row).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "refused").load(path)


class _Part(InputPartition):
    def __init__(self, path: str, start: int, length: int, number: int):
        self.path, self.start, self.length, self.number = path, start, length, number


class ChunkSource(DataSource):
    """Blocks of files that every worker can open by path: `path, size, block, start, bytes`.

    Options: path (a folder or file), block (bytes), overlap (bytes of the next block added, so that a match at a seam is seen
    whole; it counts only where it starts before the block's end), head (only the first block)."""

    @classmethod
    def name(cls):
        return "chunks"

    def schema(self):
        return "path string, size long, block long, start long, bytes binary"

    def reader(self, schema):
        return _ChunkReader(self.options)


class _ChunkReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.block, self.overlap = options["path"], int(options.get("block", 4 << 20)), int(options.get("overlap", 0))
        self.head = str(options.get("head", "false")).lower() == "true"

    def partitions(self):
        import os

        files = [self.root] if os.path.isfile(self.root) else sorted(os.path.join(d, f) for d, _, fs in os.walk(self.root) for f in fs)
        out = []
        for f in files:
            n = os.path.getsize(f)
            out += [_Part(f, s, n, i) for i, s in enumerate(range(0, max(n, 1), self.block)) if i == 0 or not self.head]
        return out

    def read(self, part):
        with open(part.path, "rb") as f:
            f.seek(part.start)
            yield part.path, part.length, part.number, part.start, f.read(self.block + (0 if self.head else self.overlap))


def needle_in_chunks(chunks: DataFrame, needle: bytes, block: int) -> DataFrame:
    """Places of needle by file, overlapping ones included; each counts once, for the block it starts in."""

    @F.pandas_udf("long")
    def hits(content: pd.Series) -> pd.Series:
        def n(b):
            k, at = 0, b.find(needle)
            while 0 <= at < block:
                k, at = k + 1, b.find(needle, at + 1)
            return k

        return content.map(n)

    return chunks.groupBy("path").agg(F.sum(hits("bytes")).alias("hits"))


def chunked(files: DataFrame, block: int, overlap: int = 0, content: str = "content") -> DataFrame:
    """ChunkSource's rows from files that only Spark reads: `path, size, block, start, bytes` of a frame (path, content)."""
    size = F.octet_length(content)
    at = F.sequence(F.lit(0), F.greatest(F.floor((size - 1) / block), F.lit(0)).cast("int"))
    rows = files.select("path", size.cast("long").alias("size"), F.explode(at).alias("block"), F.col(content).alias("_c"))
    return rows.select("path", "size", "block", (F.col("block") * block).cast("long").alias("start"), F.substring("_c", F.col("block") * block + 1, F.lit(block + overlap)).alias("bytes"))


def heads(files: DataFrame, n: int, content: str = "content") -> DataFrame:
    """path and the first n bytes of each file."""
    return files.select("path", F.substring(content, 1, n).alias("head"))


def members(archives: DataFrame, content: str = "content") -> DataFrame:
    """One row a member of every ZIP archive (path, content): path, name, size, packed, offset, crc; from the directory, nothing is unpacked."""

    def run(batches):
        for pdf in batches:
            rows = [(p, *m) for p, c in zip(pdf["path"], pdf[content]) for m in zip_members(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "name", "size", "packed", "offset", "crc"])

    return small_batches(archives.select("path", content)).mapInPandas(run, "path string, name string, size long, packed long, offset long, crc long")


def coverage(decoded: DataFrame, sizes: DataFrame) -> DataFrame:
    """The account of a decoded tree: by kind and outcome (closed, refused, or undecoded) files, bytes and share, beside the whole tree's bytes.

    decoded is decode's result, sizes (label, size) the tree's files. Files that decode lost are the account's residue, a row of their own."""
    outcome = F.when(F.col("error").isNotNull(), "refused").when(F.col("detail").isNotNull(), "closed").otherwise("undecoded")
    known = decoded.select("label", "kind", outcome.alias("outcome"))
    rows = sizes.join(known, "label", "left").withColumn("kind", F.coalesce("kind", F.lit("lost"))).withColumn("outcome", F.coalesce("outcome", F.lit("lost")))
    by = rows.groupBy("kind", "outcome").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return by.crossJoin(F.broadcast(sizes.agg(F.sum("size").alias("total")))).withColumn("share_pct", F.round(F.col("bytes") * 100.0 / F.col("total"), 4)).drop("total")


def zip_members(content: bytes) -> list[tuple[str, int, int, int, int]]:
    """(name, size, packed, offset, crc) from the central directory, without extraction."""
    import io

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(i.filename, i.file_size, i.compress_size, i.header_offset, i.CRC) for i in z.infolist()]


def png_chunks(content: bytes) -> tuple[int, int, int, int, list[str]]:
    """(width, height, depth, colour, chunk names); refuses a wrong signature, CRC, or bytes left over."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG signature")
    pos, names, head = 8, [], (0, 0, 0, 0)
    while pos < len(content):
        if pos + 12 > len(content):
            raise ValueError(f"residue {len(content) - pos}")
        n, kind = struct.unpack(">I4s", content[pos : pos + 8])
        body = content[pos + 8 : pos + 8 + n]
        if len(body) != n or len(content) < pos + 12 + n:
            raise ValueError("chunk past the end")
        if struct.unpack(">I", content[pos + 8 + n : pos + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError(f"CRC of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBB", body[:10])
        names.append(kind.decode("latin-1"))
        pos += 12 + n
    if not names or names[0] != "IHDR" or names[-1] != "IEND":
        raise ValueError("first or last chunk")
    return (*head, names)


def riff_tree(content: bytes) -> list[tuple[int, int, str, int]]:
    """(offset, size, id, depth) of RIFF chunks, padded to even; refuses what doesn't close on the declared length."""
    if content[:4] != b"RIFF" or len(content) < 12 or struct.unpack("<I", content[4:8])[0] + 8 != len(content):
        raise ValueError("RIFF length")
    out = []

    def walk(pos, end, depth):
        while pos < end:
            if pos + 8 > end:
                raise ValueError(f"residue {end - pos}")
            kind, n = content[pos : pos + 4].decode("latin-1"), struct.unpack("<I", content[pos + 4 : pos + 8])[0]
            if pos + 8 + n > end:
                raise ValueError(f"chunk {kind} past the end")
            out.append((pos, n, kind, depth))
            if kind == "LIST":
                walk(pos + 12, pos + 8 + n, depth + 1)
            pos += 8 + n + n % 2

    walk(12, len(content), 0)
    return out


def mp4_boxes(content: bytes, lo: int = 0, hi: int | None = None, depth: int = 0) -> list[tuple[int, int, str, int]]:
    """(offset, size, type, depth) of boxes; the boxes of a container must fill it exactly."""
    hi, out, pos = len(content) if hi is None else hi, [], lo
    while pos < hi:
        if pos + 8 > hi:
            raise ValueError(f"residue {hi - pos}")
        n, kind, head = *struct.unpack(">I4s", content[pos : pos + 8]), 8
        if n == 1:
            n, head = struct.unpack(">Q", content[pos + 8 : pos + 16])[0], 16
        elif n == 0:
            n = hi - pos
        if n < head or pos + n > hi:
            raise ValueError(f"box {kind!r} past the end")
        name = kind.decode("latin-1")
        out.append((pos, n, name, depth))
        if name in ("moov", "trak", "mdia", "minf", "stbl", "edts", "dinf", "udta"):
            out += mp4_boxes(content, pos + head, pos + n, depth + 1)
        pos += n
    return out


def midi_tracks(content: bytes) -> tuple[int, int, int, int]:
    """(format, declared tracks, division, tracks found); refuses bytes left over."""
    if content[:8] != b"MThd\x00\x00\x00\x06" or len(content) < 14:
        raise ValueError("no MIDI header")
    fmt, declared, division = struct.unpack(">HHH", content[8:14])
    pos, found = 14, 0
    while pos < len(content):
        if content[pos : pos + 4] != b"MTrk" or pos + 8 > len(content):
            raise ValueError(f"residue {len(content) - pos}")
        pos += 8 + struct.unpack(">I", content[pos + 4 : pos + 8])[0]
        found += 1
    if pos != len(content) or found != declared:
        raise ValueError("tracks do not close")
    return fmt, declared, division, found


#: Decoder registry: name -> function. Output of `decode` is one row a file, refusals included.
DECODERS = {
    "png": png_chunks,
    "zip": zip_members,
    "midi": midi_tracks,
    "wave": decoders.wave_info,
    "riff": riff_tree,
    "mp4": mp4_boxes,
    "ogg": decoders.ogg_pages,
    "pe": decoders.pe_sections,
    "gzip": decoders.gzip_content,
    "bzip2": decoders.bzip2_content,
    "xz": decoders.xz_content,
    "iso9660": decoders.iso9660_records,
    "ole2": formats.compound_entries,
    "cabinet": formats.cabinet_members,
    "psd": formats.psd_header,
}


def sniffed(content: str = "content"):
    """First match wins; `opaque` without one. Cheap prefix tests on the JVM side."""
    c, out = F.col(content), None
    for name, magic in (("png", "89504E470D0A1A0A"), ("zip", "504B0304"), ("midi", "4D546864"), ("ole2", "D0CF11E0A1B11AE1"), ("gzip", "1F8B"), ("bzip2", "425A68"), ("xz", "FD377A585A00"), ("pe", "4D5A"), ("ogg", "4F676753"), ("cabinet", "4D534346"), ("psd", "38425053")):
        test = F.substring(c, 1, len(magic) // 2) == F.unhex(F.lit(magic))
        out = F.when(test, name) if out is None else out.when(test, name)
    riff = F.substring(c, 1, 4) == F.unhex(F.lit("52494646"))
    mp4 = F.substring(c, 5, 4) == F.unhex(F.lit("66747970"))
    wave = riff & (F.substring(c, 9, 4) == F.unhex(F.lit("57415645")))
    iso = F.substring(c, 32770, 5) == F.unhex(F.lit("4344303031"))
    return out.when(wave, "wave").when(riff, "riff").when(iso, "iso9660").when(mp4, "mp4").when(F.is_valid_utf8(c.cast("string")), "text").otherwise("opaque")


def decode(files: DataFrame) -> DataFrame:
    """files (label, content): label, kind, parts, detail, error. What doesn't close is refused by name, never dropped."""

    def run(batches):
        for pdf in batches:
            rows = []
            for label, kind, content in zip(pdf["label"], pdf["kind"], pdf["content"]):
                try:
                    got = DECODERS[kind](bytes(content)) if kind in DECODERS else None
                    rows.append((label, kind, len(got) if isinstance(got, list) else None if got is None else 1, None if got is None else str(got), None))
                except Exception as e:  # a probe that raises is a refused file
                    rows.append((label, kind, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["label", "kind", "parts", "detail", "error"])

    return small_batches(files.select("label", sniffed().alias("kind"), "content")).mapInPandas(run, "label string, kind string, parts long, detail string, error string")
