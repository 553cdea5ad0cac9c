"""Which files there are, what is in them, and what a manifest of them lacks; and the formats of delimited files."""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Bytes that a format is told from, encodings and separators in the order in which they are tried.
HEAD = 1 << 16
ENCODINGS, SEPARATORS = ("UTF-8", "windows-1252", "ISO-8859-1"), (",", ";", "\t", "|")
#: Rows that are read of a file of more than so many bytes, where a caller asks for a sample.
LARGE_BYTES, SAMPLE_ROWS = 500_000_000, 500_000
_WINDOWS = {b: c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}


def listed(spark: SparkSession, path: str, glob: str | None = None, whole_bytes: int = 1 << 30) -> DataFrame:
    """``path``, ``length``, ``modified`` and ``digest`` of every file below a folder (whose names fit ``glob``).

    Files are hashed where they are read, SHA-256 of all bytes; of files beyond ``whole_bytes`` (2 GB is what a row can hold) the digest is that
    of their length and time, marked ``stat:``. A folder without files gives an empty table.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    small = found.where(F.col("length") <= whole_bytes).select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))
    stat = F.concat(F.lit("stat:"), F.sha2(F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256))
    large = found.where(F.col("length") > whole_bytes).select("path", "length", F.col("modificationTime").alias("modified"), stat.alias("digest"))
    return small.unionByName(large)


def compared(manifest: DataFrame, listing: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """``key``, ``status`` (new, modified, gone or same), and the old and new digest, of every file of either side. Equal entries count once; null keys are
    left out."""
    side = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(digest).alias(name), F.lit(True).alias(f"_{name}"))
    both = side(manifest, "old_digest").join(side(listing, "new_digest"), key, "full")
    status = F.when(F.col("_old_digest").isNull(), "new").when(F.col("_new_digest").isNull(), "gone").when(F.col("old_digest").eqNullSafe(F.col("new_digest")), "same").otherwise("modified")
    return both.select(key, status.alias("status"), "old_digest", "new_digest")


def _separator(text: str) -> str:
    """The separator that gives the header most columns, all full lines of the head alike; else the one of most columns."""
    lines = [x for x in text.splitlines() if x.strip()][:50]
    if not lines:
        return SEPARATORS[0]
    counts = {s: [_fields(x, s) for x in lines] for s in SEPARATORS}
    even = [s for s in SEPARATORS if counts[s][0] > 1 and len(set(counts[s])) == 1]
    return max(even or SEPARATORS, key=lambda s: (counts[s][0], -SEPARATORS.index(s)))


def _fields(line: str, sep: str) -> int:
    """Fields of a line; separators between quotes don't count."""
    n, inside = 1, False
    for c in line:
        if c == '"':
            inside = not inside
        n += c == sep and not inside
    return n


def sniffed(data: bytes, whole: bool = True) -> tuple[str, str]:
    """Encoding and separator that a file's first bytes show. Bytes that ISO-8859-1 alone assigns (0x81, 0x8D, 0x8F, 0x90, 0x9D) tell it from windows-1252."""
    if data[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
        return "UTF-16", _separator(data.decode("utf-16", "replace"))
    for encoding in ENCODINGS:
        try:
            text = codecs.getincrementaldecoder({"UTF-8": "utf-8-sig", "windows-1252": "cp1252"}.get(encoding, "latin-1"))().decode(data, final=whole)
        except UnicodeDecodeError:
            continue
        return encoding, _separator(text if whole else text.rpartition("\n")[0] or text)
    raise AssertionError("every byte is a letter of ISO-8859-1")


def formats(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path``, ``length``, ``encoding`` and ``sep`` of every file below a folder, from its first ``HEAD`` bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    heads = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length", F.substring("content", 1, HEAD).alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sniffed(h or b"", n <= HEAD) for h, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["path", "length", "encoding", "sep"])

    return heads.mapInArrow(run, "path string, length long, encoding string, sep string")


def read_delimited(spark: SparkSession, path: str, glob: str | None = None, sample_large: bool = False) -> DataFrame:
    """All delimited files below a folder as one table, each read in its own encoding and with its own separator; columns by name, null where
    a file has none, and ``_file``. Files of one format are read together, so there are at most as many readers as formats (16).

    Every row is read; with ``sample_large`` only the first ``SAMPLE_ROWS`` rows of a file of more than ``LARGE_BYTES`` bytes are. Empty files have no rows; a
    folder with none but these is a ``ValueError``.
    """
    found = formats(spark, path, glob).where("length > 0").groupBy("encoding", "sep", (F.col("length") > LARGE_BYTES).alias("large")).agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()  # two rows for each format at most
    parts = []
    for r in sorted(found, key=lambda r: (r.encoding, r.sep, r.large)):
        by_header: dict[tuple, list[str]] = {}
        for p in r.paths:
            by_header.setdefault((*_read(spark, p, r).columns, p if r.large and sample_large else ""), []).append(p)
        read = [_read(spark, own, r) for own in by_header.values()]
        parts += [x.limit(SAMPLE_ROWS) for x in read] if r.large and sample_large else read
    if not parts:
        raise ValueError(f"{path}: no file with rows")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _read(spark: SparkSession, path: str | list[str], how: Row) -> DataFrame:
    """Files of one format. Windows-1252 is read as ISO-8859-1, from which it differs in the controls 0x80 to 0x9F alone; UTF-16 isn't cut into lines by
    bytes, so its files are read whole."""
    windows = how.encoding == "windows-1252"
    reader = spark.read.option("header", True).option("sep", how.sep).option("encoding", "ISO-8859-1" if windows else how.encoding).option("multiLine", how.encoding == "UTF-16")
    df = reader.csv(path)
    names = [(c.translate(_WINDOWS) if windows else c).lstrip("\ufeff").strip() for c in df.columns]
    cells = [F.translate(F.col(f"`{c}`"), "".join(map(chr, _WINDOWS)), "".join(_WINDOWS.values())) if windows else F.col(f"`{c}`") for c in df.columns]
    return df.select(*[c.alias(n) for c, n in zip(cells, names, strict=True)], F.col("_metadata.file_path").alias("_file"))
