"""XES logs as a Spark data source: byte ranges of large files are read side by side, and every trace knows its place.

A reader partition is a range of a file's bytes; a trace belongs to the range that its tag begins in, and is read to its end wherever that lies. Compressed
files are one range. ``file, offset`` (bytes of the uncompressed text) are a trace's place, so order survives any number of files and ranges.
The header (classifiers, extensions) is read once a file. Paths may be local, or any that Arrow's file systems know (``s3://``, ``gs://``, ``hdfs://``).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracefold.functions.storage import numbered
from tracefold.sources.logs import in_time_order

TRACES = "file string, offset long, case_attrs map<string,string>, events array<struct<pos:long,attrs:map<string,string>>>"
HEADER = "file string, classifiers map<string,string>, extensions map<string,string>"
#: Bytes of a range, bytes read at once, traces of a batch.
RANGE, CHUNK, BATCH = 32 << 20, 1 << 20, 256
_BEGIN, _END = re.compile(rb"<trace(?=[\s/>])"), re.compile(rb"</trace\s*>")
_SKIP = re.compile(rb"<!--.*?-->|<!\[CDATA\[.*?\]\]>", re.S)
_KINDS = frozenset(("string", "date", "int", "float", "boolean", "id"))
_MAP = pa.map_(pa.string(), pa.string())
_EVENTS = pa.list_(pa.struct([("pos", pa.int64()), ("attrs", _MAP)]))


def _files(path: str) -> list[tuple[str, int]]:
    """The files of a path (a file, or a folder's that aren't hidden) with their sizes, in order of name."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    kept = [f for f in found if f.is_file and not any(part[:1] in "._" for part in f.path[len(root) :].strip("/").split("/") if part)]
    return sorted((scheme + f.path, f.size) for f in kept)


def _chunks(file: str, start: int = 0) -> Iterator[bytes]:
    """A file's bytes from ``start`` on, unpacked if it is compressed (then ``start`` is 0)."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(file) if "://" in file else (fs.LocalFileSystem(), file)
    with system.open_input_file(place) as f:
        f.seek(start)
        unzip = zlib.decompressobj(31) if file.endswith(".gz") else None
        while data := f.read(CHUNK):
            if unzip is None:
                yield data
                continue
            while data:  # a gzip file may have several members
                out = unzip.decompress(data)
                if out:
                    yield out
                data = unzip.unused_data
                if unzip.eof:
                    unzip = zlib.decompressobj(31)
                elif not data:
                    break


def _blank(text: bytes) -> bytes:
    """Comments and CDATA as blanks of the same length: what they hold begins no trace."""
    return _SKIP.sub(lambda m: b" " * len(m[0]), text)


def _traces(file: str, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """``offset, text`` of the traces that begin in the range. A comment that begins before the range and holds a trace's tag is not seen as one."""
    held, base, chunks, done = b"", start, _chunks(file, start), False
    while True:
        found = _BEGIN.search(_blank(held))
        if found:
            at = found.start()
            if end is not None and base + at >= end:
                return
            rest = held[at:]
            tag = rest.find(b">")
            close = None if tag < 0 else tag + 1 if rest[tag - 1 : tag] == b"/" else (m.end() if (m := _END.search(_blank(rest))) else None)
            if close is not None:
                yield base + at, rest[:close]
                held, base = rest[close:], base + at + close
                continue
            held, base = rest, base + at
        elif end is not None and base + max(0, len(held) - 6) >= end:
            return
        if done:
            if found:
                raise ValueError(f"{file}: the trace at byte {base} has no end")
            return
        if not found:
            # an open comment, or the first letters of a tag, may go on
            comment = max(_blank(held).rfind(b"<!--"), _blank(held).rfind(b"<![CDATA["))
            keep = comment if comment >= 0 else max(0, len(held) - 16)
            held, base = held[keep:], base + keep
        grown = [held]
        size = len(held)
        # what is searched again doubles, so a long trace is read in linear time
        while (more := next(chunks, None)) is not None:
            grown.append(more)
            size += len(more)
            if size >= 2 * len(held):
                break
        done = more is None
        held = b"".join(grown)


def _header(file: str) -> tuple[str, bytes]:
    """The declared encoding, and the text before the first trace."""
    text = b""
    for chunk in _chunks(file):
        text += chunk
        if found := _BEGIN.search(_blank(text)):
            text = text[: found.start()]
            break
    declared = re.match(rb"\s*(?:\xef\xbb\xbf)?<\?xml[^>]*encoding=[\"']([^\"']+)", text)
    return (declared[1].decode() if declared else "utf-8"), text


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attributes(element: ElementTree.Element) -> list[tuple[str, str]]:
    """Typed attributes by key; the first of repeated ones counts."""
    out: dict[str, str] = {}
    for x in element:
        if _local(x.tag) in _KINDS and x.get("key") is not None:
            out.setdefault(x.get("key"), x.get("value"))
    return list(out.items())


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int | None, encoding: str):
        self.file, self.start, self.end, self.encoding = file, start, end, encoding


class XesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.part = options["path"], int(options.get("range", RANGE)), options.get("part", "traces")

    def partitions(self):
        out = []
        for file, size in _files(self.path):
            encoding = _header(file)[0]
            whole = file.endswith(".gz") or self.part == "header"
            out += [Range(file, 0, None, encoding)] if whole else [Range(file, i, min(i + self.size, size), encoding) for i in range(0, size, self.size)]
        return out

    def read(self, partition: Range):
        if self.part == "header":
            text = _header(partition.file)[1].decode(partition.encoding)
            named = lambda tag, key, value: [(m.get(key), m.get(value)) for m in (ElementTree.fromstring(t) for t in re.findall(rf"<{tag}\s[^>]*/>", text)) if m.get(key) is not None]
            yield partition.file, dict(named("classifier", "name", "keys")), dict(named("extension", "prefix", "uri"))
            return
        rows = []
        head = f'<?xml version="1.0" encoding="{partition.encoding}"?>'.encode()
        for offset, text in _traces(partition.file, partition.start, partition.end):
            trace = ElementTree.fromstring(head + text)
            events = [{"pos": i, "attrs": _attributes(e)} for i, e in enumerate(x for x in trace if _local(x.tag) == "event")]
            rows.append((partition.file, offset, _attributes(trace), events))
            if len(rows) == BATCH:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), _MAP, _EVENTS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "offset", "case_attrs", "events"])


class XesDataSource(DataSource):
    """``spark.read.format("xes").load(path)``; options: ``range`` (bytes), ``part`` (``traces`` or ``header``)."""

    @classmethod
    def name(cls) -> str:
        return "xes"

    def schema(self) -> str:
        return HEADER if self.options.get("part") == "header" else TRACES

    def reader(self, schema) -> DataSourceReader:
        return XesReader(dict(self.options))


def _load(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(XesDataSource)
    return spark.read.format("xes").options(**options).load(path)


def xes_header(spark: SparkSession, path: str) -> DataFrame:
    """``file, classifiers, extensions`` of each file."""
    return _load(spark, path, part="header")


def read_xes_ranges(spark: SparkSession, path: str, log: str, range_bytes: int = RANGE) -> DataFrame:
    """As ``read_xes``: ``log, case_pos, case_id, case_attrs, events`` in time order; ``case_pos`` counts the traces of all files in the order of name and place."""
    rows = numbered(_load(spark, path, range=range_bytes), [F.col("file").asc(), F.col("offset").asc()], "case_pos")
    named = F.nullif(F.trim(F.col("case_attrs")["concept:name"]), F.lit(""))
    case_id = F.coalesce(named, F.concat(F.lit("case_"), F.col("case_pos").cast("string")))
    return rows.select(F.lit(log).alias("log"), "case_pos", case_id.alias("case_id"), "case_attrs", in_time_order(F.col("events")).alias("events"))
