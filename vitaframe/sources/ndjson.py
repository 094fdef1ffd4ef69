"""Bulk NDJSON with physical line numbers, read in byte ranges.

Files are cut into ranges, and a line belongs to the range in which it begins. One
scan counts the lines of each range, the ranges' running totals number the lines,
and a second scan reads them: no range waits for another, and a file of any length
is read by as many tasks as it has ranges. Only "\\n" ends a line, one "\\r" before it
goes, and blank lines are counted and not returned. Of a line beyond the limit no
more than the limit is ever held: the reader goes on to the next line end and gives
one row without text in its place. Bytes that aren't UTF-8 become U+FFFD, and a
byte-order mark at the start of a file goes.

Files are opened by their URI through pyarrow's file systems (local, HDFS, S3, GCS),
so the ranges also work where Spark's text source would hold whole lines.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from .resource_json import ndjson_records

RANGE_BYTES = 64 << 20
CHUNK = 1 << 20
#: Text after which lines are handed to Spark.
BATCH_BYTES = 4 << 20
MAX_LINE_BYTES = 16 << 20
#: White space of a blank line: fixed, JavaScript's.
BLANK = " \t\n\v\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_MARK = b"\xef\xbb\xbf"
COUNTS = "source string, begin long, n long"
LINES = "source string, line long, raw string, too_long boolean"


def files(path: str) -> list[tuple[str, int]]:
    """(URI or path, bytes) of a file, or of the files of a folder and those below it; names that begin with . or _ are none."""
    system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError("no NDJSON file or folder at the given path")
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(where, recursive=True))
    hidden = lambda p: any(part[:1] in "._" for part in p[len(where) :].split("/") if part)
    head = path[: len(path) - len(where)] if path.endswith(where) else ""
    return sorted((f"{head}{i.path}", i.size) for i in found if i.type == fs.FileType.File and not hidden(i.path))


def _open(source: str) -> pa.NativeFile:
    system, where = fs.FileSystem.from_uri(source) if "://" in source or source.startswith("file:") else (fs.LocalFileSystem(), source)
    return system.open_input_file(where)


def _chunks(f: pa.NativeFile, begin: int, end: int | None) -> Iterator[bytes]:
    f.seek(begin)
    while end is None or begin < end:
        data = f.read(CHUNK if end is None else min(CHUNK, end - begin))
        if not data:
            return
        begin += len(data)
        yield data


def count_lines(source: str, begin: int, end: int) -> int:
    """How many lines begin in a range of a file."""
    with _open(source) as f:
        size = f.size()
        n = 1 if begin == 0 and size else 0
        # a line begins behind each line end, unless the file ends there
        for data in _chunks(f, max(begin - 1, 0), min(end, size) - 1):
            n += data.count(b"\n")
    return n


def read_lines(source: str, begin: int, end: int, max_bytes: int) -> Iterator[bytes | None]:
    """The lines that begin in a range, without their ends; None for one of more than max_bytes bytes. Holds max_bytes and a chunk at most."""
    with _open(source) as f:
        end = min(end, f.size())
        at, held, long = begin, bytearray(), False
        if begin:
            at = None
            place = begin - 1
            for data in _chunks(f, place, end - 1):
                k = data.find(b"\n")
                if k >= 0:
                    at = place + k + 1
                    break
                place += len(data)
        if at is None or at >= end:
            return
        place = at  # of the byte that is read next
        for data in _chunks(f, at, None):
            i = 0
            while (k := data.find(b"\n", i)) >= 0:
                whole = not long and len(held) + k - i <= max_bytes + 1  # one byte may be the \r
                if whole:
                    held += data[i:k]
                yield _line(held, max_bytes) if whole else None
                held, long, i = bytearray(), False, k + 1
                if place + i >= end:
                    return
            if not long:
                long = len(held) + len(data) - i > max_bytes + 1
                held = bytearray() if long else held + data[i:]
            place += len(data)
        if held or long:
            yield None if long else _line(held, max_bytes)


def _line(held: bytearray, max_bytes: int) -> bytes | None:
    out = bytes(held[:-1]) if held.endswith(b"\r") else bytes(held)
    return out if len(out) <= max_bytes else None


class Range(InputPartition):
    def __init__(self, source: str, begin: int, end: int, before: int) -> None:
        self.source, self.begin, self.end, self.before = source, begin, end, before


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.ranges = [Range(*r) for r in json.loads(options["ranges"])]
        self.max_bytes = int(options.get("max_bytes", MAX_LINE_BYTES))

    def __getstate__(self) -> dict:
        """What goes with each task: its own range comes by itself, and a list of all ranges with every range would grow with their square."""
        return self.__dict__ | {"ranges": []}

    def partitions(self) -> list[Range]:
        return self.ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class _Counter(_Reader):
    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        r = partition
        yield pa.RecordBatch.from_arrays([pa.array([r.source]), pa.array([r.begin]), pa.array([count_lines(r.source, r.begin, r.end)])], names=["source", "begin", "n"])


class _Lines(_Reader):
    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        r = partition
        rows: list[tuple[int, str | None]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            texts = [t for _, t in rows]
            return pa.RecordBatch.from_arrays([pa.array([r.source] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int64()), pa.array(texts, pa.string()), pa.array([t is None for t in texts], pa.bool_())], names=["source", "line", "raw", "too_long"])

        for n, data in enumerate(read_lines(r.source, r.begin, r.end, self.max_bytes), r.before + 1):
            if data is not None and n == 1:
                data = data.removeprefix(_MARK)
            text = None if data is None else data.decode("utf-8", "replace")
            if text is None or text.strip(BLANK):
                rows.append((n, text))
                held += len(text or "")
            if held >= BATCH_BYTES or len(rows) >= 10_000:
                yield batch()
                rows, held = [], 0
        yield batch()


class _Counts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vitaframe_ndjson_counts"

    def schema(self) -> str:
        return COUNTS

    def reader(self, schema) -> DataSourceReader:
        return _Counter(self.options)


class _Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vitaframe_ndjson_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _Lines(self.options)


def _read(spark: SparkSession, kind: type[DataSource], ranges: list[tuple], max_bytes: int) -> DataFrame:
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).option("ranges", json.dumps(ranges)).option("max_bytes", str(max_bytes)).load()


def runs(ranges: list[tuple], tasks: int) -> list[tuple]:
    """Ranges as they are read: neighbours in a file together, where there would be far more of them than `tasks`; of no more than RANGE_BYTES, if they aren't longer by themselves."""
    most = min(RANGE_BYTES, sum(end - begin for _, begin, end, _ in ranges) // tasks)
    out: list[tuple] = []
    for source, begin, end, before in ranges:
        if out and out[-1][0] == source and out[-1][2] == begin and end - out[-1][1] <= most:
            out[-1] = (source, out[-1][1], end, before)
        else:
            out.append((source, begin, end, before))
    return out


def lines(spark: SparkSession, paths: str | list[str], max_bytes: int = MAX_LINE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """source, line (from 1), raw and too_long of every line that isn't blank."""
    found = [x for p in ([paths] if isinstance(paths, str) else paths) for x in files(p)]
    ranges = [(source, begin, min(begin + range_bytes, size), 0) for source, size in found for begin in range(0, size, range_bytes)]
    if not ranges:
        return spark.createDataFrame([], LINES)
    ranges = runs(ranges, 4 * spark.sparkContext.defaultParallelism)
    if len(ranges) > len(found):  # some file has several ranges: what comes before each is counted first
        order = Window.partitionBy("source").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
        counts = _read(spark, _Counts, ranges, max_bytes).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
        # one number for each range, as the list of ranges itself
        before = {(r.source, r.begin): r.before for r in counts.select("source", "begin", "before").collect()}
        ranges = [(s, b, e, before[s, b]) for s, b, e, _ in ranges]
    return _read(spark, _Source, ranges, max_bytes)


def read_ndjson(spark: SparkSession, paths: str | list[str], max_bytes: int = MAX_LINE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One record for each line that isn't blank: source, line, and the resource or an error code."""
    return ndjson_records(lines(spark, paths, max_bytes, range_bytes), max_bytes)


def stream_ndjson(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, max_bytes: int = MAX_LINE_BYTES, range_bytes: int = RANGE_BYTES) -> StreamingQuery:
    """A query that gives `sink` the records of the files that have arrived, in micro-batches, each file once.

    Spark's file source finds the files, and keeps which ones are done in `checkpoint`; each batch's files are read in ranges as above, so lines have their numbers. Start it with the query's own controls: it takes what is there and ends when awaited with processAllAvailable() and stop().
    """
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")

    def run(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.collect()]
        if paths:
            sink(read_ndjson(spark, paths, max_bytes, range_bytes), number)

    return found.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
