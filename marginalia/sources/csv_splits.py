"""CSV whose quoted fields may hold line breaks, read by many tasks a file.

Where a record begins depends on all quotes before it. So a first pass counts, for each split of a file, its quotes and the
records that begin in it: once as if the split began outside of quotes, once as if inside. The parities of the splits
before it tell which of the two holds, and the counts number its records. In the second pass each split is read from its
first record to the end of its last one, and Spark's own CSV parser takes the records apart.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes of a split, splits of all files together at most (larger ones then), and bytes that a task holds at once.
SPLIT_BYTES, MOST_SPLITS, CHUNK_BYTES = 32 << 20, 50_000, 8 << 20
#: Endings of files that can't be read from the middle.
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate", ".xz")
DIALECT = {"quote": '"', "escape": '"', "multiLine": "true"}
_QUOTE, _LF, _CR = b'"\n\r'


def _open(path: str) -> pa.NativeFile:
    if path.startswith("file:") or path.startswith("/"):
        return pa.fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    fs, inner = pa.fs.FileSystem.from_uri(quote(path, safe=":/@?&=%"))
    return fs.open_input_file(inner)


class Split(InputPartition):
    """Bytes ``begin`` to ``end`` of a file of ``size`` bytes; whether a quote is open there, the number of its first record, and
    whether the file's lines end by CRLF."""

    def __init__(self, number: int, path: str, size: int, begin: int, end: int, inside: int = 0, place: int = 0, crlf: bool = False) -> None:
        super().__init__(number)
        self.number, self.path, self.size, self.begin, self.end = number, path, size, begin, end
        self.inside, self.place, self.crlf = inside, place, crlf


def _splits(options: dict[str, str]) -> list[Split]:
    width, out = int(options["split_bytes"]), []
    states = json.loads(options.get("states", "[]"))
    for path, size in json.loads(options["files"]):
        for begin in range(0, size, width):
            state = states[len(out)] if states else ()
            out.append(Split(len(out), path, size, begin, min(size, begin + width), *state))
    return out


def _begins(handle: pa.NativeFile, size: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of ``a`` to ``b`` where a record begins if no quote is open there; whether one that is open or not at ``a`` changed until
    there, and until ``b``. Empty lines begin no record."""
    lead = 1 if a else 0
    data = np.frombuffer(handle.read_at(min(b + 2, size) - a + lead, a - lead), np.uint8)
    body = data[lead : lead + b - a]
    quotes = np.flatnonzero(body == _QUOTE)
    at = np.flatnonzero(data[: lead + b - a - 1] == _LF) + 1 - lead
    at = at if a else np.concatenate([[0], at])
    first, second = data[at + lead], data[np.minimum(at + lead + 1, len(data) - 1)]
    at = at[~((first == _LF) | ((first == _CR) & (second == _LF)))]
    return at + a, np.searchsorted(quotes, at) & 1, len(quotes) & 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.chunk = dict(options), int(options["chunk_bytes"])

    def partitions(self) -> list[Split]:
        return _splits(self.options)


class _Counts(_Reader):
    def read(self, split: Split) -> Iterator[tuple[int, int, int, int, bool]]:
        odd, begun, crlf = 0, [0, 0], False
        with _open(split.path) as handle:
            for a in range(split.begin, split.end, self.chunk):
                _, changed, all_ = _begins(handle, split.size, a, min(split.end, a + self.chunk))
                ones = int((changed ^ odd).sum())
                begun[0] += len(changed) - ones
                begun[1] += ones
                odd ^= all_
            if split.begin == 0:
                line = b""
                while b"\n" not in line and (more := handle.read_at(self.chunk, len(line))):
                    line += more
                crlf = line.partition(b"\n")[0].endswith(b"\r")
        yield split.number, odd, *begun, crlf


class _Texts(_Reader):
    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        """The records that begin in the split, each with the line end after it, if there is one; a file's first is its header and goes."""
        inside, place, open_at = split.inside, split.place, None
        with _open(split.path) as handle:

            def texts(bounds: list[int]) -> pa.RecordBatch:
                data = handle.read_at(bounds[-1] - bounds[0], bounds[0])
                offsets = (np.array(bounds, np.int64) - bounds[0]).astype(np.int32)
                records = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
                places = np.arange(place, place + len(records))
                crlf = pa.array(np.full(len(records), split.crlf))
                batch = pa.RecordBatch.from_arrays([pa.array(places), records, crlf], ["place", "record", "crlf"])
                return batch.slice(1) if split.begin == 0 and place == split.place else batch

            for a in range(split.begin, split.size, self.chunk):
                at, changed, all_ = _begins(handle, split.size, a, min(split.size, a + self.chunk))
                at = at[(changed ^ inside) == 0]
                bounds = ([open_at] if open_at is not None else []) + at[at < split.end].tolist()
                after = at[at >= split.end][:1].tolist()
                if open_at is None and not bounds and a >= split.end:
                    return
                if len(bounds + after) > 1:
                    yield texts(bounds + after)
                    place += len(bounds + after) - 1
                if after:
                    return
                open_at = bounds[-1] if bounds else None
                inside ^= all_
            if open_at is not None:
                yield texts([open_at, split.size])


class CsvCounts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csv_split_counts"

    def schema(self) -> str:
        return "split int, odd int, begun_outside bigint, begun_inside bigint, crlf boolean"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Counts(self.options)


class CsvRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csv_split_records"

    def schema(self) -> str:
        return "place bigint, record string, crlf boolean"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Texts(self.options)


def splittable(files: list[tuple[str, int]]) -> bool:
    """Whether tasks can open the files at any place: they aren't compressed, and pyarrow knows their store."""
    if any(path.lower().endswith(COMPRESSED) for path, _ in files):
        return False
    try:
        for path in {p.partition("://")[0]: p for p, _ in files}.values():
            _open(path).close()
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and sizes of a path's files, in order of their names; nothing is read of them."""
    return sorted(map(tuple, spark.read.format("binaryFile").load(path).select("path", "length").collect()))


def read(spark: SparkSession, path: str, split_bytes: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame | None:
    """``row_id`` (0, 1, ... in the order of files by name and of records in them) and the text fields by header name.

    Quotes are doubled inside quotes and stand nowhere else but around a field; lines end by LF or CRLF, in UTF-8. An
    empty field is null, as with Spark's reader; each file has a header, and all have the same one. A quote that is never
    closed is an error. None if the files are compressed or in a store that tasks can't open. The files are read twice, the
    first time at once.
    """
    files = files_of(spark, path)
    if not splittable(files):
        return None
    width = split_bytes or max(SPLIT_BYTES, -(-sum(size for _, size in files) // MOST_SPLITS))
    for source in (CsvCounts, CsvRecords):
        spark.dataSource.register(source)
    options = {"files": json.dumps(files), "split_bytes": str(width), "chunk_bytes": str(chunk_bytes)}
    counts = {r["split"]: tuple(r)[1:] for r in spark.read.format(CsvCounts.name()).options(**options).load().collect()}
    states, before, file, inside, place, crlf = [], 0, None, 0, 0, False
    for split in _splits(options):
        if split.begin == 0:
            # row ids go on where those of the file before ended; a file's header takes none
            before, file, place, crlf = before + max(place - 1, 0), split.path, 0, counts[split.number][-1]
        states.append((inside, before + place - 1, crlf))
        odd, *begun, _ = counts[split.number]
        place += begun[inside]
        inside ^= odd
        if inside and split.end == split.size:
            raise ValueError(f"a quote is open at the end of {file}")
    names = spark.read.csv(path, header=True, **{k: v for k, v in DIALECT.items()}).columns
    fields = StructType([StructField(name, StringType()) for name in names])
    found = spark.read.format(CsvRecords.name()).options(**options, states=json.dumps(states)).load()
    # a file of lines that end by CRLF has LF for it within quotes too, as Spark's reader gives it
    text = F.when(F.col("crlf"), F.replace("record", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("record"))
    record = F.from_csv(F.regexp_replace(text, r"\r?\n$", ""), F.lit(fields.toDDL()), DIALECT)
    return found.select(F.col("place").alias("row_id"), record.alias("r")).select("row_id", "r.*")
