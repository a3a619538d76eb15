"""Files of triples, lists, dictionaries and N-Triples.

The binary formats hold big-endian numbers.  A path is one on a file system that
all executors see, or the URI of one (``hdfs://``, ``s3://``, ``gs://``, ``file://``).
"""

from __future__ import annotations

import gzip
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.workspace import Workspace

RECORD = 24
CHUNK = 1 << 20


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _inflate(content: bytes) -> Iterator[bytes]:
    """The unpacked bytes of a gzip stream, member after member, in bounded pieces."""
    data = content
    while data:
        unpack = zlib.decompressobj(31)
        while data and not unpack.eof:
            yield unpack.decompress(data, CHUNK * RECORD)
            data = unpack.unconsumed_tail
        data = unpack.unused_data


def read_triple_files(spark: SparkSession, path: str, order: str = "spo") -> DataFrame:
    """``(s, p, o, src_file)`` of gzip files of 24-byte records, whose three terms come in ``order``.

    A file is read in one task, as gzip can't be split, but in bounded pieces.
    A rest of less than one record at the end is dropped.
    """
    at = [order.index(c) for c in "spo"]

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rest = b""
                for piece in _inflate(content.as_py()):
                    rest += piece
                    n = len(rest) // RECORD * RECORD
                    terms = np.frombuffer(rest[:n], ">i8").astype(np.int64).reshape(-1, 3)
                    rest = rest[n:]
                    columns = [pa.array(terms[:, i]) for i in at]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array([name] * len(terms), pa.string())], ["s", "p", "o", "src_file"]
                    )

    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.startswith("_")).select(name.alias("name"), "content").mapInArrow(
        run, "s bigint, p bigint, o bigint, src_file string"
    )


def write_triple_files(triples: DataFrame, path: str, order: str = "spo") -> int:
    """Writes the complete rows as gzip files of 24-byte records, one a partition; returns the rows.

    Each file appears under its name only when it is complete, so a task that is
    run again leaves no half-written or doubled one.
    """
    there, folder = _place(path)
    there.create_dir(folder)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, folder = _place(path)
        hidden = f"{folder}/_{uuid.uuid4().hex}"
        n = 0
        with fs.open_output_stream(hidden, compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="wb") as f:
            for b in batches:
                terms = np.column_stack([c.to_numpy() for c in b.columns]).astype(">i8") if b.num_rows else None
                if terms is not None:
                    f.write(terms.tobytes())
                    n += b.num_rows
        if n:
            fs.move(hidden, f"{folder}/{order}-{part:05d}_00")
        else:
            fs.delete_file(hidden)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = triples.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").select(*order)
    done = rows.mapInArrow(run, "n bigint").agg(F.sum("n").alias("n")).first()
    return done["n"] or 0


def first_elements(spark: SparkSession, path: str) -> DataFrame:
    """``(src_file, first_term, second_term, third_term)``: the first record of each triple file."""

    def run(batches):
        for b in batches:
            names, rows = [], []
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                head = zlib.decompressobj(31).decompress(content.as_py(), RECORD)
                if len(head) == RECORD:
                    names.append(name)
                    rows.append(struct.unpack(">3q", head))
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array(c, pa.int64()) for c in columns)],
                ["src_file", "first_term", "second_term", "third_term"],
            )

    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.startswith("_")).select(name.alias("name"), "content").mapInArrow(
        run, "src_file string, first_term bigint, second_term bigint, third_term bigint"
    )


def read_list_file(spark: SparkSession, path: str) -> DataFrame:
    """``(head, list_id, pos, el)`` of gzip list files: head, number of lists, and each list's size and elements."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                raw = b"".join(_inflate(content.as_py()))
                at, rows = 0, []
                while at + 12 <= len(raw):
                    head, lists = struct.unpack_from(">qi", raw, at)
                    at += 12
                    for k in range(lists):
                        (size,) = struct.unpack_from(">i", raw, at)
                        els = struct.unpack_from(f">{size}q", raw, at + 4)
                        at += 4 + 8 * size
                        rows += [(head, k, i, e) for i, e in enumerate(els)]
                columns = list(zip(*rows)) or [[]] * 4
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], ["head", "list_id", "pos", "el"]
                )

    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(run, "head bigint, list_id int, pos int, el bigint")


def write_list_file(lists: DataFrame, path: str) -> None:
    """Writes lists to one gzip file, as the format has it; they pass through the driver one after the other."""
    fs, at = _place(path)
    fs.create_dir(posixpath.dirname(at) or ".")
    rows = lists.select("head", "list_id", "pos", "el").na.drop().distinct()
    els = F.transform(F.array_sort(F.collect_list(F.struct("pos", "el"))), lambda x: x["el"])
    whole = rows.groupBy("head", "list_id").agg(els.alias("els"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("list_id", "els"))), lambda x: x["els"])
    with fs.open_output_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="wb") as f:
        for r in whole.groupBy("head").agg(own.alias("lists")).orderBy("head").toLocalIterator():
            f.write(struct.pack(">qi", r["head"], len(r["lists"])))
            for x in r["lists"]:
                f.write(struct.pack(f">i{len(x)}q", len(x), *x))


INDEX, TEXTS, ENTRY = "index_sorted.data", "text.data", 20


def read_dictionary_files(spark: SparkSession, path: str) -> DataFrame:
    """``(id, text)`` of a folder with ``index_sorted.data`` (id, offset, length) and ``text.data``."""
    there, folder = _place(path)
    n = there.get_file_info(f"{folder}/{INDEX}").size // ENTRY
    step = CHUNK // 16

    def run(batches):
        fs, folder = _place(path)
        for b in batches:
            for chunk in b.column(0).to_pylist():
                with fs.open_input_file(f"{folder}/{INDEX}") as f, fs.open_input_file(f"{folder}/{TEXTS}") as t:
                    f.seek(chunk * step * ENTRY)
                    raw = f.read(ENTRY * min(step, n - chunk * step))
                    ids, out = [], []
                    for key, offset, length in struct.iter_unpack(">qqi", raw):
                        t.seek(offset)
                        ids.append(key)
                        out.append(t.read(length).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["id", "text"])

    return spark.range(max(1, -(-n // step))).mapInArrow(run, "id bigint, text string")


def write_dictionary_files(dictionary: DataFrame, path: str) -> None:
    """Writes the two dictionary files, the index in the order of ids.

    Tasks write the stretches of the sorted order as files of their own; what
    comes to the driver is each stretch's size, and the bytes of the finished
    stretches, which it copies one after the other, as the format is two files.
    """
    spark = dictionary.sparkSession
    there, folder = _place(path)
    there.create_dir(folder)
    rows = dictionary.where("id IS NOT NULL AND text IS NOT NULL").groupBy("id").agg(F.min("text").alias("text"))
    rows = Workspace(spark, "dictionary").save(rows, "texts")  # ranges are found in one pass and used in another
    run_id = uuid.uuid4().hex

    def run(batches):
        fs, folder = _place(path)
        name, first, size, n = uuid.uuid4().hex, None, 0, 0
        with fs.open_output_stream(f"{folder}/_{run_id}-{name}-i", compression=None) as i, fs.open_output_stream(f"{folder}/_{run_id}-{name}-t", compression=None) as t:
            for b in batches:
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    raw = text.encode()
                    i.write(struct.pack(">qqi", key, size, len(raw)))
                    t.write(raw)
                    first = key if first is None else first
                    size, n = size + len(raw), n + 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([size]), pa.array([n])], ["name", "first", "size", "n"])

    parts = rows.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(run, "name string, first bigint, size bigint, n bigint").where("n > 0").collect()
    offset = 0
    with there.open_output_stream(f"{folder}/{INDEX}", compression=None) as index, there.open_output_stream(f"{folder}/{TEXTS}", compression=None) as texts:
        for p in sorted(parts, key=lambda p: p["first"]):
            with there.open_input_stream(f"{folder}/_{run_id}-{p['name']}-i", compression=None) as f:
                while raw := f.read(ENTRY * 4096):
                    entries = np.frombuffer(raw, [("id", ">i8"), ("offset", ">i8"), ("length", ">i4")]).copy()
                    entries["offset"] += offset
                    index.write(entries.tobytes())
            with there.open_input_stream(f"{folder}/_{run_id}-{p['name']}-t", compression=None) as f:
                while raw := f.read(CHUNK):
                    texts.write(raw)
            offset += p["size"]
    for info in there.get_file_info(pafs.FileSelector(folder)):
        if info.base_name.startswith(f"_{run_id}"):
            there.delete_file(info.path)


def check_dictionary_sorted(spark: SparkSession, path: str) -> bool:
    """Whether the ids of ``index_sorted.data`` rise strictly: each task looks at a stretch and the entry before it."""
    there, folder = _place(path)
    n = there.get_file_info(f"{folder}/{INDEX}").size // ENTRY
    step = CHUNK

    def run(batches):
        fs, folder = _place(path)
        for b in batches:
            for chunk in b.column(0).to_pylist():
                with fs.open_input_file(f"{folder}/{INDEX}") as f:
                    first = max(0, chunk * step - 1)
                    f.seek(first * ENTRY)
                    raw = f.read(ENTRY * (min(n, (chunk + 1) * step) - first))
                ids = np.frombuffer(raw, [("id", ">i8"), ("offset", ">i8"), ("length", ">i4")])["id"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([int((np.diff(ids) <= 0).sum())])], ["wrong"])

    return not spark.range(max(1, -(-n // step))).mapInArrow(run, "wrong bigint").where("wrong > 0").limit(1).count()


_TERM = r'(<[^<>"{}|^`\\\s]*>|_:[\w.\-]+|"(?:[^"\\]|\\.)*+"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^<>\s]*>)?)'
_LINE = rf"\A\s*{_TERM}\s+{_TERM}\s+{_TERM}\s*\.\s*(?:#.*)?\z"


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """``(subject, predicate, object, line)`` of N-Triples lines; the terms of a malformed line are null.

    Blank lines and comments give no row.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line")).where(~F.col("line").rlike(r"\A\s*(?:#.*)?\z"))
    parts = [F.regexp_extract("line", _LINE, i) for i in (1, 2, 3)]
    good = F.col("line").rlike(_LINE)
    return lines.select(
        *[F.when(good, x).alias(n) for n, x in zip(("subject", "predicate", "object"), parts)], "line"
    )


def encode(ntriples: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(triples, dictionary)``: texts replaced by ids, and the dictionary with the new ones added.

    New ids follow the largest known one, are unique, and leave gaps.  They are
    written down first, so a recomputed task gives the same ids.
    """
    spark = ntriples.sparkSession
    ws = Workspace(spark, "encode")
    rows = ntriples.where("subject IS NOT NULL").select("subject", "predicate", "object")
    known = dictionary.where("id IS NOT NULL AND text IS NOT NULL").groupBy("text").agg(F.min("id").alias("id"))
    texts = rows.select(F.explode(F.array("subject", "predicate", "object")).alias("text")).distinct()
    top = known.agg(F.coalesce(F.max("id"), F.lit(99))).first()[0]
    new = texts.join(known, "text", "left_anti").withColumn("id", F.monotonically_increasing_id() + F.lit(top + 1))
    new = ws.save(new.select("id", "text"), "new")
    every = known.select("id", "text").unionByName(new)
    out = rows
    for column, c in (("subject", "s"), ("predicate", "p"), ("object", "o")):
        out = out.join(every.select(F.col("text").alias(column), F.col("id").alias(c)), column)
    return out.select("s", "p", "o"), every


def local_files(path: str) -> list[str]:
    """The files of a folder that are complete."""
    fs, folder = _place(path)
    return sorted(x.path for x in fs.get_file_info(pafs.FileSelector(folder)) if not x.base_name.startswith("_"))
