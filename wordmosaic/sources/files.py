"""Readers for the file formats of local-descriptor data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wordmosaic.functions.names import without
from wordmosaic.functions.vectors import root_vector

#: Bytes of a descriptor record, and header lines of a word file.
RECORD = 128
HEADER_LINES = 2
#: Records read by one partition.
SPLIT_RECORDS = 500_000


class _Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        super().__init__((first, last))


class _RecordReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.split = int(options.get("splitRecords", SPLIT_RECORDS))

    def _file(self) -> tuple[FileSystem, str]:
        """The file system of the path: local without a scheme, else by it (hdfs, s3, gs, file)."""
        return FileSystem.from_uri(self.path) if "://" in self.path else (LocalFileSystem(), self.path.removeprefix("file:"))

    def partitions(self) -> list[InputPartition]:
        system, path = self._file()
        n = system.get_file_info(path).size // RECORD  # a short last record is dropped
        return [_Range(k, min(k + self.split, n)) for k in range(0, n, self.split)] or [_Range(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        first, last = partition.value
        system, path = self._file()
        with system.open_input_file(path) as f:
            f.seek(first * RECORD)
            for k in range(first, last, 10_000):
                n = min(10_000, last - k)
                flat = np.frombuffer(f.read(n * RECORD), np.uint8).astype(np.int16)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, RECORD, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + n)), lists], names=["row", "descriptor"])


class DescriptorRecords(DataSource):
    """``spark.read.format("descriptor_records")``: fixed 128-byte records of unsigned bytes, in ranges of the file."""

    @classmethod
    def name(cls) -> str:
        return "descriptor_records"

    def schema(self) -> str:
        return "row long, descriptor array<smallint>"

    def reader(self, schema) -> DataSourceReader:
        return _RecordReader(self.options)


def descriptor_records(spark: SparkSession, path: str, split_records: int = SPLIT_RECORDS) -> DataFrame:
    """``(row, descriptor)`` of a binary file of 128-byte records, no header; a partial last record is dropped."""
    spark.dataSource.register(DescriptorRecords)
    return spark.read.format("descriptor_records").option("splitRecords", split_records).load(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, pos, line)``: every line of each file with its place in it; files are read whole, one is one image."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    text = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), "\n$", "")
    return whole.select("file", F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def bare_file_name(file: Column) -> Column:
    return without(file, ".txt", ".jpg.hesaff.sift")


def visual_words(spark: SparkSession, path: str) -> DataFrame:
    """``(image_name, pos, word, x, y, a, b, c)`` of word files: two header lines, then ``word x y a b c``.

    Word ids are 1-based in the files and 0-based here. A blank or short line, or one that
    is not a number, raises as the cast does.
    """
    rows = _lines(spark, path).filter(F.col("pos") >= HEADER_LINES).select(bare_file_name(F.col("file")).alias("image_name"), (F.col("pos") - HEADER_LINES).alias("pos"), F.split(F.trim("line"), " ").alias("f"))
    number = lambda k: F.col("f")[k].cast("float")
    return rows.select("image_name", "pos", (F.col("f")[0].cast("int") - 1).alias("word"), number(1).alias("x"), number(2).alias("y"), number(3).alias("a"), number(4).alias("b"), number(5).alias("c"))


def word_bags(spark: SparkSession, path: str) -> DataFrame:
    """``(image_name, words)``: the words of each file in ascending order, repeats kept."""
    return visual_words(spark, path).groupBy("image_name").agg(F.array_sort(F.collect_list("word")).alias("words"))


def word_keypoints(spark: SparkSession, path: str) -> DataFrame:
    """``(image_name, pos, x, y, size)``: keypoints of size 1; the shape parameters are dropped."""
    return visual_words(spark, path).select("image_name", "pos", "x", "y", F.lit(1.0).alias("size"))


def word_file_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(image_name, count)``: the descriptor count in the second header line."""
    return _lines(spark, path).filter("pos = 1").select(bare_file_name(F.col("file")).alias("image_name"), F.trim("line").cast("long").alias("count"))


def image_order(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, name)`` of a file with one image name per line, order kept, blank lines left out."""
    return _lines(spark, path).filter(F.trim("line") != "").select("pos", F.trim("line").alias("name"))


def sift_files(spark: SparkSession, path: str, root: bool = True) -> DataFrame:
    """``(image_name, desc_id, x, y, a, b, c, descriptor, kind)`` of detector output.

    The second line is the number n of rows; exactly n rows ``x y a b c d0 d1 ...`` follow,
    later lines are ignored and fewer raise. With ``root``, descriptors are in root form.
    """
    lines = _lines(spark, path)
    n = lines.filter("pos = 1").select("file", F.trim("line").cast("int").alias("n"))
    rows = lines.filter("pos >= 2").join(n, "file").filter(F.col("pos") - 2 < F.col("n"))
    f = F.transform(F.split(F.trim("line"), " "), lambda x: x.cast("float"))
    parsed = rows.select("file", (F.col("pos") - 2).alias("desc_id"), f.alias("f"), "n")
    have = parsed.groupBy("file").agg(F.count(F.lit(1)).alias("have"))
    short = n.join(have, "file", "left").filter(F.coalesce("have", F.lit(0)) < F.col("n"))
    checked = parsed.join(short.select("file", F.lit(True).alias("short")), "file", "left")
    ok = F.when(F.col("short"), F.raise_error(F.concat(F.lit("fewer rows than announced in "), F.col("file"))).cast("boolean")).otherwise(F.lit(True))
    d = F.slice("f", 6, 4096)
    vector = F.transform(root_vector(d), lambda x: x.cast("float")) if root else d
    cols = [F.col("f")[k].alias(c) for k, c in enumerate(("x", "y", "a", "b", "c"))]
    return checked.filter(ok).select(bare_file_name(F.col("file")).alias("image_name"), "desc_id", *cols, vector.alias("descriptor"), F.lit("rootsift" if root else "sift").alias("kind"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pictures: Spark's ``image`` source."""
    return spark.read.format("image").option("dropInvalid", True).load(path)


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(path, length, content)`` of the files of a folder."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "length", "content")


def listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(path, length)`` of the files of a folder in the order of their names; contents are not read."""
    return files(spark, path, pattern).select("path", "length").orderBy(F.element_at(F.split("path", "/"), -1), "path")
