"""Sources: tables, text files, text pairs and lists."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterable, Sequence
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from satzwerk.functions import text as tx


def spread(frame: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Enough partitions to keep every core busy.

    A scan that already has them, as any large one does, is left alone; only a
    few large files cause a shuffle. Call it on a plain scan.
    """
    wanted = partitions or frame.sparkSession.sparkContext.defaultParallelism
    if frame.rdd.getNumPartitions() >= wanted:
        return frame
    return frame.repartition(wanted, *keys)


def read_texts(
    spark: SparkSession,
    path: str,
    id_col: str = "text_id",
    text: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """A parquet table as (id, text); no other column is read."""
    return spread(spark.read.parquet(path).select(id_col, text), id_col, partitions=partitions)


def read_text_files(spark: SparkSession, paths: str | Path | Sequence[str | Path]) -> DataFrame:
    """Each UTF-8 file is one text: text_id, filename, text.

    A list keeps its order (text_id counts from 0), a file named twice comes
    twice, and a file that is not there is an error. A single string is a folder,
    a pattern or a file for Spark to list; text_id is then a hash of the address.
    Addresses may have any scheme that Spark reads.
    """
    if isinstance(paths, (str, Path)):
        files = _whole_files(spark, [str(paths)])
        return files.select(F.xxhash64("_path").alias("text_id"), "filename", "text")
    if not paths:
        return spark.createDataFrame([], "text_id bigint, filename string, text string")
    wanted = [_address(spark, str(path)) for path in paths]
    files = _whole_files(spark, sorted({_no_pattern(path) for path in wanted}))
    missing = set(wanted) - {_decoded(path) for path in files.inputFiles()}
    if missing:
        raise FileNotFoundError(f"no such files: {sorted(missing)[:10]}")
    order = spark.createDataFrame(list(enumerate(wanted)), "text_id bigint, _path string")
    return order.join(files, "_path").select("text_id", "filename", "text")


def _address(spark: SparkSession, path: str) -> str:
    """The address of a file with its scheme and without ``.`` and ``..``."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        jvm = spark.sparkContext._jvm
        default = jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark.sparkContext._jsc.hadoopConfiguration())
        if default.getScheme() == "file":
            path = os.path.abspath(path)
        else:
            path = str(default.toString()).rstrip("/") + posixpath.normpath(posixpath.join("/", path))
    return _one_form(path)


def _one_form(path: str) -> str:
    scheme, _, rest = path.partition(":/") if ":/" in path else ("file", "", path)
    if scheme == "file":
        return "file:///" + posixpath.normpath("/" + rest.lstrip("/")).lstrip("/")
    host, slash, rest = rest.lstrip("/").partition("/")
    return f"{scheme}://{host}{slash}{posixpath.normpath(rest) if rest else rest}"


def _no_pattern(path: str) -> str:
    """The address with the signs of a pattern made plain."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _decoded(address: str) -> str:
    """An address as Spark reports it, in the form of ``_address``."""
    return _one_form(unquote(address))


def _whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """_path, filename and text of each file; Spark leaves out empty files, so these are added."""
    address = plain_address(F.col("_metadata.file_path"))
    full = spark.read.text(paths, wholetext=True).select(
        F.regexp_replace(address, r"\Afile:/+", "file:///").alias("_path"),
        plain_address(F.col("_metadata.file_name")).alias("filename"),
        tx.universal_newlines(F.col("value")).alias("text"),
    )
    empty = [(path, posixpath.basename(path), "") for path in _empty_files(spark, paths)]
    return full.unionByName(spark.createDataFrame(empty, full.schema)) if empty else full


def _empty_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The addresses of empty files, from the listing that Spark itself works by."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = []
    for path in paths:
        system = path_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in system.globStatus(path_of(path)) or ():
            for file in system.listStatus(status.getPath()):
                if file.isFile() and file.getLen() == 0 and file.getPath().getName()[0] not in "._":
                    found.append(_one_form(file.getPath().toString()))
    return found


def plain_address(address: Column) -> Column:
    """An address without its percent signs; a plus is a plus."""
    return F.url_decode(F.replace(address, F.lit("+"), F.lit("%2B")))


def read_text_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header: column 0 is the original, column 1 the corrected text.

    Fields may be quoted and hold line feeds. Columns: row_idx, original, corrected.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    original, corrected = rows.columns[:2]
    pairs = rows.select(
        F.col("_metadata.file_path").alias("_file"),
        F.monotonically_increasing_id().alias("_place"),
        F.col(f"`{original}`").alias("original"),
        F.col(f"`{corrected}`").alias("corrected"),
    )
    return _numbered(pairs).select("row_idx", "original", "corrected")


def _numbered(rows: DataFrame) -> DataFrame:
    """Number the rows 0, 1, 2... by file name and by their place in the file.

    A file with multi-line fields is read by one task, so its rows have
    consecutive places. Only one row per file is put in order; these are few, and
    broadcast if Spark measures them so.
    """
    files = rows.groupBy("_file").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(
        "_file", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return rows.join(starts, "_file").withColumn("row_idx", F.col("_place") + F.col("_shift"))


def texts_from_list(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """Texts the caller holds in memory: text_id, name ("Text 1", ...), text."""
    rows = [(number, f"Text {number + 1}", text) for number, text in enumerate(texts)]
    return spark.createDataFrame(rows, "text_id bigint, name string, text string")


def drop_blank(frame: DataFrame, text: str = "text") -> DataFrame:
    """Keep texts with something in them. Names and the texts themselves stay."""
    return frame.where(tx.strip(F.col(text)) != "")
