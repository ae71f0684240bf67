"""Stored tables: tiles, documents, postings, features."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilequarry.functions.scalars import has_suffix
from tilequarry.operators import layout
from tilequarry.sources.geotiff import _by_value


def write_tiles(tiles: DataFrame, path: str, partitions: int | None = None) -> None:
    """Tiles in curve order, a folder per dataset.

    One range shuffle on (dataset_uid, sfc) puts neighbours into the same files, so
    the extent columns' file statistics prune region queries.  A dataset that holds
    most tiles is cut into many ranges.
    """
    keys = ["dataset_uid", "sfc"]
    ranged = tiles.repartitionByRange(partitions, *keys) if partitions else tiles.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("dataset_uid").parquet(path)


def read_tiles(spark: SparkSession, path: str, dataset_uids: list[str] | None = None) -> DataFrame:
    """Stored tiles; naming datasets reads only their folders."""
    tiles = _read_partitioned(spark, path)
    return tiles if dataset_uids is None else tiles.where(F.col("dataset_uid").isin(dataset_uids))


def write_layer(tiles: DataFrame, path: str, partitions: int | None = None) -> None:
    """Tiles, and beside them the layouts of their datasets, taken from the tiles as written."""
    write_tiles(tiles, f"{path}/tiles", partitions)
    layout.stored_layouts(read_tiles(tiles.sparkSession, f"{path}/tiles")).write.mode("overwrite").parquet(f"{path}/layouts")


def read_layer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tiles and layouts of a stored layer."""
    return read_tiles(spark, f"{path}/tiles"), spark.read.parquet(f"{path}/layouts")


def _read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """A table with a folder per dataset; without a schema 00000001 would come back as a number."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name == "dataset_uid" else f for f in found.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def write_mosaic(mosaic: DataFrame, path: str, partitions: int | None = None) -> None:
    """A mosaic in row bands; no part of it is ever gathered."""
    keys = ["band_row", "gy", "gx"]
    ranged = mosaic.repartitionByRange(partitions, *keys) if partitions else mosaic.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """Tile documents, a folder per dataset."""
    docs.write.mode("overwrite").partitionBy("dataset_uid").parquet(path)


def write_document_lines(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """Lines of tile documents as text, a folder per document.

    One range shuffle by (document, place of the line) and a sort that may spill: a task streams its lines out, and a
    document with very many is cut into several files, whose names are in the order of its lines.  Ranges follow a hash of the
    document, so that short documents, which cost a folder each and hardly a byte, are spread among the long ones; and there are
    as many as shuffles have partitions, since few bytes would be joined to few tasks.

    In a folder of the local or a mounted file system tasks make the files themselves, as Hadoop's starts three processes for a document
    there if its native library is missing.  Elsewhere Spark writes them.
    """
    keys, spark = ["dataset_uid", "doc_path", "place", "fid"], lines.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.repartitionByRange(n, F.xxhash64("dataset_uid", "doc_path"), *keys)
    text = ranged.sortWithinPartitions(*keys).select("dataset_uid", "doc_path", "line")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if store.getScheme() != "file":
        text.write.mode("overwrite").partitionBy("dataset_uid", "doc_path").text(path)
        return
    store.delete(at, True)
    store.mkdirs(at)
    root, job = store.makeQualified(at).toUri().getPath(), uuid.uuid4().hex
    as_bytes = text.select(*[F.col(c).cast("binary") for c in text.columns])
    as_bytes.mapInArrow(functools.partial(_by_value(_write_folders), root, job), "files bigint").agg(F.sum("files")).first()
    store.create(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")).close()


#: How Spark names the folder of a partition value that is null or empty.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: What Spark writes as %XX in the name of a partition's folder.
_ESCAPED = {c: f"%{c:02X}".encode() for c in (*range(1, 32), *b"\"#%'*/:=?\\{[]^", 127)}


def _folder(name: str, value: bytes | None) -> bytes:
    """The folder of one partition value, as Spark names it."""
    text = b"".join(_ESCAPED.get(c) or bytes((c,)) for c in value) if value else _NO_VALUE.encode()
    return name.encode() + b"=" + text


def _write_folders(root: str, job: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (dataset_uid, doc_path, line) of one task as a file for each document; a file gets its name when it is whole.

    A task that is run again writes the same files.
    """
    context = TaskContext.get()
    name = f"part-{context.partitionId():05d}-{job}.c000.txt".encode()
    hidden = b".%s.%d" % (name, context.taskAttemptId())
    files, document, out, folder = 0, None, None, b""

    def close() -> None:
        if out is not None:
            out.close()
            os.replace(os.path.join(folder, hidden), os.path.join(folder, name))

    try:
        for batch in batches:
            for uid, doc, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if out is None or (uid, doc) != document:
                    close()
                    document, files = (uid, doc), files + 1
                    folder = os.path.join(root.encode(), _folder("dataset_uid", uid), _folder("doc_path", doc))
                    os.makedirs(folder, exist_ok=True)
                    out = open(os.path.join(folder, hidden), "wb")
                out.write((line or b"") + b"\n")
        close()
    except BaseException:
        if out is not None and not out.closed:
            out.close()
        raise
    yield pa.RecordBatch.from_pydict({"files": [files]})


def read_document_lines(spark: SparkSession, path: str) -> DataFrame:
    """(dataset_uid, doc_path, line) of ``write_document_lines``; a task reads a part of a document's lines, or many short documents.

    Names are taken from the files' paths, row by row: as partitions the driver would go through all folders.  Spark counts a file
    as some megabytes, so there would also be a task for every few documents.
    """
    found = spark.read.schema("value string").option("recursiveFileLookup", "true").text(path)
    folders = F.regexp_extract(_unescaped(F.col("_metadata.file_path")), r"/dataset_uid=([^/]*)/doc_path=([^/]*)/[^/]*$", 0)
    parts = found.select(F.split(folders, "/").alias("parts"), F.col("value").alias("line"))

    def named(i: int, name: str) -> Column:
        text = F.substring(F.get("parts", F.lit(i)), len(name) + 2, 1 << 30)
        return F.when(text != _NO_VALUE, _unescaped(text)).alias(name)

    lines = parts.select(named(1, "dataset_uid"), named(2, "doc_path"), "line")
    n_bytes = int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return lines.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-n_bytes // most)))


def _unescaped(text: Column) -> Column:
    """Text with its %XX as characters; a plus stays one."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return _read_partitioned(spark, path)


def read_document_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_path, doc) of a folder of .json document files, one file each."""
    texts = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(
        path, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("doc_path"), F.col("value").alias("doc"))


def write_postings(postings: DataFrame, path: str) -> None:
    """Postings clustered by keyword, so a search reads the row groups of its keywords only.

    The range shuffle cuts a keyword that is on every tile into many files.
    """
    postings.repartitionByRange("kw", *[c for c in postings.columns if c != "kw"]).sortWithinPartitions("kw").write.mode(
        "overwrite").parquet(path)


def write_bitmaps(bitmaps: DataFrame, path: str) -> None:
    """Bitmaps clustered by keyword and block, so a search reads the row groups of its keywords only."""
    keys = ["kw", "dataset_uid", "block"]
    bitmaps.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_index_text(rendered: DataFrame, path: str) -> None:
    rendered.select("line").write.mode("overwrite").text(path)


def read_index_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text index, for ``index.load_text``."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def write_geojson(rendered: DataFrame, path: str) -> None:
    """Geometry and attribute texts, a folder per feature name."""
    for part in ("geometry", "data"):
        rendered.select("name", part).write.mode("overwrite").partitionBy("name").text(f"{path}/{part}")


def write_geojson_lines(lines: DataFrame, path: str) -> None:
    """Whole features, one a line."""
    lines.select("line").write.mode("overwrite").text(path)


def write_feature_json(data: DataFrame, path: str) -> None:
    """Attribute objects of filtered features, one JSON object per line."""
    data.select("data").write.mode("overwrite").text(path)


def list_files(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """(path, length) of the files with one of the suffixes; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.where(has_suffix(F.col("path"), suffixes))
