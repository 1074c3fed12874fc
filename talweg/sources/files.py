"""Files as input and output: rasters, manifests, flowlines, sinks, and the shared folder between stages."""

from __future__ import annotations

import json
import re
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a folder of our own only on one machine where none is configured."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="talweg-checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


#: With this setting Spark deletes a query's shuffle files when the query ends; lost ones are made again on demand.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: what follows reads it instead of working it out again.

    The shuffle files behind it go at once, and so do `done`, tables cut before that nothing reads after this."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    for table in done:
        drop(table)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(table: DataFrame) -> None:
    """Deletes a table that cut() made."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.cut_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: TIFF field types with their sizes and struct codes, and the tags of a single-band raster.
_TYPES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I"), 11: (4, "f"), 12: (8, "d")}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _ROWS, _COUNTS, _FORMAT = 256, 257, 258, 259, 273, 278, 279, 339


def decode_raster(data: bytes) -> tuple[int, int, np.ndarray]:
    """(h, w, values) of an uncompressed single-band TIFF in strips, or of a two-dimensional npy array."""
    if data[:6] == b"\x93NUMPY":
        import io

        grid = np.load(io.BytesIO(data), allow_pickle=False)
        return grid.shape[0], grid.shape[1], grid.astype(np.float64).reshape(-1)
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    (n,) = struct.unpack_from(f"{order}H", data, at)
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        if kind not in _TYPES:
            continue
        size, code = _TYPES[kind]
        place = at + 2 + 12 * k + 8
        if size * count > 4:
            (place,) = struct.unpack_from(f"{order}I", data, place)
        tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
    if tags.get(_COMPRESSION, (1,))[0] != 1:
        raise ValueError("only uncompressed rasters are read")
    bits, form = tags.get(_BITS, (8,))[0], tags.get(_FORMAT, (1,))[0]
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}")
    strips = b"".join(data[o : o + c] for o, c in zip(tags[_OFFSETS], tags[_COUNTS], strict=True))
    h, w = tags[_HEIGHT][0], tags[_WIDTH][0]
    return h, w, np.frombuffer(strips, kind, h * w).astype(np.float64)


def encode_tiff(grid: np.ndarray) -> bytes:
    """A float32 grid as an uncompressed single-band TIFF of one strip."""
    body = grid.astype("<f4").tobytes()
    h, w = grid.shape
    fields = [(_WIDTH, 4, w), (_HEIGHT, 4, h), (_BITS, 3, 32), (_COMPRESSION, 3, 1), (_OFFSETS, 4, 8), (_ROWS, 4, h), (_COUNTS, 4, len(body)), (_FORMAT, 3, 3)]
    head = struct.pack("<2sHI", b"II", 42, 8 + len(body))
    return head + body + struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in fields) + struct.pack("<I", 0)


RASTER = T.StructType([T.StructField("path", T.StringType()), T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("z", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])


def read_rasters(spark: SparkSession, folder: str, pattern: str = "*.tif", nodata: float | None = None) -> DataFrame:
    """path, h, w, z, error: one row for each file; unreadable files have an error and no cells. Nodata and non-finite cells are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    h, w, z = decode_raster(data)
                    bad = ~np.isfinite(z) | ((z == nodata) if nodata is not None else False)
                    out.append((path, h, w, pa.array(z, mask=bad).to_pylist(), None))
                except (ValueError, KeyError, struct.error) as e:
                    out.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string()), strict=True)], RASTER.names)

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content").mapInArrow(run, RASTER)


MANIFEST = "selection struct<created:string,n_candidates_scored:int,n_selected:int,density_metric:string,rationale:string>, tiles array<struct<key:string,bbox:array<double>,nhd_flowline_count:int,nhd_total_length_km:double,area_km2:double,nhd_drainage_density:double,province:string,quintile:int>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each tile of a JSON manifest."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).select(F.explode("tiles").alias("t")).select("t.*")


def read_flowlines(spark: SparkSession, path: str, tile: Column) -> DataFrame:
    """line_id, tile, vertices: lines of a GeoJSON feature collection; multi-part lines give one row for each part."""
    schema = "features array<struct<id:string,geometry:struct<type:string,coordinates:string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("n", "f"))
    parts = F.when(F.col("f.geometry.type") == "MultiLineString", F.from_json("f.geometry.coordinates", "array<array<array<double>>>")).otherwise(F.array(F.from_json("f.geometry.coordinates", "array<array<double>>")))
    out = rows.where(F.col("f.geometry.type").isin("LineString", "MultiLineString")).select(F.col("n").alias("line"), tile.alias("tile"), F.posexplode(parts).alias("part", "xy"))
    return out.select(F.concat_ws("_", F.col("line").cast("string"), F.col("part").cast("string")).alias("line_id"), "tile", F.transform("xy", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("vertices"))


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Rows of CSV files under a schema; a field that does not parse is null, and only the columns asked for are parsed."""
    return spark.read.schema(schema).option("header", header).csv(path)


def written(df: DataFrame, kind: str, **options) -> str:
    """The path, in the shared folder, of df in another format."""
    path = f"{shared_folder(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.options(**options).format(kind).save(path)
    return path


class PagedReader(DataSourceReader):
    """One partition for each key: its pages in turn, until one is empty, is the last, or `most` have been read."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.folder, self.keys = schema, options["path"], options["keys"].split(",")
        self.size, self.most = int(options.get("size", "2000")), int(options.get("most", "200"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in self.keys]

    def page(self, key: str, offset: int) -> dict:
        """A page by key and offset; a service would be asked here."""
        with open(f"{self.folder}/{key}/{offset}.json", encoding="utf-8") as f:
            return json.load(f)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for k in range(self.most):
            page = self.page(partition.value, k * self.size)
            rows = page.get("features") or []
            for r in rows:
                yield (partition.value, *(r.get("attributes", {}).get(c) for c in self.schema.names[1:]))
            if not rows or not page.get("exceededTransferLimit"):
                return


class Paged(DataSource):
    """A paged service as a source, `paged`: the key, then the attributes that the schema names. Options: path, keys (comma-joined), size, most."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(schema, self.options)


def write_by_region(df: DataFrame, path: str, region: str = "province") -> None:
    """Rows under a folder for each region; a row may be there for several regions."""
    df.write.mode("overwrite").partitionBy(region).parquet(path)


def write_provenance(spark: SparkSession, path: str, source: str, parameters: dict[str, str], commit: str | None = None) -> None:
    """Appends one row of when, from what and how a result was made."""
    row = spark.createDataFrame([(commit, source, parameters)], "git_commit string, source string, parameters map<string,string>")
    row.select(F.current_timestamp().alias("generated_at"), "*").write.mode("append").json(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table of at most `most` rows as Markdown."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])
