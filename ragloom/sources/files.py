"""Reading document folders and writing tables."""

from __future__ import annotations

import json
import tempfile
import uuid

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import snapshots


def text_dir(spark: SparkSession, path: str, glob: str = "*.{txt,md}", recursive: bool = True) -> DataFrame:
    """doc_id and source (file name), text, one row a file. A missing folder is a FileNotFoundError.

    Without ``recursive`` files below other folders are left out, also below those named as partitions are (key=value).
    """
    try:
        df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"there is no folder of documents at {path}") from e
    if not recursive:
        fs, at = snapshots.at(spark, path)
        deep = fs.makeQualified(at).toUri().getPath().rstrip("/").count("/") + 1
        df = df.where(F.regexp_count(F.regexp_replace("_metadata.file_path", "^[^:/]+:(//[^/]*)?(?=/)", ""), F.lit("/")) == deep)
    return df.select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"), F.col("_metadata.file_name").alias("source"))


def text_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"), F.col("_metadata.file_name").alias("source"))


def binary_dir(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name, path, length, modificationTime and content of every file; a listing doesn't read the content."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", "modificationTime", "content")


def pdf_dir(spark: SparkSession, path: str, parse=None) -> DataFrame:
    """doc_id, text, source of every PDF, by ``parse`` (bytes -> text) or by pypdf where that is installed."""

    def run(batches):
        read = parse or _pypdf()
        for b in batches:
            texts = pa.array([read(c) for c in b.column("content").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), texts, b.column("doc_id")], names=["doc_id", "text", "source"])

    return binary_dir(spark, path, "*.pdf").select(F.col("name").alias("doc_id"), "content").mapInArrow(run, "doc_id string, text string, source string")


def _pypdf():
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("reading PDF needs a parser: pass parse= or install pypdf") from e
    import io

    return lambda data: "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages)


def folder(spark: SparkSession, path: str, parse=None) -> DataFrame:
    """All text files, then all PDF files."""
    return text_dir(spark, path).unionByName(pdf_dir(spark, path, parse))


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def last_write_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Keyed put: of rows with one key the one of the largest ``order`` stays."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def find_by_id(df: DataFrame, key: str, value) -> DataFrame:
    """The row of that id, or no row; of several, one."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def declared(df: DataFrame, schema: StructType | str) -> DataFrame:
    """``df`` in the columns and types of a declared schema; a missing column is null, another one is an error."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if extra := set(df.columns) - set(schema.names):
        raise ValueError(f"columns that aren't declared: {sorted(extra)}")
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def rebuild(df: DataFrame, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Full, idempotent rebuild of a plain folder, in a declared schema if one is given; the rows can be read as soon as it returns.

    The rows are written beside the old ones, which are moved away when all are there: ``df`` may read what it replaces, and a rebuild
    that fails leaves the old rows. Readers that must not see the moment between the two moves use `versioned`.
    """
    spark = df.sparkSession
    df = df if schema is None else declared(df, schema)
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    fs, at = snapshots.at(spark, path)
    there = fs.exists(at)
    if there and not fs.rename(at, snapshots.at(spark, old)[1]):
        raise OSError(f"the rows at {path} can't be moved")
    if not fs.rename(snapshots.at(spark, new)[1], at):
        if there:
            fs.rename(snapshots.at(spark, old)[1], at)
        raise OSError(f"the new rows can't be moved to {path}")
    if there:
        fs.delete(snapshots.at(spark, old)[1], True)
    spark.catalog.refreshByPath(path)
    return spark.read.schema(df.schema).parquet(path)


def versioned(df: DataFrame, path: str, schema: StructType | str | None = None) -> DataFrame:
    """`rebuild` as a new version of the table at ``path`` (see `snapshots`); older ones stay readable until they are pruned."""
    spark = df.sparkSession
    df = df if schema is None else declared(df, schema)
    before, _ = snapshots.manifest(spark, path)
    data = snapshots.fresh()
    df.write.parquet(f"{path}/{data}")
    snapshots.publish(spark, path, {"data": data, "schema": df.schema.json()}, before)
    return read(spark, path)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table that `versioned` wrote, in its last or an older version. FileNotFoundError where there is none."""
    _, says = snapshots.manifest(spark, path, version)
    if not says:
        raise FileNotFoundError(f"there is no table at {path}")
    return spark.read.schema(StructType.fromJson(json.loads(says["schema"]))).parquet(f"{path}/{says['data']}")


def table_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A stored table; one that can't be found is empty, so that what is looked up in it falls back."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def in_memory(df: DataFrame, name: str) -> DataFrame:
    """A table kept by the executors (spilled to their disks) and known to SQL under ``name`` for the session."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.createOrReplaceTempView(name)
    return df


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def index(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table to the folder that all executors share and read it again, as an index that queries reuse."""
    return written(df, f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


#: Readers hold a row group of nested columns at once, many times its size in the file; rows of an index have up to a few MB, so the
#: writer looks at the size from the first rows on.
ROW_GROUP = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4}


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table to a new folder, in small row groups, and read it from there."""
    df.write.options(**ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a written table that go to all tasks, so that the large table it is joined with isn't shuffled; more rows are shuffled.
FEW = 200_000


def few(df: DataFrame, name: str) -> DataFrame:
    """`index` for narrow rows that are looked up in a large table."""
    df = index(df, name)
    return F.broadcast(df) if df.count() <= FEW else df


_local: list[str] = []


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests, one temporary folder for the process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="ragloom-"))
    return path or _local[0]
