"""Reading document tables and stored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from themeloom.sources import feather


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ",", multi_line: bool = True
) -> DataFrame:
    """Records with a header. Fields with line breaks need ``multi_line``, which reads a file in one task;
    without it a large file is split."""
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("sep", sep)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_tsv(spark: SparkSession, path: str, schema: StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    return read_csv(spark, path, schema, "\t", multi_line)


def _starts_with_bracket(spark: SparkSession, path: str) -> bool:
    """Whether the first non-blank character is ``[`` (an array of records)."""
    first = (
        spark.read.text(path)
        .select(F.trim(F.col("value")).alias("value"))
        .filter(F.length("value") > 0)
        .select(F.substring("value", 1, 1).alias("c"))
        .head(1)
    )
    return bool(first) and first[0]["c"] == "["


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """An array of records, or one record per line when the content is not an array."""
    if not _starts_with_bracket(spark, path):
        return read_json_lines(spark, path, schema)
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def read_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def read_feather(spark: SparkSession, path: str, schema: StructType | str | None = None, partition_bytes: int | None = None) -> DataFrame:
    """A Feather file or a folder of them; the schema is in their footers, and several tasks read a large file."""
    feather.register(spark)
    reader = spark.read.format(feather.FORMAT)
    if schema is not None:
        reader = reader.schema(schema)
    if partition_bytes:
        reader = reader.option("partitionBytes", partition_bytes)
    return reader.load(path)


READERS = {
    "csv": read_csv,
    "tsv": read_tsv,
    "json": read_json,
    "jsonl": read_json_lines,
    "ndjson": read_json_lines,
    "parquet": read_parquet,
    "feather": read_feather,
}


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def load_documents(
    spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | str | None = None, **options
) -> DataFrame:
    """Read a document table; the format is ``fmt`` or the lower-cased suffix of ``path``.

    ``options`` go to the format's reader, such as ``multi_line=False`` for delimited files without line breaks in their fields.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(f"nothing to read at {path}")
    name = path.rstrip("/").rsplit("/", 1)[-1]
    kind = (fmt or (name.rsplit(".", 1)[1] if "." in name else "")).lower().lstrip(".")
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r} files; there are readers for {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path, schema, **options)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Stored vectors ``<doc_id, embedding>``; an absent path is an error."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"nothing to read at {path}")
    return spark.read.parquet(path)


def attach_vectors(
    docs: DataFrame, vectors: DataFrame, doc_key: str = "doc_id", vector_key: str = "doc_id", missing: str = "drop"
) -> DataFrame:
    """Pair documents with vectors computed earlier, by key.

    ``missing`` says what becomes of documents without a vector: ``drop`` leaves them out, ``keep`` gives
    them nulls, ``error`` stops and tells how many there are.
    """
    if missing not in ("drop", "keep", "error"):
        raise ValueError(f"missing must be drop, keep or error, got {missing!r}")
    if vector_key != doc_key:
        vectors = vectors.withColumnRenamed(vector_key, doc_key)
    if missing == "error":
        lost = docs.join(vectors, doc_key, "left_anti").count()
        if lost:
            raise ValueError(f"{lost} documents have no vector")
    return docs.join(vectors, doc_key, "left" if missing == "keep" else "inner")
