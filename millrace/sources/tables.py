"""Tables in and out: any format of Spark's readers and writers, chosen by suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = {".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc", ".avro": "avro"}


def format_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    for suffix, kind in FORMATS.items():
        if name.endswith((suffix, suffix + ".gz", suffix + ".zst")):
            return kind
    raise ValueError(f"Unsupported file format: {path}")


def read_table(spark: SparkSession, path: str, schema: str | None = None, **options: object) -> DataFrame:
    """CSV has a header and inferred types unless a schema says otherwise."""
    kind = format_of(path)
    if kind == "csv":
        options = {"header": True, "inferSchema": schema is None, "sep": "\t" if path.endswith(".tsv") else ","} | options
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_table(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite", partition_by: list[str] | None = None, **options: object) -> None:
    """A folder of part files; single_file writes one part, which only small results bear."""
    kind = format_of(path)
    if kind == "csv":
        options = {"header": True} | options
    writer = (df.coalesce(1) if single_file else df).write.mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(path)
