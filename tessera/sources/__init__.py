"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a dataset folder (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Format by extension, for reading a file directly.
FORMATS = {".csv.gz": "csv", ".csv": "csv", ".tsv": "tsv", ".jsonl": "json", ".ndjson": "json", ".json": "json", ".parquet": "parquet"}


def read(spark: SparkSession, path: str, kind: str | None = None, *, header: bool = True, delimiter: str | None = None, schema: str | None = None) -> DataFrame:
    """A CSV, TSV, JSON (array of records or lines) or Parquet file or folder."""
    kind = kind or next((k for end, k in FORMATS.items() if path.rstrip("/").lower().endswith(end)), None)
    if kind == "parquet":
        return spark.read.parquet(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in ("csv", "tsv"):
        options = {"header": header, "sep": delimiter or ("\t" if kind == "tsv" else ","), "inferSchema": schema is None, "escape": '"'}
        return reader.options(**options).csv(path)
    if kind == "json":
        lines = reader.json(path)
        # An array of records is one line or many; records on lines have no corrupt part.
        return reader.option("multiLine", True).json(path) if "_corrupt_record" in lines.columns else lines
    raise ValueError(f"no format for {path}")


def write(df: DataFrame, path: str, kind: str = "parquet", *, header: bool = True, delimiter: str | None = None, mode: str = "errorifexists") -> None:
    """COPY TO: a folder of part files; JSON is one record a line."""
    writer = df.write.mode(mode)
    if kind == "parquet":
        writer.parquet(path)
    elif kind in ("csv", "tsv"):
        writer.options(header=header, sep=delimiter or ("\t" if kind == "tsv" else ","), escape='"').csv(path)
    elif kind in ("json", "ndjson", "jsonl"):
        writer.json(path)
    else:
        raise ValueError(kind)


def retrieve(df: DataFrame, ids: list, key: str = "_id") -> DataFrame:
    """Rows by id; the filter reaches the Parquet scan."""
    from pyspark.sql import functions as F

    return df.where(F.col(key).isin(*ids))


def blob_range(column: str, offset, length):
    """Bytes [offset, offset + length) of a binary column; both are numbers or columns."""
    from pyspark.sql import functions as F

    return F.substring(F.col(column), offset + 1, length)
