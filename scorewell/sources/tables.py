"""Reading input tables and writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewell.functions.exprs import nan_to_null
from scorewell.operators.sampling import stratified_sample

# The encodings offered for CSV files.
ENCODINGS = ["utf-8", "latin-1", "iso-8859-1", "utf-16"]
_JAVA_NAMES = {"latin-1": "ISO-8859-1"}


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str | None = None) -> DataFrame:
    """A table from parquet, CSV, JSON or ORC, with NaN read as missing; a missing path raises."""
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", True)
    try:
        return nan_to_null(reader.load(path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise


def load_csv(
    spark: SparkSession,
    path: str,
    encoding: str = "utf-8",
    max_rows: int | None = None,
    target: str | None = None,
    keys: Sequence[str] = (),
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """A CSV file in a given encoding; bytes that do not decode become U+FFFD.

    The file is read in splits, so there is no chunk loop. With ``max_rows`` the table is sampled
    down to that size, per class of ``target`` where given; ``keys`` identify the rows, else their
    place in the file does.
    """
    if encoding.lower() not in ENCODINGS:
        raise ValueError(f"encoding {encoding!r} is not one of {ENCODINGS}")
    reader = (
        spark.read.option("header", True)
        .option("mode", "PERMISSIVE")
        .option("encoding", _JAVA_NAMES.get(encoding.lower(), encoding))
    )
    if encoding.lower() == "utf-16":
        # Line ends of two-byte text cannot be found from the middle of a file.
        reader = reader.option("multiLine", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    if max_rows is None:
        return df
    if keys:
        return stratified_sample(df, max_rows, keys, target)
    # Rows of a file are told apart by their place in it.
    placed = df.withColumn("__place", F.monotonically_increasing_id())
    return stratified_sample(placed, max_rows, ["__place"], target).drop("__place")


def split_features_target(df: DataFrame, target: str) -> tuple[list[str], str]:
    """Feature names and the target; the table stays one DataFrame."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    return [name for name in df.columns if name != target], target


def write_predictions(df: DataFrame, path: str, fmt: str = "csv", mode: str = "error", partition_by: Sequence[str] = ()) -> None:
    """Input columns and score columns, as one part file per task."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def numeric_schema(names: Sequence[str]) -> T.StructType:
    """A schema of doubles, as for tables of transaction features."""
    return T.StructType([T.StructField(name, T.DoubleType()) for name in names])


def transaction_schema(components: int = 28) -> T.StructType:
    """Time, V1..Vn and Amount."""
    return numeric_schema(["Time", *[f"V{i}" for i in range(1, components + 1)], "Amount"])


def as_json(df: DataFrame, cols: Sequence[str]):
    """The given columns as one JSON text per row."""
    return F.to_json(F.struct(*[F.col(f"`{x}`") for x in cols]), {"ignoreNullFields": "false"})
