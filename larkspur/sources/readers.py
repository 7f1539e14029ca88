"""Transaction and repository scans. NaN becomes NULL at every source."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTIONS = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.LongType()),
        T.StructField("InvoiceDate", T.TimestampType()),
        T.StructField("UnitPrice", T.DoubleType()),
        T.StructField("CustomerID", T.LongType()),
        T.StructField("Country", T.StringType()),
    ]
)
#: Stands for a missing value in files of experiment results, never inside the engine.
MISSING = "MISSING"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating-point NaN as NULL; other columns as they are."""
    found = {f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(found) if found else df


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, encoding: str = "UTF-8") -> DataFrame:
    """CSV (with a header) or Parquet by the path's ending; other endings are an error."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return nan_to_null(reader.parquet(path))
    if ending == "csv":
        reader = spark.read.option("header", True).option("encoding", encoding)
        reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
        return nan_to_null(reader.csv(path))
    if ending == "xlsx":
        return read_workbook(spark, path)
    raise ValueError(f"{path}: neither .csv, .parquet nor .xlsx")


def read_workbook(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """One sheet of a workbook as text and numbers, where a workbook engine is installed.

    A workbook is read by the driver: the format has at most 1,048,576 rows a sheet.
    """
    import pandas as pd

    if not Path(path).exists():
        raise FileNotFoundError(path)
    if not path.lower().endswith(".xlsx"):
        raise ValueError(f"{path}: not .xlsx")
    frame = pd.read_excel(path, sheet_name=sheet)
    for c in frame.columns[frame.dtypes == object]:
        frame[c] = frame[c].map(lambda v: None if pd.isna(v) else str(v))
    return nan_to_null(spark.createDataFrame(frame))


def sheet_names(path: str) -> list[str]:
    """Sheets in workbook order."""
    import pandas as pd

    return list(pd.ExcelFile(path).sheet_names)


def raw_files(folder: str) -> list[str]:
    """Sorted files that aren't hidden; none for a missing folder."""
    top = Path(folder)
    return sorted(str(p) for p in top.iterdir() if p.is_file() and not p.name.startswith(".")) if top.is_dir() else []


def read_repository(spark: SparkSession, folder: str, name: str = "experiment_results", prefer_parquet: bool = True) -> DataFrame:
    """An experiment repository from Parquet or else CSV; the word for missing becomes NULL."""
    endings = ("parquet", "csv") if prefer_parquet else ("csv", "parquet")
    for ending in endings:
        if Path(f"{folder}/{name}.{ending}").exists():
            df = read_table(spark, f"{folder}/{name}.{ending}")
            strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
            return df.withColumns({c: F.nullif(F.col(c), F.lit(MISSING)) for c in strings})
    raise FileNotFoundError(f"{folder}/{name}.parquet or .csv")


def with_missing_word(df: DataFrame) -> DataFrame:
    """NULL strings as the word for missing, for sinks."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.fillna(MISSING, subset=strings)
