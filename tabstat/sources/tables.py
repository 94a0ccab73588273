"""Reading one table and looking at it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN means missing in this library, so turn it into NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def scan(spark: SparkSession, path: str, format: str = "parquet",
         schema: T.StructType | str | None = None, has_nan: bool | None = None) -> DataFrame:
    """One table. CSV is read with a header; give ``schema`` to avoid the inference pass.

    ``has_nan`` adds the NaN rule. It defaults to on for text formats and off for
    columnar ones, where it would keep filters on floating columns out of the scan.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if format == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    df = reader.format(format).load(path)
    return nan_to_null(df) if (has_nan if has_nan is not None else format == "csv") else df


def overview(df: DataFrame) -> DataFrame:
    """(column, dtype, n_rows, n_non_null) from one aggregation."""
    names = df.columns
    row = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 *[F.count(F.col(c)).alias(f"n_{i}") for i, c in enumerate(names)])
    types = dict(df.dtypes)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                               F.col("n_rows"), F.col(f"n_{i}").alias("n_non_null"))
                      for i, c in enumerate(names)])
    return row.select(F.inline(cells))


def preview(df: DataFrame, n: int = 5, order_by: str | None = None) -> DataFrame:
    """First ``n`` rows, as the overview page shows them."""
    return (df.orderBy(order_by) if order_by else df).limit(n)
