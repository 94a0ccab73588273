"""Column selection, classification, casts, flags and recodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabstat.functions.predicates import all_of, compare, literal_for
from tabstat.plans.stats import bounded_rows

_KINDS = {
    "numeric": T.NumericType,
    "text": T.StringType,
    "boolean": T.BooleanType,
    "date": (T.TimestampType, T.TimestampNTZType, T.DateType),
}
_KINDS["categorical"] = (T.StringType, T.BooleanType)


def columns_of(df: DataFrame, kinds: Sequence[str] = ("numeric",)) -> list[str]:
    """Columns of the given kinds, from the schema alone."""
    wanted = tuple(t for k in kinds for t in (_KINDS[k] if isinstance(_KINDS[k], tuple) else (_KINDS[k],)))
    return [f.name for f in df.schema.fields if isinstance(f.dataType, wanted)]


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Absent names are ignored."""
    return df.drop(*cols)


def refuse_existing(df: DataFrame, *names: str) -> None:
    taken = [n for n in names if n in df.columns]
    if taken:
        raise ValueError(f"column already exists: {taken}")


# strptime directives and the Spark datetime letters for the same fields
STRPTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm",
    "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "E", "%A": "EEEE",
    "%j": "DDD", "%z": "xx", "%%": "'%'",
}


def spark_pattern(fmt: str) -> str:
    """Translate a strptime format."""
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%":
            out += STRPTIME[fmt[i:i + 2]]
            i += 2
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return out


def cast_column(df: DataFrame, col: str, to: str, fmt: str | None = None) -> DataFrame:
    """Cast to int, float, datetime, category or str; what cannot be read becomes null.

    A fractional value makes the int cast fail as a whole, in which case the column
    keeps its numbers; the check is a scalar subquery, so the result type is decided
    by one pass and the column stays double when any fraction exists.
    """
    c = F.col(col)
    if to == "int":
        number = c.try_cast("double")
        fractions = df.where(number != F.floor(number)).limit(1).count()
        return df if fractions else df.withColumn(col, number.cast("bigint"))
    if to == "float":
        return df.withColumn(col, c.try_cast("double"))
    if to == "datetime":
        text = c.cast("string")
        when = F.try_to_timestamp(text, F.lit(spark_pattern(fmt))) if fmt else F.try_to_timestamp(text)
        return df.withColumn(col, c.cast("timestamp") if not fmt and col in columns_of(df, ("date",)) else when)
    if to in ("category", "str"):
        return df.withColumn(col, c.cast("string"))
    raise ValueError(f"unknown type {to!r}")


# texts read as booleans, fixed values
TRUE_TEXTS = ("true", "1", "yes")
FALSE_TEXTS = ("false", "0", "no")


def text_to_boolean(col: Column) -> Column:
    text = F.lower(col.cast("string"))
    return F.when(text.isin(*TRUE_TEXTS), True).when(text.isin(*FALSE_TEXTS), False)


def cast_boolean(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, text_to_boolean(F.col(col)))


def duplicate_column(df: DataFrame, col: str, new: str) -> DataFrame:
    refuse_existing(df, new)
    return df.withColumn(new, F.col(col))


def recode(df: DataFrame, col: str, mapping: Mapping, new: str | None = None,
           require_all: bool = False, drop_source: bool = False) -> DataFrame:
    """Replace values by their mapped text; without ``require_all`` others keep their own text."""
    pairs = [F.lit(x) for k, v in mapping.items() for x in (str(k), str(v))]
    text = F.col(col).cast("string")
    mapped = F.create_map(*pairs)[text] if pairs else F.lit(None).cast("string")
    if require_all:
        rest = df.where(text.isNotNull() & ~text.isin(*[str(k) for k in mapping])).select(text).limit(1).collect()
        if rest:
            raise ValueError(f"value without a level: {rest[0][0]!r}")
    else:
        mapped = F.coalesce(mapped, text)
    if new and new != col:
        refuse_existing(df, new)
    out = df.withColumn(new or col, mapped)
    return out.drop(col) if drop_source and new and new != col else out


def flag(df: DataFrame, col: str, op: str, value, new: str) -> DataFrame:
    """1 where the predicate holds, else 0."""
    return df.withColumn(new, compare(F.col(col), op, literal_for(df, col, value)).cast("int"))


def keep_if(df: DataFrame, col: str, conditions: Sequence[tuple], new: str) -> DataFrame:
    """``col`` where every (column, op, value) condition holds, else null."""
    return df.withColumn(new, F.when(all_of(df, conditions), F.col(col)))


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any listed column that exists (default: any column)."""
    if cols is None:
        return df.na.drop("any")
    present = [c for c in cols if c in df.columns]
    return df.na.drop(subset=present) if present else df


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_distinct) over non-null values."""
    text = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])
    return df.select(F.inline(text)).groupBy("column").agg(F.count_distinct("v").alias("n_distinct"))


def low_cardinality(df: DataFrame, limit: int = 10) -> list[str]:
    """Columns with at most ``limit`` distinct non-null values (numeric, boolean, text).

    A register sketch first removes the clearly larger columns: for small counts it
    never overshoots by a factor of two, so the exact count then only shuffles columns
    that have few values.
    """
    cols = columns_of(df, ("numeric", "categorical"))
    if not cols:
        return []
    sketch = df.agg(*[F.approx_count_distinct(c).alias(f"d_{i}") for i, c in enumerate(cols)]).first()
    likely = [c for c, d in zip(cols, sketch) if d <= max(2 * limit, 20)]
    if not likely:
        return []
    exact = df.agg(*[F.count_distinct(c).alias(f"d_{i}") for i, c in enumerate(likely)]).first()
    return [c for c, d in zip(likely, exact) if d <= limit]


def binary_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose non-null values are exactly 0 and 1."""
    cols = columns_of(df, ("numeric",))
    if not cols:
        return []
    checks = [F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"),
                       F.bool_and(F.col(c).isin(0, 1)).alias("only")).alias(f"c_{i}")
              for i, c in enumerate(cols)]
    row = df.agg(*checks).first()
    return [c for c, v in zip(cols, row) if v["lo"] == 0 and v["hi"] == 1 and v["only"]]


def distinct_values(df: DataFrame, col: str, sort: bool = True) -> DataFrame:
    out = df.select(col).na.drop().distinct()
    return out.orderBy(col) if sort else out


def levels_of(df: DataFrame, col: str, max_levels: int = 100) -> list:
    """Sorted distinct levels on the driver; refuses more than ``max_levels``."""
    rows = bounded_rows(df.select(col).na.drop().distinct(), max_levels, f"levels of {col}")
    return sorted(r[0] for r in rows)


def present_groups(df: DataFrame, dims: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """A dimension map cut down to the columns that exist."""
    have = set(df.columns)
    return {d: [v for v in vs if v in have] for d, vs in dims.items()}
