"""Small helpers shared by catalog entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every floating column so both engines compare equal."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def sql_round(body: str, double_cols) -> str:
    """Wrap a DuckDB query so the listed columns are rounded to 6 places."""
    if not double_cols:
        return body
    rep = ", ".join(f"round({c}, 6) AS {c}" for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM ({body}) AS _r"
