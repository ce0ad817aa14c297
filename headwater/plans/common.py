"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.plans import tables


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles to so many digits, for comparison between engines: ties are judged on the product of doubles, as in the SQL,
    not on the shortest decimal. What is too large for the product stays."""
    scale = 10.0**digits

    def near(c: str):
        up = F.col(c) * scale
        return F.when(F.abs(up) < float("inf"), F.round(up, 0) / scale).otherwise(F.col(c)).alias(c)

    return df.select(*(near(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes))


def sql(body: str, doubles: str = "", longs: str = "") -> str:
    """body over the shared series, its doubles rounded and its integers as BIGINT."""
    parts = [f"round({c}, 6) AS {c}" for c in doubles.split()] + [f"{c}::BIGINT AS {c}" for c in longs.split()]
    *ctes, last = body.split("\n--\n")
    return f"WITH {', '.join([tables.SQL.strip(), *ctes, f'res AS ({last})'])} SELECT * " + (f"REPLACE ({', '.join(parts)})" if parts else "") + " FROM res"
