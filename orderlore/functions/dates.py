"""Parsing of dates held as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the date patterns tried, in order, each with the shape a fitting text has
DATE_PATTERNS = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyy-M-d H:m:s": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$",
    "M/d/yyyy H:m:s": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
}


def parses(text: Column) -> list[Column]:
    """One timestamp attempt per pattern, then the engine's own date syntax.

    A failed pattern costs an exception inside the parser, so only texts of the right shape get there.
    """
    attempts = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(p))) for p, shape in DATE_PATTERNS.items()]
    return [*attempts, text.try_cast("timestamp")]


def best_reading(text: Column, weight: Column | None = None) -> Column:
    """Aggregate over a column: the attempt that parses most values (the first of equals) as a struct of its number of
    values, place in `parses`, first and last moment. One pattern is a column's format, so that 03/04 is never read as
    March in one row and as 3 April, as other rows of the column demand, in the next."""
    weight = F.lit(1) if weight is None else weight
    rated = [
        F.struct(
            F.sum(F.when(p.isNotNull(), weight).otherwise(0)).alias("values"),
            F.lit(-i).alias("place"),
            F.min(p).alias("min_date"),
            F.max(p).alias("max_date"),
        )
        for i, p in enumerate(parses(text))
    ]
    return F.array_max(F.array(*rated))


def to_datetime(text: Column, place: int) -> Column:
    """The attempt at `place`; NULL for texts that don't fit it."""
    return parses(text)[place]


def places_of(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """The best attempt of each text column; each distinct text is parsed once, and one row a column reaches the driver."""
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").alias("value")) for i, c in enumerate(columns)])
    counted = df.select(F.explode(cells).alias("cell")).groupBy("cell.i", "cell.value").agg(F.count("*").alias("n"))
    found = counted.groupBy("i").agg(best_reading(F.col("value"), F.col("n"))["place"].alias("place")).collect()
    places = {columns[r["i"]]: -(r["place"] or 0) for r in found}
    return {c: places.get(c, 0) for c in columns}
