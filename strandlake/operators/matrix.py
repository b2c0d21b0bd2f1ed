"""Packed result cells: packing, unpacking, pivots and column filters. Long form throughout; wide only at the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a packed cell, in order.
FIELDS = ["uDOC", "sdDOC", "medDOC", "CovBases", "RCN"]
OPERATORS = {">": "gt", "<": "lt", ">=": "gte", "<=": "lte", "==": "eq", "!=": "neq"}


def packed_cell(mean: Column, sd: Column, median: Column, bases: Column, rcn: Column) -> Column:
    """mean;sd;median;bases;rcn with two, two, two, no and one decimals at most; NA for null."""
    na = lambda c: F.coalesce(c, F.lit("NA"))
    two, one = F.lit("0.0#"), F.lit("0.0")
    f = lambda c, p: F.call_function("format_number", c, p)
    return F.concat_ws(";", na(f(mean, two)), na(f(sd, two)), na(f(median, two)), na(bases.cast("string")), na(f(rcn, one)))


def field(cell: Column, name: str) -> Column:
    """One field of a packed cell; NA where it is missing, nan for a missing cell's first field."""
    at = FIELDS.index(name)
    return F.coalesce(F.get(F.split(F.coalesce(cell, F.lit("nan")), ";"), at), F.lit("NA"))


def to_long(wide: DataFrame, row: str = "locus") -> DataFrame:
    """row, sample, cell from a wide table with a column per sample."""
    rest = [c for c in wide.columns if c != row]
    return wide.unpivot([row], rest, "sample", "cell")


def to_wide(long: DataFrame, samples: list[str], value: str, row: str = "locus") -> DataFrame:
    """A column per sample in the order given; a (row, sample) that comes twice is an error."""
    twice = F.when(F.count("*") > 1, F.raise_error(F.lit("a row and sample come twice"))).otherwise(F.first(value))
    cells = long.groupBy(row, "sample").agg(twice.alias(value))
    return cells.groupBy(row).pivot("sample", samples).agg(F.first(value)).orderBy(row)


def compares(value: Column, op: str, bound: float) -> Column:
    if op not in OPERATORS:
        raise ValueError(f"no operator {op!r}: {' '.join(OPERATORS)}")
    return {">": value > bound, "<": value < bound, ">=": value >= bound, "<=": value <= bound, "==": value == bound, "!=": value != bound}[op]


def filter_samples(long: DataFrame, locus: str, op: str, bound: float, value: str) -> DataFrame:
    """Rows of the samples whose value at a locus compares; what isn't a number doesn't."""
    good = long.where((F.col("locus") == locus) & compares(F.col(value).try_cast("double"), op, bound)).select("sample").distinct()
    return long.join(good, "sample", "left_semi")


def parse_filter(spec: str) -> tuple[str, str, float]:
    """locus, operator and value of locus:operator:value; a locus may hold colons."""
    locus, op, value = spec.rsplit(":", 2)
    if op not in OPERATORS:
        raise ValueError(f"no operator {op!r}: {' '.join(OPERATORS)}")
    return locus, op, float(value)
