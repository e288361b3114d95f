"""Column selection, row filters, null handling and value maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casemill.functions.text import array_to_text, null_if_marker
from casemill.operators.joins import present
from casemill.rules.defaults import FEATURE_NAMES, NULL_MARKERS, UNCERTAIN


def rename_features(df: DataFrame, names: dict[str, str] = FEATURE_NAMES) -> DataFrame:
    """Give the extracted columns their feature names; names the table lacks are ignored."""
    return df.withColumnsRenamed(names)


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in any column, or in any of ``subset``."""
    return df.filter(present(df, subset or df.columns))


def drop_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Drop rows whose column holds one of the marker values; rows with a null stay."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(values))


def decided_only(df: DataFrame, outcome: str) -> DataFrame:
    """Binary task: rows whose outcome is not the uncertain class. A row without an outcome is not decided
    either and drops."""
    return df.filter(F.col(outcome) != UNCERTAIN)


def non_empty_arrays(df: DataFrame, column: str) -> DataFrame:
    """Rows with at least one item."""
    return df.filter(F.size(F.col(column)) > 0)


def null_markers(df: DataFrame, columns: list[str], markers: list[str] = NULL_MARKERS) -> DataFrame:
    """Turn the markers for "nothing found" into NULL, in one projection."""
    return df.withColumns({c: null_if_marker(F.col(c), markers) for c in columns})


def map_values(value: Column, mapping: dict) -> Column:
    """Replace the values named in ``mapping``; a value it lacks stays, as text if the new values are text."""
    texts = any(isinstance(new, str) for new in mapping.values())
    named = [F.when(value == F.lit(old), F.lit(new)) for old, new in mapping.items()]
    return F.coalesce(*named, value.cast("string") if texts else value)


def as_text_columns(df: DataFrame, columns: list[str], sep: str = ", ") -> DataFrame:
    """Cast feature columns to string, arrays as joined text; nulls stay null."""
    types = dict(df.dtypes)
    return df.withColumns(
        {
            c: array_to_text(F.col(c), sep)
            if types[c].startswith("array")
            else F.col(c).cast("string")
            for c in columns
        }
    )
