"""Joins on a case key. One case may hold a large share of all sentences, so hot keys are salted."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A key is hot when it has more than HOT_ROWS rows; every such key is split. A table of n rows has at most
# n / HOT_ROWS of them, which bounds the broadcast of the hot keys: a thousand for a billion rows.
HOT_ROWS = 1_000_000
# Parts over which rows without a key are dealt out.
NO_KEY_SALTS = 10_000

# Lists of the caller up to this many rows are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def hot_keys(df: DataFrame, on: list[str], rows: int = HOT_ROWS, weight: Column | None = None) -> DataFrame:
    """The hot keys of a table and, as ``_salts``, the number of parts each is split into.

    Reads the key columns only. Pass the result to the joins when the rows to join are derived from a
    stored table, so that they are not derived twice: ``weight`` then says how many rows a stored row
    becomes, or about how many. A join is right whatever keys it splits.
    """
    number = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return _as_hot(df.groupBy(*on).agg(number.alias("_n")), on, rows)


def _as_hot(counts: DataFrame, on: list[str], rows: int) -> DataFrame:
    return counts.filter(F.col("_n") > rows).select(*on, F.ceil(F.col("_n") / rows).cast("int").alias("_salts"))


def present(df: DataFrame, columns: list[str]) -> Column:
    """True for rows with a value in every column; NaN is no value."""
    types = dict(df.dtypes)
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).isNotNull()
        if types[c] in ("double", "float"):
            test = test & ~F.isnan(c)
    return test


def _without_nan(df: DataFrame, on: list[str]) -> DataFrame:
    """NaN is no key."""
    types = dict(df.dtypes)
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in on if types[c] in ("double", "float")})


def salted_join(
    many: DataFrame,
    one: DataFrame,
    on: list[str],
    how: str = "inner",
    hot: DataFrame | None = None,
    rows: int = HOT_ROWS,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Equi-join (``inner``, ``left`` or ``full``) whose ``many`` side may have hot keys.

    Rows of a hot key are spread over its salts by their other columns and by the task that holds them,
    which splits rows that a shuffle on the key has put together, and copies of one row over tasks; it
    does not change when a task is run again. The matching rows of ``one`` are repeated once per
    salt. Rows of other keys keep salt 0. Rows without a key (NULL; NaN becomes NULL on both sides)
    match nothing and are spread as well. A small ``one`` side is broadcast by Spark's own size check. ``many`` is
    read for its keys and for its rows, and must be the same both times: no sample, no unordered
    limit.

    ``hot`` may hold any keys, by all columns of ``on`` or some: a key that is not hot costs its repeated rows, one that
    is missing its split, and the result is the same. A full join is a left join and, after it, the rows of ``one`` whose
    keys ``many`` lacks. ``keys`` are the keys of ``many`` for that, repeated or not, where they can be had without
    deriving its rows again; with both, ``many`` is read once.
    """
    if how not in ("inner", "left", "full"):
        raise ValueError("a salted join is an inner, a left or a full join")
    many, one = _without_nan(many, on), _without_nan(one, on)
    counts = many.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    hot = _as_hot(counts, on, rows) if hot is None else hot
    hot_on = [c for c in hot.columns if c != "_salts"]
    hot = F.broadcast(hot.na.drop())
    no_key = ~present(many, on)
    salts = F.when(no_key, NO_KEY_SALTS).otherwise(F.coalesce("_salts", F.lit(1)))
    others = [F.col(f"`{c}`") for c, t in many.dtypes if c not in on and not t.startswith(("map", "variant"))]
    spread = F.when(salts > 1, F.pmod(F.xxhash64(F.spark_partition_id(), *others), salts)).otherwise(0).cast("int")
    left = many.join(hot, hot_on, "left").withColumn("_salt", spread)
    right = one.join(hot, hot_on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    )
    joined = left.drop("_salts").join(right.drop("_salts"), [*on, "_salt"], "left" if how == "full" else how).drop("_salt")
    if how != "full":
        return joined
    # The counts are what the hot keys are taken from, so one shuffle serves both.
    known = counts.filter(F.col("_n") > 0) if keys is None else _without_nan(keys, on).select(*on).distinct()
    return joined.unionByName(one.join(known.select(*on), on, "left_anti"), allowMissingColumns=True)


def natural_outer_join(left: DataFrame, right: DataFrame, **salting) -> DataFrame:
    """Full outer join on all shared columns, which appear once; ``left`` may have hot keys."""
    shared = [c for c in left.columns if c in right.columns]
    return salted_join(left, right, shared, "full", **salting)


def literal_table(spark: SparkSession, columns: dict[str, list], types: dict[str, str]) -> DataFrame:
    """Table from lists of the caller. Lists of unequal length are an error."""
    table = spark.createDataFrame(pa.table(columns))
    return table.select(*[F.col(c).cast(types[c]) for c in columns])


def lookup_join(
    df: DataFrame, columns: dict[str, list], types: dict[str, str], on: str, how: str = "inner"
) -> DataFrame:
    """Join with a table the caller holds as lists, broadcast only while the lists are short."""
    table = literal_table(df.sparkSession, columns, types)
    if len(columns[on]) <= BROADCAST_ROWS:
        return df.join(F.broadcast(table), on, how)
    return salted_join(df, table, [on], how)


def left_join_fill(left: DataFrame, right: DataFrame, on: str, fill: dict) -> DataFrame:
    """Left join of two tables with one row per key; what has no partner is filled."""
    return left.join(right, on, "left").na.fill(fill)


def label_join(
    features: DataFrame, outcomes: DataFrame, on: str, outcome: str, unique: bool = False, **salting
) -> DataFrame:
    """Features with their outcome; rows without an outcome are dropped, rows without a key too.

    A left join followed by that drop is an inner join, and is written as one. With ``unique`` the
    features have one row per key, so no key can be hot and none is looked for.
    """
    labelled = outcomes.filter(present(outcomes, [on, outcome]))
    keyed = features.filter(present(features, [on]))
    if unique:
        return keyed.join(labelled, on)
    return salted_join(keyed, labelled, [on], "inner", **salting)


def gold_join(sentences: DataFrame, gold: DataFrame, on: str, **salting) -> DataFrame:
    """Sentences of the annotated cases with the annotation of their case."""
    return salted_join(sentences.filter(present(sentences, [on])), gold, [on], "inner", **salting)


def dimension_counts(
    members: DataFrame,
    counts: DataFrame,
    on: str,
    count: str,
    code: str,
    excluded: list[str],
) -> DataFrame:
    """All members of a dimension that have a code, with their count or 0."""
    kept = members.filter(~F.col(on).isin(excluded) & F.col(code).isNotNull())
    return kept.join(counts, on, "left").na.fill({count: 0})
