"""Splits, oversampling, row order and one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from casemill.functions.keys import hash_bucket, key_hash
from casemill.rules.defaults import MINORITY_COPIES, TEST_SHARE
from casemill.workdir import materialize

# Hex digits by which the search for the border of an exact split goes on, and the hashes it then ranks.
_STEP, _RANKED = 4, 100_000


def shuffle_rows(df: DataFrame, keys: list[str], seed: str = "0") -> DataFrame:
    """All rows in a repeatable random order (a range-partitioned sort by hash)."""
    return df.orderBy(key_hash(seed, [F.col(k) for k in keys]))


def split_by_hash(
    df: DataFrame, keys: list[str], test_share: float = TEST_SHARE, seed: str = "0"
) -> DataFrame:
    """Add ``split``: about ``test_share`` of the keys are ``test``. Rows of a key stay together.

    Row by row and without a shuffle. Give the case key to keep a case out of both parts.
    """
    bucket = hash_bucket(key_hash(seed, [F.col(k) for k in keys]), 10_000)
    return df.withColumn(
        "split", F.when(bucket < int(round(test_share * 10_000)), "test").otherwise("train")
    )


def split_exact(
    df: DataFrame, keys: list[str], test_share: float = TEST_SHARE, seed: str = "0"
) -> DataFrame:
    """Add ``split``: the first ``int(test_share * n)`` rows in hash order are ``test``.

    ``keys`` identify a row; rows of one key stay together, so a key that repeats at the border can make
    the test part larger. The hashes are stored once. The hash where the test part ends is found from
    row counts per prefix (65,536 at most), again within the prefix that holds it, and so on until that
    one is small at any data size; its hashes alone are ranked. No row is moved.
    """
    hashed = key_hash(seed, [F.col(k) for k in keys])
    hashes = materialize(df.select(hashed.alias("_h")), "hashes")
    rows = hashes.count()
    prefix, inside, take = "", rows, int(test_share * rows)
    if not take:
        return df.withColumn("split", F.lit("train"))
    while inside > _RANKED and len(prefix) < 32:
        here = hashes.filter(F.col("_h").startswith(prefix))
        counts = here.groupBy(F.substring("_h", 1, len(prefix) + _STEP).alias("_p")).count()
        upto = F.sum("count").over(Window.orderBy("_p"))
        found = counts.withColumn("_upto", upto).filter(F.col("_upto") >= take).orderBy("_p").first()
        prefix, inside, take = found["_p"], found["count"], take - (found["_upto"] - found["count"])
    here = hashes.filter(F.col("_h").startswith(prefix)).orderBy("_h").limit(take)
    last_test = here.agg(F.max("_h")).first()[0]
    return df.withColumn("split", F.when(hashed <= last_test, "test").otherwise("train"))


def oversample(
    df: DataFrame, label: str, minority=1, copies: int = MINORITY_COPIES, copy: str = "copy"
) -> DataFrame:
    """Repeat every minority row ``copies`` times in one scan; ``copy`` numbers the repeats."""
    times = F.when(F.col(label) == minority, copies).otherwise(1)
    return df.withColumn(copy, F.explode(F.sequence(F.lit(1), times)))


def last_write_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the greatest ``order`` value (a path, a position).

    Keys are counted without the other columns. Only rows of a key that comes again are ranked; all others
    stay where they are. A row without an order is kept if its key has no other; rows without a key are one
    group. Of rows with equal order one stays.
    """
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    again = counts.filter(F.col("_n") > 1).select("_key")
    same = F.col(key).eqNullSafe(F.col("_key"))
    newest = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
    ranked = df.join(again, same, "left_semi").withColumn("_rank", F.row_number().over(newest))
    best = ranked.filter(F.col("_rank") == 1).drop("_rank")
    return df.join(again, same, "left_anti").unionByName(best).select(key, *[c for c in df.columns if c != key])


def last_rows(df: DataFrame, case: str, position: str, n: int) -> DataFrame:
    """Last ``n`` rows of each case. Spark keeps at most ``n`` rows per case and task before the shuffle."""
    latest_first = Window.partitionBy(case).orderBy(F.col(position).desc())
    return df.withColumn("_rn", F.row_number().over(latest_first)).filter(F.col("_rn") <= n).drop("_rn")


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """First ``n`` rows in a given order."""
    return df.orderBy(*order).limit(n)
