"""What the operators of this subpackage share: Arrow batches of bounded size, and stored tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from casemill.workdir import fresh_path, materialize

#: Bytes of text that a task works on at once.
CHUNK = 2 << 20

__all__ = ["CHUNK", "chunks", "crc_fold", "has_direction", "let_go", "map_chunks", "map_groups", "materialize", "per_process", "store", "text_bytes"]


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of ``column``, one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths.astype(np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; a null is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def map_chunks(
    df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, kept=None
) -> DataFrame:
    """Apply a function of small batches. ``make`` runs once per task; its function returns columns by name. ``kept`` is
    the name of what it keeps by ``per_process``."""
    kind: StructType = _parse_datatype_string(schema)
    arrow, names = to_arrow_schema(kind), df.columns

    def run(batches):
        let_go(kept)
        work = make()
        for batch in chunks((b.rename_columns(names) for b in batches), column):
            out = work(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    # Spark takes a dot in a name for a field of a struct, so names travel apart.
    return df.toDF(*(f"_{i}" for i in range(len(names)))).mapInArrow(run, kind)


def per_process(name, make):
    """What ``make`` returns, made once in a Python worker process and kept for its next task of this kind.

    A task of any other kind lets it go (``let_go``), so that a worker holds no more than its task needs.
    """
    kept = _kept()
    if name not in kept:
        kept.clear()
        kept[name] = make()
    return kept[name]


def _kept() -> dict:
    import sys
    from types import ModuleType

    module = sys.modules.setdefault("casemill_worker", ModuleType("casemill_worker"))
    return module.__dict__.setdefault("kept", {})


def let_go(but=None) -> None:
    """Drop what an earlier task of another kind has kept in this process; ``but`` is the name that stays."""
    kept = _kept()
    for name in [n for n in kept if n != but]:
        del kept[name]
    _release()


def _release() -> None:
    """Give back to the system what earlier tasks of this process have freed."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # only where the C library has it
        libc.malloc_trim(0)


def crc_fold(doc_id, folds: int = 5):
    """The fold of a row: crc32 of its id as text, modulo ``folds``."""
    from pyspark.sql import functions as F

    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def store(df: DataFrame, name: str) -> DataFrame:
    """As ``materialize``, for wide binary rows: written with a denser compression."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _wide(kind: pa.DataType) -> pa.DataType:
    """The same type with 64-bit offsets: a column of it holds any number of bytes in one piece."""
    if pa.types.is_binary(kind):
        return pa.large_binary()
    if pa.types.is_string(kind):
        return pa.large_string()
    if pa.types.is_list(kind):
        return pa.large_list(_wide(kind.value_type))
    return kind


def one_batch(batches: list[pa.RecordBatch]) -> pa.RecordBatch | None:
    """All rows of ``batches`` in one, also beyond 2 GB of bytes; None if there are none."""
    whole = pa.Table.from_batches(batches)
    whole = whole.cast(pa.schema([f.with_type(_wide(f.type)) for f in whole.schema])).combine_chunks().to_batches()
    if len(whole) > 1:
        raise ValueError("the rows of a group do not fit in one batch")
    return whole[0] if whole else None


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable, schema: str) -> DataFrame:
    """Apply ``fn`` to the rows of each group, a RecordBatch in ``order``, which returns columns by name or None.

    Groups are made small by their keys; a task holds one of them at a time.
    """
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        let_go()
        held: list[pa.RecordBatch] = []

        def done():
            whole = one_batch(held)
            if whole is not None and (out := fn(whole)) is not None:
                return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_pylist() for k in keys]
            rows = list(zip(*columns))
            cuts = [i for i in range(1, len(rows)) if rows[i] != rows[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(rows)]):
                if held and rows[a] != last and (out := done()) is not None:
                    yield out
                if rows[a] != last:
                    held, last = [], rows[a]
                held.append(batch.slice(a, b - a))
        if held and (out := done()) is not None:
            yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)


def has_direction(column):
    """Is an array of numbers a vector with a direction: no null, none that is not finite, not all zero?"""
    from pyspark.sql import functions as F

    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return column.isNotNull() & F.coalesce(F.forall(column, number) & F.exists(column, lambda x: x != 0), F.lit(False))
