"""Arrow batches in and out of Python, and bounded samples for fitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_columns(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str, kept: int = 0) -> DataFrame:
    """Rows made from batches of columns: ``make()`` runs once a task and gives a function of lists to a tuple of lists.

    The first ``kept`` columns stay Arrow arrays, which may be among what the function gives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            if f is None:
                f = make()
            if not batch.num_rows:
                continue
            out = f(*batch.columns[:kept], *map(_listed, batch.columns[kept:]))
            arrays = [(x if x.type == t else x.cast(t)) if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)
    kinds, names = list(arrow.types), list(arrow.names)
    return df.mapInArrow(run, parsed)


def _listed(column: pa.Array) -> list:
    """The values as a list; of strings, and of numbers without nulls, the short way."""
    if pa.types.is_string(column.type) or pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def sample_of_each(df: DataFrame, column: str, name: Column, groups: dict[str, str], by: list[str], rows: int, seed: int = 17) -> list[tuple]:
    """Values of ``column`` and their group for about ``rows`` rows at most of each group, all of a smaller one.

    ``groups`` has the group of each ``name`` that counts; other rows are left out. They are counted without reading ``column``.
    """
    df = df.withColumn("_lm_name", name).where(F.col("_lm_name").isin(list(groups)))
    size: dict[str, int] = {}
    for found, n in df.groupBy("_lm_name").count().collect():
        size[groups[found]] = size.get(groups[found], 0) + n
    share = F.lit(1_000_000)
    for group, n in sorted(size.items(), key=lambda x: x[1]):
        if n > rows:
            share = F.when(F.col("_lm_name").isin([x for x, g in groups.items() if g == group]), int(1_000_000 * rows / n)).otherwise(share)
    found = df.where((_picked(seed, by) < share) & F.col(column).isNotNull()).select(column, "_lm_name").toArrow()
    return [(x, groups[y]) for x, y in zip(*(c.to_pylist() for c in found.columns))]


def _picked(seed: int, by: list[str]) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1_000_000))


NOT_ASCII = r"[^\x00-\x7f]"
