"""Every query with SQL gives what DuckDB gives; the others give rows with a schema."""

import math
from pathlib import Path

import duckdb
import pytest

from leafmill.queries import oracle_sql, queries

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).iterdir():
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.9g}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    q = duck.execute(oracle_sql()[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in q.fetchall())


def test_others_give_rows_of_their_keys(spark):
    """The queries without SQL have tests of their own; here: they cover their tables, each key once."""
    rows = {n: queries()[n](spark, SF) for n in set(queries()) - set(oracle_sql())}
    assert set(rows) == {"p3_found", "p3_normalised", "fragment_blocks", "table_cells"}
    made, table = rows["fragment_blocks"], spark.read.parquet(f"{SF}/fragments.parquet").where("trim(text) <> '' and x is not null and y is not null")
    assert made.select("doc_id", "page_no").distinct().count() == table.select("doc_id", "page_no").distinct().count()
    assert made.count() == made.select("doc_id", "page_no", "block_idx").distinct().count() <= table.distinct().count()
    cells = rows["table_cells"]
    assert cells.count() == cells.select("doc_id", "page_no", "block_idx").distinct().count() > 0
    assert rows["p3_normalised"].where("utc_us is not null").select("unit", "rec_id", "field", "utc_us").distinct().count() == rows["p3_found"].count() > 0
