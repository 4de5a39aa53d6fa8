from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from framewright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF), duck.sql(catalog.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    norm = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert norm(map(tuple, got.select(columns).collect())) == norm(want.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).collect()


def test_whole_table_queries_leave_nothing_out(spark):
    want: dict[int, list[int]] = {}
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("source is not null").collect()
    for r in docs:
        data = (r.text or "").encode()
        row = want.setdefault(int("".join(c for c in r.source if c.isdigit())), [0, 0, 0])
        for k, x in enumerate((1, len(data), sum(i * b for i, b in enumerate(data, 1)))):
            row[k] += x
    got = {r.traj_id: [r.n_frames, r.n_bytes, r.checksum] for r in catalog.QUERIES["touch_checksum"](spark, SF).collect()}
    assert got == want
    assert catalog.QUERIES["batch_texts"](spark, SF).count() == len(docs)
    assert catalog.QUERIES["extend_frame_idx"](spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()
