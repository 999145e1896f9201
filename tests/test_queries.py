"""Every query of the catalog against its SQL."""

from __future__ import annotations

import pytest
from compare import connection, difference
from conftest import SF

from quillon.plans import catalog


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLES:
        assert not difference(df, con, catalog.ORACLES[name])
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["normalized", "pooled_vectors", "resized_vectors", "unit_or_null"])
def test_tiny_negative_elements(spark, tmp_path, name):
    """What is rounded to zero from below is -0.0 in SQL."""
    rows = [(k, [(-1) ** j * (1e-7 if (j + k) % 5 else 0.5) * (1 + j % 3) for j in range(64)], k) for k in range(6)] + [(6, [-1e-7] * 64, 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = connection(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert any("-0.0," in repr(r) for r in df.collect())
    assert not difference(df, con, catalog.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
