"""Pixels from floats just below a whole number: the query and its checking SQL state one rule."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

#: In single precision (x + 0.5) * 255 is rounded up to 102, 197 and 241.
EDGES = np.array([-0.1, 0.272549, 0.445098], np.float32)


@pytest.mark.parametrize("name", ["histogram", "screenshot_hash", "visual_diff"])
def test_edge_pixels_agree_with_sql(spark, tmp_path, name):
    # only half of the images hold edges, so that these do not cancel out between an image and the one before it
    vectors = [np.roll(np.resize(np.append(EDGES if k < 15 else EDGES / 2, k / 50).astype(np.float32), 64), k) for k in range(30)]
    ids = np.arange(30)
    pq.write_table(
        pa.table({"vec_id": pa.array(ids), "embedding": pa.array([v.tolist() for v in vectors], pa.list_(pa.float32())), "label": pa.array(ids % 3, pa.int32())}),
        tmp_path / "embeddings.parquet",
    )
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    relation = con.sql(entry.oracle_sql()[name])
    columns = relation.columns
    got = [tuple(row) for row in entry.queries()[name](spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(got) == sorted(relation.fetchall())
