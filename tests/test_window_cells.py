"""Windowed scores are of the cells that there are, in the precision asked for."""

import duckdb
import numpy as np
import pytest

from rastrel import queries as grids
from rastrel.plans import predict


def test_window_scores_of_an_incomplete_raster(spark, tmp_path):
    """The last row has 7 of 25 pixels, others lack pixels or whole rows, some embeddings are null or short."""
    kept = "CASE WHEN vec_id % 17 = 0 THEN NULL WHEN vec_id % 23 = 0 THEN embedding[1:7] ELSE embedding END embedding"
    con = duckdb.connect()
    con.sql(f"COPY (SELECT vec_id, {kept} FROM '/root/testdata/sf0.001/embeddings.parquet' WHERE vec_id < 482 AND vec_id NOT BETWEEN 90 AND 160) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet'")
    want = con.sql(f"SELECT overlap, r, c, p FROM ({grids.ORACLES['window_scores']})").fetchall()
    got = [tuple(x) for x in grids.QUERIES["window_scores"](spark, str(tmp_path)).select("overlap", "r", "c", "p").collect()]
    assert len(want) == 2 * (482 - 71) and sorted(got) == sorted(want)


@pytest.mark.parametrize("precision", ["float", "double"])
def test_precision_of_windows(spark, precision):
    x = np.random.default_rng(3).random((7, 5))
    d = spark.createDataFrame([(i, j, [float(x[i, j])]) for i in range(7) for j in range(5)], "r int, c int, f array<double>")
    got = {(r["r"], r["c"]): r["p"] for r in predict.windowed(d, 7, 5, 4, [1], lambda: lambda a: a[0], 1, precision=precision).collect()}
    want = x.astype(np.float32).astype(float) if precision == "float" else x
    assert got == {(i, j): want[i, j] for i in range(7) for j in range(5)}
