"""Tables that grow with the input aren't broadcast, however small Spark takes their files to be."""

from pyspark.sql.readwriter import DataFrameWriter

from rastrel import queries as grids

SF = "/root/testdata/sf0.001"


def broadcast_joins(spark, monkeypatch, name, limit):
    """Broadcast joins in each table that a query writes, and in its result."""
    count = lambda d: d._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")
    seen, write, kept = [], DataFrameWriter.parquet, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (seen.append(count(self._df)), write(self, *a, **b))[1])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            out = grids.QUERIES[name](spark, SF)
            return [*seen, count(out)]
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_morphometric_joins_dont_depend_on_file_sizes(spark, monkeypatch):
    small = broadcast_joins(spark, monkeypatch, "morphometric_outputs", "1g")
    assert len(small) > 10 and small[-1] == 0
    assert small == broadcast_joins(spark, monkeypatch, "morphometric_outputs", "-1")
