"""Session helpers: shared folder, materialization, observed counts, broadcast budget."""

from pyspark.sql import functions as F

from prospect.session import broadcast_row_limit, materialize, materialize_counted, scratch_path, shared_dir


def test_shared_folder_comes_from_the_session(spark):
    d = shared_dir(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(d.rstrip("/"))


def test_materialize_counted_is_exact_over_shuffles(spark):
    df = spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out, rows = materialize_counted(df.repartition(5, "k"), "t")
    assert rows == 97 == out.count()
    assert materialize(spark.range(5), "t2").count() == 5


def test_broadcast_budget_follows_threshold(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1MB")
        assert broadcast_row_limit(spark, 64) == 1024 * 1024 // 64
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert broadcast_row_limit(spark, 64) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_scratch_scope_removes_only_its_own_tables(spark):
    from prospect.session import scratch_scope
    from prospect.sources.readers import path_exists

    outside = materialize(spark.range(2), "kept").inputFiles()[0]
    with scratch_scope(spark) as created:
        inside = materialize(spark.range(3), "dropped")
        assert inside.count() == 3
        files = inside.inputFiles()
    assert len(created) == 1 and not path_exists(spark, files[0])
    assert path_exists(spark, outside)


def test_output_partitions_follow_the_size_estimate(spark):
    from prospect.session import output_partitions, size_estimate

    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    est = size_estimate(df)
    assert est > 0
    par = spark.sparkContext.defaultParallelism
    assert output_partitions(df) == par                      # small table: the cluster's parallelism
    assert output_partitions(df, max(1, est // (par * 4))) >= par * 4   # ~target-sized partitions


def test_output_partitions_without_statistics(spark):
    """A relation without statistics (Spark reports Long.MaxValue bytes) gets
    the cluster's parallelism, not an absurd partition count."""
    from prospect.session import output_partitions, size_estimate

    df = spark.sparkContext.parallelize([(i,) for i in range(10)]).toDF(["x"])
    assert size_estimate(df) == 0
    assert output_partitions(df) == spark.sparkContext.defaultParallelism
    df.repartitionByRange(output_partitions(df), "x").count()
