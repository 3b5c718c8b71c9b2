import pytest
from pyspark.sql import functions as F

from quarry.sources import publish as pb


def stages(calls, fail=None, key="1"):
    def numbers(spark, tables):
        calls.append("numbers")
        return spark.range(100).select("id", (F.col("id") % 7).alias("r"), F.when(F.col("id") % 3 == 0, F.array("id")).alias("list"))

    def sums(spark, tables):
        calls.append("sums")
        if fail == "sums":
            raise RuntimeError("the driver is lost")
        return tables["numbers"].groupBy("r").agg(F.sum("id").alias("s"))

    def top(spark, tables):
        calls.append("top")
        out = tables["sums"].where("s > 700")
        return out.where(F.raise_error(F.lit("an executor fails")).isNull()) if fail == "top" else out

    return [pb.Stage("numbers", numbers), pb.Stage("sums", sums, key), pb.Stage("top", top)]


def test_a_version_is_there_as_a_whole_or_not_at_all(spark, tmp_path):
    root, calls = str(tmp_path / "store"), []
    pb.publish(spark, root, "v1", stages(calls))
    assert calls == ["numbers", "sums", "top"] and pb.versions(spark, root) == ["v1"]
    one = sorted(map(tuple, pb.read_version(spark, root, "v1", "sums", verify=True).collect()))
    calls.clear()
    for fail in ("sums", "top"):
        with pytest.raises(Exception, match="is lost|executor fails"):
            pb.publish(spark, root, "v2", stages(calls, fail))
        assert pb.versions(spark, root) == ["v1"]
        assert sorted(map(tuple, pb.read_version(spark, root, "v1", "sums", verify=True).collect())) == one
        with pytest.raises(ValueError):
            pb.read_version(spark, root, "v2", "numbers")
    assert calls == ["numbers", "sums", "sums", "top"]  # numbers is not made again
    calls.clear()
    pb.publish(spark, root, "v2", stages(calls))
    assert calls == ["top"] and pb.versions(spark, root) == ["v1", "v2"]
    calls.clear()
    pb.publish(spark, root, "v2", stages(calls, "top"))
    assert calls == []


def test_a_stage_with_another_key_is_built_again_with_what_follows(spark, tmp_path):
    root, calls = str(tmp_path / "store"), []
    with pytest.raises(Exception, match="executor fails"):
        pb.publish(spark, root, "v1", stages(calls, "top"))
    calls.clear()
    pb.publish(spark, root, "v1", stages(calls, key="2"))
    assert calls == ["sums", "top"]


def test_tables_that_have_changed_are_noticed(spark, tmp_path):
    root = str(tmp_path / "store")
    pb.publish(spark, root, "v1", stages([]), {"source": "test"})
    path = f"{root}/versions/v1/numbers"
    spark.range(99).select("id", (F.col("id") % 7).alias("r"), F.lit(None).cast("array<bigint>").alias("list")).write.mode("overwrite").parquet(path)
    with pytest.raises(OSError, match="not what was published"):
        pb.read_version(spark, root, "v1", "numbers", verify=True)


def test_what_is_left_of_builds_goes(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(Exception):
        pb.publish(spark, root, "v0", stages([], "sums"))
    pb.publish(spark, root, "v1", stages([]))
    assert pb.remove_unpublished(spark, root) == ["v0"] and pb.read_version(spark, root, "v1", "top", verify=True).count() > 0


def test_checksums_do_not_depend_on_the_order(spark):
    df = spark.range(1000).select("id", (F.col("id") * 0.5).alias("x"))
    assert pb.checksum(df) == pb.checksum(df.orderBy(F.desc("id")).repartition(7))
    assert pb.checksum(df) != pb.checksum(df.withColumn("x", F.when(F.col("id") == 5, 0.0).otherwise(F.col("x"))))
    assert pb.checksum(df.limit(0)) == (0, "0000000000000000-0000000000000000")


def test_a_stage_is_computed_once(spark, tmp_path):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    stage = pb.Stage("numbers", lambda s, _: s.range(100).mapInArrow(counted, "id long"))
    made = pb.publish(spark, str(tmp_path / "store"), "v1", [stage])
    assert rows.value == 100
    assert (made["stages"][0]["rows"], made["stages"][0]["checksum"]) == pb.checksum(spark.range(100))
