"""Batches go on where a lost run stopped, and none is computed twice."""
import pytest
from pyspark.sql import functions as F

from helioscape.sources.resume import finished_batches, resume


def points(spark, n, shift=0.0):
    return spark.range(n).select("id", (F.col("id") / 100).alias("lat"), (F.col("id") / 50 + shift).alias("lon"))


def counted(spark):
    """A computation that counts the rows it is given."""
    seen = spark.sparkContext.accumulator(0)

    def compute(rows):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        return rows.select("id", "batch_key", (F.col("lat") + F.col("lon")).alias("total")).mapInArrow(count, "id long, batch_key string, total double")

    return compute, seen


def rows(df):
    return sorted((r["id"], round(r["total"], 9)) for r in df.collect())


def test_a_run_that_stops_halfway_is_ended_by_the_next(spark, tmp_path):
    compute, seen = counted(spark)
    data, want = points(spark, 1003), [(i, round(i / 100 + i / 50, 9)) for i in range(1003)]
    first = rows(resume(data, "id", compute, str(tmp_path), size=50, commits=4, at_most=2))
    done = seen.value
    assert 0 < len(first) == done < 1003 and set(first) <= set(want)
    assert rows(resume(data, "id", compute, str(tmp_path), size=50, commits=4)) == want
    assert seen.value == 1003
    assert rows(resume(data, "id", compute, str(tmp_path), size=50, commits=4)) == want
    assert seen.value == 1003 and finished_batches(spark, str(tmp_path)).count() == 21


def test_a_commit_that_was_not_listed_does_not_count(spark, tmp_path):
    compute, seen = counted(spark)
    data = points(spark, 300)

    def dies(batch):  # the rows are written, the listing never comes
        compute(batch).withColumn("_commit", F.lit("lost")).write.mode("append").parquet(f"{tmp_path}/rows")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        resume(data, "id", dies, str(tmp_path), size=50, commits=1)
    assert finished_batches(spark, str(tmp_path)).count() == 0
    got = rows(resume(data, "id", compute, str(tmp_path), size=50, commits=3))
    assert got == [(i, round(i / 100 + i / 50, 9)) for i in range(300)]


def test_changed_and_no_points(spark, tmp_path):
    compute, seen = counted(spark)
    resume(points(spark, 120), "id", compute, str(tmp_path), size=50, commits=2)
    before = seen.value
    more = points(spark, 200)  # the two full batches stay, the third is another one
    assert len(rows(resume(more, "id", compute, str(tmp_path), size=50, commits=2))) == 200
    assert (before, seen.value) == (120, 220)
    assert len(rows(resume(points(spark, 40, 1.0), "id", compute, str(tmp_path), size=50, commits=2))) == 40
    none = resume(points(spark, 0), "id", compute, str(tmp_path / "new"), size=50, commits=2)
    assert none.columns == ["id", "total"] and none.count() == 0
