import os

import pytest
from pyspark.sql import functions as F

from wardcast.operators.ordering import running_positions
from wardcast.session import scratch_scope, shared_dir, via_table


def test_a_job_leaves_no_tables(spark):
    base = f"{shared_dir(spark).removeprefix('file:')}/wardcast"
    with scratch_scope(spark):
        with scratch_scope(spark):
            assert via_table(spark.range(3), "inner").count() == 3
        assert via_table(spark.range(5), "outer").count() == 5
        assert [x for x in os.listdir(base) if x.startswith("job-")]
    assert not [x for x in os.listdir(base) if x.startswith("job-")]


def test_positions_refuse_timestamps(spark):
    df = spark.range(2).select(F.col("id").alias("hospital_id"), F.current_timestamp().alias("date"))
    with pytest.raises(ValueError):
        running_positions(df)
