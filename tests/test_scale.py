"""What must not grow with the input: tables sent to the driver, rows held by a task or a Python worker."""

import pytest

import __spark_entry__ as registry

#: Queries whose joins have two sides that grow with the input.
JOINED = ["mosaic_planes", "mosaic_faults", "alpha_appended", "alpha_faults", "container_info", "first_item_fault", "effective_primary", "gain_map_inputs", "item_metadata", "grid_cells", "sample_program_inputs", "item_payloads", "alpha_items", "chroma_at_luma", "frames_rgba", "gain_map_resampled", "track_samples", "animations", "planes_transformed"]


@pytest.mark.parametrize("name", JOINED)
def test_no_side_of_a_join_goes_through_the_driver(spark, sf_dir, name):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_headers_of_a_track_are_read_without_a_pandas_frame_per_track(spark, sf_dir):
    plan = registry.queries()["frame_headers"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Pandas" not in plan


def test_keys_are_dealt_over_more_tasks_as_they_grow(spark):
    from tessera.operators.staging import TASK_KEYS, spread

    few, many = spread(spark.range(1000)), spread(spark.range(20 * TASK_KEYS + 1))
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and many.rdd.getNumPartitions() == 21
    assert many.count() == 20 * TASK_KEYS + 1


def test_brands_need_no_second_parse(spark, sf_dir):
    plan = registry.queries()["file_brands"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 2
