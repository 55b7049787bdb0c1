"""Work that has to be spread before it grows."""

from cadenza.plans import catalog

D = "/root/testdata/sf0.001"


def test_frames_are_dealt_over_all_cores(spark):
    assert catalog.load()[0]["x1_frame_pixels"](spark, D).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_titles_meet_before_their_lines_multiply(spark):
    plan = catalog.load()[0]["a15_title_size"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
