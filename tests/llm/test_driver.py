"""What the pipeline asks of the driver: few jobs in its slowest stage, and little data for the model of its first."""

import numpy as np

import corpus_pipeline
from quillpath.llm import quality
from tests.llm.test_pairs_and_leaks import corpus


def test_join_takes_few_jobs(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    spark.sparkContext.setJobGroup("few jobs", "")
    try:
        corpus_pipeline.near_duplicates(spark, df, "").count()
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(key, None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("few jobs")) <= 65


def test_counts_reach_the_driver_packed():
    text = " ".join(f"word{i * i % 97} of the {i % 7}th line" for i in range(60)).encode()
    row = quality.term_counts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    sent = quality.packed(row)
    assert len(sent) < row.astype(np.float16).nbytes / 3
    assert np.array_equal(quality.unpacked(sent), row.astype(np.float16))
