from pyspark.sql import functions as F

from sievelight.sources import readers
from sievelight.streaming import scoring


def test_stream_scores_like_the_table(spark, tmp_path):
    df = readers.synthetic_samples(spark).withColumn("at", F.timestamp_seconds(1_700_000_000 + F.substring("sample_id", 2, 8).cast("long") * 60))
    df.write.parquet(str(tmp_path / "in"))
    means = scoring.frozen_means(df)
    table = scoring.score(df, means, range(5))
    assert table.where("risk is null or risk < 0 or risk > 1").count() == 0
    stream = scoring.score(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), means, range(5))
    query = scoring.risk_by_window(stream, "at").writeStream.outputMode("complete").format("memory").queryName("risk_windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("risk_windows").agg(F.sum("n")).first()[0] == df.count()
