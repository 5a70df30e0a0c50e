from pyspark.sql import functions as F

from kinemetry.operators.gate import episodes, marked
from kinemetry.sources.readings import readings, table
from kinemetry.streaming import gate


def test_stream_gate_is_the_batch_gate(spark, data, tmp_path):
    events = table(spark, data, "events")
    r = readings(events)
    limits = r.select("regime", "threshold").distinct()
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = (gate.alerts(gate.scored(stream, limits), 2, 2).writeStream.format("memory").queryName("fired").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start())
    q.awaitTermination()
    fired = {(x.device_id, x.event_id) for x in spark.table("fired").collect()}
    batch = episodes(marked(r, ["device_id"], ["t", "event_id"], "anomalous", F.lit(2), F.lit(2)), ["device_id"], ["t", "event_id"], "idx", F.lit(2))
    want = batch.alias("b").join(r.alias("r"), F.expr("b.alert_idx = r.idx and b.device_id = r.device_id")).select("r.device_id", "event_id").collect()
    assert fired == {tuple(x) for x in want} and fired
