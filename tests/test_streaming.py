"""Streams give what the batch operators give over the whole log."""

import random

from sluice.operators import dictionaries, stacks
from sluice.streaming import stream_final_state, stream_stacks
from tests.conftest import rows


def run(spark, tmp_path, log, schema, of, mode):
    for k in range(0, len(log), 50):  # one file a micro-batch
        spark.createDataFrame(log[k : k + 50], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    name = f"s{random.randrange(1 << 30)}"
    q = of(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_final_state(spark, tmp_path):
    rng = random.Random(1)
    log = [(rng.randrange(9), s, rng.choice(["insert", "insert", "delete", "search"]), s) for s in range(150)]
    schema = "key long, seq long, op string, value long"
    got = run(spark, tmp_path, log, schema, stream_final_state, "update")
    last = {}
    for key, seq, present, value in got.collect():
        if key not in last or seq >= last[key][0]:
            last[key] = (seq, present, value)
    assert {k: v for k, (_, p, v) in last.items() if p} == dict(rows(dictionaries.final_state(spark.createDataFrame(log, schema))))


def test_stacks(spark, tmp_path):
    rng = random.Random(2)
    log = [(rng.randrange(3), s, rng.choice(["push", "pop"]), s) for s in range(150)]
    schema = "stack long, seq long, op string, value long"
    got = run(spark, tmp_path, log, schema, stream_stacks, "append")
    assert rows(got, "stack", "seq", "value", "underflow") == rows(stacks.pops(spark.createDataFrame(log, schema)), "stack", "seq", "value", "underflow")
