import __spark_entry__ as E
from brisa.sources.kafka import (
    CLEANER_SINK_PRESET,
    LOADER_SINK_PRESET,
    sink_options,
    source_options,
    to_frame,
)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert len(df.columns) == 26


def test_every_query_has_an_oracle():
    """The engine's own queries all have SQL; tests/llm names the brute-force test of each of its queries without."""
    from brisa.plans.catalog import QUERIES

    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_kafka_option_maps():
    src = source_options("b:9092", "topic-clima-entrada", "earliest", "grupo")
    assert src == {"kafka.bootstrap.servers": "b:9092", "subscribe": "topic-clima-entrada",
                   "startingOffsets": "earliest", "kafka.group.id": "grupo"}
    assert source_options("b:9092", "t", "latest")["startingOffsets"] == "latest"
    snk = sink_options("b:9092", CLEANER_SINK_PRESET)
    assert snk["kafka.compression.type"] == "lz4" and snk["kafka.acks"] == "1"
    assert snk["kafka.enable.idempotence"] == "false" and snk["kafka.buffer.memory"] == "67108864"
    assert sink_options("b", LOADER_SINK_PRESET)["kafka.compression.type"] == "snappy"


def test_frame_shape(spark):
    df = spark.createDataFrame([(bytearray(b"\x08\x01"), 3)], "value binary, partition int")
    f = to_frame(df, "t")
    assert [(x.name, x.dataType.simpleString()) for x in f.schema.fields] == [
        ("key", "binary"), ("value", "binary"), ("topic", "string"), ("partition", "int")]
    assert to_frame(df, "t", partition=None).columns == ["key", "value", "topic"]
