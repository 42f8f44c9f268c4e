"""Streaming inputs. Every source yields one ``value`` column of text lines."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class StreamSpec:
    """``kafka`` with brokers and topics, or ``text`` with a folder that receives files."""

    kind: str
    brokers: str | None = None
    topics: tuple[str, ...] = ()
    path: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)


def kafka_options(spec: StreamSpec) -> dict[str, str]:
    if not spec.brokers or not spec.topics:
        raise ValueError("a kafka source needs brokers and topics")
    return {
        "kafka.bootstrap.servers": spec.brokers,
        "subscribe": ",".join(spec.topics),
        "startingOffsets": "latest",
        **spec.options,
    }


def read_lines(spark: SparkSession, spec: StreamSpec) -> DataFrame:
    if spec.kind == "kafka":
        stream = spark.readStream.format("kafka").options(**kafka_options(spec)).load()
        return stream.selectExpr("cast(value as string) as value")
    if spec.kind == "text":
        return spark.readStream.format("text").options(**spec.options).load(spec.path)
    raise ValueError(f"unknown stream kind: {spec.kind}")
