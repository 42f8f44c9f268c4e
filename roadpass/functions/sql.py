"""Scalar and table helpers as temporary SQL functions, for queries written as text.

They are SQL-defined functions: Catalyst inlines the body, no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFINITIONS = (
    "concat_string_string(a STRING, b STRING, sep STRING) RETURNS STRING RETURN concat_ws(sep, a, b)",
    "random_prefix(v STRING, n INT) RETURNS STRING NOT DETERMINISTIC "
    "RETURN concat(cast(floor(rand() * n) AS STRING), '_', v)",
    "remove_random_prefix(v STRING) RETURNS STRING RETURN regexp_replace(v, '^[0-9]+_', '')",
    # Histogram text of a list of values and their counts; equal values are added up.
    "counted_histogram(entries ARRAY<STRUCT<value: STRING, n: BIGINT>>) RETURNS STRING "
    "RETURN array_join(transform(array_sort(array_distinct(transform(entries, e -> e.value))), "
    "v -> concat(v, '=', cast(aggregate(filter(entries, e -> e.value = v), 0L, (a, e) -> a + e.n) AS STRING))), '|')",
    "flow_level(n BIGINT) RETURNS STRING RETURN CASE WHEN n > 170 THEN 'A LEVEL' WHEN n > 160 THEN 'B LEVEL' "
    "WHEN n > 150 THEN 'C LEVEL' ELSE 'D LEVEL' END",
    # The beginnings of a comma list, one row each.
    "prefix_rows(list STRING) RETURNS TABLE(prefix STRING, step INT) "
    "RETURN SELECT array_join(slice(split(list, ','), 1, s), ','), s FROM explode(sequence(1, size(split(list, ',')))) AS t(s)",
)


def register(spark: SparkSession) -> None:
    for definition in DEFINITIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")
