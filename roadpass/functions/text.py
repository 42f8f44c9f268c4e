"""Text expressions: padding, delimited pairs, parameters, salted prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_pad(value: Column, width: int = 2) -> Column:
    """Left-pad with zeros; longer text is kept whole."""
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def to_int(text: Column) -> Column:
    """Text to INT, NULL when malformed."""
    return F.trim(text).try_cast("int")


def tab_field(line: Column, position: int) -> Column:
    """Field of a tab-separated line, NULL when the line is too short."""
    return F.get(F.split(line, "\t"), F.lit(position))


def first_param(params: Column, name: str) -> Column:
    """First element of a JSON array parameter, NULL when absent or empty."""
    return F.get_json_object(params, f"$.{name}[0]")


def concat_with(left: Column, right: Column, sep: str) -> Column:
    """``left`` + sep + ``right``; a NULL part is skipped together with the separator."""
    return F.concat_ws(sep, left, right)


def add_prefix(value: Column, salt: Column) -> Column:
    """``<salt>_<value>``"""
    return F.concat(salt.cast("string"), F.lit("_"), value)


def drop_prefix(value: Column) -> Column:
    """Remove a leading ``<number>_``; other underscores stay."""
    return F.regexp_replace(value, "^[0-9]+_", "")


def last_pairs(
    df: DataFrame, keys: list[str], column: str, sep: str = "|", order: Sequence[str] = ()
) -> DataFrame:
    """Explode ``k=v|k=v`` text to (keys, k, v), the last duplicate of k winning.

    Several texts of one key follow each other by the ``order`` columns.
    """
    pieces = df.select(*keys, *order, F.posexplode(F.split(column, F.lit("\\" + sep))).alias("pos", "piece"))
    cut = F.instr("piece", "=")
    pairs = pieces.where(cut > 0).select(
        *keys,
        F.struct(*order, "pos").alias("at"),
        F.expr("substring(piece, 1, instr(piece, '=') - 1)").alias("k"),
        F.expr("substring(piece, instr(piece, '=') + 1)").alias("v"),
    )
    return pairs.groupBy(*keys, "k").agg(F.max_by("v", "at").alias("v"))


def tab_fields(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """Text columns of tab-separated lines (column ``value``); NULL where a line is too
    short. Quote marks are ordinary characters and an empty field stays empty.

    Exploding a one-element array keeps Catalyst from copying the split into every later
    filter: a line is split once.
    """
    fields = lines.select(F.explode(F.array(F.split("value", "\t", -1))).alias("field"))
    return fields.select(*[F.get("field", F.lit(i)).alias(n) for i, n in enumerate(names)])
