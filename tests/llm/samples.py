"""Small document tables with the awkward cases."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
# Names that operators use inside; a caller's columns may carry them too.
CLASHING = ("row", "n", "d", "leaf", "size", "rank", "block", "n_dropped", "copies", "score", "component")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None, lower: bool = False) -> list[bytes]:
    data = (text or "").encode()
    return WORD.findall(data.lower() if lower else data)


def prose(rng: random.Random, n: int) -> str:
    syllables = ["an", "be", "co", "du", "éa", "fi", "ga", "ho", "ñu", "ze"]
    out = []
    for i in range(n):
        out.append("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + ("." if i % 9 == 8 else ""))
    return "".join(w + ("\n" if i % 27 == 26 else " ") for i, w in enumerate(out)).strip()


def texts(seed: int = 1) -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): prose, copies, near copies, shared passages, nulls, empties,
    a long text, equal texts and a repeated row."""
    rng = random.Random(seed)
    rows: list[tuple[int | None, str | None, str | None]] = [
        (rng.randrange(1000) * 50 + i, prose(rng, rng.randint(5, 120)), f"src{i % 4}") for i in range(40)
    ]
    passage = prose(rng, 60)
    rows += [(60_000 + i, f"{prose(rng, 20)} {passage} {prose(rng, 15)}", "src1") for i in range(6)]
    first = prose(rng, 100)
    rows += [(70_000 + i, first, "hot") for i in range(25)]
    for i in range(8):
        near = first.split(" ")
        near[rng.randrange(len(near))] = f"changed{i}"
        rows.append((71_000 + i, " ".join(near), "hot"))
    rows += [
        (80_000, None, "src2"),
        (80_001, "", "src2"),
        (80_002, " \t\n \x0b", None),
        (80_003, "two words", None),
        (80_004, "one", "Ünïcode"),
        (80_005, "A b c \x1c d  e\r\nf", "src0"),
        (80_006, prose(rng, 6000), "long"),
        (None, "no id here but some words", "src0"),
        (None, None, None),
        (rows[0][0], rows[0][1], rows[0][2]),
    ]
    return rows


def documents(spark: SparkSession, rows=None, clashing: bool = False) -> DataFrame:
    rows = texts() if rows is None else rows
    full = [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(5)
    if clashing:
        for name in CLASHING:
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df
