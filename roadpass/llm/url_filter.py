"""URL rules by a cascade of Bloom filters over the corpus's own keys.

A rule is a host, the start of a path and a verdict; it fits its host and all subdomains.
The keys of a URL are the ends of its host, at whole labels, joined with the starts of its
path, for those (labels, path length) that rules have. A URL's rule is the longest of its keys
that is a rule.

Membership comes from a cascade. Its first level encodes the listed keys. The keys of the
whole corpus that pass it without being listed go into the second level, the listed ones that
pass that level by mistake into the third, and so on until no mistake is left; each level
hashes anew. For every key of the corpus the first level that does not hold it then tells
exactly whether it is listed, and no page is joined with a rule. A second, small cascade over
the rules tells which of them block.

Only DataFrame functions are used. Keys that pass the first level are the only ones shuffled.
A level is one row of a table and reaches the tasks as the value of a scalar subquery; its
size is checked (``MAX_BITS``). Longer lists are met by joins with the different (host, path).

Edge cases: a null URL, or one without ``://``, has an empty host and path and fits no rule;
an empty host fits none; rules without host are ignored, a null path is an empty one, hosts of
rules are lower-cased in A-Z, and of rules with equal host and path ``block`` wins; of fitting
rules equal in length there is one only, for it is the same key; without rules everything gets
``default``; repeated rows are judged each; empty tables give empty results; other columns
pass through but for those named like a result.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpass.llm.scratch import release, stored

MAX_BITS = 1 << 27
# A first level passes one in 2 ** FIRST of the other keys, a later one half of them.
FIRST, LATER = 6, 1
MAX_LEVELS = 60

RESULTS = ("host", "path", "rule", "verdict")


def parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass
class Level:
    """One Bloom filter: ``words`` is a stored table with one row, an array of 64-bit words."""

    number: int
    bits: int
    hashes: int
    words: DataFrame

    def has(self, key: Column) -> Column:
        words = self.words.select("words").scalar()
        found = [F.getbit(F.get(words, F.shiftright(p, 6)), p.bitwiseAND(63)) == 1 for p in self.places(key)]
        out = found[0]
        for f in found[1:]:
            out = out & f
        return out

    def places(self, key: Column) -> list[Column]:
        """Bits of a key; the level's number comes first, so that keys meet anew on each level."""
        h = F.xxhash64(F.lit(self.number), key)
        low, high = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long"))
        return [F.pmod(low + high * i, F.lit(self.bits)).cast("int") for i in range(self.hashes)]


class Cascade:
    """Exact membership of listed keys, for all keys of the universe it was built over."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def holds(self, key: Column) -> Column:
        # The first level without the key decides; past the last one its own side does.
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def level(keys: DataFrame, number: int, rate: int) -> Level:
    """A filter of the different ``key`` values; about one in 2 ** rate of other keys passes."""
    count = keys.count()
    bits = max(64, -(-math.ceil(count * rate / math.log(2)) // 64) * 64)
    if bits > MAX_BITS:
        raise ValueError(f"{count} keys need {bits} bits, more than {MAX_BITS}")
    out = Level(number, bits, rate, keys)
    ones = keys.select(F.explode(F.array(*out.places(F.col("key")))).alias("p")).select(
        F.shiftright("p", 6).cast("long").alias("at"), F.expr("shiftleft(1L, p % 64)").alias("word")
    )
    zeros = keys.sparkSession.range(bits // 64).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("word"))
    whole = ones.unionByName(zeros).groupBy("at").agg(F.bit_or("word").alias("word"))
    # As many words as the checked number of bits allows.
    row = whole.agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w")).select(F.col("w.word").alias("words"))
    out.words = stored(row, "filter-level")
    return out


def cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """``listed`` holds different keys; ``universe`` any keys, repeated or not."""
    levels = [level(listed, 0, FIRST)]
    passed = universe.select("key").where(levels[0].has(F.col("key"))).withColumn("listed", F.lit(False))
    known = stored(
        passed.unionByName(listed.select("key", F.lit(True).alias("listed"))).groupBy("key").agg(F.max("listed").alias("listed")),
        "filter-keys",
    )
    sides = [known.where("listed").select("key"), known.where("not listed").select("key")]
    kept: list[DataFrame] = []
    while len(levels) < MAX_LEVELS:
        side = len(levels) % 2
        # Keys of this side that the other side's last level holds by mistake.
        wrong = stored(sides[side].where(levels[-1].has(F.col("key"))), "filter-mistakes")
        kept.append(wrong)
        if wrong.isEmpty():
            break
        levels.append(level(wrong, len(levels), LATER))
        sides[side] = wrong
    else:
        raise RuntimeError("keys stay undecided")
    release(known, *kept)
    return Cascade(levels)


def ruled(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``rules`` has host, path and verdict."""
    table = _rules(rules)
    shapes = [(r["labels"], r["start"]) for r in table.select("labels", "start").distinct().orderBy("labels", "start").collect()]
    columns = [c for c in pages.columns if c.lower() not in RESULTS]
    host, path = parts(F.col("url"))
    judged = pages.select(*columns, host.alias("host"), path.alias("path"))
    if not shapes:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = [_key(F.col("host"), F.col("path"), *shape) for shape in shapes]
    bits = table.count() * FIRST / math.log(2)
    if bits > MAX_BITS:
        return _joined(judged, table, keys, default)
    corpus = judged.select(F.explode(F.array_compact(F.array(*keys))).alias("key"))
    listed = cascade(table.select("key"), corpus)
    blocking = cascade(table.where("verdict = 'block'").select("key"), table.select("key"))
    hits = [F.when(listed.holds(k), F.struct(F.length(k).alias("size"), k.alias("key"))) for k in keys]
    longest = F.greatest(*hits) if len(hits) > 1 else hits[0]
    found = judged.withColumn("rule", longest["key"])
    verdict = F.when(F.col("rule").isNull(), default).when(blocking.holds(F.col("rule")), "block").otherwise("allow")
    return found.withColumn("verdict", verdict)


def _rules(rules: DataFrame) -> DataFrame:
    """Different keys with their verdict, number of labels and length of path."""
    host = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    path = F.coalesce(F.col("path"), F.lit(""))
    clean = rules.where("host <> ''").select(host.alias("host"), path.alias("path"), F.col("verdict") == "block")
    named = clean.toDF("host", "path", "block").groupBy("host", "path").agg(F.max("block").alias("block"))
    return stored(
        named.select(
            F.concat("host", "path").alias("key"),
            F.when(F.col("block"), "block").otherwise("allow").alias("verdict"),
            F.size(F.split("host", r"\.", -1)).alias("labels"),
            F.length("path").alias("start"),
        ),
        "url-rules",
    )


def _key(host: Column, path: Column, labels: int, start: int) -> Column:
    """The end of the host with so many labels and the start of the path; null if shorter."""
    key = F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, start))
    return F.when((host != "") & (F.length(path) >= start), key)


def _joined(judged: DataFrame, table: DataFrame, keys: list[Column], default: str) -> DataFrame:
    """The same for lists beyond the filters' size, by joins over different hosts and paths."""
    wanted = judged.select("host", "path").distinct().select("host", "path", F.explode(F.array_compact(F.array(*keys))).alias("key"))
    best = F.max(F.struct(F.length("key").alias("size"), F.col("key"), F.col("verdict"))).alias("best")
    hits = wanted.join(table.select("key", "verdict").hint("merge"), "key").groupBy("host", "path").agg(best)
    return judged.join(hits.hint("merge"), ["host", "path"], "left").select(
        *judged.columns, F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
