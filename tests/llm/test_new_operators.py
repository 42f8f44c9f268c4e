"""Importance resampling, URL rules and the Merkle manifest, against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadpass.llm import importance, manifest, url_filter
from roadpass.llm.crc import DEPTH, crc32
from roadpass.llm.positions import positions
from roadpass.llm.scratch import stored
from tests.llm.samples import CLASHING, documents, texts

TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text):
    return TOKEN.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


# CRC of spans


def test_crc_of_spans_of_any_length():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 400_000, dtype=np.uint8)
    lengths = np.concatenate([np.arange(4 * DEPTH), [0, 100_000, 65_536, DEPTH, 399_000], rng.integers(0, 3000, 200)])
    starts = np.array([rng.integers(0, 400_000 - n + 1) for n in lengths])
    raw = data.tobytes()
    assert crc32(data, starts, starts + lengths).tolist() == [zlib.crc32(raw[a : a + n]) for a, n in zip(starts, lengths, strict=True)]


def test_crc_without_spans():
    none = np.zeros(0, np.int64)
    assert len(crc32(np.zeros(0, np.uint8), none, none)) == 0


# Positions


def test_positions_number_rows_in_order(spark):
    rng = random.Random(5)
    values = [rng.choice([None, 7, rng.randrange(1000)]) for _ in range(3000)]
    table = stored(spark.createDataFrame([(v,) for v in values], "v long").repartition(7), "test")
    got = sorted((r["position"], r["v"]) for r in positions(table, [F.asc_nulls_first("v")]).collect())
    assert [p for p, _ in got] == list(range(3000))
    assert [v for _, v in got] == sorted(values, key=lambda v: (v is not None, v or 0))


# Importance resampling


def brute_resample(rows, target, percent, least, widest, buckets):
    def features(text):
        words = plain(text)
        runs = [" ".join(words[i : i + n]) for n in range(1, widest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    s, t = [0] * buckets, [0] * buckets
    for counts, source in ((s, (r[1] for r in rows)), (t, target)):
        for text in source:
            for b in features(text)[1]:
                counts[b] += 1
    s_all, t_all = sum(s) + buckets, sum(t) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(buckets)]
    out = []
    for i, text, _ in rows:
        n, found = features(text)
        weight = sum(gain[b] for b in found)
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = place
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize(("widest", "percent", "buckets"), [(1, 10, 10_000), (3, 40, 500)])
def test_resampling_equals_brute_force(spark, widest, percent, buckets):
    rows = [*texts(), (90_000, "é" * 500 + " " + "x" * 5000 + " LONG " * 30, "src1")]
    target = [rows[0][1], rows[3][1], None, "", "Tail-end words, 42 of them"]
    given = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(documents(spark, rows, clashing=True), given, percent, 20, widest, buckets)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = brute_resample(rows, target, percent, 20, widest, buckets)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sum(r[5] is not None for r in want) > 3


def test_resampling_of_empty_tables(spark):
    none = documents(spark, [])
    target = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(none, target).count() == 0
    some = importance.resample(documents(spark), target)
    assert some.count() == len(texts()) and some.where("rank is not null").count() > 0


def test_equal_scores_go_to_the_smaller_id_and_long_texts_count_whole(spark):
    text = "word " * 300_000
    rows = [(4, text, "a"), (4, text, "a"), (9, "word " * 25, "a")]
    got = importance.resample(documents(spark, rows), spark.createDataFrame([(1, "other")], "item_id long, text string"), percent=100)
    found = {(r["doc_id"], r["rank"]): r for r in got.collect()}
    assert {n for i, n in found if i == 4} == {2, 3} and found[(4, 2)]["n_features"] == 300_000


# URL rules

PAGE = "page_id long, url string, html string"


def brute_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for h, p, v in rules:
        h, p = "".join(c.lower() if c.isascii() else c for c in h or ""), p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, "", ""), (len(h + p), h + p, v))
    return host, path, best and best[1], best[2] if best else default


URLS = [
    "http://a.example.com/en/1?x=/en/#y", "HTTPS://WWW.Example.COM/en/", "https://example.com", "http://example.com?/en/",
    "ftp://x.net/es/a", "http://net/fr/", "http://notnet/fr/", "http://.net/es/", "http://a..com/", "http://", "://com/", "com/", "",
    None, "http://u:p@host.com:80/x", "http://exämple.com/ÜÉ", "http://com", "http://x.org/a://b", "http://x.com/\n?a", "http://ÀB.COM/A",
]


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], PAGE).repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return url_filter.ruled(pages, table, **more)


def test_rules_of_the_query_on_odd_urls(spark):
    from roadpass.llm.queries import URL_RULES

    got = judged(spark, URLS + URLS[:3], URL_RULES)
    assert got.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict"]
    want = [(i, *brute_verdict(u, URL_RULES)) for i, u in enumerate(URLS + URLS[:3])]
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect())) == want


def many_rules():
    rng = random.Random(11)
    hosts = [f"h{i}.{rng.choice(['com', 'net', 'a.org'])}" for i in range(300)]
    rules = [(h, rng.choice(["", "/", "/a/", "/abc", None]), rng.choice(["allow", "block"])) for h in hosts]
    rules += [(rules[0][0], rules[0][1], "block"), ("", "/x", "block"), (None, "/x", "block"), ("A.ORG", "/Z", "block")]
    urls = [f"http://{rng.choice(['', 'www.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a/b', '/abcd', '/Z'])}" for _ in range(1500)]
    urls += [f"http://free{i}.com/a/{i}" for i in range(4000)]
    return rules, urls


@pytest.mark.parametrize("most", [url_filter.MAX_BITS, 100])
def test_many_rules_by_the_cascade_and_by_joins(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MAX_BITS", most)
    rules, urls = many_rules()
    got = judged(spark, urls, rules, default="block").select("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(tuple, got.collect())) == [(i, *brute_verdict(u, rules, "block")) for i, u in enumerate(urls)]


def test_a_cascade_is_exact_over_its_universe_and_needs_several_levels(spark):
    listed = spark.createDataFrame([(f"k{i}",) for i in range(500)], "key string")
    universe = stored(spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key")), "universe")
    filters = url_filter.cascade(listed, universe)
    assert len(filters.levels) > 3
    got = universe.where(filters.holds(F.col("key"))).select("key").collect()
    assert {r["key"] for r in got} == {f"k{i}" for i in range(500)} and len(got) == 500


def test_no_rules_no_pages_and_clashing_columns(spark):
    assert [tuple(r)[3:] for r in judged(spark, ["http://x.com/a"], []).collect()] == [("x.com", "/a", None, "allow")]
    assert judged(spark, [], [("com", "/", "block")]).count() == 0
    pages = spark.createDataFrame([(1, "http://a.com/", "x", "y", "z")], "page_id long, url string, rule string, key string, words string")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    row = url_filter.ruled(pages, rules).first().asDict()
    assert row["rule"] == "com/" and row["key"] == "y" and row["verdict"] == "block"


def test_the_cascade_joins_nothing_and_runs_no_python(spark):
    rules, urls = many_rules()
    plan = judged(spark, urls, rules)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Python" not in plan and "MapIn" not in plan


# Merkle manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def beside(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 8 * 8
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
        i //= 8
    return out


def brute_manifest(rows, altered):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, h(*map(field, r))))
        trees[g] = tree([h(*map(field, r)) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = beside(trees[g], i) + beside(top, at)
            digest = h(*map(field, altered(r)))
            for left, right in path:
                digest = h(left, digest, right)
            proof = h("".join(a + b for a, b in path))
            out.append((r[0], trees[g][0][i], trees[g][-1][0], top[-1][0], proof, digest, digest == top[-1][0]))
    return sorted(out, key=repr)


def lowered(row):
    i, source, lang, n, text = row
    if i is None or zlib.crc32(str(i).encode()) % 3 or text is None:
        return row
    return i, source, lang, n, "".join(c.lower() if c.isascii() else c for c in text)


def proven(spark, rows, clashing=False):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    for name in (*CLASHING, "tree", "pos", "digest", "changed", "position") if clashing else ():
        docs = docs.selectExpr("*", f"'x' as `{name}`")
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    got = manifest.merkle_manifest(
        docs, alter=F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changes={"text": F.translate("text", upper, lower)}
    )
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.select(*columns).collect()), key=repr)


def test_awkward_rows_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, s, rng.choice([None, "", "de", "en", "é"]), n, t) for i, t, s in texts() for n in (None if t is None else len(t),)]
    rows += [(5, "Ab", "en", 1, "-"), (5, None, "en", None, None), (5, None, "en", None, None), (None, "-", None, 0, "A")]
    assert proven(spark, rows, clashing=True) == brute_manifest(rows, lowered)


@pytest.mark.parametrize("levels", [1, manifest.BLOCK_LEVELS])
def test_trees_of_several_blocks_and_many_groups(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(manifest, "SPAN", manifest.FANOUT**levels)
    sizes = {"hot": 4500, "w": 65, "x": 64, "y": 1, None: 9, **{f"g{i}": 1 + i % 3 for i in range(70)}}
    rows = [(7 * i, "s", g, i, f"Text {i}" if i % 2 else f"text {i}") for g, n in sizes.items() for i in range(n)]
    got = proven(spark, rows)
    assert got == brute_manifest(rows, lowered)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_empty_and_lone_rows(spark):
    assert proven(spark, []) == []
    row = (3, "a", None, 1, "Text")
    (got,) = proven(spark, [row])
    assert got == brute_manifest([row], lowered)[0] and got[1] == got[2] == got[3] and got[4] == sha256(b"").hexdigest()


def test_a_version_shares_untouched_nodes():
    block = manifest.Block([h(str(i)) for i in range(600)], 600)
    before = [list(level) for level in block.levels]
    copied = block.version(77, h("other"))
    assert block.levels == before and len(copied) == len(block.levels)
    changed = list(before[0])
    changed[77] = h("other")
    assert copied[-1] == manifest.Block(changed, 600).root
