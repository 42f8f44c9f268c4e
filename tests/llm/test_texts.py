"""Operators on documents against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import types
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from roadpass.llm import lm, mixing, near_dup, packing, pii, quality, substring_dedup, word_contexts
from tests.llm.samples import documents, texts, words


def counted(rows):
    return collections.Counter(rows)


@pytest.mark.parametrize("clashing", [False, True])
def test_substring_dedup_equals_brute_force(spark, clashing):
    got = counted(
        (r.doc_id, r.n_words, r.n_removed, r.kept_text)
        for r in substring_dedup.remove_repeats(documents(spark, clashing=clashing)).collect()
    )
    first = {}
    for i, t, _ in sorted((r for r in texts() if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = collections.Counter()
    for i, t, _ in texts():
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want[(i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())] += 1
    assert got == want
    assert sum(r[2] for r in want) > 1000


def test_substring_dedup_joins_overlapping_ranges():
    bounds = np.array([0, 12, 12, 20])
    lists = pa.array(
        [[(5, 4), (0, 3), (3, 1), (8, 9)], None, [(0, 2), (7, 1)]],
        pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])),
    )
    covered = substring_dedup.cover(bounds, lists)
    spans = [[(x["start"], x["length"]) for x in found] for found in substring_dedup.maximal(bounds, covered).to_pylist()]
    assert spans == [[(0, 4), (5, 7)], [], [(0, 2), (7, 1)]]


def shingle_set(text, width):
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    rows = texts()
    # A chain: each links to the next only.
    base = [f"w{i}" for i in range(120)]
    for k in range(5):
        rows.append((90_000 + k, " ".join(base[6 * k :] + [f"x{i}" for i in range(6 * k)]), "chain"))
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(documents(spark, rows), width, percent).collect()}
    sets = collections.defaultdict(set)
    for i, t, _ in rows:
        if i is not None:
            sets[i].add(shingle_set(t, width))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            for a in sets[x]:
                for b in sets[y]:
                    if x < y and a and b and 100 * len(a & b) >= percent * len(a | b):
                        lo, hi = sorted((root(x), root(y)))
                        parent[hi] = lo
    want = {(i, len(s), root(i), root(i) == i) for i in ids for s in sets[i]}
    want |= {(None, len(shingle_set(t, width)), None, True) for i, t, _ in rows if i is None}
    assert got == want


def test_sketch_fills_every_bin():
    code = np.array([7, 8, 9], np.uint64)
    sketch = near_dup.fill_bins(code, np.zeros(3, np.int64), 1, 64)
    assert (sketch != np.uint64(2**64 - 1)).all()


def test_sketch_agrees_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    shared, own = rng.integers(0, 2**63, 700, dtype=np.uint64), rng.integers(0, 2**63, 300, dtype=np.uint64)
    one, two = np.concatenate([shared, own[:150]]), np.concatenate([shared, own[150:]])
    rows = np.repeat([0, 1], [len(one), len(two)])
    a, b = near_dup.fill_bins(np.concatenate([one, two]), rows, 2, 512)
    assert abs((a == b).mean() - 0.7) < 0.1


def test_blocks_of_a_hot_bucket_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(40):
        w = list(base)
        w[k % 20] = f"a{k}"
        w[20 + k % 7] = f"b{k % 3}"
        rows.append((k, " ".join(w), "s"))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(documents(spark, rows), 3, 85).collect()}
    sets = {i: shingle_set(t, 3) for i, t, _ in rows}
    comp = {i: i for i in sets}
    for _ in range(40):
        for x in sets:
            for y in sets:
                if 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                    comp[x] = comp[y] = min(comp[x], comp[y])
    assert got == comp


def test_links_of_a_cell_are_told_by_a_row_a_member():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 30):
        for _ in range(30):
            half = np.triu(rng.random((n, n)) < 1.5 / max(n, 1), 1)
            linked = half | half.T
            want = np.arange(n)
            for _ in range(n):
                for x, y in zip(*np.nonzero(linked), strict=True):
                    want[x] = min(want[x], want[y])
            assert near_dup.first_linked(linked).tolist() == want.tolist()


@pytest.mark.parametrize("parts", [1, 7])
def test_repeated_ids_with_unlike_texts_keep_every_link(spark, monkeypatch, parts):
    """Ids stand for several texts of the same buckets; links go through all of them."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = random.Random(6)
    rows = []
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(80)]
        for k in range(18):
            w = list(base)
            for at in rng.sample(range(80), rng.choice([1, 2, 3, 5])):
                w[at] = f"x{rng.randrange(5)}"
            # Every ninth id holds texts of several groups.
            rows.append((9 * group + k % 9 if k % 9 else 500 + k, " ".join(w), "s"))
    rows += rows[:5]
    docs = documents(spark, rows).repartition(parts)
    got = {}
    for r in near_dup.near_duplicates(docs, 3, 85).collect():
        assert got.setdefault(r.doc_id, r.component_id) == r.component_id
        assert r.kept == (r.doc_id == r.component_id)
    sets = [(i, shingle_set(t, 3)) for i, t, _ in rows]
    comp = {i: i for i, _ in sets}
    for _ in range(20):
        for i, x in sets:
            for j, y in sets:
                if 100 * len(x & y) >= 85 * len(x | y):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert got == comp and len(set(comp.values())) > 3


def test_mix_meets_targets(spark):
    rows = mixing.mix_sources(documents(spark, clashing=True)).collect()
    size = counted((i, len(words(t))) for i, t, _ in texts())
    assert counted((r.doc_id, r["size"]) for r in rows) == size
    total, target, taken = collections.Counter(), {}, collections.Counter()
    for r in rows:
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r["size"]
        total[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        smallest = min([x["size"] for x in rows if x.source == r.source and x["size"]], default=0)
        assert r.source_size == sum(x["size"] for x in rows if x.source == r.source)
        assert smallest >= 0
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    limit = {s: 2 * total[s] for s in names}
    full: set = set()
    while True:
        left = 1.5 * sum(total.values()) - sum(limit[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * weight[s] / open_weight > limit[s]}
        if not over:
            break
        full |= over
    for s in names:
        want = limit[s] if s in full else left * weight[s] / open_weight
        assert target[s] == pytest.approx(want)
        assert abs(taken[s] - want) <= max(r["size"] for r in rows if r.source == s)


def test_mix_is_repeatable_and_tilts_by_size(spark):
    df = documents(spark)
    one = counted(tuple(r) for r in mixing.mix_sources(df).collect())
    two = counted(tuple(r) for r in mixing.mix_sources(df.repartition(3, "text")).collect())
    assert one == two


def test_mixed_rows_repeat_documents(spark):
    df = documents(spark, clashing=True)
    got = mixing.mixed_rows(df)
    assert got.columns == df.columns
    copies = collections.Counter()
    for r in mixing.mix_sources(df).collect():
        copies[r.doc_id] += r.copies
    assert counted(r.doc_id for r in got.collect()) == +copies


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("fast", [False, True])
def test_packing_round_trip(spark, fast):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken") if fast else None
    rows = packing.pack(documents(spark), path, ranks).collect()
    exact = tokenizer()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    want = collections.Counter()
    for i, t, _ in texts():
        ids = exact.encode(t or "", add_special_tokens=False).ids + [0]
        rest = len(ids) % 2048 or 2048
        at = [0, *range(rest, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert counted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for found in sequences.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 2048
    lengths = [r.length for r in rows]
    assert len(sequences) == plain_best_fit(lengths, 2048)


def plain_best_fit(lengths, capacity):
    rooms: list[int] = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(capacity - length)
    return len(rooms)


def test_runs_pack_like_single_documents():
    rng = np.random.default_rng(5)
    for capacity in (10, 37, 64):
        for _ in range(20):
            lengths = rng.integers(1, capacity + 1, 200).tolist()
            counts = collections.Counter(lengths)
            plan = packing.best_fit_decreasing(dict(counts), capacity)
            assert plan[:, 2].max() < plain_best_fit(lengths, capacity)
            filled: dict[tuple, int] = {}
            for length, n in counts.items():
                mine = plan[plan[:, 0] == length]
                for rank in range(n):
                    row = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
                    k = rank - row[1]
                    place = (row[2] + k // row[3], row[4] + k % row[3] * length)
                    assert place not in filled
                    filled[place] = length
            ends = collections.defaultdict(int)
            for (bin_, offset), length in sorted(filled.items()):
                assert offset == ends[bin_]
                ends[bin_] += length
                assert ends[bin_] <= capacity


def test_rare_characters_and_special_strings_are_encoded_alike():
    path = public_tokenizers.path("byte_bpe_50k.json")
    fast, exact = packing.Encoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken")), packing.Encoder(path)
    for text in ("", " a", "a  b", "a\n b", "x<|endoftext|> y", "é ñ", "中文 ab", "it's 12³ x", "\x1c a\x85b"):
        assert fast.encode(text) == exact.encode(text)


def test_language_model_counts_and_beats_single_words(spark):
    rows = lm.score_texts(documents(spark, clashing=True)).collect()
    train, kept = collections.Counter(), []
    for i, t, _ in texts():
        w = words(t, lower=True) + [b""]
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        kept.append((i, held, w))
        if not held:
            train.update(w)
    n, v = sum(train.values()), len(train)
    want = counted(
        (i, held, len(w), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6))
        for i, held, w in kept
    )
    got = counted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == want
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in rows)


def test_blocks_of_the_language_model_do_not_follow_the_batches(monkeypatch):
    """Many small batches make few blocks, as a large one does, so batches may be small."""
    monkeypatch.setattr(lm, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(lm, "PIECE_BYTES", 300)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 3000)
    rng = random.Random(5)
    rows = [(i, i % 3 == 0, None if i % 10 == 0 else " ".join(rng.choice(["Aa", "b", "çd", "e"]) for _ in range(i))) for i in range(100)]
    whole = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.string()), strict=True)], ["doc_id", "held_out", "text"])
    small = [whole.slice(i, 1) for i in range(100)]
    cut = [[r for b in lm._blocks(8)(iter(batches)) for r in b.to_pylist()] for batches in ([whole], small)]
    texts = [[r for r in c if r["part"] == -1] for c in cut]
    assert 1 < len(texts[0]) < 30 and 1 < len(texts[1]) < 30
    for name in ("doc_id", "held_out", "sizes", "bytes"):
        one, many = ([x for r in t for x in r[name]] for t in texts)
        assert one == many and len(one) == 100
    hashes = [{h for r in t for h in np.frombuffer(r["hashes"], np.uint64).tolist()} for t in texts]
    assert hashes[0] == hashes[1] and len(hashes[0]) == 5


def held_out_ids(held, n):
    return [i for i in range(10_000) if (zlib.crc32(str(i).encode()) % 5 == 1) == held][:n]


def test_word_order_matters_to_the_language_model(spark):
    """Texts of the same words in their usual and in another order."""
    rng = random.Random(3)
    phrases = [[f"w{rng.randrange(60)}" for _ in range(6)] for _ in range(12)]

    def text():
        return [w for _ in range(8) for w in rng.choice(phrases)]

    rows = [(i, " ".join(text()), "s") for i in held_out_ids(False, 60)]
    usual = [text() for _ in range(5)]
    ids = held_out_ids(True, 10)
    rows += [(i, " ".join(w), "s") for i, w in zip(ids, usual, strict=False)]
    rows += [(i, " ".join(rng.sample(w, len(w))), "s") for i, w in zip(ids[5:], usual, strict=True)]
    got = {r.doc_id: r for r in lm.score_texts(documents(spark, rows)).collect()}
    for a, b in zip(ids[:5], ids[5:], strict=True):
        assert got[a].base_score == pytest.approx(got[b].base_score) and got[a].score > got[b].score + 20
        assert got[a].bits_per_byte < got[b].bits_per_byte


def test_language_model_beats_word_frequencies_by_half_a_digit(spark):
    """Held-out texts of a whole table, against c / N with the same mass for unknown words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = collections.Counter(), []
    for r in docs.select("doc_id", "text").collect():
        w = words(r.text, lower=True) + [b""]
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 1:
            held.append(w)
        else:
            train.update(w)
    n, once = sum(train.values()), sum(c == 1 for c in train.values())
    unknown, tokens = once / n, sum(map(len, held))
    plain = sum(math.log10((1 - unknown) * train[x] / n if train[x] else unknown) for w in held for x in w) / tokens
    got = lm.score_texts(docs).where("held_out").selectExpr("sum(score) / sum(n_tokens)").first()[0]
    assert plain == pytest.approx(-3.309, abs=0.001) and got > plain + 0.5


def test_predictions_after_two_words_equal_counts(spark):
    """Frequencies come back to every token whatever the parts, and add up to one."""
    rng = np.random.default_rng(5)
    blocks, want = [], collections.Counter()
    for b in range(3):
        rows = np.repeat(np.arange(4), 50)
        tokens = rng.integers(101, 106, 200).astype(np.uint64)
        training = np.array([1.0, 1.0, 0.0, 1.0])
        blocks.append((b, tokens, rows, training))
    for _, tokens, rows, training in blocks:
        for i in range(200):
            before = [int(tokens[i - k]) if i >= k and rows[i - k] == rows[i] else -k for k in (1, 2)]
            if training[rows[i]]:
                want[(*before, int(tokens[i]))] += 1
                want[tuple(before)] += 1
    for parts in (1, 5):
        packed = [word_contexts.block_pairs(b, t, r, tr, parts) for b, t, r, tr in blocks]
        pairs = spark.createDataFrame([row for rows in packed for row in rows], word_contexts.PAIRS)
        found = [r.asDict() for r in word_contexts.predictions(pairs).collect()]
        for b, tokens, rows, _ in blocks:
            place = word_contexts.placed(tokens, rows, parts)[2]
            p, frequency = word_contexts.shares([r for r in found if r["block"] == b], word_contexts.blank())
            for i in range(200):
                before = tuple(int(tokens[i - k]) if i >= k and rows[i - k] == rows[i] else -k for k in (1, 2))
                seen = want[before]
                assert frequency[place[i]] == pytest.approx(want[(*before, int(tokens[i]))] / seen if seen else 0, rel=1e-3)
                assert (p[place[i]] > 0) == (seen > 0)


def test_spelled_probabilities_add_up_to_one_at_most():
    from roadpass.llm import context_mixing as M

    rng = np.random.default_rng(2)
    table = rng.integers(0, 5, (M.CHUNKS << M.SLOT_BITS, 2)).astype(np.float32)
    model = M.Model(table)
    # All words of one byte, the empty word (the end), and nothing longer.
    every = [bytes([b]) for b in range(256) if b not in (10, 32)] + [b""]
    assert (10 ** model.log10(every)).sum() < 1
    total = 0.0
    for byte in range(256):
        s = M.Spellings([bytes([byte])]) if byte not in (10, 32) else M.Spellings([b""])
        assert len(s.edge) == (2 if byte not in (10, 32) else 1)
    for first in every[:3]:
        longer = [first + bytes([b]) for b in range(33, 127)]
        total += (10 ** model.log10(longer)).sum()
    assert total < 1


# The patterns and checks of the contract, written out again.
PLAIN_PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    out = []
    for k, pattern in enumerate(PLAIN_PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if k == 1 and any(int(p.lstrip("0")[:4] or 0) > 255 for p in m[0].split(".")):
                continue
            if k == 2:
                doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if k == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_linear_finders_equal_plain_patterns():
    rng = random.Random(8)
    for alphabet in ("01.", "a@.", "a1@.-_ ", "1 -", "+1() .-", "25.0", "a@b.c_%+-9 \n"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            for kind, pattern in zip(pii.KINDS, PLAIN_PATTERNS, strict=True):
                assert list(pii.matches(kind, text)) == [m.span() for m in re.finditer(pattern, text)], (kind, text)
            assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time(spark):
    size = 1_000_000
    parts = ["0" * 5000 + ".1.1.1", "9" * 5000 + ".1.1.1"]
    runs = ["a" * size + " 5 @", "7" * size, "1." * (size // 2), "a@" * (size // 2), "é" * size + "1", "-" * size + "@", "+1" + "(" * size]
    begin = time.monotonic()
    rows = pii.find_personal_data(documents(spark, [(i, t, "s") for i, t in enumerate(parts + runs)])).collect()
    assert time.monotonic() - begin < 60
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base_spans] for r in rows}
    assert found[0] == [("ip", 0, 5006)] and found[1] == [] and len(found[4]) == size // 8


def test_personal_data_base_spans_and_additions(spark):
    rows = [
        (1, "mail a.b%c@x-y.example.com now, call +1 (743) 555-3824 or 10.0.0.255 not 10.0.0.256", "s"),
        (2, "card 4465758382889437 4465758382889437 twice", "s"),
        (3, None, None),
        (4, "", None),
        (5, "ümläut@x.de and +49 30 1234567 and 1234567890123456", "s"),
        (None, "card 4316-5226-7852-5446", "s"),
        (7, "9" * 5000, "s"),
    ]
    numbers = [n for n in (str(4316_5226_0000_0000 + 7919 * i) for i in range(1200)) if pii.luhn(n)]
    rows += [(100 + i, f"word word {n} word", "s") for i, n in enumerate(numbers)]
    got = {r.doc_id: r for r in pii.find_personal_data(documents(spark, rows, clashing=True)).collect()}
    for i, text, _ in rows:
        want = plain_spans(text or "")
        assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in got[i].base_spans] == sorted(want)
        for s in got[i].added_spans:
            assert all(s.end <= b.start or b.end <= s.start for b in got[i].base_spans)
    assert {s.kind for s in got[1].base_spans} == {"email", "ip", "phone"}
    # The base pattern swallows both numbers and gives up.
    assert [text for text in got[2].base_spans] == []
    assert [(s.start, s.end) for s in got[2].added_spans] == [(5, 21), (22, 38)]


@pytest.mark.parametrize("text", ["12 345678901234 5", "a.b@c.de 1234567 89", "+1 (23) 456-7890"])
def test_segment_probabilities_equal_enumeration(text):
    region = pii.Region(text, "", "")
    segments = region.segments
    field = pii.Field({f: 0.1 * (k % 5) - 0.1 for k, s in enumerate(segments) for f in s[3]})
    scores = [field.score(s[3]) for s in segments]
    probability, total = field.marginals(region.length, segments)

    def walk(at):
        if at == region.length:
            yield [], 0.0
            return
        for rest, s in walk(at + 1):
            yield rest, s
        for c, (i, j, _, _) in enumerate(segments):
            if i == at:
                for rest, s in walk(j):
                    yield [c, *rest], s + scores[c]

    every = list(walk(0))
    z = sum(math.exp(s) for _, s in every)
    assert total == pytest.approx(math.log(z))
    for c in range(len(segments)):
        assert probability[c] == pytest.approx(sum(math.exp(s) for path, s in every if c in path) / z)
    best = field.decode(region)
    assert sum(field.score(next(n for a, b, kk, n in segments if (a, b, kk) == (i, j, k))) for i, j, k, _ in best) == pytest.approx(
        max(s for _, s in every)
    )
    for i, j, k, p in best:
        assert p == pytest.approx(next(q for (a, b, kk, _), q in zip(segments, probability, strict=True) if (a, b, kk) == (i, j, k)))


def test_long_tables_of_numbers_are_decoded():
    text = " ".join(str(7 * i % 1000) for i in range(4000))
    assert pii.Field({"card bias": -9.0, "ip bias": -9.0, "phone bias": -9.0}).add(text, []) == []


def test_quality_classifier_on_held_out_labels(spark):
    import random

    from tests.llm.samples import prose

    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        text = prose(rng, rng.randint(40, 120))
        kind = i % 6
        if kind == 0:
            text = "".join(w + "### " for w in text.split())
        elif kind == 1:
            text = " ".join(w for w in text.split()[:6] for _ in range(15))
        elif kind == 2:
            text += " wretched scoundrel" + " vile" * (i % 2)
        rows.append((i, text, "s"))
        if i % 2 == 0 or i % 3 == 2:
            labels.append((i, int(kind > 1), int(kind == 2)))
    rows += [(900, None, None), (901, "", "s"), (None, prose(rng, 50), "s"), (5, rows[5][1], "s")]
    frame = documents(spark, rows, clashing=True)
    table = spark.createDataFrame(labels + [(None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    scorer = quality.fit(frame, table)
    got = {r.doc_id: r.rejected for r in scorer.score(frame).collect()}
    held = [i for i in range(300) if i not in {x[0] for x in labels}]
    right = sum(got[i] == (i % 6 <= 2) for i in held)
    assert right >= 0.97 * len(held)
    assert not got[900] and not got[901]
    kept = scorer.keep(frame)
    assert kept.columns == frame.columns
    assert counted(r.doc_id for r in kept.collect()) == counted(i for i, _, _ in rows if not got[i])


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(8)
    truth = rng.random(20000) < 0.3
    accuracy = [0.95, 0.8, 0.7]
    votes = np.stack([np.where(rng.random(20000) < a, truth, ~truth) for a in accuracy], axis=1)
    codes = np.where(votes, 1, 2) @ np.array([9, 3, 1])
    p = quality.expectation_maximisation(dict(collections.Counter(codes.tolist())), 3)
    said = np.array([p[c] for c in codes.tolist()]) > 0.5
    assert (said == truth).mean() > 0.93


def test_empty_tables(spark):
    none = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert substring_dedup.remove_repeats(none).count() == 0
    assert near_dup.near_duplicates(none, 3, 85).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert packing.pack(none, path).count() == 0
    assert lm.score_texts(none).count() == 0
    assert pii.find_personal_data(none).count() == 0
    assert quality.fit(none, labels).score(none).count() == 0


def test_removed_text_is_hashed_like_the_contract(spark):
    r = substring_dedup.remove_repeats(documents(spark, [(1, " a \t b\n", "s")])).first()
    assert hashlib.sha256(r.kept_text.encode()).hexdigest() == hashlib.sha256(b"a b").hexdigest()
