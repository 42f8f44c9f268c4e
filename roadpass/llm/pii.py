"""Personal data in texts: base patterns and a semi-Markov conditional random field.

Base spans come from fixed patterns. The random field looks at regions, runs of words that
hold a digit or an @, since a span without either scores zero and stays outside. A region is
cut into runs of letters, runs of digits and single characters. A segmentation of a region
is a sequence of entities of bounded length (``LONGEST`` pieces) and single outside pieces;
its score is the sum of its entities' scores, each a weighted sum of features of the whole
span: shape, counts, checks of the digits, neighbours. Forward and backward sums over all
segmentations give the likelihood and its gradient, dynamic programming gives the best
segmentation and boundaries and types are chosen together.

Weights are fitted by maximum likelihood to the base spans of a bounded sample of different
regions (``SAMPLE``, chosen by hash). Where the base pattern gave up a match, for instance
because a neighbouring number was swallowed, the field can still find the entity. A span
of the best segmentation is added when its probability over all segmentations is at least
``SURE`` and no base span overlaps it. Every text is scanned whole.

Edge cases: a null or empty text has no spans; a null ``doc_id`` is kept; repeated rows are
scanned each; without any base span nothing can be learned and nothing is added; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpass.llm.scratch import release, stored
from roadpass.llm.words import slices

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 3000
LONGEST = 15
SURE = 0.9

# The base patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The same matches in linear time: a run of characters is entered at its start only and
# never given back, so a long run that matches nothing costs one look.
_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_FINDERS = {"card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"), "phone": re.compile(PATTERNS["phone"])}
# What a text must hold for a pattern to match at all.
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_DIGIT = re.compile("[0-9]")
_DIGITS = re.compile("[0-9]++")
_REGION = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+")
_PIECE = re.compile(r"[A-Za-z]+|[0-9]+|\s|[^A-Za-z0-9\s]")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = 2 * d if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in text.split(".")))
    if kind == "email":
        return True
    digits = "".join(_DIGIT.findall(text))
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match for each @ with a name before it and a domain behind, unless an earlier match
    has taken the whole name; a name that it took in part starts after it."""
    end = 0
    for m in _LOCAL.finditer(text):
        start, at = max(m.start(), end), m.end()
        if start < at - 1 and (domain := _DOMAIN.match(text, at)):
            end = domain.end()
            yield start, end


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Every four numbers of a run of numbers with dots between, from its start on."""
    for m in _NUMBERS.finditer(text):
        if m[0].count(".") >= 3:
            ends = [n.end() for n in _DIGITS.finditer(text, *m.span())]
            start = m.start()
            for i in range(3, len(ends), 4):
                yield start, ends[i]
                start = ends[i] + 1


def matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """The spans of the kind's pattern, leftmost and not overlapping."""
    if kind == "email":
        return _emails(text)
    if kind == "ip":
        return _ips(text)
    return (m.span() for m in _FINDERS[kind].finditer(text))


def base_spans(text: str) -> list[Span]:
    """The base spans of a text, ordered by start, then kind."""
    out = []
    if _DIGIT.search(text) or "@" in text:
        for k, kind in enumerate(KINDS):
            if _NEEDS[kind] in text:
                out += [(a, k, b) for a, b in matches(kind, text) if valid(kind, text[a:b])]
    return sorted(out)


def regions(text: str) -> Iterator[re.Match]:
    if _DIGIT.search(text) or "@" in text:
        yield from _REGION.finditer(text)


class Region:
    """Pieces of a region and its candidate segments, made on request."""

    def __init__(self, text: str, before: str, after: str):
        self.pieces = [(m.start(), m.end()) for m in _PIECE.finditer(text)]
        self.tokens = [text[a:b] for a, b in self.pieces]
        self.kinds = ["9" if t[0] in "0123456789" else "a" if t[0].isascii() and t[0].isalpha() else t for t in self.tokens]
        self.before, self.after = before, after
        self.length = len(self.tokens)

    def starting(self, i: int) -> Iterator[tuple[int, int, list[str]]]:
        """(end, kind, features) of the candidates that start at piece ``i``.

        A candidate holds one @, or no letters and 7 to 19 digits; it ends in letters or
        digits and starts neither with white space nor inside a word.
        """
        kinds, n = self.kinds, self.length
        left = kinds[i - 1] if i else self.before
        if kinds[i].isspace() or (i and kinds[i] in "9a" and left in "9a"):
            return
        digits, at, shape, groups = "", 0, "", []
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            kind = kinds[j - 1]
            shape += kind
            if kind == "9":
                digits += self.tokens[j - 1]
                groups.append(self.tokens[j - 1])
            at += kind == "@"
            if at > 1 or (not at and len(digits) > 19 and "a" not in shape):
                return
            if kind not in "9a":
                continue
            right = kinds[j] if j < n else self.after
            if at:
                yield j, 0, _features(0, shape, digits, groups, left, right)
            elif "a" not in shape and len(digits) >= 7:
                for k in range(1, len(KINDS)):
                    yield j, k, _features(k, shape, digits, groups, left, right)

    @property
    def segments(self) -> list[tuple[int, int, int, list[str]]]:
        return [(i, j, k, names) for i in range(self.length) for j, k, names in self.starting(i)]


def _near(c: str) -> str:
    return "none" if not c else "space" if c.isspace() else c if c in "9.-+@(" else "a" if c.isalpha() else "mark"


def _features(k: int, shape: str, digits: str, groups: list[str], left: str, right: str) -> list[str]:
    """Names of the whole-span features of one kind."""
    marks = "".join(sorted(set(shape) - {"a", "9"}))
    if k == 0:
        domain = shape[shape.index("@") + 1 :]
        names = ["bias", f"marks {marks[:8]}", f"dot {'.' in domain}", f"labels {min(domain.count('.'), 4)}", f"local {shape[:1]}"]
    else:
        dotted = len(groups) == 4 and marks == "." and all(len(g) <= 3 and int(g) <= 255 for g in groups)
        names = [
            "bias",
            f"shape {shape[:24]}",
            f"digits {min(len(digits), 20)}",
            f"groups {min(len(groups), 6)}",
            f"marks {marks[:8]}",
            f"check {luhn(digits)} {14 <= len(digits) <= 19}",
            f"parts {dotted}",
            f"plus {shape[0] == '+'}",
        ]
    return [f"{KINDS[k]} {x}" for x in [*names, f"left {_near(left)}", f"right {_near(right)}", f"sides {_near(left)} {_near(right)}"]]


class Field:
    """The weights and the sums over segmentations."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, names: list[str]) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in names)

    def marginals(self, length: int, segments: list) -> tuple[list[float], float]:
        """The probability of each of all candidate segments, and the log of the normaliser."""
        scored = [(i, j, self.score(names)) for i, j, _, names in segments]
        forward, backward = [0.0] * (length + 1), [0.0] * (length + 1)
        ending, starting = [[] for _ in range(length + 1)], [[] for _ in range(length + 1)]
        for i, j, s in scored:
            ending[j].append((i, s))
            starting[i].append((j, s))
        for j in range(1, length + 1):
            forward[j] = _log_sum([forward[j - 1], *(forward[i] + s for i, s in ending[j])])
        for i in range(length - 1, -1, -1):
            backward[i] = _log_sum([backward[i + 1], *(backward[j] + s for j, s in starting[i])])
        total = forward[length]
        return [math.exp(min(0.0, forward[i] + s + backward[j] - total)) for i, j, s in scored], total

    def decode(self, region: Region) -> list[tuple[int, int, int, float]]:
        """(start, end, kind, probability) of the entities of the best segmentation.

        Candidates are made start by start and not kept, so memory follows the region's
        length however many candidates it has.
        """
        n = region.length
        low = -math.inf
        forward, best, back = [0.0] + [low] * n, [0.0] + [low] * n, [None] * (n + 1)
        for i in range(n):
            forward[i + 1] = _log_sum([forward[i + 1], forward[i]])
            if best[i] >= best[i + 1]:
                best[i + 1], back[i + 1] = best[i], None
            for j, k, names in region.starting(i):
                s = self.score(names)
                forward[j] = _log_sum([forward[j], forward[i] + s])
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, k, s)
        path, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, k, s = back[j]
                path.append((i, j, k, s))
                j = i
        if not path:
            return []
        backward = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            backward[i] = _log_sum([backward[i + 1], *(self.score(names) + backward[j] for j, _, names in region.starting(i))])
        return [(i, j, k, math.exp(min(0.0, forward[i] + s + backward[j] - forward[n]))) for i, j, k, s in reversed(path)]

    def add(self, text: str, base: list[Span]) -> list[Span]:
        """Sure spans of a text that no base span overlaps."""
        found = []
        for m in regions(text):
            region = Region(m[0], text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1])
            for i, j, k, probability in self.decode(region):
                if probability >= SURE:
                    found.append((m.start() + region.pieces[i][0], k, m.start() + region.pieces[j - 1][1]))
        if not found or not base:
            return found
        inside = np.zeros(len(text) + 1, bool)
        for a, _, b in base:
            inside[a:b] = True
        return [s for s in found if not inside[s[0] : s[2]].any()]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def fit(examples: list[tuple[str, str, str, list[Span]]], rounds: int = 5, rate: float = 0.5) -> Field:
    """Maximum likelihood by stochastic gradients with per-weight rates."""
    weights: dict[str, float] = {}
    power: dict[str, float] = {}
    field = Field(weights)
    ready = []
    for text, before, after, gold in examples:
        region = Region(text, before, after)
        segments, places = region.segments, {(a, k, b) for a, k, b in gold}
        if segments:
            target = [float((region.pieces[i][0], k, region.pieces[j - 1][1]) in places) for i, j, k, _ in segments]
            ready.append((region.length, segments, target))
    for _ in range(rounds):
        for length, segments, target in ready:
            probability, _ = field.marginals(length, segments)
            for (_, _, _, names), want, have in zip(segments, target, probability, strict=True):
                gap = want - have
                if abs(gap) > 1e-4:
                    for f in names:
                        power[f] = power.get(f, 1e-2) + gap * gap
                        weights[f] = weights.get(f, 0.0) * (1 - 1e-5) + rate * gap / math.sqrt(power[f])
    return field


def examples(texts: DataFrame, sample: int) -> list[tuple[str, str, str, list[Span]]]:
    """At most ``sample`` different regions with their base spans, by smallest hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text in part.column("text").to_pylist():
                base = base_spans(text) if text else []
                for m in regions(text or ""):
                    a, b = m.span()
                    if b - a <= 200:
                        gold = ",".join(f"{s - a}:{k}:{e - a}" for s, k, e in base if a <= s and e <= b)
                        rows.append((m[0], text[a - 1 : a], text[b : b + 1], gold))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.record_batch([pa.array(c, pa.string()) for c in columns], ["region", "before", "after", "gold"])

    # Stored, so that the texts are scanned once for both halves of the sample.
    found = stored(
        texts.select("text")
        .mapInArrow(run, "region string, before string, after string, gold string")
        .groupBy("region", "before", "after")
        .agg(F.min("gold").alias("gold")),
        "regions",
    )
    hashed = found.withColumn("hash", F.xxhash64("region", "before", "after"))
    out = []
    # As many with spans as without, so that the sample shows every kind.
    for part in (hashed.where("gold <> ''"), hashed.where("gold = ''")):
        for r in part.orderBy("hash", "region", "before", "after").limit(sample // 2).collect():
            spans = [tuple(map(int, s.split(":"))) for s in r["gold"].split(",") if s]
            out.append((r["hash"], r["region"], r["before"], r["after"], spans))
    release(found)
    return [row[1:] for row in sorted(out)]


def find_personal_data(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, base_spans and added_spans: arrays of (kind, start, end) in code points."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    field = fit(examples(texts, sample))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            base, added = [], []
            for text in part.column("text").to_pylist():
                spans = base_spans(text) if text else []
                base.append(spans)
                added.append(field.add(text, spans) if text and field.weights else [])
            columns = [
                pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in found], span)
                for found in (base, added)
            ]
            yield pa.record_batch([part.column("doc_id"), *columns], ["doc_id", "base_spans", "added_spans"])

    spans = "array<struct<kind:string,start:long,end:long>>"
    return texts.mapInArrow(run, f"doc_id long, base_spans {spans}, added_spans {spans}")
