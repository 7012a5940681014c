"""Personal data: base patterns, high-recall candidate spans around them, and boosted trees that decide on the candidates.

Generators propose overlapping spans whose format is looser than the base patterns': addresses written with ``at`` and
``dot``, numbers grouped with other marks, phone numbers without ``+``. Features describe a span's format and its
context. The trees learn from all texts, with base matches and disguised copies of them as positive examples and
look-alikes that fail a check as negative ones; per kind, the threshold is the lowest at which a held-back part of
them reaches the wanted precision. Base matches are always kept.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.arrow import append, fresh, map_batches, slices
from geoloom.llm.workspace import Workspace

KINDS = ("email", "ip", "card", "phone")
TEXT_SPANS = 16              # examples that those of one text weigh at most, per kind and label
WANTED_PRECISION = 0.98
LEAST_CALIBRATION = 20       # examples above a threshold, below which a kind adds nothing
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 16
UNIT, STEPS = 1_024, 65_536  # of weights, and of derivatives and probabilities, which are added up in whole numbers
ROWS_PER_PASS = 100_000      # different examples for one task of a pass

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run is never entered in its middle: its rest would fail or match as the whole does
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# candidates: an address in words, a loose group of digits, a number in brackets
_AT = re.compile(r"[ ]at[ ]|[\[({]\s?at\s?[\])}]|\s?@\s?")
_AFTER_AT = re.compile(r"\s?[A-Za-z0-9-]{1,63}(?:(?:\s?[\[({]\s?dot\s?[\])}]\s?|[ ]dot[ ]|\.)[A-Za-z0-9-]{1,63})+(?![\w-])")
_LOOSE = re.compile(r"(?<![0-9A-Za-z])\(?\+?[0-9](?:[ ()./_·-]{0,2}[0-9])*+")
_GROUP = re.compile(r"(?:\A\(?\+?|\()?[0-9]++")
MOST_DIGITS = 25             # of a proposed span, so that a run of any length proposes at most 25 spans per group
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, in order; every pattern runs in time linear in the text."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((a, 0, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Overlapping ``(start, kind, end)`` proposals; base spans are among them only where a generator finds them too."""
    out = []
    if "@" in text or " at " in text or "at]" in text or "at)" in text or "at}" in text:
        done = 0                                 # a local part ends before the address ahead of it, so no character is walked twice
        for m in _AT.finditer(text):
            end = m.start() - (m.start() > done and text[m.start() - 1].isspace())
            a = end
            while a > done and text[a - 1] in _LOCAL:
                a -= 1
            if a < end and (after := _AFTER_AT.match(text, m.end())):
                out.append((a, 0, after.end()))
            done = m.start()
    if _DIGIT.search(text):
        for m in _LOOSE.finditer(text):
            out += _sub_runs(text, m.start(), m.end())
    return out


def _sub_runs(text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Proposals from every stretch of whole groups of a maximal run, so that neighbouring numbers don't hide each other."""
    groups = [(start + g.start(), start + g.end(), len(g[0].lstrip("(+"))) for g in _GROUP.finditer(text[start:end])]
    if text[end:end + 1].isalnum() and text[end:end + 1].isascii():
        groups.pop()                 # the last group goes on as a word
    for i, (a, e, n) in enumerate(groups):
        j, dots = i, 0
        while n <= MOST_DIGITS:
            if 12 <= n <= 19:
                yield a, 2, e
            if 7 <= n <= 15:
                yield a, 3, e
            if n >= 7 and dots == 3:
                yield a, 1, e
            j += 1
            if j == len(groups):
                break
            dots += text.count(".", e, groups[j][0])
            e = groups[j][1]
            n += groups[j][2]


@lru_cache(4_096)
def _left(left: str) -> tuple[float, ...]:
    """What stands before a span; spans of one run share it."""
    near = [w.lower() for w in _WORD.findall(left)[-2:]]
    # the words before a span are hashed to a few buckets: a stand-in for a vocabulary
    words = [float(any(zlib.crc32(w.encode()) % 8 == k for w in near)) for k in range(8)]
    return (float(left[-1:].isspace() or not left), float(left[-1:].isalnum()), float(sum(c.isdigit() for c in left)), float("\n" in left[-5:]), *words)


@lru_cache(4_096)
def _right(right: str) -> tuple[float, ...]:
    return float(right[:1].isspace() or not right), float(right[:1].isalnum()), float(sum(c.isdigit() for c in right))


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format of a span and its context, 40 characters to each side."""
    s, left, right = text[start:end], text[max(0, start - 40):start], text[end:end + 40]
    (space, word, before, line, *words), (space_after, word_after, after) = _left(left), _right(right)
    digits = _digits(s)
    groups = re.split(r"[^0-9A-Za-z]+", s.strip("()+ "))
    sizes = [len(g) for g in groups if g]
    marks = [c for c in s if not c.isalnum()]
    return [float(kind == 0), float(kind == 1), float(kind == 2), float(kind == 3), float(len(s)), float(len(digits)),
            len(digits) / max(1, len(s)), float(len(sizes)), float(max(sizes, default=0)), float(min(sizes, default=0)),
            float(len(set(sizes[:4])) == 1), float(len(marks)), float(len(set(marks))), float("." in marks), float("-" in marks),
            float(" " in marks), float("(" in marks), float("@" in marks), float(s[:1] == "+"), float(s[:2] == "00"),
            float(12 <= len(digits) <= 19 and luhn(digits)), float(max(map(int, (g[:9] for g in groups if g[:9].isdigit())), default=0) <= 255),
            float(digits[:1] == "4"), float(digits[:1] == "5"), float(len(sizes) > 1 and 2 <= sizes[-1] <= 6 and groups[-1].isalpha()),
            space, space_after, word, word_after, before, after, line, *words]


def disguises(text: str, start: int, kind: int, end: int) -> list[tuple[str, int, int]]:
    """Copies of a base match in other formats, each ``(text, start, end)`` with the same context."""
    s, left, right = text[start:end], text[max(0, start - 40):start], text[end:end + 40]
    if kind == 0:
        user, _, domain = s.partition("@")
        forms = [f"{user} at {domain.replace('.', ' dot ')}", f"{user}[at]{domain}", f"{user} @ {domain}"]
    elif kind == 2:
        d = _digits(s)
        forms = [sep.join(d[i:i + 4] for i in range(0, len(d), 4)) for sep in (".", "/", "_")]
    elif kind == 3:
        d = _digits(s)
        forms = ["00" + d, f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}"]
    else:
        forms = []
    return [(left + f + right, len(left), len(left) + len(f)) for f in forms]


def decoys(text: str, start: int, kind: int, end: int) -> list[tuple[str, int, int]]:
    """Look-alikes that are no personal data, in the place of a base match: digits that fail a check, plain figures, prose."""
    s = text[start:end]
    left, right, d = text[max(0, start - 40):start], text[end:end + 40], _digits(s) or "1234567"
    if kind == 0:
        forms = [f"{s.partition('@')[0]} at {s.partition('@')[2].split('.')[0]}. {right.strip()[:6] or 'so'}"]
    elif kind == 2:
        wrong = d[:-1] + str((int(d[-1]) + 1) % 10)
        forms = [wrong, " ".join(wrong[i:i + 4] for i in range(0, len(wrong), 4)), "/".join(d[i:i + 2] for i in range(0, 12, 2)), d[:8]]
    elif kind == 3:
        forms = [d[:7], f"{d[:4]}-{d[4:6]}-{d[6:8]}", f"{d[:3]} {d[3:6]} {d[6:9]}", f"{d[:2]}.{d[2:4]}.{d[4:8]}"]
    else:
        forms = [f"{d[:1]}.{d[1:2]}.{d[2:3]}.9999", f"3.{d[:3]}.{d[3:6]}.{d[:4]}"]
    return [(left + f + right, len(left), len(left) + len(f)) for f in forms]


@dataclass
class BoostedTrees:
    """Gradient boosting for two classes: trees of fixed depth over binned features, Newton steps on the log loss."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)   # feature, bin, leaf values
    bias: float = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(x) else np.empty((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b, w = self._binned(x), np.full(len(y), UNIT)
        return self.grow(float(y.sum()), float(len(y)), lambda level: self.sums(level, b, y, w))

    def grow(self, good: float, number: float, sums: Callable[[int], np.ndarray]) -> BoostedTrees:
        """Adds the trees, one level after the other, each from the sums of all examples by node, feature and bin."""
        self.bias = float(np.log((good + 1) / (number - good + 1)))
        for _ in range(TREES):
            feature, cut, value = np.zeros(2 ** DEPTH - 1, int), np.full(2 ** DEPTH - 1, BINS), np.zeros(2 ** DEPTH)
            self.trees.append((feature, cut, value))
            for level in range(DEPTH):
                for i, (g, h) in enumerate(np.moveaxis(sums(level) / (UNIT * STEPS), 0, 1)):
                    k = 2 ** level - 1 + i
                    feature[k], cut[k] = self._split(g, h)
                    if level == DEPTH - 1:
                        left = np.arange(BINS) <= cut[k]
                        for side, own in enumerate((left, ~left)):
                            value[2 * i + side] = -RATE * g[feature[k], own].sum() / (h[feature[k], own].sum() + 1.0)
        return self

    def sums(self, level: int, b: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """First and second derivatives of the loss, summed by node of a level of the tree that grows, feature and bin.

        In whole steps, so that the sums are the same in whatever order they are added.
        """
        n, columns = 2 ** level, len(self.edges)
        p = 1 / (1 + np.exp(-self._score(b, self.trees[:-1])))
        node = self._walk(b, self.trees[-1], level) - (n - 1)
        at = ((node[:, None] * columns + np.arange(columns)) * BINS + b).ravel()
        return np.stack([np.bincount(at, np.repeat(np.rint(d * STEPS) * w, columns), n * columns * BINS).reshape(n, columns, BINS) for d in (p - y, p * (1 - p))])

    @staticmethod
    def _walk(b: np.ndarray, tree: tuple, levels: int) -> np.ndarray:
        node, rows = np.zeros(len(b), int), np.arange(len(b))
        for _ in range(levels):
            node = 2 * node + 1 + (b[rows, tree[0][node]] > tree[1][node])
        return node

    def _score(self, b: np.ndarray, trees: list) -> np.ndarray:
        score = np.full(len(b), self.bias)
        for tree in trees:
            score += tree[2][self._walk(b, tree, DEPTH) - (2 ** DEPTH - 1)]
        return score

    @staticmethod
    def _split(g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        """The feature and bin that divide a node best; the last bin, where nothing is gained."""
        gl, hl = g.cumsum(1), h.cumsum(1)
        whole, weight = gl[:, -1:], hl[:, -1:] + 1.0
        gain = (gl ** 2 / (hl + 1.0) + (whole - gl) ** 2 / (weight - hl) - whole ** 2 / weight)[:, :-1]
        j, cut = np.unravel_index(int(gain.argmax()), gain.shape)
        return (int(j), int(cut)) if gain[j, cut] > 1e-6 else (0, BINS)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self._score(self._binned(x), self.trees)))


@dataclass
class PiiModel:
    trees: BoostedTrees | None = None
    thresholds: tuple[float, ...] = (2.0,) * len(KINDS)      # above 1: the kind adds nothing

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and the candidates accepted beside them; no accepted span overlaps a base or a better one."""
        base = base_spans(text)
        found = candidates(text) if self.trees is not None and min(self.thresholds) <= 1 else []
        free = _beside(found, base)
        if not free:
            return base, []
        p = self.trees.probability(np.array([features(text, *c) for c in free]))
        out: list[tuple[int, int, int]] = []
        # of equals the longer, or a number's first groups would stand for all of it
        for q, c in sorted(zip(p.tolist(), free), key=lambda x: (-x[0], x[1][0] - x[1][2], x[1])):
            k = bisect_left(out, (c[2],))
            if q >= self.thresholds[c[1]] and (k == 0 or out[k - 1][2] <= c[0]):     # out is disjoint and in order
                out.insert(k, c)
        return base, out


def _beside(found: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The proposals that overlap no base span (these in order of their starts)."""
    starts, reach = [a for a, _, _ in base], list(accumulate((e for _, _, e in base), max))
    return [c for c in found if (k := bisect_left(starts, c[2])) == 0 or reach[k - 1] <= c[0]]


def _examples(text: str) -> Iterator[tuple[bool, int, list[float]]]:
    """Labelled examples of one text: base matches and disguises of them against decoys and failing look-alikes."""
    base = base_spans(text)
    for a, kind, e in base:
        yield True, kind, features(text, a, kind, e)
        for t, x, y in disguises(text, a, kind, e):
            yield True, kind, features(t, x, kind, y)
            if kind in (2, 3):
                # alone and beside a copy: parts of a number, or of two, are no number
                pair, (v, w) = f"{t[:y]} {t[x:]}", (y + 1, 2 * y + 1 - x)
                yield True, kind, features(pair, x, kind, y)
                yield True, kind, features(pair, v, kind, w)
                for t, last, numbers in ((t, y, {(x, y)}), (pair, w, {(x, y), (v, w)})):
                    for b, k, f in candidates(t):
                        if k == kind and b < last and f > x and (b, f) not in numbers:
                            yield False, kind, features(t, b, kind, f)
        for t, x, y in decoys(text, a, kind, e):
            yield False, kind, features(t, x, kind, y)
    for a, kind, e in _beside(candidates(text), base):
        if kind == 2 and not luhn(_digits(text[a:e])) or kind == 1:
            yield False, kind, features(text, a, kind, e)


def _share(text: str, most: int, cut: bool) -> list[tuple[bool, int, list[float], int]]:
    """The different examples of one text with their weights, which come to ``most`` per kind and label at most.

    With ``cut`` only so many of them are taken, by hash.
    """
    found: dict[tuple[int, bool], dict[bytes, list[float]]] = {}
    for good, kind, x in _examples(text):
        found.setdefault((kind, good), {})[np.array(x).tobytes()] = x
    if cut:
        found = {k: {h: own[h] for h in sorted(own, key=lambda h: (zlib.crc32(h), h))[:most]} for k, own in found.items()}
    return [(good, kind, x, max(1, round(UNIT * min(1.0, most / len(own))))) for (kind, good), own in found.items() for x in own.values()]


def train(docs: DataFrame, text: str = "text", sample_spans: int | None = None, precision: float = WANTED_PRECISION,
          text_spans: int = TEXT_SPANS) -> PiiModel:
    """Fits the trees on the examples of all texts but a fifth, and calibrates thresholds on those of that fifth.

    Copies of a text count once, and the examples of a text weigh as much as ``text_spans`` per kind and label at most, so
    no text outweighs the others. Equal examples become one row with a weight; every level of a tree is one pass over these rows in
    Spark that brings back sums by node, feature and bin. Sums are in whole numbers, so the model doesn't depend on how the
    table is stored. ``sample_spans`` bounds the examples for callers that want a quick model. With no base match anywhere the model adds nothing.
    """
    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            got = []
            for t, draw in zip(batch.column("text").to_pylist(), batch.column("draw").to_pylist()):
                if draw not in seen:
                    seen.add(draw)
                    got += [(draw, *e) for e in _share(t, text_spans, sample_spans is not None)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (
                    pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.float64()), pa.int64()))], names=["draw", "good", "kind", "x", "w"])
    own = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("draw")).where(F.col("text").rlike("[0-9@]"))
    rows = own.mapInArrow(examples, "draw long, good boolean, kind int, x array<double>, w long").dropDuplicates(["draw", "kind", "good", "x"])
    if sample_spans is not None:
        rows = rows.orderBy("draw", "kind", "good", "x").limit(sample_spans)
    space = Workspace(docs.sparkSession, "pii")
    aside = (F.pmod(F.shiftright("draw", 20), F.lit(5)) == 0).alias("aside")       # by document, so context is not shared
    groups = space.cut(rows.groupBy("kind", "good", aside, "x").agg(F.sum("w").alias("w")))
    learnt = groups.where("not aside")
    good, number = learnt.agg(F.sum(F.when(F.col("good"), F.col("w"))), F.sum("w")).first()
    if not good or good == number:
        space.drop(groups)
        return PiiModel()
    model = BoostedTrees(_quantiles(learnt))
    binned = space.cut(_binned_rows(groups, model))
    space.drop(groups)
    passes = lambda d: d.coalesce(max(1, -(-binned.count() // ROWS_PER_PASS)))
    learnt, held = passes(binned.where("not aside")), passes(binned.where("aside"))
    model.grow(good / UNIT, number / UNIT, lambda level: _all_sums(learnt, model, level))
    thresholds = _calibrated(held, model, precision)
    space.drop(binned)
    return PiiModel(model, thresholds)


def _quantiles(rows: DataFrame) -> list[np.ndarray]:
    """Per feature the values at which the weight of all examples reaches one more of ``BINS`` equal parts."""
    values = rows.select(F.posexplode("x").alias("j", "v"), "w").groupBy("j", "v").agg(F.sum("w").alias("w"))
    upto = F.sum("w").over(Window.partitionBy("j").orderBy("v"))
    share = values.select("j", "v", "w", upto.alias("c"), F.sum("w").over(Window.partitionBy("j")).alias("t"))
    cuts = share.where(f"least({BINS - 1}, {BINS} * c div t) > {BINS} * (c - w) div t").select("j", "v").collect()      # BINS - 1 a feature at most
    return [np.array(sorted(r.v for r in cuts if r.j == j)) for j in range(1 + max(r.j for r in cuts))]


def _binned_rows(groups: DataFrame, model: BoostedTrees) -> DataFrame:
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        b = model._binned(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)).astype(np.uint8)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "good", "aside", "w")), pa.array([r.tobytes() for r in b], pa.binary())],
                                          names=["kind", "good", "aside", "w", "b"])
    return map_batches(groups, one, "kind int, good boolean, aside boolean, w long, b binary").groupBy("kind", "good", "aside", "b").agg(F.sum("w").alias("w"))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(b"".join(batch.column("b").to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(int)
    return b, batch.column("good").to_numpy(zero_copy_only=False).astype(float), batch.column("w").to_numpy()


def _all_sums(rows: DataFrame, model: BoostedTrees, level: int) -> np.ndarray:
    """The sums of all rows: each task adds up its own, so one small table per task comes back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((model.sums(level, *_matrix(batch)) for batch in batches if batch.num_rows), np.zeros(()))
        if total.ndim:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])
    parts = [np.frombuffer(r.s) for r in rows.select("b", "good", "w").mapInArrow(run, "s binary").collect()]
    return np.sum(parts, axis=0).reshape(2, 2 ** level, len(model.edges), BINS)


def _calibrated(rows: DataFrame, model: BoostedTrees, precision: float) -> tuple[float, ...]:
    """Per kind the lowest threshold, in ``STEPS`` steps, at which the examples above it reach the precision."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        b, y, w = _matrix(batch)
        q = np.floor(STEPS / (1 + np.exp(-model._score(b, model.trees)))).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(q), pa.array(w), pa.array((w * y).astype(np.int64))], names=["kind", "q", "w", "good"])
    got = map_batches(rows, one, "kind int, q long, w long, good long").groupBy("kind", "q").agg(F.sum("w").alias("w"), F.sum("good").alias("good")).collect()
    thresholds = []
    for k in range(len(KINDS)):                  # of a kind one row per step at most
        own = np.array(sorted(((r.q, r.w, r.good) for r in got if r.kind == k), reverse=True), np.int64).reshape(-1, 3)
        number, right = own[:, 1].cumsum(), own[:, 2].cumsum()
        fine = np.flatnonzero((right >= precision * number) & (number >= LEAST_CALIBRATION * UNIT))
        thresholds.append(float(max(0.5, own[fine[-1], 0] / STEPS)) if len(fine) else 2.0)
    return tuple(thresholds)


def find(docs: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """All columns and ``pii array<struct<kind, start, end, base>>``: spans in code points, end exclusive, by start and kind.

    Null and empty texts have none. A column named ``pii`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)     # bounded by TREES and DEPTH

    def one(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out = []
        for t in batch.column(text).to_pylist():
            base, more = shared.value.spans(t) if t else ([], [])
            out.append([{"kind": KINDS[k], "start": a, "end": e, "base": b}
                        for a, k, e, b in sorted([(*s, True) for s in base] + [(*s, False) for s in more])])
        return {"pii": pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])))}
    return append(docs, one, "pii array<struct<kind: string, start: long, end: long, base: boolean>>")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, a checksum of them, and all spans as text, from the output of :func:`find`."""
    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["base"])
    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col(key).alias("doc_id"), *map(count, KINDS), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
                        written(F.col("pii")).alias("spans"))


def redact(docs: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """All columns with each span of ``text`` replaced by its kind in angle brackets; overlapping spans become one.

    Null and empty texts stay as they are; every row is worked on by itself, so repeated rows give repeated results and an empty table
    gives no rows. Other columns stay, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)     # bounded by TREES and DEPTH

    def clean(t: str | None) -> str | None:
        base, more = shared.value.spans(t) if t else ([], [])
        if not base and not more:
            return t
        out, at = [], 0
        for a, k, e in sorted(base + more):
            if a >= at:
                out += [t[at:a], f"<{KINDS[k]}>"]
            at = max(at, e)
        return "".join([*out, t[at:]])

    old, = fresh(docs, text)

    def one(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {text: pa.array([clean(t) for t in batch.column(old).to_pylist()], pa.string())}
    return append(docs.withColumnRenamed(text, old), one, f"`{text}` string").select(*docs.columns)
