"""Secrets: base patterns, and a character convolutional network over every other candidate.

One pass over the texts finds the base matches and all candidates: tokens of 6 or more characters of ``A-Za-z0-9+/_.=-``, the base
patterns' own alphabet and least length, that are not made of words alone; of a token that a base match covers in part, what is left
counts. Words are up to 20 letters, small, large or with a large first letter, and numbers of up to 5 digits, joined by
``-./_=+``. Each candidate is seen through windows that cover all of it and its surroundings. The network (NumPy: one-hot convolution, maximum
over positions, logistic output) is trained on labelled findings: values of base matches against candidates that no rule
knows, with the words around hidden in half of the examples, so that it must also learn what a secret itself looks like. As an
unknown secret is labelled no secret, two networks are trained on halves of the findings, and each scores the
findings of the other half, calibrated on a part it was not trained on. Histograms of these scores over all findings of the table give
each shape of token its threshold: the highest that keeps the wanted recall of base matches. Candidates at or above it become spans of kind ``model``.

Bounds, both parameters: ``max_examples`` findings of each label train the network (smallest hash first, so the choice does not
depend on partitions). Every candidate of every text is scored, and the thresholds rest on all findings.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.llm.common import arrow_schema, id_and_text, per_text, sha256_hex
from profilekit.session import materialise

# Fixed patterns of the base spans, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ with 24 or more
KINDS = ("assign", "access", "hex", "model")

_ALPHABET = r"[A-Za-z0-9+/_.=-]"
_WORD = r"(?>[A-Z]?[a-z]{1,20}+|[A-Z]{1,20}+|[0-9]{1,5}+)"
_PLAIN = rf"[-./_=+]*+(?:{_WORD}(?:[-./_=+]++{_WORD})*+)?+[-./_=+]*+"
_TOKEN = re.compile(rf"(?<!{_ALPHABET})(?!{_PLAIN}(?!{_ALPHABET})){_ALPHABET}{{6,}}+")
_WORDS_ONLY = re.compile(_PLAIN)
_BEFORE, _INSIDE, _AFTER = 24, 48, 16
_WINDOW = _BEFORE + _INSIDE + _AFTER
_HIDDEN = "\x00"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, sorted; leftmost and non-overlapping per kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def windows(text: str, start: int, end: int) -> Iterator[str]:
    """Windows over text[start:end] and its surroundings; together they cover every character of it.

    A window is 24 characters before, 48 of the token and 16 after; places outside the text and of the
    token beyond its end are the hidden character.
    """
    for at in range(start, end, _INSIDE):
        stop = min(end, at + _INSIDE)
        before = text[max(0, at - _BEFORE):at].rjust(_BEFORE, _HIDDEN)
        yield before + text[at:stop].ljust(_INSIDE, _HIDDEN) + text[stop:stop + _AFTER].ljust(_AFTER, _HIDDEN)


def shape(token: str) -> int:
    """0: digits and signs only, 1: digits with letters of one case, 2: of both cases."""
    return int(token != token.upper()) + int(token != token.lower())


# --- the network ----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class NetworkParams:
    width: int = 5
    filters: int = 24
    epochs: int = 12
    batch: int = 64
    rate: float = 0.01
    recall: float = 0.98
    max_examples: int = 4_096
    seed: int = 5


#: Codes of a window: printable ASCII, one code for all other characters, one for hidden; token places have codes of their own.
_CODES = 97


def encode(texts: list[str]) -> np.ndarray:
    """Window texts as codes, one row each."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), _WINDOW)
    codes = np.where((flat >= 32) & (flat < 127), flat - 32, np.where(flat == 0, 96, 95)).astype(np.int64)
    codes[:, _BEFORE:_BEFORE + _INSIDE] += _CODES
    return codes


def _hidden(codes: np.ndarray) -> np.ndarray:
    """Windows without their surroundings."""
    codes = codes.copy()
    codes[:, :_BEFORE] = codes[:, _BEFORE + _INSIDE:] = 96
    return codes


@dataclass
class Network:
    """``kernel[k, code, filter]`` is added up over the width, then ReLU, maximum over places, and a logistic unit."""

    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = codes.shape[1] - self.kernel.shape[0] + 1
        total = np.zeros((len(codes), places, self.kernel.shape[2]), np.float32)
        for k in range(self.kernel.shape[0]):
            total += self.kernel[k][codes[:, k:k + places]]
        best = total.argmax(axis=1)
        return np.take_along_axis(total, best[:, None, :], 1)[:, 0] + self.bias, best

    def margin(self, codes: np.ndarray) -> np.ndarray:
        """The larger of what a window says with its surroundings and without them."""
        parts = [np.maximum(*(np.maximum(self.pooled(view)[0], 0) @ self.out for view in (codes[i:i + 512], _hidden(codes[i:i + 512]))))
                 for i in range(0, len(codes), 512)]
        return np.concatenate(parts) + self.out_bias if parts else np.empty(0)

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated probability of each window."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(codes) + self.shift, -60, 60)))


def train(texts: list[str], labels: np.ndarray, params: NetworkParams = NetworkParams()) -> Network | None:
    """Fit and calibrate; None without examples of both labels.

    Every fifth example is for calibration. Adam on the logistic loss, both labels weighted alike.
    """
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        return None
    random = np.random.default_rng(params.seed)
    codes = encode(texts)
    order = random.permutation(len(labels))
    held, used = order[::5], order[np.arange(len(order)) % 5 != 0]
    if labels[used].min() == labels[used].max() or not labels[held].any():
        held = used = order
    net = Network(
        random.normal(0, 0.1, (params.width, 2 * _CODES, params.filters)).astype(np.float32),
        np.zeros(params.filters, np.float32), random.normal(0, 0.3, params.filters).astype(np.float32))
    weights = [net.kernel, net.bias, net.out, np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    balance = np.where(labels == 1, 0.5 / labels[used].mean(), 0.5 / (1 - labels[used].mean()))
    step = 0
    for _ in range(params.epochs):
        mixed = random.permutation(used)
        for start in range(0, len(mixed), params.batch):
            rows = mixed[start:start + params.batch]
            seen = codes[rows]
            hide = random.random(len(rows)) < 0.5
            seen[hide] = _hidden(seen[hide])
            value, best = net.pooled(seen)
            active = np.maximum(value, 0)
            margin = active @ net.out + weights[3][0]
            error = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - labels[rows]) * balance[rows] / len(rows)
            back = (error[:, None] * net.out[None, :] * (value > 0)).astype(np.float32)
            slope = np.zeros_like(net.kernel)
            filters = np.arange(params.filters)[None, :]
            for k in range(params.width):
                np.add.at(slope[k], (np.take_along_axis(seen, best + k, 1), filters), back)
            step += 1
            for i, grad in enumerate((slope, back.sum(0), active.T @ error, np.array([error.sum()]))):
                first[i] += 0.1 * (grad - first[i])
                second[i] += 0.001 * (grad ** 2 - second[i])
                weights[i] -= (params.rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)).astype(weights[i].dtype)
    net.out_bias = float(weights[3][0])
    _calibrate(net, codes[held], labels[held])
    return net


def _calibrate(net: Network, codes: np.ndarray, labels: np.ndarray) -> None:
    """Logistic calibration by gradient descent."""
    margin = net.margin(codes)
    unit = margin / (np.abs(margin).max() or 1.0)
    slope, shift = 1.0, 0.0
    # Targets kept off 0 and 1, as Platt does, so separable data have a finite answer.
    target = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    for _ in range(2_000):
        error = 1 / (1 + np.exp(-np.clip(slope * unit + shift, -60, 60))) - target
        slope -= 2.0 * (error * unit).mean()
        shift -= 2.0 * error.mean()
    net.slope, net.shift = slope / (np.abs(margin).max() or 1.0), shift


#: Scores are counted in so many bins.
BINS = 1_000


def thresholds(counts: Iterable[tuple[int, int, int, int]], recall: float) -> tuple[float, ...]:
    """Per shape the highest score that keeps ``recall`` of its base matches; shapes without any take that of all together.

    ``counts`` are (label, shape, bin, findings) over the whole table.
    """
    table = np.zeros((4, BINS + 1), np.int64)
    for label, kind, place, n in counts:
        if label:
            table[[kind, 3], place] += n
    chosen = []
    for row in table:
        above = np.cumsum(row[::-1])[::-1]
        enough = np.flatnonzero(above >= recall * row.sum())
        chosen.append(enough[-1] / BINS if row.sum() else np.nan)
    return tuple(float(chosen[3] if np.isnan(t) else t) for t in chosen[:3])


# --- over tables ----------------------------------------------------------------------------------------

_FOUND = (
    "doc_id long, base string, n_assign long, n_access long, n_hex long, starts array<int>, ends array<int>, labels array<int>, "
    "seen array<string>, windows_of array<int>, firsts array<string>"
)


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of all candidates, in order; ``base`` are the text's base spans."""
    known, at, reach = sorted((s, e) for s, _, e in base), 0, 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while at < len(known) and known[at][1] <= start:
            at += 1
        pieces, left = [], start
        for s, e in known[at:]:
            if s >= end:
                break
            pieces.append((left, s))
            left = max(left, e)
        pieces.append((left, end))
        if len(pieces) == 1:
            yield start, end
        else:
            yield from ((s, e) for s, e in pieces if e - s >= 6 and _WORDS_ONLY.match(text, s, e).end() < e)


def findings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: base spans and, for each candidate or base match, its place, label (1: base match), windows and first window."""

    def make():
        def work(doc_ids, texts):
            out = {f.name: [] for f in arrow_schema(_FOUND)}
            out["doc_id"] = doc_ids
            for text in texts:
                base = base_spans(text)
                out["base"].append(joined(base))
                for kind, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(1 for s in base if s[1] == kind))
                places = []
                for s, k, e in base:
                    value = s + len(ASSIGN.match(text, s)[0]) - len(ASSIGN.match(text, s)[2]) if k == 0 else s
                    places.append((value, e, 1))
                places += [(s, e, 0) for s, e in candidates(text, base)]
                seen, counts, firsts = [], [], []
                for s, e, _ in places:
                    own = list(windows(text, s, e))
                    seen += own
                    counts.append(len(own))
                    firsts.append(own[0])
                out["starts"].append([p[0] for p in places])
                out["ends"].append([p[1] for p in places])
                out["labels"].append([p[2] for p in places])
                out["seen"].append(seen)
                out["windows_of"].append(counts)
                out["firsts"].append(firsts)
            return out

        return work

    return per_text(id_and_text(df, id_col, text_col), make, _FOUND)


def _half(window: str) -> int:
    return zlib.crc32(window.encode()) & 1


def _shape_of(window: str) -> int:
    return shape(window[_BEFORE:_BEFORE + _INSIDE].rstrip(_HIDDEN))


def _examples(found: DataFrame, params: NetworkParams) -> tuple[list[str], np.ndarray]:
    """First windows of at most ``max_examples`` findings of each label, the same whatever the partitions."""
    rows = found.select(F.explode(F.arrays_zip("labels", "firsts")).alias("x")).select(F.col("x.labels").alias("label"), F.col("x.firsts").alias("window")).distinct()
    picked = None
    for label in (0, 1):
        part = rows.where(F.col("label") == label).orderBy(F.xxhash64("window"), "window").limit(params.max_examples)
        picked = part if picked is None else picked.unionByName(part)
    table = picked.toArrow()
    return table["window"].to_pylist(), table["label"].to_numpy().astype(np.float64)


_SCORED = "doc_id long, base string, n_assign long, n_access long, n_hex long, starts array<int>, ends array<int>, labels array<int>, shapes array<int>, scores array<double>"


def scored(found: DataFrame, nets: list[Network] | None) -> DataFrame:
    """``found`` with shape and score of every finding: the largest of its windows', by the network that was not trained on it."""
    shared = found.sparkSession.sparkContext.broadcast(nets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, schema = shared.value, arrow_schema(_SCORED)
        kept = ("doc_id", "base", "n_assign", "n_access", "n_hex", "starts", "ends", "labels")
        for batch in batches:
            shapes, scores = [], []
            for firsts, seen, counts in zip(*(batch.column(n).to_pylist() for n in ("firsts", "seen", "windows_of"))):
                shapes.append([_shape_of(w) for w in firsts])
                if not firsts or not fitted:
                    scores.append([0.0] * len(firsts))
                    continue
                half = np.array([_half(w) for w in firsts])
                of_window = np.repeat(half, counts)
                values = np.empty(len(seen))
                codes = encode(seen)
                for k, net in enumerate(fitted):
                    if (of_window == k).any():
                        values[of_window == k] = net.score(codes[of_window == k])
                scores.append(np.maximum.reduceat(values, np.cumsum([0, *counts[:-1]])).tolist())
            yield pa.RecordBatch.from_pydict({**{n: batch.column(n) for n in kept}, "shapes": shapes, "scores": scores}, schema=schema)

    return found.mapInArrow(run, _SCORED)


def scan(df: DataFrame, params: NetworkParams = NetworkParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Defined cases: null is the empty text, without spans; a null id stays null; repeated rows get equal results; without base matches or
    without other candidates there is nothing to learn from and only base spans are returned; other columns are
    ignored; an empty table gives an empty table; texts of any length are scanned whole.
    """
    found = materialise(findings(df, id_col, text_col))
    texts, labels = _examples(found, params)
    half = np.array([_half(t) for t in texts], np.int64)
    nets = [train([t for t, h in zip(texts, half) if h != k], labels[half != k], params) for k in (0, 1)]
    if None in nets:
        nets = [train(texts, labels, params)] * 2
    nets = None if None in nets else nets
    rows = materialise(scored(found, nets))
    bins = rows.select(F.explode(F.arrays_zip("labels", "shapes", "scores")).alias("x")).groupBy(
        F.col("x.labels").alias("label"), F.col("x.shapes").alias("shape"), F.floor(F.col("x.scores") * BINS).alias("bin")).count()
    least = thresholds([tuple(r) for r in bins.collect()], params.recall) if nets else None
    ddl = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in batches:
            spans, digests = [], []
            for base, *lists in zip(*(batch.column(n).to_pylist() for n in ("base", "starts", "ends", "labels", "shapes", "scores"))):
                extra = [(s, 3, e) for s, e, label, kind, score in zip(*lists) if least and not label and score >= least[kind]]
                known = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
                spans.append(joined(known + extra))
                digests.append(sha256_hex(base.encode()))
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in ("doc_id", "n_assign", "n_access", "n_hex")} | {"base_sha256": digests, "spans": spans}, schema=schema)

    return rows.mapInArrow(run, ddl)
