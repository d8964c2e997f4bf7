"""Secret scan: rules give base findings; a character convolutional network judges every other run of six characters and more in its context.

The network is trained here, in numpy, on labelled findings (value with the text around it). Its scores are calibrated
on findings held out of the fit, and the threshold is the highest that keeps the recall asked for.
"""
from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.spark_support import stored
from .textkit import give_back

#: The base rules. Letters of names in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "model")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Runs of these characters, so long, can be a finding of the rules; those with a letter and a digit are drawn apart for a fit.
_RUN_CHARACTERS = string.ascii_letters + string.digits + "+/_=-"
_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in _RUN_CHARACTERS]] = True
_DIGIT, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = True
LEAST_RUN = 12
#: Candidates are runs of so many characters without blanks, those between marks that join values, and those of the characters above.
LEAST_CANDIDATE = 6
JOINS = "/:@="

#: Shape of the network: characters seen left of, in and right of a candidate (from its two ends), sizes of its layers.
LEFT, VALUE, RIGHT = 24, 40, 8
WIDTH, EMBEDDED, FILTERS = 5, 8, 24
_ALPHABET = {c: i + 2 for i, c in enumerate(string.ascii_letters + string.digits + string.punctuation + " \n")}
SYMBOLS = len(_ALPHABET) + 2  # 0 beyond the text, 1 any other character
_SYMBOL = np.ones(128, np.uint8)
for _c, _i in _ALPHABET.items():
    _SYMBOL[ord(_c)] = _i
#: A value longer than the network sees is shown by its two ends and in windows that begin so far apart.
STRIDE = VALUE // 2
#: Characters of texts that are scored together, and of a block whose responses are held at once.
BATCH_CHARACTERS, BLOCK = 4_000_000, 16_384

#: Findings of either label that a fit takes at most.
FIT_FINDINGS = 3_000
#: Texts that the findings of a fit come from.
FIT_TEXTS = 20_000
RECALL = 0.995


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the rules, by start and kind; each kind leftmost and without overlaps."""
    found = []
    lowered = text.lower()
    if any(name in lowered for name in NAMES):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found)


def _has_run(texts: list[str]) -> np.ndarray:
    """Whether a text can hold a hex finding or a candidate, for whole batches at once."""
    parts = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    run = _RUN[raw]
    edge = np.flatnonzero(run[1:] != run[:-1]) + 1
    if run[0]:
        edge = np.append(0, edge)
    start, end = edge[::2], edge[1::2]
    long_run = end - start >= LEAST_RUN
    start, end = start[long_run], end[long_run]
    digits = np.append(0, np.cumsum(_DIGIT[raw], dtype=np.int64))
    start = start[(digits[end] > digits[start]) | (end - start >= min(LEAST["access"], LEAST["hex"]))]
    ends = np.cumsum([len(p) for p in parts])
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(ends, start, side="right")] = True
    return out


_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


class Characters:
    """Texts as symbols in one array, LEFT zeros before and after each; the candidates between their base spans."""

    def __init__(self, texts: list[str], base: list[list[tuple[int, int, int]]]):
        gap = "\n" * LEFT
        points = np.frombuffer((gap + gap.join([*texts, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = LEFT + np.cumsum(np.append(0, sizes[:-1] + LEFT))
        ascii_only = np.minimum(points, 127)
        self.symbols = np.where(points < 128, _SYMBOL[ascii_only], 1).astype(np.uint8)
        blank = np.isin(ascii_only, _SPACES[_SPACES < 127])
        wide = np.flatnonzero(points > 127)
        blank[wide[np.isin(points[wide], _SPACES)]] = True
        self.symbols[:LEFT] = 0
        for at, size, spans in zip(self.starts, sizes, base, strict=True):
            self.symbols[at + size:at + size + LEFT] = 0
            for a, b, _ in spans:
                blank[at + a:at + b] = True
        joins = np.isin(ascii_only, [ord(c) for c in JOINS])
        run = _RUN[ascii_only] & (points < 128) & ~blank
        found = [_runs(~blank), _runs(~blank & ~joins), _runs(run)]
        start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        whole = end - start >= LEAST_CANDIDATE
        key = np.unique(start[whole] << 32 | end[whole])
        self.start, self.end = key >> 32, key & 0xFFFFFFFF
        self.owner = np.searchsorted(self.starts, self.start, side="right") - 1
        count = lambda kind: np.append(0, np.cumsum(kind[ascii_only] & (points < 128), dtype=np.int64))
        digits, letters, runs = count(_DIGIT), count(_LETTER), np.append(0, np.cumsum(run, dtype=np.int64))
        held = lambda c: c[self.end] - c[self.start]
        mark = np.zeros(128, bool)
        mark[[ord(c) for c in string.punctuation]] = True
        #: Those with a mark.
        self.marked = held(count(mark)) > 0
        #: Runs long enough that hold a letter and a digit.
        self.coded = (held(digits) > 0) & (held(letters) > 0) & (held(runs) == self.end - self.start) & (self.end - self.start >= LEAST_RUN)

    def windows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Views of chosen candidates as codes, and the row that each belongs to: both ends, and windows over long values."""
        s, e = self.start[rows], self.end[rows]
        long = np.flatnonzero(e - s > VALUE)
        count = -(-(e[long] - s[long] - VALUE) // STRIDE) + 1
        of = np.repeat(long, count)
        at = np.minimum(s[of] + STRIDE * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)), e[of] - VALUE)
        a, b = np.append(s, at), np.append(e, at + VALUE)
        j = np.arange(VALUE)
        size = (b - a)[:, None]
        place = np.where((size > VALUE) & (j >= VALUE // 2), b[:, None] - VALUE + j, a[:, None] + j)
        value = np.where(j < size, self.symbols[np.minimum(place, len(self.symbols) - 1)], 0)
        codes = np.concatenate((self.symbols[a[:, None] + np.arange(-LEFT, 0)], value, self.symbols[b[:, None] + np.arange(RIGHT)]), 1)
        return codes.astype(np.int64), np.append(np.arange(len(rows)), of)


def _runs(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(held[1:] != held[:-1]) + 1
    return edge[::2].astype(np.int64), edge[1::2].astype(np.int64)


def candidates(text: str) -> list[tuple[int, int]]:
    """All runs of LEAST_CANDIDATE characters and more: without blanks, without JOINS, and of the characters of a code."""
    seen = Characters([text], [[]])
    return [(int(a) - LEFT, int(b) - LEFT) for a, b in zip(seen.start, seen.end, strict=True)]


def _views(text: str, start: int, end: int) -> list[np.ndarray]:
    """What the network sees of a value: both ends, and overlapping windows over a long one."""
    places = [*range(start, end - VALUE, STRIDE), end - VALUE] if end - start > VALUE else []
    return [_codes(text, start, end), *[_codes(text, a, a + VALUE) for a in places]]


def _codes(text: str, start: int, end: int) -> np.ndarray:
    """The characters around and in a candidate; of a long value its beginning and its end."""
    left, right = text[max(0, start - LEFT):start], text[end:end + RIGHT]
    value = text[start:end] if end - start <= VALUE else text[start:start + VALUE // 2] + text[end - VALUE // 2:end]
    out = np.zeros(LEFT + VALUE + RIGHT, np.int64)
    get = _ALPHABET.get
    out[LEFT - len(left):LEFT] = [get(c, 1) for c in left]
    out[LEFT:LEFT + len(value)] = [get(c, 1) for c in value]
    out[LEFT + VALUE:LEFT + VALUE + len(right)] = [get(c, 1) for c in right]
    return out


@dataclass(frozen=True)
class SecretModel:
    """Parameters of the network, its calibration (slope, offset) and its threshold; recall and precision of the threshold on held-out findings."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    slope: float
    offset: float
    threshold: float
    recall: float = float("nan")
    precision: float = float("nan")

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return _forward(self.embedding, self.filters, self.bias, self.dense, codes)[0]

    def probability(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated chance of a secret, in blocks of bounded size."""
        parts = [self.logits(codes[i:i + 2000]) for i in range(0, len(codes), 2000)]
        return _chance(np.concatenate(parts), self.slope, self.offset) if parts else np.empty(0)


    def chances(self, seen: Characters) -> np.ndarray:
        """Calibrated chance of every candidate, of a long one the largest of its views.

        A response belongs to a place of the text, so it is found once for all candidates around it.
        """
        logits = np.full(len(seen.start), -np.inf)
        size = seen.end - seen.start
        short, rest = np.flatnonzero(size <= VALUE - WIDTH + 1), np.flatnonzero(size > VALUE - WIDTH + 1)
        for i in range(0, len(rest), 1000):
            codes, of = seen.windows(rest[i:i + 1000])
            for k in range(0, len(codes), 2000):
                np.maximum.at(logits, rest[i + of[k:k + 2000]], self.logits(codes[k:k + 2000]))
        tables = [(self.embedding @ self.filters[k * EMBEDDED:(k + 1) * EMBEDDED]).astype(np.float32) for k in range(WIDTH)]
        bias = self.bias.astype(np.float32)
        pairs = [(a[:, None] + b).reshape(-1, FILTERS) for a, b in ((tables[0], tables[1]), (tables[2], tables[3]))]
        zero = np.array([t[0] for t in tables])
        beyond = np.maximum(zero.sum(0) + bias, 0)
        dense = self.dense.astype(np.float32)
        symbols = np.append(seen.symbols, np.zeros(2 * VALUE, np.uint8)).astype(np.int64)
        double = symbols[:-1] * SYMBOLS + symbols[1:]
        cuts = np.searchsorted(seen.start[short], np.arange(0, len(seen.symbols) + BLOCK, BLOCK))
        for block, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if i == j:
                continue
            rows = short[i:j]
            low, high = max(0, block * BLOCK - LEFT), min((block + 1) * BLOCK + VALUE + RIGHT, len(symbols) - WIDTH)
            response = pairs[0][double[low:high]]
            response += pairs[1][double[low + 2:high + 2]]
            response += tables[4][symbols[low + 4:high + 4]]
            response += bias
            np.maximum(response, 0, out=response)
            largest = {1: response}  # of so many responses from a place on
            for width in (1, 2, 4, 8, 16):
                before = largest[width]
                largest[2 * width] = np.maximum(before[:-width], before[width:])
            total = np.concatenate((np.zeros((1, FILTERS)), np.cumsum(response, 0, dtype=np.float64)))
            s, e, n = seen.start[rows] - low, seen.end[rows] - low, size[rows]
            left = np.maximum(largest[16][s - LEFT], largest[8][s - 8])
            top, mean = largest[4][e], total[e + 4] - total[e] + total[e - 4] - total[s - 4]
            for width in (4, 8, 16, 32):
                of = np.flatnonzero((n >= width) & (n < 2 * width))
                top[of] = np.maximum(top[of], np.maximum(largest[width][s[of] - 4], largest[width][e[of] - 4 - width]))
            for m in range(1, WIDTH):
                for first, at in ((0, e - m), (WIDTH - m, e)):  # the last m characters of a value, the first m after it
                    edge = bias + (zero[m:].sum(0) if first == 0 else zero[:first].sum(0))
                    edge = edge + sum(tables[first + k][symbols[low + at + k]] for k in range(m))
                    np.maximum(edge, 0, out=edge)
                    np.maximum(top, edge, out=top)
                    mean += edge
            zeros = VALUE - WIDTH + 1 - n
            top = np.where((zeros > 0)[:, None], np.maximum(top, beyond), top)
            mean = (mean + zeros[:, None] * beyond) / (_PARTS[1][1] - _PARTS[1][0])
            logits[rows] = left @ dense[:FILTERS] + top @ dense[FILTERS:2 * FILTERS] + mean @ self.dense[2 * FILTERS:-1] + self.dense[-1]
        return _chance(logits, self.slope, self.offset)


def _chance(logits: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return 1 / (1 + np.exp(-(slope * np.clip(logits, -20, 20) + offset)))


#: The largest response of a filter is taken apart for the text before a candidate and for the candidate itself.
_PARTS = ((0, LEFT), (LEFT - WIDTH + 1, LEFT + VALUE + RIGHT - WIDTH + 1))


def _forward(embedding, filters, bias, dense, codes):
    seen = embedding[codes]
    windows = np.lib.stride_tricks.sliding_window_view(seen, WIDTH, axis=1).transpose(0, 1, 3, 2)
    flat = windows.reshape(len(codes), -1, WIDTH * EMBEDDED)
    response = np.maximum(flat @ filters + bias, 0)
    places = [response[:, a:b].argmax(1) + a for a, b in _PARTS]
    pooled = np.concatenate([np.take_along_axis(response, p[:, None, :], 1)[:, 0] for p in places], 1)
    mean = response[:, _PARTS[1][0]:].mean(1)
    top = np.concatenate((pooled, mean, np.ones((len(codes), 1))), 1)
    return top @ dense, (flat, response, places, top)


def fit(findings: list[tuple[str, int, int, int]], epochs: int = 6, recall: float = RECALL) -> SecretModel:
    """Trains on (text, start, end, label 0 or 1). A fifth part is held out for calibration and for the threshold.

    The threshold is the highest at which `recall` of the held-out secrets are found, however low that is; what it costs
    is the model's precision. Without held-out secrets it is 0.5.
    """
    rng = np.random.default_rng(11)
    views = [_views(t, a, b) for t, a, b, _ in findings]
    codes, of = np.concatenate(views), np.repeat(np.arange(len(views)), [len(v) for v in views])
    labels = np.array([y for *_, y in findings], float)[of]
    held_out, train = np.split(rng.permutation(len(findings)), [len(findings) // 5])
    is_train = np.zeros(len(findings), bool)
    is_train[train] = True
    train = np.flatnonzero(is_train[of])
    params = [rng.normal(0, 0.3, (SYMBOLS, EMBEDDED)), rng.normal(0, 0.25, (WIDTH * EMBEDDED, FILTERS)), np.zeros(FILTERS),
              rng.normal(0, 0.1, 3 * FILTERS + 1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = np.where(labels == 1, 0.5 / max(labels[train].mean(), 1e-3), 0.5 / max(1 - labels[train].mean(), 1e-3))
    step = 0
    for _ in range(epochs):
        train = rng.permutation(train)
        for i in range(0, len(train), 64):
            rows = train[i:i + 64]
            logits, (flat, response, places, top) = _forward(*params, codes[rows])
            slope = (1 / (1 + np.exp(-np.clip(logits, -50, 50))) - labels[rows]) * weight[rows] / len(rows)
            d_top = slope[:, None] * params[3]
            d_response = np.zeros_like(response)
            for k, p in enumerate(places):
                old = np.take_along_axis(d_response, p[:, None, :], 1)
                np.put_along_axis(d_response, p[:, None, :], old + d_top[:, None, k * FILTERS:(k + 1) * FILTERS], 1)
            span = response.shape[1] - _PARTS[1][0]
            d_response[:, _PARTS[1][0]:] += d_top[:, None, 2 * FILTERS:3 * FILTERS] / span
            d_response *= response > 0
            d_flat = (d_response @ params[1].T).reshape(len(rows), -1, WIDTH, EMBEDDED)
            d_embedding = np.zeros_like(params[0])
            for j in range(WIDTH):
                np.add.at(d_embedding, codes[rows][:, j:j + d_flat.shape[1]], d_flat[:, :, j])
            slopes = [d_embedding, flat.reshape(-1, flat.shape[2]).T @ d_response.reshape(-1, FILTERS), d_response.sum((0, 1)), top.T @ slope]
            step += 1
            for p, g, (m, v) in zip(params, slopes, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    largest = np.full(len(findings), -np.inf)
    for i in range(0, len(codes), 2000):
        np.maximum.at(largest, of[i:i + 2000], _forward(*params, codes[i:i + 2000])[0])
    held, y = largest[held_out], np.array([findings[i][3] for i in held_out], float)
    a, b = _calibrated(held, y)
    chance = _chance(held, a, b)
    positive = np.sort(chance[y == 1])
    threshold = float(positive[int((1 - recall) * len(positive))]) if len(positive) else 0.5
    threshold = min(threshold, 0.99)
    found = chance >= threshold
    return SecretModel(*params, a, b, threshold, float(found[y == 1].mean()) if (y == 1).any() else float("nan"),
                       float(y[found].mean()) if found.any() else float("nan"))


def _calibrated(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-out logits, with softened labels."""
    soft = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    x = np.column_stack((np.clip(logits, -20, 20), np.ones(len(logits))))
    ridge = np.array([0.1, 1e-3])

    def cost(w):
        z = x @ w
        return (np.logaddexp(0, z) - soft * z).sum() + (ridge * w * w).sum() / 2

    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - soft) + ridge * w)
        step = 1.0
        while step > 1e-6 and cost(w - step * move) > cost(w):
            step /= 2
        w = w - step * move
        if np.abs(step * move).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def labelled_findings(docs: DataFrame, text_col: str, limit: int = FIT_FINDINGS, texts: int = FIT_TEXTS) -> list[tuple[str, int, int, int]]:
    """At most `limit` findings of four kinds with context: values of base findings, other coded runs, others with and without marks.

    About `texts` different texts are searched, all if there are fewer. Hashes of the text and of the finding choose, so the
    choice does not depend on order or partitions.
    """
    share = min(1.0, texts / max(docs.count(), 1))
    drawn = F.pmod(F.xxhash64(text_col, F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    docs = docs.select(F.col(text_col).alias("text")).where(F.col(text_col).isNotNull() & drawn).distinct()
    reach = LEFT + RIGHT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for texts, base in _with_base([t or "" for t in batch["text"]]):
                rows = []
                for text, spans in zip(texts, base, strict=True):
                    for a, b in (ASSIGN.match(text, a).span(2) if k == 0 else (a, b) for a, b, k in spans):
                        start = max(0, a - reach)
                        rows.append((0, 0, text[start:b + reach], a - start, b - start))
                seen = Characters(texts, base)
                rank = _rank(seen)
                for kind, there in ((1, seen.coded), (2, ~seen.coded & seen.marked), (3, ~seen.coded & ~seen.marked)):
                    there = np.flatnonzero(there)
                    ranks, first = np.unique(rank[there], return_index=True)
                    for r, i in zip(ranks[:limit], there[first[:limit]], strict=True):
                        text, at = texts[seen.owner[i]], seen.starts[seen.owner[i]]
                        a, b = int(seen.start[i] - at), int(seen.end[i] - at)
                        start = max(0, a - reach)
                        rows.append((kind, int(r), text[start:b + reach], a - start, b - start))
                yield pd.DataFrame(rows, columns=["kind", "rank", "text", "start", "end"])

    found = docs.mapInPandas(run, "kind int, rank long, text string, start int, end int")
    found = stored(found, "secret-findings").distinct()
    order = ["rank", F.xxhash64("text", "start", "end"), "text", "start", "end"]
    chosen = [found.where(F.col("kind") == y).orderBy(*order).limit(limit).collect() for y in (0, 1, 2, 3)]
    return [(r.text, r.start, r.end, int(r.kind == 0)) for rows in chosen for r in rows]


def _rank(seen: Characters) -> np.ndarray:
    """A number of every candidate that depends on its size and the characters around and in it only."""
    out = (seen.end - seen.start).astype(np.uint64)
    for j in [*range(-8, 24)]:
        out = (out ^ seen.symbols[np.minimum(seen.start + j, len(seen.symbols) - 1)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(1)).astype(np.int64)


def made_findings(count: int = 1_500, seed: int = 5) -> list[tuple[str, int, int, int]]:
    """Labelled findings from a rule: token shapes in assignments, headers and prose against names, numbers and links."""
    rng = np.random.default_rng(seed)
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    alnum, words = string.ascii_letters + string.digits, ["server", "report", "alpha", "update", "node", "value", "index", "house", "river"]
    word = lambda: str(rng.choice(words))
    out = []
    for i in range(count):
        secret = [lambda: pick(alnum, int(rng.integers(20, 44))), lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24),
                  lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24), lambda: pick(alnum + "+/", 40) + "==",
                  lambda: "eyJ" + pick(alnum + "_-", 30), lambda: "AIza" + pick(alnum + "_-", 35), lambda: pick("0123456789abcdef", 32),
                  lambda: "glpat-" + pick(alnum + "_-", 20), lambda: pick(alnum + "!#$%&*?", int(rng.integers(12, 20))),
                  lambda: pick(string.ascii_letters, int(rng.integers(24, 48)))][i % 11]()
        plain = [lambda: f"{word()}-{word()}-{rng.integers(1, 99)}", lambda: f"{word()}{rng.integers(1000, 99999)}{word()}",
                 lambda: f"/{word()}/{word()}/{rng.integers(1, 9999)}/{word()}", lambda: f"version-{rng.integers(0, 20)}-{rng.integers(0, 20)}-{word()}",
                 lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(0, 24):02d}",
                 lambda: word() + word() + word() + str(rng.integers(0, 9)), lambda: f"{word()}_{word()}_{rng.integers(1, 999)}",
                 lambda: word() + str(rng.choice(["", ",", ".", "s", "-" + word()])), lambda: str(rng.integers(10**5, 10**12)),
                 lambda: word().upper() + str(rng.choice(["!!", ",!!", ".!!", "???", "."])), lambda: word() + word() + word() + word() + str(rng.choice(["", "***", "&&&", "$$$", "%%%"]))][i % 11]()
        for value, label in ((secret, 1), (plain, 0)):
            before = str(rng.choice(["", "the ", "Authorization: Bearer ", "key = ", "auth: ", "see ", "credential ", "id ", "use ", '"', "of the "]))
            left = f"{word()} {word()} {before}"
            out.append((f"{left}{value} {word()}", len(left), len(left) + len(value), label))
    return out


def _with_base(texts: list[str]) -> Iterator[tuple[list[str], list[list[tuple[int, int, int]]]]]:
    """Parts of the texts, of bounded size unless a single text is longer, with their base spans."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and end - at < 1000 and size + len(texts[end]) <= BATCH_CHARACTERS:
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        yield part, [base_spans(t) if there or _named(t) else [] for t, there in zip(part, _has_run(part), strict=True)]
        at = end


def _named(text: str) -> bool:
    lowered = text.lower()
    return any(name in lowered for name in NAMES)


def find_spans(texts: list[str], model: SecretModel | None) -> Iterator[list[tuple[int, int, int]]]:
    """(start, end, kind) of base findings and of the candidates beside them that the network holds for secrets.

    Candidates that overlap are one span.
    """
    for part, base in _with_base(texts):
        if model:
            seen = Characters(part, base)
            # responses are found in single precision here
            for i in np.flatnonzero(model.chances(seen) >= model.threshold - 1e-6):
                spans, at = base[seen.owner[i]], seen.starts[seen.owner[i]]
                a, b = int(seen.start[i] - at), int(seen.end[i] - at)
                if spans and spans[-1][2] == 3 and a < spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]), 3)
                else:
                    spans.append((a, b, 3))
        yield from (sorted(spans) for spans in base)


def scan(docs: DataFrame, id_col: str, text_col: str, model: SecretModel | None) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of every whole text, in code points; ends are exclusive.

    Null and empty texts have no spans; without a model only the rules find. Repeated rows are repeated; other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = find_spans([t or "" for t in batch["text"]], sent.value)
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in one] for one in found]
            yield pd.DataFrame({"id": batch["id"], "spans": spans})
        give_back()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInPandas(run, f"id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def masked(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with every run of overlapping spans replaced by a mark."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str, model: SecretModel | None) -> DataFrame:
    """docs with the secrets of the text replaced by a mark; null stays null, texts without findings stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.where(batch.notna(), None).tolist()
            found = find_spans([t or "" for t in texts], sent.value)
            out = [masked(t, spans) if spans else t for t, spans in zip(texts, found, strict=True)]
            yield pd.Series(out, dtype=object)
        give_back()

    return docs.withColumn(text_col, F.pandas_udf(run, "string")(F.col(text_col)))
