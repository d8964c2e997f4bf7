"""Personal data: rules give base spans; a bidirectional LSTM over characters with CRF transitions adds other forms.

The network is trained here, in numpy, on labelled spans. Overlapping windows cover every text whole. They are decoded
one by one, but for those that lack what each kind of span must have, and the best set of spans without overlaps is
chosen over the whole text.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base rules.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile("[0-9]")
#: A sign of an address and a dot in it, spelled out or not.
_AT, _DOT = re.compile(r"@|(?<![^\W_])at(?![^\W_])", re.I), re.compile(r"\.|(?<![^\W_])dot(?![^\W_])", re.I)
#: Characters of a window, and between the beginnings of windows.
WINDOW, STRIDE = 96, 48
#: Kind k is tagged 1 + 2k where it begins and 2 + 2k where it goes on; 0 is no personal data.
TAGS = 1 + 2 * len(KINDS)
HIDDEN, EMBEDDED = 16, 12
_CLASSES = "abcdefghijklmnopqrstuvwxyz"
#: Labelled texts that a fit takes at most from the corpus.
FIT_TEXTS = 600


def _octet(digits: str) -> bool:
    """ASCII digits of a number up to 255, with any number of zeros before it."""
    bare = digits.lstrip("0")
    return digits.isascii() and digits.isdigit() and len(bare) <= 3 and int(bare or "0") <= 255


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the rules, kinds as listed; each kind leftmost and without overlaps, failing matches dropped."""
    found = []
    if "@" in text:
        # a match holds an '@': only the words around one are searched, from where no earlier match can begin
        at = 0
        while (sign := text.find("@", at)) >= 0:
            start = sign
            while start > at and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
                start -= 1
            match = EMAIL.match(text, start) if start < sign else None
            if match:
                found.append((0, *match.span()))
            at = match.end() if match else sign + 1
    if _DIGIT.search(text):
        found += [(1, *m.span()) for m in IP.finditer(text) if all(map(_octet, m.group().split(".")))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() >= 16 else ""
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(found)


def _code(text: str) -> np.ndarray:
    """Class of every character: letter by value, digit, or mark; capitals have classes of their own only as a group."""
    get = _CODE.get
    return np.array([get(c, 1) for c in text], np.int64)


_CODE = {c: i + 2 for i, c in enumerate(_CLASSES + "0123456789 .,@+-()[]_%:;/'\"\n")}
_CODE |= {c.upper(): _CODE[c] for c in _CLASSES}
SYMBOLS = len(_CODE) + 2


@dataclass(frozen=True)
class PiiModel:
    """Parameters: embedding, two LSTMs (forward, backward), emission layer, transitions, tags to start with."""

    embedding: np.ndarray
    lstms: tuple[tuple[np.ndarray, np.ndarray], ...]
    emission: np.ndarray
    transitions: np.ndarray
    first: np.ndarray

    def emissions(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return _emissions(self, codes, lengths)[0]


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(inputs: np.ndarray, weights: np.ndarray, bias: np.ndarray):
    """inputs (time, batch, features); weights over features and state for the four gates. Returns states and a cache."""
    time, batch, _ = inputs.shape
    size = weights.shape[1] // 4
    drive = inputs @ weights[:inputs.shape[2]] + bias
    state, cell = np.zeros((batch, size)), np.zeros((batch, size))
    states, cache = np.empty((time, batch, size)), []
    for t in range(time):
        gates = drive[t] + state @ weights[inputs.shape[2]:]
        i, f, o = _sigmoid(gates[:, :size]), _sigmoid(gates[:, size:2 * size]), _sigmoid(gates[:, 2 * size:3 * size])
        g = np.tanh(gates[:, 3 * size:])
        before, cell = cell, f * cell + i * g
        squashed = np.tanh(cell)
        cache.append((i, f, o, g, before, squashed, state))
        state = o * squashed
        states[t] = state
    return states, cache


def _lstm_back(slopes, inputs, weights, cache):
    """Slopes of inputs, weights and bias from those of the states."""
    time, batch, features = inputs.shape
    size = weights.shape[1] // 4
    d_inputs, d_weights, d_bias = np.empty_like(inputs), np.zeros_like(weights), np.zeros(weights.shape[1])
    d_state, d_cell = np.zeros((batch, size)), np.zeros((batch, size))
    for t in range(time - 1, -1, -1):
        i, f, o, g, before, squashed, state = cache[t]
        total = slopes[t] + d_state
        d_cell = d_cell + total * o * (1 - squashed * squashed)
        gates = np.concatenate((d_cell * g * i * (1 - i), d_cell * before * f * (1 - f), total * squashed * o * (1 - o), d_cell * i * (1 - g * g)), 1)
        d_weights[:features] += inputs[t].T @ gates
        d_weights[features:] += state.T @ gates
        d_bias += gates.sum(0)
        d_inputs[t], d_state = gates @ weights[:features].T, gates @ weights[features:].T
        d_cell = d_cell * f
    return d_inputs, d_weights, d_bias


def _reverse(lengths: np.ndarray, width: int) -> np.ndarray:
    """(batch, time) index that turns every row around within its length."""
    at = np.arange(width)[None, :]
    return np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)


def _emissions(model, codes, lengths):
    turn = _reverse(lengths, codes.shape[1])
    rows = np.arange(len(codes))[:, None]
    seen = model.embedding[codes]
    ahead, cache_a = _lstm(seen.transpose(1, 0, 2), *model.lstms[0])
    back, cache_b = _lstm(seen[rows, turn].transpose(1, 0, 2), *model.lstms[1])
    both = np.concatenate((ahead.transpose(1, 0, 2), back.transpose(1, 0, 2)[rows, turn], np.ones((*codes.shape, 1))), 2)
    return both @ model.emission, (turn, rows, seen, cache_a, cache_b, both)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _crf(scores, lengths, tags, transitions, first):
    """Mean negative log likelihood of the tags and its slopes for scores, transitions and first tags."""
    batch, time, size = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[:, 0] = first + scores[:, 0]
    for t in range(1, time):
        step = _logsum(alpha[:, t - 1, :, None] + transitions, 1) + scores[:, t]
        alpha[:, t] = np.where((t < lengths)[:, None], step, alpha[:, t - 1])
    for t in range(time - 2, -1, -1):
        step = _logsum(transitions + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where((t + 1 < lengths)[:, None], step, 0.0)
    total = _logsum(alpha[:, -1], 1)
    live = np.arange(time)[None, :] < lengths[:, None]
    rows, at = np.arange(batch)[:, None], np.arange(time)[None, :]
    gold = np.zeros_like(scores)
    gold[rows, at, tags] = 1
    d_scores = (np.exp(alpha + beta - total[:, None, None]) - gold) * live[:, :, None]
    pair = alpha[:, :-1, :, None] + transitions + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
    pair = np.exp(np.minimum(pair, 0)) * live[:, 1:, None, None]
    d_transitions = pair.sum((0, 1))
    np.add.at(d_transitions, (tags[:, :-1][live[:, 1:]], tags[:, 1:][live[:, 1:]]), -1)
    value = total.sum() - (scores[rows, at, tags] * live).sum() - first[tags[:, 0]].sum() - (transitions[tags[:, :-1], tags[:, 1:]] * live[:, 1:]).sum()
    return value / batch, d_scores / batch, d_transitions / batch, d_scores[:, 0].sum(0) / batch


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Large penalties for tags that cannot follow each other or come first: a span goes on only within itself."""
    pairs, first = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
    for k in range(len(KINDS)):
        on = 2 + 2 * k
        first[on] = -1e4
        pairs[[t for t in range(TAGS) if t not in (on, on - 1)], on] = -1e4
    return pairs, first


def fit(examples: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 8, batch: int = 64) -> PiiModel:
    """Trains on (text of up to WINDOW characters, its spans); Adam on the CRF likelihood with backpropagation through time."""
    rng = np.random.default_rng(3)
    lengths = np.array([len(t) for t, _ in examples])
    codes, tags = np.zeros((len(examples), WINDOW), np.int64), np.zeros((len(examples), WINDOW), np.int64)
    for n, (text, spans) in enumerate(examples):
        codes[n, :len(text)] = _code(text)
        for kind, a, b in spans:
            tags[n, a:b] = 2 + 2 * kind
            tags[n, a] = 1 + 2 * kind
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    blocked, blocked_first = _allowed()
    one = EMBEDDED + HIDDEN
    params = [draw(SYMBOLS, EMBEDDED) * 3, draw(one, 4 * HIDDEN), np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN), draw(one, 4 * HIDDEN),
              np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN), draw(2 * HIDDEN + 1, TAGS), np.zeros((TAGS, TAGS)), np.zeros(TAGS)]
    moments, step = [(np.zeros_like(p), np.zeros_like(p)) for p in params], 0
    as_model = lambda: PiiModel(params[0], ((params[1], params[2]), (params[3], params[4])), params[5], params[6] + blocked, params[7] + blocked_first)
    for epoch in range(epochs):
        order = rng.permutation(len(examples))
        for i in range(0, len(order), batch):
            rows = order[i:i + batch]
            width = int(lengths[rows].max())
            x, y, size = codes[rows, :width], tags[rows, :width], lengths[rows]
            model = as_model()
            scores, (turn, index, seen, cache_a, cache_b, both) = _emissions(model, x, size)
            _, d_scores, d_pairs, d_first = _crf(scores, size, y, model.transitions, model.first)
            d_both = d_scores @ params[5].T
            d_ahead = d_both[:, :, :HIDDEN].transpose(1, 0, 2)
            d_back = d_both[:, :, HIDDEN:2 * HIDDEN][index, turn].transpose(1, 0, 2)
            in_a, w_a, b_a = _lstm_back(d_ahead, seen.transpose(1, 0, 2), params[1], cache_a)
            in_b, w_b, b_b = _lstm_back(d_back, seen[index, turn].transpose(1, 0, 2), params[3], cache_b)
            d_seen = in_a.transpose(1, 0, 2) + in_b.transpose(1, 0, 2)[index, turn]
            d_embedding = np.zeros_like(params[0])
            np.add.at(d_embedding, x, d_seen)
            slopes = [d_embedding, w_a, b_a, w_b, b_b, np.tensordot(both, d_scores, ((0, 1), (0, 1))), d_pairs, d_first]
            norm = np.sqrt(sum((g * g).sum() for g in slopes))
            step += 1
            rate = 0.02 * (1 - epoch / epochs)
            for p, g, (m, v) in zip(params, slopes, moments, strict=True):
                g = g * min(1.0, 5 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return as_model()


def decode(model: PiiModel, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """(kind, start, end, score) of the best tagging of every window; the score is what its tags gain over none."""
    out: list = []
    for i in range(0, len(texts), 256):
        part = texts[i:i + 256]
        lengths = np.array([len(t) for t in part])
        codes = np.zeros((len(part), int(lengths.max())), np.int64)
        for n, t in enumerate(part):
            codes[n, :len(t)] = _code(t)
        scores = model.emissions(codes, lengths)
        best, back = model.first + scores[:, 0], []
        for t in range(1, codes.shape[1]):
            step = best[:, :, None] + model.transitions
            back.append(step.argmax(1))
            best = np.where((t < lengths)[:, None], step.max(1) + scores[:, t], best)
        for n, size in enumerate(lengths.tolist()):
            tag = int(best[n].argmax())
            path = [tag]
            for t in range(size - 2, -1, -1):
                tag = int(back[t][n, tag])
                path.append(tag)
            path.reverse()
            spans, at = [], 0
            while at < size:
                end = at + 1
                if path[at]:
                    while end < size and path[end] == path[at] + (path[at] & 1):
                        end += 1
                    gain = float((scores[n, np.arange(at, end), path[at:end]] - scores[n, at:end, 0]).mean())
                    spans.append(((path[at] - 1) // 2, at, end, gain))
                at = end
            out.append(spans)
    return out


def windows_of(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over the whole text, in order; each span up to STRIDE long lies whole in one."""
    return [(s, min(s + WINDOW, len(text))) for s in range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE)] if text else []


def candidate_windows(text: str) -> list[tuple[int, int]]:
    """Those windows that can hold a span that `_plausible` accepts: seven digits (card, phone), four digits and three dots
    (ip), or a sign and a dot of an address. No span of another window is ever accepted, so its decoding would be lost."""
    places = windows_of(text)
    if not places:
        return places
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts, ends = np.array(places).T

    def held(marks: np.ndarray) -> np.ndarray:
        upto = np.append(0, np.cumsum(marks))
        return upto[ends] - upto[starts]

    def begins(pattern: re.Pattern) -> np.ndarray:
        marks = np.zeros(len(points), np.int64)
        marks[[m.start() for m in pattern.finditer(text)]] = 1
        return marks

    digits = held((points >= 48) & (points <= 57))
    can = (digits >= 7) | (digits >= 4) & (held(points == 46) >= 3)
    signs = begins(_AT)
    if signs.any():
        can |= (held(signs) > 0) & (held(begins(_DOT)) > 0)
    return [places[n] for n in np.flatnonzero(can)]


def reconciled(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of spans from all windows the set without overlaps that has the highest sum of scores, over the whole text."""
    merged: dict[tuple[int, int, int], float] = {}
    for kind, a, b, score in found:
        merged[a, b, kind] = max(score, merged.get((a, b, kind), score))
    ranked = sorted(merged.items(), key=lambda x: (x[0][1], x[0][0], x[0][2]))
    ends = [key[1] for key, _ in ranked]
    best, take = [0.0], []
    for n, ((a, _, _), score) in enumerate(ranked):
        before = int(np.searchsorted(ends[:n], a, side="right"))
        take.append((best[before] + score > best[n], before))
        best.append(max(best[n], best[before] + score))
    out, n = [], len(ranked)
    while n:
        taken, before = take[n - 1]
        if taken:
            a, b, kind = ranked[n - 1][0]
            out.append((kind, a, b))
            n = before
        else:
            n -= 1
    return out[::-1]


def _plausible(text: str, kind: int, a: int, b: int) -> bool:
    """A span of the network has what its kind cannot lack, and its ends are not inside a word or number."""
    value = text[a:b]
    digits = sum(c in "0123456789" for c in value)
    whole = not (a and text[a - 1].isalnum() and value[0].isalnum()) and not (b < len(text) and text[b].isalnum() and value[-1].isalnum())
    if kind == 0:
        has = ("@" in value or re.search(r"\bat\b", value, re.I)) and ("." in value or re.search(r"\bdot\b", value, re.I)) and len(value) >= 6
    elif kind == 1:
        has = value.count(".") == 3 and all(_octet(p.strip()) for p in value.split("."))
    elif kind == 2:
        has = 13 <= digits <= 19 and _luhn("".join(c for c in value if c in "0123456789")) and not re.search("[A-Za-z]", value)
    else:
        has = 7 <= digits <= 15 and not re.search("[A-Za-z@]", value) and "\n" not in value
    return bool(has and whole)


def find_spans(texts: list[str], model: PiiModel | None, bases: list[list[tuple[int, int, int]]] | None = None) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of every text: base spans and, where they leave room, those of the network."""
    bases = [base_spans(t) for t in texts] if bases is None else bases
    if model is None:
        return bases
    places = [(n, a, b) for n, t in enumerate(texts) for a, b in candidate_windows(t)]
    tagged = decode(model, [texts[n][a:b] for n, a, b in places]) if places else []
    per_text: dict[int, list] = {}
    for (n, a, b), spans in zip(places, tagged, strict=True):
        for kind, s, e, score in spans:
            # what touches the rim of a window is whole in its neighbour
            cut = s == 0 and a > 0 and texts[n][a - 1].isalnum() or e == b - a and b < len(texts[n]) and texts[n][b].isalnum()
            if not cut and score > 0 and _plausible(texts[n], kind, a + s, a + e) and not any(x < a + e and a + s < y for _, x, y in bases[n]):
                per_text.setdefault(n, []).append((kind, a + s, a + e, score))
    return [sorted(base + reconciled(per_text[n])) if n in per_text else base for n, base in enumerate(bases)]


def made_examples(carriers: list[str], count: int = 1_800, seed: int = 17) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled texts from a rule: usual and spelled-out forms of every kind, and numbers that are none, set between words."""
    rng = np.random.default_rng(seed)
    digits = lambda n: "".join(rng.choice(list("0123456789"), n))
    low = lambda n: "".join(rng.choice(list(_CLASSES), n))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    num = lambda a, b: str(int(rng.integers(a, b)))

    def email():
        name = pick(low(6), low(4) + "." + low(6), low(5) + "_" + num(1, 99), low(6) + "." + num(10, 99))
        host, top = pick(low(7), "mail" + num(0, 10) + ".example", low(5) + "-" + low(4)), pick("com", "org", "net", "io", "de")
        return pick(f"{name}@{host}.{top}", f"{name} at {host} dot {top}", f"{name} [at] {host} [dot] {top}", f"{name} (at) {host} (dot) {top}",
                    f"{name} @ {host}.{top}", f"{name}@{host} dot {top}", f"{name.replace('.', ' dot ')} at {host} dot {top}", f"{name}(at){host}.{top}")

    def phone():
        a, b, c = num(200, 999), num(200, 999), digits(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(20, 99)} {digits(3)} {digits(3)} {digits(4)}",
                    f"+{num(20, 99)}{digits(9)}", f"1-{a}-{b}-{c}", f"{a} {b} {c}", f"00{num(20, 99)} {digits(3)} {digits(6)}")

    def card():
        body = pick("4", "51", "37", "6011")
        size = 15 if body == "37" else 16
        body += digits(size - 1 - len(body))
        full = next(body + d for d in "0123456789" if _luhn(body + d))
        return pick(full, f"{full[:4]} {full[4:8]} {full[8:12]} {full[12:]}", f"{full[:4]}-{full[4:8]}-{full[8:12]}-{full[12:]}", f"{full[:4]}.{full[4:8]}.{full[8:12]}.{full[12:]}")

    def ip():
        return ".".join(num(0, 256) for _ in range(4))

    def none():
        return pick(f"{num(1900, 2030)}-{num(10, 13)}-{num(10, 29)}", digits(int(rng.integers(2, 7))), f"{num(1, 999)}.{digits(2)}", f"{num(1, 24)}:{digits(2)}",
                    f"v{num(1, 9)}.{num(1, 20)}.{num(1, 20)}", f"{num(1, 99)},{digits(3)},{digits(3)}", f"#{digits(8)}", low(9) + digits(12), "at", "dot", "look at",
                    f"{digits(3)} {digits(3)} items", f"{num(1, 50)} - {num(50, 99)}", f"0x{digits(8)}", f"{num(1990, 2020)} {num(1990, 2020)} {num(1990, 2020)}")

    out = []
    for i in range(count):
        line = str(rng.choice(carriers)) if carriers else ""
        words = [w for w in line.split() if w.strip(".,").isalpha()][:40] or [low(int(rng.integers(2, 9))) for _ in range(8)]
        at = int(rng.integers(0, len(words) + 1))
        left = " ".join(words[max(0, at - 4):at])[-30:]
        right = " ".join(words[at:at + 3])[:30]
        kind = i % 6
        value = (email, ip, card, phone, none, email)[kind]()[:WINDOW - 4]
        text = f"{left} {value}{pick('', '.', ',')} {right}".lstrip() if left else f"{value} {right}"
        start = text.find(value)
        out.append((text[:WINDOW], [] if kind == 4 or start + len(value) > WINDOW else [(0 if kind == 5 else kind, start, start + len(value))]))
    return out


def labelled_windows(docs: DataFrame, text_col: str, limit: int = FIT_TEXTS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most `limit` windows of the texts that hold base spans, with these as labels. All texts are searched, a hash chooses."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                spans = base_spans(text) if text else []
                for a, b in windows_of(text) if spans else ():
                    inside = [(k, s - a, e - a) for k, s, e in spans if a <= s and e <= b]
                    if inside and not any(s < a < e or s < b < e for _, s, e in spans):
                        flat = [x for n, y in enumerate(inside) for x in y if not any(y[1] < z[2] and z[1] < y[2] for z in inside[:n])]
                        rows.append((text[a:b], flat))
            yield pd.DataFrame(rows, columns=["text", "spans"])

    found = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "text string, spans array<int>")
    chosen = found.distinct().orderBy(F.xxhash64("text"), "text").limit(limit).collect()
    return [(r.text, [tuple(r.spans[i:i + 3]) for i in range(0, len(r.spans), 3)]) for r in chosen]


def train_model(docs: DataFrame, text_col: str) -> PiiModel:
    """Fits on windows of the texts that the rules label and on made examples set between words of the same texts."""
    labelled = labelled_windows(docs, text_col)
    return fit(labelled + made_examples([t for t, _ in labelled]))


def find_pii(docs: DataFrame, id_col: str, text_col: str, model: PiiModel | None) -> DataFrame:
    """(id, base, spans): arrays of struct<kind, start, end> in code points, ends exclusive; spans holds base, too.

    Null and empty texts have no spans; without a model only the rules find. Texts are searched whole, whatever
    their length. Repeated rows are repeated; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    shown = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            bases = [base_spans(t) for t in texts]
            yield pd.DataFrame({"id": batch["id"], "base": [shown(s) for s in bases], "spans": [shown(s) for s in find_spans(texts, sent.value, bases)]})

    span = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, base {span}, spans {span}")
