"""Quality classifier: cumulative-link (ordinal logistic) regression on graded ratings.

One weight vector over hashed words and a few signals of the whole text gives a score; ordered thresholds turn it into
the chances of reaching each grade, an expected grade and the tail probability that documents are selected by.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .textkit import LETTERS_ONLY, give_back, word_hashes

#: Rated documents that a fit takes at most, picked by a hash of the id.
FIT_ROWS = 6_000
BUCKET_BITS = 22
#: Bytes of a word's beginning, a feature of its own beside the word.
BEGINNING = 4
#: A word counts only if so many rated documents hold it.
MIN_DOCUMENTS = 5
STEPS, RIDGE = 100, 1e-4
#: Weight of a word that occurs once in a text of one word; it falls with the root of the number of words.
WORD_SCALE = 8.0
#: Share of rated documents kept out of the fit, on which the threshold is set.
HELD_OUT = 0.2
SIGNALS = 6
#: Weights are summed as multiples of this fraction.
FIXED_POINT = 1 << 24

_KIND = np.zeros(256, np.uint8)  # 1 upper-case letter, 2 lower-case letter, 3 digit, 4 mark other than common punctuation
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A] = 1, 2, 3
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:?'\"()-"]] = 4


@dataclass(frozen=True)
class QualityModel:
    """Nonzero weights by bucket, weights of the signals, ordered thresholds and the least tail probability to keep."""

    buckets: np.ndarray
    weights: np.ndarray
    signal_weights: np.ndarray
    thresholds: np.ndarray
    least: float

    def tails(self, score: np.ndarray) -> np.ndarray:
        """Column k: the chance of grade k + 1 or better."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every word, bucket of every word's beginning, whether it differs from the word before, words per text)."""
    hashed, counts, begun = word_hashes(texts, LETTERS_ONLY, BEGINNING)
    bucket = lambda h: (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    fresh = np.ones(len(hashed), bool)
    fresh[1:] = hashed[1:] != hashed[:-1]
    fresh[(np.cumsum(counts) - counts)[counts > 0]] = True
    return bucket(hashed), bucket(begun), fresh, counts


def _signals(texts: list[str | None], fresh: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shares of capitals, digits, odd marks and repeated words, mean word length and log size of every text."""
    parts = [(t or "").encode("utf-8", "surrogatepass") + b" " for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    kinds = _KIND[np.frombuffer(b"".join(parts), np.uint8)]
    start = np.cumsum(sizes) - sizes
    total = lambda k: np.add.reduceat((kinds == k).astype(np.int64), start)
    upper, lower, digits, marks = (total(k) for k in (1, 2, 3, 4))
    again = np.append(~fresh, False).astype(np.int64)
    repeats = np.where(counts > 0, np.add.reduceat(again, np.cumsum(counts) - counts), 0)
    many = np.maximum(counts, 1)
    return np.column_stack([upper / np.maximum(upper + lower, 1), digits / sizes, np.minimum(10 * marks / sizes, 2.0), repeats / many,
                            np.minimum(sizes / many / 10, 3.0), np.log1p(counts) / 10])


def _scores(model: QualityModel, dense: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    words, begun, fresh, counts = _words(texts)
    # whole numbers: a text's sum does not depend on the texts beside it
    worth = np.append((dense[words] + dense[begun]) * fresh, 0)
    sums = np.where(counts > 0, np.add.reduceat(worth, np.cumsum(counts) - counts), 0) / FIXED_POINT
    seen = (_signals(texts, fresh, counts) * model.signal_weights).sum(1)
    return WORD_SCALE * sums / np.sqrt(np.maximum(counts, 1)) + seen, counts


def _dense(model: QualityModel) -> np.ndarray:
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[model.buckets] = np.round(model.weights.astype(float) * FIXED_POINT).astype(np.int64)
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _thresholds(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate((x[:1], np.exp(np.clip(x[1:], -10, 10)))))


def _minimise(loss, x: np.ndarray, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps with a halving line search."""
    value, slope = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        way, kept = slope.copy(), []
        for s, g in reversed(past):
            kept.append((s @ way) / (s @ g))
            way -= kept[-1] * g
        if past:
            s, g = past[-1]
            way *= (s @ g) / (g @ g)
        for (s, g), a in zip(past, reversed(kept), strict=True):
            way += s * (a - (g @ way) / (s @ g))
        step = 1.0 if past else 1 / max(np.abs(slope).sum(), 1.0)
        while step > 1e-8:
            there, new_slope = loss(x - step * way)
            if there <= value - 1e-4 * step * (way @ slope):
                break
            step /= 2
        else:
            break
        s, g = -step * way, new_slope - slope
        done = value - there < 1e-7 * max(value, 1e-6)
        x, value, slope = x + s, there, new_slope
        if s @ g > 1e-12:
            past = [*past[-memory + 1:], (s, g)]
        if done:
            break
    return x


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, their values, signals) of every text; what scoring sums up in one go."""
    out = []
    for i in range(0, len(texts), 200):
        part = texts[i:i + 200]
        words, begun, fresh, counts = _words(part)
        owner, words, begun = np.repeat(np.arange(len(part)), counts)[fresh], words[fresh], begun[fresh]
        pairs, times = np.unique(np.concatenate((owner, owner)) * (1 << BUCKET_BITS) + np.concatenate((words, begun)), return_counts=True)
        owner, bucket = pairs >> BUCKET_BITS, (pairs & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
        value = (WORD_SCALE * times / np.sqrt(np.maximum(counts, 1))[owner]).astype(np.float32)
        cut = np.searchsorted(owner, np.arange(len(part) + 1))
        signals = _signals(part, fresh, counts)
        out += [(bucket[a:b], value[a:b], signals[n]) for n, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
    return out


def fit(rated: list[tuple[np.ndarray, np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, keep_clean: float = 0.998) -> QualityModel:
    """Penalised maximum likelihood on features of bounded rows. The threshold keeps `keep_clean` of the held-out best grade."""
    held = np.zeros(1 << BUCKET_BITS, np.int32)
    for buckets, _, _ in rated:
        held[buckets] += 1
    named = np.flatnonzero(held >= MIN_DOCUMENTS)
    place_of = np.full(1 << BUCKET_BITS, -1, np.int32)
    place_of[named] = np.arange(len(named))
    common = [place_of[b] >= 0 for b, _, _ in rated]
    at = np.concatenate([place_of[b][c] for (b, _, _), c in zip(rated, common, strict=True)])
    value = np.concatenate([v[c] for (_, v, _), c in zip(rated, common, strict=True)])
    owner = np.repeat(np.arange(len(rated), dtype=np.int32), [int(c.sum()) for c in common])
    extra = np.stack([x for _, _, x in rated])
    del held, place_of, common

    order = np.random.default_rng(7).permutation(len(rated))
    held_out, train = np.split(order, [int(len(rated) * HELD_OUT)])
    in_train = np.isin(owner, train)
    row = np.full(len(rated), -1)
    row[train] = np.arange(len(train))
    rows, columns, values, y = row[owner[in_train]], at[in_train], value[in_train], grades[train]
    size = len(named)
    ridge = np.concatenate((np.full(size, RIDGE), np.full(SIGNALS, RIDGE / 1000), np.zeros(levels - 1)))

    def loss(x):
        """Mean negative log likelihood with a ridge, and its gradient. Thresholds are the first and the logs of the steps."""
        w, v, theta = x[:size], x[size:size + SIGNALS], _thresholds(x[size + SIGNALS:])
        s = np.bincount(rows, weights=w[columns] * values, minlength=len(train)) + extra[train] @ v
        # P(y) = F(upper - s) - F(lower - s) with F the logistic function
        fu = np.where(y < levels - 1, _logistic(theta[np.minimum(y, levels - 2)] - s), 1.0)
        fl = np.where(y > 0, _logistic(theta[np.maximum(y - 1, 0)] - s), 0.0)
        p = np.maximum(fu - fl, 1e-12)
        du, dl = fu * (1 - fu) / p / len(y), fl * (1 - fl) / p / len(y)
        ds = du - dl
        dt = np.bincount(np.maximum(y - 1, 0), weights=dl, minlength=levels - 1)[:levels - 1] - \
            np.bincount(np.minimum(y, levels - 2), weights=du, minlength=levels - 1)
        tail = np.cumsum(dt[::-1])[::-1]
        tail[1:] *= np.diff(theta)
        slope = np.concatenate((np.bincount(columns, weights=ds[rows] * values, minlength=size), extra[train].T @ ds, tail))
        return -np.log(p).mean() + (ridge * x * x).sum() / 2, slope + ridge * x

    x = _minimise(loss, np.zeros(size + SIGNALS + levels - 1))
    w, v, theta = x[:size], x[size:size + SIGNALS], _thresholds(x[size + SIGNALS:])
    model = QualityModel(named[w != 0], w[w != 0].astype(np.float32), v, theta, 0.5)
    best = held_out[grades[held_out] == levels - 1]
    if len(best):
        place = np.full(len(rated), -1)
        place[best] = np.arange(len(best))
        own = place[owner] >= 0
        reached = np.bincount(place[owner[own]], weights=w[at[own]] * value[own], minlength=len(best)) + extra[best] @ v
        tail = np.sort(model.tails(reached)[:, -1])
        model = QualityModel(model.buckets, model.weights, v, theta, float(min(0.5, tail[int((1 - keep_clean) * len(tail))])))
    return model


def fit_ratings(docs: DataFrame, id_col: str, text_col: str, ratings: DataFrame, rating_id: str, grade_col: str,
                fit_rows: int = FIT_ROWS) -> QualityModel | None:
    """Fits on at most `fit_rows` rated documents, chosen by a hash of their id; None without any rated document.

    Grades are integers from 0 (worst). Ratings without a grade, an id or a document do not count; a document rated
    several times counts with each rating.
    """
    rated = ratings.select(F.col(rating_id).alias("_id"), F.col(grade_col).cast("int").alias("_grade")).where("_id is not null and _grade is not null")
    chosen = rated.orderBy(F.xxhash64("_id"), "_id", "_grade").limit(fit_rows)  # bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = features(batch["_text"].where(batch["_text"].notna(), None).tolist())
            yield pd.DataFrame({"place": batch["_place"], "grade": batch["_grade"], **{n: [x[i].tobytes() for x in found] for i, n in enumerate(_PACKED)}})

    rows = texts.select("_text", "_grade", F.xxhash64("_id", "_text").alias("_place")) \
        .mapInPandas(run, "place long, grade int, " + ", ".join(f"{n} binary" for n in _PACKED)).collect()
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (r.place, r.grade))
    grades = np.array([r.grade for r in rows])
    packed = [tuple(np.frombuffer(r[n], kind) for n, kind in _PACKED.items()) for r in rows]
    model = fit(packed, grades, max(int(grades.max()) + 1, 2))
    del rows, packed
    give_back()  # the driver lives on, too
    return model


#: Features of a text as they travel to the fit.
_PACKED = {"buckets": np.int32, "values": np.float32, "signals": np.float64}


def _judge(spark: SparkSession, model: QualityModel):
    """Column function: a text's struct<expected_grade, p_best, keep>."""
    sent = spark.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        dense = _dense(sent.value)
        for batch in texts:
            out = [pd.DataFrame({"expected_grade": np.empty(0), "p_best": np.empty(0), "keep": np.empty(0, bool)})]
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at:at + 1000]
                score, counts = _scores(sent.value, dense, part.where(part.notna(), None).tolist())
                tails = np.where(counts[:, None] > 0, sent.value.tails(score), 0.0)
                out.append(pd.DataFrame({"expected_grade": tails.sum(1), "p_best": tails[:, -1], "keep": (tails[:, -1] >= sent.value.least) & (counts > 0)}))
            yield pd.concat(out[1:] or out)
        del dense
        give_back()

    return F.pandas_udf(run, "expected_grade double, p_best double, keep boolean")


def grade_texts(docs: DataFrame, text_col: str, model: QualityModel | None) -> DataFrame:
    """Rows of docs with expected_grade, p_best (chance of the best grade) and keep; clashing columns are replaced.

    A text without words (null, blank, marks only) has grade 0 and is not kept. Without a model the figures are null
    and every row is kept. Equal texts have equal results; repeated rows are repeated.
    """
    named = ["expected_grade", "p_best", "keep"]
    judged = F.struct(*[F.lit(None).cast("double").alias(c) for c in named[:2]], F.lit(True).alias("keep")) if model is None \
        else _judge(docs.sparkSession, model)(F.col(text_col))
    others = [c for c in docs.columns if c not in named]
    return docs.select(*others, judged.alias("_judged")).select(*others, "_judged.*")


def good_texts(docs: DataFrame, text_col: str, model: QualityModel | None) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    return docs if model is None else docs.where(_judge(docs.sparkSession, model)(F.col(text_col))["keep"])
