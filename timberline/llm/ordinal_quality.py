"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight per hashed word, shared by all grades, and ordered thresholds:
P(grade <= k) = sigmoid(threshold_k - w.x). A text is the set of its words, of their
starts and ends, and of a few marks of its shape (shouting, symbols, repetition),
hashed to ``1 << bits`` slots. Fitting takes a bounded sample of rated rows; scoring is one pass in which
the weights (``4 << bits`` bytes, whatever the corpus) travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import binary, words

SAMPLE = 8_192
BITS = 18
TELLING = 7.0  # standard deviations by which a slot's rows must differ from the rest, among many ratings
FEW = 50  # what n ratings ask for falls as the root of n / (n + FEW): no slot can differ by more than the root of n, and this stays below it


def _steps(part: int, whole: int) -> int:
    """The share part / whole on a scale of 0 to 10."""
    return 10 * part // max(whole, 1)


def features(text: bytes | None, bits: int) -> np.ndarray:
    """Sorted distinct slots of a text; null and empty texts have only the marks of their shape."""
    found = words(text)
    distinct = set(found)
    letters = (text or b"").translate(None, b" \t\n\x0b\x0c\r")
    upper = len(letters) - len(letters.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(letters) - len(letters.translate(None, b"!#$%&*+/<=>@\\^_`{|}~"))
    digits = len(letters) - len(letters.translate(None, b"0123456789"))
    again = sum(map(bytes.__eq__, found, found[1:]))
    shape = {
        "words": len(found).bit_length(),
        "upper": _steps(upper, len(letters)),
        "symbols": _steps(symbols, len(letters)),
        "digits": _steps(digits, len(letters)),
        "again": _steps(again, len(found)),
        "length": min(len(letters) // max(len(found), 1), 20),
    }
    # White space parts words, so a mark, a start or an end never equals a word.
    starts = [b" 4" + w[:4] for w in distinct if len(w) > 4] + [b" 5" + w[:5] for w in distinct if len(w) > 5]
    distinct.update(starts + [b" 3" + w[-3:] for w in distinct if len(w) > 3])
    distinct.update(f" {k} {v}".encode() for k, v in shape.items())
    slots = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    return np.unique((slots & np.uint64((1 << bits) - 1)).astype(np.int32))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than the grades
    bits: int

    def grades(self, slots: np.ndarray) -> np.ndarray:
        """P(grade = k) for each k."""
        below = _sigmoid(self.thresholds - float(self.weights[slots].sum(dtype=np.float64)))
        return np.diff(np.concatenate([[0.0], below, [1.0]]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fit_rows(rows: list[tuple[int, np.ndarray]], grades: int, bits: int, epochs: int = 400, penalty: float = 1e-4) -> Model:
    """Maximum likelihood with an L2 penalty, by full-batch Adam; the same rows give the same model.

    Grades weigh by the root of their rows in total, so that a rare one is learnt. Only
    slots whose rows have a grade clearly more or less often than all rows, and that
    are seen three times, get a weight; with fewer rows less of a difference is clear. Without rows all grades are as likely.
    """
    start = np.linspace(-1.0, 1.0, grades - 1) if grades > 2 else np.zeros(grades - 1)
    if not rows:
        k = np.arange(1, grades) / grades
        return Model(np.zeros(1 << bits, np.float32), np.log(k / (1 - k)), bits)
    y = np.array([g for g, _ in rows])
    lengths = np.array([len(s) for _, s in rows])
    slots = np.concatenate([s for _, s in rows])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    seen, telling = np.bincount(slots, minlength=1 << bits), np.zeros(1 << bits)
    for k in range(grades):
        part = np.mean(y == k)
        own = np.bincount(slots, weights=y[owner] == k, minlength=1 << bits)
        spread = seen * part * (1 - part) * (1 - seen / len(y))
        telling = np.maximum(telling, np.abs(own - seen * part) / np.sqrt(np.maximum(spread, 1e-9)))
    used = ((telling >= TELLING * np.sqrt(len(y) / (len(y) + FEW))) & (seen >= 3))[slots]
    slots, owner = slots[used], owner[used]
    used, slots = np.unique(slots, return_inverse=True)
    share = 1.0 / np.sqrt(np.bincount(y, minlength=grades).clip(1)[y])
    share /= share.sum()
    # Thresholds are a first value and positive gaps, kept as logarithms, so they stay ordered.
    theta = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.diff(start))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    rate, n = 0.05, len(used)
    for step in range(1, epochs + 1):
        w, gaps = theta[:n], np.exp(theta[n + 1 :])
        cuts = theta[n] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(owner, weights=w[slots], minlength=len(y))
        high = np.where(y < grades - 1, _sigmoid(cuts[np.minimum(y, grades - 2)] - score), 1.0)
        low = np.where(y > 0, _sigmoid(cuts[np.maximum(y - 1, 0)] - score), 0.0)
        chance = np.maximum(high - low, 1e-12)
        dhigh, dlow = high * (1 - high) / chance, low * (1 - low) / chance
        by_score = share * (dhigh - dlow)  # of the negative log-likelihood
        by_cut = np.zeros(grades - 1)
        np.add.at(by_cut, y[y < grades - 1], -(share * dhigh)[y < grades - 1])
        np.add.at(by_cut, y[y > 0] - 1, (share * dlow)[y > 0])
        tails = np.cumsum(by_cut[::-1])[::-1]
        by_w = np.bincount(slots, weights=by_score[owner], minlength=n) + penalty * w
        grad = np.concatenate([by_w, tails[:1], tails[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << bits, np.float32)
    weights[used] = theta[:n]
    return Model(weights, theta[n] + np.concatenate([[0.0], np.cumsum(np.exp(theta[n + 1 :]))]), bits)


def fit(
    docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, bits: int = BITS
) -> Model:
    """Fits on ``ratings`` (id, ``grade`` 0 .. grades - 1), on at most ``sample`` ids, the first by hash.

    An id rated several times counts with its lowest grade, and a rated id that
    stands in several rows of ``docs`` with one of its texts. Null ids and grades are not used.
    """
    rated = ratings.filter(F.col(id_col).isNotNull() & F.col("grade").isNotNull())
    rated = rated.groupBy(F.col(id_col).alias("_id")).agg(F.min("grade").cast("int").alias("grade"))
    rated = rated.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # at most `sample` rows are broadcast
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(rated), "_id")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [features(t, bits).tobytes() for t in binary(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("grade"), pa.array(out, pa.binary())], ["_id", "grade", "slots"])

    kind = f"_id {dict(found.dtypes)['_id']}, grade int, slots binary"
    rows = found.select("_id", "grade", "text").mapInArrow(slots, kind)
    rows = rows.groupBy("_id", "grade").agg(F.min("slots").alias("slots")).orderBy(F.xxhash64("_id"), "_id").collect()  # at most `sample`
    return fit_rows([(r.grade, np.frombuffer(r.slots, np.int32)) for r in rows], grades, bits)


def score(docs: DataFrame, model: Model, least: int, chance: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_grade, tail, keep): tail is P(grade >= least), keep is tail >= chance.

    A null text scores as an empty one. Every row has one result, repeated and
    null ids too. Other columns are ignored, whatever their names.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    values = np.arange(len(model.thresholds) + 1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([model.grades(features(t, model.bits)) for t in binary(batch, "text")]).reshape(-1, len(values))
            tail = p[:, least:].sum(1)
            columns = [batch.column("_id"), pa.array(p @ values), pa.array(tail), pa.array(tail >= chance)]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "expected_grade", "tail", "keep"])

    kind = f"_id {dict(source.dtypes)['_id']}, expected_grade double, tail double, keep boolean"
    return source.mapInArrow(judge, kind).withColumnRenamed("_id", id_col)


def accepted(docs: DataFrame, model: Model, least: int, chance: float = 0.5, text_col: str = "text") -> DataFrame:
    """All columns of the rows that ``score`` keeps; nothing is shuffled."""

    @F.arrow_udf("boolean")
    def keep(texts: pa.Array) -> pa.Array:
        slots = (features(t.as_py(), model.bits) for t in texts.cast(pa.binary()))
        return pa.array([bool(model.grades(s)[least:].sum() >= chance) for s in slots], pa.bool_())

    return docs.filter(keep(text_col))
