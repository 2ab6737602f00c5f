import math
import random

import numpy as np
import pytest

from timberline.llm.ordinal_quality import features, fit, fit_rows, score

WORDS = [f"word{k}" for k in range(300)]


def corpus(seed, n=600):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        text = [r.choice(WORDS) for _ in range(r.randrange(5, 120))]
        grade = k % 3
        if grade == 0:
            text[r.randrange(len(text))] = r.choice(["awful", "vile"])
        if grade == 1:
            text = [w.upper() + "!!" for w in text]
        rows.append((k, " ".join(text), grade))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t, _ in rows], "doc_id long, text string, grade int")


def ratings(spark, rows):
    return spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int")


def test_held_out_accuracy(spark):
    train, test = corpus(1), corpus(2)
    model = fit(frame(spark, train), ratings(spark, train), grades=3)
    assert list(model.thresholds) == sorted(model.thresholds)
    out = {r.doc_id: r for r in score(frame(spark, test), model, least=2).collect()}
    right = sum(out[i].keep == (g == 2) for i, _, g in test)
    assert right >= 0.98 * len(test)
    means = [np.mean([out[i].expected_grade for i, _, g in test if g == k]) for k in range(3)]
    assert means[0] < 0.4 < means[1] < 1.6 < means[2]
    assert all(abs(model.grades(features(t.encode(), model.bits)).sum() - 1) < 1e-9 for _, t, _ in test[:50])


def test_the_same_rows_give_the_same_model(spark):
    rows = corpus(3, 120)
    a = fit(frame(spark, rows), ratings(spark, rows), grades=3)
    b = fit(frame(spark, rows[::-1]).repartition(3), ratings(spark, rows[::-1]), grades=3)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds)


def test_sample_is_bounded(spark):
    rows = corpus(4, 90)
    model = fit(frame(spark, rows), ratings(spark, rows), grades=3, sample=2)
    assert not model.weights.any()  # no slot is seen in three rows


def test_odd_rows(spark):
    model = fit(frame(spark, []), ratings(spark, []), grades=3)
    rows = [(1, None, 0), (1, "", 0), (None, "x", 0), (2, "y " * 100_000, 0), (2, "y " * 100_000, 0)]
    out = score(frame(spark, rows), model, least=2).collect()
    assert len(out) == 5 and all(abs(r.tail - 1 / 3) < 1e-9 for r in out)
    assert score(frame(spark, []), model, least=1).collect() == []
    twice = spark.createDataFrame([(1, 2), (1, 0), (None, 1), (3, None)], "doc_id long, grade int")
    fit(frame(spark, rows), twice, grades=3)


def test_one_grade_and_two(spark):
    slots = np.array([1, 2], np.int32)
    assert fit_rows([(0, slots)] * 5, 2, 18).grades(slots)[0] > 0.5


def loss(weights, cuts, rows, penalty):
    """The fitted likelihood, row by row: rows of a grade weigh the root of their number in total."""
    below = lambda k, x: 0.0 if k < 0 else 1.0 if k == len(cuts) else 1 / (1 + math.exp(x - cuts[k]))
    counts = {g: sum(h == g for h, _ in rows) for g, _ in rows}
    whole = sum(math.sqrt(c) for c in counts.values())
    total = penalty / 2 * sum(w * w for w in weights.values())
    for grade, slots in rows:
        x = sum(weights.get(s, 0.0) for s in slots.tolist())
        total -= math.log(below(grade, x) - below(grade - 1, x)) / math.sqrt(counts[grade]) / whole
    return total


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_optimiser(seed):
    """Steps along one coordinate after the other, halved when none helps, find no better model."""
    r = random.Random(seed)
    rows = []
    for k in range(240):
        grade = k % 3
        slots = {s for s, chance in ((10, (0.8, 0.3, 0.1)), (20, (0.1, 0.5, 0.3)), (30, (0.2, 0.3, 0.9))) if r.random() < chance[grade]}
        rows.append((grade, np.array(sorted(slots | {40 + k % 2}), np.int32)))
    model = fit_rows(rows, 3, 8, epochs=3000, penalty=1e-2)
    used = np.flatnonzero(model.weights).tolist()
    assert 10 in used and 30 in used
    of = lambda point: loss(dict(zip(used, point)), point[len(used) :], rows, 1e-2)
    point, step = [0.0] * len(used) + [-1.0, 1.0], 0.5
    best = of(point)
    while step > 1e-4:
        better = False
        for k in range(len(point)):
            for move in (step, -step):
                other = [x + move * (j == k) for j, x in enumerate(point)]
                if other[-2] < other[-1] and of(other) < best - 1e-12:
                    point, best, better = other, of(other), True
        step = step if better else step / 2
    got = [*model.weights[used].tolist(), *model.thresholds.tolist()]
    assert of(got) == pytest.approx(best, abs=1e-5) and got == pytest.approx(point, abs=0.05)


@pytest.mark.parametrize("n", [24, 45, 87])
def test_few_ratings_still_tell(spark, n):
    train, test = corpus(6, n), corpus(7, 90)
    model = fit(frame(spark, train), ratings(spark, train), grades=3)
    out = {r.doc_id: r.expected_grade for r in score(frame(spark, test), model, least=2).collect()}
    means = [np.mean([out[i] for i, _, g in test if g == k]) for k in range(3)]
    assert model.weights.any() and means[1] < means[2]


def test_a_rated_id_in_many_rows_counts_once(spark):
    rows = corpus(8, 60)
    once = fit(frame(spark, rows), ratings(spark, rows), grades=3)
    many = fit(frame(spark, rows + rows[:1] * 500), ratings(spark, rows), grades=3)
    assert np.array_equal(once.weights, many.weights)
