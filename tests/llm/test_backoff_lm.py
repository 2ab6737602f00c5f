import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from timberline.llm import common
from timberline.llm.backoff_lm import ORDER, PLAIN, PRIOR, score
from timberline.llm.common import Scratch

HELD = "crc32(cast(doc_id AS string)) % 10 = 0"


def tokens(text):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, held int")


class Counted:
    """The model from plain counts: each longer context leans on the one without its first word."""

    def __init__(self, texts, order=ORDER):
        self.order, self.runs = order, [Counter() for _ in range(order + 1)]
        for t in texts:
            padded = [None, *t]  # an end stands before each text
            self.runs[1].update((w,) for w in t)
            for n in range(2, order + 1):
                self.runs[n].update(tuple(padded[k : k + n]) for k in range(len(padded) - n + 1))
        single = self.runs[1]
        self.n, self.v = sum(single.values()), len(single)
        some = Counter(single.values())
        self.d = some[1] / (some[1] + 2 * some[2]) if some[1] and some[2] else 0.5

    def base(self, w):
        return (self.runs[1][w,] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def q(self, before, w):
        before = tuple(before)[-(self.order - 1) :] if self.order > 1 else ()
        if not before:
            c = self.runs[1][w,]
            return (c - self.d) / self.n if c else self.d * self.v / self.n
        less = self.q(before[1:], w)
        together, left = self.runs[len(before) + 1][(*before, w)], self.runs[len(before)][before]
        return PLAIN * less + (1 - PLAIN) * (together + PRIOR * less) / (left + PRIOR)


def plain(rows, order=ORDER):
    held = [i is not None and crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    texts = [tokens(t) for _, t in rows]
    m = Counted([t for h, t in zip(held, texts) if not h], order)
    out = []
    for (id_, _), h, t in zip(rows, held, texts):
        known = sum(m.runs[1][w,] > 0 for w in t)
        base, own = sum(math.log10(m.base(w)) for w in t), sum(math.log10(m.q([None, *t[:k]], w)) for k, w in enumerate(t))
        out.append((id_, h, len(t), known, m.n, base, own))
    return out


@pytest.mark.parametrize("block_bytes, order", [(200, 3), (1 << 20, 3), (200, 1), (1000, 2), (500, 5)])
def test_against_counts(spark, monkeypatch, block_bytes, order):
    monkeypatch.setattr(common, "BUCKET_KEYS", 50)
    r = random.Random(5)
    vocabulary = ["The", "the", "a", "É", "é", "x" * 300, "end.", " ", *(f"w{k}" for k in range(60))]
    rows = [(k, " ".join(r.choices(vocabulary, k=r.randrange(0, 40)))) for k in range(150)]
    rows += [(None, "null id"), (3, "the\tthe\nthe"), (3, "the\tthe\nthe"), (700, None), (701, "  "), (20, "never seen 123")]
    out = score(frame(spark, rows), Scratch(spark), F.expr(HELD), order=order, block_bytes=block_bytes).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[2], x[5])
    for got, want in zip(sorted(map(tuple, out), key=key), sorted(plain(rows, order), key=key), strict=True):
        assert got[:5] == want[:5]
        assert got[5] == pytest.approx(want[5]) and got[6] == pytest.approx(want[6])


def test_arcs_add_up(spark):
    rows = [(k, t) for k, t in zip((1, 2, 4), ("a b a b c", "b a", "c"))]
    words = ["a", "b", "c", "unknown"]
    probes = [(10**6 + k, f"a {w}") for k, w in enumerate(words)] + [(10**7, "a")]
    held = F.col("doc_id") >= 10**6
    out = {r.doc_id: r for r in score(frame(spark, rows + probes), Scratch(spark), held).collect()}
    m = Counted([tokens(t) for _, t in rows])
    for before in (("a",), ("a", "b"), (None, "a"), ("c", "b"), (None,), ("unknown", "a")):
        assert sum(m.q(before, w) for w in [*words, None]) == pytest.approx(1)
    for k, w in enumerate(words):
        assert out[10**6 + k].score == pytest.approx(math.log10(m.q([None], "a") * m.q([None, "a"], w) * m.q(["a", w], None)))


def test_held_out_text_is_likelier_than_at_the_base(spark):
    r = random.Random(2)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(20_000)]
    rows = [(k, " ".join(vocabulary[at : at + 60])) for k in range(600) for at in [r.randrange(0, 19_900)]]
    out = [x for x in score(frame(spark, rows), Scratch(spark), F.expr(HELD)).collect() if x.held_out]
    assert len(out) > 30 and sum(x.score > x.base_score for x in out) >= 0.8 * len(out)
    assert sum(x.score for x in out) > sum(x.base_score for x in out)


def test_empty(spark):
    assert score(frame(spark, []), Scratch(spark), F.expr(HELD)).collect() == []
    (r,) = score(frame(spark, [(1, "a")]), Scratch(spark), F.lit(True)).collect()
    assert (r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def test_counts_in_turns(spark):
    rows = [(k, " ".join(f"w{(k * j) % 50}" for j in range(40))) for k in range(60)]
    scratch = Scratch(spark)
    score(spark.createDataFrame(rows, "doc_id long, text string"), scratch, F.col("doc_id") % 10 == 0).count()
    buckets = [{r.bucket for r in spark.read.parquet(path).select("bucket").collect()} for name, path in scratch.paths.items() if name.startswith("totals")]
    assert len(buckets) == 2 and all(buckets) and not buckets[0] & buckets[1]
