import hashlib
import random

import pytest

from timberline.llm.piecewise_hash import common_subsequence, compare_edits, fingerprint, fingerprints, likeness


def lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_common_subsequence():
    r = random.Random(3)
    for _ in range(200):
        a, b = ("".join(r.choices("abcd", k=r.randrange(0, 40))) for _ in range(2))
        assert common_subsequence(a, b) == lcs(a, b)


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(n))


@pytest.mark.parametrize("n", [20, 200, 3000])
def test_likeness_follows_shared_text(n):
    a, b = words(1, n), words(2, n)
    half = a[: len(a) // 2] + b[len(b) // 2 :]
    assert likeness(fingerprint(a.encode()), fingerprint(a.encode())) == 1
    assert likeness(fingerprint(a.encode()), fingerprint(half.encode())) > 0.3
    assert likeness(fingerprint(a.encode()), fingerprint((a[:50] + a[57:]).encode())) > 0.8
    assert likeness(fingerprint(a.encode()), fingerprint(b.encode())) < 0.2


def test_odd_texts():
    assert fingerprint(b"") == "1::" and likeness("1::", "1::") == 1.0
    for data in (b"a", b"a" * 100_000, b"ab" * 50_000, bytes(range(256)) * 100, b"\x00"):
        size, one, two = fingerprint(data).split(":")
        assert len(one) <= 130 and len(two) <= 130 and int(size) >= 1
        assert likeness(fingerprint(data), fingerprint(b"")) == 0.0


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, id string")


@pytest.mark.parametrize("parts", [1, 7])
def test_next_document(spark, parts, monkeypatch):
    rows = [(k * k, (words(k, k % 50) + "é")[: None if k % 5 else 0]) for k in range(120)]
    rows += [(None, "no id"), (None, None), (49, "again"), (49, "again"), (10**17 + 1, "far"), (10**17, "far too")]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    import timberline.llm.piecewise_hash as m

    size = sum(len((t or "").encode()) for _, t in rows)
    monkeypatch.setattr(m, "LEAST_RANGES", parts)
    monkeypatch.setattr(m, "in_ranges", lambda d, real=m.in_ranges, **k: real(d, per_task=-(-size // parts), **k))
    out = sorted(tuple(r) for r in compare_edits(frame(spark, rows).repartition(5)).select("doc_id", "n_chars", "edited_sha256").fillna(-1, ["doc_id"]).collect())
    expected = []
    for (id_, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, cut = text or "", len(text or "") // 3
        edited = text[: len(text) - cut] + (after or "")[:cut]
        expected.append((-1 if id_ is None else id_, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert out == sorted(expected)


def test_empty_and_single(spark):
    assert compare_edits(frame(spark, [])).collect() == []
    (r,) = compare_edits(frame(spark, [(1, "abc def ghi")])).collect()
    assert (r.n_chars, r.near_next) == (11, 1.0)
    out = fingerprints(frame(spark, [(1, "x"), (2, None), (None, "x")])).collect()
    assert out[0].fingerprint == out[2].fingerprint and out[1].n_chars == 0
