import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from timberline.llm import bloom_neighbours as bn
from timberline.llm.common import Scratch

DDL = "doc_id long, text string, word string, n int"


def is_near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = max(a, b, key=len), min(a, b, key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_words(rows, part=31):
    found = Counter()
    lower = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if part and h % part == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def plain(words):
    near, forms = defaultdict(list), {}
    ordered = sorted(words)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if is_near(a, b):
                near[a].append(b)
                near[b].append(a)
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v))
        forms[w] = best if words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while forms.get(root):
            root = forms[root]
        form = forms.get(w)
        out.append((w, form, root, n, len(near[w]), words[form] if form else None))
    return sorted(out)


def text_rows(seed):
    rng = random.Random(seed)
    letters = "abcdefgÀéÿ×"
    stems = ["".join(rng.choices(letters, k=rng.randrange(6, 14))) for _ in range(12)]
    rows = []
    for key in range(250):
        found = []
        for _ in range(40):
            word = stems[min(int(rng.expovariate(0.4)), 11)]
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(word))
                word = word[:k] + rng.choice(["", word[k], rng.choice(letters), rng.choice(letters) + word[k]]) + word[k + 1 :]
            found.append(word.capitalize() if rng.random() < 0.1 else word)
        rows.append((key if key else None, rng.choice([" ", "1", "Ā", "ß-"]).join(found), "x", 1))
    return [*rows, (7, None, None, None), (8, "", "x", 1), rows[3], rows[3]]


@pytest.mark.parametrize("slice_bytes", [bn.SLICE, 64, 200])
def test_against_all_pairs(spark, slice_bytes):
    rows = text_rows(3)
    words = plain_words(rows)
    assert 150 < len(words) < 3000
    counted = bn.counted(spark.createDataFrame(rows, DDL).repartition(6))
    assert {r.word: r.n for r in counted.collect()} == words
    expected = plain(words)
    found = bn.variants(counted, Scratch(spark), slice_bytes=slice_bytes if len(words) < 1500 else max(slice_bytes, 1000))
    assert sorted(map(tuple, found.select("word", "form", "root", "n", "n_near", "form_n").collect())) == expected
    assert any(r[1] and r[1] != r[2] for r in expected)


def test_counts_are_passed_on_in_parts(spark, monkeypatch):
    rows = text_rows(4)
    monkeypatch.setattr(bn, "HELD", 50)
    assert {r.word: r.n for r in bn.counted(spark.createDataFrame(rows, DDL), part=None).collect()} == plain_words(rows, None)


def test_hashes_follow_edits(monkeypatch):
    alphabet = np.array(sorted(map(ord, "abcdeé")), np.uint32)
    texts = ["abbéccd", "aaaaaaa", "edcbaab", "abc"]
    expected = set()
    for word in texts:
        expected |= {(word, word[:k] + word[k + 1 :]) for k in range(len(word))}
        expected |= {(word, word[:k] + chr(c) + word[k + 1 :]) for k in range(len(word)) for c in alphabet if chr(c) > word[k]}
    everything = {n: (np.full(8 * 10, (1 << 64) - 1, np.uint64), 0, 10) for n in (2, 3, 6, 7)}
    for most in (1, 40, 1 << 18):
        monkeypatch.setattr(bn, "EDITS", most)
        made = list(bn.edits_known(texts, alphabet, everything))
        assert len(made) == len(set(made)) and set(made) == expected
    # A filter of exactly one made word knows it by the hash of the whole word.
    for pair in expected:
        ((_, codes),) = bn.by_length([pair[1]])
        own = {len(pair[1]): (bn.filter_of(bn.word_hashes(codes), 0, 64, 64), 0, 64)}
        assert pair in set(bn.edits_known(texts, alphabet, own))


def test_very_long_word(spark):
    long = "x" * 30_000
    rows = [(long, 40), (long[1:], 3), ("y" + long[1:], 2), ("lonely words", 9)]
    found = bn.variants(spark.createDataFrame(rows, "word string, n long"), Scratch(spark)).collect()
    assert sorted((len(r.word), r.n, r.n_near, r.form_n) for r in found) == [(12, 9, 0, None), (29_999, 3, 2, 40), (30_000, 2, 2, 40), (30_000, 40, 2, None)]


def test_empty(spark):
    assert bn.variants(bn.counted(spark.createDataFrame([], DDL)), Scratch(spark)).collect() == []
    with pytest.raises(ValueError):
        bn.variants(spark.createDataFrame([], "word string, n long"), Scratch(spark), least_ratio=1)
