import random
import re

import numpy as np
import pytest

from timberline.llm import prefix_tree_join
from timberline.llm.common import Scratch, shingles, word_hashes
from timberline.llm.prefix_tree_join import join, least_shared, links, meeting_length


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def classes(items, linked):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


def similar(a, b, part=90, whole=100):
    return bool(a) and whole * len(a & b) >= part * len(a | b)


def plain(rows, **kw):
    sets = [grams(t) for _, t in rows]
    roots = classes(sets, lambda a, b: similar(a, b, **kw))
    least = {}
    for (id_, _), r in zip(rows, roots):
        if id_ is not None:
            least[r] = min(id_, least.get(r, id_))
    return [(id_, len(s), least.get(r)) for (id_, _), s, r in zip(rows, sets, roots)]


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = r.choices(vocabulary, k=60)
    rows = []
    for base in range(12):
        words = r.choices(vocabulary, k=r.choice([4, 9, 31, 70, 150, 400, 900]))
        rows += [edited(r, words, r.randrange(0, max(1, len(words) // 50) + 1)) for _ in range(12)]
        rows += [" ".join(words)] * 3 + [" ".join(words).upper()] + [" ".join(words[: len(words) * 95 // 100])]
    rows += [" ".join(r.choices(vocabulary, k=30) + passage + r.choices(vocabulary, k=30)) for _ in range(30)]
    rows += [None, "", " \n", "one", "One", "one two", "one two three", "É a b", "é a b", "a b c a b c a b c"]
    r.shuffle(rows)
    return [(k * 3 % 1009, t) for k, t in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(*x, 5, "m") for x in rows], "doc_id long, text string, n int, mark string")


KEY = {"key": lambda r: tuple((x is None, x or 0) for x in r)}


@pytest.mark.parametrize("seed, grams_per_block", [(1, 400_000), (2, 900), (3, 3000)])
def test_against_all_pairs(spark, monkeypatch, seed, grams_per_block):
    monkeypatch.setattr(prefix_tree_join, "BLOCK_GRAMS", grams_per_block)
    rows = corpus(seed) + [(None, "null id here"), (None, "null id here"), (7, "same id"), (7, "other text for it")]
    out = [tuple(r) for r in join(frame(spark, rows).repartition(3), Scratch(spark)).collect()]
    assert sorted(out, **KEY) == sorted(plain(rows), **KEY)


def test_another_threshold(spark):
    rows = corpus(9)[:120]
    out = [tuple(r) for r in join(frame(spark, rows), Scratch(spark), part=50).collect()]
    assert sorted(out, **KEY) == sorted(plain(rows, part=50), **KEY)


def test_empty(spark):
    assert join(frame(spark, []), Scratch(spark)).collect() == []
    assert sorted(tuple(r) for r in join(frame(spark, [(1, None), (2, "")]), Scratch(spark)).collect()) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("part", [90, 60])
def test_tree_finds_every_link(seed, part):
    r = random.Random(seed)
    sets = []
    for _ in range(60):
        base = set(range(r.randrange(5) * 100, r.randrange(5) * 100 + 120)) or {1}
        sets.append(frozenset(x for x in base if r.random() < 0.97) | {r.randrange(10**6) for _ in range(r.randrange(8))})
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    for sides in ([0] * 60, [k % 2 for k in range(60)]):
        found = links(arrays, list(range(60)), sides, part, 100)
        assert all(similar(sets[a], sets[b], part) for a, b in found)
        allowed = {(a, b) for a in range(60) for b in range(60) if len(set(sides)) == 1 or sides[a] != sides[b]}
        index = list(range(60))
        want = classes(index, lambda a, b: (a, b) in allowed and similar(sets[a], sets[b], part))
        got = classes(index, lambda a, b: (a, b) in set(found) or (b, a) in set(found))
        assert len({(x, y) for x, y in zip(want, got)}) == len(set(want)) == len(set(got))


def test_bounds():
    assert meeting_length(90, 100) == 16 and 25 < least_shared(1000, 90, 100) < 40
    assert least_shared(50, 90, 100) == 45 and least_shared(1, 90, 100) == 1


def test_nothing_shared_where_sets_meet(spark):
    """A long text whose first n-grams are its own, though many of those after them stand in another text too."""
    r = random.Random(5)
    words = [f"w{r.randrange(10**9)}" for _ in range(1500)]
    hashes = shingles(word_hashes([w.encode() for w in words]), 3)
    own = {k + 1 for k in np.argsort(hashes)[: meeting_length(90, 100)].tolist()}
    rows = [(1, " ".join(words)), (2, " ".join(w for k, w in enumerate(words[:1300]) if k not in own))]
    found = join(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()
    assert sorted(found) == plain(rows)
