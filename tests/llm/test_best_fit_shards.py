import zlib
from collections import defaultdict

import pytest

from timberline.llm.best_fit_shards import best_fit_decreasing, shard
from timberline.llm.common import Scratch

TEXTS = ["one", "two two", "", None, "one", "ünï", "x" * 3000, "one", *[f"text {k % 40} " * (k % 9 + 1) for k in range(300)]]


def docs(spark, texts):
    rows = [(k if k != 5 else None, t, "s", -1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, shard int")


def held(rows, texts):
    shards, homes = defaultdict(list), defaultdict(set)
    for r in rows:
        text = texts[5 if r.doc_id is None else r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        shards[r.shard].append(r)
        homes[text].add(r.shard)
    assert all(len(x) == 1 for x in homes.values())
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in shards.values())
    return {k: sum(r.size for r in x) for k, x in shards.items()}


def test_best_fit_takes_the_tightest_bin():
    place, bins = best_fit_decreasing([6, 5, 4, 3, 2], 10)
    assert bins == 2 and place == [0, 1, 0, 1, 1]
    assert best_fit_decreasing([], 10) == ([], 0)
    assert best_fit_decreasing([12, 1], 10)[1] == 2


def test_shards_are_even_and_groups_whole(spark):
    texts = [t for t in TEXTS if t is None or len(t) < 1000]
    rows = shard(docs(spark, texts), Scratch(spark), shards=4).collect()
    sizes = held(rows, texts)
    assert len(rows) == len(texts) and set(sizes) == set(range(4))
    largest = max(sum(len((t or "").encode()) + 1 for t in texts if t == u) for u in set(texts))
    assert max(sizes.values()) - min(sizes.values()) <= largest


@pytest.mark.parametrize("items", [16, 8192])
def test_given_capacity(spark, items):
    rows = shard(docs(spark, TEXTS), Scratch(spark), capacity=1000, items=items).collect()
    sizes = held(rows, TEXTS)
    if items == 8192:
        assert sorted(sizes.values())[-1] == 3001 and sorted(sizes.values())[-2] <= 1000
        assert len(sizes) <= 1.25 * sum(sizes.values()) / 1000 + 2


def test_empty_and_repeated(spark):
    assert shard(docs(spark, []), Scratch(spark), shards=3).collect() == []
    twice = docs(spark, ["a", "b"]).union(docs(spark, ["a", "b"]))
    assert sorted(r.slot for r in shard(twice, Scratch(spark), shards=1).collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        shard(twice, Scratch(spark))
