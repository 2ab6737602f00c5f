"""The stages against plain versions, on documents that repeat each other in many ways."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_cube_mixing import filled

R = random.Random(12)
VOCABULARY = [f"word{k}" for k in range(2500)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark string, row int"


def words(n):
    return R.choices(VOCABULARY, k=n)


def rows():
    out, passage = [], words(70)
    bases = [words(n) for n in (30, 80, 200)]
    for k in range(150):
        w = words(R.randrange(5, 160))
        kind = k % 6
        if kind == 0:
            w = list(bases[k % 3])
            w[k % 30] = f"edit{k}"
        if kind == 1:
            w = w[:40] + passage + w[40:]
        if kind == 2 and k % 4 == 0:
            w[0] = "vile"
        out.append((k, " ".join(w), "en", f"s{k % 5}", None, "m", 1))
    out += [(200, None, "en", None, None, "m", 1), (201, "", "en", "s1", 0, "m", 1), (None, "no id", None, None, 5, "m", 1)]
    return out + out[3:5] + out[-1:]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = rows()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int("vile" in t.split())) for i, t, *_ in docs if i is not None and t]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def stages(spark, tables, tmp_path_factory):
    docs, out = spark.read.parquet(f"{tables}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp(f"stage{k}") / "out")
        stage(spark, docs, tables).write.parquet(path)
        out.append((docs.collect(), spark.read.parquet(path).collect()))
        docs = spark.read.parquet(path)
    return out


def grams(text, n):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def test_columns(stages):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for _, after in stages[:-1]:
        assert list(after[0].asDict()) == names


def test_reject(stages):
    before, after = stages[0]
    kept = Counter(after)
    assert not kept - Counter(before)
    gone = [r for r in before if not kept[r]]
    assert all("vile" not in (r.text or "").split() for r in after) and {"vile" in (r.text or "").split() for r in gone} == {True}


def test_deduplicate(stages):
    before, after = stages[1]
    items = sorted(set(before), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    sets, root = [grams(r.text, 5) for r in items], list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert Counter(after) == Counter(items[k] for k in {find(i) for i in range(len(items))})


def test_cut_repeats(stages):
    before, after = stages[2]
    assert sorted(map(str, (r.doc_id for r in before))) == sorted(map(str, (r.doc_id for r in after)))
    left = [grams(r.text, 50) for r in after if len((r.text or "").split()) >= 50]
    assert sum(map(len, left)) == len(set().union(*left))
    shared = Counter(g for r in before for g in grams(r.text, 40))
    texts = {r.doc_id: r for r in after}
    for r in before:
        if all(shared[g] == 1 for g in grams(r.text, 40)):
            assert texts[r.doc_id].text == r.text
    assert all(r.n_chars == len(r.text) for r in after if r.text is not None)


def test_mix(stages):
    before, after = stages[3]
    size, taken = Counter(), Counter()
    for r in before:
        size[r.source] += len((r.text or "").split())
    for r in after:
        taken[r.source] += len((r.text or "").split())
    goals = filled(size)
    assert all(abs(taken[s] - goals[s]) <= 200 for s in size) and max(Counter(after).values()) <= 2


def test_pack(stages):
    before, after = stages[4]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter()
    for r in before:
        tokens[r.doc_id] += len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1
    packed, held = Counter(), Counter()
    for r in after:
        packed[r.doc_id] += r.length
        held[r.sequence_id] += r.length
    assert packed == tokens and max(held.values()) <= 1024
    assert len(held) <= np.ceil(sum(held.values()) / 1024) + 1


def test_run(spark, tables, stages):
    out = corpus_pipeline.run(spark, tables).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in out) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in stages[-1][1])
