import os
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from timberline.llm import best_fit_packing
from timberline.llm.best_fit_packing import Encoder, pack, plan
from timberline.llm.best_fit_shards import best_fit_decreasing
from timberline.llm.common import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)
RANKS = Encoder(PATH, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def ids(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab'st1 \n\t\r.,!é<|>\u00a0\u2003\u3000\x1c\x85\x0b\x0c", "<|endoftext|>", "  "]), max_size=40))
def test_chunks_encode_like_the_whole(parts):
    text = "".join(parts)
    assert np.frombuffer(ENCODER([text])[0], "<u4").tolist() == ids(text)
    assert np.frombuffer(RANKS([text])[0], "<u4").tolist() == ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_like_the_whole(text):
    assert np.frombuffer(RANKS([text])[0], "<u4").tolist() == ids(text)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the driver tables")
def test_documents_encode_like_the_whole():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()[:300]
    assert [np.frombuffer(x, "<u4").tolist() for x in RANKS(texts)] == [ids(t) for t in texts]


def test_few_words_and_no_long_chunks_are_remembered(monkeypatch):
    monkeypatch.setattr(best_fit_packing, "CACHE", 100)
    encode = Encoder(PATH, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = [" ".join(f"w{k}x{n}" for n in range(90)) for k in range(30)]
    texts += [f"long{k}" * 500 + end for k in range(20) for end in ("", "\u00a0whole text", " \u4e2d\u6587" * 9)]
    for some in (texts, texts[::-1], texts[:1] * 2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(some)] == [ids(t) for t in some]
        assert len(encode.known) <= 100 and sum(map(len, encode.known)) < 5000


def bins(histogram, capacity):
    made = plan(histogram, capacity)
    held = Counter()
    for times, used in made:
        assert times > 0 and sum(used) <= capacity
        for n in used:
            held[n] += times
    assert held == Counter({n: c for n, c in histogram.items() if c})
    return sum(times for times, _ in made)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_as_good_as_best_fit(seed):
    r = random.Random(seed)
    histogram = {n: r.randrange(0, 40) for n in range(1, 101 if seed % 2 else 60)}
    made = bins(histogram, 100)
    assert made <= best_fit_decreasing([n for n, c in histogram.items() for _ in range(c)], 100)[1]
    if seed % 2 == 0:
        assert made <= 1.01 * sum(n * c for n, c in histogram.items()) / 100 + 1


def test_large_pieces_are_matched():
    assert bins({60: 3, 40: 2, 39: 1}, 100) == 3
    assert bins({50: 5}, 100) == 3
    assert bins({55: 2, 46: 2, 40: 2}, 100) == 3
    assert bins({}, 100) == 0 and bins({100: 7}, 100) == 7


def test_pack(spark):
    texts = ["", None, "one two", "wörd " * 30, "a" * 300, "x y z\n" * 40, " lead", "trail ", "<|endoftext|>"] * 3
    rows = [(None if k == 3 else k // 2, t, 1) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    out = pack(frame, Scratch(spark), PATH, capacity=32).collect()
    expected = Counter()
    for id_, text, _ in rows:
        own = ids(text or "") + [2]
        first = (len(own) - 1) % 32 + 1
        cuts = [0, *range(first, len(own) + 1, 32)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[id_, k, a, b - a, crc32(np.array(own[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 32
    assert pack(frame.limit(0), Scratch(spark), PATH).collect() == []
