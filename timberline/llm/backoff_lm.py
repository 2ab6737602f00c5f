"""LM scoring by a weighted backoff automaton.

States are the runs of up to ``order - 1`` words seen in training, and one without
context. That one holds words with a discount: P(w) = (c(w) - d) / N, and what the
discounts free goes to the words never seen. A state h has an arc for each word that
followed it, weighing log10 of q * P(w | h') + (1 - q) * (c(hw) + k * P(w | h')) / (c(h) + k),
where h' is h without its first word, and a failure arc to h', weighing log10 of
q + (1 - q) * k / (c(h) + k). So each state's arcs, those reached by failure included,
add up to 1. A text is read once, left to right: the state is the longest seen run
that ends at the word before; failure arcs are followed one after the other until a
state has an arc for the next word, and their weights and the arc's add up.

The automaton is as large as the corpus, so it is never in one place. Documents are
dealt into blocks of bounded bytes; a block asks for the counts of the runs that it
holds, buckets of the key space add up what all blocks have, and the answers make up
the part of the automaton that the block's texts walk through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import (
    BLOCK_DDL,
    Scratch,
    answered,
    binary,
    block_rows,
    bucket_bits,
    by_block,
    mix,
    pack,
    spans,
    totals_of,
    unpack,
    word_hashes,
    words,
)

ADDED = 0.1  # Fixed value.
PRIOR = 4.0  # k
PLAIN = 0.5  # q
ORDER = 3  # words in the longest run
TURNS = 2
BLOCK_BYTES = 8 << 20
_END = word_hashes([b"\n"])  # white space is never a word
_RUN, _WORD = np.uint64(1), ~np.uint64(1)


def keys_of(vocabulary: np.ndarray, tokens: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys of a block, and for each length up to ``order`` the key's place of the run that ends at each token.

    Tokens are numbers of words in the vocabulary; the last of each text is the end,
    which is also what stands before the next text. A run starts no earlier than with
    that end; where it would, its place is -1. Keys of words are even, of longer runs odd.
    """
    end = np.searchsorted(vocabulary, _END[0])
    before, own = np.concatenate([[end], tokens[:-1]]), vocabulary[tokens]
    start, there = before == end, np.ones(len(tokens), bool)
    context, run = mix(vocabulary)[before], own
    raw, ends = [vocabulary & _WORD], []
    for length in range(2, order + 1):
        if length > 2:  # before the first token of a text stands an end, and before that nothing
            context, there = np.concatenate([run[:1], run[:-1]]), ~start & np.concatenate([[False], there[:-1]])
        run = mix(context * np.uint64(3) + own)
        raw.append(run[there] | _RUN)
        ends.append(np.flatnonzero(there))
    keys, at = np.unique(np.concatenate(raw), return_inverse=True)
    single, *longer = np.split(at, np.cumsum([len(r) for r in raw])[:-1])
    places = [single[tokens]]
    for here, found in zip(ends, longer):
        places.append(np.full(len(tokens), -1, np.int64))
        places[-1][here] = found
    return keys, places


def _payloads(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple]:
    """(ids, held, lengths, vocabulary, tokens) of texts of bounded bytes."""
    for whole in batches:
        for batch in spans(whole, "text", block_bytes):
            texts = [words(t) for t in binary(batch, "text")]
            lengths = np.array([len(t) + 1 for t in texts])
            ends = np.cumsum(lengths)
            hashes = np.empty(ends[-1], np.uint64)
            inner = np.ones(len(hashes), bool)
            inner[ends - 1] = False
            hashes[ends - 1] = _END
            hashes[inner] = word_hashes([w for t in texts for w in t])
            vocabulary, tokens = np.unique(hashes, return_inverse=True)
            held = np.array(batch.column("held").to_pylist(), bool)
            yield batch.column("_id").to_pylist(), held, lengths, pack(vocabulary, True), pack(tokens.astype(np.uint32))


def counts_of(payload: tuple, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a block, and how often each occurs in its training texts."""
    _, held, lengths, vocabulary, tokens = payload
    keys, places = keys_of(unpack(vocabulary), unpack(tokens), order)
    trained, counts = np.repeat(~held, lengths), np.zeros(len(keys), np.int64)
    for at in places:
        counts += np.bincount(at[trained & (at >= 0)], minlength=len(keys))
    return keys, counts


def walk(payload: tuple, totals: np.ndarray, training: tuple[int, int, int, int], order: int, prior: float, plain: float) -> tuple[np.ndarray, ...]:
    """(words and end, known, base score, score) of each text of a block.

    ``training`` is the number of tokens, of words among them, and of words seen once and twice.
    The states of all places of a text are known from its words, so their steps are taken together.
    """
    _, _, lengths, vocabulary, tokens = payload
    vocabulary, tokens = unpack(vocabulary), unpack(tokens)
    _, places = keys_of(vocabulary, tokens, order)
    everything, distinct, once, twice = training
    end = np.flatnonzero(tokens == np.searchsorted(vocabulary, _END[0]))[:1]  # the place of an end
    seen = totals[places[0]]
    base = np.log10((seen + ADDED) / (everything + ADDED * (distinct + 1)))
    discount = once / (once + 2 * twice) if once and twice else 0.5
    unseen = discount * distinct / everything if everything else 1.0
    chance = np.where(seen > 0, (seen - discount) / max(everything, 1), unseen)
    step = np.log10(chance)
    for length in range(2, order + 1):
        at, state = places[length - 1], np.roll(places[length - 2], 1)  # what stands before the first token is an end
        if length == 2:
            state[0] = places[0][end[0]]
        there = at >= 0
        together, left = totals[at[there]], totals[state[there]]
        arc = plain * chance[there] + (1 - plain) * (together + prior * chance[there]) / (left + prior)
        fail = np.log10(plain + (1 - plain) * prior / (left + prior))
        chance[there] = arc
        step[there] = np.where(together > 0, np.log10(arc), fail + step[there])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    known = np.add.reduceat((seen > 0).astype(np.int64), starts)
    return lengths, known, np.add.reduceat(base, starts), np.add.reduceat(step, starts)


def score(
    docs: DataFrame,
    scratch: Scratch,
    held_out: Column,
    prior: float = PRIOR,
    plain: float = PLAIN,
    order: int = ORDER,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows where ``held_out`` is false (null counts as false) and scores
    all. A null text counts as empty: its one token is the end. Null and repeated ids
    are rows like any other; an empty table gives an empty result, and without
    training rows every word is the one unseen word. ``order`` is at least 1. Other columns are ignored, whatever
    their names. Words are compared by 64-bit hashes.
    """
    source = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    size = source.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    bits = bucket_bits(size * order // 8)  # about a third as many words as bytes, and some runs occur again
    blocks = scratch.keep(source.mapInArrow(lambda batches: block_rows(_payloads(batches, block_bytes)), BLOCK_DDL), "blocks")

    def summary(keys: np.ndarray, totals: np.ndarray) -> list[int]:
        own = totals[keys & _RUN == 0]
        return [int(own.sum()), *(int(np.sum(x)) for x in (own > 0, own == 1, own == 2))]

    # What the blocks ask for is three times the input, so it is shuffled in turns.
    turns = [scratch.keep(totals_of(blocks, lambda payload: counts_of(payload, order), bits, summary, (k, TURNS)), f"totals-{k}") for k in range(TURNS)]
    answers = reduce(DataFrame.unionAll, turns)
    sums = [unpack(r.totals) for r in answers.filter("block IS NULL").select("totals").collect()]  # one for each bucket
    training = tuple(int(x) for x in np.sum([np.zeros(4, np.uint64), *sums], axis=0))
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for payload, totals in by_block(batches):
            n, known, base, own = walk(payload, totals, training, order, prior, plain)
            ids = pa.array(payload[0], pa.string() if kind == "string" else pa.int64() if kind == "bigint" else None)
            columns = [ids, pa.array(payload[1]), *map(pa.array, (n, known, np.full(len(n), training[0]), base, own))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    columns = f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answered(blocks, answers).mapInArrow(run, columns).withColumnRenamed("_id", id_col)
