import random
import re

import numpy as np
import pyarrow as pa
import pytest

from timberline.llm import common
from timberline.llm import compact_windows as compact_windows_module
from timberline.llm.common import Scratch
from timberline.llm.compact_windows import _earlier, _without, compact_windows, repeats, run_hashes, run_starts, without_repeats



def alike(a, b, least):
    if min(len(a), len(b)) < least:
        return []
    return compact_windows_module.alike(*(compact_windows_module.side(x, least) for x in (a, b)), least)


R = random.Random(4)
VOCABULARY = [f"w{k}" for k in range(4000)]


def text(r, n):
    return r.choices(VOCABULARY, k=n)


@pytest.mark.parametrize("ties", [10**9, 6])
def test_windows_hold_every_stretch_once(ties):
    r = random.Random(2)
    for n in (0, 3, 10, 60, 200):
        h = np.array([r.randrange(ties) for _ in range(n)], np.uint64)
        windows = compact_windows(h, 8).tolist()
        for i in range(n):
            for j in range(i + 8, n + 1):
                held = [c for a, c, b in windows if a <= i <= c < j <= b]
                assert held == [i + int(h[i:j].argmin())]


def test_a_run_lies_in_each_passage():
    for least in (46, 20):
        for centre in range(60, 60 + least):
            starts = run_starts(np.array([centre]), 300, least)
            # The passage 60 .. 60 + least has this centre.
            assert any(60 <= s and s + least - 8 <= 60 + least for s in starts.tolist())


def test_equal_runs_have_equal_hashes():
    a = np.array([R.randrange(2**64) for _ in range(100)], np.uint64)
    b = np.concatenate([a[50:60], a[:40], a[3:5]])
    assert run_hashes(a, np.array([0, 7]), 30)[1] == run_hashes(b, np.array([17, 0]), 30)[0]
    assert len(set(run_hashes(a, np.arange(71), 30).tolist())) == 71


def test_alike():
    a = np.arange(100, 180, dtype=np.uint64)
    b = a.copy()
    b[[20, 50]] = 7
    assert alike(a, b, 46) and not alike(a, a[::-1].copy() + np.uint64(500), 46) and alike(a[:40], a, 46) == []
    c = a.copy()
    c[::5] = 9
    assert alike(a, c, 46) == []


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("repeated", [False, True])
def test_alike_against_all_starts_and_offsets(seed, repeated):
    r = random.Random(seed)
    for _ in range(30):
        a = [r.randrange(15 if repeated else 10**9) for _ in range(r.randrange(6, 40))]
        b = [x for x in a if r.random() < 0.95] + [r.randrange(10**9) for _ in range(r.randrange(6))]
        want = set()
        for i in range(len(a) - 7):
            for j in range(len(b) - 7):
                p, q = set(a[i : i + 8]), set(b[j : j + 8])
                if 100 * len(p & q) >= 80 * len(p | q):
                    want.add((i, i + 8))
        assert set(alike(np.array(a, np.uint64), np.array(b, np.uint64), 8)) == want


def test_a_text_of_one_word_is_quick():
    windows = compact_windows(np.zeros(400_000, np.uint64), 46)
    assert len(windows) == 400_000 - 45 and windows[-1].tolist() == [400_000 - 46, 400_000 - 46, 400_000]


def frame(spark, rows):
    return spark.createDataFrame([(*x, "en", "r", 1) for x in rows], "doc_id long, text string, lang string, row string, start int")


def grams(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_long_passage_is_found(spark, monkeypatch, seed):
    monkeypatch.setattr(common, "BUCKET_KEYS", 500)
    r = random.Random(seed)
    passages = [text(r, n) for n in (50, 50, 51, 55, 60, 90, 130)]
    short = [text(r, n) for n in (20, 35, 41)]
    rows, held = [], {}
    for k in range(60):
        words = text(r, r.randrange(0, 150))
        for p in r.sample(range(len(passages)), r.choice([0, 0, 1, 2])):
            words += passages[p] + text(r, r.randrange(0, 90))
            held.setdefault(p, []).append(k * 2)
        words += r.choice(short) + text(r, r.randrange(0, 60))
        rows.append((k * 2, " \n".join(words) if k % 2 else " ".join(words)))
    rows += [(1000 + k, t) for k, t in enumerate((None, "", "few words"))]
    out = repeats(frame(spark, rows).repartition(3), Scratch(spark), block_bytes=3000).collect()
    known = {i: (t or "").split() for i, t in rows}
    pairs = {(o.doc_id, o.first_id) for o in out}
    for p, ids in held.items():
        for later in ids[1:]:
            assert (later, ids[0]) in pairs
            covered = set()
            for o in out:
                if o.doc_id == later:
                    covered |= set(range(o.start, o.stop))
            at = next(i for i in range(len(known[later])) if known[later][i : i + len(passages[p])] == passages[p])
            assert len(covered & set(range(at, at + len(passages[p])))) >= len(passages[p]) - 16
    for o in out:  # nothing else is found: a near repeat may reach some words past what is equal
        own, first = grams(known[o.doc_id][o.start : o.stop], 5), grams(known[o.first_id], 5)
        assert o.first_id < o.doc_id and o.stop - o.start >= 42 and len(own & first) >= 0.75 * len(own)
    cut = {x.doc_id: x for x in without_repeats(frame(spark, rows), Scratch(spark), block_bytes=3000).collect()}
    assert len(cut) == len(rows) and cut[1000].text is None and cut[0].text == rows[0][1] and cut[0].lang == "en"
    left = [grams((cut[i].text or "").split(), 50) for i, _ in rows]
    assert sum(map(len, left)) == len(set().union(*left))


def test_near_passages(spark):
    r = random.Random(8)
    base = text(r, 120)
    rows = [(0, " ".join(text(r, 80) + base + text(r, 80)))]
    for k in range(1, 25):
        words = list(base)
        for at in range(15 + k % 7, 120, 40):
            words[at] = f"new{k}"
        rows.append((k, " ".join(text(r, 60) + words + text(r, 40))))
    rows += [(100 + k, " ".join(text(r, 200))) for k in range(20)]
    out = repeats(frame(spark, rows), Scratch(spark)).collect()
    assert {o.doc_id for o in out} == set(range(1, 25))


@pytest.mark.parametrize("held", ["passage", "text", "twice"])
def test_near_passages_of_repeated_originals(spark, held):
    r = random.Random(8)
    base = text(r, 120)
    first = text(r, 80) + base + text(r, 80)
    if held == "twice":
        rows = [(0, " ".join(first + base + text(r, 80)))]
    else:
        rows = [(0, " ".join(first)), (1, " ".join(first if held == "text" else text(r, 70) + base + text(r, 90)))]
    for k in range(2, 26):
        words = list(base)
        for at in range(15 + k % 7, 120, 40):
            words[at] = f"new{k}"
        rows.append((k, " ".join(text(r, 60) + words + text(r, 40))))
    # A copy of an edited text has the same repeats as that.
    rows.append((50, rows[-1][1]))
    out = repeats(frame(spark, rows), Scratch(spark)).collect()
    near = {o.doc_id: (o.start, o.stop) for o in out if o.first_id == 0}
    assert set(near) >= set(range(2, 26)) and near[50] == near[25]


@pytest.mark.parametrize("members", [5, 2048])
def test_near_passages_around_a_common_phrase(spark, monkeypatch, members):
    monkeypatch.setattr(compact_windows_module, "MEMBERS", members)
    r = random.Random(3)
    phrase = text(r, 36)
    rows = [(0, " ".join(text(r, 80) + phrase + text(r, 80)))]
    for k in range(1, 41):
        own = text(r, 12) + phrase + text(r, 12)
        rows.append((k, " ".join(text(r, 60) + own + text(r, 60))))
        own[30] = f"new{k}"
        rows.append((100 + k, " ".join(text(r, 60) + own + text(r, 60))))
    out = repeats(frame(spark, rows), Scratch(spark)).collect()
    pairs = {(o.doc_id, o.first_id) for o in out}
    assert pairs <= {(100 + k, k) for k in range(1, 41)} and len(pairs) >= 38


@pytest.mark.parametrize("seed", range(4))
def test_earlier_against_all_pairs(seed):
    r = np.random.default_rng(seed)
    line, items = r.integers(0, 1 << 62, 30), []
    bases = [np.concatenate([r.integers(0, 1 << 62, 13), line, r.integers(0, 1 << 62, 13)]) for _ in range(8)]
    for k in range(60):
        own = bases[r.integers(8)].copy()
        own[r.integers(0, len(own), r.integers(0, 9))] = r.integers(0, 1 << 62)
        items.append(((int(r.integers(0, 30)), int(r.integers(0, 1 << 40)), k), own.astype(np.uint32).tobytes()))
    order = sorted(range(60), key=lambda k: items[k][0])
    want = {}
    for p, k in enumerate(order):
        for e in order[:p]:
            if alike(np.frombuffer(items[k][1], np.uint32), np.frombuffer(items[e][1], np.uint32), 46):
                want[k] = e
                break
    assert {k: q for k, q, _ in _earlier(items, 46)} == want


def test_near_recall(spark):
    """Passages of 54 words with one to three words changed, as long as a stretch of them reaches 0.8; figures stand in the README."""
    r = random.Random(12)
    rows, wanted = [], {}
    for k in range(150):
        base = text(r, 54)
        edited = list(base)
        for at in r.sample(range(54), 1 + k % 3):
            edited[at] = f"new{k}"
        rows.append((k, " ".join(text(r, 60) + base + text(r, 60))))
        rows.append((1000 + k, " ".join(text(r, 60) + edited + text(r, 60))))
        a, b = ([hash(tuple(w[i : i + 5])) & (1 << 63) - 1 for i in range(50)] for w in (base, edited))
        if alike(np.array(b, np.uint64), np.array(a, np.uint64), 46):
            wanted.setdefault(k % 3, set()).add((1000 + k, k))
    pairs = {(o.doc_id, o.first_id) for o in repeats(frame(spark, rows), Scratch(spark)).collect()}
    found = {edits: len(pairs & want) / len(want) for edits, want in wanted.items()}
    assert len(pairs) >= 0.9 * len(set().union(*wanted.values())) and pairs <= {(1000 + k, k) for k in range(150)}, found


def test_lines_that_repeat(spark):
    """A text of one line over and over has a row for each key, and its near copy is found all along."""
    r = random.Random(2)
    line = text(r, 9)
    first, second = line * 400, line * 300
    second[450] = "other"
    out = repeats(frame(spark, [(1, " ".join(first)), (2, " ".join(text(r, 30) + second))]), Scratch(spark)).collect()
    covered = set()
    for o in out:
        assert (o.doc_id, o.first_id) == (2, 1)
        covered |= set(range(o.start, o.stop))
    assert len(covered) >= 2700 - 16


def test_odd_rows(spark):
    assert repeats(frame(spark, []), Scratch(spark)).collect() == []
    words = " ".join(text(random.Random(1), 80))
    rows = [(5, words), (5, words), (7, words + " more"), (None, words), (2, "x " * 5000)]
    out = {(o.doc_id, o.first_id) for o in repeats(frame(spark, rows), Scratch(spark)).collect()}
    assert out == {(7, 5), (None, 5)}
    left = without_repeats(frame(spark, rows), Scratch(spark)).collect()
    assert sorted(len((x.text or "").split()) for x in left)[2:] == [80, 80, 5000]


def test_without():
    assert _without("a b  c\nd é", [{"start": 1, "stop": 2}], 1) == "a c\nd é"
    assert _without(" a b", [{"start": 0, "stop": 1}, {"start": 1, "stop": 2}], 1) == " "


@pytest.mark.parametrize("seed", range(3))
def test_parts_against_each_part_alone(seed, monkeypatch):
    monkeypatch.setattr(compact_windows_module, "TILE", 8)
    r, found = np.random.default_rng(seed), 0
    for _ in range(150):
        least, words_ = int(r.integers(9, 20)), int(r.choice([15, 40, 100_000]))
        base = r.integers(0, words_, int(r.integers(2 * least, 90))).astype(np.uint32)

        def parts():
            own = base.copy()
            own[r.integers(0, len(own), int(r.integers(0, 6)))] = r.integers(200_000, 1 << 31)
            own, at = np.roll(own, int(r.integers(0, 3))), int(r.integers(0, len(own)))
            return [p for p in (own[:at], own[at:]) if len(p) >= least]

        def sides(all_):
            grams = np.concatenate(all_)
            return grams, np.cumsum([0, *map(len, all_)]), compact_windows_module._distinct(grams, least), np.unique(grams)

        one, two, want, at = parts(), parts(), set(), 0
        for a in one:
            want |= {at + s for b in two for s, _ in alike(a, b, least)}
            at += len(a)
        assert compact_windows_module.alike_parts(sides(one), sides(two), least).tolist() == sorted(want)
        found += bool(want)
    assert found > 50


def test_a_text_goes_to_a_group_once(spark, monkeypatch):
    r, rows = random.Random(8), []
    passage = text(r, 400)
    for k in range(6):
        own = list(passage)
        own[60 * k + 30] = f"changed{k}"
        rows.append((k, " ".join(own)))
    sent, keep = {}, Scratch.keep

    def kept(self, df, name):
        out = keep(self, df, name)
        sent[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", kept)
    found = repeats(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()
    assert {f.doc_id for f in found} == set(range(1, 6))
    # Not a row for each key: each text has dozens, with few first texts.
    assert sent["near-texts"] <= 36


def test_shuffle_files_go_with_the_write(spark, monkeypatch):
    scratch, seen = Scratch(spark), []
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    df = spark.range(9)
    df = df.mapInArrow(lambda batches: batches, "id long")
    writer, before = type(df.write), spark.conf.get(name)
    write = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, path: (seen.append(spark.conf.get(name)), write(self, path))[1])
    assert scratch.keep(df, "few").count() == 9
    assert seen == ["true"] and spark.conf.get(name) == before


def test_a_run_of_one_word_is_one_row(spark, monkeypatch):
    r, sent, keep = random.Random(5), {}, Scratch.keep

    def kept(self, df, name):
        out = keep(self, df, name)
        sent[name] = out
        if name == "shared":
            sent["runs"] = out.filter("kind = 0").count()
        if name == "stretches":
            sent["places"] = sum(len(x.places) // 2 for x in out.collect())
        return out

    monkeypatch.setattr(Scratch, "keep", kept)
    rows = [(k, " ".join(text(r, 60) + ["again"] * (3000 + k) + text(r, 60))) for k in range(3)]
    found = repeats(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()
    covered = {k: set() for k in range(3)}
    for f in found:
        assert f.first_id == 0
        covered[f.doc_id] |= set(range(f.start, f.stop))
    assert not covered[0] and all(len(covered[k] & set(range(60, 3060 + k))) >= 3000 + k - 16 for k in (1, 2))
    assert sent["runs"] < 100 and sent["places"] < 6000


@pytest.mark.parametrize("seed", range(6))
def test_pairs_of_windows_against_all(seed):
    r, least = np.random.default_rng(seed), 8
    grams = np.concatenate([np.repeat(r.integers(0, 6, 8), r.integers(1, 40, 8)), r.integers(0, 1 << 40, 60), np.repeat(r.integers(0, 6, 6), r.integers(1, 30, 6))]).astype(np.uint64)
    windows, lows = [], []
    for f in range(2):
        hashes = common.mix(grams, f + 2)
        windows.append(compact_windows(hashes, least).astype(np.int64))
        lows.append(hashes[windows[f][:, 1]])
    (one, two), want = windows, set()
    for k, (l1, c1, r1) in enumerate(one.tolist()):
        for j, (l2, c2, r2) in enumerate(two.tolist()):
            low, high = max(l1, l2, min(c1, c2) - least), min(r1, r2, max(c1, c2) + least)
            if c1 - least < c2 < c1 + least and high - low >= least:
                key = common.mix(common.mix(lows[0][k : k + 1], 0) + lows[1][j : j + 1], 1).view(np.int64)
                want.add((int(key[0]), low, high))
    keys, low, high, even = compact_windows_module._pairs(one, lows[0], two, lows[1], 0, 1, least)
    assert list(zip(keys.tolist(), low.tolist(), high.tolist())) == sorted(want)
    assert all(len(set(grams[a:b].tolist())) == 1 and b - a == least for a, b in zip(low[even].tolist(), high[even].tolist()))
    assert even.any()


def test_texts_with_a_common_part_are_not_all_compared(monkeypatch):
    r, least = np.random.default_rng(1), 46
    part, texts, calls, compared = r.integers(0, 1 << 31, 39), [], [], compact_windows_module.alike_parts
    for k in range(60):
        own = np.concatenate([r.integers(0, 1 << 31, 11), part, r.integers(0, 1 << 31, 11)]).astype(np.uint32)
        if k == 50:
            own[:60] = texts[20].grams[:60]
        texts.append(compact_windows_module._Text(k, k, k, np.array([7]), np.array([[0, 61]]), np.array([[0, 61]]), own, least))
    monkeypatch.setattr(compact_windows_module, "alike_parts", lambda *x: (calls.append(1), compared(*x))[1])
    found = list(compact_windows_module._group(texts, -1, True, least))
    assert [(f[2], f[4]["row"]) for f in found] == [(50, 20)]
    # Of 1770 pairs.
    assert len(calls) < 10


def test_places_without_enough_in_common_are_not_compared(monkeypatch):
    """Texts share a passage in one place; another place of each, under its key, has nothing to find."""
    r, least = np.random.default_rng(2), 46
    passage, texts, calls, compared = r.integers(0, 1 << 31, 60), [], [], compact_windows_module.alike_parts
    for k in range(40):
        own = np.concatenate([passage, r.integers(0, 1 << 31, 60)]).astype(np.uint32)
        texts.append(compact_windows_module._Text(k, k, k, np.array([7, 8]), np.array([[0, 60], [60, 120]]), np.array([[0, 120]]), own, least))
    monkeypatch.setattr(compact_windows_module, "alike_parts", lambda *x: (calls.append(1), compared(*x))[1])
    found = list(compact_windows_module._group(texts, -1, True, least))
    assert [(f[0], f[2], f[4]["row"]) for f in found] == [(7, k, 0) for k in range(1, 40)]
    # Of 780 pairs.
    assert len(calls) == 39


def test_counted_keys_go_to_all_buckets_alike():
    r = random.Random(9)
    rows = pa.RecordBatch.from_pydict({"row": [1], "id": [1], "text": [" ".join(r.choices(VOCABULARY, k=40_000))]})
    (payload,) = compact_windows_module._payloads(iter([rows]), 46, 5, 1 << 20)
    keys, _ = compact_windows_module._counts(payload)
    shares = np.bincount((keys >> np.uint64(61)).astype(int), minlength=8) / len(keys)
    assert shares.max() < 0.2


def test_words_of_all_texts_are_hashed_at_once(monkeypatch):
    r, letters = random.Random(12), "abZé\x00A漢"
    texts = ["", " \t", "x"]
    for _ in range(200):
        own = ["".join(r.choice(letters) for _ in range(r.randrange(1, 40))) for _ in range(r.randrange(30))]
        texts.append(r.choice(["", "\n"]) + r.choice([" ", "\r\t", "\x0b \x0c", " \x1f "]).join(own))
    texts = [t.encode() for t in texts]
    want = [common.word_hashes(common.words(t)) for t in texts]
    calls, digest = [], common.xxhash.xxh64_intdigest
    monkeypatch.setattr(common.xxhash, "xxh64_intdigest", lambda word: (calls.append(word), digest(word))[1])
    hashes, edges = common.hashed_words(texts)
    assert hashes.tolist() == np.concatenate(want).tolist() and edges.tolist() == np.cumsum([0, *map(len, want)]).tolist()
    assert calls and all(len(word) >= 32 for word in calls)
    calls.clear()
    rows = pa.RecordBatch.from_pydict({"row": [1, 2], "id": [1, 2], "text": [" ".join(text(r, 200)) for _ in range(2)]})
    assert len(list(compact_windows_module._payloads(iter([rows]), 46, 5, 1 << 20))) == 1 and not calls


@pytest.mark.parametrize("rounds", [0, 1, 32])
def test_windows_against_a_plain_search(monkeypatch, rounds):
    monkeypatch.setattr(compact_windows_module, "ROUNDS", rounds)
    r, least = np.random.default_rng(rounds), 3
    for ties in (2, 5, 1 << 40):
        for shape in (r.integers(ties, size=90), np.sort(r.integers(ties, size=90)), np.sort(r.integers(ties, size=90))[::-1], np.repeat([ties, 0], 45)):
            a, edges = np.ascontiguousarray(shape).astype(np.uint64), np.array([0, 30, 31, 90])
            want = []
            for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for k in range(start, stop):
                    left = max((x + 1 for x in range(start, k) if a[x] <= a[k]), default=start)
                    right = min((x for x in range(k + 1, stop) if a[x] < a[k]), default=stop)
                    if right - left >= least:
                        want.append([left, k, right])
            assert compact_windows_module.compact_windows(a, least, edges).tolist() == want


def test_exact_repeats_of_a_block_are_put_together():
    # Two runs of one shingle reach farther than the others; row 2 has no id, and row 3 is another text of the same id.
    rows = {"block": [7] * 5, "doc": [0, 0, 0, 1, 1], "row": [5, 5, 5, 6, 6], "id": [1, 1, 1, None, None], "first_row": [2, 2, 2, 2, 3]}
    rows |= {"first_id": [None, None, None, None, 9], "first_start": [0, 8, 0, 3, 4], "start": [10, 18, 70, 0, 1], "stop": [48, 90, 108, 38, 39]}
    out = compact_windows_module._covered(pa.table(rows), 38).to_pylist()
    found = [(x["row"], x["id"], x["first_id"], x["start"], x["stop"]) for x in out if x["covered"] is None]
    assert found == [(5, 1, None, 10, 108), (6, None, None, 0, 38), (6, None, 9, 1, 39)]
    (covered,) = [common.unpack(x["covered"]).reshape(3, -1).tolist() for x in out if x["covered"] is not None]
    assert sorted(zip(*covered)) == [(0, 10, 56), (0, 70, 108), (1, 0, 38), (1, 1, 39)]
