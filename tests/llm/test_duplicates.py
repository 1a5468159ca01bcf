"""Substring removal, near-duplicate classes and decontamination against brute force."""

import hashlib
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import bag_similarity, clashing, documents, odd_texts, words
from quotalens.llm import decontaminate, neardup, substrings


def brute_cut(rows):
    """(doc_id, bytes, spans, kept) of every row."""
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if i is not None:
                least[b[p:p + 50]] = min(i, least.get(b[p:p + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - 49):
            if i is not None and least[b[p:p + 50]] < i:
                gone[p + 1:p + 51] = True
        edge = np.flatnonzero(np.diff(gone.astype(int)))
        out.append((i, len(b), tuple(edge.tolist()), hashlib.sha256(bytes(x for x, g in zip(b, gone[1:]) if not g)).hexdigest()))
    return sorted(out, key=str)


def cut(df):
    rows = substrings.remove_repeats(df).collect()
    return sorted(((r.doc_id, r.n_bytes, tuple(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows), key=str)


def shared_passages():
    rng, passage, long = random.Random(1), words(1, 30), words(2, 200)
    rows = [(i, words(100 + i, 60)) for i in range(40)]
    rows += [(50 + i, words(200 + i, rng.randint(0, 30)) + " " + passage[i % 7:] + " " + words(300 + i, 10)) for i in range(40)]
    rows += [(100 + i, long) for i in range(20)] + [(140 + i, long[:rng.randint(40, 900)] + "é" + long[rng.randint(0, 900):]) for i in range(20)]
    rows += [(180, "ab" * 400), (181, "ab" * 300), (182, "b" + "ab" * 100), (183, "x" * 49), (184, "x" * 49), (185, "y" * 50), (186, "y" * 50), (187, "y" * 51)]
    return rows


def test_removal_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 4000)
    rows = shared_passages()
    assert cut(documents(spark, rows).repartition(5)) == brute_cut(rows)


def surroundings(rows):
    """One bucket of everything: a blob as the second exchange gets it."""
    held, ids = [], np.array([i for i, _ in rows], np.int64)
    for k, (_, text) in enumerate(rows):
        raw = text.encode()
        for p, g, a, b in zip(*substrings.anchors(np.frombuffer(raw, np.uint8))):
            held.append((g, k, a, p - a, b + substrings.LENGTH - a, raw[a:b + substrings.LENGTH]))
    columns = [np.array([h[i] for h in held], t) for i, t in enumerate(("u8", "u4", "u4", "u1", "u1"))]
    text = np.frombuffer(b"".join(h[5] for h in held), np.uint8)
    return pd.DataFrame({"blob": [substrings.pack(*substrings.shortened(columns[0]), *columns[1:], ids, np.zeros(len(ids), np.int32), text)]}), len(text)


def starts(found):
    return {(d, x) for d, r in zip(found["doc_id"], found["ranges"]) for a, b in zip(r[::2], r[1::2]) for x in range(a, b + 1)}


def test_packed_numbers_come_back_and_are_small():
    rng = np.random.default_rng(5)
    arrays = [rng.integers(0, 300, 4000).astype("u4"), np.arange(10**12, 10**12 + 2000), np.zeros(0, "i4"), rng.integers(0, 256, 77).astype("u1")]
    blob = substrings.pack(*arrays)
    back = substrings.unpack(blob, "u4", "i8", "i4", "u1")
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, back))
    assert len(blob) < 1.5 * 4000 + 2000 * 1.2


def test_a_bucket_without_equal_strings_gives_no_rows():
    part, _ = surroundings([(1, words(1, 30)), (2, words(2, 30))])
    found = substrings._search(part.assign(doc_id=0, key=0, ranges=None))
    assert len(found) == 0 and pa.Array.from_pandas(found["ranges"], type=pa.list_(pa.int32())).to_pylist() == []


def test_a_bucket_is_compared_in_parts_of_bounded_memory(monkeypatch):
    rows = [(i, words(i // 3, 2000)) for i in range(90)]
    part, size = surroundings(rows)
    substrings._equal_strings(part)  # tables of powers are made once
    tracemalloc.start()
    found = substrings._equal_strings(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * size
    assert len({d for d, _ in starts(found)}) == 60
    monkeypatch.setattr(substrings, "PART_BYTES", 1)
    assert starts(substrings._equal_strings(part)) == starts(found)
    monkeypatch.setattr(substrings, "PART_BYTES", 1 << 30)
    assert starts(substrings._equal_strings(part)) == starts(found)


def test_removal_of_odd_rows(spark):
    text = words(7, 40)
    rows = [r for r in odd_texts() if r[0] != 6] + [(None, text), (7, text), (7, text), (8, text + "!"), (7, "other " + text), (9, "z" * 3000)]
    assert cut(clashing(documents(spark, rows))) == brute_cut(rows)
    assert substrings.remove_repeats(documents(spark, [])).count() == 0


def test_suffix_sort_orders_suffixes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1400] = data[2000:2400]
    start = rng.permutation(3900)[:900]
    slot = np.sort(rng.integers(0, 5, 900))
    order = substrings.sort_suffixes(data, substrings.Hashes(data), start, slot)
    raw = data.tobytes()
    keys = [(slot[k], raw[start[k]:start[k] + 50]) for k in order]
    assert sorted(order) == list(range(900)) and keys == sorted(keys)


def test_equal_strings_share_an_anchor():
    rng = random.Random(4)
    one = words(5, 50).encode()
    for _ in range(30):
        before, after = words(rng.random(), 5).encode(), words(rng.random(), 5).encode()
        a, b = rng.randrange(100), rng.randrange(150, 250)
        other = before + one[a:b] + after
        place = lambda data: {s: (p - s) for p, _, f, t in zip(*substrings.anchors(np.frombuffer(data, np.uint8))) for s in range(f, t + 1)}
        x, y = place(one), place(other)
        assert all(x[s] == y[s - a + len(before)] for s in range(a, b - 49))


def shingles(text):
    import re

    w = re.findall(r"\w+", (text or "").lower())
    return [" ".join(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [" ".join(w)] if w else []


def edited(text, seed, n):
    rng, w = random.Random(seed), text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = words(rng.random(), 1)
    return " ".join(w)


def near_rows():
    base = [words(1000 + i, 120) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[0].upper() + " !") for i in range(10)]
    rows += [(200 + i, edited(base[1], i, 1)) for i in range(30)]
    rows += [(300 + i, edited(base[2], i, 60)) for i in range(10)]
    rows += [(400 + i, base[3] + " " + words(i, 120)) for i in range(10)]
    chain = base[4]
    for i in range(8):
        chain = edited(chain, 50 + i, 1)
        rows.append((500 + i, chain))
    rows += [(600, "just four words here"), (601, "Just four words here"), (602, "just four words there"), (603, ""), (604, None), (605, "?!")]
    return rows


def brute_classes(rows, rarity):
    powers = neardup._Powers()
    made = [neardup.weighted_shingles(neardup.word_hashes(t, powers), rarity) for _, t in rows]
    name = list(range(len(rows)))

    def root(k):
        while name[k] != k:
            k = name[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if neardup.similarity(made[a], made[b]) >= 0.8:
                name[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


def test_classes_equal_brute_force(spark):
    rows = near_rows()
    df = documents(spark, rows)
    rarity = neardup.shingle_rarity(df)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(clashing(df)).collect()}
    want = brute_classes(rows, rarity)
    assert got == want
    assert all(want[200 + i] == 1 for i in range(30)) and all(want[100 + i] == 0 for i in range(10)) and want[300] == 300


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LARGE", 3)
    monkeypatch.setattr(neardup, "ROUNDS", 1)
    rows = near_rows()
    df = documents(spark, rows)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == brute_classes(rows, neardup.shingle_rarity(df))


@pytest.mark.parametrize("large", [3, 256])
def test_one_shared_band_is_enough_in_buckets_of_any_size(spark, monkeypatch, large):
    """All documents share one band of 14 and 31 of 56 samples, the least that ESTIMATE lets through; the centres join few of them."""
    def samples(s, w, starts, table):
        own = np.add.reduceat(s, starts).astype(np.uint32)
        out = own[:, None] + np.arange(56, dtype=np.uint32)
        out[:, :4] = 7
        out[:, [4 * band + k for band in range(1, 10) for k in range(3)]] = 7
        return out

    monkeypatch.setattr(neardup, "samples", samples)
    monkeypatch.setattr(neardup, "LARGE", large)
    rows = [(10 * g + k, words(900 + g, 60) + " tail" * k) for g in range(25) for k in range(3)]
    df = documents(spark, rows)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    want = {i: i - i % 10 for i, _ in rows}
    assert got == want == brute_classes(rows, neardup.shingle_rarity(df))


def test_rarity_counts_documents(spark):
    common = "these five words are common"
    rows = [(i, words(i, 20) + " " + common * (1 + i % 2)) for i in range(30)] + [(50, None), (51, words(3, 20))]
    rarity = neardup.shingle_rarity(documents(spark, rows).coalesce(1))
    held = Counter(s for _, t in rows for s in set(shingles(t)))
    assert len(rarity.shingles) == sum(n > 1 for n in held.values())
    assert rarity.idf.min() == pytest.approx(np.log(33 / (max(held.values()) + 1)) + 0.05) and rarity.other == pytest.approx(np.log(33 / 2) + 0.05)


@pytest.mark.parametrize("parts,chunk", [(1, 1 << 22), (1, 300), (5, 1 << 22), (40, 1 << 22)])
def test_rarity_does_not_depend_on_partitions(spark, monkeypatch, parts, chunk):
    """Phrases in 1 to 20 of 80 documents: all that are in 8 or more are counted, as counted here."""
    monkeypatch.setattr(neardup, "SHARE", 0.1)
    monkeypatch.setattr(neardup, "_CHUNK", chunk, raising=False)
    rows = [(i, words(i, 10) + " " + " ".join(words(300 + k, 6) for k in range(1, 21) if (i * 27 + 11 * k) % 80 < k)) for i in range(80)]
    held = Counter(s for _, t in rows for s in set(shingles(t)))
    rarity = neardup.shingle_rarity(documents(spark, rows).repartition(parts))
    want = sorted(np.log(81 / (n + 1)) + 0.05 for n in held.values() if n >= 8)
    assert len(want) > 20 and sorted(rarity.idf) == pytest.approx(want)


def test_samples_agree_as_often_as_documents_are_similar():
    rng = np.random.default_rng(6)
    s = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    w = rng.uniform(5, 40, len(s))
    one, two = (s[:300], w[:300]), (s[60:360], w[60:360] * 1.1)
    table = neardup.variables()
    want = neardup.similarity(one, two)
    same = []
    for shift in range(40):  # other shingles, same weights
        move = lambda x: neardup.mix(x[0] + np.uint64(shift))
        a, b = (neardup.samples(move(x), x[1], np.array([0]), table)[0] for x in (one, two))
        same.append((a == b).mean())
    assert abs(np.mean(same) - want) < 0.04


def plain_samples(s, w, starts, table):
    """The definition: every shingle's own t and ln a, the smallest of each document."""
    r, inverse, beta, rest = table
    ln_w, low, high = np.log(w).astype(np.float32), s.astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), 56), np.uint32)
    for k in range(56):
        step = neardup._STEP[k]
        at = (low * np.uint32(step >> np.uint64(32) | np.uint64(1)) + np.uint32(step & np.uint64(0xFFFFFFFF))) >> np.uint32(16)
        t = np.floor(ln_w * inverse[at] + beta[at])
        ln_a = rest[at] - r[at] * t + np.float32(256)
        name = (high + t.astype(np.int32).view(np.uint32) * np.uint32(2654435761)) * np.uint32(2246822519)
        out[:, k] = np.minimum.reduceat((ln_a.view(np.uint32).astype(np.uint64) << np.uint64(32)) | name, starts).astype(np.uint32)
    return out


@pytest.mark.parametrize("rare", [0, 0.3, 0.95, 1])
def test_samples_are_those_of_the_definition(rare):
    rng = np.random.default_rng(8)
    s = rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    w = np.where(rng.random(len(s)) < rare, 6.9, rng.choice(rng.uniform(0.05, 40, 300), len(s)))
    starts, table = np.array([0, 1, 2, 700, 4999]), neardup.variables()
    assert np.array_equal(neardup.samples(s, w, starts, table), plain_samples(s, w, starts, table))


def test_shingles_of_one_weight_are_sampled_in_half_the_time():
    rng = np.random.default_rng(9)
    s, starts, table = rng.integers(0, 1 << 63, 1 << 16).astype(np.uint64), np.arange(0, 1 << 16, 500), neardup.variables()
    w = np.where(rng.random(len(s)) < 0.95, 6.9, rng.uniform(1, 40, len(s)))

    def seconds(sample):
        took = []
        for _ in range(5):
            start = time.process_time()
            sample(s, w, starts, table)
            took.append(time.process_time() - start)
        return min(took)

    assert seconds(neardup.samples) < 0.6 * seconds(plain_samples)


def test_texts_hashed_together_hash_as_alone(monkeypatch):
    monkeypatch.setattr(neardup, "_GROUP", 200)
    powers = neardup._Powers()
    texts = [None, "", "a", " . ", "one two three four", "one two three four five", "one two three four five six", "ΟΔΟΣ", "ΟΔΟΣ x", "x " * 40,
             *[words(k, 3 * k) for k in range(30)], "", "a b"]
    together = list(neardup.groups(texts))
    assert [t for part in together for t in part] == texts and len(together) > 5
    for part in together:
        hashes, starts = neardup.hashed_words(part, powers)
        shingles_, times, bounds = neardup.grouped_shingles(hashes, starts)
        for k, t in enumerate(part):
            alone = neardup.word_hashes(t, powers)
            assert np.array_equal(hashes[starts[k]:starts[k + 1]], alone)
            want = Counter(neardup.mix(sum((alone[i + j:i + j + 1] * neardup._STEP[j] for j in range(min(5, len(alone)))), np.zeros(1, np.uint64)))[0]
                           for i in range(max(1, len(alone) - 4) if len(alone) else 0))
            assert shingles_[bounds[k]:bounds[k + 1]].tolist() == sorted(want)
            assert times[bounds[k]:bounds[k + 1]].tolist() == [want[x] for x in sorted(want)]
        assert neardup.nodes_of(hashes, starts) == [neardup.nodes_of(*neardup.hashed_words([t], powers))[0] for t in part]


def test_first_of_each_class_stays(spark):
    text = words(9, 50)
    rows = [(5, text), (3, text + "."), (3, text + "."), (None, text), (None, "nobody knows this one at all"), (8, "another text of six words total"), (9, ""), (7, None)]
    out = neardup.keep_first(documents(spark, rows).withColumn("node", F.lit("x")))
    assert out.columns[-1] == "node"
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == sorted(
        [(3, text + "."), (-1, "nobody knows this one at all"), (8, "another text of six words total"), (7, "")])
    assert neardup.keep_first(documents(spark, [])).count() == 0
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


ITEMS = [(1, words(71, 20)), (2, words(72, 45)), (3, words(73, 45)), (4, "too short item"), (5, None), (6, "a b a b a b a b a b a b a b a b"), (1, words(74, 12)), (None, words(75, 20))]


def items(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, size string")


def contaminated():
    item = dict(ITEMS[1:3])
    rows = odd_texts() + [(10, words(80, 30) + " " + ITEMS[0][1] + " " + words(81, 30)), (11, item[2].upper().replace(" ", ", ")), (12, item[3][:100])]
    rows += [(13, words(82, 9) + " " + edited(item[2], 1, 1)), (14, edited(item[3], 2, 1) + " tail"), (15, edited(item[3], 3, 6)), (16, "a b " * 12)]
    rows += [(17, ITEMS[6][1] + " " + item[2]), (18, "too short item"), (20, ITEMS[7][1]), (10, "second text of this id")]
    rows += [(100 + i, "intro " + item[2] + " outro") for i in range(50)]
    return rows


def brute_contamination(rows):
    import re

    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    best = {}
    for d, text in rows:
        w = cut(text)
        for i, item in ITEMS:
            n = len(cut(item))
            want = shingles(" ".join(cut(item))) if n >= 5 else []
            for at in range(len(w) - 4) if want and d is not None and i is not None else ():
                window = [" ".join(w[k:k + 5]) for k in range(at, min(at + n, len(w)) - 4)]
                if window[:1] and window[0] in want:
                    score = bag_similarity(window, want)
                    if score >= 0.8:
                        best[d, i] = max(best.get((d, i), (0, 0)), (score, -at))
    return {(d, i, -at, round(s, 9)) for (d, i), (s, at) in best.items()}


@pytest.mark.parametrize("sent", [0, 500_000])
def test_contamination_equals_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "MOST_SENT", sent)
    rows = contaminated()
    got = decontaminate.contamination(clashing(documents(spark, rows)), items(spark)).collect()
    assert {(r.doc_id, r.item_id, r.start_word, round(r.similarity, 9)) for r in got} == brute_contamination(rows)
    assert {10, 11, 13, 14, 17, 100} <= {r.doc_id for r in got} and not {12, 15, 18, 20} & {r.doc_id for r in got}


def test_contaminated_documents_go(spark):
    rows = contaminated()
    left = decontaminate.decontaminate(documents(spark, rows), items(spark)).collect()
    held = {x[0] for x in brute_contamination(rows)}
    assert sorted(str(r.doc_id) for r in left) == sorted(str(i) for i, _ in rows if i not in held)


def test_contaminated_documents_without_id_go(spark):
    item = ITEMS[1][1]
    rows = [(None, "intro " + item), (None, words(91, 40)), (None, None), (1, item), (2, words(92, 40))]
    left = decontaminate.decontaminate(documents(spark, rows), items(spark)).collect()
    assert sorted(str(r.text) for r in left) == sorted([words(91, 40), "None", words(92, 40)])


def test_contamination_of_empty_tables(spark):
    assert decontaminate.contamination(documents(spark, []), items(spark)).count() == 0
    assert decontaminate.contamination(documents(spark, contaminated()), items(spark).limit(0)).count() == 0


def test_fingerprint_distance(spark):
    codes = spark.createDataFrame([([1, 2, 3, -5],), ([1, 2, 3, -5],), ([7, 8, 1 << 62],)], "s array<long>").withColumn("c", decontaminate.fingerprint(F.col("s")))
    a, b, c = (r.c for r in codes.collect())
    plain = lambda s: sum(1 << (63 - k) for k in range(64) if 2 * sum(h >> k & 1 for h in s) > len(s))
    assert a == b and int(a, 16) == plain([1, 2, 3, -5]) and int(c, 16) == plain([7, 8, 1 << 62])
    pair = spark.createDataFrame([(a, c)], "a string, c string").select(decontaminate.distance(F.col("a"), F.col("c")).alias("d")).first()
    assert pair.d == bin(int(a, 16) ^ int(c, 16)).count("1")


def test_a_task_counts_shingles_in_one_running_table(spark, monkeypatch):
    """Chunks of a task lose no frequent shingle, and what a task hands on doesn't depend on where the last chunk begins."""
    common = words(1, 12)
    docs = documents(spark, [(k, f"{common} {words(1000 + k, 12)}" if k % 3 == 0 else words(2000 + k, 20)) for k in range(600)])
    monkeypatch.setattr(neardup, "SHARE", 0.02)
    found = []
    for chunk in (1, 50, 3000, 1 << 22):
        monkeypatch.setattr(neardup, "_CHUNK", chunk)
        for parts in (1, 4, 40):
            rarity = neardup.shingle_rarity(docs.repartition(parts))
            found.append((rarity.shingles.tolist(), rarity.idf.tolist()))
    assert all(f == found[0] for f in found) and len(found[0][0]) == 8
