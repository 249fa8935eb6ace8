from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from roomledger.llm import bitplanes, simhash
from roomledger.llm.links import components


def brute_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    """For each (id, fingerprint) the smallest id that is reachable."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            low[root(i)] = min(doc, low.get(root(i), doc))
    return [low.get(root(i)) for i in range(len(prints))]


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7, 11])
def test_bit_planes_count_distances(radius):
    rng = np.random.default_rng(radius)
    values = rng.integers(0, 1 << 63, 333, dtype=np.uint64)
    values[100:] = values[7] ^ (np.uint64(1) << rng.integers(0, 64, 233, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 233, dtype=np.uint64))
    own, every = bitplanes.planes(values), bitplanes.lanes(np.ones(333, bool))
    for value in (int(values[7]), 0, (1 << 64) - 1):
        found = bitplanes.flags(bitplanes.near_value(own, value, every, radius))[:333]
        assert found.tolist() == [(int(v) ^ value).bit_count() <= radius for v in values]
    for shift in (1, 5, 63):
        part = bitplanes.lanes(np.arange(333) + shift < 333)
        found = bitplanes.flags(bitplanes.near_shifted(own, shift, part, radius))[: 333 - shift]
        assert found.tolist() == [(int(a) ^ int(b)).bit_count() <= radius for a, b in zip(values, values[shift:])]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "A b c D e f", "É é x  y\x0bz " * 40, "w " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_masks_leave_no_link_out():
    rng = random.Random(1)
    masks = [m % (1 << 64) for m in simhash.masks()]
    assert len(masks) == 35
    for _ in range(500):
        changed = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & changed == 0 for m in masks)


@pytest.mark.parametrize("sizes", [(1, 2, 3, 64), (65, 1, 200), (700,)])
def test_links_of_buckets(sizes):
    rng = np.random.default_rng(len(sizes))
    keys = np.repeat(np.arange(len(sizes)), sizes)
    base = rng.integers(0, 1 << 63, len(keys) // 3 + 1, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (3, len(keys)), dtype=np.uint64)
    values = base[rng.integers(0, len(base), len(keys))] ^ flips[0] ^ flips[1] ^ flips[2]
    a, b = simhash.bucket_links(keys, values, 4)
    for bucket in range(len(sizes)):
        own = values[keys == bucket]
        place = {int(v): i for i, v in enumerate(own)}
        label = list(range(len(own)))
        for x, y in zip(a.tolist(), b.tolist()):
            if x in place and y in place:
                low, high = sorted((label[place[x]], label[place[y]]))
                label = [low if k == high else k for k in label]
        expected = brute_components([(i, int(v)) for i, v in enumerate(own)])
        groups = lambda ls: {tuple(sorted({int(own[i]) for i, k in enumerate(ls) if k == l})) for l in ls}  # noqa: E731, E741
        assert groups(label) == groups(expected)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(-5, k) for k in range(200, 400)] + [(None, 3), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x, y in pairs:
        if x is not None and x != y:
            low, high = sorted((root(x), root(y)))
            parent[high] = low
    rows = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {(r.node, r.root) for r in rows} == {(x, root(x)) for x in list(parent)} and len(rows) == len(parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(60)) for _ in range(12)]
    rows = [(None, "x y z"), (3, None), (9, ""), (4, "   "), (5, "x y z"), (None, "alone in here with no id"), (6, texts[0]), (6, texts[0])]
    for i in range(100, 220):
        words = rng.choice(texts).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_copies(frame).collect()), key=repr)
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    expected = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints))), key=repr)
    assert found == expected
    assert simhash.near_copies(frame.where("false")).count() == 0
