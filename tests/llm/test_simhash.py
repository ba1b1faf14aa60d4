"""Covering masks, and components against all pairs."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from vulnwave.llm import simhash
from vulnwave.llm.components import components


def plain(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fingerprints, ids=None, radius=4):
    """Smallest id reachable, by comparing all pairs."""
    values = np.array(fingerprints, np.uint64)
    ids = list(range(len(values))) if ids is None else ids
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    out, seen = [None] * len(values), set()
    for i in range(len(values)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            new = set(np.nonzero(near[todo.pop()])[0].tolist()) - group
            group |= new
            todo += new
        seen |= group
        known = [ids[j] for j in group if ids[j] is not None]
        for j in group:
            out[j] = min(known) if known else None
    return out


@pytest.mark.parametrize("n", [5, 8, 16, 32])
def test_masks_cover_every_set_of_positions(n):
    masks = simhash.covering_masks(list(range(n)))
    assert all(any(all(not m >> p & 1 for p in some) for m in masks) for some in itertools.combinations(range(n), 4))


def test_masks_halve_the_positions():
    assert min(m.bit_count() for m in simhash.covering_masks(list(range(64)))) >= 32
    assert min(m.bit_count() for m in simhash.covering_masks(list(range(32)))) >= 16
    assert min(m.bit_count() for m in simhash.covering_masks(list(range(16)))) >= 8
    r = random.Random(1)
    masks = simhash.covering_masks(list(range(64)))
    for _ in range(3000):
        some = r.sample(range(64), 4)
        assert any(all(not m >> p & 1 for p in some) for m in masks)


def test_fingerprint(spark, sf_dir):
    texts = ["", None, " \x1c ", "a b", "A B", "É é", "a\tb\nc d e", "x " * 200_000]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50).collect()]
    assert [simhash.simhash(t) & 2**64 - 1 for t in texts] == [plain(t) for t in texts]


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs).collect())
    rows = sorted((r["doc_id"], plain(r["text"])) for r in docs.collect())
    want = classes([f for _, f in rows], [k for k, _ in rows])
    assert got == [(k, f"{f:016x}", c) for (k, f), c in zip(rows, want)]


@pytest.mark.parametrize("bucket", [2048, 12])
def test_dense_families_by_levels_of_masks(spark, bucket):
    r = random.Random(3)
    seeds = [r.getrandbits(64) for _ in range(3)]
    family = set()
    while len(family) < 400:
        x = r.choice(seeds)
        for p in r.sample(range(64), r.randint(0, 5)):
            x ^= 1 << p
        family.add(x)
    family = sorted(family)
    signed = [x - 2**64 if x >> 63 else x for x in family]
    table = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(table, bucket=bucket)).collect()}
    got = [roots.get(x, x) for x in signed]
    want = classes(family)
    pairs = set(zip(got, want))
    assert len(pairs) == len(set(got)) == len(set(want))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 61 + 40 + 2
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(100, 140)}) == 1 and len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows_and_representatives(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text, 1), (5, text, 2), (3, text, 1), (3, text, 1), (None, None, 1), (None, "", 1), (8, "other words here", 0), (None, "one more text", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 8
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 5)} == {3}
    assert sum(r["component_id"] == 3 for r in got) == 4 and sum(r["component_id"] is None for r in got) == 3
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in kept.collect()) == [(0, ""), (0, "one m"), (3, "w0 w1"), (8, "other")]
    assert simhash.near_duplicates(docs.limit(0)).count() == simhash.representatives(docs.limit(0)).count() == 0
