"""Groups of near-duplicates against all pairs of shingle sets."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest

from vulnwave.llm import neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def left(texts):
    """Smallest place of each group, by comparing all pairs that share a shingle."""
    sets = [plain(t) for t in texts]
    group = list(range(len(sets)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for j in {j for x in s or {None} for j in holders[x]}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]) and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                group[b] = a
        for x in s or {None}:
            holders[x].add(i)
    return {i for i in range(len(sets)) if root(i) == i}


def kept(spark, texts, **how):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    found = neardup.representatives(docs, **how) if how else corpus_pipeline.one_of_each(spark, docs, "")
    assert found.columns == docs.columns
    return sorted(r["doc_id"] for r in found.collect())


def words(r, n):
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def test_edited_copies_go(spark):
    r = random.Random(5)
    texts = []
    for edits in (1, 2, 3, 4) * 20:  # 4 words of 200: similarity 0.817 at least
        text = words(r, 200)
        copy = list(text)
        for k in r.sample(range(5, 195), edits):
            copy[k] = "edited"
        texts += [" ".join(text), " ".join(copy)]
    assert kept(spark, texts) == list(range(0, 160, 2))


def test_texts_that_share_a_repeated_line_stay(spark):
    r = random.Random(6)
    line = "all rights reserved by the owner of this page and site "
    texts = [" ".join(words(r, 100)) + " " + line * 60 for _ in range(12)]
    assert kept(spark, texts) == list(range(12))


@pytest.mark.parametrize("small", [16, 1])
def test_families_and_chains(spark, small):
    r = random.Random(7)
    texts = [None, "", " \t", "a b", "A  b", "a b c"]
    for _ in range(6):
        text = words(r, 150)
        for _ in range(25):  # a chain: each differs a little from the one before, in the end from all
            text = list(text)
            text[r.randrange(150)] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(text))
    shared = words(r, 140)
    texts += [" ".join(shared + words(r, 60)) for _ in range(60)]  # similarity 0.53: many meet, none is linked
    r.shuffle(texts)
    assert kept(spark, texts, small=small) == sorted(left(texts))


def test_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [r["text"] for r in rows]
    assert kept(spark, texts) == sorted(left(texts))


def test_variants_that_do_not_link_are_not_all_compared(spark, monkeypatch):
    r = random.Random(8)
    base = words(r, 146)
    texts = [" ".join(base)]
    for _ in range(240):  # 4 words of 146: similarity 0.75 to the first, less among each other
        text = list(base)
        for k in r.sample(range(2, 29), 4):
            text[5 * k] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(text))
    for text in texts[1:240:3]:  # each third is linked to one of its own
        texts.append(" ".join([*text.split()[:-1], "end"]))
    compared = []
    verified = neardup._verified

    def counted(pairs, of):
        compared.append(pairs.count())
        return verified(pairs, of)

    monkeypatch.setattr(neardup, "_verified", counted)
    assert kept(spark, texts) == sorted(left(texts)) == list(range(241))
    assert sum(compared) < 25 * len(texts)  # of 51,360 pairs


@pytest.mark.parametrize("seed", [31566, 65194])
def test_masks_find_what_bands_miss(spark, seed):
    r = random.Random(seed)
    text = words(r, 50)
    copy = [*text[:25], "edited", *text[26:]]
    texts = [" ".join(text), " ".join(copy)]
    a, b = map(neardup.shingles, texts)
    assert neardup.similar(a, b) and not set(neardup.bands(a)) & set(neardup.bands(b))
    assert kept(spark, texts) == [0]
