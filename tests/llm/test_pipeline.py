"""The stages and run() against plain Python, and the registry."""

from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__
from vulnwave.llm import bpe, langid, mixing, pii
from vulnwave.llm.queries import ORACLES, QUERIES


def test_registry():
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mix", "tokens"]


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def representatives(rows):
    """(key, set) that stand for their groups: all pairs that share a shingle are compared; rows: (key, text)."""
    nodes = sorted({(k is None, k or 0, frozenset(shingles(t))) for k, t in rows}, key=lambda x: (x[0], x[1], sorted(x[2])))
    group = list(range(len(nodes)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    holders = defaultdict(set)
    for i, (_, _, s) in enumerate(nodes):
        for j in {j for x in s or {None} for j in holders[x]}:
            if len(s & nodes[j][2]) >= 0.8 * len(s | nodes[j][2]) and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                group[b] = a
        for x in s or {None}:
            holders[x].add(i)
    return Counter((None if nodes[i][0] else nodes[i][1], nodes[i][2]) for i in range(len(nodes)) if root(i) == i)


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """All documents, with odd rows and columns that have the names of inner ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    again = docs.orderBy("doc_id").limit(3)
    odd = [
        (9_000_001, None, "en", "src0", 0), (9_000_002, "12 34 !", None, None, 7), (9_000_003, "mail a@b.co the thing and the other", None, None, 35),
        (None, "a text that has no id at all and stays", None, None, None), (None, "a text that has no id at all and stays", None, None, None),
        (9_000_004, "", None, "src1", 0), (9_000_005, "the and that " * 30_000, "en", "src1", 9),
    ]
    rows = docs.union(again).union(spark.createDataFrame(odd, docs.schema))
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows.selectExpr("*", "'x' as node", "1 as lang_pred", "2 as size", "3 as ids").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = {"documents": docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, folder)
        tables[name] = out.collect()
        kept = spark.createDataFrame(tables[name], out.schema)
        if name != "tokens":
            assert kept.columns == corpus_pipeline.COLUMNS
    # language: those without a letter go, no other
    count = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows)
    assert count(tables["language"]) == count(r for r in tables["documents"] if langid.normalise(r["text"] or "").any())
    assert all(r["lang"] for r in tables["language"])
    # near-duplicates: one of each group by 5-word sets, repeated rows once
    left = tables["near_duplicates"]
    assert Counter((r["doc_id"], frozenset(shingles(r["text"]))) for r in left) == representatives([(r["doc_id"], r["text"]) for r in tables["language"]])
    assert count(left) <= count(tables["language"])
    # personal data: nothing of the base patterns is left
    assert len(tables["personal_data"]) == len(left)
    assert not any(pii.base_spans(r["text"]) for r in tables["personal_data"])
    assert all(r["n_chars"] == len(r["text"]) for r in tables["personal_data"])
    # mix: as often as the operator says
    clean = spark.createDataFrame(tables["personal_data"], docs.select(*corpus_pipeline.COLUMNS).schema)
    times = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 0 for r in mixing.mix(clean).collect()}
    assert Counter(r["doc_id"] for r in tables["mix"]) == Counter({k: n for k, n in times.items() if n})
    # tokens: as the library has them, and back
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in tables["mix"]}
    assert len(tables["tokens"]) == len(tables["mix"])
    assert all(r["ids"] == library.encode_ordinary(texts[r["doc_id"]]) and r["decoded_ok"] for r in tables["tokens"])
    # run() is these stages, one after the other
    rows = lambda found: Counter((r["doc_id"], r["source"], r["lang"], r["n_tokens"], tuple(r["ids"]), r["decoded_ok"]) for r in found)
    assert rows(corpus_pipeline.run(spark, folder).collect()) == rows(tables["tokens"])


def test_empty(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
