"""Attribution of tokens against a walk over them."""

import random

import public_tokenizers as P
import pytest

from vulnwave.llm import token_counts as tc

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def walk(text, ends, rule):
    """Tokens of the sections that stop at the byte offsets ``ends``."""
    encoding, _ = tc._encoder(PATH, P.PATTERN)
    out, at = [0.0] * len(ends), 0
    starts = [0, *ends[:-1]]
    for token in encoding.encode_ordinary(text):
        low, high = at, at + len(encoding.decode_single_token_bytes(token))
        inside = [max(0, min(high, e) - max(low, s)) for s, e in zip(starts, ends)]
        if rule == "share":
            out = [o + i / (high - low) for o, i in zip(out, inside)]
        elif rule == "most":
            out[inside.index(max(inside))] += 1
        else:
            byte = low if rule == "start" else high - 1
            out[next(k for k, e in enumerate(ends) if byte < e)] += 1
        at = high
    return out


@pytest.mark.parametrize("rule", tc.RULES)
def test_rules(rule):
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(["a", "é", "\n", " ", "🙂", "ab ", "thing", "日本"]) for _ in range(r.randint(1, 20)))
        n = len(text.encode())
        ends = sorted(r.randint(0, n) for _ in range(r.randint(0, 6))) + [n]
        got, crossing = tc.allot(tc.token_ends(text, PATH, P.PATTERN), tc.np.array(ends), rule)
        assert got.tolist() == pytest.approx(walk(text, ends, rule))
        assert sum(got) == pytest.approx(len(tc.token_ends(text, PATH, P.PATTERN))) and min(crossing) >= 0


def test_unknown_rule():
    with pytest.raises(ValueError):
        tc.allot(tc.np.array([1]), tc.np.array([1]), "last")


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {}
    for r in tc.counts(docs, PATH, P.PATTERN).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for r in docs.collect():
        text, found = r["text"] or "", got[r["doc_id"]]
        assert "".join(text[x["start"] : x["end"]] for x in found) == text and [x["section"] for x in found] == list(range(len(found)))
        assert all(text[x["start"] : x["end"]].count("\n") == (text[x["end"] - 1 : x["end"]] == "\n") for x in found)
        ends, at = [], 0
        for x in found:
            at += len(text[x["start"] : x["end"]].encode())
            ends.append(at)
        assert [x["n_tokens"] for x in found] == walk(text, ends, "start")


def test_odd_rows_and_fields(spark):
    docs = spark.createDataFrame([(1, "a b", None, 1), (None, "", "x\ny", 1), (2, None, None, 1), (2, None, None, 1)], "doc_id long, text string, b string, text_tokens int")
    assert sorted((r["doc_id"] or 0, r["end"], r["n_tokens"]) for r in tc.counts(docs, PATH, P.PATTERN).collect()) == [(0, 0, 0), (1, 3, 2), (2, 0, 0), (2, 0, 0)]
    rows = tc.fields(docs, ["text", "b"], PATH, P.PATTERN).collect()
    assert len(rows) == 4 and {r["text_tokens"] + r["b_tokens"] for r in rows if r["doc_id"] == 1} == {3.0}
    assert tc.counts(docs.limit(0), PATH, P.PATTERN).count() == tc.fields(docs.limit(0), ["b"], PATH, P.PATTERN).count() == 0
