"""Base spans against the plain patterns, segmentations against all of them, and precision on clean text."""

import hashlib
import itertools
import math
import random
import re

import pytest

from vulnwave.llm import pii


def plain(text):
    """The patterns as they are stated."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and check_sum(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def check_sum(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.examples(pii.FILLER))


def test_base_spans():
    r = random.Random(1)
    for _ in range(15_000):
        text = "".join(r.choice("0123456789..@@+- ()ab_%-.55") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "é@é" * 50_000, "(" * 100_000 + "1"):
        pii.base_spans(text)


def test_decoding_is_the_best_of_all_segmentations():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 7)
        found = [pii.Segment("ip", a, b, (f"f{r.randint(0, 5)}", f"g{r.randint(0, 5)}")) for a, b in itertools.combinations(range(n + 1), 2) if r.random() < 0.6]
        field = pii.SemiMarkovField({f"{x}{i}": r.uniform(-1, 1) for x in "fg" for i in range(6)})
        sets = [c for k in range(len(found) + 1) for c in itertools.combinations(found, k) if all(a.end <= b.start or b.end <= a.start for a, b in itertools.combinations(c, 2))] if len(found) <= 12 else None
        if sets is None:
            continue
        weights = [sum(map(field.score, c)) for c in sets]
        assert sum(map(field.score, field.decode(n, found))) == pytest.approx(max(weights))
        total = sum(map(math.exp, weights))
        for s, p in zip(found, field.marginals(n, found)):
            assert p == pytest.approx(sum(math.exp(w) for c, w in zip(sets, weights) if s in c) / total)


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("call (743) 555-3824 now", "phone", "(743) 555-3824"),
        ("mail bob [at] mail.example.com ok", "email", "bob [at] mail.example.com"),
        ("write bob at example dot com please", "email", "bob at example dot com"),
        ("from 227[.]5[.]221[.]1 on", "ip", "227[.]5[.]221[.]1"),
        ("card 4465.7583.8288.9437 it", "card", "4465.7583.8288.9437"),
        ("x +1 (743) 555-3824 4465758382889437 y", "card", "4465758382889437"),
        ("x +1 (743) 555-3824 4465758382889437 y", "phone", "+1 (743) 555-3824"),
    ],
)
def test_added_spans(field, text, kind, span):
    base, added = pii.all_spans(text, field)
    assert (kind, span) in [(k, text[a:b]) for k, a, b in base + added]


@pytest.mark.parametrize("text", ["order 4738291045 was", "2024-01-31 12:30:45", "look at this. Then go", "1234 5678 9012 3456", "5 @ 3.50 each", "12 34 56 78 90", "1,234.56 and 7.8.9"])
def test_look_alikes_are_left_alone(field, text):
    assert pii.all_spans(text, field) == ([], [])


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    clean = added = 0
    for r in docs.collect():
        base, g = plain(r["text"] or ""), got[r["doc_id"]]
        assert [g[f"n_{k}"] for k in pii.KINDS] == [sum(k == b[0] for b in base) for k in pii.KINDS]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert g["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(g["spans"].split(",")) and len(list(filter(None, g["spans"].split(",")))) == len(base) + g["n_added"]
        clean += not base
        added += g["n_added"] > 0 and not base
    assert clean and added <= 0.01 * clean


def test_odd_rows_and_redaction(spark, field):
    rows = [(None, None), (1, ""), (1, "a@b.co 1.2.3.4"), (1, "a@b.co 1.2.3.4"), (2, "😀 +1 743 555 3824!" * 3)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, pii int")
    got = pii.personal_data(docs).collect()
    assert sorted(r["spans"] for r in got)[:4] == ["", "", "email:0:6,ip:7:14", "email:0:6,ip:7:14"]
    assert pii.personal_data(docs.limit(0)).count() == 0
    clean = pii.redact(docs, field)
    assert clean.columns == docs.columns
    assert sorted(r["text"] if r["text"] is not None else "-" for r in clean.collect()) == ["", "-", "<EMAIL> <IP>", "<EMAIL> <IP>", "😀 <PHONE>!" * 3]
