"""Repairs against a search over all edits, and the query against plain Python."""

import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from vulnwave.llm import conversations
from vulnwave.llm.conversations import Endings
from vulnwave.llm.queries import QUERIES

BLANKS = " \t\n\x0b\f\r"


def search(letters):
    """Least (cost, audit) by best-first search over (row, grammar state): no shared endings, audits as text."""
    keep = {("S", "s"): "P", ("S", "u"): "U", ("P", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
    go = {"S": "U", "P": "U", "U": "A", "A": "U"}
    todo, done = [(0, "", 0, "S")], set()
    while todo:
        cost, audit, i, state = heapq.heappop(todo)
        if i == len(letters) and state in "SA":
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        heapq.heappush(todo, (cost + 2, audit + "I", i, go[state]))
        if i < len(letters):
            heapq.heappush(todo, (cost + 3, audit + "D", i + 1, state))
            if letters[i] != "x":
                more = letters[i].isupper()
                heapq.heappush(todo, (cost + 2 + more, audit + "R", i + 1, go[state]))
                if to := keep.get((state, letters[i].lower())):
                    heapq.heappush(todo, (cost + more, audit + "K", i + 1, to))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_all_short_signatures(n):
    endings = Endings()
    every = ["".join(p) for p in itertools.product("suaoSUAOx", repeat=n)]
    for s in sorted(every, key=lambda s: s[::-1]):
        assert endings.solve(s) == search(s), s
    assert endings.nodes == sum(9**k for k in range(1, n + 1))  # each ending once


def test_random_signatures():
    r = random.Random(3)
    endings = Endings()
    for _ in range(400):
        s = "".join(r.choice("suaoSUAOxxuaua") for _ in range(r.randrange(30)))
        assert endings.solve(s) == search(s)


def test_long_signature():
    cost, audit = Endings().solve("ua" * 200_000 + "A")
    assert cost == 3 and len(audit) == 400_001 and audit.count("K") == 400_000


def plain(rows):
    """Results by conversation of (conv_id, turn, role, text)."""
    out, by = {}, {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if kind == 4:
            role = "user"
        by[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, found in by.items():
        def order(x):
            return (x[0] is not None, x[0] or 0, x[1], hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest())
        found.sort(key=order)
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        letters, seen, counts = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in found:
            letter = role[0] if role[:1] and role[0] in "sua" else "o"
            if not text.strip(BLANKS):
                counts["blank"] += 1
                letter = "x"
            elif (role, text) in seen:
                counts["duplicate"] += 1
                letter = "x"
            elif text.rstrip(BLANKS)[-1] not in ".!?":
                counts["truncated"] += 1
                letter = letter.upper()
            seen.add((role, text))
            letters += letter
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        cost, audit = search(letters)
        state, lines, i = "S", [], 0
        go = {"S": ("U", "user"), "P": ("U", "user"), "U": ("A", "assistant"), "A": ("U", "user")}
        for edit in audit:
            if edit == "I":
                state, role = go[state]
                lines.append(role + ":")
                continue
            _, role, text = found[i]
            i += 1
            if edit == "R":
                state, role = go[state]
            elif edit == "K":
                state = {"s": "P", "u": "U", "a": "A"}[role[0]]
            if edit != "D":
                lines.append(role + ":" + text)
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_query_equals_plain_python(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = plain([tuple(r) for r in rows])
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op12_conversations"](spark, sf_dir).collect()}
    assert got == want


def test_odd_rows(spark):
    r = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "User", "", None]
    texts = ["Yes.", "no", " ", "", None, "é!\t", "a b. c"]
    rows = [(r.choice([None, 1, 2, 3, 40]), r.choice([None, 0, 1, 2, 3, 7, -4]), r.choice(roles), r.choice(texts)) for _ in range(300)]
    rows += [(5, 5, "user", "x" * 2_000_000), (6, 15, None, None)]
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], "conv_id long, turn long, role string, text string, audit string, place int").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.digest(df).collect()}
    assert got == plain(rows)
    assert conversations.digest(df.where("false")).count() == 0


def test_dropped_conversations_stay(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert tuple(conversations.digest(df).first()) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_repaired_rows(spark):
    rows = [("c", 0, "system", "Be brief."), ("c", 1, "assistant", "Hi."), ("c", 2, "assistant", "Hi."), ("c", 3, "user", "So")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = conversations.repair(conversations.undamaged(df)).orderBy("place").collect()
    assert [(r["edit"], r["turn"], r["role"], r["text"]) for r in got] == [
        ("K", 0, "system", "Be brief."), ("I", None, "user", ""), ("K", 1, "assistant", "Hi.")
    ]
    assert conversations.audits(conversations.undamaged(df)).first()["cost"] == 8
