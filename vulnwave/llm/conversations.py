"""Conversation structure repair over a suffix-shared automaton of signatures.

Each row of a conversation has a role and at most one fault: ``blank`` (nothing but the six ASCII blanks), ``duplicate`` (role and text
seen earlier in the conversation) or ``truncated`` (the last other character is none of ``.!?``). A signature has one letter a
row: s, u, a for the initial of its role, o for others, upper case if truncated, x for blank or duplicate. The edits are Keep (0),
Rerole to user or assistant (2), Delete (3, the only one for x), Insert of an empty user or assistant text anywhere (2); a truncated row
that stays costs 1 more. The cheapest edits that give initials of the form (s?(ua)+)? are made; of several the one whose initials, read as
text, are least in ASCII.

Distinct signatures are sorted from their ends, so that those that share an ending follow each other: they are the paths of an automaton
that is minimal from the end, a node for each distinct ending. A node has, for each of the four states of the grammar, the cost to go and the first
edits of the best audit; both are found once for all conversations that pass it. Audits are compared by ranks, never
written out: what differs between two is the edits up to the next row, or the rank of what follows. Costs matter by their differences only,
so that nodes of equal differences and ranks share one shape and one set of moves.

Rows are ordered by turn (nulls first), rows of a turn by role and then by the MD5 of role and text. Null roles and texts are one blank. Rows that
are repeated count as often as they stand there. A null id is a conversation of its own. An empty table gives no rows. Other columns
are ignored. Rows stream through in order; of one conversation a task holds 16 bytes a row, its signature and audit, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnwave.llm.util import small_batches
from vulnwave.session import stored

BLANKS = " \t\n\x0b\f\r"
START, PREFACED, ASKED, ANSWERED = range(4)
STATES = range(4)
# State after a user or an assistant that is put in, by the state before.
GO = (ASKED, ASKED, ANSWERED, ASKED)
KEEP = {(START, "s"): PREFACED, (START, "u"): ASKED, (PREFACED, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
NAMES = {ASKED: "user", ANSWERED: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# A signature of more than this share of all conversations is hot; there are fewer than a thousand.
HOT_SHARE = 0.001


class Shape:
    """Per state: cost beyond the least, first edits, state after them, rank of the whole audit among the four."""

    __slots__ = ("costs", "edits", "then", "ranks")

    def __init__(self, costs: tuple, edits: tuple, then: tuple, ranks: tuple):
        self.costs, self.edits, self.then, self.ranks = costs, edits, then, ranks


class Endings:
    """The automaton along one path: ``solve`` takes signatures in the order of their reversed forms."""

    def __init__(self) -> None:
        self._shapes: dict[tuple, Shape] = {}
        self._moves: dict[tuple[str, Shape], tuple[Shape, int]] = {}
        self.end = self._shape((0, 4, 2, 0), ("", "II", "I", ""), (START, PREFACED, ASKED, ANSWERED), (0, 2, 1, 0))
        self._path = [self.end]
        self._costs = [0]
        self._last = ""
        self.nodes = 0  # made so far

    def _shape(self, *of: tuple) -> Shape:
        return self._shapes.setdefault(of, Shape(*of))

    def _before(self, symbol: str, after: Shape) -> tuple[Shape, int]:
        """Shape of a row followed by ``after``, and what the least cost grows by."""
        found = self._moves.get((symbol, after))
        if found:
            return found
        stays = TRUNCATED if symbol.isupper() else 0
        best = []
        for state in STATES:
            ways = [(DELETE + after.costs[state], "D", after.ranks[state], state)]
            if symbol != "x":
                to = GO[state]
                ways.append((REROLE + stays + after.costs[to], "R", after.ranks[to], to))
                to = KEEP.get((state, symbol.lower()))
                if to is not None:
                    ways.append((stays + after.costs[to], "K", after.ranks[to], to))
            best.append(min(ways))
        # one insertion leads from asked to answered and back; two in a row would be for nothing there
        rows = list(best)
        for state, other in ((ASKED, ANSWERED), (ANSWERED, ASKED), (START, ASKED), (PREFACED, ASKED)):
            cost, edits, rank, to = (rows if state >= ASKED else best)[other]
            best[state] = min(best[state], (INSERT + cost, "I" + edits, rank, to))
        least = min(b[0] for b in best)
        order = sorted({b[1:3] for b in best})
        made = self._shape(tuple(b[0] - least for b in best), tuple(b[1] for b in best), tuple(b[3] for b in best), tuple(order.index(b[1:3]) for b in best))
        self._moves[(symbol, after)] = made, least
        return made, least

    def solve(self, signature: str) -> tuple[int, str]:
        """Cost and audit. Nodes of the ending shared with the signature before are taken as they are."""
        backward = signature[::-1]
        shared = 0
        for a, b in zip(backward, self._last):
            if a != b:
                break
            shared += 1
        del self._path[shared + 1 :], self._costs[shared + 1 :]
        for symbol in backward[shared:]:
            shape, more = self._before(symbol, self._path[-1])
            self._path.append(shape)
            self._costs.append(self._costs[-1] + more)
        self.nodes += len(backward) - shared
        self._last = backward
        state, audit = START, []
        for shape in reversed(self._path):
            audit.append(shape.edits[state])
            state = shape.then[state]
        return self._costs[-1] + self._path[-1].costs[START], "".join(audit)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copy, gone: the rows with faults put in by crc32 of ``conv_id:turn`` modulo 20 (0 drops the row,
    which stays here with ``gone``, 1 empties the text, 2 takes its ``.!?`` away, 3 repeats the row, 4 makes it a user's)."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    kind = F.crc32(name) % 20
    words = F.coalesce(F.col(text).cast("string"), blank)
    return rows.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col(role).cast("string"), blank)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(words, ".!?", "")).otherwise(words).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (kind == 0).alias("gone"),
    )


def undamaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as they are, in the form of ``damaged``."""
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), *words, F.lit(0).alias("copy"), F.lit(False).alias("gone"))


def _mark() -> Column:
    """MD5 of role and text."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


_ORDER = ["turn", "role", "mark", "copy"]  # ascending: nulls come first


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal (longs), signature of every conversation. Rows without their texts are moved."""
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    end = F.when(last == "", F.lit(0)).when(last.isin(".", "!", "?"), F.lit(1)).otherwise(F.lit(2))
    narrow = small_batches(rows.select("conv_id", "turn", "role", "copy", "gone", end.alias("end"), _mark().alias("mark")))
    narrow = narrow.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)
    kind = narrow.schema["conv_id"].dataType
    counted = ["gaps", "blank", "duplicate", "truncated", "illegal"]
    schema = f"conv_id {kind.simpleString()}, {', '.join(f'{c} long' for c in counted)}, signature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        current: _Counts | None = None
        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "gone", "end", "mark")]
            for conv, turn, role, gone, end, mark in zip(*columns):
                if current is None or conv != current.conv:
                    if current is not None:
                        done.append(current.result())
                    current = _Counts(conv)
                if not gone:
                    current.add(turn, role, end, mark)
            if len(done) > 1_000:
                yield _table(done, conv_type)
                done = []
        if current is not None:
            yield _table([*done, current.result()], conv_type)

    def _table(done: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
        types = [conv_type, *[pa.int64()] * len(counted), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=["conv_id", *counted, "signature"])

    return narrow.mapInArrow(run, schema)


class _Counts:
    """Faults of one conversation, row by row."""

    def __init__(self, conv) -> None:
        self.conv = conv
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.before: str | None = None
        self.letters = bytearray()

    def add(self, turn: int | None, role: str, end: int, mark: bytes) -> None:
        if turn is not None and turn != self.last:  # in order of turns
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        letter = initial if initial in ("s", "u", "a") else "o"
        if end == 0:
            self.blank += 1
            letter = "x"
        elif mark in self.seen:
            self.duplicate += 1
            letter = "x"
        elif end == 2:
            self.truncated += 1
            letter = letter.upper()
        self.seen.add(mark)
        self.letters += letter.encode()

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.letters.decode()


def solved(of: DataFrame) -> DataFrame:
    """signature, n (how many conversations have it), cost, audit of each distinct signature."""
    distinct = of.groupBy("signature").agg(F.count("*").alias("n")).withColumn("backward", F.reverse("signature"))
    ranged = distinct.repartitionByRange("backward").sortWithinPartitions("backward").select("signature", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings = Endings()
        for batch in batches:
            found = [endings.solve(s.as_py()) for s in batch.column("signature")]
            new = [pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=["signature", "n", "cost", "audit"])

    return small_batches(ranged).mapInArrow(run, "signature string, n long, cost long, audit string")


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation. rows: those of ``damaged``."""
    found = stored(signatures(rows), "signatures")
    best = stored(solved(found), "audits")
    total = found.count()
    # a hot signature would bring all its conversations to one task; there are fewer than 1 / HOT_SHARE of them
    hot = F.col("n") > HOT_SHARE * total
    often = found.join(F.broadcast(best.where(hot).drop("n")), "signature")
    rare = found.join(F.broadcast(best.where(hot).select("signature")), "signature", "left_anti").join(best.where(~hot).drop("n"), "signature")
    return often.unionByName(rare).drop("signature")


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the repaired conversations in order, each conversation after a row (kind 0) of its counts and audit."""
    heads = found.select("conv_id", F.lit(0).alias("kind"), *_COUNTS, "audit")
    body = rows.where("not gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", _mark().alias("mark"), "copy", "text")
    both = small_batches(heads.unionByName(body, allowMissingColumns=True))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER)
    kind = both.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "kind", *_COUNTS, "audit", "place", "edit", "turn", "role", "text"]
    schema = f"conv_id {kind}, kind int, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, place long, edit string, turn long, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, conv = "", 0, START, 0, None
        none = (None,) * (len(_COUNTS) + 1)
        types = None

        def inserted() -> Iterator[tuple]:
            nonlocal at, state, place
            while audit[at : at + 1] == "I":
                at += 1
                state = GO[state]
                yield (conv, 1, *none, place, "I", None, NAMES[state], "")
                place += 1

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            types = [conv_type, pa.int32(), *[pa.int64()] * len(_COUNTS), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            out: list[tuple] = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    out.extend(inserted())
                    audit, at, state, place, conv = r["audit"], 0, START, 0, r["conv_id"]
                    out.append((conv, 0, *(r[c] for c in _COUNTS), audit, None, None, None, None, None))
                    continue
                out.extend(inserted())
                edit = audit[at]
                at += 1
                if edit == "D":
                    continue
                role = r["role"]
                if edit == "R":
                    state = GO[state]
                    role = NAMES[state]
                else:
                    state = KEEP[(state, role[:1])]
                out.append((conv, 1, *none, place, edit, r["turn"], role, r["text"]))
                place += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        out = list(inserted())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return both.mapInArrow(run, schema)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), turn, role, text of the repaired conversations. rows: those of ``damaged`` or ``undamaged``."""
    done = _repaired(rows, audits(rows))
    return done.where("kind = 1").select("conv_id", "place", "edit", "turn", "role", "text")


def digest(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the damaged conversations, repaired."""
    rows = damaged(conversations)
    done = _repaired(rows, audits(rows))
    kind = done.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, hashed, types = None, None, None
        for batch in batches:
            types = [batch.schema.field("conv_id").type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
            out = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if head is not None:
                        out.append((*head, hashed.hexdigest()))
                    head, hashed = tuple(r[c] for c in names[:-1]), hashlib.sha256()
                else:
                    hashed.update((("\n" if r["place"] else "") + r["role"] + ":" + r["text"]).encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        if head is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*head, hashed.hexdigest()), types)], names=names)

    schema = f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"
    return done.mapInArrow(run, schema)
