"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

``base_spans`` finds what the patterns define. The field then reads the neighbourhoods of digits, ``@`` and written-out ``at``
signs: a neighbourhood is cut into tokens, every run of up to ``MAX_TOKENS`` tokens that could be an entity is a candidate
segment of a type, and a segment is scored as a whole (number of digits, grouping, check sum, separators, what
stands before and after it). Dynamic programming over the tokens chooses the boundaries and types of all segments
together. Spans it finds that touch no base span are added; base spans stay.

The field is trained here, by gradient ascent on the conditional likelihood, with entities and look-alikes written into the
words of a bounded sample of documents (``TRAIN_DOCS`` by hash, ``TRAIN_CHARS`` characters each); without any, into fixed filler words.

Positions are code points, ends exclusive. Null and empty texts have no spans. Texts of any length are read
whole; a task holds one piece of a few megabytes, and a neighbourhood grows with what it holds only. Rows aren't
compared, so null ids and repeated rows need no care; columns of other names pass through or are left alone.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnwave.llm import util
from vulnwave.llm.util import slices, small_batches

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
PIECE_BYTES = 4_000_000
TRAIN_DOCS = 200
TRAIN_CHARS = 400
AROUND = 40

Span = tuple[str, int, int]

# The patterns that define base spans. The look-behinds only save attempts that would fail.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_DIGIT = re.compile("[0-9]")
_NOT_DIGITS = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def octets(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _emails(text: str) -> Iterator[Span]:
    """Matches around each @, so that long runs of letters cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            end = found.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[Span]:
    """Spans of the base patterns, by kind and start."""
    if not text:
        return []
    spans = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            spans += [("ip", *m.span()) for m in IP.finditer(text) if octets(m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = _NOT_DIGITS.sub("", m.group())
                if 13 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_NOT_DIGITS.sub("", m.group())) <= 15:
                    spans.append(("phone", *m.span()))
    return spans


# ---- candidate segments

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)
TRIGGER = re.compile(r"[0-9][0-9\x20()./\[\]-]{5,}[0-9]|@|[\[(]\s?at\s?[\])]|\bat\s[\w-]{1,30}\s(?:dot|\.)\s", re.IGNORECASE)
SEPARATORS = frozenset(" ()./-[]")
AT = re.compile(r"\s?(?:@|[\[(]\s?at\s?[\])])\s?|\sat\s", re.IGNORECASE)
DOT = re.compile(r"\s?(?:\.|[\[(]\s?(?:dot|\.)\s?[\])])\s?|\sdot\s", re.IGNORECASE)
DOMAIN_ON = re.compile(r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)[a-z0-9]", re.IGNORECASE)
MAILBOX = re.compile(r"[a-z0-9](?:[a-z0-9._%+-]*[a-z0-9])?", re.IGNORECASE)
LABEL = re.compile(r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?", re.IGNORECASE)
OCTETS = re.compile(r"[0-9]{1,3}(?:(?:\s?\.\s?|\s?[\[(]\.[\])]\s?)[0-9]{1,3}){3}")
CUES = {
    "email": frozenset("mail email contact write courriel correo kontakt".split()),
    "ip": frozenset("ip host server address addr adresse from".split()),
    "card": frozenset("card visa credit mastercard carte karte tarjeta payment".split()),
    "phone": frozenset("phone tel call mobile fax telephone telefon téléphone teléfono dial".split()),
}
# Ends of domains that the field knows; others count against a span.
ENDINGS = frozenset("com org net edu gov io info biz de fr es uk eu us ca example test invalid".split())


@dataclass(frozen=True)
class Segment:
    kind: str
    start: int  # first token
    end: int  # one past the last token
    features: tuple[str, ...]


def _number(kind: str, body: str) -> list[str] | None:
    groups = re.findall("[0-9]+", body)
    digits = "".join(groups)
    seps = set(_DIGIT.sub("", body.lstrip("+(")))
    if kind == "phone" and not 9 <= len(digits) <= 15 or kind == "card" and not 13 <= len(digits) <= 19:
        return None
    sizes = "-".join(str(len(g)) for g in groups[-3:])
    out = [f"digits={len(digits)}", f"groups={min(len(groups), 6)}", f"sizes={sizes}", f"kinds of separators={min(3, len(seps))}"]
    out += ["plus"] * body.startswith("+") + ["paren"] * ("(" in body) + ["luhn" if luhn(digits) else "no luhn"]
    out += ["balanced" if body.count("(") == body.count(")") else "unbalanced"] + ["square"] * bool({"[", "]"} & set(body))
    out += ["even groups"] * (len(groups) > 2 and len({len(g) for g in groups}) == 1) + ["one group"] * (len(groups) == 1)
    out += ["slash"] * ("/" in body) + ["small groups"] * (len(groups) > 1 and max(map(len, groups)) < 3) + ["double space"] * ("  " in body)
    out += ["date"] * bool(re.search(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?![0-9])", body))
    return out


def _segment(kind: str, body: str) -> list[str] | None:
    """Whole-span features of a text as a type, None if it can't be one."""
    if kind in ("phone", "card"):
        if not set(body.lstrip("+")) <= SEPARATORS | set("0123456789") or body[0] not in "+(0123456789" or not body[-1].isdigit():
            return None
        return _number(kind, body)
    if kind == "ip":
        if not OCTETS.fullmatch(body) or not octets(re.findall("[0-9]+", body)):
            return None
        return ["spaced"] * (" " in body) + ["bracketed"] * ("[" in body or "(" in body) + ["plain"] * bool(re.fullmatch("[0-9.]+", body))
    at = AT.search(body)
    if not at or not MAILBOX.fullmatch(body[: at.start()]) or AT.search(body, at.end()):
        return None
    labels = DOT.split(body[at.end() :])
    if len(labels) < 2 or not all(LABEL.fullmatch(x) for x in labels):
        return None
    marks = [m.group().strip().lower() for m in DOT.finditer(body[at.end() :])]
    out = ["at=" + at.group().strip().lower().strip("[]() "), "at bracketed" if at.group().strip()[:1] in "[(" else "at bare"]
    out += ["dot written" if "dot" in marks[-1] else "dot"] + ["known ending" if labels[-1].lower() in ENDINGS else "other ending"]
    return out + ["capital after dot"] * labels[-1][:1].isupper()


def _context(kind: str, text: str, start: int, end: int) -> list[str]:
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    out = ["joined before"] * (before.isalnum() or before in "+@_.-/") * bool(before) + ["joined after"] * (after.isalnum() or after in "@_") * bool(after)
    more = text[end : end + 3]
    out += ["number goes on"] * bool(re.match(r"[\x20./()-]{0,2}[0-9]", more)) * (kind != "email")
    before = text[max(0, start - 3) : start]
    out += ["domain goes on"] * bool(kind == "email" and DOMAIN_ON.match(text, end))
    out += ["number before"] * bool(re.search(r"[0-9][\x20./()-]{0,2}$", before)) * (kind != "email")
    words = re.findall(r"[^\W\d_]+", text[max(0, start - AROUND) : start].lower())[-3:]
    return out + ["cue"] * bool(CUES[kind] & set(words))


def segments(text: str, low: int, high: int) -> tuple[int, list[Segment], list[tuple[int, int]]]:
    """Tokens of text[low:high] (count and places) and the candidate segments over them."""
    places = [m.span() for m in TOKEN.finditer(text, low, high)]
    found = []
    for i, (start, _) in enumerate(places):
        first = text[start]
        number, word = first.isascii() and (first.isdigit() or first in "+("), first.isascii() and first.isalnum()
        if not number and not word:
            continue
        if number and not word and not any(text[places[k][0]].isdigit() for k in range(i + 1, min(i + 3, len(places)))):
            continue
        kinds = (["phone", "card"] if number else []) + (["ip"] if first.isdigit() else []) + (["email"] if word else [])
        digits = 0
        for j in range(i, min(i + MAX_TOKENS, len(places))):
            a, b = places[j]
            token = text[a:b]
            if token[0].isdigit() and token.isascii():
                digits += len(token)
            elif "phone" in kinds and j > i and not set(token) <= SEPARATORS:
                kinds = [k for k in kinds if k == "email"]
            if digits > 19:
                kinds = [k for k in kinds if k == "email"]
            if not kinds:
                break
            if not token[-1].isalnum() or not token.isascii():
                if b - start > 100:
                    break
                continue
            body = text[start:b]
            for kind in kinds:
                if kind in ("phone", "card") and digits < 9 or kind == "email" and j == i:
                    continue
                own = _segment(kind, body)
                if own is not None:
                    names = ("is", *own, *_context(kind, text, start, b))
                    found.append(Segment(kind, i, j + 1, tuple(f"{kind}:{n}" for n in names)))
    return len(places), found, places


def neighbourhoods(text: str) -> Iterator[tuple[int, int]]:
    """Places around the triggers, those that touch taken together."""
    low = high = -1
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if a <= high:
            high = b
            continue
        if high > 0:
            yield low, high
        low, high = a, b
    if high > 0:
        yield low, high


# ---- the field


def _log_add(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log1p(math.exp(min(a, b) - m))


class SemiMarkovField:
    """Scores of segmentations: the sum over segments of their features' weights; other tokens score 0."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, segment: Segment) -> float:
        get = self.weights.get
        # a feature never met in training counts like a rare one: against the span
        return sum(get(f, -0.5) for f in segment.features)

    def decode(self, n: int, found: list[Segment]) -> list[Segment]:
        """The best segmentation."""
        ending: dict[int, list[tuple[float, Segment]]] = {}
        for s in found:
            value = self.score(s)
            if value > 0:
                ending.setdefault(s.end, []).append((value, s))
        if not ending:
            return []
        best, chosen = [0.0] * (n + 1), [None] * (n + 1)
        for i in range(1, n + 1):
            best[i] = best[i - 1]
            for value, s in ending.get(i, ()):
                if best[s.start] + value > best[i]:
                    best[i], chosen[i] = best[s.start] + value, s
        out, i = [], n
        while i > 0:
            s = chosen[i]
            if s is None:
                i -= 1
            else:
                out.append(s)
                i = s.start
        return out[::-1]

    def marginals(self, n: int, found: list[Segment]) -> list[float]:
        """Probability of each candidate, by the forward and backward sums."""
        scores = [self.score(s) for s in found]
        ahead: list[list[int]] = [[] for _ in range(n + 1)]
        behind: list[list[int]] = [[] for _ in range(n + 1)]
        for k, s in enumerate(found):
            ahead[s.end].append(k)
            behind[s.start].append(k)
        forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
        for i in range(1, n + 1):
            total = forward[i - 1]
            for k in ahead[i]:
                total = _log_add(total, forward[found[k].start] + scores[k])
            forward[i] = total
        for i in range(n - 1, -1, -1):
            total = backward[i + 1]
            for k in behind[i]:
                total = _log_add(total, backward[found[k].end] + scores[k])
            backward[i] = total
        return [math.exp(forward[s.start] + v + backward[s.end] - forward[n]) for s, v in zip(found, scores)]


def train(examples: list[tuple[str, list[Span]]], rounds: int = 40, step: float = 0.5, decay: float = 0.002) -> SemiMarkovField:
    """Weights that maximise the likelihood of the examples' spans (AdaGrad, L2)."""
    ready = []
    for text, spans in examples:
        n, found, places = segments(text, 0, len(text))
        gold = set(spans)
        ready.append((n, found, [(s.kind, places[s.start][0], places[s.end - 1][1]) in gold for s in found]))
    field = SemiMarkovField({f: 0.0 for _, found, _ in ready for s in found for f in s.features})
    seen = dict.fromkeys(field.weights, 1e-8)
    for _ in range(rounds):
        slope = {f: -decay * len(ready) * w / 100 for f, w in field.weights.items()}
        for n, found, gold in ready:
            for s, p, is_gold in zip(found, field.marginals(n, found), gold):
                move = is_gold - p
                if abs(move) > 1e-4:
                    for f in s.features:
                        slope[f] += move
        for f, g in slope.items():
            seen[f] += g * g
            field.weights[f] += step * g / math.sqrt(seen[f])
    return field


# ---- training examples

FILLER = "the of and that order number was sent on for it with la de que und der ist para con une par".split()


def _entity(kind: str, r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 8)))
    if kind == "phone":
        a, b, c = str(r.randint(2, 9)) + d(2), d(3), d(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"+{r.randint(30, 49)} {d(3)} {d(3)} {d(4)}", f"00{r.randint(30, 49)} {d(3)} {d(3)} {d(3)}", f"({a}){b}-{c}", f"({a}) {b} {c}"])
    if kind == "card":
        body = r.choice("3456") + d(14)
        body += next(x for x in "0123456789" if luhn(body + x))
        parts = [body[i : i + 4] for i in range(0, 16, 4)]
        return r.choice([body, " ".join(parts), "-".join(parts), ".".join(parts), "/".join(parts), "  ".join(parts)])
    if kind == "ip":
        parts = [str(r.randint(1, 254)) for _ in range(4)]
        return r.choice([".".join(parts), "[.]".join(parts), "(.)".join(parts), " . ".join(parts), "[.]".join(parts)])
    name, host, end = w() + r.choice(["", "." + w(), d(2)]), r.choice(["", "", w() + "."]) + w(), r.choice(sorted(ENDINGS))
    return r.choice([f"{name}@{host}.{end}", f"{name} [at] {host}.{end}", f"{name} (at) {host} (dot) {end}", f"{name} at {host} dot {end}", f"{name} [at] {host} [dot] {end}", f"{name} @ {host}.{end}"])


def _lookalike(r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    bad = d(16)
    while luhn(bad):
        bad = d(16)
    parts = [bad[i : i + 4] for i in range(0, 16, 4)]
    return r.choice([
        f"20{d(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)} 1{r.randint(0, 9)}:{d(2)}:{d(2)}", d(10), d(9), d(11), d(12), d(15), bad, " ".join(parts), ".".join(parts),
        f"{d(2)}.{d(3)}.{d(3)},{d(2)}", f"{d(3)} {d(3)} {d(3)}", f"{d(1)}.{d(1)}.{d(2)}", f"19{d(2)}-20{d(2)} 19{d(2)}", f"{d(4)} {d(5)} {d(3)}",
        f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", "look at this. Then", "met at noon . It", "5 @ 3.50 each", f"{d(3)}.{d(3)}.{d(3)}.{d(3)}.{d(2)}",
        f"{d(5)}-{d(5)}", f"{d(1)} {d(1)} {d(1)} {d(1)} {d(1)} {d(1)} {d(1)} {d(1)} {d(1)}", f"{d(2)}/{d(2)}/{d(4)} {d(2)}/{d(2)}/{d(4)}", f"{d(4)}.{d(4)}.{d(4)}", f"{d(20)}",
    ])


def examples(words: list[str], n: int = 500, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Texts of the words with entities and look-alikes in them, and where the entities are."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            text += " ".join(r.choice(words) for _ in range(r.randint(1, 6)))
            pick = r.random()
            if pick < 0.55:
                kind = r.choice(KINDS)
                if r.random() < 0.25:
                    text += " " + r.choice(sorted(CUES[kind])) + r.choice(["", ":"])
                body = _entity(kind, r)
                text += " "
                spans.append((kind, len(text), len(text) + len(body)))
                text += body + r.choice([" ", ", ", ". ", " "])
            elif pick < 0.95:
                text += " " + _lookalike(r) + r.choice([" ", ", ", ". "])
            else:
                text += ". "
        out.append((text, spans))
    return out


def fit(docs: DataFrame, text: str = "text") -> SemiMarkovField:
    """The field, trained with words of at most ``TRAIN_DOCS`` different documents (of those that a hash test lets through, the
    least hashes), so that what reaches the driver doesn't grow with the table."""
    n = docs.count()
    rows = docs.where(F.length(text) > 0).select(F.xxhash64(text).alias("h"), F.substring(text, 1, TRAIN_CHARS).alias("t"))
    near = rows.where(F.shiftrightunsigned("h", 11) / float(2**53) < min(1.0, 8.0 * TRAIN_DOCS / max(n, 1)))
    found = near.distinct().orderBy("h", "t").limit(TRAIN_DOCS).collect()
    words = [w for r in found for w in r["t"].split() if w.isalpha()]
    return train(examples(words[:5000] or FILLER))


def all_spans(text: str | None, field: SemiMarkovField) -> tuple[list[Span], list[Span]]:
    """Base spans, and the spans that the field adds."""
    base = base_spans(text)
    added: list[Span] = []
    if text:
        taken = sorted((a, b) for _, a, b in base)
        for low, high in neighbourhoods(text):
            n, found, places = segments(text, low, high)
            near = [(a, b) for a, b in taken if a < high and b > low] if taken else []
            free = [s for s in found if not any(a < places[s.end - 1][1] and b > places[s.start][0] for a, b in near)]
            added += [(s.kind, places[s.start][0], places[s.end - 1][1]) for s in field.decode(n, free)]
    return base, added


def joined(spans: list[Span]) -> str:
    """kind:start:end, by kind and start, comma-joined."""
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def find(docs: DataFrame, field: SemiMarkovField, text: str = "text", out: str = "pii") -> DataFrame:
    """All columns of ``docs`` with the spans of ``text`` in ``out``, by kind and start (replaced if it is there already)."""
    kept = small_batches(docs).drop(out)
    weights = field.weights
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        util.kept("pii")
        own = SemiMarkovField(weights)
        for piece in slices(batches, text, PIECE_BYTES):
            rows = []
            for t in piece.column(text).to_pylist():
                base, added = all_spans(t, own)
                spans = [(*s, True) for s in base] + [(*s, False) for s in added]
                spans.sort(key=lambda s: (order[s[0]], s[1], s[2]))
                rows.append([{"kind": k, "start": a, "end": b, "base": c} for k, a, b, c in spans])
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(rows, _SPANS_ARROW)], names=[*piece.schema.names, out])

    return kept.mapInArrow(run, T.StructType(kept.schema.fields + [T.StructField(out, SPANS)]))


def redact(docs: DataFrame, field: SemiMarkovField, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with every span of ``text`` replaced by its kind in angle brackets; where spans overlap,
    the whole stretch by the kind of the first. Null stays null."""

    def clean(t: str | None, own: SemiMarkovField) -> str | None:
        if not t:
            return t
        base, added = all_spans(t, own)
        out, end = [], 0
        for k, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
            if a >= end:
                out += [t[end:a], f"<{k.upper()}>"]
            end = max(end, b)
        return "".join(out) + t[end:]

    weights, names = field.weights, docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        util.kept("pii")
        own = SemiMarkovField(weights)
        for piece in slices(batches, text, PIECE_BYTES):
            columns = list(piece.columns)
            columns[at] = pa.array([clean(t, own) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=piece.schema.names)

    return small_batches(docs).mapInArrow(run, docs.schema)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans as text, and how many the field added."""
    found = find(docs.select("doc_id", "text"), fit(docs)).drop("text")
    base = F.filter("pii", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    added = F.size("pii") - F.size(base)
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"), added.cast("long").alias("n_added"))
