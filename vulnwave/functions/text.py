"""Text columns: HTML stripping, masks, tokens, lemmas, keyword flags.

Every function maps Column -> Column with built-in functions, so a whole cleaning
chain is one projection in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed

SPACE = r"[\s\p{Z}]+"
WORD_BREAKS = r"""[\s\p{Z},;:@#$%&()\[\]{}<>"“”!?…]+"""
CLITICS = [r"(?i)n't\b", r"(?i)'(?:s|re|ve|ll|d|m)\b"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _replace(c: Column, rules: Iterable[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def squeeze(c: Column | str) -> Column:
    """Collapse white space to single blanks and trim."""
    return F.trim(F.regexp_replace(_col(c), SPACE, " "))


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(c), body), 1)


def _decode_numeric(text: Column, marker: str, digits: str, base: int) -> Column:
    # "a&#8211;b" splits at the marker; each later piece starts with the code.
    head = rf"^({digits});"

    def piece(p: Column, i: Column) -> Column:
        code = F.conv(F.regexp_extract(p, head, 1), base, 16)
        char = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        return (
            F.when(i == 0, p)
            .when(p.rlike(head), F.concat(char, F.regexp_replace(p, head, "")))
            .otherwise(F.concat(F.lit(marker), p))
        )

    return F.array_join(F.transform(F.split(text, marker, -1), piece), "")


def decode_entities(c: Column | str) -> Column:
    """HTML entities to characters: common names, decimal and hex codes."""

    def named(t: Column) -> Column:
        for name, char in fixed.HTML_ENTITIES.items():
            t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
        return t

    def numeric(t: Column) -> Column:
        return _decode_numeric(_decode_numeric(t, "&#x", "[0-9a-fA-F]{1,5}", 16), "&#", "[0-9]{1,6}", 10)

    def decode(t: Column) -> Column:
        coded = F.contains(t, F.lit("&#"))
        plain = F.when(coded, numeric(named(t))).otherwise(named(t))
        return F.when(F.contains(t, F.lit("&")), F.replace(plain, F.lit("&amp;"), F.lit("&"))).otherwise(t)

    return let(_col(c), decode)


def clean_html(c: Column | str) -> Column:
    """Text of an HTML fragment; script, style and comments go, NULL gives ''."""
    bare = _replace(
        F.coalesce(_col(c), F.lit("")),
        [
            (r"(?is)<(script|style)\b.*?</\1\s*>", " "),
            (r"(?s)<!--.*?-->", " "),
            (r"(?s)<[a-zA-Z/!?][^>]*>", " "),
        ],
    )
    return squeeze(decode_entities(bare))


def mask_generic(c: Column | str) -> Column:
    """URLs, mail addresses and hashes become fixed words."""
    return squeeze(
        _replace(
            _col(c),
            [
                (fixed.URL_PATTERN, "URL"),
                (fixed.EMAIL_PATTERN, "EMAIL"),
                (fixed.MD5_PATTERN, "MD5_HASH"),
                (fixed.SHA256_PATTERN, "SHA256_HASH"),
            ],
        )
    )


def mask_domain(c: Column | str, reference_order: bool = False) -> Column:
    """CVE ids, addresses, versions and attack names become fixed words.

    Addresses are masked before versions, else ``192.168.1.10`` would turn into
    ``VERSION_NUMBER.10``; ``reference_order=True`` gives that older order.
    """
    numbers = [(fixed.IP_PATTERN, "IP_ADDRESS"), (fixed.VERSION_PATTERN, "VERSION_NUMBER")]
    if reference_order:
        numbers.reverse()
    return _replace(_col(c), [(fixed.CVE_PATTERN, "CVE_REFERENCE"), *numbers, *fixed.ATTACK_MASKS])


def tokens(
    c: Column | str,
    *,
    keep_masks: bool = False,
    split_hyphens: bool = False,
    stopwords: Iterable[str] = tuple(fixed.STOPWORDS),
) -> Column:
    """Alphabetic words that are not stop words.

    By default a word holding anything but letters is dropped, masks with ``_`` or
    digits included; ``keep_masks`` keeps those, ``split_hyphens`` reads
    ``zero-day`` as two words.
    """
    text = _replace(_col(c), [(p, " ") for p in CLITICS])
    if split_hyphens:
        text = F.regexp_replace(text, r"[-/]", " ")
    words = F.transform(F.split(text, WORD_BREAKS), lambda w: F.btrim(w, F.lit("'.")))
    stop = sorted(stopwords)

    def keep(w: Column) -> Column:
        alpha = w.rlike(r"^\p{L}+$")
        if keep_masks:
            alpha = alpha | w.isin(fixed.MASK_WORDS)
        return alpha & ~F.lower(w).isin(stop) if stop else alpha

    return F.filter(words, keep)


def lemma(w: Column) -> Column:
    """Singular of a lower-case English noun by suffix rule or exception."""
    exceptions = F.create_map(*[F.lit(x) for kv in fixed.LEMMA_EXCEPTIONS.items() for x in kv])
    return (
        F.when(~w.rlike(r"^[a-z]{4,}$") & ~w.isin(list(fixed.LEMMA_EXCEPTIONS)), w)
        .when(w.isin(list(fixed.LEMMA_EXCEPTIONS)), F.element_at(exceptions, w))
        .when(w.rlike(r"(?:ss|us|is)$") | ~w.endswith("s"), w)
        .when(w.endswith("ies"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("(?:sses|xes|zzes|ches|shes)$"), F.regexp_replace(w, "es$", ""))
        .otherwise(F.regexp_replace(w, "s$", ""))
    )


def lemmatise(words: Column) -> Column:
    """`lemma` over an array of words."""
    return F.transform(words, lemma)


def clean_text_expr(
    c: Column | str,
    *,
    lemmas: bool = True,
    keep_masks: bool = False,
    split_hyphens: bool = False,
    reference_order: bool = False,
) -> Column:
    """HTML -> masks -> tokens -> lemmas -> one blank-separated string."""
    masked = mask_domain(mask_generic(clean_html(c)), reference_order=reference_order)
    words = tokens(masked, keep_masks=keep_masks, split_hyphens=split_hyphens)
    return F.array_join(lemmatise(words) if lemmas else words, " ")


def clean_text(df: DataFrame, col: str, out: str = "clean_text", **options: bool) -> DataFrame:
    """Add the cleaned text and drop rows where nothing is left.

    The row is dropped by exploding an array of zero or one texts: a plain filter
    would be pushed below the projection and run the whole chain twice.
    """
    one = F.filter(F.array(clean_text_expr(col, **options)), lambda t: F.trim(t) != "")
    kept = [c for c in df.columns if c != out]
    return df.select(*kept, F.explode(one).alias(out))


# A word between blanks that no step of cleaning changes or drops: letters only, too short for a hash, no stop word, and without
# any part of the names that are masked.
_MASKED = sorted({w for pattern, _ in fixed.ATTACK_MASKS for w in re.findall("[a-z]{2,}", pattern)})
_PLAIN_WORD = rf"(?<![^ \n])(?i)(?!(?:{'|'.join(sorted(w for w in fixed.STOPWORDS if w.isalpha()))})(?![^ \n]))(?![a-z]*(?:{'|'.join(_MASKED)}))[a-z]{{4,20}}(?![^ \n])"


def is_cleaned_to_text(c: Column | str, **options: bool) -> Column:
    """Whether ``clean_text_expr`` leaves anything of a text. Without tags and entities one plain word answers for the whole."""
    text = _col(c)
    tagged = F.contains(text, F.lit("<")) | F.contains(text, F.lit("&"))
    whole = F.trim(clean_text_expr(text, **options)) != ""
    return F.when(~tagged & text.rlike(_PLAIN_WORD), F.lit(True)).otherwise(whole)


def is_blank(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), SPACE, " ")) == ""


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """Rows whose text is neither NULL nor white space."""
    return df.filter(~is_blank(col))


def keyword_flag(c: Column | str, pattern: str, word_bounded: bool = False) -> Column:
    """Case-insensitive 'contains a match', NULL gives false."""
    body = rf"\b(?:{pattern})\b" if word_bounded else pattern
    return F.coalesce(_col(c).rlike(f"(?i){body}"), F.lit(False))


def extract_cves(c: Column | str) -> Column:
    """Sorted distinct CVE ids of a text, upper case."""
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(fixed.CVE_PATTERN), 0)
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def text_length(c: Column | str) -> Column:
    """Length in thousands of characters, NULL counts as 0."""
    return F.coalesce(F.length(_col(c)), F.lit(0)) / F.lit(1000.0)


def terms(c: Column | str, ngrams: tuple[int, int] = (1, 1)) -> Column:
    """Lower-case words of two or more word characters, plus word pairs if asked."""
    unigrams = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    if ngrams == (1, 1):
        return unigrams
    if ngrams != (1, 2):
        raise ValueError("ngrams is (1, 1) or (1, 2)")

    def with_pairs(words: Column) -> Column:
        following = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
        return F.concat(words, F.array_compact(F.zip_with(words, following, lambda a, b: F.concat(a, F.lit(" "), b))))

    return let(unigrams, with_pairs)


def counted(words: Column) -> Column:
    """Distinct words of an array and how often each stands there, as structs (term, n). No word is null."""

    def starts(w: Column) -> Column:
        return F.array_compact(F.transform(w, lambda x, i: F.when((i == 0) | (x != F.get(w, i - 1)), i)))

    def runs(w: Column) -> Column:
        ends = lambda s: F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(w)))
        pair = lambda a, b: F.struct(F.get(w, a).alias("term"), (b - a).alias("n"))
        return F.when(F.size(w) > 0, let(starts(w), lambda s: F.zip_with(s, ends(s), pair)))

    return let(F.sort_array(words), runs)
