import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vulnwave.functions import text as tx


def test_html(scalar):
    html = "<p>a &lt;b&gt; &#8211; &#x41;&amp;lt;<script>var x='<p>'</script><!-- c --><br>d&nbsp;e</p><style>p{}</style>"
    assert scalar(tx.clean_html("h"), "h string", html) == "a <b> – A&lt; d e"
    assert scalar(tx.clean_html("h"), "h string", None) == ""


def test_numeric_entities_without_code(scalar):
    assert scalar(tx.decode_entities("h"), "h string", "a &# b &#; &#x; &#65;") == "a &# b &#; &#x; A"


def test_masks(scalar):
    s = "see https://a.b/c?d, mail x@y.z md5 d41d8cd98f00b204e9800998ecf8427e"
    assert scalar(tx.mask_generic("h"), "h string", s) == "see URL mail EMAIL md5 MD5_HASH"
    sha = "a" * 64
    assert scalar(tx.mask_generic("h"), "h string", sha) == "SHA256_HASH"


def test_mask_order(scalar):
    s = "host 192.168.1.10 v1.2.3"
    assert scalar(tx.mask_domain("h"), "h string", s) == "host IP_ADDRESS vVERSION_NUMBER"
    assert scalar(tx.mask_domain("h", reference_order=True), "h string", s) == "host VERSION_NUMBER.10 vVERSION_NUMBER"


def test_attack_masks(scalar):
    s = "SQLi, cross site scripting, DDoS, remote code execution and CSRF in cve-2024-12345"
    assert scalar(tx.mask_domain("h"), "h string", s) == "SQL_INJECTION, XSS, DOS_ATTACK, RCE and CSRF in CVE_REFERENCE"


def test_tokens(scalar):
    s = "The flaw; it doesn't affect third-party code (v2) in SQL_INJECTION tools' parser."
    assert scalar(tx.tokens("h"), "h string", s) == ["flaw", "affect", "code", "tools", "parser"]
    kept = scalar(tx.tokens("h", keep_masks=True, split_hyphens=True), "h string", s)
    assert kept == ["flaw", "affect", "third", "party", "code", "SQL_INJECTION", "tools", "parser"]


def test_lemmas(scalar):
    words = "attackers vulnerabilities viruses access virus analysis boxes patches Attackers windows processes series"
    got = scalar(F.array_join(tx.lemmatise(F.split("h", " ")), " "), "h string", words)
    assert got == "attacker vulnerability virus access virus analysis box patch Attackers window process series"


def test_clean_text_drops_blank(spark):
    df = spark.createDataFrame([(1, "<p>the 12</p>"), (2, None), (3, "Flaws found")], "i int, t string")
    assert [tuple(r) for r in tx.clean_text(df, "t").select("i", "clean_text").collect()] == [(3, "Flaws found")]


def test_keyword_flag(scalar):
    assert scalar(tx.keyword_flag("h", "poc"), "h string", "an EPOCH") is True
    assert scalar(tx.keyword_flag("h", "poc", word_bounded=True), "h string", "an EPOCH") is False
    assert scalar(tx.keyword_flag("h", "poc"), "h string", None) is False


def test_cves(scalar):
    s = "cve-2021-44228 CVE-2021-44228 and CVE-2020-1234567, not CVE-20-1"
    assert scalar(tx.extract_cves("h"), "h string", s) == ["CVE-2020-1234567", "CVE-2021-44228"]


def test_terms(scalar):
    assert scalar(tx.terms("h", (1, 2)), "h string", "A big Tool, Été x9") == [
        "big", "tool", "été", "x9", "big tool", "tool été", "été x9",
    ]
    assert scalar(tx.terms("h", (1, 2)), "h string", "a") == []
    assert scalar(tx.terms("h", (1, 2)), "h string", "ab") == ["ab"]


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab &#;<>/x1.'-é\n", max_size=40), min_size=1, max_size=8))
def test_cleaning_is_stable(spark, texts):
    """Cleaned words hold letters only, and cleaning them again changes nothing."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    once = tx.clean_text(df, "t", lemmas=False)
    rows = once.select("clean_text", tx.clean_text_expr("clean_text", lemmas=False).alias("again")).collect()
    for r in rows:
        assert r["again"] == r["clean_text"]
        assert all(w.isalpha() for w in r["clean_text"].split())


def test_a_plain_word_answers_for_the_cleaned_text(spark):
    r = random.Random(8)
    parts = ["the", "over", "patched", "Kernel", "sql", "injection", "denialofservice", "denial", "of", "service", "a" * 32, "CVE-2021-44228", "x@y.example"]
    parts += ["http://a.example/some words", "it's", "don't", "&lt;", "<b>", "<!--", "-->", "9.8.7", "ab", "word.", "two-words", "cross site", "scripting", "mots\u00e9"]
    texts = [None, "", " ", *parts] + [r.choice([" ", "\n", "\u00a0", ", "]).join(r.choices(parts, k=r.randint(1, 4))) for _ in range(3_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for options in ({}, {"keep_masks": True, "split_hyphens": True}, {"lemmas": False, "reference_order": True}):
        same = F.trim(tx.clean_text_expr("t", **options)) != ""
        plain = F.col("t").rlike(tx._PLAIN_WORD)
        assert rows.where(same != tx.is_cleaned_to_text("t", **options)).count() == 0
        assert rows.where(same & plain).count() > 500 and rows.where(~same).count() > 50


def test_counted(spark):
    rows = spark.createDataFrame([(["b", "a", "b", "B"],), ([],), (None,), (["x"],)], "w array<string>")
    got = [r[0] for r in rows.select(tx.counted(F.col("w"))).collect()]
    assert got == [[("B", 1), ("a", 1), ("b", 2)], None, None, [("x", 1)]]


def test_words_of_a_text_are_found_once(spark):
    for ngrams in ((1, 1), (1, 2)):
        found = spark.createDataFrame([("a text of words and of words",), ("",), (None,), ("one",)], "t string").select(F.inline(tx.counted(tx.terms("t", ngrams))))
        assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    assert {("of words", 2), ("of", 2), ("words and", 1), ("one", 1)} < {tuple(r) for r in found.collect()} and found.count() == 9
