import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from vulnwave import schemas
from vulnwave.sources import articles as art
from vulnwave.sources import cwe, feeds, nvd


def _cve(spark, **fields):
    return spark.createDataFrame([({"id": "CVE-1", **fields},)], schemas.RAW_CVE)


def test_read_feed(spark, tmp_path):
    a = [{"source": "NVD", "cve_id": "CVE-1", "cvss_score": 5.0, "published_date": "2024-01-02", "products": ["x"]}]
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text(json.dumps(a))
    (tmp_path / "sub" / "b.json").write_text(json.dumps({"url": "u", "text": "t", "cves": []}))
    (tmp_path / "bad.json").write_text("{not json")
    with gzip.open(tmp_path / "c.json.gz", "wt") as f:
        json.dump([{"source": "The News", "url": "v"}], f)
    df = feeds.read_feed(spark, str(tmp_path))
    rows = {(r["source"], r["cve_id"] or r["url"]) for r in df.collect()}
    assert rows == {("nvd", "CVE-1"), ("thehackernews", "u"), ("thehackernews", "v")}
    assert feeds.corrupt_records(spark, str(tmp_path)).count() == 1


def test_write_json(spark, tmp_path):
    df = spark.createDataFrame([("u", ["a", "b"])], "url string, tags array<string>")
    feeds.write_json(df, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).select("url", "tags").collect() == df.collect()


def _score(spark, **metrics):
    row = nvd.flatten_cve(_cve(spark, metrics=metrics)).first()
    return row["cvss_score"], row["severity"]


def test_cvss_pick(spark):
    v = lambda score, sev=None: [{"cvssData": {"baseScore": score, "baseSeverity": sev}}]
    v2 = lambda score, sev=None: [{"cvssData": {"baseScore": score}, "baseSeverity": sev}]
    assert _score(spark, cvssMetricV31=v(None, "HIGH"), cvssMetricV2=v2(5.0, "MEDIUM")) == (5.0, "MEDIUM")
    assert _score(spark, cvssMetricV40=v(9.1, "CRITICAL"), cvssMetricV2=v2(5.0, "MEDIUM")) == (9.1, "CRITICAL")
    assert _score(spark, cvssMetricV31=v(7.0)) == (7.0, "Unknown")
    assert _score(spark, cvssMetricV31=v(None, "HIGH"), cvssMetricV30=v(None, "LOW")) == (None, "LOW")
    assert _score(spark) == (None, "Unknown")


def _products(spark, *matches):
    nodes = [{"cpeMatch": [{"vulnerable": True, **m} for m in matches]}]
    return nvd.flatten_cve(_cve(spark, configurations=[{"nodes": nodes}])).first()["products"]


def test_cpe_products(spark):
    head = "cpe:2.3:a:acme:web_server:"
    assert _products(spark, {"criteria": head + "1.2:*"}) == ["Acme Web Server 1.2"]
    assert _products(spark, {"criteria": head + "1.2:*", "versionEndIncluding": "1.9"}) == ["Acme Web Server (up to 1.9)"]
    assert _products(spark, {"criteria": head + "*:*"}) == ["Acme Web Server"]
    assert _products(spark, {"criteria": "cpe:2.3:a:node:node_server:-:*"}) == ["Node Server"]
    assert _products(spark, {"criteria": head + "1:*", "vulnerable": False}) == []
    assert _products(spark, {"criteria": "cpe:2.3:a"}, {"criteria": head + "1:*"}, {"criteria": head + "1:*"}) == ["Acme Web Server 1"]
    assert nvd.flatten_cve(_cve(spark)).first()["products"] == []


def test_cwe(spark):
    w = lambda v: [{"description": [{"lang": "en", "value": v}]}]
    named = lambda cve, cat=None: nvd.flatten_cve(cve, cat).first()["cwe"]
    assert named(_cve(spark, weaknesses=w("CWE-79"))) == "CWE-79: Cross-site Scripting"
    assert named(_cve(spark, weaknesses=w("CWE-9999"))) == "CWE-9999"
    assert named(_cve(spark)) == "No CWE Identified"
    assert named(_cve(spark, weaknesses=[])) == "No CWE Identified"
    catalog = spark.createDataFrame([("CWE-5", "five")], "cwe_id string, text string")
    assert named(_cve(spark, weaknesses=w("CWE-5")), catalog) == "CWE-5: five"
    assert named(_cve(spark), catalog) == "No CWE Identified"


def test_dates_and_description(spark):
    row = nvd.flatten_cve(
        _cve(
            spark, published="2024-03-05T10:00:00.000", lastModified="bad",
            descriptions=[{"lang": "es", "value": "hola"}, {"lang": "en", "value": "one"}, {"lang": "en", "value": "two"}],
        )
    ).first()
    assert (row["published_date"], row["last_modified"], row["description"]) == (dt.date(2024, 3, 5), None, "one")


def test_cwe_catalog(spark, tmp_path):
    long = "word " * 30
    (tmp_path / "cwe.xml").write_text(
        f"""<Catalog><Weaknesses><Weakness ID="79" Name="x"><Description>Cross  site</Description></Weakness>
        <Weakness ID="80"><Description>{long}</Description></Weakness></Weaknesses>
        <Categories><Category ID="2" Name="y"><Name>Seven</Name></Category></Categories></Catalog>"""
    )
    got = {r["cwe_id"]: r["text"] for r in cwe.cwe_catalog(cwe.read_cwe_xml(spark, str(tmp_path / "cwe.xml"))).collect()}
    assert got["CWE-79"] == "Cross site" and got["CWE-2"] == "Seven"
    assert got["CWE-80"] == long.strip()[:97] + "..." and len(got) == 5


PAGE = """<html><head><title>Big Flaw – The Site</title><meta property="article:published_time" content="{meta}"></head>
<body><span class="categ x"><a href="#"><span>Malware</span></a> <a href="#"><span>Zero &amp; Day</span></a></span>
<div class="articlebody clear"><p>First <b>bold</b> text.</p><div><p></p><p>Second &lt;one&gt;.</p></div></div>
<script>{{"id": "CVE-2024-11111"}}</script><p>Outside cve-2024-22222 {extra}</p></body></html>"""


def _parsed(spark, meta="", extra=""):
    pages = spark.createDataFrame([("u", PAGE.format(meta=meta, extra=extra))], "url string, html string")
    return art.parse_article(pages, "2024-12-31").first()


def test_parse_article(spark):
    row = _parsed(spark, "2024-05-06T07:08:09Z", "flaw affects Acme Tool version 1.2, ok")
    assert row["text"] == "Big Flaw. First text. Second <one>."
    assert row["published_date"] == dt.date(2024, 5, 6)
    assert row["cves"] == ["CVE-2024-11111", "CVE-2024-22222"]
    assert row["tags"] == ["Malware", "Zero & Day"]
    assert row["products"] == ["Acme Tool 1.2"]


def test_article_dates(spark):
    assert _parsed(spark, "March 5, 2024")["published_date"] == dt.date(2024, 3, 5)
    assert _parsed(spark, "Mar 05, 2024")["published_date"] == dt.date(2024, 3, 5)
    assert _parsed(spark, "", "on June 7, 2023")["published_date"] == dt.date(2023, 6, 7)
    assert _parsed(spark, "", "Version 12, 2024")["published_date"] == dt.date(2024, 12, 31)


def test_products(scalar):
    p = lambda s: scalar(art.product_mentions(F.col("t")), "t string", s)
    assert p("vulnerable versions of Foo Bar, and Baz before 3.1; x") == ["Foo Bar", "and Baz 3.1"]
    assert p("A flaw was found in apache and Nginx") == ["Apache", "Nginx"]
    assert p("Nginx has a flaw" + " x" * 40 + " Linux") == []
    assert p("nothing here") == []


def test_validate_required(spark):
    df = spark.createDataFrame([("a", "b"), ("c", None)], "url string, text string")
    good, bad = feeds.validate_required(df, ["url", "text"])
    assert (good.count(), bad.count()) == (1, 1)
    good, bad = feeds.validate_required(df, ["url", "tags"])
    assert (good.count(), bad.count()) == (0, 2)


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, None, None)], "i int, s string, l array<string>")
    for exact in (True, False):
        got = {r["column"]: r for r in feeds.profile(df, exact).collect()}
        assert (got["s"]["nulls"], got["s"]["distinct_values"], got["l"]["longest_array"]) == (1, 1, 2)
        assert got["i"]["type"] == "int" and got["i"]["rows"] == 2
