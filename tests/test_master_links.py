"""The lists of links beside the master hold every article that the master counts."""

from pyspark.sql import functions as F

from vulnwave.catalog import QUERIES, models
from vulnwave.plans import assess as plan


def test_links_are_whole(spark, sf_dir):
    master = models._master(spark, sf_dir)
    counted = master.where("n_articles > 0").select(F.col("cve_id").alias("doc_key"), F.col("n_articles").cast("long"))
    listed = plan.build_links(master).groupBy("doc_key").agg(F.sum(F.size("linked_articles")).alias("n"))
    want = sorted(tuple(r) for r in counted.collect())
    assert want and sorted(tuple(r) for r in listed.collect()) == want
    assert QUERIES["master_links"](spark, sf_dir).count() == sum(n for _, n in want)


def test_links_without_the_master_are_those_of_the_master(spark):
    cves = spark.createDataFrame(
        [("CVE-2020-0001", "bounds check", 1), ("CVE-2020-0002", "<b> the </b>", 1), ("CVE-2020-0003", "old words here", 1), ("CVE-2020-0003", "the", 2), (None, "words", 1)],
        "cve_id string, description string, last_modified int",
    ).withColumns({"source": F.lit("nvd"), "cvss_score": F.lit(5.0), "published_date": F.lit("2020-01-01").cast("date")})
    ids = ["CVE-2020-0001", "cve-2020-0002", "CVE-2020-0003", None]
    news = [("u1", "plain words", 1, ids), ("u2", "<p></p>", 1, ids), ("u3", "see cve-2020-0001 now", 1, None), ("u4", "plain words", 1, ids), ("u4", "the", 2, ids)]
    news += [("u5", "the", None, ids), ("u5", "plain words", 1, ["CVE-2020-0001"]), ("u6", None, 1, ids), (None, "plain words", 1, ids), ("u1", "plain words", 1, ids)]
    news += [(f"v{k}", t, 1, ["CVE-2020-0001"]) for k in range(5) for t in ("the", "plain words")]  # of two rows that tie one stands for both
    articles = spark.createDataFrame(news, "url string, text string, day int, cves array<string>").select(
        "url", "text", F.lit("news").alias("source"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("day")).alias("published_date"), "cves"
    )
    read = lambda links: sorted((r["doc_key"], r["part"], tuple(r["linked_articles"])) for r in links.collect())
    want = read(plan.build_links(plan.build_master(cves, articles)))
    assert {k for k, _, _ in want} == {"CVE-2020-0001"} and {"u1", "u3", "u5"} <= set(want[0][2])
    assert read(plan.links_of(cves, articles)) == want
