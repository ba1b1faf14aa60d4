"""Fixed schemas of the feeds and tables."""

from pyspark.sql import types as T


def _metric(severity_inside: bool) -> T.ArrayType:
    data = T.StructType([T.StructField("baseScore", T.DoubleType())])
    metric = T.StructType([T.StructField("cvssData", data)])
    (data if severity_inside else metric).add("baseSeverity", T.StringType())
    return T.ArrayType(metric)


_LANG_VALUE = T.ArrayType(
    T.StructType([T.StructField("lang", T.StringType()), T.StructField("value", T.StringType())])
)

CVE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("published", T.StringType()),
        T.StructField("lastModified", T.StringType()),
        T.StructField("descriptions", _LANG_VALUE),
        T.StructField(
            "metrics",
            T.StructType(
                [
                    T.StructField("cvssMetricV40", _metric(True)),
                    T.StructField("cvssMetricV31", _metric(True)),
                    T.StructField("cvssMetricV30", _metric(True)),
                    T.StructField("cvssMetricV2", _metric(False)),
                ]
            ),
        ),
        T.StructField(
            "weaknesses", T.ArrayType(T.StructType([T.StructField("description", _LANG_VALUE)]))
        ),
        T.StructField(
            "configurations",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "nodes",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField(
                                            "cpeMatch",
                                            T.ArrayType(
                                                T.StructType(
                                                    [
                                                        T.StructField("vulnerable", T.BooleanType()),
                                                        T.StructField("criteria", T.StringType()),
                                                        T.StructField(
                                                            "versionEndIncluding", T.StringType()
                                                        ),
                                                    ]
                                                )
                                            ),
                                        )
                                    ]
                                )
                            ),
                        )
                    ]
                )
            ),
        ),
    ]
)

RAW_CVE = T.StructType([T.StructField("cve", CVE)])

NVD = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("cve_id", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("published_date", T.DateType()),
        T.StructField("last_modified", T.DateType()),
        T.StructField("severity", T.StringType()),
        T.StructField("cvss_score", T.DoubleType()),
        T.StructField("cwe", T.StringType()),
        T.StructField("products", T.ArrayType(T.StringType())),
    ]
)

ARTICLE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("published_date", T.DateType()),
        T.StructField("products", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("url", T.StringType()),
        T.StructField("cves", T.ArrayType(T.StringType())),
        T.StructField("ingest_ts_thn", T.TimestampType()),
    ]
)

# One file may hold either kind of record; the union of both is read.
FEED = T.StructType(
    NVD.fields + [f for f in ARTICLE.fields if f.name not in {g.name for g in NVD.fields}]
)
