"""Bins, urgency, labels, evaluation, emerging threats and weight sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.bins import level_bin
from ..operators import emerging as em
from ..operators import evaluation, labels, reports, sweeps, urgency
from . import tables as t
from .registry import query


def _r(c: str, places: int = 6):
    return F.round(c, places).alias(c)


def _rsql(*cols: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in cols)


# --- bins --------------------------------------------------------------------
@query(t.with_views("nvd", "SELECT cve_id, cvss_score, severity_category FROM nvd"))
def severity_bin(spark: SparkSession, d: str) -> DataFrame:
    return t.nvd(spark, d).select("cve_id", "cvss_score", "severity_category")


@query(
    f"""SELECT event_id, {t.sql_level('(value - 10) / CAST(100 AS DOUBLE)')} AS level FROM events"""
)
def level_bin_of_values(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "events").select(
        "event_id", level_bin((F.col("value") - 10) / F.lit(100.0)).alias("level")
    )


# --- urgency -----------------------------------------------------------------
_FACTOR_COLS = [f"f_{f}" for f in fixed.FACTORS]


@query(
    t.with_views(
        "factors",
        f"SELECT cve_id, {_rsql(*_FACTOR_COLS, 'f_text_length')}, f_days_old, f_n_articles_raw FROM factors",
    )
)
def urgency_factors(spark: SparkSession, d: str) -> DataFrame:
    return t.factors(spark, d).select(
        "cve_id", *[_r(c) for c in _FACTOR_COLS], _r("f_text_length"), "f_days_old", "f_n_articles_raw"
    )


@query(t.with_views("assessed", f"SELECT cve_id, {_rsql('urgency_score')}, urgency_level FROM assessed"))
def urgency_score(spark: SparkSession, d: str) -> DataFrame:
    return t.assessed(spark, d).select("cve_id", _r("urgency_score"), "urgency_level")


@query(
    t.with_views(
        "assessed",
        f"""SELECT cve_id, severity, published_date, {_rsql('urgency_score')}, urgency_level FROM assessed
            ORDER BY assessed.urgency_score DESC NULLS LAST, cve_id LIMIT 10""",
    )
)
def top_urgent(spark: SparkSession, d: str) -> DataFrame:
    top = reports.top_urgent(t.assessed(spark, d), 10)
    return top.select("cve_id", "severity", "published_date", _r("urgency_score"), "urgency_level")


# --- labels ------------------------------------------------------------------
def _joined(labels_sql: str) -> str:
    return f"CASE WHEN len({labels_sql}) = 0 THEN 'Other' ELSE array_to_string(list_sort({labels_sql}), ',') END"


@query(t.with_views("vuln", f"SELECT cve_id, {_joined(t.sql_labels('description'))} AS labels FROM vuln"))
def rule_labels(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_join(F.array_sort(labels.rule_labels("description")), ",")
    return t.vuln(spark, d).select("cve_id", found.alias("labels"))


@query(t.with_views("vuln", f"SELECT cve_id, {_joined(t.sql_labels('description', 'cwe'))} AS labels FROM vuln"))
def seed_labels(spark: SparkSession, d: str) -> DataFrame:
    # The CWE carries its description, as the flattened feed has it.
    v = t.vuln(spark, d).withColumn("cwe", F.concat_ws(": ", "cwe", F.lit("described")))
    return v.select("cve_id", F.array_join(labels.seed_labels("description"), ",").alias("labels"))


_LABELS = [f"label_{c}" for c in fixed.CATEGORIES]
_PREDS = [f"pred_{c}" for c in fixed.CATEGORIES]


@query(t.with_views("labelled", f"SELECT cve_id, {', '.join(_LABELS)} FROM labelled"))
def binarise(spark: SparkSession, d: str) -> DataFrame:
    return t.labelled(spark, d).select("cve_id", *_LABELS)


@query(
    t.with_views(
        "labelled",
        " UNION ALL ".join(f"SELECT {t.q(c)} AS label, count(*) FILTER (label_{c} = 1) AS n FROM labelled" for c in fixed.CATEGORIES),
    )
)
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_counts(t.labelled(spark, d))


_PAIRED = "SELECT cve_id, unnest(CASE WHEN len(hits) = 0 THEN ['Other'] ELSE hits END) AS l FROM listed"
_ALL_PAIRS = f"""SELECT a.c AS label_a, b.c AS label_b FROM (SELECT unnest([{', '.join(t.q(c) for c in fixed.CATEGORIES)}]) AS c) a,
    (SELECT unnest([{', '.join(t.q(c) for c in fixed.CATEGORIES)}]) AS c) b"""


@query(
    t.with_views(
        "listed",
        """SELECT label_a, label_b, count(x.cve_id) AS n FROM allpairs LEFT JOIN (
           SELECT p.cve_id, p.l AS la, r.l AS lb FROM paired p JOIN paired r USING (cve_id)) x
           ON x.la = label_a AND x.lb = label_b GROUP BY 1, 2""",
        paired=_PAIRED, allpairs=_ALL_PAIRS,
    )
)
def label_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return labels.cooccurrence(t.labelled(spark, d), key="cve_id")


def _corr_sql(a: str, b: str) -> str:
    x = f"corr(label_{a}, label_{b})"
    return f"SELECT {t.q(a)} AS label_a, {t.q(b)} AS label_b, CASE WHEN isnan({x}) THEN NULL ELSE round({x}, 6) END AS corr FROM labelled"


@query(
    t.with_views(
        "labelled", " UNION ALL ".join(_corr_sql(a, b) for a in fixed.CATEGORIES for b in fixed.CATEGORIES)
    )
)
def label_correlation(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_correlation(t.labelled(spark, d)).select("label_a", "label_b", _r("corr"))


# --- evaluation --------------------------------------------------------------
def _report_sql(view: str, classes: list[str], truth: str, guess: str) -> dict[str, str]:
    unpivoted = " UNION ALL ".join(
        f"SELECT {i} AS i, {t.q(c)} AS name, {truth}{c} AS y, {guess}{c} AS p FROM {view}" for i, c in enumerate(classes)
    )
    add = lambda xs: " + ".join(xs)
    hit = add([f"{truth}{c} * {guess}{c}" for c in classes])
    ny, np_ = add([f"{truth}{c}" for c in classes]), add([f"{guess}{c}" for c in classes])
    return {
        "u": unpivoted,
        "c": """SELECT name, sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn, sum((1 - y) * (1 - p)) AS tn
                FROM u GROUP BY name""",
        "m": """SELECT name, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
                CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1, tp + fn AS support FROM c""",
        "s": f"""SELECT avg(CASE WHEN np > 0 THEN hit / np::DOUBLE ELSE 0 END) AS precision,
                avg(CASE WHEN ny > 0 THEN hit / ny::DOUBLE ELSE 0 END) AS recall,
                avg(CASE WHEN ny + np > 0 THEN 2 * hit / (ny + np)::DOUBLE ELSE 0 END) AS f1
                FROM (SELECT {hit} AS hit, {ny} AS ny, {np_} AS np FROM {view})""",
        "r": """SELECT name, precision, recall, f1, support FROM m
                UNION ALL SELECT 'micro avg', coalesce(sum(tp) / nullif(sum(tp + fp), 0)::DOUBLE, 0), coalesce(sum(tp) / nullif(sum(tp + fn), 0)::DOUBLE, 0),
                  coalesce(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0)::DOUBLE, 0), sum(support) FROM m
                UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
                UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                  sum(f1 * support) / sum(support), sum(support) FROM m
                UNION ALL SELECT 'samples avg', precision, recall, f1, (SELECT sum(support) FROM m) FROM s""",
    }


_REPORT = _report_sql("labelled", fixed.CATEGORIES, "label_", "pred_")
_REPORT_OUT = f"SELECT name, {_rsql('precision', 'recall', 'f1')}, CAST(support AS BIGINT) AS support FROM r"


def _report(df: DataFrame) -> DataFrame:
    return df.select("name", _r("precision"), _r("recall"), _r("f1"), "support")


@query(t.with_views("labelled", _REPORT_OUT, **_REPORT))
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return _report(evaluation.classification_report(t.labelled(spark, d)))


_JUDGED = """SELECT quality AS y_quality, toxic AS y_toxic, CAST(n_chars > 400 AS INTEGER) AS p_quality,
    CAST(doc_id % 11 = 0 AS INTEGER) AS p_toxic FROM labels JOIN documents USING (doc_id)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "labels").join(t.read(spark, d, "documents"), "doc_id").select(
        F.col("quality").alias("y_quality"), F.col("toxic").alias("y_toxic"),
        (F.col("n_chars") > 400).cast("int").alias("p_quality"), (F.col("doc_id") % 11 == 0).cast("int").alias("p_toxic"),
    )


_JUDGED_VIEWS = {"judged": _JUDGED, **_report_sql("judged", ["quality", "toxic"], "y_", "p_")}


@query("WITH " + ", ".join(f"{k} AS ({v})" for k, v in _JUDGED_VIEWS.items()) + " " + _REPORT_OUT)
def classification_report_documents(spark: SparkSession, d: str) -> DataFrame:
    return _report(evaluation.classification_report(_judged(spark, d), ["quality", "toxic"], "y_", "p_"))


@query(
    t.with_views(
        "labelled",
        f"""SELECT name AS label, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
            {_rsql('precision', 'recall', 'f1')} FROM m""",
        **{k: _REPORT[k] for k in ("u", "c", "m")},
    )
)
def multilabel_confusion(spark: SparkSession, d: str) -> DataFrame:
    c = evaluation.multilabel_confusion(t.labelled(spark, d))
    return c.select("label", "tn", "fp", "fn", "tp", _r("precision"), _r("recall"), _r("f1"))


def _first_sql(prefix: str) -> str:
    return "CASE " + " ".join(f"WHEN {prefix}{c} = 1 THEN {t.q(c)}" for c in fixed.CATEGORIES) + " ELSE 'none' END"


@query(
    t.with_views(
        "labelled",
        f"""SELECT truth, {', '.join(f"count(*) FILTER (guess = {t.q(c)}) AS {t.q(c).replace(chr(39), chr(34))}" for c in [*fixed.CATEGORIES, 'none'])}
            FROM (SELECT {_first_sql('label_')} AS truth, {_first_sql('pred_')} AS guess FROM labelled) GROUP BY truth""",
    )
)
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion_matrix(t.labelled(spark, d))


# --- emerging ----------------------------------------------------------------
@query(t.with_views("daily", "SELECT day, x FROM daily"))
def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return em.daily_counts(t.vuln(spark, d))


@query(t.with_views("spikes", "SELECT day, x FROM spikes"))
def spike_days(spark: SparkSession, d: str) -> DataFrame:
    return em.spike_days(em.daily_counts(t.vuln(spark, d)))


_SERIES_SPIKES = """WITH {filled}, w AS (SELECT event_type, day, x, count(*) OVER r AS n, sum(x) OVER r AS s, sum(x * x) OVER r AS qq FROM series
    WINDOW r AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
    SELECT event_type, day, CAST(x AS BIGINT) AS x FROM w
    WHERE n >= 5 AND n * x > s AND (n * x - s) * (n * x - s) * (n - 1) > {z} * n * (n * qq - s * s)"""


@query(
    _SERIES_SPIKES.format(
        filled="series AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS x FROM events GROUP BY 1, 2)", z=1
    )
)
def spike_days_by_series(spark: SparkSession, d: str) -> DataFrame:
    daily = em.daily_counts(t.read(spark, d, "events"), "ts", ["event_type"])
    return em.spike_days(daily, z=1, keys=["event_type"])


@query(
    _SERIES_SPIKES.format(
        filled="""raw AS (SELECT event_type, CAST(date_trunc('week', ts) AS DATE) + CAST(day(ts) % 2 AS INTEGER) AS day, count(*) AS x FROM events GROUP BY 1, 2),
            days AS (SELECT event_type, CAST(unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM raw GROUP BY 1),
            series AS (SELECT event_type, day, coalesce(x, 0) AS x FROM days LEFT JOIN raw USING (event_type, day))""",
        z=1,
    )
)
def spike_days_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Series with gaps: all events, moved to the first two days of their week."""
    moved = F.expr("CAST(date_trunc('week', ts) AS DATE) + CAST(day(ts) % 2 AS INTEGER)")
    daily = em.daily_counts(t.read(spark, d, "events").withColumn("ts", moved), "ts", ["event_type"])
    return em.spike_days(daily, z=1, keys=["event_type"], fill_gaps=True)


@query(
    t.with_views(
        "flagged",
        """SELECT cve_id, zero_day_flag, spike_flag, if_flag, emerging, array_to_string(list_filter([
           CASE WHEN zero_day_flag THEN 'zero_day' END, CASE WHEN spike_flag THEN 'spike' END,
           CASE WHEN if_flag THEN 'if' END], lambda x: x IS NOT NULL), ', ') AS methods FROM flagged""",
    )
)
def emerging(spark: SparkSession, d: str) -> DataFrame:
    """Flags, their union, and the list of methods that fired."""
    return t.flagged(spark, d).select(
        "cve_id", *em.FLAGS, "emerging", em.detection_methods().alias("methods")
    )


_OVERLAPS = {
    "only_zero_day": "z AND NOT s AND NOT i", "only_spike": "NOT z AND s AND NOT i", "only_isolation": "NOT z AND NOT s AND i",
    "zero_day_spike": "z AND s AND NOT i", "zero_day_isolation": "z AND NOT s AND i", "spike_isolation": "NOT z AND s AND i",
    "all_three": "z AND s AND i", "zero_day": "z", "spike": "s", "isolation": "i", "emerging": "e",
}


@query(
    t.with_views(
        "flagged",
        f"""SELECT count(*) AS total, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in _OVERLAPS.items())},
            round(100 * count(*) FILTER (e) / count(*)::DOUBLE, 6) AS emerging_pct
            FROM (SELECT zero_day_flag AS z, spike_flag AS s, if_flag AS i, emerging AS e FROM flagged)""",
    )
)
def detection_overlap(spark: SparkSession, d: str) -> DataFrame:
    return em.detection_overlap(t.flagged(spark, d)).withColumn("emerging_pct", F.round("emerging_pct", 6))


@query(
    t.with_views(
        "labelled",
        " UNION ALL ".join(
            f"SELECT {t.q(c)} AS category, {e} AS emerging, count(*) FILTER (label_{c} = 1 AND emerging = {e}) AS n FROM labelled"
            for c in fixed.CATEGORIES for e in ("true", "false")
        ),
    )
)
def emerging_by_category(spark: SparkSession, d: str) -> DataFrame:
    return em.emerging_by_category(t.labelled(spark, d))


@query(t.with_views("flagged", "SELECT round(corr(urgency_score, emerging::INTEGER::DOUBLE), 6) AS corr FROM flagged"))
def urgency_correlation(spark: SparkSession, d: str) -> DataFrame:
    return em.urgency_correlation(t.flagged(spark, d)).select(_r("corr"))


# --- weight sweeps -----------------------------------------------------------
_TUNE = {f: t.dbl(w) for f, w in fixed.TUNING_WEIGHTS.items()}
_WEIGHTS = " UNION ALL ".join(f"SELECT {t.q(f)} AS factor, {t.dbl(i / 20)} AS weight" for f in fixed.FACTORS for i in range(11))
_SETTINGS = "SELECT factor, weight, " + ", ".join(
    f"CASE WHEN factor = {t.q(f)} THEN weight ELSE {_TUNE[f]} * ((1 - weight) / ("
    + "CASE factor "
    + " ".join(
        f"WHEN {t.q(g)} THEN {t.dbl(sum(w for h, w in fixed.TUNING_WEIGHTS.items() if h != g))}" for g in fixed.FACTORS
    )
    + f" END)) END AS w_{f}"
    for f in fixed.FACTORS
) + " FROM ws"
_SENSITIVITY = {
    "ws": _WEIGHTS,
    "st": _SETTINGS,
    "b": f"SELECT *, {t.sql_score(_TUNE)} AS old_score FROM factors",
    "x": f"SELECT factor, weight, old_score, {t.sql_score({f: f'w_{f}' for f in fixed.FACTORS})} AS new_score FROM b, st",
    "y": f"SELECT *, {t.sql_level('old_score')} AS old_level, {t.sql_level('new_score')} AS new_level FROM x",
    "sens": """SELECT factor, weight, avg(abs(new_score - old_score)) AS score_change,
        100 * avg(CASE WHEN old_level = new_level THEN 0 ELSE 1 END) AS level_change_pct,
        100 * count(*) FILTER (new_level = 'Low') / count(new_level)::DOUBLE AS low_pct,
        100 * count(*) FILTER (new_level = 'Medium') / count(new_level)::DOUBLE AS medium_pct,
        100 * count(*) FILTER (new_level = 'High') / count(new_level)::DOUBLE AS high_pct FROM y GROUP BY 1, 2""",
}
_SENS_COLS = ["score_change", "level_change_pct", "low_pct", "medium_pct", "high_pct"]


@query(t.with_views("factors", f"SELECT factor, weight, {_rsql(*_SENS_COLS)} FROM sens", **_SENSITIVITY))
def weight_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    s = sweeps.weight_sensitivity(t.factors(spark, d))
    return s.select("factor", "weight", *[_r(c) for c in _SENS_COLS])


@query(
    t.with_views(
        "factors",
        """SELECT factor, round(max(level_change_pct), 6) AS max_level_change_pct FROM sens GROUP BY factor
           ORDER BY max_level_change_pct DESC, factor LIMIT 1""",
        **_SENSITIVITY,
    )
)
def most_sensitive_factor(spark: SparkSession, d: str) -> DataFrame:
    best = sweeps.most_sensitive(sweeps.weight_sensitivity(t.factors(spark, d)))
    return best.select("factor", _r("max_level_change_pct"))


_GRID = "SELECT * FROM " + ", ".join(
    f"(SELECT unnest([{', '.join(t.dbl(w) for w in ws)}]) AS o_{f})" for f, ws in fixed.WEIGHT_OPTIONS.items()
)
_SUM = " + ".join(f"o_{f}" for f in fixed.FACTORS)
_SEARCH = {
    "g": _GRID,
    "kept": f"SELECT {', '.join(f'o_{f} * (1 / ({_SUM})) AS w_{f}' for f in fixed.FACTORS)} FROM g WHERE {_SUM} BETWEEN {t.dbl(0.99)} AND {t.dbl(1.01)}",
    "x": f"SELECT {', '.join(f'w_{f}' for f in fixed.FACTORS)}, {t.sql_score({f: f'w_{f}' for f in fixed.FACTORS})} AS s FROM factors, kept",
    "y": f"SELECT *, {t.sql_level('s')} AS lv FROM x",
    "z": f"""SELECT {', '.join(f'w_{f}' for f in fixed.FACTORS)}, var_samp(s) AS score_variance,
        count(*) FILTER (lv = 'Low') / count(lv)::DOUBLE AS low_pct, count(*) FILTER (lv = 'Medium') / count(lv)::DOUBLE AS med_pct,
        count(*) FILTER (lv = 'High') / count(lv)::DOUBLE AS high_pct FROM y GROUP BY {', '.join(f'w_{f}' for f in fixed.FACTORS)}""",
    "e": """SELECT *, -(CASE WHEN low_pct > 0 THEN low_pct * ln(low_pct) ELSE 0 END + CASE WHEN med_pct > 0 THEN med_pct * ln(med_pct) ELSE 0 END
        + CASE WHEN high_pct > 0 THEN high_pct * ln(high_pct) ELSE 0 END) AS entropy,
        1 - (abs(low_pct - 1 / 3::DOUBLE) + abs(med_pct - 1 / 3::DOUBLE) + abs(high_pct - 1 / 3::DOUBLE)) / 2 AS balance FROM z""",
    "se": """SELECT *, (entropy / max(entropy) OVER () + score_variance / max(score_variance) OVER () + balance / max(balance) OVER ()) / 3
        AS combined_score FROM e""",
}
_SEARCH_COLS = ["entropy", "score_variance", "balance", "low_pct", "med_pct", "high_pct", "combined_score"]
_W = [f"w_{f}" for f in fixed.FACTORS]


@query(t.with_views("factors", f"SELECT {_rsql(*_W, *_SEARCH_COLS)} FROM se", **_SEARCH))
def weight_search(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.weight_search(t.factors(spark, d)).select(*[_r(c) for c in [*_W, *_SEARCH_COLS]])


def _best_sql(criterion: str) -> str:
    return t.with_views("factors", f"SELECT round(max({criterion}), 6) AS {criterion} FROM se", **_SEARCH)


def _best(spark: SparkSession, d: str, criterion: str) -> DataFrame:
    best = sweeps.best_weights(sweeps.weight_search(t.factors(spark, d)), criterion)
    return best.select(_r(criterion))


@query(_best_sql("combined_score"))
def best_weights_combined(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, "combined_score")


@query(_best_sql("entropy"))
def best_weights_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, "entropy")


@query(_best_sql("score_variance"))
def best_weights_variance(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, "score_variance")


@query(_best_sql("balance"))
def best_weights_balance(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, "balance")


@query(
    t.with_views(
        "factors",
        " UNION ALL ".join(
            f"""SELECT {t.q(f)} AS factor, round(avg(f_{f} * {_TUNE[f]}), 6) AS contribution,
                round(avg(f_{f} * {_TUNE[f]}) / avg({t.sql_score(_TUNE)}), 6) AS share FROM factors"""
            for f in fixed.FACTORS
        ),
    )
)
def weight_contributions(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.weight_contributions(t.factors(spark, d)).select("factor", _r("contribution"), _r("share"))


@query(
    t.with_views(
        "factors",
        f"""SELECT round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std, round(min(s), 6) AS min, round(max(s), 6) AS max,
            round(median(s), 6) AS median, count(*) FILTER (lv = 'Low') AS n_low, count(*) FILTER (lv = 'Medium') AS n_medium,
            count(*) FILTER (lv = 'High') AS n_high FROM (SELECT s, {t.sql_level('s')} AS lv FROM (SELECT {t.sql_score(_TUNE)} AS s FROM factors))""",
    )
)
def score_statistics(spark: SparkSession, d: str) -> DataFrame:
    scored = urgency.urgency_score(t.factors(spark, d), fixed.TUNING_WEIGHTS)
    s = sweeps.score_statistics(scored)
    return s.select(*[_r(c) for c in ("mean", "std", "min", "max", "median")], "n_low", "n_medium", "n_high")


# --- contamination -----------------------------------------------------------
_CONT = " UNION ALL ".join(f"SELECT {i} AS i, {t.dbl(c)} AS contamination, {t.dbl(1.0 - c)} AS p" for i, c in enumerate(sweeps.CONTAMINATIONS))
_CONT_VIEWS = {
    "cs": _CONT,
    "cuts": "SELECT " + ", ".join(f"quantile_cont(value, {t.dbl(1.0 - c)}) AS q{i}" for i, c in enumerate(sweeps.CONTAMINATIONS)) + " FROM events",
    "cut_rows": " UNION ALL ".join(f"SELECT {i} AS i, q{i} AS cut FROM cuts" for i in range(20)),
    "sw": """SELECT contamination, cut, avg(value) AS avg_anomaly_score, count(*) FILTER (value > cut) AS anomalies_count,
        var_pop(value) AS score_variance, avg(value) FILTER (value > cut) - avg(value) FILTER (value <= cut) AS gap
        FROM events, cut_rows JOIN cs USING (i) GROUP BY 1, 2""",
}
_CONT_COLS = ["cut", "avg_anomaly_score", "score_variance", "gap"]


def contamination_sql(sql: str, **scores: str) -> str:
    """``sql`` behind the views of the sweep; ``events`` may be given as a view with column value."""
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in {**scores, **_CONT_VIEWS}.items()) + " " + sql


def contamination_rows(scores: DataFrame, score: str) -> DataFrame:
    swept = sweeps.contamination_sweep(scores, score)
    return swept.select("contamination", "anomalies_count", *[_r(c, 5) for c in _CONT_COLS])


CONTAMINATION_SELECT = f"SELECT contamination, anomalies_count, {_rsql(*_CONT_COLS, places=5)} FROM sw"


def _contamination(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.contamination_sweep(t.read(spark, d, "events"), "value")


@query(contamination_sql(CONTAMINATION_SELECT))
def contamination_sweep(spark: SparkSession, d: str) -> DataFrame:
    return contamination_rows(t.read(spark, d, "events"), "value")


@query(
    contamination_sql(
        """SELECT contamination, round(CASE WHEN rn = 1 THEN nx - cut WHEN rn = 20 THEN cut - pv ELSE (nx - pv) / 2 END, 5) AS gradient
           FROM (SELECT contamination, cut, lead(cut) OVER w AS nx, lag(cut) OVER w AS pv, row_number() OVER w AS rn FROM sw
           WINDOW w AS (ORDER BY contamination))"""
    )
)
def contamination_gradient(spark: SparkSession, d: str) -> DataFrame:
    g = sweeps.contamination_gradient(_contamination(spark, d))
    return g.select("contamination", _r("gradient", 5))


@query(
    contamination_sql(
        """, dd AS (SELECT contamination, lag(contamination) OVER w AS pc, round(cut, 12) - lag(round(cut, 12)) OVER w AS d1,
             lead(round(cut, 12)) OVER w - 2 * round(cut, 12) + lag(round(cut, 12)) OVER w AS d2 FROM sw WINDOW w AS (ORDER BY contamination)),
           e AS (SELECT contamination AS elbow FROM dd WHERE d2 IS NOT NULL ORDER BY abs(d2) DESC, contamination LIMIT 1)
           SELECT elbow, coalesce((SELECT min(pc) FROM dd WHERE abs(d1) < CAST(0.1 AS DOUBLE) * (SELECT max(abs(d1)) FROM dd)), elbow) AS level_off FROM e"""
    )
)
def contamination_elbow(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.elbow(_contamination(spark, d))


# --- scorecard ---------------------------------------------------------------
_METRICS = """SELECT CAST(label AS VARCHAR) AS model, avg(embedding[1]::DOUBLE) AS silhouette, avg(abs(embedding[2]::DOUBLE)) AS within_similarity,
    CAST(count(*) * 100 AS DOUBLE) AS texts_per_second, CAST(label * 40 AS DOUBLE) AS size_mb, CAST(384 + label * 96 AS DOUBLE) AS dimension,
    CAST(1 + label AS DOUBLE) / 2 AS contrast_ratio, avg(abs(embedding[3]::DOUBLE)) AS avg_delta FROM embeddings GROUP BY label"""
_CARD = {
    "metrics": _METRICS,
    "parts": """SELECT model, (silhouette + 1) / 2 * 5 + within_similarity * 5 AS quality,
        least(10, texts_per_second / max(texts_per_second) OVER () * 10) AS speed,
        10 - least(10, size_mb / 100) + least(5, dimension / 200) AS efficiency,
        least(5, contrast_ratio) + 5 * (1 - least(1, avg_delta * 2)) AS understanding FROM metrics""",
    "card": """SELECT *, quality * CAST(0.35 AS DOUBLE) + speed * CAST(0.25 AS DOUBLE) + efficiency * CAST(0.15 AS DOUBLE)
        + understanding * CAST(0.25 AS DOUBLE) AS total_score FROM parts""",
}
_CARD_COLS = ["quality", "speed", "efficiency", "understanding", "total_score"]


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double")
    return t.read(spark, d, "embeddings").groupBy("label").agg(
        F.avg(at(0)).alias("silhouette"), F.avg(F.abs(at(1))).alias("within_similarity"),
        (F.count("*") * 100).cast("double").alias("texts_per_second"), F.avg(F.abs(at(2))).alias("avg_delta"),
    ).select(
        "*", F.col("label").cast("string").alias("model"), (F.col("label") * 40).cast("double").alias("size_mb"),
        (384 + F.col("label") * 96).cast("double").alias("dimension"), ((1 + F.col("label")) / 2).alias("contrast_ratio"),
    )


def _card_sql(sql: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in _CARD.items()) + " " + sql


@query(_card_sql(f"SELECT model, {_rsql(*_CARD_COLS)} FROM card"))
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.scorecard(_metrics(spark, d)).select("model", *[_r(c) for c in _CARD_COLS])


@query(_card_sql("SELECT model, round(total_score, 6) AS total_score FROM card ORDER BY card.total_score DESC, model LIMIT 1"))
def best_model(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.best_model(sweeps.scorecard(_metrics(spark, d))).select("model", _r("total_score"))
