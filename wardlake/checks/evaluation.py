"""Ranking metrics, bootstrap, episodes, budgets, row texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import costs, text
from ..functions.panels import PANEL_PRICES, PRICES
from ..operators import metrics, policy
from .derived import Derived, with_tables
from .registry import query

SCORES = ["length_score", "coarse_score"]

# ---- curves -------------------------------------------------------------------------

_CURVE = {
    "long": " UNION ALL ".join(
        f"SELECT '{s}' AS grp, doc_id, {s} AS score, quality AS y FROM scored" for s in SCORES
    ),
    "cells": "SELECT grp, score, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM long GROUP BY ALL",
    "curve": """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY grp) AS p, sum(neg) OVER (PARTITION BY grp) AS n,
        lead(pos) OVER (PARTITION BY grp ORDER BY score DESC) AS next_pos, lead(neg) OVER (PARTITION BY grp ORDER BY score DESC) AS next_neg,
        row_number() OVER (PARTITION BY grp ORDER BY score DESC) AS rn
      FROM cells WINDOW w AS (PARTITION BY grp ORDER BY score DESC)""",
    "roc": """SELECT grp, 'Infinity'::DOUBLE AS threshold, 0::BIGINT AS tp, 0::BIGINT AS fp, 0::DOUBLE AS fpr, 0::DOUBLE AS tpr FROM curve GROUP BY grp
      UNION ALL SELECT grp, score, tp::BIGINT, fp::BIGINT, fp::DOUBLE / n::DOUBLE, tp::DOUBLE / p::DOUBLE FROM curve
      WHERE rn = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg""",
    "best": """SELECT * FROM roc QUALIFY row_number() OVER (PARTITION BY grp ORDER BY sqrt(fpr * fpr + (1 - tpr) * (1 - tpr)), threshold DESC) = 1""",
    "areas": """SELECT grp, max(p)::BIGINT AS n_positive, max(n)::BIGINT AS n_negative,
        sum((neg * (2 * (tp - pos) + pos))::BIGINT)::DOUBLE / 2 / (max(p)::DOUBLE * max(n)::DOUBLE) AS auroc,
        sum(pos::DOUBLE * tp::DOUBLE / (tp + fp)::DOUBLE) / max(p)::DOUBLE AS ap FROM curve GROUP BY grp""",
}


def _curve(d: Derived):
    return metrics.cumulative(metrics.long_scores(d.scored, SCORES, "quality"))


@query("roc_points", with_tables("scored", extra=_CURVE, body="SELECT grp AS \"group\", threshold, tp, fp, fpr, tpr FROM roc"))
def roc_points(d: Derived):
    return metrics.roc_points(_curve(d))


@query("roc_points_all", with_tables("scored", extra=_CURVE, body="""
    SELECT grp AS "group", count(*) + 1 AS n FROM curve GROUP BY grp"""))
def roc_points_all(d: Derived):
    points = metrics.roc_points(_curve(d), drop_collinear=False)
    return points.groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query("pr_points", with_tables("scored", extra=_CURVE, body="""
    SELECT grp AS "group", score AS threshold, tp::DOUBLE / (tp + fp)::DOUBLE AS precision, tp::DOUBLE / p::DOUBLE AS recall FROM curve
    UNION ALL SELECT DISTINCT grp, NULL::DOUBLE, 1::DOUBLE, 0::DOUBLE FROM curve"""))
def pr_points(d: Derived):
    return metrics.pr_points(_curve(d))


@query("best_operating_point", with_tables("scored", extra=_CURVE, body="""
    SELECT grp AS "group", threshold, tpr AS sensitivity, 1 - fpr AS specificity FROM best"""))
def best_operating_point(d: Derived):
    out = metrics.ranking_metrics(_curve(d))
    return out.select("group", "threshold", "sensitivity", "specificity")


@query("score_metrics", with_tables("scored", extra=_CURVE, body="""
    SELECT grp AS "group", n_positive, n_negative, round(auroc, 10) AS auroc, round(ap, 10) AS ap, tpr AS sensitivity, 1 - fpr AS specificity, threshold
    FROM areas JOIN best USING (grp)"""))
def score_metrics(d: Derived):
    out = metrics.score_metrics(d.scored, SCORES, "quality")
    return out.withColumns({"auroc": F.round("auroc", 10), "ap": F.round("ap", 10)})


@query("auroc_by_rank_sum", with_tables("scored", body="""
    SELECT 'length_score' AS "group", round((sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0::DOUBLE)
        / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 10) AS auroc
    FROM (SELECT quality, rank() OVER (ORDER BY length_score) + (count(*) OVER (PARTITION BY length_score) - 1) / 2.0::DOUBLE AS r FROM scored)"""))
def auroc_by_rank_sum(d: Derived):
    out = metrics.score_metrics(d.scored, ["length_score"], "quality")
    return out.select("group", F.round("auroc", 10).alias("auroc"))


@query("order_value_metrics", """
    WITH cells AS (SELECT o_totalprice AS score, count(*) FILTER (o_orderstatus = 'P') AS pos, count(*) FILTER (o_orderstatus <> 'P') AS neg FROM orders GROUP BY 1),
    curve AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM cells)
    SELECT sum(pos)::BIGINT AS n_positive, sum(neg)::BIGINT AS n_negative,
      round(sum((neg * (2 * (tp - pos) + pos))::HUGEINT)::DOUBLE / 2 / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 10) AS auroc,
      round(sum(pos::DOUBLE * tp::DOUBLE / (tp + fp)::DOUBLE) / sum(pos)::DOUBLE, 10) AS ap FROM curve""")
def order_value_metrics(d: Derived):
    rows = d.table("orders").selectExpr("o_orderkey", "o_totalprice", "o_orderstatus = 'P' AS open")
    out = metrics.score_metrics(rows, ["o_totalprice"], "open")
    return out.select("n_positive", "n_negative", F.round("auroc", 10).alias("auroc"), F.round("ap", 10).alias("ap"))


@query("confusion", with_tables("scored", body="""
    SELECT *, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1 FROM (
      SELECT count(*) FILTER (coarse_score > 8 AND quality = 1) AS tp, count(*) FILTER (coarse_score > 8 AND quality = 0) AS fp,
        count(*) FILTER (coarse_score <= 8 AND quality = 1) AS fn, count(*) FILTER (coarse_score <= 8 AND quality = 0) AS tn FROM scored)"""))
def confusion(d: Derived):
    return metrics.confusion(d.scored, F.col("coarse_score") > 8, F.col("quality") == 1)


# ---- bootstrap ----------------------------------------------------------------------

REPLICATES = 20
_SHARES_SQL = "[" + ", ".join(
    "[" + ", ".join(f"{x!r}::DOUBLE" for x in metrics.poisson_shares(n)) + "]" for n in range(1, metrics.SMALL_CELL + 1)) + "]"
_BOOT = {
    "rows_of_cells": """SELECT grp, score, y, count(*) AS n, min(doc_id) AS k FROM (
        SELECT 'length_score' AS grp, doc_id, length_score AS score, quality AS y FROM scored
        UNION ALL SELECT 'coarse_score', doc_id, coarse_score, quality FROM scored) GROUP BY ALL""",
    "bits": f"""SELECT *, ('0x' || substr(d, 1, 8))::BIGINT::DOUBLE AS b1, ('0x' || substr(d, 9, 8))::BIGINT::DOUBLE AS b2
      FROM (SELECT *, md5('10:' || rep || ':' || k) AS d FROM rows_of_cells, range(1, {REPLICATES + 1}) r(rep))""",
    "normal": "SELECT *, sqrt(-2 * ln((b1 + 0.5) / 4294967296::DOUBLE)) * cos(2 * pi() * b2 / 4294967296::DOUBLE) AS z FROM bits",
    "drawn": f"""SELECT grp, rep, score, y, CASE WHEN n <= {metrics.SMALL_CELL}
        THEN len(list_filter(({_SHARES_SQL})[n], lambda x: b1 / 4294967296::DOUBLE >= x))
        ELSE greatest(0, floor(n + sqrt(n) * z + (z * z - 1) / 6 + 0.5)) END::BIGINT AS w FROM normal""",
    "cells": "SELECT grp, rep, score, sum(y * w)::BIGINT AS pos, sum((1 - y) * w)::BIGINT AS neg FROM drawn WHERE w > 0 GROUP BY ALL",
    "curve": """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY grp, rep) AS p, sum(neg) OVER (PARTITION BY grp, rep) AS n,
        lead(pos) OVER (PARTITION BY grp, rep ORDER BY score DESC) AS next_pos, lead(neg) OVER (PARTITION BY grp, rep ORDER BY score DESC) AS next_neg,
        row_number() OVER (PARTITION BY grp, rep ORDER BY score DESC) AS rn
      FROM cells WINDOW w AS (PARTITION BY grp, rep ORDER BY score DESC)""",
    "points": """SELECT grp, rep, 'Infinity'::DOUBLE AS threshold, 0::DOUBLE AS fpr, 0::DOUBLE AS tpr FROM curve GROUP BY ALL
      UNION ALL SELECT grp, rep, score, fp::DOUBLE / n::DOUBLE, tp::DOUBLE / p::DOUBLE FROM curve
      WHERE rn = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg""",
    "best": "SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY grp, rep ORDER BY sqrt(fpr * fpr + (1 - tpr) * (1 - tpr)), threshold DESC) = 1",
    "runs": """SELECT grp, rep, sum((neg * (2 * (tp - pos) + pos))::BIGINT)::DOUBLE / 2 / (max(p)::DOUBLE * max(n)::DOUBLE) AS auroc,
        sum(pos::DOUBLE * tp::DOUBLE / (tp + fp)::DOUBLE) / max(p)::DOUBLE AS ap FROM curve GROUP BY grp, rep""",
    "all_runs": "SELECT grp, rep, auroc, ap, tpr AS sensitivity, 1 - fpr AS specificity FROM runs JOIN best USING (grp, rep)",
}

_WEIGHT_SQL = " + ".join(f"(u >= {edge!r}::DOUBLE)::INTEGER" for edge in metrics.POISSON_ONE)
#: Every row drawn by itself; only "cells" and what follows is as above.
_ROW_BOOT = {
    "drawn": f"""SELECT grp, rep, score, y, {_WEIGHT_SQL} AS w FROM (
        SELECT *, ('0x' || substr(md5('10:' || rep || ':' || doc_id), 1, 8))::BIGINT::DOUBLE / 4294967296 AS u
        FROM (SELECT 'length_score' AS grp, doc_id, length_score AS score, quality AS y FROM scored
              UNION ALL SELECT 'coarse_score', doc_id, coarse_score, quality FROM scored), range(1, {REPLICATES + 1}) r(rep))""",
    **{k: v for k, v in _BOOT.items() if k not in ("rows_of_cells", "bits", "normal", "drawn")},
}


@query("bootstrap_replicates", with_tables("scored", extra=_ROW_BOOT, body="""
    SELECT grp AS "group", rep::INTEGER AS replicate, round(auroc, 10) AS auroc, round(ap, 10) AS ap, sensitivity, specificity FROM all_runs"""))
def bootstrap_replicates(d: Derived):
    out = metrics.bootstrap_replicates(d.scored, SCORES, "quality", "doc_id", REPLICATES, 10)
    return out.select(
        "group", "replicate", F.round("auroc", 10).alias("auroc"), F.round("ap", 10).alias("ap"), "sensitivity", "specificity"
    )


@query("bootstrap_intervals", with_tables("scored", extra=_BOOT, body="SELECT grp AS \"group\", " + ", ".join(
    f"round(quantile_cont({m}, 0.025), 8) AS lower_{m}, round(quantile_cont({m}, 0.975), 8) AS upper_{m}, round(stddev_pop({m}), 8) AS std_{m}"
    for m in metrics.METRICS) + " FROM all_runs GROUP BY grp"))
def bootstrap_intervals(d: Derived):
    out = metrics.bootstrap_intervals(d.scored, SCORES, "quality", "doc_id", REPLICATES, 10, draw="cells")
    return out.select("group", *[F.round(c, 8).alias(c) for c in out.columns if c != "group"])


@query("formatted_results", with_tables("scored", extra={
    **{f"b_{k}": v for k, v in {
        "long": _CURVE["long"],
        "cells": _CURVE["cells"].replace("FROM long", "FROM b_long"),
        "curve": _CURVE["curve"].replace("FROM cells", "FROM b_cells"),
        "areas": _CURVE["areas"].replace("FROM curve", "FROM b_curve"),
    }.items()}, **_ROW_BOOT}, body="""
    SELECT grp AS "Model", round(auroc, 3)::VARCHAR || ' (' || round(lo, 3)::VARCHAR || '-' || round(hi, 3)::VARCHAR || ')' AS "AUROC",
      round(ap, 3)::VARCHAR || ' (' || round(alo, 3)::VARCHAR || '-' || round(ahi, 3)::VARCHAR || ')' AS "AUPRC"
    FROM b_areas JOIN (SELECT grp, quantile_cont(auroc, 0.025) AS lo, quantile_cont(auroc, 0.975) AS hi,
      quantile_cont(ap, 0.025) AS alo, quantile_cont(ap, 0.975) AS ahi FROM all_runs GROUP BY grp) USING (grp)"""))
def formatted_results(d: Derived):
    out = metrics.evaluate_scores(d.scored, SCORES, "quality", "doc_id", REPLICATES, 10)
    return metrics.formatted_results(out).select("Model", "AUROC", "AUPRC")


# ---- episodes -----------------------------------------------------------------------

_PRICE_LIST = "[" + ", ".join(f"{float(p)}::DOUBLE" for p in PRICES) + "]"
_COST = {
    "costed": f"""SELECT *, sum(cost) OVER w AS spent, (sum((action < 12)::INTEGER) OVER w)::BIGINT AS n_tests FROM (
        SELECT *, CASE WHEN action < 12 THEN {_PRICE_LIST}[action + 1] ELSE 0 END::DOUBLE AS cost FROM log)
      WINDOW w AS (PARTITION BY patient_id ORDER BY step)""",
    "done": "SELECT patient_id, list_sort(list(DISTINCT action)) AS groups FROM log WHERE action < 12 GROUP BY 1",
    "panels": f"SELECT unnest(range(0, 12))::INTEGER AS g, unnest({_PRICE_LIST}) AS price",
    "own_cost": """SELECT patient_id, g, CASE WHEN list_contains(groups, g) THEN
          price / (SELECT sum(q.price) FROM panels q WHERE list_contains(groups, q.g)) * len(groups) ELSE price END AS cost
      FROM done, panels""",
    "budgets": "SELECT unnest(range(0, 700, 50))::INTEGER AS budget",
    "ends": """SELECT budget, patient_id, min(CASE WHEN action >= 12 OR spent > budget THEN step END) AS stop,
        count(*) FILTER (action < 12 AND spent <= budget) AS n_tests, max(label) AS label FROM costed, budgets GROUP BY ALL""",
    "stops": """SELECT e.budget, e.patient_id, e.label, coalesce(l.prob_pos, 0)::DOUBLE AS prob, coalesce(l.action = 13, FALSE) AS predicted, e.n_tests
      FROM ends e LEFT JOIN log l ON l.patient_id = e.patient_id AND l.step = e.stop""",
}


@query("running_cost", with_tables("log", extra=_COST, body="SELECT patient_id, step, action, cost, spent, n_tests FROM costed"))
def running_cost(d: Derived):
    return policy.running_cost(d.log).select("patient_id", "step", "action", "cost", "spent", "n_tests")


@query("within_budget", with_tables("log", extra=_COST, body="""
    SELECT budget, patient_id, step, action, spent FROM costed, budgets WHERE action < 12 AND spent <= budget"""))
def within_budget(d: Derived):
    return policy.within_budget(d.log).select("budget", "patient_id", "step", "action", "spent")


_PANEL_NAMES = "[" + ", ".join(f"'{n}'" for n in PANEL_PRICES) + "]"


@query("action_distribution", with_tables("log", body=f"""
    SELECT action, {_PANEL_NAMES}[action + 1] AS panel, count(*) AS n FROM log WHERE action < 12 GROUP BY ALL"""))
def action_distribution(d: Derived):
    return policy.action_distribution(d.log)


@query("personal_costs", with_tables("log", extra=_COST, body="SELECT patient_id, g, round(cost, 8) AS cost FROM own_cost"))
def personal_costs(d: Derived):
    rows = d.episode_patients.select("patient_id", F.posexplode(costs.personal_costs("lab_group_idx")).alias("g", "cost"))
    return rows.select("patient_id", "g", F.round("cost", 8).alias("cost"))


@query("legal_actions", with_tables("log", extra=_COST, body="""
    SELECT patient_id, a::INTEGER AS action, a >= 12 OR list_contains(groups, a) AS legal, NOT (a >= 12 OR list_contains(groups, a)) AS pending
    FROM done, range(0, 14) t(a)"""))
def legal_actions(d: Derived):
    mask = costs.legal_actions("lab_group_idx")
    rows = d.episode_patients.select(
        "patient_id", costs.pending_panels("lab_group_idx").alias("open"), F.posexplode(mask).alias("action", "legal")
    )
    return rows.select("patient_id", "action", "legal", F.array_contains("open", F.col("action")).alias("pending"))


@query("step_rewards", with_tables("log", extra=_COST, body="""
    SELECT l.patient_id, step, action, round(CASE WHEN action < 12 THEN -c.cost WHEN label = 1 AND action = 12 THEN -99 * 15
        WHEN label = 0 AND action = 13 THEN -99 ELSE 0 END, 8)::DOUBLE AS reward
    FROM log l LEFT JOIN own_cost c ON c.patient_id = l.patient_id AND c.g = l.action"""))
def step_rewards(d: Derived):
    out = policy.logged_rewards(d.log, d.episode_patients)
    return out.select("patient_id", "step", "action", F.round("reward", 8).alias("reward"))


@query("masked_probabilities", with_tables("log", extra=_COST, body="""
    SELECT patient_id, round(max(p) FILTER (a = 13) / (max(p) FILTER (a = 13) + max(p) FILTER (a = 12)), 10) AS p_ill,
      round(sum(p) FILTER (a < 12), 10) AS p_tests
    FROM (SELECT patient_id, a, w / sum(w) OVER (PARTITION BY patient_id) AS p FROM (
      SELECT patient_id, a, CASE WHEN a >= 12 OR list_contains(groups, a) THEN (1 + (patient_id * 7 + a * 5) % 11)::DOUBLE ELSE 0 END AS w
      FROM done, range(0, 14) t(a))) GROUP BY patient_id"""))
def masked_probabilities(d: Derived):
    rows = d.episode_patients.withColumns({
        "raw": F.transform(F.sequence(F.lit(0), F.lit(13)), lambda a: (1 + (F.col("patient_id") * 7 + a * 5) % 11).cast("double")),
        "mask": costs.legal_actions("lab_group_idx"),
    })
    rows = rows.withColumn("p", costs.masked_probabilities("raw", "mask"))
    tests = F.aggregate(F.slice("p", 1, 12), F.lit(0.0), lambda acc, x: acc + x)
    return rows.select(
        "patient_id", F.round(costs.ill_probability("p"), 10).alias("p_ill"), F.round(tests, 10).alias("p_tests")
    )


@query("episodes", with_tables("log", extra={**_COST, "e": "SELECT * FROM log WHERE action >= 12"}, body="""
    SELECT p.patient_id, p.label, coalesce(e.prob_pos, 0)::DOUBLE AS prob, coalesce(e.action = 13, FALSE) AS predicted, p.cost, p.n_tests
    FROM (SELECT patient_id, max(label) AS label, sum(cost) AS cost, count(*) FILTER (action < 12) AS n_tests FROM costed GROUP BY 1) p
    LEFT JOIN e USING (patient_id)"""))
def episodes(d: Derived):
    return policy.episodes(d.log)


_GROUPED = {
    "cells": "SELECT budget, prob AS score, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM stops GROUP BY ALL",
    "curve": """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY budget) AS p, sum(neg) OVER (PARTITION BY budget) AS n,
        lead(pos) OVER (PARTITION BY budget ORDER BY score DESC) AS next_pos, lead(neg) OVER (PARTITION BY budget ORDER BY score DESC) AS next_neg,
        row_number() OVER (PARTITION BY budget ORDER BY score DESC) AS rn FROM cells WINDOW w AS (PARTITION BY budget ORDER BY score DESC)""",
    "points": """SELECT budget, 'Infinity'::DOUBLE AS threshold, 0::DOUBLE AS fpr, 0::DOUBLE AS tpr FROM curve GROUP BY ALL
      UNION ALL SELECT budget, score, fp::DOUBLE / n::DOUBLE, tp::DOUBLE / p::DOUBLE FROM curve
      WHERE rn = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg""",
    "best": "SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY budget ORDER BY sqrt(fpr * fpr + (1 - tpr) * (1 - tpr)), threshold DESC) = 1",
    "areas": """SELECT budget, sum((neg * (2 * (tp - pos) + pos))::BIGINT)::DOUBLE / 2 / (max(p)::DOUBLE * max(n)::DOUBLE) AS auroc,
        sum(pos::DOUBLE * tp::DOUBLE / (tp + fp)::DOUBLE) / max(p)::DOUBLE AS ap FROM curve GROUP BY budget""",
    "f": """SELECT budget, coalesce(2 * count(*) FILTER (predicted AND label = 1) / nullif(2 * count(*) FILTER (predicted AND label = 1)
        + count(*) FILTER (predicted AND label = 0) + count(*) FILTER (NOT predicted AND label = 1), 0)::DOUBLE, 0)::DOUBLE AS f1,
        avg(n_tests)::DOUBLE AS mean_tests FROM stops GROUP BY budget""",
}


@query("budget_stops", with_tables("log", extra=_COST, body="SELECT budget, patient_id, label, prob, predicted, n_tests FROM stops"))
def budget_stops(d: Derived):
    return policy.budget_stops(d.log)


@query("budget_curve", with_tables("log", extra={**_COST, **_GROUPED}, body="""
    SELECT budget, f1, round(auroc, 10) AS auroc, round(ap, 10) AS ap, tpr AS sensitivity, 1 - fpr AS specificity, threshold, round(mean_tests, 10) AS mean_tests
    FROM areas JOIN best USING (budget) JOIN f USING (budget)"""))
def budget_curve(d: Derived):
    out = policy.budget_curve(d.log)
    return out.withColumns({c: F.round(c, 10) for c in ("auroc", "ap", "mean_tests")})


_REPORT = {
    **_COST,
    "budgets": "SELECT 1000000 AS budget",
    **_GROUPED,
    "r": """SELECT sum(CASE WHEN action < 12 THEN -c.cost WHEN label = 1 AND action = 12 THEN -99 * 15
        WHEN label = 0 AND action = 13 THEN -99 ELSE 0 END) AS reward FROM log l LEFT JOIN own_cost c ON c.patient_id = l.patient_id AND c.g = l.action""",
    "t": "SELECT count(DISTINCT patient_id) AS n_patients, sum(cost) AS cost FROM costed",
}


@query("policy_report", with_tables("log", extra=_REPORT, body="""
    SELECT n_patients, f1, round(auroc, 10) AS auroc, round(ap, 10) AS ap, tpr AS sensitivity, 1 - fpr AS specificity, threshold,
      round(reward / n_patients, 6) AS mean_reward, round(cost / n_patients, 6) AS mean_cost, round(mean_tests, 6) AS mean_tests
    FROM areas JOIN best USING (budget) JOIN f USING (budget), r, t"""))
def policy_report(d: Derived):
    out = policy.policy_report(d.log, d.episode_patients)
    return out.withColumns({
        **{c: F.round(c, 10) for c in ("auroc", "ap")},
        **{c: F.round(c, 6) for c in ("mean_reward", "mean_cost", "mean_tests")},
    })


DRAWS = 200
_DRAWN = {
    "people": "SELECT patient_id AS who, row_number() OVER (ORDER BY patient_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT patient_id FROM all_log)",
    "draws": f"""SELECT r AS draw, floor(('0x' || substr(md5('3:' || r), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE
        * (SELECT max(n) FROM people))::BIGINT AS i FROM range(1, {DRAWS + 1}) t(r)""",
    "log": "SELECT draw AS patient_id, step, action, prob_pos, label FROM draws JOIN people USING (i) JOIN all_log l ON l.patient_id = who",
}


@query("policy_report_drawn", with_tables("log", extra={**_DRAWN, **_REPORT}, body="""
    SELECT n_patients, f1, round(auroc, 10) AS auroc, round(ap, 10) AS ap, tpr AS sensitivity, 1 - fpr AS specificity, threshold,
      round(reward / n_patients, 6) AS mean_reward, round(cost / n_patients, 6) AS mean_cost, round(mean_tests, 6) AS mean_tests
    FROM areas JOIN best USING (budget) JOIN f USING (budget), r, t""").replace("WITH log AS (", "WITH all_log AS (", 1))
def policy_report_drawn(d: Derived):
    """The report over episodes whose patients are drawn with replacement."""
    out = policy.drawn_policy_report(d.log, d.episode_patients, DRAWS, seed=3)
    return out.withColumns({
        **{c: F.round(c, 10) for c in ("auroc", "ap")},
        **{c: F.round(c, 6) for c in ("mean_reward", "mean_cost", "mean_tests")},
    })


@query("legal_along_log", with_tables("log", extra=_COST, body="""
    SELECT patient_id, step, action, string_agg(CASE WHEN open THEN a::VARCHAR END, ',' ORDER BY a) AS legal, bool_or(open AND a = action) AS was_legal
    FROM (SELECT l.patient_id, l.step, l.action, t.a, t.a >= 12 OR (list_contains(coalesce(groups, []), t.a)
        AND NOT EXISTS (SELECT 1 FROM log e WHERE e.patient_id = l.patient_id AND e.step < l.step AND e.action = t.a)) AS open
      FROM log l LEFT JOIN done USING (patient_id), range(0, 14) t(a)) GROUP BY ALL"""))
def legal_along_log(d: Derived):
    out = policy.legal_along_log(d.log, d.episode_patients)
    open_ = F.filter(F.transform("legal", lambda ok, a: F.when(ok, a.cast("string"))), lambda a: a.isNotNull())
    return out.select("patient_id", "step", "action", F.array_join(open_, ",").alias("legal"), "was_legal")


# ---- texts --------------------------------------------------------------------------

END = "</s>"
_COLS = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("flat_row_text", f"""
    SELECT c_custkey, 'c_name : ' || c_name || CASE WHEN c_nationkey <> 0 THEN ' | c_nationkey : ' || c_nationkey ELSE '' END
      || CASE WHEN c_acctbal <> 0 THEN ' | c_acctbal : ' || c_acctbal::VARCHAR ELSE '' END
      || CASE WHEN c_mktsegment <> 'MACHINERY' THEN ' | c_mktsegment : ' || c_mktsegment ELSE '' END || '{END}' AS text FROM customer""")
def flat_row_text(d: Derived):
    rows = d.table("customer").withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'MACHINERY')"))
    return rows.select("c_custkey", text.flat_row_text(rows, _COLS, END).alias("text"))


def _segmented(d: Derived):
    rows = d.table("part").withColumns({
        "p_retailprice": F.expr("CASE WHEN p_size % 5 <> 0 THEN p_retailprice - 900 END"),
        "groups": F.expr("CASE WHEN p_partkey % 3 = 0 THEN array(1, 0) WHEN p_partkey % 3 = 1 THEN array(1) ELSE array() END").cast("array<int>"),
    })
    panels = [["p_size", "p_retailprice"], ["p_type", "p_brand"]]
    return rows, text.segments(rows, ["p_name", "p_retailprice"], panels, "groups")


_PRICE_SQL = "CASE WHEN p_size % 5 <> 0 THEN p_retailprice - 900 END"
_SEGMENTS = {
    "parts": f"""SELECT p_partkey, [
        'p_name : ' || p_name || CASE WHEN {_PRICE_SQL} <> 0 THEN ' | p_retailprice : ' || ({_PRICE_SQL})::VARCHAR ELSE '' END]
      || CASE p_partkey % 3 WHEN 0 THEN [b, a] WHEN 1 THEN [b] ELSE [] END AS parts
      FROM (SELECT *, 'p_size : ' || p_size || ' | p_retailprice : ' || coalesce(({_PRICE_SQL})::VARCHAR, 'nan') AS a,
        'p_type : ' || p_type || ' | p_brand : ' || p_brand AS b FROM part)"""
}


@query("segmented_row_text", with_tables(extra=_SEGMENTS, body=f"""
    SELECT p_partkey, array_to_string(parts, '{END}') || '{END}' AS text FROM parts"""))
def segmented_row_text(d: Derived):
    rows, parts = _segmented(d)
    return rows.select("p_partkey", text.segmented_row_text(parts, END).alias("text"))


@query("growing_text", with_tables(extra=_SEGMENTS, body=f"""
    SELECT p_partkey, (k - 1)::INTEGER AS step, array_to_string(parts[1:k], '{END}') || '{END}' AS text
    FROM parts, range(1, 4) t(k) WHERE k <= len(parts)"""))
def growing_text(d: Derived):
    rows, parts = _segmented(d)
    return text.growing_text(rows.select("p_partkey", parts.alias("parts")), "parts", END)


@query("label_rows", """
    SELECT doc_id, (quality = 1)::INTEGER AS label, (doc_id % 4)::INTEGER AS first_group, 2::INTEGER AS n_groups FROM labels""")
def label_rows(d: Derived):
    from ..plans.training import label_rows as read_labels

    rows = d.table("labels").selectExpr(
        "doc_id", "quality = 1 AS outcome", "concat('[', cast(doc_id % 4 as string), ', 7]') AS lab_group_idx"
    )
    out = read_labels(rows, "outcome")
    return out.select(
        "doc_id", "label", F.get("lab_group_idx", F.lit(0)).alias("first_group"), F.size("lab_group_idx").alias("n_groups")
    )
