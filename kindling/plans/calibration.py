"""Isotonic calibration and thresholds by group; the SQL has the max-min form of the fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindling.operators import isotonic
from kindling.plans.common import registry, table

QUERIES, ORACLES, query = registry()

#: Probabilities of 550 levels and an event, by track and category; one group has few events.
ROWS = """x AS (SELECT l_returnflag AS track, l_linestatus AS category, (round(l_quantity * 11) + round(l_discount * 100)) / 561.0::DOUBLE AS p, CAST(l_extendedprice > 30000 AS INT) AS y FROM lineitem),
    g AS (SELECT track, category, CAST(sum(y) AS BIGINT) AS events, count(*) AS "rows", sum(y) >= 20 AND count(*) - sum(y) >= 20 AS ok FROM x GROUP BY ALL)"""
KNOTS = f"""{ROWS}, l AS (SELECT track, category, p, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS w FROM x JOIN g USING (track, category) WHERE ok GROUP BY ALL),
    c AS (SELECT *, sum(s) OVER u AS cs, sum(w) OVER u AS cw FROM l WINDOW u AS (PARTITION BY track, category ORDER BY p)),
    m AS (SELECT a.track, a.category, a.p AS pa, b.p AS pb, min((b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.track, a.category, a.p ORDER BY b.p DESC) AS low FROM c a JOIN c b ON a.track = b.track AND a.category = b.category AND a.p <= b.p),
    f AS (SELECT track, category, pb AS p, max(low) AS v FROM m GROUP BY ALL),
    q AS (SELECT track, category, k, k / 200.0::DOUBLE AS x FROM g, range(0, 201) t(k) WHERE ok),
    h AS (SELECT q.*, b.p AS bp, b.v AS bv, a.p AS ap, a.v AS av FROM q ASOF LEFT JOIN f b ON q.track = b.track AND q.category = b.category AND b.p <= q.x + 5e-13 ASOF LEFT JOIN f a ON q.track = a.track AND q.category = a.category AND a.p >= q.x - 5e-13),
    v AS (SELECT track, category, k, x, CASE WHEN bp IS NULL THEN av WHEN ap IS NULL OR ap <= bp THEN bv ELSE bv + (av - bv) * (x - bp) / (ap - bp) END AS y FROM h),
    d AS (SELECT *, lead(y) OVER u - 2 * y + lag(y) OVER u AS bend FROM v WINDOW u AS (PARTITION BY track, category ORDER BY k)),
    e AS (SELECT *, row_number() OVER (PARTITION BY track, category ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY track, category) - 1 AS n FROM d WHERE bend IS NULL OR abs(bend) > 1e-9),
    knots AS (SELECT track, category, CAST(row_number() OVER u AS INT) AS place, round(x, 4) AS x, round(max(y) OVER u, 5) AS y FROM e WHERE n < 60 OR list_contains(list_transform(range(0, 60), lambda j: CAST(round(j * n / 59.0::DOUBLE) AS BIGINT)), i) WINDOW u AS (PARTITION BY track, category ORDER BY k))"""


def _rows(spark, sf_dir):
    p = (F.round(F.col("l_quantity") * 11) + F.round(F.col("l_discount") * 100)).cast("double") / 561.0
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("track"), F.col("l_linestatus").alias("category"), p.alias("p"), (F.col("l_extendedprice") > 30000).cast("int").alias("y"))


@query(f"WITH {KNOTS} SELECT track, category, place, x, y FROM knots")
def isotonic_knots(spark, sf_dir):
    """Sixty knots at most of the isotonic fit of each group with twenty events and twenty others."""
    x = _rows(spark, sf_dir)
    n = x.groupBy("track", "category").agg(F.sum("y").alias("e"), F.count("*").alias("n")).where("e >= 20 and n - e >= 20")
    keys = ["track", "category"]
    return isotonic.knots(isotonic.blocks(x.join(F.broadcast(n.select(*keys)), keys), keys, "p", "y"), keys)  # a row for each track and category


@query(f"""WITH {KNOTS},
    z AS (SELECT x.track, x.category, x.p, y, coalesce(g.ok, false) AS ok FROM x JOIN g USING (track, category)),
    i AS (SELECT z.*, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM z ASOF LEFT JOIN knots a ON z.track = a.track AND z.category = a.category AND a.x <= z.p ASOF LEFT JOIN knots b ON z.track = b.track AND z.category = b.category AND b.x > z.p),
    cal AS (SELECT track, category, y, CASE WHEN NOT ok THEN p WHEN xa IS NULL THEN yb WHEN xb IS NULL THEN ya ELSE (yb - ya) / (xb - xa) * (p - xa) + ya END AS c FROM i),
    tau AS (SELECT track, category, j, round(j * 0.05::DOUBLE, 2) AS tau, CAST(count(*) FILTER (y = 1 AND c >= round(j * 0.05::DOUBLE, 2)) AS BIGINT) AS hits, count(*) FILTER (c >= round(j * 0.05::DOUBLE, 2)) AS alarms, CAST(sum(y) AS BIGINT) AS events FROM cal, range(1, 20) t(j) GROUP BY ALL),
    o AS (SELECT track, category, j, tau, hits::DOUBLE / nullif(alarms + events - hits, 0) AS csi, alarms::DOUBLE / nullif(events, 0) AS bias, events FROM tau),
    best AS (SELECT track, category, list_reduce(os, lambda b, o: CASE WHEN o.events >= 20 AND o.bias BETWEEN 0.8 AND 1.25 AND (b.csi IS NULL OR o.csi > b.csi)
        THEN {{'tau': o.tau, 'csi': round_even(o.csi, 4), 'bias': round_even(o.bias, 4), 'events': o.events}} ELSE b END, {{'tau': NULL::DOUBLE, 'csi': NULL::DOUBLE, 'bias': NULL::DOUBLE, 'events': NULL::BIGINT}}) AS b FROM (SELECT track, category, list({{'tau': tau, 'csi': csi, 'bias': bias, 'events': events}} ORDER BY j) AS os FROM o GROUP BY ALL))
    SELECT track, category, g.events, g."rows", CASE WHEN ok THEN 'fitted' ELSE 'identity' END AS status, coalesce(b.tau, 0.5) AS threshold, b.csi AS csi, b.bias AS bias,
        CASE WHEN g.events < 20 THEN 'too few events' WHEN b.tau IS NULL THEN 'none within bounds' ELSE 'fitted' END AS source FROM g JOIN best USING (track, category)""")
def calibration_fit(spark, sf_dir):
    """For each track and category whether it has the support to be fitted, and the threshold that its calibrated probabilities ask for."""
    keys = ["track", "category"]
    rows, support = isotonic.calibrated(_rows(spark, sf_dir), keys, "p", "y")
    best = isotonic.best_thresholds(rows, keys, "calibrated", "y").drop("events", "rows")
    return support.join(best, keys)
