"""Counts regressed on groups: the fits are by Newton steps, their SQL is the closed form that saturated designs have."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindling.operators import glm
from kindling.plans.common import r, registry, table

QUERIES, ORACLES, query = registry()

#: Days of a station by type of event: n events, an effort of 1 or 2 and a fold.
CELLS = """c AS (SELECT user_id % 4 AS fold, event_type, user_id % 3 = 0 AS fast, user_id % 2 AS double_effort, ln(1 + user_id % 2) AS effort, count(*) AS y
    FROM events GROUP BY user_id, event_type, CAST(ts AS DATE))"""


def _cells(spark, sf_dir):
    """A row per station, type and day; a dummy for each type but the first in order."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("y"))
    kinds = [x[0] for x in e.select("event_type").distinct().orderBy("event_type").collect()]  # a handful of types
    e = e.withColumns({f"is_{k}": (F.col("event_type") == k).cast("double") for k in kinds[1:]})
    e = e.withColumns({"fold": F.col("user_id") % 4, "fast": (F.col("user_id") % 3 == 0).cast("double"), "effort": F.log(1.0 + F.col("user_id") % 2)})
    return e, [f"is_{k}" for k in kinds[1:]]


def _rounded(df):
    return df.select("term", *(r(F.col(c)).alias(c) for c in ("coefficient", "se", "low", "high")))


@query(f"""WITH {CELLS}, g AS (SELECT event_type, sum(y) AS y, sum(exp(effort)) AS e, row_number() OVER (ORDER BY event_type) AS place FROM c GROUP BY event_type),
    f AS (SELECT y, e FROM g WHERE place = 1),
    t AS (SELECT CASE WHEN place = 1 THEN '(intercept)' ELSE 'is_' || event_type END AS term, ln(g.y / g.e) - CASE WHEN place = 1 THEN 0 ELSE ln(f.y / f.e) END AS b,
          sqrt(1 / g.y + CASE WHEN place = 1 THEN 0 ELSE 1 / f.y END) AS s FROM g, f)
    SELECT term, round(b, 6) AS coefficient, round(s, 6) AS se, round(b - 1.959963984540054 * s, 6) AS low, round(b + 1.959963984540054 * s, 6) AS high FROM t""")
def glm_coefficients(spark, sf_dir):
    """Coefficients with standard errors and intervals of a Poisson fit with an offset."""
    rows, kinds = _cells(spark, sf_dir)
    return _rounded(glm.poisson(rows, kinds, "y", "effort")[None].table(spark))


@query(f"""WITH {CELLS}, g AS (SELECT event_type, sum(y) / sum(exp(effort)) AS rate FROM c GROUP BY event_type),
    h AS (SELECT fast, sum(y) AS y, sum(exp(effort) * rate) AS mu FROM c JOIN g USING (event_type) GROUP BY fast),
    t AS (SELECT '(intercept)' AS term, ln(y / mu) AS b, sqrt(1 / y) AS s FROM h WHERE NOT fast UNION ALL
          SELECT 'fast', ln(a.y / a.mu) - ln(b.y / b.mu), sqrt(1 / a.y + 1 / b.y) FROM h a, h b WHERE a.fast AND NOT b.fast)
    SELECT term, round(b, 6) AS coefficient, round(s, 6) AS se, round(b - 1.959963984540054 * s, 6) AS low, round(b + 1.959963984540054 * s, 6) AS high FROM t""")
def residual_glm(spark, sf_dir):
    """What a further term explains beyond a fitted base rate."""
    rows, kinds = _cells(spark, sf_dir)
    base = glm.poisson(rows, kinds, "y", "effort")[None]
    return _rounded(glm.residual(rows, base, "effort", ["fast"], "y").table(spark))


@query(f"""WITH {CELLS}, h AS (SELECT double_effort, sum(y) AS y, count(*) AS n FROM c GROUP BY double_effort),
    t AS (SELECT (ln(a.y / a.n) - ln(b.y / b.n)) / ln(2) AS b, sqrt(1 / a.y + 1 / b.y) / ln(2) AS s FROM h a, h b WHERE a.double_effort = 1 AND b.double_effort = 0)
    SELECT round(b, 6) AS exponent, round(b - 1.959963984540054 * s, 6) AS low, round(b + 1.959963984540054 * s, 6) AS high, b - 1.959963984540054 * s <= 1 AND 1 <= b + 1.959963984540054 * s AS one_inside FROM t""")
def effort_exponent(spark, sf_dir):
    """How steeply the effort enters the rate, with its interval, where it is the only term."""
    rows, kinds = _cells(spark, sf_dir)
    found = glm.identifiability(rows, spark, kinds, "y", "effort").where("fit = 'alone'")
    return found.select(*(r(F.col(c)).alias(c) for c in ("exponent", "low", "high")), "one_inside")


@query(f"""WITH {CELLS}, k AS (SELECT DISTINCT fold AS k FROM c),
    o AS (SELECT k, sum(y) / sum(exp(effort)) AS rate FROM c, k WHERE fold <> k GROUP BY k),
    g AS (SELECT k, event_type, sum(y) / sum(exp(effort)) AS rate FROM c, k WHERE fold <> k GROUP BY k, event_type),
    h AS (SELECT g.k, fast, sum(y) / sum(exp(effort) * rate) AS more FROM c JOIN g USING (event_type) WHERE fold <> g.k GROUP BY g.k, fast),
    p AS (SELECT c.fold, c.y, exp(effort) * o.rate AS l1, exp(effort) * g.rate AS l2, exp(effort) * g.rate * h.more AS l3 FROM c JOIN o ON o.k = fold JOIN g ON g.k = fold AND g.event_type = c.event_type JOIN h ON h.k = fold AND h.fast = c.fast)
    SELECT fold, count(*) AS n, round(avg(l1 - y * ln(l1)), 6) AS loss_offset, round(avg(l2 - y * ln(l2)), 6) AS loss_seasonal, round(avg(l3 - y * ln(l3)), 6) AS loss_full FROM p GROUP BY fold""")
def crossfit_arms(spark, sf_dir):
    """Three nested models compared by their mean negative log-likelihood on folds that they haven't seen."""
    rows, kinds = _cells(spark, sf_dir)
    x = glm.crossfit_arms(rows, kinds, ["fast"], "y", "effort", "fold", alphas=(0.0, 0.0))
    loss = lambda lam: F.avg(F.col(lam) - F.col("y") * F.log(lam))
    return x.groupBy("fold").agg(F.count("*").alias("n"), *(r(loss(f"lam_{a}")).alias(f"loss_{a}") for a in ("offset", "seasonal", "full")))
