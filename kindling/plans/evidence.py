"""Grids, splits, label policy, verification metrics, calibration and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kindling.functions import scores, times
from kindling.operators import grids, metrics, ranks, splits
from kindling.plans.common import r, registry, table

QUERIES, ORACLES, query = registry()

#: Embeddings as grids: a vector is a day, its components are 8 cells to a row.
GRID = "(SELECT vec_id, label, CAST((i - 1) // 8 AS INT) AS row, CAST((i - 1) % 8 AS INT) AS col, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 4096) t(i) WHERE i <= len(embedding))"


def _grid(spark, sf_dir):
    cells = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "value"))
    return cells.select("vec_id", "label", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).alias("col"), F.col("value").cast("double").alias("value"))


@query(f"""WITH a AS (SELECT label, vec_id, max(value) AS top, min(value) AS low, avg(value) AS mean, avg(value) FILTER (row BETWEEN 1 AND 2) AS part FROM {GRID} GROUP BY ALL)
SELECT label, count(*) AS leads, round(max(top), 6) AS top, round(min(low), 6) AS low, round(quantile_cont(top, 0.9), 6) AS p90, round(sum(mean), 5) AS total, round(max(part), 6) AS part FROM a GROUP BY label""")
def cell_reduce_two_level(spark, sf_dir):
    part = F.avg(F.when(F.col("row").between(1, 2), F.col("value")))
    leads = _grid(spark, sf_dir).groupBy("label", "vec_id").agg(F.max("value").alias("top"), F.min("value").alias("low"), F.avg("value").alias("mean"), part.alias("part"))
    return leads.groupBy("label").agg(F.count("*").alias("leads"), r(F.max("top")).alias("top"), r(F.min("low")).alias("low"), r(F.percentile("top", F.lit(0.9))).alias("p90"), r(F.sum("mean"), 5).alias("total"), r(F.max("part")).alias("part"))


@query(f"""WITH g AS MATERIALIZED (SELECT * FROM {GRID}), n AS (SELECT a.vec_id, a.row, a.col, max(b.value) AS m FROM g a JOIN g b ON b.vec_id = a.vec_id AND (b.row - a.row) * (b.row - a.row) + (b.col - a.col) * (b.col - a.col) <= 1 GROUP BY ALL)
SELECT vec_id, count(*) AS cells, round(sum(m), 4) AS total FROM n GROUP BY vec_id""")
def neighborhood_max(spark, sf_dir):
    return grids.neighbourhood_max(_grid(spark, sf_dir), 1, ["vec_id"]).groupBy("vec_id").agg(F.count("*").alias("cells"), r(F.sum("nbhd_max"), 4).alias("total"))


@query(f"""WITH g AS MATERIALIZED (SELECT vec_id, row, col, CASE WHEN (row * 8 + col) % 5 <> 0 THEN value END AS value FROM {GRID}),
n AS (SELECT a.vec_id, a.row, a.col, sum(b.value * exp(-((b.row - a.row) * (b.row - a.row) + (b.col - a.col) * (b.col - a.col)) / 2.0::DOUBLE)) / sum(exp(-((b.row - a.row) * (b.row - a.row) + (b.col - a.col) * (b.col - a.col)) / 2.0::DOUBLE)) AS s
FROM g a LEFT JOIN g b ON b.vec_id = a.vec_id AND b.value IS NOT NULL AND abs(b.row - a.row) <= 2 AND abs(b.col - a.col) <= 2 GROUP BY ALL) SELECT vec_id, count(s) AS cells, round(sum(s), 4) AS total FROM n GROUP BY vec_id""")
def nan_gauss(spark, sf_dir):
    holes = _grid(spark, sf_dir).drop("label").withColumn("value", F.when((F.col("row") * 8 + F.col("col")) % 5 != 0, F.col("value")))
    return grids.gaussian(holes, 1.0, 2, ["vec_id"]).groupBy("vec_id").agg(F.count("smoothed").alias("cells"), r(F.sum("smoothed"), 4).alias("total"))


LIMITS = [-0.5, 0.0, 0.5, 1.0]


@query(f"""WITH k AS (SELECT CAST(k AS INT) AS k, [-0.5, 0.0, 0.5, 1.0][k]::DOUBLE AS lim FROM range(1, 5) t(k)), p AS (SELECT label, row, col, k, sum((1 + vec_id % 3) * (value > lim)::INT) / sum(1 + vec_id % 3)::DOUBLE AS p FROM {GRID}, k GROUP BY ALL),
m AS (SELECT *, min(p) OVER (PARTITION BY label, row, col ORDER BY k) AS q FROM p) SELECT label, row, col, round(max(q) FILTER (k = 1), 6) AS p1, round(min(q), 6) AS p4, CAST(coalesce(max(k) FILTER (q >= 0.3), 0) AS INT) AS category FROM m GROUP BY ALL""")
def exceedance_monotone(spark, sf_dir):
    """Weighted shares above each limit, made non-increasing over the limits, and the largest one still likely enough."""
    limits = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("k"), F.lit(x).alias("lim")) for i, x in enumerate(LIMITS)))).alias("x")
    w = 1 + F.col("vec_id") % 3
    p = _grid(spark, sf_dir).select("*", limits).groupBy("label", "row", "col", "x.k").agg((F.sum(F.when(F.col("value") > F.col("x.lim"), w).otherwise(0)) / F.sum(w)).alias("p"))
    q = p.withColumn("q", F.min("p").over(Window.partitionBy("label", "row", "col").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    return q.groupBy("label", "row", "col").agg(r(F.max(F.when(F.col("k") == 1, F.col("q")))).alias("p1"), r(F.min("q")).alias("p4"), F.coalesce(F.max(F.when(F.col("q") >= 0.3, F.col("k"))), F.lit(0)).alias("category"))


def _days(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_custkey", "o_totalprice")


@query("""WITH e AS (SELECT DISTINCT CAST(floor(datediff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) / 14) AS BIGINT) AS episode FROM orders), b AS (SELECT episode, CAST(ntile(5) OVER (ORDER BY episode) - 1 AS INT) AS block FROM e)
SELECT episode, block, CAST(fold AS INT) AS fold, CASE WHEN block = fold THEN 'validation' ELSE 'train' END AS side FROM b, range(0, 5) t(fold)""")
def episode_block_split(spark, sf_dir):
    rows = _days(spark, sf_dir).select(times.episode(F.col("day")).alias("episode"))
    return splits.folds(splits.blocks(rows, "episode", 5), "episode", 5)


@query("""WITH w AS (SELECT DISTINCT isoyear(o_orderdate) AS y, weekofyear(o_orderdate) AS w FROM orders) SELECT CAST(y AS INT) AS iso_year, CAST(w AS INT) AS iso_week, CASE WHEN (dense_rank() OVER (ORDER BY y, w) - 1) % 4 = 1 THEN 'test' ELSE 'train' END AS side FROM w""")
def week_split(spark, sf_dir):
    weeks = _days(spark, sf_dir).select(F.extract(F.lit("YEAROFWEEK"), "day").alias("iso_year"), F.weekofyear("day").alias("iso_week")).distinct()
    place = F.dense_rank().over(Window.orderBy("iso_year", "iso_week")) - 1
    return weeks.select("iso_year", "iso_week", F.when(place % 4 == 1, "test").otherwise("train").alias("side"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), b AS (SELECT day, datediff('day', (SELECT min(day) FROM d), day) // 14 AS block FROM d), t AS (SELECT day, (dense_rank() OVER (ORDER BY block) - 1) % 4 = 1 AS test FROM b),
x AS (SELECT day, CASE WHEN test THEN 'test' WHEN EXISTS (SELECT 1 FROM t u WHERE u.test AND abs(datediff('day', u.day, t.day)) <= 7) THEN 'purged' ELSE 'train' END AS side FROM t),
s AS (SELECT DISTINCT o_custkey, CASE WHEN list_sum(list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', substr(sha1(CAST(o_custkey AS VARCHAR)), i, 1)) - 1)) % 5 = 0 THEN 'test' ELSE 'train' END AS side FROM orders)
SELECT CASE WHEN x.side = 'train' AND s.side = 'train' THEN 'train' WHEN x.side = 'test' AND s.side = 'test' THEN 'test' ELSE 'excluded' END AS side, count(*) AS n, count(DISTINCT x.day) AS days FROM orders o JOIN x ON x.day = CAST(o.o_orderdate AS DATE) JOIN s ON s.o_custkey = o.o_custkey GROUP BY 1""")
def purged_station_split(spark, sf_dir):
    rows = _days(spark, sf_dir)
    days = splits.purged_days(rows, "day").withColumnRenamed("side", "day_side")
    both = rows.withColumn("station_side", splits.hashed_side(F.col("o_custkey"))).join(days, "day")
    same = lambda v: (F.col("day_side") == v) & (F.col("station_side") == v)
    return both.groupBy(F.when(same("train"), "train").when(same("test"), "test").otherwise("excluded").alias("side")).agg(F.count("*").alias("n"), F.countDistinct("day").alias("days"))


@query("""SELECT s_suppkey, list_sum(list_transform(range(1, len(s_name) + 1), lambda i: ascii(substr(s_name, i, 1)))) % 5 = 0 AS held FROM supplier""")
def char_sum_stations(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", splits.char_sum_held(F.col("s_name")).alias("held"))


@query("""WITH c AS (SELECT quantile_cont(epoch_us(ts), 0.7) AS cut FROM events), s AS (SELECT event_id // 8 AS grp, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events GROUP BY ALL)
SELECT grp, CASE WHEN b < cut THEN 'train' WHEN a >= cut THEN 'test' ELSE 'dropped' END AS side FROM s, c""")
def time_holdout(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 8).alias("grp"), times.micros(F.col("ts")).alias("us"))
    return splits.time_holdout(rows, "grp", "us", 0.3)


@query("""WITH r AS (SELECT CAST(o_orderdate AS DATE) AS run, min(o_orderkey) AS k FROM orders GROUP BY ALL) SELECT run, CASE WHEN row_number() OVER (ORDER BY run) <= greatest(1, floor(count(*) OVER () * 0.8)) THEN 'development' ELSE 'holdout' END AS side FROM r""")
def run_chronological_split(spark, sf_dir):
    return splits.chronological(_days(spark, sf_dir), "day", "day").withColumnRenamed("day", "run")


@query("""WITH x AS (SELECT d.doc_id, CASE WHEN lang = 'de' THEN 1 WHEN lang = 'fr' THEN 0 END AS a, quality AS b, toxic AS c FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source, label, count(*) AS n, count(*) FILTER (conflict) AS conflicts FROM (SELECT CASE WHEN a IS NOT NULL THEN 'lang' WHEN b IS NOT NULL THEN 'quality' WHEN c IS NOT NULL THEN 'toxic' ELSE 'none' END AS source,
CASE WHEN coalesce(a <> b, false) OR coalesce(a <> c, false) OR coalesce(b <> c, false) THEN NULL ELSE coalesce(a, b, c) END AS label, coalesce(a <> b, false) OR coalesce(a <> c, false) OR coalesce(b <> c, false) AS conflict FROM x) GROUP BY ALL""")
def label_priority_conflict(spark, sf_dir):
    """The first label present names the source; labels that disagree leave none and are flagged."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    x = docs.join(labels, "doc_id", "left").select(F.when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 0).alias("lang"), "quality", "toxic")
    own = ["lang", "quality", "toxic"]
    conflict = F.size(F.array_distinct(F.array_compact(F.array(*own)))) > 1
    source = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in own), F.lit("none"))
    rows = x.select(source.alias("source"), F.when(~conflict, F.coalesce(*own)).alias("label"), conflict.alias("conflict"))
    return rows.groupBy("source", "label").agg(F.count("*").alias("n"), F.count_if("conflict").alias("conflicts"))


PAIR = "SELECT *, l_extendedprice / 1000 AS actual, l_quantity * 1.02::DOUBLE + l_tax * 20 AS pred FROM lineitem"


def _pair(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumns({"actual": F.col("l_extendedprice") / 1000, "pred": F.col("l_quantity") * 1.02 + F.col("l_tax") * 20})


@query(f"""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(abs(pred - actual)), 6) AS mae, round(sqrt(avg((pred - actual) * (pred - actual))), 6) AS rmse, round(avg(pred - actual), 6) AS bias, round(corr(pred, actual), 6) AS r,
round(1 - sum((pred - actual) * (pred - actual)) / (var_pop(actual) * count(*)), 6) AS r2, round(quantile_cont(abs(pred - actual), 0.9), 6) AS p90, round(avg((abs(pred - actual) > 5)::INT), 6) AS over5 FROM ({PAIR}) GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ()) HAVING count(*) >= 100""")
def regression_metrics_by_group(spark, sf_dir):
    """Errors by flag, by status and overall; the exact p90 comes from ranks, so that no group's errors meet in one task."""
    e = F.abs(F.col("pred") - F.col("actual"))
    own = metrics.regression("pred", "actual") + [F.avg((e > 5).cast("double")).alias("over5")]
    kinds = ["l_returnflag", "l_linestatus"]
    rows = _pair(spark, sf_dir).groupingSets([[kinds[0]], [kinds[1]], []], *kinds).agg(*own).where("n >= 100").withColumn("key", F.coalesce(*(F.concat(F.lit(f"{k}="), k) for k in kinds), F.lit("all")))
    counts = _pair(spark, sf_dir).groupBy(*kinds, e.alias("e")).agg(F.count("*").alias("times"))
    keyed = counts.select("e", "times", F.explode(F.array(*(F.concat(F.lit(f"{k}="), k) for k in kinds), F.lit("all"))).alias("key"))
    p90 = ranks.quantiles(keyed, ["key"], "e", {"p90": (0.9, "linear")}, "times")
    return rows.join(p90, "key").select(*kinds, "n", *(r(F.col(c)).alias(c) for c in ("mae", "rmse", "bias", "r", "r2", "p90", "over5")))


CLASSED = "SELECT CAST(least(4, floor(l_quantity / 10.2::DOUBLE)) AS INT) AS a, CAST(least(4, floor((l_quantity + l_tax * 100) / 11.7::DOUBLE)) AS INT) AS p FROM lineitem"


def _classed(spark, sf_dir):
    q = F.col("l_quantity")
    at = lambda x: F.least(F.lit(4), F.floor(x)).cast("int")
    return table(spark, sf_dir, "lineitem").select(at(q / 10.2).alias("a"), at((q + F.col("l_tax") * 100) / 11.7).alias("p"))


@query(f"""WITH x AS ({CLASSED}), c AS (SELECT CAST(k AS INT) AS class, count(*) FILTER (a = k AND p = k) AS tp, count(*) FILTER (a <> k AND p = k) AS fp, count(*) FILTER (a = k AND p <> k) AS fn FROM x, range(0, 5) t(k) GROUP BY k)
SELECT class, tp + fn AS support, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def confusion_f1(spark, sf_dir):
    rows = metrics.class_scores(_classed(spark, sf_dir), "a", "p", [0, 1, 2, 3, 4])
    return rows.select("class", "support", *(r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""SELECT CAST(k AS INT) AS a, {', '.join(f'count(*) FILTER (a = k AND p = {i}) AS "{i}"' for i in range(6))} FROM ({CLASSED}), range(0, 6) t(k) GROUP BY k""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_classed(spark, sf_dir), "a", "p", [0, 1, 2, 3, 4, 5])


PROB = "SELECT round(1 / (1 + exp(-(l_quantity - 25) / 12)), 6) AS p, (l_extendedprice > 25000 + l_discount * 1e5)::INT AS y, l_returnflag AS grp FROM lineitem"


def _prob(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(r(scores.sigmoid((F.col("l_quantity") - 25) / 12)).alias("p"), (F.col("l_extendedprice") > 25000 + F.col("l_discount") * 1e5).cast("int").alias("y"), F.col("l_returnflag").alias("grp"))


@query(f"""WITH x AS ({PROB}), m AS (SELECT avg(y) AS base FROM x), b AS (SELECT least(greatest(floor(p * 10), 0), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM x GROUP BY ALL), e AS (SELECT sum(n * abs(mp - my)) / sum(n) AS ece FROM b),
k AS (SELECT sum(CASE WHEN y = 1 THEN rk END) AS s, sum(y) AS pos, count(*) AS n FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk FROM x)),
l AS (SELECT p, sum(y) AS pos, count(*) AS n FROM x GROUP BY p), c AS (SELECT p, pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen FROM l)
SELECT round((SELECT avg((p - y) * (p - y)) FROM x), 6) AS brier, round(1 - (SELECT avg((p - y) * (p - y)) FROM x) / (SELECT avg((base - y) * (base - y)) FROM x, m), 6) AS skill, round((SELECT ece FROM e), 6) AS ece,
round((SELECT (s - pos * (pos + 1) / 2.0::DOUBLE) / (pos * (n - pos)) FROM k), 6) AS auc, round((SELECT sum(pos * tp / seen::DOUBLE) / sum(pos) FROM c), 6) AS ap,
round((SELECT avg(-(y * ln(greatest(1e-6, least(1 - 1e-6, p))) + (1 - y) * ln(1 - greatest(1e-6, least(1 - 1e-6, p))))) FROM x), 6) AS log_loss""")
def brier_ece_auc_ap(spark, sf_dir):
    x = _prob(spark, sf_dir)
    p, y = F.col("p"), F.col("y")
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    one = x.agg(F.avg((p - y) * (p - y)).alias("brier"), F.var_pop(y).alias("ref"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"))
    ece = metrics.reliability(x, "p", "y").agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))
    all_rows = one.join(F.broadcast(ece)).join(F.broadcast(metrics.auc_and_ap(x, "p", "y")))  # one row each
    return all_rows.select(r(F.col("brier")).alias("brier"), r(1 - F.try_divide("brier", "ref")).alias("skill"), *(r(F.col(c)).alias(c) for c in ("ece", "auc", "ap", "log_loss")))


@query(f"""WITH x AS ({PROB}), t AS (SELECT grp, CAST(k * 5 AS INT) AS tau, count(*) FILTER (p >= k * 5 / 100.0::DOUBLE AND y = 1) AS a, count(*) FILTER (p >= k * 5 / 100.0::DOUBLE AND y = 0) AS b, count(*) FILTER (p < k * 5 / 100.0::DOUBLE AND y = 1) AS c FROM x, range(1, 20) t(k) GROUP BY ALL),
s AS (SELECT grp, tau, round(a / nullif(a + b + c, 0), 9) AS csi, (a + b) / nullif(a + c, 0) AS bias FROM t) SELECT grp, tau AS percent, round(csi, 6) AS csi, round(bias, 6) AS bias FROM s WHERE bias BETWEEN 0.5 AND 2 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY csi DESC, tau) = 1""")
def csi_threshold_search(spark, sf_dir):
    """The threshold with the best critical success index among those whose frequency bias is acceptable; the first of equals."""
    x = _prob(spark, sf_dir).groupBy("grp", "p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    x = x.select("*", F.explode(F.sequence(F.lit(5), F.lit(95), F.lit(5))).alias("percent"))
    yes = F.col("p") >= F.col("percent") / 100.0
    t = x.groupBy("grp", "percent").agg(F.sum(F.when(yes, F.col("pos")).otherwise(0)).alias("a"), F.sum(F.when(yes, F.col("n") - F.col("pos")).otherwise(0)).alias("b"), F.sum(F.when(~yes, F.col("pos")).otherwise(0)).alias("c"))
    s = t.withColumn("csi", r(F.try_divide(F.col("a"), F.col("a") + F.col("b") + F.col("c")), 9)).withColumn("bias", F.try_divide(F.col("a") + F.col("b"), F.col("a") + F.col("c")))
    best = s.where(F.col("bias").between(0.5, 2)).groupBy("grp").agg(F.max_by(F.struct("percent", "csi", "bias"), F.struct("csi", -F.col("percent"))).alias("x"))
    return best.select("grp", "x.percent", r(F.col("x.csi")).alias("csi"), r(F.col("x.bias")).alias("bias"))


@query("""SELECT event_type, round(quantile_cont(value, 0.8), 6) AS linear80, round(list_sort(list(value))[CAST(ceil((count(*) - 1) * 0.8) AS BIGINT) + 1], 6) AS higher80, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type""")
def quantile_linear_higher(spark, sf_dir):
    q = ranks.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"linear80": (0.8, "linear"), "higher80": (0.8, "higher"), "median": (0.5, "linear")})
    return q.select("event_type", *(r(F.col(c)).alias(c) for c in ("linear80", "higher80", "median")))


@query(f"""WITH x AS ({CLASSED}), q AS (SELECT a, median(p) AS m FROM x GROUP BY a), c AS (SELECT CAST(k AS INT) AS a, coalesce(m, k) AS m FROM range(0, 5) t(k) LEFT JOIN q ON q.a = k), d AS (SELECT a, max(m) OVER (ORDER BY a) AS m FROM c)
SELECT a, m AS centre, (m + lead(m) OVER (ORDER BY a)) / 2 AS edge FROM d""")
def threshold_monotone(spark, sf_dir):
    """Class medians, never falling, and the midpoints between them; a class without rows stands at its own number."""
    found = _classed(spark, sf_dir).groupBy("a").agg(F.median("p").alias("m"))
    five = spark.range(5).select(F.col("id").cast("int").alias("a")).join(found, "a", "left").withColumn("m", F.coalesce("m", F.col("a").cast("double")))
    by = Window.orderBy("a")
    rising = five.withColumn("centre", F.max("m").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rising.select("a", "centre", ((F.col("centre") + F.lead("centre").over(by)) / 2).alias("edge"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS y, 0.5::DOUBLE + avg(value) / 40 AS lam FROM events GROUP BY ALL)
SELECT count(*) AS n, round(avg(lam - y * ln(lam) + lgamma(y + 1)), 6) AS log_score, round(2 * sum(CASE WHEN y > 0 THEN y * ln(y / lam) ELSE 0 END - (y - lam)), 4) AS deviance, round(sum((y - lam) * (y - lam) / lam) / (count(*) - 1), 6) AS dispersion FROM d""")
def poisson_scores(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("y"), (0.5 + F.avg("value") / 40).alias("lam"))
    y, lam = F.col("y"), F.col("lam")
    return d.agg(F.count("*").alias("n"), r(F.avg(lam - y * F.log(lam) + metrics.log_factorial(y))).alias("log_score"), r(2 * F.sum(F.when(y > 0, y * F.log(y / lam)).otherwise(0.0) - (y - lam)), 4).alias("deviance"), r(F.sum((y - lam) * (y - lam) / lam) / (F.count("*") - 1)).alias("dispersion"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS y, avg(value) AS lam FROM events GROUP BY ALL), t AS (SELECT *, ntile(10) OVER (ORDER BY lam, user_id, day) AS tile FROM d)
SELECT CAST(tile AS INT) AS tile, count(*) AS n, round(avg(y) - avg(lam), 6) AS gap FROM t GROUP BY tile""")
def decile_gaps(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("y"), F.avg("value").alias("lam"))
    d = ranks.ranked(d, [], [F.col("lam"), F.col("user_id"), F.col("day")])
    tiles = d.join(F.broadcast(d.agg(F.max("rank").alias("rows"))))  # one row
    return tiles.groupBy(ranks.tile(F.col("rank"), F.col("rows"), 10).alias("tile")).agg(F.count("*").alias("n"), r(F.avg("y") - F.avg("lam")).alias("gap"))


@query("""WITH c AS (SELECT n_nationkey, 100.0::DOUBLE + n_nationkey * 10 AS area, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY ALL) ON c_nationkey = n_nationkey), t AS (SELECT sum(n) / sum(area * 30) AS rate FROM c)
SELECT n_nationkey, n AS events, round((5 + n) / (5 / rate + area * 30), 9) AS shrunk, round(ln(area) + ln((5 + n) / (5 / rate + area * 30)), 6) AS log_offset FROM c, t""")
def eb_rate_offset(spark, sf_dir):
    """Events per area and day shrunk toward the pooled rate with the weight of 5 events, and the log offset it gives."""
    good = table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("events"))
    c = table(spark, sf_dir, "nation").join(good, "n_nationkey", "left").select("n_nationkey", F.coalesce("events", F.lit(0)).alias("events"), (100.0 + F.col("n_nationkey") * 10).alias("area"))
    pooled = c.agg((F.sum("events") / F.sum(F.col("area") * 30)).alias("rate"))
    shrunk = (5 + F.col("events")) / (5 / F.col("rate") + F.col("area") * 30)
    return c.join(F.broadcast(pooled)).select("n_nationkey", "events", r(shrunk, 9).alias("shrunk"), r(F.log("area") + F.log(shrunk)).alias("log_offset"))  # one row


@query("""SELECT round(ln(sum(y) / sum(exp(o))), 6) AS intercept, count(*) AS n FROM (SELECT user_id, count(*) AS y, ln(1 + avg(value)) AS o FROM events GROUP BY user_id)""")
def poisson_offset_only(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("y"), F.log(1 + F.avg("value")).alias("o"))
    return d.agg(r(F.log(F.sum("y") / F.sum(F.exp("o")))).alias("intercept"), F.count("*").alias("n"))


@query(f"""WITH x AS ({PROB}), m AS (SELECT count(*) AS n, avg((p - y) * (p - y)) AS brier, avg(y) AS base FROM x),
g AS (SELECT 'rows' AS gate, n::DOUBLE AS value, 1000.0::DOUBLE AS lim, n >= 1000 AS ok FROM m UNION ALL SELECT 'brier', brier, 0.25, brier <= 0.25 FROM m UNION ALL SELECT 'skill', 1 - brier / (base * (1 - base)), 0.05, 1 - brier / (base * (1 - base)) >= 0.05 FROM m UNION ALL SELECT 'outside', NULL, 0.0, NULL)
SELECT gate, CASE WHEN value IS NULL THEN 'deferred' WHEN ok THEN 'pass' ELSE 'fail' END AS status, round(value, 6) AS value, lim AS "limit" FROM g""")
def gate_report(spark, sf_dir):
    p, y = F.col("p"), F.col("y")
    one = _prob(spark, sf_dir).agg(F.count("*").alias("n"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(y).alias("base"))
    skill = 1 - F.col("brier") / (F.col("base") * (1 - F.col("base")))
    gates = [metrics.gate("rows", F.col("n") >= 1000, F.col("n"), 1000), metrics.gate("brier", F.col("brier") <= 0.25, F.col("brier"), 0.25), metrics.gate("skill", skill >= 0.05, skill, 0.05), metrics.gate("outside", F.lit(True), F.lit(None).cast("double"), 0)]
    return one.select(F.explode(F.array(*gates)).alias("g")).select("g.gate", "g.status", r(F.col("g.value")).alias("value"), "g.limit")


@query(f"""WITH x AS (SELECT l_returnflag AS grp, pred - actual AS e, 1 + l_tax * 50 AS w FROM ({PAIR})), b AS (SELECT grp, median(e) AS bias FROM x GROUP BY grp),
c AS (SELECT x.grp, CAST(k AS INT) AS k, avg((abs(e - bias) <= w * (0.5 + 0.05 * k))::INT) AS cover FROM x JOIN b ON b.grp = x.grp, range(0, 111) t(k) GROUP BY ALL)
SELECT b.grp, round(bias, 6) AS bias, round(0.5::DOUBLE + 0.05::DOUBLE * min(k) FILTER (cover >= 0.8), 4) AS scale FROM c JOIN b ON b.grp = c.grp GROUP BY ALL""")
def interval_scale_search(spark, sf_dir):
    """Median bias, and the least width factor that covers four in five."""
    x = _pair(spark, sf_dir).select(F.col("l_returnflag").alias("grp"), (F.col("pred") - F.col("actual")).alias("e"), (1 + F.col("l_tax") * 50).alias("w"))
    b = ranks.quantiles(x, ["grp"], "e", {"bias": (0.5, "linear")})
    off = F.abs(F.col("e") - F.col("bias"))
    wide = lambda k: F.col("w") * (0.5 + 0.05 * k)
    k = F.greatest(F.lit(0), F.ceil((off / F.col("w") - 0.5) / 0.05)).cast("int")
    k = F.when((k > 0) & (off <= wide(k - 1)), k - 1).when(off > wide(k), k + 1).otherwise(k)  # the least step that covers a row, exactly
    steps = x.join(F.broadcast(b), "grp").groupBy("grp", "bias", k.alias("k")).agg(F.count("*").alias("n"))
    grid = steps.where("k <= 110")
    upto = F.sum("n").over(Window.partitionBy("grp").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))  # 111 steps a group
    cover = grid.withColumn("upto", upto).join(steps.groupBy("grp").agg(F.sum("n").alias("rows")), "grp")
    first = cover.groupBy("grp", "bias").agg(F.min(F.when(F.col("upto") / F.col("rows") >= 0.8, F.col("k"))).alias("k"))
    return first.select("grp", r(F.col("bias")).alias("bias"), r(0.5 + 0.05 * F.col("k"), 4).alias("scale"))


@query(f"""WITH x AS (SELECT l_returnflag AS grp, actual, pred, l_linenumber * 8 AS base FROM ({PAIR})), t AS (SELECT grp, CAST(a AS INT) AS a, CAST(c AS INT) AS c, sqrt(avg(pow(base + greatest(-c * 5.0::DOUBLE, least(c * 5.0::DOUBLE, a * 0.05::DOUBLE * (pred - base))) - actual, 2))) AS rmse FROM x, range(0, 21) t(a), range(1, 5) u(c) GROUP BY ALL)
SELECT grp, a AS alpha_step, c AS cap_step, round(rmse, 6) AS rmse FROM t QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(rmse, 9), a, c) = 1""")
def guard_search(spark, sf_dir):
    """How much of a correction to apply, and its cap, by error per group over a fixed grid of 84."""
    x = _pair(spark, sf_dir).select(F.col("l_returnflag").alias("grp"), "actual", "pred", (F.col("l_linenumber") * 8).alias("base"))
    tried = [(a, c) for a in range(21) for c in range(1, 5)]
    moved = lambda a, c: F.col("base") + F.greatest(F.lit(-5.0 * c), F.least(F.lit(5.0 * c), a * 0.05 * (F.col("pred") - F.col("base"))))
    one = x.groupBy("grp").agg(*(F.avg(F.pow(moved(a, c) - F.col("actual"), 2)).alias(f"m{a}_{c}") for a, c in tried))  # one pass, 84 sums
    t = one.select("grp", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(c).alias("c"), F.sqrt(f"m{a}_{c}").alias("rmse")) for a, c in tried))).alias("t")).select("grp", "t.*")
    best = t.groupBy("grp").agg(F.min_by(F.struct("a", "c", "rmse"), F.struct(r(F.col("rmse"), 9), "a", "c")).alias("x"))
    return best.select("grp", F.col("x.a").alias("alpha_step"), F.col("x.c").alias("cap_step"), r(F.col("x.rmse")).alias("rmse"))


BLOCKED = f"SELECT l_orderkey % 40 AS block, sum(abs(pred - actual)) AS cand, sum(abs(l_quantity - actual)) AS base, count(*) AS n FROM ({PAIR}) GROUP BY ALL"


def _blocked(spark, sf_dir):
    a = F.col("actual")
    return _pair(spark, sf_dir).groupBy((F.col("l_orderkey") % 40).alias("block")).agg(F.sum(F.abs(F.col("pred") - a)).alias("cand"), F.sum(F.abs(F.col("l_quantity") - a)).alias("base"), F.count("*").alias("n"))


@query(f"SELECT count(*) AS blocks, round((sum(base) - sum(cand)) / sum(n), 6) AS gain FROM ({BLOCKED})")
def bootstrap_point(spark, sf_dir):
    return _blocked(spark, sf_dir).agg(F.count("*").alias("blocks"), r((F.sum("base") - F.sum("cand")) / F.sum("n")).alias("gain"))


@query()
def bootstrap_block_delta(spark, sf_dir):
    """Share of 2000 resamples of whole blocks in which the candidate is better, and the 95 % interval of its gain."""
    blocks = _blocked(spark, sf_dir).withColumn("place", F.row_number().over(Window.orderBy("block")) - 1)  # 40 rows
    draws = spark.range(2000).select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("slot"))
    draws = draws.withColumn("place", F.pmod(F.xxhash64(F.lit(417), "sample", "slot"), F.lit(40)).cast("int"))
    gains = draws.join(F.broadcast(blocks), "place").groupBy("sample").agg(((F.sum("base") - F.sum("cand")) / F.sum("n")).alias("gain"))
    return gains.agg(F.avg((F.col("gain") > 0).cast("double")).alias("p_better"), F.percentile("gain", F.lit(0.025)).alias("low"), F.percentile("gain", F.lit(0.975)).alias("high"))
