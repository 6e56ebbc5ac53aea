"""Queries on metrics, calibration, survival, sampling and contracts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tilewright.operators import calibration, contract, losses, metrics, prefix, sampling, survival
from tilewright.plans.lineage import shared_dir
from tilewright.plans.registry import FEATURES, PATCH, PRED, SURV, query, rounded

_AUROC = "round(sum(pos * (cn - neg / CAST(2 AS DOUBLE))) / (sum(pos) * sum(neg))::DOUBLE, 6)"
_HIST = f"(SELECT score, count(*) FILTER (y_true = 1) pos, count(*) FILTER (y_true <> 1) neg, sum(count(*) FILTER (y_true <> 1)) OVER (ORDER BY score) cn FROM {PRED} GROUP BY score)"


@query("metrics_join_predictions", f"SELECT id, y_true, round(score, 6) score FROM {PRED}")
def _(t):
    p = t.predictions()
    return rounded(metrics.join_predictions(p.select("id", "y_true"), p.select("id", "score"), "id"))


@query("metrics_auroc", f"SELECT round(avg(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE, 6) auroc FROM {PRED} a, {PRED} b WHERE a.y_true = 1 AND b.y_true <> 1")
def _(t):
    return rounded(metrics.auroc(t.predictions()))


def _proba(t):
    e = t("embeddings")
    return e.select((F.col("label") % 3).alias("y_true"), F.transform(F.slice("embedding", 1, 3), lambda x: F.exp(x.cast("double"))).alias("proba"))


_LONG = "(SELECT label % 3 y, i - 1 c, embedding[i] s FROM embeddings, range(1, 4) r(i))"
_PAIR = "avg(CASE WHEN a.s > b.s THEN 1 WHEN a.s = b.s THEN 0.5 ELSE 0 END)::DOUBLE"


@query("metrics_auroc_ovr", f"SELECT round(avg(v), 6) auroc FROM (SELECT a.c, {_PAIR} v FROM {_LONG} a JOIN {_LONG} b ON a.c = b.c AND a.y = a.c AND b.y <> b.c GROUP BY a.c)")
def _(t):
    return rounded(metrics.auroc_ovr(_proba(t)))


@query("metrics_auroc_ovr_micro", f"SELECT round({_PAIR}, 6) auroc FROM {_LONG} a JOIN {_LONG} b ON a.y = a.c AND b.y <> b.c")
def _(t):
    return rounded(metrics.auroc_ovr(_proba(t), average="micro"))


_DESC = f"(SELECT score, sum(count(*) FILTER (y_true = 1)) OVER w cp, sum(count(*) FILTER (y_true <> 1)) OVER w cn, sum(count(*) FILTER (y_true = 1)) OVER () p, sum(count(*) FILTER (y_true <> 1)) OVER () n FROM {PRED} GROUP BY score WINDOW w AS (ORDER BY score DESC))"


@query("metrics_roc_curve", f"SELECT round(score, 6) threshold, round(cn / n::DOUBLE, 6) fpr, round(cp / p::DOUBLE, 6) tpr FROM {_DESC}")
def _(t):
    return rounded(metrics.roc_curve(t.predictions()))


@query("metrics_pr_curve", f"SELECT round(score, 6) threshold, round(cp / (cp + cn)::DOUBLE, 6) \"precision\", round(cp / p::DOUBLE, 6) recall FROM {_DESC} UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE")
def _(t):
    return rounded(metrics.pr_curve(t.predictions()))


@query("metrics_auprc", f"WITH c AS (SELECT score, cp / (cp + cn)::DOUBLE pr, cp / p::DOUBLE re FROM {_DESC}) SELECT round(sum(a), 6) auprc FROM (SELECT (re - coalesce(lag(re) OVER (ORDER BY score DESC), 0)) * (pr + coalesce(lag(pr) OVER (ORDER BY score DESC), 1)) / 2 a FROM c)")
def _(t):
    return rounded(metrics.auprc(t.predictions()))


_CONF = f"(SELECT a.v y_true, b.v y_pred, (SELECT count(*) FROM {PRED} p WHERE p.y_true = a.v AND p.y_pred = b.v) n FROM (VALUES (0), (1)) a(v), (VALUES (0), (1)) b(v))"


@query("metrics_confusion", f"SELECT y_true, y_pred, n, round(n / (sum(n) OVER (PARTITION BY y_true))::DOUBLE, 6) share FROM {_CONF}")
def _(t):
    return rounded(metrics.confusion(t.predictions(), normalize=True))


_MULTI = "(SELECT label y_true, CAST((label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END) % 11 AS INT) y_pred FROM embeddings)"


@query(
    "metrics_classification",
    f"""WITH c AS (SELECT l, count(*) FILTER (y_true = l) s, count(*) FILTER (y_pred = l) q, count(*) FILTER (y_true = l AND y_pred = l) h FROM {_MULTI}, (SELECT y_true l FROM {_MULTI} UNION SELECT y_pred FROM {_MULTI}) GROUP BY l),
f AS (SELECT *, CASE WHEN s + q > 0 THEN 2 * h / (s + q)::DOUBLE ELSE 0 END f1 FROM c)
SELECT round(sum(h) / sum(s)::DOUBLE, 6) accuracy, round(avg(h / s::DOUBLE) FILTER (s > 0), 6) balanced_accuracy, round(avg(f1), 6) f1_macro, round(2 * sum(h) / (sum(s) + sum(q))::DOUBLE, 6) f1_micro, round(sum(f1 * s) / sum(s)::DOUBLE, 6) f1_weighted FROM f""",
)
def _(t):
    rows = t("embeddings").select(F.col("label").alias("y_true"), ((F.col("label") + F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0)) % 11).alias("y_pred"))
    return rounded(metrics.classification(rows))


@query("metrics_binary_rates", f"WITH c AS (SELECT count(*) FILTER (y_true = 1 AND y_pred = 1) tp, count(*) FILTER (y_true = 1 AND y_pred = 0) fn, count(*) FILTER (y_true = 0 AND y_pred = 1) fp, count(*) FILTER (y_true = 0 AND y_pred = 0) tn FROM {PRED}) SELECT round(tp / (tp + fn)::DOUBLE, 6) sensitivity, round(tn / (tn + fp)::DOUBLE, 6) specificity, round(tp / (tp + fp)::DOUBLE, 6) ppv, round(tn / (tn + fn)::DOUBLE, 6) npv FROM c")
def _(t):
    return rounded(metrics.binary_rates(t.predictions()))


@query("metrics_validate", f"SELECT count(DISTINCT y_true) = 1 one_class, (SELECT min(n) < 5 FROM (SELECT count(*) n FROM {PRED} GROUP BY y_true)) small_class, stddev_pop(score) < 1e-8 constant_score, min(score) < 0 OR max(score) > 1 outside_unit FROM {PRED}")
def _(t):
    return metrics.validate(t.predictions())


@query(
    "metrics_by_stratum",
    f"""WITH l AS (SELECT 'all' stratum, '' AS value, * FROM {PRED} UNION ALL SELECT 'source', source, * FROM {PRED}),
h AS (SELECT stratum, value, score, count(*) FILTER (y_true = 1) pos, count(*) FILTER (y_true <> 1) neg, sum(count(*) FILTER (y_true <> 1)) OVER (PARTITION BY stratum, value ORDER BY score) cn FROM l GROUP BY stratum, value, score),
a AS (SELECT stratum, value, round(sum(pos * (cn - neg / CAST(2 AS DOUBLE))) / nullif(sum(pos) * sum(neg), 0)::DOUBLE, 6) auroc FROM h GROUP BY 1, 2)
SELECT stratum, value, count(*) n, round(avg((y_true = y_pred)::INT), 6) accuracy, any_value(auroc) auroc FROM l JOIN a USING (stratum, value) GROUP BY 1, 2""",
)
def _(t):
    return rounded(metrics.by_stratum(t.predictions(), ["source"]))


# ------------------------------------------------------------------ calibration

_BIN = f"(SELECT CAST(floor(score * 10) AS INT) bin, count(*) n, avg(score) ms, avg(y_true) pos FROM {PRED} WHERE score < 1 GROUP BY 1)"


@query("calibration_curve", f"SELECT bin, n, round(ms, 6) mean_score, round(pos, 6) positive FROM {_BIN}")
def _(t):
    return rounded(calibration.curve(t.predictions()))


@query("calibration_ece", f"SELECT round(sum(abs(pos - ms) * n / (SELECT count(*) FROM {PRED})::DOUBLE), 6) ece FROM {_BIN}")
def _(t):
    return rounded(calibration.ece(t.predictions()))


@query("calibration_mce", f"SELECT round(max(abs(pos - ms)), 6) mce FROM {_BIN}")
def _(t):
    return rounded(calibration.mce(t.predictions()))


# --------------------------------------------------------------------- survival

_CELL = f'(SELECT "time", event, risk, count(*) n FROM {SURV} GROUP BY 1, 2, 3)'
_CMP = f'(SELECT a.risk ri, b.risk rj, a.n * b.n w FROM {_CELL} a JOIN {_CELL} b ON a.event AND (a."time" < b."time" OR (a."time" = b."time" AND NOT b.event)))'


@query("survival_comparable_pairs", f"SELECT CAST(sum(w) AS BIGINT) pairs FROM {_CMP}")
def _(t):
    return survival.comparable_pairs(t.survival(), "time", "event", "risk").agg(F.sum("pairs").alias("pairs"))


@query("survival_c_index", f"SELECT round(sum(CASE WHEN ri > rj THEN w WHEN ri = rj THEN w / CAST(2 AS DOUBLE) ELSE 0 END) / sum(w)::DOUBLE, 6) c_index FROM {_CMP}")
def _(t):
    return rounded(survival.c_index(t.survival(), "time", "event", "risk"))


_LIFE = "(SELECT CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS t, o_orderstatus = 'F' AS e, o_totalprice + o_custkey AS r FROM orders)"


@query("survival_c_index_continuous", f"SELECT round(sum(CASE WHEN a.r > b.r THEN 1 WHEN a.r = b.r THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) c_index FROM {_LIFE} a JOIN {_LIFE} b ON a.e AND (a.t < b.t OR (a.t = b.t AND NOT b.e))")
def _(t):
    life = t("orders").select(F.datediff("o_orderdate", F.lit("1970-01-01")).alias("t"), (F.col("o_orderstatus") == "F").alias("e"), (F.col("o_totalprice") + F.col("o_custkey")).alias("r"))
    return rounded(survival.c_index(life, "t", "e", "r"))


_KM = f'(SELECT grp, "time", ar at_risk, d events, product((ar - d) / ar::DOUBLE) OVER (PARTITION BY grp ORDER BY "time") s FROM (SELECT grp, "time", count(*) FILTER (event) d, sum(count(*)) OVER (PARTITION BY grp ORDER BY "time" DESC) ar FROM {SURV} GROUP BY 1, 2) WHERE d > 0)'


@query("survival_kaplan_meier", f'SELECT grp, "time", CAST(at_risk AS BIGINT) at_risk, events, round(s, 6) survival FROM {_KM}')
def _(t):
    return rounded(survival.kaplan_meier(t.survival(), "time", "event", ("grp",)))


@query("survival_median", f"""SELECT grp, coalesce(min("time") FILTER (s <= 0.5), 'inf'::DOUBLE) "median" FROM {_KM} GROUP BY 1""")
def _(t):
    return survival.median(survival.kaplan_meier(t.survival(), "time", "event", ("grp",)), ("grp",))


@query("survival_at", f"""SELECT q "time", round(coalesce((SELECT s FROM {_KM.replace('PARTITION BY grp ', '').replace('SELECT grp, ', 'SELECT ').replace('1, 2', '1')} k WHERE k."time" <= q ORDER BY k."time" DESC LIMIT 1), 1), 6) survival FROM (VALUES (0.5::DOUBLE), (10.5), (25), (49.9), (100)) v(q)""")
def _(t):
    asked = t.spark.createDataFrame([(0.5,), (10.5,), (25.0,), (49.9,), (100.0,)], "time double")
    return rounded(survival.at(survival.kaplan_meier(t.survival(), "time", "event"), asked))


@query("survival_brier", f'WITH d AS (SELECT *, least(greatest(risk * 10, 0), 1) r FROM {SURV}), e AS (SELECT DISTINCT "time" t FROM d WHERE event) SELECT round(avg(m), 6) brier FROM (SELECT t, avg(pow((1 - r) - CASE WHEN "time" = t AND event THEN 1 ELSE 0 END, 2)) m FROM e JOIN d ON "time" >= t GROUP BY t)')
def _(t):
    return rounded(survival.brier(t.survival().withColumn("risk", F.col("risk") * 10), "time", "event", "risk"))


@query("losses_cox_partial", f'WITH h AS (SELECT "time" t, sum(sum(exp(risk))) OVER (ORDER BY "time" DESC) h FROM {SURV} GROUP BY 1) SELECT round(avg(ln(h + 1e-8) - risk), 6) cox_loss FROM {SURV} JOIN h ON "time" = t WHERE event')
def _(t):
    return rounded(survival.cox_partial(t.survival(), "time", "event", "risk"))


# --------------------------------------------------------------------- sampling

_D = "('0x' || substr(md5('42|' || {}), 1, 8))::BIGINT"


@query("sampling_replicates", "SELECT c_custkey, CAST(r AS INT) replicate FROM customer, range(5) x(r)")
def _(t):
    return sampling.replicates(t("customer").select("c_custkey"), 5)


@query("sampling_bootstrap_simple", f"WITH p AS (SELECT *, row_number() OVER (ORDER BY id) - 1 i, count(*) OVER () n FROM {PRED}), b AS (SELECT r, {_D.format(chr(114) + chr(32) + '|| ' + chr(39) + '|' + chr(39) + ' || j')} % (SELECT max(n) FROM p) i FROM range(20) a(r), range((SELECT count(*) FROM {PRED})) c(j)) SELECT CAST(r AS INT) replicate, round(avg(score), 6) v, count(*) n FROM b JOIN p USING (i) GROUP BY 1")
def _(t):
    b = sampling.bootstrap_simple(t.predictions(), "id", 20)
    return rounded(b.groupBy("replicate").agg(F.avg("score").alias("v"), F.count("*").alias("n")))


@query("sampling_bootstrap_stratified", f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY id) - 1 i FROM {PRED}), m AS (SELECT y_true y, count(*) m FROM p GROUP BY 1), b AS (SELECT y, r, unnest(range(m)) j, m FROM m, range(20) a(r)), d AS (SELECT y, r, ('0x' || substr(md5('42|' || y || '|' || r || '|' || j), 1, 8))::BIGINT % m i FROM b) SELECT CAST(r AS INT) replicate, y_true, count(*) n, round(avg(score), 6) v FROM d JOIN p ON d.y = p.y_true AND d.i = p.i GROUP BY 1, 2")
def _(t):
    b = sampling.bootstrap_stratified(t.predictions(), "id", "y_true", 20)
    return rounded(b.groupBy("replicate", "y_true").agg(F.count("*").alias("n"), F.avg("score").alias("v")))


@query("sampling_bootstrap_group", "WITH g AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 i, count(*) OVER () n FROM (SELECT DISTINCT user_id FROM events)), d AS (SELECT r, ('0x' || substr(md5('42|' || r || '|' || i), 1, 8))::BIGINT % n i FROM g, range(10) a(r)) SELECT CAST(r AS INT) replicate, count(*) n, round(sum(value), 4) v FROM d JOIN g USING (i) JOIN events USING (user_id) GROUP BY 1")
def _(t):
    b = sampling.bootstrap_group(t("events"), "user_id", 10)
    return rounded(b.groupBy("replicate").agg(F.count("*").alias("n"), F.sum("value").alias("v")), 4)


def bootstrap_auroc(preds, n: int = 100):
    """AUROC of each stratified replicate: only (replicate, score) counts are shuffled for the metric."""
    return metrics.auroc(sampling.bootstrap_stratified(preds, "id", "y_true", n), by=("replicate",))


@query("sampling_ci", f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY id) - 1 i FROM {PRED}), m AS (SELECT y_true y, count(*) m FROM p GROUP BY 1), b AS (SELECT y, r, unnest(range(m)) j, m FROM m, range(100) a(r)),
d AS (SELECT y, r, ('0x' || substr(md5('42|' || y || '|' || r || '|' || j), 1, 8))::BIGINT % m i FROM b), x AS (SELECT r, y_true, score FROM d JOIN p ON d.y = p.y_true AND d.i = p.i),
h AS (SELECT r, score, count(*) FILTER (y_true = 1) pos, count(*) FILTER (y_true <> 1) neg, sum(count(*) FILTER (y_true <> 1)) OVER (PARTITION BY r ORDER BY score) cn FROM x GROUP BY 1, 2),
v AS (SELECT r, sum(pos * (cn - neg / CAST(2 AS DOUBLE))) / (sum(pos) * sum(neg))::DOUBLE a FROM h GROUP BY 1)
SELECT round(avg(a), 6) mean, round(quantile_cont(a, 0.025), 6) ci_lower, round(quantile_cont(a, 0.975), 6) ci_upper, count(*) replicates FROM v""")
def _(t):
    return rounded(sampling.ci(bootstrap_auroc(t.predictions()), "auroc"))


_W = " + ".join(f"CASE WHEN u > {c!r} THEN 1 ELSE 0 END" for c in sampling.poisson_steps())


@query("sampling_poisson", f"WITH d AS (SELECT CAST(r AS INT) replicate, score, (('0x' || substr(md5('42|' || id || '|' || r), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE u FROM {PRED}, range(50) x(r)), w AS (SELECT replicate, score, {_W} w FROM d) SELECT replicate, CAST(sum(w) AS BIGINT) n, round(sum(w * score) / sum(w), 6) mean_score FROM w GROUP BY 1")
def _(t):
    w = sampling.poisson(t.predictions(), "id", 50)
    return rounded(w.groupBy("replicate").agg(F.sum("weight").alias("n"), (F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("mean_score")))


@query("sampling_ci_for", f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY id) - 1 i FROM {PRED}), m AS (SELECT y_true y, count(*) m FROM p GROUP BY 1), b AS (SELECT y, r, unnest(range(m)) j, m FROM m, range(20) a(r)), d AS (SELECT y, r, ('0x' || substr(md5('42|' || y || '|' || r || '|' || j), 1, 8))::BIGINT % m i FROM b), v AS (SELECT r, avg((y_true = y_pred)::INT) a FROM d JOIN p ON d.y = p.y_true AND d.i = p.i GROUP BY 1) SELECT round(avg(a), 6) mean, round(quantile_cont(a, 0.025), 6) ci_lower, round(quantile_cont(a, 0.975), 6) ci_upper, count(*) replicates FROM v")
def _(t):
    b = sampling.bootstrap_stratified(t.predictions(), "id", "y_true", 20).select("replicate", "y_true", "y_pred")
    return rounded(sampling.ci_for(b, lambda pdf: (pdf.y_true == pdf.y_pred).mean()))


def weighted_accuracy(frame, weights):
    return float(weights[(frame.y_true == frame.y_pred).to_numpy()].sum() / weights.sum())


@query("sampling_little_bootstraps")
def _(t):
    """The interval of an accuracy from subsets of 100 rows; tests draw it again by a plain version."""
    return rounded(sampling.little_bootstraps(t.predictions().select("id", "y_true", "y_pred"), "id", weighted_accuracy, rows_per_task=100))


@query("sampling_bootstrap_sized", f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY id) - 1 i FROM {PRED}), c AS (SELECT y_true y, count(*) m FROM p GROUP BY 1),
k AS (SELECT y, m, greatest(1, round_even(m / (sum(m) OVER ())::DOUBLE * 150, 0)) k FROM c), m AS (SELECT y, m, CAST(least(k, 150 - coalesce(sum(k) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) k FROM k),
b AS (SELECT y, r, unnest(range(k)) j, m FROM m, range(20) a(r)), d AS (SELECT y, r, ('0x' || substr(md5('42|' || y || '|' || r || '|' || j), 1, 8))::BIGINT % m i FROM b)
SELECT CAST(r AS INT) replicate, y_true, count(*) n, round(avg(score), 12) v FROM d JOIN p ON d.y = p.y_true AND d.i = p.i GROUP BY 1, 2""")
def _(t):
    b = sampling.bootstrap_stratified(t.predictions(), "id", "y_true", 20, n_samples=150)
    # a mean of scores has at most twelve digits here, so none lies halfway between two roundings
    return rounded(b.groupBy("replicate", "y_true").agg(F.count("*").alias("n"), F.avg("score").alias("v")), 12)


_PAID = "(SELECT user_id, ts, max(value) paid FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)"


@query("prefix_asof", f"SELECT event_id, CASE WHEN e.ts - p.ts <= INTERVAL 3 DAY THEN paid END paid, CASE WHEN e.ts - p.ts <= INTERVAL 3 DAY THEN p.ts END ts_right FROM events e ASOF LEFT JOIN {_PAID} p ON e.user_id = p.user_id AND e.ts >= p.ts")
def _(t):
    """Each event with its user's last purchase of the three days before."""
    from tilewright.operators.prefix import asof

    paid = t("events").where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("paid"))
    return asof(t("events"), paid, "ts", ["paid"], ("user_id",), tolerance=3 * 86400).select("event_id", "paid", "ts_right")


@query("prefix_running_sum", 'SELECT l_quantity, CAST(n AS BIGINT) n, CAST(sum(n) OVER (ORDER BY l_quantity) AS BIGINT) cum_n FROM (SELECT l_quantity, count(*) n FROM lineitem GROUP BY 1)')
def _(t):
    return prefix.running_sum(t("lineitem").groupBy("l_quantity").agg(F.count("*").alias("n")), "l_quantity", ["n"])


# ---------------------------------------------------------------------- contract

_F = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PER = lambda body: " UNION ALL ".join(body.format(f=f) + f" FROM {FEATURES}" for f in _F)


@query("contract_fit_normalization", _PER("SELECT '{f}' feature, round(avg({f}), 6) mean, round(stddev_pop({f}), 6) std, round(min({f}), 6) AS \"min\", round(max({f}), 6) AS \"max\""))
def _(t):
    return rounded(contract.fit_normalization(t.features(), _F))


@query("contract_fit_imputation", _PER("SELECT '{f}' feature, round(quantile_cont({f}, 0.5), 6) AS value"))
def _(t):
    return rounded(contract.fit_imputation(t.features(), _F))


@query("contract_fit_imputation_mode", " UNION ALL ".join(f"SELECT '{f}' feature, round((SELECT {f} FROM {FEATURES} WHERE {f} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {f} LIMIT 1), 6) AS value" for f in _F))
def _(t):
    return rounded(contract.fit_imputation(t.features(), _F, "mode"))


@query("select_variance", f"SELECT * FROM ({_PER('SELECT {q}{{f}}{q} feature, round(var_pop({{f}}), 6) variance'.format(q=chr(39)))}) WHERE variance > 0.01")
def _(t):
    return rounded(contract.variance(t.features(), _F))


@query(
    "select_mutual_info",
    "WITH " + ", ".join(f"{f}_ AS (SELECT label y, least(floor((v - lo) * 10 / (hi - lo)), 9) bin FROM (SELECT label, {f} v, min({f}) OVER () lo, max({f}) OVER () hi FROM {FEATURES} WHERE {f} IS NOT NULL))" for f in _F)
    + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' feature, round(sum(n / t * ln(n * t / (b * c))), 6) mi FROM (SELECT n::DOUBLE n, (sum(n) OVER ())::DOUBLE t, (sum(n) OVER (PARTITION BY bin))::DOUBLE b, (sum(n) OVER (PARTITION BY y))::DOUBLE c FROM (SELECT y, bin, count(*) n FROM {f}_ GROUP BY 1, 2))" for f in _F) + ")",
)
def _(t):
    return rounded(contract.mutual_info(t.features(), _F, "label"))


_DIGAMMA = "(ln(({x}) + 8.0::DOUBLE) - 1 / (2 * (({x}) + 8.0::DOUBLE)) - 1 / (12 * (({x}) + 8.0::DOUBLE) ** 2) + 1 / (120 * (({x}) + 8.0::DOUBLE) ** 4) - 1 / (252 * (({x}) + 8.0::DOUBLE) ** 6) - " + " - ".join(f"1 / (({{x}}) + {i}.0::DOUBLE)" for i in range(8)) + ")"
_FEW = ["l_quantity", "l_discount", "l_tax"]


def _mi(f: str) -> str:
    """Of one feature, from all pairs of its cells."""
    g = lambda x: _DIGAMMA.format(x=x)
    return f"""(WITH c AS (SELECT y, v, n, s FROM (SELECT label y, {f}::DOUBLE v, count(*) n, sum(count(*)) OVER (PARTITION BY label) s FROM {FEATURES} WHERE {f} IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2) WHERE s > 1),
d AS (SELECT a.y, a.v, a.n, a.s, least(3, a.s - 1) k, abs(a.v - b.v) dist, CASE WHEN a.v = b.v THEN b.n - 1 ELSE b.n END bn FROM c a JOIN c b ON a.y = b.y),
r AS (SELECT y, v, n, s, k, min(dist) FILTER (upto >= k) r FROM (SELECT *, sum(bn) OVER (PARTITION BY y, v ORDER BY dist) upto FROM d) GROUP BY ALL),
m AS (SELECT r.y, r.v, r.n, r.s, r.k, sum(c.n) m FROM r JOIN c ON (r.r = 0 AND c.v = r.v) OR (c.v > r.v - r.r AND c.v < r.v + r.r) GROUP BY ALL)
SELECT '{f}' feature, round(greatest(0, {g("sum(n)")} + sum(n * {g("k")}) / sum(n) - sum(n * {g("s")}) / sum(n) - sum(n * {g("m")}) / sum(n)), 6) mi FROM m)"""


def _dist(f: str) -> str:
    """Of one feature: rows that were returned against all others."""
    q = f"(SELECT quantile_cont({f}, [{', '.join(f'{i}/10.0::DOUBLE' for i in range(11))}]) e FROM {FEATURES} WHERE label <> 'R')"
    return f"""(WITH q AS {q}, b AS (SELECT label = 'R' r, CASE WHEN {f} IS NULL THEN -1 WHEN {f} < e[1] THEN -2 WHEN {f} > e[11] THEN -3 ELSE len(list_filter(e[2:10], lambda x: x < {f})) END b FROM {FEATURES}, q),
t AS (SELECT count(*) FILTER (r)::DOUBLE n, count(*) FILTER (NOT r)::DOUBLE m, count(*) FILTER (r AND b <> -1)::DOUBLE nv, count(*) FILTER (NOT r AND b <> -1)::DOUBLE mv, count(*) FILTER (r AND b = -1) ms, count(*) FILTER (NOT r AND b = -1) fm, count(*) FILTER (r AND b = -2) bl, count(*) FILTER (r AND b = -3) ab FROM b),
s AS (SELECT i, (SELECT count(*) FROM b WHERE r AND (b = i OR i = 0 AND b = -2 OR i = 9 AND b = -3)) / nv x, (SELECT count(*) FROM b WHERE NOT r AND b = i) / mv y FROM range(10) g(i), t),
c AS (SELECT sum((greatest(x, 1e-4) - greatest(y, 1e-4)) * ln(greatest(x, 1e-4) / greatest(y, 1e-4))) psi, max(abs(g)) ks FROM (SELECT *, sum(x - y) OVER (ORDER BY i) g FROM s))
SELECT '{f}' feature, round(psi, 6) psi, round(ks, 6) ks, round(bl / nv, 6) below, round(ab / nv, 6) above, round(ms / n, 6) missing, round(fm / m, 6) frozen_missing, psi > 0.2 OR ks > 0.1 OR bl / nv > 0.01 OR ab / nv > 0.01 OR abs(ms / n - fm / m) > 0.05 drifted FROM c, t)"""


@query("contract_distribution_drift", " UNION ALL ".join(f"SELECT * FROM {_dist(f)}" for f in _F))
def _(t):
    """Returned items against the distributions that all others have frozen."""
    rows = t.features()
    return rounded(contract.Contract().fit_distribution(rows.where("label <> 'R'"), _F).freeze().distribution_drift(rows.where("label = 'R'")))


@query("select_mutual_info_neighbours", " UNION ALL ".join(f"SELECT * FROM {_mi(f)}" for f in _FEW))
def _(t):
    return rounded(contract.mutual_info_neighbours(t.features(), _FEW, "label"))


def _fitted(t):
    return contract.Contract().fit_imputation(t.features(), _F).fit_normalization(t.features(), _F).freeze()


@query("contract_transform", f"WITH p AS (SELECT avg(l_quantity) m, stddev_pop(l_quantity) s, avg(l_tax) m2, stddev_pop(l_tax) s2, quantile_cont(l_quantity, 0.5) q FROM {FEATURES}) SELECT l_orderkey, l_linenumber, round((coalesce(l_quantity, q) - m) / s, 5) l_quantity, round((l_tax - m2) / s2, 5) l_tax FROM {FEATURES}, p")
def _(t):
    return rounded(_fitted(t).apply(t.features()).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), 5)


@query("contract_impute", f"WITH p AS (SELECT quantile_cont(l_extendedprice, 0.5) q FROM {FEATURES}) SELECT l_orderkey, l_linenumber, round(coalesce(l_extendedprice, q), 4) l_extendedprice FROM {FEATURES}, p")
def _(t):
    values = {r.feature: r.value for r in contract.fit_imputation(t.features(), ["l_extendedprice"]).collect()}
    return rounded(contract.impute(t.features(), values).select("l_orderkey", "l_linenumber", "l_extendedprice"), 4)


@query("contract_drift", f"SELECT 'l_quantity' feature, round(a.m, 6) frozen_mean, round(b.m, 6) mean, round(a.s, 6) frozen_std, round(b.s, 6) std FROM (SELECT avg(l_quantity) m, stddev_pop(l_quantity) s FROM {FEATURES}) a, (SELECT avg(l_quantity) m, stddev_pop(l_quantity) s FROM {FEATURES} WHERE l_quantity > 10) b")
def _(t):
    c = contract.Contract().fit_normalization(t.features(), ["l_quantity"]).freeze()
    return rounded(c.drift(t.features().where("l_quantity > 10")))


@query("contract_round_trip", "SELECT true same_hash, CAST(16 AS INT) digits, true valid, true frozen, count(*) n_rows FROM lineitem")
def _(t):
    """Freeze, hash, save, load and validate; both contracts transform all rows alike."""
    path = f"{shared_dir(t.spark)}/contract-{uuid.uuid4().hex}"
    c = _fitted(t)
    c.save(t.spark, path)
    again = contract.Contract.load(t.spark, path)
    rows = c.apply(t.features()).intersectAll(again.apply(t.features()))
    return rows.agg(F.lit(c.hash() == again.hash()).alias("same_hash"), F.lit(len(again.hash())).alias("digits"), F.lit(again.validate()).alias("valid"), F.lit(again.frozen).alias("frozen"), F.count("*").alias("n_rows"))


# ------------------------------------------------------------------------ losses


@query("losses_class_weights", "SELECT event_type, count(*) n, round((sum(count(*)) OVER ()) / ((count(*) OVER ()) * count(*))::DOUBLE, 6) weight FROM events GROUP BY 1")
def _(t):
    return rounded(losses.class_weights(t("events"), "event_type"))


_CE = "(SELECT label, vec_id, ln(list_sum(list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE))))) - CAST(embedding[label + 1] AS DOUBLE) ce FROM embeddings)"


def _logits():
    return F.transform("embedding", lambda v: v.cast("double"))


@query("losses_log_loss", f"SELECT vec_id, round(ce, 6) loss FROM {_CE}")
def _(t):
    return rounded(t("embeddings").select("vec_id", losses.log_loss(_logits(), F.col("label")).alias("loss")))


@query("losses_focal", f"SELECT round(avg(0.25::DOUBLE * pow(1 - exp(-ce), 2) * ce), 6) mean_loss, round(sum(0.25::DOUBLE * pow(1 - exp(-ce), 2) * ce), 4) sum_loss FROM {_CE}")
def _(t):
    f = t("embeddings").select(losses.focal(_logits(), F.col("label")).alias("f"))
    return f.agg(F.round(F.avg("f"), 6).alias("mean_loss"), F.round(F.sum("f"), 4).alias("sum_loss"))


@query("losses_weighted_focal", f"WITH w AS (SELECT label, (SELECT count(*) FROM embeddings) / ((SELECT count(DISTINCT label) FROM embeddings) * count(*))::DOUBLE w FROM embeddings GROUP BY 1) SELECT round(avg(w * 0.25::DOUBLE * pow(1 - exp(-ce), 2) * ce), 6) mean_loss FROM {_CE} JOIN w USING (label)")
def _(t):
    w = losses.class_weights(t("embeddings"), "label").select("label", "weight")
    f = t("embeddings").join(F.broadcast(w), "label").select(losses.focal(_logits(), F.col("label"), weight=F.col("weight")).alias("f"))  # a row a class
    return f.agg(F.round(F.avg("f"), 6).alias("mean_loss"))


@query("losses_dice", f"SELECT source, round(1 - (2 * sum(score * y_true) + 1) / (sum(score + y_true) + 1), 6) dice_loss FROM {PRED} GROUP BY 1")
def _(t):
    return rounded(losses.dice(t.predictions(), "score", "y_true", ("source",)))


@query("losses_smooth_topk", f"SELECT slide_id, round(-ln(sum(exp(score) * score) / sum(exp(score)) + 1e-8), 6) loss FROM {PATCH} GROUP BY 1")
def _(t):
    return rounded(losses.smooth_topk(t.patches(), "slide_id", "score"))


#: SQL of the flagship query: the bootstrap of ``sampling_ci`` on the half that ``splits.stratified`` holds out.
FLAGSHIP = f"""WITH g AS (SELECT id, y_true, score, {_D.format('id')} d FROM {PRED}), c AS (SELECT y_true l, count(*) n FROM g GROUP BY 1),
a AS (SELECT *, ceil(sum(n) OVER () * 0.5::DOUBLE - 1e-9) want FROM c), e AS (SELECT *, want * n / (sum(n) OVER ())::DOUBLE e FROM a),
q AS (SELECT l, floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, l) <= want - sum(floor(e)) OVER () THEN 1 ELSE 0 END nt FROM e),
h AS (SELECT id, y_true, score FROM (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY d, id) p FROM g) JOIN q ON y_true = l WHERE p <= nt),
p AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY id) - 1 i FROM h), m AS (SELECT y_true y, count(*) m FROM p GROUP BY 1), b AS (SELECT y, r, unnest(range(m)) j, m FROM m, range(100) x(r)),
d AS (SELECT y, r, ('0x' || substr(md5('42|' || y || '|' || r || '|' || j), 1, 8))::BIGINT % m i FROM b), x AS (SELECT r, y_true, score FROM d JOIN p ON d.y = p.y_true AND d.i = p.i),
k AS (SELECT r, score, count(*) FILTER (y_true = 1) pos, count(*) FILTER (y_true <> 1) neg, sum(count(*) FILTER (y_true <> 1)) OVER (PARTITION BY r ORDER BY score) cn FROM x GROUP BY 1, 2),
v AS (SELECT r, sum(pos * (cn - neg / CAST(2 AS DOUBLE))) / (sum(pos) * sum(neg))::DOUBLE a FROM k GROUP BY 1)
SELECT round(avg(a), 6) mean, round(quantile_cont(a, 0.025), 6) ci_lower, round(quantile_cont(a, 0.975), 6) ci_upper, count(*) replicates FROM v"""
