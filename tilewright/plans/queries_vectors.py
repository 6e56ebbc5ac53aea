"""Queries on vectors, fusion, near-duplicates, trials, radiomics and models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tilewright.functions import arrays as A
from tilewright.operators import dedup, fusion, graph, models, radiomics, trials, vectors
from tilewright.plans.registry import FEATURES, PATCH, SURV, TRIALS, VOXELS, query, rounded


def _long(df, *keys, col="pooled"):
    return rounded(df.select(*keys, F.posexplode(col).alias("pos", "v")).withColumn("v", F.col("v").cast("double")))


_ELEM = f"(SELECT slide_id, patch, x, y, score, CAST(i - 1 AS INT) pos, embedding[i] v FROM {PATCH}, range(1, 65) r(i))"


@query("vectors_mean_pool", f"SELECT slide_id, pos, round(avg(v), 6) v FROM {_ELEM} GROUP BY 1, 2")
def _(t):
    return _long(vectors.mean_pool(t.patches(), "slide_id"), "slide_id")


@query("vectors_max_pool", f"SELECT slide_id, pos, round(max(v), 6) v FROM {_ELEM} GROUP BY 1, 2")
def _(t):
    return _long(vectors.max_pool(t.patches(), "slide_id"), "slide_id")


@query("vectors_softmax_pool", f"SELECT slide_id, pos, round(sum(exp(score) * v) / sum(exp(score)), 6) v FROM {_ELEM} GROUP BY 1, 2")
def _(t):
    return _long(vectors.softmax_pool(t.patches(), "slide_id", "score"), "slide_id")


@query("vectors_softmax_weights", f"SELECT slide_id, patch, round(exp(score) / sum(exp(score)) OVER (PARTITION BY slide_id), 6) weight FROM {PATCH}")
def _(t):
    return rounded(vectors.softmax_weights(t.patches(), "slide_id", "score").select("slide_id", "patch", "weight"))


_CENTRES = [[1.0 if i % 2 == k else -1.0 for i in range(64)] for k in range(2)]
_C = ["CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END", "CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END"]


@query(
    "vectors_two_tier_pool",
    f"""WITH w AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY slide_id) w FROM {PATCH}),
cs AS (SELECT slide_id, patch, w, embedding, {", ".join(f"list_sum(list_transform(embedding, lambda v, i: v * ({c}))) / (sqrt(list_sum(list_transform(embedding, lambda v: v * v))) * 8) c{k}" for k, c in enumerate(_C))} FROM w),
a AS (SELECT slide_id, patch, w, embedding, 0 k, exp(c0) / (exp(c0) + exp(c1)) a FROM cs UNION ALL SELECT slide_id, patch, w, embedding, 1, exp(c1) / (exp(c0) + exp(c1)) FROM cs),
m AS (SELECT slide_id, k, sum(a) mass, sum(a * w) sc FROM a GROUP BY 1, 2),
p AS (SELECT slide_id, k, i - 1 pos, sum(a * w * embedding[i]) s FROM a, range(1, 65) r(i) GROUP BY 1, 2, 3),
o AS (SELECT slide_id, k, exp(sc) / sum(exp(sc)) OVER (PARTITION BY slide_id) ow, mass FROM m)
SELECT slide_id, CAST(pos AS INT) pos, round(sum(ow * s / (mass + 1e-5)), 6) v FROM p JOIN o USING (slide_id, k) GROUP BY 1, 2""",
)
def _(t):
    return _long(vectors.two_tier_pool(t.patches(), "slide_id", "score", _CENTRES), "slide_id")


_REG = f"(SELECT p.*, greatest(0, least(8, CAST(floor(floor((x - ax) / (bx - ax + 1e-5) * 3) * 3 + (y - ay) / (by_ - ay + 1e-5) * 3) AS INT))) region FROM {PATCH} p JOIN (SELECT slide_id, min(x) ax, max(x) bx, min(y) ay, max(y) by_ FROM {PATCH} GROUP BY 1) USING (slide_id))"


@query("vectors_regions", f"SELECT slide_id, patch, region FROM {_REG}")
def _(t):
    return vectors.regions(t.patches(), "slide_id", 9).select("slide_id", "patch", "region")


@query("vectors_region_pool", f"SELECT slide_id, pos, round(sum(m) / 9, 6) v FROM (SELECT slide_id, region, CAST(i - 1 AS INT) pos, avg(embedding[i]) m FROM {_REG}, range(1, 65) r(i) GROUP BY 1, 2, 3) GROUP BY 1, 2")
def _(t):
    return _long(vectors.region_pool(t.patches(), "slide_id", 9, 64), "slide_id")


@query("vectors_pool_or_zero", "SELECT n_nationkey slide_id, CAST(i - 1 AS INT) pos, round(coalesce(avg(embedding[i]::DOUBLE), 0), 6) v, count(vec_id) num_patches, count(vec_id) = 0 empty FROM nation CROSS JOIN range(1, 65) r(i) LEFT JOIN embeddings ON label = n_nationkey GROUP BY 1, 2")
def _(t):
    p = t("embeddings").select(F.col("label").alias("slide_id"), "embedding")
    out = vectors.pool_or_zero(t("nation").select(F.col("n_nationkey").alias("slide_id")), p, "slide_id", 64)
    return rounded(out.select("slide_id", "num_patches", "empty", F.posexplode("pooled").alias("pos", "v")))


@query("vectors_slide_vote", "WITH m AS (SELECT label, CAST(i - 1 AS INT) c, avg(embedding[i]::DOUBLE) v FROM embeddings, range(1, 5) r(i) GROUP BY 1, 2) SELECT label, (SELECT c FROM m b WHERE b.label = a.label ORDER BY v DESC, c LIMIT 1) vote FROM (SELECT DISTINCT label FROM m) a")
def _(t):
    p = t("embeddings").withColumn("p", F.slice("embedding", 1, 4))
    return vectors.slide_vote(p, "label", "p").select("label", "vote")


_NORM = "sqrt(list_sum(list_transform(embedding, lambda v: v * v)))"


@query("vectors_top_k_norm", f"SELECT slide_id, patch, round(norm, 6) norm FROM (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY norm DESC, patch) r FROM (SELECT *, round({_NORM}, 5) norm FROM {PATCH})) WHERE r <= 12")
def _(t):
    # norms of unit vectors scaled alike differ in the last bits, so ties are rounded first
    p = t.patches().withColumn("embedding", F.array(F.round(A.l2_norm(F.col("embedding")), 5)))
    return rounded(vectors.top_k_norm(p, "slide_id", 12, "patch").select("slide_id", "patch", "norm"))


@query("vectors_sample_k", f"SELECT slide_id, patch FROM (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY ('0x' || substr(md5('42|' || patch), 1, 8))::BIGINT, patch) r FROM {PATCH}) WHERE r <= 20")
def _(t):
    return vectors.sample_k(t.patches(), "slide_id", 20, "patch").select("slide_id", "patch")


@query("vectors_pad", f"SELECT slide_id, count(*) n_real, CAST(greatest(50 - count(*), 0) AS BIGINT) n_pad FROM {PATCH} GROUP BY 1")
def _(t):
    p = vectors.pad(t.patches(), "slide_id", 50, 64)
    return p.groupBy("slide_id").agg(F.count_if(~F.col("is_pad")).alias("n_real"), F.count_if("is_pad").alias("n_pad"))


@query("vectors_pseudo_labels", f"SELECT slide_id, patch, CAST(CASE WHEN score > quantile_disc(score, 0.5) OVER (PARTITION BY slide_id) THEN slide_id % 2 ELSE 1 - slide_id % 2 END AS INT) pseudo FROM {PATCH}")
def _(t):
    p = t.patches().withColumn("bag", (F.col("slide_id") % 2).cast("int"))
    return vectors.pseudo_labels(p, "slide_id", "score", "bag").select("slide_id", "patch", "pseudo")


@query("functions_softmax", "SELECT vec_id, CAST(i - 1 AS INT) pos, round(exp(embedding[i]::DOUBLE) / list_sum(list_transform(embedding, lambda v: exp(v::DOUBLE))), 6) v FROM embeddings, range(1, 65) r(i)")
def _(t):
    return _long(t("embeddings").select("vec_id", A.softmax(F.transform("embedding", lambda v: v.cast("double"))).alias("pooled")), "vec_id")


@query("functions_cosine", "SELECT a.vec_id, round(list_sum(list_transform(a.embedding, lambda v, i: v::DOUBLE * b.embedding[i])) / sqrt(list_sum(list_transform(a.embedding, lambda v: v::DOUBLE * v)) * list_sum(list_transform(b.embedding, lambda v: v::DOUBLE * v))), 5) cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    b = t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return rounded(t("embeddings").join(b, "vec_id").select("vec_id", A.cosine(F.col("embedding"), F.col("b")).alias("cosine")), 5)


@query("functions_argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) argmax FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", A.argmax(F.col("embedding")).alias("argmax"))


@query("functions_one_hot", "SELECT vec_id, CAST(i - 1 AS INT) pos, CASE WHEN i - 1 = label THEN 1.0::DOUBLE ELSE 0 END v FROM embeddings, range(1, 11) r(i)")
def _(t):
    return _long(t("embeddings").select("vec_id", A.one_hot(F.col("label"), 10).alias("pooled")), "vec_id")


# ------------------------------------------------------------------------ fusion


@query("fusion_early", "SELECT vec_id, CAST(len(embedding) * 2 AS INT) dim, round(embedding[1]::DOUBLE, 6) first, round(embedding[64]::DOUBLE * 2, 6) last FROM embeddings")
def _(t):
    e = t("embeddings").withColumn("second", F.transform("embedding", lambda v: v * 2))
    f = fusion.early(e, ["embedding", "second"])
    return rounded(f.select("vec_id", F.size("fused").alias("dim"), F.element_at("fused", 1).alias("first"), F.element_at("fused", -1).alias("last")))


@query("fusion_late", "SELECT l_orderkey, l_linenumber, round((0.6::DOUBLE * m1 * l_discount + 0.3::DOUBLE * l_tax + 0.1::DOUBLE * l_quantity) / (0.6::DOUBLE * m1 + 0.3::DOUBLE + 0.1::DOUBLE + 1e-5), 6) fused FROM (SELECT *, CASE WHEN l_orderkey % 4 = 0 THEN 0 ELSE 1 END m1 FROM lineitem)")
def _(t):
    df = t("lineitem").withColumns({"m1": F.when(F.col("l_orderkey") % 4 == 0, 0).otherwise(1), "one": F.lit(1)})
    return rounded(fusion.late(df, ["l_discount", "l_tax", "l_quantity"], [0.6, 0.3, 0.1], ["m1", "one", "one"]).select("l_orderkey", "l_linenumber", "fused"))


@query("fusion_gate", "WITH g AS (SELECT vec_id, exp(embedding[1]::DOUBLE) a, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE exp(embedding[2]::DOUBLE) END b, exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE) t FROM embeddings) SELECT round(avg(a / t / (a / t + b / t + 1e-5)), 6) imaging, round(avg(b / t / (a / t + b / t + 1e-5)), 6) radiomics FROM g")
def _(t):
    e = t("embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("m1"), F.slice("embedding", 9, 8).alias("m2"), F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double")).alias("g"), F.array(F.lit(1), F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1)).alias("mask"))
    return rounded(fusion.mean_gate(fusion.gate(e, ["m1", "m2"], "g", "mask"), ["imaging", "radiomics"]).groupBy().pivot("modality", ["imaging", "radiomics"]).agg(F.first("mean_gate")))


# ------------------------------------------------------------------------- dedup

_SIM = """(WITH w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) w FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 15))::BIGINT h FROM w),
b AS (SELECT doc_id, i, 2 * sum((h >> i) & 1) > count(*) s FROM h, range(60) r(i) GROUP BY 1, 2)
SELECT d.doc_id, CAST(coalesce(sum(CASE WHEN s THEN (1::BIGINT << i::INT) ELSE 0 END), 0) AS BIGINT) hash FROM documents d LEFT JOIN b USING (doc_id) GROUP BY 1)"""
_HP = f"(SELECT a.h hash_i, b.h hash_j, CAST(bit_count(xor(a.h, b.h)) AS INT) distance FROM (SELECT DISTINCT hash h FROM {_SIM}) a, (SELECT DISTINCT hash h FROM {_SIM}) b WHERE a.h < b.h AND bit_count(xor(a.h, b.h)) <= 8)"
_CL = f"""(WITH RECURSIVE s AS MATERIALIZED (SELECT * FROM {_SIM}), e AS MATERIALIZED (SELECT a.doc_id a, b.doc_id b FROM s a, s b WHERE a.doc_id <> b.doc_id AND bit_count(xor(a.hash, b.hash)) <= 3),
r AS (SELECT doc_id, doc_id c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id) SELECT doc_id, min(c) component FROM r GROUP BY 1)"""


def _hashes(t):
    return dedup.text_simhash(t("documents"), "doc_id")


def _clusters(t):
    return dedup.clusters(_hashes(t), "doc_id", threshold=3, bits=60)


@query("dedup_text_simhash", f"SELECT * FROM {_SIM}")
def _(t):
    return _hashes(t)


@query("dedup_hamming_pairs", f"SELECT * FROM {_HP}")
def _(t):
    return dedup.hamming_pairs(_hashes(t), "doc_id", threshold=8, bits=60)


@query("graph_components", f"SELECT doc_id, component FROM {_CL}")
def _(t):
    return _clusters(t)


@query("dedup_run", f"SELECT doc_id FROM {_CL} WHERE doc_id = component")
def _(t):
    return dedup.run(t("documents").select("doc_id", "text"), "doc_id").select("doc_id")


@query("dedup_stats", f"SELECT CAST(sum(n) AS BIGINT) total, count(*) clusters, count(*) kept, CAST(sum(n) - count(*) AS BIGINT) removed, count(*) FILTER (n > 1) duplicate_clusters FROM (SELECT component, count(*) n FROM {_CL} GROUP BY 1)")
def _(t):
    return dedup.stats(_clusters(t), "doc_id")


@query("dedup_representative", f"SELECT component, min(doc_id) representative, count(*) \"size\" FROM {_CL} GROUP BY 1")
def _(t):
    return dedup.representative(_clusters(t), "doc_id")


@query("dedup_report", f"SELECT * FROM (SELECT component, count(*) OVER w \"size\", min(doc_id) OVER w representative, doc_id AS member, CAST(row_number() OVER (PARTITION BY component ORDER BY doc_id) AS BIGINT) AS rank FROM {_CL} WINDOW w AS (PARTITION BY component)) WHERE \"size\" > 1")
def _(t):
    return dedup.report(_clusters(t), "doc_id")


@query("dedup_to_remove", f"SELECT doc_id FROM {_CL} WHERE doc_id <> component")
def _(t):
    return dedup.to_remove(_clusters(t), "doc_id")


def _bits(flag: str, n: int) -> str:
    return f"CAST(list_sum(list_transform(range(1, {n + 1}), lambda i: CASE WHEN {flag} THEN (1::BIGINT << (i - 1)::INT) ELSE 0 END)) AS BIGINT)"


_PIXELS = "(SELECT vec_id id, list_transform(embedding, lambda x: (x::DOUBLE + 1) * 127.5) v FROM embeddings UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x: (x::DOUBLE + 1) * 127.5 * (1 + (vec_id % 3) / 50.0::DOUBLE)) FROM embeddings WHERE vec_id % 4 = 0)"


def _pixels(t):
    """Vectors as pixels, and every fourth once more, some of them brighter."""
    pixel = lambda k: F.transform("embedding", lambda x: (x.cast("double") + 1) * 127.5 * k)
    own = t("embeddings").select(F.col("vec_id").alias("id"), pixel(F.lit(1.0)).alias("v"))
    return own.union(t("embeddings").where("vec_id % 4 = 0").select(F.col("vec_id") + 1000000, pixel(1 + (F.col("vec_id") % 3) / F.lit(50.0))))


@query("dedup_ssim_pairs", f"""WITH p AS (SELECT min(id) id, v, list_avg(v) m, list_var_pop(v) s FROM {_PIXELS} GROUP BY v),
q AS (SELECT a.id id_i, b.id id_j, (2 * a.m * b.m + 6.5025) / (a.m * a.m + b.m * b.m + 6.5025) s1, (2 * (list_dot_product(a.v, b.v) / len(a.v) - a.m * b.m) + 58.5225) / (a.s + b.s + 58.5225) s2 FROM p a JOIN p b ON a.id < b.id)
SELECT id_i, id_j, round(s1 * s2, 6) ssim FROM q WHERE s1 * s2 >= 0.95""")
def _(t):
    from tilewright.operators.similarity import ssim_pairs

    return rounded(ssim_pairs(_pixels(t), "id", "v"))


@query("dedup_vector_hashes", f"SELECT vec_id, {_bits('e[i] > list_avg(e)', 48)} ahash, {_bits('e[i + 1] > e[i]', 47)} dhash FROM (SELECT vec_id, list_transform(embedding[1:48], lambda v: v::DOUBLE) e FROM embeddings)")
def _(t):
    v = F.transform(F.slice("embedding", 1, 48), lambda x: x.cast("double"))
    return t("embeddings").select("vec_id", v.alias("v")).select("vec_id", dedup.ahash(F.col("v")).alias("ahash"), dedup.dhash(F.col("v")).alias("dhash"))


_COS = "[" + ", ".join("[" + ", ".join(f"{math.cos(math.pi * k * (2 * i + 1) / 128)!r}::DOUBLE" for i in range(64)) + "]" for k in range(32)) + "]"
_MED = "(list_sort({c})[len({c}) // 2] + list_sort({c})[len({c}) // 2 + 1]) / 2"


@query("dedup_transform_hashes", f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) v FROM embeddings), c AS (SELECT vec_id, list_transform({_COS}, lambda b: list_reduce(list_transform(range(1, 65), lambda i: v[i] * b[i]), lambda x, y: x + y)) c, list_transform(range(1, 33), lambda i: (v[2 * i - 1] + v[2 * i]) / 2) m FROM e)
SELECT vec_id, CAST(list_sum(list_transform(range(1, 33), lambda i: CASE WHEN c[i] > {_MED.format(c='c')} THEN (1::BIGINT << (i - 1)::INT) ELSE 0 END)) AS BIGINT) phash, CAST(list_sum(list_transform(range(1, 33), lambda i: CASE WHEN m[i] > {_MED.format(c='m')} THEN (1::BIGINT << (i - 1)::INT) ELSE 0 END)) AS BIGINT) whash FROM c""")
def _(t):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return t("embeddings").select("vec_id", v.alias("v")).select("vec_id", dedup.phash(F.col("v"), 64).alias("phash"), dedup.whash(F.col("v")).alias("whash"))


# ------------------------------------------------------------------------ trials

_RB = f"(SELECT *, max(metric) OVER (PARTITION BY event_type ORDER BY trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) best_before FROM {TRIALS})"


@query("trials_running_best", f"SELECT trial_id, metric, best_before, coalesce(CASE WHEN best_before IS NULL THEN metric IS NOT NULL ELSE metric > best_before END, false) improved FROM {_RB}")
def _(t):
    return trials.running_best(t.trials(), "trial_id", by=("event_type",)).select("trial_id", "metric", "best_before", "improved")


@query("trials_running_best_of_all", f"SELECT trial_id, metric, best_before, coalesce(CASE WHEN best_before IS NULL THEN metric IS NOT NULL ELSE metric < best_before END, false) improved FROM (SELECT *, min(metric) OVER (ORDER BY trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) best_before FROM {TRIALS})")
def _(t):
    return trials.running_best(t.trials(), "trial_id", mode="min").select("trial_id", "metric", "best_before", "improved")


@query("trials_retain_of_all", f"SELECT trial_id, b = 1 is_best FROM (SELECT *, row_number() OVER (ORDER BY trial_id DESC) a, row_number() OVER (ORDER BY metric DESC NULLS LAST, trial_id) b FROM {TRIALS}) WHERE a <= 3 OR b = 1")
def _(t):
    return trials.retain(t.trials(), 3, "trial_id", "metric").select("trial_id", "is_best")


@query("trials_suspicious", f"SELECT trial_id, coalesce(abs(metric - best_before) > 0.05, false) suspicious FROM {_RB}")
def _(t):
    return trials.suspicious(t.trials(), "trial_id", by=("event_type",)).select("trial_id", "suspicious")


@query(
    "trials_early_stop",
    """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) epoch, value FROM events),
i AS (SELECT *, value < coalesce(min(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE) better FROM e),
l AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch) best FROM i),
s AS (SELECT user_id, min(epoch) FILTER (epoch - best >= 5) stop_epoch FROM l GROUP BY 1)
SELECT l.user_id, CAST(max(best) AS INT) best_epoch, CAST(max(stop_epoch) AS INT) stop_epoch FROM l JOIN s USING (user_id) WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY 1""",
)
def _(t):
    from pyspark.sql import Window as W

    e = t("events").select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("epoch"), F.col("value").alias("val_loss"))
    return trials.early_stop(e, 5, "user_id")


@query("trials_retain", f"SELECT trial_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY trial_id DESC) a, row_number() OVER (PARTITION BY event_type ORDER BY metric DESC NULLS LAST, trial_id) b FROM {TRIALS}) WHERE a <= 3 OR b = 1")
def _(t):
    return trials.retain(t.trials(), 3, "trial_id", "metric", by=("event_type",)).select("trial_id", "event_type")


@query("trials_leaderboard", f"SELECT trial_id, metric FROM {TRIALS} ORDER BY metric DESC NULLS LAST, trial_id LIMIT 10")
def _(t):
    return trials.leaderboard(t.trials(), "metric", "trial_id").select("trial_id", "metric")


@query("trials_config_diff", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'b' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN 'c' ELSE '' END changed FROM events")
def _(t):
    k = F.col("event_id")
    a = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0))
    b = F.map_from_entries(F.filter(F.array(F.struct(F.lit("a"), F.lit(1.0)), F.struct(F.lit("b"), F.when(k % 2 == 0, 3.0).otherwise(2.0)), F.when(k % 3 == 0, F.struct(F.lit("c"), F.lit(9.0)))), lambda e: e.isNotNull()))
    return t("events").select("event_id", F.array_join(F.array_sort(F.map_keys(trials.config_diff(a, b))), "").alias("changed"))


@query("trials_config_hash", "SELECT event_id, substr(sha256('a=' || (event_id % 5) || ';b=' || user_id), 1, 16) hash FROM events")
def _(t):
    m = F.create_map(F.lit("b"), F.col("user_id"), F.lit("a"), F.col("event_id") % 5)
    return t("events").select("event_id", trials.config_hash(m).alias("hash"))


@query("trials_journal", f"SELECT trial_id, '| ' || trial_id || ' | ' || coalesce(printf('%.4f', metric), 'failed') || ' | ' || event_type || ' |' line FROM {TRIALS}")
def _(t):
    return trials.journal(t.trials(), diff="event_type")


@query("trials_verify", f"SELECT trial_id, 'metric' AS missing FROM {TRIALS} WHERE metric IS NULL")
def _(t):
    return trials.verify(t.trials(), ["trial_id", "metric"]).select("trial_id", "missing")


@query("trials_training_curves", "SELECT l_orderkey * 8 + l_linenumber epoch, 'loss' metric, 'train' phase, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey * 8 + l_linenumber, 'loss', 'val', l_tax FROM lineitem")
def _(t):
    return trials.training_curves(t("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("epoch"), F.col("l_discount").alias("train_loss"), F.col("l_tax").alias("val_loss")))


# --------------------------------------------------------------------- radiomics


@query(
    "radiomics_first_order",
    """WITH v AS (SELECT user_id s, value v FROM events), m AS (SELECT s, count(*) n, sum(v * v) energy, min(v) mn, max(v) mx, avg(v) mean, quantile_cont(v, 0.5) md, quantile_cont(v, 0.1) p10, quantile_cont(v, 0.9) p90, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) iqr, var_pop(v) var FROM v GROUP BY 1),
d AS (SELECT s, avg(abs(v - mean)) mad, avg(pow(v - mean, 3)) m3, avg(pow(v - mean, 4)) m4, avg(v) FILTER (v BETWEEN p10 AND p90) nm FROM v JOIN m USING (s) GROUP BY 1),
r AS (SELECT s, avg(abs(v - nm)) rmad FROM v JOIN m USING (s) JOIN d USING (s) WHERE v BETWEEN p10 AND p90 GROUP BY 1),
h AS (SELECT s, -sum(p * log2(p)) entropy, sum(p * p) uniformity FROM (SELECT s, count(*) / (sum(count(*)) OVER (PARTITION BY s))::DOUBLE p FROM v GROUP BY s, floor(v / 25)) GROUP BY 1)
SELECT s user_id, round(energy + 1e-9, 2) energy, round(entropy + 1e-9, 6) entropy, round(mn + 1e-9, 6) minimum, round(p10 + 1e-9, 6) p10, round(p90 + 1e-9, 6) p90, round(mx + 1e-9, 6) maximum, round(mean + 1e-9, 6) mean, round(md + 1e-9, 6) "median", round(iqr + 1e-9, 6) iqr, round(mx - mn + 1e-9, 6) AS "range", round(mad + 1e-9, 6) mad, round(rmad + 1e-9, 6) rmad, round(sqrt(energy / n) + 1e-9, 6) rms, round(coalesce(m3 / nullif(pow(var, 1.5), 0), 0) + 1e-9, 4) skewness, round(coalesce(m4 / nullif(var * var, 0), 0) + 1e-9, 4) kurtosis, round(var + 1e-9, 4) variance, round(uniformity + 1e-9, 6) uniformity FROM m JOIN d USING (s) JOIN r USING (s) JOIN h USING (s)""",
)
def _(t):
    digits = {"energy": 2, "skewness": 4, "kurtosis": 4, "variance": 4}
    out = radiomics.first_order(t("events"), "user_id", "value")
    # the values have two decimals, so ties in rounding are common: a small offset settles them alike in both engines
    return out.select("user_id", *[F.round(F.col(c) + 1e-9, digits.get(c, 6)).alias(c) for c in out.columns if c != "user_id"])


_NB = f"(SELECT a.sample, ax axis, a.x, a.y, a.z, b.x nx, b.y ny, b.z nz, a.level li, b.level lj FROM (SELECT * FROM {VOXELS}, (VALUES ('x', 1, 0, 0), ('y', 0, 1, 0), ('z', 0, 0, 1)) s(ax, dx, dy, dz)) a JOIN {VOXELS} b ON a.sample = b.sample AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz)"


@query("radiomics_neighbours", f"SELECT sample, axis, x, y, z, li level_i, lj level_j FROM {_NB}")
def _(t):
    return radiomics.neighbours(t.voxels(), "sample").select("sample", "axis", "x", "y", "z", "level_i", "level_j")


@query(
    "radiomics_glcm",
    f"""WITH c AS (SELECT sample, axis, i, j, count(*) n FROM (SELECT sample, axis, li i, lj j FROM {_NB} UNION ALL SELECT sample, axis, lj, li FROM {_NB}) GROUP BY 1, 2, 3, 4),
g AS (SELECT sample, axis, sum(n) t, sum(n * (i - j) * (i - j)) con, sum(n * n) en, sum(n / (1 + (i - j) * (i - j))::DOUBLE) ho, sum(n * i) si, sum(n * i * i) sii, sum(n * i * j) sij, sum(n * log2(n)) nl FROM c GROUP BY 1, 2)
SELECT sample, axis, round(con / t::DOUBLE, 9) contrast, round(en / (t * t)::DOUBLE, 9) energy, round(ho / t, 9) homogeneity, round(CASE WHEN t * sii - si * si > 0 THEN (t * sij - si * si) / (t * sii - si * si)::DOUBLE ELSE 1 END, 9) correlation, round(log2(t) - nl / t, 6) + 0 entropy FROM g""",
)
def _(t):
    # at nine digits no quotient of these counts lies halfway between two roundings
    return rounded(radiomics.glcm(t.voxels(), "sample").withColumn("entropy", F.round("entropy", 6) + 0.0), 9)


_RUN = """(WITH m AS (SELECT user_id, event_id, CAST(floor(value / 25) AS INT) level FROM events),
f AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER w THEN 1 ELSE 0 END nw FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY event_id) r FROM f) SELECT user_id, level, min(event_id) AS start, count(*) length FROM g GROUP BY user_id, r, level)"""


def _line(t):
    return t("events").select("user_id", "event_id", F.floor(F.col("value") / 25).cast("int").alias("level"))


@query("radiomics_runs", f"SELECT * FROM {_RUN}")
def _(t):
    return radiomics.runs(_line(t), "user_id", "event_id")


@query("radiomics_glrlm", f"WITH r AS (SELECT * FROM {_RUN}), g AS (SELECT user_id, sum(c * c) q FROM (SELECT user_id, level, count(*) c FROM r GROUP BY 1, 2) GROUP BY 1), l AS (SELECT user_id, sum(c * c) q FROM (SELECT user_id, length, count(*) c FROM r GROUP BY 1, 2) GROUP BY 1) SELECT r.user_id, round(avg(1.0::DOUBLE / (length * length)), 6) sre, round(avg(length * length), 6) lre, round(any_value(g.q) / count(*)::DOUBLE, 6) gln, round(any_value(l.q) / count(*)::DOUBLE, 6) rln, round(count(*) / sum(length)::DOUBLE, 6) run_percentage FROM r JOIN g USING (user_id) JOIN l USING (user_id) GROUP BY 1")
def _(t):
    return rounded(radiomics.glrlm(_line(t), "user_id", "user_id", "event_id"))


_ID = "sample || '/' || x || '/' || y || '/' || z"


@query(
    "radiomics_glszm",
    f"""WITH RECURSIVE v AS MATERIALIZED (SELECT {_ID} id, sample, level FROM {VOXELS}), e AS MATERIALIZED (SELECT {_ID} a, sample || '/' || nx || '/' || ny || '/' || nz b FROM {_NB} WHERE li = lj),
u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT id, id c FROM v UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id),
z AS (SELECT sample, level, c, count(*) s FROM (SELECT id, min(c) c FROM r GROUP BY 1) JOIN v USING (id) GROUP BY 1, 2, 3)
SELECT sample, count(*) zones, round(avg(1.0::DOUBLE / (s * s)), 6) sae, round(avg(s * s), 6) lae, round(count(*) / sum(s)::DOUBLE, 6) zone_percentage FROM z GROUP BY 1""",
)
def _(t):
    return rounded(radiomics.glszm(t.voxels(), "sample"))


@query("radiomics_ngtdm", f"""WITH v AS (SELECT * FROM {VOXELS}),
a AS (SELECT v.sample, v."level" l, count(*) c, abs(v."level" * count(*) - sum(w."level")) d FROM v, range(-1, 2) i(dx), range(-1, 2) j(dy), range(-1, 2) k(dz), v w
  WHERE w.sample = v.sample AND w.x = v.x + dx AND w.y = v.y + dy AND w.z = v.z + dz AND NOT (dx = 0 AND dy = 0 AND dz = 0) GROUP BY v.sample, v.x, v.y, v.z, v."level"),
s AS (SELECT sample, l::DOUBLE l, count(*) / (sum(count(*)) OVER (PARTITION BY sample))::DOUBLE p, (sum(count(*)) OVER (PARTITION BY sample))::DOUBLE n, sum(d / c::DOUBLE) s FROM a GROUP BY 1, 2),
t AS (SELECT sample, any_value(n) n, sum(p * s) ps, sum(s) s, count(*)::DOUBLE g FROM s GROUP BY 1),
q AS (SELECT x.sample, sum(x.p * y.p * (x.l - y.l) ** 2) con, sum(abs(x.l * x.p - y.l * y.p)) bus, sum(abs(x.l - y.l) * (x.p * x.s + y.p * y.s) / (x.p + y.p)) com, sum((x.p + y.p) * (x.l - y.l) ** 2) str FROM s x JOIN s y USING (sample) GROUP BY 1)
SELECT sample, round(CASE WHEN ps = 0 THEN 1e6 ELSE least(1 / ps, 1e6) END, 6) coarseness, round(CASE WHEN g < 2 THEN 0 ELSE con / (g * (g - 1)) * s / n END, 6) contrast, round(CASE WHEN bus = 0 THEN 0 ELSE ps / bus END, 6) busyness, round(com / n, 6) complexity, round(CASE WHEN s = 0 THEN 0 ELSE str / s END, 6) strength
FROM t JOIN q USING (sample)""")
def _(t):
    return rounded(radiomics.ngtdm(t.voxels(), "sample"))


@query("radiomics_gldm", f"WITH n AS (SELECT sample, x, y, z FROM {_NB} WHERE li = lj UNION ALL SELECT sample, nx, ny, nz FROM {_NB} WHERE li = lj), d AS (SELECT v.sample, v.x, v.y, v.z, (SELECT count(*) FROM n WHERE n.sample = v.sample AND n.x = v.x AND n.y = v.y AND n.z = v.z) dependence FROM {VOXELS} v) SELECT sample, dependence, count(*) n FROM d GROUP BY 1, 2")
def _(t):
    return radiomics.gldm(t.voxels(), "sample")


@query("radiomics_shape", f"SELECT v.sample, v.n::DOUBLE volume, CAST(6 * v.n - 2 * coalesce(k.n, 0) AS BIGINT) faces, ex extent_x, ey extent_y, ez extent_z FROM (SELECT sample, count(*) n, max(x) - min(x) + 1 ex, max(y) - min(y) + 1 ey, max(z) - min(z) + 1 ez FROM {VOXELS} GROUP BY 1) v LEFT JOIN (SELECT sample, count(*) n FROM {_NB} GROUP BY 1) k USING (sample)")
def _(t):
    return radiomics.shape(t.voxels(), "sample")


# ------------------------------------------------------------------------ models


@query("models_fit_lr")
def _(t):
    d = t("lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("double"))
    f = ["l_quantity", "l_discount", "l_tax"]
    m = models.fit_lr(d, f)
    return m.transform(d).groupBy("label", "prediction").agg(F.count("*").alias("n"))


def _labelled(t):
    return t("lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", (F.col("l_quantity") + F.col("l_orderkey") % 7 * 3 > 30).cast("double").alias("label"))


_PREDICTORS = ["l_quantity", "l_discount", "l_tax"]


@query("models_evaluate")
def _(t):
    """Three kinds of models by AUROC, accuracy and macro F1 on orders that they haven't seen."""
    d = _labelled(t)
    train, held = d.where("l_orderkey % 5 <> 0"), d.where("l_orderkey % 5 = 0")
    fits = {"lr": models.fit_lr(train, _PREDICTORS), "rf": models.fit_rf(train, _PREDICTORS, trees=10, depth=4), "svm": models.fit_svm_linear(train, _PREDICTORS, maxIter=20)}
    out = [models.evaluate(m, held).withColumn("model", F.lit(name)) for name, m in fits.items()]
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]), 3)


_LABELLED = "(SELECT l_orderkey, l_quantity, l_discount, l_tax, (l_quantity + l_orderkey % 7 * 3 > 30)::DOUBLE AS label FROM lineitem)"
_EACH = " UNION ALL ".join(f"SELECT '{f}' feature, abs(covar_samp({f}, label) / stddev_samp({f})) c FROM {_LABELLED}" for f in _PREDICTORS)


@query("models_importance", f"SELECT feature, true first FROM ({_EACH}) ORDER BY c DESC LIMIT 1")
def _(t):
    """The feature that makes the label comes first."""
    d = _labelled(t)
    top = models.importance(models.fit_rf(d, _PREDICTORS, trees=10, depth=4), _PREDICTORS, t.spark).orderBy(F.desc("importance")).limit(1)
    return top.select("feature", (F.col("importance") > 0.5).alias("first"))


@query("models_lasso_select", f"SELECT feature FROM ({_EACH}) WHERE c > 0.05")
def _(t):
    """The features that keep a coefficient: of independent ones, those whose scaled covariance with the label is above the penalty."""
    return t.spark.createDataFrame([(f,) for f in models.lasso_select(_labelled(t), _PREDICTORS, "label", 0.05)], "feature string")


@query("models_cv_search", f"""WITH r AS (SELECT l_orderkey % 3 fold, label, rank() OVER (PARTITION BY l_orderkey % 3 ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_orderkey % 3, l_quantity) - 1) / 2.0 r FROM {_LABELLED}),
a AS (SELECT (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) auroc FROM r GROUP BY fold) SELECT CAST(3 AS INT) candidates, avg(auroc) > 0.6 better_than_chance FROM a""")
def _(t):
    from pyspark.ml.classification import LogisticRegression

    d = _labelled(t).withColumn("fold", (F.col("l_orderkey") % 3).cast("int"))
    lr = LogisticRegression(labelCol="label", maxIter=10)
    grid = [{lr.regParam: p["regParam"]} for p in models.random_grid({"regParam": (1e-4, 1e-1, "log")}, 3)]
    out = models.cv_search(d, _PREDICTORS, grid, lr)
    return t.spark.createDataFrame([(len(out["mean"]), bool(min(out["mean"]) > 0.6))], "candidates int, better_than_chance boolean")


@query("models_cox_outputs")
def _(t):
    """Concordance of a fitted risk, and mean survival at three times."""
    d = t("orders").select("o_orderkey", F.datediff("o_orderdate", F.lit("1970-01-01")).alias("time"), (F.col("o_orderstatus") == "F").alias("event"), (F.col("o_totalprice") / 1e5).alias("x"))
    c = models.Cox(["x"]).fit(d)
    at = c.survival_at(d, c.baseline(d), [8500.0, 9000.0, 9500.0], "o_orderkey").groupBy("time").agg(F.avg("survival").alias("survival"))
    return rounded(at.join(F.broadcast(c.c_index(d))))


@query("models_cox", f"""WITH RECURSIVE c AS (SELECT "time" t, risk * 10 x, count(*) n, count(*) FILTER (event) d FROM {SURV} GROUP BY 1, 2),
f AS (SELECT 0 step, CAST(0 AS DOUBLE) b UNION ALL
  SELECT step + 1, b + sum(dx - d * s1 / s0) / sum(d * (s2 / s0 - (s1 / s0) ** 2)) FROM (
    SELECT step, b, t, sum(d) d, sum(d * x) dx, sum(sum(n * exp(b * x))) OVER w s0, sum(sum(n * x * exp(b * x))) OVER w s1, sum(sum(n * x * x * exp(b * x))) OVER w s2
    FROM f, c WHERE step < 12 GROUP BY step, b, t WINDOW w AS (PARTITION BY step ORDER BY t DESC)) GROUP BY step, b),
h AS (SELECT t, sum(d) d, sum(sum(n * exp(b * x))) OVER (ORDER BY t DESC) s0 FROM c, f WHERE step = 12 GROUP BY t)
SELECT t "time", round(sum(d / s0) OVER (ORDER BY t), 6) hazard, round(exp(-sum(d / s0) OVER (ORDER BY t)), 6) survival FROM h WHERE d > 0""")
def _(t):
    d = t.survival().withColumn("x", F.col("risk") * 10)
    c = models.Cox(["x"]).fit(d)
    return rounded(c.baseline(d))


@query("models_lr_one", f"""WITH RECURSIVE c AS (SELECT l_quantity x, count(*) n, sum(label) y FROM {_LABELLED} GROUP BY 1),
f AS (SELECT 0 step, CAST(0 AS DOUBLE) a, CAST(0 AS DOUBLE) b UNION ALL
  SELECT step + 1, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1), b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) FROM (
    SELECT step, a, b, sum(y - n * p) g0, sum(x * (y - n * p)) g1, sum(n * p * (1 - p)) h0, sum(n * x * p * (1 - p)) h1, sum(n * x * x * p * (1 - p)) h2
    FROM (SELECT *, 1 / (1 + exp(-a - b * x)) p FROM f, c WHERE step < 15) GROUP BY step, a, b))
SELECT x l_quantity, round(1 / (1 + exp(-a - b * x)), 4) score FROM c, f WHERE step = 15""")
def _(t):
    """The probabilities of a logistic regression on one feature, a row for each of its values."""
    d = _labelled(t)
    scored = models.predict_proba(models.fit_lr(d, ["l_quantity"], tol=1e-12), d)
    return scored.groupBy("l_quantity").agg(F.round(F.max("score"), 4).alias("score"))


@query("models_aft")
def _(t):
    d = t.survival().withColumn("x", F.col("risk") * 10)
    m = models.fit_aft(d.withColumn("event", F.col("event").cast("double")), ["x"])
    return m.transform(d.withColumn("_censor", F.lit(1.0))).groupBy("risk").agg(F.round(F.avg("prediction"), 4).alias("predicted_time"))


@query("udf_map_batches", f"SELECT l_orderkey, l_linenumber, l_discount + l_tax AS total FROM {FEATURES}")
def _(t):
    from tilewright.functions.hooks import map_batches

    return map_batches(t("lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), lambda p: p.assign(total=p.l_discount + p.l_tax)[["l_orderkey", "l_linenumber", "total"]], "l_orderkey long, l_linenumber int, total double")


@query("udf_expand", "SELECT doc_id, CAST(i AS INT) line, CAST(length(lines[i + 1]) AS INT) n_chars FROM (SELECT doc_id, string_split(text, chr(10)) lines FROM documents), LATERAL (SELECT unnest(range(len(lines))) i)")
def _(t):
    """The lines of each text, one to many."""
    from tilewright.functions.hooks import expand

    lines = expand(t("documents").select("doc_id", "text"), "text", lambda x: ((i, len(v)) for i, v in enumerate(x.split("\n"))), "line int, n_chars int")
    return lines.where("error IS NULL").select("doc_id", "line", "n_chars")


@query("udf_fold_groups", "SELECT user_id, count(*) n, count(*) FILTER (event_type <> before) changes FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) before FROM events) GROUP BY 1")
def _(t):
    """How often each user's event type changes, row by row."""
    from tilewright.functions.hooks import fold_groups

    def step(state, row):
        n, changes, last = state
        return n + 1, changes + (last is not None and row["event_type"] != last), row["event_type"]

    return fold_groups(t("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], lambda: (0, 0, None), step, lambda s: [(s[0], s[1])], "n long, changes long")


@query("udf_per_group", "SELECT label, count(*) n FROM embeddings GROUP BY 1")
def _(t):
    import pandas as pd

    from tilewright.functions.hooks import per_group

    return per_group(t("embeddings").select("label", "vec_id"), ["label"], lambda p: pd.DataFrame({"label": [int(p.label.iloc[0])], "n": [len(p)]}), "label int, n long")


def _edges(t):
    return t("orders").select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") % 97).alias("dst"))


@query("graph_components_stars", "SELECT o_orderkey % 97 component, count(*) + CASE WHEN min(o_orderkey) > o_orderkey % 97 THEN 1 ELSE 0 END n FROM orders GROUP BY o_orderkey % 97")
def _(t):
    return graph.components(_edges(t)).groupBy("component").agg(F.count("*").alias("n"))
