"""Registered queries: sample loading, repo split, metrics, fusion arithmetic (phase 5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import threshold_predict
from ..operators import metrics as M
from ..operators import splits as SP
from ..operators.ordering import with_global_index
from ..sources import shards as SH
from . import fixtures as FX
from .q_builds import _W_BUILDS, builds

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


_W_S = FX.duck_with(s=FX.DUCK_SAMPLES)
_W_P = FX.duck_with(p=FX.DUCK_PREDICTIONS)


def samples(spark, sf_dir):
    return FX.samples_fx(spark, sf_dir)


def _duck_greedy(source: str, index: str, order_expr: str, vf: float = 0.2, tf: float = 0.2, tag: str = "") -> str:
    """Recursive CTE walking repos by (size desc, order) and keeping the three split counts.

    Targets use DOUBLE arithmetic (as the engine does); DuckDB would otherwise
    evaluate the fraction literals as exact decimals and break ties differently.
    """
    frac = f"(CAST(1.0 AS DOUBLE) - CAST({vf} AS DOUBLE) - CAST({tf} AS DOUBLE))"
    return f"""
, r{tag} AS (SELECT repo, count(*) AS n, min({index}) AS first_seen FROM {source} GROUP BY repo),
o{tag} AS (SELECT repo, n, row_number() OVER (ORDER BY n DESC, {order_expr}) AS step FROM r{tag}),
tot{tag} AS (SELECT sum(n) * {frac} AS t0, sum(n) * CAST({vf} AS DOUBLE) AS t1,
  sum(n) * CAST({tf} AS DOUBLE) AS t2 FROM r{tag}),
g{tag} AS (SELECT * FROM (
  WITH RECURSIVE walk(step, c0, c1, c2, repo, split) AS (
    SELECT 0, 0, 0, 0, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
    UNION ALL
    SELECT o.step,
      c0 + CASE WHEN pick.s = 'train' THEN o.n ELSE 0 END,
      c1 + CASE WHEN pick.s = 'validation' THEN o.n ELSE 0 END,
      c2 + CASE WHEN pick.s = 'test' THEN o.n ELSE 0 END, o.repo, pick.s
    FROM walk JOIN o{tag} o ON o.step = walk.step + 1 CROSS JOIN tot{tag} tot,
    LATERAL (SELECT list_max(list_filter([
       {{'k1': (t0 - c0) / greatest(t0, 1.0), 'k2': -abs(t0 - (c0 + o.n)) / greatest(t0, 1.0), 'k3': 0, 's': 'train', 't': t0}},
       {{'k1': (t1 - c1) / greatest(t1, 1.0), 'k2': -abs(t1 - (c1 + o.n)) / greatest(t1, 1.0), 'k3': -1, 's': 'validation', 't': t1}},
       {{'k1': (t2 - c2) / greatest(t2, 1.0), 'k2': -abs(t2 - (c2 + o.n)) / greatest(t2, 1.0), 'k3': -2, 's': 'test', 't': t2}}
      ], lambda x: x.t > 0)).s AS s) pick)
  SELECT repo, split FROM walk WHERE step > 0))
"""


@query("first_n_samples", _W_S + "SELECT global_index, repo, label FROM s WHERE global_index < 137")
def q_first_n_samples(spark, sf_dir):
    return SP.first_n_samples(samples(spark, sf_dir), 137).select("global_index", "repo", "label")


@query("shard_union", _W_S + """
SELECT CAST(shard_index AS INTEGER) AS shard_index, count(*) AS num_samples FROM s GROUP BY shard_index""")
def q_shard_union(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("sample_id", F.concat(F.lit("s"), F.col("global_index").cast("string"))) \
        .withColumn("build_id", F.lit(None).cast("string")).withColumn("label", F.col("label").cast("int"))
    a, b = SH.scratch_dir(spark, "run_a"), SH.scratch_dir(spark, "run_b")
    SH.write_shards(s.where("shard_index < 2"), a)
    SH.write_shards(s.where("shard_index >= 2"), b)
    u = SP.union_shards(SH.read_shards(spark, a), SH.read_shards(spark, b))
    return u.groupBy("shard_index").agg(F.count(F.lit(1)).alias("num_samples"))


@query("truncate_text", """
SELECT doc_id, length(substring(text, 1, 20000)) AS retained_chars, length(text) > 20000 AS truncated FROM documents""")
def q_truncate_text(spark, sf_dir):
    d = FX.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(SP.truncate_text(F.col("text"), 20000)).alias("retained_chars"),
                    (F.length("text") > 20000).alias("truncated"))


@query("feature_concat", _W_S + """
SELECT global_index, len(list_concat(list_concat(message_embedding, diff_embedding), context_embedding)) AS n_features,
 round(list_sum(list_concat(list_concat(message_embedding, diff_embedding), context_embedding)), 4) AS feature_sum,
 list_concat(list_concat(message_embedding, diff_embedding), context_embedding)[65] AS first_diff_value FROM s""")
def q_feature_concat(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn(
        "f", SP.feature_vector("message_embedding", "diff_embedding", "context_embedding"))
    return s.select("global_index", F.size("f").alias("n_features"),
                    F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 4).alias("feature_sum"),
                    F.element_at("f", 65).alias("first_diff_value"))


@query("sample_subset", _W_S + """
, idx AS (SELECT global_index, row_number() OVER (ORDER BY repo DESC, global_index) - 1 AS pos FROM s WHERE label = 1)
SELECT idx.pos, s.global_index, s.repo FROM s JOIN idx USING (global_index)""")
def q_sample_subset(spark, sf_dir):
    s = samples(spark, sf_dir)
    idx = with_global_index(s.where("label = 1").select("global_index", "repo"),
                            [F.col("repo").desc(), F.col("global_index")], name="pos").select("global_index", "pos")
    return SP.subset_in_order(s, idx).select("pos", "global_index", "repo")


@query("repo_first_seen", _W_S + "SELECT repo, count(*) AS n_samples, min(global_index) AS first_seen FROM s GROUP BY repo")
def q_repo_first_seen(spark, sf_dir):
    return SP.repo_summary(samples(spark, sf_dir))


@query("repo_shuffle", _W_S + """
, r AS (SELECT DISTINCT repo FROM s)
SELECT repo, row_number() OVER (ORDER BY sha256('7:' || repo)) - 1 AS shuffle_rank FROM r""")
def q_repo_shuffle(spark, sf_dir):
    r = samples(spark, sf_dir).select("repo").distinct().withColumn("k", SP.shuffle_key(F.col("repo"), 7))
    return with_global_index(r, ["k"], name="shuffle_rank").select("repo", "shuffle_rank")


@query("repos_by_size", _W_S + """
, r AS (SELECT repo, count(*) AS n_samples, min(global_index) AS first_seen FROM s GROUP BY repo)
SELECT repo, n_samples, first_seen, row_number() OVER (ORDER BY n_samples DESC, first_seen) - 1 AS size_rank FROM r""")
def q_repos_by_size(spark, sf_dir):
    return SP.repos_by_size(SP.repo_summary(samples(spark, sf_dir)))


@query("repo_split", _W_S.rstrip("\n") + _duck_greedy("s", "global_index", "first_seen") + "SELECT repo, split FROM g")
def q_repo_split(spark, sf_dir):
    return SP.split_repos(samples(spark, sf_dir), shuffle=False).select("repo", "split")


@query("repo_split_builds", _W_BUILDS.rstrip("\n") + _duck_greedy("builds", "source_row_index", "first_seen")
       + "SELECT repo, split FROM g")
def q_repo_split_builds(spark, sf_dir):
    """G10 over the 1,500-repo build fixture (targets 60/20/20 of 15,000 at sf0.01)."""
    return SP.split_repos(builds(spark, sf_dir), shuffle=False, index_col="source_row_index").select("repo", "split")


@query("split_counts", _W_S.rstrip("\n") + _duck_greedy("s", "global_index", "first_seen") + """
SELECT g.split, count(*) AS n_samples, count(DISTINCT s.repo) AS n_repos FROM s JOIN g USING (repo) GROUP BY g.split""")
def q_split_counts(spark, sf_dir):
    s = samples(spark, sf_dir)
    return SP.split_counts(SP.assign_splits(s, SP.split_repos(s, shuffle=False)))


@query("sweep_sizes", _W_S.rstrip("\n") + "".join(
    _duck_greedy(f"(SELECT * FROM s WHERE global_index < {n})", "global_index", "first_seen", tag=str(n))
    for n in (100, 250, 500)) + """
SELECT * FROM (
 SELECT 100 AS budget, g.split, count(*) AS n_samples FROM (SELECT * FROM s WHERE global_index < 100) x JOIN g100 g USING (repo) GROUP BY ALL
 UNION ALL
 SELECT 250, g.split, count(*) FROM (SELECT * FROM s WHERE global_index < 250) x JOIN g250 g USING (repo) GROUP BY ALL
 UNION ALL
 SELECT 500, g.split, count(*) FROM (SELECT * FROM s WHERE global_index < 500) x JOIN g500 g USING (repo) GROUP BY ALL)""")
def q_sweep_sizes(spark, sf_dir):
    """M9 (sizes part): split sizes for each sample budget."""
    s = samples(spark, sf_dir)
    parts = []
    for n in (100, 250, 500):
        sub = SP.first_n_samples(s, n)
        c = SP.assign_splits(sub, SP.split_repos(sub, shuffle=False)).groupBy("split") \
            .agg(F.count(F.lit(1)).alias("n_samples")).select(F.lit(n).alias("budget"), "split", "n_samples")
        parts.append(c)
    return SP.union_shards(*parts)


@query("binary_metrics", _W_P + """
, c AS (SELECT count_if(label = 1 AND prediction = 1) AS tp, count_if(label = 0 AND prediction = 0) AS tn,
   count_if(label = 0 AND prediction = 1) AS fp, count_if(label = 1 AND prediction = 0) AS fn, count(*) AS n FROM p)
SELECT (tp + tn) / n AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
 CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
 CASE WHEN tp > 0 THEN 2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) ELSE 0.0 END AS f1
FROM c""")
def q_binary_metrics(spark, sf_dir):
    return M.binary_metrics(FX.predictions(spark, sf_dir))


@query("confusion_matrix", _W_P + """
SELECT [[count_if(label = 0 AND prediction = 0), count_if(label = 0 AND prediction = 1)],
        [count_if(label = 1 AND prediction = 0), count_if(label = 1 AND prediction = 1)]] AS matrix FROM p""")
def q_confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(FX.predictions(spark, sf_dir))


@query("confusion_table", _W_P + """
SELECT 0 AS actual, count_if(label = 0 AND prediction = 0) AS predicted_0, count_if(label = 0 AND prediction = 1) AS predicted_1
FROM p UNION ALL
SELECT 1, count_if(label = 1 AND prediction = 0), count_if(label = 1 AND prediction = 1) FROM p""")
def q_confusion_table(spark, sf_dir):
    return M.confusion_table(FX.predictions(spark, sf_dir))


@query("result_table", _W_P + "SELECT doc_id, label, prediction, CAST(label = prediction AS INTEGER) AS accuracy FROM p")
def q_result_table(spark, sf_dir):
    return M.result_table(FX.predictions(spark, sf_dir), ["doc_id"])


@query("class_weights", _W_S + """
, c AS (SELECT label, count(*) AS n_c FROM s WHERE label IS NOT NULL GROUP BY label)
SELECT label, (SELECT sum(n_c) FROM c) / ((SELECT count(*) FROM c) * n_c) AS weight FROM c""")
def q_class_weights(spark, sf_dir):
    return M.class_weights(samples(spark, sf_dir))


def _logits(spark, sf_dir):
    """Fixture logit: centred sum of the message vector; label from the sidecar."""
    s = samples(spark, sf_dir)
    return s.select("global_index", (F.aggregate("message_embedding", F.lit(0.0), lambda a, x: a + x)
                                     / F.lit(8.0)).alias("logit"), F.col("sidecar_label").alias("label"))


_W_LOGIT = _W_S.rstrip("\n") + ",\nl AS (SELECT global_index, list_sum(message_embedding) / 8.0 AS logit, sidecar_label AS label FROM s)\n"


@query("threshold_predict", _W_LOGIT + """
SELECT global_index, CAST(1.0 / (1.0 + exp(-logit)) >= 0.5 AS INTEGER) AS prediction FROM l""")
def q_threshold_predict(spark, sf_dir):
    return _logits(spark, sf_dir).select("global_index", threshold_predict(F.col("logit"), 0.5).alias("prediction"))


@query("bce_loss", _W_LOGIT + """
SELECT round(avg(greatest(logit, 0.0) - logit * label + ln(1 + exp(-abs(logit)))), 6) AS loss,
 round(1.0 - avg(CAST(CAST(1.0 / (1.0 + exp(-logit)) >= 0.5 AS INTEGER) = label AS DOUBLE)), 6) AS error FROM l""")
def q_bce_loss(spark, sf_dir):
    r = M.bce_loss(_logits(spark, sf_dir))
    return r.select(F.round("loss", 6).alias("loss"), F.round("error", 6).alias("error"))


@query("attention_fuse", _W_S + """
, w AS (SELECT global_index, message_embedding AS a, diff_embedding AS b, context_embedding AS c,
   list_sum(message_embedding) AS sa, list_sum(diff_embedding) AS sb, list_sum(context_embedding) AS sc FROM s),
x AS (SELECT *, greatest(sa, sb, sc) AS m FROM w),
y AS (SELECT *, exp(sa - m) / (exp(sa - m) + exp(sb - m) + exp(sc - m)) AS wa,
   exp(sb - m) / (exp(sa - m) + exp(sb - m) + exp(sc - m)) AS wb,
   exp(sc - m) / (exp(sa - m) + exp(sb - m) + exp(sc - m)) AS wc FROM x)
SELECT global_index, round(wa, 6) AS w_message, round(wb, 6) AS w_diff, round(wc, 6) AS w_context,
 round(list_sum(list_transform(range(1, len(a) + 1), lambda i: wa * a[i] + wb * b[i] + wc * c[i])), 5) AS fused_sum
FROM y""")
def q_attention_fuse(spark, sf_dir):
    s = samples(spark, sf_dir)

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    s = s.withColumn("scores", F.array(total("message_embedding"), total("diff_embedding"), total("context_embedding")))
    s = s.withColumn("w", M.attention_weights(F.col("scores")))
    s = s.withColumn("fused", M.attention_fuse(F.col("w"), F.col("message_embedding"), F.col("diff_embedding"),
                                               F.col("context_embedding")))
    return s.select("global_index", F.round(F.col("w")[0], 6).alias("w_message"), F.round(F.col("w")[1], 6).alias("w_diff"),
                    F.round(F.col("w")[2], 6).alias("w_context"), F.round(total("fused"), 5).alias("fused_sum"))


@query("first_n_from_shards", _W_S + """
SELECT CAST(shard_index AS INTEGER) AS shard_index, CAST(record_index AS INTEGER) AS record_index, repo,
 CAST(label AS INTEGER) AS label FROM s WHERE global_index < 137""")
def q_first_n_from_shards(spark, sf_dir):
    """L1 with limit pushdown: written shards, manifest counts, only the needed shard folders read."""
    s = samples(spark, sf_dir).withColumn("sample_id", F.concat(F.lit("s"), F.col("global_index").cast("string"))) \
        .withColumn("build_id", F.lit(None).cast("string")).withColumn("label", F.col("label").cast("int"))
    path = SH.scratch_dir(spark, "shards_first_n")
    SH.write_shards(s, path)
    shards = SH.read_shards(spark, path, require_files=True)
    got = SH.first_n_from_shards(shards, SH.manifest_shards(shards), 137)
    return got.select("shard_index", "record_index", "repo", "label")
