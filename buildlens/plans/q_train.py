"""Registered queries: forest and attention-fusion training / scoring (phase 6-7, rows-only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import sample_id as sample_id_expr
from ..operators import embed as EM
from ..operators import forest as RF
from ..operators import fusion as FU
from ..operators import metrics as M
from ..operators import trees as TR
from ..operators.splits import assign_splits, first_n_samples, split_repos
from ..sources import manifest as MF
from ..sources import shards as SH
from ..sources.builds import check_input_exists
from ..sources.shards import repair_labels, scratch_dir
from . import duck as D
from . import fixtures as FX
from .q_models import _duck_greedy

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def training_samples(spark, sf_dir):
    """View 5 after label repair (J5), with ids: the table the models read."""
    s = repair_labels(FX.samples_fx(spark, sf_dir)).drop("label").withColumnRenamed("label_repaired", "label")
    return s.withColumn("sample_id", sample_id_expr(F.col("repo"), F.col("commit_sha"), F.lit(None).cast("string"),
                                                    F.col("global_index")))


@query("rf_train")
def q_rf_train(spark, sf_dir):
    """M5/M8: fit on the train repos, metrics on validation and test (300 trees, any depth)."""
    _, metrics, _ = RF.train_and_score(training_samples(spark, sf_dir), seed=0)
    return metrics


@query("rf_predict")
def q_rf_predict(spark, sf_dir):
    """M7/M4: test-split result table of a forest that was stored and loaded."""
    model, _, test = RF.train_and_score(training_samples(spark, sf_dir), seed=0)
    path = scratch_dir(spark, "forest")
    RF.save(model, path, {}, {})
    return M.result_table(RF.predict(RF.load(path)[0], test.drop("prediction")), ["repo", "commit_sha"])


@query("rf_sweep")
def q_rf_sweep(spark, sf_dir):
    """M9: sample-size sweep over a fifth, a half and all of the samples (300 trees, the default)."""
    s = training_samples(spark, sf_dir)
    n = s.count()
    return RF.sample_sweep(s, [n // 5, n // 2, n], seed=0)


def _cfg(dim: int) -> FU.FusionConfig:
    return FU.FusionConfig(embedding_dim=dim)


def _u(key_sql: str) -> str:
    """DuckDB text of the md5-seeded uniform in [0, 1) used by ``fusion.hashed_uniform``."""
    return f"(CAST(('0x' || substring(md5({key_sql}), 1, 8)) AS BIGINT) / 4294967296.0)"


def _w(key_sql: str, fan_in: str) -> str:
    return f"(({_u(key_sql)} * 2.0 - 1.0) * (1.0 / sqrt({fan_in})))"


_FUSION_SQL = FX.duck_with(sx=FX.DUCK_SAMPLES).rstrip("\n") + f"""
, s0 AS (SELECT *, {D.sample_id('repo', 'commit_sha', 'NULL', 'global_index')} AS sample_id FROM sx),
nd AS (SELECT shard_index, bool_or(label IS NULL) AS needs FROM s0 GROUP BY shard_index),
s AS (SELECT s0.global_index, s0.sample_id, CASE WHEN s0.label IS NULL THEN s0.sidecar_label ELSE s0.label END AS label,
      message_embedding, diff_embedding, context_embedding FROM s0 JOIN nd USING (shard_index)),
dims AS (SELECT max(len(message_embedding)) AS e FROM s),
x AS (SELECT sample_id, 0 AS m, unnest(message_embedding) AS v, generate_subscripts(message_embedding, 1) - 1 AS c FROM s
      UNION ALL SELECT sample_id, 1, unnest(diff_embedding), generate_subscripts(diff_embedding, 1) - 1 FROM s
      UNION ALL SELECT sample_id, 2, unnest(context_embedding), generate_subscripts(context_embedding, 1) - 1 FROM s),
mods AS (SELECT * FROM (VALUES (0, 'message'), (1, 'diff'), (2, 'context')) t(m, name)),
rr AS (SELECT unnest(range(0, 128)) AS r),
aa AS (SELECT unnest(range(0, 64)) AS a),
cc AS (SELECT unnest(range(0, (SELECT e FROM dims))) AS c),
pw AS (SELECT m, r, c, {_w("'0:' || name || '.W:' || r || ':' || c", "(SELECT e FROM dims)")} AS w FROM mods, rr, cc),
pb AS (SELECT m, r, {_w("'0:' || name || '.b:' || r", "(SELECT e FROM dims)")} AS b FROM mods, rr),
z AS (SELECT x.sample_id, x.m, pw.r, sum(x.v * pw.w) + max(pb.b) AS z FROM x JOIN pw ON pw.m = x.m AND pw.c = x.c
      JOIN pb ON pb.m = pw.m AND pb.r = pw.r GROUP BY x.sample_id, x.m, pw.r),
mu AS (SELECT *, avg(z) OVER (PARTITION BY sample_id, m) AS mu FROM z),
ln AS (SELECT *, avg((z - mu) * (z - mu)) OVER (PARTITION BY sample_id, m) AS var FROM mu),
h AS (SELECT sample_id, m, r, greatest((z - mu) * (1.0 / sqrt(var + 1e-5)), 0.0) AS h FROM ln),
w1 AS (SELECT a, r, {_w("'0:att1.W:' || a || ':' || r", "128")} AS w FROM aa, rr),
b1 AS (SELECT a, {_w("'0:att1.b:' || a", "128")} AS b FROM aa),
pa AS (SELECT h.sample_id, h.m, w1.a, tanh(sum(h.h * w1.w) + max(b1.b)) AS t FROM h JOIN w1 ON w1.r = h.r
       JOIN b1 ON b1.a = w1.a GROUP BY h.sample_id, h.m, w1.a),
w2 AS (SELECT a, {_w("'0:att2.W:0:' || a", "64")} AS w FROM aa),
sc AS (SELECT pa.sample_id, pa.m, sum(pa.t * w2.w) + {_w("'0:att2.b:0'", "64")} AS s FROM pa JOIN w2 USING (a)
       GROUP BY pa.sample_id, pa.m),
sx2 AS (SELECT sample_id, m, exp(s - max(s) OVER (PARTITION BY sample_id)) AS ex FROM sc),
al AS (SELECT sample_id, m, ex / sum(ex) OVER (PARTITION BY sample_id) AS alpha FROM sx2),
fu AS (SELECT h.sample_id, h.r, sum(al.alpha * h.h) AS f FROM h JOIN al USING (sample_id, m) GROUP BY h.sample_id, h.r),
jj AS (SELECT unnest(range(0, 128)) AS j),
c1 AS (SELECT j, r, {_w("'0:cls1.W:' || j || ':' || r", "128")} AS w FROM jj, rr),
cb AS (SELECT j, {_w("'0:cls1.b:' || j", "128")} AS b FROM jj),
q AS (SELECT fu.sample_id, c1.j, greatest(sum(fu.f * c1.w) + max(cb.b), 0.0) AS q FROM fu JOIN c1 ON c1.r = fu.r
      JOIN cb ON cb.j = c1.j GROUP BY fu.sample_id, c1.j),
c2 AS (SELECT j, {_w("'0:cls2.W:0:' || j", "128")} AS w FROM jj),
lg AS (SELECT q.sample_id, sum(q.q * c2.w) + {_w("'0:cls2.b:0'", "128")} AS logit FROM q JOIN c2 USING (j)
       GROUP BY q.sample_id),
att AS (SELECT sample_id, list(round(alpha, 6) ORDER BY m) AS attention FROM al GROUP BY sample_id),
scored AS (SELECT s.global_index, s.sample_id, CAST(s.label AS INTEGER) AS label, round(lg.logit, 6) AS logit,
 round(1.0 / (1.0 + exp(-lg.logit)), 6) AS probability,
 CAST(1.0 / (1.0 + exp(-lg.logit)) >= 0.5 AS INTEGER) AS prediction, att.attention
FROM s JOIN lg USING (sample_id) JOIN att USING (sample_id))
"""


@query("fusion_score", _FUSION_SQL + "SELECT * EXCLUDE (global_index) FROM scored")
def q_fusion_score(spark, sf_dir):
    """Logits, probabilities, predictions and attention with the md5-seeded initial weights
    (values rounded to 6 places)."""
    s = training_samples(spark, sf_dir)
    dim = s.select(F.size("message_embedding")).first()[0]
    out = FU.score(s, FU.init_params(_cfg(dim), 0), _cfg(dim))
    return out.select("sample_id", "label", F.round("logit", 6).alias("logit"),
                      F.round("probability", 6).alias("probability"), "prediction",
                      F.transform("attention", lambda a: F.round(a, 6)).alias("attention"))


@query("fusion_predict", _FUSION_SQL + """SELECT count(*) AS n,
 round(1.0 - avg(CAST(prediction = label AS DOUBLE)), 6) AS error FROM scored WHERE global_index < 200""")
def q_fusion_predict(spark, sf_dir):
    """First N samples, no split; error = 1 - correct / n."""
    s = first_n_samples(training_samples(spark, sf_dir), 200)
    dim = s.select(F.size("message_embedding")).first()[0]
    scored = FU.score(s, FU.init_params(_cfg(dim), 0), _cfg(dim))
    return scored.agg(F.count(F.lit(1)).alias("n"),
                      F.round(1.0 - F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("error"))


@query("fusion_train_history")
def q_fusion_train_history(spark, sf_dir):
    """Data-parallel AdamW on the train repos (10 epochs, the default); history per epoch."""
    s = training_samples(spark, sf_dir)
    dim = s.select(F.size("message_embedding")).first()[0]
    sp = assign_splits(s, split_repos(s, seed=0))
    _, hist = FU.train(sp.where("split = 'train'"), _cfg(dim), epochs=10, steps_per_epoch=2, seed=0,
                       validation_df=sp.where("split = 'validation'"))
    return hist


# ------------------------------------------------------------------ exact forest checks
TREE_DEPTH = 3


def _tree_sql() -> str:
    """One unbagged tree on the message vectors: per level a histogram, its running sums and the best split of every node."""
    ctes, outs = [], []
    part = lambda a, b: f"(({a}) * cw.w0 * (({a}) * cw.w0) + ({b}) * cw.w1 * (({b}) * cw.w1)) / (({a}) * cw.w0 + ({b}) * cw.w1)"
    for d in range(TREE_DEPTH + 1):
        ctes.append(f"size{d} AS (SELECT path, count_if(y = 0)::DOUBLE AS n0, count_if(y = 1)::DOUBLE AS n1 FROM n{d} GROUP BY path)")
        if d == TREE_DEPTH:
            outs.append(f"SELECT path, {d} AS depth, NULL AS feature, NULL AS bin, n0, n1 FROM size{d}")
            break
        ctes += [f"""h{d} AS (SELECT path, f, b, count_if(y = 0) AS c0, count_if(y = 1) AS c1 FROM n{d} JOIN b USING (i) GROUP BY ALL)""",
                 f"""c{d} AS (SELECT path, f, b, sum(c0) OVER w::DOUBLE AS l0, sum(c1) OVER w::DOUBLE AS l1 FROM h{d}
  WINDOW w AS (PARTITION BY path, f ORDER BY b))""",
                 f"""best{d} AS (SELECT path, f, b FROM c{d} JOIN size{d} USING (path), cw
  WHERE n0 > 0 AND n1 > 0 AND l0 + l1 > 0 AND n0 - l0 + (n1 - l1) > 0
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY {part('l0', 'l1')} + {part('n0 - l0', 'n1 - l1')} DESC, f, b) = 1)""",
                 f"""n{d + 1} AS (SELECT i, y, path || CASE WHEN b.b <= t.b THEN 'L' ELSE 'R' END AS path
  FROM n{d} JOIN best{d} t USING (path) JOIN b USING (i) WHERE b.f = t.f)"""]
        outs.append(f"SELECT path, {d} AS depth, f AS feature, b AS bin, n0, n1 FROM size{d} LEFT JOIN best{d} USING (path)")
    return FX.duck_with(s=FX.DUCK_SAMPLES).rstrip("\n") + """
, r AS (SELECT global_index AS i, CAST(coalesce(label, sidecar_label) AS INTEGER) AS y, message_embedding AS x FROM s),
v AS (SELECT i, unnest(x)::DOUBLE AS v, generate_subscripts(x, 1) - 1 AS f FROM r),
rng AS (SELECT f, min(v) AS lo, max(v) AS hi FROM v GROUP BY f),
b AS MATERIALIZED (SELECT i, v.f, CAST(greatest(0, least(31, floor((v - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END) * 32))) AS INTEGER) AS b
  FROM v JOIN rng USING (f)),
cw AS (SELECT count(*) / (2 * count_if(y = 0)) AS w0, count(*) / (2 * count_if(y = 1)) AS w1 FROM r),
n0 AS (SELECT i, y, '' AS path FROM r),
""" + ",\n".join(ctes) + "\nSELECT path, CAST(depth AS INTEGER) AS depth, CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin, " \
        "CAST(n0 AS BIGINT) AS n0, CAST(n1 AS BIGINT) AS n1 FROM (\n" + "\nUNION ALL ".join(outs) + ")"


@query("tree_fit", _tree_sql())
def q_tree_fit(spark, sf_dir):
    """M5: one tree of depth 3 without bagging, all features at every node, balanced class weights; its nodes by path."""
    s = training_samples(spark, sf_dir)
    weight = {r["label"]: r["weight"] for r in M.class_weights(s).collect()}
    cfg = TR.TreeConfig(num_trees=1, max_depth=TREE_DEPTH, features=None, bagging=False, local=100)
    model = TR.fit(s, ["message_embedding"], "label", "global_index", cfg, (weight[0], weight[1]))
    at = model.nodes.where("depth = 0").select("node", F.lit("").alias("path"))
    paths = at
    for _ in range(TREE_DEPTH):
        inner = model.nodes.where("feature IS NOT NULL").join(at, "node")
        at = inner.select(F.col("left").alias("node"), F.concat("path", F.lit("L")).alias("path")) \
            .unionByName(inner.select(F.col("right").alias("node"), F.concat("path", F.lit("R")).alias("path")))
        paths = paths.unionByName(at)
    return model.nodes.join(paths, "node").select("path", "depth", "feature", "bin", "n0", "n1")


@query("forest_inference", FX.duck_with(s=FX.DUCK_SAMPLES).rstrip("\n") + _duck_greedy("s", "global_index", "first_seen") + """
SELECT s.repo, count(*) AS n, CAST(0 AS BIGINT) AS differ, 25 AS num_trees FROM s JOIN g USING (repo) WHERE g.split = 'test' GROUP BY s.repo""")
def q_forest_inference(spark, sf_dir):
    """A stored forest is loaded, not retrained, and scores the test repos as the fitted one did (per repo, rows that differ)."""
    model, _, test = RF.train_and_score(training_samples(spark, sf_dir), seed=0, num_trees=25, shuffle=False)
    path = scratch_dir(spark, "forest")
    RF.save(model, path, {"num_trees": 25}, {})
    loaded, config = RF.load(path)
    again = RF.predict(loaded, test.withColumnRenamed("prediction", "first"))
    return again.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first") != F.col("prediction")).alias("differ"),
                                     F.lit(config["num_trees"]).alias("num_trees"))


@query("sweep_splits", FX.duck_with(s=FX.DUCK_SAMPLES).rstrip("\n") + ",\nt AS (SELECT count(*) AS n FROM s)" + "".join(
    _duck_greedy(f"(SELECT s.* FROM s, t WHERE global_index < n // {d})", "global_index", "first_seen", tag=str(d)) for d in (5, 2, 1)) + """
SELECT budget, split, CAST(sum(n) AS BIGINT) AS n_samples, count(*) AS n_repos, CAST(sum(sum(n)) OVER (PARTITION BY budget) AS BIGINT) AS loaded_samples FROM (
""" + "\nUNION ALL ".join(f" SELECT t.n // {d} AS budget, g.split, r.repo, r.n FROM r{d} r JOIN g{d} g USING (repo), t" for d in (5, 2, 1)) + """
) GROUP BY budget, split""")
def q_sweep_splits(spark, sf_dir):
    """M9: sizes, repos and loaded samples of a sweep whose budgets follow the table (a fifth, a half, all), from one read."""
    s = training_samples(spark, sf_dir)
    n = s.count()
    splits = RF.sweep_splits(s, [n // 5, n // 2, n], shuffle=False)
    per = splits.groupBy("budget", "split").agg(F.sum("n_samples").alias("n_samples"), F.count(F.lit(1)).alias("n_repos"))
    return per.join(splits.groupBy("budget").agg(F.sum("n_samples").alias("loaded_samples")), "budget")


# ------------------------------------------------------------------ stored models and results, read back
@query("fusion_stored_model", _FUSION_SQL + "SELECT * EXCLUDE (global_index) FROM scored")
def q_fusion_stored_model(spark, sf_dir):
    """Fusion weights stored and loaded; the scores are those of the weights in memory."""
    s = training_samples(spark, sf_dir)
    cfg = _cfg(s.select(F.size("message_embedding")).first()[0])
    path = scratch_dir(spark, "fusion")
    FU.save(spark, FU.init_params(cfg, 0), cfg, path)
    return _rounded(FU.score(s, *FU.load(spark, path)))


def _rounded(scored):
    return scored.select("sample_id", "label", F.round("logit", 6).alias("logit"), F.round("probability", 6).alias("probability"),
                         "prediction", F.transform("attention", lambda a: F.round(a, 6)).alias("attention"))


@query("stored_predictions", _FUSION_SQL + "SELECT * EXCLUDE (global_index) FROM scored")
def q_stored_predictions(spark, sf_dir):
    """Predictions written as JSON and read back with a fixed schema."""
    s = training_samples(spark, sf_dir)
    cfg = _cfg(s.select(F.size("message_embedding")).first()[0])
    path = scratch_dir(spark, "predictions")
    SH.write_predictions(FU.score(s, FU.init_params(cfg, 0), cfg), path)
    return _rounded(spark.read.schema("sample_id string, label int, logit double, probability double, prediction int, attention array<double>").json(path))


@query("stored_result_table", FX.duck_with(p=FX.DUCK_PREDICTIONS) + """
SELECT doc_id, CAST(label AS INTEGER) AS label, CAST(prediction AS INTEGER) AS prediction, CAST(label = prediction AS INTEGER) AS accuracy FROM p""")
def q_stored_result_table(spark, sf_dir):
    """The result table written as header CSV and read back."""
    path = scratch_dir(spark, "results")
    SH.write_result_table(M.result_table(FX.predictions(spark, sf_dir), ["doc_id"]), path)
    return spark.read.option("header", True).schema("doc_id long, label int, prediction int, accuracy int").csv(path)


@query("embedding_metadata", FX.duck_with(s=FX.DUCK_SAMPLES) + """
SELECT key, value FROM (SELECT CAST(max(len(message_embedding)) AS VARCHAR) AS d FROM s),
 LATERAL (VALUES ('model_name', 'md5-feature-hashing'), ('max_length', '512'), ('pooling', 'mean'), ('embedding_dim', d), ('dtype', 'float32'), ('device', 'cpu')) AS t(key, value)""")
def q_embedding_metadata(spark, sf_dir):
    """What a run records of its embedder, read back from the manifest log."""
    dim = training_samples(spark, sf_dir).agg(F.max(F.size("message_embedding"))).first()[0]
    out = scratch_dir(spark, "embedder")
    MF.begin_run(spark, out, "a", {"embedding": EM.HashingEmbedder(dim, 512).metadata()})
    row = MF.read_log(spark, out).where("kind = 'config'").select(F.from_json(F.get_json_object("detail", "$.embedding"), "map<string,string>").alias("m"))
    return row.select(F.explode("m").alias("key", "value"))


@query("input_check", """
SELECT 'orders' AS name, true AS found, count(*) AS n FROM orders UNION ALL SELECT 'documents', true, count(*) FROM documents
UNION ALL SELECT 'absent', false, 0""")
def q_input_check(spark, sf_dir):
    """S3: inputs are looked for before any work; an absent one is an error, not an empty table."""
    rows = []
    for name in ("orders", "documents", "absent"):
        try:
            check_input_exists(spark, f"{sf_dir}/{name}.parquet")
            rows.append((name, True, FX.table(spark, sf_dir, name).count()))
        except FileNotFoundError:
            rows.append((name, False, 0))
    return spark.createDataFrame(rows, "name string, found boolean, n long")
