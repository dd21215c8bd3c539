"""Catalog part 5: sources, sinks and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from mortar.operators import clean as B
from mortar.plans import sql_blocks as Q
from mortar.plans.fixtures import score_table
from mortar.plans.registry import query, with_ctes
from mortar.session import scratch_dir
from mortar.sources import dirty as D
from mortar.sources import results as R
from mortar.sources.tables import RAW_FEATURES, TARGET, table

# ----------------------------------------------------------------------------- A1 / B1-B8


def _scanned(spark, sf):
    return D.read_dirty_csv(spark, D.write_dirty_csv(spark, sf))


def _clean_sql_cols():
    cols = []
    for c in RAW_FEATURES:
        if c in D.JUNK and c != TARGET:
            mod, rem, text = D.JUNK[c]
            repl = {"nan": "0.0", "N\\A": "0.0", "": "0.0", " 7 ": "7.0", "1e3": "1000.0", "1,000": "0.0", "1d": "0.0"}[text]
            cols.append(f"CASE WHEN row_id % {mod} = {rem} THEN {repl} ELSE {c} END AS {c}")
        else:
            cols.append(c)
    return cols


EMPTY = f"row_id % {D.EMPTY_ROW[0]} = {D.EMPTY_ROW[1]}"
TJ = D.JUNK[TARGET]
TARGET_SQL = f"CASE WHEN row_id % {TJ[0]} = {TJ[1]} THEN NULL ELSE {TARGET} END"
SCAN_SQL = with_ctes(
    f"SELECT row_id, {', '.join(_clean_sql_cols())}, CAST(2000 + row_id % 400 AS DOUBLE) AS density_kg_m, "
    f"{TARGET_SQL} AS {TARGET} FROM mix WHERE NOT ({EMPTY}) AND ({TARGET_SQL}) IS NOT NULL")


@query("scan_mix", SCAN_SQL)
def scan_mix(spark, sf):
    return B.load_clean(_scanned(spark, sf), TARGET)


@query("drop_empty_rows", with_ctes(f"SELECT row_id FROM mix WHERE NOT ({EMPTY})"))
def drop_empty_rows(spark, sf):
    df = B.coerce_all(B.normalise_headers(_scanned(spark, sf)))
    return B.drop_empty_rows(df).select(F.col("row_id").cast("long").alias("row_id"))


@query("drop_null_target", with_ctes(f"SELECT row_id FROM mix WHERE NOT ({EMPTY}) AND ({TARGET_SQL}) IS NOT NULL"))
def drop_null_target(spark, sf):
    df = B.drop_empty_rows(B.coerce_all(B.normalise_headers(_scanned(spark, sf))))
    return B.drop_null_target(df, TARGET).select(F.col("row_id").cast("long").alias("row_id"))


@query("fill_features", with_ctes(
    f"SELECT row_id, {', '.join(c for c in _clean_sql_cols() if ' AS ' in c)} FROM mix "
    f"WHERE NOT ({EMPTY}) AND ({TARGET_SQL}) IS NOT NULL"))
def fill_features(spark, sf):
    junk_cols = [c for c in RAW_FEATURES if c in D.JUNK]
    return B.load_clean(_scanned(spark, sf), TARGET).select("row_id", *junk_cols)


@query("audit_missing", with_ctes(
    f"SELECT count(*) FILTER (WHERE ({TARGET_SQL}) IS NULL) AS n_missing, count(*) AS n_total FROM mix WHERE NOT ({EMPTY})"))
def audit_missing(spark, sf):
    df = B.drop_empty_rows(B.coerce_all(B.normalise_headers(_scanned(spark, sf))))
    return B.audit_missing(df, TARGET)


def _messy_names_spark(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.concat(
        F.col("p_type"), F.lit("  ("), F.col("p_brand"), F.lit(")/"), F.upper("p_name"),
        F.when(F.col("p_size") % 3 == 0, F.lit("\n°C")).otherwise(F.lit(""))).alias("raw"))


MESSY_NAMES_SQL = ("SELECT p_partkey, p_type || '  (' || p_brand || ')/' || upper(p_name) || "
                   "CASE WHEN p_size % 3 = 0 THEN chr(10) || '°C' ELSE '' END AS raw FROM part")


def _clean_name_sql(x):
    x = f"trim(replace({x}, chr(10), ' '))"
    x = f"lower(regexp_replace({x}, '\\s+', ' ', 'g'))"
    x = f"regexp_replace({x}, '[°/()]', ' ', 'g')"
    x = f"regexp_replace({x}, '[^a-z0-9]+', '_', 'g')"
    x = f"regexp_replace({x}, '_+', '_', 'g')"
    return f"regexp_replace({x}, '^_+|_+$', '', 'g')"


@query("clean_names", f"WITH m AS ({MESSY_NAMES_SQL}) SELECT p_partkey, raw, {_clean_name_sql('raw')} AS name FROM m")
def clean_names(spark, sf):
    m = _messy_names_spark(spark, sf)
    return m.select("p_partkey", "raw", B.clean_name_col(F.col("raw")).alias("name"))


def _messy_values_spark(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    raw = (F.when(k % 9 == 0, " 7 ").when(k % 9 == 1, "1e3").when(k % 9 == 2, "1,000").when(k % 9 == 3, "1d")
           .when(k % 9 == 4, "nan").when(k % 9 == 5, "N\\A").when(k % 9 == 6, "")
           .when(k % 9 == 7, F.concat(F.col("o_custkey").cast("string"), F.lit(".5")))
           .otherwise(F.concat(F.lit("-"), (k % 100).cast("string"), F.lit("e-2"))))
    return o.select(k.alias("row_id"), raw.alias("raw"))


MESSY_VALUES_SQL = ("SELECT o_orderkey AS row_id, CASE o_orderkey % 9 WHEN 0 THEN ' 7 ' WHEN 1 THEN '1e3' WHEN 2 THEN '1,000' "
                    "WHEN 3 THEN '1d' WHEN 4 THEN 'nan' WHEN 5 THEN 'N\\A' WHEN 6 THEN '' "
                    "WHEN 7 THEN CAST(o_custkey AS VARCHAR) || '.5' ELSE '-' || CAST(o_orderkey % 100 AS VARCHAR) || 'e-2' END AS raw "
                    "FROM orders")


@query("coerce_numeric", f"WITH m AS ({MESSY_VALUES_SQL}) SELECT row_id, raw, CASE WHEN regexp_full_match(raw, "
                         f"'\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') THEN TRY_CAST(trim(raw) AS DOUBLE) END AS value FROM m")
def coerce_numeric(spark, sf):
    m = _messy_values_spark(spark, sf)
    return m.select("row_id", "raw", B.coerce_numeric(F.col("raw")).alias("value"))


# ----------------------------------------------------------------------------- A2 / B13


def param_table(spark, sf):
    """F7 fixture: ragged nullable parameters per (feature_set, model) from the score table."""
    s = score_table(spark, sf).where(F.col("cv") == "random_5x5")
    c = F.col
    return s.select(
        "feature_set", "model",
        F.when(c("model").isin("Random Forest", "ExtraTrees", "Gradient Boosting", "XGBoost", "LightGBM"),
               F.floor(c("test_mae_mean")) * 10.0).alias("n_estimators"),
        F.when(c("feature_set") == "raw", F.floor(c("test_r2_mean") * 10.0)).alias("max_depth"),
        (F.floor(c("val_r2_mean") * 1000.0) / 10000.0).alias("learning_rate"),
        F.when(c("model") == "KNN", F.lit(7.0)).alias("n_neighbors"),
        F.when(c("model").isin("Ridge", "Lasso"), c("train_mae_std")).alias("alpha"),
        F.when(c("model") == "SVR_RBF", F.lit(16.0)).alias("units_l0"),
        F.when(c("model") == "SVR_RBF", F.lit(32.5)).alias("batch_size"))


PARAMS_SQL = (
    "SELECT feature_set, model, "
    "CASE WHEN model IN ('Random Forest', 'ExtraTrees', 'Gradient Boosting', 'XGBoost', 'LightGBM') "
    "THEN floor(test_mae_mean) * 10.0 END AS n_estimators, "
    "CASE WHEN feature_set = 'raw' THEN floor(test_r2_mean * 10.0) END AS max_depth, "
    "floor(val_r2_mean * 1000.0) / 10000.0 AS learning_rate, CASE WHEN model = 'KNN' THEN 7.0 END AS n_neighbors, "
    "CASE WHEN model IN ('Ridge', 'Lasso') THEN train_mae_std END AS alpha, CASE WHEN model = 'SVR_RBF' THEN 16.0 END AS units_l0, "
    "CASE WHEN model = 'SVR_RBF' THEN 32.5 END AS batch_size FROM scores WHERE cv = 'random_5x5'")
PARAM_NAMES = ["n_estimators", "max_depth", "learning_rate", "n_neighbors", "alpha", "units_l0", "batch_size"]


@query("scan_params", with_ctes(
    "SELECT feature_set, model, " + ", ".join(f"CAST({p} AS DOUBLE) AS {p}" for p in PARAM_NAMES) + " FROM prm",
    **Q.score_table_sql(), prm=PARAMS_SQL))
def scan_params(spark, sf):
    path = scratch_dir(spark, "params")
    param_table(spark, sf).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _decode_sql():
    longs = " UNION ALL ".join(f"SELECT feature_set, model, '{p}' AS name, CAST({p} AS DOUBLE) AS value FROM prm "
                               f"WHERE {p} IS NOT NULL" for p in PARAM_NAMES)
    ints = ", ".join(f"'{p}'" for p in B.INT_PARAMS)
    return with_ctes(
        f"SELECT feature_set, model, name, value, CASE WHEN (name IN ({ints}) OR starts_with(name, 'units_l') OR name = 'batch_size') "
        f"AND value = floor(value) THEN CAST(CAST(value AS BIGINT) AS DOUBLE) END AS int_value FROM lng",
        **Q.score_table_sql(), prm=PARAMS_SQL, lng=longs)


@query("params_decode", _decode_sql())
def params_decode(spark, sf):
    long = B.params_long(param_table(spark, sf))
    n, v = F.col("name"), F.col("value")
    is_int = (n.isin(B.INT_PARAMS) | n.startswith("units_l") | (n == "batch_size")) & (v == F.floor(v))
    return long.select("feature_set", "model", "name", "value",
                       F.when(is_int, v.cast("long").cast("double")).alias("int_value"))


# ----------------------------------------------------------------------------- A3


def _legacy_rows(spark, sf):
    s = score_table(spark, sf).where((F.col("cv") == "random_5x5") & (F.col("feature_set") == "raw"))
    return s.orderBy("model").limit(7)  # the legacy sheet holds 7 models


@query("legacy_scores", with_ctes(
    "SELECT model, train_r2_mean AS train_r2_old, val_r2_mean AS val_r2_old, test_r2_mean AS test_r2_old, "
    "train_r2_mean - test_r2_mean AS overfit_gap_old FROM scores WHERE cv = 'random_5x5' AND feature_set = 'raw' "
    "ORDER BY model LIMIT 7", **Q.score_table_sql()))
def legacy_scores(spark, sf):
    """A3: write the legacy two-header-row sheet as headerless CSV, import it by position."""
    s = _legacy_rows(spark, sf)
    cells = [F.col("model")]
    for split in ("train", "val", "test"):
        cells += [F.col(f"{split}_mae_mean").cast("string"), (F.col(f"{split}_rmse_mean") ** 2).cast("string"),
                  F.col(f"{split}_rmse_mean").cast("string"), F.col(f"{split}_r2_mean").cast("string")]
        cells += [F.lit("")] * 4
    body = s.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    n = len(cells)
    head0 = [F.lit("Model")] + [F.lit(x) for split in ("Training", "Validation", "Testing") for x in [split] + [""] * 7]
    head1 = [F.lit("")] + [F.lit(x) for _ in range(3) for x in ["MAE", "MSE", "RMSE", "R2", "", "", "", ""]]
    spark_ = s.sparkSession
    hdr = spark_.range(2).coalesce(1).select(
        *[F.when(F.col("id") == 0, head0[i]).otherwise(head1[i]).alias(f"c{i}") for i in range(n)])
    path = scratch_dir(spark, "legacy")
    sheet = hdr.withColumn("__o", F.col("id").cast("int")).drop("id") if "id" in hdr.columns else hdr
    sheet = hdr.select("*", F.monotonically_increasing_id().alias("__o")).unionByName(body.withColumn("__o", F.lit(10)))
    sheet.orderBy("__o", "c0").coalesce(1).drop("__o").write.mode("overwrite").csv(path)
    raw = spark.read.option("header", False).csv(path)
    return R.legacy_positional(raw)


# ----------------------------------------------------------------------------- A4 / A5 / A6 / A8 / A9


@query("sink_tables", with_ctes(
    "SELECT 'scores' AS sheet, count(*) AS n_rows FROM scores UNION ALL "
    "SELECT 'champions', count(*) FROM (SELECT DISTINCT cv FROM scores WHERE abs(test_r2_mean) < 10) UNION ALL "
    "SELECT 'orders_by_priority', count(DISTINCT o_orderpriority) FROM orders", **Q.score_table_sql()))
def sink_tables(spark, sf):
    from mortar.operators import leaderboard as L
    s = score_table(spark, sf)
    tables = {"scores": s, "champions": L.pick_champions(s),
              "orders_by_priority": table(spark, sf, "orders").groupBy("o_orderpriority").count()}
    out = scratch_dir(spark, "sheets")
    R.write_tables(tables, out)
    back = R.read_tables(spark, out, list(tables))
    rows = [back[n].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("sheet"), "n_rows") for n in tables]
    from functools import reduce
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("sink_replace", with_ctes(
    "SELECT sheet, count(*) AS n_rows FROM (SELECT cv AS sheet FROM scores WHERE cv <> 'GroupKFold' UNION ALL "
    "SELECT 'GroupKFold' FROM scores WHERE cv = 'GroupKFold' AND feature_set = 'raw') GROUP BY sheet", **Q.score_table_sql()))
def sink_replace(spark, sf):
    s = score_table(spark, sf).withColumn("sheet", F.col("cv"))
    out = scratch_dir(spark, "replace")
    R.write_sheets_partitioned(s, out, replace=False)
    newer = s.where((F.col("cv") == "GroupKFold") & (F.col("feature_set") == "raw"))
    R.write_sheets_partitioned(newer, out, replace=True)
    return spark.read.parquet(out).groupBy("sheet").agg(F.count(F.lit(1)).alias("n_rows"))


@query("manifest", with_ctes(
    "SELECT r.model AS report_model, r.feature_set AS report_feature_set, r.test_r2_mean AS report_test_r2, "
    "a.model AS app_model, a.test_r2_mean AS app_test_r2, v.model AS v2_model, v.feature_set AS v2_feature_set "
    "FROM (SELECT * FROM champ WHERE cv = 'random_5x5') r, (SELECT * FROM champ WHERE cv = 'GroupKFold') a, "
    "(SELECT * FROM champ WHERE cv = 'SMOGN_random') v",
    **Q.score_table_sql(),
    champ="SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cv ORDER BY test_r2_mean DESC, model, feature_set) AS rn "
          "FROM scores WHERE abs(test_r2_mean) < 10) WHERE rn = 1"))
def manifest(spark, sf):
    """Write the nested manifest, merge the report_v2 key, read it back flattened."""
    from mortar.functions.features import ENGINEERED_12
    from mortar.operators import leaderboard as L
    ch = L.pick_champions(score_table(spark, sf))

    def entry(cv, score_name):
        return ch.where(F.col("cv") == cv).select(
            "model", "feature_set", F.col("test_r2_mean").alias(score_name),
            F.col("test_r2_std").alias(f"{score_name}_std"), "overfit_gap",
            F.array(*[F.lit(f) for f in ENGINEERED_12]).alias("features"))

    rep, app = entry("random_5x5", "cv_random_test_r2"), entry("GroupKFold", "cv_group_test_r2")
    m = rep.select(F.struct(*rep.columns).alias("report")).crossJoin(app.select(F.struct(*app.columns).alias("app")))
    path, out = scratch_dir(spark, "manifest"), scratch_dir(spark, "manifest-merged")
    R.write_manifest(m, path)
    v2 = entry("SMOGN_random", "cv_test_r2").withColumn("protocol", F.lit("SMOGN_random"))
    merged = R.merge_manifest(spark, path, "report_v2", v2, out)
    return merged.select(F.col("report.model").alias("report_model"), F.col("report.feature_set").alias("report_feature_set"),
                         F.col("report.cv_random_test_r2").alias("report_test_r2"), F.col("app.model").alias("app_model"),
                         F.col("app.cv_group_test_r2").alias("app_test_r2"), F.col("report_v2.model").alias("v2_model"),
                         F.col("report_v2.feature_set").alias("v2_feature_set"))


@query("combine_studies", with_ctes(
    "SELECT 'CS' AS study, substr('CS_' || cv || '_leaderboard_of_models', 1, 31) AS sheet, model, feature_set, test_r2_mean, "
    "NULL::DOUBLE AS gap FROM scores WHERE feature_set = 'engineered_12' UNION ALL "
    "SELECT 'SL', substr('SL_' || cv || '_leaderboard_of_models', 1, 31), model, feature_set, NULL::DOUBLE, overfit_gap "
    "FROM scores WHERE feature_set = 'raw'", **Q.score_table_sql()))
def combine_studies(spark, sf):
    s = score_table(spark, sf)
    cs = s.where(F.col("feature_set") == "engineered_12").select(
        R.sheet_name("CS_", F.concat(F.col("cv"), F.lit("_leaderboard_of_models"))).alias("sheet"),
        "model", "feature_set", "test_r2_mean")
    sl = s.where(F.col("feature_set") == "raw").select(
        R.sheet_name("SL_", F.concat(F.col("cv"), F.lit("_leaderboard_of_models"))).alias("sheet"),
        "model", "feature_set", F.col("overfit_gap").alias("gap"))
    return R.combine_studies({"CS": cs, "SL": sl})


@query("upsert_metrics", with_ctes(
    "SELECT coalesce(o.cv, n.cv) AS cv, coalesce(o.model, n.model) AS model, coalesce(n.val_r2, o.val_r2) AS val_r2, "
    "CASE WHEN o.model IS NULL THEN 'NOT FOUND' WHEN n.model IS NULL THEN 'kept' ELSE 'updated' END AS status "
    "FROM o FULL OUTER JOIN n ON o.cv = n.cv AND o.model = n.model", **Q.score_table_sql(),
    o="SELECT cv, model, max(val_r2_mean) AS val_r2 FROM scores WHERE cv = 'random_5x5' GROUP BY cv, model",
    n="SELECT cv, model, max(val_r2_mean) + 0.5 AS val_r2 FROM scores WHERE cv = 'random_5x5' AND model IN ('Ridge', 'KNN') "
      "GROUP BY cv, model UNION ALL SELECT 'random_5x5', 'NoSuchStack', 0.25"))
def upsert_metrics(spark, sf):
    s = score_table(spark, sf).where(F.col("cv") == "random_5x5")
    old = s.groupBy("cv", "model").agg(F.max("val_r2_mean").alias("val_r2"))
    new = old.where(F.col("model").isin("Ridge", "KNN")).withColumn("val_r2", F.col("val_r2") + F.lit(0.5))
    new = new.unionByName(spark.createDataFrame([("random_5x5", "NoSuchStack", 0.25)], "cv string, model string, val_r2 double"))
    return R.upsert(old, new, ["cv", "model"], ["val_r2"])
