"""Registered queries: contract (C1-C7) and split / fit / evaluate / score.

Each query has its DuckDB oracle next to it (``ORACLE``); the iterative fit (F2)
and the run summary (F7) have none and are checked by row count and unit tests.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from tabwatch.functions.core import join_small, round_floats
from tabwatch.operators import contract as C
from tabwatch.operators import learn as L
from tabwatch.plans.drift_queries import SCORE_COEFFICIENTS, SCORE_INTERCEPT, score_column
from tabwatch.session import materialize
from tabwatch.sources.tables import read_table

HASH_TABLES = {"customer": None, "orders": None, "lineitem": None, "labels": "quality"}
SCORE_VERSION = "v20240101_000000_a1b2c3"
#: What the run summary names as its code.
CODE_VERSION = "md5-split-newton"


# ------------------------------------------------------------------ contract
def c2_schema_hash(spark, sf):
    out = None
    for t, target in HASH_TABLES.items():
        df = read_table(spark, sf, t)
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(t).alias("table_name"),
            F.lit(len(C.structural_rows(df, target))).cast("long").alias("n_features"),
            "n_rows", C.schema_hash_column(df, target).alias("schema_hash"))
        out = row if out is None else out.unionByName(row)
    return out


def c3_describe_columns(spark, sf):
    return round_floats(C.describe_columns(read_table(spark, sf, "orders")))


def c4_validate_contract(spark, sf):
    """Supplier rows (renamed to the customer prefix) against the customer contract:
    schema errors, and columns with records that do not conform."""
    cust = read_table(spark, sf, "customer")
    sup = read_table(spark, sf, "supplier")
    sup = sup.select(*[F.col(c).alias("c_" + c[2:]) for c in sup.columns])
    # a tenth of the names are numbers in disguise, to be told from the contract's numbers
    sup = sup.withColumn("c_acctbal", F.when(F.col("c_suppkey") % 10 == 0, F.concat(F.lit("about "), F.col("c_acctbal").cast("string"))).otherwise(F.col("c_acctbal").cast("string")))
    contract = C.structural_schema(cust)
    schema = C.validate_contract(sup, contract, n_features=len(cust.columns))
    records = C.conforming_records(sup, contract).where("n_conforming < n_records")
    return schema.unionByName(records.select(F.lit("records").alias("error_type"), F.col("name").alias("column"),
                                             F.col("n_records").cast("string").alias("expected"), F.col("n_conforming").cast("string").alias("actual")))


def c5_check_records(spark, sf):
    """Event properties; every fiftieth event breaks each rule or sits at its limit."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_id") % 50
    names = (F.when(kind == 0, F.array().cast("array<string>"))
             .when(kind == 1, F.transform(F.sequence(F.lit(1), 90 + k % 30), lambda i: F.concat(F.lit("f"), i.cast("string"))))
             .when(kind == 2, F.array(F.repeat(F.lit("x"), 250 + k % 12)))
             .otherwise(F.map_keys(F.from_json("props", "map<string,double>"))))
    ev = read_table(spark, sf, "events").withColumn("features", F.map_from_arrays(names, F.transform(names, lambda n: F.lit(1.0))))
    return C.check_records(ev, "features").select("event_id", "n_features", "error")


def c6_check_batches(spark, sf):
    """A request per event with 25 instances for each unit of its property (0 to over 1000)."""
    k = F.get_json_object("props", "$.k").cast("int")
    n = k * 25
    inst = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    ev = read_table(spark, sf, "events").withColumn("instances", inst)
    return C.check_batch_arrays(ev, "instances").select(F.col("event_id").alias("batch"), "n_instances", "status")


def scoring_records(spark, sf):
    """Events as scoring requests ``k, value``; some of each forty break each rule."""
    k, v, kind = F.get_json_object("props", "$.k"), F.col("value").cast("string"), F.col("event_id") % 40
    name_k, name_v = F.lit("k"), F.lit("value")
    feats = (F.when(kind == 0, F.create_map(name_k, k, name_v, v, F.lit("extra"), F.lit("1")))
             .when(kind == 1, F.create_map(name_k, k))
             .when(kind == 2, F.create_map(name_k, F.concat(F.lit("x"), k), name_v, v))
             .when(kind == 3, F.create_map(name_k, k, name_v, F.lit("NaN")))
             .when(kind == 4, F.create_map(name_k, F.lit("Infinity"), name_v, v))
             .when(kind == 5, F.create_map(name_v, v, name_k, k))
             .otherwise(F.create_map(name_k, k, name_v, v)))
    return read_table(spark, sf, "events").withColumn("features", feats)


def c7_validate_for_scoring(spark, sf):
    out = C.validate_for_scoring(scoring_records(spark, sf), "features", ["k", "value"], strict=True)
    return out.select("event_id", "error_type", "invalid_features")


def c7_validate_batches(spark, sf):
    """The same records in requests of seven: one wrong record fails its request."""
    ev = scoring_records(spark, sf).withColumn("batch", F.floor(F.col("event_id") / 7))
    out = C.validate_batches(ev, "batch", "features", [("k", "int64"), ("value", "float64")])
    return out.select("event_id", "batch", "batch_error", "batch_features")


# --------------------------------------------------------------------- learn
def _lineitem_scored(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return score_column(li).withColumn("label", (F.col("l_returnflag") == "R").cast("int")).withColumn(
        "pred", (F.col("score") > 0.5).cast("int"))


def f1_stratified_split(spark, sf):
    lab = read_table(spark, sf, "labels")
    return L.stratified_split(lab.select("doc_id", "quality"), "quality", "doc_id")


def _doc_features(spark, sf):
    lab = read_table(spark, sf, "labels")
    doc = read_table(spark, sf, "documents")
    j = lab.join(doc.select("doc_id", "n_chars", "lang"), "doc_id")
    return j.select("doc_id", "quality", F.ln(F.col("n_chars") + 1.0).alias("log_chars"),
                    (F.col("lang") == "en").cast("double").alias("is_en"))


def f2_fit_logistic(spark, sf):
    d = _doc_features(spark, sf)
    feats = ["log_chars", "is_en"]
    m = L.fit_logistic(d, feats, "quality")
    b0, coefs = L.coefficients(m, feats)
    rows = [("intercept", b0)] + list(coefs.items())
    return round_floats(spark.createDataFrame(rows, "feature string, coefficient double"))


def f3_classification_metrics(spark, sf):
    return round_floats(L.classification_metrics(_lineitem_scored(spark, sf), "label", "pred"))


def f4_roc_auc(spark, sf):
    """Score rounded to 6 decimals first: tie groups then do not depend on the
    last ulp of ``exp``, which differs between engines."""
    s = _lineitem_scored(spark, sf).withColumn("score", F.round("score", 6))
    return round_floats(L.roc_auc(s, "label", "score"))


def f5_score(spark, sf):
    li = read_table(spark, sf, "lineitem")
    s = L.score(li, SCORE_INTERCEPT, SCORE_COEFFICIENTS, SCORE_VERSION)
    return round_floats(s.select("l_orderkey", "l_linenumber", "probability", "predicted_class", "model_version"))


def f6_pick_probability(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    ex = F.transform("embedding", lambda x: F.exp(x.cast("double")))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, x: a + x)
    probs = F.transform(ex, lambda x: x / tot)
    e = emb.select("vec_id", probs.alias("probs"))
    e = e.withColumn("predicted_class", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))
    return round_floats(e.select("vec_id", "predicted_class",
                                 L.pick_probability(F.col("probs"), F.col("predicted_class")).alias("probability")))


def f7_run_metadata(spark, sf):
    """Split, fit, score and evaluate, as one summary row (its duration left out, so runs compare)."""
    d = _doc_features(spark, sf)
    feats = ["log_chars", "is_en"]
    # the split is read by the fit, the scoring, the metrics and the counts:
    # write it once (as the reference keeps its split frames)
    split = materialize(L.stratified_split(d, "quality", "doc_id"))
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    m = L.fit_logistic(train, feats, "quality")
    b0, coefs = L.coefficients(m, feats)
    # rounded scores: tie groups then do not depend on the last digit
    scored = L.score(test, b0, coefs).withColumn("probability", F.round("probability", 6))
    metrics = join_small(L.classification_metrics(scored, "quality", "predicted_class"),
                         L.roc_auc(scored, "quality", "probability").select("roc_auc"))  # one row each
    counts = split.groupBy().agg(F.count(F.when(F.col("split") == "train", 1)).alias("a"),
                                 F.count(F.when(F.col("split") == "test", 1)).alias("b")).first()
    return round_floats(L.run_metadata(spark, "v20240101_000000_a1b2c3", "logistic_regression", metrics,
                                       counts["a"], counts["b"], feats, C.schema_hash(d, "quality"), code_version=CODE_VERSION))


QUERIES = {
    "c2_schema_hash": c2_schema_hash,
    "c3_describe_columns": c3_describe_columns,
    "c4_validate_contract": c4_validate_contract,
    "c5_check_records": c5_check_records,
    "c6_check_batches": c6_check_batches,
    "c7_validate_for_scoring": c7_validate_for_scoring,
    "c7_validate_batches": c7_validate_batches,
    "f1_stratified_split": f1_stratified_split,
    "f2_fit_logistic": f2_fit_logistic,
    "f3_classification_metrics": f3_classification_metrics,
    "f4_roc_auc": f4_roc_auc,
    "f5_score": f5_score,
    "f6_pick_probability": f6_pick_probability,
    "f7_run_metadata": f7_run_metadata,
}


# ===================================================================== oracle
_DTYPE = """CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT', 'HUGEINT') THEN 'int64'
    WHEN data_type IN ('DOUBLE', 'FLOAT', 'REAL') OR data_type LIKE 'DECIMAL%' THEN 'float64'
    WHEN data_type = 'BOOLEAN' THEN 'bool'
    WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'datetime64[ns]' ELSE 'object' END"""


def _cols_cte(tables: dict) -> str:
    parts = []
    for t, target in tables.items():
        excl = f" AND column_name <> '{target}'" if target else ""
        parts.append(f"""SELECT table_name, column_name, ordinal_position, {_DTYPE} AS dtype
            FROM information_schema.columns WHERE table_name = '{t}'{excl}""")
    body = " UNION ALL ".join(parts)
    return f"""SELECT table_name, column_name, dtype,
        row_number() OVER (PARTITION BY table_name ORDER BY ordinal_position) - 1 AS pos FROM ({body})"""


def o_c2() -> str:
    counts = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in HASH_TABLES)
    return f"""WITH cols AS ({_cols_cte(HASH_TABLES)}),
        h AS (SELECT table_name, count(*) AS n_features, substr(sha256('[' || string_agg(
            '{{"dtype": "' || dtype || '", "name": "' || column_name || '", "position": ' || CAST(pos AS VARCHAR) || '}}',
            ', ' ORDER BY pos) || ']'), 1, 32) AS schema_hash FROM cols GROUP BY table_name),
        n AS ({counts})
        SELECT table_name, n_features, n_rows, schema_hash FROM h JOIN n USING (table_name)"""


def o_c3() -> str:
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    numeric = {"o_orderkey", "o_custkey", "o_totalprice"}
    parts = []
    for c in cols:
        if c in numeric:
            v = f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END"
            parts.append(f"""SELECT '{c}' AS name, 'numeric' AS type, count(DISTINCT {c}) AS num_unique,
                count(*) - count({v}) AS num_missing, CAST(count(*) - count({v}) AS DOUBLE) / count(*) AS missing_rate,
                min({v}) AS min, max({v}) AS max, avg({v}) AS mean, stddev_samp({v}) AS std FROM orders""")
        else:
            parts.append(f"""SELECT '{c}' AS name, 'categorical' AS type, count(DISTINCT {c}) AS num_unique,
                count(*) - count({c}) AS num_missing, CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS missing_rate,
                CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean,
                CAST(NULL AS DOUBLE) AS std FROM orders""")
    return f"""WITH cols AS ({_cols_cte({'orders': None})}), s AS ({' UNION ALL '.join(parts)})
        SELECT s.name, CAST(c.pos AS INTEGER) AS position, c.dtype, s.type, CAST(s.num_unique AS BIGINT) AS num_unique,
            CAST(s.num_missing AS BIGINT) AS num_missing, round(s.missing_rate, 6) AS missing_rate,
            round(s.min, 6) AS min, round(s.max, 6) AS max, round(s.mean, 6) AS mean, round(s.std, 6) AS std
        FROM s JOIN cols c ON c.column_name = s.name"""


def o_c4() -> str:
    return f"""WITH e AS ({_cols_cte({'customer': None})}),
        a0 AS (SELECT replace(column_name, 's_', 'c_') AS column_name, dtype, pos FROM ({_cols_cte({'supplier': None})})),
        a AS (SELECT column_name, CASE WHEN column_name = 'c_acctbal' THEN 'object' ELSE dtype END AS dtype, pos FROM a0),
        en AS (SELECT string_agg(column_name, ',' ORDER BY pos) AS names, count(*) AS n FROM e),
        an AS (SELECT string_agg(column_name, ',' ORDER BY pos) AS names, count(*) AS n FROM a),
        r AS (SELECT count(*) AS n, count(s_name) AS c_name, count(s_nationkey) AS c_nationkey,
              count(CASE WHEN s_suppkey % 10 <> 0 THEN s_acctbal END) AS c_acctbal FROM supplier)
        SELECT 'feature_count' AS error_type, CAST(NULL AS VARCHAR) AS "column", CAST(en.n AS VARCHAR) AS expected,
               CAST(an.n AS VARCHAR) AS actual FROM en, an WHERE en.n <> an.n
        UNION ALL SELECT 'feature_names', NULL, en.names, an.names FROM en, an WHERE en.names <> an.names
        UNION ALL SELECT 'dtype', e.column_name, e.dtype, a.dtype FROM e JOIN a USING (column_name) WHERE e.dtype <> a.dtype
        UNION ALL SELECT 'records', c, CAST(n AS VARCHAR), CAST(x AS VARCHAR) FROM (
            SELECT n, 'c_custkey' AS c, 0 AS x FROM r UNION ALL SELECT n, 'c_mktsegment', 0 FROM r
            UNION ALL SELECT n, 'c_name', c_name FROM r UNION ALL SELECT n, 'c_nationkey', c_nationkey FROM r
            UNION ALL SELECT n, 'c_acctbal', c_acctbal FROM r) WHERE x < n"""


def o_c5() -> str:
    return """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props FROM events),
        f AS (SELECT event_id, CASE event_id % 50 WHEN 0 THEN [] WHEN 1 THEN list_transform(range(1, 91 + k % 30), lambda i: 'f' || i)
              WHEN 2 THEN [repeat('x', CAST(250 + k % 12 AS INTEGER))] ELSE json_keys(props) END AS names FROM e)
        SELECT event_id, CAST(coalesce(len(names), 0) AS INTEGER) AS n_features,
        CASE WHEN names IS NULL OR len(names) = 0 THEN 'empty_features'
             WHEN len(names) > 100 THEN 'too_many_features'
             WHEN len(list_filter(names, lambda k: length(k) > 256)) > 0 THEN 'feature_name_too_long'
        END AS error FROM f"""


def o_c6() -> str:
    return """SELECT event_id AS batch, n AS n_instances,
        CASE WHEN n < 1 THEN 'empty' WHEN n > 1000 THEN 'too_large' ELSE 'ok' END AS status
        FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) * 25 AS n FROM events)"""


def o_c7() -> str:
    return """SELECT event_id,
        CASE event_id % 40 WHEN 0 THEN 'schema' WHEN 1 THEN 'schema' WHEN 2 THEN 'invalid_value'
             WHEN 3 THEN 'non_finite' WHEN 4 THEN 'non_finite' WHEN 5 THEN 'schema' END AS error_type,
        CASE event_id % 40 WHEN 0 THEN 'extra' WHEN 1 THEN 'value' WHEN 2 THEN 'k'
             WHEN 3 THEN 'value' WHEN 4 THEN 'k' WHEN 5 THEN 'value,k' END AS invalid_features FROM events"""


def o_c7_batches() -> str:
    return """WITH e AS (SELECT event_id, event_id // 7 AS batch, event_id % 40 AS kind FROM events),
        g AS (SELECT batch, bool_or(kind = 0) AS extra, bool_and(kind = 1) AS lacking, bool_or(kind = 5) AS misplaced, bool_or(kind = 2) AS worded,
              bool_or(kind = 4) AS infinite, bool_or(kind IN (1, 3)) AS missing FROM e GROUP BY batch)
        SELECT event_id, batch,
            CASE WHEN extra OR lacking OR misplaced THEN 'schema' WHEN worded OR infinite THEN 'dtype' WHEN missing THEN 'non_finite' END AS batch_error,
            CASE WHEN extra THEN 'extra' WHEN lacking THEN 'value' WHEN misplaced THEN 'order' WHEN worded THEN 'k:object'
                 WHEN infinite THEN 'k:float64' WHEN missing THEN 'value' END AS batch_features
        FROM e JOIN g USING (batch)"""


def o_f1() -> str:
    return """WITH per AS (SELECT quality, count(*) AS n_class FROM labels GROUP BY quality),
        t AS (SELECT *, sum(n_class) OVER () AS n FROM per),
        t2 AS (SELECT *, n - ceil(CAST(0.2 AS DOUBLE) * n) AS ntrain FROM t),
        t3 AS (SELECT *, ntrain * n_class / n AS ex, floor(ntrain * n_class / n) AS fl FROM t2),
        t4 AS (SELECT *, ex - fl AS frac, ntrain - sum(fl) OVER () AS lft FROM t3),
        t5 AS (SELECT *, row_number() OVER (ORDER BY frac DESC, quality ASC) AS r FROM t4),
        q AS (SELECT quality, fl + CASE WHEN r <= lft THEN 1 ELSE 0 END AS n_train FROM t5),
        rk AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality
               ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM labels)
        SELECT doc_id, quality, CASE WHEN rn <= n_train THEN 'train' ELSE 'test' END AS split
        FROM rk JOIN q USING (quality)"""


NEWTON_STEPS = 14
_DOCS = """SELECT doc_id, quality, ln(n_chars + 1.0) AS log_chars, CASE WHEN lang = 'en' THEN CAST(1 AS DOUBLE)
    WHEN lang IS NOT NULL THEN CAST(0 AS DOUBLE) END AS is_en FROM labels JOIN documents USING (doc_id)"""


def _newton_sql(src: str) -> list[str]:
    """CTEs of Newton steps for an intercept and two penalised weights, each step solved by
    Cramer's rule; the last is ``fit``."""
    ctes = ["w0 AS MATERIALIZED (SELECT CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2)"]
    for k in range(NEWTON_STEPS):
        ctes.append(f"""s{k} AS MATERIALIZED (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2,
            sum(y - p) AS g0, sum((y - p) * x1) - any_value(b1) AS g1, sum((y - p) * x2) - any_value(b2) AS g2, sum(v) AS a, sum(v * x1) AS b, sum(v * x2) AS c,
            sum(v * x1 * x1) + 1 AS d, sum(v * x1 * x2) AS e, sum(v * x2 * x2) + 1 AS f
            FROM (SELECT *, p * (1 - p) AS v FROM (SELECT quality AS y, log_chars AS x1, is_en AS x2, w.*,
                1 / (1 + exp(-(b0 + b1 * log_chars + b2 * is_en))) AS p FROM {src} CROSS JOIN w{k} w)))""")
        ctes.append(f"""w{k + 1} AS MATERIALIZED (SELECT b0 + (g0 * (d * f - e * e) - b * (g1 * f - e * g2) + c * (g1 * e - d * g2)) / det AS b0,
            b1 + (a * (g1 * f - g2 * e) - g0 * (b * f - e * c) + c * (b * g2 - g1 * c)) / det AS b1,
            b2 + (a * (d * g2 - e * g1) - b * (b * g2 - g1 * c) + g0 * (b * e - d * c)) / det AS b2
            FROM (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM s{k}))""")
    return [*ctes, f"fit AS (SELECT * FROM w{NEWTON_STEPS})"]


def o_f2() -> str:
    ctes = ", ".join([f"d AS MATERIALIZED ({_DOCS})", *_newton_sql("d")])
    return f"""WITH {ctes} SELECT 'intercept' AS feature, round(b0, 6) AS coefficient FROM fit
        UNION ALL SELECT 'log_chars', round(b1, 6) FROM fit UNION ALL SELECT 'is_en', round(b2, 6) FROM fit"""


def o_f7() -> str:
    split = o_f1().replace("FROM labels", "FROM d").removeprefix("WITH ")
    split_ctes, final = split.rsplit("\n        SELECT doc_id", 1)
    hash_json = '[{"dtype": "int64", "name": "doc_id", "position": 0}, {"dtype": "float64", "name": "log_chars", "position": 1}, {"dtype": "float64", "name": "is_en", "position": 2}]'
    ctes = ", ".join([
        f"d AS MATERIALIZED ({_DOCS})", split_ctes, f"sp AS MATERIALIZED (SELECT d.*, split FROM d JOIN (SELECT doc_id{final}) USING (doc_id))",
        "tr AS MATERIALIZED (SELECT * FROM sp WHERE split = 'train')", *_newton_sql("tr"),
        """sc AS (SELECT quality AS y, 1 / (1 + exp(-(b0 + b1 * CAST(CAST(log_chars AS FLOAT) AS DOUBLE) + b2 * CAST(CAST(is_en AS FLOAT) AS DOUBLE)))) AS p0
            FROM sp CROSS JOIN fit WHERE split = 'test')""",
        "sc2 AS MATERIALIZED (SELECT y, round(p0, 6) AS p, CASE WHEN p0 > 0.5 THEN 1 ELSE 0 END AS c FROM sc)",
        """m AS (SELECT count(*) FILTER (y = 1 AND c = 1) AS tp, count(*) FILTER (y = 0 AND c = 1) AS fp,
            count(*) FILTER (y = 1 AND c = 0) AS fn, count(*) FILTER (y = 0 AND c = 0) AS tn FROM sc2)""",
        "g AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM sc2 GROUP BY p)",
        "u AS (SELECT pos * (sum(neg) OVER (ORDER BY p) - neg + neg / 2.0) AS part FROM g)"])
    return f"""WITH {ctes}
        SELECT 'v20240101_000000_a1b2c3' AS model_version, 'logistic_regression' AS model_type, 'spark' AS framework, 'coefficients' AS format,
            (SELECT count(*) FROM tr) AS training_samples, (SELECT count(*) FROM sp WHERE split = 'test') AS test_samples, CAST(2 AS BIGINT) AS n_features,
            'log_chars,is_en' AS feature_names, CAST({L.C_INVERSE_REG} AS DOUBLE) AS "C", CAST({L.MAX_ITER} AS BIGINT) AS max_iter,
            substr(sha256('{hash_json}'), 1, 32) AS schema_hash, 'training_pipeline' AS created_by, '{CODE_VERSION}' AS code_version, tp, fp, fn, tn,
            round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
            round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
            round((SELECT sum(part) FROM u) / ((tp + fn) * CAST(fp + tn AS DOUBLE)), 6) AS roc_auc FROM m"""


def _score_sql(float32: bool = False) -> str:
    lin = f"CAST({SCORE_INTERCEPT!r} AS DOUBLE)"
    for c, b in SCORE_COEFFICIENTS.items():
        x = f"CAST(CAST({c} AS FLOAT) AS DOUBLE)" if float32 else c
        lin = f"({lin} + CAST({b!r} AS DOUBLE) * {x})"
    return f"(1.0 / (1.0 + exp(-{lin})))"


def _li_scored() -> str:
    return f"""SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS label,
        CAST({_score_sql()} > 0.5 AS INTEGER) AS pred, {_score_sql()} AS score FROM lineitem"""


def o_f3() -> str:
    return f"""WITH s AS ({_li_scored()}),
        c AS (SELECT count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
                     count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn FROM s)
        SELECT tp, fp, fn, tn,
            round(coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0), 0.0), 6) AS accuracy,
            round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0), 6) AS precision,
            round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0), 6) AS recall,
            round(coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM c"""


def o_f4() -> str:
    return f"""WITH s AS ({_li_scored()}),
        g AS (SELECT round(score, 6) AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
              FROM s GROUP BY round(score, 6)),
        c AS (SELECT *, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS negc FROM g)
        SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
            round(sum(pos * ((negc - neg) + neg / 2.0)) / nullif(CAST(sum(pos) * sum(neg) AS DOUBLE), 0), 6) AS roc_auc FROM c"""


def o_f5() -> str:
    return f"""SELECT l_orderkey, l_linenumber, round({_score_sql(True)}, 6) AS probability,
        CASE WHEN {_score_sql(True)} > 0.5 THEN 1 ELSE 0 END AS predicted_class,
        '{SCORE_VERSION}' AS model_version FROM lineitem"""


def o_f6() -> str:
    return """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))) AS ex FROM embeddings),
        p AS (SELECT vec_id, list_transform(ex, lambda x: x / list_sum(ex)) AS probs FROM e),
        c AS (SELECT vec_id, probs, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS predicted_class FROM p)
        SELECT vec_id, predicted_class,
            round(CASE WHEN len(probs) = 2 THEN probs[2] ELSE probs[predicted_class + 1] END, 6) AS probability FROM c"""


ORACLE = {
    "c2_schema_hash": o_c2,
    "c3_describe_columns": o_c3,
    "c4_validate_contract": o_c4,
    "c5_check_records": o_c5,
    "c6_check_batches": o_c6,
    "c7_validate_for_scoring": o_c7,
    "f1_stratified_split": o_f1,
    "c7_validate_batches": o_c7_batches,
    "f2_fit_logistic": o_f2,
    "f7_run_metadata": o_f7,
    "f3_classification_metrics": o_f3,
    "f4_roc_auc": o_f4,
    "f5_score": o_f5,
    "f6_pick_probability": o_f6,
}
