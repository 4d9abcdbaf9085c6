"""DuckDB oracle SQL for ``plans.drift_queries`` (same names, same columns).

Built from CTE fragments; every float is rounded to 6 decimals like the Spark side.
"""

from __future__ import annotations

import math

from tabwatch.plans.drift_queries import (
    EXACT_LAST, EXACT_SPLIT, LINEITEM_CATEGORICAL, LINEITEM_NUMERIC, LINEITEM_SPLIT, ORDERS_CATEGORICAL, ORDERS_SPLIT,
    SCORE_COEFFICIENTS, SCORE_INTERCEPT,
)

EPS = "CAST(1e-10 AS DOUBLE)"
KS_TERMS = 100
KS_SWITCH = 1.18


def with_(ctes: list[tuple[str, str]], final: str) -> str:
    seen, parts = set(), []
    for name, body in ctes:
        if name in seen:
            continue
        seen.add(name)
        parts.append(f"{name} AS ({body})")
    return "WITH " + ",\n".join(parts) + "\n" + final


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def long_sql(src: str, feats: list[str], keep_null: bool = False, string: bool = False) -> str:
    if string:
        parts = [f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS v FROM {src}" for f in feats]
    else:
        parts = [
            f"SELECT '{f}' AS feature, CASE WHEN isnan(CAST({f} AS DOUBLE)) THEN NULL ELSE CAST({f} AS DOUBLE) END AS v FROM {src}"
            for f in feats
        ]
    body = " UNION ALL ".join(parts)
    return body if keep_null else f"SELECT * FROM ({body}) WHERE v IS NOT NULL"


def li_halves() -> list[tuple[str, str]]:
    return [
        ("li_base", f"SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{LINEITEM_SPLIT}'"),
        ("li_cur", f"SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{LINEITEM_SPLIT}'"),
    ]


def numeric_profile_ctes(name: str, src: str, feats: list[str]) -> list[tuple[str, str]]:
    return [
        (f"{name}_long", long_sql(src, feats, keep_null=True)),
        (name, f"""SELECT feature, count(*) AS n_rows, count(v) AS n, round(avg(v), 6) AS mean,
            round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
            round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
            round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.95), 6) AS p95,
            round(avg(CASE WHEN v IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS missing_rate
            FROM {name}_long GROUP BY feature"""),
    ]


def li_profile() -> list[tuple[str, str]]:
    return li_halves() + numeric_profile_ctes("prof", "li_base", LINEITEM_NUMERIC) + [
        ("cur_long", long_sql("li_cur", LINEITEM_NUMERIC)),
    ]


def edge_hist_ctes(prof: str, cur: str, name: str) -> list[tuple[str, str]]:
    """Quartile edges of ``prof`` and the histogram of ``cur`` on them."""
    return [
        (f"{name}_edges", f"""SELECT feature, coalesce(min, 0.0) AS e0, coalesce(p25, 0.0) AS e1,
            coalesce(p50, 0.0) AS e2, coalesce(p75, 0.0) AS e3, coalesce(max, 1.0) AS e4
            FROM {prof} WHERE coalesce(p25, p50, p75, p95) IS NOT NULL"""),
        (f"{name}_cb", f"""SELECT l.feature, CASE WHEN l.v < e.e0 OR l.v > e.e4 THEN NULL ELSE
            least(CAST(l.v >= e.e0 AS INTEGER) + CAST(l.v >= e.e1 AS INTEGER) + CAST(l.v >= e.e2 AS INTEGER)
                  + CAST(l.v >= e.e3 AS INTEGER) + CAST(l.v >= e.e4 AS INTEGER) - 1, 3) END AS bin
            FROM {cur} l JOIN {name}_edges e USING (feature)"""),
        (f"{name}_cnt", f"SELECT feature, bin, count(*) AS c FROM {name}_cb WHERE bin IS NOT NULL GROUP BY feature, bin"),
        (name, f"""SELECT e.feature, CAST(b.range AS INTEGER) AS bin,
            CAST(CASE WHEN e.e0 <= e.e1 AND e.e1 <= e.e2 AND e.e2 <= e.e3 AND e.e3 <= e.e4
                 THEN coalesce(c.c, 0) END AS BIGINT) AS count
            FROM {name}_edges e CROSS JOIN range(0, 4) b
            LEFT JOIN {name}_cnt c ON c.feature = e.feature AND c.bin = b.range"""),
    ]


def psi_ctes(bins: str, name: str, expected: str = "expected") -> list[tuple[str, str]]:
    return [
        (f"{name}_tot", f"""SELECT feature, sum(CAST(count AS DOUBLE)) AS a_tot, sum(CAST({expected} AS DOUBLE)) AS e_tot,
            count(*) FILTER (WHERE count IS NULL OR {expected} IS NULL) AS bad FROM {bins} GROUP BY feature"""),
        (f"{name}_terms", f"""SELECT b.feature,
            greatest(CASE WHEN t.a_tot = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST(b.count AS DOUBLE) / t.a_tot END, {EPS}) AS a,
            greatest(CASE WHEN t.e_tot = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST(b.{expected} AS DOUBLE) / t.e_tot END, {EPS}) AS e,
            t.bad FROM {bins} b JOIN {name}_tot t USING (feature)"""),
        (name, f"""SELECT feature, CASE WHEN max(bad) = 0 THEN sum((a - e) * ln(a / e)) END AS psi
            FROM {name}_terms GROUP BY feature"""),
    ]


def kolmogorov_sql(lam: str) -> str:
    alt = (f"2.0 * list_sum(list_transform(range(1, {KS_TERMS + 1}), lambda k: "
           f"(CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * ({lam}) * ({lam}))))")
    theta = (f"1.0 - {dbl(math.sqrt(2.0 * math.pi))} / ({lam}) * list_sum(list_transform(range(1, {KS_TERMS + 1}), "
             f"lambda k: exp(-((2 * k - 1) * (2 * k - 1)) * {dbl(math.pi * math.pi)} / (8.0 * ({lam}) * ({lam})))))")
    q = (f"CASE WHEN ({lam}) IS NULL THEN NULL WHEN ({lam}) <= 0 THEN 1.0 "
         f"WHEN ({lam}) >= {KS_SWITCH} THEN {alt} ELSE {theta} END")
    return f"greatest(least({q}, 1.0), 0.0)"


def ks_ctes(a: str, b: str, name: str) -> list[tuple[str, str]]:
    return [
        (f"{name}_u", f"SELECT feature, v, 1 AS s FROM {a} UNION ALL SELECT feature, v, 2 AS s FROM {b}"),
        (f"{name}_cnt", f"""SELECT feature, v, count(*) FILTER (WHERE s = 1) AS c1, count(*) FILTER (WHERE s = 2) AS c2
            FROM {name}_u GROUP BY feature, v"""),
        (f"{name}_cum", f"""SELECT feature, v,
            sum(c1) OVER (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c1c,
            sum(c2) OVER (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c2c,
            sum(c1) OVER (PARTITION BY feature) AS n1, sum(c2) OVER (PARTITION BY feature) AS n2
            FROM {name}_cnt"""),
        (f"{name}_d", f"""SELECT feature, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
            max(abs(CAST(c1c AS DOUBLE) / n1 - CAST(c2c AS DOUBLE) / n2)) AS ks_statistic
            FROM {name}_cum WHERE n1 > 0 AND n2 > 0 GROUP BY feature, n1, n2"""),
        (name, f"""SELECT feature, n1, n2, ks_statistic,
            {kolmogorov_sql('ks_statistic * sqrt(CAST(n1 AS DOUBLE) * n2 / CAST(n1 + n2 AS DOUBLE))')} AS ks_pvalue
            FROM {name}_d"""),
    ]


def md5_uniform(seed: str) -> str:
    return f"((CAST(('0x' || substr(md5({seed}), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0)"


def sample_ctes(prof: str, name: str, n: int = 10000) -> list[tuple[str, str]]:
    base = "p.feature || '-42-' || CAST(d.range AS VARCHAR)"
    u1 = md5_uniform(f"{base} || '-1'")
    u2 = md5_uniform(f"{base} || '-2'")
    raw = (f"coalesce(p.mean, 0.0) + coalesce(p.std, 1.0) * (sqrt(-2.0 * ln({u1})) * "
           f"cos({dbl(2.0 * math.pi)} * {u2}))")
    return [(name, f"""SELECT p.feature, d.range AS draw,
        least(greatest({raw}, coalesce(p.min, CAST('-inf' AS DOUBLE))), coalesce(p.max, CAST('inf' AS DOUBLE))) AS v
        FROM {prof} p CROSS JOIN range(0, {n}) d""")]


def cat_profile_ctes(name: str, src: str, feats: list[str], k: int = 10, rounded: bool = True) -> list[tuple[str, str]]:
    share = "CAST(count AS DOUBLE) / n"
    share = f"round({share}, 6)" if rounded else share
    return [
        (f"{name}_long", long_sql(src, feats, keep_null=True, string=True)),
        (f"{name}_tot", f"""SELECT feature, count(v) AS n,
            avg(CASE WHEN v IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS missing_rate
            FROM {name}_long GROUP BY feature"""),
        (f"{name}_cnt", f"SELECT feature, v AS category, count(*) AS count FROM {name}_long WHERE v IS NOT NULL GROUP BY feature, v"),
        (f"{name}_uniq", f"SELECT feature, count(*) AS n_unique FROM {name}_cnt GROUP BY feature"),
        (f"{name}_rank", f"""SELECT *, row_number() OVER (PARTITION BY feature ORDER BY count DESC, category ASC) AS rank
            FROM {name}_cnt"""),
        (name, f"""SELECT feature, category, count, {share} AS share,
            CAST(rank AS INTEGER) AS rank, n_unique, n, round(missing_rate, 6) AS missing_rate
            FROM {name}_rank JOIN {name}_tot USING (feature) JOIN {name}_uniq USING (feature) WHERE rank <= {k}"""),
    ]


def chi_ctes(cur_long: str, prof: str, name: str) -> list[tuple[str, str]]:
    return [
        (f"{name}_obs", f"SELECT feature, v AS category, count(*) AS o FROM {cur_long} GROUP BY feature, v"),
        (f"{name}_n", f"SELECT feature, sum(o) AS n FROM {name}_obs GROUP BY feature"),
        (f"{name}_feats", f"SELECT f.feature, n.n FROM (SELECT DISTINCT feature FROM {prof}) f JOIN {name}_n n USING (feature)"),
        (f"{name}_cells", f"""SELECT f.feature, coalesce(p.share, 0.0) * f.n AS e, CAST(coalesce(o.o, 0) AS DOUBLE) AS o
            FROM (SELECT o.* FROM {name}_obs o JOIN {name}_feats USING (feature)) o
            FULL OUTER JOIN (SELECT feature, category, share FROM {prof}) p
              ON o.feature = p.feature AND o.category = p.category
            JOIN {name}_feats f ON f.feature = coalesce(o.feature, p.feature)"""),
        (f"{name}_agg", f"""SELECT feature, count(*) AS k, sum(o) AS observed_total, sum(e) AS expected_total,
            sum((o - e) * (o - e) / e) AS stat FROM {name}_cells WHERE e > 0 GROUP BY feature"""),
        (name, f"""SELECT feature, CAST(k AS BIGINT) AS k, observed_total, expected_total,
            CASE WHEN k > 1 AND abs(observed_total - expected_total) / least(observed_total, expected_total) <= 1e-8
                 THEN stat END AS chi2_statistic,
            CAST(k - 1 AS BIGINT) AS dof,
            CASE WHEN k <= 1 THEN 'too_few_categories'
                 WHEN abs(observed_total - expected_total) / least(observed_total, expected_total) > 1e-8 THEN 'sum_mismatch'
                 ELSE 'ok' END AS status
            FROM {name}_agg"""),
    ]


def score_expr(src_alias: str = "") -> str:
    p = f"{src_alias}." if src_alias else ""
    lin = dbl(SCORE_INTERCEPT)
    for c, b in SCORE_COEFFICIENTS.items():
        lin = f"({lin} + {dbl(b)} * {p}{c})"
    return f"(1.0 / (1.0 + exp(-{lin})))"


def hist20_ctes(src: str, col: str, name: str, bins: int = 20) -> list[tuple[str, str]]:
    step = f"((r.hi - r.lo) / {dbl(float(bins))})"

    def edge(i: str) -> str:
        return f"(CASE WHEN {i} = {bins} THEN r.hi ELSE r.lo + CAST({i} AS DOUBLE) * {step} END)"

    return [
        (f"{name}_r0", f"SELECT min({col}) AS mn, max({col}) AS mx FROM {src} WHERE {col} IS NOT NULL AND NOT isnan({col})"),
        (f"{name}_r", f"""SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
            CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM {name}_r0"""),
        (f"{name}_i0", f"""SELECT s.{col} AS v, r.lo, r.hi,
            least(CAST(floor((s.{col} - r.lo) * ({dbl(float(bins))} / (r.hi - r.lo))) AS INTEGER), {bins - 1}) AS i0
            FROM {src} s CROSS JOIN {name}_r r WHERE s.{col} IS NOT NULL AND NOT isnan(s.{col})"""),
        (f"{name}_i1", f"""SELECT v, lo, hi, CASE WHEN v < {edge('i0').replace('r.', '')} THEN i0 - 1 ELSE i0 END AS i1
            FROM {name}_i0"""),
        (f"{name}_i2", f"""SELECT CASE WHEN v >= {edge('(i1 + 1)').replace('r.', '')} AND i1 <> {bins - 1} THEN i1 + 1 ELSE i1 END AS bin
            FROM {name}_i1"""),
        (f"{name}_cnt", f"SELECT bin, count(*) AS c FROM {name}_i2 GROUP BY bin"),
        (name, f"""SELECT CAST(b.range AS INTEGER) AS bin, {edge('b.range')} AS lo, {edge('(b.range + 1)')} AS hi,
            CAST(coalesce(c.c, 0) AS BIGINT) AS count
            FROM {name}_r r CROSS JOIN range(0, {bins}) b LEFT JOIN {name}_cnt c ON c.bin = b.range"""),
    ]


def r6_all(cols: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# -------------------------------------------------------------------- queries
def q_d1() -> str:
    return with_(numeric_profile_ctes("prof", "lineitem", LINEITEM_NUMERIC), "SELECT * FROM prof")


def q_d2() -> str:
    return with_(cat_profile_ctes("cp", "part", ["p_brand", "p_type"]), "SELECT * FROM cp")


def q_d3() -> str:
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    parts = [f"""SELECT '{c}' AS "column", count(*) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS n_missing,
        round(CAST(count(*) - count({c}) AS DOUBLE) / count(*), 6) AS missing_rate FROM documents""" for c in cols]
    return " UNION ALL ".join(parts)


def score_base_ctes() -> list[tuple[str, str]]:
    return li_halves() + [
        ("sb", f"SELECT {score_expr()} AS score FROM li_base"),
        ("sc", f"SELECT {score_expr()} AS score FROM li_cur"),
    ]


def score_all_ctes() -> list[tuple[str, str]]:
    return [("sb", f"SELECT {score_expr()} AS score FROM lineitem")]


def q_d5() -> str:
    return with_(score_all_ctes(), """SELECT count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std,
        round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS p50,
        round(quantile_cont(score, 0.75), 6) AS p75, round(quantile_cont(score, 0.95), 6) AS p95 FROM sb""")


def q_d6() -> str:
    return with_(score_all_ctes() + hist20_ctes("sb", "score", "h"),
                 "SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, count FROM h")


def q_d7() -> str:
    return """WITH ex AS (SELECT generate_subscripts(embedding, 1) - 1 AS class_idx, unnest(embedding) AS p FROM embeddings),
        per AS (SELECT class_idx, count(p) AS n, avg(CAST(p AS DOUBLE)) AS mean, stddev_pop(CAST(p AS DOUBLE)) AS std
                FROM ex GROUP BY class_idx)
        SELECT CAST(class_idx AS INTEGER) AS class_idx, n, round(mean, 6) AS mean, round(std, 6) AS std,
               CAST(max(class_idx) OVER () + 1 AS INTEGER) AS n_classes FROM per"""


def q_d8() -> str:
    feats = ["c_acctbal", "c_nationkey", "c_custkey"]
    return with_([("l", long_sql("customer", feats))], """SELECT feature, count(*) AS count, round(avg(v), 6) AS mean,
        round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q25,
        round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS max
        FROM l GROUP BY feature""")


def q_d9() -> str:
    return """SELECT o_orderpriority AS value, count(*) AS count,
        round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share
        FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority"""


def q_d4() -> str:
    stats = ["mean", "std", "min", "max", "p25", "p50", "p75", "p95", "missing_rate"]
    num_rows = " UNION ALL ".join(
        f"SELECT 'numeric' AS section, feature, '{s}' AS stat, CAST({s} AS DOUBLE) AS value FROM np" for s in stats)
    pstats = ["mean", "std", "p25", "p50", "p75", "p95"]
    pred_rows = " UNION ALL ".join(
        f"SELECT 'prediction' AS section, 'score' AS feature, '{s}' AS stat, {s} AS value FROM sp" for s in pstats)
    ctes = ([("npl", long_sql("lineitem", LINEITEM_NUMERIC, keep_null=True))]
            + [("np", """SELECT feature, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max,
                quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75,
                quantile_cont(v, 0.95) AS p95,
                avg(CASE WHEN v IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS missing_rate
                FROM npl GROUP BY feature""")]
            + cat_profile_ctes("cp", "lineitem", LINEITEM_CATEGORICAL)
            + [("sb", f"SELECT {score_expr()} AS score FROM lineitem"),
               ("sp", """SELECT avg(score) AS mean, stddev_pop(score) AS std, quantile_cont(score, 0.25) AS p25,
                quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.75) AS p75, quantile_cont(score, 0.95) AS p95 FROM sb""")]
            + hist20_ctes("sb", "score", "h"))
    final = f"""SELECT section, feature, stat, round(value, 6) AS value FROM (
        SELECT 'dataset' AS section, '' AS feature, 'n_samples' AS stat, CAST(count(*) AS DOUBLE) AS value FROM lineitem
        UNION ALL {num_rows}
        UNION ALL SELECT 'categorical', feature, 'share:' || category, share FROM cp
        UNION ALL SELECT DISTINCT 'categorical', feature, 'n_unique', CAST(n_unique AS DOUBLE) FROM cp
        UNION ALL SELECT DISTINCT 'categorical', feature, 'missing_rate', missing_rate FROM cp
        UNION ALL {pred_rows}
        UNION ALL SELECT 'prediction', 'score', 'count:' || lpad(CAST(bin AS VARCHAR), 2, '0'), CAST(count AS DOUBLE) FROM h)"""
    return with_(ctes, final)


def q_e1() -> str:
    return with_(li_profile() + edge_hist_ctes("prof", "cur_long", "eh"), "SELECT * FROM eh")


def numeric_psi_ctes() -> list[tuple[str, str]]:
    return (li_profile() + edge_hist_ctes("prof", "cur_long", "eh")
            + [("eh_x", "SELECT *, 0.25 AS expected FROM eh")]
            + psi_ctes("eh_x", "psi")
            + [("rate", """SELECT a.feature, 1.0 - CAST(i.n_in AS DOUBLE) / a.n_all AS out_of_range_rate
                FROM (SELECT feature, count(*) AS n_all FROM cur_long GROUP BY feature) a
                JOIN (SELECT feature, sum(count) AS n_in FROM eh GROUP BY feature) i USING (feature)""")])


def q_e3() -> str:
    return with_(numeric_psi_ctes(), """SELECT feature, round(psi, 6) AS psi, round(out_of_range_rate, 6) AS out_of_range_rate
        FROM psi LEFT JOIN rate USING (feature)""")


def q_e3_observed() -> str:
    ctes = (li_profile() + [("base_long", long_sql("li_base", LINEITEM_NUMERIC))]
            + edge_hist_ctes("prof", "cur_long", "eh") + edge_hist_ctes("prof", "base_long", "ebh")
            + [("bins", """SELECT c.feature, c.bin, c.count, b.count AS expected FROM eh c
                JOIN ebh b ON b.feature = c.feature AND b.bin = c.bin""")]
            + psi_ctes("bins", "psi"))
    return with_(ctes, "SELECT feature, round(psi, 6) AS psi FROM psi")


def mean_shift_ctes() -> list[tuple[str, str]]:
    return li_profile() + [("ms", """SELECT c.feature, abs(avg(c.v) - coalesce(any_value(p.mean), 0.0)) AS mean_shift
        FROM cur_long c JOIN prof p USING (feature) GROUP BY c.feature""")]


def q_e6() -> str:
    return with_(mean_shift_ctes(), "SELECT feature, round(mean_shift, 6) AS mean_shift FROM ms")


def q_e12_numeric() -> str:
    ctes = numeric_psi_ctes() + mean_shift_ctes()
    return with_(ctes, """SELECT feature, round(psi, 6) AS psi, round(mean_shift, 6) AS mean_shift,
        (psi IS NOT NULL AND NOT isnan(psi) AND psi > 0.2) AS alert FROM psi JOIN ms USING (feature)""")


def q_e4() -> str:
    return with_(li_profile() + sample_ctes("prof", "samp"), """SELECT feature, count(*) AS n, round(avg(v), 6) AS mean,
        round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM samp GROUP BY feature""")


def q_e5_two() -> str:
    ctes = li_halves() + [("a", long_sql("li_base", LINEITEM_NUMERIC)), ("b", long_sql("li_cur", LINEITEM_NUMERIC))] + ks_ctes("a", "b", "ks")
    return with_(ctes, "SELECT feature, n1, n2, round(ks_statistic, 6) AS ks_statistic, round(ks_pvalue, 6) AS ks_pvalue FROM ks")


def ks_profile_ctes() -> list[tuple[str, str]]:
    return (li_profile() + sample_ctes("prof", "samp")
            + [("samp_v", "SELECT feature, v FROM samp")] + ks_ctes("cur_long", "samp_v", "ksp"))


def q_d1_sketch() -> str:
    return with_(numeric_profile_ctes("prof", "lineitem", LINEITEM_NUMERIC),
                 "SELECT feature, n_rows, n, min, max, true AS distinct_in_bound, true AS ranks_in_bound FROM prof")


def q_e5_exact() -> str:
    """The chance of staying inside, step by step along all orders of both samples."""
    ctes = [
        ("ev", f"SELECT event_type AS feature, value AS v, ts, event_id, ts < TIMESTAMP '{EXACT_SPLIT}' AS early FROM events WHERE value IS NOT NULL"),
        ("tail", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature, early ORDER BY ts DESC, event_id DESC) AS rn FROM ev) WHERE rn <= {EXACT_LAST}"),
        ("a", "SELECT feature, v FROM tail WHERE early"), ("b", "SELECT feature, v FROM tail WHERE NOT early"),
    ] + ks_ctes("a", "b", "ks") + [
        ("lim", "SELECT feature, n1 AS m, n2 AS n, CAST(round(ks_statistic * n1 * n2) AS BIGINT) AS reach FROM ks"),
        ("walk", """SELECT feature, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS i, CAST(1 AS DOUBLE) AS p FROM lim
            UNION ALL SELECT feature, k + 1, i2, sum(q) FROM (
                SELECT w.feature, k, l.m, l.n, l.reach, i + s AS i2, p * (CASE WHEN s = 1 THEN l.m - i ELSE l.n - (k - i) END) / CAST(l.m + l.n - k AS DOUBLE) AS q
                FROM walk w JOIN lim l USING (feature), (VALUES (0), (1)) t(s) WHERE k < l.m + l.n)
            WHERE abs(i2 * n - (k + 1 - i2) * m) < reach AND q > 0 GROUP BY feature, k, i2"""),
        ("stay", "SELECT feature, sum(p) AS p FROM walk JOIN lim USING (feature) WHERE k = m + n GROUP BY feature"),
    ]
    return with_(ctes, """SELECT ks.feature, n1, n2, round(ks_statistic, 6) AS ks_statistic, round(1.0 - coalesce(p, 0.0), 6) AS ks_pvalue
        FROM ks LEFT JOIN stay USING (feature)""").replace("WITH ", "WITH RECURSIVE ", 1)


def q_e5_profile() -> str:
    return with_(ks_profile_ctes(),
                 "SELECT feature, n1, n2, round(ks_statistic, 6) AS ks_statistic, round(ks_pvalue, 6) AS ks_pvalue FROM ksp")


def orders_chi_ctes() -> list[tuple[str, str]]:
    return ([("ob", f"SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{ORDERS_SPLIT}'"),
             ("oc", f"SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '{ORDERS_SPLIT}'")]
            + cat_profile_ctes("ocp", "ob", ORDERS_CATEGORICAL, rounded=False)
            + [("oc_long", long_sql("oc", ORDERS_CATEGORICAL, string=True))]
            + chi_ctes("oc_long", "ocp", "chi"))


def chi_tail_sql(stat: str, dof: str) -> str:
    """Upper tail for even degrees of freedom: exp(-h) * sum of h^i / i!, i < dof / 2."""
    h = f"({stat} / 2.0)"
    return (f"CASE WHEN {stat} <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(0, {dof} // 2), "
            f"lambda i: exp(i * ln({h}) - lgamma(i + 1.0) - {h})))) END")


def q_e7_test() -> str:
    return with_(orders_chi_ctes(), f"""SELECT feature, k, round(observed_total, 6) AS observed_total,
        round(expected_total, 6) AS expected_total, round(chi2_statistic, 6) AS chi2_statistic, dof, status,
        round({chi_tail_sql('chi2_statistic', 'dof')}, 6) AS chi2_pvalue FROM chi""")


def q_e7() -> str:
    return with_(orders_chi_ctes(), """SELECT feature, k, round(observed_total, 6) AS observed_total,
        round(expected_total, 6) AS expected_total, round(chi2_statistic, 6) AS chi2_statistic, dof, status FROM chi""")


def q_e7_part() -> str:
    ctes = ([("pb", "SELECT * FROM part WHERE p_size <= 25"), ("pc", "SELECT * FROM part WHERE p_size > 25")]
            + cat_profile_ctes("pcp", "pb", ["p_brand"])
            + [("pc_long", long_sql("pc", ["p_brand"], string=True))] + chi_ctes("pc_long", "pcp", "chi"))
    return with_(ctes, """SELECT feature, k, round(observed_total, 6) AS observed_total,
        round(expected_total, 6) AS expected_total, round(chi2_statistic, 6) AS chi2_statistic, dof, status FROM chi""")


def score_drift_ctes() -> list[tuple[str, str]]:
    bins = 20
    ctes = score_base_ctes() + hist20_ctes("sb", "score", "h")
    ctes += [
        ("smean", "SELECT round(avg(score), 6) AS mean FROM sb"),
        ("sedges", f"""SELECT list(lo ORDER BY bin) || [max(hi)] AS edges FROM h"""),
        ("sc_bin", f"""SELECT CASE WHEN s.score < e.edges[1] OR s.score > e.edges[{bins + 1}] THEN NULL ELSE
            least(len(list_filter(e.edges, lambda x: x <= s.score)) - 1, {bins - 1}) END AS bin
            FROM sc s CROSS JOIN sedges e WHERE s.score IS NOT NULL"""),
        ("sc_cnt", "SELECT bin, count(*) AS c FROM sc_bin WHERE bin IS NOT NULL GROUP BY bin"),
        ("sbins", """SELECT 'prediction' AS feature, h.bin, coalesce(c.c, 0) AS count, h.count AS expected
            FROM h LEFT JOIN sc_cnt c ON c.bin = h.bin"""),
    ] + psi_ctes("sbins", "spsi")
    ctes += [("sdrift", """SELECT 'prediction' AS feature, 'mean_shift' AS metric,
                abs((SELECT avg(score) FROM sc WHERE score IS NOT NULL) - coalesce((SELECT mean FROM smean), 0.5)) AS value
              UNION ALL SELECT feature, 'psi' AS metric, psi AS value FROM spsi""")]
    return ctes


def q_e8() -> str:
    return with_(score_drift_ctes(), "SELECT feature, metric, round(value, 6) AS value FROM sdrift")


def q_e9() -> str:
    soft = """SELECT label, list_transform(ex, lambda x: x / list_sum(ex)) AS probs FROM
        (SELECT label, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))) AS ex FROM embeddings)"""
    return f"""WITH e AS ({soft}),
        b AS (SELECT generate_subscripts(probs, 1) - 1 AS class_idx, unnest(probs) AS p FROM e WHERE label = 0),
        bm AS (SELECT class_idx, round(avg(p), 6) AS mean FROM b GROUP BY class_idx),
        c AS (SELECT generate_subscripts(probs, 1) - 1 AS class_idx, unnest(probs) AS p FROM e WHERE label <> 0),
        cm AS (SELECT class_idx, avg(p) AS m FROM c GROUP BY class_idx)
        SELECT 'prediction' AS feature, 'class_' || CAST(class_idx AS VARCHAR) || '_mean_shift' AS metric,
               round(abs(cm.m - coalesce(bm.mean, 0.0)), 6) AS value
        FROM cm JOIN bm USING (class_idx)"""


def feature_drift_ctes() -> list[tuple[str, str]]:
    ctes = numeric_psi_ctes() + mean_shift_ctes() + ks_profile_ctes() + orders_chi_ctes()
    ctes += [("fdrift", """
        SELECT feature, 'psi' AS metric, psi AS value FROM psi
        UNION ALL SELECT feature, 'ks_statistic', ks_statistic FROM ksp
        UNION ALL SELECT feature, 'ks_pvalue', ks_pvalue FROM ksp
        UNION ALL SELECT feature, 'mean_shift', mean_shift FROM ms
        UNION ALL SELECT feature, 'chi2_statistic', chi2_statistic FROM chi WHERE status <> 'too_few_categories'
        UNION ALL SELECT feature, 'chi2_pvalue', """ + chi_tail_sql("chi2_statistic", "dof") + """ FROM chi WHERE status <> 'too_few_categories'""")]
    return ctes


def q_e10() -> str:
    return with_(feature_drift_ctes(), "SELECT feature, metric, round(value, 6) AS value FROM fdrift")


def q_e11() -> str:
    return q_e8()


def all_scores_ctes() -> list[tuple[str, str]]:
    return feature_drift_ctes() + score_drift_ctes() + [
        ("scores", """SELECT feature, metric, round(value, 6) AS value FROM fdrift
                      UNION ALL SELECT feature, metric, round(value, 6) AS value FROM sdrift""")]


def q_e12() -> str:
    return with_(all_scores_ctes(), """SELECT feature,
        CASE WHEN metric = 'psi' THEN 'psi' ELSE 'ks_test' END AS drift_type, round(value, 6) AS value,
        CASE WHEN metric = 'psi' THEN 0.2 ELSE 0.1 END AS threshold
        FROM scores WHERE value IS NOT NULL AND NOT isnan(value) AND (
            (metric = 'psi' AND value > 0.2) OR (metric = 'ks_pvalue' AND feature <> 'prediction' AND value < 0.1))""")


def q_e13() -> str:
    return with_(all_scores_ctes(), """SELECT 'v19980101_000000_abcdef' AS model_version, feature, metric AS metric_type,
        round(value, 6) AS value FROM scores
        WHERE metric IN ('psi', 'ks_pvalue') AND value IS NOT NULL AND (feature <> 'prediction' OR metric = 'psi')""")


ORACLE = {
    "d1_numeric_profile": q_d1,
    "d1_sketch_profile": q_d1_sketch,
    "d2_categorical_profile": q_d2,
    "d3_missing_rate": q_d3,
    "d4_build_baseline": q_d4,
    "d5_score_profile": q_d5,
    "d6_histogram": q_d6,
    "d7_class_profile": q_d7,
    "d8_describe": q_d8,
    "d9_value_counts": q_d9,
    "e1_edge_histogram": q_e1,
    "e3_numeric_psi": q_e3,
    "e3_numeric_psi_observed": q_e3_observed,
    "e4_reference_sample": q_e4,
    "e5_ks_two_sample": q_e5_two,
    "e5_ks_exact": q_e5_exact,
    "e5_ks_profile": q_e5_profile,
    "e6_mean_shift": q_e6,
    "e7_chi_square": q_e7,
    "e7_chi_square_part": q_e7_part,
    "e7_chi_square_test": q_e7_test,
    "e8_score_drift": q_e8,
    "e9_class_drift": q_e9,
    "e10_feature_drift": q_e10,
    "e11_prediction_drift": q_e11,
    "e12_numeric_psi_alerts": q_e12_numeric,
    "e12_drift_alerts": q_e12,
    "e13_drift_score_rows": q_e13,
}
