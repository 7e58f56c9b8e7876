"""Profiles, statistical tests and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.catalog.base import H, HF, S, harvest, harvest_full, query, r, rs, scored, table
from furrow.operators import drift as D
from furrow.operators import evaluation as E
from furrow.operators import hypothesis as T
from furrow.operators import profiling as P
from furrow.operators import ranks as R

DAY = "1999-01-01"


def _order():
    return [F.col("fecha"), F.col("row_id")]


@query("profile_numeric", f"""{H}, v AS (SELECT formato, 'kg_jr_h' AS variable, kg_jr_h AS x FROM h UNION ALL SELECT formato, 'p_baya', p_baya FROM h)
  SELECT formato, variable, count(x) AS n, count(*) - count(x) AS n_missing, {rs('avg(x)', 4)} AS mean, {rs('stddev_samp(x)', 4)} AS std, {rs('skewness(x)', 4)} AS skew, {rs('kurtosis(x)', 3)} AS kurtosis,
  {rs('quantile_cont(x, 0.01)', 4)} AS p01, {rs('median(x)', 4)} AS median, {rs('quantile_cont(x, 0.99)', 4)} AS p99, {rs('min(x)', 4)} AS min, {rs('max(x)', 4)} AS max FROM v GROUP BY ALL""")
def profile_numeric(spark, sf):
    out = P.profile_numeric(harvest(spark, sf), ["kg_jr_h", "p_baya"], ["formato"])
    return out.select("formato", "variable", "n", "n_missing", *[r(c, 3 if c == "kurtosis" else 4).alias(c) for c in ("mean", "std", "skew", "kurtosis", "p01", "median", "p99", "min", "max")])


_GRID = [round(-2 + i * 0.1, 10) for i in range(41)]


@query("boxcox_grid", f"""{H}, g AS (SELECT unnest({_GRID}::double[]) AS lam), y AS (SELECT formato, lam, ln(kg_jr_h) AS lx, CASE WHEN abs(lam) < 1e-12 THEN ln(kg_jr_h) ELSE (exp(ln(kg_jr_h) * lam) - 1) / lam END AS y FROM h, g),
  l AS (SELECT formato, lam, count(*) AS n, (lam - 1) * sum(lx) - count(*) / 2.0 * ln(var_pop(y)) AS ll FROM y GROUP BY formato, lam), b AS (SELECT formato, max(n) AS n, arg_max(lam, (ll, lam)) AS bl FROM l GROUP BY 1)
  SELECT formato, n, bl AS "lambda", CASE WHEN abs(bl - 1) < 0.2 THEN 'ninguna' WHEN abs(bl - 0.5) < 0.2 THEN 'sqrt' WHEN abs(bl) < 0.2 THEN 'log' WHEN abs(bl + 0.5) < 0.2 THEN '1/sqrt' WHEN abs(bl + 1) < 0.2 THEN '1/x' ELSE 'boxcox' END AS advice FROM b""")
def boxcox_grid(spark, sf):
    return P.boxcox_grid(harvest(spark, sf), "kg_jr_h", ["formato"])


def _cramers(pairs, keys):
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""c AS (SELECT {k}a, b, sum(w) AS c FROM {pairs} GROUP BY ALL), m AS (SELECT *, sum(c) OVER (PARTITION BY {k}a) AS ra, sum(c) OVER (PARTITION BY {k}b) AS rb, sum(c) OVER ({part}) AS n FROM c),
  x AS (SELECT {k}max(n)::double AS n, count(DISTINCT a)::double AS r, count(DISTINCT b)::double AS k, greatest(max(n)::double * (sum(c::double * c / (ra::double * rb)) - 1), 0) AS plain FROM m {grp}),
  ia AS (SELECT {k}sum(1.0 / ra) AS ia FROM (SELECT DISTINCT {k}a, ra FROM m) {grp}), ib AS (SELECT {k}sum(1.0 / rb) AS ib FROM (SELECT DISTINCT {k}b, rb FROM m) {grp})"""


def _v(join):
    return f"""z AS (SELECT *, CASE WHEN r = 2 AND k = 2 THEN (sqrt(plain / (n * ia * ib)) - least(0.5, sqrt(plain / (n * ia * ib)))) ^ 2 * n * ia * ib ELSE plain END AS chi2 FROM x {join}),
  zz AS (SELECT *, greatest(0, chi2 / n - (r - 1) * (k - 1) / (n - 1)) AS phi, least(r - (r - 1) ^ 2 / (n - 1) - 1, k - (k - 1) ^ 2 / (n - 1) - 1) AS den FROM z)"""


@query("cramers_v", f"""WITH p AS (SELECT o_orderpriority AS a, o_orderstatus AS b, 1 AS w FROM orders), {_cramers('p', [])}, {_v(', ia, ib')}
  SELECT cast(n AS bigint) AS n, cast((r - 1) * (k - 1) AS integer) AS dof, {rs('chi2', 5)} AS chi2, {rs('CASE WHEN least(r, k) > 1 AND den > 0 THEN sqrt(phi / den) ELSE 0 END')} AS cramers_v FROM zz""")
def cramers_v(spark, sf):
    out = P.cramers_v(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")
    return out.select("n", "dof", r("chi2", 5).alias("chi2"), r("cramers_v").alias("cramers_v"))


@query("category_associations", f"""{HF}, p AS (SELECT 'tipo' AS fa, 'formato' AS fb, tipo AS a, formato AS b, 1 AS w FROM h UNION ALL SELECT 'tipo', 'estado', tipo, estado, 1 FROM h UNION ALL SELECT 'formato', 'estado', formato, estado, 1 FROM h),
  {_cramers('p', ['fa', 'fb'])}, {_v('JOIN ia USING (fa, fb) JOIN ib USING (fa, fb)')}
  SELECT fa AS feature_a, fb AS feature_b, {rs('chi2', 4)} AS chi2, {rs('sqrt(phi / den)')} AS cramers_v, CASE WHEN sqrt(phi / den) >= 0.5 THEN 'high' WHEN sqrt(phi / den) >= 0.3 THEN 'watch' ELSE 'ok' END AS severity FROM zz""")
def category_associations(spark, sf):
    out = P.category_associations(harvest_full(spark, sf), ["tipo", "formato", "estado"])
    return out.select("feature_a", "feature_b", r("chi2", 4).alias("chi2"), r("cramers_v").alias("cramers_v"), "severity")


@query("profile_categorical", f"""{H}, md AS (SELECT median(kg_jr_h) AS md FROM h), p AS (SELECT fundo AS a, cast(kg_jr_h >= md AS varchar) AS b, 1 AS w FROM h, md), {_cramers('p', [])}, {_v(', ia, ib')},
  f AS (SELECT fundo, count(*) AS c, count(kg_jr_h) AS tc, avg(kg_jr_h) AS tm, stddev_samp(kg_jr_h) AS ts FROM h GROUP BY 1),
  o AS (SELECT cast(sum(c) AS bigint) AS n, cast(coalesce(sum(c) FILTER (fundo IS NULL), 0) AS bigint) AS n_missing, count(*) AS cardinality, count(*) FILTER (c = 1) AS n_singletons FROM f),
  q AS (SELECT chi2, cast((r - 1) * (k - 1) AS integer) AS dof, CASE WHEN den > 0 THEN sqrt(phi / den) ELSE 0 END AS v FROM zz),
  g AS (SELECT *, 1 - list_sum(list_transform(range(0, cast(2 * chi2 + 500 AS bigint)), lambda i: exp((dof / 2.0 + i) * ln(chi2 / 2.0) - chi2 / 2.0 - lgamma(dof / 2.0 + i + 1)))) AS p FROM q),
  t AS (SELECT *, sum(c) OVER (ORDER BY c DESC, fundo ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT * FROM f ORDER BY c DESC, fundo LIMIT 10))
  SELECT 'fundo' AS "column", n, n_missing, cardinality, n_singletons, {rs('(SELECT sum(c) FROM t) / n')} AS coverage_top10, {rs('chi2', 4)} AS chi2, dof, {rs('p')} AS chi2_p, {rs('v')} AS cramers_v,
  CASE WHEN cardinality <= 1 THEN 'constante' WHEN cardinality = 2 THEN 'binaria' WHEN cardinality > 50 AND (n - n_missing) / cardinality < 30 THEN 'alta_cardinalidad' WHEN v < 0.05 THEN 'debil' WHEN v >= 0.3 THEN 'fuerte' ELSE 'onehot' END AS advice,
  coalesce(fundo, 'nan') AS value, c AS "count", {rs('c / n')} AS pct, {rs('cum / n')} AS cum_pct, tc AS target_count, {rs('CASE WHEN tc >= 5 THEN tm END', 4)} AS target_mean, {rs('CASE WHEN tc >= 5 THEN ts END', 4)} AS target_std FROM t, o, g""")
def profile_categorical(spark, sf):
    """The farm's profile beside each of its ten most frequent levels."""
    out = P.profile_categorical(harvest(spark, sf), "fundo", "kg_jr_h")
    out = out.select("column", "n", "n_missing", "cardinality", "n_singletons", r("coverage_top10").alias("coverage_top10"), r("chi2", 4).alias("chi2"), "dof", r("chi2_p").alias("chi2_p"), r("cramers_v").alias("cramers_v"), "advice", F.inline("top_categories"))
    return out.withColumns({c: r(c, 4 if c.startswith("target") else 6) for c in ("pct", "cum_pct", "target_mean", "target_std")})


@query("histogram", f"""{H}, l AS (SELECT formato, min(kg_jr_h) AS lo, max(kg_jr_h) AS hi FROM h GROUP BY 1) SELECT formato, cast(least(floor((kg_jr_h - lo) / ((hi - lo) / 40)), 39) AS integer) AS bin, count(*) AS n FROM h JOIN l USING (formato) GROUP BY ALL""")
def histogram(spark, sf):
    return E.histogram(harvest(spark, sf), "kg_jr_h", 40, ["formato"]).select("formato", "bin", "n")


def _acf(lags, by="formato"):
    ls = ", ".join(f"lag(c, {k}) OVER w AS l{k}" for k in range(1, lags + 1))
    return f"""ce AS (SELECT *, kg_jr_h - avg(kg_jr_h) OVER (PARTITION BY {by}) AS c FROM h), lg AS (SELECT {by}, c, {ls} FROM ce WINDOW w AS (PARTITION BY {by} ORDER BY fecha, row_id)),
  ac AS (SELECT {by}, count(*) AS n, sum(c * c) AS g0, """ + ", ".join(f"sum(c * l{k}) / sum(c * c) AS r{k}" for k in range(1, lags + 1)) + f" FROM lg GROUP BY {by})"


ACF_LAGS = 20


def _pacf(lags):
    """Partial autocorrelations f<k>_<k> by the Durbin-Levinson recursion on r1, r2, ..."""
    steps = ["p1 AS (SELECT *, r1 AS f1_1 FROM ac)"]
    for k in range(2, lags + 1):
        num = f"r{k} - (" + " + ".join(f"f{k - 1}_{j} * r{k - j}" for j in range(1, k)) + ")"
        den = "1 - (" + " + ".join(f"f{k - 1}_{j} * r{j}" for j in range(1, k)) + ")"
        last = f"CASE WHEN abs({den}) > 1e-15 THEN ({num}) / ({den}) ELSE 0 END AS f{k}_{k}"
        rest = ", ".join(f"f{k - 1}_{j} - f{k}_{k} * f{k - 1}_{k - j} AS f{k}_{j}" for j in range(1, k))
        steps.append(f"p{k} AS (SELECT *, {last}, {rest} FROM p{k - 1})")
    return ", ".join(steps)


@query("acf_pacf", f"""{H}, {_acf(ACF_LAGS)}, {_pacf(ACF_LAGS)}, u AS (SELECT formato, n, unnest([{', '.join(f'{k}' for k in range(1, ACF_LAGS + 1))}]) AS lag, unnest([{', '.join(f'r{k}' for k in range(1, ACF_LAGS + 1))}]) AS acf, unnest([{', '.join(f'f{k}_{k}' for k in range(1, ACF_LAGS + 1))}]) AS pacf FROM p{ACF_LAGS} WHERE n >= {ACF_LAGS + 5})
  SELECT formato, lag, {rs('acf')} AS acf, {rs('pacf')} AS pacf, abs(acf) > 1.96 / sqrt(n) AS significant FROM u""")
def acf_pacf(spark, sf):
    out = P.acf_pacf(harvest(spark, sf), "kg_jr_h", _order(), ACF_LAGS, ["formato"])
    return out.select("formato", "lag", r("acf").alias("acf"), r("pacf").alias("pacf"), "significant")


@query("seasonal_strength", f"""{H}, p AS (SELECT formato, kg_jr_h AS x, row_number() OVER w AS i, sum(kg_jr_h) OVER (PARTITION BY formato ORDER BY fecha, row_id ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS s,
  count(*) OVER (PARTITION BY formato ORDER BY fecha, row_id ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS c, lag(kg_jr_h, 6) OVER w AS a, lead(kg_jr_h, 6) OVER w AS b FROM h WINDOW w AS (PARTITION BY formato ORDER BY fecha, row_id)),
  t AS (SELECT formato, i % 12 AS ph, x, (s - 0.5 * (a + b)) / 12 AS t FROM p WHERE c = 13), m AS (SELECT formato, ph, avg(x - t) AS s FROM t GROUP BY ALL), m2 AS (SELECT formato, ph, s - avg(s) OVER (PARTITION BY formato) AS s FROM m),
  z AS (SELECT formato, t, s, x - t - s AS rr FROM t JOIN m2 USING (formato, ph))
  SELECT formato, count(*) AS n, {rs('greatest(0, 1 - var_pop(rr) / var_pop(t + rr))')} AS trend_strength, {rs('greatest(0, 1 - var_pop(rr) / var_pop(s + rr))')} AS seasonal_strength FROM z GROUP BY 1""")
def seasonal_strength(spark, sf):
    out = P.seasonal_strength(harvest(spark, sf), "kg_jr_h", _order(), 12, ["formato"])
    return out.select("formato", "n", r("trend_strength").alias("trend_strength"), r("seasonal_strength").alias("seasonal_strength"))


@query("top_variance_columns", f"""{H}, v AS (SELECT 'kg_ha' AS variable, var_samp(kg_ha) AS v FROM h UNION ALL SELECT 'kg_jr_h', var_samp(kg_jr_h) FROM h UNION ALL SELECT 'h_ef', var_samp(h_ef) FROM h UNION ALL SELECT 'dia_cosecha', var_samp(dia_cosecha) FROM h)
  SELECT variable, {rs('v', 2)} AS variance, cast(row_number() OVER (ORDER BY v DESC) AS integer) AS rank FROM v ORDER BY v DESC LIMIT 3""")
def top_variance_columns(spark, sf):
    out = P.top_variance_columns(harvest(spark, sf), ["kg_ha", "kg_jr_h", "h_ef", "dia_cosecha"])
    return out.select("variable", r("variance", 2).alias("variance"), "rank")


@query("synthesize_findings", f"""{H}, v AS (SELECT formato, kg_jr_h AS x FROM h), s AS (SELECT formato, skewness(x) AS sk, kurtosis(x) AS ku, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, count(*) AS n FROM v GROUP BY 1),
  o AS (SELECT formato, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_iqr, any_value(n) AS n FROM v JOIN s USING (formato) GROUP BY 1),
  f AS (SELECT formato, CASE WHEN abs(sk) > 3 OR abs(ku) > 10 THEN 'high' ELSE 'medium' END AS severity, 'skewed' AS finding, 'kg_jr_h' AS subject, {rs('sk', 4)} AS value FROM s WHERE abs(sk) > 1.5 OR abs(ku) > 5
  UNION ALL SELECT formato, 'medium', 'outliers', 'kg_jr_h', {rs('n_iqr / n', 4)} FROM o WHERE n_iqr / n > 0.05)
  SELECT *, cast(row_number() OVER (PARTITION BY formato ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END, finding, subject) AS integer) AS rank FROM f""")
def synthesize_findings(spark, sf):
    prof = P.profile_numeric(harvest(spark, sf), ["kg_jr_h", "kg_ha"], ["formato"])
    return P.synthesize_findings(prof, by=["formato"]).withColumn("value", r("value", 4))


@query("jarque_bera", f"""{H}, m AS (SELECT formato, count(*)::double AS n, avg(kg_jr_h) AS mu FROM h GROUP BY 1), c AS (SELECT formato, any_value(n) AS n, avg((kg_jr_h - mu) ^ 2) AS m2, avg((kg_jr_h - mu) ^ 3) AS m3, avg((kg_jr_h - mu) ^ 4) AS m4 FROM h JOIN m USING (formato) GROUP BY 1)
  SELECT formato, cast(n AS bigint) AS n, {rs('n / 6 * ((m3 / m2 ^ 1.5) ^ 2 + (m4 / m2 ^ 2 - 3) ^ 2 / 4)', 1)} AS statistic, true AS rejects FROM c""")
def jarque_bera(spark, sf):
    return T.jarque_bera(harvest(spark, sf), "kg_jr_h", ["formato"]).select("formato", "n", r("statistic", 1).alias("statistic"), "rejects")


@query("anderson_darling")
def anderson_darling(spark, sf):
    return T.anderson_darling(harvest(spark, sf), "kg_ha", ["formato"])


@query("breusch_pagan", f"""{S}, o AS (SELECT formato, regr_slope(kg_jr_h, kg_ha) AS b, regr_intercept(kg_jr_h, kg_ha) AS a FROM s GROUP BY 1), e AS (SELECT formato, kg_ha, (kg_jr_h - a - b * kg_ha) ^ 2 AS e2 FROM s JOIN o USING (formato))
  SELECT formato, count(*) AS n, {rs('count(*) * regr_r2(e2, kg_ha)', 4)} AS statistic FROM e GROUP BY 1""")
def breusch_pagan(spark, sf):
    return T.breusch_pagan(harvest(spark, sf), "kg_jr_h", ["kg_ha"], ["formato"]).select("formato", "n", r("statistic", 4).alias("statistic"))


@query("breusch_pagan_residuals", f"""{S}, e0 AS (SELECT formato, y_true - y_pred AS e, y_pred FROM s), o AS (SELECT formato, regr_slope(e, y_pred) AS b, regr_intercept(e, y_pred) AS a FROM e0 GROUP BY 1), e AS (SELECT formato, y_pred, (e - a - b * y_pred) ^ 2 AS e2 FROM e0 JOIN o USING (formato))
  SELECT formato, count(*) AS n, {rs('count(*) * regr_r2(e2, y_pred)', 4)} AS statistic FROM e GROUP BY 1""")
def breusch_pagan_residuals(spark, sf):
    df = scored(spark, sf).withColumn("e", F.col("y_true") - F.col("y_pred"))
    return T.breusch_pagan_residuals(df, "e", "y_pred", ["formato"]).select("formato", "n", r("statistic", 4).alias("statistic"))


@query("white_test")
def white_test(spark, sf):
    out = T.white_test(harvest(spark, sf), "kg_jr_h", ["kg_ha", "h_ef"], ["formato"])
    return out.select("formato", "n", r("statistic", 4).alias("statistic"), "rejects")


@query("durbin_watson", f"""{H}, l AS (SELECT fundo, kg_jr_h - 3000 AS e, lag(kg_jr_h - 3000) OVER (PARTITION BY fundo ORDER BY fecha, row_id) AS p FROM h)
  SELECT fundo, count(*) AS n, {rs('sum((e - p) ^ 2) / sum(e ^ 2)')} AS statistic, CASE WHEN sum((e - p) ^ 2) / sum(e ^ 2) < 1.5 THEN 'positive' WHEN sum((e - p) ^ 2) / sum(e ^ 2) > 2.5 THEN 'negative' ELSE 'ok' END AS verdict FROM l GROUP BY 1""")
def durbin_watson(spark, sf):
    df = harvest(spark, sf).withColumn("e", F.col("kg_jr_h") - 3000)
    return T.durbin_watson(df, "e", _order(), ["fundo"]).select("fundo", "n", r("statistic").alias("statistic"), "verdict")


@query("ljung_box", f"{H}, {_acf(10, 'fundo')} SELECT fundo, n, {rs('n * (n + 2) * (' + ' + '.join(f'r{k} ^ 2 / (n - {k})' for k in range(1, 11)) + ')', 5)} AS statistic FROM ac")
def ljung_box(spark, sf):
    return T.ljung_box(harvest(spark, sf), "kg_jr_h", _order(), 10, ["fundo"]).select("fundo", "n", r("statistic", 5).alias("statistic"))


@query("kpss", f"""{H}, {_acf(5, 'fundo')}, cs AS (SELECT fundo, sum(c) OVER (PARTITION BY fundo ORDER BY fecha, row_id ROWS UNBOUNDED PRECEDING) AS s FROM ce), e AS (SELECT fundo, sum(s ^ 2) AS eta FROM cs GROUP BY 1)
  SELECT fundo, n, {rs('eta / (n::double ^ 2) / (g0 / n * (1 + 2 * (' + ' + '.join(f'(1 - {k} / 6.0) * r{k}' for k in range(1, 6)) + ')))')} AS statistic FROM ac JOIN e USING (fundo)""")
def kpss(spark, sf):
    return T.kpss(harvest(spark, sf), "kg_jr_h", _order(), 5, ["fundo"]).select("fundo", "n", r("statistic").alias("statistic"))


@query("dickey_fuller", f"""{H}, l AS (SELECT fundo, kg_jr_h - lag(kg_jr_h) OVER w AS dy, lag(kg_jr_h) OVER w AS x FROM h WINDOW w AS (PARTITION BY fundo ORDER BY fecha, row_id)),
  f AS (SELECT fundo, regr_count(dy, x) AS n, regr_slope(dy, x) AS b, regr_syy(dy, x) - regr_sxy(dy, x) ^ 2 / regr_sxx(dy, x) AS sse, regr_sxx(dy, x) AS sxx FROM l GROUP BY 1)
  SELECT fundo, cast(n AS bigint) AS n, {rs('b / sqrt(sse / (n - 2) / sxx)', 5)} AS statistic FROM f""")
def dickey_fuller(spark, sf):
    return T.dickey_fuller(harvest(spark, sf), "kg_jr_h", _order(), 0, ["fundo"]).select("fundo", "n", r("statistic", 5).alias("statistic"))


def _two(spark, sf):
    h = harvest(spark, sf)
    return h.withColumn("side", F.when(F.col("fecha") < F.lit(DAY).cast("date"), "a").otherwise("b"))


TWO = f"t AS (SELECT *, CASE WHEN fecha < DATE '{DAY}' THEN 'a' ELSE 'b' END AS side FROM h)"
CUM = """v AS (SELECT formato, kg_jr_h AS x, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM t GROUP BY ALL), cu AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY formato) AS na, sum(b) OVER (PARTITION BY formato) AS nb, lead(x) OVER (PARTITION BY formato ORDER BY x) AS nx FROM v
  WINDOW w AS (PARTITION BY formato ORDER BY x ROWS UNBOUNDED PRECEDING))"""


@query("ks_two_sample", f"{H}, {TWO}, {CUM} SELECT formato, cast(max(na) AS bigint) AS n_a, cast(max(nb) AS bigint) AS n_b, {rs('max(abs(ca::double / na - cb::double / nb))')} AS ks FROM cu GROUP BY 1")
def ks_two_sample(spark, sf):
    return R.ks_two_sample(_two(spark, sf), ["formato"], "kg_jr_h", "side").select("formato", "n_a", "n_b", r("ks").alias("ks"))


@query("mann_whitney", f"""{H}, {TWO}, k AS (SELECT formato, side, rank() OVER (PARTITION BY formato ORDER BY kg_ha) + (count(*) OVER (PARTITION BY formato, kg_ha) - 1) / 2.0 AS rk FROM t),
  u AS (SELECT formato, count(*) FILTER (side = 'a')::double AS na, count(*) FILTER (side = 'b')::double AS nb, sum(rk) FILTER (side = 'a') - count(*) FILTER (side = 'a') * (count(*) FILTER (side = 'a') + 1) / 2.0 AS u FROM k GROUP BY 1),
  ti AS (SELECT formato, sum(c ^ 3 - c) AS ties FROM (SELECT formato, kg_ha, count(*)::double AS c FROM t GROUP BY ALL) GROUP BY 1)
  SELECT formato, cast(na AS bigint) AS n_a, cast(nb AS bigint) AS n_b, {rs('u', 1)} AS u, {rs('greatest(abs(u - na * nb / 2) - 0.5, 0) / sqrt(na * nb / 12 * ((na + nb + 1) - ties / ((na + nb) * (na + nb - 1))))')} AS z, {rs('2 * u / (na * nb) - 1')} AS delta FROM u JOIN ti USING (formato)""")
def mann_whitney(spark, sf):
    return R.mann_whitney(_two(spark, sf), ["formato"], "kg_ha", "side").select("formato", "n_a", "n_b", r("u", 1).alias("u"), r("z").alias("z"), r("delta").alias("delta"))


@query("kruskal_wallis", f"""{H}, k AS (SELECT formato, fundo, rank() OVER (PARTITION BY formato ORDER BY kg_ha) + (count(*) OVER (PARTITION BY formato, kg_ha) - 1) / 2.0 AS rk FROM h), g AS (SELECT formato, fundo, sum(rk) AS r, count(*) AS n FROM k GROUP BY ALL),
  ti AS (SELECT formato, sum(c ^ 3 - c) AS ties FROM (SELECT formato, kg_ha, count(*)::double AS c FROM h GROUP BY ALL) GROUP BY 1), a AS (SELECT formato, sum(n)::double AS n, count(*) AS k, sum(r * r / n) AS s FROM g GROUP BY 1)
  SELECT formato, cast(n AS bigint) AS n, k, {rs('(12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n ^ 3 - n))', 4)} AS h FROM a JOIN ti USING (formato)""")
def kruskal_wallis(spark, sf):
    return R.kruskal_wallis(harvest(spark, sf), ["formato"], "kg_ha", "fundo").select("formato", "n", "k", r("h", 4).alias("h"))


@query("holm", f"""{H}, p AS (SELECT formato, fundo, abs(avg(kg_ha) - 25.5) / 40 AS p FROM h GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY formato ORDER BY p, fundo) - 1 AS i, count(*) OVER (PARTITION BY formato) AS n FROM p)
  SELECT formato, fundo, bool_and(p <= 0.05 / (n - i)) OVER (PARTITION BY formato ORDER BY p, fundo ROWS UNBOUNDED PRECEDING) AS rejected FROM k""")
def holm(spark, sf):
    p = harvest(spark, sf).groupBy("formato", "fundo").agg((F.abs(F.avg("kg_ha") - 25.5) / 40).alias("p"))
    return R.holm(p, "p", ["formato"], order=["fundo"]).select("formato", "fundo", "rejected")


@query("permanova")
def permanova(spark, sf):
    v = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get("embedding", i).cast("double"))
    e = table(spark, sf, "embeddings").select("label", v.alias("v"))
    flat = e.select("label", *[F.get("v", F.lit(i)).alias(f"d{i}") for i in range(8)])
    cent = flat.groupBy("label").agg(*[F.avg(f"d{i}").alias(f"d{i}") for i in range(8)]).withColumn("grp", F.col("label") % 3)
    return T.permanova(cent, [f"d{i}" for i in range(8)], "grp", "label", 199)


@query("residual_battery")
def residual_battery(spark, sf):
    df = scored(spark, sf).withColumn("e", F.col("y_true") - F.col("y_pred"))
    return T.residual_battery(df, "e", "y_pred", _order(), ["formato"])


@query("residual_findings")
def residual_findings(spark, sf):
    return T.residual_findings(residual_battery(spark, sf), ["formato"])


PSI = """q AS (SELECT {k}list_sort(list_distinct(quantile_cont(x, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS p FROM lo WHERE side = 'e' GROUP BY {g}),
  bn AS (SELECT {k}len(list_filter(p[2:len(p) - 1], lambda z: z <= x)) AS bin, count(*) FILTER (side = 'e') AS e, count(*) FILTER (side = 'a') AS a FROM lo JOIN q USING ({g}) WHERE len(p) >= 3 GROUP BY ALL),
  sh AS (SELECT *, sum(e) OVER (PARTITION BY {g}) AS ne, sum(a) OVER (PARTITION BY {g}) AS na FROM bn),
  ps AS (SELECT {k}max(ne) AS ne, max(na) AS na, sum((greatest(a / na, 1e-6) - greatest(e / ne, 1e-6)) * ln(greatest(a / na, 1e-6) / greatest(e / ne, 1e-6))) AS psi FROM sh GROUP BY {g})"""


@query("psi", f"""{H}, lo AS (SELECT fundo, kg_jr_h AS x, CASE WHEN fecha < DATE '{DAY}' THEN 'e' ELSE 'a' END AS side FROM h), {PSI.format(k='fundo, ', g='fundo')}
  SELECT fundo, cast(ne AS bigint) AS n_expected, cast(na AS bigint) AS n_actual, {rs('CASE WHEN ne >= 50 AND na >= 50 THEN psi END')} AS psi FROM ps""")
def psi(spark, sf):
    df = _two(spark, sf).withColumn("side", F.when(F.col("side") == "a", "e").otherwise("a"))
    return D.psi(df, ["fundo"], "kg_jr_h", "side").withColumn("psi", r("psi"))


YEARS = f"""y AS (SELECT DISTINCT year(fecha) AS y FROM h), yp AS (SELECT y AS ya, lead(y) OVER (ORDER BY y) AS yb FROM y), l0 AS (SELECT 'kg_jr_h' AS variable, year(fecha) AS y, kg_jr_h AS x FROM h UNION ALL SELECT 'kg_ha', year(fecha), kg_ha FROM h),
  lo AS (SELECT variable, ya, yb, x, 'e' AS side FROM l0 JOIN yp ON y = ya WHERE yb IS NOT NULL UNION ALL SELECT variable, ya, yb, x, 'a' FROM l0 JOIN yp ON y = yb), {PSI.format(k='variable, ya, yb, ', g='variable, ya, yb')},
  vv AS (SELECT variable, ya, yb, x, count(*) FILTER (side = 'e') AS a, count(*) FILTER (side = 'a') AS b FROM lo GROUP BY ALL), kc AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY variable, ya, yb) AS na, sum(b) OVER (PARTITION BY variable, ya, yb) AS nb FROM vv WINDOW w AS (PARTITION BY variable, ya, yb ORDER BY x ROWS UNBOUNDED PRECEDING)),
  ks AS (SELECT variable, ya, yb, max(abs(ca::double / na - cb::double / nb)) AS ks FROM kc GROUP BY ALL), yd AS (SELECT ps.*, ks, max(psi) OVER (PARTITION BY variable) AS mp FROM ps JOIN ks USING (variable, ya, yb))"""


@query("year_drift", f"""{H}, {YEARS} SELECT variable, cast(ya AS integer) AS year_a, cast(yb AS integer) AS year_b, {rs('psi')} AS psi, {rs('ks')} AS ks, {rs('mp')} AS max_psi, CASE WHEN mp > 0.25 THEN 'severo' WHEN mp > 0.1 THEN 'moderado' ELSE 'ninguno' END AS severity FROM yd""")
def year_drift(spark, sf):
    out = D.year_drift(harvest(spark, sf), ["kg_jr_h", "kg_ha"])
    return out.select("variable", "year_a", "year_b", r("psi").alias("psi"), r("ks").alias("ks"), r("max_psi").alias("max_psi"), "severity")


@query("drift_summary", f"""{H}, {YEARS} SELECT {rs('max(mp)')} AS psi_max, count(DISTINCT variable) FILTER (mp > 0.25) AS n_severe FROM yd""")
def drift_summary(spark, sf):
    out = D.drift_summary(D.year_drift(harvest(spark, sf), ["kg_jr_h", "kg_ha"]))
    return out.select(r("psi_max").alias("psi_max"), "n_severe")


def _history(spark, sf):
    h = harvest_full(spark, sf).withColumnRenamed("variedad", "_v").withColumnRenamed("tipo", "variedad")
    old = F.col("fecha") < F.lit(DAY).cast("date")
    return h.where(old), h.where(~old).withColumn("batch", F.year("fecha").cast("string"))


NUM = ["kg_ha", "kg_jr_h"]
CAT = ["fundo", "formato"]
HB = f"""{HF}, hi AS (SELECT * FROM h WHERE fecha < DATE '{DAY}' AND NOT (formato = 'R' AND tipo = 'PROMO')), nw AS (SELECT *, cast(year(fecha) AS varchar) AS batch FROM h WHERE fecha >= DATE '{DAY}'),
  b AS (SELECT tipo, quantile_cont(kg_ha, [0.05, 0.25, 0.5, 0.75, 0.95]) AS a, quantile_cont(kg_jr_h, [0.05, 0.25, 0.5, 0.75, 0.95]) AS y FROM hi GROUP BY 1),
  lv AS (SELECT tipo, fundo, count(*) / sum(count(*)) OVER (PARTITION BY tipo) AS f FROM hi GROUP BY tipo, fundo), lf AS (SELECT tipo, formato, count(*) / sum(count(*)) OVER (PARTITION BY tipo) AS f FROM hi GROUP BY tipo, formato)"""


def _base(spark, sf):
    old, new = _history(spark, sf)
    return D.drift_baseline(old.where(~((F.col("formato") == "R") & (F.col("variedad") == "PROMO"))), NUM, CAT), new


@query("drift_baseline", f"""{HB} SELECT tipo AS variedad, 'kg_ha' AS variable, {rs('a[1]', 4)} AS p05, {rs('a[2]', 4)} AS p25, {rs('a[3]', 4)} AS center, {rs('greatest(a[4] - a[2], 1e-9)', 4)} AS scale, {rs('a[5]', 4)} AS p95 FROM b
  UNION ALL SELECT tipo, 'kg_jr_h', {rs('y[1]', 4)}, {rs('y[2]', 4)}, {rs('y[3]', 4)}, {rs('greatest(y[4] - y[2], 1e-9)', 4)}, {rs('y[5]', 4)} FROM b""")
def drift_baseline(spark, sf):
    base, _ = _base(spark, sf)
    return base["numeric"].select("variedad", "variable", *[r(c, 4).alias(c) for c in ("p05", "p25", "center", "scale", "p95")])


@query("drift_baseline_levels", f"{HB} SELECT tipo AS variedad, 'fundo' AS variable, fundo AS level, {rs('f')} AS freq FROM lv UNION ALL SELECT tipo, 'formato', formato, {rs('f')} FROM lf")
def drift_baseline_levels(spark, sf):
    base, _ = _base(spark, sf)
    return base["levels"].select("variedad", "variable", "level", r("freq").alias("freq"))


ROWD = f"""{HB}, z AS (SELECT nw.*, abs((kg_ha - a[3]) / greatest(a[4] - a[2], 1e-9)) AS za, abs((kg_jr_h - y[3]) / greatest(y[4] - y[2], 1e-9)) AS zy, coalesce(lv.f, 0) AS fl, coalesce(lf.f, 0) AS ff
  FROM nw JOIN b USING (tipo) LEFT JOIN lv USING (tipo, fundo) LEFT JOIN lf USING (tipo, formato)),
  rd AS (SELECT *, (least(za / 3, 1) + least(zy / 3, 1) + CASE WHEN fl <= 0 THEN 1 WHEN fl < 0.01 THEN 0.5 ELSE 0 END + CASE WHEN ff <= 0 THEN 1 WHEN ff < 0.01 THEN 0.5 ELSE 0 END) / 4.0 AS score,
  CASE WHEN za >= 3 OR zy >= 3 OR fl <= 0 OR ff <= 0 THEN 'alert' WHEN za >= 1 OR zy >= 1 OR fl < 0.01 OR ff < 0.01 THEN 'warning' ELSE 'ok' END AS st FROM z)"""


@query("row_drift", f"{ROWD} SELECT row_id, {rs('score')} AS drift_score, st AS drift_status FROM rd")
def row_drift(spark, sf):
    base, new = _base(spark, sf)
    return D.row_drift(new, base, NUM, CAT).select("row_id", r("drift_score").alias("drift_score"), "drift_status")


@query("drift_status_counts", f"{ROWD} SELECT tipo AS variedad, count(*) FILTER (st = 'ok') AS n_ok, count(*) FILTER (st = 'warning') AS n_warning, count(*) FILTER (st = 'alert') AS n_alert, count(*) FILTER (st <> 'ok') AS n_flagged FROM rd GROUP BY 1")
def drift_status_counts(spark, sf):
    base, new = _base(spark, sf)
    return D.drift_status_counts(D.row_drift(new, base, NUM, CAT), ["variedad"])


@query("psi_numeric_fixed", f"""{HB}, gr AS (SELECT DISTINCT tipo, batch, unnest(range(6)) AS bin FROM nw), oc AS (SELECT tipo, batch, len(list_filter(y, lambda q: q <= kg_jr_h)) AS bin, count(*) AS c FROM nw JOIN b USING (tipo) GROUP BY ALL),
  ec AS (SELECT tipo, len(list_filter(y, lambda q: q <= kg_jr_h)) AS bin, count(*) AS c FROM hi JOIN b USING (tipo) GROUP BY ALL),
  sh AS (SELECT gr.*, greatest(coalesce(oc.c, 0) / sum(coalesce(oc.c, 0)) OVER (PARTITION BY tipo, batch), 1e-4) AS o, greatest(coalesce(ec.c, 0) / sum(coalesce(ec.c, 0)) OVER (PARTITION BY tipo, batch), 1e-4) AS e, coalesce(oc.c, 0) AS c FROM gr LEFT JOIN oc USING (tipo, batch, bin) LEFT JOIN ec USING (tipo, bin))
  SELECT tipo AS variedad, batch, cast(sum(c) AS bigint) AS n_observed, {rs('sum((o - e) * ln(o / e))')} AS psi FROM sh GROUP BY tipo, batch""")
def psi_numeric_fixed(spark, sf):
    from furrow.functions.stats import melt

    base, new = _base(spark, sf)
    out = D.psi_numeric_fixed(melt(new, ["variedad", "batch"], ["kg_jr_h"]), base["numeric"], base["counts"], ["variedad", "batch"], ["variedad"])
    return out.select("variedad", "batch", "n_observed", r("psi").alias("psi"))


CATD = f"""{HB}, oc AS (SELECT tipo, batch, formato, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY tipo, batch) AS o FROM nw GROUP BY tipo, batch, formato), ev AS (SELECT tipo, batch, formato, f FROM (SELECT DISTINCT tipo, batch FROM nw) JOIN lf USING (tipo)),
  al AS (SELECT coalesce(oc.tipo, ev.tipo) AS tipo, coalesce(oc.batch, ev.batch) AS batch, coalesce(o, 0) AS o0, coalesce(f, 0) AS f0, coalesce(n, 0) AS n FROM oc FULL JOIN ev ON oc.tipo = ev.tipo AND oc.batch = ev.batch AND oc.formato = ev.formato)"""


@query("psi_categorical", f"""{CATD} SELECT tipo AS variedad, batch, cast(sum(n) AS bigint) AS n_observed, count(*) FILTER (f0 <= 0 AND o0 > 0) AS n_unseen, {rs('sum((greatest(o0, 1e-4) - greatest(f0, 1e-4)) * ln(greatest(o0, 1e-4) / greatest(f0, 1e-4)))')} AS psi FROM al GROUP BY ALL""")
def psi_categorical(spark, sf):
    base, new = _base(spark, sf)
    counts = new.groupBy("variedad", "batch", F.lit("formato").alias("variable"), F.col("formato").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    out = D.psi_categorical(counts, base["levels"].where("variable = 'formato'"), ["variedad", "batch"], ["variedad"])
    return out.select("variedad", "batch", "n_observed", "n_unseen", r("psi").alias("psi"))


@query("chi2_goodness", f"""{CATD}, k AS (SELECT *, sum(n) OVER w AS nn, sum(f0) OVER w AS ff FROM al WHERE f0 > 0 AND n > 0 WINDOW w AS (PARTITION BY tipo, batch))
  SELECT tipo AS variedad, batch, count(*) AS k, {rs('sum((n - f0 / ff * nn) ^ 2 / (f0 / ff * nn))', 5)} AS chi2 FROM k GROUP BY ALL""")
def chi2_goodness(spark, sf):
    base, new = _base(spark, sf)
    counts = new.groupBy("variedad", "batch", F.col("formato").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    levels = base["levels"].where("variable = 'formato'").select("variedad", "level", "freq")
    out = T.chi2_goodness(counts, levels, "level", ["variedad", "batch"], ["variedad"])
    return out.select("variedad", "batch", "k", r("chi2", 5).alias("chi2"))


@query("unseen_categories", f"{HB} SELECT DISTINCT tipo AS variedad, formato AS level FROM nw WHERE (tipo, formato) NOT IN (SELECT (tipo, formato) FROM lf)")
def unseen_categories(spark, sf):
    base, new = _base(spark, sf)
    seen = new.select("variedad", F.col("formato").alias("level")).distinct()
    return D.unseen_categories(seen, base["levels"].where("variable = 'formato'"), ["variedad", "level"])


@query("category_outer_align", f"""{HB}, o AS (SELECT tipo, formato, count(*) / sum(count(*)) OVER (PARTITION BY tipo) AS o FROM nw WHERE fundo <> '3' AND formato <> 'N' GROUP BY tipo, formato)
  SELECT coalesce(o.tipo, lf.tipo) AS variedad, coalesce(o.formato, lf.formato) AS level, {rs('greatest(coalesce(o, 0), 1e-4)')} AS observed, {rs('greatest(coalesce(f, 0), 1e-4)')} AS expected, coalesce(f, 0) <= 0 AS unseen
  FROM o FULL JOIN lf ON o.tipo = lf.tipo AND o.formato = lf.formato""")
def category_outer_align(spark, sf):
    from furrow.operators.groups import attach

    base, new = _base(spark, sf)
    c = new.where("fundo <> '3' AND formato <> 'N'").groupBy("variedad", F.col("formato").alias("level")).agg(F.count(F.lit(1)).alias("c"))
    t = c.groupBy("variedad").agg(F.sum("c").alias("t"))
    share = attach(c, t, ["variedad"]).select("variedad", "level", (F.col("c") / F.col("t")).alias("share"))
    out = D.category_outer_align(share, base["levels"].where("variable = 'formato'"), ["variedad", "level"])
    return out.select("variedad", "level", r("observed").alias("observed"), r("expected").alias("expected"), "unseen")


@query("batch_drift")
def batch_drift(spark, sf):
    base, new = _base(spark, sf)
    out = D.batch_drift(new, base, NUM, CAT)
    return out.select("variedad", "batch", "variable", "kind", "n_observed", r("psi").alias("psi"), "n_unseen", "status")


@query("batch_report")
def batch_report(spark, sf):
    base, new = _base(spark, sf)
    return D.batch_report(D.batch_drift(new, base, NUM, CAT)).withColumn("score", r("score"))
