"""Sources, sinks, filters and checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from furrow.catalog.base import H, HF, harvest, harvest_full, query, r, rs, table
from furrow.operators import cleaning as C
from furrow.sources import harvest as SH
from furrow.sources import store as ST
from furrow.session import shared_root


def _folder(spark, name):
    return f"{shared_root(spark)}/furrow-out/{name}-{uuid.uuid4().hex}"


RAW = """raw AS (SELECT row_id, CASE WHEN h_ef = 8 THEN 'n/d' WHEN indus_pct IS NULL THEN NULL
  WHEN p_baya = 0.01 THEN '-' || cast(kg_ha AS varchar) ELSE cast(kg_ha AS varchar) END AS y,
  CASE WHEN h_ef = 2 THEN 'sin fecha' ELSE strftime(fecha, '%Y-%m-%d') END AS d FROM h)"""


def _raw(spark, sf):
    """Records as text, with blanks, words and negative numbers among them."""
    qty = F.col("kg_ha").cast("string")
    y = F.when(F.col("h_ef") == 8, "n/d").when(F.col("indus_pct").isNull(), F.lit(None)).when(
        F.col("p_baya") == 0.01, F.concat(F.lit("-"), qty)
    ).otherwise(qty)
    d = F.when(F.col("h_ef") == 2, "sin fecha").otherwise(F.date_format("fecha", "yyyy-MM-dd"))
    return harvest(spark, sf).select("row_id", y.alias("y"), d.alias("d"))


@query("read_harvest", f"{H} SELECT fundo, formato, fecha, kg_ha, row_id FROM h")
def read_harvest(spark, sf):
    path = _folder(spark, "harvest")
    h = harvest(spark, sf).select("fundo", "formato", "fecha", "kg_ha", "row_id")
    h.toDF(" FUNDO ", "FORMATO ", " FECHA", "KG/HA", "row_id").write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return SH.read_harvest(spark, path, "csv", "a string, b string, c date, d double, row_id string").toDF(
        "fundo", "formato", "fecha", "kg_ha", "row_id"
    )


KEYED = """k AS (SELECT ' ' || variedad || ' ' AS variedad, formato, kg_ha FROM h)"""


def _keyed(spark, sf):
    return harvest_full(spark, sf).select(F.concat(F.lit(" "), "variedad", F.lit(" ")).alias("variedad"), "formato", "kg_ha")


@query("split_by_variety", f"""{HF}, {KEYED}, t AS (SELECT trim(variedad) AS variedad, formato, kg_ha FROM k)
  SELECT DISTINCT variedad, formato, kg_ha FROM t WHERE variedad IN
  (SELECT variedad FROM t GROUP BY 1 HAVING count(*) >= (SELECT count(*) / 25 FROM t))""")
def split_by_variety(spark, sf):
    df = _keyed(spark, sf)
    least = df.count() / 25
    path = _folder(spark, "split")
    SH.write_by_variety(df, path, least)
    return spark.read.parquet(path).select(F.col("variedad").cast("string").alias("variedad"), "formato", "kg_ha")


@query("split_summary", f"""{HF}, {KEYED}, t AS (SELECT trim(variedad) AS variedad, formato, kg_ha FROM k),
  c AS (SELECT variedad, count(*) AS n, count(DISTINCT (formato, kg_ha)) AS u FROM t GROUP BY 1)
  SELECT variedad, CASE WHEN n < 2000 THEN 0 ELSE u END AS rows_written, CASE WHEN n < 2000 THEN 0 ELSE n - u END AS duplicates_dropped,
  n < 2000 AS skipped FROM c""")
def split_summary(spark, sf):
    return SH.split_summary(_keyed(spark, sf), 2000)


@query("sanitize_partition_name", """WITH c AS (SELECT DISTINCT url, CASE WHEN trim(regexp_replace(url, '[\\\\/?*\\[\\]:]', '_', 'g')) = '' THEN 'SIN_NOMBRE'
  ELSE substr(trim(regexp_replace(url, '[\\\\/?*\\[\\]:]', '_', 'g')), 1, 31) END AS c FROM pages),
  n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY url) AS rn FROM c)
  SELECT url, CASE WHEN rn = 1 THEN c ELSE substr(c, 1, 28) || '_' || rn END AS partition_name FROM n""")
def sanitize_partition_name(spark, sf):
    return SH.sanitize_partition_name(table(spark, sf, "pages"), "url")


@query("list_varieties", "SELECT DISTINCT p_brand AS variedad FROM lineitem JOIN part ON l_partkey = p_partkey")
def list_varieties(spark, sf):
    return SH.list_varieties(harvest_full(spark, sf))


@query("resolve_varieties", """SELECT v AS variedad, v IN (SELECT p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) AS known
  FROM (VALUES ('Brand#3'), ('Brand#99'), ('Brand#12')) t(v)""")
def resolve_varieties(spark, sf):
    return SH.resolve_varieties(harvest_full(spark, sf), ["Brand#3", "Brand#99", "Brand#12"])


@query("import_history", f"""{H}, {RAW}, t AS (SELECT formato, try_cast(y AS double) AS kg_ha, kg_jr_h FROM raw JOIN h USING (row_id) WHERE formato <> 'A'
  UNION ALL SELECT formato, kg_ha, kg_jr_h FROM h WHERE formato = 'A')
  SELECT formato AS variety, count(*) AS n, sum(kg_ha) AS total FROM t WHERE kg_ha > 0 AND kg_jr_h > 0 GROUP BY 1""")
def import_history(spark, sf):
    """Append every variety, then replace one of them."""
    path = _folder(spark, "history")
    h = harvest(spark, sf).select("row_id", "fecha", "kg_ha", "kg_jr_h", "formato")
    raw = h.drop("kg_ha").join(_raw(spark, sf).select("row_id", F.col("y").alias("kg_ha")), "row_id")
    for v in ("A", "N", "R"):
        ST.import_history(raw.where(F.col("formato") == v).drop("formato"), path, v)
    ST.import_history(h.where("formato = 'A'").drop("formato"), path, "A", replace=True)
    return spark.read.parquet(path).groupBy(F.col("variety").cast("string").alias("variety")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("kg_ha").alias("total")
    )


def _forecast_rows(spark, sf):
    return harvest(spark, sf).select(
        F.col("row_id").alias("id"),
        F.col("formato").alias("variety"),
        "fecha",
        "fundo",
        F.col("kg_ha").alias("kghora_pred"),
        F.when(F.col("h_ef") > 2, F.col("h_ef") + 0.12345).alias("horas_efectivas"),
    )


@query("append_forecasts", f"""{H} SELECT row_id AS id, formato AS variety,
  {rs('CASE WHEN h_ef > 2 THEN kg_ha * (h_ef + 0.12345) END', 3)} AS kgjn_pred FROM h""")
def append_forecasts(spark, sf):
    path = _folder(spark, "forecasts")
    ST.append_forecasts(_forecast_rows(spark, sf), path)
    return spark.read.parquet(path).select("id", F.col("variety").cast("string").alias("variety"), r("kgjn_pred", 3).alias("kgjn_pred"))


@query("list_forecasts", """SELECT o_orderkey AS id, cast(o_orderdate AS date) AS fecha, o_totalprice AS pred,
  (SELECT count(*) FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1999-12-31') AS total
  FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1999-12-31'
  ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 20""")
def list_forecasts(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("pred"), F.col("o_orderpriority").alias("variety"),
    )
    import datetime as dt

    window = (dt.datetime(1996, 1, 1), dt.datetime(1999, 12, 31))
    page = ST.list_forecasts(o, {"variety": "2-HIGH", "created_at": window}, 50, 20)
    return page.select("id", F.to_date("created_at").alias("fecha"), "pred", "total")


@query("list_history", """SELECT o_orderkey AS id, cast(o_orderdate AS date) AS fecha, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total
  FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30 OFFSET 5""")
def list_history(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("fecha"), F.col("o_orderstatus").alias("variety")
    )
    return ST.list_history(o, "F", 30, 5).select("id", "fecha", "total")


@query("delete_forecasts", f"""{H} SELECT formato AS variety, count(*) AS n, (SELECT count(*) FROM h WHERE fecha = DATE '1998-03-05') AS removed
  FROM h WHERE fecha <> DATE '1998-03-05' GROUP BY 1""")
def delete_forecasts(spark, sf):
    import datetime as dt

    path = _folder(spark, "forecasts")
    ST.append_forecasts(_forecast_rows(spark, sf), path)
    removed = ST.delete_forecasts(spark, path, fecha=dt.date(1998, 3, 5))
    return spark.read.parquet(path).groupBy(F.col("variety").cast("string").alias("variety")).agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("removed", F.lit(removed).cast("bigint"))


@query("delete_history", f"{H} SELECT formato AS variety, count(*) AS n FROM h WHERE formato <> 'N' GROUP BY 1")
def delete_history(spark, sf):
    path = _folder(spark, "history")
    ST.append_forecasts(_forecast_rows(spark, sf), path)
    ST.delete_history(spark, path, "N")
    return spark.read.parquet(path).groupBy(F.col("variety").cast("string").alias("variety")).agg(F.count(F.lit(1)).alias("n"))


@query("export_tables", f"{H} SELECT formato, count(*) AS n, sum(kg_ha) AS total FROM h GROUP BY 1")
def export_tables(spark, sf):
    path = _folder(spark, "export")
    h = harvest(spark, sf).select("row_id", "formato", "kg_ha")
    groups = h.groupBy("formato").agg(F.count(F.lit(1)).alias("n"), F.sum("kg_ha").alias("total"))
    ST.export_tables({"predictions": h, "by_format": groups}, path)
    return spark.read.parquet(f"{path}/by_format")


@query("append_audit", f"{H} SELECT formato AS model, count(*) * 2 AS n FROM h GROUP BY 1")
def append_audit(spark, sf):
    path = _folder(spark, "audit")
    lines = harvest(spark, sf).groupBy(F.col("formato").alias("model")).agg(F.count(F.lit(1)).alias("n_rows"))
    ST.append_audit(lines, path)
    ST.append_audit(lines, path)
    return spark.read.schema("model string, n_rows bigint").json(path).groupBy("model").agg(F.sum("n_rows").alias("n"))


@query("dataset_fingerprint", f"""{H}, f AS (SELECT ('0x' || substr(md5('fp|' || concat_ws('|', row_id, formato, cast(kg_ha AS varchar), coalesce(cast(p_baya AS varchar), '~'))), 1, 8))::bigint AS v FROM h)
  SELECT count(*) AS n_rows, cast(4 AS bigint) AS n_cols, cast(sum(v) AS bigint) AS hash_sum, bit_xor(v) AS hash_xor FROM f""")
def dataset_fingerprint(spark, sf):
    return SH.dataset_fingerprint(harvest(spark, sf), ["row_id", "formato", "kg_ha", "p_baya"])


@query("read_forecast_inputs", f"""{HF} SELECT variedad, fecha, kg_ha, dpc, dia_cosecha, CASE WHEN h_ef > 5 THEN 'CLAMSHELL 4.4 OZ' ELSE formato END AS formato,
  CASE WHEN h_ef > 6 THEN '' ELSE fundo END AS fundo, p_baya, row_id AS external_id FROM h""")
def read_forecast_inputs(spark, sf):
    path = _folder(spark, "requests")
    h = harvest_full(spark, sf)
    text = h.select(
        "variedad", "fecha", "kg_ha", "dpc", "ha", "dia_cosecha",
        F.when(F.col("h_ef") > 5, F.lit(" ")).otherwise(F.col("formato")).alias("formato"),
        F.when(F.col("h_ef") > 6, F.lit(None)).otherwise(F.col("fundo")).alias("fundo"),
        "p_baya", F.col("row_id").alias("external_id"),
    )
    text.write.option("header", True).csv(path)
    out = SH.read_forecast_inputs(spark, path)
    return out.select("variedad", "fecha", "kg_ha", "dpc", "dia_cosecha", "formato", "fundo", "p_baya", "external_id")


@query("with_variety_config", f"""{HF} SELECT variedad, CASE WHEN variedad = 'Brand#3' THEN 10 ELSE 50 END AS rare_min_count,
  CASE WHEN variedad = 'Brand#4' THEN 20.0::double ELSE 35.0::double END AS max_temporal_mape, count(*) AS n FROM h GROUP BY ALL""")
def with_variety_config(spark, sf):
    own = {"Brand#3": {"rare_min_count": 10}, "Brand#4": {"max_temporal_mape": 20.0}}
    out = SH.with_variety_config(harvest_full(spark, sf), own)
    return out.groupBy("variedad", "rare_min_count", "max_temporal_mape").agg(F.count(F.lit(1)).alias("n"))


@query("latest_profile", f"{H} SELECT formato AS variedad, 2 * count(*) AS n FROM h GROUP BY 1")
def latest_profile(spark, sf):
    path = _folder(spark, "profiles")
    p = harvest(spark, sf).groupBy(F.col("formato").alias("variedad")).agg(F.count(F.lit(1)).alias("n"))
    SH.write_profile(p, path, "run-1")
    SH.write_profile(p.withColumn("n", F.col("n") * 2), path, "run-2")
    return SH.latest_profile(spark, path).select(F.col("variedad").cast("string").alias("variedad"), "n")


@query("clean_target", f"{H}, {RAW} SELECT row_id, try_cast(y AS double) AS y FROM raw WHERE try_cast(y AS double) > 0")
def clean_target(spark, sf):
    return C.clean_target(_raw(spark, sf), "y").select("row_id", "y")


@query("target_report", f"""{H}, {RAW} SELECT count(*) AS n_rows, count(*) FILTER (y IS NULL) AS n_null,
  count(*) FILTER (y IS NOT NULL AND try_cast(y AS double) IS NULL) AS n_text, count(*) FILTER (try_cast(y AS double) <= 0) AS n_nonpositive,
  count(*) FILTER (try_cast(y AS double) > 0) AS n_kept FROM raw""")
def target_report(spark, sf):
    return C.target_report(_raw(spark, sf), "y")


@query("dedup_rows", "SELECT DISTINCT l_returnflag, l_quantity, l_discount FROM lineitem")
def dedup_rows(spark, sf):
    return C.dedup_rows(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount"))


@query("clean_dates", f"{H}, {RAW} SELECT row_id, try_cast(d AS date) AS d FROM raw WHERE try_cast(d AS date) IS NOT NULL")
def clean_dates(spark, sf):
    return C.clean_dates(_raw(spark, sf), "d").select("row_id", "d")


@query("select_features", f"{HF} SELECT row_id, kg_ha, indus_pct, dpc, p_baya, ha, cast(dia_cosecha AS double) AS dia_cosecha, formato, fundo, fecha FROM h")
def select_features(spark, sf):
    return C.select_features(harvest_full(spark, sf), ["row_id"])


@query("aligned_business_columns", f"{H} SELECT row_id, {rs('kg_jr')} AS kg_jr, h_ef FROM h WHERE indus_pct > 0")
def aligned_business_columns(spark, sf):
    out = C.aligned_business_columns(harvest(spark, sf), "indus_pct")
    return out.select("row_id", r("kg_jr").alias("kg_jr"), "h_ef")


@query("check_types", f"""{H}, {RAW} SELECT 'y' AS "column", count(*) FILTER (y IS NOT NULL AND try_cast(y AS double) IS NULL) AS n_bad FROM raw
  UNION ALL SELECT 'd', count(*) FILTER (try_cast(d AS date) IS NULL) FROM raw""")
def check_types(spark, sf):
    return C.check_types(_raw(spark, sf), ["y"], "d")


RULES = {"kg_ha": (5.0, 45.0), "indus_pct": (2.0, None), "dia_cosecha": (None, 360.0)}


@query("check_ranges", f"""{H} SELECT 'kg_ha' AS "column", count(*) FILTER (kg_ha < 5) AS n_low, count(*) FILTER (kg_ha > 45) AS n_high FROM h
  UNION ALL SELECT 'indus_pct', count(*) FILTER (indus_pct < 2), 0 FROM h UNION ALL SELECT 'dia_cosecha', 0, count(*) FILTER (dia_cosecha > 360) FROM h""")
def check_ranges(spark, sf):
    return C.check_ranges(harvest(spark, sf), RULES)


@query("check_duplicates", "SELECT cast(count(*) - count(DISTINCT (l_returnflag, l_quantity, l_discount)) AS bigint) AS n_duplicates FROM lineitem")
def check_duplicates(spark, sf):
    return C.check_duplicates(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount"))


@query("check_zero_variance", """SELECT 'one' AS "column" UNION ALL SELECT 'word'""")
def check_zero_variance(spark, sf):
    df = harvest(spark, sf).select("kg_ha", "formato", F.abs(F.signum("kg_ha")).alias("one"), F.substring("row_id", 1, 0).alias("word"))
    return C.check_zero_variance(df, ["kg_ha", "one"], ["formato", "word"])


@query("validate_dataset", f"""{H} SELECT 'above_range' AS "check", 'indus_pct' AS "column", count(*) FILTER (indus_pct * 12 > 100) AS n FROM h
  UNION ALL SELECT 'duplicates', '*', cast(count(*) - count(DISTINCT (kg_ha, formato, coalesce(indus_pct, -1))) AS bigint) FROM h
  UNION ALL SELECT 'zero_variance', 'ha', 1""")
def validate_dataset(spark, sf):
    df = harvest(spark, sf).select("kg_ha", "formato", (F.col("indus_pct") * 12).alias("indus_pct"), F.abs(F.signum("kg_ha")).alias("ha"))
    return C.validate_dataset(df, ["kg_ha", "indus_pct", "ha"], ["formato"])


@query("validate_batch", f"""{HF} SELECT row_id AS "row", 'kg_ha' AS "column", cast(kg_ha AS varchar) AS value, 'must be between 2 and 48' AS reason FROM h WHERE NOT (kg_ha BETWEEN 2 AND 48)
  UNION ALL SELECT row_id, 'formato', formato, 'value not allowed' FROM h WHERE formato NOT IN ('A', 'N')
  UNION ALL SELECT row_id, 'p_baya', cast(p_baya AS varchar), 'must be between 0.02 and 0.08' FROM h WHERE p_baya IS NOT NULL AND NOT (p_baya BETWEEN 0.02 AND 0.08)
  UNION ALL SELECT row_id, 'variedad', upper(variedad), 'unknown variety' FROM h WHERE variedad NOT IN (SELECT p_brand FROM part WHERE p_size <= 1)""")
def validate_batch(spark, sf):
    rules = [C.range_rule("kg_ha", 2, 48), C.member_rule("formato", ["A", "N"]), C.range_rule("p_baya", 0.02, 0.08, True)]
    known = table(spark, sf, "part").where("p_size <= 1").select(F.col("p_brand").alias("variedad"))
    df = harvest_full(spark, sf)
    return C.validate_batch(df, rules, ["variedad", "fecha", "kg_ha"], known)


@query("validate_batch_oversize", f"""{HF} SELECT '0' AS "row", 'variedad' AS "column", upper(variedad) AS value, count(*) || ' rows exceed the maximum of 2400' AS reason
  FROM h GROUP BY variedad HAVING count(*) > 2400
  UNION ALL SELECT row_id, 'kg_ha', cast(kg_ha AS varchar), 'must be between 2 and 48' FROM h WHERE NOT (kg_ha BETWEEN 2 AND 48)
    AND variedad NOT IN (SELECT variedad FROM h GROUP BY variedad HAVING count(*) > 2400)""")
def validate_batch_oversize(spark, sf):
    return C.validate_batch(harvest_full(spark, sf), [C.range_rule("kg_ha", 2, 48)], ["variedad"], max_rows=2400)


@query("normalize_catalog", """SELECT p_partkey, CASE WHEN p_size > 45 THEN 'RED WIDGET' WHEN upper(p_name) IN ('RED WIDGET', 'SMALL RING') THEN upper(p_name) END AS item FROM part""")
def normalize_catalog(spark, sf):
    from furrow.functions.scalar import catalog_value

    messy = F.when(F.col("p_size") > 45, "  ").otherwise(F.concat(F.lit(" "), F.regexp_replace("p_name", " ", "   "), F.lit(" ")))
    return table(spark, sf, "part").select("p_partkey", catalog_value(messy, ["RED WIDGET", "SMALL RING"], "RED WIDGET").alias("item"))


@query("align_columns", f"{H} SELECT cast(kg_ha AS double) AS kg_ha, p_baya, cast(NULL AS varchar) AS nota FROM h WHERE NOT (kg_ha <= 25 AND p_baya IS NULL)".replace("cast(kg_ha AS double)", "CASE WHEN kg_ha > 25 THEN kg_ha END"))
def align_columns(spark, sf):
    df = harvest(spark, sf).select(F.when(F.col("kg_ha") > 25, F.col("kg_ha")).alias("kg_ha"), "p_baya", "formato")
    return C.align_columns(df, {"kg_ha": "double", "p_baya": "double", "nota": "string"})


@query("validate_predictions", f"""{H} SELECT cast(count(*) FILTER (formato <> 'A' AND kg_ha - 3 < 0) AS bigint) AS n_invalid, count(*) FILTER (formato = 'A') AS n_unmatched FROM h""")
def validate_predictions(spark, sf):
    h = harvest(spark, sf)
    pred = h.where("formato <> 'A'").select("row_id", F.col("kg_ha").alias("p"), (F.col("kg_ha") - 3).alias("lo"), (F.col("kg_ha") + 3).alias("hi"))
    return C.validate_predictions(pred, h, "p", "lo", "hi")


@query("quality_metrics", f"""{H}, q AS (SELECT fundo, formato, fecha, indus_pct, p_baya FROM h)
  SELECT count(*) AS n_rows, cast(5 AS bigint) AS n_cols, cast(count(*) - count(DISTINCT (fundo, formato, fecha, coalesce(indus_pct, -1), coalesce(p_baya, -1))) AS bigint) AS n_duplicates,
  cast(2 * count(*) - count(indus_pct) - count(p_baya) AS bigint) AS n_missing, count(DISTINCT fundo) AS n_fundo, count(DISTINCT formato) AS n_formato,
  min(fecha) AS date_min, max(fecha) AS date_max, {rs('(2 * count(*) - count(indus_pct) - count(p_baya)) / (5.0 * count(*))')} AS missing_ratio FROM q""")
def quality_metrics(spark, sf):
    df = harvest(spark, sf).select("fundo", "formato", "fecha", "indus_pct", "p_baya")
    out = C.quality_metrics(df, ["fundo", "formato"])
    return out.withColumn("missing_ratio", r("missing_ratio"))
