"""Sources and sinks: the driver's tables are rendered in each format, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brookcal.session import scratch_path
from brookcal.sources import ensembles as SE
from brookcal.sources import tables as ST
from brookcal.sources import text as SX
from checks.registry import check, q_rnd, rnd
from checks.scoring import phi_history
from checks.views import daily, daily_by_var, ensemble, par_ensemble, parameters, points, read, residuals, with_ctes

BUCKETS = 4
#: Lines that one task sorts and writes.
LINES = 200_000


def write_files(df, label, bucket="bucket", files=0, order="ord", head=None):
    """(bucket, ord, value) rows as one ordered text file per bucket; ``files`` is their number, where it may be large.

    With ``head``, each file begins with that line, which is added where the lines of a file have met.
    """
    path = scratch_path(df.sparkSession, label)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(max(files, partitions), bucket) if files > BUCKETS else df.repartition(bucket)
    by = [bucket, order]
    if head is not None:
        numbered = dealt.select(bucket, "value", F.col(order).alias("_by"), F.row_number().over(Window.partitionBy(bucket).orderBy(order)).alias("_n"))
        line = lambda o, text: F.struct(F.lit(o).alias("_o"), text.alias("value"))
        body = line(1, F.col("value"))
        lines = F.explode(F.when(F.col("_n") == 1, F.array(line(0, F.lit(head)), body)).otherwise(F.array(body))).alias("_l")
        dealt = numbered.select(bucket, "_by", lines).select(bucket, "_l._o", "_by", "_l.value")
        by = [bucket, "_o", "_by"]
    (dealt.sortWithinPartitions(*by).select(bucket, "value")
     .write.partitionBy(bucket).text(path))
    return path


def named_file_writer(path):
    """Writes sorted ``folder, file, line`` rows of a task as ``path/folder/file``, each file under its own attempt first."""
    import uuid

    import pyarrow as pa
    from pyarrow import fs

    def write(batches):
        store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        current = out = attempt = None

        def close():
            out.close()
            store.move(attempt, f"{root}/{current[0]}/{current[1]}")
            return pa.RecordBatch.from_pylist([dict(zip(("folder", "file"), current))])

        for batch in batches:
            for folder, file, line in zip(*(c.to_pylist() for c in batch.columns)):
                if current != (folder, file):
                    if current is not None:
                        yield close()
                    current, attempt = (folder, file), f"{root}/_attempts/{uuid.uuid4().hex}"
                    store.create_dir(f"{root}/_attempts", recursive=True)
                    store.create_dir(f"{root}/{folder}", recursive=True)
                    out = store.open_output_stream(attempt)
                out.write(f"{line}\n".encode())
        if current is not None:
            yield close()

    return write


def spread_lines(spark, body, head, label):
    """Body lines over four files, or one for each ``LINES`` of them, each starting with the head lines."""
    files = max(BUCKETS, -(-body.count() // LINES))
    b = body.select(F.pmod(F.xxhash64("value"), F.lit(files)).cast("int").alias("bucket"), F.lit(len(head)).alias("o"), "value")
    for i, text in enumerate(head):
        b = b.unionByName(spark.range(files).select(F.col("id").cast("int").alias("bucket"), F.lit(i).alias("o"), F.lit(text).alias("value")))
    return write_files(b.withColumn("ord", F.struct("o", "value")), label, files=files)


@check("S1_series_scan", with_ctes("daily_by_var") + """
SELECT loc, day, CASE WHEN value >= 5 THEN value END AS value FROM daily_by_var WHERE var = 'N'""")
def series_scan(spark, d):
    path = scratch_path(spark, "series")
    v = F.when(F.col("value") >= 5, F.col("value")).otherwise(F.lit(float("nan")))
    ST.write_series(daily_by_var(spark, d).withColumn("value", v), path)
    return ST.scan_series(spark, path, "N").select("loc", "day", "value")


@check("S19_split_by_variable", with_ctes("daily_by_var") + f"SELECT var, count(*) AS n, {q_rnd('sum(value)')} AS total FROM daily_by_var GROUP BY 1")
def split(spark, d):
    path = scratch_path(spark, "split")
    ST.write_series(daily_by_var(spark, d), path)
    return ST.scan_series(spark, path).groupBy("var").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("value")).alias("total"))


@check("S2_dimension_scan", "SELECT lpad(cast(s_suppkey AS varchar), 8, '0') AS id, s_name AS name, s_acctbal AS acct FROM supplier")
def dimension(spark, d):
    body = read(spark, d, "supplier").select(F.concat_ws(
        ",", F.col("s_suppkey").cast("string"), F.concat(F.lit("  "), "s_name", F.lit("   ")), F.col("s_acctbal").cast("string")).alias("value"))
    path = spread_lines(spark, body, ["﻿id,name,acct"], "dimension")
    # partition directories are not part of the table
    return ST.scan_dimension(spark, f"{path}/*/*", "id string, name string, acct double", {"id": 8})


@check("S3_pair_scan", with_ctes("daily") + "SELECT 'flow:' || loc || ':' || day AS obsnme, CASE WHEN value >= 5 THEN value END AS obsval FROM daily")
def pair_scan(spark, d):
    body = daily(spark, d).select(F.format_string(
        "flow:%s:%s          %s", "loc", F.col("day").cast("string"), F.when(F.col("value") >= 5, F.col("value").cast("string")).otherwise("na")).alias("value"))
    return SX.scan_pairs(spark, spread_lines(spark, body, ["obsname    obsval"], "pairs"))


@check("S3_rejected_lines", with_ctes("daily") + """
SELECT CASE WHEN value < 5 THEN 'no value' ELSE 'text' END AS kind, count(*) AS n FROM daily WHERE value < 5 OR value > 90 GROUP BY 1""")
def rejected_pairs(spark, d):
    name = F.format_string("flow:%s:%s", "loc", F.col("day").cast("string"))
    body = daily(spark, d).select(F.when(F.col("value") < 5, name).when(F.col("value") > 90, F.concat_ws(" ", name, F.lit("12x"))).otherwise(
        F.concat_ws(" ", name, F.col("value").cast("string"))).alias("value"))
    lines = SX.rejected_lines(spark, spread_lines(spark, body, ["obsname    obsval"], "damaged"), "pairs")
    return lines.groupBy(F.when(F.col("value").contains(" "), "text").otherwise("no value").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@check("S4_observation_sink", with_ctes("residuals") + """
SELECT name AS obsnme, measured AS obsval, "group" AS obgnme FROM residuals UNION ALL SELECT 'alt:' || name, modelled, 'alternative' FROM residuals""")
def observation_sink(spark, d):
    res = residuals(spark, d)
    path = scratch_path(spark, "observations")
    ST.write_observations([
        res.select(F.col("name").alias("obsnme"), F.col("measured").alias("obsval"), F.col("group").alias("obgnme")),
        res.select(F.concat(F.lit("alt:"), "name").alias("obsnme"), F.col("modelled").alias("obsval"), F.lit("alternative").alias("obgnme")),
    ], path)
    return ST.scan_observations(spark, path).select("obsnme", "obsval", "obgnme")


@check("S4_observation_lines", with_ctes("daily") + "SELECT 'flow:' || loc || ':' || day || '          ' || printf('%.1f', value) AS value FROM daily")
def observation_lines(spark, d):
    return ST.observation_lines(daily(spark, d).select(
        F.concat_ws(":", F.lit("flow"), "loc", F.col("day").cast("string")).alias("obsnme"), F.col("value").alias("obsval")))


@check("S5_residual_scan", with_ctes("residuals") + f"""
SELECT name, "group", measured, {q_rnd('modelled')} AS modelled, {q_rnd('CASE WHEN weight > 0 THEN measured - modelled END')} AS residual, weight FROM residuals""")
def residual_scan(spark, d):
    body = residuals(spark, d).select(F.concat(
        F.lit("  "), F.concat_ws("   ", "name", "group", F.col("measured").cast("string"), F.format_string("%.8f", "modelled"),
                                F.when(F.col("weight") > 0, F.format_string("%.8f", F.col("measured") - F.col("modelled"))).otherwise("Cov."),
                                F.col("weight").cast("string"))).alias("value"))
    path = spread_lines(spark, body, [" MODEL OUTPUTS", "", " Name   Group   Measured   Modelled   Residual   Weight"], "residuals")
    return SX.scan_residuals(spark, path).withColumn("modelled", rnd("modelled")).withColumn("residual", rnd("residual"))


@check("S8_parameter_values", with_ctes("parameters") + 'SELECT parnme, parval1, scale, "offset" FROM parameters')
def parameter_values(spark, d):
    path = scratch_path(spark, "parfile")
    SX.write_parameter_values(parameters(spark, d).withColumn("run", F.lit("base")), path, "run")
    return SX.scan_parameter_values(spark, path).drop("file")


@check("S9_parameter_files_to_ensemble", with_ctes("par_ensemble", "parameters") + f"""
SELECT r.real, p.parnme AS name, {q_rnd('e.value', 4)} AS value FROM (SELECT DISTINCT real FROM par_ensemble) r CROSS JOIN (SELECT parnme FROM parameters WHERE partrans <> 'fixed') p
LEFT JOIN par_ensemble e ON e.real = r.real AND e.name = p.parnme""")
def parameter_files(spark, d):
    vals = par_ensemble(spark, d).select("real", F.col("name").alias("parnme"), F.round("value", 4).alias("parval1"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"))
    # a line travels once, without a copy to sort by, and the values are not formed again for the heads
    body = vals.select(F.col("real").alias("bucket"), F.format_string("%s %.6f 1.0 0.0", "parnme", "parval1").alias("value"))
    path = write_files(body, "parfiles", order="value", head="single point")
    pars = parameters(spark, d).where("partrans <> 'fixed'")
    return SX.scan_parameter_ensemble(spark, path, pars, r"bucket=([^/]+)/").withColumn("value", rnd("value", 4))


def _wide_lines(spark, ens, key, name, value):
    """Wide csv lines of a long table with a common set of names."""
    rows = ens.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(name, F.format_string("%.12g", value).alias("v")))).alias("r"))
    body = rows.select(F.concat_ws(",", F.col(key), F.transform("r", lambda x: x["v"])).alias("value"))
    names = F.array_join(F.sort_array(ens.agg(F.collect_set(name)).scalar()), ",")
    b = body.select(F.pmod(F.xxhash64("value"), F.lit(BUCKETS)).cast("int").alias("bucket"), F.lit(1).alias("o"), "value")
    head = b.select("bucket").distinct().select("bucket", F.lit(0).alias("o"), F.concat_ws(",", F.lit("real_name"), names).alias("value"))
    return b.unionByName(head).withColumn("ord", F.struct("o", "value"))


@check("S10_ensemble_scan", with_ctes("ensemble") + f"SELECT real, name, {q_rnd('value', 6)} AS value FROM ensemble")
def ensemble_scan(spark, d):
    path = write_files(_wide_lines(spark, ensemble(spark, d), "real", "name", "value"), "ensemble")
    long = scratch_path(spark, "ensemble-long")
    SE.write_ensemble(SE.scan_ensemble(spark, path), long)
    return spark.read.parquet(long).withColumn("value", rnd("value", 6))


@check("S11_phi_history_scan", with_ctes("phi_hist") + f"SELECT cast(run AS integer) AS iteration, real, {q_rnd('phi', 5)} AS phi FROM phi_hist")
def phi_scan(spark, d):
    phi = phi_history(spark, d)
    extra = phi.groupBy("run").agg(F.count(F.lit(1)).cast("double").alias("total_runs"), F.avg("phi").alias("mean"), F.stddev("phi").alias("standard_deviation"),
                                   F.min("phi").alias("min"), F.max("phi").alias("max"))
    summary = extra.unpivot(["run"], list(SE.PHI_SUMMARY_COLUMNS), "real", "phi")
    rows = phi.select("run", "real", "phi").unionByName(summary)
    # iterations hold different realizations, so every iteration is its own file
    lines = rows.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("real", F.format_string("%.12g", "phi").alias("v")))).alias("r"))
    body = lines.select(F.col("run").alias("bucket"), F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.concat_ws(",", F.lit("iteration"), F.transform("r", lambda x: x["real"])).alias("value")),
        F.struct(F.lit(1).alias("ord"), F.concat_ws(",", F.col("run"), F.transform("r", lambda x: x["v"])).alias("value")))).alias("s")).select("bucket", "s.*")
    return SE.scan_phi_history(spark, write_files(body, "phi")).withColumn("phi", rnd("phi", 5))


@check("S12_conflict_scan", with_ctes("residuals") + "SELECT name FROM residuals WHERE modelled > 4 * measured")
def conflict_scan(spark, d):
    body = residuals(spark, d).where("modelled > 4 * measured").select(F.concat_ws(",", "name", F.col("measured").cast("string")).alias("value"))
    return SE.scan_conflicts(spark, spread_lines(spark, body, ["name,obs_mean"], "conflicts"))


@check("S13_matrix_round_trip", with_ctes("jac") + f"""
SELECT lower(o.obs) AS row, lower(p.par) AS col, {q_rnd('coalesce(v, 0)', 4)} AS v FROM (SELECT DISTINCT obs FROM jac) o CROSS JOIN (SELECT DISTINCT par FROM jac) p LEFT JOIN jac ON jac.obs = o.obs AND jac.par = p.par""")
def matrix(spark, d):
    from checks.pairs import jacobian

    m = jacobian(spark, d).select(F.col("obs").alias("row"), F.col("par").alias("col"), "v")
    path = write_files(SX.matrix_lines(m).withColumn("bucket", F.lit(0)), "matrix")
    return SX.scan_matrix(spark, path).withColumn("v", rnd("v", 4))


@check("S14_site_samples", """
SELECT 'u' || user_id AS name, date_trunc('second', ts) AS ts, CASE WHEN event_type = 'error' THEN NULL ELSE round(value, 2) + 0.0 END AS value FROM events""")
def samples(spark, d):
    ev = read(spark, d, "events")
    v = F.when(F.col("event_type") != "error", F.col("value"))
    body = SX.site_sample_lines(ev.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), "ts", v.alias("value")))
    path = scratch_path(spark, "smp")
    body.write.text(path)
    return SX.scan_site_samples(spark, path).withColumn("value", rnd("value", 2))


@check("S15_run_log", """
SELECT date_trunc('second', ts) AS ts, 'run_' || event_type || '_run_id:' || event_id AS action, cast(event_id AS varchar) AS run_id, cast(user_id AS varchar) AS agent FROM events""")
def run_log(spark, d):
    body = read(spark, d, "events").select(F.explode(F.array(
        F.concat(F.date_format("ts", "MM/dd/yy HH:mm:ss"), F.lit("->run "), "event_type", F.lit(" run_id:"), F.col("event_id").cast("string"),
                 F.lit(" on agent:"), F.col("user_id").cast("string")),
        F.lit("a line without an arrow"))).alias("value"))
    path = scratch_path(spark, "log")
    body.write.text(path)
    t = SX.scan_run_log(spark, path)
    return t.select("ts", "action", F.col("tokens")["run_id"].alias("run_id"), F.col("tokens")["agent"].alias("agent"))


@check("S16_record_phi", """
SELECT cast(kper AS varchar) AS run, seg AS iteration, 'seg_' || grp AS "group", phi FROM
 (SELECT l_returnflag AS kper, l_linenumber AS seg, l_suppkey AS grp, sum(l_quantity) AS phi FROM lineitem GROUP BY 1, 2, 3) WHERE seg < 7""")
def record(spark, d):
    """One record log per return flag; the last block ends the file and is not closed."""
    t = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("bucket"), F.col("l_linenumber").alias("b"), F.col("l_suppkey").alias("g")).agg(F.sum("l_quantity").alias("phi"))
    items = t.select("bucket", F.struct("b", F.lit(2).alias("s"), "g").alias("ord"),
                     F.concat(F.lit('   Contribution to phi from observation group "SEG_'), F.col("g").cast("string"), F.lit('"  =  '), F.col("phi").cast("string")).alias("value"))
    blocks = t.select("bucket", "b").distinct()
    line = lambda s, text, df: df.select("bucket", F.struct("b", F.lit(s).alias("s"), F.lit(0).cast("long").alias("g")).alias("ord"), F.lit(text).alias("value"))
    body = items.unionByName(line(0, "OPTIMISATION ITERATION", blocks)).unionByName(line(1, "   Starting phi for this iteration: 12.5", blocks)).unionByName(
        line(3, " ", blocks.where("b < 7")))
    out = SX.scan_record_phi(spark, write_files(body, "record"))
    return out.select(F.regexp_extract("file", "bucket=([^/]+)/", 1).alias("run"), F.col("iteration").cast("int").alias("iteration"), "group", "phi")


@check("S17_point_scan", with_ctes("points") + f"""
SELECT zone, 'pt' || (row_number() OVER (PARTITION BY zone ORDER BY name) - 1) AS name, {q_rnd('x')} AS x, {q_rnd('y')} AS y, value FROM points""")
def point_scan(spark, d):
    body = points(spark, d).select(F.col("zone").alias("bucket"), F.lit(9).alias("o"), F.col("name").alias("n"), F.concat_ws(
        " ", F.format_string("%.8f", "y"), F.format_string("%.8f", "x"), F.lit("7.5"), F.col("value").cast("string")).alias("value"))
    for i, text in enumerate(["points", "4", "northing", "easting", "code", "acct"]):
        body = body.unionByName(points(spark, d).select(F.col("zone").alias("bucket")).distinct().select(
            "bucket", F.lit(i).alias("o"), F.lit("").alias("n"), F.lit(text).alias("value")))
    path = write_files(body.withColumn("ord", F.struct("o", "n")), "gslib")
    out = SX.scan_points(spark, path, "acct", x_idx=1, y_idx=0, keep_file=True)
    return out.select(F.regexp_extract("file", "bucket=([^/]+)/", 1).cast("int").alias("zone"), "name", rnd("x").alias("x"), rnd("y").alias("y"), "value")


@check("S18_pilot_points", with_ctes("points") + f"SELECT replace(name, '#', '_') AS name, {q_rnd('x')} AS x, {q_rnd('y')} AS y, zone, value AS parval1 FROM points")
def pilot_points(spark, d):
    pts = points(spark, d).select(F.translate("name", "#", "_").alias("name"), "x", "y", "zone", F.col("value").alias("parval1"))
    path = scratch_path(spark, "pilot")
    SX.pilot_point_lines(pts).write.text(path)
    return SX.scan_pilot_points(spark, path).withColumn("x", rnd("x")).withColumn("y", rnd("y"))


_RESULTS = """WITH l AS (SELECT l_returnflag AS folder, CASE WHEN l_linenumber % 3 = 0 THEN 'prior' ELSE 'ies_hot' END AS root, l_linenumber AS i, l_suppkey % 7 AS m,
  cast(l_orderkey AS varchar) || ',' || cast(l_linenumber AS varchar) AS line FROM lineitem),
f AS (SELECT folder, root || CASE m WHEN 0 THEN '.' || i || '.obs.csv' WHEN 1 THEN '.' || i || '.par.csv' WHEN 2 THEN '.' || i || '.base.par'
  WHEN 3 THEN '.phi.actual.csv' WHEN 4 THEN '.' || i || '.pdc.csv' WHEN 5 THEN '.obs+noise.csv' ELSE '.log' END AS file, line FROM l),
g AS (SELECT folder, file, cast(sum(length(line) + 1) AS bigint) AS bytes FROM f GROUP BY 1, 2)
"""


def _result_files(spark, d):
    """Order lines as result files: a folder for each return flag, named by line number and supplier."""
    root, i = F.when(F.col("l_linenumber") % 3 == 0, "prior").otherwise("ies_hot"), F.col("l_linenumber").cast("string")
    kinds = {0: "obs.csv", 1: "par.csv", 2: "base.par", 4: "pdc.csv"}
    others = {3: ".phi.actual.csv", 5: ".obs+noise.csv"}
    name = F.lit(".log")
    for mode, kind in kinds.items():
        name = F.when(F.col("l_suppkey") % 7 == mode, F.concat(F.lit("."), i, F.lit(f".{kind}"))).otherwise(name)
    for mode, kind in others.items():
        name = F.when(F.col("l_suppkey") % 7 == mode, F.lit(kind)).otherwise(name)
    rows = read(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("folder"), F.concat(root, name).alias("file"), F.concat_ws(",", F.col("l_orderkey").cast("string"), i).alias("line"))
    path = scratch_path(spark, "results")
    rows.repartition("folder", "file").sortWithinPartitions("folder", "file").mapInArrow(named_file_writer(path), "folder string, file string").collect()
    return path


@check("S20_result_listing", _RESULTS + r"""
SELECT folder, file, bytes, regexp_extract(file, '^(.*?)\.(\d+)\.(.*)\.[^.]+$', 1) AS root, try_cast(regexp_extract(file, '^(.*?)\.(\d+)\.(.*)\.[^.]+$', 2) AS integer) AS iteration,
  regexp_extract(file, '^(.*?)\.(\d+)\.(.*)\.[^.]+$', 3) AS kind,
  file LIKE 'ies_hot%pdc%' OR file LIKE 'ies_hot%phi%' OR file LIKE 'ies_hot.%noise%' OR file LIKE 'ies_hot.0%' OR file LIKE 'ies_hot.1%' OR file LIKE 'ies_hot.2%' OR file LIKE 'ies_hot.3%' AS bundled
FROM g WHERE file LIKE '%.csv'""")
def listing(spark, d):
    """Csv files of all cases, written to the shared folder and listed there."""
    found = ST.list_results(spark, _result_files(spark, d), "*.csv", recursive=True)
    return found.withColumn("bundled", ST.in_bundle(F.col("file"), "ies_hot"))


@check("S20_parameter_iterations", _RESULTS + r"""
SELECT folder, cast(string_split(file, '.')[2] AS integer) AS iteration, file FROM g WHERE file LIKE 'ies_hot%.base.par'""")
def listed_iterations(spark, d):
    return ST.parameter_iterations(ST.list_results(spark, _result_files(spark, d), recursive=True), "ies_hot")
