"""Roles the driver's tables play, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, body: str, needs: tuple[str, ...] = ()) -> None:
    _CTES[name] = (needs, body.strip())


def with_ctes(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause holding the named views and what they need, ending in a comma-less list."""
    done: list[str] = []

    def add(name: str) -> None:
        needs, _ = _CTES[name]
        for need in needs:
            add(need)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in done)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# daily series -------------------------------------------------------------


def daily(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None, tasks: int = 0) -> DataFrame:
    """(loc, day, value): quantity shipped per supplier and day; the optional period reaches the scan.

    Where more ``tasks`` than shuffle partitions are asked for, the lines are dealt out to that many.
    """
    line = read(spark, sf_dir, "lineitem")
    if start is not None:
        stamp = F.col("l_shipdate")
        line = line.where((stamp >= F.lit(start).cast("timestamp_ntz")) & (stamp < F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 day")))
    days = line.select(F.lpad(F.col("l_suppkey").cast("string"), 8, "0").alias("loc"), F.to_date("l_shipdate").alias("day"), "l_quantity")
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        days = days.repartition(tasks, "loc", "day")
    return days.groupBy("loc", "day").agg(F.sum("l_quantity").alias("value"))


_cte("daily", """
SELECT lpad(cast(l_suppkey AS varchar), 8, '0') AS loc, cast(l_shipdate AS date) AS day, sum(l_quantity) AS value
FROM lineitem GROUP BY 1, 2""")


def daily_by_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(var, loc, day, value): the daily series split by return flag."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("var"),
            F.lpad(F.col("l_suppkey").cast("string"), 8, "0").alias("loc"),
            F.to_date("l_shipdate").alias("day"),
        )
        .agg(F.sum("l_quantity").alias("value"))
    )


_cte("daily_by_var", """
SELECT l_returnflag AS var, lpad(cast(l_suppkey AS varchar), 8, '0') AS loc, cast(l_shipdate AS date) AS day,
       sum(l_quantity) AS value
FROM lineitem GROUP BY 1, 2, 3""")


def gauge_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(loc, day, discharge): daily series with some zero and negative days."""
    v = F.col("value")
    return daily(spark, sf_dir).select(
        "loc", "day", F.when(v <= 2, -v).when(v <= 4, F.lit(0.0)).otherwise(v).alias("discharge")
    )


_cte("gauge_flow", """
SELECT loc, day, CASE WHEN value <= 2 THEN -value WHEN value <= 4 THEN 0.0 ELSE value END AS discharge
FROM daily""", ("daily",))


# residual table -----------------------------------------------------------


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, group, measured, modelled, weight): one row per order line."""
    line = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag",
        "l_linestatus",
    )
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    one = line.join(part, "l_partkey").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_extendedprice").alias("measured"),
        F.max(F.col("l_quantity") * F.col("p_retailprice")).alias("modelled"),
        F.max("l_discount").alias("weight"),
        F.max("l_returnflag").alias("_f"),
        F.max("l_linestatus").alias("_s"),
    )
    prefix = F.when(F.col("_f") == "N", "flow_").when(F.col("_s") == "F", "l_max_").otherwise("g_min_")
    return one.select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("name"),
        F.concat(prefix, F.lower("_f")).alias("group"),
        "measured", "modelled", "weight",
    )


_cte("residuals", """
SELECT concat_ws(':', cast(l_orderkey AS varchar), cast(l_linenumber AS varchar)) AS name,
       (CASE WHEN max(l_returnflag) = 'N' THEN 'flow_' WHEN max(l_linestatus) = 'F' THEN 'l_max_' ELSE 'g_min_' END)
         || lower(max(l_returnflag)) AS "group",
       max(l_extendedprice) AS measured, max(l_quantity * p_retailprice) AS modelled, max(l_discount) AS weight
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY l_orderkey, l_linenumber""")


# observation ensemble -----------------------------------------------------


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(real, name, value): one realization per vector, one name per component; the first is ``base``."""
    vec = read(spark, sf_dir, "embeddings")
    return vec.select(
        F.when(F.col("vec_id") == 0, "base").otherwise(F.col("vec_id").cast("string")).alias("real"),
        F.posexplode("embedding").alias("pos", "v"),
    ).select("real", F.concat(F.lit("v"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("name"),
             F.col("v").cast("double").alias("value"))


_cte("ensemble", """
SELECT CASE WHEN vec_id = 0 THEN 'base' ELSE cast(vec_id AS varchar) END AS real,
       'v' || lpad(cast(i - 1 AS varchar), 2, '0') AS name, cast(embedding[i] AS double) AS value
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obsnme, obsval, weight, obgnme): control values of the ensemble's names."""
    pos = F.col("pos")
    grp = pos % 8
    return (
        read(spark, sf_dir, "embeddings")
        .select("label", F.posexplode("embedding").alias("pos", "v"))
        .groupBy("pos")
        .agg(F.avg(F.when(F.col("label") == 0, F.col("v").cast("double"))).alias("_m"))
        .select(
            F.concat(F.lit("v"), F.lpad(pos.cast("string"), 2, "0")).alias("obsnme"),
            (F.round("_m", 9) + 0.05).alias("obsval"),
            (pos % 4).cast("double").alias("weight"),
            F.concat(
                F.when(grp == 1, "l_max_").when(grp == 2, "g_min_").otherwise("plain_"), grp.cast("string")
            ).alias("obgnme"),
        )
    )


_cte("observations", """
SELECT 'v' || lpad(cast(pos AS varchar), 2, '0') AS obsnme, round(m, 9) + 0.05 AS obsval,
       cast(pos % 4 AS double) AS weight,
       (CASE pos % 8 WHEN 1 THEN 'l_max_' WHEN 2 THEN 'g_min_' ELSE 'plain_' END) || cast(pos % 8 AS varchar) AS obgnme
FROM (SELECT i - 1 AS pos, avg(CASE WHEN label = 0 THEN cast(embedding[i] AS double) END) AS m
      FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1)""")


# parameters ---------------------------------------------------------------


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter table from parts; odd sizes take a range, even ones a percentage."""
    size, val = F.col("p_size"), F.col("p_retailprice")
    odd = size % 2 == 1
    return read(spark, sf_dir, "part").select(
        F.concat(F.col("p_brand"), F.lit(":hru_"), F.col("p_partkey").cast("string")).alias("parnme"),
        F.when(size % 5 == 0, "fixed").when(size % 5 == 1, "none").when(size % 5 == 2, "tied").otherwise("log")
        .alias("partrans"),
        F.when(odd, "factor").otherwise("relative").alias("parchglim"),
        val.alias("parval1"),
        F.when(odd, size * 18.0).otherwise(val * 0.8).alias("parlbnd"),
        F.when(odd, size * 18.0 + 950.0).otherwise(val * 1.2).alias("parubnd"),
        F.col("p_brand").alias("pargp"),
        (F.lit(1.0) + (size % 3) * 0.5).alias("scale"),
        F.lit(0.0).alias("offset"),
    )


_cte("parameters", """
SELECT p_brand || ':hru_' || cast(p_partkey AS varchar) AS parnme,
       CASE p_size % 5 WHEN 0 THEN 'fixed' WHEN 1 THEN 'none' WHEN 2 THEN 'tied' ELSE 'log' END AS partrans,
       CASE WHEN p_size % 2 = 1 THEN 'factor' ELSE 'relative' END AS parchglim,
       p_retailprice AS parval1,
       CASE WHEN p_size % 2 = 1 THEN p_size * 18.0::double ELSE p_retailprice * 0.8::double END AS parlbnd,
       CASE WHEN p_size % 2 = 1 THEN p_size * 18.0::double + 950.0::double ELSE p_retailprice * 1.2::double END AS parubnd,
       p_brand AS pargp, 1.0::double + (p_size % 3) * 0.5::double AS scale, 0.0::double AS "offset"
FROM part""")


def par_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(real, name, value): sampled parameter values, one realization per supplier; some names are missing."""
    line = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_discount").alias("d"))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    return line.join(part, "l_partkey").select(
        F.when(F.col("l_suppkey") == 0, "base").otherwise(F.col("l_suppkey").cast("string")).alias("real"),
        F.concat(F.col("p_brand"), F.lit(":hru_"), F.col("l_partkey").cast("string")).alias("name"),
        (F.col("p_retailprice") * (F.lit(0.75) + F.col("d") * 5.0)).alias("value"),
    )


_cte("par_ensemble", """
SELECT CASE WHEN l_suppkey = 0 THEN 'base' ELSE cast(l_suppkey AS varchar) END AS real,
       p_brand || ':hru_' || cast(l_partkey AS varchar) AS name,
       p_retailprice * (0.75::double + d * 5.0::double) AS value
FROM (SELECT l_suppkey, l_partkey, max(l_discount) AS d FROM lineitem GROUP BY 1, 2) JOIN part ON l_partkey = p_partkey""")


# points -------------------------------------------------------------------


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, x, y, zone, value): customers on a jittered grid; some share a place."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"),
        (k % 37 * 10.0 + F.col("c_nationkey") * 0.1).alias("x"),
        (k % 53 * 10.0 + F.col("c_nationkey") * 0.05).alias("y"),
        (F.col("c_nationkey") % 3 + 1).alias("zone"),
        F.col("c_acctbal").alias("value"),
    )


_cte("points", """
SELECT c_name AS name, c_custkey % 37 * 10.0::double + c_nationkey * 0.1::double AS x,
       c_custkey % 53 * 10.0::double + c_nationkey * 0.05::double AS y, c_nationkey % 3 + 1 AS zone, c_acctbal AS value
FROM customer""")
