"""Text matrices of many columns, and listings of result files."""

import pytest
from pyspark.sql import functions as F

from brookcal.sources import tables, text


def test_matrix_of_many_columns(spark):
    """10,000 columns, a hundred entries a row, a row of one entry at either end."""
    width = 10_000
    m = spark.range(3_000).select(
        F.concat(F.lit("r"), (F.col("id") % 30).cast("string")).alias("row"), F.format_string("c%05d", (F.col("id") * 7_919) % width).alias("col"),
        (F.col("id") * 0.5 - 3).alias("v"))
    ends = spark.createDataFrame([("a", "c00000", 1.0), ("b", "c09999", 2.0)], "row string, col string, v double")
    rest = spark.range(width).select(F.lit("full").alias("row"), F.format_string("c%05d", "id").alias("col"), F.lit(1.5).alias("v"))
    m = m.unionByName(ends).unionByName(rest).distinct()
    lines = text.matrix_lines(m)
    body = {r["ord"]["n"]: r["value"] for r in lines.where("ord.s = 1").collect()}
    assert len(body) == 33 and {len(x) for x in body.values()} == {15 * width}
    assert body["a"].split()[0] == "1.0000000E+00" and body["b"].split()[-1] == "2.0000000E+00" and float(body["b"].split()[0]) == 0
    want = {}
    for r in m.collect():
        want.setdefault(r["row"], {})[int(r["col"][1:])] = r["v"]
    for row, line in body.items():
        got = {j: v for j, v in enumerate(map(float, line.split())) if v}
        assert got.keys() == {j for j, v in want[row].items() if v} and all(abs(v - want[row][j]) < 1e-3 for j, v in got.items())
    names = [r["value"] for r in lines.where("ord.s = 5").orderBy("ord").collect()]
    assert names == [f"c{i:05d}" for i in range(width)]


def test_matrix_entry_given_twice(spark):
    m = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0)], "row string, col string, v double")
    with pytest.raises(Exception, match="column twice"):
        text.matrix_lines(m).collect()


def test_listing(spark, tmp_path):
    names = {"c1": ["ies_hot.0.obs.csv", "ies_hot.12.par.csv", "ies_hot.phi.actual.csv", "ies_hot.obs+noise.csv", "other.1.obs.csv", "notes"],
             "c2": ["ies_hot.2.base.par", "ies_hot.5.par", "ies_hot.base.par"], "c3": ["ies_hot.4.par", "ies_hot.par"]}
    for folder, files in names.items():
        (tmp_path / folder).mkdir()
        for f in files:
            (tmp_path / folder / f).write_text("x" * len(f))
    found = tables.list_results(spark, str(tmp_path), recursive=True)
    rows = {(r["folder"], r["file"]): r for r in found.withColumn("b", tables.in_bundle(F.col("file"), "ies_hot")).collect()}
    assert {k: r["bytes"] for k, r in rows.items()} == {(d, f): len(f) for d, x in names.items() for f in x}
    first = rows["c1", "ies_hot.12.par.csv"]
    assert (first["root"], first["iteration"], first["kind"]) == ("ies_hot", 12, "par")
    assert rows["c1", "notes"]["iteration"] is None
    assert {k for k, r in rows.items() if not r["b"]} == {("c1", "other.1.obs.csv"), ("c1", "notes"), ("c2", "ies_hot.5.par"), ("c2", "ies_hot.base.par"), ("c3", "ies_hot.4.par"), ("c3", "ies_hot.par")}
    steps = {(r["folder"], r["iteration"], r["file"]) for r in tables.parameter_iterations(found, "ies_hot").collect()}
    assert steps == {("c2", 2, "ies_hot.2.base.par"), ("c3", 4, "ies_hot.4.par")}
    assert tables.list_results(spark, str(tmp_path / "c1"), "*.csv").count() == 5


def test_a_head_line_begins_each_file_and_lines_travel_once(spark, tmp_path):
    import checks

    checks.load()
    from checks import sources

    rows = [(f"r{i % 5}", f"line {i:03d}") for i in range(60)] + [("r9", "line 000"), ("r9", "line 000")]
    df = spark.createDataFrame(rows, "bucket string, value string")
    path = sources.write_files(df, "heads", order="value", head="single point")
    got = {r["bucket"]: r["value"].split("\n") for r in spark.read.text(path, wholetext=True).collect()}
    want = {b: ["single point", *sorted(v for k, v in rows if k == b)] for b, _ in rows}
    assert {b: [x for x in lines if x] for b, lines in got.items()} == want
