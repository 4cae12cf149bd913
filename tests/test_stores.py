"""Stores by site, headers of their own, paths, null keys, and quantiles of groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_core import workbook_bytes

from metrikon.functions import ids
from metrikon.operators import compare, pseudonym, qc, ranks
from metrikon.plans import sites, tracks
from metrikon.sources import tables, workbook


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_site_replaces_itself_alone(spark, tmp_path):
    schema, path = "site string, v int", str(tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    kind = frame().schema
    read = lambda: rows_of(tables.stored(spark, path, kind))
    assert read() == []
    tables.store(frame(("CO", 1), ("CO", 2), (None, 9)), path, ["site"])
    tables.store(frame(("007", 3)), path, ["site"])
    assert read() == [("007", 3), ("CO", 1), ("CO", 2), (None, 9)]
    tables.store(frame(("CO", 5)), path, ["site"])
    assert read() == [("007", 3), ("CO", 5), (None, 9)]
    tables.store(frame(), path, ["site"])
    assert read() == [("007", 3), ("CO", 5), (None, 9)]
    tables.store(frame((None, 8)), path, ["site"])
    assert read() == [("007", 3), ("CO", 5), (None, 8)]
    fails = frame(("CO", 1)).withColumn("v", F.when(F.col("v") == 1, F.raise_error(F.lit("lost"))).cast("int"))
    with pytest.raises(Exception, match="lost"):
        tables.store(fails, path, ["site"])
    assert read() == [("007", 3), ("CO", 5), (None, 8)]
    for _ in range(2):  # without by the table is replaced
        tables.store(frame(("CO", 1)), str(tmp_path / "u"))
    assert rows_of(tables.stored(spark, str(tmp_path / "u"), kind)) == [("CO", 1)]


def plain_path(p):
    p = "/" + p.removeprefix("file:").lstrip("/") if p.startswith("file:") else p
    out = []
    for s in p.split("/"):
        if s == ".." and (out[-1:] not in ([], [".."])):
            out.pop()
        elif s not in ("", ".") and not (s == ".." and p.startswith("/") and not out):
            out.append(s)
    return ("/" if p.startswith("/") else "") + "/".join(out)


def test_paths_of_any_depth(spark):
    paths = ["/a/" + "".join(f"x{i}/" for i in range(12)) + "../" * 10 + "z", "/../../a", "../../a/../b", "a/../../b", "/", "", ".", "/a/./b//c/", "file:/a/../b", "file:///x//y", "/a/..", "/...", "/a/.../b", "/a/b/../../../../c", "é/../ü"]
    got = spark.createDataFrame([(p,) for p in [*paths, None]], "p string").select("p", ids.normal_path(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in got} == {p: plain_path(p) for p in paths} | {None: None}
    assert plain_path(paths[0]) == "/a/x0/x1/z"


def test_outer_join_keeps_null_keys(spark):
    a = spark.createDataFrame([("p", 1.0), (None, 2.0)], "k string, v double")
    b = spark.createDataFrame([("q", 3.0), (None, 4.0)], "k string, w double")
    c = spark.createDataFrame([("q", 5.0)], "k string, x double")
    assert rows_of(compare.outer_on([a, b, c], "k")) == sorted([("p", 1.0, None, None), (None, 2.0, 4.0, None), ("q", None, 3.0, 5.0)], key=str)
    assert rows_of(compare.outer({"one": a, "two": c}, "k")) == sorted([("p", 1.0, None), (None, 2.0, None), ("q", None, 5.0)], key=str)
    assert rows_of(pseudonym.require_unique(a, ["k"])) == rows_of(a)
    for twice in ([("p", 1.0), ("p", 2.0)], [(None, 1.0), (None, 2.0)]):
        with pytest.raises(Exception, match="duplicate key"):
            compare.outer_on([b, spark.createDataFrame(twice, "k string, v double")], "k").collect()


@pytest.mark.parametrize("shares", [[0.5], [0.0, 0.25, 0.75, 1.0], [0.1, 0.33]])
def test_quantiles_of_groups(spark, shares):
    rng = np.random.default_rng(4)
    rows = [("hot", float(v)) for v in rng.normal(size=4000).round(2)] + [("few", float(v)) for v in range(5)] + [("one", 3.0), (None, 1.0), (None, 2.0), ("none", None), ("same", 7.0), ("same", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: (r.n, r.q) for r in ranks.quantiles(df, ["g"], "v", shares, "q").collect()}
    values = {g: [v for k, v in rows if k == g and v is not None] for g, _ in rows}
    assert set(got) == {g for g, v in values.items() if v}
    for g, (n, q) in got.items():
        assert n == len(values[g])
        np.testing.assert_allclose(q, np.quantile(values[g], shares), atol=1e-12)
    assert ranks.quantiles(df.limit(0), ["g"], "v", shares).count() == 0


def test_a_hot_site_is_many_ranges(spark):
    """A site with nearly all rows lies in several parts of its counts, and its fences are those of one pass."""
    df = spark.createDataFrame([("hot", float(i * 7919 % 10007)) for i in range(6000)] + [("B", float(i)) for i in range(9)], "site string, v double")
    counts = df.groupBy("site", "v").agg(F.count("*").alias("c"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts are not put together
    try:
        assert ranks.running(counts, ["site", "v"], "c").where("site = 'hot'").select("part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {r.site: r.q for r in df.groupBy("site").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).collect()}
    for r in qc.iqr_bounds(df, "site", ["v"]).collect():
        low, high = want[r.site]
        assert (r.low, r.high) == pytest.approx((low - 1.5 * (high - low), high + 1.5 * (high - low)))


def test_not_a_number_is_missing(spark):
    df = spark.createDataFrame([("A", float(i)) for i in range(8)] + [("A", float("nan")), ("A", float("inf"))], "site string, v double")
    got = qc.flag(df, "site", ["v"], {"v": (0.0, 100.0)})
    assert [r.QC_FLAGS for r in got.where("NOT (v < 100)").collect()] == ["missing_values"] * 2
    assert qc.iqr_bounds(df, "site", ["v"]).first().high == 5.25 + 1.5 * 3.5


def test_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",GENERAL,\nID,AGE,H\n1,3,x\nID,AGE,H\n,GENERAL,\n\n2,,\n")
    (tmp_path / "b.csv").write_text("GENERAL,,,\nH, ID ,AGE,AGE\ny,3,4,5\n")
    (tmp_path / "short.csv").write_text("only one line\n")
    for lines in (True, False):
        got = tables.two_row_header(spark, str(tmp_path), lines)
        assert got.columns == ["ID", "AGE", "H", "AGE.1"]
        assert rows_of(got) == sorted([("1", "3", "x", None), ("ID", "AGE", "H", None), (None, "GENERAL", None, None), ("2", None, None, None), ("3", "4", "y", "5")], key=str)
    assert tables.bands(spark, str(tmp_path)) == {"ID": "", "AGE": "GENERAL", "H": "GENERAL", "AGE.1": "GENERAL"}
    with pytest.raises(FileNotFoundError):
        tables.two_row_header(spark, str(tmp_path / "short.csv"))


def test_large_files_are_split_once(spark, tmp_path):
    """Only the split that begins a file lacks two lines."""
    lines = [f"{i},{i * 2}" for i in range(20_000)]
    (tmp_path / "big.csv").write_text("\n".join([",B", "ID,V", *lines]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = tables.two_row_header(spark, str(tmp_path))
        assert sorted(int(r.ID) for r in got.collect()) == list(range(20_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_and_a_workbook_feed_the_tables(spark, tmp_path):
    """Two text files whose columns come in different orders, and workbooks with headers of their own, through the whole track."""
    co = sites.SITES["CO"]
    names = [co.columns["ID"], co.columns["TYPE"], *sorted({s for c in sites.COLUMNS[2:] for s in (co.means.get(c) or ((co.columns[c],) if c in co.columns else ()))})]
    (tmp_path / "csv").mkdir()
    for k, order in enumerate((names, names[::-1])):
        body = [[{names[0]: f"s{k}{i}", names[1]: "ST"}.get(n, str(50 + i)) for n in order] for i in range(3)]
        (tmp_path / f"csv/{k}.csv").write_text("\n".join(",".join(r) for r in [["B"] * len(order), order, *body]) + "\n")
    br = sites.SITES["BR"]
    used = [br.columns["ID"], br.columns["TYPE"], br.columns["HEIGHT_cm"], *sorted({s for c in sites.COLUMNS[2:] for s in (br.means.get(c) or ((br.columns[c],) if c in br.columns else ()))} - {br.columns["HEIGHT_cm"]})]
    more = len(used) - 3
    (tmp_path / "a.xlsx").write_bytes(workbook_bytes({"Clean": [["b"], used[:20], ["b1", "ST", 170, *([60] * min(more, 17))]]}))
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes({"Clean": [["b"], [used[2], used[0], used[1], *used[20:]], [180, "b2", "CN", *([61] * (len(used) - 20))]]}))
    raw = {"CO": tables.two_row_header(spark, str(tmp_path / "csv")), "BR": workbook.table(workbook.sheets(spark, str(tmp_path)), "Clean", 2)}
    out = tracks.tabular(raw, "salt")
    got = {r.ID: r.site for r in out["mapping"].collect()}
    assert got == {f"s{k}{i}": "CO" for k in range(2) for i in range(3)} | {"b1": "BR", "b2": "BR"}
    known = {r.site: (r.n, r.h, r.w) for r in out["preprocessed"].groupBy("site").agg(F.count("*").alias("n"), F.max("HEIGHT_cm").alias("h"), F.count("WEIGHT_kg").alias("w")).collect()}
    assert known == {"CO": (6, 52.0, 6), "BR": (2, 180.0, 1)}  # each workbook has a part of the columns
