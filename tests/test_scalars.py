from pyspark.sql import functions as F

from treeledger.functions import scalars as s
from treeledger.functions.regions import HashSpec, plan_regions

MIB = 1 << 20


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_ext(spark):
    names = [("a.JPG",), ("a.b.c",), (".bashrc",), ("a.",), ("none",), ("x.y\nz",), (None,)]
    assert [v for v, in values(spark, names, "n string", s.ext(F.col("n")))] == ["jpg", "c", "", "", "", "y\nz", None]


def test_mtime_match(spark):
    pairs = [("2020-01-01_10:00:00", "2020-01-01_10:00:02"), ("2020-01-01_10:00:00", "2020-01-01_10:00:03"), ("2020-01-01_10:00:00", "2020-01-02_00:00:00"), ("2020-01-01_10:00:00", "2020-01-02_01:00:00"), ("junk", "junk"), ("junk", "other"), (None, None), ("2020-13-01_00:00:00", "2020-01-01_00:00:00")]
    assert [v for v, in values(spark, pairs, "a string, b string", s.mtime_match(F.col("a"), F.col("b")))] == ["strong", None, "moderate", None, "strong", None, None, None]


def test_search(spark):
    names = [(n,) for n in ("Août 2021.tif", "SC_0815.tif", "was-SC_7.tif.old", "letter 3.odt", "crêpes.txt", "mnxnp", None)]
    hits = lambda q, cs=False: [n for n, ok in values(spark, names, "n string", "n", s.search_match(F.col("n"), q, cs)) if ok]
    assert hits("août") == ["Août 2021.tif"] and hits("août", True) == []
    assert hits("SC_*.tif") == ["SC_0815.tif", "was-SC_7.tif.old"]
    assert hits("letter ?.odt") == ["letter 3.odt"] and hits("cr?p?s") == ["crêpes.txt"] and hits("m*np") == ["mnxnp"]
    assert len(hits("*")) == 6 and len(hits("")) == 6


def test_labels(spark):
    sizes = [(0,), (100,), (2000,), (1 << 33,)]
    assert [v for v, in values(spark, sizes, "n long", s.size_bucket(F.col("n")))] == ["00. empty", "01. <1K", "02. 1K-4K", "14. >=8G"]
    assert [v for v, in values(spark, sizes, "n long", s.format_bytes(F.col("n")))] == ["0 B", "100 B", "2.0 KB", "8.0 GB"]
    assert s.snap_match_floor(46) == 55 and s.snap_match_floor(100.5) == 100
    order = [r.n for r in spark.createDataFrame([("f10", "file"), ("F2", "file"), ("z", "directory")], "n string, t string").orderBy(*s.tree_order(F.col("t"), F.col("n"), F.col("n"))).collect()]
    assert order == ["z", "F2", "f10"]


def test_times_widths_and_paths(spark):
    times = [("2021-03-04_05:06:07",), ("a_b_c",), ("",), (None,)]
    assert [v for v, in values(spark, times, "t string", s.format_time(F.col("t")))] == ["2021-03-04 05:06:07", "a b_c", "—", "—"]
    assert [s.widest_bytes(n) for n in (0, 9, 1023, 1024, 1 << 40)] == [3, 3, 6, 6, 7]
    paths = [("a//b\\c",), ("",), ("one",)]
    assert [v for v, in values(spark, paths, "p string", s.path_segments(F.col("p")))] == [["a", "b", "c"], [], ["one"]]
    assert [v for v, in values(spark, paths, "p string", s.join_path(s.path_segments(F.col("p"))))] == ["a/b/c", "", "one"]
    names = [("Trio-TRIO.flac",), ("solo",)]
    assert [v for v, in values(spark, names, "n string", s.highlights(F.col("n"), "trio"))] == [["Trio", "TRIO"], []]
    assert [v for v, in values(spark, names, "n string", s.highlights(F.col("n"), "s?l", True))] == [[], ["sol"]]


def test_regions():
    spec = HashSpec(8 * MIB, MIB, 8)
    assert plan_regions(0, spec) == [] and plan_regions(5, spec) == [(0, 5)]
    assert plan_regions(8 * MIB, spec) == [(0, MIB), (7 * MIB, 8 * MIB)]
    assert len(plan_regions(1 << 40, spec)) == 8
    assert plan_regions(100, HashSpec(10, 200, 8)) == [(0, 100)]
    assert all(b <= c for (_, b), (c, _) in zip(plan_regions(40 * MIB, spec), plan_regions(40 * MIB, spec)[1:]))
    assert HashSpec.parse(str(spec)) == spec and HashSpec.parse(str(HashSpec(None))) == HashSpec(None)
