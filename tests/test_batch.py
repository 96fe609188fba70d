"""The read-through cache, and edges of the batch run."""

from pyspark.sql import functions as F

from tessella.operators import batch as B
from tessella.operators import refit as RF
from tessella.operators import sequences as Q


def test_prepared(spark, tmp_path):
    """A table is built once, kept while it is among the newest, and built again where its write was cut off."""
    built = []

    def make(k):
        def build():
            built.append(k)
            return spark.createDataFrame([(k,)], "k int")

        return build

    at = str(tmp_path)
    for k in (1, 1, 2, 3, 1, 4, 5):
        assert [r["k"] for r in B.prepared(spark, at, f"key{k}", make(k)).collect()] == [k]
    assert built == [1, 2, 3, 4, 5]
    left = sorted(p.name for p in tmp_path.glob("key*"))
    assert len(left) == 3 and "key5" in left
    (tmp_path / "key5" / "_SUCCESS").unlink()
    B.prepared(spark, at, "key5", make(5))
    assert built == [1, 2, 3, 4, 5, 5]


def test_pieces(spark):
    """A row through three tiles, one outside, one along a border, one without length."""
    rows = spark.createDataFrame([("a", 5.0, 5.0, 25.0, 5.0), ("b", -9.0, -9.0, -1.0, -1.0), ("c", 10.0, 0.0, 10.0, 8.0), ("d", 3.0, 3.0, 3.0, 3.0)], "row_id string, x0 double, y0 double, x1 double, y1 double")
    tiles = spark.createDataFrame([(f"t{k}", k * 10.0, 0.0, k * 10.0 + 10, 10.0) for k in range(3)], "tile string, left double, low double, right double, high double")
    got = sorted((r["row_id"], r["tile"], r["start"], r["end"]) for r in B.row_pieces(rows, tiles, 10.0).collect())
    assert got == [("a", "t0", 0.0, 5.0), ("a", "t1", 5.0, 15.0), ("a", "t2", 15.0, 20.0), ("c", "t0", 0.0, 8.0), ("c", "t1", 0.0, 8.0)]
    px = spark.createDataFrame([], "row long, col long, green boolean")
    out = B.classified_rows(B.row_pieces(rows, tiles, 10.0), px, 1.0, 0.5).collect()
    assert len(out) == 5 and {r["row_structure"] for r in out} <= {"regular", "unassessable", "disrupted"}
    assert B.classified_areas(rows.withColumnRenamed("row_id", "id").limit(0), tiles, px, 1.0, 10.0).count() == 0


def test_numbered(spark):
    df = spark.createDataFrame([((i * 7919) % 5003,) for i in range(5003)], "v int").repartition(7)
    got = sorted((r["v"], r["place"]) for r in Q.numbered(df, [F.desc("v")], "place").collect())
    assert got == [(v, 5003 - v) for v in range(5003)]
    assert Q.numbered(df.limit(0), [F.desc("v")], "place").count() == 0


def test_shared_fit_finds_the_slope(spark):
    """Outliers go in the first rounds; a row far from all keeps its own offset."""
    rows = [("p", r, u / 2, 0.02 * u / 2 + r + (5.0 if u % 9 == 0 else 0.0), 1.0) for r in range(3) for u in range(60)]
    out = RF.shared_fit(spark.createDataFrame(rows, "p string, r int, u double, v double, w double"), "p", "r", "u", "v", "w").collect()
    assert all(abs(r["slope"] - 0.02) < 1e-9 and abs(r["offset"] - r["r"]) < 1e-9 and r["n"] > 40 for r in out)
