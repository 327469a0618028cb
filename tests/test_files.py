"""Documents found in folders, and sketches that merge."""

from pyspark.sql import functions as F

from docrec.operators import detection as de
from docrec.sources import pages


def test_inventory_of_a_folder(spark, tmp_path):
    (tmp_path / "below").mkdir()
    for name, content in {"a.pdf": b"one", "b.PDF": b"two", "below/c.Tif": b"one", "d.exe": b"one", "e.png": b"", "noext": b"x", "below/f.jpeg": b"\xff\x00"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[-1]: (r["copies"], r["bytes"]) for r in pages.inventory_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": (2, 3), "b.PDF": (1, 3), "f.jpeg": (1, 2)}
    seen = spark.createDataFrame([r.asDict() for r in pages.inventory_files(spark, str(tmp_path)).select("ident").collect()])
    (tmp_path / "new.bmp").write_bytes(b"three")
    (tmp_path / "copy.pdf").write_bytes(b"two")
    assert [r["path"].rsplit("/", 1)[-1] for r in pages.inventory_files(spark, str(tmp_path), seen).collect()] == ["new.bmp"]


def test_sketches_merge(spark):
    docs = spark.range(4000).select((F.col("id") % 5).alias("day"), F.concat(F.lit("ABCU"), F.lpad((F.col("id") % 3000).cast("string"), 7, "0"), F.lit(" ABCU0000001")).alias("text"))
    sketches = de.number_sketches(docs, de.ISO, "day")
    assert sketches.count() == 5 and abs(de.merged_totals(sketches).first()["estimate"] - 3000) < 120
    assert all(abs(r["estimate"] - n) < 40 for r, n in ((r, docs.where(F.col("day") == r["day"]).select("text").distinct().count() + 1) for r in de.merged_totals(sketches, "day").collect()))
    assert de.merged_totals(sketches.limit(0), "day").count() == 0
