from pathlib import Path

from frostline.plans import mechanisms
from frostline.sources import images, staging


def test_pictures_in_archives(spark, tmp_path):
    rows = [(f"{i % 7}/{i}.png", 1 + i % 3, 2, bytes(range(2 * (1 + i % 3)))) for i in range(500)]
    pictures = spark.createDataFrame(rows, "name string, width int, height int, data binary")
    images.write_archives(pictures, str(tmp_path))
    assert {p.suffix for p in tmp_path.iterdir()} == {".zip"} and len(list(tmp_path.iterdir())) <= 4  # one for each task
    assert sorted((r.name, r.width, r.height, bytes(r.data)) for r in images.read_archives(spark, str(tmp_path)).collect()) == sorted(rows)
    images.write_archives(pictures.limit(1), str(tmp_path))
    assert images.read_archives(spark, str(tmp_path)).count() == 501


def test_boundary_pictures_make_few_files(spark):
    rows = mechanisms.boundary_pictures(spark, "/root/testdata/sf0.001")
    found = [p for p in Path(staging._STAGED[-1].removeprefix("file:")).rglob("*") if p.is_file()]
    assert rows.count() > 50 >= len(found)


def test_no_archives(spark, tmp_path):
    images.write_archives(spark.createDataFrame([], "name string, width int, height int, data binary"), str(tmp_path))
    assert images.read_archives(spark, str(tmp_path)).count() == 0
