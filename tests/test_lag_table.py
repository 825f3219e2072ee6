from pathlib import Path

import pytest

from frostline.plans import files
from frostline.sources import frames as S
from frostline.sources import staging


def test_lags_of_many_videos_are_few_files(spark, tmp_path):
    rows = [(v, 10 * (i * 7 % 4), 2) for v in range(300) for i in range(4)] + [(None, 1, 2)]
    S.write_lag_table(spark.createDataFrame(rows, "video_id long, start long, length long"), str(tmp_path / "lags"))
    found = list((tmp_path / "lags").glob("*.csv"))
    assert len(found) <= 4
    lines = [[line.split(",") for line in p.read_text().split()] for p in found]
    assert all([x[1:] for x in part if x[0] == v] == [[str(10 * i), "2"] for i in range(4)] for part in lines for v in {x[0] for x in part} if v.isdigit())
    assert sorted(map(str, map(tuple, S.read_lag_table(spark, str(tmp_path / "lags")).collect()))) == sorted(map(str, rows))
    (tmp_path / "lags" / "bad.csv").write_text("1,x,2\n")
    with pytest.raises(Exception, match="MALFORMED"):
        S.read_lag_table(spark, str(tmp_path / "lags")).collect()


def test_lag_files_are_few(spark):
    rows = files.lag_files(spark, "/root/testdata/sf0.001")
    found = list(Path(staging._STAGED[-1].removeprefix("file:")).rglob("*.csv"))
    assert len(found) <= 4 < rows.select("video_id").distinct().count()
