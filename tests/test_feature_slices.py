import pyarrow as pa

from frostline.operators import features
from frostline.params import REPAIR


def test_features_come_in_slices():
    n = 200
    frames = pa.RecordBatch.from_pydict({
        "video_id": pa.array([0] * n, pa.int64()), "frame_num": pa.array(range(n), pa.int64()), "ts_s": pa.array([0.0] * n),
        "width": pa.array([16] * n, pa.int32()), "height": pa.array([16] * n, pa.int32()), "data": pa.array([bytes([i]) * 768 for i in range(n)], pa.binary()),
    })
    out = list(features._features(REPAIR)(iter([frames])))
    assert max(b.num_rows for b in out) == features.SLICE and [x for b in out for x in b.column(1).to_pylist()] == list(range(n))
