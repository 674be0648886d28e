from __future__ import annotations

from importlib.util import find_spec

import pytest

from brindle.operators import bow, spatial
from brindle.sources import media


def test_sizes_and_segments():
    assert media.scaled_size(2048, 1000) == (1024, 500) and media.scaled_size(10, 20) == (10, 20)
    assert media.segment_bounds(12.6) == [(0.0, 5.0), (5.0, 10.0), (10.0, 12.6)] and media.segment_bounds(2.0) == []


@pytest.mark.skipif(find_spec("cv2") is not None or find_spec("librosa") is not None, reason="decoders are there")
def test_missing_decoders_say_so(spark, tmp_path):
    for f in (media.image_descriptors, media.audio_descriptors):
        with pytest.raises(media.MissingLibrary):
            f(spark, str(tmp_path))


def test_codebook_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(i % 3, [float(i % 2) * 9, 0.0]) for i in range(40)], "id long, v array<double>")
    code = bow.train_codebook(d, "v", 2)
    counts = bow.histograms(d, "id", "v", code)
    idf = bow.smoothed_idf(counts, "id")
    bow.save_codebook(spark, code, idf, str(tmp_path / "c"))
    again, same = bow.load_codebook(spark, str(tmp_path / "c"))
    assert sorted(code) == [[0.0, 0.0], [9.0, 0.0]] and again == code
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, idf.collect()))


def test_workload_equals_a_sequential_scan(spark):
    points = spatial.random_points(spark, 500, seed=3)
    again = spatial.random_points(spark, 500, seed=3).repartition(3)
    rows = sorted(tuple(r) for r in points.collect())
    assert rows == sorted(tuple(r) for r in again.collect()) and all(-77.2 <= x <= -76.9 and -12.2 <= y <= -11.9 for _, x, y in rows)
    near = {r.id for r in spatial.radius_search(points, -77.0, -12.0, 5000.0, "haversine").collect()}
    ranked = [r.id for r in spatial.knn(points, -77.0, -12.0, len(near), "id", "haversine").collect()]
    assert near == set(ranked) and len(near) > 3
