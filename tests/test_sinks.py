"""Features as they are written."""

import json

from gridsift.sources import sinks


def test_no_negative_zero_is_written(spark):
    rows = spark.createDataFrame([(1, -0.0), (2, 0.0), (3, -0.5)], "rank long, score double").selectExpr("rank", "'S-1' as site_id", "'x' as rating", "score", "0D as x", "0D as y")
    got = {r["rank"]: r["json"] for r in sinks.features(rows, 5.0).collect()}
    assert got[1].replace('"rank":1', '"rank":2') == got[2] and "-0.0" not in got[1]
    assert json.loads(got[3])["properties"]["score"] == -0.5
