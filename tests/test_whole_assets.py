"""Queries over all assets."""

from __future__ import annotations

from paths import SF

from shoal.queries import QUERIES
from shoal.sources.views import Tables


def test_every_asset_has_its_row(spark):
    assets = Tables(spark, SF).assets
    assert QUERIES["image_details_all"](spark, SF).count() == assets.where("NOT is_deleted").count()
    assert QUERIES["gallery_position_all"](spark, SF).count() == assets.where("NOT is_deleted AND NOT is_missing").count()


def test_epochs_of_every_asset(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "/a/1652448237.png"), (5, "/a/1652448238.png")], "id long, path string")
    monkeypatch.setattr(Tables, "__getattr__", lambda self, name: rows)
    assert {r.id for r in QUERIES["parse_epoch"](spark, SF).collect()} == {1, 5}
