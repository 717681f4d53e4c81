"""Merged suggestions over all tag rows."""

from __future__ import annotations

from paths import SF

from shoal.queries import QUERIES
from shoal.sources.views import Tables


def test_suggestions_count_every_tag_row(spark):
    got = QUERIES["suggest_merged_all"](spark, SF)
    assert got.where("kind = 0").agg({"n": "sum"}).first()[0] == Tables(spark, SF).asset_tags.count()


def test_places_need_no_single_task(spark):
    plan = QUERIES["suggest_merged"](spark, SF)._jdf.queryExecution().toString()
    ranks = [line for line in plan.splitlines() if "Window [row_number()" in line]
    assert ranks and all("windowspecdefinition(_p#" in line for line in ranks)
