"""Queries against their SQL on tables whose keys are as large, or whose counts as odd, as those of larger copies."""

import pytest

from callweave.plans import queries  # noqa: F401  registers
from callweave.registry import ORACLES, QUERIES
from tests.compare import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Users whose numbers end as hotlines do, numbers of events of seven digits, and a last call of one voice."""
    out = tmp_path_factory.mktemp("large")
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "events":
            user = "case event_id % 10 when 0 then 10086 when 1 then 95588 when 2 then 210010 else user_id end"
            event = "case event_id % 4 when 1 then event_id + 1000000 when 2 then event_id + 2011100 else event_id end"
            df = df.selectExpr(*[f"{user} as user_id" if c == "user_id" else f"{event} as event_id" if c == "event_id" else c for c in df.columns])
        if t == "embeddings":
            n = df.count()
            df = df.where(f"vec_id <= {n // 5 * 5 - 5}")
        df.coalesce(1).write.parquet(f"{out}/{t}.parquet")
    return out


def same(spark, folder, name):
    got, want = compare(spark, QUERIES[name], ORACLES[name], folder)
    assert got == want


@pytest.mark.parametrize("name", ["d13_classify_calls", "v8_seed_contacts", "l10_line_counts", "q16_line_preview"])
def test_mobiles_that_end_as_hotlines_do(spark, folder, name):
    same(spark, folder, name)


def test_numbers_of_events_that_look_like_landlines_or_dates(spark, folder):
    same(spark, folder, "s3_refresh_hints")


@pytest.mark.parametrize("name", ["l2_cluster_line", "l2_line_voices", "l4_split_decision", "l3_cluster_separation", "l5_cluster_cohesion"])
def test_a_last_call_of_one_voiced_segment(spark, folder, name):
    same(spark, folder, name)
