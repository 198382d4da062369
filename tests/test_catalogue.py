"""Queries and their SQL agree on the smallest tables, where they are there."""

import os

import duckdb
import pandas as pd
import pytest

from stratasieve.plans import catalogue, inputs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SAMPLE = ["detect_env_tokens", "detect_github_token", "detect_jwt", "detect_entropy", "detect_aws_profiles", "detect_keyword_library", "match_precedence", "discard_placeholders", "classify_disposition", "redact_values", "snippets", "dedup_public", "dedup_detailed", "cap_low_confidence", "flatten_config", "select_descriptors", "parse_references", "replay_final", "replay_deleted", "replay_hardlinks", "target_counters", "tag_counters", "fill_platform", "match_locations", "store_roundtrip", "error_summaries", "upsert_manifests", "replace_tags", "tag_records", "manifest_merge", "list_repository_findings_all"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in inputs.TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def frame(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].map(lambda v: "" if v is None or v is pd.NaT or v != v else str(v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    assert frame(catalogue.QUERIES[name](spark, SF).toPandas()).equals(frame(con.sql(catalogue.SQL[name]).df()))
