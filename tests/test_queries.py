"""Every query of the core against its SQL, and the others for a stable schema and rows."""

import pytest
from compare import FOLDER, compare

from tunewright.plans import catalog

ORACLE, QUERIES = catalog.oracle_sql(), catalog.queries()
EMPTY = {"avoid_words", "near_dup_verify"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    assert compare(spark, FOLDER, QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"sampled_generation", "paired_comparison", "repair_rerank", "viterbi_lead", "transcribed_melody", "wav_render", "stream_first_seen"}))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns
    assert df.count() > 0 or name in EMPTY


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
