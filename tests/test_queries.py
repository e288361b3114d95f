"""Every registered query against its SQL, on the smallest test tables."""

import hashlib
import os

import pytest

import __spark_entry__ as entry
from casemill.bindings import ORACLES, QUERIES
from tests.harness import compare, sql_connection

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return sql_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert entry.queries()[name](spark, SF_DIR).limit(1).count() == 1


def test_metrics_are_those_of_the_predictions(spark):
    """The best number of epochs, recomputed from what its model says about the test part."""
    history = entry.queries()["text_clf_metrics"](spark, SF_DIR).collect()
    best = max(history, key=lambda r: r.macro_f1)
    rows = [r for r in entry.queries()["text_clf_predictions"](spark, SF_DIR).collect() if r.label is not None]
    in_test = {r.doc_id for r in rows if int(hashlib.md5(f"0|{r.doc_id}".encode()).hexdigest()[:8], 16) % 10000 < 2000}
    pairs = [(r.label, int(r.prediction == "POSITIVE")) for r in rows if r.doc_id in in_test]
    scores = []
    for c in {y for pair in pairs for y in pair}:
        hit, said, true = (sum(f) for f in ([y == p == c for y, p in pairs], [p == c for _, p in pairs], [y == c for y, _ in pairs]))
        scores.append(2 * hit / (said + true))
    assert sum(scores) / len(scores) == pytest.approx(best.macro_f1)
    assert sum(y == p for y, p in pairs) / len(pairs) == pytest.approx(best.accuracy)
    assert best.macro_f1 > max(2 * n / (len(pairs) + n) / 2 for n in (sum(y == c for y, _ in pairs) for c in (0, 1)))


def test_entry(spark):
    assert entry.entry(spark).columns == ["decision_id", "decision_outcome"]


# Queries that score long lists with the similarity function or call the user's tagger.
WITH_PYTHON = {
    "reconcile_names",
    "tag_with_hook",
    "cover_features_from_files",
    "labelled_covers",
    "examples_from_corpus",
}
# Queries that read delimited files back in which quoted fields hold line breaks: records are joined from lines in batches.
WITH_PYTHON |= {"read_delimited", "reject_report", "csv_roundtrip", "sharded_sink", "merge_shards"}
# Training runs jobs while the query is built; their plans are Spark ML's own.
TRAINING = {"train_text_clf", "tune_text_clf", "score_text_clf", "text_clf_metrics", "text_clf_epochs", "text_clf_predictions"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINING))
def test_plan(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert name in WITH_PYTHON or not any(n in plan for n in ("EvalPython", "InPandas", "InArrow"))


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["drop_unlabelled"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(quality)" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
