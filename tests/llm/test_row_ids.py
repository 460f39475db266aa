import corpus_pipeline as cp
import pytest

from gridloom.llm import suffix_array_dedup as op

from test_suffix_array_dedup import COLUMNS, brute

TOGETHER = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "0"}
APART = {"spark.sql.files.minPartitionNum": "100", "spark.sql.files.openCostInBytes": "0"}


@pytest.fixture
def other_splits(spark, docs, tmp_path, monkeypatch):
    """docs in several files, whose scans are split in another way after runs have been written."""
    docs.write.parquet(f"file://{tmp_path}/docs")
    for k, v in TOGETHER.items():
        spark.conf.set(k, v)
    plain = op.materialised

    def stored(df, name):
        out = plain(df, name)
        if name == "runs":
            for k, v in APART.items():
                spark.conf.set(k, v)
        return out

    monkeypatch.setattr(op, "materialised", stored)
    yield spark.read.parquet(f"file://{tmp_path}/docs")
    for k in TOGETHER:
        spark.conf.unset(k)


def test_scans_split_anew(other_splits, rows):
    got = {r[0]: tuple(r[1:]) for r in op.deduplicated(other_splits).selectExpr(*COLUMNS).collect()}
    assert got == brute(rows, 100)


def test_stage_with_scans_split_anew(spark, other_splits, rows):
    got = {r["doc_id"]: len((r["text"] or "").encode()) for r in cp.drop_repeated_substrings(spark, other_splits, "").collect() if r["doc_id"] not in (12, 13)}
    assert got == {i: x[0] - x[1] for i, x in brute(rows, 100).items() if i not in (12, 13)}
