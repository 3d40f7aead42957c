import os
import shutil
import subprocess
import sys

import __spark_entry__ as E
from penmark.streaming import features_stream
from tests.conftest import SF001


def test_entry_smoke(spark):
    df = E.entry(spark)
    out = df.collect()
    assert len(out) == 20 and "lexical_diversity" in df.columns


def test_registry_and_oracles_consistent():
    qs, os_ = E.queries(), E.oracle_sql()
    assert set(os_) <= set(qs)
    assert len(qs) >= 80


def test_stream_matches_batch(spark, tmp_path):
    schema = spark.read.parquet(f"{SF001}/documents.parquet").schema
    q = features_stream.start(spark, SF001, str(tmp_path / "sink"), str(tmp_path / "ckpt"), schema,
                              glob="documents.parquet")
    q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "sink"))
    assert got.count() == 200 and len(got.columns) == 89


def test_entry_without_the_optional_folders(tmp_path):
    """With or without corpus_pipeline.py, the rest registers when the optional subpackage is gone."""
    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(os.path.join(root, "penmark"), tmp_path / "penmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    names = ["__spark_entry__.py"] + [n for n in ("corpus_pipeline.py",) if os.path.exists(os.path.join(root, n))]
    for n in names:
        shutil.copy(os.path.join(root, n), tmp_path)
    code = ("import __spark_entry__ as E; q, o = E.queries(), E.oracle_sql(); assert set(o) <= set(q) and len(q) > 80; "
            "assert not any(k.startswith('op') or k == 'pipeline' for k in q)")
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
