"""Python workers need no copy of the package."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_from_another_folder(folder):
    with open(f"{folder}/t.csv", "w") as f:
        f.write("a;b\n1;2\n")
    code = f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from tamiz.session import local_session
        from tamiz.operators import retrieve, throttle
        from tamiz.sources.csv import load_csv
        spark = local_session(2)
        log = spark.range(50).selectExpr("id % 3 AS client", "id AS t", "id AS event_id")
        assert throttle.admitted(log, limit=1, window=100).where("admitted").count() == 3
        v = spark.sql("SELECT 'd' AS doc_name, 1 AS chunk_id, array(1.0f, 0.0f) AS embedding, 1 AS query_id")
        assert retrieve.top_k(v, v).count() == 1
        assert load_csv(spark, {folder + '/t.csv'!r}).df.columns == ["a", "b"]
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", textwrap.dedent(code)], cwd=folder, env=env, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
