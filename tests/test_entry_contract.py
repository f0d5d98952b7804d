"""The driver contract from a fresh interpreter in another working directory: entry() first, with a
plain session (no checkpoint directory, package not on the workers' path)."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_from_fresh_process(tmp_path):
    code = textwrap.dedent(f"""
        import importlib.util
        from pyspark.sql import SparkSession
        spec = importlib.util.spec_from_file_location("entry_mod", {os.path.join(ROOT, '__spark_entry__.py')!r})
        m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        df = m.entry(spark)
        print("ENTRY", df.count(), ",".join(df.columns))
        print("RADIUS", m.queries()["radius_pairs"](spark, "/root/testdata/sf0.001").count())
        spark.stop()
    """)
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True, timeout=600)
    assert "ENTRY 10 definition,all_preferred_names,count" in out.stdout, out.stderr[-2000:]
    assert "RADIUS 66" in out.stdout, out.stderr[-2000:]
