"""The package has to reach the workers by itself."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from curbside.session import build_session
from curbside.operators.html import extract_search_rows
spark = build_session("away", "local[2]", **{{"spark.ui.enabled": "false", "spark.checkpoint.dir": {shared!r}}})
page = '<li class="cl-search-result"><a class="cl-app-anchor" href="/d/1">T</a></li>'
df = spark.createDataFrame([(1, page)], "page_id long, html string")
assert [r["url"] for r in extract_search_rows(df).collect()] == ["/d/1"]
print("read")
"""


def test_query_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=root, shared=str(tmp_path / "shared"))
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "read" in out.stdout, out.stderr[-2000:]
