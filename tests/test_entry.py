"""The entry module loads and lists its queries before any Spark session exists."""

import subprocess
import sys
from pathlib import Path


def test_listing_needs_no_session():
    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
