"""Executors need no copy of the package: queries run from another folder."""

import subprocess
import sys
from pathlib import Path

from .conftest import SF

CODE = """
import sys
sys.path.insert(0, {root!r})
from kestrine.session import session
from kestrine import plans
spark = session("local[2]", 2)
for q in ("bilateral_filter", "weighted_trend", "point_in_polygon", "distance_to_shapes"):
    assert plans.queries()[q](spark, {sf!r}).count() > 0
print("fine")
"""


def test_from_another_folder(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    got = subprocess.run([sys.executable, "-c", CODE.format(root=root, sf=SF)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert got.stdout.strip().endswith("fine"), got.stderr[-2000:]
