from __future__ import annotations

import subprocess
import sys

from tests.conftest import ROOT


def test_entry_works_in_a_fresh_process():
    code = "import __spark_entry__ as e; from platewise.session import local_session; print('rows', e.entry(local_session('4', '4', 'entry')).count())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300, check=False)
    assert "rows 5" in out.stdout, out.stderr[-2000:]
