"""The entry point without a package that only the corpus operators need."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_entry_without_xxhash():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 50 and not [k for k in [*q, *s] if k == 'pipeline' or k.startswith('op1')], q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_with_all():
    code = "import __spark_entry__ as e; q = e.queries(); assert len([k for k in q if k.startswith('op') and k[2].isdigit()]) == 10 and 'pipeline' in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
