"""Modules are imported by workers too, where there is no session."""

import subprocess
import sys
from pathlib import Path


def test_every_module_is_imported_without_a_session():
    code = "import pkgutil, importlib, wordmosaic, __spark_entry__\nfor m in pkgutil.walk_packages(wordmosaic.__path__, 'wordmosaic.'): importlib.import_module(m.name)\nassert __spark_entry__.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True, timeout=120)
