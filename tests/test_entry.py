"""The entry keeps the library's own queries where the tokenizers' module is missing."""

import subprocess
import sys

from conftest import ROOT

CODE = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == "public_tokenizers":
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as entry
assert len(entry.queries()) > 70 and "session_features" in entry.oracle_sql()
"""


def test_entry_without_tokenizers():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True)
