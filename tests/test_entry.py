import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; from ledgerlark.plans import catalog; q = e.queries(); print(len(set(q) - set(catalog.QUERIES)), set(catalog.QUERIES) <= set(q))"


def test_a_missing_dependency_of_the_training_data_operators_leaves_the_others():
    code = "import sys; sys.modules['xxhash'] = None; sys.modules['tokenizers'] = None; " + COUNT
    told = subprocess.run([sys.executable, "-c", code], cwd=HERE, capture_output=True, text=True, check=True)
    assert told.stdout.split() == ["0", "True"]
