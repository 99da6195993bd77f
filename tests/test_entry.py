import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("blocked", ["ahocorasick", "tokenizers", "sightline.llm", "corpus_pipeline"])
def test_entry_without_an_optional_module(blocked):
    """A module that can't be imported takes the training-data operators away and nothing else."""
    code = f"import sys, warnings; warnings.simplefilter('ignore'); sys.modules[{blocked!r}] = None; import __spark_entry__ as e; print(*sorted(e.queries()))"
    names = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert "reconcile_left_join" in names and len(names) > 80 and not [n for n in names if n.startswith("op") or n == "pipeline"]
