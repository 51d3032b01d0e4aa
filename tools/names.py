"""Print the query names registered by one plans module."""

import importlib
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from kinelake.plans import MODULES, registry  # noqa: E402

for m in MODULES:
    before = set(registry.QUERIES)
    importlib.import_module(f"kinelake.plans.{m}")
    if m in sys.argv[1:]:
        print(" ".join(n for n in registry.QUERIES if n not in before))
