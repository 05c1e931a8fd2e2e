"""Print the physical plan of registered queries.

Usage: python tools/explain.py <sf_dir> <query> [mode]   (mode: formatted | simple | cost)
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from frostline.plans import catalog  # noqa: E402
from frostline.session import get_session  # noqa: E402


def main() -> None:
    sf_dir, name = sys.argv[1], sys.argv[2]
    mode = sys.argv[3] if len(sys.argv) > 3 else "formatted"
    spark = get_session("local[8]", shuffle_partitions=8)
    catalog.load_all()
    catalog.QUERIES[name](spark, sf_dir).explain(mode)
    spark.stop()


if __name__ == "__main__":
    main()
