"""Print the formatted physical plan of registered queries (after running them once so
AQE shows the final plan). usage: python tools/plans.py [sf_dir] name [name ...]"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vetta.plans.catalog import QUERIES  # noqa: E402
from vetta.session import local_session  # noqa: E402


def main():
    d = sys.argv[1]
    spark = local_session(8)
    for name in sys.argv[2:]:
        df = QUERIES[name][0](spark, d)
        df.write.format("noop").mode("overwrite").save()
        print(f"===== {name}")
        df.explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
