"""Write the formatted physical plan of every headline query to a folder.

    python tools/explain_plans.py OUT_DIR [sf_dir]

Used to review pushdown (PushedFilters / ReadSchema), exchanges, broadcast
choices and whole-stage codegen spans after a change.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from pricewire.plans import catalog  # noqa: E402
from pricewire.session import local_session  # noqa: E402


def main() -> None:
    out = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    os.makedirs(out, exist_ok=True)
    spark = local_session()
    qs = catalog.queries()
    for name in HEADLINE:
        df = qs[name](spark, sf_dir)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        with open(os.path.join(out, f"{name}.txt"), "w") as f:
            f.write(plan)
        nodes = [ln for ln in plan.splitlines() if ln[:1] == "(" and ") " in ln[:6]]
        n_ex = sum(1 for ln in nodes if ln.split(") ", 1)[1].startswith("Exchange"))
        n_bc = sum(1 for ln in nodes if ln.split(") ", 1)[1].startswith("BroadcastExchange"))
        print(f"{name}: {n_ex} shuffles, {n_bc} broadcasts")


if __name__ == "__main__":
    main()
