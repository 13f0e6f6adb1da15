"""python -m brindle audit DATA CONFIG | tune DATA CONFIG"""

from __future__ import annotations

import argparse
import sys

from brindle.plans.config import LEVELS


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="brindle", description=__doc__)
    parser.add_argument("workflow", choices=["audit", "tune"])
    parser.add_argument("data", help="a Parquet table")
    parser.add_argument("config", help="a YAML configuration")
    parser.add_argument("--log-level", type=str.upper, choices=LEVELS)
    parser.add_argument("--file-log-level", type=str.upper, choices=LEVELS)
    given = parser.parse_args(args)
    from brindle.plans.session import session

    try:
        if given.workflow == "audit":
            from brindle.plans.audit import audit as run
        else:
            from brindle.plans.tuning import tune as run
        print(run(session(), given.data, given.config, given.log_level, given.file_log_level))
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        if not getattr(e, "in_run_log", False):
            print(f"brindle: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
