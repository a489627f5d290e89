"""python -m plumbline.cli scan|merge --config FILE --run-id ID [--repo DIR] [--out DIR] [--axes A,B] [--waive CODE ...] [--run-commands]

--run-commands: run the shell commands that the configuration declares as measurements.
Exit: 0 passed, 1 blocked, 2 could not run."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from plumbline.context import load_config, parse_cli_args
from plumbline.plans.merge import run_merge
from plumbline.plans.scan import gate_blocked, run_scan
from plumbline.registry import core_axes, load_axes, parse_axis_selection


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    try:
        if argv[:1] not in (["scan"], ["merge"]):
            raise ValueError(__doc__)
        commands = "--run-commands" in argv[1:]
        args = parse_cli_args([a for a in argv[1:] if a != "--run-commands"], ("config", "repo", "run-id", "out", "axes"), ("waive",) if argv[0] == "merge" else (), ("config", "run-id"))
        context = load_config(args["config"], args["repo"])
        only = parse_axis_selection(args["axes"])
        spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
        if argv[0] == "scan":
            scan, _, _ = run_scan(spark, context, args["run_id"], args["out"], axes=load_axes(context.config, only, core_axes(commands)))
            print(json.dumps(scan, ensure_ascii=False, indent=2))
            return int(gate_blocked(scan))
        report, text = run_merge(spark, context, args["run_id"], args["out"], args["waive"], only)
        print(text, end="")
        return int(report["outcome"] == "fail")
    except Exception as e:
        print(f"[plumbline] {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
