"""Command line for spark-submit: run, compare, preflight, ablation, sweep, probe.

    spark-submit -m lapse run olist --root s3a://bucket/olist --output s3a://bucket/out
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from lapse.session import get_session


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lapse", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, help_text: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help_text)
        p.add_argument("--root", required=True, help="folder with one sub-folder per dataset")
        p.add_argument("--output", help="folder for results, models and matrices")
        return p

    run = command("run", "one dataset end to end, or all of them")
    run.add_argument("dataset", nargs="?", default="olist", help="dataset name or 'all'")
    run.add_argument("--sensitivity", action="store_true")
    run.add_argument("--smote", action="store_true")
    run.add_argument("--smote-comparison", action="store_true")
    run.add_argument("--window", type=int)
    check = command("preflight", "gate before a sweep; exit code 1 on any FAIL")
    check.add_argument("--targets")
    check.add_argument("--no-smote-check", action="store_true")
    ablate = command("ablation", "ablation of native-split datasets")
    ablate.add_argument("datasets", nargs="*", default=["credit_card", "telco"])
    ablate.add_argument("--with-smote", action="store_true")
    sweep = command("sweep", "gate, then every dataset in both modes, resuming finished runs")
    sweep.add_argument("--targets")
    look = command("probe", "sanity probe, then both modes")
    look.add_argument("dataset", nargs="?", default="rees46")
    return parser


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    from lapse.plans import gates
    from lapse.plans import sweep as W
    from lapse.sources.registry import list_datasets

    spark = spark or get_session()
    roots = {name: f"{args.root.rstrip('/')}/{name}" for name in list_datasets()}
    targets = args.targets.split(",") if getattr(args, "targets", None) else None
    if args.command == "run":
        names = list_datasets() if args.dataset == "all" else [args.dataset]
        if args.smote_comparison:
            tables = W.mode_comparison(spark, roots, args.output, None)
            for table in tables.values():
                table.show(200, truncate=False)
            return 0
        status, _ = W.run_many(
            spark, roots, args.output, names, ("smote",) if args.smote else ("original",),
            sensitivity=args.sensitivity, window=args.window)
        status.show(200, truncate=False)
        return 0 if status.where("status = 'FAILED'").isEmpty() else 1
    if args.command == "preflight":
        report = gates.run_preflight(spark, roots, targets, not args.no_smote_check)
        if args.output:
            from lapse.sources.sinks import write_table

            write_table(report, f"{args.output.rstrip('/')}/results/preflight/report")
        report.show(1000, truncate=False)
        return 0 if gates.gate_all_passed(report) else 1
    if args.command == "ablation":
        for name in args.datasets:
            W.ablation_only(spark, name, roots[name], args.output, args.with_smote).show(200, False)
        return 0
    if args.command == "sweep":
        W.full_sweep(spark, roots, args.output, targets).show(200, truncate=False)
        return 0
    W.probed_run(spark, args.dataset, roots[args.dataset], args.output).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
