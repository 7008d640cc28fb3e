"""python -m skarn.plans.cli validate-schema | detect-drift | score | train | predict. Exit codes: 0 passed, 1 failed, 2 bad call or missing file."""

from __future__ import annotations

import argparse
import logging
import sys

from skarn.operators import contracts, drift
from skarn.plans import runs
from skarn.session import local_session
from skarn.sources.readers import load_yaml, read_table
from skarn.sources.writers import drift_report, schema_report


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="skarn")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, names in (("validate-schema", ("config", "input", "report")), ("detect-drift", ("config", "reference", "current", "report")), ("train", ("config",)), ("predict", ("model", "input", "output"))):
        one = sub.add_parser(name)
        for x in names:
            one.add_argument(f"--{x}", required=True)
        if name == "predict":
            one.add_argument("--threshold", type=float, default=0.5)
            one.add_argument("--target")
    one = sub.add_parser("score")
    one.add_argument("--config", required=True)
    for flag, kind in (("input", str), ("output", str), ("model", str), ("threshold", float), ("chunk-size", int)):
        one.add_argument(f"--{flag}", type=kind)
    return parser


def overrides(args: argparse.Namespace) -> dict:
    """The configuration that the flags of score give; groups without a flag are left out."""
    groups = {"input": {"path": args.input}, "output": {"path": args.output}, "model": {"path": args.model}, "scoring": {"threshold": args.threshold, "chunk_size": args.chunk_size}}
    kept = {g: {k: v for k, v in x.items() if v is not None} for g, x in groups.items()}
    return {g: x for g, x in kept.items() if x}


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    try:
        args = _parser().parse_args(argv)
    except SystemExit as error:
        return int(error.code or 0) and 2
    try:
        if args.command == "predict":
            runs.predict_csv(local_session(), args.model, args.input, args.output, args.target, args.threshold)
            return 0
        config = load_yaml(args.config)
        if args.command == "validate-schema":
            spark = local_session()
            return 0 if schema_report(contracts.validate(read_table(spark, args.input), contracts.Contract.of(config)), args.report) else 1
        if args.command == "detect-drift":
            spark = local_session()
            found = drift.detect(read_table(spark, args.reference), read_table(spark, args.current), drift.DriftConfig.of(config))
            return 0 if drift_report(found, args.report) else 1
        if args.command == "train":
            runs.train_run(local_session(), config)
        else:
            config = runs.deep_merge(config, overrides(args))
            runs.batch_inference(local_session(), config, runs.build_tracker(config.get("tracking") or {}))
        return 0
    except (FileNotFoundError, ValueError, KeyError) as error:
        print(f"skarn: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
