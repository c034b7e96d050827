"""python -m tallyframe run --config c.json [--profile p]"""

from __future__ import annotations

import argparse
import logging


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyframe")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="load, compile, compare and export a configuration")
    run.add_argument("--config", required=True)
    run.add_argument("--profile")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    from .plans.config import load_config
    from .plans.pipeline import Pipeline

    for path in Pipeline(load_config(given.config, given.profile)).run():
        print(path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
