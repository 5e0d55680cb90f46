"""Command line: scan, check, history and a tool server on standard input. Exit codes: 0 clean, 1 findings, 2 errors."""

from __future__ import annotations

import argparse
import os
import shutil
import sys

from . import __version__
from . import constants as K
from .plans import report as R
from .plans.config import Config
from .scratch import clear
from .ship import ship
from .sources.git import GitError


def session():
    """The running session, or one on this machine."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("echofold").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("path", nargs="?", default=".")
    common.add_argument("--threshold", type=float)
    common.add_argument("--min-tokens", type=int, default=K.MIN_TOKENS)
    common.add_argument("--exclude", action="append", default=[], metavar="GLOB")
    common.add_argument("--no-default-excludes", action="store_true")
    tests = common.add_mutually_exclusive_group()
    tests.add_argument("--include-tests", action="store_true")
    tests.add_argument("--exclude-tests", action="store_true")
    common.add_argument("--json", action="store_true")
    top = argparse.ArgumentParser(prog="echofold", description="Finds near-duplicate functions with Spark.")
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", parents=[common])
    scan.add_argument("--all", action="store_true")
    scan.add_argument("--explain", type=int, metavar="CLUSTER")
    scan.add_argument("--full", action="store_true")
    scan.add_argument("--card", action="store_true")
    scan.add_argument("--include-classes", action="store_true")
    scan.add_argument("--containment", action="store_true")
    history = sub.add_parser("history", parents=[common])
    history.add_argument("--max-snapshots", type=int, default=K.MAX_SNAPSHOTS)
    history.add_argument("--no-card", action="store_true")
    check = sub.add_parser("check", parents=[common])
    check.add_argument("--diff", metavar="REV")
    sub.add_parser("mcp")
    return top


def config_of(args: argparse.Namespace) -> Config:
    return Config(args.threshold, args.min_tokens, tuple(args.exclude), not args.no_default_excludes, args.include_tests, args.exclude_tests)


def run_scan(args: argparse.Namespace) -> int:
    from .plans.scan import Scan
    from .sources.files import source_files

    config = config_of(args)
    files = source_files(session(), args.path, default_excludes=config.default_excludes, excludes=config.excludes)
    scan = Scan(files, config, shapes=args.include_classes)
    root = os.path.basename(os.path.abspath(args.path))
    if args.explain is not None:
        rows = list(R.ranked_documents(scan.members, scan.clusters, only=args.explain)) if args.explain > 0 else []
        if not rows:
            print(f"no cluster {args.explain}: the clusters are numbered from 1 to {scan.clusters.count()}", file=sys.stderr)
            return 2

        def read(name: str) -> str:
            with open(os.path.join(args.path, name), encoding="utf-8", errors="replace") as f:
                return f.read()

        for line in R.explain((d for _, member, d in rows if member), read, full=args.full, columns=shutil.get_terminal_size().columns):
            print(line)
    elif args.json:
        R.stream_json(scan, root, sys.stdout.write, containment=args.containment)
    else:
        for line in R.text_report(scan, root, show_all=args.all, containment=args.containment):
            print(line)
    if args.card:
        _write("echofold-card.svg", R.score_card(R.summary(scan, root)))
    return 0


def _write(name: str, text: str) -> None:
    with open(name, "w", encoding="utf-8") as f:
        f.write(text)
    print(f"wrote {name}", file=sys.stderr)


def run_check(args: argparse.Namespace) -> int:
    import json

    from .plans.check import check

    outcome = check(session(), args.path, config_of(args), args.diff)
    if not outcome.had_changes:
        print("Nothing has changed.")
        return 0
    found = [r.asDict() for r in outcome.findings.collect()]
    if args.json:
        print(json.dumps({"schema_version": K.JSON_SCHEMA, "findings": [{k: v for k, v in f.items() if k != "suggestion" or v} for f in found]}, indent=2, ensure_ascii=False))
    elif not found:
        print("Nothing that has changed repeats other code.")
    else:
        for f in found:
            print(f"{f['file']}:{f['line']}: {f['name']} repeats {f['original_name']} ({f['original_file']}:{f['original_line']}) at {f['similarity']:.0%}")
            if f["suggestion"]:
                print(f"    use: {f['suggestion']}")
        print(f"{len(found)} changed functions repeat other code.", file=sys.stderr)
    return 1 if found else 0


def run_history(args: argparse.Namespace) -> int:
    import json

    from .plans.history import history

    doc = history(session(), args.path, config_of(args), args.max_snapshots)
    if doc is None:
        print("a history needs two snapshots", file=sys.stderr)
        return 2
    print(json.dumps(doc, indent=2, ensure_ascii=False) if args.json else "\n".join(R.history_lines(doc)))
    if not args.no_card:
        _write("echofold-card.svg", R.history_card(doc))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "mcp":
            from .server import serve

            return serve(sys.stdin, sys.stdout)
        return {"scan": run_scan, "check": run_check, "history": run_history}[args.command](args)
    except (GitError, FileNotFoundError) as e:
        print(f"echofold: {e}", file=sys.stderr)
        return 2
    finally:
        from pyspark.sql import SparkSession

        if SparkSession.getActiveSession():
            clear(SparkSession.getActiveSession())


if __name__ == "__main__":
    sys.exit(main())
