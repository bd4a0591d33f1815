"""Command line: ``python -m paramscan.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys

from . import build as building
from .config import remote_url
from .errors import ParamscanError
from .operators.select import outcome_summary
from .store import Dataset

BULK = 100


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("paramscan").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="paramscan")
    top.add_argument("-C", dest="path", default=".", help="dataset directory")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("init", "info", "status", "log", "branch"):
        sub.add_parser(name)
    add = sub.add_parser("add")
    add.add_argument("fmt")
    add.add_argument("--encoding", action="store_true")
    setting = sub.add_parser("set-config")
    setting.add_argument("--fmt")
    setting.add_argument("--encoding", action="append", default=[], metavar="NAME=REGEX")
    setting.add_argument("--remote", metavar="URL")
    setting.add_argument("--remote-name")
    commit = sub.add_parser("commit")
    commit.add_argument("-m", "--message", required=True)
    commit.add_argument("--allow-empty", action="store_true")
    for name, what in (("checkout", "branch"), ("add-worktree", "branch")):
        sub.add_parser(name).add_argument(what)
    clone = sub.add_parser("clone")
    clone.add_argument("source")
    clone.add_argument("target")
    clone.add_argument("--no-data", action="store_true", help="leave out contents that the store lacks")
    clone.add_argument("--workers", type=int, default=4)
    down = sub.add_parser("download")
    down.add_argument("output")
    down.add_argument("path_names", nargs="*", metavar="PATH")
    down.add_argument("--tsv", action="append", default=[])
    down.add_argument("--all", action="store_true")
    down.add_argument("--workers", type=int, default=4)
    down.add_argument("--remote")
    down.add_argument("--yes", action="store_true")
    down.add_argument("--dry-run", action="store_true")
    make = sub.add_parser("build")
    make.add_argument("remote")
    make.add_argument("--formats", help="YAML file with a list of {fmt, db}")
    make.add_argument("--overwrite", action="store_true")
    return top


def prompt_choice(prompt: str, choices: set[str], ask=input) -> str:
    """One of ``choices``, in letters of either case."""
    answer = ask(prompt).strip().lower()
    if answer not in choices:
        raise ValueError(f"Unrecognized choice: {answer!r}")
    return answer


def confirmed(prompt: str, ask=input) -> bool:
    try:
        return prompt_choice(prompt, {"y", "yes", "n", "no", ""}, ask) in ("y", "yes")
    except EOFError:
        return False


def run(args, spark, say=print, ask=input) -> int:
    if args.command == "init":
        Dataset.init(spark, args.path)
        return 0
    if args.command == "clone":
        Dataset.clone(spark, args.source, args.target, not args.no_data, args.workers)
        return 0
    if args.command == "build":
        from .sources.tables import load_yaml

        entries = load_yaml(args.formats).get("data") if args.formats else None
        building.build(spark, args.path, args.remote, entries, overwrite=args.overwrite)
        return 0
    data = Dataset(spark, args.path)
    if args.command == "info":
        say(json.dumps({"branch": data.branch, "config": data.config(), "rows": data.data().count()}, indent=2))
    elif args.command == "status":
        say(json.dumps(data.status(), indent=2))
    elif args.command == "log":
        for c in data.log():
            say(f"{c['commit'][:12]} {c['message']}")
    elif args.command == "branch":
        found = data.branches()
        for name in found["names"]:
            say(("* " if name == found["current"] else "  ") + name)
    elif args.command == "add":
        say(f"{data.add(args.fmt, args.encoding, data.below()).count()} files")
    elif args.command == "set-config":
        data.set_config(args.fmt, dict(e.split("=", 1) for e in args.encoding) or None, remote_name=args.remote_name, remote_url=args.remote)
    elif args.command == "commit":
        say("committed" if data.commit(args.message, args.allow_empty) else "nothing to commit")
    elif args.command == "checkout":
        data.checkout(args.branch)
    elif args.command == "add-worktree":
        say(data.add_worktree(args.branch).root)
    elif args.command == "download":
        from .operators.gather import gather
        from .sources.remote import download

        everything = args.all or not (args.path_names or args.tsv)
        chosen = gather(spark, data.root or data.store, data.config(), args.path_names, args.tsv, everything, data.data())
        count = chosen.count()
        if args.dry_run:
            for r in chosen.limit(20).collect():
                say(r.path)
            say(f"{count} files")
            return 0
        if count >= BULK and not args.yes and not confirmed(f"{count} files, of unknown size. Continue? [y/N] ", ask):
            say("nothing was downloaded")
            return 1
        done = download(chosen, remote_url(data.config(), args.remote), args.output, args.workers).persist()
        summary = outcome_summary(done).first()
        say(f"{summary.succeeded} of {count} files, {summary.total_bytes} bytes")
        if summary.failed:
            say(summary.errors)
        return int(summary.failed > 0)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args, session())
    except (ParamscanError, ValueError, OSError) as e:
        print(f"paramscan: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
