"""Command line over ``Engine``: index a tree, ask the snapshot."""

from __future__ import annotations

import argparse
import os
import shutil

from sylvan.session import build_session

COMMANDS = "init index sync status ctags query files context explore callers callees references uncalled impact trace serve uninit".split()


def swap(snapshot: str) -> None:
    """Puts the snapshot written beside the current one in its place; at every moment one of them is whole."""
    old = snapshot + ".old"
    shutil.rmtree(old, ignore_errors=True)
    os.rename(snapshot, old)
    os.rename(snapshot + ".next", snapshot)
    shutil.rmtree(old, ignore_errors=True)


def recover(snapshot: str) -> None:
    """After a swap that was cut short the old snapshot counts."""
    if not os.path.exists(snapshot) and os.path.exists(snapshot + ".old"):
        os.rename(snapshot + ".old", snapshot)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sylvan", description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("words", nargs="*")
    parser.add_argument("--root", default=".")
    parser.add_argument("--snapshot", default=".sylvan")
    parser.add_argument("--limit", type=int, default=20)
    parser.add_argument("--depth", type=int, default=2)
    parser.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "uninit":
        shutil.rmtree(args.snapshot, ignore_errors=True)
        return 0
    from sylvan.api import Engine
    from sylvan.sources.scan import scan_files

    spark = build_session()
    if args.command in ("init", "index"):
        if args.command == "init":
            Engine.init(spark, args.snapshot)
        Engine.index(spark, scan_files(spark, args.root)).save(args.snapshot)
        return 0
    recover(args.snapshot)
    engine = Engine.open(spark, args.snapshot)
    if args.command == "sync":
        fresh = engine.sync(scan_files(spark, args.root))
        fresh.save(args.snapshot + ".next")
        swap(args.snapshot)
        return 0
    word = " ".join(args.words)
    if args.command == "serve":
        import sys

        from sylvan.serve import serve

        serve(engine, sys.stdin.buffer, sys.stdout.buffer, args.root)
        return 0
    if args.command == "ctags":
        engine.write_tags(word or "tags")
        return 0
    if args.command in ("context", "explore"):
        if args.command == "explore":
            print(engine.explore(word, args.limit))
        else:
            print(engine.context_json(word, args.limit) if args.json else engine.context_markdown(word, args.limit))
        return 0
    if args.command == "trace":
        print(engine.trace(*args.words[:2]))
        return 0
    answer = {
        "status": engine.stats,
        "query": lambda: engine.search(word, None, args.limit),
        "files": lambda: engine.list_files(word or None),
        "callers": lambda: engine.callers(word, args.limit),
        "callees": lambda: engine.callees(word, args.limit),
        "references": lambda: engine.references(word, args.limit),
        "uncalled": lambda: engine.uncalled(args.limit),
        "impact": lambda: engine.impact(word, args.depth),
    }[args.command]()
    if args.json:
        for row in answer.toJSON().take(args.limit):
            print(row)
    else:
        answer.show(args.limit, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
