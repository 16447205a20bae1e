"""Commands over a store kept in a folder: python -m recollect.cli FOLDER COMMAND ...; results are JSON lines."""

from __future__ import annotations

import argparse
import json
import os
import shlex
import sys
import time

from recollect.api import Store


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recollect", description=__doc__)
    p.add_argument("folder")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("insert", help="add a memory; words after # are tags")
    c.add_argument("content")
    c.add_argument("--type", default="fact", choices=["fact", "procedure", "episodic", "task"])
    for name, arg in (("search", "text"), ("search-tags", "tags"), ("get", "id"), ("related", "id"), ("backup", "target")):
        c = sub.add_parser(name)
        c.add_argument(arg)
        c.add_argument("--limit", type=int, default=10)
    c = sub.add_parser("cleanup", help="remove what is forgotten")
    c.add_argument("--least", type=float, default=0.01)
    for name in ("stats", "health", "config", "shell"):
        sub.add_parser(name)
    return p


def _latest(folder: str) -> str | None:
    """Each change is a snapshot of its own; the one that its marker names is the newest whole one."""
    mark = os.path.join(folder, "CURRENT")
    return open(mark).read().strip() if os.path.exists(mark) else None


def _kept(s: Store, folder: str) -> None:
    """Write a snapshot of all tables, then let the marker name it."""
    name = f"{time.time_ns()}"
    s.backup(os.path.join(folder, name))
    mark = os.path.join(folder, "CURRENT")
    with open(f"{mark}.new", "w") as f:
        f.write(name)
    os.replace(f"{mark}.new", mark)


def health(spark) -> dict:
    """Whether a store of its own takes a memory in, finds it by text and by tag, and gives it back."""
    with Store(spark) as s:
        ident = s.insert("a probe of the store", tags=["probe"])
        done = {
            "insert": s.memories.count() == 1,
            "search": [r.id for r in s.search("probe").select("id").collect()] == [ident],
            "tags": [r.id for r in s.search(tags=["probe"]).select("id").collect()] == [ident],
            "get": not s.get(ident).isEmpty(),
        }
    return done | {"ok": all(done.values())}


def main(args: list[str] | None = None, spark=None, lines=None) -> int:
    """Run one command; `shell` runs one for each line of standard input (or of lines), until `exit`."""
    a = _parser().parse_args(args)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("recollect").getOrCreate()
    if a.command != "shell":
        return _run(a, spark)
    worst = 0
    for line in lines if lines is not None else sys.stdin:
        words = shlex.split(line)
        if words[:1] in (["exit"], ["quit"]):
            break
        if words:
            try:
                worst = max(worst, _run(_parser().parse_args([a.folder, *words]), spark))
            except SystemExit:
                worst = 2
    return worst


def _run(a: argparse.Namespace, spark) -> int:
    now = _latest(a.folder)
    s = Store.restore(spark, os.path.join(a.folder, now)) if now else Store(spark)

    def show(df) -> int:
        rows = [r.asDict(True) for r in df.collect()]
        for r in rows:
            print(json.dumps(r, ensure_ascii=False))
        return 0 if rows else 1

    if a.command == "insert":
        words = a.content.split()
        tags = [w[1:] for w in words if w.startswith("#") and len(w) > 1]
        try:
            ident = s.insert(" ".join(w for w in words if w not in {f"#{t}" for t in tags}), a.type, tags or None)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        _kept(s, a.folder)
        print(json.dumps({"id": ident}))
        return 0
    if a.command == "search":
        return show(s.search(a.text, limit=a.limit).select("id", "content", "score"))
    if a.command == "search-tags":
        return show(s.search(tags=a.tags.split(","), limit=a.limit).select("id", "content", "score"))
    if a.command == "get":
        return show(s.get(a.id))
    if a.command == "related":
        return show(s.related(a.id, a.limit).select("id", "content", "score"))
    if a.command == "backup":
        s.backup(a.target)
        return 0
    if a.command == "cleanup":
        gone = s.cleanup(a.least)
        _kept(s, a.folder)
        print(json.dumps({"removed": gone}))
        return 0
    out = {"stats": s.statistics, "health": lambda: health(spark) | {"memories": s.memories.count()}, "config": lambda: vars(s.settings)}[a.command]()
    print(json.dumps(out))
    return 0 if out.get("ok", True) else 1


if __name__ == "__main__":
    sys.exit(main())
