"""Command line: python -m millrace COMMAND --root DIR [--seeds DIR] [--select ...] [--vars JSON]."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
from pathlib import Path

from millrace.plans import pipeline
from millrace.session import build_session
from millrace.sources import files


def _report(results: list[pipeline.quality.Result]) -> int:
    for r in results:
        print("PASS" if r.passed else "ERROR" if r.error else "FAIL", r.name, r.failures, r.error or "")
    return pipeline.quality.exit_code(results)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("command", choices=["seed", "build", "run", "test", "scan", "ls", "docs", "compile", "show"])
    p.add_argument("--root", default="warehouse", help="folder of the built tables")
    p.add_argument("--seeds", help="folder with raw_*.csv")
    p.add_argument("--from", dest="first", help="first load date of a scan")
    p.add_argument("--to", dest="last", help="last load date of a scan")
    p.add_argument("--select", default="")
    p.add_argument("--vars", default="{}", help='JSON, such as {"load_date": "2026-04-02"}')
    p.add_argument("--state", help="lineage file of an earlier docs call, for state:modified")
    p.add_argument("--threads", type=int, default=1)
    p.add_argument("--full-refresh", action="store_true")
    p.add_argument("--master", default="local[*]")
    a = p.parse_args(argv)
    if a.command == "seed" and not a.seeds or a.command == "scan" and not (a.first and a.last):
        p.error("seed needs --seeds, and scan needs --from and --to")
    previous = {n: x["fingerprint"] for n, x in json.loads(Path(a.state).read_text()).items()} if a.state else None
    registry = pipeline.telemetry
    if a.command == "ls":
        print("\n".join(registry.order(registry.select(a.select, previous))))
        return 0
    if a.command == "docs":
        print(registry.lineage())
        return 0
    spark = build_session(a.master)
    raw = {n: files.seed(spark, f"{a.seeds}/{n}.csv", n) for n in files.RAW} if a.seeds else {}
    given = json.loads(a.vars)
    if "load_date" in given:
        given["load_date"] = dt.date.fromisoformat(given["load_date"])
    if "as_of" in given:
        given["as_of"] = dt.datetime.fromisoformat(given["as_of"])
    ctx = pipeline.Context(spark, a.root, raw, given, a.full_refresh)
    if a.command == "seed":
        print("\n".join(pipeline.seed(ctx)))
        return 0
    if a.command == "scan":
        return _report(pipeline.scan(ctx, dt.date.fromisoformat(a.first), dt.date.fromisoformat(a.last)))
    if a.command in ("compile", "show"):
        for name in registry.order(registry.select(a.select, previous)):
            df = registry.models[name].build(ctx)
            print(f"-- {name}")
            print(files.as_text(df)) if a.command == "show" else df.explain("formatted")
        return 0
    if a.command == "test":
        results = pipeline.test_sources(ctx)
        for name in registry.order(registry.select(a.select, previous)):
            m = registry.models[name]
            needed = {name, *(parent for _, parent, _ in m.checks.get("relationships", []))}
            tables = {n: registry.models[n].build(ctx) if registry.models[n].materialized == "view" else ctx.ref(n) for n in needed}
            results += pipeline.quality.run(pipeline.quality.parse(name, m.checks), tables)
        return _report(results)
    outcomes = pipeline.run(registry, ctx, a.select, test=a.command == "build", previous=previous, threads=a.threads)
    for o in outcomes:
        print(o.status, o.model, f"{sum(c.passed for c in o.checks)}/{len(o.checks)} checks", o.detail)
    return int(any(o.status != "PASS" for o in outcomes))


if __name__ == "__main__":
    sys.exit(main())
