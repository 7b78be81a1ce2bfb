"""Command line: ``python -m corpusloom prepare --out FOLDER --vocabulary FILE TABLE=WEIGHT ...``."""

from __future__ import annotations

import argparse
import json
from dataclasses import fields

from corpusloom.plans.preparation import Settings, prepare
from corpusloom.session import get_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("prepare", help="judge, mix, dedup, write and tokenise; a run that was cut off goes on")
    p.add_argument("sources", nargs="+", metavar="TABLE=WEIGHT", help="Parquet tables of documents and their weights")
    p.add_argument("--out", required=True)
    p.add_argument("--vocabulary", required=True, help="lines of base64 tokens and ranks")
    p.add_argument("--id", default="doc_id")
    p.add_argument("--text", default="text")
    for f in fields(Settings):
        kind = {"int": int, "float": float, "bool": None}[f.type]
        name = f"--{f.name.replace('_', '-')}"
        if kind is None:
            p.add_argument(name, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            p.add_argument(name, type=kind, required=f.name == "target", default=None if f.name == "target" else f.default)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    paths, weights = zip(*((path, float(weight)) for path, _, weight in (s.rpartition("=") for s in args.sources)), strict=True)
    settings = Settings(**{f.name: getattr(args, f.name) for f in fields(Settings)})
    run, stages = prepare(get_session(), args.out, paths, weights, args.vocabulary, settings, args.id, args.text)
    for name, s in stages.items():
        print(json.dumps({"stage": name, "made": name in run.made, "path": s.path, **s.facts}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
