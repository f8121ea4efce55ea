"""Run stages of an evaluation: python -m tallysmith WORKSPACE --settings FILE --tree FILE [--stage NAMES]"""

from __future__ import annotations

import argparse
from importlib import import_module

from tallysmith.plans import stages
from tallysmith.session import build_session
from tallysmith.sources import dimension
from tallysmith.sources.settings import Settings


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tallysmith", description="Run stages of an evaluation over one workspace folder.")
    out.add_argument("workspace", nargs="?", help="folder with the tables, on storage that all executors share")
    out.add_argument("--settings", help="YAML file with the settings")
    out.add_argument("--tree", help="YAML file with areas and standards")
    out.add_argument("--client", help="module:function that answers (model, system, prompt, temperature)")
    out.add_argument("--stage", default="all", help="stages or sets of stages, joined by commas")
    out.add_argument("--models", help="only these models, joined by commas")
    out.add_argument("--fresh", action="store_true", help="start tables anew; old ones are kept beside them")
    out.add_argument("--list", action="store_true", help="name the stages and their sets")
    return out


def listing() -> str:
    return "\n".join(f"{name:10s} {', '.join(sorted(s.sets))}".rstrip() for name, s in stages.REGISTRY.items())


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    if args.list:
        print(listing())
        return
    if not (args.workspace and args.settings and args.tree):
        parser().error("a workspace, --settings and --tree are needed")
    stages.plan(args.stage)  # unknown names end here, before a session starts
    client = None
    if args.client:
        module, _, name = args.client.partition(":")
        client = getattr(import_module(module), name)
    spark = build_session()
    workspace = stages.Workspace(
        spark, args.workspace, Settings.load(args.settings), dimension.read_tree(spark, args.tree, None), client,
        models=args.models.split(",") if args.models else None, fresh=args.fresh,
    )
    stages.run(workspace, args.stage)
    stages.progress(workspace).show()


if __name__ == "__main__":
    main()
