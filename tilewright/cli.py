"""``python -m tilewright.cli info FILE [--json]``: a slide's properties. ``resample FILE OUT --mpp M``: another spacing."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .sources import slides


def existing_file(path: str) -> str:
    if not os.path.isfile(path):
        raise argparse.ArgumentTypeError(f"{path} isn't a file")
    return path


def new_file(path: str) -> str:
    if os.path.exists(path):
        raise argparse.ArgumentTypeError(f"{path} exists")
    return path


def info(args: argparse.Namespace) -> int:
    s = slides.open_slide(args.path, args.backend)
    told = s["properties"] | {"width": s["width"], "height": s["height"], "mpp": s["mpp"], **{f"level_{v['level']}": f"{v['width']}x{v['height']}" for v in s["levels"]}}
    print(json.dumps(told, indent=2) if args.json else "\n".join(f"{k}\t{v}" for k, v in told.items()))
    return 0


def resample(args: argparse.Namespace) -> int:
    slides.resample(args.path, args.out, args.mpp, (args.tile, args.tile))
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tilewright")
    sub = out.add_subparsers(dest="command", required=True)
    one = sub.add_parser("info", help="properties of a slide")
    one.add_argument("path", type=existing_file)
    one.add_argument("--backend", default="tiff")
    one.add_argument("--json", action="store_true")
    one.set_defaults(run=info)
    two = sub.add_parser("resample", help="write a slide at another spacing")
    two.add_argument("path", type=existing_file)
    two.add_argument("out", type=new_file)
    two.add_argument("--mpp", type=float, required=True)
    two.add_argument("--tile", type=int, default=512)
    two.set_defaults(run=resample)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
