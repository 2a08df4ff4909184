"""python -m folioframe parse|render|convert|recognize|formats|version: the grammars on one text from standard input, and images."""

from __future__ import annotations

import argparse
import json
import sys

from folioframe.functions import formulas, prose

VERSION = "0.1"


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioframe")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    commands.add_parser("formats")
    parse = commands.add_parser("parse")
    parse.add_argument("--language", choices=("markdown", "latex"), default="latex")
    commands.add_parser("render")
    recognize = commands.add_parser("recognize")
    recognize.add_argument("path")
    recognize.add_argument("--format", default="latex")
    recognize.add_argument("--mode", choices=("formula", "text", "mixed"), default="mixed")
    convert = commands.add_parser("convert")
    convert.add_argument("--source", choices=sorted(formulas.READERS), default="latex")
    convert.add_argument("--target", choices=sorted(formulas.WRITERS), default="mathml")
    a = parser.parse_args(arguments)
    if a.command == "version":
        print(VERSION)
    elif a.command == "formats":
        print("\n".join(formulas.WRITERS))
    elif a.command == "parse":
        blocks = (prose.from_markdown if a.language == "markdown" else prose.from_latex_document)(sys.stdin.read())
        print(json.dumps([dict(zip(("kind", "level", "text", "display"), b, strict=True)) for b in blocks], ensure_ascii=False, indent=2))
    elif a.command == "render":
        marks = {True: ("$$\n", "\n$$"), False: ("$", "$")}
        blocks = prose.from_latex_document(sys.stdin.read())
        print("\n\n".join(text if kind == "paragraph" else marks[display][0] + text + marks[display][1] for kind, _, text, display in blocks))
    elif a.command == "recognize":
        from folioframe.sdk import PRINTERS, Folio
        from folioframe.session import local_session

        if a.format not in PRINTERS:
            print(f"unknown format: {a.format}; one of {', '.join(PRINTERS)}", file=sys.stderr)
            return 1
        for row in Folio.from_files(local_session(), a.path, a.mode).to(a.format).toLocalIterator():
            print(row.body)
    else:
        print(formulas.convert(sys.stdin.read(), a.source, a.target))
    return 0


if __name__ == "__main__":
    sys.exit(main())
