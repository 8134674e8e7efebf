"""Command line: version, show-config, validate-config, validate-schema, eval-hallucination."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from pathlib import Path

from . import __version__, config


def _text(value: str) -> str:
    """A file's text, or the string itself where there is no such file."""
    try:
        return Path(value).read_text() if Path(value).is_file() else value
    except OSError:
        return value


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="claimweave")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("show-config").add_argument("file", nargs="?")
    sub.add_parser("validate-config").add_argument("file")
    schema = sub.add_parser("validate-schema")
    for name in ("json", "schema"):
        schema.add_argument(name, help="a file or the text itself")
    halluc = sub.add_parser("eval-hallucination")
    for name in ("context", "answer"):
        halluc.add_argument(name, help="a file or the text itself")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "validate-config":
        try:
            config.load(args.file)
        except (ValueError, TypeError, OSError) as error:
            print(f"invalid: {error}", file=sys.stderr)
            return 1
        print("valid")
        return 0
    if args.command == "show-config":
        print(json.dumps(dataclasses.asdict(config.load(args.file) if args.file else config.EngineConfig()), indent=2))
        return 0
    from .session import local_session

    spark = local_session(1, 1, "1g")
    if args.command == "validate-schema":
        from .operators import schemas

        df = spark.createDataFrame([(0, _text(args.json))], "id long, doc string")
        row = schemas.validate(df, ["id"], "doc", json.loads(_text(args.schema))).first()
        print(json.dumps({"valid": row.valid, "depth": row.depth, "errors": [e.asDict() for e in row.errors]}))
        return 0 if row.valid else 1
    from .operators import spans

    df = spark.createDataFrame([(0, _text(args.context), _text(args.answer))], "id long, context string, answer string")
    rows = spans.unsupported_tokens(df, ["id"], "context", "answer")
    found = spans.kept(spans.merge_tokens(rows, ["id"])).orderBy("start").collect()
    share = spans.ratio(rows, ["id"]).first()
    print(json.dumps({"ratio": share.ratio if share else 0.0, "spans": [{"start": r.start, "end": r.end, "confidence": r.p} for r in found]}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
