"""Command line: query, check, explain, run and new."""

from __future__ import annotations

import sys

from genoloom import engine, script
from genoloom.lang.errors import EngineError, QueryError

USAGE = "usage: python -m genoloom query TEXT | check TEXT | compile TEXT | explain TEXT | run FILE [--name value | --name=value ...] | new FILE"
SHOWN = 50


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("genoloom").getOrCreate()


def show(result, most: int | None) -> None:
    if result.text is not None:
        print(result.text)
        return
    for n, line in enumerate(result.json_lines()):
        if most is not None and n == most:
            print(f"... first {most} rows")
            break
        print(line)


def flags(args: list[str]) -> dict[str, str]:
    """``--name value`` and ``--name=value``; hyphens in a name are underscores, a last name alone is empty."""
    found: dict[str, str] = {}
    name = None
    for a in args:
        if name is not None:
            found[name], name = a, None
        elif a.startswith("--"):
            key, given, value = a[2:].partition("=")
            key = key.replace("-", "_")
            if given:
                found[key] = value
            else:
                name = key
    return found if name is None else found | {name: ""}


def warn_without_reference(text: str) -> None:
    """Say so where calls from a BAM will hold no indels."""
    try:
        q = engine.compile_query(text)
    except QueryError:
        return
    if q.source.format == "bam" and q.call == "variants" and not any(p[0] == "reference" for p in q.params):
        print("warning: no reference given: REF is the commonest base, and insertions and deletions aren't called", file=sys.stderr)


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(USAGE, file=sys.stderr)
        return 2
    command, text = args[:2]
    try:
        if command == "query":
            warn_without_reference(text)
            show(engine.run(session(), text), SHOWN)
        elif command == "check":
            engine.compile_query(text)
            print("ok")
        elif command == "compile":
            print(engine.to_json(engine.compile_query(text)))
        elif command == "explain":
            print(engine.explain(session(), text))
        elif command == "run":
            with open(text, encoding="utf-8") as f:
                found = script.parse_script(f.read())
            text = found.text
            warn_without_reference(text)
            show(engine.run(session(), found.text, script.bind(found, flags(args[2:]))), None)
        elif command == "new":
            with open(text, "x", encoding="utf-8") as f:
                f.write('-- @name: example\n-- @input: path required str "a VCF file"\nFROM vcf $path CALL variants LIMIT 10\n')
        else:
            print(USAGE, file=sys.stderr)
            return 2
    except QueryError as e:
        print(e.render(text), file=sys.stderr)
        return 1
    except (EngineError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
