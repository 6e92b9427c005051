"""Command line: extracts articles from files or standard input.

The few files that are named on a command line are read on the driver; tables of pages go through extract_articles.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pagewright import VERSION
from pagewright.operators.extract import extract_page
from pagewright.options import ExtractOptions
from pagewright.sources.files import FORMATS

FIELDS = ("title", "byline", "date", "content", "plain_content", "plain_text", "content_type")


def render(article: dict, form: str, compact: bool) -> str:
    if form == "html":
        return article["content"] or ""
    if form == "text":
        return "".join(b["text"] + "\n\n" for b in article["plain_text"] or [])
    own = {k: article[k] for k in FIELDS}
    own["plain_text"] = [{k: v for k, v in b.items() if v is not None} for b in own["plain_text"] or []]
    own["date"] = own["date"].strftime("%Y-%m-%dT%H:%M:%SZ") if own["date"] else None
    out = json.dumps(own, ensure_ascii=False, indent=None if compact else 2)
    return out.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pagewright", description=__doc__)
    p.add_argument("--input", "-i", default="", help="files, comma-separated; - or nothing for standard input")
    p.add_argument("--output", "-o", default="", help="a file for a single input")
    p.add_argument("--output-dir", default="")
    p.add_argument("--format", "-f", default="json", choices=sorted(FORMATS))
    p.add_argument("--digests", action="store_true")
    p.add_argument("--indexes", action="store_true")
    p.add_argument("--compact", action="store_true")
    p.add_argument("--preserve-links", action="store_true")
    p.add_argument("--timeout", type=float, default=ExtractOptions.timeout)
    p.add_argument("--version", action="version", version=VERSION)
    a = p.parse_args(arguments)
    options = ExtractOptions(content_digests=a.digests, node_indexes=a.indexes, preserve_important_links=a.preserve_links, timeout=a.timeout or None)
    inputs = [x.strip() for x in a.input.split(",") if x.strip()] or ["-"]
    if len(inputs) > 1 and a.output:
        print("several inputs and one output: writing to standard output", file=sys.stderr)
    failed = 0
    for name in inputs:
        try:
            source = sys.stdin.read() if name == "-" else Path(name).read_text(encoding="utf-8", errors="replace")
        except OSError as e:
            print(f"{name}: {e}", file=sys.stderr)
            failed += 1
            continue
        article = extract_page(source, options)
        if article["error"]:
            print(f"{name}: {article['error']}", file=sys.stderr)
            failed += 1
            continue
        text = render(article, a.format, a.compact)
        if a.output_dir:
            Path(a.output_dir).mkdir(parents=True, exist_ok=True)
            (Path(a.output_dir) / ((Path(name).stem if name != "-" else "stdin") + FORMATS[a.format])).write_text(text, encoding="utf-8")
        elif a.output and len(inputs) == 1:
            Path(a.output).write_text(text, encoding="utf-8")
        else:
            print(text)
    return int(failed == len(inputs))


if __name__ == "__main__":
    sys.exit(main())
