"""Redacts text files (or standard input) as one document: python -m zaslona.cli [FILES] [--out FILE]."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .operators.fold import redact_text
from .operators.rules import LABELS
from .sources.documents import plain_text


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="zaslona", description=__doc__)
    p.add_argument("files", nargs="*")
    p.add_argument("--out", "-o", help="file for the result; standard output otherwise")
    p.add_argument("--quiet", "--cicho", "-q", action="store_true", help="no counts on standard error")
    p.add_argument("--persons", "--osoby", "--pseudonimy", dest="persons", action="store_true", help="tell persons apart by letters")
    o = p.parse_args(args)
    try:
        text = "\n".join(plain_text(Path(f).read_bytes()) for f in o.files) if o.files else plain_text(sys.stdin.buffer.read())
    except OSError as e:
        print(e, file=sys.stderr)
        return 1
    redacted, found = redact_text(text, pseudonyms=o.persons)
    if o.out:
        Path(o.out).write_text(redacted, encoding="utf-8")
    else:
        sys.stdout.write(redacted)
    if not o.quiet:
        names = list(dict.fromkeys(LABELS[k] for k, _ in found))
        print(f"{sum(n for _, n in found)}: {', '.join(names)}" if found else "nothing found", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
