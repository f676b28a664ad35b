"""Reports and payloads: small frames as Markdown and JSON, within bounds."""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Mapping
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame


def payload(parts: Mapping[str, DataFrame], rows: int = 20, chars: int = 12000) -> str:
    """The first rows of each part as JSON; if that is too long, of half as many, and so on down to one."""
    while True:
        out = json.dumps({name: [r.asDict(True) for r in df.limit(rows).collect()] for name, df in parts.items()}, default=str)
        if len(out) <= chars or rows <= 1:
            return out[:chars]
        rows //= 2


def table(df: DataFrame, rows: int = 20) -> str:
    found = df.limit(rows).collect()
    cell = lambda x: f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", "/")
    lines = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join(lines + [f"| {' | '.join(map(cell, r))} |" for r in found])


def markdown(title: str, entries: list[tuple[str, str, Mapping[str, DataFrame]]], rows: int = 20) -> str:
    """entries: heading, text, and tables by name."""
    parts = [f"# {title}", f"{datetime.now():%Y-%m-%d %H:%M}"]
    for heading, text, tables in entries:
        parts += [f"## {heading}", text, *(f"### {name}\n\n{table(df, rows)}" for name, df in tables.items())]
    return "\n\n".join(p for p in parts if p) + "\n"


def written(report: str, path: str) -> str:
    """Writes Markdown, or Word by way of pandoc where there is one; returns the path of what was written."""
    out = Path(path)
    if out.suffix == ".docx" and shutil.which("pandoc"):
        subprocess.run(["pandoc", "-f", "markdown", "-o", str(out)], input=report, text=True, check=True)
        return str(out)
    out = out.with_suffix(".md")
    out.write_text(report)
    return str(out)


def exported(results: list[tuple[str, Mapping[str, DataFrame]]], path: str, rows: int = 1000) -> str:
    """Writes what each line gave as JSON, `rows` rows of each table at most; returns the path."""
    own = [{"line": line, "tables": {name: [r.asDict(True) for r in df.limit(rows).collect()] for name, df in parts.items()}} for line, parts in results]
    Path(path).write_text(json.dumps({"time": f"{datetime.now():%Y-%m-%dT%H:%M:%S}", "results": own}, default=str))
    return path
