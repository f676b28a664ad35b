"""Commands as lines of text: `verb: arguments`, `compare: A vs B | g1, g2`, `interactions: src -> tgt`."""

from __future__ import annotations

import re
from typing import Any, NamedTuple

from pyspark.sql import DataFrame

from . import report
from .engine import Engine

VERBS = ("info", "capabilities", "annotation", "semantic", "hybrid", "discover", "compare", "interactions", "proportions", "pathway", "genes", "metadata", "cells", "specificity", "coexpression", "report", "export", "quit")


class Command(NamedTuple):
    verb: str
    text: str = ""
    parts: tuple[str, ...] = ()
    genes: tuple[str, ...] = ()


def parse(line: str) -> Command:
    """A line without a known verb is a hybrid query."""
    m = re.match(r"\s*([A-Za-z]+)\s*(?::|$)\s*(.*)$", line, re.S)
    if not m or m[1].lower() not in VERBS:
        return Command("hybrid", line.strip())
    verb, rest = m[1].lower(), m[2].strip()
    body, _, genes = rest.partition("|")
    names = tuple(g.strip() for g in genes.split(",") if g.strip())
    body = body.strip()
    if verb == "compare":
        sides = tuple(x.strip() for x in re.split(r"\s+vs\.?\s+", body, flags=re.I))
        if len(sides) != 2 or not all(sides):
            raise ValueError("compare: A vs B, and genes behind a |")
        return Command(verb, body, sides, names)
    if verb == "interactions":
        left, _, right = body.partition("->")
        return Command(verb, body, (left.strip(), right.strip()), names)
    if verb == "coexpression":
        return Command(verb, body, tuple(x.strip() for x in body.split(",") if x.strip()), names)
    return Command(verb, body, (), names)


def run(engine: Engine, line: str) -> Any:
    """What the engine gives for a line: a DataFrame, for compare two of them; None for quit.

    report and export write what the lines before them gave, as Markdown (or Word) and as JSON; they give the file's path.
    """
    c = parse(line)
    if c.verb == "report":
        entries = [(said, "", parts) for said, parts in engine.results]
        return report.written(report.markdown("Report", entries), c.text or "report.md")
    if c.verb == "export":
        return report.exported(engine.results, c.text or "session.json")
    out = _answer(engine, c)
    frames = out if isinstance(out, tuple) else (out,) if isinstance(out, DataFrame) else ()
    if frames:
        engine.results.append((line.strip(), {f"table {i}": df for i, df in enumerate(frames, 1)}))
    return out


def _answer(engine: Engine, c: Command) -> Any:
    match c.verb:
        case "info":
            return engine.info()
        case "capabilities":
            return engine.capabilities()
        case "annotation":
            return engine.by_annotation(c.text)
        case "semantic":
            return engine.by_meaning(c.text)
        case "hybrid":
            return engine.query(c.text)
        case "discover":
            return engine.discover(c.text)
        case "compare":
            return engine.compare(*c.parts, c.genes or None)
        case "interactions":
            return engine.interactions(c.parts[0] or None, c.parts[1] or None)
        case "proportions":
            return engine.proportions(c.text or None)
        case "pathway":
            return engine.pathways(c.text or None)
        case "genes":
            return engine.genes_like(c.text)
        case "metadata":
            return engine.metadata(c.text)
        case "cells":
            return engine.cells_of(c.text)
        case "specificity":
            return engine.specificity()
        case "coexpression":
            return engine.coexpression(*c.parts[:2])
    return None
