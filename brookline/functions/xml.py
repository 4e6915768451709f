"""XML: navigation by paths, and a flat list of nodes where they can't say it.

Plain absolute paths (/a/b, an attribute, a count) are followed by one pass of a parser over each
document, in Arrow batches, which is many times faster than Spark's XPath; other paths are Spark's.

The flat form, ARRAY<STRUCT<id, parent, kind, name, value, attrs>>, holds elements, text,
comments, processing instructions and directives in document order; the root is 0. write()
gives well-formed XML, so text and attributes are escaped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT, TAG, TEXT, COMMENT, INSTRUCTION, DIRECTIVE = range(6)
NODES = "array<struct<id:int,parent:int,kind:int,name:string,value:string,attrs:array<struct<name:string,value:string>>>>"


def parse(source: str | bytes) -> list[dict]:
    """Nodes of one document; malformed XML raises ValueError. An XML declaration is an instruction called xml, as any other is."""
    nodes = [{"id": 0, "parent": -1, "kind": ROOT, "name": None, "value": None, "attrs": []}]
    open_ = [0]

    def add(kind: int, name: str | None, value: str | None, attrs: list | None = None) -> None:
        if kind == TEXT and nodes[-1]["kind"] == TEXT and nodes[-1]["parent"] == open_[-1]:
            nodes[-1]["value"] += value
            return
        nodes.append({"id": len(nodes), "parent": open_[-1], "kind": kind, "name": name, "value": value, "attrs": attrs or []})

    def start(name: str, attrs: list[str]) -> None:
        add(TAG, name.rpartition(":")[2], None, [{"name": k, "value": v} for k, v in zip(attrs[::2], attrs[1::2])])
        open_.append(nodes[-1]["id"])

    def declaration(version: str, encoding: str | None, alone: int) -> None:
        parts = [f'version="{version}"'] + ([f'encoding="{encoding}"'] if encoding else []) + ([f'standalone="{"yes" if alone else "no"}"'] if alone >= 0 else [])
        add(INSTRUCTION, "xml", " ".join(parts))

    p = expat.ParserCreate()
    p.ordered_attributes = True
    p.buffer_text = True
    p.StartElementHandler = start
    p.EndElementHandler = lambda name: open_.pop()
    p.CharacterDataHandler = lambda data: add(TEXT, None, data)
    p.CommentHandler = lambda data: add(COMMENT, None, data)
    p.ProcessingInstructionHandler = lambda target, data: add(INSTRUCTION, target, data)
    p.XmlDeclHandler = declaration
    p.StartDoctypeDeclHandler = lambda name, system, public, internal: add(DIRECTIVE, None, "DOCTYPE " + name)
    try:
        p.Parse(source, True)
    except expat.ExpatError as error:
        raise ValueError(f"malformed XML: {error}") from error
    return nodes


def write(nodes: list[dict]) -> str:
    below: dict[int, list[dict]] = {}
    for n in nodes:
        below.setdefault(n["parent"], []).append(n)
    out: list[str] = []

    def put(n: dict) -> None:
        kind = n["kind"]
        if kind == TAG:
            attrs = "".join(f" {a['name']}={quoteattr(a['value'])}" for a in n["attrs"])
            out.append(f"<{n['name']}{attrs}>")
            for child in below.get(n["id"], ()):
                put(child)
            out.append(f"</{n['name']}>")
        elif kind == TEXT:
            out.append(escape(n["value"]))
        elif kind == COMMENT:
            out.append(f"<!--{n['value']}-->")
        elif kind == INSTRUCTION:
            out.append(f"<?{n['name']} {n['value']}?>\n")
        elif kind == DIRECTIVE:
            out.append(f"<!{n['value']}>\n")
        else:
            for child in below.get(n["id"], ()):
                put(child)

    put(nodes[0])
    return "".join(out)


def _parse_all(series: pd.Series) -> pd.Series:
    return series.map(lambda x: None if x is None else parse(x))


def _write_all(series: pd.Series) -> pd.Series:
    return series.map(lambda x: None if x is None else write([dict(n, attrs=list(n["attrs"])) for n in x]))


def decode_nodes(v: Column) -> Column:
    return F.pandas_udf(_parse_all, NODES)(v)


def encode_nodes(v: Column) -> Column:
    return F.pandas_udf(_write_all, "string")(v)


def children(nodes: Column, parent: Column | int = 0) -> Column:
    return F.filter(nodes, lambda n: n["parent"] == parent)


PLAIN = re.compile(r"(/[A-Za-z_][\w.-]*)+")


def _parsed(source: str | bytes, start: Callable, end: Callable, text: Callable | None = None) -> None:
    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, text
    try:
        p.Parse(source, True)
    except expat.ExpatError as error:
        raise ValueError(f"malformed XML: {error}") from error


def follow(source: str | bytes, steps: list[str], name: str | None = None) -> tuple[int, str]:
    """How many elements a plain path finds, and the first one's text, or attribute where a name is given (of the first element that has it)."""
    open_: list[bool] = []
    number, inside, out, depth, found = 0, False, [], len(steps), False

    def start(tag: str, attrs: dict[str, str]) -> None:
        nonlocal number, inside, found
        at = len(open_)
        fits = at < depth and (not at or open_[-1]) and tag == steps[at]
        open_.append(fits)
        if fits and at == depth - 1:
            number += 1
            if name is None:
                inside = number == 1
            elif not found and name in attrs:
                found = True
                out.append(attrs[name])

    def end(tag: str) -> None:
        nonlocal inside
        if open_.pop() and len(open_) == depth - 1:
            inside = False

    def text(data: str) -> None:
        if inside:
            out.append(data)

    _parsed(source, start, end, text)
    return number, "".join(out)


def _following(path: str, take: Callable[[tuple[int, str]], object], kind: str, name: str | None = None) -> Callable[[Column], Column]:
    steps = path.strip("/").split("/")

    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda x: None if x is None else take(follow(x, steps, name))).astype(object)

    return F.pandas_udf(run, kind)


def checked(v: Column) -> Column:
    """A document's text as it is; a malformed one fails the task."""

    def run(series: pd.Series) -> pd.Series:
        for x in series:
            if x is not None:
                _parsed(x, None, None)
        return series

    return F.pandas_udf(run, "string")(v)


def first_text(v: Column, path: str) -> Column:
    """The text of the first node that a path finds, empty if there is none."""
    return _following(path, lambda r: r[1], "string")(v) if PLAIN.fullmatch(path) else F.xpath_string(v, F.lit(path))


def texts(v: Column, path: str) -> Column:
    return F.xpath(v, F.lit(path + "/text()"))


def attribute(v: Column, path: str, name: str) -> Column:
    return _following(path, lambda r: r[1], "string", name)(v) if PLAIN.fullmatch(path) else F.xpath_string(v, F.lit(f"{path}/@{name}"))


def count(v: Column, path: str) -> Column:
    return _following(path, lambda r: r[0], "bigint")(v) if PLAIN.fullmatch(path) else F.xpath_long(v, F.lit(f"count({path})"))
