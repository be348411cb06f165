"""Block YAML: whole files scanned with a stack of indentations into rows of path and value."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: Fixed values of the format: plain scalars that mean null, those that are booleans, and numbers.
NULLS, BOOLEANS = ("", "~", "null", "Null", "NULL"), {"true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
NUMBER = re.compile(r"-?(0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " "}

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'#\-\[\]{},&*!|>%@`?:][^#]*?|-[^\s#][^#]*?|[?:][^\s][^#]*?)\s*:(?=\s|$)""")
_Path = tuple[str, ...]


class Malformed(ValueError):
    pass


def _bare(text: str) -> str:
    """A value without the comment after it."""
    if text[:1] in ('"', "'"):
        end = _quoted(text, 0)[1]
        rest = text[end:].strip()
        if rest and not rest.startswith("#"):
            raise Malformed(f"text after a quoted value: {rest}")
        return text[:end]
    return re.split(r"(?:^|\s)#", text, maxsplit=1)[0].strip()


def _quoted(text: str, at: int) -> tuple[str, int]:
    """The quoted string that begins at a place, and where it ends."""
    quote, i, out = text[at], at + 1, []
    while i < len(text):
        c = text[i]
        if quote == "'" and text[i : i + 2] == "''":
            out.append("'")
            i += 2
        elif quote == '"' and c == "\\":
            more = {"x": 2, "u": 4, "U": 8}.get(text[i + 1 : i + 2], 0)
            out.append(chr(int(text[i + 2 : i + 2 + more], 16)) if more else ESCAPES.get(text[i + 1 : i + 2], text[i + 1 : i + 2]))
            i += 2 + more
        elif c == quote:
            return "".join(out), i + 1
        else:
            out.append(c)
            i += 1
    raise Malformed("a quoted string has no end")


def scalar(text: str):
    """A string, number, boolean or None, as a plain or quoted scalar says."""
    if text[:1] in ('"', "'"):
        return _quoted(text, 0)[0]
    if text[:1] in ("&", "*", "!"):
        raise Malformed(f"anchors, aliases and tags are not read: {text}")
    if text in NULLS:
        return None
    if text in BOOLEANS:
        return BOOLEANS[text]
    return json.loads(text) if NUMBER.fullmatch(text) else text


def _flow(text: str, at: int, path: _Path, rows: list) -> int:
    """The flow value that begins at a place, as rows; where it ends."""
    while text[at : at + 1].isspace():
        at += 1
    if text[at : at + 1] in ("{", "["):
        opened, close, n, at = text[at], "}" if text[at] == "{" else "]", 0, at + 1
        while True:
            at += len(text[at:]) - len(text[at:].lstrip())
            if text[at : at + 1] == close:
                if not n:
                    rows.append((path, {} if opened == "{" else []))
                return at + 1
            if opened == "[":
                at = _flow(text, at, (*path, n), rows)
            else:
                if text[at : at + 1] in ('"', "'"):
                    key, at = _quoted(text, at)
                else:
                    end = re.compile(r"\s*:|[,}]").search(text, at)
                    if end is None:
                        raise Malformed("a flow mapping has no end")
                    key, at = text[at : end.start()], end.start()
                at += len(text[at:]) - len(text[at:].lstrip())
                if text[at : at + 1] == ":":
                    at = _flow(text, at + 1, (*path, key), rows)
                else:
                    rows.append(((*path, key), None))
            n += 1
            at += len(text[at:]) - len(text[at:].lstrip())
            if text[at : at + 1] == ",":
                at += 1
            elif text[at : at + 1] != close:
                raise Malformed("a flow collection has no end")
    if text[at : at + 1] in ('"', "'"):
        value, at = _quoted(text, at)
        rows.append((path, value))
        return at
    end = re.compile(r"[,\]}]").search(text, at)
    stop = end.start() if end else len(text)
    rows.append((path, scalar(text[at:stop].strip())))
    return stop


def _closed(text: str) -> bool:
    """Whether the brackets of a flow value are closed."""
    bare = re.sub(r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'', "", text)
    return sum(map(bare.count, "{[")) <= sum(map(bare.count, "}]"))


def scan(text: str) -> list[tuple[_Path, object]]:
    """(path, value) of every scalar and empty collection of a document, in order; items of sequences have their
    number as a step.

    Mappings and sequences in block or flow form, plain, quoted and block scalars, and comments are read; anchors,
    aliases, tags and further documents are not, and raise ``Malformed``, as anything else that fits no rule.
    """
    lines, rows = text.replace("\r\n", "\n").split("\n"), []
    stack: list[list] = []  # indentation, whether it is a sequence, key or number
    pending: tuple[_Path, int] | None = None  # a key that has no value yet, and its indentation
    i, started = 0, False
    while i < len(lines):
        raw = lines[i]
        i += 1
        content = raw.strip()
        if not content or content.startswith("#") or (content.startswith("%") and not started):
            continue
        if raw.rstrip() in ("---", "..."):
            if started and raw.startswith("---"):
                raise Malformed("more than one document")
            continue
        started = True
        indent = len(raw) - len(raw.lstrip(" "))
        if raw[indent] == "\t":
            raise Malformed("a tab indents a line")
        while True:
            dash = content == "-" or content.startswith("- ")
            key = None if dash else _KEY.match(content)
            if not dash and key is None:
                if not stack and content[0] in "{[":
                    while not _closed(content) and i < len(lines):
                        content, i = content + "\n" + lines[i], i + 1
                    _flow(content, 0, (), rows)
                    break
                if pending is not None and indent > pending[1]:
                    last = pending[0]  # a scalar on the line after its key
                    pending = None
                    rows.append((last, scalar(_bare(content))))
                    break
                if rows and stack and isinstance(rows[-1][1], str) and indent > stack[-1][0]:
                    rows[-1] = (rows[-1][0], f"{rows[-1][1]} {_bare(content)}")  # a plain scalar goes on
                    break
                raise Malformed(f"neither a key nor an item: {content}")
            while stack and (stack[-1][0] > indent or (not dash and stack[-1][0] == indent and stack[-1][1])):
                stack.pop()
            if pending is not None and not (indent > pending[1] or (dash and indent == pending[1])):
                rows.append((pending[0], None))
            pending = None
            if stack and stack[-1][0] == indent and stack[-1][1] == dash:
                stack[-1][2] = stack[-1][2] + 1 if dash else None
            else:
                stack.append([indent, dash, 0 if dash else None])
            if dash:
                rest = content[1:].lstrip()
            else:
                name = key.group(1)
                stack[-1][2] = _quoted(name, 0)[0] if name[0] in "\"'" else name
                rest = content[key.end() :].lstrip()
            path = tuple(s[2] for s in stack)
            if not rest or rest.startswith("#"):
                pending = (path, indent)
            elif dash and (rest == "-" or rest.startswith("- ") or (rest[0] not in "{[|>" and _KEY.match(rest))):
                indent, content = indent + len(content) - len(rest), rest
                continue
            elif re.fullmatch(r"[|>][-+]?\d*\s*(#.*)?", rest):
                block = []
                while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" ")) > indent):
                    block.append(lines[i])
                    i += 1
                deep = min((len(x) - len(x.lstrip(" ")) for x in block if x.strip()), default=0)
                body = "\n".join(x[deep:] for x in block).rstrip("\n")
                if rest[0] == ">":
                    body = re.sub(r"(?<!\n)\n(?!\n)", " ", body)
                rows.append((path, body + ("" if rest[1:2] == "-" or not body else "\n")))
            elif rest[0] in "{[":
                while not _closed(rest) and i < len(lines):
                    rest, i = rest + "\n" + lines[i], i + 1
                end = _flow(rest, 0, path, rows)
                if rest[end:].strip() and not rest[end:].strip().startswith("#"):
                    raise Malformed(f"text after a collection: {rest[end:].strip()}")
            else:
                rows.append((path, scalar(_bare(rest))))
            break
    if pending is not None:
        rows.append((pending[0], None))
    return rows


def nested(rows: list[tuple[_Path, object]]):
    """The document that rows come from; of a key that is there twice the last value holds."""
    top: dict = {}
    for path, value in rows:
        at = top
        for a in ("", *path[:-1]) if path else ():
            if not isinstance(at.get(a), dict):
                at[a] = {}
            at = at[a]
        at[path[-1] if path else ""] = value

    def listed(x):
        if not isinstance(x, dict):
            return x
        inner = {k: listed(v) for k, v in x.items()}
        return list(inner.values()) if inner and all(isinstance(k, int) for k in inner) else inner

    return listed(top.get("", {}))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "at", "path", "value"]
    types = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.string())
    for batch in batches:
        for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
            try:
                rows = scan(text)
            except Malformed as error:
                log.error("%s: %s", file, error)
                continue
            cells = [(file, i, [str(p) for p in path], None if v is None else v if isinstance(v, str) else json.dumps(v)) for i, (path, v) in enumerate(rows)]
            for a in range(0, len(cells), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells[a : a + 10_000], strict=True), types, strict=True)], names=names)


def _to_json(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
            try:
                out.append(json.dumps(nested(scan(text)), ensure_ascii=False))
            except Malformed as error:
                log.error("%s: %s", file, error)
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(out, pa.string())], names=["file", "json"])


def yaml_rows(texts: DataFrame) -> DataFrame:
    """Rows (``file``, ``at``, ``path``, ``value``) of whole documents (``file``, ``text``), one for each scalar, in the
    order ``at``.  A document that can't be read gives none and is logged."""
    return texts.select("file", "text").mapInArrow(_scanned, "file string, at bigint, path array<string>, value string")


def json_documents(texts: DataFrame) -> DataFrame:
    """(``file``, ``json``) of whole documents (``file``, ``text``), JSON or block YAML; null where one can't be read."""
    marked = texts.select("file", "text", F.try_parse_json("text").isNotNull().alias("plain"))
    scanned = marked.filter("not plain and text is not null").select("file", "text").mapInArrow(_to_json, "file string, json string")
    return marked.filter("plain or text is null").select("file", F.col("text").alias("json")).unionByName(scanned)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (``file``, ``text``)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
