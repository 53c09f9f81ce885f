"""Spark's own SQL parser as a front end: scripts are split, statements become plan trees.

``parse`` asks the session's Catalyst parser for one statement and reads the whole tree with one
``toJSON`` call, since a walk over the JVM objects costs a round trip a node.  What that JSON leaves
out (partition specifications, ``SET`` pairs, folders) is fetched from the JVM by itself.  That JSON parts names by commas, so
commas inside quoted names travel as another character.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession


#: Stands for a comma inside a quoted name.
_COMMA = "\ue000"
#: Nodes that only mark how a query was written.
_MARKS = {"PipeExpression", "PipeOperator"}


@dataclass
class Node:
    """One plan or expression node: short class name, plain fields, children."""

    kind: str
    fields: dict[str, Any]
    children: list[Node] = field(default_factory=list)

    def node(self, name: str) -> Node | None:
        got = self.fields.get(name)
        if isinstance(got, int) and not isinstance(got, bool) and 0 <= got < len(self.children):
            return self.children[got]
        if isinstance(got, Node):
            return got
        return None

    def nodes(self, name: str) -> list[Node]:
        got = self.fields.get(name)
        if isinstance(got, Node):
            return [got]
        return [x for x in got if isinstance(x, Node)] if isinstance(got, list) else []

    def walk(self) -> Iterator[Node]:
        """This node and all below it, expressions held in fields included."""
        yield self
        for v in self.fields.values():
            yield from _inside(v)
        for c in self.children:
            yield from c.walk()


def _inside(value: Any) -> Iterator[Node]:
    if isinstance(value, Node):
        yield from value.walk()
    elif isinstance(value, list):
        for v in value:
            yield from _inside(v)
    elif isinstance(value, dict):
        for v in value.values():
            yield from _inside(v)


def _value(raw: Any) -> Any:
    if isinstance(raw, list):
        if raw and all(isinstance(x, dict) and "num-children" in x for x in raw):
            it = iter(raw)
            made = [_build(it)]
            for head in it:  # several trees side by side
                made.append(_build(it, head))
            return made[0] if len(made) == 1 else made
        return [_value(x) for x in raw]
    if isinstance(raw, dict):
        return {k: _value(v) for k, v in raw.items()}
    return raw.replace(_COMMA, ",") if isinstance(raw, str) and raw[:1] != "[" else raw


def _build(it: Iterator[dict], raw: dict | None = None) -> Node:
    raw = next(it) if raw is None else raw
    node = Node(raw["class"].rpartition(".")[2], {k: _value(v) for k, v in raw.items() if k not in ("class", "num-children")})
    node.children = [_build(it) for _ in range(raw["num-children"])]
    return node.children[0] if node.kind in _MARKS else node


def names(text: str | list | None) -> list[str]:
    """``[a, b]`` as the tree's JSON writes a list of names."""
    if not text:
        return []
    if isinstance(text, list):
        return [str(x) for x in text]
    return [x.replace(_COMMA, ",") for x in (text[1:-1].split(", ") if text[:1] == "[" else [text])]


def object_name(value: Any) -> str:
    """Short name of a Scala object or case class in a field, as ``LeftOuter``."""
    if isinstance(value, dict):
        return (value.get("object") or value.get("product-class") or "").rpartition(".")[2].rstrip("$")
    return value.kind if isinstance(value, Node) else str(value or "")


@dataclass
class Parsed:
    tree: Node
    partition: dict[str, str | None]
    setting: tuple[str, str] | None
    view_names: list[str]
    folder: str = ""
    format: str | None = None


class ScriptError(ValueError):
    """A statement that Catalyst does not accept."""


def _option(o: Any) -> Any:
    return o.get() if o.isDefined() else None


def parse(spark: SparkSession, sql: str) -> Parsed:
    """Parse one statement.  Variable substitution plays no part here: ``${x}`` in a string stays as written."""
    sql = "".join(x.replace(",", _COMMA) if x[:1] == "`" else x for x in _PIECE.findall(sql)) if "`" in sql else sql
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        text = str(getattr(e, "desc", None) or e)
        raise ScriptError(text.split("== SQL")[0].strip()[:500].replace(_COMMA, ",")) from e
    tree = _build(iter(json.loads(plan.toJSON())))
    partition: dict[str, str | None] = {}
    setting = None
    columns: list[str] = []
    folder, form = "", None
    kind = tree.kind
    if kind == "InsertIntoStatement":
        it = plan.partitionSpec().iterator()
        while it.hasNext():
            kv = it.next()
            partition[kv._1()] = _option(kv._2())
    elif kind == "TruncatePartition":
        spec = plan.partitionSpec().spec().iterator()
        while spec.hasNext():
            kv = spec.next()
            partition[kv._1()] = kv._2()
    elif kind == "SetCommand":
        kv = _option(plan.kv())
        if kv is not None and kv._2().isDefined():
            setting = (kv._1(), kv._2().get())
    elif kind == "CreateViewCommand":
        it = plan.userSpecifiedColumns().iterator()
        while it.hasNext():
            columns.append(it.next()._1())
    elif kind == "InsertIntoDir":
        where, form = _option(plan.storage().locationUri()), _option(plan.provider())
        folder = where.getPath() if where is not None else ""
    elif kind in ("CreateTableAsSelect", "ReplaceTableAsSelect"):
        parts = plan.partitioning()
        partition = {parts.apply(i).describe().strip("`").replace(_COMMA, ","): None for i in range(parts.size())}
    elif kind == "OverwriteByExpression":
        # REPLACE WHERE: equalities with literals name the part that is replaced
        partition = {}
        todo = [tree.fields["deleteExpr"]]
        while todo:
            e = todo.pop()
            if e.kind == "And":
                todo += e.children[::-1]
            elif e.kind == "EqualTo" and e.children[0].kind == "UnresolvedAttribute" and e.children[1].kind == "Literal":
                partition[names(e.children[0].fields["nameParts"])[-1]] = str(e.children[1].fields["value"])
            else:
                partition["*"] = "condition"
    return Parsed(tree, partition, setting, columns, folder, form)


_PIECE = re.compile(r"--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^'\\]|\\.|'')*(?:'|\Z)|\"(?:[^\"\\]|\\.)*(?:\"|\Z)|`(?:[^`]|``)*(?:`|\Z)|;|[^;'\"`/-]+|.", re.S)


@dataclass
class Statement:
    index: int
    text: str
    kind: str


def split_script(text: str) -> list[Statement]:
    """Statements of a script in order; strings, quoted names and comments hide semicolons.

    ``kind`` is ``sql``, ``empty`` (nothing between two semicolons) or ``comment`` (comments alone).
    The part after the last semicolon counts only if it holds something.
    """
    out: list[Statement] = []
    now: list[str] = []
    solid = commented = False

    def close(last: bool = False) -> None:
        nonlocal solid, commented
        body = "".join(now).strip()
        now.clear()
        if body or not last:
            out.append(Statement(len(out), body, "sql" if solid else "comment" if commented else "empty"))
        solid = commented = False

    for m in _PIECE.finditer(text):
        piece = m[0]
        if piece == ";":
            close()
            continue
        if piece.startswith(("--", "/*")):
            commented = True
        elif piece.strip():
            solid = True
        now.append(piece)
    close(last=True)
    return out
