"""Structure of nested documents: which paths there are, of what kinds, how often, and whether they may be absent.

Every task walks its documents and adds them to a trie of paths; tries are sums, minima, maxima and bit sets, so they merge in any
order and the shuffle carries one row for each task and path, not one for each node.  A node's parent is an object or array of
JSON, or an element of XML; a path is optional when some parent of its kind lacks it.

JSON paths read ``$.a.b[].c``, XML paths ``/a/b/@c`` and ``/a/b/text()``.  A text that cannot be read is one node of kind ``unreadable``
at the root path ``$`` or ``/``; a NULL text is left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelane.session import settle, ship_package

KINDS = ("array", "boolean", "element", "integer", "null", "number", "object", "text", "unreadable")
HELD = 100_000
"""Paths that a task holds before it hands them on."""
FIELDS = ("kinds", "nodes", "objects", "arrays", "documents", "holders", "least", "most")
_BIT = {kind: 1 << k for k, kind in enumerate(KINDS)}


def _scalar(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return "integer" if isinstance(value, int) else "number" if isinstance(value, float) else "text"


def _written(text: str) -> str:
    """Kind of an XML value."""
    for kind, read in (("integer", int), ("number", float)):
        try:
            read(text)
            return kind
        except ValueError:
            pass
    return "boolean" if text in ("true", "false") else "text"


def json_nodes(text: str) -> Iterator[tuple[str, str, str, int]]:
    """(path, parent path, kind, parent's number) of every node."""
    try:
        todo = [("$", "", json.loads(text), 0)]
    except ValueError:
        yield "$", "", "unreadable", 0
        return
    number = 0
    while todo:
        path, parent, value, of = todo.pop()
        number += 1
        if isinstance(value, dict):
            yield path, parent, "object", of
            todo += [(f"{path}.{name}", path, v, number) for name, v in value.items()]
        elif isinstance(value, list):
            yield path, parent, "array", of
            todo += [(f"{path}[]", path, v, number) for v in value]
        else:
            yield path, parent, _scalar(value), of


def xml_nodes(text: str) -> Iterator[tuple[str, str, str, int]]:
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        yield "/", "", "unreadable", 0
        return
    todo, number = [(f"/{root.tag}", "", root, 0)], 0
    while todo:
        path, parent, node, of = todo.pop()
        number += 1
        yield path, parent, "element", of
        for name, value in node.attrib.items():
            yield f"{path}/@{name}", path, _written(value), number
        if node.text and node.text.strip():
            yield f"{path}/text()", path, _written(node.text.strip()), number
        todo += [(f"{path}/{child.tag}", path, child, number) for child in node]


def _add(trie: dict, key, text: str, walk) -> None:
    """One document into the trie: (key, path) to its parent path and counts."""
    here: dict = {}
    for path, parent, kind, of in walk(text):
        entry = here.get(path)
        if entry is None:
            entry = here[path] = [parent, 0, 0, 0, 0, {}]
        entry[1] |= _BIT[kind]
        entry[2] += 1
        entry[3] += kind in ("object", "element")
        entry[4] += kind == "array"
        entry[5][of] = entry[5].get(of, 0) + 1
    for path, (parent, kinds, nodes, objects, arrays, of) in here.items():
        least, most = min(of.values()), max(of.values())
        entry = trie.get((key, path))
        if entry is None:
            trie[key, path] = [parent, kinds, nodes, objects, arrays, 1, len(of), least, most]
        else:
            entry[1] |= kinds
            for k, n in ((2, nodes), (3, objects), (4, arrays), (5, 1), (6, len(of))):
                entry[k] += n
            entry[7], entry[8] = min(entry[7], least), max(entry[8], most)


def _read(text: str):
    """A document that is an object or array, else None: a single value or an unreadable text is a single node."""
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, (dict, list)) else None


class Node:
    """A path of plain JSON documents: its counts, and the nodes of its members and items."""

    __slots__ = ("kinds", "nodes", "objects", "arrays", "documents", "holders", "least", "most", "seen", "members", "items")

    def __init__(self):
        self.kinds = self.nodes = self.objects = self.arrays = self.documents = self.holders = self.most = 0
        self.least, self.seen, self.members, self.items = 1 << 62, -1, {}, None


_OF_TYPE = {type(None): _BIT["null"], bool: _BIT["boolean"], int: _BIT["integer"], float: _BIT["number"], str: _BIT["text"]}


def _add_json(root: Node, value, document: int) -> int:
    """One read document into the nodes of its key, numbered ``document``; returns how many paths are new.

    A member occurs once in its object and the items of an array have it as their one parent, so nothing is kept
    for each parent.  Names must not look like paths (see ``_plain``).
    """
    new, todo = 0, [(root, value)]
    root.nodes, root.documents, root.holders, root.least, root.most = root.nodes + 1, root.documents + 1, root.holders + 1, 1, max(root.most, 1)
    while todo:
        node, value = todo.pop()
        kind = type(value)
        if kind is dict:
            node.kinds |= _BIT["object"]
            node.objects += 1
            members = node.members
            for name, v in value.items():
                child = members.get(name)
                if child is None:
                    child = members[name] = Node()
                    child.least = child.most = 1
                    new += 1
                child.nodes += 1
                child.holders += 1
                if child.seen != document:
                    child.seen = document
                    child.documents += 1
                bit = _OF_TYPE.get(type(v))
                if bit:
                    child.kinds |= bit
                else:
                    todo.append((child, v))
        elif kind is list:
            node.kinds |= _BIT["array"]
            node.arrays += 1
            if value:
                child = node.items
                if child is None:
                    child = node.items = Node()
                    new += 1
                many = len(value)
                child.nodes += many
                child.holders += 1
                child.least, child.most = min(child.least, many), max(child.most, many)
                if child.seen != document:
                    child.seen = document
                    child.documents += 1
                todo += [(child, v) for v in value]
        else:
            node.kinds |= _OF_TYPE[kind]
    return new


def _plain(value) -> bool:
    """No name in the document has a dot or bracket, which two different places could share a path by."""
    todo = [value]
    while todo:
        value = todo.pop()
        if type(value) is dict:
            for name, v in value.items():
                if "." in name or "[" in name:
                    return False
                if type(v) is dict or type(v) is list:
                    todo.append(v)
        elif type(value) is list:
            todo += [v for v in value if type(v) is dict or type(v) is list]
    return True


def _listed(roots: dict) -> Iterator[tuple]:
    """(key, path) and trie entry of every node."""
    todo = [(key, "$", "", node) for key, node in roots.items()]
    while todo:
        key, path, parent, n = todo.pop()
        yield (key, path), [parent, n.kinds, n.nodes, n.objects, n.arrays, n.documents, n.holders, n.least, n.most]
        todo += [(key, f"{path}.{name}", path, child) for name, child in n.members.items()]
        if n.items is not None:
            todo.append((key, f"{path}[]", path, n.items))


def structure(df: DataFrame, key: str, text: str, form: str = "json") -> DataFrame:
    """Per key and path of the documents in ``text`` (``form``: json or xml): ``kinds``, ``documents`` that have it, ``occurrences``, ``least`` and
    ``most`` under one parent (0 where a parent may lack it) and ``optional``."""
    ship_package(df.sparkSession)
    walk = {"json": json_nodes, "xml": xml_nodes}[form]
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    kind = rows.schema["key"].dataType

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: dict = {}
        roots: dict = {}
        document = held = 0

        def hand_on() -> pa.RecordBatch:
            entries = [*trie.items(), *_listed(roots)]
            columns = [pa.array([k for (k, _), _ in entries], key_type), pa.array([p for (_, p), _ in entries], pa.string()), pa.array([e[0] for _, e in entries], pa.string())]
            columns += [pa.array([e[k] for _, e in entries], pa.int64()) for k in range(1, 9)]
            trie.clear()
            roots.clear()
            return pa.RecordBatch.from_arrays(columns, ["key", "path", "parent", *FIELDS])

        key_type = pa.string()
        for batch in batches:
            key_type = batch.column(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = _read(t) if form == "json" else None
                if value is not None and _plain(value):
                    document += 1
                    if k not in roots:
                        roots[k] = Node()
                    held += _add_json(roots[k], value, document)
                else:
                    _add(trie, k, t, walk)
                if len(trie) + len(roots) + held > HELD:
                    yield hand_on()
                    held = 0
        if trie or roots:
            yield hand_on()

    parts = rows.mapInArrow(collect, f"key {kind.simpleString()}, path string, parent string, {', '.join(f'{f} bigint' for f in FIELDS)}")
    sums = [F.sum(f).alias(f) for f in ("nodes", "objects", "arrays", "documents", "holders")]
    paths = parts.groupBy("key", "path", "parent").agg(F.bit_or("kinds").alias("kinds"), *sums, F.min("least").alias("least"), F.max("most").alias("most"))
    paths = settle(paths)  # read twice below; the documents are walked once
    # The root's parent is the document itself.
    slots = paths.select(F.col("key").alias("of_key"), F.col("path").alias("of"), F.col("objects").alias("of_objects"), F.col("arrays").alias("of_arrays"))
    joined = paths.join(slots, F.col("key").eqNullSafe(F.col("of_key")) & (F.col("parent") == F.col("of")), "left")
    parents = F.when(F.col("path") == F.concat("parent", F.lit("[]")), F.col("of_arrays")).otherwise(F.col("of_objects"))
    optional = F.coalesce(F.col("holders") < parents, F.lit(False))
    named = F.array_compact(F.array(*[F.when(F.col("kinds").bitwiseAND(bit) != 0, kind) for kind, bit in _BIT.items()]))
    out = joined.withColumns({"optional": optional, "kinds": named})
    return out.select("key", "path", "kinds", "documents", F.col("nodes").alias("occurrences"), F.when(F.col("optional"), 0).otherwise(F.col("least")).cast("bigint").alias("least"), "most", "optional")
