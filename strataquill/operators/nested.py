"""Deeply nested JSON into flat, linked tables.

One depth-first pass over each document emits a row per nested object that carries an id of its own: the tag of the
table it belongs to, its key, the key of the nearest enclosing object with a key, and its other fields as payload.
The tagged rows are written once, partitioned by tag, and each tag is then read under its own schema.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kind of object -> names of the fields that hold such objects.
EVIDENCE_KINDS: dict[str, tuple[str, ...]] = {
    "claim": ("claim", "claims", "sub_claims"),
    "aspect": ("aspect", "aspects"),
    "gap": ("gap", "gaps"),
    "stage": ("stage", "stages"),
    "task": ("task", "tasks", "sub_tasks"),
    "attempt": ("attempt", "attempts"),
    "artifact": ("artifact", "artifacts"),
    "row": ("row", "rows", "children"),
    "cell": ("cell", "cells"),
    "note": ("note", "notes", "footnote", "footnotes"),
}


#: Fields of each kind of object, as its flat table has them.
EVIDENCE_SCHEMAS: dict[str, str] = {
    "claim": "text string, kind string, citation_refs array<string>",
    "aspect": "text string, claim_ids array<string>",
    "gap": "reason string",
    "stage": "status string, metrics struct<tokens: bigint, seconds: double>",
    "task": "status string, metrics struct<tokens: bigint, seconds: double>",
    "attempt": "status string",
    "artifact": "sha256 string, bytes bigint",
    "row": "label string",
    "cell": "value string, unit string",
    "note": "text string",
}

_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_BLANKS = re.compile(r"[ \t\n\r]*")
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def decode_deep(text: str) -> object:
    """The value of a JSON text nested to any depth, read with an explicit stack; ValueError if it is not valid."""
    skip = lambda i: _BLANKS.match(text, i).end()
    root: list = []
    open_: list[tuple[list | dict, str | None]] = [(root, None)]
    at = skip(0)
    while True:
        # One value, put into the innermost open container.
        container, key = open_[-1]
        char = text[at : at + 1]
        if char in ("{", "["):
            value: object = {} if char == "{" else []
            at = skip(at + 1)
        elif char == '"':
            value, at = scanstring(text, at + 1, True)
        elif char in _WORDS:
            word, value = _WORDS[char]
            if not text.startswith(word, at):
                raise ValueError(at)
            at += len(word)
        else:
            hit = _NUMBER.match(text, at)
            if not hit:
                raise ValueError(at)
            value = float(hit.group()) if hit.group(2) or hit.group(3) else int(hit.group())
            at = hit.end()
        if isinstance(container, dict):
            container[key] = value
        else:
            container.append(value)
        if char in ("{", "["):
            open_.append((value, None))
            if text[at : at + 1] not in ("}", "]"):
                if char == "{":
                    at = _next_key(text, at, open_, skip)
                continue
        # Containers that end here, up to the next value.
        while True:
            at = skip(at)
            container = open_[-1][0]
            if container is root:
                if at != len(text):
                    raise ValueError(at)
                return root[0]
            char, at = text[at : at + 1], skip(at + 1)
            if char == ("}" if isinstance(container, dict) else "]"):
                open_.pop()
            elif char == ",":
                if isinstance(container, dict):
                    at = _next_key(text, at, open_, skip)
                break
            else:
                raise ValueError(at)


def _next_key(text: str, at: int, open_: list, skip: Callable[[int], int]) -> int:
    """Reads a key and its colon and notes the key at the open object; gives the place of the value."""
    if text[at : at + 1] != '"':
        raise ValueError(at)
    key, at = scanstring(text, at + 1, True)
    at = skip(at)
    if text[at : at + 1] != ":":
        raise ValueError(at)
    open_[-1] = (open_[-1][0], key)
    return skip(at + 1)


def encode_deep(value: object) -> str:
    """JSON of a value nested to any depth."""
    out: list[str] = []
    stack: list[tuple[bool, object]] = [(False, value)]
    while stack:
        plain, node = stack.pop()
        if plain:
            out.append(node)
        elif isinstance(node, dict):
            stack.append((True, "}"))
            for i, (k, v) in reversed(list(enumerate(node.items()))):
                stack += [(False, v), (True, (", " if i else "") + json.dumps(k, ensure_ascii=False) + ": ")]
            out.append("{")
        elif isinstance(node, list):
            stack.append((True, "]"))
            for i, v in reversed(list(enumerate(node))):
                stack += [(False, v), (True, ", " if i else "")]
            out.append("[")
        else:
            out.append(json.dumps(node, ensure_ascii=False))
    return "".join(out)


class Slot:
    """Where a field goes in the payload of the nearest object with an id; containers come to be when something is put in them."""

    __slots__ = ("parent", "key", "held", "placed")

    def __init__(self, held: dict | list, parent: Slot | None = None, key: str | None = None) -> None:
        self.parent, self.key, self.held, self.placed = parent, key, held, parent is None

    def put(self, key: str | None, value: object) -> None:
        chain: list[tuple[Slot, str | None, object]] = [(self, key, value)]
        while not chain[-1][0].placed:
            slot = chain[-1][0]
            slot.placed = True
            chain.append((slot.parent, slot.key, slot.held))
        for slot, name, item in reversed(chain):
            if isinstance(slot.held, dict):
                slot.held[name] = item
            else:
                slot.held.append(item)


class Visitor:
    """Depth-first walk of one decoded document; iterative throughout, so depth is limited by memory only."""

    def __init__(self, kinds: Mapping[str, tuple[str, ...]], with_payload: bool) -> None:
        self.kind_of_field = {name: kind for kind, names in kinds.items() for name in names}
        self.kind_of_id = {f"{kind}_id": kind for kind in kinds}
        self.with_payload = with_payload

    @staticmethod
    def decode(text: str) -> object | None:
        """The JSON value of ``text``; None if it is not valid JSON (RFC 8259, so no NaN)."""

        def refuse(token: str) -> object:
            raise ValueError(token)

        try:
            return json.loads(text, parse_constant=refuse)
        except RecursionError:
            try:
                return decode_deep(text)
            except ValueError:
                return None
        except ValueError:
            return None

    def own_id(self, node: dict, hint: str | None) -> tuple[str, str] | None:
        """(kind, id) of an object: the kind its place calls for comes before other id fields."""
        named = ([f"{hint}_id"] if hint else []) + [key for key in self.kind_of_id if key in node]
        for key in named:
            value = node.get(key)
            if isinstance(value, (str, int)) and not isinstance(value, bool) and value != "":
                return self.kind_of_id[key], str(value)
        return None

    def opened(self, node: object) -> object:
        """The container held in a JSON string, however often it is encoded; any other value as it is."""
        while isinstance(node, str) and node[:64].lstrip()[:1] in ("{", "[", '"'):
            inner = self.decode(node)
            if not isinstance(inner, (dict, list, str)) or inner == node:
                break
            if isinstance(inner, str) and inner[:64].lstrip()[:1] not in ("{", "[", '"'):
                break
            node = inner
        return node

    def visit(self, text: str, record_key: str) -> Iterator[tuple[str, str, str, str | None]]:
        """(tag, parent id, own id, payload) for every object with an id, parents before children.

        The payload is the object's JSON with all its fields and plain objects and lists, but without objects that have
        an id of their own, as these have rows of their own.
        """
        rows: list[tuple[str, str, str, dict]] = []
        # value, parent id, kind its place calls for, key it is kept under, slot and name in the payload
        stack: list[tuple[object, str, str | None, str | None, Slot, str | None]] = [(self.decode(text), record_key, None, None, Slot({}), None)]
        while stack:
            node, parent, hint, key, slot, name = stack.pop()
            node = self.opened(node)
            if isinstance(node, list):
                inner = Slot([], slot, name)
                stack.extend((child, parent, hint, None, inner, None) for child in reversed(node))
                if not node:
                    slot.put(name, [])
            elif isinstance(node, dict):
                found = self.own_id(node, hint)
                if found is None and key is not None and hint is not None:
                    found = hint, key
                if found is None and hint is not None and node and all(self.holds_object(v) for v in node.values()):
                    keyed = [(v, parent, hint, k, slot, k) for k, v in node.items() if k not in self.kind_of_field]
                    if len(keyed) == len(node):
                        stack.extend(reversed(keyed))
                        continue
                if found is not None:
                    inner = Slot({})
                    rows.append((found[0], parent, found[1], inner.held))
                    parent = found[1]
                elif name is None and slot.parent is None and slot.held == {}:
                    inner = slot
                else:
                    inner = Slot({}, slot, name)
                    if not node:
                        slot.put(name, {})
                stack.extend((v, parent, self.kind_of_field.get(k), None, inner, k) for k, v in reversed(node.items()))
            elif self.with_payload:
                slot.put(name, node)
        for tag, parent, own, payload in rows:
            yield tag, parent, own, self.encode(payload) if self.with_payload else None

    @staticmethod
    def encode(payload: dict) -> str:
        try:
            return json.dumps(payload, ensure_ascii=False)
        except RecursionError:
            return encode_deep(payload)

    def holds_object(self, value: object) -> bool:
        value = self.opened(value)
        return value is None or isinstance(value, dict)


def emit_nested(df: DataFrame, record_key: Column | str, json_col: str, source: str, kinds: Mapping[str, tuple[str, ...]] = EVIDENCE_KINDS, with_payload: bool = True) -> DataFrame:
    """(source_table, record_key, table_tag, parent_id, child_id, payload) of every nested object with an id.

    Null, empty and invalid JSON and null keys give no rows; JSON held in a JSON string is opened; repeated input rows
    repeat their output (use ``distinct`` where rows are delivered twice). Other columns of ``df`` are ignored, so their
    names cannot clash. No shuffle: a map over the scan of two columns.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("source_table", "record_key", "table_tag", "parent_id", "child_id", "payload")])
    arrow = pa.schema([(f.name, pa.string()) for f in schema])
    key = F.col(record_key) if isinstance(record_key, str) else record_key
    slim = df.select(key.cast("string").alias("k"), F.col(json_col).cast("string").alias("j")).where("k is not null and j is not null and j rlike '[{]'")
    kinds = {k: tuple(v) for k, v in kinds.items()}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor = Visitor(kinds, with_payload)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for k, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for tag, parent, own, payload in visitor.visit(j, k):
                    for column, value in zip(out, (k, tag, parent, own, payload), strict=True):
                        column.append(value)
            arrays = [pa.array([source] * len(out[0]), pa.string()), *(pa.array(c, pa.string()) for c in out)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return slim.mapInArrow(walk, schema)


def write_tagged(emitted: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write emitted rows once, in a directory per table tag."""
    emitted.write.mode(mode).partitionBy("table_tag").parquet(path)


def read_tagged(spark: SparkSession, path: str, tag: str, schema: str | T.StructType) -> DataFrame:
    """One child table: its keys, and the payload under ``schema`` (fields it lacks are null)."""
    columns = "source_table string, record_key string, parent_id string, child_id string, payload string, table_tag string"
    rows = spark.read.schema(columns).parquet(path).where(F.col("table_tag") == tag)
    return rows.select("source_table", "record_key", "parent_id", "child_id", F.from_json("payload", schema).alias("f")).select("source_table", "record_key", "parent_id", "child_id", "f.*")


def emit_evidence(blocks: DataFrame, manifests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Tagged rows of the three JSON columns of the evidence model."""
    parts = [
        emit_nested(blocks, "evidence_id", "structured_payload", "evidence_blocks"),
        emit_nested(manifests, "run_id", "manifest_json", "run_manifest"),
        emit_nested(outcomes, F.concat_ws("/", F.col("run_id"), F.col("question_id")), "outcome_json", "question_outcome"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


class TaggedTables:
    """Emitted rows written once by tag, and read back as linked flat tables under the schemas of their kinds."""

    def __init__(self, emitted: DataFrame, path: str, schemas: Mapping[str, str] = EVIDENCE_SCHEMAS) -> None:
        self.spark, self.path, self.schemas = emitted.sparkSession, path, dict(schemas)
        write_tagged(emitted, path)

    def links(self) -> DataFrame:
        """(source_table, record_key, table_tag, parent_id, child_id), each link once; payloads are not read."""
        columns = T.StructType([T.StructField(n, T.StringType()) for n in ("source_table", "record_key", "parent_id", "child_id", "table_tag")])
        return self.spark.read.schema(columns).parquet(self.path).select("source_table", "record_key", "table_tag", "parent_id", "child_id").distinct()

    def child(self, tag: str) -> DataFrame:
        """The flat table of one kind, repeated deliveries of a row once."""
        return read_tagged(self.spark, self.path, tag, self.schemas[tag]).distinct()


#: Kinds of objects of a research contract, and the fields that hold them.
CONTRACT_KINDS = {"section": ("sections",), "topic": ("topics",), "question": ("questions",), "aspect": ("aspects",)}


def contract_tables(contracts: DataFrame, key: str, json_col: str) -> DataFrame:
    """Tagged rows of versioned contracts (sections, topics, questions, aspects) with ``fingerprint``, the SHA-256 of the text they were read from."""
    rows = emit_nested(contracts, key, json_col, "contract", CONTRACT_KINDS)
    marks = contracts.select(F.col(key).cast("string").alias("record_key"), F.sha2(F.col(json_col), 256).alias("fingerprint")).distinct()
    return rows.join(marks, "record_key")
