"""Nested settings files as rows: the subset of YAML that lists of features are written in.

Blocks of ``key: value`` and ``- item`` lines by indentation, quoted and plain scalars, plain
ones and double-quoted ones carried over lines, comments, and [] and {} for nothing. Other
notations (anchors, tags, flow lists with items, | and > blocks) are refused, not guessed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.sources.publish import located

#: Fixed value: the key under which settings files list features by group.
FEATURES = "featurematrix"

SCHEMA = "file string, mtime timestamp, keys array<string>, value string"

_KEY = re.compile(r"""('(?:[^']|'')*'|"(?:[^"\\]|\\.)*"|[^\s'"\-\[\]{}&*!|>%@`#].*?|-[^\s].*?)\s*:(?=\s|$)""")
#: A line up to a comment: quoted stretches, where a scalar begins with the quote, hold none.
_COMMENT = re.compile(r"""^((?:(?<![^\s:])(?:'(?:[^']|'')*'|"(?:[^"\\]|\\.)*")|(?<!\s)#|[^#])*?)(?:(?:(?<=\s)|^)#.*)?$""")
_ESCAPES = {"n": "\n", "t": "\t", '"': '"', "\\": "\\", "/": "/", "0": "\0", "e": "\x1b", " ": " "}


def _scalar(text: str, line: int) -> str | None:
    """The text of a scalar; null for ~, null and nothing. Types are the reader's to choose."""
    if text[:1] == "'":
        if not re.fullmatch(r"'(?:[^']|'')*'", text):
            raise ValueError(f"line {line}: unclosed quote")
        return text[1:-1].replace("''", "'")
    if text[:1] == '"':
        if not re.fullmatch(r'"(?:[^"\\]|\\.)*"', text):
            raise ValueError(f"line {line}: unclosed quote")

        def plain(m: re.Match) -> str:
            code = m[1] or m[2] or m[3]
            return chr(int(code[1:], 16)) if len(code) > 1 else _ESCAPES[code]

        return re.sub(r"\\(x[0-9a-fA-F]{2})|\\(u[0-9a-fA-F]{4})|\\(.)", plain, text[1:-1])
    if text[:1] and text[0] in "[{&*!|>%@`":
        raise ValueError(f"line {line}: notation {text[0]} is not read")
    return None if text in ("", "~", "null", "Null", "NULL") else text


def _lines(text: str) -> Iterator[tuple[int, int, str]]:
    """(number, indentation, content) of lines, without comments; a scalar's further lines joined."""
    held: tuple[int, int, str] | None = None
    for n, raw in enumerate(text.splitlines(), 1):
        line = _COMMENT.sub(r"\1", raw) if "#" in raw else raw
        body = line.strip()
        if not body or body == "---":
            continue
        indent = len(line) - len(line.lstrip(" "))
        if line[:indent + 1].endswith("\t"):
            raise ValueError(f"line {n}: indented by a tab")
        open_quote = held is not None and _open_quote(held[2])
        goes_on = held is not None and (open_quote or indent > held[1] and not body.startswith("- ") and not _KEY.match(body) and _has_value(held[2]))
        if goes_on:
            held = (held[0], held[1], f"{held[2]} {body}")
            continue
        if held is not None:
            yield held
        held = (n, indent, body)
    if held is not None:
        yield held


def _value_of(body: str) -> str:
    while body.startswith("- "):
        body = body[2:].lstrip()
    m = _KEY.match(body)
    return body[m.end() :].strip() if m else body


def _has_value(body: str) -> bool:
    return _value_of(body) != "" and body != "-"


def _open_quote(body: str) -> bool:
    value = _value_of(body)
    return value[:1] in ("'", '"') and not re.fullmatch(r"""'(?:[^']|'')*'|"(?:[^"\\]|\\.)*\"""", value)


def leaves(text: str) -> Iterator[tuple[list[str], str | None]]:
    """(keys, value) of each leaf in order; places in lists are keys 0, 1 and so on. An empty
    list or mapping has no leaves."""
    # open blocks: indentation, and the key or place that is being filled
    stack: list[list] = []
    for n, indent, body in _lines(text):
        while True:
            item = body == "-" or body.startswith("- ")
            while stack and (stack[-1][0] > indent or stack[-1][0] == indent and stack[-1][2] and not item):
                stack.pop()
            if item:
                if stack and stack[-1][0] == indent and stack[-1][2]:
                    stack[-1][1] = str(int(stack[-1][1]) + 1)
                else:
                    stack.append([indent, "0", True])
                rest = body[1:].lstrip()
                if not rest:
                    break
                indent += len(body) - len(rest)
                body = rest
                if body == "-" or body.startswith("- ") or _KEY.match(body):
                    continue
                yield from _leaf(stack, body, n)
                break
            m = _KEY.match(body)
            if m is None:
                if stack or indent:
                    raise ValueError(f"line {n}: neither a key nor an item")
                yield from _leaf(stack, body, n)
                break
            key = _scalar(m[1], n)
            if stack and stack[-1][0] == indent and not stack[-1][2]:
                stack[-1][1] = key
            else:
                stack.append([indent, key, False])
            value = body[m.end() :].strip()
            if value:
                yield from _leaf(stack, value, n)
            break


def _leaf(stack: list[list], value: str, line: int) -> Iterator[tuple[list[str], str | None]]:
    if value not in ("[]", "{}"):
        yield [s[1] for s in stack], _scalar(value, line)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, only: list[str] | None):
        self.path, self.only = path, only

    def partitions(self) -> list[InputPartition]:
        """One a file."""
        return [_File(f) for f in (sorted(mtimes(self.path)) if self.only is None else self.only)]

    def read(self, partition: _File) -> Iterator[tuple]:
        system, at = located(partition.path)
        mtime = system.get_file_info(at).mtime
        with system.open_input_stream(at) as f:
            text = f.read().decode("utf-8")
        for keys, value in leaves(text):
            yield partition.path, mtime, keys, value


class YamlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nested_yaml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        only = self.options.get("only")
        return _Reader(self.options["path"], only.split("\n") if only else None)


def mtimes(path: str) -> dict[str, int]:
    """When each .yaml file at or under ``path`` was last changed, in nanoseconds."""
    system, at = located(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return {f.path: f.mtime_ns for f in found if f.type == fs.FileType.File and f.path.endswith((".yaml", ".yml"))}


def read_yaml(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """(file, mtime, keys, value): the leaves of the files at or under ``path``, or some of them.
    A list's places are keys that count from 0."""
    spark.dataSource.register(YamlSource)
    reader = spark.read.format("nested_yaml").option("path", path)
    return (reader.option("only", "\n".join(only)) if only else reader).load()


class Reloaded:
    """Files that are read anew where they changed: ``rows`` looks at modification times, and
    reads only files that are new or have another time than when they were read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._seen: dict[str, int] = {}
        self._frames: dict[str, DataFrame] = {}
        self.reads = 0

    def rows(self) -> DataFrame:
        now = mtimes(self.path)
        for file in sorted(now):
            if self._seen.get(file) != now[file]:
                old = self._frames.pop(file, None)
                if old is not None:
                    old.unpersist()
                self._frames[file] = read_yaml(self.spark, self.path, [file]).cache()
                self.reads += 1
        for file in self._frames.keys() - now.keys():
            self._frames.pop(file).unpersist()
        self._seen = now
        out = self.spark.createDataFrame([], SCHEMA)
        for file in sorted(self._frames):
            out = out.union(self._frames[file])
        return out


def features(rows: DataFrame) -> DataFrame:
    """(grp, feature, version, state) of the leaves of feature lists, in which each group holds
    items with a name and a map of versions."""
    k = F.col("keys")
    own = rows.where((k[0] == FEATURES) & (F.size(k) >= 4)).select("file", k[1].alias("grp"), k[2].alias("item"), "keys", "value")
    names = own.where((F.size(k) == 4) & (k[3] == "name")).select("file", "grp", "item", F.rtrim("value").alias("feature"))
    states = own.where((F.size(k) == 5) & (k[3] == "versions")).select("file", "grp", "item", k[4].alias("version"), F.col("value").alias("state"))
    return names.join(states, ["file", "grp", "item"]).select("grp", "feature", "version", "state")
