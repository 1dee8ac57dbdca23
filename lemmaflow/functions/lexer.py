"""Source lines without comments, strings, character literals and quoted identifiers; state carries from line to line of a file."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.functions.names import IDENTIFIER

REST = re.compile(f"[{IDENTIFIER}]")
CHARACTER = re.compile(r"'(?:\\.?[^']*(?:'|\Z)|[^\\]')", re.S)
RAW = re.compile(r'r(#*)"')
QUOTED = re.compile(r"«[^»]*(?:»|\Z)", re.S)

#: What may end or change each state; everything before it is passed over at once.
NEXT = {
    "code": re.compile(r"""--|/-|["'«]|r#*\""""),
    "comment": re.compile(r"/-|-/"),
    "string": re.compile(r'\\.?|"', re.S),
    "text": re.compile(r'\\.?|["{]', re.S),
    "hole": re.compile(r"""[{}"']"""),
    "inner": re.compile(r'\\.?|"', re.S),
}
#: Depth 0 states that a quote mark returns to.
BACK = {"string": "code", "text": "code", "inner": "hole"}


class Lexer:
    """Where a line ended: ``state`` and ``depth``, of comments, of braces in an interpolation, or the marks of a raw string.

    A string after ``identifier!`` is interpolated: its braces hold code (a hole), in
    which braces nest and a plain string may stand. A string inside a hole counts as
    plain whatever comes before it.
    """

    def __init__(self, state: str = "code", depth: int = 0):
        self.state, self.depth = state, depth

    def line(self, text: str) -> str:
        out: list[str] = []
        at = 0
        while at < len(text):
            if self.state == "raw":
                end = text.find('"' + "#" * self.depth, at)
                if end < 0:
                    break
                at = end + 1 + self.depth
                self.state, self.depth = "code", 0
                continue
            found = NEXT[self.state].search(text, at)
            if self.state == "code":
                out.append(text[at : found.start() if found else None])
            if not found:
                break
            at = self.step(text, found, out)
        return "".join(out)

    def step(self, text: str, found: re.Match, out: list[str]) -> int:
        """Acts on what was found; where to go on."""
        mark, at = found[0], found.start()
        fresh = at == 0 or not REST.match(text[at - 1])
        if self.state in BACK:
            if mark == '"':
                self.state = BACK[self.state]
            elif mark == "{":
                self.state, self.depth = "hole", 1
        elif self.state == "comment":
            self.depth += 1 if mark == "/-" else -1
            self.state = "comment" if self.depth else "code"
        elif mark == "'":
            literal = CHARACTER.match(text, at) if fresh else None
            if literal:
                return literal.end()
            if self.state == "code":
                out.append("'")
        elif self.state == "hole":
            if mark == '"':
                self.state = "inner"
            else:
                self.depth += 1 if mark == "{" else -1
                self.state = "hole" if self.depth else "text"
        elif mark == "--":
            return len(text)
        elif mark == "/-":
            self.state, self.depth = "comment", 1
        elif mark == "«":
            return QUOTED.match(text, at).end()
        elif mark == '"':
            self.state = "text" if at > 1 and text[at - 1] == "!" and REST.match(text[at - 2]) else "string"
        elif fresh:
            self.state, self.depth = "raw", len(mark) - 2
        else:
            out.append("r")
            return at + 1
        return found.end()


def strip_lines(lines: list[str]) -> list[str]:
    lexer = Lexer()
    return [lexer.line(x) for x in lines]


#: Lines of a file that one task strips; what a chunk does to the state of the lexer is one row.
CHUNK = 4096
#: Deeper than any chunk can climb out of.
DEEP = 1 << 40
#: States with a depth that nests, and the state that a depth of zero returns to.
NESTING = {"comment": "code", "hole": "text", "inner": "text"}
HASHES = re.compile(r'"(#*)')

#: A chunk as a map from the state before it to the state behind it.
#: ``plain``: exits of code, string and text. ``out``: for each nesting state the exits by
#: depth 1, 2, ... as far as the chunk climbs out, and ``stay``: state and change of depth
#: beyond. ``raw``: (marks, exit) in ascending order; a string of more marks stays open.
EXIT = "struct<state:string,depth:bigint>"
CHUNK_MAP = f"plain map<string,{EXIT}>, out map<string,array<{EXIT}>>, stay map<string,{EXIT}>, raw array<struct<marks:bigint,exit:{EXIT}>>"


class Measured(Lexer):
    """A lexer that also keeps the least depth it has come to."""

    low = DEEP

    def step(self, text: str, found: re.Match, out: list[str]) -> int:
        at = super().step(text, found, out)
        self.low = min(self.low, self.depth)
        return at


def exit_at(state: str, depth: int) -> dict:
    return {"state": state, "depth": depth}


def chunk_map(lines: list[str]) -> dict:
    """What the lines do to every state that they may be entered in, as the columns of ``CHUNK_MAP``.

    Paths that meet at the start of a line go on as one, so every line is read about once
    for each state it can be met in. Depths have no bound, but a chunk treats all depths
    that it doesn't climb out of alike, and the others from the line on where it does.
    """
    ends: dict[tuple[int, str, int], dict] = {}

    def run(line: int, state: str, depth: int) -> dict:
        met = []
        while line < len(lines) and (line, state, depth) not in ends:
            met.append((line, state, depth))
            lexer = Lexer(state, depth)
            lexer.line(lines[line])
            line, state, depth = line + 1, lexer.state, lexer.depth
        end = ends.get((line, state, depth)) or exit_at(state, depth)
        ends.update(dict.fromkeys(met, end))
        return end

    plain = {s: run(0, s, 0) for s in ("code", "string", "text")}
    out, stay = {}, {}
    for entry in NESTING:
        state, depth, starts, lows = entry, DEEP, [], []
        for text in lines:
            starts.append((state, depth - DEEP))
            lexer = Measured(state, depth)
            lexer.line(text)
            lows.append(DEEP - min(lexer.low, depth))
            state, depth = lexer.state, lexer.depth
        climbed = list(accumulate(lows, max))
        stay[entry] = exit_at(state, depth - DEEP)
        first = [bisect_left(climbed, d) for d in range(1, (climbed[-1] if climbed else 0) + 1)]
        out[entry] = [run(at, starts[at][0], d + starts[at][1]) for d, at in enumerate(first, 1)]
    raw: list[dict] = []
    for at, text in enumerate(lines):
        for marks in (len(m[1]) for m in HASHES.finditer(text)):
            if not raw or marks > raw[-1]["marks"]:
                raw.append({"marks": marks, "exit": run(at, "raw", marks)})
    return {"plain": plain, "out": out, "stay": stay, "raw": raw}


def follow(state: str, depth: int, chunk: dict) -> tuple[str, int]:
    """The state behind a chunk that is entered in ``state``."""
    if state in chunk["plain"]:
        end = chunk["plain"][state]
    elif state == "raw":
        end = next((r["exit"] for r in chunk["raw"] if r["marks"] >= depth), exit_at(state, depth))
    elif depth <= len(chunk["out"][state]):
        end = chunk["out"][state][depth - 1]
    else:
        end = exit_at(chunk["stay"][state]["state"], depth + chunk["stay"][state]["depth"])
    return end["state"], end["depth"]


def strip_sources(source_file: DataFrame) -> DataFrame:
    """(path, line_no, code) of source lines (path, line_no, text), of files of any length.

    Files are cut into chunks of lines. Every chunk tells what it does to the state it is
    entered in, a file's chunks are composed in order, one row each, and with the state
    that it begins in every chunk is stripped on its own.
    """
    rows = source_file.selectExpr("path", "cast(line_no AS bigint) AS line_no", "coalesce(text, '') AS text")
    chunk = rows.groupBy("path", F.floor(F.col("line_no") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("lines"))

    def maps(batches: Iterator) -> Iterator:
        exit_type = pa.struct([("state", pa.string()), ("depth", pa.int64())])
        types = {"plain": pa.map_(pa.string(), exit_type), "out": pa.map_(pa.string(), pa.list_(exit_type)), "stay": pa.map_(pa.string(), exit_type), "raw": pa.list_(pa.struct([("marks", pa.int64()), ("exit", exit_type)]))}
        for batch in batches:
            found = [chunk_map(lines) for lines in batch["texts"].to_pylist()]
            columns = [pa.array([m[c] if c == "raw" else [*m[c].items()] for m in found], kind) for c, kind in types.items()]
            yield pa.RecordBatch.from_arrays([batch["path"], batch["chunk"], *columns], names=["path", "chunk", *types])

    def compose(table: pa.Table) -> pa.Table:
        state, depth, entries = "code", 0, []
        table = table.sort_by("chunk")
        for row in table.drop_columns(["path", "chunk"]).to_pylist(maps_as_pydicts="strict"):
            entries.append((state, depth))
            state, depth = follow(state, depth, row)
        return pa.table({"path": table["path"], "chunk": table["chunk"], "state": pa.array([e[0] for e in entries], pa.string()), "depth": pa.array([e[1] for e in entries], pa.int64())})

    def strip(batches: Iterator) -> Iterator:
        for batch in batches:
            out = []
            for state, depth, lines in zip(batch["state"].to_pylist(), batch["depth"].to_pylist(), batch["texts"].to_pylist()):
                lexer = Lexer(state, depth)
                out.append([lexer.line(text) for text in lines])
            yield pa.RecordBatch.from_arrays([batch["path"], batch["numbers"], pa.array(out, pa.list_(pa.string()))], names=["path", "numbers", "codes"])

    texts = chunk.select("path", "chunk", F.col("lines.line_no").alias("numbers"), F.col("lines.text").alias("texts"))
    mapped = texts.select("path", "chunk", "texts").mapInArrow(maps, f"path string, chunk bigint, {CHUNK_MAP}")
    entered = mapped.groupBy("path").applyInArrow(compose, "path string, chunk bigint, state string, depth bigint")
    entered = entered.withColumnsRenamed({"path": "of", "chunk": "at"})
    placed = texts.join(entered, F.col("path").eqNullSafe(F.col("of")) & F.col("chunk").eqNullSafe(F.col("at"))).select("path", "numbers", "texts", "state", "depth")
    codes = placed.mapInArrow(strip, "path string, numbers array<bigint>, codes array<string>")
    lines = codes.select("path", F.explode(F.arrays_zip("numbers", "codes")).alias("l"))
    return lines.select("path", F.col("l.numbers").alias("line_no"), F.col("l.codes").alias("code"))


def stripped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For whole files in one column: ``text`` becomes its code."""
    for batch in batches:
        yield batch.assign(text=["\n".join(strip_lines((t or "").split("\n"))) for t in batch["text"]])
