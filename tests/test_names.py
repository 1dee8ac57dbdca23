import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lemmaflow.functions import lexer
from lemmaflow.functions import names as N
from lemmaflow.functions.lexer import chunk_map, follow, strip_lines, strip_sources, stripped
from lemmaflow.operators.headers import scan_headers


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def plain_code(lines):
    """The lexer once more, a character at a time, with a stack of what is open instead of states."""
    word = re.compile(f"[{N.IDENTIFIER}]")
    out, stack = [], []
    for line in lines:
        code, i = "", 0
        while i < len(line):
            top = stack[-1] if stack else None
            rest = line[i:]
            fresh = i == 0 or not word.match(line[i - 1])
            if top == "comment":
                if rest.startswith("/-"):
                    stack.append("comment")
                    i += 2
                elif rest.startswith("-/"):
                    stack.pop()
                    i += 2
                else:
                    i += 1
            elif isinstance(top, int):
                if rest.startswith('"' + "#" * top):
                    stack.pop()
                    i += top
                i += 1
            elif top in ("plain", "mixed"):
                if rest[0] == "\\":
                    i += 1
                elif rest[0] == '"':
                    stack.pop()
                elif rest[0] == "{" and top == "mixed":
                    stack.append("{")
                i += 1
            elif rest[0] == "'" and fresh and (rest[1:2] == "\\" or rest[2:3] == "'"):
                if rest[1] == "\\":
                    end = rest.find("'", 3)
                    i = len(line) if end < 0 else i + end + 1
                else:
                    i += 3
            elif top == "{":
                if rest[0] == "{":
                    stack.append("{")
                elif rest[0] == "}":
                    stack.pop()
                elif rest[0] == '"':
                    stack.append("plain")
                i += 1
            elif rest.startswith("--"):
                break
            elif rest.startswith("/-"):
                stack.append("comment")
                i += 2
            elif rest[0] == '"':
                stack.append("mixed" if i > 1 and line[i - 1] == "!" and word.match(line[i - 2]) else "plain")
                i += 1
            elif fresh and (m := re.match('r(#*)"', rest)):
                stack.append(len(m[1]))
                i += m.end()
            elif rest[0] == "«":
                i += (rest.find("»") + 1) or len(rest)
            else:
                code += rest[0]
                i += 1
        out.append(code)
    return out


def test_lexer_against_a_plain_one():
    rng = random.Random(4)
    pieces = ["--", "/-", "-/", '"', "'", "\\", "{", "}", "!", "s!", 'm!"', 'r#"', '"#', 'r"', "«", "»", "a", "x'", "'n'", "'\\n'", "'\\u{2200}'", " ", ".", "é", "λ", "β", "1", "#", "@[simp]", "a.'\"'"]
    for _ in range(4000):
        lines = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 5))]
        assert strip_lines(lines) == plain_code(lines), lines


PIECES = ["--", "/-", "-/", "-/", '"', "'", "\\", "{", "}", "}", "!", 's!"', 'r#"', 'r##"', '"#', '"##', 'r"', "«", "x", "'n'", " ", "#"]


def test_chunks_compose_to_the_lexer():
    rng = random.Random(5)
    for _ in range(3000):
        lines = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 14))]
        size, state, depth, at = rng.randrange(1, 5), "code", 0, lexer.Lexer()
        for k in range(0, len(lines), size):
            state, depth = follow(state, depth, chunk_map(lines[k : k + size]))
            for line in lines[k : k + size]:
                at.line(line)
            assert (state, depth) == (at.state, at.depth), (lines, size, k)
    for entry in [("comment", 3), ("hole", 2), ("inner", 5), ("raw", 2), ("raw", 9), ("text", 0), ("string", 0)]:
        for _ in range(400):
            lines = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 6))]
            at = lexer.Lexer(*entry)
            for line in lines:
                at.line(line)
            assert follow(*entry, chunk_map(lines)) == (at.state, at.depth), (entry, lines)


def test_sources_in_chunks(spark, monkeypatch):
    """Files of many chunks, with comments and strings over several of them, repeated and null lines."""
    monkeypatch.setattr(lexer, "CHUNK", 64)
    rng = random.Random(6)
    files = {f: ["".join(rng.choice([*PIECES, *["word "] * 40]) for _ in range(rng.randrange(6))) for _ in range(n)] for f, n in (("a", 1), ("b", 700), ("c", 5000))}
    rows = [(f, k, t or None) for f, lines in files.items() for k, t in enumerate(lines, 1)]
    rng.shuffle(rows)
    got = strip_sources(spark.createDataFrame(rows, "path string, line_no int, text string")).collect()
    assert sorted((r.path, r.line_no, r.code) for r in got) == sorted((f, k, c) for f, lines in files.items() for k, c in enumerate(strip_lines(lines), 1))
    assert strip_sources(spark.createDataFrame([], "path string, line_no int, text string")).count() == 0


def test_chunks_take_time_as_they_are_long():
    """Marks that close again and again, in every state."""
    start = time.perf_counter()
    for line in ("-/ -/", "}", '"#', '"} {"', "/- -/ -/"):
        chunk_map([line] * lexer.CHUNK)
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize(
    ("source", "code"),
    [
        (["k -- rest"], ["k "]),
        (["u /- v", "/- w -/", "-/ z"], ["u ", "", " z"]),
        (['p "q', 'r" s'], ["p ", " s"]),
        (['log!"{g "x"} {h {1}}" t'], ["log! t"]),
        (['log!"{a -- b} c" d'], ["log! d"]),
        (["v' = w'"], ["v' = w'"]),
        (['r##"a"# b"## c'], [" c"]),
        (["«a -- b» c"], [" c"]),
        (["k.'\"' x"], ["k. x"]),
        (["'\\u{2200}' x"], [" x"]),
        (['n != "s" m'], ["n !=  m"]),
    ],
)
def test_lexer(source, code):
    assert strip_lines(source) == code


@pytest.mark.parametrize(
    ("lines", "first", "last", "attributes", "head"),
    [
        (["@[simp, local ext 3]", "theorem k : T"], 1, 2, ["simp", "ext"], " theorem k : T"),
        (["/-- @[fake]", "@[fake] -/", "@[step] lemma k", "  (x) : T := y", "@[late] z"], 1, 5, ["step"], "   lemma k"),
        (["@[early]", "def k := 1"], 2, 2, [], "def k := 1"),
        (["@[to_x (attr := simp)]", "def k := 1"], 1, 9, ["to_x"], " def k := 1"),
        (["private", "noncomputable"], 1, 2, [], "private noncomputable"),
        (["x"], 5, 6, None, None),
    ],
)
def test_headers(spark, lines, first, last, attributes, head):
    decl = spark.createDataFrame([(1, "f", first, last)], "id int, path string, range_start int, range_end int")
    code = strip_sources(spark.createDataFrame([("f", k, t) for k, t in enumerate(lines, 1)], "path string, line_no int, text string"))
    got = scan_headers(decl, code).collect()
    assert [(r.attributes, r["head"]) for r in got] == ([(attributes, head)] if attributes is not None else [])


@pytest.mark.parametrize(
    ("head", "name", "instance", "named"),
    [
        ("theorem part.whole : T", "N.part.whole", False, True),
        ("theorem part : T", "part.whole", False, False),
        ("theorem _root_.A.b: T", "A.b", False, True),
        ("theorem partial : T", "part", False, False),
        ("instance : Foo", "instFoo", True, True),
        ("instance : Foo", "instFoo", False, False),
        ("private theorem k : T", "_private.M.0.k", False, True),
    ],
)
def test_names_in_headers(spark, head, name, instance, named):
    assert one(spark, N.names_declaration(F.col("h"), F.col("n"), F.col("i")), h=head, n=name, i=instance) is named


@pytest.mark.parametrize(("name", "internal"), [("A.foo", False), ("A._x", True), ("_a", True), ("A.my_proof_x", True), ("A.mk.injEq", True), ("_private.M.0.A.foo", False), ("A.rec", True)])
def test_internal_names(spark, name, internal):
    assert one(spark, N.is_internal(F.col("n")), n=name) is internal


@pytest.mark.parametrize(("text", "expected"), [("L230-L238", (230, 238)), ("230-238", (230, 238)), ("12", (12, 12)), ("x", (0, 0)), ("", (0, 0))])
def test_line_ranges(spark, text, expected):
    assert tuple(one(spark, N.line_range(F.col("t")), t=text)) == expected


def test_attributes(spark):
    assert one(spark, N.attributes_of(F.col("t")), t="@[norm, scoped pin 3] @[local wide, norm] def x @[open") == ["norm", "pin", "wide", "open"]
    assert one(spark, N.without_attributes(F.col("t")), t="@[a, b] x @[c") == " x "
    assert one(spark, N.rust_source(F.col("t")), t="x Source: 'src/a.rs', lines") == "src/a.rs"
    assert one(spark, N.rust_source(F.col("t")), t="none") is None


def test_kept_and_whole_files(spark):
    """``strip_comments`` over real texts equals the plain lexer."""
    rng = random.Random(9)
    rows = [(k, "\n".join("".join(rng.choice(["-- x", "a ", '"', "/-", "-/", "'q'"]) for _ in range(6)) for _ in range(5))) for k in range(40)] + [(99, None)]
    got = spark.createDataFrame(rows, "doc_id bigint, text string").mapInPandas(stripped, "doc_id bigint, text string").collect()
    assert {r.doc_id: r.text for r in got} == {k: "\n".join(plain_code((t or "").split("\n"))) for k, t in rows}
