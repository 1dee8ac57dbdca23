"""Column expressions over declaration names, paths and line ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of names that the compiler generates.
GENERATED_SUFFIXES = [
    ".noConfusionType", ".noConfusion", ".casesOn", ".rec", ".recOn", ".brecOn", ".below", ".ibelow", ".binductionOn",
    ".sizeOf_spec", ".inj", ".injEq", ".mk.inj", ".mk.injEq", ".mk.sizeOf_spec", ".eq_1", ".eq_2", ".eq_3", ".eq_def",
    ".mk", ".elim", ".ctorIdx", ".toCtorIdx",
]

# Attributes that mark a primary specification, kinds that have one, words that open a declaration.
SPEC_ATTRIBUTES = ["progress", "pspec", "step"]
SPEC_TARGET_KINDS = ["def", "abbrev", "instance", "opaque", "axiom"]
HEAD_KEYWORDS = ["theorem", "lemma", "def", "abbrev", "instance", "axiom", "opaque", "structure", "inductive", "class", "example", "where"]

PREFIX = "probe:"
# Characters that continue an identifier, as ranges of a character class: Greek without three signs, letter-like signs, subscripts.
IDENTIFIER = "A-Za-z0-9_'!?\u03b1-\u03ba\u03bc-\u03c9\u0391-\u039f\u03a1\u03a2\u03a4-\u03a9\u03ca-\u03fb\u1f00-\u1ffe\u2100-\u214f\U0001d49c-\U0001d59f\u2080-\u2089\u2090-\u209c\u1d62-\u1d6a\u2c7c"
#: An attribute block; one that isn't closed runs to the next, or to the end.
BLOCK = r"@\[((?:(?!@\[)[^\]])*)\]?"


def either(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def user_name(name: Column) -> Column:
    """The name without its private prefix."""
    return F.regexp_replace(name, r"^_private\..*?\.0\.", "")


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def display_name(parts: Column) -> Column:
    """The last component; a number prints as itself."""
    return F.coalesce(F.element_at(parts, -1), F.lit(""))


def is_structural_member(name: Column) -> Column:
    return either([user_name(name).endswith(s) for s in GENERATED_SUFFIXES])


def is_internal(name: Column) -> Column:
    """Compiler-made by its name: substring and ending tests on the user-facing name, and components that start with an underscore."""
    n = user_name(name)
    return n.startswith("_") | either([n.contains(s) for s in ("._", "[", "proof_", "match_")]) | is_structural_member(name)


def is_realised_theorem(name: Column) -> Column:
    return last_part(name).rlike(r"^(eq_def|eq_unfold|congr_simp|(eq|congr|hcongr|congr_eq)_[0-9]+)$")


def is_native_axiom(name: Column) -> Column:
    return name.rlike(r"\._native\.[^.]+\.ax_[0-9]+(_[0-9]+)*$")


def is_companion(name: Column) -> Column:
    return last_part(name) == "mvcgen_spec"


def is_external_module(module: Column) -> Column:
    return last_part(module).endswith("External")


def decl_kind(ctor_kind: Column, flags: dict[str, Column]) -> Column:
    """The published kind of a constant; ``flags`` has is_instance, is_projection, is_abbrev, is_class and is_structure."""
    defined = F.when(flags["is_instance"], "instance").when(flags["is_projection"], "projection").when(flags["is_abbrev"], "abbrev").otherwise("def")
    proved = F.when(flags["is_projection"], "projection").otherwise("theorem")
    inductive = F.when(flags["is_class"], "class").when(flags["is_structure"], "structure").otherwise("inductive")
    return F.when(ctor_kind == "defn", defined).when(ctor_kind == "thm", proved).when(ctor_kind == "induct", inductive).when(ctor_kind.isin("axiom", "opaque", "quot"), ctor_kind).otherwise("def")


def with_prefix(name: Column) -> Column:
    return F.concat(F.lit(PREFIX), name)


def without_prefix(code_name: Column) -> Column:
    return F.when(code_name.startswith(PREFIX), F.substring(code_name, len(PREFIX) + 1, 1 << 30)).otherwise(code_name)


def without_leading_dot_slash(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def module_path(module: Column) -> Column:
    return F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(".lean"))


def line_range(text: Column) -> Column:
    """``L230-L238``, ``230-238`` or ``12`` as (lines_start, lines_end); what isn't a number is 0."""
    number = lambda k: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, r"^L?([^-]*)(?:-L?(.*))?$", k), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(0))
    start = number(1)
    return F.struct(start.alias("lines_start"), F.when(text.contains("-"), number(2)).otherwise(start).alias("lines_end"))


def rust_source(docstring: Column) -> Column:
    """What a docstring names as its source, between quotes after ``Source:``; null if it names none."""
    found = F.regexp_extract(docstring, r"Source: '([^']*)'", 1)
    return F.when(docstring.rlike(r"Source: '[^']*'"), found)


def is_relevant_source(source: Column, crate: str) -> Column:
    """Whether a source file belongs to the crate; without a crate every one does."""
    if not crate:
        return F.lit(True)
    return source.isNotNull() & source.contains(crate) & ~source.startswith("/") & ~source.contains("/cargo/registry/")


def attributes_of(line: Column) -> Column:
    """Attribute names in the ``@[...]`` blocks of a line, each once; a ``local`` or ``scoped`` before a name is passed over."""
    blocks = F.regexp_extract_all(line, F.lit(BLOCK), F.lit(1))
    entries = F.flatten(F.transform(blocks, lambda b: F.split(b, ",")))
    words = F.transform(entries, lambda e: F.array_remove(F.split(e, r"\s+"), ""))
    first = F.transform(words, lambda w: F.when(F.get(w, F.lit(0)).isin("local", "scoped"), F.get(w, F.lit(1))).otherwise(F.get(w, F.lit(0))))
    return F.array_distinct(F.filter(first, lambda x: x.isNotNull()))


def without_attributes(line: Column) -> Column:
    return F.regexp_replace(line, BLOCK, "")


def is_head_line(line: Column) -> Column:
    """Whether a line of code, its attribute blocks aside, holds a declaration's head: a colon, a bar or one of the opening words."""
    rest = without_attributes(line)
    return rest.rlike(r"[:|]") | rest.rlike(r"(?:^|\s)(?:" + "|".join(HEAD_KEYWORDS) + r")(?:$|\s)")


def names_declaration(head: Column, name: Column, is_instance: Column) -> Column:
    """Whether some identifier of the head is the user-facing name or a dotted ending of it; an instance may be named by its keyword."""
    tokens = F.transform(F.regexp_extract_all(head, F.lit(f"[{IDENTIFIER}.]+"), F.lit(0)), lambda t: F.regexp_replace(t, r"^_root_\.", ""))
    n = user_name(name)
    return F.exists(tokens, lambda t: (t != "") & ((t == n) | n.endswith(F.concat(F.lit("."), t)) | (is_instance & (t == "instance"))))


def output_name(package: Column, version: Column) -> Column:
    """File name of an extract artifact."""
    return F.concat(F.lit("lean_"), F.replace(package, F.lit("-"), F.lit("_")), F.lit("_"), version, F.lit(".json"))


def toml_field(header: Column, field: str) -> Column:
    """The first ``field = "..."`` of the lines before the first table of a TOML text."""
    top = F.element_at(F.split(header, r"(?m)^\s*\[", 2), 1)
    found = F.regexp_extract(top, rf'(?m)^\s*{field}\s*=\s*"([^"]*)"', 1)
    return F.nullif(found, F.lit(""))


def config_flag(code_name: Column, entries: list[str]) -> Column:
    """Whether a list of the user's configuration names the declaration, by user-facing name or by code name."""
    bare = without_prefix(code_name)
    return bare.isin(entries) | user_name(bare).isin(entries) if entries else F.lit(False)


def has_suffix(code_name: Column, suffixes: list[str]) -> Column:
    return either([without_prefix(code_name).endswith(s) for s in suffixes])
