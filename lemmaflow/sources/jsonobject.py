"""One JSON object of any size, read as its entries by many tasks.

Small documents are parsed a row each. A large file is cut at every ``}`` by the text source, whatever blocks it lies in, so no row is
longer than what stands between two of them. Whether a piece starts within a string, and
how deep, follows from what is above it: quotes and brackets are counted in the pieces
and summed down the file. Pieces up to the next close at the entries' depth are one
entry or a few, and only those are parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmaflow.plans.scratch import written
from lemmaflow.sources.lines import running

#: Text at the root of a document, up to the first object that opens there; possessive, so that it runs without recursion.
ROOT = r'(?s)^(?:[^"{]++|"(?:[^"\\]++|\\.)*+"?)*+'
SCHEMA, DATA, OTHER_DATA = r'"schema"\s*:\s*"', r'"data"\s*:\s*$', r'"data"\s*:\s*(?!null)[^\s{]'
PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"


#: Documents up to this size in bytes are parsed as a row each; all others are cut.
WHOLE = 32 << 20


class DocumentError(ValueError):
    """A file that is no whole JSON object, or names an entry twice."""


def count_of(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def pieces(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(path, block, place, known, real, value, inside, ends_inside, braces, depth, after): what stands before each ``}``.

    ``braces`` and ``depth`` are what is open where the piece starts, ``after`` what is
    open behind its ``}``; a file's last piece has none (not ``real``), unless the file
    ends with it, which is not ``known`` of a compressed one. With ``parts`` all files of the folder are one document, in
    order of their names.
    """
    text = spark.read.option("lineSep", "}").text(path)
    file = F.col("_metadata.file_path")
    size = F.when(~file.rlike(PACKED), F.col("_metadata.file_size"))
    cut = text.select(file.alias("path"), F.struct(file.alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block"), F.monotonically_increasing_id().alias("place"), size.alias("size"), "value")
    cut = cut.withColumn("length", F.octet_length("value") + 1)
    cut = cut.withColumn("clean", F.regexp_replace("value", r"(?s)\\.", "")).withColumn("quotes", count_of(F.col("clean"), '"'))
    within = Window.partitionBy("path", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    above = lambda c, window: F.coalesce(F.sum(c).over(window), F.lit(0))
    x = cut.withColumns({"own_quotes": above("quotes", within), "own_length": above("length", within)})
    marks = {}
    for start in (0, 1):  # whether the block starts in a string isn't known yet
        inside = (F.col("own_quotes") + start) % 2 == 1
        bare = F.regexp_replace(F.concat(F.when(inside, F.lit('"')).otherwise(F.lit("")), "clean"), r'"[^"]*+(?:"|\z)', "")
        closed = F.when((F.col("own_quotes") + F.col("quotes") + start) % 2 == 1, 0).otherwise(1)
        braces = count_of(bare, "{") - closed
        marks |= {f"braces_{start}": braces, f"depth_{start}": braces + count_of(bare, "[") - count_of(bare, "]")}
    x = x.withColumns(marks).drop("clean")
    x = x.withColumns({f"own_{m}": above(m, within) for m in marks})
    block = x.groupBy("path", "block").agg(F.max("size").alias("size"), *[F.sum(c).alias(c) for c in ("length", "quotes", *marks)])
    down = lambda key: Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    if parts:
        block = block.withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))
        x = x.withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))
    block = block.withColumns({"length_above": above("length", down("block.file")), "start": above("quotes", down("path")) % 2})
    open_end = F.coalesce(F.col("length_above") + F.col("length") > F.col("size"), F.lit(False)) & ((F.col("start") + F.col("quotes")) % 2 == 0)
    chosen = lambda what, of="": F.when(F.col("start") == 0, F.col(f"{of}{what}_0")).otherwise(F.col(f"{of}{what}_1"))
    block = block.withColumns({m: chosen(m) + open_end.cast("int") for m in ("braces", "depth")})
    block = block.select("path", "block", "length_above", "start", *[above(m, down("path")).alias(f"{m}_above") for m in ("braces", "depth")])
    x = x.join(block, ["path", "block"])
    known, ends_inside = F.col("size").isNotNull(), (F.col("start") + F.col("own_quotes") + F.col("quotes")) % 2 == 1
    real = ~known | (F.col("length_above") + F.col("own_length") + F.col("length") <= F.col("size"))
    depth = F.col("depth_above") + chosen("depth", "own_")
    return x.select(
        "path", "block", "place", known.alias("known"), real.alias("real"), "value",
        ((F.col("start") + F.col("own_quotes")) % 2 == 1).alias("inside"), ends_inside.alias("ends_inside"),
        (F.col("braces_above") + chosen("braces", "own_")).alias("braces"), depth.alias("depth"),
        (depth + chosen("depth") + F.when(~real & ~ends_inside, 1).otherwise(0)).alias("after"),
    )


def rooted(found: DataFrame) -> DataFrame:
    """``found`` with ``text``, a piece as it stands at the root, and ``head``, its part before an object opens; null where a piece starts deeper."""
    text = F.when(F.col("braces") == 0, F.regexp_replace("value", r"^\s*\{", "")).when(F.col("braces") == 1, F.concat(F.when(F.col("inside"), F.lit('"')).otherwise(F.lit("")), "value"))
    return found.withColumn("text", text).withColumn("head", F.regexp_extract("text", ROOT, 0))


def outline(found: DataFrame) -> DataFrame:
    """(path, level, opener) of each document: the depth of its entries and the piece where they begin, null where there are none.

    Entries are the root's members, or those of ``data`` if the root also has a string
    ``schema``. Files that aren't one whole object are an error.
    """
    at, blank = F.struct("block", "place"), F.trim(F.col("value"), F.lit(" \t\r\n")) == ""
    x = rooted(found).withColumns({"at": at, "closes": (F.col("after") == 0) & F.col("real") & ~F.col("ends_inside"), "counts": ~blank | (F.col("real") & F.col("known"))})
    files = x.groupBy("path").agg(
        F.bool_or(F.col("head").rlike(SCHEMA)).alias("schema"),
        F.bool_or(F.col("head").rlike(OTHER_DATA)).alias("other"),
        F.min(F.when(F.col("head").rlike(DATA) & (F.length("head") < F.length("text")), F.col("at"))).alias("data"),
        F.min(F.struct("at", (~F.col("value").rlike(r"^\s*\{")).alias("odd"))).alias("first"),
        F.min(F.when(F.col("closes"), F.col("at"))).alias("closing"),
        F.max(F.when(F.col("counts"), F.col("at"))).alias("last"),
    )
    wrong = F.col("first.odd") | F.col("closing").isNull() | (F.col("last") > F.col("closing"))
    files = written(files.withColumn("wrong", wrong), "outline")
    if bad := files.where("wrong").select("path").take(1):
        raise DocumentError(f"{bad[0]['path']}: not one whole JSON object")
    wrapped = F.col("schema") & (F.col("data").isNotNull() | F.col("other"))
    return files.select("path", F.when(wrapped, 2).otherwise(1).alias("level"), F.when(wrapped, F.col("data")).otherwise(F.col("first.at")).alias("opener"))


def members(found: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, value as variant), a row for each entry; an entry without its comma is an error."""
    x = rooted(found).join(files, "path").where(F.struct("block", "place") >= F.col("opener"))
    opens = F.struct("block", "place") == F.col("opener")
    own = F.when(opens, F.when(F.col("level") == 1, F.col("text")).otherwise(F.expr("substring(text, length(head) + 2)"))).otherwise(F.col("value"))
    ends, closes = F.col("after") < F.col("level"), (F.col("after") <= F.col("level")) & F.col("real") & ~F.col("ends_inside")
    x = x.select("path", "block", "place", F.concat(own, F.when(ends | ~F.col("real"), F.lit("")).otherwise(F.lit("}"))).alias("own"), ends.cast("int").alias("ends"), closes.cast("int").alias("closes"))
    x = running(x, ended=F.col("ends"), segment=F.col("closes")).where("ended = 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "own"))), lambda p: p["own"]), "")
    runs = x.groupBy("path", "segment").agg(body.alias("body"))
    runs = written(runs, "entries").where(r"body RLIKE '[^ \\t\\r\\n]'")
    later = F.col("segment") > 0
    fits = ~later | F.col("body").rlike(r"^\s*,\s*\S")
    body = F.when(fits, F.when(later, F.regexp_replace("body", r"^\s*,", "")).otherwise(F.col("body"))).otherwise(F.raise_error(F.concat(F.lit("entries not parted by a comma in "), "path")))
    parsed = runs.select("path", F.parse_json(F.concat(F.lit("{"), body, F.lit("}"))).alias("v"))
    return parsed.sparkSession.sql("SELECT d.path, e.key AS name, e.value AS value FROM {d} AS d, LATERAL variant_explode(d.v) AS e", d=parsed)


def are_small(spark: SparkSession, path: str) -> bool:
    return (spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0) <= WHOLE


def small_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, value, wrapped, body as variant) of documents that are a row each; names that stand twice don't parse."""
    # the parser passes over what follows a value, so the text is made the first of two in a list
    held = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("\n,0]")))
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value", held.alias("held"))
    place = lambda k: F.try_variant_get("held", f"$[{k}]", "variant")
    alone = (F.try_variant_get("held", "$[1]", "int") == 0) & place(2).isNull() & F.schema_of_variant(place(0)).startswith("OBJECT")
    if bad := text.where(~F.coalesce(alone, F.lit(False))).select("path").take(1):
        raise DocumentError(f"{bad[0]['path']}: not one whole JSON object")
    text = text.select("path", "value", place(0).alias("v"))
    data = F.try_variant_get("v", "$.data", "variant")
    stands = data.isNotNull() & ~F.coalesce(F.is_variant_null(data), F.lit(False))
    wrapped = F.coalesce((F.schema_of_variant(F.try_variant_get("v", "$.schema", "variant")) == "STRING") & stands, F.lit(False))
    return text.select("path", "value", wrapped.alias("wrapped"), F.when(wrapped, data).otherwise(F.col("v")).alias("body"))


def read_members(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(path, name, value as variant) of the documents at ``path``; a name that stands twice in one document is an error."""
    if not parts and are_small(spark, path):
        return spark.sql("SELECT d.path, e.key AS name, e.value AS value FROM {d} AS d, LATERAL variant_explode(d.body) AS e", d=small_documents(spark, path))
    found = written(pieces(spark, path, parts), "pieces")
    out = members(found, outline(found))
    if twice := out.groupBy("path", "name").count().where("count > 1").take(1):
        raise DocumentError(f"{twice[0]['path']}: {twice[0]['name']} stands twice")
    return out


def surroundings(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(path, around): each document as JSON, ``{}`` where it is bare; the data of large ones is left out."""
    if not parts and are_small(spark, path):
        return small_documents(spark, path).select("path", F.when(F.col("wrapped"), F.col("value")).otherwise(F.lit("{}")).alias("around"))
    found = written(pieces(spark, path, parts), "pieces")
    files = outline(found).where("opener IS NOT NULL")
    x = rooted(found).join(files, "path").withColumn("opens", F.struct("block", "place") == F.col("opener"))
    late = F.struct("block", "place") >= F.col("opener")
    x = running(x, ended=(late & (F.col("after") < F.col("level"))).cast("int"))
    tail = F.when((F.col("ended") > 0) | ~late, F.concat("value", F.when(F.col("real"), F.lit("}")).otherwise(F.lit("")))).when(F.col("opens"), F.expr("substring(value, 1, length(value) - length(text) + length(head)) || 'null'"))
    outside = x.where(F.col("level") == 2).select("path", F.struct("block", "place", tail.alias("own")).alias("p")).where("p.own IS NOT NULL")
    around = outside.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["own"]), "").alias("around"))
    return files.select("path").join(around, "path", "left").select("path", F.coalesce("around", F.lit("{}")).alias("around"))
