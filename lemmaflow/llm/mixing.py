"""Mixing sources to target weights by proportionate-fair scheduling of source blocks.

Each source's rows, in a fixed pseudo-random order, form blocks. A source of weight w
gets a release time floor((i-1)/w) and a deadline ceil(i/w) for its i-th block, and in
every slot the released block with the earliest deadline goes next, so that no source
is ever a whole block away from its share. Weights are whole quanta, so the schedule
repeats: one period of it is worked out for each set of sources that still have blocks,
and every row finds its place by arithmetic. All of it is DataFrame and SQL work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.llm.columns import packed, without
from lemmaflow.plans.scratch import written

BLOCK_ROWS = 64
QUANTA = 1000
EXPONENT = 0.5
BIN_ROWS = 2000
BROADCAST_SOURCES = 256
ADDED = ["block", "release", "deadline", "slot", "position"]

# One period of a phase: `active` has (source, k), `h` is the sum of k. State: blocks placed so far, and the placements.
ONE_PERIOD = """
aggregate(sequence(0, h - 1),
  named_struct('done', transform(active, x -> 0), 'out', cast(array() as array<struct<source:string,j:int,at:int,release:int,deadline:int>>)),
  (s, t) -> transform(
    array(array_min(filter(transform(active, (x, i) -> named_struct(
        'deadline', cast(((s.done[i] + 1) * h + x.k - 1) div x.k as int), 'i', i, 'release', cast((s.done[i] * h) div x.k as int), 'open', s.done[i] < x.k)),
      y -> y.open and y.release <= t))),
    pick -> named_struct(
      'done', transform(s.done, (d, i) -> if(i = pick.i, d + 1, d)),
      'out', array_append(s.out, named_struct('source', active[pick.i].source, 'j', s.done[pick.i], 'at', t, 'release', pick.release, 'deadline', pick.deadline))))[0],
  s -> s.out)
"""


def source_table(docs: DataFrame, weights: dict[str, float] | None, block_rows: int, quanta: int, exponent: float) -> DataFrame:
    """Per source: rows, blocks, quanta ``k`` a period, and ``m``, the periods it lasts."""
    counts = docs.groupBy("_source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(exponent))
    else:
        given = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
        weight = F.coalesce(F.element_at(given, F.col("_source")), F.lit(0.0)).cast("double") if weights else F.lit(0.0)
    total = F.sum("weight").over(Window.partitionBy())
    share = F.when(total > 0, F.col("weight") / total).otherwise(F.lit(0.0))
    k = F.greatest(F.lit(1), F.round(share * quanta)).cast("int")
    out = counts.withColumn("weight", weight).withColumn("k", k)
    out = out.withColumn("n_blocks", F.expr(f"(n + {block_rows - 1}) div {block_rows}"))
    return out.withColumn("m", F.expr("(n_blocks + k - 1) div k"))


def schedule(sources: DataFrame) -> DataFrame:
    """The periodic schedule of every phase: (phase, source, j) with the slot within a period, and where the phase begins."""
    one = sources.agg(F.sort_array(F.collect_list(F.struct(F.col("_source").alias("source"), "k", "m"))).alias("everyone"))
    one = one.withColumn("marks", F.expr("array_sort(array_distinct(transform(everyone, x -> x.m)))"))
    phases = one.select("everyone", "marks", F.posexplode("marks").alias("phase", "until"))
    phases = phases.withColumn("since", F.expr("if(phase = 0, 0L, marks[phase - 1])"))
    phases = phases.withColumn("active", F.expr("filter(everyone, x -> x.m > since)"))
    phases = phases.withColumn("h", F.expr("aggregate(active, 0, (a, x) -> a + x.k)"))
    phases = phases.withColumn("first_slot", F.expr("aggregate(everyone, 0L, (a, x) -> a + x.k * least(x.m, since))"))
    phases = phases.repartition(F.col("phase")).withColumn("placed", F.expr(ONE_PERIOD))
    placed = phases.select("phase", "since", "h", "first_slot", F.explode("placed").alias("x"))
    return placed.select("phase", "since", "h", "first_slot", F.col("x.source").alias("_source"), F.col("x.j").alias("j"), F.col("x.at").alias("at"), F.col("x.release").alias("_release"), F.col("x.deadline").alias("_deadline"))


def order_hash(doc_id: Column) -> Column:
    """60 bits of the id's MD5: the same order everywhere. A null id counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def numbered(docs: DataFrame, sources: DataFrame, bin_rows: int, spread: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds ``_n``, each row's place among the rows of its source, from 0, in the order of the hash.

    A source is cut into bins of about ``bin_rows`` rows by the hash; rows are numbered
    within a bin, bins within a strip of 1,024, and strips within the source, so that no
    task gets a whole source.
    """
    ties = F.xxhash64(F.to_json("row"))
    share = F.col("_hash").cast("double") / F.lit(float(1 << 60))
    df = docs.withColumn("_hash", order_hash(F.col("doc_id"))).withColumn("_tie", ties).join(spread(sources.select("_source", "n", "k")), "_source")
    df = df.withColumn("_bin", F.floor(share * F.ceil(F.col("n") / bin_rows)))
    sizes = df.select("_source", "_bin").groupBy("_source", "_bin").agg(F.count("*").alias("size")).withColumn("_strip", F.expr("_bin div 1024"))
    strips = sizes.groupBy("_source", "_strip").agg(F.sum("size").alias("size"))
    strips = strips.select("_source", "_strip", (F.sum("size").over(Window.partitionBy("_source").orderBy("_strip")) - F.col("size")).alias("ahead"))
    inside = F.sum("size").over(Window.partitionBy("_source", "_strip").orderBy("_bin")) - F.col("size")
    begins = sizes.withColumn("inside", inside).join(strips, ["_source", "_strip"]).select("_source", "_bin", (F.col("inside") + F.col("ahead")).alias("_begin"))
    rank = F.row_number().over(Window.partitionBy("_source", "_bin").orderBy("_hash", "doc_id", "_tie"))
    return df.withColumn("_rank", rank).join(begins, ["_source", "_bin"]).withColumn("_n", F.col("_begin") + F.col("_rank") - 1)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, quanta: int = QUANTA, exponent: float = EXPONENT, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Every row of ``docs`` with its place in the mixture; ``position`` is unique and orders it.

    ``weights`` maps sources to target shares; without it a source of n rows weighs
    n ** ``exponent``. Shares are rounded to whole ``quanta`` of a period, 1 at least.
    A source that runs out leaves, and the others go on in the same proportions. No row
    is dropped or repeated. Adds ``block`` (from 0 within the source), ``release`` and
    ``deadline`` (in slots of one block), ``slot`` and ``position``. A null source counts
    as the empty name; repeated rows get neighbouring numbers; an empty table gives an
    empty result. Up to ``BROADCAST_SOURCES`` sources the tables of sources and periods are
    broadcast; beyond that they are joined by shuffle. A period takes time in proportion
    to its slots times its sources. Columns of ``docs`` stay, apart from those
    that carry the names added here.
    """
    names = without(docs, ADDED)
    docs = docs.select(packed(names), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), F.col("doc_id"))
    sources = written(source_table(docs, weights, block_rows, quanta, exponent), "sources")
    few = sources.count() <= BROADCAST_SOURCES
    spread = F.broadcast if few else (lambda df: df)
    plan = written(schedule(sources), "schedule")
    marks = F.array(*[F.lit(r["m"]) for r in sources.select("m").distinct().orderBy("m").collect()]).cast("array<bigint>")
    df = numbered(docs, sources, bin_rows, spread)
    df = df.withColumn("block", F.expr(f"_n div {block_rows}")).withColumn("_q", F.expr("block div k")).withColumn("j", (F.col("block") % F.col("k")).cast("int"))
    df = df.withColumn("phase", F.size(F.filter(marks, lambda x: x <= F.col("_q"))))
    df = df.join(spread(plan), ["phase", "_source", "j"])
    begin = F.col("first_slot") + (F.col("_q") - F.col("since")) * F.col("h")
    df = df.withColumns({"slot": begin + F.col("at"), "release": begin + F.col("_release"), "deadline": begin + F.col("_deadline")})
    df = df.withColumn("position", F.col("slot") * block_rows + F.col("_n") % block_rows)
    return df.select("row.*", "block", "release", "deadline", "slot", "position")
