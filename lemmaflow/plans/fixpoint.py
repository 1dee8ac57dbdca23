"""Recursive queries as semi-naive DataFrame loops over state that stays where it is.

Every graph fact of this engine is a least fixpoint of linear rules: what a node knows,
all nodes with an edge to it know too. One loop serves them all. Facts are bits of
64-bit words, so many labels of a node are one row. Edges and facts are written in
buckets by node, each round appending its own, so a round joins them where they lie: its
one exchange is that of the new facts. The tables are in the shared folder, which cuts
lineage and survives the loss of executors; nothing but counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.plans.components import connected_components
from lemmaflow.plans.scratch import Buckets, sized, written, written_with

#: Edges of one bucket, up to as many buckets as the session has shuffle partitions.
EDGES_PER_BUCKET = 1 << 15
#: A round over at most so many new rows takes several steps, since its cost is that of a job.
FEW_ROWS, HOPS = 1 << 17, 3
#: Levels that a recursive query walks before the loop takes over.
LEVELS = 4
#: A node with more than this share of a bucket's edges, or more than so many, is a hub.
HUB_SHARE, LEAST_HUB = 4, 100_000
#: Shortcuts may make an edge table this many times as large.
MOST_GROWTH = 3
#: Graphs with fewer edges are walked without pivots, parts with fewer nodes get none; pivots are where most walks of so many steps pass.
PIVOT_EDGES, PIVOT_NODES, PIVOT_STEPS = 50_000, 1_000, 8


def walker(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` in which tables that are bucketed by one of several join keys are joined as they lie, and nothing is broadcast."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        own.conf.set(name, "-1")
    return own


def one_step(new: DataFrame, back: DataFrame, hubs: DataFrame | None, buckets: int) -> DataFrame:
    """What follows from the facts ``new`` (id, word, bits) in one step, laid by node.

    Edges into hubs aren't bucketed with the others: a shuffle that splits skewed
    partitions joins them, and only the new facts of hubs meet them.
    """
    step = back.join(new, "id").select(F.col("src").alias("id"), "word", "bits")
    if hubs is not None:
        step = step.union(hubs.join(new, "id").select(F.col("src").alias("id"), "word", "bits"))
    return step.repartition(buckets, "id").groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))


def a_round(facts: DataFrame, last: int, back: DataFrame, hubs: DataFrame | None, buckets: int, hops: int) -> DataFrame:
    """The facts (id, word, bits, fresh) that follow from those of round ``last`` in ``hops`` steps and aren't among ``facts``.

    ``fresh`` are the bits first met by the last step: what follows from the others is
    found in this round. With one step, the only exchange is that of the new facts.
    """
    new = facts.where(F.col("round") == last).select("id", "word", F.col("fresh").alias("bits")).where("bits <> 0")
    step = one_step(new, back, hubs, buckets)
    if hops == 1:
        found = step.withColumn("early", F.lit(0).cast("bigint"))
    else:
        steps = [step.withColumn("early", F.col("bits"))]
        for k in range(1, hops):
            step = one_step(step, back, hubs, buckets)
            steps.append(step.withColumn("early", F.col("bits") if k < hops - 1 else F.lit(0).cast("bigint")))
        found = steps[0]
        for more in steps[1:]:
            found = found.union(more)
        found = found.repartition(buckets, "id").groupBy("id", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("early").alias("early"))
    had = facts.groupBy("id", "word").agg(F.bit_or("bits").alias("had"))
    without = lambda c, gone: F.col(c).bitwiseAND(F.bitwise_not(gone))
    fresh = found.join(had, ["id", "word"], "left").select("id", "word", "early", without("bits", F.coalesce("had", F.lit(0).cast("bigint"))).alias("bits"))
    return fresh.where("bits <> 0").select("id", "word", "bits", without("bits", F.col("early")).alias("fresh"), F.lit(last + 1).alias("round"))


def spread(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``start``'s facts (id, word, bits) at their nodes and at all from which those can be reached over ``edges`` (src, dst).

    A fact is a set bit of a word; the result has a row for each node and word, or
    several with different bits. Null ends of edges lead nowhere. Ids get one type first:
    an int and a bigint lie in different buckets, so every task would write them all.
    """
    spark = edges.sparkSession
    kind = edges.select("src").union(start.select("id")).schema[0].dataType
    edges, start = (df.withColumns({c: F.col(c).cast(kind) for c in names if df.schema[c].dataType != kind}) for df, names in ((edges, ("src", "dst")), (start, ("id",))))
    plain, seen = written_with(edges.where("src <> dst").select("src", F.col("dst").alias("id")).distinct(), "edges", n=F.count(F.lit(1)))
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), seen["n"] // EDGES_PER_BUCKET + 1))
    most, hubs = max(LEAST_HUB, seen["n"] // (HUB_SHARE * n)), None
    if seen["n"] > most:
        busy = written(plain.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("id"), "hubs")
        if not busy.isEmpty():
            hubs, plain = written(plain.join(sized(busy), "id", "left_semi"), "hub_edges"), plain.join(sized(busy), "id", "left_anti")
    own = walker(spark)
    with Buckets(own, n) as at:
        back, facts = at.table("edges"), at.table("facts")
        at.add(plain.repartition(n, "id"), back)
        first = start.where("id IS NOT NULL AND bits <> 0").repartition(n, "id").groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))
        count = {"n": F.count(F.lit(1)), "left": F.count_if(F.col("fresh") != 0)}
        seen, k = at.add(first.select("id", "word", "bits", F.col("bits").alias("fresh"), F.lit(0).alias("round")), facts, **count), 0
        met = None if hubs is None else own.read.schema(hubs.schema).parquet(hubs.inputFiles()[0].rsplit("/", 1)[0])
        while seen["left"]:
            seen = at.add(a_round(own.table(facts[0]), k, own.table(back[0]), met, n, HOPS if seen["left"] <= FEW_ROWS else 1), facts, **count)
            k += 1
        return spark.read.schema(own.table(facts[0]).schema).parquet(facts[1]).select("id", "word", "bits")


def with_shortcuts(edges: DataFrame, most_growth: float = MOST_GROWTH, rounds: int = 2) -> DataFrame:
    """``edges`` (src, dst) with paths of two edges, then of up to four, as edges too, where the table stays near its size.

    Any reachability over the result equals that over ``edges``, in a half or a quarter
    of the rounds. The size is checked before each doubling: hubs in the middle of many
    paths stop it.
    """
    edges, seen = written_with(edges.select("src", "dst").distinct(), "edges", n=F.count(F.lit(1)))
    size = seen["n"]
    for _ in range(rounds):
        into = edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("i"))
        out = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("o"))
        paths = into.join(sized(out), "v").agg(F.sum(F.col("i") * F.col("o"))).first()[0] or 0
        if not paths or paths > most_growth * size:
            break
        a, b = edges.alias("a"), edges.alias("b")
        two = a.join(sized(b), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        edges = written(edges.union(two).distinct(), "edges")
    return edges


def contracted(edges: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``edges`` (src, dst) without the nodes that only pass on what one other node knows, and (id, to): whose knowledge each of those has.

    A node outside ``own`` (id) with one way out knows what its successor knows. Chains
    of such nodes are followed by doubling, so one of n nodes takes log n rounds, not n.
    Chains that end in a cycle of their own lead nowhere and go.
    """
    edges = written(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    single = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to")).where("n = 1").select(F.col("src").alias("id"), "to")
    alias, seen = written_with(single.join(sized(own.select("id").distinct()), "id", "left_anti"), "alias", n=F.count(F.lit(1)))
    if not seen["n"]:
        return edges, None
    gone, cyclic = alias.select("id"), True
    for _ in range(seen["n"].bit_length() + 1):
        jump = alias.select(F.col("id").alias("to"), F.col("to").alias("further"))
        alias, seen = written_with(alias.join(sized(jump), "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "alias", moved=F.count_if("moved"))
        alias = alias.select("id", "to")
        if not seen["moved"]:
            cyclic = False
            break
    rest = edges.join(sized(gone.select(F.col("id").alias("src"))), "src", "left_anti").join(sized(alias.select(F.col("id").alias("dst"), "to")), "dst", "left").select("src", F.coalesce("to", "dst").alias("dst"))
    if cyclic:
        lost = gone.select(F.col("id").alias("to"))
        alias = alias.join(sized(lost), "to", "left_anti").select("id", "to")
        rest = rest.join(sized(lost.select(F.col("to").alias("dst"))), "dst", "left_anti").select("src", "dst")
    return rest, alias


def known_everywhere(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``spread`` over fewer nodes and longer edges: what only passes facts on is left out and told at the end."""
    return known_beside(*contracted(edges, start), start)


def known_beside(rest: DataFrame, alias: DataFrame | None, start: DataFrame) -> DataFrame:
    """``known_everywhere`` from the tables of ``contracted``."""
    held = spread(with_shortcuts(rest), start)
    if alias is None:
        return held
    return held.union(alias.join(sized(held.withColumnRenamed("id", "to")), "to").select("id", "word", "bits"))


def reaching(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes (id) from which a node of ``targets`` (id) can be reached over ``edges`` (src, dst), the targets among them."""
    start = targets.select("id", F.lit(0).cast("bigint").alias("word"), F.lit(1).cast("bigint").alias("bits"))
    return known_everywhere(edges, start).select("id")


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes (id) that can be reached from ``sources`` (id), which are among them.

    The first levels are one recursive query. Spark's recursion has no UNION that drops
    what earlier levels met, so it pays for few levels alone: whatever the last of them
    still finds is where the loop goes on.
    """
    spark = edges.sparkSession
    sql = f"""
        WITH RECURSIVE near(id, level) MAX RECURSION LEVEL {LEVELS + 2} AS (
          SELECT DISTINCT id, 0 FROM {{sources}} WHERE id IS NOT NULL
          UNION ALL SELECT /*+ MERGE(e) */ DISTINCT e.dst, level + 1 FROM near JOIN {{edges}} e ON e.src = near.id WHERE level < {LEVELS} AND e.dst IS NOT NULL)
        SELECT id, min(level) AS level FROM near GROUP BY id LIMIT ALL"""
    near, seen = written_with(spark.sql(sql, sources=sources.select("id"), edges=edges.select("src", "dst")), "near", far=F.max("level"))
    if (seen["far"] or 0) < LEVELS:
        return near.select("id")
    return reaching(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), near.select("id"))


def walks(edges: DataFrame, out: str, into: str) -> DataFrame:
    """(id, n): about how many walks of up to ``PIVOT_STEPS`` edges begin at each node with an edge, followed from ``out`` to ``into``."""
    count = edges.groupBy(F.col(out).alias("id")).agg((F.count(F.lit(1)) + 1).cast("double").alias("n"))
    for _ in range(PIVOT_STEPS - 1):
        further = edges.join(sized(count.withColumnRenamed("id", into)), into, "left")
        count = further.groupBy(F.col(out).alias("id")).agg((F.sum(F.coalesce("n", F.lit(1.0))) + 1).alias("n"))
    return count


def pivots(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, part): the part of the graph that each node lies in, parts being joined by no edge of ``edges`` (src, dst); and (id, part): one node of each large part, where most walks pass."""
    own = walker(edges.sparkSession)
    apart = connected_components(own.read.schema(edges.schema).parquet(edges.inputFiles()[0].rsplit("/", 1)[0]).select(F.col("src").alias("a"), F.col("dst").alias("b")))
    part = edges.sparkSession.read.schema(apart.schema).parquet(*apart.inputFiles()).select("id", F.col("label").alias("part"))
    large = part.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PIVOT_NODES).select("part")
    score = walks(edges, "src", "dst").join(sized(walks(edges, "dst", "src").withColumnRenamed("n", "back")), "id").select("id", (F.col("n") * F.col("back")).alias("score"))
    best = score.join(sized(part), "id").join(sized(large), "part", "left_semi").groupBy("part").agg(F.max_by("id", F.struct("score", "id")).alias("id"))
    return part, written(best.select("id", "part"), "pivots")


def around_pivots(edges: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """``known_everywhere`` in three tables, each fact once: (id, word, bits), and the product of (id, part) and (part, word, bits), which isn't taken.

    Most of what a large graph knows passes its strong core: whoever reaches the pivot of
    a part knows all that the pivot knows. So those nodes and that knowledge are listed
    once; what is walked further are the facts that don't pass the core, which is the
    nodes that reach the pivot and are reached from it. A part has one pivot, so no two
    products meet, whichever node it is.
    """
    rest, alias = contracted(edges, start)
    rest = rest if alias is None else written(rest.distinct(), "rest")
    if rest.limit(PIVOT_EDGES).count() < PIVOT_EDGES:
        return known_beside(rest, alias, start), None, None
    part, pivot = pivots(rest)
    if pivot.isEmpty():
        return known_beside(rest, alias, start), None, None
    short = with_shortcuts(rest)
    flag = pivot.select("id", F.lit(0).cast("bigint").alias("word"), F.lit(1).cast("bigint").alias("bits"))
    above = spread(short, flag).select("id")
    below = spread(short.select(F.col("dst").alias("src"), F.col("src").alias("dst")), flag).select("id")
    core = written(above.join(sized(below), "id", "left_semi"), "core")
    upper = written(above.join(sized(part), "id").select("id", "part"), "upper")
    lower = start.join(sized(below), "id", "left_semi").join(sized(part), "id").groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
    lower = written(lower, "lower")
    beside = rest.join(sized(core.withColumnRenamed("id", "src")), "src", "left_anti")
    held = spread(with_shortcuts(beside), written(start.join(sized(core), "id", "left_anti"), "start"))
    told = lower.select("part", "word", F.col("bits").alias("told"))
    held = held.join(sized(upper), "id", "left").join(sized(told), ["part", "word"], "left")
    held = held.select("id", "word", F.expr("bits & ~coalesce(told, 0L)").alias("bits")).where("bits <> 0")
    if alias is not None:
        held = written(held, "held")
        held = held.union(alias.join(sized(held.withColumnRenamed("id", "to")), "to").select("id", "word", "bits"))
        upper = upper.union(alias.join(sized(upper.withColumnRenamed("id", "to")), "to").select("id", "part"))
    return held, upper, lower


def words_reaching(edges: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None, DataFrame]:
    """The tables of ``around_pivots`` for what each node holds, its ``own`` (id, label) and that of every node it can reach; and (label, word, bit).

    Labels are numbered in order, 64 to a word, so that neighbours share one.
    """
    own = written(own.where("label IS NOT NULL").select("id", "label").distinct(), "own")
    number = written(own.select("label").distinct().orderBy("label").withColumn("k", F.monotonically_increasing_id()), "labels")
    number = number.select("label", F.shiftright("k", 6).alias("word"), F.col("k").bitwiseAND(63).cast("int").alias("bit"))
    start = written(own.join(sized(number), "label").select("id", "word", F.expr("shiftleft(1L, bit)").alias("bits")), "start")
    return *around_pivots(edges, start), number


def labels_reaching(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(id, label) pairs, each once: each node holds its ``own`` (id, label) and those of every node it can reach.

    Words meet their labels before they are taken apart, so what is shuffled are words.
    Products are taken last, the nodes of a part in as many shares as there are shuffle partitions.
    """
    held, upper, lower, number = words_reaching(edges, own)
    word = number.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("bit", "label"))).alias("labels"))
    found = F.expr("filter(labels, x -> (bits & shiftleft(1L, x.bit)) <> 0).label")
    pairs = held.join(sized(word), "word").select("id", F.explode(found).alias("label"))
    if upper is None:
        return pairs
    shares = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = written(lower.join(sized(word), "word").select("part", found.alias("labels")), "known")
    known = known.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    shared = upper.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int"))
    return pairs.union(shared.join(sized(known), ["part", "share"]).select("id", F.explode("labels").alias("label")))


def label_counts(edges: DataFrame, own: DataFrame, counted: DataFrame) -> DataFrame:
    """(label, n): how many nodes of ``counted`` (id) hold a label of ``labels_reaching``, without the pairs: bits are counted where words lie, and a product by its sides."""
    held, upper, lower, number = words_reaching(edges, own)
    bit = F.explode(F.expr("filter(sequence(0, 63), b -> (bits & shiftleft(1L, b)) <> 0)")).alias("bit")
    counted = counted.select("id").distinct()
    each = held.join(sized(counted), "id", "left_semi").select("word", bit).groupBy("word", "bit").agg(F.count(F.lit(1)).alias("n"))
    if upper is not None:
        holders = upper.join(sized(counted), "id", "left_semi").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        each = each.union(lower.join(sized(holders), "part").select("word", bit, "n")).groupBy("word", "bit").agg(F.sum("n").alias("n"))
    return each.join(sized(number), ["word", "bit"]).select("label", "n")


def closure_pairs(edges: DataFrame, through: DataFrame, stop: DataFrame) -> DataFrame:
    """(src, dst) with ``src`` in ``through``, ``dst`` in ``stop`` and only nodes of ``through`` between."""
    inner = written(edges.join(sized(through.select(F.col("id").alias("src"))), "src", "left_semi"), "inner")
    last = inner.join(sized(stop.select(F.col("id").alias("dst"))), "dst", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("label"))
    middle = inner.join(sized(through.select(F.col("id").alias("dst"))), "dst", "left_semi").select("src", "dst")
    return labels_reaching(middle, last.distinct()).select(F.col("id").alias("src"), F.col("label").alias("dst"))
