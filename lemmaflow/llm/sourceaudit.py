"""Source divergence audit: how far the term distributions of a language's sources lie apart.

Terms are counted where the texts are, then hashed by language and term to shards, so that
a term has all its counts in one. Each shard is an in-memory DuckDB, which says in SQL
which terms stay, and then, once Spark has summed the shards' totals, what every pair of
sources has in common in it. Only sums and the best terms of a shard leave it; Spark adds
the sums up and ranks.

With counts of nought written p(0), which is one number for a source, the sum of
f(p, q) = floor((p - q)^2 / q) over all kept terms is

    V f(p0, q0)  +  what terms of the first source add to that, beside q0
                 +  what terms of the second add, beside p0
                 +  what terms of both add still.

The middle two hang on a count alone, so a table of how many terms have which count is
enough; shards look only at terms that two sources share. Nothing is as large as terms
times sources.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.llm.bytescan import LOWER, buffers, groups_of_rows, lean
from lemmaflow.plans.scratch import written

#: Documents of a language that a term needs.
LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP = 200
#: Bytes of text whose terms are counted at a time, and rows that a shard holds before it adds up equal ones.
CHUNK_BYTES = 8 << 20
COMPACT_ROWS = 1 << 20
BATCH_ROWS = 1 << 16

# What a term is made of: letters A to Z and all that isn't ASCII.
TERM = np.zeros(256, dtype=bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True

COUNTED = "lang string, source string, term string, n bigint, d bigint"
KEPT = "lang string, source string, term string, n bigint"
SHARED = "part string, lang string, source string, item string, value decimal(38,0)"

KEEP = f"""
SELECT lang, source, term, n FROM (SELECT *, sum(d) OVER (PARTITION BY lang, term) AS docs FROM (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(d)::BIGINT AS d FROM rows GROUP BY ALL))
WHERE docs >= {LEAST_DOCUMENTS}
"""
P = "(1 + {scale}::HUGEINT * ({n} + 1) // ({total} + {kinds}))::BIGINT"
F_OF = "(({p} - {q}) * ({p} - {q}) // {q})"


def f_sql(p: str, q: str) -> str:
    return F_OF.format(p=p, q=q)


#: p of a term in a source, p0 of a term that the source lacks, q of the term in the language.
PROBABLE = f"""
CREATE TABLE probable AS SELECT lang, source, term, {P.format(scale=SCALE, n='n', total='own', kinds='kinds')} AS p, {P.format(scale=SCALE, n=0, total='own', kinds='kinds')} AS p0,
  {P.format(scale=SCALE, n='sum(n) OVER (PARTITION BY lang, term)', total='whole', kinds='kinds')} AS q FROM rows
"""
PARTIAL = f"""
SELECT 'pair' AS part, a.lang AS lang, a.source AS source, b.source AS item,
  sum({f_sql('a.p', 'b.p')} - {f_sql('a.p', 'b.p0')} - {f_sql('a.p0', 'b.p')} + {f_sql('a.p0', 'b.p0')})::DECIMAL(38, 0) AS value
FROM probable a JOIN probable b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
UNION ALL
SELECT 'term', lang, source, term, value::DECIMAL(38, 0) FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) AS place FROM (SELECT lang, source, term, {f_sql('p', 'q')} AS value FROM probable WHERE p > q))
WHERE place <= {TOP}
"""


def database():
    """An in-memory database with one thread, which writes nothing to the machine's disk."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})


def terms_of(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of rows laid end to end, A to Z lower-cased, and the row of each."""
    inside = TERM[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    begins[borders] = inside[borders]
    ends[borders - 1] = inside[borders - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=offsets[1:])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]]))
    return terms, np.searchsorted(at, starts, side="right") - 1


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, d): occurrences and documents of each term, for some megabytes of text at a time."""
    lean()
    with database() as db:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for k, stop in groups_of_rows(at, CHUNK_BYTES, 1 << 20):
                terms, row = terms_of(data[at[k] : at[stop]], at[k : stop + 1] - at[k])
                if not len(terms):
                    continue
                words = pa.table({"doc": row, "term": terms.dictionary_encode()})  # noqa: F841  DuckDB finds it by name
                of = pa.table({"doc": np.arange(stop - k), "lang": batch.column("lang").slice(k, stop - k), "source": batch.column("source").slice(k, stop - k)})  # noqa: F841
                found = db.sql("SELECT lang, source, term::VARCHAR AS term, sum(n)::BIGINT AS n, count(*) AS d FROM (SELECT doc, term, count(*) AS n FROM words GROUP BY doc, term) JOIN of USING (doc) GROUP BY ALL")
                yield from batches_of(found, COUNTED)


def batches_of(found, schema: str) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in schema.split(", ")]
    for batch in found.to_arrow_reader(BATCH_ROWS):
        yield pa.RecordBatch.from_arrays([x.cast(pa.string()) if pa.types.is_large_string(x.type) else x for x in batch.columns], names=names)


def shard(*questions: str, schema: str, compact: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that loads its shards' rows into a database and answers with the last question; ``compact`` replaces the rows by their sums whenever there are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        with database() as db:
            held, most, there = 0, COMPACT_ROWS, False
            for batch in batches:
                more = pa.Table.from_batches([batch])  # noqa: F841
                db.execute("INSERT INTO rows SELECT * FROM more" if there else "CREATE TABLE rows AS SELECT * FROM more").fetchall()
                there, held = True, held + batch.num_rows
                if compact and held > most:
                    for q in (f"CREATE TABLE fewer AS {compact}", "DROP TABLE rows", "ALTER TABLE fewer RENAME TO rows"):
                        db.execute(q).fetchall()
                    held = db.execute("SELECT count(*) FROM rows").fetchall()[0][0]
                    most = max(COMPACT_ROWS, 2 * held)
            if there:
                for q in questions[:-1]:
                    db.execute(q).fetchall()
                yield from batches_of(db.sql(questions[-1]), schema)

    return run


def audit_sources(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language its divergence from every other (part ``pair``) and its most telling terms (part ``term``).

    Null lang, source and text are ''. Rows are documents: repeated rows count each. A
    language without terms that three documents have gives pairs of value 0 and no terms;
    a source without terms is a source like any other. Ties rank by the item's bytes. An
    empty table gives no rows. Columns of other names don't matter. ``shards`` is how many
    parts terms are dealt to, by default the session's shuffle partitions; a task holds
    the counts of its part's different terms. All arithmetic is in whole numbers.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = plain.select("lang", "source").distinct()
    kept = plain.mapInArrow(counted, COUNTED).repartition(shards, "lang", "term").mapInArrow(shard(KEEP, schema=KEPT, compact="SELECT lang, source, term, sum(n)::BIGINT AS n, sum(d)::BIGINT AS d FROM rows GROUP BY ALL"), KEPT)
    kept = written(kept, "kept")

    kinds = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("whole"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    totals = groups.join(own, ["lang", "source"], "left").join(kinds, "lang", "left").select("lang", "source", zero("own"), zero("kinds"), zero("whole"))
    totals = written(totals, "totals")

    rows = kept.join(totals, ["lang", "source"]).select("lang", "source", "term", "n", "own", "kinds", "whole").repartition(shards, "lang", "term")
    shared = written(rows.mapInArrow(shard(PROBABLE, PARTIAL, schema=SHARED), SHARED), "shared")

    scaled = lambda n: (F.lit(1) + F.expr(f"(cast({SCALE} AS decimal(20, 0)) * cast({n} + 1 AS decimal(18, 0))) div cast(own + kinds AS decimal(20, 0))"))
    flat = totals.where("kinds > 0").select("lang", "source", "kinds", scaled("0L").alias("p0"))
    held = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")).join(totals, ["lang", "source"]).select("lang", "source", "terms", scaled("n").alias("p"))
    f = lambda p, q: F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}").cast("decimal(38,0)")
    sides = flat.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    beside = held.join(flat.select("lang", "source", "p0"), ["lang", "source"]).join(sides, "lang").where("source <> item")
    first = beside.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (f("p", "q0") - f("p0", "q0"))).cast("decimal(38,0)").alias("value"))
    second = beside.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(F.sum(F.col("terms") * (f("q0", "p") - f("q0", "p0"))).cast("decimal(38,0)").alias("value"))
    nought = flat.join(sides, "lang").where("source <> item").select("lang", "source", "item", (F.col("kinds") * f("p0", "q0")).cast("decimal(38,0)").alias("value"))
    none = totals.where("kinds = 0").select("lang", "source")
    empty = none.join(none.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("decimal(38,0)").alias("value"))
    both = shared.where("part = 'pair'").select("lang", "source", "item", "value")
    pairs = both.union(first).union(second).union(nought).union(empty).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda x: x.select("lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), F.row_number().over(order).alias("rank"))
    return ranked(pairs).union(ranked(shared.where("part = 'term'")).where(F.col("rank") <= TOP))
