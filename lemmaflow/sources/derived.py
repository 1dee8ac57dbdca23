"""Declaration tables derived from the star-schema tables, so that every operator has data at any scale.

The statements are plain SQL that Spark runs over DataFrames. Parts are declarations,
lines of one order reference each other, suppliers are modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lemmaflow.plans.scratch import sized
from lemmaflow.sources.tables import table

#: Stands for the placeholder of missing proofs; part keys are not negative.
SORRY = -1
#: Stand for the axioms that every development may use; where they are axioms outside the project they hold nothing.
STANDARD = [17, 37, 57, 77, 97]

DECL = """
SELECT p_partkey AS id,
  'Pkg.M' || CAST(p_partkey % 20 AS STRING) || '.' || replace(p_name, ' ', '_') || CASE p_partkey % 12 WHEN 0 THEN '.eq_1' WHEN 1 THEN '._aux' WHEN 2 THEN '.mvcgen_spec'
    WHEN 3 THEN '.proof_1' WHEN 4 THEN '_spec' WHEN 5 THEN '.spec' WHEN 6 THEN '.mk' ELSE '' END AS name,
  'Pkg.M' || CAST(p_partkey % 20 AS STRING) || CASE WHEN p_partkey % 20 = 7 THEN '.FunsExternal' ELSE '.Funs' END AS module,
  CASE p_type WHEN 'ECONOMY' THEN 'def' WHEN 'LARGE' THEN 'theorem' WHEN 'MEDIUM' THEN 'abbrev' WHEN 'PROMO' THEN 'axiom' WHEN 'SMALL' THEN 'structure' ELSE 'theorem' END AS kind,
  CASE p_type WHEN 'ECONOMY' THEN 'defn' WHEN 'LARGE' THEN 'thm' WHEN 'MEDIUM' THEN 'defn' WHEN 'PROMO' THEN 'axiom' WHEN 'SMALL' THEN 'induct' ELSE 'thm' END AS ctor_kind,
  p_partkey % 20 <> 17 AS in_project, p_brand = 'Brand#1' AS tagged, p_partkey % 20 = 7 AS module_external, p_type IN ('LARGE', 'STANDARD') AS type_is_prop,
  p_size = 1 AS carrier, p_size >= 45 AS aux,
  p_size % 7 = 0 AS is_hidden, p_partkey % 12 IN (0, 6) AS is_lean_generated, p_brand = 'Brand#5' AS is_aeneas_generated, p_size <> 13 AS is_relevant,
  p_type IN ('LARGE', 'STANDARD') AND p_brand IN ('Brand#3', 'Brand#8', 'Brand#11') AS is_primary_spec, p_brand = 'Brand#9' AS known_attribute,
  'probe:Pkg.M' || CAST(p_partkey % 20 AS STRING) || '.' || replace(p_name, ' ', '_') AS code_name,
  'Pkg/M' || CAST(p_partkey % 20 AS STRING) || CASE WHEN p_partkey % 20 = 7 THEN '/FunsExternal' ELSE '/Funs' END || '.lean' AS code_path,
  CASE WHEN p_partkey % 11 = 3 THEN NULL ELSE CAST((p_partkey * 3) % 500 + 1 AS INT) END AS lines_start,
  CASE WHEN p_partkey % 11 = 3 THEN NULL ELSE CAST((p_partkey * 3) % 500 + 1 + p_size AS INT) END AS lines_end
FROM {part}
"""

EDGE = """
SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst, CASE WHEN a.l_linestatus = 'O' AND a.l_returnflag = 'N' THEN 'type' ELSE 'value' END AS role
FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey
WHERE b.l_linenumber > a.l_linenumber AND a.l_partkey <> b.l_partkey AND a.l_quantity <= 8 AND b.l_quantity <= 8
UNION SELECT p_partkey, CAST(-1 AS BIGINT), 'value' FROM {part} WHERE p_size = 1
"""

VERSION = """
SELECT DISTINCT replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 37 AS STRING) AS name, 'M' || CAST(p_partkey % 20 AS STRING) AS module,
  p_partkey % 20 NOT IN (7, 13) AS in_project, CASE p_type WHEN 'LARGE' THEN 'thm' WHEN 'STANDARD' THEN 'thm' WHEN 'PROMO' THEN 'axiom' ELSE 'defn' END AS ctor_kind,
  CASE p_type WHEN 'PROMO' THEN 'axiom' WHEN 'LARGE' THEN 'theorem' WHEN 'STANDARD' THEN 'theorem' ELSE 'def' END AS kind,
  'h' || CAST(p_partkey % 37 % 5 AS STRING) AS type_hash, p_brand = 'Brand#2' AS is_unsafe, p_partkey % 20 = 7 AS module_external, p_type IN ('LARGE', 'STANDARD') AS type_is_prop
FROM {part}
"""

MODULE = "SELECT 'L' || CAST(s_suppkey % 10 AS STRING) || '.S' || CAST(s_suppkey AS STRING) AS module, s_nationkey % 5 <> 0 AS in_build_dir, s_acctbal > 8000 AS is_target, s_nationkey FROM {supplier}"

IMPORT = """
SELECT DISTINCT 'L' || CAST(a.l_suppkey % 10 AS STRING) || '.S' || CAST(a.l_suppkey AS STRING) AS module, 'L' || CAST(b.l_suppkey % 10 AS STRING) || '.S' || CAST(b.l_suppkey AS STRING) AS imported
FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey
WHERE b.l_linenumber = a.l_linenumber + 1 AND a.l_suppkey <> b.l_suppkey
"""


#: One row for each name and module that declares it, with where it is attributed and whether that module is shown.
LOCATION = """
SELECT name, module, min(owner_module) AS owner_module, min(p_partkey % 20) % 3 <> 0 AS selected,
  CASE WHEN min(p_partkey % 20) % 4 <> 1 THEN CAST(min(p_partkey) AS INT) END AS range_start, CASE WHEN min(p_partkey % 20) % 4 <> 1 THEN CAST(min(p_partkey) + 5 AS INT) END AS range_end
FROM (SELECT p_partkey, replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 7 AS STRING) AS name, 'M' || CAST(p_partkey % 20 AS STRING) AS module, 'M' || CAST(p_partkey % 7 * 2 AS STRING) AS owner_module FROM {part}) x
GROUP BY name, module
"""

#: Atoms and relations in which every rule for a primary specification decides something. Targets are the ids that leave 2 modulo 3.
SPEC_ATOM = """
SELECT id, CASE WHEN t = id THEN 'N.T' || CAST(id AS STRING) WHEN id % 7 = 0 THEN 'N.T' || CAST(t AS STRING) || '_spec' WHEN id % 7 = 1 THEN 'Q.T' || CAST(t AS STRING) || '.spec' ELSE 'N.T' || CAST(id AS STRING) END AS name,
  CASE WHEN t = id THEN 'none' WHEN id % 7 = 2 THEN 'step' WHEN id % 7 = 3 THEN 'progress' ELSE 'simp' END AS attribute,
  CASE WHEN t = id THEN NULL WHEN id % 7 = 1 THEN 'N.T' || CAST(t AS STRING) WHEN id % 7 = 3 AND id % 2 = 0 THEN 'N.other' END AS head, t <> id AND id % 7 IN (4, 5) AS is_primary_spec, t
FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 2 THEN p_partkey ELSE p_partkey - 1 - p_partkey % 3 END AS t FROM {part}) x
"""

SPEC_RELATION = "SELECT p_partkey - 1 - p_partkey % 3 AS target, p_partkey AS source FROM {part} WHERE p_partkey > 2 AND p_type IN ('LARGE', 'STANDARD', 'PROMO')"


def derived(spark: SparkSession, folder: str, statement: str) -> DataFrame:
    """The statement over the tables of ``folder`` that it names; lines, which statements join with lines, are merged."""
    names = [n for n in ("part", "lineitem", "supplier") if "{" + n + "}" in statement]
    read = {n: table(spark, folder, n) for n in names}
    return spark.sql(statement, **{n: sized(t) if n == "lineitem" else t for n, t in read.items()})
