"""Queries over sorted files and sorted sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.register import registry
from factloom.sources import integrity, ranges
from factloom.sources.shared import keep, shared_dir
from factloom.sources.tables import table

QUERIES, ORACLES, query = registry()

_LINE = """'{"document":"C' || lpad(o_custkey::VARCHAR, 9, '0') || '","order":' || o_orderkey || '}'"""


@query("ranged_lines", f"""WITH l AS (SELECT 'C' || lpad(o_custkey::VARCHAR, 9, '0') AS document, o_orderkey, {_LINE} AS line FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 = 0))
  SELECT document, count(*) AS lines, sum(length(line) + 1)::BIGINT AS bytes, sha256(string_agg(line || chr(10), '' ORDER BY o_orderkey)) AS sha256 FROM l GROUP BY document""")  # fmt: skip
def ranged_lines(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as one sorted folder of lines, indexed by byte ranges; every fiftieth customer's lines are read back through the index."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    named = table(spark, sf, "orders").select(F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("document"), F.col("o_orderkey").alias("order"))
    integrity.write_canonical_jsonl(named, path, ["document", "order"])
    asked = table(spark, sf, "customer").filter("c_custkey % 50 = 0").select(F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("document"))
    index = keep(ranges.build_index(spark, path, "document", 1 << 16), "ranges")
    lines = ranges.ranged(spark, path, "document", 1 << 16, index).join(asked, "document", "left_semi")
    own = F.array_sort(F.collect_list(F.struct("path", "start", "line")))
    text = F.concat(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), F.lit("\n"))
    return lines.groupBy("document").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.sha2(text, 256).alias("sha256"))


_KEY = "lpad(l_orderkey::VARCHAR, 9, '0') || '-' || l_linenumber"


@query("merge_validation", f"""WITH a AS (SELECT {_KEY} AS key, l_orderkey * 10 + l_linenumber AS o, l_quantity::BIGINT::VARCHAR AS d FROM lineitem),
  b AS (SELECT key, o, d FROM a WHERE o % 97 <> 0 UNION ALL SELECT key, o, d FROM a WHERE o % 211 = 1 AND o % 97 <> 0 UNION ALL SELECT key || 'x', o, d FROM a WHERE o % 307 = 2),
  c AS (SELECT key, CASE WHEN o % 401 = 3 THEN o + 500 ELSE o END AS o, CASE WHEN o % 103 = 4 THEN 'other' ELSE d END AS d FROM a),
  s AS (SELECT 'a' AS source, * FROM a UNION ALL SELECT 'b', * FROM b UNION ALL SELECT 'c', * FROM c),
  k AS (SELECT source, key, count(*) AS n, min(o) AS low, max(o) AS high, min(d) AS d, max(d) AS e FROM s GROUP BY ALL),
  w AS (SELECT *, min(low) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM k),
  lead AS (SELECT * FROM k WHERE source = 'a'), others AS (SELECT unnest(['b', 'c']) AS source)
  SELECT key, source, 'repeated' AS kind FROM w WHERE n > 1 UNION ALL SELECT key, source, 'reordered' FROM w WHERE high > after
  UNION ALL SELECT k.key, k.source, 'foreign' FROM k WHERE source <> 'a' AND key NOT IN (SELECT key FROM lead)
  UNION ALL SELECT lead.key, others.source, 'missing' FROM lead, others WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.source = others.source AND k.key = lead.key)
  UNION ALL SELECT k.key, k.source, 'changed' FROM k JOIN lead USING (key) WHERE k.source <> 'a' AND (k.d <> lead.d OR k.e <> lead.e)""")  # fmt: skip
def merge_validation(spark: SparkSession, sf: str) -> DataFrame:
    """All line items as three sources of which two lack, repeat, add, change or misplace some."""
    key = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lit("-"), "l_linenumber")
    a = table(spark, sf, "lineitem").select(key.alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("ordinal"), F.col("l_quantity").cast("long").cast("string").alias("digest"))
    b = a.filter("ordinal % 97 <> 0")
    b = b.unionByName(b.filter("ordinal % 211 = 1")).unionByName(a.filter("ordinal % 307 = 2").withColumn("key", F.concat("key", F.lit("x"))))
    late, other = F.col("ordinal") % 401 == 3, F.col("ordinal") % 103 == 4
    c = a.select("key", F.when(late, F.col("ordinal") + 500).otherwise(F.col("ordinal")).alias("ordinal"), F.when(other, "other").otherwise(F.col("digest")).alias("digest"))
    return ranges.merge_validate({"a": a, "b": b, "c": c}, "a")
