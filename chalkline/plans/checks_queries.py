"""Queries over the cross-cutting checks, on the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.operators import checks as K
from chalkline.plans.bridges import read
from chalkline.plans.registry import query


@query("dq.enum_range", """SELECT 'status' AS rule, count(*) FILTER (NOT coalesce(l_linestatus IN ('O', 'F'), false)) AS n FROM lineitem UNION ALL SELECT 'discount', count(*) FILTER (NOT coalesce(l_discount BETWEEN 0 AND 0.05, false)) FROM lineitem UNION ALL SELECT 'quantity', count(*) FILTER (NOT coalesce(l_quantity >= 1 AND l_quantity <= 50, false)) FROM lineitem""")
def enum_range(spark, d):
    return K.violations(read(spark, d, "lineitem"), {"status": F.col("l_linestatus").isin("O", "F"), "discount": F.col("l_discount").between(0, 0.05), "quantity": F.col("l_quantity").between(1, 50)})


@query("dq.unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique(spark, d):
    return K.duplicates(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq.one_to_one", "WITH l AS (SELECT o_custkey AS k, count(*) AS l FROM orders GROUP BY 1), r AS (SELECT c_custkey AS k, count(*) AS n FROM customer WHERE c_custkey % 9 <> 0 GROUP BY 1) SELECT max(l) <= 1 AS left_unique, coalesce(max(n), 0) <= 1 AS right_unique, sum(CASE WHEN n IS NULL THEN l ELSE 0 END)::BIGINT AS unmatched FROM l LEFT JOIN r USING (k)")
def one_to_one(spark, d):
    return K.cardinality(read(spark, d, "orders").select(F.col("o_custkey").alias("k")), read(spark, d, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("k")), "k")


@query("dq.manifest", """WITH m AS (SELECT count(*) > 0 AS a, count(*) = count(DISTINCT doc_id) AS b, bool_and(regexp_full_match(md5(text), '[0-9a-f]{32}')) AS c, bool_and(n_chars >= 10) AS e, count(DISTINCT lang) = 4 AS f FROM documents)
SELECT unnest(['not_empty', 'unique_ids', 'hash_format', 'long_enough', 'languages']) AS check_name, unnest([a, b, c, e, f]) AS passed FROM m""")
def manifest(spark, d):
    return K.manifest(read(spark, d, "documents"), {"not_empty": F.count("*") > 0, "unique_ids": F.count("*") == F.countDistinct("doc_id"), "hash_format": F.bool_and(F.md5("text").rlike("^[0-9a-f]{32}$")), "long_enough": F.bool_and(F.col("n_chars") >= 10), "languages": F.countDistinct("lang") == 4})
