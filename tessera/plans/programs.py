"""Queries of programs' tests, contexts, runs and reports, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import strings as S
from tessera.operators import boolean_tests, filters, stats
from tessera.plans.texts import CONTEXT, TESTS, context_pool, order_tests
from tessera.registry import Catalogue
from tessera.session import table
from tessera.streaming.events import epochs

catalogue = Catalogue()
query = catalogue.query


@query("true_false_balance", f"WITH {TESTS} SELECT program, count(*) FILTER (result = 'True') AS n_true, count(*) FILTER (result = 'False') AS n_false FROM o GROUP BY program")
def true_false_balance(spark, sf_dir):
    tests = boolean_tests.crossed(order_tests(spark, sf_dir))
    return tests.groupBy("program").agg(F.count_if(F.col("result") == "True").alias("n_true"), F.count_if(F.col("result") == "False").alias("n_false"))


@query("balance_totals", f"WITH {TESTS}, b AS (SELECT program, count(*) FILTER (result = 'True') AS t, count(*) FILTER (result = 'False') AS f FROM o GROUP BY program) SELECT count(*) AS programs, sum(t)::bigint AS n_true, sum(f)::bigint AS n_false, round(avg(t), 6) AS mean_true, round(avg(f), 6) AS mean_false FROM b")
def balance_totals(spark, sf_dir):
    b = true_false_balance(spark, sf_dir)
    return b.agg(F.count("*").alias("programs"), F.sum("n_true").alias("n_true"), F.sum("n_false").alias("n_false"), F.round(F.avg("n_true"), 6).alias("mean_true"), F.round(F.avg("n_false"), 6).alias("mean_false"))


@query(
    "verify_counters",
    "SELECT user_id AS task, count(*) FILTER (event_type = 'purchase') AS passed, count(*) FILTER (event_type <> 'purchase') AS failed, coalesce(string_agg(CASE WHEN event_type = 'error' THEN event_id::varchar || ':' || props END, ',' ORDER BY event_id), '') AS errors FROM events GROUP BY 1",
)
def verify_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    errors = F.sort_array(F.collect_list(F.when(F.col("event_type") == "error", F.struct("event_id", "props"))))
    out = e.groupBy(F.col("user_id").alias("task")).agg(F.count_if(F.col("event_type") == "purchase").alias("passed"), F.count_if(F.col("event_type") != "purchase").alias("failed"), errors.alias("x"))
    return out.select("task", "passed", "failed", F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["event_id"], r["props"])), ",").alias("errors"))


@query(
    "runtimes_by_task",
    "SELECT user_id AS task, count(*) FILTER (event_type = 'click') AS timeouts, coalesce(string_agg(CASE WHEN event_type = 'purchase' THEN event_id::varchar END, ',' ORDER BY event_id), '') AS passed, round(avg(value) FILTER (event_type = 'purchase'), 6) AS mean_runtime FROM events GROUP BY 1",
)
def runtimes_by_task(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ran = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return e.groupBy(F.col("user_id").alias("task")).agg(F.count_if(F.col("event_type") == "click").alias("timeouts"), F.array_join(F.sort_array(F.collect_list(ran)), ",").alias("passed"), F.round(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))), 6).alias("mean_runtime"))


@query("few_and_zero_shot", "SELECT item_id, shots, CASE WHEN shots = 'few' THEN text ELSE '' END AS context FROM benchmark, (VALUES ('few'), ('zero')) s(shots)")
def few_and_zero_shot(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    few = b.select("item_id", F.lit("few").alias("shots"), F.col("text").alias("context"))
    return few.unionByName(b.select("item_id", F.lit("zero").alias("shots"), F.lit("").alias("context")))


@query(
    "generated_tests_attach",
    "SELECT o_orderkey AS program, count(l_orderkey) FILTER (l_returnflag <> 'R') AS own, count(l_orderkey) FILTER (l_returnflag = 'R') AS generated, count(l_orderkey) AS tests FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
)
def generated_tests_attach(spark, sf_dir):
    """Programs with their own tests, to which generated ones are attached by name."""
    i = table(spark, sf_dir, "lineitem")
    listed = lambda c, name: i.where(c).groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias(name))
    empty = lambda name: F.coalesce(name, F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint>>"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    both = o.join(listed("l_returnflag <> 'R'", "own"), "l_orderkey", "left").join(listed("l_returnflag = 'R'", "generated"), "l_orderkey", "left")
    size = lambda c: F.size(c).cast("long")
    return both.select(F.col("l_orderkey").alias("program"), size(empty("own")).alias("own"), size(empty("generated")).alias("generated"), size(F.concat(empty("own"), empty("generated"))).alias("tests"))


@query("page_map_join", "SELECT p.page_id, m.pages FROM pages p JOIN (SELECT regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path, count(*) AS pages FROM pages GROUP BY 1) m ON regexp_extract(p.url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) = m.path")
def page_map_join(spark, sf_dir):
    """Pages joined to a map by path; a path that the map has twice is an error."""
    p = table(spark, sf_dir, "pages").select("page_id", F.coalesce(S.path(F.col("url")), F.lit("")).alias("path"))
    named = p.groupBy("path").agg(F.count("*").alias("pages"))
    return filters.join_unique(p, named, "path").select("page_id", "pages")


@query("chain_conflicts", "SELECT p_partkey, len(list_intersect([lower(p_type), split_part(p_name, ' ', 1)], ['promo', 'red', 'small']))::int AS conflicts FROM part")
def chain_conflicts(spark, sf_dir):
    """How many steps of two processor chains have the same name."""
    first = F.array(F.lower("p_type"), F.split("p_name", " ")[0])
    return table(spark, sf_dir, "part").select("p_partkey", F.size(F.array_intersect(first, F.array(F.lit("promo"), F.lit("red"), F.lit("small")))).alias("conflicts"))


@query("epochs", "SELECT item_id, epoch::int AS epoch FROM benchmark, range(0, 3) t(epoch)")
def epochs_query(spark, sf_dir):
    return epochs(table(spark, sf_dir, "benchmark").select("item_id"), 3)


@query("run_names", "SELECT DISTINCT replace(p_name, ' ', '_x')[:length(replace(p_name, ' ', '_x')) - length(split_part(p_name, ' ', 2)) - 2] AS name, CASE p_size % 3 WHEN 0 THEN 'eval/' WHEN 1 THEN 'test/' ELSE 'train/' END || p_brand AS metric FROM part")
def run_names(spark, sf_dir):
    """Runs named "a_xb-size" and metrics of three kinds."""
    run = F.concat(F.replace("p_name", F.lit(" "), F.lit("_x")), F.lit("-"), F.col("p_size").cast("string"))
    metric = F.concat(F.element_at(F.array(F.lit("eval_"), F.lit("test_"), F.lit("")), (F.col("p_size") % 3 + 1).cast("int")), "p_brand")
    return table(spark, sf_dir, "part").select(S.run_name(run).alias("name"), S.metric_name(metric).alias("metric")).distinct()


@query("renamed_subset", "SELECT n_nationkey, 'Region ' || n_regionkey::varchar AS display FROM nation WHERE n_regionkey IN (0, 2)")
def renamed_subset(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("run", F.col("n_regionkey").cast("string"))
    return filters.renamed_subset(n, {"0": "Region 0", "2": "Region 2"}, "run").select("n_nationkey", "display")


@query("missing_keys", "SELECT 'missing' AS side, count(*) FILTER (l.doc_id IS NULL) AS n FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT 'present', count(l.doc_id) FROM documents d LEFT JOIN labels l USING (doc_id)")
def missing_keys(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    have, lack = filters.with_keys(table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left"), "quality")
    count = lambda d, side: d.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(lack, "missing").union(count(have, "present"))


@query(
    "context_stats",
    f"""WITH RECURSIVE {TESTS}, {CONTEXT}, n AS (SELECT p.program, count(rank) AS n, coalesce(sum(length(input)), 0) AS chars FROM (SELECT DISTINCT o_orderkey AS program FROM orders) p LEFT JOIN chosen USING (program) GROUP BY 1)
        SELECT count(*) AS programs, round(avg(n), 6) AS mean_examples, round(avg(chars), 6) AS mean_chars, count(*) FILTER (n = 0) AS without, count(*) FILTER (n < 4) AS below_quota FROM n""",
)
def context_stats(spark, sf_dir):
    """Sizes of the chosen contexts: their means, and how many programs have none or are below their quota."""
    chosen = boolean_tests.greedy_context(context_pool(spark, sf_dir), true_quota=2, false_quota=2)
    programs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("program")).distinct()
    return stats.context_sizes(programs, chosen, "program", "input", 4)


@query("distinct_outcomes", "SELECT event_type, count(DISTINCT user_id) AS tasks FROM events GROUP BY 1")
def distinct_outcomes(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("tasks"))


@query("score_softmax", "SELECT vec_id, round(exp(embedding[1]::double) / (exp(embedding[1]::double) + exp(embedding[2]::double)) * 100, 4) AS first_pct FROM embeddings")
def score_softmax(spark, sf_dir):
    two = F.slice(F.col("embedding").cast("array<double>"), 1, 2)
    return table(spark, sf_dir, "embeddings").select("vec_id", stats.softmax_percent(two)[0].alias("first_pct"))
