"""Queries of statistics, sampling and evaluation, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import filters, sampling, stats
from tessera.registry import Catalogue
from tessera.session import table

catalogue = Catalogue()
query = catalogue.query

OUTCOMES = {"purchase": "Passed", "error": "RuntimeError", "signup": "SyntaxError", "view": "Failed Tests", "click": "Timed Out"}
NAMES = list(OUTCOMES.values())
AS_OUTCOME = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OUTCOMES.items()) + " ELSE 'Unknown' END"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results of predictions: the user is the task, the type the outcome."""
    e = table(spark, sf_dir, "events")
    names = F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv])
    return e.select(F.col("user_id").alias("task"), F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("Unknown")).alias("outcome"), "value", "event_id", "ts", "props")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


RESULTS = f"r AS (SELECT user_id AS task, {AS_OUTCOME} AS outcome, value, event_id FROM events)"
DESCRIBE = "count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max"


@query("describe_values", f"SELECT event_type, {DESCRIBE} FROM (SELECT event_type, value AS v FROM events) GROUP BY 1")
def describe_values(spark, sf_dir):
    return rounded(stats.describe(table(spark, sf_dir, "events"), "value", ["event_type"]), "mean", "std", "p25", "p50", "p75")


@query("describe_orders", f"SELECT {DESCRIBE}, count(*) FILTER (v >= 100000) AS large FROM (SELECT o_totalprice AS v FROM orders)")
def describe_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    large = o.agg(F.count_if(F.col("o_totalprice") >= 100000).alias("large"))
    return rounded(stats.describe(o, "o_totalprice"), "mean", "std", "p25", "p50", "p75").crossJoin(large)


@query("describe_vigintiles", "SELECT (i * 5)::int AS pct, round(quantile_cont(value, [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95])[i], 6) AS v FROM events, range(1, 20) t(i) GROUP BY i")
def describe_vigintiles(spark, sf_dir):
    return rounded(stats.vigintiles(table(spark, sf_dir, "events"), "value"), "v")


@query(
    "quantile_histogram",
    """WITH q AS (SELECT list_sort(list_distinct(list_concat([min(value)], quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]), [max(value)]))) AS e FROM events),
       b AS (SELECT e[i] AS lo, e[i + 1] AS hi FROM q, range(1, 8) t(i) WHERE i < len(e))
       SELECT round(lo, 6) AS lo, round(hi, 6) AS hi, (SELECT count(*) FROM events WHERE value > lo AND value <= hi) AS n FROM b""",
)
def quantile_histogram(spark, sf_dir):
    return rounded(stats.quantile_histogram(table(spark, sf_dir, "events"), "value", [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]), "lo", "hi")


def _pass(n: str, c: str, k: int) -> str:
    return f"CASE WHEN {c} = 0 THEN 0.0::double WHEN {n} - {c} < {k} THEN 1.0 ELSE 1.0 - list_product(list_transform(range(({n} - {c} + 1)::bigint, ({n} + 1)::bigint), lambda i: 1.0 - {k}::double / i)) END"


@query("pass_at_k", f"WITH {RESULTS}, t AS (SELECT task, count(*) AS n, count(*) FILTER (outcome = 'Passed') AS c FROM r GROUP BY task) SELECT count(*) AS tasks, " + ", ".join(f"round(avg({_pass('n', 'c', k)}) * 100, 6) AS pass_{k}" for k in (1, 5, 10)) + " FROM t")
def pass_at_k(spark, sf_dir):
    t = results(spark, sf_dir).groupBy("task").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "Passed").alias("c"))
    return t.agg(F.count("*").alias("tasks"), *[F.round(F.avg(stats.pass_at_k(F.col("n"), F.col("c"), k)) * 100, 6).alias(f"pass_{k}") for k in (1, 5, 10)])


@query(
    "outcome_pcts",
    f"WITH {RESULTS}, t AS (SELECT task, max((outcome = 'Passed')::int) AS solved FROM r GROUP BY task) SELECT "
    + ", ".join(f"round(100.0::double * count(*) FILTER (outcome = '{o}') / count(*), 6) AS {o.lower().replace(' ', '_')}_pct" for o in NAMES)
    + ", round(100.0::double * count(*) FILTER (outcome NOT IN ('Passed', 'Failed Tests', 'SyntaxError')) / count(*), 6) AS runtime_error_pct_ovr, (SELECT round(100.0::double * sum(solved) / count(*), 6) FROM t) AS problems_solved_pct FROM r",
)
def outcome_pcts(spark, sf_dir):
    r = results(spark, sf_dir)
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 6)
    solved = r.groupBy("task").agg(F.max((F.col("outcome") == "Passed").cast("int")).alias("s")).agg(F.round(100.0 * F.sum("s") / F.count("*"), 6).alias("problems_solved_pct"))
    return r.agg(*[share(F.col("outcome") == o).alias(f"{o.lower().replace(' ', '_')}_pct") for o in NAMES], share(~F.col("outcome").isin("Passed", "Failed Tests", "SyntaxError")).alias("runtime_error_pct_ovr")).crossJoin(solved)


@query("task_outcomes", f"WITH {RESULTS}, t AS (SELECT DISTINCT task FROM r), o AS (SELECT unnest({NAMES}) AS outcome) SELECT t.task, o.outcome, count(r.task) AS n FROM t CROSS JOIN o LEFT JOIN r ON r.task = t.task AND r.outcome = o.outcome GROUP BY 1, 2")
def task_outcomes(spark, sf_dir):
    return stats.outcome_counts(results(spark, sf_dir), "task", "outcome", NAMES)


@query("error_pivot", f"WITH {RESULTS} SELECT task, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o.lower().replace(' ', '_')}" for o in NAMES) + ", round(100.0::double * count(*) FILTER (outcome = 'RuntimeError') / count(*), 6) AS runtime_error_pct FROM r GROUP BY task")
def error_pivot(spark, sf_dir):
    r = results(spark, sf_dir)
    return r.groupBy("task").agg(*[F.count_if(F.col("outcome") == o).alias(o.lower().replace(" ", "_")) for o in NAMES], F.round(100.0 * F.count_if(F.col("outcome") == "RuntimeError") / F.count("*"), 6).alias("runtime_error_pct"))


@query("distinct_programs", "SELECT user_id AS task, count(DISTINCT trim(props)) FILTER (event_type <> 'signup') AS programs, count(DISTINCT props) FILTER (event_type = 'error') AS errors, round(count(DISTINCT trim(props)) FILTER (event_type <> 'signup')::double / count(*), 6) AS program_ratio FROM events GROUP BY 1")
def distinct_programs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    programs = F.countDistinct(F.when(F.col("event_type") != "signup", F.trim("props")))
    return e.groupBy(F.col("user_id").alias("task")).agg(programs.alias("programs"), F.countDistinct(F.when(F.col("event_type") == "error", F.col("props"))).alias("errors"), F.round(programs / F.count("*"), 6).alias("program_ratio"))


@query("solved_tasks", "SELECT user_id AS task, count(*) FILTER (event_type = 'purchase') AS correct FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase') > 0")
def solved_tasks(spark, sf_dir):
    return results(spark, sf_dir).groupBy("task").agg(F.count_if(F.col("outcome") == "Passed").alias("correct")).where("correct > 0")


@query("metric_means", "WITH t AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS correct, avg(value) AS value FROM events GROUP BY 1) SELECT * FROM (UNPIVOT (SELECT round(avg(total), 6) AS total_mean, round(avg(correct), 6) AS correct_mean, round(avg(value), 6) AS value_mean FROM t) ON total_mean, correct_mean, value_mean INTO NAME metric VALUE mean)")
def metric_means(spark, sf_dir):
    t = results(spark, sf_dir).groupBy("task").agg(F.count("*").cast("double").alias("total"), F.count_if(F.col("outcome") == "Passed").cast("double").alias("correct"), F.avg("value").alias("value"))
    means = t.agg(*[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in ("total", "correct", "value")])
    return means.unpivot([], ["total_mean", "correct_mean", "value_mean"], "metric", "mean")


CLASSES = "p AS (SELECT e.label AS target, (list_position(v, list_max(v)) - 1) % 8 AS predicted, vec_id FROM (SELECT label % 8 AS label, vec_id, embedding[1:8] AS v FROM embeddings) e)"


def classes(spark, sf_dir):
    """Vectors as classified rows: the target is the label, the prediction the largest of the first eight components."""
    v = F.slice("embedding", 1, 8)
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 8).alias("target"), stats.argmax(v).alias("predicted"))


@query("classification_micro", f"WITH {CLASSES} SELECT count(*) AS n, a AS accuracy, a AS precision, a AS recall, a AS f1 FROM (SELECT *, round(avg((target = predicted)::int) OVER () * 100, 6) AS a FROM p) GROUP BY a")
def classification_micro(spark, sf_dir):
    return rounded(stats.micro_scores(classes(spark, sf_dir), "target", "predicted"), "accuracy", "precision", "recall", "f1")


@query(
    "classification_per_class",
    f"""WITH {CLASSES}, l AS (SELECT target AS label FROM p UNION SELECT predicted FROM p),
        c AS (SELECT label, (SELECT count(*) FROM p WHERE predicted = label) AS predicted, (SELECT count(*) FROM p WHERE target = label) AS actual, (SELECT count(*) FROM p WHERE target = label AND predicted = label) AS hits FROM l),
        s AS (SELECT label::int AS label, predicted, CASE WHEN predicted = 0 THEN 0.0 ELSE hits::double / predicted END AS p, CASE WHEN actual = 0 THEN 0.0 ELSE hits::double / actual END AS r FROM c)
        SELECT label, predicted, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM s""",
)
def classification_per_class(spark, sf_dir):
    return rounded(stats.per_class(classes(spark, sf_dir), "target", "predicted"), "precision", "recall", "f1")


@query("classification_subsets", "SELECT toxic, count(*) AS n, a AS accuracy, a AS precision, a AS recall, a AS f1 FROM (SELECT toxic, round(avg((quality = 1 - toxic)::int) OVER (PARTITION BY toxic) * 100, 6) AS a FROM labels) GROUP BY toxic, a")
def classification_subsets(spark, sf_dir):
    l = table(spark, sf_dir, "labels").withColumn("guess", 1 - F.col("toxic"))
    return rounded(stats.micro_scores(l, "quality", "guess", ["toxic"]), "accuracy", "precision", "recall", "f1")


MEMBERS = "m AS (SELECT vec_id AS task, i AS member, list_transform(embedding[(i * 8 + 1)::int:(i * 8 + 8)::int], lambda x: x::double) AS s FROM embeddings, range(0, 8) t(i))"


def members(spark, sf_dir):
    """Vectors as tasks with eight ensemble members of eight choices."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("task"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, F.lit(8)))).alias("member", "scores"))


@query(
    "ensemble_vote",
    f"""WITH {MEMBERS}, v AS (SELECT task, list_position(s, list_max(s)) - 1 AS choice, list_max(s) AS top FROM m),
        c AS (SELECT task, choice, count(*) AS n, avg(top) AS a FROM v GROUP BY 1, 2),
        t AS (SELECT task, min(n) = max(n) AND count(*) = 8 AS tie FROM c GROUP BY task)
        SELECT task, choice::int AS choice FROM (SELECT c.*, row_number() OVER (PARTITION BY task ORDER BY CASE WHEN tie THEN 0 ELSE -n END, CASE WHEN tie THEN -a ELSE 0 END, choice) AS k FROM c JOIN t USING (task)) WHERE k = 1""",
)
def ensemble_vote(spark, sf_dir):
    return stats.ensemble_vote(members(spark, sf_dir), "task", "member", "scores", 8)


@query(
    "softmax_argmax",
    f"WITH {MEMBERS}, e AS (SELECT task, member, s, list_transform(s, lambda x: exp(x - list_max(s))) AS x FROM m) SELECT task, member::int AS member, (list_position(s, list_max(s)) - 1)::int AS choice, round(list_max(list_transform(x, lambda y: y / list_sum(x) * 100)), 4) AS top_pct FROM e",
)
def softmax_argmax(spark, sf_dir):
    return members(spark, sf_dir).select("task", "member", stats.argmax(F.col("scores")).alias("choice"), F.array_max(stats.softmax_percent(F.col("scores"))).alias("top_pct"))


@query(
    "zero_shot_subtract",
    f"WITH {MEMBERS}, z AS (SELECT task, s AS z FROM m WHERE member = 0), d AS (SELECT task, member, list_transform(list_zip(s, z), lambda p: p[1] - p[2]) AS d FROM m JOIN z USING (task)) SELECT task, member::int AS member, (list_position(d, list_max(d)) - 1)::int AS choice FROM d",
)
def zero_shot_subtract(spark, sf_dir):
    m = members(spark, sf_dir)
    zero = m.where("member = 0").select("task", F.col("scores").alias("zero")).dropDuplicates(["task"])
    return m.join(zero, "task").select("task", "member", stats.argmax(F.zip_with("scores", "zero", lambda a, b: a - b)).alias("choice"))


@query("vote_bincount", f"WITH {MEMBERS}, v AS (SELECT list_position(s, list_max(s)) - 1 AS choice FROM m) SELECT choice::int AS choice, count(*) AS n FROM v GROUP BY 1")
def vote_bincount(spark, sf_dir):
    return members(spark, sf_dir).groupBy(stats.argmax(F.col("scores")).alias("choice")).agg(F.count("*").alias("n"))


DRAW = "md5('{0}:' || doc_id::varchar)"


@query("exact_n_sample", f"SELECT doc_id FROM documents ORDER BY {DRAW.format(7)}, doc_id LIMIT 150")
def exact_n_sample(spark, sf_dir):
    return sampling.sample_n(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 150, 7)


@query("train_val_split", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {DRAW.format(3)}, doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= least(500, floor(0.1 * n)) THEN 'val' ELSE 'train' END AS split FROM r")
def train_val_split(spark, sf_dir):
    return sampling.train_val_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", max_val=500, seed=3)


@query("positional_split", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents) SELECT doc_id, CASE WHEN k <= 10 THEN 'few_shot' WHEN k <= 60 THEN 'test' WHEN k <= 150 THEN 'train' ELSE 'validation' END AS split FROM r")
def positional_split(spark, sf_dir):
    return sampling.positional_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 10, 50, 90)


@query("prefer_fallback", f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang <> 'en', {DRAW.format(0)}, doc_id) AS k FROM documents) WHERE k = 1")
def prefer_fallback(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("lang") != "en").alias("other"))
    return sampling.prefer_one(d, "source", "other", "doc_id").select("source", "doc_id")


@query("resplit_union", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {DRAW.format(5)}, doc_id) AS k FROM documents) SELECT doc_id, CASE WHEN k <= 100 THEN 'val' ELSE 'train' END AS split FROM r")
def resplit_union(spark, sf_dir):
    s = sampling.train_val_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", max_val=500, seed=3)
    train, val = sampling.resplit(s.where("split = 'train'").drop("split"), s.where("split = 'val'").drop("split"), "doc_id", 100, 5)
    return train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))


@query("latest_per_group", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_group(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return sampling.latest(e, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("longest_n", "SELECT doc_id, length(text)::bigint AS n FROM documents ORDER BY length(text) DESC, doc_id LIMIT 50")
def longest_n(spark, sf_dir):
    return sampling.longest(table(spark, sf_dir, "documents"), "text", "doc_id", 50).select("doc_id", F.length("text").cast("long").alias("n"))


@query("slice_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 90 OFFSET 90")
def slice_rows(spark, sf_dir):
    return filters.rows_between(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], 90, 180)


@query(
    "char_budget",
    """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations),
       c AS (SELECT conv_id, turn, coalesce(min(CASE WHEN length(x) > 120 THEN i END), count(*) + 1) - 1 AS kept FROM l GROUP BY 1, 2) SELECT conv_id, turn, kept::bigint AS kept FROM c""",
)
def char_budget(spark, sf_dir):
    """Lines of each turn before the first of more than 120 characters."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(sampling.until_too_long(F.split("text", "\n"), 120)).cast("long").alias("kept"))


@query("ensemble_batches", "SELECT vec_id, len(embedding) // 24 AS batches, round(list_sum(list_transform(embedding[25:48], lambda x: x::double)), 6) AS second FROM embeddings")
def ensemble_batches(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    b = sampling.batches(F.col("embedding").cast("array<double>").cast("array<string>"), 24, True)
    total = F.aggregate(F.element_at(b, 2), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return e.select("vec_id", F.size(b).cast("long").alias("batches"), F.round(total, 6).alias("second"))


@query("minmax_highlight", "SELECT event_id, CASE WHEN value = max(value) OVER () THEN 'max' ELSE 'min' END AS mark FROM events QUALIFY value = max(value) OVER () OR value = min(value) OVER ()")
def minmax_highlight(spark, sf_dir):
    """Rows that hold the largest or smallest value; the bounds are one aggregated row."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    bounds = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.crossJoin(F.broadcast(bounds)).where("value = lo or value = hi").select("event_id", F.when(F.col("value") == F.col("hi"), "max").otherwise("min").alias("mark"))


@query("cube_rollup", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::bigint AS level, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query(
    "asof_join",
    "SELECT p.event_id, v.event_id AS before_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p JOIN LATERAL (SELECT max(struct_pack(ts := e.ts, event_id := e.event_id)) AS m FROM events e WHERE e.event_type = 'view' AND e.user_id = p.user_id AND e.ts < p.ts) x ON true JOIN events v ON v.event_id = x.m.event_id",
)
def asof_join(spark, sf_dir):
    """Each purchase with the user's latest view before it, by one window over both kinds."""
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'view')")
    before = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    view = F.max(F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))).over(before)
    return e.withColumn("v", view).where("event_type = 'purchase' and v is not null").select("event_id", F.col("v.event_id").alias("before_id"))
