"""Queries of training samples, prompts, tasks, benchmarks and their reports, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import maps, templates
from tessera.functions import strings as S
from tessera.operators import boolean_tests, experiments, filters, packing, posts, programs, samples, sampling, stats
from tessera.plans.texts import CONTEXT, TESTS, context_pool, order_tests
from tessera.registry import Catalogue, Task, metrics, prompts, run_task, tasks, transforms
from tessera.session import table

catalogue = Catalogue()
query = catalogue.query

ANSWERS = """a AS (SELECT l_orderkey AS qid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos,
                  CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag || '-' || l_partkey END AS body, l_quantity::bigint - 15 AS score FROM lineitem),
    q AS (SELECT o_orderkey AS id, o_orderpriority AS question, CASE WHEN o_orderkey % 3 = 0 THEN 2 END AS acc FROM orders WHERE o_orderstatus <> 'P')"""


def answered(spark, sf_dir):
    """Orders as questions, without body if their status is P, and their parts as answers, empty if returned as A."""
    i = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    body = F.when(F.col("l_returnflag") == "A", "").otherwise(F.concat_ws("-", "l_returnflag", "l_partkey"))
    answers = i.select(F.col("l_orderkey").alias("parent_id"), pos.alias("line"), pos.cast("string").alias("id"), body.alias("body"), (F.col("l_quantity").cast("long") - 15).alias("score"), F.lit("2020-01-02").alias("date"))
    body = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority"))
    questions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), body.alias("body"), F.when(F.col("o_orderkey") % 3 == 0, "2").alias("accepted_answer"))
    return posts.align_answers(questions, answers)


def quality_prompt(given):
    return F.concat(F.lit("Quality: "), given["quality"], F.lit("\n"), F.coalesce(given["context"], F.lit("")))


REPEATED = f"""WITH {ANSWERS},
    r AS (SELECT a.*, question, acc, row_number() OVER (PARTITION BY qid ORDER BY coalesce(pos = acc, false) DESC, score DESC, pos) AS place, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) = 1 AS top FROM a JOIN q ON qid = id),
    k AS (SELECT *, coalesce(pos = acc, false) OR (top AND acc IS NULL AND score >= 0) AS best, row_number() OVER (PARTITION BY qid ORDER BY place) - 1 AS part FROM r WHERE body <> '')
    SELECT qid AS id, part::int AS part, 'Quality: ' || {{label}} || CASE WHEN part = 0 THEN chr(10) || question ELSE '' END AS input, body AS labels FROM k"""


@query("repeated_samples", REPEATED.format(label="CASE WHEN best THEN 'BEST' WHEN score >= 12 THEN 'GREAT' WHEN score >= 3 THEN 'GOOD' WHEN score <= -1 THEN 'BAD' ELSE 'OK' END"))
def repeated_samples(spark, sf_dir):
    """A sample for each answer, the body in the first one only, with labels by score."""
    return samples.training_samples(answered(spark, sf_dir), quality_prompt)


@query("relative_samples", REPEATED.format(label="CASE WHEN best THEN 'BEST' ELSE place::varchar || CASE WHEN place % 100 BETWEEN 11 AND 13 THEN 'TH' WHEN place % 10 = 1 THEN 'ST' WHEN place % 10 = 2 THEN 'ND' WHEN place % 10 = 3 THEN 'RD' ELSE 'TH' END END"))
def relative_samples(spark, sf_dir):
    """The same with labels by rank."""
    return samples.training_samples(answered(spark, sf_dir), quality_prompt, samples.SampleRules(relative=True))


@query(
    "joined_samples",
    f"""WITH {ANSWERS}, r AS (SELECT a.*, row_number() OVER (PARTITION BY qid ORDER BY score, pos) AS place FROM a),
        j AS (SELECT qid, string_agg(CASE WHEN body = '' THEN 'none' ELSE body END, chr(10) ORDER BY place) AS labels FROM r WHERE place <= 2 GROUP BY qid)
        SELECT id, 0 AS part, 'Quality: BEST' || chr(10) || question AS input, coalesce(labels, 'none') AS labels FROM q LEFT JOIN j ON qid = id""",
)
def joined_samples(spark, sf_dir):
    """One sample for each question: its two worst answers, or a text that says there is none."""
    rules = samples.SampleRules(sorting="ascending", answers_per_sample=2, repeat_prompt=False, allow_no_answer=True, no_answer="none")
    return samples.training_samples(answered(spark, sf_dir), quality_prompt, rules)


@query(
    "tagged_answers",
    """WITH q AS (SELECT o_orderkey AS id, o_orderpriority AS tag FROM orders WHERE o_orderstatus <> 'F'), a AS (SELECT CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_orderkey END AS parent FROM lineitem),
       r AS (SELECT coalesce(tag, CASE WHEN parent IS NULL THEN 'NO_PARENT' ELSE 'NO_QUESTION' END) AS tag FROM a LEFT JOIN q ON id = parent) SELECT tag, count(*) AS n FROM r GROUP BY 1""",
)
def tagged_answers(spark, sf_dir):
    """Answers by the tag of their question, and those that failed to find one, by reason."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    none = F.lit(None).cast("string")
    questions = posts.overview(o.select(F.col("o_orderkey").alias("id"), F.array("o_orderpriority").alias("tags"), F.lit(0).alias("score"), F.lit(0).alias("views"), F.lit(0).alias("answer_count"), none.alias("accepted_answer")))
    answers = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") != "A", F.col("l_orderkey")).alias("parent_id"))
    good, failed = posts.tagged_answers(answers, questions)
    return good.groupBy(F.col("tag_to_use").alias("tag")).agg(F.count("*").alias("n")).union(failed)


@query("passed_posts", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND length(text) >= 100 AND NOT (lang = 'en' AND source = 'src0')")
def passed_posts(spark, sf_dir):
    """Questions and answers that passed all checks."""
    from tessera.plans.posts import statuses

    return posts.passed(statuses(spark, sf_dir)).select("doc_id")


prompts.register("part")({"template": "{% if p_size == 1 %}one{% elif big %}{{ p_brand | upper }}{% else %}{{ p_brand }}{% endif %}: {{ input_sequence | trim }}"})
prompts.register("listed")({"template": "{%- for word in words -%}\n{{ loop.index ~ '. ' ~ word }}{% if not loop.last %}, {% endif %}\n{%- endfor %} ({{ input_sequence ~ mark }})", "params": {"mark": "?"}})


@query(
    "prompt_pipe",
    """SELECT p_partkey, list_reduce(list_transform(string_split(p_name, ' '), lambda w, i: i::varchar || '. ' || w), lambda a, b: a || ', ' || b) || ' (' ||
              CASE WHEN p_size = 1 THEN 'one' WHEN p_size > 25 THEN upper(p_brand) ELSE p_brand END || ': ' || trim(p_type) || '!)' AS input_sequence FROM part""",
)
def prompt_pipe(spark, sf_dir):
    """Two prompts in turn, with a condition, a loop, filters and a parameter."""
    p = table(spark, sf_dir, "part").withColumns({"input_sequence": F.col("p_type"), "big": F.col("p_size") > 25, "words": F.split("p_name", " ")})
    return templates.apply_prompts(p, [prompts["part"], prompts["listed"]], {"mark": "!"}).select("p_partkey", "input_sequence")


@transforms.register("add_prefix")
def add_prefix(df, column: str, prefix: str):
    return df.withColumn(column, F.concat(F.lit(prefix), F.col(column)))


@transforms.register("upper_text")
def upper_text(df, column: str):
    return df.withColumn(column, F.upper(column))


@metrics.register("exact_share")
def exact_share(prediction, target):
    return F.avg(F.coalesce(prediction == target, F.lit(False)).cast("double")) * 100


tasks.register("parts")(Task(load=lambda df: df.select("p_partkey", F.col("p_name").alias("input_sequence"), F.col("p_type").alias("target")), pre=(("add_prefix", {"column": "input_sequence", "prefix": "b:"}),), post=(("upper_text", {"column": "target"}),), metrics=("exact_share",)))


@query("task_plugin", "SELECT p_partkey, 'm:b:a:' || p_name AS input_sequence, upper(p_type) AS target FROM part")
def task_plugin(spark, sf_dir):
    """A task's own processors among those of all tasks and of its model type; its postprocessors override all others."""
    step = lambda x: ("add_prefix", {"column": "input_sequence", "prefix": x})
    config = {"preprocessors": [step("a:")], "model_type": {"preprocessors": [step("m:")]}, "postprocessors": [step("never:")], "override_postprocessors": True}
    return run_task(table(spark, sf_dir, "part"), "parts", config)


EXACT = "CASE user_id % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' ELSE 'error' END"


@query("oracle_best_of", f"SELECT round(avg(hit) * 100, 6) AS exact, round(avg(best) * 100, 6) AS oracle_exact FROM (SELECT user_id, avg((event_type = {EXACT})::int) AS hit, max((event_type = {EXACT})::int) AS best FROM events GROUP BY 1)")
def oracle_best_of(spark, sf_dir):
    """Exact match of all predictions, and of each task's best one."""
    target = F.element_at(F.array(*map(F.lit, ("view", "click", "purchase", "error"))), (F.col("user_id") % 4 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", target.alias("target"))
    best = stats.oracle_best(e, "user_id", (F.col("event_type") == F.col("target")).cast("int"), "event_id")
    plain = e.groupBy("user_id").agg(metrics["exact_share"](F.col("event_type"), F.col("target")).alias("x")).agg(F.round(F.avg("x"), 6).alias("exact"))
    return plain.crossJoin(best.agg(F.round(metrics["exact_share"](F.col("event_type"), F.col("target")), 6).alias("oracle_exact")))


@query("valid_syntax_stats", "SELECT count(*) AS tasks, round(avg(s) * 100, 6) AS valid_syntax_pct_mean, count(*) FILTER (s = 1) AS all_valid, count(*) FILTER (s = 0) AS all_invalid FROM (SELECT user_id, avg((event_type <> 'error')::int) AS s FROM events GROUP BY 1)")
def valid_syntax_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("valid", F.col("event_type") != "error")
    return stats.syntax_stats(e, "user_id", "valid").withColumn("valid_syntax_pct_mean", F.round("valid_syntax_pct_mean", 6))


@query("ratio_report", "SELECT lang, count(*) FILTER (contains(text, 'the')) AS found, count(*) AS total, round(count(*) FILTER (contains(text, 'the')) / count(*) * 100, 6) AS pct FROM documents GROUP BY 1")
def ratio_report(spark, sf_dir):
    return stats.ratio_report(table(spark, sf_dir, "documents"), "lang", F.contains("text", F.lit("the"))).withColumn("pct", F.round("pct", 6))


@query("log_prob_gain", "SELECT vec_id, round(embedding[1]::double + embedding[4]::double - 0.5, 6) AS first, round(embedding[2]::double + embedding[3]::double + 0.25, 6) AS second FROM embeddings")
def log_prob_gain(spark, sf_dir):
    """Two choices of two tokens each: their log-probabilities less a zero-shot score."""
    e = F.col("embedding").cast("array<double>")
    scores = F.array(F.slice(e, 1, 2), F.slice(e, 3, 2))
    gain = stats.log_prob_gain(scores, F.array(F.array(F.lit(0), F.lit(1)), F.array(F.lit(1), F.lit(0))), F.array(F.lit(0.5), F.lit(-0.25)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(gain[0], 6).alias("first"), F.round(gain[1], 6).alias("second"))


CODE = "'import os' || chr(13) || chr(10) || '# Solution' || chr(10) || 'def f' || p_partkey || '(x):' || chr(10) || '    return x + ' || p_size"


def part_code():
    return F.concat(F.lit("import os\r\n# Solution\ndef f"), F.col("p_partkey").cast("string"), F.lit("(x):\n    return x + "), F.col("p_size").cast("string"))


@query(
    "code_strings",
    f"""SELECT p_partkey, replace(c, chr(13), '') AS plain, string_split(c, '# Solution')[1] AS before, 'Q' || 'import os' || chr(13) || chr(10) || '# Solution' || chr(10) || 'def ' AS prompt, 'f' || p_partkey || '(x):' || chr(10) || '    return x + ' || p_size AS target,
        CASE WHEN p_size > 25 THEN p_brand || ': ' || p_type ELSE p_brand END AS says, replace(p_name, ' ', '_') AS kind, 'f' || p_partkey AS function FROM (SELECT *, {CODE} AS c FROM part)""",
)
def code_strings(spark, sf_dir):
    """String functions on programs with carriage returns, markers and a function."""
    c = part_code()
    prompt, target = S.prompt_and_target(c, F.lit("Q"))
    says, _ = S.outcome_text(F.col("p_brand"), F.when(F.col("p_size") > 25, F.col("p_type")))
    calls = F.array(*(F.concat(F.lit(f"{before}f"), F.col("p_partkey").cast("string"), F.lit("(1)")) for before in ("", "len(", "not ")))
    return table(spark, sf_dir, "part").select("p_partkey", S.without_returns(c).alias("plain"), S.before_marker(c).alias("before"), prompt.alias("prompt"), target.alias("target"), says.alias("says"), S.outcome_text(F.col("p_name"), F.lit(None))[1].alias("kind"), S.function_name(calls).alias("function"))


def part_benchmark(spark, sf_dir):
    """Parts as rows of a benchmark; of every tenth size the test is a chained comparison."""
    p = table(spark, sf_dir, "part")
    call = F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit("(1)"))
    test = F.concat(F.lit("assert "), call, F.when(F.col("p_size") % 10 == 0, " < 99 == ").otherwise(" == "), (F.col("p_size") + 1).cast("string"))
    return p.select(F.col("p_name").alias("text"), part_code().alias("code"), F.col("p_partkey").alias("task_id"), F.lit("").alias("test_setup_code"), F.array(test).alias("test_list"), F.array().cast("array<string>").alias("challenge_test_list"))


@query(
    "benchmark_programs",
    """SELECT p_partkey::varchar AS task_id, 'f' || p_partkey AS function, p_name AS description, 'def f' || p_partkey || '(x):' || chr(10) || '    return x + ' || p_size AS code,
       'import os' || chr(10) || '# Solution' AS context, 'f' || p_partkey || '(1) == ' || (p_size + 1) AS tests FROM part WHERE p_size % 10 <> 0""",
)
def benchmark_programs(spark, sf_dir):
    """Benchmark rows in the one form of all programs."""
    good, _ = programs.normalised(part_benchmark(spark, sf_dir), "mbpp")
    tests = F.array_join(F.transform("input_output_pairs", lambda p: F.concat_ws(" ", p["input"], p["ops"], p["output"])), ",")
    return good.select("task_id", "function", "description", "code", "context", tests.alias("tests"))


@query("benchmark_quarantine", "SELECT p_partkey AS task_id, 'MBPP' AS task, 'chained comparison' AS exception FROM part WHERE p_size % 10 = 0")
def benchmark_quarantine(spark, sf_dir):
    """Rows that can't be read, with the reason."""
    return programs.normalised(part_benchmark(spark, sf_dir), "mbpp")[1].select("task_id", "task", "exception")


@query(
    "generated_by_function",
    """SELECT p_partkey::varchar AS task_id, 1 + count(g.k) AS tests, count(g.k) AS generated FROM part LEFT JOIN (SELECT p_partkey AS k FROM part, range(2) WHERE p_size > 40) g ON g.k = p_partkey WHERE p_size % 10 <> 0 GROUP BY 1""",
)
def generated_by_function(spark, sf_dir):
    """Generated tests join the program whose function all of their calls name."""
    good, _ = programs.normalised(part_benchmark(spark, sf_dir), "mbpp")
    large = table(spark, sf_dir, "part").where("p_size > 40")
    call = lambda x: F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(f"({x})"))
    made = large.select(F.concat(F.lit("group "), F.col("p_partkey").cast("string")).alias("name"), F.explode(F.array(call(2), call(3))).alias("input"), F.lit("==").alias("ops"), F.lit("0").alias("output"))
    tests = programs.attach_generated(good, made)
    size = lambda c: F.size(c).cast("long")
    return tests.select("task_id", size("input_output_pairs").alias("tests"), size(F.filter("input_output_pairs", lambda p: p["is_generated"])).alias("generated"))


@query("cast_key_join", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey::varchar = o_custkey::varchar")
def cast_key_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), "o_orderkey")
    return filters.join_as_text(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "key")


@query("side_by_side", "SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) c FULL JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier) s USING (n)")
def side_by_side(spark, sf_dir):
    """Two tables joined by place."""
    return packing.side_by_side(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")


@query("skipped_groups", "SELECT p_partkey FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#22') AND NOT contains(p_type, 'PRO')")
def skipped_groups(spark, sf_dir):
    """Rows of no listed brand and no marked group."""
    return filters.without_mark(filters.skip_listed(table(spark, sf_dir, "part"), "p_brand", "Brand#11", "Brand#22"), "p_type", "PRO").select("p_partkey")


@query("block_shuffle", "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents) SELECT doc_id, (o // 64) * 64 + row_number() OVER (PARTITION BY o // 64 ORDER BY md5('0:' || doc_id), doc_id) - 1 AS place FROM n")
def block_shuffle(spark, sf_dir):
    return packing.block_shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64)


@query("shuffled_packing", """WITH n AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents), s AS (SELECT source, row_number() OVER (ORDER BY o // 64, md5('0:' || doc_id), doc_id) - 1 AS p FROM n)
    SELECT p // 16 AS block, string_agg(source, ' ' ORDER BY p) AS tokens FROM s GROUP BY 1 HAVING count(*) = 16""")  # fmt: skip
def shuffled_packing(spark, sf_dir):
    """Packing of rows shuffled within blocks; a row's source is its one token."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array("source").alias("tokens"))
    return packing.packed_shuffled(d, "doc_id", "tokens", 16, 64).select("block", F.array_join("tokens", " ").alias("tokens"))


@query("worker_slices", "SELECT worker, count(*) AS n, sum(doc_id)::bigint AS ids FROM (SELECT doc_id, least((row_number() OVER (ORDER BY doc_id) - 1) % 100 // 33, 2)::int AS worker FROM documents) GROUP BY 1")
def worker_slices(spark, sf_dir):
    """Each buffer of 100 rows in slices for 3 workers."""
    d = packing.worker_slices(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 3)
    return d.groupBy("worker").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("budgeted_words", "SELECT p_partkey, CASE WHEN length(w[1]) > 9 THEN 0 WHEN len(w) = 1 OR length(w[1]) + length(w[2]) > 9 THEN 1 ELSE 2 END::int AS kept FROM (SELECT p_partkey, string_split(p_name, ' ')[1:2] AS w FROM part)")
def budgeted_words(spark, sf_dir):
    """How many of two words fit into nine characters."""
    words = F.slice(F.split("p_name", " "), 1, 2)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(sampling.within_budget(words, 9)).alias("kept"))


@query("sample_tap", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def sample_tap(spark, sf_dir):
    """The first rows, for a look at them."""
    return sampling.tap(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


@query("durations", "SELECT o_orderkey, (o_totalprice::bigint // 3600)::varchar || ':' || lpad((o_totalprice::bigint % 3600 // 60)::varchar, 2, '0') || ':' || lpad((o_totalprice::bigint % 60)::varchar, 2, '0') AS took FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def durations(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.duration_text(F.col("o_totalprice")).alias("took"))


@query("where_each", "SELECT p_partkey FROM part WHERE length(p_name) % 2 = 0 AND p_size > 3")
def where_each(spark, sf_dir):
    """Rows that a Python function keeps."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return filters.where_each(p, lambda r: len(r["p_name"]) % 2 == 0 and r["p_size"] > 3).select("p_partkey")


@query(
    "context_batches",
    f"""WITH RECURSIVE {TESTS}, {CONTEXT}, r AS (SELECT o.program, o.i, o.j, row_number() OVER (PARTITION BY o.program ORDER BY o.i, o.j) - 1 AS n FROM o ANTI JOIN chosen USING (program, i, j)),
        s AS (SELECT program, count(*) AS shown FROM chosen GROUP BY 1)
        SELECT program, (n // 5)::int AS batch, any_value(shown)::int AS shown, count(*)::int AS tests, string_agg(i::varchar || '-' || j::varchar, ',' ORDER BY i, j) AS places FROM r JOIN s USING (program) GROUP BY program, n // 5""",
)
def context_batches(spark, sf_dir):
    """Tests in batches of five, with their program's context."""
    tests = boolean_tests.crossed(order_tests(spark, sf_dir))
    context = boolean_tests.greedy_context(context_pool(spark, sf_dir), true_quota=2, false_quota=2)
    out = boolean_tests.with_contexts(tests, context, size=5)
    places = F.array_join(F.transform("tests", lambda t: F.concat_ws("-", t["at"]["i"], t["at"]["j"])), ",")
    return out.select("program", "batch", F.size("context").alias("shown"), F.size("tests").alias("tests"), places.alias("places"))


@query(
    "dump_statuses",
    """SELECT result, count(*) AS n, sum(score)::bigint AS score, sum(tags)::bigint AS tags FROM (
           SELECT CASE WHEN p_size % 7 = 0 THEN 'PARSE_FAIL' WHEN p_size > 45 THEN 'NOT_VALID_TYPE' WHEN p_size % 5 = 1 THEN 'NO_BODY' WHEN p_size % 2 = 1 AND p_size % 3 = 0 THEN 'NO_TITLE' ELSE 'PASS' END AS result,
                  CASE WHEN p_size % 7 <> 0 THEN p_size - 10 END AS score, CASE WHEN p_size % 7 <> 0 AND p_size % 2 = 1 AND p_size <= 45 THEN 2 ELSE 0 END AS tags FROM part) GROUP BY 1""",
)
def dump_statuses(spark, sf_dir):
    """Parts written as a dump of posts and read back: what became of each line."""
    from tessera.session import scratch
    from tessera.sources import posts_xml

    size = F.col("p_size")
    kind = F.when(size > 45, 17).when(size % 2 == 1, 1).otherwise(2)
    body, title = F.when(size % 5 == 1, "").otherwise(F.concat(F.lit("a &lt;b&gt; "), "p_name")), F.when(size % 3 == 0, "").otherwise(F.col("p_name"))
    line = F.concat(F.lit('  <row Id="'), F.col("p_partkey").cast("string"), F.lit('" PostTypeId="'), kind.cast("string"), F.lit('" Score="'), (size - 10).cast("string"), F.lit('" Body="'), body, F.lit('" Title="'), title, F.lit('" Tags="&lt;a&gt;&lt;b&gt;"'), F.when(size % 7 == 0, "").otherwise(" />"))
    path = scratch(spark, "dump")
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    read = posts_xml.read_posts(spark, path)
    return read.groupBy("result").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.sum(F.coalesce(F.size("tags"), F.lit(0))).cast("long").alias("tags"))


@query("jsonl_round_trip", "SELECT lang, count(*) AS n, sum(n_chars)::bigint AS chars FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1")
def jsonl_round_trip(spark, sf_dir):
    """Documents written as JSON lines by language and read back with a schema."""
    from tessera.session import scratch
    from tessera.sources import files

    path = scratch(spark, "by-lang")
    files.write_by(table(spark, sf_dir, "documents").where("lang in ('en', 'fr')").select("doc_id", "lang", "n_chars"), path, "lang")
    both = files.read_jsonl(spark, path, "doc_id bigint, n_chars bigint, lang string")
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "kept_answers",
    f"""WITH {ANSWERS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS place FROM a) SELECT qid, place::int AS place, body FROM r WHERE place <= 2 AND body <> ''""",
)
def kept_answers(spark, sf_dir):
    """The two best answers of each question, if they have a body."""
    a = answered(spark, sf_dir).select(F.col("id").alias("question_id"), F.explode("answers").alias("a")).select("question_id", "a.body", "a.score", F.col("a.line").alias("pos"))
    return posts.keep_first(posts.rank_answers(a), 2).select(F.col("question_id").alias("qid"), F.col("rank").alias("place"), "body")


@query("resolved_links", "SELECT p_partkey, 'https://h.example/' || CASE p_size % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'a/' || p_partkey ELSE 'a/b?' || p_partkey END AS url FROM part")
def resolved_links(spark, sf_dir):
    """Links resolved against the page that holds them."""
    key = F.col("p_partkey").cast("string")
    link = F.element_at(F.array(F.lit("/x"), key, F.concat(F.lit("?"), key)), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", S.joined_url("https://h.example/a/b")(link).alias("url"))


@query("public_props", "SELECT event_id, 'k=' || (props->>'$.k') || ',size=' || length(event_type) AS props FROM events")
def public_props(spark, sf_dir):
    """A record with one value set, without its private keys."""
    m = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("_hidden"), F.lit("1")))
    m = maps.public_keys(maps.with_value(m, "size", F.length("event_type").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("props"))


@query("stashed_columns", "SELECT p_partkey, upper(p_name) AS p_name, p_brand, p_size FROM part WHERE p_size > 30 OR p_type = 'PROMO'")
def stashed_columns(spark, sf_dir):
    """Columns put aside while others change, and any of two conditions."""
    p = filters.where_any(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_type"), F.col("p_size") > 30, F.col("p_type") == "PROMO")
    rest, aside = filters.stash(p.drop("p_type"), "p_partkey", ["p_brand", "p_size"])
    return rest.withColumn("p_name", F.upper("p_name")).join(aside, "p_partkey")


@query(
    "name_problems",
    """SELECT 'p' || n_nationkey AS name, 'repeated' AS problem FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'p' || n_nationkey, 'unknown' FROM nation WHERE n_nationkey < 20 AND n_nationkey % 2 = 1
       UNION ALL SELECT 'p' || n_nationkey, 'missing' FROM nation WHERE n_nationkey >= 20 AND n_nationkey % 2 = 0 AND n_nationkey % 5 <> 0""",
)
def name_problems(spark, sf_dir):
    """Names of runs that repeat, are missing, or were not asked for."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_nationkey").alias("k"))
    names = n.where("k < 20").select("name").union(n.where("k % 5 = 0").select("name")).union(n.where("k >= 20 and k % 5 = 0").select("name"))
    return experiments.missing_and_repeated(names, n.where("k % 2 = 0 or (k >= 20 and k % 5 = 0)").select("name"))
