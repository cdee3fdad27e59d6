"""Queries of text functions, training samples, packing, boolean tests, maps and streams, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import code, html_blocks, maps
from tessera.functions import strings as S
from tessera.operators import boolean_tests, experiments, packing
from tessera.registry import Catalogue, metrics, transforms
from tessera.session import table
from tessera.streaming import events as streams

catalogue = Catalogue()
query = catalogue.query


@query(
    "scalar_strings",
    """SELECT doc_id, upper(lang) AS up, replace(text, chr(13), '') = text AS no_returns, string_split(text, '# Solution')[1] = text AS no_marker, length(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)))::bigint AS clean_chars,
       length(text)::bigint + 1 + length(text) - length(replace(text, chr(10), '')) AS tabbed_chars, contains(text, 'the') AND contains(text, 'on') AS has_both FROM documents""",
)
def scalar_strings(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.upper("lang").alias("up"), (S.without_returns(t) == t).alias("no_returns"), (S.before_marker(t) == t).alias("no_marker"), F.length(S.clean_lines(t)).cast("long").alias("clean_chars"),
        F.length(F.concat(F.lit("\t"), F.replace(t, F.lit("\n"), F.lit("\n\t")))).cast("long").alias("tabbed_chars"), S.contains_all(t, "the", "on").alias("has_both"),
    )


@query("ordinals", "SELECT DISTINCT p_size::bigint AS n, p_size::varchar || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'TH' WHEN p_size % 10 = 1 THEN 'ST' WHEN p_size % 10 = 2 THEN 'ND' WHEN p_size % 10 = 3 THEN 'RD' ELSE 'TH' END AS ordinal FROM part")
def ordinals(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("n"), S.ordinal(F.col("p_size")).alias("ordinal")).distinct()


@query("comment_wrap", "SELECT conv_id, turn, md5('\"\"\"' || chr(10) || text || chr(10) || '\"\"\"') AS block, md5('# ' || replace(text, chr(10), chr(10) || '# ')) AS line FROM conversations")
def comment_wrap(spark, sf_dir):
    d = lambda c: F.md5(c.cast("binary"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", d(S.comment(F.col("text"), "BLOCK")).alias("block"), d(S.comment(F.col("text"), "LINE")).alias("line"))


@query("prompt_render", "SELECT p_partkey, 'Is ' || p_name || ' > ' || p_size::varchar || '?' || chr(10) || 'Tags: ' || lower(p_type) || ', ' || p_brand AS prompt FROM part")
def prompt_render(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    statement = S.filled("Is __input__ __op__ __output__?\nTags: ", input=F.col("p_name"), op=F.lit(">"), output=F.col("p_size").cast("string"))
    return p.select("p_partkey", F.concat(statement, F.array_join(F.array(F.lower("p_type"), "p_brand"), ", ")).alias("prompt"))


@query("regex_blocks", r"SELECT doc_id, length(rtrim(regexp_extract('x' || chr(10) || text, '(?s)^(.*?)(?:\nclass|\ndef|\n#|\n@|\nprint|\nif|$)', 1), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))::bigint AS n FROM documents")
def regex_blocks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(S.first_block(F.concat(F.lit("x\n"), "text"))).cast("long").alias("n"))


@query("translit")
def translit(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.ascii_text("text").cast("binary")).alias("digest"))


@query("date_formats", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y') AS year FROM orders")
def date_formats(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.date_text(F.col("o_orderdate"), "%Y-%m").alias("month"), S.date_text(F.col("o_orderdate"), "%Y").alias("year"))


@query("json_props", "SELECT event_id, (props->>'$.k')::bigint AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("map_invert", "SELECT event_id, props->>'$.k' || '=k' AS inverted FROM events")
def map_invert(spark, sf_dir):
    m = maps.inverted(F.from_json("props", "map<string,string>"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("inverted"))


@query("flatten_merge", "SELECT p_partkey, 'brand.name=' || p_brand || ',brand.type=' || p_type || ',size=0,steps=3' AS config, 'size' AS conflict FROM part")
def flatten_merge(spark, sf_dir):
    """A nested record flattened and merged with another one that wins, and the keys in conflict."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.struct(F.col("p_brand").alias("name"), F.col("p_type").alias("type")).alias("brand"), F.col("p_size").alias("size")).alias("r"))
    m = maps.flat(F.col("r"), p.schema["r"].dataType)
    over = F.create_map(F.lit("size"), F.lit("0"), F.lit("steps"), F.lit("3"))
    text = F.array_join(F.array_sort(F.transform(F.map_entries(maps.merged_right(m, over)), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return p.select("p_partkey", text.alias("config"), F.array_join(maps.conflicting_keys(m, over), ",").alias("conflict"))


@query("html_blocks")
def html_blocks_query(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", html_blocks.html_blocks("html").alias("b"))
    return p.select("page_id", F.size("b").alias("blocks"), F.length(html_blocks.blocks_text(F.col("b"))).alias("chars"))


@query("html_sections")
def html_sections_query(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(html_blocks.html_sections("html")).alias("s"))
    return p.select("page_id", "s.*")


@query(
    "sample_rows",
    """WITH c AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS q FROM conversations)
       SELECT a.conv_id, a.turn, '# ' || replace(u.text, chr(10), chr(10) || '# ') AS input, a.text AS labels FROM c a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.q WHERE a.role = 'assistant'""",
)
def sample_rows(spark, sf_dir):
    """Training samples: the question as line comments, the answer as labels."""
    c = table(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    q = F.max(F.when(F.col("role") == "user", F.struct("turn", "text"))).over(before)
    return c.withColumn("q", q).where("role = 'assistant' and q is not null").select("conv_id", "turn", S.comment(F.col("q.text"), "LINE").alias("input"), F.col("text").alias("labels"))


WORDS = r"string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' ')"


@query("token_counts", f"SELECT sum(len({WORDS.format('text')}))::bigint AS text_tokens, sum(len({WORDS.format('source')}))::bigint AS source_tokens, count(*) AS instances, sum(len({WORDS.format('text')}) + len({WORDS.format('source')}))::bigint AS total FROM documents")
def token_counts(spark, sf_dir):
    return packing.token_totals(table(spark, sf_dir, "documents"), "text", "source")


@query(
    "sequence_packing",
    f"""WITH w AS (SELECT doc_id, unnest({WORDS.format('text')}) AS w, generate_subscripts({WORDS.format('text')}, 1) AS i FROM documents), n AS (SELECT w, row_number() OVER (ORDER BY doc_id, i) - 1 AS p FROM w)
        SELECT p // 512 AS block, md5(string_agg(w, ' ' ORDER BY p)) AS digest FROM n GROUP BY 1 HAVING count(*) = 512""",
)
def sequence_packing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", packing.whitespace_tokens(F.col("text")).alias("tokens"))
    return packing.packed(d, "doc_id", "tokens", 512).select("block", F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


@query("pack_with_padding", f"WITH w AS (SELECT conv_id, turn, len({WORDS.format('text')}) AS n FROM conversations WHERE trim(text) <> '') SELECT conv_id, turn, ceil(n / 64)::bigint AS blocks, n::bigint AS kept FROM w")
def pack_with_padding(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("trim(text) <> ''").select("conv_id", "turn", packing.whitespace_tokens(F.col("text")).alias("t"))
    blocks, masks = packing.padded(F.col("t"), 64, "<pad>")
    kept = F.aggregate(F.flatten(masks), F.lit(0).cast("long"), lambda a, x: a + x)
    return c.select("conv_id", "turn", F.size(F.filter(blocks, lambda b: F.size(b) == 64)).cast("long").alias("blocks"), kept.alias("kept"))


@query("expected_length", f"SELECT floor((sum(len({WORDS.format('text')})) + count(*) * 2) / 512)::bigint AS blocks FROM documents")
def expected_length(spark, sf_dir):
    t = packing.token_totals(table(spark, sf_dir, "documents"), "text")
    return t.select(packing.expected_blocks(F.col("text_tokens"), F.col("instances"), 1, 512).alias("blocks"))


@query(
    "rank_shards",
    """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () AS n FROM documents),
       a AS (SELECT doc_id, o FROM d UNION ALL SELECT doc_id, o + n FROM d WHERE n % 48 <> 0 AND o < 48 - n % 48)
       SELECT ((o // 16) % 3)::int AS rank, (o // 16) // 3 AS batch, (o % 16)::int AS place, doc_id FROM a""",
)
def rank_shards(spark, sf_dir):
    return packing.rank_shards(table(spark, sf_dir, "documents"), "doc_id", 16, 3)


def order_tests(spark, sf_dir):
    """Items as assertions: an order is a program, a part an input, a supplier an output."""
    i = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).cast("long")
    op = F.when(F.col("l_returnflag") == "R", "==").when(F.col("l_returnflag") == "A", "<").otherwise("in")
    return i.select(F.col("l_orderkey").alias("program"), pos.alias("pos"), (F.col("l_partkey") % 7).cast("string").alias("input"), op.alias("op"), (F.col("l_suppkey") % 5).cast("string").alias("output"))


TESTS = """i AS (SELECT l_orderkey AS program, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, (l_partkey % 7)::varchar AS input,
      CASE l_returnflag WHEN 'R' THEN '==' WHEN 'A' THEN '<' ELSE 'in' END AS op, (l_suppkey % 5)::varchar AS output FROM lineitem),
    x AS (SELECT a.program, a.input, a.op, b.output, a.pos AS i, b.pos AS j, a.output = b.output AS truth FROM i a JOIN i b ON a.program = b.program),
    t AS (SELECT program, input, op, output, min([i, j, truth::bigint]) AS spot FROM x GROUP BY ALL),
    o AS (SELECT program, input, op, output, spot[1] AS i, spot[2] AS j, CASE WHEN spot[3] = 1 THEN 'True' ELSE 'False' END AS result, spot[1] = spot[2] AS is_original, program::varchar || '_' || spot[1]::varchar || '_' || spot[2]::varchar AS task_id FROM t)"""


@query("self_cross_pairs", f"WITH {TESTS} SELECT program, input, op, output, result, i, j FROM o")
def self_cross_pairs(spark, sf_dir):
    return boolean_tests.crossed(order_tests(spark, sf_dir)).select("program", "input", "op", "output", "result", "i", "j")


@query(
    "negation_pairs",
    f"""WITH {TESTS}, n AS (SELECT program, input, CASE op WHEN '==' THEN '!=' WHEN '<' THEN '>=' ELSE 'not in' END AS op, output, CASE result WHEN 'True' THEN 'False' ELSE 'True' END AS result, task_id || '_neg' AS task_id, task_id AS is_negation_of FROM o)
        SELECT task_id, op, result, is_negation_of FROM (SELECT program, input, op, output, result, task_id, NULL AS is_negation_of FROM o UNION ALL SELECT program, input, op, output, result, task_id, is_negation_of FROM n)""",
)
def negation_pairs(spark, sf_dir):
    return boolean_tests.with_negations(boolean_tests.crossed(order_tests(spark, sf_dir))).select("task_id", "op", "result", "is_negation_of")


@query(
    "balanced_select",
    f"""WITH {TESTS}, c AS (SELECT program, count(*) FILTER (result = 'True') AS t, count(*) FILTER (result = 'False') AS f FROM o GROUP BY 1 HAVING t > 0 AND f > 0),
        k AS (SELECT o.*, t, f FROM o JOIN c USING (program)),
        h AS (SELECT *, input IN (SELECT input FROM k y WHERE y.program = k.program AND y.result = 'True') AND row_number() OVER (PARTITION BY program, input ORDER BY md5('0:' || task_id), task_id) = 1 AS one FROM k WHERE result = 'False'),
        g AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY one DESC, md5('0:' || task_id), task_id) AS n FROM h)
        SELECT task_id, result FROM k WHERE result = 'True' UNION ALL SELECT task_id, result FROM g WHERE n <= greatest(least(f, t), 1)""",
)
def balanced_select(spark, sf_dir):
    tests = boolean_tests.crossed(order_tests(spark, sf_dir)).withColumns({"task_id": F.concat_ws("_", "program", "i", "j"), "is_generated": F.lit(False)})
    return boolean_tests.balanced(tests).select("task_id", "result")


#: Turns of true and false tests, and the state after each of the 2 * n steps of the two passes.
CONTEXT = """k AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY nth, result DESC) AS k, count(*) OVER (PARTITION BY program) AS n
             FROM (SELECT *, row_number() OVER (PARTITION BY program, result ORDER BY i, j) AS nth FROM o)),
    g(program, s, n, t, f, seen, taken) AS (
        SELECT DISTINCT program, 0::bigint, n, 2, 2, []::varchar[], []::bigint[] FROM k
        UNION ALL
        SELECT program, s + 1, n, t - (take AND result = 'True')::int, f - (take AND result = 'False')::int, CASE WHEN take THEN seen || [input] ELSE seen END, CASE WHEN take THEN taken || [k] ELSE taken END
        FROM (SELECT g.program, g.s, g.n, g.t, g.f, g.seen, g.taken, k.k, k.input, k.result,
                     CASE k.result WHEN 'True' THEN t > 0 ELSE f > 0 END AND NOT list_contains(taken, k.k) AND (s >= g.n OR NOT list_contains(seen, k.input)) AS take
              FROM g JOIN k ON k.program = g.program AND k.k = g.s % g.n + 1 WHERE g.s < 2 * g.n AND g.t + g.f > 0)),
    c AS (SELECT program, unnest(taken) AS k, generate_subscripts(taken, 1) AS rank FROM (SELECT program, arg_max(taken, s) AS taken FROM g GROUP BY program)),
    chosen AS (SELECT c.program, c.rank, k.i, k.j, k.input, k.result FROM c JOIN k USING (program, k))"""


def context_pool(spark, sf_dir):
    return boolean_tests.crossed(order_tests(spark, sf_dir)).select("program", F.struct("i", "j").alias("pos"), "input", "result")


@query("greedy_context", f"WITH RECURSIVE {TESTS}, {CONTEXT} SELECT * FROM chosen")
def greedy_context(spark, sf_dir):
    chosen = boolean_tests.greedy_context(context_pool(spark, sf_dir), true_quota=2, false_quota=2)
    return chosen.select("program", "rank", "pos.i", "pos.j", "input", "result")


@query("numbered_tests", f"WITH {TESTS} SELECT task_id, row_number() OVER (PARTITION BY program ORDER BY result DESC, i, j) - 1 AS pred_idx FROM o")
def numbered_tests(spark, sf_dir):
    """True tests before false ones, with their running index."""
    tests = boolean_tests.numbered(boolean_tests.crossed(order_tests(spark, sf_dir)))
    return tests.select(F.concat_ws("_", "program", "i", "j").alias("task_id"), F.col("pred_idx").cast("long").alias("pred_idx"))


@query(
    "fixed_tests",
    f"""WITH {TESTS}, m AS (SELECT program, input || ' ' || op || ' ' || output AS statement, count(*) AS times FROM x GROUP BY ALL)
        SELECT task_id, CASE WHEN i = 1 AND j = 2 AND times = 1 THEN CASE result WHEN 'True' THEN 'False' ELSE 'True' END ELSE result END AS result, i = 1 AND j = 2 AND times = 1 AS is_manual_fix
        FROM o JOIN m ON m.program = o.program AND m.statement = o.input || ' ' || o.op || ' ' || o.output WHERE NOT (i = 2 AND j = 1)""",
)
def fixed_tests(spark, sf_dir):
    """Programs of which one statement is excluded and another one's result is flipped by hand."""
    pairs = order_tests(spark, sf_dir)
    plain = boolean_tests.crossed(pairs).withColumn("statement", F.concat_ws(" ", "input", "op", "output"))
    left = pairs.select("program", F.concat_ws(" ", "input", "op").alias("left"))
    times = left.join(pairs.select("program", "output"), "program").groupBy("program", F.concat_ws(" ", "left", "output").alias("statement")).agg(F.count("*").alias("times"))
    fixes = plain.where("i = 1 and j = 2").join(times.where("times = 1"), ["program", "statement"], "left_semi").select("program", "statement")
    tests = boolean_tests.crossed(pairs, excluded=plain.where("i = 2 and j = 1").select("program", "statement"), fixes=fixes)
    return tests.select(F.concat_ws("_", "program", "i", "j").alias("task_id"), "result", "is_manual_fix")


@query(
    "ablation_product",
    """SELECT 'base.' || p || '.' || q AS name, s AS step, 'model=' || CASE WHEN q = 'big' THEN 'xl' ELSE 'small' END || ',rate=' || CASE WHEN p = 'fast' THEN '0.1' WHEN s = 'tune' THEN '0.01' ELSE '0.001' END AS config
       FROM (VALUES ('fast'), ('plain')) a(p), (VALUES ('big'), ('small')) b(q), (VALUES ('train'), ('tune')) c(s)""",
)
def ablation_product(spark, sf_dir):
    frame = lambda rows, names: spark.createDataFrame(rows, f"{names} string, config map<string,string>")
    card = frame([("base", {"model": "small", "rate": "0.001"})], "name")
    steps = frame([("train", {}), ("tune", {"rate": "0.01"})], "step")
    out = experiments.ablation_product(card, steps, [frame([("fast", {"rate": "0.1"}), ("plain", {})], "choice"), frame([("big", {"model": "xl"}), ("small", {})], "choice")])
    return out.select("name", "step", F.array_join(F.array_sort(F.transform(F.map_entries("config"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("config"))


def event_folder(spark, sf_dir):
    """The events file as a folder that a stream can read."""
    return f"{sf_dir}/event[s].parquet"


def streamed(spark, stream, name, mode="complete"):
    return streams.run_to_table(stream, name, mode)


@query("stream_outcome_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_outcome_counts(spark, sf_dir):
    s = streams.event_stream(spark, event_folder(spark, sf_dir))
    return streamed(spark, s.groupBy("event_type").agg(F.count("*").alias("n")), "outcomes")


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    s = streams.tumbling(streams.event_stream(spark, event_folder(spark, sf_dir)), "1 day")
    return streamed(spark, s, "tumbling").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding", "SELECT b - INTERVAL (i) DAY AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS b FROM events) CROSS JOIN range(0, 2) r(i) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    s = streams.sliding(streams.event_stream(spark, event_folder(spark, sf_dir)), "2 days", "1 day")
    return streamed(spark, s, "sliding").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query(
    "batch_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
       s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def batch_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sessions(e, "6 hours").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
       s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark, sf_dir):
    s = streams.sessions(streams.event_stream(spark, event_folder(spark, sf_dir)), "6 hours")
    return streamed(spark, s, "sessions").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_dedupe", "SELECT count(DISTINCT event_id) AS n FROM events")
def stream_dedupe(spark, sf_dir):
    s = streams.deduplicated(streams.event_stream(spark, event_folder(spark, sf_dir)), late="30 days")
    return streamed(spark, s.select("event_id"), "dedupe", "append").agg(F.count("*").alias("n"))


@query("stream_pack", "SELECT user_id % 8 AS lane, unnest(range(count(*) // 64)) AS block, 64 AS n FROM events GROUP BY 1")
def stream_pack(spark, sf_dir):
    e = streams.event_stream(spark, event_folder(spark, sf_dir)).withColumn("lane", F.col("user_id") % 8)
    return streamed(spark, streams.packed_stream(e, "lane", "event_type", 64), "packed", "append").select("lane", "block", F.size("tokens").alias("n"))


@transforms.register("trimmed_text")
def trimmed_text(df):
    return df.withColumn("text", F.trim("text"))


@transforms.register("with_words")
def with_words(df):
    return df.withColumn("words", F.size(packing.whitespace_tokens(F.col("text"))).cast("long"))


@metrics.register("exact_match")
def exact_match(prediction, target):
    return F.avg((F.trim(prediction) == F.trim(target)).cast("double")) * 100


@query("udf_surface", f"SELECT lang, sum(len({WORDS.format('trim(text)')}))::bigint AS words, round(avg((trim(text) = trim(lower(text)))::int) * 100, 6) AS exact FROM documents GROUP BY lang")
def udf_surface(spark, sf_dir):
    from tessera.registry import chain

    d = chain(table(spark, sf_dir, "documents"), "trimmed_text", "with_words")
    return d.groupBy("lang").agg(F.sum("words").alias("words"), F.round(metrics["exact_match"](F.lower("text"), F.col("text")), 6).alias("exact"))


@query(
    "bleu_by_lang",
    f"""WITH h AS (SELECT doc_id, lang, w[1:len(w) // 2] AS t, w[len(w) // 2 + 1:] AS p FROM (SELECT doc_id, lang, {WORDS.format('text')} AS w FROM documents)),
        s AS (SELECT doc_id, lang, n, side, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram
              FROM (SELECT doc_id, lang, 't' AS side, t AS w FROM h UNION ALL SELECT doc_id, lang, 'p', p FROM h), (SELECT unnest([1, 2, 3, 4]) AS n)),
        c AS (SELECT doc_id, lang, n, gram, count(*) FILTER (side = 't') AS t, count(*) FILTER (side = 'p') AS p FROM s GROUP BY ALL),
        m AS (SELECT lang, n, sum(least(t, p)) AS hits, sum(p) AS all_ FROM c GROUP BY ALL),
        z AS (SELECT lang, sum(len(p)) AS c, sum(len(t)) AS r FROM h GROUP BY 1)
        SELECT lang, round(CASE WHEN min(hits) > 0 THEN 100 * exp(avg(ln(hits / all_)) + least(0, 1 - any_value(r) / any_value(c))) ELSE 0 END, 6) AS bleu, any_value(c)::bigint AS words FROM m JOIN z USING (lang) GROUP BY lang""",
)
def bleu_by_lang(spark, sf_dir):
    """BLEU of each document's second half of words against its first."""
    from tessera.functions.bleu import corpus_bleu

    w = packing.whitespace_tokens(F.col("text"))
    half = F.floor(F.size(w) / 2).cast("int")
    d = table(spark, sf_dir, "documents").select("lang", F.array_join(F.slice(w, F.lit(1), half), " ").alias("target"), F.array_join(F.slice(w, half + 1, F.size(w)), " ").alias("prediction"))
    return corpus_bleu(d, "prediction", "target", ["lang"]).withColumn("bleu", F.round("bleu", 6))


@query("code_screen")
def code_screen(spark, sf_dir):
    """Which turns are valid programs, and what assertions and statistics they have."""
    c = table(spark, sf_dir, "conversations")
    stats = code.code_stats("text")
    return c.select("conv_id", "turn", code.is_valid("text").alias("valid"), F.size(code.io_pairs("text")).alias("pairs"), stats["lines"].alias("lines"), F.size(code.snippets("text")).alias("snippets"))
