"""Queries of question-and-answer posts and tags, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import strings as S
from tessera.operators import filters, posts, stats, tags
from tessera.registry import Catalogue
from tessera.session import table

catalogue = Catalogue()
query = catalogue.query


def part_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tagged posts: type and the words of the name are tags, the size is the score."""
    words = F.split("p_name", " ")
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.array(F.lower("p_type"), words[0], F.coalesce(F.try_element_at(words, F.lit(2)), words[0])).alias("tags"), F.col("p_size").cast("long").alias("score"), "p_brand")


PART = """t AS (SELECT p_partkey AS id, [lower(p_type), split_part(p_name, ' ', 1), CASE WHEN split_part(p_name, ' ', 2) = '' THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) END] AS tags, p_size::bigint AS score, p_brand FROM part)"""


@query(
    "qa_align_rank_quality",
    """WITH c AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question_id FROM conversations),
       a AS (SELECT conv_id, question_id, turn, length(text)::bigint AS score FROM c WHERE role = 'assistant' AND question_id IS NOT NULL),
       r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, question_id ORDER BY score DESC, turn) AS rank FROM a)
       SELECT conv_id, question_id, turn, score, rank::int AS rank,
              CASE WHEN rank = 1 THEN 'BEST' WHEN score >= 600 THEN 'GREAT' WHEN score >= 200 THEN 'GOOD' WHEN score <= 50 THEN 'BAD' ELSE 'OK' END AS label
       FROM r""",
)
def qa_align_rank_quality(spark, sf_dir):
    """Assistant turns as answers to the user turn before them, ranked by length and labelled."""
    c = table(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("question_id", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(before))
    a = c.where("role = 'assistant' and question_id is not null").select("conv_id", "question_id", "turn", F.length("text").cast("long").alias("score"))
    a = a.withColumn("q", F.struct("conv_id", "question_id"))
    ranked = posts.rank_answers(a, question="q", position="turn")
    return ranked.select("conv_id", "question_id", "turn", "score", "rank", posts.quality_label(F.col("score"), F.col("is_best"), great=600, good=200, bad=50).alias("label"))


@query(
    "parent_child_nested",
    """SELECT o_orderkey AS id, count(l_orderkey) AS n, coalesce(string_agg(l_linenumber::varchar || ':' || l_partkey::varchar, ',' ORDER BY l_linenumber, l_partkey), '') AS children
       FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) l ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
)
def parent_child_nested(spark, sf_dir):
    """Orders with their items nested; of items with one number the largest part stays."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("part"))
    nested = posts.align_answers(orders, items, order="part")
    text = F.array_join(F.transform("answers", lambda a: F.concat_ws(":", a["id"], a["part"])), ",")
    return nested.select("id", F.size("answers").cast("long").alias("n"), text.alias("children"))


@query("orphan_children", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_children(spark, sf_dir):
    return posts.orphans(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id")), "doc_id", "label_id")


STATUS = "CASE WHEN lang IS NULL THEN 'PARSE_FAIL' WHEN lang = 'es' THEN 'NOT_VALID_TYPE' WHEN length(text) < 100 THEN 'NO_BODY' WHEN lang = 'en' AND source = 'src0' THEN 'NO_TITLE' ELSE 'PASS' END"


def statuses(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).when(F.col("lang") == "de", 3).when(F.col("lang") == "es", 9)
    body = F.when(F.length("text") >= 100, F.col("text"))
    title = F.when(F.col("source") != "src0", F.col("source"))
    return d.withColumns({"type": kind, "result": posts.post_status(F.col("lang").isNotNull(), kind, body, title)})


@query("post_status_classify", f"SELECT doc_id, {STATUS} AS result FROM documents")
def post_status_classify(spark, sf_dir):
    return statuses(spark, sf_dir).select("doc_id", "result")


@query("type_counts", f"SELECT {STATUS} AS result, count(*) AS n FROM documents GROUP BY 1")
def type_counts(spark, sf_dir):
    return statuses(spark, sf_dir).groupBy("result").agg(F.count("*").alias("n"))


@query("overview_project", "SELECT d.doc_id AS id, d.lang AS tag_to_use, d.n_chars AS views, l.quality::bigint AS score FROM documents d JOIN labels l USING (doc_id) WHERE d.n_chars >= 500 AND l.quality >= 1")
def overview_project(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    q = d.select(F.col("doc_id").alias("id"), F.array("lang").alias("tags"), F.col("quality").cast("long").alias("score"), F.col("n_chars").alias("views"), F.lit(0).alias("answer_count"), F.lit(None).cast("string").alias("accepted_answer"))
    return filters.at_least(posts.overview(q), views=500, score=1).select("id", "tag_to_use", "views", "score")


@query("blocklist_anti", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def blocklist_anti(spark, sf_dir):
    blocked = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("blocked"))
    return filters.drop_listed(table(spark, sf_dir, "documents").select("doc_id", "lang"), blocked, "doc_id", "blocked")




@query("tag_blocklist", f"WITH {PART} SELECT id, array_to_string(tags, ',') AS tags FROM t WHERE NOT list_has_any(tags, ['promo', 'small', 'red'])")
def tag_blocklist(spark, sf_dir):
    return filters.drop_tagged(part_tags(spark, sf_dir), ["promo", "small", "red"]).select("id", F.array_join("tags", ",").alias("tags"))


@query("tag_allowlist", f"WITH {PART} SELECT id, array_to_string(tags, ',') AS tags FROM t WHERE list_has_any(list_transform(tags, lambda x: lower(x)), ['promo', 'small', 'red'])")
def tag_allowlist(spark, sf_dir):
    return filters.keep_tagged(part_tags(spark, sf_dir), ["Promo", "SMALL", "red"]).select("id", F.array_join("tags", ",").alias("tags"))


@query(
    "first_match_semi",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k
         FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')) WHERE k = 1""",
)
def first_match_semi(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("l_orderkey"))
    return filters.first_match(table(spark, sf_dir, "lineitem"), wanted, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("sql_inner_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sql_inner_join(spark, sf_dir):
    return spark.sql("SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey", nation=table(spark, sf_dir, "nation"), region=table(spark, sf_dir, "region"))


@query("implicit_join", "SELECT n_name, count(*) AS n FROM nation, supplier WHERE n_nationkey = s_nationkey GROUP BY n_name")
def implicit_join(spark, sf_dir):
    return spark.sql("SELECT n_name, count(*) AS n FROM {nation}, {supplier} WHERE n_nationkey = s_nationkey GROUP BY n_name", nation=table(spark, sf_dir, "nation"), supplier=table(spark, sf_dir, "supplier"))


@query(
    "key_reconcile",
    """WITH c AS (SELECT c_custkey AS key FROM customer WHERE c_acctbal > 0), o AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'P')
       SELECT key, 'no orders' AS side FROM c WHERE key NOT IN (SELECT key FROM o) UNION ALL SELECT key, 'no customer' FROM o WHERE key NOT IN (SELECT key FROM c)""",
)
def key_reconcile(spark, sf_dir):
    """Keys that one side lacks: customers in credit, and those with open orders."""
    a = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    b = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")).distinct()
    return a.join(b, "key", "left_anti").withColumn("side", F.lit("no orders")).union(b.join(a, "key", "left_anti").withColumn("side", F.lit("no customer")))


@query(
    "left_default_attach",
    "SELECT o_orderkey, coalesce(max(l_quantity), 0.0) AS most, CASE WHEN count(l_orderkey) = 0 THEN 'Timed Out' ELSE 'Done' END AS result FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY 1",
)
def left_default_attach(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_quantity").alias("most"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(found, o["o_orderkey"] == found["l_orderkey"], "left").select("o_orderkey", F.coalesce("most", F.lit(0.0)).alias("most"), F.when(F.col("l_orderkey").isNull(), "Timed Out").otherwise("Done").alias("result"))


@query(
    "context_theta_join",
    "SELECT a.l_orderkey, a.l_linenumber, count(*) AS others FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2",
)
def context_theta_join(spark, sf_dir):
    """For each item, how many items of its order have another part."""
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a, b = i.alias("a"), i.alias("b")
    return a.join(b, F.expr("a.l_orderkey = b.l_orderkey and a.l_partkey <> b.l_partkey")).groupBy("a.l_orderkey", "a.l_linenumber").agg(F.count("*").alias("others"))


SYNONYMS = {"red": "crimson", "small": "little", "promo": "offer"}


@query(
    "synonym_canonicalise",
    f"WITH {PART} SELECT id, array_to_string(list_transform(tags, lambda x: CASE x WHEN 'red' THEN 'crimson' WHEN 'small' THEN 'little' WHEN 'promo' THEN 'offer' ELSE x END), ',') AS tags FROM t",
)
def synonym_canonicalise(spark, sf_dir):
    m = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    return part_tags(spark, sf_dir).select("id", F.array_join(tags.canonical(F.col("tags"), m), ",").alias("tags"))


@query(
    "synonym_join",
    f"WITH {PART}, n AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), c AS (SELECT c_custkey AS id, [lower(c_mktsegment), n_name] AS tags FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT id, tags[1] || ',' || coalesce(r_name, tags[2]) AS tags FROM c LEFT JOIN n ON tags[2] = n_name",
)
def synonym_join(spark, sf_dir):
    """Customers' tags with nations replaced by their region, by a join."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    syn = nation.join(region, F.expr("n_regionkey = r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"))
    c = table(spark, sf_dir, "customer").join(nation, F.expr("c_nationkey = n_nationkey")).select(F.col("c_custkey").alias("id"), F.array(F.lower("c_mktsegment"), "n_name").alias("tags"))
    return tags.canonical_by_join(c, syn, "id").select("id", F.array_join("tags", ",").alias("tags"))


@query("tag_counts", f"WITH {PART} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM t) GROUP BY tag")
def tag_counts(spark, sf_dir):
    return tags.tag_counts(part_tags(spark, sf_dir))


@query("top25_tags", f"WITH {PART} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM t) GROUP BY tag ORDER BY n DESC, tag LIMIT 25")
def top25_tags(spark, sf_dir):
    return tags.top_tags(part_tags(spark, sf_dir).select(F.explode("tags").alias("tag_to_use")))


EDGES = f"{PART}, e AS (SELECT tags[i] AS src, tags[j] AS dst, count(*) AS n FROM t, (VALUES (1, 2), (1, 3), (2, 3)) p(i, j) GROUP BY 1, 2)"


@query("cooccurrence_edges", f"WITH {EDGES} SELECT '(' || src || ',' || dst || ')' AS edge, n FROM e")
def cooccurrence_edges(spark, sf_dir):
    return tags.edges(part_tags(spark, sf_dir)).select(F.format_string("(%s,%s)", "src", "dst").alias("edge"), "n")


@query("adjacency", f"WITH {EDGES} SELECT tag, string_agg(other, ',' ORDER BY other) AS neighbours FROM (SELECT src AS tag, dst AS other FROM e UNION SELECT dst, src FROM e) GROUP BY tag")
def adjacency(spark, sf_dir):
    return tags.adjacency(tags.edges(part_tags(spark, sf_dir))).select("tag", F.array_join("neighbours", ",").alias("neighbours"))


@query("first_tag_graph", f'WITH {PART} SELECT tags[1] AS "first", tags[j] AS other, count(*) AS n FROM t, (VALUES (2), (3)) p(j) GROUP BY 1, 2')
def first_tag_graph(spark, sf_dir):
    return tags.first_tag_graph(part_tags(spark, sf_dir))


@query(
    "top_tag_graph",
    f"""WITH {PART}, x AS (SELECT id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM t), c AS (SELECT tag, count(*) AS c FROM x GROUP BY tag),
        o AS (SELECT id, tag, row_number() OVER (PARTITION BY id ORDER BY c DESC, pos) AS k FROM x JOIN c USING (tag))
        SELECT a.tag AS "first", b.tag AS other, count(*) AS n FROM o a JOIN o b ON a.id = b.id AND a.k = 1 AND b.k > 1 GROUP BY 1, 2""",
)
def top_tag_graph(spark, sf_dir):
    return tags.first_tag_graph(tags.by_global_count(part_tags(spark, sf_dir), "id"))


@query(
    "prefix_rollup",
    f"""WITH {PART}, l AS (SELECT unnest(['all', tags[1], tags[1] || ',' || tags[2], tags[1] || ',' || tags[2] || ',' || tags[3]]) AS level, score::double AS v FROM t)
        SELECT level, round(avg(v), 6) AS mean, quantile_cont(v, 0.5) AS median, round(stddev_pop(v), 6) AS std, count(*) AS n FROM l GROUP BY level""",
)
def prefix_rollup(spark, sf_dir):
    out = tags.prefix_rollup(part_tags(spark, sf_dir), "score")
    return out.select("level", F.round("mean", 6).alias("mean"), "median", F.round("std", 6).alias("std"), "n")


@query(
    "merged_tag_counts",
    "SELECT n_name AS tag, count(c_custkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey",
)
def merged_tag_counts(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    count = lambda name, key: nation.join(table(spark, sf_dir, name), F.col("n_nationkey") == F.col(key)).groupBy(F.col("n_name").alias("tag")).agg(F.count("*").alias("n"))
    return tags.merged_counts(count("customer", "c_nationkey"), count("supplier", "s_nationkey"))[0]


HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '')"
PATH = r"regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)"


@query("url_two_level", f"SELECT {HOST} AS host, {PATH} AS path, count(*) AS n FROM pages GROUP BY 1, 2")
def url_two_level(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(S.host(F.col("url")).alias("host"), F.coalesce(S.path(F.col("url")), F.lit("")).alias("path"))
    return p.groupBy("host", "path").agg(F.count("*").alias("n"))


@query("url_hosts", f"SELECT {HOST} AS host, count(*) AS n, count(DISTINCT {PATH}) AS paths FROM pages GROUP BY 1")
def url_hosts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(S.host(F.col("url")).alias("host"), F.coalesce(S.path(F.col("url")), F.lit("")).alias("path"))
    return p.groupBy("host").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"))


@query("href_counts", """SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pages) GROUP BY href""")
def href_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.explode(S.hrefs(F.col("html"))).alias("href")).groupBy("href").agg(F.count("*").alias("n"))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return stats.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("duplicate_texts", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
