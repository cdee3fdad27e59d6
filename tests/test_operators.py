"""The operators on small rows, with results known by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import bleu, code, html_blocks, maps, templates
from tessera.functions import strings as S
from tessera.operators import boolean_tests, experiments, filters, packing, posts, ranks, samples, sampling, stats, tags
from tessera.registry import Registry
from tessera.sources import files, posts_xml

POSTS = """<?xml version="1.0" encoding="utf-8"?>
<posts>
  <row Id="410" PostTypeId="1" AcceptedAnswerId="412" CreationDate="2021-03-04T05:06:07.008" Score="31" ViewCount="77" Body="&lt;p&gt;How do tides work?&lt;/p&gt;" Title="Tides" Tags="&lt;sea&gt;&lt;moon&gt;" AnswerCount="2" CommentCount="0" />
  <row Id="412" PostTypeId="2" ParentId="410" CreationDate="2021-03-04T06:00:00.000" Score="4" Body="by the moon" CommentCount="1" />
  <row Id="413" PostTypeId="1" CreationDate="2021-03-05T00:00:00.000" Score="2" Body="nameless" Tags="&lt;sand&gt;" />
  <row Id="414" PostTypeId="2" ParentId="410" CreationDate="2021-03-06T00:00:00.000" Score="-3" Body="by the wind" />
  <row Id="415" PostTypeId="17" Score="0" Body="what kind" />
  <row Id="416" PostTypeId="1" Score="1" Body="quiet" Title="Unanswered" />
  <row Id="417" PostTypeId="2" ParentId="999" Score="0" Body="astray" />
  <row Id="418" PostTypeId="5" Score="0" Body="" />
  <row Id="419" PostTypeId="1" Score=
</posts>
"""


@pytest.fixture(scope="module")
def dump(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "Posts.xml"
    path.write_text(POSTS)
    return posts_xml.read_posts(spark, f"file://{path}")


def test_dump(dump):
    counts = {r[0]: r[1] for r in dump.groupBy("result").count().collect()}
    assert counts == {"PARSE_FAIL": 4, "NO_TITLE": 1, "NOT_VALID_TYPE": 1, "NO_BODY": 1, "PASS": 5}
    first = dump.where("id = '410'").first()
    assert first["tags"] == ["sea", "moon"] and first["views"] == 77 and first["accepted_answer"] == "412"


def test_align(dump):
    good = dump.where("result = 'PASS'")
    questions = good.where("type = 1").select("id", "tags", "score")
    answers = good.where("type = 2").select("line", "parent_id", "id", "score", "body")
    got = {r["id"]: [a["id"] for a in r["answers"]] for r in posts.align_answers(questions, answers).collect()}
    assert got == {"410": ["412", "414"], "416": []}
    assert [r["id"] for r in posts.orphans(answers, questions.select(F.col("id").alias("qid")), "parent_id", "qid").collect()] == ["417"]


def test_ranking(spark):
    rows = spark.createDataFrame([(1, 0, -1, False), (1, 1, 0, True), (1, 2, 10, False), (2, 0, 5, False), (2, 1, 5, False)], "question_id int, pos int, score int, acc boolean")
    accepted = posts.rank_answers(rows, accepted="acc").orderBy("question_id", "rank")
    assert [(r["question_id"], r["score"]) for r in accepted.collect()] == [(1, 0), (1, 10), (1, -1), (2, 5), (2, 5)]
    labels = [r[0] for r in accepted.where("question_id = 1").select(posts.quality_label(F.col("score"), F.col("rank") == 1)).collect()]
    assert labels == ["BEST", "GOOD", "BAD"]
    assert [(r["pos"], r["is_best"]) for r in posts.rank_answers(rows).where("question_id = 2").orderBy("pos").collect()] == [(0, True), (1, False)]


def test_filters(spark):
    df = spark.createDataFrame([(1, ["A", "b"]), (2, ["c"]), (3, []), (4, None)], "id int, tags array<string>")
    assert [r[0] for r in filters.drop_tagged(df, ["a", "c"]).collect()] == [1, 3, 4]
    assert [r[0] for r in filters.keep_tagged(df, ["a"]).collect()] == [1]
    have, lack = filters.with_keys(df, "tags")
    assert have.count() == 3 and lack.count() == 1
    assert [r["display"] for r in filters.renamed_subset(spark.createDataFrame([("x",), ("y",)], "run string"), {"x": "X!"}, "run").collect()] == ["X!"]


def test_tag_graph(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], 2.0), (2, ["a", "a"], 4.0), (3, ["b"], 6.0), (4, [], 8.0)], "id int, tags array<string>, v double")
    assert {(r[0], r[1]): r[2] for r in tags.edges(df).collect()} == {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 1, ("a", "a"): 1}
    levels = {r["level"]: (r["mean"], r["n"]) for r in tags.prefix_rollup(df, "v").collect()}
    assert levels == {"all": (5.0, 4), "a": (3.0, 2), "a,b": (2.0, 1), "a,b,c": (2.0, 1), "a,a": (4.0, 1), "b": (6.0, 1)}
    assert {r["id"]: r["tags"] for r in tags.by_global_count(df, "id").collect()}[1] == ["a", "b", "c"]


def test_tag_dimension(spark):
    t = spark.createDataFrame([("x", 3, "1", "11", "12"), ("y", 1, "2", None, None)], "tag string, count int, id string, excerpt_id string, wiki_id string")
    body = spark.createDataFrame([("11", "short", "d1"), ("12", "long", "d2")], "id string, body string, date string")
    syn = spark.createDataFrame([("x", "ex"), ("x", "eks")], "target string, source string")
    got = {r["tag"]: r for r in tags.tag_dimension(t, body, body, syn).collect()}
    assert got["x"]["wiki_date"] == "d2" and got["x"]["synonyms"] == ["eks", "ex"] and got["y"]["synonyms"] == []


def test_pass_at_k(spark):
    rows = spark.createDataFrame([(4, 1), (4, 0), (4, 4), (2, 1)], "n int, c int")
    got = [tuple(r) for r in rows.select(*[F.round(stats.pass_at_k(F.col("n"), F.col("c"), k), 6) for k in (1, 2, 3)]).collect()]
    assert got == [(0.25, 0.5, 0.75), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.5, 1.0, 1.0)]


def test_histogram_leaves_out_the_minimum(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 1, 2, 3, 4, 10)], "v double")
    got = [(r["lo"], r["hi"], r["n"]) for r in stats.quantile_histogram(df, "v", [0.5]).orderBy("lo").collect()]
    assert got == [(1.0, 2.5, 1), (2.5, 10.0, 3)]


def test_vote(spark):
    rows = [(1, 0, [0.9, 0.1]), (1, 1, [0.2, 0.3]), (2, 0, [0.1, 0.2]), (2, 1, [0.0, 0.2]), (2, 2, [0.9, 0.0])]
    got = dict(map(tuple, stats.ensemble_vote(spark.createDataFrame(rows, "task int, member int, scores array<double>"), "task", "member", "scores", 2).collect()))
    assert got == {1: 0, 2: 1}


def test_sampling(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a = {r[0] for r in sampling.sample_n(df, "k", 17, 1).collect()}
    assert len(a) == 17 and a == {r[0] for r in sampling.sample_n(df.repartition(7), "k", 17, 1).collect()}
    with pytest.raises(ValueError):
        sampling.sample_n(df, "k", 101)
    split = sampling.train_val_split(df, "k", max_val=50)
    assert split.where("split = 'val'").count() == 10 and split.count() == 100
    parts = {r[0]: r[1] for r in sampling.positional_split(df, "k", 2, 4, 5).groupBy("split").count().collect()}
    assert parts == {"few_shot": 2, "test": 4, "train": 5, "validation": 89}
    one = spark.range(1).select(F.array(*map(F.lit, "abcde")).alias("a"), F.array(F.lit("x")).alias("b"))
    r = one.select(sampling.batches(F.col("a"), 2, True), sampling.batches(F.col("a"), 2), sampling.interleaved(F.col("a"), F.col("b")), sampling.until_too_long(F.array(F.lit("a"), F.lit("bbb"), F.lit("c")), 2)).first()
    assert [list(x) for x in r] == [[["a", "b"], ["c", "d"]], [["a", "b"], ["c", "d"], ["e"]], ["a", "x", "b", "c", "d", "e"], ["a"]]


def test_boolean_tests(spark):
    pairs = spark.createDataFrame([("p", 0, "f(1)", "==", "2"), ("p", 1, "f(2)", "==", "3")], "program string, pos int, input string, op string, output string")
    tests = boolean_tests.crossed(pairs)
    assert sorted((r["input"], r["output"], r["result"]) for r in tests.collect()) == [("f(1)", "2", "True"), ("f(1)", "3", "False"), ("f(2)", "2", "False"), ("f(2)", "3", "True")]
    both = boolean_tests.with_negations(tests)
    assert both.count() == 8 and {(r["op"], r["result"]) for r in both.where("is_negation_of is not null").collect()} == {("!=", "True"), ("!=", "False")}
    own = tests.withColumns({"task_id": F.concat_ws("_", "i", "j"), "is_generated": F.lit(False)})
    assert sorted(r["result"] for r in boolean_tests.balanced(own).collect()) == ["False", "False", "True", "True"]
    pool = tests.select("program", F.struct("i", "j").alias("pos"), "input", "result")
    chosen = boolean_tests.greedy_context(pool, true_quota=1, false_quota=1).orderBy("rank").collect()
    assert [(tuple(r["pos"]), r["result"]) for r in chosen] == [((0, 0), "True"), ((1, 0), "False")]


def test_contradicting_outputs(spark):
    """Of one call with two outputs, both pairs state what came first; excluded and fixed statements."""
    names = "program string, pos int, input string, op string, output string, is_generated boolean"
    pairs = spark.createDataFrame([("p", 0, "f(1)", "==", "2", False), ("p", 1, "f(1)", "==", "3", True), ("p", 2, "g()", "<", "5", None)], names)
    got = {(r["input"], r["output"]): (r["result"], r["is_original"], r["i"], r["is_output_generated"]) for r in boolean_tests.crossed(pairs).collect()}
    assert got["f(1)", "2"] == ("True", True, 0, False) and got["f(1)", "3"] == ("False", False, 0, True)
    assert got["g()", "5"] == ("True", True, 2, False) and got["f(1)", "5"][0] == "False" and len(got) == 6
    listed = lambda *s: spark.createDataFrame([("p", x) for x in s], "program string, statement string")
    tests = boolean_tests.crossed(pairs, excluded=listed("f(1) == 2"), fixes=listed("g() < 2"))
    got = {(r["input"], r["output"]): (r["result"], r["is_manual_fix"]) for r in tests.collect()}
    assert len(got) == 5 and got["g()", "2"] == ("True", True) and got["g()", "3"] == ("False", False)
    with pytest.raises(Exception, match="a fixed statement repeats"):
        boolean_tests.crossed(pairs, fixes=listed("f(1) == 3")).collect()


def test_negations_that_are_there_already(spark):
    rows = [("p", "a", "==", "1", 0, 0, "True", True), ("p", "a", "!=", "2", 1, 1, "True", True), ("p", "a", "==", "2", 0, 1, "False", False), ("p", "a", "!=", "1", 1, 0, "False", False)]
    tests = spark.createDataFrame(rows, "program string, input string, op string, output string, i int, j int, result string, is_original boolean")
    both = boolean_tests.numbered(boolean_tests.with_negations(tests)).orderBy("pred_idx").collect()
    assert [(r["input"] + r["op"] + r["output"], r["result"], r["is_negation_of"]) for r in both] == [
        ("a==1", "True", None), ("a!=1", "False", "p_0_0"), ("a!=2", "True", None), ("a==2", "False", "p_1_1"), ("a==2", "False", None), ("a!=1", "False", None),
    ]


def plain_choice(tests, ratio):
    """Which tests of one program are chosen, one after another."""
    import hashlib
    import math

    own = [t for t in tests if not t["is_generated"]]
    true, false = ([t for t in own if t["result"] == k] for k in ("True", "False"))
    if not true or not false:
        return set()
    place = lambda t: (hashlib.md5(f"0:{t['task_id']}".encode()).hexdigest(), t["task_id"])
    quota = max(1, min(len(false), math.floor(len(true) * ratio)))
    led, seen = [], set()
    for t in sorted(false, key=place):
        if t["input"] in {x["input"] for x in true} and t["input"] not in seen:
            led.append(t)
            seen.add(t["input"])
    rest = [t for t in sorted(false, key=place) if t not in led]
    return {t["task_id"] for t in true} | {t["task_id"] for t in (led + rest)[:quota]}


@pytest.mark.parametrize("ratio", [0.3, 1.0, 2.5])
def test_balanced_choice(spark, ratio):
    import random

    r = random.Random(3)
    rows = [{"program": p, "task_id": f"{p}_{k}", "input": r.choice("abc"), "result": r.choice(["True", "False", "False"]), "is_generated": r.random() < 0.2} for p in range(12) for k in range(r.randrange(1, 9))]
    df = spark.createDataFrame([(x["program"], x["task_id"], x["input"], x["result"], x["is_generated"]) for x in rows], "program int, task_id string, input string, result string, is_generated boolean")
    got = {x["task_id"] for x in boolean_tests.balanced(df, ratio=ratio).collect()}
    assert got == set().union(*(plain_choice([x for x in rows if x["program"] == p], ratio) for p in range(12)))


def test_packing(spark):
    rows = [(i, [f"{i}.{j}" for j in range(n)]) for i, n in enumerate([3, 0, 5, 1, 9, 2])]
    flat = [t for _, ts in rows for t in ts]
    df = spark.createDataFrame(rows, "k int, tokens array<string>").repartition(3)
    got = {r["block"]: r["tokens"] for r in packing.packed(df, "k", "tokens", 4).collect()}
    assert got == {b: flat[4 * b : 4 * b + 4] for b in range(len(flat) // 4)}
    blocks, masks = packing.padded(F.col("tokens"), 4, "_")
    r = df.where("k = 2").select(blocks, masks).first()
    assert r[0] == [["2.0", "2.1", "2.2", "2.3"], ["2.4", "_", "_", "_"]] and r[1] == [[1, 1, 1, 1], [1, 0, 0, 0]]
    shards = packing.rank_shards(spark.range(10).withColumnRenamed("id", "k"), "k", 2, 3)
    assert {r["rank"]: r["n"] for r in shards.groupBy("rank").agg(F.count("*").alias("n")).collect()} == {0: 4, 1: 4, 2: 4}
    assert packing.rank_shards(spark.range(10).withColumnRenamed("id", "k"), "k", 2, 3, True).count() == 6


def test_strings(spark):
    r = spark.range(1).select(
        S.tag_list(F.lit("<a><b-c>")), S.ordinal(F.lit(12)), S.ordinal(F.lit(23)), S.first_block(F.lit("x = 1\n\ndef f(): pass")), S.run_name(F.lit("abc_d_e-tail")), S.metric_name(F.lit("eval_loss")), S.host(F.lit("https://www.A.org/x?y")),
        S.docstring(F.lit('def f():\n  """ one\n   two """\n')), S.human_size(F.lit(2048)), S.ascii_text(F.lit("Ærøß é")), S.comment(F.lit("a\nb"), "LINE"), S.context_and_program(F.lit("import x\ndef f(): 1"))[1], S.indented(F.lit("a\nb")),
    ).first()
    assert [r[0], *r[1:]] == [["a", "b-c"], "12TH", "23RD", "x = 1", "abc_d", "eval/loss", "a.org", "one\ntwo", "2.0 KB", "AEross e", "# a\n# b", "def f(): 1", "\ta\n\tb"]


def test_blocks_and_sections():
    html = "<p>Call <code>go()</code> once</p><ul><li>then wait</li></ul><pre><code>go()\nwait()</code></pre><p>Done</p>"
    assert html_blocks.body_blocks(html) == [("p", "Call go() once\nthen wait"), ("code", "go()\nwait()"), ("p", "Done")]
    rows = html_blocks.section_rows("<h1 id=a>A</h1><p>t</p><h2>B</h2><ul><li>i</ul><pre>c\n</pre><h1>C</h1>")
    assert [(r[0], r[1], r[5], r[3] or r[6]) for r in rows] == [(1, 0, "section", "A"), (1, 1, "p", "t"), (2, 1, "section", "B"), (2, 2, "p", "* i"), (2, 2, "code", "c"), (3, 0, "section", "C")]


def test_maps(spark):
    left, right = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"), F.lit("c"), F.lit("4"))
    r = spark.range(1).select(maps.merged_right(left, right), maps.merged_left(left, right, ["c"]), maps.conflicting_keys(left, right), maps.inverted(left)).first()
    assert [r[0], r[1], r[2], r[3]] == [{"a": "1", "b": "3", "c": "4"}, {"a": "1", "b": "2"}, ["b"], {"1": "a", "2": "b"}]
    record = {"a": {"b": 1, "c": {"d": 2}}, "e": 3}
    assert maps.flat_dict(record) == {"a.b": 1, "a.c.d": 2, "e": 3} and maps.nested_dict(maps.flat_dict(record)) == record


def test_experiments(spark):
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} string, config map<string,string>")
    groups = [frame([("x", {"k": "1"})], "choice"), frame([("y", {"k": "2"}), ("z", {})], "choice")]
    assert experiments.ablation_product(frame([("c", {})], "name"), frame([("s", {})], "step"), groups).count() == 2
    assert [r["key"] for r in experiments.conflicts(groups).collect()] == ["k"]


def test_programs():
    source = "def test():\n    assert f(1) == 2\n    assert g('a') is not None\n    assert h(x)\n    assert 1 < 2 < 3\n    assert k not in (1, 2)\n"
    assert code.assertion_pairs(source) == [("f(1)", "==", "2"), ("g('a')", "is not", "None"), ("k", "not in", "(1, 2)")]
    s = code.program_stats("import os\nx = 1\nx = 2\nfor i in range(3):\n    if i: print(i[0])\n")
    assert s["loops"] == 1 and s["branches"] == 1 and s["redefined"] == ["x"] and s["unused"] == ["x"] and s["imports"] == ["os"]
    assert code.doctest_snippets(">>> x = 2\n>>> print(x)\n2\n\n>>> for i in [1]:\n...     print(i)\n1")[0] == {"context": "x = 2", "code": "x", "result": "2", "start_char_idx": 10}
    assert code.backward_slice("a = 1\nb = 2\nc = a + 1\nd = b", {"c"}) == "a = 1\nc = a + 1"
    assert code.sample_functions("import math\na = 4\nb = math.sqrt(a)", "b += 1", ["b", "a"]) == {
        "target": "def solution(a, b):\n    b += 1\n    return b, a",
        "inputs": ["a", "b"],
        "context": "def get_inputs_from_context():\n    a = 4\n    b = math.sqrt(a)\n    return dict(a=a, b=b)",
        "imports": ["import math"],
    }


def test_execution(spark):
    got = [code.execute(p, 2.0)["result"] for p in ("x = 1", "assert False", "1 / 0", "def", "while True: pass", code.harness("def f(x): return x", "f(1) == 1"))]
    assert got == ["Passed", "Failed Tests", "ZeroDivisionError", "SyntaxError", "Timed Out", "Passed"]
    with pytest.raises(PermissionError):
        code.executed(spark.createDataFrame([("x",)], "code string"))


def test_bleu():
    same = "the cat sat on the mat"
    assert round(bleu.bleu(bleu.ngram_counts(same, same)), 6) == 100
    assert bleu.bleu(bleu.ngram_counts("a b", "c d")) == 0


def test_registry():
    r = Registry("thing")
    r.register("a")(1)
    with pytest.raises(ValueError):
        r.register("a")(2)
    with pytest.raises(KeyError):
        r["b"]


def test_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nowhere"):
        files.require(spark, f"file://{tmp_path}", f"file://{tmp_path}/nowhere")
    (tmp_path / "m.json").write_text('{"json": ["1", "2"], "array": []}')
    assert {r["tag"]: r["value"] for r in files.read_json_map(spark, f"file://{tmp_path}/m.json", "array<string>", "tag").collect()} == {"json": ["1", "2"], "array": []}
    df = spark.createDataFrame([("a", 1, "val"), ("b", 2, "train")], "tag string, n int, split string")
    files.write_split(df, f"file://{tmp_path}/out", "x")
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"x.jsonl", "x_val.jsonl"}
    assert [r["tag"] for r in files.read_jsonl(spark, f"file://{tmp_path}/out/x_val.jsonl", "tag string, n int").collect()] == ["a"]
    files.write_json_object(df.drop("split"), f"file://{tmp_path}/one", "tag", whole=True)
    assert {r["k"]: r["value"]["n"] for r in files.read_json_map(spark, f"file://{tmp_path}/one", "struct<n:int>", "k").collect()} == {"a": 1, "b": 2}
    files.write_json_object(df.drop("split"), f"file://{tmp_path}/each", "tag")
    assert sorted(r["value"] for r in spark.read.text(f"file://{tmp_path}/each").collect()) == ['{"a":{"n":1}}', '{"b":{"n":2}}']
    files.write_by(df, f"file://{tmp_path}/by", "tag")
    assert spark.read.json(f"file://{tmp_path}/by").count() == 2


def test_readers(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and f"file://{tmp_path}/{name}"
    assert [tuple(r) for r in files.read_records(spark, put("r.json", '[{"a": 1}, {"a": null}]'), "a int").collect()] == [(1,), (None,)]
    assert [tuple(r) for r in files.read_csv(spark, put("c.csv", 'k,v\n1,"x, y"\n2,\n'), "k int, v string").collect()] == [(1, "x, y"), (2, None)]
    assert [r[0] for r in files.read_list(spark, put("l.txt", " a \n\nb\n")).collect()] == ["a", "b"]
    assert [tuple(r) for r in files.read_whole(spark, put("run_Eval.py", "x = 1\ny")).collect()] == [("run", "x = 1\ny")]
    tags_path = put("Tags.xml", '<tags>\n  <row Id="1" TagName="sea" Count="3" ExcerptPostId="7" />\n  <row Id="2" Count="1" />\n  <row Id=\n</tags>\n')
    assert [tuple(r) for r in posts_xml.read_tags(spark, tags_path).collect()] == [("sea", 3, "1", "7", None)]
    runs = spark.createDataFrame([("r1", {"loss": "0.5"})], "run string, m map<string,string>")
    assert files.flat_runs(runs, "run", "m").first()[0] == '{"run_name":"r1","loss":"0.5"}'


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "P.xml").write_bytes(b'<posts>\n<row Id="1" PostTypeId="2" ParentId="3" Score="1" Body="caf\xff" />\n</posts>\n')
    row = posts_xml.read_posts(spark, f"file://{tmp_path}/P.xml").where("result = 'PASS'").first()
    assert row["body"] == "caf\ufffd"


def test_samples_from_a_dump(dump):
    """From XML over alignment to samples, the body cleaned of its markup."""
    good = posts.passed(dump)
    assert {r["id"] for r in good.collect()} == {"410", "412", "414", "416", "417"}
    text = lambda c: html_blocks.blocks_text(html_blocks.html_blocks(c))
    answers = good.where("type = 2").select("line", "parent_id", "id", "score", "date", "body")
    questions = good.where("type = 1").withColumn("body", F.when(F.startswith("body", F.lit("<")), text("body")).otherwise(F.col("body"))).select("id", "title", "body", "accepted_answer", "tags")
    prompt = lambda g: F.concat_ws("\n", g["title"], g["context"], F.concat(F.lit("# "), g["quality"]), g["answer_date"])
    got = samples.training_samples(posts.align_answers(questions, answers), prompt).orderBy("id", "part").collect()
    assert [tuple(r) for r in got] == [("410", 0, "Tides\nHow do tides work?\n# BEST\n2021-03-04T06:00:00.000", "by the moon"), ("410", 1, "Tides\n# BAD\n2021-03-06T00:00:00.000", "by the wind")]
    named, failed = posts.tagged_answers(answers, posts.overview(dump.where("result = 'PASS' and type = 1")))
    assert {r["id"]: r["tag_to_use"] for r in named.collect()} == {"412": "sea", "414": "sea"} and [tuple(r) for r in failed.collect()] == [("NO_QUESTION", 1)]


ANSWERS = [("7", "seven", 2, "d7"), ("8", "", 9, "d8"), ("9", "nine", 9, "d9"), ("10", "ten", -4, "d10")]


@pytest.mark.parametrize(
    ("rules", "accepted", "want"),
    [
        ({}, "10", [("BEST", "ten"), ("GOOD", "nine"), ("OK", "seven")]),
        ({}, None, [("GOOD", "nine"), ("OK", "seven"), ("BAD", "ten")]),
        ({"allow_no_answer": True}, None, [("BEST", "-"), ("GOOD", "nine"), ("OK", "seven"), ("BAD", "ten")]),
        ({"relative": True}, "10", [("BEST", "ten"), ("3RD", "nine"), ("4TH", "seven")]),
        ({"sorting": "ascending", "answers_per_sample": 2}, "10", [("BEST", "ten"), ("OK", "seven")]),
        ({"sorting": "descending", "highest_is_best": True, "answers_per_sample": 2}, "10", [("GOOD", "nine")]),
        ({"worst_is_best": True}, "7", [("OK", "seven"), ("GOOD", "nine"), ("BEST", "ten")]),
        ({"repeat_prompt": False}, "10", [("BEST", "ten\nnine\nseven")]),
        ({"answers_per_sample": 1, "allow_no_answer": True, "sorting": "descending"}, "7", [("GOOD", "-")]),
    ],
)
def test_sample_rules(spark, rules, accepted, want):
    kind = "id string, body string, accepted_answer string, answers array<struct<id:string,body:string,score:int,date:string>>"
    rows = spark.createDataFrame([("q", "text", accepted, ANSWERS), ("none", "text", None, []), ("empty", " ", None, ANSWERS)], kind)
    made = samples.training_samples(rows, lambda g: F.concat(g["quality"], F.when(g["context"].isNotNull(), " +").otherwise("")), samples.SampleRules(no_answer="-", **rules))
    got = made.orderBy("id", "part").collect()
    assert [(r["input"], r["labels"]) for r in got if r["id"] == "q"] == [(q + " +" * (k == 0), t) for k, (q, t) in enumerate(want)]
    assert [(r["id"], r["labels"]) for r in got if r["id"] != "q"] == [("none", "-")] * rules.get("allow_no_answer", False)


def test_best_needs_a_score(spark):
    kind = "id string, body string, accepted_answer string, answers array<struct<id:string,body:string,score:int,date:string>>"
    rows = spark.createDataFrame([("q", "text", None, [("1", "a", -2, "d")])], kind)
    got = [samples.training_samples(rows, lambda g: g["quality"], samples.SampleRules(allow_negative_best=x)).first()["input"] for x in (False, True)]
    assert got == ["BAD", "BEST"]


def test_templates(spark):
    df = spark.createDataFrame([("a", None, [("s1", 1), ("s2", 2)], 0, True), ("b", " x ", [], 3, False)], "name string, note string, pairs array<struct<l:string,r:int>>, n int, flag boolean")
    source = "{% if note %}[{{ note|trim }}]{% elif flag and not n %}flag{% else %}none{% endif %} {{- '!' }}{# gone #}\n{% for l, r in pairs -%}\n  {{ loop.index }}{{ l ~ '=' ~ r }}{% if not loop.last %};{% endif %}{% endfor %}{{ pairs|length }}{{ name.split('a')|join('-') }}\n"
    assert [r[0] for r in df.orderBy("name").select(templates.rendered(df, source)).collect()] == ["flag!\n1s1=1;2s2=22-", "[x]!\n0b"]
    with pytest.raises(KeyError, match="missing"):
        templates.rendered(df, "{{ missing }}")
    for bad in ("{% if n %}", "{% endif %}", "{{ n n }}", "{{ n|odd }}", "{% for x in n %}{% endfor %}"):
        with pytest.raises((ValueError, TypeError)):
            templates.rendered(df, bad)
    prompt = [{"template": "<{{ input_sequence }}{{ mark }}>", "params": {"mark": "?"}}, {"template": "{{ input_sequence|upper }}"}]
    df = df.withColumn("input_sequence", F.col("name"))
    assert [r[0] for r in templates.apply_prompts(df, prompt, {"mark": "#"}).orderBy("name").select("input_sequence").collect()] == ["<A#>", "<B#>"]
    with pytest.raises(KeyError, match="flags"):
        templates.apply_prompts(df, prompt, flags={"flag": True})


def test_benchmark_rows(spark):
    from tessera.operators import programs

    kind = "task_id string, prompt string, canonical_solution string, test string, entry_point string"
    prompt = 'import math\n\ndef area(r):\n    """ Area of\n    a disc.\n    """\n'
    rows = spark.createDataFrame(
        [
            ("T/1", prompt, "    return math.pi * r * r\n", "def check(candidate):\n    assert candidate(0) == 0\n    assert candidate(1) > 3\n", "area"),
            ("T/2", prompt, "    return (", "def check(candidate):\n    assert candidate(0) == 0\n", "area"),
            ("T/3", prompt, "    return 1", "def check(candidate):\n    pass\n", "area"),
            ("T/4", "def area(r): pass", "    return 1", "assert candidate(0) == 0\n", "area"),
            ("HumanEval/38", prompt, "", "", "area"),
            ("T/5", None, None, None, None),
        ],
        kind,
    )
    good, bad = programs.normalised(rows, "human_eval")
    (one,) = good.collect()
    assert (one["description"], one["context"], one["code"]) == ("Area of\na disc.", "import math", "def area(r):\n    return math.pi * r * r")
    assert [tuple(p) for p in one["input_output_pairs"]] == [("area(0)", "==", "0"), ("area(1)", ">", "3")]
    fails = {r["task_id"]: r["exception"] for r in bad.collect()}
    assert set(fails) == {"T/2", "T/3", "T/4", "T/5", "HumanEval/38"} and fails["T/3"] == "No IO Pairs" and fails["HumanEval/38"] == "Skipped program"
    assert programs.without_listed_inputs(good, "area(1)").count() == 0 and programs.without_listed_inputs(good, "x").count() == 1
    with pytest.raises(KeyError):
        programs.normalised(rows, "nothing")


def test_code_samples(spark):
    assert code.doctest_snippets(">>> for k in y:\n...     print(k)\n1\n\n>>> if y:\n...     print(y)\n[1]") == [
        {"context": "out_0 = []\nfor k in y:\n    out_0.append(k)", "code": "out_0", "result": "1", "start_char_idx": 0},
        {"context": "out_0 = []\nfor k in y:\n    out_0.append(k)\nout_1 = None\nif y:\n    out_1 = y", "code": "out_1", "result": "[1]", "start_char_idx": 36},
    ]
    assert code.returned_values(["x", "y + 1"], ["x = 'a'", "print(x)", "y = 2"]) == {"OUT_0": {"val": "'a'", "type": "str"}, "OUT_1": {"val": "3", "type": "int"}, "STDOUT": "a\n", "STDERR": ""}
    assert code.returned_values(["1 / 0"], [])["ERROR"].startswith("ZeroDivisionError")
    assert code.sample_passes(["x = 'a'"], ["x", "1"], ["a", "1"]) and not code.sample_passes([], ["1"], ["2"])
    rows = [
        {"section_id": 1, "idx": 1, "tag": "code", "text": ">>> n = len(base)\n>>> n\n3"},
        {"section_id": 1, "idx": 2, "tag": "p", "text": "words"},
        {"section_id": 1, "idx": 3, "tag": "code", "text": ">>> n + 1\n4\n>>> 'a' + n\n5"},
        {"section_id": 2, "idx": 4, "tag": "code", "text": ">>> n\n3"},
    ]
    got = code.section_samples(rows, ["base = 'abc'"], {2: {4}}, enabled=True)
    assert [(s["idx"], s["code"], s["passed"], (s["error"] or "").split(":")[0]) for s in got] == [(1, "n", True, ""), (3, "n + 1", True, ""), (3, "'a' + n", False, "TypeError"), (4, "n", False, "")]
    assert got[1]["context"] == ["base = 'abc'", "n = len(base)"]
    df = spark.createDataFrame([("d", r["section_id"], r["idx"], r["tag"], r["text"]) for r in rows], "doc string, section_id int, idx int, tag string, text string")
    assert code.code_samples(df, "doc", global_context=["base = 'abc'"]).count() == 4


def test_section_parsers(spark):
    from tessera.registry import parsers

    page = "<h1>Site</h1><div class='mw-parser-output'><h2>A</h2><table><tr><td>no</table><p>yes</p></div>"
    assert [r[3] or r[6] for r in parsers["wiki"](page)] == ["A", "yes"]
    df = spark.createDataFrame([(page, "wiki"), (page, "other")], "html string, domain string")
    assert [len(r[0]) for r in df.select(html_blocks.sections_of_domain("html", "domain")).collect()] == [2, 4]


def test_exact_percentiles(spark):
    import random

    import numpy as np

    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([r.gauss(0, 1), 5.0, float(r.randrange(4)), None])) for _ in range(3000)] + [("one", 7.0), ("nulls", None)]
    points = [0.0, 0.01, 0.25, 0.5, 0.77, 0.999, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for n in (4, 64):
        got = {x["g"]: x["q"] for x in ranks.exact_percentiles(df, "v", points, ["g"], buckets=n).collect()}
        assert set(got) == {"a", "b", None, "one"}
        for g, q in got.items():
            assert np.allclose(q, np.quantile([v for h, v in rows if h == g and v is not None], points))
    (whole,) = ranks.exact_percentiles(df, "v", points).collect()
    assert np.allclose(whole["q"], np.quantile([v for _, v in rows if v is not None], points))
    assert ranks.exact_percentiles(df.where("v > 1e9"), "v", points).collect() == []


def test_places(spark):
    edges = [1.0, 2.0, 2.0, 5.0, 9.0]
    df = spark.createDataFrame([(x / 2,) for x in range(22)], "v double")
    got = df.select("v", ranks.place(F.array(*map(F.lit, edges)), F.col("v"), 5)).collect()
    assert all(r[1] == sum(e < r[0] for e in edges) for r in got)


def test_misses_count(spark):
    df = spark.createDataFrame([("x", "x"), ("x", None)], "target string, predicted string")
    assert tuple(stats.micro_scores(df, "target", "predicted").first())[:2] == (2, 50.0)


def test_repeated_names_are_errors(spark):
    pages = spark.createDataFrame([(1, "/a")], "id int, path string")
    twice = spark.createDataFrame([("/a", "A"), ("/a", "B")], "path string, name string")
    assert filters.join_unique(pages, twice.limit(1), "path").columns == ["id", "path", "name"]
    with pytest.raises(Exception, match="repeated: /a"):
        filters.join_unique(pages, twice, "path").collect()


def test_splits_keep_repeated_keys_together(spark):
    df = spark.createDataFrame([(k % 20, k) for k in range(60)], "k int, v int")
    split = sampling.train_val_split(df, "k", max_val=50, share=0.2)
    assert split.count() == 60 and split.where("split = 'val'").select("k").distinct().count() == 4 and split.where("split = 'val'").count() == 12


def test_streams_end_in_tables(spark, tmp_path):
    from tessera.streaming import events as streams

    rows = [(k, k // 10, "a b" if k % 2 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string").selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, event_id) AS ts", "user_id", "event_type", "1.0D AS value", "'' AS props")
    for part in range(3):
        df.where(f"event_id % 3 = {part}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/e")
    stream = lambda: streams.event_stream(spark, f"file://{tmp_path}/e")
    counts = streams.run_to_table(stream().groupBy("user_id").agg(F.count("*").alias("n")), "counts")
    assert {r["user_id"]: r["n"] for r in counts.collect()} == {0: 10, 1: 10, 2: 10, 3: 10}
    packed = streams.run_to_table(streams.packed_stream(stream(), "user_id", "event_type", 3), "packed", "append")
    assert sorted((r["lane"], r["block"], len(r["tokens"])) for r in packed.collect()) == [(k, b, 3) for k in range(4) for b in range(3)]
    assert streams.run_to_table(stream().where("user_id > 9").select("user_id"), "none", "append").count() == 0


def test_late_rows_are_dropped(spark, tmp_path):
    """A row behind the watermark changes no window that is closed."""
    from tessera.streaming import events as streams

    for k, (hour, ids) in enumerate([(1, [1, 2]), (9, [3]), (20, [5]), (1, [4])]):
        rows = [(i, 1, "a") for i in ids]
        df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string").selectExpr("event_id", f"timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, {hour}) AS ts", "user_id", "event_type", "1.0D AS value", "'' AS props")
        df.coalesce(1).write.parquet(f"file://{tmp_path}/e/p{k}")
    found = streams.event_stream(spark, f"file://{tmp_path}/e/*")
    got = streams.run_to_table(streams.tumbling(found, "1 hour", late="2 hours"), "late", "append").collect()
    assert {r["window"]["start"].hour: r["n"] for r in got}[1] == 2


def test_traces_and_times(spark):
    df = spark.createDataFrame([("a = 1\nb = a\nc = 2", "b"), ("a = (", "a"), (None, "a")], "code string, name string")
    rows = df.select(code.variable_trace("code").alias("t"), code.sliced("code", "name").alias("s")).collect()
    assert [len(r["t"]) for r in rows] == [3, 0, 0] and rows[0]["t"][1]["uses"] == ["a"] and [r["s"] for r in rows] == ["a = 1\nb = a", None, None]
    assert code.timed("def f(): return 1", "f()", 10)["seconds"] < 1
    assert code.timed("def f(): return 1", "g()", 10) == {"seconds": None, "result": "NameError"}


def test_progress():
    from tessera.streaming import events as streams

    assert streams.progress([{"batchId": 1, "numInputRows": 5}, {"batchId": 0, "numInputRows": 15}], 20) == [(0, 15, 0.75), (1, 20, 1.0)]


def test_function_traces(spark):
    source = "def f(a, *b, c=1):\n    x = a\n    x = 2\n    def g(y): return y\n    n = 0\n    n += 1\n    return x + n\nz = 1\n"
    (f,) = code.function_traces(source)
    assert f == {"name": "f", "args": ["a", "b", "c"], "nested": ["g"], "unused": ["b", "c"], "overwritten": ["x"], "lines": 7}
    df = spark.createDataFrame([(source,), ("def (",), (None,)], "code string")
    assert [len(r[0]) for r in df.select(code.code_functions("code")).collect()] == [1, 0, 0]
