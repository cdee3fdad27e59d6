"""The pipeline: stages keep clean documents, and each decision takes effect."""

import random

import pytest

import corpus_pipeline
from tessera.llm import classifier, decontaminate
from tessera.llm.queries import TOKENIZER, quality_model
from tests.conftest import SF
from tests.llm.conftest import prose
from tests.llm.test_documents import least_distance, plain_components, plain_line_dedup
from tests.llm.test_others import plain_chances, plain_features


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "encoding":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "encoding"]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables with toxic and poor texts, lines that repeat, copies, near copies, benchmark passages, nulls and empty texts."""
    r = random.Random(17)
    items = [(k, prose(5000 + k, 9)) for k in range(4)]
    shared = [prose(5100 + k, 5) for k in range(5)]
    rows, labels = [], []
    for i in range(240):
        grade = i % 3
        text = prose(i, 25) + (" vile insult" if grade == 0 else " SPAM!! BUY!! NOW!!" if grade == 1 else "")
        rows.append((i, text))
        labels.append((i, int(grade == 2), int(grade == 0)))
    good = [(300 + k, "\n".join([prose(6000 + k, 12), *r.sample(shared, k % 3), prose(6500 + k, 12)])) for k in range(40)]
    near = [(400 + k, " ".join([*t.split()[:-1], "other"])) for k, (_, t) in enumerate(good[:10])]
    copies = [(420 + k, t) for k, (_, t) in enumerate(good[10:15])]
    leaks = [(440 + k, f"{prose(7000 + k, 6)} {t.replace('alpha', 'alpah', 1)} {prose(7100 + k, 6)}") for k, (_, t) in enumerate(items)]
    rows += [*good, *near, *copies, *leaks, (500, None), (501, ""), (502, " \n "), (503, "\n".join(shared[:2]))]
    path = tmp_path_factory.mktemp("small")
    put = lambda data, kind, name: spark.createDataFrame(data, kind).repartition(3).write.parquet(f"{path}/{name}.parquet")
    put([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS, "documents")
    put(labels, "doc_id bigint, quality int, toxic int", "labels")
    put(items, "item_id bigint, text string", "benchmark")
    return str(path), items


def plain_stage(spark, name, rows, folder, items):
    """The (doc_id, text) that a stage leaves of ``rows``, by other means."""
    if name == "quality":
        model = quality_model(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        return [(i, t) for i, t in rows if plain_chances(sum(float(model.weights[f]) for f in plain_features(t)), model.thresholds)[-1] >= classifier.ACCEPT]
    if name == "line_dedup":
        out = plain_line_dedup(rows, 16, 1)
        return [(i, t) for (i, n, gone, t), times in out.items() for _ in range(times) if not gone or gone < n]
    if name == "near_dedup":
        kept = {i for i, _, _, is_kept in plain_components(rows, 5, 80) if is_kept}
        return [(i, t) for i, t in rows if i in kept]
    return [(i, t) for i, t in rows if not t or all(least_distance(decontaminate.plain(p), decontaminate.plain(t)) > int(0.08 * len(p)) for _, p in items)]


def test_stages_against_plain_versions(spark, small, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    folder, items = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        want = plain_stage(spark, name, rows, folder, items)
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = docs.collect()
        key = lambda x: (x[0], x[1] or "")
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted(want, key=key), name
        assert 0 < len(got) < len(rows) or name == "near_dedup" and len(got) <= len(rows), name
        assert all(r["n_chars"] == len(r["text"] or "") for r in got)
    sp = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    coded = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()}
    assert {i: list(r["token_ids"]) for i, r in coded.items()} == {r["doc_id"]: sp.encode(r["text"] or "") for r in got}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == set(coded)


def test_stages_of_odd_tables(spark, small, tmp_path):
    """Empty tables, repeated rows, null ids and columns that clash go through every stage."""
    folder, _ = small
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id >= 300")
    odd = docs.union(docs).union(spark.createDataFrame([(None, prose(1, 30), None, None, None), (None, None, None, None, None)], COLUMNS)).withColumnsRenamed({"lang": "id", "source": "__n_lines"})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), folder).count() == 0, name
        out = stage(spark, odd, folder)
        if name != "encoding":
            assert out.columns == odd.columns, name
        assert out.where("doc_id is null").count() == 2 - (name == "quality" and out.where("doc_id is null").count() < 2), name

