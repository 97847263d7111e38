"""What the learned operators learn from: repeated, blank and many rows, and their arithmetic against plain forms."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusqa.llm import language_id, ordinal_quality

pytestmark = pytest.mark.filterwarnings("error::RuntimeWarning")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")


def predicted(docs, model):
    return {(r.doc_id, r.text_hash): (r.lang_pred, round(r.score, 6)) for r in language_id.predict(docs.withColumn("text_hash", F.xxhash64("text")), model).collect()}


def test_blank_rows_under_learned_ids(spark, documents):
    """Texts without letters, null texts and null labels teach nothing, whatever id they have."""
    odd = [(i, t, lang) for i in range(6) for t, lang in (("", "de"), (None, "fr"), ("12 .", "en"), ("abc", None))]
    more = documents.unionByName(spark.createDataFrame(odd, documents.schema))
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        plain, with_odd = language_id.fit(documents), language_id.fit(more)
    assert np.array_equal(plain.weights, with_odd.weights) and plain.languages == with_odd.languages
    found = predicted(documents, with_odd)
    assert found == predicted(documents, plain) and all(0 <= score <= 1 for _, score in found.values())
    labels = {(r.doc_id): r.lang for r in documents.collect()}
    assert sum(lang == labels[i] for (i, _), (lang, _) in found.items()) >= 0.97 * len(labels)


@pytest.mark.parametrize("equal", [True, False])
def test_many_rows_of_one_id(spark, documents, monkeypatch, equal):
    """The driver gets as many rows as are chosen, not their product."""
    got = []
    frame = spark.range(3000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("der hund und die katze").alias("text") if equal else F.concat(F.lit("der hund und die katze "), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    real = type(frame).toPandas
    monkeypatch.setattr(type(frame), "toPandas", lambda self: got.append(real(self)) or got[-1])
    model = language_id.fit(frame.unionByName(documents.where("doc_id < 40")), sample_rows=200)
    assert len(got[-1]) <= 200 and sum(map(len, got[-1]["turns"])) <= 200
    assert language_id.predict(documents.where("doc_id < 40"), model).count() == 40
    labels = spark.createDataFrame([(7, g) for g in (0, 1, 2, None)], "doc_id BIGINT, grade INT")
    rated = ordinal_quality.rate(frame.limit(5), ordinal_quality.fit(frame, labels, sample_rows=300)).collect()
    assert len(got[-1]) <= 300 and sum(map(len, got[-1]["grades"])) == 300
    assert len(rated) == 5 and all(0 <= r.tail_2 <= r.tail_1 <= 1 for r in rated)


def presences(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return next(language_id.presence(data, np.array([0, len(data)]))).copy()


def test_kernel_ridge_against_dense_matrices(documents):
    rows = documents.where("doc_id < 60").collect()
    frame = documents.where("doc_id < 60")
    model = language_id.fit(frame, landmarks=500)  # every row is a landmark: the exact kernel
    x = np.stack([presences(r.text) for r in rows]).astype(float)
    x /= np.sqrt(x.sum(1))[:, None]
    kernel = x @ x.T
    target = np.array([[1.0 if r.lang == lang else -1.0 for lang in model.languages] for r in rows])
    alpha = np.linalg.solve(kernel + 1e-3 * len(rows) * np.eye(len(rows)), target)
    margin = kernel @ alpha
    odds = np.exp(6.0 * (margin - margin.max(1, keepdims=True)))
    odds /= odds.sum(1, keepdims=True)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(frame, model).collect()}
    for r, o in zip(rows, odds):
        assert got[r.doc_id][0] == model.languages[o.argmax()] and abs(got[r.doc_id][1] - o.max()) < 0.01


def test_tails_against_plain_sums(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", ordinal_quality.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    model = ordinal_quality.fit(documents, labels)
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "a b"), (2, "der Hund " * 50), (2, "der Hund " * 50)], "doc_id BIGINT, text STRING").withColumn("grade", F.lit("clash"))
    hasher = ordinal_quality.WordHasher()
    expected = []
    for r in odd.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        words, grams = next(ordinal_quality._cells(data, np.array([0, len(data)]), hasher))
        score = sum(float(model.words[w]) for w in words) + (sum(float(model.grams[g]) for g in grams) / len(grams) if len(grams) else 0.0)
        expected.append((str(r.doc_id), *(round(1 / (1 + np.exp(t - score)), 5) for t in model.thresholds)))
    assert sorted((str(r.doc_id), round(r.tail_1, 5), round(r.tail_2, 5)) for r in ordinal_quality.rate(odd, model).collect()) == sorted(expected)
    assert np.all(np.diff(model.thresholds) > 0)
    assert ordinal_quality.rate(odd.where("false"), model).count() == 0
    nothing = ordinal_quality.fit(documents.where("false"), labels)
    assert [r.tail_2 for r in ordinal_quality.rate(odd.limit(1), nothing).collect()] == [0.5]


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    """Names that the stages use inside, nulls, ties and repeated rows."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 30")
    docs = docs.unionByName(docs.where("doc_id < 3")).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    names = ["carried_text", "row", "score", "lang_pred", "removed", "n_lines", "gone_id", "component_id", "item_id"]
    docs = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir))
        assert docs.columns[-len(names) :] == names and 0 < docs.count() <= before, name
        assert [tuple(r) for r in docs.select(*names).distinct().collect()] == [tuple(range(len(names)))], name
    assert docs.where("doc_id IS NULL").count() == 1 and docs.where("text IS NULL").count() == 0
