import zlib

import numpy as np
import pytest

from lodestone.llm import nb_svm, samples, toxicity
from lodestone.llm.registry import QUERIES, table

LEARNT = "/root/testdata/sf0.1"
FOLDER = "/root/testdata/sf0.001"


def _auc(scores, labels):
    rank = np.argsort(np.argsort(scores))
    ones = labels == 1
    return (rank[ones].mean() - (ones.sum() - 1) / 2) / (~ones).sum()


def test_held_out_rows_are_by_crc32(spark):
    got = spark.range(50).withColumnRenamed("id", "doc_id")
    got = got.select("doc_id", samples.held_out(got.doc_id).alias("held_out")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_sample_is_bounded_balanced_and_leaves_out_held_rows(spark, documents_of):
    docs = documents_of([f"text {i}" for i in range(300)])
    labels = spark.range(300).selectExpr("id as doc_id", "cast(id % 3 = 0 as int) as toxic")
    rows = samples.labelled_sample(docs, labels, "toxic", 60).collect()
    assert len(rows) == 60 and sum(r["label"] for r in rows) == 30
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 for r in rows)
    assert all(r["label"] == int(r["doc_id"] % 3 == 0) for r in rows)


@pytest.mark.parametrize(
    "name,target,least,threshold",
    [("op6_quality", "quality", 0.99, 0.7), ("op4_toxicity", "toxic", 0.9, 0.3)],
)
def test_held_out_accuracy(spark, name, target, least, threshold):
    got = QUERIES[name](spark, LEARNT)
    docs = table(spark, LEARNT, "documents")
    assert got.count() == docs.count()
    assert [c for c in got.columns] == ["doc_id", "held_out", "score", "predicted"]
    marked = got.join(table(spark, LEARNT, "labels"), "doc_id").where("held_out").toPandas()
    assert marked["score"].between(0, 1).all()
    assert (marked["predicted"] == (marked["score"] >= threshold)).all()
    assert _auc(marked["score"].to_numpy(), marked[target].to_numpy()) > least


@pytest.mark.parametrize("module", [nb_svm, toxicity])
def test_odd_tables(spark, documents_of, module):
    docs = documents_of([None, "", "some words", "some words", "x" * 5000 + " y"]).withColumnRenamed("lang", "score")
    target = "quality" if module is nb_svm else "toxic"
    nothing = spark.createDataFrame([], f"doc_id long, {target} int")
    one_kind = spark.createDataFrame([(2, 1), (3, 1), (None, 1), (0, None)], f"doc_id long, {target} int")
    score = module.score_quality if module is nb_svm else module.score_toxicity
    for labels in (nothing, one_kind):
        model = module.fit_on(docs, labels)
        rows = score(docs, model).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
        by_id = {r["doc_id"]: r["score"] for r in rows}
        assert by_id[2] == by_id[3] and by_id[0] == by_id[1]
        assert score(docs.limit(0), model).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    """The duality gap of the hinge-loss problem closes."""
    r = np.random.default_rng(1)
    rows = [np.unique(r.integers(0, 40, 8)) + 40 * int(i % 2 and r.random() < 0.9) for i in range(80)]
    labels = np.arange(80) % 2
    model = nb_svm.fit(rows, labels, rounds=300)
    assert np.mean([(model.margin(x) > 0) == (y == 1) for x, y in zip(rows, labels, strict=True)]) > 0.85
    ratio = nb_svm.log_count_ratio(rows, labels)
    w = np.divide(model.weights, ratio, out=np.zeros_like(ratio), where=ratio != 0)
    y = 2.0 * labels - 1

    def primal(w, b):
        margins = np.array([w[x] @ (ratio[x] / np.sqrt(len(x))) + b for x in rows])
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * margins).sum()

    best = primal(w, model.bias)
    for _ in range(200):
        assert primal(w + r.normal(0, 0.02, len(w)) * (w != 0), model.bias + r.normal(0, 0.02)) >= best - 1e-6


def test_log_count_ratio_is_of_smoothed_counts():
    ratio = nb_svm.log_count_ratio([np.array([0, 1]), np.array([1, 2])], np.array([1, 0]))
    total = nb_svm.FEATURES + 2
    assert np.allclose(ratio[:4], np.log(np.array([2, 2, 1, 1]) / total) - np.log(np.array([1, 2, 2, 1]) / total))


def test_gradients_are_those_of_the_loss():
    net = toxicity.Network()
    words = ["alpha", "beta", "gamma", "delta"]
    net.known = toxicity.word_inputs(words)[0]
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    at, lengths = np.array([[0, 1, 2], [3, 1, 0]]), np.array([3, 2])
    labels, weights = np.array([1.0, 0.0]), np.array([0.5, 0.5])

    def loss():
        vectors, _ = net.word_vectors(toxicity.word_inputs(words))
        z, _ = net.windows(net.gate_inputs(vectors), at, lengths)
        return float((weights * (np.logaddexp(0, z) - labels * z)).sum())

    vectors, sources = net.word_vectors(toxicity.word_inputs(words))
    found = net.gradients(vectors, sources, at, lengths, labels, weights)
    for name, place in (
        ("u_f", (2, 5)), ("u_b", (1, 20)), ("w_in", (3, 9)), ("b_in", (30,)), ("attend", (4,)),
        ("out", (11,)), ("bias", (0,)), ("word", (int(net.known[1]) % toxicity.WORD_BINS, 2)),
        ("gram", (int(sources[2][3]), 5)),
    ):
        step = 1e-2
        net.p[name][place] += step
        up = loss()
        net.p[name][place] -= 2 * step
        down = loss()
        net.p[name][place] += step
        assert abs((up - down) / (2 * step) - found[name][place]) < 2e-3 * (1 + abs(found[name][place])), name


def test_windows_cover_all_words():
    for n in range(400):
        covered = {i for s in toxicity.window_starts(n) for i in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n))


def test_a_small_memory_changes_no_score():
    net = toxicity.Network()
    texts = ["a b c", "", None, "one two " * 200, "d e f g"]
    all_at_once = toxicity.Scorer(net).scores(texts)
    assert np.allclose(all_at_once, toxicity.Scorer(net, memory=2, together=3).scores(texts), atol=1e-6)
    alone = [toxicity.Scorer(net).scores([t])[0] for t in texts]
    assert np.allclose(all_at_once, alone, atol=1e-6)


def test_runs_without_spaces_are_scored_to_their_end():
    run = "".join(chr(0x4E00 + i) for i in range(100))
    words = toxicity.words_of(f"A {run}b c")
    assert "".join(words) == f"a{run}bc" and max(map(len, words)) == 64
    clean, bad = "的一是不了人我在有他" * 10, "毒恶骂" * 10
    texts = [(clean + (bad if i % 2 else clean[:30])) for i in range(60)]
    documents = [(i % 2, [" ".join(toxicity.words_of(t))]) for i, t in enumerate(texts)]
    scores = toxicity.Scorer(toxicity.train(toxicity.Sample.of(documents))).scores(texts[:2])
    assert scores[0] < 0.3 < 0.7 < scores[1]


def test_training_windows_hold_the_toxic_passage(spark, documents_of, monkeypatch):
    """Wherever it stands in a long document."""
    plain = " ".join(f"word{i % 90}" for i in range(2400))
    texts = [plain if i % 2 else f"{plain[: 500 + 150 * i]} venomous {plain[500 + 150 * i :]}" for i in range(60)]
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda sample, prevalence: seen.append(sample))
    toxicity.fit_on(documents_of(texts), labels)
    (sample,) = seen
    bad = sample.words.index("venomous")
    inside = (sample.at == bad) & (np.arange(toxicity.WINDOW) < sample.lengths[:, None])
    found = set(sample.owner[inside.any(axis=1)].tolist())
    assert found == set(np.flatnonzero(sample.labels).tolist()) and found
    assert np.bincount(sample.owner).max() == toxicity.SAMPLE_WINDOWS


def test_a_sample_has_one_row_of_each_id(spark, documents_of):
    docs = documents_of([(1, f"copy {i:04d}") for i in range(2000)] + [(i, "other") for i in range(2, 40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    rows = samples.labelled_sample(docs, labels, "toxic", 60).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) <= 60
    assert [r["text"] for r in rows if r["doc_id"] == 1] in ([], ["copy 0000"])


def test_feature_numbers_come_back_from_either_form():
    for n in (0, 5, 2047, 2048, 60_000):
        found = np.sort(np.random.default_rng(n).choice(nb_svm.FEATURES, n, replace=False))
        assert nb_svm.unpacked(nb_svm.packed(found)).tolist() == found.tolist()
        assert len(nb_svm.packed(found)) <= nb_svm.FEATURES // 8
