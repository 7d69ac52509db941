import importlib

import pytest

import corpus_pipeline
from lodestone.llm import lexical_packing, nb_svm, personal_data, set_join, toxicity
from lodestone.llm.registry import table

FOLDER = "/root/testdata/sf0.01"


def _rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_stages_are_those_of_the_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality", "near_copies", "personal_data", "packing",
    ]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_the_stages_done_by_hand(spark):
    """Models are fitted on what each stage gets; decisions are then made row by row."""
    labels = table(spark, FOLDER, "labels")
    docs = table(spark, FOLDER, "documents")
    rows = [r.asDict() for r in docs.collect()]

    scorer = toxicity.Scorer(toxicity.fit_on(docs, labels))
    rows = [r for r in rows if scorer.scores([r["text"]])[0] < 0.3]
    docs = spark.createDataFrame(rows, docs.schema)

    model = nb_svm.fit_on(docs, labels)
    rows = [r for r in rows if model.score(r["text"]) >= 0.7]
    docs = spark.createDataFrame(rows, docs.schema)

    sets = {r["doc_id"]: set_join.Shingler().set_of(r["text"]) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = {}
    for i, s in sorted(sets.items()):
        seen = {j for x in s.tolist() for j in having.get(x, ())}
        for j in seen:
            if set_join.linked(s, sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s.tolist():
            having.setdefault(x, []).append(i)
    rows = [r for r in rows if find(r["doc_id"]) == r["doc_id"]]
    docs = spark.createDataFrame(rows, docs.schema)

    classifier = personal_data.learn(docs)
    for r in rows:
        base = personal_data.base_spans(r["text"])
        text = personal_data.masked(r["text"], base + personal_data.added_spans(r["text"], base, classifier))
        if text != r["text"]:
            r["text"], r["n_chars"] = text, len(text)

    got = corpus_pipeline.run(spark, FOLDER).collect()
    pieces = {}
    for p in got:
        pieces.setdefault(p["doc_id"], []).append(p)
    coder = lexical_packing.byte_coder(None, None)
    assert set(pieces) == {r["doc_id"] for r in rows}
    for r in rows:
        total = len(coder.encode(r["text"])) + 1
        assert {p["doc_tokens"] for p in pieces[r["doc_id"]]} == {total}
        assert sum(p["length"] for p in pieces[r["doc_id"]]) == total
    assert sum(p["length"] for p in got) == sum(len(coder.encode(r["text"])) + 1 for r in rows)


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows_pass_every_stage(spark, documents_of, stage, tmp_path):
    texts = [None, "", "the same five words and more of them here", "the same five words and more of them here"]
    docs = documents_of([*texts, (None, "a text without an id"), "mail me at a.b@c.org " * 400])
    docs = docs.withColumnRenamed("lang", "score").withColumnRenamed("source", "masked text 2")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    name, function = corpus_pipeline.STAGES[stage]
    found = function(spark, docs, str(tmp_path))
    rows = found.collect()
    if stage < 4:
        assert found.columns == docs.columns
    if name in ("toxicity", "personal_data"):
        assert len(rows) == 6
    if name == "near_copies":
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [
            (False, 0), (False, 1), (False, 2), (False, 5), (True, 0),
        ]
    if name == "personal_data":
        changed = next(r for r in rows if r["doc_id"] == 5)
        assert "@" not in changed["text"] and changed["n_chars"] == len(changed["text"])
    assert function(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_the_entry_registers_one_query_for_each_operator():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
