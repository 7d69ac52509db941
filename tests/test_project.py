import json
import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from lodestone import cli, config, render
from lodestone.errors import NavigationError
from lodestone.operators.changes import apply_changes, change_counts, change_set
from lodestone.operators.scopes import scope_condition
from lodestone.plans import indexing
from lodestone.plans.evaluation import run_quality
from lodestone.sources.markdown_dir import _matcher, matching_files
from lodestone.sources.providers import RuntimeOptions
from lodestone.sources.store import IndexStore

# Workers cannot import a test module, so its provider travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class TopicProvider:
    """Three axes: starting up, lifecycle, anything else."""

    fingerprint = "topics-1"

    def __init__(self, _config):
        pass

    def embed(self, texts):
        rows = []
        for text in texts:
            lower = text.lower()
            axis = 2
            if "冷启动" in lower or "cold start" in lower or "startup delay" in lower:
                axis = 0
            elif "lifecycle" in lower:
                axis = 1
            row = [0.05, 0.05, 0.05]
            row[axis] = 1.0
            rows.append(row)
        return np.array(rows)


def write(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as handle:
        handle.write(text)


def search(spark, root, **request):
    return cli.search_rows(spark, root, request, factory=TopicProvider)[0]


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("project"))
    write(root, "docs/scheduler.md", "# Scheduler\n\n## Pool\n\n### Warm-up\nGPU 冷启动 gpu-warmup-42\nends")
    write(root, "docs/lifecycle.md", "# Service\n\n## Lifecycle\n\nlifecycle of a worker")
    write(root, ".hidden/note.md", "# Hidden\n\nsecret garden")
    write(root, "node_modules/x/readme.md", "# Skipped\n\ntext")
    write(root, "docs/other.txt", "not markdown")
    summary = indexing.initialize(spark, root, TopicProvider)
    return root, summary


def test_build_and_search(spark, project):
    root, summary = project
    assert (summary.added, summary.documents, summary.chunks) == (3, 3, 3)
    found = search(spark, root, query="gpu-warmup-42", top=5)
    assert found[0]["path"] == "docs/scheduler.md"
    assert (found[0]["start_line"], found[0]["end_line"]) == (5, 7)
    assert found[0]["heading"] == ["Scheduler", "Pool", "Warm-up"]
    near = search(spark, root, query="startup delay", top=5)
    assert near[0]["path"] == "docs/scheduler.md" and near[0]["vector_rank"] == 1
    assert search(spark, root, query="gpu-warmup-42", path="lifecycle", top=5) == []
    assert search(spark, root, query="secret", path=".\\Hidden"[2:], top=5)[0]["path"] == ".hidden/note.md"
    text = render.as_json(found, explain=True)
    assert json.loads(text)["results"][0]["explanation"]["keyword_rank"] == 1
    assert "docs/scheduler.md" in render.detailed(found, explain=True)


def test_update_follows_content(spark, project):
    root, _ = project
    write(root, "docs/scheduler.md", "# Scheduler\n\nnow about cold start only")
    os.remove(os.path.join(root, "docs/lifecycle.md"))
    write(root, "docs/added.md", "# Added\n\nbrand new words")
    pending = indexing.status(spark, root)
    assert [pending[n] for n in ("added", "modified", "deleted", "unchanged")] == [1, 1, 1, 1]
    assert render.status_text(pending).count("1 added, 1 modified, 1 deleted") == 1
    done = indexing.update(spark, root, TopicProvider)
    assert (done.added, done.modified, done.deleted, done.documents) == (1, 1, 1, 3)
    after = indexing.status(spark, root)
    assert [after[n] for n in ("added", "modified", "deleted", "unchanged")] == [0, 0, 0, 3]
    stale = search(spark, root, query="gpu-warmup-42")
    assert all(row["keyword_rank"] is None for row in stale)
    assert search(spark, root, query="brand new words")[0]["path"] == "docs/added.md"
    chunks = IndexStore(spark, config.index_path(root)).table("chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count()


def test_tags_and_sources_follow_the_config(spark, project):
    root, _ = project
    write(root, "memory/m.md", "# Memory\n\nshared memory words")
    now = config.read_config(root)
    raw = config.config_to_toml(now) + (
        '\n[[sources]]\nid = "memory"\nkind = "markdown-directory"\npath = "memory"\n'
        'include = ["**/*.md"]\ntags = ["Memory"]\n'
    )
    with open(config.config_path(root), "w", encoding="utf-8") as handle:
        handle.write(raw.replace('"**/.git/**"', '"memory/**", "**/.git/**"'))
    indexing.update(spark, root, TopicProvider)
    assert len(search(spark, root, query="shared memory words", tags=["memory"])) == 1
    assert search(spark, root, query="shared memory words", tags=["other"]) == []
    config.write_config(root, now)
    done = indexing.update(spark, root, TopicProvider)
    assert done.deleted == 1 and done.documents == 4


def test_other_provider_is_refused(spark, project):
    root, _ = project
    with pytest.raises(NavigationError) as caught:
        indexing.update(spark, root)
    assert caught.value.code == "EMBEDDING_CONFIG_CHANGED"
    for request, code in (({"query": " "}, "QUERY_EMPTY"), ({"query": "a", "top": 0}, "TOP_INVALID")):
        with pytest.raises(NavigationError) as caught:
            search(spark, root, **request)
        assert caught.value.code == code


def test_quality_run(spark, project, tmp_path):
    root, _ = project
    suite = {
        "version": 1,
        "thresholds": {"positive_recall_at_5": 0.9, "negative_rejection": 0.9, "determinism": 1},
        "cases": [
            {"id": "new", "category": "exact", "query": "brand new words",
             "expected": [{"path": "docs/added.md", "heading": "Added"}]},
            {"id": "none", "category": "negative", "query": "zxqv-9999 unknown"},
        ],
    }
    path = tmp_path / "suite.json"
    path.write_text(json.dumps(suite))
    report = run_quality(spark, root, str(path), TopicProvider)
    assert report.metrics.first().exact_top_1 == 1.0
    assert report.checks.count() == 3


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path)
    write(root, "a.md", "# A\n\nsome plain words")
    assert cli.main(["--root", root, "status"], spark) == 0
    assert cli.main(["--root", root, "update"], spark) == 1
    assert cli.main(["--root", root, "init"], spark) == 0
    assert cli.main(["--root", root, "search", "plain words", "--top", "3"], spark) == 0
    assert cli.main(["--root", root, "search", "x", "--top", "500"], spark) == 1
    assert cli.main(["nonsense"], spark) == 2
    assert cli.main(["--version"], spark) == 0
    out = capsys.readouterr()
    assert "a.md" in out.out and "TOP_INVALID" in out.err and "PROJECT_NOT_INITIALIZED" in out.err
    assert open(os.path.join(root, ".gitignore")).read() == "/.lodestone/\n"


def test_globs(spark, project):
    root, _ = project
    source = config.SourceConfig(id="s", path=".", include=("**/*.{md,txt}",), exclude=("docs/**",))
    found = {r.relative for r in matching_files(spark, source, root).collect()}
    assert ".hidden/note.md" in found and not any(f.startswith("docs/") for f in found)
    assert _matcher(("a/?[!x]*.md",)).fullmatch("a/byz.md")
    assert not _matcher(("a/?[!x]*.md",)).fullmatch("a/bxz.md")


def test_change_set_kinds(spark):
    shape = "source_id string, document_key string, content_hash string"
    new = spark.createDataFrame([("s", "same", "1"), ("s", "mod", "2"), ("s", "add", "3")], shape)
    old = spark.createDataFrame([("s", "same", "1"), ("s", "mod", "0"), ("s", "gone", "4")], shape)
    counts = change_counts(change_set(new, old)).first()
    assert counts.asDict() == {"added": 1, "modified": 1, "deleted": 1, "unchanged": 1}
    assert sorted(apply_changes(old, new).collect()) == sorted(new.collect())


def test_scope_condition(spark):
    assert scope_condition(path="", collection_ids=None, source_ids=[], tags=[]) is None
    rows = [("A\\b.md", "c", "s", ["X"], []), ("a/b_c.md", "c", "t", [], ["x"])]
    frame = spark.createDataFrame(
        rows,
        "display_path string, collection_id string, source_id string, document_tags array<string>, "
        "source_tags array<string>",
    )
    assert frame.filter(scope_condition(path="./a\\B")).count() == 2
    assert frame.filter(scope_condition(path="b_")).count() == 1
    assert frame.filter(scope_condition(tags=["x"], source_ids=["t"])).count() == 1


def test_config_rules():
    now = config.default_config()
    assert now.search.candidate_pool == 100 and now.embedding.max_tokens == 288
    for change in (
        {"vector_weight": 0.0, "keyword_weight": 0.0},
        {"semantic_best_distance": 0.2},
        {"candidate_pool": 5},
        {"candidate_pool": 100.5},
    ):
        with pytest.raises(NavigationError):
            config.SearchConfig(**change)
    raw = {"version": 1, "project_id": now.project_id, "sources": []}
    for bad in (raw, {**raw, "extra": 1}):
        with pytest.raises(NavigationError):
            config.config_from_mapping(bad)


def test_runtime_options():
    assert RuntimeOptions("direct-ort", "org/bge-small-zh").pooling == "cls"
    assert RuntimeOptions("static-ort", "m").dtype == "int8"
    for bad in (
        ("fastembed", "m", "mean"),
        ("direct-ort", "m", "max"),
        ("static-ort", "m", None, "q8"),
        ("static-ort", "m", None, None, "passage: "),
    ):
        with pytest.raises(NavigationError):
            RuntimeOptions(*bad)
