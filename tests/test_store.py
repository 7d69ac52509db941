import pytest

from lodestone.errors import NavigationError
from lodestone.sources.schema import DOCUMENTS
from lodestone.sources.store import CHUNKS, IndexStore, bucket_of


def _frames(spark, key):
    row = {"collection_id": "c", "source_id": "s", "document_key": key, "display_path": key}
    return {
        "documents": spark.createDataFrame([row], DOCUMENTS),
        "chunks": spark.createDataFrame([], CHUNKS),
    }


def _commit(store, spark, key):
    frames = _frames(spark, key)
    touched = [r.b for r in frames["documents"].select(bucket_of(store.buckets).alias("b")).collect()]
    store.commit(frames, touched, {}, [], 0)


def _keys(spark, path):
    return {r.document_key for r in IndexStore(spark, path).table("documents").collect()}


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    path = str(tmp_path / "index")
    first, second = IndexStore(spark, path), IndexStore(spark, path)
    _commit(first, spark, "a.md")
    with pytest.raises(NavigationError, match="changed meanwhile"):
        _commit(second, spark, "b.md")
    assert _keys(spark, path) == {"a.md"}
    _commit(IndexStore(spark, path), spark, "b.md")
    assert _keys(spark, path) == {"a.md", "b.md"}


def test_a_failure_midway_leaves_the_index_whole(spark, tmp_path):
    path = str(tmp_path / "index")
    _commit(IndexStore(spark, path), spark, "a.md")
    store, frames = IndexStore(spark, path), _frames(spark, "b.md")
    frames["chunks"] = frames["documents"].selectExpr("raise_error('lost') as content", "*")
    with pytest.raises(Exception, match="lost"):
        store.commit(frames, list(range(64)), {}, [], 0)
    assert _keys(spark, path) == {"a.md"}
    _commit(IndexStore(spark, path), spark, "c.md")
    assert _keys(spark, path) == {"a.md", "c.md"}
