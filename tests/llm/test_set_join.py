import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import set_join as sj
from lodestone.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """(id, size, component) of every row, from all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    having = defaultdict(list)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in having[x])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in s:
            having[x].append(i)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    return sorted((d, len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows))


def found(frame):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in frame.collect())


def variants(seed, groups=25):
    """Groups of texts of many sizes, one to many words changed from each other."""
    r = random.Random(seed)
    rows = []
    passage = " ".join(f"p{i}" for i in range(60))
    for g in range(groups):
        n = r.choice([1, 3, 4, 5, 6, 8, 9, 12, 13, 20, 30, 60, 150, 400])
        base = [f"g{g}w{r.randint(0, n * 2)}" for _ in range(n)]
        for _ in range(r.randint(1, 7)):
            words = base[:]
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, n // 20])):
                at = r.randint(0, len(words))
                words[at : at + r.randint(0, 2)] = [f"x{r.randint(0, 10**6)}"] * r.randint(0, 2)
            if r.random() < 0.3:
                words = [*words, *passage.split()]
            rows.append(" ".join(words).upper() if r.random() < 0.1 else " ".join(words))
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, documents_of, seed):
    rows = variants(seed)
    assert found(sj.join_sets(documents_of(rows).repartition(4))) == brute(rows)


def test_chains_are_one_component(spark, documents_of):
    """Neighbours in a chain link, its ends do not."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[i * 10 : i * 10 + 200])) for i in range(20)]
    got = found(sj.join_sets(documents_of(rows)))
    assert got == brute(rows)
    assert {c for _, _, c in got} == {81}


def test_the_threshold_itself_links(spark, documents_of):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "q r s t u v w x y"), (4, "q r s t u v w z z")]
    assert found(sj.join_sets(documents_of(rows))) == [(1, 4, 1), (2, 5, 1), (3, 5, 3), (4, 5, 4)]


def test_odd_rows(spark, documents_of):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "é\x1fx"), (7, "É\x1fx"), (8, "one")]
    docs = documents_of([*rows, (8, "one")]).withColumnRenamed("lang", "signature").withColumnRenamed("source", "node")
    got = found(sj.join_sets(docs))
    assert got == sorted([*brute(rows), (8, 1, 4)])
    nulls = sj.join_sets(documents_of([(None, "a b"), (None, None), (3, "a b"), (4, "a b")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in nulls) == [
        (0, 0, 0), (0, 1, 0), (3, 1, 3), (4, 1, 3),
    ]
    assert found(sj.join_sets(documents_of(rows).limit(0))) == []


def test_large_group_of_near_copies(spark, documents_of):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: i % 100], f"n{i}", *base[i % 100 :]])) for i in range(300)]
    rows += [(1000 + i, " ".join(base[:60] + [f"m{i}k{j}" for j in range(60)])) for i in range(40)]
    assert found(sj.join_sets(documents_of(rows).repartition(5))) == brute(rows)


def test_linked_sets_share_a_signature():
    """For every size and any order of subsets, up to the bound of differences."""
    r = np.random.default_rng(3)
    for counts in (np.zeros(sj.COUNT_BINS, np.int64), r.integers(0, 9, sj.COUNT_BINS)):
        signer = sj.Signer(counts, 0.2)
        for size in [*range(4, 70), 100, 127, 128, 255, 400, 1000]:
            for _ in range(6):
                x = r.integers(0, 2**63, size * 2, dtype=np.uint64)
                a = np.unique(x[:size])
                drop = int(r.integers(0, size // 5 + 1))
                b = np.unique(np.r_[a[drop:], x[size : size + int(r.integers(0, size // 5 + 1))]])
                if sj.linked(a, b) and not np.array_equal(a, b):
                    assert np.isin(signer.signatures(a), signer.signatures(b)).any()


def test_sparse_sets_fall_back_to_further_hashings(monkeypatch):
    monkeypatch.setattr(sj, "allocate", lambda low, crowded: sj.Band(low, max(2, low // 3), False))
    r = np.random.default_rng(4)
    signer = sj.Signer(np.zeros(sj.COUNT_BINS, np.int64), 0.2)
    for size in (8, 11, 16, 31):
        for _ in range(40):
            a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
            b = a[1:]
            assert sj.linked(a, b) and np.isin(signer.signatures(a), signer.signatures(b)).any()


def test_parities_never_exceed_differences():
    r = np.random.default_rng(5)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 60, 40, dtype=np.uint64) << np.uint64(20)) for _ in range(2))
        apart = int(np.bitwise_count((sj.parities(a) ^ sj.parities(b)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_query(spark, sample_documents):
    assert found(QUERIES["op7_shingle_join"](spark, FOLDER)) == brute(sample_documents)
