"""Groups of the n-gram join: what chance shares stays apart, and one large cluster is joined by its differences."""

import itertools
import random

import numpy as np
import pytest

from casewright.llm import ngram_join


def linked(a, b, percent):
    both = len(np.intersect1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def drawn(rng, n):
    return np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))


def test_a_gram_shared_by_chance_connects_nothing(spark, tmp_path, monkeypatch):
    """Twenty clusters, each sharing one rare n-gram with the next, were one group of twenty times the size."""

    def blocks(*_):
        raise AssertionError("no cluster is larger than the limit")

    monkeypatch.setattr(ngram_join, "_block_links", blocks)
    rows = []
    for i in range(20):
        base = " ".join(f"w{i}n{k}" for k in range(120))
        rows += [(3 * i, base), (3 * i + 1, f"{base} x{i} y{i} z{i}"), (3 * i + 2, f"{base} x{i - 1} y{i - 1} z{i - 1}")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    found = ngram_join.near_groups(spark.read.parquet(path), limit=1000).select("doc_id", "component_id", "n_shingles").collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i - i % 3 for i in range(60)}
    assert {r.n_shingles for r in found} == {118, 121}


@pytest.mark.parametrize("percent", [34, 50, 70, 80, 90, 95, 99, 100])
def test_sets_that_link_have_a_mark_in_common(percent):
    """Whichever n-gram alone they share in their prefixes, sets of bands at any place of their range, with empty parts or not."""
    rng, pick = np.random.default_rng(percent), random.Random(percent)
    pairs = 0
    for _ in range(1500):
        a = drawn(rng, pick.choice([1, 2, 4, 7, 9, 10, 12, 19, 20, 31, 64, 250, 400]))
        rate = pick.random() * (100 - percent) / 100
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rate], drawn(rng, pick.randint(0, 1 + int(len(a) * rate)))]))
        if len(b) and not np.array_equal(a, b) and linked(a, b, percent):
            pairs += 1
            one = np.intersect1d(a, b)[:1]
            assert len(np.intersect1d(ngram_join._marks(a, one, percent), ngram_join._marks(b, one, percent)))
    assert pairs > 50 or percent > 95


@pytest.mark.parametrize("percent", [80, 90])
def test_a_large_cluster_is_joined_by_its_differences(monkeypatch, percent):
    """The tree of 300 near copies held nearly all their n-grams, each of which every copy met."""
    rng, edges = np.random.default_rng(1), []

    class Tree(ngram_join.PrefixTree):
        def __init__(self, *given):
            super().__init__(*given)
            edges.append(len(self.edge))

    monkeypatch.setattr(ngram_join, "PrefixTree", Tree)
    base, common = drawn(rng, 400), drawn(rng, 50)
    sets = [np.unique(np.concatenate([base[rng.random(400) > rate], rng.choice(common, 3), drawn(rng, int(rate * 400))])) for rate in rng.random(300) / 8]
    found = ngram_join.tree_links(sets, list(range(300)), np.ones(300, bool), percent)
    assert 10 * edges[0] < sum(map(len, sets))
    component = list(range(300))
    for a, b in found:
        assert linked(sets[a], sets[b], percent) and component[a] != component[b]
        component = [component[a] if c == component[b] else c for c in component]
    assert not any(linked(sets[a], sets[b], percent) for a, b in itertools.combinations(range(300), 2) if component[a] != component[b])
    assert 1 < len(set(component)) < 300 or percent == 80


@pytest.mark.parametrize("percent", [1, 34, 60, 80, 90, 100])
def test_links_of_mixed_groups(percent):
    """Several clusters in a group, sets joined from the start, and sets that are not matched."""
    rng, pick = np.random.default_rng(percent), random.Random(percent)
    for _ in range(40):
        bases = [drawn(rng, pick.choice([1, 5, 20, 60])) for _ in range(pick.randint(1, 3))]
        sets = [np.unique(np.concatenate([b[rng.random(len(b)) > pick.random() / 5], rng.choice(bases[0], 2), drawn(rng, pick.randint(0, 3))])) for b in pick.choices(bases, k=25)]
        labels, probes = [pick.randint(0, 15) for _ in sets], rng.random(25) < 0.7
        known = {(a, b) for a, b in itertools.combinations(range(25), 2) if (probes[a] or probes[b]) and linked(sets[a], sets[b], percent)}
        found = {tuple(sorted(map(int, x))) for x in ngram_join.tree_links(sets, labels, probes, percent)}
        assert found <= known

        def grouped(links, labels=tuple(labels)):
            for a, b in links:
                labels = tuple(labels[a] if x == labels[b] else x for x in labels)
            return {frozenset(i for i, x in enumerate(labels) if x == y) for y in labels}

        assert grouped(found) == grouped(known)
