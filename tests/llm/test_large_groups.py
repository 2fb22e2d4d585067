"""Near-copy groups and grids that are large for what the optimiser or one machine expects."""

import corpus_pipeline
import numpy as np
import pytest
from test_dedup import brute_components
from tidemark.llm import components, simhash


def signed(prints):
    return [p - (1 << 64) if p >> 63 else p for p in prints]


def dense(rng, size=60):
    """A base, and texts of up to three changed bits around it, most of them within four bits of each other."""
    base = int(rng.integers(0, 2**64, dtype=np.uint64))
    return [base, *{base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)) for _ in range(size)}]


def test_cells_are_never_broadcast(spark):
    """Some fingerprints are small enough to be sent anywhere, their 66 cells each are not."""
    frame = spark.createDataFrame([(p,) for p in range(0, 1 << 40, 1 << 31)], "fp long").distinct()
    found = simhash.links(frame, 4)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("few", [500_000, 0])
def test_linked_groups_are_those_of_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    rng = np.random.default_rng(11)
    prints = list(dict.fromkeys([*dense(rng), *dense(rng, 20), *rng.integers(0, 2**64, 20, dtype=np.uint64).tolist(), 0]))
    names = signed(prints)
    least = brute_components({n: p for n, p in zip(names, prints)}, 4)
    nodes = spark.createDataFrame([(n, k % 7) for k, n in enumerate(names)], "fp long, n long").repartition(3)
    roots = {r["node"]: r["root"] for r in simhash.linked(nodes, 4).collect()}
    assert {n: roots.get(n, n) for n in names} == least


def test_pairs_of_one_group_do_not_meet_again(spark):
    prints = signed(dense(np.random.default_rng(12)))
    frame = spark.createDataFrame([(p, 1 + (p == prints[0])) for p in prints], "fp long, root long")
    assert {frozenset((r["u"], r["v"])) for r in simhash.links(frame, 4).collect()} == {frozenset((p, prints[0])) for p in prints[1:]}


def test_no_pair_leaves_the_join_in_all_its_cells(spark):
    """At most twice a slab, not once for each of the 33 cells that two fingerprints may share there."""
    prints = signed(dense(np.random.default_rng(13)))
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 4)
    joined = found._jdf.queryExecution().optimizedPlan().children().apply(0)
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, joined).count()
    pairs = found.count()
    assert pairs <= rows <= 4 * pairs


def test_language_stage_names_unlabelled_texts(spark, docs_of):
    rows = [(i, " ".join((["alpha", "beta"] if i % 2 else ["ouzi", "uxoz"])[(i + k) % 2] for k in range(12)), ("aa" if i % 2 else "bb") if i < 40 else None) for i in range(60)]
    rows += [(70, None, None), (71, "12 !", None)]
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs_of(rows), "unused").collect()}
    assert got == {i: "aa" if i % 2 else "bb" for i in range(60)}
