import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgraph.operators import clustering as C
from tests import data as D


def labels(df, column, key="seq"):
    return [r[column] for r in df.orderBy(key).collect()]


def test_three_people_stay_three(spark):
    rng = np.random.default_rng(0)
    rows = np.repeat(np.eye(8)[:3], 4, axis=0) + 0.05 * rng.normal(size=(12, 8))
    found = labels(C.two_stage_clusters(D.frame(spark, rows), min_cluster_size=1), "label")
    assert D.same_partition(found, [0] * 4 + [1] * 4 + [2] * 4)
    assert found[0] == 0 and found[4] == 1 and found[8] == 2


def test_split_leaders_are_rejoined(spark):
    rows = D.frame(spark, [[1, 0, 0, 0], [0.42, 0.9075, 0, 0], [0.42, 0.797, 0.434, 0]])
    apart = C.two_stage_clusters(rows, min_cluster_size=1, merge_threshold=None)
    together = C.two_stage_clusters(rows, min_cluster_size=1)
    assert len(set(labels(apart, "label"))) == 2
    assert len(set(labels(together, "label"))) == 1


def test_small_clusters_are_noise_and_empty_stays_empty(spark):
    rows = D.frame(spark, [[1, 0, 0], [1, 0.01, 0], [0, 0, 1]])
    assert labels(C.two_stage_clusters(rows, min_cluster_size=2), "label") == [0, 0, -1]
    assert C.cluster_count(C.two_stage_clusters(rows, min_cluster_size=2)).first()[0] == 1
    assert C.two_stage_clusters(rows.filter("seq < 0")).count() == 0
    assert C.similarity_components(rows.filter("seq < 0")).count() == 0


@pytest.mark.parametrize("seed", [3])
def test_pairs_and_components_equal_brute_force(spark, seed):
    rows = D.clustered(seed, 60, copies=30)  # a third of the rows are exact copies
    df = D.frame(spark, rows)
    u = D.unit(rows)
    s = np.round(u @ u.T, 12)
    want = {(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if s[i, j] >= 0.8}
    got = C.similar_pairs(df, 0.8, block_rows=25).collect()
    assert {(r.src, r.dst) for r in got} == want and len(got) == len(want)
    assert labels(C.similarity_components(df, 0.8, block_rows=25), "component") == D.components(rows, 0.8)


def test_component_edges_stay_few_in_a_dense_block(spark):
    df = D.frame(spark, np.ones((200, 4)))
    edges = C.component_edges(df, 0.9, block_rows=50)
    blocks = 4 * 5 / 2 + 10  # more blocks than pairs of them would need; hash blocks are uneven
    assert edges.count() <= 200 * blocks
    assert set(labels(C.similarity_components(df, 0.9, block_rows=50), "component")) == {0}


def test_long_chain_is_one_component(spark):
    angle = np.arange(100) * 0.05
    df = D.frame(spark, np.stack([np.cos(angle), np.sin(angle), np.linspace(0, 9, 100)], axis=1))
    edges = spark.range(99).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert set(labels(C.connected_components(df, edges), "component")) == {0}


@pytest.mark.parametrize("seed", [3])
def test_leaders_equal_sequential_pass(spark, seed):
    rows = D.clustered(seed, 60, noise=0.9, copies=30)
    rows[7] = 0  # a zero vector leads itself
    df = D.frame(spark, rows)
    want = D.leaders(rows, 0.6)
    # heads of 8 rows force many rounds
    assert labels(C.greedy_leader_clusters(df, 0.6, chunk_rows=8), "leader") == want
    assert labels(C.greedy_leader_clusters(df, 0.6, chunk_rows=40, broadcast_bytes=0), "leader") == want


def test_grouped_leaders_with_a_hot_and_a_null_group(spark):
    rows = D.clustered(5, 80, noise=0.8)
    group = [None if i % 7 == 0 else (1 if i % 3 else i % 5) for i in range(len(rows))]
    df = D.frame(spark, rows, person_id=group)
    got = {r.leader for r in C.grouped_leaders(df, "person_id", 0.6, id_col="seq", strict=True, chunk_rows=6).collect()}
    want = set()
    for g in set(group):
        members = [i for i, x in enumerate(group) if x == g]
        lead = D.leaders(rows[members], 0.6, strict=True)
        want |= {members[k] for k in range(len(members)) if lead[k] == k}
    assert got == want


@pytest.mark.parametrize("seed", [3])
def test_average_linkage_equals_one_merge_at_a_time(spark, seed):
    rows = D.clustered(seed, 24, noise=1.0, copies=8)
    want = D.average_linkage(rows, 0.3)
    df = D.frame(spark, rows)
    got = {r.seq: r.merged for r in C.average_linkage(df, 0.3, id_col="seq", broadcast_bytes=0).collect()}
    assert D.same_partition([want[i] for i in sorted(got)], [got[i] for i in sorted(got)])


@pytest.mark.parametrize("seed", [1])
def test_two_stages_equal_sequential(spark, seed):
    rows = D.unit(D.clustered(seed, 40, noise=1.0))
    lead = D.leaders(rows, 0.7)
    ids = sorted(set(lead))
    sums = np.stack([rows[[i for i, x in enumerate(lead) if x == k]].sum(axis=0) for k in ids])
    merged = D.average_linkage(sums, 0.4)
    want = [merged[ids.index(x)] for x in lead]
    got = C.two_stage_clusters(D.frame(spark, rows), min_cluster_size=1, threshold=0.7, merge_threshold=0.4)
    assert D.same_partition(labels(got, "label"), want)


def test_linkage_searches_only_what_changed(spark, monkeypatch):
    rows = D.clustered(11, 24)
    searched, search = [], C.nearest_partner

    def counted(partners, rows, *args, **options):
        searched.append((rows.count(), partners.count()))
        return search(partners, rows, *args, **options)

    monkeypatch.setattr(C, "nearest_partner", counted)
    got = {r.seq: r.merged for r in C.average_linkage(D.frame(spark, rows), 0.3, id_col="seq").collect()}
    assert len(set(got.values())) < len(rows)
    assert len(searched) > 2 and searched[0][0] == searched[0][1]
    assert all(n <= p for n, p in searched[1:]) and sum(n for n, _ in searched[1:]) < sum(p for _, p in searched[1:])


@pytest.mark.parametrize("task_rows", [0, 12])
def test_last_rounds_of_linkage_in_one_task(spark, monkeypatch, task_rows):
    rows = D.clustered(3, 24, noise=1.0, copies=8)
    searched, search = [], C.nearest_partner
    monkeypatch.setattr(C, "nearest_partner", lambda *a, **k: searched.append(1) or search(*a, **k))
    monkeypatch.setattr(C, "FIRST_ROUNDS", 1)
    want = D.average_linkage(rows, 0.3)
    got = {r.seq: r.merged for r in C.average_linkage(D.frame(spark, rows), 0.3, id_col="seq", task_rows=task_rows).collect()}
    assert D.same_partition([want[i] for i in sorted(got)], [got[i] for i in sorted(got)])
    assert all(got[i] == min(k for k in got if got[k] == got[i]) for i in got)
    assert len(searched) > 2 if task_rows == 0 else len(searched) <= 2


def test_small_blocks_do_not_multiply_parts(spark, monkeypatch):
    rows = D.clustered(5, 300)
    made, parts_of = [], C.K.parts_of
    monkeypatch.setattr(C.K, "parts_of", lambda df, n, key: made.append(n) or parts_of(df, n, key))
    pairs = C.similar_pairs(D.frame(spark, rows), 0.5, block_rows=2)
    unit = D.unit(rows)
    s = np.round(unit @ unit.T, 12)
    assert {(r.src, r.dst) for r in pairs.collect()} == {(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.5}
    assert made[0] <= C.K.MOST_PARTS + 1
