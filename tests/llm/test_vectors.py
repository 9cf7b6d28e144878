"""Operators on embeddings against brute force."""

import math
import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import embed_dedup, tables, topk

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT"


def odd_vectors(spark):
    pick = np.random.default_rng(1)
    rows = []
    for i in range(150):
        base = pick.normal(size=8) if i % 3 else np.ones(8) + pick.normal(scale=0.15, size=8)
        rows.append((i, [float(np.float32(x)) for x in base], None))
    rows += [(200 + k, [float(np.float32(x)) for x in np.ones(8)], 1) for k in range(40)]
    rows += [
        (300, None, None),
        (301, [0.0] * 8, 1),
        (302, [math.nan] + [1.0] * 7, 1),
        (303, [math.inf] + [1.0] * 7, 1),
        (304, [None] + [1.0] * 7, 1),
        (305, [], 1),
        (306, [1.0, 1.0, 1.0], 1),
        (307, [2.0, 2.0, 2.0], 1),
        (200, [float(np.float32(x)) for x in np.ones(8)], 1),
        (308, [1e-30] * 8, 2),
        (309, [1e30] * 8, 2),
    ]
    return rows


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_embedding_links_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rows = odd_vectors(spark)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_links", F.lit("x")).withColumn("v", F.lit(0)).repartition(3)
    found = sorted(map(tuple, embed_dedup.near_duplicate_vectors(df, threshold=0.9).collect()))
    n = len(rows)
    vectors = [np.float32(r[1]).astype(np.float64) if usable(r[1]) else None for r in rows]
    unit = [None if v is None else (v / abs(v).max()) / np.linalg.norm(v / abs(v).max()) for v in vectors]
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]):
                if float(unit[i] @ unit[j]) >= 0.9:
                    links[i].append(j)
    component = [None] * n
    for i in sorted(range(n), key=lambda k: rows[k][0]):
        if component[i] is None:
            stack = [i]
            while stack:
                j = stack.pop()
                if component[j] is None:
                    component[j] = rows[i][0]
                    stack += links[j]
    want = sorted((rows[i][0], len(links[i]), component[i], rows[i][0] == component[i]) for i in range(n))
    assert found == want


def test_empty_and_unusable_embeddings(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert embed_dedup.near_duplicate_vectors(empty).count() == 0
    none = spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], SCHEMA)
    found = sorted(map(tuple, embed_dedup.near_duplicate_vectors(none).collect()))
    assert found == [(1, 0, 1, True), (2, 0, 2, True)]


def folder_bytes(folders):
    total = 0
    for folder in folders:
        for at, _, names in os.walk(folder):
            for name in names:
                try:
                    total += os.lstat(os.path.join(at, name)).st_size
                except OSError:
                    pass
    return total


def test_disk_follows_the_vectors_and_not_the_pairs_of_blocks(spark, monkeypatch, tmp_path):
    n, length = 2000, 64
    monkeypatch.setattr(embed_dedup, "BLOCK", 32)
    made = iter(range(10**6))
    for module in (tables, embed_dedup):
        monkeypatch.setattr(module, "scratch_dir", lambda spark: f"{tmp_path}/{next(made)}", raising=False)
    # No two are near and no box tells blocks apart, so every pair of blocks is compared.
    matrix = np.random.default_rng(3).normal(size=(n, length)).astype(np.float32)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(matrix.tolist())], SCHEMA)
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [*store.localDirsString(), str(tmp_path)]
    before, most, over = folder_bytes(folders), [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            most[0] = max(most[0], folder_bytes(folders) - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        found = embed_dedup.near_duplicate_vectors(df, threshold=0.9).collect()
    finally:
        over.set()
        watcher.join()
    assert sorted(map(tuple, found)) == [(i, 0, i, True) for i in range(n)]
    assert most[0] < 20 * matrix.nbytes


def test_equal_vectors_of_many_tasks_are_one_class(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    pick = np.random.default_rng(4)
    base = pick.normal(size=(20, 8)).astype(np.float32)
    base[0, 0], base[1] = 0.0, base[0]
    base[1, 0] = -0.0
    rows = [(i, [float(x) for x in base[i % 20]], 0) for i in range(400)]
    rows += [(None, [float(x) for x in base[2]], 0), (None, [1.0, 0.0], 0), (2**63 - 1, [1.0, 0.0], 0), (-7, [1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    kept = embed_dedup.written
    frames = []
    monkeypatch.setattr(embed_dedup, "written", lambda frame: frames.append(kept(frame)) or frames[-1])
    found = embed_dedup.near_duplicate_vectors(df, threshold=0.999999)
    got = sorted(map(tuple, found.collect()), key=str)
    first = [i % 20 if i % 20 > 1 else 0 for i in range(400)]
    want = [(i, 39 if first[i] == 0 else 20 if first[i] == 2 else 19, first[i], i == first[i]) for i in range(400)]
    want += [(None, 20, 2, False), (None, 1, 2**63 - 1, False), (2**63 - 1, 1, 2**63 - 1, True), (-7, 0, -7, True)]
    assert got == sorted(want, key=str)
    classes = [frame for frame in frames if "_first" in frame.columns and "node" in frame.columns]
    assert sum(frame.count() for frame in classes) == 19 + 2


def test_coordinates_of_equal_vectors_agree_to_the_last_bit():
    pick = np.random.default_rng(5)
    matrix, axes = pick.normal(size=(1000, 64)), np.linalg.qr(pick.normal(size=(64, 64)))[0][:, :6]
    whole = embed_dedup._lead(matrix, axes)
    assert np.allclose(whole, embed_dedup._unit(matrix) @ axes)
    for rows in (slice(3, 4), slice(17, 40), np.arange(999, 0, -7)):
        assert (embed_dedup._lead(matrix[rows], axes) == whole[rows]).all()


@pytest.mark.parametrize("leading", [4, 12, 24])
@pytest.mark.parametrize("few,many", [(0, 1), (0, 50), (10**9, 50), (40, 10**9)])
def test_links_of_two_blocks_against_all_pairs(monkeypatch, tmp_path, leading, few, many):
    for name, value in (("FEW", few), ("MANY", many), ("PART", 32)):
        monkeypatch.setattr(embed_dedup, name, value)
    pick = np.random.default_rng(6)
    axes = np.linalg.qr(pick.normal(size=(24, 24)))[0]
    sides, units = [], []
    common = pick.normal(size=24)
    for k, n in enumerate((150, 97)):
        rows = np.zeros(n, dtype=embed_dedup._row("<f4", 24))
        rows["vec"] = pick.normal(size=(n, 24))
        rows["vec"][::3] = common + 0.3 * pick.normal(size=rows["vec"][::3].shape)
        rows["n"] = pick.integers(1, 5, n)
        embed_dedup._write_block(str(tmp_path), k, np.arange(n) + 1000 * k, rows, axes)
        sides.append(embed_dedup._Side(open(embed_dedup._path(str(tmp_path), k), "rb").read(), axes, leading, "<f4"))
        units.append(embed_dedup._unit(sides[-1].vectors.astype(np.float64)))
    found = embed_dedup._compare_tile([(0, 0), (0, 1), (1, 1)], sides.__getitem__, math.sqrt(0.2), 0.9)
    unit = np.concatenate(units)
    node, count = (np.concatenate([getattr(side, name) for side in sides]) for name in ("node", "n"))
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    want = {int(v): int(x) for v, x in zip(node, hit @ count) if x}
    links = found[found["kind"] == 0]
    assert dict(zip(links["node"].tolist(), links["other"].tolist())) == want and len(links) == len(want)
    # The ties hang the same vectors together as the links do.
    reach = np.linalg.matrix_power((hit | np.eye(len(hit), dtype=bool)).astype(float), 8) > 0
    assert ((reach.astype(float) @ reach) > 0).astype(int).tolist() == reach.astype(int).tolist()
    least = {int(v): int(node[np.flatnonzero(r)].min()) for v, r in zip(node, reach)}
    up = {v: v for v in least}
    for v, other in found.loc[found["kind"] == 1, ["node", "other"]].itertuples(index=False):
        assert least[v] == least[other]
        up[v] = other
    roots = {v: v for v in up}
    for v in up:
        while up[roots[v]] != roots[v]:
            roots[v] = up[roots[v]]
    assert len(set(roots.values())) == len(set(least.values()))


@pytest.mark.parametrize("k", [1, 10, 500])
def test_top_k_against_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rows = [r for r in odd_vectors(spark) if r[0] not in (308, 309)]
    del rows[-1]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).repartition(3)
    found = sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=k).collect()))
    good = [
        (i, [math.floor(1024 * float(np.float32(x))) for x in v])
        for i, v, _ in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    want = []
    for i, q in good:
        if i % 20 == 0:
            scored = [(sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q)]
            scored.sort(key=lambda s: (-s[0], s[1]))
            want += [(i, rank, j, score) for rank, (score, j) in enumerate(scored[:k], 1)]
    assert found == sorted(want)


def test_top_k_of_nothing_and_of_huge_components(spark):
    assert topk.exact_top_k(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    huge = spark.createDataFrame([(1, [1e30], 1), (2, [1.0], 1)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        topk.exact_top_k(huge, F.lit(True)).collect()


def test_scores_beyond_64_bits_are_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    pick = random.Random(5)
    rows = [(i, [float(pick.choice([-1, 1]) * pick.randint(900_000, 1_000_000)) for _ in range(64)], 0) for i in range(60)]
    rows += [(100, [1e6] * 64, 0), (101, [1e6] * 64, 0), (102, [-1e6] * 64, 0), (103, [0.5] * 64, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=5).collect()))
    whole = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v, _ in rows}
    want = []
    for i in (i for i in whole if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[i], v)), j) for j, v in whole.items() if j != i)
        want += [(i, rank, j, -score) for rank, (score, j) in enumerate(scored[:5], 1)]
    assert found == sorted(want) and max(row[3] for row in found) > 1 << 63


def test_pruning_keeps_the_best():
    pick = np.random.default_rng(2)
    matrix = pick.integers(-900, 900, size=(3000, 40))
    matrix[:, 0] *= 20
    ids, query = pick.permutation(3000), matrix[7]
    frame = topk._tile(ids[7:8], query[None], ids, matrix, 10)
    scores = matrix @ query
    keep = np.flatnonzero(ids != ids[7])
    order = keep[np.lexsort((ids[keep], -scores[keep]))][:10]
    assert frame["vec_id"].tolist() == ids[order].tolist()
    assert frame["score"].tolist() == scores[order].tolist()
