import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import graph, joins, similarity


def flip(bits, places):
    return "".join(("1" if b == "0" else "0") if i in places else b for i, b in enumerate(bits))


def hashes(n_bits, n, seed, zeros):
    """Random hashes, near copies, and many that share an all-zero corner."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        half = n_bits // 2
        b = "0" * half + "".join(rng.choice("01") for _ in range(n_bits - half)) if i < zeros else "".join(rng.choice("01") for _ in range(n_bits))
        out.append(b)
        if i % 5 == 0:
            out.append(flip(b, rng.sample(range(n_bits), rng.randint(0, 12))))
    return out


def distance(a, b):
    return sum(x != y for x, y in zip(a, b))


@pytest.mark.parametrize("n_bits,t,bucket_rows", [(256, 10, 2000), (256, 10, 5), (56, 3, 4), (20, 2, 3)])
def test_near_pairs_match_brute_force(spark, n_bits, t, bucket_rows):
    hs = hashes(n_bits, 60, 7, 30)
    df = spark.createDataFrame(list(enumerate(hs)), "image_id long, bits string")
    got = {(r.a, r.b): r.hamming for r in similarity.near_hashes(df, n_bits, t, bucket_rows).collect()}
    distinct = sorted(set(hs))
    want = {(a, b): distance(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1:] if distance(a, b) <= t}
    assert got == want and want


@pytest.mark.parametrize("bucket_rows", [2000, 4])
def test_near_semi_matches_brute_force(spark, bucket_rows):
    hs = hashes(256, 60, 3, 30)
    pool, held = list(enumerate(hs[::2])), list(enumerate(hs[1::2]))
    p = spark.createDataFrame(pool, "image_id long, bits string")
    h = spark.createDataFrame(held, "image_id long, bits string")
    got = {r.image_id for r in similarity.near_semi(p, h, 256, 10, bucket_rows).collect()}
    assert got == {i for i, b in pool if any(distance(b, c) <= 10 for _, c in held)} and got


def test_hot_copies_stay_linear(spark):
    """A third of the rows are copies of one image: edges grow with the rows, not with their square."""
    rows = [(i, "1" * 256 if i < 300 else format(random.Random(i).getrandbits(256), "0256b")) for i in range(900)]
    df = spark.createDataFrame(rows, "image_id long, bits string")
    e = similarity.near_pairs(df, 256, 10)
    assert e.count() == 299 and e.where("copies_a = 300 and id_a = 0").count() == 299


def test_pair_totals_match_listing(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("01") for _ in range(56)) for _ in range(12)]
    rows = []
    for i in range(80):
        b = base[i % 12]
        bits = flip(b, rng.sample(range(56), rng.choice([0, 0, 1, 2])))
        rows.append((i, bits, f"d{rng.randint(0, 30)}", f"s{i % 3}", i % 2, f"L{i % 7}" if i % 4 else "", ""))
    df = spark.createDataFrame(rows, "image_id long, bits string, sha256 string, source string, label int, lesion_id string, patient_id string")
    got = similarity.pair_totals(df, 56, 3).first().asDict()
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1:] if distance(a[1], b[1]) <= 3 or a[2] == b[2]]
    assert got == {
        "pairs_total": len(pairs), "pairs_exact_sha256": sum(a[2] == b[2] for a, b in pairs), "pairs_near_only": sum(a[2] != b[2] for a, b in pairs),
        "pairs_cross_source": sum(a[3] != b[3] for a, b in pairs), "pairs_within_source": sum(a[3] == b[3] for a, b in pairs),
        "pairs_label_conflict": sum(a[4] != b[4] for a, b in pairs),
        "pairs_different_lesion_id": sum(not (a[5] and a[5] == b[5]) for a, b in pairs)}


def find_components(edges, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)]
    edges += [(rng.randint(300, 500), rng.randint(300, 500)) for _ in range(120)]
    nodes = list(range(0, 510))
    e = spark.createDataFrame(edges, "src long, dst long")
    n = spark.createDataFrame([(x,) for x in nodes], "node long")
    assert {r.node: r.component for r in graph.components(e, n).collect()} == find_components(edges, nodes)


def test_blank_ids_never_link_and_conflicts_exclude_all(spark):
    rows = [("a", "", "", "x"), ("b", "", "", "x"), ("c", "P1", "", ""), ("d", "P1", "L1", ""), ("e", "", "L1", "")]
    df = spark.createDataFrame(rows, "image_id string, patient_id string, lesion_id string, dup_cluster string")
    got = {r.image_id: r.group_id for r in graph.link_groups(df, ["patient_id", "lesion_id"]).collect()}
    assert got == {"a": "ga", "b": "gb", "c": "gc", "d": "gc", "e": "gc"}
    d = spark.createDataFrame([("a", "s", 0), ("b", "s", 0), ("c", "s", 1), ("d", "s", 1), ("e", "s", 1)], "image_id string, source string, label int")
    comp = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e")], "image_id string, component string")
    got = {r.image_id: (r.action, r.dup_cluster) for r in graph.decide_clusters(d, comp).collect()}
    assert got == {**{k: ("exclude_label_conflict", "dupa") for k in "abc"}, "d": ("keep", ""), "e": ("keep", "")}


def test_isolate_test_keeps_test_rows(spark):
    df = spark.createDataFrame([("a", "T", "g1"), ("b", "D", "g1"), ("c", "D", "g2")], "image_id string, source string, group_id string")
    assert {r.image_id for r in graph.isolate_test(df, ["T"]).collect()} == {"a", "c"}


def test_exact_far_copy_keeps_zero_distance(spark):
    rows = [(1, "0" * 56, "d"), (2, "1" * 56, "d"), (3, "0" * 55 + "1", "e")]
    df = spark.createDataFrame(rows, "image_id long, bits string, sha256 string")
    got = {tuple(r) for r in similarity.duplicate_edges(df, 56, 3).collect()}
    assert got == {(1, 2, 0), (1, 3, 1)}
    assert similarity.nearest_histogram(df, 56, 3).where(F.col("min_hamming") == 4).first().images == 1


@pytest.fixture
def plain_shuffles(spark):
    """Sixteen partitions that nothing merges, splits or broadcasts away."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.usefixtures("plain_shuffles")
def test_hot_key_is_spread_over_the_tasks(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 900).cast("long").alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).where("k <> 5")
    got = joins.spread_join(rows, facts, "k", "n")
    sizes = sorted(r[1] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    want = rows.join(facts, "k")
    assert got.exceptAll(want.select(*got.columns)).isEmpty() and got.count() == want.count()
    kept = joins.spread_join(rows, facts, "k", "n", keep_all=True)
    assert kept.count() == 40_000 and kept.where("n is null").select("k").distinct().collect() == [(5,)]


@pytest.mark.usefixtures("plain_shuffles")
def test_star_of_half_the_rows(spark):
    rng = random.Random(11)
    edges = [(3000, i) for i in range(1000)] + [(rng.randint(0, 2999), rng.randint(0, 2999)) for _ in range(1000)]
    e = spark.createDataFrame(edges, "src long, dst long").repartition(4)
    want = find_components(edges, {x for p in edges for x in p})
    got = {r.node: r.component for r in graph.components(e).collect()}
    assert got == {k: v for k, v in want.items() if k != v or sum(x == v for x in want.values()) > 1}


def test_contraction_keeps_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 7)
    rng = random.Random(12)
    edges = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(45)]
    df = spark.createDataFrame([(max(p), min(p)) for p in edges if p[0] != p[1]], "hi string, lo string")
    small = [tuple(r) for r in graph.contract(df.coalesce(2)).collect()]
    nodes = {x for p in edges for x in p}
    assert find_components(small, nodes) == find_components(edges, nodes) and all(hi > lo for hi, lo in small)
    assert graph.components(spark.createDataFrame([], "src string, dst string")).collect() == []
