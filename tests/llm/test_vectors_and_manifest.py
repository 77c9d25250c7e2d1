"""Whitening, Merkle manifests and near-duplicate vectors against brute force, and their awkward cases."""

import hashlib
import math
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import merkle, near_vectors, queries, whitening
from meridia.llm.oracles import ORACLES

BAD = [None, [], [0.1, None, 0.3], [float("nan"), 1.0, 2.0], [float("inf"), 0.0, 0.0]]


def vectors(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.withColumns({c: F.lit("x") for c in ("row", "unit", "x", "n", "ball", "label", "component", "size", "homes")}).repartition(3)


# whitening


def test_residues_give_integers_back():
    rng = np.random.default_rng(0)
    x = rng.integers(-(2**40), 2**40, (300, 5))
    moduli = whitening.primes_for(300 * 2**80)
    assert len(set(moduli)) == len(moduli) and math.prod(moduli) > 2 * 300 * 2**80
    found = whitening.remaindered([whitening.modular_scatter(x, p) for p in moduli], moduli)
    wide = x.astype(object)
    assert (found == wide.T @ wide).all()


def test_whitening_equals_exact_fractions(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, [1, 2, 3, 0.5, 4, 1], (200, 6)).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, [float(v) for v in x[0]]), (300, [float(v) for v in x[0]]), (None, [float(v) for v in x[1]])]
    rows += [(400 + i, v) for i, v in enumerate(BAD)] + [(500, [1.0, 2.0])]
    got = whitening.whitened_vectors(vectors(spark, rows)).collect()
    assert len(got) == 4 * 203 and {r.vec_id for r in got} == {*range(200), 300, None}
    whole = np.floor(256 * x.astype(float)).astype(np.int64)
    distinct = np.unique(whole, axis=0)
    n, sums = len(distinct), distinct.sum(0)
    v = [[sum(Fraction(n * int(r[i]) - int(sums[i])) * (n * int(r[j]) - int(sums[j])) for r in distinct) / n**3 for j in range(6)] for i in range(6)]
    values, axes = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    for r in got:
        if r.vec_id in range(200):
            centred = n * whole[r.vec_id] - sums
            want = (centred / n) @ axes[:, -r.component] / math.sqrt(values[-r.component])
            assert math.isclose(abs(r.whitened), abs(want), rel_tol=1e-9, abs_tol=1e-11)
            assert r.deviation == int((centred**2).sum()) and r.n == n
            assert math.isclose(r.explained, values[-r.component] / values.sum(), rel_tol=1e-9)
            assert r.identity_error < 1e-9
    for c in range(1, 5):  # one sign for all rows
        own = {r.vec_id: r.whitened for r in got if r.component == c}
        signs = {np.sign(own[i] * ((n * whole[i] - sums) @ axes[:, -c])) for i in range(200)}
        assert len(signs) == 1


def test_whitening_of_odd_tables(spark):
    assert whitening.whitened_vectors(vectors(spark, [(1, None)])).collect() == []
    assert whitening.whitened_vectors(vectors(spark, [(1, [1.0])]).limit(0)).collect() == []
    one = whitening.whitened_vectors(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.whitened, r.explained, r.n, r.deviation, r.identity_error) for r in one] == [(None, 0.0, 1, 0, None)] * 4
    flat = whitening.whitened_vectors(vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert {r.component: r.whitened is None for r in flat} == {1: False, 2: True, 3: True}
    huge = whitening.whitened_vectors(vectors(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], "double")).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge if r.vec_id < 3)


# near-duplicate vectors


def plain_links(rows, threshold=0.9):
    able = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for a in able:
        for b in able:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a].add(b)
    out = []
    for i, (name, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((name, len(links[i]), least, name == least))
    return sorted(out, key=str)


def turned(rng, base, cosine):
    other = rng.standard_normal(base.shape)
    other -= (other * base).sum(-1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=-1, keepdims=True)
    return cosine * base + np.sqrt(1 - cosine**2) * other


def units(rng, n, dim):
    x = rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_fast_hadamard_is_a_rotation():
    x = np.random.default_rng(2).standard_normal((7, 16))
    y = near_vectors.hadamard(x)
    assert np.allclose((y**2).sum(1), (x**2).sum(1)) and np.allclose(near_vectors.hadamard(y), x)


def test_near_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = units(rng, 150, 20)
    near = np.concatenate([turned(rng, base, rng.uniform(0.87, 0.99, (150, 1))), turned(rng, np.repeat(base[:3], 40, 0), 0.995), turned(rng, np.repeat(base[5:6], 150, 0), rng.uniform(0.9, 1.0, (150, 1)))])
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    rows += [(1000, rows[0][1]), (1000, rows[0][1]), (None, rows[0][1]), (None, [5 * c for c in rows[9][1]]), (1001, [1e-300 * c for c in rows[9][1]]), (1002, [1e300 * c for c in rows[9][1]])]
    rows += [(2000 + i, v) for i, v in enumerate(BAD)] + [(2100, [0.0] * 20), (2101, [0.0] * 3), (2102, [1.0, 0.0, 0.0]), (2103, [1.0, 0.0, 0.1]), (2104, [1.0, 0.0])]
    got = near_vectors.near_vectors(vectors(spark, rows, "double"))
    found, want = sorted([tuple(r) for r in got.collect()], key=str), plain_links([(i, None if v is None else list(np.array(v) / max(map(abs, v)) if v and None not in v and any(v) and all(map(math.isfinite, v)) else v)) for i, v in rows])
    assert len(found) == len(want)
    assert sum(f[1] for f in found) >= 0.99 * sum(w[1] for w in want)
    by_id = {w[0]: w for w in want}
    assert all(f[1] <= by_id[f[0]][1] for f in found if f[0] is not None)
    assert sum(f == w for f, w in zip(found, want)) >= 0.97 * len(want)


def test_recall_at_the_threshold_itself(spark):
    rng = np.random.default_rng(4)
    base = units(rng, 600, 64)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, turned(rng, base, 0.9001)]))]
    got = near_vectors.near_vectors(vectors(spark, rows, "double")).collect()
    assert sum(r.n_links for r in got) >= 0.97 * 1200 and all(r.n_links <= 1 for r in got)


def test_crowded_buckets_are_cut_into_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = units(rng, 1, 16)
    rows = [(i, v.tolist()) for i, v in enumerate(turned(rng, np.repeat(centre, 400, 0), rng.uniform(0.6, 1.0, (400, 1))))]
    monkeypatch.setattr(near_vectors, "TILE", 30)
    got = sorted((tuple(r) for r in near_vectors.near_vectors(vectors(spark, rows, "double")).collect()), key=str)
    want = plain_links(rows)
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_near_vectors_of_empty_and_unusable_tables(spark):
    assert near_vectors.near_vectors(vectors(spark, [(1, [1.0])]).limit(0)).collect() == []
    got = near_vectors.near_vectors(vectors(spark, [(1, None), (None, []), (2, [0.0])])).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]


# Merkle manifests


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(digests):
    proofs, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i : i + 3] for i in range(0, len(digests), 3)]
        for i, proof in enumerate(proofs):
            r, slot = divmod(at[i], 3)
            proof.append((slot, runs[r][:slot] + runs[r][slot + 1 :]))
            at[i] = r
        digests = [H(*r) for r in runs]
    return digests[0], proofs


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([plain_leaf(r) for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))]) for s in names}
    root, tops = plain_tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for r, proof in zip(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))), trees[s][1]):
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            value = plain_leaf((*r[:4], r[4].replace("\n", "")) if hit else r)
            for slot, siblings in proof + top:
                value = H(*siblings[:slot], value, *siblings[slot:])
            out.append((r[0], plain_leaf(r), trees[s][0], root, H(*[v for _, sib in proof + top for v in sib]), value, value == root))
    return sorted(out, key=str)


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return df.withColumns({c: F.lit("x") for c in ("tree", "size", "place", "digest", "leaf", "row", "held", "at", "proof", "level", "first")}).repartition(4)


def odd_documents():
    rows = [(i if i % 7 else None, None if i % 5 == 0 else f"s{i % 11 if i % 2 else 0}" if i < 300 else f"ü{i}", None if i % 13 == 0 else "en", i if i % 3 else None, None if i % 17 == 0 else f"a\nb{i % 50}é\n") for i in range(400)]
    return rows + [(3, "s3", "en", 3, "same")] * 40 + [(None, None, None, None, None)] * 20 + [(9, "s3", "en", 0, ""), (10, "", "en", 0, "wort " * 40_000 + "\n")]


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_equals_plain_trees(spark, levels):
    rows = odd_documents()
    docs = documents(spark, rows)
    found = merkle.dataset_manifest(docs, checked=merkle.tampered_leaf(docs), levels=levels)
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), merkle.folded(F.col("checked"), F.col("proof")).alias("folded"))
    got = sorted((tuple(r) for r in found.withColumn("verified", F.col("folded") == F.col("root")).collect()), key=str)
    assert got == plain_manifest(rows)


def test_manifest_of_small_tables(spark):
    docs = documents(spark, [(1, "a", "en", 1, "x")])
    assert merkle.verified_manifest(docs.limit(0)).collect() == []
    (row,) = merkle.verified_manifest(docs).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == H() and row.verified


def test_partial_parents_wait_for_their_arity(spark):
    """Events in any order and any partitions: what is complete goes up, what is not stays as indexed children."""
    digests = [H(str(i)) for i in range(10)]
    rows = [(0, 10, 0, i, d) for i, d in enumerate(digests)]
    nodes = spark.createDataFrame(rows, "tree long, size long, level int, place long, digest string")
    (top,) = merkle.climb(nodes.repartition(1, "tree"), 99).collect()
    assert top.digest == plain_tree(digests)[0] and top.level == 3
    part = merkle.climb(nodes.where("place <> 4").coalesce(1), 99).collect()
    assert {(r.level, r.place) for r in part} == {(0, 3), (0, 5), (1, 0), (1, 2), (2, 1)}


def test_queries_equal_their_sql(spark, tmp_path):
    rng = np.random.default_rng(6)
    spark.createDataFrame(odd_documents(), "doc_id long, source string, lang string, n_chars long, text string").dropDuplicates().repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    base = units(rng, 60, 8)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, turned(rng, base, 0.97), turned(rng, base[:20], 0.995)]))] + [(900, None, 0), (901, [0.0] * 8, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("op12_merkle_manifest", "op13_near_vectors"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        found = con.execute(ORACLES[name])
        assert [d[0] for d in found.description] == got.columns
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, found.fetchall()))
