"""Whitening against dense linear algebra, the Merkle manifest and the chosen-path join against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tribunal.llm import chosen_path, merkle, whitening
from tribunal.llm.jaccard import Shingles

from .test_operators import jaccard_brute, rows

# --- 11


def dense(vectors, components):
    """n, deviations, whitened (for each vector) and shares, from the exact covariance."""
    x = np.array([[math.floor(64 * c) for c in v] for v in vectors], np.int64)
    u = np.unique(x, axis=0)
    n, a = len(u), u - u.mean(0)
    e, axes = np.linalg.eigh(a.T @ a / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(components, int((e > 1e-9 * max(e.sum(), 1e-300)).sum()))
    dev = [sum(int(n * v - s) ** 2 for v, s in zip(row, u.sum(0), strict=True)) for row in x]
    return n, dev, (x - u.mean(0)) @ axes[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum() if k else e[:0]


def check_whitened(got, given, components=whitening.COMPONENTS):
    """got: rows; given: (vec_id, vector) of the usable rows, whose ids differ."""
    n, dev, want, shares = dense([v for _, v in given], components)
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    assert sum(map(len, by.values())) == len(given) * want.shape[1]
    if not want.shape[1]:
        return
    w = np.array([[by[i][k + 1].whitened for k in range(want.shape[1])] for i, _ in given])
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-8
    for (i, _), d in zip(given, dev, strict=True):
        for k, share in enumerate(shares):
            r = by[i][k + 1]
            assert (r.n, r.deviation) == (n, d) and abs(r.explained - share) < 1e-9 and 0 <= r.identity_error < 1e-9


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 24)) @ np.diag(np.linspace(0.05, 3, 24)) @ rng.normal(size=(24, 24))
    return [(i, [float(c) for c in v]) for i, v in enumerate([*base, *[base[7]] * 90])]


def test_whitening(spark, vectors):
    bad = [(900, None), (901, []), (902, [None] + [1.0] * 23), (903, [math.nan] + [1.0] * 23), (904, [math.inf] * 24)]
    table = spark.createDataFrame([(i, v, "w", 1) for i, v in vectors + bad], "vec_id long, embedding array<float>, whitened string, d int").repartition(5)
    got = whitening.components_of(table).collect()
    check_whitened(got, [(i, [float(np.float32(c)) for c in v]) for i, v in vectors])
    twice = whitening.components_of(table.unionByName(table)).groupBy("vec_id", "component").count().groupBy("count").count().collect()
    assert [tuple(r) for r in twice] == [(2, len(vectors) * 16)]  # a row for each, the fit is the same
    assert whitening.components_of(table.limit(0)).count() == 0
    assert whitening.components_of(table.where("vec_id >= 900")).count() == 0


def test_whitening_of_few_directions(spark):
    """Constant dimensions, sums of others, far from zero; fewer directions than components; equal vectors; several lengths; null ids."""
    rng = np.random.default_rng(4)
    a = rng.integers(-300, 300, (80, 3)) / 64
    flat = [(i, [*r, 5.0, r[0] + r[1], 20000 + r[2] * 3]) for i, r in enumerate(a.tolist())]
    short = [(1000 + i, r[:2]) for i, (_, r) in enumerate(flat)]
    one = [(2000, [1.0, 2.0, 3.0]), (2001, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame([*flat, *short, *one], "vec_id long, embedding array<double>").repartition(3)
    got = whitening.components_of(table).collect()
    check_whitened([r for r in got if r.vec_id < 1000], flat)
    check_whitened([r for r in got if 1000 <= r.vec_id < 2000], short)
    assert not any(r.vec_id >= 2000 for r in got)
    none = whitening.components_of(table.withColumn("vec_id", F.lit(None).cast("long")))
    assert none.count() == len(got) and none.where("vec_id IS NOT NULL").isEmpty()


def test_whitening_of_very_large_entries(spark):
    """Sums beyond 64 bits; deviations that don't fit are null."""
    given = [(i, [float(x), float(y)]) for i, (x, y) in enumerate([(2**50, 1), (-(2**50), 2), (2**49, -7), (3, 2**52), (1e300, 5)])]
    got = whitening.components_of(spark.createDataFrame(given, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 10 and all(r.deviation is None and math.isfinite(r.whitened) and r.identity_error < 1e-6 for r in got)


def test_pivoted_cholesky():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 6))
    a[:, 2], a[:, 4] = a[:, 0] - a[:, 1], 0
    keep, u = whitening.pivoted_cholesky(a.T @ a, 1e-9)
    assert len(keep) == 4 and 4 not in keep and np.allclose(u.T @ u, a.T @ a) and np.allclose(np.tril(u[:, keep], -1), 0)


# --- 12


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(leaves):
    """The root, and for each leaf the (before, after) of its runs."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            paths[k].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        level = [sha(*level[s : s + 8]) for s in range(0, len(level), 8)]
        at = [p // 8 for p in at]
    return level[0], paths


def manifest_brute(table):
    """Rows as tuples, in the order of merkle.manifest."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(*map(field, (r[0], r[1], r[2], r[3], text)))
    langs = defaultdict(list)
    for r in table:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[lang] = tree_of([leaf(r, r[4]) for r in langs[lang]])
    root, above = tree_of([trees[lang][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for r, path in zip(langs[lang], trees[lang][1], strict=True):
            steps = path + above[k]
            low = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf(r, r[4].translate(str.maketrans(merkle.UPPER, merkle.LOWER)) if low else r[4])
            for b, a in steps:
                h = sha(b, h, a)
            out.append((r[0], leaf(r, r[4]), trees[lang][0], root, sha(*[b + a for b, a in steps]), h, h == root))
    return out


@pytest.mark.parametrize("depth", [4, 1, 2])
def test_manifest(spark, monkeypatch, depth):
    """Rounds of several depths; null and empty languages, ids, texts; equal rows; a lone leaf; runs of one."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    rng = random.Random(12)
    given = [(i, rng.choice(["a", None, ""]), lang, rng.choice([None, 5]), rng.choice(["Upper Case", "lower", None, "", "É ß 漢"])) for lang, n in (("de", 130), ("en", 65), (None, 9), ("", 8), ("x", 1), ("é", 3)) for i in rng.sample(range(10**6), n)]
    given += [given[0]] * 5 + [(None, "s", "de", 1, "No Id")] * 3 + [(None, None, None, None, None), (given[1][0], "other", "de", 1, "Same Id"), (-3, "s", "en", 1, "Minus")]
    docs = spark.createDataFrame([(*r, "n", "h") for r in given], "doc_id long, source string, lang string, n_chars long, text string, part string, h string").repartition(4)
    lowered = F.when(F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 == 0), F.translate("text", merkle.UPPER, merkle.LOWER))
    got = merkle.manifest(docs, lowered)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(manifest_brute(given), key=key)
    assert merkle.manifest(docs.limit(0), lowered).count() == 0
    one = docs.where("lang = 'x'")
    assert [tuple(r) for r in merkle.manifest(one).select("leaf", "subroot", "root", "proof_sha256", "verified").collect()] == [(*[h for r in manifest_brute([g for g in given if g[2] == "x"]) for h in (r[1],)] * 3, sha(""), True)]


# --- 13

NEAR = ("doc_id", "n_shingles", "component_id")


@pytest.mark.parametrize(("size", "percent", "small"), [(5, 85, 256), (5, 80, 3), (4, 60, 3)])
def test_chosen_path(docs, texts, none, monkeypatch, size, percent, small):
    """Also with nodes of four sets that branch again, and lists of four in tiles."""
    monkeypatch.setattr(chosen_path, "SMALL", small)
    spec = Shingles(size, percent)
    got = chosen_path.groups(docs, spec)
    assert rows(got, *NEAR) == jaccard_brute(texts, size, percent)
    assert got.where("NOT (kept <=> (doc_id <=> component_id))").isEmpty()
    assert chosen_path.groups(none, spec).count() == 0


@pytest.mark.parametrize("small", [256, 4])
def test_chosen_path_of_a_family(spark, monkeypatch, small):
    """Chains and stars of edits, pages of one template just under the threshold, and a passage in otherwise different texts."""
    monkeypatch.setattr(chosen_path, "SMALL", small)
    rng = random.Random(18)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    family = [fresh(120)]
    for _ in range(120):
        w = list(rng.choice(family[-30:]))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        family.append(w)
    template, passage = fresh(200), fresh(60)
    family += [template + fresh(19) for _ in range(60)] + [fresh(50) + passage + fresh(50) for _ in range(60)]
    given = [(i, " ".join(w)) for i, w in enumerate(family)]
    got = chosen_path.groups(spark.createDataFrame(given, "doc_id long, text string"), chosen_path.CONTRACT)
    assert rows(got, *NEAR) == jaccard_brute(given, 5, 85)


def test_trees_and_sketches_reach_the_recall():
    assert chosen_path.trees(85, 1e-7) == 5 and chosen_path.trees(85, 1e-2) < chosen_path.trees(60, 1e-2)
    with pytest.raises(ValueError):
        chosen_path.trees(50, 0.1)
    k = chosen_path.agreeing(85, 1e-7)
    below = sum(math.comb(128, j) * 0.85**j * 0.15 ** (128 - j) for j in range(k))
    assert below < 1e-7 < below + math.comb(128, k) * 0.85**k * 0.15 ** (128 - k)
