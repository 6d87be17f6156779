"""Whitening, hard negatives and fingerprints against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelgrid.llm import fingerprint, hard_negatives, whitening
from panelgrid.llm.common import read_table
from tests.conftest import SF_SMALL

NAN, INF = float("nan"), float("inf")


def table(spark, rows, more="extra string"):
    """vec_id, embedding, label and a further column whose name an operator uses itself."""
    return spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<double>, label int, {more}")


# ------------------------------------------------------------------ whitening

def whitened(rows):
    """Brute force: n, deviations, eigenvalues, whitened rows and explained shares."""
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for v in rows])
    n = len(x)
    moved = n * x - x.sum(axis=0)
    v = (moved / n).T @ (moved / n) / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    return n, (moved.astype(object) ** 2).sum(axis=1), e, (moved / n) @ q / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(v)


def check_whitening(got, ids, rows, components):
    n, deviation, e, w, share = whitened(rows)
    assert len(got) == len(ids) * components
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(components):
        col = np.array([by[i, c + 1].whitened for i in ids])
        sign = np.sign((col * w[:, c]).sum())
        assert np.abs(col * sign - w[:, c]).max() < 1e-8
        assert all(abs(by[i, c + 1].explained - share[c]) < 1e-10 for i in ids)
    assert [by[i, 1].deviation for i in ids] == deviation.tolist()
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-10


@pytest.mark.parametrize(("dim", "count", "spread"), [(64, 700, "flat"), (64, 900, "hot"), (10, 300, "flat"), (3, 40, "flat")])
def test_whitening_equals_eigenvectors(spark, dim, count, spread):
    rng = np.random.default_rng([dim, count])
    x = rng.standard_normal((count, dim)) / np.sqrt(dim) * np.linspace(1.3, 0.7, dim)
    if spread == "hot":
        x[: count // 3] = x[0]  # a third of all rows are copies
    got = whitening.whiten(table(spark, [(k, r.tolist(), 1) for k, r in enumerate(x)]).repartition(7)).collect()
    check_whitening(got, list(range(count)), x.tolist(), min(8, dim))


def test_whitening_needs_no_gram_matrix(spark):
    """The filter converges where the block is much narrower than the space, and certifies what it returns."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 200)) * np.linspace(1.5, 1, 200)
    packed, dim = whitening._packed(table(spark, [(k, r.tolist(), 1) for k, r in enumerate(x)]), "vec_id", "embedding")
    model = whitening.fit_blocks(packed.persist(), dim, components=4)
    e = whitened(x.tolist())[2]
    assert np.allclose(model.values, e[:4], rtol=1e-12) and (model.residuals <= 1e-11 * e[0]).all()
    assert model.vectors.shape == (200, 4)


def test_whitening_of_odd_rows(spark):
    good = [(1, [0.1, 0.5], 1), (2, [0.3, -0.5], None), (2, [0.9, 0.25], 3), (None, [-0.3, 0.7], 3), (7, [0.1, 0.5], 1)]
    bad = [(3, None, 1), (4, [], 1), (5, [0.1, None], 1), (6, [NAN, 0.0], 1), (8, [INF, 0.0], 1), (9, [1.0], 1)]
    got = whitening.whiten(table(spark, good + bad)).collect()
    assert len(got) == 2 * len(good) and {r.n for r in got} == {5}
    w = whitened([r[1] for r in good])
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(w[1].tolist())
    assert got[0].asDict().keys() == {f.split()[0] for f in whitening.OUTPUT}
    for rows in ([], bad[:5], [(1, [0.5, 0.5], 1)] * 3):  # empty, nothing valid, no variance
        assert whitening.whiten(table(spark, rows)).count() == 0
    line = whitening.whiten(table(spark, [(k, [0.1 * k, 0.5], 1) for k in range(9)])).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-9
    far = whitening.whiten(table(spark, [(k, [1e30 * (k - 1), 0.5], 1) for k in range(3)])).collect()
    assert len(far) == 3 and {r.deviation for r in far} == {None, 0}


# ------------------------------------------------------------- hard negatives

def mined(rows, anchors, positives=5, negatives=5):
    """Brute force with whole numbers; rows are (id, vector, label)."""
    rows = [(i, [int(np.floor(256 * c)) for c in v], label) for i, v, label in rows]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, x, label in rows:
        if not anchors(i):
            continue
        others = [(score(x, y), j, other) for j, y, other in rows if j != i and len(x) == len(y)]
        order = sorted(others, key=lambda r: (-r[0], r[1]))
        for ps, p, _ in [r for r in order if r[2] == label][:positives]:
            fits = [r for r in order if r[2] != label and 80 * ps <= 100 * r[0] <= 100 * ps][:negatives]
            out += [(i, p, k + 1, j, ps, s) for k, (s, j, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "clustered", "one label holds a third", "ties"])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(hard_negatives, "STRIPE", 40)
    rng = np.random.default_rng(8)
    n, dim = 260, 12
    x = rng.standard_normal((n, dim))
    labels = rng.integers(0, 4, n)
    if kind == "clustered":
        x = x[rng.integers(0, 12, n)] + 0.05 * rng.standard_normal((n, dim))
    if kind == "one label holds a third":
        labels[: n // 3], x[: n // 4] = 1, x[0]
    if kind == "ties":
        x = rng.integers(-1, 2, (n, dim)).astype(float)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    rows = [(k, r.tolist(), int(c)) for k, (r, c) in enumerate(zip(x, labels, strict=True))]
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i % 5 == 0)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (400, 16))
    x[:150] = x[0] + rng.integers(-9, 9, (150, 16))
    x[399] = 0
    norm = np.linalg.norm(x.astype(float), axis=1)
    references = x[[0, 200, 210]] / norm[[0, 200, 210], None]
    angles = hard_negatives._angles(x.astype(float), norm, references)
    low, high = hard_negatives.bounds(norm, angles, norm, angles)
    scores = hard_negatives.exact_scores(x, norm, x, norm)
    assert (scores == x @ x.T).all() and (low <= scores).all() and (scores <= high).all()
    # Near copies of a reference: nearly all other rows lie below four fifths of a near score.
    assert (high[:150, 150:] < 0.8 * norm[0] ** 2).mean() > 0.9


def test_hard_negatives_of_odd_rows(spark):
    good = [(0, [0.5, 0.5], 1), (10, [0.5, 0.4], 1), (20, [0.5, 0.45], 2), (30, [0.0, 0.0], 1), (40, [0.4, 0.45], 2), (50, [0.5], 1), (60, [0.5], 2)]
    bad = [(None, [0.5, 0.5], 1), (70, [0.5, 0.5], None), (80, None, 1), (90, [], 1), (100, [0.5, None], 1), (110, [NAN, 0.5], 1), (120, [INF, 0.0], 2),
           (130, [2e6, 0.0], 2)]
    again = [(10, [0.5, 0.9], 1), (20, [0.1, 0.1], 3)]  # of repeated ids the smallest label, then vector stays
    got = hard_negatives.mine(table(spark, good + bad + again, "score string"), F.lit(True))
    assert sorted(map(tuple, got.collect())) == mined(good, lambda i: True)
    for rows in ([], bad):
        assert hard_negatives.mine(table(spark, rows), F.lit(True)).count() == 0


def test_scores_beyond_double_precision():
    a, b = np.array([[2 ** 27 + 1, 3]]), np.array([[2 ** 27 + 3, 5]])
    norm = np.array([float(2 ** 27)])
    assert int(hard_negatives.exact_scores(a, norm, b, norm)[0, 0]) == (2 ** 27 + 1) * (2 ** 27 + 3) + 15


# --------------------------------------------------------------- fingerprints

texts = st.text(alphabet="ab é漢😀\n", max_size=120)


@settings(max_examples=150, deadline=None)
@given(texts, texts, st.integers(0, 120), st.integers(0, 120))
def test_extensions_equal_brute_force(a, b, i, k):
    i, k = min(i, len(a)), min(k, len(b))
    same = 0
    while i + same < len(a) and k + same < len(b) and a[i + same] == b[k + same]:
        same += 1
    one, two = fingerprint.Prefixes(a), fingerprint.Prefixes(b)
    assert one.extension(i, two, k) == same
    assert one.equal(i, len(a), two, k) == (a[i:] == b[k:k + len(a) - i])


@settings(max_examples=100, deadline=None)
@given(texts, texts)
def test_fingerprints_and_likeness(a, b):
    one, two = fingerprint.fingerprint(a), fingerprint.fingerprint(b)
    assert (str(one) == str(two)) == (a == b)
    assert str(fingerprint.Fingerprint.parse(str(one))) == str(one)
    near = fingerprint.likeness(one, two)
    assert 0 <= near <= 1 and near == fingerprint.likeness(str(two), str(one)) and fingerprint.likeness(one, one) == 1
    if a != b:
        start = fingerprint._common_start(one, two)
        assert a[:start] == b[:start]


def test_fingerprints_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abc dé漢😀") for _ in range(5000))
    whole = str(fingerprint.fingerprint(text))
    for size in (33, 64, 1000):
        monkeypatch.setattr(fingerprint, "PIECE", size)
        fingerprint._powers.cache_clear()
        assert str(fingerprint.fingerprint(text)) == whole
        assert fingerprint.Prefixes(text).extension(7, fingerprint.Prefixes(text[5:]), 2) == 4993
    fingerprint._powers.cache_clear()


def test_likeness_survives_shifts_and_tells_texts_apart():
    rng = random.Random(9)
    words = [f"word{k}" for k in range(300)]
    for _ in range(20):
        a, b = (" ".join(rng.choice(words) for _ in range(400)) for _ in range(2))
        assert fingerprint.likeness(str(fingerprint.fingerprint(a)), str(fingerprint.fingerprint("New. " + a))) > 0.4
        assert fingerprint.likeness(str(fingerprint.fingerprint(a)), str(fingerprint.fingerprint(a[:2000] + "!" + a[2000:]))) > 0.5
        assert fingerprint.likeness(str(fingerprint.fingerprint(a)), str(fingerprint.fingerprint(b))) < 0.1


def successors(rows):
    """Brute force: (id, text) rows in falling order with the row that follows each."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    return [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]


def expected(rows):
    out = []
    for i, t, following in successors(rows):
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        f, g, h = (str(fingerprint.fingerprint(x)) for x in (t, edited, following))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, g, fingerprint.likeness(f, g), fingerprint.likeness(f, h)))
    return sorted(out, key=repr)


def test_neighbours(spark):
    docs = read_table(spark, SF_SMALL, "documents").repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = fingerprint.neighbours(docs).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)
    assert sum(r.near_edited > r.near_next for r in got) > 0.95 * len(got)


@pytest.mark.parametrize("rows", [
    [], [(5, "alone here")], [(None, None)], [(None, "x y"), (None, "a b c d"), (3, ""), (3, None), (3, "same"), (3, "same"), (-2, "é漢😀 more")],
    [(k % 3, "all rows share few ids " * (k % 5)) for k in range(90)], [(7, "copy")] * 40, [(1, "w " * 200_000), (2, "short"), (3, "v" * 300_000)],
])
def test_neighbours_of_odd_rows(spark, rows):
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, part int, borrowed string")
    assert sorted(map(tuple, fingerprint.neighbours(docs).collect()), key=repr) == expected(rows)
