"""Vector codes against plain Python: whole searches, whole rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from reflexgrid.llm import codes as C


def plain(rows, parts=8, size=16, rounds=6):
    """{position: (code, error, label_error, digest)} of (id, vector, label) rows, by full search in Python's integers."""
    kept = [(i, r) for i, r in enumerate(rows) if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    if not kept:
        return {}
    width = -(-max(len(r[1]) for _, r in kept) // parts) * parts

    def floor(v):
        top, bottom = float(v).as_integer_ratio()
        return top * 4096 // bottom

    x = {i: [floor(v) for v in r[1]] + [0] * (width - len(r[1])) for i, r in kept}
    d = width // parts
    first = sorted(kept, key=lambda k: (k[1][0] is None, k[1][0] or 0, k[1][1]))[:size]
    books = [[x[i][p * d : p * d + d] for i, _ in first] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for v in x.values():
                part = v[p * d : p * d + d]
                held.setdefault(nearest(p, part)[1], []).append(part)
            for k, members in held.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    found = {i: [nearest(p, v[p * d : p * d + d]) for p in range(parts)] for i, v in x.items()}
    errors = {i: sum(e for e, _ in f) for i, f in found.items()}
    labels = {}
    for i, r in kept:
        labels[r[2]] = labels.get(r[2], 0) + errors[i]
    digest = hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()
    top = C.LONGEST
    return {i: ("".join(f"{k:02x}" for _, k in found[i]), min(errors[i], top), min(labels[r[2]], top), digest) for i, r in kept}


def same(spark, rows, kind="float", extra=""):
    schema = f"vec_id bigint, embedding array<{kind}>, label int"
    if kind == "float":
        rows = [(a, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for a, v, c in rows]
    df = spark.createDataFrame(rows, schema)
    if extra:
        df = df.selectExpr("*", *[f"'x' as {c}" for c in extra.split()])
    got = C.compress(df).collect()
    want = plain(rows)
    assert sorted(map(repr, ((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got))) == sorted(repr((rows[i][0], *v)) for i, v in want.items())
    return got


def test_search_equals_full_search_and_skips():
    rng = np.random.default_rng(1)
    for dim, spread in ((1, 3), (2, 2), (8, 900), (8, 2)):
        entries = rng.integers(-spread, spread + 1, (1, 16, dim)).tolist()
        books = C.Books(entries)
        x = rng.integers(-spread - 2, spread + 3, (3000, dim))
        entry, best, tried = books.nearest(0, x)
        far = ((x[:, None, :] - np.array(entries[0])[None]) ** 2).sum(axis=2)
        assert (entry == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()  # argmin takes the lower index
        assert tried < 16 * len(x)
        wide = books.nearest(0, x.astype(object))
        assert (wide[0] == entry).all() and (wide[1] == best).all()


def test_given_vectors(spark):
    import duckdb

    from reflexgrid.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select vec_id, embedding, label from '{folder}/embeddings.parquet'").fetchall()
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in QUERIES["op12_vector_codes"](spark, folder).collect()}
    assert got == {rows[i][0]: v for i, v in plain(rows).items()}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_awkward_vectors(spark, kind):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(16)], rng.choice([1, 2, None])) for i in range(60)]
    rows += [(3, rows[3][1], 1), (3, rows[3][1], 1), (4, [0.5] * 16, 2), (None, [0.25] * 16, None), (61, None, 1), (62, [1.0, None] * 8, 1)]
    rows += [(63, [float("nan")] * 16, 1), (64, [float("inf")] + [0.0] * 15, 2), (65, [float("-inf")] * 16, None), (66, [0.1] * 9, 1), (67, [], 2), (68, [0.0] * 16, 7)]
    same(spark, rows, kind, extra="id n at part entry code error vector")
    same(spark, rows[:5], kind)
    same(spark, [(1, [], None)], kind)
    same(spark, rows[-12:], kind)
    assert C.compress(spark.createDataFrame([], f"vec_id bigint, embedding array<{kind}>, label int")).collect() == []


def test_wide_components(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e6, -3e8, 0.3, -7.25]) for _ in range(8)], i % 2) for i in range(30)] + [(40, [1e14] * 8, 1)]
    same(spark, rows, "double")
