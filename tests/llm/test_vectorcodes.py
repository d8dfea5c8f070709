import hashlib
import math
import random

import numpy as np
import pytest

from rivulet.llm import vectorcodes as vc

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """The same codes by whole numbers without a size, one row at a time."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    width = max(1, -(-max(len(r[1]) for r in kept) // parts))
    bound = vc.Limbs.plan(width).bound
    ints = [[max(-bound, min(bound, math.floor(256 * x))) for x in r[1]] + [0] * (parts * width - len(r[1])) for r in kept]
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for v in ints]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)), i) for i, e in enumerate(books[p])) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for i in range(len(order)):
                mine = [v[p] for v, f in zip(cut, found, strict=True) if f[p][1] == i]
                if mine:
                    books[p][i] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for r, e in zip(kept, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    fit = lambda n: n if n < 1 << 63 else None
    return sorted(((r[0], "".join(f"{i:02x}" for _, i in f), fit(e), fit(by[r[2]]), sha) for r, f, e in zip(kept, found, errors, strict=True)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows(seed, n, dim, scale=1.0):
    rnd = random.Random(seed)
    out = [(i * 3, [rnd.gauss(0, scale) for _ in range(dim)], rnd.choice([0, 1, 1, None])) for i in range(n)]
    out += [(7, None, 1), (8, [None] * dim, 1), (9, [float("nan")] * dim, 0), (10, [float("inf")] + [0.0] * (dim - 1), 0)]
    out += [out[2], out[2], (out[5][0], out[6][1], 1), (None, out[4][1], None)]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("n,dim,scale", [(150, 64, 0.2), (90, 32, 4.0), (30, 16, 1e5), (80, 48, 3e6)])
def test_matches_exact_arithmetic(llm, n, dim, scale):
    data = rows(n, n, dim, scale)
    assert result(vc.product_codes(llm.createDataFrame(data, SCHEMA))) == brute(data)


def test_uneven_lengths_and_odd_tables(llm):
    data = [(1, [0.5] * 20, 1), (2, [], 1), (3, [1.0], None), (3, [1.0, -2.0], 2), (None, [0.25] * 7, None)]
    assert result(vc.product_codes(llm.createDataFrame(data, SCHEMA))) == brute(data)
    assert result(vc.product_codes(llm.createDataFrame([], SCHEMA))) == []
    assert result(vc.product_codes(llm.createDataFrame([(1, None, 2)], SCHEMA))) == []
    more = llm.createDataFrame([(*r, "x", 0.5, "y") for r in data], SCHEMA + ", code string, error double, LABEL_ERROR string")
    assert result(vc.product_codes(more)) == brute(data)


@pytest.mark.parametrize("width", [1, 2, 4, 7, 64, 256])
def test_limb_products_are_exact(width):
    limbs = vc.Limbs.plan(width)
    assert limbs.count >= 2 and limbs.count * width * ((1 << limbs.bits) - 1) ** 2 < 1 << 53
    rnd = np.random.default_rng(width)
    x = rnd.integers(-limbs.bound, limbs.bound + 1, (20, width))
    y = rnd.integers(-limbs.bound, limbs.bound + 1, (9, width))
    x[0], y[0], x[1], y[1] = limbs.bound, limbs.bound, -limbs.bound, -limbs.bound
    want = [[sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in y] for p in x]
    assert limbs.dot(limbs.split(x), limbs.split(y)).tolist() == want
    plain = (x.astype(float) @ y.astype(float).T).astype(np.int64)
    assert width == 1 or (plain != np.array(want)).any()  # one product of floats would not do
    at, far = vc.nearest(x, y, limbs)
    exact = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)), i) for i, q in enumerate(y)) for p in x]
    assert list(zip(far.tolist(), at.tolist(), strict=True)) == exact


def test_ties_go_to_the_first_entry():
    book = np.array([[4, 0], [0, 0], [0, 0], [-4, 0]], np.int64)
    at, far = vc.nearest(np.array([[2, 0], [0, 0], [-2, 0]], np.int64), book, vc.Limbs.plan(2))
    assert at.tolist() == [0, 1, 1] and far.tolist() == [4, 0, 4]


def test_codes_expand_to_their_entries(llm):
    data = rows(3, 120, 32)
    df = llm.createDataFrame(data, SCHEMA)
    books = vc.train_codebooks(df)
    done = vc.compress(df.select("embedding", "vec_id"), books).orderBy("vec_id").collect()
    back = vc.expand([r["code"] for r in done], books)
    assert books.shape == (16, 64, 2) and back.shape == (len(done), 32)
    plain = {r[0]: r[1] for r in data if r[0] in (0, 30, 60)}
    for r, v in zip(done, back, strict=True):
        if r["vec_id"] in plain:
            assert r["error"] == sum((math.floor(256 * x) - int(b)) ** 2 for x, b in zip(plain[r["vec_id"]], v, strict=True))
