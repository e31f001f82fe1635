"""The bounds of the exact search drop most work where vectors have directions, and never a result."""

import numpy as np
import pandas as pd

from versemill.llm import topk


def search(monkeypatch, vectors, asked, k=5, **options):
    """(results by query, share of all products that were computed) of one cell."""
    cells, plain = [], topk._Cell

    class Counted(plain):
        def __init__(self, *a):
            super().__init__(*a)
            cells.append(self)

    monkeypatch.setattr(topk, "_Cell", Counted)
    frame = lambda some: pd.DataFrame({"vec_id": some, "row": some, "wide": False, "vector": list(vectors[some] / 256)})
    found = topk._search_cell(frame(asked), frame(np.arange(len(vectors))), k, 256, options.pop("block", 8), options.pop("run", 128), **options)
    monkeypatch.setattr(topk, "_Cell", plain)
    results = {q: list(zip(g.score, g.vec_id)) for q, g in found.groupby("query_id")}
    return results, sum(c.products for c in cells) / (len(asked) * vectors.size)


def brute(vectors, asked, k=5):
    out = {}
    for q in asked:
        s = vectors @ vectors[q]
        out[q] = [(int(s[i]), i) for i in np.lexsort((np.arange(len(s)), -s)) if i != q][:k]
    return out


def clustered(rng, n, width, groups, noise):
    centres = rng.normal(size=(groups, width))
    v = centres[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, width))
    return np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True))


def test_most_products_are_left_out_on_clustered_vectors(monkeypatch):
    rng = np.random.default_rng(1)
    vectors = clustered(rng, 6000, 64, 40, 0.15)
    asked = np.arange(0, 6000, 50)
    found, share = search(monkeypatch, vectors, asked, block=16, run=512)
    assert found == brute(vectors, asked) and share < 0.5
    found, share = search(monkeypatch, vectors, asked, block=4, run=128)
    assert found == brute(vectors, asked) and share < 0.8


def test_exact_on_ties_short_cells_and_flat_vectors(monkeypatch):
    rng = np.random.default_rng(2)
    for vectors in (np.floor(rng.normal(size=(900, 16)) * 2), np.ones((50, 8)), np.zeros((40, 4)), clustered(rng, 700, 24, 9, 0.4), np.floor(rng.normal(size=(4, 8)) * 9), np.repeat(np.floor(rng.normal(size=(20, 12)) * 30), 30, axis=0)):
        asked = np.arange(0, len(vectors), 7)
        for batch in (1, 32):
            found, _ = search(monkeypatch, vectors, asked, batch=batch)
            assert found == brute(vectors, asked)
