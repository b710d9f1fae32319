"""op1's candidates against every window's inner product with every passage's latent direction."""

import random

import numpy as np
import pytest

from boxwright.llm import decontamination as d


@pytest.mark.parametrize("sums", [1 << 20, 1])
def test_every_window_with_the_least_cosine_is_a_candidate(monkeypatch, sums):
    """Also where words repeat within a window (they were left out by a bound that took each once), and with the passages dealt into groups."""
    monkeypatch.setattr(d, "SUMS", sums, raising=False)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    common = [word() for _ in range(30)]
    items = [" ".join(rng.choice(common) if rng.random() < 0.4 else word() for _ in range(rng.randint(3, 70))).encode() for _ in range(150)]
    often = [word() for _ in range(21)]
    items.append(" ".join(often + often[:1] * 29).encode())
    items = sorted(items, key=lambda t: (d.size_of(len(d.word_hashes(t))), t))
    docs = [b"", b"!", items[0], items[70] + b" " + items[149]]
    for _ in range(60):
        some = rng.choice(items).split()
        docs.append(b" ".join(rng.choice([rng.choice(some), rng.choice(some[:2]), word().encode(), rng.choice(common).encode()]) for _ in range(rng.randint(1, 300))))
    docs.append(" ".join(often[0] if k % 8 == 0 else f"z{k}z" for k in range(120)).encode())
    idf = np.random.default_rng(1).uniform(0, 6, d.DIMENSIONS)
    idf[d.buckets(d.word_hashes(often[0].encode()))] = 3
    spaces = [d.randomised_svd(items[k : k + d.PART], idf) for k in range(0, len(items), d.PART)]
    hashes = [d.word_hashes(t) for t in items]
    passages = d.Passages(list(enumerate(hashes)), idf, spaces)
    directions = []
    for p, own in enumerate(hashes):
        vocabulary, basis = spaces[p // d.PART]
        at, x, _ = d._row(np.searchsorted(vocabulary, own), idf[d.buckets(vocabulary)])
        v = x @ basis[at]
        directions.append(dict(zip(vocabulary.tolist(), (idf[d.buckets(vocabulary)] * (basis @ (v / np.linalg.norm(v)))).tolist(), strict=True)))
    hits = 0
    for text in docs:
        words = d.word_hashes(text)
        found = {(p, s): c for p, s, c in passages.candidates(words)}
        squares, blocks = idf[d.buckets(words)] ** 2, -(-len(words) // d.STEP)
        for p, direction in enumerate(directions):
            adds = np.array([direction.get(w, 0.0) for w in words.tolist()])
            size = min(passages.size[p], blocks * d.STEP)
            for start in range(0, blocks * d.STEP - size + 1, d.STEP) if blocks else []:
                norm = squares[start : start + size].sum()
                cosine = adds[start : start + size].sum() / np.sqrt(norm) if norm else 0
                if abs(cosine - d.LEAST_COSINE) > 1e-4:
                    assert ((p, start) in found) == (cosine > d.LEAST_COSINE)
                    hits += cosine > d.LEAST_COSINE
                if (p, start) in found:
                    assert abs(found[p, start] - cosine) < 1e-4
    assert hits > 300 and passages.candidates(d.word_hashes(docs[-1]))
