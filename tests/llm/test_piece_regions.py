import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from segmill.llm import pieces  # noqa: E402


def test_long_paths_are_looked_at_only_as_far_as_noise_reaches(monkeypatch):
    m = pieces.model(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(600)) for _ in range(40)]
    looked, plain = [], pieces._scores

    def counted(lat, g, row, *rest):
        if len(row) == 1:
            looked.append(row.shape[1])
        return plain(lat, g, row, *rest)

    monkeypatch.setattr(pieces, "_scores", counted)
    found = pieces.sample(m, texts, np.arange(40), 3)
    assert looked and np.mean(looked) < 600
    monkeypatch.setattr(pieces, "NEAR", 1 << 20)
    for one, other in zip(found, pieces.sample(m, texts, np.arange(40), 3)):
        assert [(i.tolist(), *rest) for i, *rest in one] == [(i.tolist(), *rest) for i, *rest in other]


def test_words_with_the_same_end_share_its_rows():
    import public_tokenizers

    from segmill.llm import pieces

    lat = pieces.Lattices(pieces.model(public_tokenizers.path("piece_bpe_32k.model")), ["walking talking", "talking"])
    assert lat.rows == len({w[i:] for w in ("▁walking", "▁talking") for i in range(8)}) == 10
