"""Words whose proposal fails are merged together, with the tokens that merging each alone gives."""

import numpy as np

from genorigin.llm import bpe, queries


def test_words_are_merged_together(monkeypatch):
    from tokenizers import Tokenizer

    t, ours = Tokenizer.from_file(queries.tokenizer_path()), bpe.Tokenizer(queries.tokenizer_path())
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeinrsthlo"), rng.integers(2, 30))) for _ in range(5000)] + ["q" * n for n in (1, bpe.SHORT, bpe.SHORT + 1, 500)]
    exact, alone = ours.exact, []
    monkeypatch.setattr(ours, "exact", lambda word: alone.append(word) or exact(word))
    ids, counts = ours.encode_batch(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(w, add_special_tokens=False).ids for w in words]
    assert not {w.encode() for w in words if 16 < len(w) <= bpe.SHORT} & set(alone)  # only pairs of tokens, and long words


def test_many_words_at_once():
    ours = bpe.Tokenizer(queries.tokenizer_path())
    rng = np.random.default_rng(4)
    words = [rng.integers(0, 256, n).astype(np.uint8).tobytes() if n % 2 else bytes(rng.choice(list(b" theraino"), n)) for n in rng.integers(1, 70, 6000).tolist()]
    sizes = np.array([*map(len, words)])
    ids, counts = ours.exact_many(np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [ours.exact(w) for w in words]
    assert [len(x) for x in ours.exact_many(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]
