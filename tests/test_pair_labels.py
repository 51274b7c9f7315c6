"""Labels of a pair without its common suffix are the labels of the whole alignment."""

import random

from redline.operators import align, edits


def test_pair_labels_align_only_before_the_common_suffix(monkeypatch):
    rng, seen, real = random.Random(5), [], align.lcs_align
    cases = [([rng.choice("abcd") for _ in range(rng.randrange(9))], [rng.choice("abcd") for _ in range(rng.randrange(9))])
             for _ in range(4000)]
    want = [edits.word_labels(s, t, real(s, t)) for s, t in cases]
    monkeypatch.setattr(align, "lcs_align", lambda s, t: seen.append((s, t)) or real(s, t))
    assert [edits.pair_labels(s, t) for s, t in cases] == want
    assert seen and all(s[-1] != t[-1] for s, t in seen)


def test_small_tables_align_like_checkpointed_ones():
    rng = random.Random(6)
    for _ in range(3000):
        s, t = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        assert align.lcs_align(s, t) == align.lcs_align(s, t, full_table_bits=0)
