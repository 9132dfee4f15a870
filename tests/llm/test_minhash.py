"""Near-duplicates against comparing all pairs, and the bounds that rule pairs out."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import minhash

U64 = st.integers(0, (1 << 64) - 1)


@settings(max_examples=200, deadline=None)
@given(st.sets(U64, max_size=60), st.sets(U64, max_size=60), st.sets(U64, max_size=400))
def test_bitmaps_differ_in_no_more_bits_than_the_sets_in_members(a, b, common):
    x, y = (np.array(sorted(s | common), np.uint64) for s in (a, b))
    bits = sum(int(w).bit_count() for w in (minhash.parity(x) ^ minhash.parity(y)).view(np.uint64))
    assert bits <= len(np.setxor1d(x, y))


def test_unlike_groups_with_a_shared_passage_against_all_pairs(spark):
    """Chains of copies, each some edits from the one before, around one passage that all groups share."""
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for group in range(4):
        words = [f"g{group}x{w}" for w in rng.integers(0, 500, 45)]
        for step in range(25):
            words[int(rng.integers(0, 45))] = f"e{group}x{step}"
            texts.append(" ".join(words[:20] + passage + words[20:]))
    texts += [texts[0].upper(), " ".join(passage), "x " * 20_000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(minhash.shingle_set(t.encode() if t else None).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = {r["doc"]: r for r in minhash.near_duplicates(df).collect()}
    assert [got[i]["component"] for i in range(len(texts))] == root
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
