import random

import numpy as np
import xxhash

from sextant.llm.simhash_dedup import fingerprint, simhash_dedup, trie_forest


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) and hashes)


def classes(ids, fps, budget=3):
    group = {i: i for i in ids}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= budget and root(i) != root(j):
                group[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in ids}


def test_fingerprint_matches_the_definition():
    for text in (None, "", "  \t", "One", "one TWO", "A b c d\x0be f   g", "x " * 500):
        assert fingerprint(text) == plain(text)


def test_trie_walk_against_all_pairs():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    keys = set(base)
    for b in base:
        for _ in range(12):
            keys.add(b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 5))))
    keys = np.array(sorted(keys), dtype=np.uint64)
    parent = trie_forest(keys, np.array([0]), np.array([len(keys)]), 0, 3)
    want = classes(range(len(keys)), [int(k) for k in keys])
    assert [want[i] for i in range(len(keys))] == parent.tolist()


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(30):
        t = [rng.choice(words) for _ in range(rng.choice((1, 2, 40, 200)))]
        texts.append(" ".join(t))
        for _ in range(rng.randrange(4)):
            u = list(t)
            u[rng.randrange(len(u))] = "changed"
            texts.append(" ".join(u))
    texts += [None, "", "  ", texts[0], texts[0]]
    rows = [(i * 7 + 3, t, "x", 1) for i, t in enumerate(texts)]
    out = simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string, fp string, component int")).collect()
    fps = {i: plain(t) for i, t, *_ in rows}
    want = classes([r[0] for r in rows], fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {i: (f"{fps[i]:016x}", want[i]) for i in want}
    assert len(out) == len(rows)


def test_empty_null_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert simhash_dedup(spark.createDataFrame([], schema)).count() == 0
    out = simhash_dedup(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "lonely words here now")], schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in out) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]
