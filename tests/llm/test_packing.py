import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sextant.llm.packing import STEP_TOKENS, TIERS, WordEncoder, pack, packing, step_groups


def test_pack_uses_every_token_once_and_pads_nothing():
    rng = random.Random(1)
    for case in ([], [1], [2048], [5000], [3, 3, 3], [rng.choice((1, 5, 90, 300, 700, 1500, 2047, 9000)) for _ in range(500)]):
        seen = [np.zeros(n, int) for n in case]
        for size, pieces in pack(case):
            assert size & (size - 1) == 0 and size <= TIERS[-1] and sum(p[2] for p in pieces) == size
            for doc, start, n in pieces:
                seen[doc][start : start + n] += 1
        assert all((s == 1).all() for s in seen)
        lengths = [s for s, _ in pack(case)]
        groups = step_groups(lengths)
        held = {}
        for g, n in zip(groups, lengths, strict=True):
            held[g] = held.get(g, 0) + n
        assert all(v == STEP_TOKENS for g, v in held.items() if g != max(held)) and all(v <= STEP_TOKENS for v in held.values())


def test_pieces_hold_the_tokenizers_ids(spark):
    texts = [None, "", "Hello, World's 123 ÄÖ́!", "<|endoftext|> mid <|startoftext|>x", "e ́x y z\x85a\tb\x0bc\x1cd\r\n e", "Wort " * 5000, "x" * 30000, "a\x00b ﬁ İ Σς ΑΣ", "same", "same", "a★b ★ ★★ c★"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i if i != 8 else 9, x, "c", 1) for i, x in enumerate(texts)]
    out = packing(spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").coalesce(1)).collect()
    want = sorted((r[0], *t.encode(r[1] or "", add_special_tokens=False).ids, 1) for r in rows)
    whole, left = [], sorted(out, key=lambda r: (r.doc_id, r.start))
    for key in {(r.doc_id) for r in out}:
        own = [r for r in left if r.doc_id == key]
        copies = sum(r.start == 0 for r in own)
        n = own[0].doc_tokens
        assert sum(r.length for r in own) == copies * n
        starts = {}
        for r in own:
            starts.setdefault(r.start, r.ids)
            assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        if copies == 1:
            whole.append((key, *sum((starts[s] for s in sorted(starts)), [])))
    assert sorted(whole) == [w for w in want if w[0] != 9]
    for s in {r.sequence_id for r in out}:
        own = sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at == own[0].sequence_length <= 2048 and at & (at - 1) == 0


def test_empty_table_and_null_ids(spark):
    assert packing(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert packing(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).count() >= 1


def test_encoder_on_random_texts():
    spec = open(public_tokenizers.path("word_bpe_49k.json")).read()
    mine, whole = WordEncoder(spec), Tokenizer.from_str(spec)
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x180)] + list("abcdefgh   \n'..,,1") * 30 + ["'s", "the", "é", "é", "Σ", "“", "日", "<|endoftext|>"] * 4
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + [chr(c) for c in range(0x180)]
    for t, ids in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t
