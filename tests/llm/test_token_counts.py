import random

from tokenizers import Tokenizer, pre_tokenizers
from tokenizers.models import Unigram

from sextant.llm.token_counts import WORD, PieceCounter, read_pieces, token_counts


def reference(pieces, byte_fallback):
    t = Tokenizer(Unigram(pieces, 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(split=False)])
    return t


TEXTS = [None, "", " \n", "The cat's naïve café", "日本語 テキスト 𝔘𝔫𝔦 ☃☃☃ ab☃", "x" * 3000, "<unk> a<unk>☃b <0x0A> <s>", "▁▁▁▁ ▁a▁▁", "a b c\x85d\x1ce\tf\x0bg", "thththththth ouéouéoué 12345 &&&%%%"]


def test_counts_match_the_unigram_tokenizer(spark):
    t = reference(read_pieces(), True)
    rows = [(i, x, 5, 6) for i, x in enumerate(TEXTS)] + [(3, TEXTS[3], 5, 6), (None, "a b", 1, 1)]
    out = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_words int")).collect()
    want = sorted((-1 if r[0] is None else r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in out) == want
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ties_and_unknown_runs_on_small_vocabularies():
    rng = random.Random(2)
    for case in range(60):
        letters = "▁abcd"
        own = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))): float(-rng.randrange(1, 4)) for _ in range(12)}
        pieces = [("<unk>", 0.0), *own.items()]
        t, mine = reference(pieces, False), PieceCounter(pieces)
        for _ in range(40):
            word = "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 14)))
            assert mine.count("▁" + word) == len(t.encode(word).ids), (case, word, pieces)
    assert WORD.findall("a b") == ["a", "b"]
