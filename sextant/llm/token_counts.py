"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary lists the pieces that end at each character of
a word; dynamic programming carries the best score, the piece count and where a run of
unknown characters began. The vocabulary is a public file's pieces with their scores, read
as a unigram model. Ties go to the piece that starts first, scores are summed from the left
in double precision, unknown characters score ten less than the lowest piece, adjacent ones
are one run, and a run that is no piece counts as its UTF-8 bytes where all byte pieces are
in the vocabulary and as one piece else: the rules of the public unigram tokenizers.
Words are separated by white space and get the mark U+2581 in front unless they begin with it.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN_PENALTY = 10.0
#: Unicode's White_Space: what separates words.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = re.compile(f"[^{SPACE}]+")
#: Words whose counts a worker keeps.
CACHED_WORDS = 1_000_000

_counters: dict = {}


def read_pieces(path: str | None = None) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, the first being the unknown piece; control pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not model.is_control(i)]


class PieceCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.unknown = pieces[0][0]
        self.pieces = dict(pieces)
        self.bytes = all(f"<0x{b:02X}>" in self.pieces for b in range(256))
        self.least = min(self.pieces.values()) - UNKNOWN_PENALTY
        self.machine = ahocorasick.Automaton()
        for piece, score in self.pieces.items():
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.kept: dict[str, int] = {}

    def run(self, text: str) -> int:
        """Pieces of a run of unknown characters."""
        return len(text.encode()) if self.bytes and text not in self.pieces else 1

    def count(self, text: str) -> int:
        """Pieces of the best segmentation of ``text``, a word with its mark."""
        n = len(text)
        score, pieces, since = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        matches, known, unknown = self.machine.iter(text), self.pieces, self.unknown
        found = next(matches, None)
        for end in range(1, n + 1):
            best, start = None, end
            while found is not None and found[0] == end - 1:
                size, gain = found[1]
                value = gain + score[end - size]
                if best is None or value > best or value == best and end - size < start:
                    best, start = value, end - size
                found = next(matches, None)
            strange = False
            if text[end - 1] not in known:
                value = self.least + score[end - 1]
                if best is None or value > best:
                    best, start, strange = value, end - 1, True
            score[end] = best
            if strange or end - start == len(unknown) and text[start:end] == unknown:
                pieces[end], since[end] = pieces[start], start if since[start] < 0 else since[start]
            else:
                pieces[end] = pieces[start] + 1 + (self.run(text[since[start] : start]) if since[start] >= 0 else 0)
        return pieces[n] + (self.run(text[since[n] : n]) if since[n] >= 0 else 0)

    def words(self, counted: Counter) -> int:
        kept, total = self.kept, 0
        if len(kept) > CACHED_WORDS:
            kept.clear()
        for word, times in counted.items():
            pieces = kept.get(word)
            if pieces is None:
                pieces = self.count(word if word[0] == "▁" else "▁" + word)
                if len(word) <= 64:
                    kept[word] = pieces
            total += pieces * times
        return total


def counter(pieces: list[tuple[str, float]], key: int) -> PieceCounter:
    if key not in _counters:
        _counters.clear()
        _counters[key] = PieceCounter(pieces)
    return _counters[key]


def token_counts(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of every row of ``docs`` (doc_id, text; others are ignored).

    Null, empty and blank texts have no tokens. Repeated rows return repeatedly, null doc_id
    stays null, an empty table gives an empty table. A text is counted whole, whatever its
    length, a word at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(vocabulary_path))
    key = uuid.uuid4().int

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(shared.value, key)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                counted = Counter(WORD.findall(text.as_py() or ""))
                words.append(counted.total())
                tokens.append(model.words(counted))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_words long, n_tokens long")
