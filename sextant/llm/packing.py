"""Hierarchical packing of documents into sequences of several context sizes.

Documents longer than the longest window give whole windows first. What is left is routed
to the smallest tier that holds it. From the longest tier down, each document opens a window
of its tier, and the window's gap is filled with the longest shorter documents that fit and
at last with a cut piece, so windows are full. When no document is left to fill a window,
its tokens are dealt to sequences whose lengths are powers of two, which need no padding.
Sequences are then dealt to step groups of equal size.

The rows are packed where they are read, a chunk of bounded size at a time: no shuffle, and a
lost task packs the same rows the same way again.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 1
TIERS = (256, 512, 1024, 2048)
#: Tokens that a step group holds.
STEP_TOKENS = 16 * 2048
#: Tokens packed at once.
CHUNK_TOKENS = 1 << 21
#: Pieces of a generation of those whose ids a worker keeps.
CACHED_PIECES = 250_000

_encoders: dict = {}


def _class(kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] in kinds)


def _byte_letters() -> list[str]:
    """The printable stand-ins of byte-level tokenizers: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in own else chr(256 + next(rest)) for b in range(256)]


#: Texts of characters below this are cut here; the tokenizer's own rules cut others.
PLAIN = 0x180
STRANGE = re.compile("[^\\x00-\\u017f]|\\u0130|<\\|")
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\\t-\\r \\x85\\xa0{_class('LN')}]+")
PRINTED = _byte_letters()


class WordEncoder:
    """Ids of whole texts by way of their pieces, for the lower-casing BPE with word ends.

    That tokenizer composes and lower-cases the text, cuts it into runs of letters, single
    numerals, contractions and runs of other characters, and merges within these pieces
    only; so equal pieces have equal ids, which are kept for frequent ones in two
    generations. Texts without rare characters are cut here and their unknown pieces go to
    the merge model many at once; each piece ends in exactly one id with the word end. Other
    texts go word by word through the whole tokenizer.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.young, self.old = Tokenizer.from_str(spec), {}, {}
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that aren't kept."""
        for i in range(0, len(pieces), 5000):
            part = pieces[i : i + 5000]
            text = " ".join([p if p.isascii() and p.isprintable() else "".join([PRINTED[b] for b in p.encode()]) for p in part])
            ids = np.array(self.merger.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            flat = ids.tobytes()
            self.young.update(zip(part, [flat[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)], strict=True))

    def strange(self, text: str) -> bytes:
        """Ids by the whole tokenizer, a word at a time."""
        words = text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
        if len(self.words) > CACHED_PIECES:
            self.words = {}
        missing = list(set(words).difference(self.words))
        for w, e in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, dtype="<u4").tobytes()
        return b"".join([self.words[w] for w in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [None if STRANGE.search(t) else PIECE.findall(t.lower()) for t in texts]
        if len(self.young) > CACHED_PIECES:
            self.young, self.old = {}, self.young
        missing = set().union(*[c for c in cut if c]).difference(self.young)
        kept = missing.intersection(self.old)
        self.young.update((p, self.old[p]) for p in kept)
        self.learn(list(missing - kept))
        known = self.young
        return [self.strange(t) if c is None else b"".join([known[p] for p in c]) for t, c in zip(texts, cut, strict=True)]


def encoder(spec: str) -> WordEncoder:
    if hash(spec) not in _encoders:
        _encoders.clear()
        _encoders[hash(spec)] = WordEncoder(spec)
    return _encoders[hash(spec)]


def pack(lengths: Iterable[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (length, [(document, start, length)...]) for documents of the given token counts.

    Every token lies in exactly one piece; a sequence's pieces fill it. Sequences have a
    tier's length or, for the tokens that no window needs, another power of two.
    """
    longest = tiers[-1]
    sequences: list[tuple[int, list[tuple[int, int, int]]]] = []
    pool: list[tuple[int, int, int]] = []  # (length, document, start), ascending
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= longest:
            sequences.append((longest, [(doc, at, longest)]))
            at += longest
        if n > at:
            pool.append((n - at, doc, at))
    pool.sort()
    while pool:
        n, doc, at = pool.pop()
        tier = next(t for t in tiers if n <= t)
        pieces, gap = [(doc, at, n)], tier - n
        while gap and pool:
            k = bisect_right(pool, (gap, math.inf))
            if k:
                m, other, start = pool.pop(k - 1)
                pieces.append((other, start, m))
                gap -= m
            else:
                m, other, start = pool.pop(0)
                pieces.append((other, start, gap))
                rest = (m - gap, other, start + gap)
                pool.insert(bisect_right(pool, rest), rest)
                gap = 0
        if not gap:
            sequences.append((tier, pieces))
            continue
        rest = tier - gap
        for size in (1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1):
            need, own = size, []
            while need:
                other, start, m = pieces.pop(0)
                own.append((other, start, min(m, need)))
                if m > need:
                    pieces.insert(0, (other, start + need, m - need))
                need -= own[-1][2]
            sequences.append((size, own))
    return sequences


def step_groups(lengths: list[int], tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence, the long ones dealt first so that groups but the last hold ``tokens`` exactly."""
    groups, group, held = [0] * len(lengths), 0, 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if held + lengths[i] > tokens:
            group, held = group + 1, 0
        groups[i] = group
        held += lengths[i]
    return groups


def packing(docs: DataFrame, tokenizer_path: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Packs every row of ``docs`` (doc_id, text; others are ignored), null text being empty.

    A document is its text's ids and then ``end_id``. Returns a row per piece: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, step_group and, with
    ``with_ids``, ids. Repeated rows and null doc_id are documents of their own. There is no
    padding: a sequence is as long as a tier or another power of two. An empty table gives an
    empty table. Very long texts are cut at the longest window and need their own ids in
    memory only.
    """
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def chunk(held: list, base: int) -> tuple[pa.RecordBatch, int]:
        names = [d for d, _ in held]
        ids = [np.frombuffer(b, dtype="<u4") for _, b in held]
        sequences = pack(map(len, ids), tiers)
        groups = step_groups([n for n, _ in sequences])
        cols: list[list] = [[] for _ in range(9)]
        parts = []
        for k, (size, pieces) in enumerate(sequences):
            at = 0
            for doc, start, n in pieces:
                part = ids[doc][start : start + n]
                for c, v in zip(cols, (names[doc], start, n, zlib.crc32(part), len(ids[doc]), base + k, at, size, base + groups[k]), strict=True):
                    c.append(v)
                if with_ids:
                    parts.append(part)
                at += n
        arrays = [pa.array(c, pa.int64()) for c in cols]
        if with_ids:
            flat = np.concatenate(parts) if parts else np.zeros(0, "<u4")
            ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32))))
        return pa.RecordBatch.from_arrays(arrays, names=names_out), base + len(sequences)

    names_out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"] + ["ids"] * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        end = np.array([end_id], dtype="<u4").tobytes()
        base, held, tokens = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                for doc, ids in zip(rows.column(0).to_pylist(), enc.encode([t or "" for t in rows.column(1).to_pylist()]), strict=True):
                    held.append((doc, ids + end))
                    tokens += len(ids) // 4 + 1
                    if tokens >= CHUNK_TOKENS:
                        out, base = chunk(held, base)
                        yield out
                        held, tokens = [], 0
        if held:
            yield chunk(held, base)[0]

    schema = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names_out)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)
