"""Concatenate and cut: documents as one stream of token ids, cut into sequences of fixed length.

Pass one tokenises every text once and stores the ids together with the number
of ids before the text in its partition. The totals of the partitions, one
number each, give every partition its place in the whole stream. Pass two cuts
each text where a sequence ends; a text that crosses a border leaves one record
on each side. No text is shuffled, and nothing runs in one task but the sum of
one number per partition.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from panelmill.llm import kernels as K
from panelmill.llm.stores import Stores

#: Words that a task remembers; beyond that it starts anew, which costs time only.
CACHE_WORDS = 800_000
_GROUP = 256
_TOKENS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
_LETTERS_AND_MARKS = re.compile(rb"([A-Za-z]+|[A-Za-z\x80-\xff]+)([!-&(-/:;=?@\[-`~]*)")

_PROBES = ("a", "the", "tokens", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba")


class _WordIds:
    """Ids of words between white space, as little-endian bytes.

    Holds for tokenizers whose tokens never span white space and that drop it.
    A word of letters and ASCII marks is looked up as its two parts; new parts are
    encoded many at a time and told apart by the tokens that end a word.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(size, bool)
        if suffix:
            for token, i in self.tokenizer.get_vocab().items():
                self.ends[i] = token.endswith(suffix)
        # Lower-case ASCII letters pass most normalisers unchanged; then the model alone gives their ids.
        self.direct = all(
            [t.id for t in self.tokenizer.model.tokenize(w)] == self.tokenizer.encode(w, add_special_tokens=False).ids for w in _PROBES
        )
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {b"": b""}

    def _learn_parts(self, parts: list[bytes]) -> None:
        """Parts that the tokenizer takes as one word each."""
        if self.direct:
            tokenize = self.tokenizer.model.tokenize
            plain = [p for p in parts if p.isascii() and p.isalpha()]
            self.parts.update((p, np.array([t.id for t in tokenize(p.decode())], self.kind).tobytes()) for p in plain)
            parts = [p for p in parts if p not in self.parts]
        for low in range(0, len(parts), 4096):
            some = parts[low : low + 4096]
            coded = self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)
            ids = np.array(coded[0].ids, self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                code, step = ids.tobytes(), self.kind.itemsize
                stops = (stops * step).tolist()
                self.parts.update(zip(some, [code[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
            else:
                self._learn_singly(some, self.parts)

    def _learn_singly(self, some: list[bytes], into: dict[bytes, bytes]) -> None:
        coded = self.tokenizer.encode_batch_fast([s.decode() for s in some], add_special_tokens=False)
        into.update((s, np.array(c.ids, self.kind).tobytes()) for s, c in zip(some, coded, strict=True))

    def learn(self, missing: set[bytes]) -> None:
        pairs, whole, match = [], [], _LETTERS_AND_MARKS.fullmatch
        for word in missing:
            found = match(word)
            if found is not None:
                head, tail = found.groups()
                if head.isascii():
                    pairs.append((word, head.lower(), tail))
                    continue
                if head.decode().isalpha():
                    pairs.append((word, head, tail))
                    continue
            whole.append(word)
        fresh = {h for _, h, _ in pairs}.union(t for _, _, t in pairs).difference(self.parts)
        if fresh:
            self._learn_parts(list(fresh))
        if whole:
            self._learn_singly(whole, self.words)
        parts = self.parts
        self.words.update((w, parts[h] + parts[t]) for w, h, t in pairs)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        split = [t.split() for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        if len(self.parts) > CACHE_WORDS:
            self.parts = {b"": b""}
        missing = set().union(*split).difference(self.words)
        if missing:
            self.learn(missing)
        known = self.words.__getitem__
        for ws in split:
            yield b"".join(map(known, ws))


def _tokenise(vocabulary, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _WordIds(vocabulary.value)
        end = np.array([end_id], coder.kind).tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw, offsets = K.text_bytes(batch.column(1))
            for low in range(0, batch.num_rows, _GROUP):
                high = min(low + _GROUP, batch.num_rows)
                texts = [raw[offsets[i] : offsets[i + 1]].tobytes() for i in range(low, high)]
                ids = [x + end for x in coder.encode(texts)]
                n = [len(x) // coder.kind.itemsize for x in ids]
                starts = before + np.cumsum([0, *n[:-1]])
                before += sum(n)
                yield K.batch_of(_TOKENS, batch.column(0)[low:high], [part] * len(n), starts, n, ids)

    return run


def _cut(bases, length: int, wide: bool):
    kind = np.dtype("<u4") if wide else np.dtype("<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = bases.value
        for batch in batches:
            rows = []
            for doc, part, before, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code = np.frombuffer(ids, kind).astype("<u4").tobytes()
                place, start = at[part] + before, 0
                while start < n:
                    sequence, offset = divmod(place + start, length)
                    size = min(n - start, length - offset)
                    rows.append((doc, start, size, zlib.crc32(code[4 * start : 4 * (start + size)]), n, sequence, offset))
                    start += size
            yield K.batch_of(_PIECES, *(zip(*rows, strict=True) if rows else [()] * 7))

    return run


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, stores: Stores) -> DataFrame:
    """(doc_id, part, before, n, ids) of every row, stored: its partition and the ids before it there."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    coded = docs.select("doc_id", "text").mapInArrow(_tokenise(held, end_id), "doc_id long, part int, before long, n long, ids binary")
    return stores.keep(coded, "tokens")


def packed(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all rows of ``docs``.

    ``vocabulary`` is the text of a tokenizer file whose tokens never span white
    space. Every row has at least the closing id, so a null or empty text is one
    piece of one id. Rows without doc_id and repeated rows are packed like any
    other. Only the last sequence is padded (by less than ``length``). An empty
    table has no pieces. Other columns are ignored.

    Broadcast: the vocabulary file and one number per partition of the scan.
    """
    stores = Stores(docs.sparkSession)
    tokens = tokenised(docs, vocabulary, end_id, stores)
    totals = {r.part: r.total for r in tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total")).collect()}
    bases, place = {}, 0
    for part in sorted(totals):
        bases[part], place = place, place + totals[part]
    held = docs.sparkSession.sparkContext.broadcast(bases)
    from tokenizers import Tokenizer

    wide = Tokenizer.from_str(vocabulary).get_vocab_size() > 1 << 16
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokens.mapInArrow(_cut(held, length, wide), schema)
