"""Token ids of whole texts, made inside Spark tasks with the tokenizers library.

Byte-level BPE with the usual pattern never joins text across `x y`: a token starts right before a
single blank that stands between two visible characters, and a line feed between two visible characters
is a token of its own. Texts are therefore cut at those places: a batch becomes one column of words, each distinct
word is encoded once by the library and remembered, and ids are gathered by number. The ids are those of
encoding the whole text (tested); natural text repeats its words, so most come from the memo.
The operators leave the library's default for special tokens: their strings in a text get their own ids.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

END_ID = 2
MEMO_CHUNKS = 300_000  # distinct chunks in each of a worker's two generations

# both neighbours visible ASCII or Latin letters: white space under no library's definition
_VISIBLE = "!-~À-ɏ"
_CUT = re.compile(f"(?<=[{_VISIBLE}])(?= [{_VISIBLE}])|(?<=[{_VISIBLE}])(?=\n[{_VISIBLE}])|(?<=[{_VISIBLE}]\n)(?=[{_VISIBLE}])")
# texts that are more than visible characters with single blanks and line feeds between them
_ODD = f"[^ \\n{_VISIBLE}]|[ \\n][ \\n]|^[ \\n]|[ \\n]$|^$"
BLANK, LINE_FEED = "Ġ", "Ċ"  # how byte-level BPE writes them
_SPACE = re.compile(r"\s")
FIRST, LAST = "\0", "\1"  # before a word without a blank; the end of a text
TOGETHER = 500  # new words that are encoded as one text


class _Memo:
    """Ids of chunks in one growing array: `codes` numbers the chunks, `bounds[code]` is where a chunk's ids begin."""

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.bounds, self.ids, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0

    def add(self, chunks: Sequence[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n, m = len(self.codes), len(chunks)
        while len(self.bounds) < n + m + 1:
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.codes.update(zip(chunks, range(n, n + m)))
        self.bounds[n + 1 : n + m + 1] = self.used + np.cumsum(sizes)
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def find(self, chunks: list[str]) -> np.ndarray:
        """Codes of chunks, -1 for unknown ones."""
        return np.fromiter(map(self.codes.get, chunks, repeat(-1)), np.int64, len(chunks))

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of the chunks, one behind the other."""
        start = self.bounds[codes]
        sizes = self.bounds[codes + 1] - start
        place = np.cumsum(sizes) - sizes
        return sizes, self.ids[np.repeat(start - place, sizes) + np.arange(sizes.sum())]


class TextEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids; `vocabulary` is the tokenizer file's JSON."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark owns the cores
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(vocabulary)
        self._tokenizer.no_padding()
        self._tokenizer.no_truncation()
        words = self._tokenizer.get_vocab()
        self.largest_id = max(words.values(), default=0)
        self._with_blank = np.zeros(self.largest_id + 1, bool)
        self._with_blank[[i for w, i in words.items() if w.startswith(BLANK)]] = True
        self._line_feed = np.zeros(self.largest_id + 1, bool)
        self._line_feed[[i for w, i in words.items() if w == LINE_FEED]] = True
        self._memo, self._older, self._end = _Memo(), _Memo(), -1

    def encode(self, texts: pa.Array | list[str | None], end_id: int = END_ID) -> Iterator[bytes]:
        """The ids of each text, one after the other; null counts as empty; `end_id` closes each."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if end_id != self._end:  # the memo knows the end as a chunk
            self._memo, self._older, self._end = _Memo(), _Memo(), end_id
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        parts = self._words(texts.filter(pa.array(~odd)))
        for text, slow in zip(texts, odd):
            yield self._pieces(text.as_py()) if slow else next(parts)

    def _words(self, texts: pa.Array) -> Iterator[bytes]:
        """Texts with single blanks and line feeds between visible characters only, as columns of words."""
        marked = pc.binary_join_element_wise(FIRST, pc.replace_substring(texts, "\n", f" \n {FIRST}"), f" {LAST}", "")
        lists = pc.split_pattern(marked, " ")
        words = lists.flatten().dictionary_encode()
        codes = self._codes(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        sizes, ids = self._memo.take(codes)
        upto = np.concatenate([[0], np.cumsum(sizes)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist() if len(texts) else []
        for a, b in zip(upto, upto[1:]):
            yield ids[a:b].tobytes()

    def _pieces(self, text: str) -> bytes:
        """Any other text."""
        pieces = [FIRST + x for x in _CUT.split(text)] if text else []
        codes = self._codes([*pieces, LAST])
        return self._memo.take(codes)[1].tobytes()

    def _codes(self, chunks: list[str]) -> np.ndarray:
        """Codes in the memo: a plain word has a blank before it, FIRST stands for none, LAST for the end."""
        if len(self._memo.codes) > MEMO_CHUNKS:  # what is not met again during a generation is forgotten
            self._older, self._memo = self._memo, _Memo()
        codes = self._memo.find(chunks)
        if len(new := np.flatnonzero(codes < 0)):
            self._learn(list({chunks[k]: None for k in new.tolist()}))
            codes[new] = self._memo.find([chunks[k] for k in new.tolist()])
        return codes

    def _learn(self, new: list[str]) -> None:
        old = self._older.find(new)
        if len(at := np.flatnonzero(old >= 0)):
            self._memo.add([new[k] for k in at.tolist()], *self._older.take(old[at]))
            new = [new[k] for k in np.flatnonzero(old < 0).tolist()]
        kinds: tuple[list[str], list[str], list[str]] = ([], [], [])
        for c in new:
            kinds[0 if c >= "!" else 1 if c[:1] == FIRST and not _SPACE.search(c) else 2].append(c)
        # many words go as one text: what stands between them shows in the ids where each begins
        self._together(kinds[0], [" " + c for c in kinds[0]], "", self._with_blank)
        self._together(kinds[1], [c[1:] for c in kinds[1]], "\n", self._line_feed)
        self._one_by_one(kinds[2], [c[1:] if c[:1] == FIRST else c for c in kinds[2]])

    def _together(self, chunks: list[str], texts: list[str], between: str, marks: np.ndarray) -> None:
        groups = [slice(k, k + TOGETHER) for k in range(0, len(chunks), TOGETHER)]
        for g, code in zip(groups, self._tokenizer.encode_batch_fast([between + between.join(texts[g]) for g in groups], add_special_tokens=False)):
            ids = np.array(code.ids, np.uint32)
            at = np.flatnonzero(marks[ids])
            if len(at) == len(chunks[g]) and at[0] == 0:
                sizes = np.diff(at, append=len(ids))
                if between:
                    ids, sizes = ids[~marks[ids]], sizes - 1
                self._memo.add(chunks[g], sizes, ids)
            else:
                self._one_by_one(chunks[g], texts[g])

    def _one_by_one(self, chunks: list[str], texts: list[str]) -> None:
        if chunks:
            ids = [[self._end] if c == LAST else x.ids for c, x in zip(chunks, self._tokenizer.encode_batch_fast(texts, add_special_tokens=False))]
            self._memo.add(chunks, np.array([len(x) for x in ids]), np.array([i for x in ids for i in x], np.uint32))


def share_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file (a few MB, whatever the corpus), read once on the driver and broadcast."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


_ENCODERS: dict[int, TextEncoder] = {}


def encoder(vocabulary: Broadcast) -> TextEncoder:
    """This worker's encoder for a broadcast vocabulary; its memo lives as long as the worker."""
    text = vocabulary.value
    key = hash(text)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TextEncoder(text)
    return _ENCODERS[key]
