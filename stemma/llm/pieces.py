"""SentencePiece byte-pair encoding by a table of every prefix's last token, and decoding."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name of the public vocabulary.
MODEL = "piece_bpe_32k"
SPACE = "▁"
CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words that a worker remembers, the length up to which it does, and the length of a text from which words are found one by one.
KEPT, SHORT, LONG = 1 << 18, 48, 1 << 20
NEVER = float("inf")
#: Ids in an Arrow batch of results, about.
BATCH = 1 << 18


@lru_cache(2)
def processor(name: str):
    """The library's own reader of the vocabulary; it normalises texts before, and decodes ids after, the encoder below."""
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))


def kept(words: dict[str, bytes], word: str, out: bytes) -> bytes:
    if len(word) < SHORT:
        if len(words) >= KEPT:
            words.clear()
        words[word] = out
    return out


class Starts(dict):
    """From words at the start of a line, with no space before them, to the bytes of their ids."""

    def __init__(self, packed: Callable[[str], bytes]):
        super().__init__()
        self.packed = packed

    def __missing__(self, word: str) -> bytes:
        return kept(self, word, self.packed(word))


class Encoder(dict):
    """Encodes normalised texts; as a dictionary, from words to the bytes of their ids, a word being what stands behind a space.

    By merges alone each text has one encoding, and the beginnings of an encoding are encodings themselves. So every prefix of
    a text has one last token: of the pieces that end there, which an automaton finds, the one that goes together with the last
    token of what is left before it. Two tokens go together if merging their joint text gives just them. The ids
    are then read off backwards, from the last token of the whole.

    A character that no piece has is written as its bytes' tokens and merges with nothing; it ends a prefix by itself.
    Texts are cut before spaces, where no piece can reach across, so that words which repeat are encoded once.
    """

    def __init__(self, name: str):
        super().__init__()
        sp = processor(name)
        size = self.size = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.texts = {i: sp.id_to_piece(i) for i in range(size) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.ids = {piece: i for i, piece in self.texts.items()}
        self.ranks = {piece: -sp.get_score(i) for i, piece in self.texts.items()}
        self.lengths = [len(self.texts.get(i, "")) for i in range(size)]
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        #: Pieces that their own text's encoding consists of.
        self.whole = {i for i, piece in self.texts.items() if self.merged(piece) == [i]}
        self.automaton = ahocorasick.Automaton()
        for i in self.whole:
            self.automaton.add_word(self.texts[i], (i, self.lengths[i]))
        self.automaton.make_automaton()
        self.together: dict[int, bool] = {}
        #: What a line feed is written as, if no piece has it; lines are then cut there, too.
        self.lines = b"" if any("\n" in piece for piece in self.ids) else self.packed("\n")
        self.starts = Starts(self.packed)
        self.crossed = any(SPACE in piece.lstrip(SPACE) for piece in self.ids)

    def merged(self, text: str) -> list[int | None]:
        """A short text's ids by merging: again and again the best pair of neighbours, of equal ones the first."""
        rank, parts = self.ranks.get, list(text)
        costs = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while costs and (least := min(costs)) < NEVER:
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1], NEVER)
        return [self.ids.get(p) for p in parts]

    def fits(self, before: int, token: int) -> bool:
        """Whether a token can follow another in an encoding."""
        if len(self.together) >= 4 * KEPT:
            self.together.clear()
        fit = self.together[before * self.size + token] = self.merged(self.texts[before] + self.texts[token]) == [before, token]
        return fit

    def last_tokens(self, text: str) -> list[int]:
        """The last token of each prefix; for a character without a piece -1, as if a text began behind it."""
        last = [-1] * (len(text) + 1)
        done, known, size = 0, self.together.get, self.size
        for end, (token, length) in self.automaton.iter(text):
            # matches come from the longest to the shortest, and the first that fits is the only one; a character always fits if no longer one does
            if end >= done:
                before = last[end + 1 - length]
                if length > 1 and before >= 0:
                    fit = known(before * size + token)
                    if not fit and (fit is not None or not self.fits(before, token)):
                        continue
                done = end + 1
                last[done] = token
        return last

    def packed(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        last, at, ids, lengths = self.last_tokens(text), len(text), [], self.lengths
        while at:
            token = last[at]
            if token >= 0:
                ids.append(token)
                at -= lengths[token]
            else:
                at -= 1
                ids += [self.byte[b] for b in reversed(text[at].encode())] if self.byte else [self.unknown]
        ids.reverse()
        return array("i", ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if self.lines and "\n" in word:
            head, *rest = word.split("\n")
            return self[head] + b"".join(self.lines + self.starts[x] for x in rest)
        return kept(self, word, self.packed(SPACE + word))

    def encode(self, normal: str) -> np.ndarray:
        if self.crossed:
            return np.frombuffer(self.packed(normal), np.int32)
        if normal[:1] == SPACE and SPACE + SPACE not in normal and len(normal) < LONG:
            parts = map(self.__getitem__, normal[1:].split(SPACE))
        else:  # runs of spaces stay with what follows, as pieces of several spaces are possible
            parts = (self[m[0][1:]] if m[0][0] == SPACE else self.packed(m[0]) for m in CHUNKS.finditer(normal))
        return np.frombuffer(b"".join(parts), np.int32)


@lru_cache(2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows]), pa.int32()))


def encode(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """doc_id, ids for every row of ``docs`` (doc_id, text): the ids of the whole text, as the vocabulary's own library gives them.

    No begin or end ids are added. A null or empty text has no ids. The names of control tokens in a text are ordinary text; what no
    piece has is written by bytes. Rows without an id and repeated rows are encoded each, other columns are not read, and
    an empty table gives no rows. A task holds a batch of texts and about ``BATCH`` ids besides those of one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, own = processor(name), encoder(name)
        for b in batches:
            at, rows, held = 0, [], 0
            for text in b.column(1):
                rows.append(own.encode(sp.normalize(text.as_py() or "")))
                held += len(rows[-1])
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(rows)), _lists(rows)], ["doc_id", "ids"])
                    at, rows, held = at + len(rows), [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(rows)), _lists(rows)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = MODEL) -> DataFrame:
    """``encoded`` (doc_id, ids) with the text that the vocabulary's library decodes each row's ids to.

    No ids give an empty text, and so do null ids. Ids outside the vocabulary, which encode never gives, fail.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(name)
        for b in batches:
            texts = [sp.decode(ids.values.to_pylist()) if ids.is_valid and len(ids.values) else "" for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
