"""SentencePiece encoding and decoding by Viterbi over an Aho-Corasick automaton.

The automaton holds all pieces of a model. One pass over a text yields, at each end position, every
piece that ends there (the automaton follows its output links); each relaxes the best score of that
position. The best path maximises the sum of piece scores; ties go to the longer last piece. A character
that no piece covers scores below all pieces and is written as its UTF-8 byte pieces.

No piece holds a character other than the space mark before a space mark, nor a line end, so a best path
never crosses from a word into the next space or line: a text is cut there, and a bounded memo of words
keeps the passes short. The cuts are checked for each model; one without that property is encoded whole.

Round trip: decode(encode(text)) is the text, always. To that end a space mark that a text itself holds
is written as bytes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisect.llm.common import over_texts, table

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words that a task remembers at most, in two generations: when the young one is full it becomes the old
#: one, and words found there are taken over, so frequent words stay.
MEMO_WORDS = 400_000
#: How much an uncovered character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
_LEAST = float("-inf")
_WORDS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


@dataclass
class Vocabulary:
    """Pieces with ids and scores; small (a model's size), read on the driver and sent to the tasks."""

    pieces: list[tuple[str, int, float]]
    byte_ids: list[int]
    text_of: dict[int, bytes | str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, text_of = [], [0] * 256, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                byte = int(piece[1:-1], 16)
                text_of[i] = chr(byte) if byte < 0x80 else bytes([byte])  # no other character holds an ASCII byte
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append((piece, i, model.get_score(i)))
                text_of[i] = piece
        return cls(pieces, byte_ids, text_of)


def _next_none(found: list, start: int) -> int:
    try:
        return found.index(None, start)
    except ValueError:
        return -1


class Codec:
    """Encoder and decoder for one vocabulary; made once in each task."""

    def __init__(self, vocabulary: Vocabulary, memo_words: int = MEMO_WORDS):
        self.byte_ids, self.text_of, self.half = vocabulary.byte_ids, vocabulary.text_of, max(1, memo_words // 2)
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}
        self.automaton = ahocorasick.Automaton()
        lowest = 0.0
        for piece, i, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), i, score))
            lowest = min(lowest, score)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = lowest - UNKNOWN_PENALTY
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p, _, _ in vocabulary.pieces)
        self.alone = frozenset(p for p, _, _ in vocabulary.pieces if len(p) == 1)

    def viterbi(self, text: str) -> list[int]:
        """The ids of the best path over a text whose spaces are marks already."""
        n = len(text)
        best = array("d", [float("-inf")]) * (n + 1)
        size_at, piece_at = array("i", [1]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0], at = 0.0, 0

        def close(upto: int) -> None:
            """Positions below upto get no more pieces; each may be reached by one uncovered character."""
            nonlocal at
            while at < upto:
                at += 1
                if best[at - 1] + self.unknown > best[at]:
                    best[at], size_at[at], piece_at[at] = best[at - 1] + self.unknown, 1, -1

        if len(self.automaton):
            for end, (size, piece, score) in self.automaton.iter(text):
                close(end)  # everything that starts at or before end is final
                reached = best[end + 1 - size] + score
                # longer pieces come first, so a tie keeps the longer one
                if reached > best[end + 1]:
                    best[end + 1], size_at[end + 1], piece_at[end + 1] = reached, size, piece
        close(n)
        out: list[int] = []
        while n:
            start = n - size_at[n]
            if piece_at[n] >= 0:
                out.append(piece_at[n])
            else:
                out.extend(self.byte_ids[b] for b in reversed(text[start:n].encode("utf-8")))
            n = start
        return out[::-1]

    def _covered(self, text: str) -> list[int]:
        """viterbi for a text of which each character is a piece: no character need be uncovered."""
        # the last place is that before the text: its score is 0
        n = len(text)
        best, back = [_LEAST] * n + [0.0], [None] * n
        for end, found in self.automaton.iter(text):
            size, _, score = found
            score += best[end - size]
            if score > best[end]:
                best[end], back[end] = score, found
        out, at = [], n - 1
        while at >= 0:
            size, piece, _ = back[at]
            out.append(piece)
            at -= size
        out.reverse()
        return out

    def _word(self, word: str) -> list[int]:
        """The ids of a word that isn't in the young memo."""
        ids = self.old.get(word)
        if ids is None:
            ids = self._covered(word) if len(word) <= 64 and self.alone.issuperset(word) else self.viterbi(word)
        if len(word) <= 32:
            if len(self.young) >= self.half:
                self.young, self.old = {}, self.young
            self.young[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if MARK in text:
            return self._encode_marks(text)
        marked = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self.viterbi(marked)
        words = _WORDS.findall(marked)
        found = list(map(self.young.get, words))
        if None in found:
            at = -1
            while (at := _next_none(found, at + 1)) >= 0:
                # a word that came up before in this text is in the memo by now
                found[at] = self.young.get(words[at]) or self._word(words[at])
        return list(chain.from_iterable(found))

    def _encode_marks(self, text: str) -> list[int]:
        """Texts that hold the space mark itself: it becomes byte pieces."""
        out: list[int] = []
        for k, part in enumerate(re.split(f"({MARK}+)", text)):
            if k % 2:
                out += [self.byte_ids[b] for b in part.encode("utf-8")]
            elif part or not k:
                marked = part.replace(" ", MARK)
                out += self.viterbi(MARK + marked if not k else marked)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD, ids without a text nothing."""
        text_of = self.text_of
        try:
            text = "".join(map(text_of.__getitem__, ids)).replace(MARK, " ")  # fails if there are byte pieces
        except (TypeError, KeyError):
            parts = [text_of.get(i, "") for i in ids]
            text = b"".join(p if isinstance(p, bytes) else p.replace(MARK, " ").encode("utf-8") for p in parts).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_CODECS: dict[bytes, Codec] = {}


def _codec(vocabulary: Vocabulary, memo_words: int = MEMO_WORDS) -> Codec:
    """This worker's codec, kept from task to task; one vocabulary and one size of memo at a time."""
    key = hashlib.md5(repr((vocabulary.pieces, vocabulary.byte_ids, memo_words)).encode()).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary, memo_words)
    return _CODECS[key]


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, memo_words: int = MEMO_WORDS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, ids, n_tokens, text_crc32.

    text_crc32 is of the text decoded from the ids. A null text has null ids and crc and n_tokens 0, an
    empty text no ids and crc 0. Repeated rows stay; other columns are dropped. memo_words bounds the words that
    a worker remembers (about 0.2 MB a thousand); it changes no result.
    """
    vocabulary = vocabulary or Vocabulary.load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, memo_words)
        for b in batches:
            for s in range(0, b.num_rows, 128):
                part = b.slice(s, 128)
                texts = part.column(1).to_pylist()
                ids = [None if t is None else codec.encode(t) for t in texts]
                crcs = [None if x is None else zlib.crc32(codec.decode(x).encode("utf-8")) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x or ()) for x in ids], pa.int32()), pa.array(crcs, pa.int64())], ["doc_id", "ids", "n_tokens", "text_crc32"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return over_texts(slim, run, "doc_id long, ids array<int>, n_tokens int, text_crc32 long")


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text, null members of ids nothing."""
    vocabulary = vocabulary or Vocabulary.load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for b in batches:
            texts = [None if x is None else codec.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the ids of every whole document, and whether decoding gives the text again."""
    return encode(table(spark, sf_dir, "documents"))
