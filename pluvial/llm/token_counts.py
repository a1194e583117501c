"""How many unigram pieces a text has, without making the pieces.

Texts are cut before a space that follows a non-space, where no piece of the
vocabulary crosses (with a vocabulary that has such a piece, nowhere); so a run
of spaces and the word after it are one stretch, and pieces of several space
marks count. Stretches are segmented by Viterbi: an Aho-Corasick automaton lists the pieces that end at each place, and the best
score and its number of pieces are carried along. Ties go by the rule of the
tokenizers library's Unigram model: a candidate replaces an earlier one only if
its score is higher, and candidates come in order of their start, so of equal
ones the longest last piece stays. A character that is no piece costs the
lowest score less 10 and counts its UTF-8 bytes (byte fallback) or, with its
unknown neighbours, one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship

MARK, UNKNOWN, KEPT = "▁", 10.0, 300_000
_STRETCH = re.compile(" +[^ ]*")


class Counter(dict):
    """Piece counts by stretch (without its first space), kept for up to KEPT stretches."""

    def __init__(self, pieces: Sequence[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        for piece, score in dict(reversed(pieces)).items():  # of equal pieces the first counts
            if piece:
                self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN
        self.byte_fallback = byte_fallback
        # a mark that is no piece may join its unknown neighbours
        self.whole = any(MARK in p.lstrip(MARK) for p, _ in pieces) or not byte_fallback and all(p != MARK for p, _ in pieces)

    def __missing__(self, word: str) -> int:
        n = self.count(MARK + word.replace(" ", MARK))
        if len(self) >= KEPT:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        """Pieces of one stretch of text that already has its marks."""
        score, pieces, open_ = [0.0], [0], [False]  # open: ends in a character that is no piece
        found = self.trie.iter(text)
        at, hits = next(found, (len(text), None))
        for end in range(len(text)):
            best, start, single = float("-inf"), -1, False
            while at == end:
                length, own = hits
                single |= length == 1
                candidate = score[end + 1 - length] + own
                if candidate > best or candidate == best and end + 1 - length < start:
                    best, start = candidate, end + 1 - length
                at, hits = next(found, (len(text), None))
            if not single and score[end] + self.unknown > best:
                score.append(score[end] + self.unknown)
                more = len(text[end].encode("utf-8", "surrogatepass")) if self.byte_fallback else 0 if open_[end] else 1
                pieces.append(pieces[end] + more)
                open_.append(True)
            else:
                score.append(best)
                pieces.append(pieces[start] + 1)
                open_.append(False)
        return pieces[-1]

    def text(self, text: str) -> int:
        """Pieces of a whole text: a mark for each space, and one before the text unless it starts with a space."""
        if not text:
            return 0
        text = text.replace(MARK, " ")
        if text[0] != " ":
            text = " " + text
        if self.whole:
            return self.count(text.replace(" ", MARK))
        words = [x[1:] for x in _STRETCH.findall(text)] if "  " in text else text.split(" ")[1:]
        return sum(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def pieces_of(model_path: str) -> tuple[tuple[str, float], ...]:
    """Pieces and scores of a sentencepiece model file, without its control symbols."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return tuple((sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i))


@lru_cache(maxsize=2)
def _counter(model_path: str) -> Counter:
    return Counter(pieces_of(model_path))


def count(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` of every whole text under the unigram model with the file's pieces and scores.

    A null or empty text has 0. Repeated rows come out as often; a null id
    stays null; other columns are not read. Counts of words are kept for the
    next texts in a bounded memory.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = _counter(model_path)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                own = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([counter.text(t or "") for t in own.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint")
