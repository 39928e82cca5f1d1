"""Token counts of a unigram tokenizer without making its tokens: count-only Viterbi.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; the
dynamic programme keeps, for each position, the best score and how many pieces reach it.
Ties go to the piece that starts first, as in tokenizers that walk forward and replace
only what is strictly worse. Characters of no piece cost their UTF-8 bytes in tokens.

No piece crosses from a letter to a blank or holds a line feed (checked when the vocabulary is
loaded), so the best split of a text is that of its words, and words recur: counts are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import worker_cache

#: The public SentencePiece vocabulary that the query counts with.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Words whose counts a worker remembers; it forgets all when there are more.
REMEMBERED = 400_000
UNKNOWN_PENALTY = 10.0


def load_pieces(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Text pieces and scores of a SentencePiece model: neither control, unknown nor byte pieces. Read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    of_text = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return [(model.id_to_piece(i), model.get_score(i)) for i in of_text]


class Counter(dict):
    """Token counts of words, each as it stands after a blank (or not, for keys with a leading line feed)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if not piece:
                continue
            if BLANK in piece.lstrip(BLANK) or "\n" in piece or " " in piece:
                raise ValueError(f"the piece {piece!r} crosses words; words can't be counted one by one")
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY

    def pieces_of(self, unit: str) -> int:
        """Tokens of the best split of ``unit``, in which blanks are already U+2581.

        Only the states of the last characters that a piece can reach back to are kept, so memory doesn't grow with it.
        """
        ring = self.longest + 1
        best, count = [0.0] * ring, [0] * ring  # of the position modulo ring
        matches = self.automaton.iter(unit)
        end, match = next(matches, (-1, None))
        for e, char in enumerate(unit):
            here = []
            while end == e:
                here.append(match)
                end, match = next(matches, (-1, None))
            top, many = None, 0
            for length, score in sorted(here, reverse=True):  # the longest starts first
                at = (e + 1 - length) % ring
                x = best[at] + score
                if top is None or x > top:
                    top, many = x, count[at] + 1
            if char not in self.single:
                x = best[e % ring] + self.unknown
                if top is None or x > top:
                    top, many = x, count[e % ring] + len(char.encode())
            best[(e + 1) % ring], count[(e + 1) % ring] = top, many
        return count[len(unit) % ring]

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = self.pieces_of(word[1:] if word[:1] == "\n" else BLANK + word)
        return n

    def tokens(self, text: str) -> int:
        """Tokens of a whole text; a blank is put before a text that isn't empty."""
        if not text:
            return 0
        total = 0
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if k:
                total += 1  # the line feed, a byte
                if words[0]:
                    total += self["\n" + words[0]]
                words = words[1:]
            if "" not in words:
                total += sum([self[w] for w in words])
                continue
            blanks = ""
            for w in words:
                if w:
                    total += self[blanks + w]
                    blanks = ""
                else:
                    blanks += BLANK
            if blanks:
                total += self.pieces_of(blanks)
        return total


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each document: doc_id, n_tokens, n_bytes of its whole text (null or empty: 0).

    The vocabulary, some thousand pieces, is read on the driver and broadcast; documents
    are mapped where they are read and nothing is shuffled. A long text is walked word by
    word, and words of any length with states for as many characters as the longest piece has.
    Repeated rows and rows without an id are counted row by row; an empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    pieces = spark.sparkContext.broadcast(load_pieces(vocabulary))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache()
        counter = kept.get(("tokens", vocabulary)) or kept.setdefault(("tokens", vocabulary), Counter(pieces.value))
        for b in batches:
            n = [counter.tokens(t) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), b.column("n_bytes")], ["doc_id", "n_tokens", "n_bytes"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(counted, "doc_id long, n_tokens long, n_bytes long")
