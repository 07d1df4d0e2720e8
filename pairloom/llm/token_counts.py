"""Token counts by count-only Viterbi over a unigram vocabulary.

A text is written with U+2581 for spaces, one in front. An Aho-Corasick automaton enumerates all
vocabulary pieces in it; dynamic programming over the places of the text carries only the best
score and the number of pieces of the best segmentation, never the segmentation itself.

Tie rules, those of the tokenizers library's Unigram model: scores are summed as 64-bit floats; of
equal sums at a place the piece that starts first stays; a character that is no piece itself may be
unknown, at the least score less 10. With a byte piece for every byte, unknown characters count
one for each UTF-8 byte; else a run of unknown characters counts one.

No piece has U+2581 behind another character (checked when the vocabulary is read), so the best
segmentation never crosses the place in front of a U+2581 that follows another character, and the
words can be counted one by one: sums of whole scores are exact. If some piece does, or a score is
no whole number, texts are counted whole. Words repeat, so a Python worker keeps the results of a
bounded number of them.

The default vocabulary is the pieces and scores of a public SentencePiece file. That is a BPE model, whose scores are
ranks and no log probabilities (no unigram file is at hand): the segmentation is the unigram model's best under these scores.

Edge cases: a null or empty text has 0 tokens and score 0. Repeated rows give repeated results; an
empty table an empty one. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

SPACE = "▁"
UNKNOWN_LESS = 10.0
CACHED_WORDS = 400_000


class Unigram:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        for p, s in pieces:
            if p:
                self.trie.add_word(p, (len(p), float(s)))
        self.trie.make_automaton()
        names = {p for p, _ in pieces}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_LESS
        self.by_bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        whole = all(float(s).is_integer() and abs(s) < 2**31 for _, s in pieces)
        self.by_words = whole and self.by_bytes and not any(SPACE in p.lstrip(SPACE) for p in names)
        self.cache: dict[str, tuple[int, float]] = {}

    def viterbi(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation."""
        n, none = len(text), float("-inf")
        score, count, known_end = [none] * (n + 1), [0] * (n + 1), [True] * (n + 1)
        score[0], at, single = 0.0, 0, False

        def unknown(i: int) -> None:  # the last to try at a place, since it starts last
            s = score[i - 1] + self.unknown
            if s > score[i]:
                score[i] = s
                fused = not self.by_bytes and not known_end[i - 1]
                count[i] = count[i - 1] + (len(text[i - 1].encode()) if self.by_bytes else 0 if fused else 1)
                known_end[i] = False

        for end, (length, s) in self.trie.iter(text):  # at each place the longest first
            i = end + 1
            while at < i:
                if at and not single:
                    unknown(at)
                at, single = at + 1, False
            s += score[i - length]
            if s > score[i]:
                score[i], count[i], known_end[i] = s, count[i - length] + 1, True
            single |= length == 1
        while at <= n:
            if at and not single:
                unknown(at)
            at, single = at + 1, False
        return count[n], score[n]

    def word(self, w: str) -> tuple[int, float]:
        found = self.cache.get(w)
        if found is None:
            found = self.viterbi(w)
            if len(w) < 200:
                if len(self.cache) >= CACHED_WORDS:
                    self.cache.clear()
                self.cache[w] = found
        return found

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if not self.by_words:
            return self.viterbi(SPACE + text.replace(" ", SPACE))
        # A run of spaces belongs to the word behind it.
        n, total, spaces = 0, 0.0, 0
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            for w, times in Counter(words).items():
                k, s = self.word(SPACE + w)
                n, total = n + k * times, total + s * times
            return n, total
        for w in words:
            spaces += 1
            if w:
                k, s = self.word(SPACE * spaces + w)
                n, total, spaces = n + k, total + s, 0
        if spaces:
            k, s = self.word(SPACE * spaces)
            n, total = n + k, total + s
        return n, total


def vocabulary(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


@lru_cache(2)
def unigram(path: str) -> Unigram:
    """One for each Python worker and file."""
    return Unigram(vocabulary(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and score of the best segmentation of each whole text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = unigram(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                done = [u.count(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.float64())], ["doc_id", "n_tokens", "score"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, score double")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
