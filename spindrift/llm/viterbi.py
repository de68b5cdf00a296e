"""Token counts under a unigram vocabulary, without the tokens: a count-only Viterbi.

An Aho-Corasick automaton of the vocabulary's pieces names, in one walk over a text, every
piece that ends at each character.  Dynamic programming carries, for each place, only the best
score of a segmentation up to there and how many tokens it has.  The rules are those of the ``Unigram``
model of the ``tokenizers`` library: a segmentation's score is the sum of its pieces'; of
equal scores the one whose last piece is longer stays; a character that is no piece
of its own may stand alone for the smallest score less 10, and then counts as the tokens of its
UTF-8 bytes if the vocabulary has them, else as one unknown token together with those before it.

Spaces become U+2581, one of which also begins each text.  Where no piece goes on over the
beginning of a word, all scores are whole numbers (sums are then exact) and all bytes have tokens,
a text's best segmentation is that of its words; new words are walked many at a time, and
their results remembered in a bounded dictionary.  With other vocabularies whole texts are walked.

Defined cases: a null or empty text has no tokens and score 0; texts of any length are read whole; equal
scores are told apart as the tokenizer does; repeated rows count each; an empty table gives no rows; other
columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spindrift.llm import common

SPACE = "▁"
PENALTY = 10.0
_MARKS = ",.!?;:%*#$&|"
_WORDS = re.compile(r" *[^ ]+| +")


class UnigramCounter:
    _open: dict[str, UnigramCounter] = {}

    def __init__(self, pieces: list[tuple[str, float]], remember: int = 700_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        known = dict(pieces)  # as in the library, of equal pieces the last one counts
        for k, piece in enumerate(known):
            if piece:
                self.automaton.add_word(piece, k)
        self.automaton.make_automaton()
        self.lengths = np.array([len(p) for p in known])
        self.scores = np.array(list(known.values()), np.float64)
        self.neighbours = {a + b for p in known for a, b in zip(p, p[1:], strict=False)}
        self.alone = min(known.values()) - PENALTY
        self.byte_pieces = all(f"<0x{b:02X}>" in known for b in range(256))
        inside = any(SPACE in p.lstrip(SPACE) for p in known)
        self.by_word = self.byte_pieces and not inside and "\0" not in "".join(known) and all(float(s).is_integer() for s in known.values())
        self.known: dict[str, tuple[int, float]] = {}
        self.remember = remember

    @classmethod
    def shared(cls, path: str) -> UnigramCounter:
        """The pieces and scores of a ``sentencepiece`` file; one counter per Python worker."""
        if path not in cls._open:
            cls._open[path] = cls(pieces_of(path))
        return cls._open[path]

    def walk(self, text: str) -> tuple[int, float]:
        """Tokens and score of a text whose spaces are already U+2581."""
        n = len(text)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at, top, found, single = 1, None, None, False

        def close(e: int, top, found, single) -> None:
            s = e - 1
            score = best[s] + self.alone
            if not single and (top is None or score > top):
                new = len(text[s].encode()) if self.byte_pieces else int(not unknown[s])
                best[e], count[e], unknown[e] = score, count[s] + new, True
            else:
                best[e], count[e] = top, count[found] + 1

        for end, k in self.automaton.iter(text):
            e, length, score = end + 1, int(self.lengths[k]), float(self.scores[k])
            while at < e:
                close(at, top, found, single)
                at, top, found, single = at + 1, None, None, False
            candidate = best[e - length] + score
            if top is None or candidate > top:  # longer pieces come first
                top, found = candidate, e - length
            single |= length == 1
        while at <= n:
            close(at, top, found, single)
            at, top, found, single = at + 1, None, None, False
        return count[n], best[n]

    def _learn(self, words: list[str]) -> None:
        """Walk many new words at once: the automaton names their matches, numpy goes on place by place."""
        texts = [w.replace(" ", SPACE) for w in words]
        size = np.array([len(t) for t in texts])
        begin = np.concatenate([[0], np.cumsum(size + 1)])  # NUL, which is in no piece, stands behind each
        joined = "\0".join(texts) + "\0"
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        end, length, score = found[:, 0] + 1, self.lengths[found[:, 1]], self.scores[found[:, 1]]
        word = np.searchsorted(begin, end - 1, "right") - 1
        place = end - begin[word]  # how many characters of the word the match leaves behind it
        letters = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        wide = 1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF).astype(np.int64)
        longest = int(size.max())
        best, count = np.zeros((longest + 1, len(words))), np.zeros((longest + 1, len(words)), np.int64)
        single = np.zeros(len(letters) + 1, bool)
        single[end[length == 1] - 1] = True
        order = np.argsort(place * 64 - np.minimum(length, 63), kind="stable")  # by place, longer pieces first
        end, length, score, word, place = end[order], length[order], score[order], word[order], place[order]
        at = np.searchsorted(place, np.arange(1, longest + 2))
        for e in range(1, longest + 1):
            here = np.flatnonzero(size >= e)
            top, tokens = np.full(len(words), -np.inf), np.zeros(len(words), np.int64)
            lo, hi = at[e - 1], at[e]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(length[lo:hi])) + 1, [hi - lo]]) + lo
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x < y:
                    w, k = word[x:y], int(length[x])
                    value = best[e - k, w] + score[x:y]
                    better = value > top[w]
                    top[w[better]] = value[better]
                    tokens[w[better]] = count[e - k, w[better]] + 1
            spot = begin[here] + e - 1
            value = best[e - 1, here] + self.alone
            better = ~single[spot] & (value > top[here])
            top[here[better]] = value[better]
            tokens[here[better]] = count[e - 1, here[better]] + wide[spot[better]]
            best[e], count[e] = top, tokens
        last = np.arange(len(words))
        self.known.update(zip(words, zip(count[size, last].tolist(), best[size, last].tolist(), strict=True), strict=True))

    def counts(self, texts: list[str | None], most: int = 40_000) -> list[tuple[int, float]]:
        """Tokens and score of each text."""
        if not self.by_word:
            return [self.walk(SPACE + t.replace(" ", SPACE)) if t else (0, 0.0) for t in texts]
        known, out = self.known, []
        if len(known) > self.remember:
            known.clear()
        split = [_WORDS.findall(" " + t) if t else [] for t in texts]
        new = list({w: None for words in split for w in words if w not in known})
        long = [w for w in new if len(w) > 64 or "\0" in w]
        known.update((w, self.walk(w.replace(" ", SPACE))) for w in long)
        # no piece goes over a word's end into the marks behind it: the two are counted apart
        parts = {w: (w[:k], w[k:]) for w in new if w not in known and 0 < (k := len(w.rstrip(_MARKS))) < len(w) and w[k - 1] != " " and w[k - 1 : k + 1] not in self.neighbours}
        rest = list({p: None for w in new if w not in known for p in parts.get(w, (w,)) if p not in known})
        for k in range(0, len(rest), most):
            self._learn(rest[k : k + most])
        known.update((w, (known[a][0] + known[b][0], known[a][1] + known[b][1])) for w, (a, b) in parts.items())
        for words in split:
            n, s = zip(*map(known.__getitem__, words), strict=True) if words else ((), ())
            out.append((sum(n), sum(s, 0.0)))
        return out


def pieces_of(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), float(model.get_score(k))) for k in range(model.get_piece_size())]


def token_counts(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, score`` of every row: one pass over the texts."""
    common.prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter.shared(path)
        for batch in common.slices(batches, 1):
            found = counter.counts(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "n_tokens", "score"])

    return common.pick(documents, id_col, text_col).mapInArrow(common.frugal(run), "doc_id long, n_tokens long, score double")
