"""Language identification by segmentation-marginalised unigrams.

A language is a probability for every piece of a fixed public vocabulary. A word may be cut into
pieces in many ways; its probability under a language is the sum over all segmentations of the product
of the pieces' probabilities, found by a forward pass. A text's score adds its words' logarithms to
the prior; the posterior of the best language is the answer.

The piece probabilities are learned by expectation maximisation: a forward and a backward pass give the
expected count of every piece over all segmentations of the counted words of each language. Words are
counted and expected counts added up by Spark; what comes to the driver is one number per language and
piece. Words come from about ``MOST_TEXTS`` whole texts a language, chosen by a hash of the id.

A word is a run of letters in lower case, a run of over ``UNIT`` letters one word per ``UNIT`` of them (so
that no product leaves the range of doubles).
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import bounded_batches, checkpoint, text_or_empty

#: Expected number of texts a language is learned from, passes of learning, letters of one word and of one piece at most.
MOST_TEXTS, PASSES, UNIT, LONGEST = 1_000, 3, 32, 8
#: Added to every expected count; least probability of a piece and of a letter outside the vocabulary.
SMOOTH, LEAST = 0.05, 1e-9
UNDECIDED = "und"
#: Words whose scores a worker remembers.
SEEN = 200_000
_START = "▁"
_RUN = re.compile(r"[^\W\d_]+")
_BASE, _MIX, _SLOTS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 20


def units(text: str) -> list[str]:
    """Words of a whole text."""
    runs = _RUN.findall(text.lower())
    if "".join(runs).isalpha() and max(map(len, runs)) <= UNIT:
        return runs
    # Numerals such as a superscript two are no letters.
    return [x[i:i + UNIT] for run in runs for x in "".join(c if c.isalpha() else " " for c in run).split() for i in range(0, len(x), UNIT)]


def read_pieces(model_file: str) -> list[str]:
    """Pieces of up to ``LONGEST`` letters of a SentencePiece model in lower case, with or without the mark of a word's start."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
    return sorted(p for p in found if p.removeprefix(_START).isalpha() and len(p) <= LONGEST) + [_START]


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes of short pieces are small; this spreads them over all 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


class Pieces:
    """Finds the vocabulary's pieces in many words at once, by rolling hashes of their letters."""

    def __init__(self, pieces: Sequence[str]):
        self.pieces = list(pieces)
        self.longest = max(map(len, self.pieces), default=1)
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        assert len(np.unique(hashes)) == len(hashes)
        order = np.argsort(hashes)
        self.hashes, self.ids = np.append(hashes[order], np.uint64(0)), np.append(order, -1).astype(np.int32)
        slot = (hashes[order] >> np.uint64(64 - _SLOTS)).astype(np.int64)
        self.first = np.searchsorted(slot, np.arange((1 << _SLOTS) + 1)).astype(np.int32)

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
        return _mixed(np.array([h], np.uint64))[0]

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.size, -1, np.int32)
        h = h.ravel()
        slot = (h >> np.uint64(64 - _SLOTS)).astype(np.int32)
        at = self.first[slot]
        open_ = np.flatnonzero(at < self.first[slot + 1])
        at, end, h = at[open_], self.first[slot[open_] + 1], h[open_]
        while len(open_):
            hit = self.hashes[at] == h
            out[open_[hit]] = self.ids[at[hit]]
            more = ~hit & (at + 1 < end)
            open_, at, end, h = open_[more], at[more] + 1, end[more], h[more]
        return out

    def grid(self, words: Sequence[str]) -> np.ndarray:
        """Piece numbers ``[word, start, length - 1]`` of words of one length, which start with the mark.
        ``len(pieces)`` stands for none, ``len(pieces) + 1`` for a letter that is no piece."""
        n, v = len(words[0]) + 1, len(self.pieces)
        chars = np.frombuffer("".join(_START + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
        deep = min(self.longest, n)
        out = np.full((len(words), n, deep), v, np.int32)
        h = np.zeros((len(words), n), np.uint64)
        for k in range(deep):
            h = h[:, :n - k] * _BASE + chars[:, k:] + np.uint64(1)
            got = self._lookup(_mixed(h)).reshape(h.shape)
            out[:, :n - k, k] = np.where(got >= 0, got, v + (k == 0))
        return out


def forward(grid: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
    """``[position][word, language]``: the sum over all segmentations of the letters before a position."""
    count, n, deep = grid.shape
    alpha = [np.ones((count, p.shape[1]))]
    for j in range(1, n + 1):
        at = alpha[j - 1] * p[grid[:, j - 1, 0]]
        for k in range(2, min(deep, j) + 1):
            piece = grid[:, j - k, k - 1]
            some = np.flatnonzero(piece < len(p) - 2)
            at[some] += alpha[j - k][some] * p[piece[some]]
        alpha.append(at)
    return alpha


def expected(grid: np.ndarray, p: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected number of uses of every piece by words that occur ``times``; ``p`` has one language."""
    count, n, deep = grid.shape
    alpha = forward(grid, p)
    beta = [np.ones((count, 1)) for _ in range(n + 1)]
    out = np.zeros(len(p))
    for i in range(n - 1, -1, -1):
        to = [p[grid[:, i, k - 1]] * beta[i + k] for k in range(1, min(deep, n - i) + 1)]
        for k, ways in enumerate(to):
            out += np.bincount(grid[:, i, k], (alpha[i] * ways)[:, 0] / alpha[n][:, 0] * times, len(p))
        beta[i] = sum(to)
    return out


def by_length(words: Sequence[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Positions and words of each length."""
    size = np.array([len(w) for w in words])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for part in np.array_split(at, -(-len(at) // 20_000)):
            yield part, [words[i] for i in part]


@functools.lru_cache(maxsize=2)
def _pieces(pieces: tuple[str, ...]) -> Pieces:
    return Pieces(pieces)


@dataclass(frozen=True)
class Model:
    """Piece probabilities per language (two more rows: no piece, unknown letter) and log priors."""

    pieces: tuple[str, ...]
    languages: tuple[str, ...]
    p: np.ndarray
    prior: np.ndarray

    def word_scores(self, words: Sequence[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.languages)))
        for at, same in by_length(words):
            out[at] = np.log(forward(_pieces(self.pieces).grid(same), self.p)[-1])
        return out

    def scorer(self):
        """Function from texts to ``(language, score)`` pairs; scores of a bounded number of words are remembered."""
        known: dict[str, int] = {}
        table = np.empty((0, len(self.languages)))

        def score(texts: Sequence[str]) -> list[tuple[str, float]]:
            nonlocal table
            if len(known) > SEEN:
                known.clear()
                table = table[:0]
            counts = [Counter(units(t)) for t in texts]
            new = list({w for c in counts for w in c if w not in known})
            if new:
                known.update(zip(new, range(len(table), len(table) + len(new))))
                table = np.vstack((table, self.word_scores(new)))
            out = []
            for c in counts:
                if not c or not len(self.languages):
                    out.append((UNDECIDED, 0.0))
                    continue
                at = np.fromiter((known[w] for w in c), np.int64, len(c))
                logs = np.fromiter(c.values(), np.float64, len(c)) @ table[at] + self.prior
                best = int(np.argmax(logs))
                out.append((self.languages[best], float(1 / np.exp(np.maximum(logs - logs[best], -700)).sum())))
            return out
        return score


def held_out(id_col: str | Column) -> Column:
    """CRC-32 of the id as text modulo 3 is 1 (null ids: not held out, and never learned from)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _normalised(counts: np.ndarray) -> np.ndarray:
    """Probabilities from expected counts; the last two rows are no piece and an unknown letter."""
    p = np.zeros((counts.shape[0] + 2, counts.shape[1]))
    smooth = counts + SMOOTH
    p[:-2] = np.maximum(smooth / smooth.sum(axis=0), LEAST)
    p[-1] = LEAST
    return p


def _counted(rows: DataFrame) -> DataFrame:
    """``(lang, word, n)`` over ``(lang, text)``."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for lang, texts in pdf.groupby("lang")["text"]:
                found = Counter()
                for t in texts:
                    found.update(units(t))
                if found:
                    yield pd.DataFrame({"lang": lang, "word": list(found), "n": list(found.values())})
    words = rows.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return words.repartition(rows.sparkSession.sparkContext.defaultParallelism, "word")


def _pass(words: DataFrame, model: Model) -> np.ndarray:
    """Expected piece counts of one pass, ``[piece, language]``."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, total = _pieces(model.pieces), np.zeros((len(model.p), len(model.languages)))
        for pdf in parts:
            for lang, of in pdf.groupby("lang"):
                k = model.languages.index(lang)
                all_words, times = of["word"].tolist(), of["n"].to_numpy(np.float64)
                for at, same in by_length(all_words):
                    total[:, k] += expected(pieces.grid(same), model.p[:, k:k + 1], times[at])
        piece, lang = np.nonzero(total[:-2])
        yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})
    sums = words.mapInPandas(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
    got = sums.toPandas()  # at most pieces times languages
    out = np.zeros((len(model.pieces), len(model.languages)))
    out[got["piece"], got["lang"]] = got["n"]
    return out


def train(docs: DataFrame, pieces: Sequence[str], id_col: str = "doc_id", text: str = "text", lang: str = "lang",
          most_texts: int = MOST_TEXTS, passes: int = PASSES, seed: int = 13) -> Model:
    """Learn from the rows that are not held out.

    Rows without an id, a text or a language teach nothing; repeated rows count each time. The prior of a
    language is its share among all such rows. Without any the model knows no language and answers ``und``.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")) \
        .filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    shares = {r.lang: r.n for r in base.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    names, total = tuple(shares), sum(shares.values())
    prior = np.log(np.array([shares[x] / total for x in names])) if names else np.empty(0)
    model = Model(tuple(pieces), names, _normalised(np.ones((len(pieces), len(names)))), prior)
    if not names:
        return model
    # A text is chosen when its hash falls below the language's rate; where there are fewer texts, all are.
    rates = docs.sparkSession.createDataFrame([(x, int((1 << 40) * min(1.0, most_texts / n))) for x, n in shares.items()], "lang string, rate long")
    chosen = base.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) < F.col("rate"))
    words = checkpoint(_counted(chosen.select("lang", "text")))
    for _ in range(passes):
        model = Model(model.pieces, names, _normalised(_pass(words, model)), prior)
    return model


def with_language(docs: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` plus the likeliest language and its posterior probability.

    A null text or one without letters is ``und`` with score 0, as is every text under a model that knows
    no language. Ties go to the first language by name. Whole texts are scored, of any length; rows are
    independent (equal texts get equal answers) and all other columns pass through. The names
    ``out`` and ``score`` replace columns of ``docs`` that have them.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("lang string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score_all = model.scorer()
        for s in parts:
            yield pd.DataFrame(score_all(s.tolist()), columns=["lang", "score"])

    found = f"__langid_{'_'.join(docs.columns)}"  # no column of docs
    return docs.withColumn(found, predict(text_or_empty(text))).withColumns(
        {out: F.col(f"`{found}`.lang"), score: F.col(f"`{found}`.score")}).drop(found)
