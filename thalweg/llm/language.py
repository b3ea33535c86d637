"""Language identification by unigram piece models marginalised over segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all
ways to cut it into pieces, by the forward algorithm; a text's is the product over its words. Probabilities are fitted by
expectation maximisation on a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_texts, uniform

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bounds of the training sample, for each language: documents (expected), distinct words.
SAMPLE_DOCS, SAMPLE_WORDS = 300, 6_000
LETTERS = re.compile(r"[^\W\d_]+")
#: Longer runs of letters are summed up in logarithms, as their probabilities may leave the range of doubles.
PLAIN_LETTERS = 40
#: Cells (words x letters) that are summed up at once.
CELLS = 1_000_000
SMOOTHING, UNKNOWN, ROUNDS, MEMO_WORDS = 0.05, 1e-5, 4, 200_000
START = "▁"


def read_pieces(path: str) -> list[str]:
    """The spelled pieces of a sentence-piece model, in lower case, distinct; a piece that starts a word begins with ▁."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return sorted({p for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and (p := model.id_to_piece(i).lower())})


def words_of(text: str) -> Counter:
    found = Counter(LETTERS.findall(text.lower()))
    for word in [w for w in found if not w.isalpha()]:  # numerals such as superscripts are among them
        n = found.pop(word)
        for part in "".join(c if c.isalpha() else " " for c in word).split():
            found[part] += n
    return found


def batches(words: list[str]) -> Iterator[tuple[list[int], bool]]:
    """Places of words to be summed up together, and whether in logarithms: of like length, CELLS letters or one word."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    held: list[int] = []
    for k in order:
        n = len(words[k])
        if held and ((n > PLAIN_LETTERS) != (len(words[held[-1]]) > PLAIN_LETTERS) or (len(held) + 1) * (n + 2) > CELLS):
            yield held, len(words[held[-1]]) > PLAIN_LETTERS
            held = []
        held.append(k)
    if held:
        yield held, len(words[held[-1]]) > PLAIN_LETTERS


class Lattice:
    """All pieces within a list of words, as edges (word, from, to, piece) in order of `to`."""

    def __init__(self, automaton, singles: np.ndarray, sizes: np.ndarray, words: list[str]):
        joined = "\n".join(START + w for w in words)
        self.length = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        start = np.concatenate(([0], np.cumsum(self.length + 1)[:-1])).astype(np.int64)
        hits = np.fromiter((end << 32 | value for end, value in automaton.iter(joined)), np.int64)
        end, piece, unknown = hits >> 32, hits & 0xFFFFFFFF, len(sizes)
        size = sizes[piece]
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lone = np.flatnonzero(~np.isin(codes, singles) & (codes != 10))
        end, piece, size = np.concatenate((end, lone)), np.concatenate((piece, np.full(len(lone), unknown))), np.concatenate((size, np.ones(len(lone), np.int64)))
        word = np.searchsorted(start, end, "right") - 1
        to = end - start[word] + 1
        order = np.lexsort((word, to))
        self.word, self.to, self.piece = word[order], to[order], piece[order]
        self.frm = self.to - size[order]

    def _steps(self, key: np.ndarray):
        """Slices of equal key, and within each the starts of equal words."""
        if not len(key):
            return
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield a, b

    def forward(self, p: np.ndarray, logs: bool = False) -> np.ndarray:
        """p: (pieces, languages) -> alpha: (words, positions, languages), summed over all segmentations; both in
        logarithms if `logs`."""
        join, add, one = (np.add, np.logaddexp, 0.0) if logs else (np.multiply, np.add, 1.0)
        alpha = np.full((len(self.length), int(self.length.max(initial=0)) + 1, p.shape[1]), -np.inf if logs else 0.0)
        alpha[:, 0] = one
        for a, b in self._steps(self.to):
            word = self.word[a:b]
            first = np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1))
            alpha[word[first], self.to[a]] = add.reduceat(join(alpha[word, self.frm[a:b]], p[self.piece[a:b]]), first)
        return alpha

    def whole(self, p: np.ndarray, logs: bool = False) -> np.ndarray:
        """(words, languages): the logarithm of each word's probability."""
        with np.errstate(divide="ignore"):
            alpha = self.forward(np.log(p) if logs else p, logs)[np.arange(len(self.length)), self.length]
            return alpha if logs else np.log(np.maximum(alpha, 1e-300))

    def expected(self, p: np.ndarray, times: np.ndarray, logs: bool = False) -> np.ndarray:
        """Expected uses of each piece, for one language: p (pieces, 1)."""
        join, add, one, n = *((np.add, np.logaddexp, 0.0) if logs else (np.multiply, np.add, 1.0)), len(self.length)
        with np.errstate(divide="ignore"):
            p = np.log(p) if logs else p
        alpha = self.forward(p, logs)[..., 0]
        beta = np.full_like(alpha, -np.inf if logs else 0.0)
        beta[np.arange(n), self.length] = one
        order = np.lexsort((self.word, -self.frm))
        word, frm, to, q = self.word[order], self.frm[order], self.to[order], p[self.piece[order], 0]
        for a, b in self._steps(frm):
            w = word[a:b]
            first = np.concatenate(([0], np.flatnonzero(np.diff(w)) + 1))
            beta[w[first], frm[a]] = add.reduceat(join(beta[w, to[a:b]], q[a:b]), first)
        whole = alpha[np.arange(n), self.length]
        if logs:
            uses = np.exp(alpha[word, frm] + q + beta[word, to] - whole[word]) * times[word]
        else:
            uses = alpha[word, frm] * q * beta[word, to] * (times / np.maximum(whole, 1e-300))[word]
        return np.bincount(self.piece[order], uses, len(p))


class LanguageModel:
    """Piece probabilities of each language; picklable, the automaton is built where it is used."""

    def __init__(self, pieces: list[str], counts: dict[str, Counter]):
        self.pieces, self.languages = pieces, sorted(counts)
        self._lattice = None
        p = np.zeros((len(pieces) + 1, len(self.languages)))
        for j, language in enumerate(self.languages):
            vocabulary, times = zip(*counts[language].items()) if counts[language] else ((), ())
            parts = [(self.lattice([vocabulary[k] for k in at]), np.array([times[k] for k in at], float), logs) for at, logs in batches(vocabulary)]
            now = np.full(len(pieces) + 1, 1 / (len(pieces) + 1))
            for _ in range(ROUNDS if len(times) else 0):
                uses = sum(lattice.expected(now[:, None], n, logs) for lattice, n, logs in parts)
                now = (1 - SMOOTHING) * uses / uses.sum() + SMOOTHING / len(now)
            now[-1] = UNKNOWN
            p[:, j] = now
        self.p = p
        self._lattice = None

    def __getstate__(self):
        return self.__dict__ | {"_lattice": None}

    def lattice(self, words: list[str]) -> Lattice:
        if self._lattice is None:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, piece in enumerate(self.pieces):
                automaton.add_word(piece, i)
            automaton.make_automaton()
            self._lattice = automaton, np.array(sorted(ord(x) for x in self.pieces if len(x) == 1), np.uint32), np.array([len(x) for x in self.pieces], np.int64)
        return Lattice(*self._lattice, words)

    def log_words(self, words: list[str]) -> np.ndarray:
        """(words, languages): log probabilities."""
        out = np.zeros((len(words), len(self.languages)))
        for at, logs in batches(words):
            out[at] = self.lattice([words[k] for k in at]).whole(self.p, logs)
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", pieces: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> LanguageModel:
    """Learns from labelled documents whose crc32(doc_id) mod 4 is not 2: about sample_docs of each language, chosen by a
    hash of the id, and the sample_words most frequent words of those (ties: by the word).

    Words are counted by the executors; the driver gets sample_words rows a language. Null ids are not learned from. No
    labelled document: a model of no language.
    """
    label = F.col(lang_col).cast("string")
    known = docs.where(label.isNotNull() & F.col(text_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 4 != 2)).select(label.alias("language"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rates = {r["language"]: sample_docs / r["n"] for r in known.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}
    # as many rows as the model has languages: texts are filtered where they are read
    rate = F.broadcast(known.sparkSession.createDataFrame(sorted(rates.items()), "language string, rate double"))
    chosen = known.withColumn("u", uniform("sample", F.col("id"))).join(rate, "language").where("u < rate")

    def start():
        return lambda texts: ([[{"word": w, "n": n} for w, n in words_of(t).items()] for t in texts],)

    words = map_texts(chosen, "text", {"language": F.col("language")}, {"words": "array<struct<word:string,n:bigint>>"}, start).select("language", F.explode("words").alias("x"))
    counts = words.groupBy("language", F.col("x.word").alias("word")).agg(F.sum("x.n").alias("n"))
    best = counts.withColumn("r", F.row_number().over(W.partitionBy("language").orderBy(F.desc("n"), "word"))).where(F.col("r") <= sample_words)
    found: dict[str, Counter] = {l: Counter() for l in rates}
    for r in best.select("language", "word", "n").collect():
        found[r["language"]][r["word"]] = r["n"]
    return LanguageModel(read_pieces(pieces), {l: Counter(dict(sorted(c.items(), key=lambda x: (-x[1], x[0])))) for l, c in found.items()})


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", *more: Column, named: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, the columns `more` and `named`, lang_pred, score (posterior of lang_pred, 0 to 1).

    Only the text is looked at, whole. Null text, no letter, or no language learned: `und`, score 0. Languages that tie:
    the first by name. Repeated rows come back as they are, ids of any type, null ones too. Empty table: no rows.
    A map over input partitions; the model is broadcast: 8 bytes for each piece of the vocabulary and language, whatever
    the number of documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model, memo = shared.value, {}

        def work(texts):
            found = [words_of(t) for t in texts]
            new = list({w for c in found for w in c if w not in memo}) if model.languages else []
            for i in range(0, len(new), 20_000):
                memo.update(zip(new[i : i + 20_000], model.log_words(new[i : i + 20_000])))
            best, score = [], []
            for c in found:
                if not c or not model.languages:
                    best.append("und"), score.append(0.0)
                    continue
                total = np.fromiter(c.values(), float, len(c)) @ np.array([memo[w] for w in c])
                j = int(total.argmax())
                best.append(model.languages[j]), score.append(float(1 / np.exp(total - total[j]).sum()))
            if len(memo) > MEMO_WORDS:
                memo.clear()
            return best, score

        # texts of a batch are taken by the hundred, so that the words held at once stay few
        return lambda texts: tuple(sum(x, []) for x in zip(*(work(texts[i : i + 256]) for i in range(0, len(texts), 256)), strict=True)) or ([], [])

    return map_texts(docs, text_col, {"doc_id": F.col(id_col), **dict(zip(docs.select(*more).columns, more)), **(named or {})}, {"lang_pred": "string", "score": "double"}, start)
