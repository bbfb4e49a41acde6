"""Language identification by segmentation-marginalised unigrams.

Each language has a unigram distribution over the pieces of a fixed public
vocabulary (a SentencePiece model whose path is a parameter).  The likelihood of a
text is the sum over *all* its segmentations into pieces, by a forward algorithm.
Pieces never cross the word mark, so the text's likelihood is the product over its
words, which are scored once per worker and remembered.  A character that is no piece
is spelled in the vocabulary's byte pieces.

The piece probabilities are fitted by expectation-maximisation on a bounded sample of
labelled rows: about ``train_docs`` texts of each of the ``MOST_LANGS`` most frequent declared languages, those with the
smallest hashes; copies of a text are one.  Everything else covers all rows and whole texts.

A document is rejected if another language explains it better than its declared one
by more than ``margin`` nats a word, or if it has no words.  With the default of one, a text half of whose words are of another language
is about as likely to go as to stay, one with 70 % of them goes, and one with 30 % stays.

Defined results.  Null, empty or blank texts have no words: rejected, and their
``pred_lang`` is null.  Words and texts of any length are scored whole.  A document with a null or unknown ``lang`` is kept with its
prediction.  Equal scores go to the alphabetically first language.  Without any
labelled text there is no model: everything with words is kept with a null prediction.
Repeated rows are scored one by one.  doc_id, an integer, may be null or repeated: the sample doesn't depend on it.  Extra columns are kept by ``filter_documents``
under any name and ignored by ``language_report``.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidy

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TRAIN_DOCS = 600
MOST_LANGS = 256
MARGIN = 1.0
EM_ROUNDS = 3
SMOOTHING = 0.1
MARK = "▁"
#: Words of so many letters are handled one by one in log space, as probabilities might underflow; the result is the same.
LONG = 40
BLOCK = 8_000
REMEMBERED = 400_000
#: What stands between words.
GAP = r"[^\p{L}]+"


def pieces(path: str = VOCABULARY) -> dict[str, int]:
    """Normal pieces in lower case -> number; the 256 byte pieces have the numbers after them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    known: dict[str, int] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            known.setdefault(sp.id_to_piece(i).lower(), len(known))
    return known


class Lattice:
    """Finds all pieces at all places of many words at once.

    The words (each with the mark in front) lie in one array of characters.  The hash of
    the ``n`` characters from every place comes from that of ``n - 1``, and is looked
    up among the hashes of the pieces of that length.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, known: dict[str, int]):
        self.known, self.size = known, len(known) + 256
        self.longest = max(map(len, known), default=1)
        self.by_length = []
        for n in range(1, self.longest + 1):
            own = [p for p in known if len(p) == n]
            h = self._fold(np.array([[ord(c) for c in p] for p in own], dtype=np.uint64).reshape(len(own), n))
            order = np.argsort(h)
            self.by_length.append((h[order], np.array([known[own[i]] for i in order], dtype=np.int32)))

    def _fold(self, chars: np.ndarray) -> np.ndarray:
        h = np.zeros(len(chars), np.uint64)
        for j in range(chars.shape[1]):
            h = self._step(h, chars[:, j])
        return h

    def _step(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h + c + np.uint64(1)) * self.BASE
        return h ^ (h >> np.uint64(29))

    def spelling(self, char: str) -> list[int]:
        """The byte pieces of a character that is no piece."""
        return [len(self.known) + b for b in char.encode("utf-8", "surrogatepass")]

    def scan(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[str]]:
        """(starts, lengths, ids, odd): ids[n-1][place] is the piece of n characters there or -1; spelled characters have ids from ``size`` on, numbered in odd."""
        lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        flat = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        left = np.repeat(starts + lengths, lengths) - np.arange(len(flat))  # characters to the end of the word
        ids, h, places = [], np.zeros(len(flat), np.uint64), np.arange(len(flat))
        for n, (hashes, numbers) in enumerate(self.by_length, 1):
            on = left[places] >= n
            places, h = places[on], h[on]
            h = self._step(h, flat[places + n - 1])
            out = np.full(len(flat), -1, np.int32)
            if len(hashes) and len(places):
                k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[k] == h
                out[places[hit]] = numbers[k[hit]]
            ids.append(out)
        gone = np.flatnonzero(ids[0] < 0)
        chars, which = np.unique(flat[gone], return_inverse=True)
        ids[0][gone] = self.size + which
        return starts, lengths, ids, [chr(int(c)) for c in chars]


def _rows(lattice: Lattice, prob: np.ndarray, odd: list[str]) -> np.ndarray:
    """prob with rows for the spelled characters and a last row of zeros, at -1."""
    spelled = [prob[lattice.spelling(c)].prod(0) for c in odd]
    return np.concatenate([prob, *[r[None] for r in spelled], np.zeros((1, prob.shape[1]))])


def forward(lattice: Lattice, scanned, rows: np.ndarray) -> np.ndarray:
    """alpha[place + e]: likelihood of the first e characters of the word that starts at place - its number; one more slot than characters a word."""
    starts, lengths, ids, _ = scanned
    slot = starts + np.arange(len(starts))
    alpha = np.zeros((int(lengths.sum()) + len(starts), rows.shape[1]))
    alpha[slot] = 1.0
    order = np.argsort(-lengths, kind="stable")
    sorted_len = -lengths[order]
    for e in range(1, int(lengths.max(initial=0)) + 1):
        live = order[: np.searchsorted(sorted_len, -e, side="right")]
        acc = np.zeros((len(live), rows.shape[1]))
        for n in range(1, min(e, lattice.longest) + 1):
            k = ids[n - 1][starts[live] + e - n]
            hit = np.flatnonzero(k >= 0)
            if len(hit):
                acc[hit] += alpha[slot[live[hit]] + e - n] * rows[k[hit]]
        alpha[slot[live] + e] = acc
    return alpha


def _log_lattice(lattice: Lattice, word: str, logp: np.ndarray) -> tuple[list[list[tuple[int, int]]], list[str], np.ndarray, list[np.ndarray]]:
    """(arcs (first, piece) by their end, spelled characters, log probabilities with theirs, alpha), all in log space, for words so long that probabilities underflow."""
    _, lengths, ids, odd = lattice.scan([word])
    rows = np.concatenate([logp, *[logp[lattice.spelling(c)].sum(0)[None] for c in odd]])
    arcs: list[list[tuple[int, int]]] = [[]]
    alpha = [np.zeros(logp.shape[1])]
    for e in range(1, int(lengths[0]) + 1):
        arcs.append([(e - n, int(ids[n - 1][e - n])) for n in range(1, min(e, lattice.longest) + 1) if ids[n - 1][e - n] >= 0])
        alpha.append(np.logaddexp.reduce([alpha[at] + rows[k] for at, k in arcs[-1]], axis=0))
    return arcs, odd, rows, alpha


def _log_expected(lattice: Lattice, word: str, weight: np.ndarray, logp: np.ndarray, expected: np.ndarray) -> None:
    """Adds to expected, (pieces, languages), how often each piece is used in all segmentations of one word."""
    arcs, odd, rows, alpha = _log_lattice(lattice, word, logp)
    beta = [np.full(logp.shape[1], -np.inf) for _ in alpha]
    beta[-1] = np.zeros(logp.shape[1])
    for e in range(len(arcs) - 1, 0, -1):
        for at, k in arcs[e]:
            through = rows[k] + beta[e]
            share = weight * np.exp(alpha[at] + through - alpha[-1])
            for piece in [k] if k < lattice.size else lattice.spelling(odd[k - lattice.size]):
                expected[piece] += share
            beta[at] = np.logaddexp(beta[at], through)


def word_scores(words: list[str], lattice: Lattice, logp: np.ndarray, prob: np.ndarray | None = None) -> np.ndarray:
    """Log likelihood of each word under each language, over all its segmentations."""
    out = np.zeros((len(words), logp.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) < LONG]
    if short:
        scanned = lattice.scan([words[i] for i in short])
        alpha = forward(lattice, scanned, _rows(lattice, np.exp(logp) if prob is None else prob, scanned[3]))
        end = alpha[scanned[0] + np.arange(len(short)) + scanned[1]]
        with np.errstate(divide="ignore"):
            out[short] = np.log(end)
    long = np.array([len(w) >= LONG for w in words], dtype=bool)
    for i in np.flatnonzero(long | (out.min(1, initial=0) < -600)):
        out[i] = _log_lattice(lattice, words[i], logp)[-1][-1]
    return out


def fit(counts: dict[str, Counter], lattice: Lattice, rounds: int = EM_ROUNDS, smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray]:
    """EM over all segmentations of the sample's words; languages in alphabetical order.  BLOCK words are in memory at a time."""
    langs, size = sorted(counts), lattice.size
    logp = np.full((size, len(langs)), -np.log(size))
    words, long = [], []
    for w in sorted(set().union(*counts.values())):
        (words if len(w) < LONG else long).append(w)
    weights = lambda block: np.array([[counts[lang][w] for lang in langs] for w in block], dtype=float)
    for _ in range(rounds):
        expected = np.full((size, len(langs)), smoothing)
        prob = np.exp(logp)
        for at in range(0, len(words), BLOCK):
            block = words[at : at + BLOCK]
            expected += _expected(lattice, block, weights(block), prob)
        for w in long:
            _log_expected(lattice, w, weights([w])[0], logp, expected)
        logp = np.log(expected / expected.sum(0))
    return langs, logp


def _expected(lattice: Lattice, words: list[str], weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """(pieces, languages): how often each piece is used in all segmentations of the words, by their likelihood."""
    size, n_langs = lattice.size, prob.shape[1]
    scanned = lattice.scan(words)
    starts, lengths, ids, odd = scanned
    slot = starts + np.arange(len(starts))
    order = np.argsort(-lengths, kind="stable")
    sorted_len = -lengths[order]
    rows = _rows(lattice, prob, odd)
    alpha = forward(lattice, scanned, rows)
    total = alpha[slot + lengths]
    beta = np.zeros_like(alpha)
    beta[slot + lengths] = np.divide(weight, total, out=np.zeros_like(weight), where=total > 0)
    expected = np.zeros((len(rows), n_langs))
    for s in range(int(lengths.max(initial=0)) - 1, -1, -1):
        live = order[: np.searchsorted(sorted_len, -(s + 1), side="right")]
        acc = np.zeros((len(live), n_langs))
        for n in range(1, lattice.longest + 1):
            within = live[lengths[live] >= s + n]  # a prefix of live: it goes by falling length
            k = ids[n - 1][starts[within] + s]
            hit = np.flatnonzero(k >= 0)
            if len(hit):
                share = rows[k[hit]] * beta[slot[within[hit]] + s + n]
                acc[hit] += share
                np.add.at(expected, k[hit], share * alpha[slot[within[hit]] + s])
        beta[slot[live] + s] = acc
    for c, r in zip(odd, expected[size:-1], strict=True):
        for k in lattice.spelling(c):
            expected[k] += r
    return expected[:size]


def sample_counts(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> dict[str, Counter]:
    """Word counts by declared language over the bounded sample.

    The sample is the distinct texts whose hash is below train_docs / rows of the
    language, so it is the same whatever the partitions; rows of null lang are left out.
    """
    labelled = docs.select("lang", "text").filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()}
    if not sizes:
        return {}
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, train_docs / n))) for lang, n in sizes.items()])
    h = F.xxhash64("text")
    unit = (h.bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)).cast("double")
    texts = labelled.filter(unit < share).groupBy("lang", h.alias("h")).agg(F.first("text").alias("text"))
    words = F.explode(F.split(F.lower("text"), GAP)).alias("w")
    rows = texts.select("lang", words).filter("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("n"))
    out: dict[str, Counter] = {lang: Counter() for lang in sizes}
    for lang, w, n in rows.toLocalIterator():  # a partition at a time: the sample is bounded, and so is what the driver holds
        out[lang][w] = int(n)
    return {k: v for k, v in out.items() if v}


def train(docs: DataFrame, vocabulary: str = VOCABULARY, train_docs: int = TRAIN_DOCS) -> dict | None:
    counts = sample_counts(docs, train_docs)
    if not counts:
        return None
    known = pieces(vocabulary)
    langs, logp = fit(counts, Lattice(known))
    return {"langs": langs, "logp": logp, "pieces": list(known)}


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(first token of each text, distinct tokens, the number of each token among them); there is a token a text at least, which may be empty."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), GAP)
    tokens = lists.flatten().dictionary_encode()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(sizes) - sizes, tokens.dictionary.to_pylist(), tokens.indices.to_numpy(zero_copy_only=False)


class Scorer:
    def __init__(self, model: dict):
        known = {p: i for i, p in enumerate(model["pieces"])}
        self.lattice, self.logp = Lattice(known), model["logp"]
        self.prob = np.exp(self.logp)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {"": 0}
        self.table = np.zeros((1, self.logp.shape[1]))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words, log likelihoods by language) of each text."""
        if len(self.memo) > REMEMBERED:
            self.forget()
        n, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), self.logp.shape[1]))
        if not len(texts):
            return n, total
        first, words, number = split_words(texts)
        memo = self.memo
        fresh = [w for w in words if w not in memo]
        if fresh:
            for i, w in enumerate(fresh, len(self.table)):
                memo[w] = i
            self.table = np.concatenate([self.table, word_scores(fresh, self.lattice, self.logp, self.prob)])
        row = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))[number]
        n = np.add.reduceat(row > 0, first, dtype=np.int64)
        for j in range(total.shape[1]):
            total[:, j] = np.add.reduceat(self.table[row, j], first)
        return n, total


def _verdict(model: dict | None, scorer, texts: pa.Array, declared: list, margin: float) -> pd.DataFrame:
    if model is None:
        n = np.zeros(0, np.int64)
        if len(texts):
            first, words, number = split_words(texts)
            n = np.add.reduceat(np.array([w != "" for w in words])[number], first, dtype=np.int64)
        return pd.DataFrame({"n_words": n, "pred_lang": [None] * len(texts), "nats_per_word": np.nan, "gap": 0.0, "keep": n > 0})
    n, total = scorer.score(texts)
    langs = model["langs"]
    per = total / np.maximum(n, 1)[:, None]
    best = per.argmax(1)
    at = {lang: i for i, lang in enumerate(langs)}
    own = np.array([at.get(x, -1) for x in declared])
    rows = np.arange(len(texts))
    gap = np.where(own >= 0, per[rows, best] - per[rows, own], 0.0)
    pred = [langs[b] if k else None for b, k in zip(best, n, strict=True)]
    return pd.DataFrame({"n_words": n, "pred_lang": pred, "nats_per_word": np.where(n > 0, -per[rows, best], np.nan), "gap": gap, "keep": (n > 0) & (gap <= margin)})


def language_report(docs: DataFrame, vocabulary: str = VOCABULARY, train_docs: int = TRAIN_DOCS, margin: float = MARGIN) -> DataFrame:
    """The documents kept: doc_id, lang, pred_lang, n_words, nats_per_word (of the best language), gap to the declared one."""
    model = train(docs, vocabulary, train_docs)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the vocabulary and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        scorer = Scorer(m) if m else None
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                v = _verdict(m, scorer, c.column(2), c.column(1).to_pylist(), margin)
                k = np.flatnonzero(v["keep"].to_numpy())
                v = v.iloc[k]
                yield pa.RecordBatch.from_arrays(
                    [c.column(0).take(pa.array(k)), c.column(1).take(pa.array(k)), pa.array(v["pred_lang"].tolist(), pa.string()), pa.array(v["n_words"].to_numpy()), pa.array(v["nats_per_word"].to_numpy()), pa.array(v["gap"].to_numpy())],
                    names=["doc_id", "lang", "pred_lang", "n_words", "nats_per_word", "gap"],
                )
        del m, scorer
        tidy()

    schema = "doc_id long, lang string, pred_lang string, n_words long, nats_per_word double, gap double"
    return docs.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(run, schema)


def filter_documents(docs: DataFrame, vocabulary: str = VOCABULARY, train_docs: int = TRAIN_DOCS, margin: float = MARGIN) -> DataFrame:
    """The documents kept, with all their columns."""
    model = train(docs, vocabulary, train_docs)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def keep(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m = shipped.value
        scorer = Scorer(m) if m else None
        for text, lang in batches:
            parts = [_verdict(m, scorer, text.slice(at, 256), lang.slice(at, 256).to_pylist(), margin)["keep"].to_numpy() for at in range(0, len(text), 256)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))
        del m, scorer
        tidy()

    return docs.filter(keep(F.col("text"), F.col("lang")))


def op3_language_id(spark, sf_dir):
    return language_report(table(spark, sf_dir, "documents"))
