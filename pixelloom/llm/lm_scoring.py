"""Language-model scoring by deleted interpolation.

    P(w | v) = l2(b) c(v,w)/c(v) + l1(b) c(w)/N + l0(b) / (V + 1),   b: bucket of c(v)

Tokens are lower-cased (A-Z) words and an end token; the first word's context is the
start. Counts come from the training documents. The mixture weights are learned per
context-frequency bucket by expectation-maximisation on deleted counts: every
training token is held out in turn, so it is seen with its own occurrence taken off
all counts. EM reads a histogram over (bucket, p2, p1) at quarter powers of two,
whose size doesn't grow with the corpus; the histogram itself counts every token.

Distribution: ``blocks`` exchanges. A block asks for each of its distinct unigrams
and bigrams and says how often its training documents hold them; the answer is the
corpus count. Scoring is then local to the block. Words are told apart by their bytes
within a block and by 128 bits of a keyed BLAKE2b between blocks, so the counts of
words, N and V are exact; bigrams are told apart by 64 bits of those, which may
add one's count to another's once in 10**19 pairs, in the model's score alone.

Defined results: null text is empty, hence one end token; a null id counts as the
text '' for the split; without training tokens every count is 0; equal rows score
alike and are read each; a text of any length is one document, read whole; other columns,
whatever their names, are not read; an empty table gives none. A null id is held as the
smallest 64-bit number, so a row with that id counts as one without.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import blocks as bl
from pixelloom.llm import textnum as tn

FOLDS, HELD_OUT = 7, 2
BUCKETS = 40
STEPS = 4  # histogram bins to a power of two
NONE_BIN = 255
#: EM stops when no weight moves by more than this, or after so many rounds.
SETTLED, EM_ROUNDS = 1e-6, 1000
END, START = np.uint64(0x5851F42D4C957F2C), np.uint64(0x14057B7EF767814E)
NULL_ID = -(1 << 63)


def is_held_out(ids: np.ndarray) -> np.ndarray:
    names = [b"" if i == NULL_ID else str(i).encode() for i in ids.tolist()]
    return np.array([crc32(s) % FOLDS == HELD_OUT for s in names], bool)


class Tokens:
    """The tokens of a block: ``doc`` and ``word`` (number of the distinct token) of each, end tokens included.

    Words are told apart by their bytes. ``key`` and ``proof`` of a distinct token are 128 bits of a keyed
    BLAKE2b, which stand for it across blocks; keys have their lowest bit clear. ``pair`` is the bigram
    number of each token, ``pair_key`` a 64-bit key of each distinct bigram with its lowest bit set. Distinct
    tokens and bigrams ascend by their keys.
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        n = len(offsets) - 1
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        found = [tn.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in bl.slices(offsets)]
        at = [offsets[a] for a, _ in bl.slices(offsets)]
        first = [a for a, _ in bl.slices(offsets)]
        none = [np.zeros(0, np.int64)]
        starts = np.concatenate([s + o for (s, _, _), o in zip(found, at)] or none)
        ends = np.concatenate([e + o for (_, e, _), o in zip(found, at)] or none)
        owner = np.concatenate([d + a for (_, _, d), a in zip(found, first)] or none)
        number, shown = tn.interned(data, starts, ends)
        names = tn.digests(data, starts[shown], ends[shown])
        key, proof = np.append(names[:, 0] & ~np.uint64(1), END), np.append(names[:, 1], END)
        order = np.lexsort((proof, key))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.key, self.proof = key[order], proof[order]
        doc = np.concatenate([owner, np.arange(n)])
        by_doc = np.argsort(doc, kind="stable")
        self.doc = doc[by_doc]
        self.word = rank[np.concatenate([number, np.full(n, len(shown))])][by_doc]
        self.first = np.ones(len(self.doc), bool)
        self.first[1:] = self.doc[1:] != self.doc[:-1]
        before = np.roll(self.word, 1)
        before[self.first] = len(self.key)
        pairs, self.pair = np.unique(before * (len(self.key) + 1) + self.word, return_inverse=True)
        names = np.append(tn.mix(self.key + self.proof * np.uint64(3)), START)
        before, word = np.divmod(pairs, len(self.key) + 1)
        key = tn.mix(names[before] * np.uint64(5) + names[word]) | np.uint64(1)
        # Bigrams whose keys agree, by chance alone, count as one everywhere.
        self.pair_key, same = np.unique(key, return_inverse=True)
        self.pair = same[self.pair]

    def questions(self):
        """(keys, proofs, place of each distinct token, place of each distinct bigram), ascending."""
        keys = np.concatenate([self.key, self.pair_key])
        proof = np.concatenate([self.proof, np.zeros(len(self.pair_key), np.uint64)])
        order = np.lexsort((proof, keys))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return keys[order], proof[order], place[: len(self.key)], place[len(self.key) :]


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count))."""
    return np.where(count > 0, np.frexp(np.maximum(count, 1).astype(np.float64))[1], 0).clip(0, BUCKETS - 1)


def keys_of(ids: np.ndarray, offsets: np.ndarray, data: np.ndarray):
    t = Tokens(offsets, data)
    keys, proof, words, pairs = t.questions()
    train = (~is_held_out(ids))[t.doc]
    said = np.zeros(len(keys), np.int64)
    said[words] = np.bincount(t.word, train, len(words))
    said[pairs] = np.bincount(t.pair, train, len(pairs))
    return keys, said, proof


def merge(n: int, where: np.ndarray, said: np.ndarray) -> np.ndarray:
    return np.bincount(where, said, n)


def judge(keys: np.ndarray, where: np.ndarray, said: np.ndarray):
    """Answers are corpus counts; figures are V and N over the unigrams of the range."""
    totals = np.bincount(where, said, len(keys)).astype(np.int64)
    single = (keys & np.uint64(1)) == 0
    return totals.astype("<u8"), int((single & (totals > 0)).sum()), int(totals[single].sum())


def counts_of(t: Tokens, answers: np.ndarray, train_docs: int):
    """Corpus counts of each token, bigram and context."""
    keys, _, words, pairs = t.questions()
    assert len(keys) == len(answers), "answers don't match the questions"
    c = answers.astype(np.int64)
    c1, c2 = c[words][t.word], c[pairs][t.pair]
    context = np.roll(c1, 1)
    context[t.first] = train_docs
    return c1, c2, context


def bins(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        b = np.floor(-np.log2(p) * STEPS + 0.5)
    return np.where(p > 0, np.clip(b, 0, NONE_BIN - 1), NONE_BIN).astype(np.int64)


def deleted_histogram(blocks: DataFrame, total: int, train_docs: int) -> DataFrame:
    """(cell, n): training tokens by (bucket, p2, p1) with the token itself taken off the counts."""

    def run(batches):
        for batch in batches:
            for k, (_, ids, offsets, data) in enumerate(bl.opened(batch)):
                t = Tokens(offsets, data)
                d = t.doc
                c1, c2, context = counts_of(t, bl.answers_of(batch, k, "<u8"), train_docs)
                on = (~is_held_out(ids))[d]
                c1, c2, context = c1[on] - 1, c2[on] - 1, context[on] - 1
                p2 = np.where(context > 0, c2 / np.maximum(context, 1), 0.0)
                cell = (bucket_of(context) * 256 + bins(p2)) * 256 + bins(c1 / max(total - 1, 1))
                cells, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], ["cell", "n"])

    return blocks.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def learn_weights(cells: np.ndarray, n: np.ndarray, types: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """EM: mixture weights (bigram, unigram, uniform) of each bucket."""
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    bucket = cells >> 16

    def value(b):
        return np.where(b == NONE_BIN, 0.0, np.exp2(-b / STEPS))

    p = np.stack([value((cells >> 8) & 255), value(cells & 255), np.full(len(cells), 1 / (types + 1))], 1)
    for _ in range(rounds):
        old = weights.copy()
        share = weights[bucket] * p
        share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
        sums = np.stack([np.bincount(bucket, share[:, j], BUCKETS) for j in range(3)], 1)
        seen = sums.sum(1) > 0
        weights[seen] = sums[seen] / sums[seen].sum(1, keepdims=True)
        if np.abs(weights - old).max() < SETTLED:
            break
    # Text that no count explains keeps a finite score.
    weights[:, 2] = np.maximum(weights[:, 2], 1e-6)
    return weights / weights.sum(1, keepdims=True)


def scored(blocks: DataFrame, weights: np.ndarray, types: int, total: int, train_docs: int) -> DataFrame:
    lam = weights.tolist()

    def run(batches):
        w = np.array(lam)
        for batch in batches:
            for k, (_, ids, offsets, data) in enumerate(bl.opened(batch)):
                t = Tokens(offsets, data)
                d = t.doc
                c1, c2, context = counts_of(t, bl.answers_of(batch, k, "<u8"), train_docs)
                mine = w[bucket_of(context)]
                p = mine[:, 2] / (types + 1) + mine[:, 1] * (c1 / max(total, 1))
                p += mine[:, 0] * np.where(context > 0, c2 / np.maximum(context, 1), 0.0)
                base = np.log10((c1 + 1) / (total + types + 1))
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, mask=ids == NULL_ID),
                        pa.array(is_held_out(ids)),
                        pa.array(np.bincount(d, minlength=n).astype(np.int64)),
                        pa.array(np.bincount(d, c1 > 0, n).astype(np.int64)),
                        pa.array(np.full(n, total, np.int64)),
                        pa.array(np.bincount(d, base, n)),
                        pa.array(np.bincount(d, np.log10(p), n)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return blocks.mapInArrow(
        run,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def lm_scores(df: DataFrame, *, key: str = "doc_id", text: str = "text", block_bytes: int = bl.BLOCK_BYTES) -> DataFrame:
    """One row per row of ``df``: its counts, base score and model score."""
    blocks = bl.build(df, key, text, block_bytes)
    # A block of a few megabytes holds fewer than 2**32 tokens; several may hold more.
    answers = bl.exchange(blocks, keys_of, judge, merge, "<u8" if blocks.count() > 1 << bl.FAN_BITS else "<u4", "<u8")
    figures = answers.agg(F.coalesce(F.sum("figure_a"), F.lit(0)), F.coalesce(F.sum("figure_b"), F.lit(0))).first()
    types, total = int(figures[0]), int(figures[1])
    name = F.coalesce(F.col(f"`{key}`").cast("long").cast("string"), F.lit(""))
    train_docs = df.where(F.crc32(name.cast("binary")) % FOLDS != HELD_OUT).count()
    known = bl.with_answers(blocks, answers)
    # At most 40 x 256 x 256 cells, however large the corpus.
    cells = deleted_histogram(known, total, train_docs).toPandas()
    weights = learn_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64), types)
    return scored(known, weights, types, total, train_docs)
