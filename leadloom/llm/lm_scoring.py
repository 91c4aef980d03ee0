"""Scoring documents by an n-gram language model kept as Elias-Fano tries.

The model is an interpolated trigram model of the training documents' words (A-Z in lower
case) and of the end of each document. With c for counts, a context of count c leaves
``left(c)`` of its probability to the shorter context:

    p(w | u v) = (1 - left3(c(u v))) c(u v w) / c(u v) + left3(c(u v)) p(w | v)
    p(w | v)   = (1 - left2(c(v))) c(v w) / c(v) + left2(c(v)) p(w)
    p(w)       = (c(w) + 0.5) / (N + 0.5 (V + 1))

with left(c) = a c^-b, all of it where the context is unknown; the probabilities of a context
sum to one. The parameters `LEFT2` and `LEFT3` were chosen on held-out documents.

1. One pass looks for hot contexts, which a task's documents have in 1 of 2 * `most_hot` tokens or
   more: those that come to that share of all tokens are at most 2 * `most_hot`, and every context
   with twice the share is among them.
2. Documents are dealt to homes. A home sends each shard the distinct trigrams and words it
   met, as compressed columns with their counts in training documents. A context belongs to
   one shard; a hot one is spread over all shards by its next word, and counted like a word.
3. A shard adds the homes' counts, computes smoothed probabilities, builds its trie
   (`elias_fano.NgramTrie`) and sends every home the codes for what it asked, with the tokens and
   distinct words of the shard, which sum to N and V. A bigram's count is that of the context
   it makes for the token after it.
4. The homes put the codes together and sum the logarithms by document.

No task holds more than a home, a shard or one text; homes and shards grow with the root of the
input between `LEAST_BYTES` and `MOST_BYTES`, so that the cells they exchange do not shrink. The
model is never whole in one place. Contexts are told apart by the shard and 36 bits of a
hash, words behind them by 28 bits: where a shard has a million contexts, an unknown one is
taken for one of them in 15 of a million cases, words by 56 bits; behind a context of a thousand words, an unknown
word in 4 of a million. Quantised logarithms are off by at most 0.002 a token, in either direction.

Defined cases: a null text is empty and scores as its end alone; a row without an id is scored
but not learned from, and not held out; rows repeated with their id and text are learned from and
scored each; without training documents all counts are 0; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import forget, small_batches, table, written
from leadloom.llm.elias_fano import WORD_BITS, NgramTrie, dequantise, quantise
from leadloom.llm.substring_dedup import squeeze, unsqueeze

#: left(c) = a c^-b of contexts of one and of two words.
LEFT2, LEFT3 = (0.9, 0.1), (0.7, 0.1)
FOLDS, HELD_OUT = 5, 1
LEAST_BYTES, MOST_BYTES, LEAST_SHARDS, MOST_SHARDS = 4 << 20, 64 << 20, 128, 1 << 22
#: Bytes of text that a home should have for each shard; shares of the tokens that make a context hot.
CELL_BYTES, MOST_HOT = 512, 65536
START, END, PAD = b" ", b"", b"  "  # no word is like these
CONTEXT_BITS, HASH_BITS = 36, 56
WORDS, HOT_CONTEXTS, TRIGRAMS = 1, 2, 3


def is_training(doc_id: int | None, folds: int = FOLDS, held_out: int = HELD_OUT) -> bool:
    return doc_id is not None and zlib.crc32(b"%d" % doc_id) % folds != held_out


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (y + np.uint64(0xD6E8FEB86659FD93))
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xFF51AFD7ED558CCD)
    return z ^ (z >> np.uint64(29))


def hash_of(word: bytes) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(word))


class Tokens:
    """The tokens of some documents one after another, each between two starts and a pad, as
    hashes; ``at`` leads to the words, ends and pads, ``of`` to the document of a token."""

    def __init__(self, texts: list[bytes | None]):
        flat: list[bytes] = []
        lengths = []
        for text in texts:
            before = len(flat)
            flat += (START, START)
            flat += (text or b"").lower().split()  # both take ASCII alone
            flat += (END, PAD)
            lengths.append(len(flat) - before)
        coded = pa.array(flat, pa.binary()).dictionary_encode()
        self.codes = coded.indices.to_numpy()
        self.distinct = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        self.all = self.distinct[self.codes] if flat else np.empty(0, np.uint64)
        self.of = np.repeat(np.arange(len(texts)), lengths)
        self.at = np.nonzero(self.of[:-2] == self.of[2:])[0] + 2
        self.real = self.all[self.at] != hash_of(PAD)

    def contexts(self, which=slice(None)) -> np.ndarray:
        at = self.at[which]
        return mixed(self.all[at - 2], self.all[at - 1])


def _column(batch, k):
    return batch.column(k).to_pylist()


def _parts(shard: np.ndarray, *columns: np.ndarray):
    """Runs of equal shards."""
    if len(shard):
        cuts = [0, *(np.nonzero(shard[1:] != shard[:-1])[0] + 1).tolist(), len(shard)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(shard[a]), [c[a:b] for c in columns]


def _gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0)).astype("<u8")


def _hot_candidates(most: int):
    """(context, n) of the contexts that are hot in a batch of training documents, and its tokens."""

    def run(batches):
        for batch in batches:
            tokens = Tokens([t for i, t in zip(_column(batch, 0), _column(batch, 1), strict=True) if is_training(i)])
            least = max(1.0, len(tokens.at) / (2 * most))
            often = (np.bincount(tokens.codes, minlength=1) >= least)[tokens.codes] if len(tokens.codes) else np.empty(0, bool)
            both = often[tokens.at - 2] & often[tokens.at - 1]
            found, n = np.unique(tokens.contexts(both), return_counts=True)
            found, n = found[n >= least].view(np.int64).tolist(), n[n >= least].tolist()
            columns = [[None, *found], [0, *n], [len(tokens.at)] + [0] * len(n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["context", "n", "tokens"])

    return run


def hot_contexts(rows: DataFrame, most: int) -> np.ndarray:
    """The hot contexts of all rows, ascending; see step 1 of the module."""
    found = written(rows.mapInArrow(_hot_candidates(most), "context long, n long, tokens long"), "lm-hot")
    total = found.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    sums = found.where("context is not null").groupBy("context").agg(F.sum("n").alias("n"))
    hot = [r.context for r in sums.where(F.col("n") >= max(1, total // (2 * most))).collect()]  # at most 2 * most
    forget(found)
    return np.sort(np.array(hot, np.int64).view(np.uint64))


class Layout:
    """How trigrams and words are dealt to shards; the same in homes and shards."""

    def __init__(self, shards: int, hot: np.ndarray):
        self.shards, self.hot = shards, hot
        self.bits = np.uint64(shards.bit_length() - 1)

    def is_hot(self, contexts: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(contexts), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, contexts), len(self.hot) - 1)] == contexts

    def trigrams(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Of each word, end and pad: shard and context in one number, and some bits of the word."""
        contexts, words = tokens.contexts(), tokens.all[tokens.at]
        spread = np.where(self.is_hot(contexts), mixed(contexts, words), contexts)
        shard = (spread >> np.uint64(40)) & np.uint64(self.shards - 1)
        low = contexts & np.uint64((1 << CONTEXT_BITS) - 1)
        return (shard << np.uint64(CONTEXT_BITS)) | low, (words >> np.uint64(64 - WORD_BITS)).astype(np.uint32)

    def word_shard(self, words: np.ndarray) -> np.ndarray:
        return words >> (np.uint64(64) - self.bits)


def in_order(where: np.ndarray, words: np.ndarray, used: int) -> np.ndarray:
    """The order by both; ``where`` has that many bits."""
    key = (where << np.uint64(64 - used)) | (words.astype(np.uint64) >> np.uint64(max(0, WORD_BITS - (64 - used))))
    order = np.argsort(key)
    a, b = key[order], words[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # words that agree in the bits of the key
        run = np.concatenate([[0], np.cumsum(~same)])
        mixed_up = np.zeros(run[-1] + 1, bool)
        mixed_up[run[1:][same & (b[1:] != b[:-1])]] = True
        rows = mixed_up[run]
        part = order[rows]
        order[rows] = part[np.lexsort((words[part], key[part]))]
    return order


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


class Asked:
    """What a home asks: its distinct trigrams in the order of shard, context and word, the
    contexts among them, and its distinct words; the ``back`` lead from the tokens to them."""

    def __init__(self, tokens: Tokens, layout: Layout):
        where, words = layout.trigrams(tokens)
        self.order = in_order(where, words, CONTEXT_BITS + layout.shards.bit_length() - 1)
        a, b = where[self.order], words[self.order]
        new = changes(a, b)
        self.begin, self.where, self.next = np.nonzero(new)[0], a[new], b[new]
        self.back = np.empty(len(a), np.int64)
        self.back[self.order] = np.cumsum(new) - 1
        self.new_context = changes(self.where)
        self.context_back = (np.cumsum(self.new_context) - 1)[self.back]
        self.words, back = np.unique(tokens.distinct, return_inverse=True)
        self.word_back = back[tokens.codes] if len(tokens.codes) else np.empty(0, np.int64)

    def counts(self, tokens: Tokens, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        learned = training[tokens.of]
        trigrams = np.add.reduceat(learned[tokens.at][self.order].astype(np.uint32), self.begin) if len(self.begin) else np.empty(0, np.uint32)
        real = tokens.at[tokens.real]
        words = np.bincount(self.word_back[real], learned[real], len(self.words))
        return trigrams, words.astype(np.uint32)


def _packed(batches):
    """Texts compressed for their way to the homes."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [None if t is None else press.compress(t) for t in _column(batch, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), batch.column(2)], batch.schema.names)


def _documents(rows: pa.Table) -> tuple[list, list, np.ndarray]:
    expand = zstandard.ZstdDecompressor()
    ids, texts = rows["doc_id"].to_pylist(), [None if t is None else expand.decompress(t) for t in rows["content"].to_pylist()]
    return ids, texts, np.array([is_training(i) for i in ids], bool)


#: contexts holds one value for each context of a cell, data one for each trigram (or word).
CELLS = "kind int, shard long, home long, contexts binary, data binary"
CELL_NAMES = [c.split()[0] for c in CELLS.split(", ")]


def _ask(layout: Layout):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        _, texts, training = _documents(rows)
        tokens = Tokens(texts)
        asked = Asked(tokens, layout)
        trigrams, words = asked.counts(tokens, training)
        low, out = np.uint64((1 << CONTEXT_BITS) - 1), []
        for shard, (where, after, n, new) in _parts(asked.where >> np.uint64(CONTEXT_BITS), asked.where, asked.next, trigrams, asked.new_context):
            out.append((TRIGRAMS, shard, squeeze(_gaps(where[new] & low)), squeeze(after.astype("<u4"), n.astype("<u4"), new)))
        contexts = tokens.contexts()
        hot, back = np.unique(contexts[layout.is_hot(contexts)], return_inverse=True)
        n_hot = np.bincount(back, training[tokens.of[tokens.at]][layout.is_hot(contexts)], len(hot)).astype(np.uint32)
        for kind, hashes, counts in ((WORDS, asked.words, words), (HOT_CONTEXTS, hot, n_hot)):
            cells = dict(_parts(layout.word_shard(hashes), hashes >> np.uint64(64 - HASH_BITS), counts))
            for shard in range(layout.shards) if kind == WORDS else cells:  # each shard has words to tell of
                of_shard, n = cells.get(shard, (np.empty(0, np.uint64), np.empty(0, np.uint32)))
                out.append((kind, shard, b"", squeeze(_gaps(of_shard), n.astype("<u4"))))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        kind, shard, contexts, data = (pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 4, kinds, strict=True))
        return pa.table([kind, shard, pa.array([key[0].as_py()] * len(out), pa.int64()), contexts, data], CELL_NAMES)

    return run


def left(count: np.ndarray, a: float, b: float) -> np.ndarray:
    """What a context of that count leaves to the shorter one; all of it if it is unknown."""
    return np.where(count > 0, a * np.maximum(count, 1.0) ** -b, 1.0)


def shard_trie(where: np.ndarray, words: np.ndarray, n: np.ndarray) -> bytes:
    """The trie of distinct, ascending (context, word) with counts over 0. The count of a hot context
    is that of the shard's words alone, and its probabilities are in terms of it; the homes know both."""
    new = changes(where)
    begins = np.append(np.nonzero(new)[0], len(where))
    contexts = where[new]
    totals = np.add.reduceat(n, begins[:-1]).astype(np.float64) if len(n) else np.empty(0)
    per = np.repeat(totals, np.diff(begins))
    return NgramTrie.build(contexts, quantise(totals), begins, words, quantise((1 - left(per, *LEFT3)) * n / per), CONTEXT_BITS)


def _answer():
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() != TRIGRAMS:
            parts = [unsqueeze(x.as_py(), "<u8", "<u4") for x in rows["data"]]
            hashes, counts = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
            _, back = np.unique(hashes, return_inverse=True)
            total = np.bincount(back, counts).astype("<u8")
            told = np.array([total.sum(), np.count_nonzero(total)], "<i8").tobytes()
            contexts, data = [told] * len(parts), [squeeze(x) for x in np.split(total[back], np.cumsum([len(p[0]) for p in parts])[:-1])]
        else:
            parts = [(*unsqueeze(c.as_py(), "<u8"), *unsqueeze(d.as_py(), "<u4", "<u4", "?")) for c, d in zip(rows["contexts"], rows["data"], strict=True)]
            where = np.concatenate([np.cumsum(p[0])[np.cumsum(p[3]) - 1] for p in parts])
            words, n, first = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
            order = in_order(where, words, CONTEXT_BITS)
            a, b = where[order], words[order]
            new = changes(a, b)
            total = np.add.reduceat(n[order].astype(np.int64), np.nonzero(new)[0])
            a, b, back = a[new], b[new], np.empty(len(order), np.int64)
            back[order] = np.cumsum(new) - 1
            learned = total > 0
            trie = NgramTrie(shard_trie(a[learned], b[learned], total[learned]))
            counts, odds = trie.query(a, b)
            ends = np.cumsum([len(p[1]) for p in parts])[:-1]
            contexts = [squeeze(x[f]) for x, f in zip(np.split(counts[back].astype("<u2"), ends), np.split(first, ends), strict=True)]
            data = [squeeze(x) for x in np.split(odds[back].astype("<u2"), ends)]
        return pa.table([rows["kind"], rows["shard"], rows["home"], pa.array(contexts, pa.binary()), pa.array(data, pa.binary())], CELL_NAMES)

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(layout: Layout):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts, _ = _documents(rows)
        tokens = Tokens(texts)
        asked = Asked(tokens, layout)
        came = sorted(zip(*(answers[c].to_pylist() for c in ("kind", "shard", "contexts", "data")), strict=True))
        totals = lambda kind: np.concatenate([np.empty(0, np.uint64), *(unsqueeze(d, "<u8")[0] for k, _, _, d in came if k == kind)])
        n_all, v_all = np.sum([np.frombuffer(c, "<i8") for k, _, c, _ in came if k == WORDS], axis=0).tolist()
        codes = lambda at: np.concatenate([np.empty(0, np.uint16), *(unsqueeze(x[at], "<u2")[0] for x in came if x[0] == TRIGRAMS)])
        pairs, own, counts = dequantise(codes(2))[asked.context_back], dequantise(codes(3))[asked.back], totals(WORDS)
        contexts = tokens.contexts()
        hot = layout.is_hot(contexts)
        if hot.any():  # from the share of a shard to the whole context
            part, whole = pairs[hot], totals(HOT_CONTEXTS)[np.unique(contexts[hot], return_inverse=True)[1]].astype(np.float64)
            in_part = own[hot] * part / np.where(part > 0, 1 - left(part, *LEFT3), 1)
            own[hot], pairs[hot] = (1 - left(whole, *LEFT3)) * in_part / np.maximum(whole, 1), whole
        count = counts.astype(np.float64)[asked.word_back] if len(tokens.all) else np.empty(0)
        t = np.nonzero(tokens.real)[0]  # the entry after a real token's is that of its own bigram
        at, of = tokens.at[t], tokens.of[tokens.at[t]]
        ends = np.searchsorted(asked.words, hash_of(END))
        before = np.where(tokens.all[at - 1] == hash_of(START), count_at(counts, ends), count[at - 1])
        unigram = (count[at] + 0.5) / (n_all + 0.5 * (v_all + 1))
        rest2, rest3 = left(before, *LEFT2), left(pairs[t], *LEFT3)
        bigram = (1 - rest2) * pairs[t + 1] / np.maximum(before, 1) + rest2 * unigram
        trigram = own[t] + rest3 * bigram
        total = lambda x: np.bincount(of, x, len(ids))
        columns = [
            rows["doc_id"], pa.array([i is not None and not is_training(i) for i in ids], pa.bool_()), pa.array(total(None).astype(np.int64)), pa.array(total(count[at] > 0).astype(np.int64)),
            pa.array([n_all] * len(ids), pa.int64()), pa.array(total(np.log10(unigram))), pa.array(total(np.log10(trigram))),
        ]
        return pa.table(columns, [c.split()[0] for c in RESULT.split(", ")])

    return run


def count_at(counts: np.ndarray, place: int) -> float:
    return float(counts[place]) if place < len(counts) else 0.0


def shares(size: int) -> tuple[int, int]:
    """Homes and shards for that many bytes: as many as their bytes allow, with cells that do not shrink."""
    each = min(MOST_BYTES, max(LEAST_BYTES, int((CELL_BYTES * size) ** 0.5)))
    shards = 1 << max(LEAST_SHARDS - 1, min(MOST_SHARDS - 1, size // each)).bit_length()
    return max(LEAST_SHARDS, size // each), shards


def score(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", most_hot: int = MOST_HOT) -> DataFrame:
    """One row per document; see the module and `RESULT`."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("content"))
    homes, shards = shares(rows.agg(F.sum(F.octet_length("content"))).first()[0] or 0)
    layout = Layout(shards, hot_contexts(rows, min(shards, most_hot)))
    dealt = rows.withColumn("home", F.pmod(F.xxhash64("doc_id", "content"), F.lit(homes).cast("long")))
    placed = dealt.mapInArrow(_packed, "doc_id long, content binary, home long").repartition("home")
    cells = placed.groupBy("home").applyInArrow(_ask(layout), CELLS)
    answers = cells.groupBy("kind", "shard").applyInArrow(_answer(), CELLS)
    return placed.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(_score(layout), RESULT)


def op13_lm_scoring(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
