"""Language identification by cross-parsing against labelled text.

For each language a suffix automaton of a sample of its labelled text gives the
longest match from any place of a text, so the text is parsed greedily into the
fewest phrases that occur in the sample (a character never seen is a phrase of
its own). Phrases per character estimate the cross entropy; the language with
the fewest wins. Phrases run over the whole text, across its words.

Texts are lower-cased and everything but letters becomes one blank. An automaton
whose states times its alphabet stay within ``TABLE_CELLS`` is laid out as a
table, and many texts are parsed at once, a character of each at a time. For that
long texts are cut into stretches; where one begins in the midst of a phrase, it is
parsed again until both parses are in one state, so the counts are those of the
whole text. Larger automata parse text by text.

The sample is bounded: some ``DOCS`` documents a language, each with a stretch of
at most ``DOC_CHARS`` at a place its hash picks, cut to ``CHARS`` a language and
``ALL_CHARS`` together (with many languages fewer documents and characters each). The
``LABELS`` labels with the most rows are learned (ties: first in code point order), so
dirty labels cannot fill the driver or the workers: a rarer one is never predicted.
Letters are numbered once for all languages, and a worker's tables grow with the letters
of the samples alone.

Defined cases: a null text, or one without letters, is ``und`` with score 0;
without labelled rows every text is ``und``; equal counts go to the language
first in code point order; rows without text or label teach nothing; repeated
rows are judged alike; an empty table gives no rows; names of further columns
do not matter.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import SMALL_BATCH, fresh, resident, small_batches, table

DOCS, DOC_CHARS, CHARS, ALL_CHARS = 64, 1000, 24_000, 240_000
#: Labels learned at most, and documents wanted of each at least (with 8 by chance, one language in 3,000 gets none).
LABELS, FEWEST = 500, 8
TABLE_CELLS = 16 << 20
#: Characters of text in a slice of a batch, and in a stretch.
SLICE_CHARS, STRETCH = 3 << 20, 4096


class SuffixAutomaton:
    """All substrings of a text; a state is the transitions from it."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for char in text:
            state = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and char not in self.next[at]:
                self.next[at][char] = state
                at = link[at]
            if at >= 0:
                to = self.next[at][char]
                if length[at] + 1 == length[to]:
                    link[state] = to
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    while at >= 0 and self.next[at].get(char) == to:
                        self.next[at][char] = copy
                        at = link[at]
                    link[to] = link[state] = copy
            last = state

    def step(self, state: int, char: str) -> tuple[int, int]:
        """The state behind a character, and how many phrases end before or with it."""
        if (to := self.next[state].get(char)) is not None:
            return to, 0
        to = self.next[0].get(char)
        return to or 0, (state != 0) + (to is None)

    def phrases(self, text: str) -> int:
        """Phrases of the greedy parse by longest matches."""
        states, root = self.next, self.next[0]
        at, count = root, 0
        for char in text:
            if (to := at.get(char)) is None:
                count += at is not root  # a phrase ends before this character
                if (to := root.get(char)) is None:
                    count += 1
                    at = root
                    continue
            at = states[to]
        return count + (at is not root)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> that of its lower case, or of a blank if it is no letter."""
    found = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        char = chr(c)
        if char.isalpha():
            found[c] = ord(char.lower()[0])
    return found


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Normal texts as code points in a row, and the length of each: letters in lower case,
    one blank between runs of them and at either end; texts without letters are empty."""
    joined = "\n".join(["", *(t or "" for t in texts), ""])  # a blank before, between and behind
    found = _letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    cuts = np.cumsum([0] + [len(t or "") + 1 for t in texts])
    blank = found == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]  # the first blank behind a run
    sizes = np.add.reduceat(keep[1:], cuts[:-1]) if len(texts) else np.empty(0, np.int64)
    kept = found[1:][keep[1:]]
    out = np.full(len(kept) + int((sizes > 0).sum()), 32, np.uint32)
    shift = np.cumsum(sizes > 0)  # one more blank before each text with letters
    out[np.arange(len(kept)) + np.repeat(shift, sizes)] = kept
    return out, sizes + (sizes > 0)


def normal(text: str) -> str:
    points, _ = code_points([text])
    return points.tobytes().decode("utf-32-le")


class Parser:
    """The automata of all languages, those with small alphabets laid out as one table."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.names = [lang for lang, _ in samples]
        self.automata = [SuffixAutomaton(text) for _, text in samples]
        alphabets = [sorted(set(text)) for _, text in samples]
        cells = [len(x.next) * (len(y) + 1) for x, y in zip(self.automata, alphabets, strict=True)]
        self.tabled = [k for k, n in enumerate(cells) if n <= TABLE_CELLS and len(alphabets[k]) < 1 << 16]
        self.others = [k for k in range(len(cells)) if k not in self.tabled]
        # a state is the place of its row in the table of its language, which holds such places
        self.root = np.cumsum([0] + [cells[k] for k in self.tabled])[:-1].astype(np.int64)
        self.table = np.full(sum(cells[k] for k in self.tabled), -1, np.int32)
        self.width = np.array([len(alphabets[k]) + 1 for k in self.tabled], np.int64)
        code = np.uint8 if len(self.width) and self.width.max() <= 256 else np.uint16
        # code point -> row of `code`, which holds the letter's column in each language's table
        seen = sorted(set().union(*(alphabets[k] for k in self.tabled)))
        self.row = np.full(0x110000, len(seen), np.int32)
        self.row[[ord(c) for c in seen]] = np.arange(len(seen))
        self.code = np.empty((len(seen) + 1, len(self.tabled)), code)
        for i, k in enumerate(self.tabled):
            letters = {c: j for j, c in enumerate(alphabets[k])}
            self.code[:, i] = len(letters)  # letters never seen share the last column, which leads nowhere
            self.code[self.row[[ord(c) for c in letters]], i] = np.arange(len(letters))
            base, width = int(self.root[i]), int(self.width[i])
            for state, edges in enumerate(self.automata[k].next):
                for c, to in edges.items():
                    self.table[base + state * width + letters[c]] = base + to * width

    def counts(self, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each text (column) for each language (row)."""
        found = np.zeros((len(self.names), len(sizes)), np.int64)
        begins, order = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
        text = lambda i, at: points[begins[i] + at : begins[i] + sizes[i]].tobytes().decode("utf-32-le")
        for k in self.others:
            found[k] = [self.automata[k].phrases(text(i, 0)) for i in range(len(sizes))]
        if not self.tabled or not len(sizes):
            return found
        # texts are cut into stretches, all parsed from the start of a phrase
        pieces = np.maximum(1, -(-sizes // STRETCH))
        of = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(STRETCH, sizes[of] - nth * STRETCH)
        count, state = self._together(points, begins[of] + nth * STRETCH, length)
        for row, k in enumerate(self.tabled):
            total, at = np.zeros(len(sizes), np.int64), state[:, row].copy()
            np.add.at(total, of, count[:, row])
            for j in np.nonzero(nth > 0)[0].tolist():  # where a phrase ran on from the stretch before
                mine, theirs, begin = int(at[j - 1]), 0, begins[of[j]] + nth[j] * STRETCH
                if mine:
                    for char in points[begin : begin + length[j]].tolist():
                        mine, more = self.automata[k].step(mine, chr(char))
                        theirs, fewer = self.automata[k].step(theirs, chr(char))
                        total[of[j]] += more - fewer
                        if mine == theirs:  # from here on both go the same way
                            break
                    else:
                        at[j] = mine
            found[k] = total + (at[np.cumsum(pieces) - 1] != 0)
        return found

    def _together(self, points: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases ended, and the state reached, of each stretch (row) for each tabled language."""
        n, width = len(sizes), len(self.tabled)
        order = np.argsort(-sizes, kind="stable")
        running = np.searchsorted(-sizes[order], -np.arange(int(sizes.max())), "left")  # stretches longer than t
        columns = self.code.take(self.row.take(points), axis=0)
        root = np.tile(self.root.astype(np.int32), n)
        now, count, first = root.copy(), np.zeros(n * width, np.int32), begins[order]
        for t, lanes in enumerate(running.tolist()):
            m = lanes * width
            column = columns.take(first[:lanes] + t, axis=0).reshape(-1)
            to = self.table.take(now[:m] + column)
            dead = np.flatnonzero(to < 0)  # phrases that end before this character
            start = root.take(dead)
            again = self.table.take(start + column.take(dead))
            unseen = again < 0
            count[dead] += (now.take(dead) != start).view(np.int8) + unseen.view(np.int8)
            to[dead] = np.where(unseen, start, again)
            now[:m] = to
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        state = (now - root).reshape(n, width)[back] // self.width
        return count.reshape(n, width)[back], state

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each, and how much fewer phrases it needs than the next: 0 (as many) to 1."""
        names, scores, part, held = [], [], [], 0
        for text in [*texts, ...]:
            if part and (text is ... or held >= SLICE_CHARS):
                found = self._predict(part)
                names += found[0]
                scores += found[1]
                part, held = [], 0
            if text is not ...:
                part.append(text)
                held += len(text or "")
        return names, scores

    def _predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        points, sizes = code_points(texts)
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        counts = self.counts(points, sizes)
        best, fewest = counts.argmin(axis=0), counts.min(axis=0)
        second = np.partition(counts, 1, axis=0)[1] if len(counts) > 1 else sizes
        score = np.where(sizes > 0, 1.0 - fewest / np.maximum(second, 1), 0.0)
        return [self.names[b] if n else "und" for b, n in zip(best.tolist(), sizes.tolist(), strict=True)], np.maximum(score, 0.0).tolist()


def learn(
    labelled: DataFrame, *, docs: int = DOCS, doc_chars: int = DOC_CHARS, chars: int = CHARS, all_chars: int = ALL_CHARS, labels: int = LABELS
) -> tuple[tuple[str, str], ...]:
    """(language, sample) of (doc_id, text, lang), all not null. The driver gets the bounded sample alone."""
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    most = counts.orderBy(F.desc("rows"), "lang").limit(labels).collect()
    languages = len(most)
    if not languages:
        return ()
    known = F.broadcast(labelled.sparkSession.createDataFrame(most, counts.schema))
    wanted = max(FEWEST, min(docs, 2 * all_chars // (languages * doc_chars)))
    place = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    start = 1 + F.pmod(F.shiftright(place, 8), F.greatest(F.lit(1), F.length("text") - doc_chars))
    drawn = labelled.join(known, "lang").where(F.pmod(place, F.lit(1 << 30)) < F.least(F.lit(1.0), wanted / F.col("rows")) * (1 << 30))
    rows = drawn.select("lang", place.alias("place"), F.substr("text", start, F.lit(doc_chars)).alias("text")).collect()
    share = max(1, min(chars, all_chars // languages))
    samples: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"], r["text"])):
        if len(samples.setdefault(r["lang"], "")) < share:
            samples[r["lang"]] = (samples[r["lang"]] + normal(r["text"]))[:share]
    return tuple((k, v) for k, v in sorted(samples.items()) if v)


def identify(
    docs: DataFrame, samples: tuple[tuple[str, str], ...], *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), lang_pred: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """The columns of ``keep`` with the language and score of every text, under the names given."""
    spark = docs.sparkSession
    small_batches(spark, SMALL_BATCH)
    shared = spark.sparkContext.broadcast(samples)
    (whole,) = fresh([*docs.columns, *keep], "whole")
    named = docs.select(*keep, F.col(text).cast("string").alias(whole))

    def run(batches):
        model = resident(("languages", shared.value), lambda: Parser(shared.value))
        for rows in batches:
            names, scores = model.predict(rows.column(len(keep)).to_pylist())
            made = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], *made], [*keep, lang_pred, score])

    schema = named.drop(whole).schema.add(lang_pred, "string").add(score, "double")
    return named.mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; fold 2 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def labelled_rows(docs: DataFrame, text: str, doc_id: str, lang: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return rows.where((fold(F.col("doc_id")) != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull())


def predict_languages(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from the other folds of ``docs`` itself."""
    samples = learn(labelled_rows(docs, text, doc_id, lang))
    target = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(fold(F.col(doc_id)) == 2, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return identify(target, samples, keep=("doc_id", "held_out"))


def keep_identified(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The documents with a language; a missing label becomes the predicted one, all other
    columns stay. Where no row is labelled, those with a letter stay, without a label."""
    samples = learn(labelled_rows(docs, text, doc_id, lang))
    if not samples:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    pred, score = fresh(docs.columns, "lang_pred", "score")
    found = identify(docs, samples, text=text, keep=tuple(docs.columns), lang_pred=pred, score=score)
    label = F.coalesce(F.col(lang), F.col(pred)).alias(lang)
    return found.where(F.col(pred) != "und").select(*[label if c == lang else c for c in docs.columns])


def op7_language_id(spark, sf_dir):
    return predict_languages(table(spark, sf_dir, "documents"))
