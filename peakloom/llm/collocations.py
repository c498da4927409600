"""Phrase collocations by language, from counts of all phrases of up to ``LONGEST`` words (suffix-sigma).

1. ``suffixes``: one pass over the texts cuts pieces into words and takes, from every word on, the ``LONGEST`` words that follow in its piece. Equal
   ones are counted in the map task before anything is written, ``FLUSH`` words at a time, so that a suffix which stands in a third of all places
   comes as one row for each flush. The rows are a written table, sorted by flush.
2. ``phrases``: the rows are dealt by ranges of language, first word, second and so on, and sorted. The ranges follow the rows, so a first word,
   or pair, with a third of them is spread over as many tasks as its rows need. Each task counts all prefixes with one stack: a
   prefix's count grows as long as sorted suffixes begin with it, and is given out when one doesn't. Rows of a batch are compared as arrays, the
   stack carries open prefixes from batch to batch. A prefix below the least count is given out only where it touches a border of the task, since the
   rest of it may lie beyond; the few shares of such prefixes are summed after.
3. ``collocations``: candidates meet the counts of their parts by joins, and are scored in exact decimals. All parts of a candidate are at least as
   frequent as it is, so the table of frequent phrases has them. Of each language the best are kept in every task before they are ranked.

Words keep their spelling throughout: nothing is hashed. In a row they stand one after another, each closed by a line feed, which neither words
(pieces end there) nor the names of languages, in which it is escaped, can hold; so the suffixes that begin with a phrase are neighbours in byte order.

Defined cases: null text is empty; null lang is ``und``, together with rows that say so; repeated rows each count; ties in score
and count go by the phrase in UTF-8 order; an empty table gives no rows; texts of any length and words of any length are taken whole; columns beside text and
lang are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.common import durable

LONGEST, LEAST, COVER, TOP = 3, 10, 50, 2000
#: Words that a map task counts before it gives out their suffixes, and bytes of their spelling; rows of a batch given out.
FLUSH, FLUSH_BYTES, ROWS = 1 << 22, 64 << 20, 1 << 16
_BITS = 20
#: A to Z to lower case; what ends a piece becomes a full stop, which is then a token of its own; a tab is left to split words.
_CUT = bytes(c + 32 if 65 <= c <= 90 else 46 if chr(c) in ".,;:!?\n\v\f\r" else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, with a full stop wherever a piece ends."""
    return text.translate(_CUT).replace(b".", b" . ").split()


class _Numbers(dict):
    """Numbers of words in the order in which they come; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


class _Flush:
    """The suffixes that a map task has seen and not given out, by language."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.numbers, self.parts, self.n, self.bytes = _Numbers({b".": 0}), {}, 0, 0

    def add(self, lang: str | None, words: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Takes words in slices, so that their numbers fit the bits that a suffix has for each."""
        size = 1 << (_BITS - 1)
        for start in range(0, len(words), size):
            part = words[start : start + size + LONGEST - 1]
            if len(self.numbers) + len(part) >= 1 << _BITS or self.n >= FLUSH or self.bytes >= FLUSH_BYTES:
                yield from self.out()
            known = len(self.numbers)
            number = np.fromiter(map(self.numbers.__getitem__, part), np.int64, len(part))
            if len(self.numbers) > known:
                self.bytes += sum(map(len, part))
            begins = min(size, len(part))
            key, inside = np.zeros(begins, np.int64), np.ones(begins, bool)
            for i in range(LONGEST):
                word = np.zeros(begins, np.int64)
                there = number[i : i + begins]
                word[: len(there)] = there
                inside &= word > 0
                key = key << _BITS | np.where(inside, word, 0)
            key = key[key > 0]
            self.parts.setdefault(lang, []).append(key)
            self.n += len(key)

    def out(self) -> Iterator[pa.RecordBatch]:
        """Distinct suffixes, in order, with how often each was seen."""
        words = sorted(self.numbers.keys() - {b"."})
        place, mask = np.zeros(len(words) + 1, np.int64), (1 << _BITS) - 1
        place[[self.numbers[x] for x in words]] = np.arange(1, len(words) + 1)
        spelling = pa.array([b"", *(x + b"\n" for x in words)], pa.binary()).cast(pa.string())
        for lang, parts in self.parts.items():
            key, renamed = np.concatenate(parts), 0
            for i in reversed(range(LONGEST)):
                renamed = renamed << _BITS | place[key >> (i * _BITS) & mask]
            key, count = np.unique(renamed, return_counts=True)
            for start in range(0, len(key), ROWS):
                some = key[start : start + ROWS]
                spelled = [spelling.take(pa.array(some >> (i * _BITS) & mask)) for i in reversed(range(LONGEST))]
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(pa.scalar(_escaped(lang)), *spelled, ""), pa.array(count[start : start + ROWS])], names=["suffix", "n"])
        self.clear()


def _escaped(lang: str | None) -> str:
    return ("und" if lang is None else lang).replace("%", "%25").replace("\n", "%0A") + "\n"


def suffixes(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(suffix, n): the words that follow from every word on, at most LONGEST, and how often a flush of a map task has seen them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = _Flush()
        for batch in batches:
            for name, x in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if x.is_valid:
                    yield from flush.add(name, tokens(x.as_buffer().to_pybytes()))
        yield from flush.out()

    return docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "suffix string, n long")


class _Stack:
    """For each length, the prefix that the last row began with, its count so far, and whether it may have begun in the task before."""

    def __init__(self, least: int):
        self.least, self.begun, self.open = least, False, [None] * (LONGEST + 1)

    def push(self, suffix: pa.Array, n: np.ndarray) -> Iterator[tuple[bytes, int]]:
        """(prefix, count) of the prefixes that end with these rows, which follow all rows before in order; length 0 is the language alone."""
        suffix = suffix.cast(pa.binary())
        parts = pc.split_pattern(suffix, b"\n")
        begin, words = parts.offsets.to_numpy(), parts.flatten()
        length = np.diff(begin) - 2
        new = np.zeros(len(suffix), bool)
        new[0] = True
        for level in range(LONGEST + 1):
            has = length >= level
            word = words.take(pa.array(begin[:-1] + level, mask=~has))
            new[1:] |= pc.fill_null(pc.not_equal(word[1:], word[:-1]), True).to_numpy(zero_copy_only=False)
            there = np.flatnonzero(has)
            starts = np.flatnonzero(new[there])
            sums = np.add.reduceat(n[there], starts) if len(there) else np.zeros(0, np.int64)
            starts = there[starts] if len(there) else there

            def name(i: int, level: int = level) -> bytes:
                return b"".join(x + b"\n" for x in suffix[i].as_py().split(b"\n")[: level + 1])

            was, border = self.open[level], not self.begun
            if was is not None:
                if len(starts) and starts[0] == 0 and name(0) == was[0]:
                    sums[0] += was[1]
                    border = was[2]
                elif was[1] >= self.least or was[2]:
                    yield was[0], was[1]
            keep = sums >= self.least
            keep[:1] |= border
            keep[-1:] = False
            for i in np.flatnonzero(keep).tolist():
                yield name(int(starts[i])), int(sums[i])
            self.open[level] = (name(int(starts[-1])), int(sums[-1]), border and len(sums) == 1) if len(sums) else None
        self.begun = True

    def end(self) -> Iterator[tuple[bytes, int]]:
        for x in filter(None, self.open):
            yield x[0], x[1]


def phrases(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(phrase, n) of every prefix of the suffixes with at least so many places, and of every language; words and language are closed by line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = _Stack(least)

        def given(found: Iterator[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
            if some := list(found):
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.binary()).cast(pa.string()), pa.array([x for _, x in some], pa.int64())], names=["phrase", "n"])

        for batch in batches:
            if batch.num_rows:
                yield from given(stack.push(batch.column("suffix"), batch.column("n").to_numpy()))
        yield from given(stack.end())

    shares = rows.repartitionByRange("suffix").sortWithinPartitions("suffix").mapInArrow(run, "phrase string, n long")
    summed = shares.groupBy("phrase").agg(F.sum("n").alias("n"))
    return summed.where((F.col("n") >= least) | (F.size(F.split("phrase", "\n")) == 2))


def _closed(lang: Column, words: Column) -> Column:
    return F.concat(lang, F.lit("\n"), F.array_join(words, "\n"), F.lit("\n"))


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to LONGEST words.

    A phrase with ``a`` places, cut into parts with ``l`` and ``r``, scores floor(10^6 a a / (l r)); its lowest cut counts. A phrase inside a longer
    one with at least ``cover`` percent of its places is left out, whether or not the longer one is itself.
    """
    rows = durable(suffixes(docs, text, lang), "suffixes")
    known = durable(phrases(rows, least), "phrases")
    parts = known.select("phrase", F.col("n").alias("a"), F.split("phrase", "\n").alias("x")).select("phrase", "a", F.element_at("x", 1).alias("lang"), F.slice("x", 2, F.size("x") - 2).alias("words"))
    long = parts.where(F.size("words") >= 2)
    cuts = long.select("phrase", "a", "lang", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("phrase", "a", "k", _closed(F.col("lang"), F.slice("words", 1, F.col("k"))).alias("left"), _closed(F.col("lang"), F.slice("words", F.col("k") + 1, F.size("words"))).alias("right"))
    cuts = cuts.join(known.select(F.col("phrase").alias("left"), F.col("n").alias("l")), "left").join(known.select(F.col("phrase").alias("right"), F.col("n").alias("r")), "right")
    score = F.expr("(cast(a AS decimal(19,0)) * cast(a AS decimal(19,0)) * 1000000) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))")
    scored = cuts.groupBy("phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    places = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: _closed(F.col("lang"), F.slice("words", i, m)))))
    covers = long.where(F.size("words") >= 3).select("a", F.explode(places).alias("phrase")).groupBy("phrase").agg(F.max("a").alias("longer"))
    kept = long.join(covers, "phrase", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))).join(scored, "phrase")
    named = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = parts.where(F.size("words") == 0).select("lang", F.col("a").alias("n"))
    own = F.replace(F.replace("lang", F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    return best.join(totals, "lang").select(own.alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
