"""Language-model scores from the subword lattice of an existing vocabulary.

A word, with a gap in front, can be cut into the vocabulary's pieces in many ways; its probability is the sum over all of them,
by the forward recursion over its bytes in log space. Pieces never cross a gap, so a text's probability is the product over
its words and one end. Pieces weigh as the vocabulary's own scores say; in this file these are ranks, taken by Zipf's law.
Single bytes are pieces too, so every text has a probability. The pieces are as the vocabulary has them, and so are their weights
unless ``fitted`` is asked for. Then the training texts teach both levels: the weights are fitted to all distinct training words by
expectation and maximisation, ``PASSES`` times, from the vocabulary's; and a training word is an arc of its own over its whole length, of its
discounted share of the training tokens, beside the cuts, which share what the discount leaves. The base score has words' counts with one added.

1. One pass over the texts writes a row for every few MB of them: a dictionary of the distinct words, as 64-bit BLAKE2b hashes with
   their spelling and training count, and for each text its words as places in that dictionary, with counts.
2. The dictionaries are summed to one row for each word of the corpus; each of these is scored once.
3. Dictionary entries meet the words' rows by a sort-merge join of written tables, so that a word that stands in a third of all
   texts has one row for each few MB, and is split like any skewed key; what they are told is grouped by dictionary and joined
   to its texts. No text is shuffled, and no word is read twice.

A word of over ``LONG`` bytes is scored in segments, with one number for each byte of it.

Words are those between ASCII white space, A to Z in lower case, then one end. Defined cases: null is the empty text, of
one token, the end; rows with a null id are training texts; repeated rows each count; an empty table gives no rows; any length of
text, and of a word, is taken whole; columns beside key and text are not read, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import crc_of, durable, hashes_of, mixed, pieces, removed, spaced_words

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PIECE_BYTES, ZIPF, LONG, SEGMENT = 8 << 20, 10.0, 1024, 1 << 15
#: Passes of the fit, and the weight that the vocabulary's own weights have in each, as a number of pieces.
PASSES, PRIOR = 2, 256.0
#: So many words are scored at a time, if they have no more bytes than ``PIECE_BYTES``.
GATHERED = 1 << 16


class _Rolling:
    """Polynomial hashes modulo 2^64 of ranges of short byte strings, from prefix sums; the base is odd and so has an inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of values[start:end] for each pair; equal ranges get equal hashes wherever they stand."""
        self.powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], dtype=np.uint64, out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


_PIECE = _Rolling(0xBF58476D1CE4E5B9 | 1)


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(crc_of(key), F.lit(7)) == 2, F.lit(False))


class Vocabulary:
    """Pieces as bytes with a space for the gap, their log weights, and a hash table to look up many at once.

    The first 256 are the single bytes, the last one is the end.
    """

    def __init__(self, model_file: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ranks: dict[bytes, float] = {}
        for i in range(model.vocab_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i).replace("▁", " ").encode()
                if b" " not in piece[1:] and piece:
                    ranks[piece] = min(-model.get_score(i), ranks.get(piece, np.inf))
        self.texts = [bytes([i]) for i in range(256)] + list(ranks)
        last = max(ranks.values(), default=0.0)
        weights = 1 / (ZIPF + np.array([last * 4] * 256 + list(ranks.values()) + [0.0]))
        self.log = np.log(weights / weights.sum())
        self.longest = max(map(len, self.texts))
        keys = self._keys(list(ranks))
        self.bits = 20
        self.table_key, self.table_id, self.probes = np.zeros((1 << self.bits) + 64, np.uint64), np.full((1 << self.bits) + 64, -1, np.int32), 1
        for n, key in enumerate(keys.tolist()):
            slot = key >> (64 - self.bits)
            while self.table_id[slot] >= 0:
                slot += 1
            self.table_key[slot], self.table_id[slot] = key, 256 + n
            self.probes = max(self.probes, slot - (key >> (64 - self.bits)) + 1)

    @staticmethod
    def _keys(texts: list[bytes]) -> np.ndarray:
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        return _PIECE.ranges(mixed(data.astype(np.uint64) + np.uint64(1)), np.append(0, ends[:-1]), ends)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each key, or -1."""
        flat = keys.ravel()
        slot = (flat >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.table_key[slot] == flat, self.table_id[slot], np.int32(-1))
        # Most slots are empty, so few keys are left that stand behind another piece.
        left = np.flatnonzero((out < 0) & (self.table_id[slot] >= 0))
        for i in range(1, self.probes):
            at = slot[left] + i
            found = (self.table_key[at] == flat[left]) & (self.table_id[at] >= 0)
            out[left[found]] = self.table_id[at[found]]
            left = left[~found & (self.table_id[at] >= 0)]
        return out.reshape(keys.shape)

    def lattice(self, words: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end in words of one length (rows of bytes): (start, rows, pieces) of the arcs that end there."""
        rows, n = words.shape
        _PIECE.powers(n + 1)
        sums = np.zeros((rows, n + 1), np.uint64)
        np.cumsum(mixed(words.astype(np.uint64) + np.uint64(1)) * _PIECE.up[:n], axis=1, dtype=np.uint64, out=sums[:, 1:])
        arcs: list[list] = [[] for _ in range(n + 1)]
        everywhere = np.arange(rows)
        for size in range(1, min(n, self.longest) + 1):
            keys = mixed((sums[:, size:] - sums[:, :-size]) * _PIECE.down[: n - size + 1] + np.uint64(size))
            found = self.find(keys)
            for start in np.flatnonzero((found >= 0).any(axis=0)).tolist():
                held = np.flatnonzero(found[:, start] >= 0)
                arcs[start + size].append((start, held, found[held, start]))
        for i in range(n):
            arcs[i + 1].append((i, everywhere, words[:, i].astype(np.int32)))
        return arcs

    def forward(self, arcs: list, rows: int) -> list[np.ndarray]:
        """Log sums over all cuts up to each place."""
        alpha = [np.zeros(rows)]
        for own in arcs[1:]:
            total = np.full(rows, -np.inf)
            for start, held, piece in own:
                total[held] = np.logaddexp(total[held], alpha[start][held] + self.log[piece])
            alpha.append(total)
        return alpha

    def segments(self, word: np.ndarray, back: bool = False) -> Iterator[list[tuple[int, int, float, int]]]:
        """The arcs (start, end, log weight, piece) of a long word, in rising or falling order of their starts, a segment of starts at a time."""
        n = len(word)
        for a in reversed(range(0, n, SEGMENT)) if back else range(0, n, SEGMENT):
            b = min(a + SEGMENT, n)
            part = word[a : min(b + self.longest, n)]
            starts, ends, found = [np.arange(b - a)], [np.arange(b - a) + 1], [part[: b - a].astype(np.int64)]
            for size in range(1, min(len(part), self.longest) + 1):
                at = np.arange(min(b - a, len(part) - size + 1))
                pieces_at = self.find(_PIECE.ranges(mixed(part.astype(np.uint64) + np.uint64(1)), at, at + size))
                held = np.flatnonzero(pieces_at >= 0)
                starts.append(held)
                ends.append(held + size)
                found.append(pieces_at[held])
            starts, ends, found = (np.concatenate(c) for c in (starts, ends, found))
            order = np.argsort(-starts if back else starts, kind="stable")
            yield list(zip((starts[order] + a).tolist(), (ends[order] + a).tolist(), self.log[found[order]].tolist(), found[order].tolist(), strict=True))

    def forward_long(self, word: np.ndarray) -> array:
        """Log sums over all cuts up to each place of one word of any length."""
        none = -math.inf
        alpha = array("d", [none]) * (len(word) + 1)
        alpha[0] = 0.0
        for arcs in self.segments(word):
            for start, end, log, _ in arcs:
                x, y = alpha[end], alpha[start] + log
                high, low = (x, y) if x > y else (y, x)
                alpha[end] = high if low == none else high + math.log1p(math.exp(low - high))
        return alpha

    def expected_long(self, word: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the cuts of one word of any length."""
        none, alpha, out = -math.inf, self.forward_long(word), [0.0] * len(self.log)
        beta = array("d", [none]) * len(alpha)
        beta[-1] = 0.0
        for arcs in self.segments(word, back=True):
            for start, end, log, piece in arcs:
                x, y = beta[start], beta[end] + log
                high, low = (x, y) if x > y else (y, x)
                beta[start] = high if low == none else high + math.log1p(math.exp(low - high))
                out[piece] += math.exp(alpha[start] + y - alpha[-1])
        return np.array(out)

    @staticmethod
    def _by_size(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of words of one length, their bytes with the gap in front as rows); long ones alone, the end without a gap."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        for size in np.unique(sizes).tolist():
            every = np.flatnonzero(sizes == size)
            most = len(every) if size == 0 else 1 if size > LONG else max(1, (1 << 18) // (size + 1))
            for i in range(0, len(every), most):
                at = every[i : i + most]
                yield at, np.concatenate((np.full((len(at), int(size > 0)), 32, np.uint8), data[starts[at][:, None] + np.arange(size)]), axis=1)

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural log probability of each word. The empty word is the end."""
        scores = np.zeros(len(words))
        for at, rows in self._by_size(words):
            if rows.shape[1] == 0:
                scores[at] = self.log[-1]
            elif rows.shape[1] > LONG + 1:
                scores[at] = self.forward_long(rows[0])[-1]
            else:
                scores[at] = self.forward(self.lattice(rows), len(at))[-1]
        return scores

    def expected(self, words: list[bytes]) -> np.ndarray:
        """How often each piece is expected in the cuts of the words, by the forward and the backward recursion."""
        out = np.zeros(len(self.log))
        for at, rows in self._by_size(words):
            n = rows.shape[1]
            if n == 0:
                out[-1] += len(at)
                continue
            if n > LONG + 1:
                out += self.expected_long(rows[0])
                continue
            arcs = self.lattice(rows)
            alpha = self.forward(arcs, len(at))
            beta = [np.full(len(at), -np.inf) for _ in range(n)] + [np.zeros(len(at))]
            found, shares = [], []
            for end in range(n, 0, -1):
                for start, held, piece in arcs[end]:
                    through = self.log[piece] + beta[end][held]
                    beta[start][held] = np.logaddexp(beta[start][held], through)
                    found.append(piece)
                    shares.append(np.exp(alpha[start][held] + through - alpha[n][held]))
            out += np.bincount(np.concatenate(found), np.concatenate(shares), len(out))
        return out


_PART = "part long, keys array<long>, train array<boolean>, n_tokens array<long>, kinds array<int>, places binary, counts binary, words array<long>, spelled array<binary>, sums array<long>"
_LAYOUT = pa.schema([("part", pa.int64()), ("keys", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int32())), ("places", pa.binary()), ("counts", pa.binary()), ("words", pa.list_(pa.int64())), ("spelled", pa.list_(pa.binary())), ("sums", pa.list_(pa.int64()))])


class _Numbered(dict):
    """Words with their numbers, in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _dictionary(part: pa.RecordBatch) -> pa.RecordBatch:
    # Words are numbered as they come, so that each distinct one is hashed once and kept once.
    numbers, held = _Numbered(), []
    for text in part.column(2):
        tokens = [*spaced_words(text.as_py(), lower=True), b""]
        held.append(np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)))
    sizes = np.array([len(h) for h in held])
    train = part.column(1).to_numpy(zero_copy_only=False)
    spelled = list(numbers)
    hashes = hashes_of(spelled)
    order = np.argsort(hashes)
    words, rank = hashes[order], np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = rank[np.concatenate(held)]
    text = np.repeat(np.arange(len(sizes)), sizes)
    held, counts = np.unique(text * len(words) + place, return_counts=True)
    sums = np.bincount(place, train[text], len(words)).astype(np.int64)
    cells = {
        "part": uuid.uuid4().int >> 65, "keys": part.column(0).to_pylist(), "train": train.tolist(), "n_tokens": sizes, "kinds": np.bincount(held // len(words), minlength=len(sizes)),
        "places": (held % len(words)).astype(np.int32).tobytes(), "counts": counts.astype(np.int32).tobytes(),
        "words": words.view(np.int64), "spelled": [spelled[i] for i in order.tolist()], "sums": sums,
    }
    return pa.RecordBatch.from_arrays([pa.array([cells[f.name]], f.type) for f in _LAYOUT], schema=_LAYOUT)


def _pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting, size = [], 0
    for batch in batches:
        for part in pieces(batch, "text", PIECE_BYTES) if batch.num_rows else ():
            waiting.append(part)
            size += part.nbytes
            if size >= PIECE_BYTES:
                yield _dictionary(_joined(waiting))
                waiting, size = [], 0
    if waiting:
        yield _dictionary(_joined(waiting))


def dictionaries(rows: DataFrame) -> DataFrame:
    """From (key, train, text): a row for every few MB of texts, with their dictionary and each text's words as places in it."""
    return durable(rows.select("key", "train", "text").mapInArrow(_pieces_of, _PART), "dictionaries")


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of some ``GATHERED`` rows, since words are scored by length, and numpy takes many at a time faster."""
    waiting, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= GATHERED or size >= PIECE_BYTES:
            yield _joined(waiting)
            waiting, rows, size = [], 0, 0
    if waiting:
        yield _joined(waiting)


def fit(vocabulary: Vocabulary, words: DataFrame) -> None:
    """Fits the vocabulary's weights to the distinct words of (total, spelled) with a total above 0; only one number for each piece reaches the driver."""
    trained = words.where("total > 0").select("spelled")
    for _ in range(PASSES):
        sent = words.sparkSession.sparkContext.broadcast(vocabulary)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(sent.value.log))
            for batch in _gathered(batches):
                total += sent.value.expected(batch.column(0).to_pylist())
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["piece", "n"])

        counts = np.exp(vocabulary.log) * PRIOR
        counts[:256] += 1
        for piece, n in trained.mapInArrow(count, "piece long, n double").groupBy("piece").agg(F.sum("n")).collect():
            counts[piece] += n
        vocabulary.log = np.log(counts / counts.sum())


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", *, model_file: str = MODEL, fitted: bool = False) -> DataFrame:
    """For each row: key, held_out, n_tokens, n_known, train_tokens, base_score and score, both log10.

    With ``fitted`` the score is of weights and whole words learned from the training texts, else of the vocabulary's own weights.
    """
    texts = F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")
    found = dictionaries(docs.select(F.col(key).cast("long").alias("key"), (~held_out(F.col(key))).alias("train"), texts))
    listed = found.select(F.explode(F.arrays_zip("words", "sums", "spelled")).alias("w")).select("w.words", "w.sums", "w.spelled")
    words = durable(listed.groupBy(F.col("words").alias("word")).agg(F.sum("sums").alias("total"), F.any_value("spelled").alias("spelled")), "words")
    seen = [F.count_if(F.col("total") == n) for n in (1, 2)]
    train_tokens, distinct_tokens, once, twice = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count_if(F.col("total") > 0), *seen).first()
    vocabulary, learned = Vocabulary(model_file), fitted and train_tokens > 0
    if learned:
        fit(vocabulary, words)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    discount = (once + 1) / (once + 2 * twice + 2)

    def spell(batch: pa.RecordBatch) -> pa.RecordBatch:
        logs = sent.value.score(batch.column(2).to_pylist())
        if learned:
            share = np.maximum(batch.column(1).to_numpy() - discount, 0) / train_tokens
            whole = np.log(share, out=np.full(len(share), -np.inf), where=share > 0)
            logs = np.logaddexp(whole, logs + math.log(discount * distinct_tokens / train_tokens))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(logs / np.log(10))], names=["word", "total", "log"])

    spelled = words.select("word", "total", "spelled").mapInArrow(lambda batches: map(spell, _gathered(batches)), "word long, total long, log double")
    scored = durable(spelled, "scored")
    removed(words)
    # One plan at every size: the words' rows grow with the corpus, and are never broadcast.
    asked = found.select("part", F.posexplode("words").alias("place", "word"))
    # Three lists of numbers, filled in one order, are half as large as a list of rows.
    told = asked.join(scored.hint("merge"), "word").groupBy("part").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("place", "total", "log")])
    told = told.withColumnsRenamed({"places": "told_places"})
    texts = found.select("part", "keys", "train", "n_tokens", "kinds", "places", "counts").join(told.hint("merge"), "part")

    def add(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for n in range(batch.num_rows):
            row = {c: batch.column(i)[n] for i, c in enumerate(batch.schema.names)}
            order = np.argsort(row["told_places"].values.to_numpy())
            total, log = row["totals"].values.to_numpy()[order], row["logs"].values.to_numpy()[order]
            places, counts = (np.frombuffer(row[c].as_buffer(), np.int32) for c in ("places", "counts"))
            kinds = row["kinds"].values.to_numpy()
            starts = np.cumsum(kinds) - kinds
            summed = lambda values, counts=counts, starts=starts: np.add.reduceat(values * counts, starts)
            columns = [row["keys"].values, row["train"].values, row["n_tokens"].values, pa.array(summed((total > 0).astype(np.int64)[places])), pa.array(summed(np.log10(total + 1.0)[places])), pa.array(summed(log[places]))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "train", "n_tokens", "n_known", "logs", "score"])

    out = texts.mapInArrow(lambda batches: (r for b in batches for r in add(b)), "key long, train boolean, n_tokens long, n_known long, logs double, score double")
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(train_tokens + distinct_tokens + 1))
    return out.select(F.col("key").alias(key), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
