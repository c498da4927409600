"""Secret scan: fixed patterns, and strings in a sensitive context that a dictionary-primed Zstandard can't compress.

The method: a candidate is a run of 16 or more characters of secrets' alphabets that holds letters and digits, and stands
within ``reach`` characters after a word such as key or token. In unspaced KEY=value text the word is part of the run: if the
run itself isn't reported, each part that follows a = and ends at the next one (or with it, where = closes the run) is a candidate too, up to
the first one reported, whose span takes in the rest of the run. A candidate's novelty is what it adds to the compressed size of its
surrounding text, for a compressor primed with a dictionary of identifiers, in bytes a character. The dictionary holds common ones and,
nearest to the text, those that stand in the most documents of the table; only letters and underscores make an identifier, so
that no key can enter it, however many copies of it there are. Words and identifiers that stand
in the dictionary or nearby add little; keys add as much as their entropy. Candidates at or above ``novelty`` are reported,
unless they touch a span that a pattern has found.

Surroundings are up to ``AROUND`` characters on either side. Each text is scanned whole and by itself, in time that grows with its
length and its spans; only counts of identifiers, summed in map tasks, are shuffled, and at most ``LISTED`` of them come to the driver.
Defined cases: null is the empty text; repeated rows are each scanned; offsets count code points, the end is exclusive; without spans the
digest is that of the empty string; an empty table gives no rows; columns beside key and text are not read by ``scan``, and
``without_secrets`` keeps them, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import by_batch

NOVELTY, REACH, AROUND, LISTED = 0.5, 48, 256, 2000
KINDS = ("assign", "access", "hex", "novel")
#: Patterns of secrets. A hexadecimal or access key pattern with a least length finds what the plain one
#: finds and the length test keeps, since either match ends where the run of its characters ends.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_WORDS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api key", "access_key", "private_key", "private key", "auth", "bearer", "credential", "signature", "session", "cookie", "license_key", "client_id")
CONTEXT = re.compile("|".join(CONTEXT_WORDS), re.ASCII | re.IGNORECASE)
LEAST = 16
CANDIDATE, DIGIT, LETTER, EQUALS = re.compile(rf"[A-Za-z0-9+/_=.-]{{{LEAST},}}"), re.compile("[0-9]"), re.compile("[A-Za-z]"), re.compile("=+")
IDENTIFIERS = (
    "import return function const public static private class string value index length config default environment "
    "username password passwd secret token api_key apikey access_key secret_key private_key client_id client_secret "
    "authorization bearer credential signature session_id cookie certificate database connection localhost example.com "
    "http://www. https://api. /usr/local/bin/ /home/user/ /var/lib/ /etc/ .json .html .yaml .properties .amazonaws.com "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000-0000-0000-0000-000000000000 "
    "2020-01-01T00:00:00Z version=1.0.0 get_value set_value to_string from_string index_of is_valid has_next"
)


#: Two or more parts of letters, joined by underscores or by a capital.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])(?:[A-Za-z]+(?:_+[A-Za-z]+)+|[a-z]+(?:[A-Z][a-z]+)+)(?![A-Za-z0-9_])")


def identifiers(docs: DataFrame, text: str = "text", most: int = LISTED, longest: int = 40) -> str:
    """The identifiers of the most texts, each counted once a text, the most frequent ones last; ties by code point."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        counts: Counter[str] = Counter()
        for value in batch.column(0).to_pylist():
            if value:
                counts.update({w for w in IDENTIFIER.findall(value) if len(w) <= longest})
        return pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]) if counts else None

    sums = by_batch(docs.select(F.col(text).alias("text")), work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return " ".join(r["word"] for r in reversed(sums.orderBy(F.desc("n"), "word").limit(most).collect()))


@lru_cache(4)
def _primed(known: str) -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(f"{IDENTIFIERS} {known}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty_of(before: str, candidate: str, after: str, known: str = "") -> float:
    """Compressed bytes that the candidate adds to its surroundings, for each of its characters."""
    size = lambda s: len(_primed(known).compress(s.encode("utf-8", "replace")))
    return (size(f"{before} {after} {candidate}") - size(f"{before} {after} ")) / len(candidate)


def patterns_in(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order of start and kind."""
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _parts(text: str, first: int, end: int) -> Iterator[tuple[int, int]]:
    """The run itself, then what stands between its equals signs; those that close the run belong to its last part."""
    yield first, end
    start = None
    for m in EQUALS.finditer(text, first, end):
        if m.end() == end:
            break
        if start is not None:
            yield start, m.start()
        start = m.end()
    if start is not None:
        yield start, end


def novel_in(text: str, known: list[tuple[int, int, int]], novelty: float = NOVELTY, reach: int = REACH, words: str = "") -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates that the method reports beside the known spans."""
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    found, at = [], 0
    for m in CANDIDATE.finditer(text):
        first, end = m.span()
        # Known spans are in order of their starts; those that end before this run are passed for good.
        while at < len(known) and known[at][2] <= first:
            at += 1
        if not (DIGIT.search(text, first, end) and LETTER.search(text, first, end)):
            continue
        for start, stop in _parts(text, first, end):
            if stop - start < LEAST or not (CONTEXT.search(text, max(0, start - reach), start) and DIGIT.search(text, start, stop) and LETTER.search(text, start, stop)):
                continue
            while at < len(known) and known[at][2] <= start:
                at += 1
            if at < len(known) and known[at][0] < end:
                continue
            if novelty_of(text[max(0, start - AROUND) : start], text[start:stop], text[stop : stop + AROUND], words) >= novelty:
                found.append((start, 3, end))
                break
    return found


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", *, novelty: float = NOVELTY, reach: int = REACH) -> DataFrame:
    """For each row: key, n_assign, n_access, n_hex, n_novel, base_sha256, spans (kind:start:end, comma-joined), and the marked strings."""

    words = identifiers(docs, text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans, strings = [[], [], [], []], [], [], []
        for value in batch.column(1):
            one = value.as_py() or ""
            base = patterns_in(one)
            every = sorted(base + novel_in(one, base, novelty, reach, words))
            listed = lambda found: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)
            for k, column in enumerate(counts):
                column.append(sum(x[1] == k for x in every))
            digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
            spans.append(listed(every))
            strings.append([one[a:b] for a, _, b in every])
        arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(strings, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "strings"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = by_batch(rows, work, f"key {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, strings array<string>")
    return out.withColumnRenamed("key", key)


def without_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "<secret>", **limits) -> DataFrame:
    """The rows with every span replaced by a mark, all other columns as they are; texts without spans, and nulls, don't change."""
    novelty, reach = limits.get("novelty", NOVELTY), limits.get("reach", REACH)
    at, words = docs.columns.index(text), identifiers(docs, text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for value in batch.column(at):
            one = value.as_py()
            if one:
                base = patterns_in(one)
                cut, parts = 0, []
                for start, _, end in sorted(base + novel_in(one, base, novelty, reach, words)):
                    if start >= cut:
                        parts += [one[cut:start], mark]
                    cut = max(cut, end)
                one = "".join([*parts, one[cut:]])
            texts.append(one)
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(lambda batches: (work(b) for b in batches), docs.schema)
