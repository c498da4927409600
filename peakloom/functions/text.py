"""Text to typed data as column expressions: identifiers, tokens, peak lists, formulas in text, answers and tool calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no answer.
NO_ANSWER = ("", "none", "null", "n/a", "na", "unknown", "error", "failed")


def squeezed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c.cast("string"), r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    s = squeezed(c)
    return F.when(s != "", s)


def first_filled(*columns: Column) -> Column:
    """The first of the values that isn't blank, squeezed."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def compact_id(c: Column) -> Column:
    """Runs of characters outside identifiers as one underscore, none at the ends; null where nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(squeezed(c), r"[^A-Za-z0-9_.:-]+", "_"), r"^_+|_+$", "")
    return F.when(kept != "", kept)


def sha1_text(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, n)


def keyed(kind: str, *parts: Column, n: int = 24) -> Column:
    """A content key: the kind and a digest of the parts joined by bars, nulls as empty."""
    return F.concat(F.lit(f"{kind}:"), sha1_text(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), n))


def split_pipe(c: Column) -> Column:
    """The filled parts between bars; empty for null."""
    parts = F.transform(F.split(F.coalesce(squeezed(c), F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def number(c: Column) -> Column:
    """A double where the text is one, else null."""
    return blank_to_null(c).try_cast("double")


def query_terms(c: Column, most: int) -> Column:
    """The first terms of a search text: letters, digits and _ : + . - within it, cut to plain words, in lower case."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))), 1, most)


def tokens(c: Column) -> Column:
    """Every word of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def _doubles(found: Column) -> Column:
    return F.transform(found, lambda x: x.cast("double"))


def numeric_shifts(c: Column) -> Column:
    """Every number; the second of a range keeps its dash as a sign."""
    return _doubles(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)))


def range_ends(c: Column) -> Column:
    """Every number, both ends of a range as they stand."""
    apart = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<=\d)\s*[-–—~]\s*(?=\d)", " ")
    return numeric_shifts(apart)


def proton_shifts(c: Column) -> Column:
    """Shifts of a proton peak list, each as often as its integral says; a range stands for its middle, to four places."""
    after = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)^.*?δ", "")
    entries = F.split(F.regexp_replace(after, r"\)\s*,", ");"), ";")

    def expand(entry: Column) -> Column:
        numbers = _doubles(F.regexp_extract_all(entry, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))
        first = F.get(numbers, 0)
        middle = F.when(entry.rlike(r"\d+(?:\.\d+)?\s*[–-]\s*\d+(?:\.\d+)?"), F.bround((first + F.get(numbers, 1)) / 2, 4)).otherwise(first)
        integral = F.regexp_extract(entry, r"(?i)(\d+(?:\.\d+)?)\s*H\b", 1).try_cast("double")
        count = F.coalesce(F.greatest(F.bround(integral, 0).cast("int"), F.lit(1)), F.lit(1))
        return F.when(first.isNull(), F.array().cast("array<double>")).otherwise(F.array_repeat(middle, count))

    return F.flatten(F.transform(entries, expand))


def carbon_shifts(c: Column) -> Column:
    """Shifts of a carbon peak list without its heading: nucleus, frequency, solvent."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)13C|NMR|\(\s*\d+\s*MHz[^)]*\)|\d+(?:\.\d+)?\s*MHz|CDCl3|DMSO-?d6|CD3OD|δ|ppm", " ")
    return numeric_shifts(bare)


def labelled_formula(c: Column) -> Column:
    """A formula after a label, else the first run that looks like one."""
    labelled = F.regexp_extract(c, r"(?i)(?:formula|molecular formula)\s*[:=：]?\s*([A-Z][A-Za-z0-9]*\d[A-Za-z0-9]*)", 1)
    bare = F.regexp_extract(c, r"\b(C\d+H\d+(?:[A-Z][a-z]?\d*)*)\b", 1)
    return F.coalesce(F.nullif(labelled, F.lit("")), F.nullif(bare, F.lit("")))


def line_kind(c: Column) -> Column:
    """What a line of a case gives: carbon, proton, formula or note."""
    return F.when(c.rlike(r"(?i)13\s*C|carbon"), "carbon").when(c.rlike(r"(?i)1\s*H\b|proton"), "proton").when(c.rlike(r"(?i)formula"), "formula").otherwise("note")


def answer(c: Column) -> Column:
    """What stands between answer tags, else after the word Answer; null for words that are no answer."""
    tagged = F.regexp_extract(c, r"(?is)<answer>\s*(.*?)\s*</answer>", 1)
    said = F.regexp_extract(c, r"(?im)^\s*(?:final\s+)?answer\s*:\s*(.+?)\s*$", 1)
    found = F.coalesce(F.nullif(tagged, F.lit("")), F.nullif(said, F.lit("")))
    return F.when(~F.lower(found).isin(*NO_ANSWER), found)


def structures_in(c: Column) -> Column:
    """Distinct quoted values of smiles keys, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r'"(?:canonical_)?smiles"\s*:\s*"([^"]+)"'), F.lit(1)))


def without_thoughts(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<think>.*?</think>", "")


def tool_call(c: Column) -> Column:
    """struct(thought, action, arguments): a tagged JSON call, or the lines of a reasoning step; arguments stay JSON text."""
    text = without_thoughts(c)
    tagged = F.regexp_extract(text, r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>", 1)
    line = lambda name: F.nullif(F.regexp_extract(text, rf"(?m)^\s*{name}\s*:\s*(.+?)\s*$", 1), F.lit(""))
    return F.struct(
        line("Thought").alias("thought"),
        F.coalesce(F.get_json_object(tagged, "$.name"), line("Action")).alias("action"),
        F.coalesce(F.get_json_object(tagged, "$.arguments"), F.nullif(F.regexp_extract(text, r"(?s)Action Input\s*:\s*(\{.*\})", 1), F.lit(""))).alias("arguments"),
    )


def embedded_json(c: Column) -> Column:
    """The text if it is a JSON object, else its outermost braces, else null."""
    whole, inner = F.trim(c), F.regexp_extract(c, r"(?s)\{.*\}", 0)
    valid = lambda x: F.try_parse_json(x).isNotNull() & x.startswith("{")
    return F.when(valid(whole), whole).when(valid(inner), inner)


def masked(c: Column, keep: int = 4) -> Column:
    """The ends of a secret; all of it if it is short."""
    return F.when(F.length(c) <= 2 * keep, "***").otherwise(F.concat(F.substring(c, 1, keep), F.lit("..."), F.right(c, F.lit(keep))))


def shortened(c: Column, n: int, mark: str = "...[truncated]") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def versioned_url(c: Column) -> Column:
    """An address that ends in /v1."""
    bare = F.regexp_replace(F.trim(c), "/+$", "")
    return F.when(bare.endswith("/v1"), bare).otherwise(F.concat(bare, F.lit("/v1")))


def slug(c: Column, n: int = 120) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "-"), 1, n)


def heading(line: Column) -> Column:
    """struct(level, title) of a heading line; level 0 for others."""
    marks = F.regexp_extract(line, r"^(#{1,6})\s+(.+?)\s*$", 1)
    return F.struct(F.length(marks).alias("level"), F.nullif(F.regexp_extract(line, r"^(#{1,6})\s+(.+?)\s*$", 2), F.lit("")).alias("title"))


def intent(c: Column, rules: list[tuple[str, str]], otherwise: str = "chat") -> Column:
    """The first intent whose pattern the text meets."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(F.lower(c).rlike(pattern), name).otherwise(out)
    return out


def structure_tokens(c: Column) -> Column:
    """Tokens of a structure string: brackets, two-letter elements, ring numbers, bonds, atoms."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[[^\]]+\]|Br|Cl|Si|Se|%\d{2}|@@|[A-Za-z]|\d|[=#\-+\\/:~.()$*]"), F.lit(0))
