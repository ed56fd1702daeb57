"""String measures and formats as columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from gridspark.schemas import RESPONSE

# Cell texts that mean nothing is there.
PLACEHOLDERS = ("", "..", "-", "n/a", "—", "na", "n.a.")
# Characters that recognition takes for one another.
CONFUSABLE = {
    "0": "OoD", "O": "0oD", "o": "0O", "1": "lI|i", "l": "1I|i", "I": "1l|i", "5": "Ss", "S": "5s", "s": "5S", "8": "B&",
    "B": "8", "2": "Zz", "Z": "2", "6": "Gb", "G": "6", "9": "gq", "g": "9q", "q": "9g",
}
_PAIRS = sorted({p for a, bs in CONFUSABLE.items() for b in bs for p in (a + b, b + a)})

#: Python's white space for str.strip and str.split.
WHITE = r"[\s\x1c-\x1f\x85\xa0]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", "")


def strip_fence(text: Column) -> Column:
    """The inside of a fenced block: from the line after the first fence to before the last one; other text as it is."""
    t = strip(text)
    after = F.substring(t, F.instr(t, "```") + 3, F.length(t))
    line = F.instr(after, "\n")
    inside = F.when(line > 0, F.substring(after, line + 1, F.length(after))).otherwise(after)
    tail = F.instr(F.reverse(inside), "```")
    cut = F.when(tail > 0, F.regexp_replace(F.substring(inside, F.lit(1), F.length(inside) - tail - 2), rf"{WHITE}+$", "")).otherwise(inside)
    return F.when(F.contains(t, F.lit("```")), cut).otherwise(t)


def parse_response(text: Column) -> Column:
    """A model's answer as a struct, null where it is no JSON object."""
    body = strip_fence(text)
    return F.when((F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1) & F.startswith(body, F.lit("{")), F.from_json(body, RESPONSE))


def is_placeholder(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin(*PLACEHOLDERS), F.lit(True))


def _distance(a: Sequence, b: Sequence) -> int:
    """The edit distance of two sequences; a whole line of its table at a time, as the bits of one integer (Myers, Hyyrö)."""
    start, m, n = 0, len(a), len(b)
    while start < min(m, n) and a[start] == b[start]:
        start += 1
    while min(m, n) > start and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b = (a[start:m], b[start:n]) if m <= n else (b[start:n], a[start:m])
    same = {x: bytearray(len(b) // 8 + 1) for x in set(a)}
    for i, x in enumerate(b):
        if x in same:
            same[x][i >> 3] |= 1 << (i & 7)
    same = {x: int.from_bytes(bits, "little") for x, bits in same.items()}
    every = (1 << len(b)) - 1
    up, down = every, 0  # where the line grows, and falls, from one place of b to the next
    for x in a:
        eq = same[x] | down
        level = ((((eq & up) + up) ^ up) | eq) & every
        fell, grew = up & level, ((down | (every ^ (up | level))) << 1 | 1) & every
        up, down = (fell << 1 | (every ^ (grew | level))) & every, grew & level
    return len(a) + up.bit_count() - down.bit_count()


@F.pandas_udf(LongType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """The edit distance of two texts or two arrays of any length; ``levenshtein`` goes cell by cell and takes no arrays."""
    return pd.Series([None if x is None or y is None else _distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def cer(predicted: Column, truth: Column, distance: Callable[[Column, Column], Column] = F.levenshtein) -> Column:
    """Character error rate; may exceed 1. An empty truth gives 0 for an empty prediction, else 1.

    ``distance`` is for texts that are long enough for :func:`edit_distance`.
    """
    p, t = F.coalesce(predicted, F.lit("")), F.coalesce(truth, F.lit(""))
    return F.when(t == "", F.when(p == "", 0.0).otherwise(1.0)).otherwise(distance(p, t) / F.length(t))


def _spaced(words: Column) -> Column:
    return F.array_join(words, " ")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"{WHITE}+"), lambda x: x != "")


def wer_char(predicted: Column, truth: Column, distance: Callable[[Column, Column], Column] = F.levenshtein) -> Column:
    """The error rate of the space-normalised texts, counted in characters."""
    return cer(_spaced(words(predicted)), _spaced(words(truth)), distance)


def wer_word(predicted: Column, truth: Column) -> Column:
    """The word error rate proper: edit distance of the word sequences over the words of the truth."""
    a, b = words(predicted), words(truth)
    return F.when(F.size(b) == 0, F.when(F.size(a) == 0, 0.0).otherwise(1.0)).otherwise(edit_distance(a, b) / F.size(b))


def _folded(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit(" "), F.lit("")))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all, by the longest-matching-block rule; no built-in function has it."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def confusable_pair(a: Column, b: Column) -> Column:
    return F.concat(a, b).isin(_PAIRS) | F.concat(F.upper(a), F.upper(b)).isin(_PAIRS)


def confusable_share(a: Column, b: Column) -> Column:
    """Of the positions where two equally long strings differ, the share of pairs easily taken for one another; else null."""
    x, y = F.split(a, ""), F.split(b, "")
    kinds = F.zip_with(x, y, lambda c, d: F.when(c != d, F.when(confusable_pair(c, d), 1).otherwise(0)))
    apart = F.filter(kinds, lambda k: k.isNotNull())
    return F.when(F.length(a) == F.length(b), F.try_divide(F.aggregate(apart, F.lit(0), lambda s, k: s + k), F.size(apart)))


def boosted(ratio: Column, a: Column, b: Column) -> Column:
    """``ratio`` of folded strings, raised half-way to 1 by the confusable share of their differences."""
    share = confusable_share(a, b)
    return F.when(share.isNull(), ratio).otherwise(F.least(F.lit(1.0), ratio + (1.0 - ratio) * share * 0.5))


def similarity(a: Column, b: Column) -> Column:
    """0 for an empty side, 1 for strings equal but for case and spaces, else the boosted sequence ratio."""
    x, y = _folded(a), _folded(b)
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).when(x == y, 1.0).otherwise(boosted(sequence_ratio(x, y), x, y))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.70, "medium").otherwise("low")


def sheet_name(name: Column) -> Column:
    return F.when(F.length(name) > 31, F.concat(F.substring(name, 1, 28), F.lit("..."))).otherwise(name)


def html_escape(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def retryable(error: Column) -> Column:
    """Errors after which another attempt is worth it."""
    low = F.lower(error)
    found = [F.contains(error, F.lit(code)) for code in ("500", "503", "429")]
    found += [F.contains(low, F.lit(words)) for words in ("internal error", "timeout", "deadline exceeded")]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return F.coalesce(out, F.lit(False))


def backoff_seconds(attempt: Column, error: Column, attempts: Column) -> Column:
    """Seconds to wait after the attempt (from 0); null where no other attempt follows."""
    return F.when(retryable(error) & (attempt < attempts - 1), F.least(F.pow(F.lit(2.0), attempt), F.lit(10.0)))


def provider(provider: Column, model: Column) -> Column:
    return F.when((provider == "google") | F.contains(F.lower(model), F.lit("gemini")), "google").otherwise("openai")


def cost_usd(tokens_in: Column, tokens_out: Column, model: Column) -> Column:
    """Fixed price tiers in dollars for a million tokens, the first whose name the model holds."""
    low = F.lower(model)
    tiers = (("2.5", 0.0, 0.0), ("3.0-pro", 1.25, 5.0), ("3-pro", 1.25, 5.0), ("gpt-4o", 2.5, 10.0), ("flash", 0.075, 0.3))
    price_in, price_out = F.lit(1.0), F.lit(3.0)
    for name, i, o in reversed(tiers):
        price_in, price_out = F.when(F.contains(low, F.lit(name)), i).otherwise(price_in), F.when(F.contains(low, F.lit(name)), o).otherwise(price_out)
    return tokens_in / 1_000_000 * price_in + tokens_out / 1_000_000 * price_out


def estimated_tokens(prompt: Column, answer: Column) -> tuple[Column, Column]:
    """What a call is counted as when the provider does not say: a token for four characters, and 1000 for the image."""
    return F.floor(F.length(prompt) / 4) + 1000, F.floor(F.length(answer) / 4)


def page_indices(text: Column) -> Column:
    """``"0,2-5,10"`` -> array of page numbers in order, repeats kept; null where it is malformed."""
    good = F.regexp_like(text, F.lit(r"^\s*\d+\s*(-\s*\d+\s*)?(,\s*\d+\s*(-\s*\d+\s*)?)*$"))
    parts = F.transform(F.split(text, ","), lambda p: F.transform(F.split(p, "-"), lambda x: F.trim(x).cast("int")))
    ends = F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0)).alias("a"), F.element_at(p, -1).alias("b")))
    rising = F.forall(ends, lambda e: e["a"] <= e["b"])
    return F.when(good, F.when(rising, F.flatten(F.transform(ends, lambda e: F.sequence(e["a"], F.greatest(e["a"], e["b"]))))))


def sha256_of_map(config: Column) -> Column:
    """A digest of a string map that does not depend on the order of its entries."""
    entries = F.array_sort(F.map_entries(config))
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "\n"), 256)
