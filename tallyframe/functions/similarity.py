"""Text normalisation and similarity scores, as Columns wherever Spark has the parts."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shipping import ship


def nfkc(c: Column) -> Column:
    """Unicode compatibility form; Spark has no such function, so texts go through Python's."""

    ship()

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return compose(c)


def normalise(c: Column, steps: Iterable[str]) -> Column:
    """The steps that are listed, always in this order: nfkc, strip, lower, collapse_ws, strip_punct."""
    steps = set(steps)
    if "nfkc" in steps:
        c = nfkc(c)
    if "strip" in steps:
        c = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    if "lower" in steps:
        c = F.lower(c)
    if "collapse_ws" in steps:
        c = F.regexp_replace(c, r"(?U)\s+", " ")
    if "strip_punct" in steps:
        c = F.regexp_replace(c, r"(?U)[^\w\s]", "")
    return c


#: Characters whose places fit the bits of one long, with room for a sum.
BITS = 62
FULL = (1 << BITS) - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def characters(c: Column) -> Column:
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


def bag(chars: Column) -> Column:
    """b0, b1: a bitmap of the characters, each numbered where it repeats.

    Every bit that differs between two texts is a character that differs, so the bits
    that differ are at most the sum of the lengths less twice what is in common.
    """

    def named(chars: Column) -> Column:
        repeats = lambda ch: F.size(F.filter(chars, lambda x: x == ch))
        return F.flatten(F.transform(F.array_distinct(chars), lambda ch: F.transform(F.sequence(F.lit(1), repeats(ch)), lambda i: F.xxhash64(ch, i))))

    def word(hashes: Column, w: int) -> Column:
        bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda bits, h: F.when(h.bitwiseAND(F.lit(1)) == w, bits.bitwiseOR(bit(h))).otherwise(bits))

    return let(let(chars, named), lambda hashes: F.named_struct(F.lit("b0"), word(hashes, 0), F.lit("b1"), word(hashes, 1)))


def may_reach(threshold: float, n: Column, m: Column, b: Column, c: Column) -> Column:
    """Necessary for ``ratio_of`` to reach the threshold: texts of n and m characters with the bitmaps b and c."""
    differ = F.bit_count(b["b0"].bitwiseXOR(c["b0"])) + F.bit_count(b["b1"].bitwiseXOR(c["b1"]))
    return (200 * F.least(n, m) >= threshold * (n + m)) & (100 * differ <= (100 - threshold) * (n + m) + 1e-6)


def prepared(c: Column) -> Column:
    """What ``common`` needs of one text: its length n, chars, and of at most ``BITS`` characters the places of each as bits."""

    def places(chars: Column, ch: Column) -> Column:
        bits = F.transform(chars, lambda x, i: F.when(x == ch, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda total, x: total + x)

    def parts(chars: Column) -> Column:
        masks = F.map_from_entries(F.transform(F.array_distinct(chars), lambda ch: F.struct(ch, places(chars, ch))))
        return F.struct(F.size(chars).alias("n"), chars.alias("chars"), F.when(F.size(chars) <= BITS, masks).alias("masks"))

    return let(characters(c), parts)


def _by_bits(masks: Column, chars: Column) -> Column:
    """Length of the longest common subsequence; the row of the usual table is the bits of a long, one step a character."""

    def step(row: Column, places: Column) -> Column:
        hit = row.bitwiseAND(places)
        return (row + hit).bitwiseAND(F.lit(FULL)).bitwiseOR(row - hit)

    found = F.transform(chars, lambda ch: F.coalesce(F.try_element_at(masks, ch), F.lit(0).cast("long")))
    return F.bit_count(F.aggregate(found, F.lit(FULL), step).bitwiseXOR(F.lit(FULL))).cast("long")


def _by_rows(a: Column, b: Column) -> Column:
    """The same for two arrays of characters of any length, by one row of the usual table at a time."""
    start = F.array_repeat(F.lit(0).cast("long"), F.size(b) + 1)

    def row(above: Column, ch: Column) -> Column:
        def cell(left: Column, j: Column) -> Column:
            hit = F.element_at(above, j) + 1
            miss = F.greatest(F.element_at(above, j + 1), F.element_at(left, -1))
            return F.concat(left, F.array(F.when(ch == F.element_at(b, j), hit).otherwise(miss)))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), F.array(F.lit(0).cast("long")), cell)

    return F.element_at(F.aggregate(a, start, row), -1)


def common(x: Column, y: Column) -> Column:
    """Length of the longest common subsequence of two ``prepared`` texts."""
    none = (x["n"] == 0) | (y["n"] == 0)
    by_bits = F.when(x["masks"].isNotNull(), _by_bits(x["masks"], y["chars"])).when(y["masks"].isNotNull(), _by_bits(y["masks"], x["chars"]))
    return F.when(none, F.lit(0).cast("long")).otherwise(F.coalesce(by_bits, F.when((x["n"] > BITS) & (y["n"] > BITS), _by_rows(x["chars"], y["chars"]))))


def ratio_of(x: Column, y: Column) -> Column:
    """200 * common / (sum of lengths) of two ``prepared`` texts; two empty texts are equal."""
    total = x["n"] + y["n"]
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * common(x, y) / F.nullif(total, F.lit(0)))


def ratio(a: Column, b: Column) -> Column:
    """``ratio_of`` two texts."""
    both = let(F.struct(prepared(a).alias("x"), prepared(b).alias("y")), lambda p: ratio_of(p["x"], p["y"]))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, F.lit(100.0)).otherwise(both))


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def sorted_tokens(c: Column, distinct: bool = False) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(_tokens(c)) if distinct else _tokens(c)), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(sorted_tokens(a), sorted_tokens(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """100 where one set of words holds the other and they meet; else the best of the joined differences."""
    x, y = F.array_distinct(_tokens(a)), F.array_distinct(_tokens(b))
    both = F.array_sort(F.array_intersect(x, y))
    only_x, only_y = F.array_sort(F.array_except(x, y)), F.array_sort(F.array_except(y, x))
    s = F.array_join(both, " ")
    dx, dy = F.array_join(only_x, " "), F.array_join(only_y, " ")
    full_x, full_y = F.concat_ws(" ", F.nullif(s, F.lit("")), dx), F.concat_ws(" ", F.nullif(s, F.lit("")), dy)
    best = ratio(full_x, full_y)
    alone = F.when(F.size(both) > 0, F.greatest(_prefix_ratio(s, full_x), _prefix_ratio(s, full_y))).otherwise(F.lit(0.0))
    subset = (F.size(both) > 0) & ((F.size(only_x) == 0) | (F.size(only_y) == 0))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).when(subset, F.lit(100.0)).otherwise(F.greatest(best, alone))


def _prefix_ratio(prefix: Column, whole: Column) -> Column:
    return F.lit(200.0) * F.length(prefix) / F.nullif(F.length(prefix) + F.length(whole), F.lit(0))


def _lcs(a: str, b: str) -> int:
    """As ``_by_bits``, in one integer of any length."""
    full = (1 << len(a)) - 1
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) & full) | (row - hit)
    return (row ^ full).bit_count()


def best_window(a: str, b: str) -> float:
    """The best ratio of the shorter text with any stretch of the longer that is as long, or cut off by an end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    windows = {b[max(0, i) : i + len(a)] for i in range(1 - len(a), len(b))}
    return max(200.0 * _lcs(a, w) / (len(a) + len(w)) for w in windows)


def partial_ratio(a: Column, b: Column) -> Column:
    ship()

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else best_window(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return score(a, b)


SCORERS = {"ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio}
#: The text of a key whose characters ``ratio_of`` compares; token_set_ratio does so where no word is shared.
COMPARED = {"ratio": lambda c: c, "partial_ratio": lambda c: c, "token_sort_ratio": sorted_tokens, "token_set_ratio": lambda c: sorted_tokens(c, distinct=True)}


def known(name: str) -> str:
    """The scorer's name; an unknown one is token_sort_ratio."""
    return name if name in SCORERS else "token_sort_ratio"


def words_of(c: Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(_tokens(c))
