"""Text, digest and confidence scalars as column expressions, with Arrow functions where Spark has no built-in."""

from __future__ import annotations

import math
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.matching import shared

#: Fixed value: the characters that count as white space, as Python's str.isspace has them.
WHITE = r"[\x09-\x0D\x1C-\x20\x85\xA0  -     　]"
#: Fixed value: code points of CJK scripts and punctuation.
CJK = r"[\x{2E80}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]"
PLAIN = r"^[\x00-\x7F]*$"
NUMBERED = r"^\p{Nd}+[.．)）]$"
DIGEST = "^[0-9a-f]{64}$"
COLOR = "^#[0-9a-f]{6}$"
ASSET_PATH = r"^assets/sha256-[0-9a-f]{64}\.[a-z0-9]+$"
NARROW = 0.55
LANGUAGE = "^[A-Za-z0-9_]+$"
#: Cells of a cost table that is kept whole: 2 bits each.
TABLE_BITS = 1 << 27


@F.arrow_udf(T.StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Compatibility composition. ASCII stays in the JVM: only other values go to Python."""
    plain = text.rlike(PLAIN)
    return F.when(plain | text.isNull(), text).otherwise(_nfkc(F.when(~plain, text)))


def spaced(text: Column, normal: bool = True) -> Column:
    """Normalised text with single spaces inside and none at the ends."""
    text = nfkc(text) if normal else text
    return F.trim(F.regexp_replace(text, WHITE + "+", " "))


def compact(text: Column, normal: bool = True) -> Column:
    """Normalised text without white space."""
    text = nfkc(text) if normal else text
    return F.regexp_replace(text, WHITE + "+", "")


def accuracy(expected: Column, observed: Column) -> Column:
    """100 * (1 - edit distance / longer length) of compacted texts, not below 0; 100 if both are empty."""
    longer = F.greatest(F.length(expected), F.length(observed))
    distance = F.levenshtein(expected, observed)
    return F.when(longer == 0, 100.0).otherwise(F.round(F.greatest(F.lit(0.0), 100 * (1 - distance / longer)), 6))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance; a row of the cost table is two whole numbers of a bit for each character."""
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[start:], b[start:]
    end = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, distance = full, 0, len(a)
    for c in b:
        same = where.get(c, 0)
        level = (((same & up) + up) ^ up) | same | down
        above, below = (down | ~(level | up)) & full, level & up
        distance += (above & top > 0) - (below & top > 0)
        above, below = above << 1 | 1, below << 1
        up, down = (below | ~(level | above)) & full, above & level & full
    return distance


@F.arrow_udf(T.LongType())
def long_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64())


def whole_accuracy(expected: Column, observed: Column, long: int = 2000) -> Column:
    """accuracy() of whole documents: texts of over ``long`` characters are compared by edit_distance(), whose work grows with a 64th."""
    size = F.greatest(F.length(expected), F.length(observed))
    wide = size > long
    distance = F.when(wide, long_distance(F.when(wide, expected), F.when(wide, observed))).otherwise(F.levenshtein(F.when(~wide, expected), F.when(~wide, observed)))
    return F.when(size == 0, 100.0).otherwise(F.round(F.greatest(F.lit(0.0), 100 * (1 - distance / size)), 6))


@F.arrow_udf(T.DoubleType())
def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Twice the matched characters over all, matching longest blocks first; 1 if both are empty, null for null."""
    pairs = list(zip(a.to_pylist(), b.to_pylist()))
    known = [p for p in pairs if None not in p]
    told = iter([2.0 * n / (len(x) + len(y)) if x or y else 1.0 for n, (x, y) in zip(shared(known).tolist(), known)])
    return pa.array([None if None in p else next(told) for p in pairs], pa.float64())


def ratio_bound(a: Column, b: Column) -> Column:
    """An upper bound of ratio() from lengths alone."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / total)


def edit_runs(expected: str, observed: str) -> tuple[list[str], list[str]]:
    """Runs of characters that are missing from and extra in the observed text, along a shortest edit script.

    Equal characters and substitutions are preferred to deletions, and deletions to insertions, going back from the end.
    Rows of the cost table are bits of whole numbers, and beyond ``TABLE_BITS`` memory grows with the root of their number.
    """
    n, m = len(expected), len(observed)
    step = max(1, n if n * m <= TABLE_BITS else math.isqrt(n))
    full = (1 << m) - 1
    where: dict[str, int] = {}
    for j, c in enumerate(observed):
        where[c] = where.get(c, 0) | 1 << j

    def rows(first: int, state: tuple[int, int], keep: bool) -> tuple[tuple[int, int], list[tuple[int, int]]]:
        """The cost table's rows after ``first``, a bit for each observed character: where a cost equals the one before in
        both texts, and where it is above the one before in the expected text. state: where costs rise and fall in a row."""
        up, down = state
        held = []
        for c in expected[first : first + step]:
            same = where.get(c, 0)
            level = ((((same & up) + up) ^ up) | same | down) & full
            above, below = down | (full ^ (level | up)), level & up
            if keep:
                held.append((level, above))
            above = (above << 1 | 1) & full
            up, down = (below << 1 & full) | (full ^ (level | above)), above & level
        return (up, down), held

    starts = [(full, 0)]  # every step-th row; the others are made again where the way back needs them
    for first in range(0, n - step, step):
        starts.append(rows(first, starts[-1], False)[0])
    known, held = -1, []
    missing, extra, i, j = [], [], n, m
    open_runs: set[int] = set()  # runs that the next character before them would lengthen
    while i or j:
        before = i
        while i and j and expected[i - 1] == observed[j - 1]:
            i, j = i - 1, j - 1
        if i != before:
            open_runs.clear()
            continue
        if i and (i - 1) // step != known:
            known = (i - 1) // step
            held = rows(known * step, starts[known], True)[1]
        level, above = held[(i - 1) % step] if i else (0, 0)
        if i and j and not level >> (j - 1) & 1:
            i, j = i - 1, j - 1
            steps = [(missing, expected[i]), (extra, observed[j])]
        elif i and (not j or above >> (j - 1) & 1):
            i -= 1
            steps = [(missing, expected[i])]
        else:
            j -= 1
            steps = [(extra, observed[j])]
        for runs, character in steps:
            if id(runs) in open_runs:
                runs[-1] = character + runs[-1]
            else:
                runs.append(character)
                open_runs.add(id(runs))
    return missing[::-1], extra[::-1]


@F.arrow_udf(T.StructType([T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("extra", T.ArrayType(T.StringType()))]))
def text_differences(expected: pa.Array, observed: pa.Array) -> pa.Array:
    rows = []
    for x, y in zip(expected.to_pylist(), observed.to_pylist()):
        missing, extra = edit_runs(x or "", y or "")
        rows.append({"missing": missing, "extra": extra})
    strings = pa.list_(pa.string())
    return pa.array(rows, pa.struct([("missing", strings), ("extra", strings)]))


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def is_word(character: Column) -> Column:
    return character.rlike(r"^[\p{L}\p{N}]$")


def is_numbered(text: Column) -> Column:
    """Digits and a closing mark, such as 12. or 3)."""
    return F.trim(text).rlike(NUMBERED)


def ends(text: Column) -> tuple[Column, Column]:
    """First and last character that isn't white space; null if there is none."""
    bare = compact(text, normal=False)
    some = F.length(bare) > 0
    return F.when(some, F.substring(bare, 1, 1)), F.when(some, F.substring(bare, -1, 1))


def needs_space(previous: Column, current: Column) -> Column:
    """Two fragments of a line are words of their own: no CJK at the seam, or a number such as 12. before."""
    (_, last), (first, _) = ends(previous), ends(current)
    words = is_word(last) & is_word(first) & ~has_cjk(last) & ~has_cjk(first)
    return F.coalesce(F.when(is_numbered(previous), is_word(first)).otherwise(words), F.lit(False))


def advance(text: Column) -> Column:
    """Width in font sizes: 1 for a CJK character, 0.55 for another, nothing for white space."""
    bare = compact(text, normal=False)
    narrow = F.length(F.regexp_replace(bare, CJK, ""))
    return (F.length(bare) - narrow) + narrow * NARROW


def confidence(raw: Column) -> Column:
    """An engine's 0..100 value as 0..1; null if negative, not a number or infinite. Over 100 stays over 1, for checks."""
    value = raw.try_cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf")), value / 100)


def least_confidence(detection: Column, recognition: Column, overall: Column) -> Column:
    return F.coalesce(F.least(F.coalesce(detection, overall), recognition), F.coalesce(detection, overall), F.lit(0.0))


def json_digest(*fields: tuple[str, Column]) -> Column:
    """SHA-256 of a JSON object with its keys in order and without spaces."""
    row = F.struct(*[value.alias(name) for name, value in sorted(fields, key=lambda f: f[0])])
    return F.sha2(F.to_json(row), 256)


def minted(prefix: str, number: Column, width: int = 4) -> Column:
    return F.format_string(f"{prefix}%0{width}d", number)


def languages_ok(languages: Column) -> Column:
    return (F.size(languages) > 0) & (F.size(languages) == F.size(F.array_distinct(languages))) & F.forall(languages, lambda x: x.rlike(LANGUAGE))


def font_size(height: Column) -> Column:
    return F.greatest(F.lit(1.0), F.round(height * 0.8, 6))


def stroke_width(thickness: Column) -> Column:
    return F.greatest(F.lit(0.25), thickness)
