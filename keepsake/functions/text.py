"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.schema import SHINGLE, SHORT_SHINGLE


#: Word edges and white space as RE2 has them: Java's own edges follow Unicode.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def as_re2(pattern: str) -> str:
    r"""A pattern in RE2's spelling as Java has to have it for the same matches.

    Java's \b follows Unicode where RE2's edges are ASCII's; its \s has the vertical tab, which RE2's lacks; its (?i) folds
    ASCII alone, where RE2 folds all letters; and its $ also stands before a last line feed.
    """
    out, inside, at = [], False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two[0] == "\\":
            out.append({r"\b": EDGE, r"\s": r"\t\n\f\r " if inside else r"[\t\n\f\r ]"}.get(two, two))
            at += 2
            continue
        inside = two[0] == "[" or (inside and two[0] != "]")
        out.append(r"\z" if two[0] == "$" and not inside else two[0])
        at += 1
    return "".join(out).replace("(?i)", "(?iu)")


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once even where ``use`` names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_space(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalised(text: Column) -> Column:
    """Lower case; letters, digits and single spaces only."""
    kept = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}\s]+", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def tokens(text: Column) -> Column:
    """Words of the normalised text, that is its runs of letters and digits; none for an empty one."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def folded(text: Column) -> Column:
    """Without diacritics, as a full-text index keeps its words: marks are parted from their letters and dropped."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
        return texts.map(lambda t: t if t is None or t.isascii() else plain(t))

    return run(text)


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def shingles(words: Column, n: int = SHINGLE, least: int = SHORT_SHINGLE) -> Column:
    """Runs of n words; a text of ``least`` to n-1 words is one shingle, a shorter one has none."""

    def of(w):
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) < least, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))

    # inside a lambda the words are computed once, not once a run
    return F.get(F.transform(F.array(words), of), F.lit(0))


def shingle_hashes(words: Column, n: int = SHINGLE, least: int = SHORT_SHINGLE) -> Column:
    """Hashes of the same runs as ``shingles``: a fold of the words' hashes, so that no run is built as text."""

    def of(h):
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, n)))
        return F.when(F.size(h) < least, F.array().cast("array<bigint>")).otherwise(F.array_distinct(runs))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4).cast("long")


def luhn_valid(digits: Column) -> Column:
    """Of a string of digits: 13 to 19 of them with a checksum of 0 modulo 10."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0)))
    return F.length(digits).between(13, 19) & (F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0)


def cut_bytes(text: Column, most: int, mark: str = "") -> Column:
    """A text of more than ``most`` bytes, cut to whole characters that fit them, with ``mark`` after it."""
    raw = text.cast("binary")

    def at(k):
        # a byte 10xxxxxx goes on with a character: step back to where one begins
        begins = lambda i: (F.conv(F.hex(F.substring(raw, i + 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0xC0))) != 0x80
        return F.when(begins(F.lit(k)), k).when(begins(F.lit(k - 1)), k - 1).when(begins(F.lit(k - 2)), k - 2).otherwise(k - 3)

    head = F.decode(F.substr(raw, F.lit(1), at(most).cast("int")), "UTF-8")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(head, F.lit(mark)))


def one_line(text: Column, most: int) -> Column:
    """White space collapsed; beyond ``most`` bytes, cut one short of them and marked."""
    line = trim_space(F.regexp_replace(text, r"(?U)\s+", " "))
    return let(line, lambda x: F.when(F.octet_length(x) <= most, x).otherwise(F.concat(cut_bytes(x, most - 1), F.lit("…"))))


def title_line(text: Column) -> Column:
    """The first clause of a claim (if its mark stands after the twelfth byte), in 72 bytes."""

    def of(line):
        head = F.regexp_extract(line, r"^[^.;]*", 0)
        return one_line(F.when((F.octet_length(head) > 12) & (F.length(head) < F.length(line)), head).otherwise(line), 72)

    return let(trim_space(F.regexp_replace(text, r"(?U)\s+", " ")), of)


def short_id(claim: Column) -> Column:
    return F.substring(claim.cast("string"), 1, 8)


def ago(then: Column, now: Column) -> Column:
    """now, minutes, hours below two days, days below sixty, else the date; - for none."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    said = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(then.isNull(), "-").when(s < 60, "now").when(s < 3600, said(60, "m")).when(s < 48 * 3600, said(3600, "h")).when(s < 60 * 86400, said(86400, "d")).otherwise(F.date_format(then, "yyyy-MM-dd"))


def badge(status: Column) -> Column:
    return F.when(status.isin("quarantined", "superseded", "tombstoned", "aging"), F.concat(F.lit(" ["), status, F.lit("]"))).otherwise("")


def share_held(words: Column, held: Column | list[str]) -> Column:
    """The share of words (with repeats) that a set holds; 0 without words. Words of a list are found by their hash, in a column each is compared with all."""
    known = lambda w: w.isin(held) if isinstance(held, list) else F.array_contains(held, w)
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, known)) / F.size(words))


def covered_by(content: Column, held: Column | list[str]) -> Column:
    """Whether four fifths of a claim's words stand in a file's word set already."""
    some = F.lit(len(held) > 0) if isinstance(held, list) else F.size(held) > 0
    return let(tokens(content), lambda w: some & (F.size(w) > 0) & (share_held(w, held) >= 0.8))


def normalised_imperative(text: Column) -> Column:
    """What a user tells themselves, as a preference: one full stop at the end."""
    return F.concat(F.lit("Preference (user-stated): "), trim_space(F.regexp_replace(trim_space(text), r"\.\z", "")), F.lit("."))


def clean_aliases(aliases: Column, canonical: Column) -> Column:
    """Trimmed, sorted, each once whatever its case (the first spelling), without blanks and the name itself."""
    trimmed = F.transform(aliases, trim_space)

    def of(all_):
        first = F.filter(all_, lambda a, i: (a != "") & (F.lower(a) != F.lower(trim_space(canonical))) & (F.array_position(F.transform(all_, F.lower), F.lower(a)) == i + 1))
        return F.array_sort(first)

    return let(trimmed, of)


def entropy(text: Column) -> Column:
    """Bits a byte of an ASCII text."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")

    def of(cs):
        counts = F.transform(F.array_distinct(cs), lambda c: F.size(F.filter(cs, lambda d: d == c)) / F.size(cs))
        return F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return let(letters, of)


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def parse_since(text: str) -> timedelta:
    """``30d``, ``2w`` or hours, minutes and seconds as ``1h30m``; nothing is no time."""
    text = text.strip()
    if not text:
        return timedelta(0)
    if m := re.fullmatch(r"([+-]?[0-9]*\.?[0-9]+)([dw])", text):
        return timedelta(days=float(m[1]) * (7 if m[2] == "w" else 1))
    if not re.fullmatch(r"[+-]?(?:[0-9]*\.?[0-9]+(?:ns|us|µs|ms|s|m|h))+", text):
        raise ValueError(f"bad duration {text!r} (want e.g. 30d, 2w, 12h)")
    seconds = sum(float(n) * _UNITS[u] for n, u in re.findall(r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|s|m|h)", text))
    return timedelta(seconds=-seconds if text[0] == "-" else seconds)
