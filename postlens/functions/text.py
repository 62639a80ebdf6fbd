"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import FAMILIAR_TOOLS, NON_PRODUCT_HOSTS

#: White space beyond ASCII, one for one.
_WIDE = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
URL = r"(?i)\bhttps?://[^\s<>()\"']+"


def spaces(x: Column) -> Column:
    """Every kind of space that is not ASCII becomes a plain space."""
    return F.translate(x, _WIDE, " " * len(_WIDE))


def ascii_shadow(x: Column) -> Column:
    """Letters, digits and marks beyond ASCII become one symbol each, so that \\b and \\w are ASCII's."""
    return F.regexp_replace(x, r"[\p{L}\p{N}\p{M}&&[^\x00-\x7F]]", "¤")


def normalize_whitespace(x: Column) -> Column:
    return F.trim(F.regexp_replace(spaces(x), r"\s+", " "))


def trim_all(x: Column) -> Column:
    return F.regexp_replace(spaces(x), r"\A\s+|\s+\z", "")


def split_sentences(x: Column) -> Column:
    parts = F.transform(F.split(x, r"(?<=[.!?])\s+|\n+"), trim_all)
    return F.filter(parts, lambda s: s != "")


def count_matches(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


def extract_urls(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?)]+\z", ""))


def host_of(url: Column) -> Column:
    """Host in lower case without a leading www.; null if the text is no web address."""
    host = F.regexp_extract(url, r"(?i)\A\s*https?:[/\\]*(?:[^/?#\\@]*@)?([^/?#:\\]+)", 1)
    host = F.regexp_replace(F.lower(host), r"\Awww\.", "")
    return F.when(host.rlike(r"\A[^\s%<>\[\]^|]+\z"), host)


def host_label(host: Column) -> Column:
    """The second-level label, or the third before co, com, org or net."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    second = F.try_element_at(parts, F.lit(-2))
    third = F.try_element_at(parts, F.lit(-3))
    return F.when(n < 2, F.element_at(parts, 1)).when(second.isin("co", "com", "org", "net") & (n >= 3), third).otherwise(second)


def first_label(host: Column) -> Column:
    return F.split_part(host, F.lit("."), F.lit(1))


def is_product_host(host: Column) -> Column:
    return host.isNotNull() & ~host.isin(NON_PRODUCT_HOSTS) & ~F.endswith(host, F.lit(".reddit.com"))


def is_familiar(name: Column) -> Column:
    return F.lower(name).isin([t.lower() for t in FAMILIAR_TOOLS])


def literal(name: Column) -> Column:
    """A pattern that matches name itself."""
    return F.regexp_replace(name, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def mentions(x: Column, name: Column) -> Column:
    return F.regexp_like(x, F.concat(F.lit(r"(?i)\b"), literal(name), F.lit(r"\b")))


def first_match(text: Column, shadow: Column, pattern: str, size: int = 80) -> Column:
    at = F.regexp_instr(shadow, F.lit(pattern))
    found = F.substr(text, at, F.length(F.regexp_extract(shadow, pattern, 0)))
    return F.when(at > 0, F.left(normalize_whitespace(found), F.lit(size)))


def position(shadow: Column, pattern: str | Column) -> Column:
    """Where the first match begins as a share of the text; -1 if there is none."""
    at = F.regexp_instr(shadow, F.lit(pattern) if isinstance(pattern, str) else pattern)
    return F.when(at > 0, (at - 1) / F.greatest(F.lit(1), F.length(shadow))).otherwise(F.lit(-1.0))


def last_position(shadow: Column, pattern: str) -> Column:
    last = F.try_element_at(F.regexp_extract_all(shadow, F.lit(pattern), F.lit(0)), F.lit(-1))
    rest = F.element_at(F.split(shadow, pattern, -1), -1)
    return F.when(last.isNull(), F.lit(-1.0)).otherwise((F.length(shadow) - F.length(rest) - F.length(last)) / F.greatest(F.lit(1), F.length(shadow)))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def ascii_words(x: Column) -> Column:
    """Distinct lower-case words of three or more ASCII word characters."""
    return F.array_distinct(F.filter(F.split(F.lower(x), r"[^a-z0-9_]+"), lambda w: F.length(w) > 2))


def unicode_words(x: Column) -> Column:
    plain = F.regexp_replace(F.lower(normalize_whitespace(x)), r"[^\p{L}\p{N}\s]", " ")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) > 2))


def fnv_hash(x: Column) -> Column:
    """Two 32-bit FNV-1a passes over UTF-16 units, as 16 hexadecimal digits."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(x, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("long"))

    def run(seed: int) -> Column:
        folded = F.aggregate(units, F.lit(seed).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.lpad(F.lower(F.hex(folded)), 8, "0")

    return F.concat(run(0x811C9DC5), run(0x9747B28C))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def days_ago(created: Column, as_of: Column) -> Column:
    days = F.greatest(F.lit(0), round_half_up((as_of - created) / 86400.0))
    return F.when(days == 0, "today").when(days == 1, "1 day ago").when(days < 60, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.concat(round_half_up(days / 30).cast("string"), F.lit(" months ago")))


def normalize_for_match(x: Column) -> Column:
    plain = F.translate(F.lower(x), "‘’‚‛“”„‟–—", "''''\"\"\"\"--")
    return normalize_whitespace(plain)


def sanitize_note(x: Column, size: int = 160) -> Column:
    return F.left(F.trim(F.regexp_replace(x, r"(?i)\b(scam(?:mer)?|liar|lying|fraud|shill|astroturf(?:ing)?)\b", "promotional")), F.lit(size))


def score_label(score: Column) -> Column:
    return (
        F.when(score <= 19, "Unlikely promotional")
        .when(score <= 39, "Some promotional characteristics")
        .when(score <= 59, "Possibly promotional")
        .when(score <= 79, "Likely promotional")
        .otherwise("Highly likely promotional")
    )


def disclosure_label(x: Column) -> Column:
    return F.when(x == "clear", "Connection disclosed by author").when(x == "unclear", "Connection mentioned but unclear").when(x == "missing", "Connection not disclosed").when(x == "unknown", "No connection to disclose detected")


def confidence_label(x: Column) -> Column:
    return F.concat(F.initcap(x), F.lit(" confidence"))


def ring_state(score: Column, disclosure: Column) -> Column:
    return F.when(score < 40, "green").when(disclosure == "clear", "blue").when(score < 60, "amber").otherwise("red")


def origin_allowed(origin: Column, allowed: list[str]) -> Column:
    """Whether origin is in a list whose entries may hold * for anything but a slash."""
    import re

    return origin.rlike(r"\A(?:" + "|".join("[^/]*".join(map(re.escape, a.split("*"))) for a in allowed) + r")\z") if allowed else F.lit(False)
