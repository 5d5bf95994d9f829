"""Column functions over text: normal forms, tokens, references, display strings."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[0-9]{1,4}[/-][0-9]{4}[/-]qh[0-9]+|\p{Nd}+[a-z]?|[\p{L}\p{Nl}\p{No}]+"
DOCUMENT_NUMBER = r"(?iU)\b([0-9]{1,4})\s*[/-]\s*([0-9]{4})\s*[/-]\s*QH\s*([0-9]+)\b"
PAGE_NUMBER = r"(?iU)^\s*(?:[-–—]\s*[0-9]{1,4}\s*[-–—]|(?:trang|page)\s+[0-9]{1,4}(?:\s*/\s*[0-9]{1,4})?)\s*$"


#: What composition may change: marks, and letters that have another form of their own.
COMPOSABLE = r"[\p{M}\x{340}\x{341}\x{37E}\x{387}\x{1F71}-\x{1FFD}\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]"


@cache
def compositions() -> tuple[str, str, str]:
    """From Unicode's tables: letters and the letters they stand for, then pairs (what is composed, into what), those with the fewest marks first."""
    single, pairs = [], []
    for c in map(chr, range(0xA0, 0x2FA20)):
        if not unicodedata.decomposition(c) or unicodedata.decomposition(c).startswith("<"):
            continue
        whole, parts = unicodedata.normalize("NFC", c), unicodedata.normalize("NFD", c)
        if whole != c:
            if len(whole) == 1:
                single.append((c, whole))
            else:
                pairs.append((0, c, whole))
            continue
        for k in range(1, len(parts)):
            # marks may come in any order
            rest = unicodedata.normalize("NFC", parts[:k] + parts[k + 1 :])
            if len(rest) == 1 and unicodedata.normalize("NFC", rest + parts[k]) == c:
                pairs.append((len(parts), rest + parts[k], c))
    return "".join(x for x, _ in single), "".join(y for _, y in single), "\ue000".join(f"{x}\ue001{y}" for _, x, y in sorted(pairs))


def nfc(text: Column) -> Column:
    """Unicode composition, for which Spark has no function: one replacement for each pair, in texts that have anything to compose.

    Marks that compose with nothing keep their order, and Hangul letters stay apart.
    """
    letters, stand_for, pairs = compositions()
    both = F.split(F.lit(pairs), "\ue000")
    one = lambda t, p: F.replace(t, F.substring_index(p, "\ue001", 1), F.substring_index(p, "\ue001", -1))
    return F.when(F.rlike(text, F.lit(COMPOSABLE)), F.aggregate(both, F.translate(text, letters, stand_for), one)).otherwise(text)


def line_form(text: Column) -> Column:
    """Inner white space as one space, ends stripped, line breaks kept."""
    plain = F.translate(F.replace(text, F.lit("​"), F.lit("")), " \r", " \n")
    return F.array_join(F.transform(F.split(plain, "\n"), lambda p: F.regexp_replace(F.regexp_replace(p, r"[ \t\f\x0B]+", " "), r"(?U)^\s+|\s+$", "")), "\n")


def folded(text: Column) -> Column:
    """White space as single spaces, ends stripped; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def search_form(text: Column) -> Column:
    """Composed, in lower case, white space folded; null as empty."""
    return folded(F.lower(nfc(text)))


def is_page_number(line: Column) -> Column:
    return F.rlike(line, F.lit(PAGE_NUMBER))


def tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(nfc(F.coalesce(text, F.lit("")))), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.replace(t, F.lit("-"), F.lit("/")))


def extracted(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null."""
    return F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def document_number(text: Column) -> Column:
    parts = [F.regexp_extract(text, DOCUMENT_NUMBER, k) for k in (1, 2, 3)]
    return F.when(F.rlike(text, F.lit(DOCUMENT_NUMBER)), F.concat(parts[0], F.lit("-"), parts[1], F.lit("-QH"), parts[2]))


def references(query: Column) -> dict[str, Column]:
    """Document, article, clause and point that a question names; null where it doesn't."""
    q = search_form(query)
    label = lambda name, pattern: F.concat(F.lit(name + " "), extracted(q, pattern))
    return {
        "document_id": document_number(q),
        "article": label("Điều", r"(?U)\bđiều\s+([0-9]+[a-z]?)\b"),
        "clause": label("Khoản", r"(?U)\bkhoản\s+([0-9]+)\b"),
        "point": label("Điểm", r"(?U)\bđiểm\s+([a-zđ])\b"),
    }


def same(a: Column, b: Column) -> Column:
    """Equal in search form; a null b equals nothing."""
    return F.coalesce(b.isNotNull() & (search_form(a) == search_form(b)), F.lit(False))


def any_of(text: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def count_of(text: Column, phrases: Column) -> Column:
    """How many of an array of phrases text contains."""
    return F.size(F.filter(phrases, lambda p: F.contains(text, p)))


def filled(value: Column) -> Column:
    """Stripped and folded, null if nothing is left."""
    return F.nullif(folded(value), F.lit(""))


def source_path(document_title, document_id, chapter, section, article, article_title, clause, point) -> Column:
    """The whole way down to a passage."""
    head = F.coalesce(filled(document_title), filled(document_id))
    titled = F.concat_ws(". ", filled(article), filled(article_title))
    out = F.concat_ws(" → ", head, filled(chapter), filled(section), F.nullif(titled, F.lit("")), filled(clause), filled(point))
    return F.when(out == "", F.lit("Không rõ nguồn")).otherwise(out)


def citation_text(document_title, document_id, article, clause, point) -> Column:
    """The short form; null without a document."""
    head = F.coalesce(filled(document_title), filled(document_id))
    return F.when(head.isNotNull(), F.concat_ws(" → ", head, filled(article), filled(clause), filled(point)))


def version_year(year, document_id, document_title) -> Column:
    """The first 20dd of the year field, else of id and title; else null."""
    pattern = r"(?U)\b(20[0-9]{2})\b"
    named = F.concat_ws(" ", F.coalesce(document_id, F.lit("")), F.coalesce(document_title, F.lit("")))
    return F.coalesce(extracted(year.cast("string"), pattern), extracted(named, pattern)).cast("int")


def prefixed(text: Column, prefix: str) -> Column:
    """What an encoder is given; empty text is an error."""
    plain = folded(text)
    return F.when(plain == "", F.raise_error(F.lit("empty text for the encoder"))).otherwise(F.concat(F.lit(prefix), plain))


def n_words(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))
