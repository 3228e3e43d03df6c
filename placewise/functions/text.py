"""Folding, number formatting and template rendering as column expressions."""
from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, functions as F

NBSP = "\u00a0"
# Accented letters and their base letters, position by position.
ACCENTED = "áàâäãåąăāçćčďđéèêëęěēíìîïīłĺľñńňóòôöõőøōřŕšśşßťţúùûüůűūýÿžźż"
PLAIN = "aaaaaaaaacccddeeeeeeeiiiiilllnnnoooooooorrssssttuuuuuuuyyzzz"




def _decompositions() -> dict[str, str]:
    """Lower-case letters and what they are without diacritics by compatibility decomposition, where that differs.
    Hangul syllables stay whole: they carry no diacritics."""
    out = {}
    for c in map(chr, range(0xAA, sys.maxunicode + 1)):
        if unicodedata.decomposition(c) and unicodedata.category(c)[0] == "L" and c == c.lower():
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
            if plain != c and plain.isalpha():
                out[c] = plain
    return out


_LETTERS = {c: p for c, p in _decompositions().items() if c not in ACCENTED}
_FROM, _TO = (ACCENTED + "".join(c for c, p in _LETTERS.items() if len(p) == 1), PLAIN + "".join(p for p in _LETTERS.values() if len(p) == 1))
_LIGATURES = {c: p for c, p in _LETTERS.items() if len(p) > 1 and p.isascii()} | {"ß": "ss"}


def strip_accents(s: Column) -> Column:
    """Lower case without diacritics (stroke letters and loose combining marks included); ligatures become their letters,
    sharp s becomes ss."""
    low = F.lower(s)
    for c, letters in _LIGATURES.items():
        low = F.replace(low, F.lit(c), F.lit(letters))
    return F.regexp_replace(F.translate(low, _FROM, _TO), r"\p{Mn}+", "")


def fold_sql(s: str) -> str:
    """``fold`` as SQL text, from the same table of letters."""
    low = f"lower({s})"
    for c, letters in _LIGATURES.items():
        low = f"replace({low}, '{c}', '{letters}')"
    plain = f"regexp_replace(translate({low}, '{_FROM}', '{_TO}'), '\\\\p{{Mn}}+', '')"
    return f"trim(regexp_replace(regexp_replace({plain}, '[-–,./()\"\\'„”]', ' '), '\\\\s+', ' '))"


def fold(s: Column) -> Column:
    """Search form: no accents, punctuation to blanks, blanks collapsed."""
    s = F.regexp_replace(strip_accents(s), "[-–,./()\"'„”]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def fold_keep_slash(s: Column) -> Column:
    """Address form: keeps word characters and / . - ; everything else becomes a blank."""
    s = F.regexp_replace(strip_accents(s), r"[^\p{L}\p{N}_\s/.-]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def alnum_key(s: Column) -> Column:
    return F.regexp_replace(strip_accents(s), "[^a-z0-9]", "")


# Street-type words dropped from the front of a street name.
STREET_PREFIX = r"^(ul|al|aleja|aleje|os|osiedle|pl|plac|rondo|bulwar|skwer|marsz|gen|ks|sw|św|prof|dr|im)\.?\s+"


def street_norm(s: Column) -> Column:
    s = F.regexp_replace(strip_accents(s), r"[^\p{L}\p{N}_\s]", " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    for _ in range(3):
        s = F.regexp_replace(s, STREET_PREFIX, "")
    return s


def house_number(s: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(s), r"\s+", ""), "/")[0]


def fmt_number(v: Column, lang: Column, decimals: Column) -> Column:
    """Polish groups from five digits, Czech from four (no-break space, decimal comma); others 1,234.5."""
    r = F.bround(F.round(v, 9), 0)
    r1 = F.bround(F.round(v, 9), 1)
    s = F.when(decimals > 0, F.format_number(r1, 1)).otherwise(F.format_number(r, 0))
    s = F.when(s == "-0", "0").otherwise(s)
    whole, frac = F.substring_index(s, ".", 1), F.when(decimals > 0, F.substring_index(s, ".", -1))
    digits = F.regexp_replace(whole, "[,-]", "")
    grouped = F.when(F.length(digits) >= F.when(lang == "pl", 5).otherwise(4), F.translate(whole, ",", NBSP)) \
        .otherwise(F.regexp_replace(whole, ",", ""))
    local = F.when(frac.isNotNull(), F.concat(grouped, F.lit(","), frac)).otherwise(grouped)
    return F.when(lang.isin("pl", "cs"), local).otherwise(s)


def display_value(v: Column, unit: Column, lang: Column, decimals: Column) -> Column:
    return F.when((unit == "min") & (v < 1), "<1").otherwise(fmt_number(v, lang, decimals))


def render(template: Column, **values: Column) -> Column:
    for k, v in values.items():
        template = F.replace(template, F.lit("{{" + k + "}}"), F.coalesce(v.cast("string"), F.lit("None")))
    return template


def address_parts(street: Column, place: Column, cp: Column, co: Column, mark: Column, kind: Column,
                  zip_code: Column) -> tuple[Column, Column, Column]:
    """Street (else the place name), house number (cp/co, 'ev. n' for recreation numbers), postcode as 'NNN NN'."""
    orient = F.concat(F.coalesce(co, F.lit("")), F.coalesce(mark, F.lit("")))
    number = F.when(orient != "", F.concat(cp, F.lit("/"), orient)).when(kind == "č.ev.", F.concat(F.lit("ev. "), cp)).otherwise(cp)
    z = F.regexp_replace(F.coalesce(zip_code, F.lit("")), " ", "")
    base = F.when(F.coalesce(street, F.lit("")) != "", street).otherwise(F.coalesce(place, F.lit("")))
    return base, number, F.when(F.length(z) == 5, F.concat_ws(" ", F.substring(z, 1, 3), F.substring(z, 4, 2)))


def wkt_point(s: Column) -> tuple[Column, Column]:
    """'POINT(a b)' -> two numbers, NULL if it does not match."""
    pat = r"POINT\(\s*([\d.]+)\s+([\d.]+)\s*\)"
    return tuple(F.when(s.rlike(pat), F.regexp_extract(s, pat, i)).try_cast("double") for i in (1, 2))
