"""Normalisation of names and addresses as Column expressions; nothing leaves the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samewise.functions import dictionaries as D
from samewise.functions.tokens import let


@lru_cache(maxsize=1)
def latin_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode's own decompositions."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = unicodedata.normalize("NFKD", c)[0]
        if base.isascii() and base.isalpha():
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Letters that have no decomposition (fixed values).
LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "TH", "ð": "d"}


def ascii_latin(c: Column) -> Column:
    """Latin letters without their accents; letters of some other scripts by their names."""

    def of(text: Column) -> Column:
        s = text
        for a, b in LIGATURES.items():
            s = F.replace(s, F.lit(a), F.lit(b))
        s = let(F.translate(s, *latin_table()), other_scripts)
        return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(s, r"\p{M}+", ""))

    return let(c, of)


def _spell(text: str | None) -> str | None:
    """Other scripts by the names Unicode gives their letters: KA is ``ka``, VOWEL SIGN AA is ``aa``."""
    if text is None or text.isascii():
        return text
    out: list[str] = []
    for c in unicodedata.normalize("NFC", text):
        if c.isascii():
            out.append(c)
            continue
        name = unicodedata.name(c, "")
        found = re.search(r"(?:LETTER|VOWEL SIGN|DIGIT) ([A-Z]+)$", name)
        if "VIRAMA" in name and out and out[-1].endswith("a"):
            out[-1] = out[-1][:-1]
        elif found and "VOWEL SIGN" in name and out and out[-1].endswith("a"):
            out[-1] = out[-1][:-1] + found[1].lower()
        elif "ANUSVARA" in name or "CANDRABINDU" in name:
            out.append("n")
        elif unicodedata.category(c) == "Nd":
            out.append(str(unicodedata.digit(c)))
        elif found:
            out.append(found[1].lower())
        else:
            base = unicodedata.normalize("NFKD", c)
            out.append(base if base.isascii() else " " if not unicodedata.combining(c) else "")
    return "".join(out)


def _sound(script: str, name: str) -> str:
    """The sound of a letter from its Unicode name: Greek and Cyrillic names spell more than the letter's sound."""
    name = name.lower()
    if script == "GREEK":
        return name[:2] if name[:2] in ("th", "ph", "ch", "ps") else name[:1]
    if script == "CYRILLIC":
        if name == "ie":
            return "e"
        if len(name) == 2 and name[0] == "e":
            return name[1]  # EF, EL, EM, EN, ER, ES
        return name if name[0] in "aeiouy" else name.rstrip("aeiou")
    return name


@lru_cache(maxsize=1)
def script_table() -> str:
    """Letters, vowel signs and digits of other scripts and their spelling, by the rule of :func:`_spell`, as ``c:ka,...``.

    A vowel sign's spelling begins with ``\\u0001``, as a virama's is, which takes the vowel of the consonant before.
    """
    out = []
    for c in map(chr, [*range(0x370, 0x530), *range(0x900, 0xD80)]):
        name = unicodedata.name(c, "")
        found = re.search(r"(?:LETTER|VOWEL SIGN|DIGIT) ([A-Z]+)$", name)
        if "VIRAMA" in name:
            out.append((c, "\u0001"))
        elif found and "VOWEL SIGN" in name:
            out.append((c, "\u0001" + found[1].lower()))
        elif "ANUSVARA" in name or "CANDRABINDU" in name:
            out.append((c, "n"))
        elif unicodedata.category(c) == "Nd":
            out.append((c, str(unicodedata.digit(c))))
        elif found:
            out.append((c, _sound(name.split(" ")[0], found[1])))
        else:
            base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            found = re.search(r"LETTER ([A-Z]+)$", unicodedata.name(base, "")) if len(base) == 1 else None
            if found:
                out.append((c, _sound(name.split(" ")[0], found[1])))
    return ",".join(f"{c}:{x}" for c, x in out)


def other_scripts(c: Column) -> Column:
    """Greek, Cyrillic and the scripts of India in Latin letters, within the JVM; texts of Latin letters are not touched."""
    table = F.str_to_map(F.lit(script_table()), F.lit(","), F.lit(":"))
    spelt = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")
    return F.when(c.rlike(r"[\u0370-\u052F\u0900-\u0D7F]"), F.regexp_replace(spelt, "a?\u0001", "")).otherwise(c)


@F.pandas_udf(T.StringType())
def transliterate(s: pd.Series) -> pd.Series:
    """Any script to ASCII, also those that :func:`other_scripts` lacks. Only for tables that have such text: it leaves the JVM."""
    return s.map(_spell)


def country(c: Column) -> Column:
    """Trimmed, in lower case; missing is ``unk``."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t == "", F.lit("unk")).otherwise(t)


def phonetic(c: Column) -> Column:
    """Spellings of one sound become one, doubled letters too; digits stay."""
    for a, b in D.PHONETIC:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"([a-z])\1", "$1")


def base(c: Column, variant: str = "g2") -> Column:
    """ASCII, lower case, words and digits only, domains and ordinals cut, folded (not in variant g1)."""
    s = F.trim(F.lower(ascii_latin(F.coalesce(c, F.lit("")))))
    s = F.replace(s, F.lit("&"), F.lit(" and "))
    s = F.regexp_replace(s, D.DOMAIN, "$1")
    s = F.regexp_replace(s, D.ORDINAL, "$1")
    s = F.regexp_replace(s, "[^a-z0-9 ]+", " ")
    return s if variant == "g1" else phonetic(s)


def words(c: Column) -> Column:
    """The words of a normalised text; none gives an empty array."""
    return F.filter(F.split(c, " +"), lambda w: w != "")


def _mapped(tokens: Column, table: dict[str, str]) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    return F.transform(tokens, lambda w: F.coalesce(F.element_at(lookup, w), w))


def _legal(variant: str, fold: bool) -> dict[str, str]:
    table = D.LEGAL_G1 if variant == "g1" else D.LEGAL
    return D.folded(table) if fold and variant != "g1" else table


def name_tokens(c: Column, variant: str = "g2", fold_dictionaries: bool = True) -> Column:
    return _mapped(words(base(c, variant)), _legal(variant, fold_dictionaries))


def core_tokens(tokens: Column, variant: str = "g2") -> Column:
    """Words that are no trade form; all of them if there is no other."""
    forms = F.array(*[F.lit(w) for w in sorted(set((D.LEGAL_G1 if variant == "g1" else D.LEGAL).values()))])
    return let(F.filter(tokens, lambda w: ~F.array_contains(forms, w)), lambda rest: F.when(F.size(rest) == 0, tokens).otherwise(rest))


def states(s: Column, land: Column, variant: str = "g2", fold_dictionaries: bool = True) -> Column:
    """Names of regions become codes: those of the record's own country, or of the US and India in variant g1.

    One pass over the text with one alternation, the longest names first, so a code is never read again.
    """

    def one(table: dict[str, str], s: Column = s) -> Column:
        table = D.folded(table) if fold_dictionaries and variant != "g1" else table
        pattern = r"\b(" + "|".join(sorted(map(re.escape, table), key=lambda x: (-len(x), x))).replace("\\ ", " ") + r")\b"
        lookup = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
        # the text between the matches and the matches themselves, put together again
        def of(text: Column, found: Column) -> Column:
            pieces = F.transform(F.split(text, pattern), lambda x, i: F.concat(x, F.coalesce(F.element_at(lookup, F.get(found, i)), F.lit(""))))
            return F.when(F.size(found) == 0, text).otherwise(F.array_join(pieces, ""))

        return let(s, lambda text: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda found: of(text, found)))

    if variant == "g1":
        return one({**D.STATES["us"], **D.STATES["india"]})

    def of(text: Column) -> Column:
        out = text
        for name, table in D.STATES.items():
            out = F.when(land == name, one(table, text)).otherwise(out)
        return out

    return let(s, of)


def address_tokens(c: Column, land: Column, variant: str = "g2", fold_dictionaries: bool = True) -> Column:
    """The words of an address, short forms, without words for missing, sorted; repeated words stay."""
    table = D.ADDRESS_G1 if variant == "g1" else D.folded(D.ADDRESS) if fold_dictionaries else D.ADDRESS
    none = D.MISSING_G1 if variant == "g1" else (*D.MISSING, *map(D.fold_word, D.MISSING)) if fold_dictionaries else D.MISSING
    kept = F.filter(words(states(base(c, variant), land, variant, fold_dictionaries)), lambda w: ~w.isin(*sorted(set(none))))
    return F.array_sort(_mapped(kept, table))


def numbers(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda w: w.rlike("^[0-9]+$"))))


def prepare(df: DataFrame, variant: str = "g2", fold_dictionaries: bool = True) -> DataFrame:
    """The source columns, never NULL, and ``name_full, core, nosp, addr, nums, zips``.

    NULL and empty fields become ``''``. Extra columns are dropped. One row for every row.
    """
    s = df.select(F.coalesce("entity_id", F.lit("")).alias("entity_id"), F.coalesce("business_name", F.lit("")).alias("business_name"), F.coalesce("business_address", F.lit("")).alias("business_address"), country(F.col("country")).alias("country"))
    s = s.withColumns({"__n": name_tokens(F.col("business_name"), variant, fold_dictionaries), "__a": address_tokens(F.col("business_address"), F.col("country"), variant, fold_dictionaries)})
    s = s.withColumns({"__c": core_tokens(F.col("__n"), variant), "__d": numbers(F.col("__a"))})
    return s.select(
        "entity_id", "business_name", "business_address", "country",
        F.array_join("__n", " ").alias("name_full"), F.array_join("__c", " ").alias("core"), F.array_join("__c", "").alias("nosp"), F.array_join("__a", " ").alias("addr"),
        F.array_join("__d", " ").alias("nums"), F.array_join(F.filter("__d", lambda w: F.length(w).isin(5, 6)), " ").alias("zips"),
    )
