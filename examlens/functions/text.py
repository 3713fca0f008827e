"""Column functions on text. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
SPACES = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set as a character class (Java syntax), by Unicode property: that is
# several times faster than listing the characters.
WS = r"[\p{IsWhite_Space}\x{feff}&&[^\x{85}]]"
LETTERS = ["A", "B", "C", "D", "E"]


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapsed(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WS}]+", " ")


def zone_key(c: Column) -> Column:
    """Header and footer strings compare trimmed, lower-cased, single-spaced."""
    return collapsed(F.lower(trimmed(c)))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(f"[^{WS}]+")), F.lit(0))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, or null when there is no match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def normalize_answer(c: Column) -> Column:
    """One letter A-E, alone or followed by a separator."""
    return extract(F.upper(trimmed(c)), rf"^([A-E])(?:\z|[).:\-{WS}])")


# Messages shown for a failed exam.
MSG_NONE_FOUND = (
    "Nenhuma questão identificada. Verifique se o arquivo contém questões objetivas "
    "e ajuste faixa de páginas/template."
)
MSG_UNPROCESSABLE = "Arquivo não processável. Use PDF ou imagem legível com questões objetivas."
MSG_NO_EXPLANATION = "Explicação indisponível para esta questão no momento."


def error_category(message: Column) -> Column:
    """User-facing text of a processing error."""
    low = F.lower(message)
    technical = low.contains("pdf") | low.contains("parser")
    for word in ("pipeline_", "pipeline input"):
        technical = technical | low.contains(word)
    return (
        F.when(message == "ZERO_VALID_QUESTIONS", MSG_NONE_FOUND)
        .when(technical, MSG_UNPROCESSABLE)
        .when(F.length(message) > 220, F.concat(F.substring(message, 1, 217), F.lit("...")))
        .otherwise(message)
    )


def normalize_exam_date(c: Column) -> Column:
    """Typed date to ISO when eight digits are there, else what was typed, as dd/mm/yyyy."""
    digits = F.substring(F.regexp_replace(c, "[^0-9]", ""), 1, 8)
    n = F.length(digits)
    day, month, year = F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 4)
    return (
        F.when(n == 8, F.concat_ws("-", year, month, day))
        .when(n > 4, F.concat_ws("/", day, month, year))
        .when(n > 2, F.concat_ws("/", day, month))
        .otherwise(F.nullif(digits, F.lit("")))
    )
