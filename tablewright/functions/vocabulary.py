"""Column expressions that several operators share; built-in functions only."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decomposed() -> tuple[dict[str, str], dict[str, str]]:
    """Letters with marks and other compatible forms, by Unicode decomposition without marks: to one character, to several."""
    one, more = {}, {}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x20A0), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if plain != chr(code) and plain.strip():
            (one if len(plain) == 1 else more)[chr(code)] = plain
    return one, more


ONE, MORE = _decomposed()
#: Marks that stand behind their letter.
MARKS = "[\\u0300-\\u036F\\u1AB0-\\u1AFF\\u1DC0-\\u1DFF\\u20D0-\\u20FF]"

# The shapes of printed values.
DATE = (
    r"(?i)\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"
    r"|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}"
)
MONEY = r"[$£€]\s?-?[\d,]+\.?\d*|\(?-?[\d,]+\.\d{2}\)?"
NUMBER = r"^-?[\d,]+(\.\d+)?$"
RATE = r"\d+(\.\d+)?\s?%|\b0?\.\d+\b"
CODE = r"[A-Za-z0-9][A-Za-z0-9\-/]{3,}"
TOKEN_DATE = (
    r"^(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\*?|\d{4}-\d{1,2}-\d{1,2}"
    r"|(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*[\s.-]*\d{2,4})$"
)
TOKEN_PERCENT = r"^\(?-?[\d,]*\.?\d+\)?%$"
TOKEN_MONEY = r"^\(?-?[\d,]*\.?\d+\)?-?$"
FIGURE = r"^(\(-?(\d+\.?\d*|\.\d+)-?\)|-?(\d+\.?\d*|\.\d+)-?)$"
#: Figures as most are printed: digits and a point; a currency sign and commas besides.
PLAIN = r"\A-?(?:\d+\.?\d*|\.\d+)\z"
PLAIN_MONEY = r"\A\$?\d[\d,]*\.?\d*\z"
CELL_BREAK = r"\t|\s{2,}|\s*\|\s*"
A_BREAK = r"\t|\s\s|\|"


def fold_key(text: Column) -> Column:
    """Accents, case and punctuation stop mattering; spaces stay. Only text that isn't ASCII is decomposed."""
    plain = F.translate(text, "".join(ONE), "".join(ONE.values()))
    plain = F.regexp_replace(plain, MARKS, "")
    for letter in "Ĳĳﬀﬁﬂﬃﬄ":
        plain = F.replace(plain, F.lit(letter), F.lit(MORE[letter]))
    plain = F.when(text.rlike("[^\\x00-\\x7F]"), plain).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9 ]+", " "))


def fold_words(text: Column) -> Column:
    """Lower case, and one space for every run of other characters than letters and digits."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def squash(text: Column) -> Column:
    """Only letters and digits stay, in lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def strip(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def parse_figure(text: Column) -> Column:
    """A printed figure as decimal(18,4), null if it isn't one: brackets, a leading or trailing minus are negative. Plain figures,
    nearly all there are, are read at once, text with a letter never; only the rest is taken apart."""
    money = F.translate(text, "$,", "").try_cast("decimal(18,4)")
    return F.when(text.rlike(PLAIN), text.try_cast("decimal(18,4)")).when(text.rlike(PLAIN_MONEY), money).when(~text.rlike("[A-Za-z]"), odd_figure(text))


def odd_figure(text: Column) -> Column:
    """`parse_figure` of any text, step by step."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"[$,]", ""), "%+$", "")
    sign = F.when(t.startswith("(") | t.contains("-"), "-").otherwise("")
    return F.when(t.rlike(FIGURE), F.concat(sign, F.regexp_replace(t, "[()-]", "")).try_cast("decimal(18,4)"))


def value_kind(text: Column) -> Column:
    """date, percent, money, number or text."""
    t = F.trim(text)
    bare = F.replace(t, F.lit("$"), F.lit(""))
    return (
        F.when(~text.rlike(r"\d"), "text")
        .when(text.rlike(r"\A\d*\.\d+\z"), "money")  # the plain ones, told before anything is taken apart
        .when(text.rlike(r"\A\d+\z"), "number")
        .when(t.rlike(TOKEN_DATE), "date")
        .when(bare.rlike(TOKEN_PERCENT), "percent")
        .when(bare.rlike(TOKEN_MONEY), F.when(t.rlike(r"[$,.]"), "money").otherwise("number"))
        .otherwise("text")
    )


def shape_tests(value: Column) -> dict[str, Column]:
    """Whether a trimmed value that isn't null looks like what a field of each shape holds."""
    return {
        "date": value.rlike(DATE),
        "money": value.rlike(MONEY),
        "number": strip(value, "$ ").rlike(NUMBER),
        "rate": value.rlike(RATE),
        "code": value.rlike(CODE) & value.rlike(r"\d"),
    }


def fits_shape(value: Column, shape: Column) -> Column:
    """Whether a value looks like what a field of this shape holds; an unknown shape takes any."""
    v = F.trim(F.coalesce(value, F.lit("")))
    fits = v != ""
    for name, test in shape_tests(v).items():
        fits = F.when(shape == name, test).otherwise(fits)
    return fits


def us_date(text: Column) -> Column:
    """MM/DD/YYYY of a printed date, null if it can't be read."""
    t = F.trim(text)
    forms = ["M/d/yyyy", "yyyy-M-d", "MMMM d, yyyy", "MMM d, yyyy", "M-d-yyyy", "d MMM yyyy"]
    return F.date_format(F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms]), "MM/dd/yyyy")


def split_cells(text: Column) -> Column:
    """The cells of a line that aren't empty. A line without a break, as most are, is its own cell and isn't split."""
    several = F.filter(F.transform(F.split(text, CELL_BREAK), lambda c: F.trim(c)), lambda c: c != "")
    none = F.array().cast("array<string>")
    return F.when(~text.rlike(A_BREAK), F.when(F.trim(text) == "", none).otherwise(F.array(F.trim(text)))).otherwise(several)


#: What may stand between the words of a label.
LABEL_GAP = "[^A-Za-z0-9]{0,3}"


def label_pattern(label_key: str) -> str:
    """A label's words with up to three other characters between, no letter or digit before."""
    return r"(?<![A-Za-z0-9])" + LABEL_GAP.join(re.escape(w) for w in label_key.split())
