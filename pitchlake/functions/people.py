"""Ages, dates of birth and names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

YEAR = 365.25


def age_years(on: Column, born: Column) -> Column:
    """Age as days / 365.25."""
    return F.datediff(on, born) / F.lit(YEAR)


def calendar_age(on: Column, born: Column) -> Column:
    """Whole years by the calendar."""
    before = (F.month(on) < F.month(born)) | ((F.month(on) == F.month(born)) & (F.day(on) < F.day(born)))
    return F.year(on) - F.year(born) - before.cast("int")


def is_minor(on: Column, born: Column, of_age: int = 18) -> Column:
    """Under age on a date; unknown birth dates count as minors."""
    return F.coalesce(calendar_age(on, born) < of_age, F.lit(True))


def age_label(age: Column) -> Column:
    """An age as '12y 3m'."""
    months = F.floor(age * 12).cast("int")
    return F.concat(F.floor(months / 12).cast("string"), F.lit("y "), (months % 12).cast("string"), F.lit("m"))


def birth_relation(a: Column, b: Column, near: int = 7) -> Column:
    """exact, near (within days), transposed (day and month swapped), unknown or none."""
    swapped = (F.year(a) == F.year(b)) & (F.month(a) == F.day(b)) & (F.day(a) == F.month(b))
    return (
        F.when(a.isNull() | b.isNull(), "unknown")
        .when(a == b, "exact")
        .when(F.abs(F.datediff(a, b)) <= near, "near")
        .when(swapped, "transposed")
        .otherwise("none")
    )


#: Marks that go (harakat, superscript alef, tatweel), letters written in one way.
ARABIC_MARKS = "[ً-ْٰـ]"
ARABIC_FROM = "أإآٱةىؤئ"
ARABIC_TO = "ااااهيوي"


@F.pandas_udf(StringType())
def _compatible(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


def normal_name(name: Column) -> Column:
    """A name in one form: compatible characters, no marks, folded letters and case, single spaces."""
    plain = name.rlike(r"^[\x00-\x7f]*$")
    folded = F.when(plain, F.lower(name)).otherwise(_compatible(name))
    folded = F.translate(F.regexp_replace(folded, ARABIC_MARKS, ""), ARABIC_FROM, ARABIC_TO)
    return F.trim(F.regexp_replace(folded, r"\s+", " "))


def name_tokens(name: Column) -> Column:
    """Distinct words of a normal name."""
    return F.array_distinct(F.filter(F.split(name, " "), lambda w: w != ""))


def token_containment(a: Column, b: Column) -> Column:
    """Shared words over the words of the shorter list; 0 for an empty one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def exact_form(name: Column) -> Column:
    """A name for exact comparison: lower case, single spaces, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


#: What a level of agreement says to a reviewer, in the order of a listing.
EVIDENCE = {
    ("name", "all"): "Every word of the shorter name after the given one is in the other",
    ("name", "all-one-word"): "The one word after the given name matches",
    ("name", "most"): "Most words after the given name match",
    ("name", "some"): "Some words after the given name match",
    ("name", "none"): "The names have no word after the given one in common",
    ("given", "same"): "Same given name",
    ("given", "different"): "Different given names",
    ("dob", "exact"): "Same date of birth",
    ("dob", "transposed"): "Day and month of birth swapped",
    ("dob", "near"): "Born within a week of each other",
    ("dob", "conflict"): "Dates of birth disagree",
    ("dob", "unknown"): "A date of birth is missing",
    ("sport", "same"): "Same sport",
    ("sport", "different"): "Different sports",
    ("club", "same"): "Registered at the same club",
    ("club", "different"): "Registered at different clubs",
}


def evidence(levels: dict[str, Column]) -> Column:
    """The sentences for a pair's levels, in order; levels that say nothing are left out."""
    said = [F.when(levels[f] == level, text) for (f, level), text in EVIDENCE.items() if f in levels]
    return F.array_compact(F.array(*said))


def age_range(text: Column) -> Column:
    """(least, most) age of an English or Arabic phrase such as 'u17', '14 to 16', 'over 15'."""
    t = F.lower(text)
    def at(rx: str, g: int) -> Column:
        return F.regexp_extract(t, rx, g).try_cast("int")

    two = r"(\d{1,2})\s*(?:-|to|and|إلى)\s*(\d{1,2})"
    under, over = r"(?:\bu|under|below|تحت)\s*-?(\d{1,2})", r"(?:over|above|older than|فوق)\s*(\d{1,2})"
    exact = r"(\d{1,2})\s*(?:years?|yo|سنة)"
    least = F.when(t.rlike(two), F.least(at(two, 1), at(two, 2))).when(t.rlike(under), F.lit(None)).when(t.rlike(over), at(over, 1) + 1).when(t.rlike(exact), at(exact, 1))
    most = F.when(t.rlike(two), F.greatest(at(two, 1), at(two, 2))).when(t.rlike(under), at(under, 1) - 1).when(t.rlike(over), F.lit(None)).when(t.rlike(exact), at(exact, 1))
    return F.struct(least.cast("int").alias("least"), most.cast("int").alias("most"))
