"""Names across scripts: words, their forms, words that can be one name, searches."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..functions import sounds
from ..session import cut

_TEXTS = ArrayType(StringType())
FORMS = StructType([StructField(c, kind) for c, kind in (("arabic", BooleanType()), ("form", StringType()), ("key", StringType()), ("meets", _TEXTS), ("lines", _TEXTS), ("skeletons", _TEXTS), ("pattern", StringType()))])


@F.pandas_udf(_TEXTS)
def name_words(names: pd.Series) -> pd.Series:
    """The words of each name; an empty list for a null one."""
    return names.map(sounds.words)


@F.pandas_udf(FORMS)
def word_forms(words: pd.Series) -> pd.DataFrame:
    """What tells words apart: an Arabic word's plain form and pattern, a Latin one's sound lines
    and skeletons; the key of both, and the keys by which they can meet across the scripts."""
    rows = []
    for w in words:
        if sounds.is_arabic(w):
            rows.append((True, sounds.arabic_form(w), sounds.word_key(w), [sounds.meeting_key(sounds.arabic_sounds(w))], [], [], f"^(?:{sounds.arabic_pattern(w)})$"))
        else:
            lines = sounds.latin_lines(w)
            rows.append((False, None, sounds.word_key(w), sorted({sounds.meeting_key(x) for x in lines}), list(lines), sorted({s for s in map(sounds.skeleton, lines) if s}), None))
    return pd.DataFrame(rows, columns=FORMS.names)


def words_of(people: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """(id, place, word): the different words of a person's names in order, each at its first place."""
    listed = F.array_distinct(F.flatten(F.array(*[name_words(F.coalesce(F.col(n), F.lit(""))) for n in names])))
    return people.select(F.col(key).alias("id"), F.posexplode(listed).alias("place", "word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, and its forms), each different word once."""
    forms = words.select("word").distinct().withColumn("f", word_forms("word"))
    return cut(forms.select("word", "f.*"))


def spellings(forms: DataFrame) -> DataFrame:
    """(arabic, line): sound lines of Latin words that spell an Arabic word.

    Each different word once: those that share all their sounds but h and l meet by a join of
    equal keys, then a line is matched with the Arabic word's pattern.
    """
    arabic = forms.where("arabic").select(F.col("word").alias("arabic"), F.explode("meets").alias("meets"), "pattern")
    latin = forms.where("not arabic").select(F.explode("lines").alias("line")).distinct()
    meets = F.regexp_replace(F.regexp_replace("line", r"\[[a-z]+\]", ""), "[hHl]", "")
    return arabic.join(latin.withColumn("meets", meets), "meets").where(F.rlike("line", F.col("pattern"))).select("arabic", "line").distinct()


def comparable(forms: DataFrame) -> DataFrame:
    """(word, key, w): ``w`` holds all that ``same_word`` needs of a word."""
    known = spellings(forms).groupBy(F.col("arabic").alias("word")).agg(F.collect_set("line").alias("spelled"))
    own = F.when(F.col("arabic"), F.array("form")).otherwise(F.col("skeletons"))
    across = F.when(F.col("arabic"), F.coalesce("spelled", F.array().cast("array<string>"))).otherwise(F.col("lines"))
    return forms.join(known, "word", "left").select("word", "key", F.struct("arabic", own.alias("own"), across.alias("across")).alias("w"))


def same_word(a: Column, b: Column) -> Column:
    """Whether two words (``comparable``'s ``w``) can be one name: in one script by equal forms or
    consonant sounds, across them by a spelling."""
    return F.when(a["arabic"] == b["arabic"], F.arrays_overlap(a["own"], b["own"])).otherwise(F.arrays_overlap(a["across"], b["across"]))


def hits(short: Column, long: Column) -> Column:
    """How many words of one list have a match in the other."""
    return F.size(F.filter(short, lambda a: F.exists(long, lambda b: same_word(a, b))))


def matching_words(forms: DataFrame) -> DataFrame:
    """(a, b): all pairs of different words that can be one name, both ways, and each with itself."""
    arabic, latin = forms.where("arabic"), forms.where("not arabic")
    side = lambda df, value, name: df.select(F.col("word").alias(name), value.alias("k"))
    by_form = side(arabic, F.col("form"), "a").join(side(arabic, F.col("form"), "b"), "k")
    by_sound = side(latin, F.explode("skeletons"), "a").join(side(latin, F.explode("skeletons"), "b"), "k")
    lines = latin.select("word", F.explode("lines").alias("line"))
    across = spellings(forms).join(lines, "line").select(F.col("arabic").alias("a"), F.col("word").alias("b"))
    pairs = by_form.select("a", "b").union(by_sound.select("a", "b")).union(across).union(across.select("b", "a"))
    return pairs.distinct()


def find_names(queries: DataFrame, people: DataFrame, key: str, names: Sequence[str], query: str = "query") -> DataFrame:
    """(query, id): people with a match, in some name of theirs, for every word of a query.

    Words are compared once each, however many names hold them. A query without words finds
    nobody. A query and a person meet by the query's two words with the fewest bearers, and the
    others are looked for where they meet, so common words cost no row for each bearer.
    """
    asked = queries.select(query).distinct().withColumn("words", F.array_distinct(name_words(F.coalesce(F.col(query), F.lit("")))))
    asked = cut(asked.select(query, F.size("words").alias("needed"), F.explode("words").alias("word")))
    held = cut(words_of(people, key, names).select("id", "word"))
    forms = vocabulary(asked.select("word").union(held.select("word")))
    bearers = held.groupBy(F.col("word").alias("b")).agg(F.count("*").alias("n"))
    options = matching_words(forms).join(bearers, "b").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n"), F.collect_list("b").alias("held"))
    sought = asked.join(options, "word").groupBy(query, "needed").agg(F.sort_array(F.collect_list(F.struct("n", "word", "held"))).alias("l")).where("size(l) = needed")
    pair = lambda x, y: (F.least(x, y).alias("p"), F.greatest(x, y).alias("q"))
    sought = sought.select(query, F.col("l.held").alias("options"), F.explode(F.col("l")[0]["held"]).alias("x"))
    sought = sought.withColumn("y", F.explode(F.when(F.size("options") > 1, F.get("options", F.lit(1))).otherwise(F.array("x"))))
    sought = sought.select(query, "options", *pair(F.col("x"), F.col("y")))
    borne = held.groupBy("id").agg(F.collect_list("word").alias("words"))
    borne = borne.select("id", "words", F.explode("words").alias("x")).select("id", "words", "x", F.explode("words").alias("y")).where("x <= y")
    reached = sought.join(borne.select("id", "words", F.col("x").alias("p"), F.col("y").alias("q")), ["p", "q"])
    return reached.where(F.forall("options", lambda o: F.arrays_overlap(o, F.col("words")))).select(query, "id").distinct()


def sound_key_index(people: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """(id, keys): the different sound keys of each person's words, alike in both scripts."""
    held = words_of(people, key, names)
    forms = vocabulary(held)
    keyed = held.join(forms.select("word", "key"), "word").where("key <> ''")
    return keyed.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
