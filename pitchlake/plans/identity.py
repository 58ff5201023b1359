"""Queries on who is who: names across scripts, candidates, comparison, probabilities, groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.people import evidence, normal_name
from ..operators import linkage, names
from ..session import cut, written
from . import adapters as ad

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


NAMES = ("full_name", "known_as")
RANDOM_PAIRS = 50_000
LINK = 0.5


@query()
def f4_names_across_scripts(spark, sf_dir):
    """Every name as registered second, looked for among those registered first."""
    r = ad.registrations(spark, sf_dir)
    asked = r.where("source = 'federation'").select(F.col("full_name").alias("query"))
    return names.find_names(asked, r.where("source = 'academy'"), "record_id", NAMES).select("query", F.col("id").alias("record_id"))


@query()
def f5_sound_keys(spark, sf_dir):
    """How many people have each sound key, in either script."""
    keys = names.sound_key_index(ad.registrations(spark, sf_dir), "record_id", NAMES)
    return keys.select("id", F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("records"))


def prepared(spark, sf_dir):
    """Registrations with their sound keys and what a comparison needs."""
    r = ad.registrations(spark, sf_dir)
    held = cut(names.words_of(r, "record_id", NAMES))
    forms = names.comparable(names.vocabulary(held))
    listed = held.join(forms, "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("l"), F.array_sort(F.collect_set(F.nullif(F.col("key"), F.lit("")))).alias("keys"))
    tokens = F.filter(F.split(normal_name(F.concat_ws(" ", *NAMES)), " "), lambda w: w != "")
    words = listed.select(F.col("id").alias("record_id"), F.col("l.w").alias("words"), "keys")
    return cut(r.join(words, "record_id", "left").withColumn("given", F.when(F.length(F.trim("full_name")) > 0, F.col("words")[0])).withColumn("tokens", tokens))


def candidates(r, within=None):
    return linkage.name_candidates(r, "record_id", "keys", "sex", "date_of_birth", within=within)


def compared(r, told):
    """Candidate pairs with what ``told`` (a row for each pattern of levels) says of their pattern."""
    return linkage.candidate_patterns(r, "record_id", "keys").join(F.broadcast(told), "pattern").drop("pattern")


@query()
def j12_name_candidates(spark, sf_dir):
    """Pairs of registrations that share enough sound keys, with sexes and birth years that agree."""
    return candidates(prepared(spark, sf_dir))


def true_pairs(r, half: int):
    """Pairs known to be one person, in one of two halves of the people."""
    one = r.where(F.floor(F.col("person_id") / 4) % 2 == half).select("person_id", "record_id")
    return one.where("record_id % 2 = 0").select("person_id", F.col("record_id").alias("a")).join(one.where("record_id % 2 = 1").select("person_id", F.col("record_id").alias("b")), "person_id").select("a", "b")


def model(spark, sf_dir):
    """(records, counts of compared candidates by their levels, m, u, share): m from half of the
    known pairs, u from random pairs, the share of true pairs from all pairs.

    Candidates grow with the square of the records, their patterns don't: what needs the pairs
    themselves compares them again rather than keep them.
    """
    r, fields = prepared(spark, sf_dir), list(linkage.LEVELS)
    levels = lambda pairs: linkage.seven_levels(pairs, r, "record_id")
    m = linkage.level_shares(levels(true_pairs(r, 0)))
    u = linkage.level_shares(levels(linkage.random_pairs(r, "record_id", RANDOM_PAIRS)))
    n = r.count()
    every = max(1, n * (n - 1) // 2)
    counts = linkage.candidate_patterns(r, "record_id", "keys").groupBy("pattern").agg(F.count("*").alias("n"))
    patterns = counts.join(F.broadcast(linkage.patterns(spark)), "pattern").select(*fields, "n").toPandas()
    share = linkage.fit_share(patterns, m, u, fields, every, min(0.5, max(1e-12, 0.1 * n / every)))
    return r, patterns, m, u, share


def scored(spark, sf_dir):
    """(records, patterns of levels with their probability)."""
    r, _, m, u, share = model(spark, sf_dir)
    return r, linkage.score(linkage.patterns(spark), m, u, list(linkage.LEVELS), share)


@query()
def m6_match_probabilities(spark, sf_dir):
    """Candidate pairs by their seven levels, with the probability that they are one person."""
    r, told = scored(spark, sf_dir)
    return compared(r, told.withColumn("probability", F.round("probability", 6))).select("a", "b", *linkage.LEVELS, "probability")


@query()
def m6_evidence_weights(spark, sf_dir):
    """What each level of each field says, in log odds."""
    _, patterns, m, u, _ = model(spark, sf_dir)
    seen = {f: patterns.groupby(f)["n"].sum() for f in linkage.LEVELS}
    rows = [(f, lv, m[f][lv], u[f][lv], linkage.level_weight(m, u, f, lv), int(seen[f].get(lv, 0))) for f in linkage.LEVELS for lv in linkage.LEVELS[f]]
    weights = spark.createDataFrame(rows, "field string, level string, m double, u double, weight double, pairs long")
    return weights.select("field", "level", *[F.round(c, 6).alias(c) for c in ("m", "u", "weight")], "pairs")


def grouped(spark, sf_dir):
    """(records, candidates of LINK and more, groups). Conflicts tell groups apart only among
    records that links connect; there all pairs are looked at, as candidates leave out the very
    pairs whose sexes differ or who were born years apart."""
    r, told = scored(spark, sf_dir)
    clash = (F.col("dob") == "conflict") | (F.col("sex") == "different")
    strong = written(compared(r, told.where(F.col("probability") >= LINK).select("pattern", "probability", clash.alias("conflict"))))
    links = strong.where("not conflict")  # a link in conflict is refused whatever the groups
    near = r.join(linkage.components(links.select("a", "b")).withColumnRenamed("id", "record_id"), "record_id")
    bad = linkage.conflicts(near, "record_id", "sex", "date_of_birth", "component").select("a", "b", F.lit(0.0).alias("probability"), F.lit(True).alias("conflict"))
    return r, strong, linkage.greedy_groups(links.union(bad), "conflict", LINK)


@query()
def m6b_greedy_groups(spark, sf_dir):
    """Groups of records, the strongest link first, without conflicting dates or sexes."""
    return grouped(spark, sf_dir)[2]


@query()
def m6_evaluation(spark, sf_dir):
    """Candidates, links and groups against the known pairs that m was not counted on."""
    r, s, groups = grouped(spark, sf_dir)
    true = true_pairs(r, 1)
    inside = r.where(F.floor(F.col("person_id") / 4) % 2 == 1).select(F.col("record_id").alias("a"), F.col("person_id").alias("pa"))
    found = s.where(F.col("probability") >= LINK).join(inside, "a").join(r.select(F.col("record_id").alias("b"), F.col("person_id").alias("pb")), "b")
    g = groups.join(r.select(F.col("record_id").alias("id"), "person_id"), "id").where(F.floor(F.col("person_id") / 4) % 2 == 1)
    joined = true.join(g.select(F.col("id").alias("a"), F.col("group").alias("ga")), "a").join(g.select(F.col("id").alias("b"), F.col("group").alias("gb")), "b").where("ga = gb")
    row = lambda what, df: df.agg(F.count("*").alias("pairs")).select(F.lit(what).alias("what"), "pairs")
    return row("known", true).union(row("candidates", true.join(candidates(r, within="person_id"), ["a", "b"], "left_semi"))).union(row("linked", found)).union(row("linked and right", found.where("pa = pb"))).union(row("grouped and right", joined))


@query()
def f22_identity_evidence(spark, sf_dir):
    """What candidate pairs agree and disagree on, in words."""
    r, told = prepared(spark, sf_dir), linkage.patterns(spark)
    return compared(r, told.select("pattern", F.array_join(evidence({f: F.col(f) for f in linkage.LEVELS}), "; ").alias("evidence"))).select("a", "b", "evidence")
