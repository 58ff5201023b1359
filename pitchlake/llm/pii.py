"""Personal data: generators propose spans, boosted trees select (DataFrame operations only)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup, matches, once, text_of

SPAN = "array<struct<start:int,kind:int,end:int,hit:string,before:string,after:string>>"


@dataclass(frozen=True)
class Generator:
    """Proposes spans of a kind. ``cheap``: a regex that a text with one must match."""

    kind: str
    pattern: str
    cheap: str
    digits: int = 0  # matches with fewer are no proposals


#: The kinds in the order of a listing. The first four are the contract's; their
#: regexes match the same spans but never go back over a long run of the same characters.
GENERATORS = (
    Generator("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Generator("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    Generator("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){8}", 9),
    Generator("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 5),
    Generator("local_phone", r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])", r"[0-9]{3}[ .-][0-9]"),
    Generator("spelled_email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]++)++", r"[\[(]at[\])]"),
    Generator("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]"),
    Generator("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
)
BASE_KINDS = 4
HINTS = ("mail", "tel", "phone", "call", "card", "ip", "id", "account", "contact", ":", "=")


def proposals(text: Column, number: int) -> Column:
    """Spans of a generator with the characters around them, by start."""
    rule = GENERATORS[number]
    found = matches(text, rule.pattern)
    if rule.digits:
        found = F.filter(found, lambda m: F.length(only_digits(m["hit"])) >= rule.digits)
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"), m["hit"].alias("hit"), m["before"].alias("before"), m["after"].alias("after")))
    return F.when(text.rlike(rule.cheap), spans).otherwise(F.array().cast(SPAN))


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit checks the others."""

    def value(i: Column) -> Column:
        v = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def check_digits(hit: Column) -> Column:
    """Whether an account number's remainder by 97 is 1, its first four characters put last."""
    plain = F.regexp_replace(hit, " ", "")
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    signs = F.filter(F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), ""), lambda c: c != "")
    return F.aggregate(signs, F.lit(0), lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97) == 1


def valid(s: Column) -> Column:
    """Whether a span passes its kind's check."""
    hit = s["hit"]
    n = F.length(only_digits(hit))
    in_range = F.forall(F.split(hit, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substring(F.concat(F.lit("000"), p), -3, 3) <= "255"))
    return (
        F.when(s["kind"] == 0, True)
        .when(s["kind"] == 1, in_range)
        .when(s["kind"] == 2, F.when((n >= 12) & (n <= 19), luhn(only_digits(hit))).otherwise(False))
        .when(s["kind"] == 3, (n >= 9) & (n <= 15))
        .when(s["kind"] == 4, (n >= 9) & (n <= 11))
        .when(s["kind"] == 5, hit.rlike(r"^[^\[(]*[A-Za-z].*[A-Za-z]{2}$"))
        .when(s["kind"] == 6, ~hit.rlike("^(?:000|666|9)|-00-|-0000$"))
        .otherwise(check_digits(hit))
    )


def features(s: Column) -> list[Column]:
    """Kind, format and context of a span, as doubles. None of them is a check's outcome."""
    hit = s["hit"]
    n = lambda rx: F.length(hit) - F.length(F.regexp_replace(hit, rx, ""))
    digits = F.split(F.substring(only_digits(hit), 1, 64), "")
    out = [s["kind"], F.length(hit), n("[0-9]"), n("[A-Za-z]"), n("[ ]"), n("[-]"), n("[.]"), n("[()]"), F.size(F.array_distinct(digits)), F.instr(hit, "@"), hit.startswith("+")]
    out += [F.length(F.substring_index(hit, ".", 1)), F.length(F.substring_index(hit, " ", 1)), F.length(F.substring_index(hit, ".", -1))]
    out += [F.contains(s["before"], F.lit(h)) for h in HINTS]
    out += [s["before"].rlike(r"[a-z0-9]$"), s["before"].rlike(r"[ \n]$"), s["after"].rlike(r"^[A-Za-z0-9]"), s["after"].rlike(r"^[ \n.,;]"), s["before"] == "", s["after"] == ""]
    return [c.cast("double") for c in out]


def boosted(labelled: DataFrame, trees: int, depth: int, seed: int) -> list[tuple[float, str]]:
    """Weights and descriptions of trees fitted to ``x`` and ``label``."""
    model = GBTClassifier(featuresCol="v", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5).fit(labelled.select(array_to_vector("x").alias("v"), "label"))
    return [(float(w), t.toDebugString) for w, t in zip(model.treeWeights, model.trees)]


def tree_column(description: str, x: Column) -> Column:
    """A fitted tree as an expression, from its lines 'If (feature i <= t)', 'Else', 'Predict: p'."""
    lines = iter([line.strip() for line in description.splitlines()[1:] if line.strip()])

    def node() -> Column:
        line = next(lines)
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1]))
        words = line.replace("(", " ").replace(")", " ").split()  # If feature i <= t
        low = node()
        next(lines)  # Else
        return F.when(F.get(x, F.lit(int(words[2]))) <= float(words[4]), low).otherwise(node())

    return node()


def score_column(trees: list[tuple[float, str]], x: Column) -> Column:
    """Probability of a span to be personal data."""
    margin = reduce(Column.__add__, [F.lit(float(w)) * tree_column(t, x) for w, t in trees])
    return 1 / (1 + F.exp(-2 * margin))


def detect(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    sample_docs: int = 4000,
    trees: int = 8,
    depth: int = 3,
    precision: float = 0.9,
    counted: int = 30,
    seed: int = 4,
) -> DataFrame:
    """``docs`` with ``pii``: spans (start, kind, end, sure; code points, end exclusive) by start.

    Generators propose spans, also overlapping ones: the contract's four kinds before their
    checks, and four looser kinds. A span of the four kinds that passes its check is sure. Each
    kind's check (ranges, check digits, numbers of digits) labels its proposals in four fifths
    of a bounded sample (the first ``sample_docs`` documents by a hash of id and text): boosted
    trees learn to tell the passing from the failing ones by kind, format and context alone.
    Over the proposals of all other documents the passing ones are counted by kind and score;
    the least score from which on a share of ``precision`` passes is a kind's threshold. A kind
    with fewer than ``counted`` such proposals takes the threshold of all kinds together.
    Proposals that aren't sure are selected (``sure`` false) from their kind's threshold on,
    unless they overlap a sure one. The trees run as expressions on all proposals of every whole
    text, without a shuffle. If the sample has no passing or no failing proposals, only sure
    spans are returned.

    A null text is empty and has no spans. Rows stay as they are, repeated ones and null ids
    included; a column ``pii`` is replaced. An empty table stays empty.
    """
    kept = [c for c in docs.columns if c.lower() != "pii"]
    t = text_of(text)
    numbers = range(len(GENERATORS))

    order = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), t)
    hashed = docs.select(order.alias("o"), t.alias("t"))
    learnt = lookup(hashed.select("o").distinct().orderBy("o").limit(sample_docs).where(F.pmod("o", F.lit(5)) != 0))
    labelled = lambda rows: rows.select(F.explode(F.concat(*[proposals(F.col("t"), i) for i in numbers])).alias("s")).select(F.col("s.kind").alias("kind"), F.array(*features(F.col("s"))).alias("x"), valid(F.col("s")).cast("double").alias("label"))
    sample = cut(labelled(hashed.join(learnt, "o", "left_semi").groupBy("o").agg(F.first("t").alias("t"))))
    fitted = boosted(sample, trees, depth, seed) if sample.select("label").distinct().count() == 2 else None
    limits: dict[int, float] = {}
    if fitted:
        rest = labelled(hashed.join(learnt, "o", "left_anti"))
        bins = rest.select("kind", "label", F.floor(score_column(fitted, F.col("x")) * 50).alias("bin")).groupBy("kind", "bin").agg(F.sum("label").alias("good"), F.count("*").alias("n"))
        by_kind: dict[int | None, dict[int, list[float]]] = {}
        for r in bins.collect():  # at most 51 rows a kind
            for kind in (r["kind"], None):
                total = by_kind.setdefault(kind, {}).setdefault(r["bin"], [0, 0])
                total[0], total[1] = total[0] + r["good"], total[1] + r["n"]

        def limit(of: dict[int, list[float]]) -> float:
            good = n = 0
            least = 2.0  # no score is so high
            for b in sorted(of, reverse=True):
                good, n = good + of[b][0], n + of[b][1]
                least = b / 50 if good >= precision * n else least
            return least

        limits = {k: limit(by_kind[k if sum(n for _, n in by_kind.get(k, {}).values()) >= counted else None]) for k in numbers} if by_kind else {}

    def selected(s: Column) -> Column:
        if not limits or min(limits.values()) > 1:
            return F.lit(False)
        least = F.element_at(F.array(*[F.lit(limits[k]) for k in numbers]), s["kind"] + 1)
        return F.when(least <= 1, once(F.array(*features(s)), lambda x: score_column(fitted, x)) >= least).otherwise(False)

    sure = lambda s: (s["kind"] < BASE_KINDS) & valid(s)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("_row"), F.concat(*[proposals(t, i) for i in numbers]).alias("_all"))
    short = lambda s, sure: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(sure).alias("sure"))
    rows = rows.withColumn("_sure", F.transform(F.filter("_all", sure), lambda s: short(s, True)))
    maybe = F.filter("_all", lambda s: ~sure(s) & selected(s) & ~F.exists("_sure", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.withColumn("_more", F.when(F.size("_all") > 0, F.transform(maybe, lambda s: short(s, False))).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,sure:boolean>>")))
    return rows.select(*[F.col("_row")[c].alias(c) for c in kept], F.array_sort(F.concat("_sure", "_more")).alias("pii"))
