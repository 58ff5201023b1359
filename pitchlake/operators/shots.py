"""Shots as a model sees them, and their chances: linear or boosted, chosen by folds of matches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# The categories of a shot; the last one or the named default stands for any other.
BODY_PARTS = ("foot", "head", "other")
SHOT_TYPES = ("open_play", "free_kick", "corner")
TECHNIQUES = ("normal", "volley", "half_volley", "lob", "backheel", "overhead", "diving_header")
PATTERNS = ("regular", "counter", "corner", "free_kick", "throw_in", "goal_kick", "keeper", "kick_off", "other")
ASSISTS = ("none", "ground", "low", "high", "through_ball", "cross", "cut_back")
CATEGORIES = {"body_part": BODY_PARTS, "shot_type": SHOT_TYPES, "technique": TECHNIQUES, "pattern": PATTERNS, "assist": ASSISTS}
NUMBERS = ("distance", "angle", "under_pressure", "first_time", "one_on_one", "open_goal", "follows_dribble", "defenders_in_cone", "players_in_cone", "keeper_to_shooter", "keeper_off_line", "keeper_off_centre", "nearest_defender")


def snake(name: Column) -> Column:
    """A provider's name as lower case words joined by underscores."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s-]+", "_")


def among(value: Column, values: Sequence[str], default: str) -> Column:
    return F.when(value.isin(*values), value).otherwise(default)


def body_part(name: Column) -> Column:
    n = snake(name)
    return F.when(n == "head", "head").when(n.isin("right_foot", "left_foot"), "foot").otherwise("other")


def shot_type(name: Column) -> Column:
    return among(snake(name), SHOT_TYPES, "open_play")


def technique(name: Column) -> Column:
    return among(snake(name), TECHNIQUES, "normal")


def pattern(name: Column) -> Column:
    """How the play began: 'From Counter' is a counter, 'Regular Play' regular."""
    return among(F.regexp_replace(F.regexp_replace(snake(name), "^from_", ""), "^regular_play$", "regular"), PATTERNS, "other")


def assist(key_pass: Column) -> Column:
    """The set-up class of the pass before a shot: a struct of technique and height (names),
    through_ball, cut_back and cross (flags); null for a shot without one."""
    told = lambda c: F.coalesce(key_pass[c], F.lit(False))
    height = F.regexp_extract(snake(key_pass["height"]), "^(ground|low|high)_pass$", 1)
    return (
        F.when(key_pass.isNull(), "none")
        .when(told("through_ball") | F.coalesce(snake(key_pass["technique"]) == "through_ball", F.lit(False)), "through_ball")
        .when(told("cut_back"), "cut_back")
        .when(told("cross"), "cross")
        .otherwise(F.when(height != "", height).otherwise("ground"))
    )


def with_assists(shots: DataFrame, passes: DataFrame, key_pass: str, pass_id: str) -> DataFrame:
    """``shots`` with ``assist``: the class of the pass they name, joined by its id."""
    p = passes.select(F.col(pass_id).alias("_id"), F.struct("technique", "height", "through_ball", "cut_back", "cross").alias("_pass"))
    return shots.join(p, F.col(key_pass) == F.col("_id"), "left").withColumn("assist", assist(F.col("_pass"))).drop("_id", "_pass")


def one_hot(df: DataFrame, categories: Mapping[str, Sequence[str]] = CATEGORIES) -> tuple[DataFrame, list[str]]:
    """``df`` with a 0/1 column ``<c>_<value>`` for each value of each category, and their names."""
    columns = {f"{c}_{v}": (F.coalesce(F.col(c) == v, F.lit(False))).cast("double") for c, values in categories.items() for v in values}
    return df.withColumns(columns), list(columns)


@dataclass(frozen=True)
class Setting:
    """Logistic regression with a ridge (``trees`` 0), or that many boosted trees."""

    name: str
    trees: int = 0
    depth: int = 3
    step: float = 0.1
    ridge: float = 1e-3

    def fit(self, rows: DataFrame):
        from pyspark.ml.classification import GBTClassifier, LogisticRegression

        if not self.trees:
            return LogisticRegression(featuresCol="_v", labelCol="_y", regParam=self.ridge, maxIter=100).fit(rows)
        return GBTClassifier(featuresCol="_v", labelCol="_y", maxIter=self.trees, maxDepth=self.depth, stepSize=self.step, subsamplingRate=0.8, minInstancesPerNode=5, seed=0).fit(rows)


#: The settings that folds choose among.
SETTINGS = (
    Setting("logistic, strong ridge", ridge=1e-2),
    Setting("logistic", ridge=1e-3),
    Setting("boosted, depth 3", 300, 3, 0.05),
    Setting("boosted, depth 4", 300, 4, 0.05),
    Setting("boosted, slow", 600, 3, 0.03),
)


def _chance(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("xg", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def log_loss(scored: DataFrame, goal: str = "_y", chance: str = "xg") -> Column:
    p = F.least(F.greatest(F.col(chance), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.avg(-F.when(F.col(goal) == 1, F.ln(p)).otherwise(F.ln(1 - p)))


def shot_chances(shots: DataFrame, match: str, features: Sequence[str], goal: str, training: Column, penalty: Column, settings: Sequence[Setting] = SETTINGS, folds: int = 5) -> tuple[DataFrame, list[tuple[str, float]]]:
    """(``shots`` with ``xg``, each setting's name and log loss over the folds).

    Folds are of whole matches, dealt by a hash. The setting with the least loss over all folds is
    chosen (the first of equals). Shots to train on get the chance of the fold that left their
    match out; all others that of a model of all shots to train on. Penalties are no shots for a
    model: theirs is the share of training penalties that went in (null without any). ``training``
    and ``penalty`` are conditions; null counts as false. Shots with a null feature have none.
    """
    from pyspark.ml.feature import VectorAssembler

    flags = shots.withColumn("_train", F.coalesce(training, F.lit(False))).withColumn("_penalty", F.coalesce(penalty, F.lit(False))).withColumn("_y", F.col(goal).cast("double"))
    rate = flags.where("_penalty and _train").agg(F.avg("_y")).first()[0]
    open_play = flags.where("not _penalty")
    rows = cut(VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip").transform(open_play.withColumn("_fold", F.pmod(F.xxhash64(match), F.lit(folds)).cast("int"))))
    known = rows.where("_train and _y is not null")
    scored, losses = {}, []
    for s in settings:
        parts = [_chance(s.fit(known.where(F.col("_fold") != k)), known.where(F.col("_fold") == k)) for k in range(folds) if known.where(F.col("_fold") == k).limit(1).count() and known.where(F.col("_fold") != k).select("_y").distinct().count() == 2]
        if parts:
            scored[s.name] = cut(reduce(DataFrame.unionByName, parts))
            losses.append((s.name, float(scored[s.name].agg(log_loss(scored[s.name])).first()[0])))
    names = shots.columns
    out = flags.where("_penalty").select(*names, F.lit(rate).cast("double").alias("xg"))
    blank = open_play.join(rows.select(*names).distinct(), names, "left_anti").select(*names, F.lit(None).cast("double").alias("xg")) if not losses else None
    if blank is not None:
        return out.unionByName(blank).unionByName(rows.select(*names, F.lit(None).cast("double").alias("xg"))), losses
    best = min(losses, key=lambda x: x[1])[0]
    others = _chance(next(s for s in settings if s.name == best).fit(known), rows.where("not _train or _y is null"))
    whole = scored[best].select(*names, "xg").unionByName(others.select(*names, "xg"))
    skipped = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="keep")
    missing = reduce(lambda a, b: a | b, [F.col(f).isNull() | F.isnan(F.col(f).cast("double")) for f in skipped.getInputCols()])
    return out.unionByName(whole).unionByName(open_play.where(missing).select(*names, F.lit(None).cast("double").alias("xg"))), losses
