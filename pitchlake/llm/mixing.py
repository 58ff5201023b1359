"""Mixing sources to target weights by hierarchical budgets (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_of

BIG = "decimal(38,0)"
FEW_LEAVES = 10_000  # of a tree, up to which its budgets are broadcast


def weight_of(level: Column, weights: Mapping[str, int], default: int) -> Column:
    """The whole-number weight of a node's name; other names get the default."""
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(level == name, F.lit(int(w))).otherwise(out)
    return out.cast(BIG)


def share_out(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Divide each parent's ``budget`` among its children by ``weight``, none above its ``cap``.

    What a full child leaves goes to its siblings in proportion to their weights. Whole numbers
    throughout: children in order of cap / weight are full as long as cap * weights left <=
    budget left * weight; the rest get the rounded-down share. A weight of 0 gets nothing.
    Returns ``nodes`` with ``given``.
    """
    group = list(parents) or [F.lit(0)]
    ranked = nodes.where("weight > 0").withColumn("_ratio", F.col("cap").cast("double") / F.col("weight").cast("double"))
    order = Window.partitionBy(*group).orderBy("_ratio", name)
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("_left", F.col("budget") - F.coalesce(F.sum("cap").over(earlier), F.lit(0)).cast(BIG))
        .withColumn("_weights", F.sum("weight").over(later).cast(BIG))
        .withColumn("_full", F.expr("cap * _weights <= _left * weight"))
    )
    whole = Window.partitionBy(*group)
    ranked = (
        ranked.withColumn("_rest", F.max("budget").over(whole) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(whole), F.lit(0)).cast(BIG))
        .withColumn("_of", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole).cast(BIG))
        .withColumn("given", F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("(cast(_rest as decimal(28,0)) * cast(weight as decimal(9,0))) div cast(_of as decimal(18,0))")).cast(BIG))
    )
    return ranked.drop("_ratio", "_left", "_weights", "_full", "_rest", "_of")


def mix(
    docs: DataFrame,
    levels: Sequence[Column],
    weights: Sequence[Mapping[str, int]],
    percent: int,
    max_epochs: int = 2,
    seed: int = 0,
    default_weight: int = 1,
    tokens: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Documents of a mix of ``percent`` per cent of the corpus's tokens, with ``copies``.

    ``levels`` are the tree's levels from the root down (domain, language, source); ``weights``
    has a whole-number weight by name for each. A leaf can give its tokens ``max_epochs`` times.
    Budgets go down the tree by ``share_out``: siblings take up a shortage first, and only what
    a whole subtree can't hold goes to the ancestors' other children. A leaf gives all its
    documents as often as its budget holds them all, and of one further epoch the documents
    whose running sum of tokens stays within what is left, in the order of md5(seed, epoch,
    doc_id), then of md5(text).

    The running sum needs no large group: tokens are added up by two bytes of the md5, the byte
    pair where the budget ends is found on those sums, and only its documents are put in order.

    Null names of a level form a node named ''; null doc_ids and texts count as empty; empty
    texts have 0 tokens and follow their place in the order; repeated rows are separate rows
    (equal in order, either may come first). An empty table gives an empty mix. Further columns
    of ``docs`` stay, whatever their names are, but for ``copies``, which is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != "copies"]
    keys = [f"_k{i}" for i in range(len(levels))]
    row = F.struct(*[docs[f"`{c}`"] for c in kept]).alias("_row")
    count = F.regexp_count(text_of(text), F.lit(WORD)) if tokens is None else F.coalesce(tokens, F.lit(0))
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    orders = [F.md5(F.concat(F.lit(f"{seed}:{e}:"), name)) for e in range(max_epochs)]
    flat = docs.select(
        row, count.cast("long").alias("_n"), *[F.coalesce(c.cast("string"), F.lit("")).alias(k) for c, k in zip(levels, keys)], F.array(*orders).alias("_md5")
    )

    leaves = cut(flat.groupBy(*keys).agg(F.sum("_n").alias("_tokens")))
    nodes = leaves.withColumn("cap", (F.col("_tokens") * max_epochs).cast(BIG))
    total = nodes.agg(F.expr(f"(cast(coalesce(sum(_tokens), 0) as decimal(28,0)) * {int(percent)}) div 100").alias("budget")).first()[0]
    given = None
    for i, key in enumerate(keys):
        above = keys[:i]
        here = nodes.groupBy(*keys[: i + 1]).agg(F.sum("cap").cast(BIG).alias("cap"))
        here = here.join(given, above) if above else here.withColumn("budget", F.lit(total).cast(BIG))
        here = here.withColumn("weight", weight_of(F.col(key), weights[i], default_weight))
        given = share_out(here, above, key).select(*keys[: i + 1], F.col("given").alias("budget"))
    plan = leaves.join(given, keys).withColumn("_whole", F.expr("if(_tokens > 0, cast(budget div _tokens as long), 0)"))
    plan = cut(plan.select(*keys, "_whole", (F.col("budget") - F.col("_whole") * F.col("_tokens")).cast("long").alias("_rest")))

    few = F.broadcast if plan.count() <= FEW_LEAVES else lambda table: table  # else a shuffled join
    placed = flat.join(few(plan), keys).withColumn("_order", F.expr(f"if(_whole < {max_epochs}, _md5[int(_whole)], '')"))
    placed = placed.withColumn("_b1", F.substring("_order", 1, 2)).withColumn("_b2", F.substring("_order", 3, 2))
    sums = cut(placed.where("_order <> ''").groupBy(*keys, "_rest", "_b1", "_b2").agg(F.sum("_n").alias("_n")))

    def boundary(table: DataFrame, bucket: str, before: str | None) -> DataFrame:
        """Each leaf's bucket in which the running sum passes ``_rest``, and the sum before it."""
        run = Window.partitionBy(*keys).orderBy(bucket)
        base = F.col(before) if before else F.lit(0)
        run_sum = table.withColumn("_upto", F.sum("_n").over(run) + base)
        over = run_sum.where("_upto > _rest").groupBy(*keys).agg(F.min(F.struct(F.col(bucket), (F.col("_upto") - F.col("_n")).alias("s"))).alias("m"))
        return over.select(*keys, F.col(f"m.{bucket}").alias(f"{bucket}_end"), F.col("m.s").alias(f"{bucket}_sum"))

    first = boundary(sums.groupBy(*keys, "_rest", "_b1").agg(F.sum("_n").alias("_n")), "_b1", None)
    inside = sums.join(first, keys).where("_b1 = _b1_end")
    second = boundary(inside, "_b2", "_b1_sum")
    ends = cut(first.join(second, keys).select(*keys, "_b1_end", "_b2_end", "_b2_sum"))

    placed = placed.join(few(ends), keys, "left")
    end = F.concat("_b1_end", "_b2_end")
    here = F.concat("_b1", "_b2")
    sure = (F.col("_order") == "") | F.col("_b1_end").isNull() | (here != end)
    extra = F.when(F.col("_order") == "", 0).when(F.col("_b1_end").isNull() | (here < end), 1).otherwise(0)
    certain = placed.where(sure).select("_row", (F.col("_whole") + extra).alias("copies"))
    edge = placed.where(~sure)
    order = Window.partitionBy(*keys).orderBy("_order", F.md5(text_of(f"_row.{text}")))
    edge = edge.withColumn("_upto", F.col("_b2_sum") + F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.select("_row", (F.col("_whole") + F.expr("int(_upto <= _rest)")).alias("copies"))
    chosen = certain.unionByName(edge).where("copies > 0")
    return chosen.select(*[F.col("_row")[c].alias(c) for c in kept], F.col("copies").cast("long").alias("copies"))
