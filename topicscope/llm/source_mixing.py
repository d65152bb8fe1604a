"""Mixing sources to target weights by entropy balancing [DataFrame functions only].

Rates r of documents minimise the entropy distance sum (r ln r - r) over the
documents from one copy each, under token constraints sum size * r = target for
every group of every constraint column (the sources; more columns may be
balanced at once) and r <= max_copies.  The convex dual has one multiplier a
group and gives exponentially tilted rates
r = min(max_copies, exp(size * sum of the document's multipliers)): where a
source must grow its long documents are repeated first, where it must shrink
they go first.  Documents of equal groups and size share a rate, so they are
counted into cells before anything is shuffled.  Newton steps on the dual run as
aggregates over the cells, all groups of a column at once (their curvature is
diagonal, as a document is in one group of a column), on the logarithm of the
group's words, which is nearly straight; with one column each group's bracket
guards its steps, with several the columns take turns until none misses its
targets.  The multipliers stay in tables; a dual that is not solved raises.

Rounding: a document gets floor(r) copies and one more if its keyed hash ranks
low enough.  The rank limit of each source is found on a histogram of the
hashes, refined inside the crossing bin, for large documents first; what they
leave over or short is passed on to the smaller ones, so a source's words end
within about half a small document of the target.

Defined results: null or empty text has size 0 and is taken 0 words; the null
source is a source (last); a source of size 0 has target 0; rows that repeat
an id or have none are rounded each by its own text, equal rows by their number
among themselves; an empty table gives no rows; other columns pass by.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage_table

GRID = 1024    # bins of a histogram level; two levels
SALTS = 256    # shares in which equal rows are numbered
EDGE = 1e6     # multiplier of a group whose documents are all at the ceiling (negative: at none)
#: Size classes relative to the source's mean size, large first.
CLASSES = (2.0, 0.25)


def sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, doc_id, source, g, size, h): words of each text; ``g`` is a key without nulls, ``h`` a hash of id, text and g.

    ``row`` is the rows' key: the column ``__mix_row`` if there is one, otherwise it is made here.
    """
    row = F.col("__mix_row") if "__mix_row" in docs.columns else F.monotonically_increasing_id()
    g = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    # a hash passes nulls over: say which are null
    h = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col), g)
    return docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), g.alias("g"),
                       F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), h.alias("h"))


def numbered(d: DataFrame) -> DataFrame:
    """Adds ``number``: 0, 1, ... among the rows of equal ``h``.

    Counted inside salted shares, so that a hash on a third of the rows is not
    one task; which equal row has which number does not matter.
    """
    d = d.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    before = F.sum("n").over(Window.partitionBy("h").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))   # <= SALTS rows each
    shares = d.groupBy("h", "salt").agg(F.count("*").alias("n")).select("h", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("h", "salt").orderBy("row")) - 1
    return d.withColumn("inside", inside).join(shares, ["h", "salt"]).withColumn("number", F.col("before") + F.col("inside")).drop("salt", "inside", "before")


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Sources by code point, null last, take the weights in turn (one row a source)."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))


def capped_targets(sources: DataFrame, total_share: float, max_copies: float) -> DataFrame:
    """Adds ``target``: shares of ``total_share`` of all sizes by weight, none above ``max_copies`` times its source.

    The resharing of excess ends where target = min(cap, t * weight); t is read
    off the sources in order of cap / weight.
    """
    cap, by = F.col("source_size") * max_copies, Window.orderBy("ratio", "g")
    s = sources.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = (s.withColumn("below", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("left", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(1))) * total_share)
         .withColumn("t", (F.col("total") - F.col("below")) / F.col("left")))
    level = s.where(F.col("ratio") > F.col("t")).agg(F.min_by("t", F.struct("ratio", "g")).alias("level"))
    return (s.crossJoin(F.broadcast(level))   # one row
            .withColumn("target", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap"))
                        .otherwise(F.col("level") * F.col("weight")))
            .select("g", "source_size", "weight", "target"))


def tilted_rate(size: Column, multipliers: list[Column], max_copies: float) -> Column:
    theta = F.least(size * reduce(add, multipliers), F.lit(math.log(max_copies)))
    return F.exp(F.greatest(theta, F.lit(-700.0)))


def balance(cells: DataFrame, constraints: dict[str, DataFrame], max_copies: float, *, tolerance: float = 1e-9, max_rounds: int = 200) -> dict[str, DataFrame]:
    """The dual's solution: column -> (column, multiplier).

    ``cells``: constraint columns, size, n.  ``constraints``: column -> (column,
    target).  A group without words has multiplier 0; one whose target is at its
    ceiling, or 0, has all its documents at the ceiling, or at none.
    """
    words, cap = F.col("n") * F.col("size"), float(max_copies)
    state, alone = {}, len(constraints) == 1
    for name, target in constraints.items():
        mass = cells.groupBy(name).agg(F.sum(words).cast("double").alias("mass"), F.sum(words * F.col("size")).cast("double").alias("square"))
        goal = F.coalesce(F.col("target").cast("double"), F.lit(0.0))
        fixed = F.when(F.col("mass") <= 0, 0.0).when(goal >= F.col("mass") * cap * (1 - 1e-12), EDGE).when(goal <= 0, -EDGE)
        first = F.coalesce(fixed, F.log(goal / F.col("mass")) * F.col("mass") / F.col("square"))
        none = F.lit(None).cast("double")
        state[name] = stage_table(mass.join(target.select(name, "target"), name, "left").select(
            name, goal.alias("goal"), fixed.isNotNull().alias("fixed"), first.alias("multiplier"), none.alias("low"), none.alias("high")), "mixing-dual")
    for _ in range(max_rounds):
        worst = 0.0
        for name in constraints:
            rows = cells
            for other, now in state.items():
                rows = rows.join(now.select(other, F.col("multiplier").alias(f"m_{other}")), other)
            multipliers = [F.col(f"m_{c}") for c in state]
            theta = F.col("size") * reduce(add, multipliers)
            rate = tilted_rate(F.col("size"), multipliers, cap)
            got = rows.groupBy(name).agg(F.sum(words * rate).alias("got"),
                                         F.sum(F.when(theta < math.log(cap), words * F.col("size") * rate).otherwise(0.0)).alias("curve"))
            m = F.col("multiplier")
            low = F.when(F.col("got") <= F.col("goal"), m).otherwise(F.col("low")) if alone else F.col("low")
            high = F.when(F.col("got") > F.col("goal"), m).otherwise(F.col("high")) if alone else F.col("high")
            s = state[name].join(got, name).withColumn("low", low).withColumn("high", high)
            # Newton on ln got; without curvature all documents are at the ceiling and the multiplier must fall
            gap = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.log(F.col("goal") / F.greatest(F.col("got"), F.lit(1e-300)))))
            newton = m + F.coalesce(F.try_divide(gap * F.col("got"), F.col("curve")), -F.abs(m) / 2)
            inside = (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
            step = F.when(inside, newton).otherwise((F.coalesce("low", m - F.abs(m) - 1) + F.coalesce("high", m + F.abs(m) + 1)) / 2)
            miss = F.abs(F.col("got") - F.col("goal")) / F.greatest("goal", F.lit(1.0))
            s = s.select(name, "goal", "fixed", F.when(F.col("fixed") | (miss <= tolerance), m).otherwise(step).alias("multiplier"), "low", "high",
                         F.when(~F.col("fixed"), miss).alias("miss"))
            s = stage_table(s, "mixing-dual")
            worst = max(worst, s.agg(F.max("miss")).first()[0] or 0.0)
            state[name] = s.drop("miss")
        if worst <= tolerance:
            return {name: s.select(name, "multiplier") for name, s in state.items()}
    raise ArithmeticError(f"the targets cannot be met together: a group is {worst:.3g} of its target away after {max_rounds} rounds")


def _crossing(hist: DataFrame, bin_col: str, prefix: str) -> DataFrame:
    """Per g: the bin in which the running words pass ``need``, words before it and in it.

    The histogram has at most GRID rows a source.
    """
    by = Window.partitionBy("g").orderBy(bin_col)
    run = hist.withColumn("upto", F.sum("words").over(by)).withColumn("before", F.col("upto") - F.col("words"))
    hit = run.where((F.col("before") <= F.col("need")) & (F.col("upto") > F.col("need")))
    return hit.groupBy("g").agg(F.min(bin_col).alias(f"{prefix}_bin"), F.min("before").alias(f"{prefix}_before"),
                                F.min_by("words", bin_col).alias(f"{prefix}_words"))


def rounded_copies(rated: DataFrame, max_copies: int, seed: int = 13) -> DataFrame:
    """Adds ``copies``.  ``rated``: h, number, g, size, rate, mean (the source's mean size)."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("h"), F.col("number")), 11) / F.lit(float(1 << 53))
    d = (rated.withColumn("base", F.least(F.floor("rate"), F.lit(max_copies)).cast("int"))
         .withColumn("frac", F.when(F.col("base") >= max_copies, F.lit(0.0)).otherwise(F.col("rate") - F.col("base")))
         .withColumn("rank", F.least(F.floor((u - F.col("frac") + 1) / 2 * GRID * GRID), F.lit(GRID * GRID - 1)).cast("long"))
         .withColumn("class", F.when(F.col("size") > F.col("mean") * CLASSES[0], 0).when(F.col("size") > F.col("mean") * CLASSES[1], 1).otherwise(2)))
    d = stage_table(d, "mixing-ranked")
    open_ = d.where((F.col("base") < max_copies) & (F.col("size") > 0))
    carry, limits = None, None
    for c in range(len(CLASSES) + 1):
        own = open_.where(F.col("class") == c).withColumn("b1", F.shiftright("rank", 10)).withColumn("b2", F.col("rank").bitwiseAND(GRID - 1))
        need = own.groupBy("g").agg(F.sum(F.col("size") * F.col("frac")).alias("want"), F.sum("size").cast("double").alias("all"))
        if carry is not None:
            need = need.join(carry, "g", "full").select("g", (F.coalesce("want", F.lit(0.0)) + F.coalesce("carry", F.lit(0.0))).alias("want"),
                                                        F.coalesce("all", F.lit(0.0)).alias("all"))
        need = stage_table(need.withColumn("need", F.greatest("want", F.lit(0.0))), "mixing-need")
        one = _crossing(own.groupBy("g", "b1").agg(F.sum("size").cast("double").alias("words")).join(need.select("g", "need"), "g"), "b1", "one")
        inner = own.join(one, "g").where(F.col("b1") == F.col("one_bin"))
        two = inner.groupBy("g", "b2").agg(F.sum("size").cast("double").alias("words")).join(
            need.join(one, "g").select("g", (F.col("need") - F.col("one_before")).alias("need")), "g")
        two = _crossing(two, "b2", "two")
        picked = need.join(one, "g", "left").join(two, "g", "left")
        at = F.coalesce(F.col("one_before") + F.col("two_before"), F.col("all"))   # nothing crosses: all are taken
        more = F.coalesce(F.col("need") - at > F.col("two_words") / 2, F.lit(False))
        limit = F.coalesce(F.col("one_bin") * GRID + F.col("two_bin") + F.when(more, 1).otherwise(0), F.lit(GRID * GRID)).cast("long")
        picked = stage_table(picked.select("g", F.lit(c).alias("class"), limit.alias("limit"),
                                           (F.col("want") - at - F.when(more, F.col("two_words")).otherwise(0.0)).alias("carry")), "mixing-limits")
        carry = picked.select("g", "carry")
        limits = picked.select("g", "class", "limit") if limits is None else limits.unionByName(picked.select("g", "class", "limit"))
    extra = (F.col("base") < max_copies) & (F.col("size") > 0) & (F.col("rank") < F.coalesce("limit", F.lit(0)))
    return d.join(limits, ["g", "class"], "left").withColumn("copies", F.col("base") + F.when(extra, 1).otherwise(0))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] | DataFrame = (5, 2, 1), total_share: float = 1.5, max_copies: int = 2, seed: int = 13) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for every row.

    ``weights``: cyclic weights of the sources by code point, or a table (source, weight).
    """
    return mix_by_row(docs, id_col=id_col, text_col=text_col, source_col=source_col, weights=weights, total_share=total_share,
                      max_copies=max_copies, seed=seed).drop("row")


def mix_by_row(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple[float, ...] | DataFrame = (5, 2, 1), total_share: float = 1.5, max_copies: int = 2, seed: int = 13) -> DataFrame:
    """``mix`` with the rows' key ``row``."""
    d = stage_table(sizes(docs, id_col=id_col, text_col=text_col, source_col=source_col), "mixing-sizes")
    sources = d.groupBy("g", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    if isinstance(weights, DataFrame):
        w = weights.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("g"), F.col("weight").cast("double"))
        named = sources.join(w, "g", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    else:
        named = cyclic_weights(sources, tuple(weights))
    goal = stage_table(capped_targets(named, total_share, float(max_copies)), "mixing-targets")
    cells = stage_table(d.where("size > 0").groupBy("g", "size").agg(F.count("*").alias("n")), "mixing-cells")
    dual = balance(cells, {"g": goal.select("g", "target")}, float(max_copies))["g"]
    facts = sources.select("g", (F.col("source_size") / F.col("n")).alias("mean")).join(goal.select("g", "source_size", "target"), "g").join(dual, "g", "left")
    rated = numbered(d).join(facts, "g").withColumn("rate", tilted_rate(F.col("size"), [F.coalesce("multiplier", F.lit(0.0))], float(max_copies)))
    return (rounded_copies(rated, max_copies, seed)
            .select("row", "doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "rate", "copies",
                    (F.col("copies") * F.col("size")).cast("long").alias("taken")))


def mixed_rows(docs: DataFrame, **kw) -> DataFrame:
    """The documents of the mix, all columns, each row as often as ``mix`` copies that row.

    Rows are told apart by a key that is written with them (columns starting with ``__mix`` are reserved).
    """
    rows = stage_table(docs.withColumn("__mix_row", F.monotonically_increasing_id()), "mixing-rows")
    copies = mix_by_row(rows, **kw).where("copies > 0").select(F.col("row").alias("__mix_row"), F.col("copies").alias("__mix_copies"))
    out = rows.join(copies, "__mix_row")
    return out.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*docs.columns)
