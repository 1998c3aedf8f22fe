"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source is due the same number of copies, target / source size. The whole part is taken outright; the
fractional parts are rounded by the pivotal method. Two parties at a time trade words: mass moves from one to the other, in
a random direction whose odds keep both expectations, until one of the two is a whole copy or none; it is settled, and the
other goes on. As words and not copies are traded, the words taken stay the same at every step, so a source misses its
target by less than the one document that is left at the end.

The reduction is a tree. Documents of a source are dealt by a seeded hash into blocks of about ``FAN`` units; each block
settles all but at most one unit; what is left of ``FAN`` blocks meets in a block of the next level. At the first level all
units of a block have the same probability, so the largest trades with the pool of all smaller ones, then the next largest:
what is left is small. Further up units trade in pairs. A hot source only has more blocks, and no task ever holds more than
a block.

Defined results: documents are units by (source, id, size): rows equal in all three share one decision and weigh together.
Null sources are a source of their own, which comes last; null texts have size 0; units of size 0 move no mass and are
drawn alone at their source's rate. A source without words has target 0. Empty tables give empty results. All draws are
hashes of the seed, level and unit, so reruns agree, whatever the partitioning. Columns named as the operator's output are
replaced; other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gramsieve.llm.common import cut, without

#: Units that meet in a block of the reduction tree, on average.
FAN = 256
#: Copies of a document at most.
MOST = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: A copy probability this near to 0 or 1 is whole.
NEAR = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, source_size, n_units), one row a source: adds ``target``, a share of all words by weight that stops at
    ``most`` times the source's words; what is over goes to the others by weight.

    Sources ordered by words per weight reach their stop in that order, so one running sum finds the last that does. The
    windows are over one row a source.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size").cast("double") * most)
    whole = W.partitionBy(F.lit(1))
    before = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumns({"all": F.sum("source_size").over(whole).cast("double"), "all_w": F.sum("w").over(whole)})
    x = x.withColumns({"c0": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w0": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    x = x.withColumn("stopped", F.col("cap") * (F.col("all_w") - F.col("w0")) < (F.col("all") - F.col("c0")) * F.col("w"))
    x = x.withColumns({k: F.coalesce(F.sum(F.when(F.col("stopped"), F.col(c))).over(whole), F.lit(0.0)) for k, c in (("c1", "cap"), ("w1", "w"))})
    level = (F.col("all") - F.col("c1")) / F.nullif(F.col("all_w") - F.col("w1"), F.lit(0.0))
    target = F.when(F.col("stopped"), F.col("cap")).otherwise(F.least(level * F.col("w"), F.col("cap")))
    return x.select("source", "source_size", "n_units", F.coalesce(target, F.lit(0.0)).alias("target"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and gives it to ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


_UNIT = "struct<doc_id:bigint,size:bigint,words:double,p:double>"


def _unit(u: Column, p: Column) -> Column:
    return F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["words"].alias("words"), p.alias("p"))


def _whole(p: Column) -> Column:
    return F.when(p < NEAR, 0.0).when(p > 1 - NEAR, 1.0).otherwise(p)


def _is_whole(p: Column) -> Column:
    return (p == 0.0) | (p == 1.0)


def _none() -> list[Column]:
    return [F.lit(None).cast(_UNIT).alias("left"), F.array().cast(f"array<{_UNIT}>").alias("done")]


def _trade(a: Column, p: Column, b: Column, q: Column, draw: Column) -> Column:
    """The words that a party of a words at probability p gains from one of b words at q; negative if it gives."""
    up, down = F.least((1 - p) * a, q * b), F.least(p * a, (1 - q) * b)
    return _let(F.struct(up.alias("up"), down.alias("down")), lambda m: F.when(draw * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"]))


def _pool(units: Column, seed: int) -> Column:
    """Folds a block of units that share one p, largest first; each trades with all that come after it.

    {p: the pool's probability, mass: its words, left: a unit that isn't whole or null, done: settled units}.
    """

    def step(acc: Column, u: Column) -> Column:
        p, rest = acc["p"], acc["mass"] - u["words"]

        def settled(p: Column) -> Column:
            return F.struct(p.alias("p"), rest.alias("mass"), acc["left"].alias("left"), F.concat(acc["done"], F.array(_unit(u, p))).alias("done"))

        def after(x: Column) -> Column:
            own = F.concat(acc["done"], F.array(_unit(u, x["u"])))
            return F.when(_is_whole(x["u"]), F.struct(x["rest"].alias("p"), rest.alias("mass"), acc["left"].alias("left"), own.alias("done"))).otherwise(
                F.struct(x["rest"].alias("p"), rest.alias("mass"), _unit(u, x["u"]).alias("left"), acc["done"].alias("done"))
            )

        draw = _uniform(F.lit(seed), F.lit("pool"), u["doc_id"], u["size"])
        traded = _let(_trade(u["words"], p, rest, p, draw), lambda d: F.struct(_whole(p + d / u["words"]).alias("u"), _whole(p - d / rest).alias("rest")))
        alone = F.struct(p.alias("p"), rest.alias("mass"), _unit(u, p).alias("left"), acc["done"].alias("done"))
        return F.when(_is_whole(p), settled(p)).when(rest < 0.5, alone).otherwise(_let(traded, after))

    first = F.get(units, F.lit(0))["p"]
    mass = F.aggregate(units, F.lit(0.0), lambda a, u: a + u["words"])
    return F.aggregate(units, F.struct(first.alias("p"), mass.alias("mass"), *_none()), step)


def _pairs(units: Column, seed: int, level: int) -> Column:
    """Folds a block of units in pairs: {left: the unit that isn't whole or null, done: settled units}."""

    def step(acc: Column, u: Column) -> Column:
        a = acc["left"]
        draw = _uniform(F.lit(seed), F.lit(level), a["doc_id"], a["size"], u["doc_id"], u["size"])
        two = _let(_trade(a["words"], a["p"], u["words"], u["p"], draw), lambda d: F.array(_unit(a, _whole(a["p"] + d / a["words"])), _unit(u, _whole(u["p"] - d / u["words"]))))
        met = _let(
            two,
            lambda x: F.struct(
                F.get(F.filter(x, lambda v: ~_is_whole(v["p"])), F.lit(0)).alias("left"), F.concat(acc["done"], F.filter(x, lambda v: _is_whole(v["p"]))).alias("done")
            ),
        )
        return F.when(a.isNull(), F.struct(u.alias("left"), acc["done"].alias("done"))).otherwise(met)

    return F.aggregate(units, F.struct(*_none()), step)


def decide(units: DataFrame, seed: int = 0, fan: int = FAN) -> DataFrame:
    """From (source, doc_id, size, n, rate, n_units), n rows alike a unit: adds ``copies``."""
    units = units.withColumn("base", F.floor(F.col("rate") + NEAR).cast("long"))
    units = units.withColumn("p", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    whole = (F.col("p") <= NEAR) | (F.col("size") == 0)
    alone = F.when(F.col("p") <= NEAR, 0).otherwise(F.when(_uniform(F.lit(seed), F.col("doc_id"), F.col("source")) < F.col("p"), 1).otherwise(0))
    settled = units.filter(whole).select("source", "doc_id", "size", alone.cast("double").alias("p"))
    left = units.filter(~whole).select("source", "doc_id", "size", (F.col("size") * F.col("n")).cast("double").alias("words"), "p", F.ceil(F.col("n_units") / fan).alias("blocks"))
    most = units.agg(F.max("n_units")).head()[0] or 1
    level = 0
    while True:
        last = most <= fan
        block = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size"), F.col("blocks"))
        item = F.struct((-F.col("words")).alias("order"), "doc_id", "size", "words", "p")
        folded = left.groupBy("source", block.alias("block"), "blocks").agg(F.sort_array(F.collect_list(item)).alias("u"))
        folded = folded.withColumn("u", F.transform("u", lambda x: _unit(x, x["p"])))
        fold = _pairs(F.col("u"), seed, level) if level else _pool(F.col("u"), seed)
        folded = folded.select("source", "blocks", F.explode(F.array(fold)).alias("f"))
        if not last:
            folded = cut(folded)
        done = folded.select("source", F.inline("f.done")).select("source", "doc_id", "size", "p")
        rest = folded.filter("f.left IS NOT NULL").select("source", "f.left.*", F.ceil(F.col("blocks") / fan).alias("blocks"))
        settled = settled.unionByName(done)
        if last:
            draw = _uniform(F.lit(seed), F.lit("last"), F.col("doc_id"), F.col("size"))
            settled = settled.unionByName(rest.select("source", "doc_id", "size", F.when(draw < F.col("p"), 1.0).otherwise(0.0).alias("p")))
            return settled
        left, level, most = rest, level + 1, -(-most // fan)


def mix(df: DataFrame, size: Column | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``copies`` (0 to 3) and ``taken`` (words, repeats counted) to the documents.

    ``size`` is the words of the text unless given.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    df = df.withColumn("__n", n_words(F.col(text)) if size is None else size)
    units = cut(df.groupBy(F.col(source).alias("source"), F.col(doc_id).cast("long").alias("doc_id"), F.col("__n").alias("size")).agg(F.count("*").alias("n")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.count("*").alias("n_units"))
    goals = cut(targets(sizes))
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    g = goals.select(F.col("source").alias("__gs"), "source_size", "n_units", "target", rate.alias("rate"))
    rated = units.join(g, F.col("source").eqNullSafe(F.col("__gs")), "inner").drop("__gs")
    bits = decide(rated.select("source", "doc_id", "size", "n", "rate", "n_units"), seed)
    b = bits.select(F.col("source").alias("__bs"), F.col("doc_id").alias("__bd"), F.col("size").alias("__bz"), F.col("p").alias("__p"))
    out = without(df, added) if {source.lower(), doc_id.lower()}.isdisjoint(added) else df
    out = out.join(b, out[source].eqNullSafe(F.col("__bs")) & out[doc_id].cast("long").eqNullSafe(F.col("__bd")) & (F.col("__n") == F.col("__bz")), "inner")
    g = goals.select(F.col("source").alias("__gs"), "source_size", "target", (F.floor(rate + NEAR)).cast("long").alias("__base"))
    out = out.join(g, out[source].eqNullSafe(F.col("__gs")), "inner")
    out = out.withColumn("copies", F.col("__base") + F.col("__p").cast("long")).withColumn("size", F.col("__n"))
    return out.withColumn("taken", F.col("size") * F.col("copies")).drop("__n", "__bs", "__bd", "__bz", "__p", "__gs", "__base")


def repeat(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """Each document as often as the mix takes it; those taken no times go."""
    name = "__copy"
    return mixed.withColumn(name, F.explode(F.when(F.col(copies) > 0, F.sequence(F.lit(1), F.col(copies).cast("int"))))).drop(name)
