"""Mixing sources to target weights by iterative proportional fitting, DataFrame operations only.

Documents fall into cells of source, language and topic.  Token weights of the cells are raked to
target marginals of the three, ``ROUNDS`` times in turn; each cell's sampling probability is then the raked weight
per token, scaled so that the expected tokens are ``KEEP`` of the input, and no probability exceeds one (what
is cut off goes to the other cells).  A document is in the sample if a number hashed from its id falls below
its cell's probability, so the sample does not depend on partitions or order.

Without given targets a marginal is tempered: shares to the power ``TEMPER``, which lifts small groups.
Topics, where the table has none, go by words: in each language, of the words of ``TOPIC_LETTERS`` letters or more that at most ``TOPIC_SHARE``
of its documents have, the ``TOPICS`` most widespread ones.  A document's topic is the place (from 1) of the rarest of them that it has, or 0;
so every language has every topic, and no topic stands for a language.

The cells are counted before anything is dealt by key, so a hot source is a sum from each task.  A table of at most ``FEW`` cells
is raked in one task and broadcast; a larger one is raked by sums of each axis joined back, and its probabilities are found by repeated sums.

Defined results: null or empty texts have no tokens and topic 0, and their probability is that of their cell, or one if the cell has no tokens; null source
or language is a group of its own; repeated rows share their fate; null ids share one number; an empty table gives an empty result; other columns pass
through, but one that bears the name of a result gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import small
from .store import Store, col

ROUNDS, KEEP, TEMPER, FEW = 10, 0.5, 0.5, 50_000
TOPICS, TOPIC_LETTERS, TOPIC_SHARE, SEED = 8, 10, 0.1, 17
AXES = ("source", "lang", "topic")
_MADE = ("topic", "source", "lang", "tokens", "weight", "probability", "sampled")


def tokens(text: Column) -> Column:
    """Words by white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), "")


def _long_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[^ \t\n\x0B\f\r]{{{TOPIC_LETTERS},}}"), F.lit(0))


def topics(placed: DataFrame, number: int = TOPICS, share: float = TOPIC_SHARE) -> DataFrame:
    """_lang, _places, _named: the topic words of each language, the rarest first. placed: _lang and _long (long words)."""
    words = placed.select("_lang", F.explode(F.array_distinct("_long")).alias("word")).groupBy("_lang", "word").agg(F.count("*").alias("n"))
    words = words.join(small(placed.groupBy("_lang").agg((F.count("*") * share).alias("most"))), "_lang").filter("n <= most")
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("n"), "word"))
    top = words.withColumn("place", place).filter(F.col("place") <= number)
    return top.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("place", "word")), asc=False).alias("t")).select("_lang", F.col("t.place").alias("_places"), F.col("t.word").alias("_named"))


def with_cells(docs: DataFrame, store: Store, text_col: str = "text", topic_col: str | None = None) -> DataFrame:
    """docs with _tokens and the cell columns _source, _lang, _topic. The topic words are found once and kept."""
    none = F.lit("")
    found = docs.withColumns({"_source": F.coalesce("source", none), "_lang": F.coalesce("lang", none)})
    if topic_col:
        topic = F.coalesce(col(topic_col).cast("string"), none)
    else:
        named = store.keep(topics(found.select("_lang", _long_words(col(text_col)).alias("_long"))), "topics")
        found = found.join(small(named), "_lang", "left")
        # keeps the order of the first
        first = F.get(F.array_intersect("_named", _long_words(col(text_col))), F.lit(0))
        topic = F.coalesce(F.get("_places", (F.array_position("_named", first) - 1).cast("int")), F.lit(0)).cast("string")
    return found.select(*map(col, docs.columns), F.size(tokens(col(text_col))).cast("long").alias("_tokens"), "_source", "_lang", topic.alias("_topic"))


def _total(df: DataFrame, value: str, name: str) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(F.sum(value).alias(name))))


def _rake_by_sums(cells: DataFrame, targets: dict[str, dict[str, float]] | None, rounds: int, temper: float, store: Store) -> DataFrame:
    """``rake`` for many cells: the sums of an axis are an aggregation joined back, and every round is written."""
    now = cells.withColumn("weight", F.when(F.col("tokens") > 0, F.col("tokens").cast("double")).otherwise(0.0))
    wishes = {}
    for axis in AXES:
        sums = now.groupBy(axis).agg(F.sum("weight").alias("s"))
        wish = _wish(axis, F.pow(F.col("s"), F.lit(temper)), targets)
        wishes[axis] = store.keep(_total(sums.withColumn("wish", wish), "wish", "all").select(axis, F.try_divide("wish", "all").alias(f"to_{axis}")), "wish")
    for _ in range(rounds):
        for axis in AXES:
            factor = now.groupBy(axis).agg(F.sum("weight").alias("s")).join(wishes[axis], axis).select(axis, F.try_divide(f"to_{axis}", "s").alias("f"))
            now = now.join(factor, axis).withColumn("weight", F.coalesce(F.col("weight") * F.col("f"), F.lit(0.0))).select(*AXES, "tokens", "weight")
        now = store.keep(now, "round")
    return _total(now, "weight", "all").withColumn("weight", F.coalesce(F.try_divide("weight", "all"), F.lit(0.0))).drop("all")


def _calibrate_by_sums(raked: DataFrame, keep: float, store: Store) -> DataFrame:
    """``calibrate`` for many cells: cells whose probability reaches one leave the rest more to share, until none does."""
    now = store.keep(raked, "raked")
    rate = F.coalesce(F.try_divide("weight", "tokens"), F.lit(0.0))
    budget = (now.agg(F.sum("tokens")).first()[0] or 0) * keep
    scale, live = None, F.lit(True)
    while True:
        full, rest = now.agg(F.coalesce(F.sum(F.when(~live, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(live, F.col("weight"))), F.lit(0.0))).first()
        new = max(budget - full, 0.0) / rest if rest > 1e-12 else None
        if new is None or new == scale:
            scale = new if new is not None else scale
            break
        scale, live = new, rate * F.lit(new) <= 1.0
    whole = F.lit(1.0) if scale is None else F.least(F.lit(1.0), F.lit(scale) * rate)
    return now.select(*AXES, "tokens", "weight", F.when(F.col("tokens") == 0, 1.0).otherwise(whole).alias("probability"))


def _wish(axis: str, tempered: Column, targets: dict[str, dict[str, float]] | None) -> Column:
    given = (targets or {}).get(axis)
    if not given:
        return tempered
    wish = F.lit(0.0)
    for name, share in given.items():
        wish = F.when(F.col(axis) == name, float(share)).otherwise(wish)
    return wish


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, temper: float = TEMPER, store: Store | None = None) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight, which sums to 1 and has the target marginals as far as the cells allow.

    For few cells: one task has all. With a store, the plan is cut every ten rounds."""
    now = cells.coalesce(1)
    everything = Window.partitionBy(F.lit(0))
    live = F.col("tokens") > 0
    now = now.withColumn("weight", F.when(live, F.col("tokens").cast("double")).otherwise(0.0))
    for axis in AXES:
        one = Window.partitionBy(axis)
        now = now.withColumn("_wish", _wish(axis, F.pow(F.sum("weight").over(one), F.lit(temper)), targets))
        # each value of the axis counts once, whatever its number of cells
        lead = F.when(F.row_number().over(one.orderBy(*AXES)) == 1, F.col("_wish")).otherwise(0.0)
        now = now.withColumn("_lead", lead).withColumn(f"to_{axis}", F.try_divide("_wish", F.sum("_lead").over(everything))).drop("_wish", "_lead")
    for i in range(rounds):
        if store and i and i % 10 == 0:
            now = store.keep(now, "round").coalesce(1)
        for axis in AXES:
            now = now.withColumn("weight", F.coalesce(F.col("weight") * F.try_divide(F.col(f"to_{axis}"), F.sum("weight").over(Window.partitionBy(axis))), F.lit(0.0)))
    return now.withColumn("weight", F.coalesce(F.try_divide("weight", F.sum("weight").over(everything)), F.lit(0.0)))


def calibrate(raked: DataFrame, keep: float = KEEP) -> DataFrame:
    """probability of each cell: the least of 1 and scale * weight / tokens, with the scale that keeps the expected share of tokens.

    Cells in order of weight per token: the first j are kept whole and the rest share what is left of the budget; j is the first number for which no
    probability of the rest exceeds one."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("rate"), *AXES).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    now = raked.withColumn("rate", F.coalesce(F.try_divide("weight", "tokens"), F.lit(0.0)))
    now = now.withColumns({"_before": F.coalesce(F.sum("tokens").over(order), F.lit(0)), "_rest": 1.0 - F.coalesce(F.sum("weight").over(order), F.lit(0.0)), "_all": F.sum("tokens").over(everything)})
    scale = F.try_divide(F.greatest(F.col("_all") * keep - F.col("_before"), F.lit(0.0)), "_rest")
    now = now.withColumn("_scale", F.when(F.col("_rest") > 1e-12, scale))
    ok = F.col("_scale") * F.col("rate") <= 1.0
    now = now.withColumn("_scale", F.first(F.when(ok, F.col("_scale")), ignorenulls=True).over(everything.orderBy(F.desc("rate"), *AXES).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    p = F.when(F.col("tokens") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("_scale") * F.col("rate"), F.lit(1.0))))
    return now.select(*AXES, "tokens", "weight", p.alias("probability"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None, keep: float = KEEP, rounds: int = ROUNDS, temper: float = TEMPER, few: int = FEW) -> DataFrame:
    """docs with _topic, _tokens, _weight (of the cell), _probability, _sampled."""
    store = Store(docs.sparkSession, "mix")
    docs = docs.drop(*[f"_{c}" for c in _MADE])
    placed = with_cells(docs, store, text_col, topic_col)
    axes = [F.col(f"_{a}").alias(a) for a in AXES]
    cells = store.keep(placed.groupBy(*axes).agg(F.sum("_tokens").alias("tokens")), "cells")
    fit = cells.count() <= few
    found = calibrate(rake(cells, targets, rounds, temper, store), keep) if fit else _calibrate_by_sums(_rake_by_sums(cells, targets, rounds, temper, store), keep, store)
    plan = store.keep(found, "plan").select(*[F.col(a).alias(f"_{a}") for a in AXES], F.col("weight").alias("_weight"), F.col("probability").alias("_probability"))
    found = placed.join(F.broadcast(plan) if fit else plan, [f"_{a}" for a in AXES], "left")
    # the first 52 bits of a digest of the id
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return found.select(*map(col, docs.columns), "_topic", "_tokens", "_weight", "_probability", (number < F.col("_probability")).alias("_sampled"))
