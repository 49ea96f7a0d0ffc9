"""Exact ranks and quantiles of keys of any size, from counts on two levels.

Approximate quantiles only deal values out: their error moves work between tasks,
never the result. Counts of the ranges below a value are added to what is counted
inside its range, so neither a key nor a value that very many rows share has to
be in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookflow.sources.tables import shared_folder

#: Rows that a range of a key is meant to have, and ranges of a key at most.
ROWS_PER_RANGE, RANGES = 100_000, 256
#: Keys of so many values are taken whole; for others, the error of the approximate quantiles is one over ACCURACY.
SMALL, ACCURACY = 100_000, 10_000
#: Bounds are searched by the ends of runs of so many bounds, then inside a run.
RUN = 16
#: Parts that the rows of one hot value, or without a value, are dealt to.
SALTS = 64
#: Facts of so many keys at most are broadcast; a key's facts are a row of bounded width.
BROADCAST_KEYS = 1000


def joined(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table on keys that may be NULL. Facts of few keys should be `settled`, or a key's rows are sorted in one task."""
    other = table.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = [df[k].eqNullSafe(other[f"__of_{k}"]) for k in keys]
    return df.join(other, same, how).drop(*[f"__of_{k}" for k in keys])


def settled(facts: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """A table of one row for each key, written to the shared folder and read back, with a broadcast hint if it has few rows.

    AQE doesn't broadcast a table whose few keys leave most partitions of its
    exchange empty, and a join on such keys sorts all rows of a key in one task.
    """
    spark = facts.sparkSession
    path = f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
    facts.write.parquet(path)
    stored = spark.read.schema(facts.schema).parquet(path)
    return F.broadcast(stored) if stored.limit(most + 1).count() <= most else stored


def range_bounds(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row for each key: for the i-th value, __b{i} (ordered bounds of its ranges, none for a key with few rows) and __e{i} (ends of runs of bounds)."""
    points = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    facts = df.groupBy(*keys).agg(*[x for i, v in enumerate(values) for x in (F.percentile_approx(v, points, F.lit(10 * RANGES)).alias(f"__p{i}"), F.count(v).alias(f"__n{i}"))])
    cut, runs = {}, {}
    for i in range(len(values)):
        wanted = F.least(F.lit(RANGES), F.ceil(F.col(f"__n{i}") / ROWS_PER_RANGE))
        every = F.greatest(F.lit(1), F.floor(RANGES / F.greatest(wanted, F.lit(1)))).cast("int")
        chosen = F.when(wanted > 1, F.array_distinct(F.filter(f"__p{i}", lambda _, k: (k + 1) % every == 0)))  # noqa: B023
        cut[f"__b{i}"] = F.coalesce(chosen, F.array().cast("array<double>"))
        runs[f"__e{i}"] = F.filter(f"__b{i}", lambda _, k: (k + 1) % RUN == 0)
    return facts.select(*keys, *[c.alias(n) for n, c in cut.items()]).withColumns(runs)


def _code(value: Column, i: int) -> Column:
    """Twice the number of bounds below the value, and 1 more if it is a bound itself; NULL for NULL."""
    runs = F.size(F.filter(f"__e{i}", lambda e: e < value)) * RUN
    below = runs + F.size(F.filter(F.slice(f"__b{i}", runs + 1, RUN), lambda e: e < value))
    on = F.coalesce(F.get(f"__b{i}", below) == value, F.lit(False))
    return F.when(value.isNotNull(), 2 * below + on.cast("int"))


def _flag(value: str, condition: Column | None = None) -> Column:
    v = F.col(value).isNotNull()
    return F.when(v if condition is None else v & condition, 1).otherwise(0).cast("long")


def rank_facts(source: DataFrame, keys: Sequence[str], values: dict[str, dict[str, Column]]) -> DataFrame:
    """One row for each key with what its rows need: for the i-th value its bounds, and __t{i}, an ordered array of its codes.

    An entry of __t{i} has a code, and for the k-th flag of the value c{k}, its flagged rows, and o{k}, those of lower codes.
    """
    bounds = settled(range_bounds(source, keys, list(values)))
    width = max(map(len, values.values()))
    flags = [[*fs.values(), *[F.lit(0).cast("long")] * (width - len(fs))] for fs in values.values()]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), _code(F.col(v), i).alias("code"), *[f.alias(f"c{k}") for k, f in enumerate(fs)]) for i, (v, fs) in enumerate(zip(values, flags, strict=True))])
    cut = joined(source, bounds.filter(reduce(lambda a, b: a | b, [F.size(f"__b{i}") > 0 for i in range(len(values))])), keys)  # keys in one range need no counts
    counts = cut.select(*keys, F.inline(cells)).filter("code is not null").groupBy(*keys, "i", "code").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(width)])
    upto = Window.partitionBy(*keys).orderBy("i", "code").rowsBetween(Window.unboundedPreceding, -1)
    entry = F.struct("i", "code", *[x for k in range(width) for x in (f"c{k}", f"o{k}")])
    tables = counts.withColumns({f"o{k}": F.coalesce(F.sum(f"c{k}").over(upto), F.lit(0)) for k in range(width)}).groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("__t"))
    of = lambda i: F.filter("__t", lambda e: e["i"] == i)
    return joined(bounds, tables.select(*keys, *[of(i).alias(f"__t{i}") for i in range(len(values))]), keys, "left")


def _coded(df: DataFrame, facts: DataFrame, keys: Sequence[str], values: dict[str, dict[str, Column]]) -> DataFrame:
    """Adds to each row its code of the i-th value, and for the k-th flag __c{i}_{k}, the flagged rows of this code, and __o{i}_{k}, those of lower codes."""
    codes, new = {}, {}
    for i, (v, flags) in enumerate(values.items()):
        codes[f"__code{i}"] = _code(F.col(v), i)
        codes[f"__at{i}"] = F.get(f"__t{i}", F.array_position(F.col(f"__t{i}.code"), codes[f"__code{i}"]).cast("int") - 1)
        for k in range(len(flags)):
            new[f"__c{i}_{k}"] = F.col(f"__at{i}")[f"c{k}"]
            new[f"__o{i}_{k}"] = F.coalesce(F.col(f"__at{i}")[f"o{k}"] - F.get(f"__t{i}", F.lit(0))[f"o{k}"], F.lit(0))
    return joined(df, facts, keys).withColumns(codes).withColumns(new).drop(*[f"__{c}{i}" for i in range(len(values)) for c in ("b", "e", "t", "at")])


def _on_bound(i: int) -> Column:
    """Is the i-th value a bound? Its rows need no order."""
    return F.coalesce(F.col(f"__code{i}") % 2 == 1, F.lit(False))


def _rank_of_bound(i: int, k: int) -> Column:
    return F.col(f"__o{i}_{k}") + (F.col(f"__c{i}_{k}") + 1) / 2.0


def _ranked(coded: DataFrame, keys: Sequence[str], i: int, value: str, flags: dict[str, Column]) -> DataFrame:
    """Adds one rank for each flag of the i-th value to coded rows."""
    given, v, code = coded.columns, F.col(value), F.col(f"__code{i}")
    # the rows of a bound need no order, those without a value no rank: they are spread
    plain = [c for c in given if not c.startswith("__")]
    salt = F.when(code.isNull() | _on_bound(i), F.pmod(F.xxhash64(*plain), F.lit(SALTS))).otherwise(0)
    flagged = coded.withColumns({"__salt": salt} | {f"__f{k}": f for k, f in enumerate(flags.values())})
    part = [*keys, f"__code{i}", "__salt"]
    upto_peers, peers = Window.partitionBy(*part).orderBy(v.asc_nulls_last()), Window.partitionBy(*part, value)
    n = range(len(flags))
    counted = flagged.withColumns({f"__le{k}": F.sum(f"__f{k}").over(upto_peers) for k in n} | {f"__eq{k}": F.sum(f"__f{k}").over(peers) for k in n})
    rank = lambda k: F.when(_on_bound(i), _rank_of_bound(i, k)).otherwise(F.col(f"__o{i}_{k}") + F.col(f"__le{k}") - (F.col(f"__eq{k}") - 1) / 2.0)
    return counted.select(*given, *[F.when(F.col(f"__f{k}") == 1, rank(k)).alias(name) for k, name in enumerate(flags)])


def _ranked_apart(df: DataFrame, facts: DataFrame, keys: Sequence[str], value: str, flags: dict[str, Column]) -> DataFrame:
    """Adds one rank for each flag of the only value: rows of bounds are looked up and stay where they are, like rows without the value; others are exchanged and sorted."""
    of = lambda x, k: F.col("__x")[f"{x}{k}"]
    known = [(of("o", k) - F.get("__t0", F.lit(0))[f"o{k}"] + (of("c", k) + 1) / 2.0).alias(f"__r{k}") for k in range(len(flags))]
    entries = facts.select(*keys, "__b0", "__t0", F.explode("__t0").alias("__x")).filter(F.col("__x.code") % 2 == 1)
    bounds = settled(entries.select(*keys, F.get("__b0", F.floor(F.col("__x.code") / 2).cast("int")).alias(value), F.lit(True).alias("__hot"), *known), BROADCAST_KEYS * RANGES)
    looked = joined(df, bounds, [*keys, value], "left")
    between = F.col(value).isNotNull() & F.col("__hot").isNull()
    still = looked.filter(~between).select(*df.columns, *[F.when(f == 1, F.col(f"__r{k}")).alias(name) for k, (name, f) in enumerate(flags.items())])
    others = _coded(looked.filter(between).select(*df.columns), facts, keys, {value: flags})
    return still.unionByName(_ranked(others, keys, 0, value, flags).select(*still.columns))


def any_larger(df: DataFrame, keys: Sequence[str], most: int | None = None) -> bool:
    """Whether a key has more than `most` rows (ROWS_PER_RANGE unless given): one count, of which one row reaches the driver."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return not sizes.filter(F.col("__n") > (ROWS_PER_RANGE if most is None else most)).isEmpty()


def _whole_ranks(df: DataFrame, keys: Sequence[str], values: dict[str, dict[str, Column]]) -> DataFrame:
    """Ranks of keys that are a range each: one exchange for all values."""
    out = df
    for v, flags in values.items():
        upto, peers, n = Window.partitionBy(*keys).orderBy(F.col(v).asc_nulls_last()), Window.partitionBy(*keys, v), range(len(flags))
        counted = out.withColumns({f"__f{k}": f for k, f in enumerate(flags.values())})
        counted = counted.withColumns({f"__le{k}": F.sum(f"__f{k}").over(upto) for k in n} | {f"__eq{k}": F.sum(f"__f{k}").over(peers) for k in n})
        rank = lambda k: F.when(F.col(f"__f{k}") == 1, F.col(f"__le{k}") - (F.col(f"__eq{k}") - 1) / 2.0)
        out = counted.select(*out.columns, *[rank(k).alias(name) for k, name in enumerate(flags)])
    return out


def _with_ranks(df: DataFrame, source: DataFrame, keys: Sequence[str], values: dict[str, dict[str, Column]], large: bool | None) -> DataFrame:
    if not (any_larger(source, keys) if large is None else large):
        return _whole_ranks(df, keys, values)
    facts = settled(rank_facts(source, keys, values))
    if len(values) == 1:  # rows are read twice; with more values that would double for each
        ((v, flags),) = values.items()
        return _ranked_apart(df, facts, keys, v, flags)
    out = _coded(df, facts, keys, values)
    for i, (v, flags) in enumerate(values.items()):
        out = _ranked(out, keys, i, v, flags)
    return out.drop(*[f"__code{i}" for i in range(len(values))], *[f"__{c}{i}_{k}" for i, flags in enumerate(values.values()) for k in range(len(flags)) for c in "co"])


def masked_ranks(df: DataFrame, keys: Sequence[str], value: str, names: dict[str, Column | None], source: DataFrame | None = None, large: bool | None = None) -> DataFrame:
    """Adds ranks of one value: for each name, among the key's rows that meet its condition (None: all rows).

    Ranks count from 1, ties share their mean rank; rows without the value or against
    the condition get NULL. `source` may give the same rows without columns that are
    costly and not needed for counting. `large` as in average_ranks.
    """
    return _with_ranks(df, df if source is None else source, keys, {value: {n: _flag(value, c) for n, c in names.items()}}, large)


def average_ranks(df: DataFrame, keys: Sequence[str], names: dict[str, str], large: bool | None = None) -> DataFrame:
    """Adds the rank of each value column (value: name) among the key's rows, from 1, ties sharing their mean rank; NULL for NULL.

    Values are dealt to ranges between approximate quantiles. A value that very
    many rows share is a bound; its rows are ranked by counts alone. Other rows
    are ranked inside their range, after the counts of the ranges below. Bounds
    and counts of all columns take one pass each. `large` tells whether a key has
    more than ROWS_PER_RANGE rows; if no key has, each is one range. Unless given, rows are counted.
    """
    return _with_ranks(df, df, keys, {v: {n: _flag(v)} for v, n in names.items()}, large)


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank", large: bool | None = None) -> DataFrame:
    """average_ranks of one column."""
    return average_ranks(df, keys, {value: name}, large)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str = "q", large: bool | None = None) -> DataFrame:
    """One row for each key: `name`, the quantiles of the value by linear interpolation; NULL without values.

    Selection by counts: approximate quantiles bracket every rank that is asked
    for. Values outside the brackets are only counted; those inside are counted by
    value, and running counts find the value that holds the rank. `large` tells
    whether a key has more than SMALL rows; if none has, a key's values are few
    enough for one buffer. Unless given, rows are counted.
    """
    if not (any_larger(df, keys, SMALL) if large is None else large):
        return df.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(p)) for p in probs])).alias(name))
    v, margin, n_probs = F.col(value).cast("double"), 3 / ACCURACY, len(probs)
    order = sorted(range(n_probs), key=lambda i: probs[i])
    ends = [x for i in order for x in (max(probs[i] - margin, 0.0), min(probs[i] + margin, 1.0))]
    facts = settled(df.groupBy(*keys).agg(F.count(v).alias("__n"), F.percentile_approx(v, F.array(*map(F.lit, ends)), F.lit(ACCURACY)).alias("__ends")))
    large = F.col("__n") > SMALL
    bound = lambda k: F.when(large & F.lit(0.0 < ends[k] < 1.0), F.col("__ends")[k])
    bracketed = facts.select(*keys, "__n", F.array(*[bound(2 * k) for k in range(n_probs)]).alias("__from"), F.array(*[bound(2 * k + 1) for k in range(n_probs)]).alias("__to"))
    # a zone is told by the brackets that end below a value; it is in a bracket if more have begun
    passed = F.size(F.filter("__to", lambda e: e < F.col("__v")))
    begun = F.size(F.filter("__from", lambda e: e.isNull() | (e <= F.col("__v"))))
    rows = joined(df.select(*keys, v.alias("__v")), bracketed, keys).select(*keys, "__n", "__v", passed.alias("__zone"), (begun > passed).alias("__in"))
    cells = rows.filter("__v is not null").groupBy(*keys, "__zone", "__in", F.when(F.col("__in"), F.col("__v")).alias("__v")).agg(F.count(F.lit(1)).alias("__c"), F.max("__n").alias("__n"))
    zones = cells.groupBy(*keys, "__zone", "__in").agg(F.sum("__c").alias("__m"))
    before = Window.partitionBy(*keys).orderBy("__zone", "__in").rowsBetween(Window.unboundedPreceding, -1)
    offsets = zones.select(*keys, "__zone", "__in", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__o")).filter("__in").drop("__in")
    upto = F.col("__o") + F.sum("__c").over(Window.partitionBy(*keys, "__zone").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    placed = joined(cells.filter("__in"), offsets, [*keys, "__zone"]).withColumn("__hi", upto).withColumn("__lo", F.col("__hi") - F.col("__c"))
    at = [(F.col("__n") - 1) * F.lit(float(p)) for p in probs]
    held = lambda k: F.max(F.when((F.col("__lo") <= k) & (k < F.col("__hi")), F.col("__v")))
    found = placed.groupBy(*keys).agg(F.max("__n").alias("__n"), *[x for i, a in enumerate(at) for x in (held(F.floor(a)).alias(f"__a{i}"), held(F.ceil(a)).alias(f"__z{i}"))])
    missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
    one = lambda i, a: F.when(F.col(f"__a{i}").isNull() | F.col(f"__z{i}").isNull(), missed).when(F.col(f"__a{i}") == F.col(f"__z{i}"), F.col(f"__a{i}")).otherwise(
        (F.ceil(a) - a) * F.col(f"__a{i}") + (a - F.floor(a)) * F.col(f"__z{i}")
    )
    values = found.select(*keys, F.array(*[one(i, a) for i, a in enumerate(at)]).alias(name))
    return joined(facts.select(*keys), values, keys, "left")


def nth_values(df: DataFrame, keys: Sequence[str], value: str, nth: str) -> DataFrame:
    """One row for each key: __v, its value at place `nth` in order (from 1, the same on all rows of the key; values are set), __left, how many rows of this value are up to that place, and __same, its rows.

    Rows are counted by ranges, then values by value in the one range that holds the place.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"), F.col(nth).alias("__nth"))
    coded = joined(rows, settled(range_bounds(rows, keys, ["__v"])), keys).select(*keys, "__v", "__nth", _code(F.col("__v"), 0).alias("__code"))

    def reached(by: str, source: DataFrame) -> DataFrame:
        counts = source.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("__c"), F.max("__nth").alias("__nth"))
        before = F.sum("__c").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
        left = counts.withColumn("__left", F.col("__nth") - F.coalesce(before, F.lit(0)))
        return left.filter((F.col("__left") > 0) & (F.col("__left") <= F.col("__c")))

    held = settled(reached("__code", coded).select(*keys, F.col("__code").alias("__in"), F.col("__left").alias("__nth")))
    inside = joined(coded.drop("__nth"), held, keys).filter(F.col("__code") == F.col("__in"))
    return reached("__v", inside).select(*keys, "__v", "__left", F.col("__c").alias("__same"))
