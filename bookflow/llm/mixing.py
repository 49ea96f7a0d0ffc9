"""Iterative proportional fitting of token weights to source, language and topic marginals.

Documents are summed into cells (source, lang, topic) first; the fit works on
cells, so its size follows the number of different triples, not of documents.
Each round scales the mass of the cells to the target of one dimension after
another, but never above the cell's tokens: a cell that reaches them is kept
whole, and the other cells of the same value make up for it in later rounds. The
fitted mass over the observed one is the probability with which each of the
cell's documents is kept. `unmet` reports what a target still lacks, which is
more than rounding only where the tokens don't suffice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookflow.llm.common import forget, small_or_not, stored

DIMENSIONS = ("source", "lang", "topic")
#: Exponents of the default targets: a value's target share goes with its observed share to this power.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Topics by a mark in the text, tried in this order; texts without one are prose.
TOPIC_MARKS = (("table", " | "), ("symbols", "%%%"), ("shouting", "!! "), ("license", "icense"))
ROUNDS = 40
BLOCK = 5
KEEP = 0.7
#: Cells fitted in one partition without shuffles, if they are counted to be no more than this.
ONE_TASK_CELLS = 200_000
NONE = "(none)"


def n_tokens(text: Column) -> Column:
    """Words between single spaces or line ends; 1 at least, so that no cell is without mass."""
    bare = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.coalesce(F.octet_length(text) - F.octet_length(bare) + 1, F.lit(1)).cast("long")


def topic_of(text: Column) -> Column:
    found = F.lit("prose")
    for name, mark in reversed(TOPIC_MARKS):
        found = F.when(F.contains(text, F.lit(mark)), F.lit(name)).otherwise(found)
    return found


def unit_interval(doc_id: Column, text: Column, seed: int) -> Column:
    """A fixed number in [0, 1) for a document: the same on every run and partitioning."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit("")))), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def measured(docs: DataFrame, seed: int, topic: Column | None = None) -> DataFrame:
    """doc_id, tokens, the three dimensions and the sampling number of each row; no text."""
    return docs.select(
        F.col("doc_id"),
        n_tokens(F.col("text")).alias("tokens"),
        F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"),
        (topic_of(F.col("text")) if topic is None else topic).alias("topic"),
        unit_interval(F.col("doc_id"), F.col("text"), seed).alias("draw"),
    )


def tempered(cells: DataFrame, dimension: str, exponent: float) -> DataFrame:
    """Default targets of one dimension: observed token shares to a power, scaled to sum to 1."""
    seen = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("seen"))
    powered = seen.select(dimension, F.pow(F.col("seen"), F.lit(float(exponent))).alias("p"))
    whole = powered.agg(F.sum("p").alias("whole"))
    return powered.join(F.broadcast(whole)).select(dimension, (F.col("p") / F.col("whole")).alias(f"to_{dimension}"))


def rake(cells: DataFrame, keep: float = KEEP, rounds: int | None = None) -> DataFrame:
    """Fit the cells' mass to their targets to_<dimension> of `keep` of all tokens, in rounds, none above its tokens.

    Adds mass, weight (mass over the part `keep` of the cell's tokens) and
    probability. Cells whose number is checked to be small stay in one partition,
    which every window below accepts as it is; more cells are summed by each
    dimension and joined with the sums.
    """
    n, rounds = cells.count(), ROUNDS if rounds is None else rounds
    budget = keep * (cells.agg(F.sum("tokens").cast("double").alias("t")).first()["t"] or 0.0)
    fitted, before = cells.withColumn("mass", F.col("tokens") * F.lit(float(keep))), None
    for done in range(0, rounds, BLOCK):
        fitted = fitted.coalesce(1) if n <= ONE_TASK_CELLS else fitted
        for _ in range(min(BLOCK, rounds - done)):
            for d in DIMENSIONS:
                if n <= ONE_TASK_CELLS:
                    fitted = fitted.withColumn("__now", F.sum("mass").over(Window.partitionBy(d)))
                else:
                    fitted = fitted.join(fitted.groupBy(d).agg(F.sum("mass").alias("__now")), d)
                aimed = F.when(F.col("__now") > 0, F.col("mass") * F.col(f"to_{d}") * F.lit(budget) / F.col("__now")).otherwise(F.lit(0.0))
                fitted = fitted.withColumn("mass", F.least(F.col("tokens").cast("double"), aimed)).drop("__now")
        fitted = stored(fitted, "mixing-mass")
        if before is not None:
            forget(before)
        before = fitted
    return fitted.withColumns({"weight": F.col("mass") / (F.col("tokens") * F.lit(float(keep))), "probability": F.col("mass") / F.col("tokens")})


def unmet(fitted: DataFrame) -> DataFrame:
    """dimension, value, target and share of the fitted mass for every value of raked cells."""
    whole = fitted.agg(F.sum("mass").alias("whole"))
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col(f"to_{d}").alias("target")) for d in DIMENSIONS])
    sums = fitted.select("mass", F.inline(cells)).groupBy("dimension", "value").agg(F.max("target").alias("target"), F.sum("mass").alias("mass"))
    return sums.join(F.broadcast(whole)).select("dimension", "value", "target", (F.col("mass") / F.col("whole")).alias("share"))


def fitted_cells(rows: DataFrame, keep: float, targets: dict[str, DataFrame] | None) -> DataFrame:
    """The raked cells with their targets, mass, weight and probability."""
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mixing-cells")
    aimed = cells
    for d in DIMENSIONS:
        given = (targets or {}).get(d)
        to = tempered(cells, d, TEMPER[d]) if given is None else given.toDF(d, f"to_{d}")
        aimed = aimed.join(to, d, "left").withColumn(f"to_{d}", F.coalesce(F.col(f"to_{d}"), F.lit(0.0)))
    return rake(stored(aimed, "mixing-targets"), keep)


def mix(docs: DataFrame, keep: float = KEEP, targets: dict[str, DataFrame] | None = None, seed: int = 17, topic: Column | None = None) -> DataFrame:
    """Sample documents so that the kept tokens follow target shares of source, language and topic.

    `targets` may give a table (value, share) per dimension, shares summing to 1;
    the others get tempered shares (TEMPER). Returns doc_id, tokens, source, lang,
    topic, weight, probability and kept for every row.

    * null text has 1 token and is prose; null source or lang is the value "(none)"
    * a value without a target gets no mass: its rows have probability 0
    * a target without rows, or of more tokens than there are, can't be met: all tokens of the value are kept, and `unmet` shows the gap
    * rows with a null id draw by their text; repeated rows draw alike
    * ties: a row is kept if its draw is below its share, so rows with equal draws in one cell go together
    * very long texts count by their words and are held whole by the task that reads them
    * an empty table gives no rows; other columns of the input are ignored
    """
    rows = measured(docs, seed, topic)
    table = fitted_cells(rows, keep, targets).select(*DIMENSIONS, "weight", "probability")
    return rows.join(small_or_not(table), list(DIMENSIONS)).select(
        "doc_id", "tokens", *DIMENSIONS, F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), (F.col("draw") < F.col("probability")).alias("kept")
    )


def sampled(docs: DataFrame, keep: float = KEEP, targets: dict[str, DataFrame] | None = None, seed: int = 17, topic: Column | None = None) -> DataFrame:
    """The rows that `mix` keeps, with all their columns."""
    table = fitted_cells(measured(docs, seed, topic), keep, targets)
    table = table.select(*[F.col(d).alias(f"__mix_{d}") for d in DIMENSIONS], F.col("probability").alias("__mix_p"))
    label = {
        "source": F.coalesce(docs["source"].cast("string"), F.lit(NONE)),
        "lang": F.coalesce(docs["lang"].cast("string"), F.lit(NONE)),
        "topic": topic_of(docs["text"]) if topic is None else topic,
    }
    rows = docs.withColumns({f"__own_{d}": c for d, c in label.items()})
    same = [F.col(f"__own_{d}") == F.col(f"__mix_{d}") for d in DIMENSIONS]
    kept = rows.join(small_or_not(table), same).filter(unit_interval(docs["doc_id"], docs["text"], seed) < F.col("__mix_p"))
    return kept.select(*[docs[c] for c in docs.columns])


def oracle(keep: float = KEEP, seed: int = 17) -> str:
    """The same fit as DuckDB SQL, with every round written out."""
    topic = "CASE " + " ".join(f"WHEN contains(text, '{mark}') THEN '{name}'" for name, mark in TOPIC_MARKS) + " ELSE 'prose' END"
    parts = [
        f"""r AS (SELECT doc_id, coalesce(strlen(text) - strlen(replace(replace(text, ' ', ''), chr(10), '')) + 1, 1)::BIGINT AS tokens,
            coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, {topic} AS topic,
            ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, '')) || ':{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
            FROM documents)""",
        "c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM r GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        parts.append(f"p_{d} AS (SELECT {d}, pow(sum(tokens), {TEMPER[d]}::DOUBLE) AS p FROM c GROUP BY {d})")
        parts.append(f"t_{d} AS (SELECT {d}, p / (SELECT sum(p) FROM p_{d}) AS to_{d} FROM p_{d})")
    parts.append(f"m0 AS MATERIALIZED (SELECT c.*, tokens * {keep}::DOUBLE AS mass, to_source, to_lang, to_topic FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    k = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            parts.append(f"m{k + 1} AS MATERIALIZED (SELECT * REPLACE (least(tokens, mass * to_{d} * (SELECT {keep}::DOUBLE * sum(tokens) FROM c) / sum(mass) OVER (PARTITION BY {d})) AS mass) FROM m{k})")
            k += 1
    parts.append(f"q AS (SELECT source, lang, topic, mass / (tokens * {keep}::DOUBLE) AS weight, mass / tokens AS probability FROM m{k})")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT doc_id, r.tokens, source, lang, topic, round(weight, 9) AS weight, round(probability, 9) AS probability, draw < probability AS kept FROM r JOIN q USING (source, lang, topic)"
    )
