"""Benchmark decontamination by template windows.

Texts become lower-cased words, and beside them templates, in which numbers,
names and units are typed placeholders. Windows of WINDOW words are hash-joined
with those of the benchmark items in two ways:

* a verbatim window has the item's words, in any case;
* a template window has the item's template, so a question whose numbers or
  names were changed still matches. It must hold a slot and PLAIN plain words at
  least: a window of little but slots, as in a table of numbers, says nothing and
  counts only where it is verbatim.

Template windows on one diagonal (a place in the document less a place in the
item) must agree about their slots: each value of the item stands for one value
of the document, the one it meets most often there. Windows against that are left
out, the other windows of the diagonal stay.

A first pass looks for an item's probes in each document, from distinct keys and
at every word; a word pair that starts no probe is skipped by a bit table of a
fixed size. The probes are an item's windows but for the NEEDED - 1 that most other
items share, so who holds the item holds a probe; a window of very many items is a
probe of few, and its documents don't meet them all. Then the windows of the pairs
found are counted, and those of the pairs with enough are aligned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookflow.llm.common import forget, small_or_not, stored, weight

WINDOW = 8
#: Windows of an item that must be met in a document: a run of 13 words, or all of a shorter item.
NEEDED = 6
#: Plain words of a template window, at least.
PLAIN = 3
#: Entries of the table of word pairs that start a window of some item.
TABLE = 1 << 15
#: Placeholders of the template; no word has the mark.
NUMBER, NAME, UNIT = "#number", "#name", "#unit"
# Units of measurement.
UNITS = ("kg", "g", "mg", "km", "m", "cm", "mm", "mi", "ft", "lb", "oz", "l", "ml", "s", "ms", "min", "h", "hours", "hour", "minutes", "minute",
         "seconds", "days", "day", "years", "miles", "meters", "metres", "grams", "liters", "litres", "usd", "eur", "dollars", "euros", "percent")
# Written-out numbers.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen",
                "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million")
# Words that are no names where they open a sentence.
FUNCTION_WORDS = ("a", "an", "and", "are", "as", "at", "because", "but", "by", "can", "did", "do", "does", "each", "every", "find", "for", "from", "given", "had", "has", "have", "he", "her",
                  "his", "how", "if", "in", "is", "it", "its", "let", "many", "more", "most", "much", "no", "not", "of", "on", "or", "she", "so", "some", "suppose", "than", "that", "the",
                  "their", "then", "there", "these", "they", "this", "to", "was", "we", "were", "what", "when", "where", "which", "while", "who", "why", "will", "with", "would", "you")

RESULT = "doc_id long, text_hash long, item_id long, matched_windows long, item_windows long, n_slots long"


def split_words(text: Column) -> Column:
    """Runs of letters and digits; separators inside numbers are taken out, a unit glued to its number is cut off."""
    text = F.regexp_replace(text, r"(\d)[.,](\d)", "$1$2")
    text = F.regexp_replace(text, rf"(\d)({'|'.join(UNITS)})\b", "$1 $2")
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def lowered(words: Column) -> Column:
    return F.transform(words, lambda w: F.lower(w))


def template(words: Column, low: Column) -> Column:
    """The placeholder or the lower-cased word at each place."""

    def mark(w: Column, x: Column) -> Column:
        plain = (x == w) & (x > ":") & ~x.isin(*UNITS, *NUMBER_WORDS)  # most words, told by cheap tests
        number = x.isin(*NUMBER_WORDS) | x.rlike(r"^\d+$")
        name = (x != w) & ~x.isin(*FUNCTION_WORDS) & w.rlike(r"^\p{Lu}\p{Ll}\p{L}*$")
        return F.when(plain, x).when(number, NUMBER).when(x.isin(*UNITS), UNIT).when(name, NAME).otherwise(x)

    return F.zip_with(words, low, mark)


def marked(words: DataFrame) -> DataFrame:
    """Adds `low` and `marks`, the lower-cased words and the template, in place of `words`."""
    return words.withColumn("low", lowered(F.col("words"))).withColumn("marks", template(F.col("words"), F.col("low"))).drop("words")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def key_at(hashes: Column, at: Column, length: int) -> Column:
    """Hash of the window that starts at a place counted from 1."""
    return F.xxhash64(F.slice(hashes, at, length))


def keys_at(hashes: Column, at: Column, length: int) -> Column:
    """Hashes of the windows at the places of an array, which may be null."""
    return F.coalesce(F.transform(at, lambda i: key_at(hashes, i, length)), F.array().cast("array<long>"))


def entry(hashes: Column, at: Column, length: int) -> Column:
    """Place in the table, from 0, of the word or pair that starts a window."""
    second = F.get(hashes, at) if length > 1 else F.lit(0).cast("long")
    return F.pmod(F.xxhash64(F.get(hashes, at - 1), second, F.lit(length)), F.lit(TABLE)).cast("int")


def starts(hashes: Column, length: int) -> Column:
    return F.when(F.size(hashes) >= length, F.sequence(F.lit(1), F.size(hashes) - (length - 1)))


def met_starts(hashes: Column, length: int, table: Column) -> Column:
    """Places where the table lets a window start."""
    return F.filter(starts(hashes, length), lambda i: F.get(table, entry(hashes, i, length)))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, length, n_windows, item_at, key, kind, entry, slots) of every item with a word.

    kind is v or t; slots are the values at each word of a template window, null
    for plain words, and null for a verbatim window. A template window is left out
    where it has no slot or too few plain words. Items under WINDOW words have one
    verbatim window of their whole length.
    """
    low = marked(benchmark.select("item_id", split_words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words")).filter(F.size("words") > 0))
    low = low.withColumn("length", F.least(F.size("low"), F.lit(WINDOW)))
    low = low.select("*", hashed(F.col("low")).alias("v"), hashed(F.col("marks")).alias("t"), (F.size("low") - F.col("length") + 1).alias("n_windows"))
    one = low.select("*", F.explode(F.sequence(F.lit(1), F.col("n_windows"))).alias("item_at"))
    values = F.slice("low", F.col("item_at"), F.col("length"))
    slots = F.zip_with(F.slice("marks", F.col("item_at"), F.col("length")), values, lambda m, v: F.when(m != v, v))
    n_slots = F.size(F.filter(slots, lambda s: s.isNotNull()))
    kinds = F.array(F.struct(F.lit("v").alias("kind"), F.col("v").alias("hashes")), F.struct(F.lit("t").alias("kind"), F.col("t").alias("hashes")))
    cut = one.select("item_id", "length", "n_windows", "item_at", slots.alias("slots"), n_slots.alias("n"), F.explode(kinds).alias("k"))
    cut = cut.filter((F.col("k.kind") == "v") | ((F.col("length") == WINDOW) & (F.col("n") > 0) & (F.col("n") <= WINDOW - PLAIN)))
    hashes, at = F.col("k.hashes"), F.col("item_at")
    place = F.when(F.col("length") > 1, F.pmod(F.xxhash64(F.get(hashes, at - 1), F.get(hashes, at), F.col("length")), F.lit(TABLE))).otherwise(
        F.pmod(F.xxhash64(F.get(hashes, at - 1), F.lit(0).cast("long"), F.col("length")), F.lit(TABLE))
    )
    key = F.xxhash64(F.slice(hashes, at, F.col("length")))
    return cut.select("item_id", "length", F.col("n_windows").cast("long").alias("n_windows"), "item_at", key.alias("key"), F.col("k.kind").alias("kind"), place.cast("int").alias("entry"), F.when(F.col("k.kind") == "t", F.col("slots")).alias("slots"))


def with_probes(keys: DataFrame, needed: int) -> DataFrame:
    """Adds `probe` to item windows: false at the `needed` - 1 places of an item (all but one, if it has fewer) whose keys most items have.

    Whoever meets `needed` places of an item meets one with a probe. Ranks are those of one item's places.
    """
    shared = keys.groupBy("key").agg(F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("items"))
    places = keys.join(shared, "key").groupBy("item_id", "item_at").agg(F.max("items").alias("items"), F.min("n_windows").alias("n"))
    item = Window.partitionBy("item_id")
    ranked = places.withColumns({"rank": F.row_number().over(item.orderBy(F.desc("items"), "item_at")), "least": F.least(F.lit(needed), F.min("n").over(item))})
    marked_places = ranked.select(F.col("item_id").alias("p_item"), F.col("item_at").alias("p_at"), (F.col("rank") >= F.col("least")).alias("probe"))
    return keys.join(marked_places, keys["item_id"].eqNullSafe(F.col("p_item")) & (keys["item_at"] == F.col("p_at"))).select(*keys.columns, "probe")


def leaks(docs: DataFrame, benchmark: DataFrame, needed: int = NEEDED) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds.

    Returns doc_id, text_hash (xxhash64 of the text), item_id, matched_windows,
    item_windows and n_slots (different pairs of slot values in the template
    windows), one row for each pair in which `needed` windows of the item (all, if
    it has fewer) are met, verbatim or by template.

    * null or empty text holds nothing, and an item without words is held by nothing
    * an item of fewer than WINDOW words, a single word included, is held where all its words stand in a row
    * rows that share an id are each judged by their own text; rows equal in id and text are one document; a null id is reported as null
    * repeated items are each reported under their own item_id
    * ties: of values that an item's value meets equally often on a diagonal, the first in order stands; a very long text is cut into windows where it is read
    * an empty table on either side gives no rows; other columns are ignored
    """
    cut_items = stored(item_windows(benchmark), "template-items")
    keys = stored(with_probes(cut_items, needed), "template-windows")
    forget(cut_items)
    lengths = [r["length"] for r in keys.select("length").distinct().collect()]  # WINDOW at most
    if not lengths:
        return docs.sparkSession.createDataFrame([], RESULT)
    probes = keys.filter("probe")
    bits = ["0"] * TABLE
    for r in probes.select("entry").distinct().collect():  # TABLE at most
        bits[r["entry"]] = "1"
    table = F.split(F.lit(",".join(bits)), ",").cast("array<boolean>")  # a constant of the plan

    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).filter(F.length("text") > 0)
    words = marked(texts.select("doc_id", "text_hash", split_words(F.col("text")).alias("words")))
    hashes = words.select("doc_id", "text_hash", hashed(F.col("low")).alias("v"), hashed(F.col("marks")).alias("t"))
    # each key once a text
    found = [keys_at(F.col(c), met_starts(F.col(c), n, table), n) for n in lengths for c in ("v", "t")[: 1 + (n == WINDOW)]]
    cut = hashes.select("doc_id", "text_hash", F.explode(F.array_distinct(F.concat(*found))).alias("key"))
    sought = probes.select("key", "item_id").distinct()
    hit = cut.join(small_or_not(sought, weight(sought)), "key")
    met = stored(hit.select(F.col("doc_id").alias("m_doc"), F.col("text_hash").alias("m_hash"), F.col("item_id").alias("m_item")).distinct(), "template-met")

    held = met.select("m_doc", "m_hash").distinct()
    same = texts["doc_id"].eqNullSafe(F.col("m_doc")) & (texts["text_hash"] == F.col("m_hash"))
    close = texts.join(small_or_not(held, 32 * met.count()), same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    close = stored(close.select("doc_id", "text_hash", split_words(F.col("text")).alias("words")), "template-close")
    words = marked(close)
    # the windows to look for in each document: those of the items that it may hold
    size = weight(keys)
    known = small_or_not(keys.select("key").distinct(), size)
    wanted = met.join(small_or_not(keys.drop("length", "entry", "probe"), size), F.col("m_item").eqNullSafe(F.col("item_id"))).drop("m_item")
    return accepted(verbatim(words, wanted, known, lengths).unionByName(by_template(words, wanted, known)), needed)


def asked(cut: DataFrame, wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Windows of documents (doc_id, text_hash, key and others) that are wanted there; windows of no item (`known` has all keys) aren't moved."""
    cut = cut.join(known, "key", "left_semi")
    same = cut["doc_id"].eqNullSafe(wanted["m_doc"]) & (cut["text_hash"] == wanted["m_hash"]) & (cut["key"] == wanted["key"])
    return cut.join(wanted, same).drop("m_doc", "m_hash", "key")


def verbatim(words: DataFrame, wanted: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """Item windows whose words stand in a document."""
    v = words.select("doc_id", "text_hash", hashed(F.col("low")).alias("v"))
    found = [keys_at(F.col("v"), starts(F.col("v"), n), n) for n in lengths]
    cut = v.select("doc_id", "text_hash", F.explode(F.array_distinct(F.concat(*found))).alias("key"))
    hit = asked(cut, wanted.filter("kind = 'v'"), known)
    return hit.select("doc_id", "text_hash", "item_id", "item_at", "n_windows", F.lit(None).cast("array<struct<i:string,d:string>>").alias("pairs"))


def by_template(words: DataFrame, wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Item windows whose template stands in a document, with slot values that agree along their diagonal."""
    t = words.select("doc_id", "text_hash", "low", hashed(F.col("marks")).alias("t"))
    cut = t.select("doc_id", "text_hash", F.explode(F.transform(starts(F.col("t"), WINDOW), lambda i: F.struct(i.alias("at"), key_at(F.col("t"), i, WINDOW).alias("key"), F.slice("low", i, WINDOW).alias("values")))).alias("w"))
    hit = asked(cut.select("doc_id", "text_hash", "w.*"), wanted.filter("kind = 't'"), known)
    pairs = F.filter(F.zip_with("slots", "values", lambda i, d: F.struct(i.alias("i"), d.alias("d"))), lambda p: p["i"].isNotNull())
    diagonal = ["doc_id", "text_hash", "item_id", "diagonal"]
    aligned = stored(hit.select("doc_id", "text_hash", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", "n_windows", pairs.alias("pairs")), "template-aligned")
    seen = aligned.select(*diagonal, F.explode("pairs").alias("p")).groupBy(*diagonal, "p").agg(F.count(F.lit(1)).alias("n"))
    chosen = seen.groupBy(*diagonal, F.col("p.i").alias("i")).agg(F.min_by("p", F.struct(-F.col("n"), F.col("p.d"))).alias("p"))
    allowed = chosen.groupBy(*diagonal).agg(F.collect_list("p").alias("allowed"))  # as many as the item has slots at most
    right, left = allowed.alias("r"), aligned.alias("l")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash")) & (F.col("l.item_id").eqNullSafe(F.col("r.item_id"))) & (F.col("l.diagonal") == F.col("r.diagonal"))
    good = left.join(right, same).filter(F.size(F.array_except("l.pairs", "r.allowed")) == 0)
    return good.select("l.doc_id", "l.text_hash", "l.item_id", "l.item_at", "l.n_windows", "l.pairs")


def accepted(windows: DataFrame, needed: int) -> DataFrame:
    by = ["doc_id", "text_hash", "item_id"]
    one = windows.groupBy(*by, "item_at").agg(F.max("n_windows").alias("n_windows"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    met = one.groupBy(*by).agg(F.count(F.lit(1)).alias("matched_windows"), F.max("n_windows").alias("item_windows"), F.size(F.array_distinct(F.flatten(F.collect_list("pairs")))).cast("long").alias("n_slots"))
    return met.filter(F.col("matched_windows") >= F.least(F.lit(needed), F.col("item_windows")))


def without_leaks(docs: DataFrame, benchmark: DataFrame, needed: int = NEEDED) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with all their columns."""
    found = leaks(docs, benchmark, needed).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__hash"))
    return docs.join(found, same, "left_anti")
