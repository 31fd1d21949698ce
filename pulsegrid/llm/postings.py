"""Positional inverted index of training text and its exact phrase and proximity search (operator 11).

Everything runs as DataFrame expressions.  The index is partitioned by document, as each task keeps the postings of
the texts it read, sorted by term, so building it needs no shuffle and Parquet can skip what a search doesn't ask for.

A search takes, for each window of terms, the list of its rarest term first.  Its postings, adjusted by the
term's offset, are candidate starts; the second rarest term's list thins them out; the longer lists of the other terms
are only read for windows and documents that are left.

Nulls count as texts without words.  Rows that repeat an id are told apart by their text; repeated rows with equal
text share postings and get equal results.  Terms are compared by 64-bit hashes; a false match needs a collision in each
word of a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII alone take the faster way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """Runs of digits, letters and all beyond ASCII, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def document_key(id: str, text: str) -> Column:
    return F.xxhash64(F.col(id), F.coalesce(F.col(text), F.lit("")))


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(term, doc, pos)`` of every word of every text, kept below the checkpoint folder.

    One posting a word.  A term's postings of one task lie together, in the order of texts and positions.
    """
    tokens = docs.select(document_key(id, text).alias("doc"), F.posexplode(words(F.col(text))).alias("pos", "word"))
    return written(tokens.select(F.xxhash64("word").alias("term"), "doc", "pos").sortWithinPartitions("term"))


def windows_of(items: DataFrame, size: int, id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, wid, terms)``: every run of ``size`` consecutive words of an item, or all of a shorter one."""
    hashed = items.select(F.col(id).alias("item"), F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("t"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("t") - (size - 1), F.lit(1)))
    cut = hashed.where(F.size("t") > 0).withColumn("i", F.explode(starts)).withColumn("terms", F.slice("t", F.col("i"), F.lit(size)))
    return cut.select("item", F.xxhash64("terms").alias("wid"), "terms").distinct()


def plan_windows(index: DataFrame, windows: DataFrame) -> DataFrame:
    """``(wid, size, steps)``: a window's terms with offsets, the rarest in the index first.

    Windows with a term that the index lacks can't occur and go.
    """
    places = windows.select("wid", "terms").distinct().select("wid", F.posexplode("terms").alias("off", "term"))
    asked = written(places.select("term").distinct())
    counts = index.join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    listed = places.join(counts, "term", "left").groupBy("wid").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term"))).alias("steps"))
    return written(listed.where(F.col("steps")[0]["n"] > 0).select("wid", F.size("steps").alias("size"), "steps"))


def _meeting(asked: DataFrame, postings: DataFrame, slack: int) -> DataFrame:
    """Rows of ``asked`` whose ``term`` stands in ``doc`` at most ``slack`` words from ``want``."""
    if not slack:
        return asked.join(postings.withColumnRenamed("pos", "want"), ["term", "doc", "want"], "left_semi")
    width = 2 * slack + 1
    cell = lambda c: F.floor(c / width)
    both = F.array_distinct(F.array(cell(F.col("want") - slack), cell(F.col("want") + slack)))
    a, p = asked.withColumn("cell", F.explode(both)), postings.withColumn("cell", cell(F.col("pos")))
    near = (a["term"] == p["term"]) & (a["doc"] == p["doc"]) & (a["cell"] == p["cell"]) & (F.abs(a["want"] - p["pos"]) <= slack)
    return a.join(p, near, "left_semi").drop("cell").distinct()


def matches(index: DataFrame, plans: DataFrame, slack: int = 0) -> DataFrame:
    """``(wid, doc, start, size)`` of every place where all terms of a window stand.

    Without ``slack`` these are exact phrases.  With it each term may stand up to ``slack`` words from where the rarest
    one puts it, in any order: proximity matches.
    """
    steps = F.col("steps")
    first = written(plans.select("wid", "size", steps[0]["term"].alias("term"), steps[0]["off"].alias("off"),
                                 F.coalesce(F.try_element_at("steps", F.lit(2)), steps[0]).alias("second"),
                                 F.when(F.size("steps") > 2, F.slice("steps", 3, F.size("steps") - 2)).otherwise(F.slice("steps", 1, 1)).alias("rest")))
    key = ["wid", "doc", "start"]
    # lists of the rarest terms, as starts of windows
    found = index.join(first.select("term", "wid", "off", "second"), "term")
    found = found.select("wid", "doc", (F.col("pos") - F.col("off")).alias("start"), "second").where(F.col("start") >= (0 if not slack else -slack))
    asked = found.select(*key, F.col("second.term").alias("term"), (F.col("start") + F.col("second.off")).alias("want"))
    seconds = written(first.select(F.col("second.term").alias("term")).distinct())
    left = written(_meeting(asked, index.join(seconds, "term", "left_semi"), slack).select(*key).distinct())
    # the other lists, only for what is left
    alive = written(first.join(left.select("wid").distinct(), "wid", "left_semi").select("wid", "size", "rest"))
    terms = written(alive.select(F.explode("rest.term").alias("term")).distinct())
    held = written(left.select("doc").distinct())
    others = index.join(terms, "term", "left_semi").join(held, "doc", "left_semi")
    wants = left.join(alive, "wid").select(*key, "size", F.size("rest").alias("need"), F.explode("rest").alias("s"))
    wants = wants.select(*key, "size", "need", F.col("s.off").alias("off"), F.col("s.term").alias("term"), (F.col("start") + F.col("s.off")).alias("want"))
    met = _meeting(wants, others, slack)
    whole = met.groupBy(*key, "size", "need").agg(F.count("*").alias("met")).where("met = need")
    return whole.select(*key, "size")


def _covered(found: DataFrame) -> DataFrame:
    """Words of each document inside any match."""
    before = Window.partitionBy("doc").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    spans = found.select("doc", "start", "size").distinct().withColumn("reach", F.max(end).over(before))
    return spans.groupBy("doc").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", F.coalesce("reach", F.lit(0))))).alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id, n_words, n_hit, n_items, item_ids, contaminated``.

    A word is hit if it lies inside a place where ``size`` consecutive words of an item stand (all words of a shorter
    item).  ``item_ids`` are the ids, as sorted strings, of items with such a place; an item row without an id hits
    words but is not listed.  Without documents there are no rows, without items nothing is hit.
    """
    index = build_index(docs, id, text)
    windows = written(windows_of(items, size, item_id, item_text))
    found = written(matches(index, plan_windows(index, windows)))
    owners = found.select("wid", "doc").distinct().join(windows.select("wid", "item").distinct(), "wid")
    listed = owners.groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("item_ids"))
    counts = index.groupBy("doc").agg((F.max("pos") + 1).alias("n_words"))
    rows = docs.select(F.col(id).alias("id"), document_key(id, text).alias("doc"))
    out = rows.join(counts, "doc", "left").join(_covered(found), "doc", "left").join(listed, "doc", "left")
    hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), hit.alias("n_hit"),
                      F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (hit > 0).alias("contaminated"))
