"""Benchmark decontamination by a distributed positional inverted index.

Built-in functions only. The words of all documents are stored once with their positions. Every
window of a benchmark item is looked up by its two rarest words: their postings, shifted by the
words' places in the item, must meet at the same alignment of item and document. What meets is
compared word by word, and gives the exact phrase matches; a looser meeting gives proximity
matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import ascii_lower

WINDOW = 13
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# measured bytes of a table that may be broadcast, and a count of numbers; beyond it is a shuffle
_SMALL_BYTES = 32 << 20
_SMALL_KEYS = 1_000_000


def words(text: Column) -> Column:
    """Runs of digits, a-z and characters beyond ASCII, A-Z in lower case; none for null."""
    found = F.array_remove(F.split(ascii_lower(text), _BREAKS, -1), "")
    return F.coalesce(found, F.array().cast("array<string>"))


@dataclass(frozen=True)
class Index:
    """``rows``: row, doc_id, n_words, words, one for each document; written once."""

    rows: DataFrame

    def postings(self) -> DataFrame:
        """(term, row, pos) of every word."""
        return self.rows.select("row", F.posexplode("words").alias("pos", "term"))


def build_index(docs: DataFrame) -> Index:
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words")
    )
    return Index(staged(rows.withColumn("n_words", F.size("words").cast("bigint")), "words"))


def _checked(df: DataFrame) -> DataFrame:
    """A broadcast hint for a stored table whose content was measured and is small."""
    measured = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if measured <= _SMALL_BYTES else df


@dataclass(frozen=True)
class Plan:
    """``items``: item, item_id, item_words, pairs (of places); ``seeds``: term, item, place."""

    items: DataFrame
    seeds: DataFrame


def plan_items(index: Index, benchmark: DataFrame, window: int = WINDOW) -> Plan:
    """The two rarest words of each window, by their counts in all documents.

    Items without words have no windows. A window with a word that no document holds is left
    out: it occurs nowhere.
    """
    items = staged(
        benchmark.select(
            F.monotonically_increasing_id().alias("item"), "item_id", words(F.col("text")).alias("item_words")
        ).filter(F.size("item_words") > 0),
        "items",
    )
    size = F.size("item_words")
    length = F.least(F.lit(window), size)
    terms = items.select(
        "item", size.alias("size"), length.alias("length"), F.posexplode("item_words").alias("place", "term")
    )
    counts = index.rows.select(F.explode("words").alias("term")).groupBy("term").count()
    counts = counts.join(terms.select("term").distinct(), "term")
    begins = F.sequence(
        F.greatest(F.lit(0), F.col("place") - F.col("length") + 1),
        F.least(F.col("place"), F.col("size") - F.col("length")),
    )
    ranked = F.sort_array(F.collect_list(F.struct("count", "place")))  # a window's words: few
    chosen = (
        terms.join(counts, "term", "left")
        .select("item", "place", F.coalesce("count", F.lit(0)).alias("count"), F.explode(begins).alias("begin"))
        .groupBy("item", "begin")
        .agg(ranked.alias("ranked"))
        .filter(F.col("ranked")[0]["count"] > 0)
        .select(
            "item",
            F.col("ranked")[0]["place"].alias("a"),
            F.when(F.size("ranked") > 1, F.col("ranked")[1]["place"]).otherwise(F.col("ranked")[0]["place"]).alias("b"),
        )
        .distinct()
    )
    chosen = staged(chosen, "pairs")
    places = chosen.select("item", F.explode(F.array("a", "b")).alias("place")).distinct()
    seeds = staged(places.join(terms.select("item", "place", "term"), ["item", "place"]), "seeds")
    pairs = chosen.groupBy("item").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    return Plan(staged(items.join(pairs, "item"), "items"), seeds)


def alignments(index: Index, plan: Plan) -> DataFrame:
    """(row, item, delta, places): the offset-adjusted lists of the seeds, by alignment."""
    return (
        index.postings()
        .join(_checked(plan.seeds), "term")
        .groupBy("row", "item", (F.col("pos") - F.col("place")).alias("delta"))
        .agg(F.collect_set("place").alias("places"))
    )


def phrase_matches(index: Index, plan: Plan, window: int = WINDOW) -> DataFrame:
    """(row, item_id, begin, length): exact occurrences of windows in documents.

    ``begin`` counts words from 0. Overlapping occurrences are separate rows.
    """
    met = F.exists(
        "pairs", lambda p: F.array_contains("places", p["a"]) & F.array_contains("places", p["b"])
    )
    candidates = (
        alignments(index, plan)
        .join(_checked(plan.items), "item")
        .filter(met)
        # bounded by the words of one document
        .groupBy("row")
        .agg(F.collect_list(F.struct("item_id", "item_words", "delta")).alias("candidates"))
    )

    def verified(c: Column) -> Column:
        length = F.least(F.lit(window), F.size(c["item_words"]))

        def holds(w: Column) -> Column:
            in_text = F.slice("words", F.greatest(c["delta"] + w + 1, F.lit(1)), length)
            return (c["delta"] + w >= 0) & (F.slice(c["item_words"], w + 1, length) == in_text)

        begins = F.filter(F.sequence(F.lit(0), F.size(c["item_words"]) - length), holds)
        return F.transform(
            begins,
            lambda w: F.struct(
                c["item_id"].alias("item_id"), (c["delta"] + w).alias("begin"), length.alias("length")
            ),
        )

    candidates = staged(candidates, "candidates")
    rows = index.rows.select("row", "words")
    if candidates.count() <= _SMALL_KEYS:  # else all words are shuffled to the candidates
        rows = rows.join(F.broadcast(candidates.select("row")), "row", "left_semi")
    return (
        rows.join(candidates, "row")
        .select("row", F.explode(F.flatten(F.transform("candidates", verified))).alias("m"))
        .select("row", "m.*")
    )


def proximity_matches(index: Index, plan: Plan, slop: int = 5, share: float = 0.8) -> DataFrame:
    """(row, item_id, near): items whose rare words lie near their places in a document.

    ``near`` is the largest share of an item's seed words found at alignments that differ by at
    most ``2 * slop``; items with less than ``share`` are not returned.
    """
    seeds = plan.seeds.groupBy("item").agg(F.count("*").alias("seeds"))
    cell = F.floor(F.col("delta") / (2 * slop + 1))
    # two grids, shifted by half a cell, so that no group of near alignments is cut in both
    other = F.floor((F.col("delta") + slop) / (2 * slop + 1))
    cells = F.explode(F.array(F.struct(F.lit(0).alias("grid"), cell.alias("at")), F.struct(F.lit(1), other)))
    found = (
        alignments(index, plan)
        .select("row", "item", cells.alias("cell"), F.explode("places").alias("place"))
        .groupBy("row", "item", "cell")
        .agg(F.count_distinct("place").alias("found"))
    )
    return (
        found.groupBy("row", "item")
        .agg(F.max("found").alias("found"))
        .join(seeds, "item")
        .join(plan.items.select("item", "item_id"), "item")
        .select("row", "item_id", (F.col("found") / F.col("seeds")).alias("near"))
        .filter(F.col("near") >= share)
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    A word is hit if it lies in any occurrence of a window of ``window`` item words (all words
    of a shorter item). A document is contaminated if one word in twenty or more is hit. Null
    texts have no words; items that repeat an item_id count once.
    """
    index = build_index(docs)
    return _report(index, phrase_matches(index, plan_items(index, benchmark, window), window)).drop("row")


def _report(index: Index, matches: DataFrame) -> DataFrame:
    per_doc = matches.groupBy("row").agg(
        F.collect_set(F.col("item_id").cast("string")).alias("items"),
        # bounded by the words of one document
        F.collect_set(F.struct("begin", "length")).alias("spans"),
    )
    covered = F.array_distinct(
        F.flatten(F.transform("spans", lambda s: F.sequence(s["begin"], s["begin"] + s["length"] - 1)))
    )
    hits = per_doc.select("row", "items", F.size(covered).cast("bigint").alias("hit"))
    n_hit = F.coalesce("hit", F.lit(0).cast("bigint"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return index.rows.select("row", "doc_id", "n_words").join(hits, "row", "left").select(
        "row", "doc_id", "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated rows, told apart by doc_id and text."""
    key = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    report = contamination(docs.select(key.alias("doc_id"), "text"), benchmark, window)
    bad = report.filter("contaminated").select(
        F.col("doc_id.doc_id").alias("bad_id"), F.col("doc_id.hash").alias("bad_hash")
    ).distinct()
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"])
    return docs.join(bad, same, "left_anti")
