"""Prefix trie of conversations, named by van Emde Boas recursion, totals grafted upwards.

A node of the trie is a distinct sequence of first turns; it is named by its smallest member
(with its depth that is unique). Naming is recursive on half depths: the sequences of a
subproblem of greatest length ``m`` are cut at ``h = m // 2``, the cut prefixes are named (the
smallest member of each distinct prefix), and then the upper trie (the first ``h`` turns of
every sequence) and the lower forests (the rest, rooted at the named cut prefix) are solved as
independent subproblems of length ``ceil(m / 2)`` at most, all of one level in the same Spark
jobs. A level is written before the next reads it, so ``log2`` of the longest conversation
levels are run. Turns are named once first, by the smallest (conversation, place) that holds
them, so that sequences are short arrays of numbers.

Totals over subtrees are grafted upwards along the members' own paths: a node's value is put on
its smallest member at its depth, a running sum from the deep end of every conversation carries
it up, and a node's total is the sum of its members' running sums at its depth. Ends are hashed
in one sorted pass per node, never gathered in a list.

Rules: rows with a null conv_id belong to no conversation; turns order by turn (null first),
then role, then text; a null role or text is empty. Conversation ``c`` is rebuilt from the
first ``crc32(str(c)) % 4`` turns of conversation ``c - c % 20`` (SQL remainder, so the sign of
``c``) and its own turns after as many. A turnless conversation is a member of the root alone.
No conversation: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

SPREAD = 16  # salts that a hot key is named over
WORDS = r"[^\x20\x09-\x0D]+"
OUT_COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def smallest_by(df: DataFrame, key: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the smallest ``value`` among rows of its key.

    The minimum is taken per (key, salt) first and the rows meet it by (key, salt), so the rows
    of a hot key are spread over ``SPREAD`` tasks.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SPREAD))).withColumn("_value", value)
    partial = salted.groupBy(*key, "_salt").agg(F.min("_value").alias("_low"))
    whole = partial.groupBy(*key).agg(F.min("_low").alias(name))
    spread = partial.join(whole, key).select(*key, "_salt", name)
    return salted.join(spread, [*key, "_salt"]).drop("_salt", "_value")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, role, text) of every rebuilt conversation, and (conv_id) of all of them."""
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = staged(turns.withColumn("pos", F.row_number().over(order) - 1).drop("turn"), "trie-turns")
    ids = turns.select("conv_id").distinct().select(
        "conv_id",
        (F.col("conv_id") - F.col("conv_id") % 20).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("h"),
    )
    ids = staged(ids, "trie-ids")
    head = ids.join(
        turns.filter(F.col("pos") < 3).withColumnRenamed("conv_id", "base"), "base"
    ).filter(F.col("pos") < F.col("h")).select("conv_id", F.lit(0).alias("part"), "pos", "role", "text")
    tail = turns.join(ids.select("conv_id", "h"), "conv_id").filter(F.col("pos") >= F.col("h")).select(
        "conv_id", F.lit(1).alias("part"), "pos", "role", "text"
    )
    order = Window.partitionBy("conv_id").orderBy("part", "pos")
    both = head.unionByName(tail).withColumn("pos", F.row_number().over(order) - 1).drop("part")
    return staged(both, "trie-rebuilt"), ids.select("conv_id")


def name_prefixes(sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, node) for every depth from 1 to the length of ``syms``.

    ``sequences``: (conv_id, syms). ``node`` is the smallest conv_id whose first ``depth``
    symbols are the same.
    """
    work = sequences.filter(F.size("syms") > 0).select(
        F.lit(0).cast("bigint").alias("rd"), F.lit(0).cast("bigint").alias("rn"), "conv_id", "syms"
    )
    work = staged(work, "trie-level")
    named = []
    while True:
        longest = work.agg(F.max(F.size("syms"))).first()[0] or 0
        if longest == 0:
            break
        if longest == 1:
            last = smallest_by(work.withColumn("cut", F.col("syms")), ["rd", "rn", "cut"], F.col("conv_id"), "node")
            named.append(staged(last.select("conv_id", (F.col("rd") + 1).alias("depth"), "node"), "trie-named"))
            break
        half = longest // 2
        cut = work.filter(F.size("syms") >= half).withColumn("cut", F.slice("syms", 1, half))
        cut = staged(smallest_by(cut, ["rd", "rn", "cut"], F.col("conv_id"), "node"), "trie-cut")
        named.append(cut.select("conv_id", (F.col("rd") + half).alias("depth"), "node"))
        upper = work.select("rd", "rn", "conv_id", F.slice("syms", 1, half).alias("syms"))
        lower = cut.filter(F.size("syms") > half).select(
            (F.col("rd") + half).alias("rd"),
            F.col("node").alias("rn"),
            "conv_id",
            F.slice("syms", half + 1, F.size("syms") - half).alias("syms"),
        )
        work = staged(upper.unionByName(lower), "trie-level")
    if not named:
        return sequences.sparkSession.createDataFrame([], "conv_id bigint, depth bigint, node bigint")
    out = named[0]
    for more in named[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _hash_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the comma-joined ends of every node, from rows sorted by node and conv_id."""
    out = {"depth": [], "node": [], "ends_sha256": []}
    key, digest, first = None, None, True
    for frame in batches:
        for depth, node, conv in zip(frame["depth"], frame["node"], frame["conv_id"], strict=True):
            if (depth, node) != key:
                if key is not None:
                    out["depth"].append(key[0])
                    out["node"].append(key[1])
                    out["ends_sha256"].append(digest.hexdigest())
                key, digest, first = (depth, node), hashlib.sha256(), True
            digest.update((b"" if first else b",") + str(int(conv)).encode())
            first = False
            if len(out["node"]) >= 10_000:
                yield pd.DataFrame(out, columns=["depth", "node", "ends_sha256"]).astype({"depth": "int64", "node": "int64"})
                out = {"depth": [], "node": [], "ends_sha256": []}
    if key is not None:
        out["depth"].append(key[0])
        out["node"].append(key[1])
        out["ends_sha256"].append(digest.hexdigest())
    yield pd.DataFrame(out, columns=["depth", "node", "ends_sha256"]).astype({"depth": "int64", "node": "int64"})


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see the module's rules)."""
    turns, ids = rebuilt(conversations)
    symbols = smallest_by(turns, ["role", "text"], F.struct("conv_id", "pos"), "sym")
    symbols = staged(symbols.select("conv_id", "pos", "sym", "text"), "trie-symbols")
    sequences = ids.join(
        symbols.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "sym"))).alias("pairs")),
        "conv_id",
        "left",
    ).select("conv_id", F.coalesce(F.col("pairs.sym"), F.array()).alias("syms"))
    sequences = staged(sequences, "trie-sequences")

    root = ids.agg(F.min("conv_id")).first()[0]
    if root is None:
        return conversations.sparkSession.createDataFrame(
            [], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
            "n_leaves bigint, saved_tokens bigint, ends_sha256 string"
        )
    paths = name_prefixes(sequences).unionByName(
        ids.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(root).cast("bigint").alias("node"))
    )
    paths = staged(paths, "trie-paths")
    lengths = sequences.select("conv_id", F.size("syms").cast("bigint").alias("length"))

    nodes = paths.groupBy("depth", "node").agg(F.count("*").alias("n_convs"))
    parents = paths.select(
        (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("node"), F.col("node").alias("parent_conv_id")
    )
    nodes = nodes.join(parents, ["depth", "node"], "left")
    children = nodes.filter(F.col("parent_conv_id").isNotNull()).groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("node")
    ).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["depth", "node"], "left").fillna(0, ["n_children"])
    last_text = symbols.select(
        (F.col("pos") + 1).cast("bigint").alias("depth"), F.col("conv_id").alias("node"),
        F.size(F.regexp_extract_all("text", F.lit(WORDS), 0)).cast("bigint").alias("words"),
    )
    nodes = nodes.join(last_text, ["depth", "node"], "left").fillna(0, ["words"])
    nodes = staged(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("bigint")).withColumn(
        "saved", (F.col("n_convs") - 1) * F.col("words")
    ), "trie-nodes")

    # graft: every node's values ride on its smallest member, summed from the deep end upwards
    own = paths.join(
        nodes.select(F.col("node").alias("conv_id"), "depth", "leaf", "saved"), ["conv_id", "depth"], "left"
    ).fillna(0, ["leaf", "saved"])
    upwards = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    carried = own.select(
        "depth", "node", F.sum("leaf").over(upwards).alias("leaves"), F.sum("saved").over(upwards).alias("saved")
    )
    totals = carried.groupBy("depth", "node").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )

    ends = paths.join(lengths, "conv_id").filter(F.col("length") == F.col("depth")).select("depth", "node", "conv_id")
    hashed = (
        ends.repartition("depth", "node")
        .sortWithinPartitions("depth", "node", "conv_id")
        .mapInPandas(_hash_ends, "depth bigint, node bigint, ends_sha256 string")
    )
    out = nodes.join(totals, ["depth", "node"]).join(hashed, ["depth", "node"], "left")
    return out.select(
        F.col("node").alias("conv_id"),
        "depth",
        F.col("parent_conv_id").cast("bigint").alias("parent_conv_id"),
        F.col("n_convs").cast("bigint").alias("n_convs"),
        F.col("n_children").cast("bigint").alias("n_children"),
        F.col("n_leaves").cast("bigint").alias("n_leaves"),
        F.col("saved_tokens").cast("bigint").alias("saved_tokens"),
        F.coalesce(F.col("ends_sha256"), F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
