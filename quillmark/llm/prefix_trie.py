"""The prefix trie of conversations, summed by messages from the leaves to the root.

Every distinct sequence of first turns (role and text) is a node; conversations that begin with it are its
members. A prefix is named by 128 bits: the XOR, over its turns, of two hashes of the turn's SHA-256 and place, so
that prefixes are running aggregates and no conversation's turns are gathered in one row. Texts are read once;
from then on turns are 32-byte digests.

Subtree sums go up by leaf peeling. Nodes in a row with the same members are one segment, so the tree has no more
of them than there are branches and ends. Each segment holds a counter of the children it still waits for, and the
XOR of their names. Segments whose counter is zero send their sums to their parents, summed before they are
shuffled; a parent subtracts what came, by count and by XOR, so that a counter of one leaves the name of the child
it waits for. Such segments wait for one child alone and jump: they add that child's sum to their own and wait for
the child's child, which halves a chain in each round. So rounds grow with the logarithm of the tree, not with
its depth. Rounds are staged in the shared folder; the last one is that in which the root finishes.

Digests of the conversations that end in a node hash their ids in order. Ids are joined in pieces of 4,096 in
a row (so many ids at most), and a node's pieces are streamed in order through one hash: SHA-256 has no other way,
but even a node with a billion ends is only 250,000 rows there, and no task holds them at once. Hot parents are
the long side of equi-joins, which AQE splits. A conversation's own turns are sorted in one task, by a sort that
spills.

Defined for odd rows: turns are ordered by `turn`, null first; rows of one turn by the SHA-256 of role and text; a null
role or text is empty. Rows without conv_id belong to no conversation and count nowhere. Repeated rows are turns like others. An
empty table has no conversation and no node. Extra columns are neither read nor returned; very long texts are
hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.plans.staging import drop_staged, staged

WORD = r"[^\x20\x09-\x0D]+"
PIECE = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _turn_digest() -> Column:
    """SHA-256 of a row's role and text; the role's length keeps the two apart."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest, words of every turn."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", _turn_digest().alias("digest"), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("words"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return rows.select("conv_id", place.cast("long").alias("place"), F.unhex("digest").alias("digest"), "words")


def shared_heads(turns: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt with the first turns of their block's first conversation instead of their own.

    As many as crc32 of the decimal conv_id, modulo `most`. Conversations that have no turn left are kept by one
    row without a place.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    every = turns.where(F.col("place") == 1).select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), h.alias("h"))
    heads = turns.where((F.col("conv_id") % block == 0) & (F.col("place") < most)).select(F.col("conv_id").alias("base"), F.col("place").alias("_place"), "digest", "words")
    given = every.join(heads, "base", "left").where(F.col("_place").isNull() | (F.col("_place") <= F.col("h")) | (F.col("_place") == 1))
    # a conversation's row with place null stays even where it takes no head
    taken = F.col("_place") <= F.col("h")
    copies = given.select("conv_id", F.when(taken, F.lit(0)).alias("own"), F.when(taken, F.col("_place")).alias("place"), F.when(taken, F.col("digest")).alias("digest"), F.when(taken, F.col("words")).alias("words"))
    own = turns.where(F.col("place") > h).select("conv_id", F.lit(1).alias("own"), "place", "digest", "words")
    return copies.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2 (name of the prefix), p1, p2 (of the one before), words, is_end; depth 0 is the root.

    turns: conv_id, own, place, digest, words; rows without a place only say that the conversation is there.
    """
    order = Window.partitionBy("conv_id").orderBy("own", "place")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    there = F.col("place").isNotNull()
    placed = turns.withColumn("depth", F.sum(there.cast("long")).over(so_far)).withColumn("_next", F.coalesce(F.lead(there).over(order), F.lit(False)))
    hashed = placed.withColumns({"_h1": F.when(there, F.xxhash64("digest", "depth")).otherwise(F.lit(0)), "_h2": F.when(there, F.xxhash64(F.lit(1), "depth", "digest")).otherwise(F.lit(0))})
    named = hashed.withColumns({"k1": F.bit_xor("_h1").over(so_far), "k2": F.bit_xor("_h2").over(so_far)})
    return named.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("_h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("_h2")).alias("p2"), F.coalesce("words", F.lit(0)).alias("words"), there.alias("_there"), (~F.col("_next")).alias("is_end"))


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) from (depth, k1, k2, conv_id), each conversation once."""
    node = ["depth", "k1", "k2"]
    pieces = ends.withColumn("piece", F.floor(F.col("conv_id") / F.lit(PIECE))).groupBy(*node, "piece").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    dealt = pieces.repartition(*map(F.col, node)).sortWithinPartitions(*node, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*node, "ids")), strict=True):
                if key != now:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _batch(done)
        if now:
            yield _batch([(*now, digest.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*node, "ends_sha256"])

    return dealt.select(*node, "ids").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def nodes(prefix: DataFrame) -> DataFrame:
    """A staged row for each node: conv_id, depth, n_convs, n_children, saved (its own), ends_sha256, and its parent's conv_id and n_convs."""
    key = ["depth", "k1", "k2"]
    turn = prefix.where("_there").groupBy(*key).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("words").alias("words"))
    convs = prefix.where("is_end").select("conv_id", *key)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where(F.col("n_convs") > 0).select(*(zero.alias(c) for c in key), "n_convs", "conv_id", F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("words"))
    every = staged(turn.select(*root.columns).unionByName(root), "trie-nodes")
    children = every.where(F.col("depth") > 0).groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = every.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"))
    full = every.join(children, key, "left").join(_end_digests(convs), key, "left").join(parents, ["depth", "p1", "p2"], "left")
    out = full.select("conv_id", "depth", "n_convs", "parent_conv_id", "parent_n", F.coalesce("n_children", zero).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    full_nodes = staged(out, "trie-full-nodes")
    drop_staged(every)
    return full_nodes


def _segments(node: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, n): the conv_id and n_convs that a segment's nodes share; (pc, pn): its parent; remaining children and the XOR (xc, xn) of their names.

    And the staged table that it reads.
    """
    own = node.groupBy(F.col("conv_id").alias("c"), F.col("n_convs").alias("n")).agg(F.min_by(F.struct("parent_conv_id", "parent_n"), "depth").alias("_p"), F.max_by("n_children", "depth").alias("remaining"), F.sum("saved").alias("saved"))
    own = staged(own.select("c", "n", F.col("_p.parent_conv_id").alias("pc"), F.col("_p.parent_n").alias("pn"), "remaining", (F.col("remaining") == 0).cast("long").alias("leaves"), "saved"), "trie-segments")
    names = own.where(F.col("pc").isNotNull()).groupBy(F.col("pc").alias("c"), F.col("pn").alias("n")).agg(F.bit_xor("c").alias("xc"), F.bit_xor("n").alias("xn"))
    return own.join(names, ["c", "n"], "left").select("c", "n", "pc", "pn", "remaining", F.coalesce("xc", F.lit(0)).alias("xc"), F.coalesce("xn", F.lit(0)).alias("xn"), "leaves", "saved"), own


def _jumped(waiting: DataFrame) -> DataFrame:
    """Segments that wait for one child which waits for one child, too, take its sum and wait for that one."""
    step = waiting.where(F.col("remaining") == 1).select(F.col("c").alias("xc"), F.col("n").alias("xn"), F.col("xc").alias("_yc"), F.col("xn").alias("_yn"), F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved"))
    one = waiting.where(F.col("remaining") == 1).join(step, ["xc", "xn"], "left")
    moved = one.select("c", "n", "pc", "pn", "remaining", F.coalesce("_yc", "xc").alias("xc"), F.coalesce("_yn", "xn").alias("xn"), (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"))
    return moved.unionByName(waiting.where(F.col("remaining") > 1))


def _round(waiting: DataFrame, done: DataFrame) -> DataFrame:
    """Delivers the sums of the segments that are done: to parents that wait for several children, and to whoever waits for one alone."""
    sent = done.groupBy(F.col("pc").alias("c"), F.col("pn").alias("n")).agg(F.count(F.lit(1)).alias("_k"), F.bit_xor("c").alias("_xc"), F.bit_xor("n").alias("_xn"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    many = waiting.where(F.col("remaining") > 1).join(sent, ["c", "n"], "left")
    one = waiting.where(F.col("remaining") == 1).join(done.select(F.col("c").alias("xc"), F.col("n").alias("xn"), F.lit(1).cast("long").alias("_k"), F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved")), ["xc", "xn"], "left").withColumns({"_xc": F.when(F.col("_k") == 1, F.col("xc")), "_xn": F.when(F.col("_k") == 1, F.col("xn"))})
    zero = F.lit(0).cast("long")
    took = many.unionByName(one.select(*many.columns))
    return took.select("c", "n", "pc", "pn", *((F.col(a) - F.coalesce(b, zero)).alias(a) for a, b in (("remaining", "_k"),)), *(F.col(a).bitwiseXOR(F.coalesce(b, zero)).alias(a) for a, b in (("xc", "_xc"), ("xn", "_xn"))), *((F.col(a) + F.coalesce(f"_{a}", zero)).alias(a) for a in ("leaves", "saved")))


def subtree_sums(node: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(c, n, leaves, saved) of every segment, its whole subtree summed; and the tables to drop when it has been read."""
    first, base = _segments(node)
    state = staged(first, "trie-round")
    tables, finished = [base, state], []
    while True:
        done, waiting = state.where(F.col("remaining") == 0), state.where(F.col("remaining") > 0)
        finished.append(done.select("c", "n", "leaves", "saved"))
        left, alone = waiting.agg(F.count(F.lit(1)), F.count(F.when(F.col("remaining") == 1, 1))).first()
        if not left:
            return reduce(DataFrame.unionByName, finished), tables
        state = staged(_round(_jumped(waiting) if alone else waiting, done), "trie-round")
        tables.append(state)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Every node of the trie of `turns` (as `prefixes` takes them), with the sums of its subtree."""
    prefix = staged(prefixes(turns), "trie-prefixes")
    node = nodes(prefix)
    sums, tables = subtree_sums(node)
    segment = Window.partitionBy("conv_id", "n_convs").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    above = node.withColumn("_above", F.coalesce(F.sum("saved").over(segment), F.lit(0)))
    out = above.join(sums.select(F.col("c").alias("conv_id"), F.col("n").alias("n_convs"), "leaves", F.col("saved").alias("_all")), ["conv_id", "n_convs"])
    result = staged(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), (F.col("_all") - F.col("_above")).alias("saved_tokens"), "ends_sha256"), "trie")
    for table in (prefix, node, *tables):
        drop_staged(table)
    return result


def conversation_trie(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text); with `rebuild`, of the conversations that `shared_heads` makes of it."""
    turns = staged(ordered_turns(conversations), "trie-turns")
    out = prefix_trie(shared_heads(turns) if rebuild else turns.withColumn("own", F.lit(1)))
    drop_staged(turns)
    return out
