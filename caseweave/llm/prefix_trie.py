"""The trie of conversation prefixes, its subtree totals by parallel tree contraction.

1. Turns are numbered within their conversation and rebuilt conversations put together, on digests of the turns.
2. A prefix is known by sums over its turns of four 32-bit numbers drawn from (place, turn).  Equal prefixes
   are one node, named by its smallest conversation and its depth.
3. The tree is contracted in rounds.  Rake: leaves give what they carry to their parents and go.  Compress:
   of the nodes with one child left, an independent set is spliced out of its chains; a spliced node gives what
   it carries to its parent, leaves its place to its child, and is written down as "the child's total plus this".
   The set is chosen by bits of the depth, which halves an unbroken chain each round, and later by draws.
4. Spliced nodes are expanded: each points to a node that went later, so following the pointers by doubling
   gives every total in a few rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.plans.ordered import SLICE, range_slices
from caseweave.session import materialise

#: The prefix that comes from another conversation has a length below SHARED; conversations are taken in groups of GROUP.
SHARED, GROUP = 9, 5
LANES = ("s1", "s2", "s3", "s4")
#: Ids of one chunk differ in the lowest bits only, so a chunk holds 2**CHUNK_BITS ids at most.
CHUNK_BITS = 12

ACTIVE, RAKED, SPLICED = 0, 1, 2


def _so_far(rows: DataFrame, key: str, order: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """``rows`` with every column of ``totals`` replaced by its sum up to the row, within ``key``, in ``order``.

    Rows are sorted in ranges over key and order; a range is summed on its own and starts from the sums of
    those before it, so a long conversation is spread over many tasks.
    """
    cut = range_slices(rows, [key, *order])
    here = Window.partitionBy(key, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(key, SLICE).agg(*[F.sum(t).alias(t) for t in totals])
    start = sums.select(key, SLICE, *[F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"_{t}") for t in totals])
    summed = cut.withColumns({t: F.sum(t).over(here) for t in totals})
    return summed.join(start, [key, SLICE]).withColumns({t: F.col(t) + F.col(f"_{t}") for t in totals}).drop(
        SLICE, *[f"_{t}" for t in totals]
    )


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(c, p, turn_key, n_bytes): turns in order, null turns first, ties by a digest of role and text.

    ``turn_key`` is the digest, ``n_bytes`` the UTF-8 length of the text.  Equal rows are counted before the
    shuffle and unfolded once they have their place.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn",
        F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text).cast("binary"), 256)).alias("turn_key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    counted = rows.groupBy("c", "turn", "turn_key", "n_bytes").agg(F.count(F.lit(1)).alias("copies"))
    placed = _so_far(counted.withColumn("upto", F.col("copies")), "c", ["turn", "turn_key"], ["upto"])
    return placed.select(
        "c", F.explode(F.sequence(F.col("upto") - F.col("copies") + 1, F.col("upto"))).alias("p"), "turn_key", "n_bytes"
    )


def rebuilt(turns: DataFrame, shared: int = SHARED, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (c, d, turn_key, n_bytes, last), and (c, total) with their lengths.

    The first h turns come from conversation c - c % group, where h is the CRC-32 of c as text modulo
    ``shared``; c's own turns after its first h follow.
    """
    lengths = turns.groupBy("c").agg(F.count(F.lit(1)).alias("length"))
    # A head has fewer than ``shared`` turns, and serves ``group`` conversations.
    heads = turns.where((F.col("p") < shared) & (F.col("c") % group == 0)).groupBy("c").agg(
        F.sort_array(F.collect_list(F.struct("p", "turn_key", "n_bytes"))).alias("head")
    )
    taken = F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0))).cast("long")
    plan = (
        lengths.withColumn("h", (F.crc32(F.col("c").cast("string").cast("binary")) % shared).cast("int"))
        .withColumn("base", F.col("c") - F.col("c") % group)
        .join(heads.withColumnRenamed("c", "base"), "base", "left")
        .withColumn("head", F.coalesce("head", F.array().cast("array<struct<p:bigint,turn_key:binary,n_bytes:bigint>>")))
        .select("c", "h", taken.alias("taken"), F.slice("head", F.lit(1), taken.cast("int")).alias("head"), "length")
    )
    plan = materialise(plan.withColumn("total", F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))))
    first = plan.select("c", "total", F.explode("head").alias("t")).select(
        "c", F.col("t.p").alias("d"), "t.turn_key", "t.n_bytes", "total"
    )
    own = turns.join(plan.select("c", "h", "taken", "total"), "c").where("p > h").select(
        "c", (F.col("p") - F.col("h") + F.col("taken")).alias("d"), "turn_key", "n_bytes", "total"
    )
    rows = first.unionByName(own).withColumn("last", F.col("d") == F.col("total")).drop("total")
    return rows, plan.select("c", "total")


def _key(depth: Column, lanes: Sequence[Column]) -> Column:
    return F.concat_ws(".", depth.cast("string"), *[F.hex(x) for x in lanes])


def prefix_nodes(rows: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, parent_key, conv_id, depth, n_convs, n_bytes) per node but the root, and (key, c) of the conversations' ends."""
    drawn = F.sha2(F.concat_ws(":", F.col("d").cast("string"), F.hex("turn_key")).cast("binary"), 256)
    lanes = {s: F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("long") for i, s in enumerate(LANES)}
    own = rows.withColumns(lanes).withColumns({f"o{s}": F.col(s) for s in LANES}).drop("turn_key")
    summed = _so_far(own, "c", ["d"], LANES)
    keyed = materialise(summed.select(
        "c", "d", "n_bytes", "last", _key(F.col("d"), [F.col(s) for s in LANES]).alias("key"),
        _key(F.col("d") - 1, [F.col(s) - F.col(f"o{s}") for s in LANES]).alias("parent_key"),
    ))
    nodes = keyed.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("c").alias("conv_id"), F.min("d").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"), F.min("n_bytes").alias("n_bytes"),
    )
    empty = lengths.where("total = 0").select(root_key().alias("key"), "c")
    return nodes, keyed.where("last").select("key", "c").unionByName(empty)


def root_key() -> Column:
    return _key(F.lit(0), [F.lit(0)] * len(LANES))


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of the ascending, comma-joined ids of every key.

    Ids meet in chunks of a bounded range; the chunks of a key are fed to the digest one after the other,
    so the ids of a key are never together in memory.
    """
    chunks = ends.groupBy("key", F.shiftright("c", CHUNK_BITS).alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, keys, found = None, hashlib.sha256(), [], []
        for batch in batches:
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == current:
                    digest.update(b",")
                else:
                    if current is not None:
                        keys.append(current)
                        found.append(digest.hexdigest())
                    current, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["key", "ends_sha256"])
            keys, found = [], []
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    return chunks.repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids").mapInArrow(
        digested, "key string, ends_sha256 string"
    )


#: What a node carries and passes on.
_CARRIED = ("leaves", "saved")


def _coin(c: str, d: str, turn: int, bits: int) -> Column:
    """0 or 1 for a node, the same wherever it is asked in round ``turn``."""
    if turn < bits:
        return F.shiftright(F.col(d), turn).bitwiseAND(F.lit(1))
    return F.xxhash64(F.col(c), F.col(d), F.lit(turn)).bitwiseAND(F.lit(1))


#: Nodes that one task of a round works on.
_NODES_PER_TASK = 250_000


def _message(target: tuple[str, str], minus: int = 0, out: Column | None = None, into: Column | None = None,
             carry: bool = True, up: tuple[str, str] | None = None) -> Column:
    """What a node tells another: fewer children, changes of the exclusive or, sums to add, a new parent."""
    none, nought = F.lit(None).cast("long"), F.lit(0).cast("long")
    change = lambda x: F.lit(0).cast("long") if x is None else x
    return F.struct(
        F.col(target[0]).alias("c"), F.col(target[1]).alias("d"), none.alias("pc"), none.alias("pd"),
        F.lit(-minus).cast("long").alias("k"), change(out).alias("kc"), change(into).alias("kd"),
        *[(F.col(x) if carry else nought).alias(x) for x in _CARRIED],
        F.lit(None).cast("int").alias("status"),
        *[(none if up is None else F.col(u)).alias(f"new_{p}") for p, u in zip(("pc", "pd"), up or ("", ""), strict=True)],
    )


def _told(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """``nodes`` after what the ``messages`` say to each: one shuffle, summed in map tasks first."""
    own = nodes.withColumns({"new_pc": F.lit(None).cast("long"), "new_pd": F.lit(None).cast("long")})
    return own.unionByName(messages).groupBy("c", "d").agg(
        F.coalesce(F.max("new_pc"), F.max("pc")).alias("pc"), F.coalesce(F.max("new_pd"), F.max("pd")).alias("pd"),
        F.sum("k").alias("k"), F.bit_xor("kc").alias("kc"), F.bit_xor("kd").alias("kd"),
        *[F.sum(x).alias(x) for x in _CARRIED], F.max("status").alias("status"),
    )


def _round(active: DataFrame, turn: int, bits: int) -> DataFrame:
    """One rake and one compress: the nodes with their ``status`` afterwards."""
    inner = F.col("pc").isNotNull()
    leaves = active.where((F.col("k") == 0) & inner)
    raked = _told(active.where((F.col("k") > 0) | ~inner), leaves.select(
        _message(("pc", "pd"), minus=1, out=F.col("c"), into=F.col("d")).alias("m")
    ).select("m.*"))
    chosen = (F.col("k") == 1) & inner & (_coin("c", "d", turn, bits) == 1) & (_coin("kc", "kd", turn, bits) == 0)
    marked = raked.withColumn("status", F.when(chosen, SPLICED).otherwise(ACTIVE))
    # One pass over the nodes gives the nodes themselves and what the spliced ones say.  No message reaches
    # a spliced node: neither its parent nor its child is spliced with it.
    swap = (F.col("c").bitwiseXOR(F.col("kc")), F.col("d").bitwiseXOR(F.col("kd")))
    messages = marked.where(F.col("status") == SPLICED).select(F.explode(F.array(
        _message(("pc", "pd"), out=swap[0], into=swap[1]), _message(("kc", "kd"), carry=False, up=("pc", "pd")),
    )).alias("m")).select("m.*")
    return leaves.withColumn("status", F.lit(RAKED)).unionByName(_told(marked, messages))


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(c, d, leaves, saved): for nodes (c, d, pc, pd, k, kc, kd, leaves, saved), the sums over each node's subtree.

    The root has a null parent; ``k`` children have the exclusive or (``kc``, ``kd``) of their ids.  The work
    of a round falls with the tree, and small rounds use few tasks; what reaches the driver is one depth and
    one count per round.
    """
    def few(rows: DataFrame, n: int) -> DataFrame:
        return rows.coalesce(-(-n // _NODES_PER_TASK))

    state = nodes.withColumn("status", F.lit(ACTIVE))
    size = state.agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).first()
    total, bits = size["n"], int(size["d"] or 0).bit_length()
    left, gone, turn = total, [], 0
    while left > 1:
        after = materialise(few(_round(few(state, left), turn, bits), left))
        gone.append(after.where(F.col("status") != ACTIVE))
        state = after.where(F.col("status") == ACTIVE)
        left = state.count()
        turn += 1
    gone.append(state.withColumn("status", F.lit(RAKED)))
    spliced = F.col("status") == SPLICED
    known = materialise(few(reduce(DataFrame.unionByName, gone).select(
        "c", "d", F.when(spliced, F.col("kc")).alias("tc"), F.when(spliced, F.col("kd")).alias("td"), *_CARRIED
    ), max(total, 1)))
    while not known.where("tc IS NOT NULL").isEmpty():
        a, b = known.where("tc IS NOT NULL").alias("a"), known.alias("b")
        moved = a.join(b, (F.col("a.tc") == F.col("b.c")) & (F.col("a.td") == F.col("b.d"))).select(
            "a.c", "a.d", "b.tc", "b.td", *[(F.col(f"a.{x}") + F.col(f"b.{x}")).alias(x) for x in _CARRIED]
        )
        known = materialise(few(moved.unionByName(known.where("tc IS NULL")), total))
    return known.select("c", "d", *_CARRIED)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256).

    Every conversation is rebuilt (``rebuilt``); each distinct sequence of its first d turns (role, text) is a
    node at depth d, and all conversations are members of the root.  ``conv_id`` is the smallest member and
    ``n_convs`` the number of members.  ``n_leaves`` counts the childless nodes of the subtree, ``saved_tokens``
    sums over it (n_convs - 1) times the UTF-8 bytes of a node's last text.  ``ends_sha256`` is the digest of the ids of
    the members that end at the node, ascending and comma-joined.

    Null roles and texts are empty; null turns come first, equal turns are ordered by a digest of role and
    text, repeated rows are repeated turns.  Rows without a conv_id belong to no conversation and are left out.  Other
    columns are not read.  Without a conversation there is no node.
    """
    turns = materialise(numbered_turns(conversations))
    rows, lengths = rebuilt(turns)
    total = lengths.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    lowest = total.first()["conv_id"]
    inner, ends = prefix_nodes(rows, lengths)
    inner = materialise(inner)
    # All nodes of depth 1 have the root as parent; the rest find theirs by its key.
    top = inner.where("depth = 1").withColumn("parent_conv_id", F.lit(lowest).cast("long"))
    deep = inner.where("depth > 1").join(
        inner.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key"
    )
    columns = ("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_bytes")
    root = total.where("n_convs > 0").select(
        root_key().alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs", F.lit(0).cast("long").alias("n_bytes"),
    )
    named = top.select(*columns).unionByName(deep.select(*columns)).unionByName(root)
    # Every node counts itself in at its parent: children, and the exclusive or of their ids.
    nought = F.lit(0).cast("long")
    own = named.select(
        F.col("conv_id").alias("c"), F.col("depth").alias("d"), "key", F.col("parent_conv_id").alias("pc"), "n_convs", "n_bytes",
        nought.alias("k"), nought.alias("kc"), nought.alias("kd"),
    )
    none = F.lit(None).cast("long")
    counted = named.where("depth > 0").select(
        F.col("parent_conv_id").alias("c"), (F.col("depth") - 1).alias("d"), F.lit(None).cast("string").alias("key"), none.alias("pc"),
        none.alias("n_convs"), none.alias("n_bytes"), F.lit(1).cast("long").alias("k"), F.col("conv_id").alias("kc"), F.col("depth").alias("kd"),
    )
    nodes = materialise(own.unionByName(counted).groupBy("c", "d").agg(
        *[F.max(x).alias(x) for x in ("key", "pc", "n_convs", "n_bytes")],
        F.sum("k").alias("k"), F.bit_xor("kc").alias("kc"), F.bit_xor("kd").alias("kd"),
    ))
    totals = subtree_totals(nodes.select(
        "c", "d", "pc", F.when(F.col("pc").isNotNull(), F.col("d") - 1).alias("pd"), "k", "kc", "kd",
        (F.col("k") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
    ))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(end_digests(ends), "key", "left").join(totals, ["c", "d"]).select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("pc").alias("parent_conv_id"), "n_convs",
        F.col("k").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
