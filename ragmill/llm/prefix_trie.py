"""The trie of conversations' turns: which conversations begin alike, and what a cache of prefixes would save.

Turns are told apart by SHA-256 of role and text. Numpy scans give every prefix a polynomial rolling fingerprint (scans), and since such
fingerprints add up, that of a rebuilt conversation follows from those of its parts. Prefixes of one depth and fingerprint are a group.
A group is verified at its own turn against its representative, its smallest conversation; as equal fingerprints and an equal last
turn leave equal fingerprints one turn before, groups verified at every turn hold equal prefixes. Where a group fails, its conversations
carry the digest of that turn as a mark from there on, and marked prefixes are told apart by their marks too.

A node is its smallest member and its depth, so the nodes of one representative are a chain down the trie. Sums over subtrees go up in
two steps: totals of chains by pointer doubling, whose rounds are the logarithm of how deep chains are nested, and running sums along
each chain.

Nothing is gathered by conversation, node or parent: groups are aggregated before the shuffle, a long conversation is scanned in ranges.
Only the digest of a node's conversations is sequential by its definition: their ids are joined in ranges, by pieces of PIECE, and one
task hashes the pieces of a node as they come.

Defined results: rows without a conv_id belong to no conversation; a null role or text is an empty one; turns of one number (null comes
first) are in the order of role and then digest; rows repeated as a whole are turns of their own; an empty table gives no rows, not even a
root; texts are read whole, however long; columns other than the four, whatever their names, have no effect and are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table
from .scans import Ring, running

#: Two rings, whose fingerprints make one of 62 bits.
RINGS = {"g1": Ring(1_103_515_245, (1 << 31) - 1), "g2": Ring(1_220_703_125, (1 << 31) - 19)}
#: Ids of a piece of a node's list of conversations.
PIECE = 1024
#: A rebuilt conversation begins with up to HEAD - 1 turns of the first conversation of its BLOCK.
BLOCK, HEAD = 20, 4
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, digest, n_words."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    words = F.size(F.filter(F.split(t, r"[ \t-\r]+", -1), lambda w: w != "")).cast("long")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256))
    kept = df.where(F.col(conv).isNotNull())
    return kept.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), r.alias("role"), digest.alias("digest"), words.alias("n_words"))


def prefixes(rows: DataFrame, rings: dict[str, Ring]) -> DataFrame:
    """A row for each turn: conv_id, digest, n_words, pos (from 0), and the fingerprints of the turns up to it and before it."""
    terms = [F.pmod(F.xxhash64("digest", F.lit(i)), F.lit(ring.modulus)).alias(g) for i, (g, ring) in enumerate(rings.items())]
    keyed = rows.select("conv_id", "turn", "role", "digest", "n_words", *terms)
    return running(keyed, "conv_id", [F.col("turn"), F.col("role"), F.col("digest")], rings, "prefixes").drop("turn", "role")


def _together(g: list[Column]) -> Column:
    """Residues in one long."""
    return F.shiftleft(g[0], 31).bitwiseOR(g[1])


def heads(scanned: DataFrame, rings: dict[str, Ring]) -> DataFrame:
    """conv_id, n (its turns) and x0, x1, x2: its first turns as structs, null where it has none."""
    one = F.struct("digest", "n_words", *[c for g in rings for c in (g, f"{g}_before")])
    first = scanned.where(F.col("pos") < HEAD - 1).select("conv_id", "pos", one.alias("x"))
    sizes = scanned.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"))
    by = first.groupBy("conv_id").agg(*[F.any_value(F.when(F.col("pos") == i, F.col("x")), ignoreNulls=True).alias(f"x{i}") for i in range(HEAD - 1)])
    return sizes.join(by, "conv_id")


def rebuilt(scanned: DataFrame, rings: dict[str, Ring]) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations, and all conversations with the length that they now have.

    A conversation c gives up its first h turns, h = crc32 of its decimal id modulo 4, for as many as there are of conversation
    c - c % 20. Its later fingerprints are moved, not computed anew: the sum of what it keeps is taken out of its own, shifted by the
    difference in length and added to that of its new beginning.
    """
    known = shared_table(heads(scanned, rings), "heads")
    base = known.select(F.col("conv_id").alias("base_id"), F.col("n").alias("base_n"), *[F.col(f"x{i}").alias(f"b{i}") for i in range(HEAD - 1)])
    h = (F.crc32(F.col("conv_id").cast("string")) % HEAD).alias("h")
    convs = known.select("*", h, (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base_id")).join(base, "base_id", "left")
    convs = convs.withColumn("hb", F.least(F.col("h"), F.coalesce("base_n", F.lit(0))))

    def at(prefix: str, count: str, g: str) -> Column:
        """The fingerprint of the first turns, 0 of none."""
        return F.coalesce(*[F.when(F.col(count) == i + 1, F.col(f"{prefix}{i}")[g]) for i in range(HEAD - 1)], F.lit(0))

    given = [at("x", "h", g).alias(f"{g}_given") for g in rings] + [at("b", "hb", g).alias(f"{g}_taken") for g in rings]
    length = (F.col("hb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
    convs = shared_table(convs.select("conv_id", "h", "hb", length, *given, F.array(*[f"b{i}" for i in range(HEAD - 1)]).alias("base")), "conversations")

    def moved(g: str, c: str) -> Column:
        ring = rings[g]
        back = F.array(*[F.lit(pow(ring.base, -k, ring.modulus)).cast("long") for k in range(HEAD)])
        shift = F.get(back, (F.col("h") - F.col("hb")).cast("int"))
        return F.pmod(F.col(f"{g}_taken") + F.pmod(F.col(c) - F.col(f"{g}_given"), F.lit(ring.modulus)) * shift % ring.modulus, F.lit(ring.modulus))

    own = scanned.join(convs.drop("base"), "conv_id").where("pos >= h").select(
        "conv_id",
        (F.col("pos") - F.col("h") + F.col("hb") + 1).alias("depth"),
        "digest",
        "n_words",
        _together([moved(g, g) for g in rings]).alias("g"),
        _together([moved(g, f"{g}_before") for g in rings]).alias("g_before"),
        "length",
    )
    lent = convs.where("hb > 0").select("conv_id", "length", F.posexplode(F.slice("base", 1, F.col("hb").cast("int"))).alias("i", "x")).select(
        "conv_id",
        (F.col("i") + 1).cast("long").alias("depth"),
        "x.digest",
        "x.n_words",
        _together([F.col(f"x.{g}") for g in rings]).alias("g"),
        _together([F.col(f"x.{g}_before") for g in rings]).alias("g_before"),
        "length",
    )
    members = own.unionByName(lent).select("*", (F.col("depth") == F.col("length")).alias("ends")).drop("length")
    return shared_table(members, "members"), convs.select("conv_id", "length")


def verified(members: DataFrame) -> DataFrame:
    """Adds marks and marks_before: what tells prefixes of one depth and fingerprint apart. Both are empty where all groups hold.

    Members are counted by their turn before their group is looked at, so a group of any size is compared with its representative as a
    few rows, one for each different turn.
    """
    turns_of = members.groupBy("depth", "g", "digest").agg(F.min("conv_id").alias("least"))
    groups = turns_of.groupBy("depth", "g").agg(F.min_by("digest", "least").alias("of_representative"), F.count(F.lit(1)).alias("n"))
    failed = shared_table(groups.where("n > 1").select("depth", "g"), "failed")
    if failed.isEmpty():
        return members.select("*", F.lit("").alias("marks"), F.lit("").alias("marks_before"))
    marks = members.join(failed, ["depth", "g"], "left_semi").select("conv_id", F.col("depth").alias("at"), F.concat_ws(":", "depth", F.hex("digest")).alias("mark"))
    met = members.select("conv_id", "depth").join(marks, "conv_id").where("at <= depth")

    def joined(rows: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["mark"]), ",")

    one = F.struct("at", "mark")
    labels = met.groupBy("conv_id", "depth").agg(joined(one).alias("marks"), joined(F.when(F.col("at") < F.col("depth"), one)).alias("marks_before"))
    marked = members.join(labels, ["conv_id", "depth"], "left")
    return shared_table(marked.fillna("", ["marks", "marks_before"]), "marked")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and conversation -> node, first conversation, ids joined by commas; PIECE ids at most."""
    at, ids, out = None, [], []

    def close() -> None:
        if ids:
            out.append((*at, ids[0], ",".join(map(str, ids))))
            ids.clear()

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["depth", "g", "marks", "first", "ids"])

    for batch in batches:
        for node in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if node[:3] != at or len(ids) == PIECE:
                close()
                at = node[:3]
            ids.append(node[3])
        if out:
            yield batch_of()
            out.clear()
    close()
    if out:
        yield batch_of()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first conversation -> node and the digest of all its ids."""
    at, h = None, None

    def batch_of(out: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["depth", "g", "marks", "ends_sha256"])

    for batch in batches:
        out = []
        for depth, g, marks, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
            if (depth, g, marks) == at:
                h.update(b",")
            else:
                if h:
                    out.append((*at, h.hexdigest()))
                at, h = (depth, g, marks), hashlib.sha256()
            h.update(ids.encode())
        if out:
            yield batch_of(out)
    if h:
        yield batch_of([(*at, h.hexdigest())])


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, g, marks, ends_sha256 from depth, g, marks, conv_id: conversations that end at a node, smallest first."""
    node = ["depth", "g", "marks"]
    pieces = ends.select(*node, "conv_id").repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id").mapInArrow(_pieces, "depth long, g long, marks string, first long, ids string")
    return pieces.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(_digests, "depth long, g long, marks string, ends_sha256 string")


def chain_totals(chains: DataFrame) -> DataFrame:
    """conv_id, leaves and saved of a chain and all chains that hang on it, from conv_id, up (the chain it hangs on, or null), leaves, saved.

    After k rounds a chain has the sums of those less than 2^k steps below it, and knows the one 2^k steps above it.
    """
    chains = shared_table(chains, "chains")
    while not chains.where("up is not null").isEmpty():
        below = chains.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = chains.where("up is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        both = chains.join(below, "conv_id", "left").join(above, "up", "left")
        more = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        chains = shared_table(both.select("conv_id", F.col("next").alias("up"), *more), "chains")
    return chains.drop("up")


def prefix_trie(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rings: dict[str, Ring] = RINGS) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    members, convs = rebuilt(prefixes(turns(df, conv=conv, turn=turn, role=role, text=text), rings), rings)
    members = verified(members)
    node = ["depth", "g", "marks"]
    grouped = members.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("g_before").alias("g_before"), F.max("marks_before").alias("marks_before"), F.max("n_words").alias("n_words")
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    at_root = [F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("g"), F.lit("").alias("marks")]
    ends = members.where("ends").select(*node, "conv_id").unionByName(convs.where("length = 0").select(*at_root, "conv_id"))
    rooted = root.select(*at_root, "conv_id", "n_convs", F.lit(None).cast("long").alias("g_before"), F.lit(None).cast("string").alias("marks_before"), F.lit(0).cast("long").alias("n_words"))
    nodes = shared_table(grouped.unionByName(rooted).join(ends_digests(ends), node, "left").fillna(EMPTY, ["ends_sha256"]), "nodes")

    # Parents: that of the first turns is the root, a single row; the others meet theirs by depth and fingerprint.
    least = nodes.where("depth = 0").select(F.col("conv_id").alias("parent_conv_id"))
    parents = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("g").alias("g_before"), F.col("marks").alias("marks_before"), F.col("conv_id").alias("parent_conv_id"))
    deeper = nodes.where("depth > 1").join(parents, ["depth", "g_before", "marks_before"])
    top = nodes.where("depth = 1").join(F.broadcast(least))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", (F.col("n_words") * (F.col("n_convs") - 1)).alias("saved"), "ends_sha256"]
    linked = deeper.select(*columns).unionByName(top.select(*columns)).unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns))
    linked = shared_table(linked, "linked")

    children = linked.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = linked.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    counted = shared_table(counted.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "counted")

    # A chain hangs where its uppermost node's parent is of another chain. Totals of chains that hang on the root's are needed as they
    # are and go no further up.
    hangs = counted.where("parent_conv_id != conv_id").select("conv_id", F.col("parent_conv_id").alias("on"), (F.col("depth") - 1).alias("at"))
    sums = counted.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    chains = sums.join(hangs, "conv_id").join(F.broadcast(least), F.col("on") == F.col("parent_conv_id"), "left")
    totals = chain_totals(chains.select("conv_id", F.when(F.col("parent_conv_id").isNull(), F.col("on")).alias("up"), "leaves", "saved"))
    hung = totals.join(hangs, "conv_id").groupBy(F.col("on").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    whole = counted.join(hung, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256",
        (F.col("leaf") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
    )
    up = running(whole, "conv_id", [F.col("depth").desc()], {"n_leaves": None, "saved_tokens": None}, "subtrees")
    return up.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
