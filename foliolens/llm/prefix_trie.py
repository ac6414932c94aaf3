"""The trie of all conversation prefixes, with totals over subtrees, by time-forward processing.

A turn's 120-bit digest stands for its role and text, and a prefix of d turns is the number
H(d) = H(d-1) * ``BASE`` + digest modulo ``PRIME``. Such numbers combine by association: turns
are dealt out by ranges of (conv_id, turn), every task numbers and sums its own stretch, and what
a stretch has before it (at most one conversation for each task, so a small map) is added after.
A conversation of any length is so the work of many tasks.

Nodes are groups of equal (depth, H), combined before their shuffle. A node with at most
``shard_turns`` turns at or beneath it whose parent has more is the root of a shard. Within the
shards, nodes are sorted by reverse level order (Spark's external sort) and pass subtree totals to
their parents through a priority queue that spills sorted runs. The totals of shard roots are
summed by parent, and the nodes above the shards are worked in the same way, in one stream: there
are at most (turns x longest conversation / ``shard_turns``) of them, and neither stream keeps
more than ``QUEUE_ROWS`` messages in memory.

Null role or text counts as empty; a row without conv_id belongs to no conversation; a null turn
comes first; equal turns of a conversation are ordered by the digest of role and text, and
repeated rows are turns of their own. Turns are read as digests after the first scan, so long
texts are no shuffle's work. An empty table has no nodes, not even a root. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import stored

PRIME = 2**127 - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix base").digest(), "big") % PRIME
ROOT = bytes(16)
FAMILY, HEADS, SHARD_TURNS, QUEUE_ROWS, ID_RUN, SALTS = 100, 6, 20_000, 200_000, 4096, 32
TURN = "part int, conv_id long, pos long, h binary, prev binary, chars long"
PATH = "conv_id long, depth long, h binary, prev binary, chars long, turns long"
NODE = "h binary, depth long, prev binary, conv_id long, n_convs long, chars long, label binary"


def packed(number: int) -> bytes:
    return number.to_bytes(16, "big")


def number(value: bytes) -> int:
    return int.from_bytes(value, "big")


def digested(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, digest, chars): one row for each turn, without its text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.sha2(whole, 256).alias("digest"),
        F.char_length(text).cast("long").alias("chars"))


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers and prefix numbers of the turns that a task has, as if they began with it."""
    from pyspark import TaskContext

    part, of, pos, h = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        ids, digests, chars = (batch.column(c).to_pylist() for c in ("conv_id", "digest", "chars"))
        rows = []
        for conv, digest in zip(ids, digests):
            if conv != of:
                of, pos, h = conv, 0, 0
            before, pos = h, pos + 1
            h = (h * BASE + int(digest[:30], 16)) % PRIME
            rows.append((pos, packed(h), packed(before)))
        n, hs, prev = zip(*rows) if rows else ((), (), ())
        yield pa.record_batch({"part": pa.array([part] * len(ids), pa.int32()), "conv_id": pa.array(ids, pa.int64()),
                               "pos": pa.array(n, pa.int64()), "h": pa.array(hs, pa.binary()),
                               "prev": pa.array(prev, pa.binary()), "chars": pa.array(chars, pa.int64())})


def carries(scanned: DataFrame) -> dict[int, tuple[int, int, int]]:
    """{part: (conv_id, turns, H)} for the parts that begin inside a conversation: at most one
    row for each task comes to the driver."""
    ends = scanned.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos", "h")).alias("last"))
    found, open_conv, open_n, open_h = {}, None, 0, 0
    for row in sorted(ends.collect(), key=lambda r: r["part"]):
        conv, n, h = row["last"]["conv_id"], row["last"]["pos"], number(row["last"]["h"])
        if row["first"] == open_conv:
            found[row["part"]] = (open_conv, open_n, open_h)
            if conv == open_conv:
                n, h = open_n + n, (open_h * pow(BASE, n, PRIME) + h) % PRIME
        open_conv, open_n, open_h = conv, n, h
    return found


def carried(df: DataFrame, before: dict[int, tuple[int, int, int]]) -> DataFrame:
    """Rows of ``TURN`` with whole numbers instead of those of their stretch."""
    if not before:
        return df

    def run(batches):
        for batch in batches:
            cols = batch.to_pydict()
            for i, (part, conv) in enumerate(zip(cols["part"], cols["conv_id"])):
                if (carry := before.get(part)) and carry[0] == conv:
                    n = cols["pos"][i]
                    cols["pos"][i] = carry[1] + n
                    at = carry[2] * pow(BASE, n - 1, PRIME)
                    cols["prev"][i] = packed((at + number(cols["prev"][i])) % PRIME)
                    cols["h"][i] = packed((at * BASE + number(cols["h"][i])) % PRIME)
            yield pa.record_batch(cols, schema=batch.schema)

    return df.select("part", "conv_id", "pos", "h", "prev", "chars").mapInArrow(run, TURN)


def rebuilt(turns: DataFrame, before: dict[int, tuple[int, int, int]]) -> DataFrame:
    """``PATH``: for every conversation and depth, from 0, the node that its prefix is."""
    heads = carried(turns.where(f"pos < {HEADS}"), before).where(f"pos < {HEADS}")  # a place in a stretch is no later than in the whole
    heads = heads.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "h", "prev", "chars"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).join(heads, "conv_id")
    bases = heads.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    plan = (convs.withColumn("own_from", F.crc32(F.col("conv_id").cast("string")) % HEADS)
            .withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(bases, "base", "left")
            .withColumn("k", F.least("own_from", F.coalesce(F.size("base_head"), F.lit(0)))))
    last = lambda head, n: F.when(F.col(n) > 0, F.get(f"{head}.h", F.col(n).cast("int") - 1))
    plan = stored(plan.select(
        "conv_id", "own_from", "k", (F.col("k") + F.greatest(F.col("n") - F.col("own_from"), F.lit(0))).alias("turns"),
        last("base_head", "k").alias("new"), last("head", "own_from").alias("old"),
        F.when(F.col("k") > 0, F.slice("base_head", F.lit(1), F.col("k").cast("int"))).alias("shared")))
    root = plan.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("h"), F.lit(None).cast("binary").alias("prev"),
                       F.lit(0).cast("long").alias("chars"), "turns")
    shared = plan.select("conv_id", F.explode("shared").alias("s"), "turns").select(
        "conv_id", F.col("s.pos").alias("depth"), "s.h", "s.prev", "s.chars", "turns")

    def shifted(batches):
        """H of the rebuilt prefix: the own turns from ``own_from`` on, after ``new`` instead of ``old``."""
        for batch in batches:
            cols = batch.to_pydict()
            h, prev = cols["h"], cols["prev"]
            for i, (pos, start, new, old) in enumerate(zip(cols["pos"], cols["own_from"], cols.pop("new"), cols.pop("old"))):
                if change := (number(new or ROOT) - number(old or ROOT)) % PRIME:
                    at = change * pow(BASE, pos - start - 1, PRIME)
                    prev[i], h[i] = packed((number(prev[i]) + at) % PRIME), packed((number(h[i]) + at * BASE) % PRIME)
            cols["depth"] = [k + pos - start for k, pos, start in zip(cols.pop("k"), cols.pop("pos"), cols.pop("own_from"))]
            yield pa.record_batch([pa.array(cols[c], t) for c, t in (
                ("conv_id", pa.int64()), ("depth", pa.int64()), ("h", pa.binary()), ("prev", pa.binary()),
                ("chars", pa.int64()), ("turns", pa.int64()))], names=["conv_id", "depth", "h", "prev", "chars", "turns"])

    own = (carried(turns, before).join(plan.drop("shared"), "conv_id").where("pos > own_from")
           .select("conv_id", "pos", "h", "prev", "chars", "turns", "own_from", "k", "new", "old").mapInArrow(shifted, PATH))
    return stored(root.unionByName(shared).unionByName(own))


class SpillingQueue:
    """A priority queue of (-depth, h, leaves, saved): beyond ``limit`` entries it goes on as a
    sorted run in an unnamed scratch file of the task, which vanishes with it."""

    FORMAT = ">q16sqq"

    def __init__(self, limit: int = QUEUE_ROWS, fan_in: int = 32):
        self.limit, self.fan_in, self.live, self.runs = limit, fan_in, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.live, item)
        if len(self.live) > self.limit:
            entries, self.live = sorted(self.live), []
            if len(self.runs) >= self.fan_in:
                heads = [self._whole(head, run) for head, _, run in self.runs]
                entries, self.runs = heapq.merge(entries, *heads), []
            self._add(self._written(entries))

    @staticmethod
    def _whole(head: tuple, run: Iterator[tuple]) -> Iterator[tuple]:
        yield head
        yield from run

    def _written(self, entries) -> Iterator[tuple]:
        file = tempfile.TemporaryFile()
        for entry in entries:
            file.write(struct.pack(self.FORMAT, *entry))
        file.seek(0)
        while data := file.read(struct.calcsize(self.FORMAT) * 1024):
            yield from struct.iter_unpack(self.FORMAT, data)
        file.close()

    def _add(self, run: Iterator[tuple]) -> None:
        if (head := next(run, None)) is not None:
            heapq.heappush(self.runs, (head, id(run), run))

    def take(self, key: tuple) -> tuple[int, int, int]:
        """How many messages for the node ``key`` there are, and their sums; earlier keys are gone."""
        n = leaves = saved = 0
        while True:
            from_run = bool(self.runs) and (not self.live or self.runs[0][0] < self.live[0])
            first = self.runs[0][0] if from_run else self.live[0] if self.live else None
            if first is None or first[:2] > key:
                return n, leaves, saved
            if from_run:
                self._add(heapq.heappop(self.runs)[2])
            else:
                heapq.heappop(self.live)
            if first[:2] == key:
                n, leaves, saved = n + 1, leaves + first[2], saved + first[3]


def time_forward(batches: Iterator[pa.RecordBatch], limit: int = QUEUE_ROWS) -> Iterator[pa.RecordBatch]:
    """Nodes in reverse level order get their totals and pass them on to their parents."""
    queue = SpillingQueue(limit)
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in ("h", "depth", "prev", "n_convs", "chars", "label", "in_children", "in_leaves", "in_saved")}
        totals = []
        for h, depth, prev, n_convs, chars, label, children, leaves, saved in zip(*cols.values()):
            n, more_leaves, more_saved = queue.take((-depth, h))
            children += n
            leaves = leaves + more_leaves if children else 1
            saved += more_saved + (n_convs - 1) * chars
            if h != label and prev is not None:
                queue.push((1 - depth, prev, leaves, saved))
            totals.append((children, leaves, saved))
        kept = [c for c in batch.schema.names if not c.startswith("in_")]
        sums = list(zip(*totals)) or [(), (), ()]
        yield pa.record_batch([batch.column(c) for c in kept] + [pa.array(s, pa.int64()) for s in sums],
                              names=kept + ["n_children", "n_leaves", "saved_tokens"])


def totalled(nodes: DataFrame, queue_rows: int) -> DataFrame:
    schema = f"{NODE}, n_children long, n_leaves long, saved_tokens long"
    return nodes.mapInArrow(lambda batches: time_forward(batches, queue_rows), schema)


def end_digests(path: DataFrame, id_run: int = ID_RUN) -> DataFrame:
    """(h, ends_sha256) of the nodes where conversations end. Ids are sorted by ranges over all
    tasks and joined in runs of at most ``id_run``; a digest then streams through its node's runs."""
    def runs(batches):
        of, ids = None, []
        rows: list[tuple] = []
        for batch in batches:
            for h, conv in zip(batch.column("h").to_pylist(), batch.column("conv_id").to_pylist()):
                if h != of or len(ids) == id_run:
                    if ids:
                        rows.append((of, ids[0], ",".join(map(str, ids))))
                    of, ids = h, []
                ids.append(conv)
            yield table(rows)
            rows = []
        if ids:
            yield table([(of, ids[0], ",".join(map(str, ids)))])

    def table(rows):
        h, first, text = zip(*rows) if rows else ((), (), ())
        return pa.record_batch([pa.array(h, pa.binary()), pa.array(first, pa.int64()), pa.array(text, pa.string())], names=["h", "first", "ids"])

    def digests(batches):
        of, sha = None, None
        for batch in batches:
            done = []
            for h, ids in zip(batch.column("h").to_pylist(), batch.column("ids").to_pylist()):
                if h != of:
                    if sha:
                        done.append((of, sha.hexdigest()))
                    of, sha = h, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.record_batch([pa.array([h for h, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["h", "ends_sha256"])
        if sha:
            yield pa.record_batch([pa.array([of], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["h", "ends_sha256"])

    ends = path.where("depth = turns").select("h", "conv_id")
    dealt = ends.repartitionByRange("h", "conv_id").sortWithinPartitions("h", "conv_id").mapInArrow(runs, "h binary, first long, ids string")
    return dealt.repartition("h").sortWithinPartitions("h", "first").mapInArrow(digests, "h binary, ends_sha256 string")


def trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
         shard_turns: int = SHARD_TURNS, queue_rows: int = QUEUE_ROWS, id_run: int = ID_RUN) -> DataFrame:
    """Per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and its prefix number ``prefix`` (16 bytes)."""
    turns = stored(digested(conversations, id_col, turn_col, role_col, text_col))
    keys = ["conv_id", "turn", "digest"]
    scanned = stored(turns.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(stretches, TURN))
    path = rebuilt(scanned, carries(scanned))
    nodes = stored(path.groupBy("depth", "h").agg(
        F.min("prev").alias("prev"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"),
        F.sum(F.col("turns") - F.col("depth") + 1).alias("beneath")))
    above = nodes.where(F.col("beneath") > shard_turns)
    # The first node of a conversation's path that is not above the shards names its shard.
    labels = (path.join(above.select("h"), "h", "left_anti").groupBy("conv_id")
              .agg(F.min(F.struct("depth", "h"))["h"].alias("label")))
    inner = nodes.where(F.col("beneath") <= shard_turns).join(labels, "conv_id")
    zeros = [F.lit(0).cast("long").alias(c) for c in ("in_children", "in_leaves", "in_saved")]
    columns = [c.split()[0] for c in NODE.split(", ")]
    small = stored(totalled(inner.select(*columns, *zeros).repartition("label").sortWithinPartitions(F.desc("depth"), "h"), queue_rows))
    shard_roots = small.where("h = label")
    sent = shard_roots.groupBy(F.col("prev").alias("h")).agg(F.count("*").alias("in_children"), F.sum("n_leaves").alias("in_leaves"),
                                                            F.sum("saved_tokens").alias("in_saved"))
    top = above.withColumn("label", F.lit(None).cast("binary")).join(sent, "h", "left").select(
        *columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_children", "in_leaves", "in_saved")])
    top = stored(totalled(top.repartition(1).sortWithinPartitions(F.desc("depth"), "h"), queue_rows))
    # A node inside a shard has its parent there; a node above, or a shard root, may share a parent with very many.
    parent = lambda df: df.select(F.col("h").alias("prev"), F.col("conv_id").alias("parent_conv_id"))
    within = small.where("h <> label").join(parent(small), "prev", "left")
    salt = F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int").alias("salt")
    across = (top.unionByName(shard_roots).select("*", salt)
              .join(parent(top).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), ["prev", "salt"], "left"))
    found = within.unionByName(across.drop("salt")).join(end_digests(path, id_run), "h", "left")
    none = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), F.col("h").alias("prefix"))
