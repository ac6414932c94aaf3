"""Near-duplicate passages by compact windows.

A text is a sequence of five-word shingle hashes. For each of ``HASHES`` hash functions the
Cartesian tree over its values cuts the sequence into compact windows: all subsequences
between ``low`` and ``high`` that contain the tree node have that node's value as their
min-hash. Windows narrower than ``LEAST`` shingles hold no passage and are left out, which
leaves about 2 / ``LEAST`` windows a shingle; only a least value of some stretch of ``LEAST`` shingles can be
the node of a wider one, and its bounds are the nearest smaller values of that kind, so the tree
itself is not built. Windows that share the value and the run of
shingles on one side of it (the side with the smaller next hash, so both texts choose alike)
form a group, sorted by what follows that run on the same side in ever longer runs. A window is linked to the first
of its group, to the first with the same runs, and to the one before it, which shares the longest runs; so in a group
that a frequent line makes, windows that share a whole passage around it still meet. Groups that stay in several classes are then
compared as a whole, and pairs that join classes are verified too (``open_pairs``). Within a batch
of windows before the shuffle, one window of each group and runs goes on. Links of two documents on
neighbouring diagonals are joined as intervals; those that at least ``AGREE`` hash functions or a long equal run confirm are
checked by the shingles that both intervals hold: a passage is kept where the resemblance is at least ``SIMILAR`` and most
shingles of every stretch of ``WORDS`` words are shared. Words put in or left out move the diagonal and cost the
shingles around them. Passages that overlap in a document become one span, and spans that links connect a class.

Null and short texts have no passages; repeats inside one document do not count; documents
are told apart by id: repeated rows count once, of equal texts only the first is compared, and of rows that share an id but not a text the one with
the smallest digest stands, whatever their order; null ids are left out; empty tables give no rows; other columns are
ignored. Equal values inside one text are one node, the first. A very long text is held as eight bytes a word and hash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.llm.common import map_texts, stored
from foliolens.llm.components import components
from foliolens.llm.open_groups import by_part, in_open_groups

SHINGLE, WORDS, SIMILAR = 5, 50, 0.8
HASHES, AGREE, CONTEXT = 4, 2, 8
#: Lengths of the runs by which a group is sorted, six bits of each; diagonals so near count as one.
RUNS, SLIP = range(12, 52, 4), 8
LOOSE = 0.6
# Resemblance s of two equal-sized sets is reached at a common share of 2 s / (1 + s).
ENOUGH = 2 * SIMILAR / (1 + SIMILAR)
#: Stretches of one text that go through a task in one row.
CUTS = 1000
#: A link whose windows agree in so many runs needs no second hash function; it is marked by SURE.
STRONG, SURE = 2, 64
LEAST = WORDS - SHINGLE + 1
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
AT_ONCE = 100_000
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
#: Characters whose words are hashed at once, about.
PIECE = 1 << 17
#: Which code points of the first plane belong to words, as ``\w`` has it.
LETTERS = np.array([chr(c).isalnum() or c == 95 for c in range(1 << 16)])
parting = re.compile(r"\W").search
#: Groups of so many windows are looked at again, as all pairs of a smaller one are links.
LOOK = 4
#: Shingles of a stretch of ``LEAST`` around a node that a window of a group may share at least with another one.
NEEDED = int(np.ceil(SIMILAR * LEAST - 1e-9))
#: Pairs of windows whose hits are held at once.
AT_A_TIME = 4096
# `span` holds low and high, `node` the node and the hash function.
WINDOW = "key long, runs long, doc_id long, span long, node long"
# A link, or, without `b`, a window of a group to be looked at again: `a` is its text and `shift` its node.
LINK = "a long, b long, shift long, low long, high long, hash long, key long"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """XXH64 of each word of each text. Words are the runs of letters, digits and underscores of the lower-cased text."""
    out = [[] for _ in texts]
    for (owners, begin), joined in pieces(texts, str.lower):
        starts, ends, codes = word_places(joined)
        sizes = np.ones(len(codes), np.int64)
        for bound in (0x80, 0x800, 0x10000):
            sizes += codes >= bound
        at = np.r_[0, np.cumsum(sizes)]
        hashes = xxh64(joined.encode(), at[starts], at[ends])
        cut = np.r_[np.searchsorted(starts, begin), len(starts)]
        for owner, i, j in zip(owners, cut[:-1].tolist(), cut[1:].tolist()):
            out[owner].append(hashes[i:j])
    return [np.concatenate(parts) if parts else np.zeros(0, np.uint64) for parts in out]


def xxh64(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the slices [start, end) of ``data``, all at once; slices of 32 bytes and more one by one."""
    import xxhash

    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))

    def turned(x, by):
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    size = ends - starts
    padded = data + bytes(8)
    eight, four, one = (np.ndarray(len(data) + 1, kind, padded, 0, (1,)) for kind in ("<u8", "<u4", "u1"))
    out = p5 + size.astype(np.uint64)
    for lane in range(3):
        (of,) = np.nonzero(size >= 8 * lane + 8)
        if len(of):
            out[of] = turned(out[of] ^ (turned(eight[starts[of] + 8 * lane] * p2, 31) * p1), 27) * p1 + p4
    (of,) = np.nonzero(size & 4)
    out[of] = turned(out[of] ^ (four[starts[of] + (size[of] & -8)].astype(np.uint64) * p1), 23) * p2 + p3
    for last in range(3):
        (of,) = np.nonzero((size & 3) > last)
        out[of] = turned(out[of] ^ (one[starts[of] + (size[of] & -4) + last].astype(np.uint64) * p5), 11) * p1
    out = (out ^ (out >> np.uint64(33))) * p2
    out = (out ^ (out >> np.uint64(29))) * p3
    out ^= out >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]])
    return out


def pieces(texts: list[str | None], changed=str):
    """((numbers of texts, where each begins), text): texts put together, and long ones cut, between words,
    at about ``PIECE`` characters."""
    owners, starts, parts, size = [], [], [], 0
    for owner, text in enumerate(texts):
        text, at = changed(text or ""), 0
        while at < len(text):
            stop = parting(text, at + PIECE - size) if len(text) - at > PIECE - size else None
            part = text[at:stop.start()] if stop else text[at:]
            at += len(part)
            owners.append(owner)
            starts.append(size)
            parts.append(part)
            size += len(part) + 1
            if size >= PIECE:
                yield (owners, starts), "\n".join(parts)
                owners, starts, parts, size = [], [], [], 0
    if parts:
        yield (owners, starts), "\n".join(parts)


def word_places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, code points): where the words of a text are."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = LETTERS[np.minimum(codes, len(LETTERS) - 1)]
    for at in np.flatnonzero(codes >= len(LETTERS)).tolist():
        inside[at + 1] = text[at].isalnum()
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2], codes


def word_counts(texts: list[str | None]) -> np.ndarray:
    counts = np.zeros(len(texts), np.int64)
    for (owners, begin), joined in pieces(texts):
        np.add.at(counts, np.array(owners)[np.searchsorted(begin, word_places(joined)[0], "right") - 1], 1)
    return counts


def chained(values: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` values."""
    out = np.full(max(0, len(values) - n + 1), salt, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(31) + values[i:i + len(out)])
    return out


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every stretch of ``width`` values, by doubling."""
    size, out = 1, values
    while 2 * size <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[:len(values) - width + 1], out[width - size:][:len(values) - width + 1])


def windows(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, node, high) of the Cartesian tree's nodes over at least ``least`` places, bounds included.

    Zeros in ``values`` part texts; the first and last value must be zero. Equal smallest values of a
    segment share one row, with the first as the node.
    """
    if len(values) < least + 2:
        return (np.zeros(0, np.int64),) * 3
    lows = sliding(values, least, np.minimum)
    # the largest of the minima of all stretches that hold a place is its value where it is one of them
    edge = np.zeros(least - 1, values.dtype)
    nodes = sliding(np.concatenate([edge, lows, edge]), least, np.maximum) == values
    at = np.flatnonzero(nodes | (values == 0))
    before, after, first = [0] * len(at), [0] * len(at), [True] * len(at)
    places, stack = at.tolist(), []
    for i, value in enumerate(values[at].tolist()):
        while stack and stack[-1][1] > value:
            after[stack.pop()[0]] = places[i]
        if stack and stack[-1][1] == value:
            before[i], first[i] = before[stack[-1][0]], False
        elif stack:
            before[i] = places[stack[-1][0]]
        stack.append((i, value))
    low, high = np.array(before) + 1, np.array(after) - 1
    kept = (values[at] > 0) & np.array(first) & (high - low + 1 >= least)
    return low[kept], at[kept], high[kept]


def runs_of(sums: np.ndarray, back: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end): differences of running sums, moved to a common place."""
    return (sums[end] - sums[start]) * back[start]


def text_windows(docs: list[int], texts: list[np.ndarray]):
    """Columns (key, runs, doc, low, node, high, hash) for several texts' shingle hashes."""
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + 1) - sizes  # a zero before each text, and one at the end
    values = np.zeros(int(sizes.sum()) + len(texts) + 1, np.uint64)
    for at, text in zip(starts, texts):
        values[at:at + len(text)] = text
    real = np.zeros(len(values), bool)
    real[np.concatenate([np.arange(a, a + n) for a, n in zip(starts, sizes)])] = True
    powers = np.cumprod(np.concatenate([[1], np.full(len(values), FACTOR, np.uint64)]).astype(np.uint64))
    back = np.cumprod(np.concatenate([[1], np.full(len(values), INVERSE, np.uint64)]).astype(np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:-1])])
    text_of = np.repeat(np.arange(len(texts)), sizes + 1)
    rows = []
    for j, multiplier in enumerate(MULTIPLIERS[:HASHES]):
        hashed = np.where(real, np.maximum(mixed(values * multiplier), np.uint64(1)), np.uint64(0))
        low, node, high = windows(hashed, LEAST)
        of = text_of[node]
        begin, end = starts[of], starts[of] + sizes[of]
        # The run of shingles from the node on, or up to it; at an end of the text the other.
        to_right = ((values[node + 1] < values[node - 1]) & (node + CONTEXT <= end)) | (node - begin < CONTEXT - 1)
        start = np.where(to_right, np.minimum(node, end - CONTEXT), np.maximum(node - CONTEXT + 1, begin))
        run = runs_of(sums, back, start, start + CONTEXT)
        key = mixed(run * np.uint64(3) + mixed(hashed[node] + np.uint64(j)) + to_right.astype(np.uint64))
        longer = np.zeros(len(node), np.uint64)
        for length in RUNS:
            first = np.where(to_right, node, np.maximum(node + 1 - length, begin))
            last = np.where(to_right, np.minimum(node + length, end), node + 1)
            bits = mixed(runs_of(sums, back, first, last) + (last - first).astype(np.uint64)) >> np.uint64(58)
            longer = (longer << np.uint64(6)) | bits
        rows.append((key.view(np.int64), longer.view(np.int64), np.array(docs, np.int64)[of], low - begin, node - begin, high - begin,
                     np.full(len(node), j)))
    return [np.concatenate(c) for c in zip(*rows)]


def linked(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Links of windows sorted by (key, runs, doc_id, low)."""
    key, runs = columns[:2]
    new_key = np.r_[True, key[1:] != key[:-1]]
    new = new_key | np.r_[True, runs[1:] != runs[:-1]]
    place = np.arange(len(key))
    first, same = np.maximum.accumulate(np.where(new_key, place, 0)), np.maximum.accumulate(np.where(new, place, 0))
    me = np.flatnonzero(~new_key)
    pairs = np.unique(np.concatenate([np.stack([p[me], me], 1) for p in (first, same, place - 1)]), axis=0)
    return links_of(columns[1:], pairs[pairs[:, 0] != pairs[:, 1]])


def links_of(columns, pairs) -> list[np.ndarray]:
    """Columns of LINK for pairs of rows (runs, doc, low, ...) of different documents whose common interval is wide enough."""
    i, k = pairs.T
    flip = columns[1][i] > columns[1][k]
    a = [np.where(flip, c[k], c[i]) for c in columns]
    b = [np.where(flip, c[i], c[k]) for c in columns]
    shift = a[3] - b[3]
    low, high = np.maximum(a[2], b[2] + shift), np.minimum(a[4], b[4] + shift)
    ok = (a[1] != b[1]) & (high - low + 1 >= LEAST)
    # the runs of the first STRONG lengths agree, so a long stretch is the same
    strong = ((a[0] ^ b[0]) >> (6 * (len(RUNS) - STRONG))) == 0
    return [c[ok] for c in (a[1], b[1], shift, low, high, a[5] + SURE * strong)]


def record(columns, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), pa.int64()) if c is None else pa.array(np.asarray(c, np.int64)) for c in columns],
                                      [f.split()[0] for f in schema.split(", ")])


def scan(batches):
    """Windows of texts as WINDOW."""
    def out():
        key, runs, doc, low, node, high, hash_ = text_windows(docs, texts)
        return record([key, runs, doc, (low << 32) | high, (node << 8) | hash_], WINDOW)

    docs, texts, size = [], [], 0
    for batch in batches:
        for doc, hashes in zip(batch.column(0).to_pylist(), word_hashes(batch.column(1).to_pylist())):
            values = chained(hashes, SHINGLE) if doc is not None else ()
            if len(values) >= LEAST:
                docs.append(doc)
                texts.append(values)
                size += len(values)
            if size >= AT_ONCE:
                yield out()
                docs, texts, size = [], [], 0
    if texts:
        yield out()


def group_links(batches):
    """LINK rows of windows sorted by (key, runs, doc_id, span): links, and the windows of groups of at least ``LOOK``. Of the
    group that a batch ends in, its first row, the first of the last runs and the last row are carried on, and the
    rows of a smaller one that may still grow."""
    carry, held, sent = None, None, 0
    for batch in batches:
        key, runs, doc, span, node = (batch.column(i).to_numpy() for i in range(5))
        if not len(key):
            continue
        new = [key, runs, doc, span >> 32, node >> 8, span & 0xFFFFFFFF, node & 255]
        columns = new if carry is None or carry[0][0] != key[0] else [np.concatenate([x, y]) for x, y in zip(carry, new)]
        links = linked(columns)
        if len(links[0]):
            yield record([*links, None], LINK)
        if held is None or held[0] != key[0]:
            held, sent = (key[0], [c[:0] for c in new]), 0
        rows = [np.concatenate([x, y]) for x, y in zip(held[1], new)]
        begin = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
        sizes = np.diff(np.r_[begin, len(rows[0])])
        counts = sizes + np.where(np.arange(len(sizes)) == 0, sent, 0)
        many = np.repeat(counts >= LOOK, sizes)
        if many.any():
            of, _, a, low, at, high, hash_ = (c[many] for c in rows)
            yield record([a, None, at, low, high, hash_, of], LINK)
        last = begin[-1] if counts[-1] < LOOK else len(rows[0])
        held, sent = (key[-1], [c[last:] for c in rows]), int(counts[-1]) if counts[-1] >= LOOK else 0
        key, runs = columns[:2]
        first = int(np.searchsorted(key, key[-1]))
        same = first + int(np.flatnonzero(runs[first:] == runs[-1])[0])
        carry = [c[sorted({first, same, len(key) - 1})] for c in columns]


def similar_runs(one: np.ndarray, two: np.ndarray, hits: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(start, end, start, end): the word ranges of two sequences of shingles that are one passage; ``hits`` marks those
    that the other has too.

    Ranges in which at least ``LOOSE`` of every stretch of ``WORDS`` words' shingles are also among the other's are a passage
    if their shingle sets resemble each other by ``SIMILAR``. Otherwise the parts of them are tried in which as many of
    every stretch are shared as two equal sets of this resemblance share, and then those that are shared throughout. Ends are
    trimmed to shared shingles.
    """
    out: list[tuple[int, int, int, int]] = []
    totals, order, before = [np.r_[0, np.cumsum(hit)] for hit in hits], None, None
    for share in (LOOSE, ENOUGH, 1):
        sides = [dense_runs(hit, share, total) for hit, total in zip(hits, totals)]
        if not sides[0] or not sides[1]:
            break  # nor has a larger share runs
        if sides != before:
            order = np.argsort(two, kind="stable") if order is None else order
            for start, end in sides[0]:
                if not any(s <= start and end <= e for s, e, _, _ in out):
                    out += paired_runs(one, two, order, [(start, end)], sides[1])
        before = sides
    return [(a, b + SHINGLE - 1, c, d + SHINGLE - 1) for a, b, c, d in out]


def shared_shingles(ones: list[np.ndarray], twos: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of sequences of 32-bit shingles, in one go: marks of those that the other has too, and where each pair's begin."""
    sides = []
    for parts in (ones, twos):
        sizes = np.array([len(p) for p in parts])
        owner = np.repeat(np.arange(len(parts), dtype=np.int64), sizes)
        sides.append(((owner << 32) | np.concatenate(parts).view(np.uint32).astype(np.int64), np.r_[0, np.cumsum(sizes)]))
    (x, x_at), (y, y_at) = sides
    both = np.concatenate([x, y])
    order = np.argsort(both)
    ranked = both[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    starts, of_y = np.flatnonzero(new), order >= len(x)
    met = np.logical_or.reduceat(of_y, starts) & np.logical_or.reduceat(~of_y, starts)
    hit = np.empty(len(both), bool)
    hit[order] = met[np.cumsum(new) - 1]
    return hit[:len(x)], x_at, hit[len(x):], y_at


def paired_runs(one: np.ndarray, two: np.ndarray, order: np.ndarray, runs: list[tuple[int, int]], others: list[tuple[int, int]]):
    """Runs of the one side with the run of the other that holds most of what they share, if they resemble each other enough;
    ``order`` sorts the other."""
    ranked, (starts, ends) = two[order], np.array(others).T
    for start, end in runs:
        # all places of the shared shingles in the other text, by the run that they lie in
        kinds = np.unique(one[start:end])
        first, last = np.searchsorted(ranked, kinds, "left"), np.searchsorted(ranked, kinds, "right")
        at = order[np.repeat(first - np.r_[0, np.cumsum(last - first)[:-1]], last - first) + np.arange(int((last - first).sum()))]
        run = np.minimum(np.searchsorted(ends, at, "right"), len(ends) - 1)
        k = int(np.bincount(run[(at >= starts[run]) & (at < ends[run])], minlength=len(ends)).argmax())
        a, b = set(kinds.tolist()), set(two[starts[k]:ends[k]].tolist())
        narrow = min(end - start, ends[k] - starts[k]) < LEAST * ENOUGH
        if not narrow and len(a & b) >= SIMILAR * len(a | b) - 1e-9:
            yield start, end, *others[k]


def dense_runs(hit: np.ndarray, share: float, total: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) ranges of shingles over which at least ``share`` of every stretch are hits, with their running
    ``total``."""
    if len(hit) < LEAST:
        return []
    good = np.flatnonzero(total[LEAST:] - total[:-LEAST] >= np.ceil(LEAST * share - 1e-9))
    out = []
    for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(good) else []:
        places = np.flatnonzero(hit[run[0]:run[-1] + LEAST]) + run[0]
        if out and places[0] < out[-1][1]:
            out[-1] = (out[-1][0], int(places[-1]) + 1)
        else:
            out.append((int(places[0]), int(places[-1]) + 1))
    return out


def copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of the ids that have several texts, with the one that stands; and (doc_id, first_id, words):
    documents whose text another one has too, with the smallest id that has it. Texts are compared by 128-bit digests."""
    def make(batches):
        import hashlib

        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([hashlib.md5((t or "").encode("utf-8", "replace")).digest() for t in texts], pa.binary()),
                 pa.array(word_counts(texts), pa.int64())], ["doc_id", "digest", "words"])
    digests = stored(map_texts(docs, ["doc_id", "text"], make, "doc_id long, digest binary, words long"))
    chosen = stored(digests.groupBy("doc_id").agg(F.min(F.struct("digest", "words")).alias("d"), F.count_distinct("digest").alias("n"))
                    .select("doc_id", "d.digest", "d.words", "n"))
    groups = chosen.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return chosen.where("n > 1").select("doc_id", "digest"), stored(chosen.join(groups, "digest").select("doc_id", "first_id", "words"))


def grouped(docs: DataFrame) -> DataFrame:
    """The links of neighbours in groups and the windows of larger groups, as LINK."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(map_texts(docs, ["doc_id", "text"], scan, WINDOW).repartition(n, "key").sortWithinPartitions("key", "runs", "doc_id", "span")
                  .mapInArrow(group_links, LINK))


def lanes(links: DataFrame) -> DataFrame:
    """(a, b, low, high, hashes, least, most) of links (a, b, shift, low, high, hashes) of different texts, on neighbouring diagonals."""
    # Where the larger id comes first, the interval is told in the other text.
    turned = (links.where("a <> b").withColumn("turn", F.expr("a > b"))
              .selectExpr("IF(turn, b, a) AS a", "IF(turn, a, b) AS b", "IF(turn, -shift, shift) AS shift",
                          "IF(turn, low - shift, low) AS low", "IF(turn, high - shift, high) AS high", "hashes"))
    # Diagonals of a pair that lie within SLIP of each other are one: a word more or less moves the rest.
    order = Window.partitionBy("a", "b").orderBy("shift")
    return (turned.withColumn("opens", F.coalesce(F.col("shift") - F.lag("shift").over(order) > SLIP, F.lit(False)).cast("int"))
            .withColumn("lane", F.sum("opens").over(order))
            .groupBy("a", "b", "lane").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("hashes").alias("hashes"),
                                           F.min("shift").alias("least"), F.max("shift").alias("most")).drop("lane"))


def candidates(rows: DataFrame) -> DataFrame:
    """(a, b, low, high, least, most): pairs of texts that enough hash functions link on neighbouring
    diagonals ``least`` to ``most`` (a place in ``a`` minus its place in ``b``)."""
    links = (rows.where("b is not null").groupBy("a", "b", "shift")
             .agg(F.min("low").alias("low"), F.max("high").alias("high"),
                  F.bit_or(F.expr(f"shiftleft(1L, CAST(IF(hash >= {SURE}, hash - {SURE}, hash) AS INT)) | IF(hash >= {SURE}, {1 << 32}L, 0L)"))
                  .alias("hashes")))
    return lanes(links).where((F.bit_count("hashes") >= AGREE) | (F.col("hashes") >= 1 << 32)).drop("hashes")


def marked(shingles: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, start, marks): for the shingles of a group's windows, put together from ``start`` on, their row in ``marks``, which
    tells the windows that hold each; row 0, of no window, is that of shingles that occur once."""
    sizes = np.array([len(s) for s in shingles])
    owner, start = np.repeat(np.arange(len(sizes)), sizes), np.r_[0, np.cumsum(sizes)]
    _, column, times = np.unique(np.concatenate([np.asarray(s, np.int32) for s in shingles]), return_inverse=True, return_counts=True)
    place = np.where(times > 1, np.cumsum(times > 1), 0)[column]
    marks = np.zeros((int((times > 1).sum()) + 1, len(sizes)), bool)
    marks[place, owner] = True
    marks[0] = False
    return place, start, marks


def around(node: np.ndarray, component: np.ndarray, shingles: list[list[int]], marking=None, repeats=False) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of a group's windows, of different components, that may be one passage around the node: of some stretch
    of ``LEAST`` shingles around the one's ``NEEDED`` are among the other's, and all of these reach as far as a passage. Of a class that shares such
    a stretch as a whole with a window, one window is enough; windows marked by ``repeats`` are not taken for it."""
    place, start, marks = marking or marked(shingles)
    one, other, plain = [], [], ~(np.zeros(len(node), bool) | repeats)
    shared = np.r_[0, np.cumsum(place > 0)][start]
    for i in np.flatnonzero(np.diff(shared) >= NEEDED).tolist():
        mine, size = marks[place[start[i]:start[i + 1]]], int(start[i + 1] - start[i])
        near = np.flatnonzero((mine.sum(0, dtype=np.int16) >= NEEDED) & (component != component[i]))
        if not len(near):
            continue
        hits = mine[:, near]
        total = np.concatenate([np.zeros((1, len(near)), np.int16), hits.cumsum(0, dtype=np.int16)])
        reach = size - hits.argmax(0) - hits[::-1].argmax(0)
        most = (total[LEAST:] - total[:-LEAST]).max(0)
        kept = (most >= NEEDED) & (reach >= LEAST * ENOUGH)
        near, whole = near[kept], near[kept & (most == LEAST) & plain[near] & plain[i]]
        if len(whole):
            # a stretch that is shared as a whole is a passage, so one such window connects the class
            near = np.r_[near[~np.isin(component[near], component[whole])], whole[np.unique(component[whole], return_index=True)[1]]]
        one.append(np.full(len(near), i))
        other.append(near)
    pairs = np.concatenate([np.zeros((2, 0), np.int64), *(np.stack([np.minimum(x, y), np.maximum(x, y)]) for x, y in zip(one, other))], 1)
    return tuple(np.unique(pairs, axis=1))


def run_at(hits: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(width, shared, parted) for rows of hits around a node: how wide the one run of ``dense_runs`` is and how many hits it
    has, zero where there is none; and whether there may be several."""
    total = np.concatenate([np.zeros((len(hits), 1), np.int16), hits.cumsum(1, dtype=np.int16)], 1)
    good = total[:, LEAST:] - total[:, :-LEAST] >= np.ceil(LEAST * share - 1e-9)
    first, last = good.argmax(1), good.shape[1] - 1 - good[:, ::-1].argmax(1)
    at = np.arange(hits.shape[1])
    inside = hits & (at >= first[:, None]) & (at < (last + LEAST)[:, None]) & good.any(1)[:, None]
    shared = inside.sum(1)
    width = np.where(shared > 0, hits.shape[1] - inside[:, ::-1].argmax(1) - inside.argmax(1), 0)
    return width, shared, good.sum(1) < last - first + 1


def may_hold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs ``similar_runs`` may find a passage in, given rows of hits of windows without repeated shingles: the shared ones
    of both runs are at most the fewer hits of the two."""
    out = np.zeros(len(x), bool)
    for share in (LOOSE, ENOUGH, 1):
        (x_width, x_shared, x_parted), (y_width, y_shared, y_parted) = run_at(x, share), run_at(y, share)
        both = np.minimum(x_shared, y_shared)
        out |= (both > 0) & (x_parted | y_parted | (np.minimum(x_width, y_width) >= LEAST * ENOUGH)
                             & (both >= SIMILAR * (x_width + y_width - both) - 1e-9))
    return out


def joining(node: np.ndarray, component: np.ndarray, shingles: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of a group's windows that join its classes: of the pairs that may be one passage (``around``) those whose
    surroundings hold one, from the most shared shingles down, each if its windows are not joined yet. So all windows that share a passage
    around the node end in one class, and the pairs are fewer than the windows. Of windows of one class and surroundings the first counts."""
    marking = place, start, marks = marked(shingles)
    if (np.diff(np.r_[0, np.cumsum(place > 0)][start]) >= NEEDED).sum() < 2:
        return (np.zeros(0, np.int64),) * 2
    parts, first = [np.asarray(s, np.int32) for s in shingles], {}
    for i, alike in enumerate(zip(component.tolist(), node.tolist(), (p.tobytes() for p in parts))):
        first.setdefault(alike, i)
    if len(first) < len(parts):
        of = np.fromiter(first.values(), np.int64)
        one, other = joining(node[of], component[of], [parts[i] for i in of])
        return of[one], of[other]
    repeats = np.array([len(np.unique(p)) < len(p) for p in parts])
    one, other = around(node, component, parts, marking, repeats)
    if not len(one):
        return one, other
    sizes, width = np.diff(start), int(np.diff(start).max())
    places = np.zeros((len(parts), max(width, LEAST)), place.dtype)
    places[np.repeat(np.arange(len(parts)), sizes), np.arange(len(place)) - np.repeat(start[:-1], sizes)] = place
    shared, kept = np.zeros(len(one), np.int64), np.zeros(len(one), bool)
    for at in range(0, len(one), AT_A_TIME):
        i, k = one[at:at + AT_A_TIME], other[at:at + AT_A_TIME]
        x, y = marks[places[i], k[:, None]], marks[places[k], i[:, None]]
        shared[at:at + AT_A_TIME] = np.minimum(x.sum(1), y.sum(1))
        kept[at:at + AT_A_TIME] = repeats[i] | repeats[k] | may_hold(x, y)
    out, ranked = [], np.flatnonzero(kept & (shared >= NEEDED))
    ranked = ranked[np.argsort(-shared[ranked], kind="stable")]
    label = np.unique(component, return_inverse=True)[1]
    for at in range(0, len(ranked), AT_A_TIME):
        some = ranked[at:at + AT_A_TIME]
        for p in some[label[one[some]] != label[other[some]]].tolist():
            i, k = int(one[p]), int(other[p])
            if label[i] != label[k] and similar_runs(parts[i], parts[k], (marks[places[i, :sizes[i]], k], marks[places[k, :sizes[k]], i])):
                label[label == label[i]] = label[k]
                out.append(p)
    return one[out], other[out]


def few_shared(rows: DataFrame, sizes: DataFrame, chunk: int) -> DataFrame:
    """(row): those (key, row, shingles) of which fewer than ``NEEDED`` shingles are also in another row of the key. The shingles
    of a group are dealt by their value to as many shares as ``chunk`` goes into its rows (``sizes``: key, count), so a share has
    about as many shingles as ``chunk`` rows have, and a row is in few of them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches):
        for batch in batches:
            out = []
            for key, row, shares, shingles in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).to_numpy(zero_copy_only=False)):
                values = np.asarray(shingles, np.int32)
                share = mixed(values.view(np.uint32).astype(np.uint64)) % np.uint64(shares)
                order = np.argsort(share, kind="stable")
                cut = np.flatnonzero(np.r_[True, share[order][1:] != share[order][:-1]])
                out += [(key, int(share[at[0]]), row, values[at]) for at in np.split(order, cut[1:])]
            columns = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))],
                                             ["key", "part", "row", "shingles"])

    def count(batches):
        def done(held):
            tables = pa.Table.from_batches(held)
            row, lists = tables.column("row").to_numpy(), tables.column("shingles").combine_chunks()
            owner = np.repeat(np.arange(len(row)), np.diff(lists.offsets.to_numpy()))
            values, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            least, most = np.full(len(values), len(row)), np.full(len(values), -1)
            np.minimum.at(least, column, owner)
            np.maximum.at(most, column, owner)
            shared = np.bincount(owner, weights=(least < most)[column], minlength=len(row)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(shared)], ["row", "n"])

        now, held = None, []
        for batch in batches:
            key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1, len(key)] if len(key) else ()
            for i, j in zip(cut[:-1], cut[1:]):
                if held and now != (key[i], part[i]):
                    yield done(held)
                    held = []
                now = key[i], part[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield done(held)

    dealt = map_texts(rows.join(sizes, "key").withColumn("shares", F.ceil(F.col("count") / F.lit(chunk))), ["key", "row", "shares", "shingles"], deal,
                      "key long, part long, row long, shingles array<int>")
    counts = dealt.repartition(parts, "key", "part").sortWithinPartitions("key", "part").mapInArrow(count, "row long, n long")
    return counts.groupBy("row").agg(F.sum("n").alias("n")).where(F.col("n") < NEEDED).select("row")


def open_pairs(docs: DataFrame, rows: DataFrame, spans: DataFrame, chunk: int) -> DataFrame:
    """Candidate pairs of the groups whose windows lie in several classes: all pairs of windows in different ones that may be a
    passage around the node, as far as they join classes. One window of each class and surroundings stands for the rest. In a group of more than
    ``chunk`` windows those are left out first of whose surroundings too little occurs anywhere else in the group; what stays is cut
    into shares, and each pair of shares is compared by itself."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    windows_ = rows.where("b is null").selectExpr("key", "a AS doc", "shift AS node", "low", "high").distinct()
    inside = spans.selectExpr("doc", "start_word", "end_word", "component AS of")
    windows_ = (windows_.join(inside, (windows_.doc == inside.doc) & F.col("node").between(F.col("start_word"), F.col("end_word") - SHINGLE), "left")
                .select("key", windows_.doc, "node", "low", "high", F.xxhash64(F.coalesce("of", node("node", windows_.doc))).alias("component")))
    several = (windows_.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("windows"))
               .where("least < most").select("key", (F.col("windows") > chunk).alias("large")))
    windows_ = stored(windows_.join(several, "key").withColumn("row", F.monotonically_increasing_id()))
    begin = F.greatest(F.col("low"), F.col("node") - (LEAST - 1))
    wanted = windows_.select("key", "row", "component", "large", (F.col("node") - begin).alias("n"), F.col("doc").alias("doc_id"), begin.alias("at"),
                             (F.least(F.col("high"), F.col("node") + (LEAST - 1)) + 1).alias("upto"))
    # One window of each class and surroundings stands for the rest: in a small group its task finds it.
    each = stored(stretches(docs, wanted, "key long, row long, component long, large boolean, n long"))
    ours = stored(each.where("large").groupBy("key", "component", "n", "shingles").agg(F.min("row").alias("row")))
    few = few_shared(ours.select("key", "row", "shingles"), ours.groupBy("key").count().where(F.col("count") > chunk), chunk)
    ours = stored(ours.join(few, "row", "left_anti").select(ours.columns))
    columns = ["key", "part", "row", "component", "n", "shingles"]
    dealt = (in_open_groups(ours.select("key", "row", "component"), chunk).join(ours.select("row", "n", "shingles"), "row").select(columns)
             .unionByName(each.where("not large").withColumn("part", F.lit(0)).select(columns))
             .repartition(parts, "key", "part").sortWithinPartitions("key", "part", "row"))
    pairs = stored(dealt.mapInArrow(lambda batches: by_part(batches, "shingles", joining, ["x", "y"]), "x long, y long").distinct())
    x, y = (windows_.select(F.col("row").alias(side), F.struct("doc", "node", "low", "high").alias(side + "_")) for side in "xy")
    shift = "x_.node - y_.node"
    links = (pairs.join(x, "x").join(y, "y")
             .selectExpr("x_.doc AS a", "y_.doc AS b", f"{shift} AS shift", f"greatest(x_.low, y_.low + {shift}) AS low",
                         f"least(x_.high, y_.high + {shift}) AS high", "0L AS hashes").where(f"high - low + 1 >= {LEAST}"))
    return lanes(links).select("a", "b", "low", "high", (F.col("least") - SLIP).alias("least"), (F.col("most") + SLIP).alias("most"))


def stretches(docs: DataFrame, wanted: DataFrame, names: str) -> DataFrame:
    """(names, shingles) of stretches (names, doc_id, at, upto) of texts; ``names`` has columns and types. Their places
    grow with the texts and are never broadcast, so that the plan is the same at every size."""
    fields = [tuple(name.split()) for name in names.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    # A text goes to its stretches once, or once for about CUTS of them.
    shares = wanted.groupBy("doc_id").agg(F.ceil(F.count("*") / F.lit(CUTS)).alias("shares"))
    lists = (wanted.join(shares, "doc_id").groupBy("doc_id", F.pmod(F.xxhash64(fields[0][0], "at"), "shares").alias("share"))
             .agg(F.collect_list(F.struct(*(name for name, _ in fields), "at", "upto")).alias("cuts")))

    def cut(batches):
        for batch in batches:
            lists = batch.column(1)
            cuts, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            columns = dict(zip((f.name for f in cuts.type), cuts.flatten()))
            at, upto = (columns[c].to_numpy() for c in ("at", "upto"))
            parts, size = [], []
            for hashes, i, j in zip(word_hashes(batch.column(0).to_pylist()), [0, *ends.tolist()], ends.tolist()):
                shingles = chained(hashes, SHINGLE).astype(np.uint32).view(np.int32)
                parts += [shingles[x:y] for x, y in zip(at[i:j].tolist(), upto[i:j].tolist())]
            offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*(columns[name].cast(kinds[kind]) for name, kind in fields), pa.ListArray.from_arrays(offsets, flat)],
                                             [*(name for name, _ in fields), "shingles"])

    return map_texts(docs.join(lists.hint("merge"), "doc_id"), ["text", "cuts"], cut, f"{names}, shingles array<int>")


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, start, end, other, upto): the passages of candidate pairs that hold when their shingles are compared, as
    word ranges of both."""
    numbered = stored(pairs.withColumn("pair", F.monotonically_increasing_id()))
    wanted = numbered.select("pair", F.explode(F.array(
        F.struct(F.col("a").alias("doc_id"), F.lit(0).alias("side"), F.col("low").alias("at"), (F.col("high") + 1).alias("upto")),
        F.struct(F.col("b").alias("doc_id"), F.lit(1).alias("side"), F.greatest(F.col("low") - F.col("most"), F.lit(0)).alias("at"),
                 (F.col("high") - F.col("least") + 1).alias("upto")))).alias("w")).select("pair", "w.*")

    def compare(batches):
        for batch in batches:
            sides = [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)]
            kept = [i for i, (x, y) in enumerate(zip(*sides)) if x is not None and y is not None and min(len(x), len(y)) >= LEAST * ENOUGH]
            rows = []
            if kept:
                ones, twos = ([side[i] for i in kept] for side in sides)
                x_hit, x_at, y_hit, y_at = shared_shingles(ones, twos)
                often = [np.add.reduceat(hit, at[:-1], dtype=np.int64) >= LEAST * ENOUGH for hit, at in ((x_hit, x_at), (y_hit, y_at))]
                for k in np.flatnonzero(often[0] & often[1]):
                    hits = x_hit[x_at[k]:x_at[k + 1]], y_hit[y_at[k]:y_at[k + 1]]
                    rows += [(kept[k], *run) for run in similar_runs(ones[k], twos[k], hits)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at)] + [pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 5)],
                                             ["pair", "start", "end", "other", "upto"])

    both = stretches(docs, wanted, "pair long, side int").groupBy("pair").agg(*(F.first(F.when(F.col("side") == i, F.col("shingles")), ignorenulls=True).alias(n) for i, n in enumerate("xy")))
    runs = map_texts(both, ["pair", "x", "y"], compare, "pair long, start long, end long, other long, upto long")
    moved = lambda name, by: (F.col(name) + by).alias(name)
    at = F.greatest(F.col("low") - F.col("most"), F.lit(0))
    return runs.join(numbered, "pair").select("a", "b", moved("start", F.col("low")), moved("end", F.col("low")), moved("other", at), moved("upto", at))


def node(doc, start):
    return F.concat_ws(":", doc, start)


def classes(found: DataFrame, same: DataFrame) -> DataFrame:
    """(doc, start_word, end_word, component): the spans that passages make, with the class that links connect."""
    ends = (found.select(F.col("a").alias("doc"), "start", "end")
            .unionByName(found.select(F.col("b").alias("doc"), F.col("other").alias("start"), F.col("upto").alias("end"))))
    whole = (same.where((F.col("doc_id") == F.col("first_id")) & (F.col("words") >= WORDS))
             .select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("start"), F.col("words").alias("end")))
    pieces_ = stored(ends.unionByName(whole).distinct()
                     .withColumn("before", F.max("end").over(Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)))
                     .withColumn("opens", F.when(F.col("before").isNull() | (F.col("start") >= F.col("before")), F.col("start")))
                     .withColumn("span", F.max("opens").over(Window.partitionBy("doc").orderBy("start", "end")))
                     .select("doc", "start", "end", "span"))
    place = pieces_.select("doc", "start", "end", node("doc", "span").alias("node"))
    edges = (found.join(place.selectExpr("doc AS a", "start", "end", "node AS u"), ["a", "start", "end"])
             .join(place.selectExpr("doc AS b", "start AS other", "end AS upto", "node AS v"), ["b", "other", "upto"])
             .select(F.col("u").alias("a"), F.col("v").alias("b")).distinct())
    return stored(pieces_.groupBy("doc", F.col("span").alias("start_word")).agg(F.max("end").alias("end_word"))
                  .withColumn("node", node("doc", "start_word")).join(components(stored(edges)), "node", "left")
                  .select("doc", "start_word", "end_word", F.coalesce("component", "node").alias("component")))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1_000) -> DataFrame:
    """(doc_id, start_word, end_word, class_doc_id, class_start, n_linked): every passage that
    another document has too, as a span of words (end not included); the class of spans that
    links connect, named by one span of it; and the number of other texts that links connect it to, directly
    or through others. Documents of equal text have the same rows."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    several, same = copies(docs)
    if several.take(1):
        stands = F.col("digest").isNull() | (F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))) == F.col("digest"))
        docs = docs.join(several, "doc_id", "left").where(stands).select("doc_id", "text")
    # Of equal texts the one with the smallest id is compared.
    docs = docs.join(same.where("doc_id <> first_id").select("doc_id"), "doc_id", "left_anti")
    rows = grouped(docs)
    found = stored(verified(docs, candidates(rows)))
    spans = classes(found, same)
    more = stored(verified(docs, open_pairs(docs, rows, spans, chunk)))
    if more.take(1):
        spans = classes(found.unionByName(more), same)
    texts = spans.groupBy("component").agg((F.count_distinct("doc") - 1).alias("n_linked"))
    spans = (spans.join(texts, "component")
             .select("doc", "start_word", "end_word", F.split("component", ":")[0].cast("long").alias("class_doc_id"),
                     F.split("component", ":")[1].cast("long").alias("class_start"), "n_linked"))
    others = same.where("doc_id <> first_id").select(F.col("first_id").alias("doc"), "doc_id").distinct()
    own = spans.withColumnRenamed("doc", "doc_id")
    return own.unionByName(spans.join(others, "doc").select(own.columns))
