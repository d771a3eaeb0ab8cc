"""Similarity join on word shingles by PartEnum signatures, and the groups that its links form.

Two sets with Jaccard similarity of at least t differ in at most k = (|a| + |b|)(1 - t)/(1 + t) elements. Sets fall into
bands of sizes between powers of two; a set signs its own band, and the next one if a similar set may lie there. A band
deals the domain into n1 groups of n2 sub-partitions, and a set has a signature for each subset of n2 - 1 of a group: its
elements in these. From 85 % on n2 is 3, and k differences change 2k signatures at most (n1 + k, where k > n1); below, where
many differences call for many groups, n2 is 2, and they change k. Similar sets share all others. A band has more groups
than that needs, so a set may leave out as many signatures, less one, as it must share with any similar set, in any order
that all sets have in common: most of them, those of the fewest elements, before anything is shuffled; the rest (one of
RESERVE), the most frequent of the corpus, once they are counted. Passages that many texts share therefore make few
candidates. Signatures of no elements are never used: a set with too few others signs single sub-partitions as well, twice
as many at each further step, until k + 1 of them hold elements; two similar sets that share none but empty signatures at
one step both come to the next.

Equal sets form a class with one representative. Buckets of at most SMALL representatives that share a signature are
compared pair by pair; pairs whose numbers of elements in SKETCH parts of the domain differ in more than k together cannot
be similar and are passed over. In larger buckets all are compared with one set, the hub: of those in the bucket, and in other
large buckets of its members, that which has most of its signatures in large buckets, as the text that many near copies
come from has. So the buckets of many near copies have one hub, and each copy is compared once. Sets near the hub are linked through it.

The sets that were compared with a hub, some of them far from it, are its group; copies that each have edits of their own
stay far from all others, however many they are. A group of at most BLOCKS blocks is dealt to tasks by pairs of blocks, in
order of size. A task passes over pairs whose PARITY bits, whether each part of the domain holds an odd number of elements,
differ in more than k: a few nanoseconds a bit word, and no row. It compares the others exactly unless links that it has found
join them already, so it returns fewer links than it has sets, however many are similar.

In larger groups a link of a set that is far from the hub shows in the differences from the hub: two similar sets, one of
which has d > k differences, share d - k of them at least, so they meet on the k + 1 rarest differences. These meetings are
the buckets of the next round, each with the member that most buckets of the old hub have as the new one, so that buckets
with common members share it; a set leaves a bucket if the rarest difference that it could share with any other there comes
too late for enough more to follow. No candidate that could link is dropped, whatever the size of a bucket or a group.

Null texts and texts without words have empty sets and link with nothing. Long texts are read whole. Extra columns are not
read, whatever their names. Rows of one doc_id count as one document; rows without doc_id get the component of a document
with an equal set, or null. Repeated rows get equal results each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut_lineage, freed_shuffles, lookup, map_rows, slices, written

#: Members of a bucket that are compared pair by pair; larger buckets go by a hub.
SMALL = 16
#: Parts of the domain whose elements are counted, to pass over pairs; counts end at 255.
SKETCH = 128
#: Bits that tell whether the number of elements in a part is odd, to pass over pairs of a group.
PARITY = 2048
#: Most weight of a block (a set weighs MEMBER and its elements), and most blocks of a group that is compared by blocks.
BLOCK, MEMBER, BLOCKS = 1 << 18, 100, 64
#: Bits of the map by which texts of no pair are passed over before any of the others is moved: 1 MB, whatever the input.
MAP_BITS = 1 << 23
#: Of the signatures that a set may leave out, one in so many is chosen by its frequency.
RESERVE = 4
#: Similarity in percent from which subsets of two of three sub-partitions are signed; below it, of one of two.
DENSE = 85
#: Words whose hashes a task keeps.
CACHE = 150_000

#: Signatures of a band and step (place); ``spare`` of them, the most frequent, are left out.
SIGNATURES = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("spare", T.IntegerType()), T.StructField("signatures", T.ArrayType(T.LongType()))])
SIGNED = T.StructType([
    T.StructField("n_shingles", T.LongType()),
    T.StructField("key_a", T.LongType()),
    T.StructField("key_b", T.LongType()),
    T.StructField("sketch", T.BinaryType()),
    T.StructField("signed", T.ArrayType(SIGNATURES)),
])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles of ``n`` words; of the whole sequence if it has fewer."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def hashes(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # of bytes: A-Z, and the six ASCII spaces
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh3_64_intdigest(word)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.n, len(ids))
        if not width:
            return ids
        rows = len(ids) - width + 1
        joined = np.full(rows, width, np.uint64)
        for i in range(width):
            joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + rows])
        return np.unique(joined)


def most_apart(sizes: int, percent: int) -> int:
    """Most differences of two similar sets of so many elements together."""
    return sizes * (100 - percent) // (100 + percent)


@lru_cache(256)
def groups_of(band: int, percent: int) -> int:
    """Groups of sub-partitions of a band: more than half of its most differences needs, by an eighth or a half."""
    least = most_apart(2 * ((2 << band) - 1), percent) // 2 + 1
    return least * 9 // 8 if percent >= DENSE else least * 3 // 2


def contents(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of elements in each partition of the domain, and their sum; hashes are mixed, sums wrap."""
    part = (hashes >> np.uint64(20)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[order])])
    return np.diff(edges), sums[edges[1:]] - sums[edges[:-1]]


def subsets(values: np.ndarray, percent: int) -> np.ndarray:
    """Sums over the subsets of each group's sub-partitions that lack one."""
    if percent < DENSE:
        return values
    three = values.reshape(-1, 3)
    return (three[:, [0, 0, 1]] + three[:, [1, 2, 2]]).ravel()


def chosen(held: np.ndarray, sums: np.ndarray, needed: int, place: int) -> tuple[int, int, np.ndarray]:
    """Place, number of signatures to leave out by frequency, and signatures: those of most elements, none of them empty."""
    at = np.flatnonzero(held)
    names = mix(sums[at] ^ mix(at.astype(np.uint64) + np.uint64(place << 40)))
    spare = max(0, len(at) - needed)
    later = spare // RESERVE
    first = np.lexsort((names, -held[at]))[: len(at) - (spare - later)]
    return place, later, names[first]


def sign(hashes: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """What ``chosen`` gives for a set, for each band and step."""
    size, made = len(hashes), []
    parts = 3 if percent >= DENSE else 2
    band, largest = size.bit_length() - 1, size * 100 // percent
    while 1 << band <= largest:
        apart = most_apart(size + min(largest, (2 << band) - 1), percent)
        groups, step = groups_of(band, percent), 0
        if apart:  # else equal sets alone are similar: one class already
            held, sums = (subsets(x, percent) for x in contents(hashes, parts * groups))
            needed = (min(2 * apart, groups + apart) if parts == 3 else apart) + 1
            made.append(chosen(held, sums, needed, band << 5))
            while np.count_nonzero(held) < needed:
                needed, step = apart + 1, step + 1
                held, sums = contents(hashes, parts * groups << step)
                made.append(chosen(held, sums, needed, band << 5 | step))
        band += 1
    return made


def sign_one(shingler: Shingler, percent: int, text: str | None) -> tuple:
    hashes = shingler.hashes(text)
    if not len(hashes):
        return 0, None, None, None, None
    sketch = np.minimum(np.bincount((hashes % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()
    keys = np.array([hashes.sum(), mix(hashes).sum()], np.uint64).view(np.int64)
    return len(hashes), int(keys[0]), int(keys[1]), sketch, [{"place": p, "spare": n, "signatures": x.view(np.int64)} for p, n, x in sign(hashes, percent)]


def signed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, size and key of each text's set, and its signatures."""

    def start():
        return partial(sign_one, Shingler(n), percent)

    return map_rows(docs.select("doc_id", "text"), "text", SIGNED, start).drop("text").withColumn("row", F.monotonically_increasing_id())


def id_map(pairs: DataFrame) -> np.ndarray:
    """MAP_BITS bits, those set that the ids of the pairs fall on; MAP_BITS / 64 rows come to the driver at most."""
    ids = pairs.select(F.explode(F.array("u", "hub")).alias("id")).select(F.pmod("id", F.lit(MAP_BITS)).alias("slot"))
    words = ids.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    found = np.zeros(MAP_BITS // 64, np.int64)
    found[words.column("word").to_numpy().astype(np.int64)] = words.column("bits").to_numpy()
    return found


def packed_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id and compressed text of the documents that the pairs name: less to move than the set, which tasks derive from it."""
    shared = docs.sparkSession.sparkContext.broadcast(id_map(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, words = zstandard.ZstdCompressor(level=1).compress, shared.value
        for batch in slices(batches, "text"):
            slot = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False) % MAP_BITS
            wanted = batch.filter(pa.array((words[slot >> 6] >> (slot & 63) & 1) == 1))
            packed = [compress((text or "").encode()) for text in wanted.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([wanted.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    return of_pairs(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, packed binary"), pairs)


def within_reach(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (u, hub, large) that are of a large bucket or may be similar by their sizes and sketches."""
    for batch in batches:
        if batch.num_rows:
            parts = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for c in ("sketch_u", "sketch_hub")]
            sizes = batch.column("size_u").to_numpy() + batch.column("size_hub").to_numpy()
            near = np.abs(parts[0] - parts[1]).sum(axis=1) <= sizes * (100 - percent) // (100 + percent)
            near &= np.abs(batch.column("size_u").to_numpy() - batch.column("size_hub").to_numpy()) <= sizes * (100 - percent) // (100 + percent)
            kept = batch.filter(pa.array(near | batch.column("large").to_numpy(zero_copy_only=False)))
            yield kept.select(["u", "hub", "large"])


def reachable(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    side = lambda name: whole.select(F.col("doc_id").alias(name), F.col("n_shingles").alias(f"size_{name}"), F.col("sketch").alias(f"sketch_{name}"))
    both = pairs.join(side("u"), "u").join(side("hub"), "hub")
    return both.mapInArrow(partial(within_reach, percent), "u long, hub long, large boolean")


COMPARED = "u long, hub long, large boolean, linked boolean, size long, apart long, spread long, differences array<long>"


def compare(n: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pairs with both texts: whether they link, in how many elements they differ, k for the two sizes, and (large) where."""
    shingler, unpack = Shingler(n), zstandard.ZstdDecompressor().decompress
    hub_id, hub_set = None, None
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            rows = []
            for u, hub, large, a, b in zip(*(batch.column(c).to_pylist() for c in ("u", "hub", "large", "text_u", "text_hub")), strict=True):
                if hub != hub_id:  # pairs of one hub come together
                    hub_id, hub_set = hub, shingler.hashes(unpack(b).decode())
                own = shingler.hashes(unpack(a).decode())
                apart = np.setxor1d(own, hub_set, assume_unique=True)
                common = (len(own) + len(hub_set) - len(apart)) // 2
                linked = 100 * common >= percent * (common + len(apart))
                # The largest k that a pair with u can have: its partner has size |u| * 100 / percent at most.
                spread = most_apart(len(own) + len(own) * 100 // percent, percent)
                rows.append((u, hub, large, linked, len(own), len(apart), spread, apart.view(np.int64) if large else None))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = ["u", "hub", "large", "linked", "size", "apart", "spread", "differences"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def open_groups(done: DataFrame) -> DataFrame:
    """hub, its ``weight``: the hubs of large buckets with several sets, one of them far, so that links among these are open."""
    by_hub = done.filter("large").groupBy("hub").agg(F.count("*").alias("m"), F.count_if("far").alias("far"), F.sum(F.col("size") + MEMBER).alias("weight"))
    return by_hub.filter("m > 1 and far > 0").select("hub", "weight")


def with_parity(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed texts with the PARITY bits of their sets."""
    shingler, unpack = Shingler(n), zstandard.ZstdDecompressor().decompress
    for batch in batches:
        made = []
        for packed in batch.column("packed").to_pylist():
            part = (shingler.hashes(unpack(packed).decode()) >> np.uint64(40)) % np.uint64(PARITY)
            made.append(np.packbits(np.bincount(part.astype(np.int64), minlength=PARITY) & 1).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("packed"), pa.array(made, pa.binary())], names=["u", "packed", "parity"])


def link_blocks(n: int, percent: int, sets: pa.Table) -> pa.Table:
    """Links (u, v) of sets in two blocks i <= j of a group that, with those of near sets to the hub, connect whatever is similar."""
    sets = sets.sort_by([("block", "ascending"), ("size", "ascending"), ("u", "ascending")])
    shingler, unpack = Shingler(n), zstandard.ZstdDecompressor().decompress
    block, size, ids = (sets.column(c).to_numpy() for c in ("block", "size", "u"))
    texts, known, links = sets.column("packed"), {}, []
    bits = np.frombuffer(b"".join(sets.column("parity").to_pylist()), np.uint64).reshape(len(ids), -1).T.copy()
    # The number of each set's component so far; near sets are linked through the hub.
    joined = np.where(sets.column("far").to_numpy(), np.arange(len(ids)), -1)

    def elements(at: int) -> np.ndarray:
        if at not in known:  # a block's sets hold BLOCK elements at most, or are one
            known[at] = shingler.hashes(unpack(texts[at].as_py()).decode())
        return known[at]

    one = block[0] == block[-1]
    first = 0 if one else int(np.searchsorted(block, block[-1]))
    for at in range(len(ids) if one else first):
        start, end = at + 1 if one else first, int(np.searchsorted(size[first:], size[at] * 100 // percent, "right")) + first
        if start >= end:
            continue
        unlike = np.bitwise_count(bits[:, start:end] ^ bits[:, at, None]).sum(axis=0, dtype=np.int64)
        may = (unlike <= (size[start:end] + size[at]) * (100 - percent) // (100 + percent)) & (joined[start:end] != joined[at])
        for other in (np.flatnonzero(may) + start).tolist():
            if joined[other] != joined[at]:
                apart = len(np.setxor1d(elements(at), elements(other), assume_unique=True))
                common = int(size[at] + size[other] - apart) // 2
                if 100 * common >= percent * (common + apart):
                    links.append((ids[at], ids[other]))
                    joined[joined == joined[other]] = joined[at]
    return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([x for _, x in links], pa.int64())})


def links_by_blocks(groups: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (u, v) among the sets of each group (hub, u, far, size), each pair of its blocks a group of Spark's."""
    before = F.sum(F.col("size") + MEMBER).over(Window.partitionBy("hub").orderBy("size", "u"))
    members = written(groups.select("hub", "u", "far", "size", F.floor(before / BLOCK).cast("int").alias("block")))
    blocks = members.groupBy("hub", "block").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    first, last = (blocks.select("hub", F.col("block").alias(k), F.col(c).alias(c)) for k, c in (("i", "most"), ("j", "least")))
    meet = first.join(last, "hub").filter(f"i <= j and least * {percent} <= most * 100")
    dealt = members.join(meet.select("hub", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")), ["hub", "block"])
    own = texts.join(members.select(F.col("u").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "packed")
    whole = dealt.join(own.mapInArrow(partial(with_parity, n), "u long, packed binary, parity binary"), "u")
    return whole.groupBy("hub", "i", "j").applyInArrow(lambda sets: link_blocks(n, percent, sets), "u long, v long")


def meetings(compared: DataFrame, percent: int) -> DataFrame:
    """Members of the buckets (hub, element): the rarest differences from the hub of each set, where it may link.

    ``room``: how many of its differences come after the element.
    """
    open_hubs = compared.groupBy("hub").agg(F.count("*").alias("m"), F.count_if("far").alias("far")).filter("m > 1 and far > 0").select("hub")
    each = compared.join(open_hubs, "hub", "left_semi").select("hub", "u", "far", "size", "apart", "spread", F.explode("differences").alias("element"))
    shared = each.groupBy("hub", "element").agg(F.count("*").alias("n"), F.count_if("far").alias("n_far")).filter("n > 1 and n_far > 0").select("hub", "element", "n")
    # Elements that no other set has, or only near ones, come first: they use up places but no pair meets there.
    per_set = "partition by hub, u"
    ranked = each.join(shared, ["hub", "element"]).withColumn("room", F.expr(f"count(*) over ({per_set}) - row_number() over ({per_set} order by n, element)"))
    # A far set shares apart - spread of its differences at least with any set that it links to; a near one shares more
    # than apart * percent / (100 + percent) with a far one. The rarest of the others need no meeting.
    own = F.expr(f"if(far, spread + 1, apart - apart * {percent} div {100 + percent})")
    placed = ranked.filter(F.col("apart") - F.col("room") <= own).drop("n")
    # A pair whose first common difference is this one shares 1 + the smaller room at most, and half of what its
    # differences exceed k at least.
    least = [F.min("apart").alias("d"), F.min(F.when(F.col("far"), F.col("apart"))).alias("d_far"), F.max("room").alias("r"), F.max(F.when(F.col("far"), F.col("room"))).alias("r_far"), F.count("*").alias("n")]
    bucket = placed.groupBy("hub", "element").agg(*least).filter("n > 1 and d_far is not null").drop("n")
    may = F.expr("if(far, apart + d - spread <= 2 + 2 * least(room, r), apart + d_far - spread <= 2 + 2 * least(room, r_far))")
    return placed.join(bucket, ["hub", "element"]).filter(may).select("hub", "element", "u", "far", "size", "apart", "room")


def next_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs to compare: of each small bucket all that may link, of a ``large`` one each member with that of most large buckets."""
    sized = buckets.groupBy("hub", "element").agg(F.count("*").alias("n"), F.max("far").alias("open")).filter("n > 1 and open").drop("open")
    members = buckets.join(sized, ["hub", "element"])
    small = members.filter(F.col("n") <= SMALL)
    other = small.select("hub", "element", *[F.col(c).alias(f"v_{c}") for c in ("u", "far", "size", "apart", "room")])
    enough = f"apart + v_apart - (size + v_size) * {100 - percent} div {100 + percent} <= 2 + 2 * least(room, v_room)"
    pairs = small.join(other, ["hub", "element"]).filter("u > v_u and (far or v_far)").filter(enough).select("u", F.col("v_u").alias("hub")).distinct()
    crowded = members.filter(F.col("n") > SMALL).select("hub", "element", "u", "apart")
    often = crowded.groupBy("hub", "u").agg(F.count("*").alias("often"))
    first = F.max(F.struct("often", -F.col("apart"), (-F.col("u")).alias("last"))).alias("first")
    firsts = crowded.join(often, ["hub", "u"]).groupBy("hub", "element").agg(first).select("hub", "element", (-F.col("first.last")).alias("first"))
    large = crowded.join(firsts, ["hub", "element"]).filter("u != first").select("u", F.col("first").alias("hub")).distinct()
    return both_kinds(pairs, large)


def both_kinds(small: DataFrame, large: DataFrame) -> DataFrame:
    """Pairs (u, hub) of small and of large buckets in one table."""
    return small.withColumn("large", F.lit(False)).unionByName(large.withColumn("large", F.lit(True)))


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for the nodes of ``links`` (u, v), by alternating stars.

    A star step links each node's neighbours with its smallest one; the number of links never grows.
    """
    step = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    before = None
    while True:
        # Large star: neighbours above a node go to its smallest neighbour or itself.
        both = step.unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: neighbours below a node, and the node, go to the smallest of them.
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        step = written(small.select("e.*").filter("u > v").distinct())
        state = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    return step.select(F.col("u").alias("node"), F.col("v").alias("component"))


def representatives(whole: DataFrame) -> DataFrame:
    """The rows of ``whole`` that stand for their class: of those with a doc_id the first, of equal rows one."""
    own = whole.filter("n_shingles > 0 and doc_id is not null").select("key_a", "key_b", "doc_id", "row")
    several = own.groupBy("key_a", "key_b").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = lookup(own, several.select("key_a", "key_b", "n", F.col("first.row").alias("first")), ["key_a", "key_b"], "inner")
    # Few rows are copies as a rule, so signatures need no shuffle to have one row for each class.
    return whole.filter("n_shingles > 0 and doc_id is not null").join(written(copies.filter("row != first").select("row")), "row", "left_anti")


def rare_signatures(classes: DataFrame) -> DataFrame:
    """u and signature: what two classes or more have, without the spare ones of each class (doc_id, signed)."""
    entries = classes.select(F.col("doc_id").alias("u"), F.inline("signed")).select("u", "place", "spare", F.explode("signatures").alias("signature"))
    counts = entries.groupBy("signature").agg(F.count("*").alias("n")).filter("n > 1")
    own = F.array_sort(F.collect_list(F.struct("n", "signature"))).alias("own")  # of one set
    shared = entries.join(counts, "signature").groupBy("u", "place", "spare").agg(own)
    kept = shared.filter(F.size("own") > F.col("spare")).select("u", F.explode(F.slice("own", F.lit(1), F.size("own") - F.col("spare"))).alias("e"))
    return kept.select("u", "e.signature")


def shared_signatures(whole: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, hub, large) of representatives with a common signature: all of small buckets, members and hub of large ones."""
    entries = cut_lineage(rare_signatures(representatives(whole)))
    sizes = entries.groupBy("signature").agg(F.count("*").alias("n")).filter("n > 1")
    members = entries.join(sizes, "signature")
    # Many signatures have the same members; such buckets become one before their pairs are listed.
    bucket = F.array_sort(F.collect_list("u")).alias("bucket")
    small = members.filter(F.col("n") <= SMALL).groupBy("signature").agg(bucket).select("bucket").distinct()
    each = small.select("bucket", F.posexplode("bucket").alias("at", "hub")).select("hub", F.explode(F.slice("bucket", F.col("at") + 2, F.lit(SMALL))).alias("u"))
    crowded = cut_lineage(members.filter(F.col("n") > SMALL).select("u", "signature"))
    often = crowded.groupBy("u").agg(F.count("*").alias("often"))
    best = F.max(F.struct("often", (-F.col("u")).alias("last"))).alias("best")
    own = crowded.join(often, "u").groupBy("signature").agg(best)
    beside = crowded.join(own, "signature").groupBy("u").agg(F.max("best").alias("best"))
    hubs = crowded.join(beside, "u").groupBy("signature").agg(F.max("best").alias("best")).select("signature", (-F.col("best.last")).alias("hub"))
    large = crowded.join(hubs, "signature").filter("u != hub").select("u", "hub").distinct()
    return written(reachable(both_kinds(each.filter("u != hub").select("u", "hub").distinct(), large), whole, percent))


def of_pairs(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``texts`` (with doc_id) that the pairs name."""
    return texts.join(pairs.select(F.explode(F.array("u", "hub")).alias("doc_id")).distinct(), "doc_id", "left_semi")


def compared(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    with_u = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("packed").alias("text_u")), "u")
    with_both = with_u.join(texts.select(F.col("doc_id").alias("hub"), F.col("packed").alias("text_hub")), "hub")
    return with_both.mapInArrow(partial(compare, n, percent), COMPARED).withColumn("far", ~F.col("linked"))


def links(docs: DataFrame, pairs: DataFrame, whole: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (u, v) between representatives that connect whatever is similar, from the pairs of ``shared_signatures``."""
    texts, sketches, found = cut_lineage(packed_texts(docs, pairs)), None, []
    while True:
        done = written(compared(pairs, texts, n, percent))
        found.append(done.filter("linked").select("u", F.col("hub").alias("v")))
        if pairs.filter("large").isEmpty():
            break
        hubs = written(open_groups(done))
        fitting = F.col("weight") < BLOCK * BLOCKS
        found.append(written(links_by_blocks(done.filter("large").join(hubs.filter(fitting), "hub", "left_semi"), texts, n, percent)))
        if hubs.filter(~fitting).isEmpty():
            break
        beyond = done.filter("large").join(hubs.filter(~fitting), "hub", "left_semi")
        if sketches is None:  # no later round has other sets
            sketches = written(of_pairs(whole.select("doc_id", "n_shingles", "sketch"), pairs.filter("large")))
        pairs = written(reachable(next_pairs(written(meetings(beyond, percent)), percent), sketches, percent))
        if pairs.isEmpty():
            break
        texts = cut_lineage(of_pairs(texts, pairs))  # no others are compared any more
    return reduce(DataFrame.union, found)


def groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    with freed_shuffles(docs.sparkSession):
        return grouped(docs, n, percent)


def grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    whole = cut_lineage(signed(docs, n, percent))
    rows = whole.select("doc_id", "n_shingles", "key_a", "key_b")
    pairs = shared_signatures(whole, percent)
    joined = components(links(docs, pairs, whole, n, percent))
    classes = rows.filter("n_shingles > 0").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    of_class = classes.join(joined, "node", "left").select("key_a", "key_b", "n", F.coalesce("component", "node").alias("component_id"))
    empty = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return lookup(rows.filter("n_shingles > 0"), of_class, ["key_a", "key_b"], "inner").select("doc_id", "n_shingles", "component_id").unionByName(empty)
