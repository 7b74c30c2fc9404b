"""MinHash near-duplicate detection by an inverted join over signature coordinates.

Documents with equal shingle sets are one class and need no comparison. Each class is posted under
every (coordinate, value) pair of its signature; values that no other class shares are counted and
left out. Two classes whose sets are similar enough agree in ``MATCHES`` coordinates or more (all
but a share of about 1e-9 of such pairs do), so they also meet under one of their rarest
``COORDINATES - MATCHES + 1`` values: longer lists are skipped. Within a list, classes are first
compared with the list's most central class alone. Classes that this joins into one component need
no further comparison. The classes of lists that still hold several components are compared through
their shingles: a class with ``common`` shingles in larger components that links to one of them by
``need`` shared ones has one of its ``common - need + 1`` rarest there too, so it probes with these alone.
Only links that join components come out. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from servicenight.llm import textvec
from servicenight.llm.common import same_row, stored, text_key, without
from servicenight.llm.components import components

SHINGLE = 5
PERCENT = 75
COORDINATES = 48
#: Of pairs at the threshold, under one in 10^9 agrees in fewer coordinates.
MATCHES = 17
#: Classes that probe a shingle, or hold it, in one block, and rows that one group of block pairs takes in.
BLOCK = 512
GROUP_ROWS = 1024
#: Sizes of sets in one band differ by a part of 1 / BANDS; need is counted band by band.
BANDS = 100

_FACTORS = np.random.Generator(np.random.PCG64(9)).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row laid end to end, and how many each row has."""
    data = textvec.LOWER[data]
    starts, ends, n_words = textvec.word_spans(data, offsets)
    words = textvec.span_hashes(textvec.prefix_sums(data), starts, ends)
    hashes, first = textvec.window_hashes(words, n_words, SHINGLE)
    rows = textvec.row_of(n_words)[first]
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        begin = np.cumsum(n_words) - n_words
        whole = [np.uint64(n_words[r]) + np.sum(words[begin[r]:begin[r] + n_words[r]] * textvec.powers(SHINGLE)[:n_words[r]], dtype=np.uint64) for r in short]
        hashes = np.concatenate([hashes, textvec.mix(np.array(whole, np.uint64))])
        rows = np.concatenate([rows, short])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], np.bincount(rows[new], minlength=len(n_words))


def signatures(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_id, signature) of each row; empty sets have neither of the last two."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textvec.column_bytes(batch.column("text"))
            sizes, ids, rows = [], [], []
            for first, last in textvec.steps(offsets):
                hashes, counts = shingle_sets(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
                full = np.flatnonzero(counts)
                begin = (np.cumsum(counts) - counts)[full]
                ids_here, rows_here = [None] * len(counts), [None] * len(counts)
                if len(full):
                    names = np.column_stack([textvec.mix(np.add.reduceat(textvec.mix(hashes ^ np.uint64(salt)), begin) + counts[full].astype(np.uint64)) for salt in (0x51, 0xA7)])
                    values = np.column_stack([np.minimum.reduceat(hashes * f, begin) >> np.uint64(32) for f in _FACTORS]).astype(np.uint32).view(np.int32)
                    for k, r in enumerate(full):
                        ids_here[r], rows_here[r] = names[k].tobytes(), values[k]
                sizes.append(counts)
                ids += ids_here
                rows += rows_here
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()),
                 pa.array(ids, pa.binary()), pa.array(rows, pa.list_(pa.int32()))],
                ["doc_id", "text_key", "n_shingles", "set_id", "signature"])

    chosen = documents.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    schema = chosen.select("doc_id", "text_key").schema.add("n_shingles", "long").add("set_id", "binary").add("signature", T.ArrayType(T.IntegerType()))
    return chosen.mapInArrow(work, schema)


def posting_lists(classes: DataFrame) -> DataFrame:
    """(token, node, n_shingles, signature, weight): each class under the rarest values that can matter.

    ``weight`` is how often the class's values occur in all; the heaviest class of a list is its centre.
    """
    posted = classes.select("node", F.posexplode("signature").alias("i", "value")).select(
        "node", (F.shiftleft(F.col("i").cast("bigint"), 32) + F.col("value").cast("bigint")).alias("token"))
    # stored, so that the join meets two plain shuffles and a frequent value can be split
    shared = stored(posted.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    ranked = posted.join(shared, "token").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"), F.sum("n").alias("weight")).where(F.size("tokens") >= MATCHES)
    prefix = ranked.select("node", "weight", F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - MATCHES + 1)).alias("t"))
    return prefix.select("t.token", "node", "weight").join(classes.select("node", "n_shingles", "signature"), "node")


def may_link(a: str, b: str) -> Column:
    """Sizes that allow the similarity, and enough equal coordinates."""
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    equal = F.size(F.filter(F.zip_with(f"{a}.signature", f"{b}.signature", lambda x, y: x == y), lambda same: same))
    return (100 * small >= PERCENT * large) & (equal >= MATCHES)


def enough(common: Column, a: Column, b: Column) -> Column:
    """Whether sets of these sizes with so many common shingles are similar enough."""
    return 100 * common >= PERCENT * (a + b - common)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long")


def full_sets(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, shingles) of the given classes, read again from one text of each."""
    wanted = classes.select("node", F.col("doc_id").alias("class_id"), F.col("text_key").alias("class_key"))
    texts = documents.select("doc_id", "text").join(wanted, same_row("class_id", "class_key")).select("node", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textvec.column_bytes(batch.column("text"))
            values, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
            for first, last in textvec.steps(offsets):
                hashes, sizes = shingle_sets(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
                values.append(hashes)
                counts.append(sizes)
            places = np.cumsum(np.concatenate(counts)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(values).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "shingles"])

    return texts.mapInArrow(work, "node long, shingles array<long>").dropDuplicates(["node"])


def links_to_centres(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed pairs of a list's most central class and another member."""
    centre = lists.groupBy("token").agg(F.max_by(F.struct("node", "n_shingles", "signature"), F.struct("weight", "node")).alias("c"))
    spokes = lists.alias("m").join(centre, "token").where((F.col("c.node") != F.col("m.node")) & may_link("c", "m"))
    return stored(confirmed(spokes.select(F.least("c.node", "m.node").alias("a"), F.greatest("c.node", "m.node").alias("b")).distinct(), sets))


def still_open(lists: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root, rank, n_shingles, least, band, signature) of the classes of lists that the links leave in several components.

    ``root`` names a class's component so far, ``rank`` orders the components by how many of these classes they hold,
    ``least`` is the smallest set in the class's lists.
    """
    roots = components(links).select("node", "root")
    rooted = stored(lists.drop("weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    open_lists = rooted.groupBy("token").agg(F.min("n_shingles").alias("least"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    rest = stored(rooted.join(open_lists.select("token", "least"), "token").groupBy("node").agg(
        F.first("root").alias("root"), F.first("n_shingles").alias("n_shingles"), F.min("least").alias("least"), F.first("signature").alias("signature")))
    sizes = stored(rest.groupBy("root").agg(F.count("*").alias("n")))
    return stored(rest.join(sizes, "root").select(
        "node", "root", F.struct("n", "root").alias("rank"), "n_shingles", "least", F.floor(F.log("n_shingles") * BANDS).cast("int").alias("band"), "signature"))


def probes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(token, node, probe): under each probed shingle of a band, the classes that probe it and those of the band that hold it.

    Of two classes that can link, the one of the smaller component probes the other one's band. Rare shingles are taken
    first, so what a whole group of copies has in common is probed only by a class that has enough of it to link. A class
    whose shingles that other components have do not do even with the smallest set it may meet is out. The shingles to
    probe are chosen over all sizes, one row for each shingle of a class; only the chosen ones meet the bands, and of
    these the first ones that do for the band's sizes. Copies share whole runs of shingles, which make the same list over
    and over; one of them stays.
    """
    held = members.join(sets, "node").select("node", "root", "rank", "n_shingles", "least", "band", F.explode("shingles").alias("shingle"))
    across = stored(held.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle"))
    held = stored(held.drop("root").join(across, "shingle"))
    able = stored(held.groupBy("node").agg(F.count("*").alias("common"), F.first("n_shingles").alias("n"), F.first("least").alias("least")).where(
        enough(F.col("common"), F.col("n"), F.greatest("least", "common"))).select("node"))
    held = stored(held.drop("least").join(able, "node"))
    spread = (F.max("rank").alias("top"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    within = (F.col("top") > F.col("own_rank")) & (100 * F.col("most") >= PERCENT * F.col("size")) & (100 * F.col("size") >= PERCENT * F.col("least"))
    # 100 * common >= PERCENT * (size + least - common), solved for common
    need = F.ceil(PERCENT * (F.col("size") + F.col("least")) / (100 + PERCENT)).cast("int")
    own = held.select("shingle", "node", F.col("rank").alias("own_rank"), F.col("n_shingles").alias("size"))
    shared = own.join(stored(held.groupBy("shingle").agg(F.count("*").alias("n"), *spread)), "shingle").where(within)
    ranked = shared.groupBy("node", "own_rank", "size").agg(
        F.greatest(F.min("least"), F.ceil(PERCENT * F.col("size") / 100)).alias("least"),
        F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("shingles")).withColumn("common", F.size("shingles")).where(F.col("common") >= need)
    chosen = stored(ranked.select("node", "own_rank", "size", "common", F.posexplode(F.slice("shingles", F.lit(1), F.col("common") - need + 1)).alias("place", "s")).select(
        "node", "own_rank", "size", "common", "place", "s.shingle"))
    places = stored(held.groupBy("shingle", "band").agg(*spread))
    probing = stored(chosen.join(places, "shingle").where(within & (F.col("place") + need <= F.col("common"))).select("shingle", "band", "node", "own_rank"))
    probed = stored(probing.groupBy("shingle", "band").agg(F.min("own_rank").alias("lowest")))
    holding = held.join(probed, ["shingle", "band"]).where(F.col("rank") > F.col("lowest")).select("shingle", "band", "node", F.lit(False).alias("probe"))
    both = probing.select("shingle", "band", "node", F.lit(True).alias("probe")).union(holding)
    return unrepeated(stored(both.select(F.xxhash64("shingle", "band").alias("token"), "node", "probe").groupBy("token", "node").agg(F.max("probe").alias("probe"))))


def unrepeated(lists: DataFrame) -> DataFrame:
    """One list (token, node, probe) of those that hold the same rows, told by their number and 128 bits of hash."""
    alike = lists.groupBy("token").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(salt), "node", "probe")).alias(f"h{salt}") for salt in (1, 2)])
    first = stored(alike.groupBy("n", "h1", "h2").agg(F.min("token").alias("token")).select("token"))
    return stored(lists.join(first, "token"))


def in_blocks(lists: DataFrame) -> DataFrame:
    """Rows (bucket, token, i, j, left, node) that bring each probing class of a list together with each class of the list.

    The p probing classes of a list are cut into p / ``BLOCK`` blocks by a hash, all its n classes into n / ``BLOCK``:
    group (i, j) has block i of the ones on its left, block j of the others on its right. Small lists share a bucket.
    """
    sizes = stored(lists.groupBy("token").agg(F.count("*").alias("n"), F.count_if("probe").alias("p")))
    blocks, probing = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n", "p"))
    at, at_left = (F.pmod(F.xxhash64("node"), k).cast("int") for k in (blocks, probing))
    place = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    right = F.transform(F.sequence(F.lit(0), probing - 1), lambda k: place(k, at, False))
    left = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: place(at_left, k, True))
    dealt = lists.join(sizes, "token").select("token", "node", F.explode(F.when(F.col("probe"), F.concat(left, right)).otherwise(right)).alias("place"))
    rows = sizes.agg(F.sum(F.col("n") * probing + F.col("p") * blocks)).first()[0] or 0
    return dealt.select("token", "place.*", "node").withColumn("bucket", F.pmod(F.xxhash64("token", "i", "j"), F.lit(rows // GROUP_ROWS + 1)))


class Forest:
    """Components of a bucket while its links are found."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        while x in self.above:
            x = self.above[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.above[a] = b
        return a != b


class Bucket:
    """The groups of a bucket, their columns laid out once."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.node, self.root, self.size, self.on_left = (table.column(c).to_numpy() for c in ("node", "root", "n_shingles", "left"))
        self.signature = table.column("signature").chunk(0).flatten().to_numpy().reshape(-1, COORDINATES)
        shingles = table.column("shingles").chunk(0)
        self.places, self.shingles = shingles.offsets.to_numpy(), shingles.values.to_numpy()
        _, group = np.unique(np.column_stack([table.column(c).to_numpy() for c in ("token", "i", "j")]), axis=0, return_inverse=True)
        order = np.argsort(group.ravel(), kind="stable")
        self.groups = np.split(order, np.flatnonzero(np.diff(group.ravel()[order])) + 1)
        self.forest = Forest()
        self.tried: set[tuple[int, int]] = set()

    def linked(self, x: int, y: int) -> bool:
        """Whether the full sets of two rows are similar enough."""
        a, b = (self.shingles[self.places[r]:self.places[r + 1]] for r in (x, y))
        common = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * common >= PERCENT * (len(a) + len(b) - common)

    def candidates(self, rows: np.ndarray) -> tuple[list[int], list[int]]:
        """Pairs of the two sides of a group that may link two components, best agreeing ones first."""
        left, right = rows[self.on_left[rows]], rows[~self.on_left[rows]]
        equal = np.zeros((len(left), len(right)), np.int16)
        x, y = self.signature[left], self.signature[right]
        if equal.size <= BLOCK:
            equal += (x[:, None] == y[None]).sum(2, dtype=np.int16)
        else:
            for k in range(COORDINATES):
                equal += x[:, k][:, None] == y[:, k][None, :]
        a, b = np.nonzero(equal >= MATCHES)
        order = np.argsort(-equal[a, b], kind="stable")
        a, b = left[a[order]], right[b[order]]
        small, large = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        keep = (self.root[a] != self.root[b]) & (100 * small >= PERCENT * large)
        return a[keep].tolist(), b[keep].tolist()

    def links(self) -> list[tuple[int, int]]:
        """Links within groups that join components, each confirmed on the full sets.

        Pairs whose components are already joined are passed over, so at most one link per member comes out;
        a pair of several groups is compared once.
        """
        out = []
        for rows in self.groups:
            for x, y in zip(*self.candidates(rows)):
                a, b = int(self.root[x]), int(self.root[y])
                pair = int(self.node[x]), int(self.node[y])
                if self.forest.root(a) == self.forest.root(b) or pair in self.tried:
                    continue
                if self.linked(x, y):
                    self.forest.join(a, b)
                    out.append(pair)
                else:
                    self.tried.update((pair, pair[::-1]))
        return out


def links_between_components(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b) that join components of the members: enough to connect whatever is connected."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Bucket(pa.Table.from_batches(list(batches))).links()
        a, b = zip(*links) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = in_blocks(probes(members, sets)).join(members.select("node", "root", "n_shingles", "signature"), "node").join(sets, "node")
    return dealt.groupBy("bucket").applyInArrow(work, "a long, b long")


def linked_classes(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between classes: enough of them to connect whatever is connected."""
    lists = stored(posting_lists(classes))
    sets = stored(full_sets(documents, lists.select("node").distinct().join(classes, "node")))
    links = links_to_centres(lists, sets)
    return links.union(links_between_components(still_open(lists, links), sets))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, set_id, n_shingles, component_id) of every row.

    A row without words has no set and is its own component. A null doc_id never names a
    component that has another id. Rows of one doc_id are separate rows with their own sets.
    """
    rows = stored(signatures(documents))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    # numbered as they are stored, so the numbers stay
    classes = stored(rows.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(
        F.min_by(F.struct("doc_id", "text_key", "n_shingles", "signature"), order).alias("r")).select(
        "set_id", "r.*", F.monotonically_increasing_id().alias("node")))
    roots = components(linked_classes(documents, classes))
    rooted = classes.select("set_id", "node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(smallest, "root").select(F.col("set_id").alias("_set"), "component_id")
    return rows.join(named, F.col("set_id") == F.col("_set"), "left").select(
        "doc_id", "text_key", "set_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicate_report(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_each(documents: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its own columns.

    Rows without words all stay, and so do rows that repeat the smallest doc_id.
    """
    found = near_duplicates(documents.select("doc_id", "text"))
    return without(documents, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))))
