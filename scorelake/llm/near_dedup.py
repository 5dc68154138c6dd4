"""MinHash near-duplicates by an inverted join on signature coordinates.

A document's set is its distinct runs of SHINGLE_WORDS words (the whole sequence if shorter). Equal
sets are one class and are compared once. A class has a signature of COORDINATES minima. Classes
are posted under each coordinate-value pair of a prefix of the signature: classes with a Jaccard
similarity s share none of PREFIX coordinates with probability (1 - s)^PREFIX, 1e-7 at 0.8.
Posting lists are merged in tiles: the collisions of two classes on the whole signature are
counted, and a pair is looked at only in the list of its first common coordinate; it is skipped in
the later ones. Classes with a partner of MATCHES collisions or more (0.5 of the coordinates, which
a pair of similarity 0.8 misses with probability below 1e-7) are retained, and their links are
confirmed on the full sets, tile by tile.

A list of m classes is cut into chunks and every two chunks meet in a tile, so no task gets a whole
long list. A tile gives classes, and then a spanning forest of its links: never pairs of a whole
group. Components of the links are found by alternating stars over written tables.

Defined cases: a NULL text or one without words has no set, is linked with nothing and is its own
component; a NULL doc_id never names a component unless all its documents have none. Repeated rows
are equal documents: both get the same component, and kept is true for each of them if their id is
the component's. A very long text is one set in its task's memory. Between texts of equal collisions there
is nothing to choose: every link counts, and a component has the smallest id. An empty table gives an
empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.sources.workspace import new_folder

SHINGLE_WORDS = 5
PERCENT = 80
COORDINATES = 64
PREFIX = 10
MATCHES = 32
#: Classes of a chunk of a posting list: at least this, and growing with the root of the list's length.
CHUNK, CHUNK_ROOT = 256, 8
#: Sets of a block when links are confirmed (two blocks meet in a matrix), and pairs that are counted at once.
BLOCK, PAIRS = 512, 1 << 20
#: Bits of a key filter: per key, a power of two in all, and at most.
KEY_BITS, MOST_BITS = 16, 1 << 27
_PAGE = 1 << 15
_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_MIX = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_SIGNED = "doc_id long, text_hash long, n_shingles long, node binary, prefix array<long>, sig binary"


def shingles(text: str, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a text's word runs; A-Z is lower-cased first."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(hashed))
    mixed = np.full(len(hashed) - n + 1, np.uint64(n))
    for k in range(n):
        mixed = (mixed ^ hashed[k : len(hashed) - n + 1 + k]) * _MIX[k % len(_MIX)]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each coordinate, 32 bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 8192):
        part = hashes[None, at : at + 8192] * _FACTORS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signed(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """Per row: doc_id, a hash of the text, set size, class (NULL for an empty set), prefix values, and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, prefixes, sigs = [], [], [], []
            for value in batch.column(1):
                hashes = shingles(value.as_py() or "", width)
                sizes.append(len(hashes))
                if len(hashes):
                    sig = signature(hashes)
                    nodes.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    prefixes.append(sig[:PREFIX].astype(np.int64))
                    sigs.append(sig[:PREFIX].tobytes() + sig.astype(np.uint16).tobytes())
                else:
                    nodes.append(None)
                    prefixes.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(prefixes, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "node", "prefix", "sig"],
            )

    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash")
    ).mapInArrow(run, _SIGNED)


def _written(df: DataFrame, name: str) -> DataFrame:
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def with_among(rows: DataFrame, flag: str, hashed: Column, keys: DataFrame) -> DataFrame:
    """rows with a column flag: false only where a hash is not in the column `h` of keys; true for all of those and few others.

    Keys set a bit each in pages of bits; the pages, MOST_BITS bits in all at most, go to all tasks. Where keys are
    too many for them, more and more is true, in the end everything.
    """
    n = keys.count()
    bits = min(MOST_BITS, max(_PAGE, 1 << (KEY_BITS * n).bit_length()))
    if n > MOST_BITS:
        return rows.withColumn(flag, F.lit(True))
    place = F.col("h").bitwiseAND(bits - 1) + 1
    pages = keys.groupBy(F.bitmap_bucket_number(place).alias("__page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__bits"))
    at = hashed.bitwiseAND(bits - 1)
    placed = rows.withColumn("__at", at).withColumn("__page", F.col("__at").bitwiseAND(-_PAGE) / _PAGE + 1)
    placed = placed.withColumn("__page", F.col("__page").cast("long"))
    joined = placed.join(F.broadcast(pages), "__page", "left")
    byte = F.conv(F.hex(F.expr(f"substring(__bits, cast((__at % {_PAGE}) / 8 AS int) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("cast(__at % 8 AS int)")
    held = byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), bit + 1)) > 0
    return joined.withColumn(flag, F.coalesce(held, F.lit(False))).drop("__page", "__at", "__bits")


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[list]]:
    """Consecutive rows of equal first n_keys columns, as lists by column."""
    held: list[list] | None = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        keys = list(zip(*columns[:n_keys], strict=True))
        start = 0
        for at in range(1, len(keys) + 1):
            if at < len(keys) and keys[at] == keys[start]:
                continue
            part = [c[start:at] for c in columns]
            if held is not None and tuple(c[0] for c in held[:n_keys]) == keys[start]:
                for have, more in zip(held, part, strict=True):
                    have.extend(more)
            else:
                if held is not None:
                    yield held
                held = part
            start = at
    if held is not None:
        yield held


def _retained(a_chunk: np.ndarray, coordinate: int, sizes: np.ndarray, sigs: list[bytes], crossing: bool) -> np.ndarray:
    """True for rows of a tile with a partner of MATCHES collisions whose first common coordinate is this one."""
    raw = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)
    prefix = np.ascontiguousarray(raw[:, : 4 * PREFIX]).view(np.uint32)
    whole = np.ascontiguousarray(raw[:, 4 * PREFIX :]).view(np.uint16)
    found = np.zeros(len(sigs), bool)
    left = np.flatnonzero(a_chunk == a_chunk.min()) if crossing else np.arange(len(sigs))
    right = np.flatnonzero(a_chunk != a_chunk.min()) if crossing else left
    if not len(left) or not len(right):
        return found
    sizes_right, whole_right, prefix_right = sizes[right], whole[right].T.copy(), prefix[right].T.copy()
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        matches = np.zeros((len(rows), len(right)), np.uint8)
        for k in range(COORDINATES):
            matches += whole[rows, k, None] == whole_right[k][None, :]
        small = np.minimum(sizes[rows, None], sizes_right[None, :])
        large = np.maximum(sizes[rows, None], sizes_right[None, :])
        good = (matches >= MATCHES) & (100 * small >= PERCENT * large)
        for k in range(coordinate):
            good &= prefix[rows, k, None] != prefix_right[k][None, :]
        if not crossing:
            good &= rows[:, None] != right[None, :]
        found[rows] |= good.any(axis=1)
        found[right] |= good.any(axis=0)
    return found


def _retain_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in _runs(batches, 4):
        bucket, coordinate, low, high, chunk, sizes, nodes, sigs = some
        if len(nodes) < 2:
            continue
        keep = np.flatnonzero(_retained(np.array(chunk), coordinate[0], np.array(sizes), sigs, low[0] != high[0]))
        if len(keep):
            pick = lambda column: [column[i] for i in keep]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array(pick(bucket), pa.int64()), pa.array(pick(low), pa.int32()), pa.array(pick(high), pa.int32()),
                 pa.array(pick(nodes), pa.binary())],
                names=["bucket", "low", "high", "node"],
            )


def common_counts(sets: list[np.ndarray], dense_from: int = 24) -> np.ndarray:
    """How many members each two sets have in common, as a matrix.

    Members of few sets are counted pair by pair, members of many by matrix products.
    """
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    members = np.concatenate(sets)
    order = np.argsort(members, kind="stable")
    members, owner = members[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], members[1:] != members[:-1]]))
    lengths = np.diff(np.append(starts, len(members)))
    counts = np.zeros(m * m, np.int64)
    for n in np.unique(lengths[(lengths > 1) & (lengths < dense_from)]):
        group = owner[starts[lengths == n][:, None] + np.arange(n)]
        a, b = np.triu_indices(n, 1)
        some = max(1, PAIRS // len(a))
        for at in range(0, len(group), some):
            part = group[at : at + some]
            np.add(counts, np.bincount((part[:, a] * m + part[:, b]).ravel(), minlength=m * m), out=counts)
    wide = np.flatnonzero(lengths >= dense_from)
    for at in range(0, len(wide), 2048):
        columns = wide[at : at + 2048]
        dense = np.zeros((m, len(columns)), np.float32)
        for j, k in enumerate(columns):
            dense[owner[starts[k] : starts[k] + lengths[k]], j] = 1
        counts += (dense @ dense.T).astype(np.int64).ravel()
    counts = counts.reshape(m, m)
    counts = np.maximum(counts, counts.T)  # pairs were counted on one side of the diagonal
    np.fill_diagonal(counts, [len(s) for s in sets])
    return counts


def forest(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links of a spanning forest over all pairs of sets with 100 * common >= percent * union.

    More than two blocks of sets meet two by two, so no matrix grows with their number; two blocks
    that are one component already have nothing to add.
    """
    if len(sets) <= 2 * BLOCK:
        return _block_forest(sets, percent)
    links, component = [], np.arange(len(sets))
    starts = range(0, len(sets), BLOCK)
    for i, low in enumerate(starts):
        for high in starts[i + 1 :]:
            rows = np.r_[low : low + BLOCK, high : min(high + BLOCK, len(sets))]
            if (component[rows] == component[rows[0]]).all():
                continue
            for a, b in _block_forest([sets[x] for x in rows], percent):
                a, b = rows[a], rows[b]
                if component[a] != component[b]:
                    links.append((int(a), int(b)))
                    component[component == component[b]] = component[a]
    return links


def _block_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    common = common_counts(sets)
    sizes = np.array([len(s) for s in sets])
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    links, todo = [], np.ones(len(sets), bool)
    for root in range(len(sets)):
        if not todo[root]:
            continue
        todo[root] = False
        edge = [root]
        while edge:
            at = edge.pop()
            near = np.flatnonzero(linked[at] & todo)
            todo[near] = False
            edge.extend(near)
            links.extend((at, int(x)) for x in near)
    return links


def _confirm_tiles(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, nodes, sets in _runs(batches, 3):
            # A class comes more than once if several rows of its smallest id have its set.
            of = dict(zip(nodes, sets, strict=True))
            names = sorted(of)
            if len(names) < 2:
                continue
            links = forest([np.frombuffer(of[x], np.uint64) for x in names], percent)
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[b] for _, b in links], pa.binary()), pa.array([names[a] for a, _ in links], pa.binary())],
                    names=["u", "v"],
                )

    return run


def _sets_of(rows: DataFrame, width: int) -> DataFrame:
    """rows (text, node, tiles): the set of each class in each of its tiles; other texts of the same id are left out.

    A task gives a class once, however many rows repeat its id and text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            held = 0
            for text, node, tiles in zip(*(batch.column(i) for i in range(3)), strict=True):
                if node.as_py() in given:
                    continue
                hashes = shingles(text.as_py() or "", width)
                if xxhash.xxh3_128_digest(hashes.tobytes()) != node.as_py():
                    continue
                given.add(node.as_py())
                packed = hashes.tobytes()
                for tile in tiles.as_py():
                    for column, value in zip(out, (tile["bucket"], tile["low"], tile["high"], node.as_py(), packed), strict=True):
                        column.append(value)
                    held += len(packed)
                if held > 16 << 20:
                    yield _set_batch(out)
                    out, held = ([], [], [], [], []), 0
            yield _set_batch(out)

    return rows.select("text", "node", "tiles").mapInArrow(run, "bucket long, low int, high int, node binary, members binary")


def _set_batch(columns: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    names = ["bucket", "low", "high", "node", "members"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def retained(classes: DataFrame) -> DataFrame:
    """classes (node, n_shingles, prefix, sig) to (bucket, low, high, node): who may have a link, and in which tile."""
    postings = classes.select("node", "n_shingles", F.posexplode("prefix").alias("coordinate", "value"))
    postings = postings.withColumn("bucket", F.xxhash64("coordinate", "value")).drop("value")
    lists = postings.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    chunk = F.greatest(F.lit(CHUNK).cast("double"), CHUNK_ROOT * F.sqrt("m"))
    shared = postings.join(lists, "bucket").withColumn("chunks", F.ceil(F.col("m") / chunk).cast("int")).drop("m")
    shared = shared.join(classes.select("node", "sig"), "node")
    shared = shared.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = shared.select(
        "bucket", "coordinate", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        "own", "n_shingles", "node", "sig",
    )
    keys = ("bucket", "coordinate", "low", "high")
    together = tiles.repartition(*keys).sortWithinPartitions(*keys)
    return together.mapInArrow(_retain_tiles, "bucket long, low int, high int, node binary")


def links_of(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """Confirmed links (u, v) between classes (node, doc_id, ...), enough of them to connect whatever is linked."""
    found = retained(classes).groupBy("node").agg(F.collect_set(F.struct("bucket", "low", "high")).alias("tiles"))
    wanted = found.join(classes.select("node", F.col("doc_id").alias("first_id")), "node")
    wanted = _written(wanted, "wanted")
    texts = docs.select(F.col(doc_id).cast("long").alias("first_id"), F.col(text).alias("text"))
    # Only texts of retained classes are shuffled, and few others.
    keys = wanted.select(F.xxhash64("first_id").alias("h"))
    texts = with_among(texts, "among", F.xxhash64("first_id"), keys).where("among").drop("among")
    rows = texts.join(wanted, texts["first_id"].eqNullSafe(wanted["first_id"]))
    keys = ("bucket", "low", "high")
    sets = _sets_of(rows, width).repartition(*keys).sortWithinPartitions(*keys)
    return sets.mapInArrow(_confirm_tiles(percent), "u binary, v binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (u, v): a row (node, component) per node; component is its smallest node.

    Alternates large and small stars over written tables until the links no longer change.
    """
    links = _written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = _written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable) and kept (whether it is that one)."""
    rows, named = _named(docs, doc_id, text, width, percent)
    sets = rows.where(F.col("node").isNotNull())
    linked = sets.select("doc_id", "n_shingles", "node").join(named, "node").drop("node", "first_node")
    alone = rows.where(F.col("node").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _named(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signature of every row, and of each class its component and that one's smallest id and class."""
    rows = _written(signed(docs, doc_id, text, width), "signatures")
    sets = rows.where(F.col("node").isNotNull())
    firsts = sets.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("prefix").alias("prefix")
    )
    classes = _written(firsts, "classes")
    group = components(links_of(docs, classes, doc_id, text, width, percent))
    grouped = classes.select("node", "doc_id").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "node")
    names = grouped.groupBy("component").agg(F.min(least).alias("first"))
    names = names.select("component", F.col("first.doc_id").alias("component_id"), F.col("first.node").alias("first_node"))
    return rows, grouped.join(names, "component").select("node", "component_id", "first_node")


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """The rows of docs but one of each component: one with its smallest doc_id, and of those its least text hash.

    Rows without a set are all kept. Columns stay as they are; of rows equal in id and text any one is taken.
    """
    rows, named = _named(docs, doc_id, text, width, percent)
    keys = ["doc_id", "text_hash"]
    members = rows.where(F.col("node").isNotNull()).join(named, "node").groupBy("first_node", *keys).agg(F.count(F.lit(1)).alias("n"))
    members = _written(members, "members")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), *keys)
    leads = members.groupBy("first_node").agg(F.min(rank).alias("lead"))
    judged = members.join(leads, "first_node").withColumn("leads", rank == F.col("lead"))
    # Only rows that go, and the few leads that are several rows, need a decision.
    decided = judged.where(~F.col("leads") | (F.col("n") > 1)).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("leads").alias("__leads")
    )
    decided = _written(decided, "decided")
    texts = docs.withColumn("__own", F.xxhash64(F.col(text)))
    # Rows that no decision can touch stay where they are; the others meet the decisions.
    keys = decided.select(F.xxhash64("__id", "__hash").alias("h"))
    texts = with_among(texts, "__touched", F.xxhash64(F.col(doc_id).cast("long"), "__own"), keys)
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash"))
    joined = texts.where("__touched").join(decided, same, "left")
    single = texts.where("NOT __touched").unionByName(joined.where(F.col("__leads").isNull()), allowMissingColumns=True).select(*docs.columns)
    several = joined.where("__leads").groupBy("__id", "__hash").agg(F.first(F.struct(*docs.columns)).alias("row"))
    return single.unionByName(several.select("row.*"))
