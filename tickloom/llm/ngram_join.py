"""Similarity self-join on word n-grams by rare-first prefix filtering.

Texts become sets of n-gram hashes; two texts link when their Jaccard similarity reaches the
threshold. All sets are put in one global order, rare n-grams first, so that two similar sets
must share an n-gram among the first few of both. Pairs that meet on such a *prefix* n-gram
pass four exact filters before their sets are compared once:

* length: the sizes are close enough;
* positional: after the shared n-gram both sets have enough left to reach the overlap;
* suffix: bits that differ between parity bitmaps of the sets bound the n-grams that differ;
* component: pairs already known to be connected add nothing to the classes.

The last one keeps large groups of near copies linear: first every text meets a few members
of its n-gram groups, and the full join then only looks at pairs between different
components. Equal sets take part once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .components import components
from .tokens import Block, blocks, column, grams, map_texts, mix, table

BUCKET_BITS = 18  # n-gram counts are kept for 2**18 buckets, whatever the corpus: 2 MB
BITMAP = 256  # bits of the parity bitmap that goes with every n-gram shared by two texts
LARGE = 4096  # bits of the bitmap that a pair is checked with before whole sets are moved
NEIGHBOURS = 4  # members of each n-gram group that a member is compared with before components are known
GROUP = 4096  # rows of one n-gram group that a window task takes at most, on average
BLOOM_BITS = 23  # 1 MB


def sets_of(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; fewer than n words make one n-gram."""
    block = Block(texts).lowered()
    starts, stops, first = block.words()
    words = block.hashes(starts, stops)
    h, at = grams(words, first, n)
    bounds = np.searchsorted(at, first)
    for i in range(block.n):
        count = first[i + 1] - first[i]
        if count == 0:
            yield h[:0]
        elif count < n:
            yield grams(words[first[i] : first[i + 1]], np.array([0, count]), int(count))[0] + np.uint64(count)
        else:
            yield np.unique(h[bounds[i] : bounds[i + 1]])


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bucket_counts(docs: DataFrame, n: int) -> np.ndarray:
    """In how many texts the n-grams of each bucket occur, over all texts."""

    def run(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in blocks(batches):
            for s in sets_of(column(batch, "text"), n):
                total += np.bincount(_bucket(s), minlength=1 << BUCKET_BITS) if len(s) > 1 << 16 else 0
                if len(s) <= 1 << 16:
                    np.add.at(total, _bucket(s), 1)
        at = np.flatnonzero(total)
        if len(at):
            yield table(bucket=at, count=total[at])

    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    rows = docs.select("text").mapInArrow(run, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))
    found = rows.toArrow()  # at most 2**18 rows
    counts[found["bucket"].to_numpy()] = found["count"].to_numpy()
    return counts


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One number for each set; equal sets have equal numbers."""
    return mix(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets], np.uint64)).view(np.int64)


def _rarity(counts: np.ndarray) -> np.ndarray:
    """Ten bits of log frequency per bucket, so that they sort before the hash."""
    return np.minimum(1023, 32 * np.log2(np.maximum(counts, 1))).astype(np.uint64) << np.uint64(54)


def _index(spark, counts: np.ndarray, n: int, percent: int):
    shared = spark.sparkContext.broadcast(_rarity(counts))

    def make():
        rarity = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = list(sets_of(column(batch, "text"), n))
            keys, maps = [], []
            for s in sets:
                size = len(s)
                maps.append(_parity(s, BITMAP))
                order = rarity[_bucket(s)] | (s >> np.uint64(10))
                order.sort()
                keys.append(order[: size - -(-percent * size // 100) + 1] if size else order)
            bits = np.concatenate(maps).view(np.int64).reshape(-1, BITMAP // 64)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            return table(
                doc_id=column(batch, "doc_id"), row=column(batch, "row"), size=np.array([len(s) for s in sets], np.int64), sig=_signatures(sets),
                **{f"b{i}": bits[:, i] for i in range(BITMAP // 64)},
                keys=pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64))),
            )

        return each

    return make


BITS = [f"b{i}" for i in range(BITMAP // 64)]
MEMBER = ["sig", "size", "pos", *BITS]


def _passes(a: Column, b: Column, percent: int) -> Column:
    """The length, positional and suffix filters for two members (structs) of one group."""
    both = a["size"] + b["size"]
    overlap = F.ceil((percent * both) / (100 + percent) - F.lit(1e-9))
    differ = sum((F.bit_count(a[f].bitwiseXOR(b[f])) for f in BITS), F.lit(0))
    return (
        (100 * F.least(a["size"], b["size"]) >= percent * F.greatest(a["size"], b["size"]))
        & (F.least(a["size"] - a["pos"], b["size"] - b["pos"]) >= overlap)
        & (differ <= both - 2 * overlap)
    )


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _neighbours(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of each member with a few others of its group that pass the filters.

    Members stand in an order of their own in every group, so that a text that shares several
    n-grams with a large group of near copies meets other members in each.
    """
    w = Window.partitionBy("key", "salt").orderBy(F.xxhash64("key", "me.sig"), "me.sig")
    me = members.select("key", "salt", F.struct(*MEMBER).alias("me"))
    others = F.array(F.first("me").over(w), *[F.lag("me", i).over(w) for i in range(1, NEIGHBOURS + 1)])
    near = F.filter("others", lambda o: o.isNotNull() & (o["sig"] != F.col("me.sig")) & _passes(F.col("me"), o, percent))
    pairs = me.select("me", others.alias("others")).select("me", F.explode(near).alias("other"))
    return pairs.select(*_pair("me.sig", "other.sig")).distinct()


def _bloom(rows: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that holds the ``row`` keys of all rows (and, by chance, some others)."""
    places = F.array(F.shiftrightunsigned("row", 64 - BLOOM_BITS), F.col("row").bitwiseAND((1 << BLOOM_BITS) - 1))
    p = rows.select(F.explode(places).alias("p"))
    words = p.groupBy(F.shiftright("p", 5).alias("word")).agg(F.bit_or(F.pow(F.lit(2.0), F.col("p").bitwiseAND(31)).cast("long")).alias("bits"))
    found = words.toArrow()  # at most 2**18 rows
    bitmap = np.zeros(1 << (BLOOM_BITS - 5), np.int64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bitmap


def _in_bloom(bitmap: np.ndarray, row: np.ndarray) -> np.ndarray:
    h = row.view(np.uint64)
    places = ((h >> np.uint64(64 - BLOOM_BITS)).astype(np.int64), (h & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64))
    return np.logical_and(*[(bitmap[p >> 5] >> (p & 31)) & 1 == 1 for p in places])


def _parity(s: np.ndarray, bits: int) -> np.ndarray:
    """Bit i: whether an odd number of the hashes falls to i."""
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def _fetched(docs: DataFrame, reps: DataFrame, pairs: DataFrame, n: int, whole: bool) -> DataFrame:
    """(sig, size, body) of the sets in ``pairs``: their hashes, or large parity bitmaps.

    The texts are read again, and only rows whose key is in a bitmap of the wanted rows are
    looked at: neither the texts nor the list of wanted rows is shuffled or sent around.
    """
    nodes = pairs.select(F.col("u").alias("sig")).unionByName(pairs.select(F.col("v").alias("sig"))).distinct()
    bitmap = docs.sparkSession.sparkContext.broadcast(_bloom(reps.join(nodes, "sig").select("row")))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            mine = batch.filter(pa.array(_in_bloom(bitmap.value, np.asarray(column(batch, "row")))))
            sets = list(sets_of(column(mine, "text"), n))
            if whole:
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                body = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))
            else:
                body = pa.array([_parity(s, LARGE).tobytes() for s in sets], pa.binary())
            return table(sig=_signatures(sets), size=np.array([len(s) for s in sets], np.int64), body=body)

        return each

    # chance hits and repeated rows give a set twice or for nothing; one of each is kept
    rows = map_texts(docs.select("row", "text"), make, f"sig long, size long, body {'array<long>' if whole else 'binary'}").join(nodes, "sig", "left_semi")
    return stored(rows.dropDuplicates(["sig"]), "sets")


def _side_by_side(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with the sizes a, b and the bodies x, y of both sets."""
    left = pairs.select("u", "v").join(sets.select(F.col("sig").alias("u"), F.col("size").alias("a"), F.col("body").alias("x")), "u")
    both = left.join(sets.select(F.col("sig").alias("v"), F.col("size").alias("b"), F.col("body").alias("y")), "v")
    return both.select("u", "v", "a", "b", "x", "y")


def _likely(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Pairs that pass the suffix filter on large bitmaps, with the share of the bound they use."""

    def keep(batches):
        for batch in batches:
            a, b = (np.asarray(column(batch, c)) for c in "ab")
            x, y = (np.frombuffer(b"".join(column(batch, c).to_pylist()), np.uint64).reshape(-1, LARGE // 64) for c in "xy")
            differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            most = a + b - 2 * -(-percent * (a + b) // (100 + percent))
            yield table(u=column(batch, "u"), v=column(batch, "v"), use=differ / (most + 1)).filter(pa.array(differ <= most))

    return _side_by_side(pairs, maps).mapInArrow(keep, "u long, v long, use double")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold, row by row in the JVM."""
    both = _side_by_side(pairs, sets).withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(100 * F.col("common") >= percent * (F.col("a") + F.col("b") - F.col("common"))).select("u", "v")


def _labelled(nodes: DataFrame, classes: DataFrame, node: str, name: str) -> DataFrame:
    """Adds the component of the column ``node``: itself if it has no link yet."""
    known = classes.select(F.col("node").alias(node), F.col("component").alias(name))
    return nodes.join(known, node, "left").withColumn(name, F.coalesce(name, node))


def classes(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, first_row), one row per input row.

    ``row`` is a hash of doc_id and text; ``first_row`` that of the class's first document, by
    doc_id (null last). See ``ngram_join`` for the rest.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    schema = "doc_id long, row long, size long, sig long, " + ", ".join(f"{b} long" for b in BITS) + ", keys array<long>"
    base = stored(map_texts(docs, _index(spark, bucket_counts(docs, n), n, percent), schema), "base")
    filled = base.where("size > 0")
    reps = filled.groupBy("sig").agg(F.min(F.struct("doc_id", "row", *BITS)).alias("r")).select("sig", "r.*")
    entries = filled.select("sig", "size", F.posexplode("keys").alias("pos", "key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("count")).where("count > 1")
    once = entries.join(shared, "key").distinct()
    members = stored(
        once.join(reps.select("sig", *BITS), "sig").withColumn("salt", F.pmod(F.xxhash64("sig"), F.ceil(F.col("count") / GROUP).cast("long"))),
        "members",
    )
    tried = stored(_neighbours(members, percent), "pairs")
    likely = stored(_likely(tried, _fetched(docs, reps, tried, n, whole=False), percent), "likely")
    sets = _fetched(docs, reps, likely, n, whole=True)
    # the most promising partner of every text first: it settles nearly all components
    sides = likely.select(F.col("u").alias("node"), F.col("v").alias("other"), "use").unionByName(likely.select(F.col("v").alias("node"), F.col("u").alias("other"), "use"))
    best = sides.groupBy("node").agg(F.min(F.struct("use", "other")).alias("b")).select(*_pair("node", "b.other")).distinct()
    links = stored(_linked(best, sets, percent), "links")
    linked = stored(components(links), "classes")
    second = _labelled(_labelled(likely, linked, "u", "cu"), linked, "v", "cv").where("cu <> cv").select("u", "v").join(best, ["u", "v"], "left_anti")
    links = stored(links.unionByName(_linked(second, sets, percent)), "links")
    linked = stored(components(links), "classes")
    labelled = _labelled(members, linked, "sig", "comp")
    open_keys = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    left = stored(labelled.join(open_keys, "key").select("key", "comp", F.struct(*MEMBER).alias("m")), "open")
    a, b = left.alias("a"), left.alias("b")
    apart = (F.col("a.m.sig") < F.col("b.m.sig")) & (F.col("a.comp") != F.col("b.comp"))
    rest = stored(
        a.join(b, (F.col("a.key") == F.col("b.key")) & apart & _passes(F.col("a.m"), F.col("b.m"), percent))
        .select(*_pair("a.m.sig", "b.m.sig"))
        .distinct()
        .join(tried, ["u", "v"], "left_anti"),
        "pairs",
    )
    last = stored(_likely(rest, _fetched(docs, reps, rest, n, whole=False), percent).select("u", "v"), "likely")
    more = _linked(last, _fetched(docs, reps, last, n, whole=True), percent)
    linked = stored(components(links.unionByName(more)), "classes")
    placed = _labelled(base.select("doc_id", "row", "size", "sig"), linked, "sig", "class")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    least = placed.where("size > 0").groupBy("class").agg(F.min(order).alias("least"))
    whole = placed.withColumn("class", F.when(F.col("size") > 0, F.col("class"))).join(least, "class", "left")
    own = F.col("size") == 0
    return whole.select(
        "doc_id",
        "row",
        F.col("size").alias("n_shingles"),
        F.when(own, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        F.when(own, F.col("row")).otherwise(F.col("least.row")).alias("first_row"),
    )


def ngram_join(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Classes of texts linked by n-gram Jaccard similarity of ``percent`` or more.

    Returns (doc_id, n_shingles, component_id), one row per input row; ``component_id`` is
    the smallest doc_id reachable by links. ``docs`` needs doc_id and text; other columns are
    ignored. A null text, or one without words, has no n-grams, links with nothing and is its
    own component. Rows that repeat a doc_id stay separate rows. A null doc_id takes part; it
    gets the component of what it is linked with, or null. An empty table gives an empty
    result. n-grams count as equal when their 64-bit hashes are.
    """
    return classes(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row of ``docs`` per class, with all its columns: the first by doc_id (null last).

    Rows without words stay; of rows that repeat a doc_id and text one stays.
    """
    names = docs.columns
    first = classes(docs, n, percent).where("row = first_row").select("row").distinct()
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], key.alias("row"))
    kept = keyed.join(first, "row", "left_semi").dropDuplicates(["row"])
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
