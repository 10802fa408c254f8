"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.graph import components
from tallyline.llm.text import few_at_a_time, give_back, hashed_words, mix, shingles, utf8
from tallyline.staging import stage

SLOTS, ROWS = 128, 4
#: Members of a bucket that are compared all at once, and the shingles they have together.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: A shingle that so many members of a block share is counted by a matrix product, others pair by pair.
COMMON = 32


def super_minhash(elements: np.ndarray, owner: np.ndarray, sets: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures of ``sets`` sets given as element hashes with the set each belongs to.

    Every element draws a permutation of the slots and one uniform number per rank;
    at rank j it offers ``j + uniform`` to the j-th slot of its permutation, and a
    slot keeps the least offer. Ranks are walked for all elements at once. A set
    stops as soon as all its slots are filled, because later ranks only offer more.
    """
    best = np.full((sets, slots), np.iinfo(np.uint64).max, np.uint64)
    order = None
    for rank in range(slots):
        draw = mix(elements + np.uint64((rank + 1) * 0xA0761D6478BD642F % (1 << 64)))
        pick = rank + ((draw >> np.uint64(32)) % np.uint64(slots - rank)).astype(np.int64)
        if rank == 0:
            slot = pick
        else:
            rows = np.arange(len(elements))
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[rows, rank]
            order[rows, rank] = slot
        offer = (np.uint64(rank) << np.uint64(56)) | (mix(draw) >> np.uint64(8))
        np.minimum.at(best.reshape(-1), owner * slots + slot, offer)
        open_sets = (best == np.iinfo(np.uint64).max).any(axis=1)
        stay = open_sets[owner]
        if not stay.any():
            break
        elements, owner = elements[stay], owner[stay]
        if rank == 0:
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
            rows, first = np.arange(len(elements)), slot[stay]
            order[rows, first] = 0
            order[:, 0] = first
        else:
            order = order[stay]
    return best


def _sign(width: int, slots: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_a_time(batches, most=1 << 20):
            words, at = hashed_words(utf8(batch.column("text")))
            sets = [shingles(words[low:high], width) for low, high in zip(at[:-1], at[1:])]
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            signature = super_minhash(flat, np.repeat(np.arange(len(sets)), sizes), len(sets), slots)
            bands = np.zeros((len(sets), slots // rows), np.uint64)
            for k in range(rows):
                bands = mix(bands + signature[:, k::rows]) + np.arange(slots // rows, dtype=np.uint64)
            ends = np.cumsum(sizes)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (flat, mix(flat))]
            one, two = ((s[ends] - s[ends - sizes]).astype(np.int64) for s in sums)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands.shape[1]),
                                              pa.array(bands.reshape(-1).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(one), pa.array(two), listed],
                ["doc_id", "n_shingles", "print_one", "print_two", "bands"])
        give_back()
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_a_time(batches, most=1 << 20):
            words, at = hashed_words(utf8(batch.column("text")))
            sets = [shingles(words[low:high], width) for low, high in zip(at[:-1], at[1:])]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64)))],
                                             ["doc_id", "members"])
        give_back()
    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets of hashes.

    Shingles of one set alone are left out first.  Common ones form a membership
    matrix, in slices; of the others every pair of holders is counted.
    """
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    holders = np.diff(np.append(starts, len(flat)))
    common = np.flatnonzero(holders >= COMMON)
    for low in range(0, len(common), 4096):
        some = common[low: low + 4096]
        column = np.repeat(np.arange(len(some)), holders[some])
        at = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(holders[some])[:-1]]), holders[some]) + np.arange(holders[some].sum())
        has = np.zeros((n, len(some)), np.float32)
        has[owner[at], column] = 1
        out += has @ has.T
    for k in range(1, COMMON - 1):  # the pairs k places apart in the lists of holders
        some = starts[(holders > k) & (holders < COMMON)]
        left = holders[(holders > k) & (holders < COMMON)] - k
        at = np.repeat(some - np.concatenate([[0], np.cumsum(left)[:-1]]), left) + np.arange(left.sum()) if len(some) else np.zeros(0, int)
        pairs = np.bincount(owner[at] * n + owner[at + k], minlength=n * n).reshape(n, n) if len(at) else 0
        out += pairs + (pairs.T if len(at) else 0)
    return out


def joined_parts(ids: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies in different parts: at most one per part beyond the first.

    ``parts`` says which members are connected already.  Every pair is verified on
    its full sets; what is returned connects the same members as all links found.
    """
    sizes = np.array([len(s) for s in sets], np.float32)
    shared = shared_counts(sets)
    linked = denominator * shared >= numerator * (sizes[:, None] + sizes[None, :] - shared)
    linked &= parts[:, None] != parts[None, :]
    top = {int(p): int(p) for p in np.unique(parts)}

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    a, b = [], []
    for i in np.flatnonzero(linked.any(axis=1)):
        for p, j in zip(*np.unique(parts[linked[i]], return_index=True)):  # one member of each other part
            one, two = root(int(parts[i])), root(int(p))
            if one != two:
                top[max(one, two)] = min(one, two)
                a.append(ids[i])
                b.append(ids[np.flatnonzero(linked[i])[j]])
    return np.array(a, np.int64), np.array(b, np.int64)


def _joined(numerator: int, denominator: int):
    """Verified links between parts, from rows sorted by bucket and block pair; one block pair is held at a time."""
    def judged(rows: pa.Table) -> pa.RecordBatch:
        sets = rows.column("members").combine_chunks()
        at, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        found = joined_parts(rows.column("id").to_numpy(), rows.column("part").to_numpy(),
                             [flat[low:high] for low, high in zip(at[:-1], at[1:])], numerator, denominator)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if kept is None else [*kept.to_batches(), batch])
            keys = np.stack([rows.column(c).to_numpy() for c in ("bucket", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if high - low > 1:
                    yield judged(rows.slice(low, high - low))
            kept = rows.slice(cuts[-1])
        if kept is not None and kept.num_rows > 1:
            yield judged(kept)
        give_back()
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    at_least: tuple[int, int] = (75, 100), slots: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per input row.

    1. Texts become sets of hashed word shingles and SuperMinHash signatures.
       Documents with the same set form a class, found by a fingerprint of the set;
       only the smallest id of a class goes on.
    2. A bucket is a band of ``rows`` signature slots. Every member is verified
       against the bucket's smallest id, on full sets. This is linear in the bucket.
    3. A bucket whose members then lie in several components is compared further, in
       blocks of bounded size: a task counts the intersections of all pairs of a
       block pair on full sets and gives out at most one link per component, never a
       row per pair. A component that fills blocks of its own is not compared with
       itself.
    4. Components of all verified links.

    A pair at the threshold misses all ``slots / rows`` bands with probability
    (1 - 0.75**4)**32, about 5e-6.
    Null or blank texts have an empty set and stay alone. A null id stays alone, has
    no component and is kept. Repeated rows count as copies and share one id; of an id
    with several texts the least one is verified. An empty table gives no rows, and
    other columns, clashing names included, are not read.
    """
    numerator, denominator = at_least
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = stage(plain.mapInArrow(_sign(width, slots, rows),
                                    "doc_id long, n_shingles long, print_one long, print_two long, bands array<long>"), "signed")
    key = ["print_one", "print_two", "n_shingles"]
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stage(filled.groupBy(*key).agg(F.min("doc_id").alias("first_id")), "classes")
    firsts = filled.join(classes.select(F.col("first_id").alias("doc_id")), "doc_id", "left_semi")
    banded = firsts.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    buckets = stage(banded.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("size"))
                    .where("size > 1 and lead.id is not null"), "buckets")
    members = stage(banded.join(buckets, "bucket").select("bucket", "id", "n", "size", F.col("lead.id").alias("lead"),
                                                          F.col("lead.n").alias("lead_n")).distinct(), "members")

    def similar_sizes(x: str, y: str) -> Column:
        return denominator * F.least(x, y) >= numerator * F.greatest(x, y)

    star = stage(members.where("id != lead").where(similar_sizes("n", "lead_n"))
                 .select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "star")

    # every document in a bucket with others, once; its text is the only one that moves
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    sets = stage(plain.join(wanted.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
                 .mapInArrow(_sets(width), "doc_id long, members array<long>"), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        side = {k: sets.select(F.col("doc_id").alias(k), F.col("members").alias(f"members_{k}")) for k in "ab"}
        both = pairs.join(side["b"], "b").join(side["a"], "a")
        shared = both.select("a", "b", F.size(F.array_intersect("members_a", "members_b")).alias("shared"),
                             (F.size("members_a") + F.size("members_b")).alias("total"))
        return stage(shared.where(denominator * F.col("shared") >= numerator * (F.col("total") - F.col("shared"))).select("a", "b"), name)

    links = verified(star, "star-links")

    def still_mixed() -> tuple[DataFrame, DataFrame]:
        """Bucket members with their component so far, and the buckets that hold several components."""
        placed = members.select("bucket", "id", "n", "size").join(stage(components(links), "parts"), "id", "left").select(
            "bucket", "id", "n", "size", F.coalesce("component", "id").alias("part"))
        return placed, stage(placed.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"))
                             .where("low < high").select("bucket"), "mixed")

    placed, mixed = still_mixed()
    crowd = placed.join(mixed, "bucket", "left_semi")
    blocks = lambda n, size: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(size) / BLOCK_SHINGLES)).cast("int")
    own = stage(crowd.groupBy("bucket", "part").agg(F.count("*").alias("members_of"), F.sum("n").alias("shingles_of"))
                .withColumn("alone", blocks("members_of", "shingles_of") > 1), "crowd-parts")
    rest = own.where("not alone").groupBy("bucket").agg(F.sum("members_of").alias("members_of"), F.sum("shingles_of").alias("shingles_of"))
    # blocks of a bucket: some for each component that fills them, the others shared
    listed = own.where("alone").select("bucket", "part", blocks("members_of", "shingles_of").alias("n_blocks")).unionByName(
        rest.select("bucket", F.lit(None).cast("long").alias("part"), blocks("members_of", "shingles_of").alias("n_blocks")))
    listed = listed.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("part", "n_blocks"))).alias("groups"))
    numbered = stage(listed.withColumn("firsts", F.transform("groups", lambda g, i: F.aggregate(
        F.slice("groups", 1, i), F.lit(0), lambda s, x: s + x["n_blocks"]))), "blocks")
    group = F.array_position(F.transform("groups", lambda g: g["part"].eqNullSafe(F.when(F.col("alone"), F.col("part")))), F.lit(True)).cast("int")
    homed = (crowd.join(own.select("bucket", "part", "alone"), ["bucket", "part"]).join(numbered, "bucket").withColumn("group", group)
             .withColumn("block", F.element_at("firsts", F.col("group")) + F.pmod(F.xxhash64("id"), F.element_at("groups", F.col("group"))["n_blocks"]).cast("int")))
    partners = F.flatten(F.transform(F.arrays_zip("groups", "firsts"), lambda g, i: F.when(
        F.col("alone") & (i + 1 == F.col("group")), F.array().cast("array<int>")).otherwise(
            F.sequence(g["firsts"], g["firsts"] + g["groups"]["n_blocks"] - 1))))
    key_pair = ["bucket", "i", "j"]
    paired = homed.withColumn("other", F.explode(partners)).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("id").alias("doc_id"), "part")
    joined = (paired.join(sets, "doc_id").withColumnRenamed("doc_id", "id").repartition(*key_pair).sortWithinPartitions(*key_pair)
              .mapInArrow(_joined(numerator, denominator), "a long, b long"))
    links = links.union(stage(joined.distinct(), "joined"))
    parts = components(links).withColumnRenamed("id", "first_id")
    return (signed.select("doc_id", *key).join(classes, key, "left").join(parts, "first_id", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
