r"""Near-duplicate groups: banded MinHash, sequential Bayesian pruning, exact checks.

A document's set holds the 64-bit hashes of its distinct five-word shingles.
Documents of equal sets are one class from the start; only one of each class is
compared.  Signatures of ``BANDS * ROWS`` minima are cut into bands; documents
that share a band are candidates.  A pair of similarity s shares one with
probability ``1 - (1 - s**ROWS)**BANDS``, which is 0.99998 at 0.75 and 0.0004
at 0.1, so that passages many documents share bring few candidates.

Most buckets hold one class.  They are found by a bitmap of the hashes of the
buckets that hold several, of fixed size; only rows with such a bucket go on,
and only their texts are read again, found by hashes of their content.

Candidates are never expanded to all pairs of a bucket.  First each member of a
bucket meets one leader (of its part of the bucket, then the parts' leaders meet
the bucket's); a leader of too different a size only leaves the member to later.
Pairs compare their signatures batch by batch; after each batch a pair goes on
only while the posterior probability of a similarity of at least ``THRESHOLD``
(uniform prior, m of n minima equal) stays above ``MISS``.  Survivors are checked
on their full sets, each leader's text beside its members', and links give
components.  What is left are pairs that share a bucket across components.  In
such a bucket the rows of its largest component meet the others, never
themselves, and the others meet each other: blocks of bounded weight (rows and
shingles) in groups that compare signatures the same way.  A group hands on one
row with the pairs that stay possible; the texts of their rows then join the
group, and only links that join components come out.  So every candidate pair
ends up in one component or is compared itself, no link is lost but by the two
stated probabilities, and pairs are no rows of their own.

Components come from alternating star contraction on the links.  Neither links
nor labels leave the executors.

Words are runs of anything but ``[\x20\x09-\x0D]`` with A-Z lower-cased; a text
of fewer than five words has its whole sequence as the only shingle.

Defined results: a text without words, or null, has an empty set, is its own
component and is kept.  ``component_id`` is the smallest id of the component
(null ids only if it has no other).  Repeated rows are one class; each gets a
row.  ``first_row`` is true for one row of each component.  The documents are
read twice, in any order; a text that is gone at the second time is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finframe.llm.bitmaps import gathered, known, marked
from finframe.session import checkpointed

SHINGLE = 5
BANDS, ROWS = 40, 5
THRESHOLD = 75  # percent
MISS = 1e-6
BATCH = 40  # minima compared before each look at the posterior
PARTS = 64  # leaders of one bucket
BLOCK = 512  # rows of a bucket that are compared with each other in one group
HEAVY = 1 << 20  # shingles of such rows
MAP_BITS = 26  # of the bitmap of buckets
KEY_BITS = 40  # of a bucket's hash that is counted

_RANDOM = np.random.default_rng(20240229)
_MULTIPLY = (_RANDOM.integers(1, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1))
_ADD = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_WEIGHTS = _RANDOM.integers(1, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_WEIGHTS = _RANDOM.integers(1, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SEEDS = _RANDOM.integers(1, 1 << 63, BANDS, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text in UTF-8."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < SHINGLE:
        return _mixed((h * _WEIGHTS[:n]).sum(keepdims=True) + np.uint64(n))
    x = h[: n - SHINGLE + 1] * _WEIGHTS[0]
    for k in range(1, SHINGLE):
        x += h[k : n - SHINGLE + 1 + k] * _WEIGHTS[k]
    return np.unique(_mixed(x))


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the smallest hash of the set under each function."""
    low = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        best = np.minimum(best, (low[at : at + 2048, None] * _MULTIPLY + _ADD).min(0))
    return best.astype(np.uint16)


def _sign(carried: list[str]):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for text in batch.column("_text").cast(pa.binary()).to_pylist():
                shingles = shingle_set(text)
                sizes.append(len(shingles))
                keys.append(set_key(shingles) if len(shingles) else None)
                sigs.append(signature(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carried], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], [*carried, "n", "_key", "_sig"])

    return sign


def buckets(sigs: list[bytes]) -> np.ndarray:
    """One row per signature with the hash of its values in every band."""
    sig = np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
    return _mixed((sig * _BAND_WEIGHTS).sum(2) + _BAND_SEEDS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of every bucket with one of the class that is in it."""
    for batch in batches:
        held = buckets(batch.column("_sig").to_pylist()) & np.uint64((1 << KEY_BITS) - 1)
        classes = np.frombuffer(b"".join(k[:6] + b"\0\0" for k in batch.column("_key").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held.ravel().astype(np.int64)), pa.array(np.repeat(classes, BANDS))], ["_bucket", "_class"])


def _sharing(bitmap: np.ndarray):
    """Rows that have a bucket of the bitmap, with those buckets."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = buckets(batch.column("_sig").to_pylist())
            shared = known(bitmap, held)
            some = np.flatnonzero(shared.any(1))
            lists = [held[i, shared[i]].view(np.int64) for i in some]
            bands = [np.flatnonzero(shared[i]).astype(np.int32) for i in some]
            yield pa.RecordBatch.from_arrays(
                [*batch.take(pa.array(some)).columns, pa.array(lists, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int32()))], [*batch.schema.names, "_buckets", "_bands"])

    return share


def fewest_matches(threshold: int = THRESHOLD, miss: float = MISS, total: int = BANDS * ROWS, batch: int = BATCH) -> dict[int, int]:
    """For each look, the fewest equal minima with which a pair goes on.

    With a uniform prior, P(similarity >= t | m of n) is P(Binomial(n + 1, t) <= m).
    """
    t, out = threshold / 100, {}
    for n in range(batch, total + 1, batch):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def _pruned(looks: dict[int, int]):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("_sig_a", "_sig_b"))
            alive, equal, at = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, fewest in looks.items():
                equal = equal + (a[alive, at:n] == b[alive, at:n]).sum(1)
                going = equal >= fewest
                alive, equal, at = alive[going], equal[going], n
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return prune


def _checked_set(text: str, key: bytes) -> np.ndarray:
    """The set of a text, which must be that of the first reading."""
    shingles = shingle_set(text.encode())
    if set_key(shingles) != key:
        raise ValueError("the documents changed between two readings; write them as a table first")
    return shingles


def _similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= threshold * (len(x) + len(y) - common)


def _verified(threshold: int):
    """Rows of a leader and its members, the leader first, to the pairs that are similar."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, shingles = None, None
        for batch in batches:
            keep = []
            for i, (a, b, key, text) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("a", "b", "_key", "_text")), strict=True)):
                if a == b:
                    leader, shingles = a, _checked_set(text, key)
                elif a != leader:
                    raise ValueError("a member without its leader")
                elif _similar(shingles, _checked_set(text, key), threshold):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return verify


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of a partition sorted by a key, cut between keys only, a few thousand rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        if not len(keys):
            continue
        first_of_last = int(np.searchsorted(keys, keys[-1]))
        if first_of_last or (held and held[-1].column(key)[-1].as_py() != keys[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, first_of_last)])
            held = []
        held.append(batch.slice(first_of_last))
    if held:
        yield pa.Table.from_batches(held)


def _compared(looks: dict[int, int], threshold: int):
    """Groups of rows that share a band, to the pairs of them that stay possible, one row per group.

    A pair that shares several bands is taken up in the first of them only.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "_group"):
            col = {n: table.column(n).to_numpy() for n in ("_group", "_band", "_row", "n", "comp", "_side")}
            sig = np.frombuffer(b"".join(table.column("_sig").to_pylist()), np.uint16).reshape(len(table), -1)
            edges = np.flatnonzero(np.r_[True, col["_group"][1:] != col["_group"][:-1], True])
            out = {n: [] for n in ("rows", "comps", "i", "j")}
            for at, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                pairs = [p for k in range(at, end - 1) if len(p := _possible(col, sig, k, end, looks, threshold))]
                if not pairs:
                    continue
                left, right = np.concatenate(pairs).T
                used, places = np.unique(np.r_[left, right], return_inverse=True)
                out["rows"].append(col["_row"][used])
                out["comps"].append(col["comp"][used])
                out["i"].append(places[: len(left)])
                out["j"].append(places[len(left) :])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["rows"], pa.list_(pa.int64())), pa.array(out["comps"], pa.list_(pa.int64())), pa.array(out["i"], pa.list_(pa.int32())), pa.array(out["j"], pa.list_(pa.int32()))],
                ["rows", "comps", "i", "j"])

    return compare


def _possible(col: dict, sig: np.ndarray, k: int, end: int, looks: dict[int, int], threshold: int) -> np.ndarray:
    """Pairs of row k with later rows of its group that no look at the posterior rules out."""
    other = np.arange(k + 1, end)
    n, m = col["n"][k], col["n"][other]
    fit = (col["comp"][other] != col["comp"][k]) & (100 * np.minimum(n, m) >= threshold * np.maximum(n, m))
    fit &= (col["_side"][other] < 0) | (col["_side"][other] != col["_side"][k])
    other, equal, at = other[fit], 0, 0
    for upto, fewest in looks.items():
        equal = equal + (sig[other, at:upto] == sig[k, at:upto]).sum(1)
        going = equal >= fewest
        other, equal, at = other[going], equal[going], upto
    if len(other):
        same = (sig[other] == sig[k]).reshape(len(other), BANDS, ROWS).all(2)
        other = other[same.argmax(1) == col["_band"][k]]
    return np.stack([np.full(len(other), k), other], 1)


def _joined_up(threshold: int):
    """Links that join components, among the possible pairs of each group; pairs already joined are not checked."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for g in batch.to_pylist():
                texts = {t["_pos"]: t for t in g["_texts"]}
                sets: dict[int, np.ndarray] = {}

                def shingles(k, texts=texts, sets=sets):
                    if k not in sets:
                        sets[k] = _checked_set(texts[k]["_text"], texts[k]["_key"])
                    return sets[k]

                up = {c: c for c in g["comps"]}

                def top(c, up=up):
                    while up[c] != c:
                        c = up[c]
                    return c

                for i, j in zip(g["i"], g["j"], strict=True):
                    x, y = top(g["comps"][i]), top(g["comps"][j])
                    if x != y and _similar(shingles(i), shingles(j), threshold):
                        up[max(x, y)] = min(x, y)
                        a.append(g["rows"][i])
                        b.append(g["rows"][j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return join


def _similar_size(n: Column, m: Column, threshold: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(n, m) >= threshold * F.greatest(n, m)


def _leader_pairs(bands: DataFrame, threshold: int) -> DataFrame:
    """Distinct (a, b, fit), a < b: members with the leader of their part, and those leaders with their bucket's.

    Every row that shares a bucket is in a pair; ``fit`` tells whether the sizes allow a link.
    """
    part = F.pmod(F.xxhash64("_row"), F.lit(PARTS)).cast("int")
    own = F.struct("_row", "n")
    rows = bands.withColumn("_lead", F.first(own).over(Window.partitionBy("_bucket", part).orderBy("_row")))
    heads = rows.where(F.col("_row") == F.col("_lead._row")).withColumn("_lead", F.first(own).over(Window.partitionBy("_bucket").orderBy("_row")))
    met = rows.unionByName(heads).where(F.col("_row") != F.col("_lead._row"))
    fit = _similar_size(F.col("n"), F.col("_lead.n"), threshold)
    return met.select(F.col("_lead._row").alias("a"), F.col("_row").alias("b"), fit.alias("fit")).distinct()


def _survivors(pairs: DataFrame, signed: DataFrame, looks: dict[int, int]) -> DataFrame:
    sig = signed.select("_row", "_sig")
    both = pairs.join(sig.withColumnsRenamed({"_row": "a", "_sig": "_sig_a"}), "a").join(sig.withColumnsRenamed({"_row": "b", "_sig": "_sig_b"}), "b")
    return checkpointed(both.select("a", "b", "_sig_a", "_sig_b").mapInArrow(_pruned(looks), "a long, b long"))


def _links(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that are similar; a leader's text travels once to each part of its members."""
    part = F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int")
    members = pairs.select("a", "b", part.alias("_part"))
    leaders = members.select("a", F.col("a").alias("b"), "_part").distinct()
    met = members.unionByName(leaders).join(texts.withColumnRenamed("_row", "b"), "b")
    met = met.repartition("a", "_part").sortWithinPartitions("a", "_part", F.col("a") != F.col("b"))
    return checkpointed(met.select("a", "b", "_key", "_text").mapInArrow(_verified(threshold), "a long, b long"))


def _groups(bands: DataFrame) -> DataFrame:
    """``_group, _side, _band, _row``: the rows that share a bucket across components, dealt to groups that compare them.

    In a bucket the largest component's rows are cut into blocks, and so are the
    others.  Every block of others meets every block of the largest component
    (sides 0 and 1), itself (side -1, with the first of those) and every other
    block of others.  Rows of one side are not compared, but for side -1.
    """
    weight = F.sum(F.lit(HEAVY // BLOCK) + F.least(F.col("n"), F.lit(HEAVY)))
    sizes = bands.groupBy("_bucket", "comp").agg(weight.alias("_w"))
    main = sizes.groupBy("_bucket").agg(F.max(F.struct("_w", "comp")).alias("_m"), F.sum("_w").alias("_all")).where(F.col("_all") > F.col("_m._w"))

    def cut(weight):
        return F.greatest(F.lit(1), F.ceil(weight / HEAVY)).cast("int")

    main = main.select("_bucket", F.col("_m.comp").alias("_main"), cut(F.col("_m._w")).alias("_mains"), cut(F.col("_all") - F.col("_m._w")).alias("_others"))
    rows = bands.join(main, "_bucket").withColumn("_own", F.col("comp") == F.col("_main"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_row"), F.when(F.col("_own"), F.col("_mains")).otherwise(F.col("_others"))).cast("int"))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), F.when(F.col("_own"), F.col("_others")).otherwise(F.col("_mains")) - 1)))
    across = rows.select(
        F.xxhash64("_bucket", F.when(F.col("_own"), F.col("_block")).otherwise(F.col("_with")), F.when(F.col("_own"), F.col("_with")).otherwise(F.col("_block"))).alias("_group"),
        F.when(F.col("_own"), 0).when(F.col("_with") == 0, -1).otherwise(1).alias("_side"), "_band", "_row")
    others = bands.join(main.where("_others > 1"), "_bucket").where(F.col("comp") != F.col("_main"))
    others = others.withColumn("_block", F.pmod(F.xxhash64("_row"), F.col("_others")).cast("int"))
    others = others.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_others") - 1))).where(F.col("_with") != F.col("_block"))
    between = others.select(
        F.xxhash64("_bucket", F.least("_block", "_with"), F.greatest("_block", "_with"), F.lit("others")).alias("_group"), F.col("_block").alias("_side"), "_band", "_row")
    return across.unionByName(between)


def _links_across(labelled: DataFrame, bands: DataFrame, texts: DataFrame, looks: dict[int, int], threshold: int) -> DataFrame:
    """Links between components among all rows that share a bucket."""
    rows = _groups(bands.join(labelled.select("_row", "comp"), "_row"))
    # sizes, components and signatures join what is left only
    rows = rows.join(labelled.select("_row", "n", "comp", "_sig"), "_row").repartition("_group").sortWithinPartitions("_group")
    groups = rows.mapInArrow(_compared(looks, threshold), "rows array<long>, comps array<long>, i array<int>, j array<int>")
    groups = checkpointed(groups.withColumn("_g", F.monotonically_increasing_id()))
    legs = groups.select("_g", F.posexplode("rows").alias("_pos", "_row")).join(texts, "_row")
    held = legs.groupBy("_g").agg(F.collect_list(F.struct("_pos", "_key", "_text")).alias("_texts"))  # two blocks at most
    return checkpointed(groups.join(held, "_g").mapInArrow(_joined_up(threshold), "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """``_row, comp``: the smallest row of the component, for every row that has a link (a, b)."""
    now = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).collect()[0]
        if state == seen:
            return now.select(F.col("u").alias("_row"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("_row"), F.col("v").alias("comp")).distinct())
        seen = state
        # every larger neighbour of u meets the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every smaller neighbour of u, and u itself, meets the smallest of them
        large = checkpointed(large.where("u <> v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        now = checkpointed(small.distinct())


def _content(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2")]


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), threshold: int = THRESHOLD, miss: float = MISS,
) -> DataFrame:
    """``<id_col>, n_shingles, component_id, kept, first_row`` and the ``carry`` columns for every document.

    ``kept`` holds for the component's smallest id, ``first_row`` for one of its rows.
    """
    looks = fewest_matches(threshold, miss)
    text, names = F.col(text_col), [f"_c{i}" for i in range(len(carry))]
    source = docs.select(text.alias("_text"), F.col(id_col).alias("_id"), *_content(text), *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)])
    carried = ["_id", "_h1", "_h2", *names]
    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in carried)
    signed = source.mapInArrow(_sign(carried), f"{kinds}, n long, _key binary, _sig binary")
    signed = checkpointed(signed.withColumn("_row", F.monotonically_increasing_id()))
    worded = signed.where(F.col("_key").isNotNull())
    classes = checkpointed(worded.groupBy("_key").agg(F.min("_row").alias("_rep")))

    # rows that share a bucket with another class, one of each class
    held = worded.select("_key", "_sig").mapInArrow(_counted, "_bucket long, _class long").groupBy("_bucket").agg(F.min("_class").alias("_lo"), F.max("_class").alias("_hi"))
    bitmap = gathered(held.where("_lo < _hi"), "_bucket", MAP_BITS)
    kept = "_row long, n long, _key binary, _sig binary, _h1 long, _h2 long"
    sharing = worded.select("_row", "n", "_key", "_sig", "_h1", "_h2").mapInArrow(_sharing(bitmap), f"{kept}, _buckets array<long>, _bands array<int>")
    chosen = checkpointed(sharing.join(classes.select(F.col("_rep").alias("_row")), "_row", "left_semi"))
    bands = chosen.select("_row", "n", F.inline(F.arrays_zip(F.col("_buckets").alias("_bucket"), F.col("_bands").alias("_band"))))
    met = checkpointed(_leader_pairs(bands, threshold))
    # a leader of another size must not keep a row from the other rows of its bucket
    active = checkpointed(met.select(F.explode(F.array("a", "b")).alias("_row")).distinct().join(chosen, "_row"))
    texts = _texts_of(active, docs.select(text.alias("_text"), *_content(text)))

    links = _links(_survivors(met.where("fit").select("a", "b"), active, looks), texts, threshold)
    labelled = active.select("_row", "n", "_sig").join(components(links), "_row", "left")
    labelled = checkpointed(labelled.withColumn("comp", F.coalesce("comp", "_row")))
    comps = checkpointed(components(links.unionByName(_links_across(labelled, bands, texts, looks, threshold))))

    # rows to classes to components, and the smallest id back to every row
    reps = classes.join(comps.withColumnRenamed("_row", "_rep"), "_rep", "left").select("_key", F.coalesce("comp", "_rep").alias("_comp"))
    rows = checkpointed(signed.select("_id", "n", "_key", "_row", *names).join(reps, "_key", "left").withColumn("_comp", F.coalesce("_comp", "_row")).drop("_key"))
    low = rows.groupBy("_comp").agg(F.min("_id").alias("component_id"), F.min(F.struct(F.col("_id").isNull(), "_id", "_row"))["_row"].alias("_first"))
    return rows.join(low, "_comp").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"),
        (F.col("_row") == F.col("_first")).alias("first_row"), *[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)])


def _texts_of(rows: DataFrame, source: DataFrame) -> DataFrame:
    """``_row, _key, _text`` of the rows, found among all texts by their content."""
    wanted = rows.select("_row", "_key", "_h1", "_h2")
    found = marked(source, wanted, "_h1", "_maybe").where("_maybe").drop("_maybe")
    # copies of a text are one before they travel
    one = found.groupBy("_h1", "_h2").agg(F.first("_text").alias("_text"))
    lost = F.raise_error(F.lit("the documents changed between two readings; write them as a table first")).cast("string")
    return checkpointed(wanted.join(one, ["_h1", "_h2"], "left").select("_row", "_key", F.coalesce("_text", lost).alias("_text")))
