"""SimHash near-dedup: tiled exact comparison of fingerprints by exclusive-or and bit counts.

Fingerprints are dealt into cells by the population counts of equal slices; two cells are compared
only if their counts can lie within the radius (a pair differs in at least as many bits as its counts
do), so no link is lost. Cells are cut into tiles of bounded size; a pair of tiles is one numpy
exclusive-or, and gives its linked members' local components as stars, never all pairs of a group.

Defined cases: a null or empty text, or one of white space, has no words and fingerprint zero, linked
like any other; a text with fewer words than a shingle is one shingle; repeated rows and equal texts
share a fingerprint; a null doc_id counts as the smallest; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import attach, durable, let_go, mixed, null_ids, whole_id

TILE = 2048


def _grams(text: str | None, shingle: int) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= shingle:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))


def fingerprint(text: str | None, shingle: int = 3, seeds: tuple[int, ...] = (42,)) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The 64-bit fingerprints of a text, one for each hash seed (a bit is set if over half the
    shingles' hashes have it), and the least hash of each seed."""
    grams = _grams(text, shingle)
    if not grams:
        return (0,) * len(seeds), (0,) * len(seeds)
    out, least = [], []
    for seed in seeds:
        digests = [xxhash.xxh64_digest(g, seed) for g in grams]
        raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
        least.append(int.from_bytes(min(digests), "big"))
        counts = np.zeros(64, np.int64)
        for at in range(0, len(raw), 1 << 16):
            counts += np.unpackbits(raw[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(counts * 2 > len(grams)).tobytes(), "big"))
    return tuple(out), tuple(least)


def fingerprints(docs: DataFrame, shingle: int = 3, seeds: tuple[int, ...] = (42,), text_col: str = "text") -> DataFrame:
    """doc_id and two arrays of one signed 64-bit number for each seed: fp and least, the least hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            found = [np.array(fingerprint(t, shingle, seeds), np.uint64).view(np.int64) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": [x[0] for x in found], "least": [x[1] for x in found]})

    return docs.select(whole_id(), F.col(text_col).alias("text")).mapInPandas(run, "doc_id bigint, fp array<bigint>, least array<bigint>")


def _cell(slices: int, width: int, words: int) -> Column:
    """Population counts of the slices, each in steps of `width`, as one array."""
    if slices == 1:
        total = sum((F.bit_count(F.col("fp")[k]) for k in range(words)), F.lit(0))
        return F.array(F.floor(total / width).cast("int"))
    bits = 64 // slices
    mask = (1 << bits) - 1
    return F.array(*[F.bit_count(F.shiftrightunsigned(F.col("fp")[0], bits * k).bitwiseAND(F.lit(mask).cast("bigint"))).cast("int") for k in range(slices)])


def _offsets(slices: int, width: int, radius: int) -> list[tuple[int, ...]]:
    """Half of the neighbouring cells that can hold a link, the cell itself first."""
    least = lambda d: max(0, (abs(d) - 1) * width + 1) if d else 0
    reach = (radius - 1) // width + 1
    near = [v for v in itertools.product(range(-reach, reach + 1), repeat=slices) if sum(map(least, v)) <= radius]
    return sorted(v for v in near if v >= (0,) * slices)


def tile_stars(a: np.ndarray, b: np.ndarray | None, a_ids: np.ndarray, b_ids: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Stars (member, least member) of the components that links between two tiles make; b None: within a.

    a, b: fingerprints, a row each, all different; the first word alone settles most pairs."""
    same = b is None
    b, b_ids = (a, a_ids) if same else (b, b_ids)
    far = np.bitwise_count(a[:, 0][:, None] ^ b[:, 0][None, :])
    for k in range(1, a.shape[1]):
        far = np.add(far, np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :]), dtype=np.uint16)
    near = far <= radius
    if same:
        np.fill_diagonal(near, False)
    rows, cols = near.any(axis=1), near.any(axis=0)
    if not rows.any():
        return []
    out, left = [], rows.copy()
    while left.any():
        start = int(np.argmax(left))
        in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        in_a[start], fresh = True, np.array([start])
        while len(fresh):
            reached = near[fresh].any(axis=0) & ~in_b
            in_b |= reached
            back = near[:, reached].any(axis=1) & ~in_a if reached.any() else np.zeros(len(a), bool)
            if same:
                back |= reached & ~in_a
            in_a |= back
            fresh = np.flatnonzero(back)
        left &= ~in_a
        members = np.concatenate([a_ids[in_a], b_ids[in_b]])
        root = int(members.min())
        out += [(int(m), root) for m in set(members.tolist()) if m != root]
    return out


def links(reps: DataFrame, radius: int, words: int, slices: int = 4, width: int = 1, by_least: bool = False) -> DataFrame:
    """Stars (u, v) over reps(rep, fp) or, by_least, reps(rep, fp, least).

    by_least: cells are the least shingle hashes instead. Texts of similarity s share
    one of n of them but for a chance of (1 - s) ** n; this spares most pairs where the radius is wide."""
    if by_least:
        placed = reps.select("rep", "fp", F.posexplode("least").alias("k", "hash")).withColumn("cell", F.array(F.col("k").cast("bigint"), "hash"))
        counted = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        offsets = [(0, 0)]
    else:
        placed = reps.withColumn("cell", _cell(slices, width, words))
        counted = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        offsets = _offsets(slices, width, radius)
    cells = counted.select("cell", F.ceil(F.col("n") / TILE).cast("int").alias("n_tiles"))
    dealt = placed.join(cells, "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("n_tiles")).cast("int"))
    packed = F.transform(F.col("held"), lambda x: x["fp"])
    tiles = dealt.groupBy("cell", "tile").agg(F.collect_list(F.struct("rep", "fp")).alias("held"))
    tiles = durable(tiles.select("cell", "tile", F.transform("held", lambda x: x["rep"]).alias("ids"), F.flatten(packed).alias("fps")))
    steps = F.array(*[F.array(*[F.lit(x) for x in v]) for v in offsets])
    left = tiles.select("cell", F.col("tile").alias("a_tile"), F.col("ids").alias("a_ids"), F.col("fps").alias("a_fps"), F.explode(steps).alias("step"))
    left = left.withColumn("own", F.forall("step", lambda x: x == 0)).withColumn("cell", F.zip_with("cell", "step", lambda x, y: x + y)).drop("step")
    right = tiles.select("cell", F.col("tile").alias("b_tile"), F.col("ids").alias("b_ids"), F.col("fps").alias("b_fps"))
    pairs = left.join(right.hint("shuffle_merge"), "cell").filter("NOT own OR a_tile <= b_tile")
    same = F.col("own") & (F.col("a_tile") == F.col("b_tile"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            out = []
            for same, a_ids, a_fps, b_ids, b_fps in zip(*(batch[c] for c in ("same", "a_ids", "a_fps", "b_ids", "b_fps"))):
                a = np.asarray(a_fps).view(np.uint64).reshape(-1, words)
                if same and len(a) == 1:
                    continue
                b = None if same else np.asarray(b_fps).view(np.uint64).reshape(-1, words)
                out += tile_stars(a, b, np.asarray(a_ids), None if same else np.asarray(b_ids), radius)
            yield pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return pairs.select(same.alias("same"), "a_ids", "a_fps", F.when(~same, F.col("b_ids")).alias("b_ids"), F.when(~same, F.col("b_fps")).alias("b_fps")).mapInPandas(
        compare, "u bigint, v bigint"
    )


def _groups(
    docs: DataFrame,
    shingle: int = 3,
    radius: int = 2,
    seeds: tuple[int, ...] = (42,),
    slices: int = 4,
    width: int = 1,
    text_col: str = "text",
) -> DataFrame:
    found = durable(fingerprints(docs, shingle, seeds, text_col))
    reps = durable(found.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(reps, radius, len(seeds), slices, width))
    named = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return attach(found.select("doc_id", "fp"), durable(named), "fp").select("doc_id", "fp", "component_id")


def near_groups(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, fp (array of signed words) and component_id, the smallest doc_id that links reach."""
    return null_ids(_groups(docs, **settings), "doc_id", "component_id")


def shingle_set(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The hashes of a text's different shingles, in order."""
    digests = b"".join(xxhash.xxh64_digest(g, seed) for g in set(_grams(text, shingle)))
    return np.unique(np.frombuffer(digests, ">u8").astype(np.uint64))


def set_hash(held: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(held.tobytes()) - (1 << 63)


def sketch(text: str | None, shingle: int, seeds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of a text's set of shingles the fingerprints, two least hashes a seed, its size and its hash."""
    grams = list(set(_grams(text, shingle)))
    fp, least, held = np.zeros(len(seeds), np.uint64), np.zeros(2 * len(seeds), np.uint64), np.empty(0, np.uint64)
    for k, seed in enumerate(seeds if grams else ()):
        raw = np.frombuffer(b"".join(xxhash.xxh64_digest(g, seed) for g in grams), np.uint8).reshape(-1, 8)
        hashes = raw.reshape(-1).view(">u8").astype(np.uint64)
        counts = np.zeros(64, np.int64)
        for at in range(0, len(raw), 1 << 16):
            counts += np.unpackbits(raw[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
        fp[k] = int.from_bytes(np.packbits(counts * 2 > len(grams)).tobytes(), "big")
        least[2 * k], least[2 * k + 1] = hashes.min(), mixed(hashes).min()
        held = np.unique(hashes) if k == 0 else held
    return fp.view(np.int64), least.view(np.int64), len(held), set_hash(held)


def verified_stars(ids: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], n_left: int, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Stars (member, least member) of the links whose sets have the Jaccard similarity. The first n_left
    are met with the others, or with each other if they are all; pairs already connected are spared."""
    sizes = np.array([len(x) for x in sets])
    right = slice(0, None) if n_left == len(ids) else slice(n_left, None)
    a, b = fps[:n_left], fps[right]
    far = sum(np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :]).astype(np.uint16) for k in range(fps.shape[1]))
    small, large = np.minimum(sizes[:n_left, None], sizes[right][None, :]), np.maximum(sizes[:n_left, None], sizes[right][None, :])
    near = (far <= radius) & (small >= similarity * large - 1e-9)
    if n_left == len(ids):
        near = np.triu(near, 1)
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    shift = right.start
    for i, j in np.argwhere(near).tolist():
        u, v = root(i), root(j + shift)
        if u != v:
            x, y = sets[i], sets[j + shift]
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common >= similarity * (len(x) + len(y) - common) - 1e-9:
                parent[v] = u
    least: dict[int, int] = {}
    for n in range(len(ids)):
        r = root(n)
        least[r] = min(least.get(r, int(ids[n])), int(ids[n]))
    return [(int(ids[n]), least[root(n)]) for n in range(len(ids)) if int(ids[n]) != least[root(n)]]


#: At most so many texts and, but for a single larger text, about so many shingles to a tile of sets.
SET_ROWS, SET_SHINGLES = 512, 1 << 14


_PARTS = ("ids", "fps", "sizes", "grams")


def _packed(dealt: DataFrame, *keys: str) -> DataFrame:
    """dealt(rep, fp, size, grams) gathered by the keys, each part as one array."""
    held = dealt.groupBy(*keys).agg(F.collect_list(F.struct("rep", "fp", "size", "grams")).alias("held"))
    pick = lambda name: F.transform("held", lambda x: x[name])
    return held.select(*keys, pick("rep").alias("ids"), F.flatten(pick("fp")).alias("fps"), pick("size").alias("sizes"), F.flatten(pick("grams")).alias("grams"))


def _compared(pairs: DataFrame, words: int, radius: int, similarity: float) -> DataFrame:
    """Stars (u, v) of pairs(same, a_..., b_...); if same, a is met with itself."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                sides = [(row.a_ids, row.a_fps, row.a_sizes, row.a_grams)] + ([] if row.same else [(row.b_ids, row.b_fps, row.b_sizes, row.b_grams)])
                if row.same and len(row.a_ids) == 1:
                    continue
                ids = np.concatenate([x[0] for x in sides])
                fps = np.concatenate([x[1] for x in sides]).view(np.uint64).reshape(-1, words)
                sets = [y for x in sides for y in np.split(np.asarray(x[3]), np.cumsum(x[2])[:-1])]
                out += verified_stars(ids, fps, sets, len(row.a_ids), radius, similarity)
            yield pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    columns = ["same", *[f"a_{c}" for c in _PARTS], *[F.when(~F.col("same"), F.col(f"b_{c}")).alias(f"b_{c}") for c in _PARTS]]
    return pairs.select(*columns).mapInPandas(compare, "u bigint, v bigint")


def verified_links(members: DataFrame, words: int, radius: int, similarity: float) -> DataFrame:
    """Stars (u, v) over members(rep, fp, least, size, grams, root, small): of the pairs that share a least
    hash, and of all pairs of a small group of candidates, those whose sets have the similarity."""
    few = _packed(members.filter("small"), "root")
    alone = few.select(F.lit(True).alias("same"), *[F.col(c).alias(f"a_{c}") for c in _PARTS], *[F.col(c).alias(f"b_{c}") for c in _PARTS])
    members = members.filter("NOT small")
    placed = members.select("rep", "fp", "size", "grams", F.posexplode("least").alias("k", "hash")).withColumn("cell", F.array(F.col("k").cast("bigint"), "hash"))
    # Counted without the sets.
    slim = members.select("size", F.posexplode("least").alias("k", "hash")).withColumn("cell", F.array(F.col("k").cast("bigint"), "hash"))
    counted = slim.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).filter("n > 1")
    cells = counted.select("cell", F.greatest(F.ceil(F.col("n") / SET_ROWS), F.ceil(F.col("total") / SET_SHINGLES)).cast("int").alias("n_tiles"))
    dealt = placed.join(cells, "cell").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("n_tiles")).cast("int"))
    tiles = durable(_packed(dealt, "cell", "tile"))
    left = tiles.select("cell", F.col("tile").alias("a_tile"), *[F.col(c).alias(f"a_{c}") for c in _PARTS])
    right = tiles.select("cell", F.col("tile").alias("b_tile"), *[F.col(c).alias(f"b_{c}") for c in _PARTS])
    pairs = left.join(right.hint("shuffle_merge"), "cell").filter("a_tile <= b_tile").withColumn("same", F.col("a_tile") == F.col("b_tile"))
    return _compared(alone, words, radius, similarity).unionByName(_compared(pairs, words, radius, similarity))


def _similar_groups(docs: DataFrame, similarity: float, shingle: int, radius: int, seeds: tuple[int, ...], text_col: str = "text") -> DataFrame:
    """doc_id and component_id by links of texts whose sets of shingles have the Jaccard similarity.

    Candidates share one of two least hashes a seed, which two texts of similarity s miss with a chance of
    (1 - s) ** (2 * seeds), and lie within a wide radius; every link is verified on the sets."""
    texts = docs.select(whole_id(), F.col(text_col).alias("text"))

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            found = [sketch(t, shingle, seeds) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"]} | {name: [x[k] for x in found] for k, name in enumerate(("fp", "least", "size", "same"))})

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch["text"]]
            own = np.array([set_hash(x) for x in sets], np.int64) == batch["same"].to_numpy(np.int64)
            yield batch.drop(columns=["text", "same"]).assign(grams=[x.view(np.int64) for x in sets])[own]

    found = durable(texts.mapInPandas(sketched, "doc_id bigint, fp array<bigint>, least array<bigint>, size int, same bigint"))
    # Equal sets are one node, so that a large group of copies is met once.
    reps = durable(found.groupBy("same").agg(F.min("doc_id").alias("rep"), *[F.min(c).alias(c) for c in ("fp", "least", "size")]).filter("size > 0"))
    near = components(links(reps, radius, len(seeds), by_least=True))
    nodes = near.select(F.col("node").alias("rep"), "root").unionByName(near.select(F.col("root").alias("rep"), "root").distinct())
    nodes = durable(reps.join(nodes, "rep"))
    small = (F.count(F.lit(1)) <= 2) | (F.count(F.lit(1)) <= SET_ROWS) & (F.sum("size") <= SET_SHINGLES)
    wanted = durable(nodes.join(nodes.groupBy("root").agg(small.alias("small")), "root").withColumnRenamed("rep", "doc_id"))
    kept = "doc_id as rep", "fp", "least", "size", "root", "small", "same", "text"
    schema = "rep bigint, fp array<bigint>, least array<bigint>, size int, root bigint, small boolean, grams array<bigint>"
    members = durable(attach(texts, wanted, "doc_id").filter("same IS NOT NULL").selectExpr(*kept).mapInPandas(gathered, schema))
    roots = components(verified_links(members, len(seeds), radius, similarity))
    firsts = found.groupBy("same").agg(F.min("doc_id").alias("rep"))
    named = firsts.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("same", F.coalesce("root", "rep").alias("component_id"))
    return attach(found.select("doc_id", "same"), durable(named), "same").select("doc_id", "component_id")


def surplus(docs: DataFrame, similarity: float | None = None, **settings) -> DataFrame:
    """doc_id of all but the first document of each group; by verified similarity if one is given."""
    groups = _groups(docs, **settings) if similarity is None else _similar_groups(docs, similarity, **settings)
    return groups.filter("doc_id <> component_id").select("doc_id")


#: Near copies by sets of five-word shingles at a Jaccard similarity of 0.8 or more. Two such sets'
#: fingerprints of 256 bits differ in 39 bits on average (the angle of a cosine of 2s / (1 + s)), with a
#: deviation of 6, so the radius spares comparisons and decides nothing.
SIMILAR = {"similarity": 0.8, "shingle": 5, "radius": 80, "seeds": (42, 43, 44, 45)}


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
