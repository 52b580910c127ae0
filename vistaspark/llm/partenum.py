"""N-gram Jaccard join by PartEnum signatures.

Two shingle sets with Jaccard similarity ``>= t`` differ in at most
``(1 - t) / (1 + t) * (|a| + |b|)`` shingles. Sizes are cut into bands so that similar sets
lie in the same or in neighbouring bands; each set takes part in the instance of its own
band and in that of the next. An instance with most difference ``d`` splits the domain of
shingles by hash into ``d // 2 + 1`` parts of three subparts. In some part two similar sets
differ in at most one place, so they agree on two of its three subparts: each subset of two
gives a signature, and similar sets share one. Where the two subparts of a subset are empty,
unlike sets would share it too; but the third then differs in one shingle at most, so its
content, whole and without each one of its shingles, gives the signatures instead.

Copies (equal sets) are one class from the start. A shingle that one class alone has counts
against every pair of it: a class with more than ``1 - t`` of such shingles is linked with
nothing, and the others sign only what they share (``shared``). That leaves out all but the
near-copies and what is made of common passages, so a signature seldom joins unlike sets.

Classes that share signatures, over any path, form a cluster, and within it those that share
rare shingles (a prefix filter, the exact second key). It is not expanded into pairs: its
classes are dealt to blocks, a task merges what is linked within a block and with a few
pivots that stand in all blocks, and what is then still apart from the cluster's largest
component is compared with the whole cluster, block by block. Before two sets are compared,
the parities of their shingle counts in cells must leave the pair open: those differ in no
more cells than the sets do in shingles, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.llm.common import discard, materialise, small_side, text_of, tidy
from vistaspark.llm.components import connected_components
from vistaspark.llm.shared import class_of, shared_counts, shared_shingles
from vistaspark.llm.shingles import distinct, mix, shingle_set, texts_of

SUBSETS = ((0, 1), (0, 2), (1, 2))


def band_tops(size: int, num: int, den: int) -> list[int]:
    """Upper ends of the size bands up to the one that holds ``size``; each begins after the last."""
    tops, low = [], 1
    while not tops or tops[-1] < size:
        tops.append(low * den // num)
        low = tops[-1] + 1
    return tops


def signatures(shingles: np.ndarray, num: int, den: int, size: int | None = None) -> np.ndarray:
    """The set's signatures in the instances of its band and of the next one.

    ``size``: that of the whole set, where ``shingles`` are only those it shares.
    """
    size = len(shingles) if size is None else size
    if not size:
        return np.empty(0, np.uint64)
    tops, out = band_tops(size, num, den), []
    own = len(tops)
    tops.append((tops[-1] + 1) * den // num)
    for instance in (own, own + 1):
        most = 2 * tops[instance - 1] * (den - num) // (den + num)
        parts = most // 2 + 1
        spread = mix(shingles ^ np.uint64(instance * 0x9E3779B1))
        place = ((spread >> np.uint64(33)) * np.uint64(3 * parts)) >> np.uint64(31)
        # the content of a subpart is the sum of its shingles' hashes, its count in the mix
        place, own_hash = place.astype(np.int64), mix(spread + np.uint64(1))
        sums = np.zeros(3 * parts, np.uint64)
        np.add.at(sums, place, own_hash)
        content = mix(sums.reshape(parts, 3))
        counts = np.bincount(place, minlength=3 * parts).reshape(parts, 3)
        label = np.arange(parts, dtype=np.uint64) * np.uint64(8) + np.uint64(instance << 40)
        for k, (i, j) in enumerate(SUBSETS):
            bare = (counts[:, i] == 0) & (counts[:, j] == 0)
            out.append(mix(content[:, i] * np.uint64(3) ^ mix(content[:, j] + label + np.uint64(k)))[~bare])
            if bare.any():
                # nothing to agree on but the third subpart, which differs in one shingle at most
                third = np.arange(parts) * 3 + (3 - i - j)
                rest = np.zeros(3 * parts, np.uint64)
                rest[third] = label + np.uint64(4 + k)
                gone = np.isin(place, third[bare])
                out.append(mix(sums[third[bare]] ^ mix(rest[third[bare]])))
                out.append(mix((sums[place[gone]] - own_hash[gone]) ^ mix(rest[place[gone]])))
    return np.concatenate(out)


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in texts_of(batch.column(1)):
                s = shingle_set(data, k)
                rows.append((len(s), *class_of(s)))
            columns = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in columns]], ["doc_id", "n_shingles", "class", "class2"])

    return run


def _sets_of(column: pa.Array) -> list[np.ndarray]:
    values = column.values.to_numpy().view(np.uint64)
    return [values[a:b] for a, b in zip(column.offsets[:-1].to_numpy(), column.offsets[1:].to_numpy(), strict=True)]


def _sign(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [distinct(signatures(s, num, den, n)).view(np.int64) for n, s in zip(batch.column(1).to_pylist(), _sets_of(batch.column(2)), strict=True)]
            offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            values = np.concatenate(lists) if lists else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["class", "signatures"])

    return run


LEAST_CELLS = 512


def _parities(shingles: np.ndarray, cells: int) -> np.ndarray:
    """Those of the counts of shingles in cells, a bit each. Sets differ in at least as many shingles as parities."""
    place = (mix(shingles + np.uint64(11)) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=cells) & 1).astype(np.uint8)).view(np.uint64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The parities over fewer cells."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def merging_links(sizes: np.ndarray, sets: list[np.ndarray], roots: np.ndarray, left: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of places whose links merge components; with them, all links between a set of ``left`` and any other are within components.

    ``sizes``: of the whole sets; ``sets``: the shingles that others have, sorted; ``roots``:
    what is known to be linked has the same number.
    """
    order = np.argsort(sizes, kind="stable")
    n, left, root = sizes[order], left[order], np.unique(roots[order], return_inverse=True)[1]
    sets = [sets[i] for i in order]
    own = n - np.array([len(s) for s in sets])
    words = np.array([max(LEAST_CELLS, 1 << (int(x) - 1).bit_length()) // 64 for x in n])
    widths, starts = np.unique(words, return_index=True)
    ends = np.append(starts[1:], len(n))
    bits = {int(w): np.stack([_parities(s, 64 * int(w)) for s in sets[a:b]]) for w, a, b in zip(widths, starts, ends, strict=True)}
    out = []
    for i in range(1, len(n)):
        low = int(np.searchsorted(n * den, num * n[i]))
        near = low + np.flatnonzero((root[low:i] != root[i]) & (left[low:i] | left[i]))
        if not len(near):
            continue
        mine, apart = bits[int(words[i])][i - starts[np.searchsorted(widths, words[i])]], np.empty(len(near), np.int64)
        for w, a, b in zip(widths, starts, ends, strict=True):
            here = (near >= a) & (near < b)
            if here.any():
                apart[here] = np.bitwise_count(bits[int(w)][near[here] - a] ^ _folded(mine, int(w))).sum(1)
        apart += own[near] + own[i]
        still = apart * (den + num) <= (n[near] + n[i]) * (den - num)
        for j in near[still][np.argsort(apart[still], kind="stable")]:
            if root[j] != root[i]:
                small, large = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
                if not len(small):
                    continue
                shared = int(np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small))
                if den * shared >= num * int(n[i] + n[j] - shared):
                    out.append((int(order[i]), int(order[j])))
                    root[root == root[i]] = root[j]
    return out


#: Classes and shingles of a block; pivots that stand in every block of a cluster, on average.
BLOCK_CLASSES, BLOCK_SHINGLES, PIVOTS = 2048, 1 << 22, 32
GROUPED = "cluster long, part long, class long, root long, left boolean, n long, shingles array<long>"


def _merge(num: int, den: int):
    """Links of each group (cluster, part) of rows as in ``GROUPED``, which come sorted by group."""

    def links_of(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        group = pa.Table.from_batches(rows).combine_chunks()
        classes, roots, left, sizes = (group.column(c).to_numpy() for c in ("class", "root", "left", "n"))
        sets = [np.sort(s) for s in _sets_of(group.column("shingles").chunk(0))]
        found = np.array(merging_links(sizes, sets, roots, left, num, den), np.int64).reshape(-1, 2).T
        return classes[found[0]], classes[found[1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    key = tuple(keys[:, a])
                    if key != now and held:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in links_of(held)], ["a", "b"])
                        held = []
                    now = key
                    held.append(batch.slice(a, b - a))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links_of(held)], ["a", "b"])

    return run


def _merged(rows: DataFrame, num: int, den: int) -> DataFrame:
    dealt = rows.select(*[x.split()[0] for x in GROUPED.split(", ")]).repartition("cluster", "part").sortWithinPartitions("cluster", "part")
    return dealt.mapInArrow(tidy(_merge(num, den)), "a long, b long")


def _every(n: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def _joined(rows: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """node, root: which classes share keys over any path; ``rows``: class and keys.

    The rows of a key are linked with the first of their salt, and those with the key's
    first, so that a key of very many classes is no one task's.
    """
    salts = -(-classes // 100_000)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(max(1, salts))))
    first = F.min("class").over(Window.partitionBy(*keys, "salt"))
    stars = materialise(rows.withColumn("first", first).filter((F.col("class") != F.col("first")) | F.lit(salts > 1)).select(*(keys if salts > 1 else []), "class", "first").distinct(), "partenum-stars")
    edges = stars.select(F.col("class").alias("a"), F.col("first").alias("b"))
    if salts > 1:
        heads = stars.filter("class = first").select(*keys, F.col("class").alias("a"))
        edges = edges.union(heads.join(stars.groupBy(*keys).agg(F.min("first").alias("b")), keys).select("a", "b"))
    clusters = connected_components(edges)
    discard(stars)
    return clusters


def _clusters(reduced: DataFrame, num: int, den: int) -> DataFrame:
    """cluster, class, n, shingles: classes that may be linked over any path; what stands alone is left out.

    Similar sets share a signature; over any path, the classes that do are together. Within,
    similar sets share one of their rarest shingles too: of a set of n, t * n or more are in
    the other, so one of those is among the first n - t * n + 1 in any order that both keep,
    here that of how many classes of the cluster have the shingle. A shingle that one class
    alone has comes first and joins nothing, so few classes are left with a common passage.
    """
    classes = reduced.count()
    signed = reduced.select("class", "n", "shingles").mapInArrow(tidy(_sign(num, den)), "class long, signatures array<long>")
    signed = _joined(signed.select("class", F.explode("signatures").alias("signature")), ["signature"], classes)
    members = reduced.join(signed.withColumnRenamed("root", "cluster"), F.col("class") == F.col("node")).select("cluster", "class", "shingles")
    single = members.select("cluster", "class", F.explode("shingles").alias("shingle"))
    counts = single.groupBy("cluster", "shingle").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    held = single.join(counts, ["cluster", "shingle"]).groupBy("cluster", "class").agg(F.sort_array(F.collect_list(F.struct("classes", "shingle"))).alias("held"))
    first = F.size("held") - F.ceil(F.col("n") * num / den).cast("int") + 1
    rare = held.join(reduced.select("class", "n"), "class").filter(first > 0).select("cluster", "class", F.explode(F.slice("held", F.lit(1), first)).alias("x"))
    rare = _joined(rare.select("cluster", F.col("x.shingle").alias("shingle"), "class"), ["cluster", "shingle"], classes)
    return reduced.join(rare.withColumnRenamed("root", "cluster"), F.col("class") == F.col("node")).drop("node")


def _links(reduced: DataFrame, num: int, den: int) -> DataFrame:
    """node, root of all classes that are linked; ``reduced``: class, n, shingles."""
    members = _clusters(reduced, num, den)
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("count"), F.sum(F.size("shingles")).alias("total"))
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK_CLASSES), F.ceil(F.col("total") / BLOCK_SHINGLES))
    sizes = materialise(sizes.withColumn("blocks", blocks.cast("long")), "partenum-clusters")
    members = members.join(small_side(sizes), "cluster").withColumn("part", F.pmod(F.xxhash64("class"), F.col("blocks")))
    members = members.withColumn("root", F.col("class")).withColumn("left", F.lit(True))
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("class", F.lit(7)), F.ceil(F.col("count") / PIVOTS)) == 0)
    pivots = members.filter(pivot).withColumn("home", F.col("part")).withColumn("part", _every("blocks")).filter("part <> home").drop("home")
    links = materialise(_merged(members.unionByName(pivots), num, den), "partenum-links")
    roots = connected_components(links)
    if not sizes.filter("blocks > 1").head(1):
        return roots
    # in clusters of several blocks: what is not of the largest component, with everything
    known = roots.withColumnRenamed("root", "known")
    large = members.filter("blocks > 1").drop("root", "left").join(known, F.col("class") == F.col("node"), "left")
    large = large.withColumn("root", F.coalesce("known", "class")).drop("node", "known")
    counts = large.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("size"))
    most = counts.groupBy("cluster").agg(F.max(F.struct("size", "root")).alias("most"), F.sum("size").alias("all"))
    most = most.select("cluster", F.col("most.root").alias("main"), F.ceil((F.col("all") - F.col("most.size")) / BLOCK_CLASSES).cast("long").alias("minor_blocks"))
    most = materialise(most.filter("minor_blocks > 0"), "partenum-main")
    large = large.join(small_side(most), "cluster").withColumn("left", F.col("root") != F.col("main"))
    everything = large.withColumn("minor_part", _every("minor_blocks")).withColumn("left", F.lit(False))
    minors = large.filter("left").withColumn("minor_part", F.pmod(F.xxhash64("class", F.lit(3)), F.col("minor_blocks"))).withColumn("part", _every("blocks"))
    both = minors.unionByName(everything).withColumn("part", F.col("part") * F.col("minor_blocks") + F.col("minor_part"))
    more = materialise(links.union(_merged(both, num, den)), "partenum-links")
    discard(links)
    return connected_components(more)


def jaccard_components(df: DataFrame, words: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``df``.

    ``num / den``: least similarity, at least a half. A document without words (null and
    empty texts too) has an empty set and is linked with nothing; rows with equal sets are
    one class. The component's id is the smallest id in it. Of repeated ids each row has the
    component of its own text; a null id counts as no id, so such a row has a component of
    null unless its component has an id. Texts of any length are read whole. An empty table
    gives an empty result. Columns other than the two named are not read.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    described = materialise(texts.mapInArrow(tidy(_describe(words)), "doc_id long, n_shingles long, class long, class2 long"), "partenum-classes")
    classes = described.filter("n_shingles > 0").groupBy("class").agg(F.min("n_shingles").alias("n"), F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows"))
    total = described.agg(F.sum("n_shingles")).first()[0] or 0
    # a class is out when more than 1 - t of its shingles are its own
    could = lambda shared: (F.col("n") - shared) * den <= F.col("n") * (den - num)
    candidates = shared_counts(texts, words, total).join(classes, "class").filter(could(F.least("shared", "n")))
    candidates = materialise(candidates.select("class", "id", "n"), "partenum-candidates")
    kept = candidates.agg(F.count(F.lit(1)), F.sum("n")).first()
    ids = candidates.select(F.col("id").alias("candidate")).distinct()
    held = texts.join(small_side(ids, kept[0]), F.col("doc_id").eqNullSafe(F.col("candidate")), "left_semi")
    reduced = shared_shingles(held, words, kept[1] or 0).join(candidates.select("class", "n"), "class").filter(could(F.size("shingles")))
    reduced = materialise(reduced.select("class", "n", "shingles"), "partenum-shared")
    roots = _links(reduced, num, den)
    # (class, component) of the classes of several rows or links; every other row stands alone
    linked = classes.join(roots, F.col("class") == F.col("node")).select("class", "id", "root")
    lowest = linked.groupBy("root").agg(F.min("id").alias("component"))
    linked = linked.join(lowest, "root").select("class", "component")
    copies = classes.filter("rows > 1").join(linked, "class", "left_anti").select("class", F.col("id").alias("component"))
    component = materialise(linked.union(copies).withColumnRenamed("class", "of"), "partenum-components")
    found = described.join(small_side(component), (F.col("class") == F.col("of")) & (F.col("n_shingles") > 0), "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(df: DataFrame, **options) -> DataFrame:
    """``df`` without the rows whose text is linked, over any path, with one of a smaller id.

    Rows of one id stay if any of them would; null ids stay.
    """
    found = jaccard_components(df, **options).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("goes"))
    gone = materialise(found.filter("goes").select(F.col("doc_id").alias("__gone")), "partenum-gone")
    return df.join(small_side(gone), df["doc_id"] == F.col("__gone"), "left_anti")
