"""Operator 10: exact Jaccard self-join of n-gram sets, as a metric-space join.

Jaccard distance d = 1 - J is a metric; documents within r = 1 - ``threshold`` are
linked. Unrelated documents all lie at distance 1 from each other, so pivots drawn
from the corpus at large tell nothing apart. The first pivots are found where
documents meet, the later ones are drawn from the region that they divide:

1. Equal gram sets are one set from the start, by a fingerprint of all grams.
2. The grams of a set in hash order make links gram -> next gram, as many as grams
   (the last one leads to an end mark). Where two sets disagree on what follows a
   common gram, the lesser follower is in one set only, and it follows one gram only;
   so |x & y| grams in common mean |x & y| - |x ^ y| links in common at least, which
   is (2t - 1) max(|x|, |y|) for a pair within r. A link holds two distant trigrams
   of a text and is rarely shared by chance, which single trigrams of frequent words
   often are, the more so the larger the corpus. Every set sends its prefix, the
   |x| - ceil((2t - 1)|x|) + l(x) links of smallest hash, l(x) = ceil(slack |x|), to
   cells keyed by link. A pair within r shares at least min(l(x), l(y)) prefix links.
   The set of least priority in a cell is the pivot of the cell; members are tied to it.
3. A set whose prefix shares too few links with anybody has no partner and goes. Of
   the others' ties the weakest go, as long as the shared links lost are fewer than
   half of what a pair is sure to share: every pair within r keeps a pivot that both
   are tied to. A set is copied into the regions of all its pivots.
4. A region over ``BIG`` sets or bytes is often one of a passage that unrelated documents
   share. They lie at distance 1 here too, so steps 2 and 3 are taken once more inside it, with
   single grams, those last that are frequent in the region: a pair within r has |x & y| >=
   t max(|x|, |y|), so a prefix of |x| - ceil(t|x|) + l(x) grams does as that of links does.
   What is over ``BIG`` then is divided by a shuffle, again and again: pivots
   are drawn from its own sets, each set goes to the nearest (a Voronoi cell), and is
   copied as a guest to every earlier cell in which it can have a partner by the
   triangle inequality, d(y, p) <= R(p) + r with R(p) the radius of the cell. What pivots
   hardly divide is cut into pairs of blocks. A region that fits one task is divided in
   the same way there, down to ``LEAF`` sets. Own sets meet each other and the guests, so
   a pair of a region is met once.
5. Of the regions that a pair shares, the one of the least pivot counts it. No pairs are
   written: a region returns for each set how many documents it is linked to, and a tree
   of links that holds its linked sets together. Trees are joined to classes.

No step drops a pair. Grams are 48-bit hashes and sets are known by 64 bits; links and
the value of J hold up to collisions of these (about 1e-9 for a pair of 500-gram documents).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.llm import common as C
from mergeloom.llm import substring as S
from mergeloom.llm.tokens import Words, slices

#: Sets that are joined without further pivots, sets compared at once, pivots of a division.
LEAF, BLOCK, PIVOTS = 16, 128, 16
#: Sets and bytes of a region in one task, and rounds of division by shuffle before the rest is cut into blocks.
BIG, BIG_BYTES, ROUNDS = 4096, 64 << 20, 4
#: Sets and bytes of a large region that tell which grams are frequent in it (a matter of order, not of results), and their least share.
SAMPLE, SAMPLE_BYTES, FREQUENT = 256, 16 << 20, 0.02
#: A division that leaves more than this share of the work of a region does not pay.
PAYS = 0.7
EPS = 1e-9
GRAM = np.uint64((1 << 48) - 1)
FOUND = "fp long, n int, doc_ids array<long>, grams binary"
WORK = ["region", "fp", "own", "self", "lesser", "weight", "grams"]
LINKED = "fp long, root long, links long"


def gram_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row << 48 | gram) keys, and the number of grams of each row."""
    h, at = words.grams(n, short=True)
    key = (words.doc[at].astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key, np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=len(words.count))


def prefix_links(key: np.ndarray, size: np.ndarray, t: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit link, row) of each row's prefix."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    row = (key >> np.uint64(48)).astype(np.int64)
    after = np.concatenate([key[1:], [~np.uint64(0)]])
    after[np.concatenate([row[1:] != row[:-1], [True]])] = ~np.uint64(0)
    link = C.mix((key & GRAM) * np.uint64(0x9E3779B97F4A7C15) + (after & GRAM)) & GRAM
    link |= key & ~GRAM
    link.sort()
    rank = np.arange(len(link)) - np.concatenate([[0], np.cumsum(size)])[row]
    least = np.ceil(slack * size - EPS)
    length = np.minimum(size, size - np.ceil((2 * t - 1) * size - EPS) + least)
    take = rank < length[row]
    return link[take] & GRAM, row[take]


def near_classes(docs: DataFrame, n: int = 3, threshold: float = 0.7, slack: float = 0.1) -> DataFrame:
    """(doc_id, class_id, n_links): every document that has another one with J >= threshold.

    ``n_links`` is the number of these others, copies with the same gram set
    included; ``class_id`` is the least doc_id of all documents that a chain of links
    leads to, that of the document itself among them.

    Defined cases: a null or wordless text has no grams and no partner; a text of
    1 to n-1 words is one gram; a very long text is one set like others (regions are
    bounded by bytes); rows with null doc_id are left out; equal rows are one
    document; rows that share a doc_id but not the gram set are compared like others and
    reported as one, with the least class and the most links of theirs. ``doc_id`` is
    a whole number, others are an error. Other columns are not read. No rows give no rows.
    """
    if not 0 < slack < 2 * threshold - 1 <= 1:
        raise ValueError("0 < slack < 2 threshold - 1 <= 1 must hold")
    spark = docs.sparkSession
    C.bounded_batches(spark)
    texts = S.texts_of(docs)
    nb = C.bucket_count(texts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            key, size = gram_sets(Words(b.column(1)), n)
            if not len(key):
                continue
            fp = _set_hash(key, np.concatenate([[0], np.cumsum(size)]))
            link, row = prefix_links(key, size, threshold, slack)
            one = np.zeros(len(fp), bool)
            one[np.unique(fp, return_index=True)[1]] = True
            link, row = link[one[row]], row[one[row]]
            yield C.blob_batch(_cells(link, row, fp, size, nb))

    cells = C.exchange(texts.mapInArrow(C.trimmed(send), C.BLOB), lambda blobs: _link(blobs, nb), C.BLOB)
    ties = _ties(cells, threshold, slack)
    known = C.ids_of(C.stored(ties.select("fp").distinct()))
    members = spark.sparkContext.broadcast(known)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            key, size = gram_sets(Words(b.column(1)), n)
            cut = np.concatenate([[0], np.cumsum(size)])
            fp, ids = _set_hash(key, cut).view(np.int64), b.column(0).to_numpy()
            rows = np.flatnonzero(size)
            rows = rows[np.argsort(fp[rows], kind="stable")]
            first = np.flatnonzero(np.concatenate([[True], fp[rows][1:] != fp[rows][:-1]])) if len(rows) else rows
            one, ends = rows[first], np.append(first, len(rows)).astype(np.int32)
            wanted = np.ones(len(one), bool) if members.value is None else C.among(fp[one], members.value)
            grams = [_packed(key[cut[r] : cut[r + 1]]) if w else None for r, w in zip(one, wanted)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp[one]), pa.array(size[one], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[rows])), pa.array(grams, pa.binary())],
                names=["fp", "n", "doc_ids", "grams"],
            )

    found = C.stored(texts.mapInArrow(C.trimmed(sets), FOUND))
    named = C.stored(found.select("fp", F.explode("doc_ids").alias("doc_id")).distinct())
    classes = C.stored(named.groupBy("fp").agg(F.count("*").alias("weight"), F.min("doc_id").alias("least")))
    if known is not None and not len(known):  # no set meets another: copies alone are linked
        copies = C.stored(classes.where("weight > 1").select("fp", F.col("least").alias("class_id"), (F.col("weight") - 1).alias("n_links")))
        return _rows(named, copies)
    grams = found.where("grams is not null").groupBy("fp").agg(F.first("grams").alias("grams"))
    tied = _regions(ties)
    place = tied.join(grams, "fp").join(classes.select("fp", "weight"), "fp")
    parts = [C.stored(place.select("region", "fp", F.lit(True).alias("own"), F.lit(True).alias("self"), "lesser", "weight", "grams"))]
    C.release(found, ties, tied)
    fit = []
    for k in range(-1, ROUNDS + 1):
        large = C.stored(_sizes(parts[-1]).where((F.col("sets") > BIG) | (F.col("bytes") > BIG_BYTES)))
        if large.isEmpty():
            break
        fit.append(parts[-1].join(C.small_side(large.select("region")), "region", "left_anti"))
        rows = parts[-1].join(C.small_side(large), "region")
        parts.append(_refine(rows, nb, threshold, slack) if k < 0 else _divide(rows, k, 1 - threshold))
    work = parts[-1]
    for x in fit:
        work = work.unionByName(x.select(*WORK))
    bucket = F.pmod(F.xxhash64("region"), F.lit(nb)).alias("bucket")
    joined = C.stored(work.select(bucket, *WORK).groupBy("bucket").applyInArrow(lambda t: _join_regions(t, threshold), LINKED))
    C.release(*parts)
    links = joined.groupBy("fp").agg(F.sum("links").alias("links"))
    root = groups(joined.select(F.col("fp").alias("doc_a"), F.col("root").alias("doc_b"))).select(F.col("doc_id").alias("fp"), "root")
    linked = C.stored(classes.join(links, "fp", "left").join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")).where("n_links > 0"))
    named_class = linked.groupBy("root").agg(F.min("least").alias("class_id"))
    each = C.stored(linked.join(named_class, "root").select("fp", "class_id", "n_links"))
    return _rows(named, each)


def _ties(cells: DataFrame, t: float, slack: float) -> DataFrame:
    """(fp, pivot), stored: ties that must stay, of pivots with two members at least."""
    every = C.stored(C.exchange(cells, lambda blobs: _choose(blobs, t, slack), "fp long, pivot long"))
    shared = every.groupBy("pivot").agg(F.count("*").alias("members")).where("members > 1").select("pivot")
    ties = C.stored(every.join(shared, "pivot", "left_semi"))
    C.release(every)
    return ties


def _regions(ties: DataFrame) -> DataFrame:
    """(fp, region, lesser), stored: the members of the regions of pivots, with the lesser pivots of each."""
    lists = ties.groupBy("fp").agg(F.collect_set("pivot").alias("pivots"))
    tied = C.stored(lists.select("fp", F.explode("pivots").alias("region"), "pivots").select("fp", "region", F.filter("pivots", lambda p: p < F.col("region")).alias("lesser")))
    # a region is met elsewhere if all its members also are in the region of one lesser pivot
    size = tied.groupBy("region").agg(F.count("*").alias("members"))
    also = tied.select("region", F.explode("lesser").alias("q")).groupBy("region", "q").agg(F.count("*").alias("members"))
    elsewhere = C.stored(also.join(size, ["region", "members"]).select("region").distinct())
    kept = C.stored(tied.join(C.small_side(elsewhere), "region", "left_anti"))
    C.release(tied, elsewhere)
    return kept


def _rows(named: DataFrame, each: DataFrame) -> DataFrame:
    """What is known of sets, for their documents."""
    return named.join(C.small_side(each), "fp").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))


def _packed(grams: np.ndarray) -> bytes:
    return (grams & GRAM).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _set_hash(key: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One 64-bit value per set, from all its grams (their order is the sorted one)."""
    h = C.mix((key & GRAM) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
    return C.mix(total[cut[1:]] - total[cut[:-1]])


def _cells(link: np.ndarray, row: np.ndarray, fp: np.ndarray, size: np.ndarray, nb: int) -> list[tuple[int, bytes]]:
    """Links of rows by bucket: the half of a link's hash that the bucket doesn't tell, and whose it is, by
    numbers into names or by names alone, whichever is shorter: 12 bytes a link at most, however many
    buckets there are. Sizes go once to the bucket of the name. Links that are taken for one only make more ties."""
    low = C.mix(link).astype("<u4")
    at, used = dict(C.split_by(C.bucket_of(link, nb))), np.unique(row)
    sized = {k: used[i] for k, i in C.split_by(C.bucket_of(fp[used], nb))}
    rows, none = [], np.zeros(0, np.int64)
    for k in sorted(at.keys() | sized.keys()):
        i, s = at.get(k, none), sized.get(k, none)
        own, local = np.unique(row[i], return_inverse=True)
        if 2 * len(i) + 8 * len(own) > 8 * len(i):
            own, local = row[i], none
        rows.append((k, C.pack(low[i], local.astype("<u2"), fp[own].astype("<u8"), fp[s].astype("<u8"), size[s].astype("<u4"))))
    return rows


def _link(blobs: list[bytes], nb: int) -> pa.Table:
    """Cells of a bucket -> ties (set, pivot, shared links), packed by the set's bucket, with the sizes that are sent there."""
    links, numbers, names, sized, sizes = C.gather(blobs, "<u4", "<u2", "<u8", "<u8", "<u4")
    rows, sized, none = [], np.concatenate(sized), np.zeros(0, np.uint64)
    sizes = np.concatenate(sizes)
    for k, i in C.split_by(C.bucket_of(sized, nb)):
        rows.append((k, C.pack(none, none, none.astype("<u4"), sized[i], sizes[i])))
    link = np.concatenate(links)
    if not len(link):
        return pa.Table.from_batches([C.blob_batch(rows)])
    base = np.cumsum([0] + [len(x) for x in names])
    which = np.concatenate([(n.astype(np.int64) if len(n) else np.arange(len(x))) + b for n, x, b in zip(numbers, names, base)])
    ids, number = np.unique(np.concatenate(names), return_inverse=True)
    doc = number[which]
    order = np.lexsort((doc, link))
    link, doc = link[order], doc[order]
    new = np.concatenate([[True], (link[1:] != link[:-1]) | (doc[1:] != doc[:-1])])  # equal sets of several tasks
    link, doc = link[new], doc[new]
    begin = np.flatnonzero(np.concatenate([[True], link[1:] != link[:-1]]))
    many = np.diff(np.concatenate([begin, [len(link)]]))
    priority = np.empty(len(ids), np.int64)
    by = np.lexsort((ids, C.mix(ids)))
    priority[by] = np.arange(len(ids))
    pivot = by[np.minimum.reduceat(priority[doc], begin)]
    in_cell = np.repeat(many > 1, many)
    doc, pivot = doc[in_cell], np.repeat(pivot, many)[in_cell]
    pair, shared = np.unique((doc.astype(np.uint64) << np.uint64(32)) | pivot.astype(np.uint64), return_counts=True)
    doc, pivot = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    for k, i in C.split_by(C.bucket_of(ids[doc], nb)):
        rows.append((k, C.pack(ids[doc[i]], ids[pivot[i]], shared[i].astype("<u4"), none, none.astype("<u4"))))
    return pa.Table.from_batches([C.blob_batch(rows)])


def _choose(blobs: list[bytes], t: float, slack: float) -> pa.Table:
    """Ties of whole sets -> those that must stay."""
    doc, pivot, shared, named, sizes = (np.concatenate(x) for x in C.gather(blobs, "<i8", "<i8", "<u4", "<i8", "<u4"))
    if not len(doc):
        return pa.table({"fp": doc, "pivot": pivot})
    order = np.lexsort((pivot, doc))
    doc, pivot, shared = doc[order], pivot[order], shared[order].astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pivot[1:] != pivot[:-1])]))
    doc, pivot, shared = doc[begin], pivot[begin], np.add.reduceat(shared, begin)
    named, at = np.unique(named, return_index=True)
    size = sizes[at][np.searchsorted(named, doc)].astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    many = np.diff(np.concatenate([begin, [len(doc)]]))
    group = np.repeat(np.arange(len(begin)), many)
    least = np.ceil(slack * size - EPS)
    enough = np.add.reduceat(shared, begin)[group] >= np.ceil(slack * t * size - EPS)
    may_lose = np.maximum(0, np.ceil(t * (least - 1) / 2 - EPS) - 1)
    by = np.lexsort((shared, group))
    lost = np.cumsum(shared[by]) - np.concatenate([[0], np.cumsum(np.add.reduceat(shared, begin))])[group[by]]
    keep = np.empty(len(doc), bool)
    keep[by] = lost > may_lose[by]
    keep &= enough
    return pa.table({"fp": doc[keep], "pivot": pivot[keep]})


# --- dividing regions by a shuffle ------------------------------------------


def _refine(large: DataFrame, nb: int, t: float, slack: float) -> DataFrame:
    """Rows of large regions of own sets (with their sizes) -> rows of the regions of pivots inside them, stored.

    Sets without a partner in their region go, and what is left meets by rare grams. A member of a
    region is known by a hash of both; lesser pivots of the refined region are added to those of the set.
    """
    large = large.withColumn("member", F.xxhash64("region", "fp"))
    chance = F.least(SAMPLE / F.col("sets"), SAMPLE_BYTES / F.col("bytes"))
    drawn = F.pmod(F.xxhash64("fp", F.lit(-2)), F.lit(1 << 30)) < chance * (1 << 30)
    frequent = C.stored(large.where(drawn).select("region", "grams").groupBy("region").applyInArrow(_frequent, "region long, frequent binary"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            region, member = (b.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            prefixes, size = [], np.zeros(b.num_rows, np.int64)
            for k, (raw, last) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                g = _grams(raw)
                size[k] = n = len(g)
                prefixes.append(_prefix(g, np.frombuffer(last or b"", "<u8"), int(min(n, n - np.ceil(t * n - EPS) + np.ceil(slack * n - EPS)))))
            if not prefixes:
                continue
            row = np.repeat(np.arange(b.num_rows), [len(x) for x in prefixes])
            key = C.mix(np.concatenate(prefixes) * np.uint64(0x9E3779B97F4A7C15) + C.mix(region)[row]) & GRAM
            yield C.blob_batch(_cells(key, row, member, size, nb))

    sets = large.select("region", "member", "grams").join(C.small_side(frequent), "region", "left").select("region", "member", "grams", "frequent")
    cells = C.exchange(sets.mapInArrow(C.trimmed(send), C.BLOB), lambda blobs: _link(blobs, nb), C.BLOB)
    ties = _ties(cells, t, slack)
    inner = _regions(ties).withColumnsRenamed({"fp": "member", "region": "inner", "lesser": "also"})
    rows = large.join(inner, "member").select(F.col("inner").alias("region"), "fp", "own", "self", F.concat("lesser", "also").alias("lesser"), "weight", "grams")
    refined = C.stored(rows)
    C.release(frequent, ties)
    return refined


def _frequent(sample: pa.Table) -> pa.Table:
    """The grams that are frequent in a sample of a region, the most frequent last."""
    grams, many = np.unique(np.concatenate([_grams(x) for x in sample.column("grams").to_pylist()]), return_counts=True)
    found = np.flatnonzero(many >= max(3, FREQUENT * sample.num_rows))
    found = found[np.argsort(many[found], kind="stable")]
    return pa.table({"region": sample.column("region").slice(0, 1), "frequent": pa.array([grams[found].astype("<u8").tobytes()], pa.binary())})


def _prefix(grams: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """The first ``length`` of the sorted ``grams``, where those of ``last`` come last, in its order."""
    rare = grams[~C.among(grams, np.sort(last))]
    return rare[:length] if length <= len(rare) else np.concatenate([rare, last[C.among(last, grams)]])[:length]


def _sizes(work: DataFrame) -> DataFrame:
    return work.groupBy("region").agg(F.count("*").alias("sets"), F.sum(F.col("own").cast("int")).alias("owners"), F.sum(F.octet_length("grams")).alias("bytes"))


def _parts(of: int) -> Column:
    """Into how many parts the sets of a large region are salted."""
    return F.greatest(F.ceil(F.col("sets") / F.lit(of)), F.ceil(F.col("bytes") / F.lit(BIG_BYTES))).cast("int")


def _divide(large: DataFrame, k: int, r: float) -> DataFrame:
    """Rows of large regions (with their sizes) -> rows of the Voronoi cells of pivots drawn from them, stored.

    In the last round, or where the cells with their guests hardly save work, a region is cut into pairs of blocks.
    """
    large = large.withColumn("salt", F.pmod(F.xxhash64("fp"), _parts(BIG)).cast("int"))
    drawn = F.pmod(F.xxhash64("fp", F.lit(k)), F.col("owners")) < PIVOTS
    pivots = large.where(F.col("own") & F.col("self") & drawn & F.lit(k < ROUNDS)).select(F.col("region").alias("p_region"), F.explode(F.sequence(F.lit(0), _parts(BIG) - 1)).alias("p_salt"), F.col("fp").alias("pivot"), F.col("grams").alias("p_grams"))
    shape = "region long, fp long, own boolean, self boolean, lesser array<long>, weight long, grams binary, sets long, owners long, bytes long, home int, d array<double>"
    placed = C.stored(large.groupBy("region", "salt").cogroup(pivots.groupBy("p_region", "p_salt")).applyInArrow(_distances, shape))
    cell = placed.where("own").groupBy("region", "home").agg(F.max(F.col("d")[F.col("home")]).alias("radius"), F.count("*").alias("held"), F.first("owners").alias("owners"))
    every = C.stored(cell.where("held < owners").select("region", F.col("home").alias("at"), "radius", "held"))
    near = F.when(F.col("own"), F.col("at") <= F.col("home")).otherwise(True) & (F.col("distance") <= F.col("radius") + r + EPS)
    met = placed.select("region", "own", "home", "sets", "owners", F.posexplode("d").alias("at", "distance")).join(C.small_side(every), ["region", "at"]).where(near)
    met = met.groupBy("region", "at").agg(F.count("*").alias("reach"), F.first("held").alias("held"), F.first("sets").alias("sets"), F.first("owners").alias("owners"))
    left = met.groupBy("region").agg(F.sum(F.expr("held * (reach - held / 2)")).alias("left"), F.first(F.expr("owners * (sets - owners / 2)")).alias("whole"))
    pays = C.stored(left.where(F.col("left") <= PAYS * F.col("whole")).select("region"))
    cell = C.stored(every.join(C.small_side(pays), "region", "left_semi").drop("held"))
    whole = placed.join(C.small_side(cell.select("region").distinct()), "region", "left_anti")
    each = placed.select("*", F.posexplode("d").alias("at", "distance"))
    cells = each.join(C.small_side(cell), ["region", "at"]).where(near)
    cells = cells.select(F.xxhash64("region", "at", F.lit(k)).alias("region"), "fp", (F.col("own") & (F.col("at") == F.col("home"))).alias("own"), "self", "lesser", "weight", "grams")
    # blocks a <= b: those of own sets with themselves and with later ones, and with all of guests
    n, block = _parts(BIG // 2), F.col("block")
    cut = whole.withColumn("block", F.pmod(F.xxhash64("fp", F.lit(-1)), n * 2).cast("int")).withColumn("blocks", n * 2)
    own = cut.where("own").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    mine = own.where("self").select("*", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), (block <= F.col("other")).alias("is_own"))
    same = mine.select(F.xxhash64("region", "a", "b", F.lit(k)).alias("region"), "fp", F.col("is_own").alias("own"), (F.col("a") == F.col("b")).alias("self"), "lesser", "weight", "grams")
    guests = cut.where("not own").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = own.select(F.xxhash64("region", "block", "other", F.lit(-k - 1)).alias("region"), "fp", "own", F.lit(False).alias("self"), "lesser", "weight", "grams")
    met = met.unionByName(guests.select(F.xxhash64("region", "other", "block", F.lit(-k - 1)).alias("region"), "fp", "own", F.lit(False).alias("self"), "lesser", "weight", "grams"))
    divided = C.stored(cells.unionByName(same).unionByName(met))
    C.release(placed)
    return divided


def _distances(t: pa.Table, pivots: pa.Table) -> pa.Table:
    """Rows of a part of a region with their distances to its pivots, and the number of the nearest."""
    pivots = pivots.sort_by("pivot")
    sets = [_grams(x) for x in t.column("grams").to_pylist()]
    against = [_grams(x) for x in pivots.column("p_grams").to_pylist()]
    d = _to_pivots(sets, against) if against else np.zeros((1, len(sets)))
    home = np.argmin(d, axis=0).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * len(d)), pa.array(np.ascontiguousarray(d.T).reshape(-1)))
    return t.drop_columns(["salt"]).append_column("home", pa.array(home)).append_column("d", lists)


# --- joining one region ---------------------------------------------------


def _to_pivots(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """Jaccard distances, a row for each pivot."""
    m, size = len(sets), np.array([len(s) for s in sets])
    d, step = np.empty((len(pivots), m)), 1024
    for a in range(0, m, step):  # few at a time, so that memory stays bounded
        row, flat = np.repeat(np.arange(len(sets[a : a + step])), size[a : a + step]), np.concatenate(sets[a : a + step])
        for k, p in enumerate(pivots):
            both = np.bincount(row, weights=C.among(flat, p), minlength=len(sets[a : a + step]))
            d[k, a : a + step] = 1 - both / (size[a : a + step] + len(p) - both)
    return d


class Region:
    """Sets of a region, the links found between them, and the trees that these make."""

    def __init__(self, sets: list[np.ndarray], lesser: list[np.ndarray], weight: np.ndarray, t: float):
        self.sets, self.lesser, self.weight, self.t = sets, lesser, weight, t
        self.links, self.root = np.zeros(len(sets), np.int64), np.arange(len(sets))
        self.divided = 0

    def join(self, own: np.ndarray, guests: np.ndarray, depth: int = 0) -> None:
        """All pairs of ``own``, and of ``own`` with ``guests``."""
        if not len(own):
            return
        if len(own) + len(guests) <= LEAF or len(own) == 1 or depth > 20:
            self.blocks(own, own)
            return self.blocks(own, guests)
        pick = own[np.unique(np.linspace(0, len(own) - 1, min(PIVOTS, 2 + len(own) // LEAF)).astype(int))]
        both = np.concatenate([own, guests])
        d = _to_pivots([self.sets[i] for i in both], [self.sets[i] for i in pick])
        home = np.argmin(d, axis=0)
        home[len(own) :] = len(pick)  # a guest comes after all cells
        cells = []
        for k in range(len(pick)):
            c = np.flatnonzero(home == k)
            if len(c):
                cells.append((c, np.flatnonzero((home > k) & (d[k] <= d[k][c].max() + (1 - self.t) + EPS))))
        left = sum(len(c) * (len(c) / 2 + len(near)) for c, near in cells)
        if left > 0.7 * len(own) * (len(own) / 2 + len(guests)):  # the pivots hardly divide this region
            self.blocks(own, own)
            return self.blocks(own, guests)
        self.divided += 1
        for c, near in cells:
            self.join(both[c], both[near], depth + 1)

    def blocks(self, a: np.ndarray, b: np.ndarray) -> None:
        """``a`` against ``b``, or its own pairs if they are the same, a block at a time."""
        same = a is b
        for i in range(0, len(a), BLOCK):
            x = a[i : i + BLOCK]
            if same:
                self.leaf(x, x)
            for j in range(i + BLOCK if same else 0, len(b), BLOCK):
                self.leaf(x, b[j : j + BLOCK])

    def leaf(self, a: np.ndarray, b: np.ndarray) -> None:
        both = _common(self.sets, a, b)
        size = np.array([len(self.sets[i]) for i in a])[:, None] + np.array([len(self.sets[i]) for i in b])
        ok = both / (size - both) >= self.t
        if a is b:
            ok = np.triu(ok, 1)
        if ok.any():
            ok &= _common(self.lesser, a, b) == 0  # met in the region of a lesser pivot
        i, j = np.nonzero(ok)
        i, j = a[i], b[j]
        np.add.at(self.links, i, self.weight[j])
        np.add.at(self.links, j, self.weight[i])
        while len(i):
            low = np.minimum(self.root[i], self.root[j])
            if (self.root[i] == low).all() and (self.root[j] == low).all():
                break
            for end in (i, j):
                np.minimum.at(self.root, self.root[end], low)
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _join_regions(t: pa.Table, threshold: float) -> pa.Table:
    t = t.sort_by("region")
    region, fp, own, alone, weight = (t.column(c).to_numpy() for c in ("region", "fp", "own", "self", "weight"))
    cut = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]]))
    out = []
    for a, z in zip(cut[:-1], cut[1:]):
        mine = np.flatnonzero(own[a:z])
        if z - a < 2 or not len(mine):
            continue
        part = t.slice(a, z - a)
        found = Region([_grams(x) for x in part.column("grams").to_pylist()], [np.sort(np.array(x, np.int64)) for x in part.column("lesser").to_pylist()], weight[a:z], threshold)
        if alone[a:z][mine].all():
            found.join(mine, np.flatnonzero(~own[a:z]))
        else:
            found.blocks(mine, np.flatnonzero(~own[a:z]))
        got = np.flatnonzero(found.links)
        out.append((fp[a:z][got], fp[a:z][found.root[got]], found.links[got]))
    C.trim()
    x, y, n = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"fp": x, "root": y, "links": n})


def _grams(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def _common(lists: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values each of ``a`` shares with each of ``b``."""
    same = a is b
    every = a if same else np.concatenate([a, b])
    size = np.array([len(lists[i]) for i in every])
    flat, row = np.concatenate([lists[i] for i in every]), np.repeat(np.arange(len(every)), size)
    both = np.zeros((len(a), len(b)))
    if not len(flat):
        return both
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    many = np.diff(np.concatenate([np.flatnonzero(new), [len(flat)]]))
    shared = many > 1
    keep = np.repeat(shared, many)
    row, col = row[keep], np.repeat(np.cumsum(shared) - 1, many)[keep]
    width = int(shared.sum())
    for c in range(0, width, 4096):  # bounded columns at a time
        i0, i1 = np.searchsorted(col, (c, c + 4096))
        x = np.zeros((len(every), min(4096, width - c)), np.float32)
        x[row[i0:i1], col[i0:i1] - c] = 1
        both += x[: len(a)] @ (x if same else x[len(a) :]).T
    return np.rint(both)


# --- groups -----------------------------------------------------------------


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, root): connected components of (doc_a, doc_b); root is the least doc_id.

    Alternates the large-star and small-star steps until the edges are stars;
    each round is written to the shared folder. No pairs give no rows.
    """
    edges = C.stored(pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("u <> v").distinct())
    while True:
        before = _state(edges)
        if not before[0]:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = C.stored(large.where("u <> v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("a"), "u", "m")
        small = small.select(F.col("a").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = C.stored(small.where("u <> v").distinct())
        if _state(edges) == before:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without all but the least doc_id of each class of near copies.

    Of rows that repeat a doc_id with its text one stays. Rows that share a doc_id
    but not the text are one document here: they stay or go together. Rows with null doc_id
    stay, as do those without words; all columns stay.
    """
    gone = C.stored(near_classes(docs, **how).where("class_id <> doc_id").select(F.col("doc_id").alias("__gone")))
    kept = docs.join(C.small_side(gone), docs["doc_id"] == gone["__gone"], "left_anti")
    again = C.stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")))
    if again.isEmpty():
        return kept
    many = C.small_side(again)
    once = kept.join(many, F.col("doc_id") == F.col("__again"), "left_anti")
    return once.unionByName(kept.join(many, F.col("doc_id") == F.col("__again"), "left_semi").dropDuplicates(["doc_id", "text"]))
