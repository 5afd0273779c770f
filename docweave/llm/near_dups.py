"""MinHash near-dedup: one-permutation hashing with optimal densification, banded
buckets and star-shaped candidate edges.

1. One pass over the texts hashes each document's shingles once, keeps the least
   hash in each of ``BINS`` bins and fills empty bins from bins chosen by a hash
   of (bin, attempt). Bands of ``ROWS`` bins become bucket keys. The same pass
   makes a 128-bit digest of the whole shingle set.
2. Documents with equal sets are one class, whatever their number; the rest works
   on class representatives, under a bijective scramble of their ids (nodes).
3. In each bucket every member is joined to a centre only, the least node. Pairs
   that the sizes allow are confirmed on full sets by the JVM.
4. A link between two members that are not linked to a centre must not get lost.
   Buckets whose members still lie in different components stay open. The hub of
   a component is its member with most links; every member of an open bucket is
   compared with the hubs of the bucket's larger components, ``HEADS`` at most: a
   second star. What is left is searched by deviations: with D(x) the shingles in which x
   differs from the hub h, x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)|
   shingles, so linked ones share at least half of |D(x)| + |D(y)| less what linked
   sets may differ in. A document that is not linked with the hub deviates by more
   than that, so the shared part is never empty, and a prefix index over
   deviations, rarest shingles first, finds every such pair; deviations are short
   where texts are near copies and rarely shared where they differ at random.

At a similarity of 0.8 a band of 6 bins agrees with probability 0.26, and all of
50 bands miss a pair with probability 3e-7; higher similarities miss less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docweave.llm._shared import Tables, map_arrow
from docweave.llm._text import chunks, find_words, lower_bytes, mix64, read_words, text_buffers, word_table
from docweave.llm.components import connected_components

BANDS, ROWS = 50, 6
#: A component is large in an open bucket if it has one in so many of its members.
HEADS = 4
BINS = BANDS * ROWS
#: Bits of the map that tells which texts are read again (8 MB), and of one of its pieces.
BITS, PIECE = 26, 15
_A = np.uint64(0xD6E8FEB86659FD93)
_B = np.uint64(0xA5A3564E27F88AB3)
_C = np.uint64(0x2545F4914F6CDD1D)
_TOP = np.uint64(32)


class Shingler:
    """Distinct shingle hashes of texts."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.lower, self.table = lower_bytes(), word_table("nonspace")

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """For each text the sorted distinct hashes of its shingles of ``size``
        words; of a shorter text, one for the whole sequence; of none, nothing."""
        bounds, data = text_buffers(column)
        for lo, hi in chunks(bounds):
            part = self.lower[data[bounds[lo] : bounds[hi]]]
            starts, ends, first = find_words(part, bounds[lo : hi + 1] - bounds[lo], self.table)
            words = read_words(part, starts, ends).hashes
            rolled = words * _A
            for k in range(1, self.size):
                left = max(0, len(words) - k)
                rolled[:left] = mix64(rolled[:left]) * _B + words[len(words) - left :]
            rolled = mix64(rolled)
            for d in range(hi - lo):
                i, j = int(first[d]), int(first[d + 1])
                if j - i >= self.size:
                    yield np.unique(rolled[i : j - self.size + 1])
                elif j > i:
                    whole = words[i : i + 1] * _C
                    for k in range(i + 1, j):
                        whole = mix64(whole) * _C + words[k : k + 1]
                    yield mix64(whole)
                else:
                    yield words[:0]


def _bins(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> _TOP) * np.uint64(BINS) >> _TOP).astype(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation minima, densified: (documents, BINS). Sets must not be empty."""
    out = np.zeros((len(sets), BINS), dtype=np.uint64)
    full = np.zeros((len(sets), BINS), dtype=bool)
    for d, u in enumerate(sets):
        bins = _bins(u)
        least = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        out[d, bins[least]] = u[least]
        full[d, bins[least]] = True
    doc, slot = np.nonzero(~full)
    attempt = np.zeros(1, dtype=np.uint64)
    while len(doc):
        attempt = attempt + _C
        source = _bins(mix64(slot.astype(np.uint64) * _B + attempt))
        hit = full[doc, source]
        out[doc[hit], slot[hit]] = out[doc[hit], source[hit]]
        doc, slot = doc[~hit], slot[~hit]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _C, (len(signature), 1))
    for r in range(ROWS):
        key = mix64(key * _A + parts[:, :, r])
    return key


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(flat, type=pa.int64()))


#: Documents whose signatures are held at once.
STEP = 2048


def sketch(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, keys): size and digest of the set, bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                sets = list(shingler.sets(part.column(1)))
                some = [i for i, x in enumerate(sets) if len(x)]
                keys = [np.zeros(0, np.uint64)] * len(sets)
                for i, row in zip(some, bands(signatures([sets[i] for i in some])), strict=True):
                    keys[i] = row
                digest = np.array([(mix64(x + _A).sum(), mix64(x ^ _B).sum()) for x in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(x) for x in sets], type=pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), _lists(keys)], ["doc_id", "n_shingles", "h1", "h2", "keys"])

    return map_arrow(docs.select(doc_id, text), run, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, items): all distinct shingle hashes of each text of docs(id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), _lists(list(shingler.sets(part.column(1))))], ["id", "items"])

    return map_arrow(docs.select("id", "text"), run, "id long, items array<long>")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Texts are lower-cased in A-Z and cut into words at white space; a set holds the
    distinct shingles of ``shingle`` words, or a shorter text's whole sequence.
    Texts with 100 * intersection >= ``percent`` * union are linked, and so are
    rows with the same id; ``component_id`` is the smallest id that links reach.
    A null or blank text is linked with nothing; a row without id is linked with
    nothing either, has no component_id and is kept. An empty table gives no rows.
    A text of any length is one set; only its row grows with it. Other columns are
    not read. Links are confirmed on full sets, whose shingles stand there as 64-bit hashes
    that mix every eight bytes with their place: sizes count hashes, and two different
    shingles are taken for one with a chance of 2**-64 a pair.
    """
    tables = Tables(docs.sparkSession, "near-dups")
    known = docs.where(F.col(doc_id).isNotNull()).select(_node(F.col(doc_id).cast("long")).alias("id"), F.col(text).alias("text"))
    digest = ["h1", "h2", "n_shingles"]
    sketches = tables.keep(sketch(docs, doc_id, text, shingle), "sketches")
    some = sketches.where("doc_id is not null and n_shingles > 0")
    classes = tables.keep(some.groupBy(*digest).agg(F.min("doc_id").alias("doc_id")).withColumn("id", _node(F.col("doc_id"))), "classes")
    chosen = some.join(classes, [*digest, "doc_id"])
    members = chosen.select("id", F.explode("keys").alias("key"))
    centres = members.groupBy("key").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "c")
    buckets = tables.keep(members.join(centres, "key").where("id <> c"), "stars")
    sizes = classes.select("id", F.col("n_shingles").alias("n"))
    tried = tables.keep(_close(buckets.select(F.col("c").alias("a"), F.col("id").alias("b")).distinct(), sizes, percent), "pairs-stars")
    links = tables.keep(_confirmed(tried, known, shingle, percent).unionByName(_repeated(some, classes, digest)), "links-stars")
    labels = connected_components(links, tables, "components-stars")
    left = _unsettled(buckets, labels, tables, "open")
    if not left.isEmpty():
        met = tables.keep(_hubs(left, links, labels), "hubs")
        tables.drop("open")
        near = tables.keep(_deviations(met, known, shingle, percent), "near")
        pairs = tables.keep(_sharing(near, labels, tables, percent).join(tried, ["a", "b"], "left_anti"), "pairs-open")
        tables.drop("entries")
        to_hubs = near.where("linked").select(F.col("g").alias("a"), F.col("id").alias("b"))
        new = tables.keep(_confirmed(pairs, known, shingle, percent).unionByName(to_hubs), "links-open")
        tables.drop("near")
        labels = _merged(labels, new, tables, "components-open")
    tables.drop("stars")
    found = classes.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = found.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = found.join(least, "label").select(*digest, "component_id")
    linked = some.select("doc_id", *digest).join(named, digest).select("doc_id", "n_shingles", "component_id")
    alone = sketches.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest id, and any one
    of rows with equal ids. Rows without id all stay. All columns are kept."""
    tables = Tables(docs.sparkSession, "deduplicate")
    found = tables.keep(near_duplicates(docs, doc_id=doc_id, text=text, shingle=shingle, percent=percent).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "kept")
    id_ = F.col("doc_id").alias(doc_id)
    once = docs.join(found.where("n = 1").select(id_), doc_id, "left_semi")
    out = once.unionByName(docs.where(F.col(doc_id).isNull()))
    several = found.where("n > 1").select(id_)
    return out if several.isEmpty() else out.unionByName(docs.join(several, doc_id, "left_semi").dropDuplicates([doc_id]))


def _node(x: Column) -> Column:
    """A bijective scramble of a long: the least node of some is any of them."""
    for _ in range(2):
        for shift, by in ((F.shiftleft, 13), (F.shiftrightunsigned, 7), (F.shiftleft, 17)):
            x = x.bitwiseXOR(shift(x, by))
    return x


def _merged(labels: DataFrame, new: DataFrame, tables: Tables, name: str) -> DataFrame:
    """The labels after new links(a, b), found on the graph of the old components."""
    ends = _labels_of(_labels_of(new, labels, "a"), labels, "b")
    found = connected_components(ends, tables, name).select(F.col("node").alias("label"), F.col("label").alias("to"))
    nodes = new.select(F.col("a").alias("node")).union(new.select(F.col("b").alias("node"))).distinct().join(labels, "node", "left_anti")
    every = labels.unionByName(nodes.select("node", F.col("node").alias("label")))
    return tables.keep(every.join(found, "label", "left").select("node", F.coalesce("to", "label").alias("label")), f"{name}-merged")


def _labels_of(links: DataFrame, labels: DataFrame, end: str) -> DataFrame:
    other = "b" if end == "a" else "a"
    named = links.join(labels.withColumnsRenamed({"node": end, "label": "l"}), end, "left")
    return named.select(F.coalesce("l", end).alias(end), other)


def _close(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes(id, n) allow a link."""
    named = pairs.join(sizes.withColumnsRenamed({"id": "a", "n": "an"}), "a").join(sizes.withColumnsRenamed({"id": "b", "n": "bn"}), "b")
    return named.where(F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent).select("a", "b").distinct()


def _linked(common: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * common >= percent * (n + m - common)


def _size(column: str) -> Column:
    return F.size(column).cast("long")


def _marked(ids: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of known(id, ...) whose ids are given, and few others, without a shuffle
    of them: the ids set bits of a map of 2**``BITS`` bits, whatever their number, which
    is broadcast in pieces. Where the map would be full, a join by id."""
    if ids.count() > 1 << BITS - 1:
        return known.join(ids.distinct(), "id", "left_semi")
    place = F.shiftrightunsigned(F.xxhash64("id"), 64 - BITS)
    piece, bit = F.shiftright(place, PIECE).alias("piece"), place.bitwiseAND(F.lit((1 << PIECE) - 1))
    pieces = ids.select(piece, bit.alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substr("bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (bit.bitwiseAND(F.lit(7)) + 1).cast("int"))) != 0
    return known.withColumn("piece", piece).join(F.broadcast(pieces), "piece").where(there).drop("piece", "bits")


def _sets(ids: DataFrame, known: DataFrame, shingle: int) -> DataFrame:
    """(id, items) of the texts known(id, text) whose ids are given, and of few others."""
    return full_sets(_marked(ids, known), shingle)


def _confirmed(pairs: DataFrame, known: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    sets = _sets(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), known, shingle)
    first = pairs.join(sets.withColumnsRenamed({"id": "b", "items": "items_b"}), "b")
    both = first.join(sets.withColumnsRenamed({"id": "a", "items": "items_a"}), "a")
    common = F.size(F.array_intersect("items_a", "items_b")).cast("long")
    return both.where(_linked(common, _size("items_a"), _size("items_b"), percent)).select("a", "b")


def _unsettled(buckets: DataFrame, labels: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(key, id, label) of the buckets whose members lie in several components."""
    named = buckets.select("key", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    return tables.keep(named.join(mixed, "key", "left_semi"), name)


def _hubs(left: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, g, both): each member of an open bucket with the hubs of the bucket's larger
    components; ``both`` where two members outside all of these meet at this hub."""
    degree = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    hubs = degree.join(labels.withColumnRenamed("node", "id"), "id").groupBy("label").agg(F.max(F.struct("d", "id")).alias("hub"))
    parts = left.groupBy("key", "label").agg(F.count(F.lit(1)).alias("s"))
    whole = parts.groupBy("key").agg(F.sum("s").alias("m"), F.max(F.struct("s", "label")).alias("top"))
    first = F.col("label") == F.col("top.label")
    heads = parts.join(whole, "key").where((HEADS * F.col("s") >= F.col("m")) | first).select("key", "label", first.alias("first"))
    marked = left.join(heads.select("key", "label", F.lit(True).alias("own")), ["key", "label"], "left").drop("label")
    met = marked.join(heads, "key").groupBy("id", "label").agg(F.max(F.col("first") & F.col("own").isNull()).alias("both"))
    named = met.join(hubs, "label", "left").select("id", F.coalesce("hub.id", "label").alias("g"), "both")
    return named.where("id <> g")


def _deviations(rows: DataFrame, known: DataFrame, shingle: int, percent: int) -> DataFrame:
    """rows(id, g, both) with the size of the set, the number of shingles in which it
    deviates from the hub's, these shingles, and whether the two are linked."""
    sets = _sets(rows.select("id").union(rows.select("g")), known, shingle)
    both = rows.join(sets, "id").join(sets.withColumnsRenamed({"id": "g", "items": "hub"}), "g")
    common = F.size(F.array_intersect("items", "hub")).cast("long")
    n, m = _size("items"), _size("hub")
    spread = F.concat(F.sort_array(F.array_except("items", "hub")), F.sort_array(F.array_except("hub", "items")))
    return both.select("id", "g", "both", n.alias("n"), (n + m - 2 * common).alias("d"), _linked(common, n, m, percent).alias("linked"), spread.alias("items"))


_PARTNER = {"id": "c", "n": "cn", "d": "cd", "label": "cl", "rank": "cr", "core": "cc", "both": "cb"}


def _sharing(near: DataFrame, labels: DataFrame, tables: Tables, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet at a hub and may be linked: one of
    them lies in the hub's component, or none lies in a larger one of the bucket.

    Linked sets of n and m shingles differ in (100 - percent) * (n + m) / (100 + percent)
    at most; ``slack`` is that for the largest m that may be linked with n.
    """
    label = labels.withColumnRenamed("node", "id")
    named = near.join(label, "id", "left").join(label.withColumnsRenamed({"id": "g", "label": "gl"}), "g", "left")
    # who is linked with a hub counts as of its component
    named = named.withColumn("gl", F.coalesce("gl", "g")).withColumn("label", F.when(F.col("linked"), F.col("gl")).otherwise(F.coalesce("label", "id")))
    named = named.withColumn("core", F.col("label") == F.col("gl")).drop("gl")
    slack = F.floor(F.col("n") * (100 - percent) / percent)
    core = F.col("core")
    limits = named.groupBy("g").agg(F.max(F.when(core, F.col("d"))).alias("core_most"), F.min(F.when(core, F.col("d"))).alias("core_least"), F.min(F.when(~core, F.col("d"))).alias("guest_least"))
    # who may be a partner, and the least that a partner deviates
    inside = (F.col("d") - slack <= F.col("core_most")) & (F.col("core_least") <= F.col("d") + slack)
    least = F.when(core, F.col("guest_least")).when(F.col("both"), F.least(F.when(inside, F.col("core_least")), F.col("guest_least"))).when(inside, F.col("core_least"))
    able = named.join(limits, "g").withColumn("reach", F.least(slack, F.floor((F.col("d") - least + slack) / 2)) + 1).where("reach >= 1")
    every = able.select("g", "id", "n", "d", "label", "core", "both", "reach", F.explode("items").alias("item"))
    partner = F.col("core") | F.col("both")
    often = every.groupBy("g", "item").agg(F.count(F.lit(1)).alias("f"), F.min("label").alias("x"), F.max("label").alias("y"), F.max(partner).alias("p"), F.min("core").alias("q")).where("x <> y and p and not q").select("g", "item", "f")
    # shingles that no two sides share come first in the order, then the rarest
    row = W.partitionBy("g", "id")
    rank = F.col("d") - F.count(F.lit(1)).over(row) + F.row_number().over(row.orderBy("f", "item"))
    entries = tables.keep(every.join(often, ["g", "item"]).withColumn("rank", rank).where("rank <= reach").drop("f", "reach"), "entries")
    other = entries.where("core or both").select("g", "item", *(F.col(k).alias(v) for k, v in _PARTNER.items()))
    must = F.ceil((F.col("d") + F.col("cd") - F.floor((F.col("n") + F.col("cn")) * (100 - percent) / (100 + percent))) / 2)
    allowed = (F.col("label") != F.col("cl")) & (F.col("cc") | (F.col("both") & (F.col("id") < F.col("c"))))
    close = F.least("n", "cn") * 100 >= F.greatest("n", "cn") * percent
    early = (F.col("rank") <= F.col("d") - must + 1) & (F.col("cr") <= F.col("cd") - must + 1)
    met = entries.where("not core").join(other, ["g", "item"]).where(allowed & close & early)
    return met.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()


def _repeated(some: DataFrame, classes: DataFrame, digest: list[str]) -> DataFrame:
    """Links between the classes of different texts that stand under one id."""
    shared = some.groupBy("doc_id").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("doc_id")
    rows = some.select("doc_id", *digest).join(shared, "doc_id", "left_semi")
    return rows.join(classes.select(*digest, "id"), digest).select(_node(F.col("doc_id")).alias("a"), F.col("id").alias("b")).distinct()
