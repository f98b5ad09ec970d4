"""Near-duplicate documents by Jaccard similarity of their word n-grams.

Documents and n-grams form a sparse 0/1 matrix; the product with its transpose
holds the overlaps. It is computed in blocks, and only where it can matter:

* equal sets are one class, so copies make no pairs;
* n-grams are ordered, those of many documents last; of each set only the first
  few are multiplied, as many as any partner must share one of. They are the
  postings, dealt out by n-gram, and n-grams of one class are dropped;
* overlaps over the postings are added up per pair, and pairs whose sizes leave
  no room for the overlap they still need are discarded;
* the rest is verified with the whole sets.

A group of many near copies would still have links between all its members.
Only connectivity is asked for, so a first round multiplies the classes of a
posting with a few hubs only, joins what links, and a second round multiplies
all classes that are still apart. Large postings are multiplied in blocks of
bounded size.

Defined results: documents without words have an empty set and link with
nothing; with fewer words than n the whole sequence is the one n-gram. Rows
without an id link with nothing and have no component. Rows with the same id
count as one document for components, if their sets are equal, and as linked
otherwise. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.llm.arrays import Slice, mix, shingles, text_buffer, texts_in
from treelens.llm.graph import components
from treelens.operators.workspace import written


# Buckets whose counts bound an overlap from above; a count of MANY bounds nothing.
BUCKET_BITS, MANY = 5, 255
BUCKETS = 1 << BUCKET_BITS


@dataclass(frozen=True)
class JaccardRules:
    """n, the least similarity in percent, and sizes that only shape the work.

    `common_*` set which n-grams are known to be common, for the order and for
    dealing them out; `block` is the most classes multiplied at once; `hubs` is
    how many of a posting the first round multiplies the others with; `listed`
    is the most rows of ids that are sent to all tasks instead of shuffled;
    `pairs_held` is how many pairs a task adds up before it hands them on.
    """

    n: int = 4
    percent: int = 85
    common_texts: int = 32
    common_listed: int = 100_000
    block: int = 1024
    hubs: int = 32
    listed: int = 1_000_000
    pairs_held: int = 400_000


def listed(df: DataFrame, rules: JaccardRules) -> DataFrame:
    """A written table of ids, marked for broadcast if it is known to be small."""
    return F.broadcast(df) if df.count() <= rules.listed else df


# ---- sets of n-grams ----


def grams(part: Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, sorted within each text, and where each text's begin."""
    words = part.words()
    hashes = part.hashes(words)
    counts = np.bincount(words.text, minlength=part.count)
    values, owners = [], []
    for k in range(1, n + 1):
        chosen = counts[words.text] == k if k < n else counts[words.text] >= n
        value, place = shingles(hashes[chosen], words.text[chosen], k)
        values.append(value)
        owners.append(words.text[chosen][place])
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.append(True, (np.diff(owner) != 0) | (value[1:] != value[:-1])) if len(value) else np.zeros(0, bool)
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(part.count + 1))


def set_ids(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; equal sets have equal ids."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    sums = total[bounds[1:]] - total[bounds[:-1]]
    return mix(sums + np.diff(bounds).astype(np.uint64)).view(np.int64)


def bucket_counts(value: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """How many n-grams of each set fall into each of some buckets, a byte each, 255 for any more."""
    n = np.diff(bounds)
    place = np.repeat(np.arange(len(n)), n) * BUCKETS + (value >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    counts = np.minimum(np.bincount(place, minlength=BUCKETS * len(n)), MANY).astype(np.uint8)
    ends = np.arange(len(n) + 1, dtype=np.int32) * BUCKETS
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(counts.tobytes())])


def most_in_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest overlap that the bucket counts of two sets each leave room for."""
    least = np.minimum(a, b)
    return least.sum(1, dtype=np.int64) + (least == MANY).any(1) * (1 << 40)


def sets_of(documents: DataFrame, rules: JaccardRules) -> DataFrame:
    """`doc_id`, `id` of its set, `n` of its n-grams, their `counts` by buckets; and `common` n-grams
    of a task, on rows without id.

    Counts over a task need not be exact: they only shape the order of n-grams.
    """
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    schema = "doc_id long, id long, n long, counts binary, gram long, texts long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "id", "n", "counts", "gram", "texts"]
        for batch in batches:
            often: list[np.ndarray] = []
            for first, last, part in texts_in(batch.column(1), lower=True):
                value, bounds = grams(part, rules.n)
                size = last - first
                arrays = [
                    batch.column(0).slice(first, size),
                    pa.array(set_ids(value, bounds)),
                    pa.array(np.diff(bounds)),
                    bucket_counts(value, bounds),
                    pa.nulls(size, pa.int64()),
                    pa.nulls(size, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names)
                ordered = np.sort(value)
                # Four or more equal ones in a row of the sorted hashes.
                if len(ordered) > 3:
                    often.append(ordered[3:][ordered[3:] == ordered[:-3]])
            if often:
                gram, n = np.unique(np.concatenate(often), return_counts=True)
                nothing = pa.nulls(len(gram), pa.int64())
                none = pa.nulls(len(gram), pa.binary())
                arrays = [nothing, nothing, nothing, none, pa.array(gram.view(np.int64)), pa.array(n + 3)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return source.mapInArrow(run, schema)


def common_grams(scanned: DataFrame, rules: JaccardRules) -> tuple[np.ndarray, np.ndarray]:
    """The commonest n-grams, sorted, with about how many texts have them; a bounded list."""
    counted = scanned.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("texts").alias("texts"))
    rows = counted.where(F.col("texts") >= rules.common_texts).orderBy(F.desc("texts"), "gram").limit(rules.common_listed)
    found = rows.collect()
    gram = np.array([r.gram for r in found], dtype=np.int64).view(np.uint64)
    texts = np.array([r.texts for r in found], dtype=np.int64)
    order = np.argsort(gram)
    return gram[order], texts[order]


# ---- postings ----


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of `n` with any partner."""
    return -(-percent * n // 100)


def level_of(value: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How common each n-gram is, in powers of two and in texts; 0 if it is not known to be."""
    gram, texts = common
    if not len(gram):
        return np.zeros(len(value), np.int64), np.zeros(len(value), np.int64)
    at = np.minimum(np.searchsorted(gram, value), len(gram) - 1)
    n = np.where(gram[at] == value, texts[at], 0)
    return np.ceil(np.log2(n + 1)).astype(np.int64), n


def postings(documents: DataFrame, common: tuple[np.ndarray, np.ndarray], rules: JaccardRules) -> DataFrame:
    """`gram`, `id`, `n` for the first n-grams of every set, of n-grams that two classes have."""
    source = documents.where("doc_id IS NOT NULL").select(F.col("text").cast("string"))
    send = documents.sparkSession.sparkContext.broadcast(common)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part in texts_in(batch.column(0), lower=True):
                value, bounds = grams(part, rules.n)
                n = np.diff(bounds)
                ids = set_ids(value, bounds)
                # Copies within the slice need not be sent again.
                first = np.zeros(len(ids), bool)
                first[np.unique(ids, return_index=True)[1]] = True
                owner = np.repeat(np.arange(len(n)), n)
                level, texts = level_of(value, send.value)
                order = np.lexsort((value, level, owner))
                rank = np.arange(len(value)) - np.repeat(bounds[:-1], n)
                prefix = n - needed(n, rules.percent) + 1
                keep = order[(rank < prefix[owner]) & first[owner]]
                # A common n-gram is dealt out over several tasks by set.
                parts = 1 + texts[keep] // 512
                mine = owner[keep]
                arrays = [
                    pa.array(value[keep].view(np.int64)),
                    pa.array(ids[mine]),
                    pa.array(n[mine].astype(np.int32)),
                    pa.array(((ids[mine] % parts) * (parts > 1) + (parts > 1)).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["gram", "id", "n", "salt"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of n-grams with two ids or more, from rows sorted by n-gram and id."""
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            gram = table.column("gram").to_numpy()
            # The last n-gram may go on in the next batch.
            cut = int(np.searchsorted(gram, gram[-1], "left")) if len(gram) else 0
            yield from several(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield from several(held)

    def several(table: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, ids, salt = (table.column(c).to_numpy() for c in ("gram", "id", "salt"))
        if not len(gram):
            return
        new = np.append(True, (gram[1:] != gram[:-1]) | (ids[1:] != ids[:-1]))
        gram, salt, rows = gram[new], salt[new], np.flatnonzero(new)
        same = gram[1:] == gram[:-1]
        keep = np.append(same, False) | np.insert(same, 0, False) | (salt > 0)
        yield from table.select(["gram", "id", "n"]).take(pa.array(rows[keep])).combine_chunks().to_batches()

    emitted = source.mapInArrow(emit, "gram long, id long, n int, salt int")
    dealt = emitted.repartition("gram", "salt").sortWithinPartitions("gram", "id")
    return dealt.mapInArrow(shared, "gram long, id long, n int")


def placed(posted: DataFrame) -> DataFrame:
    """Postings with the `place` of their class: those that share most with others come first.

    Of near copies this is the text they were made from, which has more in common
    with each of them than they have with each other.
    """
    sizes = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("classes"))
    shares = posted.join(sizes, "gram").groupBy("id").agg((-F.sum("classes")).alias("place"))
    return posted.join(shares, "id")


# ---- pairs ----


def promising(pairs: DataFrame, rules: JaccardRules) -> DataFrame:
    """Pairs whose counted overlap `c`, with all that their postings leave out, may be enough."""
    left = [F.ceil(F.lit(rules.percent) * F.col(n) / 100) - 1 for n in ("n_a", "n_b")]
    enough = (F.col("c") + F.greatest(*left)) * (100 + rules.percent) >= rules.percent * (F.col("n_a") + F.col("n_b"))
    return pairs.where(enough)


class Overlaps:
    """Overlaps of pairs, added up in a bounded table."""

    NAMES = ["a", "n_a", "b", "n_b", "c"]

    def __init__(self, most: int):
        self.most, self.parts, self.size = most, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Take pairs; gives rows back if there are too many different ones."""
        if len(columns[0]):
            self.parts.append(pa.table(list(columns), self.NAMES))
            self.size += len(columns[0])
        if self.size > 2 * self.most:
            self._combine()
            if self.size > self.most:
                yield from self.taken()

    def _combine(self) -> None:
        total = pa.concat_tables(self.parts).group_by(self.NAMES[:4]).aggregate([("c", "sum")])
        total = total.rename_columns([*self.NAMES[:4], "c"]).select(self.NAMES)
        self.parts, self.size = [total], total.num_rows

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._combine()
            yield from self.parts[0].combine_chunks().to_batches(max_chunksize=1 << 16)
        self.parts, self.size = [], 0


def multiplied(
    posted: DataFrame, labels: DataFrame | None, classes: DataFrame | None, rules: JaccardRules
) -> DataFrame:
    """Promising pairs `a` < `b` of classes with different labels in a posting.

    Without labels, each class is only multiplied with the hubs of its posting, the
    first by `place`: a class has few pairs then, however many near copies it has.
    With labels, pairs whose bucket counts (of `classes`) leave no room for the
    overlap that their sizes ask for are dropped at once.
    """
    most = rules.hubs if labels is None else None
    if labels is None:
        known = posted.select(
            "gram", "id", "n", "place", F.col("id").alias("label"), F.lit(None).cast("binary").alias("counts")
        )
    else:
        told = classes.join(labels, classes["id"] == labels["node"], "left").select(
            "id", F.coalesce("component", "id").alias("label"), "counts"
        )
        known = posted.join(told, "id").select("gram", "id", "n", "place", "label", "counts")
    mixed = (
        known.groupBy("gram")
        .agg(
            F.min("label").alias("low"),
            F.max("label").alias("high"),
            F.min(F.struct("place", "id"))["id"].alias("first"),
            F.count(F.lit(1)).alias("m"),
        )
        .where("low <> high")
        .select("gram", "first", F.ceil(F.col("m") / rules.block).cast("int").alias("blocks"))
    )
    rows = known.join(mixed, "gram")
    mine = F.when(F.col("id") == F.col("first"), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    if labels is None:
        # The hubs are in the first block.
        others = F.when(F.col("mine") == 0, others).otherwise(F.array(F.lit(0)))
    spread = rows.withColumn("mine", mine).select("*", F.explode(others).alias("other"))
    keyed = spread.select(
        "first",
        "gram",
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
        (F.col("mine") <= F.col("other")).alias("left"),
        "place",
        "id",
        "n",
        "label",
        "counts",
    )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of each block with their overlaps, from rows sorted by block.

        Overlaps are added up over all the blocks of a task as long as its
        pairs are not too many, so a pair leaves a task about once.
        """
        held: pa.Table | None = None
        sums = Overlaps(rules.pairs_held)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            key = [table.column(c).to_numpy() for c in ("gram", "i", "j")]
            starts = np.append(0, 1 + np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)))
            yield from products(table, starts, sums)
            held = table.slice(starts[-1])
        if held is not None:
            yield from products(held, np.array([0, held.num_rows]), sums)
        yield from sums.taken()

    def products(table: pa.Table, starts: np.ndarray, sums: Overlaps) -> Iterator[pa.RecordBatch]:
        if len(starts) < 2:
            return
        ids, n, label = (table.column(c).to_numpy() for c in ("id", "n", "label"))
        room = None
        if most is None:
            room = text_buffer(table.column("counts").combine_chunks())[0].reshape(-1, BUCKETS)
        left = table.column("left").to_numpy(zero_copy_only=False)
        diagonal = table.column("i").to_numpy() == table.column("j").to_numpy()
        # N-grams of one passage have the same list of classes: it is multiplied once, for all of them.
        sides = mix(ids.view(np.uint64) * np.uint64(2) + left)
        lists = np.add.reduceat(sides, starts[:-1])
        kind = np.stack([lists, np.diff(starts).astype(np.uint64), diagonal[starts[:-1]].astype(np.uint64)], 1)
        _, chosen, weights = np.unique(kind, axis=0, return_index=True, return_counts=True)
        for block, weight in zip(chosen, weights, strict=True):
            first, last = starts[block], starts[block + 1]
            own = np.arange(first, last)
            a, b = (own, own) if diagonal[first] else (own[left[first:last]], own[~left[first:last]])
            a = a[:most]
            for at in range(0, len(b), 256):
                p, q = np.meshgrid(a, b[at : at + 256], indexing="ij")
                apart = (label[p] != label[q]) & (p < q if diagonal[first] else True)
                fits = 100 * np.minimum(n[p], n[q]).astype(np.int64) >= rules.percent * np.maximum(n[p], n[q]).astype(np.int64)
                p, q = p[apart & fits], q[apart & fits]
                if room is not None:
                    need = rules.percent * (n[p].astype(np.int64) + n[q])
                    enough = (100 + rules.percent) * most_in_common(room[p], room[q]) >= need
                    p, q = p[enough], q[enough]
                swap = ids[p] > ids[q]
                p, q = np.where(swap, q, p), np.where(swap, p, q)
                yield from sums.add(ids[p], n[p], ids[q], n[q], np.full(len(p), weight, np.int64))

    # N-grams of one passage have about the same classes: dealt out by their first hub
    # they meet in a task, which adds their overlaps up before they are shuffled.
    order = ["first", "i", "j", "gram", "place", "id"]
    blocks = keyed.repartition("first", "i", "j").sortWithinPartitions(*order).drop("first", "place")
    pairs = blocks.mapInArrow(multiply, "a long, n_a int, b long, n_b int, c long")
    counted = pairs.groupBy("a", "b", "n_a", "n_b").agg(F.sum("c").alias("c"))
    return promising(counted, rules).select("a", "b")


# ---- verification with whole sets ----


def verified(pairs: DataFrame, classes: DataFrame, documents: DataFrame, rules: JaccardRules) -> DataFrame:
    """The pairs of class ids `a`, `b` whose whole sets are similar enough.

    Texts of the classes in pairs are brought together by `a`, in parts, and
    each part holds one set while it reads the others.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("parts"))
    salted = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    members = salted.select(F.col("b").alias("id"), "a", "part")
    heads = parts.select(
        F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    wanted = members.unionByName(heads).join(classes, "id").select("doc_id", "id", "a", "part")
    wanted = written(wanted, "wanted")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(listed(wanted, rules), "doc_id").select("a", "part", "id", "text")
    order = F.when(F.col("id") == F.col("a"), 0).otherwise(1)
    together = rows.withColumn("member", order).repartition("a", "part").sortWithinPartitions("a", "part", "member")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, whole = None, np.zeros(0, np.uint64)
        for batch in batches:
            hub, ids = (batch.column(k).to_numpy() for k in (0, 2))
            a, b = [], []
            for first, last, part in texts_in(batch.column(3), lower=True):
                value, bounds = grams(part, rules.n)
                own = set_ids(value, bounds)
                for k in range(last - first):
                    if own[k] != ids[first + k]:
                        continue  # another row with the same document id
                    mine = value[bounds[k] : bounds[k + 1]]
                    if ids[first + k] == hub[first + k]:
                        head, whole = hub[first + k], mine
                    elif head == hub[first + k]:
                        # Both are sorted: find one in the other.
                        at = np.minimum(np.searchsorted(whole, mine), len(whole) - 1)
                        overlap = int((whole[at] == mine).sum())
                        if (100 + rules.percent) * overlap >= rules.percent * (len(whole) + len(mine)):
                            a.append(head)
                            b.append(ids[first + k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return together.select("a", "part", "id", "text").mapInArrow(compare, "a long, b long").distinct()


def near_documents(documents: DataFrame, rules: JaccardRules | None = None) -> DataFrame:
    """`doc_id`, `n_shingles`, and the smallest id of the documents that links lead to."""
    rules = rules or JaccardRules()
    scanned = written(sets_of(documents, rules), "sets")
    rows = scanned.where("id IS NOT NULL").select("doc_id", "id", "n")
    classes = written(
        scanned.where("doc_id IS NOT NULL AND n > 0")
        .groupBy("id")
        .agg(F.min("doc_id").alias("doc_id"), F.min("counts").alias("counts")),
        "classes",
    )
    posted = written(postings(documents, common_grams(scanned, rules), rules), "postings")
    posted = written(placed(posted), "postings")
    tried = written(multiplied(posted, None, None, rules), "pairs")
    links = written(verified(tried, classes, documents, rules), "verified")
    labels = components(links)
    rest = written(multiplied(posted, labels, classes, rules).join(tried, ["a", "b"], "left_anti"), "pairs")
    more = verified(rest, classes, documents, rules)
    # Rows with one id are one document, whatever their sets.
    several = rows.where("doc_id IS NOT NULL AND n > 0").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    joined = labels.select(F.col("component").alias("a"), F.col("node").alias("b"))
    labels = components(joined.unionByName(more).unionByName(several.where("a <> b").select("a", "b")))
    named = classes.join(labels, classes["id"] == labels["node"], "left").select(
        classes["id"], "doc_id", F.coalesce("component", "id").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = written(named.join(smallest, "root").select("id", "component_id"), "components")
    return rows.join(found, "id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def near_dedup_stage(documents: DataFrame, rules: JaccardRules | None = None) -> DataFrame:
    """The document with the smallest id of each component; same columns.

    Rows that repeat an id are one document, of which the row with the smallest
    hash of its text, then text, then hash of the row stays.
    """
    rules = rules or JaccardRules()
    found = near_documents(documents, rules)
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "removed")
    twice = written(
        documents.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated"
    )
    kept = documents.join(listed(gone, rules), "doc_id", "left_anti")
    if twice.isEmpty():
        return kept.select(*documents.columns)
    single = kept.join(listed(twice, rules), "doc_id", "left_anti").select(*documents.columns)
    doubled = kept.join(listed(twice, rules), "doc_id", "left_semi")
    columns = [F.col(f"`{name}`") for name in documents.columns]
    order = F.struct(F.xxhash64("text"), F.col("text"), F.xxhash64(*columns))
    first = doubled.groupBy("doc_id").agg(F.min_by(F.struct(*columns), order).alias("row"))
    return single.unionByName(first.select("row.*"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
