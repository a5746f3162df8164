"""N-gram Jaccard join by vertical partitioning, and the classes of linked documents.

All n-grams stand in one global order, rare ones first, which is cut into fragments. The
overlap of a pair of documents is counted fragment by fragment and summed per pair.

Which pairs are counted follows from the same order: two sets of the wanted similarity share
an n-gram among the first quarter of both. Documents with equal sets are one. Where few
documents share such an n-gram all their pairs are candidates. Where many do, each is paired
with one of them first, then with a few more, then with the one of some hundred that is likeliest
by its sketch; links found so join most of them into classes, and
only pairs across classes are left, which are then candidates too, unless a sketch of both sets shows that they
differ in too much: a bit for each share of the n-grams, set when the set has an odd number
of them, differs for at most as many shares as there are n-grams in one set only. The sets of a pair
are sent and counted only if longer sketches, which grow with the set, do not rule it out
either. So no link is lost, and a large group of near copies never becomes all of its pairs. Before an n-gram that many documents of a task
share is shuffled, it is cut down to one row of that task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import remove, sized, spread_left_join, stored, sweep
from scriptloom.llm.components import components
from scriptloom.llm.words import chunks, mixed, shingle_sets

WORDS = 5
#: Least similarity, in hundredths.
PERCENT = 75
#: Slots of the table of frequent n-grams, how many of them may be used, and the least count.
SLOTS = 1 << 20
USED_SLOTS = 1 << 18
FREQUENT = 8
#: Documents up to which all pairs that share an early n-gram are candidates.
FEW = 8
#: Early n-grams that are gathered in a task before they are sent, and in a bucket.
WINDOW = 2_000_000
BUCKET_ENTRIES = 1 << 19
#: Ranges that the rare n-grams, and at most those that the frequent ones, are cut into.
RARE_FRAGMENTS = 4
#: Documents of each shared early n-gram that the others are compared with before all pairs across classes are.
PIVOTS = 4
#: Documents among which the likeliest partner of another class is looked for, about and at most twice that.
GROUP = 512
LEVELS_PER_FRAGMENT = 3

_POS = 32767
_FLAG = 1 << 15
_ENTRY = np.dtype([("token", "<u4"), ("row", "<i8"), ("code", "<u2"), ("pos", "<u2")])
#: Bits of the sketch of a set, and the numbers that hold them.
SKETCH_BITS = 1024
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]
_OUT = "kind int, a long, b long, c long, d long, doc_id {id}, blob binary, sketch array<long>"


def _set_digest(tokens: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        one = mixed(tokens ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64)
        two = mixed(tokens + np.uint64(0x1234567)).sum(dtype=np.uint64)
    return int(np.array(one).view(np.int64)), int(np.array(two).view(np.int64))


def _marks(tokens: np.ndarray) -> np.ndarray:
    """For each share of the n-grams, whether the set has an odd number of them, as bits.

    There are at least two shares for each n-gram, so that sets of any size can be told apart.
    """
    bits = max(SKETCH_BITS, 1 << max(0, 2 * len(tokens) - 1).bit_length())
    share = ((tokens >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(share, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _folded(marks: np.ndarray, words: int) -> np.ndarray:
    """The marks as those of fewer shares: a share is odd when one of the two it holds is."""
    while len(marks) > words:
        marks = marks[: len(marks) // 2] ^ marks[len(marks) // 2 :]
    return marks


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """The marks of a set, folded to SKETCH_BITS."""
    return _folded(_marks(tokens), SKETCH_BITS // 64)


def _least_shared(both, percent: int):
    """How many n-grams similar sets share at least, when they have so many together. Works on numpy arrays too."""
    return -(-both * percent // (100 + percent))


def _may_link(n_a: int, n_b: int, a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """False when no similar sets have these sizes, or when their marks differ in more bits than those of such sets can."""
    words = min(len(a), len(b))
    shared = _least_shared(n_a + n_b, percent)
    if min(n_a, n_b) < shared:
        return False  # before the marks, as those of a small set tell nothing about a large one
    return int(np.bitwise_count((_folded(a, words) ^ _folded(b, words)).view(np.uint64)).sum()) <= n_a + n_b - 2 * shared


def _differ() -> Column:
    """The number of bits in which the sketches of a and b differ."""
    return sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SKETCH), F.lit(0))


def _too_different(percent: int) -> Column:
    """True when no similar sets have the sizes of a and b, or when their sketches differ in more bits than those of such sets can."""
    both = F.col("n_a") + F.col("n_b")
    shared = F.ceil(both * percent / (100 + percent) - 1e-9)
    return (F.least("n_a", "n_b") < shared) | (_differ() > both - 2 * shared)


def _usual(differ: np.ndarray) -> np.ndarray:
    """The most bits in which the sketches of sets that differ in so many n-grams do differ, but for one pair in some hundred.

    Many n-grams that differ fall on the same bit, so that it is no longer one bit for each.
    """
    share = (1 - np.exp(-2 * differ / SKETCH_BITS)) / 2
    return SKETCH_BITS * share + 3 * np.sqrt(SKETCH_BITS * share * (1 - share))


def frequent_levels(docs: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """For each slot the binary logarithm of its most frequent n-gram's count, or 0, and all n-grams.

    N-grams of two and more documents of a task are counted, over all documents. The table
    has a fixed size: with more frequent n-grams only the most frequent keep a level. It
    shapes the global order and so the cost, never the result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, 0

        def flush():
            joined = np.concatenate(held)
            held.clear()
            tokens, n = np.unique(joined, return_counts=True)
            often = n >= 2
            return pa.RecordBatch.from_arrays(
                [pa.array(tokens[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"]
            )

        seen: set = set()
        for batch in chunks(batches, "text"):
            for tokens in shingle_sets(batch.column("text"), words):
                total += len(tokens)
                if len(tokens) and (digest := _set_digest(tokens)) not in seen:
                    seen.add(digest)
                    held.append(tokens)
                    size += len(tokens)
                if size >= 2 * WINDOW:
                    yield flush()
                    held, size = [], 0
                    seen.clear()
        if held:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total], pa.int64())], ["token", "n"])

    counts, path = stored(
        docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        .where(f"token is null or n >= {FREQUENT}"),
        "ngram-counts",
    )
    total = counts.where("token is null").agg(F.sum("n").alias("n")).first()["n"] or 0
    slots = (
        counts.where("token is not null")
        .groupBy(F.pmod("token", F.lit(SLOTS)).cast("int").alias("slot"))
        .agg(F.floor(F.log2(F.max("n"))).cast("int").alias("level"))
    )
    by_level = {r["level"]: r["n"] for r in slots.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    floor, used = 64, 0
    for level in sorted(by_level, reverse=True):
        if (used := used + by_level[level]) > USED_SLOTS:
            break
        floor = level
    found = slots.where(F.col("level") >= floor).toArrow()
    levels = np.zeros(SLOTS, np.uint8)
    levels[found.column("slot").to_numpy()] = found.column("level").to_numpy()
    remove(docs.sparkSession, path)
    return levels, total


def _passes(code_a, pos_a, code_b, pos_b, percent: int):
    """Whether a pair that first meets at these positions can still be similar enough.

    Sizes are known to a 64th of a power of two and positions to a 32767th of the set, both
    rounded to the safe side. Works on numpy arrays and on columns.
    """
    share = percent / (100 + percent)
    low = 2.0 ** ((code_b - code_a - 1) / 64.0)
    high = 2.0 ** ((code_b - code_a + 1) / 64.0)
    left_a = 1 - pos_a / float(_POS)
    left_b = 1 - pos_b / float(_POS)
    slack = 1e-9
    return (left_a + slack >= share * (1 + low)) & (left_b + slack >= share * (1 + 1 / high))


def _arrays(entries: np.ndarray):
    return entries["code"].astype(np.float64), (entries["pos"] & (_FLAG - 1)).astype(np.float64)


def _pairs(entries: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    code, pos = _arrays(entries)
    ok = _passes(code[i], pos[i], code[j], pos[j], percent) & (entries["row"][i] != entries["row"][j])
    a, b = entries["row"][i[ok]], entries["row"][j[ok]]
    return np.stack([np.maximum(a, b), np.minimum(a, b)], 1)


def _split(entries: np.ndarray, keys: np.ndarray):
    """Runs of equal keys: the run of each entry, lengths, and a pivot: the least row of each."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    length = np.diff(np.append(edge, len(keys)))
    run = np.repeat(np.arange(len(edge)), length)
    order = np.lexsort((entries["row"], run))
    return run, length, order[edge]


def _frame(kind: int, n: int, id_type: pa.DataType, **columns) -> pa.RecordBatch:
    """A batch of the mixed output; columns that are not given are null."""
    made = {"kind": pa.array(np.full(n, kind, np.int32)), **columns}
    types = {"kind": pa.int32(), "doc_id": id_type, "blob": pa.binary(), "sketch": pa.list_(pa.int64())}
    names = ["kind", "a", "b", "c", "d", "doc_id", "blob", "sketch"]
    arrays = [made[x] if x in made else pa.nulls(n, types.get(x, pa.int64())) for x in names]
    return pa.RecordBatch.from_arrays(arrays, names)


def _long_frames(keys: np.ndarray, entries: np.ndarray, id_type) -> pa.RecordBatch:
    return _frame(
        3,
        len(entries),
        id_type,
        a=pa.array(keys.view(np.int64)),
        b=pa.array(np.ascontiguousarray(entries["row"])),
        c=pa.array(entries["code"].astype(np.int64)),
        d=pa.array((entries["pos"] & (_FLAG - 1)).astype(np.int64)),
    )


def _pair_frames(pairs: list[np.ndarray], id_type) -> Iterator[pa.RecordBatch]:
    pairs = [p for p in pairs if len(p)]
    if pairs:
        both = np.unique(np.concatenate(pairs), axis=0)
        yield _frame(2, len(both), id_type, a=pa.array(both[:, 0].copy()), b=pa.array(both[:, 1].copy()))


def _index(docs: DataFrame, levels: np.ndarray, buckets: int, words: int, percent: int) -> DataFrame:
    """One pass over the texts: a row per document, early n-grams by bucket, local candidates."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    id_field = docs.schema["doc_id"].dataType

    def flush(keys, parts, id_type):
        # What is gathered is not kept beside what is made of it.
        token = np.concatenate(keys)
        keys.clear()
        entries = np.concatenate(parts)
        parts.clear()
        # From here on an n-gram is its bucket and its lower half, as it is where buckets meet.
        bucket = ((token >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        token = (bucket << np.uint64(32)) | (token & np.uint64(0xFFFFFFFF))
        order = np.argsort(token, kind="stable")
        token, entries, bucket = token[order], entries[order], bucket[order]
        run, length, pivot = _split(entries, token)
        many = length[run] > FEW
        own = pivot[run]
        lead = np.zeros(len(token), bool)
        lead[pivot] = True
        rest = np.flatnonzero(many & ~lead)
        yield from _pair_frames([_pairs(entries, rest, own[rest], percent)], id_type)
        if len(rest):
            yield _long_frames(token[rest], entries[rest], id_type)
        entries["pos"][many & lead] |= _FLAG
        stay = ~many | lead
        entries, bucket = entries[stay], bucket[stay]
        cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        used = np.flatnonzero(cut[1:] > cut[:-1])
        # Columns apart: that compresses better than entries one by one.
        blobs = [b"".join(entries[n][cut[k] : cut[k + 1]].tobytes() for n in _ENTRY.names) for k in used]
        yield _frame(1, len(used), id_type, d=pa.array(used.astype(np.int64)), blob=pa.array(blobs, pa.binary()))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        task = TaskContext.get().partitionId() << 32
        number, keys, parts, size, seen = 0, [], [], 0, set()
        id_type = pa.int64()
        for batch in chunks(batches, "text"):
            id_type = batch.column("doc_id").type
            rows, ones, twos, sizes, sketches, marks = [], [], [], [], [], []
            for tokens in shingle_sets(batch.column("text"), words):
                n = len(tokens)
                row = task + number
                number += 1
                one, two = _set_digest(tokens) if n else (0, 0)
                rows.append(row), ones.append(one), twos.append(two), sizes.append(n)
                marks.append(_marks(tokens))
                sketches.append(_folded(marks[-1], SKETCH_BITS // 64))
                marks[-1] = marks[-1].tobytes()
                if not n or (one, two) in seen:
                    continue
                seen.add((one, two))
                early = n - (n * percent + 99) // 100 + 1
                level = table[(tokens & np.uint64(SLOTS - 1)).astype(np.int64)]
                first = np.argsort(level, kind="stable")[:early]
                entry = np.empty(early, _ENTRY)
                entry["token"] = (tokens[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                entry["row"] = row
                entry["code"] = int(np.floor(64 * np.log2(n)))
                entry["pos"] = np.arange(early) * _POS // n
                keys.append(tokens[first]), parts.append(entry)
                size += early
            yield _frame(
                0, len(rows), id_type, a=pa.array(rows, pa.int64()), b=pa.array(ones, pa.int64()),
                c=pa.array(twos, pa.int64()), d=pa.array(sizes, pa.int64()), doc_id=batch.column("doc_id"),
                blob=pa.array(marks, pa.binary()), sketch=pa.array(sketches, pa.list_(pa.int64())),
            )
            if size >= WINDOW:
                yield from flush(keys, parts, id_type)
                keys, parts, size = [], [], 0
                seen.clear()
        if size:
            yield from flush(keys, parts, id_type)

    return docs.select("doc_id", "text").mapInArrow(index, _OUT.format(id=id_field.simpleString()))


def _meet(blobs: DataFrame, percent: int) -> DataFrame:
    """Candidates among the early n-grams of each bucket, and the rows of n-grams of many."""

    def decode(blob: bytes) -> np.ndarray:
        n = len(blob) // _ENTRY.itemsize
        entries, at = np.empty(n, _ENTRY), 0
        for name in _ENTRY.names:
            width = _ENTRY[name].itemsize * n
            entries[name] = np.frombuffer(blob, _ENTRY[name], n, at)
            at += width
        return entries

    def meet(batches: pa.Table) -> pa.Table:
        id_type = pa.int64()
        entries = np.concatenate([decode(b) for b in batches.column("blob").to_pylist()])
        bucket = np.uint64(batches.column("d")[0].as_py())
        entries = entries[np.lexsort((entries["row"], entries["token"]))]
        keys = (bucket << np.uint64(32)) | entries["token"].astype(np.uint64)
        # Rows from different windows of a task can repeat; which n-gram was cut down is a flag.
        run, length, pivot = _split(entries, keys)
        flagged = np.zeros(len(length), bool)
        flagged[run[(entries["pos"] & _FLAG) > 0]] = True
        many = (flagged | (length > FEW))[run]
        pairs = []
        for k in range(1, FEW):
            i = np.flatnonzero((run[k:] == run[:-k]) & ~many[k:])
            if len(i):
                pairs.append(_pairs(entries, i, i + k, percent))
        rest = np.flatnonzero(many)
        pairs.append(_pairs(entries, rest, pivot[run[rest]], percent))
        out = [*_pair_frames(pairs, id_type)]
        if len(rest):
            out.append(_long_frames(keys[rest], entries[rest], id_type))
        if not out:
            out = [_frame(2, 0, id_type)]
        return pa.Table.from_batches(out).select(["kind", "a", "b", "c", "d"])

    return blobs.select("d", "blob").groupBy("d").applyInArrow(meet, "kind int, a long, b long, c long, d long")


def _fragments(docs: DataFrame, needed: DataFrame, levels: np.ndarray, words: int) -> DataFrame:
    """(row, fragment, tokens): the sets of the needed rows, cut along the global order."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    wanted = needed.withColumnRenamed("doc_id", "_id")
    texts = docs.select("doc_id", "text").join(sized(wanted), F.col("doc_id").eqNullSafe(F.col("_id"))).select("row", "one", "two", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in chunks(batches, "text"):
            rows, parts, blobs = [], [], []
            known = zip(batch.column("row").to_pylist(), batch.column("one").to_pylist(), batch.column("two").to_pylist())
            for tokens, (row, one, two) in zip(shingle_sets(batch.column("text"), words), known):
                if not len(tokens) or _set_digest(tokens) != (one, two):
                    continue  # another text with the same id
                level = table[(tokens & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.int64)
                quarter = (tokens >> np.uint64(62)).astype(np.int64) * RARE_FRAGMENTS // 4
                part = np.where(level == 0, quarter, RARE_FRAGMENTS + level // LEVELS_PER_FRAGMENT)
                for p in np.unique(part).tolist():
                    rows.append(row), parts.append(p), blobs.append(tokens[part == p].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())],
                ["row", "fragment", "tokens"],
            )

    return texts.mapInArrow(cut, "row long, fragment int, tokens binary")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """The pairs (a, b) that the marks of their sets do not tell apart.

    The marks of a set take a 32nd of its n-grams, so that those of most false candidates are
    never sent.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist())
            marks = zip(batch.column("marks_a"), batch.column("marks_b"))
            keep = [
                _may_link(n, m, np.frombuffer(x.as_buffer(), "<i8"), np.frombuffer(y.as_buffer(), "<i8"), percent)
                for (n, m), (x, y) in zip(sizes, marks)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    spark = pairs.sparkSession
    ends, ends_path = stored(_ends(pairs), "ngram-ends")
    known, known_path = stored(sets.join(sized(ends), "row", "left_semi").select("row", "n", "marks"), "ngram-marks")
    a, b = (known.select(F.col("row").alias(c), F.col("n").alias(f"n_{c}"), F.col("marks").alias(f"marks_{c}")) for c in "ab")
    likely = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").mapInArrow(check, "a long, b long")
    likely, path = stored(likely, "ngram-likely")
    for spent in (ends_path, known_path):
        remove(spark, spent)
    return likely, path


def _links(docs, pairs: DataFrame, sets: DataFrame, levels, words: int, percent: int) -> tuple[DataFrame, str]:
    """The pairs (a, b) whose overlaps, counted by fragment and summed, are large enough."""
    pairs, likely_path = _likely(pairs, sets, percent)
    needed, needed_path = stored(
        sets.join(_ends(pairs), "row", "left_semi").select("row", "doc_id", "one", "two"), "ngram-needed"
    )
    parts, parts_path = stored(_fragments(docs, needed, levels, words), "ngram-fragments")
    sweep(docs.sparkSession)

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, other = batch.column("tokens"), batch.column("other")
            n = [
                len(np.intersect1d(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), True))
                for x, y in zip(mine, other)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), batch.column("fragment"), pa.array(n, pa.int64())],
                ["a", "b", "fragment", "n"],
            )

    # Of a pair the lesser row is the one that many share: few sets stand on that side.
    left = parts.withColumnRenamed("row", "a")
    right = parts.select(F.col("row").alias("b"), "fragment", F.col("tokens").alias("other"))
    firsts, firsts_path = stored(pairs.select("b").distinct(), "ngram-firsts")
    right = right.join(sized(firsts), "b", "left_semi")
    partial = (
        left.join(sized(pairs), "a")
        .join(right.hint("merge"), ["b", "fragment"])
        .select("a", "b", "fragment", "tokens", "other")
        .mapInArrow(overlap, "a long, b long, fragment int, n long")
    )
    # A document may be in the table twice with id and text: its partial counts are equal.
    once = partial.groupBy("a", "b", "fragment").agg(F.max("n").alias("n"))
    shared = once.groupBy("a", "b").agg(F.sum("n").alias("shared"))
    size = sets.select("row", "n")
    checked = (
        shared.join(size.withColumnsRenamed({"row": "a", "n": "na"}), "a")
        .join(size.withColumnsRenamed({"row": "b", "n": "nb"}), "b")
        .where(F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * percent)
        .select("a", "b")
    )
    links, path = stored(checked, "ngram-links")
    for spent in (parts_path, needed_path, firsts_path, likely_path):
        remove(docs.sparkSession, spent)
    sweep(docs.sparkSession)
    return links, path


def _around(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the rows of each n-gram with PIVOTS rows of it, where their classes differ.

    The pivots are those with the least hashes, so that rows which share many n-grams meet the
    same ones and make few pairs. There are at most PIVOTS pairs for each row of an n-gram.
    """
    pivot = [
        F.min(F.struct(F.xxhash64("row", F.lit(k)).alias("h"), "row", "class", "code", "pos")).alias(f"p{k}")
        for k in range(PIVOTS)
    ]
    pivots, _ = stored(
        placed.groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("x"), F.max("class").alias("y"), *pivot)
        .where("x < y")
        .select("token", "n", F.array_distinct(F.array(*[F.col(f"p{k}").dropFields("h") for k in range(PIVOTS)])).alias("pivots")),
        "ngram-pivots",
    )
    met = spread_left_join(placed, pivots, ["token"], ["row"]).where("pivots is not null").withColumn("p", F.explode("pivots"))
    fits = _passes(F.col("code"), F.col("pos"), F.col("p.code"), F.col("p.pos"), percent)
    return (
        met.where((F.col("class") != F.col("p.class")) & fits)
        .select(F.greatest("row", "p.row").alias("a"), F.least("row", "p.row").alias("b"))
        .distinct()
    )


def _nearest(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each row with the likeliest row of another class, by their sketches, of about GROUP rows.

    A row is looked up in one n-gram only, of those across classes the one of most rows, whose
    rows are dealt out by a hash. There is at most one pair for each row, of sets whose sizes and
    sketches speak for a link; other pairs of two classes are left to the join across them.
    """

    def likeliest(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        row, of, n = (group.column(c).to_numpy() for c in ("row", "class", "n"))
        marks = np.stack([group.column(c).to_numpy() for c in SKETCH], 1).view(np.uint64)
        pairs = []
        for k in range(len(row)):
            both = n + n[k]
            shared = _least_shared(both, percent)
            most = both - 2 * shared
            differ = np.bitwise_count(marks ^ marks[k]).sum(1, dtype=np.int64)
            fits = (of != of[k]) & (np.minimum(n, n[k]) >= shared)
            fits = np.flatnonzero(fits & (differ <= np.minimum(most, _usual(most))))
            if len(fits):
                near = fits[np.argmin(differ[fits] / both[fits])]
                pairs.append((max(row[k], row[near]), min(row[k], row[near])))
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    mixed, _ = stored(
        placed.groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("x"), F.max("class").alias("y"))
        .where("x < y")
        .select("token", "n"),
        "ngram-mixed",
    )
    own = spread_left_join(placed, mixed, ["token"], ["row"]).where("n is not null")
    own = own.groupBy("row", "class").agg(F.max(F.struct("n", "token")).alias("t"))
    dealt = F.pmod(F.xxhash64("row"), F.ceil(F.col("t.n") / GROUP)).alias("part")
    own = own.select("row", "class", F.col("t.token").alias("token"), dealt)
    own = own.join(sets.select("row", "n", *SKETCH), "row")
    return own.groupBy("token", "part").applyInArrow(likeliest, "a long, b long").distinct()


def _least_rows(rows: DataFrame) -> DataFrame:
    """(row, rep): each row with the least row that has the same set."""
    keys = ["one", "two", "n"]
    reps, _ = stored(rows.groupBy(*keys).agg(F.min("row").alias("rep")), "ngram-reps")
    return rows.select("row", *keys).join(reps, keys).select("row", "rep")


def jaccard_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_shingles, component_id.

    component_id is the least doc_id that links lead to, a document's own included. Null and
    blank texts have no n-grams and no links; a text with fewer words has one. Repeated rows
    have equal sets and so one class. A null doc_id is no component_id unless its class has
    no other. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    levels, total = frequent_levels(docs, words)
    buckets = max(1, -(-(total * (100 - percent) // 100) // BUCKET_ENTRIES))
    made, made_path = stored(_index(docs, levels, buckets, words, percent), "ngram-index")
    rows = made.where("kind = 0").select(
        F.col("a").alias("row"), F.col("b").alias("one"), F.col("c").alias("two"), F.col("d").alias("n"), "doc_id",
        F.col("blob").alias("marks"), *[F.col("sketch")[k].alias(c) for k, c in enumerate(SKETCH)],
    )
    rows, rows_path = stored(rows, "ngram-rows")
    met, met_path = stored(_meet(made.where("kind = 1"), percent), "ngram-met")
    local = made.where("kind > 1").select("kind", "a", "b", "c", "d")
    found = met.unionByName(local)
    same, same_path = stored(_least_rows(rows.where("n > 0")), "ngram-same")
    # Pairs and early n-grams are those of the least row of each set from here on.
    sets = rows

    def by_set(frame: DataFrame, column: str) -> DataFrame:
        to = same.select(F.col("row").alias("_r"), F.col("rep").alias("_rep"))
        return frame.join(to, F.col(column) == F.col("_r")).withColumn(column, F.col("_rep")).drop("_r", "_rep")

    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    first, first_path = stored(tidy(by_set(by_set(found.where("kind = 2").select("a", "b"), "a"), "b")), "ngram-pairs")
    shared, shared_path = stored(
        by_set(
            found.where("kind = 3").select(F.col("a").alias("token"), F.col("b").alias("row"), F.col("c").alias("code"), F.col("d").alias("pos")),
            "row",
        ).distinct(),
        "ngram-shared",
    )
    for spent in (made_path, met_path):
        remove(spark, spent)
    sweep(spark)
    links, _ = _links(docs, first, sets, levels, words, percent)
    classes, classes_path = stored(components(links), "ngram-classes")

    def place(classes: DataFrame) -> tuple[DataFrame, str]:
        of = classes.withColumnsRenamed({"node": "row", "root": "class"})
        return stored(shared.join(of, "row", "left").withColumn("class", F.coalesce("class", "row")), "ngram-placed")

    # A few documents of each n-gram, then the likeliest of some hundred, join most classes that
    # have it, with pairs in proportion to its rows.
    placed, placed_path = place(classes)
    tried, tried_paths = first, []
    for near in (lambda: _around(placed, percent), lambda: _nearest(placed, sets, percent)):
        fresh, path = stored(near().join(tried, ["a", "b"], "left_anti"), "ngram-pairs")
        tried_paths.append(path)
        if fresh.isEmpty():
            continue
        more, _ = _links(docs, fresh, sets, levels, words, percent)
        known_links = classes.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        remove(spark, placed_path)
        joined, joined_path = stored(components(known_links.unionByName(more)), "ngram-classes")
        remove(spark, classes_path)
        classes, classes_path = joined, joined_path
        placed, placed_path = place(classes)
        tried = tried.unionByName(fresh)

    # What many documents share is left to do only across classes.
    mixed_tokens = placed.groupBy("token").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y")
    # Few rows of few n-grams are left, and only they carry the sketches of their sets.
    open_ = placed.join(mixed_tokens.select("token").hint("merge"), "token", "left_semi")
    open_, open_path = stored(open_.join(sets.select("row", "n", *SKETCH), "row"), "ngram-open")
    known = ["row", "class", "code", "pos", "n", *SKETCH]
    mine = open_.select("token", *[F.col(c).alias(f"{c}_a") for c in known])
    other = open_.select("token", *[F.col(c).alias(f"{c}_b") for c in known])
    fits: Column = _passes(F.col("code_a"), F.col("pos_a"), F.col("code_b"), F.col("pos_b"), percent)
    fits = fits & ~_too_different(percent)
    across = (
        mine.join(other, (mine["token"] == other["token"]) & (F.col("class_a") < F.col("class_b")) & fits)
        .select(
            F.greatest("row_a", "row_b").alias("a"), F.least("row_a", "row_b").alias("b"),
            F.col("class_a").alias("x"), F.col("class_b").alias("y"), _differ().alias("differ"),
        )
        .distinct()
    )
    second, second_path = stored(across.join(tried, ["a", "b"], "left_anti"), "ngram-pairs")
    joined, found = classes, [classes.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))]
    # The likeliest pair of two classes first; then all pairs of those that are still apart.
    likeliest = second.groupBy("x", "y").agg(F.min(F.struct("differ", "a", "b")).alias("p")).select("p.a", "p.b")
    likeliest, likeliest_path = stored(likeliest, "ngram-pairs")
    rest_paths: list[str] = []
    for number in range(2):
        if number == 0:
            pairs = likeliest
        else:
            of = sized(stored(joined, "ngram-classes")[0])
            x, y = (of.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("x", "y"))
            rest = second.join(likeliest, ["a", "b"], "left_anti").join(x, "x", "left").join(y, "y", "left")
            apart = F.coalesce("root_x", "x") != F.coalesce("root_y", "y")
            pairs, path = stored(rest.where(apart).select("a", "b"), "ngram-pairs")
            rest_paths.append(path)
        if pairs.isEmpty():
            break
        more, _ = _links(docs, pairs, sets, levels, words, percent)
        found.append(more)
        every = found[0]
        for links in found[1:]:
            every = every.unionByName(links)
        joined, _ = stored(components(every), "ngram-classes")
    for spent in (likeliest_path, *tried_paths, *rest_paths):
        remove(spark, spent)
    for spent in (first_path, shared_path, placed_path, open_path, second_path):
        remove(spark, spent)

    own = rows.join(same, "row", "left").withColumn("rep", F.coalesce("rep", "row"))
    own = own.join(joined.withColumnsRenamed({"node": "rep", "root": "class"}), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("class", "rep").alias("class")
    )
    own, _ = stored(own, "ngram-own")
    least, _ = stored(own.groupBy("class").agg(F.min("doc_id").alias("component_id")), "ngram-least")
    return own.join(least, "class").select("doc_id", "n_shingles", "component_id")


def near_duplicates_left(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents with all their columns, without those that link to a smaller doc_id.

    Of each class the document with the least id stays. Rows that share an id stay or go
    together; those without an id stay.
    """
    classes = jaccard_classes(docs, words, percent)
    firsts = classes.where("doc_id = component_id").select("doc_id").distinct()
    others = classes.where("doc_id <> component_id").select("doc_id").join(firsts, "doc_id", "left_anti").distinct()
    gone, _ = stored(others, "ngram-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
