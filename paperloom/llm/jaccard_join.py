"""N-gram Jaccard join with token-combination prefixes.

A document's tokens are hashes of its distinct shingles. Two documents link when their Jaccard
similarity reaches PERCENT / 100. With ``e = n - ceil(PERCENT * n / 100)`` no more than ``e`` of the
``n`` tokens of one can be missing in the other.

1. Equal sets become one class, represented by its smallest document.
2. Screening. Under hash order, linked sets share at least ``k`` tokens within the extended prefix of
   ``e + k`` tokens. Documents with fewer prefix tokens that any other has in its prefix link with
   nothing and leave. The tokens travel packed, and each batch sends a token once.
3. Tokens of the remaining sets are counted over all of them and ordered: rare ones (at most RARE
   sets) first, frequent ones last, by hash within a class. The first shared token of a linked pair
   lies in the prefix of ``e + 1``. If it is rare, it is indexed as a single token. If it is frequent,
   no rare token is shared, so all rare tokens of either set count as missing; the prefix is then
   extended until at least one run of COMBINE shared tokens that follow each other in both sets must
   end in it, and combinations of COMBINE neighbouring frequent tokens are indexed.
4. Each index entry is verified against one leader of its posting list (the set with the fewest rare
   tokens), which links thousands of near copies without comparing all pairs; then only members
   that still lie in different components are compared, after bounds on size, on shared tokens, and
   on the difference that parity bits show. Posting lists of more than BLOCK sets meet block by block.
   A pair is left out at a key if both sets have the same key before it, where they have met already.

Verification counts the intersection of whole token sets. All steps are exact but for 64-bit hashes.

Defined results: null, empty or wordless texts have no shingles and link with nothing; so do rows
with a null ``doc_id``; repeated rows of a ``doc_id`` are the same document; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_small, map_arrow, map_groups
from .components import components
from .hashing import SENT, chunks, mixed, sequences, slices, word_hashes
from .packed import SCHEMA, bucket_count, dealt, grouped, known, of_several, rows, unpack_all

SHINGLE, PERCENT = 4, 85
#: Tokens of more sets than this are frequent; neighbouring frequent tokens are combined by COMBINE.
RARE, COMBINE = 8, 2
#: Sets of a posting list that meet in one group; tokens that a task holds before it hands them on.
BLOCK, HELD = 1024, 1 << 18
_SALT = np.uint64(0x9FB21C651E98DF25)


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row."""
    for first, last, data, offsets in chunks(batch.column("text")):
        words, bounds = word_hashes(data, offsets, lower=True)
        h = sequences(words, shingle)
        for k in range(last - first):
            i, j = int(bounds[k]), int(bounds[k + 1])
            if j - i >= shingle:
                yield first + k, np.unique(h[i : j - shingle + 1])
            else:
                yield first + k, mixed(sequences(words[i:j], j - i) + np.uint64(j - i)) if j > i else np.zeros(0, np.uint64)


def _missing(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100


def _extra(n: int, percent: int) -> int:
    """Shared tokens that screening asks for beyond the plain prefix; never more than linked sets must share."""
    e = _missing(n, percent)
    return min(max(1, (e + 1) // 2), n - e)


def _arrays(values: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


#: Words of 64 parity bits.
PARITY = 8


def _parity(t: np.ndarray) -> np.ndarray:
    """Whether the tokens of each of 64 * PARITY hash ranges are odd in number. Two sets differ in at least as many tokens as their parities do in bits."""
    odd = np.bincount((t >> np.uint64(64 - 6 - PARITY.bit_length() + 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _signed(batches: Iterator[pa.RecordBatch], shingle: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, n, two hashes of the set, and its tokens if asked for."""

    def rows_of(batch: pa.RecordBatch, found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        sums = [pa.array(np.array([mixed(t ^ salt).sum(dtype=np.uint64) for _, t in found], np.uint64).view(np.int64)) for salt in (np.uint64(0), _SALT)]
        lists = [_arrays([f(t) if whole else t[:0] for _, t in found]) for f in (lambda t: t, _parity)]
        ids = batch.column("doc_id").take(pa.array([row for row, _ in found], pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array([len(t) for _, t in found], pa.int32()), *sums, *lists], ["doc_id", "n", "s1", "s2", "tokens", "parity"])

    for batch in batches:
        found, held = [], 0
        for row, t in _sets(batch, shingle):
            found.append((row, t))
            held += len(t)
            if held >= HELD:
                yield rows_of(batch, found)
                found, held = [], 0
        if found:
            yield rows_of(batch, found)


_SIGNED = "doc_id long, n int, s1 long, s2 long, tokens array<long>, parity array<long>"


_TOKEN_HASH = ("<u4", "<u1")  # 40 bits beside the bucket: enough to screen with


def _send(batches: Iterator[pa.RecordBatch], shingle: int, percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Tokens of extended prefixes: buckets below ``buckets`` get one record of each token that the batch can't judge alone; those above, documents of tokens known to be shared."""
    for k, batch in enumerate(slices(batches, SENT)):
        ids, tokens, owner = batch.column("doc_id").to_numpy(zero_copy_only=False), [], []
        for row, t in _sets(batch, shingle):
            if len(t):
                tokens.append(t[: _missing(len(t), percent) + _extra(len(t), percent)])
                owner.append(np.full(len(tokens[-1]), ids[row], np.int64))
        if not tokens:
            continue
        t, doc = np.concatenate(tokens), np.concatenate(owner)
        order, begin, size = grouped(t)
        several = of_several(order, begin, doc)
        shared = np.zeros(len(t), bool)
        shared[order] = np.repeat(several, size)
        once = ~shared
        once[order[begin[several]]] = True
        rest = mixed(t[once])
        parts = [(rest // np.uint64(buckets)) & np.uint64(0xFFFFFFFF), (rest // np.uint64(buckets) >> np.uint64(32)) & np.uint64(0xFF)]
        # records of shared tokens ask for no reply; a zero mark in place of the one tells them apart
        mark = (~shared)[once].astype(np.int64)
        out = dealt((rest % np.uint64(buckets)).astype(np.int64), parts, _TOKEN_HASH, [doc[once], mark], buckets)
        yield rows(out + known(_TOKEN_HASH, [doc[shared], np.ones(int(shared.sum()), np.int64)], buckets + (int(t[0] % np.uint64(buckets)) + k) % buckets))


def _reply(group: pa.Table, buckets: int) -> pa.Table:
    """(doc_id, hits): tokens that several documents have."""
    low, high, doc, mark = unpack_all(group, _TOKEN_HASH, 2)
    keep = mark == 1
    if group.column("bucket")[0].as_py() < buckets:
        order, begin, size = grouped(low | high << np.uint64(32))
        several = of_several(order, begin, doc)
        doc, mark = doc[order], mark[order]
        keep = np.repeat(several | (np.minimum.reduceat(mark, begin) == 0), size) & (mark == 1)
    found, hits = np.unique(doc[keep], return_counts=True)
    return pa.table({"doc_id": pa.array(found, pa.int64()), "hits": pa.array(hits, pa.int64())})


def _screen(docs: DataFrame, sizes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id of documents whose extended prefix has enough tokens that others have too; equal sets count as others here."""
    buckets = bucket_count(docs)
    sent = map_arrow(docs, lambda b: _send(b, shingle, percent, buckets), SCHEMA)
    hits = map_groups(sent, "bucket", lambda g: _reply(g, buckets), "doc_id long, hits long").groupBy("doc_id").agg(F.sum("hits").alias("hits"))
    e = F.col("n") - F.floor((percent * F.col("n") + 99) / 100)
    needed = F.least(F.greatest(F.lit(1), F.floor((e + 1) / 2)), F.col("n") - e)
    return hits.join(sizes.groupBy("doc_id").agg(F.min("n").alias("n")), "doc_id").where(F.col("hits") >= needed).select("doc_id")


def _keys(batches: Iterator[pa.RecordBatch], percent: int, combine: int) -> Iterator[pa.RecordBatch]:
    """Index entries (key, doc_id, n, common, rare) of sets whose shared tokens are given in two classes."""

    def rows_of(out: list) -> pa.RecordBatch:
        size = np.array([len(keys) for keys, *_ in out])
        doc, n, common, rare = (np.repeat(np.array([x[k] for x in out], kind), size) for k, kind in ((1, np.int64), (2, np.int32), (3, np.int32), (4, np.int32)))
        key = np.concatenate([keys for keys, *_ in out]).view(np.int64)
        return pa.RecordBatch.from_arrays(list(map(pa.array, (key, doc, n, common, rare))), ["key", "doc_id", "n", "common", "rare"])

    for batch in batches:
        out, held = [], 0
        for doc, n, few, many in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("few"), batch.column("many")):
            few = np.sort(np.array(few.values, np.int64).view(np.uint64))
            many = np.sort(np.array(many.values, np.int64).view(np.uint64))
            e, common = _missing(n, percent), len(few) + len(many)
            alone = n - common
            if alone > e:
                continue
            keys = [few[: e + 1 - alone]]
            rare = alone + len(few)
            if rare <= e:
                apart = (100 - percent) * n // percent - rare  # frequent tokens that only one of a linked pair has
                end = min(len(many), e - rare + (combine - 1) * max(apart, 0) + combine)
                keys.append(mixed(sequences(many[:end], combine) ^ _SALT))
            out.append((np.unique(np.concatenate(keys)), doc, n, common, rare))
            held += len(out[-1][0])
            if held >= HELD:
                yield rows_of(out)
                out, held = [], 0
        if out:
            yield rows_of(out)


def _may_link(n1: Column, common1: Column, n2: Column, common2: Column, percent: int) -> Column:
    """Bounds that every linked pair keeps: sizes, and the tokens of each that any other set has."""
    sizes = (100 * F.least(n1, n2)) >= (percent * F.greatest(n1, n2))
    return sizes & (F.least(common1, common2) * (100 + percent) >= percent * (n1 + n2))


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right, keep = batch.column("ta"), batch.column("tb"), []
        for k in range(batch.num_rows):
            x, y = left[k].values.to_numpy(), right[k].values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb"), lambda x: _verified(x, percent), "a long, b long")


def jaccard_links(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rare: int = RARE, combine: int = COMBINE) -> tuple[DataFrame, DataFrame]:
    """(classes, labels): doc_id, n_shingles and the representative of each row; id and component label of linked representatives."""
    texts_of = docs.select("doc_id", "text").where("doc_id is not null")
    signed = cut(map_arrow(texts_of, lambda x: _signed(x, shingle, False), _SIGNED).drop("tokens", "parity"))
    same = cut(signed.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")))
    classes = signed.join(same, ["s1", "s2", "n"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"))
    firsts = same.select(F.col("rep").alias("doc_id"), "s1", "s2", "n")
    near = cut(firsts.join(_screen(texts_of, firsts, shingle, percent), "doc_id", "left_semi"))
    texts = join_small(texts_of, near.select("doc_id"), "doc_id", "left_semi")
    sets = map_arrow(texts, lambda x: _signed(x, shingle, True), _SIGNED)
    sets = cut(join_small(sets, near.select("doc_id", "s1", "s2"), ["doc_id", "s1", "s2"], "left_semi").select("doc_id", "n", "tokens", "parity"))

    tokens = sets.select("doc_id", "n", F.explode("tokens").alias("t"))
    counts = tokens.groupBy("t").agg(F.count("*").alias("df"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    classed = tokens.join(counts.select("t", (F.col("df") > rare).alias("frequent")), "t")
    lists = classed.groupBy("doc_id", "n").agg(
        F.collect_set(F.when(~F.col("frequent"), F.col("t"))).alias("few"), F.collect_set(F.when(F.col("frequent"), F.col("t"))).alias("many")
    )
    index = cut(map_arrow(lists, lambda x: _keys(x, percent, combine), "key long, doc_id long, n int, common int, rare int"))

    leaders = index.groupBy("key").agg(F.min(F.struct("rare", "doc_id", "n", "common")).alias("leader"), F.count("*").alias("members")).where("members > 1")
    spokes = index.join(leaders, "key").where(F.col("doc_id") != F.col("leader.doc_id"))
    spokes = spokes.where(_may_link(F.col("n"), F.col("common"), F.col("leader.n"), F.col("leader.common"), percent))
    pairs = spokes.select(F.least("doc_id", "leader.doc_id").alias("a"), F.greatest("doc_id", "leader.doc_id").alias("b")).distinct()
    links = cut(_verify(pairs, sets, percent))
    labels = components(links)

    placed = index.join(labels, F.col("doc_id") == F.col("id"), "left").select("key", "doc_id", "n", "common", F.coalesce("label", "doc_id").alias("label"))
    lists = placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("members")).where("x < y")
    open_keys = placed.join(lists.select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "key")
    per_doc = open_keys.groupBy("doc_id", "n", "common", "label").agg(F.array_sort(F.collect_set(F.struct("key", "blocks"))).alias("keys"))
    per_doc = per_doc.join(sets.select("doc_id", "parity"), "doc_id").dropDuplicates(["doc_id"])
    open_rows = per_doc.select("doc_id", "n", "common", "label", "parity", "keys", F.posexplode("keys").alias("pos", "at"))
    open_rows = open_rows.select("doc_id", "n", "common", "label", "parity", "at.key", "at.blocks", F.coalesce(F.get("keys", F.col("pos") - 1)["key"], F.col("at.key")).alias("before"))
    open_rows = cut(open_rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")))
    dealt = open_rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = [dealt.where(F.col(low) <= F.col(high)).select("key", F.col(low).alias("low"), F.col(high).alias("high"), *[F.col(c).alias(f"{c}{k}") for c in ("doc_id", "n", "common", "label", "parity", "before")])
           for k, low, high in (("1", "block", "other"), ("2", "other", "block"))]
    may = _may_link(F.col("n1"), F.col("common1"), F.col("n2"), F.col("common2"), percent)
    odd = reduce(lambda x, y: x + y, [F.bit_count(F.get("parity1", F.lit(k)).bitwiseXOR(F.get("parity2", F.lit(k)))) for k in range(PARITY)])
    near_enough = odd * (100 + percent) <= (100 - percent) * (F.col("n1") + F.col("n2"))
    left, right = met
    new = (F.col("label1") != F.col("label2")) & ((left["low"] < left["high"]) | (F.col("doc_id1") < F.col("doc_id2")))
    first = (F.col("before1") != F.col("before2")) | (F.col("before1") == left["key"])
    rest = left.join(right, (left["key"] == right["key"]) & (left["low"] == right["low"]) & (left["high"] == right["high"]) & new & first & may & near_enough)
    rest = rest.select(F.least("doc_id1", "doc_id2").alias("a"), F.greatest("doc_id1", "doc_id2").alias("b")).distinct()
    more = cut(_verify(rest, sets, percent))
    if more.isEmpty():
        return classes, labels
    return classes, components(links.unionByName(more))


def linked(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id; one row per row of the input."""
    classes, labels = jaccard_links(docs, shingle, percent)
    found = classes.join(labels, F.col("rep") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    unnamed = map_arrow(docs.where("doc_id is null").select("doc_id", "text"), lambda x: _signed(x, shingle, False), _SIGNED)
    return found.unionByName(unnamed.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents with the smallest id of each component, with their own columns; rows without an id stay."""
    gone = cut(linked(docs, shingle, percent).where("doc_id <> component_id").select("doc_id").distinct())
    keyed = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return join_small(keyed, gone, "doc_id", "left_anti").select("row.*")


def op6(docs: DataFrame) -> DataFrame:
    return linked(docs)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), tokens AS (
  SELECT DISTINCT doc_id, words[i:i + 3] AS t FROM w, unnest(range(1, greatest(len(words) - 2, 2))) AS r(i) WHERE len(words) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * met >= 85 * (p.n + q.n - met)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.node WHERE reach.root < ways.b
)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, (SELECT min(root) FROM reach WHERE node = w.doc_id)) AS component_id
FROM w LEFT JOIN sizes USING (doc_id)
"""
