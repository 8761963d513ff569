"""Set similarity join on word shingles with token-combination prefixes.

Two sets x and y of at least 3/4 similarity share ceil(3/4 max(|x|, |y|)) shingles, so under any order of
the shingles the first |x| - ceil(3/4 |x|) + k of x and likewise of y have k in common. This is used twice:

1. *Extended hash prefixes.* The order is the shingle's hash and k grows with the set (1 + |x| // 8). Each
   batch of texts reports, per shingle, one set that holds it or the fact that several do, so a shingle in a
   third of all texts costs one entry a batch. A set with too few shared shingles in its prefix links with
   nothing and is done; a shared passage alone does not carry a set past this count.
2. *Token combinations.* What is left is ordered by frequency. Shingles of at most ``RARE`` sets are indexed
   alone; pairs of more frequent ones are indexed together, with prefixes one longer (k = 2).

In between, sets with equal minima under the same permutations are compared with the first of them. Large
groups of near copies become components there, and later steps only look for links between different
components. Every link is verified on the whole sets; equal sets are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import keep
from .words import SPACED, U64, mix, shingles, split, texts

NUM, DEN = 3, 4
RARE = 16
BANDS, ROWS = 6, 2
#: a bucket up to this size gives all its pairs at once (at most 496); larger ones are starred first
SMALL_BUCKET = 32
#: frequent shingles of a prefix that are paired; with more, they are indexed alone
MOST_PAIRED = 40
NARROWING = 2


def _alpha(n):
    return (n * NUM + DEN - 1) // DEN


def _k(n):
    return 1 + n // 8


def _longs(blob: np.ndarray) -> np.ndarray:
    return blob.view(np.int64)


def shingle_sets(column, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the batch, sorted distinct shingle keys) of every text."""
    for t in texts(column):
        w = split(t, SPACED)
        for i in range(t.hi - t.lo):
            key = w.key[w.first[i] : w.first[i + 1]]
            yield t.lo + i, np.unique(shingles(key, size))


def set_key(tokens: np.ndarray) -> int:
    """One 64-bit key per set, 0 for the empty set."""
    if not len(tokens):
        return 0
    x = np.add.reduce(mix(tokens ^ U64(0x5851F42D4C957F2D))) + U64(len(tokens))
    return int(mix(np.array([x], U64)).view(np.int64)[0]) or 1


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n_shingles, set_key) per row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, s in shingle_sets(b.column(1), size):
                n[i], k[i] = len(s), set_key(s)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n), pa.array(k)], ["id", "n_shingles", "set_key"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(rows, "id long, n_shingles long, set_key long")


def _hash_prefixes(docs: DataFrame, text_col: str, size: int, parts: int) -> DataFrame:
    """(part, tokens, keys, held): per batch and token part the prefix shingles, each with one set that holds
    it, or key 0 if several sets of the batch do; ``part`` -1 carries (set, count) of the latter."""
    bits = parts.bit_length() - 1

    def rows(batches):
        for b in batches:
            chunks: list[tuple[np.ndarray, int]] = []
            weight = 0
            for _, s in shingle_sets(b.column(0), size):
                n = len(s)
                if n:
                    chunks.append((s[: n - _alpha(n) + _k(n)], set_key(s)))
                    weight += len(chunks[-1][0])
                if weight > 1_000_000:
                    yield from _packed(chunks, bits)
                    chunks, weight = [], 0
            if chunks:
                yield from _packed(chunks, bits)

    return docs.select(F.col(text_col).cast("string")).mapInArrow(rows, "part int, tokens binary, keys binary")


def _packed(chunks: list[tuple[np.ndarray, int]], bits: int) -> Iterator[pa.RecordBatch]:
    chunks = list({k: (s, k) for s, k in chunks}.values())
    token = np.concatenate([s for s, _ in chunks])
    key = np.repeat(np.array([k for _, k in chunks], np.int64), [len(s) for s, _ in chunks])
    order = np.argsort(token, kind="stable")
    token, key = token[order], key[order]
    begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    count = np.diff(np.append(begins, len(token)))
    several = np.repeat(count > 1, count)
    sets, n = np.unique(key[several], return_counts=True)
    one = token[begins]
    holder = np.where(count > 1, 0, key[begins])
    part = (one >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(one), np.int64)
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    ends = np.append(cut[1:], len(part))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.append(part[cut], -1).astype(np.int32)),
            pa.array([one[a:z].tobytes() for a, z in zip(cut, ends)] + [n.astype(np.int64).tobytes()], pa.binary()),
            pa.array([holder[a:z].tobytes() for a, z in zip(cut, ends)] + [sets.tobytes()], pa.binary()),
        ],
        ["part", "tokens", "keys"],
    )


def _shared(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """How many prefix shingles of each set another set holds too, as (bucket, keys, counts): one row for each
    bucket of sets."""
    tokens, keys, sets, counts = [], [], [], []
    for b in batches:
        for part, t, k in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            (counts if part < 0 else tokens).append(np.frombuffer(t.as_py(), np.int64 if part < 0 else U64))
            (sets if part < 0 else keys).append(np.frombuffer(k.as_py(), np.int64))
    if tokens:
        token, key = np.concatenate(tokens), np.concatenate(keys)
        order = np.lexsort((key, token))
        token, key = token[order], key[order]
        new = np.concatenate([[True], token[1:] != token[:-1]])
        run = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        last = np.append(begins[1:], len(token)) - 1
        # several holders, or one batch that says so (key 0)
        shared = (key[begins] != key[last]) | (np.minimum.reduceat((key != 0).astype(np.int8), begins) == 0)
        # an exact copy in another batch is the same set and counts once
        once = np.concatenate([[True], (key[1:] != key[:-1]) | new[1:]])
        got, n = np.unique(key[shared[run] & once & (key != 0)], return_counts=True)
        sets.append(got)
        counts.append(n.astype(np.int64))
    if sets:
        got, total = _added(sets, counts)
        home = (mix(got.view(U64)) % U64(buckets)).astype(np.int32)
        order = np.argsort(home, kind="stable")
        got, total, home = got[order], total[order], home[order]
        cut = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(home))
        yield pa.RecordBatch.from_arrays(
            [pa.array(home[cut]), *(pa.array([x[a:z].tobytes() for a, z in zip(cut, ends)], pa.binary()) for x in (got, total))], ["bucket", "keys", "counts"]
        )


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    got, at = np.unique(np.concatenate(keys), return_inverse=True)
    return got, np.bincount(at, np.concatenate(counts), len(got)).astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set_key, shared) out of the rows of whole buckets."""
    keys, counts = [], []
    for b in batches:
        for k, n in zip(b.column(1), b.column(2)):
            keys.append(np.frombuffer(k.as_py(), np.int64))
            counts.append(np.frombuffer(n.as_py(), np.int64))
    if keys:
        got, total = _added(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(total)], ["set_key", "shared"])


def _token_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, set_key, n, tokens, bands) of (id, text, wanted set): the whole sets, and minima under permutations."""
    odd = [U64(int(x) | 1) for x in np.random.default_rng(11).integers(1, 2**63, BANDS * ROWS)]

    def rows(batches):
        for b in batches:
            out: list[tuple] = []
            held, first = 0, 0

            def batch(upto):
                whole = pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(first, upto - first),
                        pa.array([x[0] for x in out], pa.int64()),
                        pa.array([len(x[1]) for x in out], pa.int64()),
                        pa.array([_longs(x[1]) for x in out], pa.list_(pa.int64())),
                        pa.array([x[2] for x in out], pa.list_(pa.int64())),
                    ],
                    ["id", "set_key", "n", "tokens", "bands"],
                )
                return whole.filter(pc.equal(whole.column(1), b.column(2).slice(first, upto - first)))

            for i, s in shingle_sets(b.column(1), size):
                low = np.array([mix(s * m).min() for m in odd]).reshape(BANDS, ROWS) if len(s) else np.zeros((BANDS, ROWS), U64)
                bands = _longs(mix(low[:, 0] * U64(3) + mix(low[:, 1]) + np.arange(BANDS, dtype=U64)))
                out.append((set_key(s), s, bands))
                held += len(s)
                if held > 500_000:
                    yield batch(i + 1)
                    out, held, first = [], 0, i + 1
            if out:
                yield batch(first + len(out))

    return docs.mapInArrow(rows, "id long, set_key long, n long, tokens array<long>, bands array<long>")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of ids those whose whole sets reach the similarity."""
    one = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    inter = F.size(F.array_intersect("ta", "tb"))
    return (
        pairs.select("a", "b").join(two, "b").join(one, "a")
        .withColumn("inter", inter)
        .where(F.col("inter") * 100 >= (F.size("ta") + F.size("tb") - F.col("inter")) * 75)
        .select("a", "b")
    )


def _stars(buckets: DataFrame, sets: DataFrame, centre: DataFrame, rows: int) -> DataFrame:
    """Links between the middle of each bucket and its other rows.

    The middle is the set with the largest share of shingles that other sets hold too: among edited copies,
    the one with the fewest edits, which most of them reach.
    """
    ranked = buckets.join(centre, "id")
    lead = ranked.groupBy("sig").agg(F.max(F.struct("centre", (-F.col("id")).alias("id"))).alias("x"), F.count("*").alias("m")).where("m > 1")
    lead = keep(lead.select("sig", (-F.col("x.id")).alias("a")), rows)
    pairs = buckets.join(lead, "sig").where("a <> id").select("a", F.col("id").alias("b")).distinct()
    return verify(pairs, sets)


def _star_links(comps: DataFrame) -> DataFrame:
    """Components as links again."""
    return comps.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _labelled(ids: DataFrame, comps: DataFrame) -> DataFrame:
    """ids with the component found so far; an id without links is its own."""
    return ids.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _between(sets: DataFrame, comps: DataFrame) -> DataFrame:
    """(id, n, component) of sets that may link outside their component: the count over extended hash
    prefixes once more, now of shingles that more than one component holds."""
    ids = _labelled(sets.select("id", "n"), comps)
    prefix = F.expr("explode(slice(tokens, 1, cast(n - (n * 3 + 3) div 4 + 1 + n div 8 as int)))")
    rows = sets.select("id", "n", prefix.alias("token")).join(ids.select("id", "component"), "id")
    mixed = keep(rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token"))
    need = F.expr("1 + ((n * 3 + 3) div 4) div 8")
    some = rows.join(mixed, "token").groupBy("id").agg(F.count("*").alias("shared"), F.first("n").alias("n")).where(F.col("shared") >= need).select("id")
    return ids.join(some, "id")


def _narrowed(left: DataFrame) -> DataFrame:
    """(id, n, component, tokens, v, alpha) of the sets of ``left`` that may still link with one of another component.

    Such a link needs at least 3/7 of both sizes together in common, and never more than v, the number of a
    set's shingles that another component holds. So v bounds the partner's size from above; the smallest set
    with one of those shingles bounds it from below and gives alpha, the least overlap. That many shingles
    must occur in sets of at most the upper size. What falls here takes its shingles out of the count.
    """
    rows = left.select("id", "n", "component", F.explode("tokens").alias("token"))
    stats = keep(rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least")).where("low <> high").select("token", "least"))
    own = rows.join(stats, "token").groupBy("id", "n", "component").agg(F.collect_list("least").alias("l"))
    own = own.withColumn("v", F.size("l").cast("long")).withColumn("alpha", F.expr("greatest((n * 3 + 3) div 4, (3 * (n + array_min(l)) + 6) div 7)"))
    own = own.where("size(filter(l, x -> 3 * (n + x) <= 7 * v)) >= alpha").select("id", "v", "alpha")
    return left.drop("v", "alpha").join(own, "id")


def _index(left: DataFrame) -> DataFrame:
    """(sig, id, n, component, v): single rare shingles and pairs of frequent ones of every prefix.

    The frequency of a shingle is the number of components that hold it. Shingles of one component come first
    in the order and need no entry; k is 2 throughout. Where a prefix holds very many frequent shingles their
    pairs would be too many: those shingles are indexed alone, in every set.
    """
    rows = left.select("id", "component", F.explode("tokens").alias("token"))
    stats = keep(rows.groupBy("token", "component").agg(F.lit(1).alias("one")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    own = rows.join(stats, "token").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("t"))
    length = "cast(greatest(0, n - alpha + 2 - (n - size(t))) as int)"
    own = own.join(left.select("id", "n", "component", "v", "alpha"), "id").withColumn("t", F.expr(f"slice(t, 1, {length})"))
    own = keep(own.withColumn("o", F.expr(f"filter(t, x -> x.df > {RARE})")))
    alone = keep(own.where(F.size("o") > MOST_PAIRED).select(F.explode("o.token").alias("token")).distinct())
    rare = f"x.df <= {RARE}"
    if alone.limit(1).count():
        marked = own.select("id", F.explode("o.token").alias("token")).join(alone, "token").groupBy("id").agg(F.collect_set("token").alias("alone"))
        own = own.join(marked, "id", "left").withColumn("alone", F.coalesce("alone", F.array().cast("array<bigint>")))
        own = own.withColumn("o", F.expr("filter(o, x -> not array_contains(alone, x.token))"))
        rare += " or array_contains(alone, x.token)"
    single = F.expr(f"transform(filter(t, x -> {rare}), x -> xxhash64(x.token))")
    double = F.expr("""flatten(transform(o, (x, i) -> transform(slice(o, i + 2, greatest(size(o) - i - 1, 0)),
        y -> xxhash64(least(x.token, y.token), greatest(x.token, y.token)))))""")
    return own.select(F.explode(F.concat(single, double)).alias("sig"), "id", "n", "component", "v")


def similar(docs: DataFrame, id_col: str, text_col: str, size: int = 5) -> DataFrame:
    """(id, n_shingles, set_key, component) per row of ``docs``; the component is the smallest linked id.

    Texts without words, null texts and null ids link with nothing; the component of a null id is null.
    Fewer words than ``size`` make one shingle. Rows with one id count as one document. Other columns are
    not read, whatever they are called.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = keep(signatures(docs, "id", "text", size))
    some = sig.where("id is not null and n_shingles > 0")
    classes = keep(some.groupBy("set_key").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n")))
    total = sig.agg(F.sum(F.expr("n_shingles - (n_shingles * 3 + 3) div 4 + 1 + n_shingles div 8"))).first()[0] or 0
    # small tasks while there are few of them, up to about 100 MB each on very large inputs
    tokens_a_task = min(max(250_000, int(total) // 20_000), 4_000_000)
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, int(total) // tokens_a_task + 1)
    parts = 1 << (2 * tasks - 1).bit_length()
    packed = _hash_prefixes(docs.where("id is not null"), "text", size, parts)
    # the part's number spreads the key space; part -1 (counts) is spread by its content
    packed = packed.repartition(tasks, F.when(F.col("part") >= 0, F.col("part")).otherwise(F.xxhash64("keys")))
    homes = max(64, tasks // 64)
    shared = packed.mapInArrow(lambda batches: _shared(batches, homes), "bucket int, keys binary, counts binary")
    shared = shared.repartition(homes, "bucket").mapInArrow(_summed, "set_key long, shared long")
    need = F.expr("1 + ((n * 3 + 3) div 4) div 8")
    live = keep(classes.join(shared, "set_key").where(F.col("shared") >= need).select("set_key", F.col("rep").alias("id"), (F.col("shared") / F.col("n")).alias("centre")))
    found = docs.join(live.hint("shuffle_hash"), "id").select("id", "text", "set_key")
    sets = keep(_token_sets(found, size))
    centre, n_live = live.select("id", "centre"), live.count()

    links = _stars(sets.select("id", F.explode("bands").alias("sig")).distinct(), sets.select("id", "tokens"), centre, BANDS * n_live)
    comps = keep(components(links, "a", "b"), n_live)
    left = keep(_between(sets, comps), n_live)
    left = sets.select("id", "tokens").join(left, "id")
    for _ in range(NARROWING):
        left = keep(_narrowed(left))
    rest = left.select("id", "tokens")
    buckets = keep(_index(left))
    sizes = buckets.groupBy("sig").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    sizes = keep(sizes.select("sig", "m"))
    buckets = keep(buckets.join(sizes, "sig"))
    big = buckets.where(F.col("m") > SMALL_BUCKET)
    if big.limit(1).count():
        comps = keep(components(_star_links(comps).unionByName(_stars(big.select("sig", "id"), rest, centre, n_live)), "a", "b"), n_live)
        buckets = keep(_labelled(buckets.drop("component"), comps))
    # a pair that meets in several buckets comes out of the first of them only
    buckets = buckets.join(keep(buckets.groupBy("id").agg(F.collect_list("sig").alias("sigs")), n_live), "id")
    one = buckets.select("sig", F.col("id").alias("a"), F.col("n").alias("na"), F.col("v").alias("va"), F.col("component").alias("ca"), F.col("sigs").alias("sa"))
    two = buckets.select("sig", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("v").alias("vb"), F.col("component").alias("cb"), F.col("sigs").alias("sb"))
    fits = "ca < cb and 4 * na >= 3 * nb and 4 * nb >= 3 * na and 7 * least(va, vb) >= 3 * (na + nb) and sig = array_min(array_intersect(sa, sb))"
    pairs = one.join(two, "sig").where(fits).select("a", "b").distinct()
    comps = components(_star_links(comps).unionByName(verify(pairs, rest)), "a", "b")

    by_set = keep(_labelled(classes.select("set_key", F.col("rep").alias("id")), comps).select("set_key", "component"))
    return sig.join(by_set, "set_key", "left").select(
        "id", "n_shingles", "set_key", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("component", "id")).otherwise(F.col("id")).alias("component")
    )
