"""N-gram Jaccard join by grouped prefixes, and its connected components.

A document's set is its distinct 5-word shingles (64-bit hashes); x and y link when 100 * |x & y| >= 75 * |x | y|.
1. Sets. Equal sets are one class from here on (128-bit digest of the set). A set can only have a partner if at most a
   quarter of its shingles occur nowhere else; that is tested on the half of the shingles with an even hash, which must
   then all but that quarter be shared. Sets that fail are alone; this is exact, and leaves copies and near copies.
2. Order. The shingles of what is left are counted (in hash buckets, combined per batch first) and ordered by
   rarity. A set's prefix is its n - ceil(0.75 n) + 1 rarest shingles; linked sets share one of them. Shingles of its own
   (`first` of them) lead the order and can be shared with nobody, so they are not joined.
3. Groups. Sets with identical prefixes and size become one group.
4. First links: each set is verified against its group's leader and, of the lists of a few of its shingles, against the
   centre and the neighbour by size that it meets most often. This is a few pairs a set, whatever a list's length, and
   merges most of a group of near copies. Components of these links are found, and sets outside the largest component of
   a list are verified against that component's centre, one pair each.
5. Group pairs: pairs inside one component cannot change it, so only lists that still hold two components are joined.
   A pair of groups passes if it meets the length bound, the positional bound and the signature bound: shingles of one's
   own, and bits in which the parities of hashed shingles differ, all count towards the symmetric difference, which
   may be (100 - p) / (100 + p) of the sizes' sum at most. Of the lists that two groups share, those whose last few
   shared shingles before are the same are passed over, as an earlier list has the pair already.
6. Leaders of group pairs are verified first; what is then still apart and has more members is expanded to members under the
   same bounds, and verified. No candidate that could join two components is left out.
Verification intersects whole sets. A group of a million near copies costs a few million rows, not their square.

Defined cases: null texts, texts without words: n_shingles 0, alone. A null id links like any other, but the component's
id is the least that isn't null; null if there is none. Rows are documents of their own even if ids repeat; rows that
repeat id and text are one set, and `one_of_each` keeps one of them. An empty table gives an empty result. Other
columns, whatever their names, are left out (`one_of_each`: kept unchanged).
Shingles of two compared texts are told apart by 64 bits, components in the join of lists by 64 bits, sets and texts by 128.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_column, discard, fresh, hashed_words, input_mb, remove, rolling, saved, workspace
from .components import components
from .keyed import binary, bucket_bits, joined, pack, shared, slices, unpack

BATCH = 1_000_000  # shingles
ROWS = 256  # texts whose words are hashed together
DOC = np.dtype([("id", "<i8"), ("null", "<i4"), ("n", "<i4"), ("row", "V16"), ("node", "V16"), ("sampled", "<i4"), ("known", "<i4")])
REP = np.dtype([("node", "V16"), ("n", "<i4")])
SHORT = 39  # bits of a sampled hash below the bucket's
SIGNATURE = 8  # 64-bit words of a signature
BEFORE = 4  # earlier shingles of a prefix that go with a list's entry
LONG_LIST = 20_000  # entries of a list that one window sorts


def needed(n, percent: int):
    """Least overlap that a set of n needs with any partner: ceil(percent * n / 100)."""
    return -(-n * percent // 100)


def shingles(texts: list[bytes], k: int):
    """The sorted set of each text."""
    words, counts = hashed_words(texts)
    runs, at = rolling(words, k), 0
    for n in counts.tolist():
        yield np.unique(runs[at : at + n - k + 1] if n >= k else rolling(words[at : at + n], n) if n else runs[:0])
        at += n


def _parts(batches):
    """Rows that are shingled together."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def signature(tokens: np.ndarray) -> np.ndarray:
    """Parity bits of hashed tokens: two sets differ in at least as many tokens as their signatures in bits."""
    places = tokens * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 6 - (SIGNATURE.bit_length() - 1))
    odd = np.bincount(places.astype(np.int64), minlength=64 * SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _sets(rows: DataFrame, k: int, percent: int, bits: int) -> DataFrame:
    """id, n, row (digest of the text), node (digest of the set), near: whether it can have a partner."""

    def sample(batches):
        import pyarrow as pa
        import xxhash

        held, docs, n, number = [], [], 0, 0

        def flush():
            table = np.array(docs, DOC)
            keys, at, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(docs)), table["sampled"])
            multi = count > 1
            table["known"] = np.bincount(owner[multi[at]], minlength=len(docs))
            where = np.zeros(len(keys), "<u2")
            where[at] = owner
            batch = (TaskContext.get().partitionId() << 24) + number
            value = (keys << np.uint64(bits)) >> np.uint64(64 - SHORT) << np.uint64(1) | multi.astype(np.uint64)
            single, cut = ~multi, slices(keys, bits)
            start = np.array([x for _, x, _ in cut], np.int64)
            size, alone = np.diff([*start, len(keys)]), np.add.reduceat(single, start, dtype=np.int64) if len(cut) else start
            return pa.RecordBatch.from_arrays(
                [pa.array([batch % (1 << bits), *(x for x, _, _ in cut)], pa.int64()), pa.array([batch] * (len(cut) + 1), pa.int64()), binary(np.frombuffer(pack(value, 5), np.uint8), [0, *(5 * size)]),
                 binary(where[single].view(np.uint8), [0, *(2 * alone)]), pa.array([table.tobytes(), *[None] * len(cut)], pa.binary())],
                ["bucket", "batch", "keys", "places", "docs"],
            )

        for batch in _parts(batches):
            for i, row, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingles(byte_column(batch, "text"), k)):
                part = own[own & np.uint64(1) == 0]
                docs.append((i or 0, i is None, len(own), row, xxhash.xxh3_128_digest(own.tobytes()), len(part), 0))
                held.append(part)
                n += len(part)
                if n >= BATCH or len(docs) == 65_535:
                    yield flush()
                    held, docs, n, number = [], [], 0, number + 1
        if docs:
            yield flush()

    def meet(table):
        import pyarrow as pa

        told = table.filter(table.column("docs").is_valid()).select(["batch", "docs"])
        table = table.filter(table.column("docs").is_null())
        data, size = joined(table.column("keys"))
        values, places, size = unpack(data, 5), joined(table.column("places"))[0].view("<u2"), size // 5
        counts, rows = np.zeros((0, 2), "<i4"), np.zeros(0, np.int64)
        if len(values):
            multi = (values & np.uint64(1)) > 0
            hit = shared(values >> np.uint64(1), multi)[~multi]
            own = np.repeat(np.arange(len(size)), size)[~multi][hit]
            pairs, count = np.unique(own << 16 | places[hit], return_counts=True)
            counts = np.stack([pairs & 0xFFFF, count], 1).astype("<i4")
            rows = np.bincount(pairs >> 16, minlength=len(size))
        met = table.select(["batch"]).filter(pa.array(rows > 0)) if len(rows) else table.select(["batch"]).slice(0, 0)
        batch = pa.chunked_array([*told.column("batch").chunks, *met.column("batch").chunks], pa.int64())
        return pa.table({"batch": batch, "counts": pa.chunked_array([pa.nulls(len(told), pa.binary()), binary(counts.view(np.uint8), 8 * rows[rows > 0])]), "docs": pa.chunked_array([*(c.cast(pa.binary()) for c in told.column("docs").chunks), pa.nulls(len(met), pa.binary())], pa.binary())}).combine_chunks()

    def judge(table):
        import pyarrow as pa

        docs = joined(table.column("docs"))[0].view(DOC)
        known = docs["known"].astype(np.int64)
        doc, count = joined(table.column("counts"))[0].view("<i4").reshape(-1, 2).T
        known += np.bincount(doc, count, minlength=len(docs)).astype(np.int64)
        n = docs["n"].astype(np.int64)
        near = (n > 0) & (known >= docs["sampled"] - (n - needed(n, percent)))
        return pa.table({"id": pa.array(docs["id"], mask=docs["null"] > 0), "n": pa.array(n), **{c: binary(np.ascontiguousarray(docs[c]).view(np.uint8), [16] * len(docs)) for c in ("row", "node")}, "near": pa.array(near)})

    dealt = rows.mapInArrow(sample, "bucket long, batch long, keys binary, places binary, docs binary")
    met = dealt.groupBy("bucket").applyInArrow(meet, "batch long, counts binary, docs binary")
    return met.groupBy("batch").applyInArrow(judge, "id long, n long, row binary, node binary, near boolean")


def _lists(rows: DataFrame, wanted: DataFrame, k: int, percent: int, bits: int) -> DataFrame:
    """One row a set: node, n, group, prefix (shingles that others share, rarest first), first (rank of the first of them),
    tokens (all shingles that others share), sig (their signature). Rows that repeat a set only make its shingles look more
    frequent, which leaves all bounds valid. Saved."""
    spark = rows.sparkSession

    def pack_sets(batches):
        import pyarrow as pa
        import xxhash

        held, docs, met, n, number = [], [], set(), 0, 0

        def flush():
            batch = (TaskContext.get().partitionId() << 24) + number
            return pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([np.array(docs, REP).tobytes()], pa.binary()), pa.array([np.concatenate(held).tobytes()], pa.binary())], ["batch", "docs", "sets"])

        for batch in _parts(batches):
            for own in shingles(byte_column(batch, "text"), k):
                node = xxhash.xxh3_128_digest(own.tobytes())
                if node in met:
                    continue
                met.add(node)
                docs.append((node, len(own)))
                held.append(own)
                n += len(own)
                if n >= BATCH:
                    yield flush()
                    held, docs, met, n, number = [], [], set(), 0, number + 1
        if docs:
            yield flush()

    def tell(batches):
        import pyarrow as pa

        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, count = np.unique(np.frombuffer(data, "<u8"), return_counts=True)
                out = slices(keys, bits)
                size = np.array([y - x for _, x, y in out], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _, _ in out], pa.int64()), pa.array([number] * len(out), pa.int64()), binary(keys.view(np.uint8), 8 * size), binary(count.astype("<u4").view(np.uint8), 4 * size)],
                    ["bucket", "batch", "keys", "counts"],
                )

    def rarity(table):
        import pyarrow as pa

        keys, size = joined(table.column("keys"))
        _, at = np.unique(keys.view("<u8"), return_inverse=True)
        total = np.bincount(at, joined(table.column("counts"))[0].view("<u4"))
        code = np.minimum(255, np.floor(8 * np.log2(total))).astype(np.uint8)[at]
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "codes": binary(code, size // 8)})

    def order(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for docs, data, told in zip(*(batch.column(c).to_pylist() for c in range(3))):
                docs, sets = np.frombuffer(docs, REP), np.frombuffer(data, "<u8")
                keys, at = np.unique(sets, return_inverse=True)
                code = np.frombuffer(b"".join(x["codes"] for x in sorted(told, key=lambda x: x["bucket"])), np.uint8)[at]
                cuts = np.cumsum([0, *docs["n"]])
                rows = {"node": [], "n": [], "group": [], "prefix": [], "first": [], "tokens": [], "sig": []}
                for doc, a, b in zip(docs, cuts[:-1], cuts[1:]):
                    own, rare, n = sets[a:b], code[a:b], int(b - a)
                    ranked = own[np.lexsort((own, rare))]
                    first, length = int((rare == 0).sum()), n - int(needed(n, percent)) + 1
                    prefix = ranked[first : max(first, length)]
                    node = doc["node"].tobytes()
                    rows["node"].append(node)
                    rows["n"].append(n)
                    rows["group"].append(node if first else xxhash.xxh3_128_digest(prefix.tobytes() + n.to_bytes(8, "little")))
                    rows["prefix"].append(prefix.view(np.int64))
                    rows["first"].append(first)
                    rows["tokens"].append(ranked[first:].tobytes())
                    rows["sig"].append(signature(ranked[first:]))
                kinds = {"node": pa.binary(), "n": pa.int64(), "group": pa.binary(), "prefix": pa.list_(pa.int64()), "first": pa.int64(), "tokens": pa.binary(), "sig": pa.list_(pa.int64())}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds[c]) for c, v in rows.items()], list(rows))

    path = workspace(spark, "sets")
    rows.join(wanted, rows["id"].eqNullSafe(wanted["least"]) & (rows["row"] == wanted["text_row"]), "left_semi").select("text").mapInArrow(pack_sets, "batch long, docs binary, sets binary").write.parquet(path)
    packed = spark.read.schema("batch long, docs binary, sets binary").parquet(path)
    told = packed.select("batch", "sets").mapInArrow(tell, "bucket long, batch long, keys binary, counts binary")
    told = told.groupBy("bucket").applyInArrow(rarity, "batch long, bucket long, codes binary")
    told = told.groupBy("batch").agg(F.collect_list(F.struct("bucket", "codes")).alias("told"))
    ordered = packed.join(told, "batch").select("docs", "sets", "told").mapInArrow(order, "node binary, n long, `group` binary, prefix array<long>, first long, tokens binary, sig array<long>")
    out = saved(ordered.where(F.size("prefix") > 0).dropDuplicates(["node"]), "lists")
    remove(spark, path)
    return out


def verified(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with the size of their intersection, `both`, and whether they are similar enough, `ok`."""
    side = lambda c: lists.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}"))

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            na, nb, ta, tb = (c.to_pylist() for c in batch.columns[2:])
            both = [len(np.intersect1d(np.frombuffer(u, "<u8"), np.frombuffer(v, "<u8"), assume_unique=True)) for u, v in zip(ta, tb)]
            ok = [100 * k >= percent * (x + y - k) for x, y, k in zip(na, nb, both)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(ok, pa.bool_())], ["a", "b", "both", "ok"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ta", "tb")
    return joined.mapInArrow(check, "a binary, b binary, both long, ok boolean")


def _first_pairs(lists: DataFrame, look: int) -> DataFrame:
    """A set with its group's leader and, of the lists of `look` shingles of its prefix (the rarest and those of least hash), with
    the centre (the set with the smallest share of shingles of its own) and the neighbour by size that it meets most often.

    Lists beyond LONG_LIST entries are dealt into parts for the order by size; their centre is the same in all parts."""
    leaders = lists.groupBy("group").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1")
    inner = lists.select("group", F.col("node").alias("b")).join(leaders, "group").where("a <> b").select("a", "b")
    some = F.array_union(F.slice("prefix", 1, look // 2), F.slice(F.array_sort("prefix"), 1, look - look // 2))
    posts = lists.select("node", "n", (F.col("first") / F.col("n")).alias("own"), F.explode(some).alias("token"))
    centres = posts.groupBy("token").agg(F.min(F.struct("own", "node")).alias("centre"), F.count(F.lit(1)).alias("m")).where("m > 1")
    posts = posts.join(centres, "token").withColumn("part", F.expr(f"pmod(xxhash64(node), m div {LONG_LIST} + 1)"))
    beside = posts.withColumn("a", F.lag("node").over(Window.partitionBy("token", "part").orderBy("n", "node")))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("centre.node").alias("a")), F.struct(F.lit(1).alias("kind"), F.col("a")))
    met = beside.select(F.col("node").alias("b"), F.inline(kinds)).where("a <> b").groupBy("b", "kind", "a").count()
    best = met.groupBy("b", "kind").agg(F.max(F.struct("count", "a")).alias("best")).select("best.a", "b")
    return inner.unionByName(best).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(percent: int, one: str, two: str) -> str:
    """The bounds by size and by symmetric difference that two groups (or sets) may still meet, as SQL: n, f (shingles of
    one's own), l0.. and h0.. (signature bits that all members have, that any member has)."""
    differ = " + ".join(f"bit_count(({one}.l{i} & ~{two}.h{i}) | (~{one}.h{i} & {two}.l{i}))" for i in range(SIGNATURE))
    return (
        f"100 * {one}.n >= {percent} * {two}.n and 100 * {two}.n >= {percent} * {one}.n"
        f" and {100 + percent} * ({one}.f + {two}.f + {differ}) <= {100 - percent} * ({one}.n + {two}.n)"
    )


def _with_roots(lists: DataFrame, roots: DataFrame) -> DataFrame:
    return lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _groups(lists: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups: group, c (their component, or a name of their own if they have several), mixed, lead (least member), m (members),
    n, f, prefix, signature bits. Open lists: token, big (the component with most groups), of the lists that hold two
    components. Both saved."""
    bits = [f(F.col("sig")[i]).alias(f"{c}{i}") for i in range(SIGNATURE) for c, f in (("l", F.bit_and), ("h", F.bit_or))]
    groups = _with_roots(lists, roots).withColumn("c", F.xxhash64("root")).groupBy("group").agg(
        F.min("c").alias("low"), F.max("c").alias("high"), F.min("node").alias("lead"), F.count(F.lit(1)).alias("m"),
        F.first("n").cast("int").alias("n"), F.first("first").cast("int").alias("f"), F.first("prefix").alias("prefix"), *bits,
    )
    groups = saved(groups.withColumn("c", F.expr("if(low = high, low, xxhash64(`group`))")).withColumn("mixed", F.expr("low <> high")).drop("low", "high"), "groups")
    counted = groups.select("c", F.explode("prefix").alias("token")).groupBy("token", "c").count()
    open_ = counted.groupBy("token").agg(F.max(F.struct("count", "c")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return groups, saved(open_.select("token", F.col("most.c").alias("big")), "open")


def _central_pairs(groups: DataFrame, open_: DataFrame) -> DataFrame:
    """Each group outside the largest component of an open list with that component's centre there (least share of shingles of its
    own); of these centres, the one that it meets most often."""
    posts = groups.select("c", "lead", F.expr("f / n").alias("own"), F.explode("prefix").alias("token")).join(open_, "token")
    centres = posts.where("c = big").groupBy("token").agg(F.min(F.struct("own", "lead")).alias("centre"))
    met = posts.where("c <> big").join(centres, "token").groupBy(F.col("lead").alias("b"), F.col("centre.lead").alias("a")).count()
    best = met.groupBy("b").agg(F.max(F.struct("count", "a")).alias("best"))
    return best.select(F.least("best.a", "b").alias("a"), F.greatest("best.a", "b").alias("b")).distinct()


def _group_pairs(groups: DataFrame, open_: DataFrame, percent: int) -> DataFrame:
    """(g1, g2, lead1, lead2, many): pairs of groups of different components that pass the prefix, length, positional and signature
    bounds, each group's least member, and whether there are others. A group of several components meets itself too. Saved.

    The largest component of a list is joined with the others only, never with itself."""
    before = F.expr(f"slice(prefix, greatest(1, at + 1 - {BEFORE}), least(at, {BEFORE})) AS before")
    bits = [f"{c}{i}" for i in range(SIGNATURE) for c in "lh"]
    posts = groups.select("group", "c", "lead", "m", "n", "f", *bits, F.posexplode("prefix").alias("at", "token"), "prefix")
    posts = posts.select("token", "group", "c", "lead", "m", "n", "f", *bits, "at", before)
    posts = saved(posts.join(open_, "token").withColumn("largest", F.expr("c = big")).drop("big"), "posts")
    # at counts from the first shared shingle on: so many before it can be in both, and what is behind it
    most = "least(x.at, y.at) + least(x.n - x.f - x.at, y.n - y.f - y.at)"
    possible = f"{100 + percent} * ({most}) >= {percent} * (x.n + y.n) and {_apart(percent, 'x', 'y')} and not arrays_overlap(x.before, y.before)"
    rest, big = posts.where("not largest"), posts.where("largest")
    pairs = [big.alias("x").join(rest.alias("y"), F.expr(f"x.token = y.token and {possible}")), rest.alias("x").join(rest.alias("y"), F.expr(f"x.token = y.token and x.c < y.c and {possible}"))]
    ends = [F.col("x.group").alias("g1"), F.col("y.group").alias("g2"), F.col("x.lead").alias("lead1"), F.col("y.lead").alias("lead2"), F.expr("x.m > 1 or y.m > 1").alias("many")]
    swapped = F.expr("if(g1 < g2, struct(g1, g2, lead1, lead2, many), struct(g2 AS g1, g1 AS g2, lead2 AS lead1, lead1 AS lead2, many)) AS p")
    found = pairs[0].select(*ends).unionByName(pairs[1].select(*ends)).select(swapped).select("p.*").distinct()
    inside = groups.where("mixed").select(F.col("group").alias("g1"), F.col("group").alias("g2"), F.col("lead").alias("lead1"), F.col("lead").alias("lead2"), F.lit(True).alias("many"))
    return saved(found.unionByName(inside), "pairs", drop=(posts,))


def _member_pairs(lists: DataFrame, roots: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs of members, still apart, of the group pairs that have more than their leaders."""
    sides = [F.col("sig")[i].alias(f"{c}{i}") for i in range(SIGNATURE) for c in "lh"]
    members = _with_roots(lists, roots).select("group", "node", "root", "n", F.col("first").alias("f"), *sides)
    out = pairs.where("many").select("g1", "g2").alias("p").join(members.alias("x"), F.expr("x.group = p.g1"))
    out = out.join(members.alias("y"), F.expr(f"y.group = p.g2 and x.root <> y.root and (p.g1 <> p.g2 or x.node < y.node) and {_apart(percent, 'x', 'y')}"))
    return out.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _linked(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Saved."""
    return saved(verified(pairs, lists, percent).where("ok").select("a", "b"), "links")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75, look: int = 8, small_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, class_size (rows with an equal set), row (MD5 of the text), component
    (its key; null for sets that can't have a partner). Saved."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("row"), text.alias("text"))
    bits = bucket_bits(input_mb(docs, text_col))
    sets = saved(_sets(rows, k, percent, bits), "rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    classes = sets.where("near").groupBy("node").agg(first, F.count(F.lit(1)).alias("class_size"))
    classes = saved(classes.select("node", F.col("first.id").alias("least"), F.col("first.row").alias("text_row"), "class_size"), "classes")
    # the classes' rows are sent to all only if they are proven few; else texts are dealt by row
    wanted = F.broadcast(classes) if classes.count() <= small_rows else classes
    lists = _lists(rows, wanted, k, percent, bits)
    links = _linked(_first_pairs(lists, look), lists, percent)
    roots = components(links)

    def add(late: DataFrame) -> None:
        nonlocal links, roots
        if not late.isEmpty():
            links, gone = saved(links.unionByName(late), "links", drop=(links,)), roots
            roots = components(links)
            discard(gone)
        discard(late)

    groups, open_ = _groups(lists, roots)
    add(_linked(_central_pairs(groups, open_), lists, percent))
    discard(groups, open_)
    groups, open_ = _groups(lists, roots)
    pairs = _group_pairs(groups, open_, percent)
    discard(groups, open_)
    leaders = pairs.where("lead1 <> lead2").select(F.least("lead1", "lead2").alias("a"), F.greatest("lead1", "lead2").alias("b"))
    add(_linked(leaders.distinct(), lists, percent))
    add(_linked(_member_pairs(lists, roots, pairs, percent), lists, percent))
    named = classes.join(roots, "node", "left").select("node", "least", "class_size", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(least, "root").select("node", "component_id", "class_size", "root")
    out = sets.join(found, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("class_size").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
        "row", F.col("root").alias("component"),
    )
    return saved(out, "components", drop=(sets, classes, lists, links, roots, pairs))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each component: that with the least id (a null id last), then the least text digest; of rows that
    repeat id and text, one."""
    found = jaccard_components(docs, id_col=id_col, text_col=text_col, **options)
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "row")).alias("best")
    kept = found.where("component is not null").groupBy("component").agg(best).select("best.id", "best.row")
    alone = found.where("component is null").select(F.col(id_col).alias("id"), "row")
    again = not found.groupBy(id_col, "row").count().where("count > 1").isEmpty()
    kept = saved(kept.unionByName(alone).distinct(), "kept", drop=(found,))
    row, number = fresh("row", docs.columns), fresh("number", docs.columns)
    rows = docs.withColumn(row, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    rows = rows.join(kept, rows[id_col].cast("long").eqNullSafe(kept["id"]) & (rows[row] == kept["row"]), "left_semi")
    if not again:
        return rows.select(*docs.columns)
    once = Window.partitionBy(id_col, row).orderBy(F.lit(1))
    return rows.withColumn(number, F.row_number().over(once)).where(F.col(number) == 1).select(*docs.columns)


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    out = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + least(len(w), 5) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reached) AS component_id
FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
