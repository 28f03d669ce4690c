"""Process relations: `event of`, `child of` and `descendant of`, as a boolean column each.

State is a set of process ids per scope, changed in the order of events: first the lifecycle (removal of those marked dead
before, a start of System that clears all, children of known parents, marks of the terminated), then the sources, then
the event is judged. A mark is taken up by the next process event, so of each process event only the one before matters.

In windows: process events and sources alone, without their payload, give the changes of the set. Each needs the process event
before it and the start of System after it. As a scope may hold most of the events, it is cut into stretches of the order, and
what lies before and after a stretch comes from one row for each. An id's additions, removals and lookups are rows of their own
then, kept apart by scope and id, and the latest addition or removal tells; a clearing is a removal of what was added since the
last. Only `descendant of`, where additions depend on earlier ones, folds process events and sources in order, as ids, in a
task that holds only ids. Give the binding scope_cols (a host, say): without them all events share one state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compile import Compiler
from ..functions.values import Value
from ..plans.nodes import Query, Relation, walk
from .matching import Settings, event_scope, stage_test

#: Cuts of the order (one less than a power of two) and the rows that they are taken from.
CUTS, SAMPLE = 255, 4096


def relations_of(query: Query) -> list[Relation]:
    """All relations of a query, inner ones before those that hold them, each once."""
    found: dict[Relation, None] = {}

    def visit(node) -> None:
        for part in walk(node):
            if isinstance(part, Relation) and part not in found:
                visit(part.stage.where)
                found.setdefault(part)

    for stage in [*query.stages, *([query.until] if query.until else [])]:
        visit((stage.where, stage.by))
    visit(query.by)
    visit(tuple(p.args for p in query.pipes))
    return list(found)


def _key(v: Value | None, zero: bool) -> Column:
    """An id as text, null if it can't be one."""
    if v is None or v.kind in ("null", "object"):
        return F.lit(None).cast("string")
    out = v.col.cast("string") if v.kind != "array" else F.to_json(v.col)
    if v.kind == "string":
        return F.when(F.length(v.col) > 0, out)
    if v.kind == "bool":
        return F.when(v.col, out)
    return out if zero or not v.number else F.when(v.col != 0, out)


def related(df: DataFrame, query: Query, settings: Settings) -> tuple[DataFrame, dict[Relation, Column]]:
    """df with a column for each relation of the query."""
    columns: dict[Relation, Column] = {}
    relations = relations_of(query)
    if relations:
        rows = df.select("ord", _scope(settings), *lifecycle(df, settings, {}))
        cuts = _cuts(rows)
        edges = _edges(rows, cuts)
    for n, relation in enumerate(relations):
        df = _with(df, relation, f"r{n}", settings, columns, cuts, edges)
        columns[relation] = F.col(f"r{n}")
    return df, columns


def lifecycle(df: DataFrame, settings: Settings, known: dict[Relation, Column]) -> list[Column]:
    """What an event does to the set of processes: _p process event, _c start, _e end, _r start of System, and the ids _pid, _own
    (as a source), _parent."""
    binding = settings.binding
    field = event_scope(df, settings, known).field
    opcode, subtype, title, pid = field("opcode"), field("subtype"), field("process_name"), field(binding.pid_col)
    if settings.by_opcode:
        code = opcode.col if opcode is not None and opcode.kind == "int" else F.lit(None).cast("long")
        create, ends = code.isin(1, 3, 9), code.isin(2, 4)
    else:
        kind = subtype.col if subtype is not None and subtype.kind == "string" else F.lit(None).cast("string")
        create, ends = kind.isin("create", "fork"), kind == "terminate"
    four = pid.col == 4 if pid is not None and pid.number else F.lit(False)
    system = title.col == "System" if title is not None and title.kind == "string" else F.lit(False)
    process = F.col("type") == "process"
    tests = {"_p": process, "_c": process & create, "_e": process & ends, "_r": process & create & four & system}
    ids = {"_pid": _key(pid, True), "_own": _key(pid, False), "_parent": _key(field(binding.ppid_col), True)}
    return [*(F.coalesce(c, F.lit(False)).alias(n) for n, c in tests.items()), *(c.alias(n) for n, c in ids.items())]


def _scope(settings: Settings) -> Column:
    return F.struct(*[F.col("event").getField(c).alias(c) for c in settings.binding.scope_cols] or [F.lit(0).alias("all")]).alias("_s")


def _cuts(rows: DataFrame) -> DataFrame:
    """One row: `_at`, places in the order with about as many rows from each to the next. They are read off the rows whose places
    have the least digests, so they are the same whenever they are computed."""
    some = rows.select("ord").orderBy(F.xxhash64("ord"), "ord").limit(SAMPLE).agg(F.sort_array(F.collect_list("ord")).alias("_x"))
    return some.select(F.transform(F.sequence(F.lit(1), F.lit(CUTS)), lambda i: F.get("_x", F.floor(i * F.size("_x") / (CUTS + 1)).cast("int"))).alias("_at"))


def _cut(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows with `_b`, the number of cuts up to their place, by bisection."""
    columns = rows.columns
    rows = rows.crossJoin(F.broadcast(cuts)).withColumn("_b", F.lit(0))
    for n in range(1, CUTS.bit_length() + 1):  # a step each: as one expression it would double with each step
        half = (CUTS + 1) >> n
        rows = rows.withColumn("_b", F.col("_b") + F.when(F.get("_at", F.col("_b") + half - 1) <= F.col("ord"), half).otherwise(0))
    return rows.select(*columns, "_b")


def _edges(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """For each scope's stretches that have events: `_end`, the last process event before, and `_next`, the first start of System after."""
    own = _cut(rows.where("_p"), cuts).groupBy("_s", "_b").agg(F.max_by(F.struct("_e", "_pid"), "ord").alias("_own"), F.min(F.when(F.col("_r"), F.col("ord"))).alias("_first"))
    every = _cut(rows.select("_s", "ord"), cuts).select("_s", "_b").distinct().withColumn("_every", F.lit(True))
    by_scope, earlier = Window.partitionBy("_s"), (Window.unboundedPreceding, -1)
    before, after = by_scope.orderBy("_b").rangeBetween(*earlier), by_scope.orderBy(F.desc("_b")).rangeBetween(*earlier)
    both = every.unionByName(own, allowMissingColumns=True)
    return both.select("_s", "_b", "_every", F.last("_own", True).over(before).alias("_end"), F.min("_first").over(after).alias("_next")).where("_every").drop("_every")


def _along(slim: DataFrame, cuts: DataFrame, edges: DataFrame) -> DataFrame:
    """slim with `_gone`, the id that a process event removes, and `_clear`, the place of the first start of System after."""
    rows = _cut(slim, cuts).unionByName(edges, allowMissingColumns=True)  # a stretch's edges have no place and come first either way
    stretch, earlier = Window.partitionBy("_s", "_b"), (Window.unboundedPreceding, -1)
    last = F.last(F.coalesce("_end", F.when(F.col("_p"), F.struct("_e", "_pid"))), True).over(stretch.orderBy("ord").rowsBetween(*earlier))
    clear = F.last(F.coalesce("_next", F.when(F.col("_r"), F.col("ord"))), True).over(stretch.orderBy(F.desc_nulls_first("ord")).rowsBetween(*earlier))
    rows = rows.select(*slim.columns, last.alias("_last"), clear.alias("_clear")).where("ord is not null")
    return rows.withColumn("_gone", F.when(F.col("_p") & F.col("_last._e"), F.col("_last._pid"))).drop("_last")


def _with(df: DataFrame, relation: Relation, name: str, settings: Settings, known: dict[Relation, Column], cuts: DataFrame, edges: DataFrame) -> DataFrame:
    test = stage_test(relation.stage, Compiler(event_scope(df, settings, known)))
    life = lifecycle(df, settings, known)
    slim = df.select(_scope(settings), "ord", *life, test.alias("_w")).where("_p or _w")
    if relation.kind == "descendant":
        changes = _descendants(slim)
    elif relation.kind == "child":
        changes = _children(_along(slim, cuts, edges))
    else:
        changes = _parts(_along(slim, cuts, edges), [*_sources(), (0, "ord", F.col("_gone"))])
    asked = df.select("*", _scope(settings), *life).withColumn("_k", F.col("_own" if relation.kind == "event" else "_pid"))
    asked = asked.select(*df.columns, "_s", F.lit(3).alias("_step"), _spread("_k").alias("_k"), F.col("_k").isNotNull().alias("_id"))
    rows = asked.unionByName(changes.select("_s", "ord", "_step", "_k"), allowMissingColumns=True).withColumn("_held", _known())
    return rows.where("_step = 3").select(*df.columns, (F.col("_held") & F.col("_id")).alias(name))


def _spread(name: str) -> Column:
    """An id as a key; without one a key of its own, so that such rows don't meet."""
    return F.coalesce(F.col(name), F.concat(F.lit("\0"), F.xxhash64("ord").cast("string")))


def _parts(rows: DataFrame, parts: list[tuple[int, str, Column]], *keep: str) -> DataFrame:
    """A row for each part that has a place and a key: `ord`, `_k` and `_step` (-1 removal by clearing, 0 removal, 1 and 2 addition, 3 lookup)."""
    all_ = F.array(*[F.struct(F.lit(step).alias("_step"), F.col(at).alias("ord"), key.alias("_k")) for step, at, key in parts])
    some = F.filter(all_, lambda x: x.getField("_k").isNotNull() & x.getField("ord").isNotNull())
    return rows.select("_s", *keep, F.explode(some).alias("_x")).select("_s", *keep, "_x.*")


def _sources() -> list[tuple[int, str, Column]]:
    source = F.when(F.col("_w"), F.col("_own"))
    return [(2, "ord", source), (-1, "_clear", source)]


def _known(additions: tuple[int, ...] = (1, 2)) -> Column:
    """Whether the key's latest change so far is an addition."""
    window = Window.partitionBy("_s", "_k").orderBy("ord", "_step").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("_step") <= 0, False).when(F.col("_step").isin(*additions), True), True).over(window)
    return F.coalesce(latest, F.lit(False))


def _children(slim: DataFrame) -> DataFrame:
    """The changes of the processes under a source: those started whose parent is a source then, looked up before the event's own
    addition, and removals."""
    parent = F.when(F.col("_p") & F.col("_c") & ~F.col("_r") & F.col("_pid").isNotNull(), F.col("_parent"))
    rows = _parts(slim, [*_sources(), (0, "ord", F.col("_gone")), (1, "ord", parent)], "_pid", "_clear").withColumn("_under", _known((2,)))
    rows = rows.where("_step = 0 or _step = 1 and _under").withColumnRenamed("_k", "_asked").withColumnRenamed("_step", "_was")
    started = F.when(F.col("_was") == 1, F.col("_pid"))
    return _parts(rows, [(1, "ord", started), (-1, "_clear", started), (0, "ord", F.when(F.col("_was") == 0, F.col("_asked")))])


def _descendants(slim: DataFrame) -> DataFrame:
    """The changes of the processes under a source: those started whose parent is a source or under one then, and removals."""
    names = ["_p", "_c", "_e", "_r", "_w", "_pid", "_own", "_parent"]
    rows = slim.select("_s", "ord", *names).repartition("_s").sortWithinPartitions("_s", "ord")

    def fold(batches):
        import pyarrow as pa

        scope, first = None, True
        for batch in batches:
            at = {c: batch.column(batch.schema.get_field_index(c)) for c in ("_s", "ord", *names)}
            places, steps, keys = [], [], []

            def change(i, step, *ids):
                places.extend([i] * len(ids))
                steps.extend([step] * len(ids))
                keys.extend(ids)

            for i, (s, p, c, e, r, w, pid, own, parent) in enumerate(zip(*(at[c].to_pylist() for c in ("_s", *names)))):
                if first or s != scope:
                    scope, first, sources, under, dead = s, False, set(), set(), None
                if p:
                    if dead is not None:
                        sources.discard(dead)
                        if dead in under:
                            under.discard(dead)
                            change(i, 0, dead)
                    dead = pid if e else None
                if r:
                    change(i, -1, *under)
                    sources, under = set(), set()
                elif p and c and pid is not None and pid not in under and (parent in sources or parent in under):
                    under.add(pid)
                    change(i, 1, pid)
                if w and own is not None:
                    sources.add(own)
            if places:
                taken = pa.array(places)
                yield pa.RecordBatch.from_arrays([at["_s"].take(taken), at["ord"].take(taken), pa.array(steps, pa.int32()), pa.array(keys, pa.string())], ["_s", "ord", "_step", "_k"])

    return rows.mapInArrow(fold, T.StructType([rows.schema["_s"], rows.schema["ord"], T.StructField("_step", T.IntegerType()), T.StructField("_k", T.StringType())]))
