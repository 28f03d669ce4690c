"""One named query per operator over the driver's tables, with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Engine, EventBinding, Options, compile, matches

BINDING = EventBinding(type_col="event_type", time_col="ts", order_cols=("ts", "event_id"))
PROCESS = EventBinding(type_col="kind", time_col="ts", order_cols=("ts", "event_id"), scope_cols=("hostname",))

Query = Callable[[SparkSession, str], DataFrame]

#: The events with some derived fields, for both sides.
EVENTS_SQL = """
SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'h' || (user_id % 5) AS hostname,
  CASE WHEN event_id % 7 <> 0 THEN upper(event_type) || '_' || (user_id % 9) END AS name,
  (user_id % 4) || '.' || (event_id % 256) || '.' || (user_id % 256) || '.7' AS ip,
  [event_type, 'u' || (user_id % 3), CASE WHEN event_id % 5 <> 0 THEN 'x' END] AS tags,
  CASE WHEN event_id % 3 = 0 THEN '0x1f' WHEN event_id % 3 = 1 THEN CAST(user_id AS VARCHAR) ELSE 'abc' END AS txt
FROM events
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    user, number = F.col("user_id"), F.col("event_id")
    return df.select(
        "event_id", "ts", "user_id", "event_type", "value", F.from_json("props", "k bigint").getField("k").alias("k"), F.concat(F.lit("h"), text(user % 5)).alias("hostname"),
        F.when(number % 7 != 0, F.concat(F.upper("event_type"), F.lit("_"), text(user % 9))).alias("name"),
        F.concat_ws(".", text(user % 4), text(number % 256), text(user % 256), F.lit("7")).alias("ip"),
        F.array("event_type", F.concat(F.lit("u"), text(user % 3)), F.when(number % 5 != 0, F.lit("x"))).alias("tags"),
        F.when(number % 3 == 0, F.lit("0x1f")).when(number % 3 == 1, text(user)).otherwise(F.lit("abc")).alias("txt"),
    )


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as process and file events of a few hosts: sign-ups start, errors end processes."""
    df = events(spark, sf_dir)
    kind = F.when(F.col("event_type").isin("signup", "error"), F.lit("process")).otherwise(F.lit("file"))
    subtype = F.when(F.col("event_type") == "signup", F.lit("create")).when(F.col("event_type") == "error", F.lit("terminate"))
    return df.select(kind.alias("kind"), subtype.alias("subtype"), (F.col("k") % 23 + 1).alias("pid"), (F.col("user_id") % 23 + 1).alias("ppid"), F.col("name").alias("process_name"), "event_id", "ts", "value", "hostname")


def _restarts(df: DataFrame) -> DataFrame:
    """The same, but some starts are those of System, after which nothing is known."""
    system = (F.col("subtype") == "create") & (F.col("event_id") % 11 == 0)
    return df.withColumn("pid", F.when(system, 4).otherwise(F.col("pid"))).withColumn("process_name", F.when(system, "System").otherwise(F.col("process_name")))


def _events(text: str, *columns: str, options: Options = Options(), source: Callable[[DataFrame], DataFrame] = lambda df: df) -> Query:
    return lambda spark, d: compile(text, options).run(source(events(spark, d)), BINDING).selectExpr(*(columns or ("event_id",)))


def _ranked(text: str, *columns: str) -> Query:
    """A query whose order shows as `place`, from 1. Behind head or tail only, so the window is over a few rows."""

    def run(spark, d):
        from pyspark.sql import Window

        df = compile(text).frame(events(spark, d), BINDING)
        return df.select(F.row_number().over(Window.orderBy("ord")).alias("place"), *[F.col(f"event.{c}") for c in columns])

    return run


def _groups(text: str, *ids: str, options: Options = Options()) -> Query:
    """Matches with the event_id of each of their events."""
    return lambda spark, d: compile(text, options).frame(events(spark, d), BINDING).select(*[F.get("events", F.lit(i)).getField("event_id").alias(c) for i, c in enumerate(ids)])


def _processes(text: str) -> Query:
    return lambda spark, d: compile(text).run(processes(spark, d), PROCESS).select("event_id")


def _where(condition: str, columns: str = "event_id") -> str:
    return f"WITH e AS ({EVENTS_SQL}) SELECT {columns} FROM e WHERE {condition}"


def _pair(extra: str = "", fork: bool = False, condition: str = "") -> str:
    """Two-stage sequences by user_id: view, then purchase."""
    consumed = "" if fork else "AND (rp IS NULL OR rp <= rv)"
    return f"""
WITH e AS ({EVENTS_SQL}), x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM e),
y AS (SELECT *, max(CASE WHEN event_type = 'view' THEN rn END) OVER p AS rv, max(CASE WHEN event_type = 'purchase' THEN rn END) OVER p AS rp,
  max(CASE WHEN event_type = 'error' THEN rn END) OVER p AS re
  FROM x WINDOW p AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT v.event_id AS first_id, y.event_id AS last_id FROM y JOIN x v ON v.user_id = y.user_id AND v.rn = y.rv
WHERE y.event_type = 'purchase' {consumed} {extra}"""


def _steps(columns: str, start: str, emit: str, names: str) -> str:
    """A state machine per user: columns of state (their SQL from the state r and the next event x), row by row."""
    return f"""
WITH RECURSIVE x AS (SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, {start} FROM x
UNION ALL SELECT x.user_id, x.rn, {columns} FROM r JOIN x ON x.user_id = r.user_id AND x.rn = r.rn + 1)
SELECT {names} FROM r WHERE {emit}"""


_ID, _TIME = "CAST(NULL AS BIGINT)", "CAST(NULL AS TIMESTAMP)"
#: State: v, vt the latest view and its time; a, at_, b a view and click that wait; oa, ob, oc a match at this event.
_THREE = _steps(
    """CASE x.event_type WHEN 'error' THEN NULL WHEN 'view' THEN x.event_id WHEN 'click' THEN NULL ELSE v END,
  CASE x.event_type WHEN 'error' THEN NULL WHEN 'view' THEN x.ts WHEN 'click' THEN NULL ELSE vt END,
  CASE WHEN x.event_type IN ('error', 'purchase') THEN NULL WHEN x.event_type = 'click' AND x.ts - vt <= INTERVAL 3 DAY THEN v ELSE a END,
  CASE WHEN x.event_type IN ('error', 'purchase') THEN NULL WHEN x.event_type = 'click' AND x.ts - vt <= INTERVAL 3 DAY THEN vt ELSE at_ END,
  CASE WHEN x.event_type IN ('error', 'purchase') THEN NULL WHEN x.event_type = 'click' AND x.ts - vt <= INTERVAL 3 DAY THEN x.event_id ELSE b END,
  CASE WHEN x.event_type = 'purchase' AND x.ts - at_ <= INTERVAL 3 DAY THEN a END,
  CASE WHEN x.event_type = 'purchase' AND x.ts - at_ <= INTERVAL 3 DAY THEN b END,
  CASE WHEN x.event_type = 'purchase' AND x.ts - at_ <= INTERVAL 3 DAY THEN x.event_id END""",
    f"{_ID} AS v, {_TIME} AS vt, {_ID} AS a, {_TIME} AS at_, {_ID} AS b, {_ID} AS oa, {_ID} AS ob, {_ID} AS oc",
    "oa IS NOT NULL",
    "oa AS a, ob AS b, oc AS c",
)
#: State: v, vt the latest view; p, pt a view behind which an error of 20 at most has come; oa, ob a match.
_NEGATIVE = _steps(
    """CASE x.event_type WHEN 'view' THEN x.event_id WHEN 'error' THEN NULL ELSE v END, CASE x.event_type WHEN 'view' THEN x.ts WHEN 'error' THEN NULL ELSE vt END,
  CASE WHEN x.event_type = 'purchase' THEN NULL WHEN x.event_type = 'error' AND NOT coalesce(x.value > 20, false) AND x.ts - vt <= INTERVAL 2 DAY THEN v ELSE p END,
  CASE WHEN x.event_type = 'purchase' THEN NULL WHEN x.event_type = 'error' AND NOT coalesce(x.value > 20, false) AND x.ts - vt <= INTERVAL 2 DAY THEN vt ELSE pt END,
  CASE WHEN x.event_type = 'purchase' AND x.ts - pt <= INTERVAL 2 DAY THEN p END, CASE WHEN x.event_type = 'purchase' AND x.ts - pt <= INTERVAL 2 DAY THEN x.event_id END""",
    f"{_ID} AS v, {_TIME} AS vt, {_ID} AS p, {_TIME} AS pt, {_ID} AS oa, {_ID} AS ob",
    "oa IS NOT NULL",
    "oa AS a, ob AS b",
)
#: State: the slots a, b, c as they are with this event; full slots are a match and start anew at the next event.
_SLOT = "CASE WHEN x.event_type = 'error' THEN NULL WHEN x.event_type = '{}' {} AND (r.{c} IS NULL OR full_) THEN x.event_id WHEN NOT full_ THEN r.{c} END"
_JOIN = _steps(
    ", ".join([_SLOT.format("view", "", c="a"), _SLOT.format("click", "AND x.value > 20", c="b"), _SLOT.format("purchase", "", c="c")])
    + ", " + " AND ".join(f"({_SLOT.format(t, w, c=c)}) IS NOT NULL" for t, w, c in (("view", "", "a"), ("click", "AND x.value > 20", "b"), ("purchase", "", "c"))),
    f"{_ID} AS a, {_ID} AS b, {_ID} AS c, false AS full_",
    "full_",
    "a, b, c",
)

_PROCESS_SQL = f"""
WITH RECURSIVE e AS ({EVENTS_SQL}),
p AS (SELECT event_id, hostname, value, CASE WHEN event_type IN ('signup', 'error') THEN 'process' ELSE 'file' END AS kind,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'terminate' END AS subtype, k % 23 + 1 AS pid, user_id % 23 + 1 AS ppid,
  row_number() OVER (PARTITION BY hostname ORDER BY ts, event_id) AS rn FROM e),
-- a terminated id goes at the next process event of its host
gone AS (SELECT hostname, pid, next AS rn FROM (SELECT *, min(CASE WHEN kind = 'process' THEN rn END) OVER (PARTITION BY hostname ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM p)
  WHERE subtype = 'terminate' AND next IS NOT NULL),
-- for each event: when its id, if added there, goes again
t AS (SELECT p.*, (SELECT min(g.rn) FROM gone g WHERE g.hostname = p.hostname AND g.pid = p.pid AND g.rn > p.rn) AS until FROM p)"""


def _held(inner: str, *, events_of: str = "t", later: str = "<=") -> str:
    """Whether an event's id was added by an event of `inner` and has not gone since."""
    return f"EXISTS (SELECT 1 FROM {inner} s WHERE s.hostname = {events_of}.hostname AND s.pid = {events_of}.{{0}} AND s.rn {later} {events_of}.rn AND (s.until IS NULL OR s.until > {events_of}.rn))"


def _children(sources: str, name: str) -> str:
    return f"{name} AS (SELECT * FROM t WHERE kind = 'process' AND subtype = 'create' AND {_held(sources, later='<').format('ppid')})"


_EVENT_OF = f"{_PROCESS_SQL}, s0 AS (SELECT * FROM t WHERE kind = 'process' AND value > 40) SELECT event_id FROM t WHERE kind = 'file' AND {_held('s0').format('pid')}"
_CHILD_OF = f"{_PROCESS_SQL}, s0 AS (SELECT * FROM t WHERE kind = 'process' AND value > 40), {_children('s0', 'u0')} SELECT event_id FROM t WHERE {_held('u0').format('pid')}"
_DESCENDANT_OF = f"""{_PROCESS_SQL}, s0 AS (SELECT * FROM t WHERE kind = 'process' AND value > 90), {_children('s0', 'u0')},
u AS (SELECT hostname, pid, rn, until, event_id FROM u0
  UNION SELECT c.hostname, c.pid, c.rn, c.until, c.event_id FROM u JOIN t c ON c.subtype = 'create' AND c.hostname = u.hostname AND c.ppid = u.pid AND c.rn > u.rn AND (u.until IS NULL OR u.until > c.rn))
SELECT event_id FROM t WHERE {_held('u').format('pid')}"""
_NESTED = f"""{_PROCESS_SQL}, s0 AS (SELECT * FROM t WHERE kind = 'file' AND value > 60), s1 AS (SELECT * FROM t WHERE kind = 'process' AND {_held('s0').format('pid')}),
{_children('s1', 'u0')} SELECT event_id FROM t WHERE {_held('u0').format('pid')}"""

#: State: z, whether an error of 20 at most has come since the last match; o, a purchase that matches.
_FIRST_NEGATIVE = _steps(
    """CASE WHEN x.event_type = 'error' AND NOT coalesce(x.value > 20, false) THEN true WHEN x.event_type = 'purchase' THEN false ELSE z END,
  CASE WHEN x.event_type = 'purchase' AND z THEN x.event_id END""",
    f"false AS z, {_ID} AS o",
    "o IS NOT NULL",
    "o AS a",
)
_PAIRS = _pair().strip()


def _nth(sql: str) -> str:
    """Over the matches of _pair() with their payloads: f and l are the first and last events."""
    return f"WITH q AS ({_PAIRS}), f AS ({EVENTS_SQL}), m AS (SELECT q.first_id, q.last_id, f.*, l.ts AS last_ts FROM q JOIN f ON f.event_id = q.first_id JOIN f l ON l.event_id = q.last_id) {sql}"


_PURCHASES = "sequence by user_id [view where true] [purchase where true]"

#: As _CHILD_OF, where what was added before a start of System goes with it, and such a start is no child.
_RESET = f"""{_PROCESS_SQL.replace("k % 23 + 1 AS pid", "CASE WHEN event_type = 'signup' AND event_id % 11 = 0 THEN 4 ELSE k % 23 + 1 END AS pid")},
z AS (SELECT *, count(CASE WHEN kind = 'process' AND subtype = 'create' AND event_id % 11 = 0 THEN 1 END) OVER (PARTITION BY hostname ORDER BY rn) AS n FROM t),
u0 AS (SELECT c.* FROM z c WHERE c.kind = 'process' AND c.subtype = 'create' AND c.event_id % 11 <> 0 AND EXISTS (SELECT 1 FROM z s WHERE s.kind = 'process' AND s.value > 40
  AND s.hostname = c.hostname AND s.pid = c.ppid AND s.n = c.n AND s.rn < c.rn AND (s.until IS NULL OR s.until > c.rn)))
SELECT event_id FROM z WHERE EXISTS (SELECT 1 FROM u0 s WHERE s.hostname = z.hostname AND s.pid = z.pid AND s.n = z.n AND s.rn <= z.rn AND (s.until IS NULL OR s.until > z.rn))"""

ES = Options(extended=True, allow_sample=True, allow_negation=True, allow_runs=True)

_HOSTS = "list_sort(list_distinct(list(hostname))) AS hosts, CAST(count(DISTINCT hostname) AS INTEGER) AS total_hosts"

#: name -> (query, SQL or None)
CATALOG: dict[str, tuple[Query, str | None]] = {
    "sequence_maxspan": (
        _groups("sequence by user_id with maxspan=1d [view where true] [purchase where true]", "first_id", "last_id"),
        _pair("AND y.ts - v.ts <= INTERVAL 1 DAY"),
    ),
    "select_event": (_events("purchase where value > 100 and k in (1, 2, 3)"), _where("event_type = 'purchase' AND value > 100 AND k IN (1, 2, 3)")),
    "select_any": (_events("any where value <= 1.5"), _where("value <= 1.5")),
    "implied_any": (_events("value <= 0.5", options=Options(implied_any=True)), _where("value <= 0.5")),
    "implied_base": (_events("| filter value <= 0.5", options=Options(implied_base=True)), _where("value <= 0.5")),
    "projection_payload": (_events("click where value > 190", "event_id", "user_id", "event_type", "value", "k", "name"), _where("event_type = 'click' AND value > 190", "event_id, user_id, event_type, value, k, name")),
    "compare_strings_fold": (_events("any where name == 'VIEW_3' or name == 'click_4'"), _where("lower(name) IN ('view_3', 'click_4')")),
    "compare_case_sensitive": (_events("any where name == 'view_3' or name == 'CLICK_4'", options=Options(case_sensitive=True)), _where("name IN ('view_3', 'CLICK_4')")),
    "compare_order": (_events("any where name >= 'view' and value < 20 and value >= 3"), _where("lower(name) >= 'view' AND value < 20 AND value >= 3")),
    "null_test": (_events("view where name == null"), _where("event_type = 'view' AND name IS NULL")),
    "not_null_test": (_events("view where name != null and value > 50"), _where("event_type = 'view' AND name IS NOT NULL AND value > 50")),
    "in_set": (_events("any where name in ('view_1', 'PURCHASE_2', null)"), _where("lower(name) IN ('view_1', 'purchase_2')")),
    "not_in_set": (_events("error where name not in ('error_1', 'error_2')"), _where("event_type = 'error' AND name IS NOT NULL AND lower(name) NOT IN ('error_1', 'error_2')")),
    "in_dynamic": (_events("any where k in (user_id, 5)"), _where("k = user_id OR k = 5")),
    "wildcard_equals": (_events("any where name == 'v*_8'"), _where("lower(name) LIKE 'v%\\_8' ESCAPE '\\'")),
    "wildcard_not": (_events("signup where name != '*_8'"), _where("event_type = 'signup' AND lower(name) NOT LIKE '%\\_8' ESCAPE '\\'")),
    "logic_kleene": (_events("any where not (name == 'view_1' or value > 10) or k == 7"), _where("NOT (lower(name) = 'view_1' OR value > 10) OR k = 7")),
    "truthiness": (_events("any where length(name) and not (k - 5)"), _where("length(name) > 0 AND k = 5")),
    "math_floor_division": (_events("any where (k - 50) / 7 == -3 and (0 - k) % 7 == 2"), _where("floor((k - 50) / 7.0) = -3 AND ((((0 - k) % 7) + 7) % 7) = 2")),
    "math_functions": (_events("any where add(k, 2) == subtract(multiply(2, k), 3) or divide(value, 2) > 95"), _where("k + 2 = 2 * k - 3 OR value / 2 > 95")),
    "math_unary": (_events("any where -k < -97"), _where("-k < -97")),
    "fn_length": (_events("any where length(name) == 6"), _where("length(name) = 6")),
    "fn_wildcard": (_events("any where wildcard(name, 'v*1', '*k_2')"), _where("lower(name) LIKE 'v%1' OR lower(name) LIKE '%k\\_2' ESCAPE '\\'")),
    "fn_starts_with": (_events("any where startsWith(name, 'VIEW_')"), _where("starts_with(lower(name), 'view_')")),
    "fn_ends_with": (_events("any where endsWith(name, '_0')"), _where("ends_with(lower(name), '_0')")),
    "fn_string_contains": (_events("any where stringContains(name, 'chas') and value > 60"), _where("contains(lower(name), 'chas') AND value > 60")),
    "fn_match": (_events("any where match(name, 'v.*[13]$', '(?P<a>c)lick_2')"), _where("regexp_matches(name, '(?i)^(v.*[13]$|click_2)')")),
    "fn_match_lite": (_events("any where matchLite(name, 'SIGN')"), _where("regexp_matches(name, '(?i)^sign')")),
    "fn_string": (_events("any where string(k) == '42' or string(value) == '3.5'"), _where("k = 42 OR value = 3.5")),
    "fn_number": (_events("any where number(txt) == 31 or number(txt) == 12"), _where("txt IN ('0x1f', '31', '12')")),
    "fn_concat": (_events("any where concat(event_type, '-', k) == 'view-9'"), _where("event_type = 'view' AND k = 9")),
    "fn_index_of": (_events("any where indexOf(name, '_') == 4 and indexOf(name, 'e', 3) == null"), _where("instr(lower(name), '_') = 5 AND NOT contains(substr(lower(name), 4), 'e')")),
    "fn_substring": (_events("any where substring(name, -3, -1) == 'k_'", "event_id"), _where("lower(substr(name, length(name) - 2, 2)) = 'k_' AND length(name) >= 3")),
    "fn_between": (_events("any where between(name, 'I', '_') == 'EW'"), _where("lower(name) LIKE 'view\\_%' ESCAPE '\\'")),
    "fn_cidr_match": (_events("any where cidrMatch(ip, '1.16.0.0/12', '3.0.0.0/9')"), _where("(user_id % 4 = 1 AND event_id % 256 BETWEEN 16 AND 31) OR (user_id % 4 = 3 AND event_id % 256 < 128)")),
    "fn_array_contains": (_events("any where arrayContains(tags, 'U2', 'nothing') and arrayContains(tags, null)"), _where("user_id % 3 = 2 AND event_id % 5 = 0")),
    "fn_array_search": (_events("any where arraySearch(tags, t, t == 'u1' or startsWith(t, 'sign'))"), _where("user_id % 3 = 1 OR event_type = 'signup'")),
    "fn_array_count": (_events("any where arrayCount(tags, t, length(t) == 1) == 0"), _where("event_id % 5 = 0")),
    "fn_safe": (_events("any where safe(k % (user_id - user_id)) == null and value > 150"), _where("value > 150")),
    "array_index": (_events("any where tags[1] == 'u0' and tags[7] == null and value < 9"), _where("user_id % 3 = 0 AND value < 9")),
    "method_call": (_events("any where name:length() == 5 or name:endsWith('e_1')"), _where("length(name) = 5 OR ends_with(lower(name), 'e_1')")),
    "string_enum": (_events("any where event_type.view and value < 2"), _where("event_type = 'view' AND value < 2")),
    "extended_string_predicates": (_events('any where name : ("view_*", "*_7") and name like "v*" and name regex "view_[0-4]"', options=ES), _where("regexp_matches(name, '(?i)^view_[0-4]')")),
    "extended_in_tilde": (_events('any where name in~ ("VIEW_1", "click_1")', options=ES), _where("lower(name) IN ('view_1', 'click_1')")),
    "extended_optional_field": (_events('view where ?missing == null and value < 3', options=ES), _where("event_type = 'view' AND value < 3")),
    "scoped_variables": (_events("any where arraySearch(tags, $t, $t == 'u1')", options=Options(scoped=True)), _where("user_id % 3 = 1")),
    "definitions": (
        _events("any where BIG(value) and k == SEVEN", options=Options(definitions="const SEVEN = 7\nmacro BIG(x) x > 100")),
        _where("value > 100 AND k = 7"),
    ),
    "pipe_filter": (_events("view where true | filter value > 50 | filter k < 5"), _where("event_type = 'view' AND value > 50 AND k < 5")),
    "pipe_head": (_ranked("click where true | head 7", "event_id"), f"WITH e AS ({EVENTS_SQL}) SELECT row_number() OVER (ORDER BY ts, event_id) AS place, event_id FROM e WHERE event_type = 'click' ORDER BY 1 LIMIT 7"),
    "pipe_tail": (
        _ranked("click where true | tail 7", "event_id"),
        f"WITH e AS ({EVENTS_SQL}), t AS (SELECT ts, event_id FROM e WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 7) SELECT row_number() OVER (ORDER BY ts, event_id) AS place, event_id FROM t",
    ),
    "pipe_sort": (
        _ranked("any where true | sort name, value | head 40", "event_id"),
        f"WITH e AS ({EVENTS_SQL}), t AS (SELECT event_id, row_number() OVER (ORDER BY coalesce(lower(name), ''), value, ts, event_id) AS place FROM e) SELECT place, event_id FROM t WHERE place <= 40",
    ),
    "pipe_unique": (_events("any where true | unique name, k"), f"WITH e AS ({EVENTS_SQL}) SELECT min_by(event_id, (ts, event_id)) AS event_id FROM e GROUP BY lower(name), k"),
    "pipe_count": (_events("view where true | count", "key", "count", "array_join(hosts, ',') AS hosts", "total_hosts"), f"WITH e AS ({EVENTS_SQL}), t AS (SELECT count(*) AS count, {_HOSTS} FROM e WHERE event_type = 'view') SELECT 'totals' AS key, count, array_to_string(hosts, ',') AS hosts, total_hosts FROM t"),
    "pipe_count_keys": (
        _events("any where true | count name", "key", "count", "percent", "array_join(hosts, ',') AS hosts", "total_hosts"),
        f"WITH e AS ({EVENTS_SQL}), t AS (SELECT coalesce(min_by(name, (ts, event_id)), '') AS key, count(*) AS count, {_HOSTS} FROM e GROUP BY lower(name)) "
        "SELECT key, count, count / sum(count) OVER () AS percent, array_to_string(hosts, ',') AS hosts, total_hosts FROM t",
    ),
    "pipe_unique_count": (
        _events("any where true | unique_count k", "event_id", "k", "count", "percent", "array_join(hosts, ',') AS hosts", "total_hosts"),
        f"WITH e AS ({EVENTS_SQL}), t AS (SELECT min_by(event_id, (ts, event_id)) AS event_id, k, count(*) AS count, {_HOSTS} FROM e GROUP BY k) "
        "SELECT event_id, k, count, count / sum(count) OVER () AS percent, array_to_string(hosts, ',') AS hosts, total_hosts FROM t",
    ),
    "pipe_chain": (_events("any where true | unique user_id, event_type | count user_id | filter count >= 5", "key", "count"), "SELECT user_id AS key, count(DISTINCT event_type) AS count FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 5"),
    "sequence_keyed": (_groups("sequence by user_id [view where true] [purchase where true]", "first_id", "last_id"), _pair()),
    "sequence_fork": (_groups("sequence by user_id [view where true] [purchase where true] fork", "first_id", "last_id"), _pair(fork=True)),
    "sequence_until": (_groups("sequence by user_id [view where true] [purchase where true] until [error where true]", "first_id", "last_id"), _pair("AND (re IS NULL OR re <= rv)")),
    "sequence_stage_keys": (
        _groups("sequence [view where true] by user_id [purchase where true] by k", "first_id", "last_id"),
        f"""WITH e AS ({EVENTS_SQL}), p AS (SELECT user_id AS key, 1 AS s, ts, event_id FROM e WHERE event_type = 'view' UNION ALL SELECT k, 2, ts, event_id FROM e WHERE event_type = 'purchase'),
x AS (SELECT *, lag(s) OVER w AS ls, lag(event_id) OVER w AS li FROM p WINDOW w AS (PARTITION BY key ORDER BY ts, event_id))
SELECT li AS first_id, event_id AS last_id FROM x WHERE s = 2 AND ls = 1""",
    ),
    "sequence_unkeyed": (
        _groups("sequence [signup where value > 150] [error where value > 150]", "first_id", "last_id"),
        f"""WITH e AS ({EVENTS_SQL}), p AS (SELECT * FROM e WHERE value > 150 AND event_type IN ('signup', 'error')),
x AS (SELECT *, lag(event_type) OVER w AS lt, lag(event_id) OVER w AS li FROM p WINDOW w AS (ORDER BY ts, event_id))
SELECT li AS first_id, event_id AS last_id FROM x WHERE event_type = 'error' AND lt = 'signup'""",
    ),
    "sequence_runs": (_groups("sequence by user_id [view where value > 50] with runs=2", "first_id", "last_id", options=ES), f"""
WITH e AS ({EVENTS_SQL}), x AS (SELECT *, row_number() OVER w AS rn, lag(event_id) OVER w AS li FROM e WHERE event_type = 'view' AND value > 50 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT li AS first_id, event_id AS last_id FROM x WHERE li IS NOT NULL"""),
    "sequence_three": (_groups("sequence by user_id with maxspan=3d [view where true] [click where true] [purchase where true] until [error where true]", "a", "b", "c"), _THREE),
    "sequence_negative": (_groups("sequence by user_id with maxspan=2d [view where true] ![error where value > 20] [purchase where true]", "a", "b", options=ES), _NEGATIVE),
    "sequence_pipes": (_groups("sequence by user_id [view where true] [purchase where true] | filter events[1].value > events[0].value", "first_id", "last_id"), _pair("AND y.value > v.value")),
    "join_keyed": (_groups("join by user_id [view where true] [click where value > 20] [purchase where true] until [error where true]", "a", "b", "c"), _JOIN),
    "sample_keyed": (
        _groups("sample by user_id [view where true] [purchase where true]", "a", "b", options=ES),
        f"""WITH e AS ({EVENTS_SQL}), x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM e WHERE event_type IN ('view', 'purchase'))
SELECT min_by(event_id, rn) AS a, max_by(event_id, rn) AS b FROM x GROUP BY user_id, rn // 2 HAVING count(*) = 2""",
    ),
    "relation_event_of": (_processes("file where event of [process where value > 40]"), _EVENT_OF),
    "relation_child_of": (_processes("any where child of [process where value > 40]"), _CHILD_OF),
    "relation_descendant_of": (_processes("any where descendant of [process where value > 90]"), _DESCENDANT_OF),
    "relation_nested": (_processes("any where child of [process where event of [file where value > 60]]"), _NESTED),
    "relation_reset": (
        lambda spark, d: compile("any where child of [process where value > 40]").run(_restarts(processes(spark, d)), PROCESS).select("event_id"),
        _RESET,
    ),
    "relation_by_opcode": (
        lambda spark, d: compile("any where child of [process where value > 40]", Options(lifecycle="opcode")).run(
            processes(spark, d).withColumn("opcode", F.when(F.col("subtype") == "create", 3).when(F.col("subtype") == "terminate", 4)).drop("subtype"), PROCESS).select("event_id"),
        _CHILD_OF,
    ),
    "sequence_first_negative": (_groups("sequence by user_id with maxspan=400d ![error where value > 20] [purchase where true]", "a", options=ES), _FIRST_NEGATIVE),
    "sequence_one_stage": (_groups("sequence [view where true]", "a", options=ES), "SELECT event_id AS a FROM events WHERE false"),
    "sequence_alias": (_groups("sequence by user_id [view where true] as v [purchase where true] as p", "first_id", "last_id", options=Options(extended=True, scoped=True)), _pair()),
    "sequence_fold_keys": (
        lambda spark, d: compile("sequence by user [view where true] [purchase where true]").frame(
            events(spark, d).withColumn("user", F.concat(F.when(F.col("event_id") % 2 == 0, "U").otherwise("u"), F.col("user_id").cast("string"))), BINDING
        ).select(*[F.get("events", F.lit(i)).getField("event_id").alias(c) for i, c in enumerate(("first_id", "last_id"))]),
        _pair(),
    ),
    "sequence_key_number": (
        lambda spark, d: compile("sequence [view where true] by user_id [purchase where true] by user").frame(events(spark, d).withColumn("user", F.col("user_id").cast("int")), BINDING)
        .select(*[F.get("events", F.lit(i)).getField("event_id").alias(c) for i, c in enumerate(("first_id", "last_id"))]),
        _pair(),
    ),
    "sequence_seconds": (
        lambda spark, d: compile("sequence by user_id with maxspan=90s [view where true] [purchase where true]").frame(
            events(spark, d).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e9), EventBinding(type_col="event_type", time_col="at", time_unit="s", order_cols=("ts", "event_id"))
        ).select(*[F.get("events", F.lit(i)).getField("event_id").alias(c) for i, c in enumerate(("first_id", "last_id"))]),
        _pair("AND y.ts - v.ts <= INTERVAL 90000 SECOND"),
    ),
    "join_stage_keys": (
        _groups("join [view where true] by user_id [purchase where true] by k", "a", "b"),
        f"""WITH RECURSIVE e AS ({EVENTS_SQL}), p AS (SELECT user_id AS key, 1 AS s, ts, event_id FROM e WHERE event_type = 'view' UNION ALL SELECT k, 2, ts, event_id FROM e WHERE event_type = 'purchase'),
x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS rn FROM p),
r AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS rn, {_ID} AS a, {_ID} AS b FROM x UNION ALL
  SELECT x.key, x.rn, CASE WHEN r.a IS NOT NULL AND r.b IS NOT NULL THEN CASE WHEN x.s = 1 THEN x.event_id END WHEN x.s = 1 THEN coalesce(r.a, x.event_id) ELSE r.a END,
    CASE WHEN r.a IS NOT NULL AND r.b IS NOT NULL THEN CASE WHEN x.s = 2 THEN x.event_id END WHEN x.s = 2 THEN coalesce(r.b, x.event_id) ELSE r.b END FROM r JOIN x ON x.key = r.key AND x.rn = r.rn + 1)
SELECT a, b FROM r WHERE a IS NOT NULL AND b IS NOT NULL""",
    ),
    "group_head": (
        lambda spark, d: compile(_PURCHASES + " | head 9").frame(events(spark, d), BINDING).select(*[F.get("events", F.lit(i)).getField("event_id").alias(c) for i, c in enumerate(("first_id", "last_id"))]),
        _nth("SELECT first_id, last_id FROM m ORDER BY last_ts, last_id LIMIT 9"),
    ),
    "group_tail": (
        lambda spark, d: compile(_PURCHASES + " | tail 9").frame(events(spark, d), BINDING).select(*[F.get("events", F.lit(i)).getField("event_id").alias(c) for i, c in enumerate(("first_id", "last_id"))]),
        _nth("SELECT first_id, last_id FROM m ORDER BY last_ts DESC, last_id DESC LIMIT 9"),
    ),
    "group_sort": (
        lambda spark, d: compile(_PURCHASES + " | sort k, value | head 9").frame(events(spark, d), BINDING).select(*[F.get("events", F.lit(i)).getField("event_id").alias(c) for i, c in enumerate(("first_id", "last_id"))]),
        _nth("SELECT first_id, last_id FROM m ORDER BY k, value, last_ts, last_id LIMIT 9"),
    ),
    "group_unique": (_groups(_PURCHASES + " | unique user_id", "first_id", "last_id"), _nth("SELECT min_by(first_id, (last_ts, last_id)) AS first_id, min_by(last_id, (last_ts, last_id)) AS last_id FROM m GROUP BY user_id")),
    "group_count_keys": (
        lambda spark, d: compile(_PURCHASES + " | count k").run(events(spark, d), BINDING).select("key", "count", "percent"),
        _nth("SELECT k AS key, count(*) AS count, count(*) / sum(count(*)) OVER () AS percent FROM m GROUP BY k"),
    ),
    "group_count": (lambda spark, d: compile(_PURCHASES + " | count").run(events(spark, d), BINDING).select("key", "count"), _nth("SELECT 'totals' AS key, count(*) AS count FROM m")),
    "group_unique_count": (
        lambda spark, d: compile(_PURCHASES + " | unique_count k").run(events(spark, d), BINDING).select("event_id", "k", "count", "percent"),
        _nth("SELECT min_by(first_id, (last_ts, last_id)) AS event_id, k, count(*) AS count, count(*) / sum(count(*)) OVER () AS percent FROM m GROUP BY k"),
    ),
    "sample_stage_keys": (
        _groups("sample [view where true] by user_id [purchase where true] by k", "a", "b", options=ES),
        f"""WITH e AS ({EVENTS_SQL}), p AS (SELECT user_id AS key, ts, event_id FROM e WHERE event_type = 'view' UNION ALL SELECT k, ts, event_id FROM e WHERE event_type = 'purchase'),
x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) - 1 AS rn FROM p)
SELECT min_by(event_id, rn) AS a, max_by(event_id, rn) AS b FROM x GROUP BY key, rn // 2 HAVING count(*) = 2""",
    ),
    "escaped_field": (_events("any where `odd name` > 150", "event_id", source=lambda df: df.withColumnRenamed("value", "odd name")), _where("value > 150")),
    "precedence": (_events("any where k == 1 or k == 2 and value > 100 or not k < 99 and value - 2 * 3 > 100 % 7"), _where("k = 1 OR (k = 2 AND value > 100) OR (NOT k < 99 AND value - 6 > 2)")),
    "equals_sign": (_events("any where k = 5 and name = 'VIEW_1'"), _where("k = 5 AND lower(name) = 'view_1'")),
    "fn_modulo": (_events("any where modulo(k, 7) == 3"), _where("k % 7 = 3")),
    "fn_tilde": (_events('any where startsWith~(name, "VIEW_1")', options=ES), _where("starts_with(lower(name), 'view_1')")),
    "matched_one_by_one": (
        lambda spark, d: matches("purchase where value > 100", events(spark, d), binding=BINDING).select("event_id", "matched"),
        f"WITH e AS ({EVENTS_SQL}) SELECT event_id, event_type = 'purchase' AND coalesce(value > 100, false) AS matched FROM e",
    ),
    "null_strings": (_events('any where not (startsWith(name, "v") or length(name) > 6) or name : "zzz" or length(name) == 0', options=ES), _where("name IS NOT NULL AND NOT (starts_with(lower(name), 'v') OR length(name) > 6) OR length(name) = 0")),
    "null_length": (_events("any where length(name) == null"), _where("name IS NULL")),
    "null_string": (_events("any where string(name) == null and concat('a', k) != null"), _where("name IS NULL")),
    "null_substring": (_events("view where substring(name, 0, 1) == null or between(name, 'q', 'q') != null"), _where("event_type = 'view' AND name IS NULL")),
    "wrong_kind_strings": (_events("any where startsWith(k, 'x') or value > 195"), _where("value > 195")),
    "short_circuit": (_events("any where value > 150 or safe(1 % (k - k)) == 1"), _where("value > 150")),
    "null_in_set": (_events("any where not (name in ('view_1', 'x'))"), _where("name IS NOT NULL AND lower(name) <> 'view_1'")),
    "null_arithmetic": (_events("any where (k + null) == null and value > 190"), _where("value > 190")),
    "multi_rule": (
        lambda spark, d: Engine([compile("view where value > 100", name="a"), compile("any where k == 3", name="b")], BINDING).run(events(spark, d)).select("rule_id", "event_id"),
        f"WITH e AS ({EVENTS_SQL}) SELECT 'a' AS rule_id, event_id FROM e WHERE event_type = 'view' AND value > 100 UNION ALL SELECT 'b', event_id FROM e WHERE k = 3",
    ),
}
