"""SQL for the queries of the catalogue, as DuckDB runs it on the same tables."""

from __future__ import annotations

from .functions.paths import EXCLUDED_DIRS, EXCLUDED_NAMES, TEMPORARY
from .functions.text import STOP_WORDS

_T, _SINCE, _START, _DAY = 1_705_276_800_000_000_000, 1_704_844_800_000_000_000, 1_704_067_200_000_000_000, 86_400_000_000_000

_VLOG = """vlog AS (SELECT 'r' || (user_id % 4) AS repo, 'u' || user_id AS path, epoch_us(ts) * 1000 AS ts_ns, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 3 ELSE 2 END AS event_type,
  CASE WHEN event_type = 'error' THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS delta_size,
  CASE WHEN event_type = 'error' THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS file_size FROM events)"""
_LABEL = "CASE event_type WHEN 1 THEN 'CREATE' WHEN 2 THEN 'MODIFY' WHEN 3 THEN 'DELETE' END"
_FILES = "vfiles AS (SELECT concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, doc_id, coalesce(text, '') AS content FROM documents)"
_CHAIN = "vchain AS (SELECT 'c' || conv_id AS path, turn AS rev, coalesce(text, '') AS content FROM conversations)"
_ORDERS = "vorders AS (SELECT CAST(o_custkey AS VARCHAR) AS path, epoch_us(o_orderdate) * 1000 AS ts_ns, o_orderkey AS seq, CAST(round(o_totalprice * 100) AS BIGINT) AS file_size FROM orders)"
_PATHS = "vpaths AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"
_W = "WINDOW w AS (PARTITION BY repo, path ORDER BY ts_ns, seq)"
_BASE = f"base AS (SELECT DISTINCT repo, path FROM vlog WHERE ts_ns <= {_START + _DAY})"
_LAST = "SELECT repo, path, ts_ns, seq, event_type, file_size FROM vlog {where} QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY ts_ns DESC, seq DESC) = 1"
_BLOCKS = f"""{_FILES}, b AS (SELECT path, doc_id, CAST(p AS INTEGER) AS pos, substr(content, CAST(p AS BIGINT) * 512 + 1, 512) AS data
  FROM vfiles, unnest(range((length(content) + 511) // 512)) AS u(p)),
blocks AS (SELECT path, doc_id, pos, data, CAST(length(data) AS INTEGER) AS size, sha256(data) AS hash FROM b)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _extlog(where: str = "") -> str:
    return _with(_VLOG) + f"""SELECT repo, path, ts_ns, seq, {_LABEL} AS event, row_number() OVER w AS rev, delta_size, file_size,
  CASE WHEN event_type <> 3 THEN file_size - lag(file_size) OVER w END AS size_change, ts_ns - lag(ts_ns) OVER w AS elapsed_ns,
  CASE WHEN file_size > 0 THEN delta_size * 10000 // file_size ELSE 0 END AS ratio_bp FROM vlog {where} {_W}"""


def _log(where: str = "") -> str:
    return _with(_VLOG) + f"SELECT repo, path, ts_ns, seq, {_LABEL} AS event, delta_size, file_size FROM vlog {where} ORDER BY ts_ns, seq"


_ISLANDS = f"""isl AS (SELECT *, CAST(coalesce(sum(CASE WHEN event_type = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS island,
  count(*) OVER (PARTITION BY repo, path) AS total FROM vlog),
runs AS (SELECT repo, path, island, count(*) AS n, arg_min(event_type, (ts_ns, seq)) AS kind, arg_min(seq, (ts_ns, seq)) AS first_seq, arg_max(seq, (ts_ns, seq)) AS last_seq
  FROM isl WHERE total > 3 AND event_type <> 3 GROUP BY ALL HAVING count(*) > 3 AND arg_min(event_type, (ts_ns, seq)) = 1)"""
_LINES = "CASE WHEN length({x}) = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split(CASE WHEN {x} LIKE '%' || chr(10) THEN left({x}, length({x}) - 1) ELSE {x} END, chr(10)) END"


def _count(x: str) -> str:
    return f"(CASE WHEN length({x}) = 0 THEN 0 ELSE length({x}) - length(replace({x}, chr(10), '')) + CASE WHEN {x} LIKE '%' || chr(10) THEN 0 ELSE 1 END END)"


def _ranges(new: str) -> str:
    """(path, rev, old, new, first_line, last_line)"""
    match = "coalesce(nullif(list_position(list_transform(list_zip({a}, {b}), lambda p: p[1] IS NOT DISTINCT FROM p[2]), false), 0) - 1, greatest(len({a}), len({b})))"
    return f"""{_CHAIN}, pairs AS (SELECT path, rev, content, coalesce(lag(content) OVER (PARTITION BY path ORDER BY rev), '') AS old FROM vchain),
p2 AS (SELECT path, rev, old, {new} AS new FROM pairs),
ln AS (SELECT *, {_LINES.format(x="old")} AS a, {_LINES.format(x="new")} AS b FROM p2),
hd AS (SELECT *, {match.format(a="a", b="b")} AS head, {match.format(a="list_reverse(a)", b="list_reverse(b)")} AS back FROM ln),
tl AS (SELECT *, least(back, least(len(a), len(b)) - head) AS tail, head = len(a) AND head = len(b) AS same FROM hd),
r AS (SELECT *, CASE WHEN same THEN 1 ELSE head + 1 END AS first_line, CASE WHEN same THEN 1 ELSE greatest(len(b) - tail, head + 1) END AS last_line FROM tl)"""


_SKIP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_GLOBS = " OR ".join(f"regexp_matches(base, '{pattern}')" for g in EXCLUDED_NAMES for pattern in ["^" + "".join({"*": ".*", ".": "\\.", "#": "#", "~": "~"}.get(c, c) for c in g) + "$"])
_DIRS = "|".join(d.replace(".", "\\.") for d in EXCLUDED_DIRS)
_EXCLUDED = f"""(regexp_matches(path, '(^|/)({_DIRS})(/|$)') OR contains(path, '{TEMPORARY}')
  OR ((NOT starts_with(base, '.') OR regexp_matches(base, '^(\\.DS_Store|\\.goutputstream-.*|\\.~lock\\..*|\\.#.*|\\.nfs.*)$')) AND ({_GLOBS})))"""
_ROOTS = "roots(root, id) AS (VALUES ('src0', 1), ('src0/en', 2), ('src1', 3), ('src1/de', 4))"


def _hex(x: str, width: int) -> str:
    """The digits of a number's little-endian bytes."""
    return " || ".join(f"lpad(lower(hex(({x} >> {8 * i}) & 255)), 2, '0')" for i in range(width))


def _time(units: dict[str, int]) -> str:
    return "CASE (event_id % 6) " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(units.values()) if s) + " END"


def _changed(of: str) -> list[str]:
    """(path, rev, lines): whole lines of the range that changed, as many as fit 8,192 bytes; one that doesn't is left out."""
    return [
        f"own AS (SELECT path, rev, list_slice(b, first_line, last_line) AS own FROM {of})",
        """changed AS (SELECT path, rev, array_to_string(list_reduce(list_prepend({'size': 0::BIGINT, 'kept': CAST([] AS VARCHAR[])}, list_transform(own, lambda x: {'size': CAST(strlen(x) + 1 AS BIGINT), 'kept': [x]})),
  lambda acc, x: {'size': acc.size + x.size, 'kept': CASE WHEN acc.size + x.size <= 8192 THEN list_concat(acc.kept, x.kept) ELSE acc.kept END}).kept, chr(10)) AS lines FROM own)""",
    ]


def _binary(x: str) -> str:
    """Whether a text's first bytes are those of binary content."""
    digits = f"regexp_extract_all(left(hex(encode({x})), 16384), '..')"
    return f"(list_contains({digits}, '00') OR len(list_filter({digits}, lambda y: y < '20' AND y NOT IN ('00', '09', '0A', '0D'))) > len({digits}) // 10 OR len(list_filter({digits}, lambda y: y > '7E')) > len({digits}) // 3)"


def _tagged(of: str) -> list[str]:
    """(path, rev, tags) of the changes ``of`` (path, rev, old, new, first_line, last_line)."""
    return [
        *_changed(of),
        f"said AS (SELECT {of}.path, {of}.rev, CASE WHEN {_binary('old')} OR {_binary('new')} THEN '' WHEN length(new) > 0 THEN lines ELSE left(old, 8192) END AS content FROM {of} JOIN changed USING (path, rev))",
        "tk AS (SELECT path, rev, lower(w) AS w, i FROM (SELECT path, rev, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT path, rev, regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*') AS l FROM said)))",
        f"""k AS (SELECT * FROM tk WHERE length(w) BETWEEN 3 AND 40 AND w NOT IN ({_SKIP}) AND NOT (length(w) > 6 AND NOT regexp_matches(w, '[aeiou]'))
  AND NOT (length(w) > 4 AND length(regexp_replace(w, '[^0-9]', '', 'g')) * 5 > length(w) * 2))""",
        "c AS (SELECT path, rev, w, count(*) AS n, min(i) AS first_at FROM k GROUP BY ALL)",
        "d AS (SELECT *, row_number() OVER (PARTITION BY path, rev ORDER BY first_at) AS seen FROM c)",
        "t AS (SELECT *, row_number() OVER (PARTITION BY path, rev ORDER BY n DESC, w) AS rn FROM d WHERE seen <= 256)",
        "tagged AS (SELECT v.path, v.rev, coalesce(string_agg('#' || w, ' ' ORDER BY rn), '') AS tags FROM said v LEFT JOIN t ON v.path = t.path AND v.rev = t.rev AND rn <= 4 GROUP BY v.path, v.rev)",
    ]


_SNAP = f"{_CHAIN}, snap AS (SELECT path, rev, rev * 1000 + 1000 AS ts_ns, content, lag(content) OVER (PARTITION BY path ORDER BY rev) AS was, row_number() OVER (PARTITION BY path ORDER BY rev) AS k FROM vchain)"
#: A record for each revision that changes something: a MODIFY, or a CREATE where either side is empty or the delta would be (it never is).
_RECORDS = f"{_SNAP}, records AS (SELECT * EXCLUDE (k), CASE WHEN k = 1 OR was = '' OR content = '' THEN 1 ELSE 2 END AS kind FROM snap WHERE k = 1 OR content IS DISTINCT FROM was)"

_FSM = "SELECT path, ts_ns, kind AS event_type, CAST(strlen(content) AS BIGINT) AS file_size, CASE WHEN was IS NULL THEN 'new' WHEN was = '' OR content = '' THEN 'rewritten' ELSE 'changed' END AS reason FROM records"
_WRITTEN = "SELECT path, rev * 1000 + 1000 AS ts_ns, 1 AS event_type, CAST(strlen(path) AS INTEGER) AS path_len, CAST(strlen(content) AS BIGINT) AS delta_size, CAST(strlen(content) AS BIGINT) AS file_size, sha256(content) AS sha256 FROM vchain"


ORACLE = {
    "extlog": _extlog(),
    "extlog_since": _extlog(f"WHERE ts_ns >= {_SINCE}"),
    "extlog_footer": _with(_VLOG) + "SELECT count(*) AS n_records, count(DISTINCT (repo, path)) AS n_paths FROM vlog",
    "log_sorted": _log(),
    "log_path": _log("WHERE path = 'u7'"),
    "scope_prefix": _with(_FILES) + "SELECT path, CAST(strlen(content) AS BIGINT) AS size, substr(path, 6) AS rel FROM vfiles WHERE path = 'src0/en' OR starts_with(path, 'src0/en/')",
    "as_of_state": _with(_VLOG) + f"SELECT repo, path, ts_ns, seq, file_size FROM ({_LAST.format(where=f'WHERE ts_ns <= {_T}')}) WHERE event_type <> 3",
    "as_of_tags": _with(_VLOG, f"points AS (SELECT 'd' || lpad(CAST(i AS VARCHAR), 2, '0') AS name, {_START} + (i - 1) * {_DAY} AS at FROM range(1, 31) t(i))", "p AS (SELECT DISTINCT repo, path FROM vlog)")
    + "SELECT name, v.repo, v.path, v.seq, v.file_size FROM (SELECT * FROM points, p) q ASOF JOIN vlog v ON q.repo = v.repo AND q.path = v.path AND q.at >= v.ts_ns WHERE v.event_type <> 3",
    "undo_last_dir": _with(_VLOG) + "SELECT repo, path, seq, file_size FROM vlog QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY ts_ns DESC, seq DESC) = 2",
    "undo_skipped": _with(_VLOG, f"g AS (SELECT repo, path, count(*) AS c FROM vlog WHERE ts_ns BETWEEN {_T} AND {_T + _DAY} GROUP BY ALL)") + "SELECT count(*) AS n_paths, CAST(sum(CASE WHEN c < 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_skipped, CAST(sum(CASE WHEN c >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_restored FROM g",
    "undo_initial": _with(_VLOG, _BASE) + "SELECT repo, path, seq, file_size FROM vlog SEMI JOIN base USING (repo, path) QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY ts_ns, seq) = 1",
    "prune_list": _with(_VLOG, _BASE) + f"SELECT repo, path FROM ({_LAST.format(where='')}) l ANTI JOIN base USING (repo, path) WHERE event_type <> 3 AND path NOT LIKE '%7' AND path <> 'u12'",
    "last_two": _with(_VLOG, "r AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY ts_ns DESC, seq DESC) AS rn FROM vlog)") + "SELECT repo, path, max(ts_ns) FILTER (rn = 1) AS last_ns, max(ts_ns) FILTER (rn = 2) AS prev_ns FROM r GROUP BY ALL",
    "nth_revision": _with(_VLOG, "r AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY ts_ns, seq) AS rn, count(*) OVER (PARTITION BY repo, path) AS c FROM vlog)", "n(n) AS (VALUES (1::BIGINT), (5), (-1), (-3), (0), (1000000), (-1000000))")
    + "SELECT n, repo, path, seq FROM r, n WHERE (n > 0 AND rn = least(n, c)) OR (n < 0 AND rn = c + 1 + n)",
    "scd2": _with(_VLOG) + f"SELECT repo, path, seq, ts_ns // 1000 AS valid_from_us, lead(ts_ns) OVER w // 1000 AS valid_to_us FROM vlog {_W}",
    "noop_suppressed": _with(_VLOG) + f"SELECT repo, path, seq FROM vlog {_W} QUALIFY lag(event_type) OVER w IS DISTINCT FROM event_type",
    "replay_sum": _with(_VLOG, f"i AS (SELECT *, sum(CASE WHEN event_type IN (1, 3) THEN 1 ELSE 0 END) OVER w AS g FROM vlog {_W})") + "SELECT repo, path, seq, CAST(sum(delta_size) OVER (PARTITION BY repo, path, g ORDER BY ts_ns, seq) AS BIGINT) AS state FROM i",
    "anchor_pruned": _with(_VLOG, f"v AS (SELECT * FROM vlog WHERE ts_ns <= {_T})", f"i AS (SELECT *, sum(CASE WHEN event_type IN (1, 3) THEN 1 ELSE 0 END) OVER w AS g FROM v {_W})")
    + "SELECT repo, path, CAST(sum(delta_size) AS BIGINT) AS state, count(*) AS n_folded FROM i SEMI JOIN (SELECT repo, path, max(g) AS g FROM i GROUP BY ALL) USING (repo, path, g) GROUP BY repo, path",
    "compact_plan": _with(_VLOG, _ISLANDS) + "SELECT repo, path, island, n, first_seq, last_seq FROM runs",
    "compacted_log": _with(_VLOG, _ISLANDS, "j AS (SELECT isl.*, r.first_seq FROM isl LEFT JOIN runs r USING (repo, path, island))")
    + """SELECT repo, path, ts_ns, seq, event_type, delta_size, file_size FROM j WHERE first_seq IS NULL OR event_type = 3 OR seq = first_seq
UNION ALL SELECT repo, path, max(ts_ns), arg_max(seq, (ts_ns, seq)), CASE WHEN sum(delta_size) < arg_max(file_size, (ts_ns, seq)) THEN 2 ELSE 1 END,
  CAST(least(sum(delta_size), arg_max(file_size, (ts_ns, seq))) AS BIGINT), arg_max(file_size, (ts_ns, seq))
FROM j WHERE first_seq IS NOT NULL AND event_type <> 3 AND seq <> first_seq GROUP BY repo, path, island""",
    "debounce_sessions": """WITH e AS (SELECT user_id AS path, epoch_us(ts) AS us FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY path ORDER BY us) > 21600000000 THEN 1 ELSE 0 END AS cut FROM e),
s AS (SELECT *, sum(cut) OVER (PARTITION BY path ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT path, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY path, k""",
    "debounce_close": """WITH e AS (SELECT user_id AS path, epoch_us(ts) AS us, event_id AS seq, event_type FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 21600000000 OR lag(event_type) OVER w = 'purchase' THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY path ORDER BY us, seq)),
s AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY path ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)
SELECT path, session, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY path, session""",
    "stats": _with(_VLOG) + "SELECT count(*) AS n_records, CAST(sum(25 + strlen(path) + delta_size) AS BIGINT) AS stored_bytes, min(ts_ns) FILTER (ts_ns > 0) AS first_ns, max(ts_ns) AS last_ns FROM vlog",
    "stats_rollup": _with(_VLOG) + "SELECT repo, count(*) AS deltas, CAST(sum(delta_size) AS BIGINT) AS bytes, count(DISTINCT path) AS files FROM vlog GROUP BY ROLLUP (repo)",
    "status_totals": _with(_VLOG) + "SELECT repo, count(*) FILTER (event_type = 1) AS creates, count(*) FILTER (event_type = 2) AS modifies, count(*) FILTER (event_type = 3) AS deletes, CAST(sum(delta_size) AS BIGINT) AS bytes FROM vlog GROUP BY repo",
    "block_split": _with(_BLOCKS) + "SELECT path, pos, size, hash FROM blocks",
    "block_dedup": _with(_BLOCKS) + "SELECT count(*) AS n_blocks, count(DISTINCT hash) AS n_distinct FROM blocks",
    "block_new": _with(_BLOCKS) + "SELECT DISTINCT hash, size FROM blocks WHERE doc_id % 2 = 1 AND hash NOT IN (SELECT hash FROM blocks WHERE doc_id % 2 = 0)",
    "block_gc": _with(_BLOCKS) + "SELECT DISTINCT hash, size FROM blocks WHERE hash NOT IN (SELECT hash FROM blocks WHERE NOT starts_with(path, 'src0/'))",
    "block_reassemble": _with(_FILES) + "SELECT path, sha256(content) AS sha256, false AS missing FROM vfiles WHERE length(content) > 0",
    "verify_report": _with(
        _VLOG,
        f"b AS (SELECT *, (event_type = 2 AND delta_size > file_size) OR (event_type = 2 AND coalesce(lag(event_type) OVER w, 3) = 3) AS bad FROM vlog {_W})",
        "c AS (SELECT *, bad AND row_number() OVER (PARTITION BY repo, path, bad ORDER BY ts_ns, seq) = 1 AS corrupt FROM b)",
    )
    + "SELECT count(*) AS n_records, count(DISTINCT (repo, path)) AS n_paths, count(*) FILTER (corrupt) AS n_corrupt, count(DISTINCT (repo, path)) FILTER (corrupt) AS n_corrupt_paths FROM c",
    "exclude_builtin": _with(_PATHS, "p AS (SELECT page_id, path || ['/x.o', '/.git/a', '/.o', '/a.bak', '/b~', '/c', '/#d#', '/node_modules', '/a.tt_tmp_1', '/d/.tt_tmp_x/e'][page_id % 10 + 1] AS path FROM vpaths)", "q AS (SELECT *, string_split(path, '/')[-1] AS base FROM p)") + f"SELECT page_id, path FROM q WHERE NOT {_EXCLUDED}",
    "exclude_user": _with(_FILES, "q AS (SELECT path, string_split(path, '/')[-1] AS base FROM vfiles)")
    + f"SELECT path FROM q WHERE NOT {_EXCLUDED} AND NOT contains('/' || path || '/', '/de/') AND NOT contains('/' || path || '/', '/src2/fr/') AND NOT regexp_matches(path, '^src1/.*/1.*$') AND NOT (path LIKE '%7')",
    "repo_fanout": _with(_FILES, _ROOTS) + "SELECT root, id, path FROM vfiles JOIN roots ON path = root OR starts_with(path, root || '/')".replace("root, id, path", "root, path"),
    "repo_nearest": _with(_FILES, _ROOTS) + "SELECT path, arg_max(root, length(root)) AS root FROM vfiles JOIN roots ON path = root OR starts_with(path, root || '/') GROUP BY path",
    "repo_overlap": _with(_PATHS, "u AS (SELECT path FROM vpaths UNION ALL SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) FROM vpaths WHERE page_id % 3 = 0 UNION ALL SELECT string_split(path, '/')[1] FROM vpaths WHERE page_id % 7 = 0)", "r AS (SELECT DISTINCT path FROM u WHERE path <> '')") + "SELECT a.path AS outer, b.path AS inner FROM r a JOIN r b ON starts_with(b.path, a.path || '/')",
    "tag_latest": "SELECT 't' || (user_id % 50) AS name, arg_max(epoch_us(ts) * 1000, event_id) AS ts_ns FROM events GROUP BY ALL",
    "annotation_join": _with(_VLOG, "n AS (SELECT ts_ns, path, arg_min(seq, seq) AS seq FROM vlog WHERE seq % 3 = 0 GROUP BY ts_ns, path)") + "SELECT v.ts_ns, v.path, v.seq AS record, 'n' || n.seq AS summary FROM vlog v LEFT JOIN n ON v.ts_ns = n.ts_ns AND v.path = n.path",
    "event_kind_map": """WITH k AS (SELECT CASE event_type WHEN 'view' THEN 'modify' WHEN 'click' THEN 'moved_to' WHEN 'purchase' THEN 'moved_from' WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'attrib' END AS kind FROM events)
SELECT kind, CASE WHEN kind IN ('delete', 'moved_from') THEN 'DELETE' ELSE 'MODIFY' END AS event, count(*) AS n FROM k GROUP BY ALL""",
    "event_labels": """WITH c AS (SELECT event_id AS seq, event_id % 7 AS k FROM events)
SELECT seq, ['CREATE', 'MODIFY', 'DELETE', '???', 'CREATE_D', '???', '???'][CASE WHEN k = 0 THEN 7 ELSE k END] AS log, ['CREATE', 'MODIFY', 'DELETE', '???', '???', '???', '???'][CASE WHEN k = 0 THEN 7 ELSE k END] AS log_since,
  ['CREATE', 'MODIFY', 'DELETE', '???', 'CREATE_D', '???', '???'][CASE WHEN k = 0 THEN 7 ELSE k END] AS extlog FROM c""",
    "line_counts": _with(_FILES) + f"SELECT path, CAST({_count('content')} AS BIGINT) AS n_lines FROM vfiles",
    "changed_range": _with(_ranges("content")) + "SELECT path, rev, CAST(first_line AS BIGINT) AS first_line, CAST(last_line AS BIGINT) AS last_line FROM r",
    "summary": _with(_ranges("old || chr(10) || content"), *_tagged("r"), f"s AS (SELECT *, {_count('new')} - {_count('old')} AS net FROM r)")
    + """SELECT path, rev, '+' || greatest(net, 0) || '/-' || greatest(-net, 0) || ' lines ' || first_line || CASE WHEN first_line = last_line THEN '' ELSE '-' || last_line END || ' delta=' || (strlen(new) - strlen(old)) || ' file=' || strlen(new) || CASE WHEN tags <> '' THEN ' ' || tags ELSE '' END AS summary,
  'CREATE (' || strlen(new) || ' B)' || CASE WHEN tags <> '' THEN ' ' || tags ELSE '' END AS created FROM s JOIN tagged USING (path, rev)""",
    "autotags": _with(_ranges("content"), *_tagged("r")) + "SELECT path, rev, tags FROM tagged",
    "changed_lines": _with(_ranges("content"), *_changed("r")) + "SELECT path, rev, lines FROM changed",
    "is_binary": _with(_FILES, "h AS (SELECT path, regexp_extract_all(left(hex(encode(content)), 16384), '..') AS h FROM vfiles)")
    + "SELECT path, list_contains(h, '00') OR len(list_filter(h, lambda x: x < '20' AND x NOT IN ('00', '09', '0A', '0D'))) > len(h) // 10 OR len(list_filter(h, lambda x: x > '7E')) > len(h) // 3 AS is_binary FROM h",
    "fmt_bytes": _with(_ORDERS) + "SELECT seq, CASE WHEN file_size >= 1073741824 THEN printf('%.2f GiB', file_size / 1073741824) WHEN file_size >= 1048576 THEN printf('%.1f MiB', file_size / 1048576) WHEN file_size >= 1024 THEN printf('%.1f KiB', file_size / 1024) ELSE printf('%d B', file_size) END AS size FROM vorders",
    "fmt_duration": _with(_VLOG, f"s AS (SELECT seq, ts_ns, (ts_ns - {_START}) // 1000000000 AS s FROM vlog)")
    + """SELECT seq, CASE WHEN s >= 86400 THEN printf('%dd %dh %dm %ds', s // 86400, s % 86400 // 3600, s % 3600 // 60, s % 60) WHEN s >= 3600 THEN printf('%dh %dm %ds', s // 3600, s % 3600 // 60, s % 60)
  WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%ds', s) END AS age, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M:%S') AS at FROM s""",
    "sanitize": _with(_PATHS) + "SELECT page_id, CASE WHEN path = '' THEN 'root' ELSE regexp_replace(path, '[^A-Za-z0-9.\\- ]', ' ', 'g') END AS name FROM vpaths",
    "basename": _with(_PATHS) + "SELECT page_id, string_split(path, '/')[-1] AS base, CASE WHEN contains(path, '/') THEN left(path, length(path) - length(string_split(path, '/')[-1]) - 1) ELSE '' END AS dir, rtrim(ltrim(path, '/'), '/') AS prefix FROM vpaths",
    "time_expr": f"SELECT event_id, greatest(0, 1000000000000000 - (event_id % 500) * {_time({'min': 60, 'hours': 3600, 'days': 86400, 'weeks': 604800, 'months': 0, 'sec': 1})} * 1000000000) AS ts_ns FROM events WHERE event_id % 6 <> 4 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 6 = 4",
    "rel_path": _with(_FILES) + "SELECT path, CASE WHEN starts_with(path, 'src0/en/') THEN substr(path, 9) ELSE path END AS rel FROM vfiles",
    "manifest": _with(_VLOG, f"n AS (SELECT *, sum(CASE WHEN event_type <> 3 THEN 1 ELSE 0 END) OVER w AS v FROM vlog {_W})")
    + f"SELECT path, ts_ns, seq, {_LABEL} AS event, file_size AS size, CASE WHEN event_type = 3 THEN '' ELSE 'v' || lpad(CAST(v AS VARCHAR), 6, '0') || '_' || ts_ns END AS version_file FROM n",
    "line_diff": _with(_CHAIN, "pairs AS (SELECT path, rev, content AS new, coalesce(lag(content) OVER (PARTITION BY path ORDER BY rev), '') AS old FROM vchain)", *(f"{n} AS (SELECT path, rev, unnest({_LINES.format(x=x)}) AS line FROM pairs)" for n, x in (("a", "old"), ("b", "new"))))
    + "SELECT path, rev, line, '-' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT path, rev, line, '+' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
    "header_codec": _with(_VLOG) + f"SELECT seq, {_hex('ts_ns', 8)} || {_hex('event_type', 1)} || {_hex('strlen(path)', 4)} || {_hex('delta_size', 4)} || {_hex('file_size', 8)} AS header, ts_ns FROM vlog",
    "log_distinct_paths": _with(_VLOG) + "SELECT DISTINCT repo, path FROM vlog",
    "orders_revisions": _with(_ORDERS) + "SELECT path, seq, row_number() OVER w AS rev, file_size - lag(file_size) OVER w AS size_change, ts_ns - lag(ts_ns) OVER w AS elapsed_ns FROM vorders WINDOW w AS (PARTITION BY path ORDER BY ts_ns, seq)",
    "monotonic_ts": _with(_ORDERS, "n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq) AS k FROM vorders)") + "SELECT path, seq, max(ts_ns - k) OVER (PARTITION BY path ORDER BY seq) + k AS ts_ns FROM n",
    "rescan_diff": _with(_VLOG, *(f"{n} AS (SELECT path, seq FROM ({_LAST.format(where=f'WHERE ts_ns <= {t}')}) WHERE event_type <> 3)" for n, t in (("a", _SINCE), ("b", _T))))
    + "SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.seq IS NULL THEN 3 ELSE 2 END AS event_type FROM a FULL JOIN b ON a.path = b.path WHERE a.seq IS DISTINCT FROM b.seq",
    "history_flag": _with(_VLOG) + "SELECT path, path IN (SELECT path FROM vlog) AS has_history FROM (SELECT path FROM vlog UNION SELECT 'u' || c_custkey FROM customer)",
    "common_dir": "SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN source || '/' || min(lang) ELSE source END AS dir FROM documents GROUP BY source",
    "replay_bytes": _with(_RECORDS) + "SELECT path, ts_ns, sha256(content) AS sha256, CAST(NULL AS VARCHAR) AS fault FROM records",
    "content_as_of": _with(_CHAIN) + "SELECT path, sha256(content) AS sha256, CAST(NULL AS VARCHAR) AS fault FROM vchain WHERE rev * 1000 + 1000 <= 3500 QUALIFY row_number() OVER (PARTITION BY path ORDER BY rev DESC) = 1",
    "restore_counts": _with(_RECORDS, "l AS (SELECT * FROM records WHERE CASE WHEN path LIKE '%3' THEN ts_ns > 1000 WHEN path LIKE '%7' THEN ts_ns > 3000 ELSE true END)", "p AS (SELECT path, count(*) FILTER (ts_ns <= 2500) AS n, bool_or(kind = 1 AND ts_ns <= 2500) AS based FROM l GROUP BY path)")
    + "SELECT count(*) FILTER (n > 0 AND based) AS restored, count(*) FILTER (n > 0 AND NOT based) AS errors, count(*) FILTER (n = 0) AS skipped FROM p",
    "version_against_current": _with(
        _CHAIN,
        "o AS (SELECT path, content AS old FROM vchain WHERE rev * 1000 + 1000 <= 2500 QUALIFY row_number() OVER (PARTITION BY path ORDER BY rev DESC) = 1)",
        "n AS (SELECT path, content AS new FROM vchain QUALIFY row_number() OVER (PARTITION BY path ORDER BY rev DESC) = 1)",
        "pairs AS (SELECT path, coalesce(old, '') AS old, coalesce(new, '') AS new FROM o FULL JOIN n USING (path))",
        *(f"{n} AS (SELECT path, unnest({_LINES.format(x=x)}) AS line FROM pairs)" for n, x in (("a", "old"), ("b", "new"))),
    )
    + "SELECT path, line, '-' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT path, line, '+' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
    "compacted_bytes": _with(_RECORDS, "c AS (SELECT *, count(*) OVER (PARTITION BY path) AS n, row_number() OVER (PARTITION BY path ORDER BY ts_ns) AS k FROM records)")
    + "SELECT path, ts_ns, sha256(content) AS sha256, CAST(NULL AS VARCHAR) AS fault FROM c WHERE n <= 3 OR k IN (1, n)",
    "dedup_replay": _with(_RECORDS) + "SELECT path, ts_ns, CASE WHEN kind = 1 AND strlen(content) >= 256 THEN 5 ELSE kind END AS event_type, sha256(content) AS sha256, CAST(NULL AS VARCHAR) AS fault FROM records",
    "block_references": _with(_RECORDS, "h AS (SELECT path, ts_ns, hex(encode(content)) AS h FROM records WHERE kind = 1 AND strlen(content) >= 256)", "b AS (SELECT path, ts_ns, CAST(p AS INTEGER) AS pos, sha256(unhex(substr(h, p * 128 + 1, 128))) AS hash FROM h, unnest(range((length(h) + 127) // 128)) AS u(p))")
    + "SELECT path, ts_ns, pos, hash, CASE WHEN starts_with(hash, 'a') THEN 'missing' END AS fault FROM b",
    "resolve_targets": _with(_VLOG, "r AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY ts_ns, seq) AS rn, count(*) OVER (PARTITION BY repo, path) AS c FROM vlog)", "n(expr, n) AS (VALUES ('now', -1), ('first', 1), ('prev', -2), ('3', 3), ('-2', -2))", f"t(expr) AS (VALUES ('tag:mid'), ('@{_T // 1_000_000_000}'), ('@{_T}'), ('2024-01-15 00:00:00'), ('10 days ago'))", f"l AS ({_LAST.format(where=f'WHERE ts_ns <= {_T}')})")
    + "SELECT expr, repo, path, seq FROM r, n WHERE (n > 0 AND rn = least(n, c)) OR (n < 0 AND rn = c + 1 + n) UNION ALL SELECT expr, repo, path, seq FROM l, t",
    "suppressed": _with(_VLOG, "m AS (SELECT repo, path, seq, ts_ns, event_type, file_size % 3 AS size FROM vlog)")
    + "SELECT repo, path, seq FROM m WINDOW w AS (PARTITION BY repo, path ORDER BY ts_ns, seq) QUALIFY row_number() OVER w = 1 OR lag(event_type) OVER w <> event_type OR lag(size) OVER w <> size",
    "ratio_percent": _with(_VLOG) + "SELECT seq, round(CASE WHEN file_size > 0 THEN 100.0::DOUBLE * delta_size / file_size ELSE 0 END, 6) AS percent FROM vlog",
    "integers": "SELECT event_id, event_id % 8 IN (0, 1, 2, 4) AS is_integer, event_id % 8 IN (5, 7) AS is_glob FROM events",
    "little_endian": _with(_VLOG) + "SELECT seq, ts_ns FROM vlog",
    "bridged_pairs": _with(_VLOG) + f"SELECT repo, path, seq, lag(seq) OVER w AS previous_seq, lag(file_size) OVER w AS previous_size FROM vlog WHERE event_type <> 3 {_W}",
    "single_file_repos": _with(_FILES, "roots(root, file) AS (VALUES ('src0', NULL), ('src0/en', '100'), ('src1', 'en/1'), ('src2', 'en/22'), ('src3', 'en'))")
    + "SELECT root, path, substr(path, length(root) + 2) AS rel FROM vfiles JOIN roots ON starts_with(path, root || '/') WHERE file IS NULL OR substr(path, length(root) + 2) = file",
    "watched": "SELECT event_id, 'd' || c_nationkey || '/f' || (event_id % 10) AS path FROM events JOIN customer ON user_id = c_custkey",
    "annotated_extlog": _with(_VLOG, "n AS (SELECT ts_ns, path, min(seq) AS seq FROM vlog WHERE seq % 3 = 0 GROUP BY ts_ns, path)")
    + f"SELECT v.repo, v.path, v.seq, row_number() OVER w AS rev, CASE WHEN n.seq % 2 = 1 THEN 'note ' || n.seq END AS summary FROM vlog v LEFT JOIN n ON v.ts_ns = n.ts_ns AND v.path = n.path WINDOW w AS (PARTITION BY v.repo, v.path ORDER BY v.ts_ns, v.seq)",
    "ms_log": _with(_VLOG) + f"SELECT seq, '[' || strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M:%S.%g') || '] ' || rpad({_LABEL}, 8, ' ') || ' ' || path || ' (' || file_size || ' B)' AS line FROM vlog",
    "delta_round_trip": _with(_CHAIN, "p AS (SELECT path, rev, coalesce(lag(content) OVER (PARTITION BY path ORDER BY rev), '') || chr(10) || content AS new FROM vchain)") + "SELECT path, rev, CAST(strlen(new) AS INTEGER) AS file_size, true AS bounded, true AS same FROM p",
    "encrypted_round_trip": _with(_CHAIN) + "SELECT path, rev, true AS same FROM vchain",
    "capture_fsm": _with(_RECORDS) + _FSM,
    "stream_captured": _with(_RECORDS) + _FSM,
    "captured_from_state": _with(
        f"{_CHAIN}, c AS (SELECT path, rev * 1000 + 1000 AS ts_ns, content, lag(content) OVER (PARTITION BY path ORDER BY rev) AS was, path LIKE '%1' AND min(rev) OVER (PARTITION BY path) = 0 AS history, min(rev) OVER (PARTITION BY path) = 0 AS seeded FROM vchain)",
        "ch AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts_ns) AS k FROM c WHERE ts_ns > 1000 AND (was IS NULL OR content <> was))",
    )
    + """SELECT path, ts_ns, CASE WHEN was IS NULL OR (k = 1 AND history) OR was = '' OR content = '' THEN 1 ELSE 2 END AS event_type, CAST(strlen(content) AS BIGINT) AS file_size,
  CASE WHEN was IS NULL THEN 'new' WHEN k = 1 AND history THEN 'reanchored' WHEN was = '' OR content = '' THEN 'rewritten' ELSE 'changed' END AS reason FROM ch
UNION ALL SELECT path, 1, 1, CAST(strlen(was) AS BIGINT), 'original' FROM ch WHERE k = 1 AND seeded AND NOT history AND was IS NOT NULL""",
    "segments_read": _with(_CHAIN) + _WRITTEN,
    "segments_sealed": _with(_CHAIN) + _WRITTEN,
    "segments_source": _with(_CHAIN) + "SELECT path, count(*) AS n, count(*) AS n_seq, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM vchain GROUP BY path",
    "segments_checked": _with(_CHAIN) + "SELECT CAST(NULL AS VARCHAR) AS fault, count(*) AS n_records, 0 AS torn_bytes FROM vchain UNION ALL SELECT 'magic', 0, 0",
    "walked": _with(_FILES, "q AS (SELECT path, content, string_split(path, '/')[-1] AS base FROM vfiles)")
    + f"SELECT path, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS sha256 FROM q WHERE NOT {_EXCLUDED} AND NOT contains('/' || path || '/', '/de/') AND NOT (path LIKE '%7')",
    "exported_versions": _with(_RECORDS) + "SELECT path, 'v' || lpad(CAST(ts_ns AS VARCHAR), 6, '0') || '_' || ts_ns AS version_file, sha256(content) AS sha256 FROM records WHERE kind = 1 AND content <> ''",
    "manifest_file": _with(_VLOG, f"n AS (SELECT *, sum(CASE WHEN event_type <> 3 THEN 1 ELSE 0 END) OVER w AS v FROM vlog {_W})")
    + f"SELECT path, ts_ns, seq, {_LABEL} AS event, file_size AS size, CASE WHEN event_type = 3 THEN '' ELSE 'v' || lpad(CAST(v AS VARCHAR), 6, '0') || '_' || ts_ns END AS version_file FROM n",
    "tags_table": "SELECT * FROM (VALUES ('v1', 5::BIGINT), ('v2', 6), ('v1', 9)) t(name, ts_ns)",
    "annotations_table": _with(_VLOG) + "SELECT ts_ns, path, 'n ' || seq AS summary FROM vlog",
    "patterns_table": "SELECT lower(n_name) AS pattern FROM nation WHERE lower(n_name) NOT LIKE '%a%' UNION SELECT '*.' || lower(n_name) FROM nation",
    "baseline_table": _with(_VLOG, _BASE) + "SELECT DISTINCT path FROM base",
    "status_table": _with(_VLOG) + "SELECT repo AS root, count(*) AS deltas, CAST(sum(delta_size) AS BIGINT) AS bytes, count(DISTINCT path) AS files, 0 AS lost FROM vlog GROUP BY repo",
    "stream_totals": "SELECT CAST(user_id % 4 AS VARCHAR) AS repo, count(*) AS deltas, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY ALL",
    "stream_sessions": """WITH e AS (SELECT user_id AS path, epoch_us(ts) AS us FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY path ORDER BY us) > 21600000000 THEN 1 ELSE 0 END AS cut FROM e),
s AS (SELECT *, sum(cut) OVER (PARTITION BY path ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g),
w AS (SELECT path, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY path, k)
SELECT path, n, first_us, last_us FROM w WHERE last_us + 21600000000 <= (SELECT max(us) // 1000 * 1000 - 3600000000 FROM e)""",
    "stream_debounced": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, epoch_ms(date_trunc('second', ts)) AS ms, event_type IN ('error', 'purchase') AS closes, event_id FROM events),
g AS (SELECT *, CASE WHEN ms - lag(ms) OVER w > 21600000 OR lag(closes) OVER w THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY path ORDER BY ms, event_id)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY path ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
w AS (SELECT path, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms, bool_or(closes) AS closed FROM s GROUP BY path, k)
SELECT path, CAST(sum(n) AS BIGINT) AS n, min(first_ms) AS first_ms FROM w WHERE closed OR last_ms + 21600001 <= (SELECT max(ms) - 3600000 FROM e) GROUP BY path""",
}
