"""Sessions, arcs and ordered state over events read as calls."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from facetledger.functions import display
from facetledger.operators import resolve as rs
from facetledger.operators import sessions as ss
from facetledger.operators.classify import activity_rules, context_rules, domain_keywords, keyword_tagger, project_workdir
from facetledger.operators.scan import CHUNK, ROW
from facetledger.plans.label_queries import ACTIVITY_SQL, CALLS_CTE, DOMAIN_SQL, PROJECT_SQL, TAGS_SQL, classify_coverage, coverage_sql
from facetledger.plans.registry import plain, query
from facetledger.schemas import FACETS
from facetledger.sources.tables import event_calls, load
from facetledger.vocab import ACTIVITY_WORDS, DOMAIN_WORDS

# Events of a user lie hours apart, so the limits are wider than the defaults.
RULES = ss.SessionRules(gap_minutes=600, arc_gap_minutes=240, anchor_min_chars=45)
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"

ORDERED = f"""{CALLS_CTE}, o AS (SELECT *, coalesce(session_id, '__no_session__') AS s, CASE WHEN event_id % 50 <> 0 AND event_id % 23 = 1
    THEN ['business','personal','unknown'][k % 3 + 1] END AS declared FROM calls),
g AS (SELECT *, lag(ts) OVER w AS pts, lag(workdir) OVER w AS pw FROM o WINDOW w AS (PARTITION BY s ORDER BY ts, call_id)),
a AS (SELECT *, CASE WHEN pts IS NULL OR epoch_us(ts) - epoch_us(pts) > 240 * 60 * 1000000::BIGINT THEN call_id END AS st FROM g),
arcs AS (SELECT *, concat(s, ':', last_value(st IGNORE NULLS) OVER (PARTITION BY s ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING)) AS arc_id,
  length(text) >= 45 AS anchor FROM a)
"""


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def calls(spark, sf_dir):
    return event_calls(spark, sf_dir)


def arc_calls(spark, sf_dir):
    return ss.with_arcs(calls(spark, sf_dir), RULES.arc_gap_minutes)


@query(
    "session_boundaries",
    f"{ORDERED}, d AS (SELECT *, CASE WHEN pts IS NULL THEN 'no-prior' WHEN epoch_us(ts) - epoch_us(pts) > 600 * 60 * 1000000::BIGINT THEN 'time-gap' "
    "WHEN pw <> workdir THEN 'workdir-change' ELSE 'continues' END AS reason FROM g WHERE session_id IS NOT NULL) "
    "SELECT call_id, reason, CAST(sum(CASE WHEN reason <> 'continues' THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM d",
)
def session_boundaries(spark, sf_dir):
    own = calls(spark, sf_dir).filter("session_id is not null")
    return ss.session_decisions(own, RULES).select("call_id", "reason", "segment")


@query(
    "arcs",
    f"{ORDERED} SELECT arc_id, min(session_id) AS session_id, count(*) AS calls, {STAMP.format('min(ts)')} AS start_ts, {STAMP.format('max(ts)')} AS end_ts, "
    "round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE, 6) AS duration_seconds FROM arcs GROUP BY 1",
)
def arcs(spark, sf_dir):
    table = ss.arc_table(arc_calls(spark, sf_dir))
    return plain(table.select("arc_id", "session_id", "calls", stamp("start_ts"), stamp("end_ts"), "duration_seconds"))


@query(
    "arc_text",
    f"{ORDERED} SELECT arc_id, right(string_agg(text, chr(10) || chr(10) ORDER BY ts, call_id), 300) AS text FROM arcs GROUP BY 1",
)
def arc_text(spark, sf_dir):
    return ss.arc_text(arc_calls(spark, sf_dir), 300)


@query(
    "arc_synthetic_calls",
    f"{ORDERED} SELECT concat('arc:', arc_id) AS call_id, {STAMP.format('max(ts)')} AS timestamp, arg_min(workdir, (ts, call_id)) AS working_directory, "
    "right(string_agg(text, chr(10) || chr(10) ORDER BY ts, call_id), 12000) AS text FROM arcs GROUP BY arc_id",
)
def arc_synthetic_calls(spark, sf_dir):
    made = ss.synthetic_calls(arc_calls(spark, sf_dir))
    return made.select("call_id", stamp("timestamp"), "working_directory", F.get("messages", F.lit(0))["content"].alias("text"))


@query("anchor_flags", f"{ORDERED} SELECT call_id, anchor AS is_anchor FROM arcs")
def anchor_flags(spark, sf_dir):
    return calls(spark, sf_dir).select("call_id", ss.is_anchor(RULES.anchor_min_chars).alias("is_anchor"))


ANCHORED = f"""{ORDERED}, n AS (SELECT *, coalesce(
  last_value(CASE WHEN anchor THEN call_id END IGNORE NULLS) OVER (PARTITION BY arc_id ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING),
  first_value(CASE WHEN anchor THEN call_id END IGNORE NULLS) OVER (PARTITION BY arc_id ORDER BY ts, call_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS anchor_id FROM arcs)
"""


@query("nearest_anchor", f"{ANCHORED} SELECT call_id, arc_id, anchor_id FROM n")
def nearest_anchor(spark, sf_dir):
    found = ss.nearest_anchor(arc_calls(spark, sf_dir), F.col("call_id"), ss.is_anchor(RULES.anchor_min_chars))
    return found.select("call_id", "arc_id", F.col("anchor").alias("anchor_id"))


@query(
    "arc_eligibility",
    f"{ORDERED} SELECT arc_id, count(*) AS calls, count(*) FILTER (WHERE anchor) AS anchors, CASE WHEN count(*) < 2 THEN 'single-message-arc' "
    "WHEN max(session_id) IS NULL THEN 'no-session-id' WHEN count(*) = count(*) FILTER (WHERE anchor) THEN 'all-anchors' WHEN count(*) FILTER (WHERE anchor) = 0 THEN 'no-anchors' END AS reason "
    "FROM arcs GROUP BY 1",
)
def arc_eligibility(spark, sf_dir):
    return ss.arc_eligibility(arc_calls(spark, sf_dir), ss.is_anchor(RULES.anchor_min_chars))


def labelled_arcs(spark, sf_dir):
    """Calls with the verdicts of all classifiers, in arcs."""
    marked = lambda rows: rs.classify(rows).withColumn("is_anchor", ss.is_anchor(RULES.anchor_min_chars))
    kept = ("session_id", "call_id", "timestamp", "is_anchor", "classifications", CHUNK, ROW)
    return ss.with_arcs(ss.dealt(calls(spark, sf_dir), then=lambda rows: marked(rows).select(*kept)), RULES.arc_gap_minutes)


CONTEXT_SQL = "CASE WHEN workdir LIKE '%/taxes/%' THEN 'personal' WHEN workdir LIKE '%/repos/%' THEN 'business' ELSE 'unknown' END"


def inherited_sql(facet: str, name: str = "call_id") -> str:
    """A facet's strongest verdict in the segment before each call, the earliest on ties, as an inherited candidate."""
    return (
        f"SELECT call_id, '{facet}' AS facet, h.v AS value, least(-h.neg, 0.75) AS confidence, concat('session-inherited-from-', h.id) AS source, 100 AS ord FROM ("
        f"SELECT w.call_id, min(CASE WHEN f.confidence >= 0.5 THEN {{'neg': -f.confidence, 'ts': w.ts, 'id': w.{name}, 'v': f.value}} END) OVER "
        f"(PARTITION BY w.s, w.segment ORDER BY w.ts, w.call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM walk w LEFT JOIN first f ON f.call_id = w.call_id AND f.facet = '{facet}') WHERE h IS NOT NULL"
    )


FACET_LIST = ", ".join(f"('{f.name}', {f.min_confidence}, {f.top_n if f.array else 1})" for f in FACETS.values())
OWN_SQL = f"""own AS (
  SELECT call_id, 'context' AS facet, CASE WHEN workdir LIKE '%/taxes/%' THEN 'personal' WHEN workdir LIKE '%/repos/%' THEN 'business' ELSE 'unknown' END AS value,
    CASE WHEN workdir LIKE '/tmp%' THEN 0.5::DOUBLE ELSE 0.85 END AS confidence,
    CASE WHEN workdir LIKE '%/taxes/%' THEN 'workdir-personal-fragment' WHEN workdir LIKE '%/repos/%' THEN 'workdir-business-fragment' ELSE 'default-unknown' END AS source, 0 AS ord FROM calls
  UNION ALL SELECT call_id, 'domain', domain, CASE WHEN n = 1 THEN 0.6::DOUBLE ELSE 0.8 END, concat('keywords-', n, '-hits'), 0 FROM r WHERE rk = 1 AND n > 0
  UNION ALL SELECT call_id, 'activity', {ACTIVITY_SQL}, CASE WHEN branch IS NOT NULL THEN 0.9::DOUBLE WHEN k % 6 = 0 THEN 0.8 ELSE 0.5 END,
    CASE WHEN branch IS NOT NULL THEN concat('git-branch-prefix-', split_part(branch, '/', 1)) WHEN k % 6 = 0 THEN 'test-file-path' ELSE 'default-unknown' END, 0 FROM calls
  UNION ALL SELECT call_id, 'project', value, confidence, source, ord FROM p WHERE ord < 7
  UNION ALL SELECT call_id, 'tags', value, confidence, source, ord FROM tags),
"""
KEPT_SQL = """kept AS (SELECT cand.*, low, top, min(ord) OVER (PARTITION BY call_id, facet, value) AS seen FROM cand JOIN facets USING (facet) WHERE confidence >= low),
best AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY call_id, facet, value ORDER BY confidence DESC, ord) = 1),
final AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY call_id, facet ORDER BY confidence DESC, seen) <= top)
"""
OWN_VERDICTS = f"{DOMAIN_SQL[len(CALLS_CTE):]}{PROJECT_SQL[len(CALLS_CTE):]}{TAGS_SQL[len(CALLS_CTE):]}, facets(facet, low, top) AS (VALUES {FACET_LIST}), {OWN_SQL}"
RECURSIVE = ("WITH base", "WITH RECURSIVE base", 1)
FIRST_SQL = "first AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY call_id, facet ORDER BY confidence DESC, ord) = 1)"
# The walk over a session: boundaries, the strongest context so far and the context each call resolves to.
STEP_SQL = """segment + CAST(reason <> 'continues' AS BIGINT), CASE WHEN reason <> 'continues' OR cc > hc THEN cv ELSE hv END,
    CASE WHEN reason <> 'continues' OR cc > hc THEN cc ELSE hc END, CASE WHEN reason = 'continues' AND least(hc, 0.75) > cc THEN hv ELSE cv END"""
CLASSIFIED = f"""{ORDERED.replace(*RECURSIVE)}{OWN_VERDICTS}{FIRST_SQL},
numbered AS (SELECT g.*, row_number() OVER (PARTITION BY s ORDER BY ts, g.call_id) AS i, f.value AS cv, f.confidence AS cc
  FROM g JOIN first f ON f.call_id = g.call_id AND f.facet = 'context' WHERE session_id IS NOT NULL),
walk AS (
  SELECT s, i, ts, call_id, 'no-prior' AS reason, 1::BIGINT AS segment, cv AS hv, cc AS hc, cv AS ctx FROM numbered WHERE i = 1
  UNION ALL
  SELECT s, i, ts, call_id, reason, {STEP_SQL}
  FROM (SELECT n.s, n.i, n.ts, n.call_id, n.cv, n.cc, w.segment, w.hv, w.hc, CASE WHEN epoch_us(n.ts) - epoch_us(n.pts) > 600 * 60 * 1000000::BIGINT THEN 'time-gap'
    WHEN n.pw <> n.workdir THEN 'workdir-change' WHEN w.ctx <> n.declared THEN 'context-change' ELSE 'continues' END AS reason
    FROM walk w JOIN numbered n ON n.s = w.s AND n.i = w.i + 1)),
cand AS (SELECT * FROM own UNION ALL {" UNION ALL ".join(inherited_sql(f) for f in FACETS)}),
{KEPT_SQL}"""


@query(
    "anchor_revision",
    f"{ANCHORED}{OWN_VERDICTS}cand AS (SELECT * FROM own), {KEPT_SQL}, lists AS (SELECT call_id, facet, string_agg(value, ',' ORDER BY confidence DESC, seen) AS vals, max(confidence) AS most FROM final GROUP BY 1, 2) "
    "SELECT n.call_id, b.facet, n.arc_id, coalesce(w.vals, '') AS original, CASE WHEN w.most >= 0.99 THEN w.vals ELSE b.vals END AS revised, CASE WHEN w.most >= 0.99 THEN 'pass1-above-floor' END AS skipped "
    "FROM n JOIN lists b ON b.call_id = n.anchor_id LEFT JOIN lists w ON w.call_id = n.call_id AND w.facet = b.facet WHERE NOT n.anchor AND n.session_id IS NOT NULL",
)
def anchor_revision(spark, sf_dir):
    audit = ss.revisions(ss.revise_by_anchor(labelled_arcs(spark, sf_dir), RULES), RULES)
    listed = {c: F.array_join(c, ",") for c in ("original", "revised")}
    return audit.withColumns(listed).select("call_id", "facet", "arc_id", "original", "revised", "skipped")


@query(
    "classified_calls",
    f"{CALLS_CTE}{OWN_VERDICTS}cand AS (SELECT * FROM own), {KEPT_SQL} "
    "SELECT call_id, facet, value, round(confidence, 6) AS confidence, source FROM final",
)
def classified_calls(spark, sf_dir):
    return plain(rs.long_form(rs.classify(calls(spark, sf_dir)), "call_id").select("call_id", "facet", "value", "confidence", "source"))


query("classify_coverage", coverage_sql(OWN_VERDICTS, KEPT_SQL))(classify_coverage)


@query("session_classification", f"{CLASSIFIED} SELECT call_id, reason, segment, facet, value, round(confidence, 6) AS confidence, source FROM final LEFT JOIN walk USING (call_id)")
def session_classification(spark, sf_dir):
    rows = ss.classify_sessions(calls(spark, sf_dir), rules=RULES)
    return plain(rs.long_form(rows, "call_id", "reason", "segment").select("call_id", "reason", "segment", "facet", "value", "confidence", "source"))


# An arc as one call: the first call's fields, the last call's time and name, the joined text with all its tickets.
ARC_UNITS = ORDERED.replace(*RECURSIVE).replace("\ncalls AS (", "\nevery AS (").replace("FROM calls)", "FROM every)") + """, calls AS (
  SELECT concat('arc:', arc_id) AS call_id, arc_id, s, max(ts) AS ts, min(ts) AS begins, arg_max({'id': call_id, 'dir': workdir}, (ts, call_id)) AS ending,
    right(string_agg(text, chr(10) || chr(10) ORDER BY ts, call_id), 12000) AS text,
    unnest(arg_min({'uid': uid, 'k': k, 'event_id': event_id, 'session_id': session_id, 'workdir': workdir, 'branch': branch, 'repo': repo, 'request_project': request_project, 'team': team, 'declared': declared}, (ts, call_id)))
  FROM arcs GROUP BY arc_id, s)"""
TICKETS_SQL = "SELECT call_id, regexp_extract(text, 'PAY-[0-9]+'), 0.9, 'prompt-ticket-ref', 6 FROM calls WHERE k % 5 = 2"
ALL_TICKETS_SQL = (
    "SELECT call_id, value, 0.9, 'prompt-ticket-ref', 6 + min(i) / 1000000.0::DOUBLE FROM (SELECT call_id, unnest(found) AS value, unnest(range(len(found))) AS i "
    "FROM (SELECT call_id, regexp_extract_all(text, '\\b[A-Z][A-Z0-9]{1,9}-[0-9]{2,5}\\b') AS found FROM calls)) GROUP BY call_id, value"
)
ARC_VERDICTS = f"{ARC_UNITS}{OWN_VERDICTS}".replace(TICKETS_SQL, ALL_TICKETS_SQL)
ARC_MODE = f"""{ARC_VERDICTS}{FIRST_SQL},
gaps AS (SELECT *, ending.id AS last_id, lag(ts) OVER w AS pts, lag(ending.dir) OVER w AS pw, row_number() OVER w AS i FROM calls WHERE session_id IS NOT NULL WINDOW w AS (PARTITION BY s ORDER BY ts, ending.id)),
numbered AS (SELECT gaps.*, f.value AS cv, f.confidence AS cc FROM gaps JOIN first f ON f.call_id = gaps.call_id AND f.facet = 'context'),
walk AS (
  SELECT s, i, ts, call_id, last_id, 'no-prior' AS reason, 1::BIGINT AS segment, cv AS hv, cc AS hc, cv AS ctx FROM numbered WHERE i = 1
  UNION ALL
  SELECT s, i, ts, call_id, last_id, reason, {STEP_SQL}
  FROM (SELECT n.s, n.i, n.ts, n.call_id, n.last_id, n.cv, n.cc, w.segment, w.hv, w.hc, CASE WHEN epoch_us(n.begins) - epoch_us(n.pts) > 600 * 60 * 1000000::BIGINT THEN 'time-gap'
    WHEN n.pw <> n.workdir THEN 'workdir-change' WHEN w.ctx <> n.declared THEN 'context-change' ELSE 'continues' END AS reason
    FROM walk w JOIN numbered n ON n.s = w.s AND n.i = w.i + 1)),
cand AS (SELECT * FROM own UNION ALL {" UNION ALL ".join(inherited_sql(f, 'last_id') for f in FACETS)}),
{KEPT_SQL}"""


@query("arc_verdicts", f"{ARC_VERDICTS}cand AS (SELECT * FROM own), {KEPT_SQL} SELECT substr(call_id, 5) AS arc_id, facet, value, round(confidence, 6) AS confidence, source FROM final")
def arc_verdicts(spark, sf_dir):
    made = ss.arc_verdicts(arc_calls(spark, sf_dir), rules=RULES)
    return plain(rs.long_form(made, "arc_id").select("arc_id", "facet", "value", "confidence", "source"))


@query(
    "arc_text_revision",
    f"{ARC_VERDICTS}cand AS (SELECT * FROM own), {KEPT_SQL}, protected AS (SELECT call_id FROM every WHERE request_project IS NOT NULL OR k % 25 = 0 OR k % 33 = 0) "
    "SELECT arcs.call_id, final.facet, final.value, round(final.confidence, 6) AS confidence FROM arcs JOIN final ON final.call_id = concat('arc:', arcs.arc_id) "
    "WHERE final.facet <> 'project' OR arcs.call_id NOT IN (SELECT call_id FROM protected)",
)
def arc_text_revision(spark, sf_dir):
    """What calls take from their arc's own verdicts; a declared project stays."""
    arcs = ss.with_arcs(ss.dealt(calls(spark, sf_dir), then=rs.classify), RULES.arc_gap_minutes)
    revised = ss.revise_by_text(arcs, arcs.drop("classifications", "pipeline_version"), rules=RULES)
    taken = revised.select("call_id", F.inline("_revised")).filter(F.startswith("source", F.lit(ss.FROM_ARC)))
    return plain(taken.select("call_id", "facet", "value", "confidence"))


@query("arc_mode", f"{ARC_MODE} SELECT arcs.arc_id, arcs.call_id, final.facet, final.value, round(final.confidence, 6) AS confidence, final.source FROM arcs JOIN final ON final.call_id = concat('arc:', arcs.arc_id)")
def arc_mode(spark, sf_dir):
    shared = ss.classify_arcs(calls(spark, sf_dir), rules=RULES)
    return plain(rs.long_form(shared, "arc_id", "call_id").select("arc_id", "call_id", "facet", "value", "confidence", "source"))


def updates_sql(trigger: float) -> str:
    """Back-propagation over ``v`` (call_id, s, rn, ts, facet, value, conf, src): ``upd``, the weak verdicts that the next strong
    one overwrites. Context goes first; the other facets stop where the context then differs."""
    return f"""ev AS (SELECT *, conf >= {trigger} AND src NOT LIKE 'session-inherited-from-%' AS fires FROM v WHERE conf >= 0.7),
ctx AS (SELECT * FROM v WHERE facet = 'context'),
nx AS (SELECT *, first_value(CASE WHEN conf >= 0.7 THEN rn END IGNORE NULLS) OVER (PARTITION BY s, facet ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS jn FROM v),
hits AS (SELECT nx.*, e.fires, e.value AS nv, e.call_id AS nid, e.ts AS nts, c.value AS nctx FROM nx JOIN ev e ON e.s = nx.s AND e.facet = nx.facet AND e.rn = nx.jn
  LEFT JOIN ctx c ON c.s = e.s AND c.rn = e.rn WHERE nx.conf < 0.7),
cu AS (SELECT s, rn, nv, jn FROM hits WHERE facet = 'context' AND fires),
stops AS (SELECT hits.*, fires AND coalesce(CASE WHEN cu.jn < hits.jn THEN cu.nv ELSE c.value END <> nctx, false) AS differs FROM hits
  LEFT JOIN ctx c ON c.s = hits.s AND c.rn = hits.rn LEFT JOIN cu ON cu.s = hits.s AND cu.rn = hits.rn WHERE hits.facet <> 'context'),
upd AS (SELECT call_id, facet, value, conf, src, nv, nid, nts FROM hits WHERE facet = 'context' AND fires
  UNION ALL SELECT call_id, facet, value, conf, src, nv, nid, nts FROM stops d WHERE fires AND NOT differs
    AND NOT EXISTS (SELECT 1 FROM stops x WHERE x.s = d.s AND x.facet = d.facet AND x.jn = d.jn AND x.rn > d.rn AND x.differs))"""


# Every fourth call of a user lies in another place, so that contexts differ inside a session; a lower trigger lets all facets act.
MOVED = ORDERED.replace("CASE WHEN user_id % 3 = 0 THEN '/home", "CASE WHEN event_id % 4 = 0 THEN '/home/u/taxes/y' WHEN user_id % 3 = 0 THEN '/home", 1)


@query(
    "back_propagation",
    f"{MOVED}{OWN_VERDICTS}rn AS (SELECT call_id, s, ts, row_number() OVER (PARTITION BY s ORDER BY ts, call_id) AS rn FROM o WHERE session_id IS NOT NULL), "
    "v AS (SELECT rn.*, facet, value, confidence AS conf, source AS src FROM own JOIN rn USING (call_id) WHERE facet IN ('context', 'domain', 'activity')), "
    f"{updates_sql(0.8)} SELECT call_id, facet, value AS original, conf AS original_confidence, src AS original_source, nv AS new_value, 0.8::DOUBLE AS new_confidence, "
    "concat('back-propagated-from-', nid) AS new_source, nid AS triggered_by, strftime(nts, '%Y-%m-%d %H:%M:%S') AS updated_at FROM upd",
)
def back_propagation(spark, sf_dir):
    rules = replace(RULES, trigger=0.8)
    elsewhere = F.substring("call_id", 2, 20).cast("bigint") % 4 == 0
    moved = calls(spark, sf_dir).withColumn("working_directory", F.when(elsewhere, F.lit("/home/u/taxes/y")).otherwise(F.col("working_directory")))
    rows = ss.dealt(moved, then=lambda dealt: rs.classify(dealt).select("session_id", "call_id", "timestamp", "classifications", CHUNK, ROW))
    audit = ss.audit_updates(ss.back_propagate(rows, rules), rules)
    return audit.select(
        "call_id", "facet", "original", "original_confidence", "original_source", "new_value", "new_confidence", "new_source", "triggered_by", stamp("updated_at"),
    )


@query(
    "followed_users",
    f"{CALLS_CTE}, d AS (SELECT *, uid AS who, CASE WHEN event_id % 7 <> 0 THEN concat('w', k % 3) END AS sid FROM calls), "
    "f AS (SELECT *, coalesce(last_value(sid IGNORE NULLS) OVER (PARTITION BY who ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING), '__no_session__') AS named FROM d), "
    "l AS (SELECT *, lag(named) OVER w AS pn, lag(ts) OVER w AS pts, lag(workdir) OVER w AS pw FROM f WINDOW w AS (PARTITION BY who ORDER BY ts, call_id)), "
    "r AS (SELECT *, CASE WHEN pts IS NULL THEN 'no-prior' WHEN pn <> named THEN 'explicit-id' WHEN epoch_us(ts) - epoch_us(pts) > 600 * 60 * 1000000::BIGINT THEN 'time-gap' "
    "WHEN pw <> workdir THEN 'workdir-change' ELSE 'continues' END AS reason FROM l) "
    "SELECT call_id, reason, CAST(sum(CAST(reason <> 'continues' AS INT)) OVER (PARTITION BY who ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM r",
)
def followed_users(spark, sf_dir):
    """Boundaries along a user's calls, whichever sessions these name."""
    number = F.substring("call_id", 2, 20).cast("bigint")
    k = load(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("call_id"), F.get_json_object("props", "$.k").cast("int").alias("_k")
    )
    named = calls(spark, sf_dir).join(k, "call_id").withColumn("session_id", F.when(number % 7 != 0, F.concat(F.lit("w"), F.col("_k") % 3)))
    return ss.session_decisions(named, RULES, follow="user_id").select("call_id", "reason", "segment")


@query("session_job")
def session_job(spark, sf_dir):
    job = ss.run_sessions(calls(spark, sf_dir), rules=RULES)
    return plain(rs.long_form(job.final, "call_id").select("call_id", "facet", "value", "confidence", "source"))


def turns(spark, sf_dir):
    own = calls(spark, sf_dir).filter("session_id is not null")
    chosen = {"context": context_rules, "domain": domain_keywords, "activity": activity_rules, "project": project_workdir, "tags": keyword_tagger}
    return ss.dealt(own, then=lambda rows: rs.classify(rows, chosen))


DECAY_SQL = f"""{TAGS_SQL.replace('WITH base', 'WITH RECURSIVE base', 1)},
own AS (SELECT call_id, value, confidence, ord FROM tags),
top AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY confidence DESC, ord) <= {FACETS['tags'].top_n}),
turn AS (SELECT session_id, call_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, call_id) AS n FROM calls WHERE session_id IS NOT NULL),
listed AS (SELECT t.session_id, t.call_id, t.n, coalesce(list({{'v': value, 'c': round_even(confidence, 3)}}) FILTER (WHERE value IS NOT NULL), []) AS fresh
  FROM turn t LEFT JOIN top USING (call_id) GROUP BY ALL),
walk AS (
  SELECT session_id, call_id, n, list_sort([{{'m': -f.c, 'v': f.v, 't': 0}} FOR f IN fresh])[:5] AS held FROM listed WHERE n = 1
  UNION ALL
  SELECT l.session_id, l.call_id, l.n, list_sort(list_concat(
    [{{'m': least(round_even(h.m * 0.7, 3), coalesce(-list_filter(l.fresh, lambda f: f.v = h.v)[1].c, 0)), 'v': h.v,
       't': CASE WHEN len(list_filter(l.fresh, lambda f: f.v = h.v)) > 0 THEN 0 ELSE h.t + 1 END}} FOR h IN list_filter(w.held, lambda h: -h.m * 0.7 >= 0.3)],
    [{{'m': -f.c, 'v': f.v, 't': 0}} FOR f IN list_filter(l.fresh, lambda f: NOT list_contains([h.v FOR h IN list_filter(w.held, lambda h: -h.m * 0.7 >= 0.3)], f.v))]))[:5]
  FROM walk w JOIN listed l ON l.session_id = w.session_id AND l.n = w.n + 1)
SELECT session_id, call_id, h.v AS value, round(-h.m, 6) AS confidence, CAST(h.t AS INT) AS turns_since_seen
FROM walk LEFT JOIN LATERAL (SELECT unnest(held) AS h) ON true"""


@query("tag_decay", DECAY_SQL)
def tag_decay(spark, sf_dir):
    rows = turns(spark, sf_dir).select("session_id", "timestamp", "call_id", F.filter("classifications", lambda c: c["facet"] == "tags").alias("tags"), CHUNK, ROW)
    states = ss.tag_states(rows)
    return plain(states.select("session_id", "call_id", F.inline_outer("tags")))


@query(
    "session_totals",
    f"{ORDERED} SELECT call_id, round(CAST(sum(round(value / 100.0, 6)::DECIMAL(18,6)) OVER w AS DOUBLE), 6) AS total_cost_usd, count(*) OVER w AS call_count, "
    f"CASE WHEN {CONTEXT_SQL} = 'unknown' THEN NULL ELSE {CONTEXT_SQL} END AS context FROM o WHERE session_id IS NOT NULL WINDOW w AS (PARTITION BY s ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING)",
)
def session_totals(spark, sf_dir):
    totals = ss.session_totals(turns(spark, sf_dir))
    return plain(totals.select("call_id", "total_cost_usd", F.col("call_count").cast("bigint").alias("call_count"), "context"))


def words_sql(words, key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + f" ELSE {default} END"


@query(
    "status_labels",
    f"{ORDERED}{DOMAIN_SQL[len(CALLS_CTE):]}{TAGS_SQL[len(CALLS_CTE):]}, "
    "shown AS (SELECT call_id, string_agg(value, ',' ORDER BY confidence DESC, ord) AS tags FROM (SELECT * FROM tags QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY confidence DESC, ord) <= 3) GROUP BY 1), "
    f"acts AS (SELECT call_id, {ACTIVITY_SQL} AS activity FROM calls), "
    "total AS (SELECT *, sum(round(value / 100.0, 6)::DECIMAL(18,6)) OVER (PARTITION BY s ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS total FROM o WHERE session_id IS NOT NULL) "
    "SELECT call_id, concat_ws(' | ', CASE uid % 3 WHEN 0 THEN 'shop' WHEN 1 THEN 'y2024' ELSE split_part(workdir, '/', 3) END, "
    f"CASE WHEN activity <> 'unknown' THEN {words_sql(ACTIVITY_WORDS, 'activity', 'activity')} END, CASE WHEN r.n > 0 THEN nullif({words_sql(DOMAIN_WORDS, 'domain', 'left(domain, 4)')}, '') END, shown.tags, "
    "CASE WHEN total > 0 THEN printf('$%.2f', CAST(round(total, 2) AS DOUBLE)) END) AS label FROM total JOIN acts USING (call_id) JOIN r USING (call_id) LEFT JOIN shown USING (call_id) WHERE rk = 1",
)
def status_labels(spark, sf_dir):
    totals = ss.session_totals(turns(spark, sf_dir))
    projects = F.transform("projects", lambda p: p["value"])
    label = display.status_label(projects, F.col("activity"), F.col("domain"), rs.values_of(F.col("classifications"), "tags"), F.col("total_cost_usd"))
    return totals.select("call_id", label.alias("label"))
