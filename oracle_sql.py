"""DuckDB oracles for the registered queries (tables pre-registered as views).

Independent SQL formulations of the same semantics, used by the correctness gate at sf0.01.
Fixed values below are those of the detection method and of the events mapping
(see anomark.sources.events): W = 10, N = 5, tolerance 1e-5,
threshold 0.005, K = 3 for property _m_0 and 2 + m % 3 for _m_1, m = user_id % 5.
"""

from __future__ import annotations

W = 10
N = 5
TOL = "1e-5"
THR = "0.005"
TS_SQL = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"

# events numbered per user; one observation per (event, stateful property)
BASE = f"""
ev AS (
  SELECT event_id, user_id, ts, value, props, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS gs,
         lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt,
         max(event_id) OVER () AS last_event
  FROM events),
ob AS (
  SELECT user_id, gs, event_id, {TS_SQL} AS tval, 0 AS j, value AS v FROM ev
  UNION ALL
  SELECT user_id, gs, event_id, {TS_SQL} AS tval, 1 AS j,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM ev)
"""


def windows_cte(anchor_filter: str = f"a.gs >= {W} AND a.nxt IS NOT NULL", w: int = W) -> str:
    return f"""
win AS (
  SELECT 'Machine_' || a.user_id AS machine_id,
         '_' || (a.user_id % 5) || '_' || o.j AS property_id,
         CAST(greatest(1, a.gs - {w - 1}) AS BIGINT) AS window_no,
         CAST(a.nxt AS BIGINT) AS trigger_seq,
         CASE WHEN o.j = 0 THEN 3 ELSE 2 + (a.user_id % 5) % 3 END AS k,
         list(o.v ORDER BY o.gs) AS vals,
         list('Timestamp_' || o.event_id ORDER BY o.gs) AS tids,
         list(o.tval ORDER BY o.gs) AS tvals
  FROM ev a JOIN ob o ON o.user_id = a.user_id AND o.gs BETWEEN a.gs - {w - 1} AND a.gs
  WHERE {anchor_filter}
  GROUP BY ALL)
"""


SEEDS = """
seeded AS (
  SELECT *, list_filter(vals, lambda v, i: list_position(vals, v) = i)[1:k] AS seeds FROM win)
"""


def lloyd(cent: str, vals: str) -> str:
    """One Lloyd round as a struct {cent, avg}: lowest index on distance ties, mean of
    members (summed left to right), centroids without members dropped."""
    dist = f"list_transform({vals}, lambda v: list_transform({cent}, lambda c: abs(v - c)))"
    assign = f"list_transform({dist}, lambda d: list_position(d, list_min(d)))"
    avg = f"list_sum(list_transform({dist}, lambda d: list_min(d))) / len({vals})"
    means = (
        f"list_filter(list_transform(range(1, len({cent}) + 1), lambda c: "
        f"list_sum(list_filter({vals}, lambda v, i: {assign}[i] = c)) / "
        f"nullif(len(list_filter({vals}, lambda v, i: {assign}[i] = c)), 0)), lambda x: x IS NOT NULL)"
    )
    return f"{{'cent': {means}, 'avg': {avg}}}"


COLD = f"""
cold AS (
  WITH RECURSIVE it(machine_id, property_id, window_no, vals, cent, prev_avg, rounds, done) AS (
    SELECT machine_id, property_id, window_no, vals, seeds, 'inf'::DOUBLE, 0, false FROM seeded
    UNION ALL
    SELECT machine_id, property_id, window_no, vals, r.cent, r.avg, rounds + 1,
           abs(prev_avg - r.avg) <= {TOL}
    FROM (SELECT *, {lloyd('cent', 'vals')} AS r FROM it WHERE NOT done))
  SELECT machine_id, property_id, window_no, cent FROM it WHERE done)
"""

WARM = f"""
wk AS (
  SELECT *, row_number() OVER (PARTITION BY machine_id, property_id ORDER BY window_no) AS rn FROM seeded),
warm AS (
  WITH RECURSIVE it(machine_id, property_id, rn, vals, k, cent, prev_avg, rounds, done) AS (
    SELECT machine_id, property_id, rn, vals, k, seeds, 'inf'::DOUBLE, 0, false FROM wk WHERE rn = 1
    UNION ALL
    SELECT machine_id, property_id, rn2, vals2, k2, cent2, avg2, rounds2, done2 FROM (
      SELECT f.machine_id, f.property_id,
        CASE WHEN f.done THEN n.rn ELSE f.rn END AS rn2,
        CASE WHEN f.done THEN n.vals ELSE f.vals END AS vals2,
        CASE WHEN f.done THEN n.k ELSE f.k END AS k2,
        CASE WHEN NOT f.done THEN r.cent
             WHEN skip THEN f.cent
             WHEN len(f.cent) < n.k THEN list_append(f.cent, n.vals[-1])
             ELSE f.cent END AS cent2,
        CASE WHEN f.done THEN 'inf'::DOUBLE ELSE r.avg END AS avg2,
        CASE WHEN f.done THEN 0 ELSE f.rounds + 1 END AS rounds2,
        CASE WHEN f.done THEN skip
             ELSE abs(f.prev_avg - r.avg) <= {TOL} END AS done2
      FROM (SELECT *, CASE WHEN NOT done THEN {lloyd('cent', 'vals')} END AS r FROM it) f
      LEFT JOIN wk n ON n.machine_id = f.machine_id AND n.property_id = f.property_id AND n.rn = f.rn + 1,
      LATERAL (SELECT f.done AND (f.vals[1] = n.vals[-1] OR list_contains(f.cent, n.vals[-1])) AS skip)
      WHERE NOT f.done OR n.rn IS NOT NULL))
  SELECT w.*, it.cent FROM it JOIN wk w USING (machine_id, property_id, rn) WHERE it.done)
"""


def labels_of(cent: str, vals: str) -> str:
    return (
        f"list_transform({vals}, lambda v: list_position({cent}, list_max(list_filter({cent}, "
        f"lambda c: abs(c - v) = list_min(list_transform({cent}, lambda x: abs(x - v)))))) - 1)"
    )


def probs_of(labels: str, ncent: str) -> str:
    """Probability of every transition of a label list (count(a->b) / count(a->*))."""
    pairs = f"list_transform(range(1, len({labels})), lambda i: {{'a': {labels}[i], 'b': {labels}[i + 1]}})"
    return (
        f"list_transform({pairs}, lambda t: CASE WHEN {ncent} = 1 THEN 1.0 ELSE "
        f"len(list_filter({pairs}, lambda x: x.a = t.a AND x.b = t.b))::DOUBLE / "
        f"len(list_filter({pairs}, lambda x: x.a = t.a))::DOUBLE END)"
    )


def chain_cte(src: str) -> str:
    """First run of N transitions below the threshold, replaying the running product:
    step i <= n multiplies, later steps divide out p[i-n] and multiply in p[i] (unless equal)."""
    return f"""
steps AS (
  SELECT *, least({N}, len(p)) AS n FROM {src}),
chain AS (
  WITH RECURSIVE c(machine_id, property_id, window_no, i, prob, found, idx) AS (
    SELECT machine_id, property_id, window_no, 0, 1.0::DOUBLE, false, NULL::INTEGER FROM steps
    UNION ALL
    SELECT c.machine_id, c.property_id, c.window_no, c.i + 1, x.nxt, x.nxt < {THR},
           CASE WHEN x.nxt < {THR} THEN x.at END
    FROM c JOIN steps s USING (machine_id, property_id, window_no),
    LATERAL (SELECT
       CASE WHEN c.i + 1 <= s.n THEN c.prob * s.p[c.i + 1]
            WHEN s.p[c.i + 1 - s.n] <> s.p[c.i + 1] THEN c.prob / s.p[c.i + 1 - s.n] * s.p[c.i + 1]
            ELSE c.prob END AS nxt,
       CASE WHEN c.i + 1 <= s.n THEN 0 ELSE c.i + 1 - s.n END AS at) x
    WHERE NOT c.found AND c.i < len(s.p))
  SELECT s.*, c.prob, c.idx FROM chain_hits c JOIN steps s USING (machine_id, property_id, window_no))
"""


def _chain_with_hits(src: str) -> str:
    return chain_cte(src).replace("FROM chain_hits c", "FROM (SELECT * FROM c WHERE found) c")


def anomalies_body(cluster_cte: str, centroid_table: str, prop_filter: str = "true", windows: str | None = None) -> str:
    return f"""
WITH {BASE}, {windows or windows_cte()}, {SEEDS}, {cluster_cte},
lab AS (SELECT *, {labels_of('cent', 'vals')} AS labels FROM {centroid_table} WHERE {prop_filter}),
pr AS (SELECT *, {probs_of('labels', 'len(cent)')} AS p FROM lab),
{_chain_with_hits('pr')},
hits AS (
  SELECT machine_id, property_id, tids[idx + 1] AS timestamp_id, tvals[idx + 1] AS timestamp_value,
         prob AS probability, window_no, trigger_seq FROM chain),
firsts AS (
  SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY property_id, timestamp_id
                                                ORDER BY trigger_seq, machine_id) = 1)
"""


ANOMALY_SELECT = """
SELECT CAST(row_number() OVER (ORDER BY trigger_seq, property_id) - 1 AS BIGINT) AS anomaly_no,
       machine_id, property_id, timestamp_id, timestamp_value, round(probability, 9) AS probability,
       window_no, trigger_seq
FROM firsts
"""


def sliding_windows() -> str:
    return f"""
WITH {BASE}, {windows_cte()}
SELECT machine_id, property_id, window_no, trigger_seq, CAST(pos - 1 AS BIGINT) AS pos,
       vals[pos] AS value, tids[pos] AS timestamp_id
FROM win, LATERAL (SELECT unnest(range(1, len(vals) + 1)) AS pos)
"""


def _window_sums(keep: str, w: int = W, where: str = "true") -> str:
    return f"""
WITH {BASE}, {windows_cte(keep, w)}
SELECT machine_id, property_id, window_no, trigger_seq, CAST(len(vals) AS BIGINT) AS n_values,
       round(list_sum(vals), 6) AS sum_values
FROM win WHERE {where}
"""


def _flushed(w: int) -> str:
    return (f"(a.gs >= {w} AND a.nxt IS NOT NULL) OR "
            f"(a.user_id = (SELECT user_id FROM ev WHERE event_id = last_event) AND "
            f"a.nxt = a.last_event AND a.gs < {w})")


def tail_flush(w: int = W) -> str:
    return _window_sums(_flushed(w), w)


def stream_tail(w: int) -> str:
    return anomalies_body(WARM, "warm", windows=windows_cte(_flushed(w), w)) + ANOMALY_SELECT.replace(", trigger_seq\nFROM", "\nFROM")


def tail_file(where: str = "true") -> str:
    return _window_sums(f"a.gs >= {W} AND a.nxt IS NOT NULL AND a.nxt <> a.last_event", where=where)


def warm_kmeans_discrete() -> str:
    """The fold on the value's whole part modulo 3."""
    return warm_kmeans().replace(
        "FROM events)", "FROM (SELECT * REPLACE (((floor(value)::BIGINT % 3 + 3) % 3)::DOUBLE AS value) FROM events))")


def scan_triples() -> str:
    return f"SELECT * EXCLUDE (line) FROM ({parse_triples()})"


def anomaly_sink(system_uri: str) -> str:
    return f"SELECT value FROM ({anomaly_triples(system_uri)})"


def rejects() -> str:
    return """
WITH e AS (SELECT event_id, user_id, 'ObservationGroup_' || event_id AS g FROM events),
known AS (SELECT * FROM e WHERE event_id % 7 <> 0 AND event_id % 19 <> 0)
SELECT 'group without machine' AS reason, g AS item FROM e WHERE event_id % 7 = 0
UNION ALL SELECT 'unknown machine', g FROM e WHERE event_id % 7 <> 0 AND event_id % 19 = 0
UNION ALL SELECT 'unknown property', g || '/_unknown' FROM known WHERE event_id % 13 = 0
UNION ALL SELECT 'value is not numeric', g || '/_' || (user_id % 5) || '_0' FROM known
          WHERE event_id % 11 = 0 AND event_id % 13 <> 0
UNION ALL SELECT 'value is not finite', g || '/_' || (user_id % 5) || '_0' FROM known
          WHERE event_id % 23 = 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0
UNION ALL SELECT 'subject is not a name#local term', '<broken> line ' || event_id FROM e WHERE event_id % 17 = 0
UNION ALL SELECT 'stateful property without its parameters', 'MachineModel_4/_4_1' FROM (SELECT DISTINCT user_id % 5 AS m FROM e) WHERE m = 4
"""


def seed_values() -> str:
    return f"""
WITH {BASE}, {windows_cte()}, {SEEDS}
SELECT machine_id, property_id, window_no, CAST(i - 1 AS BIGINT) AS seed_no, seeds[i] AS seed
FROM seeded, LATERAL (SELECT unnest(range(1, len(seeds) + 1)) AS i)
"""


def _centroid_rows(table: str) -> str:
    return f"""
SELECT machine_id, property_id, window_no, CAST(i - 1 AS BIGINT) AS centroid_no,
       round(cent[i], 9) AS centroid
FROM {table}, LATERAL (SELECT unnest(range(1, len(cent) + 1)) AS i)
"""


def cold_kmeans() -> str:
    return f"WITH {BASE}, {windows_cte()}, {SEEDS}, {COLD}" + _centroid_rows("cold")


def warm_kmeans() -> str:
    return f"WITH {BASE}, {windows_cte()}, {SEEDS}, {WARM}" + _centroid_rows("warm")


def label_values() -> str:
    return f"""
WITH {BASE}, {windows_cte()}, {SEEDS},
lab AS (SELECT *, {labels_of('seeds', 'vals')} AS labels FROM seeded)
SELECT machine_id, property_id, window_no, CAST(i - 1 AS BIGINT) AS pos, CAST(labels[i] AS INTEGER) AS label
FROM lab, LATERAL (SELECT unnest(range(1, len(labels) + 1)) AS i)
"""


def transition_matrix() -> str:
    return f"""
WITH {BASE}, {windows_cte()}, {SEEDS},
lab AS (SELECT *, {labels_of('seeds', 'vals')} AS labels FROM seeded),
pr AS (SELECT *, {probs_of('labels', 'len(seeds)')} AS p FROM lab),
cells AS (
  SELECT DISTINCT machine_id, property_id, window_no,
         CASE WHEN len(seeds) = 1 THEN 0 ELSE labels[i] END AS src,
         CASE WHEN len(seeds) = 1 THEN 0 ELSE labels[i + 1] END AS dst, p[i] AS p
  FROM pr, LATERAL (SELECT unnest(range(1, len(labels))) AS i))
SELECT machine_id, property_id, window_no, CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst,
       round(p, 12) AS p
FROM cells
"""


def chain_anomalies() -> str:
    return f"""
WITH {BASE}, {windows_cte()}, {SEEDS},
lab AS (SELECT *, seeds AS cent, {labels_of('seeds', 'vals')} AS labels FROM seeded),
pr AS (SELECT *, {probs_of('labels', 'len(cent)')} AS p FROM lab),
{_chain_with_hits('pr')}
SELECT machine_id, property_id, window_no, trigger_seq, CAST(idx AS INTEGER) AS abnormal_index,
       round(prob, 9) AS probability, tids[idx + 1] AS timestamp_id
FROM chain
"""


def anomalies(prop_filter: str = "true") -> str:
    return anomalies_body(WARM, "warm", prop_filter) + ANOMALY_SELECT


def anomaly_triples(system_uri: str) -> str:
    base = f"<{system_uri}#"
    rdf_type = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
    res = "<http://www.agtinternational.com/ontologies/DEBSAnalyticResults#"
    iot = "<http://www.agtinternational.com/ontologies/IoTCore#"
    wmm = "<http://www.agtinternational.com/ontologies/WeidmullerMetadata#"
    mach = "<http://www.agtinternational.com/ontologies/I4.0#machine>"
    dbl = "<http://www.w3.org/2001/XMLSchema#double>"
    dt = "<http://www.w3.org/2001/XMLSchema#dateTime>"
    return anomalies_body(WARM, "warm") + f""",
num AS (SELECT row_number() OVER (ORDER BY trigger_seq, property_id) - 1 AS anomaly_no, * FROM firsts),
lines AS (
  SELECT anomaly_no, 0 AS ord, '{base}Anomaly_' || anomaly_no || '> {rdf_type} {res}Anomaly> .' AS value FROM num
  UNION ALL SELECT anomaly_no, 1, '{base}Anomaly_' || anomaly_no || '> {mach} {wmm}' || machine_id || '> .' FROM num
  UNION ALL SELECT anomaly_no, 2, '{base}Anomaly_' || anomaly_no || '> {res}inAbnormalDimension> {wmm}' || property_id || '> .' FROM num
  UNION ALL SELECT anomaly_no, 3, '{base}Anomaly_' || anomaly_no || '> {res}hasTimeStamp> {base}' || timestamp_id || '> .' FROM num
  UNION ALL SELECT anomaly_no, 4, '{base}Anomaly_' || anomaly_no || '> {res}hasProbabilityOfObservedAbnormalSequence> "' || CAST(probability AS VARCHAR) || '"^^{dbl} .' FROM num
  UNION ALL SELECT anomaly_no, 5, '{base}' || timestamp_id || '> {rdf_type} {iot}Timestamp> .' FROM num
  UNION ALL SELECT anomaly_no, 6, '{base}' || timestamp_id || '> {iot}ValueLiteral> "' || timestamp_value || '"^^{dt} .' FROM num)
SELECT CAST(anomaly_no AS BIGINT) AS anomaly_no, CAST(ord AS INTEGER) AS ord, value FROM lines
"""


# ---------------------------------------------------------------------------------------------
# N-Triples path and metadata

EV3 = f"""
e3 AS (
  SELECT e.*, j, 'ObservationGroup_' || event_id AS g, 'Timestamp_' || event_id AS t,
         'Machine_' || user_id AS machine_id, 'MachineModel_' || (user_id % 5) AS model_id,
         '_' || (user_id % 5) || '_' || j AS property_id,
         CASE j WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN json_extract_string(props, '$.k')
                ELSE event_type END AS raw,
         {TS_SQL} AS tval
  FROM events e, (SELECT unnest(range(3)) AS j))
"""


def parse_triples() -> str:
    def row(i, s, p, o_ns, o, lit="false", src="e1"):
        return (f"SELECT first + {i} AS line, 'data' AS s_ns, {s} AS s, 'ontology' AS p_ns, "
                f"'{p}' AS p, {o_ns} AS o_ns, {o} AS o, {lit} AS is_literal FROM {src}")

    obs = "g || '_Observation_' || j"
    out = "g || '_Output_' || j"
    val = "g || '_Value_' || j"
    parts = [
        row(0, "g", "type", "'ontology'", "'MoldingMachineObservationGroup'"),
        row(1, "g", "machine", "'data'", "machine_id"),
        row(2, "g", "observationResultTime", "'data'", "t"),
        row(3, "g", "observedCycle", "'data'", "'Cycle_' || event_id"),
        row(4, "t", "valueLiteral", "'XMLSchema#dateTime'", "tval", "true"),
        row("5 + 5 * j", "g", "contains", "'data'", obs, src="e3"),
        row("6 + 5 * j", obs, "observedProperty", "'data'", "property_id", src="e3"),
        row("7 + 5 * j", obs, "observationResult", "'data'", out, src="e3"),
        row("8 + 5 * j", out, "hasValue", "'data'", val, src="e3"),
        row("9 + 5 * j", val, "valueLiteral", "'XMLSchema#string'", "raw", "true", src="e3"),
    ]
    union = "\n  UNION ALL ".join(parts)
    return f"""
WITH {EV3.replace("e3 AS", "e0 AS")},
e3 AS (SELECT *, (dense_rank() OVER (ORDER BY event_id) - 1) * (5 + 5 * 3) AS first FROM e0),
e1 AS (SELECT * FROM e3 WHERE j = 0),
lines AS ({union})
SELECT CAST(line AS BIGINT) AS line, s_ns, s, p_ns, p, o_ns, o, is_literal FROM lines
"""


def build_metadata() -> str:
    return """
WITH u AS (SELECT DISTINCT user_id FROM events)
SELECT 'Machine_' || user_id AS machine_id, 'MachineModel_' || (user_id % 5) AS model_id,
       '_' || (user_id % 5) || '_' || j AS property_id,
       CAST(CASE j WHEN 0 THEN 3 WHEN 1 THEN 2 + (user_id % 5) % 3 END AS INTEGER) AS num_clusters,
       CASE WHEN j < 2 THEN 0.005 END::DOUBLE AS prob_threshold,
       j < 2 AS stateful
FROM u, (SELECT unnest(range(3)) AS j)
"""


def metadata_shared() -> str:
    """Each model with its own cluster count, threshold and flag of the property that all share."""
    return build_metadata() + """
UNION ALL
SELECT 'Machine_' || user_id, 'MachineModel_' || (user_id % 5), '_shared', CAST(user_id % 5 + 2 AS INTEGER),
       (user_id % 5 + 1) / 1000.0::DOUBLE, user_id % 5 <> 3
FROM u
"""


def assemble_observations() -> str:
    return f"""
WITH {EV3}
SELECT machine_id, g AS group_id, t AS timestamp_id, tval AS timestamp_value, property_id,
       raw AS raw_value, TRY_CAST(raw AS DOUBLE) AS value
FROM e3
"""


def stateful_filter() -> str:
    return f"""
WITH {EV3}
SELECT machine_id, g AS group_id, property_id, TRY_CAST(raw AS DOUBLE) AS value FROM e3 WHERE j < 2
"""


def property_params() -> str:
    return f"""
WITH {EV3}
SELECT machine_id, g AS group_id, property_id, model_id,
       CAST(CASE j WHEN 0 THEN 3 WHEN 1 THEN 2 + (user_id % 5) % 3 END AS INTEGER) AS num_clusters,
       CASE WHEN j < 2 THEN 0.005 END::DOUBLE AS prob_threshold, j < 2 AS stateful
FROM e3
"""


def wide_export() -> str:
    cols = ",\n       ".join(
        f"max(CASE WHEN property_id = '_{m}_{j}' THEN TRY_CAST(raw AS DOUBLE) END) AS \"_{m}_{j}\""
        for m in range(5) for j in range(2)
    )
    return f"""
WITH {EV3}
SELECT machine_id, t AS timestamp_id,
       {cols}
FROM e3 WHERE j < 2
GROUP BY machine_id, t
"""


def triples_anomalies() -> str:
    return anomalies_body(WARM, "warm") + """
SELECT CAST(row_number() OVER (ORDER BY trigger_seq, property_id) - 1 AS BIGINT) AS anomaly_no,
       machine_id, property_id, timestamp_id, timestamp_value, round(probability, 9) AS probability,
       window_no
FROM firsts
"""
