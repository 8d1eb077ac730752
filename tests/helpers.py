"""Small hand-made detector inputs and a sequential model of the detector that shares no code with it."""

from __future__ import annotations

from collections import Counter, defaultdict


def build_inputs(spark, events, params):
    """events: list of (machine, {property: value | [values]}) in stream order.
    params: {property: (K, threshold)}; every machine uses one model 'M'."""
    groups, obs = [], []
    for i, (m, props) in enumerate(events):
        gid, tid = f"G{i}", f"T{i}"
        groups.append((m, gid, i, tid, f"t{i}"))
        pos = 0
        for p, vs in props.items():
            for v in vs if isinstance(vs, list) else [vs]:
                obs.append((m, gid, pos, p, float(v), tid, f"t{i}"))
                pos += 1
    g = spark.createDataFrame(groups, "machine_id string, group_id string, seq bigint, timestamp_id string, timestamp_value string")
    o = spark.createDataFrame(obs, "machine_id string, group_id string, obs_pos bigint, property_id string, value double, timestamp_id string, timestamp_value string")
    machines = spark.createDataFrame(sorted({(m, "M") for m, _ in events}), "machine_id string, model_id string")
    mp = spark.createDataFrame(
        [("M", p, k, t, True) for p, (k, t) in params.items()],
        "model_id string, property_id string, num_clusters int, prob_threshold double, stateful boolean",
    )
    return g, o, machines, mp


def model_kmeans(values, seeds):
    """Lloyd rounds from ``seeds`` until the mean distance moves by at most 1e-5."""
    centres, before = list(seeds), float("inf")
    while True:
        members = [[] for _ in centres]
        distance = 0.0
        for v in values:
            gaps = [abs(v - c) for c in centres]
            members[gaps.index(min(gaps))].append(v)
            distance += min(gaps)
        centres = [sum(m) / len(m) for m in members if m]
        distance /= len(values)
        if abs(before - distance) <= 1e-5:
            return centres
        before = distance


def model_labels(values, centres):
    out = []
    for v in values:
        gap = min(abs(c - v) for c in centres)
        out.append(centres.index(max(c for c in centres if abs(c - v) == gap)))
    return out


def model_chain(labels, n_centres, threshold, n):
    """(index, probability) of the first chain of n transitions below the threshold, or None."""
    steps = list(zip(labels, labels[1:]))
    out_of, pair = Counter(a for a, _ in steps), Counter(steps)
    p = [1.0 if n_centres == 1 else pair[s] / out_of[s[0]] for s in steps]
    n = min(n, len(p))
    run = 1.0
    for factor in p[:n]:
        run *= factor
        if run < threshold:
            return 0, run
    for start in range(1, len(p) - n + 1):
        if p[start - 1] != p[start + n - 1]:
            run = run / p[start - 1] * p[start + n - 1]
        if run < threshold:
            return start, run
    return None


def simulate(events, params, W, N):
    """Sequential dispatcher: the window of W events is evaluated when the machine's next
    event arrives; first report per (property, timestamp id) wins. Returns emission order."""
    window = defaultdict(list)
    carried = {}
    reported = set()
    out = []
    for i, (m, _props) in enumerate(events):
        if len(window[m]) == W:
            seen = defaultdict(list)
            for j in window[m]:
                for p, vs in events[j][1].items():
                    seen[p] += [(float(v), f"T{j}") for v in (vs if isinstance(vs, list) else [vs])]
            for p in sorted(seen):
                values = [v for v, _ in seen[p]]
                k, threshold = params[p]
                if (m, p) not in carried:
                    centres = model_kmeans(values, list(dict.fromkeys(values))[:k])
                else:
                    centres, gone = carried[m, p]
                    new = values[-1]
                    if new != gone and new not in centres:
                        centres = model_kmeans(values, centres + [new] if len(centres) < k else centres)
                carried[m, p] = centres, values[0]
                hit = model_chain(model_labels(values, centres), len(centres), threshold, N)
                if hit and (p, seen[p][hit[0]][1]) not in reported:
                    reported.add((p, seen[p][hit[0]][1]))
                    out.append((m, p, seen[p][hit[0]][1], hit[1]))
            window[m].pop(0)
        window[m].append(i)
    return out
