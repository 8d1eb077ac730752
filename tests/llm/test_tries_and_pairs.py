"""Prefix trie, hard negatives and bottom-k near-duplicates against brute-force versions, and their edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from anomark.llm import bottom_k, hard_negatives, prefix_trie


def same(got, expected):
    def key(row):
        return tuple((v is None, str(v)) for v in row)

    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, expected), key=key)


# --- prefix trie

TURNS = "conv_id long, turn long, role string, text string, node string, depth string, place string, parent string, shard string"


def trie_of(rebuilt):
    """Nodes of {conversation: [(role, text)]}, subtree by subtree."""
    members, ends, below = defaultdict(set), defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
            if d:
                below[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    out = []
    for node, who in members.items():
        under = [n for n in members if n[: len(node)] == node]
        out.append(
            (
                min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(below[node]),
                sum(not below[n] for n in under),
                sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n),
                hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
            )
        )
    return out


def rebuilt_of(rows, every=100, most=6):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = own.get(c - c % every, [])[:h] + turns[h:]
    return out


def conversations(seed, convs, texts):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(texts)))
    return rows


def edge_conversations():
    rows = conversations(1, range(0, 1000, 7), ["hi", "hello", "é😀", "", "a\nb"])
    rows += conversations(2, [*range(100, 140), *range(300, 420)], ["same"])
    rows += [(c, t, "user", f"turn {t}") for c in (2001, 2002, 2003) for t in range(75)]  # long and alike
    rows += [(2002, 75, "user", "one more"), (2003, 74, None, None), (2003, None, None, "before all"), (2003, None, "user", None)]
    rows += [(2004, 0, "user", "twice"), (2004, 0, "user", "twice"), (2004, 0, "assistant", "twice"), (None, 0, "user", "of none")]
    rows += [(c, 0, "user", "short") for c in range(5000, 5020)]  # without a base: some are left without a turn
    rows += [(6000, 0, "user", "x" * 300_000), (6001, 0, "user", "x" * 300_000), (6001, 1, "user", "y"), (10**15, 3, "user", "far")]
    return rows


def test_prefix_trie(spark):
    rows = edge_conversations()
    table = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], TURNS).repartition(3)
    expected = trie_of(rebuilt_of(rows))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    for segment, shard in ((1024, 16_384), (1, 7)):
        rebuilt = prefix_trie.with_shared_beginnings(prefix_trie.ordered_turns(table))
        same(prefix_trie.prefix_trie(rebuilt, segment, shard).select(columns).collect(), expected)


def test_prefix_trie_of_one_beginning(spark):
    """All conversations share their first turns, a third are equal: one row a shard meets at each shared node."""
    rows = [(c, t, "user", "first" if t == 0 else f"{t if c % 3 else c}") for c in range(0, 90_000, 100) for t in range(3)]
    table = spark.createDataFrame([(*r, *[None] * 5) for r in rows], TURNS)
    turns = prefix_trie.ordered_turns(table)
    got = prefix_trie.prefix_trie(prefix_trie.with_shared_beginnings(turns), 8, 100).collect()
    same(got, trie_of(rebuilt_of(rows)))


def test_prefix_trie_without_rows(spark):
    table = spark.createDataFrame([], TURNS)
    rebuilt = prefix_trie.with_shared_beginnings(prefix_trie.ordered_turns(table))
    assert prefix_trie.prefix_trie(rebuilt).count() == 0


# --- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, block int, kind int, score long, anchor long"


def negatives_of(rows, every=50, positives=5, count=3):
    usable = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        q = [int(x * 256 // 1) for x in v]
        usable[i] = min(usable.get(i, (label, q)), (label, q))
    out = []
    for a, (label, q) in usable.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, p)) for i, (_, p) in usable.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if usable[i][0] == label][:positives]:
            hard = [i for i in order if usable[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(hard[:count], 1)]
    return out


def vectors(seed, n, dims=8, labels=4):
    rng = random.Random(seed)
    return [(i, [rng.randrange(-400, 400) / 256 for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


def edge_vectors():
    rows = vectors(3, 400)
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(60)]  # ties
    rows += [(2000 + i, [0.5] * 8, i % 3) for i in range(120)]  # one vector of many rows
    rows += [(3000 + i, [0.0] * 8, i % 2) for i in range(20)]  # scores of 0
    rows += [(4000, None, 1), (4050, [1.0] * 8, None), (None, [1.0] * 8, 1), (4100, [float("nan")] + [1.0] * 7, 1)]
    rows += [(4150, [float("inf")] + [1.0] * 7, 1), (4200, [None] + [1.0] * 7, 1), (4250, [1.0, 1.0], 1), (4300, [], 1)]
    rows += [(4350, [60000.0] * 8, 2), (4400, [-60000.0] * 8, 2), (4450, [1.0] * 8, 77), (0, rows[0][1], rows[0][2]), (-50, [1.0] * 8, 3)]
    return rows


def test_hard_negatives(spark):
    rows = edge_vectors()
    table = spark.createDataFrame([(*r, None, None, None, None) for r in rows], VECTORS).repartition(3)
    expected = negatives_of(rows)
    assert len(expected) > 50
    for block in (8192, 37):
        same(hard_negatives.hard_negatives(table, "vec_id % 50 = 0", block_rows=block).collect(), expected)
    assert hard_negatives.hard_negatives(table.where("false"), "vec_id % 50 = 0").count() == 0
    assert hard_negatives.hard_negatives(table, "vec_id = 7777").count() == 0


def test_window_is_exact():
    for p in range(-50, 400):
        lo, hi = hard_negatives.window(p, 50, 95)
        assert [s for s in range(-500, 500) if 50 * p <= 100 * s <= 95 * p] == list(range(lo, hi + 1))


# --- bottom-k near-duplicates


def sets_of(text, shingle=2):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else set()


def components_of(rows, percent=80):
    sets = [sets_of(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for k, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < k:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                group[root(k)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    out = []
    for k, (i, _) in enumerate(rows):
        c = least.get(root(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return out


def edited(rng, words, share):
    return [rng.choice("abcdefghijklmnop") * 3 + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


def crowded(seed=5):
    """Groups of near copies at all distances, short texts of few words, texts that share a passage."""
    rng = random.Random(seed)
    word = [f"w{k}" for k in range(4000)]
    rows = []
    for share in (0.01, 0.04, 0.06, 0.09):
        base = rng.choices(word, k=rng.choice([60, 150, 400]))
        rows += [" ".join(edited(rng, base, share)) for _ in range(60)]
    passage = rng.choices(word, k=70)
    rows += [" ".join(rng.choices(word, k=rng.choice([20, 60, 200])) + passage) for _ in range(120)]
    rows += [" ".join(passage + rng.choices(word, k=rng.randrange(0, 30))) for _ in range(80)]
    rows += [" ".join(rng.choices(word[:4], k=rng.randrange(1, 12))) for _ in range(250)]
    chain = rng.choices(word, k=120)
    for _ in range(40):  # each near the one before, the ends far apart
        chain = edited(rng, chain, 0.03)
        rows.append(" ".join(chain))
    rng.shuffle(rows)
    return [(k * 3, t) for k, t in enumerate(rows)]


def test_near_duplicates(spark, docs, no_docs, rows):
    same(bottom_k.near_duplicates(docs).collect(), components_of(rows))
    assert bottom_k.near_duplicates(no_docs).count() == 0


def test_near_duplicates_in_large_groups(spark):
    rows = crowded()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = components_of(rows)
    same(bottom_k.near_duplicates(table, list_limit=12).collect(), expected)  # nearly all of these lists are longer


def test_blocks_of_a_list(spark, monkeypatch):
    monkeypatch.setattr(bottom_k, "MOST_SHARED", 1)
    rows = crowded(6)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(bottom_k.near_duplicates(table, list_limit=12).collect(), components_of(rows))


def test_pairs_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    """Copies of one text, some a little too far from its middle: each is compared with a few others, not with the group."""
    rng = random.Random(8)
    base = rng.choices([f"w{k}" for k in range(4000)], k=150)
    rows = [(k, " ".join(edited(rng, base, rng.choice([0.01, 0.03, 0.07])))) for k in range(300)] + [(300, " ".join(base))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    compared, verified = [], bottom_k.verified

    def counted(pairs, sets):
        compared.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(bottom_k, "verified", counted)
    same(bottom_k.near_duplicates(table, list_limit=12).collect(), components_of(rows))
    assert sum(compared) < 12 * len(rows), compared


def test_only_wanted_texts_move(spark):
    docs = spark.createDataFrame([(k, f"a{k} b{k} c{k}") for k in range(50)], "doc_id long, text string")
    keys = bottom_k.sketches(docs).select("doc_id", "row_key")
    wanted = keys.where("doc_id < 3").select(F.col("doc_id").alias("uid"), "row_key")
    sets = bottom_k.full_sets(docs, wanted, 2)
    assert sorted((r["uid"], r["n"]) for r in sets.collect()) == [(0, 2), (1, 2), (2, 2)]
    texts = sets._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in texts and texts.index("Aggregate") < texts.index("LeftSemi")  # picked below the aggregate


def test_shingle_hashes_are_sets():
    for text in ("", " \n", "One", "one two", "a b a b a b", "A b\ta B", "x " * 50, "é É e"):
        assert len(bottom_k.shingle_hashes(text.encode(), 2)) == len(sets_of(text))
    assert set(bottom_k.shingle_hashes(b"a b", 2)).isdisjoint(bottom_k.shingle_hashes(b"a", 2))


# --- few rows in many partitions


def test_components_end_when_edges_are_stars(spark, monkeypatch):
    from anomark.llm import components

    written = []
    keep = components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: written.append(keep(df, name)) or written[-1])
    rng = random.Random(5)
    stars = [(10 * k + j, 10 * k) for k in range(5) for j in range(1, 4)]
    chains = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    for edges, rounds in ((stars, 0), (stars + [(4, 4), (None, 1), *stars], 0), (chains, None), ([(1, 2)], 1), ([], 0)):
        written.clear()
        df = spark.createDataFrame(edges, "u long, v long").repartition(16)
        found = {tuple(r) for r in components.connected_components(df, 300).collect()}
        root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
        for _ in root:
            for u, v in edges:
                if u in root and v in root:
                    root[u] = root[v] = min(root[u], root[v])
        assert found == set(root.items())
        assert rounds is None or len(written) == 1 + rounds


def test_few_rows_are_written_by_few_tasks(spark):
    from anomark.llm.common import in_few

    most = 2 * spark.sparkContext.defaultParallelism
    many = spark.range(1000).repartition(most + 50)
    assert in_few(many, 1000).rdd.getNumPartitions() == most
    assert in_few(many, 1000, each=1).rdd.getNumPartitions() == most + 50
    assert in_few(many, 1000).distinct().count() == 1000


def test_minhash_picks_texts_by_few_bits(spark, monkeypatch):
    """What is sent to all tasks to pick wanted texts is some bits a text; all wanted sets come, and no others."""
    sent = []
    send = bottom_k.F.broadcast
    monkeypatch.setattr(bottom_k.F, "broadcast", lambda df: sent.append(df) or send(df))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.format_string("%d a b %d", "id", F.col("id") % 7).alias("text"))
    rows = bottom_k.sketches(docs)
    wanted = rows.where("doc_id % 2 = 0").select(F.col("doc_id").alias("uid"), "row_key")
    made = bottom_k.full_sets(docs, wanted, 2).select("uid", "n").collect()
    assert sorted((r.uid, r.n) for r in made) == [(k, 3) for k in range(0, 20_000, 2)]
    assert len(sent) == 1 and 0 < sum(len(bytes(v)) for r in sent[0].collect() for v in r if isinstance(v, (bytes, bytearray))) <= 10_000 * 4
    keys = wanted.select(F.xxhash64("row_key").alias("key"))
    others = rows.where("doc_id % 2 = 1").select(F.xxhash64("row_key").alias("key"))
    sieve, mask = bottom_k._sieve(keys, 10_000)
    assert bottom_k._picked(keys, sieve, mask).count() == 10_000
    assert bottom_k._picked(others, sieve, mask).count() < 1_500
    assert bottom_k.full_sets(docs, wanted.where("false"), 2).count() == 0


def test_minhash_large_tables_are_not_sent_whole(spark, monkeypatch):
    """A sketch's values are tens of times as many as classes, whatever Spark makes of the files' size; the same for tables of many rows."""
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.format_string("%d a b %d", "id", F.col("id") % 7).alias("text"))
    classes = bottom_k._kept(bottom_k.sketches(docs).withColumn("uid", F.col("doc_id")), "test", 3_000)
    plan = bottom_k._posting_plan(classes, 0.8, 256)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [value" in plan and "BroadcastHashJoin [value" not in plan
    monkeypatch.setattr(bottom_k, "MOVED", 2_000)
    one = bottom_k._kept(spark.range(3_000).toDF("a"), "test", 3_000)
    assert "BroadcastHashJoin" not in one.join(spark.range(5).toDF("a"), "a")._jdf.queryExecution().executedPlan().toString()
    few = bottom_k._kept(spark.range(5).toDF("a"), "test", 5)
    assert "BroadcastHashJoin" in few.join(spark.range(5_000).toDF("a"), "a")._jdf.queryExecution().executedPlan().toString()
