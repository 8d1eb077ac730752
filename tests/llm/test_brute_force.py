"""Each operator against a brute-force version over the edge rows, and on an empty table."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from anomark.llm import language, lm_score, order_minhash, packing, quality, quotes, repeats, secrets, sentencepiece_scan, simhash
from anomark.llm.common import piece_model, vocabulary
from anomark.session import scratch_path
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(row):
    return tuple((v is None, str(v)) for v in row)


def same(got, expected):
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


# --- Order MinHash


def test_edited_pairs(docs, no_docs, rows):
    s = order_minhash.Sketcher(10, 2, 64)
    got = order_minhash.edited_pairs(docs).collect()
    assert len(got) == len(rows) and order_minhash.edited_pairs(no_docs).count() == 0
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    by_id = {r["doc_id"]: r for r in got}
    for (i, t), (_, u) in zip(known, known[1:]):
        t, u = t or "", u or ""
        e = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        a, b, c = (s.whole(order_minhash.codes_of(x)) for x in (t, e, u))
        r = by_id[i]
        if [j for j, _ in known].count(i) > 1:
            assert r["fingerprint"] == a.hex()
            continue
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a.hex(), b.hex())
        assert r["near_edited"] == order_minhash.likeness(a, b) and r["near_next"] == order_minhash.likeness(a, c)


def test_one_document_is_its_own_next(spark):
    text = "abcdefghij" * 5
    r = order_minhash.edited_pairs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["near_next"] == 1.0
    assert r["edited_sha256"] == hashlib.sha256((text[:34] + text[:16]).encode()).hexdigest()


def test_order_matters():
    s = order_minhash.Sketcher(4, 2, 256)
    parts = [f"<{k:03d} part of a text>" for k in range(40)]
    mixed = parts[:]
    random.Random(1).shuffle(mixed)
    a, b = (s.whole(order_minhash.codes_of("".join(x))) for x in (parts, mixed))
    edited = "".join(parts)[:-20] + "another end of it all"
    c = s.whole(order_minhash.codes_of(edited))
    assert order_minhash.likeness(a, c) > order_minhash.likeness(a, b)


# --- packing


def test_packing(docs, no_docs, rows):
    got = packing.pack_documents(docs, *vocabulary(), group_rows=40).collect()
    assert packing.pack_documents(no_docs, *vocabulary()).count() == 0
    tokenizer = Tokenizer.from_file(vocabulary()[0])
    expected = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 1024):
            part = np.array(ids[at : at + 1024], "<u4")
            expected.append((i, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
    same([tuple(r)[:5] for r in got], expected)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_sum_of_squares_against_brute_force():
    rng = random.Random(3)
    lengths = [rng.randint(1, 20) for _ in range(300)]
    sequence, offset = packing.sum_of_squares(lengths, 20)
    fill: list[int] = []
    for s, q, o in zip(lengths, sequence, offset):
        levels = Counter(f for f in fill if f < 20)

        def cost(h):
            after = levels.copy()
            if h:
                after[h] -= 1
            if h + s < 20:
                after[h + s] += 1
            return sum(n * n for n in after.values())

        options = [h for h in [0, *levels] if levels[h] or h == 0 if h + s <= 20]
        assert cost(o) == min(map(cost, options))
        if q == len(fill):
            fill.append(0)
        assert fill[q] == o
        fill[q] += s


# --- quality


def test_quality_counts(docs, no_docs, rows):
    got = quality.quality(docs).collect()
    assert quality.quality(no_docs).count() == 0
    expected = []
    for i, t in rows:
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
        n = len(words)
        expected.append((i, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
                         n < 50 or 100 * len(covered) > 50 * n))
    same([tuple(r)[:7] for r in got], expected)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_quality_fences(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(100)) + (" $$$" * (40 if k % 50 == 0 else k % 3)), "en", "a") for k in range(300)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r["doc_id"] for r in got if not r["kept"]} == {k for k in range(300) if k % 50 == 0}


# --- repeated strings


def covered_bytes(texts, length):
    count = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                mask[k : k + length] = b"\1" * length
        out.append(mask)
    return out


def test_repeats(docs, no_docs, rows):
    texts = [(t or "").encode() for _, t in rows]
    expected = []
    for (i, _), t, m in zip(rows, texts, covered_bytes(texts, 200)):
        starts = sum(1 for k in range(len(t)) if m[k] and not (k and m[k - 1]))
        expected.append((i, len(t), sum(m), starts, hashlib.sha256(bytes(c for c, x in zip(t, m) if not x)).hexdigest()))
    for limit in (20_000, 1):
        same(repeats.digest(docs, group_limit=limit).collect(), expected)
    assert repeats.digest(no_docs).count() == 0


def test_without_repeats(docs, rows):
    texts = [(t or "").encode() for _, t in rows]
    got = repeats.without_repeats(docs)
    assert got.columns == docs.columns
    expected = []
    for (i, t), raw, m in zip(rows, texts, covered_bytes(texts, 200)):
        parts = [b""]
        for c, x in zip(raw, m):
            if x:
                parts.append(b"")
            else:
                parts[-1] += bytes([c])
        expected.append((i, None if t is None else "".join(p.decode("utf-8", "ignore") for p in parts)))
    same([(r["doc_id"], r["text"]) for r in got.collect()], expected)


def test_suffix_order():
    rng = random.Random(5)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(3000)), np.uint8)
    starts = np.array(rng.sample(range(2900), 700))
    prefix = repeats.hashing().prefixes(data)
    order = repeats.merge_sort(prefix, data, starts, np.zeros(700, np.int64), np.full(700, 700), 60)
    text = data.tobytes()
    assert [text[k : k + 60] for k in order] == sorted(text[k : k + 60] for k in starts)


# --- SimHash


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, distance):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def test_simhash(docs, no_docs, rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    label = components(prints, 3)
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = min([v for v in (least.get(x), i) if v is not None], default=None)
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_components(docs).collect()]
    same(got, [(i, f, least[x]) for (i, _), f, x in zip(rows, prints, label)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(least.values())
    assert simhash.simhash_components(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def test_trie_join_of_any_bucket(spark):
    rng = random.Random(8)
    values = set()
    for _ in range(60):
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            values.add(v)
            for _ in range(rng.randint(1, 4)):
                v ^= 1 << rng.randrange(64)
    values |= {1 << k for k in range(12)} | {0}
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    frame = spark.createDataFrame(signed, "fp long")
    label = components(values, 3)
    want = defaultdict(set)
    for v, x in zip(values, label):
        want[x].add(v)
    for limit in (50_000, 3):
        edges = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.trie_edges(frame, 3, limit).collect()]
        place = {v: k for k, v in enumerate(values)}
        own = list(range(len(values)))
        for a, b in edges:
            old, new = own[place[a]], own[place[b]]
            own = [new if x == old else x for x in own]
        found = defaultdict(set)
        for v, x in zip(values, own):
            found[x].add(v)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


# --- secrets


def brute_secrets(text):
    kinds = [
        ("assign", re.compile(secrets.ASSIGN, re.A), lambda m: len(m.group(2)) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 32),
        ("id", re.compile(secrets.IDENTIFIER, re.A), lambda m: len(m.group(2)) >= 3),
        ("key", re.compile(secrets.RANDOM), lambda m: all(re.search(c, m.group()) for c in ("[0-9]", "[a-z]", "[A-Z]"))),
        ("endpoint", re.compile(secrets.ENDPOINT), lambda m: True),
    ]
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m)]
    ids, keys = ([s for s, k, _ in found if kinds[k][0] in names] for names in (("access", "id"), ("assign", "hex", "key")))

    def near(s, others):
        return any(abs(s - o) <= 256 for o in others)

    def told(s, k):
        name = kinds[k][0]
        return k < 3 or (name == "id" or near(s, ids)) and (name == "key" or near(s, keys))

    return [(s, kinds[k][0], e) for s, k, e in sorted(found) if told(s, k)]


def test_secrets(docs, no_docs, rows):
    expected = []
    for i, t in rows:
        spans = brute_secrets(t)
        base = ",".join(f"{k}:{s}:{e}" for s, k, e in spans if k in ("assign", "access", "hex"))
        n = Counter(k for _, k, _ in spans)
        expected.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, k, e in spans)))
    same(secrets.scan(docs).collect(), expected)
    assert any("key:" in e[5] and "endpoint:" in e[5] for e in expected) and expected[-2][5] == ""
    assert secrets.scan(no_docs).count() == 0


def test_redact(docs, rows):
    got = secrets.redact(docs)
    assert got.columns == docs.columns
    expected = []
    for i, t in rows:
        if t is None:
            expected.append((i, None))
            continue
        out, at = "", 0
        for s, _, e in brute_secrets(t):
            if s > at or (s == at and not (out.endswith("[secret]") and at)):
                out += t[at:s] + "[secret]"
            at = max(at, e)
        expected.append((i, out + t[at:]))
    same([(r["doc_id"], r["text"]) for r in got.collect()], expected)


def test_redact_of_long_secrets(spark):
    """Parts beside a secret longer than the scope, and every line of a key that is broken over many."""
    rng = random.Random(6)
    line = lambda n: "aB1" + "".join(rng.choice("abcXYZ019+/") for _ in range(n - 3))
    lines = "\n".join(line(64) for _ in range(20))
    words = " and" * 80
    mail = [
        (1, f"{line(400)} login: someone", "[secret] [secret]"),
        (2, f"client_id: svc-7\n{lines}\nend", "[secret]\n" + "\n".join(["[secret]"] * 20) + "\nend"),
        (3, f"{lines}\r\nhttps://example.org login: someone", "\n".join(["[secret]"] * 20) + "\r\n[secret] [secret]"),
        (4, f"{line(400)}{words} login: someone", None),
        (5, f"login: someone{words} {lines}", None),
        (6, f"https://example.org {line(400)}{words} login: someone", None),
    ]
    frame = spark.createDataFrame([r[:2] for r in mail], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in secrets.redact(frame).collect()} == {i: t if want is None else want for i, t, want in mail}


# --- SentencePiece


def test_sentencepiece(docs, no_docs, rows):
    v = sentencepiece_scan.vocabulary(piece_model())
    expected = []
    for i, t in rows:
        score, ids = sentencepiece_scan.sequential(v, sentencepiece_scan.marked(t or "")) if t else (0, b"")
        expected.append((i, score, ids, t or ""))
    for chunk in (50, 1 << 15):
        got = sentencepiece_scan.encode_documents(docs, piece_model(), chunk).collect()
        same([(r["doc_id"], r["score"], bytes(r["ids"]), r["decoded"]) for r in got], expected)
    assert sentencepiece_scan.encode_documents(no_docs, piece_model()).count() == 0


# --- LM scoring


def test_cross_entropy_difference(spark, docs, no_docs, rows):
    good = spark.createDataFrame([(1,), (6,), (6,), (None,), (77,)], "doc_id long")
    got = lm_score.cross_entropy_difference(docs, good, vocabulary=50).collect()
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    often = Counter(w for _, ws in texts for w in ws)
    least = next(c for c in range(1, 10**6) if sum(n >= c for n in often.values()) <= 50)
    ids = {w: k + 2 for k, (w, n) in enumerate(sorted(often.items(), key=lambda x: (-x[1], x[0]))) if n >= least}
    assert 0 < len(ids) <= 50
    size = len(ids) + 2
    seqs = [(i, [0, *(ids.get(w, 1) for w in ws)]) for i, ws in texts]

    def model(chosen):
        one, two = Counter(), Counter()
        for s in chosen:
            if len(s) > 1:
                one.update(s)
                two.update(lm_score.buckets(np.array(s)).tolist())
        total = sum(n for w, n in one.items() if w)

        def loss(s):
            out = []
            for a, b, h in zip(s, s[1:], lm_score.buckets(np.array(s)).tolist()):
                share = min(two[h], one[a]) / max(one[a], 1)
                out.append(-np.log(0.5 * share + 0.5 * (one[b] + 1) / (total + size)))
            return np.mean(out)

        return loss

    target, background = model([s for i, s in seqs if i in (1, 6)]), model([s for _, s in seqs])
    expected = [(i, len(s) - 1, target(s) if len(s) > 1 else None, background(s) if len(s) > 1 else None) for i, s in seqs]
    round_ = lambda r: (*r[:2], *(None if x is None else round(float(x), 9) for x in r[2:4]))
    same([round_(tuple(r)) for r in got], [round_(e) for e in expected])
    assert lm_score.cross_entropy_difference(no_docs, good).count() == 0


def test_pairs_are_counted_exactly(spark):
    """More distinct pairs than any fixed table of 2^18 counts tells apart."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(4000)) for _ in range(100)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(frame, frame.where("doc_id < 10").select("doc_id")).collect()}
    often = Counter(w for t in texts for w in t.split())
    for name, chosen in (("background_loss", texts), ("target_loss", texts[:10])):
        one, two = Counter(), Counter()
        for t in chosen:
            s = ["", *t.split()]
            one.update(s)
            two.update(zip(s, s[1:]))
        total = sum(n for w, n in one.items() if w)
        for i, t in enumerate(texts[:20]):
            s = ["", *t.split()]
            want = np.mean([-np.log(0.5 * two[a, b] / max(one[a], 1) + 0.5 * (one[b] + 1) / (total + len(often) + 2)) for a, b in zip(s, s[1:])])
            assert abs(got[i][name] - want) < 1e-9


def test_every_word_is_its_own(spark):
    """More distinct words than 65,536, all of one count, and a word of a megabyte."""
    texts = [" ".join(f"w{k}" for k in range(n, n + 1000)) for n in range(0, 70_000, 1000)] + ["x" * (1 << 20), "x" * (1 << 20) + "y"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = lm_score.cross_entropy_difference(frame, frame.where("doc_id = 0").select("doc_id")).collect()
    size = 70_002 + 2
    unigram = {0: 2 / (70_002 + size), 1: 2 / (1000 + size)}
    first = {0: 1 / 72, 1: 1}
    for r in got:
        background = [first[0], *[1] * 999][: r["n_tokens"]]
        assert r["n_tokens"] == (1000 if r["doc_id"] < 70 else 1)
        assert abs(r["background_loss"] - np.mean([-np.log(0.5 * x + 0.5 * unigram[0]) for x in background])) < 1e-9
        seen = r["doc_id"] == 0
        target = -np.log(0.5 * seen + 0.5 * (unigram[1] if seen else 1 / (1000 + size)))
        assert abs(r["target_loss"] - target) < 1e-9


# --- language


def test_language(spark, docs, no_docs, rows):
    found = language.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).where("held_out")
    right = found.where("lang = lang_pred").count() / found.count()
    assert right >= 0.95
    by = {}
    for r in language.identify(docs).collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, by.values())) == len(rows)
    for i, t in rows:
        und = not t or not any(c.isalpha() for c in t)
        assert all((r["lang_pred"] == "und") == und for r in by[i]) or i is None
        assert all(0 <= r["score"] <= 1 for r in by[i])
        assert all(r["held_out"] == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) for r in by[i])
    assert language.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang IS NULL")).collect()} == {"und"}


def test_accepted_texts_of_many_languages(spark):
    """A text of six languages in turn, and languages that no model tells apart, stay; a table without labels keeps its texts."""
    rng = random.Random(9)
    letters = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    said = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(n))
    labelled = [(i, said(i % 6, 80), f"l{i % 6}") for i in range(240)]
    mixed = [(1000 + i, " ".join(said(k, 64) for k in range(6)), None) for i in range(5)]
    alike = [(2000 + i, said(0, 80), f"same{i % 8}") for i in range(400)]
    kinds = "doc_id long, text string, lang string"
    for rows in (labelled + mixed, labelled + alike):
        got = {r["doc_id"] for r in language.accepted(spark.createDataFrame([*rows, (9999, "123 456", None)], kinds)).collect()}
        assert got == {i for i, _, _ in rows}
    bare = spark.createDataFrame([(i, t, None) for i, t, _ in mixed] + [(9999, "123 456", None), (9998, None, None)], kinds)
    assert {r["doc_id"] for r in language.accepted(bare).collect()} == {i for i, _, _ in mixed}


def test_language_pairs_equal_plain_convolution():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    m = language.train(x, np.arange(40) % 3, ["a", "b", "c"], widths=(2, 3, 5), filters=4, steps=5)
    pooled = np.concatenate([language.responses(x, f).max(axis=1) for f in m.filters], axis=1)
    want = language.softmax(np.maximum(pooled + m.bias, 0) @ m.out + m.out_bias)
    np.testing.assert_allclose(language.Predictor(m).probabilities(x), want, rtol=1e-4)


# --- quotes


def test_passages():
    text = "> > deep\n>> deep two\n> one\n> more\n\nmine\nstill mine\n\nlast"
    assert quotes.passages(text) == [(2, "deep\ndeep two"), (1, "one\nmore"), (0, "mine\nstill mine"), (0, "last")]


def test_conversations(spark):
    mail = [
        (1, "First message\nwith two lines"),
        (2, "> first   MESSAGE\n> with two lines\n\nSecond"),
        (3, ">> First message\n>> with two lines\n\n> Second\n\nThird"),
        (4, ">> First message\n>> with two lines\n\nFourth"),
        (5, "> nobody said this\n\nFifth"),
        (6, "> Third\n> \n> Fifth is longer\n\nSixth"),
        (6, "> Third\n> \n> Fifth is longer\n\nSixth"),
        (7, None),
        (8, ""),
        (9, "> Ninth\n\nNinth"),
        (None, "> Third"),
    ]
    frame = spark.createDataFrame([(*r, "x", "y") for r in mail], "msg_id long, text string, hash string, root string")
    got = {r["msg_id"]: tuple(r) for r in quotes.conversations(frame).collect()}
    assert got == {
        1: (1, 0, 1, None, 0, "First message\nwith two lines"),
        2: (1, 1, 2, 1, 1, "Second"),
        3: (1, 2, 3, 2, 2, "Third"),
        4: (1, 1, 4, 1, 1, "Fourth"),
        5: (5, 0, 5, None, 1, "Fifth"),
        6: (1, 3, 6, 3, 2, "Sixth"),
        7: (7, 0, 7, None, 0, ""),
        8: (8, 0, 8, None, 0, ""),
        9: (9, 0, 9, None, 1, "Ninth"),
    }
    assert quotes.conversations(frame.where("false")).count() == 0


def test_every_earlier_holder_may_be_the_original(spark):
    """A common passage links within its own conversation; a copied conversation stays one of its own."""
    talk = ["Hello all", "> Hello all\n\nA question", ">> Hello all\n\n> A question\n\nThanks", ">> A question\n\n> Thanks\n\nDone"]
    mail = [
        *enumerate(talk, 1),
        (11, "Thanks"),
        (12, "> Thanks\n\nFor what?"),
        *enumerate(talk, 21),
        # two conversations with turns in between: the other level, then the rarer passage, tell them apart
        (31, "Offer one"),
        (32, "Offer two"),
        (33, "> Offer one\n\nThanks\n\nAs ever"),
        (34, "> Offer two\n\nThanks"),
        (35, ">> Offer one\n\n> Thanks\n\nWelcome"),
        (36, "> Thanks\n> \n> As ever\n\nFine"),
    ]
    frame = spark.createDataFrame(mail, "msg_id long, text string").repartition(3)
    got = {r["msg_id"]: (r["parent"], r["conversation"], r["depth"]) for r in quotes.conversations(frame).collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == [(None, 1, 0), (1, 1, 1), (2, 1, 2), (3, 1, 3)]
    assert [got[k] for k in (11, 12)] == [(None, 11, 0), (11, 11, 1)]
    assert [got[k] for k in (21, 22, 23, 24)] == [(None, 21, 0), (21, 21, 1), (22, 21, 2), (23, 21, 3)]
    assert [got[k][0] for k in (33, 34, 35, 36)] == [31, 32, 33, 33]


def test_nearest_holder_of_a_frequent_passage(spark):
    """A passage that a third of all messages hold is cut into ranges; each quote finds the holder just before it."""
    mail = [(3 * k + j, t) for k in range(400) for j, t in enumerate(("Thanks", f"> Thanks\n\nreply {k}", f"> reply {k}\n\nend {k}"))]
    frame = spark.createDataFrame(mail, "msg_id long, text string").repartition(5)
    got = quotes.conversations(frame).collect()
    assert all((r["conversation"], r["depth"]) == (r["msg_id"] // 3 * 3, r["msg_id"] % 3) for r in got) and len(got) == 1200


def test_quoted_mail_round_trip(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = quotes.conversations(quotes.quoted_mail(turns))
    assert got.where("depth > 0").count() > 0
    assert got.where("parent >= msg_id").count() == 0
    lost = got.join(turns.selectExpr("conv_id * 1000000 + turn AS msg_id", "text AS said"), "msg_id")
    assert lost.where("trim(both '\n' from text) <> trim(both '\n' from regexp_replace(said, '\n\\s*\n', '\n\n'))").count() == 0


def test_quoted_mail_loses_no_turn(spark):
    """Turn values from a million up, and differing and repeated rows of one turn."""
    rows = [(0, 0, "a"), (0, 1_000_000, "b"), (0, 1_000_001, "b2"), (1, 0, "c"), (1, 0, "d"), (1, 0, "d"), (1, 1, "e"), (1, 1, None), (None, 1, "x")]
    mail = quotes.quoted_mail(spark.createDataFrame(rows, "conv_id long, turn int, text string"))
    got = quotes.conversations(mail).collect()
    assert sorted((r["msg_id"], r["text"]) for r in got) == [
        (0, "a"), (1, "b"), (2, "b2"), (1_000_000, "c"), (1_000_001, "d"), (1_000_002, ""), (1_000_003, "e"),
    ]
    assert {r["msg_id"]: r["parent"] for r in got}[2] == 1
    assert quotes.quoted_mail(spark.createDataFrame([], "conv_id long, turn int, text string")).count() == 0


# --- cases of earlier operators


def test_texts_of_numerals_are_undetermined(spark):
    rows = [(k, "ni hao shi jie" if k % 2 else "hello there world", "zh" if k % 2 else "en") for k in range(1, 60)]
    odd = [(100, "½ ² ①", None), (101, "Ⅷ ٣ 42 ___", None), (102, "5 µ", None), (103, None, None), (104, "", None)]
    table = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(table).collect()}
    assert [got[i] for i, *_ in odd] == ["und", "und", got[102], "und", "und"] and got[102] in ("en", "zh")


def test_quoted_mail_of_any_conversation_id(spark):
    rows = [("b", 0, "one"), ("b", 1, "two"), ("a", 0, "three")]
    for ids, kind in (({"a": 10**13, "b": 2**62}, "long"), ({"a": "x", "b": "y"}, "string"), ({"a": -(2**63), "b": 5}, "long")):
        table = spark.createDataFrame([(ids[c], t, x) for c, t, x in rows], f"conv_id {kind}, turn int, text string")
        got = quotes.conversations(quotes.quoted_mail(table)).collect()
        assert sorted((r["msg_id"], r["text"], r["parent"]) for r in got) == [(0, "three", None), (1, "one", None), (2, "two", 1)]


def test_equal_rows_are_spread_over_packers(spark):
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    parts = spark.createDataFrame([(1, 0, 700, 5, 700)] * 2000, schema).repartition(4)
    path = scratch_path(spark, "equal-parts")
    parts.write.parquet(path)
    got = packing.packed(spark.read.parquet(path), 1024, group_rows=100)
    groups = [r["count"] for r in got.groupBy((got["sequence_id"] % 20).alias("g")).count().collect()]
    assert len(groups) == 20 and max(groups) <= 130
    assert got.select("sequence_id").distinct().count() == 2000


def test_repeats_of_repeated_rows(spark):
    """Each span of a repeated row is cut once, and no length is taken that a run's place cannot hold."""
    text = prose(3, 200)
    table = spark.createDataFrame([(1, text)] * 200 + [(2, prose(4, 100) + text[100:600]), (3, "x" * 500)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repeats.digest(table).collect()}
    size = len(text.encode())
    assert (got[1]["n_removed"], got[1]["n_spans"]) == (size, 1) and got[2]["n_spans"] == 1 and got[3]["n_removed"] == 500
    with pytest.raises(ValueError):
        repeats.digest(table, length=300)
