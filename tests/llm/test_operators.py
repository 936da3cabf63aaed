"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated
rows and extra columns, and on empty tables."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from letterloom.llm import common, dartminhash, langid, mixing, multi_index, packing, pii, quality, radix_dedup, recompression, toxicity
from letterloom.llm.bytetext import Hasher
from letterloom.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, id string, node string, size long, digit string"
WORDS = [f"w{i}{c}" for i in range(40) for c in "abc"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed=1):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += [texts[0], texts[0].upper(), texts[1] + " tail", texts[2][:200], "", None, None, "é " * 30, "a " * 60, "a " * 100, prose(rng, 5000), texts[3] + "\n\t" + texts[4]]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None, "é"]), "x", "y", 7, "z") for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, texts[0], "en", None, "x", "y", 7, "z"), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)] + [(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_exact_dedup(docs):
    got = radix_dedup.exact_dedup(docs).collect()
    rows = documents()
    groups = {}
    for r in rows:
        groups.setdefault(lower(r[1]), []).append(r[0])
    want = sorted((repr(r[0]), repr(max((x for x in groups[lower(r[1])] if x is not None), default=None)), len(groups[lower(r[1])]), hashlib.sha256(lower(r[1]).encode()).hexdigest()) for r in rows)
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = radix_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_dedup_with_full_bits(docs, monkeypatch):
    monkeypatch.setattr(radix_dedup, "_repeated", lambda heads: np.full((1 << radix_dedup.SPOT_BITS) // 8, 255, np.uint8))
    every = {tuple(r) for r in radix_dedup.exact_dedup(docs).collect()}
    monkeypatch.undo()
    monkeypatch.setattr(radix_dedup, "SPOT_BITS", 15)
    assert every == {tuple(r) for r in radix_dedup.exact_dedup(docs).collect()}


def test_substring_dedup(docs):
    got = {(r.doc_id, r.n_words): r for r in recompression.substring_dedup(docs).collect()}
    rows = sorted({(r[0], r[1]) for r in documents()}, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    seen, gone = {}, {}
    for k, (i, text) in enumerate(rows):
        w = words(text)
        for s in range(len(w) - 19):
            seen.setdefault(tuple(w[s : s + 20]), []).append((-1 if i is None else i, s, k))
    for places in seen.values():
        first = min(p[:2] for p in places)
        for i, s, k in places:
            if (i, s) > first:
                gone.setdefault(k, set()).update(range(s, s + 20))
    for k, (i, text) in enumerate(rows):
        w = words(text)
        kept = " ".join(x for p, x in enumerate(w) if p not in gone.get(k, ()))
        r = got[(i, len(w))]
        assert (r.n_removed, r.kept_text, r.kept_sha256) == (len(gone.get(k, ())), kept, hashlib.sha256(kept.encode()).hexdigest())


def test_equal_windows_have_equal_anchors():
    rng, h = random.Random(3), Hasher()
    shared = [rng.choice("abcde") for _ in range(20)]
    import pyarrow as pa

    texts = [" ".join([rng.choice("abcdexyz") for _ in range(rng.randint(0, 9))] + shared + [rng.choice("abcdexyz") for _ in range(9)]) for _ in range(40)]
    w = recompression._windows(h, pa.RecordBatch.from_pydict({"text": texts}), 20)
    by = {}
    for first, row, anchor in zip(w["first"], w["row"], w["anchor"], strict=True):
        at = first - w["of"][row]
        by.setdefault(tuple(texts[row].split()[at : at + 20]), set()).add(int(anchor))
    assert all(len(x) == 1 for x in by.values())


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    weight = rng.integers(1, 4, 400).astype(float)
    other = np.where(rng.random(400) < 0.8, weight, 0.5)
    sig = dartminhash.dart_minhash(np.repeat([0, 1], 400), np.tile(a, 2), np.concatenate([weight, other]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(weight, other).sum() / np.maximum(weight, other).sum()) < 0.04


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = [words(prose(rng, 200)) for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base[:6]:
        for k in range(4):
            c = list(b)
            for j in range(1 + k):
                c[20 + 40 * j] = f"new{k}{j}"
            texts.append(" ".join(c))
    texts += [texts[0], None, "", "two words", "two words"]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1)], "doc_id long, text string, node string, weight int")
    got = dartminhash.near_duplicates(rows).collect()

    def bag(t):
        w = words(t)
        s = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
        return {x: s.count(x) for x in s}

    bags = [bag(t) for t in texts]
    least = list(range(len(texts)))
    for _ in range(len(texts)):
        for i, a in enumerate(bags):
            for j, b in enumerate(bags):
                both = sum(min(a[x], b.get(x, 0)) for x in a)
                if a and b and both / (sum(a.values()) + sum(b.values()) - both) >= 0.8:
                    least[i] = least[j] = min(least[i], least[j])
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(least))
    assert sum(r.kept for r in got) == len(set(least))
    assert dartminhash.drop_near_copies(rows).count() == len(set(least))


def test_mixing(docs):
    got = mixing.mix_sources(docs, payload=["source"]).collect()
    again = mixing.mix_sources(docs, payload=["source"]).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == docs.count()
    sizes = {}
    for r in got:
        sizes[r.payload.source] = sizes.get(r.payload.source, 0) + r.size
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not above:
            break
        for s in above:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= above
    target |= {s: weight[s] * level for s in open_}
    for s in order:
        mine = [r for r in got if r.payload.source == s]
        assert mine[0].source_size == sizes[s] and math.isclose(mine[0].target, target[s], rel_tol=1e-9)
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(r.size for r in mine) / 2 + 1e-6
        assert all(r.taken in (0, r.size, 2 * r.size) for r in mine)


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(docs, tokenizer_path(), most=256, with_ids=True).collect()
    bins, pieces = {}, {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.ids))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    total = 0
    for i, text, *_ in documents():
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        if i not in (0, None):
            assert [x for _, _, p in sorted(pieces[i]) for x in p] == ids
    assert len(bins) <= -(-total // 256) + 1


@pytest.mark.parametrize("seed", range(5))
def test_packing_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    count = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(rng.randint(1, 40))}
    used, fill = {}, {}
    for length, first, number, sequence, offset in packing.plan_packing(count, 64):
        assert first == used.get(length, 0)
        used[length] = first + number
        for s in range(sequence, sequence + number):
            fill.setdefault(s, []).append((offset, length))
    assert used == count
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_word_tokens_equal_whole_texts():
    import pyarrow as pa

    w = packing.WordTokens(tokenizer_path())
    texts = ["don't it's 'S we've,x", "12,345 a1b2", "<|endoftext|> a", "é—x ,—, naïve ×÷ İstanbul", "日本 «x»", "\x01a\x02", "", "   ", "a,,,b!!c ---", "x y \u0085q", "a</w>|b"]
    ids, at = w.ids(pa.array(texts))
    for i, x in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == w.tokenizer.encode(x, add_special_tokens=False).ids


def test_search_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (None, x[0].tolist()), (5001, None), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0]), (5005, [None] + [1.0] * 15)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = multi_index.search(table, F.col("id") % 20 == 0, centroids=16, share=0.45).collect()
    d, hits, n = x.astype(float), 0, 0
    for q in range(0, 3000, 20):
        score = np.zeros(3000)
        for k in range(16):
            score += d[q, k] * d[:, k]
        order = [i for i in np.lexsort((np.arange(3000), -score)) if i != q][:20]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(score[i] == s for _, i, s in mine)
        hits, n = hits + len({m[1] for m in mine} & set(order)), n + 20
    assert hits / n >= 0.9
    tiny = multi_index.search(table.where("vec_id < 3"), F.col("id") == 0).collect()
    assert [r.rank for r in tiny] == [1, 2]
    assert multi_index.search(table.limit(0), F.col("id") == 0).count() == 0


def test_share_to_visit_follows_the_structure_of_the_vectors():
    rng = np.random.default_rng(3)
    loose = rng.normal(size=(4000, 16))
    tight = rng.normal(size=(50, 16)).repeat(80, axis=0) + 0.05 * loose
    tight = tight[rng.permutation(4000)] / np.linalg.norm(tight, axis=1).mean()
    shares = []
    for x in (tight, loose):
        index = multi_index.MultiIndex(multi_index.k_means(x[:, :8], 32), multi_index.k_means(x[:, 8:], 32))
        shares.append(multi_index.share_to_visit(index, x, 20, 0.94))
    assert shares[0] < 0.15 < shares[1] < 1


def test_mixing_comes_near_targets_of_few_documents(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(n), f"s{i % 5}") for i, n in enumerate(rng.lognormal(4, 1.2, size=300))]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), payload=["source"]).collect()
    for s in {r.payload.source for r in got}:
        mine = [r for r in got if r.payload.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.01 * mine[0].target
        assert all(r.taken in (0, r.size, 2 * r.size) for r in mine)


def test_pii(spark):
    texts = ["mail a.b@c.de, ip 10.0.0.255 1.2.3.256 card 4111 1111 1111 1111 or 4111111111111112", "call +1 (555) 123-4567 +12", "IBAN GB82 WEST 1234 5698 7654 32 é DE00123", "1 " * 3000 + "x@y.zz@q.rr", "", None]
    got = {r.doc_id: r for r in pii.pii_digest(spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, kind string")).collect()}
    for i, t in enumerate(texts):
        spans = []
        for kind in pii.KINDS[:4]:
            for m in re.finditer(kind.plain, t or ""):
                digits = re.sub("[^0-9]", "", m[0])
                luhn = sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))) % 10 == 0
                good = {"email": True, "ip": kind.name == "ip" and all(int(p) < 256 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}
                if good[kind.name]:
                    spans.append(f"{kind.name}:{m.start()}:{m.end()}")
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert got[i].spans.startswith(",".join(spans))
    assert "iban:5:32" in got[2].spans and got[1].n_phone == 1


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, name):
    from tests.test_queries import compared

    compared(spark, name, QUERIES, ORACLE_SQL)


def thue_morse(n=10):
    """Two words that polynomial hashes modulo 2**64 can't tell apart."""
    a = "a"
    for _ in range(n):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_contents_that_fool_polynomial_hashes(spark):
    import pyarrow as pa

    one, two = thue_morse()
    w = packing.WordTokens(tokenizer_path())
    for _ in range(2):
        ids, at = w.ids(pa.array([one, two, f"x {two} {one}"]))
        for i, x in enumerate([one, two, f"x {two} {one}"]):
            assert ids[at[i] : at[i + 1]].tolist() == w.tokenizer.encode(x, add_special_tokens=False).ids
    before, behind = prose(random.Random(8), 30), prose(random.Random(9), 30)
    rows = spark.createDataFrame([(1, f"{before} {one} {behind}"), (2, f"{before} {two} {behind}"), (3, one), (4, two)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in recompression.substring_dedup(rows.where("doc_id < 3")).collect()}
    assert got == {1: 0, 2: 60}
    classes = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(rows.where("doc_id > 2")).collect()}
    assert classes == {3: 3, 4: 4}


def test_units_with_equal_hashes_are_told_apart():
    import pyarrow as pa

    w = packing.WordTokens(tokenizer_path())
    w.h.word_hashes = lambda data, starts, ends: ((ends - starts) % 3).astype(np.uint64)
    texts = ["the quick brown fox, don't 12,3 a1b2", "jumps (over) the lazy dog's!! bone"]
    for _ in range(2):
        ids, at = w.ids(pa.array(texts))
        for i, x in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == w.tokenizer.encode(x, add_special_tokens=False).ids


def test_a_filling_whose_counts_do_not_allow_it_is_passed_over():
    runs = packing.plan_packing({3000: 1, 500: 1, 400: 5, 348: 5, 96: 3}, 4096)
    assert [r[0] for r in runs[:4]] == [3000, 400, 348, 348]


def test_hot_anchors_change_nothing(spark, monkeypatch):
    rng = random.Random(11)
    common = prose(rng, 12)
    rows = spark.createDataFrame([(i, f"{prose(rng, 15)} {common} {prose(random.Random(i % 7), 30)}") for i in range(400)], "doc_id long, text string")
    plain = sorted(map(repr, recompression.substring_dedup(rows).collect()))
    monkeypatch.setattr(recompression, "HOT_SAMPLE", 1)
    found = []
    real = recompression._hot_anchors
    monkeypatch.setattr(recompression, "_hot_anchors", lambda rows, size, parts: found.append(real(rows, size, 50)) or found[-1])
    assert sorted(map(repr, recompression.substring_dedup(rows).collect())) == plain and len(found[0])


def test_pii_takes_time_in_proportion(spark):
    import time

    took = []
    for n in (20_000, 20_000, 80_000):
        rows = spark.createDataFrame([(None, "ab@cd.efg, " * n), (7, "1." * 4 * n), (7, "1." * 4 * n)], "doc_id long, text string").repartition(1)
        start = time.time()
        got = pii.pii_digest(rows).collect()
        took.append(time.time() - start)
        assert sorted((repr(r.doc_id), r.n_email, r.n_ip) for r in got) == [("7", 0, n), ("7", 0, n), ("None", n, 0)]
    assert took[2] < 12 * max(took[1], 0.5)


def test_near_duplicates_of_documents_against_brute_force(spark):
    from collections import Counter, defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(docs).collect()}
    bags, where = {}, defaultdict(list)
    for r in docs.collect():
        w = words(r.text)
        bags[r.doc_id] = Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()
        for x in bags[r.doc_id]:
            where[x].append(r.doc_id)
    parent = {i: i for i in bags}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in {(min(p), max(p)) for ids in where.values() for k, x in enumerate(ids) for p in ((x, y) for y in ids[:k])}:
        both = sum((bags[a] & bags[b]).values())
        if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {i: top(i) for i in bags}


def test_hot_groups_are_dealt_out(spark):
    from letterloom.llm.common import join_groups

    rows = spark.range(2000).select(F.col("id").alias("rid"), F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, F.col("id")).alias("k"))
    groups = rows.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = join_groups(rows, groups, "k", how="left")
    assert out.count() == 2000 and {(r.k, r.n) for r in out.where("k = 1 OR k IS NULL").collect()} == {(1, 668), (None, None)}


def test_queries_are_dealt_out_and_near_cells_share_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 8)).repeat(100, axis=0) + 0.05 * rng.normal(size=(4000, 8))
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, cell int")
    got = multi_index.search(table, F.col("id") % 20 == 0, with_scored=True)
    assert got.groupBy("query_id").agg(F.max("scored").alias("n")).agg(F.avg("n")).first()[0] < 0.5 * 4000
    asked = got.select("query_id").distinct().repartition(4, F.xxhash64("query_id"))
    assert asked.rdd.getNumPartitions() == 4 and asked.count() == 200
    # all alike: ties go to the smaller ids
    same = multi_index.search(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)], "vec_id long, embedding array<double>"), F.col("id") == 40).collect()
    assert [r.vec_id for r in sorted(same, key=lambda r: r.rank)] == list(range(20))


def test_site_posteriors_against_plain_python_and_their_gain(spark):
    rng = random.Random(6)
    rows, known = [], []
    for i in range(1500):
        host = i % 30
        good = rng.random() < (0.9 if host < 15 else 0.1)
        # texts alone say little
        rows.append((i, f"{prose(rng, 20)} {'fine' if rng.random() < (0.55 if good else 0.45) else 'poor!!'}", f"h{host}", f"h{host}/{i % 2}"))
        known.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame(known, "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    got = {r.doc_id: r for r in quality.score_quality(docs, labels, model, F.col("host"), F.col("path")).collect()}
    held = [i for i in got if got[i].held_out]
    right = lambda f: sum((f(i) > 0.5) == (known[i][1] == 1) for i in held) / len(held)
    alone = lambda i: 1 / (1 + math.exp(-(got[i].evidence + math.log(model.prior / (1 - model.prior)))))
    assert right(lambda i: got[i].score) > 0.85 > 0.7 > right(alone)
    weight = {i: 0.25 if got[i].held_out else 1.0 for i in got}
    value = {i: alone(i) if got[i].held_out else float(known[i][1]) for i in got}
    n, k = sum(weight.values()), sum(weight[i] * value[i] for i in got)
    prior = (k + 1) / (n + 2)

    def strength(of):
        groups = {}
        for i in got:
            g = groups.setdefault(of(i), [0.0, 0.0])
            g[0], g[1] = g[0] + weight[i], g[1] + weight[i] * value[i]
        g = np.array(list(groups.values()))
        noise = prior * (1 - prior)
        spread = (((g[:, 1] / g[:, 0] - prior) ** 2 * g[:, 0]).sum() - noise * (len(g) - 1)) / (g[:, 0].sum() - (g[:, 0] ** 2).sum() / g[:, 0].sum())
        return groups, min(max(noise / spread - 1, 2.0), 1000.0)

    hosts, m_host = strength(lambda i: rows[i][2])
    paths, m_path = strength(lambda i: rows[i][3])
    for i in (0, 7, 100, 1499):
        without = lambda g: (g[0] - weight[i], g[1] - weight[i] * value[i])  # noqa: B023, E731
        hn, hk = without(hosts[rows[i][2]])
        host = (hk + m_host * prior) / (hn + m_host)
        pn, pk = without(paths[rows[i][3]])
        assert math.isclose(got[i].host_posterior, host, rel_tol=1e-6)
        assert math.isclose(got[i].path_posterior, (pk + m_path * host) / (pn + m_path), rel_tol=1e-6)


def test_language_model_against_plain_python(spark):
    texts = [("en", "the dog and the cat"), ("de", "der Hund und die Katze über"), ("ru", "собака и кошка"), ("en", "a dog")]
    rows = [(i, t, y) for i, (y, t) in enumerate(texts * 3)] + [(100, "hund собаки", None), (101, "кошкин", None), (102, "123", None), (103, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs)
    learned = [(y, t.lower()) for i, t, y in rows if y and zlib.crc32(str(i).encode()) % 4 != 2]
    langs = sorted({y for y, _ in learned})
    assert list(model.languages) == langs
    counts = [{} for _ in range(6)]
    for y, t in learned:
        for w in t.split():
            for s in range(6):
                m = f"\x02{w}\x03"
                for g in [w] if s == 0 else [m[j : j + s] for j in range(len(m) - s + 1)]:
                    counts[s].setdefault(g, dict.fromkeys(langs, 0))[y] += 1

    def logs(s, g):
        whole = {y: sum(c[y] for c in counts[s].values()) + 0.5 * len(counts[s]) + 1 for y in langs}
        return np.array([math.log((counts[s][g][y] + 0.5) / whole[y]) for y in langs])

    def score(text):
        total = np.zeros(len(langs))
        for w in re.findall(r"[a-z\u0080-\U0010ffff]+", text.lower()):
            if w in counts[0]:
                total += logs(0, w)
                continue
            m, found = f"\x02{w}\x03", []
            for j in range(len(m)):
                s = next((s for s in range(5, 0, -1) if j + s <= len(m) and m[j : j + s] in counts[s]), 0)
                found += [logs(s, m[j : j + s])] if s else []
            total += sum(found) / max(len(found), 1)
        return total

    for r in langid.identify_languages(docs, model).collect():
        text = {i: t for i, t, _ in rows}[r.doc_id]
        if text is None or text == "123":
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        want = score(text)
        assert r.lang_pred == langs[int(want.argmax())]
        assert math.isclose(r.score, 1 / np.exp(want - want.max()).sum(), rel_tol=1e-6)


def test_toxicity_ratios_against_plain_python(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, 8) + (" nasty thing" if i % 4 == 0 else " kind Thing")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    learned = [(t.lower(), i % 4 == 0) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    count = {}
    for t, y in learned:
        for g in {t[j : j + s] for s in (3, 4, 5, 6) for j in range(len(t) - s + 1)}:
            c = count.setdefault(g, [0, 0])
            c[y] += 1
    n1 = sum(y for _, y in learned)
    worth = {g: abs(math.log((b + 1) / (n1 + 2)) - math.log((a + 1) / (len(learned) - n1 + 2))) * math.sqrt(a + b) for g, (a, b) in count.items() if a + b >= 5}
    model = toxicity.fit_toxicity(docs, labels, features=10**6)
    assert len(model.gram) == len(worth)
    few = toxicity.fit_toxicity(docs, labels, features=20)
    h = Hasher()
    from letterloom.llm.bytetext import BYTE_P

    def name(g):
        data = np.frombuffer(g.encode(), np.uint8)
        p = h.prefix(h.of_byte[data], BYTE_P)
        return int(h.spans(p, np.array([0]), np.array([len(data)]), BYTE_P)[0])

    least = sorted(worth.values())[-20]
    chosen = {name(g) for g, v in worth.items() if v >= least - 1e-12}
    assert set(few.gram.tolist()) <= chosen


def test_inclusion_is_unbiased(spark):
    """300 sources alike: what each place in a source is taken as often as its share says."""
    sizes = [3, 5, 8, 13, 40, 7, 7, 22]
    rows = [(k * 100 + j, "w " * n, f"s{k:04d}") for k in range(300) for j, n in enumerate(sizes)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,)).collect()
    for j in range(len(sizes)):
        mean = sum(r.copies for r in got if r.doc_id % 100 == j) / 300
        assert abs(mean - 1.5) < 0.15


def test_learned_operators_on_hard_rows(spark, docs, labels):
    n = docs.count()
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert len(scored) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    langs = langid.identify_languages(docs, langid.fit_languages(docs)).collect()
    assert len(langs) == n and {r.lang_pred for r in langs} <= {"en", "fr", "und"}
    good = quality.score_quality(docs, labels, quality.fit_quality(docs, labels), F.col("source"), F.col("lang")).collect()
    assert len(good) == n and all(0 <= r.score <= 1 for r in good)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 4 == 2) for r in langs)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    langs = QUERIES["op3_word_first_language"](spark, sf).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert langs.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    toxic = QUERIES["op5_nb_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").where("toxic IS NOT NULL").select("toxic", "predicted", "score").toPandas()
    hits = int((toxic.toxic * toxic.predicted).sum())
    assert hits / toxic.predicted.sum() > 0.9 and hits / toxic.toxic.sum() > 0.8
    rank, ones = toxic.score.rank(), int(toxic.toxic.sum())
    assert (rank[toxic.toxic == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(toxic) - ones)) > 0.95


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("case", ["none", "hard"])
def test_pipeline_on_hard_rows(spark, tmp_path, case, docs, labels):
    """Nulls in every column, repeated rows, empty and long texts, clashing names; and no rows at all."""
    import corpus_pipeline as c

    some = docs if case == "hard" else docs.limit(0)
    some.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = c.read(spark, str(tmp_path), "documents")
    for _, stage in c.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    packed = c.run(spark, str(tmp_path))
    assert (packed.count() > 0) == (case == "hard") and packed.where("piece = 0").count() == now.count()


def test_pipeline_keeps_what_it_should(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = c.read(spark, sf, "documents")
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns
        if name != "mixing":
            assert out.exceptAll(docs).count() == 0
        docs = out
    assert docs.groupBy("text").count().where("count > 2").count() == 0
    assert c.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_a_worker_tokenizes_a_word_once(monkeypatch):
    import pyarrow as pa
    from pyspark import TaskContext

    class Task:
        def partitionId(self):
            return 0

    monkeypatch.setattr(TaskContext, "get", lambda: Task())
    sent, real = [], packing.WordTokens.encode
    monkeypatch.setattr(packing.WordTokens, "encode", lambda self, *units: sent.append(units) or real(self, *units))
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "text": ["onceonly, seenbefore 4.5", None, "seenbefore onceonly!"]})
    task = lambda: [r for b in packing._tokenize(tokenizer_path(), 4, True)(iter([batch])) for r in b.to_pylist()]
    first, n = task(), len(sent)
    assert n and task() == first and len(sent) == n


def test_units_are_found_again_as_the_table_grows_and_is_forgotten(monkeypatch):
    import pyarrow as pa

    rng = random.Random(12)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(6, 9))) for _ in range(60_000)] + ["x" * 90 + c for c in "ab"] + [f"{i}'s" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=3000)) for _ in range(40)]
    w = packing.WordTokens(tokenizer_path())
    want = [w.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    for known, most_bytes, grown in ((1 << 20, 16, True), (1 << 13, 16, False), (1 << 20, 0.05, False)):
        monkeypatch.setattr(packing, "KNOWN_WORDS", known)
        monkeypatch.setattr(packing, "KNOWN_BYTES", most_bytes)
        w.forget()
        for k in range(0, len(texts), 2):
            ids, at = w.ids(pa.array(texts[k : k + 2]))
            assert [ids[at[i] : at[i + 1]].tolist() for i in (0, 1)] == want[k : k + 2]
        assert (len(w.table) > 1 << 16) == grown


def test_a_worker_holds_little_for_a_word_and_looks_at_little_text_together(monkeypatch):
    import pyarrow as pa
    from pyspark import TaskContext

    class Task:
        def partitionId(self):
            return 0

    monkeypatch.setattr(TaskContext, "get", lambda: Task())
    rng = random.Random(13)
    texts = [" ".join("".join(rng.choices("abcdeé", k=rng.randint(6, 9))) for _ in range(200)) for _ in range(1000)]
    w, seen, real = packing.worker_tokens(tokenizer_path()), [], packing.WordTokens.ids
    monkeypatch.setattr(packing.WordTokens, "ids", lambda self, column: seen.append(pa.compute.sum(pa.compute.binary_length(column)).as_py()) or real(self, column))
    w.forget()
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    got = [r for b in packing._tokenize(tokenizer_path(), 4096, True)(iter([batch])) for r in b.to_pylist()]
    for r in got[::50]:
        assert r["ids"] == [*w.tokenizer.encode(texts[r["id"]], add_special_tokens=False).ids, 1]
    assert [r["id"] for r in got] == batch.column("id").to_pylist()
    held = sum(x.nbytes for k, x in vars(w).items() if isinstance(x, np.ndarray) and k not in ("kind", "odd", "closes"))
    # a hash, two places, a share of the table, the bytes of the word and about four ids, with a quarter to spare
    assert w.n > 100_000 and held < 80 * w.n
    assert sum(seen) == sum(len(x.encode()) for x in texts) and max(seen) <= 1 << 18


def test_spans_that_differ_in_one_byte():
    from letterloom.llm.bytetext import equal_spans

    data = np.random.default_rng(3).integers(0, 256, 300).astype(np.uint8)
    for size in (0, 1, 7, 8, 9, 63, 64, 65, 200):
        at = np.array([5])
        assert equal_spans(data, at, data.copy(), at, np.array([size])).all()
        for k in range(300 - 8):
            other = data.copy()
            other[k] ^= 128
            assert equal_spans(data, at, other, at, np.array([size]))[0] == (not 5 <= k < 5 + size)


def test_few_files(spark, tmp_path):
    """A table made from little is written in few files, however many shuffle partitions there are; sizes that Spark doesn't know change nothing."""
    spark.range(5000).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = common.table(common.few_files(rows.groupBy("id").count()), "few")
        most = common.FILES_A_CORE * spark.sparkContext.defaultParallelism
        assert 1 < len(got.inputFiles()) <= most
        # ids that Spark gives to rows stay apart
        ids = common.few_files(rows.groupBy("id").count().withColumn("rid", F.monotonically_increasing_id()))
        assert ids.select("rid").distinct().count() == got.count() == 5000
        assert common.few_files(spark.sparkContext.parallelize([(i,) for i in range(64)], 64).toDF("id long")).rdd.getNumPartitions() == 64
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_toxicity_worker_memory():
    """What a worker makes to look for n-grams stays far below what pieces of 1 MB took: 57 MB more than the model and the rows."""
    rng = np.random.default_rng(3)
    text = ["".join(chr(97 + c) for c in rng.integers(0, 26, 4000)) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(text)], ["id", "text"])
    gram = np.sort(rng.integers(0, 1 << 63, 4096).astype(np.uint64) * 2)
    model = toxicity.ToxicityModel((3, 4, 5, 6), gram, np.ones(4096), 0.0)
    tracemalloc.start()
    try:
        rows = sum(len(b) for b in toxicity._score(model)(iter([batch])))
        assert rows == 500 and tracemalloc.get_traced_memory()[1] < 40_000_000
    finally:
        tracemalloc.stop()


def test_exact_dedup_few_files(spark, tmp_path, monkeypatch):
    """The tables of a round have few files, however many shuffle partitions there are."""
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same words"), (F.col("id") % 300).cast("string")).alias("text"))
    rows.write.parquet(str(tmp_path / "docs"))
    files = []
    written = lambda df, name: files.append(len((out := common.table(df, name)).inputFiles())) or out
    monkeypatch.setattr(radix_dedup, "table", written)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = radix_dedup.exact_dedup(spark.read.parquet(str(tmp_path / "docs"))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 600 and all(r.group_size == 2 and r.keep_id == r.doc_id % 300 + 300 for r in got)
    assert max(files) <= common.FILES_A_CORE * spark.sparkContext.defaultParallelism
