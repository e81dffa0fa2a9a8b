"""Operators over documents against brute force on a small table of hard cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quern.llm import exact_dedup, fingerprint, lm_score, mixing, packing, sharding, simhash
from quern.llm.common import at_places, connected_components, lasting, met, placed, row_numbers


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def test_fingerprints(spark, sf, docs_rows):
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fingerprint.op1_fingerprint(spark, sf).collect())
    rows, want = ordered(docs_rows), Counter()
    for i, (doc_id, text, *_) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (fingerprint.sketch(t) for t in (text, edited, after))
        want[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.to_string(a), fingerprint.to_string(b), round(fingerprint.likeness(a, b)[0], 9), round(fingerprint.likeness(a, c)[0], 9)] += 1
    assert got == want


def test_sketches_estimate_containment_and_merge():
    from tests.llm.conftest import prose

    part, rest = prose(1, 600), prose(2, 20_000)
    a, b = fingerprint.sketch(part), fingerprint.sketch(f"{part} {rest}")
    assert fingerprint.likeness(a, b)[1] > 0.9 and fingerprint.likeness(a, b)[0] < 0.1
    assert (fingerprint.from_string(fingerprint.to_string(b)) == b).all()
    m = fingerprint.merge(a, fingerprint.sketch(rest))
    assert fingerprint.likeness(m, b)[0] > 0.97
    assert (fingerprint.merge(fingerprint.sketch(part[:300]), fingerprint.sketch(part[:300])) == fingerprint.sketch(part[:300])).all()


def test_sketches_by_brute_force():
    """Hashes as the docstring defines them, written anew: which shingles a sketch holds and how likeness counts."""
    from tests.llm.conftest import prose

    def brute(text):
        words = [xxhash.xxh64_intdigest(w) for w in text.lower().encode().split()]
        out = set()
        for i in range(max(1, len(words) - 4) if words else 0):
            v, some = 0, words[i : i + 5]
            for j, w in enumerate(some):
                v = w if not j else (v * 0x9E3779B97F4A7C15 + w) % 2**64
            v = (v + len(some)) % 2**64
            for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                v = (v ^ (v >> 33)) * m % 2**64
            out.add((v ^ (v >> 33)) >> 16)
        return out

    texts = ["", "one", "a b c d e", prose(1, 30), prose(1, 30) + " and more", prose(2, 90), prose(2, 2000)]
    for x in texts:
        whole = sorted(brute(x))
        want = [h for i, h in enumerate(whole) if i < fingerprint.LEAST or h < 2**48 // fingerprint.KEEP_ONE_IN]
        assert fingerprint.sketch(x).tolist() == want
    a, b = brute(texts[3]), brute(texts[4])  # short texts are compared exactly
    assert fingerprint.likeness(*(fingerprint.sketch(x) for x in texts[3:5]))[0] == len(a & b) / len(a | b)


def test_exact_dedup(spark, sf, docs_rows):
    got = exact_dedup.op5_exact_dedup(spark, sf).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in docs_rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()].append(doc_id)
    assert len(got) == len(docs_rows)
    for r in got:
        ids = groups[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (min(ids), len(ids))
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert kept == Counter(dict.fromkeys(groups, 1))
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_finds_heavy_digests(spark, sf, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY_ROWS", 10)
    rows = exact_dedup.digests(lasting(spark.read.parquet(f"{sf}/documents.parquet")))
    assert [r["group_size"] for r in exact_dedup.verified_winners(rows).collect()] == [61]
    test_exact_dedup(spark, sf, __import__("tests.llm.conftest", fromlist=["x"]).document_rows())


def test_dedup_keeps_one_row_of_each(spark, sf, docs_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns
    assert out.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in docs_rows})
    assert {r["_metadata"] for r in out.select("_metadata").distinct().collect()} == {"clash"}


def brute_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def test_simhash(spark, sf, docs_rows):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op10_simhash(spark, sf).collect()}
    prints = [brute_simhash(r[1]) for r in docs_rows]
    roots = brute_components(prints)
    low = defaultdict(lambda: math.inf)
    for r, root in zip(docs_rows, roots):
        low[root] = min(low[root], r[0])
    assert got == {(r[0], f"{p:016x}", low[root]) for r, p, root in zip(docs_rows, prints, roots)}
    assert simhash.dedup(spark.read.parquet(f"{sf}/documents.parquet")).count() == len(set(roots))


def test_near_dedup_keeps_different_texts_of_one_id(spark):
    from tests.llm.conftest import SCHEMA, prose

    texts = [prose(i, 60) for i in range(9)]
    ids = [None, None, None, 7, 7, 3, None, 9, 9]  # null ids, and ids with two texts
    rows = [(i, x, "en", "s", 0) for i, x in zip(ids, texts)]
    rows += [(None, texts[5], "en", "s", 0), (7, texts[5], "en", "s", 0)]  # copies of the text of 3
    rows += [rows[0], rows[3]]
    got = sorted((r["text"], r["doc_id"]) for r in simhash.dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [x for x, _ in got] == sorted(texts)
    assert dict(got) == dict(zip(texts, ids))


def clustered_points(seed=1, centres=20, each=15):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, centres, dtype=np.uint64)
    flips = lambda: np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
    return np.unique(np.array([c ^ flips() for c in base for _ in range(each)], np.uint64))


def parts_of_links(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        parent[root(i)] = root(j)
    groups = defaultdict(set)
    for i in range(n):
        groups[root(i)].add(i)
    return {frozenset(g) for g in groups.values()}


def brute_parts(points):
    groups = defaultdict(set)
    for i, root in enumerate(brute_components([int(p) for p in points])):
        groups[root].add(i)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("flat", [4096, 16])
def test_vantage_trees_connect_what_brute_force_connects(monkeypatch, flat):
    monkeypatch.setattr(simhash, "FLAT", flat)
    points = clustered_points()
    for f in (simhash.spanning_links, simhash.shard_links):
        a, b = f(points, 4)
        assert parts_of_links(len(points), zip(a.tolist(), b.tolist())) == brute_parts(points)
    assert len(simhash.spanning_links(points, 4)[0]) < len(points)
    assert max(Counter([*a.tolist(), *b.tolist()]).values()) <= 100


@pytest.mark.parametrize("least", [8, 64, 10**9])
def test_linked_points_meet_in_a_shard(least):
    points = np.unique(np.concatenate([clustered_points(2, 150, 12), clustered_points(3, 1, 400)]))
    met_, copies = set(), 0
    for mask, radius in simhash.BLOCKS:
        nodes = simhash.grown(points[::2], mask, radius, least)  # grown on a sample, routed for all
        assert (not nodes) == (least > len(points))
        for _, at in simhash.routed(nodes, points):
            copies += len(at)
            near = np.bitwise_count(points[at][:, None] ^ points[at][None, :]) <= 4
            x, y = np.nonzero(near)
            met_ |= set(zip(at[x].tolist(), at[y].tolist()))
    x, y = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4)
    assert met_ == set(zip(x.tolist(), y.tolist()))
    assert copies >= 3 * len(points)


def test_near_links_through_spark(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 16)
    points = clustered_points(5, 300, 8)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "bits bigint")
    place = {int(x): i for i, x in enumerate(points.view(np.int64))}
    links = [(place[r["a"]], place[r["b"]]) for r in simhash.near_links(df, len(points)).collect()]
    assert parts_of_links(len(points), links) == brute_parts(points)


def test_rows_keep_their_places(spark, sf, docs_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert lasting(docs) is docs
    computed = docs.where("doc_id IS NOT NULL")
    assert lasting(computed) is not computed
    from pyspark.sql import functions as F

    places = placed(docs, number=F.col("doc_id"))
    assert places.select("file", "at").distinct().count() == len(docs_rows)
    again = at_places(docs, places.where("number % 2 = 0").select("file", "at")).select("doc.*")
    assert again.columns == docs.columns
    assert Counter(r["doc_id"] for r in again.collect()) == Counter(r[0] for r in docs_rows if r[0] % 2 == 0)


def test_crowded_keys_meet_by_broadcast(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)], "i bigint, k string")
    facts = rows.groupBy("k").count().withColumnRenamed("count", "n")
    assert {r["i"]: r["n"] for r in met(rows, facts, "k", 3000).collect()} == {i: 2000 if i % 3 else 1 for i in range(3000)}


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(64)] + [(100, 101), (101, 100)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(65)} | {100: 100, 101: 100}


def test_row_numbers_are_gapless(spark):
    df = spark.createDataFrame([(None if i % 7 == 0 else "ab"[i % 2], i) for i in range(100)], "g string, v bigint")
    got = defaultdict(list)
    for r in row_numbers(df, ["g"], [df["v"]], 5, "at").collect():
        got[r["g"]].append(r["at"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and len(got) == 3


def test_sharding(spark, sf, docs_rows):
    got = sharding.op2_sharding(spark, sf).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in docs_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    shards, sizes = defaultdict(set), Counter()
    for r in got:
        shards[r["text_crc32"]].add(r["shard"])
        sizes[r["text_crc32"]] += 1
    # groups that fit stay whole; the hot one takes few more shards than it needs
    for crc, n in sizes.items():
        assert len(shards[crc]) <= math.ceil(n / min(counts)) + (2 if n > min(counts) else 0)


def test_packing(spark, sf, docs_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.op3_packing(spark, sf).collect()
    ids = {r[0]: np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in docs_rows}
    copies = Counter(r[0] for r in docs_rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(part.tobytes()) and len(part) == r["length"] > 0
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, found in pieces.items():
        assert sum(n for _, n in found) == copies[doc] * len(ids[doc])
    assert set(pieces) == set(ids)
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(sum(n for _, n in v) < 2048 for v in sequences.values()) <= 3  # one for each input split


def test_sum_of_squares_prefers_the_level_that_evens_out():
    s = packing.SumOfSquares(10)
    list(s.add(("a", 0, b"1234" * 6, 6), 6))
    assert s.level_for(4) == 6  # fills the window
    list(s.add(("b", 0, b"1234" * 6, 6), 6))
    assert s.count[6] == 2 and s.level_for(2) == 6
    done = [w for size in (4, 4) for w in s.add(("c", 0, b"1234" * size, size), size)]
    assert len(done) == 2 and s.n_open == 0


def test_tokenizer_agrees_on_odd_texts():
    import public_tokenizers

    t = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for x in ["ΣΑΣ x", "İstanbul it's I'LL <|endoftext|> x<|startoftext|>y", "12345 $$$ é́ ﬁ", "日本語テキスト 한국어", "\x1c a\x1fb \x85c", "", " a"]:
        assert np.frombuffer(next(t.batch([x])), "<u4").tolist() == t.t.encode(x, add_special_tokens=False).ids


def test_mixing(spark, sf, docs_rows):
    got = mixing.op8_mixing(spark, sf).collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in docs_rows)
    totals = Counter()
    for r in docs_rows:
        totals[r[3]] += size(r[1])
    sources = sorted((s for s in {r[3] for r in docs_rows}), key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    bound, capped = {s: 3 * totals[s] for s in sources}, set()
    while True:
        left = sum(totals.values()) - sum(bound[s] for s in capped)
        share = sum(weight[s] for s in sources if s not in capped)
        goal = {s: bound[s] if s in capped else left * weight[s] / share for s in sources}
        over = {s for s in sources if goal[s] > bound[s] + 1e-9}
        if not over:
            break
        capped |= over
    of = {(r[0]): r[3] for r in docs_rows}
    taken = Counter()
    for r in got:
        assert r["source_size"] == totals[of[r["doc_id"]]] and r["target"] == pytest.approx(goal[of[r["doc_id"]]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[of[r["doc_id"]]] += r["taken"]
    for s in sources:
        sizes = [size(r[1]) for r in docs_rows if r[3] == s]
        # whole copies come as near as the shortest documents allow, unless most of the source is a few long ones
        few = sorted(sizes)[-5:]
        assert abs(taken[s] - goal[s]) <= (max(sizes) / 2 if sum(few) > 0.8 * sum(sizes) else max(0.02 * goal[s], 60)), (s, taken[s], goal[s])
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.op8_mixing(spark, sf).collect()), key=str)


def test_mixing_solves_the_joint_dual(spark, tmp_path):
    """At the solution rates are exponential tilts that meet every source's target, and the other groups' softly."""
    from tests.llm.conftest import prose

    rng = np.random.default_rng(3)
    rows = [(i, prose(i, int(rng.integers(1, 300))), ["en", "de", None][int(rng.integers(0, 3)) if i % 2 else 0], f"s{i % 4}", 0) for i in range(400)]
    spark.createDataFrame(rows, LM_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in mixing.op8_mixing(spark, str(tmp_path)).collect()}
    by_source, by_lang, goal, totals = Counter(), Counter(), {}, Counter()
    for r in rows:
        x = got[r[0]]
        by_source[r[3]] += x["rate"] * x["size"]
        by_lang[r[2]] += x["rate"] * x["size"]
        totals[r[2]] += x["size"]
        goal[r[3]] = x["target"]
    assert all(by_source[s] == pytest.approx(goal[s], rel=1e-6) for s in goal)
    # documents of one source differ in rate by language and length, ratios being those of their groups
    one = {(r[2], int(math.log2(got[r[0]]["size"]))): got[r[0]]["rate"] for r in rows if r[3] == "s0"}
    two = {(r[2], int(math.log2(got[r[0]]["size"]))): got[r[0]]["rate"] for r in rows if r[3] == "s1"}
    assert len(set(one.values())) > 2
    free = [k for k in one if k in two and max(one[k], two[k]) < 2.999]
    ratios = [one[k] / two[k] for k in free]
    assert max(ratios) == pytest.approx(min(ratios), rel=1e-6)
    assert all(abs(by_lang[k] - totals[k]) < 0.1 * totals[k] for k in totals)


LM_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute_lm(rows, good):
    """(n_tokens, target loss, background loss) by plain counting over words."""
    docs = [(r[0], [w.lower() for w in (r[1] or "").encode().split()]) for r in rows]
    counted = lambda some: (Counter(w for _, ws in some for w in ws), Counter(w for _, ws in some for w in ["<s>", *ws][: len(ws)]), Counter(p for _, ws in some for p in zip(["<s>", *ws], ws)))
    starts = lambda some: sum(1 for _, ws in some if ws)
    chosen = [d for d in docs if d[0] in good]
    every, some = counted(docs), counted(chosen)
    known = {w for w, n in every[0].items() if n >= 2}
    tokens = {"b": sum(every[0].values()), "t": sum(some[0].values())}
    scale = tokens["t"] / tokens["b"] if tokens["t"] else 1.0
    rare = {"b": sum(n for w, n in every[0].items() if w not in known), "t": sum(n for w, n in some[0].items() if w not in known)}
    n_starts = {"b": starts(docs), "t": starts(chosen)}
    out = []
    for doc_id, ws in docs:
        own = Counter(ws), Counter(["<s>", *ws]), Counter(zip(["<s>", *ws], ws))
        losses = {}
        for m, (uni, _, two), s in (("b", every, scale), ("t", some, 1.0)):
            less = m == "b" or doc_id in good
            total = 0.0
            for u, w in zip(["<s>", *ws], ws):
                c1 = uni[w] if w in known else rare[m]
                h = n_starts[m] if u == "<s>" else uni[u]
                c2, n = two[u, w], tokens[m]
                if less:
                    c1 -= own[0][w] if w in known else sum(k for x, k in own[0].items() if x not in known)
                    h -= own[1][u] if u == "<s>" else sum(1 for x in ws[:-1] if x == u)
                    c2, n = c2 - own[2][u, w], n - len(ws)
                p1 = (s * c1 + 1) / (s * n + len(known) + 1)
                p2 = (s * c2 + p1) / (s * h + 1)
                total -= math.log(0.6 * p2 + 0.4 * p1)
            losses[m] = total / len(ws) if ws else 0.0
        out.append((doc_id, len(ws), losses["t"], losses["b"]))
    return out


@pytest.mark.parametrize("long, rows_, bytes_", [(1 << 16, 4096, 25_000_000), (200, 3, 500)])
def test_lm_scores_match_brute_force(spark, monkeypatch, long, rows_, bytes_):
    from tests.llm.conftest import prose

    for name, value in (("LONG", long), ("ROWS", rows_), ("BUCKET_BYTES", bytes_)):
        monkeypatch.setattr(lm_score, name, value)
    rows = [(i, prose(i, 20 + 7 * i), "en", "s", 0) for i in range(30)]
    rows += [(40, None, None, None, None), (41, " ", None, None, None), (42, "one", "en", "s", 0), (None, "a b A b once", "en", "s", 0), rows[3], rows[4][:1] + ("x y z x", "", "", 0)]
    good = {1, 3, 4, 9, 17, 42}
    targets = spark.createDataFrame([(i,) for i in [*good, None, 999, 3]], "doc_id bigint")
    got = lm_score.scored(spark.createDataFrame(rows, LM_SCHEMA).repartition(3), targets).collect()
    want = Counter((d, n, round(t, 9), round(b, 9)) for d, n, t, b in brute_lm(rows, good))
    assert Counter((r["doc_id"], r["n_tokens"], round(r["target_loss"], 9), round(r["background_loss"], 9)) for r in got) == want
    assert all(r["score"] == r["target_loss"] - r["background_loss"] for r in got)


def test_lm_without_targets(spark, sf, docs_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = lm_score.scored(docs, spark.createDataFrame([], "doc_id bigint")).collect()
    assert len(got) == len(docs_rows) and {r["score"] for r in got} == {0.0}


def test_empty_tables(spark, empty_sf):
    for f in (fingerprint.op1_fingerprint, sharding.op2_sharding, packing.op3_packing, exact_dedup.op5_exact_dedup, lm_score.op7_lm_score, mixing.op8_mixing, simhash.op10_simhash):
        assert f(spark, empty_sf).count() == 0, f.__name__
