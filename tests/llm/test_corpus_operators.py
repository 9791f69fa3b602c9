"""The corpus operators in Spark: results against plain versions, and the cases their docstrings define."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from depscope.llm import bpe, embeddings, exact_dedup, html_text, mixing, near_copies, quality, sharding, simhash, token_store, toxicity
from depscope.llm.common import shared_dir, table
from depscope.llm.components import connected_components, join_hot
from depscope.llm.forest import Forest

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 20_000
#: Names that the operators use for columns of their own.
CLASHES = ["id", "size", "copies", "kept", "keep_id", "score", "row", "stays", "fp", "label", "shard", "slot", "rate", "target", "body", "digest", "n", "source_size", "lambda", "features", "text_sha256", "component_id"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    rows = [(1, "a b  c", "en", "s1"), (2, "a b\tc", "en", "s1"), (3, None, None, None), (4, "", "de", "s2"), (5, " \n", "de", "s2"), (None, "q r s", "fr", "s1"), (None, None, None, "s2"), (6, LONG, "en", None), (7, LONG.replace(" ", "\n"), "en", "s3"), (8, "é漢🙂 x", "en", "s3"), (8, "é漢🙂 x", "en", "s3"), (9, "one", "en", "s1"), (10, "one", "en", "s1"), (11, "You vile idiot. Fine day.", "en", "s9")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)}).repartition(3)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- components and joins ---------------------------------------------------------------------


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 1000 + i) for i in range(80)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5), (-3, -9), (-9, -3)]
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    at = {x: i for i, x in enumerate(nodes)}
    f = Forest(len(nodes))
    f.add(np.array([at[a] for a, b in edges if a != b]), np.array([at[b] for a, b in edges if a != b]))
    got = by_id(connected_components(spark.createDataFrame(edges, "a long, b long")), "node")
    assert sorted(got) == nodes
    groups = defaultdict(set)
    for x in nodes:
        groups[got[x]["label"]].add(f.root[at[x]])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(f.root.tolist()))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_hot(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k"), "id")
    lookup = rows.groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("v"))
    got = join_hot(rows, lookup, "k", "w", F.col("id"), 3000, hot_share=10).collect()
    assert len(got) == 3000 and all(r["v"] == (0 if r["id"] < 2000 else r["id"]) for r in got)


# --- op1 --------------------------------------------------------------------------------------


def plain_groups(texts_by_id):
    fps = {i: simhash.fingerprint(t) for i, t in texts_by_id.items()}
    ids = list(fps)
    fp = np.array([fps[i] for i in ids], np.uint64)
    f = Forest(len(ids))
    f.add(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp) <= 3))
    least = {}
    for i, r in zip(ids, f.root.tolist(), strict=True):
        least[r] = min(i, least.get(r, i))
    return {i: (fps[i], least[r]) for i, r in zip(ids, f.root.tolist(), strict=True)}


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = {}
    for i in range(150):
        t = rng.choices(words, k=rng.choice([2, 30, 400]))
        texts[i * 3] = " ".join(t)
        for j in (1, 2):
            if i % 3 == 0:
                t[rng.randrange(len(t))] = "zz"
                texts[i * 3 + j] = " ".join(t)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_components(df, leaf_rows=20).collect()}
    want = plain_groups(texts)
    assert got == want and 40 < len({c for _, c in want.values()}) < len(texts)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == {c for _, c in want.values()}


def test_simhash_cases(spark, odd):
    got = defaultdict(list)
    for r in simhash.simhash_components(odd).collect():
        got[r["id"]].append(r)
    assert sum(map(len, got.values())) == odd.count()
    assert {got[i][0]["fp"] for i in (3, 4, 5)} == {0} and got[5][0]["component_id"] == 3
    assert got[2][0]["component_id"] == 1 and got[7][0]["component_id"] == 6 and len(got[8]) == 2
    out = simhash.drop_near_duplicates(odd)
    assert out.columns == odd.columns and sorted(r["doc_id"] for r in out.filter("doc_id is not null").collect()) == [1, 3, 6, 8, 9, 11]
    assert out.filter("doc_id is null").count() == 1
    assert simhash.simhash_components(odd.limit(0)).count() == 0 == simhash.drop_near_duplicates(odd.limit(0)).count()


def test_near_copy_cases(spark, odd):
    got = defaultdict(set)
    for r in near_copies.near_copy_components(odd).collect():
        got[r["id"]].add(r["component_id"])
    assert got == {1: {1}, 2: {1}, 3: {3}, 4: {4}, 5: {5}, None: {None}, 6: {6}, 7: {6}, 8: {8}, 9: {9}, 10: {9}, 11: {11}}
    out = near_copies.drop_near_copies(odd)
    assert out.columns == odd.columns and Counter(r["doc_id"] for r in out.collect()) == Counter([1, 3, 4, 5, None, 6, 8, 9, 11])
    assert {c: {r[c] for r in out.select(c).distinct().collect()} for c in CLASHES} == {c: {i} for i, c in enumerate(CLASHES)}
    assert near_copies.near_copy_components(odd.limit(0)).count() == 0 == near_copies.drop_near_copies(odd.limit(0)).count()


# --- op2 --------------------------------------------------------------------------------------


def plain_links(vectors, threshold=0.9):
    ids = [i for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    rows = {i: np.array(v, float) for i, v in vectors if i in ids}
    n, f = Counter(), Forest(len(ids))
    for a, i in enumerate(ids):
        for b, j in enumerate(ids):
            u, v = rows[i], rows[j]
            if a != b and len(u) == len(v) and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= threshold:
                n[i] += 1
                f.add(np.array([a]), np.array([b]))
    least = {}
    for a, i in enumerate(ids):
        least[f.root[a]] = min(i, least.get(f.root[a], i))
    return {i: (n[i], least[f.root[ids.index(i)]] if i in ids else i) for i, _ in vectors}


@pytest.mark.parametrize("chunk_rows,cells", [(8192, 12), (20, 5)])
def test_embeddings_against_brute_force(spark, chunk_rows, cells):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(15, 16))
    vectors = [(i, (centres[i % 15] * rng.uniform(0.1, 9) + (0.35 if i % 2 else 3) * rng.normal(size=16)).astype("f4").tolist()) for i in range(240)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(30)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, []), (2005, [1.0, 0.0]), (2006, [2.0, 0.1]), (2007, [float("inf")] * 16)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("n_links", F.lit(7)).repartition(4)
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in embeddings.embedding_components(df, chunk_rows=chunk_rows, least_cells=cells).collect()}
    want = plain_links([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors])
    assert got == want
    assert got[2005] == (1, 2005) and got[2000] == (0, 2000) and got[1000][0] >= 30


def test_embedding_cases(spark):
    schema = "vec_id long, embedding array<double>"
    assert embeddings.embedding_components(spark.createDataFrame([], schema)).count() == 0
    only = embeddings.embedding_components(spark.createDataFrame([(4, None), (None, [0.0])], schema)).collect()
    assert {(r["id"], r["n_links"], r["component_id"], r["kept"]) for r in only} == {(4, 0, 4, True), (None, 0, None, True)}
    rows = [(None, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [0.0, 1.0]), (9, [3.0, 0.1])]
    got = Counter((r["id"], r["n_links"], r["component_id"]) for r in embeddings.embedding_components(spark.createDataFrame(rows, schema)).collect())
    assert got == Counter([(None, 2, 5), (5, 2, 5), (9, 2, 5), (None, 0, None)])


# --- op3 --------------------------------------------------------------------------------------


def test_sharding(spark, odd):
    df = spark.range(5000).select((F.col("id") * 7).alias("doc_id"), F.lit("x").alias("shard"))
    rows = sharding.shard_rows(df, shards=24).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 5000 and sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {len(s) for s in slots.values()} <= {208, 209}
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_rows(df.repartition(7), shards=24).collect()}
    # One shard more: it takes a 25th of the rows, and few others move.
    more = by_id(sharding.shard_rows(df, shards=25))
    moved = sum(more[r["doc_id"]]["shard"] != r["shard"] for r in rows)
    assert 200 <= moved < 700, moved
    small = sharding.shard_rows(odd, shards=24)
    assert small.count() == odd.count() and small.groupBy("shard").count().agg(F.max("count")).first()[0] == 1
    assert set(small.columns) == set(odd.columns) and sharding.shard_rows(odd.limit(0)).count() == 0
    ids = [None] * 40 + [3] * 40
    same = sharding.shard_rows(spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string"), shards=300)
    assert same.count() == 80 and same.select("shard").distinct().count() == 80
    with pytest.raises(ValueError):
        sharding.shard_rows(df, shards=0)


# --- op4 --------------------------------------------------------------------------------------


def plain_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    return {i: (min(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_against_brute_force(spark, weak):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a ", " a", "b\n\nc", "b c", "", None, "x" + str(i % 40)])) for i in range(600)] + [(i, "hot text") for i in range(1000, 1400)]
    digest = (lambda body: F.substring(F.sha2(body.cast("binary"), 256), 1, 1).cast("binary")) if weak else exact_dedup.sha256_digest
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = exact_dedup.exact_dedup(df, digest=digest, hot_share=10).collect()
    want = plain_dedup(rows)
    assert len(got) == len(rows) and {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == want[r["doc_id"]][0]) for r in got)


def test_exact_dedup_cases(spark, odd):
    out = exact_dedup.exact_dedup(odd)
    assert sorted(out.columns) == sorted({*odd.columns, "keep_id", "group_size", "kept", "text_sha256"}) and out.count() == odd.count()
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert got[2, "a b\tc"]["keep_id"] == 1 and got[4, ""]["keep_id"] == 3 and got[5, " \n"]["keep_id"] == 5 and got[None, None]["keep_id"] == 3 and not got[None, None]["kept"]
    assert got[7, LONG.replace(" ", "\n")]["keep_id"] == 6 and got[None, "q r s"]["kept"]
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 5, None, 6, 8, 9, 11])
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0 == exact_dedup.drop_exact_duplicates(odd.limit(0)).count()


# --- op5, op9 ---------------------------------------------------------------------------------


def test_quality(spark, sf_dir, odd):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = by_id(quality.classify(docs, labels), "id")
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(got) == docs.count() and all(got[r["doc_id"]]["held_out"] for r in held)
    right = {k: [got[r["doc_id"]]["predicted"] == k for r in held if r["quality"] == k] for k in (0, 1)}
    assert np.mean([np.mean(x) for x in right.values()]) > 0.75  # a constant has 0.5
    again = by_id(quality.classify(docs.repartition(3), labels.repartition(2)), "id")
    assert all(abs(again[i]["score"] - r["score"]) < 1e-6 for i, r in got.items())
    none = labels.limit(0)
    assert {r["score"] for r in quality.classify(odd, none).collect()} == {0.5}
    wild = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 0), (2, 1, 1)], labels.schema))
    scores = quality.classify(odd, wild.filter("doc_id is null or doc_id < 12"))
    assert scores.count() == odd.count() and scores.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.classify(odd.limit(0), labels).count() == 0


def test_toxicity(spark, sf_dir, odd):
    plain = [f"word{i}" for i in range(200)]
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        text = ". ".join(" ".join(rng.choices(plain, k=9)) for _ in range(5))
        bad = i % 3 == 0
        rows.append((i, text + (". You vile idiot" if bad else ". You are fine")))
        labels.append((i, 1, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, known)
    got = by_id(toxicity.score(docs, model), "id")
    assert all(got[i]["predicted"] == t for i, _, t in labels)
    first = got[0]["offending"][-1]
    assert rows[0][1][first["start"] : first["end"]] == "You vile idiot"
    assert {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()} == {i for i, _, t in labels if not t}
    out = toxicity.drop_toxic(odd, model)
    assert out.columns == odd.columns and out.count() == odd.count() - 1 and out.filter("doc_id = 11").count() == 0
    assert toxicity.score(odd, model).filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert {r["score"] for r in toxicity.score(odd, toxicity.train(odd, known.limit(0))).collect()} == {0.5}


# --- op6, op10 --------------------------------------------------------------------------------


def test_bpe(spark, odd):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(path))}, special_tokens={})
    text = {r["doc_id"]: r["text"] or "" for r in odd.filter("doc_id is not null").collect()}
    rows = bpe.bpe_round_trip(odd, path, P.PATTERN).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["id"] is not None:
            ids = np.array(enc.encode_ordinary(text[r["id"]]), "<u4")
            assert bytes(r["ids"]) == ids.tobytes() and r["n_tokens"] == len(ids) and bytes(r["decoded"]).decode() == text[r["id"]]
    assert bpe.bpe_round_trip(odd.limit(0), path, P.PATTERN).count() == 0


@pytest.mark.parametrize("options", [{}, {"width": 1, "block": 64, "file_ids": 4}])
def test_token_store(spark, odd, options):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    folder = shared_dir(spark)
    manifest = token_store.write_ids(odd, folder, path, P.PATTERN, **options)
    got = sorted(token_store.read_ids(spark, folder, manifest).collect(), key=lambda r: r["start"])
    rows = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
    source = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    at = 0
    assert manifest.count() > (5 if options else 0) and manifest.agg(F.sum("n_docs")).first()[0] == odd.count()
    for r, (i, t, _) in zip(got, source, strict=True):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (r["id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    empty = shared_dir(spark)
    assert token_store.write_ids(odd.limit(0), empty, path, P.PATTERN).count() == 0


def test_token_store_with_added_tokens(spark):
    from tokenizers import Tokenizer

    path, end = P.path("byte_bpe_50k.json"), "<|endoftext|>"
    lib = Tokenizer.from_file(path)
    texts = [f"hello {end} world", end, f"{end}{end}", f" {end}  a\n", f"x{end}y <|endoftext|", f"<|{end}|>", "plain", f"é漢 {end}'s 12"]
    folder = shared_dir(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    manifest = token_store.write_ids(df, folder, path, P.PATTERN)
    at = 0
    for r in sorted(token_store.read_ids(spark, folder, manifest).collect(), key=lambda r: r["id"]):
        ids = np.array([*lib.encode(texts[r["id"]], add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert 50256 in lib.encode(texts[0], add_special_tokens=False).ids


# --- op7 --------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, goal = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        rest = goal - sum(cap * sizes[s] for s in full)
        t = {s: cap * sizes[s] if s in full else rest * w[s] / sum(w[o] for o in open_) for s in names}
        over = {s for s in open_ if t[s] > cap * sizes[s]}
        if not over:
            return t
        full |= over


def test_mixing(spark, odd):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 40, 200])), rng.choice(["b", "B", "a", "é", "z", None, "hot", "hot", "hot"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df.repartition(5)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = plain_targets(sizes)
    taken = Counter()
    for r in out:
        assert r["copies"] in (0, 1, 2) and r["size"] == len(r["text"].split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= max(3, 0.01 * want[s]) for s in sizes) and len(out) == 3000
    # The rates solve the dual: per source they are exponential in size, and give the target.
    for s in sizes:
        own = [r for r in out if r["source"] == s]
        assert sum(r["rate"] * r["size"] for r in own) == pytest.approx(want[s], rel=1e-6)
        slope = {round(np.log(r["rate"]) / r["size"], 9) for r in own if 0 < r["rate"] < 2 and r["size"]}
        assert len(slope) <= 1 or max(slope) - min(slope) < 1e-6
    assert {(r["doc_id"], r["copies"]) for r in out} == {(r["doc_id"], r["copies"]) for r in mixing.mix(df.repartition(3)).collect()}


def test_mixing_cases(spark, odd):
    out = mixing.mix(odd)
    assert out.count() == odd.count() and out.filter("copies is null or copies > 2").count() == 0
    times = Counter((r["doc_id"], r["text"]) for r in out.collect() for _ in range(r["copies"]))
    taken = mixing.take(odd)
    assert taken.columns == odd.columns and Counter((r["doc_id"], r["text"]) for r in taken.collect()) == times
    assert all(r[c] == i for r in taken.collect() for i, c in enumerate(CLASHES))
    assert mixing.mix(odd.limit(0)).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["target"]) for r in blank] == [(0, 0.0), (0, 0.0)]


# --- op8 --------------------------------------------------------------------------------------


def test_html(spark):
    page = lambda i: f"<html><body><nav>m</nav><div class='box-{i}'><h2>T{i}</h2><p>body, of {i}</p></div><div class='low'><p>{'teaser, ' * (30 if i == 3 else 1)}</p></div></body></html>"
    rows = [(i, f"https://User@Ex.org:80/p{i}", page(i)) for i in range(8)] + [(20, None, page(20)), (21, "nonsense", None), (22, "http://other.org", ""), (22, "http://other.org", ""), (None, "http://third.org", "<p>just, this</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("path", F.lit(1)).repartition(3)
    for hosts in (100_000, 1):
        got = defaultdict(list)
        for r in html_text.extract(df, broadcast_hosts=hosts).collect():
            got[r["id"]].append(r["text"])
        # Page 3 alone would take its long teaser; the host's other pages decide.
        assert all(got[i] == [f"T{i} body, of {i}"] for i in range(8)), got
        assert got[20] == ["T20 body, of 20"] and got[21] == [""] and got[22] == ["", ""] and got[None] == ["just, this"]
    assert html_text.extract(df.limit(0)).count() == 0
    assert html_text.consensus_paths(df).filter("host = 'ex.org'").first()["path"] == ">html>body>div.box-#"


def test_html_of_a_host_with_two_templates(spark):
    long = "long, text " * 20
    most = lambda i: f"<body><article><h1>A{i}</h1><div class=entry><p>{long}</p></div></article></body>"
    few = lambda i: f"<body><article class=x><div class=entry><p>note</p></div></article><article><div class=entry><p>see</p></div></article><div class=report><p>R{i} {long}</p></div></body>"
    rows = [(i, "http://ex.org/", most(i) if i < 9 else few(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for hosts in (100_000, 0):
        got = {r["id"]: r["text"] for r in html_text.extract(df, broadcast_hosts=hosts).collect()}
        assert all(got[i] == (f"A{i} {long}" if i < 9 else f"R{i} {long}").strip() for i in range(12)), got


def test_a_host_outvotes_the_words_of_its_classes(spark):
    long = "long, text " * 20
    page = lambda i: f"<body><div class='promo box'><p>P{i} {long}</p></div><div class=low><p>x{i}, y</p></div><div class=footer><p>{'z, ' * (300 if i == 3 else 1)}</p></div></body>"
    df = spark.createDataFrame([(i, "http://ex.org/", page(i)) for i in range(9)], "page_id long, url string, html string")
    assert {r["id"]: r["text"] for r in html_text.extract(df).collect()} == {i: f"P{i} {long}".strip() for i in range(9)}
