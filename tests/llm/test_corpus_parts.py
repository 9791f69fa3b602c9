"""Parts of the corpus operators that need no Spark, against plain versions of the same."""

import io
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from depscope.llm import bpe, embeddings, html_text, near_copies, planes, quality, sharding, simhash, textvec, toxicity, vantage
from depscope.llm.forest import Forest
from depscope.llm.pretokens import Splitter
from depscope.llm.token_store import AddedTokenEncoder

ODD = ["", " ", "\x1c\x1d", "a\x85b", "  x  y ", "don't we'll 'S", "naïve ñandú", "漢字かな", "🙂🙃", "a​b", "<|endoftext|>", "½ ² ⅷ 12", "\r\n\r\n x", "é", "x" * 5000, "　 a　b", "ſtraße"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_encoding(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return Tokenizer.from_file(P.path("byte_bpe_50k.json")), AddedTokenEncoder(f.read(), P.PATTERN)


texts = st.text(st.one_of(st.sampled_from(list(" \n\t'sltdvem.!aZ09éñß漢\x1c\x85\xa0　")), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_both_encoders_agree_with_the_libraries(vocabulary, tiktoken_encoding, library, text):
    ids = np.frombuffer(vocabulary.encode(text), "<u4").tolist()
    assert ids == tiktoken_encoding.encode_ordinary(text)
    assert vocabulary.decode(vocabulary.encode(text)) == text.encode()
    whole, pieces = library
    assert np.frombuffer(pieces.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_encoders_on_odd_texts(vocabulary, tiktoken_encoding, library, text):
    assert np.frombuffer(vocabulary.encode(text), "<u4").tolist() == tiktoken_encoding.encode_ordinary(text)
    assert np.frombuffer(library[1].encode(text), "<u4").tolist() == library[0].encode(text, add_special_tokens=False).ids
    assert vocabulary.encode(None) == b"" == library[1].encode(None)


def test_long_texts_are_split_alike(monkeypatch):
    import depscope.llm.pretokens as pretokens

    text = "ab, cd  12\n" * 500
    whole = [m for part in Splitter(P.PATTERN)(text) for m in part]
    monkeypatch.setattr(pretokens, "LONG_TEXT", 40)
    parts = list(Splitter(P.PATTERN)(text))
    assert len(parts) > 10 and [m for p in parts for m in p] == whole


def test_perfect_hash_is_a_bijection(vocabulary):
    keys = [f"key {i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(map(h.slot, keys)) == list(range(5000))
    assert len(vocabulary.at) == len(vocabulary.tokens) and all(t in vocabulary.ranks for t, _ in vocabulary.at)
    assert bpe.PerfectHash([b"one"]).slot(b"one") == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=12), st.sampled_from([1, 8]), st.sampled_from([4, 7, 64]))
def test_plane_files_round_trip(docs, width, block):
    out = io.BytesIO()
    w = planes.PlaneWriter(out, block=block, width=width)
    for i, d in enumerate(docs):
        w.add(i * 3 if i % 4 else None, np.array(d, "<u4"))
    w.close()
    f = planes.PlaneFile(out.getvalue())
    flat = [x for d in docs for x in d]
    assert [(doc, ids.tolist()) for doc, _, ids in f.documents()] == [(i * 3 if i % 4 else None, d) for i, d in enumerate(docs)]
    for a in range(0, len(flat) + 1, 5):
        assert f.ids(a, min(9, len(flat) - a)).tolist() == flat[a : a + 9]
    with pytest.raises(IndexError):
        f.ids(0, len(flat) + 1)


def test_plane_file_errors():
    with pytest.raises(ValueError):
        planes.PlaneFile(b"not such a file, though long enough to hold a footer of one")
    with pytest.raises(ValueError):
        planes.PlaneWriter(io.BytesIO(), width=4)


def plain_fingerprint(text, words=3):
    parts = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [*ODD, None, "One two", "ONE two Three", "a b c d " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_majority_counts_over_255():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 1700, np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert simhash.majority_bits(h) == want


@pytest.mark.parametrize("search", [vantage.Search(1, 32, 1, 3), vantage.Search(1, 16, 1, 7), vantage.Search(2, 32, 2, 11)])
def test_trees_connect_all_links(search):
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, 2**64, (2000, search.words), np.uint64)]
    for bits in (1, 2, 3, 3, search.radius, search.radius + 1):  # chains and dense groups
        some = rows[-1][:150].copy()
        for _ in range(bits):
            at = rng.integers(0, 64 * search.words, len(some))
            some[np.arange(len(some)), at // 64] ^= np.uint64(1) << (at % 64).astype(np.uint64)
        rows.append(some)
    fp = np.unique(np.concatenate(rows), axis=0)
    every = np.arange(len(fp))
    forest = Forest(len(fp))
    for b in range(search.count):
        codes = np.ascontiguousarray(search.blocks(fp)[:, b])
        leaves = []
        tree = vantage.build_tree(codes[::3], 3, 400, search.reach, np.random.default_rng(0), leaves)
        stored = []
        for _, rows_, home in vantage.route(tree, codes, every, search.reach, np.ones(len(fp), bool)):
            stored += rows_[home].tolist()
            shard = vantage.Shard(fp[rows_[home]], codes[rows_[home]], rows_[home], forest, search.radius)
            shard.search(fp[rows_], codes[rows_], rows_, search.masks(), block=97)
        assert sorted(stored) == every.tolist() and len(leaves) > 2
    d = sum(np.bitwise_count(fp[:, None, w] ^ fp[:, w]).astype(int) for w in range(search.words))
    want = Forest(len(fp))
    want.add(*np.nonzero(d <= search.radius))
    assert len(np.unique(want.root)) < len(fp) - 400
    assert len(set(zip(want.root.tolist(), forest.root.tolist(), strict=True))) == len(np.unique(want.root)) == len(np.unique(forest.root))


def test_ranges_in_pieces():
    of, place = vantage.expand(np.array([3, 9, 5]), np.array([5, 9, 8]))
    assert of.tolist() == [0, 0, 2, 2, 2] and place.tolist() == [3, 4, 5, 6, 7]
    assert [len(x) for x in vantage.expand(np.array([], int), np.array([], int))] == [0, 0]
    n = np.array([0, 3, 50, 1, 1, 0, 9])
    parts = list(vantage._pieces(n, 5))
    assert np.concatenate([n[p] for p in parts]).tolist() == n.tolist() and all(n[p].sum() <= 5 or len(n[p]) == 1 for p in parts if n[p].sum() > 5)


def plain_shingles(text, words=5):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def test_shingle_sets_and_wide_fingerprints():
    texts_ = ["a b c d e f", "A  b\tc d E f g", None, "one two", "", "TWO one", "x y " * 900, "é漢 b"]
    h, n = near_copies.shingle_sets(texts_)
    sets = [set(x.tolist()) for x in np.split(h, np.cumsum(n)[:-1])]
    want = [plain_shingles(t) for t in texts_]
    assert [len(s) for s in sets] == [len(s) for s in want]
    assert all(len(a & b) == len(c & d) for a, c in zip(sets, want, strict=True) for b, d in zip(sets, want, strict=True))
    fp = near_copies.wide_fingerprints(h, n)
    assert fp.shape == (6, 4) and len(np.unique(fp)) == 24
    assert near_copies.wide_fingerprints(*near_copies.shingle_sets(["", None])).shape == (0, 4)


def test_forest():
    f = Forest(8)
    f.add(np.array([1, 5, 5]), np.array([2, 6, 5]))
    f.add(np.array([2, 7]), np.array([6, 7]))
    assert f.root[1] == f.root[2] == f.root[5] == f.root[6] and len(set(f.root.tolist())) == 5


def plain_walk(counts, nodes, capacity):
    """One key at a time: own keys first, then what is left goes around in a queue."""
    used, out, left = [0] * len(capacity), {}, defaultdict(list)

    def put(key, shard):
        out[key] = (shard, used[shard])
        used[shard] += 1

    for i, (_, shard) in enumerate(nodes):
        for r in range(counts.get(i, 0)):
            if used[shard] < capacity[shard]:
                put((i, r), shard)
            else:
                left[i].append((i, r))
    queue = []
    for i, (_, shard) in [*enumerate(nodes)] * 2:
        while queue and used[shard] < capacity[shard]:
            put(queue.pop(0), shard)
        queue += left.pop(i, [])
    return out


@pytest.mark.parametrize("shards", [1, 5, 24, 300, 2000])
def test_bounded_walk(shards):
    rng = random.Random(shards)
    nodes = sharding.ring_nodes(shards, 4 if shards < 10 else 64)
    assert {s for _, s in nodes} == set(range(shards)) and nodes == sorted(nodes) and len(nodes) == shards * (4 if shards < 10 else 64)
    counts = {i: rng.choice([0, 1, 7, 30]) for i in range(0, len(nodes), 1 if shards < 10 else 9)}
    total = sum(counts.values())
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    placed = sharding.bounded_walk(counts, nodes, capacity)
    got = {(node, r): (shard, slot + r - a) for node, a, e, shard, slot in placed for r in range(a, e)}
    assert got == plain_walk(counts, nodes, capacity) and len(got) == total
    assert sharding.bounded_walk({}, nodes, capacity) == []
    with pytest.raises(ValueError):
        sharding.bounded_walk({0: total + 1}, nodes, capacity)


def test_word_hashes_and_shapes():
    texts_ = ["Foo, bar FOO bär 12a", "", None, "foo!! !!", "x" * 3000]
    w = textvec.Words(texts_, spaced=False)
    words = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
    assert words == ["foo", "bar", "foo", "bär", "12a", "foo", "x" * 3000] and w.doc.tolist() == [0] * 5 + [3, 4]
    h = w.hashes(w.start, w.end)
    assert h[0] == h[2] == h[5] and len(set(h.tolist())) == 5
    assert w.hashes(w.start[:1], w.start[:1] + 2)[0] == w.hashes(w.start[2:3], w.start[2:3] + 2)[0]
    s = textvec.Words(["Abc DEF Xyzzy a1 b2 !! !"], spaced=True).shapes()
    assert s[0] == s[2] and s[3] == s[4] and s[5] == s[6] and len(set(s.tolist())) == 4
    assert textvec.Words([None, ""], spaced=True).doc.size == 0
    assert list(textvec.groups(["aa", "b", None, "cccc"], 3)) == [(0, 2), (2, 4)] or list(textvec.groups(["aa", "b", None, "cccc"], 3))[-1][1] == 4


def test_contexts_stay_within_documents():
    index, total = quality.index_vectors(), np.zeros((quality.ENTRIES, quality.DIM + 1), np.int64)
    docs = ["a b c", None, "d", "b a"]
    quality.add_contexts(*quality.entries(docs), index, total)
    want = np.zeros_like(total)
    for d in docs:
        x = quality.entries([d])[0]
        for i in range(len(x)):
            want[x[i], -1] += 1
            for j in range(max(0, i - 2), min(len(x), i + 3)):
                if j != i:
                    want[x[i], :-1] += index[x[j]]
    assert (total == want).all() and total.any()
    v = quality.centred(total)
    assert np.allclose((v * v).sum(1)[total[:, :-1].any(1)], 1, atol=1e-5) and not v[~total[:, :-1].any(1)].any()


def test_features_are_pooled_word_vectors():
    v = np.random.default_rng(0).normal(size=(quality.ENTRIES, quality.DIM)).astype(np.float32)
    x = quality.features(["a b b", None, "c"], v)
    a, b, c = (v[quality.entries([w])[0][0]].astype(float) for w in "abc")
    own = np.stack([a, b, b])
    assert np.allclose(x[0], np.concatenate([own.mean(0), own.std(0), (a * b + b * b) / 3, [np.log(4) / 10]]), atol=1e-5)
    assert not x[1].any() and np.allclose(x[2, : quality.DIM], c) and np.allclose(x[2, quality.DIM : -1], 0, atol=1e-3)


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 6))
    y = (rng.random(1500) < 1 / (1 + np.exp(-2 * x[:, 0] - x[:, 1]))).astype(int)
    p = quality.fit(x[:1000], y[:1000]).scores(x[1000:])
    assert ((p > 0.5) == y[1000:]).mean() > 0.75
    high = p > 0.8
    assert abs(y[1000:][high].mean() - p[high].mean()) < 0.12
    assert quality.fit(x[:5], np.ones(5, int)).scores(x[:2]).tolist() == [1, 1] and quality.fit(x[:0], y[:0]).scores(x[:1])[0] == 0.5


def test_noisy_or_finds_the_sentence():
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(400):
        sentences = [" ".join(rng.choices(plain, k=8)) for _ in range(rng.randrange(2, 9))]
        labels.append(int(i % 4 == 0))
        if labels[-1]:
            for _ in range(2):
                sentences[rng.randrange(len(sentences))] += " vile" + rng.choice(["", "st", "ness"])
        docs.append(". ".join(sentences))
    x = [toxicity.Sentences([d]) for d in docs]
    model = toxicity.fit([(s.features, s.sentence) for s in x[:300]], np.array(labels[:300]))
    score = [model.documents(model.sentences(s), s.doc, 1)[0] for s in x[300:]]
    assert np.mean((np.array(score) >= 0.5) == np.array(labels[300:])) > 0.97
    s = toxicity.Sentences(["w1 w2. Oh, vilest w3! w4"])
    assert model.sentences(s).argmax() == 1 and len(s.doc) == 3
    empty = toxicity.Sentences(["", None])
    assert model.documents(model.sentences(empty), empty.doc, 2).max() < 0.5


def test_pivot_bounds_never_lose_a_link():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    v = embeddings.unit(np.concatenate([centres[rng.integers(0, 12, 400)] + 0.25 * rng.normal(size=(400, 8)), rng.normal(size=(200, 8))]))
    c = embeddings.Cells(v[:10])
    angles = c.angles(v)
    home = angles.argmin(1)
    near = angles[np.arange(len(v)), home]
    radius = np.array([near[home == j].max() if (home == j).any() else -10 for j in range(10)])
    reach = np.arccos(0.9)
    go = (angles <= radius + reach + 1e-6) & (angles - near[:, None] <= 2 * reach + 1e-6)
    a, b = np.nonzero(v @ v.T >= 0.9)
    assert go[a, home[b]].all() and not go.all()


PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="home p-12">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div id="cookie-notice">We use cookies, yes</div>
<main><div class="post-12 entry"><h1>T &amp; x &am</h1><!-- <p>hidden</p> --><p>One <b>bo</b>ld,&nbsp;text
 here<p>Two <a href="x>y">link</a> 1 < 2<br>next<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>
<div class="comments"><p>nice, post, yes, indeed, so very nice</p></div><form>f</form><div class=ad-slot>buy</div><p hidden>no</p></div></main>
<aside>s</aside><footer>&copy; f</footer>"""


def test_page_blocks():
    want = "T & x &am One bold, text here Two link 1 < 2 next a b c d"
    found = html_text.blocks(PAGE)
    assert html_text.main_text(found, None) == want
    best = max(html_text.container_scores(found).items(), key=lambda x: x[1])[0]
    assert best.endswith("main>div.entry.post-#") and html_text.main_text(found, best) == want
    assert html_text.main_text(found, ">html>body>nowhere") == want
    assert html_text.main_text(html_text.blocks(""), None) == "" == html_text.main_text(html_text.blocks("<nav>x</nav>"), None)
    assert html_text.main_text(html_text.blocks("<div class='has-sidebar no-ads'><p>kept, all</p><p class=commentList>gone</p></div>"), None) == "kept, all"
    assert html_text.main_text(html_text.blocks("a < b &lt; c"), None) == "a < b < c"
    assert html_text.main_text(html_text.blocks("<p>" * 4000 + "x, y" + "<div>" * 3000 + "z, long enough"), None) != ""


def test_whole_article_around_its_longest_part():
    body = "long, text " * 30
    for page in (
        f"<body><article><h1>T</h1><p class=lead>Lead</p><div class=entry><p>{body}</p></div></article><div class=low><p>no</p></div>",
        f"<body><main><h1>T</h1><section class=a><p>Lead</p></section><section class=b><p>{body}</p></section></main><div class=low><p>no</p></div>",
        f"<body><div class=post><h1>T</h1><p class=lead>Lead</p><div class=entry><p>{body}</p></div></div><div class=low><p>no</p></div>",
    ):
        assert html_text.main_text(html_text.blocks(page), None) == f"T Lead {body.strip()}"


@pytest.mark.parametrize("wrapper", ["content-sidebar-wrap", "layout-sidebar-right", "search-results"])
def test_wrappers_and_attribute_values_are_no_boilerplate(wrapper):
    text = lambda page: html_text.main_text(html_text.blocks(page), None)
    assert text(f"<p>Site, since 1999</p><div class='{wrapper}'><article><h1>T</h1><p>long, text</p></article><div class=sidebar><p>x, y</p></div></div>") == "T long, text"
    assert text(f"<div id={wrapper}><p>{'long, text ' * 20}</p></div><p>tag</p>").startswith("long, text")
    assert text(f"<div class='{wrapper}'><p>all there is</p></div>") == "all there is"
    for value in ("The hidden valley", "class=ad id=menu", "style='display:none'"):
        quote = '"' if "'" in value else "'"
        assert text(f"<article data-title={quote}{value}{quote}><p>kept, all</p></article>") == "kept, all"
    assert text("<article><p>kept, all</p><p title='x' hidden>gone</p><div class=comments><article><p>a, longer, comment, than, all</p></article></div></article>") == "kept, all"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<b>", "<", ">", "&", "text, ", '"', "<!--", "-->", "<script>", "</script>", "<a href=\"x", "<br/>", "<li>", "é"]), max_size=40))
def test_any_markup_is_read(parts):
    html_text.main_text(html_text.blocks("".join(parts)), None)


LONG_TEXT = "long, text " * 20


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='layout-sidebar-left'><p>{LONG_TEXT}</p></div>",
        f"<div class='site header-fixed'><p>{LONG_TEXT}</p></div>",
        f"<div id=search-results><p>{LONG_TEXT}</p></div><p>short</p>",
        f"<article><p>{LONG_TEXT}</p><p class='share-worthy'>keep one</p><p class=ad-hoc>keep two</p></article>",
        "<article><p>keep one</p><svg><path d=1><p>keep two</p></article>",
        f"<form><h1>keep one</h1><p>{LONG_TEXT}</p></form>",
        f"<form><article><h1>keep one</h1><p>{LONG_TEXT}</p></article><form>DROP</form></form>",
        f"<article><p>{LONG_TEXT}</p><iframe src=x><p>keep one</p></article>",
        f"<article><object>DROP<object>DROP</object>DROP</object><p>keep one {LONG_TEXT}</p></article>",
        f"<article><svg width=1><text>DROP</text></svg><p>{LONG_TEXT}</p><select><option>DROP<option>DROP</select> keep one <form>DROP</form></article>",
        f"<div class=entry><p>{LONG_TEXT}</p><div class=related-posts><p>DROP, it</p></div><div class=comments><p>{'DROP, all ' * 90}</p></div></div>",
    ],
)
def test_what_is_the_article(page):
    text = html_text.main_text(html_text.blocks(page), None)
    assert "DROP" not in text and text.count("keep") == page.count("keep") and ("long" in text) == ("long" in page)
