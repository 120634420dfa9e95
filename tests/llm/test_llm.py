"""Every operator against a brute-force version and on awkward rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tillcast.llm import bpe, caps, graph, html_text, lines, maxent, minhash, packing, quality, sharding, warc

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id bigint, text string, n_lines int, kept boolean, probability string"


def prose(seed: int, n: int) -> str:
    dice = random.Random(seed)
    return " ".join(dice.choice("Alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(dice.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 120)
    near = base.replace("alpha", "Alpha", 1).split()
    near[60] = "changed"
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, base),
        (5, base.upper()),
        (6, " ".join(near)),
        (7, "one two"),
        (8, "ONE  two"),
        (9, "A shared line of text\nown\n\nanother own line here"),
        (10, "  a shared LINE of text\t\nA shared line of text\nlast"),
        (11, prose(2, 30_000)),
        (12, "it's 　 odd <|endoftext|> ßé\r\n\r\n end "),
        (13, prose(3, 40)),
        (13, prose(3, 40)),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, 5, True, "x") for r in texts], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/", b"same"), (1, None, b"same"), (2, "x\ny", None), (5, "u", b""), (1, None, b"same"), (None, "n", b"same"), (4, "v", b"\xff\x00\r\n\r\n")]
    frame = spark.createDataFrame(rows, "record_id bigint, url string, payload binary")
    warc.write_archive(frame, f"{tmp_path}/a")
    back = warc.read_archive(spark, f"{tmp_path}/a").collect()
    found = sorted((r["id"] or -1, r["type"], r["refers_to"], r["payload_bytes"], r["digest"]) for r in back)

    def sha(x):
        return base64.b32encode(hashlib.sha1(x).digest()).decode()

    assert found == sorted(
        [
            (-1, "revisit", 1, 4, sha(b"same")),
            (1, "response", None, 4, sha(b"same")),
            (1, "response", None, 4, sha(b"same")),
            (2, "response", None, 0, sha(b"")),
            (3, "revisit", 1, 4, sha(b"same")),
            (4, "response", None, 6, sha(b"\xff\x00\r\n\r\n")),
            (5, "revisit", 2, 0, sha(b"")),
        ],
        key=lambda r: (r[0], r[1]),
    )
    for r in back:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert len(block) == length + 4 and block.endswith(b"\r\n\r\n")
        assert (bytes(r["payload"]) in block) == (r["type"] == "response" or not r["payload_bytes"])
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == 3
    warc.write_archive(frame, f"{tmp_path}/b", min_bytes=5)
    assert {r["type"] for r in warc.read_archive(spark, f"{tmp_path}/b").collect()} == {"response"}
    warc.write_archive(frame.limit(0), f"{tmp_path}/c")
    assert warc.read_archive(spark, f"{tmp_path}/c").count() == 0


def test_language_model(spark, docs, texts, empty):
    own = docs.withColumn("held_out", F.col("doc_id") == 6)
    found = maxent.score_texts(own).collect()
    heard = [(i, (t or "").encode().lower().split() + [None]) for i, t in texts]
    counts = Counter(w for i, ws in heard if i != 6 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, len(ws), sum(counts[w] > 0 for w in ws), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in heard)
    for r, w in zip(sorted(found, key=lambda r: (r["doc_id"], r["n_tokens"])), want):
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (*w[:3], n)
        assert r["base_score"] == pytest.approx(w[3]) and r["score"] <= 0
    assert maxent.score_texts(empty.withColumn("held_out", F.lit(False))).count() == 0


def test_language_model_is_a_distribution():
    rng = np.random.default_rng(0)
    logs = maxent.class_logs(rng.standard_normal((maxent.SLOTS, maxent.CLASSES)), np.arange(50))
    assert np.allclose(np.exp(logs).sum(axis=1), 1)


def near_copies_by_force(rows):
    sets = {}
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and either and 100 * both >= 75 * either:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_minhash(spark, docs, texts, empty):
    want = near_copies_by_force(texts)
    for r in minhash.near_copies(docs).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert minhash.near_copies(empty).count() == 0


def test_minhash_chain_in_a_bucket(spark):
    """Copies of copies: neighbours link, the ends do not."""
    dice, rows, words = random.Random(4), [], prose(9, 150).split()
    for i in range(40):
        rows.append((i, " ".join(words)))
        words = list(words)
        for _ in range(3):
            words[dice.randrange(len(words))] = f"new{dice.random()}"
    want = near_copies_by_force(rows)
    found = minhash.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == want


def family(n: int, seed: int = 6):
    """Copies of one text with two or three words changed: similarities from 0.7 to 0.8, and who links."""
    dice, words = random.Random(seed), prose(11, 200).split()
    rows, kept = [], np.ones((n, 196), dtype=np.float32)
    for i in range(n):
        own = list(words)
        for place in dice.sample(range(4, 196), dice.choice((2, 3, 3))):
            own[place] = f"new{i}x{place}"
            kept[i, place - 4 : place + 1] = 0
        rows.append((i, " ".join(own)))
    assert len(set(zip(*(words[k:] for k in range(5))))) == 196
    shared = kept @ kept.T
    linked = 100 * shared >= 75 * (2 * 196 - shared)
    label = list(range(n))
    while True:  # the smallest neighbour's label, until nothing changes
        new = np.where(linked, np.array(label)[None, :], n).min(axis=1)
        if (new == label).all():
            return rows, label
        label = new.tolist()


def test_minhash_of_a_family_at_the_threshold(spark, tmp_path, monkeypatch):
    """Pairs handed on grow with the documents, not with their square, and no link is lost."""
    handed = {}
    for n in (500, 2000):
        monkeypatch.setattr(minhash, "workspace", lambda *_: f"{tmp_path}/{n}")
        rows, label = family(n)
        found = minhash.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8))
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == dict(enumerate(map(int, label)))
        handed[n] = sum(
            spark.read.parquet(f"{tmp_path}/{n}/{t}").count() for t in ("tried-0", "across") if (tmp_path / f"{n}/{t}").exists()
        )
    assert handed[500] < 32 * 500 and handed[2000] < 6 * handed[500]


def test_shared_counts():
    rng = np.random.default_rng(3)
    sides = [[np.unique(rng.integers(0, 9000, rng.integers(0, 6000), dtype=np.uint64)) for _ in range(n)] for n in (7, 5)]
    want = [[len(np.intersect1d(x, y)) for y in sides[1]] for x in sides[0]]
    assert minhash.shared_counts(sides).tolist() == want
    nothing = [np.zeros(0, np.uint64)]
    assert minhash.shared_counts([nothing, sides[1]]).tolist() == [[0] * 5]


def test_links_across_blocks_are_a_forest_in_the_first_bucket(spark):
    """Against all pairs of hand-made sets, over one and over several blocks."""
    rng, rows = np.random.default_rng(4), []
    sets = []
    for i in range(120):
        keys = np.arange(100, dtype=np.uint64)
        keys[rng.choice(100, 7, replace=False)] = rng.integers(1000, 1 << 40, 7, dtype=np.uint64)
        sets.append(np.unique(keys))
        rows.append((i, [7, 3 if i % 2 else 4], sets[-1].tobytes()))
    batch = lambda rs: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rs], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))], names=list("abcdefgh"))
    want = {(j, i) for i in range(120) for j in range(i + 1, 120) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert 20 < len(want)
    for blocks in (1, 3):
        found = {True: set(), False: set()}
        for forest in (True, False):
            for bucket in (3, 4, 7):
                inside = [r for r in rows if bucket in r[1]]
                for one in range(blocks):
                    for other in range(one, blocks):
                        meeting = [(bucket, one, other, 0, i, i, b, k) for i, b, k in inside if i % blocks == one]
                        meeting += [(bucket, one, other, 1, i, i, b, k) for i, b, k in inside if i % blocks == other] if one != other else []
                        for out in minhash._links_across(forest)(iter([batch(meeting)])):
                            pairs = list(zip(*(c.to_pylist() for c in out.columns)))
                            assert not found[forest] & set(pairs)  # each in one bucket only
                            found[forest] |= set(pairs)
        assert found[False] == want and found[True] <= want
        root = {True: list(range(120)), False: list(range(120))}
        for forest, label in root.items():
            for _ in range(120):
                for a, b in found[forest]:
                    label[a] = label[b] = min(label[a], label[b])
        assert root[True] == root[False]


def test_components_of_a_hub(spark, tmp_path):
    """A star of 100,000 leaves and a chain; the hub's join is divided over tasks."""
    links = spark.range(1, 100_001).selectExpr("id AS a", "0L AS b").unionByName(
        spark.range(200_000, 200_050).selectExpr("id + 1 AS a", "id AS b")
    )
    found = graph.components(links, f"{tmp_path}/graph")
    counts = {r["component"]: r["count"] for r in found.groupBy("component").count().collect()}
    assert counts == {0: 100_001, 200_000: 51}
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    }
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        step = graph._to_smaller(graph._to_larger(links))
        step.collect()
        assert "skew=true" in step._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_caps(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 64))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in v + 0.25 * rng.standard_normal(64)]) for i, v in enumerate(base)]
    rows += [(300, rows[0][1]), (301, [2 * x for x in rows[0][1]]), (300, rows[0][1])]
    odd = [(400, None), (401, []), (402, [0.0] * 64), (403, [None] + [1.0] * 63), (404, [float("nan")] * 64), (405, [float("inf")] * 64), (None, rows[0][1])]
    found = caps.linked_vectors(spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")).collect()
    assert len(found) == len(rows + odd)
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    links = Counter()
    for k, (i, _) in enumerate(rows):
        links[i] = int(near[k].sum()) - 1
    by_id = {r["vec_id"]: r for r in found}
    total = sum(links[i] for i in links)
    assert sum(by_id[i]["n_links"] for i in links) >= 0.99 * total > 0
    assert all(by_id[i]["n_links"] <= links[i] for i in links)
    assert by_id[300]["component_id"] == 0 and by_id[301]["component_id"] == 0
    for i, _ in odd:
        assert by_id[i]["n_links"] == 0 and by_id[i]["component_id"] == i and by_id[i]["kept"]


@pytest.mark.parametrize("n", [20_000, 1_000_000, 10_000_000])
def test_caps_recall_at_any_number_of_filters(n):
    words = caps.words_for(n)
    t = caps.threshold(64, words)
    for cosine, missed in ((0.9, 0.003), (0.95, 0.001)):
        owned = []
        for side in caps.pairs_at(64, 3_000, cosine, 9):
            row, cap = caps.decoded(side, words, t)
            assert np.bincount(row, minlength=3_000).min() >= caps.FEWEST
            assert len(row) < 60 * 3_000
            owned.append(set(zip(row.tolist(), cap.tolist())))
        met = {row for row, _ in owned[0] & owned[1]}
        assert len(met) >= (1 - missed) * 3_000


@pytest.mark.parametrize("low, high, fewer", [(200, 1400, 6), (300, 900, 12), (500, 1030, 30)])
def test_packing_evolves_beyond_best_fit(spark, tmp_path, low, high, fewer):
    """On pieces that leave gaps: fewer bins than best-fit decreasing, and fewer still over epochs."""
    dice = random.Random(1)
    sizes = [dice.randrange(low, high) for _ in range(4096)]
    plain: list[list[int]] = []
    packing.Room(plain, sizes, 2048).best_fit(sorted(range(4096), key=lambda i: -sizes[i]))
    people = packing.evolved(sizes, [], 2048, random.Random(2))
    for bins in people:
        assert sorted(i for held in bins for i in held) == list(range(4096))
        assert max(sum(sizes[i] for i in held) for held in bins) <= 2048
    counts = [len(bins) for bins in people]
    assert counts == sorted(counts) and len(people) == packing.POPULATION and counts[0] <= len(plain) - fewer
    later = packing.evolved(sizes, people, 2048, random.Random(3))
    assert len(later[0]) <= counts[0]
    if low == 200:
        items = spark.createDataFrame(list(enumerate(sizes)), "item bigint, length bigint")
        items.write.parquet(f"{tmp_path}/items")
        packed = packing.pack_items(spark.read.parquet(f"{tmp_path}/items"), f"{tmp_path}/work").toPandas()
        assert packed.sequence_id.nunique() <= len(plain) - fewer and len(packed) == 4096
        island = spark.read.parquet(f"{tmp_path}/work/epoch-1").collect()
        assert [len(r["plans"]) for r in island] == [packing.POPULATION] * packing.ISLANDS


def test_packing_of_special_names_and_long_words(spark):
    """Ids are those of the plain call: a special token's name in a text is that token."""
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "x<|endoftext|>y z", "a" * 30_000, "plain words"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tokenizer = Tokenizer.from_file(JSON)
    found = packing.pack_documents(rows, JSON, keep_ids=True).orderBy("doc_id", "piece").collect()
    for k, text in enumerate(texts):
        ids = [i for r in found if r["doc_id"] == k for i in np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist()]
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids + [0]
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [31373, 220, 50256, 995]


def test_packing(spark, docs, texts, empty):
    found = packing.pack_documents(docs, JSON, keep_ids=True).toPandas()
    tokenizer = Tokenizer.from_file(JSON)
    want = Counter()
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        at, end, piece = 0, (len(ids) - 1) % 2048 + 1, 0
        while at < len(ids):
            own = np.array(ids[at:end], dtype="<u4").tobytes()
            want[(i, piece, at, end - at, zlib.crc32(own), own)] += 1
            at, end, piece = end, end + 2048, piece + 1
    assert Counter(found[["doc_id", "piece", "start", "length", "ids_crc32", "ids"]].itertuples(index=False, name=None)) == want
    for _, held in found.sort_values("offset").groupby("sequence_id"):
        assert held.offset.tolist() == [0, *held.length.cumsum()[:-1]] and held.length.sum() <= 2048
    assert found.sequence_id.nunique() == -(-found.length.sum() // 2048)
    assert packing.pack_documents(empty, JSON).count() == 0


def test_crossover_keeps_every_piece():
    dice = random.Random(2)
    sizes = [dice.randrange(1, 700) for _ in range(300)]
    best = packing.evolved(sizes, [], 1000, dice)
    assert sorted(p for held in best for p in held) == list(range(300))
    assert max(sum(sizes[p] for p in held) for held in best) <= 1000
    child = packing.crossed(best, packing.evolved(sizes, [], 1000, dice), sizes, 1000, dice)
    assert sorted(p for held in child for p in held) == list(range(300))


def test_html(spark):
    page = (
        "<!DOCTYPE html><html><head><title>t</title><script>var t='</p>';</script></head><body>"
        "<nav><ul><li><a href=/>menu</a></ul></nav><div class='ad'>buy</div><div id=box>Site of {0}</div>"
        "<article><h1>Head &amp; {0}</h1><p><b>bold {0}<br>next\n  line<p>A quoted passage.</p>"
        "<div class=promo-box>x</div><section><div>Follow us</div></section><!-- no <p> --><p>1 &lt; 2 &eacute;</p></article>"
        "<div class=comments><p>reader</p></div><footer>&copy; {0}</footer>"
    )
    rows = [(k, "http://h.example/a", page.format(k)) for k in range(8)]
    rows += [(20, None, None), (21, "", "plain  text"), (22, "x", "<p>a<p>b</td><i>c</i>d < e"), (23, "http://h.example", "<p" * 50)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("own"))
    found = {r["page_id"]: r["text"] for r in html_text.extract_text(frame).collect()}
    for k in range(8):
        assert found[k] == f"Head & {k}\n\nbold {k} next line\n\nA quoted passage.\n\n1 < 2 é"
    assert (found[20], found[21], found[22]) == ("", "plain text", "a\n\nbcd < e")
    assert html_text.extract_text(frame.limit(0)).count() == 0


def plain_text(page: str) -> str:
    return html_text.main_text(html_text.parse(page), set())


@pytest.mark.parametrize(
    "name", ["has-sidebar", "page-with-nav", "content no-sidebar", "content-sidebar-wrap", "single-related", "sidebar", "notice"]
)
def test_html_names_round_the_article(name):
    """A layout class takes nothing away; inside of an article whole names do."""
    assert plain_text(f"<nav>menu</nav><div class='{name}'><article><h1>T</h1><p>x y</p></article></div>") == "T\n\nx y"
    inside = plain_text(f"<article><p>a</p><div class='{name}'><p>b</p></div></article>")
    assert inside == ("a" if name in ("sidebar", "notice") else "a\n\nb")


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article class='post comments-open'><p>a</p></article>", "a"),
        ("<article><p>a</p><div class='search-theory'><p>b</p></div></article>", "a\n\nb"),
        ("<form action=/><article><p>a</p></article></form>", "a"),
        ("<article><p>a</p></article><div class=comments><article><p>c</p></article></div>", "a"),
        ("<div class='related'><article><p>teaser</p></article></div><article><p>a</p></article>", "a"),
        ("<article class=comment><p>c</p></article><main><p>a</p></main>", "a"),
        ("<div class='cookie-banner'>x</div><p>a</p><div class='ad-slot'>y</div><aside>z</aside>", "a"),
        ("<div class=notice><h1>Head</h1></div><p>a", "Head\n\na"),
        ("<p title='a>b'>c<b x=\"'>\">d</b> 1 < 2 </p></i></p><li>e<li>f", "cd 1 < 2\n\ne\n\nf"),
        ("a <b", "a <b"),
        ("<p>x<!-- <p>y", "x"),
        ("<p>a<a href='x>b</p>", "ab"),
    ],
)
def test_html_pages(page, text):
    assert plain_text(page) == text


def test_html_of_copied_pages(spark):
    """Texts that several pages of a host carry stay; boxes on most of its pages go."""
    box = "<div class=letter><h3>Our letter</h3><p>Get it weekly.</p></div>"
    rows = [(k, f"<article><h1>{k}</h1><p>{prose(100 + k, 40)}</p>{box}</article>") for k in range(205)]
    body = f"<p>{prose(1, 60)}</p><p>{prose(2, 60)}</p>"
    shapes = ("<article><div class=body>{}</div></article>", "<div>{}</div>", "<article><section>{}</section><p>x</p></article>")
    for n, shape in enumerate(shapes):  # the same text on pages that differ in their menus, and plain copies
        rows += [(1000 + 100 * n + k, f"<nav>{k}</nav>" + shape.format(body)) for k in range(6)]
        rows += [(1050 + 100 * n + k, shape.format(body)) for k in range(30)]
    # A host that has nothing but one text.
    few = [(5000 + k, f"<nav>{k}</nav><div>{body}</div>") for k in range(7)]
    frame = spark.createDataFrame(
        [(i, "http://a.example/", h) for i, h in rows] + [(i, "http://b.example/", h) for i, h in few],
        "page_id bigint, url string, html string",
    )
    found = {r["page_id"]: r["text"] for r in html_text.extract_text(frame).collect()}
    for k in range(205):
        assert found[k] == f"{k}\n\n{prose(100 + k, 40)}"
    for i in found:
        if i >= 1000:
            assert found[i].startswith(f"{prose(1, 60)}\n\n{prose(2, 60)}"), i


def test_html_counts_of_subtrees(spark):
    """Against a count of every subtree over the different pages of a small site."""
    dice = random.Random(7)
    part = lambda: dice.choice(["<div id=a>x</div>", "<ul><li>m<li>n</ul>", "<p>text</p>", f"<div>{dice.randrange(3)}</div>", "<section><h2>s</h2></section>"])
    pages = [("h", "".join(part() for _ in range(4))) for _ in range(60)] + [("g", "<div>1</div>")] * 9
    frame = spark.createDataFrame(pages + pages[:30], "site string, html string")
    counts, texts, total = Counter(), {}, Counter(s for s, _ in set(pages))
    for site, page in set(pages):
        left, seen = [html_text.parse(page)], set()
        while left:
            e = left.pop()
            children = [x for x in e.parts if not isinstance(x, str)]
            left += children
            if e.tag and e.parts:
                seen.add(e.hash)
                texts[e.hash] = "<p>" in page and e.tag == "p" or e.tag in ("section", "h2")
        counts.update((site, n) for n in seen)
    want = {k for k, n in counts.items() if n >= 5 and n >= (0.5 if texts[k[1]] else 0.3) * total[k[0]]}
    assert want and {(r["site"], r["node"]) for r in html_text.recurring(frame, 5, 0.3).collect()} == want


@pytest.mark.parametrize("page", ["<a ", "<b>", "</i>", "<a '", "<p><object><h1>", "<!", "<li>", "<p>x", "&amp", "<a b=\"'>"])
def test_html_takes_time_in_proportion(page):
    """A megabyte of what is never closed, or never opened, in seconds."""
    long = page * (1_000_000 // len(page))
    start = time.perf_counter()
    plain_text(long[: len(long) // 4])
    plain_text("<b>" * 50_000 + long[: len(long) // 4])
    assert time.perf_counter() - start < 60


def test_bpe(spark, docs, texts, empty):
    found = bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN, ("ids", "decoded", "n_tokens")).collect()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = sorted((i, own.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts)
    assert sorted((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in found) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in found)
    assert bpe.encode_and_decode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def long_words():
    dice = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    glued = [w for w in prose(9, 60).split()]
    return {
        "random": "".join(dice.choices(letters, k=100_000)),
        "equal": "a" * 100_003,
        "dashes": "-" * 100_001,
        "period of three": "=-_" * 20_001,
        "words without blanks": re.sub(r"[^a-z]", "", "".join(dice.choices(glued, k=4000)).lower()),
        "two letters": "".join(dice.choices("ab", k=5000)),
        "no letters of ASCII": "語言模型" * 3000,
    }


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.mark.parametrize("name", list(long_words()))
def test_bpe_of_long_words(codec, name):
    word = long_words()[name]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    began = time.time()
    (ids, decoded), other = codec.encode([word.encode(), b"other"])
    assert time.time() - began < 60
    assert [int(x) for x in ids.split()] == own._encode_single_piece(word)
    assert decoded == word.encode() and other[1] == b"other"


def test_bpe_forgets_rare_words(codec, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    held = bpe.Texts(codec)
    for seed in range(8):
        texts = [prose(seed, 30) + " it's,  odd\t" + prose(99, 20), "", prose(99, 20)]
        found = list(held.encode(texts))
        assert [[int(x) for x in ids.split()] for ids, _ in found] == [own.encode_ordinary(t) for t in texts]
        assert [decoded.decode() for _, decoded in found] == texts
    assert len(held.parts) < 200


@pytest.mark.parametrize("letters", ["ab", "aeiounst", "=-*"])
def test_bpe_windows_at_any_width(codec, monkeypatch, letters):
    monkeypatch.setattr(bpe, "LONG", 8)
    monkeypatch.setattr(bpe, "WINDOW", 8)
    monkeypatch.setattr(bpe, "WIDER", 2)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    dice = random.Random(6)
    words = ["".join(dice.choices(letters, k=dice.randrange(1, 150))) for _ in range(150)]
    found = codec.encode([w.encode() for w in words])
    assert [[int(x) for x in ids.split()] for ids, _ in found] == [own._encode_single_piece(w) for w in words]


def lines_by_force(rows):
    def key(line):
        return line.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()

    owner = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                owner.setdefault(key(line), i)
    return [(i, "\n".join(x for x in (t or "").split("\n") if owner.get(key(x), i) == i)) for i, t in rows]


@pytest.mark.parametrize("batches", [1, 4])
def test_lines(spark, docs, texts, empty, batches):
    found = lines.dedup_lines(docs, batches)
    assert found.columns == ["doc_id", "text", "kept", "probability", "n_lines", "n_dropped"]
    assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == sorted(lines_by_force(texts))
    assert lines.dedup_lines(empty, batches).count() == 0


def test_lines_with_null_ids(spark):
    rows = [(None, "a line that is shared"), (3, "a line that is shared\nx"), (None, "only without an id")]
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter([(None, ""), (3, rows[1][1]), (None, rows[2][1])])


def test_sharding(spark, docs, texts, empty):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.repeat(F.lit("x"), (F.col("id") % 90).cast("int"))).alias("text"))
    for frame, shards in ((docs.select("doc_id", "text"), 3), (many, 10)):
        found = sharding.shard_by_bytes(frame, shards).toPandas()
        assert len(found) == frame.count()
        for _, held in found.groupby("shard"):
            assert sorted(held.slot) == list(range(len(held)))
        sizes = found.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
        assert (abs(sizes - found["size"].sum() / shards) <= found["size"].max() * 2 + 0.02 * found["size"].sum() / shards).all()
    assert sorted(zip(found["size"], found.text_crc32)) == sorted((len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in many.collect())
    assert sharding.shard_by_bytes(empty).count() == 0


def test_sharding_keeps_groups_whole(spark):
    """One text of a third of all bytes, groups of many sizes: only what is larger than the room of a shard is divided."""
    dice = random.Random(8)
    rows = [(k, "h" * 500) for k in range(2000)]
    groups = [dice.choice([2, 2, 2, 5, 40, 300, 900]) for _ in range(700)]
    for g, n in enumerate(groups):
        width = dice.randrange(1, 60)
        rows += [(10_000 + len(rows) + k, f"{g} " + "x" * width) for k in range(n)]
    rows += [(900_000 + k, f"single {k}") for k in range(4000)] + [(None, None), (None, None), (5, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sharding.shard_by_bytes(frame, 20).toPandas()
    assert sorted(zip(found["size"], found.text_crc32)) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    for _, held in found.groupby("shard"):
        assert sorted(held.slot) == list(range(len(held)))
    share = found["size"].sum() / 20
    sizes = found.groupby("shard")["size"].sum().reindex(range(20), fill_value=0)
    assert (abs(sizes - share) <= 0.03 * share).all()
    whole = found.groupby(["text_crc32", "size"])
    divided = [g["size"].sum() for _, g in whole if g.shard.nunique() > 1]
    # The text of a third of all bytes must be divided; of the others none that would have fitted.
    assert len(divided) == 1 and divided[0] > share


def test_room_for_heavy_groups():
    pieces, free = sharding.room_for([(1, 250), (2, 60), (3, 60), (4, 30)], 4, 100.0)
    assert sum(n for k, n in pieces[0]) == 250 and pieces[1:] == [[(3, 60)], [(2, 50), (3, 10)], [(3, 30)]]
    assert abs(sum(free)) < 1e-9


def measures_by_force(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7))
    repeated = {k + j for k in range(len(ws) - 7) if windows[tuple(ws[k : k + 8])] > 1 for j in range(8)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated)


def test_quality_measures(spark, docs, texts, empty):
    rows = [*texts, (20, "a b c d e f g h " * 5), (21, "é#*\n\né#*\n \nx\x0by|z\n"), (22, "\n\n\n")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = quality.score_quality(frame, None).collect()
    got = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found)
    assert got == sorted((i, *measures_by_force(t)) for i, t in rows)
    for r in found:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed)
    assert quality.score_quality(empty, None).count() == 0
    kept = quality.keep_good(docs, None)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 11, 13}


def test_quality_classifier_on_held_out_rows(spark):
    rows = [(i, prose(i, 60) if i % 2 else " ".join(w + "!!" for w in prose(i, 60).upper().split()), i % 2) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = quality.fit_quality_model(frame.where("doc_id < 120"))
    for r in quality.score_quality(frame.where("doc_id >= 120"), model).collect():
        assert r["kept"] == (r["doc_id"] % 2 == 1)
    assert quality.fit_quality_model(frame.where("quality = 1")) is None


def test_pipeline_stages(spark, tmp_path, texts):
    rows = [(i, prose(i, 80), "en", "s", 0) for i in range(100, 140)] + [(i, t, "en", "s", 0) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = at
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns and at.count() <= before.count(), name
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    # The only line of document 5 is one of document 4: it stays as an empty document.
    assert set(packed.doc_id) == {4, 5, 11, 13, *range(100, 140)}
