"""Backtracking BPE, filter audit and Merkle manifest against brute-force versions and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillcast.llm import audit, backtracking, merkle, queries

JSON = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, place int, tree string, part int, words string"
EXTRA = ("x", 1, "t", 2, "w")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# --- op11 -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def awkward_texts() -> list[str | None]:
    dice = random.Random(3)
    letters = "".join(chr(dice.choice([32, 10, 9, 13, 39, 45, 61, 97, 115, 0xA0, 0x85, 0x3000])) for _ in range(500))
    any_char = "".join(chr(c) for c in (dice.randrange(0x110000) for _ in range(2000)) if not 0xD800 <= c < 0xE000)
    return [
        None,
        "",
        " ",
        "hello <|endoftext|> world",
        "<|endoftext|><|endoftext|>",
        "it's they'll  I'M\r\n\r\n end ",
        letters,
        any_char,
        "".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)),
        "a" * 100_000,
        " " * 5_000 + "x",
        "=-" * 20_000,
        "same text",
        "same text",
    ]


def test_encoder_gives_the_tokenizers_ids(spark, tokenizer):
    texts = awkward_texts()
    rows = [(k, t, "l", "s", 1, *EXTRA) for k, t in enumerate(texts)] + [(None, "same text", "l", "s", 1, *EXTRA)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    want = [tokenizer.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    plain = backtracking.encode_texts(docs, JSON)
    assert dict(plain.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    found = sorted(plain.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [r["ids"] for r in found] == want
    for encoded in (plain, backtracking.encode_texts(docs, JSON, packed=True)):
        back = backtracking.decode_ids(encoded, JSON).collect()
        assert sorted((r["doc_id"] or -1, r["text"]) for r in back) == sorted((r[0] or -1, r[1] or "") for r in rows)


def test_every_token_is_what_merging_makes_of_its_bytes():
    """The encoder takes a word that is a token as that token."""
    tables = backtracking.vocabulary(JSON)
    for token in range(256, len(tables.spelling)):
        left, right = tables.halves[token]
        assert tables.joined[left, right] == token
        before, behind = tables.right_edge(left), tables.left_edge(right)
        # No other merge crosses its middle before its own.
        crossing = {tables.joined.get((a, b), token) for a in before for b in behind}
        assert tables.compatible(left, right) is False and token in crossing


def test_pairs_as_merging_leaves_them():
    tables, dice = backtracking.vocabulary(JSON), random.Random(5)

    def merged(word: bytes) -> list[int]:
        parts = [tables.age[bytes([b])] for b in word]
        while True:
            ranks = [(tables.joined[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in tables.joined]
            if not ranks:
                return parts
            token, i = min(ranks)
            parts[i : i + 2] = [token]

    for _ in range(20_000):
        a, b = dice.randrange(3000), dice.randrange(3000)
        assert tables.compatible(a, b) == (merged(tables.spelling[a] + tables.spelling[b]) == [a, b])
    for token in dice.sample(range(len(tables.spelling)), 3000):
        assert merged(tables.spelling[token]) == [token]


def test_decoder_takes_any_ids(spark, tokenizer):
    dice = random.Random(4)
    lists = [[dice.randrange(50_257) for _ in range(dice.randrange(30))] for _ in range(300)]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(lists)] + [(-1, None), (-2, [99_999_999, None, 31373])], "doc_id int, ids array<int>")
    found = {r["doc_id"]: r["text"] for r in backtracking.decode_ids(frame, JSON).collect()}
    assert [found[k] for k in range(300)] == [tokenizer.decode(x, skip_special_tokens=False) for x in lists]
    assert (found[-1], found[-2]) == ("", "hello")
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert backtracking.decode_ids(backtracking.encode_texts(empty, JSON), JSON).count() == 0


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        backtracking.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_codec_query(spark, tokenizer, tmp_path):
    texts = awkward_texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_backtracking(spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, dtype="<u4").tobytes()
        assert found[k] == (len(ids), sha(packed), sha(tokenizer.decode(ids, skip_special_tokens=False)))


# --- op12 -------------------------------------------------------------------------------


def test_positional_counts():
    dice = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 100, 12_345):
        words = dice.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        assert audit.positional_counts(words).tolist() == [int(((words >> b) & 1).sum()) for b in range(32)]


def brute_audit(docs: list[tuple], labels: list[tuple]) -> dict:
    first: dict[str, int] = {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    judged = []
    for doc_id, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": text in first and (doc_id is None or first[text] < doc_id),
        }
        judged.append((lang or "", doc_id, fails))
    out = {}
    for part in {p for p, _, _ in judged}:
        own = [(i, f) for p, i, f in judged if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if x[1][letter]]
                left = [x for x in left if not x[1][letter]]
                failing = sum(f[letter] for _, f in own)
                unique = sum(f[letter] and sum(f.values()) == 1 for _, f in own)
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), unique,
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), letter,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]]
    return out


def audit_rows() -> tuple[list[tuple], list[tuple]]:
    dice = random.Random(9)
    varied = " ".join(f"w{dice.randrange(10**6)}" for _ in range(150))
    texts = [None, "", " \t", varied, varied + " $", varied.upper(), "same " * 200, "SAME WORDS", "one two", "one two ", "x" * 200_000]
    docs = [(k, dice.choice(texts), dice.choice(["en", "de", None, ""]), "s", 1, *EXTRA) for k in range(200)]
    docs += [(5, texts[8], "en", "s", 1, *EXTRA)] * 3 + [(None, texts[8], "en", "s", 1, *EXTRA), (None, "alone", "fr", "s", 1, *EXTRA)] * 2
    labels = [(k, dice.choice([0, 1, None]), dice.choice([0, 1, None])) for k in range(0, 300, 2)]
    return docs, [*labels, *labels[:20], (None, 1, 1), (4, 1, 0), (4, 0, 1)]


def test_audit_is_brute_force(spark):
    docs, labels = audit_rows()
    found = audit.audit_filters(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    rows = found.collect()
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in rows}
    assert len(rows) == len(got) and got == brute_audit(docs, labels)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit.audit_filters(spark.createDataFrame([], DOCS), labels).count() == 0
    one = audit.audit_filters(spark.createDataFrame([(1, "a", None, "s", 1, *EXTRA)], DOCS), labels)
    assert one.count() == 600 and {r["part"] for r in one.collect()} == {""}


def test_parts_are_summed_over_tasks(spark):
    rows = spark.range(5000).select((F.col("id") % 700).cast("string").alias("part"), (F.col("id") % 32).cast("int").alias("failed"), F.lit(0).alias("good"), F.lit(1).alias("toxic"))
    counted = audit.survivors(rows).collect()
    assert len(counted) == 700 and sum(r["survivors"][0] for r in counted) == 5000


# --- op13 -------------------------------------------------------------------------------


def brute_manifest(rows: list[tuple]) -> list[tuple]:
    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def leaf(doc_id, text, lang, source, n_chars):
        return sha("".join(map(field, (doc_id, source, lang, n_chars, text))))

    def tree(slots: list[str]):
        levels = [slots]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            out.append((at & 1, level[at ^ 1] if at ^ 1 < len(level) else ""))
            at >>= 1
        return out

    by_lang: dict = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        own = leaf(doc_id, text, lang, source, n_chars)
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        shown = leaf(doc_id, text, lang, source, None if n_chars is None else n_chars + 1) if bad else own
        by_lang.setdefault(lang, []).append((doc_id is not None, doc_id or 0, own, shown))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([r[2] for r in sorted(by_lang[x])]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for at, (known, doc_id, own, shown) in enumerate(sorted(by_lang[x])):
            steps = path(trees[x], at) + path(top, k)
            folded = shown
            for side, other in steps:
                folded = sha(other + folded if side else folded + other)
            out.append((doc_id if known else None, own, trees[x][-1][0], top[-1][0], sha("".join(s for _, s in steps)), folded, folded == top[-1][0]))
    return out


def check_manifest(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_merkle(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute_manifest(rows), key=repr)


def test_manifest_is_brute_force(spark, tmp_path):
    """One tree higher than a group, one of a single leaf more than a group, small ones, a lone leaf."""
    dice = random.Random(8)
    ids = dice.sample(range(-(10**12), 10**12), 400) + list(range(5000, 8100))
    rows = [(i, f"text {i}", "en", "s", i, *EXTRA) for i in ids]
    rows += [(i, f"é {i}", "de", None, None, *EXTRA) for i in range(1025)]
    rows += [(i, None, dice.choice([None, "", "fr", "é"]), "", 7, *EXTRA) for i in (3, -1, -(2**63), 2**63 - 1, 64, 63)]
    rows += [(77, "lone", "zz", "s", 2**63 - 1, *EXTRA)]
    check_manifest(spark, tmp_path, rows)


def test_manifest_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(i, f"text {i % 3}", "en", "s", 1, *EXTRA) for i in [1, 1, 1, 2, 64, 64, 65, 130, 7, 7, 7, 7, *range(200, 300)]]
    rows += [(7, f"other {i}", "en", "s", 1, *EXTRA) for i in range(50)]
    rows += [(None, f"none {i}", "en", "s", 1, *EXTRA) for i in range(9)] + [(None, "same", None, "s", 1, *EXTRA)] * 5
    check_manifest(spark, tmp_path, rows)


def test_manifest_of_nothing_and_of_one(spark, tmp_path):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, "t", "en", "s", 1, *EXTRA)], DOCS)).collect()
    assert [(r["leaf"], r["path"]) for r in one] == [(one[0]["root"], [])] and one[0]["leaf"] == one[0]["subroot"]


def test_more_trees_than_a_group(spark):
    """The tree of roots has several levels of groups, too."""
    rows = [(i, "t", f"l{i % 1500:04}", "s", 1, *EXTRA) for i in range(1600)]
    found = merkle.manifest(spark.createDataFrame(rows, DOCS)).select(
        "root", merkle.folded(F.col("leaf"), F.col("path")).alias("folded"), F.size("path").alias("n")
    )
    rows = found.collect()
    assert {r["root"] for r in rows} == {r["folded"] for r in rows} and len({r["root"] for r in rows}) == 1
    assert {r["n"] for r in rows} == {11, 12}
