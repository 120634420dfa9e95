"""The language model against a brute-force version over strings, and pairs of words with equal endings."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.llm import maxent

SCHEMA = "doc_id bigint, held_out boolean, text string"
END = None


def tokens_of(text: str | None) -> list[bytes | None]:
    raw = (text or "").encode()
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w] + [END]


def hash_and_suffix(word: bytes) -> tuple[int, int]:
    hashes, suffix, _ = maxent.hashed_words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
    return int(hashes.view(np.int64)[0]), int(suffix[0])


class Brute:
    """The model with a class softmax of zero weights: all classes that occur have one chance."""

    def __init__(self, texts: list[str | None]) -> None:
        runs = [tokens_of(t) for t in texts]
        self.c = Counter(w for run in runs for w in run)
        self.n = sum(self.c.values())
        names = [w for w in self.c if w is not END]
        top = sorted(names, key=lambda w: (-self.c[w], hash_and_suffix(w)[0]))[: maxent.SINGLE - 1]
        self.kind = {w: maxent.SINGLE + hash_and_suffix(w)[1] % maxent.SUFFIX for w in names}
        self.kind |= {w: i + 1 for i, w in enumerate(top)} | {END: 0}
        self.total = Counter()
        for w, n in self.c.items():
            self.total[self.kind[w]] += n
        self.by: dict = defaultdict(Counter)
        for run in runs:
            for before, w in zip([END, *run], run):
                self.by[before][self.kind[w]] += 1
                self.by[before, self.kind[w]][w] += 1
        once = sum(n == 1 for n in self.c.values())
        self.unknown = min(0.5, (once + 1) / (self.n + 2))

    def mixed(self, context, item, coarse: float) -> float:
        seen = self.by.get(context, Counter())
        kept = {k: n - 0.5 for k, n in seen.items() if n >= 2}
        total = sum(seen.values()) + 1
        return (kept.get(item, 0) + (total - sum(kept.values())) * coarse) / total

    def chance(self, before, w) -> float:
        if w not in self.c:
            return self.unknown
        kind = self.kind[w]
        found = self.mixed(before, kind, 1 / len(self.total))
        if kind >= maxent.SINGLE:
            found *= self.mixed((before, kind), w, self.c[w] / self.total[kind])
        return found * (1 - self.unknown)

    def score(self, text: str | None) -> float:
        run = tokens_of(text)
        return sum(math.log10(self.chance(a, b)) for a, b in zip([END, *run], run))


@pytest.fixture(scope="module")
def corpus():
    dice = random.Random(5)
    names = ["w" + "".join(dice.choice("abcde") for _ in range(dice.randrange(1, 5))) for _ in range(150)]
    texts = [" ".join(dice.choice(names[: dice.choice((20, 150))]) for _ in range(dice.randrange(60))) for _ in range(90)]
    texts += [None, "", " \n", "Wa WA wa", texts[3], texts[3], "never seen words", "ß　x"]
    return [(i if i % 11 else None, None if i % 10 == 9 else i % 7 == 2, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("partitions", [1, 30])  # as many blocks and ranges, at least 8
def test_scores_equal_a_brute_force_version(spark, corpus, monkeypatch, partitions):
    monkeypatch.setattr(maxent, "trained", lambda cells: np.zeros((maxent.SLOTS, maxent.CLASSES)))
    rows = [(n, *row[1:]) for n, row in enumerate(corpus)]
    brute = Brute([text for _, out, text in rows if not out])
    frame = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    found = {r["doc_id"]: r for r in maxent.score_texts(frame).collect()}
    assert len(found) == len(rows)
    for doc_id, out, text in rows:
        run, row = tokens_of(text), found[doc_id]
        assert row["n_tokens"] == len(run) and row["n_known"] == sum(w in brute.c for w in run)
        assert row["held_out"] == bool(out) and row["train_tokens"] == brute.n
        assert row["score"] == pytest.approx(brute.score(text), rel=1e-6)
    for before in (END, b"wa", b"never", *list(brute.c)[:20]):
        total = sum(brute.chance(before, w) for w in brute.c) + brute.unknown
        assert total == pytest.approx(1)


def test_null_ids_and_extra_columns(spark, corpus):
    frame = spark.createDataFrame(corpus, SCHEMA).withColumn("block", F.lit("x")).withColumn("score", F.lit(1))
    found = maxent.score_texts(frame).collect()
    assert len(found) == len(corpus) and sum(r["doc_id"] is None for r in found) == sum(r[0] is None for r in corpus)
    assert all(r["score"] <= 0 for r in found)


def test_a_seen_pair_scores_above_an_unseen_one_of_the_same_endings(spark):
    filler = [f"{a}{b}cat {b}{a}dog" for a in "pqrstuvw" for b in "klmnopqr"]
    rows = [(i, False, t) for i, t in enumerate(["redcat bluedog", "greencat blackdog"] * 300 + filler * 3)]
    asked = ["redcat bluedog", "redcat blackdog", "greencat blackdog", "greencat bluedog"]
    rows += [(10_000 + i, True, t) for i, t in enumerate(asked)]
    found = {r["doc_id"]: r["score"] for r in maxent.score_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[10_000] > found[10_001] + 1 and found[10_002] > found[10_003] + 1


def test_ranges_hold_whole_contexts_and_answers_their_pairs():
    dice = np.random.default_rng(3)
    cells = maxent._cells_of(dice.integers(0, 40, 3000).astype(np.uint64))
    keys, place = maxent.distinct(cells | dice.integers(0, 30, 3000).astype(np.uint64))
    n = np.bincount(place)
    pair, rest = maxent.outcomes(keys, n)
    for start in np.flatnonzero(maxent.context_starts(keys)):
        same = keys >> np.uint64(maxent.ITEM_BITS) == keys[start] >> np.uint64(maxent.ITEM_BITS)
        assert pair[same].sum() + rest[start] == pytest.approx(1, abs=1e-5)
    for ranges in (1, 7, 1000):
        cuts = maxent.range_cuts(keys, ranges)
        owner = [int(k >> np.uint64(maxent.ITEM_BITS)) * ranges >> 36 for k in keys]
        assert cuts.tolist() == [0, *np.searchsorted(owner, range(1, ranges)).tolist(), len(keys)]
    assert (maxent.unpacked(maxent.packed(keys), len(keys), np.uint64) == keys).all()
