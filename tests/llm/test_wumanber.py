"""Multi-pattern search against looking at every place, and leaks in several blocks."""

import random

import numpy as np
import pytest

from ledgerloom.llm.leaks import find_leaks
from ledgerloom.llm.wumanber import LANE, LONG, WuManber


@pytest.mark.parametrize("letters", ["ab ", "abcdefgh ", "xyzé "])
def test_same_as_every_place(letters):
    rng = random.Random(letters)
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(60):
        patterns = list({word(rng.randrange(2, 2 * LONG)).encode() for _ in range(rng.randrange(1, 40))})
        text = word(rng.choice([0, 1, 3, 50, LANE - 1, LANE, LANE + 1, 6 * LANE])).encode()
        want = sorted((i, k) for k, p in enumerate(patterns) for i in range(len(text)) if text.startswith(p, i))
        at, which = WuManber(patterns).search(np.frombuffer(text, dtype=np.uint8))
        assert sorted(zip(at.tolist(), which.tolist())) == want


def test_no_patterns():
    at, which = WuManber([]).search(np.frombuffer(b"text", dtype=np.uint8))
    assert len(at) == len(which) == 0


def test_windows_do_move():
    part = WuManber([b"needlework", b"haystacks"]).parts[0]
    assert part.shift.max() == part.window - part.block + 1
    assert len(part._ends(np.frombuffer(b"nothing of the kind stands here " * 100, dtype=np.uint8))) < 200


def test_blocks_of_evaluation_texts(spark, rows):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmno") for _ in range(n))
    texts = [[word(rng.choice([1, 2, 5, 8])) for _ in range(60)] for _ in range(5)]
    filled = lambda t, every: " ".join(w + (" Zzz," if k % every == 0 else "") for k, w in enumerate(t))
    documents = [(1, filled(texts[0][5:40], 1)), (2, filled(texts[1][:31], 2)), (3, " ".join(texts[2][:25])), (4, filled(texts[3], 3).upper()), (5, None), (6, ""), (7, " ".join(texts[4][10:50]) + filled(texts[0], 4))]
    d, e = spark.createDataFrame(documents, "doc_id bigint, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)] + [(9, None)], "eval_id bigint, review string")
    want = [(1, 0), (2, 1), (4, 3), (7, 0), (7, 4)]
    assert rows(find_leaks(d, "doc_id", "text", e, "eval_id", "review")) == want
    assert rows(find_leaks(d, "doc_id", "text", e, "eval_id", "review", block=2)) == want
