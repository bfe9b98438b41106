"""Leaks that no run of words and no greedy walk shows."""

import random

import numpy as np
import pytest

from ledgerloom.llm.leaks import Rule, Searcher, leaked

RULE = Rule()


def searcher(texts, skipped=None):
    texts = [np.array(t, dtype=np.int64) for t in texts]
    skipped = skipped or [np.zeros(len(t), dtype=np.int64) for t in texts]
    return Searcher(list(range(len(texts))), texts, skipped, {str(w): w for w in range(1, 1 + max(int(t.max()) for t in texts))}, RULE)


def by_hand(text, skipped, document):
    """The rule word by word: best[i, j, e] words agree up to text word i at j, e of those since the first lacking."""
    slack, best = RULE.stretch - RULE.least, {}
    before = np.cumsum(skipped)
    for i, a in enumerate(text):
        for j, b in enumerate(document):
            if a != b:
                continue
            for e in range(slack + 1):
                most = 1 if e == 0 else 0
                for d in range(e + 1):
                    for gap in range(1, RULE.between + 2 + (before[i] - before[i - 1 - d] if i - 1 - d >= 0 else 0)):
                        most = max(most, 1 + best[i - 1 - d, j - gap, e - d] if (i - 1 - d, j - gap, e - d) in best else 0)
                if most:
                    best[i, j, e] = most
    return len(text) >= RULE.stretch and max(best.values(), default=0) >= RULE.least


def test_word_between_two_substitutions_counts():
    text = list(range(1, 61))
    passage = text[10:40]
    for k in (10, 12, 20, 25):
        passage[k] = 0
    assert leaked(searcher([text]), [np.array([0] * 20 + passage + [0] * 20)], RULE) == [(0, 0)]


@pytest.mark.parametrize("every", [1, 2])
def test_filler_after_every_word_or_two(every):
    text = list(range(1, 61))
    passage = [x for k, w in enumerate(text[5:35]) for x in ((w, 0) if k % every == every - 1 else (w,))]
    assert leaked(searcher([text]), [np.array([0] * 500 + passage + [0] * 20)], RULE) == [(0, 0)]


@pytest.mark.parametrize("seed", range(4))
def test_same_as_by_hand(seed):
    rng = random.Random(seed)
    texts = [[rng.randrange(1, 90) for _ in range(rng.choice([29, 30, 31, 45, 60]))] for _ in range(4)]
    skipped = [np.array([rng.choice([12, 25]) if rng.random() < 0.03 else 0 for _ in t]) for t in texts]
    documents = []
    for _ in range(40):
        t = rng.choice(texts)
        at = rng.randrange(max(1, len(t) - 29))
        passage, change = t[at : at + 30], rng.sample(range(min(30, len(t))), rng.choice([3, 4, 4, 5]))
        passage = [rng.choice([[], [0], [rng.randrange(1, 90)]]) if k in change else [w] for k, w in enumerate(passage)]
        passage = [y for x in passage for y in (*x, *([rng.randrange(0, 90)] * rng.choice([0, 0, 0, 1, 6, 7] if rng.random() < 0.1 else [0])))]
        documents.append(np.array([rng.randrange(0, 90) for _ in range(rng.randrange(300))] + passage + [rng.randrange(0, 90) for _ in range(20)]))
    want = [(d, k) for d, document in enumerate(documents) for k, t in enumerate(texts) if by_hand(t, skipped[k], document.tolist())]
    assert leaked(searcher(texts, skipped), documents, RULE) == want and want
