"""Pieces, mixtures and leaks."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.leaks import Rule, find_leaks
from ledgerloom.llm.mixture import Share, mix_sources
from ledgerloom.llm.pieces import best_cuts, cut_text, split_oversized
from ledgerloom.llm.plainwords import plain_words
from ledgerloom.llm.tokens import TOKEN, token_count

WORDS = "lid crust plot rhyme owner harbour courier quick sturdy bowl panel strap colour motor garage kitchen spine garnish metal window".split()


def prose(rng, n):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS))
        if rng.random() < 0.1:
            out[-1] += rng.choice([".", "!", "?\n", ".\n\n", ","])
    return " ".join(out)


@pytest.mark.parametrize("text", ["", "  \n ", "a", "wé_1 -- 你好，世界 ½²x́y z w\x1cq", "a.b.c", "...", "x" * 3000, "I'm 3.5%\t\U0001f600!"])
def test_tokens_are_the_same_in_both_engines(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(token_count(F.col("t"))).head()[0] == len(TOKEN.findall(text))


@pytest.mark.parametrize("seed", range(6))
def test_cut_is_whole_and_within_the_limit(seed):
    rng = random.Random(seed)
    text = "  " + prose(rng, rng.choice([30, 401, 900, 3000])) + ("\n" + " ".join(["word"] * 700) if seed % 2 else "") + " \n"
    pieces, longest = cut_text(text, 100, 10)
    spans = [m.span() for m in TOKEN.finditer(text)]
    assert "".join(text[own:stop] for _, own, stop, _, _ in pieces) == text
    for k, (start, own, stop, tokens, kind) in enumerate(pieces):
        inside = [s for s in spans if start <= s[0] and s[1] <= stop]
        assert tokens == len(inside) <= 100
        assert len([s for s in inside if s[0] < own]) == (10 if k else 0)
        if kind in ("line", "sentence", "paragraph"):
            gap = text[: stop].rstrip()[-1:] + text[len(text[:stop].rstrip()) : stop]
            assert "\n" in gap or re.match(r"[.!?]\s", gap)
    stretches = [len(TOKEN.findall(x)) for x in re.split(r"\n|(?<=[.!?])\s", text)]
    assert longest == max(stretches)
    if max(stretches) <= 90:
        assert all(p[4] != "token" for p in pieces)


def test_cuts_are_optimal_on_small_texts():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(12, 30)
        natural = np.array(sorted(rng.sample(range(1, n), rng.randrange(6, 10))), dtype=np.int64)
        penalty = np.array([rng.choice([0.0, 0.05, 0.1]) for _ in natural])
        limit, overlap = 12, 2
        if np.diff(np.concatenate(([0], natural, [n]))).max() > limit - overlap:
            continue
        even = (n - overlap) / max(1, -(-(n - overlap) // (limit - overlap)))

        def cost(cuts):
            points, total = [0, *cuts, n], 0.0
            for a, b in zip(points, points[1:]):
                span = b - a if a else b - overlap
                if (span + overlap) > limit or (a and a < overlap):
                    return float("inf")
                total += ((span - even) / (limit - overlap)) ** 2
            return total + sum(penalty[list(natural).index(c)] for c in cuts)

        subsets = [[int(natural[i]) for i in range(len(natural)) if mask >> i & 1] for mask in range(1 << len(natural))]
        least = min(map(cost, subsets))
        cuts, _ = best_cuts(n, natural, penalty, limit, overlap)
        assert abs(cost(cuts) - least) < 1e-9


def test_pieces_of_odd_rows(spark, rows):
    df = spark.createDataFrame([(1, None, "c"), (1, "", "c"), (2, "one two. three", "c")], "id bigint, text string, piece string")
    assert rows(split_oversized(df, "id", "text"), "id", "pieces", "tokens", "text") == [(1, 1, 0, ""), (1, 1, 0, ""), (2, 1, 4, "one two. three")]
    assert rows(split_oversized(df, "id", "text", small=False)) == [] and rows(split_oversized(df.limit(0), "id", "text")) == []
    with pytest.raises(ValueError, match="overlap"):
        split_oversized(df, "id", "text", 10, 6)


def test_mix_meets_shares(spark, rows):
    rng = random.Random(8)
    docs = [(i, rng.choice(["a"] * 6 + ["b"] * 3 + ["c"]), rng.randrange(1, 40)) for i in range(4000)] + [(-1, None, 5), (-2, "a", None), (-3, "c", 0)]
    frame = spark.createDataFrame(docs, "id bigint, source string, n bigint")
    size = {s: sum(n or 0 for _, x, n in docs if x == s) for s in "abc"}
    total = sum(size.values())
    shares = [Share(1, "a", 500, 1, 60), Share(1, "b", 300, 1, 60), Share(1, "c", 200, 2, 60), Share(2, "c", 900, 2, 50), Share(2, "zz", 100, 9, 50)]
    mix, report = mix_sources(frame, "id", "source", "n", shares)
    got = {(r["mix_id"], r["source"]): r for r in report.collect()}
    for s in shares:
        r = got[s.mix_id, s.source]
        there = size.get(s.source, 0)
        assert r["available"] == there and r["short"] == (s.max_repeats * there < total * s.percent * s.permille / 100_000)
        want = min(total * s.percent * s.permille / 100_000, s.max_repeats * there)
        assert abs(r["actual_tokens"] - want) <= 0.02 * total * s.percent / 100
    used = {(r["mix_id"], r["source"]): r for r in mix.groupBy("mix_id", "source").agg(F.sum("n").alias("n"), F.max("round").alias("round")).collect()}
    assert all(u["n"] == got[k]["actual_tokens"] for k, u in used.items()) and used[2, "c"]["round"] == 1
    assert mix.groupBy("mix_id", "id").count().where("count > 2").count() == 0
    nothing, empty = mix_sources(frame.limit(0), "id", "source", "n", shares)
    assert nothing.count() == 0 and empty.count() == 5


def disguised(words, how, rng):
    text = " ".join(words)
    if how == "upper":
        return text.upper()
    if how == "html":
        return "<p>" + "<br/>\n".join(" ".join(f"<b>{w}</b>" if i % 5 == 0 else w for i, w in enumerate(words[k : k + 7])) for k in range(0, len(words), 7)) + "</p>&nbsp;"
    if how == "json":
        return '{"review": "' + "\\n".join(" ".join(words[k : k + 6]) for k in range(0, len(words), 6)).replace("e", "\\u0065") + '"}'
    if how == "hidden":
        return " ".join(w[:1] + "​­" + w[1:] for w in words)
    if how == "accents":
        return text.replace("a", "á").replace("o", "ö")
    if how == "quoted":
        return "> " + "\n> ".join(" ".join(words[k : k + 5]) + " --" for k in range(0, len(words), 5))
    if how == "noise":  # one word in ten is missing, one in twelve is new
        return " ".join(w for i, w in enumerate(x for k, w in enumerate(words) for x in ([w] if k % 10 != 4 else []) + (["zebra"] if k % 12 == 7 else [])))
    return text


def test_leaks_in_every_disguise(spark, rows):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("bra", "mon", "ter", "lis", "ova", "kes", "pud", "rin") for b in ("den", "to", "mar", "lek", "su", "pit", "gon", "ha")]
    phrase = [rng.choice(vocabulary) for _ in range(35)]
    reviews = [[rng.choice(vocabulary) for _ in range(90)] for _ in range(12)]
    for k in (0, 1, 2):
        reviews[k] = reviews[k][:20] + phrase + reviews[k][20:]
    items = spark.createDataFrame([(100 + i, " ".join(w)) for i, w in enumerate(reviews)] + [(200, None), (201, ""), (202, "too short")], "eval_id bigint, review string")
    noise = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, want = [], set()

    def add(words, leaks=()):
        docs.append((len(docs), words if isinstance(words, str) else " ".join(words)))
        want.update((len(docs) - 1, e) for e in leaks)

    for k, how in enumerate(("plain", "upper", "html", "json", "hidden", "accents", "quoted", "noise")):
        add(" ".join(noise(50)) + ". " + disguised(reviews[3 + k][10:60], how, rng) + " " + " ".join(noise(40)), [103 + k])
    add(reviews[5][0:33] + noise(900) + reviews[6][50:88], [105, 106])  # two leaks
    add(reviews[0], [100])  # the whole, a standard phrase within
    add(noise(30) + phrase + noise(30))  # the standard phrase alone
    add(reviews[7][10:32] + noise(60) + reviews[7][40:62])  # shorter quotes
    shuffled = reviews[8][10:60]
    rng.shuffle(shuffled)
    add(shuffled)
    add([x for w in reviews[9][10:50] for x in (w, *noise(9))])  # far apart
    add("".join(noise(2)))
    docs += [(900, None), (901, ""), (902, "x" * 200_000), (5, docs[5][1])]
    frame = spark.createDataFrame([(*d, "c") for d in docs], "doc_id bigint, text string, eval_id string")
    assert set(rows(find_leaks(frame, "doc_id", "text", items, "eval_id", "review"), "doc_id", items.columns[0])) == want
    assert set(rows(find_leaks(frame, "doc_id", "text", items, "eval_id", "review", block=5), "doc_id", "eval_id")) == want
    assert rows(find_leaks(frame.limit(0), "doc_id", "text", items, "eval_id", "review")) == []
    assert rows(find_leaks(frame, "doc_id", "text", items.limit(0), "eval_id", "review")) == []
    strict = find_leaks(frame, "doc_id", "text", items, "eval_id", "review", Rule(stretch=30, least=30))
    assert (7, 110) not in set(rows(strict))


@pytest.mark.parametrize(
    ("text", "words"),
    [("Café, DON&#39;T!", ["cafe", "dont"]), ("pop-up <b>bo</b>ok<br>x", ["popup", "book", "x"]), ("a\\nb \\u00e9c", ["a", "b", "ec"]), ("pow-\n> er", ["power"]), ("a​b", ["ab"]), ("%20x%2Fy", ["x", "y"]), ("", []), ("&amp;lt;b&amp;gt;hi", ["hi"]), ("\\ud800 z", ["z"])],
)
def test_words(text, words):
    assert plain_words(text) == words
