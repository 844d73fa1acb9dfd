"""Operator 6: no near pair is left out."""

import random

import numpy as np
import pytest

from panelspark.llm import passages


def shingles(words):
    return [hash(tuple(words[i : i + 5])) & 0xFFFFFFFF for i in range(len(words) - 4)]


def word(rng, kind="w"):
    return f"{kind}{rng.randint(0, 10**9)}"


def changed(rng, words, times):
    out = list(words)
    for k in rng.sample(range(len(words)), times):
        out[k] = word(rng, "e")
    return out


def classes(spark, texts):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id").distinct().collect()
    return {r.doc_id: r.class_id for r in got}


def test_windows_of_other_content_stay():
    """A block sends one window for each content; before, one for each signature and its two tokens aside."""
    w = np.zeros(3, passages.WINDOW)
    w["sig"], w["before"], w["after"], w["content"], w["doc"] = 7, 1, 2, (5, 6, 5), (1, 2, 3)
    kept, pairs = passages.collapsed(w)
    assert sorted(kept["doc"].tolist()) == [1, 2] and [(p["doc"], p["rdoc"], bool(p["equal"])) for p in pairs] == [(3, 1, True)]


def test_runs_of_one_word_have_one_window():
    for text in (b"the " * 400, b"a b c d e f g h i j " * 40):
        w, _ = passages.compact_windows(*passages.tokens([text]))
        assert len(w) <= passages.HASHES and (w["z"] > w["c"]).all() and (w["l"] == 0).all()


@pytest.mark.parametrize("original", ["last", "none"])
def test_all_near_pairs_in_one_class(spark, original):
    """Copies with two of 80 words changed, alike to the original (last, or not there) and a few of them to each other; more
    of them than are linked each with each. Before, one near pair in ten ended in two classes."""
    rng, texts, groups = random.Random(2), [], []
    for _ in range(4):
        base = [word(rng) for _ in range(80)]
        own = [changed(rng, base, 2) for _ in range(50)] + [base] * (original == "last")
        groups.append(range(len(texts), len(texts) + len(own)))
        texts += own
    found, sets = classes(spark, texts), [set(shingles(t)) for t in texts]
    near = [(a, b) for own in groups for a in own for b in own if b < a and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])]
    assert len(near) > 20 and [p for p in near if found.get(p[0], -1) != found.get(p[1], -2)] == []
    assert all(any(i in own and c in own for own in groups) for i, c in found.items())


def test_compared_finds_every_like_stretch():
    """Against all stretches at the same place: a long run beside an edit is no longer taken for the whole of what is alike."""
    rng = random.Random(3)
    for _ in range(150):
        a = [word(rng) for _ in range(rng.choice([70, 120]))]
        x, y = shingles(a), shingles(changed(rng, a, rng.choice([2, 3, 4])))
        n, found = len(x), passages.compared(np.array(x, np.uint32), np.array(y, np.uint32))
        spans = [(s, e) for e in range(passages.PASSAGE, n + 1) for s in range(e - passages.PASSAGE + 1)]
        assert bool(found) == any(len(set(x[s:e]) & set(y[s:e])) >= passages.LEAST * len(set(x[s:e]) | set(y[s:e])) for s, e in spans)
        for s, e, r, f, j in found:
            own, other = set(x[s : e + 1]), set(y[r : f + 1])
            assert j == len(own & other) / len(own | other) >= passages.LEAST and min(e - s, f - r) >= passages.PASSAGE - 1


def test_common_line_leads_nowhere(spark):
    """Texts that have a line in common, and two of them a passage: no pairs are listed for the line's sake."""
    rng = random.Random(4)
    line, passage = [word(rng) for _ in range(12)], [word(rng) for _ in range(60)]
    texts = [[word(rng) for _ in range(40)] + line + [word(rng) for _ in range(40)] for _ in range(100)]
    for k, cut in ((10, 3), (70, 5)):
        texts[k][cut:cut] = changed(rng, passage, 1)
    assert classes(spark, texts) == {10: 10, 70: 10}
    rows = np.repeat(np.arange(100), 20)
    own = np.concatenate([np.concatenate((np.arange(8), 100 + 12 * k + np.arange(12))) for k in range(100)])
    order = np.argsort(own, kind="stable")
    found, _ = passages.rare_tokens(rows[order], own[order], np.full(100, 40), np.arange(100))
    assert not len(found)


def test_cells_of_a_large_family(spark, monkeypatch):
    """A signature that fills several cells gives the same classes."""
    rng = random.Random(5)
    base = [word(rng) for _ in range(80)]
    texts = [changed(rng, base, 2) for _ in range(60)] + [[word(rng) for _ in range(60)] for _ in range(5)]
    whole = classes(spark, texts)
    monkeypatch.setattr(passages, "CHUNK", 10)
    monkeypatch.setattr(passages, "LISTING", 50)
    assert classes(spark, texts) == whole and len(whole) >= 50


def test_families_are_not_listed_pair_by_pair(monkeypatch):
    """300 rows of one label with ten tokens in common, and one row of another: its 300 partners are listed, not the family's
    45,000 pairs a token."""
    monkeypatch.setattr(passages, "LISTING", 1_000)
    rows, own, root = np.tile(np.arange(301), 10), np.repeat(np.arange(10), 301), np.zeros(301, np.int64)
    root[300] = 1
    found = list(passages.listed_pairs(rows, own, root))
    assert len(found) <= 10 and {(min(p), max(p)) for a, b in found for p in zip(a.tolist(), b.tolist())} == {(k, 300) for k in range(300)}
