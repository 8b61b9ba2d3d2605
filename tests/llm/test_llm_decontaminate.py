"""Operator 4's automaton against a plain search, and its size."""

import random

import numpy as np
import pytest

from tidewindow.llm import decontaminate as dc
from tidewindow.llm.textvec import ALNUM, word_hashes


def plain(items, words, window):
    """Hit places and items of a list of words."""
    hit, found = set(), set()
    for owner, own in items:
        size = min(window, len(own))
        for s in range(len(own) - size + 1 if size else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[s : s + size]:
                    hit |= set(range(i, i + size))
                    found.add(owner)
    return hit, found


@pytest.mark.parametrize("stretch", [(1, 3), (64, 1024)])
def test_scan_equals_a_plain_search(monkeypatch, stretch):
    monkeypatch.setattr(dc, "STRETCH", stretch)
    r = random.Random(5)
    for round_ in range(150):
        window = r.choice([1, 2, 3, 5])
        letters = "abc" if round_ % 2 else "abcdefgh"
        items = [(r.randrange(4), r.choices(letters, k=r.randint(0, 9))) for _ in range(r.randint(0, 6))]
        words = r.choices(letters + "xyz"[: r.randint(0, 3)], k=r.randint(0, 40))
        automaton = dc.build_automaton([word_hashes(" ".join(w), ALNUM) for _, w in items], [o for o, _ in items], window)
        coded = automaton.numbers(word_hashes(" ".join(words), ALNUM))
        ends, found = automaton.hits(automaton.scan(coded, window)) if len(automaton.keys) and words else (np.empty(0, int),) * 2
        hit = {p for e, f in zip(ends.tolist(), found.tolist(), strict=True) for p in range(e - int(automaton.depth[f]) + 1, e + 1)}
        assert (hit, set(automaton.items_of(found).tolist())) == plain(items, words, window)


def test_many_words_and_a_bound_of_the_built_table(spark):
    """More distinct words than there are code points."""
    n = 1_300_000
    items = spark.range(n // 100).selectExpr("id AS item_id", "array_join(transform(sequence(id * 100, id * 100 + 99), i -> concat('w', i)), ' ') AS text")
    docs = spark.createDataFrame([(1, "so " + " ".join(f"w{i}" for i in range(1_299_940, 1_299_955)) + " end"), (2, "w5 w6 w7"), (3, " ".join(f"W{i}" for i in range(95, 105)))], "doc_id long, text string")
    out = {r["doc"]["doc_id"]: r for r in dc.contamination(docs, items).collect()}
    assert (out[1]["n_words"], out[1]["n_hit"], out[1]["item_ids"]) == (17, 15, ["12999"])
    assert (out[2]["n_hit"], out[3]["n_hit"]) == (0, 0)
    with pytest.raises(ValueError, match="the automaton has"):
        dc.contamination(docs, items.limit(100), max_automaton_bytes=10_000)


def test_windows_of_an_item_share_states():
    words = word_hashes(" ".join(f"w{i}" for i in range(10_000)), ALNUM)
    automaton = dc.build_automaton([words, words], [0, 1], 10)
    assert len(automaton.keys) == sum(10_000 - d for d in range(10))
    assert automaton.nbytes < 200 * 10_000
    assert automaton.items_of(automaton.windows).tolist() == [0, 1]
