"""Operator 1 where n-grams are too common to be joined by themselves."""

import random

import pytest

from tidewindow.llm import ngram_join


def groups(sets, num, den):
    """Id -> smallest id that links reach, by all pairs."""
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


def shingles(text, n=3):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("num", [90, 50])
def test_groups_under_common_ngrams(spark, num, monkeypatch):
    """Near copies of texts from few words, and small texts, whose n-grams all are hot."""
    r = random.Random(num)
    words = [f"w{i}" for i in range(5)]
    texts = {}
    for i in range(14):
        base = r.choices(words, k=r.choice([3, 4, 5, 9, 20, 120, 200]))
        for k in range(r.randint(1, 5)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                own[r.randrange(len(own))] = r.choice(words) if r.random() < 0.5 else f"x{r.randrange(40)}"
            texts[10 * i + k] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    expected = groups({i: shingles(t) for i, t in texts.items()}, num, 100)
    for hot, heavy in ((0, 8), (3, 0)):
        monkeypatch.setattr(ngram_join, "HEAVY", heavy)
        out = ngram_join.ngram_jaccard_groups(df, n_words=3, num=num, hot_entries=hot).collect()
        assert {r["doc_id"]: r["component_id"] for r in out} == expected


def test_unlinked_long_texts_of_few_words_stay_linear(spark, monkeypatch):
    """What is written for neighbours is a few rows for each entry that is left, however long the texts are."""
    counts = {}
    save = ngram_join.Scratch.save

    def counting(self, name, df, *args, **kw):
        out = save(self, name, df, *args, **kw)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join.Scratch, "save", counting)
    r = random.Random(2)
    texts = [(i, " ".join(r.choices([f"w{k}" for k in range(20)], k=3000))) for i in range(40)]
    out = ngram_join.ngram_jaccard_groups(spark.createDataFrame(texts, "doc_id long, text string"), n_words=3, num=90, hot_entries=3).collect()
    assert all(r["component_id"] == r["doc_id"] for r in out)
    assert 0 < counts["paired"] <= 4 * counts["open"] and counts["twice"] <= counts["paired"] and counts["light"] == 0


def test_neighbours_are_found_in_both_sets_of_a_link():
    """By all sizes and overlaps: of the first common items of two sets, two are neighbours in both, within the places that are written."""
    r = random.Random(9)
    for num in (90, 80, 60):
        for _ in range(2000):
            n, m = r.randint(1, 60), r.randint(1, 60)
            least = -(-num * (n + m) // (num + 100))
            beyond = ngram_join._beyond(num, 100)
            if least > min(n, m) or min(n, m) < beyond:
                continue
            common = set(r.sample(range(1000), least))
            x, y = (sorted(common | {v + 0.3 + 0.2 * side for v in r.sample(range(-5, 1000), k - least)}) for side, k in ((0, n), (1, m)))

            def pairs(own, size):
                low = num * size // 100
                k = min(size, 2 * size + low - 3 * (num * (size + low) // (num + 100)) + 3)
                return set(zip(own[:k], own[1:k], strict=False))

            assert pairs(x, n) & pairs(y, m)
