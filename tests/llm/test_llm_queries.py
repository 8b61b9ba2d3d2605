"""The operators' queries against their SQL, and against brute force where there is none."""

import collections
import hashlib
import re
import zlib
from html import unescape

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tidewindow.llm import html_text, language_id, registry, sql, token_counts
from tidewindow.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_WEIGHTS, VOCABULARY
from tidewindow.llm.textvec import shingles


def rows_of(spark, data, table, *columns):
    return spark.read.parquet(f"{data}/{table}.parquet").select(*columns).collect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_has_the_rows_of_its_sql(name, same_rows):
    same_rows(registry.queries()[name], registry.oracle_sql()[name])


def test_language_is_found_in_held_out_documents(spark, data):
    lang = {r["doc_id"]: r["lang"] for r in rows_of(spark, data, "documents", "doc_id", "lang")}
    out = registry.queries()["op2_language_id"](spark, data).collect()
    assert len(out) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_profiles_equal_a_plain_count(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40).persist()
    model = language_id.collect_profiles(language_id.train_profiles(docs, top=50), 50)
    plain = collections.defaultdict(collections.Counter)
    for r in docs.collect():
        words = "".join(c.lower() if c.isalpha() else " " for c in r["text"]).split()
        for w in words:
            padded = f" {w} "
            plain[r["lang"]].update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")
    docs.unpersist()

    def code(gram):
        out = 0
        for c in gram:
            out = out << 21 | ord(c)
        return out

    for lang, counts in plain.items():
        ordered = sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:50]
        assert model[lang] == [code(g) for g, _ in ordered]


def plain_ngrams(text):
    words = "".join(c.lower() if c.isalpha() else " " for c in text or "").split()
    padded = [f" {w} " for w in words]
    return collections.Counter(p[i : i + n] for p in padded for n in (1, 2, 3) for i in range(len(p) - n + 1) if p[i : i + n] != " ")


def plain_profile(counts):
    """The 300 most frequent n-grams; ties by the n-gram's letters, shorter n-grams first."""
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:300]]


def plain_predictions(docs, train):
    """Id -> language and score of ``docs`` by out-of-place distances to the profiles of ``train``."""
    counts = collections.defaultdict(collections.Counter)
    for r in train:
        if r["lang"] is not None:
            counts[r["lang"]].update(plain_ngrams(r["text"]))
    places = {lang: {g: i for i, g in enumerate(plain_profile(c))} for lang, c in counts.items()}
    out = {}
    for r in docs:
        own = plain_profile(plain_ngrams(r["text"]))
        apart = {lang: sum(abs(i - p[g]) if g in p else 300 for i, g in enumerate(own)) for lang, p in places.items()}
        best = min(apart, key=lambda x: (apart[x], x)) if own else "und"
        out[r["doc_id"]] = best, 1 - apart[best] / (300 * len(own)) if own else 0.0
    return out


def test_predictions_equal_plain_distances(spark, data):
    docs = rows_of(spark, data, "documents", "doc_id", "text", "lang")
    plain = plain_predictions(docs, [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 5])
    for r in registry.queries()["op2_language_id"](spark, data).collect():
        assert (r["lang_pred"], r["score"]) == (plain[r["doc_id"]][0], pytest.approx(plain[r["doc_id"]][1]))


def greedy(word, vocabulary, longest):
    n = 0
    while word:
        size = next(k for k in range(min(longest, len(word)), 0, -1) if word[:k] in vocabulary)
        word, n = word[size:], n + 1
    return n


def test_token_counts_equal_greedy_matching(spark, data):
    tokens = token_counts.read_vocabulary(spark, VOCABULARY)
    vocabulary, longest = set(tokens), max(map(len, tokens))
    out = {r["doc_id"]: r["n_tokens"] for r in registry.queries()["op5_token_counts"](spark, data).collect()}
    for r in rows_of(spark, data, "documents", "doc_id", "text"):
        words = token_counts._WORD.findall(r["text"].encode())
        assert b"".join(words) == r["text"].encode()
        assert out[r["doc_id"]] == sum(greedy(w, vocabulary, longest) for w in words)


def test_small_vocabularies_exhaustively():
    vocabulary = [b"a", b"b", b"c", b"abc", b"abcab", b"bca", b"cc"]
    automaton, words = token_counts.LongestMatch(vocabulary), [b""]
    for _ in range(7):
        words = [w + bytes([c]) for w in words for c in b"abc"]
        assert all(automaton.count(w) == greedy(w, set(vocabulary), 5) for w in words)
    assert token_counts.LongestMatch([b"ab"]).count(b"abc") == 1


def within_article(html):
    """The blocks between the article tags of a page of the test tables, which has one and nothing to leave out inside it."""
    inner = re.search("<article>(.*?)</article>", html, re.DOTALL)[1]
    blocks = re.split("</?(?:p|h1|h2|ul|li|div)(?: [^>]*)?>", inner)
    plain = (" ".join(unescape(re.sub("<[^>]*>", "", re.sub("<br ?/?>", " ", b))).split()) for b in blocks)
    return "\n".join(b for b in plain if b)


def test_main_text_is_the_article(spark, data):
    html = {r["page_id"]: r["html"] for r in rows_of(spark, data, "pages", "page_id", "html")}
    for r in registry.queries()["op7_html_extraction"](spark, data).collect():
        assert r["text"] == html_text.main_text(html[r["page_id"]]) == within_article(html[r["page_id"]])
        assert r["n_chars"] == len(r["text"]) > 0 and "<" not in r["text"] and "\xa9" not in r["text"]


def brute_groups(docs, n, num):
    lower = {c: c + 32 for c in range(65, 91)}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for i, t in docs}
    sets = {i: {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set() for i, w in words.items()}
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    places = collections.defaultdict(list)
    for i, s in sets.items():
        for item in s:
            places[item].append(i)
    for i, s in sets.items():
        for j, both in collections.Counter(j for item in s for j in places[item] if j < i).items():
            if 100 * both >= num * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_pipeline_stages_one_by_one(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = docs.collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "secrets", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(kept, docs.schema), data)
        rows = out.collect()
        if name != "mixing":
            assert out.columns == docs.columns
        if name == "language_id":
            plain = plain_predictions(kept, kept)
            assert {r["doc_id"] for r in rows} == {i for i, (lang, score) in plain.items() if lang != "und" and score >= corpus_pipeline.LEAST_SCORE}
            given = {r["doc_id"]: r["lang"] for r in kept}
            assert all(r["lang"] == (given[r["doc_id"]] or plain[r["doc_id"]][0]) for r in rows)
        elif name == "near_duplicates":
            group = brute_groups([(r["doc_id"], r["text"]) for r in kept], 5, 80)
            assert sorted(r["doc_id"] for r in rows) == sorted(set(group.values()))
        elif name == "decontamination":
            hit = {r["doc_id"] for r in registry.queries()["op4_decontamination"](spark, data).where("contaminated").collect()}
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in kept} - hit
        elif name == "secrets":
            text = {r["doc_id"]: r["text"] for r in kept}
            assert len(rows) == len(kept) and all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] != text[r["doc_id"]])
            planted = spark.createDataFrame([(1, "x password=b7db7aa4a5fcc78305 y", "en", "src1", 31)], docs.schema)
            assert stage(spark, planted, data).select("text", "n_chars").collect() == [("x [ASSIGN] y", 12)]
        else:
            db = duckdb.connect()
            db.register("documents", pd.DataFrame([r.asDict() for r in kept]))
            expected = db.sql(f"SELECT doc_id, domain, n_tokens, epochs FROM ({sql.mixing_sql(MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)})").fetchall()
            assert sorted((r["doc_id"], r["domain"], r["n_tokens"], r["epochs"]) for r in rows) == sorted(expected)
        kept = [tuple(r[c] for c in docs.columns) for r in rows]
        kept = spark.createDataFrame(kept, docs.schema).collect() if kept else []
    assert len({r["doc_id"] for r in corpus_pipeline.run(spark, data).select("doc_id").collect()} ^ {r["doc_id"] for r in kept}) == 0


def test_shared_words_hash_alike():
    assert shingles("A b\tC", 3).tolist() == shingles("a B\n c", 3).tolist() != shingles("a b d", 3).tolist()
    assert len(shingles("É x", 1)) == 2 and shingles("É", 1).tolist() != shingles("é", 1).tolist()
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
