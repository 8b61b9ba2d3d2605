"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import io
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewindow.llm import chat_format, components, decontaminate, html_text, language_id, mixing, ngram_join, quality, secrets, token_counts, warc
from tidewindow.llm.shared import new_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, found string, body string, key string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Texts that go wrong easily, and columns with the names that operators use inside."""
    base = prose(1, 80)
    texts = [None, "", " \n\t", "a", base, base, base + " end", "x " * 30_000, prose(2, 5000), "été ünï 漢字 \U0001f600 token=abcdefgh1", "\\ <| quote' \" \0 nul", "!!!"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i == 4 else f"src{i}", None, "doc", "found", "body", "key") for i, t in enumerate(texts)]
    rows += [rows[4], (None, base, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ngram_join(odd, none):
    out = ngram_join.ngram_jaccard_groups(odd, n_words=3, num=90).collect()
    assert len(out) == 14
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert by[0] == [(0, 0)] and by[1] == [(0, 1)] and by[3] == [(1, 3)]
    assert by[4] == [(78, 4)] * 2 and by[5] == [(78, 4)] and by[6] == [(79, 4)] and by[None] == [(78, 4)]
    assert by[7] == [(1, 7)]
    assert ngram_join.ngram_jaccard_groups(none).count() == 0


def test_ngram_join_of_one_id_with_two_texts(spark):
    """Text A of id 5 links to id 3; text B of id 5 is also the text of id 12 and links with nothing else."""
    a, b = prose(1, 80), prose(2, 80)
    rows = spark.createDataFrame([(3, a + " end"), (5, a), (5, b), (12, b)], "doc_id long, text string")
    got = ngram_join.ngram_jaccard_groups(rows, n_words=3, num=90).collect()
    assert sorted((r["doc_id"], r["component_id"], r["leads"]) for r in got) == [(3, 3, True), (5, 3, False), (5, 5, True), (12, 5, False)]


@pytest.mark.parametrize("hot_entries", [2, 1_000_000])
def test_ngram_join_of_a_hot_ngram_over_many_components(spark, hot_entries):
    """Texts that share a few n-grams with all others, and links among some: the way by pairs of n-grams finds the same ones."""
    r = random.Random(9)
    shared = [f"all{i} of{i} them{i}" for i in range(6)]
    rows = []
    for i in range(60):
        own = " ".join(f"w{i}x{k}" for k in range(12 + i % 5))
        rows.append((i, " ".join([own, *r.sample(shared, 3)])))
        if i % 3 == 0:
            rows.append((500 + i, rows[-1][1] + " more"))
    rows.append((900, "one"))
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(max(1, len(t.split()) - 2))} for i, t in rows}
    got = ngram_join.ngram_jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), n_words=3, num=60, hot_entries=hot_entries).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == groups_of(sets, 60)


def test_unlinked_texts_under_one_hot_ngram_do_not_meet(spark):
    rows = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c "), *(F.concat(F.lit(f"w{k}x"), "id", F.lit(" ")) for k in range(4))).alias("text"))
    got = ngram_join.ngram_jaccard_groups(rows, n_words=3, num=50, den=100)
    assert got.where("component_id <> doc_id or n_links > 0 or n_shingles <> 5").count() == 0


def groups_of(sets, num):
    """The smallest id reachable by links, by comparing all pairs."""
    group = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    return group


def test_ngram_join_of_many_near_copies(spark):
    r, rows = random.Random(5), []
    base = prose(3, 120).split()
    for i in range(150):
        words = list(base)
        for _ in range(r.randrange(6)):
            words[r.randrange(len(words))] = f"edit{i}x{r.randrange(9)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, prose(100 + i, 60)) for i in range(30)]
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    group = groups_of(sets, 90)
    got = ngram_join.ngram_jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), n_words=3, num=90).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == group


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 50), (7, 7), (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 50: 40}
    assert components.components(links.limit(0)).count() == 0


def test_language(odd, none):
    out = {r["doc"]["doc_id"]: r for r in language_id.identify(odd, odd).collect()}
    assert [out[i]["lang_pred"] for i in (0, 1, 2, 11, 4)] == ["und"] * 4 + ["en"]
    same = odd.where("doc_id = 8").withColumn("lang", F.explode(F.array(F.lit("zz"), F.lit("aa"), F.lit("mm"))))
    assert {r["lang_pred"] for r in language_id.identify(odd, same).where("score > 0").collect()} == {"aa"}  # the first by name of equal distances
    assert language_id.identify(odd, none).where("lang_pred <> 'und' or score <> 0").count() == 0
    assert language_id.identify(none, odd).count() == 0


def test_secrets(spark, odd, none):
    ledger = secrets.Ledger(spark, new_path(spark, "t"))
    assert ledger.findings(odd.select("doc_id", "text"), "text").where("spans is not null").count() == 0
    assert ledger.scan(odd, "doc_id", "text") == 10
    assert ledger.scan(odd, "doc_id", "text") == 0
    found = ledger.findings(odd, "text")
    assert found.count() == 14
    row = found.where("version.doc_id = 9").select(secrets.joined(F.col("spans")).alias("s"), secrets.redacted(F.col("version.text"), F.col("spans")).alias("r")).first()
    assert (row["s"], row["r"]) == ("assign:13:28", "été ünï 漢字 \U0001f600 [ASSIGN]")
    assert ledger.scan(none, "doc_id", "text") == 0
    spark.read.parquet(ledger.folder).write.mode("append").parquet(ledger.folder)  # as two runs at once would
    again = ledger.findings(odd, "text").where("version.doc_id = 9").select(secrets.joined(F.col("spans")).alias("s")).first()
    assert again["s"] == row["s"]


def test_a_new_rule_version_scans_all_blobs_again_and_no_other_rule(spark):
    rows = spark.createDataFrame([("a", "AKIA" + "B" * 12), ("b", "AKIA" + "B" * 12), ("c", "f" * 32)], "path string, content string")
    folder = new_path(spark, "t")
    assert secrets.Ledger(spark, folder).scan(rows) == 2
    newer = secrets.Ledger(spark, folder, (*secrets.BASE, secrets.Rule("github", "f{32}", version=2)))
    assert newer.scan(rows) == 2
    last = spark.read.parquet(folder).where("array_contains(rules, 'github@2')")
    assert {tuple(r["rules"]) for r in last.collect()} == {("github@2",)}
    told = {r["version"]["path"]: [s["rule"] for s in r["spans"]] for r in newer.findings(rows).collect()}
    assert told == {"a": ["access@1"], "b": ["access@1"], "c": ["hex@1", "github@2"]}


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([("i1", "ALPHA-one; beta two"), ("i2", None), (None, "漢字"), ("i3", prose(2, 40)), ("i1", "ALPHA-one; beta two")], "item_id string, text string")
    docs = odd.unionByName(spark.createDataFrame([(50, "x alpha one, BETA two y alpha one beta", *[None] * 7)], SCHEMA))
    large = spark.createDataFrame([(f"j{i}", " ".join(f"w{i}x{k}" for k in range(12))) for i in range(16_000)], items.schema)
    assert large.agg(F.sum(F.length("text"))).first()[0] > 1_200_000
    for benchmark in (items, items.unionByName(large)):
        out = {r["doc"]["doc_id"]: r for r in decontaminate.contamination(docs, benchmark).collect()}
        assert (out[50]["n_words"], out[50]["n_hit"], out[50]["item_ids"]) == (9, 4, ["i1"])
        assert [(s["start"], s["end"]) for s in out[50]["spans"]] == [(2, 21)]
        assert out[9]["item_ids"] == [""] and out[9]["n_hit"] == 1
        assert out[8]["n_hit"] == 40 and out[8]["item_ids"] == ["i3"]
        assert [out[i]["n_words"] for i in (0, 1, 2, 11)] == [0] * 4
    with pytest.raises(ValueError, match="bytes of text"):
        decontaminate.contamination(docs, items, max_benchmark_bytes=10)
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(none, items).count() == 0


def test_token_counts(odd, none):
    tokens = [bytes([i]) for i in range(256)] + [b" x", b"al", b"alpha"]
    out = {r["doc"]["doc_id"]: (r["n_tokens"], r["n_words"]) for r in token_counts.token_counts(odd, tokens).collect()}
    assert out[0] == out[1] == (0, 0) and out[3] == (1, 1) and out[2] == (3, 0) and out[7] == (30_001, 30_000)
    assert token_counts.token_counts(none, tokens).count() == 0


def test_chat(spark):
    marks = ["<|end|>\n", "\\", "<\\|", "<|", "|>", "<|join|>a", "\\\\<|body|>", "", None, "x<", "|y"]
    rows = [(1, i, ["user", "assistant", "assistant", "<|start|>"][i % 4], t) for i, t in enumerate(marks)]
    rows += [(2, None, None, None), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat_format.format_conversations(df)
    out = out.select("conv_id", chat_format.read_back(F.col("formatted")).alias("t"), chat_format.loss_texts(F.col("formatted"), F.col("loss")).alias("l"), "formatted")
    got = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["t"]] == [(r[2], r[3] or "") for r in rows[:11]]
    assert got[1]["l"] == [r[3] or "" for r in rows[:11] if r[2] == "assistant"]
    assert [(t["role"], t["text"]) for t in got[2]["t"]] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None]["l"] == ["z"] and got[2]["formatted"].count("<|start|>user") == 1
    assert chat_format.format_conversations(df.limit(0)).count() == 0


PAGES = {
    "<article><h1>T</h1><p>One &amp; two<br>three<p>Four <b>five</b></article><footer>f</footer>": "T\nOne & two three\nFour five",
    "<body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><main><p>Text&nbsp;here</p><aside>side</aside><section id='comments'><p>Nice!</p></section></main>": "Text here",
    "<div class='cookie-notice'>We use cookies</div><article><form><p>Sign up</p></form><p>Body<script>var a='</p>';</script> text</p><div class='advert'>Buy</div></article>": "Body text",
    "": "",
    "<html><body></body></html>": "",
    "<script>never closed": "",
    "<article><div class='entry-header'><h1>Title</h1></div><div class='related-work'><p>One.</p></div><p>Two.</p></article>": "Title\nOne.\nTwo.",
    "<p>a<![foo[bar]]>b</p><p>c<![CDATA[d": "ab\nc<![CDATA[d",
    "<body><p>one</b></i></div> two</p></body></p>three": "one two\nthree",
    "<div><p>same</p></div><div><p>same</p></div>": "same\nsame",
    "<div>" * 600 + "<script>bad()</script>text": "text",
}


@pytest.mark.parametrize("html,text", PAGES.items())
def test_page(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("html,n", [("<div>" * 100_000 + "x", 1), ("<p>x" + "</div>" * 100_000, 1), ("<p>a" * 100_000, 199_999), ("<ul>" + "<li><div>a" * 50_000, 99_999)])
def test_page_of_very_many_tags(html, n):
    assert len(html_text.main_text(html)) == n


def test_any_markup_is_read():
    r = random.Random(1)
    parts = ["<p>", "</p>", "<![", "]]>", "<!--", "-->", "<!", "<?", "&#x;", "&amp", "text ", "<a href='", "'", '"', ">", "<", "</", "<script>", "<br/>", "<li>", "\0", "&#xffffffff;", "<td>", "="]
    assert all(isinstance(html_text.main_text("".join(r.choices(parts, k=r.randrange(1, 25)))), str) for _ in range(3000))


def plain_density(node, body_share):
    """Density of a node from its counts, each taken by walking all of its subtree."""
    def walk(x, inside):
        for c in x.children:
            if isinstance(c, str):
                n = sum(not ch.isspace() for ch in c)
                yield n, 0, n * inside, 0
            else:
                yield 0, 1, 0, int(c.tag == "a")
                yield from walk(c, inside or c.tag == "a")

    chars, tags, link_chars, link_tags = (sum(x) for x in zip(*walk(node, node.tag == "a"), strict=True)) if node.children else (0,) * 4
    share = body_share if body_share is not None else link_chars / max(1, chars)
    if not chars:
        return 0.0
    base = math.log(max(math.e, chars / max(1, chars - link_chars) * link_chars + share * chars + math.e))
    return chars / max(1, tags) * math.log(max(1.0, chars / max(1, link_chars) * max(1, tags) / max(1, link_tags))) / base


def test_the_subtree_of_the_largest_sum_is_taken(spark, data):
    """For all pages, with and without their article tags: densities by plain walks, then the largest sum of children's densities."""
    for row in spark.read.parquet(f"{data}/pages.parquet").select("html").collect():
        for html in (row["html"], row["html"].replace("article>", "section>")):
            tree = html_text._Tree()
            tree.feed(html)
            tree.close()
            html_text._prune(tree.root)
            level, nodes = [tree.root], []
            while level:
                nodes += level
                level = [c for n in level for c in n.children if not isinstance(c, str)]
            body = next((n for n in nodes if n.tag == "body"), tree.root)
            nodes = nodes[nodes.index(body) :]
            chars = "".join(html_text._blocks(body))
            links = "".join("".join(html_text._blocks(n)) for n in nodes if n.tag == "a")
            share = len("".join(links.split())) / max(1, len("".join(chars.split())))
            nodes = [n for n in nodes if n is body or _under(n, body)]
            density = {id(n): plain_density(n, share) for n in nodes}
            sums = [sum(density[id(c)] for c in n.children if not isinstance(c, str)) or density[id(n)] for n in nodes]
            best = nodes[max(range(len(nodes)), key=lambda i: (round(sums[i], 6), -i))]
            text = html_text.main_text(html).split("\n")
            assert [b for b in html_text._blocks(best) if b not in text] == []
            if best.parent is body:  # nothing on these pages stands beside the text and is as dense
                assert text == html_text._blocks(best)


def _under(node, body):
    while node is not None and node is not body:
        node = node.parent
    return node is body


def test_page_without_an_article():
    long = " ".join(f"<p>{prose(i, 40)}</p>" for i in range(5))
    links = "".join(f"<li><a href='/{i}'>Link {i} to somewhere else</a></li>" for i in range(30))
    html = f"<body><div id=top><ul>{links}</ul></div><div id=content><h2>Heading</h2>{long}</div><div><a href=a>A</a> <a href=b>B</a></div></body>"
    assert html_text.main_text(html).split("\n") == ["Heading", *(prose(i, 40) for i in range(5))]


def test_page_with_its_title_beside_the_text():
    text = "".join(f"<p>{prose(i, 30)}</p>" for i in range(4))
    links = "".join(f"<li><a href='/{i}'>Link number {i}</a></li>" for i in range(20))
    html = f"<body><div class=x><ul>{links}</ul></div><div class=post><h1>Title</h1><div>{text}</div></div><div class=x><ul>{links}</ul></div></body>"
    assert html_text.main_text(html).split("\n") == ["Title", *(prose(i, 30) for i in range(4))]
    html = f"<body><ul>{links}</ul><h1>Title</h1><div>{text}</div><ul>{links}</ul></body>"
    assert html_text.main_text(html).split("\n") == ["Title", *(prose(i, 30) for i in range(4))]


def test_pages_table(spark):
    df = spark.createDataFrame([(1, None, "p", "t"), (1, None, "p", "t"), (2, "<p>x", "p", "t")], "page_id long, html string, page string, text string")
    out = html_text.extract_main_text(df).collect()
    assert sorted((r["page"]["page_id"], r["text"], r["n_chars"]) for r in out) == [(1, "", 0), (1, "", 0), (2, "x", 1)]
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def brute_shares(nodes, budget):
    """Children by weight, the sated ones left out one after the other."""
    got, open_ = {}, dict(nodes)
    while open_:
        total = sum(w for _, w in open_.values())
        left = budget - sum(got.values())
        full = [k for k, (cap, w) in open_.items() if cap * total <= left * w]
        if not full:
            for k, (_, w) in open_.items():
                got[k] = left * w // total if k not in got else got[k]
            spent = budget - left
            return {k: (left * nodes[k][1] // total if k in open_ else got[k]) for k in nodes} if spent >= 0 else got
        for k in full:
            got[k] = open_.pop(k)[0]
    return got


@pytest.mark.parametrize("seed", range(4))
def test_shares(spark, seed):
    r = random.Random(seed)
    nodes = {f"n{i}": (r.randrange(0, 400), r.randrange(1, 9)) for i in range(7)}
    budget = r.randrange(0, 1500)
    df = spark.createDataFrame([(k, c // 2) for k, (c, _) in nodes.items()], "source string, tokens long")
    nodes = {k: (c // 2 * 2, w) for k, (c, w) in nodes.items()}
    out = mixing.allot(df, ["source"], {"source": {k: w for k, (_, w) in nodes.items()}}, F.lit(budget).cast("long"), 2)
    assert {x["source"]: x["got"] for x in out.collect()} == brute_shares(nodes, budget)


def test_mix(odd, none):
    levels = {"domain": F.col("lang"), "lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mix(odd, levels, {}, 0.5, 2).collect()
    assert out and all(r["n_tokens"] > 0 and 1 <= r["epochs"] <= 2 for r in out)
    whole = mixing.mix(odd, levels, {}, 2.0, 2).collect()
    assert len(whole) == 11 and {r["epochs"] for r in whole} == {2}
    assert mixing.mix(none, levels, {}).count() == 0


def test_warc(spark):
    big = "é" * 600
    rows = [(1, "http://a/%41 b\r\nX: y", big), (2, None, big), (2, None, big), (9, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    out = warc.round_trip(df, payloads=True).collect()
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out)
    assert got == [(-1, "revisit", 9, 1200), (1, "revisit", 9, 1200), (2, "revisit", 9, 1200), (2, "revisit", 9, 1200), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (9, "response", None, 1200)]
    urls = {r["page_id"]: r["url"] for r in out}
    assert urls[1] == rows[0][1] and urls[2] is None
    assert {bytes(r["payload"]).decode() for r in out if r["page_id"] == 9} == {big}
    assert warc.round_trip(df.limit(0)).count() == 0


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_zip64_and_comments(monkeypatch):
    record = warc.gzip.compress(warc.make_record(1, "u", b"x", None, False))
    plain = warc.make_package([(1, record)])
    assert [r["page_id"] for r in warc.read_package(Bytes(plain), len(plain))] == [1]
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    large = warc.make_package([(1, record), (2, record)])
    assert b"PK\x06\x06" in large and len(list(warc.read_package(Bytes(large), len(large)))) == 2
    out = io.BytesIO(plain)
    with zipfile.ZipFile(out, "a") as z:
        z.comment = b"a comment"
        z.writestr("other.txt", "packed", zipfile.ZIP_DEFLATED)
    data = out.getvalue()
    assert set(warc.read_directory(Bytes(data), len(data))) == {warc.DATA, warc.INDEX}
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(warc.make_record(1, "u", b"payload", None, False).replace(b"payload\r\n", b"paylaod\r\n"))


@pytest.mark.parametrize(
    "wrapped",
    [
        '<div class="content with-sidebar"><article>{}</article></div>',
        '<div id="layout-sidebar-right"><article>{}</article></div>',
        '<div class="post social-enabled">{}</div>',
        '<div class="widget">{}</div>',
        '<article><p>Before.</p><section id="related-work">{}</section><p>After, and as long as what is said above it, or so.</p></article>',
    ],
)
def test_names_of_wrappers_take_no_text_away(wrapped):
    text = "<p>The text of the page, in some words of its own.</p>"
    page = f'<body><nav><a href="/">Home</a></nav>{wrapped.format(text)}<div class="sidebar"><p>More.</p></div><div class="share-buttons">Send</div></body>'
    out = html_text.main_text(page)
    assert "in some words of its own" in out and "More." not in out and "Send" not in out


def test_quality(odd, none):
    out = {r["doc_id"]: r for r in quality.judge(odd).collect()}
    assert all(out[i]["base_failed"] and not out[i]["kept"] and out[i]["n_words"] == 0 for i in (0, 1, 2))
    assert out[7]["n_repeat_words"] == out[7]["n_words"] == 30_000 and out[7]["base_failed"]
    assert out[4]["n_words"] == 80 and out[4]["n_repeat_words"] == 0 and out[4]["kept"]
    assert out[11]["n_words"] == 1 and out[11]["n_shouts"] == 3
    assert quality.judge(none).count() == 0


def drawn(model, n, seed, abstain=0.3):
    """Counts of patterns of votes drawn from a model."""
    r, counts = random.Random(seed), {}
    for _ in range(n):
        c = r.choices(range(len(model.shares)), model.shares)[0]
        votes = tuple(0 if r.random() < abstain else -1 if r.random() < b else 1 for b in model.bad[c])
        counts[votes] = counts.get(votes, 0) + 1
    return [(*v, k) for v, k in counts.items()]


NAMES = list("abcdefgh")
SPOKEN = {"x": NAMES[:4], "y": NAMES[4:]}
PATTERN = ", ".join(f"{n} int" for n in NAMES) + ", n long"


def test_accuracies_are_recovered_from_drawn_votes(spark):
    true = quality.Model((0.7, 0.2, 0.1), ((0.02, 0.1, 0.05, 0.2) * 2, (0.9, 0.6, 0.8, 0.7, 0.1, 0.05, 0.2, 0.1), (0.1, 0.05, 0.2, 0.1, 0.6, 0.9, 0.7, 0.8)))
    model = quality.fit(spark.createDataFrame(drawn(true, 60_000, 3), PATTERN), NAMES, SPOKEN, rounds=200)
    assert model.shares == pytest.approx(true.shares, abs=0.02)
    for found, told in zip(model.bad, true.bad, strict=True):
        assert found == pytest.approx(told, abs=0.03)
        assert all(0 < x < 1 for x in found)


def test_a_noisy_rule_loses_its_veto_and_several_rules_outvote_one(spark):
    """Rule a votes bad on a third of all texts whatever they are; c and d agree on the bad ones."""
    true = quality.Model((0.8, 0.1, 0.1), ((0.33, 0.02, 0.02, 0.02) + (0.02,) * 4, (0.33, 0.9, 0.9, 0.9) + (0.02,) * 4, (0.33, 0.02, 0.02, 0.02) + (0.9,) * 4))
    model = quality.fit(spark.createDataFrame(drawn(true, 30_000, 4), PATTERN), NAMES, SPOKEN)
    cases = {(-1, 1, 1, 1, 1, 1, 1, 1): True, (1, -1, -1, 1, 1, 1, 1, 1): False, (1, -1, 1, 1, 1, 1, 1, 1): True, (0,) * 8: True, (1, 1, 1, 1, -1, -1, 0, 0): False}
    votes = spark.createDataFrame(list(cases), [*NAMES])
    told = {tuple(r[:8]): r[8] for r in votes.select(*NAMES, model.posterior([F.col(c) for c in NAMES])).collect()}
    assert {v: p >= 0.5 for v, p in told.items()} == cases


def test_estimate_without_rows_and_a_tie(spark):
    empty = spark.createDataFrame([], PATTERN)
    assert quality.fit(empty, NAMES, SPOKEN) == quality.start_model(NAMES, SPOKEN)
    alike = quality.Model((0.5, 0.5), ((0.2,), (0.2,)))
    assert spark.createDataFrame([(-1,)], ["a"]).select(alike.posterior([F.col("a")])).first()[0] == 0.5


def test_pipeline_over_empty_documents(spark, data, none):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        assert out.count() == 0


def test_pipeline_stages_with_clashing_columns(spark, data, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").withColumns({c: F.lit("x") for c in ("Domain", "n_tokens", "key", "text_id", "doc", "clean")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        if name == "mixing":
            assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "key", "text_id", "doc", "clean", "domain", "n_tokens", "epochs"])
        else:
            assert out.columns == docs.columns and out.where("key <> 'x' or doc <> 'x' or clean <> 'x'").count() == 0
        assert out.count() > 0


def test_pipeline_stages_over_odd_documents(spark, data, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, data).collect()
        assert len(rows) == {"language_id": 10, "near_duplicates": 10, "decontamination": 14, "secrets": 14, "mixing": len(rows)}[name]
