"""Quality rules, chat formatting, HTML extraction and language identification."""

import html
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from freshet.llm import chat, html_text, language, quality, queries

SF = "/root/testdata/sf0.001"


# --- quality -----------------------------------------------------------------

TEXTS = [None, "", " \n\t", "one", "a b c a b c", "a b a b a b a", "x\nx\n x\nx", "é漢 #|#\n\n<b>", "w " * 9000, "q\x0bq\x0cq\rq\x85q q"]


def brute_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return quality.Measures(
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered)
    )


def test_measures():
    r = random.Random(0)
    for text in TEXTS + [" ".join(r.choice("abcd") for _ in range(r.randrange(60))) for _ in range(200)]:
        assert quality.measure(None if text is None else text.encode()) == brute_measure(text)


def test_ledger_policies_and_ablations(spark):
    r = random.Random(1)
    texts = TEXTS + [" ".join(r.choice(["the", "#", "of", "x|", "supercalifragilistic", "eau"]) for _ in range(r.randrange(120))) for _ in range(80)]
    rows = [(k if k % 9 else None, t, "clash") for k, t in enumerate(texts)] * 2
    book = quality.ledger(spark.createDataFrame(rows, "doc_id long, text string, failed string"))
    bits = [quality.failure_bits(brute_measure(t)) for _, t, _ in rows]
    assert sorted(x["failed"] for x in book.collect()) == sorted(bits)
    dropped = {p: sum(any(b & quality.BIT[x] for x in rules) for b in bits) for p, rules in quality.POLICIES.items()}
    for policy, n in dropped.items():
        assert book.where(quality.fails(policy)).count() == n
    found = {(x["policy"], x["rule"]): x for x in quality.ablations(book).collect()}
    assert set(found) == {(p, x) for p, rules in quality.POLICIES.items() for x in rules}
    for (policy, rule), x in found.items():
        rest = quality.policy_mask(quality.POLICIES[policy]) & ~quality.BIT[rule]
        assert (x["n_docs"], x["n_dropped"], x["n_without"]) == (len(bits), dropped[policy], sum(b & rest != 0 for b in bits))
        assert x["n_only"] == sum(b & rest == 0 and b & quality.BIT[rule] != 0 for b in bits)
    assert quality.ledger(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- chats -------------------------------------------------------------------


def brute_chats(rows):
    convs = defaultdict(set)
    for conv, turn, role, text, _ in rows:
        convs[conv].add((turn, role, text))
    said = {c: tuple((r, t) for _, r, t in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0))) for c, turns in convs.items()}
    kept = {s for s in said.values() if not any(len(o) > len(s) and o[: len(s)] == s for o in said.values())}
    out = []
    for s in kept:
        ids = sorted((c for c in said if said[c] == s), key=lambda c: (c is None, c))
        text = "".join(f"<|im_start|>{r or ''}\n{(t or '').replace('<|im_start|>', '< |im_start|>').replace('<|im_end|>', '< |im_end|>')}<|im_end|>\n" for r, t in s)
        out.append((ids[0], len(s), len(ids), text))
    return sorted(out, key=repr)


def logged(seed):
    r = random.Random(seed)
    base = [[(r.choice(["user", "assistant", None]), r.choice(["hi", "", None, "<|im_end|> x", "漢", "yes " * 500])) for _ in range(n)] for n in (1, 4, 9, 30)]
    rows = []
    for conv in range(40):
        turns = r.choice(base)[: r.randrange(1, 31)]
        if conv % 5 == 0:
            turns = turns + [("user", f"own {conv}")]
        start = r.choice([0, 0, 3, 510])
        rows += [(conv or None, start + k, role, text, "c") for k, (role, text) in enumerate(turns)]
    rows += rows[:25] + [(99, None, "user", "hi", "c"), (99, 5, "user", "hi", "c")]
    r.shuffle(rows)
    return rows


def test_chats(spark):
    rows = logged(3)  # turns 510 and on lie in two blocks
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string")
    got = [(x["conv"], x["n_turns"], x["n_logged"], x["chat"]) for x in chat.format_chats(log).collect()]
    assert sorted(got, key=repr) == brute_chats(rows)
    assert chat.format_chats(log.where("turn > 9999")).collect() == []


def test_a_long_conversation_is_one_row(spark):
    """A conversation over many blocks, a snapshot of it, and one that leaves it late."""
    turns = [(k, ["user", "assistant"][k % 2], f"turn {k} " + "x" * (k % 7)) for k in range(5000)]
    rows = [(1, *t, "") for t in turns] + [(2, *t, "") for t in turns[:600]] + [(3, *t, "") for t in turns[:599]] + [(3, 599, "user", "else", ""), (4, *turns[0], "")]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, x string").repartition(3)
    got = [(x["conv"], x["n_turns"], x["n_logged"], x["chat"]) for x in chat.format_chats(log).collect()]
    assert sorted(got) == brute_chats(rows) and [g[1] for g in sorted(got)] == [5000, 600]


def test_long_conversations_equal_the_sql(spark, tmp_path):
    turns = [(k, ["user", "assistant"][k % 2], f"turn {k}") for k in range(600)]
    rows = [(1, *t) for t in turns] + [(2, *t) for t in turns[:513]] + [(3, *turns[0]), (3, 1, None, "a"), (5, 700, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    found = queries.QUERIES["op6_chat_format"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    theirs = con.execute(queries.ORACLES["op6_chat_format"])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(theirs.fetchall()) == sorted(tuple(r) for r in found.select(*names).collect())


def test_chats_are_plain_dataframe_work(spark):
    log = spark.createDataFrame(logged(4), "conv_id long, turn long, role string, text string, x string")
    plan = chat.format_chats(log)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- HTML --------------------------------------------------------------------


def test_pages_of_the_table(spark):
    """The pages' own pattern, cut out by regular expressions."""

    def brute(page):
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:p|h1)>", body)]
        return "\n\n".join(" ".join(b.split()) for b in blocks if b.split())

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html", html_text.extracted("html")).collect()
    assert pages and all(p["text"] == brute(p["html"]) for p in pages)


LONG = "This is the text of the page that has a lot of words in it and that is not an article, but it is as good as one."


@pytest.mark.parametrize(
    "page, blocks",
    [
        (None, []),
        ("", []),
        ("<article></article>", []),
        ("<article><h1>A &amp; B&nbsp;&lt;c&gt;</h1><p>x\n y<b>z</b>w</article>", ["A & B <c>", "x yzw"]),
        ("<body><header>Site</header><article><header><h1>T</h1></header><p>p</p></article></body>", ["T", "p"]),
        ("<article><p>a<br>b<br><br>c</p></article>", ["a b", "c"]),
        ("<article><p>a<script>var t='</p>';</script>b<style>p{}</style></p><!-- no <p>x</p> --></article>", ["ab"]),
        ("<article><p>a</p><aside>s</aside><form>f</form><div class='ad-box'>x</div><div class='cookie-notice'>y</div><p>b</p></article>", ["a", "b"]),
        ("<main><p>a</p><section id=comments><article class=comment><p>c</p></article></section></main><p>after</p>", ["a"]),
        ("<article><ul><li>one<li>two</ul><p hidden>h</p><p style='display: none'>n</p><p aria-hidden=true>g</p></article>", ["one", "two"]),
        ("<article><p>Read <a href=x>this</a> now please</p><p><a href=y>All of it a link</a></p></article>", ["Read this now please"]),
        ("<body class='has-sidebar'><div class='content-wrapper'><article><p>a</p></article></div><div class=sidebar>s</div></body>", ["a"]),
        (f"<div><a href=/>Home</a> <a href=/b>News</a></div><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>&copy; me</p>", ["Head", LONG, "Short.", LONG]),
        ("<article><p>x<![CDATA[ y ]]>z<p", ["xz"]),
        ("<article><p>HE!! ATHTIEREN!! ING!! " + "EDOU!! " * 30 + "</p></article>", ["HE!! ATHTIEREN!! ING!! " + " ".join(["EDOU!!"] * 30)]),
    ],
)
def test_blocks(page, blocks):
    assert html_text.main_text(None if page is None else page.encode()) == "\n\n".join(blocks)


def test_nothing_of_an_article_is_dropped_or_cut():
    r = random.Random(2)
    blocks = [" ".join(r.choice(["zx", "qq", "the", "é"]) for _ in range(r.choice([1, 5, 60, 5000]))) for _ in range(60)]
    page = "<nav>menu</nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"
    assert html_text.main_text(page.encode()) == "\n\n".join(blocks)


# --- language ----------------------------------------------------------------


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.train(docs)


def test_held_out_accuracy(docs, model):
    told = docs.select("doc_id", "lang", language.held_out().alias("held"), language.predicted(model).alias("told")).collect()
    held = [t for t in told if t["held"]]
    assert all(t["held"] == (zlib.crc32(str(t["doc_id"]).encode()) % 4 == 2) for t in told)
    assert len(held) > 100 and sum(t["lang"] == t["told"]["lang"] for t in held) >= 0.98 * len(held)
    assert all(0 <= t["told"]["score"] <= 1 for t in told)
    assert (model.weights == 0).mean() > 0.3  # the elastic net leaves weights out
    assert model.temperature in language.TEMPERATURES


def test_frequencies_cover_all_that_may_be_learned_from(docs, model):
    learned = [r["text"].encode() for r in docs.where(~language.held_out()).collect()]
    seen = Counter(t for text in learned for t in (language.term_counts(text) or ([],))[0])
    n = sum(language.term_counts(text) is not None for text in learned)
    import numpy as np

    expected = np.log((1 + n) / (1 + np.array([seen[t] for t in range(language.FEATURES)]))) + 1
    assert np.allclose(model.idf, expected)


def test_answers_without_letters(model):
    for text in (None, b"", b"  12 !? \n", "①②".encode()):
        assert model.predict(text) == ("und", 0.0)
    assert model.predict("Das ist ein ungheit und die schung der".encode())[0] == "de"
    assert model.predict(b"\xff\xfe the of and that thing")[0] == "en"


def test_training_ignores_held_out_labels(spark, docs, model):
    lied = docs.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    other = language.train(lied)
    assert other.languages == model.languages and abs(other.weights - model.weights).max() < 1e-9


def test_filter_and_awkward_rows(spark, model, monkeypatch):
    schema = "doc_id long, text string, lang string, told int, label string"
    rows = [(1, "the thing of and", "en", 1, "a"), (1, "the thing of and", "en", 1, "a"), (None, None, None, 2, None), (3, "", "en", 1, "a"), (4, "12 34", "de", 1, "a"), (None, "that is the thing", None, 5, None)]
    frame = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(language, "train", lambda *_: model)
    kept = language.keep_identified(frame)
    assert kept.columns == frame.columns
    assert sorted((r["text"], r["lang"]) for r in kept.collect()) == [("that is the thing", "en"), ("the thing of and", "en"), ("the thing of and", "en")]


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string, lang string"
    for rows in ([], [(1, "abc", None), (2, None, "en"), (None, "abc", "en")]):
        frame = spark.createDataFrame(rows, schema)
        empty = language.train(frame)
        assert empty.languages == [] and empty.predict(b"abc") == ("und", 0.0)
        assert language.keep_identified(frame).collect() == []
