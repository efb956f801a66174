"""Operators held against plain Python over small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logwarden.llm import (chat_format, decontaminate, html_extract, language_id, packing, quality, sentence_dedup,
                           simhash, substring_dedup, url_filter)
from logwarden.llm.components import components
from logwarden.llm.deep_shallow import common_prefixes, order_of, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, words string, found int, row int"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 7, 8) for i, t in rows], DOCS)


def words_text(rng, n, sep=" "):
    return sep.join(rng.choice(["aa", "Bb", "é", "c,", "dd.", "7", "x\ny", "Z!"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared = [words_text(rng, k) for k in (14, 60, 90)]
    out = [(i, " ".join(rng.choice([words_text(rng, rng.randrange(1, 60)), rng.choice(shared)]) for _ in range(3)))
           for i in range(40)]
    out += [(100, None), (101, ""), (102, " \t\n"), (103, out[3][1]), (103, out[3][1]), (104, out[4][1]), (None, out[5][1]),
            (105, "word"), (106, "a" * 3000), (107, "ab " * 500), (108, words_text(rng, 6000)), (109, "...!!! ###")]
    return out


def test_empty_tables(spark):
    docs = table(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(docs, bench).count() == 0
    assert substring_dedup.remove_repeats(docs).count() == 0
    assert sentence_dedup.spans(docs).count() == 0
    assert simhash.classes(docs).count() == 0
    assert packing.pack_documents(docs, TOKENIZER).count() == 0
    assert quality.judge(docs, quality.fit(docs, docs)).count() == 0
    assert language_id.predict(docs, language_id.fit(docs)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(pages).count() == 0
    assert url_filter.filter_urls(pages, spark.createDataFrame([], "key string"), []).count() == 0
    assert chat_format.format_chats(chat_format.gather(
        spark.createDataFrame([], "conv_id long, turn long, role string, text string")), "conv_id").count() == 0


# -- substring dedup ----------------------------------------------------------

def removed_bytes(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(t[k:k + 200] for _, t in texts for k in range(len(t) - 199))
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if times[t[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        runs = len(re.findall(b"\1+", bytes(gone)))
        yield i, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()


@pytest.mark.parametrize("max_group", [substring_dedup.MAX_GROUP, 2])
def test_substrings(spark, rows, max_group):
    got = substring_dedup.remove_repeats(table(spark, rows), max_group).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, removed_bytes(rows)))
    assert sum(r.n_removed for r in got) > 0


def test_kept_bytes(spark, rows):
    for r in substring_dedup.remove_repeats(table(spark, rows), with_kept=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_deep_shallow():
    rng = random.Random(2)
    base = [bytes(rng.randrange(97, 99) for _ in range(60)) for _ in range(6)]
    strings = [rng.choice(base)[:rng.randrange(20, 61)] + bytes([rng.randrange(97, 100)]) for _ in range(400)]
    group = np.array([rng.randrange(3) for _ in strings])
    words = words_of(strings, 64)
    order = order_of(words, group)
    padded = [s[:64].ljust(64, b"\0") for s in strings]
    assert [(group[i], padded[i]) for i in order] == sorted(zip(group, padded))
    shared = common_prefixes(words, group, order)
    for k in range(1, len(order)):
        a, b = order[k - 1], order[k]
        want = -1 if group[a] != group[b] else next((i for i in range(64) if padded[a][i] != padded[b][i]), 64)
        assert shared[k] == want


# -- language -----------------------------------------------------------------

def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    net = language_id.fit(docs.filter(~held), per_language=200)
    test = docs.filter(held & F.col("text").isNotNull()).select("doc_id", "lang")
    pairs = language_id.predict(docs, net).join(test, "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in pairs]) > 0.95
    assert all(0 <= r.score <= 1 for r in pairs)


def test_language_defined(spark, rows):
    docs = table(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("xx"))
    net = language_id.fit(docs, epochs=1)
    got = {r.doc_id: r for r in language_id.predict(docs, net).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {100, 101, 102, 109}
    assert got[100].score == 0 and got[108].lang_pred in ("en", "xx")
    kept = language_id.keep_known(docs, net)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


# -- decontamination ----------------------------------------------------------

def brute_scan(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = [(str(i), word.findall((t or "").translate(LOWER))) for i, t in items]
    for i, t in rows:
        w = word.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for item, x in cut:
            n = min(13, len(x))
            windows = {tuple(x[k:k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids.add(item)
        yield i, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("max_windows", [decontaminate.MAX_WINDOWS, 1])
def test_scan(spark, rows, max_windows):
    items = [(1, rows[0][1][:200]), (2, rows[1][1]), (3, "aa7 Bb12"), (4, None), (5, "!!"), (2, rows[2][1][5:300]),
             (7, rows[1][1])]
    bench = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, words string")
    got = decontaminate.scan(table(spark, rows), bench, max_windows=max_windows).select(
        "doc_id", "n_words", "n_hit", "item_ids", "contaminated").collect()
    want = list(brute_scan(rows, items))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = decontaminate.remove_documents(table(spark, rows), bench, max_windows=max_windows)
    assert kept.columns == table(spark, rows).columns
    assert kept.count() == sum(not w[4] for w in want) < len(rows)
    spans = decontaminate.remove_spans(table(spark, rows), bench, max_windows=max_windows)
    assert Counter(len(re.findall(decontaminate.GAP.replace("[", "[^", 1) + "+", (r.text or "").translate(LOWER)))
                   for r in spans.collect()) == Counter(w[1] - w[2] for w in want)


# -- pages --------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="site-header">Site</header><nav><ul><li><a href="/">Home</a><li><a href="/x">About</a></ul></nav>
<div class="cookie-notice">We use cookies. Accept, or decline.</div><main><article><h1>Head &amp; line</h1>
<p>First <b>para</b>graph, with   space &eacute;&#233;.<p>Second one &lt;here&gt;;<br>after a break. It is longer, so it counts.
<ul><li>item one</ul><!-- <p>hidden</p> --></article><aside>Also read</aside>
<section id="comments"><p>Great post, thanks! I really, really liked it, and will be back. More, please!</p></section></main>
<div class="ad">Buy now</div><form><label>Mail</label><input></form><footer>&copy; 2024"""


def test_main_text(spark):
    text = "Head & line First paragraph, with space éé. Second one <here>; after a break. It is longer, so it counts. item one"
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "just text"), (5, "u", "<script>x"), (1, "u", PAGE),
            (6, "u", "<p>" + "long " * 50000), (7, "u", "<div " * 3000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got[1] == text and got[2] == got[3] == got[5] == "" and got[4] == "just text"
    assert got[6] == ("long " * 50000).strip() and html_extract.extract(pages).count() == len(rows)


# -- sentences ----------------------------------------------------------------

def brute_sentences(rows, run, least):
    cut = [(i, sentence_dedup.sentences((t or "").encode()), t) for i, t in rows]
    keys = [[b" ".join(b"".join(s[k:k + run]).lower().split()) for k in range(len(s) - run + 1)] for _, s, _ in cut]
    place = [sentence_dedup.LAST if i is None else i for i, _, _ in cut]
    lead = {}
    for r, own in enumerate(keys):
        for k in own:
            lead[k] = min(lead.get(k, place[r]), place[r])
    times = Counter(k for own in keys for k in own)
    for r, (i, s, t) in enumerate(cut):
        gone = set()
        for at, k in enumerate(keys[r]):
            if len(k.split()) >= least and times[k] > 1 and not (place[r] == lead[k] and keys[r].index(k) == at):
                gone.update(range(at, at + run))
        yield i, t if not gone else b"".join(x for k, x in enumerate(s) if k not in gone).decode(), len(s), len(gone)


def test_sentences(spark, rows):
    got = sentence_dedup.spans(table(spark, rows), 3, 4).collect()
    want = list(brute_sentences(rows, 3, 4))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and any(w[3] for w in want)
    whole = sentence_dedup.remove_repeats(table(spark, rows), 3, 4)
    assert whole.columns == table(spark, rows).columns and whole.count() == len(rows)
    for _, t in rows:
        assert b"".join(sentence_dedup.sentences((t or "").encode())).decode() == (t or "") or not (t or "").strip()


def test_long_passage_goes(spark):
    rng = random.Random(1)
    fresh = lambda n: " ".join("".join(rng.choices(string.ascii_lowercase, k=7)) for _ in range(n))
    passage = fresh(55) + "."
    docs = [(i, f"{fresh(30)}.\n{passage}\n{fresh(20)}.") for i in range(5)]
    got = {r.doc_id: r.text for r in sentence_dedup.spans(table(spark, docs)).collect()}
    assert got[0] == docs[0][1] and all(got[i] == docs[i][1].replace(passage + "\n", "") for i in range(1, 5))


# -- urls ---------------------------------------------------------------------

def test_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    urls = ["http://a.example.net/en/1", "http://example.net/fr/", "https://notexample.com/de/", "https://X.Example.COM/de/?q",
            "no url", None, "", "http://bad.test/a/b/c.html?x#y", "http://good.test/a/b.html", "http://sub.bad.test/z",
            "ftp://x.org/fr/1", "http://spam.org", "http://spam.org/fr/", "http://", "http://h" + "/p" * 20000, "http://net",
            "http://site.test/a/b/", "http://site.test/a/bc"]
    listed = spark.createDataFrame([(k,) for k in ("bad.test/", "good.test/a/", "spam.org/", "site.test/a/b/", None)], "key string")
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)], "page_id long, url string, key string, hit string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed, rules).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("example.net/en/", "allow"), ("net/", "block"), (None, "allow"), ("example.com/de/", "block"), (None, "allow"),
        (None, "allow"), (None, "allow"), (None, "block"), (None, "block"), (None, "block"), ("org/fr/", "allow"),
        (None, "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow")]


def test_bloom_passes_all_listed(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".test/")).alias("key"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".test/x")).alias("url"))
    got = url_filter.filter_urls(pages, keys, []).filter("verdict = 'block'")
    assert got.count() == 3000 and got.agg(F.max("page_id")).first()[0] == 2999


# -- quality ------------------------------------------------------------------

def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
    times, hit = Counter(windows), set()
    for k, x in enumerate(windows):
        if times[x] > 1:
            hit.update(range(k, k + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed), w


def test_quality(spark, rows):
    buckets = 1 << 10
    rows = [*rows, (200, "a b c d e f g h " * 30), (201, "l\nl\n\nl #*$ <x>\n" + "w " * 40)]
    trusted = spark.createDataFrame([(k,) for k in (0, 1, 2, 2, 103)], "doc_id long")
    weights = quality.fit(table(spark, rows), trusted, buckets)
    h64 = lambda s, seed=42: xxhash.xxh64_intdigest(s.encode(), seed=seed)

    def features(w):
        return [h64(x) % buckets for x in w] + [h64(y, h64(x)) % buckets for x, y in zip(w, w[1:])]

    raw, good = Counter(), Counter()
    for i, t in rows:
        f = features(brute_rules(t)[1])
        raw.update(f)
        good.update(f if i in (0, 1, 2, 103) else ())
    want = [round(1e6 * (np.log(good[b] + 1) - np.log(raw[b] + 1) + np.log(sum(raw.values()) + buckets)
                         - np.log(sum(good.values()) + buckets))) for b in range(buckets)]
    assert max(abs(a - b) for a, b in zip(weights, want)) <= 1
    got = quality.judge(table(spark, rows), weights, 0).collect()
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda x: (x[0] is None, x[0]))):
        counts, w = brute_rules(t)
        f = features(w)
        score = sum(weights[b] for b in f) / len(f) if f else 0
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts, i
        assert abs(r.score - score) < 1e-6 and r.kept == (not counts[5] and score >= 0)


# -- near duplicates ----------------------------------------------------------

def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_linked(values):
    """For each value the least value reachable by steps of three bits or fewer."""
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def test_classes(spark, rows):
    fps = [fingerprint(t) for _, t in rows]
    roots = least_linked(set(fps))
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    got = simhash.classes(table(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(
        str((i, f"{f:016x}", least.get(roots[f]))) for (i, _), f in zip(rows, fps))
    kept = simhash.keep_one(table(spark, rows))
    assert kept.columns == table(spark, rows).columns and kept.count() == len(set(roots.values()))


@pytest.mark.parametrize("max_group", [simhash.MAX_GROUP, 40])
def test_dense_links(spark, max_group):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    values = {base, *(rng.getrandbits(64) for _ in range(50))}
    while len(values) < 700:
        x = rng.choice(sorted(values)) if rng.random() < 0.3 else base
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        values.add(x)
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    root = {r.node: r.root for r in components(simhash.link_fingerprints(df, max_group)).collect()}
    want = least_linked(values)
    classes = lambda f: sorted(sorted(v for v in values if f(v) == r) for r in {f(v) for v in values})
    back = {v: s for s, v in signed.items()}
    assert classes(lambda v: root.get(back[v], back[v])) == classes(lambda v: want[v])


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260))
                                                                               for _ in range(40)] + [(5, 5), (7, 6)]
    up = {v: v for e in edges for v in e}
    for _ in range(len(up)):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(v, v) == r for v, r in up.items())


# -- packing ------------------------------------------------------------------

def test_packing(spark, rows):
    rows = [*rows, (300, "It's <|endoftext|> \x1c İstanbul étude naïve ÀÉ"), (301, "Привет, мир! 你好")]
    docs = table(spark, rows)
    got = packing.pack_documents(docs, TOKENIZER).collect()
    encode = Tokenizer.from_file(TOKENIZER).encode
    want = Counter()
    for i, t in rows:
        ids = [*encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at:at + 2048], "<u4")
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= sum(r.length for r in got) / 2048 + 2


def test_words_are_looked_up_once():
    """A chunk asks the table for each of its distinct words, not for every word; and a small table that overflows is exact."""
    class Counting(dict):
        asked = 0

        def get(self, *args):
            self.asked += 1
            return super().get(*args)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    texts = ["the cat, the dog. ÀÉ", "the cat " * 500, "a,.b x×y", " \t", "<|endoftext|> the", "日本 the"]
    exact = [np.array(e.ids, "<u4").tobytes()
             for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    words = packing.WordTokenizer(TOKENIZER)
    assert words(texts) == exact
    words.known = Counting(words.known)
    assert words(texts) == exact and words.known.asked < 50
    small = packing.WordTokenizer(TOKENIZER, 3)
    assert [small([t])[0] for t in texts] == exact


def test_bounded_bins():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 2049) for _ in range(20000)]
    bins = packing.Bins(2048, 64)
    for n in sizes:
        bins.place(n)
        assert bins.open <= 64
    assert bins.next < 1.06 * sum(sizes) / 2048


# -- chats --------------------------------------------------------------------

def test_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "~1~0~", "<|user|>\nx</s>\n", "|>\n<|", "", None, "a<", "\n", "é😀[INST", "~</s", "<~1|>"]
    rows = [(c, t, ["user", "assistant", "system", "<|x|>\n", None][(c + t) % 5], hard[(c * 3 + t) % len(hard)])
            for c in range(12) for t in range(9)] + [(50, 1, "user", "b"), (50, 1, "user", "a"), (50, None, "assistant", "z"),
                                                     (None, 1, "user", "q"), (51, 0, "assistant", "long " * 20000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, rows string")
    got = chat_format.format_chats(chat_format.gather(df), "conv_id").select(
        "id", chat_format.parse(F.col("formatted")).alias("read"), "formatted", "loss_spans",
        chat_format.masked(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert {r.id for r in got} == set(want)
    for r in got:
        turns = [x[2:] for x in sorted(want[r.id])]
        assert [(t.role, t.text) for t in r.read] == turns
        assert r.loss == "".join(text for role, text in turns if role == "assistant")


def test_layouts(spark):
    rows = [
        ("1", [("user", "a"), ("assistant", "b")], None, None, None, None, None, None),
        ("2", None, [("human", "a"), ("gpt", "b")], None, None, None, None, None),
        ("3", None, None, "a", None, None, None, "b"),
        ("4", None, None, None, "do", "this", "b", None),
        ("5", None, None, None, "do", None, "b", None),
        ("6", None, None, "odd", "do", None, None, None),
        ("7", None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, """id string, messages array<struct<role:string,content:string>>,
        conversations array<struct<`from`:string,value:string>>, prompt string, instruction string, input string,
        output string, completion string""").withColumn("turns", F.lit(1))
    got = {r.id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat_format.format_chats(df, "id").collect()}
    pair = [("user", "a"), ("assistant", "b")]
    assert got == {"1": ("messages", pair), "2": ("from and value", pair), "3": ("prompt and completion", pair),
                   "4": ("instruction with input", [("user", "do\n\nthis"), ("assistant", "b")]),
                   "5": ("instruction", [("user", "do"), ("assistant", "b")]), "6": (None, None), "7": (None, None)}
