"""Row-wise corpus operators against brute force: personal data, page text, decontamination, tokens."""

from __future__ import annotations

import hashlib
import html
import re

import public_tokenizers
import pytest
from tests_llm import ODD_TEXTS, SF, SF01, rows_of

from tracebeam.llm import decontam, html_text, pii, tokens

DOCS = rows_of("documents", SF01)


# -- personal data --------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn_ok(digits):
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain_spans(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        keep = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0,
                "card": 13 <= len(digits) <= 19 and luhn_ok(digits or "0"), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                keep.append(m.span())
        out[kind] = keep
    return out


TRICKY = [
    "a@b.c@d.e.f x@y z.@-.- @a.b a@b..c", "1.2.3.4.5.6.7.8 999.1.2.3.4 001.2.3.255 1.2.3.256",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  111111111111 12 34", "+1 (974) 555-3436 +12 +1.2.3.4-5 6)7 8 9",
    "+49 30 1234567 - and +4", "mail:first.last%x+y@sub-domain.example.co.uk. end",
]


@pytest.mark.parametrize("text", TRICKY + [r[1] for r in DOCS if re.search("[0-9@]", r[1] or "")][:300])
def test_plain_spans_equal_the_patterns(text):
    assert pii.detect(text) == plain_spans(text)


@pytest.mark.parametrize(
    "text, kind, source",
    [
        ("write to john (at) example (dot) com now", "email", "john (at) example (dot) com"),
        ("write to john [AT] mail.example [DOT] org.", "email", "john [AT] mail.example [DOT] org"),
        ("reach jane at example dot com today", "email", "jane at example dot com"),
        ("mail jоhn@еxample.com", "email", "jоhn@еxample.com"),
        ("call plus four nine three zero one two three four five six seven please", "phone",
         "plus four nine three zero one two three four five six seven"),
        ("card four one one one one one one one one one one one one one one one end", "card",
         "four one one one one one one one one one one one one one one one"),
        ("host one nine two dot one six eight dot one dot five up", "ip", "one nine two dot one six eight dot one dot five"),
        ("card ４１１１ １１１１ １１１１ １１１１.", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("a​b@exam​ple.com", "email", "a​b@exam​ple.com"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    base = pii.detect(text)
    found = pii.added(text, base)[kind]
    assert [text[lo:hi] for lo, hi in found] == [source]


def test_clean_prose_has_no_added_spans():
    for text in ("We met at the dot of five.", "one two three", "Look at example pages.", "Версия 1.2 и 3.4"):
        assert not any(pii.added(text, pii.detect(text)).values())
    assert all(not any(pii.added(r[1], pii.detect(r[1])).values()) for r in DOCS if r[1])


@pytest.mark.parametrize(
    "text, kind, source",
    [
        ("reach jane at example.com today", "email", "jane at example.com"),
        ("reach Jane AT mail.example.ORG.", "email", "Jane AT mail.example.ORG"),
        ("call plus 49 30 1234567 now", "phone", "plus 49 30 1234567"),
        ("mail a@zéro.com", "email", "a@zéro.com"),
    ],
)
def test_disguises_do_not_depend_on_other_content(text, kind, source):
    alone = pii.added(text, pii.detect(text))[kind]
    beside = pii.added(f"{text}\n(at) dot ѕ", pii.detect(text))[kind]
    assert alone == beside
    assert [text[lo:hi] for lo, hi in alone] == [source]


def test_the_pre_check_loses_nothing(monkeypatch):
    import random

    rng = random.Random(8)
    bits = [
        "jane", "at", "AT", "dot", "example", "com", "Com", ".", "..", "@", " ", "  ", " ", "-", "(", ")", "[", "]",
        "plus", "pluſ", "+", "one", "Four", "ſix", "zéro", "FÜNF", "neun", "4", "19", "192", "4111", ",", "\n", "é", "İ", "uK",
    ]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(2, 30))) for _ in range(20_000)]
    texts += [" ".join(rng.choice(bits) for _ in range(rng.randrange(2, 30))) for _ in range(20_000)]
    for _ in range(4_000):  # numbers and addresses in part spelled
        digits = [rng.choice(["1", "4", "one", "four", "Zwei"]) for _ in range(rng.randrange(4, 18))]
        texts.append(rng.choice(["", "+", "plus "]) + "".join(d + rng.choice(["", " ", "-", ".", "(", ") "]) for d in digits))
        texts.append("jane at example" + rng.choice([".", " dot ", "(dot)", ". "]) + rng.choice(["com", "fr now", "x"]))
    texts += [r[1] for r in DOCS if r[1]]
    fast = [pii.added(t, pii.detect(t)) for t in texts]
    monkeypatch.setattr(pii, "disguised", lambda text: True)
    assert fast == [pii.added(t, pii.detect(t)) for t in texts]
    assert sum(any(x.values()) for x in fast) > 500


def test_personal_data_rows(spark, make_docs):
    got = {}
    for row in pii.personal_data(make_docs(ODD_TEXTS + [(20, TRICKY[0])])).collect():
        got.setdefault(row["doc_id"], []).append(row)
    assert len(got[5]) == 2 and got[1][0]["n_email"] == 0
    want = ",".join(f"{k}:{a}:{b}" for k, v in plain_spans(TRICKY[0]).items() for a, b in v)
    assert got[20][0]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert got[20][0]["spans"] == want
    assert pii.redact("a b@c.d e", "email:2:7") == "a [email] e"
    assert pii.personal_data(make_docs([])).count() == 0


def test_detectors_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 100_000):
        pii.detect(text)
        pii.added(text, {k: [] for k in pii.KINDS})
        pii.Rewritten(text)
    pii.Rewritten("a" + " " * 300_000 + "at" + " " * 300_000)
    pii.Rewritten("one " * 50_000 + "at x" + " dot y" * 50_000)


# -- decontamination ------------------------------------------------------------------------------


def brute_contamination(docs, items, window=13):
    def words_of(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    tests = {}
    for item, text in items:
        w = words_of(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if size else ():
            tests.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, names = words_of(text), set(), set()
        for size in {len(t) for t in tests}:
            for i in range(len(w) - size + 1):
                found = tests.get(tuple(w[i : i + size]))
                if found:
                    names |= found
                    hit |= set(range(i, i + size))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 21, 900])
def test_contamination_equals_brute_force(spark, block_bytes):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    items = spark.read.parquet(f"{SF01}/benchmark.parquet")
    got = decontam.contamination(docs, items, block_bytes=block_bytes).collect()
    want = brute_contamination([(r[0], r[1]) for r in DOCS], rows_of("benchmark", SF01))
    assert sorted(map(tuple, got), key=repr) == want
    assert sum(r[2] > 0 for r in want) > 5


def test_short_and_odd_items(spark, make_docs):
    a = [f"w{k % 7}" for k in range(40)]
    docs = [(1, " ".join(a)), (2, "x Alpha, beta! y"), (3, "solo"), (4, None), (5, ""), (6, "alpha alpha alpha beta"),
            (6, "alpha alpha alpha beta"), (7, "ÄB äb Äb")]
    items = [(1, " ".join(a[3:20])), (2, "ALPHA beta"), (3, "solo"), (4, None), (5, "..."), (6, "alpha alpha"),
             (7, "Äb"), (8, " ".join(a[:13])), (8, " ".join(a[:13])), (9, "alpha")]
    items_df = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 doc_id", "2 n")
    got = decontam.contamination(make_docs(docs), items_df)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_contamination(docs, items)
    nothing = decontam.contamination(make_docs(ODD_TEXTS), items_df.limit(0)).collect()
    assert len(nothing) == len(ODD_TEXTS) and not any(r["contaminated"] for r in nothing)
    assert decontam.contamination(make_docs([]), items_df).count() == 0


def test_decontaminate_stage_keeps_clean_rows(make_docs, spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = make_docs([(1, "alpha beta gamma"), (2, "clean words"), (None, "more clean"), (3, "alpha beta " * 40 + "gamma")])
    out = decontam.decontaminate_stage(docs, items)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 2, 3] or sorted(
        r["doc_id"] or 0 for r in out.collect()
    ) == [0, 2]


def test_decontaminate_stage_judges_rows_not_ids(make_docs, spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    bad, clean = "alpha beta gamma", "more clean words"
    docs = make_docs([(None, bad), (None, clean), (None, clean), (7, bad), (7, clean), (8, None)])
    out = decontam.decontaminate_stage(docs, items)
    assert out.columns == docs.columns
    want = [tuple(r) for r in docs.collect() if r["text"] != bad]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 21, 40])
def test_items_without_id_count_as_in_sql(spark, make_docs, tmp_path, block_bytes):
    import duckdb

    from tracebeam.llm import oracle

    docs = [(1, "x alpha beta y"), (2, "gamma delta"), (3, "alpha beta gamma delta"), (4, "nothing here"), (5, None)]
    items = [(None, "alpha beta"), (None, "gamma delta"), (None, None), (6, "delta"), (7, "beta gamma"), (11, "y"), (12, "here")]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", make_docs(docs)), ("benchmark", items_df)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    want = sorted(con.execute(oracle.SQL["op4_decontamination"]).fetchall(), key=repr)
    got = decontam.contamination(make_docs(docs), items_df, block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert [r[2:4] for r in want] == [(3, 2), (2, 2), (4, 3), (1, 1), (0, 0)]


# -- tokens ---------------------------------------------------------------------------------------

SPACES = [
    "a  b   c", " lead", "trail ", "x\n y", "x \n y", "tab\t z", "nbsp\xa0 q", "  ", "", "a b", "don't we'll  x",
    "end<|endoftext|> more <|endoftext|>", "<|endoftext|>", "\x1c a", "a\x1c b", "é è  ñ", "１２ 3", "word " * 3000,
    "a　 b", "a  b", "日本語 テキスト", "😀 😀  😀",
]


def test_token_counts_equal_the_library(spark, make_docs, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [(k, t) for k, t in enumerate(SPACES)] + [(100 + r[0], r[1]) for r in DOCS] + [(None, None)]
    got = sorted(map(tuple, tokens.token_counts(make_docs(texts), path).collect()), key=repr)
    want = []
    for doc, text in texts:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc, len((text or "").encode()), n, n > 512))
    assert got == sorted(want, key=repr)
    # tiny batches and memories give the same
    monkeypatch.setattr(tokens, "BATCH_BYTES", 64)
    monkeypatch.setattr(tokens, "MEMO_PIECES", 50)
    counter = tokens.Counter(path)
    assert counter.count([t or "" for _, t in texts]) == [
        len(library.encode(t or "", add_special_tokens=False).ids) for _, t in texts
    ]


def test_token_counts_of_odd_texts(make_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.token_counts(make_docs(ODD_TEXTS), path).count() == len(ODD_TEXTS)
    assert tokens.token_counts(make_docs([]), path).count() == 0


# -- page text ------------------------------------------------------------------------------------


def brute_article(page):
    """Article of the synthetic pages: text of its block elements."""
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.DOTALL)
    if not m:
        return None
    blocks = re.split(r"<(?:/?(?:h1|p|article))>", m.group(1))
    plain = [" ".join(html.unescape(re.sub(r"<[^>]*>|<[^>]*\Z", "", re.sub("<br>", " ", b))).split()) for b in blocks]
    return "\n\n".join(b for b in plain if b)


def test_page_text_equals_the_article(spark):
    pages = rows_of("pages", SF01)
    got = {r["page_id"]: r for r in html_text.main_text(spark.read.parquet(f"{SF01}/pages.parquet")).collect()}
    assert len(got) == len(pages)
    for page_id, url, page in pages:
        want = brute_article(page)
        assert want is not None and got[page_id]["text"] == want and got[page_id]["n_chars"] == len(want)
        assert got[page_id]["url"] == url


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def is_subsequence(part, whole):
    it = iter(whole)
    return all(x in it for x in part)


@pytest.mark.parametrize("cells", [1 << 30, 6])
def test_common_lines_is_a_longest_common_subsequence(cells):
    import random

    rng = random.Random(5)
    for _ in range(400):
        a = [rng.randrange(5) for _ in range(rng.randrange(14))]
        b = [rng.randrange(5) for _ in range(rng.randrange(14))]
        found = sorted(html_text.common_lines(a, b, cells))
        assert len(found) == brute_lcs(a, b)
        assert is_subsequence([a[i] for i in found], b)


MARKUP = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav class=menu><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Title &amp; more</h1><p>by someone</p></header><p>First
 para<b>graph</b>.<p>Second&nbsp;one<br>line</p><aside>See also</aside><form><input name=q><p>Search</p></form>
<div class='ad banner'><div>Buy</div>now</div><ul><li>a</li><li>b &lt; c</li></ul><script>if (1 < 2) "</p>"</script>
<section id="comments"><p>Nice!</p></section></article></main><footer>&copy; x</footer></body></html>"""


def test_template_regions_go_and_blocks_stay():
    kept = [t for role, t in html_text.lines_of(MARKUP) if role == html_text.ARTICLE]
    assert kept == ["Title & more", "First paragraph.", "Second one line", "a", "b < c"]


def test_shared_lines_of_pages_without_article(spark):
    def page(*own):
        return "<div>Top line</div>" + "".join(f"<p>{x}</p>" for x in own) + "<div>Bottom line</div>"

    rows = [(1, "http://a.x/p/1", page("one", "more")), (2, "http://a.x/p/2?q", page("two")),
            (3, "http://a.x/p/2#r", page("two")), (4, "http://b.x/p/1", page("alone")), (5, None, None), (6, "", ""),
            (7, "not a url", "plain & simple"), (2, "http://a.x/p/2?q", page("two"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 text", "2 lines")
    got = sorted((r["page_id"], r["text"]) for r in html_text.main_text(df).collect())
    assert got[0] == (1, "one\n\nmore")
    assert got[1:4] == [(2, "two"), (2, "two"), (3, "two")]
    assert got[4] == (4, "Top line\n\nalone\n\nBottom line")
    assert got[5:] == [(5, ""), (6, ""), (7, "plain & simple")]
    assert html_text.main_text(df.limit(0)).count() == 0


def test_neighbours_decide_what_lies_outside_an_article(spark):
    teaser = "<div>Site line</div><div id=content><p>Story {0}</p><p>goes on {0}</p></div><article>Teaser {0}</article>"
    mirror = "<div>Top line</div><p>same text</p>"
    rows = [(k, f"http://t.x/{k}", teaser.format(k)) for k in range(3)]
    # three copies in the middle of a host: each meets the differing page, the inner one too
    rows += [(10 + k, f"http://m.x/a?{k}", mirror) for k in range(3)] + [(20, "http://m.x/b", "<div>Top line</div><p>other</p>")]
    # one id and url with different pages: what one shares is not cut from the other
    rows += [(30, "http://r.x/a", "<p>only here</p><p>both</p>"), (30, "http://r.x/a", "<p>both</p><p>second</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"], r["n_shared"]) for r in html_text.main_text(df).collect())
    assert got[:3] == [(k, f"Story {k}\n\ngoes on {k}\n\nTeaser {k}", 1) for k in range(3)]
    assert got[3:7] == [(10 + k, "same text", 1) for k in range(3)] + [(20, "other", 1)]
    assert got[7:] == [(30, "only here", 1), (30, "second", 1)]


def brute_site(rows):
    """Text of each page: lines of its list that neither nearest differing page of the host holds."""
    out = []
    order = {}
    for page_id, host, path, lines in rows:
        key = (path, page_id)
        order[host, lines] = min(order.get((host, lines), key), key)
    for page_id, host, path, lines in rows:
        line_up = sorted((k, x) for (h, x), k in order.items() if h == host and x)
        at = [x for _, x in line_up].index(lines) if lines else None
        near = set()
        if lines:
            for k in (at - 1, at + 1):
                if 0 <= k < len(line_up):
                    near |= set(line_up[k][1])
        out.append((page_id, "\n\n".join(x for x in lines if x not in near)))
    return sorted(out)


def test_differencing_equals_brute_force(spark):
    import random

    rng = random.Random(8)
    rows = []
    for k in range(300):
        host = rng.choice(["hot"] * 6 + ["b", "c"])
        # the site's lines stand in one order, so their common subsequence is unique
        site = [f"{host} line {n}" for n in range(6) if rng.random() < 0.5]
        own = [] if rng.random() < 0.3 else [f"own {k % 90} a", f"own {k % 90} b"]
        rows.append((k % 250, host, f"/{rng.randrange(60)}", tuple(site[:3] + own + site[3:])))
    df = spark.createDataFrame(
        [(i, f"https://{h}{p}?v={i}", "".join(f"<div>{x}</div>" for x in lines)) for i, h, p, lines in rows],
        "page_id long, url string, html string",
    ).repartition(7)
    got = sorted((r["page_id"], r["text"]) for r in html_text.main_text(df).collect())
    assert got == brute_site(rows)


@pytest.mark.parametrize("page", [None, "", "<", "<p", "a < b", "<!-- open", "<script>x", "<nav><p>x", "&#0;&#xD800;", "<p class='a>b"])
def test_broken_pages(page):
    html_text.lines_of(page)


assert SF
