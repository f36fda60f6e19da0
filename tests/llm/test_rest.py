"""Operators 5, 6, 7, 8 and 10, and the pipeline."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gridtally.llm import secrets, toxicity
from gridtally.llm.html_text import extract_pages, main_text
from gridtally.llm.mixing import draw, mix_documents
from gridtally.llm.quality import quality
from gridtally.llm.quality import oracle as quality_oracle
from gridtally.llm.texts import vocabulary


def brute_spans(text):
    text = text or ""
    out = []
    for order, (kind, pattern) in enumerate((("assign", r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"))):
        flags = re.IGNORECASE | re.ASCII if kind == "assign" else 0
        for m in re.finditer(pattern, text, flags):
            if {"assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[kind]():
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_secrets(spark):
    rng = random.Random(1)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", " = ", ": ", "=", '"', "'", "abcdef", "x", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "deadbeef", " ", "\n", "é", "𝄞", "==", "secret=token :abcdef", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 30_000 + "token=abcdefg"), (None, "secret: hunter22"), (5, "token=zzzzzz")]
    frame = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kinds string")
    found = secrets.secret_digest(secrets.find_secrets(frame)).collect()
    assert len(found) == len(rows)
    base = lambda spans: [s for s in spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")]
    assert sorted((str(r.doc_id), base(r.spans)) for r in found) == sorted((str(i), brute_spans(t)) for i, t in rows)
    assert any("pem:" in r.spans for r in found) and any("github:" in r.spans for r in found)
    assert secrets.find_secrets(frame.limit(0)).count() == 0


def test_secrets_against_sql(spark, duck, sf):
    got = sorted(tuple(r) for r in secrets.secret_digest(secrets.find_secrets(spark.read.parquet(f"{sf}/documents.parquet"))).collect())
    assert got == sorted(duck.sql(secrets.oracle()).fetchall())


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") == []
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [[frozenset({"aki", "kia"})]]
    assert [len(run) for run in secrets.trigram_query(secrets.RULES[0].pattern)] == [6]


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 300), f"s{min(i % 7, 4)}") for i in range(700)] + [(800 + i, "a b c", "same") for i in range(300)]
    rows += [(2000, None, "s0"), (2001, "", None), (2002, "x y", None), (None, "p q r", "s1"), (2002, "x y", None)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, copies int")
    got = mix_documents(frame).collect()
    assert len(got) == len(rows)
    assert sorted(tuple(map(str, r)) for r in got) == sorted(tuple(map(str, r)) for r in mix_documents(frame.repartition(7)).collect())
    size, source = {}, {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    target, open_, left = {}, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(size.values())
    while open_:
        full = [s for s in open_ if left * open_[s] / sum(open_.values()) >= 2 * size[s]]
        if not full:
            target |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
            del open_[s]
    by_id = {i: s for i, t, s in rows}
    taken = {}
    for r in got:
        s = by_id[r.doc_id]
        assert r.taken <= 2 * r.size and abs(r.target - target[s]) < 1e-3 and r.source_size == size[s]
        taken[s] = taken.get(s, 0) + r.taken
    least = min(len((t or "").split()) for _, t, _ in rows if (t or "").split())
    assert all(abs(taken[s] - target[s]) <= max(1, least) for s in target)
    drawn = draw(frame)
    assert drawn.columns == frame.columns
    assert drawn.filter("doc_id < 700").count() == sum(r.copies for r in got if r.doc_id is not None and r.doc_id < 700 and r.size)
    assert mix_documents(frame.limit(0)).count() == 0


def test_quality_against_sql(spark, duck, sf):
    frame = quality(spark.read.parquet(f"{sf}/documents.parquet"), vocabulary("piece_bpe_32k.model"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(tuple(r) for r in frame.select(columns).collect()) == sorted(duck.sql(quality_oracle()).fetchall())
    assert frame.filter("base_failed and kept").count() == 0


def test_quality_cases(spark):
    good = "The committee met on Tuesday to discuss the annual budget and agreed on several changes. " * 1
    rng = random.Random(3)
    words = "river stone winter garden machine paper silver morning window letter table ocean music summer bridge forest city mountain story window cloud".split()
    good = " ".join(rng.choice(words) for _ in range(120))
    rows = [(1, good), (2, None), (3, ""), (4, "la " * 100), (5, "\x01\x02é𓀀𓀁" * 100), (6, "мир " + " ".join(rng.choice(["дом", "река", "город", "лес", "окно", "снег", "вода"]) + str(k) for k in range(80)))]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("piece_bpe_32k.model")).collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept and not got[4].kept and not got[5].kept and got[6].kept
    assert got[6].script == "cyrillic" and got[1].script == "latin" and got[3].script == "none"


def fertility_bands(rows):
    """For each row the measures that lie outside its language's band, recomputed row by row."""
    import math
    import statistics

    from gridtally.llm.quality import BEYOND, FEW_DOCUMENTS, REACH

    def quartiles(values, digits=3, shares=(0.25, 0.5, 0.75)):
        v, out = sorted(round(x, digits) for x in values), []
        for share in shares:
            k = share * (len(v) - 1)
            out.append(v[math.floor(k)] + (k - math.floor(k)) * (v[math.ceil(k)] - v[math.floor(k)]))
        return out

    logs = {id(r): math.log2(max(r["n_tokens"], 2)) for r in rows}
    outside = {id(r): set() for r in rows}
    for group in {r["group"] for r in rows}:
        own = [r for r in rows if r["group"] == group]
        normal = [r for r in own if not r["base_failed"]]
        if not normal:
            continue
        x, y = [logs[id(r)] for r in normal], [r["evenness"] for r in normal]
        slope, height = (0.0, statistics.fmean(y)) if len(set(x)) < 2 else statistics.linear_regression(x, y)
        low, high = quartiles(x, 2, (0.01, 0.99))
        for r in own:
            r["bent"] = r["evenness"] - height - slope * logs[id(r)] if low - BEYOND <= logs[id(r)] <= high + BEYOND else None
        for c, (below, above, least) in REACH.items():
            a, m, b = quartiles([r[c] for r in normal if r[c] is not None])
            far = 1 + FEW_DOCUMENTS / len(normal)
            for r in own:
                if r[c] is not None and not m - max(least, below * far * (m - a)) <= r[c] <= m + max(least, above * far * (b - m)):
                    outside[id(r)].add(c)
    return [outside[id(r)] for r in rows]


def test_quality_bands(spark):
    """Each measure rejects by itself, and verdicts equal a recomputation."""
    from gridtally.llm.quality import BANDS

    rng = random.Random(5)
    parts = [a + b for a in "bcdfglmnprst" for b in ("a", "en", "or", "it", "u")]
    words = [a + b for a in parts for b in parts]
    good = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, good(rng.randint(60, 400)), "en" if i % 2 else None, "x") for i in range(300)]
    rows += [(1000, " ".join("".join(rng.choice("qxzjkvw") for _ in range(6)) for _ in range(200)), "en", "x")]
    rows += [(1001, " ".join(w + ("𓀀" if k % 4 == 0 else "") for k, w in enumerate(good(200).split())), "en", "x")]
    rows += [(1002, " ".join(x for w in good(200).split() for x in ("the", w)), "en", "x")]
    rows += [(1003, None, None, "x"), (1004, "", "en", "x"), (1005, good(12_000), "en", "x"), (7, rows[7][1], "en", "x"), (1006, "la " * 300, "en", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, group string")
    got = [r.asDict() for r in quality(frame, vocabulary("piece_bpe_32k.model")).collect()]
    assert len(got) == len(rows)
    lang = {i: g for i, _, g, _ in rows}
    for r in got:
        r["group"] = lang[r["doc_id"]] or r["script"]
    outside = fertility_bands(got)
    for r, out in zip(got, outside):
        band = BANDS[r["script"]]
        fixed = band.chars_low <= r["chars_per_token"] <= band.chars_high and r["byte_share"] <= band.bytes_high and r["evenness"] >= band.even_low
        assert r["kept"] == (not r["base_failed"] and fixed and not out), (r, out)
    by_id = {r["doc_id"]: (r["kept"], out) for r, out in zip(got, outside)}
    assert sum(by_id[i][0] for i in range(300)) >= 297 and by_id[1005][0]
    assert "chars_per_token" in by_id[1000][1] and "byte_share" in by_id[1001][1] and "bent" in by_id[1002][1]
    assert not any(by_id[i][0] for i in (1000, 1001, 1002, 1003, 1004, 1006))
    assert {frozenset(out) for out in outside} >= {frozenset({"bent"})}
    assert quality(frame.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>One &amp; two<br>three</p><p> four\n five", "One & two three\n\nfour five"),
        ('<nav><a>x</a></nav><article><h1>T</h1><p>A.<p>B.</article><footer>f</footer><script>p("</p>")</script>', "T\n\nA.\n\nB."),
        ('<body class="has-sidebar"><main><header><h1>T</h1><p>by x</p></header><p>Long text of the page</p><div class="comments"><p>nice</p></div><form>x</form></main><aside>s</aside>', "T\n\nLong text of the page"),
        ('<div id=menu>m</div><div><p>Long text that is the content of the page.</p><p>Short.</p><p>And more long text for the content.</p></div><div class="cookie-notice">c</div>', "Long text that is the content of the page.\n\nShort.\n\nAnd more long text for the content."),
        ("", ""),
        ("<nav>only</nav>", ""),
        ("</p></div>a<b", "a"),
        ('<article><p>A long text of the article, with <span class="ad">buy</span> words.</p><div class="tags-intro"><p>Words of the article that stand in a box of their own, as long as any.</p></div></article>', "A long text of the article, with words.\n\nWords of the article that stand in a box of their own, as long as any."),
        ('<article><p>' + "The article has a long text. " * 5 + '</p></article><div hidden>h</div><div class="reader-comments">' + "<p>I like it a lot.</p>" * 9 + "</div>", ("The article has a long text. " * 5).strip()),
        ("<i>" * 2100 + '<span class="ad">buy</span>kept', "kept"),
        ('<style>p{}</style><div><button>b</button><p>x</p></div>', "x"),
        ('<div><p>The terms of the lease are long.</p><p class="notice-period">Thirty days of notice are due.</p><p class="related-work">Others have asked this too.</p></div>', "The terms of the lease are long.\n\nThirty days of notice are due.\n\nOthers have asked this too."),
        ('<div><p>Words that stay in the page for long.</p><div class="ad-slot-2">buy</div><div class="comment-list">hm</div><p id="cookie-notice">ok?</p></div>', "Words that stay in the page for long."),
        ("<p>one</p><!-- <p>two</p> --><p>three</p><!--> <p>four</p><![if x]><p>five</p><![CDATA[ six ]]><p>seven</p><!-- eight", "one\n\nthree\n\nfour\n\nfive\n\nseven"),
        ("<p>one <b and two<c three", "one"),
    ],
)
def test_html(html, text):
    assert main_text(html) == text


def article_page(rng, rename=lambda tag: tag):
    """A page with the parts that none of the article's text belongs to, and that text."""
    words = lambda n: " ".join(rng.choice(["stone", "river", "garden", "of", "the", "a", "morning"]) for _ in range(n))
    parts = [words(6), *(words(rng.randint(2, 60)) for _ in range(rng.randint(4, 12)))]
    body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}</p>" for p in parts[1:])
    links = lambda n: "".join(f"<li><a href='/{k}'>{words(2)}</a></li>" for k in range(n))
    tag, nav, foot = rename("article"), rename("nav"), rename("footer")
    return f"<html><body><{nav}><ul>{links(8)}</ul></{nav}><{tag}>{body}</{tag}><div><ul>{links(300)}</ul></div><{foot}>{words(4)}</{foot}></body></html>", "\n\n".join(parts)


def test_html_ratios_find_the_region():
    """With no telling name left, the ratios find the article; without the threshold they don't."""
    from gridtally.llm.html_text import Page, content_lines

    rng = random.Random(21)
    pages = [article_page(rng, lambda tag: "div") for _ in range(100)]
    assert sum(main_text(h) == t for h, t in pages) >= 95

    def without(html):
        page = Page()
        page.feed(html)
        page.close()
        page.flush()
        return "\n\n".join(content_lines(page.lines, page.parents, spread=0.0))

    assert sum(without(h) == t for h, t in pages) <= 20
    named = [article_page(rng) for _ in range(100)]
    assert sum(main_text(h) == main_text(re.sub(r"(</?)(article|main)\b", r"\1div", h)) for h, _ in named) >= 95
    assert sum(main_text(h) == t for h, t in named) >= 95


def test_html_smoothing_against_brute_force():
    import math

    import numpy as np

    from gridtally.llm.html_text import REACH, smoothed

    rng = random.Random(22)
    for n in (1, 2, 7, 40):
        ratio = [rng.random() * 100 for _ in range(n)]
        weight = {k: math.exp(-0.5 * (k / max(1, REACH / 2)) ** 2) for k in range(-REACH, REACH + 1)}
        brute = [sum(w * ratio[min(max(i + k, 0), n - 1)] for k, w in weight.items()) / sum(weight.values()) for i in range(n)]
        assert np.allclose(smoothed(np.array(ratio)), brute)


def test_html_time_is_linear():
    import time

    for html in ("<div><b></i></p>", "<i><div></i>", "<p><b>"):
        took = []
        for n in (4000, 32_000):
            start = time.process_time()
            main_text(html * n + "x")
            took.append(time.process_time() - start)
        assert took[1] < 40 * took[0] + 0.5
    for unit in ("<a ", "<!--", "<![CDATA[", "</", "<?", "<a b='", "<"):  # what no end ever closes
        for end in ("", "<p>x", ">"):
            start = time.process_time()
            main_text(unit * (1_000_000 // len(unit)) + end)
            assert time.process_time() - start < 5


def test_pages(spark):
    rows = [(1, "u", "<p>x</p>", "t"), (2, None, None, "t"), (3, "u", "<div>" * 5000 + "deep", "t")]
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1] == ("u", "x", 1) and got[2] == (None, "", 0) and got[3][1] == "deep"
    frame = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, text string")
    assert extract_pages(frame).filter("page_id = 1").count() == 2 and extract_pages(frame.limit(0)).count() == 0


def brute_marginals(model, score):
    """Forward and backward over every token."""
    import numpy as np

    base, n = np.exp(model.chain), len(score)
    emit = np.stack((np.ones(n), np.exp(score)), axis=1)
    f, b = np.zeros((n, 2)), np.ones((n, 2))
    f[0] = 0.5 * emit[0]
    for k in range(1, n):
        f[k] = f[k - 1] @ base * emit[k]
        f[k] /= f[k].sum()
    for k in range(n - 2, -1, -1):
        b[k] = base @ (emit[k + 1] * b[k + 1])
        b[k] /= b[k].sum()
    p = f * b
    return p[:, 1] / p.sum(axis=1)


def toxic_corpus():
    rng = random.Random(4)
    words = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilething", "vilehead", "grubby"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    import numpy as np

    rows, labels = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in [*rows, (5000, None), (5001, ""), (5002, "vilething " * 20_000), (None, "hello")]], "doc_id long, text string, score string")
    frame = spark.createDataFrame([*labels, (7000, None), (7001, 3)], "doc_id long, toxic int")
    model = toxicity.trained(docs, frame)
    out = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    held = [i for i, _ in labels if out[i].held_out]
    assert 200 < len(held) < 400
    assert sum(out[i].predicted == y for i, y in labels if out[i].held_out) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values()) and out[5002].predicted == 1 and out[5000].score == out[5001].score
    i = next(i for i, y in labels if y)
    text = dict(rows)[i]
    assert {text[a:b] for a, b in out[i].toxic_spans} & {"vilething", "vilehead", "grubby"}
    odd = ["İÉ𝄞ß vilething, Ω", "", "grubby"]
    found = toxicity.Tokens(odd)
    a, b = found.spans(np.arange(len(found.starts)))
    assert [odd[t][i:j] for t, i, j in zip(found.text_of, a, b)] == ["İÉ𝄞ß", "vilething", "Ω", "grubby"]
    tokens = toxicity.Tokens([t for _, t in rows[:40]])
    score, _ = model.emissions(tokens.features)
    at, p = model.marginals(tokens)
    cut = np.concatenate(([0], np.cumsum(tokens.counts)))
    full = np.concatenate([brute_marginals(model, score[a:b]) for a, b in zip(cut, cut[1:])])
    assert np.allclose(full[at], p, atol=1e-6)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in out.values())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.trained(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_documents(docs, model).first().predicted == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.filter(F.col("n_tokens") != F.size("token_ids")).count() == 0


def test_bounds_of_the_toxicity_fit_are_named():
    from gridtally.llm import toxicity

    for name in ("SAMPLE_ROWS", "SAMPLE_CHARS", "SAMPLE_PIECES"):
        assert getattr(toxicity, name) > 0 and name in toxicity.__doc__
