"""Toxicity, chats, language, personal data, pages, neighbours and the pipeline, against brute force and held-out rows."""

import html
import math
import random
import re

import numpy as np
import pytest

from quadrille.llm import chat, html_text, language, neighbours, pii, toxicity

SF = "/root/testdata/sf0.01"

# Language.


def test_code_lengths_equal_a_plain_model():
    r = random.Random(1)
    samples = {k: ["".join(r.choice(a) for _ in range(60)).encode() for _ in range(8)] for k, a in (("x", "abcab "), ("y", "abdde "))}
    m = language.train(samples)

    def plain(lang, text):
        """Escape to shorter contexts, one byte at a time."""
        counts = {}
        for s in (b"\n" * 3 + t for t in samples[lang]):
            for i in range(3, len(s)):
                for k in range(4):
                    counts.setdefault(s[i - k : i], {}).setdefault(s[i], 0)
                    counts[s[i - k : i]][s[i]] += 1
        total, s = 0.0, b"\n" * 3 + text
        for i in range(3, len(s)):
            k = 3
            while k >= 0:
                c = counts.get(s[i - k : i], {})
                n, kinds = sum(c.values()), len(c)
                if s[i] in c:
                    total -= math.log2(c[s[i]] / (n + kinds))
                    break
                if n:
                    total -= math.log2(kinds / (n + kinds))
                k -= 1
            else:
                total += 8
        return total

    texts = [b"abcab abc", b"dde abd", b"zzz", b""]
    got = m.code_lengths(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx([plain("x", t), plain("y", t)], abs=1e-9)


def test_every_language_is_learnt(spark, docs):
    """A hundred labels, a bounded number of rows each, repeated ids once; counts of the executors equal those of one place."""
    r = random.Random(8)
    words = [["".join(chr(0x4E00 + 7 * k + r.randrange(7)) + r.choice("aeiou") for _ in range(4)) for _ in range(6)] for k in range(100)]
    texts = [" ".join(r.choice(words[k]) for _ in range(12)) for _ in range(5) for k in range(100)]
    langs = [f"l{k:02}" for _ in range(5) for k in range(100)]
    m = language.fit(docs(texts, langs=langs))
    assert m.languages == sorted(set(langs)) and m.predict(texts)[0] == langs
    whole = language.train({k: [language.folded(t) for t, x in zip(texts, langs) if x == k] for k in set(langs)})
    sample = [language.folded(t) for t in texts[::9]]
    assert np.array_equal(m.code_lengths(sample), whole.code_lengths(sample))
    few = language.fit(docs(texts + texts, ids=[*range(500), *range(500)], langs=langs + langs), per_language=3)
    assert few.languages == m.languages and {int(t.bits[0].size > 0) for t in few.trees} == {1}


def test_language_of_long_texts():
    m = language.train({"x": [b"abcab " * 50], "y": [b"xyzzy " * 50]})
    assert m.predict(["abcab " * 400_000, "xyzzy " * 400_000 + "a"])[0] == ["x", "y"]


def test_language_edges(spark, docs):
    df = docs([None, "", "123 !?", "der hund und die katze", "the dog and the cat"] + ["the cat and dog"] * 5 + ["die katze und hund"] * 5, langs=[None] * 5 + ["en"] * 5 + ["de"] * 5)
    rows = {r.doc_id: r for r in language.identify(df, language.fit(df)).collect()}
    assert [rows[i].lang_pred for i in range(5)] == ["und", "und", "und", "de", "en"] and rows[0].score == 0.0 and 0.5 < rows[3].score <= 1
    empty = docs([])
    assert language.identify(empty, language.fit(empty)).count() == 0
    assert {r.lang_pred for r in language.identify(docs(["abc"]), language.fit(empty)).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    from quadrille.llm import queries

    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op7_language(spark, SF).filter("held_out").join(d, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


# Toxicity.


def in_turn(machines, classes):
    """What transducers do one after another, each reading what the one before wrote."""
    total = np.zeros(len(toxicity.MASSES))
    for m in machines:
        classes, masses = m.run(classes)
        total += masses
    return classes, total


def test_composition_equals_the_transducers_in_turn():
    r = random.Random(12)
    machines, whole = toxicity.parts(), toxicity.grammar()
    assert len(machines) == 5 and whole.next.shape[0] > max(m.next.shape[0] for m in machines)
    for _ in range(3000):
        clause = [r.randrange(len(toxicity.WORDS)) for _ in range(r.randint(0, 14))]
        (want, masses), (got, total) = in_turn(machines, clause), whole.run(clause)
        assert got == want and total == pytest.approx(masses)


def plain_masses(classes):
    """The masses by their definitions, word by word, without automata."""
    out, said, left = dict.fromkeys(toxicity.MASSES, 0.0), False, 0
    plain = []  # places of plain insults and threats
    targets = [i for i, c in enumerate(classes) if c == "target"]
    for i, c in enumerate(classes):
        what = "threat" if c == "threat" else "insult" if c in toxicity.INSULT else ""
        how = "negated" if left else "reported" if said else "plain"
        if what == "insult":
            out[how] += toxicity.LEVELS[toxicity.INSULT.index(c)]
        if what and how == "plain":
            plain.append((i, what, c))
        said, left = said or c == "reported", toxicity.SCOPE if c == "negation" else max(left - 1, 0)
    for i, what, c in plain:
        if what == "threat":
            out["threat"] += any(0 < t - i <= toxicity.NEAR for t in targets)
        elif any(abs(t - i) <= toxicity.NEAR for t in targets):
            out["targeted"] += toxicity.LEVELS[toxicity.INSULT.index(c)]
    return [out[m] for m in toxicity.MASSES]


def test_grammar_equals_its_definitions():
    r = random.Random(13)
    for _ in range(4000):
        classes = [r.choice(toxicity.WORDS) for _ in range(r.randint(0, 16))]
        assert toxicity.grammar().run([toxicity.CLASSES.index(c) for c in classes])[1] == pytest.approx(plain_masses(classes)), classes


def test_grammar_scopes():
    read = toxicity.Reader({"idio": 5.0})
    masses = lambda t: dict(zip(toxicity.MASSES, read.masses(t.split()), strict=True))
    assert masses("what an idiot") == dict.fromkeys(toxicity.MASSES, 0.0) | {"plain": 3.5 if 5.0 < toxicity.BETWEEN[1] else 5.5}
    assert masses("you utter idiot")["targeted"] > 0 and masses("he is not an idiot")["plain"] == 0 < masses("he is not an idiot")["negated"]
    assert masses("someone said idiot")["reported"] > 0 and masses("i will kill you")["threat"] == 1.0 and masses("kill the lights")["threat"] == 0.0


@pytest.mark.parametrize("text", ["I will kill, you", '"kill you', "*kill* you", "(kill) you"])
def test_threats_with_marks(text):
    assert toxicity.Reader({}).features(text)[6] == math.log1p(1.0)


def test_negated_and_reported_insults_score_below_plain_ones(spark):
    from quadrille.llm import queries

    m = toxicity.fit(queries.read(spark, SF, "documents"), queries.read(spark, SF, "labels"))
    plain, negated, reported, nothing, long = m.score(["the house is green. you are an idiot and an idiot.", "the house is green. you are not an idiot nor an idiot.", "the house is green. he said you idiot and idiot.", "the house is green. you are an island and an island.", "the house is green. " * 30_000])
    assert plain > 0.5 > max(negated, reported, nothing, long) and max(negated, reported) <= nothing + 1e-9


def test_toxicity_learns_and_scores(spark, docs):
    r = random.Random(2)
    clean = [" ".join(r.choice(["the", "house", "green", "walk", "river"]) for _ in range(30)) for _ in range(120)]
    toxic = [c.replace("walk", "scumbag", 2) + " scumbags" for c in clean[:40]]
    df = docs(clean + toxic + [None, ""])
    labels = spark.createDataFrame([(i, int(i >= 120), "x") for i in range(160)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, doc string")
    rows = {x.doc_id: x.toxicity for x in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    assert all(rows[i] < 0.5 for i in range(120)) and all(rows[i] > 0.5 for i in range(120, 160)) and rows[160] == rows[161] < 0.5
    none = toxicity.fit(df, labels.filter("toxic = 0"))
    assert {x.toxicity for x in toxicity.score(df, none).collect()} == {0.0}
    assert toxicity.score(docs([]), none).count() == 0


def test_toxicity_held_out(spark):
    from quadrille.llm import queries

    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = queries.op5_toxicity(spark, "/root/testdata/sf0.1").filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97


# Personal data.

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    r = random.Random(3)
    pieces = ["a.b@c.de", "@", "1", "23", ".", "-", " ", "+", "(", ")", "x", "256", "4111111111111111", "10.0.0.1", "٣", "é", "+1 (217) 555-7713"]
    for _ in range(4000):
        t = "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("a" * 200_000 + "@" * 3000 + "1" * 200_000 + ".") == []


def test_random_field_on_unseen_lines():
    f = pii.trained()
    right = found = there = 0
    for t, spans in pii.written_lines(seed=4242, lines=150):
        got = {s[:3] for s in pii.find(t, f)}
        right, found, there = right + len(got & set(spans)), found + len(got), there + len(spans)
    assert right / found > 0.85 and right / there > 0.95


HAND_WRITTEN = [  # lines by hand, not by the generator: text, what must be found, what must not
    ("Call the front desk at (217) 555-0148 before nine.", ["(217) 555-0148"], []),
    ("Reach Ana: ana.lima [at] exemplo [dot] pt, thanks!", ["ana.lima [at] exemplo [dot] pt"], []),
    ("the build finished at 2024-05-17 in 12.5 seconds, run 4821", [], ["2024", "4821"]),
    ("api_key = 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08", ["9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"], []),
    ("Server 10.12.0.7 answered; write to ops@example.org or phone +44 20 7946 0958.", ["10.12.0.7", "ops@example.org", "+44 20 7946 0958"], []),
    ("chapters 1, 2 and 3 cover the years 1914 to 1918", [], ["1914", "1918", "1, 2"]),
    ("my card 4111.1111.1111.1111 was declined", ["4111.1111.1111.1111"], []),
]


def test_random_field_on_lines_by_hand():
    f = pii.trained()
    for text, wanted, unwanted in HAND_WRITTEN:
        found = [text[a:b] for _, a, b, _ in pii.find(text, f)]
        assert set(wanted) <= set(found) and not any(u in x for u in unwanted for x in found), (text, found)


@pytest.mark.parametrize("n", [32, 64, 128, 160, 256, 10_000])
def test_long_secrets(n):
    r, f = random.Random(n), pii.trained()
    for _ in range(20 if n < 1000 else 2):
        key = "".join(r.choice("0123456789abcdef") for _ in range(n))
        text = f"the secret = {key} was set"
        assert pii.redacted(text, pii.find(text, f)) == "the secret = [SECRET] was set"


def test_personal_data_in_hostile_texts_takes_linear_time():
    import time

    f = pii.trained()
    for piece in ("1.", "((((1", "a-1", "=a1", "1 at ", "a at b dot ", "+1 (", "1", "a1@"):
        spent = []
        for n in (3_000, 9_000):
            began = time.perf_counter()
            pii.find(piece * n, f)
            spent.append(time.perf_counter() - began)
        assert spent[1] < max(1.0, 6 * spent[0]), (piece, spent)


def brute_best(field, n, segs):
    best = (-math.inf, None)

    def go(at, label, score, taken):
        nonlocal best
        if at == n:
            best = max(best, (score, taken), key=lambda x: x[0])
            return
        go(at + 1, "O", score + field.w.get(f"after:{label}>O", 0.0), taken)
        for i, j, k, f in segs:
            if i == at:
                go(j, k, score + field.w.get(f"after:{label}>{k}", 0.0) + field.score(f), [*taken, (i, j, k)])

    go(0, "O", 0.0, [])
    return best


def test_random_field_program_and_expectations():
    r = random.Random(5)
    for _ in range(40):
        n, field = r.randint(1, 7), pii.SemiMarkov()
        segs = [(i, j, r.choice(pii.KINDS), [r.choice("abcd")]) for i in range(n) for j in range(i + 1, min(i + 4, n + 1)) if r.random() < 0.4]
        field.w = {k: r.uniform(-2, 2) for k in ["a", "b", "c", "d", *[f"after:{x}>{y}" for x in ("O", *pii.KINDS) for y in ("O", *pii.KINDS)]]}
        score, taken = brute_best(field, n, segs)
        assert field.best(n, segs) == taken
        counts, total = field.expected(n, segs)
        assert total >= score - 1e-9
        base = field.w["after:O>O"]
        field.w["after:O>O"] = base + 1e-5
        up = field.expected(n, segs)[1]
        assert counts.get("after:O>O", 0.0) == pytest.approx((up - total) / 1e-5, abs=1e-3)


def test_detect_and_redact(spark, docs):
    rows = {r.doc_id: r for r in pii.detect(docs([None, "", "mail a.b@c.de, +1 (217) 555-7713 now", "clean text"])).collect()}
    assert rows[0].spans == [] and rows[0].redacted is None and rows[1].redacted == "" and rows[3].redacted == "clean text"
    assert rows[2].redacted == "mail [EMAIL], [PHONE] now" and pii.detect(docs([])).count() == 0


# Pages.


def test_pages(spark):
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy this now please and soon.</div><header><p>Site name</p></header><article><header><h1>Head&amp;line</h1></header><p>One <b>two</b>&nbsp;three\n four<br>five.</p><ul><li>item one</li></ul><aside>Related things here</aside><script>var x="</p>";</script><div class="comments"><p>First! I say something here today.</p></div><p>Last &lt;b&gt;.</article><footer>&copy; us, all rights</footer>'
    text = html_text.main_text(page)
    assert text == "Head&line\n\nOne two three four five.\n\nitem one\n\nLast <b>."
    rows = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame([(1, "u", page, 9), (2, "u", None, 9), (3, None, "", 9), (4, "u", "<p", 9), (5, "u", "<article><p>&amp", 9)], "page_id long, url string, html string, text int")).collect()}
    assert rows == {1: text, 2: "", 3: "", 4: "", 5: "&"}


def test_pages_equal_their_articles(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))]
        assert html_text.main_text(r.html) == "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("start", ['<svg class="i"/>', '<svg class="i"><path d="M0"/>', "<button>x", "<video-player></video-player>", "<math/>", "<select><option>x", "<object data=a>", "<div><button>x</div>"])
@pytest.mark.parametrize("end", ["", "<button>y</button>", "<svg><path/></svg>", "<p>last</p>"])
def test_silent_elements_do_not_take_the_page(start, end):
    texts = [b.text for b in html_text.flat_blocks(f"{start}<p>rest of <b>it</b></p>{end}")]
    assert texts == ["rest of it"] + ["last"] * ("last" in end)


def test_silent_elements_stay_silent():
    page = "<title>a</title><script>if (a < b) '<p>c'</script><noscript><p>d</p></noscript><svg><title>e</title></svg><button><div>f</div></button><p>g</p><script><p>h"
    assert [b.text for b in html_text.flat_blocks(page)] == ["g"]


def decided(found):
    """Whether the tree keeps each block; those outside are dropped before it."""
    out = []
    for b, x in zip(found, html_text.features(found), strict=True):
        node = html_text.tree()
        while node.feature >= 0:
            node = node.low if x[node.feature] <= node.bound else node.high
        out.append(b.zone >= 0 and node.keep)
    return out


def test_tree_agrees_with_its_pages():
    right = total = 0
    for page, labels in html_text.labelled():
        got = decided(html_text.flat_blocks(page))
        right, total = right + sum(g == bool(y) for g, y in zip(got, labels, strict=True)), total + len(labels)
    assert total > 500 and right / total > 0.99


HELD_OUT = (
    """0 <div>{3}</div><ul><li><a>{1}</a></li><li><a>{2}</a></li><li><a>{1}</a></li></ul>
1 <h1>{6}</h1><p>{52}</p><p>{9}</p><p>{34} <a>{3}</a> {8}</p><p>{12}</p><p>{71}</p><p>{10}</p>
0 <div><a>{2}</a> <a>{2}</a></div>""",
    """0 <div class="cookie"><p>{33}</p></div><nav><a>{4}</a></nav>
1 <article><h1>{4}</h1><p>{20}</p><h2>{2}</h2><p>{3}</p><p>{80}</p><table><tr><td>{3}</td><td>{1}</td></tr></table></article>
0 <div id="comments"><article><p>{21}</p></article></div><div>{14}</div><footer><p>{26}</p></footer>""",
    """0 <header><p>{9}</p></header><div class="sidebar">{40}</div>
1 <main><div><p>{15}</p><p>{6} <a>{1}</a></p><p>{2}</p><p class="lead">{44}</p></div></main>
0 <form><p>{18}</p></form>""",
    """0 <p><a>{2}</a> <a>{1}</a> <a>{2}</a></p>
1 <h1>{5}</h1><p>{130}</p><p>{88}</p><h2>{3}</h2><p>{11}</p><p>{47}</p><p>{9}</p>
0 <p class="copyright">{6}</p><ul class="related"><li>{9}</li><li><a>{5}</a></li></ul>""",
    """1 <article><p>{8}</p><p>{5}</p>
0 <p class="ad">{12}</p>
1 <p>{60}</p>
0 <ul class="share"><li>{1}<li>{1}</ul>
1 <p>{9}</p></article>""",
)


def test_unseen_pages():
    for page, labels in html_text.labelled(HELD_OUT):
        assert decided(html_text.flat_blocks(page)) == [bool(y) for y in labels], page


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><p>" + "a " * 60 + "</p><p>last one here</p></article><div class='comments'><p>" + "b " * 21 + "</p></div>", ["a " * 60, "last one here"]),
        ("<div class='cookie'>" + "c " * 33 + "</div><h1>Head line</h1><p>" + "a " * 50 + "</p>", ["Head line", "a " * 50]),
        ("<h1>Head line</h1><p>" + "a " * 50 + "</p><p>" + "b " * 10 + "</p>", ["Head line", "a " * 50, "b " * 10]),
        ("<p>" + "a " * 50 + "</p><footer>" + "f " * 26 + "</footer>", ["a " * 50]),
        ("<form><main><p>" + "a " * 9 + "</p></main></form>", ["a " * 9]),
        ("<div class='has-sidebar'><article><p>" + "a " * 9 + "</p><p hidden>x y z</p></article></div>", ["a " * 9]),
    ],
)
def test_zones_are_not_overruled(page, text):
    assert html_text.main_text(page) == "\n\n".join(t.strip() for t in text)


def test_hostile_pages_take_linear_time():
    import time

    for page in ("<p title=\"x>a'" * 40_000, "<p a='" * 80_000, "<button>" * 80_000, "<svg>" * 80_000, '<a href="' * 99_000, "<select><option>" * 50_000, "<button><svg>" * 50_000, "<div>" * 99_000 + "x" + "</p>" * 99_000, "<!--" * 99_000):
        began = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - began < 5


# Neighbours.


def brute(vectors, ids, q, k):
    d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]]
    return [(int(ids[i]), float(d[i])) for i in order[:k]]


def test_factor_one_is_exact(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(neighbours, "SHARD_ROWS", 150)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 5)) + rng.integers(0, 4, (600, 1)) * 5
    v[7] = v[8]
    df = spark.createDataFrame([(i, x.tolist(), 0.5) for i, x in enumerate(v)], "vec_id long, embedding array<double>, score double")
    rows = neighbours.search(df, F.col("vec_id") % 100 == 0, factor=1.0).collect()
    for q in range(0, 600, 100):
        got = [(r.vec_id, r.score) for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)]
        want = brute(v, np.arange(600), q, 10)
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-12)


def test_neighbour_edges(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (8, [1.0, -0.5]), (8, [1.0, -0.5]), (None, [1.0, 1.0]), (100, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5), (0, 2, 8, 0.5), (0, 3, 8, 0.5), (100, 1, 7, 2.0)]
    rows = [(0, [3.0]), (0, [1.0]), (0, [1.0]), (1, [1e200]), (2, [-1.7e308]), (3, [1.7e308]), (4, [1.0 + 1e-170]), (100, [-1.7e308])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.vec_id, r.score) for r in got if r.query_id == 0] == [(0, 0.0), (4, 0.0), (0, 2.0), (1, 1e200), (2, 1.7e308), (3, 1.7e308), (100, 1.7e308)]
    assert [(r.vec_id, r.score) for r in got if r.query_id == 100][:2] == [(2, 0.0), (0, 1.7e308)] and got[-1].vec_id == 3 and got[-1].score == math.inf
    assert neighbours.search(df.filter("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_recall_of_the_default_factor(spark):
    from quadrille.llm import queries

    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    v, ids = np.array(e.embedding.tolist(), float), e.vec_id.to_numpy()
    rows = queries.op10_neighbours(spark, "/root/testdata/sf0.1").collect()
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        want = {i for i, _ in brute(v, ids, q, 10)}
        hit, total = hit + len(want & {r.vec_id for r in rows if r.query_id == ids[q]}), total + 10
    assert hit / total >= 0.9


@pytest.mark.parametrize("where", ["first", "spread", "binary"])
def test_neighbours_among_many_equal_vectors(where):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 6)) + rng.integers(0, 4, (3000, 1)) * 5
    if where == "binary":  # few distances, so that most medians are shared
        v = rng.integers(0, 2, (3000, 12)).astype(float)
    else:
        v[np.arange(1000) if where == "first" else rng.permutation(3000)[:1000]] = v[0]
    ids = np.arange(3000)
    tree, q = neighbours.Tree(v, ids), np.arange(0, 3000, 30)
    d, i = tree.search(v[q], q, 10, 1.0)
    want = [brute(v, ids, x, 10) for x in q]
    assert [[x for x, _ in w] for w in want] == i.tolist() and np.allclose(d, [[x for _, x in w] for w in want], atol=1e-12)
    d, _ = tree.search(v[q], q, 10, neighbours.FACTOR)
    near = np.array([w[-1][1] for w in want])
    assert (d <= near[:, None] + 1e-9).mean() >= 0.9


# Chats.


def brute_cost(roles):
    cost = {chat.START: 0}
    for q in roles:
        step = {}
        for s, c in cost.items():
            for t in (1, 2, 3):
                step[t] = min(step.get(t, chat.NEVER), c + chat.STEPS[s, q, t][0])
        cost = step
    return min(c + int(chat.END[s]) for s, c in cost.items())


@pytest.mark.parametrize("one", [False, True])
def test_chats(spark, one):
    """Legal, cheapest sequences, also where one conversation spans many ranges."""
    r = random.Random(4)
    rows = []
    for c in range(1 if one else 25):
        for t in range(300 if one else r.choice([1, 2, 5, 40])):
            rows.append((c, t, r.choice(["user", "assistant", "system", " User", "tool", None]), r.choice(["hi", "a<|b", None])))
    out = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas().sort_values(["conv_id", "position"])
    assert len(out) == len(rows)
    for c, g in out.groupby("conv_id"):
        codes = [chat.role_code(x[2]) for x in rows if x[0] == c]
        assert g.position.tolist() == list(range(len(g)))
        cost = sum((0 if q == chat.ROLES[x.role] else chat.NAME if q == chat.UNKNOWN else chat.RELABEL) + (chat.MERGE if x.action == "merge" else 0) + (chat.INSERT if x.inserted else 0) for q, x in zip(codes, g.itertuples()))
        text = "".join(g.rendered)
        tags = re.findall(r"<\|(system|user|assistant)\|>", text)
        made = sum((x.action != "merge") + bool(x.inserted) for x in g.itertuples())
        body = tags[1:] if tags[0] == "system" else tags
        assert body == ["user", "assistant"] * (len(body) // 2) and text.count("<|end|>") == len(tags)
        assert cost + chat.INSERT * (len(tags) - made) == brute_cost(codes)


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, position string"
    rows = [(None, 1, "user", "q", "x"), (None, 2, "assistant", "a", "x"), (1, None, "human", None, "x"), (1, None, "human", None, "x"), (2, 1, "system", "s", "x")]
    out = chat.format_turns(spark.createDataFrame(rows, schema)).toPandas()
    assert "".join(out[out.conv_id.isna()].sort_values("position").rendered) == "<|user|>\nq\n<|end|>\n<|assistant|>\na\n<|end|>\n"
    assert "".join(out[out.conv_id == 2].rendered).count("<|end|>") == 3 and len(out) == 5
    assert chat.format_turns(spark.createDataFrame([], schema)).count() == 0


# Pipeline.


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as p

    r = random.Random(9)
    prose = lambda: " ".join(r.choice("the river runs over green hills and under old bridges near town".split()) + str(r.randrange(99)) for _ in range(80))
    base = prose()
    texts = [prose() for _ in range(12)] + [base, base, base + " extra", None, "12 34", "write to me a.b@c.de " + prose()]
    df = docs(texts, langs=["en"] * len(texts))
    out = p.identify_language(spark, df, SF)
    assert out.columns == df.columns and sorted(x.doc_id for x in out.collect()) == [i for i in range(18) if i not in (15, 16)]
    out = p.drop_near_duplicates(spark, df, SF)
    assert out.columns == df.columns and sorted(x.doc_id for x in out.collect()) == [i for i in range(18) if i not in (13, 14)]
    out = {x.doc_id: x for x in p.redact(spark, df, SF).collect()}
    assert "[EMAIL]" in out[17].text and out[17].n_chars == len(out[17].text) and out[15].text is None and out[0].text == texts[0]
    assert len(p.STAGES) == 5 and p.pack(spark, df, SF).select("doc_id").distinct().count() == 18


def test_pipeline_runs(spark):
    import corpus_pipeline as p

    rows = p.run(spark, "/root/testdata/sf0.001").collect()
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert 0.7 * n < len({r.doc_id for r in rows}) <= n
