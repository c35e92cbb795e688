"""Operators that SQL can't express, over whole tables, against plain Python that shares nothing with them but the stated rules."""

import itertools
import re
from html.parser import HTMLParser

import numpy as np

from dialoom.llm import classifier, html_text, near_dedup, queries, toxicity

DIR = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{DIR}/{name}.parquet")


# --- near duplicates


def pairs_of(text):
    """The word pairs of a text; of a text of one word, the word."""
    ws = (text or "").lower().split()
    return set(zip(ws, ws[1:])) if len(ws) > 1 else set(ws)


def least_of_groups(texts, threshold=0.5):
    """{id: least id of its group} by all pairs, for the ids that aren't the least."""
    sets = {i: s for i, t in texts.items() if (s := pairs_of(t))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets if find(i) != i}


def test_near_duplicates_against_all_pairs(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    got = {r.doc_id: r.duplicate_of for r in queries.op9_minhash_near_dedup(spark, DIR).collect()}
    assert got == least_of_groups(texts) and len(got) > 10


def test_near_duplicates_with_repeats_ties_and_nulls(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A  B c d"), (3, None), (4, ""), (5, "   "), (None, "a b c d"), (6, "word"), (7, "word"), (8, "x y z")]
    got = near_dedup.near_duplicates(spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, sig string, a int"))
    assert {r.doc_id: r.duplicate_of for r in got.collect()} == {2: 1, 7: 6}


# --- toxicity


def steps(classes):
    """Weight of a clause's classes, one rule after the other over the whole clause."""
    t = toxicity
    out = list(classes)
    left = 0
    for i, c in enumerate(classes):  # negation
        if c == t.NEGATE:
            left = 3
        else:
            if left and c in (t.INSULT, t.THREAT):
                out[i] = t.INSULT_N if c == t.INSULT else t.THREAT_N
            left = max(0, left - 1)
    said = False
    for i, c in enumerate(out):  # reported speech
        said |= c == t.REPORT
        if said and c in (t.INSULT, t.THREAT):
            out[i] = t.INSULT_R if c == t.INSULT else t.THREAT_R
    aimed = {t.THREAT: t.AIMED, t.THREAT_N: t.AIMED_N, t.THREAT_R: t.AIMED_R}
    last = None
    for i, c in enumerate(list(out)):  # a threat and a target within four words
        if c in aimed:
            last = i, aimed[c]
        elif c == t.TARGET and last and i - last[0] <= 4:
            out[i], last = last[1], None
    weights = {t.INSULT: 1.0, t.INSULT_N: 0.15, t.INSULT_R: 0.4, t.AIMED: 2.0, t.AIMED_N: 0.1, t.AIMED_R: 0.5}
    score = [weights.get(c, 0.0) for c in out]
    if t.INSULT in out and (t.TARGET in out or t.AIMED in out):
        score.append(0.75)
    return out, score


def test_composed_grammar_is_the_cascade():
    """The machine's table gives each clause of up to five words the weight of the rules applied one by one."""
    for n in range(6):
        for classes in itertools.product(range(6), repeat=n):
            state, got = 0, 0.0
            for c in classes:
                got += toxicity.WEIGHT[state][c]
                state = toxicity.NEXT[state][c]
            assert abs(got - sum(steps(classes)[1])) < 1e-9, classes


def plain_score(text, insults, stems, noise):
    """Score of a text, clause by clause, word by word."""
    low = text.lower()
    firm = loose = 0.0
    matched = 0
    for clause in re.split(r"[.,;:!?\n|()\"]", low):
        ws = [w.replace("’", "'") for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", clause)]
        both = []
        for with_stems in (True, False):
            kinds, strength = [], 1.0
            for w in ws:
                hit = w in insults or with_stems and any(w[:n] in stems for n in toxicity.STEM_LENGTHS)
                kinds.append(toxicity.INSULT if hit else next((c for c, x in toxicity.WORDS.items() if w in x.split()), toxicity.OTHER))
            both.append((sum(steps(kinds)[1]) * strength, any(k in (toxicity.INSULT, toxicity.THREAT) for k in kinds)))
        (score, hit), (bare, _) = both
        if hit and score > 0:
            matched += 1
            if noise and bare == 0:
                loose += score
            else:
                firm += score
    return round(firm + max(0.0, loose - toxicity.ALLOWANCE * noise * len(low)), 4), matched


def plain_toxic(spark, docs, marks):
    """(doc_id, score, clauses) of the toxic rows of docs, a list of rows with doc_id, text and lang."""
    df = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in docs], "doc_id long, text string, lang string")
    words = toxicity.lexicon(toxicity.learn(df, marks))
    got = [(r.doc_id, *plain_score(r.text, *words.get(r.lang or "", words[""]))) for r in docs if r.text]
    return [x for x in got if x[1] >= toxicity.THRESHOLD]


def test_toxic_documents_against_plain_scoring(spark):
    got = {(r.doc_id, round(r.score, 3), r.clauses) for r in queries.op5_toxicity(spark, DIR).collect()}
    want = plain_toxic(spark, table(spark, "documents").collect(), table(spark, "labels"))
    assert got == {(i, round(s, 3), n) for i, s, n in want} and len(got) > 3


def test_what_is_learnt_from_odd_labels(spark):
    docs = table(spark, "documents")
    assert toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int")) == {}
    few = toxicity.learn(docs, spark.createDataFrame([(1, 0), (2, None), (None, 1), (3, 7)], "doc_id long, toxic int"))
    assert all(not terms and not stems for terms, stems, _ in few.values())


# --- quality classifier


def plain_statistics(text):
    """The statistics of a text, counted character by character."""
    t = text or ""
    ws = re.split("[ \n\t\r]", t)
    n, m = len(t) + 50, len(ws) + 10
    capital = sum(bool(re.fullmatch("[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]", c)) for c in t)
    again = sum(a == b and a != "" for a, b in zip(ws, ws[1:]))
    solid = sum(c not in " \n\t\r" for c in t)
    return [sum(c in "#$%&*+/<=>@[\\]^_`{|}~" for c in t) * 1000 // n, capital * 1000 // n, again * 1000 // m, sum(c in "0123456789" for c in t) * 1000 // n, (solid + 50) * 100 // m, len(t), len(ws), t.count("\n") + 1]


def test_quality_scores_against_rules_by_hand(spark):
    """All documents: statistics, the rules' conditions and the logistic sum in plain Python, with the rules fitted on the same labels."""
    docs = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    marks = {r.doc_id: r.quality for r in table(spark, "labels").collect() if r.doc_id in docs and r.quality in (0, 1)}
    stats = {i: plain_statistics(t) for i, t in docs.items()}
    ids = sorted(marks)
    intercept, rules = classifier.fit(np.array([stats[i] for i in ids]), np.array([float(marks[i]) for i in ids]))
    assert rules
    want = {}
    for i, x in stats.items():
        z = intercept + sum(w for rule, w in rules if all(x[f] <= at if op == "<=" else x[f] > at for f, op, at in rule))
        p = round(1 / (1 + np.exp(-z)), 6)
        if p >= classifier.THRESHOLD:
            want[i] = p
    got = {r.doc_id: r.score for r in queries.op10_quality_classifier(spark, DIR).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in got)


def test_lasso_meets_its_conditions():
    """At the weights found, the gradient is the penalty's: equal to it where a weight isn't zero, within it where it is."""
    rng = np.random.default_rng(7)
    r = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * r[:, 0] - 2 * r[:, 1])))).astype(float)
    b, w = classifier.lasso(r, y, 0.02, steps=4000)
    g = r.T @ (1 / (1 + np.exp(-(b + r @ w))) - y) / 400
    assert (abs(g[w == 0]) <= 0.02 + 1e-6).all() and np.allclose(g[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-5) and (w == 0).any()


def test_repeated_labelled_rows_count_once(spark):
    docs, marks = table(spark, "documents"), table(spark, "labels")
    once = sorted(map(tuple, classifier.quality_scores(docs, marks).collect()))
    assert sorted(set(map(tuple, classifier.quality_scores(docs.unionAll(docs), marks.unionAll(marks)).collect()))) == once


# --- web pages


class _Tree(HTMLParser):
    """A page as nested lists [tag, attributes, bad, children], by the library's parser."""

    def __init__(self, hints, drop):
        super().__init__(convert_charrefs=True)
        self.root = ["html", {}, False, []]
        self.open, self.hints, self.drop, self.raw = [self.root], hints, drop, None

    def handle_starttag(self, tag, attrs):
        if self.raw or tag == "html" and len(self.open) == 1:
            return
        if tag in ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe"):
            self.raw = tag
            return
        block = html_text._BLOCK
        closes = {"p": block - {"html", "body"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
        while len(self.open) > 1 and tag in closes.get(self.open[-1][0], ()):
            self.open.pop()
        if self.open[-1][0] == "head" and len(self.open) > 1 and tag not in ("base", "link", "meta"):
            self.open.pop()
        if tag in ("br", "hr"):
            self.open[-1][3].append("\n")
            return
        if tag in ("area", "base", "col", "embed", "img", "input", "link", "meta", "param", "source", "track", "wbr"):
            return
        marked = any(k in ("class", "id") and re.search(r"\b(ad|ads|advert|banner|comment|cookie|footer|menu|nav|promo|related|share|sidebar|social|sponsor)\b", v or "", re.I) for k, v in attrs)
        bad = tag not in ("html", "body", "main") and (self.open[-1][2] or tag in self.drop or self.hints and marked and tag not in ("html", "body", "main", "article", "form"))
        node = [tag, dict(attrs), bad, []]
        self.open[-1][3].append(node)
        self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        if tag in ("br", "hr") and not self.raw:
            self.open[-1][3].append("\n")

    def handle_endtag(self, tag):
        if self.raw:
            self.raw = None if tag == self.raw else self.raw
            return
        if any(n[0] == tag for n in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.raw and data:
            self.open[-1][3].append(data)


def _flat(nodes):
    out = []

    def walk(x):
        if isinstance(x, str):
            out.append(x if x == "\n" else re.sub(r"\s+", " ", x))
        elif not x[2]:
            edge = "\n" if x[0] in html_text._BLOCK else ""
            out.append(edge)
            for c in x[3]:
                walk(c)
            out.append(edge)

    for n in nodes:
        walk(n)
    return "\n".join(s for line in "".join(out).split("\n") if (s := " ".join(line.split())))


def plain_extract(html):
    """Text and score by the definition, recursively."""
    best = "", 0.0
    drop = html_text._DROP
    for hints, gone in ((True, drop), (False, drop), (False, drop - {"form"}), (False, {"head"})):
        t = _Tree(hints, gone)
        t.feed(html or "")
        t.close()
        got = _plain_read(t.root)
        if not best[0] or got[1] > 0 and len(got[0]) >= max(250, 4 * len(best[0])):
            best = got
        if best[1] > 0 and len(best[0]) >= 250:
            break
    return best


def _plain_read(root):
    parents, order = {}, []

    def walk(n):
        order.append(n)
        for c in n[3]:
            if not isinstance(c, str):
                parents[id(c)] = n
                walk(c)

    walk(root)

    def strings(n):
        return [s for c in n[3] for s in ([c] if isinstance(c, str) else strings(c))]

    def chars(n):
        return sum(len(s.strip()) for s in strings(n))

    def linked(n):
        return chars(n) if n[0] == "a" else sum(linked(c) for c in n[3] if not isinstance(c, str))

    density = lambda n: linked(n) / chars(n) if chars(n) else 0.0
    score, first = {}, []
    for n in order:
        inner = any(not isinstance(c, str) and c[0] in html_text._BLOCK for c in n[3])
        if n[2] or not (n[0] in ("p", "td", "pre", "blockquote") or n[0] == "div" and chars(n) and not inner) or chars(n) < 25:
            continue
        points = 1 + sum(s.count(",") + s.count("，") + s.count("、") for s in strings(n)) + min(chars(n) // 100, 3)
        up = parents.get(id(n))
        for share in (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12):
            if up is None:
                break
            if id(up) not in score:
                first.append(up)
            score[id(up)] = score.get(id(up), 0.0) + points * share
            up = parents.get(id(up))
    if not first:
        return _flat([root]), 0.0
    value = lambda n: score.get(id(n), 0.0) * (1 - density(n))
    best = max(first, key=value)
    if id(best) not in parents:
        return _flat([best]), round(value(best), 4)
    near = max(10.0, 0.2 * value(best))
    keep = []
    for s in parents[id(best)][3]:
        if isinstance(s, str):
            continue
        plain = s[0] == "p" and (chars(s) > 80 and density(s) < 0.25 or 0 < chars(s) <= 80 and linked(s) == 0 and any("." in x for x in strings(s)))
        if s is best or not s[2] and (value(s) >= near or plain):
            keep.append(s)
    return _flat(keep), round(value(best), 4)


def test_pages_against_a_recursive_reading(spark):
    want = {r.page_id: plain_extract(r.html) for r in table(spark, "pages").collect()}
    got = {r.page_id: (r.text, r.score) for r in queries.op8_html_extraction(spark, DIR).collect()}
    assert got == want


def test_equal_containers_and_stray_tags():
    body = "This is a paragraph, with commas, and enough text to count as content. " * 3
    two = f"<div id=a><p>{body}</p></div><div id=b><p>{body}</p></div>"
    assert html_text.extract(two) == plain_extract(two)
    for page in ("</p></div></b>" * 50 + f"<p>{body}</p>", f"<div><p>{body}<p>{body}</div></div></p>", f"<table><tr><td>{body}<td>{body}</table>"):
        assert html_text.extract(page) == plain_extract(page)
    # As many stray tags as open ones: each is looked up, not sought.
    assert html_text.extract("<div>" * 20_000 + "</b>" * 20_000 + "deep")[0] == "deep"


def test_line_bitmaps_with_null_and_large_ids(spark):
    """Ids beyond 2^53 stay exact beside null ones; the null id sorts first."""
    from dialoom.llm import line_dedup

    big = (1 << 62) + 1
    rows = [(None, "shared\nnone"), (big, "shared\nbig"), (big + 1, "shared\nbig\nmore"), (-5, "shared")]
    got = {r.doc_id: (r.n_lines, r.n_kept, r.keep_runs) for r in line_dedup.line_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: (2, 2, "2"), -5: (1, 0, "0,1"), big: (2, 1, "0,1,1"), big + 1: (3, 1, "0,2,1")}
