import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.llm import ann, bpe, classifier, common, html_text, line_dedup, lm, near_dedup, packing, quality_rules, queries, toxicity

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, pos string, c0 string, __kept string, __id string, __gone string, sig string, score double, lines string"
REST = ("x", "y", "z", "k", "i", "g", "s", 1.0, "l")
LONG = "one two three, four. " * 20_000
ROWS = [(1, "same line\nown line", "en", "a", 1), (2, "same line\n\nother", "en", "a", None), (2, "same line\n\nother", "en", "a", None), (3, "", "en", None, 0), (4, None, None, None, None), (None, "same line", "fr", "b", 3), (5, LONG, "en", "a", 9), (6, LONG + "end", "en", "a", 9), (7, "퟿ é ünïcode", "xx", "", 2)]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([r + REST for r in rows], SCHEMA)


def labels(spark, rows=((1, 1, 0), (2, None, None), (None, 1, 1), (2, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "line bitmaps": lambda s, d: line_dedup.line_bitmaps(d),
    "line dedup": lambda s, d: line_dedup.dedup_lines(d),
    "quality": lambda s, d: quality_rules.quality_kept(d),
    "quality report": lambda s, d: quality_rules.quality_report(d),
    "packing": lambda s, d: packing.pack(packing.document_examples(d)),
    "toxic": lambda s, d: toxicity.toxic_documents(d, labels(s)),
    "drop toxic": lambda s, d: toxicity.drop_toxic(d, labels(s)),
    "bpe": lambda s, d: bpe.encode(d),
    "lm": lambda s, d: lm.corpus_perplexities(d),
    "near": lambda s, d: near_dedup.near_duplicates(d),
    "drop near": lambda s, d: near_dedup.drop_near_duplicates(d),
    "classifier": lambda s, d: classifier.quality_scores(d, labels(s)),
    "html": lambda s, d: html_text.extract_pages(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), "score")),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    df = docs(spark)
    got = OPERATORS[name](spark, df)
    got.collect()
    if name in ("line dedup", "quality", "drop toxic", "drop near"):
        assert got.dtypes == df.dtypes
    assert OPERATORS[name](spark, docs(spark, [])).collect() == []


def test_results_of_odd_rows(spark):
    d = docs(spark)
    rows = lambda name: OPERATORS[name](spark, d).collect()
    assert rows("toxic") == [] and len(rows("drop toxic")) == len(ROWS)
    assert {r.doc_id: r.duplicate_of for r in rows("near")} == {6: 5}
    # Without the copy; the null id and repeated rows stay.
    assert collections.Counter(r.doc_id for r in rows("drop near")) == {1: 1, 2: 2, 3: 1, 4: 1, None: 1, 5: 1, 7: 1}
    tokens = [(r.doc_id, r.n_tokens, r.token_ids) for r in rows("bpe")]
    assert (3, 0, []) in tokens and (4, 0, None) in tokens and sum(i == 2 for i, _, _ in tokens) == 2
    scores = {(r.doc_id, r.n_symbols, r.perplexity) for r in rows("lm")}
    assert (4, 0, None) in scores and {n for i, n, _ in scores if i == 3} == {1} and len([x for x in scores if x[0] == 2]) == 1 and {n for i, n, _ in scores if i == 5} == {len(LONG) + 1}
    # Two labels are too few for a rule: every row, the repeated one twice, is as likely good as not.
    assert collections.Counter((r.doc_id, r.score) for r in rows("classifier")) == {(1, 0.5): 1, (2, 0.5): 2, (3, 0.5): 1, (4, 0.5): 1, (None, 0.5): 1, (5, 0.5): 1, (6, 0.5): 1, (7, 0.5): 1}
    packed = collections.Counter()
    for r in rows("packing"):
        packed[r.example] += r.n_tokens
    assert packed[3] == packed[4] == 0 and packed[None] > 0 and packed[5] == next(n for i, n, _ in tokens if i == 5)
    pages = {r.page_id: (r.text, r.score) for r in rows("html") if r.page_id in (3, 4)}
    assert pages == {3: ("", 0.0), 4: ("", 0.0)}
    report = {r.doc_id: (r.symbols, r.repeats) for r in rows("quality report")}
    assert report[4] == report[3] == (0, 0)


def test_line_dedup_against_brute_force(spark):
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark)).collect()}
    # The null id sorts first and takes "same line"; rows that repeat a document are one.
    assert got[1] == "own line" and got[2] == "\nother" and got[None] == "same line" and got[4] is None
    rows = spark.read.parquet(f"{DIR}/documents.parquet")
    seen, want = set(), {}
    for r in rows.orderBy("doc_id").collect():
        kept = []
        for line in (r.text or "").split("\n"):
            bare = line.strip(" \t\r\x0b\x0c ")
            if not bare or bare not in seen:
                kept.append(line)
            seen.add(bare)
        want[r.doc_id] = "\n".join(kept) if kept else None
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(rows).collect()}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_near_copies_join_and_others_stay(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    base = [word() for _ in range(200)]
    rows = [(i, " ".join(base[:k] + [word()] + base[k + 1 :])) for i, k in enumerate(range(0, 200, 2))] + [(1000 + i, " ".join(word() for _ in range(100))) for i in range(30)]
    rows += [(2000, "short text here"), (2001, "short text here")]
    got = {r.doc_id: r.duplicate_of for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: 0 for i in range(1, 100)}, 2001: 2000}


def _changed(rng, ws, share):
    """The words with a share of them replaced, in single places."""
    ws = list(ws)
    for k in rng.choice(len(ws), int(share * len(ws)), replace=False):
        ws[k] = f"n{rng.integers(1 << 40)}"
    return ws


def _jaccard(a, b):
    a, b = (set(zip(x, x[1:])) for x in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_beside_exact_copies_join(spark):
    rng = np.random.default_rng(3)
    rows, near = [], []
    for g in range(60):
        base = [f"w{rng.integers(1 << 40)}" for _ in range(200)]
        other = _changed(rng, base, 0.12)
        assert _jaccard(base, other) >= 0.6
        rows += [(g * 100 + i, " ".join(base)) for i in range(50)] + [(g * 100 + 60, " ".join(other))]
        near.append(g * 100 + 60)
    got = {r.doc_id: r.duplicate_of for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got.get(g * 100 + i) == g * 100 for g in range(60) for i in range(1, 50))
    found = sum(got.get(i) == i - 60 for i in near)
    print("near copies beside 50 copies found:", found, "of", len(near))
    assert found >= 57


def test_documents_that_share_a_passage_below_the_threshold_stay(spark):
    rng = np.random.default_rng(4)
    passage = [f"p{k}" for k in range(123)]
    rows = [(i, passage + [f"w{rng.integers(1 << 40)}" for _ in range(77)]) for i in range(2_000)]
    assert 0.42 < _jaccard(rows[0][1], rows[1][1]) < 0.46
    got = near_dedup.near_duplicates(spark.createDataFrame([(i, " ".join(ws)) for i, ws in rows], "doc_id long, text string")).count()
    print("documents with a shared passage taken for copies:", got, "of", len(rows))
    assert got == 0


def test_packs_keep_limits_and_lose_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(1, 3000)), int(rng.integers(1, 10)), int(rng.integers(0, 3000))) for i in range(400)] + [(400, 20_000, 3, 9_000), (None, None, None, None)]
    got = packing.pack(spark.createDataFrame(rows, "example long, n_tokens long, n_segments long, n_loss long")).toPandas()
    sums = got.groupby(["group", "pack"])[["n_tokens", "n_segments", "n_loss"]].sum()
    assert (sums <= [packing.TOKENS, packing.SEGMENTS, packing.LOSS]).all().all()
    want = {r[0]: r[1] for r in rows if r[0] is not None}
    assert got.dropna(subset=["example"]).groupby("example").n_tokens.sum().to_dict() == want
    bound = max(sums.n_tokens.sum() / packing.TOKENS, sums.n_segments.sum() / packing.SEGMENTS, sums.n_loss.sum() / packing.LOSS)
    assert len(sums) <= 1.15 * bound + 1


def test_pieces_count_their_own_turns(spark):
    word = " one"
    turns = [(1, 0, "user", word * 4000), (1, 1, "assistant", word * 4000), (2, 0, "user", word * 5), (2, 1, "assistant", word * 7)]
    e = packing.conversation_examples(spark.createDataFrame(turns[::-1], "conv_id long, turn long, role string, text string"))
    got = {(r.example, r.piece): tuple(r)[4:] for r in packing.pack(e).collect()}
    assert got == {(1, 0): (0, 4096, 2, 96), (1, 1): (4096, 3072, 1, 3072), (1, 2): (7168, 832, 1, 832), (2, 0): (0, 12, 2, 7)}
    e = packing.document_examples(spark.createDataFrame([(1, word * 7000)], "doc_id long, text string"))
    assert sorted(tuple(r)[4:] for r in packing.pack(e).collect()) == [(0, 3072, 1, 3072), (3072, 3072, 1, 3072), (6144, 856, 1, 856)]
    assert list(packing.cut_turns([(0, False)] * 30, (10, 24, 5))) == [(0, 0, 24, 0), (0, 0, 6, 0)] and list(packing.cut_turns([], (10, 24, 5))) == [(0, 0, 0, 0)]


def _by_tokens(turns, limits):
    """Sizes of the pieces of an example, token by token."""
    out, n, seg, loss, first, at = [], 0, 0, 0, 0, 0
    for size, own in turns:
        fresh = True
        for _ in range(max(size, 1)):
            one = int(size > 0)
            if n + one > limits[0] or loss + one * own > limits[2] or fresh and seg + 1 > limits[1]:
                out.append((first, n, seg, loss))
                n, seg, loss, first, fresh = 0, 0, 0, at, True
            n, loss, at, seg, fresh = n + one, loss + one * own, at + one, seg + fresh, False
    return [*out, (first, n, seg, loss)]


def _by_hand(rows, limits):
    """Packs of (order key, sizes) by the dot-product heuristic in exact fractions."""
    from fractions import Fraction

    left, packs = sorted(rows), []
    while left:
        room, mine = list(limits), []
        while fitting := [r for r in left if all(a <= b for a, b in zip(r[1], room))]:
            dot = lambda r: sum(Fraction(a, t) * Fraction(b, t) for a, b, t in zip(r[1], room, limits))
            best = max(fitting, key=dot)
            mine.append(best)
            left.remove(best)
            room = [b - a for a, b in zip(best[1], room)]
        packs.append(sorted(mine))
    return packs


def test_pieces_and_packs_against_brute_force(spark):
    rng = np.random.default_rng(6)
    limits = (64, 6, 32)
    for _ in range(300):
        turns = [(int(rng.integers(0, 90)) if rng.random() < 0.3 else int(rng.integers(0, 20)), bool(rng.random() < 0.5)) for _ in range(rng.integers(0, 12))]
        assert list(packing.cut_turns(turns, limits)) == _by_tokens(turns, limits)
    # Sizes that are powers of two make all products exact, so that ties are ties in floats, too.
    sizes = np.stack([2 ** rng.integers(0, 6, 120), rng.integers(0, 4, 120), 2 ** rng.integers(0, 5, 120)], axis=1)
    keys = [(k, tuple(map(int, r))) for k, r in enumerate(sizes)]
    got = packing.fill(sizes, np.array([64, 8, 32]))
    assert [sorted(keys[i] for i in np.flatnonzero(got == p)) for p in range(got.max() + 1)] == _by_hand(keys, (64, 8, 32))


def test_conversations_against_brute_force(spark):
    """The whole of op3's examples: turns by a tokenizer of another library, pieces token by token."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    rows = spark.read.parquet(f"{DIR}/conversations.parquet").orderBy("conv_id", "turn").collect()
    turns = collections.defaultdict(list)
    for r in rows:
        turns[r.conv_id].append((len(t.encode(r.text, add_special_tokens=False).ids), r.role == "assistant"))
    limits = (256, 5, 128)
    got = packing.pack(packing.conversation_examples(spark.read.parquet(f"{DIR}/conversations.parquet")), tokens=256, segments=5, loss=128).toPandas()
    have = {(r.example, r.piece): (r.first_token, r.n_tokens, r.n_segments, r.n_loss) for r in got.itertuples()}
    assert have == {(c, i): p for c, ts in turns.items() for i, p in enumerate(_by_tokens(ts, limits))}
    assert (got.groupby(["group", "pack"])[["n_tokens", "n_segments", "n_loss"]].sum() <= list(limits)).all().all()


def test_odd_conversations(spark):
    rows = [(None, 0, "user", " one"), (None, 0, "user", " one"), (1, None, "assistant", " one"), (1, 5, None, None), (1, 5_000, "assistant", " one one"), (1, 9_000, "user", ""), *[(2, 3, "user", " one")] * 60]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, run int, alone int")
    got = packing.pack(packing.conversation_examples(df)).toPandas()
    assert len(got[got.example.isna()]) == 2
    one = got[got.example == 1].sort_values("piece")
    assert one[["piece", "first_token", "n_tokens", "n_segments", "n_loss"]].values.tolist() == [[0, 0, 1, 2, 1], [1 << 32, 1, 2, 1, 2], [2 << 32, 3, 0, 1, 0]]
    assert sorted(got[got.example == 2].n_segments) == [12, 24, 24] and packing.pack(packing.conversation_examples(df.where("false"))).collect() == []


def test_repeated_ids_are_spread_and_open_packs_are_filled(spark):
    rows = [(None, 700, 1, 500)] * 900 + [(7, 300, 1, 20)] * 900 + [(i, 40 + i % 900, 2, i % 40) for i in range(600)]
    df = spark.createDataFrame(rows, "example long, n_tokens long, n_segments long, n_loss long")
    got = packing.pack(df, group_rows=100).toPandas()
    assert len(got) == len(rows) and got.groupby("group").size().max() <= 250
    sums = got.groupby(["group", "pack"])[["n_tokens", "n_segments", "n_loss"]].sum()
    assert (sums <= [packing.TOKENS, packing.SEGMENTS, packing.LOSS]).all().all()
    # Of 24 groups each would leave a pack that no size fills: of all packs, hardly one is.
    assert (sums < [0.8 * packing.TOKENS, 0.8 * packing.SEGMENTS, 0.8 * packing.LOSS]).all(axis=1).sum() <= 2


def _near(vectors, queries, k=10):
    """The numbers of the k nearest of all vectors for each of the queries, by brute force."""
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -9
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_neighbours_recall(spark):
    """Of all queries that the production query asks for."""
    for d in (DIR, "/root/testdata/sf0.1"):
        got = queries.op4_permutation_ann(spark, d).toPandas()
        p = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
        ids, asked = p.vec_id.to_numpy(), np.flatnonzero(p.vec_id % 20 == 0)
        best = ids[_near(np.stack(p.embedding).astype(float), asked)]
        found = got.groupby("vec_id").neighbour.apply(set)
        recall = np.mean([len(found[i] & set(b)) / 10 for i, b in zip(ids[asked], best)])
        print("recall at 10 over", d, recall)
        assert recall >= 0.95 and len(got) == 10 * len(asked) and not got.duplicated(["vec_id", "neighbour"]).any()


def test_neighbours_of_odd_rows(spark):
    odd = spark.createDataFrame([(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "y"), (2, [1.0, 0.0], "z"), (3, None, ""), (4, [], ""), (5, [0.0, 0.0], ""), (None, [1.0, 1.0], ""), (6, [1.0, None], ""), (7, [1.0, float("nan")], ""), (8, [1.0, 0.0, 0.0], "")], "vec_id long, embedding array<float>, region string")
    assert {(r.vec_id, r.neighbour, r.similarity) for r in ann.neighbours(odd, every=1).collect()} == {(1, 2, 1.0), (2, 1, 1.0)}
    assert ann.neighbours(odd.where("false")).collect() == [] and ann.neighbours(odd.where("vec_id = 2"), every=1).collect() == [] and ann.neighbours(odd, every=100).collect() == []


def test_ties_of_neighbours_go_to_the_lesser_id(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n for r in ann.neighbours(same, k=3, every=20).groupBy("vec_id").agg(F.sort_array(F.collect_list("neighbour")).alias("n")).collect()}
    assert got == {0: [1, 2, 3], 20: [0, 1, 2]}


def test_files_are_split_without_loss(spark, monkeypatch):
    """Small blocks and lots find all that large ones do; more blocks only look at more."""
    e = spark.read.parquet(f"{DIR}/embeddings.parquet")
    want = {(r.vec_id, r["rank"]): r.similarity for r in ann.neighbours(e, every=2).collect()}
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "LOT", 8)
    got = {(r.vec_id, r["rank"]): r.similarity for r in ann.neighbours(e, every=2).collect()}
    assert got.keys() == want.keys() and all(got[x] >= want[x] for x in want)


def test_neighbours_recall_outside_a_crowd(spark):
    rng = np.random.default_rng(5)
    n, hot, every = 8_000, 7_200, 5
    x = rng.normal(size=(n, 64))
    x[:hot] = 0.5 * x[:hot] + 3 * rng.normal(size=64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    got = ann.neighbours(df, every=every).groupBy("vec_id").agg(F.collect_set("neighbour").alias("n")).toPandas().set_index("vec_id").n
    asked = np.arange(0, n, every)
    found = np.array([len(set(got[i]) & set(b)) / 10 for i, b in zip(asked, _near(x, asked))])
    print("recall inside and outside the crowd:", found[asked < hot].mean().round(3), found[asked >= hot].mean().round(3))
    assert found[asked < hot].mean() >= 0.9 and found[asked >= hot].mean() >= 0.9


def test_clauses_not_words():
    m = toxicity.Matcher(*toxicity.lexicon()["en"])
    toxic = lambda t: m.score(t)[0] >= toxicity.THRESHOLD
    assert toxic("You are an idiot.") and toxic("I will kill you!") and toxic("what a moron. pathetic clown")
    assert not toxic("You are not an idiot.") and not toxic("He said you are an idiot.") and not toxic("I won't hurt you.") and not toxic("An idiot.")


def test_allowance_is_for_stems_only():
    m = toxicity.Matcher({"idiot": 1.0}, {"zorg": 1.0}, 2.2e-4)
    filler = "rien de plus ici. " * 560
    assert m.score(filler + "tu es un idiot. " * 5)[0] == 8.75
    assert m.score(filler + "i will kill you! ")[0] == 2.0
    assert m.score(filler + "zorgal. " * 5)[0] == 0 and m.score("zorgal. " * 5)[0] > 4


def test_bpe_equals_the_library_and_round_trips(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()] + [(-1, "<|endoftext|> x"), (-2, "  a\n\n b\t"), (-3, "aaaaaaaaaaaaa")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.token_ids for r in bpe.encode(df).collect()}
    texts = dict(rows)
    assert all(got[i] == t.encode(x, add_special_tokens=False).ids for i, x in texts.items() if x)
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()} == texts


def test_bpe_query_decodes_what_it_encodes(spark):
    rows = queries.op6_bpe(spark, DIR).collect()
    assert len(rows) == spark.read.parquet(f"{DIR}/documents.parquet").count() and all(r.gives_back for r in rows if r.token_ids is not None)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "é ퟿ <|endoftext|>")], "doc_id long, text string")
    assert {r.doc_id: (r.gives_back, r.token_ids is None) for r in bpe.round_trip(odd).collect()} == {1: (None, True), 2: (True, False), 3: (True, False)}


def test_decoding_odd_ids(spark):
    rows = [(1, [64, None, 10**6, -3]), (2, None), (3, []), (4, [bpe.vocabulary(bpe.VOCABULARY).byte_id[0xC3].item()])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, token_ids array<int>, text string")
    one = bpe.vocabulary(bpe.VOCABULARY).bytes[64].decode()
    assert {r.doc_id: r.text for r in bpe.decode(df).collect()} == {1: one + "\ufffd" * 3, 2: None, 3: "", 4: "\ufffd"}
    assert bpe.decode(df.where("false")).collect() == []


def test_model_against_dictionaries(spark):
    texts = ["the cat sat on the mat", "the cat ate the rat", "a cat and a rat", "the end"] * 3
    folder = lm.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    model = lm.Model(folder)
    n = lm.ORDER
    counts = {n: collections.Counter(lm.keys_of(texts)[0].tolist())}
    for k in range(n - 1, 0, -1):
        counts[k] = collections.Counter()
        for g, c in counts[k + 1].items():
            low = g & ((1 << lm.BITS * k) - 1)
            # Different symbols before it; raw counts where it begins a text.
            counts[k][low] += c if low >> lm.BITS * (k - 1) == lm.START else 1
    cut = {}
    for k, c in counts.items():
        h = collections.Counter(c.values())
        ns = [h[i] for i in range(5)]
        y = ns[1] / (ns[1] + 2 * ns[2]) if ns[1] else 0
        cut[k] = [max(0.01, min(i, i - (i + 1) * y * ns[i + 1] / ns[i])) for i in (1, 2, 3)] if all(ns[1:]) else [0.5, 1.0, 1.5]

    def p(key, k):
        if k == 0:
            return 1 / lm.SYMBOLS
        key &= (1 << lm.BITS * k) - 1
        same = {g: c for g, c in counts[k].items() if g >> lm.BITS == key >> lm.BITS}
        if not same:
            return p(key, k - 1)
        total = sum(same.values())
        off = lambda c: cut[k][min(c, 3) - 1]
        own = same.get(key, 0)
        return (own - off(own) if own else 0) / total + sum(map(off, same.values())) / total * p(key, k - 1)

    keys = np.unique(lm.keys_of(["the cat", "zebra", ""])[0])
    assert np.allclose(np.exp(model.log_probability(keys)), [p(int(k), n) for k in keys], rtol=1e-4)
    context = int(keys[0]) >> lm.BITS << lm.BITS
    assert abs(np.exp(model.log_probability(context + np.arange(lm.SYMBOLS))).sum() - 1) < 1e-3


def test_model_in_many_files_is_the_same(spark, monkeypatch):
    """A key is sought in the one file that its hash names."""
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    want = sorted(map(tuple, lm.corpus_perplexities(df).collect()))
    monkeypatch.setattr(lm, "FILE_ROWS", 1_000)
    folder = lm.train(df)
    assert len(lm.Model(folder).tables["p5"].parts) >= 16
    assert sorted(map(tuple, lm.perplexities(df, folder).collect())) == want


def test_main_text_of_a_page():
    body = "This is a paragraph, with commas, and enough text to count as content for the page. " * 3
    html = f"<html><body><nav><a href=/>Home</a> links</nav><div id=main><p>{body}</p><p>{body}</p><p>Short.</p></div><div class=sidebar><a href=x>{body}</a></div></body>"
    text, score = html_text.extract(html)
    assert text.count("This is a paragraph") == 6 and "Home" not in text and text.endswith("Short.") and score > 0
    assert html_text.extract("<div>" * 5000 + "deep")[0] == "deep" and html_text.extract(None) == ("", 0.0)


@pytest.mark.parametrize(
    "page",
    [
        "<html><body class='page no-sidebar'>{}</body></html>",
        "<body><div class='layout menu-open'>{}</div></body>",
        "<body><article class='post has-comment'>{}</article></body>",
        "<html><body><form id=aspnet><nav>Menu</nav>{}</form></body></html>",
        "<html><head><title>T</title><meta charset=utf-8><body>{}</body></html>",
        "<html><head><title>T</title>{}",
        "<body><nav><a href=/>Home</a>{}</body>",
        "<body><aside class=sidebar>{}</body>",
    ],
)
def test_boilerplate_marks_do_not_empty_a_page(page):
    body = "This is a paragraph, with commas, and enough text to count as content for the page. " * 3
    text, score = html_text.extract(page.format(f"<div><p>{body}</p><p>{body}</p></div>"))
    assert text.count("This is a paragraph") == 6 and score > 0 and "Menu" not in text


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = {r.doc_id for r in classifier.quality_scores(docs, marks.where("doc_id % 2 = 0")).collect()}
    rest = marks.where("doc_id % 2 = 1").collect()
    assert np.mean([(r.doc_id in kept) == bool(r.quality) for r in rest]) >= 0.95


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    import duckdb

    df = queries.QUERIES[name](spark, DIR)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    got = db.execute(queries.SQL[name])
    columns = [x[0] for x in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str([r[c] for c in df.columns]) for r in df.collect()) == sorted(str([r[columns.index(c)] for c in df.columns]) for r in got.fetchall())


def test_pipeline_against_its_stages(spark):
    """The rows of run() are those of the stages called one by one; each filter keeps whole rows of what it got."""
    import corpus_pipeline

    got = corpus_pipeline.run(spark, DIR)
    assert got.count() > 0
    docs = common.table(spark, DIR, "documents")
    first = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, spark.createDataFrame((x := stage(spark, docs, DIR)).collect(), x.schema)
        if k < 4:
            assert docs.columns == first and 0 < docs.count() <= before.count()
            if k != 2:
                assert docs.exceptAll(before).count() == 0
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, got.collect()))
