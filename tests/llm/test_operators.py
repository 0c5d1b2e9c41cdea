"""The training-data operators against plain versions on small tables with nulls, empty and
long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.llm import common as C
from provenant.llm import (embedding_join, hidden_markov, jaccard_join, language_id, mixing, quality_rules, secrets,
                           sentencepiece, toxicity, url_filter)

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, BASE, "a"), (2, BASE, "b"), (3, BASE.replace("w30 ", ""), "a"), (4, BASE + " tail end", None), (5, None, "a"), (6, "", "c"), (7, "one two", "a"),
    (8, "one two", "a"), (9, " \t\n", None), (10, "x" * 5000, "b"), (11, " ".join(f"z{i % 7}" for i in range(900)), "b"), (12, "日本 ñandú ▁ \U0001F600 end", "c"), (13, "A B\nA B\n\nc! d? ***", "a"),
    (None, BASE, "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, "en", -1, "clash", 0) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size long, path string, row long")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def shingle_set(text):
    w = WORDS.findall(text or "")
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_words_and_components():
    import pyarrow as pa
    texts = [t or "" for _, t, _ in TEXTS]
    data, offsets = C.text_bytes(pa.array(texts))
    starts, ends, bounds = C.word_bounds(data, offsets)
    got = [[bytes(data[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in itertools.pairwise(bounds)]
    assert got == [WORDS.findall(t) for t in texts]
    assert C.local_components(6, np.array([5, 3, 1]), np.array([3, 1, 4])).tolist() == [0, 1, 2, 1, 1, 1]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    got = {r.node: r.root for r in C.components(edges).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 50: 50, 51: 50}


def test_sentencepiece_is_the_model_and_round_trips(docs, nothing):
    import sentencepiece as library
    model = sentencepiece.read_model()
    plain = library.SentencePieceProcessor(model_proto=model)
    tokens = sentencepiece.encode(docs, model)
    got = {r.doc_id: r for r in tokens.collect()}
    for i, text, _ in TEXTS:
        assert got[i].ids == plain.encode(text or "") and got[i].n_tokens == len(got[i].ids) and got[i].round_trip
    back = {r.doc_id: r.text for r in sentencepiece.decode(tokens, model).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t, _ in TEXTS)
    assert sentencepiece.encode(nothing, model).count() == 0


def test_sentencepiece_on_random_words():
    import sentencepiece as library
    model = sentencepiece.read_model()
    plain, own = library.SentencePieceProcessor(model_proto=model), sentencepiece.Pieces(model)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("aehinorst  \n.é日▁"), rng.integers(0, 60))) for _ in range(400)]
    ids, bounds = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == plain.encode(texts)


def brute_links(rows):
    sets = [shingle_set(t) if i is not None else set() for i, t, _ in rows]
    links = {i: set() for i in range(len(rows))}
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            links[a].add(b)
            links[b].add(a)
    return links


def reach(links, n):
    root = list(range(n))
    for _ in range(n):
        for a in links:
            for b in links[a]:
                root[a] = root[b] = min(root[a], root[b])
    return root


def test_jaccard_join_is_the_brute_force(spark, docs, nothing):
    rng = np.random.default_rng(1)
    rows = list(TEXTS)
    for g in range(6):
        words = [f"g{g}_{k}" for k in range(80)]
        for c in range(12):
            w = list(words)
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(len(w))] = f"n{rng.integers(1000)}"
            rows.append((100 + 20 * g + c, " ".join(w), "s"))
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in jaccard_join.jaccard_links(table, runs=6).collect()}
    links = brute_links(rows)
    root = reach(links, len(rows))
    for k, (i, _, _) in enumerate(rows):
        assert got[i].n_links == len(links[k]), rows[k]
        assert got[i].class_id == (None if i is None else min(rows[m][0] for m in range(len(rows)) if root[m] == root[k] and rows[m][0] is not None))
    assert jaccard_join.jaccard_links(nothing).count() == 0
    assert jaccard_join.runs_for(0.8) >= 2


def test_jaccard_join_splits_large_and_dense_nodes(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    rng = np.random.default_rng(2)
    dense = [[f"d{k}" for k in range(100)] for _ in range(40)]
    for w in dense:
        w[rng.integers(100)] = f"n{rng.integers(10**6)}"
    loose = [["same", "five", "words", "at", "start", *(f"r{n}_{k}" for k in range(30))] for n in range(40)]
    rows = [(i, " ".join(w), "s") for i, w in enumerate(dense + loose)]
    got = {r.doc_id: r.n_links for r in jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string, source string"), runs=5).collect()}
    want = {rows[k][0]: len(v) for k, v in brute_links(rows).items()}
    assert got == want


def test_jaccard_join_recall_over_shared_coordinates():
    # A pair agrees in one set of coordinates; every node of every tree chooses among them.
    rng, runs, pairs = np.random.default_rng(12), jaccard_join.runs_for(0.8), 400_000
    agree = rng.binomial(jaccard_join.COORDS, 0.8, pairs) / jaccard_join.COORDS
    lost = np.ones(pairs, dtype=bool)
    for _ in range(runs):
        nodes = np.ones(pairs, dtype=np.int64)
        for _ in range(jaccard_join.DEPTH):
            nodes = rng.binomial(jaccard_join.BRANCH * nodes, agree)
        lost &= nodes == 0
    assert lost.mean() <= 1e-4
    assert jaccard_join.loss(0.8, runs) <= 1e-4 < jaccard_join.loss(0.8, runs - 1)


def test_jaccard_join_links_in_a_hot_loose_node(spark, monkeypatch):
    # All sets share a third of their shingles, so nodes stay large over several levels; the trees are production's.
    monkeypatch.setattr(jaccard_join, "SMALL", 16)
    rng, rows = np.random.default_rng(13), []
    for g in range(150):
        words = [f"same{k}" for k in range(40)] + [f"g{g}_{k}" for k in range(60)]
        near = list(words)
        near[50], near[80] = f"x{g}", f"y{rng.integers(10**6)}"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(near))]
    got = {r.doc_id: r.n_links for r in jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(300), 1)


def test_quality_counts_and_votes(docs, nothing):
    got = {r.doc_id: r for r in quality_rules.quality(docs).collect()}
    for i, text, _ in TEXTS:
        t = text or ""
        w = WORDS.findall(t)
        windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        repeated = {k + o for k, x in enumerate(windows) if windows.count(x) > 1 for o in range(5)} if len(w) < 2000 else set()
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert got[1].kept and quality_rules.quality(nothing).count() == 0


def test_em_learns_the_better_rule(spark):
    rows = [(1, "good words here " * 3)]
    assert quality_rules.base_counts(spark.createDataFrame(rows, "doc_id long, text string")).first().n_repeat_words == 9
    prior, accuracy = quality_rules.fit(spark.createDataFrame([tuple([1] * len(quality_rules.RULES))] * 90 + [tuple([-1] * len(quality_rules.RULES))] * 10, ", ".join(f"{n} int" for n in quality_rules.RULES)))
    assert 0.85 < prior < 0.95 and all(g > 0.9 and b > 0.8 for g, b in accuracy.values())


def test_mix_hits_its_targets(spark, nothing):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 200))), None if s == 4 else f"s{s}") for i in range(1500) for s in [int(rng.choice(6, p=[.4, .2, .1, .1, .1, .1]))]]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(table).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[r.source] and r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 250 for s in names)
    again = {r.doc_id: r.taken for r in mixing.mix_sources(table).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert mixing.mix_sources(nothing).count() == 0
    twice = mixing.repeated(table, mixing.mix_sources(table))
    assert twice.columns == table.columns and twice.count() == sum(r.copies for r in got)


def test_dual_is_a_plain_solution_and_sources_rank_by_code_point(spark):
    rng = np.random.default_rng(8)
    names = [f"s{i}" for i in range(300)] + ["é", "Z", "日本", None]
    rows = [(s, int(rng.integers(1, 90))) for s in names for _ in range(int(rng.integers(1, 12)))]
    got = {r.source: r for r in mixing.document_rates(spark.createDataFrame(rows, "source string, size long").repartition(5)).collect()}
    sizes = {s: [n for t, n in rows if t == s] for s in names}
    order = sorted((s for s in names if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    open_ = [r for r in got.values() if not r.full]
    level = open_[0].target / (5, 2, 1)[order.index(open_[0].source) % 3]
    for place, s in enumerate(order):
        r = got[s]
        assert r.source_size == sum(sizes[s]) and math.isclose(r.target, min((5, 2, 1)[place % 3] * level, 2 * sum(sizes[s])), rel_tol=1e-9)
        if r.full:
            continue
        scale, low, high = max(1.0, float(np.mean(sizes[s]))), -60.0, 60.0
        for _ in range(200):
            middle = (low + high) / 2
            have = sum(n * 2 / (1 + math.exp(-middle * n / scale)) for n in sizes[s])
            low, high = (middle, high) if have < r.target else (low, middle)
        for n in sizes[s]:
            assert math.isclose(2 / (1 + math.exp(-r.multiplier * n / scale)), 2 / (1 + math.exp(-low * n / scale)), abs_tol=1e-4)


def test_stages_keep_columns_of_any_name(spark):
    odd = ["found", "_hit", "_key", "_copies", "_id", "_copy", "c0", "row"]
    docs = spark.createDataFrame([(1, "see password=abcdef123 x", "s", *range(8)), (2, None, None, *range(8))], "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in odd))
    masked = secrets.redacted(docs)
    assert masked.columns == docs.columns and {r.doc_id: (r.text, r.found) for r in masked.collect()} == {1: ("see [SECRET] x", 0), 2: (None, 0)}
    twice = mixing.repeated(docs, mixing.mix_sources(docs))
    assert twice.columns == docs.columns and {r._copies for r in twice.collect()} == {3}
    assert secrets.redacted(docs.where("false")).count() == 0


def test_owners_and_repositories_each_decide(spark):
    few, owners, repos = "Few1" + "a2" * 10, "Own2" + "b3" * 10, "Rep3" + "c4" * 10
    rows = [(1, few, "o1", "r1"), (2, few, "o2", "r2")]
    rows += [(10 + k, owners, f"o{k}", "same") for k in range(3)]  # three owners of one repository name each
    rows += [(20 + k, repos, "o1", f"r{k}") for k in range(5)]  # one owner's five repositories
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    got = {r.doc_id: r.n_owned for r in secrets.scan(table, repository="repo").collect()}
    assert got == {r[0]: int(r[1] == few) for r in rows}
    without = {r.doc_id: r.n_owned for r in secrets.scan(table).collect()}
    assert without == {r[0]: int(r[1] != owners) for r in rows}
    for limit, value, shown in (("MOST_OWNERS", 3, owners), ("MOST_REPOSITORIES", 5, repos)):
        before = getattr(secrets, limit)
        setattr(secrets, limit, value)
        try:
            assert {r.doc_id: r.n_owned for r in secrets.scan(table, repository="repo").collect()} == {r[0]: int(r[1] in (few, shown)) for r in rows}
        finally:
            setattr(secrets, limit, before)


def test_language_rejection_is_a_quantile(spark):
    rng = np.random.default_rng(3)
    sound = {"aa": "ka ta ra na ma".split(), "bb": "sch zug ber ung ein".split()}
    rows = [(i, " ".join("".join(rng.choice(sound[("aa", "bb")[i % 2]], 3)) for _ in range(6)), ("aa", "bb")[i % 2]) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(table, "doc_id", rows=300)
    scores = sorted(r.score for r in language_id.predict(table, model).collect())
    assert 0 < model.threshold <= 0.5
    assert sum(x < model.threshold for x in scores) <= 0.002 * len(scores)
    junk = spark.createDataFrame([(1, "q w q w 7 x y v j"), (2, "kataran schzug")], "doc_id long, text string")
    assert language_id.predict(junk, model).count() == 2


def test_toxicity_learns_words_and_stems(spark, nothing, docs):
    rng = np.random.default_rng(5)
    fill = [f"f{c}ll{d}" for c in "abcdefgh" for d in "abcdefgh"]
    fill = [f.replace("0", "o") for f in fill]
    bad = ["grobian", "zorkish", "zorkly", "zorkum"]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(fill, 40))
        toxic = i % 4 == 0
        if toxic:
            for b in rng.choice(bad, 2):
                w.insert(int(rng.integers(len(w))), str(b))
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(toxic)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (9999, None)], "doc_id long, toxic int")
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    known = table.where(C.fold("doc_id", 5) != 0)
    assert sorted(r.doc_id for r in table.where(C.fold("doc_id", 5) == 0).collect()) == held
    grammar = toxicity.train(known, marks)
    got = {r.doc_id: r for r in toxicity.toxicity(table, grammar).collect()}
    assert all(got[i].predicted == labels[i][1] for i in held)
    odd = toxicity.toxicity(docs, grammar).collect()
    assert len(odd) == len(TEXTS) and all(r.predicted == 0 and 0 <= r.score < 0.5 for r in odd)
    assert toxicity.toxicity(nothing, grammar).count() == 0
    assert toxicity.train(nothing, marks).curve is None


def test_grammar_composes_negation_report_target_and_threat():
    lexicon, machine = toxicity.Lexicon({"zork": 4.0}), toxicity.machine()

    def largest(text):
        return toxicity.features(text, lexicon, machine)[1]

    plain = largest("a zork b")
    assert largest("not a zork") < plain < largest("you zork") and largest("she said a zork") < largest("she is a zork")
    assert largest("kill you") > 0 and largest("kill. you") == 0 and largest("never kill you") < largest("kill you")
    assert largest("not a b c d zork") == plain
    assert largest("killing you") == largest("you will be killed") == largest("I will murder you") == largest("kill you")
    assert largest("kill") == largest("you") == 0


def test_the_composed_machine_is_the_five_transducers_one_after_another():
    rng = np.random.default_rng(6)
    parts = toxicity.transducers()
    next_, factor, menace = toxicity.machine()
    assert len(parts) == 5 and len(next_) == np.prod([len(p.next) for p in parts])
    for _ in range(400):
        read = rng.integers(0, 7, rng.integers(1, 25)).tolist()
        weights = [float(rng.integers(1, 9)) if k == toxicity.INSULT else 1.0 for k in read]
        kinds, scaled = read, weights
        for part in parts:
            kinds, scaled = part.apply(kinds, scaled)
        stepwise = sum(w for k, w in zip(kinds, scaled, strict=True) if k == toxicity.INSULT) + toxicity.THREATENED * sum(w for k, w in zip(kinds, scaled, strict=True) if k == toxicity.MENACE)
        state, whole = 0, 0.0
        for kind, weight in zip(read, weights, strict=True):
            whole += (weight if kind == toxicity.INSULT else 1.0) * factor[state, kind] + menace[state, kind]
            state = next_[state, kind]
        assert math.isclose(stepwise, whole, rel_tol=1e-9, abs_tol=1e-12)


def test_hidden_markov_likelihoods(spark, nothing):
    rows = [(i, t) for i, (_, t, _) in enumerate(TEXTS)] + [(50 + i, f"The cat {i % 3} saw the dog") for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in hidden_markov.score_texts(table, C.fold("doc_id", 7) != 2).collect()}
    tokens = {i: [*WORDS.findall("".join(c.lower() if c.isascii() else c for c in t or "")), None] for i, t in rows}
    count = {}
    for i, seq in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for x in seq:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, seq in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(seq), sum(x in count for x in seq), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in seq), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert hidden_markov.score_texts(nothing, C.fold("doc_id", 7) != 2).count() == 0
    alone = hidden_markov.score_texts(table.limit(3), F.lit(False)).collect()
    assert len(alone) == 3 and all(r.train_tokens == 0 and r.base_score == 0 for r in alone)


def test_forward_recursion_and_counts_by_enumeration():
    rng = np.random.default_rng(6)
    k = hidden_markov.STATES
    model = hidden_markov.first_guess(rng.random(hidden_markov.CLASSES))
    model.start = rng.dirichlet(np.ones(k))
    seq = rng.integers(0, 9, 4).astype(np.uint16)
    paths = list(itertools.product(range(k), repeat=4))
    weight = np.array([model.start[p[0]] * np.prod([model.emit[s, c] for s, c in zip(p, seq, strict=True)]) * np.prod([model.move[a, b] for a, b in itertools.pairwise(p)]) for p in paths])
    got = hidden_markov.log_likelihoods(model, np.concatenate((seq, seq[:2])), np.array([0, 4, 6]))
    assert math.isclose(got[0], math.log10(weight.sum()), rel_tol=1e-9)
    out = [np.zeros(k), np.zeros((k, k)), np.zeros((k, hidden_markov.CLASSES))]
    hidden_markov.expected(model, seq, np.array([0]), np.array([4]), out)
    share = weight / weight.sum()
    start, move = np.zeros(k), np.zeros((k, k))
    for p, x in zip(paths, share, strict=True):
        start[p[0]] += x
        for a, b in itertools.pairwise(p):
            move[a, b] += x
    assert np.allclose(out[0], start, atol=1e-4) and np.allclose(out[1] * model.move, move, atol=1e-4) and math.isclose(out[2].sum(), 4, rel_tol=1e-4)


def test_hidden_markov_counts_of_long_texts_are_the_uncut_ones(monkeypatch):
    rng = np.random.default_rng(8)
    k = hidden_markov.STATES
    model = hidden_markov.first_guess(rng.random(hidden_markov.CLASSES))
    seq = rng.integers(0, hidden_markov.CLASSES, 6400).astype(np.uint16)
    at, train = np.array([0, 5, 2900, 2901, 3901, 6400]), np.array([1, 1, 1, 0, 1])

    def counts():
        out = [np.zeros(k), np.zeros((k, k)), np.zeros((k, hidden_markov.CLASSES))]
        starts, lengths, lead, own = hidden_markov._pieces(at, train)
        hidden_markov.expected(model, seq, starts, lengths, out, lead, own)
        return out

    monkeypatch.setattr(hidden_markov, "PIECE", 10_000)
    whole = counts()
    monkeypatch.setattr(hidden_markov, "PIECE", 200)
    cut = counts()
    assert np.isclose(cut[0].sum(), 4, atol=1e-4)  # a start a training text, not a piece
    assert np.isclose(cut[2].sum(), 5 + 2895 + 1 + 2499, rtol=1e-5) and np.isclose((cut[1] * model.move).sum(), cut[2].sum() - 4, rtol=1e-4)
    for a, b in zip(whole, cut):
        assert np.abs(a - b).max() <= 1e-4 * np.abs(a).max()


def test_hidden_markov_passes_see_every_block(spark, monkeypatch):
    seen, plain = [], hidden_markov.baum_welch

    def counted(model, coded):
        seen.append(coded.count())
        return plain(model, coded)

    monkeypatch.setattr(hidden_markov, "baum_welch", counted)
    table = spark.createDataFrame([(i, f"one two w{i % 9} end") for i in range(60)], "doc_id long, text string").repartition(12, "doc_id")
    blocks = table.select(F.spark_partition_id()).distinct().count()
    assert hidden_markov.score_texts(table, F.lit(True)).count() == 60
    assert blocks > 4 and seen == [blocks] * hidden_markov.PASSES


def test_embedding_join_is_the_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.12 * rng.normal(size=16)).tolist(), i % 3) for i in range(240)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [None] + [1.0] * 15, 1), (1003, [float("nan")] * 16, 1), (1004, rows[0][1], None), (1005, rows[0][1], 0), (1005, rows[0][1], 0), (1006, [1.0, 2.0], 0), (1007, [], 0)]
    got = sorted(embedding_join.embedding_links(spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, label int, cell int")).collect(), key=lambda r: r.vec_id)
    sound = [k for k, (_, v, lab) in enumerate(rows) if v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a, b in itertools.combinations(sound, 2):
        x, y = np.array(rows[a][1]), np.array(rows[b][1])
        if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.93:
            links[a].add(b)
            links[b].add(a)
    root = reach(links, len(rows))
    want = sorted((rows[k][0], len(links[k]), rows[root[k]][0]) for k in range(len(rows)))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert sum(len(v) for v in links.values()) > 100
    assert embedding_join.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embedding_join_keeps_radii_beside_many_small_labels(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "CELL", 16)
    monkeypatch.setattr(embedding_join, "ALL_PIVOTS", 64)
    rng = np.random.default_rng(14)
    hot = rng.normal(size=(400, 3))
    hot /= np.sqrt((hot * hot).sum(axis=1, keepdims=True))
    rows = [(i, x.tolist(), 5) for i, x in enumerate(hot)] + [(1000 + i, [1.0, float(i), 2.0], 100 + i) for i in range(3000)]
    got = {r.vec_id: r.n_links for r in embedding_join.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cosine=0.99).collect()}
    near = (hot @ hot.T >= 0.99).sum(axis=1) - 1
    assert near.sum() > 400
    assert got == {**{i: int(n) for i, n in enumerate(near)}, **{1000 + i: 0 for i in range(3000)}}


def test_embedding_join_leaves_far_rings_out(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "CELL", 100)
    monkeypatch.setattr(embedding_join, "BLOCK", 16)
    rng = np.random.default_rng(15)
    hot = rng.normal(size=(500, 3))
    rows = [(i, x.tolist(), 5) for i, x in enumerate(hot)]
    ring = [[math.cos(t), math.sin(t), 0.0] for t in np.linspace(0, 6, 60)]  # at one distance from the pole
    rows += [(1000 + i, [*x[:2], 3.0], 6) for i, x in enumerate(ring)] + [(2000, [0.0, 0.0, 1.0], 6)]
    seen, plain = [], embedding_join.ring_pairs

    def counted(cells, reach):
        out = plain(cells, reach)
        every = plain(cells, 9.0)
        seen.append(tuple(x.agg(F.sum(F.col("homes") * F.col("alls"))).first()[0] for x in (out, every)))
        assert all(r.i_blocks == 1 for r in out.collect() if r.homes <= 16)
        return out

    monkeypatch.setattr(embedding_join, "ring_pairs", counted)
    got = {r.vec_id: r.n_links for r in embedding_join.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cosine=0.99).collect()}
    want = {}
    for label in (5, 6):
        x = np.array([v for _, v, lab in rows if lab == label])
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        want.update(zip([i for i, _, lab in rows if lab == label], ((x @ x.T >= 0.99).sum(axis=1) - 1).tolist()))
    assert got == want
    assert seen[0][0] < 0.8 * seen[0][1]


def test_language_id_accuracy_and_rejection(spark, docs, nothing):
    rng = np.random.default_rng(9)
    sound = {"aa": "ka ta ra na ma".split(), "bb": "sch zug ber ung ein".split()}
    rows = [(i, " ".join("".join(rng.choice(sound[lang], 3)) for _ in range(15)), lang) for i in range(200) for lang in [("aa", "bb")[i % 2]]]
    table = spark.createDataFrame(rows + [(900, "kata", None), (901, None, "aa")], "doc_id long, text string, lang string")
    model = language_id.train(table.where(C.fold("doc_id", 3) != 1), "doc_id")
    got = {r.doc_id: r for r in language_id.predict(table, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and got[901].lang_pred == "und" and got[901].rejected
    odd = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all((odd[i].lang_pred == "und") == (i in (5, 6, 9)) and 0 <= odd[i].score <= 1 for i, _, _ in TEXTS)
    none = language_id.train(nothing, "doc_id")
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    kept = language_id.accepted(table, model)
    assert kept.columns == table.columns and kept.count() >= 200


def test_sums_over_slabs_are_the_whole(monkeypatch):
    import pyarrow as pa
    column = pa.array([BASE, "", "ab cd", BASE * 3])
    table = np.random.default_rng(1).normal(size=(language_id.BUCKETS, 2))
    whole = language_id._sums(*language_id._separated(column), table)
    monkeypatch.setattr(C, "SLAB_BYTES", 64)
    parts = language_id._sums(*language_id._separated(column), table)
    assert np.allclose(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_url_filter_rules_and_list(spark, monkeypatch):
    urls = ["http://WWW.Example.org/es/1?x", "https://m.example.org/en/12#t", "https://a.b.org/q", "http://x.com/fr/a", "x.com/de/1", "http://x.com/de/1", "http://x.com", None, "", "http://x.net/p/", "http://www.x.net/p#f", "http://x.net/pp", "http://org/", "http://xorg/a"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("x.net/p",), ("x.net/p",), (None,), ("x.com",), ("",)], "canonical string")
    for blocks in (64, 1 << 18):  # a filter far too small only sends more pages to the exact join
        monkeypatch.setattr(url_filter, "MAX_BLOCKS", blocks)
        got = {r.page_id: r for r in url_filter.filter_urls(pages, listed).collect()}
        verdicts = [got[i].verdict for i in range(len(urls))]
        assert verdicts == ["block", "block", "allow", "allow", "allow", "block", "block", "allow", "allow", "block", "block", "allow", "allow", "allow"]
        assert [got[i].rule for i in range(6)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", None, "com/de/"]
        assert (got[0].host, got[0].path, got[4].host, got[9].path) == ("www.example.org", "/es/1", "", "/p/")
    assert url_filter.filter_urls(pages, listed).count() == len(urls) + 1
    assert url_filter.filter_urls(pages.where("false"), listed).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages.where("page_id = 11"), listed.where("false")).collect()} == {"allow"}


def test_secret_spans_and_masks(spark, docs, nothing):
    own, wide = "Zx9" + "q7" * 10, "Wd1" + "k3" * 10
    texts = ['é token: "abc12345" x', "AKIA" + "A1" * 8, "0123456789abcdef01234567", "token:token:abcdefg", f"see {own} there", None, "password=short", 'API_KEY = 0123456789abcdef01234567 end']
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(20 + k, f"copy {wide} here", f"s{k}") for k in range(5)] + [(1, texts[1], "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.scan(table).collect()}
    value = re.compile(secrets.ASSIGN)
    for i, t, _ in rows:
        spans = [(m.start(), 0, "assign", m.end()) for m in value.finditer(t or "") if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t or "") if len(m[0]) >= 24]
        listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[1] == r for x in spans) for r in range(3))
    assert got[4].spans == f"owned:4:{4 + len(own)}" and got[20].spans == ""
    masked = {r.doc_id: r.text for r in secrets.redacted(table).collect()}
    assert masked[0] == "é [SECRET]\" x" and masked[4] == "see [SECRET] there" and masked[20] == rows[-6][1] and masked[5] is None and masked[7] == "[SECRET] end"
    assert secrets.redacted(docs).columns == docs.columns and secrets.scan(nothing).count() == 0
