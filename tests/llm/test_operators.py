"""Each operator on small tables with every edge, and against brute force."""

import hashlib
import random

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as driver
from lexweave.llm import exact, graph, html, jaccard, language, pieces, quality, rules, substrings
from lexweave.llm.words import WordReader

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark, rows):
    """Documents with columns whose names the operators use inside."""
    df = spark.createDataFrame(
        [(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    return df.withColumns({n: F.lit(1) for n in ("id", "h", "a", "size", "score", "ids", "words", "kept", "keep_id")})


def corpus(seed=3, n=60):
    """Random texts with copies, near copies, shared passages, blanks and short ones."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    passage = [draw.choice(words) for _ in range(30)]
    rows = []
    for i in range(n):
        kind = draw.randrange(6)
        text = [draw.choice(words) for _ in range(draw.randrange(80))]
        if rows and kind == 0:
            text = draw.choice(rows)[1].split(" ")
        elif rows and kind < 3:
            text = draw.choice(rows)[1].split(" ")
            for _ in range(draw.randrange(4)):
                text[draw.randrange(len(text))] = draw.choice(words)
        elif kind == 3:
            at = draw.randrange(len(text) + 1)
            text[at:at] = passage[draw.randrange(10) :]
        rows.append((i * 7 % 61, draw.choice([" ", " ", "\n", "\t "]).join(text)))
    return rows


EDGES = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "One"), (1005, "x " * 3000), (1006, "x " * 3000)]


@pytest.mark.parametrize("seed", [3, 4])
def test_substrings_match_brute_force(spark, seed):
    rows = corpus(seed) + EDGES
    got = substrings.remove_repeats(documents(spark, rows).repartition(5)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(brute.repeats(rows))
    texts = dict(rows)
    for r in got:
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
        for start, n, source, place in r["factors"]:
            mine, theirs = texts[r["doc_id"]].split(), texts[source].split()
            assert source < r["doc_id"] and mine[start : start + n] == theirs[place : place + n]


def test_substrings_of_rows_without_or_with_equal_ids(spark):
    long = " ".join(map(str, range(20)))
    got = substrings.remove_repeats(documents(spark, [(5, long), (5, long), (None, long), (5, "a " + long)])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("5", 0), ("5", 0), ("5", 0), ("None", 20)]
    assert substrings.remove_repeats(documents(spark, [])).collect() == []


def test_different_texts_without_ids_keep_their_words(spark):
    draw = random.Random(8)
    own = lambda name: " ".join(f"{name}{draw.randrange(10**6)}" for _ in range(21))
    shared = own("s")
    twice = own("t") + " " + shared
    spaced = [tuple(r) for r in substrings.remove_repeats(documents(spark, [(1, shared), (5, twice), (5, twice.replace(" ", "  "))])).select("doc_id", "n_removed").collect()]
    assert sorted(spaced) == [(1, 0), (5, 21), (5, 21)]
    rows = [(1, shared), (None, own("a") + " " + shared)] + [(None, own(f"n{k}")) for k in range(40)]
    got = substrings.remove_repeats(documents(spark, rows).repartition(4)).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in got) == [(21, 0)] * 41 + [(42, 21)]


@pytest.mark.parametrize("seed", [5, 6])
def test_similar_documents_match_brute_force(spark, seed):
    rows = corpus(seed) + EDGES
    got = jaccard.similar_documents(documents(spark, rows).repartition(4))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == sorted(brute.similar(rows))


def test_similar_documents_edges(spark):
    got = jaccard.similar_documents(documents(spark, [(None, "a b c d e f"), (4, "A b c d e f"), (4, "A b c d e f"), (9, "")]))
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got.collect()) == [
        ("4", 2, 4), ("4", 2, 4), ("9", 0, 9), ("None", 2, 4),
    ]
    assert jaccard.similar_documents(documents(spark, [])).collect() == []


def test_rows_without_or_with_one_id_are_told_apart(spark):
    text = lambda name, end: " ".join(f"{name}{k}" for k in range(60)) + end
    a, b = text("a", ""), text("b", "")
    rows = [(4, a), (None, a + " x"), (None, b), (7, b + " y"), (9, text("c", "")), (None, text("d", "")), (None, text("d", " z")), (5, text("e", "")), (5, text("f", ""))]
    got = jaccard.similar_documents(documents(spark, rows).repartition(3))
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["n_links"]) for r in got.collect()) == sorted([
        ("4", "4", 1), ("None", "4", 1), ("None", "7", 1), ("7", "7", 1), ("9", "9", 0), ("None", "None", 1), ("None", "None", 1), ("5", "5", 0), ("5", "5", 0),
    ])
    kept = sorted((str(r["doc_id"]), r["text"][:2]) for r in jaccard.one_of_each(documents(spark, rows)).collect())
    assert kept == [("4", "a0"), ("5", "e0"), ("5", "f0"), ("7", "b0"), ("9", "c0"), ("None", "d0")]


def test_one_document_of_each_component_stays(spark):
    base = " ".join(map(str, range(100)))
    df = documents(spark, [(3, base), (2, base + " x"), (8, "other words that are not there"), (9, None)])
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(df).collect()) == [2, 8, 9]
    assert jaccard.one_of_each(df).columns == df.columns


def test_equal_sets_need_a_common_part():
    """Any two sets that can link share a signature, whatever parts are empty."""
    draw = np.random.default_rng(2)
    for n in [2, 4, 5, 6, 8, 12, 30, 70, 200]:
        for _ in range(60):
            base = draw.choice(np.arange(1, 10**6, dtype=np.uint64), n * 2, replace=False)
            cut = draw.integers(0, n // 4 + 1)
            one, two = base[:n], np.concatenate((base[cut:n], base[n : n + draw.integers(0, n // 4 + 1)]))
            both = len(np.intersect1d(one, two))
            if 100 * both < 80 * (len(one) + len(two) - both):
                continue
            sets = jaccard.Sets(np.concatenate((np.sort(one), np.sort(two))), np.array([0, len(one), len(one) + len(two)]))
            sign, text = jaccard.part_signatures(sets)
            assert set(sign[text == 0].tolist()) & set(sign[text == 1].tolist()) or set(one) == set(two)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS_AT_ONCE", 7)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    monkeypatch.setattr(jaccard, "TRIED", 1)
    draw = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(50):
        text = list(base)
        text[draw.randrange(60)] = f"x{draw.randrange(9)}"
        rows.append((i, " ".join(text)))
    got = jaccard.similar_documents(documents(spark, rows))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == sorted(brute.similar(rows))


def near_copies(n):
    """Texts of 60 words of which most pairs differ in a few, a chain, and copies."""
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base[:5] + [f"x{i % 40}"] + base[6:])) for i in range(n)]
    return rows + [(1000 + i, " ".join(f"c{k}" for k in range(3 * i, 3 * i + 60))) for i in range(30)] + [(2000, "alone " * 9)]


def test_all_links_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS_AT_ONCE", 16)
    rows = near_copies(90)
    classes = {}
    for i, t in rows:
        classes.setdefault(frozenset(brute.shingles(t)), i)
    want = {
        (max(i, j), min(i, j)) for s, i in classes.items() for r, j in classes.items()
        if i < j and 100 * len(s & r) >= 80 * len(s | r)
    }
    assert len(want) > 700
    found = jaccard._linked(documents(spark, rows).repartition(3), "doc_id", "text", jaccard.SHINGLE, jaccard.SIMILARITY)
    monkeypatch.setattr(jaccard, "_linked", lambda *_: found)
    got = jaccard.similar_documents(documents(spark, rows)).collect()
    assert all(r["n_links"] == sum(r["class_id"] in p for p in want) for r in got)
    pairs = [tuple(r) for r in jaccard.similar_pairs(documents(spark, rows)).collect()]
    assert len(pairs) == len(want) and set(pairs) == want


def test_groups_of_the_same_sets_are_compared_once(spark):
    """A passage of many texts makes many groups; their pairs are one group's pairs."""
    rows = [(h, i) for h in range(50) for i in range(20)] + [(100, 1), (100, 30), (101, 0), (101, 5)]
    groups = spark.createDataFrame([(h, i, i) for h, i in rows], "h long, id long, other long")
    label = spark.createDataFrame([(0, 0), (5, 0)], "id long, component long")
    got = [tuple(r) for r in jaccard._open_groups(groups, label).collect()]
    assert len(got) <= 23 and len(set(got)) == len(got) and all(c == (0 if i == 5 else i) for _, i, c in got)
    found = [{i for h, i, _ in got if h == g} for g in {h for h, _, _ in got}]
    assert any(set(range(20)) <= f for f in found) and any({1, 30} <= f for f in found)
    assert jaccard._open_groups(groups.where("h = 101"), label).collect() == []


def test_texts_with_a_common_passage_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS_AT_ONCE", 16)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    monkeypatch.setattr(jaccard, "TRIED", 1)
    draw = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, passage + " " + " ".join(f"w{draw.randrange(20)}" for _ in range(draw.choice([4, 8, 30])))) for i in range(120)]
    got = jaccard.similar_documents(documents(spark, rows))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == sorted(brute.similar(rows))


@pytest.mark.parametrize("few", [0, 3, 100])
def test_shared_counts(monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "COLUMNS_AT_ONCE", 5)
    draw = np.random.default_rng(few)
    sets = [np.unique(draw.integers(0, 40, draw.integers(1, 30))).astype(np.uint64) for _ in range(30)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (jaccard.shared_counts(sets, None) == np.triu(want, 1)).all()
    assert (jaccard.shared_counts(sets[:11], sets[11:]) == want[:11, 11:]).all()


def test_components(spark):
    draw = random.Random(4)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "x long, y long")).collect()}
    least = {i: i for link in links for i in link}
    for _ in range(200):
        for x, y in links:
            least[x] = least[y] = min(least[x], least[y])
    assert got == {i: c for i, c in least.items() if any(i in link and link[0] != link[1] for link in links)}


@pytest.mark.parametrize("first", [0, 1, 90])
def test_components_after_more_links(spark, first):
    draw = random.Random(first)
    links = [(draw.randrange(150), draw.randrange(150)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(20)]
    draw.shuffle(links)
    frame = lambda some: spark.createDataFrame(some, "x long, y long")
    label = graph.components(frame(links[:first]))
    got = sorted(tuple(r) for r in graph.components_after(label, frame(links[first:])).collect())
    assert got == sorted(tuple(r) for r in graph.components(frame(links)).collect())


def test_words_and_runs():
    texts = ["", "a  b\tc", "B", " \n", "x a b c y"]
    data = "".join(texts).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    words = WordReader(fold_case=True)(np.frombuffer(data, np.uint8), offsets)
    assert words.counts.tolist() == [0, 3, 1, 0, 5]
    assert words.hashes[1] == words.hashes[3] == words.hashes[6]
    runs, fits = words.runs(3, 1)
    assert fits.tolist() == [True, False, False, False, True, True, True, False, False]
    assert runs[0] == runs[5] and runs[0] != runs[4]


def test_exact_groups(spark):
    rows = [(3, "a"), (9, "a"), (4, None), (5, ""), (7, "A"), (7, "A"), (None, "a")]
    got = exact.exact_groups(documents(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in got) == [
        ("3", 9, 3, False), ("4", 5, 2, False), ("5", 5, 2, True), ("7", 7, 2, True), ("7", 7, 2, True),
        ("9", 9, 3, True), ("None", 9, 3, False),
    ]
    assert {r["text_sha256"] for r in got if r["doc_id"] in (4, 5)} == {hashlib.sha256(b"").hexdigest()}
    assert sorted(r["doc_id"] for r in exact.drop_copies(documents(spark, rows)).collect()) == [5, 7, 9]
    assert exact.exact_groups(documents(spark, []), keep="min").collect() == []


def test_kept_rows_are_one_for_each_text(spark):
    rows = [(7, "A"), (7, "B"), (9, "B"), (None, "C"), (None, "C"), (None, "D"), (8, "A"), (8, "E"), (8, "E")]
    got = exact.drop_copies(documents(spark, rows).repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == [("8", "A"), ("8", "E"), ("9", "B"), ("None", "C"), ("None", "D")]


def test_rules(spark):
    clean = "The house and the garden are in the old town. " * 2 + "It is a view of the sea for all who want it and more."
    rows = [(1, clean), (2, None), (3, "word " * 60), (4, " ".join(f"w{i}$$$" for i in range(30))), (None, "few words")]
    got = {str(r["doc_id"]): r for r in rules.judge(documents(spark, rows)).collect()}
    assert got["4"]["failed_rules"] == ["symbols"] and not got["4"]["base_failed"] and not got["4"]["kept"]
    assert got["3"]["n_repeat_words"] == 60 and got["3"]["base_failed"]
    assert got["2"]["n_words"] == 0 and got["2"]["base_failed"] and got["None"]["base_failed"]
    assert rules.judge(documents(spark, [])).collect() == []


def test_rules_stay_in_the_jvm(spark, plan):
    for df in (rules.judge(documents(spark, [])), exact.exact_groups(documents(spark, []))):
        assert not any(word in plan(df) for word in ("Python", "Pandas", "Arrow"))


def test_language_on_edges(spark):
    rows = [(i, t, n) for i, (t, n) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de")] * 5)]
    rows += [(90, None, "en"), (91, "", "en"), (92, "12 34 !", None), (None, "the sea and the house", None), (94, "der see " * 9000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("body", F.lit(0))
    got = {str(r["doc_id"]): (r["lang_pred"], r["score"]) for r in language.predict(df, language.learn(df)).collect()}
    assert [got[str(k)][0] for k in (0, 1, 90, 91, 92, None, 94)] == ["en", "de", "und", "und", "und", "en", "de"]
    assert got["92"][1] == 0 and 0 < got["0"][1] <= 1
    none = language.predict(df, language.learn(df.limit(0))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_rank_distance_by_hand():
    profiles = language.Profiles({"x": [5, 6, 7], "y": [7, 5]}, 3)
    assert profiles.distances(np.array([6, 5, 9])).tolist() == [1 + 1 + 3, 3 + 0 + 3]


def test_learnt_models_on_held_out_rows(spark):
    found = {n: f(spark, "/root/testdata/sf0.01").toPandas() for n, f in driver.queries().items() if n[:3] in ("op3", "op9")}
    read = spark.read.parquet
    marks = found["op3_quality_classifier"].merge(read("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    marks = marks[marks.held_out]
    assert (marks.predicted == marks.quality).mean() > 0.93 and marks[marks.quality == 1].predicted.mean() > 0.97
    langs = found["op9_language_id"].merge(read("/root/testdata/sf0.01/documents.parquet").toPandas(), on="doc_id")
    langs = langs[langs.held_out]
    assert (langs.lang == langs.lang_pred).mean() > 0.98


def test_network_reads_whole_texts(spark):
    net = quality.ByteNet(quality.NetConfig())
    long = "ab cd " * 400_000
    one = net.scores(__import__("pyarrow").array([long, None, "", "x"]))
    seen = net.responses(*quality.blocked(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]), 8))[0]
    assert one[0] == pytest.approx(float(net.combined(seen.max(axis=0, keepdims=True))[0]), abs=1e-5)
    assert one[1] == one[2] and ((0 <= one) & (one <= 1)).all()
    assert quality.learn(documents(spark, [(1, "a")]), spark.createDataFrame([(1, 1)], "doc_id long, quality int")) is None
    assert quality.score(documents(spark, [(1, None)]), None).first()["score"] == 0.5


def test_gradients_match_differences():
    cfg = quality.NetConfig(stride=2, width=3, filters=4)
    net = quality.ByteNet(cfg)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    texts, labels = [b"abcdefg", b"xyz", b""], np.array([1.0, 0.0, 1.0])
    data = np.frombuffer(b"".join(texts), np.uint8)
    blocks, first = quality.blocked(data, np.array([0, 7, 10, 10]), 2)

    def loss():
        p = net.combined(net.pooled(blocks, first))
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    for name, grad in net.gradients(blocks, first, labels).items():
        flat = net.weights[name].reshape(-1)
        for k in np.argsort(-np.abs(grad).reshape(-1))[:3]:
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert (up - down) / 2e-5 == pytest.approx(grad.reshape(-1)[k], rel=2e-2, abs=1e-6)


def test_pieces_equal_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    draw = random.Random(1)
    texts = ["".join(draw.choice("aeth in▁  \n\t.,é日ß😀théxq<0x0A>") for _ in range(draw.randrange(50))) for _ in range(400)]
    texts += ["", "ab" * 300, "e" * 20_000, " " * 70, "  lead and trail  "]
    rows = documents(spark, [*enumerate(texts), (None, None)])
    got = {r["doc_id"]: r for r in pieces.encode(rows, PIECES).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == model.encode(t), t
        assert got[i]["round_trip"] == ("▁" not in t)
    assert got[None]["ids"] == [] and got[None]["round_trip"]
    back = pieces.decode(pieces.encode(rows, PIECES), PIECES).where("doc_id = 404").first()["text"]
    assert back == "  lead and trail  "
    assert pieces.encode(documents(spark, []), PIECES).collect() == []


def test_viterbi_finds_the_best_sum():
    table = pieces.Pieces(PIECES, "unigram")
    words = ["▁ther", "▁hous", "banan", "▁é日a▁"]

    def best(word):
        if not word:
            return 0.0
        options = [best(word[:-1]) + table.worst] if word[-1] not in table.by_text else []
        options += [best(word[:-k]) + table.by_text[word[-k:]][0] for k in range(1, len(word) + 1) if word[-k:] in table.by_text]
        return max(options)

    text_of = {i: t for t, (_, i) in table.by_text.items()}
    for word, ids in zip(words, pieces.viterbi(words, table)):
        total = sum(table.by_text[text_of[i]][0] for i in np.frombuffer(ids, "<i4").tolist() if i in text_of)
        unknown = sum(c not in table.by_text for c in word)
        assert total + unknown * table.worst == pytest.approx(best(word))


PAGES = [
    ("<p>One<p>Two <b>bold</b>  text<br>next", "One\n\nTwo bold text\nnext"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>", "- a\n- b\n  3. c\n  4. d\n- e"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>x<td>22</table>", "Name       N\nlong name  1\nx          22"),
    ("<div hidden>no</div><p style='display:none'>no</p><p style='visibility:hidden'>no<b style='visibility:visible'>yes</b></p>", "yes"),
    ("<script>if (a</p>b) {}</script><style>p{}</style>a &amp; b<!-- c --> d", "a & b d"),
    ("<pre>  two\n    four</pre>after", "  two\n    four\n\nafter"),
    ("<html><head><title>T</title><body><h1>Head</h1>text</body></html>", "Head\n\ntext"),
    ("<table><tr><td colspan=2>wide cell over both<tr><td>a<td>b<tr><td rowspan=2>c<td>d<tr><td>e</table>",
     "wide cell over both\na  b\nc  d\n   e"),
    ("a<div>b<div>c</div></div>d", "a\nb\nc\nd"),
    ("x < y <5 and </nope> <b", "x < y <5 and"),
    ("", ""), (None, ""),
]


@pytest.mark.parametrize("source, text", PAGES)
def test_pages(source, text):
    assert html.render(source) == text


@pytest.mark.parametrize("source, text", [
    ("<table><tr><form action=x><td>a<td>b</form></table>", "a  b"),
    ("<form><table><form><tr><td>a</table>b</form>c", "a\n\nb\nc"),
    ("x<table><tr>loose<td>a</table>", "xloose\n\na"),
    ("<table><tbody><p>loose<tr><td>a</table>z", "loose\n\na\n\nz"),
    ("<table><tr hidden>loose<td>a</table>z", "loose\n\nz"),
    ("<table><tr><a href=x>link<td>a</a><td>b</table>", "link\n\na  b"),
    ("<table><tr><center>mid<td>a</center><td>b<tr><td>c</table>", "mid\n\na  b\nc"),
    ("<table><colgroup><col><tr><td>a</table>", "a"),
    ("<table><caption>cap<tr><td>a</table>", "cap\na"),
    ("<table><tr><td>a<tr><table><tr><td>b</table>", "a\n\nb"),
    ("<table><tr><td>a<table><tr><td>b</table>c<td>d</table>", "a  d\n\nb\n\nc"),
    ('<p class="a"">Hello "x" y</p>', 'Hello "x" y'),
    ("<a title=don't>it's</a> so", "it's so"),
    ("<p a='1>2' b=\"3>4\">text", "text"),
    ('<a href=a="b>c">d', 'c">d'),
    ('<a =">x">y', 'x">y'),
    ("<p title = '>' hidden>gone</p>here", "here"),
    ('<p title="open>text', "text"),
    ("<img alt=a><br/>z", "a\nz"),
])
def test_pages_of_odd_tables_and_quotes(source, text):
    assert html.render(source) == text


def test_pages_of_a_table(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    rows = [(1, "u", "<title>A  b</title><p>x"), (None, None, None), (3, "u", deep), (3, "u", deep), (4, "", "<p>" + "y " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("source", F.lit(1))
    got = sorted(html.extract(df).collect(), key=lambda r: r["page_id"] or 0)
    assert [(r["title"], r["n_lines"], len(r["text"])) for r in got] == [
        (None, 0, 0), ("A b", 1, 1), (None, 1, 4), (None, 1, 4), (None, 1, 99_999),
    ]
    assert html.extract(df.limit(0)).collect() == []


def test_registered_queries_match_brute_force(spark):
    queries = driver.queries()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries["op10_substring_dedup"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(brute.repeats(rows))
    got = queries["op2_jaccard_join"](spark, SF).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute.similar(rows))


def test_pipeline(spark):
    import corpus_pipeline

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash"))
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF)
        seen.append(spark.createDataFrame(out.collect(), out.schema))
    kept, unique, apart, mixed, coded = ([r.asDict() for r in df.collect()] for df in seen[1:])
    assert all(df.columns == corpus_pipeline.COLUMNS for df in seen[1:5])
    best = {}
    for r in kept:
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in unique) == sorted(best.values())
    linked = brute.similar([(r["doc_id"], r["text"]) for r in unique])
    assert sorted(r["doc_id"] for r in apart) == sorted({c for _, _, c in linked})
    sizes = {r["doc_id"]: len(brute.WORD.findall(r["text"])) for r in apart}
    taken = {r["doc_id"]: len(brute.WORD.findall(r["text"])) for r in mixed}
    assert all(0 < n <= 2 * sizes[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.05 * sum(sizes.values())
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert len(coded) == len(mixed) and all(r["ids"] == model.encode(texts[r["doc_id"]]) and r["round_trip"] for r in coded)


def test_pipeline_over_no_documents(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
