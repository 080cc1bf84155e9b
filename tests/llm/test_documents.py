import random
import re
from collections import defaultdict

import pytest

from crumbtrail.llm import leakage, mixing, spam_pages

DOC = "doc_id long, text string, term string, pos int, class long, source string"
ITEM = "item_id long, passage string, df int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2, "s") for i, t in rows], DOC)


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute_runs(rows, items, least):
    out = set()
    grams = defaultdict(set)
    for i, p in items:
        w = words(p)
        for k in range(len(w) - least + 1):
            grams[tuple(w[k : k + least])].add(i)
    for d, t in rows:
        w = words(t)
        for k in range(len(w) - least + 1):
            out |= {(d, i) for i in grams[tuple(w[k : k + least])]}
    return out


def leak_case(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "of"] * 10
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 50)))) for i in range(12)]
    rows = []
    for d in range(60):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if r.random() < 0.6:
            p = words(r.choice(items)[1])
            a = r.randrange(len(p))
            w[len(w) // 2 : len(w) // 2] = p[a : a + r.randint(4, 30)]
        rows.append((d, r.choice([" ", ", ", "\n"]).join(w).upper()))
    return rows + [(100, None), (101, ""), (102, rows[0][1])], items


@pytest.mark.parametrize(("seed", "letters", "block"), [(1, 3_000_000, 200_000), (2, 100, 60)])
def test_phrases(spark, monkeypatch, seed, letters, block):
    monkeypatch.setattr(leakage, "SEGMENT_LETTERS", letters)
    monkeypatch.setattr(leakage, "BLOCK_WORDS", block)
    rows, items = leak_case(seed)
    index = leakage.build_index(docs(spark, [*rows, (None, rows[0][1])]), "doc_id", "text")
    terms = leakage.passage_terms(spark.createDataFrame([(i, p, 1) for i, p in items], ITEM), index, "item_id", "passage")
    runs = leakage.phrase_matches(index, terms, 6).collect()
    assert {(x["doc_id"], x["item_id"]) for x in runs} == brute_runs(rows, items, 6)
    text, passage = dict(rows), dict(items)
    for x in runs:
        assert words(text[x["doc_id"]])[x["pos"] : x["pos"] + x["n_words"]] == words(passage[x["item_id"]])[x["ppos"] : x["ppos"] + x["n_words"]]


def test_proximity_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SEGMENT_LETTERS", 200)
    rows, items = leak_case(7)
    index = leakage.build_index(docs(spark, rows), "doc_id", "text")
    terms = leakage.passage_terms(spark.createDataFrame([(i, p, 1) for i, p in items], ITEM), index, "item_id", "passage")
    got = {tuple(x) for x in leakage.proximity_matches(index, terms, 3, 12).collect()}
    df = defaultdict(int)
    for _, t in rows:
        for w in words(t):
            df[w] += 1
    want = set()
    for i, p in items:
        rare = sorted({w for w in words(p) if df[w]}, key=lambda w: (df[w], w))[:3]
        for d, t in rows:
            at = [[k for k, w in enumerate(words(t)) if w == x] for x in rare]
            if len(rare) == 3 and all(at):
                span = min(max(x, y, z) - min(x, y, z) + 1 for x in at[0] for y in at[1] for z in at[2])
                if span <= 12:
                    want.add((d, i, span))
    assert got == want and want


def test_proximity(spark):
    rows = [(1, "rare1 x x rare2 y rare3"), (2, "rare3 rare1 " + "x " * 50 + "rare2"), (3, "x y x y"), (4, "rare2 rare1 rare3")]
    index = leakage.build_index(docs(spark, rows), "doc_id", "text")
    terms = leakage.passage_terms(spark.createDataFrame([(7, "x rare1 y rare2 x rare3", 1), (8, "absent", 1)], ITEM), index, "item_id", "passage")
    got = {tuple(x) for x in leakage.proximity_matches(index, terms, 3, 10).collect()}
    assert got == {(1, 7, 6), (4, 7, 3)}


def test_no_documents_no_items(spark):
    index = leakage.build_index(docs(spark, []), "doc_id", "text")
    terms = leakage.passage_terms(spark.createDataFrame([(1, "a b c", 1)], ITEM), index, "item_id", "passage")
    assert leakage.phrase_matches(index, terms, 2).count() == 0
    full = leakage.build_index(docs(spark, [(1, "a b c")]), "doc_id", "text")
    assert leakage.phrase_matches(full, leakage.passage_terms(spark.createDataFrame([], ITEM), full, "item_id", "passage"), 2).count() == 0


COUNTED, TARGET = "doc_id long, source string, n_tokens long", "source string, target_share double, max_repeats int"


def quota(shares, caps, seats):
    out = dict.fromkeys(shares, 0)
    for _ in range(seats):
        open_ = [s for s in shares if out[s] < caps[s]]
        if not open_:
            break
        out[min(open_, key=lambda s: (-shares[s] / (2 * out[s] + 1), s))] += 1
    return out


def test_apportionment(spark):
    r = random.Random(1)
    shares = {f"s{k}": r.random() for k in range(7)}
    caps = {s: r.choice([0, 3, 40, 200]) for s in shares}
    claims = spark.createDataFrame([(0, s, w, caps[s], 150) for s, w in shares.items()], "_all int, name string, weight double, cap long, seats long")
    got = {x["name"]: x["quota"] for x in mixing._seats(claims, ["_all"], "weight", "cap", "seats").collect()}
    assert got == {s: n for s, n in quota(shares, caps, 150).items() if n}


def test_mixture(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["big"] * 8 + ["mid", "mid", "small"]), r.randint(50, 150)) for i in range(3000)] + [(5000, None, 90), (5001, "big", 0), (5002, "unwanted", 80)]
    targets = spark.createDataFrame([(" BIG", 0.4, 1), ("mid", 0.35, 2), ("small", 0.2, 3), ("absent", 0.05, 9), ("broken", None, 1)], TARGET)
    counted = spark.createDataFrame(rows, COUNTED)
    for total in (40_000, None):
        mixed = mixing.mixture(counted, targets, total, blocks=200)
        got = mixed.collect()
        assert len({x["doc_id"] for x in got}) == len(got)
        assert all(x["copies"] <= {"big": 1, "mid": 2, "small": 3}[x["source"]] for x in got)
        if total:
            size = sum(x["n_tokens"] * x["copies"] for x in got)
            assert abs(size / total - 1) < 0.1
            for s, want in (("big", 0.4 / 0.95), ("mid", 0.35 / 0.95), ("small", 0.2 / 0.95)):
                assert abs(sum(x["n_tokens"] * x["copies"] for x in got if x["source"] == s) / size - want) < 0.04
        report = {x["source"]: x for x in mixing.reached_shares(counted, targets, mixed).collect()}
        assert report["absent"]["tokens"] == 0 and abs(sum(x["actual_share"] for x in report.values()) - 1) < 1e-9
    again = {tuple(x) for x in mixing.mixture(counted, targets, 40_000, blocks=200).collect()}
    assert again == {tuple(x) for x in mixing.mixture(counted, targets, 40_000, blocks=200).collect()}
    assert 0 < mixing.reachable_total(counted, targets) <= sum(x[2] for x in rows) * 3


def test_mixture_is_whole_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TEXTS", 60)
    r = random.Random(3)
    rows = [(i, "small" if i % 20 == 0 else "big", r.randint(50, 150)) for i in range(3000)]
    have = {s: sum(x[2] for x in rows if x[1] == s) for s in ("big", "small")}
    counted = spark.createDataFrame(rows, COUNTED)
    targets = spark.createDataFrame([("big", 0.6, 2), ("small", 0.4, 3)], TARGET)
    for total, want in ((None, {"small": 3 * have["small"]}), (3 * 2 * have["small"], {"small": 0.4 * 6 * have["small"]})):
        got = mixing.mixture(counted, targets, total, blocks=200).collect()
        assert len({x["doc_id"] for x in got}) == len(got) and all(x["copies"] <= {"big": 2, "small": 3}[x["source"]] for x in got)
        tokens = {s: sum(x["n_tokens"] * x["copies"] for x in got if x["source"] == s) for s in have}
        wish = total or sum(have.values())
        assert abs(sum(tokens.values()) / wish - 1) < 0.01
        assert abs(tokens["small"] / want["small"] - 1) < 0.02


def test_offsets_over_spans_of_shards(spark):
    r = random.Random(4)
    rows = [(s, k, r.randint(1, 9)) for s in "ab" for k in range(50) if r.random() < 0.8]
    want = {(s, k): sum(h for t, j, h in rows if t == s and j < k) for s, k, _ in rows}
    for span in (1, 7, 100):
        got = mixing._ahead(spark.createDataFrame(rows, "source string, shard long, held long"), span).collect()
        assert {(x["source"], x["shard"]): x["ahead"] for x in got} == want


def test_shards_far_smaller_than_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TEXTS", 3)
    r = random.Random(9)
    rows = [(i, f"s{i % 5}", r.randint(50, 150)) for i in range(2000)]
    shares = {"s0": 0.5, "s1": 0.2, "s2": 0.15, "s3": 0.1, "s4": 0.05}
    counted = spark.createDataFrame(rows, COUNTED)
    targets = spark.createDataFrame([(s, w, 3) for s, w in shares.items()], TARGET)
    held = sum(x[2] for x in rows)
    block = -(-held // 32)
    takes = {x["source"]: x for x in mixing.quotas(counted, targets, held, 32).collect()}
    assert {s: x["quota"] for s, x in takes.items()} == quota(shares, dict.fromkeys(shares, 99), 32)
    got = mixing.mixture(counted, targets, held, 32).collect()
    tokens = {s: sum(x["n_tokens"] * x["copies"] for x in got if x["source"] == s) for s in shares}
    assert abs(sum(tokens.values()) - held) <= 5 * block
    assert all(0 <= tokens[s] - takes[s]["take"] < 150 for s in shares)


def test_tokens(spark):
    rows = [(1, "Hello  World", " Web\tA", 1), (1, "Hello  World", " Web\tA", 1), (2, None, None, 1), (3, "", "b", 1), (None, "x", "b", 1), (4, "a" * 200_000, "b", 1)]
    got = {x["doc_id"]: (x["source"], x["n_tokens"]) for x in mixing.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int"), "doc_id", "text", "source").collect()}
    assert got[1] == ("web a", 3) and got[2] == (None, 0) and got[3] == ("b", 0) and got[4][1] > 0


def test_mixture_of_nothing(spark):
    empty, targets = spark.createDataFrame([], COUNTED), spark.createDataFrame([("a", 1.0, 1)], TARGET)
    assert mixing.mixture(empty, targets).count() == 0
    assert [x["actual_share"] for x in mixing.reached_shares(empty, targets, mixing.mixture(empty, targets)).collect()] == [0.0]
    assert mixing.reachable_total(empty, targets) == 0


def collection(r):
    subjects, verbs, things = ["the cook", "our waiter", "my sister", "a neighbour"], ["likes", "carried", "forgot", "praised"], ["the soup", "a warm loaf", "some rice", "the old table"]

    def sentence():
        return f"{r.choice(subjects)} {r.choice(verbs)} {r.choice(things)} and {r.choice(verbs)} {r.choice(things)}.".capitalize()

    good = [" ".join(sentence() for _ in range(r.randint(4, 9))) + r.choice(["", " See http://site.example/a", " #soup #rice"]) for _ in range(120)]
    spam = [" ".join(r.choice(["best soup", "cheap soup", "soup near me", "order soup online"]) for _ in range(40)), "\n".join(f"http://x{r.randint(0, 10**6)}.example/{r.randint(0, 999)}-{r.choice('abcdef')}" for _ in range(25)), " ".join(f"#tag{r.randint(0, 10**6)}" for _ in range(40)), sentence() + "\n" + " > ".join(r.choice(["Home", "Menu", "Deals", "Order"]) for _ in range(50))]
    return good, spam


def test_spam_pages(spark):
    good, spam = collection(random.Random(1))
    rows = list(enumerate(good + spam)) + [(900, good[0]), (901, spam[0]), (0, good[0]), (902, None), (903, ""), (None, spam[1]), (904, "\n \n")]
    scores = spam_pages.page_scores(docs(spark, rows), "doc_id", "text")
    got = {x["doc_id"] for x in spam_pages.spam_pages(scores).collect()}
    assert got == {len(good) + k for k in range(len(spam))} | {901}
    ids = [x["doc_id"] for x in scores.collect()]
    assert sorted(ids) == sorted(set(ids)) and not {902, 903, 904} & set(ids)


def brute_scores(pages):
    """mean_pmi and spam_share of each page by counting everything again for each."""
    import math
    from collections import Counter

    token = re.compile(r"[^\W_]+|_+|(?:[^\w\s])+")
    cut = []
    for text in pages:
        segments, at = [], 0
        for m in [*spam_pages.END.finditer(text), None]:
            part = text[at : m.end() if m else len(text)]
            words = token.findall(part)
            if words:
                segments.append((list(zip(["\n", *words], words)), bool(m and m[1]), len(part)))
            at = m.end() if m else len(text)
        cut.append(segments)
    counts = [Counter(p for s in segments for p in s[0]) for segments in cut]
    c = sum(counts, Counter())
    df, total = Counter(p for x in counts for p in x), sum(c.values())
    c1, c2 = Counter(), Counter()
    for (a, b), n in c.items():
        c1[a] += n
        c2[b] += n
    out = []
    for segments, own in zip(cut, counts):
        spam = chars = top = low = 0
        for pairs, ended, n in segments:
            value = weight = 0
            for p in pairs:
                w, others, rate = len(p[0]) + len(p[1]), c[p] - own[p], c[p] / len(pages)
                x = max(spam_pages.LOW, min(spam_pages.HIGH, math.log(others * total / (c1[p[0]] * c2[p[1]])))) if others else spam_pages.LOW
                top, low = top + w * x, low + w
                stuffed = others and own[p] >= spam_pages.REPEATS and (c[p] / df[p] / (rate / (1 - math.exp(-rate))) >= spam_pages.BUNCHING or own[p] >= spam_pages.PAGE_SHARE * own.total())
                value, weight = value + w * (spam_pages.LOW if stuffed else x), weight + w
            spam += n * (value / weight < (spam_pages.SENTENCE_MEAN if ended else spam_pages.OTHER_MEAN))
            chars += n
        out.append((top / low, spam / chars))
    return out


@pytest.mark.parametrize("letters", [10, 6_000_000])
def test_scores_against_brute_force(spark, monkeypatch, letters):
    monkeypatch.setattr(spam_pages, "BATCH_LETTERS", letters)
    good, spam = collection(random.Random(5))
    pages = sorted({t.lower() for t in good[:40] + spam + ["a b", "a b c.\nd _ e", "c a b!"]})
    got = {x["doc_id"]: (x["mean_pmi"], x["spam_share"]) for x in spam_pages.page_scores(docs(spark, list(enumerate(pages))), "doc_id", "text").collect()}
    for k, want in enumerate(brute_scores(pages)):
        assert got[k] == pytest.approx(want, abs=1e-9)


def test_long_page_and_no_pages(spark):
    good, _ = collection(random.Random(2))
    rows = [*enumerate(good), (500, "buy " * 300_000)]
    assert 500 in {x["doc_id"] for x in spam_pages.spam_pages(spam_pages.page_scores(docs(spark, rows), "doc_id", "text")).collect()}
    assert spam_pages.page_scores(docs(spark, []), "doc_id", "text").count() == 0
