import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from crumbtrail.llm import grid_components, score_bands, term_counts, variant_names


def groups(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for s, a, b in pairs:
        x, y = sorted((root((s, a)), root((s, b))))
        up[y] = x
    return {(s, n, root((s, n))[1]) for s, n in up}


@pytest.mark.parametrize("cell_edges", [12, 200_000])
def test_components(spark, cell_edges):
    r = random.Random(1)
    chain = [(1, f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    star = [(2, "hub", f"s{i:03d}") for i in range(80)]
    noise = [(3, f"n{r.randint(0, 80)}", f"n{r.randint(0, 80)}") for _ in range(70)]
    rows = chain + star + noise + chain[:5] + [(s, b, a) for s, a, b in chain[:9]]
    r.shuffle(rows)
    dirt = [(1, None, "c000"), (1, "x", None), (None, "a", "b"), (1, "self", "self")]
    df = spark.createDataFrame([(*x, "clash", 5) for x in rows + dirt], "scope long, b string, a string, rep string, cell int")
    got = {tuple(x) for x in grid_components.components(df, "scope", "b", "a", cell_edges).collect()}
    assert got == groups([x for x in rows if x[1] != x[2]])


MATCH = "match_id long, business_id long, name_a string, name_b string, similarity double"


def test_matches(spark):
    rows = [(1, 1, " Pad\tThai", "phad thai", 0.87), (2, 1, "phad thai", "pad  thay", 0.9), (3, 1, "x", "y", 0.86), (4, 1, "x", "y", float("nan")), (5, 1, "x", "y", None), (6, 1, "x", " X", 0.99), (7, 1, "x", "", 0.99), (8, 2, "phad thai", "b", 1.0)]
    got = {tuple(x) for x in grid_components.matched_names(spark.createDataFrame(rows, MATCH)).collect()}
    assert got == {(1, n, "pad thai") for n in ("pad thai", "phad thai", "pad thay")} | {(2, "phad thai", "b"), (2, "b", "b")}
    assert grid_components.matched_names(spark.createDataFrame([], MATCH)).count() == 0


DISH = "id long, business_id long, positive_count long, mention_count long, rank_no long, _band int"


@pytest.mark.parametrize("shares", [(), (0.9, 0.6), (0.99, 0.5, 0.01)])
def test_bands(spark, shares):
    r = random.Random(2)
    rows = [(i, r.choice([1, 1, 1, 1, 2, 3, r.randint(4, 200)]), r.choice([None, 0, 0, 1, 1, 2, 9, r.randint(0, 50)]), r.choice([None, 0, 3]), 7, 1) for i in range(3000)]
    extra = [(9001, None, 5, 5, 1, 1), (None, 1, 5, 5, 1, 1)]
    want = defaultdict(list)
    for i, b, p, m, *_ in rows:
        want[b].append((-(p or 0), -(m or 0), i))
    want = {(b, x[2], k) for b, xs in want.items() for k, x in enumerate(sorted(xs)[:10], 1)}
    df = spark.createDataFrame(rows + rows[:50] + extra, DISH)
    got = [tuple(x) for x in score_bands.top_by_bands(df, "business_id", "id", ["positive_count", "mention_count"], 10, shares).collect()]
    assert len(got) == len(want) and set(got) == want


def test_bands_of_nothing_and_of_ties(spark):
    assert score_bands.top_by_bands(spark.createDataFrame([], DISH), "business_id", "id", ["positive_count"], 10).count() == 0
    df = spark.createDataFrame([(i, 1, 5, 5, 0, 0) for i in range(500)], DISH)
    assert sorted(r["id"] for r in score_bands.top_by_bands(df, "business_id", "id", ["positive_count", "mention_count"], 10).collect()) == list(range(10))


def counted(records):
    occurrences, mentions = Counter(), Counter()
    for tags in records.values():
        terms = [t for t in (" ".join(x.split()).lower() for x in tags or [] if x) if t]
        occurrences.update(terms)
        mentions.update(set(terms))
    return {t: (occurrences[t], mentions[t]) for t in occurrences}


def test_signed_changes(spark, tmp_path):
    r = random.Random(3)
    words = ["Hot", "hot ", " HOT\t", "mild", "rich  sauce", "", None, "  "]

    def tags():
        return r.choice([None, [], [r.choice(words) for _ in range(r.randint(1, 6))]])

    schema, state, path = "id long, tags array<string>, term string, records long", {}, str(tmp_path / "counts")
    for step in range(4):
        new = {i: tags() for i in r.sample(range(60), 25)}
        gone = [i for i in new if step and r.random() < 0.3]
        old = spark.createDataFrame([(i, t, "x", 1) for i, t in state.items()], schema) if state else None
        rows = [(i, t, "x", 1, i in gone) for i, t in new.items()]
        df = spark.createDataFrame(rows + rows[:3] + [(None, ["hot"], "x", 1, False)], schema + ", _deleted boolean")
        term_counts.merge_counts(spark, path, term_counts.signed_changes(old, df, "id", "tags"), step + 1, buckets=4)
        state = {i: t for i, t in (state | new).items() if i not in gone}
        assert {x["term"]: (x["occurrences"], x["records"]) for x in term_counts.read_counts(spark, path).collect()} == counted(state)


def test_marks(spark):
    counts = spark.createDataFrame([("a", 9, 2), ("b", 9, 3), ("c", 9, 10), ("d", 20, 11)], "term string, occurrences long, records long")
    got = {x["term"]: x["mark"] for x in term_counts.marked(counts, spark.createDataFrame([(100,)], "n long")).collect()}
    assert got == {"a": "rare", "b": None, "c": None, "d": "common"}


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = tmp_path / "counts"
    schema = "term string, occurrences long, records long"
    term_counts.merge_counts(spark, str(path), spark.createDataFrame([(f"t{i}", 2, 1) for i in range(50)], schema), 1)
    before = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    term_counts.merge_counts(spark, str(path), spark.createDataFrame([("t3", -2, -1)], schema), 2)
    after = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    assert len(before.items() - after.items()) == 1
    assert {x["term"] for x in term_counts.read_counts(spark, str(path)).collect()} == {f"t{i}" for i in range(50)} - {"t3"}


def test_a_delivery_counts_once(spark, tmp_path):
    import shutil

    path, schema = str(tmp_path / "counts"), "term string, occurrences long, records long"
    first, second = ([(f"t{i}", 2 * k, k) for i in range(40)] for k in (1, 3))
    term_counts.merge_counts(spark, path, spark.createDataFrame(first, schema), 1, buckets=4)
    shutil.copytree(path, tmp_path / "old")
    for delivery, rows in ((2, second), (2, second), (1, first)):
        term_counts.merge_counts(spark, path, spark.createDataFrame(rows, schema), delivery, buckets=4)
        assert {(x["occurrences"], x["records"]) for x in term_counts.read_counts(spark, path).collect()} == {(8, 4)}
    # A merge that broke off after some partitions is made good by merging again.
    for bucket in ("bucket=0", "bucket=2"):
        shutil.rmtree(f"{path}/{bucket}")
        shutil.copytree(tmp_path / "old" / bucket, f"{path}/{bucket}")
    term_counts.merge_counts(spark, path, spark.createDataFrame(second, schema), 2, buckets=4)
    assert {(x["occurrences"], x["records"]) for x in term_counts.read_counts(spark, path).collect()} == {(8, 4)}


def test_counts_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, tags array<string>")
    for n in range(2):
        term_counts.merge_counts(spark, str(tmp_path / "c"), term_counts.signed_changes(None, empty, "id", "tags"), n)
    assert term_counts.read_counts(spark, str(tmp_path / "c")).count() == 0


@pytest.mark.parametrize(("a", "b", "k", "want"), [("kitten", "sitting", 3, 3), ("abcd", "abdc", 2, 1), ("abc", "abc", 1, 0), ("abc", "xyz", 2, 3), ("", "ab", 3, 2), ("a", "abcdef", 2, 3)])
def test_distance(a, b, k, want):
    assert variant_names.distance(a, b, k) == want


def plain_distance(a, b):
    d = {(i, j): i + j if not i * j else 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_banded_distance_is_exact_within_the_band():
    r = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(2))
        k = r.randint(1, 4)
        assert variant_names.distance(a, b, k) == min(k + 1, plain_distance(a, b)), (a, b, k)


def test_canonical_forms():
    same = ["market plantain stew with miso gravy", "market-plantain stew w/ miso gravy", "the plantain stew (market) & miso gravy", "stew of market plantain with miso gravy", "stew, market plantain - miso gravy", "market plantain stews wyth miso gravy"]
    assert len({"".join(variant_names.canonical(n)[0]) for n in same}) == 1


NAMES = "business_id long, dish_name string, item long, words string"


def test_variants(spark):
    r = random.Random(5)
    heads, mains, forms = ["smoked", "golden", "crispy", "charred"], ["lobster", "chicken", "pumpkin", "oxtail", "rabbit"], ["noodles", "risotto", "casserole", "dumplings"]
    common = [(b, f"{r.choice(heads)} {r.choice(mains)} {r.choice(forms)}") for b in range(10, 60) for _ in range(30)]
    mine = ["golden lobster noodles", "golden lobstre noodles", "goldn lobster nodles", "gol den lobster noodles", "golden lbstr noods", "gln", "golden noodles", "Golden  Lobster Noodles", "golden chicken noodles", "charred rabbit risotto", "crr", "smoked rabbit risotto", None, " ", "!!!"]
    df = spark.createDataFrame([(b, n, 1, "x") for b, n in common + [(1, n) for n in mine * 2] + [(None, "x"), (2, "golden lobstre noodles")]], NAMES)
    got = variant_names.name_groups(df, "business_id", "dish_name").where("business_id = 1").collect()
    named = defaultdict(set)
    for x in got:
        named[x["item"]].add(x["name"])
    # "gln" and "golden noodles" fit lobster only; chicken noodles would be gcn, but "golden noodles" fits both, so it stays alone.
    want = [{"golden lobster noodles", "golden lobstre noodles", "goldn lobster nodles", "gol den lobster noodles", "golden lbstr noods", "gln"}, {"golden noodles"}, {"golden chicken noodles"}, {"charred rabbit risotto", "crr"}, {"smoked rabbit risotto"}, {"!!!"}]
    assert sorted(map(sorted, named.values())) == sorted(map(sorted, want))
    pairs = {(x["name_a"], x["name_b"]) for x in variant_names.name_pairs(variant_names.name_groups(df, "business_id", "dish_name"), "business_id").collect() if x["business_id"] == 1}
    assert pairs == {(a, b) for g in want for a in g for b in g if a < b}


def test_join_finds_what_comparing_all_pairs_finds(spark):
    r = random.Random(6)
    vocabulary = ["smoked", "golden", "lobster", "chicken", "pumpkin", "noodle", "risotto", "casserole", "truffle", "saffron", "butter", "pickled"]
    rows = {}

    def misspelt(w):
        at = r.randrange(1, len(w))
        return r.choice([w[:at] + r.choice("aeiouxyz") + w[at:], w[: at - 1] + w[at:], w[: at - 1] + w[at] + w[at - 1] + w[at + 1 :], w[:3], w[0] + "".join(c for c in w[1:] if c not in "aeiou")])

    for _ in range(140):
        words = [r.choice(vocabulary) for _ in range(r.randint(2, 5))]
        rows[tuple(words)] = [500] * len(words)
        for n in (1, 2, 3):
            wrong, at = list(words), r.sample(range(len(words)), min(n, len(words)))
            for k in at:
                wrong[k] = misspelt(wrong[k])
            rows[tuple(wrong)] = [2 if w not in vocabulary else 500 for w in wrong]
    table = [(1, k, list(w), f, [i for i, x in enumerate(f) if x < 50], [x for x, y in zip(w, f) if y >= 50]) for k, (w, f) in enumerate(rows.items())]
    df = spark.createDataFrame(table, "scope long, item long, words array<string>, freqs array<long>, rare array<int>, common array<string>")
    got = {(x["probe"], x["item"]): x["cost"] for x in variant_names.near_items(df).collect()}
    want = {}
    for _, p, wa, fa, rare, _ in table:
        for _, i, wb, fb, _, _ in table:
            if rare and p != i and (c := variant_names.name_cost(wa, fa, wb, fb)) is not None:
                a, b = "".join(wa), "".join(wb)
                k = variant_names._k(len(b))
                # What the operator states: few edits (a swap counts twice here), or at most two rare words.
                if len(rare) <= 2 and len(wa) == len(wb) and sum(x != y for x, y in zip(wa, wb)) <= len(rare) and all(wa[n] == wb[n] for n in range(len(wa)) if n not in rare) or levenshtein(a, b) <= k:
                    want[p, i] = c
    assert len(want) > 200 and want.items() <= got.items()
    assert all(variant_names.name_cost(*[x for p, i in [pair] for x in (table[p][2], table[p][3], table[i][2], table[i][3])]) == c for pair, c in got.items())


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
    return row[-1]


def test_no_names(spark):
    assert variant_names.name_groups(spark.createDataFrame([], NAMES), "business_id", "dish_name").count() == 0
    assert re.fullmatch(r"[a-z]+", "".join(variant_names.canonical("x" * 5000)[0]))


def test_a_mention_delivered_twice_counts_once(spark):
    # The spelling with more mentions stands for the dish; the second one's rows are one mention delivered three times.
    rows = [(1, 1, "zarzuela"), (2, 1, "zarzuela"), (3, 1, "zarzuella"), (3, 1, "zarzuella"), (3, 1, "zarzuella"), (None, 1, "zarzuella"), (None, 1, "zarzuella")]
    df = spark.createDataFrame(rows, "id long, business_id long, dish_name string")

    def means(**how):
        got = {r["name"]: r["item"] for r in variant_names.name_groups(df, "business_id", "dish_name", **how).collect()}
        assert got["zarzuela"] == got["zarzuella"]
        return got["zarzuela"]

    assert means(record_id="id") == variant_names_item(spark, "zarzuela") and means() == variant_names_item(spark, "zarzuella")


def variant_names_item(spark, compact):
    return spark.range(1).select(F.xxhash64(F.lit(1).cast("long"), F.lit(compact))).first()[0]


def test_rare_words_are_spellings_whatever_their_frequencies(spark):
    rows = [(1, "zarzuela"), (1, "zarzuela"), (1, "zarzuela with rice"), (1, "zarzeula"), (2, "old cachupa"), (2, "old cachupa"), (2, "old cachuppa"), (3, "zarzeula")]
    df = spark.createDataFrame(rows, "business_id long, dish_name string")
    pairs = {tuple(x) for x in variant_names.name_pairs(variant_names.name_groups(df, "business_id", "dish_name"), "business_id").collect()}
    assert pairs == {(1, "zarzeula", "zarzuela"), (2, "old cachupa", "old cachuppa")}
    assert variant_names.word_cost("grilled", 30, "drilled", 40, 20) is None and variant_names.word_cost("zarzuela", 2, "zarzeula", 1, 3) == 1
