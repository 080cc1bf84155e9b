import pytest

from crumbtrail.llm import pii

CASES = [
    ("Write to ana.keller+food@mail.example.org please", [("email", "ana.keller+food@mail.example.org")]),
    ("mail is tariq at quickpost dot example, thanks", [("email", "tariq at quickpost dot example")]),
    ("or otto [at] box.example for the photos", [("email", "otto [at] box.example")]),
    ("my cell is (412) 555-0143.", [("phone", "(412) 555-0143")]),
    ("Call +44 20 7946 0143 before noon", [("phone", "+44 20 7946 0143")]),
    ("Text 555-0143 to book", [("phone", "555-0143")]),
    ("Passport XK1234567 was at the bar", [("id_number", "XK1234567")]),
    ("My licence D123-4567-8901 fell down", [("id_number", "D123-4567-8901")]),
    ("I lost it, ID number 912-34-5678.", [("id_number", "912-34-5678")]),
    ("We live at 1491 Cinder Terrace, Apt 4 now", [("street_address", "1491 Cinder Terrace, Apt 4")]),
    ("Mail it to Unit 6, 22B old mill road please", [("street_address", "Unit 6, 22B old mill road")]),
    ("Ask for Greta P. Hollings, who kept our coats.", [("person_name", "Greta P. Hollings")]),
    ("we waited for Brandt, Tobias on payday", [("person_name", "Brandt, Tobias")]),
    ("Kudos, Priyanka!", [("person_name", "Priyanka")]),
    ("thanks to OSKAR FENWORTH for the soup", [("person_name", "OSKAR FENWORTH")]),
    ("Better than Oskar's Kitchen down the road.", []),
    ("Order #7877-61 took nine minutes, table 41, ticket 749211.", []),
    ("Open 11:30-2:30, closed on 05/11/2018, $91.42 plus 21%.", []),
    ("Booking code TX9277 did not scan. Batch 612-26 is hot.", []),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    got = pii.find(text, pii.train(), pii.known_words(pii.VOCABULARY))
    assert [(k, text[s:e]) for s, e, k in got] == want


# Names and sentences that training has not: its names are coined, and its sentences are others.
NAMES = """Brandon Whitlock|Siddharth Rao|Tyler Grant|Wei Zhang|Guadalupe|Karen O'Brien|Ana de la Cruz|John Smith|Susan Miller|Mike|Steve Rogers|Lisa Nguyen|Tom Baker|Fatou Diallo
Kwame Mensah|Hye-jin Park|Olumide Adeyemi|Mary Ann Fisher|J. Thompson|Robert L. Hayes|Chen, Li|Dwayne|Ingeborg Larsen|Marcus van Dyke|Shanice Williams|Pradeep|Yuki Tanaka|Carlos Mendoza
Ahmed El-Sayed|Dmitry Volkov|Zoe|Grace Hill|Mark Brown|Rosa Park|Hope|Will Turner|Jean-Luc Moreau|Aoife Murphy|Bjorn|Nana Osei""".replace("\n", "|").split("|")
WITH_NAMES = """On our second night {n} came over to check on us.|Please give {n} a raise, nobody else cared.|The highlight was chatting with {n} about wine.|Our sommelier {n} picked a lovely bottle.|Huge shoutout to {n} for fixing the order.
When I complained, {n} apologized right away.|My brother {n} proposed here last spring.|A gentleman named {n} held the door for us.|We owe this evening to {n} and the kitchen.|Manager {n} comped our desserts without being asked.|The hostess, {n}, found us a booth.
You can thank {n} for the five stars.|Even {n} behind the counter remembered our names.|Everyone should get served by {n} once.|I left my jacket and {n} mailed it back.|Best regards, {n}|Our bartender was {n} and he poured with a heavy hand.|Kids adored {n}, who folded napkins into swans.
Reservation is in the name of {n} for eight people.|Dad and {n} shared the ribs.|I called twice and spoke with {n} both times.|If you see {n}, order the special.|Many thanks {n}!|Server: {n}. Table was sticky though.|The new chef, {n}, has changed everything.|{n} deserves a bonus.|Hello {n}, your soup changed my life.
Hey {n}, save me a table.|A waitress called {n} spilled soup and laughed.|We were greeted by {n}, then forgotten.""".replace("\n", "|").split("|")
WITHOUT = """We parked behind the Marriott on Peachtree.|The Szechuan eggplant beats anything in Boston.|Closed on Mondays, open late on Fridays.|I prefer the Tacoma branch to the one in Spokane.|Their Caesar salad and Thai tea were fine.|Lola's Taqueria next door is louder.|Honestly the gnocchi tasted like glue.
Drove up from San Diego for the Garlic Festival.|Sunday brunch at the Blue Heron Cafe was packed.|NEVER AGAIN. The calamari was rubber.|Try the bibimbap or the pho.|Found it on Yelp and booked with OpenTable.|The view over Lake Michigan is worth it.|We had two Guinness and a flight of bourbon.
Order 8841 was wrong, table 12 was dirty.|Bottomless mimosas for $18 until 3pm.|Great falafel, decent hummus, sad tabbouleh.|The Halal cart on Fifth is faster.|Parking near Wrigley Field is a nightmare.|It reminds me of Little Italy in the nineties.""".replace("\n", "|").split("|")


# A second set, measured once and never looked at.
FRESH_NAMES = "Jerome Patterson|Lakshmi Iyer|Owen|Maria dos Santos|Natalie Portillo|Femi Adebayo|Hiroko Matsuda|Patrick O'Shea|Bill Cooper|Soo-yeon Kim|Anastasia|Raj Malhotra|Gabriela Fuentes|Erin K. Walsh|Tunde|Heather Stone|Viktor Petrov|Leila Hosseini".split("|")
FRESH = """It was {n} who talked us into the tasting menu.|My aunt brought {n} along for the birthday.|Kudos go to {n} at the front desk.|Nobody but {n} noticed the allergy.|The owner introduced himself as {n}.|Tell the cook that {n} sent you.
{n} made our anniversary unforgettable.|A busboy, {n}, mopped up without a fuss.|Cheers to {n} for staying late.|Ask whether {n} is working the patio.|Then {n} walked over with the bill.|Yours truly, {n}|We booked through {n} last week.|Dinner with {n} ended early.""".replace("\n", "|").split("|")


def held_out(names, sentences):
    """Of names and sentences that training never saw: cases found, cases, all found."""
    words, weights = pii.known_words(pii.VOCABULARY), pii.train()
    hit = wanted = given = 0
    for k, name in enumerate(names):
        for j, template in enumerate(sentences):
            text = WITHOUT[(k + j) % len(WITHOUT)] + " " + template.replace("{n}", name) + " " + WITHOUT[(k + 3 * j) % len(WITHOUT)]
            got = [text[s:e] for s, e, _ in pii.find(text, weights, words)]
            hit, wanted, given = hit + (name in got), wanted + 1, given + len(got)
    return hit, wanted, given


@pytest.mark.parametrize(("names", "sentences"), [(NAMES, WITH_NAMES), (FRESH_NAMES, FRESH)])
def test_held_out_names_and_sentences(names, sentences):
    hit, wanted, given = held_out(names, sentences)
    assert hit / wanted > 0.9 and hit / given > 0.9, (hit / wanted, hit / given)


def test_no_sentence_of_the_collection_is_in_the_templates(folder):
    import re

    import pyarrow.parquet as pq

    def runs(text, n=4):
        w = re.findall(r"[^\W_]+", text.lower())
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    own = {x for block in (pii._NAMES, pii._OTHERS, pii._NOTHING) for t in re.split(r"[|\n]", block) for part in re.split(r"\{\w+\}", t) for x in runs(part)}
    texts = pq.read_table(f"{folder}/reviews.parquet", columns=["review_text"])["review_text"].to_pylist()
    assert not own & {x for t in texts if t for x in runs(t)}


def test_decode_is_the_best_set():
    spans = [(0, 4, "a", ""), (2, 9, "b", ""), (4, 9, "c", ""), (9, 12, "d", "")]
    assert pii.decode(spans, [1.0, 2.5, 1.0, -1.0]) == [1]
    assert pii.decode(spans, [1.0, 1.5, 1.0, 0.5]) == [0, 2, 3]
    assert pii.decode([], []) == []
    assert abs(pii.marginals([(0, 1, "a", "")], [0.0])[0] - 0.5) < 1e-9


SCHEMA = "id long, text string, pii_text string, masked int"


def test_tables(spark):
    long = "x " * 400_000
    rows = [(1, "Call 555-0143 or 555-0143 now", "clash", 1), (1, "Call 555-0143 or 555-0143 now", "clash", 1), (2, None, None, None), (3, "", None, None), (None, "Call 555-0199", None, None), (4, long + "my cell is 555-0177.", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in pii.find_pii(df, "id", "text").collect()} == {(1, "phone", "555-0143"), (4, "phone", "555-0177")}
    masked = {r["id"]: r["masked"] for r in pii.mask_pii(df, "id", "text").collect()}
    assert masked[1] == "Call [PHONE] or [PHONE] now" and masked[2] is None and masked[3] == "" and masked[4] == long + "my cell is [PHONE]."
    assert pii.find_pii(spark.createDataFrame([], SCHEMA), "id", "text").count() == 0


PIECES = ["P123456", "P123456,", "K12L345M67", "AB-1234-C567", "12345678A", "kbrat at velford.test", "kbrat ( at ) velford.test", "KBRAT @ velford dot test", "+12345", "+1 23 45", "555-0143", "22B old mill road", "Unit 6, 22 Mill Road", "9 Mill\nRace Street., Apt 4"]
PIECES += ["j. Smith", "J. smith Brown", "É. Martin", "Tobias Brandt", "Brandt, Tobias", "İstanbul Oskar", "912-34-5678", "at noon.", "2 tacos", "look at it. Good"]


def test_all_that_a_form_proposes_is_decoded():
    import random

    words = pii.known_words(pii.VOCABULARY)
    filler = "we liked the soup and came again with all our friends but never had the bread "
    r = random.Random(5)
    texts = [left + x + right for x in PIECES for left in ("", filler * 3) for right in ("", " " + filler * 3)]
    texts += ["".join(r.choice(PIECES) + " " + filler[: r.randint(0, 60)] * r.choice([0, 1, 4]) + " " for _ in range(6)) for _ in range(300)]
    for text in texts:
        parts = pii.stretches(text)
        assert all(a[1] < b[0] for a, b in zip(parts, parts[1:]))
        assert pii._form_spans(text) == {x[:4] for x in pii.candidates(pii.Tokens(text, words), words) if x[4] < 0}, text


@pytest.mark.parametrize(("text", "names"), [
    ("Ask for Karen O'Brien.", ["Karen O'Brien"]), ("with Ana de la Cruz here", ["Ana de la Cruz", "Ana"]), ("Brandt, Tobias", ["Brandt", "Brandt, Tobias", "Tobias"]),
    ("É. Martin", ["É. Martin", "Martin"]), ("GRETA P. HOLLINGS", ["GRETA P. HOLLINGS"]), ("thanks to zoltan griverwick", ["zoltan griverwick"]),
])
def test_names_are_proposed_without_a_list(text, names):
    got = {text[s:e] for s, e, *_ in pii.name_spans(pii.Tokens(text, pii.known_words(pii.VOCABULARY)), pii.known_words(pii.VOCABULARY))}
    assert set(names) <= got


@pytest.mark.parametrize("case", ["P123456", "K12L345M67", "AB-1234-C567", "kbrat at velford.test"])
def test_cases_that_stand_alone_reach_the_field(case):
    text = "the soup was warm and the bread was good " * 4 + "it was " + case
    assert any(s <= text.index(case) and e >= len(text) for s, e in pii.stretches(text))


class _Unused:
    def __getattr__(self, name):
        raise AssertionError("a text is cut into tokens again")


def test_what_was_met_before_is_not_cut_again(monkeypatch):
    words, weights = pii.known_words(pii.VOCABULARY), pii.train()
    first = "The soup was warm. Kudos, Priyanka! We came again on payday."
    assert [first[s:e] for s, e, _ in pii.find(first, weights, words)] == ["Priyanka"]
    monkeypatch.setattr(pii, "_TOKEN", _Unused())
    other = "We came again on payday. The soup was warm.  Kudos, Priyanka!"
    assert [other[s:e] for s, e, _ in pii.find(other, weights, words)] == ["Priyanka"]


ODD = ["", " ", "  a  b ", "a\n\nb \n c\n", "\tTobias Brandt's  'soup'", "x" * 200 + " Tobias's", "the cook, J. P.O'Brien-Lee's", "İstanbul ǅ é. 3D B2B _x x_ ...", "THANKS TO OSKAR FENWORTH FOR THE SOUP WE HAD. Kudos, Priyanka!", "I I I I I I I met Greta"]


@pytest.mark.parametrize("most", [2, 50_000])
@pytest.mark.parametrize("text", [*ODD, *(t for t, _ in CASES)])
def test_tokens_and_sums_are_those_of_the_whole_text(text, most, monkeypatch):
    monkeypatch.setattr(pii._Made, "MOST", most)
    words, weights = pii.known_words(pii.VOCABULARY), pii.train()
    t = pii.Tokens(text, words)
    assert [(m.start(), m.end(), m.group().lower()) for m in pii._TOKEN.finditer(text)] == list(zip(t.starts, t.ends, t.low, strict=True))
    for _, _, pattern, k, j in pii.name_spans(t, words):
        assert weights.of_name(t, pattern, k, j) == pytest.approx(sum(weights.get(f, 0.0) for f in pii._name_features(t, pattern, k, j)), abs=1e-9)


def test_weights_can_be_sent_to_tasks():
    import pickle

    weights = pii.train()
    again = pickle.loads(pickle.dumps(weights))
    text, words = "Ask for Greta P. Hollings, who kept our coats.", pii.known_words(pii.VOCABULARY)
    assert again == weights and pii.find(text, again, words) == pii.find(text, weights, words)
