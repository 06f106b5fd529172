import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import languages as L, pairs, personal as P, personal_examples as X, scanned as S, transcripts
from parley.session import cut

NAMES = P.Gazetteer({"marta": "given", "june": "given", "will": "given", "rose": "given", "jamal": "given", "ingrid": "given", "anna": "given", "peter": "given", "luis": "given", "carla": "given", "rahul": "given", "sofia": "given", "henri": "given", "okafor": "family", "lindqvist": "family", "duarte": "family", "tomas": "given", "priya": "given", "veiltez": "family", "nevik": "family", "sharma": "family", "keller": "family", "moreau": "family"})

# Sentences of no pattern to which the model is fitted.
HELD_OUT = (
    "For the minutes: {name} was present.", "My boss {name} wants a copy.", "There is a note from {name} in the file.", "Somebody called {name} picked up.", "I handed the keys to {name} on Friday.", "{name} agreed to the terms.", "Yours sincerely, {name}", "Is {name} available?",
    "Use {email} from now on.", "The receipt was sent to {email} twice.", "Anything for me goes to {email}.", "Her mail address is {email}.", "Just call {phone} and leave a message.", "You may reach my wife on {phone}.", "My phone, {phone}, is off at night.", "Text the code to {phone}.",
    "The passport shows {id}.", "I have the identity number {id} here.", "Her social security number was {id}.", "We now live at {address}.", "The parcel went to {address}.", "Our house at {address} is for sale.", "Ich spreche mit {name}.", "Meine Adresse lautet {address}.", "Je vis au {address}.", "Hablo con {name} de la oficina.", "Falei com {name} da agência.",
)
HELD_OUT_PLAIN = (
    "We are short of staff in {town} until {month}.", "The {plan} was launched on {date}.", "{firm} has a new office.", "A sum of {amount} will be paid on {date}.", "Please send form {form} by {date}.", "Complaint {ref} has been logged.", "Your parcel {longref} is on its way.", "He will be here at {time}.", "We grew by {pct} in {year}.",
    "The road was closed for two days.", "I bought it for {amount} from {firm}.", "Die Rechnung vom {date} ist offen.", "Le contrat {ref} est signé.", "El contrato {ref} está firmado.", "The last four are {four}.", "It rained in {town} at {time}.", "Nobody answered the letter.", "That would be all, goodbye.",
)


@pytest.fixture(scope="module")
def names(spark, small):
    return P.gazetteer(spark.read.parquet(f"{small}/known_names.parquet")) | NAMES


@pytest.fixture(scope="module")
def reader(names):
    return P.Reader(P.fit_model(names))


def _redacted(reader, text):
    return P.redact(text, P.entities([text], reader)[0])


def test_sentences_of_other_patterns(reader, names):
    rows = X.rows(names, 1500, seed=77, labelled=HELD_OUT, plain=HELD_OUT_PLAIN)
    found = P.entities([t for t, _ in rows], reader)
    right = sum(len(set(f) & set(g)) for f, (_, g) in zip(found, rows))
    assert right / sum(len(g) for _, g in rows) > 0.9
    assert right / sum(map(len, found)) > 0.9
    assert not {X.SLOT.sub("", p) for p in (*HELD_OUT, *HELD_OUT_PLAIN)} & {X.SLOT.sub("", p) for p in (*X.LABELLED, *X.PLAIN)}


@pytest.mark.parametrize(
    "text, want",
    [
        ("reach me on one two three four five six eight nine", "reach me on [PHONE]"), ("ring four four five one two eight six six one", "ring [PHONE]"), ("I moved to 14 Oak Crescent, Leeds last year.", "I moved to [ADDRESS] last year."), ("write to 1600 Amphitheatre Parkway, Mountain View", "write to [ADDRESS]"),
        ("My IBAN is DE89 3704 0044 0532 0130 00, please note it.", "My IBAN is [ID_NUMBER], please note it."), ("my passport number is C01X00T47", "my passport number is [ID_NUMBER]"), ("call 555-2368 after six", "call [PHONE] after six"), ("please ask for jamal at the desk", "please ask for [NAME] at the desk"),
        ("Call me back on +44 7700 900321 tonight.", "Call me back on [PHONE] tonight."), ("The account holder is Marta Veiltez, I think.", "The account holder is [NAME], I think."), ("You can write to marta dot veiltez at halden dot com any time.", "You can write to [EMAIL] any time."),
        ("Will the June statement show the Rose series too?", None), ("The card ending 4471 was lost.", None), ("The mail is already [EMAIL].", None), ("Let me check ticket TKT-425329 for you.", None), ("We took the main road to the branch.", None), ("The road to maturity is long.", None), ("", None), (None, None),
        ("We live at Leimfield Road now.", "We live at [ADDRESS] now."), ("We live at twenty four Leimfield Road now.", "We live at [ADDRESS] now."), ("आप ०७७०० १२३४५६ पर कॉल कीजिए।", "आप [PHONE] पर कॉल कीजिए।"),
    ],
)
def test_redaction(reader, text, want):
    assert _redacted(reader, text) == (text if want is None else want)


def test_redaction_keeps_blanks_and_long_texts(reader):
    text = "  Call  me  back on 07700 900123   after work. " + "Nothing here. " * 40_000 + "Is that Marta Veiltez on the line?"
    assert _redacted(reader, text) == text.replace("07700 900123", "[PHONE]").replace("Marta Veiltez", "[NAME]")
    assert _redacted(reader, "x" * 500_000) == "x" * 500_000


def test_best_segmentation_is_that_of_all_segmentations(reader):
    """The dynamic program against trying every way to cut a short text."""
    text = "Mr. Keller, 0770 900 12 or mail k@b.de"
    tokens = P._TOKEN.findall(text)
    scored = {}
    for kind in range(len(P.TYPES)):
        for a, b, s in reader.spans(text, kind):
            scored[a, b, kind] = s

    def best(at):
        if at == len(tokens):
            return 0.0
        return max([best(at + 1), *[s + best(b) for (a, b, _), s in scored.items() if a == at]])

    chosen = reader.read_spans(text)
    assert abs(sum(scored[c] for c in chosen) - best(0)) < 1e-3


def test_personal_tables(spark, reader):
    model = reader.model
    df = spark.createDataFrame([(1, "Is that Marta Veiltez on the line?", None, 5), (2, None, "", 5)], "id long, raw_text string, translated_text string, field int")
    assert [(r.id, r.field, r.pii_type) for r in P.found(df, model).collect()] == [(1, "raw_text", "name")]
    rows = {r.id: r for r in P.redacted(df, model).collect()}
    assert rows[1].raw_text == "Is that [NAME] on the line?" and rows[2].raw_text is None and rows[2].translated_text == ""
    assert P.found(df.limit(0), model).count() == 0
    many = spark.createDataFrame([(k, "Many common words and Names", None) for k in range(5)], "id long, raw_text string, translated_text string")
    assert P.common_words(many) == {"common", "words", "and"} and P.common_words(many.limit(0)) == frozenset()


@pytest.fixture(scope="module")
def language_model(spark, small):
    return L.fit_model(spark.read.parquet(f"{small}/transcript_turns.parquet"))


def test_words_are_read_whole(language_model):
    word = "x" * 45
    assert (language_model.word(word + "y" * 10) < language_model.word(word + "y") - 1).all()
    assert (language_model.word(word + "the") != language_model.word(word + "und")).any()
    assert np.isfinite(language_model.word("donaudampfschiff" * 400)).all()


def test_scaled_sums_are_those_of_all_segmentations(language_model):
    def brute(marked, k):
        if not marked:
            return 1.0
        return sum(brute(marked[n:], k) * language_model.table.get(marked[:n], language_model.floor)[k] for n in range(1, len(marked) + 1) if n == 1 or marked[:n] in L.pieces(language_model.path))

    for word in ("the", "konto", "banco", "wxyzzt", "contrato"):
        assert np.allclose(language_model.word(word), [math.log(brute("▁" + word, k)) for k in range(6)])
    assert L.longest_piece(language_model.path) == max(map(len, L.pieces(language_model.path)))


@pytest.mark.parametrize("text", ["Sziasztok, szeretném tudni, mikor érkezik meg a pénzem.", "Добрый день, я хочу узнать о моём счёте.", "こんにちは、口座について知りたいです。", "Dzień dobry, chciałbym wiedzieć kiedy przyjdzie przelew."])
def test_other_languages(language_model, text):
    assert [s[0] for s in L.segments(text, language_model)] == ["other"]


def test_confidence_means_something(spark, small, language_model):
    """Of the sentences of texts with a label, those given with more confidence agree with it at least as often."""
    rows = [(r.lang, s) for r in spark.read.parquet(f"{small}/transcript_turns.parquet").selectExpr("lower(substr(metadata['lang'], 1, 2)) AS lang", "raw_text").where("lang in ('en', 'de', 'fr', 'es', 'pt', 'hi')").collect() for s in L.segments(r.raw_text, language_model)]
    sure = [lang == s[0] for lang, s in rows if s[1] >= 0.99]
    unsure = [lang == s[0] for lang, s in rows if s[1] < 0.99]
    assert len(sure) > 100 and sum(sure) / len(sure) > 0.8
    assert not unsure or sum(sure) / len(sure) >= sum(unsure) / len(unsure) - 0.05


@pytest.mark.parametrize("text, langs", [("Könnten Sie mir das noch einmal erklären?", ["de"]), ("Kya aap mujhe yeh samjha sakte hain?", ["hi"]), ("क्या आप मुझे बता सकते हैं?", ["hi"]), ("The charge was applied because the mandate had expired. Mein Mann sagt, der Schutz endet mit dem Kredit.", ["en", "de"]), ("[noise] Um.", []), ("", []), (None, [])])


def test_languages(language_model, text, langs):
    got = L.segments(text, language_model)
    assert [g[0] for g in got] == langs and all(0 < g[1] <= 1 for g in got)


def test_language_accuracy_on_labels(spark, small, language_model):
    df = L.with_languages(spark.read.parquet(f"{small}/transcript_turns.parquet"), language_model).where(L.normal_label(F.col("label")) != "").where(F.size("segments") == 1)
    n, right = df.count(), df.where(F.col("segments")[0]["lang"] == L.normal_label(F.col("label"))).count()
    assert right / n > 0.85


def test_language_cases(spark, language_model):
    rows = [(1, "Could you explain the tax once more?", "", {"lang": "en-IN"}), (2, "Could you explain the tax once more?", None, {"lang": "de"}), (3, "Could you explain the tax once more?", None, None), (4, None, None, {})]
    df = spark.createDataFrame(rows, "id long, raw_text string, translated_text string, metadata map<string,string>")
    assert sorted((r.id, r.field, r.lang) for r in L.found(df, language_model).collect()) == [(2, "raw_text", "en"), (3, "raw_text", "en")]
    assert L.found(df.limit(0), language_model).count() == 0


def test_empty_training(spark):
    assert L.fit_model(spark.createDataFrame([], "id long, raw_text string, metadata map<string,string>")).table == {}


PAIRS = [
    ("What does it cost?", None, "empty"), ("What does it cost?", " \n", "empty"), ("What does it cost?", "N/A", "empty"), ("What does it cost?", "[PRODUCT:]", "empty"), ("What does it cost to miss a payment?", "You asked: what does it cost to miss a payment?", "copy"),
    ("What does it cost?", "I'm sorry, but I can't help with that request.", "refusal"), ("What does it cost?", "NOTE: i cannot provide information on this topic.", "refusal"), ("Was kostet das?", "Es tut mir leid, dabei kann ich nicht helfen.", "refusal"),
    ("What does it cost?", "A missed payment costs 5 USD and is (", "truncated"), ("What does it cost?", "A missed payment costs", "truncated"), ("What does it cost to miss a payment?", "Sie brauchen das Formular und den letzten Auszug.", "wrong_language"),
    ("Is it open?", "Yes, it is.", None), ("¿Sigue abierto?", "Sí, lo está.", None), ("What does it cost?", "I'm sorry for the delay. It costs 5 USD. Papers:\n- KYC (2)", None), ("How is it taxed?", "No, the return depends on the market, so I cannot promise it.", None), (None, "It costs 5 USD.", None),
]


def test_pair_defects(spark):
    df = spark.createDataFrame([(k, q, a, "rag_answer") for k, (q, a, _) in enumerate(PAIRS)] + [(99, "q", None, "context_only"), (100, "q", None, None)], "state_id long, question string, answer string, route string")
    got = {r.state_id: r.defect for r in pairs.found(df).collect()}
    assert got == {k: d for k, (_, _, d) in enumerate(PAIRS) if d}
    assert pairs.found(df.limit(0)).count() == 0


HEAD = "INTERNAL - Greil Trust"
BODY = ["The service centre will archive every rebate that is older.", "Please release the certificate only after the monthly rider has cleared."]


def scans(spark):
    rows = []
    for k, word in enumerate("amber birch cedar delta ember fjord grove heron inlet jetty kiosk ledge".split()):
        text = f"{HEAD}\n\n- {k + 1} -\nThe service centre will archive every rebate of every {word} that is\nolder. The first certificate number {k} is released after the lock-in.\n\nThe offer runs until May for the service of the office."
        rows.append((f"c{k}", "d", text, k + 1, k + 1))
    rows[0] = ("c0", "d", f"{HEAD.replace('Trust', 'Trusf')}   1\nThe ser-\nvice centre is here.", 1, 1)
    rows[1] = ("c1", "d", "The lock-\nin of the offlce ends. The offcr runs until May.", 2, 2)
    rows += [("n", None, None, None, None), ("e", "x", "", 0, 0), rows[3]]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, page_start int, page_end int")


def test_defects_are_made_once(spark):
    """The plan tests each answer once, in generated rows that no filter is pushed below."""
    df = spark.createDataFrame([(1, "rag_answer", "What is it?", "It is so.")], "state_id long, route string, question string, answer string")
    plan = pairs.found(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") <= 2 * len(pairs.FUNCTION_WORDS) + 2


def test_scanned(spark):
    done = S.repair(scans(spark), cut)
    got = {(r.chunk_id, r.kind) for r in S.found(done).collect()}
    assert {("c0", "hyphen"), ("c0", "header"), ("c0", "page_number"), ("c1", "chars"), ("c5", "header"), ("c5", "page_number")} <= got
    assert not {("c1", "hyphen"), ("c1", "header"), ("c5", "chars"), ("c5", "hyphen")} & got
    text = {r.chunk_id: r.text for r in S.repaired_text(done).collect()}
    assert text["c0"] == "The service centre is here."
    assert text["c1"] == "The lock-in of the office ends. The offer runs until May."
    assert text["c5"].startswith("The service centre will archive every rebate of every fjord that is older.") and HEAD not in text["c5"]


def test_misread_words_are_put_right_once_and_by_context(spark):
    """A form that what comes out for another word looks like is left alone; of two frequent forms of one skeleton the one that follows the word before is chosen."""
    rows = [(f"c{k}", "d", f"we met the clerk in the room and saw a modem device on page {k}.", 0, 0) for k in range(12)] + [(f"d{k}", "d", f"this is the modern house of number {k}.", 0, 0) for k in range(12)]
    rows += [("x", "d", "this is the m0dem house. we saw a m0dem device.", 0, 0), ("y", "d", None, 0, 0)]
    done = S.repair(spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, page_start int, page_end int"), cut)
    fixed = {r.chunk_id: r.text for r in S.repaired_text(done).collect()}
    assert fixed["c3"] == "we met the clerk in the room and saw a modem device on page 3." and fixed["d4"] == "this is the modern house of number 4."
    assert fixed["x"].count("m0dem") == 0 and "y" not in fixed


def test_scanned_empty(spark):
    done = S.repair(scans(spark).limit(0), cut)
    assert S.found(done).count() == 0 and S.repaired_text(done).count() == 0


def test_scanned_many_headers(spark):
    names = "Amber Birch Cedar Delta Ember Fjord Grove Heron".split()
    rows = [(f"c{k:02d}", "d", None, f"Chapter Of {names[k // 5]} Matters\n\nThe service centre number {k} is open.", k + 1, k + 1) for k in range(40)]
    rows += [(f"n{k}", None, "m" if k < 2 else f"m{k}", f"{'Minor Plan Notes' if k < 2 else 'Text'}\n\nThe offer number {k} ends.", k + 1, k + 1) for k in range(20)]
    done = S.repair(spark.createDataFrame(rows, "chunk_id string, doc_id string, document_id string, text string, page_start int, page_end int"), cut)
    assert {r.chunk_id for r in S.found(done).where("kind = 'header'").collect()} == {f"c{k:02d}" for k in range(40)} | {"n0", "n1"}


def test_sentences_of_the_same_words_are_judged_once(language_model, monkeypatch):
    """Names and numbers do not matter, so that the work does not grow with them."""
    judged, best = [], L.PieceModel.best
    monkeypatch.setattr(L.PieceModel, "best", lambda model, words: judged.append(words) or best(model, words))
    memo = {}
    texts = [f"Please move {n} euros from the {name} saver into something safer." for n, name in ((11, "Lugaula"), (2750, "Bera"), (90, "Trefor"))]
    assert [L.segments(t, language_model, memo) for t in texts] == [L.segments(t, language_model) for t in texts]
    assert len(judged) == 1 + len(texts)


def test_words_and_labels_are_found_as_by_plain_patterns():
    r = random.Random(4)
    for _ in range(4000):
        text = "".join(r.choice("aBé नि'_9३@[].,: -–(>\n" + "bot  ") for _ in range(r.randint(0, 24)))
        plain = re.sub(r"\S*@\S*|\S*\d\S*|\[\w+\]", " ", text) if re.search("[@[0-9]", text) else text
        found = [w for w in L._OTHER_OR_WORD.findall(text) if w] if L._MAY_HOLD_OTHER.search(text) else L._WORD.findall(text)
        assert found == L._WORD.findall(plain), text
        assert transcripts._LABEL_SIGN.search(text) or not transcripts._LABEL.search(text), text
    for label in ("[Agent]:", "(customer)", "<v Ann>", "{agent}", "Agent: ", "agent:", "agent >>", "Ann Lee >>", "Agent - ", "</v>"):
        assert transcripts._LABEL.search(label + "x" * label.endswith(" ")) and transcripts._LABEL_SIGN.search(label), label
