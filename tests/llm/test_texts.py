import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest

from millrace.llm import language as G
from millrace.llm import ocr as O
from millrace.llm import pairs as P

Q = "How long may fish stock stay in the cold store?"
GOOD = "Keep fish stock below 4 °C and use it within two days of opening."


@pytest.fixture(scope="module")
def ends():
    corpus = [GOOD, "Wash hands for 17 seconds before using the slicing machine.", "Tell the cook when the cold store smells of bleach."] * 20
    total: dict = {}
    for piece in P.end_counts(iter(corpus), piece=100):
        for r, e, m in zip(*(x.tolist() for x in piece)):
            before = total.get(r, (0, 0))
            total[r] = before[0] + e, before[1] + m
    return total


CASES = [
    (None, Q, True, "empty"), ("", Q, True, "empty"), ("​\n", Q, None, "empty"), ("N/A", Q, True, "empty"), ("[no answer]", Q, True, "empty"), ("**", Q, True, "empty"), ("—", Q, True, "empty"),
    ("I'm sorry, but I can't help with that request.", Q, True, "refusal"), ("Désolé, ce sujet dépasse mon rôle. Essayez plus tard.", Q, None, "refusal"), ("I'm sorry, but I can't help with that request.", Q, False, None), ("Leider liegt mir hierzu nichts vor", Q, False, None),
    ("Sorry for the wait. " + GOOD, Q, True, None),
    (Q, Q, True, "copies_query"), ("how  long may fish stock stay in the cold store", Q, True, "copies_query"), (f"You asked: {Q}", Q, True, "copies_query"), (f"{Q}\n{Q}", Q, True, "copies_query"), ("How long may fish stock stay in cold store?", Q, True, "copies_query"), (f"{Q} {GOOD}", Q, True, None),
    ("Guarde el caldo de pescado por debajo de 4 °C y deseche lo que sobre después de dos días.", Q, True, "other_language"), ("يجب حفظ السمك تحت 4 درجات مئوية والتخلص من الباقي بعد يومين.", Q, True, "other_language"), (GOOD, "¿Cuánto tiempo puede estar el caldo en la cámara fría?", True, "other_language"),
    (GOOD, Q, True, None), ("4 °C", Q, True, None), ("15 %", Q, True, None), ("35 min", Q, True, None), ("Keep fish stock below", Q, True, "truncated"), ("Keep fish stock below 4 °C and use it wi", Q, True, "truncated"), (GOOD + " Wash hands for,", Q, True, "truncated"), (GOOD + " Tell the cook…", Q, True, "truncated"), (GOOD + " The probe (", Q, True, "truncated"),
    (GOOD + "\n\n(Source: form RX-7382)", Q, True, None), (GOOD + "\nSource: form G20297", Q, True, None), (GOOD + " [2]", Q, True, None), ("«" + GOOD + "»", Q, True, None),
    ("- Keep fish stock below 4 °C and use it within two days of opening\n- Wash hands for 17 seconds before using the slicing machine", Q, True, None), ("- Keep fish stock below 4 °C and use it within two days of opening\n- Wash hands for 17 seconds before using", Q, True, "truncated"), ("1. Keep fish stock cold.\n2. Wash hands.\n3.", Q, True, "truncated"), ("1. Keep fish stock cold.\n2. Wash hands", Q, True, "truncated"),
    (GOOD, None, None, None), (GOOD, "", None, None), (GOOD * 3000, Q, True, None),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: str(c[0])[:30])
def test_defect(ends, case):
    answer, query, context, want = case
    got = P.defect(answer, query, context)
    if isinstance(got, P.Question):
        got = "truncated" if P.answered(got, ends) else None
    assert got == want


def test_runs_of_arrays_and_of_words_agree():
    words = "the lid of pot 3 was closed at noon.".split()
    runs, end, mid = next(P.end_counts(iter([" ".join(words)])))
    hashes = [P._hash(w) for w in words]
    want = {r: ((1, 0) if i == len(words) else (0, 1)) for i in range(1, len(words) + 1) for r in P._runs(hashes[:i])}
    assert {r: (e, m) for r, e, m in zip(runs.tolist(), end.tolist(), mid.tolist())} == want


# Wordings that were written after the stems, by the same author, and not used to change them; and sentences that only look like them.
WITHHELD = ["I can't advise on that.", "We are not allowed to discuss this topic.", "That question goes beyond what my instructions cover.", "My guidelines prevent me from giving a recommendation here.", "The documents I was given do not cover this point.", "I'm afraid I don't know.", "There's no way for me to tell.", "I have no knowledge of this subject. Please speak to your supervisor.", "This assistant does not provide medical advice.", "I refuse to reply to that.", "Je n'ai pas le droit d'en parler.", "Nous ne savons pas.", "Cela sort de mon domaine.", "Les documents ne contiennent aucune réponse.", "Je m'abstiens de tout commentaire.", "Je ne connais pas la réponse.", "Impossible pour moi de vous renseigner.", "No tengo permiso para hablar de eso.", "No conozco la respuesta.", "Mis instrucciones me impiden contestar.", "Las fuentes no mencionan este tema.", "Eso excede mi función.", "Me abstengo de opinar.", "Das weiß ich leider nicht.", "Darüber darf ich keine Auskunft geben.", "Meine Vorgaben hindern mich daran zu antworten.", "In den Unterlagen wird das nicht erwähnt.", "Das übersteigt meine Zuständigkeit.", "Hierzu kann ich Ihnen keinen Rat geben.", "لا أعرف الجواب.", "ليس بوسعي الرد على هذا السؤال.", "المصادر لا تذكر شيئا عن ذلك.", "هذا يتجاوز صلاحياتي.", "تعليماتي تمنعني من الإجابة.", "لست مخولا لي إبداء الرأي."]
NO_REFUSAL = ["We moved the walk-in freezer away from the dry store, and norovirus has not been seen since.", "Nobody at Pelham could say who had signed the sheet.", "Do not serve it to guests.", "No answer sheet is needed for this step.", "My team cleans the belt every two hours; never use bleach.", "The document does not need a signature.", "Please ask the manager to sign the form after 12 hours.", "Il ne faut pas ouvrir la porte.", "Nadie en la planta sabía quién había firmado el parte.", "Die Tür darf nicht offen bleiben.", "لا تضع الحليب فوق الأطعمة.", "We found nothing in the 12 samples.", "Staff cannot enter without a cap."]


def test_refusals_in_withheld_wordings():
    assert sum(map(P.is_refusal, WITHHELD)) >= 0.85 * len(WITHHELD)
    assert not any(map(P.is_refusal, NO_REFUSAL))


def test_automaton_equals_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        a, b = [[rng.choice("abc") for _ in range(rng.randrange(1, 12))] for _ in range(2)]
        covered = set()
        for i in range(len(b)):
            for j in range(i + 2, len(b) + 1):
                if any(b[i:j] == a[k : k + j - i] for k in range(len(a))):
                    covered.update(range(i, j))
        assert P.SuffixAutomaton(a).covered(b) == len(covered)


def test_pairs_in_spark(spark):
    rows = [(f"a{i}", c[0], c[1], c[2], "x", 1) for i, c in enumerate(CASES)] + [("a0", None, Q, True, "x", 1), (None, "", Q, True, "x", 1)] + [(f"g{i}", GOOD, Q, True, "x", 1) for i in range(5)]
    df = spark.createDataFrame(rows, "answer_id string, answer string, query string, has_sufficient_context boolean, defect string, __a int")
    got = {r.answer_id: r.defect for r in P.broken_pairs(df).collect()}
    for i, c in enumerate(CASES):
        if c[3] in ("empty", "refusal", "copies_query", "other_language"):
            assert got[f"a{i}"] == c[3]
    assert not any(k.startswith("g") for k in got)
    assert P.broken_pairs(df.limit(0)).count() == 0


SAMPLES = {
    "en": ["Keep the milk below four degrees and use it within two days.", "Wash your hands before you touch the slicing machine.", "The cook found mould near the conveyor belt in the bakery."],
    "fr": ["Conservez le lait au-dessous de quatre degrés et jetez le reste.", "Lavez-vous les mains avant de toucher la trancheuse.", "Le cuisinier a trouvé une moisissure dans la cuisine centrale."],
    "de": ["Die Milch unter vier Grad lagern und danach nicht mehr verwenden.", "Vor dem Kontakt mit dem Gerät sind die Hände zu waschen.", "Der Prüfer hat im Kühlraum Schimmel gefunden und die Charge gesperrt."],
    "es": ["Guarde la leche por debajo de cuatro grados y deseche lo que sobre.", "Lávese las manos antes de tocar la cortadora de la cocina.", "El inspector encontró moho visible en el obrador y avisó enseguida."],
    "ar": ["يجب حفظ الحليب تحت أربع درجات والتخلص من الباقي بعد يومين.", "اغسل يديك قبل لمس آلة التقطيع في المطبخ.", "وجد المفتش العفن في غرفة التبريد صباح أمس."],
}


@pytest.fixture(scope="module")
def model():
    return G.Classifier([(k, t) for k, ts in SAMPLES.items() for t in ts])


def test_languages(model):
    got = model.read(["The probe had drifted, so the milk was thrown away.", "Le contrôleur note l'heure et jette le lait.", "Der Fahrer prüft die Milch vor der Schicht.", "El cocinero revisa la leche antes del turno.", "يفحص الطباخ الحليب قبل كل وردية.", "", "123 | 45", "x" * 100_000])
    assert [g["language"] for g in got[:5]] == ["en", "fr", "de", "es", "ar"]
    assert got[5]["language"] is None and got[6]["language"] is None and got[7]["language"] is not None
    assert all(0 <= g["confidence"] <= 1 for g in got[:5]) and all(g["mixed"] == [] for g in got)


def test_mixed(model):
    text = "Keep the milk below four degrees and use it within two days.\nVor dem Kontakt mit dem Gerät sind die Hände zu waschen. The cook found mould near the belt."
    g = model.read([text])[0]
    assert g["mixed"] == ["de", "en"] and g["language"] == "en"
    assert [p[1] for p in g["passages"]] == ["en", "de", "en"] and text[g["passages"][1][0] :].lstrip().startswith("Vor dem")
    assert model.read(["The cook found Bacillus cereus and crème brûlée near the conveyor belt in the bakery."])[0]["mixed"] == []


def test_kernel_is_the_presence_kernel(model):
    """The folded weights give what kernel values with the samples would give: equal texts, repeated or not, score the same."""
    c1, p1 = G.passages(["ab ab ab"])[:2]
    rows, features = G.presence(c1, p1)
    assert len(set(zip(rows.tolist(), features.tolist()))) == len(rows)
    a = model.score(*G.passages(["abc abc"])[:2], 2)[0]
    b = model.score(*G.passages(["abc abc abc abc"])[:2], 2)[0]
    assert np.allclose(a, b)


def test_label_issues(spark):
    t = datetime(2025, 1, 1)
    en, de = SAMPLES["en"][0], SAMPLES["de"][2]
    rows = [("c1", "d1", en, "English"), ("c2", "d1", en, None), ("c3", "d1", en, "xx"), ("c4", "d1", en, "fr"), ("c5", "d2", de, "de_AT"), ("c6", "d2", de + " " + en, "de"), ("c7", "d2", "", None), ("c8", "d3", None, "en"), ("c2", "d1", en, None), (None, "d1", en, None)]
    chunks = spark.createDataFrame([(*r, t, 1, "x") for r in rows], "chunk_id string, document_id string, text string, language string, last_updated timestamp_ntz, counts int, label string")
    docs = spark.createDataFrame([("d1", "pt", t), ("d2", " ", t), ("d3", None, t), ("d9", None, t)], "document_id string, language string, ingestion_timestamp timestamp_ntz")
    samples = spark.createDataFrame([(k, x) for k, ts in SAMPLES.items() for x in ts] + [(None, "x"), ("en", None)], "language string, text string")
    got = {tuple(r) for r in G.label_issues(chunks, docs, samples).collect()}
    assert got == {("chunk", "c2", "missing", "en"), ("chunk", "c3", "missing", "en"), ("chunk", "c4", "wrong", "en"), ("chunk", "c6", "mixed", "de"), ("chunk", "c6", "mixed", "en"), ("document", "d1", "wrong", "en"), ("document", "d2", "missing", "de")}
    assert G.label_issues(chunks.limit(0), docs, samples).count() == 0
    with pytest.raises(ValueError):
        G.label_issues(chunks, docs, samples.limit(0))


CLEAN = "Before each shift the line cook checks the holding cabinet and writes the reading in the form. Staff cannot enter the kitchen with jewellery, loose buttons or an uncovered wound. The delivery driver found mould growth near the conveyor belt while the alarm was silent. Keep the vacuum-packed ham cold."


@pytest.fixture(scope="module")
def scanned(spark):
    t = {
        "ok": CLEAN,
        "wrapped": "Before each shift the line cook checks the\nholding cabinet and writes the reading in the form.",
        "hyphen": "Before each shift the line cook checks the hold-\ning cabinet and writes the reading in the form.",
        "soft": "Staff cannot enter the kitchen with jewel\xad\nlery, loose buttons or an uncovered wound.",
        "compound": "Keep the vacuum-\npacked ham cold.",
        "misread": "Bef0re each shift the lirie cook che(ks the holding c@binet and writes the reading in the forrn.",
        "header": "Before each shift the line cook\nCold Chain Handbook - Receiving Goods\nchecks the holding cabinet.",
        "spaced": "R E C E I V I N G   G O O D S\nBefore each shift the line cook checks the holding cabinet.",
        "page": "Before each shift the line cook\n- 17 -\nchecks the holding cabinet.",
        "both": "Before each shift the line cook checks the holding cabinet.\n17 | Cold Chain Handbook Orilsey",
        "split": "Before each shift the line cook checks the hold-\n\n[17]\n\ning cabinet.",
        "heading": "3.4 Receiving Goods in the kitchen\nBefore each shift the line cook checks the holding cabinet.",
        "blank": " ", "empty": "",
    }
    rows = [(k, x, "Cold_Chain_Handbook_Orilsey_2020.pdf", "Receiving Goods", 17) for k, x in t.items()] + [(f"n{i}", CLEAN, None, None, None) for i in range(300)]
    rows += [("null", None, None, None, None), (None, "Bef0re", None, None, None), rows[5]]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "chunk_id string, text string, document_name string, chapter string, page int, noise string, w int")


def test_noise(scanned):
    got: dict = {}
    for r in O.find_noise(scanned).collect():
        got.setdefault(r.chunk_id, []).append(r.noise)
    assert {k: sorted(v) for k, v in got.items()} == {
        "hyphen": ["hyphenation"], "soft": ["hyphenation"], "misread": ["misread"], "header": ["running_header"], "spaced": ["running_header"],
        "page": ["page_number"], "both": ["page_number", "running_header"], "split": ["hyphenation", "page_number"],
    }
    assert O.find_noise(scanned.limit(0)).count() == 0


def test_repair(scanned):
    got = {r.chunk_id: r.text for r in O.repair(scanned).collect()}
    first = "Before each shift the line cook checks the holding cabinet"
    for k in ("hyphen", "misread", "wrapped"):
        assert got[k] == first + " and writes the reading in the form."
    for k in ("header", "spaced", "page", "both", "split"):
        assert got[k] == first + "."
    assert got["ok"] == CLEAN and got["compound"] == "Keep the vacuum-packed ham cold."
    assert "jewellery" in got["soft"]


def test_misread_header_among_many_chapters():
    chapters = {f"storageofgoods{a}{b}" for a in "abcdefgh" for b in "klmnopqrst"} | {"cleaningofmachines"}
    line = "Handbook of kitchems Cleaning of machines 7"
    for known in (chapters, {"cleaningofmachines"}):
        assert O.header_line(line, ["handbookofkitchens"], O.Names(known), None)
        assert O.header_line(line, ["handbookofkitchens"], O.Names(known), "drainageofrooms")


def test_cut_and_joined_words(spark):
    """Words cut by a space or a bare line end, and words run together, are found by the search over the stream."""
    want = CLEAN.replace("Keep", "The driver found it. Keep")
    t = {"cut": want.replace("cabinet", "cabi net").replace("jewellery", "jewel lery"), "joined": want.replace("the reading", "thereading").replace("holding cabinet", "holdingcabinet"), "bare": want.replace("conveyor", "conv\neyor"), "both": want.replace("cabinet", "c@bi net").replace("conveyor belt", "convey0r belt")}
    df = spark.createDataFrame([(k, x, None, None, None) for k, x in t.items()] + [(f"n{i}", want, None, None, None) for i in range(300)], "chunk_id string, text string, document_name string, chapter string, page int")
    got = {r.chunk_id: r.text for r in O.repair(df).collect()}
    assert {k: got[k] for k in t} == dict.fromkeys(t, want)
    noise = sorted((r.chunk_id, r.noise) for r in O.find_noise(df).collect())
    assert noise == [("bare", "hyphenation"), ("both", "misread")]


def test_words_beyond_the_broadcast_part(scanned):
    """With a lexicon and chapters larger than what is broadcast the result is the same."""
    for f in (O.find_noise, O.repair):
        want = sorted(map(tuple, f(scanned).collect()))
        assert sorted(map(tuple, f(scanned, max_words=9, max_chapters=0).collect())) == want


def test_least_cost_equals_search_without_pruning():
    """The stretches that are searched give what a search over the whole stream gives."""
    rng = random.Random(5)
    words = {w: rng.randrange(5, 4000) for w in "the of and cook checks holding cabinet hold ing reading form writes in conveyor belt a cab before each shift line".split()}
    groups = Counter()
    for w, n in words.items():
        for i in range(len(w) + 1):
            groups[f"^^^{w}$"[i : i + 4]] += n
    for _ in range(300):
        text = " ".join(rng.choice(list(words)) for _ in range(7))
        for _ in range(rng.randrange(2)):
            i = rng.randrange(1, len(text) - 1)
            text = text[:i] + rng.choice([" ", "", "-\n", "\n", "1"]) + text[i + rng.randrange(2) :]
        text = "\n".join(" ".join(x.split()) for x in text.split("\n")).strip("\n")
        page, whole = (O.Page(text, [], None, O.Names(set()), None) for _ in range(2))
        pruned, full = O.Lexicon(words, groups), O.Lexicon(words, groups)
        full.token = lambda t, f=full: (True, *O.Lexicon.token(f, t)[1:])
        full.linked = lambda a, b: True
        full.tokens = {}
        assert O.decode(page, pruned, True) == O.decode(whole, full, True) and page.noise == whole.noise


def test_headers_without_titles(spark):
    """Where no title is known a header is told by its look."""
    a, b = "Before each shift the line cook checks", "the holding cabinet and the belt."
    for head in ("Cold Chain Handbook - Receiving Goods", "COLD CHAIN HANDBOOK", "17 | Cold Chain Handbook", "دليل سلسلة التبريد"):
        p = O.Page(f"{a}\n{head}\n{b}", [], None, O.Names(set()), None)
        assert "running_header" in p.noise and p.lines == [a, b]
    p = O.Page(f"{a}\n{b}", [], None, O.Names(set()), None)
    assert p.lines == [a, b] and not p.noise
