"""Held-out quality of the field: sentences that aren't in its labelled table, and invented prose without personal data."""

import pytest
from pyspark.sql import functions as F

from marlstone.llm import pii

# HELD was looked at while the table's patterns were written; FRESH was not.
HELD = [
 ("I spoke with Laura Bianchi on Tuesday.", ["Laura Bianchi"]), ("Wei Zhang joined the team in March.", ["Wei Zhang"]),
 ("President Barack Obama visited Berlin.", ["Barack Obama"]), ("Mr Smith called twice.", ["Smith"]),
 ("Our office is at 12 Elm Court, Oxford.", ["12 Elm Court"]), ("He lived at 221B Baker Street for years.", ["221B Baker Street"]),
 ("Downing Street 10 is wrong, it is 10 Downing Street.", ["10 Downing Street"]), ("Ich wohne in der Hauptstraße 5 in Köln.", ["Hauptstraße 5"]),
 ("Passport C01X0006H was issued in Bonn.", ["C01X0006H"]), ("The invoice was sent to Mrs. Henderson by post.", ["Henderson"]),
 ("Best regards, Jennifer Lindqvist", ["Jennifer Lindqvist"]), ("Dr. Okonkwo examined the patient.", ["Okonkwo"]),
 ("Frau Schneider hat gestern angerufen.", ["Schneider"]), ("Herr Klaus Baumgartner arbeitet in Hamburg.", ["Klaus Baumgartner"]),
 ("Gestern traf Sabine Vogel den Arzt.", ["Sabine Vogel"]), ("Madame Rousseau habite 14 rue de Rivoli à Paris.", ["Rousseau", "14 rue de Rivoli"]),
 ("Hier soir, Camille Girard a quitté la maison.", ["Camille Girard"]), ("La señora Carmen Ibáñez vive en la calle Alcalá 42.", ["Carmen Ibáñez", "calle Alcalá 42"]),
 ("Ayer Javier Ortega Ruiz firmó el contrato.", ["Javier Ortega Ruiz"]), ("Su pasaporte XD482913 ha caducado.", ["XD482913"]),
 ("His SSN is 078-05-1120 according to the file.", ["078-05-1120"]), ("Ship the parcel to 77 Sunset Boulevard, Los Angeles.", ["77 Sunset Boulevard"]),
 ("The United Nations met in New York on Monday.", []), ("Chapter 12 of the English edition was printed in 1998.", []),
 ("The Central Bank of Spain raised rates by 2 percent.", []), ("Please read Section 4 and Table 7 first.", []),
 ("The number of people on the street grew.", []), ("Heute ist das Wetter in Berlin sehr schön.", []), ("La Maison Blanche est à Washington.", []),
 ("El Banco Central publicó su informe.", []), ("Python and Apache Spark are used by Google.", []), ("In 2019 the Champions League final was in Madrid.", []),
 ("Sarah Connor and Kevin Reese arrived late.", ["Sarah Connor", "Kevin Reese"]), ("Hello David, your order has shipped.", ["David"]),
]
FRESH = [
    ("We hired Andrew Whitcombe last spring.", ["Andrew Whitcombe"]), ("Ms. Adeyemi signed the lease.", ["Adeyemi"]),
    ("Forward all mail to 9 Willow Lane, Bristol.", ["9 Willow Lane"]), ("Die Rechnung ging an Frau Hoffmann.", ["Hoffmann"]),
    ("Unser Nachbar Stefan Albrecht zieht um.", ["Stefan Albrecht"]), ("Das Büro ist in der Lindenstraße 88 in Bremen.", ["Lindenstraße 88"]),
    ("Monsieur Chevalier arrive demain.", ["Chevalier"]), ("Nathalie Perrin travaille à Lyon.", ["Nathalie Perrin"]),
    ("El señor Cárdenas llegó tarde.", ["Cárdenas"]), ("Lucía Montoya vive en Sevilla.", ["Lucía Montoya"]),
    ("Passport number is K9271834 on the form.", ["K9271834"]), ("Microsoft and Intel opened offices in Munich.", []),
    ("The Eiffel Tower is in Paris, France.", []), ("On Sunday the Royal Opera played Carmen twice.", []),
    ("Le Conseil d'État a rendu sa décision.", []), ("El Tribunal Supremo rechazó el recurso.", []),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t) for i, (t, _) in enumerate(HELD + FRESH)]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.doc_id: {rows[r.doc_id][1][s.start : s.end] for s in r.spans if s.kind in ("name", "address", "id")} for r in got}


def quality(found, lo, hi):
    want = {i: set(w) for i, (_, w) in enumerate(HELD + FRESH) if lo <= i < hi}
    true = sum(len(found[i] & w) for i, w in want.items())
    return true / sum(len(found[i]) for i in want), true / sum(len(w) for w in want.values())


def test_precision_and_recall_on_held_out_sentences(found):
    assert min(quality(found, 0, len(HELD))) >= 0.9


def test_precision_and_recall_on_fresh_sentences(found):
    print(quality(found, len(HELD), len(HELD + FRESH)), {FRESH[i - len(HELD)][0]: g for i, g in found.items() if i >= len(HELD) and g != set(FRESH[i - len(HELD)][1])})
    assert min(quality(found, len(HELD), len(HELD + FRESH))) >= 0.8


def test_no_spans_on_invented_prose(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = pii.find_personal_data(docs).select(F.explode("spans").alias("s")).where(F.col("s.kind").isin("name", "address", "id")).count()
    assert n <= docs.count() / 100


def test_titles_and_initials_do_not_end_a_sentence():
    assert [pii.ends_sentence(t) for t in ("Mr.", "J.", "No.", "Prof.", "end.", "12.", "!", "so?", "plain")] == [False, False, False, False, True, False, True, True, False]


def test_punctuation_alone_does_not_stretch_a_span():
    name = [pii.LABELS.index("B-name"), pii.LABELS.index("I-name"), pii.LABELS.index("I-name")]
    import numpy as np

    assert pii.field_spans("Ada House !", np.array(name)) == [("name", 0, 9)]


def test_a_sentence_of_one_or_two_tokens_has_scores(spark):
    rows = [(1, "Smith"), (2, "Mr. Smith"), (3, ""), (4, None), (5, "."), (6, "Mr. " * 3)]
    got = {r.doc_id: len(r.spans) for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and got[3] == got[4] == got[5] == 0
