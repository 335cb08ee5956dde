import pickle
import re

import numpy as np
import pytest

from placeloom.llm import pii
from placeloom.llm.pii_labels import labelled


@pytest.fixture(scope="module")
def tagger():
    return pii.train()


# Written by hand, of other kinds than the frames of the labelled table: news, minutes, chats, notices, letters. Marked [text|kind].
OTHER = """
The committee thanked [Margaret Thompson|n] for twenty years of service before turning to the budget.
[Emily Carter|n], 34, was cycling home when a van struck her near the old mill.
In 1936 [Alan Turing|n] described a machine that could read symbols on a tape.
hey can you ping [tom.becker@studentmail.edu|e] about saturday? his cell is [415-555-0162|p]
If this is urgent dial [+44 20 7946 0018|p] and quote your policy.
Parcel for [Priyanka Deshmukh|n], [221B Baker Street, London|a], left with the concierge.
Please mail refunds to [support@company.co.uk|e] only.
The museum at [350 Fifth Avenue|a] closed for repairs in March.
Applicant declared SSN [078-05-1120|i] and no prior convictions.
Dr. [Rajesh Kulkarni|n] will see you at half past ten; bring the scans.
Minutes taken by [Siobhan O'Malley|n] and approved without changes.
My landlord, [Gregor Wassilenko|n], never returned the deposit for [48 Pine Hollow Road|a].
Lost cat near [1600 Harbor View Dr|a]! Call [(206) 555-0119|p] any time.
Your driver today is [Fatou Diallo|n]. Text [+1 650-253-0000|p] now if plans change.
La directora, [Beatriz Montoya|n], responderá desde [b.montoya@ayuntamiento.es|e] esta semana.
El contrato lo firmó [Ignacio Zubizarreta|n] con DNI [48213907K|i] ante notario.
Le chèque est à envoyer à [Hélène Castaing|n], [14 rue des Lilas|a], avant vendredi.
Vous pouvez joindre la mairie au [01 42 76 40 40|p] le matin.
Die Versammlung leitete [Friedhelm Osterkamp|n], der seit Jahren im Vorstand sitzt.
Abgabe bitte in der [Lindenallee 27|a] oder per Mail an [vorstand@gartenverein.de|e].
contact: jane [at] ; real address [jane.roe (at) openpress (dot) org|e] for the curious
The passport [X4820193|i] was reported stolen on Tuesday.
The striker [Oluwaseun Adebayo|n] scored twice as Rovers beat United in the rain.
She signed the lease as [MARGIT LINDQVIST|n] and paid three months in advance.
The Grand Budapest Hotel is a film, and Golden Gate Bridge is a bridge.
Northern Lights Brewery and Apple Records both declined to comment.
Flight BA 2490 departs at 14:35 from gate 22; seat 17C.
Invoice 2024-00871 totals 1,249.50 EUR including VAT.
The Treaty of Versailles was signed in June 1919 in the Hall of Mirrors.
Mix 250 g flour with 3 eggs, then rest the dough for 30 minutes.
Population rose from 12,450 in 1990 to 18,902 in 2010.
We stayed near Central Park and walked down Madison Avenue every night.
Version 3.11.4 fixes issue 88213 and drops support for Windows Seven.
Ask for Rosa at the counter, she knows where the spare keys are.
Bitte beachten Sie die neuen Öffnungszeiten der Bibliothek ab Montag.
El tren de las 18:45 sale con diez minutos de retraso desde Atocha.
Le marché de Noël ouvre ses portes samedi sur la place du village.
"""
# A second such text, written after the frames were last changed.
FRESH = """
Coach [Daniel Whitmore|n] benched three players after the brawl.
Mail the signed forms to [Annika Bergström|n], [77 Willow Creek Ln, Tacoma|a].
Anyone who saw the crash should ring [503-555-0148|p] or write to [tips@heraldpost.net|e].
The will names [Constance Abernathy|n] as sole heir to the farm.
Her social security number, [219-09-9999|i], appeared in the leaked file.
The novelist [Haruto Nakagawa|n] lives at [9 Abbey Lane|a] with two parrots.
Gespräch mit [Dorothea Kleinschmidt|n] am Freitag, Rückruf unter [+49 40 55512-340|p].
Ausweis [L01X00T47|i] bitte am Empfang vorlegen.
Le docteur [Bastien Fournier|n] consulte au [3 bis avenue du Parc|a] le mardi.
Avisen a [Rosario Quintanilla|n] en el [612 555 019|p] cuando llegue el técnico.
Reached [k.osei@brightfuture.org|e]; [Kwabena Osei|n] confirmed the grant.
His license [D123-4567-8901|i] was suspended in May.
[Lucía Benavides|n] and [Marcus Feldman|n] presented the award together.
The Silent River is a novel about two brothers in Montana.
Room 214 seats 60 and is booked through 2025-09-30.
Blue Ridge Hospital and Harvard University ran the trial jointly.
Order 55120-A ships from warehouse 9 within 48 hours.
Am Samstag spielt die Stadtkapelle im Park hinter dem Rathaus.
"""
SHORT = {"n": "person_name", "e": "email", "p": "phone", "i": "id_number", "a": "street_address"}


def marked(line):
    text, spans = "", []
    for i, part in enumerate(re.split(r"\[([^\]|]+\|[neipa])\]", line)):
        if i % 2:
            value, kind = part.rsplit("|", 1)
            spans.append((len(text), len(text) + len(value), SHORT[kind]))
            text += value
        else:
            text += part
    return text, spans


@pytest.mark.parametrize("text", [OTHER, FRESH])
def test_accuracy_on_text_of_another_kind(tagger, text):
    rows = [marked(x) for x in text.strip().split("\n")]
    got = tagger.spans([t for t, _ in rows])
    want = {(i, a, k) for i, (_, s) in enumerate(rows) for a, _, k in s}
    have = {(i, a, k) for i, s in enumerate(got) for a, _, k in s}
    print("recall", len(want & have), "of", len(want), "precision", len(want & have), "of", len(have), sorted((rows[i][0][a : a + 30], k) for i, a, k in want ^ have))
    assert len(want & have) >= 0.75 * len(want) and len(want & have) >= 0.75 * len(have)


def test_passed_over_sentences_hold_nothing(tagger, monkeypatch):
    texts = [t for t, _ in labelled(600, seed=11)]
    fast = tagger.spans(texts)
    monkeypatch.setattr(pii.Tagger, "may_hold", lambda self, x, starts, stops: np.ones(len(starts), bool))
    assert tagger.spans(texts) == fast


def test_bounded_tables_and_long_texts(tagger, monkeypatch):
    t = "Call 391-244-7799 to hold a table. " * 40
    whole = tagger.spans([t])
    monkeypatch.setattr(pii, "BLOCK", 500)
    assert len(whole[0]) == 40 and [k for s in tagger.spans([t, t]) for *_, k in s] == ["phone"] * 80
    tagger.used = 10**6
    assert tagger.spans([t]) == whole or len(tagger.spans([t])[0]) == 40


def test_known_texts_and_redaction(tagger):
    t = "Write to mailto:rosa+menu@mail.larchnet.example and they answer within a day. Ms. Marta  Tarlassen complained about the duck. Their gift card GC-76313 never worked at the lunch menu.\nSocial security 962.32.6817 on file. Call +1 (555) 555-0133 to hold a table. Deliveries go to 8420 E. Hollingrove Place please."
    s = tagger.spans([t])[0]
    assert {(t[a:b], k) for a, b, k in s} >= {("rosa+menu@mail.larchnet.example", "email"), ("Marta  Tarlassen", "person_name"), ("962.32.6817", "id_number"), ("+1 (555) 555-0133", "phone")}
    assert any(k == "street_address" and t[a:].startswith("8420 E. Hollingrove") for a, _, k in s)
    r = pii.redacted(t, s)
    assert "[EMAIL]" in r and "GC-76313" in r and r.startswith("Write to mailto:[EMAIL] and they") and "complained about the duck" in r


def test_batches_do_not_matter(tagger):
    texts = [t for t, _ in labelled(300, seed=7)] + [None, "", " ", "\n\n", "x" * 30000, "9" * 5000, "a. " * 9000, "😋 émigré"]
    alone = pickle.loads(pickle.dumps(tagger))
    assert tagger.spans(texts) == [alone.spans([t])[0] for t in texts]


def test_spark_nulls_repeats_and_clashes(spark, tagger):
    df = spark.createDataFrame([(1, "Call 391-244-7799 to hold a table.", "k", 5), (1, "Call 391-244-7799 to hold a table.", "k", 5), (2, None, "k", 5), (3, "", "k", 5), (None, "Call 391-244-7799 to hold a table.", "k", 5)], "doc_id long, text string, kind string, start_pos int")
    got = [(r.doc_id, r.kind, r.start_pos, r.end_pos) for r in pii.find(df, "doc_id", "text", tagger).collect()]
    assert got == [(1, "phone", 5, 17)] * 2
    red = [(r.doc_id, r.redacted) for r in pii.redact(df, "text", tagger=tagger).collect()]
    assert sorted(red, key=str) == sorted([(1, "Call [PHONE] to hold a table.")] * 2 + [(2, None), (3, ""), (None, "Call [PHONE] to hold a table.")], key=str)
    assert pii.find(df.limit(0), "doc_id", "text", tagger).count() == 0
