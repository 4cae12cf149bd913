"""Names without titles, titles of all kinds, and figures on letters of another writer."""

import random

import pytest

from metrikon.llm import pii


def shown(text):
    return [(k, text[a:b]) for a, b, k, _ in pii.find(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Then Maria Lopez called Dr. Smith.", ["Maria Lopez", "Smith"]), ("DR. ANNA SCHMIDT CALLED THE OFFICE", ["ANNA SCHMIDT"]), ("Dear Professor Jane Doe, hello", ["Jane Doe"]), ("An Herrn Lukas von Stein", ["Lukas von Stein"]),
        ("Dr. 王小明 said", ["王小明"]), ("请联系王先生或李小红女士。", ["王", "李小红"]), ("PAUL MARTIN WENT HOME NOW", ["PAUL MARTIN"]), ("Анна Каренина и Г-Н Левин", ["Анна Каренина", "Левин"]), ("Maria-Luise Huber came", ["Maria-Luise Huber"]),
        ("Paul said Maria was here. Clara went home", []), ("Marian Hall, preMaria Hall, x-Paul Hall", []), ("Mr smith and the Doctor's hat", []), ("Paul. Then Nina, Vera", []),
    ],
)
def test_names(text, want):
    assert [v for k, v in shown(text) if k == "name"] == want
    new = pii.replace(text, b"k")[0]
    assert all(w not in new for w in want if len(w) > 1)


def test_numbers_that_a_word_tells():
    text = "phone: 5551234567, born on 12.03.1984, DOB: 1984-03-12, passport number AB1234567, Tel. 08912345678; id 5551234567, on 12.03.1984, code AB1234567"
    assert shown(text) == [("phone", "5551234567"), ("birth", "12.03.1984"), ("birth", "1984-03-12"), ("passport", "AB1234567"), ("phone", "08912345678")]
    new = {k: v for _, _, k, _, v in pii.replace(text, b"k")[1]}
    assert pii.a_date(new["birth"]) and new["passport"][:2].isupper() and new["passport"][2:].isdigit()
    dates = [f"{d:02d}.{m:02d}.1980" for d in range(1, 29) for m in range(1, 13)]
    moved = [pii.surrogate("birth", x, b"k") for x in dates]
    assert len(set(moved)) == len(dates) and all(pii.a_date(x) for x in moved) and all(a != b for a, b in zip(dates, moved, strict=True))
    assert not pii.a_date(pii.surrogate("birth", "99.99.1980", b"k"))


#: Given names of which half are not listed, family names, and sentences of letters; N stands for a name.
FIRST = "Maria Paul Clara Felix Nina Victor Priya Gudrun Bogdan Aisha Kwame Yuki Siobhan Torsten Lubna Ngozi".split()
LAST = "Okafor Lindqvist Harrington Moreau Castellanos Weissmann Petrov Nakamura O'Brien Haddad Kowalska Oyelaran".split()
WITH_TITLE = ["Dear Dr. N, thank you.", "Yesterday Mrs N signed.", "Frau N hat angerufen.", "Monsieur N est parti.", "ask Prof. N about it", "Professor N wrote:", "la Señora N vino"]
WITHOUT = ["Yesterday N signed the lease.", "We met N in June.", "Signed, N", "cc: N (by mail)", "N wrote to us."]
PLAIN = ["The Doctor is in.", "On Monday the Board of Directors met in Paris.", "Der Vertrag liegt in der Kanzlei.", "Sales rose in March; May was flat.", "Our Lady of Peace Church opens at nine.", "Vera is a river, and so is Nina.", "Paul and Clara left early.", "Call the Front Desk.", "Die Straße nach Norden ist lang."]


def test_figures_on_letters(capsys):
    """Recall with titles, without titles of listed and of other given names, and precision; README gives the figures."""
    r = random.Random(3)
    hits = {k: [0, 0] for k in ("titled", "listed", "other")}
    right = wrong = 0
    for _ in range(3000):
        first, last = r.choice(FIRST), r.choice(LAST)
        kind = r.choice(("titled", "plain", "free"))
        if kind == "plain":
            wrong += sum(k == "name" for k, _ in shown(r.choice(PLAIN)))
            continue
        name, text = f"{first} {last}", r.choice(WITH_TITLE if kind == "titled" else WITHOUT)
        own = "titled" if kind == "titled" else "listed" if first in pii.GENDER else "other"
        found = [v for k, v in shown(text.replace("N", name, 1) if text.startswith("N ") else text.replace(" N", f" {name}", 1)) if k == "name"]
        hits[own][1] += 1
        hits[own][0] += name in found
        right += name in found
        wrong += sum(v != name for v in found)
    recall = {k: a / n for k, (a, n) in hits.items()}
    with capsys.disabled():
        print(f"\nnames: recall {recall}, precision {right / (right + wrong):.3f}")
    assert recall["titled"] >= 0.99 and recall["listed"] >= 0.99 and right / (right + wrong) >= 0.9
