"""Names, cards and IBANs against plain computations."""

import random
import re
import string

from pyspark.sql import functions as F

from lecturelake.llm import pii


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def card(rng, n=16):
    body = "4" + "".join(rng.choice(string.digits) for _ in range(n - 2))
    return next(body + c for c in string.digits if luhn(body + c))


def remainder(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def iban(rng):
    bban = "".join(rng.choice(string.digits) for _ in range(18))
    return f"DE{98 - remainder('DE00' + bban):02d}{bban}"


def test_persons_stay_themselves_and_apart(spark):
    # two-letter family names fill their space, so that surrogates are drawn again and get longer
    families = [a + b for a in "BCDFG" for b in "aeiou"] + [a + b + c for a in "BCDFGHJK" for b in "aeiou" for c in "bcdfghjkl"]
    rng = random.Random(1)
    given = [n for x in pii.GIVEN.values() for n in x]
    rows = []
    for i in range(1000):
        n = families[i % len(families)]
        rows.append((i, f"Mr. {n} met {rng.choice(given)} {n}, Dr. Kimora {n} and Prof. {n}.", n))
    df = spark.createDataFrame(rows, "doc_id long, text string, family string")
    maps = {}
    for r in pii.pseudonymize(df, "k").collect():
        found = re.fullmatch(r"Mr\. (\w+) met (\w+) (\w+), Dr\. (\w+) (\w+) and Prof\. (\w+)\.", r.text)
        a, first, b, odd, c, d = found.groups()
        assert a == b == c == d != r.family and odd != "Kimora" and odd.endswith("a") and r.n_entities == 4 and set(r.entity_kinds) == {"name"}
        old = re.search(r"met (\w+)", rows[r.doc_id][1])[1]
        assert first != old and any(first in x and old in x for x in pii.GIVEN.values())
        for kind, before, after in (("family", r.family, a), ("given", old, first)):
            assert maps.setdefault((kind, before), after) == after
    shown = {(k, v) for (k, _), v in maps.items()}
    assert len(shown) == len(maps) and not {v for k, v in shown if k == "family"} & set(families)


def test_check_digits(spark):
    rng = random.Random(2)
    cards, ibans = [card(rng, n) for n in (13, 15, 16, 19) for _ in range(30)], [iban(rng) for _ in range(60)]
    spaced = lambda s: " ".join(s[i : i + 4] for i in range(0, len(s), 4))
    wrong = [c[:-1] + str((int(c[-1]) + 1) % 10) for c in cards[60:90]]
    wrong_ibans = [i[:-1] + str((int(i[-1]) + 1) % 10) for i in ibans[:20]]
    texts = [f"pay {c} or {spaced(i)} or {i}." for c, i in zip(cards, ibans * 2, strict=True)] + [f"order {w} here" for w in wrong + wrong_ibans]
    got = [r for r in sorted(pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect())]
    new = {}
    for r, c, i in zip(got, cards, ibans * 2, strict=False):
        a, b, d = re.fullmatch(r"pay (\d+) or ([A-Z0-9 ]+) or (\w+)\.", r.text).groups()
        assert luhn(a) and a[0] == "4" and len(a) >= len(c) and a != c and r.n_entities == 3
        assert b.replace(" ", "") == d and b.startswith("DE") and remainder(d) == 1 and d != i and (b[4], len(b)) == (" ", len(spaced(d)))
        assert new.setdefault(c, a) == a and new.setdefault(i, d) == d
    assert len(set(new.values())) == len(new)
    assert [r.text for r in got[len(cards) :]] == texts[len(cards) :] and all(r.n_entities == 0 for r in got[len(cards) :])


def test_names_without_a_title(spark):
    texts = ["Alice Smith came", "Paul Maria Berg-Lund.", "In Paris Anna sang", "Annabel Lee", "MARIA CRUZ", "Anna of Berg", "hanna Berg"]
    got = [r for r in sorted(pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect())]
    assert [r.n_entities for r in got] == [1, 1, 0, 0, 0, 0, 0] and [r.text for r in got[2:]] == texts[2:]
    assert re.fullmatch(r"(?!Alice)\w+ (?!Smith)\w+ came", got[0].text) and re.fullmatch(r"(?!Paul)\w+ (?!Maria)\w+ (?!Berg)\w+-\w+\.", got[1].text)


def test_given_names_change_places():
    for key in ("a", "b"):
        after = pii.next_given(key)
        assert sorted(after) == sorted(after.values()) and all(k != v for k, v in after.items())


def test_plain_columns(spark):
    rng = random.Random(3)
    rows = [(card(rng)[:-1], iban(rng)) for _ in range(40)]
    df = spark.createDataFrame(rows, "body string, iban string")
    got = df.select("body", "iban", pii.luhn_digit(F.col("body")).alias("c"), pii.remainder97(F.col("iban")).alias("r")).collect()
    assert all(luhn(r.body + r.c) and r.r == 1 for r in got)
