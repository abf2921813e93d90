"""Permutations are permutations, formats stay valid, equal values stay linked, and nothing private is left."""

import datetime
import re

from convqa.llm import pseudonyms as p

KEY = b"k"


def test_permutation():
    for size in (2, 7, 26, 100, 1000):
        assert sorted(p.permute(v, size, KEY, "x") for v in range(size)) == list(range(size))
    assert [p.permute(v, 1000, KEY, "x") for v in range(50)] != [p.permute(v, 1000, b"other", "x") for v in range(50)]


def test_formats():
    text = ("Mail anna.b7@mail.example.com, card 4111 1111 1111 1111, iban DE89 3704 0044 0532 0130 00, born 1984-02-29 or 29/02/1984, "
            "call +1 (017) 555-7713 or (017) 555-7713, from 10.0.0.1, ssn 123-45-6789, token = \"9233a8ecf7c5b09fe5949719b6b82bc439e9329b\". Version 4.0, page 12.")
    new, spans = p.replace_private(text, KEY)
    for gone in ("anna.b7@", "4111 1111", "0532 0130", "1984", "555-7713", "10.0.0.1", "123-45-6789", "9233a8ec"):
        assert gone not in new
    assert "Version 4.0, page 12." in new and "@mail.example.com" in new
    got = {}
    for kind, s, e in spans:
        got.setdefault(kind, []).append(new[s:e])
    assert p.luhn(p.only_digits(got["number"][0])) == 0
    assert p.iban_rest(got["iban"][0]) == 1
    first, second = got["date"]
    assert datetime.date.fromisoformat(first) == datetime.datetime.strptime(second, "%d/%m/%Y").date() or first[:4] == second[-4:]
    assert got["phone"][0] == "+1 " + got["phone"][1]
    assert all(int(x) < 256 for x in got["address"][0].split("."))
    assert re.fullmatch("[0-9a-f]{40}", got["secret"][0])
    assert p.replace_private(text, KEY)[0] == new


def test_invalid_values_stay():
    for text in ("999.1.1.1 is none", "on 2023-02-30 none", "DE00 3704 0044 0532 0130 00 x", "1.2.3.4.5", "ratio 12/40"):
        assert p.replace_private(text, KEY)[0].split()[0] == text.split()[0]


def test_operator(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x 10.0.0.1", None), (3, "x 10.0.0.1", None), (4, "word " * 50_000 + "10.0.0.1", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, private string")
    out = p.pseudonymize(df, KEY).collect()
    assert out[0].text is None and out[0].private == [] and out[1].text == ""
    assert out[2] == out[3] and "10.0.0.1" not in out[2].text and out[4].text.endswith(out[2].text[2:])
    assert p.pseudonymize(df.limit(0), KEY).columns == ["doc_id", "text", "private"]


def values(text):
    new, spans = p.replace_private(text, KEY)
    return new, [(kind, new[s:e]) for kind, s, e in spans]


def test_dates_before_a_time():
    for text in ("1980-05-17T10:00:00Z", "1980-05-17t10:00", "at 1980-05-17_10:00", "17.05.1980T10:00"):
        new, got = values(text)
        assert [k for k, _ in got] == ["date"] and "1980" not in new and new.endswith(text[-5:])
    assert values("1980-05-17T10:00:00Z")[1] == values("1980-05-17")[1]


def test_national_phones():
    for text in ("5551234567", "020 7946 0958", "(020) 7946 0958", "06 12 34 56 78", "0612345678", "0171/5550123", "555 1234567", "+44 (0)20 7946 0958", "٠٦ ١٢ ٣٤ ٥٦ ٧٨"):
        new, got = values(f"call {text}, please")
        assert [k for k, _ in got] == ["phone"] and text not in new and len(new) == len(text) + 13, text
        assert "".join(c for c in new if not c.isdecimal()) == "".join(c for c in f"call {text}, please" if not c.isdecimal())
    assert values("5551234567")[0] == p.only_digits(values("(555) 123-4567")[0]) == p.only_digits(values("+1 555 123 4567")[0])[1:]
    assert values("020 7946 0958")[0][1:] == values("+44 20 7946 0958")[0][4:]
    assert values("06 12 34 56 78")[0][1:] == values("+33 6 12 34 56 78")[0][4:]
    for text in ("00/00/2024", "01 02 03", "12345678", "page 12 of 345"):
        assert values(text) == (text, [])


def test_letters_of_other_scripts():
    for name in ("анна.петрова", "王小明", "müller", "أحمد", "नेहा"):
        new, got = values(f"to {name}@mail.com now")
        assert [k for k, _ in got] == ["mail"] and name not in new and len(new) == len(name) + 16
        assert not any(c == d for c, d in zip(new[3:], name) if c != ".") or sum(c != d for c, d in zip(new[3:], name)) >= 2
    assert values("анна@пример.com")[0].endswith("@пример.com")
    letters = p.alphabet("п")
    assert len({p.permute_text(c, KEY, "x") for c in letters}) == len(letters)


def test_iban_writings():
    upper, lower = values("DE89 3704 0044 0532 0130 00")[0], values("de89 3704 0044 0532 0130 00")[0]
    assert upper.lower() == lower != "de89 3704 0044 0532 0130 00" and p.iban_rest(lower) == 1 and upper[2:] == lower[2:]
    new, got = values("gb82 west 1234 5698 7654 32, and AT61 1904 3002 3457 3201 sent to me")
    assert [k for k, _ in got] == ["iban", "iban"] and all(p.iban_rest(v) == 1 for _, v in got) and new.endswith(" sent to me")
    assert values("de00 3704 0044 0532 0130 00")[1] == [] or values("de00 3704 0044 0532 0130 00")[1][0][0] != "iban"


def test_long_numbers_stay_digits():
    body = "12345678901234567"
    text = body + str((10 - p.luhn(body + "0")) % 10)
    new, got = values(text)
    assert got == [("number", new)] and new.isdecimal() and p.luhn(new) == 0 and new != text


def test_unchanged_values_are_not_reported():
    assert values("_@x.com") == ("_@x.com", [])
    for name in "abcdefghijklmnopqrstuvwxyz":
        new, got = values(f"{name}@x.com")
        assert bool(got) == (new != f"{name}@x.com")
