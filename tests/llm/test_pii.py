"""Pseudonyms: formats, validation, linkage and one-to-one mapping."""

import datetime
import re

from pyspark.sql import functions as F

from quire.llm import pii

KEY = "k"


def run(spark, texts, key=KEY):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = pii.pseudonymise(docs, key).orderBy("doc_id").collect()
    return [r.text for r in rows], [[x.kind for x in r.pii] for r in rows]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


VALID = {
    "card": ["4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"],
    "ip": ["10.0.0.255", "255.255.255.255"],
    "ssn": ["123-45-6789", "899-01-0001"],
    "phone": ["+1 (389) 555-5010", "+4915123456789", "(212) 555-0100", "212-555-0100"],
    "date": ["2024-02-29", "1999/12/31", "31.12.1999", "12/25/1990", "25/12/1990", "5.6.2001"],
    "email": ["some.one+42@mail.example.com"],
    "iban": ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19"],
}
SHAPE = str.maketrans("0123456789", "9" * 10)


def test_kinds_and_formats(spark):
    for kind, values in VALID.items():
        texts, kinds = run(spark, [f"see ({v}), or {v}." for v in values])
        for value, text, found in zip(values, texts, kinds):
            assert found == [kind, kind], (value, text, found)
            new = re.fullmatch(r"see \((.*)\), or (.*)\.", text)
            assert new[1] == new[2] != value
            if kind == "card":
                assert luhn(new[1])
            if kind not in ("email", "iban", "ip") and value != "5.6.2001":
                assert new[1].translate(SHAPE) == value.translate(SHAPE)
            if kind == "iban":
                s = new[1].replace(" ", "")
                assert int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
            if kind == "ip":
                assert all(0 <= int(x) <= 255 for x in new[1].split("."))
            # A pseudonym is a valid value of the same kind again.
            assert run(spark, [f"see ({new[1]}), or {new[1]}."])[1] == [[kind, kind]]


def test_what_fails_validation_stays(spark):
    texts = ["4111111111111112", "300.1.1.1", "1.2.3.4.5", "000-45-6789", "2023-02-29",
             "31/31/2000", "token 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "Version 2.0.",
             "DE89370400440532013001", "12345678", None, "", "no digits at all", "a@b", "\x01 1"]
    got, kinds = run(spark, texts)
    assert got == texts and not any(kinds)


def test_one_to_one_and_keyed(spark):
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(d) for d in range(0, 4000, 3)]
    values = ([f"{d:%Y-%m-%d}" for d in days] + [f"{d:%d/%m/%Y}" for d in days]
              + [f"192.168.{i // 250}.{i % 250}" for i in range(1000)]
              + [f"{100 + i // 90}-{10 + i % 90}-{1000 + i}" for i in range(1000)])
    values = list(dict.fromkeys(values))
    new, kinds = run(spark, values)
    assert all(len(k) == 1 for k in kinds)
    assert len(set(new)) == len(values)
    other, _ = run(spark, values[:50], key="another")
    assert other != new[:50]
    assert run(spark, values[:50])[0] == new[:50]  # equal over documents and runs


def test_all_leap_days_stay_apart(spark):
    values = [f"{y}-02-29" for y in range(1904, 2100, 4)]
    new, _ = run(spark, values)
    assert len(set(new)) == len(values)
    assert all(datetime.date.fromisoformat(x).strftime("%m-%d") == "02-29" for x in new)


def test_rows_and_columns(spark):
    """Repeated rows, a column named pii, long text, empty table; no Python."""
    schema = "doc_id long, text string, pii string, kind int"
    long = "word " * 100_000 + "10.1.2.3"
    docs = spark.createDataFrame([(1, "10.1.2.3", "x", 1), (1, "10.1.2.3", "x", 1),
                                  (None, long, None, None)], schema)
    out = pii.pseudonymise(docs, KEY)
    rows = out.collect()
    assert set(out.columns) == set(docs.columns) and len(rows) == 3
    assert rows[0].text == rows[1].text and rows[2].text == "word " * 100_000 + rows[0].text
    assert pii.pseudonymise(docs.filter("false"), KEY).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert out.select(F.size("pii")).first()[0] == 1


def test_values_beside_other_numbers(spark):
    """A value is found whatever stands after it: numbers, words, other values."""
    alone = [(kind, v) for kind, values in VALID.items() for v in values]
    alone += [("card", "378282246310005"), ("card", "3782 822463 10005"),
              ("phone", "+1-202-555-0143"), ("phone", "+33 1 23 45 67 89"),
              ("phone", "+49 30 1234567"), ("iban", "BE68 5390 0754 7034"),
              ("iban", "NO93 8601 1117 947")]
    new, kinds = run(spark, [v for _, v in alone])
    assert kinds == [[k] for k, _ in alone]
    values = dict(zip([v for _, v in alone], new))
    after = ["90210", "12/25", "BIC", "EUR 5", "75001 Paris"]
    texts = [f"{v} {x}" for v in values for x in after]
    got, _ = run(spark, texts)
    assert got == [f"{values[v]} {x}" for v in values for x in after]
    pairs = [(a, b) for a in alone for b in alone]
    got, kinds = run(spark, [f"{a} {b}" for (_, a), (_, b) in pairs])
    assert kinds == [[j, k] for (j, _), (k, _) in pairs]
    assert got == [f"{values[a]} {values[b]}" for (_, a), (_, b) in pairs]
    # What fails before a value, and card, expiry and check number in one line.
    got, kinds = run(spark, ["1234 4111 1111 1111 1111", "4111 1111 1111 1111 12/25 123",
                             "4111 1111 1111 1111 123", "+1 202 555 0143 192.168.1.5"])
    assert kinds == [["card"], ["card"], ["card"], ["phone", "ip"]]
    assert got[1] == values["4111 1111 1111 1111"] + " 12/25 123"
    assert got[2] == values["4111 1111 1111 1111"] + " 123"


def test_values_beside_letters_and_signs(spark):
    """Only characters of a value's own format keep it from being one."""
    values = ["2024-01-15", "bob.roe@example.com", "1-800-555-1234", "4111 1111 1111 1111"]
    new, kinds = run(spark, values)
    assert kinds == [["date"], ["email"], ["phone"], ["card"]]
    assert new[2].startswith("1-") and new[2][1:] != values[2][1:]
    date, mail, _, card = values
    texts = [f"at {date}T10:30:00Z.", f"-{mail}", f"_{mail}", f"\u8054\u7cfb{mail}\u8c22\u8c22",
             f"\u65e5\u671f{date}\u65e5", f"\u0e17\u0e35\u0e48{card}\u0e04",
             f"+33 1 23 45 67 89 {date}T10:30:00Z"]
    got, kinds = run(spark, texts)
    assert kinds == [["date"], ["email"], ["email"], ["email"], ["date"], ["card"],
                     ["phone", "date"]]
    for text, out, old, pseudo in zip(texts, got, [date, mail, mail, mail, date, card],
                                      [new[0], new[1], new[1], new[1], new[0], new[3]]):
        assert out == text.replace(old, pseudo)
    assert got[6].endswith(f" {new[0]}T10:30:00Z")
    stay = [f"x{date}", f"{date}x", f"{date}Tx", f"{card}x", "v10.0.0.1", f"{mail}_x"]
    assert run(spark, stay) == (stay, [[]] * len(stay))


def test_texts_that_repeat_without_end(spark):
    """Long runs of labels, names, digits, marks and dates: no crash, time in
    proportion, other rows as they are."""
    import time

    texts = ["x@" + "a." * 100_000 + "com", "x@" + "ab." * 50_000 + "com", "a." * 300_000,
             "a" * 1_000_000, "1" * 500_000, "1-" * 200_000, "+1 " * 100_000, "(" * 500_000,
             "AB12 " * 50_000, "@" * 300_000, "mail me: jo@example.org"]
    t = time.time()
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "i int, text string"),
                           "k").orderBy("i").collect()
    assert time.time() - t < 90
    assert [len(r.text) for r in got] == [len(x) for x in texts]
    assert [p.kind for p in got[-1].pii] == ["email"] and "jo@" not in got[-1].text
    assert got[0].text == texts[0] and [p.kind for p in got[1].pii] == ["email"]


def test_clashing_names(spark):
    df = spark.createDataFrame([("born 1980-02-03", "mine", 1)], "text string, pii string, "
                               "_candidates int")
    (r,) = pii.pseudonymise(df, "k", out="found").collect()
    assert (r.pii, r._candidates) == ("mine", 1) and r.found[0].kind == "date"
