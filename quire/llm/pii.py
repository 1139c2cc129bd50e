"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Values are found by one regular expression, validated (check digits, calendar,
ranges) and replaced by a keyed permutation of their own format: a Feistel
network whose round function is SHA-256 over key, format and the other half.
The permutation depends on nothing but key, format and value, so equal values
get equal pseudonyms in all documents, different values different ones, and
the result is again a valid value of the format. Everything is built from
DataFrame functions.

==========  ==================================  ==============================
kind        validated by                        kept as it is
==========  ==================================  ==============================
card        13 to 19 digits, Luhn check digit   separators (check digit anew)
iban        modulo 97                           country (check digits anew)
ssn         area, group and serial ranges       dashes
ip          four numbers up to 255              dots
phone       8 to 15 digits                      country code, separators
date        calendar, years 1800 to 2199        century, field order, separators
email       name (64 characters) and domain     domain, signs in the name
==========  ==================================  ==============================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
RUN = 64  # candidates taken together

# Names have at most 64 characters and domains at most 127 labels of 63 (the
# limits of mail and DNS), so a match costs the same in texts of any length.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}" \
        r"\.[A-Za-z]{2,63}"
DATE = r"\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{4}\.\d{1,2}\.\d{1,2}" \
       r"|\d{1,2}-\d{1,2}-\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}"
IP = r"(?:\d{1,3}\.){3}\d{1,3}(?!\.\d)"
SSN = r"\d{3}-\d{2}-\d{4}(?!-?\d)"
NEAR_PHONE = r"(?:1[.-])?\d{3}[.-]\d{3}[.-]\d{4}"
LONG_CARD = r"\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}"
# Values may stand directly beside letters of scripts written without spaces.
WORD = r"[\p{L}\p{N}_&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}" \
       r"\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]]"
END = f"(?!{WORD})"
DATE_END = rf"(?:{END}|(?=T\d))"  # a time may follow
# A further group after a blank must not be the start of another value.
OTHER = rf"(?:{DATE}){DATE_END}|(?:{IP}|{SSN}|{NEAR_PHONE}){END}|\d{{1,2}}/\d"
CARD = r"\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}" \
       rf"(?:(?: (?!{OTHER})|-)\d{{1,3}})?|\d{{4}}[ -]\d{{6}}[ -]\d{{5}}"
PHONE = rf"\+\d{{1,3}}(?: (?!(?:{LONG_CARD}){END})|[.-])?(?:\(\d{{1,4}}\)[ .-]?)?\d{{1,14}}" \
        rf"(?:(?: (?!(?:{LONG_CARD}){END}|{OTHER})|[.-])\d{{1,10}}){{0,5}}" \
        rf"|\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}|{NEAR_PHONE}"
IBAN = r"[A-Z]{2}\d{2}" rf"(?:(?: (?!{OTHER}))?[A-Z0-9]{{4}}){{2,7}}" \
       rf"(?:(?: (?!{OTHER}))?[A-Z0-9]{{1,3}})?"
# Matches nothing at every place where a candidate starts; group 1 is its longest form.
CANDIDATE = (rf"(?=[A-Za-z0-9+(])(?=((?<![A-Za-z0-9]){EMAIL}(?![A-Za-z0-9_])"
             rf"|(?<!{WORD}|[%+-])(?<!\d\.)(?:(?:{DATE}){DATE_END}|(?:"
             + "|".join([IP, SSN, CARD, PHONE, IBAN]) + f"){END})))")
# Forms with groups that may belong to what follows them, and the length that
# Visa and Mastercard numbers and those of the North American plan have.
SPLITS = r"^(?:\+|\d{4}[ -]\d{4}|[A-Z]{2}\d{2}[A-Z0-9 ]*$)"
USUAL = r"^(?:(?:4\d|5[1-5]|2[2-7])\d\d(?:[ -]\d{4}){3}|\+1(?:[ .()-]*\d){10})" + END

MONTH_DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _int(s: Column) -> Column:
    return s.try_cast("int")


def _at(s: Column, i: Column) -> Column:
    return F.substr(s, i, F.lit(1))


def _code(c: Column) -> Column:
    return F.ascii(c)


# --- Feistel networks -----------------------------------------------------
def _hash(key: str, tweak: Column, i: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), other, F.lit(key))
                  .cast("binary"), 256)


def _shift(s: Column, pad: Column) -> Column:
    """Move every digit and letter within its class by a keyed distance."""
    def one(i: Column) -> Column:
        c = _at(s, i)
        by = F.conv(F.substr(pad, (i - 1) % 15 * 4 + 1, F.lit(4)), 16, 10).cast("int")
        def inside(first: int, n: int) -> Column:
            return F.char(F.lit(first) + (_code(c) - first + by) % n)
        return (F.when(c.between("0", "9"), inside(48, 10))
                .when(c.between("a", "z"), inside(97, 26))
                .when(c.between("A", "Z"), inside(65, 26)).otherwise(c))
    return F.array_join(F.transform(
        F.filter(F.sequence(F.lit(1), F.length(s) + 1), lambda i: i <= F.length(s)), one), "")


def permute_text(s: Column, key: str, tweak: Column) -> Column:
    """Keyed permutation of the strings of one length whose characters keep
    their class (digit, lower-case or upper-case letter, other)."""
    half = F.floor(F.length(s) / 2).cast("int")
    tweak = F.concat_ws(":", tweak, F.length(s).cast("string"))
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"),
                     F.substr(s, half + 1, F.length(s)).alias("r"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start,
        lambda a, i: F.struct(a["r"].alias("l"),
                              _shift(a["l"], _hash(key, tweak, i, a["r"])).alias("r")),
        lambda a: F.concat(a["l"], a["r"]))


def permute_pair(left: Column, right: Column, n_left: Column, n_right: Column, key: str,
                 tweak: Column) -> Column:
    """Keyed permutation of the pairs of numbers below ``n_left`` and
    ``n_right``, as a struct ``l, r``."""
    big = [c.cast("long") for c in (left, right, n_left, n_right)]
    start = F.struct(big[0].alias("l"), big[1].alias("r"), big[2].alias("m"), big[3].alias("n"))

    def step(a: Column, i: Column) -> Column:
        by = F.conv(F.substr(_hash(key, tweak, i, a["r"].cast("string")), F.lit(1), F.lit(15)),
                    16, 10).cast("long")
        return F.struct(a["r"].alias("l"), ((a["l"] + by % a["m"]) % a["m"]).alias("r"),
                        a["n"].alias("m"), a["m"].alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _refill(template: Column, chars: Column, where: str) -> Column:
    """``template`` with its characters of class ``where`` taken from
    ``chars`` in order."""
    return F.aggregate(
        F.split(template, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
        lambda a, c: F.when(c.rlike(where), F.struct(
            F.concat(a["s"], _at(chars, a["i"])).alias("s"), (a["i"] + 1).alias("i")))
        .otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))),
        lambda a: a["s"])


# --- the formats ----------------------------------------------------------
def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum; every second digit from the right is doubled, starting with
    the ``doubled``-th."""
    def add(total: Column, i: Column) -> Column:
        d = _int(_at(digits, F.length(digits) + 1 - i))
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((i - doubled) % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    body = F.substr(_digits(m), F.lit(1), F.length(_digits(m)) - 1)
    new = permute_text(body, key, F.lit("card"))
    check = lambda d: ((10 - _luhn(d, 1) % 10) % 10).cast("string")
    full = F.element_at(F.transform(F.array(new), lambda d: F.concat(d, check(d))), 1)
    return F.element_at(F.transform(F.array(full), lambda d: _refill(m, d, "[0-9]")), 1)


def _mod97(s: Column) -> Column:
    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"),
                       lambda a, c: F.when(c.between("0", "9"), a * 10 + _int(c))
                       .otherwise(a * 100 + _code(c) - 55) % 97)


def _iban_rest(m: Column) -> Column:
    flat = F.replace(m, F.lit(" "), F.lit(""))
    return F.concat(F.substr(flat, F.lit(5)), F.substr(flat, F.lit(1), F.lit(2)))


def _iban(m: Column, key: str) -> Column:
    flat = F.replace(m, F.lit(" "), F.lit(""))
    country = F.substr(flat, F.lit(1), F.lit(2))
    new = permute_text(F.substr(flat, F.lit(5)), key, F.concat(F.lit("iban"), country))

    def whole(bban: Column) -> Column:
        check = F.lpad((98 - _mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(country, check, bban)
    full = F.element_at(F.transform(F.array(new), whole), 1)
    return F.element_at(F.transform(F.array(full), lambda s: _refill(m, s, "[A-Z0-9]")), 1)


def _part(m: Column, sep: str, i: int) -> Column:
    return _int(F.get(F.split(m, sep), F.lit(i)))


def _ip(m: Column, key: str) -> Column:
    p = [_part(m, r"\.", i) for i in range(4)]
    new = permute_pair(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536),
                       key, F.lit("ip"))
    return F.element_at(F.transform(F.array(new), lambda a: F.concat_ws(
        ".", *[x.cast("int").cast("string") for half in (a["l"], a["r"])
               for x in (F.floor(half / 256), half % 256)])), 1)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (_part(m, "-", i) for i in range(3))
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)  # 898 areas: not 000, 666, 900 on
    new = permute_pair(rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key,
                       F.lit("ssn"))

    def written(a: Column) -> Column:
        r = F.floor(a["l"] / 99).cast("int")
        area = r + 1 + F.when(r >= 665, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"),
                           F.lpad((a["l"] % 99 + 1).cast("string"), 2, "0"),
                           F.lpad((a["r"] + 1).cast("string"), 4, "0"))
    return F.element_at(F.transform(F.array(new), written), 1)


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^(?:\+(?:\d{1,3}(?=[ .(-])|\d{2}|1)|1[.-])", 0)
    rest = F.substr(m, F.length(code) + 1)
    new = permute_text(_digits(rest), key, F.concat(F.lit("phone"), code))
    return F.concat(code, F.element_at(
        F.transform(F.array(new), lambda d: _refill(rest, d, "[0-9]")), 1))


def _email(m: Column, key: str) -> Column:
    name, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(permute_text(name, key, F.lit("email")), F.lit("@"), domain)


def _date_parts(m: Column) -> Column:
    """``y, m, d`` and ``form``: 1 year first, 2 day first with a point,
    3 month first, 4 day first because the first field is over 12."""
    f = F.split(m, "[-/.]")
    a, b, c = (_int(F.get(f, F.lit(i))) for i in range(3))
    form = (F.when(m.rlike(r"^\d{4}"), 1).when(m.contains("."), 2)
            .when(a <= 12, 3).otherwise(4))
    return F.element_at(F.transform(F.array(F.struct(
        a.alias("a"), b.alias("b"), c.alias("c"), form.alias("form"))), lambda p: F.struct(
            F.when(p["form"] == 1, p["a"]).otherwise(p["c"]).alias("y"),
            F.when(p["form"] == 3, p["a"]).otherwise(p["b"]).alias("m"),
            F.when(p["form"] == 1, p["c"]).when(p["form"] == 3, p["b"])
            .otherwise(p["a"]).alias("d"), p["form"].alias("form"))), 1)


def _is_date(p: Column) -> Column:
    y = p["y"]
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.get(F.array(*map(F.lit, MONTH_DAYS)), p["m"] - 1) \
        + F.when(leap & (p["m"] == 2), 1).otherwise(0)
    return y.between(1800, 2199) & p["m"].between(1, 12) & (p["d"] >= 1) & (p["d"] <= last)


def _date(m: Column, key: str) -> Column:
    """Dates are permuted within their century: common days as (day of the
    year, year), 29 February among the leap years. Day-first dates with a
    first field over 12 keep a day over 12, so that they still read so."""
    def new(p: Column) -> Column:
        century = F.floor(p["y"] / 100).cast("int")
        year, form = p["y"] % 100, p["form"]
        tweak = F.concat_ws(":", F.lit("date"), century.cast("string"))
        out = F.when((p["m"] == 2) & (p["d"] == 29),
                     _leap_day(century, year, key, tweak))
        for high, first in ((True, 13), (False, 1)):
            starts = [sum(x - first + 1 for x in MONTH_DAYS[:i]) for i in range(12)]
            n = sum(x - first + 1 for x in MONTH_DAYS)
            at = F.array(*map(F.lit, starts))
            moved = permute_pair(F.get(at, p["m"] - 1) + p["d"] - first, year, F.lit(n),
                                 F.lit(100), key, F.concat_ws(":", tweak, F.lit(str(first))))

            value = F.element_at(F.transform(F.array(moved), _named(century, at, first)), 1)
            out = out.when(form == 4, value) if high else out.otherwise(value)
        return out

    def written(p: Column) -> Column:
        sep = F.regexp_extract(m, "[-/.]", 0)
        wide = lambda s: F.when(m.rlike(r"^\d{4}.\d{2}.\d{2}$|^\d{2}.\d{2}.\d{4}$"),
                                F.lpad(s.cast("string"), 2, "0")).otherwise(s.cast("string"))
        q = p["new"]
        y = F.lpad(q["y"].cast("string"), 4, "0")
        joined = lambda a, b, c: F.concat(a, sep, b, sep, c)
        return (F.when(p["form"] == 1, joined(y, wide(q["m"]), wide(q["d"])))
                .when(p["form"] == 3, joined(wide(q["m"]), wide(q["d"]), y))
                .otherwise(joined(wide(q["d"]), wide(q["m"]), y)))
    return F.element_at(F.transform(F.transform(
        F.array(_date_parts(m)), lambda p: F.struct(p["form"].alias("form"), new(p).alias("new"))),
        written), 1)


def _named(century: Column, starts: Column, first: int):
    """Date of a permuted (day of the year, year) pair."""
    def date(a: Column) -> Column:
        month = F.size(F.filter(starts, lambda s: s <= a["l"]))
        return F.struct((century * 100 + a["r"]).cast("int").alias("y"), month.alias("m"),
                        (a["l"] - F.get(starts, month - 1) + first).cast("int").alias("d"))
    return date


def _leap_day(century: Column, year: Column, key: str, tweak: Column) -> Column:
    full = century % 4 == 0  # 25 leap years, else 24: the first is none
    k = F.floor(year / 4).cast("int") - F.when(full, 0).otherwise(1)
    n = F.when(full, 5).otherwise(6)
    moved = permute_pair(F.floor(k / n), k % n, F.when(full, 5).otherwise(4), n, key,
                         F.concat_ws(":", tweak, F.lit("leap")))
    return F.element_at(F.transform(F.array(moved), lambda a: F.struct(
        (century * 100 + 4 * (a["l"] * n + a["r"] + F.when(full, 0).otherwise(1))).cast("int")
        .alias("y"), F.lit(2).alias("m"), F.lit(29).alias("d"))), 1)


def _kind(m: Column) -> Column:
    """Kind of a candidate that passes its validation, else null."""
    digits = _digits(m)
    ssn_area = _part(m, "-", 0)
    is_ssn = (ssn_area.between(1, 899) & (ssn_area != 666) & (_part(m, "-", 1) > 0)
              & (_part(m, "-", 2) > 0))
    def like(pattern: str) -> Column:
        return m.rlike(f"^(?:{pattern})$")
    return (F.when(m.contains("@"), F.lit("email"))
            .when(like(DATE) & _is_date(_date_parts(m)), F.lit("date"))
            .when(like(r"(?:\d{1,3}\.){3}\d{1,3}"),
                  F.when(F.forall(F.split(m, r"\."), lambda x: _int(x) <= 255), F.lit("ip")))
            .when(like(r"\d{3}-\d{2}-\d{4}"), F.when(is_ssn, F.lit("ssn")))
            .when(like(CARD) & (F.length(digits) >= 13) & (_luhn(digits, 2) % 10 == 0),
                  F.lit("card"))
            .when(like(PHONE) & F.length(digits).between(8, 15), F.lit("phone"))
            .when(like(IBAN) & (F.length(_iban_rest(m)) >= 13) & (_mod97(F.concat(
                _iban_rest(m), F.substr(m, F.lit(3), F.lit(2)))) == 1), F.lit("iban")))


def _valid(m: Column) -> Column:
    """``kind`` and ``value`` of the valid value a candidate begins with, else
    null: the usual length of its network, else the most groups."""
    groups = F.split(m, "(?=[ .-])")
    fewer = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)),
                        lambda k: F.array_join(F.slice(groups, F.lit(1), k), ""))
    forms = F.when(m.rlike(SPLITS), F.filter(F.concat(
        F.array(F.regexp_extract(m, USUAL, 0)), fewer), lambda x: x != "")) \
        .otherwise(F.array(m))
    return F.get(F.filter(F.transform(
        forms, lambda x: F.struct(_kind(x).alias("kind"), x.alias("value"))),
        lambda x: x["kind"].isNotNull()), F.lit(0))


_PERMUTE = {"email": _email, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card,
            "phone": _phone, "iban": _iban}


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    out = None
    for name, permute in _PERMUTE.items():
        out = (F if out is None else out).when(kind == name, permute(m, key))
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with the personal values of ``text`` replaced and a column
    ``out``: ``kind`` and ``value`` (the pseudonym) of each, in order.

    The length of a text may change only where a date is written without
    leading zeros or an address number takes more digits. A null text stays
    null with an empty list, an empty one empty; repeated rows and other
    columns stay; a column named ``out`` is replaced. A candidate that fails
    its validation is tried with fewer groups; where none passes, the text is
    searched on from the next place where a candidate starts.
    """
    t, zipped_name = F.col(text), "_candidates"
    while zipped_name in docs.columns:
        zipped_name = f"_{zipped_name}"
    pieces = F.split(t, CANDIDATE, -1)  # each but the first starts at a candidate
    valid = F.transform(F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(1)), _valid)
    nothing = F.array(F.lit(None).cast("struct<kind:string,value:string>"))
    out_type = "array<struct<kind:string,value:string,rest:string>>"

    def take(a: Column, x: Column) -> Column:
        """Starts inside a value taken before are passed over."""
        size = F.length(x["piece"])
        hit = (a["skip"] == 0) & x["valid"].isNotNull()
        used = F.when(hit, F.length(x["valid"]["value"])).otherwise(a["skip"])
        row = F.struct(F.when(hit, x["valid"]["kind"]).alias("kind"),
                       F.when(hit, x["valid"]["value"]).alias("value"),
                       F.substr(x["piece"], used + 1).alias("rest"))
        return F.struct(
            F.greatest(used - size, F.lit(0)).alias("skip"),
            F.when(~hit & (used >= size), a["out"])
            .otherwise(F.concat(a["out"], F.array(row))).cast(out_type).alias("out"))
    def take_some(a: Column, some: Column) -> Column:
        """A text's list grows by a run of candidates at a time: it is copied
        whenever it grows."""
        return F.aggregate(some, F.struct(a["skip"].alias("skip"), F.array().cast(out_type)
                                          .alias("out")), take, lambda b: F.struct(
            b["skip"].alias("skip"), F.concat(a["out"], b["out"]).cast(out_type).alias("out")))
    zipped = F.arrays_zip(pieces.alias("piece"), F.when(
        F.size(pieces) > F.size(out), F.concat(nothing, F.col(out)))
        .otherwise(F.col(out)).alias("valid"))
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(zipped_name) / RUN).cast("int")),
                       lambda i: F.slice(zipped_name, i * RUN + 1, RUN))
    taken = docs.withColumn(out, F.when(t.rlike("[0-9@]"), valid)).withColumn(
        zipped_name, F.when(F.exists(out, lambda x: x.isNotNull()), zipped)).withColumn(
        out, F.when(F.col(zipped_name).isNotNull(), F.aggregate(
            runs, F.struct(F.lit(0).alias("skip"), F.array().cast(out_type).alias("out")),
            take_some, lambda a: a["out"]))).drop(zipped_name)
    some = taken.withColumn(out, F.transform(out, lambda x: F.struct(
        x["kind"].alias("kind"), pseudonym(x["value"], x["kind"], key).alias("value"),
        x["rest"].alias("rest"))))
    rebuilt = F.array_join(F.transform(
        out, lambda x: F.concat(F.coalesce(x["value"], F.lit("")), x["rest"])), "")
    none = F.array().cast("array<struct<kind:string,value:string>>")
    values = F.transform(F.filter(out, lambda x: x["kind"].isNotNull()),
                         lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value")))
    return some.withColumn(text, F.when(F.col(out).isNotNull(), rebuilt).otherwise(t)) \
        .withColumn(out, F.coalesce(values, none))
