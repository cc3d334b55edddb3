"""Format-preserving Feistel pseudonyms for personal data, by Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

ROUNDS = 8
#: Dates are permuted within this many months from January of FIRST_YEAR on; dates outside stay as they are.
FIRST_YEAR, MONTHS = 1900, 2400
#: Steps over days that a month lacks, one in thirty, at most.
WALKS = 24

#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """In fours or without spaces, at the country's length; digits of other countries, and their codes without spaces."""
    group = lambda n: rf"(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"(?: ?[A-Z0-9]{{{n % 4}}})" if n % 4 else "")
    known = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}{group(n)}" for n, c in IBAN_LENGTHS.items())
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}})(?:{known}|[A-Z]{{2}}\d{{2}}(?:(?: ?\d{{4}}){{3,6}}(?: ?\d{{1,3}})?|[A-Z0-9]{{11,30}}))(?![A-Za-z0-9])"


#: What a space within a phone number isn't before: another date, address, security or card number.
OTHER = r"(?!\d{4}-\d{2}-\d{2}|\d{2}[/.]\d{2}[/.]\d{4}|(?:\d{1,3}\.){3}\d|\d{3}-\d{2}-\d{4}|\d{4}[ -]\d{4,6}[ -]\d{4}|\d{13})"

# Names that secrets are given to, and beginnings of keys that some services issue.
SECRET_NAMES = "passwords?|passwd|pwd|passphrase|secrets?|tokens?|api[_ -]?keys?|secret[_ -]?keys?|access[_ -]?keys?|private[_ -]?keys?|credentials?"
ISSUED = r"gh[pousr]_|github_pat_|glpat-|sk-|xox[abeprs]-|AIza|hf_|npm_"
#: `name=`, `name :`, `"name": "` and the like, in any case.
GIVEN = rf"(?i:{SECRET_NAMES})[\"']?[ \t]{{0,3}}(?::=|=>|[=:])[ \t]{{0,3}}"

# What each kind of value looks like. Each is validated before it is replaced.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "issued": rf"(?<![A-Za-z0-9_-])(?:{ISSUED})[A-Za-z0-9_-]{{16,}}|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}",
    # in quotes anything; bare after `=` anything, after `:` what has a digit, as prose has colons too
    "secret": rf"{GIVEN}(?:\"[^\s\"]{{6,}}|'[^\s']{{6,}}|(?<![:>][ \t]{{0,3}})[^\s\"']{{6,}}|(?=[^\s\"']{{0,200}}\d)[^\s\"']{{6,}})",
    "iban": _iban_pattern(),
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])(?:1 )?[2-9]\d{2} [2-9]\d{2}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d(?:(?:[ .-]" + OTHER + r")?\(?\d\)?){7,14}(?!\d)",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d]|\.\d)",
}
#: Secrets come first, in a group of their own: what stands where a secret does is one, whatever it looks like.
ANY = "|".join([f"({PATTERNS['secret']})", *(f"(?:{p})" for k, p in PATTERNS.items() if k != "secret")])


def feistel(x: Column, size_x: Column, y: Column, size_y: Column, key: str, kind: str) -> Column:
    """Keyed permutation of [0, size_x) x [0, size_y): each round adds a hash of one half to the other, modulo its size."""

    def turn(s, r):
        mixed = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r, s["y"], s["m"], s["n"]).cast("binary"), 256), 1, 15), 16, 10).cast("long")
        return F.struct(s["y"].alias("x"), F.pmod(s["x"] + mixed, s["m"]).alias("y"), s["n"].alias("m"), s["m"].alias("n"))

    start = F.struct(*[c.cast("long").alias(k) for k, c in (("x", x), ("y", y), ("m", size_x), ("n", size_y))])
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """`m` with its digits replaced, one by one, by `digits`."""
    at = F.sequence(F.lit(1), F.length(m))
    return F.array_join(F.transform(at, lambda j: let(F.substr(m, j, F.lit(1)), lambda c: F.when(c.between("0", "9"), F.substr(digits, F.length(_digits(F.substr(m, F.lit(1), j))), F.lit(1))).otherwise(c))), "")


def _pad(value: Column, n: Column) -> Column:
    return F.lpad(value.cast("string"), n, F.lit("0"))


def _luhn(d: Column) -> Column:
    n = F.length(d)
    one = F.transform(F.sequence(F.lit(1), n), lambda j: let(F.substr(d, j, F.lit(1)).cast("int") * F.when((n - j) % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(one, F.lit(0), lambda a, v: a + v) % 10


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _permute_digits(d: Column, key: str, kind: str) -> Column:
    """Permutation of the digit strings of one length (up to 34), halved."""
    n = F.length(d)
    a = F.floor(n / 2).cast("int")

    def joined(s):
        return F.concat(F.when(a > 0, _pad(s["x"], a)).otherwise(F.lit("")), _pad(s["y"], n - a))

    left = F.when(a > 0, F.substr(d, F.lit(1), a).cast("long")).otherwise(F.lit(0))
    return let(feistel(left, _power(a), F.substr(d, a + 1, n - a).cast("long"), _power(n - a), key, kind), joined)


def _card(m: Column, key: str) -> Column:
    def made(d):
        n = F.length(d)
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), _permute_digits(F.substr(d, F.lit(2), n - 2), key, "card"))
        return F.when(_luhn(d) == 0, let(body, lambda b: _refill(m, F.concat(b, F.pmod(F.lit(10) - _luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))))

    return let(_digits(m), made)


def _phone(m: Column, key: str) -> Column:
    """The ten national digits, with or without +1 before them, or those after the first two of another international number."""

    def made(d):
        n = F.when(m.startswith("+") & ~(m.startswith("+1") & (F.length(d) == 11)), F.length(d) - 2).otherwise(F.lit(10))
        return let(n, lambda k: _refill(m, F.concat(F.substr(d, F.lit(1), F.length(d) - k), _permute_digits(F.substr(d, F.length(d) - k + 1, k), key, "phone"))))

    return let(_digits(m), made)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.substr(m, F.lit(i), F.lit(k)).cast("long") for i, k in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = area - 1 - F.when(area > 666, 1).otherwise(0)

    def made(s):
        a = s["x"] + 1 + F.when(s["x"] >= 665, 1).otherwise(0)
        return F.concat_ws("-", _pad(a, F.lit(3)), _pad(F.floor(s["y"] / 9999) + 1, F.lit(2)), _pad(s["y"] % 9999 + 1, F.lit(4)))

    return F.when(valid, let(feistel(index, F.lit(898), (group - 1) * 9999 + serial - 1, F.lit(99 * 9999), key, "ssn"), made))


def _ip(m: Column, key: str) -> Column:
    def made(p):
        o = [F.get(p, F.lit(i)).cast("long") for i in range(4)]
        valid = (o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256)
        text = lambda s: F.concat_ws(".", F.floor(s["x"] / 256), s["x"] % 256, F.floor(s["y"] / 256), s["y"] % 256)
        return F.when(valid, let(feistel(o[0] * 256 + o[1], F.lit(65536), o[2] * 256 + o[3], F.lit(65536), key, "ip"), text))

    return let(F.split(m, r"\."), made)


def _date(m: Column, key: str) -> Column:
    """Months and days are permuted, days over 12 among such: so a day's pseudonym is one day in every form, and a slash
    date that is read as day first for its day over 12 becomes another such."""
    form = F.when(m.contains("-"), F.lit("yyyy-MM-dd")).when(m.contains("."), F.lit("dd.MM.yyyy")).when(F.substr(m, F.lit(1), F.lit(2)).cast("int") > 12, F.lit("dd/MM/yyyy")).otherwise(F.lit("MM/dd/yyyy"))
    part = lambda f, iso, us, other: F.when(f == "yyyy-MM-dd", F.substr(m, *map(F.lit, iso))).when(f == "MM/dd/yyyy", F.substr(m, *map(F.lit, us))).otherwise(F.substr(m, *map(F.lit, other)))
    date = lambda month, day: F.try_to_date(F.concat_ws("-", F.lit(FIRST_YEAR) + F.floor(month / 12), month % 12 + 1, day), "yyyy-M-d")

    def moved(v):
        f, late = v["f"], v["day"] > 12
        low, size = F.when(late, 13).otherwise(1), F.when(late, 19).otherwise(12)

        def walk(s, i):
            """February has no 30th: such days are walked over."""
            to = let(feistel(s["x"], F.lit(MONTHS), s["y"], size, key, "date"), lambda z: F.struct(z["x"].alias("x"), z["y"].alias("y"), date(z["x"], z["y"] + low).isNotNull().alias("done")))
            return F.when(s["done"], s).otherwise(to)

        start = F.struct(v["month"].cast("long").alias("x"), (v["day"] - low).cast("long").alias("y"), F.lit(False).alias("done"))
        new = let(F.aggregate(F.sequence(F.lit(0), F.lit(WALKS)), start, walk), lambda s: date(s["x"], s["y"] + low))
        text = let(new, lambda t: F.when(f == "yyyy-MM-dd", F.date_format(t, "yyyy-MM-dd")).when(f == "dd.MM.yyyy", F.date_format(t, "dd.MM.yyyy")).when(f == "dd/MM/yyyy", F.date_format(t, "dd/MM/yyyy")).otherwise(F.date_format(t, "MM/dd/yyyy")))
        return F.when(v["month"].between(0, MONTHS - 1) & date(v["month"], v["day"]).isNotNull(), text)

    def parts(f):
        y, mo, d = (part(f, *at).cast("int") for at in (((1, 4), (7, 4), (7, 4)), ((6, 2), (1, 2), (4, 2)), ((9, 2), (4, 2), (1, 2))))
        month = F.when(mo.between(1, 12), (y - FIRST_YEAR) * 12 + mo - 1).otherwise(-1)
        return let(F.struct(f.alias("f"), month.alias("month"), d.alias("day")), moved)

    return let(form, parts)


def _letters(m: Column) -> Column:
    return F.regexp_replace(m, "[^A-Z]", "")


def _permute_letters(a: Column, key: str, kind: str) -> Column:
    """Permutation of the strings of A-Z of one length (up to 26), halved."""
    n = F.length(a)
    k = F.floor(n / 2).cast("int")
    size = lambda n: F.aggregate(F.sequence(F.lit(0), n), F.lit(1).cast("long"), lambda p, i: F.when(i == 0, p).otherwise(p * 26))
    value = lambda t: F.aggregate(F.split(t, ""), F.lit(0).cast("long"), lambda v, c: F.when(c == "", v).otherwise(v * 26 + F.ascii(c) - 65))

    def text(v, n):
        done = F.aggregate(F.sequence(F.lit(0), n), F.struct(v.alias("v"), F.lit("").alias("t")), lambda s, i: F.when(i == 0, s).otherwise(F.struct(F.floor(s["v"] / 26).alias("v"), F.concat(F.char((s["v"] % 26 + 65)), s["t"]).alias("t"))))
        return done["t"]

    made = let(feistel(value(F.substr(a, F.lit(1), k)), size(k), value(F.substr(a, k + 1, n - k)), size(n - k), key, kind), lambda s: F.concat(text(s["x"], k), text(s["y"], n - k)))
    return F.when(n > 0, made).otherwise(F.lit(""))


def _refill_both(m: Column, digits: Column, letters: Column) -> Column:
    """`m` with its digits and capitals replaced, one by one."""

    def at(j):
        c, upto = F.substr(m, j, F.lit(1)), F.substr(m, F.lit(1), j)
        return F.when(c.between("0", "9"), F.substr(digits, F.length(_digits(upto)), F.lit(1))).when(c.between("A", "Z"), F.substr(letters, F.length(_letters(upto)), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), at), "")


def _mod97(t: Column) -> Column:
    """Of digits and capitals, these as 10 to 35."""
    step = lambda v, c: F.when(c == "", v).when(c.between("0", "9"), (v * 10 + F.ascii(c) - 48) % 97).otherwise((v * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(t, ""), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    """Validated modulo 97; the account's digits and letters are permuted and the check digits made anew."""

    def made(c):
        country, check, account = F.substr(c, F.lit(1), F.lit(2)), F.substr(c, F.lit(3), F.lit(2)), F.substr(c, F.lit(5))
        digits = let(_digits(account), lambda d: F.when(F.length(d) > 0, _permute_digits(d, key, "iban")).otherwise(F.lit("")))
        # two parts, so that the halves of each fit in 64 bits
        letters = let(_letters(account), lambda a: F.concat(_permute_letters(F.substr(a, F.lit(1), F.lit(16)), key, "iban-a"), _permute_letters(F.substr(a, F.lit(17), F.lit(99)), key, "iban-b")))
        changed = let(F.struct(digits.alias("d"), letters.alias("a")), lambda s: F.struct(s["d"].alias("d"), s["a"].alias("a"), _refill_both(account, s["d"], s["a"]).alias("t")))
        anew = lambda s: _refill_both(m, F.concat(_pad(F.lit(98) - _mod97(F.concat(s["t"], country, F.lit("00"))), F.lit(2)), s["d"]), F.concat(country, s["a"]))
        return F.when((F.length(account).between(11, 30)) & (_mod97(F.concat(account, country, check)) == 1), let(changed, anew))

    return let(F.regexp_replace(m, " ", ""), made)


def _hashed(m: Column, key: str, kind: str, n) -> Column:
    return F.substr(F.repeat(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), m).cast("binary"), 256), F.lit(8)), F.lit(1), n)


def _secret(m: Column, key: str) -> Column:
    """What it is given to stays; so does a quote before the value, which is hashed."""
    given = F.regexp_extract(m, rf"^{GIVEN}[\"']?", 0)

    def made(p):
        value = F.substr(m, F.length(p) + 1)
        return F.concat(p, _hashed(value, key, "secret", F.least(F.length(value), F.lit(512))))

    return let(given, made)


def pseudonym(m: Column, secret: Column, key: str) -> Column:
    """Replacement of one match; null where it isn't valid, so it stays. `secret`: it stands where a secret does."""
    is_ = lambda k: F.regexp_like(m, F.lit(rf"^(?:{PATTERNS[k]})$"))
    return (
        F.when(secret, _secret(m, key))
        .when(m.contains("@"), F.concat(F.lit("u"), _hashed(m, key, "email", F.lit(14)), F.lit("@example.org")))
        .when(is_("issued"), let(F.regexp_extract(m, rf"^(?:{ISSUED})", 0), lambda p: F.concat(p, _hashed(m, key, "secret", F.least(F.length(m) - F.length(p), F.lit(512))))))
        .when(is_("key"), F.concat(F.lit("AKIA"), F.upper(_hashed(m, key, "key", F.lit(16)))))
        .when(is_("iban"), _iban(m, key))
        .when(is_("date"), _date(m, key))
        .when(is_("ip"), _ip(m, key))
        .when(is_("ssn"), _ssn(m, key))
        .when(is_("phone"), _phone(m, key))
        .when(is_("card"), _card(m, key))
    )


def replace_private(text: Column, key: str) -> Column:
    """struct(text, n): the text with its private values replaced, and how many were."""

    def rebuilt(found):
        def made(new):
            pieces = F.split(text, ANY, -1)
            whole = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(new, i), F.get(found, i), F.lit("")))), "")
            return F.struct(whole.alias("text"), F.size(F.filter(new, lambda x: x.isNotNull())).cast("long").alias("n"))

        secrets = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(1)), lambda x: x != "")
        return F.when(F.size(found) > 0, let(let(secrets, lambda on: F.transform(found, lambda m, i: pseudonym(m, F.get(on, i), key))), made)).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))

    return let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), rebuilt)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with `text` replaced and n_private added; every other column stays. `key` is the caller's secret.

    Cards (Luhn), IBANs (modulo 97), dates, IPv4 addresses, social security and phone numbers are permuted by a
    keyed Feistel network within their own format, so equal values get equal pseudonyms in all documents and
    unlike values unlike ones; a day is one day in every form of date. E-mail addresses and secrets have no finite
    format; they get keyed hashes of their form. Secrets are what is given to a name in SECRET_NAMES, in any case and
    also if it looks like a number (after a bare colon only if it has a digit; six characters at least), and keys that
    begin as in ISSUED, web tokens and AKIA keys; others are not found. Numbers that fail validation stay. Null text stays null (n_private 0); empty, very long and repeated texts are treated alike;
    an empty table gives no rows; a column n_private that is there already is replaced.
    """
    found = F.when(F.col("text").isNull(), F.struct(F.col("text").alias("text"), F.lit(0).cast("long").alias("n"))).otherwise(replace_private(F.col("text"), key))
    kept = [c for c in docs.columns if c.lower() != "n_private"]
    own = "_private"
    while own in [c.lower() for c in kept]:
        own += "_"
    made = docs.select(*[F.col(f"`{c}`") for c in kept], found.alias(own))
    return made.select(*[F.col(f"{own}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in kept], F.col(f"{own}.n").alias("n_private"))
