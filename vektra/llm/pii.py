"""Personal data: format-preserving Feistel pseudonyms, as DataFrame expressions only.

A value is found by pattern and validated (Luhn, mod 97, calendar, octets), then sent
through a keyed permutation of all values of its format: equal values get equal
pseudonyms in every document, different values different ones, and a pseudonym passes
the same validation. Who holds the key can invert it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let as _let
from .shared import named, scan, unused

ROUNDS = 8
#: The patterns of each kind, in the order in which they are tried at a place. Every repeat is bounded, so
#: that no text makes the matcher recurse deeply or start anew over long stretches; an address has 64 signs before the @
#: and 127 labels behind it at most, as mail systems have it.
KINDS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,126}(?<=\.[A-Za-z-]{2,63})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:(?:18|19|20|21)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/(?:18|19|20|21)[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.(?:18|19|20|21)[0-9]{2})(?![0-9/-])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9]|\.[0-9]))|(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Matches at every place where one begins, overlapping ones too; the match is group 1, so the card's separator is group 2.
AHEAD = "(?=(" + ANY.replace(r"\1", r"\2") + "))"
#: Lengths of the IBANs of each country.
IBAN_LENGTHS = {
    int(n): set(c.split()) for n, c in (line.split(":") for line in """15:NO
16:BE
18:DK FO FI GL NL SD
19:MK SI
20:AT BA EE KZ LT LU MN XK
21:CH HR LI LV
22:BG BH CR DE GB GE IE ME RS VA
23:AE GI IL IQ OM SO TL
24:AD CZ ES MD PK RO SA SE SK TN VG
25:LY PT ST
26:IS TR
27:BI DJ FR GR IT MC MR SM
28:AL AZ BY CY DO GT HU LB NI PL SV
29:BR EG PS QA UA
30:JO KW MU YE
31:MT SC
32:LC
33:RU""".split("\n"))
}
#: Country codes of telephone numbers: of one digit, of two, and all others of three.
COUNTRY_CODE = r"^(\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}|[0-9]{0,2}))?"
#: The calendar's cycle of 400 years has so many days, 189 * 773.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)


def _digest(key: str, tweak: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), turn.cast("string"), half.cast("string")), 256)


def _shift_char(c: Column, by: Column) -> Column:
    """The character moved on within digits, lower or upper-case letters; others stay."""
    moved = lambda first, size: F.char(F.lit(first) + (F.ascii(c) - first + by) % size)
    return F.when(c.between("0", "9"), moved(48, 10)).when(c.rlike("^[a-z]$"), moved(97, 26)).when(c.rlike("^[A-Z]$"), moved(65, 26)).otherwise(c)


def _shifted(half: Column, digest: Column) -> Column:
    def each(e):
        by = lambda j: F.conv(F.substr(e["d"], ((j - 1) % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(e["h"])), lambda j: _shift_char(F.substr(e["h"], j, F.lit(1)), by(j))), "")

    return F.when(F.length(half) == 0, half).otherwise(_let(F.struct(half.alias("h"), digest.alias("d")), each))


def permute_text(value: Column, key: str, tweak: str) -> Column:
    """Feistel permutation of strings of one layout: every digit stays a digit, every letter of its case."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("a"), F.substr(value, half + 1, F.length(value)).alias("b"))

    def turn(acc, i):
        return F.when(i % 2 == 1, F.struct(_shifted(acc["a"], _digest(key, tweak, i, acc["b"])).alias("a"), acc["b"].alias("b"))).otherwise(
            F.struct(acc["a"].alias("a"), _shifted(acc["b"], _digest(key, tweak, i, acc["a"])).alias("b"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: F.concat(acc["a"], acc["b"]))


def permute_number(value: Column, sizes: tuple[int, int], key: str, tweak: str) -> Column:
    """Feistel permutation of 0 ... ``sizes[0] * sizes[1] - 1``, over the two digits of that mixed base."""
    a, b = sizes
    start = F.struct(F.floor(value / b).cast("long").alias("a"), (value % b).cast("long").alias("b"))
    number = lambda i, half: F.conv(F.substr(_digest(key, tweak, i, half), F.lit(1), F.lit(14)), 16, 10).cast("long")

    def turn(acc, i):
        return F.when(i % 2 == 1, F.struct(((acc["a"] + number(i, acc["b"])) % a).alias("a"), acc["b"].alias("b"))).otherwise(
            F.struct(acc["a"].alias("a"), ((acc["b"] + number(i, acc["a"])) % b).alias("b"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: acc["a"] * b + acc["b"])


def _kept(value: Column, what: str) -> Column:
    return F.regexp_replace(value, f"[^{what}]", "")


def _laid_out(like: Column, signs: Column, what: str) -> Column:
    """``signs`` written into the places that characters of ``what`` have in ``like``."""

    def each(e):
        here = lambda j: F.substr(e["l"], j, F.lit(1))
        nth = lambda j: F.length(_kept(F.substr(e["l"], F.lit(1), j), what))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(e["l"])), lambda j: F.when(here(j).rlike(f"^[{what}]$"), F.substr(e["s"], nth(j), F.lit(1))).otherwise(here(j))), "")

    return _let(F.struct(like.alias("l"), signs.alias("s")), each)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits whose last one counts once."""

    def add(acc, i):
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _mod97(signs: Column) -> Column:
    def add(acc, i):
        c = F.substr(signs, i, F.lit(1))
        return F.when(c.between("0", "9"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(signs)), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    def each(d):
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_text(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
        whole = _let(body, lambda b: F.concat(b, ((F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when((luhn_sum(d) % 10 == 0) & d.rlike("[1-9]"), _laid_out(m, whole, "0-9"))

    return _let(_kept(m, "0-9"), each)


def _iban_of(m: Column) -> Column:
    """What a match begins with that is valid and as long as its country's IBANs, else the match."""
    lengths = F.create_map(*[F.lit(x) for n, lands in IBAN_LENGTHS.items() for c in sorted(lands) for x in (c, n)])
    usual = F.element_at(lengths, F.substr(m, F.lit(1), F.lit(2)))
    own = F.substr(m, F.lit(1), F.when(m.contains(" "), usual + F.floor((usual - 1) / 4).cast("int")).otherwise(usual))
    valid = lambda v: _let(_kept(v, "A-Z0-9"), lambda s: (F.length(s) == usual) & (_mod97(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))) == 1))
    border = ~F.substr(m, F.length(own) + 1, F.lit(1)).rlike("[A-Z0-9]")
    return _let(F.when(border & valid(own), own), lambda v: F.coalesce(v, m))


def _iban(m: Column, key: str) -> Column:
    def each(s):
        land, rest = F.substr(s, F.lit(1), F.lit(2)), F.substr(s, F.lit(5), F.length(s))
        whole = _let(permute_text(rest, key, "iban"), lambda b: F.concat(land, F.lpad((F.lit(98) - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when(_mod97(F.concat(rest, F.substr(s, F.lit(1), F.lit(4)))) == 1, _laid_out(m, whole, "A-Z0-9"))

    return _let(_kept(m, "A-Z0-9"), each)


def _ip(m: Column, key: str) -> Column:
    o = lambda i: F.split_part(m, F.lit("."), F.lit(i)).cast("long")
    number = ((o(1) * 256 + o(2)) * 256 + o(3)) * 256 + o(4)
    return _let(permute_number(number, (65536, 65536), key, "ip"), lambda n: F.concat_ws(".", *[(F.shiftright(n, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)]))


def _ssn(m: Column, key: str) -> Column:
    part = lambda i: F.split_part(m, F.lit("-"), F.lit(i)).cast("long")
    area = part(1) - F.when(part(1) > 666, 2).otherwise(1)  # 0 ... 897
    number = (area * 99 + part(2) - 1) * 9999 + part(3) - 1

    def written(n):
        a = F.floor(n / (99 * 9999)).cast("long")
        area = a + F.when(a >= 665, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((F.floor(n / 9999) % 99 + 1).cast("long").cast("string"), 2, "0"), F.lpad((n % 9999 + 1).cast("string"), 4, "0"))

    return _let(permute_number(number, (898, 99 * 9999), key, "ssn"), written)


def _date(m: Column, key: str) -> Column:
    """ISO dates, and dates of day, month and year (month first where only that is a date)."""
    part = lambda sep, i: F.split_part(m, F.lit(sep), F.lit(i)).try_cast("int")
    out = None
    for sep, order in (("-", "ymd"), ("/", "dmy"), ("/", "mdy"), (".", "dmy")):
        at = {c: order.index(c) + 1 for c in order}
        width = F.length(F.split_part(m, F.lit(sep), F.lit(at["d"])))
        found = _calendar(part(sep, at["y"]), part(sep, at["m"]), part(sep, at["d"]))
        moved = _let(F.datediff(found, F.lit(FIRST_DAY).cast("date")).cast("long"), lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), permute_number(n, DAYS, key, "date").cast("int")))
        padded = F.substr(m, F.lit(1), F.lit(1)) == "0"

        def written(d, sep=sep, order=order, padded=padded, width=width):
            small = lambda x: F.when(F.lit(sep == "-") | padded | (width == 2), F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
            text = {"y": F.lpad(F.year(d).cast("string"), 4, "0"), "m": small(F.month(d)), "d": small(F.dayofmonth(d))}
            return F.concat_ws(sep, *[text[c] for c in order])

        this = F.when(m.contains(sep) & found.isNotNull(), _let(moved, _only(written)))
        out = this if out is None else F.coalesce(out, this)
    return out


def _only(f):
    return lambda x: f(x)


def _calendar(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def _phone(m: Column, key: str) -> Column:
    """The country code after a plus stays; the digits behind it are permuted, however they are written."""
    head = F.regexp_extract(m, COUNTRY_CODE, 0)
    rest = F.substr(m, F.length(head) + 1, F.length(m))
    return F.concat(head, _let(rest, lambda r: _laid_out(r, permute_text(_kept(r, "0-9"), key, "phone"), "0-9")))


def _email(m: Column, key: str) -> Column:
    """The last two labels of the domain stay."""
    tail = F.regexp_extract(m, r"[A-Za-z0-9-]+\.[A-Za-z0-9-]+$", 0)
    head = F.substr(m, F.lit(1), F.length(m) - F.length(tail))
    return F.concat(_let(head, lambda h: permute_text(h, key, "email")), tail)


_MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
#: How a match is told apart, without what stands around it.
_SHAPES = {
    "email": r"@", "iban": r"^[A-Z]{2}[0-9]{2}", "ip": r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$", "date": r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([/.])[0-9]{1,2}\2[0-9]{4})$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "phone": r"^(\+|\([0-9]{3}\)|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$)", "card": r"^[0-9]",
}


def _named(kind: str, m: Column):
    return lambda p: F.struct(F.when(p.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(p, m).alias("to"), F.length(m).alias("n"))


def _maker(kind: str, key: str):
    return lambda v: _let(_MAKERS[kind](v, key), _named(kind, v))


def _made(m: Column, key: str) -> Column:
    """Struct of kind, pseudonym and length of what a match begins with; one that is not valid stays, with kind null."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("to"), F.length(m).alias("n"))
    for kind in reversed(KINDS):
        made = _let(_iban_of(m), _maker(kind, key)) if kind == "iban" else _maker(kind, key)(m)
        out = F.when(m.rlike(_SHAPES[kind]), made).otherwise(out)
    return out


def _chosen(found: Column) -> Column:
    """Of pieces that begin with a match each, what is written for them: array of (kind, to).

    From left to right; a valid match uses up what it covers, an invalid one nothing.
    """
    none = F.expr("cast(array() as array<struct<kind:string,to:string>>)")
    after = lambda x, n: F.substr(x["piece"], n + 1, F.length(x["piece"]))
    pick = lambda kind, to: F.struct(kind.alias("kind"), to.alias("to"))
    nothing = F.lit(None).cast("string")
    alone = lambda x: F.when(x["kind"].isNull(), pick(nothing, x["piece"])).otherwise(pick(x["kind"], F.concat(x["to"], after(x, x["n"]))))

    def step(acc, x):
        skip, size = acc["state"], F.length(x["piece"])
        inside = skip > 0
        used = F.when(inside, skip).when(x["kind"].isNull(), 0).otherwise(x["n"])
        own = F.when(inside, pick(nothing, after(x, skip))).otherwise(alone(x))
        return F.struct(F.greatest(used - size, F.lit(0)).alias("state"), F.concat(acc["out"], F.array(own)).alias("out"))

    # Only where a valid match reaches into the next piece does order matter.
    reach = F.exists(found, lambda x: x["kind"].isNotNull() & (x["n"] > F.length(x["piece"])))
    return F.when(reach, scan(found, F.lit(0), none, step)["out"]).otherwise(F.transform(found, alone))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; ``found_col`` gets the kinds found, in order.

    Every row and column stays; null and empty texts stay as they are (nothing found).
    What only looks like a number or date but fails its validation stays too. Telephone
    numbers are linked however they are written, with or without a country code. Columns
    may have any names; ``found_col`` must be a new one. Whole texts of any length are
    read, one row at a time, in time linear in their length, without an exchange.
    """
    if found_col in docs.columns:
        raise ValueError(f"there is a column {found_col} already")
    made, pieces, chosen = unused(docs, "_made", "_pieces", "_chosen")
    text = named(text_col)
    found = F.regexp_extract_all(text, F.lit(AHEAD), F.lit(1))
    rows = docs.withColumn(made, F.when(text.rlike("[0-9@]"), F.transform(found, lambda m: _made(m, key))))
    # Pieces begin where matches do; the first has none unless the text begins with one.
    rows = rows.withColumn(pieces, F.when(F.size(made) > 0, F.split(text, AHEAD, -1)))
    lead = F.size(pieces) - F.size(made)
    pairs = F.zip_with(made, F.slice(pieces, lead + 1, F.size(made)), lambda x, piece: F.struct(x["kind"].alias("kind"), x["to"].alias("to"), x["n"].alias("n"), piece.alias("piece")))
    rows = rows.withColumn(chosen, F.when(F.size(made) > 0, _let(pairs, _chosen)))
    put = F.concat(F.slice(pieces, F.lit(1), lead), F.transform(chosen, lambda x: x["to"]))
    new = F.when(F.size(chosen) > 0, F.array_join(put, "")).otherwise(text)
    kinds = F.coalesce(F.filter(F.transform(chosen, lambda x: x["kind"]), lambda k: k.isNotNull()), F.expr("cast(array() as array<string>)"))
    columns = [new.alias(c) if c == text_col else named(c) for c in docs.columns]
    return rows.select(*columns, *([kinds.alias(found_col)] if found_col else []))
