"""Deterministic fakes: pure functions of (seed, entity type, value), so tasks agree without exchanging anything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checksums import luhn_digit, mod97

FIRST = ["Alex", "Blair", "Casey", "Devon", "Ellis", "Frankie", "Gray", "Harper", "Indigo", "Jules", "Kai", "Lane", "Morgan", "Noel", "Oakley", "Parker", "Quinn", "Reese", "Sage", "Taylor"]
LAST = ["Arden", "Birch", "Calder", "Dale", "Ember", "Fenn", "Glade", "Heath", "Isle", "Jarrow", "Kestrel", "Lark", "Marsh", "North", "Orchard", "Pike", "Quarry", "Rowan", "Stone", "Thorne"]
CITIES = ["Alderton", "Brookvale", "Cedar Falls", "Dunmore", "Eastwick", "Fairhaven", "Glenrock", "Hartfield", "Ivydale", "Kingsmere"]
FIRMS = ["Aster Works", "Boreal Partners", "Cobalt Systems", "Delta Foundry", "Evergreen Supply", "Fathom Labs", "Granite Trust", "Harbor Lines", "Ionic Group", "Juniper Mills"]
MAIL_HOSTS = ["example.com", "example.net", "example.org", "mail.example.com", "post.example.net", "inbox.example.org"]
#: Pools by language for names and places; languages without one use English.
LOCAL = {
    "de": (["Anke", "Bernd", "Heike", "Jürgen", "Silke", "Uwe"], ["Ackermann", "Brandt", "Kessler", "Lindner", "Vogt", "Winter"], ["Altdorf", "Lindau", "Rosenheim"], ["Nordwerk GmbH", "Rheintal AG"]),
    "fr": (["Aline", "Benoît", "Chloé", "Didier", "Élodie", "Luc"], ["Aubert", "Blanchet", "Fabre", "Girard", "Lacroix", "Mercier"], ["Beaumont", "Clairval", "Montfort"], ["Atelier du Nord SA", "Groupe Azur SA"]),
    "es": (["Alba", "Bruno", "Inés", "Lucía", "Mateo", "Rocío"], ["Aguilar", "Bravo", "Campos", "Delgado", "Ibáñez", "Vega"], ["Alameda", "Montalvo", "Ribera"], ["Grupo Ribera SA", "Talleres Sur SL"]),
    "it": (["Alba", "Dario", "Elisa", "Fabio", "Giada", "Marco"], ["Barbieri", "Conti", "Ferri", "Galli", "Moretti", "Riva"], ["Borgo", "Castelnuovo", "Riviera"], ["Officine Alba SpA", "Riva Srl"]),
}
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "MMMM d, yyyy", "MMM d, yyyy"]


class Source:
    """Numbers drawn from md5(seed | type | value | place)."""

    def __init__(self, seed: int, entity_type: Column, value: Column):
        self.key = F.concat_ws("|", F.lit(str(seed)), entity_type, value)

    def number(self, place, below) -> Column:
        place = place if isinstance(place, Column) else F.lit(place)
        h = F.md5(F.concat_ws("|", self.key, place.cast("string")))
        return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), below if isinstance(below, Column) else F.lit(below)).cast("int")

    def pick(self, place, pool: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in pool]), self.number(place, len(pool)) + 1)

    def letters(self, n: Column, first: int = 97) -> Column:
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.chr(self.number(i, 26) + first)), "")).otherwise(F.lit(""))

    def digits(self, n: Column) -> Column:
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: self.number(i, 10).cast("string")), "")).otherwise(F.lit(""))


def pour(template: Column, fill: Column) -> Column:
    """The digits of `template` replaced in order by the characters of `fill`; all else stays."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["out"], F.substring(fill, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at")))
    return F.aggregate(F.split(template, ""), start, step, lambda a: a["out"])


def card(src: Source, value: Column) -> Column:
    """As many digits as before, the last one making the Luhn check pass, in the old format."""
    n = F.length(F.regexp_replace(value, "[^0-9]", ""))
    body = src.digits(n - 1)
    return pour(value, F.concat(body, luhn_digit(body).cast("string")))


def iban(src: Source, value: Column) -> Column:
    """The country and the grouping stay; letters become letters, digits digits, and the check digits fit."""
    chars = F.transform(F.split(value, ""), lambda c, i: F.when(i < 4, c).when(c.rlike("[0-9]"), src.number(i, 10).cast("string")).when(c.rlike("[A-Za-z]"), F.chr(src.number(i, 26) + 65)).otherwise(c))
    rest = F.substring(F.array_join(chars, ""), F.lit(5), F.length(value))
    country = F.upper(F.substring(value, 1, 2))
    check = F.lit(98) - mod97(F.concat(F.replace(rest, F.lit(" "), F.lit("")), country, F.lit("00")))
    return F.when(F.length(value) < 4, F.lit("[IBAN_CODE]")).otherwise(F.concat(country, F.lpad(check.cast("string"), 2, "0"), rest))


def shift_date(value: Column, days: Column) -> Column:
    """The date moved, in the format it was written in; null where no format reads it."""
    return F.coalesce(*[F.date_format(F.date_add(F.try_to_timestamp(value, F.lit(f)).cast("date"), days), f) for f in DATE_FORMATS])


def entity_aware(entity_type: Column, value: Column, seed: int = 0, language: Column | None = None) -> Column:
    """A fake of the same kind for the types that have a generator, `[TYPE]` for the others."""
    src = Source(seed, entity_type, value)

    def local(i: int, place, pool: list[str]) -> Column:
        out = src.pick(place, pool)
        if language is not None:
            for code, pools in LOCAL.items():
                out = F.when(language == code, src.pick(place, pools[i])).otherwise(out)
        return out

    first, last = local(0, "first", FIRST), local(1, "last", LAST)
    nine = src.digits(F.lit(9))
    kinds = {
        "PERSON": F.when(F.contains(value, F.lit(",")), F.concat(last, F.lit(", "), first)).otherwise(F.concat(first, F.lit(" "), last)),
        "EMAIL_ADDRESS": F.concat(src.letters(F.lit(8)), F.lit("@"), src.pick("host", MAIL_HOSTS)),
        "PHONE_NUMBER": pour(value, src.digits(F.length(value))),
        "CREDIT_CARD": card(src, value),
        "US_SSN": pour(value, F.concat((F.lit(100) + src.number("area", 500)).cast("string"), F.substring(nine, 4, 6))),
        "IP_ADDRESS": F.concat(F.lit("192.168."), (src.number("a", 254) + 1).cast("string"), F.lit("."), (src.number("b", 254) + 1).cast("string")),
        "DATE_TIME": F.coalesce(shift_date(value, src.number("days", 3651) - 1825), F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), src.number("date", 9000)), "yyyy-MM-dd")),
        "LOCATION": local(2, "city", CITIES),
        "ORGANIZATION": local(3, "firm", FIRMS),
        "URL": F.concat(F.when(F.startswith(value, F.lit("https")), "https").otherwise("http"), F.lit("://synthetic-"), F.lpad(src.number("host", 10000).cast("string"), 4, "0"), F.lit(".example.com/"), src.letters(src.number("path", 9) + 4)),
        "US_BANK_NUMBER": src.digits(F.length(F.regexp_replace(value, "[^0-9]", ""))),
        "IBAN_CODE": iban(src, value),
    }
    out = None
    for name, fake in kinds.items():
        out = F.when(entity_type == name, fake) if out is None else out.when(entity_type == name, fake)
    return out.otherwise(F.concat(F.lit("["), entity_type, F.lit("]")))


def mask(entity_type: Column, value: Column) -> Column:
    return F.concat(F.lit("["), entity_type, F.lit("]"))


def random_letters(entity_type: Column, value: Column, seed: int = 0) -> Column:
    """Letters of the same length."""
    return Source(seed, entity_type, value).letters(F.length(value))
