"""Check-digit rules of public identifier formats as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters of the Spanish, Singaporean and Italian check characters.
ES_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
SG_CITIZEN, SG_FOREIGN = "JZIHGFEDCBA", "XWUTRQPNMLK"
#: What a character in an odd place of an Italian fiscal code counts, for 0-9 (and A-J), then K-Z.
IT_ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def weighted(d: Column, weights: list[int]) -> Column:
    """Sum of the first digits times their weights."""
    return sum((F.coalesce(F.substring(d, i + 1, 1).try_cast("int"), F.lit(0)) * w for i, w in enumerate(weights)), F.lit(0))


def digit(d: Column, i: int) -> Column:
    return F.coalesce(F.substring(d, i, 1).try_cast("int"), F.lit(-1))


def letter_of(letters: str, i: Column) -> Column:
    return F.substring(F.lit(letters), i + 1, F.lit(1))


def luhn(v: Column) -> Column:
    return F.call_function("luhn_check", digits(v))


def luhn_digit(body: Column) -> Column:
    """The digit that makes `body` followed by it pass: every second digit from the right, beginning with the last, is doubled."""
    seq = F.reverse(F.split(body, ""))
    each = F.transform(F.filter(seq, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.pmod(10 - F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10, F.lit(10))


def mod97(v: Column) -> Column:
    """Remainder of an alphanumeric string read as a number, letters A-Z as 10-35: of its digits by 16 at a time, each piece behind the remainder so far."""
    digits = F.array_join(F.transform(F.split(v, ""), lambda c: F.conv(c, 36, 10)), "")

    def of(d):
        starts = F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1)), F.lit(16))
        return F.aggregate(starts, F.lit(0), lambda a, i: (F.concat(a.cast("string"), F.substring(d, i, F.lit(16))).cast("bigint") % 97).cast("int"))

    return F.element_at(F.transform(F.array(digits), of), 1)


def iban(v: Column) -> Column:
    s = F.replace(v, F.lit(" "), F.lit(""))
    return F.length(s).between(15, 34) & (mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1)


def abn(v: Column) -> Column:
    return (weighted(digits(v), [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]) - 10) % 89 == 0


def acn(v: Column) -> Column:
    return weighted(digits(v), [8, 7, 6, 5, 4, 3, 2, 1, 1]) % 10 == 0


def tfn(v: Column) -> Column:
    return weighted(digits(v), [1, 4, 3, 7, 5, 8, 6, 9, 10]) % 11 == 0


def medicare(v: Column) -> Column:
    d = digits(v)
    return weighted(d, [1, 3, 7, 9, 1, 3, 7, 9]) % 10 == digit(d, 9)


def nhs(v: Column) -> Column:
    return weighted(digits(v), [10, 9, 8, 7, 6, 5, 4, 3, 2, 1]) % 11 == 0


def pesel(v: Column) -> Column:
    return weighted(digits(v), [1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1]) % 10 == 0


def nif(v: Column) -> Column:
    return letter_of(ES_LETTERS, F.substring(digits(v), 1, 8).try_cast("int") % 23) == F.substring(v, -1, 1)


def nric(v: Column) -> Column:
    kind, s = F.substring(v, 1, 1), weighted(digits(v), [2, 7, 6, 5, 4, 3, 2])
    s = (s + F.when(kind.isin("T", "G"), 4).otherwise(0)) % 11
    return F.when(kind.isin("S", "T"), letter_of(SG_CITIZEN, s)).otherwise(letter_of(SG_FOREIGN, s)) == F.substring(v, -1, 1)


def dea(v: Column) -> Column:
    d = digits(F.substring(v, 3, 7))
    return weighted(d, [1, 2, 1, 2, 1, 2]) % 10 == digit(d, 7)


def ssn(v: Column) -> Column:
    """Area not 000, 666 or 900-999; group not 00; serial not 0000."""
    d = digits(v)
    return ~F.substring(d, 1, 3).isin("000", "666") & (F.substring(d, 1, 1) != "9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def _dihedral(a: int, b: int) -> int:
    """The group operation behind the Verhoeff check: rotations 0-4, reflections 5-9."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def aadhaar(v: Column) -> Column:
    """Verhoeff check over all digits."""
    turn = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([turn[x] for x in powers[-1]])
    table = F.array(*[F.lit(_dihedral(a, b)) for a in range(10) for b in range(10)])
    turned = F.array(*[F.lit(x) for row in powers for x in row])
    d = F.filter(F.reverse(F.split(digits(v), "")), lambda c: c != "")
    steps = F.transform(d, lambda c, i: F.element_at(turned, (i % 8) * 10 + c.cast("int") + 1))
    return F.aggregate(steps, F.lit(0), lambda a, x: F.element_at(table, a * 10 + x + 1)) == 0


def fiscal_code(v: Column) -> Column:
    odd = F.array(*[F.lit(x) for x in IT_ODD])
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 65)
    total = sum((F.element_at(odd, value(F.substring(v, i, 1)) + 1) if i % 2 else value(F.substring(v, i, 1)) for i in range(1, 16)), F.lit(0))
    return F.chr(total % 26 + 65) == F.substring(v, 16, 1)
