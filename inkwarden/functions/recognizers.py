"""The registry of personal-data recognizers: a pattern over the shadow text, a cheap guard, a score and a check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checksums as cs

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MONTHS = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"


@dataclass(frozen=True)
class Recognizer:
    entity_type: str
    pattern: str
    score: float
    guard: str | tuple[str, ...] | None = None  # a literal that any match must contain, or several of which it must contain one
    check: Callable[[Column], Column] | None = None
    first: str | None = None  # a class of characters that any match begins with

    @property
    def sought(self) -> str:
        """The pattern behind a look at its first character: that is cheaper at most places of a text than a word boundary, and matches are the same."""
        return f"(?={self.first}){self.pattern}" if self.first else self.pattern


def names(words: list[str]) -> str:
    """A pattern for whole capitalised names from a list, longest first."""
    return r"\b(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + r")\b"


#: Small open gazetteers; they stand in for a language model's entities and claim nothing beyond their words.
FIRST_NAMES = ["Ada", "Alan", "Anna", "Carlos", "Clara", "David", "Elena", "Emma", "Fatima", "Grace", "Hans", "Ines", "James", "John", "Julia", "Karl", "Laura", "Linus", "Maria", "Marie", "Mary", "Michael", "Nina", "Omar", "Paul", "Peter", "Sarah", "Sofia", "Thomas", "Yuki"]
PLACES = ["Amsterdam", "Berlin", "Boston", "Chicago", "London", "Lisbon", "Madrid", "Munich", "New York", "Oslo", "Paris", "Rome", "San Francisco", "Seattle", "Sydney", "Tokyo", "Toronto", "Vienna", "Warsaw", "Zurich"]
PEOPLES = ["American", "Australian", "British", "Buddhist", "Catholic", "Chinese", "Christian", "Dutch", "French", "German", "Hindu", "Indian", "Italian", "Japanese", "Jewish", "Muslim", "Polish", "Protestant", "Spanish", "Swiss"]

FIRMS = ["Inc", "Corp", "Ltd", "LLC", "GmbH", "AG", "SA", "PLC", "Company", "University"]

REGISTRY: dict[str, Recognizer] = {
    r.entity_type: r
    for r in [
        Recognizer("PERSON", r"\b(?:" + "|".join(FIRST_NAMES) + r") [A-Z][a-z]+\b", 0.75, first="[A-Z]"),
        Recognizer("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b", 1.0, "@"),
        Recognizer("PHONE_NUMBER", r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}\b", 0.75, first="[+(0-9]"),
        Recognizer("CREDIT_CARD", r"\b[0-9](?:[ -]?[0-9]){12,18}\b", 1.0, None, cs.luhn, first="[0-9]"),
        Recognizer("US_SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.85, "-", cs.ssn, first="[0-9]"),
        Recognizer("US_PASSPORT", r"\b[A-Z][0-9]{8}\b", 0.7, first="[A-Z]"),
        Recognizer("US_DRIVER_LICENSE", r"\b[A-Z][0-9]{7}\b", 0.7, first="[A-Z]"),
        Recognizer("IP_ADDRESS", rf"\b(?:{OCTET}\.){{3}}{OCTET}\b", 0.95, ".", first="[0-9]"),
        Recognizer("URL", r"\bhttps?://[^\s<>\x22']+", 0.95, "://", first="h"),
        Recognizer("NRP", names(PEOPLES), 0.7, first="[A-Z]"),
        Recognizer("LOCATION", names(PLACES), 0.7, first="[A-Z]"),
        Recognizer("DATE_TIME", rf"\b(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|{MONTHS} [0-9]{{1,2}}, [0-9]{{4}})\b", 0.85, first="[0-9A-Z]"),
        Recognizer("MEDICAL_LICENSE", r"\b[ABFGMPR][A-Z9][0-9]{7}\b", 0.9, None, cs.dea, first="[ABFGMPR]"),
        Recognizer("US_BANK_NUMBER", r"\b[0-9]{8,12}\b", 0.3, first="[0-9]"),
        Recognizer("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 1.0, None, cs.iban, first="[A-Z]"),
        Recognizer("CRYPTO", r"\b(?:[13][1-9A-HJ-NP-Za-km-z]{25,34}|bc1[02-9ac-hj-np-z]{11,71}|0x[0-9a-fA-F]{40})\b", 0.8, first="[013b]"),
        Recognizer("AU_ABN", r"\b[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b", 0.8, None, cs.abn, first="[0-9]"),
        Recognizer("AU_ACN", r"\b[0-9]{3} [0-9]{3} [0-9]{3}\b", 0.75, None, cs.acn, first="[0-9]"),
        Recognizer("AU_TFN", r"\b[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b", 0.7, None, cs.tfn, first="[0-9]"),
        Recognizer("AU_MEDICARE", r"\b[2-6][0-9]{3} ?[0-9]{5} ?[0-9]\b", 0.75, None, cs.medicare, first="[2-6]"),
        Recognizer("UK_NHS", r"\b[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4}\b", 0.8, None, cs.nhs, first="[0-9]"),
        Recognizer("SG_NRIC_FIN", r"\b[STFG][0-9]{7}[A-Z]\b", 0.9, None, cs.nric, first="[STFG]"),
        Recognizer("IN_PAN", r"\b[A-Z]{3}[ABCFGHLJPT][A-Z][0-9]{4}[A-Z]\b", 0.85, first="[A-Z]"),
        Recognizer("IN_AADHAAR", r"\b[2-9][0-9]{3} ?[0-9]{4} ?[0-9]{4}\b", 0.85, None, cs.aadhaar, first="[2-9]"),
        Recognizer("IT_FISCAL_CODE", r"\b[A-Z]{6}[0-9]{2}[A-EHLMPRST][0-9]{2}[A-Z][0-9]{3}[A-Z]\b", 0.95, None, cs.fiscal_code, first="[A-Z]"),
        Recognizer("ES_NIF", r"\b[0-9]{8}[A-Z]\b", 0.9, None, cs.nif, first="[0-9]"),
        Recognizer("PL_PESEL", r"\b[0-9]{11}\b", 0.75, None, cs.pesel, first="[0-9]"),
        Recognizer("ORGANIZATION", r"\b[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)* (?:" + "|".join(FIRMS) + r")\b", 0.7, tuple(f" {w}" for w in FIRMS), first="[A-Z]"),
    ]
}

DEFAULT_TYPES = list(REGISTRY)


def custom(entity_type: str, patterns: list[str], score: float = 0.85) -> list[Recognizer]:
    """A tenant's own type, one recognizer a pattern."""
    return [Recognizer(entity_type, p, score) for p in patterns]


def deny_list(entity_type: str, words: list[str], score: float = 1.0) -> Recognizer:
    """Whole words to find as they stand."""
    quoted = ["".join(c if c.isalnum() or c == " " else "\\" + c for c in w) for w in words]
    return Recognizer(entity_type, r"\b(?:" + "|".join(quoted) + r")\b", score)


def guarded(r: Recognizer, seen: Column, spans: Column, empty: Column) -> Column:
    """Spans only where one of the guard's literals occurs at all."""
    if not r.guard:
        return spans
    literals = [r.guard] if isinstance(r.guard, str) else r.guard
    return F.when(reduce(or_, [F.contains(seen, F.lit(x)) for x in literals]), spans).otherwise(empty)
