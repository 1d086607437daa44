"""Look-alike values drawn from a hash of context, text and the draw's number, by SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabets and word lists.
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
VIN = "ABCDEFGHJKLMNPRSTUVWXYZ0123456789"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
DOMAINS = ("example.com", "test.org", "sample.net")
PATHS = ("page", "article", "post", "item", "doc")

Draw = Callable[[Column | int, int], Column]


def drawing(token: Column, context: Column) -> Draw:
    """draw(k, n): the k-th number below n. 60 bits of a SHA-256 make it even enough."""

    def draw(k: Column | int, n: int) -> Column:
        number = F.lit(str(k)) if isinstance(k, int) else k.cast("string")
        digest = F.sha2(F.concat(context, F.lit("\0"), token, F.lit("\0"), number).cast("binary"), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(n).cast("bigint"))

    return draw


def letters(draw: Draw, first: int, count: Column | int, alphabet: str) -> Column:
    ks = F.sequence(F.lit(first), F.lit(first) + (F.lit(count) if isinstance(count, int) else count.cast("int")) - 1)
    return F.array_join(F.transform(ks, lambda k: F.substring(F.lit(alphabet), (draw(k, len(alphabet)) + 1).cast("int"), F.lit(1))), "")


def pick(draw: Draw, k: int, words: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (draw(k, len(words)) + 1).cast("int"))


def _ssn(d: Draw) -> Column:
    area = 1 + d(0, 898)
    return F.format_string("%03d-%02d-%04d", F.when(area >= 666, area + 1).otherwise(area), 1 + d(1, 99), 1 + d(2, 9999))


def _email(d: Draw) -> Column:
    return F.concat(letters(d, 1, 4 + d(0, 5), LOWER), (1 + d(20, 9999)).cast("string"), F.lit("@"), pick(d, 21, DOMAINS))


def _card(d: Draw) -> Column:
    digits = [F.lit(4).cast("bigint")] + [d(k, 10) for k in range(14)]
    # The check digit doubles every second digit from the right, itself not counted.
    parts = [F.when(2 * x > 9, 2 * x - 9).otherwise(2 * x) if (15 - i) % 2 else x for i, x in enumerate(digits)]
    total = sum(parts[1:], parts[0])
    return F.format_string("%d%d%d%d-%d%d%d%d-%d%d%d%d-%d%d%d%d", *digits, F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)))


GENERATORS: dict[str, Callable[[Draw], Column]] = {
    "ssn": _ssn,
    "email-address": _email,
    "phone-number": lambda d: F.format_string("(555) %03d-%04d", 100 + d(0, 900), 1000 + d(1, 9000)),
    "credit-card": _card,
    "ip-address": lambda d: F.format_string("192.168.%d.%d", d(0, 256), d(1, 256)),
    "date": lambda d: F.format_string("%02d/%02d/%04d", 1 + d(1, 12), 1 + d(2, 28), 1950 + d(0, 50)),
    "zip-code": lambda d: F.format_string("%05d", d(0, 100_000)),
    "mac-address": lambda d: F.format_string("02:%02x:%02x:%02x:%02x:%02x", *[d(k, 256) for k in range(5)]),
    "vin": lambda d: letters(d, 0, 17, VIN),
    "bank-routing-number": lambda d: F.format_string("%09d", d(0, 1_000_000_000)),
    "bitcoin-address": lambda d: F.concat(F.lit("1"), letters(d, 1, 25 + d(0, 8), BASE58)),
    "age": lambda d: F.format_string("%d years old", 1 + d(0, 80)),
    "url": lambda d: F.concat(F.lit("https://example.com/"), pick(d, 1, PATHS), (1 + d(0, 9999)).cast("string")),
    "iban-code": lambda d: F.concat(F.format_string("GB%02d", 2 + d(0, 97)), letters(d, 1, 4, UPPER), F.format_string("%06d%08d", d(5, 1_000_000), d(6, 100_000_000))),
    "passport-number": lambda d: F.concat(letters(d, 0, 1, UPPER), F.format_string("%08d", d(1, 100_000_000))),
    "drivers-license-number": lambda d: F.concat(letters(d, 0, 1, UPPER), F.format_string("%07d", d(1, 10_000_000))),
    "tracking-number": lambda d: F.format_string("1Z%09d", d(0, 1_000_000_000)),
}
GENERATORS["phone-number-extension"] = GENERATORS["phone-number"]


def random_value(filter_type: str, token: Column, context: Column) -> Column:
    """A value of the type, the same for the same context and text; a type without values gets the plain redaction."""
    make = GENERATORS.get(filter_type)
    return make(drawing(token, context)) if make else F.lit(f"{{{{{{REDACTED-{filter_type}}}}}}}")
