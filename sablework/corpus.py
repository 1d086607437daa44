"""A corpus of sensitive-looking text, derived from the customer table by arithmetic that any SQL engine agrees on.

Every customer gives one text with valid, invalid, overlapping and non-ASCII
cases of each kind. The SQL runs unchanged on Spark and on DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def d(expr: str, width: int) -> str:
    """A number's digits with leading zeros, cut to the width."""
    return f"lpad(cast(({expr}) % {10**width} as string), {width}, '0')"


def pick(expr: str, words: list[str]) -> str:
    cases = " ".join(f"when {i} then '{w}'" for i, w in enumerate(words))
    return f"(case ({expr}) % {len(words)} {cases} end)"


MONTHS = "January February March April May June July August September October November December".split()
_MON = pick("k", MONTHS + [m[:3] for m in MONTHS])
_LETTER = pick("k", list("ABCDEFGHJKLMNPRSTUVWXYZ"))
#: One piece per kind; each is an SQL expression of k.
PIECES: dict[str, str] = {
    "ssn": f"'SSN ' || {d('k * 7', 3)} || '-' || {d('k', 2)} || '-' || {d('k * 31', 4)} || ' or é' || {d('k * 11', 9)} || ', TIN ' || {d('k', 2)} || '-' || {d('k * 104729', 7)}",
    "age": f"'aged ' || cast(k % 90 as string) || '. A ' || cast(k % 99 as string) || '-year-old, ' || cast(k % 50 as string) || {pick('k', ['yo', ' years old', ' years', ' y/o', ' yrs Old'])} || ' here'",
    "bank": f"'routing ' || {d('k * 100003', 9)} || ' and ' || {d('k * 17', 8)}",
    "bitcoin": f"{pick('k', ['1', '3', '2'])} || 'A1zP1eP5QGefi2DMPTfTL5SLmv7Div' || {_LETTER} || 'Na bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf' || cast(k % 97 as string)",
    "card": f"{pick('k', ['4', '5', '37', '300', '6011', '2131', '9', '35123'])} || {d('k * 999983', 12)} || ' 4111111111111111 411111111111' || {d('k', 4)}",
    "date": f"{_MON} || ' ' || cast(1 + k % 31 as string) || {pick('k', [', ', ' ', ',  '])} || cast(1990 + k % 40 as string) || '; ' || {d('1 + k % 12', 2)} || {pick('k', ['/', '.', '-'])} || {d('1 + k % 31', 2)} || {pick('k', ['/', '.', '-'])} || cast(1990 + k % 40 as string) || '; ' || cast(1990 + k % 40 as string) || '-' || {d('1 + k % 13', 2)} || '-' || {d('1 + k % 31', 2)} || '; ' || cast(1 + k % 31 as string) || ' ' || upper({_MON}) || ' 2001'",
    "licence": f"{_LETTER} || {d('k * 7919', 7)} || ' ' || lower({_LETTER}) || 'B' || {d('k * 3', 6)} || ' ' || {d('k * 5', 7)}",
    "email": "'mail u' || cast(k as string) || '.x+y@example' || cast(k % 9 as string) || '.com, @no.com, ü' || cast(k as string) || '@test.org'",
    "iban": f"'DE' || {d('k', 2)} || {d('k * 37', 9)} || {d('k * 41', 9)} || ' gb29NWBK' || {d('k * 3', 8)}",
    "ip": "cast(k % 300 as string) || '.' || cast(k % 256 as string) || '.0.' || cast(k % 99 as string) || ' fe80::' || cast(k % 9999 as string) || ' 2001:db8:0:0:0:0:0:' || cast(k % 999 as string)",
    "mac": f"'00:1A:2b:' || {d('k', 2)} || ':4D:5E 001A.2B3C.' || {d('k', 4)} || ' 00-1A'",
    "passport": f"{_LETTER} || {d('k * 10007', 8)} || ' ' || lower({_LETTER}) || {d('k', 7)}",
    "phone": f"'(555) ' || {d('k', 3)} || '-' || {d('k * 7', 4)} || ' +44 20 7946 ' || {d('k', 4)} || ' 555.' || {d('k', 3)} || '.' || {d('k * 3', 4)}",
    "tracking": f"'1Z12345E' || {d('k * 13', 10)} || ' ' || {d('k * 1000003', 12)} || ' EA' || {d('k', 8)}  || 'US 94001' || {d('k * 101', 9)} || {d('k * 103', 8)}",
    "url": "'see https://www.site' || cast(k % 7 as string) || '.org/a?b=' || cast(k as string) || '\n bare' || cast(k as string) || '.net:80 www.x' || cast(k % 5 as string) || '.com'",
    "vin": f"'1HGCP2684BR0' || {d('k', 4)} || {_LETTER} || ' 1HGCP2684BRI' || {d('k', 5)}",
    "zip": f"{d('k * 17', 5)} || ' ' || {d('k', 5)} || '-' || {d('k * 3', 4)} || ' ' || {d('k * 7', 5)} || {d('k', 4)}",
}
SEPARATOR = "' . '"


def corpus_sql(kinds: list[str] | None = None) -> str:
    """SELECT doc_id, context, text. The order of pieces turns with the customer, so that kinds meet each other."""
    parts = [PIECES[k] for k in kinds or PIECES]
    half = max(1, len(parts) // 2)
    join = f" || {SEPARATOR} || ".join
    texts = [join(parts), join(parts[half:] + parts[:half])]
    return (
        "SELECT k AS doc_id, 'ctx' || cast(k % 7 as string) AS context, "
        f"CASE k % 2 WHEN 0 THEN {texts[0]} ELSE {texts[1]} END AS text FROM (SELECT c_custkey AS k FROM customer) AS base"
    )


def corpus(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    # The table is small and its texts are long, so keys are dealt out to all cores before texts are built.
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").repartition(spark.sparkContext.defaultParallelism)
    return spark.sql(corpus_sql(kinds).replace("FROM customer", "FROM {customer}"), customer=customers)
