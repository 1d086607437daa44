"""DuckDB SQL for what the engine computes, built from the same tables of fixed values but by relational means."""

from __future__ import annotations

from sablework.functions.random_values import BASE58, DOMAINS, LOWER, PATHS, UPPER, VIN
from sablework.operators.patterns import KINDS, Kind, Pattern


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches_sql(patterns: list[tuple[int, int, str, Pattern]], source: str = "c") -> str:
    """SELECT doc_id, f (detector), p (pattern), kind, confidence, token, lo, hi (bytes), clo, chi (characters)."""
    one = []
    for f, p, kind, pattern in patterns:
        regex = lit(f"({pattern.regex})")
        one.append(
            f"SELECT doc_id, {f} AS f, {p} AS p, {lit(kind)} AS kind, {pattern.confidence}::DOUBLE AS confidence, "
            f"string_split(regexp_replace(text, {regex}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM {source} WHERE regexp_matches(text, {regex})"
        )
    return (
        "SELECT doc_id, f, p, kind, confidence, parts[i] AS token, "
        "coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: strlen(x))), 0)::INT AS lo, "
        "coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0)::INT AS clo "
        f"FROM (SELECT *, unnest(range(2, len(parts) + 1, 2)) AS i FROM ({' UNION ALL '.join(one)}))"
    )


# Tests after contained matches were dropped, as SQL of token.
POST_SQL = {
    "age": "(contains(lower(token), 'age') OR contains(lower(token), 'old') OR contains(lower(token), 'y/o') OR contains(lower(token), 'yo'))",
    "ssn": "(regexp_matches(token, '^[0-9]{2}-') OR NOT (substr(regexp_replace(token, '[- ]', '', 'g'), 1, 3) IN ('000', '666') OR regexp_replace(token, '[- ]', '', 'g') LIKE '9%'))",
}
LUHN_SQL = (
    "list_sum(list_transform(list_reverse(string_split(regexp_replace(token, '[^0-9]', '', 'g'), '')), "
    "lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT WHEN x::INT > 4 THEN 2 * x::INT - 9 ELSE 2 * x::INT END)) % 10 = 0"
)


def spans_sql(kinds: list[tuple[Kind, tuple[Pattern, ...]]], source_sql: str, post: dict[str, str] | None = None, replacement: str | None = None) -> str:
    """WITH ... whose last relation s has doc_id, context, text, f, p, kind, confidence, token, lo, hi, clo, chi, replacement."""
    post = POST_SQL if post is None else post
    flat = [(f, p, k.filter_type, x) for f, (k, patterns) in enumerate(kinds) for p, x in enumerate(patterns)]
    tests = " ".join(f"WHEN {lit(k)} THEN {t}" for k, t in post.items())
    keep = f"CASE kind {tests} ELSE true END" if tests else "true"
    repl = replacement or "'{{{REDACTED-' || kind || '}}}'"
    return (
        f"WITH c AS ({source_sql}), m0 AS ({matches_sql(flat)}), "
        "m AS (SELECT *, (lo + strlen(token))::INT AS hi, (clo + length(token))::INT AS chi FROM m0), "
        "k AS (SELECT a.* FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.doc_id = a.doc_id AND b.f = a.f "
        "AND (b.p < a.p OR b.p = a.p AND b.lo < a.lo) AND a.lo >= b.lo AND a.hi <= b.hi)), "
        f"s AS (SELECT k.*, c.context, c.text, {repl} AS replacement FROM k JOIN c USING (doc_id) WHERE {keep})"
    )


COLUMNS = "doc_id, lo AS character_start, hi AS character_end, kind AS filter_type, token, replacement, confidence"


def explain_sql(kinds, source_sql: str, **more) -> str:
    return f"{spans_sql(kinds, source_sql, **more)} SELECT {COLUMNS} FROM s"


def redact_sql(kinds, source_sql: str, where: str = "true", **more) -> str:
    """doc_id, filtered_text: each span adds what lies between the end of the one before it and its own start."""
    return (
        f"{spans_sql(kinds, source_sql, **more)}, o AS (SELECT *, row_number() OVER w AS n, coalesce(lag(chi) OVER w, 0) AS prev "
        f"FROM s WHERE {where} WINDOW w AS (PARTITION BY doc_id ORDER BY lo, f, p)), "
        "t AS (SELECT doc_id, string_agg(CASE WHEN clo > prev THEN substr(text, prev + 1, clo - prev) ELSE '' END "
        "|| CASE WHEN replacement = '' THEN token ELSE replacement END, '' ORDER BY n) AS head, max_by(chi, n) AS tail FROM o GROUP BY doc_id) "
        "SELECT c.doc_id, CASE WHEN t.doc_id IS NULL THEN c.text ELSE t.head || substr(c.text, t.tail + 1) END AS filtered_text FROM c LEFT JOIN t USING (doc_id)"
    )


def draw(k: int | str, n: int, token: str = "token", context: str = "context") -> str:
    number = f"'{k}'" if isinstance(k, int) else f"({k})::VARCHAR"
    return f"(('0x' || substr(sha256({context} || chr(0) || {token} || chr(0) || {number}), 1, 15))::BIGINT % {n})"


def letters(first: int, count: str, alphabet: str) -> str:
    return f"list_reduce(list_transform(range({first}, {first} + {count}), lambda i: substr({lit(alphabet)}, ({draw('i', len(alphabet))} + 1)::INT, 1)), lambda a, b: a || b)"


def word(k: int, words: tuple[str, ...]) -> str:
    return f"([{', '.join(map(lit, words))}])[{draw(k, len(words))} + 1]"


_CARD = ["4", *[draw(k, 10) for k in range(14)]]
_CARD_SUM = " + ".join(f"CASE WHEN 2 * {x} > 9 THEN 2 * {x} - 9 ELSE 2 * {x} END" if (15 - i) % 2 else x for i, x in enumerate(_CARD))
RANDOM_SQL: dict[str, str] = {
    "ssn": f"printf('%03d-%02d-%04d', 1 + {draw(0, 898)} + CASE WHEN 1 + {draw(0, 898)} >= 666 THEN 1 ELSE 0 END, 1 + {draw(1, 99)}, 1 + {draw(2, 9999)})",
    "email-address": f"{letters(1, f'4 + {draw(0, 5)}', LOWER)} || (1 + {draw(20, 9999)}) || '@' || {word(21, DOMAINS)}",
    "phone-number": f"printf('(555) %03d-%04d', 100 + {draw(0, 900)}, 1000 + {draw(1, 9000)})",
    "credit-card": f"printf('%d%d%d%d-%d%d%d%d-%d%d%d%d-%d%d%d%d', {', '.join(_CARD)}, (10 - ({_CARD_SUM}) % 10) % 10)",
    "ip-address": f"printf('192.168.%d.%d', {draw(0, 256)}, {draw(1, 256)})",
    "date": f"printf('%02d/%02d/%04d', 1 + {draw(1, 12)}, 1 + {draw(2, 28)}, 1950 + {draw(0, 50)})",
    "zip-code": f"printf('%05d', {draw(0, 100000)})",
    "mac-address": f"printf('02:%02x:%02x:%02x:%02x:%02x', {', '.join(draw(k, 256) for k in range(5))})",
    "vin": letters(0, "17", VIN),
    "bank-routing-number": f"printf('%09d', {draw(0, 1000000000)})",
    "bitcoin-address": f"'1' || {letters(1, f'25 + {draw(0, 8)}', BASE58)}",
    "age": f"(1 + {draw(0, 80)}) || ' years old'",
    "url": f"'https://example.com/' || {word(1, PATHS)} || (1 + {draw(0, 9999)})",
    "iban-code": f"printf('GB%02d', 2 + {draw(0, 97)}) || {letters(1, '4', UPPER)} || printf('%06d%08d', {draw(5, 1000000)}, {draw(6, 100000000)})",
    "passport-number": f"{letters(0, '1', UPPER)} || printf('%08d', {draw(1, 100000000)})",
    "drivers-license-number": f"{letters(0, '1', UPPER)} || printf('%07d', {draw(1, 10000000)})",
    "tracking-number": f"printf('1Z%09d', {draw(0, 1000000000)})",
}
RANDOM_SQL["phone-number-extension"] = RANDOM_SQL["phone-number"]
ALL_KINDS: list[tuple[Kind, tuple[Pattern, ...]]] = [(k, k.patterns) for k in KINDS]


def of(key: str, option: str | None = None) -> list[tuple[Kind, tuple[Pattern, ...]]]:
    kind = next(k for k in KINDS if k.key == key)
    return [(kind, kind.options[option] if option else kind.patterns)]


def large_list_sql(words_sql: str, source_sql: str, fold: bool = True, near: tuple[int, float] | None = None) -> str:
    """Spans of a word list (word, position): terms grow run by run along the text's runs, whose ends are word boundaries.
    ``near``: the most edits of a near token, and its confidence."""
    key = (lambda c: f"lower({c})") if fold else (lambda c: c)
    split = lambda c, one: f"string_split(regexp_replace({c}, '({one})', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    runs = lambda c: split(c, "[0-9A-Za-z_]+")
    fields = "'custom-dictionary' AS filter_type, token, '{{{REDACTED-custom-dictionary}}}' AS replacement"
    spans = f"""
WITH RECURSIVE w0 AS (SELECT regexp_replace(word, '^\\s+|\\s+$', '', 'g') AS word, position FROM ({words_sql})),
w AS MATERIALIZED (SELECT arg_min(word, position) AS word, row_number() OVER (ORDER BY min(position)) AS place FROM w0 WHERE word <> '' GROUP BY lower(word)),
wk AS MATERIALIZED (SELECT place, {key('word')} AS key, list_filter({runs(key('word'))}, lambda x: x <> '') AS parts FROM w),
tree AS MATERIALIZED (SELECT DISTINCT array_to_string(parts[1:n], '') AS prefix FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS n FROM wk)),
c AS ({source_sql}),
p AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM (SELECT doc_id, {runs('text')} AS parts FROM c)),
placed AS (SELECT doc_id, i, n, part, (sum(strlen(part)) OVER (PARTITION BY doc_id ORDER BY i))::INT AS hi FROM p),
cells AS MATERIALIZED (SELECT doc_id, i, {key('part')} AS key, part, (hi - strlen(part))::INT AS lo, hi FROM placed WHERE i BETWEEN 2 AND n - 1),
walk AS (
    SELECT doc_id, i AS last, 1 AS runs, lo, hi, key AS prefix, part AS token FROM cells JOIN tree ON prefix = key
    UNION ALL
    SELECT k.doc_id, k.last + 1, k.runs + 1, k.lo, x.hi, t.prefix, k.token || x.part
    FROM walk k JOIN cells x ON x.doc_id = k.doc_id AND x.i = k.last + 1 JOIN tree t ON t.prefix = k.prefix || x.key
),
m0 AS MATERIALIZED (SELECT doc_id, lo, hi, token, place, runs FROM walk JOIN wk ON wk.key = walk.prefix),
laps AS MATERIALIZED (
    SELECT *, bool_or(lap) OVER (PARTITION BY doc_id, place) AS laps_once
    FROM (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id, place ORDER BY lo) > lo, false) AS lap FROM m0)
),
nth AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, place ORDER BY lo) AS k FROM laps WHERE laps_once),
chain AS (
    SELECT doc_id, place, k, hi AS till, true AS kept FROM nth WHERE k = 1
    UNION ALL
    SELECT n.doc_id, n.place, n.k, CASE WHEN n.lo >= r.till THEN n.hi ELSE r.till END, n.lo >= r.till
    FROM chain r JOIN nth n ON n.doc_id = r.doc_id AND n.place = r.place AND n.k = r.k + 1
),
m AS MATERIALIZED (
    SELECT doc_id, lo, hi, token, place, runs FROM laps WHERE NOT laps_once
    UNION ALL SELECT doc_id, lo, hi, token, place, runs FROM nth JOIN chain USING (doc_id, place, k) WHERE kept
),
held AS MATERIALIZED (SELECT doc_id, lo, hi, place FROM m WHERE runs > 1),
s AS MATERIALIZED (
    SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM held b WHERE b.doc_id = a.doc_id AND b.place < a.place AND b.lo <= a.lo AND b.hi >= a.hi)
)"""
    exact = f"SELECT doc_id, lo AS character_start, hi AS character_end, {fields}, 1.0::DOUBLE AS confidence FROM s"
    if near is None:
        return f"{spans} {exact}"
    most, confidence = near
    # Edits are counted in bytes there, so letters of several bytes become signs, which neither tokens nor words have.
    bytewise = lambda c: f"translate({c}, 'àáâäçèéêëíîïñóôöùúûüß', '!#$%&()*+,-./:;<=>?@[')"
    return f"""{spans},
t0 AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, {split('text', "[\\p{L}\\p{Nd}'']+")} AS parts FROM c)),
t1 AS (SELECT doc_id, i, part AS token, (sum(strlen(part)) OVER (PARTITION BY doc_id ORDER BY i))::INT AS hi FROM t0),
t AS MATERIALIZED (SELECT doc_id, token, (hi - strlen(token))::INT AS lo, hi FROM t1 WHERE i % 2 = 0),
close AS (
    SELECT token FROM (SELECT v.token, levenshtein({bytewise(key('v.token'))}, {bytewise('wk.key')}) AS d FROM (SELECT DISTINCT token FROM t) v, wk)
    GROUP BY token HAVING min(d) BETWEEN 1 AND {most}
)
{exact}
UNION ALL SELECT doc_id, lo, hi, {fields}, {confidence}::DOUBLE FROM t JOIN close USING (token)
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = t.doc_id AND s.lo <= t.lo AND s.hi >= t.hi)"""
