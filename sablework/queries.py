"""The registered queries of the redaction engine, with DuckDB SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablework.corpus import corpus, corpus_sql, pick
from sablework.functions.random_values import GENERATORS, random_value
from sablework.functions.spans import drop_contained, splice
from sablework.operators.big_dictionary import dictionary_rows
from sablework.operators.detectors import FUZZY, TOKEN, RegexDetector
from sablework.operators.metrics import RedactionMetrics, metrics, redactions_by_type
from sablework.operators.model import Entity
from sablework.operators.patterns import KINDS, STRICT_EMAIL, Kind, Pattern
from sablework.operators.span_rows import drop_contained_rows
from sablework.oracle import ALL_KINDS, COLUMNS, LUHN_SQL, POST_SQL, RANDOM_SQL, explain_sql, large_list_sql, of, redact_sql, spans_sql
from sablework.plans.engine import Engine, redact_requests
from sablework.plans.policy import Block, strategies_field, valid_policies
from sablework.sources.ledger import Ledger
from sablework.sources.stores import ContextStore, context_entries, scratch_dir, upsert

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

DOCS_SQL = "SELECT doc_id, '' AS context, text FROM documents"
OUT = ["doc_id", "character_start", "character_end", "filter_type", "token", "replacement", "confidence"]


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few large files of few rows each make few tasks; the detectors keep more cores busy than that."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit("").alias("context"), "text")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def rows(engine: Engine, df: DataFrame) -> DataFrame:
    return engine.explain_rows(df, context="context").select(*OUT)


def policy_of(key: str, strategy: dict | None = None, **options) -> dict:
    return {"identifiers": {key: options | ({strategies_field(key): [strategy]} if strategy else {})}}


ALL_POLICY = {"identifiers": {k.key: {} for k in KINDS}}

# --- detectors -------------------------------------------------------------------------------------------------------
for _kind in KINDS:
    register(
        f"detect_{_kind.filter_type.replace('-', '_')}",
        lambda spark, sf, key=_kind.key: rows(Engine(policy_of(key)), corpus(spark, sf)),
        explain_sql(of(_kind.key), corpus_sql()),
    )
register(
    "detect_credit_card_luhn",
    lambda spark, sf: rows(Engine(policy_of("creditCard", onlyValidCreditCardNumbers=True)), corpus(spark, sf)),
    explain_sql(of("creditCard"), corpus_sql(), post=POST_SQL | {"credit-card": LUHN_SQL}),
)
register(
    "detect_url_prefixed",
    lambda spark, sf: rows(Engine(policy_of("url", requireHttpWwwPrefix=True)), corpus(spark, sf)),
    explain_sql(of("url", "requireHttpWwwPrefix"), corpus_sql()),
)
register(
    "detect_zip_code_delimited",
    lambda spark, sf: rows(Engine(policy_of("zipCode", requireDelimiter=True)), corpus(spark, sf)),
    explain_sql(of("zipCode", "requireDelimiter"), corpus_sql()),
)


def strict_email(spark: SparkSession, sf: str) -> DataFrame:
    kind = next(k for k in KINDS if k.key == "emailAddress")
    detector = RegexDetector(kind, Block(kind.key), (STRICT_EMAIL,))
    return rows(Engine({}, detectors=[detector]), corpus(spark, sf))




def capture_group(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns of a user that mean a part of what they match: a mailbox's name, and the last digits of a number."""
    kind = next(k for k in KINDS if k.key == "ssn")
    patterns = (Pattern(r"([a-z0-9.+]+)@example([0-9])\.com", 0.5, "@", 1), Pattern(r"\b([0-9]{3})-(?:[0-9]{2})-([0-9]{4})\b", 0.75, "[0-9]", 2))
    detector = RegexDetector(Kind("user", "user", ()), Block(kind.key), patterns)
    return rows(Engine({}, detectors=[detector]), corpus(spark, sf))


_USER = [(Kind("user", "user", ()), (Pattern(r"[a-z0-9.+]+@example[0-9]\.com", 0.5), Pattern(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.75)))]
register(
    "capture_group",
    capture_group,
    f"{spans_sql(_USER, corpus_sql(), post={})}, g AS (SELECT doc_id, CASE p WHEN 0 THEN lo ELSE hi - 4 END AS lo, CASE p WHEN 0 THEN hi - 13 ELSE hi END AS hi, kind, replacement, confidence, "
    f"CASE p WHEN 0 THEN regexp_replace(token, '@.*', '') ELSE right(token, 4) END AS token FROM s) SELECT {COLUMNS} FROM g",
)
register("detect_email_address_strict", strict_email, explain_sql([(of("emailAddress")[0][0], (STRICT_EMAIL,))], corpus_sql()))
register("explain_corpus", lambda spark, sf: rows(Engine(ALL_POLICY), corpus(spark, sf)), explain_sql(ALL_KINDS, corpus_sql()))
register("explain_documents", lambda spark, sf: rows(Engine(ALL_POLICY), documents(spark, sf)), explain_sql(ALL_KINDS, DOCS_SQL))

# --- redaction, overlaps included -------------------------------------------------------------------------------------
register(
    "redact_corpus",
    lambda spark, sf: Engine(ALL_POLICY).redact(corpus(spark, sf), context="context").select("doc_id", "filtered_text"),
    redact_sql(ALL_KINDS, corpus_sql()),
)
register(
    "redact_documents",
    lambda spark, sf: Engine(ALL_POLICY).redact(documents(spark, sf), context="context").select("doc_id", "filtered_text"),
    redact_sql(ALL_KINDS, DOCS_SQL),
)
CHATS_SQL = "SELECT conv_id * 100000 + turn AS doc_id, '' AS context, text FROM conversations"
register(
    "redact_conversations",
    lambda spark, sf: Engine(ALL_POLICY)
    .redact(spark.read.parquet(f"{sf}/conversations.parquet").select((F.col("conv_id") * 100000 + F.col("turn")).alias("doc_id"), "text"))
    .select("doc_id", "filtered_text"),
    redact_sql(ALL_KINDS, CHATS_SQL),
)
_NUMBERS = [k for k in ALL_KINDS if k[0].key in ("bankRoutingNumber", "driversLicense", "ssn", "zipCode")]
register(
    "redact_overlap_drop",
    lambda spark, sf: rows(Engine({"identifiers": {k.key: {} for k, _ in _NUMBERS}}, overlap="drop"), corpus(spark, sf)),
    f"{spans_sql(_NUMBERS, corpus_sql())}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lo, f, p) AS n FROM s) "
    f"SELECT {COLUMNS} FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.doc_id = a.doc_id AND b.n < a.n AND a.lo >= b.lo AND a.hi <= b.hi)",
)
register(
    "redact_with_ignored",
    lambda spark, sf: Engine(policy_of("emailAddress", ignored=["MAIL@X.ORG", "U7.x+y@example7.com"], ignoredPatterns=[{"pattern": r"^u\d?5"}, {"pattern": "ORG$", "caseSensitive": True}]))
    .explain_rows(corpus(spark, sf), context="context").select(*OUT, "ignored", "applied"),
    f"{spans_sql(of('emailAddress'), corpus_sql())}, i AS (SELECT *, lower(token) IN ('mail@x.org', 'u7.x+y@example7.com') OR regexp_matches(token, '(?i)^u\\d?5') "
    f"OR regexp_matches(token, 'ORG$') AS ignored FROM s) SELECT {COLUMNS}, ignored, NOT ignored AS applied FROM i",
)

# --- strategies -------------------------------------------------------------------------------------------------------
STRATEGIES: dict[str, tuple[str, dict, str]] = {
    "redact_format": ("ssn", {"strategy": "REDACT", "redactionFormat": "[%t:%v]"}, "'[ssn:' || token || ']'"),
    "static": ("phoneNumber", {"strategy": "STATIC_REPLACE", "staticReplacement": "PHONE"}, "'PHONE'"),
    "static_empty": ("phoneNumber", {"strategy": "STATIC_REPLACE"}, "''"),
    "mask": ("emailAddress", {"strategy": "MASK"}, "repeat('*', strlen(token))"),
    "mask_two": ("vin", {"strategy": "MASK", "maskCharacter": "xo"}, "repeat('xo', strlen(token))"),
    "last_four_falls_back": ("ssn", {"strategy": "LAST_4", "redactionFormat": "<%t %v>"}, "'<ssn %v>'"),
    "hash_falls_back": ("ssn", {"strategy": "HASH_SHA256_REPLACE"}, "'{{{REDACTED-ssn}}}'"),
    "crypto_falls_back": ("ssn", {"strategy": "CRYPTO_REPLACE"}, "'{{{REDACTED-ssn}}}'"),
    "shift_other_falls_back": ("ssn", {"strategy": "SHIFT_DATE", "shiftDays": 1}, "'{{{REDACTED-ssn}}}'"),
}
for _name, (_key, _strategy, _sql) in STRATEGIES.items():
    register(
        f"strategy_{_name}",
        lambda spark, sf, key=_key, strategy=_strategy: Engine(policy_of(key, strategy)).redact(corpus(spark, sf), context="context").select("doc_id", "filtered_text"),
        redact_sql(of(_key), corpus_sql(), replacement=_sql),
    )

_T = "regexp_replace(array_to_string(list_transform(string_split(lower(token), ' '), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' '), ' +', ' ', 'g')"


def _shifted(days: int, months: int) -> str:
    def attempt(source: str, layout: str, shape: str) -> str:
        date = f"CASE WHEN regexp_matches({source}, '{shape}') THEN try_strptime({source}, '{layout}')::DATE END"
        moved = f"(date_trunc('month', {date}) + INTERVAL {months} MONTH + to_days((day({date}) - 1 + {days})::INT))::DATE"
        return f"strftime({moved}, '{layout.replace('%d', '%-d') if 'B' in layout or 'b' in layout else layout}')"

    named = [attempt(_T, layout, "[a-zA-Z]") for layout in ("%B %d, %Y", "%b %d, %Y", "%B %d %Y", "%b %d %Y", "%d %B %Y", "%d %b %Y")]
    iso = attempt("token", "%Y-%m-%d", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    plain = [attempt("token", f"%m{s}%d{s}%Y", f"^[0-9]{{2}}[{s}][0-9]{{2}}[{s}][0-9]{{4}}$") for s in "/.-"]
    return f"coalesce({', '.join([*named, iso, *plain])}, token)"


register(
    "strategy_shift_date",
    lambda spark, sf: rows(Engine(policy_of("date", {"strategy": "SHIFT_DATE", "shiftDays": 3, "shiftMonths": 1, "shiftYears": 2})), corpus(spark, sf)),
    explain_sql(of("date"), corpus_sql(), replacement=_shifted(3, 25)),
)
for _kind in KINDS:
    register(
        f"random_{_kind.filter_type.replace('-', '_')}",
        lambda spark, sf, key=_kind.key: rows(Engine(policy_of(key, {"strategy": "RANDOM_REPLACE"})), corpus(spark, sf)),
        explain_sql(of(_kind.key), corpus_sql(), replacement=RANDOM_SQL[_kind.filter_type]),
    )


def random_values(spark: SparkSession, sf: str) -> DataFrame:
    people = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("token"), F.col("c_mktsegment").alias("context"))
    kinds = [k for k in GENERATORS if k in RANDOM_SQL]
    made = F.array(*[F.struct(F.lit(k).alias("filter_type"), random_value(k, F.col("token"), F.col("context")).alias("value")) for k in kinds])
    return people.select("doc_id", F.explode(made).alias("v")).select("doc_id", "v.*")


register(
    "random_values",
    random_values,
    " UNION ALL ".join(
        f"SELECT c_custkey AS doc_id, '{k}' AS filter_type, {sql} AS value FROM (SELECT c_custkey, c_name AS token, c_mktsegment AS context FROM customer)" for k, sql in RANDOM_SQL.items()
    ),
)

# --- dictionaries -----------------------------------------------------------------------------------------------------
PARTS_SQL = "SELECT p_partkey AS doc_id, '' AS context, p_name || ' ' || p_type || '. ' || p_brand AS text FROM part"
WORDS = ["part", "Brand", "steel", "copper", "promo burnished", "small"]


def parts(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/part.parquet")
    return df.select(F.col("p_partkey").alias("doc_id"), F.lit("").alias("context"), F.concat("p_name", F.lit(" "), "p_type", F.lit(". "), "p_brand").alias("text"))


def _dictionary(**options) -> dict:
    return {"identifiers": {"dictionaries": [{"terms": WORDS} | options]}}


def _words_sql(fold: bool) -> list:
    from sablework.functions.dialect import quote

    return [(Kind("dictionaries", "custom-dictionary", ()), tuple(Pattern(("(?i)" if fold else "") + rf"\b{quote(w)}\b", 1.0) for w in WORDS))]


register("dictionary_exact", lambda spark, sf: rows(Engine(_dictionary()), parts(spark, sf)), explain_sql(_words_sql(True), PARTS_SQL))
register("dictionary_case_sensitive", lambda spark, sf: rows(Engine(_dictionary(caseSensitive=True)), parts(spark, sf)), explain_sql(_words_sql(False), PARTS_SQL))
for _level, (_most, _sure) in {"low": (1, 0.8), "medium": (2, 0.6), "high": (3, 0.4)}.items():
    _near = ", ".join(f"levenshtein(lower(token), '{w.lower()}')" for w in WORDS)
    register(
        f"dictionary_fuzzy_{_level}",
        lambda spark, sf, level=_level: rows(Engine(_dictionary(fuzzy=level)), parts(spark, sf)),
        f"{spans_sql(_words_sql(True), PARTS_SQL)}, w0 AS (SELECT doc_id, string_split(regexp_replace(text, '([\\p{{L}}\\p{{Nd}}'']+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM c), "
        "w1 AS (SELECT doc_id, parts, unnest(range(2, len(parts) + 1, 2)) AS i FROM w0), "
        "w2 AS (SELECT doc_id, parts[i] AS token, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: strlen(x))), 0)::INT AS lo FROM w1), "
        f"w3 AS (SELECT *, (lo + strlen(token))::INT AS hi, least({_near}) AS d FROM w2) "
        f"SELECT {COLUMNS} FROM s UNION ALL SELECT doc_id, lo, hi, 'custom-dictionary', token, '{{{{{{REDACTED-custom-dictionary}}}}}}', {_sure}::DOUBLE FROM w3 "
        f"WHERE d BETWEEN 1 AND {_most} AND NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = w3.doc_id AND w3.lo >= s.lo AND w3.hi <= s.hi)",
    )


def dictionary_by_join(spark: SparkSession, sf: str) -> DataFrame:
    words = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.explode(F.split("text", "[^0-9A-Za-z_]+")).alias("word")).distinct()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return dictionary_rows(docs, words).select("doc_id", "character_start", "character_end", "token")


register(
    "dictionary_by_join",
    dictionary_by_join,
    "WITH w AS (SELECT DISTINCT lower(x) AS k FROM (SELECT unnest(regexp_split_to_array(text, '[^0-9A-Za-z_]+')) AS x FROM benchmark) WHERE x <> ''), "
    "p AS (SELECT doc_id, string_split(regexp_replace(text, '([0-9A-Za-z_]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents), "
    "l AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p), "
    "o AS (SELECT doc_id, i, part, sum(strlen(part)) OVER (PARTITION BY doc_id ORDER BY i) AS hi FROM l) "
    "SELECT doc_id, (hi - strlen(part))::INT AS character_start, hi::INT AS character_end, part AS token FROM o JOIN w ON lower(part) = w.k WHERE i % 2 = 0",
)


# --- large dictionaries, through the engine ---------------------------------------------------------------------------
def phrases(spark: SparkSession, sf: str) -> DataFrame:
    """word, position: at each word of all benchmark items and then of all conversations, a phrase of 1 to 5 words by turns."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    longs = lambda *c: F.struct(*[x.cast("long").alias(n) for x, n in zip(c, "abc", strict=True)])
    items = read("benchmark").select(longs(F.lit(0), F.col("item_id"), F.lit(0)).alias("at"), "text")
    chats = read("conversations").select(longs(F.lit(1), F.col("conv_id"), F.col("turn")).alias("at"), "text")
    cut = "transform(array(split(text, ' ')), ws -> transform(ws, (w, i) -> array_join(slice(ws, i + 1, 1 + i % 5), ' ')))[0]"
    return items.unionByName(chats).select("at", F.posexplode(F.expr(cut)).alias("i", "word")).select("word", F.struct("at", "i").alias("position"))


def chat_words(spark: SparkSession, sf: str) -> DataFrame:
    """word, position: the words of all conversations."""
    chats = spark.read.parquet(f"{sf}/conversations.parquet")
    each = chats.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(f"({TOKEN})"), 1)).alias("i", "word"))
    return each.select("word", F.struct("conv_id", "turn", "i").alias("position"))


def benchmark_items(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), F.lit("").alias("context"), "text")


def _large(words: DataFrame, docs: DataFrame, **options) -> DataFrame:
    return rows(Engine({"identifiers": {"dictionaries": [{"files": ["list"]} | options]}}, word_lists={"list": words}), docs)


_PHRASES_SQL = (
    "SELECT array_to_string(ws[i + 1 : i + 1 + i % 5], ' ') AS word, [a, b, c, i] AS position FROM (SELECT a, b, c, ws, unnest(range(len(ws))) AS i FROM ("
    "SELECT 0 AS a, item_id AS b, 0 AS c, string_split(text, ' ') AS ws FROM benchmark UNION ALL SELECT 1, conv_id, turn, string_split(text, ' ') FROM conversations))"
)
_TOKENS = "regexp_extract_all(text, '[\\p{L}\\p{Nd}'']+')"
_CHAT_WORDS_SQL = f"SELECT ts[i + 1] AS word, [conv_id, turn, i] AS position FROM (SELECT conv_id, turn, ts, unnest(range(len(ts))) AS i FROM (SELECT conv_id, turn, {_TOKENS} AS ts FROM conversations))"
_ITEMS_SQL = "SELECT item_id AS doc_id, '' AS context, text FROM benchmark"
register("dictionary_large", lambda spark, sf: _large(phrases(spark, sf), documents(spark, sf)), large_list_sql(_PHRASES_SQL, DOCS_SQL))
register(
    "dictionary_large_case_sensitive",
    lambda spark, sf: _large(phrases(spark, sf), documents(spark, sf), caseSensitive=True),
    large_list_sql(_PHRASES_SQL, DOCS_SQL, fold=False),
)
for _level, _near in FUZZY.items():
    register(
        f"dictionary_large_fuzzy_{_level}",
        lambda spark, sf, level=_level: _large(chat_words(spark, sf), benchmark_items(spark, sf), fuzzy=level),
        large_list_sql(_CHAT_WORDS_SQL, _ITEMS_SQL, near=_near),
    )


# --- models -----------------------------------------------------------------------------------------------------------
class NamesOfClerks:
    """A stand-in for a model: finds the customer numbers' names."""

    def load(self) -> None:
        pass

    def predict(self, text: str, labels: list[str], threshold: float) -> list[Entity]:
        at = text.find("Customer#")
        return [Entity(at, at + 18, "Person", 0.9, text[at : at + 18]), Entity(at, at + 8, "Person", 0.8, text[at : at + 8])] if at >= 0 else []


def model_detector(spark: SparkSession, sf: str) -> DataFrame:
    people = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.col("c_custkey").alias("doc_id"), F.lit("").alias("context"), F.concat(F.lit("by "), "c_name", F.lit(" in "), "c_mktsegment").alias("text")
    )
    return rows(Engine({"identifiers": {"pheye": [{}]}}, models=[NamesOfClerks()]), people)


register(
    "model_detector",
    model_detector,
    "SELECT c_custkey AS doc_id, 3 AS character_start, 21 AS character_end, 'pheye' AS filter_type, substr(c_name, 1, 18) AS token, '{{{REDACTED-pheye}}}' AS replacement, "
    "0.9::DOUBLE AS confidence FROM customer WHERE c_name LIKE 'Customer#%'",
)
INERT = {"identifiers": {"currency": {}, "phoneNumberExtension": {}, "streetAddress": {}, "ssn": {"enabled": False}}, "ignored": [{"terms": ["x"]}], "crypto": {"key": "k"}}
register(
    "inert_blocks",
    lambda spark, sf: Engine(INERT).redact(corpus(spark, sf)).select("doc_id", F.size("spans").cast("long").alias("spans"), (F.col("text") == F.col("filtered_text")).alias("unchanged")),
    f"SELECT doc_id, 0::BIGINT AS spans, true AS unchanged FROM ({corpus_sql()})",
)


# --- span algebra -----------------------------------------------------------------------------------------------------
def drop_contained_spans(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    key = (F.col("l_partkey") % 40).cast("int")
    item = F.struct(F.col("l_linenumber").alias("n"), key.alias("start"), (key + F.col("l_quantity").cast("int")).alias("end"))
    spans = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max(item).alias("item")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("item")).alias("spans"))
    kept = drop_contained(F.col("spans"), "array<struct<n:int,start:int,end:int>>")
    return spans.select(F.col("l_orderkey").alias("doc_id"), F.explode(kept).alias("s")).select("doc_id", F.col("s.start").alias("character_start"), F.col("s.end").alias("character_end"))


register(
    "drop_contained_spans",
    drop_contained_spans,
    "WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, max({'s': (l_partkey % 40)::INT, 'e': (l_partkey % 40)::INT + l_quantity::INT}) AS x FROM lineitem GROUP BY ALL) "
    "SELECT doc_id, x.s AS character_start, x.e AS character_end FROM i a WHERE NOT EXISTS "
    "(SELECT 1 FROM i b WHERE a.doc_id = b.doc_id AND b.n < a.n AND a.x.s >= b.x.s AND a.x.e <= b.x.e)",
)


def contained_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A few documents that hold all lines, as spans in the order of orders and lines."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    at = (F.col("l_partkey") % 1000).cast("int")
    item = F.struct(F.concat("l_returnflag", "l_linestatus").alias("doc_id"), at.alias("start"), (at + F.col("l_quantity").cast("int")).alias("end"))
    spans = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max(item).alias("item")).select("item.*", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"))
    return drop_contained_rows(spans).select("doc_id", F.col("start").alias("character_start"), F.col("end").alias("character_end"), "n")


register(
    "drop_contained_rows",
    contained_rows,
    "WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS n, max({'d': l_returnflag || l_linestatus, 's': (l_partkey % 1000)::INT, 'e': (l_partkey % 1000)::INT + l_quantity::INT}) AS x FROM lineitem GROUP BY l_orderkey, l_linenumber), "
    "r AS MATERIALIZED (SELECT n, x.d AS d, x.s AS s, x.e AS e FROM i) SELECT d AS doc_id, s AS character_start, e AS character_end, n FROM r a WHERE NOT EXISTS "
    "(SELECT 1 FROM r b WHERE a.d = b.d AND b.n < a.n AND a.s >= b.s AND a.e <= b.e)",
)


def splice_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    text = F.lit("0123456789ABCDEF")
    one = lambda at, n, r: F.struct(
        at.alias("character_start"), (at + n).alias("character_end"), F.substring(text, at + 1, F.lit(n)).alias("text"), F.lit(r).alias("replacement"), F.lit(False).alias("ignored"), F.lit(True).alias("applied")
    )
    a, b = (F.col("o_orderkey") % 6).cast("int"), (F.col("o_custkey") % 4).cast("int")
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.array(one(a, 5, "<A>"), one(a + b, 2, "<B>"), one(a + b + 1, 3, "")).alias("spans"))
    return orders.select("doc_id", splice(text, F.col("spans")).alias("filtered_text"))


register(
    "splice_overlaps",
    splice_overlaps,
    "WITH o AS (SELECT o_orderkey AS doc_id, (o_orderkey % 6)::INT AS a, (o_custkey % 4)::INT AS b, '0123456789ABCDEF' AS t FROM orders) "
    "SELECT doc_id, substr(t, 1, a) || '<A>' || CASE WHEN a + b > a + 5 THEN substr(t, a + 6, b - 5) ELSE '' END || '<B>' "
    "|| CASE WHEN a + b + 1 > a + b + 2 THEN substr(t, a + b + 3, 0) ELSE '' END || substr(t, a + b + 2, 3) || substr(t, a + b + 5) AS filtered_text FROM o",
)


# --- requests, contexts, ledger, metrics ------------------------------------------------------------------------------
def requests(spark: SparkSession, sf: str) -> DataFrame:
    base = corpus(spark, sf, ["ssn", "email"])
    asked = base.select(
        F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("text")).alias("text"), "context",
        F.element_at(F.array(*map(F.lit, ("ids", "mail", "none"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("policy"),
        F.col("doc_id").cast("string").alias("document_id"), F.lit("f.txt").alias("file_name"),
    )
    out = redact_requests(asked, {"ids": policy_of("ssn"), "mail": policy_of("emailAddress")})
    return out.select("document_id", "policy", "error", "filtered_text", F.size("spans").cast("long").alias("spans"))


_REQ = corpus_sql(["ssn", "email"])
_REQ_PART = (
    "SELECT c.doc_id, r.filtered_text, (SELECT count(*) FROM ({spans} SELECT doc_id FROM s) z WHERE z.doc_id = c.doc_id) AS n "
    "FROM ({source}) c JOIN ({redact}) r USING (doc_id)"
)


def _requests_sql() -> str:
    parts = {
        key: _REQ_PART.format(spans=spans_sql(of(key), _REQ), source=_REQ, redact=redact_sql(of(key), _REQ)) for key in ("ssn", "emailAddress")
    }
    return (
        f"WITH a AS ({parts['ssn']}), b AS ({parts['emailAddress']}) SELECT c.doc_id::VARCHAR AS document_id, "
        "(['ids', 'mail', 'none'])[c.doc_id % 3 + 1] AS policy, "
        "CASE WHEN c.doc_id % 11 = 0 THEN 'text is required' WHEN c.doc_id % 3 = 2 THEN 'no policy none' END AS error, "
        "CASE WHEN c.doc_id % 11 = 0 THEN NULL WHEN c.doc_id % 3 = 0 THEN a.filtered_text WHEN c.doc_id % 3 = 1 THEN b.filtered_text END AS filtered_text, "
        "CASE WHEN c.doc_id % 11 = 0 THEN 0 WHEN c.doc_id % 3 = 0 THEN a.n WHEN c.doc_id % 3 = 1 THEN b.n ELSE 0 END AS spans "
        f"FROM ({_REQ}) c JOIN a USING (doc_id) JOIN b USING (doc_id)"
    )


register("requests_by_policy", requests, _requests_sql())
_SHAPES = [
    ("ssn", '{"identifiers":{"ssn":{}}}'),
    ("ssn", '{"identifiers":{"ssn":{"ssnFilterStrategies":[{"strategy":"STATIC_REPLACE","staticReplacement":"S#"}]}}}'),
    ("email-address", '{"identifiers":{"emailAddress":{"emailAddressFilterStrategies":[{"strategy":"MASK","maskCharacter":"#"}]},"ssn":{"enabled":false}}}'),
    ("", '{"identifiers":{"emailAddress":{"ignored":["U#.X+Y@EXAMPLE0.com"],"ignoredPatterns":[{"pattern":"org$"}]},"ssn":{"ssnFilterStrategies":[{"redactionFormat":"[%t:%v]#"}]}}}'),
    ("bad", '{"identifiers":['),
]


def requests_policy_table(spark: SparkSession, sf: str) -> DataFrame:
    """A thousand policies in a table, one for each thousandth of the customers."""
    number, shape = F.col("doc_id") % 1000, (F.col("doc_id") % len(_SHAPES) + 1).cast("int")
    text = F.replace(F.element_at(F.array(*[F.lit(p) for _, p in _SHAPES]), shape), F.lit("#"), number.cast("string"))
    base = corpus(spark, sf, ["ssn", "email"])
    policies = base.select(F.concat(F.lit("p"), number.cast("string")).alias("name"), text.alias("policy")).distinct()
    asked = base.select("text", "context", F.concat(F.lit("p"), number.cast("string")).alias("policy"), F.col("doc_id").cast("string").alias("document_id"), F.lit("f").alias("file_name"))
    out = redact_requests(asked, policies)
    return out.select("document_id", "filtered_text", F.col("error").isNotNull().alias("failed"))


_NUMBER, _SHAPE = "(doc_id % 1000)::VARCHAR", f"doc_id % {len(_SHAPES)}"
_INSTEAD = (
    f"CASE {_SHAPE} WHEN 0 THEN '{{{{{{REDACTED-ssn}}}}}}' WHEN 1 THEN 'S' || {_NUMBER} WHEN 2 THEN repeat({_NUMBER}, strlen(token)) "
    f"ELSE CASE kind WHEN 'ssn' THEN '[ssn:' || token || ']' || {_NUMBER} ELSE '{{{{{{REDACTED-email-address}}}}}}' END END"
)
_WHERE = (
    f"CASE {_SHAPE} WHEN 0 THEN kind = 'ssn' WHEN 1 THEN kind = 'ssn' WHEN 2 THEN kind = 'email-address' "
    f"ELSE kind = 'ssn' OR NOT (lower(token) = 'u' || {_NUMBER} || '.x+y@example0.com' OR regexp_matches(token, '(?i)org$')) END"
)
register(
    "requests_policy_table",
    requests_policy_table,
    f"SELECT doc_id::VARCHAR AS document_id, CASE WHEN {_SHAPE} < 4 THEN filtered_text END AS filtered_text, {_SHAPE} = 4 AS failed "
    f"FROM ({redact_sql([*of('emailAddress'), *of('ssn')], _REQ, where=_WHERE, replacement=_INSTEAD)})",
)
# Policies of every kind, one a customer: valid ones, broken text, and values of the wrong type.
_POLICIES = pick("c_custkey", ['{"identifiers":{"ssn":{}}}', "{}", "", "{", '{"identifiers":[]}', '{"identifiers":{"ssn":{"enabled":false}}}', "[1]", '{"identifiers":{"ssn":7}}'])


def validate_policies(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.expr(_POLICIES).alias("policy"))
    return asked.select("doc_id", valid_policies("policy").alias("valid"))


register("validate_policies", validate_policies, "SELECT c_custkey AS doc_id, c_custkey % 8 IN (0, 1, 5) AS valid FROM customer")
_SSN = policy_of("ssn", {"strategy": "RANDOM_REPLACE"})


def _explained(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(_SSN).explain(corpus(spark, sf), context="context")


_SSN_SPANS = spans_sql(of("ssn"), corpus_sql(), replacement=RANDOM_SQL["ssn"])
_ENTRIES = "SELECT context, sha256(token) AS token_hash, arg_max(replacement, doc_id * 1000000 + lo) AS replacement FROM s GROUP BY ALL"


def _contexts(spark: SparkSession, sf: str) -> ContextStore:
    """A store on disk that has taken in the corpus, the even documents first."""
    store = ContextStore(spark, scratch_dir(spark))
    found = _explained(spark, sf)
    for half in (0, 1):
        store.put(context_entries(found.where(F.col("doc_id") % 2 == half), "doc_id"))
    return store


def context_delete(spark: SparkSession, sf: str) -> DataFrame:
    store = _contexts(spark, sf)
    store.delete("ctx3")
    return store.table.read()


register(
    "context_upsert",
    lambda spark, sf: upsert(spark.createDataFrame([], "context string, token_hash string, replacement string"), context_entries(_explained(spark, sf), "doc_id")),
    f"{_SSN_SPANS} {_ENTRIES}",
)
register(
    "context_count",
    lambda spark, sf: _contexts(spark, sf).counts(),
    f"{_SSN_SPANS}, e AS ({_ENTRIES}) SELECT context, count(*) AS count FROM e GROUP BY context",
)
register(
    "context_list",
    lambda spark, sf: _contexts(spark, sf).list(),
    f"{_SSN_SPANS} SELECT DISTINCT context FROM s",
)
register(
    "context_delete",
    context_delete,
    f"{_SSN_SPANS}, e AS ({_ENTRIES}) SELECT * FROM e WHERE context <> 'ctx3'",
)


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    docs = _explained(spark, sf).select(F.col("doc_id").cast("string").alias("document_id"), F.lit("f.txt").alias("file_name"), "spans")
    return Ledger().record(docs, F.timestamp_millis(F.lit(_RECORDED)))


_RECORDED = 1704164645678
_FIELDS = ("index", "document_id", "text", "replacement", "start", "stop", "file_name", "timestamp", "previous_hash")
_HASH_SQL = " || ".join(f"strlen(r.{f}::VARCHAR) || ':' || r.{f}::VARCHAR" for f in _FIELDS)
register(
    "ledger_record",
    lambda spark, sf: _ledger(spark, sf).withColumns({"timestamp": F.unix_millis("timestamp"), "previous_hash": F.hex("previous_hash")}).select(*_FIELDS),
    f"{_SSN_SPANS.replace('WITH', 'WITH RECURSIVE', 1)}, e AS MATERIALIZED (SELECT (row_number() OVER (PARTITION BY doc_id ORDER BY lo, p) - 1)::INT AS index, doc_id::VARCHAR AS document_id, "
    f"token AS text, replacement, lo AS start, hi AS stop, 'f.txt' AS file_name, {_RECORDED}::BIGINT AS timestamp FROM s), "
    "r AS (SELECT e.*, repeat('0', 64) AS previous_hash FROM e WHERE index = 0 UNION ALL "
    f"SELECT e.*, upper(sha256({_HASH_SQL})) FROM r JOIN e ON e.document_id = r.document_id AND e.index = r.index + 1) SELECT {', '.join(_FIELDS)} FROM r",
)


def ledger_verify(spark: SparkSession, sf: str) -> DataFrame:
    entries = _ledger(spark, sf)
    third = F.col("document_id").cast("long") % 3
    changed = F.when((third == 0) & (F.col("index") == 0), F.lit("tampered")).otherwise(F.col("replacement"))
    return Ledger().verify_all(entries.withColumn("replacement", changed))


register(
    "ledger_verify",
    ledger_verify,
    f"{_SSN_SPANS} SELECT doc_id::VARCHAR AS document_id, NOT (doc_id % 3 = 0 AND count(*) > 1) AS valid, count(*) AS entries FROM s GROUP BY doc_id",
)
_SPACE = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
register(
    "metrics",
    lambda spark, sf: metrics(Engine(ALL_POLICY).explain(documents(spark, sf)), _contexts(spark, sf).table.read()),
    f"{spans_sql(ALL_KINDS, DOCS_SQL)} SELECT (SELECT count(*) FROM c) AS documents, "
    f"(SELECT sum(len(list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda w: w <> '')))::BIGINT FROM c) AS tokens_received, "
    f"(SELECT count(*) FROM s) AS redactions_total, (SELECT count(DISTINCT context) FROM ({_SSN_SPANS} SELECT context FROM s)) AS contexts, 1 AS healthy",
)


def metrics_observed(spark: SparkSession, sf: str) -> DataFrame:
    """The counters of a redaction that is written, kept by the job that writes it."""
    counts = RedactionMetrics()
    counts.watch(Engine(ALL_POLICY).redact(documents(spark, sf))).write.parquet(f"{scratch_dir(spark)}/redacted")
    return counts.row(spark, _contexts(spark, sf).table.read())


register("metrics_observed", metrics_observed, ORACLE_SQL["metrics"])
register(
    "redactions_by_type",
    lambda spark, sf: redactions_by_type(Engine(ALL_POLICY).explain(documents(spark, sf))),
    f"{spans_sql(ALL_KINDS, DOCS_SQL)} SELECT kind AS filter_type, count(*) AS redactions FROM s GROUP BY kind",
)
