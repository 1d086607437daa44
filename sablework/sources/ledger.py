"""The ledger: per document a chain of redactions, each entry holding the hash of the one before it.

An entry's hash is the SHA-256 of its fields, each as decimal length, colon and
text; the chain starts from 32 zero bytes. Texts may be encrypted (AES-GCM with an
initialisation vector derived from key, document and index, so a task that is run
again writes the same entry); hashes then cover what is stored. The last entry of a
chain is covered by no later hash.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sablework.sources.stores import NotFound

ENTRY = (
    "index int, document_id string, text string, replacement string, start int, stop int, file_name string,"
    " timestamp timestamp, previous_hash binary"
)
FIELDS = tuple(f.split()[0] for f in ENTRY.split(", "))
#: Where a document's chain ends.
TAIL = "document_id string, index int, hash binary"
HASHED = ("index", "document_id", "text", "replacement", "start", "stop", "file_name", "timestamp", "previous_hash")


def zero_hash() -> Column:
    return F.unhex(F.lit("00" * 32))


def hashed_text(get, names: tuple[str, ...] = HASHED) -> Column:
    """Of fields that ``get`` gives by name, each one's length, a colon and its text."""
    parts = []
    for name in names:
        value = get(name)
        text = F.hex(value) if name == "previous_hash" else F.unix_millis(value).cast("string") if name == "timestamp" else value.cast("string")
        text = F.coalesce(text, F.lit(""))
        parts.append(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.concat(*parts)


def entry_hash(get) -> Column:
    """The hash of an entry whose fields ``get`` gives by name."""
    return F.unhex(F.sha2(hashed_text(get).cast("binary"), 256))


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by document and index, with the text of all their other fields (__body) and, in previous_hash, the end of
    the chain that their document goes on from; each gets the hash of the one before it."""
    document, last = object(), b""
    for batch in batches:
        before = []
        for d, start, body in zip(*(batch.column(c).to_pylist() for c in ("document_id", "previous_hash", "__body")), strict=True):
            if d != document:
                document, last = d, start
            before.append(last)
            text = last.hex().upper()
            last = hashlib.sha256(f"{body}{len(text)}:{text}".encode()).digest()
        at = batch.schema.get_field_index("previous_hash")
        yield batch.set_column(at, batch.schema.field(at), pa.array(before, batch.schema.field(at).type)).select(list(FIELDS))


class Ledger:
    def __init__(self, key: bytes | None = None) -> None:
        if key is not None and len(key) not in (16, 24, 32):
            warnings.warn("a ledger key has 16, 24 or 32 bytes: texts stay in clear", stacklevel=2)
            key = None
        self.key = key

    def _key(self) -> Column:
        return F.unhex(F.lit(self.key.hex()))

    def seal(self, text: Column, document_id: Column, index: Column) -> Column:
        if not self.key:
            return text
        seed = F.concat(F.lit(hashlib.sha256(self.key).hexdigest()), document_id, F.lit("|"), index.cast("string"), F.lit("|"), text)
        vector = F.substring(F.unhex(F.sha2(seed.cast("binary"), 256)), 1, 12)
        return F.base64(F.aes_encrypt(text.cast("binary"), self._key(), F.lit("GCM"), F.lit("DEFAULT"), vector))

    def unseal(self, text: Column) -> Column:
        return F.aes_decrypt(F.unbase64(text), self._key(), F.lit("GCM")).cast("string") if self.key else text

    def tails(self, ledger: DataFrame) -> DataFrame:
        """document_id, index, hash: where each document's chain ends."""
        last = ledger.groupBy("document_id").agg(F.max_by(F.struct(*[F.col(c) for c in HASHED]), "index").alias("last"))
        return last.select("document_id", "last.index", entry_hash(lambda n: F.col(f"last.{n}")).alias("hash"))

    def record(self, explained: DataFrame, timestamp: Column, ledger: DataFrame | None = None, tails: DataFrame | None = None) -> DataFrame:
        """New entries of documents (document_id, file_name, spans): one per span, ignored ones too, chained per
        document, going on from what ``ledger`` already has of it, or from its tails() where these are at hand. Several rows
        of one document_id make one chain, in the order of their timestamps and file names (then of a hash of their spans);
        rows without an id are one document.

        A chain can't be split, but its entries pass by one after the other, sorted; no task holds a document's entries.
        """
        rows = explained.where("size(spans) > 0").select(
            "document_id", timestamp.alias("timestamp"), F.coalesce("file_name", F.lit("")).alias("file_name"), F.xxhash64("spans").alias("__tie"),
            F.monotonically_increasing_id().alias("__row"), "spans",
        )
        each = rows.select("document_id", "timestamp", "file_name", "__tie", "__row", F.posexplode("spans").alias("__pos", "s"))
        tails = self.tails(ledger) if tails is None and ledger is not None else tails
        if tails is None:
            each = each.withColumns({"__first": F.lit(0), "__before": zero_hash()})
        else:
            ends = tails.select("document_id", (F.col("index") + 1).alias("__first"), F.col("hash").alias("__before"))
            each = each.join(ends, "document_id", "left").withColumns({"__first": F.coalesce("__first", F.lit(0)), "__before": F.coalesce("__before", zero_hash())})
        order = Window.partitionBy("document_id").orderBy("timestamp", "file_name", "__tie", "__row", "__pos")
        numbered = each.withColumn("index", F.col("__first") + F.row_number().over(order) - 1)
        entries = numbered.select(
            "index", "document_id", self.seal(F.col("s.text"), F.col("document_id"), F.col("index")).alias("text"), F.col("s.replacement").alias("replacement"),
            F.col("s.character_start").alias("start"), F.col("s.character_end").alias("stop"), "file_name", "timestamp", F.col("__before").alias("previous_hash"),
        )
        # What the window has put together and in order stays so.
        sealed = entries.withColumn("__body", hashed_text(F.col, HASHED[:-1])).sortWithinPartitions("document_id", "index")
        return sealed.mapInArrow(chain, ENTRY)

    def get(self, ledger: DataFrame, document_id: str) -> DataFrame:
        """A document's entries by index, in clear."""
        return ledger.where(F.col("document_id") == document_id).withColumn("text", self.unseal(F.col("text"))).orderBy("index")

    def verify_all(self, ledger: DataFrame) -> DataFrame:
        """document_id, valid, entries: every entry holds the hash of the one before it."""
        order = Window.partitionBy("document_id").orderBy("index")
        hashed = ledger.withColumn("own", entry_hash(F.col))
        linked = F.col("previous_hash") == F.coalesce(F.lag("own").over(order), zero_hash())
        return hashed.withColumn("ok", linked).groupBy("document_id").agg(F.bool_and("ok").alias("valid"), F.count(F.lit(1)).alias("entries"))

    def verify(self, ledger: DataFrame, document_id: str) -> bool:
        row = self.verify_all(ledger.where(F.col("document_id") == document_id)).first()
        if row is None:
            raise NotFound(document_id)
        return row.valid
